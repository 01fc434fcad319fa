"""Chat formatting: collapse cumulative snapshots of conversations, then render what is left.

Logs often hold a conversation again and again as it grows. Rolling hashes over the turns of every conversation name
each of its prefixes; a conversation whose whole hash is a proper prefix of another one is a snapshot and goes.
Conversations are worked on in blocks of turns, so a conversation of any length spreads over tasks.
Native: DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loam.llm.common import id_key

BLOCK_TURNS = 256
LAST_BLOCK = 2**62


def _turns(conversations: DataFrame, block_turns: int) -> DataFrame:
    """Distinct turns with their conversation's key, their block and their place in the block."""
    turns = conversations.select("conv_id", "turn", "role", "text").distinct()
    turns = turns.withColumn("__conv", id_key("conv_id")).withColumn("__block", F.coalesce(F.floor(F.col("turn") / block_turns), F.lit(LAST_BLOCK)).cast("long"))
    order = [F.col("turn").asc_nulls_last(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first()]
    return turns.withColumn("__idx", F.row_number().over(Window.partitionBy("__conv", "__block").orderBy(*order)))


def _with_block_offsets(turns: DataFrame, values: dict[str, Column]) -> DataFrame:
    """Adds, for each value, its sum over the conversation's earlier blocks (<name>_before)."""
    blocks = turns.groupBy("__conv", "__block").agg(*[F.sum(v).alias(n) for n, v in values.items()])
    earlier = Window.partitionBy("__conv").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select("__conv", "__block", *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"{n}_before") for n in values])
    return turns.join(offsets, ["__conv", "__block"])


def prefix_hashes(conversations: DataFrame, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """Turns with __pos (place in the conversation from 1) and the rolling hash of the turns up to it (__ha, __hb).

    A turn's hash is salted with its place and prefix hashes are sums of two 64-bit lanes, so blocks combine.
    """
    turns = _with_block_offsets(_turns(conversations, block_turns), {"__n": F.lit(1)})
    turns = turns.withColumn("__pos", F.col("__n_before") + F.col("__idx"))
    lanes = {
        "__a": F.xxhash64("__pos", F.col("role").isNull(), "role", F.col("text").isNull(), "text").cast("decimal(20,0)"),
        "__b": F.xxhash64(F.lit("second lane"), "text", "role", F.col("text").isNull(), "__pos").cast("decimal(20,0)"),
    }
    turns = _with_block_offsets(turns.withColumns(lanes), {n: F.col(n) for n in lanes})
    up_to = Window.partitionBy("__conv", "__block").orderBy("__idx").rowsBetween(Window.unboundedPreceding, 0)
    return turns.withColumns({f"__h{n[-1]}": F.col(f"{n}_before") + F.sum(n).over(up_to) for n in lanes})


def maximal_conversations(hashed: DataFrame) -> DataFrame:
    """Key and number of turns of the conversations that are no snapshot: of equal ones the smallest id, null last."""
    sizes = hashed.groupBy("__conv").agg(F.max("__pos").alias("n_turns"))
    hashed = hashed.select("conv_id", "__conv", "__pos", "__ha", "__hb").join(sizes, "__conv")
    first = F.min(F.struct(F.col("conv_id").isNull().alias("no_id"), "conv_id", "__conv")).alias("first")
    whole = hashed.filter("__pos = n_turns").groupBy("n_turns", "__ha", "__hb").agg(first)
    prefixes = hashed.filter("__pos < n_turns").select(F.col("__pos").alias("n_turns"), "__ha", "__hb").distinct()
    return whole.join(prefixes, ["n_turns", "__ha", "__hb"], "left_anti").select("first.__conv", "n_turns")


def _segment() -> Column:
    """One turn as text; control marks inside a turn's own text are broken up."""
    clean = lambda c: F.replace(F.coalesce(F.col(c), F.lit("")), F.lit("<|"), F.lit("<\\|"))
    role = F.when(F.col("role").isNull(), F.lit("unknown")).otherwise(clean("role"))
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), clean("text"), F.lit("<|end|>\n"))


def format_chats(conversations: DataFrame, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """conv_id, part, n_turns (of the conversation) and text of every maximal conversation.

    text has the turns in order of turn (null last, ties by role and text), each as <|role|>, its text and <|end|>.
    A part has the turns whose numbers share a block, so one row stays bounded; most conversations are one part 0.

    Repeated rows count once. Null role: unknown; null text: empty. Rows with a null conv_id are one conversation.
    An empty table gives no rows; further columns don't matter.
    """
    hashed = prefix_hashes(conversations, block_turns)
    keep = maximal_conversations(hashed)
    turns = _turns(conversations, block_turns).join(keep, "__conv")
    in_order = F.array_sort(F.collect_list(F.struct("__idx", _segment().alias("segment"))))
    parts = turns.groupBy("__conv", "__block").agg(F.first("conv_id").alias("conv_id"), F.first("n_turns").alias("n_turns"), F.array_join(F.transform(in_order, lambda x: x["segment"]), "").alias("text"))
    part = F.row_number().over(Window.partitionBy("__conv").orderBy("__block")) - 1
    return parts.select("conv_id", part.cast("long").alias("part"), F.col("n_turns").cast("long").alias("n_turns"), "text")


ORACLE = r"""
WITH t AS (SELECT DISTINCT conv_id, turn, role, text, CAST(floor(turn / 256) AS BIGINT) AS blk FROM conversations),
o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role NULLS FIRST, text NULLS FIRST) AS pos,
         count(*) OVER (PARTITION BY conv_id) AS n FROM t
), p AS (
  SELECT *, string_agg(md5(coalesce('r' || role, '') || chr(1) || coalesce('t' || text, '')), '')
            OVER (PARTITION BY conv_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sig FROM o
), w AS (SELECT n, sig, min(conv_id) AS conv_id FROM p WHERE pos = n GROUP BY n, sig),
k AS (SELECT * FROM w WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.pos < p.n AND p.pos = w.n AND p.sig = w.sig)),
g AS (
  SELECT o.conv_id, coalesce(o.blk, 4611686018427387904) AS blk, any_value(k.n) AS n_turns,
         string_agg('<|' || CASE WHEN role IS NULL THEN 'unknown' ELSE replace(role, '<|', '<\|') END || '|>' || chr(10)
                    || replace(coalesce(text, ''), '<|', '<\|') || '<|end|>' || chr(10), '' ORDER BY pos) AS text
  FROM o JOIN k ON o.conv_id = k.conv_id GROUP BY 1, 2
)
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY blk) - 1 AS part, n_turns, text FROM g
"""
