"""Mixing sources to target weights: hash-random order, distributed prefix sums, exact budgets.

Documents of a source are put in the order of a hash key. The key's first hex digits are a range bucket, so
(source, bucket) groups are ranges of that order: bucket totals give every bucket its offset, and a window inside
the bucket gives every document its place in the source's token line. No task ever holds a whole source.
Native: DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loam.llm.common import WORD, word_count

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
BUCKET_DIGITS = 3


def _source_targets(sources: DataFrame, weights: tuple[int, ...], max_epochs: int) -> DataFrame:
    """One row a source in, with its target: shares by weight, at most max_epochs times its size.

    Re-sharing the excess by weight until no source is above its cap ends at min(level * weight, cap) for the one
    level at which the targets sum to everything. With sources in order of cap / weight, the level is that of the
    first source that a level computed from the capped ones before it doesn't fill.
    """
    rank = Window.orderBy(F.col("__source").isNull(), "__source")
    by_fill = Window.orderBy("__fill", "__rank")
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    after = by_fill.rowsBetween(0, Window.unboundedFollowing)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("__rank") % len(weights) + 1).cast("int"))
    ranked = (
        sources.withColumn("__rank", F.row_number().over(rank) - 1)
        .withColumn("__weight", weight)
        .withColumn("__cap", F.col("source_size") * max_epochs)
        .withColumn("__fill", F.col("__cap") / F.col("__weight"))
        .withColumn("__total", F.sum("source_size").over(Window.partitionBy()))
        .withColumn("__capped", F.coalesce(F.sum("__cap").over(before), F.lit(0)))
        .withColumn("__rest", F.sum("__weight").over(after))
        .withColumn("__level", (F.col("__total") - F.col("__capped")) / F.col("__rest"))
    )
    level = F.min(F.when(F.col("__level") <= F.col("__fill"), F.struct("__fill", "__rank", "__level"))).over(Window.partitionBy())
    capped = F.col("__fill") < F.col("__at.__level")
    target = F.when(capped, F.col("__cap").cast("double")).otherwise(F.col("__at.__level") * F.col("__weight"))
    return ranked.withColumn("__at", level).select("__key_source", "source_size", target.alias("target"))


def mix(docs: DataFrame, carry: list[str] | None = None, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = "mix", bucket_digits: int = BUCKET_DIGITS) -> DataFrame:
    """doc_id, size, source_size, target and taken of every row of docs (doc_id, text, source).

    taken: words the mix takes of the row, repeats counted: whole epochs, then the source's documents in hash order
    until its budget is used up; the document at the cut gives only its first words. So the words taken of a source
    are its target rounded down, and a row gives at most max_epochs times its size.

    Null text: size 0, nothing taken. Null source: a source of its own, last. Null or repeated ids and repeated rows:
    each row counts; equal rows are interchangeable. No words at all: every target is 0. Other columns don't matter;
    those in carry come along as a struct named carried.
    """
    text_hash = F.coalesce(F.md5(F.col("text").cast("binary")), F.lit(""))
    key = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), text_hash).cast("binary"))
    extra = [F.struct(*[F.col(f"`{c}`") for c in carry]).alias("carried")] if carry else []
    keyed_source = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
    rows = docs.select("doc_id", F.col("source").alias("__source"), keyed_source.alias("__key_source"), word_count(F.col("text")).alias("size"), key.alias("__key"), *extra)
    rows = rows.withColumn("__bucket", F.substring("__key", 1, bucket_digits))
    light = docs.select(F.col("source").alias("__source"), keyed_source.alias("__key_source"), word_count(F.col("text")).alias("size"), F.substring(key, 1, bucket_digits).alias("__bucket"))
    buckets = light.groupBy("__key_source", "__source", "__bucket").agg(F.sum("size").alias("__bucket_size"))
    sources = buckets.groupBy("__key_source", "__source").agg(F.sum("__bucket_size").alias("source_size"))
    targets = _source_targets(sources, weights, max_epochs)
    in_source = Window.partitionBy("__key_source").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = buckets.select("__key_source", "__bucket", F.coalesce(F.sum("__bucket_size").over(in_source), F.lit(0)).alias("__offset")).join(targets, "__key_source")
    in_bucket = Window.partitionBy("__key_source", "__bucket").orderBy("__key", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.join(offsets, ["__key_source", "__bucket"]).withColumn("__before", F.col("__offset") + F.coalesce(F.sum("size").over(in_bucket), F.lit(0)))
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.expr("floor(target) div source_size")).otherwise(F.lit(0))
    rest = budget - epochs * F.col("source_size")
    part = F.least(F.greatest(rest - F.col("__before"), F.lit(0)), F.col("size"))
    taken = (epochs * F.col("size") + part).cast("long")
    return placed.select("doc_id", "size", "source_size", "target", taken.alias("taken"), *(["carried"] if carry else []))


def _first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word."""
    words = F.slice(F.regexp_extract_all(text, F.lit(rf"([\x20\x09-\x0D]*{WORD})"), F.lit(1)), F.lit(1), n.cast("int"))
    return F.array_join(words, "")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus itself, with the columns of docs: a row for each epoch of a document, the last one cut.

    n_chars, where docs has it, is that of the row's own text. Documents of which nothing is taken are left out.
    """
    columns = docs.columns
    mixed = mix(docs, carry=columns, **options).filter("taken > 0")
    whole = F.expr("taken div size")
    part = F.col("taken") - whole * F.col("size")
    copies = mixed.select("carried", F.explode(F.concat(F.array_repeat(F.lit(-1).cast("long"), whole.cast("int")), F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<bigint>")))).alias("__words"))
    text = F.when(F.col("__words") < 0, F.col("carried.text")).otherwise(_first_words(F.col("carried.text"), F.col("__words")))
    out = copies.select(*[text.alias(c) if c == "text" else F.col(f"carried.`{c}`").alias(c) for c in columns])
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in columns else out


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(md5(text), '')) AS k
  FROM documents
), s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rk FROM s),
w AS (SELECT *, CASE rk % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS wt FROM r),
c AS (SELECT *, 3 * source_size AS cap, (3 * source_size) / wt AS fill FROM w),
l AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY fill, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(wt) OVER (ORDER BY fill, rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv FROM c
), v AS (SELECT lv FROM l WHERE lv <= fill ORDER BY fill, rk LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN fill < (SELECT lv FROM v) THEN CAST(cap AS DOUBLE) ELSE (SELECT lv FROM v) * wt END AS target FROM c),
p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bef
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), e AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target) AS BIGINT) // source_size ELSE 0 END AS ep FROM p)
SELECT doc_id, size, source_size, target,
       CAST(ep * size + least(greatest(CAST(floor(target) AS BIGINT) - ep * source_size - bef, 0), size) AS BIGINT) AS taken
FROM e
"""
