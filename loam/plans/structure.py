"""Queries on the structure of documents and on what relates rows: sections, chunks, related documents, as-of, partners."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.operators import asof, related, sections
from loam.session import table

MAX_CHARS = 1200
#: Keywords by concept, as they stand in the texts of the tables.
CONCEPTS = {"contact": ["@", "+1", "+4"], "licence": ["licen", "copyright", "apache"], "secret": ["password", "token", "secret"], "web": ["http", "www."], "junk": ["|", "<", "&"], "abuse": ["idiot", "stupid"]}
_WHITE = r"' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _conversation_texts(spark: SparkSession, d: str) -> DataFrame:
    """conv_id, title and a text with a heading for each turn, one to three marks deep, and the turn's text below."""
    turn = F.struct("turn", F.concat(F.repeat(F.lit("#"), (1 + F.col("turn") * 2 % 3).cast("int")), F.lit(" "), F.col("role"), F.lit(" "), F.col("turn"), F.lit("\n\n"), F.col("text")).alias("part"))
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    return rows.select("conv_id", F.concat(F.lit("conversation "), F.col("conv_id")).alias("title"), F.array_join(F.transform("turns", lambda t: t["part"]), "\n").alias("text"))


def _document_chunks(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "source", "text")
    return sections.chunked(docs, "source", "text", MAX_CHARS).select("doc_id", F.col("chunk").cast("bigint").alias("chunk"), "path", F.length("body").cast("bigint").alias("n_chars"), F.md5("body").alias("digest"))


def _conversation_sections(spark: SparkSession, d: str) -> DataFrame:
    chunks = sections.chunked(_conversation_texts(spark, d), "title", "text", 1_000_000)
    return chunks.select("conv_id", F.col("chunk").cast("bigint").alias("chunk"), "path", F.md5("body").alias("digest"))


def _outlines(spark: SparkSession, d: str) -> DataFrame:
    docs = _conversation_texts(spark, d)
    text = sections.enveloped("OUTLINE_V1", {"doc_title": F.col("title"), "content_kind": F.lit("section_outline")}, sections.outline(sections.headings(F.col("text"))))
    return docs.select("conv_id", text.alias("outline"))


def _outline_steps(spark: SparkSession, d: str) -> DataFrame:
    steps = sections.outline_steps(_conversation_texts(spark, d), "text")
    return steps.select("conv_id", F.col("place").cast("bigint").alias("place"), "title", F.array_join("before", ",").alias("before"))


def _related_documents(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    near = related.nearest_related(docs, "doc_id", F.concat_ws("/", "source", "lang"), related.concepts_of(F.col("text"), CONCEPTS), "source", 10)
    return near.select("a", "b", "same_group", F.array_join("shared", ",").alias("shared"), F.col("place").cast("bigint").alias("place"))


def _other_nation(spark: SparkSession, d: str) -> DataFrame:
    """Each customer with the richest one of the same market segment that is of another nation."""
    rows = table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_nationkey", "c_acctbal")
    return related.best_of_other_side(rows, "c_mktsegment", "c_nationkey", "c_custkey", "c_acctbal").select("c_custkey", "partner", "partner_score")


def _last_click(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", "user_id", "ts", "event_type", "value")
    return asof.last_before(e.filter("event_type <> 'click'"), e.filter("event_type = 'click'"), ["user_id"], "ts", ["event_id", "value"]).select("event_id", "last_event_id", "last_value")


_CONV = """SELECT conv_id, turn, role || ' ' || turn AS title, 1 + turn * 2 % 3 AS level, text FROM conversations"""
_CONCEPTS_SQL = "[" + ", ".join("CASE WHEN " + " OR ".join(f"contains(lower(text), '{w}')" for w in words) + f" THEN '{name}' END" for name, words in CONCEPTS.items()) + "]"

CATALOG: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    # texts of documents have neither headings nor blank lines, so a document is one section of one paragraph here
    "document_chunks": (
        _document_chunks,
        f"""WITH RECURSIVE s AS (SELECT doc_id, source, trim(text, {_WHITE}) AS t FROM documents),
        l AS (SELECT doc_id, source, CASE WHEN length(t) <= {MAX_CHARS} THEN [t] ELSE list_filter(list_transform(string_split(regexp_replace(t, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, {_WHITE})), lambda x: x <> '') END AS sentences FROM s),
        i AS (SELECT doc_id, source, list_filter(flatten(list_transform(sentences, lambda x: CASE WHEN length(x) <= {MAX_CHARS} THEN [{{'t': x, 'solo': false}}] ELSE list_transform(range(0, CAST(ceil(length(x) / {MAX_CHARS}) AS BIGINT)), lambda k: {{'t': trim(substr(x, k * {MAX_CHARS} + 1, {MAX_CHARS}), {_WHITE}), 'solo': true}}) END)), lambda x: x.t <> '') AS items FROM l),
        e AS (SELECT doc_id, source, unnest(items) AS item, generate_subscripts(items, 1) AS n FROM i),
        r AS (SELECT doc_id, n, 0::BIGINT AS chunk, CASE WHEN item.solo THEN 0 ELSE length(item.t) END AS fill FROM e WHERE n = 1
          UNION ALL SELECT e.doc_id, e.n, r.chunk + CASE WHEN item.solo OR fill = 0 OR fill + 1 + length(item.t) > {MAX_CHARS} THEN 1 ELSE 0 END, CASE WHEN item.solo THEN 0 WHEN fill = 0 OR fill + 1 + length(item.t) > {MAX_CHARS} THEN length(item.t) ELSE fill + 1 + length(item.t) END FROM r JOIN e ON e.doc_id = r.doc_id AND e.n = r.n + 1),
        p AS (SELECT doc_id, source, chunk + 1 AS n, string_agg(item.t, ' ' ORDER BY n) AS t FROM r JOIN e USING (doc_id, n) GROUP BY 1, 2, 3),
        q AS (SELECT doc_id, n, 0::BIGINT AS chunk, length(t) AS fill FROM p WHERE n = 1
          UNION ALL SELECT p.doc_id, p.n, q.chunk + CASE WHEN fill + 2 + length(p.t) > {MAX_CHARS} THEN 1 ELSE 0 END, CASE WHEN fill + 2 + length(p.t) > {MAX_CHARS} THEN length(p.t) ELSE fill + 2 + length(p.t) END FROM q JOIN p ON p.doc_id = q.doc_id AND p.n = q.n + 1)
        SELECT doc_id, chunk, source AS path, length(string_agg(t, chr(10) || chr(10) ORDER BY n)) AS n_chars, md5(string_agg(t, chr(10) || chr(10) ORDER BY n)) AS digest FROM q JOIN p USING (doc_id, n) GROUP BY 1, 2, 3""",
    ),
    "conversation_sections": (
        _conversation_sections,
        f"""WITH RECURSIVE t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM ({_CONV})),
        r AS (SELECT conv_id, 0::BIGINT AS n, ['conversation ' || conv_id] AS stack FROM (SELECT DISTINCT conv_id FROM conversations)
          UNION ALL SELECT t.conv_id, t.n, list_append(r.stack[1:t.level], t.title) FROM r JOIN t ON t.conv_id = r.conv_id AND t.n = r.n + 1),
        b AS (SELECT conv_id, n, array_to_string(list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda x: trim(x, {_WHITE})), lambda x: x <> ''), chr(10) || chr(10)) AS body FROM t)
        SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY n) - 1 AS chunk, array_to_string(stack, ' > ') AS path, md5(body) AS digest FROM r JOIN b USING (conv_id, n) WHERE body <> ''""",
    ),
    "conversation_outlines": (
        _outlines,
        f"SELECT conv_id, 'OUTLINE_V1' || chr(10) || 'doc_title=conversation ' || conv_id || chr(10) || 'content_kind=section_outline' || chr(10) || chr(10) || ltrim(string_agg(repeat('  ', level - 1) || '- ' || title, chr(10) ORDER BY turn)) || chr(10) AS outline FROM ({_CONV}) GROUP BY conv_id",
    ),
    "outline_steps": (
        _outline_steps,
        f"SELECT * FROM (SELECT conv_id, row_number() OVER w - 1 AS place, title, string_agg(title, ',') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM ({_CONV}) WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE place > 0",
    ),
    "related_documents": (
        _related_documents,
        f"""WITH d AS (SELECT doc_id, source || '/' || lang AS g, lower(source) AS title, list_filter({_CONCEPTS_SQL}, lambda x: x IS NOT NULL) AS c FROM documents),
        p AS (SELECT x.doc_id AS a, y.doc_id AS b, x.g = y.g AS same_group, list_sort(list_intersect(x.c, y.c)) AS shared, y.title FROM d x JOIN d y ON x.doc_id <> y.doc_id AND (x.g = y.g OR list_has_any(x.c, y.c)))
        SELECT a, b, same_group, array_to_string(shared, ',') AS shared, place FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY len(shared) DESC, same_group DESC, title, b) AS place FROM p) WHERE place <= 10""",
    ),
    "other_side_partner": (
        _other_nation,
        "SELECT c_custkey, partner, partner_score FROM (SELECT x.c_custkey, y.c_custkey AS partner, y.c_acctbal AS partner_score, row_number() OVER (PARTITION BY x.c_custkey ORDER BY y.c_acctbal DESC, y.c_custkey) AS k FROM customer x JOIN customer y ON x.c_mktsegment = y.c_mktsegment AND x.c_nationkey <> y.c_nationkey) WHERE k = 1",
    ),
    "last_click_before": (
        _last_click,
        """WITH c AS (SELECT user_id, ts, max({'event_id': event_id, 'value': value}) AS best FROM events WHERE event_type = 'click' GROUP BY 1, 2)
        SELECT e.event_id, c.best.event_id AS last_event_id, c.best.value AS last_value FROM (SELECT * FROM events WHERE event_type <> 'click') e ASOF LEFT JOIN c ON e.user_id = c.user_id AND e.ts > c.ts""",
    ),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for name, (query, _) in CATALOG.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in CATALOG.items() if sql}
