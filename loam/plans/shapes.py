"""Queries on column functions (grids, text, nested values, scores) and on the record operators, each with its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.functions import grids, nested, scores
from loam.functions import text as texts
from loam.operators import corpus, evals, packing, sequences
from loam.session import table

SEQ_LEN, WIDE = 1024, 8
PAGE_TAGS = [("query", ["?page="]), ("mobile", ["://m."]), ("secure", ["https"]), ("com", [".com/"])]

_UNIT = "(('0x' || substr(sha256('0:' || doc_id), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0)"
_SPLIT = f"(CASE WHEN {_UNIT} < 0.1 THEN 'val' ELSE 'train' END)"
_G = f"""SELECT vec_id, g, len(g) AS h, flatten(g) AS cells FROM (SELECT vec_id, list_transform(range(0, 3 + vec_id % 6), lambda r: list_transform(range(0, {WIDE}), lambda c: CAST(floor(abs(CAST(embedding[r * {WIDE} + c + 1] AS DOUBLE)) * 40) AS BIGINT) % 4)) AS g FROM embeddings)"""
_TEXT = "array_to_string(list_transform({g}, lambda w: array_to_string(w, '')), '/')"
_NEXT = "SELECT a.vec_id, a.g AS g, b.g AS o, a.h AS h, b.h AS oh FROM t AS a JOIN t AS b ON b.vec_id = a.vec_id + 1"


def _grids(spark: SparkSession, d: str) -> DataFrame:
    """vec_id and a grid of 3 to 8 rows and 8 columns of four colours, from each embedding."""
    rows = table(spark, d, "embeddings")
    value = lambda r, c: (F.floor(F.abs(F.element_at("embedding", r * WIDE + c + 1).cast("double")) * 40) % 4).cast("int")
    grid = F.transform(F.sequence(F.lit(0), (2 + F.col("vec_id") % 6).cast("int")), lambda r: F.transform(F.sequence(F.lit(0), F.lit(WIDE - 1)), lambda c: value(r, c)))
    return rows.select("vec_id", grid.alias("g"))


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    """Each grid with the next one."""
    own = _grids(spark, d)
    return own.join(own.select((F.col("vec_id") - 1).alias("vec_id"), F.col("g").alias("o")), "vec_id")


def _g(spark: SparkSession, d: str, **columns: Column) -> DataFrame:
    return _grids(spark, d).select("vec_id", *[c.alias(n) for n, c in columns.items()])


def _long(c: Column) -> Column:
    return c.cast("bigint")


def _joined(c: Column) -> Column:
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages")


def _steps(spark: SparkSession, d: str) -> DataFrame:
    """Record texts of conversation steps: header lines, a blank line and the turn's text."""
    rows = table(spark, d, "conversations")
    head = F.concat(F.lit("REASONING_STATE_V1\ntrace="), F.col("conv_id").cast("string"), F.lit("\nstep="), F.col("turn").cast("string"), F.lit("\ntarget_action="), F.col("role"))
    return rows.select("conv_id", "turn", F.concat(head, F.lit("\n\n"), F.col("text")).alias("record"))


def _event_json(spark: SparkSession, d: str) -> DataFrame:
    """event_id and a JSON text in no order, with blanks, of each event."""
    e = table(spark, d, "events")
    raw = F.format_string('{ "type" : "%s", "props": %s, "list": [%s, {"b": %s, "a": "x"}] }', "event_type", "props", _long(F.floor("value")), F.col("user_id"))
    return e.select("event_id", "event_type", "user_id", "value", "props", raw.alias("raw"))


def _event_fields(spark: SparkSession, d: str, shift: int) -> DataFrame:
    """event_id and the leaves of the event `shift` before it."""
    e = table(spark, d, "events").select((F.col("event_id") + shift).alias("event_id"), F.to_json(F.struct("event_type", (F.get_json_object("props", "$.k").cast("bigint") % 3).alias("k"), F.struct((F.col("user_id") % 5).alias("u")).alias("n"))).alias("j"))
    return nested.leaves(e, "event_id", "j")


_EVENT_RAW = """'{"list":[' || CAST(floor(value) AS BIGINT) || ',{"a":"x","b":' || user_id || '}],"props":{"k":' || CAST(props->>'$.k' AS BIGINT) || '},"type":"' || event_type || '"}'"""
_ROWS = f"""WITH p AS (SELECT {_SPLIT} AS split, string_agg(regexp_replace(hex(encode(text)), '(..)', '0\\1', 'g') || '100', '' ORDER BY doc_id) AS line FROM documents GROUP BY 1),
  r AS (SELECT split, line, unnest(range(CAST(length(line) // 3075 AS BIGINT))) AS seq_id FROM p)"""


def _token_text(c: Column) -> Column:
    """Ids as three upper-case hex digits each."""
    return F.array_join(F.transform(c, lambda x: F.lpad(F.conv(x.cast("string"), 10, 16), 3, "0")), "")


#: name: (query, SQL)
CATALOG: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "grid_strings": (lambda s, d: _g(s, d, line=grids.grid_text(F.col("g")), fits=grids.height(F.col("g")) <= 6), f"WITH t AS ({_G}) SELECT vec_id, {_TEXT.format(g='g')} AS line, h <= 6 AS fits FROM t"),
    "grid_symmetries": (
        lambda s, d: _grids(s, d).select("vec_id", F.posexplode(F.transform(F.array(*grids.dihedral(F.col("g"))), grids.grid_text)).alias("symmetry", "line")),
        f"""WITH t AS ({_G}), w AS (SELECT vec_id, g, h, list_transform(range(1, {WIDE + 1}), lambda c: list_transform(g, lambda row: row[c])) AS tr FROM t),
        a AS (SELECT vec_id, unnest([g, list_reverse(tr), list_reverse(list_transform(g, lambda x: list_reverse(x))), list_transform(tr, lambda x: list_reverse(x)), list_transform(g, lambda x: list_reverse(x)), list_reverse(g), tr, list_reverse(list_transform(tr, lambda x: list_reverse(x)))]) AS g, unnest(range(8)) AS symmetry FROM w)
        SELECT vec_id, CAST(symmetry AS INTEGER) AS symmetry, {_TEXT.format(g='g')} AS line FROM a""",
    ),
    "grid_similarity": (
        lambda s, d: _pairs(s, d).select("vec_id", F.round(grids.similarity(F.col("g"), F.col("o")), 6).alias("similarity")),
        f"WITH t AS ({_G}), p AS ({_NEXT}) SELECT vec_id, round(list_sum(list_transform(range(0, greatest(h, oh) * {WIDE}), lambda i: CASE WHEN coalesce(g[i // {WIDE} + 1][i % {WIDE} + 1], 0) = coalesce(o[i // {WIDE} + 1][i % {WIDE} + 1], 0) THEN 1 ELSE 0 END))::DOUBLE / (greatest(h, oh) * {WIDE}), 6) AS similarity FROM p",
    ),
    "grid_overlap": (
        lambda s, d: _pairs(s, d).select("vec_id", F.round(grids.overlap(grids.filled_cells(F.col("g"), F.lit(0)), grids.filled_cells(F.col("o"), F.lit(0))), 6).alias("overlap")),
        f"""WITH t AS ({_G}), p AS ({_NEXT}), c AS (SELECT vec_id, list_filter(range(0, h * {WIDE}), lambda i: g[i // {WIDE} + 1][i % {WIDE} + 1] <> 0) AS a, list_filter(range(0, oh * {WIDE}), lambda i: o[i // {WIDE} + 1][i % {WIDE} + 1] <> 0) AS b FROM p),
        n AS (SELECT vec_id, len(list_intersect(a, b)) AS same, len(a) + len(b) - len(list_intersect(a, b)) AS every FROM c)
        SELECT vec_id, CASE WHEN every = 0 THEN 1.0::DOUBLE ELSE round(same::DOUBLE / every, 6) END AS overlap FROM n""",
    ),
    "grid_colors": (
        lambda s, d: _g(s, d, dominant=_long(grids.dominant(F.col("g"))), background=_joined(grids.background_candidates(F.col("g")))),
        f"""WITH t AS ({_G}), u AS (SELECT vec_id, unnest(cells) AS c FROM t), n AS (SELECT vec_id, c, count(*) AS k FROM u GROUP BY 1, 2),
        o AS (SELECT vec_id, list(c ORDER BY k DESC, c) AS l FROM n GROUP BY 1)
        SELECT t.vec_id, l[1] AS dominant, array_to_string(list_prepend(cells[1], list_filter(l[1:4], lambda x: x <> cells[1])), ',') AS background FROM t JOIN o ON o.vec_id = t.vec_id""",
    ),
    "grid_histogram": (
        lambda s, d: _grids(s, d).select("vec_id", F.posexplode(grids.histogram(F.col("g"), 4)).alias("color", "share")).select("vec_id", "color", F.round("share", 6).alias("share")),
        f"WITH t AS ({_G}), u AS (SELECT vec_id, cells, unnest(range(4)) AS color FROM t) SELECT vec_id, CAST(color AS INTEGER) AS color, round(len(list_filter(cells, lambda x: x = color))::DOUBLE / len(cells), 6) AS share FROM u",
    ),
    "grid_padded": (
        lambda s, d: _g(s, d, digest=F.sha2(F.array_join(F.transform(grids.padded(F.col("g")), lambda x: x.cast("string")), ""), 256)),
        f"""WITH t AS ({_G}) SELECT vec_id, sha256(array_to_string(list_transform(range(0, 900), lambda i: CASE WHEN i // 30 < h AND i % 30 < {WIDE} THEN g[i // 30 + 1][i % 30 + 1] + 2
        WHEN (i // 30 = h AND i % 30 < {WIDE}) OR (i % 30 = {WIDE} AND i // 30 < h) THEN 1 ELSE 0 END), '')) AS digest FROM t""",
    ),
    "grid_hash": (
        lambda s, d: _g(s, d, digest=F.sha2(F.concat_ws(":", grids.height(F.col("g")).cast("string"), grids.width(F.col("g")).cast("string"), F.array_join(F.transform(F.flatten("g"), lambda x: x.cast("string")), "")), 256)),
        f"WITH t AS ({_G}) SELECT vec_id, sha256(h || ':{WIDE}:' || array_to_string(cells, '')) AS digest FROM t",
    ),
    "grid_runs": (
        lambda s, d: _g(s, d, runs=F.array_join(grids.row_runs(F.col("g"), grids.dominant(F.col("g"))), ",")),
        f"""WITH t AS ({_G}), n AS (SELECT vec_id, c, count(*) AS k FROM (SELECT vec_id, unnest(cells) AS c FROM t) GROUP BY 1, 2), o AS (SELECT vec_id, list(c ORDER BY k DESC, c)[1] AS bg FROM n GROUP BY 1),
        u AS (SELECT t.vec_id, bg, unnest(cells) AS v, unnest(range(0, h * {WIDE})) AS i FROM t JOIN o ON o.vec_id = t.vec_id),
        m AS (SELECT *, CASE WHEN i % {WIDE} = 0 OR v <> lag(v) OVER (PARTITION BY vec_id ORDER BY i) THEN 1 ELSE 0 END AS starts FROM u), q AS (SELECT *, sum(starts) OVER (PARTITION BY vec_id ORDER BY i) AS run FROM m),
        r AS (SELECT vec_id, run, min(i) AS first, count(*) AS k, min(v) AS v FROM q WHERE v <> bg GROUP BY 1, 2)
        SELECT t.vec_id, coalesce(string_agg(first // {WIDE} || '.' || first % {WIDE} || '.' || k || '.' || v, ',' ORDER BY first), '') AS runs FROM t LEFT JOIN r ON r.vec_id = t.vec_id GROUP BY 1""",
    ),
    "grid_from_runs": (
        lambda s, d: _grids(s, d).withColumn("bg", grids.dominant(F.col("g"))).select("vec_id", grids.grid_text(grids.grid_of_runs(grids.row_runs(F.col("g"), F.col("bg")), grids.height(F.col("g")), grids.width(F.col("g")), F.col("bg"))).alias("line"), grids.grid_of_runs(grids.row_runs(F.col("g"), F.col("bg")), F.lit(0), F.lit(0), F.col("bg")).isNull().alias("refused")),
        f"WITH t AS ({_G}) SELECT vec_id, {_TEXT.format(g='g')} AS line, len(list_distinct(cells)) > 1 AS refused FROM t",
    ),
    "slugs": (
        lambda s, d: _pages(s, d).select("page_id", texts.slug(F.col("url")).alias("slug")),
        "SELECT page_id, regexp_replace(regexp_replace(lower(url), '[^a-z0-9]', '_', 'g'), '^_+|_+$', '', 'g') AS slug FROM pages",
    ),
    "normalised_tokens": (
        lambda s, d: table(s, d, "documents").select("doc_id", _long(F.size(texts.normalised_tokens(F.col("text")))).alias("n"), F.array_join(F.slice(texts.normalised_tokens(F.col("text")), 1, 5), " ").alias("first")),
        "SELECT doc_id, len(w) AS n, array_to_string(w[1:5], ' ') AS first FROM (SELECT doc_id, list_filter(string_split(lower(regexp_replace(text, '[^\\p{L}\\p{N}]+', ' ', 'g')), ' '), lambda x: length(x) >= 3) AS w FROM documents)",
    ),
    "shared_tokens": (
        lambda s, d: _shared(table(s, d, "documents")),
        """WITH t AS (SELECT doc_id, list_distinct(list_filter(string_split(lower(regexp_replace(text, '[^\\p{L}\\p{N}]+', ' ', 'g')), ' '), lambda x: length(x) >= 3)) AS w FROM documents)
        SELECT a.doc_id, len(list_intersect(a.w, b.w)) AS shared FROM t AS a JOIN t AS b ON b.doc_id = a.doc_id + 1""",
    ),
    "path_prefixes": (
        lambda s, d: _page_paths(s, d).select("page_id", _long(F.size("parts")).alias("depth"), F.array_join(texts.path_prefixes(F.col("parts"), " > "), "|").alias("prefixes")),
        "SELECT page_id, len(p) AS depth, array_to_string(list_transform(range(1, len(p) + 1), lambda i: array_to_string(p[1:i], ' > ')), '|') AS prefixes FROM (SELECT page_id, list_filter(string_split(regexp_replace(url, '^https?://', ''), '/'), lambda x: trim(x) <> '') AS p FROM pages)",
    ),
    "common_depth": (
        lambda s, d: _page_paths(s, d).join(_page_paths(s, d).select((F.col("page_id") - 1).alias("page_id"), F.col("parts").alias("o")), "page_id").select("page_id", _long(texts.common_depth(F.col("parts"), F.col("o"))).alias("depth")),
        """WITH t AS (SELECT page_id, list_filter(string_split(regexp_replace(url, '^https?://', ''), '/'), lambda x: trim(x) <> '') AS p FROM pages), j AS (SELECT a.page_id, a.p AS p, b.p AS q FROM t AS a JOIN t AS b ON b.page_id = a.page_id + 1)
        SELECT page_id, len(list_filter(range(1, len(p) + 1), lambda i: p[1:i] = q[1:i])) AS depth FROM j""",
    ),
    "numeric_fragments": (
        lambda s, d: _numbers(table(s, d, "documents")),
        # a number may not follow a letter, so the sign or digit behind one goes first
        r"""WITH t AS (SELECT doc_id, regexp_extract_all(regexp_replace(replace(text, ',', ''), '([A-Za-z])[-+0-9]', '\1 ', 'g'), '[-+]?(?:[0-9]+\.[0-9]+|[0-9]+/[0-9]+|[0-9]+)(?:%|x)?') AS f FROM documents),
        u AS (SELECT doc_id, rtrim(unnest(f), 'x') AS x FROM t), v AS (SELECT doc_id, CASE WHEN contains(x, '/') THEN split_part(rtrim(x, '%'), '/', 1)::DOUBLE / nullif(split_part(rtrim(x, '%'), '/', 2)::DOUBLE, 0) ELSE rtrim(x, '%')::DOUBLE END / CASE WHEN x LIKE '%\%' ESCAPE '\' THEN 100 ELSE 1 END AS value FROM u)
        SELECT doc_id, count(*) AS n, coalesce(round(max(value) FILTER (value < 1e9), 4), -1) AS most FROM v GROUP BY 1""",
    ),
    "record_headers": (
        lambda s, d: _steps(s, d).select("conv_id", "turn", F.element_at(texts.header_fields(F.col("record")), "target_action").alias("action"), _long(F.length(texts.body(F.col("record")))).alias("n_body"), texts.without_fields(texts.with_field(F.substring_index("record", "\n\n", 1), "step", F.lit("x")), ["target_action"]).alias("stripped"), texts.with_field(F.lit("a=1"), "b", F.col("conv_id").cast("string")).alias("added")),
        "SELECT conv_id, turn, role AS action, length(text) AS n_body, 'REASONING_STATE_V1' || chr(10) || 'trace=' || conv_id || chr(10) || 'step=x' AS stripped, 'a=1' || chr(10) || 'b=' || conv_id AS added FROM conversations",
    ),
    "escaped_items": (
        lambda s, d: _pages(s, d).select("page_id", F.sha2(texts.escaped_item(F.col("html")), 256).alias("digest"), texts.usable_body(F.col("html")).alias("usable")),
        r"SELECT page_id, sha256(replace(replace(html, '~', '~~'), '|', '~p')) AS digest, length(trim(regexp_replace(html, '[ \t\n\r]+', ' ', 'g'))) >= 120 AND len(regexp_extract_all(regexp_replace(html, '[ \t\n\r]+', ' ', 'g'), '[.]{4,}')) < 2 AS usable FROM pages",
    ),
    "ranked_tags": (
        lambda s, d: _pages(s, d).select("page_id", F.array_join(texts.ranked_tags(F.col("url"), PAGE_TAGS, ["other", "com"], 3), ",").alias("tags")),
        """WITH t AS (SELECT page_id, list_filter([CASE WHEN contains(lower(url), '?page=') THEN 'query' END, CASE WHEN contains(lower(url), '://m.') THEN 'mobile' END, CASE WHEN contains(lower(url), 'https') THEN 'secure' END, CASE WHEN contains(lower(url), '.com/') THEN 'com' END], lambda x: x IS NOT NULL) AS f FROM pages)
        SELECT page_id, array_to_string((f || list_filter(['other', 'com'], lambda x: NOT list_contains(f, x)))[1:3], ',') AS tags FROM t""",
    ),
    "choice_answers": (
        lambda s, d: table(s, d, "events").select("event_id", F.coalesce(texts.choice_letter(F.when(F.col("event_id") % 2 == 0, (F.col("user_id") % 7).cast("string")).otherwise(F.chr(F.col("user_id") % 7 + 97)), 5), F.lit("none")).alias("answer")),
        "SELECT event_id, CASE WHEN user_id % 7 < 5 THEN chr(CAST(user_id % 7 + 65 AS INTEGER)) ELSE 'none' END AS answer FROM events",
    ),
    "score_buckets": (
        lambda s, d: _buckets(table(s, d, "lineitem")),
        """WITH t AS (SELECT CASE WHEN l_discount < 0.03 THEN 'low' WHEN l_discount < 0.07 THEN 'medium' ELSE 'high' END AS level, CAST(least(3, floor(4 * greatest(0.0, least(l_quantity, 50.0)) / 50.0)) AS INTEGER) AS quartile, greatest(-8.0, least(8.0, (l_extendedprice - 20000) / 2000.0)) AS clamped,
          2.0 * (0.5 * l_discount + 0.3 * l_tax + 0.2 * (l_quantity / 50.0)) AS r FROM lineitem)
        SELECT level, quartile, CASE WHEN r < 0.25 THEN 'lowest' WHEN r < 0.45 THEN 'low' WHEN r < 0.65 THEN 'medium' WHEN r < 0.82 THEN 'high' ELSE 'highest' END AS reward, count(*) AS n, round(sum(clamped), 3) AS clamped FROM t GROUP BY 1, 2, 3""",
    ),
    "safe_ratios": (
        lambda s, d: table(s, d, "events").groupBy("event_type").agg(F.round(scores.safe_ratio(F.sum(F.when(F.col("value") > 10, 1).otherwise(0)), F.sum(F.when(F.col("value") > 1000, 1).otherwise(0))), 6).alias("ratio"), F.round(F.avg(scores.capped_sum([(0.4, F.col("value") > 5), (0.8, F.col("value") > 20)])), 6).alias("capped")),
        "SELECT event_type, round(sum(CASE WHEN value > 10 THEN 1 ELSE 0 END)::DOUBLE / greatest(sum(CASE WHEN value > 1000 THEN 1 ELSE 0 END), 1), 6) AS ratio, round(avg(least(1.0, 0.4 * CAST(value > 5 AS INTEGER) + 0.8 * CAST(value > 20 AS INTEGER))), 6) AS capped FROM events GROUP BY 1",
    ),
    "canonical_json": (lambda s, d: _event_json(s, d).select("event_id", nested.canonical(F.col("raw")).alias("json")), f"SELECT event_id, {_EVENT_RAW} AS json FROM events"),
    "json_actions": (
        lambda s, d: _event_json(s, d).select("event_id", nested.action(F.when(F.col("event_id") % 3 == 0, F.col("event_type")).otherwise(F.format_string('{"name": "%s", "argument": {"z": 1, "k": %s}}', "event_type", F.col("user_id")))).alias("a")).select("event_id", "a.*"),
        """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_type ELSE '{"argument":{"k":' || user_id || ',"z":1},"name":"' || event_type || '"}' END AS canonical, event_type AS name, CASE WHEN event_id % 3 = 0 THEN event_type ELSE '{"k":' || user_id || ',"z":1}' END AS argument FROM events""",
    ),
    "json_leaves": (
        lambda s, d: nested.leaves(_event_json(s, d), "event_id", "raw"),
        """WITH t AS (SELECT event_id, [['type', event_type], ['props.k', CAST(CAST(props->>'$.k' AS BIGINT) AS VARCHAR)], ['list.0', CAST(CAST(floor(value) AS BIGINT) AS VARCHAR)], ['list.1.b', CAST(user_id AS VARCHAR)], ['list.1.a', 'x']] AS l FROM events), u AS (SELECT event_id, unnest(l) AS e FROM t)
        SELECT event_id, e[1] AS path, e[2] AS value FROM u""",
    ),
    "json_match": (
        lambda s, d: nested.match_fraction(_event_fields(s, d, 0), _event_fields(s, d, 1), "event_id").select("event_id", F.round("fraction", 6).alias("fraction")),
        """WITH t AS (SELECT event_id, event_type, CAST(props->>'$.k' AS BIGINT) % 3 AS k, user_id % 5 AS u FROM events)
        SELECT coalesce(a.event_id, b.event_id + 1) AS event_id, round((CAST(a.event_type IS NOT DISTINCT FROM b.event_type AS INTEGER) + CAST(a.k IS NOT DISTINCT FROM b.k AS INTEGER) + CAST(a.u IS NOT DISTINCT FROM b.u AS INTEGER)) / 3.0::DOUBLE, 6) AS fraction FROM t AS a FULL JOIN t AS b ON b.event_id + 1 = a.event_id""",
    ),
    "metadata_merge": (
        lambda s, d: table(s, d, "documents").select("doc_id", F.array_join(F.transform(F.array_sort(F.map_entries(nested.merged(F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source")), F.create_map(F.lit("source"), F.lit("x"), F.lit("n"), F.col("n_chars").cast("string"))))), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("metadata")),
        "SELECT doc_id, 'lang=' || lang || ';n=' || n_chars || ';source=x' AS metadata FROM documents",
    ),
    "packed_rows": (
        lambda s, d: packing.packed_rows(table(s, d, "documents"), SEQ_LEN).select("split", "seq_id", F.sha2("line", 256).alias("digest")),
        f"{_ROWS} SELECT split, seq_id, sha256(substr(line, seq_id * 3075 + 1, 3075)) AS digest FROM r",
    ),
    "packed_pairs": (
        lambda s, d: packing.shifted(packing.packed_rows(table(s, d, "documents"), SEQ_LEN), SEQ_LEN).select("split", "seq_id", F.md5(_token_text(F.col("inputs"))).alias("inputs"), F.md5(_token_text(F.col("targets"))).alias("targets")),
        f"{_ROWS} SELECT split, seq_id, md5(substr(line, seq_id * 3075 + 1, 3072)) AS inputs, md5(substr(line, seq_id * 3075 + 4, 3072)) AS targets FROM r",
    ),
    "taken_rows": (
        lambda s, d: _taken(packing.packed_rows(table(s, d, "documents"), SEQ_LEN), 64),
        f"{_ROWS}, n AS (SELECT split, count(*) AS k FROM r GROUP BY 1) SELECT r.split, k - 1 - seq_id AS position, seq_id // 64 AS shard_index, md5(substr(line, seq_id * 3075 + 1, 3075)) AS digest FROM r JOIN n ON n.split = r.split",
    ),
    "step_transitions": (
        lambda s, d: sequences.transitions(table(s, d, "conversations"), "conv_id", "turn", "role"),
        "SELECT conv_id, turn, role, lag(role, 1, '<start>') OVER w AS previous, lead(role, 1, '<end>') OVER w AS next, lead(turn) OVER w IS NULL AS done FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)",
    ),
    "whole_groups": (
        lambda s, d: sequences.whole_groups(table(s, d, "conversations"), "conv_id", "turn").groupBy("role").agg(F.count("*").alias("n")),
        "WITH g AS (SELECT conv_id FROM conversations GROUP BY 1 HAVING count(*) >= max(turn) + 1) SELECT role, count(*) AS n FROM conversations WHERE conv_id IN (SELECT conv_id FROM g) GROUP BY 1",
    ),
    "first_of_each": (
        lambda s, d: sequences.first_of_each(table(s, d, "documents").select("source", "doc_id"), "source", "doc_id", 5),
        "SELECT source, doc_id, CAST(place AS INTEGER) AS place FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS place FROM documents) WHERE place <= 5",
    ),
    "union_first": (
        lambda s, d: sequences.union_first([("benchmark", table(s, d, "benchmark").select(F.md5("text").alias("key"), F.col("item_id").alias("id"))), ("documents", table(s, d, "documents").select(F.md5("text").alias("key"), F.col("doc_id").alias("id")))], ["key"]),
        "SELECT key, id, part FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY o, id) AS k FROM (SELECT md5(text) AS key, item_id AS id, 'benchmark' AS part, 0 AS o FROM benchmark UNION ALL SELECT md5(text), doc_id, 'documents', 1 FROM documents)) WHERE k = 1",
    ),
    "overwritten_keys": (
        lambda s, d: sequences.overwritten(table(s, d, "documents").select("doc_id", F.lit(-1).cast("bigint").alias("quality")), table(s, d, "labels").select("doc_id", _long(F.col("quality")).alias("quality")), "doc_id"),
        "SELECT doc_id, CAST(quality AS BIGINT) AS quality FROM labels UNION ALL SELECT doc_id, -1 FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    ),
    "value_masks": (
        lambda s, d: sequences.value_masks(table(s, d, "events"), "user_id", "event_type"),
        "WITH v AS (SELECT DISTINCT event_type FROM events), u AS (SELECT DISTINCT user_id FROM events), p AS (SELECT DISTINCT user_id, event_type FROM events) SELECT u.user_id, string_agg(CASE WHEN p.user_id IS NULL THEN '0' ELSE '1' END, '' ORDER BY v.event_type) AS mask FROM u CROSS JOIN v LEFT JOIN p ON p.user_id = u.user_id AND p.event_type = v.event_type GROUP BY 1",
    ),
    "candidate_index": (
        lambda s, d: sequences.candidate_index(table(s, d, "events"), {"type": F.col("event_type"), "user": F.col("user_id"), "both": F.concat_ws("/", "event_type", F.col("user_id").cast("string")), "k": F.get_json_object("props", "$.k"), "all": F.lit("x")}, "value"),
        """SELECT bucket, count(DISTINCT value) AS n_values, min(value) AS least FROM (SELECT unnest(['type:' || event_type, 'user:' || user_id, 'both:' || event_type || '/' || user_id, 'k:' || (props->>'$.k'), 'all:x']) AS bucket, value FROM events) GROUP BY 1""",
    ),
    "positional_split": (
        lambda s, d: sequences.positional_split(table(s, d, "documents").select("doc_id"), "doc_id", 0.15),
        "SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY doc_id) <= greatest(1, least(floor(count(*) OVER () * 0.85 + 0.5), count(*) OVER () - 1)) THEN 'train' ELSE 'val' END AS part FROM documents",
    ),
    "cover_thresholds": (
        lambda s, d: evals.thresholds(evals.cover_curve(table(s, d, "documents"), "source"), [0.5, 0.8, 0.95, 1.5]).select("goal", F.coalesce("rank", F.lit(-1)).alias("rank")),
        "WITH c AS (SELECT source, count(*) AS n FROM documents GROUP BY 1), w AS (SELECT row_number() OVER o AS rank, round(sum(n) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::DOUBLE / sum(n) OVER (), 6) AS covered FROM c WINDOW o AS (ORDER BY n DESC, source)), g AS (SELECT unnest([0.5, 0.8, 0.95, 1.5])::DOUBLE AS goal) SELECT goal, CAST(coalesce(min(rank), -1) AS INTEGER) AS rank FROM g LEFT JOIN w ON covered >= goal GROUP BY 1",
    ),
    "best_configs": (
        lambda s, d: evals.best_by(table(s, d, "orders").select("o_orderpriority", "o_orderkey", "o_totalprice"), "o_orderpriority", ["o_totalprice"], "o_orderkey"),
        "SELECT o_orderpriority, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice NULLS LAST, o_orderkey) AS k FROM orders) WHERE k = 1",
    ),
    "best_probe": (
        lambda s, d: evals.best_probe(table(s, d, "events").withColumn("k", F.get_json_object("props", "$.k")), ["user_id", "k"], "event_type", F.col("event_id") % 5 > 0),
        """WITH e AS (SELECT event_id % 5 > 0 AS train, event_type, unnest(['user_id', 'k']) AS feature, unnest([CAST(user_id AS VARCHAR), props->>'$.k']) AS x, unnest([0, 1]) AS o FROM events),
        c AS (SELECT feature, x, event_type, count(*) AS n FROM e WHERE train GROUP BY 1, 2, 3), b AS (SELECT feature, x, event_type AS guess FROM (SELECT *, row_number() OVER (PARTITION BY feature, x ORDER BY n DESC, event_type) AS k FROM c) WHERE k = 1),
        m AS (SELECT event_type AS overall FROM events WHERE event_id % 5 > 0 GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
        r AS (SELECT e.feature, o, count(*) AS n, sum(CASE WHEN event_type = guess THEN 1 ELSE 0 END)::DOUBLE / count(*) AS a, sum(CASE WHEN event_type = overall THEN 1 ELSE 0 END)::DOUBLE / count(*) AS z FROM e LEFT JOIN b ON b.feature = e.feature AND b.x = e.x CROSS JOIN m WHERE NOT train GROUP BY 1, 2)
        SELECT feature, n, round(a, 6) AS accuracy, round(a - z, 6) AS lift FROM r ORDER BY round(a, 6) DESC, o LIMIT 1""",
    ),
    "compared_sides": (
        lambda s, d: evals.compared(table(s, d, "lineitem"), "l_returnflag", "A", "R", {"price": (F.col("l_extendedprice"), False), "quantity": (F.col("l_quantity"), True), "one": (F.lit(1.0), True)}),
        """WITH t AS (SELECT round(avg(l_extendedprice) FILTER (l_returnflag = 'A'), 6) AS pa, round(avg(l_extendedprice) FILTER (l_returnflag = 'R'), 6) AS pb, round(avg(l_quantity) FILTER (l_returnflag = 'A'), 6) AS qa, round(avg(l_quantity) FILTER (l_returnflag = 'R'), 6) AS qb FROM lineitem)
        SELECT 'price' AS metric, pa AS a, pb AS b, CASE WHEN pa < pb THEN 'A' WHEN pa <> pb THEN 'R' ELSE 'tie' END AS winner FROM t UNION ALL SELECT 'quantity', qa, qb, CASE WHEN qa > qb THEN 'A' WHEN qa <> qb THEN 'R' ELSE 'tie' END FROM t UNION ALL SELECT 'one', 1.0, 1.0, 'tie'""",
    ),
    "present_means": (
        lambda s, d: evals.present_mean(table(s, d, "documents").join(table(s, d, "labels"), "doc_id", "left"), "lang", F.col("quality")),
        "SELECT lang, count(quality) AS n_present, round(avg(quality), 6) AS mean FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1",
    ),
    "source_summary": (
        lambda s, d: table(s, d, "documents").groupingSets([["lang"], ["source"]], "lang", "source").agg(F.grouping("lang").alias("by_source"), F.count("*").alias("n")).select(F.coalesce("lang", "source").alias("value"), F.col("by_source").cast("int").alias("by_source"), "n"),
        "SELECT lang AS value, 0 AS by_source, count(*) AS n FROM documents GROUP BY 1 UNION ALL SELECT source, 1, count(*) FROM documents GROUP BY 1",
    ),
    "seeded_order": (
        lambda s, d: sequences.first_of_each(table(s, d, "documents").select("lang", "doc_id", F.md5(F.concat(F.lit("11:"), F.col("doc_id").cast("string"))).alias("key")), "lang", "key", 20).drop("key"),
        "SELECT lang, doc_id, CAST(place AS INTEGER) AS place FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY md5('11:' || doc_id)) AS place FROM documents) WHERE place <= 20",
    ),
    "vocabulary_join": (
        lambda s, d: _coded(table(s, d, "events")),
        "WITH v AS (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS id FROM (SELECT DISTINCT event_type FROM events)) SELECT user_id, string_agg(CAST(id AS VARCHAR), '' ORDER BY ts, event_id) AS codes FROM events JOIN v USING (event_type) GROUP BY 1",
    ),
}


def _shared(docs: DataFrame) -> DataFrame:
    words = docs.select("doc_id", F.array_distinct(texts.normalised_tokens(F.col("text"))).alias("w"))
    return words.join(words.select((F.col("doc_id") - 1).alias("doc_id"), F.col("w").alias("o")), "doc_id").select("doc_id", _long(texts.shared_count(F.col("w"), F.col("o"))).alias("shared"))


def _page_paths(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).select("page_id", texts.path_parts(F.regexp_replace("url", "^https?://", ""), "/").alias("parts"))


def _numbers(docs: DataFrame) -> DataFrame:
    found = docs.select("doc_id", F.explode(texts.numeric_fragments(F.col("text"))).alias("x"))
    return found.groupBy("doc_id").agg(F.count("*").alias("n"), F.coalesce(F.round(F.max(F.when(texts.fragment_value(F.col("x")) < 1e9, texts.fragment_value(F.col("x")))), 4), F.lit(-1.0)).alias("most"))


def _buckets(lines: DataFrame) -> DataFrame:
    level = scores.bucket(F.col("l_discount"), [0.03, 0.07], ["low", "medium", "high"])
    own = scores.reward_bucket(scores.reward(F.lit(2.0), F.col("l_discount"), F.col("l_tax"), F.col("l_quantity") / 50.0))
    rows = lines.select(level.alias("level"), scores.quartile_bucket(F.col("l_quantity"), F.lit(50.0)).alias("quartile"), own.alias("reward"), scores.clamped(F.col("l_extendedprice") - 20000, 2000.0).alias("clamped"))
    return rows.groupBy("level", "quartile", "reward").agg(F.count("*").alias("n"), F.round(F.sum("clamped"), 3).alias("clamped"))


def _taken(rows: DataFrame, per_shard: int) -> DataFrame:
    """All rows of each split, the last one first."""
    sizes = rows.groupBy("split").agg(F.count("*").alias("k"))
    wanted = rows.select("split", "seq_id").join(sizes, "split").select("split", "seq_id", (F.col("k") - 1 - F.col("seq_id")).alias("position"))
    return packing.take_rows(rows, wanted, per_shard).select("split", "position", "shard_index", F.md5("line").alias("digest"))


def _coded(events: DataFrame) -> DataFrame:
    ids = sequences.vocabulary(events.withColumn("head", F.lit("event")), "head", "event_type").select("event_type", "id")
    coded = events.join(ids, "event_type")
    return coded.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "id"))), lambda x: x["id"].cast("string")), "").alias("codes"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for name, (query, _) in CATALOG.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in CATALOG.items() if sql}
