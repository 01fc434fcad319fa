"""Every query on the driver's tables that the library answers, with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loam.functions import text as texts
from loam.operators import corpus, evals, graphs, packing, sequences
from loam.session import table
from loam.sources import pages
from loam.streaming import events as streams

SEQ_LEN, PER_SHARD = 1024, 512
LANGUAGES = ["en", "de"]
TAGS = [("apache", "apache"), ("licensed", "licence"), ("idiot", "insult"), ("the", "english")]
KEYWORDS = ["the", "tion", "ung", "que"]
STOP = ["the", "and", "that"]
BATCH, RANKS = 64, 4

_UNIT = "(('0x' || substr(sha256('{seed}:' || {id}), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0)"
_SPLIT = f"(CASE WHEN {_UNIT.format(seed=0, id='doc_id')} < 0.1 THEN 'val' ELSE 'train' END)"
_RECORDS = f"SELECT doc_id, source AS corpus, {_SPLIT} AS split, CAST(length(text) AS BIGINT) AS char_length, CAST(strlen(text) AS BIGINT) AS byte_length, sha256(text) AS text_sha256 FROM documents"
_PACKED = f"SELECT {_SPLIT} AS split, count(*) AS n_docs, CAST(sum(strlen(text) + 1) AS BIGINT) AS document_tokens FROM documents GROUP BY 1"
_OFFSETS = f"SELECT doc_id, split, n, CAST(sum(n) OVER (PARTITION BY split ORDER BY doc_id) - n AS BIGINT) AS start FROM (SELECT doc_id, {_SPLIT} AS split, strlen(text) + 1 AS n FROM documents)"
_LINKS = """SELECT 'c' || c_custkey AS source, 'n' || c_nationkey AS target FROM customer UNION SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier UNION SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation
  UNION SELECT 's' || s_suppkey, 'r' || n_regionkey FROM supplier JOIN nation ON n_nationkey = s_nationkey"""


_WHOLE = "SELECT 2 * l_partkey AS source, 2 * l_suppkey + 1 AS target FROM lineitem UNION SELECT 2 * l_suppkey + 1, 2 * l_partkey FROM lineitem"


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def _links(spark: SparkSession, d: str) -> DataFrame:
    """Customers and suppliers to their nations, nations to their regions, and suppliers to their regions at once."""
    node = lambda kind, key: F.concat(F.lit(kind), F.col(key).cast("string"))
    nations = table(spark, d, "nation").select("n_nationkey", "n_regionkey")
    suppliers = table(spark, d, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
    parts = [
        table(spark, d, "customer").select(node("c", "c_custkey").alias("source"), node("n", "c_nationkey").alias("target")),
        table(spark, d, "supplier").select(node("s", "s_suppkey").alias("source"), node("n", "s_nationkey").alias("target")),
        nations.select(node("n", "n_nationkey").alias("source"), node("r", "n_regionkey").alias("target")),
        suppliers.select(node("s", "s_suppkey").alias("source"), node("r", "n_regionkey").alias("target")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]).distinct()


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("target").alias("source"), F.col("source").alias("target"))).distinct()


def _whole_edges(spark: SparkSession, d: str) -> DataFrame:
    """Every part and supplier that share a line, both ways: parts are the even nodes, suppliers the odd ones."""
    lines = table(spark, d, "lineitem").select((F.col("l_partkey") * 2).alias("part"), (F.col("l_suppkey") * 2 + 1).alias("supplier")).dropna().distinct()
    return lines.select(F.explode(F.array(F.struct(F.col("part").alias("source"), F.col("supplier").alias("target")), F.struct(F.col("supplier").alias("source"), F.col("part").alias("target")))).alias("e")).select("e.*")


def _shortcuts(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers to their parts, parts to their orders, and other suppliers to these orders at once."""
    name = lambda kind, key: F.concat(F.lit(kind), key.cast("string"))
    lines = table(spark, d, "lineitem")
    part, order = name("p", F.col("l_partkey")), name("o", F.col("l_orderkey"))
    ends = [(name("s", F.col("l_suppkey")), part), (part, order), (name("s", F.expr("l_suppkey div 2 + 1")), order)]
    return lines.select(F.explode(F.array(*[F.struct(a.alias("source"), b.alias("target")) for a, b in ends])).alias("e")).select("e.*").distinct()


def _user_steps(spark: SparkSession, d: str) -> DataFrame:
    """events, each with the user's event_type before it."""
    last = F.lag("event_type", 1, "<start>").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, d, "events").withColumn("previous", last)


def _batches(docs: DataFrame) -> DataFrame:
    """The documents of an epoch by batch, rank and slot: items are documents in order of doc_id, placed by ranges of ids."""
    placed = packing.numbered(docs.select("doc_id"), "doc_id").cache()
    n = placed.count()
    epoch = packing.batches(placed.select(F.col("number").alias("position")), n, BATCH, RANKS)
    return epoch.join(placed, F.col("item") == F.col("number")).select("doc_id", "batch_id", "rank", "slot")


def _correct() -> Column:
    return F.col("value") > 5


_STEPS = ("conv_id", "turn", "role")
_REPEATS = "SELECT CAST(doc_id AS VARCHAR) AS base, {s} AS split, unnest(range(CASE WHEN {s} = 'train' THEN 3 ELSE 1 END)) AS i FROM documents".format(s=_SPLIT)
_DIGEST = packing.epoch_numbers(0, 0)

#: name: (query, SQL or None)
CATALOG: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "doc_records": (lambda s, d: corpus.records(_docs(s, d)), _RECORDS),
    "split_stats": (
        lambda s, d: corpus.records(_docs(s, d)).groupBy("split").agg(F.count("*").alias("n_docs"), F.sum("byte_length").alias("n_bytes")),
        f"SELECT split, count(*) AS n_docs, CAST(sum(byte_length) AS BIGINT) AS n_bytes FROM ({_RECORDS}) GROUP BY 1",
    ),
    "doc_filter_scores": (
        lambda s, d: corpus.passing(_docs(s, d), table(s, d, "labels"), LANGUAGES, 200, 1).select("doc_id", "lang", "quality"),
        "SELECT doc_id, lang, quality FROM documents LEFT JOIN labels USING (doc_id) WHERE (quality IS NULL OR quality >= 1) AND length(trim(text, ' ')) >= 200 AND lang IN ('en', 'de')",
    ),
    "manifest_rollup": (
        lambda s, d: corpus.rollup_counts(corpus.records(_docs(s, d))),
        f"SELECT coalesce(split, 'total') AS split, coalesce(corpus, 'total') AS corpus, count(*) AS n_docs, CAST(sum(char_length) AS BIGINT) AS n_chars, CAST(sum(byte_length) AS BIGINT) AS n_bytes FROM ({_RECORDS}) GROUP BY ROLLUP (split, corpus)",
    ),
    "train_repeat": (
        lambda s, d: corpus.repeat_train(_docs(s, d), 3),
        f"SELECT CASE WHEN i = 0 THEN base ELSE base || '::repeat_' || i END AS doc_name, split, CAST(i AS INTEGER) AS repeat_index FROM ({_REPEATS})",
    ),
    "boost_copies": (
        lambda s, d: corpus.boost_train(_docs(s, d), 2, "auto_balance"),
        f"SELECT doc_id || '::auto_balance_' || i AS doc_name, CAST(i AS INTEGER) AS copy FROM (SELECT doc_id, unnest(range(1, 3)) AS i FROM documents WHERE {_SPLIT} = 'train')",
    ),
    "holdout_route": (
        lambda s, d: corpus.routed(_docs(s, d), table(s, d, "benchmark")),
        f"SELECT 'd' || doc_id AS name, {_SPLIT} AS target FROM documents UNION ALL SELECT 'b' || item_id, 'holdout/benchmark' FROM benchmark",
    ),
    "band_gates": (
        lambda s, d: corpus.band_fractions(_docs(s, d), table(s, d, "conversations"), table(s, d, "benchmark")),
        """WITH b AS (SELECT 'pgen' AS band, CAST(sum(strlen(text)) AS BIGINT) AS n_bytes FROM documents UNION ALL SELECT 'ptraj', CAST(sum(strlen(text)) AS BIGINT) FROM conversations UNION ALL SELECT 'pbench', CAST(sum(strlen(text)) AS BIGINT) FROM benchmark),
        f AS (SELECT band, n_bytes, CASE WHEN band = 'pbench' THEN 0.0::DOUBLE ELSE n_bytes::DOUBLE / sum(CASE WHEN band <> 'pbench' THEN n_bytes ELSE 0 END) OVER () END AS share FROM b)
        SELECT band, n_bytes, round(share, 6) AS share, CASE band WHEN 'pgen' THEN share >= 0.7 WHEN 'ptraj' THEN share BETWEEN 0.05 AND 0.3 ELSE n_bytes > 0 END AS passes FROM f""",
    ),
    "bottom_k_hash": (
        lambda s, d: corpus.least_hashes(_docs(s, d), 50, 7),
        f"SELECT doc_id, {_UNIT.format(seed=7, id='doc_id')} AS score FROM documents ORDER BY score, doc_id DESC LIMIT 50",
    ),
    "duplicate_profile": (
        lambda s, d: corpus.duplicate_profile(_docs(s, d), "source"),
        "SELECT source, count(*) AS n_rows, count(DISTINCT text) AS n_distinct, count(*) - count(DISTINCT text) AS n_surplus FROM documents GROUP BY source",
    ),
    "contaminated_probes": (
        lambda s, d: corpus.contamination(_docs(s, d), table(s, d, "benchmark")),
        r"""WITH w AS (SELECT 'd' AS t, doc_id AS id, list_filter(regexp_split_to_array(lower(text), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
          UNION ALL SELECT 'b', item_id, list_filter(regexp_split_to_array(lower(text), '[\x20\x09-\x0D]+'), lambda x: x <> '') FROM benchmark),
        r AS (SELECT DISTINCT t, id, array_to_string(w[i:i + 7], ' ') AS run FROM (SELECT t, id, w, unnest(range(1, len(w) - 6)) AS i FROM w WHERE len(w) >= 8))
        SELECT b.id AS item_id, count(DISTINCT d.id) AS n_docs FROM r AS b JOIN r AS d ON b.run = d.run AND b.t = 'b' AND d.t = 'd' GROUP BY 1""",
    ),
    "pack_summary": (
        lambda s, d: packing.summary(_docs(s, d), SEQ_LEN),
        f"SELECT split, n_docs, document_tokens, document_tokens // 1025 AS n_sequences, document_tokens // 1025 * 1025 AS packed_tokens, document_tokens % 1025 AS dropped_tokens FROM ({_PACKED})",
    ),
    "pack_sequences": (
        lambda s, d: packing.sequences(_docs(s, d), SEQ_LEN),
        f"""WITH o AS ({_OFFSETS}), e AS (SELECT split, n, start, unnest(range(start // 1025, CAST((start + n - 1) // 1025 + 1 AS BIGINT))) AS seq_id FROM o)
        SELECT split, seq_id, count(*) AS n_docs, CAST(sum(least(start + n, (seq_id + 1) * 1025) - greatest(start, seq_id * 1025)) AS BIGINT) AS n_tokens FROM e GROUP BY 1, 2""",
    ),
    "pack_shards": (
        lambda s, d: packing.shards(_docs(s, d), SEQ_LEN, PER_SHARD),
        f"""WITH p AS (SELECT split, document_tokens // 1025 AS n FROM ({_PACKED})), e AS (SELECT split, n, unnest(range((n - 1) // 512 + 1)) AS k FROM p WHERE n > 0)
        SELECT split, k AS shard_index, k * 512 AS start_sequence_index, least(512, n - k * 512) AS sequence_count, least(512, n - k * 512) * 1025 AS token_count FROM e""",
    ),
    "sliding_windows": (
        lambda s, d: packing.windows(_docs(s, d), 2048),
        """WITH d AS (SELECT doc_id, CAST(strlen(text) + 1 AS BIGINT) AS n FROM documents WHERE strlen(text) + 1 >= 2),
        e AS (SELECT doc_id, n, unnest(range(CAST(greatest(0, ceil((n - 2049) / 1024)) AS BIGINT) + 1)) AS w FROM d)
        SELECT doc_id, w AS "window", w * 1024 AS start, least(2049, n - w * 1024) AS n_real, 2049 - least(2049, n - w * 1024) AS n_pad FROM e""",
    ),
    "permuted_batches": (
        lambda s, d: _batches(_docs(s, d)),
        f"""WITH c AS (SELECT count(*) AS n FROM documents), m AS (SELECT n, {_DIGEST[0]}::UBIGINT % n AS m0, CAST({_DIGEST[1]}::UBIGINT % n AS BIGINT) AS s FROM c),
        k AS (SELECT n, s, list_filter(list_transform(range(0, n), lambda i: CASE WHEN m0 = 0 THEN i + 1 ELSE (m0::BIGINT - 1 + i) % n + 1 END), lambda x: gcd(x, n) = 1)[1] AS m FROM m),
        i AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents), j AS (SELECT (i * m + s) % n AS item, i FROM i, k)
        SELECT doc_id, j.i // {BATCH} AS batch_id, (j.i % {BATCH}) // {BATCH // RANKS} AS rank, j.i % {BATCH // RANKS} AS slot FROM j JOIN i ON i.i = j.item""",
    ),
    "bigram_nll": (
        lambda s, d: packing.bigram_nll(_docs(s, d), 0.5),
        f"""WITH h AS (SELECT {_SPLIT} AS split, hex(encode(text)) AS x FROM documents), p AS (SELECT split, substr(x, 2 * i - 1, 4) AS pair, count(*) AS n FROM (SELECT split, x, unnest(range(1, length(x) // 2)) AS i FROM h) GROUP BY 1, 2),
        t AS (SELECT pair, n FROM p WHERE split = 'train'), c AS (SELECT substr(pair, 1, 2) AS first, sum(n) AS context FROM t GROUP BY 1)
        SELECT CAST(sum(p.n) AS BIGINT) AS n_pairs, round(sum(-ln((coalesce(t.n, 0) + 0.5::DOUBLE) / (coalesce(context, 0) + 128.0::DOUBLE)) * p.n) / sum(p.n), 6) AS nll
        FROM p LEFT JOIN t ON t.pair = p.pair LEFT JOIN c ON c.first = substr(p.pair, 1, 2) WHERE p.split = 'val'""",
    ),
    "prev_action_lag": (
        lambda s, d: sequences.previous(table(s, d, "conversations"), *_STEPS),
        "SELECT conv_id, turn, role, lag(role, 1, '<start>') OVER (PARTITION BY conv_id ORDER BY turn) AS previous FROM conversations",
    ),
    "contiguous_turns": (
        lambda s, d: sequences.contiguous(table(s, d, "conversations"), "conv_id", "turn"),
        "SELECT conv_id, count(*) AS n_steps, count(DISTINCT turn) = count(*) AND min(turn) = 0 AND max(turn) = count(*) - 1 AS whole FROM conversations GROUP BY 1",
    ),
    "round_robin_limit": (
        lambda s, d: sequences.round_robin(_docs(s, d), "source", "doc_id", 70),
        "SELECT source, doc_id, CAST(turn AS INTEGER) AS turn FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS turn FROM documents) ORDER BY turn, source LIMIT 70",
    ),
    "kv_records": (
        lambda s, d: sequences.record_lines(table(s, d, "conversations"), *_STEPS),
        "SELECT conv_id, turn, 'REASONING_STATE_V1' || chr(10) || 'trace=' || conv_id || chr(10) || 'step=' || turn || chr(10) || 'action=' || role AS record, role AS parsed_action FROM conversations",
    ),
    "vocab_ids": (
        lambda s, d: sequences.vocabulary(table(s, d, "orders"), "o_orderstatus", "o_orderpriority"),
        "SELECT o_orderstatus, o_orderpriority, dense_rank() OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority) - 1 AS id FROM (SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders)",
    ),
    "coverage_reasons": (
        lambda s, d: sequences.coverage(table(s, d, "events").filter("event_id % 10 = 0"), table(s, d, "events").filter("event_id % 10 > 0"), "user_id", "event_type"),
        """WITH t AS (SELECT DISTINCT user_id, event_type FROM events WHERE event_id % 10 > 0)
        SELECT CASE WHEN (e.user_id, e.event_type) IN (SELECT (user_id, event_type) FROM t) THEN 'covered' WHEN e.user_id IN (SELECT user_id FROM t) THEN 'unseen_value' ELSE 'missing_head' END AS reason, count(*) AS n
        FROM events AS e WHERE event_id % 10 = 0 GROUP BY 1""",
    ),
    "backoff_lookup": (
        lambda s, d: sequences.backoff(table(s, d, "events").filter("event_id % 10 = 0"), table(s, d, "events").filter("event_id % 10 > 0"), [["event_type", "user_id"], ["user_id"], []], "value"),
        """WITH q AS (SELECT DISTINCT event_type, user_id FROM events WHERE event_id % 10 = 0), t AS (SELECT * FROM events WHERE event_id % 10 > 0),
        a AS (SELECT event_type, user_id, count(DISTINCT value) AS n FROM t GROUP BY 1, 2), b AS (SELECT user_id, count(DISTINCT value) AS n FROM t GROUP BY 1), c AS (SELECT count(DISTINCT value) AS n FROM t)
        SELECT q.event_type, q.user_id, CASE WHEN a.n > 0 THEN 0 WHEN b.n > 0 THEN 1 WHEN c.n > 0 THEN 2 ELSE -1 END AS level, coalesce(a.n, b.n, c.n) AS n_candidates
        FROM q LEFT JOIN a ON a.event_type = q.event_type AND a.user_id = q.user_id LEFT JOIN b ON b.user_id = q.user_id CROSS JOIN c""",
    ),
    "backoff_lookup_whole": (
        lambda s, d: sequences.backoff(*(_user_steps(s, d).filter(f"event_id % 10 {side}") for side in ("= 0", "> 0")), [["user_id", "event_type", "previous"], ["user_id", "event_type"], ["user_id"], ["event_type"], []], "value"),
        """WITH s AS (SELECT *, lag(event_type, 1, '<start>') OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM events),
        q AS (SELECT DISTINCT user_id, event_type, previous FROM s WHERE event_id % 10 = 0), t AS (SELECT * FROM s WHERE event_id % 10 > 0),
        a AS (SELECT user_id, event_type, previous, nullif(count(DISTINCT value), 0) AS n FROM t GROUP BY 1, 2, 3), b AS (SELECT user_id, event_type, nullif(count(DISTINCT value), 0) AS n FROM t GROUP BY 1, 2),
        c AS (SELECT user_id, nullif(count(DISTINCT value), 0) AS n FROM t GROUP BY 1), e AS (SELECT event_type, nullif(count(DISTINCT value), 0) AS n FROM t GROUP BY 1), f AS (SELECT nullif(count(DISTINCT value), 0) AS n FROM t)
        SELECT q.user_id, q.event_type, q.previous, CASE WHEN a.n > 0 THEN 0 WHEN b.n > 0 THEN 1 WHEN c.n > 0 THEN 2 WHEN e.n > 0 THEN 3 WHEN f.n > 0 THEN 4 ELSE -1 END AS level, coalesce(a.n, b.n, c.n, e.n, f.n, 0) AS n_candidates
        FROM q LEFT JOIN a ON a.user_id = q.user_id AND a.event_type = q.event_type AND a.previous = q.previous LEFT JOIN b ON b.user_id = q.user_id AND b.event_type = q.event_type
        LEFT JOIN c ON c.user_id = q.user_id LEFT JOIN e ON e.event_type = q.event_type CROSS JOIN f""",
    ),
    "p95_stats": (
        lambda s, d: evals.percentiles(table(s, d, "events"), "event_type", "value"),
        "SELECT event_type, count(value) AS n, round(avg(value), 4) AS mean, quantile_disc(value, 0.95) AS p95_rank, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.5), 6) AS median, max(value) AS most FROM events GROUP BY 1",
    ),
    "stderr_agg": (
        lambda s, d: evals.standard_errors(table(s, d, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice"),
        "SELECT l_returnflag, l_linestatus, count(l_extendedprice) AS n, round(avg(l_extendedprice), 6) AS mean, round(stddev_pop(l_extendedprice) / sqrt(count(l_extendedprice)), 6) AS stderr FROM lineitem GROUP BY 1, 2",
    ),
    "cover_curve": (
        lambda s, d: evals.cover_curve(_docs(s, d), "source"),
        "WITH c AS (SELECT source, count(*) AS n FROM documents GROUP BY 1) SELECT source, n, CAST(row_number() OVER w AS INTEGER) AS rank, round(sum(n) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::DOUBLE / sum(n) OVER (), 6) AS covered FROM c WINDOW w AS (ORDER BY n DESC, source)",
    ),
    "lookup_probe": (
        lambda s, d: evals.lookup_probe(table(s, d, "events"), "user_id", "event_type", F.col("event_id") % 5 > 0),
        """WITH t AS (SELECT user_id, event_type, count(*) AS n FROM events WHERE event_id % 5 > 0 GROUP BY 1, 2),
        b AS (SELECT user_id, event_type AS guess FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS k FROM t) WHERE k = 1),
        o AS (SELECT event_type AS overall FROM t GROUP BY 1 ORDER BY sum(n) DESC, 1 LIMIT 1),
        r AS (SELECT count(*) AS n, sum(CASE WHEN event_type = guess THEN 1 ELSE 0 END)::DOUBLE / count(*) AS a, sum(CASE WHEN event_type = overall THEN 1 ELSE 0 END)::DOUBLE / count(*) AS z
              FROM events LEFT JOIN b USING (user_id) CROSS JOIN o WHERE event_id % 5 = 0)
        SELECT n, round(a, 6) AS accuracy, round(z, 6) AS baseline, round(a - z, 6) AS lift FROM r""",
    ),
    "micro_macro_accuracy": (
        lambda s, d: evals.accuracies(table(s, d, "events"), "event_type", "user_id", _correct()),
        """WITH t AS (SELECT event_type, user_id, count(*) AS n, sum(CASE WHEN value > 5 THEN 1 ELSE 0 END) AS r FROM events GROUP BY 1, 2)
        SELECT event_type, count(*) AS n_traces, round(sum(r)::DOUBLE / sum(n), 6) AS step_accuracy, round(avg(CASE WHEN r = n THEN 1 ELSE 0 END), 6) AS trace_accuracy FROM t GROUP BY 1""",
    ),
    "prefix_until_error": (
        lambda s, d: evals.until_first_error(table(s, d, "events"), "user_id", ["ts", "event_id"], _correct(), "value"),
        """WITH o AS (SELECT user_id, value, min(CASE WHEN value > 5 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ok FROM events)
        SELECT user_id, CAST(sum(ok) AS BIGINT) AS prefix, round(sum(CASE WHEN ok = 1 THEN value ELSE 0.0 END), 4) AS reward FROM o GROUP BY 1""",
    ),
    "ordered_counts": (
        lambda s, d: evals.ordered_counts(_docs(s, d), "lang"),
        "SELECT coalesce(lang, 'unknown') AS value, count(*) AS n FROM documents GROUP BY 1 ORDER BY 2 DESC, 1",
    ),
    "two_hop_paths": (
        lambda s, d: graphs.two_hops(_links(s, d)),
        f"WITH e AS ({_LINKS}) SELECT DISTINCT a.source, a.target AS middle, b.target FROM e AS a JOIN e AS b ON a.target = b.source",
    ),
    "reduced_edges": (
        lambda s, d: graphs.reduced(_links(s, d)),
        f"WITH e AS ({_LINKS}) SELECT source, target FROM e EXCEPT SELECT a.source, b.target FROM e AS a JOIN e AS b ON a.target = b.source",
    ),
    "shortest_hops": (
        lambda s, d: graphs.shortest_all(_both_ways(_links(s, d)), "r0"),
        f"WITH RECURSIVE o AS ({_LINKS}), e AS (SELECT source, target FROM o UNION SELECT target, source FROM o), r AS (SELECT 'r0' AS node, 0 AS hops UNION SELECT e.target, hops + 1 FROM r JOIN e ON e.source = r.node WHERE hops < 12) SELECT node, min(hops) AS hops FROM r GROUP BY 1",
    ),
    "neighbour_lists": (
        lambda s, d: graphs.neighbours(_links(s, d)),
        f"WITH e AS ({_LINKS}) SELECT source, count(*) AS degree, string_agg(CAST(target AS VARCHAR), ',' ORDER BY target) AS targets FROM e GROUP BY 1",
    ),
    # parts and suppliers that share a line, both ways; two-hop paths grow with the square of the degrees, so these have no SQL
    "two_hop_paths_whole": (lambda s, d: graphs.two_hops(_whole_edges(s, d)), None),
    "reduced_edges_whole": (
        lambda s, d: graphs.reduced(_shortcuts(s, d)),
        """WITH e AS (SELECT 's' || l_suppkey AS source, 'p' || l_partkey AS target FROM lineitem UNION SELECT 'p' || l_partkey, 'o' || l_orderkey FROM lineitem UNION SELECT 's' || (l_suppkey // 2 + 1), 'o' || l_orderkey FROM lineitem)
        SELECT source, target FROM e ANTI JOIN (SELECT DISTINCT a.source, b.target FROM e AS a JOIN e AS b ON a.target = b.source) AS p USING (source, target)""",
    ),
    "shortest_hops_whole": (
        lambda s, d: graphs.shortest_all(_whole_edges(s, d), 2),
        f"""WITH RECURSIVE e AS ({_WHOLE}), r(node, hops) USING KEY (node) AS (SELECT 2::BIGINT, 0 UNION SELECT e.target, r.hops + 1 FROM r JOIN e ON e.source = r.node WHERE e.target NOT IN (SELECT node FROM recurring.r))
        SELECT node, CAST(hops AS INTEGER) AS hops FROM r""",
    ),
    "neighbour_lists_whole": (
        lambda s, d: graphs.neighbours(_whole_edges(s, d)),
        f"SELECT source, count(*) AS degree, string_agg(CAST(target AS VARCHAR), ',' ORDER BY target) AS targets FROM ({_WHOLE}) GROUP BY 1",
    ),
    "focus_tokens": (
        lambda s, d: _docs(s, d).select("doc_id", F.array_join(texts.focus_tokens(F.col("text"), STOP), " ").alias("tokens")),
        """WITH a AS (SELECT doc_id, list_transform(regexp_extract_all(lower(text), '[a-z0-9_./%-]+'), lambda x: trim(x, '._')) AS a FROM documents), w AS (SELECT doc_id, unnest(a) AS w, generate_subscripts(a, 1) AS i FROM a),
        f AS (SELECT doc_id, w, min(i) AS i FROM w WHERE w <> '' AND w NOT IN ('the', 'and', 'that') GROUP BY 1, 2), k AS (SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS tokens FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM f) WHERE k <= 12 GROUP BY 1)
        SELECT doc_id, coalesce(tokens, '') AS tokens FROM documents LEFT JOIN k USING (doc_id)""",
    ),
    "lead_words": (
        lambda s, d: _docs(s, d).select("doc_id", F.array_join(texts.lead_words(F.col("text"), STOP), " ").alias("words")),
        """SELECT doc_id, array_to_string(list_filter(list_transform(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9_''-]*'), lambda x: lower(x)), lambda x: length(x) > 2 AND x NOT IN ('the', 'and', 'that'))[1:8], ' ') AS words FROM documents""",
    ),
    "keyword_tags": (
        lambda s, d: _docs(s, d).select("doc_id", texts.keyword_hits(F.col("text"), KEYWORDS).alias("hits"), texts.first_tag(F.col("text"), TAGS, "none").alias("tag")),
        "SELECT doc_id, CAST(contains(t, 'the') AS BIGINT) + CAST(contains(t, 'tion') AS BIGINT) + CAST(contains(t, 'ung') AS BIGINT) + CAST(contains(t, 'que') AS BIGINT) AS hits, CASE WHEN contains(t, 'apache') THEN 'apache' WHEN contains(t, 'licensed') THEN 'licence' WHEN contains(t, 'idiot') THEN 'insult' WHEN contains(t, 'the') THEN 'english' ELSE 'none' END AS tag FROM (SELECT doc_id, lower(text) AS t FROM documents)",
    ),
    "html_extract": (lambda s, d: pages.extract(table(s, d, "pages")), None),
    "event_windows": (
        lambda s, d: streams.counts(table(s, d, "events"), "10 minutes"),
        "SELECT time_bucket(INTERVAL 10 MINUTE, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    ),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for name, (query, _) in CATALOG.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in CATALOG.items() if sql}
