"""Exact top-k by inner product: an impact-ordered index, processed score at a time.

A component's impact is floor(64 * x). The index is dealt into blocks of vectors; in a block, postings (dimension,
vector, impact) form segments by the power of two that their impact's size reaches, strongest first. For a block of
queries, the segments are added to the scores in that order. What is still to come is bounded for every vector by the
norm of its weaker postings and by the largest impact that remains; a query stops when the vectors that could still
enter its top k are proven to be few, and those are scored anew, exactly. Queries meet every block; the block results
are merged by rank.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCALE = 64
#: Vectors in an index block and queries in a query block, about.
INDEX_BLOCK, QUERY_BLOCK = 8192, 2048
#: A query stops when at most so many times k vectors can still be members.
FEW = 8


def impacts(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id and impacts (doubles that hold integers) of the vectors that take part.

    Left out: rows with a null id, and vectors that are null or hold null or non-finite components (or such that `scale`
    times them is). Empty vectors have the score 0 with all others. From 2**52 on every double is an integer.
    """
    x = F.col("embedding").cast("array<double>")
    fits = F.forall(x, lambda v: F.coalesce(F.abs(v * scale) < F.lit(float("inf")), F.lit(False)))
    found = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), x.alias("x")).filter(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & fits)
    return found.select("vec_id", F.transform("x", lambda v: F.when(F.abs(v * scale) < 2.0**52, F.floor(v * scale).cast("double")).otherwise(v * scale)).alias("impacts"))


def _dense(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of a list column as a matrix; shorter vectors end in zeros."""
    column = column.combine_chunks()
    sizes = np.diff(column.offsets.to_numpy())
    found = np.zeros((len(column), width))
    found[np.repeat(np.arange(len(column)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = column.flatten().to_numpy()
    return found


def _segments(index: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """For each segment, strongest first: its postings, and of what is weaker the norm by vector and the largest impact."""
    level = np.frexp(np.abs(index))[1]
    found = []
    for own in np.unique(level[index != 0])[::-1]:
        rest = np.where(level < own, index, 0)
        found.append((np.where(level == own, index, 0), np.sqrt((rest * rest).sum(axis=1)), float(np.abs(rest).max(initial=0))))
    return found


def _small(query: np.ndarray, rows: np.ndarray) -> bool:
    """Whether all sums of their products are exact in doubles."""
    with np.errstate(over="ignore"):
        return bool(np.abs(query).max(initial=0) * np.abs(rows).max(initial=0) * rows.shape[-1] < 2.0**51)


def _best(ids: np.ndarray, query: np.ndarray, rows: np.ndarray, k: int) -> list[tuple[int, int]]:
    """The k best of some vectors with their exact scores; a score beyond a long counts as its limit."""
    if _small(query, rows):
        exact = (rows @ query).astype("i8")
        return [(int(ids[i]), int(exact[i])) for i in np.lexsort((ids, -exact))[:k]]
    whole = [max(-(2**63), min(2**63 - 1, sum(int(a) * int(b) for a, b in zip(query, row, strict=True)))) for row in rows]
    return [(int(ids[i]), whole[i]) for i in sorted(range(len(whole)), key=lambda i: (-whole[i], ids[i]))[:k]]


def top_of_block(ids: np.ndarray, index: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(query, vector, score) of each query's k best in the block, ties to the smaller id, the query itself left out."""
    order = np.argsort(ids, kind="stable")
    ids, index = ids[order], index[order]
    own = np.searchsorted(ids, query_ids)
    own_end = np.searchsorted(ids, query_ids, "right")
    if not _small(queries, index):  # bounds in doubles would prove nothing
        every = [np.concatenate((np.arange(a), np.arange(b, len(ids)))) for a, b in zip(own, own_end, strict=True)]
        return [(int(q), *found) for q, row, own in zip(query_ids, queries, every, strict=True) for found in _best(ids[own], row, index[own], k)]
    # rounding in doubles is far below one half as long as scores stay below 2**51
    slack = 0.5 + 1e-9 * float(np.abs(index).max(initial=0)) * float(np.abs(queries).max(initial=0)) * index.shape[1]
    scores = np.zeros((len(queries), len(ids)))
    norm, total = np.sqrt((queries * queries).sum(axis=1)), np.abs(queries).sum(axis=1)
    waiting = np.arange(len(queries))
    members: dict[int, np.ndarray] = {}
    for postings, rest_norm, rest_most in [*_segments(index), (None, np.zeros(len(ids)), 0.0)]:
        if postings is not None:
            scores[waiting] += queries[waiting] @ postings.T
        proven = []
        for q in waiting:
            to_come = np.minimum(norm[q] * rest_norm, total[q] * rest_most) + slack
            low = scores[q] - to_come
            low[own[q] : own_end[q]] = -np.inf
            high = scores[q] + to_come
            high[own[q] : own_end[q]] = -np.inf
            bar = np.partition(low, len(low) - k)[len(low) - k] if len(low) > k else -np.inf
            possible = np.flatnonzero((high >= bar) & (high > -np.inf))
            if postings is None or rest_most == 0 or len(possible) <= FEW * k:
                members[q] = possible
                proven.append(q)
        waiting = np.setdiff1d(waiting, proven)
        if not len(waiting):
            break
    return [(int(query_ids[q]), *found) for q, possible in members.items() for found in _best(ids[possible], queries[q], index[possible], k)]


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = SCALE) -> DataFrame:
    """query_id, rank (from 1), vec_id and score: for each row of vectors (vec_id, embedding) that is_query marks, the k
    largest integer inner products with all other rows, ties to the smaller vec_id; fewer if there are fewer.

    See impacts for rows that take no part. Vectors of unlike lengths count as if zeros followed. Rows that share an id
    are one vector each as candidates, and none of them is a candidate of its own id; as queries, the rows of an id are
    one (the least). Without rows there is no result; further columns don't matter.
    """
    own = impacts(vectors, scale)
    n = own.count()
    blocks = max(1, -(-n // INDEX_BLOCK))
    queries = own.filter(is_query).groupBy("vec_id").agg(F.min("impacts").alias("impacts"))
    query_blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    dealt = F.pmod(F.xxhash64("vec_id", "impacts"), F.lit(blocks)).alias("block")
    each = lambda count: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(count - 1).cast("bigint")))
    index = own.select(dealt, each(query_blocks).alias("part"), "vec_id", "impacts")
    asked = queries.select(each(blocks).alias("block"), F.pmod(F.xxhash64("vec_id"), F.lit(query_blocks)).alias("part"), "vec_id", "impacts")

    def block(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple[int, int, int]] = []
        if left.num_rows and right.num_rows:
            width = max(int(np.diff(t["impacts"].combine_chunks().offsets.to_numpy()).max()) for t in (left, right))
            found = top_of_block(left["vec_id"].to_numpy(), _dense(left["impacts"], width), right["vec_id"].to_numpy(), _dense(right["impacts"], width), k)
        return pa.table({name: pa.array([r[i] for r in found], pa.int64()) for i, name in enumerate(("query_id", "vec_id", "score"))})

    # every query (a stated set) meets every row, block by block
    parts = index.groupBy("block", "part").cogroup(asked.groupBy("block", "part")).applyInArrow(block, "query_id bigint, vec_id bigint, score bigint")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return parts.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS c FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, v.vec_id, CAST(list_dot_product(CAST(q.c AS DOUBLE[]), CAST(v.c AS DOUBLE[])) AS BIGINT) AS score
  FROM v AS q JOIN v ON v.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0
), r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 20
"""
