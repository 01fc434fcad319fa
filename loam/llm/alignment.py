"""Cross-tokenizer alignment: where two tokenizers' tokens of the same text end together.

A batch of texts is one run of bytes. The ends of all its tokens of either kind are counted once over that run, and it is
cut where both kinds end; prefix sums over the cuts, taken at the documents' borders, give each document's groups. Tokens
that end together have bytes of which one ends with the other's, so the vocabularies alone tell which pairs of ids can
ever be linked: their number is bounded by the tokens' lengths, whatever the corpus. Pairs go by their place in that list.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.llm.common import written
from loam.llm.hashing import chunks
from loam.llm.vocabularies import ByteVocabulary, PieceVocabulary, byte_vocabulary, joined, piece_vocabulary, table_of


def linkable(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """a's id * len(b) + b's id, sorted, of all pairs of tokens of which one's bytes end with the other's.

    There are at most the bytes of all tokens of a, times the ids of b that share their bytes, and the other way round.
    """
    by_bytes: tuple[dict[bytes, list[int]], dict[bytes, list[int]]] = ({}, {})
    for known, tokens in zip(by_bytes, (a, b), strict=True):
        for i, token in enumerate(tokens):
            if token:
                known.setdefault(token, []).append(i)
    pairs = [(i, j) for i, x in enumerate(a) for k in range(len(x)) for j in by_bytes[1].get(x[k:], ())]
    pairs += [(i, j) for j, y in enumerate(b) for k in range(1, len(y)) for i in by_bytes[0].get(y[k:], ())]
    found = np.array(pairs, "i8").reshape(-1, 2)
    return np.unique(found[:, 0] * len(b) + found[:, 1])


@dataclass(frozen=True)
class Pair:
    """The two vocabularies by their files."""

    a_path: str
    b_path: str

    @property
    def a(self) -> ByteVocabulary:
        return byte_vocabulary(self.a_path, False)

    @property
    def b(self) -> PieceVocabulary:
        return piece_vocabulary(self.b_path)

    @property
    def tables(self) -> tuple[list[bytes], list[bytes]]:
        return _tables(self)


@lru_cache(maxsize=4)
def _tables(pair: Pair) -> tuple[list[bytes], list[bytes]]:
    return table_of(pair.a.tokens), table_of(pair.b.tokens)


@dataclass
class Aligned:
    """What align_texts finds, by text: numbers of tokens and groups, the groups written out, and the links."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    groups: list[bytes]
    a_ids: np.ndarray
    b_ids: np.ndarray


def _flat(ids: list[np.ndarray]) -> np.ndarray:
    return np.concatenate(ids).astype("i8") if ids else np.zeros(0, "i8")


def align_texts(texts: list[str], pair: Pair, pieces: list[bytes]) -> Aligned:
    """The alignment of each text; pieces: see written_out."""
    a_table, b_table = pair.tables
    spaced = [" " + t if t else "" for t in texts]
    a_ids = [pair.a.ids(t) if t else np.zeros(0, "u4") for t in spaced]
    b_ids = pair.b.ids(texts)
    for i, text in enumerate(spaced):
        raw = text.encode()
        if joined(a_table, a_ids[i].tolist()) != raw or joined(b_table, b_ids[i].tolist()) != raw:
            spaced[i], a_ids[i], b_ids[i] = "", a_ids[i][:0], b_ids[i][:0]
    n_a, n_b = (np.array(list(map(len, x)), "i8") for x in (a_ids, b_ids))
    border = np.cumsum([0, *(len(t.encode()) for t in spaced)])
    a, b = _flat(a_ids), _flat(b_ids)
    a_end, b_end = (np.cumsum(np.fromiter(map(len, table), "i8", len(table))[ids]) for table, ids in ((a_table, a), (b_table, b)))
    ends_a, ends_b = (np.bincount(x, minlength=border[-1] + 1) for x in (a_end, b_end))
    cut = (ends_a > 0) & (ends_b > 0)
    groups, links = np.cumsum(cut), np.cumsum(ends_a * ends_b)
    a_cut, b_cut, at_border = cut[a_end], cut[b_end], np.zeros(len(cut), bool)
    at_border[border] = True
    text = written_out(a, b, a_cut, b_cut, groups[a_end - 1], groups[b_end - 1], at_border[b_end], len(a_table), pieces)
    at = np.concatenate(([0], np.cumsum(n_a + n_b)))
    by_text = [b"".join(text[s:e]) for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    return Aligned(n_a, n_b, np.diff(groups[border]), np.diff(links[border]), by_text, a[a_cut], b[b_cut])


@lru_cache(maxsize=4)
def written_pieces(pair: Pair) -> list[bytes]:
    """Each id of a before a comma and before a bar, then each of b before a comma, before a semicolon and alone."""
    a, b = map(len, pair.tables)
    return [f"{i}{mark}".encode() for i in range(a) for mark in (",", "|")] + [f"{i}{mark}".encode() for i in range(b) for mark in (",", ";", "")]


def written_out(a: np.ndarray, b: np.ndarray, a_cut: np.ndarray, b_cut: np.ndarray, a_group: np.ndarray, b_group: np.ndarray, last: np.ndarray, n_ids: int, pieces: list[bytes]) -> list[bytes]:
    """The tokens of all texts as they are written: by group, those of a before those of b."""
    n_groups = int(max(a_group.max(initial=-1), b_group.max(initial=-1))) + 1
    a_before, b_before = (np.concatenate(([0], np.cumsum(np.bincount(g, minlength=n_groups)))) for g in (a_group, b_group))
    order = np.empty(len(a) + len(b), "i8")
    order[np.arange(len(a)) + b_before[a_group]] = 2 * a + a_cut
    order[np.arange(len(b)) + a_before[b_group + 1]] = 2 * n_ids + 3 * b + np.where(last, 2, b_cut)
    return list(map(pieces.__getitem__, order.tolist()))


def aligned(docs: DataFrame, pair: Pair, pairs: np.ndarray) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups (`a1,a2|b1;a3|b2,b3`) and links (places in pairs) of every row."""
    n_b_ids = len(pair.tables[1])
    shared = docs.sparkSession.sparkContext.broadcast(pairs)

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = written_pieces(pair)
        for held, texts in chunks(batches, 1):
            found = align_texts([t.decode() for t in texts], pair, pieces)
            places = np.searchsorted(shared.value, found.a_ids * n_b_ids + found.b_ids).astype("<u4").tobytes()
            at = 4 * np.concatenate(([0], np.cumsum(found.n_links)))
            links = [places[s:e] for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            numbers = [pa.array(x) for x in (found.n_a, found.n_b, found.n_groups, found.n_links)]
            yield pa.RecordBatch.from_arrays([held.column(0), *numbers, pa.array(found.groups, pa.binary()).cast(pa.string()), pa.array(links, pa.binary())], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "links"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(tasks, "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups string, links binary")


def link_counts(rows: DataFrame, n_pairs: int) -> np.ndarray:
    """How many links of all rows hold each pair; a task and the driver hold one number for each pair that can be."""

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_pairs, "i8")
        for batch in batches:
            for links in batch.column(0):
                found, n = np.unique(np.frombuffer(links.as_py(), "<u4"), return_counts=True)
                total[found] += n
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype("i4")), pa.array(total[used])], ["pair", "n"])

    counted = rows.select("links").mapInArrow(tasks, "pair int, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(n_pairs, "i8")
    total[counted["pair"].to_numpy()] = counted["n"].to_numpy()
    return total


def align(docs: DataFrame, a_path: str, b_path: str, digest: bool = False) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups of every row of docs (doc_id, text).

    Both tokenizers see a text with a space before it. n_best is the number of links whose pair of ids is, in the whole
    corpus, the most frequent or one of the most frequent of its b id; count_sum adds up the links' pair counts. With
    digest, groups_sha256 comes in place of groups ('' without tokens). Null and empty texts, and those that either
    tokenizer doesn't give back byte by byte, have zeros and ''. Null ids and repeated rows: a row out for each row in, each
    counted. An empty table gives no rows; further columns don't matter.

    The texts are tokenised once; what is counted and looked up afterwards are the links written then. The counts that the
    tasks get are one number for each pair that the vocabularies allow (see linkable).
    """
    pair = Pair(a_path, b_path)
    pairs = linkable(*pair.tables)
    rows = aligned(docs, pair, pairs)
    if digest:
        rows = rows.withColumn("groups", F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise(F.lit(""))).withColumnRenamed("groups", "groups_sha256")
    rows = written(rows, "aligned")
    counts = link_counts(rows, len(pairs))
    most = np.zeros(len(pair.tables[1]), "i8")
    np.maximum.at(most, pairs % len(most), counts)
    shared = docs.sparkSession.sparkContext.broadcast((counts, counts == most[pairs % len(most)]))
    text = "groups_sha256" if digest else "groups"

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, best = shared.value
        for batch in batches:
            links = [np.frombuffer(x.as_py(), "<u4") for x in batch.column(6)]
            scores = [pa.array([int(table[x].sum()) for x in links], pa.int64()) for table in (best, counts)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *scores, batch.column(5)], [*batch.schema.names[:5], "n_best", "count_sum", text])

    return rows.mapInArrow(tasks, f"doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, {text} string")
