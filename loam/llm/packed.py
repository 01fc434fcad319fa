"""Packing by concatenate and cut: documents' ids end to end, cut into sequences of one length.

The first pass tokenises every document once, and writes its ids with the number of its partition and the ids before it
there. What the partitions hold in all gives, by a prefix sum, where each begins in the whole stream. The second pass
reads the ids, adds that start, and cuts at every multiple of the length; a boundary record names each piece. Only the
last sequence can fall short.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loam.llm.common import written
from loam.llm.hashing import chunks
from loam.llm.vocabularies import byte_vocabulary

LENGTH = 1024
END_ID = 0
#: Bytes of ids that a task turns into pieces at once, about.
STEP_BYTES = 1 << 24


def tokenised(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """doc_id, part, before, n and ids of every row: its partition, the ids before it there, how many it has, and those.

    ids are little-endian, of two bytes where the vocabulary allows it and of four elsewhere; end_id closes each document.
    """

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, before, part = byte_vocabulary(path, True), 0, TaskContext.get().partitionId()
        kind, end = id_type(max(vocabulary.tokens)), np.array([end_id], "u4")
        for held, texts in chunks(batches, 1):
            found = [np.concatenate((vocabulary.ids(t.decode()), end)).astype(kind) for t in texts]
            sizes = np.array(list(map(len, found)), "i8")
            starts = before + np.cumsum(sizes) - sizes
            before += int(sizes.sum())
            arrays = [held.column(0), pa.array(np.full(len(found), part, "i4")), pa.array(starts), pa.array(sizes), pa.array([x.tobytes() for x in found], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "part", "before", "n", "ids"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(tasks, "doc_id bigint, part int, before bigint, n bigint, ids binary")


def id_type(largest: int) -> str:
    return "<u2" if largest < 1 << 16 else "<u4"


def pack(docs: DataFrame, path: str, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """Boundary records of all documents' ids, packed into sequences of at most `length`; a row for each piece.

    doc_id; start, the ids of its document before the piece; length; ids (little-endian unsigned 32-bit); doc_tokens, all
    ids of the document, the closing one included; sequence_id; offset, the ids before the piece in its sequence. Null and
    empty texts have the closing id alone. Null ids and repeated rows: each row is a document of its own. An empty table
    gives no rows; further columns don't matter. The driver gets one number for each partition.
    """
    rows = written(tokenised(docs, path, end_id), "packed")
    totals = sorted((r["part"], r["n"]) for r in rows.groupBy("part").agg(F.sum("n").alias("n")).collect())
    starts = np.zeros(max((part for part, _ in totals), default=0) + 1, "i8")
    for (part, _), start in zip(totals, np.cumsum([0, *(n for _, n in totals)]), strict=False):
        starts[part] = start
    shared = docs.sparkSession.sparkContext.broadcast(starts)

    def cut(doc_id: pa.Array, first: np.ndarray, n: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
        """The pieces of documents that begin at `first` in the stream and whose `n` ids follow each other in ids."""
        begins, ends = first // length, (first + n - 1) // length
        of = np.repeat(np.arange(len(n)), ends - begins + 1)
        within = np.arange(len(of)) - np.repeat(np.cumsum(ends - begins + 1) - (ends - begins + 1), ends - begins + 1)
        sequence = begins[of] + within
        start = np.maximum(sequence * length, first[of])
        size = np.minimum((sequence + 1) * length, (first + n)[of]) - start
        places = np.concatenate(([0], np.cumsum(size))) * 4
        pieces = pa.Array.from_buffers(pa.binary(), len(of), [None, pa.py_buffer(places.astype("i4")), pa.py_buffer(ids.astype("<u4"))])
        columns = [doc_id.take(pa.array(of)), pa.array(start - first[of]), pa.array(size), pieces, pa.array(n[of]), pa.array(sequence), pa.array(start - sequence * length)]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, before, n, raw = (batch.column(i) for i in (1, 2, 3, 4))
            first, n = shared.value[part.to_numpy()] + before.to_numpy(), n.to_numpy()
            sizes = np.concatenate(([0], np.cumsum(pc.binary_length(raw).to_numpy(), dtype="i8")))
            at = 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(sizes, sizes[at] + STEP_BYTES, "right")) - 1)
                flat = b"".join(raw.slice(at, to - at).to_pylist())
                yield cut(batch.column(0).slice(at, to - at), first[at:to], n[at:to], np.frombuffer(flat, f"<u{len(flat) // int(n[at:to].sum())}"))
                at = to

    return rows.mapInArrow(tasks, "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint")


def sequences(pieces: DataFrame, length: int = LENGTH, pad_id: int = 0) -> DataFrame:
    """sequence_id, n_ids, ids (padded to `length`, unless n_ids is a power of two) and the doc_ids and lengths of its pieces, in order.

    A sequence has at most `length` pieces, so no task collects more than that for one.
    """
    in_order = F.array_sort(F.collect_list(F.struct("offset", "start", "doc_id", "length", "ids")))
    held = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_ids"), in_order.alias("pieces"))
    whole = F.unhex(F.array_join(F.transform("pieces", lambda p: F.hex(p["ids"])), ""))
    pad = F.lit(pad_id.to_bytes(4, "little"))
    power: Column = F.col("n_ids").bitwiseAND(F.col("n_ids") - 1) == 0
    padded = F.when(power, whole).otherwise(F.rpad(whole, F.lit(4 * length), pad))
    return held.select("sequence_id", "n_ids", padded.alias("ids"), F.col("pieces.doc_id").alias("doc_ids"), F.col("pieces.length").alias("lengths"))
