"""Substring dedup: passages that an earlier document has are cut, found by a count-min prefilter and exact grouping.

Every window of words picks a minimiser, the least of the short runs of words inside it, so equal windows pick equal
ones. Partitions count the minimisers of their documents into count-min sketches, which are merged; a count there is
never below the number of documents with any window that picks the minimiser, so it overestimates that of the window's
own documents too. A second pass groups exactly the windows whose minimiser is estimated to be in two documents or more,
by 96 bits of two hashes with words and windows salted apart by a secret of the run. Collisions in the sketch let more windows through and lose
none. A third pass takes only the windows of groups that hold two documents, and cuts.

The sketch has eight counters for each minimiser that the corpus may have, by its bytes, and 2 * MOST_COUNTERS bits at
most; fuller ones filter less, and what they let through is still judged exactly.
"""

from __future__ import annotations

import secrets
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loam.llm.common import HOT_KEYS, HOT_ROWS, Bits, bits_of, id_key, written
from loam.llm.hashing import Words, chunks, mix, words_of

WINDOW = 50
#: Words in a run that may be a window's minimiser.
RUN = 8
#: Counters in a row of the sketch at least and at most, rows, and blocks of counters that are merged on their own.
LEAST_COUNTERS, MOST_COUNTERS, ROWS, BLOCKS = 1 << 20, 1 << 29, 2, 256
#: Minimisers that a task counts before it gives out its sketch.
FLUSH = 1 << 20


def _minimisers(words: Words, window: int) -> np.ndarray:
    """For each word, the least hash of the runs inside the window from there on (texts' ends not minded)."""
    run = min(RUN, window)
    least = words.windows(run)
    least[max(0, len(least) - run + 1) :] = np.iinfo("u8").max
    width, wanted = 1, window - run + 1
    while width < wanted:
        step = min(width, wanted - width)
        least[:-step] = np.minimum(least[:-step], least[step:])
        width += step
    return least


def _starts(words: Words, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The words from which a window fits into its text, and the number of that text."""
    text = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
    at = np.flatnonzero(np.arange(len(text)) + window <= words.first[text + 1])
    return at, text[at]


def _counters(minimisers: np.ndarray, row: int, counters: int) -> np.ndarray:
    return (mix(minimisers + np.uint64(row + 1)) & np.uint64(counters - 1)).astype("u4")


def counters_for(docs: DataFrame, window: int) -> int:
    """Counters in a row: eight for each minimiser, of which words have about one in half a window."""
    n_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    wanted, counters = 8 * (n_bytes / 6) * 2 / max(2, window - RUN + 2), LEAST_COUNTERS
    while counters < min(wanted, MOST_COUNTERS):
        counters *= 2
    return counters


def repeated_minimisers(docs: DataFrame, window: int = WINDOW, secret: int = 0) -> list[np.ndarray]:
    """For each row of the merged sketch, a bitmap of the counters that reach two."""
    counters = counters_for(docs, window)
    size = counters // BLOCKS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            found = np.concatenate(held) if held else np.zeros(0, "u8")
            held.clear()
            out: list[tuple] = []
            for row in range(ROWS):
                counter, n = np.unique(_counters(found, row, counters), return_counts=True)
                cut = np.searchsorted(counter, np.arange(BLOCKS + 1, dtype="u8") * size)
                for b in range(BLOCKS):
                    if cut[b + 1] > cut[b]:
                        part = slice(cut[b], cut[b + 1])
                        out.append((row * BLOCKS + b, (counter[part] % size).astype("<u4").tobytes(), np.minimum(n[part], 2).astype("u1").tobytes()))
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int32(), pa.binary(), pa.binary()))], ["block", "counters", "counts"])

        total = 0
        for _, texts in chunks(batches):
            words = words_of(texts, secret=secret)
            at, text = _starts(words, window)
            least = _minimisers(words, window)[at]
            first = np.ones(len(at), bool)
            first[1:] = (least[1:] != least[:-1]) | (text[1:] != text[:-1])
            pairs = np.unique(np.rec.fromarrays([text[first], least[first]], names="text,least"))
            held.append(pairs.least)
            total += len(pairs)
            if total > FLUSH:
                yield flush()
                total = 0
        yield flush()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merged: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, places, counts in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                sums = merged.setdefault(block, np.zeros(size, "u1"))
                at = np.frombuffer(places, "<u4")
                sums[at] = np.minimum(sums[at] + np.frombuffer(counts, "u1"), 2)
        if merged:
            bits = [np.packbits(sums > 1).tobytes() for sums in merged.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(merged), pa.int32()), pa.array(bits, pa.binary())], ["block", "bits"])

    sketches = docs.select(F.col("text").cast("binary")).mapInArrow(count, "block int, counters binary, counts binary")
    tasks = max(8, docs.sparkSession.sparkContext.defaultParallelism)
    found = [np.zeros(counters // 8, "u1") for _ in range(ROWS)]
    for r in sketches.repartition(tasks, "block").mapInArrow(merge, "block int, bits binary").collect():  # ROWS * MOST_COUNTERS bits at most
        row, block = divmod(r["block"], BLOCKS)
        found[row][block * size // 8 : (block + 1) * size // 8] = np.frombuffer(r["bits"], "u1")
    return found


def _repeated_windows(docs: DataFrame, sketch: list[np.ndarray], window: int, secret: int, known: Bits | None = None) -> DataFrame:
    """a and b (hash), doc_id, own (hash of the row) and at (the first word) of each different window of a text that may be repeated.

    With `known`, only those whose a it has.
    """
    shared = docs.sparkSession.sparkContext.broadcast((sketch, known))

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, known = shared.value
        for part, texts in chunks(batches, 1):
            words = words_of(texts, secret=secret)
            at, text = _starts(words, window)
            least = _minimisers(words, window)[at]
            maybe = np.ones(len(at), bool)
            for row, found in enumerate(bits):
                c = _counters(least, row, 8 * len(found))
                maybe &= (found[c >> 3] >> (7 - (c & 7)).astype("u1") & 1).astype(bool)
            at, text = at[maybe], text[maybe]
            a, b = (words.windows(window, lane)[at] for lane in (0, 1))
            if known:
                own = known.has(a)
                at, text, a, b = at[own], text[own], a[own], b[own]
            first = np.unique(np.rec.fromarrays([text, a], names="text,a"), return_index=True)[1]
            first.sort()
            at, text, a, b = at[first], text[first], a[first], b[first]
            row = pa.array(text)
            place = pa.array((at - words.first[text]).astype("i4"))
            yield pa.RecordBatch.from_arrays([pa.array(a.view("i8")), pa.array((b >> np.uint64(32)).astype("u4").view("i4")), part.column(0).take(row), part.column(2).take(row), place], ["a", "b", "doc_id", "own", "at"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary"), _own().alias("own")).mapInArrow(tasks, "a bigint, b int, doc_id bigint, own bigint, at int")


def _own() -> Column:
    """Tells rows of one doc_id apart that have unlike texts."""
    return F.xxhash64(F.col("text").cast("binary"))


def _met(windows: DataFrame, groups: DataFrame) -> DataFrame:
    """windows with first_id of their group; groups (a, b, first_id, n: their rows, written) with many rows are split over tasks.

    What groups hold in all tells which are large, so windows are read once and never written. Groups of HOT_ROWS rows or
    more, and at least one in HOT_KEYS of all, are split: HOT_KEYS groups at most, which is what is broadcast.
    """
    bar = max(HOT_ROWS, (groups.agg(F.sum("n")).first()[0] or 0) // HOT_KEYS)
    salts = F.ceil(F.col("n") / bar).cast("int")
    hot = groups.filter(F.col("n") >= bar).select("a", "b", salts.alias("salts"))
    dealt = windows.join(F.broadcast(hot), ["a", "b"], "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("doc_id", "own", "at"), F.col("salts")), F.lit(0)).cast("int"))
    every = F.when(F.col("n") >= bar, F.sequence(F.lit(0), salts - 1)).otherwise(F.array(F.lit(0)))
    return dealt.drop("salts").join(groups.select("a", "b", "first_id", F.explode(every).alias("salt")), ["a", "b", "salt"])


def cut_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the kept words joined by a space) of every row of docs (doc_id, text).

    A word goes if a window of `window` words that covers it also starts in a document with a smaller doc_id; windows
    are judged on the input. Repeats inside one document stay. Null text: no words. Null doc_id: counts as larger than
    all others, and rows of it take nothing from each other. Repeated rows share their id, so they are treated alike.
    A row out for each row in; an empty table gives no rows; further columns don't matter.
    """
    secret = secrets.randbits(64)
    sketch = repeated_minimisers(docs, window, secret)
    holders = [F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"), F.max(F.col("doc_id").isNull()).alias("no_id"), F.count("*").alias("n")]
    groups = _repeated_windows(docs, sketch, window, secret).groupBy("a", "b").agg(*holders).filter("first_id < last_id OR (no_id AND first_id IS NOT NULL)")
    repeated = written(groups.select("a", "b", "first_id", "n"), "substring-groups")
    known = bits_of(repeated.select(F.col("a").alias("hash")), repeated.count())
    gone = _met(_repeated_windows(docs, sketch, window, secret, known), repeated).filter("doc_id IS NULL OR doc_id > first_id")
    places = gone.groupBy(id_key("doc_id").alias("__id"), "own").agg(F.sort_array(F.collect_set("at")).alias("places"))
    keyed = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary"), id_key("doc_id").alias("__own_id"), _own().alias("__own"))
    rows = keyed.join(places, (F.col("__own_id") == F.col("__id")) & (F.col("__own") == F.col("own")), "left").select("doc_id", "text", "places")

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches, 1):
            words = words_of(texts, secret=secret)
            hashes = words.windows(window)
            n_words, n_removed, kept = [], [], []
            for text, first, end, places in zip(texts, words.first[:-1].tolist(), words.first[1:].tolist(), part.column(2), strict=True):
                n, gone = end - first, 0
                found = text.split()
                if places.is_valid:
                    own = hashes[first : max(first, end - window + 1)]
                    again = np.flatnonzero(np.isin(own, own[places.values.to_numpy()]))
                    edges = np.zeros(n + 1, "i8")
                    edges[again] += 1
                    edges[again + window] -= 1
                    covered = np.cumsum(edges[:n]) > 0
                    gone = int(covered.sum())
                    found = [found[i] for i in np.flatnonzero(~covered)]
                n_words.append(n)
                n_removed.append(gone)
                kept.append(b" ".join(found))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary())], ["doc_id", "n_words", "n_removed", "kept"])

    return rows.mapInArrow(tasks, "doc_id bigint, n_words bigint, n_removed bigint, kept binary")
