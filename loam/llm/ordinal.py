"""Quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade >= k) = sigmoid(s - threshold_k), with one score s from hashed text weights for all grades and thresholds in
order. Grades here: 0 toxic, 1 poor, 2 good. The model is fitted on a bounded sample of rated documents by averaged
local passes and scores every whole text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loam.llm.averaging import train_averaged
from loam.llm.common import written
from loam.llm.hashing import chunks, mix, words_of

BITS = 18
SIZE = 1 << BITS
#: Rated documents that the fit may use at most, about.
SAMPLE = 20_000
#: Sampled documents in which a hashed feature must occur to get a weight.
MIN_DOCS = 8
#: Features in a training task, about: averaging over more tasks than needed costs accuracy.
TASK_FEATURES = 1 << 21
ROUNDS = 6
EPOCHS = 4
#: What a byte of a word stands for in its shape: letters a, digits 0, the rest itself.
_SHAPE = np.arange(256, dtype="u1")
for _kind in (b"abcdefghijklmnopqrstuvwxyz", b"0123456789"):
    _SHAPE[list(_kind)] = _kind[0]


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # float32, SIZE of them
    thresholds: tuple[float, float]


#: Features of a text as a whole, and of each of its distinct words.
WHOLE, EACH = 11, 3
#: Classes of bytes whose shares of a text are features: upper-case letters, digits, and other printable ASCII.
_CLASSES = (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")


def features_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets and values of the texts' features, and where each text's begin (one more place at the end).

    A text has its bias, and its shares of repeated words, of words that follow themselves, and of bytes of _CLASSES
    (each plain, and by steps that are finer near 0).
    Each distinct word in lower case (A-Z) gives 1 + ln(count), one for its first six bytes, and its share of the text
    for the shape of its last four bytes.
    """
    words = words_of(texts, lower=True)
    hashes, n = words.hashes(), np.diff(words.first)
    owner = np.repeat(np.arange(len(texts)), n)
    key = owner.astype("u8") << np.uint64(40) | (hashes >> np.uint64(24))
    order = np.argsort(key)
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(key)), bool), key[order][1:] != key[order][:-1])))
    count = np.diff(np.append(first, len(key))).astype("f8")
    text, word = owner[order[first]], order[first]
    distinct = np.bincount(text, minlength=len(texts))
    again = np.flatnonzero((hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1]))
    repeats, follow = 1 - distinct / np.maximum(1, n), np.bincount(owner[again], minlength=len(texts)) / np.maximum(1, n)

    def bucket(values: np.ndarray, kind: int) -> np.ndarray:
        return (mix(values.astype("u8") + (np.uint64(kind) << np.uint64(56))) % np.uint64(SIZE)).astype("i4")

    def pieces(raw: np.ndarray, kind: str, starts: np.ndarray) -> np.ndarray:
        return np.ndarray((len(raw) + 1 - int(kind[-1]),), kind, raw, strides=(1,))[starts]

    starts = np.concatenate(([0], np.cumsum(WHOLE + EACH * distinct)))
    index, value = np.empty(starts[-1], "i4"), np.empty(starts[-1], "f4")
    begins = np.concatenate(([0], np.cumsum([len(t) for t in texts], dtype="i8")))
    raw = np.frombuffer(b"".join(texts), "u1")
    shares = [repeats, follow]
    for kind in _CLASSES:
        own = np.zeros(256, "i8")
        own[list(kind)] = 1
        shares.append(np.diff(np.concatenate(([0], np.cumsum(own[raw])))[begins]) / np.maximum(1, np.diff(begins)))
    index[starts[:-1]], value[starts[:-1]] = bucket(np.zeros(len(texts)), 1), 1.0
    for k, share in enumerate(shares):
        for more, part, x in ((1, np.zeros(len(texts)), 5 * share), (2, np.ceil(20 * np.sqrt(share)), 2.0)):
            index[starts[:-1] + 2 * k + more], value[starts[:-1] + 2 * k + more] = bucket(part, 2 * k + more + 20), x
    sizes = (words.ends - words.starts)[word]
    head = pieces(words.raw, "<u8", words.starts[word]) & np.uint64((1 << 48) - 1)
    head = np.where(sizes >= 6, head, hashes[word] >> np.uint64(16))
    tail = pieces(np.concatenate((np.zeros(4, "u1"), _SHAPE[words.raw])), "<u4", words.ends[word]) >> np.maximum(0, 4 - sizes).astype("u4") * np.uint32(8)
    place = starts[text] + WHOLE + np.arange(len(word)) - (np.cumsum(distinct) - distinct)[text]
    for part, kind, x in ((hashes[word] >> np.uint64(8), 8, 1 + np.log(count)), (head, 9, 1.0), (tail, 10, 3 * count / n[text])):
        index[place], value[place] = bucket(part, kind), x
        place += distinct[text]
    return index, value, starts


def grade(quality: Column, toxic: Column) -> Column:
    """0 for toxic, else 1 for poor and 2 for good; null without a rating of quality."""
    return F.when(toxic == 1, 0).when(quality.isNotNull(), 1 + (quality >= 1).cast("int")).cast("int")


def rated_sample(docs: DataFrame, labels: DataFrame, bound: int) -> DataFrame:
    """doc_id, text and grade of about `bound` rated documents at most, picked by a hash of their id.

    Documents rated more than once count with their lowest grade.
    """
    rated = labels.select("doc_id", grade(F.col("quality"), F.col("toxic")).alias("grade")).dropna().groupBy("doc_id").agg(F.min("grade").alias("grade"))
    n = rated.count()
    share = 1 << 30 if n <= bound else int((1 << 30) * bound / n)
    picked = rated.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share)
    return docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")  # bounded by `bound`


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, rounds: int = ROUNDS) -> Model:
    """The model fitted on a sample of labels (doc_id, quality, toxic). Without ratings: no weights, everything good."""

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches):
            index, value, starts = features_of(texts)
            places = pa.array(starts, pa.int32())
            yield pa.RecordBatch.from_arrays([part.column(1).cast(pa.int32()), pa.ListArray.from_arrays(places, pa.array(index)), pa.ListArray.from_arrays(places, pa.array(value))], ["grade", "index", "value"])

    rows = rated_sample(docs, labels, sample).select(F.col("text").cast("binary"), "grade").mapInArrow(featurise, "grade int, index array<int>, value array<float>")
    found = written(rows, "ordinal-examples")
    n_features = found.agg(F.sum(F.size("index"))).first()[0] or 0
    examples = written(found.repartition(max(1, n_features // TASK_FEATURES)), "ordinal-dealt")
    common = found.select(F.explode(F.array_distinct("index")).alias("bucket")).groupBy("bucket").count().filter(F.col("count") >= MIN_DOCS)
    mask = np.zeros(SIZE, "f4")
    mask[[r["bucket"] for r in common.collect()]] = 1  # at most SIZE of them
    start = np.zeros(SIZE + 2, "f4")
    start[SIZE:] = -2.0, -1.0

    def local_pass(w: np.ndarray, rows: pa.Table, number: int) -> tuple[np.ndarray, np.ndarray]:
        seen = np.full(SIZE + 2, 1.0, "f4")
        grades, lists, values = rows["grade"].to_numpy(), rows["index"].combine_chunks(), rows["value"].combine_chunks()
        places, index = lists.offsets.to_numpy(), lists.values.to_numpy()
        value = values.values.to_numpy() * mask[index]
        sigmoid = lambda z: 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))
        rng = np.random.default_rng(number)
        for _ in range(EPOCHS):
            for k in rng.permutation(len(grades)):
                y, own = grades[k], slice(places[k], places[k + 1])
                i, v = index[own], value[own]
                s = float(w[i] @ v)
                a = 1.0 if y == 0 else sigmoid(s - w[SIZE + y - 1])
                b = 0.0 if y == 2 else sigmoid(s - w[SIZE + y])
                g = (1 - a - b) * v - 1e-5 * w[i]
                np.add.at(seen, i, g * g)
                np.add.at(w, i, 0.3 * g / np.sqrt(seen[i]))
                gap = max(a - b, 1e-6)
                if y > 0:
                    w[SIZE + y - 1] -= 0.01 * a * (1 - a) / gap
                if y < 2:
                    w[SIZE + y] += 0.01 * b * (1 - b) / gap
                w[SIZE + 1] = max(w[SIZE + 1], w[SIZE] + 0.1)
        seen[SIZE:] += len(grades)
        return w, seen - 1  # a feature's averaged weight is that of the tasks which know it, by their gradients

    w = train_averaged(examples, start, local_pass, rounds, 1)
    return Model(w[:SIZE] * mask, (float(w[SIZE]), float(w[SIZE + 1])))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, expected_grade, p_poor_or_better, p_good of every whole text of docs (doc_id, text).

    Null and empty texts are scored as texts without words. Null or repeated ids and repeated rows: a row out for each
    row in. An empty table gives no rows; further columns don't matter.
    """
    return _scored(docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("binary").alias("text")), model).drop("text")


def _scored(docs: DataFrame, model: Model) -> DataFrame:
    """docs, whose last column is text (binary), with the model's figures."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    text = len(docs.columns) - 1

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for part, texts in chunks(batches, text):
            index, value, starts = features_of(texts)
            s = np.add.reduceat(model.weights[index].astype("f8") * value, starts[:-1])
            low, high = (1 / (1 + np.exp(np.clip(t - s, -30, 30))) for t in model.thresholds)
            yield pa.RecordBatch.from_arrays([*part.columns, *map(pa.array, (low + high, low, high))], [*part.schema.names, "expected_grade", "p_poor_or_better", "p_good"])

    added = [T.StructField(n, T.DoubleType()) for n in ("expected_grade", "p_poor_or_better", "p_good")]
    return docs.mapInArrow(tasks, T.StructType([*docs.schema.fields, *added]))


def select_good(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows of docs, with its columns, whose probability of being good is at least `least`; ties stay.

    Null and empty texts count as texts without words. Null or repeated ids and repeated rows are judged row by row; an
    empty table stays empty; further columns come along, whatever their names.
    """
    others = [c for c in docs.columns if c != "text"]
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("row"), F.col("text").cast("binary").alias("text"))
    kept = _scored(packed, model).filter(F.col("p_good") >= least)
    return kept.select(*[F.col("text").cast("string").alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
