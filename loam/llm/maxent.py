"""Language model scoring: a hashed maximum-entropy model with a class-factored softmax.

P(token | history) = P(group | history) * P(token | group, history). Tokens have a class by their last two bytes, and
every CLASSES / GROUPS classes are a group. The first factor is a softmax over the groups, the second a chain of two-way
softmaxes down the group's tree, in which each side of a fork has about half of the counts. Both have hashed n-gram and
skip features of the four tokens before, by the tokens themselves (whether the dictionary has these or not) and by their
classes; a fork's share of the counts is its bias, so without features a token has its share. Tokens outside a dictionary
of bounded size are one leaf of their class, inside which a token's chance is its smoothed count, met in a join.

Counts cover every training document, and so do the gradient steps: every position of every training text gives one,
the texts being dealt over the rounds; tasks take steps on theirs, and the tasks' weights are averaged between rounds, by
what each task has seen of a feature. Tables grow with the counted vocabulary, up to MOST_TIMES their least size, and
tasks with the tables, so that moving the weights costs no more than reading the texts; small tables leave many tasks,
so that no core has all of the steps. Texts are scored in sparse numpy batches.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import filterfalse

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loam.llm.averaging import train_averaged
from loam.llm.common import text_digest, written
from loam.llm.hashing import chunks, mix

#: The end of a text, as a token; no word is empty.
END = b""
CLASSES, GROUPS = 64, 32
#: In histories, what stands before a text: no token's code, and a class of its own.
BEFORE = 1 << 27
HISTORY = 4
#: Tokens, at most, whose counts every task holds; the most frequent ones.
DICTIONARY = 1 << 17
#: Weights of forks, for few tokens; rows of group weights for each kind of feature of the softmax over groups.
FORK_WEIGHTS, GROUP_ROWS = 1 << 20, 1 << 12
#: How many times as large the tables are for many tokens, at most: 92 MB of weights.
MOST_TIMES = 16
#: Examples in a training task, about, and for each weight; every position of a training text is one.
TASK_EXAMPLES, WEIGHT_EXAMPLES = 1 << 22, 1
ROUNDS, GROUP_RATE, FORK_RATE = 2, 1.0, 0.15
BATCH, FLUSH = 2048, 400_000


def is_held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 7 == 2


def tokens_of(text: bytes) -> list[bytes]:
    return [*text.lower().split(), END]


def class_of(token: bytes) -> int:
    return zlib.crc32(token[-2:]) % CLASSES


def count_tokens(docs: DataFrame) -> DataFrame:
    """token and n of all texts of docs; partial counts are flushed, so a task's memory is bounded."""

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def flush() -> pa.RecordBatch:
            found = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["token", "n"])
            counts.clear()
            return found

        for _, texts in chunks(batches):
            for text in texts:
                counts.update(tokens_of(text))
            if len(counts) > FLUSH:
                yield flush()
        yield flush()

    return docs.select(F.col("text").cast("binary")).mapInArrow(tasks, "token binary, n bigint").groupBy("token").agg(F.sum("n").alias("n"))


def _code_outside(token: bytes) -> int:
    """The negative code of a token outside the dictionary: 24 bits of its hash and its class."""
    return -1 - ((zlib.crc32(token) & ((1 << 24) - 1)) * CLASSES + class_of(token))


class _Ids(dict):
    """Ranks of the dictionary's tokens; those of other tokens are negative codes, which are worked out, not kept."""

    def __missing__(self, token: bytes) -> int:
        return _code_outside(token)


@dataclass(frozen=True)
class Model:
    """ids: dictionary tokens by rank. Leaves are the dictionary's tokens by rank, and then the others of each class."""

    ids: _Ids
    counts: np.ndarray  # by rank
    outside: np.ndarray  # n + number of tokens + 1 of the tokens outside the dictionary, by class
    n: int
    v: int
    classes: np.ndarray  # by leaf
    forks: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]  # see _trees
    weights: np.ndarray | None = None

    def codes(self, tokens: list[bytes]) -> np.ndarray:
        """Ranks of tokens; outside the dictionary their negative codes."""
        return np.fromiter(map(self.ids.__getitem__, tokens), "i4", len(tokens))

    def leaves(self, codes: np.ndarray) -> np.ndarray:
        leaves = codes.copy()
        other = codes < 0
        leaves[other] = len(self.ids) + (-1 - codes[other]) % CLASSES
        return leaves


def _trees(groups: np.ndarray, mass: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Trees over the leaves of each group, halving their mass: where each leaf's path begins (one more place at the end),
    the forks and sides (0 or 1) of the paths, and the logarithm of side 1's mass over side 0's for each fork."""
    order = np.lexsort((-mass, groups))
    total = np.concatenate(([0.0], np.cumsum(mass[order])))
    edges = np.flatnonzero(np.diff(groups[order])) + 1
    low, high = np.concatenate(([0], edges)), np.concatenate((edges, [len(order)]))
    leaf, fork, side, bias = [], [], [], []
    n = 0
    while len(low := low[own := high - low > 1]):
        high = high[own]
        middle = np.clip(np.searchsorted(total, (total[low] + total[high]) / 2, "right") - 1, low + 1, high - 1)
        places = np.concatenate([np.arange(a, b) for a, b in zip(low.tolist(), high.tolist(), strict=True)])
        number = np.repeat(np.arange(len(low)), high - low)
        leaf.append(order[places])
        fork.append(n + number)
        side.append(places >= middle[number])
        bias.append(np.log((total[high] - total[middle]) / (total[middle] - total[low])))
        n += len(low)
        low, high = np.concatenate((low, middle)), np.concatenate((middle, high))
    if not leaf:
        return np.zeros(len(mass) + 1, "i8"), np.zeros(0, "i4"), np.zeros(0, "i1"), np.zeros(0, "f4")
    at = np.concatenate(leaf)
    by_leaf = np.argsort(at, kind="stable")
    starts = np.concatenate(([0], np.cumsum(np.bincount(at, minlength=len(mass)))))
    return starts, np.concatenate(fork)[by_leaf].astype("i4"), np.concatenate(side)[by_leaf].astype("i1"), np.concatenate(bias).astype("f4")


def _vocabulary(counts: DataFrame) -> Model:
    level = F.floor(F.log2("n") * 8)
    cut, held = None, 0
    for row in sorted(counts.groupBy(level.alias("level")).count().collect(), reverse=True):
        held += row["count"]
        if held > DICTIONARY:
            break
        cut = row["level"]
    chosen = counts.filter((level >= cut) | (F.col("token") == F.lit(END))) if cut is not None else counts.filter(F.col("token") == F.lit(END))
    rows = sorted(chosen.collect(), key=lambda r: (-r["n"], r["token"]))  # DICTIONARY at most
    tokens = [bytes(r["token"]) for r in rows]
    n_each = np.array([r["n"] for r in rows], "f8")
    classes = np.array([class_of(t) for t in tokens], "i4")
    ending = F.crc32(F.substring("token", -2, 2)) % CLASSES
    outside = np.ones(CLASSES)
    n = v = 0
    for r in counts.groupBy(ending.cast("int").alias("ending")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
        outside[r["ending"]] += r["n"] + r["v"]
        n, v = n + r["n"], v + r["v"]
    np.subtract.at(outside, classes, n_each + 1)
    return model_of(tokens, n_each, outside, n, v)


def model_of(tokens: list[bytes], counts: np.ndarray, outside: np.ndarray, n: int, v: int) -> Model:
    """The model before any step, of dictionary tokens by falling count."""
    classes = np.concatenate((np.array([class_of(t) for t in tokens], "i4"), np.arange(CLASSES, dtype="i4")))
    return Model(_Ids((t, i) for i, t in enumerate(tokens)), counts, outside, n, v, classes, _trees(classes % GROUPS, np.concatenate((counts, outside))))


class _Weights:
    """The weights: group biases, rows of group weights by kind of feature, and the forks'; and how they are used."""

    KINDS = 3

    def __init__(self, model: Model, weights: np.ndarray) -> None:
        self.model, self.weights = model, weights
        self.rows = GROUP_ROWS * _times(model)
        self.bias, flat, self.forks = np.split(weights, [GROUPS, GROUPS + self.KINDS * self.rows * GROUPS])
        self.table = flat.reshape(-1, GROUPS)
        self.groups = model.classes % GROUPS
        self.starts, fork, side, bias = model.forks
        # of each fork on each leaf's path: the sign of the side to take, the bias towards it, and what its places mix in
        self.sign = 2 * side.astype("f4") - 1
        self.path_bias = self.sign * bias[fork]
        self.salt = mix(fork.astype("u8") + np.uint64(1 << 41)).astype("u4")
        self.shift = np.uint32(33 - len(self.forks).bit_length())

    def _context(self, history: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the group weights, and hashes of what the forks' features look at: one for each kind."""
        codes = history.T.astype("i8")
        c1, c2, c3, c4 = np.where(codes == BEFORE, CLASSES, self.model.classes[np.minimum(self.model.leaves(codes), len(self.model.classes) - 1)]).astype("u8")
        codes = codes[:2].astype("u8")
        near = [codes[0], c1 * np.uint64(128) + c2, c3 * np.uint64(128) + c4]
        far = [codes[0], mix(codes[0] * np.uint64(3) + np.uint64(1)) + codes[1]]
        salted = lambda parts, kind: [mix(x + (np.uint64(k + kind) << np.uint64(40))) for k, x in enumerate(parts)]
        rows = (np.stack(salted(near, 1)) % np.uint64(self.rows)).astype("i8") + np.arange(self.KINDS)[:, None] * self.rows
        return rows, np.stack(salted(far, 11)).astype("u4")

    def _group_logs(self, rows: np.ndarray) -> np.ndarray:
        z = self.table[rows[0]]
        for r in rows[1:]:
            z += self.table[r]
        z += self.bias
        z -= z.max(axis=1, keepdims=True)
        z -= np.log(np.exp(z).sum(axis=1, keepdims=True))
        return z

    def _paths(self, leaves: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the forks on the leaves' paths: the example, the signed logit, the sign, and the places of their weights."""
        starts = self.starts[leaves]
        sizes = self.starts[leaves + 1] - starts
        owner = np.repeat(np.arange(len(leaves)), sizes)
        at = np.arange(len(owner)) + (starts - (np.cumsum(sizes) - sizes))[owner]
        salt, sign = self.salt[at], self.sign[at]
        places = []
        for hashes in far:
            place = hashes[owner] ^ salt
            place *= np.uint32(0x9E3779B1)
            places.append((place >> self.shift).astype("i8"))
        z = self.forks[places[0]]
        for p in places[1:]:
            z += self.forks[p]
        z *= sign
        z += self.path_bias[at]
        return owner, z, sign, places

    def log_likelihood(self, history: np.ndarray, leaves: np.ndarray) -> np.ndarray:
        """Natural logarithm of each leaf's chance."""
        out = np.zeros(len(leaves))
        for a in range(0, len(leaves), BATCH):
            own = slice(a, a + BATCH)
            rows, far = self._context(history[own])
            logs = self._group_logs(rows)
            owner, z, _, _ = self._paths(leaves[own], far)
            n = len(logs)
            lost = np.log1p(np.exp(-np.abs(z))) - np.minimum(z, 0)
            out[own] = logs[np.arange(n), self.groups[leaves[own]]] - np.bincount(owner, lost, n)
        return out

    def step(self, history: np.ndarray, leaves: np.ndarray, seen_rows: np.ndarray, seen_forks: np.ndarray) -> None:
        """One gradient step for some examples; rates fall with the squared gradients that are summed up by row and by fork's weight."""
        rows, far = self._context(history)
        g = -np.exp(self._group_logs(rows))
        g[np.arange(len(leaves)), self.groups[leaves]] += 1
        self.bias += 0.002 * g.sum(axis=0)
        own, number = np.unique(rows.ravel(), return_inverse=True)
        # bincount adds rows up several times faster than reduceat or add.at
        places = (number[:, None] * GROUPS + np.arange(GROUPS)).ravel()
        sums = np.bincount(places, np.tile(g, (self.KINDS, 1)).ravel(), len(own) * GROUPS).reshape(-1, GROUPS).astype("f4")
        seen_rows[own] += (sums * sums).sum(axis=1)
        self.table[own] += sums * (GROUP_RATE / np.sqrt(1 + seen_rows[own]))[:, None]
        _, z, sign, places = self._paths(leaves, far)
        g = sign / (1 + np.exp(np.minimum(z, 30)))
        squares, g = g * g, FORK_RATE * g
        for p in places:
            np.add.at(seen_forks, p, squares)
            np.add.at(self.forks, p, g / np.sqrt(np.float32(0.1) + seen_forks[p]))


def _times(model: Model) -> int:
    """How often the features' tables are as large as for few tokens: as the root of all distinct tokens, MOST_TIMES at most."""
    times = 1
    while times < MOST_TIMES and times * times << 18 < model.v:
        times *= 2
    return times


def _training_tasks(n: int, n_weights: int, cores: int) -> int:
    """Tasks that share n examples, in whole waves over the cores, so that no core waits for a last few."""
    tasks = max(1, -(-n // max(TASK_EXAMPLES, WEIGHT_EXAMPLES * n_weights)))
    return tasks if tasks < cores else tasks // cores * cores


def _start(model: Model) -> np.ndarray:
    """Weights under which tokens have their share of the counts."""
    mass = np.bincount(model.classes % GROUPS, np.concatenate((model.counts, model.outside)), GROUPS)
    rest = np.zeros(_Weights.KINDS * GROUP_ROWS * _times(model) * GROUPS + FORK_WEIGHTS * _times(model))
    return np.concatenate((np.log(np.maximum(mass, 1e-6)), rest)).astype("f4")


def _history(codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The codes of the tokens before each token of texts, which have so many tokens each, one after another."""
    history = np.full((len(codes), HISTORY), BEFORE, "i4")
    place = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    for back in range(1, HISTORY + 1):
        at = np.flatnonzero(place >= back)
        history[at, back - 1] = codes[at - back]
    return history


def _codes(model: Model, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The codes of the tokens of texts one after another, and the number of tokens of each text."""
    each = [tokens_of(t) for t in texts]
    return model.codes([t for own in each for t in own]), np.array([len(own) for own in each])


def fit(docs: DataFrame, counts: DataFrame) -> Model:
    """The model of the training documents of docs (doc_id, text), whose token counts are counts (token, n)."""
    model = _vocabulary(counts)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in chunks(batches):
            codes, sizes = _codes(shared.value, texts)
            yield pa.RecordBatch.from_arrays([pa.array([sizes.astype("<i4").tobytes()], pa.binary()), pa.array([codes.astype("<i4").tobytes()], pa.binary())], ["sizes", "codes"])

    rows = docs.filter(~is_held_out()).select(F.col("text").cast("binary")).mapInArrow(examples, "sizes binary, codes binary")
    start = _start(model)
    n_tasks = _training_tasks(model.n, len(start), docs.sparkSession.sparkContext.defaultParallelism)
    dealt = written(rows.repartition(n_tasks), "maxent-examples")

    def local_pass(weights: np.ndarray, rows: pa.Table, number: int) -> tuple[np.ndarray, np.ndarray]:
        model = shared.value
        own = _Weights(model, weights)
        seen_rows, seen_forks = np.zeros(len(own.table), "f4"), np.zeros(len(own.forks), "f4")
        rng = np.random.default_rng(number)
        for k in rng.permutation(np.arange(number, rows.num_rows, ROUNDS)).tolist():  # each text in one round
            codes, sizes = (np.frombuffer(rows[c][k].as_py(), "<i4") for c in ("codes", "sizes"))
            history, leaves = _history(codes, sizes), model.leaves(codes)
            order = rng.permutation(len(codes))
            for a in range(0, len(codes), BATCH):
                at = order[a : a + BATCH]
                own.step(history[at], leaves[at], seen_rows, seen_forks)
        return weights, np.concatenate((np.full(GROUPS, rows.num_rows), np.repeat(seen_rows, GROUPS), seen_forks))

    weights = train_averaged(dealt, start, local_pass, ROUNDS, 1) if model.n else start
    shared.destroy()
    return replace(model, weights=weights)


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every whole text of docs (doc_id, text).

    Documents whose crc32(doc_id as text) mod 7 is 2 are held out; the others teach the model. score is the logarithm
    (base 10) of the text's probability, the end included; base_score that under smoothed token counts. Null text:
    empty, so its one token is the end. Null doc_id: as the empty text, not held out. Repeated rows: a row out for
    each row in, and each one teaches. An empty table gives no rows; further columns don't matter.
    """
    counts = written(count_tokens(docs.filter(~is_held_out())), "maxent-counts")
    model = fit(docs, counts)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary"), is_held_out().alias("held_out"), text_digest("text").alias("digest"))
    scale = np.log10(model.n + model.v + 1)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        maxent = _Weights(model, model.weights)
        log_counts = np.append(np.log10(model.counts + 1), 0.0)
        log_totals = np.log10(model.outside)
        for part, texts in chunks(batches, 1):
            codes, sizes = _codes(model, texts)
            leaves = model.leaves(codes)
            known = log_counts[np.maximum(codes, -1)]
            chance = maxent.log_likelihood(_history(codes, sizes), leaves) / np.log(10)
            other = codes < 0
            chance[other] -= log_totals[leaves[other] - len(model.ids)]
            starts = np.cumsum(sizes) - sizes
            sums = [np.add.reduceat(x, starts) for x in ((codes >= 0).astype("i8"), known - scale, chance)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), part.column(3), pa.array(sizes, pa.int64()), *map(pa.array, sums)], ["doc_id", "held_out", "digest", "n_tokens", "found", "base", "chance"])

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = shared.value.ids
        for part, texts in chunks(batches):
            tokens, times, digests = [], [], []
            for text, digest in zip(texts, part.column(1).to_pylist(), strict=True):
                found = Counter(filterfalse(ids.__contains__, tokens_of(text)))
                if found:
                    # a row of its own tells how many rows have this text; no word holds a line break
                    tokens += [b"\n" + digest, *found]
                    times += [1, *found.values()]
                    digests += [digest] * (len(found) + 1)
            yield pa.RecordBatch.from_arrays([pa.array(tokens, pa.binary()), pa.array(times, pa.int64()), pa.array(digests, pa.binary())], ["token", "times", "digest"])

    met = rows.select("text", "digest").mapInArrow(rare, "token binary, times bigint, digest binary").join(counts, "token", "left")
    mark = F.substring("token", 1, 1) == F.lit(b"\n")
    sums = met.groupBy("digest").agg(
        F.sum(F.when(mark, F.col("times")).otherwise(0)).alias("copies"),
        F.sum(F.when(~mark & F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("more_known"),
        F.sum(F.when(~mark, F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 1)).otherwise(0.0)).alias("more"),
    )
    sums = sums.select("digest", F.expr("more_known div copies").alias("more_known"), (F.col("more") / F.col("copies")).alias("more"))
    fitted = rows.mapInArrow(whole, "doc_id bigint, held_out boolean, digest binary, n_tokens bigint, found bigint, base double, chance double")
    more = F.coalesce("more", F.lit(0.0))
    known = F.col("found") + F.coalesce("more_known", F.lit(0))
    return fitted.join(sums, "digest", "left").select("doc_id", "held_out", "n_tokens", known.alias("n_known"), F.lit(model.n).cast("bigint").alias("train_tokens"), (F.col("base") + more).alias("base_score"), (F.col("chance") + more).alias("score"))
