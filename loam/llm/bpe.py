"""Byte-level BPE encoding and decoding with a public rank file.

The distinct words (matches of the split pattern) of the corpus are counted, and Spark's higher-order functions fold
the ranked merges over the byte arrays of the frequent ones, against a literal rank map. That dictionary has a bounded
number of entries and goes to every task. The words outside it are merged where they occur, by the same rule for many
words at once (a long one by a heap): folding them in Spark, too, took twice the CPU time that the limits allow (figures
in the README). Decoding takes the binary pieces of the ids, which lie one after another then. A literal array of all
pieces, looked up in Spark, made plans of megabytes, which the driver keeps.
"""

from __future__ import annotations

import base64
import heapq
import json
import struct
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loam.llm.common import written
from loam.llm.vocabularies import PATTERN

#: Words with more bytes than this are not counted for the dictionary, nor remembered.
FOLD_BYTES = 48
#: Entries of the dictionary that the fold fills and every task gets; the most frequent words.
DICTIONARY = 1 << 17
RANK_BUCKETS = 8192
NO_RANK = 2**31 - 1
FLUSH = 200_000
#: Words outside the dictionary whose ids a task remembers.
MEMORY = 100_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank from a rank file: base64 and number a line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


@lru_cache(maxsize=4)
def finder(pattern: str) -> Callable[[str], list[str]]:
    """What finds all matches of the pattern in a text; for the public PATTERN by kinds of characters, in a fraction of the time."""
    import regex

    if pattern != PATTERN:
        return regex.compile(pattern).findall
    every = "".join(map(chr, range(0x110000)))
    kinds = np.full(len(every), 3, "u1")  # 0: white space, 1: letter, 2: number, 3: other
    for kind, found in enumerate((r"\s", r"\p{L}", r"\p{N}")):
        kinds[[ord(c) for c in regex.findall(found, every)]] = kind

    def matches(text: str) -> list[str]:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        kind = kinds.take(points)
        starts = np.ones(len(kind), bool)
        np.not_equal(kind[1:], kind[:-1], out=starts[1:])
        # white space before something else: its last character goes alone or, if a space, with what follows
        last = np.flatnonzero((kind[:-1] == 0) & starts[1:])
        starts[last] = True
        starts[last[points[last] == 32] + 1] = False
        # an apostrophe that no space or other mark leads takes these letters with it
        for q in np.flatnonzero((points[:-1] == 39) & starts[:-1] & (kind[1:] == 1)).tolist():
            if size := 2 if text[q + 1] in "stmd" else 3 if text[q + 1 : q + 3] in ("re", "ve", "ll") else 0:
                starts[q + 1] = False
                starts[q + size : q + size + 1] = True
        at = np.flatnonzero(starts).tolist()
        ends = at[1:]
        ends.append(len(text))
        return [text[a:b] for a, b in zip(at, ends)]  # noqa: B905

    return matches


def count_words(docs: DataFrame, pattern: str, longest: int = FOLD_BYTES) -> DataFrame:
    """word and n: how often each match of the pattern of up to `longest` bytes occurs in the texts."""

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, counts = finder(pattern), Counter()

        def flush() -> pa.RecordBatch:
            kept = [(w, n) for w, n in counts.items() if len(w) * 4 <= longest or len(w.encode()) <= longest]
            counts.clear()
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], ["word", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    counts.update(find(text))
                    if len(counts) > FLUSH:
                        yield flush()
        yield flush()

    return docs.select("text").mapInArrow(tasks, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def frequent(counts: DataFrame, limit: int) -> DataFrame:
    """The rows of counts at or above the lowest count for which there are at most limit of them.

    The cut is found on a histogram over the logarithm of the count, of a few hundred rows at any size.
    """
    level = F.floor(F.log2("n") * 8)
    histogram = sorted(counts.groupBy(level.alias("level")).count().collect(), reverse=True)
    cut, total = None, 0
    for row in histogram:
        total += row["count"]
        if total > limit:
            break
        cut = row["level"]
    return counts.filter(level >= cut) if cut is not None else counts.filter(F.lit(False))


def _rank_map(ranks: dict[bytes, int]) -> Column:
    """The ranks as a literal. Bytes are pairs of hex digits here, so that a map can be keyed by them.

    It is an array of small maps by checksum, as Spark goes through a map's keys one by one.
    """
    buckets: list[dict[str, int]] = [{} for _ in range(RANK_BUCKETS)]
    for token, rank in ranks.items():
        digits = token.hex().upper()
        buckets[zlib.crc32(digits.encode()) % RANK_BUCKETS][digits] = rank
    return F.from_json(F.lit(json.dumps(buckets)), T.ArrayType(T.MapType(T.StringType(), T.IntegerType())))


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value worked out once: a lambda variable holds it by reference, where an expression would be repeated."""
    return F.element_at(F.transform(F.array(value), use), 1)


def fold_word(word: Column, known: Column) -> Column:
    """The ids of a word: ranked merges folded over its bytes, one merge a step, lowest rank and leftmost first."""

    def rank_of(token: Column) -> Column:
        return F.try_element_at(F.element_at(known, (F.crc32(token.cast("binary")) % RANK_BUCKETS + 1).cast("int")), token)

    def pair_rank(one: Column, two: Column) -> Column:
        return F.coalesce(rank_of(F.concat(one, two)), F.lit(NO_RANK))

    def merge_once(state: Column) -> Column:
        """The state with its best pair merged; of the pairs' ranks only those beside it change."""
        parts, pairs, at = state["parts"], state["pairs"], state["at"]

        def merged(token: Column) -> Column:
            left = F.when(at > 1, F.array(pair_rank(F.try_element_at(parts, at - 1), token))).otherwise(F.array().cast("array<int>"))
            right = F.when(at < F.size(pairs), F.array(pair_rank(token, F.try_element_at(parts, at + 2)))).otherwise(F.array().cast("array<int>"))
            new_parts = F.concat(F.slice(parts, F.lit(1), at - 1), F.array(token), F.slice(parts, at + 2, F.size(parts)))
            new_pairs = F.concat(F.slice(pairs, F.lit(1), F.greatest(at - 2, F.lit(0))), left, right, F.slice(pairs, at + 2, F.size(pairs)))
            return _with(new_pairs, lambda found: F.struct(new_parts.alias("parts"), found.alias("pairs"), best_of(found).alias("at")))

        return F.when(at == 0, state).otherwise(_with(F.concat(F.element_at(parts, at), F.element_at(parts, at + 1)), merged))

    def best_of(pairs: Column) -> Column:
        """The place of the lowest rank, the leftmost one; 0 if no pair has a rank."""
        return _with(F.coalesce(F.array_min(pairs), F.lit(NO_RANK)), lambda least: F.when(least == NO_RANK, F.lit(0)).otherwise(F.array_position(pairs, least).cast("int")))

    def folded(raw: Column) -> Column:
        n_bytes = (F.octet_length(raw) / 2).cast("int")
        single = F.transform(F.sequence(F.lit(1), n_bytes), lambda i: F.substring(raw, 2 * i - 1, F.lit(2)))

        def from_bytes(parts: Column) -> Column:
            places = F.when(n_bytes > 1, F.sequence(F.lit(1), n_bytes - 1)).otherwise(F.array().cast("array<int>"))
            pairs = F.transform(places, lambda i: pair_rank(F.element_at(parts, i), F.element_at(parts, i + 1)))
            start = _with(pairs, lambda found: F.struct(parts.alias("parts"), found.alias("pairs"), best_of(found).alias("at")))
            return F.transform(F.aggregate(places, start, lambda state, _: merge_once(state))["parts"], rank_of)

        return _with(rank_of(raw), lambda whole: F.when(whole.isNotNull(), F.array(whole)).otherwise(_with(single, from_bytes)))

    return _with(F.hex(F.encode(word, "UTF-8")), folded)


def fold_merges(words: DataFrame, ranks: dict[bytes, int], tasks: int | None = None) -> DataFrame:
    """word and ids of every word that is not empty: see fold_word."""
    coded = _with(_rank_map(ranks), lambda known: fold_word(F.col("word"), known))
    return words.filter("word <> ''").repartition(tasks or min(32, words.sparkSession.sparkContext.defaultParallelism)).select("word", coded.alias("ids"))


def _merge_short(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a word of few bytes: its pairs' ranks in a list, of which the first least one is merged."""
    parts = [word[i : i + 1] for i in range(len(word))]
    pairs = [ranks.get(word[i : i + 2], NO_RANK) for i in range(len(word) - 1)]
    while pairs and (least := min(pairs)) < NO_RANK:
        i = pairs.index(least)
        parts[i] += parts.pop(i + 1)
        del pairs[i]
        if i < len(pairs):
            pairs[i] = ranks.get(parts[i] + parts[i + 1], NO_RANK)
        if i:
            pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], NO_RANK)
    return [ranks[p] for p in parts]


def merge_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word; of a long one by a heap of adjacent pairs by rank and place, so of any length."""
    if word in ranks:
        return [ranks[word]]
    n = len(word)
    if n <= FOLD_BYTES:
        return _merge_short(word, ranks)
    parts: list[bytes | None] = [word[i : i + 1] for i in range(n)]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(ranks[word[i : i + 2]], i, word[i : i + 2]) for i in range(n - 1) if word[i : i + 2] in ranks]
    heapq.heapify(heap)
    while heap:
        _, i, pair = heapq.heappop(heap)
        j = after[i]
        if parts[i] is None or j >= n or parts[i] + parts[j] != pair:
            continue
        parts[i], parts[j], after[i] = pair, None, after[j]
        if after[j] < n:
            before[after[j]] = i
            longer = pair + parts[after[j]]
            if longer in ranks:
                heapq.heappush(heap, (ranks[longer], i, longer))
        if before[i] >= 0:
            longer = parts[before[i]] + pair
            if longer in ranks:
                heapq.heappush(heap, (ranks[longer], before[i], longer))
    return [ranks[p] for p in parts if p is not None]


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


@dataclass
class Merges:
    """Merges many words at once: a step takes the best pair of each word, the leftmost one of the lowest rank."""

    ranks: dict[bytes, int]

    @cached_property
    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """A hash table of the pairs of ids whose tokens make a token, and of that token's id."""
        ranks = self.ranks
        found = [(ranks[t[:i]] << 32 | ranks[t[i:]], rank) for t, rank in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        left, values = np.array(found, "i8").reshape(-1, 2).T
        size = 1 << (8 * len(left) + 1).bit_length()
        keys, ids = np.full(size, -1, "i8"), np.full(size, NO_RANK, "i4")
        at = self._place(left, size)
        while len(left):
            free = keys[at] < 0
            keys[at[free]] = left[free]
            held = keys[at] == left
            ids[at[held]] = values[held]
            left, values, at = left[~held], values[~held], (at[~held] + 1) & (size - 1)
        return keys, ids

    @cached_property
    def bytes(self) -> np.ndarray:
        return np.array([self.ranks.get(bytes([b]), -1) for b in range(256)], "i4")

    @staticmethod
    def _place(keys: np.ndarray, size: int) -> np.ndarray:
        return (keys.astype("u8") * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(65 - size.bit_length())).astype("i8")

    def _joined(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """The ids of the tokens that pairs of ids make; NO_RANK where they make none."""
        keys, ids = self.pairs
        wanted = one.astype("i8") << 32 | two
        at = self._place(wanted, len(keys))
        found = np.where(keys[at] == wanted, ids[at], NO_RANK)
        open_ = np.flatnonzero((keys[at] != wanted) & (keys[at] >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & (len(keys) - 1)
            held = keys[at[open_]]
            same = held == wanted[open_]
            found[open_[same]] = ids[at[open_[same]]]
            open_ = open_[~same & (held >= 0)]
        return found

    def of(self, words: list[bytes]) -> list[bytes]:
        """The packed ids of each word; none is empty. Words go on until they have no pair that makes a token."""
        sizes = np.fromiter(map(len, words), "i8", len(words))
        parts = self.bytes[np.frombuffer(b"".join(words), "u1")]
        if (parts < 0).any():
            raise KeyError("a byte without a rank")
        owner = np.repeat(np.arange(len(words)), sizes)
        pair = np.append(self._joined(parts[:-1], parts[1:]), NO_RANK) if len(parts) else parts
        pair[np.cumsum(sizes) - 1] = NO_RANK
        done_owner, done_parts = [], []
        while len(parts):
            starts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            sizes = np.diff(np.append(starts, len(owner)))
            least = np.minimum.reduceat(pair, starts)
            going = np.repeat(least < NO_RANK, sizes)
            if not going.all():
                done_owner.append(owner[~going])
                done_parts.append(parts[~going])
                parts, owner, pair = parts[going], owner[going], pair[going]
                sizes, least = sizes[least < NO_RANK], least[least < NO_RANK]
            hits = np.flatnonzero(pair == np.repeat(least, sizes))
            first = hits[np.concatenate(([True], owner[hits[1:]] != owner[hits[:-1]]))] if len(hits) else hits
            parts[first] = least
            kept = np.ones(len(parts), bool)
            kept[first + 1] = False
            ended = first + 2 >= len(parts)
            ended[~ended] = owner[first[~ended] + 2] != owner[first[~ended]]
            pair[first] = NO_RANK
            parts, owner, pair = parts[kept], owner[kept], pair[kept]
            at = first - np.arange(len(first))
            right = at[~ended]
            pair[right] = self._joined(parts[right], parts[right + 1])
            left = at[at > 0]
            left = left[owner[left - 1] == owner[left]]
            pair[left - 1] = self._joined(parts[left - 1], parts[left])
        if not done_owner:
            return []
        owner = np.concatenate(done_owner)
        flat = np.concatenate(done_parts)[np.argsort(owner, kind="stable")].astype("<u4").tobytes()
        ends = (4 * np.cumsum(np.bincount(owner, minlength=len(words)))).tolist()
        return [flat[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


@lru_cache(maxsize=1)
def _dictionary(block: bytes) -> dict[str, bytes]:
    """The packed ids of each word of a block (an Arrow stream of word and ids); made once in a process."""
    folded = pa.ipc.open_stream(block).read_all().combine_chunks()
    if not folded.num_rows:
        return {}
    ids = folded["ids"].combine_chunks()
    places, flat = ids.offsets.to_numpy(), ids.values.to_numpy().astype("<u4").tobytes()
    return {w: flat[4 * a : 4 * b] for w, a, b in zip(folded["word"].to_pylist(), places[:-1].tolist(), places[1:].tolist(), strict=True)}


Tasks = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
_ENCODED = "doc_id bigint, n_tokens bigint, tokens array<int>, ids binary"


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, dictionary: int = DICTIONARY) -> DataFrame:
    """doc_id, n_tokens, tokens (ids as an array) and ids (little-endian unsigned 32-bit integers) of every whole text of docs.

    Null and empty texts have no tokens. Null or repeated ids and repeated rows: a row out for each row in. An empty
    table gives no rows; further columns don't matter.
    """
    return _rows(docs).mapInArrow(_encoder(docs, ranks, pattern, dictionary), _ENCODED)


def encode_and_decode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, dictionary: int = DICTIONARY) -> DataFrame:
    """doc_id, n_tokens, ids and decoded, as decode gives them of what encode gives, in one Python process for each task.

    One after the other they keep two processes busy for each task, and these stay with their memory for later stages.
    """
    coded, decoded = _encoder(docs, ranks, pattern, dictionary), _decoder(docs, ranks, 2)

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in decoded(coded(batches)):
            yield batch.select(["doc_id", "n_tokens", "ids", "decoded"])

    return _rows(docs).mapInArrow(tasks, "doc_id bigint, n_tokens bigint, ids binary, decoded binary")


def _encoder(docs: DataFrame, ranks: dict[bytes, int], pattern: str, dictionary: int) -> Tasks:
    """What encode does in tasks, by the words of docs."""
    counts = written(count_words(docs, pattern), "words")  # read twice: for the cut and for the words above it
    folded = fold_merges(frequent(counts, dictionary), ranks).toArrow()
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, folded.schema) as stream:
        stream.write_table(folded.combine_chunks())
    # as one block of bytes: the driver holds no object for each word
    shared = docs.sparkSession.sparkContext.broadcast((sink.getvalue().to_pybytes(), Merges(ranks)))
    del folded, sink

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = finder(pattern)
        block, merges = shared.value
        known = _dictionary(block)
        rare: dict[str, bytes] = {}

        def learn(words: set[str]) -> None:
            """The ids of words outside the dictionary come to be known, until forget."""
            short, raw = [], []
            for word in words:
                own = word.encode()
                if own in merges.ranks or len(own) > FOLD_BYTES:
                    rare[word] = _packed(merge_word(own, merges.ranks))
                else:
                    short.append(word)
                    raw.append(own)
            rare.update(zip(short, merges.of(raw), strict=True))

        def forget() -> None:
            if len(rare) > MEMORY:
                rare.clear()
            for word in [w for w in rare if len(w) > FOLD_BYTES]:
                del rare[word]

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                every = [find(text) if text else [] for text in part.column(1).to_pylist()]
                rows = [list(map(known.get, found)) for found in every]
                learn({w for found, row in zip(every, rows, strict=True) if None in row for w, c in zip(found, row, strict=True) if c is None and w not in rare})
                ids = [b"".join([rare[w] if c is None else c for w, c in zip(found, row, strict=True)] if None in row else row) for found, row in zip(every, rows, strict=True)]
                del every, rows
                forget()
                packed = pa.array(ids, pa.binary())
                places = pa.array(np.cumsum([0, *(len(x) // 4 for x in ids)]), pa.int32())
                tokens = pa.ListArray.from_arrays(places, pa.array(np.frombuffer(b"".join(ids), "<i4")))
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array([len(x) // 4 for x in ids], pa.int64()), tokens, packed], ["doc_id", "n_tokens", "tokens", "ids"])

    return tasks


def decode(encoded: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """The columns of encoded and decoded: the bytes of its tokens (an array of ids), one after another. Null tokens: null."""
    tasks = _decoder(encoded, ranks, encoded.columns.index("tokens"))
    return encoded.mapInArrow(tasks, T.StructType([*encoded.schema.fields, T.StructField("decoded", T.BinaryType())]))


def _decoder(rows: DataFrame, ranks: dict[bytes, int], place: int) -> Tasks:
    """What decode does in tasks of the session of rows, with tokens in the column at `place`."""
    by_rank = {rank: token for token, rank in ranks.items()}
    shared = rows.sparkSession.sparkContext.broadcast([by_rank.get(i, b"") for i in range(max(by_rank, default=-1) + 1)])

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pa.array(shared.value, pa.binary())
        for batch in batches:
            tokens = batch.column(place)
            flat = pieces.take(tokens.flatten())  # without those of null rows
            ends = np.cumsum(np.concatenate(([0], np.nan_to_num(tokens.value_lengths().to_numpy(zero_copy_only=False)).astype("i8"))))
            taken = np.frombuffer(flat.buffers()[1], "<i4") if len(flat) else np.zeros(1, "<i4")
            decoded = pa.BinaryArray.from_buffers(pa.binary(), len(batch), [pa.array(tokens.is_valid()).buffers()[1], pa.py_buffer(taken[ends].tobytes()), flat.buffers()[2]])
            yield pa.RecordBatch.from_arrays([*batch.columns, decoded], [*batch.schema.names, "decoded"])

    return tasks
