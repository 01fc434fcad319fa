"""Phrase collocations by suffix automata of bounded depth.

Words become numbers, and the documents of a language that a task holds become shards of them, which are written once:
texts are read and their words numbered one time, whatever the length of phrases. A shard's generalised
suffix automaton, cut at a depth, has as states the classes of phrases that end at the same places. Suffix links lead
from a phrase to that without its first word, so the places that share a phrase of d words split into those of d + 1 by
the word before: refining the places word by word gives states, links and sizes of endpos sets, for all documents at once.

Counts of shards are added up for the whole corpus, one length after another: a phrase is frequent only if both phrases of
one word less in it are, so the automata of the next length hand on only those whose suffix link and prefix may be, by a
bitmap that has all frequent ones. A phrase inside a frequent longer one is told by the same two links.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loam.llm.common import Bits, bits_of, written
from loam.llm.hashing import chunks, mix

LONGEST = 3
LEAST = 10
INSIDE_PERCENT = 50
TOP = 2000
#: Words of a shard, about; it holds whole documents.
SHARD_WORDS = 1 << 19
NO_LANG = "und"
_SEED = 42
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BREAK = b"."
#: A-Z to a-z, tab to space, and what ends a piece to one mark.
_PLAIN = bytes(46 if x in b".,;:!?\n\x0b\x0c\r" else 32 if x == 9 else x + 32 if 65 <= x <= 90 else x for x in range(256))


def pieces_of(text: bytes) -> list[bytes]:
    """The words of a text in order, and _BREAK where a piece ends."""
    return text.translate(_PLAIN).replace(_BREAK, b" . ").split(b" ")


class Numbers(dict):
    """Numbers words as they come; _BREAK and what is empty have 0."""

    def __init__(self):
        super().__init__({b"": -1, _BREAK: 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = found = len(self) - 1
        return found

    def of(self, text: bytes) -> np.ndarray:
        found = np.fromiter(map(self.__getitem__, pieces_of(text)), "i4")
        return np.append(found[found >= 0], np.int32(0))

    def words(self) -> bytes:
        """The words by number, _BREAK first, with spaces between."""
        return b" ".join(list(self)[1:])


def _sorted(key: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """key and places by key, then place. Both are sorted as one number where they fit in one, which takes a fraction of the time."""
    bits = int(places.max(initial=0)).bit_length()
    if int(key.max(initial=0)).bit_length() + bits < 64:
        both = np.sort((key << bits) | places)
        return both >> bits, both & ((1 << bits) - 1)
    order = np.argsort(key, kind="stable")
    return key[order], places[order]


@dataclass
class Automaton:
    """A generalised suffix automaton of word numbers (0 parts pieces), of phrases of up to `depth` words.

    By d - 1, for the phrases of d words: at, the number of the one that ends at each place (-1: none); count, the size of
    their endpos sets; last, a place where they end; link, the number of their suffix of d - 1 words.
    """

    words: np.ndarray
    at: list[np.ndarray]
    count: list[np.ndarray]
    last: list[np.ndarray]
    link: list[np.ndarray]

    @classmethod
    def of(cls, words: np.ndarray, depth: int) -> Automaton:
        self = cls(words, [], [], [], [])
        suffix = np.where(words > 0, 0, -1).astype("i4")  # the class of the empty phrase, whose endpos set is every word
        for d in range(depth):
            before = np.concatenate((np.zeros(d, "i4"), words[: len(words) - d]))
            places = np.flatnonzero((suffix >= 0) & (before > 0))
            key, places = _sorted(suffix[places].astype("i8") * (int(words.max(initial=0)) + 1) + before[places], places)
            first = np.flatnonzero(np.concatenate((np.ones(min(1, len(key)), bool), key[1:] != key[:-1])))
            number = np.full(len(words), -1, "i4")
            number[places] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(key))))
            self.at.append(number)
            self.count.append(np.diff(np.append(first, len(key))))
            self.last.append(places[first])
            self.link.append(suffix[self.last[-1]])
            suffix = number
        return self

    def prefix(self, d: int) -> np.ndarray:
        """For each phrase of d words (2 or more) the number of the one without its last word."""
        return self.at[d - 2][self.last[d - 1] - 1]


def hash_seed(lang: str) -> int:
    """The seed of the hashes of a language's words, by which a word's is that of Spark's xxhash64(lang, word)."""
    return xxhash.xxh64_intdigest(lang.encode(), _SEED)


def _phrases(words: pa.Array, automaton: Automaton, d: int, which: np.ndarray) -> pa.Array:
    """The phrases of d words with these numbers, joined by spaces."""
    last = automaton.last[d - 1][which]
    return pc.binary_join_element_wise(*(words.take(pa.array(automaton.words[last - k])) for k in reversed(range(d))), b" ")


def word_hashes(words: list[bytes], lang: str) -> np.ndarray:
    """A hash of each word of a language."""
    seed = hash_seed(lang)
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), "u8", len(words))


def joined_hashes(parts: Iterable[np.ndarray]) -> np.ndarray:
    """Hashes of phrases by those of their first words, their second ones and so on."""
    return reduce(lambda so_far, own: mix(so_far * _ODD + own), parts)


def _may_be(hashes: np.ndarray, automaton: Automaton, d: int, which: np.ndarray, frequent: Bits) -> np.ndarray:
    """Whether the phrases of d words with these numbers may be frequent, by the hashes of the shard's words."""
    last = automaton.last[d - 1][which]
    return frequent.has(joined_hashes(hashes[automaton.words[last - k]] for k in reversed(range(d))))


def phrase_bits(level: DataFrame) -> Bits:
    """A bitmap of the written phrases (lang, phrase), by joined_hashes."""

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(c.to_pylist() for c in batch.columns), strict=True)
            found = [joined_hashes(word_hashes([w], lang) for w in phrase.split(b" ")) for lang, phrase in rows]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view("i8"))], ["hash"])

    return bits_of(level.select("lang", F.col("phrase").cast("binary")).mapInArrow(tasks, "hash bigint"), level.count())


def shard_phrases(words: list[bytes], numbers: np.ndarray, lang: str, d: int, frequent: list[Bits]) -> tuple[pa.Array, np.ndarray]:
    """Phrases of d words of a shard and their counts, of those whose parts may all be frequent (frequent: by words)."""
    automaton, may = Automaton.of(numbers, d), None
    hashes = word_hashes(words, lang) if d > 1 else None
    for k in range(1, d):
        which = np.arange(len(automaton.count[k - 1])) if may is None else np.flatnonzero(may[automaton.link[k - 1]] & may[automaton.prefix(k)])
        may = np.zeros(len(automaton.count[k - 1]), bool)
        may[which] = _may_be(hashes, automaton, k, which, frequent[k - 1])
    which = np.arange(len(automaton.count[d - 1])) if may is None else np.flatnonzero(may[automaton.link[d - 1]] & may[automaton.prefix(d)])
    return _phrases(pa.array(words, pa.binary()), automaton, d, which), automaton.count[d - 1][which]


def number_shards(docs: DataFrame) -> DataFrame:
    """lang, words (by number) and numbers (32 bits each) of shards of docs (lang, text)."""

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards: dict[str, tuple[Numbers, list[np.ndarray]]] = {}
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, (known, texts) in shards.items():
                row = [lang], [known.words()], [np.concatenate(texts).astype("<i4").tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, (pa.string(), pa.binary(), pa.binary()), strict=True)], ["lang", "words", "numbers"])
            shards.clear()

        for part, texts in chunks(batches, 1):
            for lang, text in zip(part.column(0).to_pylist(), texts, strict=True):
                known, own = shards.setdefault(lang, (Numbers(), []))
                own.append(known.of(text))
                held += len(own[-1])
            if held > SHARD_WORDS:
                yield from flush()
                held = 0
        yield from flush()

    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANG)).alias("lang"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(tasks, "lang string, words binary, numbers binary")


def count_phrases(shards: DataFrame, d: int, frequent: list[Bits]) -> DataFrame:
    """lang, phrase and f of the phrases of d words of shards; with d of 1, also '' for the words of a language in all."""
    shared = shards.sparkSession.sparkContext.broadcast(frequent)

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, words, numbers in zip(*batch.columns, strict=True):
                phrases, counts = shard_phrases(words.as_py().split(b" "), np.frombuffer(numbers.as_buffer(), "<i4"), lang.as_py(), d, shared.value)
                if d == 1 and len(phrases):
                    phrases, counts = pa.concat_arrays([phrases, pa.array([b""], pa.binary())]), np.append(counts, counts.sum())
                for at in range(0, len(phrases), 1 << 16):
                    part = phrases.slice(at, 1 << 16).cast(pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array([lang.as_py()] * len(part)), part, pa.array(counts[at : at + (1 << 16)])], ["lang", "phrase", "n"])

    return shards.mapInArrow(tasks, "lang string, phrase string, n bigint").groupBy("lang", "phrase").agg(F.sum("n").alias("f"))


def _part(first: int, n: int) -> Column:
    """n words of the column phrase, from the first-th on."""
    return F.array_join(F.slice(F.split("phrase", " "), first, n), " ")


def _cuts(phrases: DataFrame, d: int) -> DataFrame:
    """The written phrases (lang, phrase, f) of d words with each way to cut them in two: after k words, into head and tail."""
    ways = F.array(*[F.struct(F.lit(k).alias("k"), _part(1, k).alias("head"), _part(k + 1, d - k).alias("tail")) for k in range(1, d)])
    return phrases.withColumn("way", F.explode(ways)).select("lang", "phrase", F.col("f").alias("a"), "way.*")


def exact_score(a: Column, l: Column, r: Column) -> Column:
    """floor(1000000 * a * a / (l * r)), of numbers of up to 15 digits, in decimals throughout."""
    a, l, r = (x.cast("decimal(15,0)") for x in (a, l, r))
    return F.call_function("div", F.lit(1000000).cast("decimal(7,0)") * (a * a), l * r)


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, inside_percent: int = INSIDE_PERCENT, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of the best collocations of each language of docs (lang, text).

    A phrase is 2 to `longest` words in one piece of a text, in lower case (A-Z), found `least` times or more (a). Cut in
    two, with l and r occurrences of the parts, its score is floor(1000000 * a * a / (l * r)), and its least one counts;
    n is the number of words of the language. Phrases in a longer one with `inside_percent` hundredths of their
    occurrences are left out. The first `top` by score, then a, then phrase stay. Null languages are `und`, null texts
    empty; repeated rows count as often as they come; further columns don't matter. An empty table gives no rows.

    Texts are read once; shards of their words' numbers are written, and read for each length. Every length's frequent
    phrases are written; a bitmap of them goes to the tasks.
    """
    shards = written(number_shards(docs), "phrase-shards")
    levels: list[DataFrame] = []
    bits: list[Bits] = []
    for d in range(1, longest + 1):
        counted = count_phrases(shards, d, bits)
        level = written(counted.filter((F.col("f") >= least) | (F.col("phrase") == "")), f"phrases-{d}")
        levels.append(level.filter("phrase <> ''"))
        if d == 1:
            totals = level.filter("phrase = ''").select("lang", F.col("f").alias("n"))
        if d < longest:
            bits.append(phrase_bits(level))
    counts = levels[0]
    for level in levels[1:-1]:
        counts = counts.unionByName(level)
    scored = _cuts(levels[1], 2)
    for d, level in enumerate(levels[2:], 3):
        scored = scored.unionByName(_cuts(level, d))
    for side, name in (("head", "l"), ("tail", "r")):
        scored = scored.join(counts.select("lang", F.col("phrase").alias(side), F.col("f").alias(name)), ["lang", side])
    lowest = scored.withColumn("score", exact_score(F.col("a"), F.col("l"), F.col("r"))).groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("best"))
    inside = [level.select("lang", F.explode(F.array(_part(1, d - 1), _part(2, d - 1))).alias("phrase"), "f") for d, level in enumerate(levels[2:], 3)]
    kept = lowest
    if inside:
        around = inside[0]
        for more in inside[1:]:
            around = around.unionByName(more)
        around = around.groupBy("lang", "phrase").agg(F.max("f").alias("around"))
        kept = lowest.join(around, ["lang", "phrase"], "left").filter(F.col("around").isNull() | (100 * F.col("around") < inside_percent * F.col("best.a")))
    ranked = kept.select("lang", "phrase", "best.*").withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")))
    return ranked.filter(F.col("rank") <= top).join(totals, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")


ORACLE = r"""
WITH texts AS (
    SELECT row_number() OVER () AS id, coalesce(lang, 'und') AS lang,
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
    FROM documents
),
pieces AS (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM texts),
worded AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM pieces),
grams AS (
    SELECT lang, 1 AS d, unnest(words) AS phrase FROM worded
    UNION ALL
    SELECT lang, 2, unnest([words[i] || ' ' || words[i + 1] for i in range(1, len(words))]) FROM worded
    UNION ALL
    SELECT lang, 3, unnest([words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] for i in range(1, len(words) - 1)]) FROM worded
),
counted AS (SELECT lang, d, phrase, count(*) AS f FROM grams GROUP BY ALL),
cuts AS (
    SELECT lang, d, phrase, f AS a, k, array_to_string(string_split(phrase, ' ')[1:k], ' ') AS head, array_to_string(string_split(phrase, ' ')[k + 1:], ' ') AS tail
    FROM (SELECT *, unnest(range(1, d)) AS k FROM counted WHERE d > 1 AND f >= 10)
),
scored AS (
    SELECT c.lang, c.d, c.phrase, c.a, h.f AS l, t.f AS r, (1000000::HUGEINT * c.a * c.a) // (h.f::HUGEINT * t.f) AS score, k
    FROM cuts c JOIN counted h ON h.lang = c.lang AND h.phrase = c.head AND h.d = c.k JOIN counted t ON t.lang = c.lang AND t.phrase = c.tail AND t.d = c.d - c.k
),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
around AS (
    SELECT lang, phrase, max(f) AS f FROM (
        SELECT lang, f, unnest([array_to_string(string_split(phrase, ' ')[1:2], ' '), array_to_string(string_split(phrase, ' ')[2:3], ' ')]) AS phrase
        FROM counted WHERE d = 3 AND f >= 10)
    GROUP BY ALL
),
ranked AS (
    SELECT lowest.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
    FROM lowest LEFT JOIN around USING (lang, phrase) WHERE d = 3 OR around.f IS NULL OR 100 * around.f < 50 * a
)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM ranked JOIN (SELECT lang, sum(f) AS n FROM counted WHERE d = 1 GROUP BY lang) USING (lang) WHERE rank <= 2000
"""
