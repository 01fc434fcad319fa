"""Quality rules: tokeniser fertility, after plain counts of words, symbols and repeats.

Public vocabularies say how a text splits into tokens: characters per token, the share of byte-fallback tokens, and the
entropy of the tokens. Ordinary prose of a language stays inside a band of each; a text outside its language's bands is
rejected. Words are tokenised one by one (neither vocabulary joins across white space), each distinct one once per task.
"""

from __future__ import annotations

import base64
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Distinct words whose tokens a task remembers before it starts afresh.
MEMORY = 300_000


@dataclass(frozen=True)
class Band:
    """What a language's prose keeps to: characters per token of both vocabularies, fallback share, entropy in bits."""

    piece_chars: tuple[float, float] = (1.0, 8.0)
    byte_chars: tuple[float, float] = (1.0, 8.0)
    max_fallback: float = 0.2
    min_entropy: float = 3.0


#: Bands by language; other and unknown languages get the band of the script most letters are of. The lower edges lie
#: below the labelled good documents' figures and above those of texts whose words carry strings of symbols.
LANGUAGE_BANDS = {
    "en": Band(byte_chars=(1.87, 9.0), piece_chars=(1.2, 9.0), max_fallback=0.05),
    "de": Band(byte_chars=(1.90, 9.0), piece_chars=(1.2, 9.0), max_fallback=0.05),
    "fr": Band(byte_chars=(1.70, 9.0), piece_chars=(1.2, 9.0), max_fallback=0.05),
    "es": Band(byte_chars=(1.75, 9.0), piece_chars=(1.2, 9.0), max_fallback=0.05),
}
SCRIPT_BANDS = {"latin": Band((1.2, 9.0), (1.2, 9.0), 0.1, 3.0), "other": Band((0.2, 9.0), (0.2, 9.0), 0.9, 2.5)}


@dataclass(frozen=True)
class Rules:
    piece_model: str
    byte_ranks: str
    pattern: str
    languages: dict[str, Band] = field(default_factory=lambda: dict(LANGUAGE_BANDS))
    scripts: dict[str, Band] = field(default_factory=lambda: dict(SCRIPT_BANDS))


def _script(text: str) -> str:
    letters = [c for c in text if c.isalpha()]
    return "latin" if not letters or 2 * sum(c < "ɐ" for c in letters) >= len(letters) else "other"


def _repeat_words(words: list[bytes]) -> int:
    """Words inside a window of three that occurs twice or more."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    counts = Counter(windows)
    if len(counts) == len(windows):
        return 0
    total, covered = 0, 0
    for at, window in enumerate(windows):
        if counts[window] > 1:
            total += at + 3 - max(covered, at)
            covered = at + 3
    return total


class _Tokens:
    """Tokens of words under both vocabularies, remembered."""

    def __init__(self, rules: Rules) -> None:
        import sentencepiece
        import tiktoken

        with open(rules.byte_ranks, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.bytes = tiktoken.Encoding("ranks", pat_str=rules.pattern, mergeable_ranks=ranks, special_tokens={})
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=rules.piece_model)
        self.fallback = frozenset(i for i in range(self.pieces.vocab_size()) if self.pieces.is_byte(i) or self.pieces.is_unknown(i))
        self.known: dict[bytes, tuple[tuple[int, ...], int, int]] = {}

    def of(self, words: Counter) -> tuple[int, int, int, Counter]:
        """Piece tokens, those that are bytes, byte-level tokens, and the counts of the piece tokens."""
        new = [w for w in words if w not in self.known]
        if new:
            if len(self.known) > MEMORY:
                self.known.clear()
                new = list(words)
            texts = [w.decode("utf-8", "replace") for w in new]
            for w, ids, text in zip(new, self.pieces.encode(texts, num_threads=1), texts, strict=True):
                self.known[w] = tuple(ids), sum(i in self.fallback for i in ids), len(self.bytes.encode_ordinary(" " + text))
        n_pieces = n_fallback = n_bytes = 0
        tokens: Counter = Counter()
        for w, n in words.items():
            ids, fallback, other = self.known[w]
            n_pieces += n * len(ids)
            n_fallback += n * fallback
            n_bytes += n * other
            for i in ids:
                tokens[i] += n
        return n_pieces, n_fallback, n_bytes, tokens


SCHEMA = (
    "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, "
    "piece_chars double, byte_chars double, fallback_share double, token_entropy double, kept boolean"
)


def apply_rules(docs: DataFrame, rules: Rules) -> DataFrame:
    """Counts, fertility figures and verdict of every whole text of docs (doc_id, text, lang), in the columns of SCHEMA.

    Null text: no words, so base_failed; figures of a text without words are null. Null or unknown lang: the band of
    the text's script. Null or repeated ids and repeated rows: a row out for each row in. An empty table gives no
    rows; further columns don't matter. A text of one endless word is one word.
    """

    def row(tokens: _Tokens, doc_id: int | None, raw: bytes | None, lang: str | None) -> tuple:
        raw = raw or b""
        words = raw.split()
        n = len(words)
        chars = len(b"".join(words).decode("utf-8", "replace"))
        symbols = len(raw) - len(raw.translate(None, SYMBOLS))
        lines = [x for x in raw.split(b"\n") if x.split()]
        dup_lines = len(lines) - len(set(lines))
        repeats = _repeat_words(words)
        failed = n < MIN_WORDS or 100 * repeats > MAX_REPEAT_PERCENT * n
        if not n:
            return (doc_id, 0, 0, symbols, dup_lines, 0, True, None, None, None, None, False)
        n_pieces, n_fallback, n_bytes, found = tokens.of(Counter(words))
        entropy = math.log2(n_pieces) - sum(k * math.log2(k) for k in found.values()) / n_pieces
        band = rules.languages.get(lang) or rules.scripts[_script(raw.decode("utf-8", "replace"))]
        figures = chars / n_pieces, chars / n_bytes, n_fallback / n_pieces, entropy
        good = band.piece_chars[0] <= figures[0] <= band.piece_chars[1] and band.byte_chars[0] <= figures[1] <= band.byte_chars[1] and figures[2] <= band.max_fallback and entropy >= band.min_entropy
        return (doc_id, n, chars, symbols, dup_lines, repeats, failed, *figures, not failed and good)

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _Tokens(rules)
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        types = [pa.int64()] * 6 + [pa.bool_()] + [pa.float64()] * 4 + [pa.bool_()]
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                rows = [row(tokens, *x) for x in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("binary"), "lang").mapInArrow(tasks, SCHEMA)
