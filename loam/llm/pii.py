"""Personal data: fixed patterns, and a semi-Markov conditional random field that adds what they miss.

Around every digit or @ lies a region of tokens. The field scores whole candidate spans of a region by features of the
span (its shape, length, checksums, the words beside it), and dynamic programming over spans of bounded length chooses
boundaries and kinds together. Its weights are fitted by gradient steps on regions of a bounded sample whose spans the
patterns, and those of secrets, mark, and on the same regions with made-up entities put in: keys in many contexts,
telephone numbers without a plus, numbers of persons and accounts, long addresses, and what looks like them but is none,
as hashes of commits, dates and versions. What the patterns find always stays; the field's spans are added where they
don't overlap it, if they have LEAST_CHARS characters or more and the field gives them CERTAIN of the probability.
"""

from __future__ import annotations

import heapq
import math
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loam.llm.averaging import BLOCK, train_averaged
from loam.llm.common import checkpoint

KINDS = ("email", "ip", "card", "phone", "secret", "id")
#: Tokens in a span at most; hashed features; documents of the fit's sample, about, and the regions of each that it
#: sees at most, those of least hash over the whole text. Both bound the fit alone; every region of every text is searched.
SPAN_TOKENS, SIZE, SAMPLE, REGIONS, LONGEST = 16, 1 << 12, 20_000, 3, 2000
ROUNDS, EPOCHS, TASKS = 5, 4, 6
#: Share of the sample's regions that are seen once more with something put in.
PLANTED = 0.8
#: Characters that a region reaches beyond its first and last seed, and on to the end of a word.
BEYOND = 72
#: Characters in a span that the field considers, at least.
LEAST_CHARS = 7
#: A fitted span counts from this share of its region's probability on.
CERTAIN = 0.7

_AT = re.compile("@")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SECRET = re.compile(r"(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])|(?:password|token)\s?=\s?\"?([A-Za-z0-9]{8,64})(?![A-Za-z0-9])")
#: Parts of words that stand before entities, or before what only looks like one, by class.
_CUES = {
    "mark": ("pass", "pwd", "token", "key", "secret", "bearer", "auth", "credential", "api"),
    "hash": ("commit", "sha", "md5", "hash", "checksum", "digest", "revision", "rev", "blob", "etag", "uuid", "build", "version", "isbn"),
    "call": ("phone", "tel", "call", "fax", "mobile", "dial"),
    "person": ("ssn", "social", "security", "iban", "account", "passport", "bank"),
    "host": ("host", "ip", "addr", "server", "ping"),
}
_SEED = re.compile("[0-9@]")
_TOKEN = re.compile(r"[^\W_]+|[^\s\w]|_")
Span = tuple[str, int, int]


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    """What the patterns find: leftmost, non-overlapping within a kind, failing matches dropped. In linear time."""
    found: list[Span] = []
    end = 0
    for at in (m.start() for m in _AT.finditer(text)):
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1)
        if start < at and domain:
            end = domain.end()
            found.append(("email", start, end))
    for m in _IP.finditer(text):
        if all(len(part) < 400 and int(part) <= 255 for part in (p.lstrip("0") or "0" for p in m.group().split("."))):
            found.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if 12 <= len(digits := _digits(m.group())) <= 19 and _luhn(digits):
            found.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_digits(m.group())) <= 15:
            found.append(("phone", *m.span()))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def regions(text: str) -> Iterator[tuple[int, int]]:
    """Stretches around seeds (digits and @) in which spans are looked for: disjoint, in order, of whole words.

    Seeds whose stretches would meet share one, so no token, and none of the words beside it, is parted from its seed.
    """
    start = end = -1
    for seed in (m.start() for m in _SEED.finditer(text)):
        if seed >= end:  # else the seed's own token ends in the stretch
            reach = _token_start(text, seed, max(0, end)) - BEYOND
            if reach > 0:
                reach = _token_start(text, reach, max(0, end))
            if reach > end:
                if end >= 0:
                    yield start, end
                start = max(0, reach)
            elif end < 0:
                start = 0
        if seed + BEYOND >= end:
            end = _token_end(text, min(len(text), max(end, seed + BEYOND)))
    if end >= 0:
        yield start, end


def _token_start(text: str, at: int, least: int) -> int:
    """Where the word of letters and digits around a place begins, looked for from `least` on."""
    while at > least and text[at - 1].isalnum() and text[at].isalnum():
        at -= 1
    return at


def _token_end(text: str, at: int) -> int:
    while 0 < at < len(text) and text[at - 1].isalnum() and text[at].isalnum():
        at += 1
    return at


def sampled(text: str) -> list[str]:
    """The regions of a text that the fit sees: those of least hash, from all over the text, of up to LONGEST characters."""
    found = [(zlib.crc32(f"{a}:{text[a:b]}".encode(errors="replace")), a, b) for a, b in regions(text) if b - a <= LONGEST]
    return [text[a:b] for _, a, b in heapq.nsmallest(REGIONS, found)]


def _shape(text: str) -> str:
    out = []
    for c in text:
        k = "9" if "0" <= c <= "9" else "A" if c.isupper() else "a" if c.isalpha() else c
        if not out or out[-1] != k:
            out.append(k)
    return "".join(out)[:24]


def _features(text: str, tokens: list[tuple[int, int]], i: int, j: int) -> tuple[int, ...]:
    """Hashed features of the span of tokens i up to j of a region's text."""
    start, end = tokens[i][0], tokens[j - 1][1]
    words = [text[a:b].lower() for a, b in tokens[max(0, i - 4) : i]]
    before = words[-1] if words else "^"
    two = words[-2] if len(words) > 1 else "^"
    cue = next(filter(None, map(_cue, reversed(words))), "")
    before = _cue(before) or ("word" if before.isalnum() else before[:12])
    return _span_features(text[start:end], text[max(0, start - 1) : start], before, _cue(two) or ("=" if two == "=" else ""), cue, text[end : end + 1] or "$")


@lru_cache(1 << 14)
def _cue(word: str) -> str:
    """The class of a word that tells what may follow."""
    return next((name for name, parts in _CUES.items() if any(p in word if len(p) > 3 else word.startswith(p) for p in parts)), "") if word.isalnum() else ""


@lru_cache(1 << 16)
def _span_features(span: str, left: str, before: str, two: str, cue: str, after: str) -> tuple[int, ...]:
    digits = _digits(span)
    shape, n = _shape(span), len(span)
    plain = span.isalnum()
    lengths = "-".join(str(len(m.group())) for m in _TOKEN.finditer(span) if m.group()[0].isalnum())[:24]
    parts = [
        "bias",
        f"shape {shape if len(shape) < 12 else 'mixed'} {min(n, 48) // 4}",
        f"parts {_shape(span[:1])}{'' if plain else re.sub('[^@.()+= -]', '', span)[:12]} {lengths if not plain else n // 4}",
        f"digits {min(len(digits), 20)} plain {plain}",
        f"luhn {12 <= len(digits) <= 19 and _luhn(digits)} {shape[:3]}",
        f"before {before} {two} {plain}",
        f"cue {cue} {plain} {shape[:3]} {len(digits) * 4 // max(1, n)}",
        f"cue {cue} {lengths if not plain else min(n, 64) // 8}",
        f"edges {_shape(left) or '^'} {_shape(after)} {shape[:2]}",
        f"case {span.isupper()} {span.islower()} {len(digits) * 4 // max(1, n)} {min(n, 48) // 4} {plain}",
    ]
    return tuple(zlib.crc32(p.encode()) % SIZE for p in parts)


def _candidates(text: str, tokens: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last token and features of the spans that may be entities: with digits or @, ending in a word."""
    spans = []
    for i, (a, b) in enumerate(tokens):
        if not (text[a].isalnum() or text[a] in "+("):
            continue
        seeded = False
        for j in range(i + 1, min(len(tokens), i + SPAN_TOKENS) + 1):
            s, e = tokens[j - 1]
            # spans run on across a single space, but not from or to a word of letters
            if j > i + 1 and (gap := s - tokens[j - 2][1]) and (gap > 1 or text[tokens[j - 2][0] : tokens[j - 2][1]].isalpha() or text[s:e].isalpha()):
                break
            seeded = seeded or bool(_SEED.search(text, s, e))
            if seeded and text[s].isalnum() and e - a >= LEAST_CHARS:
                spans.append((i, j, _features(text, tokens, i, j)))
    if not spans:
        return np.zeros(0, "i8"), np.zeros(0, "i8"), np.zeros((0, 10), "i8")
    return np.array([s[0] for s in spans]), np.array([s[1] for s in spans]), np.array([s[2] for s in spans])


def _chart(weights: np.ndarray, text: str):
    """Tokens, candidates, their scores by kind, and the logarithms of the forward and backward sums over tokens."""
    tokens = [m.span() for m in _TOKEN.finditer(text)]
    first, end, features = _candidates(text, tokens)
    scores = weights[:, features].sum(axis=2).T if len(first) else np.zeros((0, len(KINDS)))
    total = np.logaddexp.reduce(scores, axis=1) if len(first) else np.zeros(0)
    n = len(tokens)
    by_end: list[list[int]] = [[] for _ in range(n + 1)]
    by_first: list[list[int]] = [[] for _ in range(n + 1)]
    for s, (i, j) in enumerate(zip(first.tolist(), end.tolist(), strict=True)):
        by_end[j].append(s)
        by_first[i].append(s)
    forward, backward = [0.0] * (n + 1), [0.0] * (n + 1)
    for j in range(1, n + 1):  # a token outside of any span scores nothing
        forward[j] = _log_sum([forward[j - 1], *(forward[first[s]] + total[s] for s in by_end[j])])
    for i in range(n - 1, -1, -1):
        backward[i] = _log_sum([backward[i + 1], *(backward[end[s]] + total[s] for s in by_first[i])])
    return tokens, first, end, features, scores, by_end, np.array(forward), np.array(backward)


def _log_sum(values: list[float]) -> float:
    if len(values) == 1:
        return values[0]
    most = max(values)
    return most + math.log(sum(math.exp(v - most) for v in values))


def decode(weights: np.ndarray, text: str) -> list[Span]:
    """The best segmentation's spans in a region's text, those of which the field is certain."""
    tokens, first, end, _, scores, by_end, forward, backward = _chart(weights, text)
    if not len(first):
        return []
    n, kind = len(tokens), scores.argmax(axis=1)
    best, back = [0.0] * (n + 1), [-1] * (n + 1)
    for j in range(1, n + 1):
        best[j] = best[j - 1]
        for s in by_end[j]:
            if (value := best[first[s]] + scores[s, kind[s]]) > best[j]:
                best[j], back[j] = value, s
    found: list[Span] = []
    j = n
    while j > 0:
        if (s := back[j]) < 0:
            j -= 1
            continue
        sure = forward[first[s]] + scores[s, kind[s]] + backward[end[s]] - forward[n]
        if sure >= math.log(CERTAIN):
            found.append((KINDS[kind[s]], tokens[first[s]][0], tokens[end[s] - 1][1]))
        j = first[s]
    return found[::-1]


def _gold(text: str) -> list[Span]:
    secrets = [("secret", *(m.span(1) if m.group(1) else m.span())) for m in _SECRET.finditer(text)]
    found: list[Span] = []
    for s in sorted([*base_spans(text), *secrets], key=lambda s: (s[1], KINDS.index(s[0]))):
        if not found or s[1] >= found[-1][2]:
            found.append(s)
    return found


def _varied(text: str, rng: np.random.Generator) -> str | None:
    """A region with its first marked secret cut to another length and, half the time, without quotes; None without one."""
    found = next((m for m in _SECRET.finditer(text) if m.group(1)), None)
    if found is None:
        return None
    a, b = found.span(1)
    end = a + int(rng.integers(12, max(13, b - a)))
    if rng.random() < 0.5:
        return text[:a].rstrip('"') + text[a:end] + text[b:].removeprefix('"')
    return text[:a] + text[a:end] + text[b:]


_HEX, _BASE62 = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
#: Kinds with forms: # a digit, and {name} what _made makes. The entity stands between the bars. None: no entity.
_FORMS: dict[str | None, tuple[str, ...]] = {
    "secret": ("api_key: |{key}|", "apikey=|{key}|", 'key = "|{key}|"', "secret: |{key}|", "Authorization: Bearer |{key}|", "pwd=|{key}|", "credentials |{key}|", "|sk_live_{key}|", "auth |gh_{key}|", "token |{key}|", "passphrase: |{hex}|", "secret = '|{hex}|'"),
    "phone": ("call |(###) ###-####|", "tel: |###-###-####|", "phone |0## #### ####|", "|(###) ###-####|", "fax |###.###.####|", "mobile |0### #######|"),
    "id": ("SSN |###-##-####|", "ssn: |###-##-####|", "|###-##-####|", "id number |###-##-####|", "passport |###-##-####|", "IBAN |{cc}## #### #### #### #### ##|", "account |{cc}## #### #### #### #### ####|", "IBAN: |{cc}####################|"),
    "ip": ("from host |{v6}|", "ping |{v6}|", "address |{v6}|", "server |{v6}|"),
    None: ("commit {hex}", "sha256 {hex}{hex}", "md5: {hex}", "checksum {hex}", "revision {hex}", "etag {hex}", "hash of {hex}", "blob {hex}", "in commit {hex}", "version #.#.##", "build ####.##.#", "20##-0#-1#", "pages ###-###", "order ########", "$#,###.##", "1#:##:##", "ISBN 978-#-####-####-#", "room ###", "(19##) ##-##", "No. ###.###", "chapter ##.#.#"),
}


def _made(form: str, rng: np.random.Generator) -> tuple[str, tuple[int, int] | None]:
    """A text of this form, and the entity's place in it, if it has bars."""
    pick = lambda letters, n: "".join(letters[i] for i in rng.integers(0, len(letters), n))

    def part(m: re.Match) -> str:
        name = m.group()
        if name == "#":
            return pick("0123456789", 1)
        if name == "{cc}":
            return pick("ABCDEFGHIKLMNOPRST", 2)
        if name == "{hex}":
            return pick(_HEX, int(rng.choice([7, 8, 12, 32, 40, 40]))) if "|" not in form else pick(_HEX, int(rng.integers(20, 49)))
        if name == "{v6}":
            return ":".join([pick(_HEX, int(rng.integers(2, 5))) for _ in range(int(rng.integers(2, 7)))]) + rng.choice(["::", ":"]) + pick(_HEX, 1) + pick("123456789", 1)
        return pick(rng.choice([_BASE62, _HEX, _BASE62[26:]]), int(rng.integers(14, 49)))

    text = re.sub(r"#|{\w+}", part, form)
    if "|" not in text:
        return text, None
    a, b = text.index("|"), text.rindex("|") - 1
    return text.replace("|", ""), (a, b)


def _planted(text: str, rng: np.random.Generator) -> tuple[str, list[Span]]:
    """A region with a made-up entity, or with what only looks like one, between two of its words, and its spans."""
    kinds = list(_FORMS)
    kind = kinds[int(rng.choice(len(kinds), p=[0.22, 0.12, 0.2, 0.06, 0.4]))]
    made, own = _made(str(rng.choice(_FORMS[kind])), rng)
    gaps = [m.start() for m in re.finditer(" ", text)]
    at = gaps[int(rng.integers(len(gaps)))] + 1 if gaps else 0
    whole = f"{text[:at]}{made} {text[at:]}"
    gold = [s for s in _gold(whole) if s[2] <= at or s[1] >= at + len(made) or own is None and s[0] != "secret"]
    return whole, sorted([*gold, *([(kind, at + own[0], at + own[1])] if own else [])], key=lambda s: s[1])


def fit(docs: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """Weights by kind and feature, fitted on a sample of about `sample` documents. Without regions: all zero."""
    share = min(1.0, sample / max(1, docs.count()))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(0).to_pylist():
                rows += sampled(text or "")
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(rows)], ["region"])

    picked = docs.filter(F.pmod(F.xxhash64("doc_id", F.lit("pii")), F.lit(1 << 30)) < int(share * (1 << 30)))
    examples = checkpoint(picked.select("text").mapInArrow(cut, "region string").repartition(TASKS))

    def local_pass(w: np.ndarray, rows: pa.Table, number: int) -> tuple[np.ndarray, np.ndarray]:
        weights = w.reshape(len(KINDS), SIZE)
        seen = np.full(weights.shape, 1.0)
        rng = np.random.default_rng(number)
        own = rows["region"].to_pylist()
        texts = [(t, _gold(t)) for t in own]
        texts += [(t, _gold(t)) for t in (_varied(text, rng) for text in own for _ in range(2)) if t is not None]
        texts += [_planted(text, rng) for text in own if rng.random() < PLANTED]
        for k in np.concatenate([rng.permutation(len(texts)) for _ in range(EPOCHS)]):
            text, spans = texts[k]
            tokens, first, end, features, scores, _, forward, backward = _chart(weights, text)
            if not len(first):
                continue
            expected = np.exp(np.minimum(0, forward[first][:, None] + scores + backward[end][:, None] - forward[len(tokens)]))
            gold = {(a, b): KINDS.index(kind) for kind, a, b in spans}
            for s, (i, j) in enumerate(zip(first.tolist(), end.tolist(), strict=True)):
                if (kind := gold.get((tokens[i][0], tokens[j - 1][1]))) is not None:
                    expected[s, kind] -= 1
            for kind in range(len(KINDS)):
                g = -(np.bincount(features.ravel(), np.repeat(expected[:, kind], features.shape[1]), SIZE) + 1e-3 * weights[kind] * (seen[kind] > 1))
                at = np.flatnonzero(g)
                seen[kind, at] += g[at] ** 2
                weights[kind, at] += 0.5 * g[at] / np.sqrt(seen[kind, at])
        return weights.ravel(), np.full(-(-weights.size // BLOCK), len(texts))

    start = np.zeros((len(KINDS), SIZE), "f8")
    start[:, zlib.crc32(b"bias") % SIZE] = -2.0  # few spans are entities
    return np.asarray(train_averaged(examples, start.ravel(), local_pass, ROUNDS), "f8").reshape(len(KINDS), SIZE)


def all_spans(weights: np.ndarray, text: str) -> tuple[list[Span], list[Span]]:
    """The patterns' spans, and those with the field's added, in order."""
    base = base_spans(text)
    added = []
    for a, b in regions(text):
        for kind, i, j in decode(weights, text[a:b]):
            if all(a + j <= s or e <= a + i for _, s, e in base):
                added.append((kind, a + i, a + j))
    return base, sorted([*base, *added], key=lambda s: (s[1], KINDS.index(s[0])))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, a, b in spans)


def find(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (of the patterns), n_added (spans of the field), base and spans of every row.

    base and spans are kind:start:end, comma-joined.

    Places are code points, ends exclusive; order is by start, then kind as in KINDS. Null text: empty. Null or repeated
    ids and repeated rows: a row out for each row in. An empty table gives no rows; further columns don't matter.
    """
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [all_spans(shared.value, x or "") for x in batch.column(1).to_pylist()]
            counts = [pa.array([sum(s[0] == kind for s in base) for base, _ in found], pa.int64()) for kind in KINDS[:4]]
            counts.append(pa.array([len(spans) - len(base) for base, spans in found], pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, *(pa.array([joined(x[i]) for x in found], pa.string()) for i in (0, 1))], ["doc_id", *(f"n_{k}" for k in KINDS[:4]), "n_added", "base", "spans"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(tasks, "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, n_added bigint, base string, spans string")


def masked(text: str, spans: list[Span]) -> str:
    """The text with each stretch of overlapping spans replaced by the first one's kind in brackets."""
    out, end = [], 0
    for kind, a, b in spans:
        if a >= end:
            out += [text[end:a], f"[{kind.upper()}]"]
        end = max(end, b)
    return "".join([*out, text[end:]])


def mask(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """The rows of docs, with its columns, with personal data in text masked and n_chars, where there is one, renewed.

    A null text stays null. Null or repeated ids and repeated rows: a row out for each row in. An empty table stays
    empty; further columns come along, whatever their names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x if x is None else masked(x, all_spans(shared.value, x)[1]) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["row", "masked"])

    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row"), "text")
    schema = T.StructType([packed.schema["row"], T.StructField("masked", T.StringType())])
    out = packed.mapInArrow(tasks, schema)
    renewed = {"text": F.col("masked")}
    if "n_chars" in docs.columns:
        renewed["n_chars"] = F.length("masked").cast(docs.schema["n_chars"].dataType)
    return out.select(*[renewed.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
