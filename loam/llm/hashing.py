"""Hashes of words and word windows for a batch of texts at once, in numpy.

A word's hash adds up its pieces of eight bytes, each mixed with a salt of its own, so no pattern inside a word (as
those known to defeat power sums) makes two words meet; long words go through xxhash. Windows are hashed by doubling:
that of 2w words mixes those of its two halves. Lanes have salts of their own throughout. Where unlike words must not
meet, the salts come from a secret that the driver draws for a run, as words that meet can be found for known salts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash

CHUNK_BYTES = 1 << 20
#: Pieces of eight bytes in a word that is hashed by pieces.
PIECES = 4
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype="u1")
_LOWER[65:91] += 32
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], "u8")
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit of 64 over all of them."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x



def salts_of(secret: int) -> np.ndarray:
    """A row of salts for each lane: for a word's length and pieces, and for windows by the bits of their width."""
    start = mix(np.array([secret], "u8"))
    return mix(mix(np.arange(1, 129, dtype="u8") * _ODD + start) ^ start).reshape(2, 64) if secret else mix(np.arange(1, 129, dtype="u8") * _ODD).reshape(2, 64)


_SALTS = salts_of(0)


def _word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, lane: int, salts: np.ndarray) -> np.ndarray:
    """Hashes of raw[start:end] for each start and end; raw goes on for eight bytes at least after the last word."""
    sizes = ends - starts
    pieces = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))
    found = mix(sizes.astype("u8") + salts[0])
    own = np.arange(len(starts))
    for k in range(PIECES):
        left = sizes[own] - 8 * k
        found[own] += mix((pieces[starts[own] + 8 * k] & _MASKS[np.minimum(left, 8)]) ^ salts[k + 1])
        own = own[left > 8]
        if not len(own):
            break
    for i in own.tolist():
        found[i] = xxhash.xxh3_64_intdigest(raw[starts[i] : ends[i]].tobytes(), int(salts[40]))
    return mix(found)


@dataclass
class Words:
    """The words of some texts: the words of text i are those from first[i] to first[i + 1]."""

    raw: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    salts: np.ndarray
    lanes: dict[int, np.ndarray] = field(default_factory=dict)

    def hashes(self, lane: int = 0) -> np.ndarray:
        if lane not in self.lanes:
            self.lanes[lane] = _word_hashes(self.raw, self.starts, self.ends, lane, self.salts[lane])
        return self.lanes[lane]

    def windows(self, size: int, lane: int = 0) -> np.ndarray:
        """Hash of the `size` words from each word on, texts' ends not minded; 0 where fewer follow."""
        n = len(self.starts)
        found = np.zeros(n, "u8")
        if n < size:
            return found
        level, width, covered, so_far = self.hashes(lane), 1, 0, None
        while covered < size:
            if size & width:
                part = level[covered:]
                so_far = part if so_far is None else mix(so_far[: len(part)] * _ODD + part + self.salts[lane, 32 + width.bit_length()])
                covered += width
            if covered < size:
                level = mix(level[:-width] * _ODD + level[width:] + self.salts[lane, 8 + width.bit_length()])
                width *= 2
        found[: n - size + 1] = so_far[: n - size + 1]
        return found


def words_of(texts: list[bytes], lower: bool = False, secret: int = 0) -> Words:
    raw = np.frombuffer(b"\n" + b"\n".join(texts) + b"\n" * 9, "u1")
    if lower:
        raw = _LOWER[raw]
    space = _SPACE[raw]
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    starts, ends = edges[::2], edges[1::2]
    offsets = np.cumsum(np.fromiter((len(t) + 1 for t in texts), "i8", len(texts))) + 1
    return Words(raw, starts, ends, np.searchsorted(starts, np.concatenate(([1], offsets))), salts_of(secret) if secret else _SALTS)


def chunks(batches: Iterator[pa.RecordBatch], column: int = 0) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with about CHUNK_BYTES of text (binary, at `column`) each, and their texts; null: empty."""
    for batch in batches:
        texts = [x or b"" for x in batch.column(column).to_pylist()]
        at, size = 0, 0
        for i, text in enumerate(texts):
            if i > at and size + len(text) > CHUNK_BYTES:
                yield batch.slice(at, i - at), texts[at:i]
                at, size = i, 0
            size += len(text)
        if at < len(texts):
            yield batch.slice(at), texts[at:]
