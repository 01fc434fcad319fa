"""Public vocabularies: ids of texts, and the bytes of every token."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable
from functools import lru_cache

import numpy as np

#: What the byte-level pre-tokeniser splits texts by; the same for every file of that kind.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]


def byte_of_letter() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printed ones are themselves, the others go on from 256."""
    rest = [b for b in range(256) if b not in set(_PRINTED)]
    return {chr(b): b for b in _PRINTED} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteVocabulary:
    """A byte-level BPE file (JSON): ids as the tokenizers library gives them, without what it would add.

    Where the file's ids rise with its merges, as in rank files, tiktoken encodes by them, in a third of the time. It gives
    up on very long runs of white space; such texts go to the tokenizers library. special: whether the strings of special
    tokens in a text stand for them, or are plain text.
    """

    def __init__(self, path: str, special: bool):
        with open(path, encoding="utf-8") as file:
            held = json.load(file)
        self._path, self._special, self._slow, self._fast = path, special, None, None
        letters = byte_of_letter()
        vocab, added = held["model"]["vocab"], {t["content"]: t["id"] for t in held["added_tokens"]}
        self.tokens: dict[int, bytes] = {i: bytes(map(letters.__getitem__, token)) for token, i in vocab.items()}
        merges = [m.split(" ") if isinstance(m, str) else m for m in held["model"]["merges"]]
        made = np.array([vocab[a + b] for a, b in merges])
        if (made[1:] > made[:-1]).all() and len(vocab) == len(merges) + 256:
            import tiktoken

            self._fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks={t: i for i, t in self.tokens.items()}, special_tokens=added if special else {})
        self.tokens |= {i: token.encode() for token, i in added.items()}

    def _tokenizer(self):
        if self._slow is None:
            from tokenizers import Tokenizer

            self._slow = Tokenizer.from_file(self._path)
            self._slow.encode_special_tokens = not self._special
        return self._slow

    def ids(self, text: str) -> np.ndarray:
        if self._fast is not None:
            try:
                return self._fast.encode_to_numpy(text, allowed_special="all", disallowed_special=())
            except ValueError:  # its pattern's stack is full
                pass
        return np.array(self._tokenizer().encode(text, add_special_tokens=False).ids, "u4")


class PieceVocabulary:
    """A sentencepiece model, which puts a space before each text itself."""

    def __init__(self, path: str):
        import sentencepiece

        self._model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = {i: self._model.id_to_piece(i) for i in range(self._model.get_piece_size())}
        self.tokens: dict[int, bytes] = {i: bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for i, p in pieces.items()}

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x, "u4") for x in self._model.encode(texts, num_threads=1)]


def table_of(tokens: dict[int, bytes]) -> list[bytes]:
    """Tokens by id; ids that are not in use have no bytes."""
    return [tokens.get(i, b"") for i in range(max(tokens, default=-1) + 1)]


def joined(table: list[bytes], ids: Iterable[int]) -> bytes:
    return b"".join(map(table.__getitem__, ids))


@lru_cache(maxsize=4)
def byte_vocabulary(path: str, special: bool) -> ByteVocabulary:
    """Loaded once in a process, which many tasks share."""
    return ByteVocabulary(path, special)


@lru_cache(maxsize=4)
def piece_vocabulary(path: str) -> PieceVocabulary:
    """Loaded once in a process, which many tasks share."""
    return PieceVocabulary(path)
