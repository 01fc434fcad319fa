"""Packing by concatenate and cut against the library's ids, and sequences put together again."""

import struct
import zlib

import pytest
from tokenizers import Tokenizer

from loam.llm import packed
from loam.llm.queries import BYTE_VOCABULARY, op13_packing
from loam.session import table

SMALL = "/root/testdata/sf0.001"
ODD = [None, "", "a<|endoftext|>b", " " * 300_000, "x" * 5000, "\n\u0000é日本"]


def library_ids(text):
    return Tokenizer.from_file(BYTE_VOCABULARY).encode(text or "", add_special_tokens=False).ids + [0]


def check(pieces, by_doc, length):
    """Pieces are a partition of every document's ids and of the sequences' places."""
    own, places = {}, {}
    for r in pieces:
        own.setdefault(r["doc_id"], []).append(r)
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert set(own) == set(by_doc)
    for doc, held in own.items():
        ids, at = by_doc[doc], 0
        for r in sorted(held, key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"]) == (at, len(ids)) and r["length"] > 0
            at += r["length"]
            yield r, ids[r["start"] : at]
        assert at == len(ids)
    fills = []
    for s in places.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        fills.append(at)
    assert max(fills) <= length and sum(f < length for f in fills) <= 1
    assert sorted(places) == list(range(len(places)))


def test_whole_table(spark):
    tokenizer = Tokenizer.from_file(BYTE_VOCABULARY)
    by_doc = {r["doc_id"]: tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [0] for r in table(spark, SMALL, "documents").collect()}
    for r, ids in check(op13_packing(spark, SMALL).collect(), by_doc, 1024):
        assert r["ids_crc32"] == zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))


@pytest.mark.parametrize("length", [1, 7, 1024])
def test_odd_texts_and_sequences(spark, length):
    texts = ODD if length > 7 else [None, "a b", "", "c d e f g h i j k l m"]
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id bigint, text string, start int").repartition(3)
    by_doc = {i: library_ids(t) for i, t in enumerate(texts)}
    pieces = packed.pack(docs, BYTE_VOCABULARY, length).cache()
    rows = pieces.collect()
    for r, ids in check(rows, by_doc, length):
        assert list(struct.unpack(f"<{len(ids)}I", r["ids"])) == ids
    held = packed.sequences(pieces, length).collect()
    assert sum(r["n_ids"] for r in held) == sum(map(len, by_doc.values()))
    by_sequence = {}
    for p in sorted(rows, key=lambda p: p["offset"]):
        by_sequence.setdefault(p["sequence_id"], []).append(p)
    for r in held:
        full = 4 * r["n_ids"] if r["n_ids"] & (r["n_ids"] - 1) == 0 else 4 * length
        assert len(r["ids"]) == full and sum(r["lengths"]) == r["n_ids"]
        own = by_sequence[r["sequence_id"]]
        assert r["doc_ids"] == [p["doc_id"] for p in own]
        assert bytes(r["ids"][: 4 * r["n_ids"]]) == b"".join(p["ids"] for p in own) and not any(r["ids"][4 * r["n_ids"] :])


def test_repeated_and_null_ids_and_no_rows(spark):
    docs = spark.createDataFrame([(5, "x y"), (5, "x y"), (None, "z")], "doc_id bigint, text string")
    rows = packed.pack(docs, BYTE_VOCABULARY, 4).collect()
    assert sum(r["length"] for r in rows) == 2 * len(library_ids("x y")) + len(library_ids("z"))
    assert packed.pack(docs.limit(0), BYTE_VOCABULARY).collect() == []
