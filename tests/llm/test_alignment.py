"""Cross-tokenizer alignment against a plain version by the libraries themselves."""

import hashlib
from collections import Counter

import sentencepiece
from tokenizers import Tokenizer

from loam.llm import alignment
from loam.llm.queries import BYTE_VOCABULARY, PIECE_MODEL, op11_tokenizer_alignment
from loam.session import table

SMALL = "/root/testdata/sf0.001"
ODD = [None, "", " ", "a▁b", "x  y   z", "don't stop\n\n\t12345", "<|endoftext|> <s>", "\u0000é日本語🙂", "<0x41>A", " " * 60_000, "Ⅷ ﬁ é", "\r\nx"]


def letters():
    printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names, extra = {}, 0
    for b in range(256):
        names[chr(b) if b in printed else chr(256 + extra)] = b
        extra += b not in printed
    return names


def tokens_of(text, a, b, table):
    """(id, bytes) of both kinds, or none."""
    if not text:
        return [], []
    one = [(i, bytes(table[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    two = []
    for i in b.encode(text):
        p = b.id_to_piece(i)
        two.append((i, bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode()))
    raw = (" " + text).encode()
    return (one, two) if b"".join(t for _, t in one) == raw == b"".join(t for _, t in two) else ([], [])


def plain(docs):
    a, b, table = Tokenizer.from_file(BYTE_VOCABULARY), sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL), letters()
    a.encode_special_tokens = True
    found, counts = {}, Counter()
    for doc, text in docs:
        one, two = tokens_of(text, a, b, table)
        ends = []
        for tokens in (one, two):
            at, own = 0, {}
            for i, t in tokens:
                at += len(t)
                own[at] = i
            ends.append(own)
        cuts = sorted(set(ends[0]) & set(ends[1]))
        groups, before = [], 0
        for c in cuts:
            groups.append("|".join(",".join(str(i) for e, i in sorted(own.items()) if before < e <= c) for own in ends) if len(cuts) < 300 else None)
            before = c
        links = [(ends[0][c], ends[1][c]) for c in cuts]
        counts.update(links)
        found[doc] = (len(one), len(two), cuts, groups, links)
    best = Counter()
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    out = {}
    for doc, (n_a, n_b, cuts, groups, links) in found.items():
        text = None if None in groups else ";".join(groups)
        out[doc] = (n_a, n_b, len(cuts), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links)), text
    return out


NUMBERS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def test_whole_table(spark):
    want = plain((r["doc_id"], r["text"]) for r in table(spark, SMALL, "documents").collect())
    rows = op11_tokenizer_alignment(spark, SMALL).collect()
    assert len(rows) == len(want)
    for r in rows:
        numbers, text = want[r["doc_id"]]
        assert tuple(r[c] for c in NUMBERS) == numbers
        if text is not None:
            assert r["groups_sha256"] == (hashlib.sha256(text.encode()).hexdigest() if text else "")


def test_odd_texts(spark):
    docs = [*enumerate(ODD), *((100 + i, t) for i, t in enumerate(ODD)), (None, "a b")]
    df = spark.createDataFrame([(*d, 3) for d in docs], "doc_id bigint, text string, n_a int").repartition(3)
    want = plain(docs)
    rows = alignment.align(df, BYTE_VOCABULARY, PIECE_MODEL).collect()
    assert len(rows) == len(docs)
    for r in rows:
        numbers, text = want[r["doc_id"]]
        assert tuple(r[c] for c in NUMBERS) == numbers
        assert text is None or r["groups"] == text
    assert any(want[i][0][0] == 0 for i, t in enumerate(ODD) if t)
    assert alignment.align(df.limit(0), BYTE_VOCABULARY, PIECE_MODEL).collect() == []


def test_linkable_pairs_by_suffixes():
    a, b = [b"a", b"ba", b"xx", b""], [b"a", b"cba", b"x", b"a", b""]
    want = sorted(i * len(b) + j for i, x in enumerate(a) for j, y in enumerate(b) if x and y and (x.endswith(y) or y.endswith(x)))
    assert alignment.linkable(a, b).tolist() == want
