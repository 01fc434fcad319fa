"""Chat formatting and mixing: small cases."""

from loam.llm import chat, mixing


def test_snapshots_collapse(spark):
    rows = [(1, 0, "user", "hi"), (2, 0, "user", "hi"), (2, 1, "bot", "yo"), (3, 0, "user", "hi"), (3, 1, "bot", "yo"), (4, 0, "user", None), (5, 0, None, "<|x|>"), (5, 0, None, "<|x|>"), (6, 0, "user", "hi"), (6, 1, "bot", "no")]
    turns = spark.createDataFrame([(*r, 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, part int")
    found = {r["conv_id"]: (r["n_turns"], r["text"]) for r in chat.format_chats(turns).collect()}
    assert found == {
        2: (2, "<|user|>\nhi<|end|>\n<|bot|>\nyo<|end|>\n"),
        4: (1, "<|user|>\n<|end|>\n"),
        5: (1, "<|unknown|>\n<\\|x|><|end|>\n"),
        6: (2, "<|user|>\nhi<|end|>\n<|bot|>\nno<|end|>\n"),
    }
    assert chat.format_chats(turns.limit(0)).collect() == []


def test_long_conversations_go_by_blocks(spark):
    rows = [(c, t, "u", f"m{t}") for c, n in ((1, 40), (2, 39), (3, 17)) for t in range(n)] + [(4, 0, "u", "other")]
    found = chat.format_chats(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"), 8).collect()
    assert sorted((r["conv_id"], r["part"]) for r in found) == [*((1, p) for p in range(5)), (4, 0)]
    assert "".join(r["text"] for r in sorted(found, key=lambda r: r["part"]) if r["conv_id"] == 1).count("<|end|>") == 40


def test_targets_and_budgets(spark):
    rows = [(i, " ".join(["w"] * (i % 7)), "abc"[i % 3] if i % 10 else None, 9) for i in range(400)] + [(None, None, "a", 9), (5, "x y", "tiny", 9), (5, "x y", "tiny", 9)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, size int")
    found = mixing.mix(docs).collect()
    assert len(found) == len(rows)
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in found)
    for target in {(r["source_size"], r["target"]) for r in found}:
        taken = sum(r["taken"] for r in found if (r["source_size"], r["target"]) == target)
        assert taken == int(target[1])
    assert abs(sum(r["taken"] for r in found) - sum(r["size"] for r in found)) <= 5
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    assert sum(len(r["text"].split()) for r in out.collect()) == sum(r["taken"] for r in found)
    assert mixing.mix(docs.limit(0)).collect() == []
    blank = mixing.mix(docs.filter("doc_id IS NULL")).collect()
    assert [(r["size"], r["target"], r["taken"]) for r in blank] == [(0, 0.0, 0)]
