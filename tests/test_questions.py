"""Multiple-choice rows, coverage, joins that must match, grid tasks and folders of documents."""

import json

import pytest
from pyspark.sql import functions as F

from loam.operators import questions
from loam.sources import files, tasks


def test_options_and_labels(spark):
    rows = [(1, ["x", "y", "z"], "b", None, "ok", None), (2, ["x", "y"], "7", 1, "wrong_groundtruth", "A"), (3, ["x"], "A", 0, None, None), (4, None, "A", 0, "ok", None), (5, ["x", "y"], None, 9, "ok", "B"), (6, ["x", None], "0", 5, "wrong_groundtruth", "Q"), (7, ["x", "y"], "A", 0, "no_correct_answer", None), (8, ["x", "y"], "A", 0, "multiple_correct_answers", "B")]
    df = spark.createDataFrame(rows, "id int, options array<string>, answer string, answer_index int, error_type string, correct string")
    found = {r["id"]: (r["letter"], r["reject_reason"]) for r in questions.normal_options(df, "options", "answer", "answer_index").collect()}
    assert found == {1: ("B", None), 2: ("B", None), 3: ("A", "invalid_choice_count"), 4: (None, "invalid_choice_count"), 5: (None, "unresolved_answer"), 6: ("A", None), 7: ("A", None), 8: ("A", None)}
    repaired = lambda mode: {r["id"]: (r["letter"], r["reject_reason"]) for r in questions.repaired_labels(df, "options", "answer", "error_type", "correct", mode).collect() if r["id"] in (1, 2, 3, 5, 6, 7, 8)}
    assert repaired("corrected_single") == {1: ("B", None), 2: (None, "invalid_original_answer"), 3: ("A", "invalid_choice_count"), 5: (None, "invalid_original_answer"), 6: ("A", None), 7: ("A", "unsupported_no_correct_answer"), 8: ("A", "unsupported_multiple_correct_answers")} | {2: ("A", "invalid_original_answer")}
    assert repaired("original")[7] == ("A", None)
    with pytest.raises(ValueError):
        questions.repaired_labels(df, "options", "answer", "error_type", "correct", "other")


def test_features_and_quantities(spark):
    df = spark.createDataFrame([(1, "May 3/4 of 12 rise? Not ____.", ["the 5% share", "none", None]), (2, None, None)], "id int, q string, c array<string>")
    found = [(r["id"], r["quantity"], r["role"], r["exact"], r["value"]) for r in questions.quantities(df, "q", "c").collect()]
    assert sorted(found) == [(1, "q_choice_a_0", "choice_a_numeric", "5%", 0.05), (1, "q_stem_0", "question_numeric", "3/4", 0.75), (1, "q_stem_1", "question_numeric", "12", 12.0)]
    (first, second, _) = df.filter("id = 1").select(questions.choice_features(F.col("c"), ["the"]).alias("f")).first()["f"]
    assert (first["choice"], first["n_words"], first["numbers"], first["focus"], second["choice"]) == ("A", 2, ["5%"], ["share"], "B")
    s = df.filter("id = 1").select(questions.structure(F.col("q"), ["may ", "should "], ["excerpt"], ["history of"]).alias("s")).first()["s"]
    assert (s["question_length"], s["question_token_count"], s["sentence_count"], s["has_fill_blank"], s["has_question_mark"], s["question_starts_with_modal"], s["has_passage_prefix"]) == (29, 4, 2, True, True, True, False)
    label = questions.cascade(F.col("q"), [("never", ["zzz"]), ("rising", ["RISE".lower(), "x"]), ("late", ["not"])], "none")
    assert [r["l"] for r in df.orderBy("id").select(label.alias("l")).collect()] == ["rising", "none"]


def test_coverage(spark):
    rows = [(i, "ab"[i % 2], None if i % 3 else "short") for i in range(12)] + [(12, None, None)]
    found = {(r["dimension"], r["value"]): (r["n_rows"], r["n_kept"], r["samples"]) for r in questions.coverage(spark.createDataFrame(rows, "id int, family string, reason string"), "id", ["family"], "reason", 2).collect()}
    assert found == {("all", ""): (13, 9, [1, 2]), ("family", "a"): (6, 4, [2, 4]), ("family", "b"): (6, 4, [1, 5]), ("family", "null"): (1, 1, [12]), ("reject_reason", "short"): (4, 0, [0, 3])}


def test_joins_that_must_match(spark):
    left = spark.createDataFrame([(1, None, "l1"), (1, "x", "l2")], "a int, b string, v string")
    right = spark.createDataFrame([(1, None, 5), (1, "x", 6), (9, "y", 7)], "a int, b string, w int")
    assert {(r["v"], r["w"]) for r in questions.must_match(left, right, ["a", "b"]).collect()} == {("l1", 5), ("l2", 6)}
    with pytest.raises(Exception, match="no row for"):
        questions.must_match(left, right.filter("w <> 6"), ["a", "b"]).collect()


def test_grid_tasks(spark, tmp_path):
    task = {"train": [{"input": [[1]], "output": [[2, 3]]}], "test": [{"input": [[4], [5]]}]}
    (tmp_path / "t/sub").mkdir(parents=True)
    (tmp_path / "t/a b.json").write_text(json.dumps(task))
    (tmp_path / "t/sub/c.json").write_text(json.dumps({"train": [], "test": []}))
    rows = {(r["grid_id"], r["role"], str(r["grid"])) for r in tasks.read_task_files(spark, str(tmp_path / "t")).collect()}
    assert rows == {("a b:train:0:input", "train_input", "[[1]]"), ("a b:train:0:output", "train_output", "[[2, 3]]"), ("a b:test:0:input", "test_input", "[[4], [5]]")}
    (tmp_path / "c.json").write_text(json.dumps({"k1": task, "k2": task}))
    (tmp_path / "s.json").write_text(json.dumps({"k1": [[[7]], [[8]]], "gone": [[[9]]]}))
    found = tasks.read_challenges(spark, str(tmp_path / "c.json"), str(tmp_path / "s.json"))
    assert found.count() == 8 and {(r["grid_id"], str(r["grid"])) for r in found.filter("role = 'test_output'").collect()} == {("k1:test:0:output", "[[7]]"), ("k1:test:1:output", "[[8]]")}


def test_folders_of_documents(spark, tmp_path):
    for name, text in {"a.md": "intro\r\n# Title one \nx", "a.html": "<title>no</title>", "sub/b.html": "<title>Page</title><p>text</p>", "c d.txt": " plain ", "e.pdf": "x", "f.md": "no heading"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text, newline="")
    found = {r["name"]: (r["format"], r["title"], r["text"]) for r in files.extracted(files.discovered(spark, str(tmp_path))).collect()}
    assert found == {"a": ("markdown", "Title one", "# Title one\n\nintro\n# Title one \nx"), "sub/b": ("html", "Page", "# Page\n\nPage\n\ntext"), "c d": ("plain", "c d", "# c d\n\nplain"), "f": ("markdown", "f", "# f\n\nno heading")}
