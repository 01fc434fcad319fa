"""Records in and out, packed rows, manifests, pages, streams, and what is left when the subpackage llm is gone."""

import json
import os
import shutil
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from loam.functions import grids, nested
from loam.functions import text as texts
from loam.operators import corpus, evals, packing
from loam.sources import pages, records
from loam.streaming import events

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_written_documents_come_back(spark, tmp_path):
    rows = [("web", s, f"d{i}", None if i % 2 else "ptraj", s, "x", "text é" * i, 6 * i, 7 * i, "bench" if i % 5 == 0 else "") for i, s in enumerate(["train", "val"] * 10)]
    docs = spark.createDataFrame(rows, records.DOCUMENT).withColumn("holdout_group", F.nullif(F.col("holdout_group"), F.lit("")))
    counters = {r["target"]: (r["n_docs"], r["n_bytes"]) for r in records.write_documents(docs, str(tmp_path / "out")).collect()}
    assert set(counters) == {"train", "val", "holdout-bench"} and sum(n for n, _ in counters.values()) == 20
    again = records.read_documents(spark, str(tmp_path / "out"))
    assert again.select("doc_id", "text", "char_length").exceptAll(docs.select("doc_id", "text", "char_length")).count() == 0
    assert {r["band"] for r in records.typed(again).collect()} == {"pgen", "ptraj"} and "text" not in records.typed(again).columns


def test_malformed_lines_are_errors(spark, tmp_path):
    path = tmp_path / "rows.jsonl"
    path.write_text('{"doc_id": "1", "text": "a"}\n\n{"doc_id": \n')
    with pytest.raises(Exception, match="(?i)malformed|fail"):
        records.read_documents(spark, str(path)).collect()


def test_text_columns_and_choices(spark, tmp_path):
    rows = spark.createDataFrame([(None, "b", 1), ("a", "c", 2)], "content string, document string, n int")
    assert [r["t"] for r in rows.select(records.text_column(rows).alias("t")).collect()] == ["b", "a"]
    assert [r["t"] for r in rows.select(records.text_column(rows, "document").alias("t")).collect()] == ["b", "c"]
    assert [r["t"] for r in rows.select(records.text_column(rows, "content").alias("t")).collect()] == ["b", "a"]
    with pytest.raises(KeyError):
        records.text_column(rows.select("n"))
    (tmp_path / "anatomy_test.csv").write_text('"What, and ""why""?",a, b ,c,d, b\nshort,a,b\nbad,a,b,c,d,E\n')
    (row,) = records.read_choices(spark, str(tmp_path)).collect()
    assert (row["question"], row["choices"], row["answer"], row["subject"]) == ('What, and "why"?', ["a", "b", "c", "d"], "B", "anatomy")


def test_packed_rows_by_hand(spark):
    docs = spark.createDataFrame([(1, "ab"), (2, "c"), (None, None)], "doc_id bigint, text string")
    lines = {}
    for d, t in ((None, None), (1, "ab"), (2, "c")):
        split = docs.filter(F.col("doc_id").eqNullSafe(d)).select(corpus.split_of(F.col("doc_id")).alias("s")).first()["s"]
        lines.setdefault(split, []).extend([*(t or "").encode(), 256])
    for pad in (False, True):
        want = set()
        for split, line in lines.items():
            for k in range(0, len(line), 3):
                part = line[k : k + 3]
                if len(part) == 3 or pad:
                    want.add((split, k // 3, len(part), *part, *[257] * (3 - len(part))))
        assert {(r["split"], r["seq_id"], r["n_tokens"], *r["tokens"]) for r in packing.packed_rows(docs, 2, pad).collect()} == want
    (row, *_) = packing.shifted(packing.packed_rows(docs, 2), 2).collect()
    assert row["inputs"][1:] == row["targets"][:-1]


def test_manifest_problems(spark):
    """A manifest made from what packing says of a table."""
    rows = packing.summary(spark.createDataFrame([(i, "x" * 90) for i in range(400)], "doc_id bigint, text string"), 32).collect()
    own = {"seq_len": 32, "tokenizer": {"kind": "byte", "task": "text"}, "splits": {r["split"]: {"sequence_count": r["n_sequences"]} for r in rows}, "document_manifest_corpus_counts": {"train": {"notes": 300, "notes_long": 60, "letters": 0}}}
    n = own["splits"]["train"]["sequence_count"]
    check = lambda least, *corpora, m=own: records.manifest_problems(m, ("byte", "text"), 32, least, list(corpora))
    assert n > 900 and check(n, "notes", "notes_*") == []
    assert check(n, "notes", "letters") == ["Missing required train corpora: letters"]
    assert check(n + 1, "notes") == [f"Only {n} train sequences, not {n + 1}"]
    assert len(check(1, "notes", m=own | {"seq_len": 64, "tokenizer": {"kind": "byte", "task": "code"}})) == 2
    assert len(check(1, "notes", m={})) == 4


def test_counters_of_one_pass(spark, tmp_path):
    rows = [("web" if i % 3 else "mail", ["train", "val"][i % 2], f"d{i}", None, None, "x", "é" * i, i, 2 * i, {0: "", 1: None, 2: "bench"}[i % 4 % 3]) for i in range(40)]
    docs = spark.createDataFrame(rows, records.DOCUMENT).repartition(3)
    found = records.write_counted(docs, str(tmp_path / "out"), {"corpus": ["web"], "target": ["train", "val"], "band": ["pgen"]})
    target = lambda r: f"holdout-{r[9]}" if r[9] else r[1]
    sums = lambda keep: {"n_docs": len(keep), "n_chars": sum(r[7] for r in keep), "n_bytes": sum(r[8] for r in keep)}
    assert found["all"][""] == sums(rows)
    assert found["corpus"] == {"web": sums([r for r in rows if r[0] == "web"]), "other": sums([r for r in rows if r[0] != "web"])}
    assert found["target"] == {t: sums([r for r in rows if (target(r) if target(r) in ("train", "val") else "other") == t]) for t in ("train", "val", "other")}
    assert found["band"] == {"pgen": sums([]), "other": sums(rows)}
    assert sorted(os.listdir(tmp_path / "out"))[-3:] == ["target=holdout-bench", "target=train", "target=val"]
    assert records.read_documents(spark, str(tmp_path / "out")).count() == 40


def test_metadata_is_read(spark, tmp_path):
    (tmp_path / "rows.jsonl").write_text('{"doc_id": "1", "text": "a", "metadata": {"url": "u", "n": [1, 2]}}\n{"doc_id": "2", "text": "b"}\n')
    rows = records.read_documents(spark, str(tmp_path / "rows.jsonl"))
    found = {r["doc_id"]: (r["u"], r["n"]) for r in rows.select("doc_id", F.try_variant_get("metadata", "$.url", "string").alias("u"), F.try_variant_get("metadata", "$.n[1]", "int").alias("n")).collect()}
    assert found == {"1": ("u", 2), "2": (None, None)}


def test_words_and_numbers_by_rule(spark):
    rows = spark.createDataFrame([("Größe über alles niño, x2 日本語テ 12", "._v1.2_ the A/B 50% the a/b -x- __"), (None, None)], "t string, u string")
    r = rows.select(texts.normalised_tokens(F.col("t")).alias("n"), texts.focus_tokens(F.col("u"), ["the"]).alias("f"), texts.lead_words(F.lit("The don't Don't ab x1_y-z the"), ["the"], 3).alias("l")).collect()
    assert r[0]["n"] == ["größe", "über", "alles", "niño", "日本語テ"] and r[0]["f"] == ["v1.2", "a/b", "50%", "-x-"] and r[0]["l"] == ["don't", "don't", "x1_y-z"]
    assert r[1]["n"] is None and r[1]["f"] is None
    found = spark.range(1).select(F.transform(texts.numeric_fragments(F.lit("-1,200.5 a12 b-5 3x4 +1/2% 7x, 8/0")), lambda x: F.struct(x.alias("x"), texts.fragment_value(x).alias("v"))).alias("n")).first()["n"]
    assert [(x["x"], x["v"]) for x in found] == [("-1200.5", -1200.5), ("2", 2.0), ("5", 5.0), ("3x", 3.0), ("+1/2%", 0.005), ("7x", 7.0), ("8/0", None)]


def test_leaves_of_any_depth(spark):
    deep = "[" * 60 + "1.50" + "]" * 60
    rows = spark.createDataFrame([(1, '{"a": "{\\"b\\": 1}", "t": true, "e": []}'), (2, deep), (3, "[1e400, -0]")], "id bigint, j string")
    found = {(r["id"], r["path"], r["value"]) for r in nested.leaves(rows, "id", "j").collect()}
    assert found == {(1, "a", '{"b": 1}'), (1, "t", "true"), (1, "e", "[]"), (2, ".".join("0" * 60), "1.50"), (3, "0", "1e400"), (3, "1", "-0")}


PAGES = [
    ("<html><head><title> A &amp; B </title><style>p{}</style></head><body><p>one<br>two</p><div>x  &lt;y&gt;</div></body></html>", "A & B"),
    ("<p>no title</p>", "u1"),
    (None, "u2"),
    ("", "u3"),
]


def test_pages(spark):
    rows = spark.createDataFrame([(i, f"u{i}", h) for i, (h, _) in enumerate(PAGES)], "page_id bigint, url string, html string")
    found = {r["page_id"]: r for r in pages.extract(rows).collect()}
    assert [found[i]["title"] for i in range(4)] == [t for _, t in PAGES]
    text = found[0]["text"]
    assert text.startswith("# A & B\n\n") and "one\ntwo" in text and "x <y>" in text
    assert found[1]["text"] == "# u1\n\nno title"


def test_percentiles_of_odd_groups(spark):
    rows = [("a", float(x)) for x in range(1, 21)] + [("b", 3.0)] * 5 + [(None, 1.0), (None, 2.0), ("c", None)]
    found = {r["g"]: r for r in evals.percentiles(spark.createDataFrame(rows, "g string, v double"), "g", "v").collect()}
    assert (found["a"]["p95_rank"], found["a"]["p95"], found["a"]["median"]) == (19.0, 19.05, 10.5)
    assert (found["b"]["p95"], found["b"]["median"], found[None]["median"], found["c"]["n"], found["c"]["p95"]) == (3.0, 3.0, 1.5, 0, None)


def test_percentiles_with_an_outlier(spark):
    values = [i / 20_000 for i in range(20_000)] + [1e12]
    df = spark.createDataFrame([("g", v) for v in values], "g string, v double")
    (r,) = evals.percentiles(df, "g", "v").collect()
    assert (r["p95_rank"], r["median"], r["most"]) == (values[19_000], values[10_000], 1e12)
    # what is put in order is a small part of the group
    cuts = df.agg(F.percentile_approx("v", [p + d / evals.ACCURACY for p in (0.5, 0.95) for d in (-2, 2)], evals.ACCURACY).alias("c")).first()["c"]
    assert max(sum(a <= v < b for v in values) for a, b in ((cuts[0], cuts[1]), (cuts[2], cuts[3]))) < 40


def test_choice_letters_grids_and_json(spark):
    rows = spark.createDataFrame([("1", 4), ("b", 4), ("9", 4), (" D ", 4), (None, 4)], "a string, n int")
    assert [r["x"] for r in rows.select(texts.choice_letter(F.col("a"), 4).alias("x")).collect()] == ["B", "B", None, "D", None]
    grid = spark.createDataFrame([([[1]], [[1, 0]])], "a array<array<int>>, b array<array<int>>")
    r = grid.select(grids.similarity(F.col("a"), F.col("b")).alias("s"), grids.overlap(grids.filled_cells(F.col("a"), F.lit(1)), F.array().cast("array<bigint>")).alias("o"), grids.grid_of_runs(F.array(F.lit("0.1.5.2")), F.lit(1), F.lit(3), F.lit(0)).alias("bad")).first()
    assert (r["s"], r["o"], r["bad"]) == (1.0, 1.0, None)
    odd = spark.createDataFrame([(1, '{"b": {}, "a": [1, {"c": null}]}'), (2, "no json"), (3, None)], "id bigint, j string")
    assert {(x["id"], x["path"], x["value"]) for x in nested.leaves(odd, "id", "j").collect()} == {(1, "b", "{}"), (1, "a.0", "1"), (1, "a.1.c", None), (2, "", "no json"), (3, "", None)}
    assert [x["c"] for x in odd.select(nested.canonical(F.col("j")).alias("c")).collect()] == ['{"a":[1,{"c":null}],"b":{}}', None, None]


def test_streamed_windows_equal_the_batch(spark, tmp_path):
    rows = [(f"2024-01-01 00:{m:02d}:00", "click" if m % 2 else "view", float(m)) for m in range(0, 59, 3)] + [("2024-01-02 12:00:00", "end", 0.0)]
    table = spark.createDataFrame(rows, "t string, event_type string, value double").select(F.to_timestamp("t").alias("ts"), "event_type", "value")
    table.write.parquet(str(tmp_path / "in"))
    stream = events.counts(spark.readStream.schema(table.schema).parquet(str(tmp_path / "in")), "10 minutes")
    query = stream.writeStream.format("memory").queryName("windows").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    want = {tuple(r) for r in events.counts(table, "10 minutes").filter("event_type <> 'end'").collect()}
    assert {tuple(r) for r in spark.table("windows").collect()} == want


def test_the_rest_works_without_the_subpackage(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", ".pytest_cache", "spark-warehouse"))
    assert not (copy / "loam" / "llm").exists()
    program = "import json, __spark_entry__ as e, bench; print(json.dumps([sorted(e.queries()), sorted(e.oracle_sql())]))"
    for pipeline in (True, False):
        if not pipeline:
            (copy / "corpus_pipeline.py").unlink()
        done = subprocess.run([sys.executable, "-c", program], cwd=copy, capture_output=True, text=True, timeout=120, check=True)
        queries, sql = json.loads(done.stdout.strip().splitlines()[-1])
        assert "pack_summary" in queries and "pipeline" not in queries and not any(q.startswith("op1") for q in queries) and set(sql) <= set(queries)
