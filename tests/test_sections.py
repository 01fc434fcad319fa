"""Sections, chunks and outlines against a plain fold over lines."""

import random
import re

from pyspark.sql import functions as F

from loam.functions.folds import greedy_runs, scan
from loam.operators import sections

HEADING = re.compile(r"^(#{1,3})\s+(.*)$")


def plain_split(paragraph, most):
    if len(paragraph) <= most:
        return [paragraph]
    out, held = [], ""
    for s in filter(None, (x.strip() for x in re.split(r"(?<=[.!?])\s+", paragraph))):
        if held and len(held) + 1 + len(s) <= most:
            held += " " + s
            continue
        out += [held] if held else []
        held = s
        if len(s) > most:
            out += [x for i in range(0, len(s), most) if (x := s[i : i + most].strip())]
            held = ""
    return out + ([held] if held else [])


def plain_chunks(title, text, most):
    out, path, lines = [], [title], []

    def close():
        held = ""
        for p in filter(None, (x.strip() for x in "\n".join(lines).split("\n\n"))):
            for piece in plain_split(p, most):
                if held and len(held) + 2 + len(piece) <= most:
                    held += "\n\n" + piece
                else:
                    out.extend([(" > ".join(path), held)] if held else [])
                    held = piece
        out.extend([(" > ".join(path), held)] if held else [])
        lines.clear()

    for line in (text or "").splitlines():
        if found := HEADING.match(line.strip()):
            close()
            path = [*path[: len(found.group(1))], found.group(2).strip()]
        else:
            lines.append(line)
    close()
    return out


def some_text(rng):
    parts = []
    for _ in range(rng.randint(0, 30)):
        kind = rng.random()
        if kind < 0.25:
            parts.append("  " * rng.randint(0, 1) + "#" * rng.randint(1, 4) + rng.choice([" ", "\t ", ""]) + rng.choice(["Ä title", "two > parts", "x"]) + " ")
        elif kind < 0.5:
            parts.append(rng.choice(["", " ", "\n", "\r"]))
        else:
            parts.append(" ".join(rng.choice(["word.", "ñandú", "no?", "so", "x" * 45, "end!"]) for _ in range(rng.randint(1, 25))))
    return rng.choice(["\n", "\r\n", "\n\n"]).join(parts)


def test_chunks_equal_plain(spark):
    rng = random.Random(2)
    texts = [None, "", "#", "# only", "text", "a" * 100, "# t\n\n\n\nx\n## \n###### six\ny", "x  # y z", *(some_text(rng) for _ in range(150))]
    docs = spark.createDataFrame([(i, f"T{i}", t, "k") for i, t in enumerate(texts)], "id int, title string, text string, body string").drop("body")
    for most in (20, 70):
        found = {}
        for r in sections.chunked(docs, "title", "text", most).orderBy("id", "chunk").collect():
            assert r["chunk"] == len(found.setdefault(r["id"], [])) and 0 < len(r["body"]) <= most
            found[r["id"]].append((r["path"], r["body"]))
        for i, t in enumerate(texts):
            assert found.get(i, []) == plain_chunks(f"T{i}", t, most), t


def test_outlines(spark):
    docs = spark.createDataFrame([(1, "# A\ntext\n### B\n## C"), (2, None), (3, "no # heading")], "id int, text string")
    found = {r["id"]: r["o"] for r in docs.select("id", sections.outline(sections.headings(F.col("text"))).alias("o")).collect()}
    assert found == {1: "- A\n    - B\n  - C", 2: "", 3: ""}
    steps = [(r["place"], r["level"], r["title"], r["before"]) for r in sections.outline_steps(docs, "text").orderBy("place").collect()]
    assert steps == [(1, 3, "B", ["A"]), (2, 2, "C", ["A", "B"])]


def test_envelope(spark):
    made = sections.enveloped("MARK_V1", {"doc": F.lit(3), "none": F.lit(None).cast("string")}, F.lit(" b \n"))
    assert spark.range(1).select(made.alias("x")).first()["x"] == "MARK_V1\ndoc=3\nnone=\n\nb\n"


def test_folds_by_parts(spark):
    rng = random.Random(1)
    rows = [[rng.randint(0, 9) for _ in range(n)] for n in (0, 1, 2, 7, 8, 9, 50)]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, xs array<int>")
    sums = {r["i"]: r["s"] for r in df.select("i", scan(F.col("xs"), F.lit(0), lambda a, x: a + x, "int", 4).alias("s")).collect()}
    assert sums == {i: [sum(r[: k + 1]) for k in range(len(r))] for i, r in enumerate(rows)}
    items = F.transform("xs", lambda x: F.struct(F.repeat(F.lit("a"), x + 1).alias("text"), (x == 9).alias("solo")))
    one, two = ({r["i"]: r["s"] for r in df.select("i", greedy_runs(items, "--", 12, part).alias("s")).collect()} for part in (3, 256))
    assert one == two and all(len(t) <= 12 for ts in one.values() for t in ts)


def test_long_documents_stay_linear_enough(spark):
    text = "# h\n" + "\n\n".join(f"sentence {i} ends here." for i in range(20000))
    found = sections.chunked(spark.createDataFrame([("t", text)], "title string, text string"), "title", "text", 400).collect()
    assert "\n\n".join(r["body"] for r in found) == text[4:]
