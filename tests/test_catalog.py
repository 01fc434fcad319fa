import glob
import math
import os

import duckdb
import pytest

from loam.plans import benchmarks, catalog, scenes, shapes, structure

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
CATALOG = catalog.CATALOG | shapes.CATALOG | structure.CATALOG | scenes.CATALOG | benchmarks.CATALOG
#: Queries whose rare cases only show on more rows.
MORE = ("focus_tokens", "numeric_fragments", "score_buckets", "path_prefixes", "p95_stats")


@pytest.fixture(scope="module")
def duck():
    found = {}
    for folder in (SMALL, MIDDLE):
        found[folder] = duckdb.connect()
        for path in glob.glob(f"{folder}/*.parquet"):
            found[folder].execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return found


def plain(rows):
    return sorted((tuple(round(float(x), 4) if isinstance(x, float) else None if x is None else str(x).removesuffix("+00:00") for x in r) for r in rows), key=str)


@pytest.mark.parametrize("name,folder", [(n, SMALL) for n, (_, sql) in CATALOG.items() if sql] + [(n, MIDDLE) for n in MORE])
def test_equals_sql(spark, duck, name, folder):
    query, sql = CATALOG[name]
    df = query(spark, folder)
    cursor = duck[folder].execute(sql)
    names = [c[0] for c in cursor.description]
    assert sorted(df.columns) == sorted(names)
    want = [tuple(r[names.index(c)] for c in sorted(names)) for r in cursor.fetchall()]
    found = [tuple(r[c] for c in sorted(names)) for r in df.collect()]
    for f, w in zip(plain(found), plain(want), strict=True):
        assert all(math.isclose(a, b, rel_tol=1e-6, abs_tol=2e-4) if isinstance(a, float) and isinstance(b, float) else a == b for a, b in zip(f, w, strict=True)), (f, w)


def test_html(spark):
    rows = CATALOG["html_extract"][0](spark, SMALL).collect()
    assert rows and all(r["text"].startswith("# ") and "<p>" not in r["text"] for r in rows)
