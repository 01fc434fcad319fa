"""Bundles of tables: out, in, and what is refused."""

import shutil

import pytest
from pyspark.sql import functions as F

from loam.operators import packing
from loam.session import table
from loam.sources import bundles

SMALL = "/root/testdata/sf0.001"


def test_round_trip(spark, tmp_path):
    path = f"file://{tmp_path}/b"
    docs = table(spark, SMALL, "documents")
    tables = {"documents": docs.select("text", "doc_id", "lang"), "windows": packing.window_tokens(docs.limit(20), 64), "none": docs.limit(0)}
    made = bundles.export_bundle(tables, path, {"seq_len": 64, "names": ["a"]}, {"documents": ["lang"]})
    settings, again = bundles.load_bundle(spark, path)
    assert settings == {"seq_len": 64, "names": ["a"]} and made["tables"]["none"]["rows"] == 0
    for name, df in tables.items():
        assert again[name].columns == df.columns and again[name].count() == made["tables"][name]["rows"]
        if name != "windows":
            assert again[name].exceptAll(df).count() == 0
    with pytest.raises(FileExistsError):
        bundles.export_bundle(tables, path)
    shutil.rmtree(tmp_path / "b/documents/lang=en")
    with pytest.raises(ValueError, match="documents has"):
        bundles.load_bundle(spark, path)
    assert bundles.load_bundle(spark, path, check=False)[1]["documents"].filter(F.col("lang") == "de").count() > 0


def test_no_manifest_no_bundle(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        bundles.load_bundle(spark, f"file://{tmp_path}")
