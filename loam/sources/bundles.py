"""Bundles: several tables and their settings, frozen together under one manifest."""

from __future__ import annotations

import json

from pyarrow import fs
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MANIFEST = "manifest.json"


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    files, root = fs.FileSystem.from_uri(path)
    return files, root.rstrip("/")


def export_bundle(tables: dict[str, DataFrame], path: str, settings: dict | None = None, partition_by: dict[str, list[str]] | None = None) -> dict:
    """Writes each table as Parquet into a new folder and then its manifest, which is returned: settings, and rows and schema by table.

    Rows are counted while they are written. A folder without a manifest is no bundle; one that has a manifest is never
    written to. partition_by: columns by table that its files are laid out by.
    """
    files, root = _opened(path)
    if files.get_file_info(f"{root}/{MANIFEST}").type != fs.FileType.NotFound:
        raise FileExistsError(path)
    files.create_dir(root, recursive=True)
    found = {}
    for name, table in tables.items():
        seen = Observation()
        table.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("errorifexists").partitionBy(*(partition_by or {}).get(name, [])).parquet(f"{path.rstrip('/')}/{name}")
        found[name] = {"rows": seen.get["n"], "schema": json.loads(table.schema.json())}
    manifest = {"settings": settings or {}, "tables": found}
    with files.open_output_stream(f"{root}/{MANIFEST}") as stream:
        stream.write(json.dumps(manifest, indent=1, sort_keys=True).encode())
    return manifest


def load_bundle(spark: SparkSession, path: str, check: bool = True) -> tuple[dict, dict[str, DataFrame]]:
    """Settings and tables of a bundle, by its manifest alone: in the columns it states, with `check` also their number of rows."""
    files, root = _opened(path)
    with files.open_input_stream(f"{root}/{MANIFEST}") as stream:
        manifest = json.loads(stream.read())
    tables = {}
    for name, held in manifest["tables"].items():
        schema = T.StructType.fromJson(held["schema"])
        tables[name] = spark.read.schema(schema).parquet(f"{path.rstrip('/')}/{name}").select(*[F.col(f"`{c}`") for c in schema.names])
        if check and (n := tables[name].count()) != held["rows"]:
            raise ValueError(f"{name} has {n} rows, not {held['rows']}")
    return manifest["settings"], tables
