"""Folders of documents in several formats: one file for each name, title and text by format."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.sources.pages import page_text

#: Formats by the ends of files' names; where a name comes in several, the first counts.
FORMATS = {"md": "markdown", "markdown": "markdown", "html": "html", "htm": "html", "txt": "plain"}


def discovered(spark: SparkSession, path: str, formats: dict[str, str] | None = None) -> DataFrame:
    """path, name (below the folder, without its end), format and raw text of the files of a folder, each name once."""
    formats = formats or FORMATS
    root = path.rstrip("/").removeprefix("file://").removeprefix("file:")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{" + ",".join(formats) + "}").load(path)
    below = F.substring_index(F.url_decode("path"), f"{root}/", -1)
    end = F.lower(F.substring_index(below, ".", -1))
    rank = F.array_position(F.array(*map(F.lit, formats)), end)
    named = files.select("path", F.regexp_replace(below, r"[.][^./]*$", "").alias("name"), rank.alias("rank"), F.create_map(*[F.lit(x) for e, f in formats.items() for x in (e, f)])[end].alias("format"), F.decode("content", "UTF-8").alias("raw"))
    best = named.groupBy("name").agg(F.min(F.struct("rank", "path")).alias("best"))
    return named.join(best, "name").filter(F.col("path") == F.col("best.path")).select("path", "name", "format", "raw")


def markdown(raw: Column, name: Column) -> tuple[Column, Column]:
    """Title and text of markdown: the title is the first heading of one mark, else the name; the text begins with a heading."""
    body = F.trim(F.regexp_replace(F.coalesce(raw, F.lit("")), r"\r\n?", "\n"))
    found = F.regexp_extract(body, r"(?m)^#[^\S\n]+([^\n]*\S)[^\S\n]*$", 1)
    title = F.when(found != "", found).otherwise(name)
    return title, F.when(F.startswith(body, F.lit("#")), body).otherwise(F.concat(F.lit("# "), title, F.lit("\n\n"), body))


def extracted(files: DataFrame) -> DataFrame:
    """name, format, title and text of discovered files; plain text stays as it is under its name as a title."""
    stem = F.substring_index("name", "/", -1)
    marked = markdown(F.col("raw"), stem)
    plain = F.concat(F.lit("# "), stem, F.lit("\n\n"), F.trim("raw"))
    light = files.filter("format <> 'html'").select("name", "format", F.when(F.col("format") == "markdown", marked[0]).otherwise(stem).alias("title"), F.when(F.col("format") == "markdown", marked[1]).otherwise(plain).alias("text"))

    def pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [page_text(raw or "", name) for name, raw in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(["html"] * len(found), pa.string()), pa.array([t for t, _ in found], pa.string()), pa.array([x for _, x in found], pa.string())], ["name", "format", "title", "text"])

    html = files.filter("format = 'html'").select("name", stem.alias("stem"), "raw").mapInArrow(pages, "name string, format string, title string, text string")
    return light.unionByName(html)
