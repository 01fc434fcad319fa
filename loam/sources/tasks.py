"""Grid tasks from JSON: one row for each grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_GRID = "array<array<int>>"
_PAIR = f"struct<input:{_GRID},output:{_GRID}>"
TASK = f"struct<train:array<{_PAIR}>,test:array<{_PAIR}>>"
SCHEMA = f"task_id string, grid_id string, role string, grid {_GRID}"


def _grids(tasks: DataFrame) -> DataFrame:
    """Rows of SCHEMA from task_id and task."""

    def side(part: str, end: str) -> Column:
        name = lambda i: F.concat_ws(":", F.col("task_id"), F.lit(part), i.cast("string"), F.lit(end))
        pairs = F.coalesce(F.col("task")[part], F.array().cast(f"array<{_PAIR}>"))
        return F.transform(pairs, lambda p, i: F.struct(name(i).alias("grid_id"), F.lit(f"{part}_{end}").alias("role"), p[end].alias("grid")))

    every = F.concat(*[side(part, end) for part in ("train", "test") for end in ("input", "output")])
    return tasks.select("task_id", F.explode(every).alias("g")).select("task_id", "g.*").filter("grid IS NOT NULL")


def read_task_files(spark: SparkSession, path: str) -> DataFrame:
    """The grids of a folder of JSON files, a task in each; its name is the file's path below the folder, without `.json`."""
    root = path.rstrip("/").removeprefix("file://").removeprefix("file:")
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(path)
    name = F.regexp_replace(F.substring_index(F.url_decode(F.input_file_name()), f"{root}/", -1), r"[.]json$", "")
    return _grids(files.select(name.alias("task_id"), F.from_json("value", TASK, {"mode": "FAILFAST"}).alias("task")))


def read_challenges(spark: SparkSession, challenges: str, solutions: str | None = None) -> DataFrame:
    """The grids of one JSON file of tasks by name, with the test outputs of another one if it is given."""
    whole = lambda path, kind: spark.read.option("wholetext", True).text(path).select(F.explode(F.from_json("value", f"map<string,{kind}>", {"mode": "FAILFAST"})).alias("task_id", "task"))
    grids = _grids(whole(challenges, TASK))
    if solutions is None:
        return grids
    answers = whole(solutions, f"array<{_GRID}>").select("task_id", F.posexplode("task").alias("i", "grid"))
    named = answers.select("task_id", F.concat_ws(":", "task_id", F.lit("test"), F.col("i").cast("string"), F.lit("output")).alias("grid_id"), F.lit("test_output").alias("role"), "grid")
    known = whole(challenges, TASK).select("task_id")
    return grids.filter("role <> 'test_output'").unionByName(named.join(known, "task_id", "left_semi"))
