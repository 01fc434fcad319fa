"""Document records: line-delimited JSON and directories of CSV files in, split-routed JSON lines with counters out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DOCUMENT = "corpus string, split string, doc_id string, band string, source_split string, text_sha256 string, text string, char_length bigint, byte_length bigint, holdout_group string"
#: A record as it is read: metadata is an open object.
RECORD = f"{DOCUMENT}, metadata variant"
TEXT_COLUMNS = ("text", "content", "raw_content", "document")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Rows of JSON lines in the schema RECORD; a malformed line is an error, blank lines are passed over."""
    return spark.read.schema(RECORD).option("mode", "FAILFAST").json(path)


def typed(rows: DataFrame) -> DataFrame:
    """Records without their text: no band is pgen, an empty held-out group is none."""
    band = F.coalesce("band", F.lit("pgen"))
    return rows.withColumns({"band": band, "holdout_group": F.nullif(F.col("holdout_group"), F.lit(""))}).drop("text")


def text_column(rows: DataFrame, wanted: str | None = None) -> Column:
    """Each row's text: the column asked for if it has one there, else the first of TEXT_COLUMNS that has; an error if rows have no such column."""
    strings = {f.name for f in rows.schema.fields if isinstance(f.dataType, T.StringType)}
    found = [c for c in ((wanted,) if wanted else ()) + TEXT_COLUMNS if c in strings]
    if not found:
        raise KeyError(f"no text column among {rows.columns}")
    return F.coalesce(*[F.col(f"`{c}`") for c in found])


def read_choices(spark: SparkSession, path: str) -> DataFrame:
    """question, choices, answer and subject (the file's name) of a directory of CSV files without headers, of four choices.

    Cells are trimmed and answers in upper case. Rows with fewer than six cells, or an answer that is none of A to D, go.
    """
    rows = spark.read.schema("question string, a string, b string, c string, d string, answer string").option("multiLine", True).option("escape", '"').csv(path)
    subject = F.regexp_extract(F.input_file_name(), r"([^/]+?)(_dev|_val|_test)?[.]csv$", 1)
    cell = lambda c: F.trim(F.coalesce(c, F.lit("")))
    found = rows.select(cell("question").alias("question"), F.array(*map(cell, "abcd")).alias("choices"), F.upper(F.trim("answer")).alias("answer"), subject.alias("subject"))
    return found.filter(F.col("answer").isin("A", "B", "C", "D"))


def _target() -> Column:
    """holdout- and the group of a record; of those without one (null or empty), the split."""
    group = F.nullif(F.col("holdout_group"), F.lit(""))
    return F.when(group.isNotNull(), F.concat(F.lit("holdout-"), group)).otherwise(F.col("split"))


def write_counted(rows: DataFrame, path: str, known: dict[str, list[str]]) -> dict[str, dict[str, dict[str, int]]]:
    """Writes JSON lines by target, as write_documents does, and counts documents, characters and bytes in the same pass.

    known: values by column whose rows are counted, with `target` as a column, too; all others count as `other`, nulls among
    them, so every column's numbers add up to those of `all`. Counted is what tasks wrote in the attempts that count.
    """
    measures = {"n_docs": F.lit(1).cast("bigint"), "n_chars": F.col("char_length"), "n_bytes": F.col("byte_length")}
    groups = {("all", ""): F.lit(True)}
    for column, values in known.items():
        groups |= {(column, v): F.coalesce(F.col(column) == v, F.lit(False)) for v in values}
        groups[column, "other"] = ~F.coalesce(F.col(column).isin(*values), F.lit(False))
    seen, named = Observation(), {}
    for i, (group, condition) in enumerate(groups.items()):
        named |= {f"{i}_{m}": (group, m, F.sum(F.when(condition, x).otherwise(0))) for m, x in measures.items()}
    observed = rows.withColumn("target", _target()).observe(seen, *[x.alias(name) for name, (_, _, x) in named.items()])
    observed.write.mode("errorifexists").partitionBy("target").json(path)
    found: dict[str, dict[str, dict[str, int]]] = {}
    for name, ((column, value), measure, _) in named.items():
        found.setdefault(column, {}).setdefault(value, {})[measure] = seen.get[name] or 0
    return found


def write_documents(rows: DataFrame, path: str) -> DataFrame:
    """Writes JSON lines by target (a split, or holdout/ and its group) and returns documents, characters and bytes by target.

    The counters are worked out from what was written, so they hold for it.
    """
    rows.withColumn("target", _target()).write.mode("errorifexists").partitionBy("target").json(path)
    again = rows.sparkSession.read.schema(f"{DOCUMENT}, target string").json(path)
    return again.groupBy("target").agg(F.count("*").alias("n_docs"), F.sum("char_length").alias("n_chars"), F.sum("byte_length").alias("n_bytes"))


def manifest_problems(manifest: dict, tokenizer: tuple[str, str], seq_len: int, least_sequences: int, required: list[str]) -> list[str]:
    """What keeps a packed manifest from being used for training; none: it is ready."""
    found = manifest.get("tokenizer", {})
    corpora = manifest.get("document_manifest_corpus_counts", {}).get("train", {})
    missing = [c for c in required if not any(name == c or (c.endswith("*") and name.startswith(c[:-1])) for name, n in corpora.items() if n > 0)]
    sequences = manifest.get("splits", {}).get("train", {}).get("sequence_count", 0)
    checks = [
        ((found.get("kind"), found.get("task")) == tokenizer, f"Tokenizer is {found.get('kind')}/{found.get('task')}, not {'/'.join(tokenizer)}"),
        (manifest.get("seq_len") == seq_len, f"seq_len is {manifest.get('seq_len')}, not {seq_len}"),
        (sequences >= least_sequences, f"Only {sequences} train sequences, not {least_sequences}"),
        (not missing, f"Missing required train corpora: {', '.join(missing)}"),
    ]
    return [message for good, message in checks if not good]
