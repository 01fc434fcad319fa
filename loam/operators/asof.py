"""As-of joins: the last row before, by key, and what they say of definitions and uses."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a time range, about, and ranges at most.
RANGE_ROWS, MOST_RANGES = 2_000_000, 4096


def _cuts(times: DataFrame, n: int) -> list:
    """n - 1 times that part the rows in ranges of about the same size."""
    if n < 2:
        return []
    shares = [k / n for k in range(1, n)]
    found = times.agg(F.percentile_approx("__time", shares, 10 * n).alias("cuts")).first()["cuts"]
    return sorted(set(found or []))


def last_before(left: DataFrame, right: DataFrame, keys: list[str], time: str, take: list[str], or_equal: bool = False, ranges: int | None = None) -> DataFrame:
    """Each row of left with the columns `take` of the last row of right before it (or at its time) that has its keys, as last_<column>.

    None: nulls. Of rows of right at one time, that with the greatest `take` counts. Null keys meet nothing; rows of left
    without a time keep nulls.

    Rows of both sides go through one window by key and time. So that a key with many rows isn't one task's, times are cut in
    ranges at quantiles of all rows: a window inside each (key, range) finds what is in the range, and the last row of the
    ranges before comes from a table with one row for each of them. Rows of one key at one time stay together.
    """
    names = [f"last_{c}" for c in take]
    kind = [left.schema[k].dataType for k in keys]
    value = F.struct(*[F.col(c).alias(n) for c, n in zip(take, names, strict=True)])
    columns = left.columns
    ones = left.select(*keys, F.col(time).alias("__time"), F.struct(*[F.col(f"`{c}`") for c in columns]).alias("__left"))
    others = right.select(*[F.col(k).cast(t) for k, t in zip(keys, kind, strict=True)], F.col(time).alias("__time"), value.alias("__right"))
    others = others.filter("__time IS NOT NULL").dropna(subset=keys)
    if ranges is None:
        ranges = min(MOST_RANGES, 1 + (left.count() + right.count()) // RANGE_ROWS)
    cuts = _cuts(others.select("__time").unionByName(ones.select("__time")), ranges)
    number = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col("__time"))) if cuts else F.lit(0)
    both = ones.unionByName(others, allowMissingColumns=True).withColumn("__range", F.when(F.col("__time").isNull(), -1).otherwise(number))
    # at one time, rows of right come after those of left, or before them where equal times count
    side = F.when(F.col("__left").isNull(), 0 if or_equal else 1).otherwise(1 if or_equal else 0)
    order = Window.partitionBy(*keys, "__range").orderBy("__time", side, "__right").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = both.withColumn("__in", F.last("__right", ignorenulls=True).over(order)).filter("__left IS NOT NULL")
    ends = others.withColumn("__range", number).groupBy(*keys, "__range").agg(F.max(F.struct("__time", "__right"))["__right"].alias("__end"))
    marks = seen.select(*keys, "__range").distinct().unionByName(ends, allowMissingColumns=True).groupBy(*keys, "__range").agg(F.max("__end").alias("__end"))
    before = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    carried = marks.withColumn("__carry", F.last("__end", ignorenulls=True).over(before)).select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__range").alias("__r"), "__carry")
    same = F.col("__range") == F.col("__r")
    for i, k in enumerate(keys):
        same = same & (F.col(k) == F.col(f"__k{i}"))
    found = F.when(F.col("__range") >= 0, F.coalesce("__in", "__carry"))
    for k in keys:
        found = F.when(F.col(k).isNotNull(), found)
    return seen.join(carried, same, "left").withColumn("__found", found).select(*[F.col("__left")[c].alias(c) for c in columns], *[F.col("__found")[n].alias(n) for n in names])


def names_in(lines: DataFrame, doc: str, line: str, code: str, keywords: list[str]) -> tuple[DataFrame, DataFrame]:
    """(definitions, uses) as doc, name and line, of code lines: names left of one `=`, and all other names but keywords."""
    text = F.regexp_replace(F.regexp_replace(F.coalesce(code, F.lit("")), r"\"[^\"]*\"|'[^']*'", " "), "#.*|//.*", " ")
    assigned = F.regexp_extract(text, r"^(?:[^=(]|==)*?\b([A-Za-z_]\w*)\s*(?:[-+*/%&|^]|<<|>>)?=(?!=)", 1)
    plain = F.regexp_replace(text, r"^((?:[^=(]|==)*?)\b([A-Za-z_]\w*)(\s*=(?!=))", "$1$3")  # a name only set is not read
    named = lines.select(F.col(doc).alias("doc"), F.col(line).alias("line"), assigned.alias("set"), F.regexp_extract_all(plain, F.lit(r"\b([A-Za-z_]\w*)\b"), F.lit(1)).alias("read"))
    definitions = named.filter("set <> ''").select("doc", F.col("set").alias("name"), "line")
    uses = named.select("doc", F.explode(F.array_distinct("read")).alias("name"), "line").filter(~F.col("name").isin(*keywords))
    return definitions, uses


def def_use_edges(lines: DataFrame, doc: str, line: str, code: str, keywords: list[str]) -> DataFrame:
    """doc, name, source and target: each use of a name with the last earlier line that sets it. Branches are not followed."""
    definitions, uses = names_in(lines, doc, line, code, keywords)
    found = last_before(uses, definitions.withColumn("at", F.col("line")), ["doc", "name"], "line", ["at"])
    return found.filter("last_at IS NOT NULL").select("doc", "name", F.col("last_at").alias("source"), F.col("line").alias("target"))
