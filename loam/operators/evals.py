"""Summaries of evaluation runs: rates, percentiles, probes, cover curves, standard errors, accuracies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Accuracy of the quantiles that values are cut at, around the percentiles that are then picked exactly.
ACCURACY = 10_000


def percentiles(rows: DataFrame, by: str, value: str) -> DataFrame:
    """Mean, nearest-rank and interpolated 95th percentile, median and largest, by group; exact.

    Values are counted. Approximate quantiles a little below and above each percentile cut a group's values in ranges; exact
    counts of the ranges tell in which the wanted ranks lie, and only those ranges' values are put in order: some thousandth
    of a group, however its values lie.
    """
    counts = rows.filter(F.col(value).isNotNull()).groupBy(F.col(by).alias("g"), F.col(value).alias("v")).agg(F.count("*").alias("k"))
    sums = rows.groupBy(F.col(by).alias("g")).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.max(value).alias("most"), F.percentile_approx(value, [p + d / ACCURACY for p in (0.5, 0.95) for d in (-2, 2)], ACCURACY).alias("cuts"))
    groups = sums.select(F.col("g").alias("h"), "n", "cuts")
    ranks = {"rank": F.ceil(0.95 * F.col("n")) - 1, "low": F.floor(0.95 * (F.col("n") - 1)), "high": F.ceil(0.95 * (F.col("n") - 1)), "under": F.floor(0.5 * (F.col("n") - 1)), "over": F.ceil(0.5 * (F.col("n") - 1))}
    placed = counts.join(groups, F.col("g").eqNullSafe(F.col("h"))).withColumn("range", F.size(F.filter("cuts", lambda c: c <= F.col("v"))))
    before = Window.partitionBy("h").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # five rows at most
    ranges = placed.groupBy("h", "range", "n").agg(F.sum("k").alias("inside")).withColumn("base", F.coalesce(F.sum("inside").over(before), F.lit(0)))
    holds = lambda start, size: [(start <= r) & (r < start + size) for r in ranks.values()]
    some = holds(F.col("base"), F.col("inside"))
    wanted = ranges.filter(some[0] | some[1] | some[2] | some[3] | some[4]).select(F.col("h").alias("q"), F.col("range").alias("r"), "base")
    own = placed.join(wanted, F.col("g").eqNullSafe(F.col("q")) & (F.col("range") == F.col("r")))
    start = F.col("base") + F.coalesce(F.sum("k").over(Window.partitionBy("g", "range").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    picked = own.withColumn("start", start).groupBy(F.col("g").alias("p")).agg(*[F.max(F.when(here, F.col("v"))).alias(name) for name, here in zip(ranks, holds(F.col("start"), F.col("k")), strict=True)])
    between = lambda low, high, share: F.col(low) + (F.col(high) - F.col(low)) * (share * (F.col("n") - 1) - F.floor(share * (F.col("n") - 1)))
    return sums.join(picked, F.col("g").eqNullSafe(F.col("p")), "left").select(
        F.col("g").alias(by), "n", F.round("mean", 4).alias("mean"), F.col("rank").alias("p95_rank"), F.round(between("low", "high", 0.95), 6).alias("p95"), F.round(between("under", "over", 0.5), 6).alias("median"), "most"
    )


def standard_errors(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean and population deviation over the root of n, over finite values."""
    x = F.when(~F.isnan(value), F.col(value))
    return rows.groupBy(*by).agg(F.count(x).alias("n"), F.round(F.avg(x), 6).alias("mean"), F.round(F.stddev_pop(x) / F.sqrt(F.count(x)), 6).alias("stderr"))


def cover_curve(rows: DataFrame, by: str) -> DataFrame:
    """Groups by falling size with the running share of rows that the largest ones cover."""
    counts = rows.groupBy(by).agg(F.count("*").alias("n"))
    order = Window.orderBy(F.desc("n"), by)  # a row for each group
    return counts.select(by, "n", F.row_number().over(order).alias("rank"), F.round(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)) / F.sum("n").over(Window.partitionBy()), 6).alias("covered"))


def lookup_probe(rows: DataFrame, feature: str, target: str, train: Column) -> DataFrame:
    """How well the majority target of a feature's value predicts held-out rows, next to the overall majority."""
    counts = rows.filter(train).groupBy(feature, target).agg(F.count("*").alias("n"))
    best = counts.groupBy(feature).agg(F.min_by(target, F.struct(-F.col("n"), F.col(target))).alias("guess"))
    overall = counts.groupBy(target).agg(F.sum("n").alias("n")).agg(F.min_by(target, F.struct(-F.col("n"), F.col(target))).alias("overall"))
    asked = rows.filter(~train).groupBy(feature, target).agg(F.count("*").alias("n")).join(best, feature, "left").join(F.broadcast(overall))  # one row
    right = lambda g: F.sum(F.when(F.col(target) == F.col(g), F.col("n")).otherwise(0)) / F.sum("n")
    return asked.agg(F.sum("n").alias("n"), F.round(right("guess"), 6).alias("accuracy"), F.round(right("overall"), 6).alias("baseline"), F.round(right("guess") - right("overall"), 6).alias("lift"))


def accuracies(rows: DataFrame, group: str, trace: str, correct: Column) -> DataFrame:
    """Share of right steps and of traces that are right throughout, by group."""
    traces = rows.groupBy(group, trace).agg(F.count("*").alias("n"), F.sum(correct.cast("bigint")).alias("right"))
    return traces.groupBy(group).agg(F.count("*").alias("n_traces"), F.round(F.sum("right") / F.sum("n"), 6).alias("step_accuracy"), F.round(F.avg((F.col("right") == F.col("n")).cast("int")), 6).alias("trace_accuracy"))


def until_first_error(rows: DataFrame, trace: str, order: list[str], correct: Column, reward: str) -> DataFrame:
    """Steps before a trace's first error, and the reward up to there."""
    marked = rows.withColumn("ok", correct.cast("int"))
    so_far = F.min("ok").over(Window.partitionBy(trace).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    good = marked.withColumn("good", so_far == 1)
    return good.groupBy(trace).agg(F.sum(F.col("good").cast("bigint")).alias("prefix"), F.round(F.sum(F.when(F.col("good"), F.col(reward)).otherwise(0.0)), 4).alias("reward"))


def ordered_counts(rows: DataFrame, by: str) -> DataFrame:
    """Counts by value, null as unknown: the largest first, then by value."""
    counts = rows.groupBy(F.coalesce(F.col(by).cast("string"), F.lit("unknown")).alias("value")).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "value")


def thresholds(curve: DataFrame, goals: list[float]) -> DataFrame:
    """For each goal, the first rank of a cover curve that covers so much; null if none does."""
    picked = curve.agg(*[F.min(F.when(F.col("covered") >= g, F.col("rank"))).alias(f"r{i}") for i, g in enumerate(goals)])
    return picked.select(F.explode(F.array(*[F.struct(F.lit(float(g)).alias("goal"), F.col(f"r{i}").alias("rank")) for i, g in enumerate(goals)])).alias("x")).select("x.*")


def best_by(rows: DataFrame, group: str, order: list[str], key: str) -> DataFrame:
    """Of each group the row that is least by the order columns (null last), then by key."""
    rank = F.struct(*[x for c in order for x in (F.col(c).isNull(), F.col(c))], F.col(key))
    return rows.groupBy(group).agg(F.min_by(F.struct(key, *order), rank).alias("best")).select(group, "best.*")


def best_probe(rows: DataFrame, features: list[str], target: str, train: Column) -> DataFrame:
    """The feature whose lookup probe is most accurate on held-out rows, the first one on ties, and its lift."""
    probes = [lookup_probe(rows, f, target, train).withColumn("feature", F.lit(f)).withColumn("order", F.lit(i)) for i, f in enumerate(features)]
    every = probes[0]
    for p in probes[1:]:
        every = every.unionByName(p)
    return every.orderBy(F.desc("accuracy"), "order").limit(1).select("feature", "n", "accuracy", "lift")


def compared(rows: DataFrame, side: str, one: str, two: str, metrics: dict[str, tuple[Column, bool]]) -> DataFrame:
    """metric, its value on both sides and the winner; a metric says whether more is better. Equal or missing: tie."""
    sums = rows.filter(F.col(side).isin(one, two)).agg(*[F.round(F.avg(F.when(F.col(side) == s, m)), 6).alias(f"{name}_{i}") for name, (m, _) in metrics.items() for i, s in enumerate((one, two))])
    parts = F.array(*[F.struct(F.lit(name).alias("metric"), F.col(f"{name}_0").alias("a"), F.col(f"{name}_1").alias("b"), F.lit(more).alias("more")) for name, (_, more) in metrics.items()])
    out = sums.select(F.explode(parts).alias("x")).select("x.*")
    ahead = F.when(F.col("more"), F.col("a") > F.col("b")).otherwise(F.col("a") < F.col("b"))
    return out.select("metric", "a", "b", F.when(ahead, one).when(F.col("a") != F.col("b"), two).otherwise("tie").alias("winner"))


def present_mean(rows: DataFrame, by: str, metric: Column) -> DataFrame:
    """The mean of a metric over the rows that have it, and how many these are."""
    return rows.groupBy(by).agg(F.count(metric).alias("n_present"), F.round(F.avg(metric), 6).alias("mean"))
