"""Steps of traces: what came before, whether a trace is whole, fair limits, record lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def previous(steps: DataFrame, trace: str, index: str, action: str, start: str = "<start>") -> DataFrame:
    """Each step with the action before it."""
    return steps.select(trace, index, action, F.lag(action, 1, start).over(Window.partitionBy(trace).orderBy(index)).alias("previous"))


def contiguous(steps: DataFrame, trace: str, index: str) -> DataFrame:
    """Traces, their steps, and whether these are 0, 1, ... without a gap or repeat."""
    sums = steps.groupBy(trace).agg(F.count("*").alias("n_steps"), F.countDistinct(index).alias("n_distinct"), F.min(index).alias("first"), F.max(index).alias("last"))
    whole = (F.col("n_distinct") == F.col("n_steps")) & (F.col("first") == 0) & (F.col("last") == F.col("n_steps") - 1)
    return sums.select(trace, "n_steps", whole.alias("whole"))


def round_robin(rows: DataFrame, group: str, order: str, limit: int) -> DataFrame:
    """The first `limit` rows when groups, in order of name, give one row each in turn."""
    turn = F.row_number().over(Window.partitionBy(group).orderBy(order))
    # only the first `limit` rows of a group can be among them
    few = rows.select(group, order, turn.alias("turn")).filter(F.col("turn") <= limit)
    return few.orderBy("turn", group).limit(limit)


def record_lines(steps: DataFrame, trace: str, index: str, action: str) -> DataFrame:
    """Each step as the lines key=value of a record, and the action read back from them."""
    text = F.concat_ws("\n", F.lit("REASONING_STATE_V1"), F.concat(F.lit("trace="), F.col(trace).cast("string")), F.concat(F.lit("step="), F.col(index).cast("string")), F.concat(F.lit("action="), F.col(action)))
    out = steps.select(trace, index, text.alias("record"))
    fields = F.transform(F.filter(F.split("record", "\n"), lambda x: F.contains(x, F.lit("="))), lambda x: F.struct(F.substring_index(x, "=", 1).alias("k"), F.substring(x, F.length(F.substring_index(x, "=", 1)) + 2, F.length(x)).alias("v")))
    return out.withColumn("parsed_action", F.element_at(F.map_from_entries(fields), "action"))


def vocabulary(rows: DataFrame, head: str, value: str) -> DataFrame:
    """Dense ids from 0 of the distinct values of each head, in order."""
    return rows.select(head, value).distinct().withColumn("id", (F.dense_rank().over(Window.partitionBy(head).orderBy(value)) - 1).cast("bigint"))


def coverage(rows: DataFrame, train: DataFrame, head: str, value: str) -> DataFrame:
    """Rows by what of them training has seen: covered, else the head's value or the head itself missing."""
    seen = train.select(head, value).distinct().withColumn("pair", F.lit(True))
    heads = train.select(head).distinct().withColumn("own", F.lit(True))
    met = rows.join(seen, [head, value], "left").join(heads, head, "left")
    reason = F.when(F.col("pair"), "covered").when(F.col("own"), "unseen_value").otherwise("missing_head")
    return met.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


def backoff(rows: DataFrame, train: DataFrame, levels: list[list[str]], value: str) -> DataFrame:
    """For each distinct key of rows, the number of values at the first level of keys that training has, and the level."""
    keys = rows.select(*levels[0]).distinct()
    out = keys
    for i, level in enumerate(levels):
        sizes = train.groupBy(*level).agg(F.countDistinct(value).alias(f"n{i}"))
        out = out.join(sizes, level, "left") if level else out.crossJoin(sizes)  # one row without keys
    found = F.coalesce(*[F.when(F.col(f"n{i}") > 0, F.lit(i)) for i in range(len(levels))], F.lit(-1))
    return out.select(*levels[0], found.alias("level"), F.coalesce(*[F.when(F.col(f"n{i}") > 0, F.col(f"n{i}")) for i in range(len(levels))], F.lit(0)).alias("n_candidates"))


def transitions(steps: DataFrame, trace: str, index: str, action: str) -> DataFrame:
    """Each step with the action before it, the one after it, and whether it is the trace's last."""
    order = Window.partitionBy(trace).orderBy(index)
    after = F.lead(action).over(order)
    return steps.select(trace, index, action, F.lag(action, 1, "<start>").over(order).alias("previous"), F.coalesce(after, F.lit("<end>")).alias("next"), F.lead(index).over(order).isNull().alias("done"))


def whole_groups(rows: DataFrame, group: str, index: str) -> DataFrame:
    """The rows of groups that have as many rows as their largest index (from 0) says."""
    sizes = rows.groupBy(group).agg(F.count("*").alias("n"), F.max(index).alias("last")).filter("n >= last + 1")
    return rows.join(sizes.select(group), group, "left_semi")


def first_of_each(rows: DataFrame, group: str, order: str, k: int) -> DataFrame:
    """The first k rows of each group; groups are cut to k before any is whole in one task."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(order))).filter(F.col("place") <= k)


def union_first(parts: list[tuple[str, DataFrame]], key: list[str]) -> DataFrame:
    """The union of parts (name, rows) in order, of which the first row of each key stays, with its part's name."""
    every = None
    for i, (name, rows) in enumerate(parts):
        own = rows.withColumns({"part": F.lit(name), "__order": F.lit(i)})
        every = own if every is None else every.unionByName(own, allowMissingColumns=True)
    columns = [c for c in every.columns if c not in (*key, "__order")]
    return every.groupBy(*key).agg(F.min_by(F.struct(*columns), F.struct("__order", *columns)).alias("x")).select(*key, "x.*")


def overwritten(base: DataFrame, more: DataFrame, key: str) -> DataFrame:
    """The rows of more, and those of base whose key it doesn't have."""
    return base.join(more.select(key).distinct(), key, "left_anti").unionByName(more)


def value_masks(rows: DataFrame, key: str, value: str) -> DataFrame:
    """For each key, a 0 or 1 for every value of the vocabulary (in order), as it occurs with the key."""
    values = rows.select(value).distinct().agg(F.sort_array(F.collect_list(value)).alias("vocabulary"))  # a row for each value
    own = rows.groupBy(key).agg(F.collect_set(value).alias("own")).crossJoin(F.broadcast(values))  # one row
    return own.select(key, F.array_join(F.transform("vocabulary", lambda v: F.array_contains("own", v).cast("int").cast("string")), "").alias("mask"))


def candidate_index(rows: DataFrame, keys: dict[str, Column], value: str) -> DataFrame:
    """bucket, its number of distinct values and the least of them; each row feeds the bucket of each of its keys."""
    buckets = F.array(*[F.concat(F.lit(f"{name}:"), F.coalesce(k.cast("string"), F.lit("none"))) for name, k in keys.items()])
    pairs = rows.select(F.explode(buckets).alias("bucket"), value).distinct()
    return pairs.groupBy("bucket").agg(F.count(value).alias("n_values"), F.min(value).alias("least"))


def positional_split(rows: DataFrame, order: str, share: float, bucket: int = 4096) -> DataFrame:
    """Rows in order of an integer key: the first round(n * (1 - share)) are train (one at least, n - 1 at most), the rest val."""
    placed = rows.withColumn("__bucket", F.floor(F.col(order) / bucket))
    totals = placed.groupBy("__bucket").agg(F.count("*").alias("k"))
    before = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("__bucket", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("base"), F.sum("k").over(Window.partitionBy()).alias("n"))
    place = F.col("base") + F.row_number().over(Window.partitionBy("__bucket").orderBy(order))
    cut = F.greatest(F.lit(1), F.least(F.floor(F.col("n") * (1 - share) + 0.5), F.col("n") - 1))
    return placed.join(bases, "__bucket").withColumn("part", F.when(place <= cut, "train").otherwise("val")).select(*rows.columns, "part")
