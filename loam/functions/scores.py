"""Column functions on scores: buckets, clamps, rewards."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bucket(value: Column, edges: list[float], names: list[str]) -> Column:
    """The name of the first edge that the value stays below, else the last name; null for null."""
    found = F.lit(names[-1])
    for edge, name in reversed(list(zip(edges, names, strict=False))):
        found = F.when(value < edge, F.lit(name)).otherwise(found)
    return F.when(value.isNotNull(), found)


# The edges and names of reward buckets.
REWARD_EDGES = [0.25, 0.45, 0.65, 0.82]
REWARD_NAMES = ["lowest", "low", "medium", "high", "highest"]


def reward_bucket(score: Column) -> Column:
    return bucket(score, REWARD_EDGES, REWARD_NAMES)


def quartile_bucket(value: Column, most: Column) -> Column:
    """0 to 3 by the value's quarter of [0, most]; values outside count as the nearest end."""
    return F.when(most <= 0, 0).otherwise(F.least(F.lit(3), F.floor(4 * F.greatest(F.lit(0.0), F.least(value, most)) / most).cast("int")))


def clamped(value: Column, scale: float = 128.0, most: float = 8.0) -> Column:
    return F.greatest(F.lit(-most), F.least(F.lit(most), value / scale))


def reward(weight: Column, local: Column, output: Column, delta: Column) -> Column:
    return weight * (0.5 * local + 0.3 * output + 0.2 * delta)


def capped_sum(terms: list[tuple[float, Column]], most: float = 1.0) -> Column:
    """A weighted sum of terms, null ones as 0, no more than `most`."""
    return F.least(F.lit(most), sum((w * F.coalesce(x.cast("double"), F.lit(0.0)) for w, x in terms), F.lit(0.0)))


def safe_ratio(part: Column, whole: Column) -> Column:
    return part / F.greatest(whole, F.lit(1))
