"""JSON and nested values: canonical text, leaves by path, merging, comparing."""

from __future__ import annotations

import json as parser
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def canonical(text: Column) -> Column:
    """JSON with sorted keys and no blanks; null for what is no JSON."""
    return F.to_json(F.try_parse_json(text))


def action(text: Column) -> Column:
    """A struct of an action's canonical text, its name and its argument; text that is no JSON object is all three."""
    parsed = F.try_parse_json(text)
    name = F.try_variant_get(parsed, "$.name", "string")
    argument = F.to_json(F.try_variant_get(parsed, "$.argument", "variant"))
    good = name.isNotNull()
    return F.struct(*[F.when(good, x).otherwise(text).alias(n) for x, n in ((F.to_json(parsed), "canonical"), (name, "name"), (F.coalesce(argument, F.lit("null")), "argument"))])


def merged(base: Column, more: Column) -> Column:
    """Two maps (string to string) in one; of a key in both, the second's value counts."""
    kept = F.map_filter(base, lambda k, _: ~F.coalesce(F.map_contains_key(more, k), F.lit(False)))
    return F.map_concat(F.coalesce(kept, F.create_map().cast("map<string,string>")), F.coalesce(more, F.create_map().cast("map<string,string>")))


class _Number(str):
    """A number as it is written."""

    __slots__ = ()


def _leaves_of(text: str | None) -> list[tuple[str, str | None]]:
    """(path, value) of the leaves of one JSON text, in order."""
    try:
        top = parser.loads(text or "", parse_int=_Number, parse_float=_Number, parse_constant=_Number)
    except ValueError:
        return [("", text)]
    found, open_ = [], [("", top)]
    while open_:
        path, value = open_.pop()
        inner = value.items() if isinstance(value, dict) else enumerate(value) if isinstance(value, list) else ()
        below = [(f"{path}.{name}" if path else str(name), x) for name, x in inner]
        if below:
            open_.extend(reversed(below))
        else:
            found.append((path, value if value is None or isinstance(value, str) else parser.dumps(value)))
    return found


def leaves(rows: DataFrame, key: str, json: str) -> DataFrame:
    """key, path (names and places from 0, joined by dots) and value (as text) of every leaf of JSON texts, however deep.

    Empty objects and arrays are leaves; strings stay strings, whatever they hold; numbers are as they are written. A text
    that is no JSON, or null, is one leaf without a path. One scan; a text nested deeper than the parser goes (some
    thousand levels) is an error.
    """

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                found = [_leaves_of(x) for x in part.column(1).to_pylist()]
                keys = part.column(0).take(pa.array([i for i, x in enumerate(found) for _ in x], pa.int64()))
                flat = [x for own in found for x in own]
                yield pa.RecordBatch.from_arrays([keys, pa.array([p for p, _ in flat], pa.string()), pa.array([v for _, v in flat], pa.string())], [key, "path", "value"])

    return rows.select(key, F.col(json).cast("string").alias("json")).mapInArrow(tasks, f"`{key}` {rows.schema[key].dataType.simpleString()}, path string, value string")


def match_fraction(one: DataFrame, two: DataFrame, key: str) -> DataFrame:
    """key and the share of the paths of either side whose values are equal on both; a missing path has the value null."""
    pairs = one.withColumnRenamed("value", "a").join(two.withColumnRenamed("value", "b"), [key, "path"], "full")
    return pairs.groupBy(key).agg((F.sum(F.col("a").eqNullSafe(F.col("b")).cast("bigint")) / F.count("*")).alias("fraction"))
