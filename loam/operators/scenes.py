"""Grids as scenes: components of equal cells, drawing by painter's order, puzzles told by their hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loam.functions import grids
from loam.functions.folds import once
from loam.operators.graphs import least_labels

#: A cell is row * COLUMNS + column; wider grids are refused.
COLUMNS = 1 << 20


def border_color(grid: Column) -> Column:
    """The colour of all cells on the outer ring; null if they differ, or there are none."""
    sides = F.concat(F.element_at(grid, 1), F.element_at(grid, -1), F.flatten(F.transform(grid, lambda row: F.array(F.element_at(row, 1), F.element_at(row, -1)))))
    return F.when((grids.height(grid) > 0) & (grids.width(grid) > 0), once(F.array_distinct(sides), lambda c: F.when(F.size(c) == 1, F.element_at(c, 1))))


def _runs(grid: Column, background: Column, bordered: Column) -> Column:
    """Runs of equal cells by row: an array for each row of struct<row, first, end, color>, without background and a border."""
    n_rows, n_columns = grids.height(grid), grids.width(grid)

    def of_row(row: Column, r: Column) -> Column:
        free = lambda c: ~(bordered & ((r == 0) | (r == n_rows - 1) | (c == 0) | (c == n_columns - 1)))
        color = lambda c: F.element_at(row, c + 1)
        filled = lambda c: (color(c) != background) & free(c)
        same = lambda c: F.coalesce(F.try_element_at(row, F.greatest(c, F.lit(1))) == color(c), F.lit(False)) & (c > 0) & free(F.greatest(c - 1, F.lit(0)))
        firsts = F.filter(grids.places(F.size(row)), lambda c: filled(c) & ~same(c))
        end = lambda c: F.coalesce(F.array_min(F.filter(grids.places(F.size(row)), lambda x: (x > c) & ~(filled(x) & same(x)))), F.size(row))
        return F.transform(firsts, lambda c: F.struct(r.alias("row"), c.alias("first"), end(c).alias("end"), color(c).alias("color")))

    return F.transform(grid, of_row)


def components(rows: DataFrame, key: str, grid: str, background: Column) -> DataFrame:
    """key, cell (the first, as row * COLUMNS + column), color, n_cells and cells (in order) of the components of each grid.

    Cells of one colour that touch by a side are one component. Cells of the background's colour take no part, nor does the
    outer ring where it has one colour. Runs of a row stand for their cells; runs that touch from row to row are linked, for
    all grids at once. A key is one grid; null and empty grids have none.
    """
    g = F.col(grid)
    too_wide = F.raise_error(F.concat(F.lit("grids have at most "), F.lit(COLUMNS), F.lit(" columns")))
    fitting = F.when(grids.width(g) <= COLUMNS, g).otherwise(too_wide.cast(rows.schema[grid].dataType))
    held = rows.filter(grids.width(g) > 0).select(key, _runs(fitting, background, border_color(g).isNotNull()).alias("runs"))
    node = lambda run: run["row"].cast("bigint") * COLUMNS + run["first"]
    runs = held.select(key, F.explode(F.flatten("runs")).alias("run")).select(key, node(F.col("run")).alias("node"), "run")
    touching = lambda a, b: (a["color"] == b["color"]) & (a["first"] < b["end"]) & (b["first"] < a["end"])
    links = F.flatten(F.transform("runs", lambda above, i: F.flatten(F.transform(above, lambda a: F.transform(F.filter(F.coalesce(F.try_element_at("runs", i + 2), F.filter(above, lambda _: F.lit(False))), lambda b: touching(a, b)), lambda b: F.struct(node(a).alias("node"), node(b).alias("other")))))))
    edges = held.select(key, F.explode(links).alias("e")).select(key, "e.node", "e.other")
    labels = least_labels(runs, edges, key)
    cells = F.flatten(F.sort_array(F.collect_list(F.transform(F.sequence(F.col("run.first"), F.col("run.end") - 1), lambda c: F.col("run.row").cast("bigint") * COLUMNS + c))))
    found = runs.join(labels, [key, "node"]).groupBy(key, F.col("label").alias("cell")).agg(F.first("run.color").alias("color"), F.sum(F.col("run.end") - F.col("run.first")).alias("n_cells"), cells.alias("cells"))
    return found.select(key, "cell", "color", "n_cells", "cells")


def drawn(scenes: DataFrame, objects: DataFrame, scene: str) -> DataFrame:
    """scene and grid of scenes (scene, height, width, background, border, marker) with objects (scene, place, frame, mass, color, cells).

    Later paint covers earlier: background, the border's ring (null: none), objects (frames first, then by mass, then by
    place; cells as struct<row, column>, those outside are passed over), the marker's corner (a row, column and color, or
    null). Every painted cell goes by itself, and the last paint of a cell is found by aggregation, so a scene's objects may
    be many; a scene's cells come together in one row at the end, as its grid must.
    """
    layer = lambda n, mass=F.lit(0.0), place=F.lit(0): F.struct(F.lit(n).alias("layer") if isinstance(n, int) else n.alias("layer"), mass.cast("double").alias("mass"), place.cast("bigint").alias("place"))
    rows = F.sequence(F.lit(0), F.col("height") - 1)
    columns = F.sequence(F.lit(0), F.col("width") - 1)
    sized = scenes.filter("height > 0 AND width > 0")
    every = sized.select(scene, "height", "width", "background", "border", F.explode(rows).alias("row")).select("*", F.explode(columns).alias("column"))
    ring = (F.col("row") == 0) | (F.col("row") == F.col("height") - 1) | (F.col("column") == 0) | (F.col("column") == F.col("width") - 1)
    ground = every.select(scene, "row", "column", F.when(ring & F.col("border").isNotNull(), F.col("border")).otherwise(F.col("background")).alias("color"), layer(0).alias("paint"))
    shapes = objects.select(scene, "color", layer(F.when(F.col("frame"), 1).otherwise(2), F.col("mass"), F.col("place")).alias("paint"), F.explode("cells").alias("c")).select(scene, F.col("c.row").alias("row"), F.col("c.column").alias("column"), "color", "paint")
    inside = shapes.join(sized.select(scene, "height", "width"), scene).filter("row >= 0 AND row < height AND column >= 0 AND column < width").select(*ground.columns)
    marks = sized.filter("marker IS NOT NULL").select(scene, "marker.row", "marker.column", "marker.color", layer(3).alias("paint"))
    painted = ground.unionByName(inside).unionByName(marks).groupBy(scene, "row", "column").agg(F.max_by("color", "paint").alias("color"))
    lines = painted.groupBy(scene, "row").agg(F.transform(F.sort_array(F.collect_list(F.struct("column", "color"))), lambda x: x["color"]).alias("line"))
    return lines.groupBy(scene).agg(F.transform(F.sort_array(F.collect_list(F.struct("row", "line"))), lambda x: x["line"]).alias("grid"))


def digest(grid: Column) -> Column:
    """SHA-256 of a grid: a byte for its height, one for its width, then one for each cell."""
    byte = lambda x: F.lpad(F.hex(x.cast("bigint")), 2, "0")
    cells = F.concat(F.array(grids.height(grid), grids.width(grid)), F.flatten(grid))
    return F.sha2(F.unhex(F.array_join(F.transform(cells, byte), "")), 256)


def puzzle_digests(examples: DataFrame, puzzle: str, given: str, wanted: str) -> DataFrame:
    """puzzle, digest and canonical of puzzles by their examples (a grid given and one wanted), in whatever order these come.

    digest is SHA-256 over the examples' digests in order; canonical is the least digest of the eight symmetries of the
    puzzle, the same turned and mirrored together, so it tells puzzles apart that aren't turns of each other.
    """
    turns = [F.concat_ws("|", digest(a), digest(b)) for a, b in zip(grids.dihedral(F.col(given)), grids.dihedral(F.col(wanted)), strict=True)]
    each = examples.select(puzzle, F.posexplode(F.array(*turns)).alias("turn", "example"))
    whole = each.groupBy(puzzle, "turn").agg(F.sha2(F.array_join(F.sort_array(F.collect_list("example")), "|"), 256).alias("digest"))
    return whole.groupBy(puzzle).agg(F.max(F.when(F.col("turn") == 0, F.col("digest"))).alias("digest"), F.min("digest").alias("canonical"))


def without_turns(digests: DataFrame, puzzle: str, quota: int) -> DataFrame:
    """puzzle, canonical and place of `puzzle_digests`, without puzzles of one digest but the first, and at most `quota` of one canonical form."""
    first = digests.groupBy("canonical", "digest").agg(F.min(puzzle).alias(puzzle))
    # a canonical form has eight digests at most, so its digests are few
    turns = first.groupBy("canonical").agg(F.slice(F.sort_array(F.collect_list(puzzle)), 1, quota).alias("kept"))
    return turns.select("canonical", F.posexplode("kept").alias("place", puzzle))
