"""Column functions on grids: arrays of rows (arrays of small integers) of one width, counted from 0 where places show."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def height(grid: Column) -> Column:
    return F.size(grid)


def width(grid: Column) -> Column:
    return F.coalesce(F.size(F.try_element_at(grid, F.lit(1))), F.lit(0))


def cell(grid: Column, row: Column, column: Column) -> Column:
    """The value at a place; null outside the grid."""
    return F.try_element_at(F.try_element_at(grid, (row + 1).cast("int")), (column + 1).cast("int"))


def places(n: Column) -> Column:
    """0, 1, ... up to n, without n."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def transpose(grid: Column) -> Column:
    return F.transform(places(width(grid)), lambda c: F.transform(grid, lambda row: F.element_at(row, c + 1)))


def dihedral(grid: Column) -> list[Column]:
    """The eight symmetries: turned by 0 to 3 quarters counter-clockwise, mirrored left-right and up-down, transposed, and transposed about the other diagonal."""
    mirrored = lambda g: F.transform(g, F.reverse)
    turned = F.reverse(transpose(grid))
    return [grid, turned, F.reverse(mirrored(grid)), mirrored(transpose(grid)), mirrored(grid), F.reverse(grid), transpose(grid), F.reverse(mirrored(transpose(grid)))]


def base36(number: Column) -> Column:
    """A number from 0 in lower-case base 36."""
    return F.lower(F.conv(number.cast("string"), 10, 36))


def grid_text(grid: Column) -> Column:
    """Rows of base-36 digits, joined by slashes."""
    return F.array_join(F.transform(grid, lambda row: F.array_join(F.transform(row, base36), "")), "/")


def fits(grid: Column, side: int = 30) -> Column:
    return (height(grid) <= side) & (width(grid) <= side)


def similarity(one: Column, two: Column) -> Column:
    """Share of equal cells, both grids filled up with zeros to the larger height and width; two empty grids are alike."""
    rows, columns = F.greatest(height(one), height(two)), F.greatest(width(one), width(two))
    equal = F.flatten(F.transform(places(rows), lambda r: F.filter(places(columns), lambda c: F.coalesce(cell(one, r, c), F.lit(0)) == F.coalesce(cell(two, r, c), F.lit(0)))))
    return F.when(rows * columns == 0, 1.0).otherwise(F.size(equal) / (rows * columns))


def color_counts(grid: Column) -> Column:
    """Colours with their counts, the most frequent first, then the smaller colour."""
    cells = F.flatten(grid)
    counts = F.transform(F.array_distinct(cells), lambda c: F.struct((-F.size(F.filter(cells, lambda x: x == c))).alias("less"), c.alias("color")))
    return F.array_sort(counts)


def dominant(grid: Column) -> Column:
    """The most frequent colour, the smallest one on ties."""
    return F.try_element_at(color_counts(grid), F.lit(1))["color"]


def background_candidates(grid: Column, most: int = 4) -> Column:
    """The colour at the top left, then the most frequent ones, each once."""
    return F.array_distinct(F.concat(F.array(cell(grid, F.lit(0), F.lit(0))), F.transform(F.slice(color_counts(grid), 1, most), lambda x: x["color"])))


def histogram(grid: Column, bins: int = 10) -> Column:
    """The share of each colour below `bins`."""
    cells = F.flatten(grid)
    return F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda k: F.size(F.filter(cells, lambda x: x == k)) / F.greatest(F.size(cells), F.lit(1)))


def padded(grid: Column, side: int = 30) -> Column:
    """side * side values: cells + 2, a 1 below each column and to the right of each row, 0 elsewhere."""
    rows, columns = height(grid), width(grid)

    def value(i: Column) -> Column:
        r, c = F.floor(i / side).cast("int"), i % side
        edge = ((r == rows) & (c < columns)) | ((c == columns) & (r < rows))
        return F.coalesce(cell(grid, r, c) + 2, F.when(edge, 1).otherwise(0))

    return F.transform(F.sequence(F.lit(0), F.lit(side * side - 1)), value)


def filled_cells(grid: Column, background: Column) -> Column:
    """Places (row * 2^32 + column) that don't have the background's colour."""
    return F.flatten(F.transform(places(height(grid)), lambda r: F.transform(F.filter(places(width(grid)), lambda c: cell(grid, r, c) != background), lambda c: r.cast("bigint") * (1 << 32) + c)))


def overlap(one: Column, two: Column) -> Column:
    """Intersection over union of two sets of places; 1 if both are empty."""
    union = F.size(F.array_union(one, two))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(one, two)) / union)


def row_runs(grid: Column, background: Column) -> Column:
    """Runs of one colour other than the background, as row.start.length.colour in base 36, in order."""

    def runs(row: Column, r: Column) -> Column:
        starts = F.filter(places(F.size(row)), lambda c: (F.element_at(row, c + 1) != background) & ((c == 0) | (F.element_at(row, c + 1) != F.try_element_at(row, F.when(c > 0, c).otherwise(1)))))

        def run(start: Column) -> Column:
            color = F.element_at(row, start + 1)
            end = F.coalesce(F.array_min(F.filter(places(F.size(row)), lambda c: (c > start) & (F.element_at(row, c + 1) != color))), F.size(row))
            return F.concat_ws(".", base36(r), base36(start), base36(end - start), base36(color))

        return F.transform(starts, run)

    return F.flatten(F.transform(places(height(grid)), lambda r: runs(F.element_at(grid, r + 1), r)))


def grid_of_runs(runs: Column, rows: Column, columns: Column, background: Column) -> Column:
    """The grid of runs; null if one leaves the grid or has other than four fields."""
    number = lambda x, i: F.conv(F.try_element_at(F.split(x, r"\."), F.lit(i)), 36, 10).cast("int")
    parsed = F.transform(runs, lambda x: F.struct(*[number(x, i + 1).alias(n) for i, n in enumerate(("row", "start", "length", "color"))], F.size(F.split(x, r"\.")).alias("fields")))
    valid = F.forall(parsed, lambda x: F.coalesce((x["fields"] == 4) & (x["row"] < rows) & (x["length"] > 0) & (x["start"] + x["length"] <= columns), F.lit(False)))

    def value(r: Column, c: Column) -> Column:
        own = F.filter(parsed, lambda x: (x["row"] == r) & (x["start"] <= c) & (c < x["start"] + x["length"]))
        return F.coalesce(F.try_element_at(own, F.lit(1))["color"], background)

    return F.when(valid, F.transform(places(rows), lambda r: F.transform(places(columns), lambda c: value(r, c))))
