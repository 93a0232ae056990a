"""Joins of points and intervals by cells of grids: equi-joins alone, no nested loop.

An interval belongs to the grid whose cells are the least power of four as wide as it is long, so it covers two cells
or three at most. A point is looked up in one cell of each grid that any interval uses. Both sides of a cell then meet
by equality, and the exact bounds decide.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Widths below it are taken as it; grids from there on to the widest interval are powers of four.
LEAST_WIDTH = 1.0


def _grid(length: Column) -> Column:
    return F.ceil(F.log(4.0, F.greatest(length.cast("double"), F.lit(LEAST_WIDTH)))).cast("int")


def _cell(x: Column, grid: Column) -> Column:
    return F.floor(x.cast("double") / F.pow(F.lit(4.0), grid)).cast("bigint")


def _same(a: DataFrame, b: DataFrame, pairs: list[tuple[str, str]]) -> Column:
    return reduce(Column.__and__, (a[x].eqNullSafe(b[y]) for x, y in pairs), F.lit(True))


def within(points: DataFrame, intervals: DataFrame, on: list[str], point: str, first: str, last: str, how: str = "inner") -> DataFrame:
    """Points beside the intervals of equal `on` columns that hold them, both ends included.

    how: inner gives the columns of both sides; left_semi and left_anti give the points that any interval holds, or
    none does. `on` may be empty; its columns equal each other as null does null here. A null point or bound holds
    nothing, an interval that ends before it starts neither. Repeated rows are answered each. Other columns of the two
    sides have different names. Bounds are numbers; widths up to 4 ** 40.
    """
    if how != "inner":
        own = points.select(*on, point).distinct()
        held = within(own, intervals, on, point, first, last).select(*(F.col(c).alias(f"_{c}") for c in (*on, point))).distinct()
        return points.join(held, _same(points, held, [(c, f"_{c}") for c in (*on, point)]), how)
    known = intervals.where(F.col(first) <= F.col(last)).withColumn("_grid", _grid(F.col(last) - F.col(first)))
    # A few dozen at most: the logarithm of the longest interval.
    grids = sorted(r[0] for r in known.select("_grid").distinct().collect())
    cells = known.withColumn("_cell", F.explode(F.sequence(_cell(F.col(first), F.col("_grid")), _cell(F.col(last), F.col("_grid")))))
    cells = cells.withColumnsRenamed({c: f"_{c}" for c in on} | {"_grid": "_g", "_cell": "_c"})
    looked = points.where(F.col(point).isNotNull()).withColumn("_grid", F.explode(F.array(*map(F.lit, grids)).cast("array<int>")))
    looked = looked.withColumn("_cell", _cell(F.col(point), F.col("_grid")))
    met = looked.join(cells, _same(looked, cells, [(c, f"_{c}") for c in on]) & (looked["_grid"] == cells["_g"]) & (looked["_cell"] == cells["_c"]) & (F.col(point) >= F.col(first)) & (F.col(point) <= F.col(last)))
    return met.drop("_grid", "_cell", "_g", "_c", *(f"_{c}" for c in on))


def unheld(both: DataFrame, on: list[str], point: str, first: str, last: str) -> DataFrame:
    """Of rows that are points or intervals (the other's columns null), the points that no interval of equal `on` columns holds.

    In the order of places the greatest end of the intervals that have begun says whether one still goes on: one pass,
    without a join. Rows of equal `on` columns meet in one task, so this is for keys of documents; within() is for any.
    """
    begun = Window.partitionBy(*on).orderBy("_at", F.col(point).isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    placed = both.withColumn("_at", F.coalesce(point, first)).withColumn("_until", F.max(F.when(F.col(first) <= F.col(last), F.col(last))).over(begun))
    return placed.where(F.col(point).isNotNull() & ~F.coalesce(F.col("_until") >= F.col(point), F.lit(False))).drop("_at", "_until")


def overlapping(left: DataFrame, right: DataFrame, on: list[str], left_first: str, left_last: str, right_first: str, right_last: str) -> DataFrame:
    """Pairs of intervals of equal `on` columns that share a point, with the columns of both sides; see within().

    Of two such intervals one starts in the other: the left in the right, or the right behind the left's start.
    """
    real = left.where(F.col(left_first) <= F.col(left_last))
    starts = within(real, right, on, left_first, right_first, right_last)
    later = within(right.where(F.col(right_first) <= F.col(right_last)), real, on, right_first, left_first, left_last).where(F.col(right_first) > F.col(left_first))
    return starts.unionByName(later.select(*starts.columns))
