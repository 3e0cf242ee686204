"""Places in ordered groups, with no group in one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def placed_in_group(rows: DataFrame, by: list[str], coarse: list[Column], order: list, name: str = "place") -> DataFrame:
    """``name``: 1, 2, .. in each group of ``by``, in ascending order of ``coarse``, then ``order``.

    ``coarse`` cuts a group into cells that can be counted: a cell starts after all rows of
    the cells before it, so only its own rows are sorted together.  A group with
    any share of the rows is spread over as many tasks as it has cells.
    """
    cells = [f"_c{i}" for i in range(len(coarse))]
    r = rows.select("*", *[c.alias(n) for c, n in zip(coarse, cells, strict=True)])
    counts = r.groupBy(*by, *cells).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(W.partitionBy(*by).orderBy(*cells)) - F.col("_n")
    starts = counts.select(*[F.col(c).alias(f"_s{c}") for c in [*by, *cells]], before.alias("_before"))
    local = r.withColumn("_i", F.row_number().over(W.partitionBy(*by, *cells).orderBy(*order)))
    same = reduce(lambda a, b: a & b, [local[c].eqNullSafe(starts[f"_s{c}"]) for c in [*by, *cells]])
    placed = local.join(starts, same)
    return placed.select(*rows.columns, (F.col("_before") + F.col("_i")).alias(name))


def numbered_values(rows: DataFrame, value: str, name: str = "place") -> DataFrame:
    """Each different value once with a number 0.. that follows the md5 of the value: a shuffled
    order that any SQL engine can repeat.  The first two digits of the md5 are the cells."""
    v = rows.filter(F.col(value).isNotNull()).select(value).distinct().withColumn("_h", F.md5(F.col(value).cast("binary")))
    placed = placed_in_group(v.withColumn("_all", F.lit(0)), ["_all"], [F.left("_h", F.lit(2))], ["_h", value], name)
    return placed.select(value, (F.col(name) - 1).alias(name))


DAY = 86_400_000_000
_HOW = {"sum": (F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))), "max": (F.max, F.greatest), "min": (F.min, F.least)}


def slices(rows: DataFrame, column: str, width: int | None = None) -> Column:
    """Cells of an ordered column: days of a time, stretches of 65,536 of a number."""
    kind = rows.schema[column].dataType.typeName()
    if kind in ("timestamp", "timestamp_ntz", "date"):
        return F.floor(F.unix_micros(F.col(column).cast("timestamp")) / (width or DAY))
    return F.floor(F.col(column) / (width or 65_536))


def running(rows: DataFrame, by: list[str], cell: Column, order: list, values: dict[str, tuple[str, Column]], later: bool = False, own: bool = True) -> DataFrame:
    """``rows`` with running sums, greatest or least values over each group of ``by`` in ``order``.

    ``values``: name -> (``sum``, ``max`` or ``min``, what of).  ``later`` runs from the last row backwards; ``own`` tells
    whether a row's own value counts.  Nulls count for nothing; where nothing came before, a sum is 0, others null.

    A group is cut into cells that follow each other in ``order``.  Each cell folds to one value, these are scanned, and the rows of
    each cell go on from what the cells before it add up to.  So a group with any share of the rows is spread
    over as many tasks as it has cells, and only one row a cell meets in one task.
    """
    r = rows.withColumn("_k", F.struct(*by, cell.alias("_cell")))
    inside = W.partitionBy("_k").orderBy(*order).rowsBetween(*((0 if own else 1, W.unboundedFollowing) if later else (W.unboundedPreceding, 0 if own else -1)))
    totals = r.groupBy("_k").agg(*[_HOW[how][0](of).alias(f"_t_{n}") for n, (how, of) in values.items()])
    before = W.partitionBy(*[f"_k.{c}" for c in by]).orderBy("_k._cell").rowsBetween(*((1, W.unboundedFollowing) if later else (W.unboundedPreceding, -1)))
    carried = totals.select("_k", *[_HOW[how][0](f"_t_{n}").over(before).alias(f"_c_{n}") for n, (how, _) in values.items()])
    local = r.select("*", *[_HOW[how][0](of).over(inside).alias(f"_l_{n}") for n, (how, of) in values.items()])
    joined = local.join(carried, "_k")
    return joined.select(*rows.columns, *[_HOW[how][1](F.col(f"_l_{n}"), F.col(f"_c_{n}")).alias(n) for n, (how, _) in values.items()])
