"""Running totals and neighbours in one order over a whole table, without a task that sees all of it.

Rows are cut into ranges of the order, whose number follows the rows; each range is sorted alone, and what one range hands to the next (its
totals, its last row) meets in a frame of one row per range and group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import fresh, shared_folder, written

#: Rows of a range.
RANGE_ROWS = 500_000


def ranged(df: DataFrame, order: list[str], rows: int | None = None) -> tuple[DataFrame, str]:
    """df, written, with the number of each row's range; the name of that column. Rows equal in all of ``order`` share a range."""
    rows = RANGE_ROWS if rows is None else rows
    part = fresh("_range", df)
    n = max(1, -(-df.count() // rows))
    cut = df.repartitionByRange(n, *(F.col(c).asc_nulls_first() for c in order)) if n > 1 else df
    number = F.spark_partition_id() if n > 1 else F.lit(0)
    return written(cut.withColumn(part, number), shared_folder(df.sparkSession, "ranges")), part


def running(df: DataFrame, by: list[str], order: list[str], sums: dict[str, str], rows: int | None = None) -> DataFrame:
    """df with, for each new name in ``sums``, the sum of a column over the rows of its group (by) that stand before in ``order``; equal
    rows stand in any order among themselves, so aggregate them first where that matters."""
    cut, part = ranged(df, [*by, *order], rows)
    inside = Window.partitionBy(*by, part).orderBy(*(F.col(c).asc_nulls_first() for c in order)).rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy(*by, F.lit(0)).orderBy(part).rowsBetween(Window.unboundedPreceding, -1) if by else Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    total = cut.groupBy(*by, part).agg(*(F.sum(c).alias(f"_t{k}") for k, c in enumerate(sums.values())))
    total = total.select(*by, part, *(F.coalesce(F.sum(f"_t{k}").over(across), F.lit(0)).alias(f"_b{k}") for k in range(len(sums))))
    own = cut.select("*", *(F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"_o{k}") for k, c in enumerate(sums.values())))
    met = matched(own, total, [*by, part])
    return met.select(*df.columns, *((F.col(f"_o{k}") + F.col(f"_b{k}")).alias(name) for k, name in enumerate(sums)))


def placed(df: DataFrame, by: list[str], order: list[str], before: dict[str, str], rows: int | None = None) -> DataFrame:
    """df with ``place`` (rows of its group before it) and, for each new name in ``before``, the column's value in the row just before it."""
    cut, part = ranged(df, [*by, *order], rows)
    key = [F.col(c).asc_nulls_first() for c in order]
    inside = Window.partitionBy(*by, part).orderBy(*key)
    last = F.max_by(F.struct(*before.values()), F.struct(*order))
    ends = cut.groupBy(*by, part).agg(F.count("*").alias("_n"), last.alias("_last"))
    across = Window.partitionBy(*by).orderBy(part)
    ends = ends.select(*by, part, F.coalesce(F.sum("_n").over(across.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_first"), F.lag("_last").over(across).alias("_last"))
    own = cut.select("*", (F.row_number().over(inside) - 1).alias("_own"), F.lag(F.struct(*before.values())).over(inside).alias("_lag"))
    met = matched(own, ends, [*by, part])
    value = lambda c: F.when(F.col("_own") > 0, F.col("_lag")[c]).otherwise(F.col("_last")[c])
    return met.select(*df.columns, (F.col("_first") + F.col("_own")).alias("place"), *(value(c).alias(name) for name, c in before.items()))


def matched(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """left with right's other columns, null keys matching each other."""
    turned = right.select(*(F.col(c).alias(f"_k{k}") for k, c in enumerate(keys)), *(c for c in right.columns if c not in keys))
    on: Column = F.lit(True)
    for k, c in enumerate(keys):
        on = on & F.col(c).eqNullSafe(F.col(f"_k{k}"))
    return left.join(turned, on)
