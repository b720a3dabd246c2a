"""Running sums and numbers over a whole ordered table without a window over one partition.

Rows are dealt into ranges of the order column that hold about equally many rows each, however sparse its values are; a small table of one row
per range carries the sums before it, so each range is a window of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quay.functions import local

#: Values of the order column that are counted together to find the ranges' bounds.
CELL = 1 << 16
#: Rows in one range, about; a cell of more rows is a range of its own.
RANGE_ROWS = 1 << 16


def _ranges(df: DataFrame, seq: str, value: Column) -> DataFrame:
    """cell, range, base: which range each cell of the order column is in, and the sum before that range.

    One row stands for each cell that has rows. Cells are numbered by their share of all rows: first among 4,096 neighbours, then over these groups.
    """
    cells = df.groupBy(F.floor(F.col(seq) / CELL).alias("cell")).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("s")).withColumn("group", F.floor(F.col("cell") / 4096))
    groups = cells.groupBy("group").agg(F.sum("n").alias("gn"), F.sum("s").alias("gs"))
    over = Window.orderBy("group").rowsBetween(Window.unboundedPreceding, -1)  # one row for each 2 ** 28 values
    groups = groups.select("group", F.coalesce(F.sum("gn").over(over), F.lit(0)).alias("n0"), F.coalesce(F.sum("gs").over(over), F.lit(0)).alias("s0"))
    inside = Window.partitionBy("group").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    placed = cells.join(groups, "group").select(
        "group", "cell", (F.col("n0") + F.coalesce(F.sum("n").over(inside), F.lit(0))).alias("n0"), (F.col("s0") + F.coalesce(F.sum("s").over(inside), F.lit(0))).alias("s0")
    )
    # cells that begin in the same run of RANGE_ROWS rows of one group are one range, named by its first cell
    run = Window.partitionBy("group", F.floor(F.col("n0") / RANGE_ROWS))
    return placed.select("cell", F.min("cell").over(run).alias("range"), F.min(F.struct("cell", "s0")).over(run)["s0"].alias("base"))


def prefix_sum(df: DataFrame, value: Column, name: str, *, seq: str = "seq", ties: tuple[str, ...] = ()) -> DataFrame:
    """Adds the sum of ``value`` over all rows before this one, by ``seq`` and then ``ties``."""
    cell, range_, base = local.free(df, "cell", "range", "base")
    dealt = _ranges(df, seq, value).select(F.col("cell").alias(cell), F.col("range").alias(range_), F.col("base").alias(base))
    rows = df.withColumn(cell, F.floor(F.col(seq) / CELL)).join(dealt, cell)
    before = Window.partitionBy(range_).orderBy(seq, *ties).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn(name, F.col(base) + F.coalesce(F.sum(value).over(before), F.lit(0))).drop(cell, range_, base)


def numbered(df: DataFrame, name: str, *, seq: str = "seq", ties: tuple[str, ...] = ()) -> DataFrame:
    """Adds the number of rows before this one."""
    return prefix_sum(df, F.lit(1).cast("long"), name, seq=seq, ties=ties)
