"""Exact quantiles of groups of any size: ranks from a range partitioning, no group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize


def exact_ranks(df: DataFrame, group: str, value: str, partitions: int | None = None) -> DataFrame:
    """(group, value, r, n): rank of each non-null value in its group and the group's size.

    Values are range-partitioned by (group, value); each partition ranks its own rows and adds the sizes of the parts of the
    group before it, a table of at most partitions times groups rows. Ties get ranks in any order, which no quantile sees.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(group, value).where(F.col(value).isNotNull())
    rows = materialize(rows.repartitionByRange(n, group, value).withColumn("_p", F.spark_partition_id()), "ranges")
    part = rows.groupBy(group, "_p").agg(F.count("*").alias("_c"))
    w = Window.partitionBy(group).orderBy("_p")
    part = part.select(group, "_p", (F.sum("_c").over(w) - F.col("_c")).alias("_before"), F.sum("_c").over(Window.partitionBy(group)).alias("n"))
    same = F.col("r._p").eqNullSafe(F.col("q._p")) & F.col(f"r.{group}").eqNullSafe(F.col(f"q.{group}"))
    local = rows.withColumn("_r", F.row_number().over(Window.partitionBy(group, "_p").orderBy(value)))
    return local.alias("r").join(part.alias("q"), same).select(F.col(f"r.{group}").alias(group), F.col(f"r.{value}").alias(value), (F.col("_r") + F.col("_before")).alias("r"), "n")


def nearest(p: float) -> Column:
    """Nearest rank: round half even of p n + 0.5, within 1..n."""
    return F.least(F.col("n"), F.greatest(F.lit(1), F.bround(F.lit(p) * F.col("n") + 0.5).cast("bigint")))


def at_rank(value: str, rank: Column) -> Column:
    return F.max(F.when(F.col("r") == rank, F.col(value)))


def median(value: str) -> Column:
    """Interpolated: the mean of the two middle values of an even number."""
    lo, hi = F.floor((F.col("n") + 1) / 2), F.ceil((F.col("n") + 1) / 2)
    return (at_rank(value, lo) + at_rank(value, hi)) / 2
