"""Rankings made from rankings: fusion, two stages, quotas, merging, best of a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(df: DataFrame, by: list[Column], name: str = "rank", per: str = "qid") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(per).orderBy(*by)))


def fused(ranks: DataFrame, k: Column | int = 60, weight: Column | float = 1.0, digits: int = 9) -> Column:
    """Weighted reciprocal rank fusion of rank_a and rank_b. With weight 0 the order is that of rank_b."""
    k_, w = (x if isinstance(x, Column) else F.lit(x) for x in (k, weight))
    return F.round(w / (k_ + F.col("rank_a")) + F.lit(1.0) / (k_ + F.col("rank_b")), digits)


def two_stage(df: DataFrame, first: str, second: str, n: int) -> DataFrame:
    """The first n by ``first`` (a rank) in the order of ``second`` (a score), the rest in the first order; n = 0 takes all."""
    head = F.lit(True) if n == 0 else F.col(first) <= n
    return ranked(df, [F.desc(head), F.when(head, -F.col(second)).otherwise(F.col(first)), F.col("id")])


def round_robin(lists: DataFrame, caps: Column | int) -> DataFrame:
    """(qid, list, rank, item) -> (qid, item, position): one item of each list per round; a repeat is skipped but uses its list's turn."""
    kept = lists.where(F.col("rank") <= caps)
    firsts = kept.withColumn("_n", F.row_number().over(Window.partitionBy("qid", "item").orderBy("rank", "list"))).where("_n = 1")
    return firsts.select("qid", "item", F.row_number().over(Window.partitionBy("qid").orderBy("rank", "list")).alias("position"))


def seeds(df: DataFrame, entity: str, entities: Column, k: int, quota: int) -> DataFrame:
    """Top k per query, or, where the query names two entities or more, ``quota`` per entity without a cap, in rank order."""
    per = df.withColumn("_e", F.row_number().over(Window.partitionBy("qid", entity).orderBy("rank")))
    return per.where(F.when(entities >= 2, F.col("_e") <= quota).otherwise(F.col("rank") <= k)).drop("_e")


def best_of_groups(df: DataFrame, group: str, k: int) -> DataFrame:
    """The best row of each group of a query, then the k best of these."""
    best = df.withColumn("_g", F.row_number().over(Window.partitionBy("qid", group).orderBy(F.desc("score"), "id"))).where("_g = 1").drop("_g")
    return ranked(best, [F.desc("score"), F.col("id")]).where(F.col("rank") <= k)
