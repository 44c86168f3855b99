"""Retrieval metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import share


def evidence_ranks(evidence: DataFrame, top: DataFrame, keys: list[str], pages: tuple[str, str, str] | None = None) -> DataFrame:
    """Best rank of each piece of evidence (qid, ev, keys...) among the ranked rows (qid, rank, keys...); null if none matches.

    ``pages`` = (page, start, end) adds the range condition page between start and end to the equi-join.
    """
    e, t = evidence.alias("e"), top.alias("t")
    on = F.col("e.qid") == F.col("t.qid")
    for k in keys:
        on &= F.col(f"e.{k}") == F.col(f"t.{k}")
    if pages:
        on &= F.col(f"e.{pages[0]}").between(F.col(f"t.{pages[1]}"), F.col(f"t.{pages[2]}"))
    return e.join(t, on, "left").groupBy(F.col("e.qid").alias("qid"), F.col("e.ev").alias("ev")).agg(F.min("t.rank").alias("rank"))


def question_metrics(ranks: DataFrame, k: int = 5, depth: int = 10) -> DataFrame:
    """(qid, first_rank, hit, recall, rr): hit within k, share of evidence within k, reciprocal of the first rank within depth."""
    g = ranks.groupBy("qid").agg(F.min("rank").alias("first_rank"), F.count("*").alias("n"), F.count_if(F.col("rank") <= k).alias("found"))
    return g.select(
        "qid", "first_rank", F.coalesce(F.col("first_rank") <= k, F.lit(False)).cast("int").alias("hit"), share(F.col("found"), F.col("n")).alias("recall"),
        F.when(F.col("first_rank") <= depth, 1.0 / F.col("first_rank")).otherwise(0.0).alias("rr"),
    )


def macro(n: Column | None = None) -> list[Column]:
    return [F.count("*").alias("questions"), F.round(F.avg("hit"), 6).alias("hit_rate"), F.round(F.avg("recall"), 6).alias("recall"), F.round(F.avg("rr"), 6).alias("mrr")]
