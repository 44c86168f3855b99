"""Context assembly from ranked seeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _chars(rows: DataFrame):
    """Characters of a text: a column where ``text`` only stands for it."""
    return F.col("chars") if "chars" in rows.columns else F.char_length("text")


def expanded(seeds: DataFrame, chunks: DataFrame, around: int) -> DataFrame:
    """Each seed (qid, seed_rank, doc, ord) with its neighbours up to ``around`` in the same document, in reading order."""
    c = chunks.select(F.col("doc").alias("doc"), F.col("ord").alias("c_ord"), "chunk_id", "text", *[x for x in ("chars",) if x in chunks.columns])
    return seeds.join(c, (seeds["doc"] == c["doc"]) & c["c_ord"].between(seeds["ord"] - around, seeds["ord"] + around)).drop(c["doc"])


def budgeted(rows: DataFrame, max_chars: int) -> DataFrame:
    """Rows (qid, seed_rank, text, ...) whose text no better seed brought, up to the first seed that would exceed the budget.

    ``text`` may be any key of it, beside a column ``chars``. A seed costs the characters of its new texts. The first seed with a cost is always kept, whatever its size.
    """
    fresh = rows.withColumn("_first", F.min("seed_rank").over(Window.partitionBy("qid", "text"))).where("seed_rank = _first").drop("_first")
    cost = fresh.groupBy("qid", "seed_rank").agg(F.sum(_chars(fresh)).alias("cost"))
    w = Window.partitionBy("qid").orderBy("seed_rank")
    run = cost.withColumn("total", F.sum("cost").over(w)).withColumn("nth", F.sum(F.when(F.col("cost") > 0, 1).otherwise(0)).over(w))
    cut = run.where((F.col("total") > max_chars) & (F.col("nth") > 1)).groupBy("qid").agg(F.min("seed_rank").alias("_cut"))
    return fresh.join(cut, "qid", "left").where(F.col("_cut").isNull() | (F.col("seed_rank") < F.col("_cut"))).drop("_cut")


def blocks(rows: DataFrame) -> DataFrame:
    """(qid, cid, doc, chunk_ids, n_chars): one block per document in order of its best seed, chunks in reading order, cid C1, C2, ..."""
    b = rows.groupBy("qid", "doc").agg(
        F.min("seed_rank").alias("first"), F.array_sort(F.collect_set(F.struct("c_ord", "chunk_id"))).alias("cs"), F.sum(_chars(rows)).alias("n_chars")
    )
    w = Window.partitionBy("qid").orderBy("first", "doc")
    return b.select("qid", F.concat(F.lit("C"), F.row_number().over(w)).alias("cid"), "doc", F.transform("cs", lambda c: c["chunk_id"]).alias("chunk_ids"), "n_chars")


def with_neighbours(seeds: DataFrame, order: DataFrame, first: int) -> DataFrame:
    """Seeds (qid, rank, id) and, behind them, the previous and next item of the first ``first`` seeds. order: (id, prev_id, next_id)."""
    near = seeds.where(F.col("rank") <= first).join(order, "id").select("qid", "rank", F.explode(F.array("prev_id", "next_id")).alias("id")).where("id is not null")
    all_ = seeds.select("qid", "rank", "id", F.lit(0).alias("added")).union(near.select("qid", "rank", "id", F.lit(1).alias("added")))
    one = all_.withColumn("_n", F.row_number().over(Window.partitionBy("qid", "id").orderBy("added", "rank"))).where("_n = 1")
    return one.select("qid", "id", "added", F.row_number().over(Window.partitionBy("qid").orderBy("added", "rank", "id")).alias("position"))
