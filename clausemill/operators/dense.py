"""Vector scoring in blocks: a stated query set against all rows, each block pair one matrix product."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: rows of a block on either side
QUERY_BLOCK, CORPUS_BLOCK = 512, 4096


def _blocks(df: DataFrame, id_: str, vec: str, extra: list[str], size: int, seed: int) -> DataFrame:
    """Blocks of about ``size`` rows by hash; their number follows the row count, which one cheap count gives."""
    n = max(1, -(-df.count() // size))
    return (
        df.where(F.col(vec).isNotNull() & F.col(id_).isNotNull())
        .withColumn("_b", F.pmod(F.xxhash64(F.col(id_), F.lit(seed)), F.lit(n)))
        .groupBy("_b")
        .agg(F.collect_list(F.struct(F.col(id_).cast("bigint").alias("id"), F.col(vec).cast("array<double>").alias("v"), *[F.col(c).cast("string").alias(c) for c in extra])).alias("rows"))
        .select("rows")
    )


def cosine_top(
    queries: DataFrame, corpus: DataFrame, k: int | None, dims: int | None = None, scope: str | None = None, least: float | None = None, best_of: str | None = None, digits: int = 6
) -> DataFrame:
    """(qid, id, score): dot products of unit vectors, accumulated in double and rounded; per query the k best (all, if None).

    ``dims`` uses the first components only; ``scope`` names a column that must agree (filtered before ranking, as the
    scores don't depend on each other); ``least`` drops scores below; ``best_of`` names a column of the corpus of whose
    values only the best row counts per query (as string column of the result; the column needs no null). A block pair keeps its own k best, so what leaves
    a task is bounded; the last cut is a window with a group limit. Null vectors and ids take no part.
    """
    extra = [c for c in dict.fromkeys((scope, best_of)) if c]
    q_extra = [scope] if scope else []
    q = _blocks(queries, "qid", "vector", q_extra, QUERY_BLOCK, 1).withColumnRenamed("rows", "qs")
    c = _blocks(corpus, "id", "vector", extra, CORPUS_BLOCK, 2).withColumnRenamed("rows", "cs")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for qs, cs in zip(pdf["qs"], pdf["cs"], strict=True):
                x, y = np.array([r["v"] for r in qs])[:, :dims], np.array([r["v"] for r in cs])[:, :dims]
                qi, ci = np.array([r["id"] for r in qs]), np.array([r["id"] for r in cs])
                s = np.round(x @ y.T, digits) + 0.0
                ok = np.ones(s.shape, dtype=bool)
                if scope:
                    ok &= np.array([r[scope] for r in qs], dtype=object)[:, None] == np.array([r[scope] for r in cs], dtype=object)[None, :]
                if least is not None:
                    ok &= s >= least
                rows, cols = np.nonzero(ok)
                out = pd.DataFrame({"qid": qi[rows], "id": ci[cols], "score": s[rows, cols]})
                if best_of:
                    out[best_of] = np.array([r[best_of] for r in cs], dtype=object)[cols]
                    out = out.sort_values(["qid", "score", "id"], ascending=[True, False, True]).drop_duplicates(["qid", best_of])
                elif k is not None:
                    out = out.sort_values(["qid", "score", "id"], ascending=[True, False, True]).groupby("qid", sort=False).head(k)
                yield out

    scored = c.repartition(max(1, c.sparkSession.sparkContext.defaultParallelism)).crossJoin(q).mapInPandas(run, "qid bigint, id bigint, score double" + (f", {best_of} string" if best_of else ""))
    if best_of:
        per = Window.partitionBy("qid", best_of).orderBy(F.desc("score"), "id")
        scored = scored.withColumn("_n", F.row_number().over(per)).where("_n = 1").drop("_n")
    if k is None:
        return scored
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def pair_scores(pairs: DataFrame, queries: DataFrame, corpus: DataFrame, digits: int = 6) -> DataFrame:
    """Pairs (qid, id, ...) with ``score``, the dot product of their vectors: for the few pairs that a first stage left."""
    q = queries.select("qid", F.col("vector").cast("array<double>").alias("_q"))
    c = corpus.select("id", F.col("vector").cast("array<double>").alias("_c"))
    dot = F.aggregate(F.zip_with("_q", "_c", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return pairs.join(q, "qid").join(c, "id").withColumn("score", F.round(dot, digits) + F.lit(0.0)).drop("_q", "_c")
