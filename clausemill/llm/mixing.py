"""Problem 9: mixing sources to target weights by cube-method balanced sampling (Deville and Tillé)."""

from __future__ import annotations

from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .bpe import DEFAULT_VOCABULARY, token_counts

#: documents per block of the flight phase
BLOCK = 4000
#: rows of all sizes in a block that go on undecided, so that the last level has some to settle with
RESERVE = 60
_UNIT = "doc_id bigint, source string, tokens bigint, base int, pi double, u double, block bigint"


def flight(pi: list[float], size: list[int], u: list[float]) -> list[float]:
    """Walk in the null space of (count, size) until at most two units are undecided; each step decides one of three.

    Every move keeps the sums of pi and of pi * size, and is even in expectation: no unit's probability is changed.
    """
    p = list(pi)
    active: list[int] = []
    for k in range(len(p)):
        if 1e-9 < p[k] < 1 - 1e-9:
            active.append(k)
        else:
            p[k] = float(round(p[k]))
        if len(active) < 3:
            continue
        i, j, m = active
        a, b, c = size[m] - size[j], size[i] - size[m], size[j] - size[i]
        if a == 0 and b == 0:
            a, b, c = 1, -1, 0
        up = down = float("inf")
        for q, d in ((p[i], a), (p[j], b), (p[m], c)):
            if d > 0:
                up, down = min(up, (1 - q) / d), min(down, q / d)
            elif d < 0:
                up, down = min(up, -q / d), min(down, (q - 1) / d)
        step = up if u[k] * (up + down) < down else -down
        left = []
        for q, d in ((i, a), (j, b), (m, c)):
            p[q] += step * d
            if p[q] < 1e-9:
                p[q] = 0.0
            elif p[q] > 1 - 1e-9:
                p[q] = 1.0
            else:
                left.append(q)
        active = left
    return p


def land(pi: list[float], size: list[int]) -> list[float]:
    """Decide the few units that are left: the choice whose token total is nearest to the expected one, then whose count is."""
    want, n = sum(p * s for p, s in zip(pi, size, strict=True)), sum(pi)
    best = min(product((0.0, 1.0), repeat=len(pi)), key=lambda x: (abs(sum(a * s for a, s in zip(x, size, strict=True)) - want), abs(sum(x) - n)))
    return list(best)


def _fly(pdf: pd.DataFrame, reserve: int = 0) -> pd.DataFrame:
    # the largest first: what is undecided in the end is small
    pdf = pdf.sort_values(["tokens", "u", "doc_id"], ascending=[False, True, True], ignore_index=True)
    fly = np.ones(len(pdf), dtype=bool)
    if reserve:
        fly[np.linspace(0, len(pdf) - 1, min(reserve, len(pdf))).astype(int)] = False
    pdf.loc[fly, "pi"] = flight(pdf.loc[fly, "pi"].tolist(), pdf.loc[fly, "tokens"].tolist(), pdf.loc[fly, "u"].tolist())
    return pdf


def _fly_on(pdf: pd.DataFrame) -> pd.DataFrame:
    return _fly(pdf, min(RESERVE, BLOCK // 10))


def _fly_and_land(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = _fly(pdf)
    open_ = (pdf["pi"] > 0) & (pdf["pi"] < 1)
    if open_.any():
        pdf.loc[open_, "pi"] = land(pdf.loc[open_, "pi"].tolist(), pdf.loc[open_, "tokens"].tolist())
    return pdf


def sized(docs: DataFrame, vocabulary_path: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(doc_id, source, tokens) of the rows that count: text with something in it and a source."""
    d = docs.where("doc_id is not null and source is not null and text is not null").where(F.regexp_like("text", F.lit(r"(?U)\S")))
    return token_counts(d.select("doc_id", "source", "text"), ["doc_id", "source"], vocabulary_path)


def quotas(units: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """(source, docs, available, target_share, max_repeats, quota, copies): per source of ``targets`` what may be taken.

    The selection is to have ``total_tokens`` (as many as there are, if None); a source's quota is its share of them or, if
    less, max_repeats times what it has; copies is how often each of its tokens is taken on average. Sources without a
    target take no part; a target without documents has quota 0. Null shares and repeats count as 0.
    """
    own = units.groupBy("source").agg(F.count("*").alias("docs"), F.sum("tokens").alias("available"))
    total = own.agg(F.coalesce(F.sum("available"), F.lit(0)).cast("double").alias("total")) if total_tokens is None else None
    t = targets.where("source is not null").groupBy("source").agg(F.max(F.coalesce("target_share", F.lit(0.0))).alias("target_share"), F.max(F.coalesce("max_repeats", F.lit(0))).alias("max_repeats"))
    j = t.join(own, "source", "left").withColumn("docs", F.coalesce("docs", F.lit(0))).withColumn("available", F.coalesce("available", F.lit(0)))
    j = j.crossJoin(total) if total is not None else j.withColumn("total", F.lit(float(total_tokens)))  # one row
    quota = F.least(F.col("target_share") * F.col("total"), F.col("max_repeats") * F.col("available"))
    return j.withColumn("quota", quota).withColumn("copies", F.when(F.col("available") > 0, F.col("quota") / F.col("available")).otherwise(0.0))


def balanced_selection(units: DataFrame, quota: DataFrame, seed: int = 1) -> DataFrame:
    """(doc_id, source, tokens, copies): every selected row with how often it is taken.

    A source that is to be taken c times on average gets every row floor(c) times and the rest by a sample with equal
    probabilities, balanced on tokens and on rows: the cube method's flight runs in blocks of some thousand rows
    side by side, the at most two undecided rows of each block and some of all sizes go on to the next level until one block per source is left,
    and only that is landed. No decided row is turned over again, so every row keeps its inclusion probability but for the
    two that land, and a source's total is off by less than these. No block grows with the data.
    """
    q = quota.select("source", "copies", F.ceil(F.col("docs") / BLOCK).cast("bigint").alias("blocks")).where("copies > 0")
    base = F.floor(F.col("copies") + 1e-12).cast("int")
    u = units.join(F.broadcast(q), "source")  # one row per target source, a table of fixed size
    key = F.xxhash64("doc_id", F.lit(seed))
    u = u.select(
        "doc_id", "source", "tokens", base.alias("base"), (F.col("copies") - base).alias("pi"),
        (F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), F.lit(1 << 30)) / float(1 << 30)).alias("u"),
        F.pmod(key, F.greatest("blocks", F.lit(1))).alias("block"),
    )
    u = materialize(u, "units")
    reserve = min(RESERVE, BLOCK // 10)
    done, most = None, (u.groupBy("source").agg(F.max("block").alias("b")).agg(F.max("b")).first()[0] or 0) + 1
    while most > 1:
        u = materialize(u.groupBy("source", "block").applyInPandas(_fly_on, _UNIT), "flown")
        fixed = u.where("pi <= 0 or pi >= 1")
        done = fixed if done is None else done.union(fixed)
        most = -(-(reserve + 2) * most // BLOCK)
        u = u.where("pi > 0 and pi < 1").withColumn("block", F.pmod(F.col("block"), F.lit(most)))
    last = u.groupBy("source").applyInPandas(_fly_and_land, _UNIT)
    done = last if done is None else done.union(last)
    return done.select("doc_id", "source", "tokens", (F.col("base") + F.round("pi").cast("int")).alias("copies")).where("copies > 0")


def mix_shares(selection: DataFrame, quota: DataFrame) -> DataFrame:
    """Per target source: what it was to have and what it got, as tokens, as share of the planned total and as share of the selection."""
    got = selection.groupBy("source").agg(
        F.count("*").alias("docs_selected"), F.sum(F.col("tokens") * F.col("copies")).alias("tokens_selected"), F.max("copies").alias("most_copies")
    )
    j = quota.join(got, "source", "left").withColumn("tokens_selected", F.coalesce("tokens_selected", F.lit(0)))
    all_ = j.agg(F.sum("tokens_selected").cast("double").alias("all_selected"))
    j = j.crossJoin(all_)  # one row
    return j.select(
        "source", "target_share", "max_repeats", "docs", "available", "quota", F.coalesce("docs_selected", F.lit(0)).alias("docs_selected"), "tokens_selected",
        F.coalesce("most_copies", F.lit(0)).alias("most_copies"),
        F.when(F.col("total") > 0, F.col("tokens_selected") / F.col("total")).otherwise(0.0).alias("share_of_plan"),
        F.when(F.col("all_selected") > 0, F.col("tokens_selected") / F.col("all_selected")).otherwise(0.0).alias("share_of_selection"),
        (F.col("target_share") * F.col("total") > F.col("max_repeats") * F.col("available")).alias("capped"),
    )
