"""Near copies among many short texts: DartMinHash bands, exact check of every candidate, groups by chains.

Shared by the operators for near duplicates and for truncated copies.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize, spread
from . import dart
from .components import components
from .textnorm import grams, plain


@dataclass(frozen=True)
class Banding:
    """n: characters of a gram; b bands of r columns; least: similarity that links two texts; sketch_bits: agreeing bits of 128 below which a candidate isn't fetched (four standard deviations under the mean at ``least``); small: bucket size up to which all its pairs are candidates."""

    n: int = 2
    b: int = 96
    r: int = 5
    least: float = 0.5
    sketch_bits: int = 76
    small: int = 48


def classes(texts: DataFrame, form: Callable[[str | None], str] = plain) -> DataFrame:
    """(id, norm) -> all rows with their plain form; rows whose form is empty are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf["norm"] = [form(t) for t in pdf["text"]]
            yield pdf.loc[pdf["norm"] != "", ["id", "norm"]]

    return texts.where("text is not null and id is not null").select("id", "text").mapInPandas(run, "id bigint, norm string")


def signed(reps: DataFrame, how: Banding) -> DataFrame:
    """(rid, norm) -> (rid, toks, bands, s0, s1)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            at = 0
            length = pdf["norm"].str.len().to_numpy()
            while at < len(pdf):
                to, size = at, 0
                while to < len(pdf) and (to == at or size + length[to] < 40_000):
                    size += length[to]
                    to += 1
                part = pdf.iloc[at:to]
                rows, values = grams(list(part["norm"]), how.n)
                sig = dart.signatures(rows, dart.mix(values), None, len(part), how.b * how.r)
                sk = dart.sketch(sig)
                cuts = np.cumsum(np.bincount(rows, minlength=len(part)))[:-1]
                yield pd.DataFrame(
                    {
                        "rid": part["rid"].to_numpy(),
                        "toks": np.split(values.view(np.int64), cuts),
                        "bands": list(dart.bands(sig, how.b, how.r)),
                        "s0": sk[:, 0],
                        "s1": sk[:, 1],
                    }
                )
                at = to

    return spread(reps, "rid").mapInPandas(run, "rid bigint, toks array<bigint>, bands array<bigint>, s0 bigint, s1 bigint")


def agreeing_bits(a: str, b: str, words: int = 2) -> Column:
    """Agreeing bits of two sketches in columns s0, s1, ..."""
    apart = [F.bit_count(F.col(f"{a}.s{i}").bitwiseXOR(F.col(f"{b}.s{i}"))) for i in range(words)]
    return F.lit(64 * words) - sum(apart[1:], apart[0])


def _pairs(x: DataFrame, y: DataFrame, how: Banding, extra: Column) -> DataFrame:
    return (
        x.alias("x")
        .join(y.alias("y"), (F.col("x.band") == F.col("y.band")) & extra & (agreeing_bits("x", "y") >= how.sketch_bits))
        .select(F.least("x.rid", "y.rid").alias("a"), F.greatest("x.rid", "y.rid").alias("b"))
    )


def similarity(x: Column, y: Column) -> Column:
    """Jaccard similarity of two arrays of distinct values."""
    both = F.size(F.array_intersect(x, y)).cast("double")
    return both / (F.size(x) + F.size(y) - both)


def verified(pairs: DataFrame, sigs: DataFrame, least: float) -> DataFrame:
    """Of the pairs (a, b) those that are similar enough, with their similarity."""
    t = sigs.select("rid", "toks")
    return (
        pairs.distinct()
        .join(t.select(F.col("rid").alias("a"), F.col("toks").alias("ta")), "a")
        .join(t.select(F.col("rid").alias("b"), F.col("toks").alias("tb")), "b")
        .withColumn("similarity", similarity(F.col("ta"), F.col("tb")))
        .where(F.col("similarity") >= least)
        .select("a", "b", "similarity")
    )


def links(sigs: DataFrame, how: Banding) -> DataFrame:
    """(a, b) links whose chains are those of all similar pairs that share a band.

    Buckets of up to ``how.small`` texts give all their pairs. A larger bucket never does: first each of its texts is
    compared with the bucket's smallest; then, of the texts that are still in different components, those outside the
    bucket's largest component are compared with all of the bucket. Every cross-component pair is covered, and pairs
    within a component, which can't change the groups, are not emitted.
    """
    rows = sigs.select(F.explode("bands").alias("band"), "rid", "s0", "s1")
    sizes = rows.groupBy("band").agg(F.count("*").alias("n"), F.min("rid").alias("lead")).where("n > 1")
    shared = materialize(rows.join(sizes, "band"), "buckets")
    few, many = shared.where(F.col("n") <= how.small), shared.where(F.col("n") > how.small)
    pairs = _pairs(few, few, how, F.col("x.rid") < F.col("y.rid"))
    if many.isEmpty():
        return materialize(verified(pairs, sigs, how.least), "links")
    lead = many.where("rid = lead").dropDuplicates(["band"])
    first = materialize(verified(pairs.union(_pairs(lead, many, how, F.col("x.rid") < F.col("y.rid"))), sigs, how.least), "links")
    label = components(first.select("a", "b"))
    at = many.join(label.withColumnRenamed("node", "rid"), "rid", "left").withColumn("component", F.coalesce("component", "rid"))
    at = materialize(at, "labelled")
    per = at.groupBy("band", "component").agg(F.count("*").alias("c"))
    top = per.groupBy("band").agg(F.max(F.struct("c", "component")).alias("top"), F.count("*").alias("k")).where("k > 1").select("band", F.col("top.component").alias("main"))
    open_ = at.join(top, "band")
    second = _pairs(open_.where("component <> main"), open_, how, F.col("x.component") != F.col("y.component"))
    return materialize(first.union(verified(second, sigs, how.least)), "links")
