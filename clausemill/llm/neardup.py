"""Problem 3: near-duplicate records with small edits, in groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .blocks import alike, facing
from .components import components
from .near import Banding, classes, links, signed


def _grouped(texts: DataFrame, how: Banding) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Members (id, norm), classes (norm, rid), their signatures and the labels (node, component) of those with a link."""
    member = classes(texts).groupBy("id").agg(F.min("norm").alias("norm"))
    member = materialize(member, "member")
    reps = materialize(member.groupBy("norm").agg(F.min("id").alias("rid")), "reps")
    sigs = materialize(signed(reps.select("rid", "norm"), how), "signed")
    return member, reps, sigs, components(links(sigs, how).select("a", "b").distinct())


def similar_groups(texts: DataFrame, how: Banding = Banding()) -> DataFrame:
    """(id, class_id, group_id) as in ``near_duplicates``, without the work of counting links."""
    member, reps, _, label = _grouped(texts, how)
    named = reps.join(label.withColumnRenamed("node", "rid"), "rid", "left")
    return member.join(named, "norm").select("id", F.col("rid").alias("class_id"), F.coalesce("component", "rid").alias("group_id"))


def _counted(least: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for xr, xt, yr, yt in zip(pdf["x_rid"], pdf["x_toks"], pdf["y_rid"], pdf["y_toks"], strict=True):
                linked = alike(xt, yt, least) & (xr[:, None] != yr[None, :])
                yield pd.DataFrame({"rid": xr, "links": linked.sum(1).astype(np.int64)})

    return run


def near_duplicates(texts: DataFrame, how: Banding = Banding()) -> DataFrame:
    """(id, class_id, group_id, class_links): one row per id of ``texts`` (id bigint, text).

    The class holds the ids of equal plain form (width, white space and punctuation ignored) and is named by its
    smallest id; the group joins classes over chains of similar ones; class_links counts the other classes of the group
    that a class is similar enough to, all compared exactly, in blocks. Null ids, null texts and texts without a letter
    or digit are no cases; repeated rows of an id count once (the smallest form, should they differ). An empty table
    gives no row; other columns are never read.
    """
    member, reps, sigs, label = _grouped(texts, how)
    at = materialize(sigs.select("rid", "toks").join(label.withColumnRenamed("node", "rid"), "rid"), "grouped")
    degree = facing(at, at, "component").mapInPandas(_counted(how.least), "rid bigint, links bigint").groupBy("rid").agg(F.sum("links").alias("class_links"))
    named = reps.join(label.withColumnRenamed("node", "rid").join(degree, "rid"), "rid", "left")
    return member.join(named, "norm").select(
        "id", F.col("rid").alias("class_id"), F.coalesce("component", "rid").alias("group_id"), F.coalesce("class_links", F.lit(0)).alias("class_links")
    )


def group_pairs(groups: DataFrame) -> DataFrame:
    """(id_a, id_b) of every two ids of a group, id_a < id_b: the result p3_found asks for."""
    g = materialize(groups.select("id", "group_id"), "groups")
    big = g.groupBy("group_id").agg(F.count("*").alias("n")).where("n > 1").select("group_id")
    g = g.join(big, "group_id")
    x, y = g.select("group_id", F.col("id").alias("id_a")), g.select("group_id", F.col("id").alias("id_b"))
    return x.join(y, "group_id").where("id_a < id_b").select("id_a", "id_b")
