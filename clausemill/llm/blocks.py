"""Rows of equal key compared all against all in blocks of bounded size, however many rows a key has."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize


def facing(left: DataFrame, right: DataFrame, key: str, size: int = 512) -> DataFrame:
    """(xb, yb, x_..., y_...): every pair of a block of ``left`` and one of ``right`` of the same ``key``, one row each.

    Both have ``key`` and ``rid``; the columns come as arrays. A block holds about ``size`` rows by hash of rid, and
    pairs of blocks are spread over tasks by key and block, so a hot key is no single task's work.
    """

    def count(df: DataFrame, p: str) -> DataFrame:
        return df.groupBy(key).agg(F.ceil(F.count("*") / size).alias(f"{p}n"))

    both = materialize(count(left, "x").join(count(right, "y"), key), "facing")

    def blocks(df: DataFrame, p: str) -> DataFrame:
        own = [c for c in df.columns if c != key]
        at = df.join(both.select(key, f"{p}n"), key).withColumn(f"{p}b", F.pmod(F.xxhash64("rid"), F.col(f"{p}n")))
        rows = at.groupBy(key, f"{p}b").agg(F.collect_list(F.struct(*own)).alias("rows"))
        return rows.select(key, f"{p}b", *[F.col(f"rows.{c}").alias(f"{p}_{c}") for c in own])

    def upto(n: str):
        return F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))

    tasks = both.select(key, "yn", upto("xn").alias("xb")).select(key, "xb", upto("yn").alias("yb"))
    return tasks.join(blocks(left, "x"), [key, "xb"]).join(blocks(right, "y"), [key, "yb"]).drop(key)


def common(xs: list[np.ndarray], ys: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Number of common values of every two of ``xs`` and ``ys``, arrays of distinct values; ``width`` values of the vocabulary at a time."""
    nx, ny = [len(x) for x in xs], [len(y) for y in ys]
    x, y = np.concatenate(xs), np.concatenate(ys)
    both = np.intersect1d(x, y)
    out = np.zeros((len(xs), len(ys)), dtype=np.float32)
    if not len(both):
        return out.astype(np.int64)

    def at(v: np.ndarray, sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
        i = np.minimum(np.searchsorted(both, v), len(both) - 1)
        known = both[i] == v
        rows, i = np.repeat(np.arange(len(sizes)), sizes)[known], i[known]
        order = np.argsort(i, kind="stable")
        return rows[order], i[order]

    (rx, ix), (ry, iy) = at(x, nx), at(y, ny)
    for lo in range(0, len(both), width):
        hi = min(lo + width, len(both))
        a, b = np.zeros((len(xs), hi - lo), dtype=np.float32), np.zeros((len(ys), hi - lo), dtype=np.float32)
        f, t = np.searchsorted(ix, (lo, hi))
        a[rx[f:t], ix[f:t] - lo] = 1
        f, t = np.searchsorted(iy, (lo, hi))
        b[ry[f:t], iy[f:t] - lo] = 1
        out += a @ b.T
    return out.astype(np.int64)


def alike(xs: list[np.ndarray], ys: list[np.ndarray], least: float) -> np.ndarray:
    """Which two of ``xs`` and ``ys`` have a Jaccard similarity of ``least`` or more."""
    both = common(xs, ys)
    return both >= least * (np.array([len(x) for x in xs])[:, None] + np.array([len(y) for y in ys])[None, :] - both)
