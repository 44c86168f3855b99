"""Problem 6: percentiles of very large numeric columns from mergeable rank-interval summaries (Greenwald and Khanna).

A summary of n values is a list of tuples (v, lo, hi): the value v has a rank from lo to hi among them. Its error is half
of the largest uncertainty ``hi of a tuple - lo of the tuple before``: every rank is that near to some tuple.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

KEYS = ["g0", "g1", "g2", "metric"]
_TUPLES = "g0 string, g1 string, g2 date, metric string, part bigint, v double, lo bigint, hi bigint"
#: proven rank error as a share of the group's size
EPS = 0.005
#: summaries of one key that one step merges
FAN = 64
_FIELDS = ["part", "v", "lo", "hi"]


def compress(lo: np.ndarray, hi: np.ndarray, permitted: float) -> np.ndarray:
    """Places of the tuples that stay: from each the farthest one that keeps the uncertainty between the two permitted; first and last stay."""
    n = len(lo)
    if permitted < 2 or n < 3:
        return np.arange(n)
    keep, at = [0], 0
    while at < n - 1:
        at = max(at + 1, int(np.searchsorted(hi, lo[at] + permitted, "right")) - 1)
        keep.append(at)
    return np.array(keep)


def merge(group: np.ndarray, part: np.ndarray, v: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(group, v, lo, hi): one summary per group, of all its parts at once. Rows come by group, part, lo.

    In the order of values the lower rank is the running sum of what each tuple's part gains with it, and so is the upper
    one, of the ranks that each part's next tuple still allows; so any number of parts takes one sort.
    """
    n = len(v)
    if not n:
        return group, v, lo, hi
    new = np.ones(n, dtype=bool)
    new[1:] = (group[1:] != group[:-1]) | (part[1:] != part[:-1])
    last = np.append(new[1:], True)
    gain = lo - np.where(new, 0, np.append(0, lo[:-1]))
    # the most ranks that the own part can have had before whatever follows this tuple
    after = np.where(last, hi, np.append(hi[1:], 0) - 1)
    rise = after - hi + 1
    order = np.lexsort((lo, part, v, group))
    g = group[order]
    heads = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
    size = np.diff(np.append(heads, n))

    def running(x: np.ndarray, start: np.ndarray | None = None) -> np.ndarray:
        c = np.cumsum(x)
        base = np.where(heads > 0, c[heads - 1], 0)
        return c - np.repeat(base if start is None else base - start, size)

    # parts whose first tuple is still to come may have had up to hi - 1 ranks as well
    first = np.add.reduceat(np.where(new, hi - 1, 0)[order], heads)
    low, high = running(gain[order]), running(rise[order], first) - after[order] + hi[order]
    return g, v[order], low, np.maximum(high, low)


def query(v: np.ndarray, lo: np.ndarray, hi: np.ndarray, heads: np.ndarray, q: float) -> tuple[np.ndarray, np.ndarray]:
    """Per summary (they begin at ``heads``): the value for quantile q, and how many ranks it may be off."""
    size = np.diff(np.append(heads, len(v)))
    total = hi[heads + size - 1]
    r = np.repeat(np.maximum(1, np.ceil(q * total - 1e-9)).astype(np.int64), size)
    off = np.maximum(np.maximum(r - lo, hi - r), 0)
    least = np.minimum.reduceat(off, heads)
    hit = np.flatnonzero(off == np.repeat(least, size))
    at = hit[np.searchsorted(hit, heads)]
    return v[at], least


def _heads(pdf: pd.DataFrame, columns: list[str]) -> np.ndarray:
    """Where runs of equal values in ``columns`` begin."""
    new = np.zeros(len(pdf), dtype=bool)
    if len(pdf):
        new[0] = True
    for c in columns:
        x = pdf[c].to_numpy() if pd.api.types.is_integer_dtype(pdf[c].dtype) else pd.factorize(pdf[c], use_na_sentinel=True)[0]
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def _local(eps: float, block: int = 1 << 18):
    """Values -> summaries. A task holds one block of values at a time and summarizes it as it comes: every (2 eps n)-th value, with its rank."""
    import pyspark

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        context = pyspark.TaskContext.get()
        part = (context.partitionId() if context else 0) << 32
        held: list[pd.DataFrame] = []
        rows = 0

        def flush(no: int) -> pd.DataFrame:
            pdf = pd.concat(held, ignore_index=True).sort_values([*KEYS, "value"], kind="stable", ignore_index=True)
            heads = _heads(pdf, KEYS)
            size = np.diff(np.append(heads, len(pdf)))
            n = np.repeat(size, size)
            rank = np.arange(len(pdf)) - np.repeat(heads, size) + 1
            step = np.maximum(1, (2 * eps * n).astype(np.int64))
            keep = ((rank - 1) % step == 0) | (rank == n)
            return pdf.loc[keep, KEYS].assign(part=np.int64(part + no), v=pdf["value"].to_numpy()[keep], lo=rank[keep], hi=rank[keep])

        blocks = 0
        for pdf in batches:
            held.append(pdf)
            rows += len(pdf)
            if rows >= block:
                yield flush(blocks)
                held, rows, blocks = [], 0, blocks + 1
        if rows:
            yield flush(blocks)

    return run


def _by_group(columns: list[str], finish: Callable[[pd.DataFrame, tuple], pd.DataFrame]):
    """Tuples sorted by ``columns``, source part and lo -> ``finish`` of the merged groups; a group may run over batches."""

    def done(held: list[pd.DataFrame]) -> pd.DataFrame:
        pdf = pd.concat(held, ignore_index=True) if len(held) > 1 else held[0].reset_index(drop=True)
        heads = _heads(pdf, columns)
        group = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(pdf))))
        merged = merge(group, *(pdf[c].to_numpy() for c in ("part", "v", "lo", "hi")))
        return finish(pdf.loc[heads, columns].reset_index(drop=True), merged)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_: list[pd.DataFrame] = []  # whole groups that wait, and the one that isn't over
        for pdf in batches:
            if not len(pdf):
                continue
            if open_:
                tail = open_[-1][columns].iloc[[-1]]
                same = len(_heads(pd.concat([tail, pdf[columns].iloc[[0]]], ignore_index=True), columns)) == 1
                heads = _heads(pdf, columns)
                cut = (int(heads[1]) if len(heads) > 1 else len(pdf)) if same else 0
                if cut:
                    open_.append(pdf.iloc[:cut])
                if cut < len(pdf):
                    yield done(open_)
                    open_ = []
                pdf = pdf.iloc[cut:].reset_index(drop=True)
                if not len(pdf):
                    continue
            last = int(_heads(pdf, columns)[-1])
            if last:
                yield done([pdf.iloc[:last]])
            open_ = [pdf.iloc[last:].reset_index(drop=True)]
        if open_:
            yield done(open_)

    return run


def _compressed(eps: float):
    """Merged groups -> their tuples, compressed by what ``eps`` permits."""

    def finish(keys: pd.DataFrame, merged: tuple) -> pd.DataFrame:
        g, v, lo, hi = merged
        heads = np.searchsorted(g, np.arange(len(keys)))
        ends = np.append(heads[1:], len(g))
        keep = np.ones(len(g), dtype=bool)
        for a, b in zip(heads.tolist(), ends.tolist(), strict=True):
            if 2 * eps * hi[b - 1] >= 2 and b - a > 2:
                keep[a:b] = False
                keep[a + compress(lo[a:b], hi[a:b], 2 * eps * hi[b - 1])] = True
        out = keys.iloc[g[keep]].reset_index(drop=True)
        return out.rename(columns={"bucket": "part"}).assign(v=v[keep], lo=lo[keep], hi=hi[keep])[[*KEYS, *_FIELDS]]

    return finish


def _as_percentiles(at: tuple[float, ...]):
    def finish(keys: pd.DataFrame, merged: tuple) -> pd.DataFrame:
        g, v, lo, hi = merged
        heads = np.searchsorted(g, np.arange(len(keys)))
        got = [query(v, lo, hi, heads, q) for q in at]
        worst = np.max([off for _, off in got], axis=0)
        return keys.assign(n=hi[np.append(heads[1:], len(g)) - 1], **{f"p{round(q * 100)}": x for q, (x, _) in zip(at, got, strict=True)}, rank_error=worst)

    return finish


def _parts(summary: DataFrame) -> int:
    """Parts of the key that has most: each part has one tuple of lo 1."""
    first = summary.where("lo = 1").groupBy(*KEYS).agg(F.countDistinct("part").alias("n"))
    return first.agg(F.max("n")).first()[0] or 0


def rolled(summary: DataFrame, least: float, most: float, fan: int = FAN) -> DataFrame:
    """Merge the parts of each key, ``fan`` at a time and level by level, until a key has at most ``fan`` of them.

    Every level compresses by a little more of the error from ``least`` to ``most``, so no task ever holds more than about
    ``fan`` summaries of one key, however many parts there are.
    """
    summary = materialize(summary, "summaries")
    parts = _parts(summary)
    counts = []
    while parts > fan:
        parts = -(-parts // fan)
        counts.append(parts)
    for level, buckets in enumerate(counts, 1):
        bucket = F.pmod(F.xxhash64("part"), F.lit(buckets)) if level == 1 else F.floor(F.col("part") / fan)
        at = summary.withColumn("bucket", bucket.cast("bigint")).repartition(*KEYS, "bucket").sortWithinPartitions(*KEYS, "bucket", "part", "lo")
        summary = at.mapInPandas(_by_group([*KEYS, "bucket"], _compressed(least + (most - least) * level / len(counts))), _TUPLES)
    return materialize(summary, "rolled") if counts else summary


def summaries(values: DataFrame, eps: float = EPS, fan: int = FAN) -> DataFrame:
    """(g0, g1, g2, metric, part, v, lo, hi): mergeable summaries, at most ``fan`` a key, from ``values`` (g0, g1, g2, metric, value).

    Each task summarizes its blocks of values with a quarter of ``eps``; the parts of a key are merged level by level
    up to three quarters. The rest is left for merging with those of other days or keys. Null values are left out.
    """
    return rolled(values.where("value is not null").mapInPandas(_local(eps / 4), _TUPLES), eps / 4, eps * 0.75, fan)


def percentiles(summary: DataFrame, at: tuple[float, ...] = (0.5, 0.9, 0.95, 0.99), eps: float = EPS, fan: int = FAN, few: bool = False) -> DataFrame:
    """(keys, n, p50, ..., rank_error): values at ``at`` of merged summaries; rank_error is the proven bound in ranks.

    The value at q is the one of rank ceil(q n). Summaries of several days or runs may be united before; give each its own
    ``part``. few: the summaries are as ``summaries`` gives them, so no key has more than ``fan``. An empty table gives no row.
    """
    fields = "g0 string, g1 string, g2 date, metric string, n bigint, " + ", ".join(f"p{round(q * 100)} double" for q in at) + ", rank_error bigint"
    s = (summary if few else rolled(summary, eps * 0.75, eps, fan)).repartition(*KEYS).sortWithinPartitions(*KEYS, "part", "lo")
    return s.mapInPandas(_by_group(KEYS, _as_percentiles(at)), fields)


def readings(runs: DataFrame) -> DataFrame:
    """(g0 model, g1 type, g2 day, metric, value) of the three measures; each id counts once, as last loaded. Null, negative and NaN readings are none."""
    one = (
        runs.where("id is not null")
        .groupBy("id")
        .agg(F.max(F.struct("loaded_at", "model", "type", "asked_at", F.col("seconds"), F.col("usage.prompt").alias("prompt"), F.col("usage.completion").alias("completion"))).alias("r"))
        .select("r.*")
    )
    long = one.select(
        F.col("model").alias("g0"),
        F.col("type").alias("g1"),
        F.to_date("asked_at").alias("g2"),
        F.explode(
            F.array(
                F.struct(F.lit("seconds").alias("metric"), F.col("seconds").alias("value")),
                F.struct(F.lit("prompt").alias("metric"), F.col("prompt").cast("double").alias("value")),
                F.struct(F.lit("completion").alias("metric"), F.col("completion").cast("double").alias("value")),
            )
        ).alias("m"),
    )
    return long.select("g0", "g1", "g2", "m.metric", "m.value").where("value >= 0 and not isnan(value)")


def true_ranks(values: DataFrame, found: DataFrame, at: tuple[float, ...] = (0.5, 0.9, 0.95, 0.99)) -> DataFrame:
    """(keys, n, rank_error, off): how many ranks the values of ``found`` are off at most, counted over all ``values``."""
    same = [F.col(f"v.{k}").eqNullSafe(F.col(f"f.{k}")) for k in KEYS]
    j = values.alias("v").join(found.alias("f"), same[0] & same[1] & same[2] & same[3]).select("f.*", F.col("v.value").alias("value"))
    names = [f"p{round(q * 100)}" for q in at]
    counts = [c.alias(f"{p}_{k}") for p in names for k, c in (("below", F.count_if(F.col("value") < F.col(p))), ("upto", F.count_if(F.col("value") <= F.col(p))))]
    g = j.groupBy(*KEYS, "n", "rank_error").agg(*counts)
    want = {p: F.greatest(F.lit(1), F.ceil(F.lit(q) * F.col("n") - 1e-9)) for p, q in zip(names, at, strict=True)}
    off = [F.greatest(F.col(f"{p}_below") + 1 - want[p], want[p] - F.col(f"{p}_upto"), F.lit(0)) for p in names]
    return g.select(*KEYS, "n", "rank_error", F.greatest(*off).cast("bigint").alias("off"))
