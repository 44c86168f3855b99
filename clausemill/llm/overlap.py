"""Problem 5: the same or nearly the same records across splits, by winnowing fingerprints."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, spread
from .blocks import facing
from .dart import mix, signatures, sketch
from .near import agreeing_bits, classes
from .textnorm import codes, grams


@dataclass(frozen=True)
class Winnow:
    """k: characters of a gram; w: window, so every common run of k + w - 1 characters has a common seed; short: characters up to which a text is fingerprinted with fine_k and fine_w as well, as its edits leave shorter runs in common; matches: texts of one side times those of the other up to which a seed is joined row by row, above it is compared in blocks; least: similarity of a reported pair; sketch_bits: agreeing bits, of the 64 * words of a min-hash sketch of the character pairs, that a pair needs before it is looked at (four standard deviations under the mean at ``least``)."""

    k: int = 8
    w: int = 4
    short: int = 48
    fine_k: int = 4
    fine_w: int = 3
    matches: int = 400
    least: float = 0.5
    words: int = 6
    sketch_bits: int = 254


def winnowed(a: np.ndarray, k: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and positions of the selected minima of a text's codes, rightmost on ties; a text shorter than a gram is its own seed."""
    k = min(k, len(a))
    if not k:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    h = np.full(len(a) - k + 1, k, dtype=np.uint64)
    for j in range(k):
        h = mix((h + np.uint64(j + 1)) * np.uint64(0x9E3779B97F4A7C15) ^ a[j : len(a) - k + 1 + j])
    w = min(w, len(h))
    win = np.lib.stride_tricks.sliding_window_view(h, w)[:, ::-1]
    at = np.unique(np.arange(len(win)) + w - 1 - win.argmin(1))
    return h[at], at.astype(np.int64)


def fingerprints(text: str, how: Winnow) -> tuple[np.ndarray, np.ndarray]:
    """Seeds of a text and where they begin; a short text has finer ones too."""
    a = codes(text).astype(np.uint64)
    h, at = winnowed(a, how.k, how.w)
    if len(a) > how.short or len(a) <= how.fine_k:
        return h, at
    fine, fine_at = winnowed(a, how.fine_k, how.fine_w)
    return np.concatenate([h, fine]), np.concatenate([at, fine_at])


def _sketch(how: Winnow) -> list[str]:
    return [f"s{i}" for i in range(how.words)]


def _seeds(how: Winnow):
    names = ["rid", *_sketch(how), "h"]

    def some(rids: list[int], texts: list[str]) -> pd.DataFrame:
        rows, values = grams(texts, 2)
        sk = sketch(signatures(rows, mix(values), None, len(texts), 64 * how.words), how.words)
        out: list[list] = [[] for _ in names]
        for i, (rid, text) in enumerate(zip(rids, texts, strict=True)):
            h = np.unique(fingerprints(text, how)[0]).view(np.int64)
            n = len(h)
            for column, x in zip(out, (np.full(n, rid), *(np.full(n, x) for x in sk[i]), h), strict=True):
                column.append(x)
        return pd.DataFrame({n: np.concatenate(x) for n, x in zip(names, out, strict=True)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rids, texts, at = pdf["rid"].tolist(), pdf["norm"].tolist(), 0
            while at < len(texts):
                to, size = at, 0
                while to < len(texts) and (to == at or size + len(texts[to]) < 40_000):
                    size += len(texts[to])
                    to += 1
                yield some(rids[at:to], texts[at:to])
                at = to

    return run


def seeds(reps: DataFrame, how: Winnow) -> DataFrame:
    """(rid, norm) -> (rid, s0, ..., h): each seed of a text once, s0 and on the sketch."""
    return spread(reps, "rid").mapInPandas(_seeds(how), "rid bigint, " + ", ".join(f"{c} bigint" for c in (*_sketch(how), "h")))


def _sketched(how: Winnow):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                apart = np.zeros((len(row.x_rid), len(row.y_rid)), dtype=np.int16)
                for c in _sketch(how):
                    apart += np.bitwise_count(getattr(row, f"x_{c}").view(np.uint64)[:, None] ^ getattr(row, f"y_{c}").view(np.uint64)[None, :])
                i, j = np.nonzero(64 * how.words - apart >= how.sketch_bits)
                yield pd.DataFrame({"a": row.x_rid[i], "b": row.y_rid[j]})

    return run


def _matched(left: DataFrame, right: DataFrame, how: Winnow) -> DataFrame:
    """(a, b), each once: texts with a common seed whose sketches agree. A seed of more than ``matches`` pairs is compared in blocks, all its pairs like those of any other."""
    both = materialize(left.groupBy("h").agg(F.count("*").alias("n")).join(right.groupBy("h").agg(F.count("*").alias("m")), "h"), "common")
    few, many = both.where(F.col("n") * F.col("m") <= how.matches).select("h"), both.where(F.col("n") * F.col("m") > how.matches).select("h")
    x, y = left.join(few, "h", "left_semi").alias("x"), right.join(few, "h", "left_semi").alias("y")
    rare = x.join(y, (F.col("x.h") == F.col("y.h")) & (agreeing_bits("x", "y", how.words) >= how.sketch_bits)).select(F.col("x.rid").alias("a"), F.col("y.rid").alias("b"))
    hot = facing(left.join(many, "h", "left_semi"), right.join(many, "h", "left_semi"), "h").mapInPandas(_sketched(how), "a bigint, b bigint")
    return rare.union(hot).distinct()


def chain(pa: list[int], pb: list[int]) -> list[tuple[int, int]]:
    """Longest list of seeds that ascend in both texts."""
    pts = sorted(set(zip(pa, pb, strict=True)), key=lambda p: (p[0], -p[1]))
    ends: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for i, (_, y) in enumerate(pts):
        k = bisect_left(ends, y)
        back.append(at[k - 1] if k else -1)
        if k == len(ends):
            ends.append(y)
            at.append(i)
        else:
            ends[k], at[k] = y, i
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(pts[i])
        i = back[i]
    return out[::-1]


def extend(a: str, b: str, seeds_: list[tuple[int, int]], k: int) -> tuple[int, int]:
    """Characters of each text that the chained seeds cover, each seed extended both ways while the texts agree."""
    ca, cb = np.zeros(len(a), dtype=bool), np.zeros(len(b), dtype=bool)
    for x, y in seeds_:
        if x < len(a) and y < len(b) and ca[x] and cb[y]:
            continue
        lo = 0
        while x - lo > 0 and y - lo > 0 and a[x - lo - 1] == b[y - lo - 1]:
            lo += 1
        hi = 0
        while x + hi < len(a) and y + hi < len(b) and a[x + hi] == b[y + hi]:
            hi += 1
        ca[x - lo : x + hi] = True
        cb[y - lo : y + hi] = True
    return int(ca.sum()), int(cb.sum())


def _grams(t: str) -> set[str]:
    return {t[i : i + 2] for i in range(len(t) - 1)} or {t}


def common_seeds(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[list[int], list[int]]:
    """Positions of the seeds that two texts share, every occurrence with every other."""
    at: dict[int, list[int]] = {}
    for h, p in zip(a[0].tolist(), a[1].tolist(), strict=True):
        at.setdefault(h, []).append(p)
    hits = [(p, q) for h, q in zip(b[0].tolist(), b[1].tolist(), strict=True) for p in at.get(h, ())]
    return [p for p, _ in hits], [q for _, q in hits]


def _align(how: Winnow):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            known: dict[str, tuple[np.ndarray, np.ndarray]] = {}  # of one batch
            for a, b, ta, tb in zip(*(pdf[c] for c in ("a", "b", "ta", "tb")), strict=True):
                ga, gb = _grams(ta), _grams(tb)
                both = len(ga & gb)
                s = both / (len(ga) + len(gb) - both)
                if s >= how.least:
                    for t in (ta, tb):
                        if t not in known:
                            known[t] = fingerprints(t, how)
                    ca, cb = extend(ta, tb, chain(*common_seeds(known[ta], known[tb])), how.k)
                    rows.append((a, b, s, ca / len(ta), cb / len(tb)))
            yield pd.DataFrame(rows, columns=["a", "b", "similarity", "coverage_a", "coverage_b"])

    return run


def cross_overlaps(train: DataFrame, held: DataFrame, how: Winnow = Winnow()) -> DataFrame:
    """(id_a, id_b, similarity, coverage_a, coverage_b): pairs of ``train`` and ``held`` (id string, text) that are alike.

    Texts are compared in plain form (width, white space, punctuation ignored); equal ones form one class on each side,
    so copies cost one comparison and are expanded only in the result. Seeds shared across the sides give the candidates; their
    collinear chain, extended by alignment, gives the coverage; similarity is the exact share of common character
    pairs. Null ids, null texts and texts without letter or digit are no cases; repeated rows count once; an empty
    side gives no row; other columns are never read.
    """

    def side(df: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        keyed = df.where("id is not null and text is not null").select("id", "text").distinct()
        keyed = materialize(keyed.withColumn("n", F.xxhash64("id", "text")), name)
        norm = classes(keyed.select(F.col("n").alias("id"), "text")).withColumnRenamed("id", "n")
        member = materialize(keyed.select("id", "n").join(norm, "n").groupBy("id", "norm").agg(F.count("*").alias("c")).drop("c"), name)
        # two 64-bit hashes decide on equal forms no better than one here: the forms of a pair are compared themselves
        reps = materialize(member.groupBy("norm").agg(F.min(F.xxhash64("norm")).alias("rid")), name)
        return member.join(reps, "norm").select("id", "rid"), reps

    ma, ra = side(train, "train")
    mb, rb = side(held, "held")
    found = _matched(materialize(seeds(ra.select("rid", "norm"), how), "seeds"), materialize(seeds(rb.select("rid", "norm"), how), "seeds"), how)
    cand = found.join(ra.select(F.col("rid").alias("a"), F.col("norm").alias("ta")), "a").join(rb.select(F.col("rid").alias("b"), F.col("norm").alias("tb")), "b")
    alike = cand.mapInPandas(_align(how), "a bigint, b bigint, similarity double, coverage_a double, coverage_b double")
    alike = materialize(alike, "alike")
    return (
        alike.join(ma.select(F.col("rid").alias("a"), F.col("id").alias("id_a")), "a")
        .join(mb.select(F.col("rid").alias("b"), F.col("id").alias("id_b")), "b")
        .groupBy("id_a", "id_b")
        .agg(F.max("similarity").alias("similarity"), F.max("coverage_a").alias("coverage_a"), F.max("coverage_b").alias("coverage_b"))
    )


def overlap_report(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """(split, writer, records, overlapping, share, mean_coverage) per split and source of ``held`` (id, split, writer)."""
    own = held.where("id is not null").groupBy("id").agg(F.min("split").alias("split"), F.min("writer").alias("writer"))
    hit = pairs.groupBy(F.col("id_b").alias("id")).agg(F.max("coverage_b").alias("coverage"))
    j = own.join(hit, "id", "left")
    return j.groupBy("split", "writer").agg(
        F.count("*").alias("records"),
        F.count("coverage").alias("overlapping"),
        (F.count("coverage") / F.count("*")).alias("share"),
        F.avg("coverage").alias("mean_coverage"),
    )
