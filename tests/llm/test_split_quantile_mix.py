import random
import time

import numpy as np
from pyspark.sql import functions as F

from clausemill.llm import mixing, quantile, split

LIMITS = [("body", 50, 10), ("guide", 20, 5), (None, 3, 1)]
UNITS = "unit_id bigint, section string, lines array<struct<page:int,line:string>>, loaded_at int, text string"


def unit(i, section, lines, at=1):
    return (i, section, None if lines is None else [None if t == "NULL" else (1, t) for t in lines], at, "clash")


def test_pieces_round_trip(spark):
    rng = random.Random(3)
    body = ["".join(rng.choice("甲乙丙丁。，；ab ") for _ in range(rng.randint(0, 30))) for _ in range(20)]
    rows = [
        unit(1, "body", body), unit(1, "body", body, 2), unit(2, "body", ["字" * 51]), unit(3, "body", ["字" * 50]), unit(4, "guide", ["字" * 400]), unit(5, "body", None), unit(6, "body", []),
        unit(7, "body", [None, "", None]), unit(8, None, ["字" * 99]), unit(9, "none", ["字" * 99]), unit(10, "guide", ["end of", "line " * 9]), unit(11, "body", ["𠀀" * 60]), unit(12, "body", ["x" * 50000]),
    ]
    units, limits = spark.createDataFrame(rows, UNITS), spark.createDataFrame(LIMITS, "section string, max_chars int, overlap_chars int")
    got = split.split_oversized(units, limits).orderBy("unit_id", "piece_no").collect()
    assert {r["unit_id"] for r in got} == {1, 2, 4, 10, 11, 12}
    size = {"body": (50, 10), "guide": (20, 5)}
    for i, section, lines, *_ in rows:
        mine = [r for r in got if r["unit_id"] == i]
        if mine:
            top, lap = size[section]
            whole = "".join(r["text"][r["lead_chars"] :] for r in mine)
            assert whole.replace(" ", "") == "".join((x and x[1]) or "" for x in lines).replace(" ", "")
            for k, r in enumerate(mine):
                assert 0 < r["n_chars"] == len(r["text"]) <= top and r["lead_chars"] <= lap and (k == 0) == (r["start"] == 0)
                assert r["text"][: r["lead_chars"]] == whole[r["start"] - r["lead_chars"] : r["start"]]
    assert split.split_oversized(units.limit(0), limits).count() == 0 and split.split_oversized(units, limits.limit(0)).count() == 0


def test_cuts_stand_behind_strong_boundaries(spark):
    u = spark.createDataFrame([unit(1, "body", ["一二三四五六七八九十一二三四五六七八九十一二三四五六。七八九十，一二三四五六七八九十一二三四五六七"])], UNITS)
    r = split.split_oversized(u, spark.createDataFrame([("body", 40, 0)], "section string, max_chars int, overlap_chars int")).orderBy("piece_no").collect()
    assert r[0]["text"].endswith("。")


def exact_off(values, got, q):
    v = np.sort(values)
    r = max(1, int(np.ceil(q * len(v) - 1e-9)))
    lo, hi = np.searchsorted(v, got, "left") + 1, np.searchsorted(v, got, "right")
    return 0 if lo <= r <= hi else min(abs(lo - r), abs(hi - r))


def summary(values, eps):
    n = len(values)
    rank = np.arange(1, n + 1)
    keep = ((rank - 1) % max(1, int(2 * eps * n)) == 0) | (rank == n)
    return values[keep], rank[keep], rank[keep]


def merged(parts):
    part = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
    return quantile.merge(np.zeros(len(part), dtype=int), part, *(np.concatenate([p[i] for p in parts]) for i in range(3)))[1:]


def test_merged_summaries_keep_the_bound():
    rng = np.random.default_rng(2)
    for eps in (0.01, 0.05):
        parts = [np.sort(rng.choice([rng.normal(0, 1, n), np.round(rng.pareto(1, n), 1)])) for n in (1000, 10, 3000, 1, 500)]
        s = [summary(p, eps / 4) for p in parts]
        m = merged([merged(s[:2]), merged(s[2:])])
        values = np.concatenate(parts)
        assert m[2][-1] == len(values) and m[1][0] == 1 and (np.diff(m[1]) > 0).all()
        keep = quantile.compress(m[1], m[2], 2 * (eps / 2) * len(values))
        c = [x[keep] for x in m]
        assert len(c[0]) < len(m[0]) and c[2][-1] == len(values)
        for q in (0.0, 0.01, 0.5, 0.9, 0.99, 1.0):
            (got,), (bound,) = quantile.query(*c, np.array([0]), q)
            assert exact_off(values, got, q) <= bound <= eps / 2 * len(values) + 1


def test_groups_merge_side_by_side():
    rng = np.random.default_rng(4)
    values = [np.sort(rng.integers(0, 50, n).astype(float)) for n in (1, 7, 300, 2)]
    rows = [(g, p, v, i + 1) for g, x in enumerate(values) for p in range(3) for i, v in enumerate(x[p::3])]
    g, p, v, r = (np.array(c) for c in zip(*rows))
    mg, mv, lo, hi = quantile.merge(g, p, v, r, r)
    for k, x in enumerate(values):
        assert (mv[mg == k] == x).all() and (lo[mg == k] == np.arange(1, len(x) + 1)).all() and (hi == lo).all()


def test_ten_thousand_parts_of_one_key(spark):
    """Level by level, fan parts at a time; the true ranks stay within the bound, and so does the time."""
    rng = np.random.default_rng(5)
    per = 20
    values = np.sort(rng.lognormal(0, 1, (10_000, per)), axis=1)
    cols = {"part": np.repeat(np.arange(10_000), per), "v": values.ravel(), "lo": np.tile(np.arange(1, per + 1), 10_000)}
    import pandas as pd

    pdf = pd.DataFrame(cols).assign(hi=lambda x: x["lo"], g0="k", g1=None, g2=None, metric="m")[["g0", "g1", "g2", "metric", "part", "v", "lo", "hi"]]
    df = spark.createDataFrame(pdf, quantile._TUPLES)
    start = time.time()
    (row,) = quantile.percentiles(df).collect()
    assert time.time() - start < 60 and row["n"] == values.size and 0 < row["rank_error"] <= 0.005 * values.size + 1
    for q, c in ((0.5, "p50"), (0.9, "p90"), (0.95, "p95"), (0.99, "p99")):
        assert exact_off(values.ravel(), row[c], q) <= row["rank_error"]


def test_percentiles_of_frames(spark):
    rng = np.random.default_rng(3)
    hot = np.round(rng.lognormal(1, 2, 20000), 2)
    rows = [("hot", "t", "m", float(x)) for x in hot] + [("one", "t", "m", 5.0), (None, "t", "m", 1.0), (None, "t", "m", 2.0), ("n", "t", "m", None)]
    df = spark.createDataFrame(rows, "g0 string, g1 string, metric string, value double").withColumn("g2", F.lit(None).cast("date")).select("g0", "g1", "g2", "metric", "value").repartition(5)
    r = {x["g0"]: x for x in quantile.percentiles(quantile.summaries(df, 0.01)).collect()}
    assert set(r) == {"hot", "one", None} and r["one"]["p99"] == 5.0 and r[None]["p50"] == 1.0
    for q, c in ((0.5, "p50"), (0.9, "p90"), (0.99, "p99")):
        assert exact_off(hot, r["hot"][c], q) <= r["hot"]["rank_error"] <= 0.01 * len(hot) + 1
    assert quantile.percentiles(quantile.summaries(df.limit(0))).count() == 0


def test_readings(spark):
    rows = [("a", 1, "m", "t", None, 5.0, (3, None, None)), ("a", 2, "m", "t", None, 5.0, (3, None, None)), ("b", 1, None, "t", None, -1.0, None), ("c", 1, "m", "t", None, float("nan"), (-4, 7, 1)), (None, 1, "m", "t", None, 1.0, None)]
    df = spark.createDataFrame(rows, "id string, loaded_at int, model string, type string, asked_at timestamp, seconds double, usage struct<prompt:bigint,completion:bigint,reasoning:bigint>")
    assert sorted((r["metric"], r["value"]) for r in quantile.readings(df).collect()) == [("completion", 7.0), ("prompt", 3.0), ("seconds", 5.0)]


def test_flight_keeps_both_sums():
    rng = random.Random(1)
    size = [rng.choice((1, 5, 5, 40, 1000)) for _ in range(500)]
    for pi in (0.3, 0.01, 0.97):
        p = mixing.flight([pi] * 500, size, [rng.random() for _ in size])
        assert sum(0 < x < 1 for x in p) <= 2
        assert abs(sum(p) - 500 * pi) < 1e-6 and abs(sum(a * b for a, b in zip(p, size, strict=True)) - pi * sum(size)) < 1e-5


def test_inclusion_probabilities_are_kept():
    rng = random.Random(4)
    hits = np.zeros(12)
    for _ in range(4000):
        p = mixing.flight([0.4] * 12, [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 50, 60], [rng.random() for _ in range(12)])
        hits += np.array(p)
    assert np.abs(hits / 4000 - 0.4).max() < 0.04


def test_selection_meets_quotas_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 50)
    rng = random.Random(7)
    rows = [(i, "a", rng.randint(1, 90)) for i in range(400)] + [(1000 + i, "b", rng.randint(1, 90)) for i in range(30)] + [(5000, "zero", 3)] + [(6000, "other", 9)]
    units = spark.createDataFrame(rows, "doc_id bigint, source string, tokens bigint")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.4, 3), ("zero", 0.0, 1), ("none", 0.1, 2), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    q = mixing.quotas(units, targets)
    sel = mixing.balanced_selection(units, q)
    r = {x["source"]: x for x in mixing.mix_shares(sel, q).collect()}
    assert r["b"]["capped"] and r["b"]["tokens_selected"] == 3 * r["b"]["available"] and r["b"]["most_copies"] == 3
    assert abs(r["a"]["tokens_selected"] - r["a"]["quota"]) <= 90 and r["none"]["tokens_selected"] == 0 and r["zero"]["docs_selected"] == 0
    assert sel.groupBy("doc_id").count().where("count > 1").count() == 0
    assert mixing.balanced_selection(units.limit(0), mixing.quotas(units.limit(0), targets)).count() == 0


def test_what_counts_for_the_mix(spark):
    docs = spark.createDataFrame([(1, "a", "x y", 9), (2, "a", None, 9), (3, "a", "  　\n", 9), (4, None, "x", 9), (5, "b", "", 9)], "doc_id bigint, source string, text string, tokens int")
    assert [(r["doc_id"], r["tokens"]) for r in mixing.sized(docs).collect()] == [(1, 2)]


def test_boundary_in_the_first_half_and_many_pieces(spark):
    text = "短句子。" + "a" * 17 + "。"
    rows = [unit(1, "guide", [text]), unit(2, "body", ["字" * 60_000])]
    limits = spark.createDataFrame([("guide", 20, 0), ("body", 50, 10)], "section string, max_chars int, overlap_chars int")
    got = split.split_oversized(spark.createDataFrame(rows, UNITS), limits).orderBy("unit_id", "piece_no").collect()
    assert [r["text"] for r in got if r["unit_id"] == 1] == ["短句子。", "a" * 17 + "。"]
    two = [r for r in got if r["unit_id"] == 2]
    assert len(two) == 1500 and all(r["n_chars"] == r["lead_chars"] + 40 for r in two) and two[7]["lead_chars"] == 10 and two[-1]["start"] == 59_960
