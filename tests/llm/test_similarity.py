import random

import numpy as np

from clausemill.llm import blocks, dart, neardup, overlap
from clausemill.llm.components import components
from clausemill.llm.near import Banding
from clausemill.llm.textnorm import plain


def test_dart_minhash_estimates_weighted_jaccard():
    rng = np.random.default_rng(5)
    e = np.arange(50).astype(np.uint64)
    x, y = rng.choice([0, 0.5, 1, 3.0, 6.5], 50), rng.choice([0, 0.5, 1, 3.0, 6.5], 50)
    docs = np.concatenate([np.zeros((x > 0).sum(), int), np.ones((y > 0).sum(), int)])
    s = dart.signatures(docs, np.concatenate([e[x > 0], e[y > 0]]), np.concatenate([x[x > 0], y[y > 0]]), 2, 8192)
    assert abs((s[0] == s[1]).mean() - np.minimum(x, y).sum() / np.maximum(x, y).sum()) < 0.02


def test_signature_does_not_depend_on_the_batch():
    a = dart.signatures(np.array([0, 0, 0]), np.array([1, 2, 3], dtype=np.uint64), None, 1, 64)
    b = dart.signatures(np.array([0, 1, 1, 1, 2]), np.array([9, 1, 2, 3, 7], dtype=np.uint64), None, 3, 64)
    assert (a[0] == b[1]).all()


def grams(t):
    return {t[i : i + 2] for i in range(len(t) - 1)} or {t}


def groups(texts):
    ids, parent = list(texts), {i: i for i in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in ids:
        for j in ids:
            if i < j:
                a, b = grams(plain(texts[i])), grams(plain(texts[j]))
                if len(a & b) >= 0.5 * len(a | b):
                    a, b = find(i), find(j)
                    parent[max(a, b)] = min(a, b)
    return {(i, j) for i in ids for j in ids if i < j and find(i) == find(j)}


def texts(n=60, seed=2):
    rng = random.Random(seed)
    word = lambda: "".join(chr(rng.randint(0x4E00, 0x5FFF)) for _ in range(40))
    out, base = {}, [word() for _ in range(n // 5)]
    for i in range(n):
        t = list(rng.choice(base))
        for _ in range(rng.randint(0, 6)):
            t[rng.randrange(len(t))] = chr(rng.randint(0x4E00, 0x5FFF))
        out[i] = "".join(t)
    return out


def test_groups_against_brute_force(spark):
    t = texts()
    t[100], t[101], t[102], t[103] = t[0], "，".join(t[0]), "一", "一。"
    rows = [(i, x, "q") for i, x in t.items()] + [(0, t[0], "q"), (200, None, None), (201, " 。", None), (None, "x", None)]
    df = spark.createDataFrame(rows, "id bigint, text string, norm string")
    g = neardup.near_duplicates(df, Banding(b=128))
    got = {(r["id_a"], r["id_b"]) for r in neardup.group_pairs(g).collect()}
    assert got == groups(t)
    assert g.count() == len(t) and neardup.near_duplicates(df.limit(0)).count() == 0


def test_hot_buckets_lose_no_link(spark):
    """Buckets larger than ``small`` go by their first text and by components: the groups stay those of all pairs."""
    t = texts(90, 4)
    df = spark.createDataFrame(list(t.items()), "id bigint, text string")
    got = {(r["id_a"], r["id_b"]) for r in neardup.group_pairs(neardup.near_duplicates(df, Banding(b=128, small=2))).collect()}
    assert got == groups(t)


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (7, 8), (8, 7), (9, 9), (None, 1)] + [(100, 101 + i) for i in range(50)] + [(i, i + 1) for i in range(200, 260)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got[4] == 1 and got[8] == 7 and 9 not in got and got[150] == 100 and got[260] == 200
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_winnowing_guarantee():
    how = overlap.Winnow()
    rng = random.Random(1)
    for _ in range(50):
        common = "".join(chr(rng.randint(0x4E00, 0x9000)) for _ in range(how.k + how.w - 1))
        a, b = ("".join(chr(rng.randint(0x4E00, 0x9000)) for _ in range(9)) + common + "尾" * rng.randint(0, 5) for _ in range(2))
        assert set(overlap.fingerprints(a, how)[0].tolist()) & set(overlap.fingerprints(b, how)[0].tolist())
    assert len(overlap.fingerprints("", how)[0]) == 0 and len(overlap.fingerprints("短", how)[0]) == 1


def test_chain_and_extension():
    assert overlap.chain([1, 5, 9, 3], [2, 6, 4, 9]) in ([(1, 2), (5, 6)], [(1, 2), (3, 9)], [(1, 2), (9, 4)])
    a, b = "前言甲乙丙丁戊己庚", "甲乙丙丁戊己庚后记"
    assert overlap.extend(a, b, [(4, 2)], 3) == (7, 7)


def test_cross_overlaps_against_brute_force(spark):
    t = texts(60, 9)
    a, b = {f"b{i}": x for i, x in t.items() if i % 2}, {f"d{i}": x for i, x in t.items() if not i % 2}
    a["b900"] = b["d900"] = "短问"
    extra = [("b901", None, 1), ("b902", "", 1), (None, "x", 1)]
    fa = spark.createDataFrame([(k, v, 1) for k, v in a.items()] + extra + [("b1", a["b1"], 1)], "id string, text string, norm int")
    fb = spark.createDataFrame([(k, v, 1) for k, v in b.items()], "id string, text string, norm int")
    want = set()
    for i, x in a.items():
        for j, y in b.items():
            p, q = grams(plain(x)), grams(plain(y))
            if len(p & q) >= 0.5 * len(p | q):
                want.add((i, j))
    how = overlap.Winnow()
    found = overlap.cross_overlaps(fa, fb, how)
    got = {(r["id_a"], r["id_b"]) for r in found.collect()}
    assert got <= want and len(got) >= 0.97 * len(want) and ("b900", "d900") in got
    assert all(0 < r["coverage_a"] <= 1 for r in found.collect())
    assert overlap.cross_overlaps(fa, fb.limit(0), how).count() == 0
    held = fb.selectExpr("id", "'s' as split", "'w' as writer")
    r = overlap.overlap_report(found, held).first()
    assert r["records"] == len(b) and r["overlapping"] == len({j for _, j in got})


def edited(text, rng):
    """With substitutions, insertions, deletions and moved pieces, until about half to nine tenths of the pairs stay."""
    x = list(text)
    for _ in range(rng.randint(1, max(1, len(x) // 7))):
        k = rng.randrange(len(x))
        x[k : k + rng.randint(0, 2)] = [chr(rng.randint(0x4E00, 0x5FFF)) for _ in range(rng.randint(0, 2))]
    if rng.random() < 0.3:
        c = rng.randrange(len(x))
        x = x[c:] + x[:c]
    return "".join(x)


def test_recall_of_proposals_at_all_lengths():
    """With the shipped defaults, of random edits that leave a similarity of 0.5 or more: a common seed and a sketch that agrees."""
    rng, how = random.Random(12), overlap.Winnow()
    for n in (20, 25, 30, 40, 48, 55, 70, 100):
        pairs = []
        while len(pairs) < 400:
            t = "".join(chr(rng.randint(0x4E00, 0x5FFF)) for _ in range(n))
            u = edited(t, rng)
            if len(u) > 3 and len(grams(t) & grams(u)) >= 0.5 * len(grams(t) | grams(u)):
                pairs.append((t, u))
        hit = [bool(set(overlap.fingerprints(t, how)[0].tolist()) & set(overlap.fingerprints(u, how)[0].tolist())) for t, u in pairs]
        assert sum(hit) >= 0.95 * len(hit), (n, sum(hit) / len(hit))
        flat = [x for p in pairs for x in p]
        rows, values = overlap.grams(flat, 2)
        sk = overlap.sketch(overlap.signatures(rows, overlap.mix(values), None, len(flat), 64 * how.words), how.words)
        apart = np.bitwise_count((sk[0::2] ^ sk[1::2]).view(np.uint64)).sum(1)
        assert (64 * how.words - apart >= how.sketch_bits).mean() >= 0.995


def test_seeds_of_a_hot_question_lose_no_pair(spark):
    """Edits spread over the variants of one question leave short common runs only, in seeds of more than ``matches`` pairs."""
    rng = random.Random(3)
    base = [chr(rng.randint(0x4E00, 0x5FFF)) for _ in range(60)]

    def variant():
        t = list(base)
        for _ in range(4):
            t[rng.randrange(len(t))] = chr(rng.randint(0x4E00, 0x5FFF))
        return "".join(t)

    a, b = {f"b{i}": variant() for i in range(40)}, {f"d{i}": variant() for i in range(40)}
    how = overlap.Winnow()
    seeds = {t: set(overlap.fingerprints(t, how)[0].tolist()) for t in (*a.values(), *b.values())}
    want = {(i, j) for i, x in a.items() for j, y in b.items() if seeds[x] & seeds[y] and len(grams(x) & grams(y)) >= 0.5 * len(grams(x) | grams(y))}
    frames = [spark.createDataFrame(list(t.items()), "id string, text string") for t in (a, b)]
    got = {(r["id_a"], r["id_b"]) for r in overlap.cross_overlaps(*frames, how).collect()}
    assert got == want and len(want) > 1500


def test_links_of_a_hot_group_are_all_counted(spark):
    rng = random.Random(6)
    base = [chr(rng.randint(0x4E00, 0x5FFF)) for _ in range(40)]
    t = {}
    for i in range(90):
        x = list(base)
        for _ in range(rng.randint(1, 9)):
            x[rng.randrange(len(x))] = chr(rng.randint(0x4E00, 0x5FFF))
        t[i] = "".join(x)
    g = {i: grams(x) for i, x in t.items()}
    want = {i: sum(len(g[i] & g[j]) >= 0.5 * len(g[i] | g[j]) for j in g if j != i) for i in g}
    df = spark.createDataFrame(list(t.items()), "id bigint, text string")
    r = neardup.near_duplicates(df, Banding(b=128, small=2)).collect()
    assert max(want.values()) > 50
    assert {x["id"]: x["class_links"] for x in r} == want


def test_blocks_meet_each_other_once(spark):
    df = spark.range(70).selectExpr("id % 2 as k", "id as rid")
    rows = blocks.facing(df, df.where("rid < 30"), "k", 8).collect()
    met = [(x, y) for r in rows for x in r["x_rid"] for y in r["y_rid"]]
    assert len(rows) > 2 and len(met) == len(set(met)) and set(met) == {(x, y) for x in range(70) for y in range(30) if x % 2 == y % 2}
    sets = [np.array([1, 2, 3]), np.array([9]), np.array([3, 2, 7, 8])]
    assert blocks.common(sets, sets[:2], 2).tolist() == [[3, 0], [0, 1], [2, 0]]
