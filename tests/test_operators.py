import random

from pyspark.sql import functions as F

from clausemill.operators import agent, context, corpus, grounding, lexical, quantiles, ranking


def test_bm25_against_a_plain_loop(spark):
    import math

    docs = {1: "cash value of the loan", 2: "loan loan waiting period", 3: "cash", 4: None}
    df = spark.createDataFrame(list(docs.items()), "doc_id bigint, text string")
    post, stats = lexical.postings(df), lexical.corpus_stats(df)
    w = lexical.term_weights(post, stats)
    q = spark.createDataFrame([(7, "cash loan loan")], "qid bigint, text string")
    got = {r["id"]: r["score"] for r in lexical.scores(lexical.contributions(q, post, stats, F.col("idf_lucene"), w)).collect()}
    toks = {k: (v or "").split() for k, v in docs.items()}
    avg = sum(map(len, toks.values())) / 4
    for k, t in toks.items():
        s = 0.0
        for term in "cash loan loan".split():
            df_ = sum(term in x for x in toks.values())
            tf = t.count(term)
            s += math.log(1 + (4 - df_ + 0.5) / (df_ + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(t) / avg)) if tf else 0
        assert abs(got.get(k, 0.0) - s) < 1e-6


def test_round_robin_against_a_plain_loop(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for qid in range(60):
        lists = [rng.sample(range(8), 6) for _ in range(rng.choice((2, 3)))]
        rows += [(qid, n, r + 1, x) for n, li in enumerate(lists) for r, x in enumerate(li)]
        out = []
        for r in range(4):
            for li in lists:
                if li[r] not in out:
                    out.append(li[r])
        want[qid] = out
    got = ranking.round_robin(spark.createDataFrame(rows, "qid bigint, list int, rank int, item bigint"), 4).collect()
    for qid, items in want.items():
        assert [r["item"] for r in sorted((r for r in got if r["qid"] == qid), key=lambda r: r["position"])] == items


def test_budget_keeps_the_first_block_and_stops(spark):
    rows = [(1, 1, "x" * 50), (1, 2, "x" * 50), (1, 3, "y" * 30), (1, 4, "z" * 1)]
    df = spark.createDataFrame(rows, "qid bigint, seed_rank int, text string")
    assert sorted(r["seed_rank"] for r in context.budgeted(df, 40).collect()) == [1]
    assert sorted(r["seed_rank"] for r in context.budgeted(df, 80).collect()) == [1, 3]


def test_two_stage_tail_keeps_its_order(spark):
    df = spark.createDataFrame([(1, i, i, float(i)) for i in range(1, 6)], "qid bigint, id bigint, a int, s double")
    r = ranking.two_stage(df, "a", "s", 2).orderBy("rank").collect()
    assert [x["id"] for x in r] == [2, 1, 3, 4, 5]


def test_citation_kinds(spark):
    a = spark.createDataFrame([("r1", "满30岁能投吗", "等待期180日。[C1]给付40%。[C1]为60日。[C2]满30岁，另有7次。")], "id string, question string, answer string")
    b = spark.createDataFrame([("r1", "C1", "等待期180日", ["d1"]), ("r1", "C2", "无", ["d2"]), ("r1", "C3", "给付40%", ["d1"]), ("r1", "C4", "为60日", ["d9"])], "id string, cid string, text string, docs array<string>")
    got = {(r["kind"], r["fact"]) for r in grounding.citation_issues(a, b).collect()}
    assert got == {("imprecise", "40 %"), ("misattributed", "60 日"), ("uncited", None)}
    c = spark.createDataFrame([("r1", "", "等待期181日。[C1]")], "id string, question string, answer string")
    assert [r["kind"] for r in grounding.citation_issues(c, b).collect()] == ["absent"]


def test_headers_and_segments(spark):
    rows = [(1, "d", p, n, t) for p in range(1, 6) for n, t in enumerate((f"某某保险条款 第{p}页", f"正文{'甲乙丙丁'[p % 4]}内容"))]
    lines = spark.createDataFrame(rows, "unit_id bigint, doc_id string, page int, line_no int, line string")
    h = corpus.repeated_headers(lines)
    assert [r["key"] for r in h.collect()] == ["某某保险条款 第#页"]
    assert corpus.without_headers(lines, h).count() == 5
    s = corpus.segments(lines.withColumn("o", F.col("page") * 10 + F.col("line_no")), "doc_id", "o", F.col("line").startswith("某某"))
    assert s.agg(F.max("segment")).first()[0] == 5


def test_long_split_against_a_fold(spark):
    rng = random.Random(5)
    import re

    item = re.compile(r"^\s*(?:[（(]?[0-9一二三四五六七八九十]+[)）．.、]|[-•●])")
    for _ in range(15):
        lines = [rng.choice(("1．", "", "")) + "字" * rng.randint(1, 300) for _ in range(rng.randint(0, 12))]
        want, size = [], 0
        for t in lines:
            if size and (size >= 700 or (size >= 450 and item.search(t))):
                want.append(size)
                size = 0
            size += len(t)
        want += [size] if size else []
        assert spark.createDataFrame([(lines,)], "l array<string>").select(corpus.long_split(F.col("l")).alias("x")).first()["x"] == want


def test_exact_ranks_with_a_hot_group(spark):
    rows = [("hot", float(i % 97)) for i in range(1000)] + [("b", 3.0), ("b", None), (None, 1.0), (None, 2.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    r = quantiles.exact_ranks(df, "g", "v", 7).groupBy("g").agg(F.max("n").alias("n"), quantiles.at_rank("v", quantiles.nearest(0.5)).alias("p"), quantiles.median("v").alias("m")).collect()
    got = {x["g"]: (x["n"], x["p"], x["m"]) for x in r}
    hot = sorted(float(i % 97) for i in range(1000))
    assert got["hot"] == (1000, hot[499], (hot[499] + hot[500]) / 2) and got["b"] == (1, 3.0, 3.0) and got[None][0] == 2


def test_argument_validation(spark):
    t = [agent.Tool("calc", {"start": "STRING", "days": "BIGINT", "mode": "STRING"}, ("start", "days"), {"mode": ("a", "b")})]
    cases = {
        ("calc", '{"start": "2024-01-01", "days": 3}'): None, ("nope", "{}"): "unknown_tool", ("calc", "{"): "bad_json", ("calc", "[1]"): "not_object",
        ("calc", '{"start": "x"}'): "missing:days", ("calc", '{"start": "x", "days": 1, "z": 2}'): "unknown:z", ("calc", '{"start": "x", "days": true}'): "type:days",
        ("calc", '{"start": 5, "days": 1}'): "type:start", ("calc", '{"start": "x", "days": 1, "mode": "c"}'): "enum:mode",
    }
    df = spark.createDataFrame([(*k, v) for k, v in cases.items()], "n string, raw string, want string")
    for r in df.select("*", agent.validation_error(t, F.col("n"), F.col("raw")).alias("got")).collect():
        assert r["got"] == r["want"], r
    s = spark.createDataFrame([('{"a": 1, "b": 2}', '{"b": 2, "a": 1}')], "x string, y string")
    assert s.where(agent.signature(F.lit("t"), F.col("x")) == agent.signature(F.lit("t"), F.col("y"))).count() == 1


def test_guard_and_repeats(spark):
    s = spark.createDataFrame([("e", 1, 2, False), ("e", 2, 1, False), ("e", 3, 0, False), ("f", 5, 9, True)], "episode string, step int, severe int, forced boolean")
    assert {(r["episode"], r["step"], r["accepted"]) for r in agent.guarded(s).collect()} == {("e", 1, False), ("e", 2, True), ("f", 5, True)}
    c = spark.createDataFrame([("e", 1, "s", "boom"), ("e", 2, "s", None), ("e", 3, "s", None)], "episode string, step int, sig string, error string")
    assert {r["step"]: r["first_step"] for r in agent.marked_repeats(c).collect()} == {1: None, 2: None, 3: 2}
    k = spark.createDataFrame([("e", 1, "search", None, None), ("e", 2, "final", None, None), ("g", 1, None, None, None)], "episode string, step int, tool string, error string, first_step int")
    assert {r["episode"]: r["stop"] for r in agent.finished(k, 8, "final").collect()} == {"e": "submitted", "g": "text"}


def test_fusion_with_weight_zero_is_the_second_ranking(spark):
    df = spark.createDataFrame([(1, i, 6 - i, i) for i in range(1, 6)], "qid bigint, id bigint, rank_a int, rank_b int")
    f = df.withColumn("f", ranking.fused(None, 60, 0.0))
    assert [r["id"] for r in f.orderBy(F.desc("f"), "id").collect()] == [1, 2, 3, 4, 5]


def test_block_search_with_nulls_and_ties(spark):
    from clausemill.operators import dense

    rows = [(i, [1.0, 0.0] if i % 2 else [0.0, 1.0], "a" if i < 4 else "b") for i in range(8)] + [(8, None, "a"), (None, [1.0, 0.0], "a")]
    c = spark.createDataFrame(rows, "id bigint, vector array<double>, g string")
    q = c.where("id in (1, 8)").withColumnRenamed("id", "qid")
    got = [(r["qid"], r["id"], r["score"], r["rank"]) for r in dense.cosine_top(q, c, 3).orderBy("qid", "rank").collect()]
    assert got == [(1, 1, 1.0, 1), (1, 3, 1.0, 2), (1, 5, 1.0, 3)]
    best = [(r["id"], r["g"]) for r in dense.cosine_top(q, c, 5, best_of="g").orderBy("rank").collect()]
    assert best == [(1, "a"), (5, "b")]
    assert {r["id"] for r in dense.cosine_top(q, c, 9, scope="g").collect()} == {0, 1, 2, 3}
    pairs = spark.createDataFrame([(1, 0), (1, 7), (1, 8)], "qid bigint, id bigint")
    assert {r["id"]: r["score"] for r in dense.pair_scores(pairs, q, c).collect()} == {0: 0.0, 7: 1.0, 8: None}


def test_facts_of_named_chunks(spark):
    runs = spark.createDataFrame([("r", [("C1", ["k1", "k2", "none"]), ("C2", None)])], "id string, context array<struct<cid:string,chunk_ids:array<string>>>")
    chunks = spark.createDataFrame([("k1", "d1", "等待期30日"), ("k2", "d2", "给付50%，30日")], "chunk_key string, doc_id string, text string")
    r = grounding.context_facts(runs, chunks).collect()
    assert len(r) == 1 and set(r[0]["held"]) == {"30 日", "50 %"} and set(r[0]["docs"]) == {"d1", "d2"}
