"""Models as functions, caches, graders, prompts, principals; sinks that go with them."""

import json
import uuid

import numpy as np
from pyspark.sql import functions as F

from clausemill.functions import text as X
from clausemill.operators import models
from clausemill.sources import files


def _encoder():
    def make():
        return lambda texts: np.array([[len(t), t.count("a"), 0.0] for t in texts])

    return make


encoder = _encoder()  # a nested function goes to the workers by value


def test_vectors_are_normal(spark, tmp_path):
    df = spark.createDataFrame([(1, "aab", "x"), (2, "", "x"), (3, None, "x"), (None, "a", "x")], "id bigint, text string, vector string")
    got = {r["id"]: r["vector"] for r in models.embedded(df, encoder, 1).collect()}
    assert set(got) == {1, 2} and abs(np.linalg.norm(got[1]) - 1) < 1e-6 and got[2] == [0.0, 0.0, 0.0]
    assert models.embedded(df.limit(0), encoder).count() == 0
    files.write_matrix(models.embedded(df, encoder), str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m" / "meta")).first().asDict() == {"rows": 2, "least_dim": 3, "most_dim": 3}


def test_pair_scores(spark):
    df = spark.createDataFrame([(1, 5, "ab", "abc"), (1, 6, "ab", None), (2, 5, "x", "")], "qid bigint, id bigint, question string, text string")
    got = {(r["qid"], r["id"]): r["score"] for r in models.pair_scores(df, lambda: lambda q, t: [len(a) - len(b) for a, b in zip(q, t)]).collect()}
    assert got == {(1, 5): -1.0, (2, 5): 1.0}


def test_cached_calls(spark):
    df = spark.createDataFrame([(1, "m", "one"), (2, "m", "one"), (3, "m", "two"), (4, "m", "three"), (5, None, "x")], "id bigint, model string, prompt string")
    key = {r["prompt"]: r["key"] for r in df.select("prompt", models.request_key().alias("key")).collect()}
    cache = spark.createDataFrame([(key["two"], json.dumps({"text": "known", "finish": "stop"}))], "key string, response string")
    replies, fresh = models.cached_calls(df, cache, lambda: lambda m, p: {"text": p.upper(), "finish": "length" if p == "three" else "stop"})
    got = {r["id"]: (json.loads(r["response"])["text"], r["cached"]) for r in replies.collect()}
    assert got == {1: ("ONE", False), 2: ("ONE", False), 3: ("known", True), 4: ("THREE", False)}
    assert [r["key"] for r in fresh.collect()] == [key["one"]] and len(key["one"]) == 24


def test_graded(spark):
    rows = [(1, 'so {"correctness": "partial", "faithful": true, "keypoints": [{"point": "a", "covered": true}, {"point": "b", "covered": false}]}'), (2, "no json"), (3, '{"correctness": "great", "faithful": 1}'), (4, None)]
    a = models.graded(spark.createDataFrame(rows, "id bigint, text string"))
    got = {r["id"]: (r["verdict"], r["faithful"], r["covered"], r["points"]) for r in a.collect()}
    assert got[1] == ("partial", True, 1, 2) and got[2][:2] == (None, None) and got[3][0] is None and got[4][0] is None
    b = spark.createDataFrame([(1, "partial", False), (2, None, None), (9, "correct", True)], "id bigint, verdict string, faithful boolean")
    assert tuple(models.grader_agreement(a, b).first()) == (2, 2, 1)


def test_prompts_and_principals(spark):
    rows = spark.createDataFrame([(1, "why"), (2, None)], "id bigint, question string")
    prompts = spark.createDataFrame([("v1", "Q{id}: {question}"), ("v2", "x")], "version string, template string")
    assert [r["prompt"] for r in models.prompted(rows, prompts, "v1").orderBy("id").collect()] == ["Q1: why", "Q2: "]
    assert models.prompted(rows, prompts, "v9").first()["prompt"] is None
    q = spark.createDataFrame([(1, "p1"), (2, None), (3, "px")], "id bigint, principal string")
    p = spark.createDataFrame([("p1", "staff", "t")], "principal string, role string, tenant string")
    assert [(r["id"], r["role"], r["tenant"]) for r in models.principal_of(q, p).orderBy("id").collect()] == [(1, "staff", "t"), (2, "system", None), (3, "system", None)]


def test_rendered(spark):
    b = spark.createDataFrame([(1, 2, "C2", None, "two"), (1, 1, "C1", "doc p1", "one")], "qid bigint, nth int, cid string, label string, text string")
    assert models.rendered(b).first()["context"] == "[C1] doc p1\none\n\n[C2] \ntwo"


def test_write_back_and_optional(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", None), (2, "b", "old")], "id bigint, text string, dropped string")
    out = files.write_back(rows, spark.createDataFrame([(1, "near", 0.95)], "id bigint, dropped string, sim double"), str(tmp_path / "v2"))
    assert [tuple(r) for r in out.select("id", "text", "dropped", "sim").orderBy("id").collect()] == [(1, "a", "near", 0.95), (2, "b", "old", None)]
    assert files.optional(spark, str(tmp_path / "none"), "id bigint, verdict string").count() == 0


def test_scalars(spark):
    t = spark.createDataFrame([("2024-02-29", {"a": 2}), ("2023-02-29", {}), (None, None)], "t string, m map<string,int>")
    r = t.select(X.iso_date(F.col("t")).alias("d"), X.named_uuid(F.lit("example")).alias("u"), X.count_of(F.col("m"), F.lit("a")).alias("n"), X.insufficient(F.col("t")).alias("i")).collect()
    assert str(r[0]["d"]["day"]) == "2024-02-29" and r[0]["d"]["error"] is None and r[1]["d"]["error"] == r[2]["d"]["error"] == "bad_date"
    assert r[0]["u"] == str(uuid.uuid5(uuid.NAMESPACE_DNS, "example"))
    assert [x["n"] for x in r] == [2, 0, 0] and not any(x["i"] for x in r)
    amounts = spark.createDataFrame([("15万元，150,000元，2.5万，共3项，1234567890123456789",)], "t string").select(X.amounts(F.col("t")).alias("a")).first()["a"]
    assert sorted(amounts) == [3, 25000, 150000]
