"""Calls of models that are given as functions: encoders, pair scorers, graders and text models behind a cache.

A model is any picklable function on a batch; it is made once per task (``make``), so that weights are loaded on the
executor, and sees a bounded number of rows at a time. Nothing here knows a model or a network.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import first_json


def _parts(pdf: pd.DataFrame, batch: int) -> Iterator[pd.DataFrame]:
    for at in range(0, len(pdf), batch):
        yield pdf.iloc[at : at + batch]


def embedded(texts: DataFrame, make: Callable[[], Callable[[list[str]], np.ndarray]], batch: int = 16) -> DataFrame:
    """(id, vector) of texts (id bigint, text): unit vectors of an encoder. A null text gives no row, a zero vector stays zero."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = make()
        for pdf in batches:
            for part in _parts(pdf, batch):
                v = np.asarray(encode(part["text"].tolist()), dtype=np.float64)
                v = v / np.where((size := np.linalg.norm(v, axis=1, keepdims=True)) > 0, size, 1.0)
                yield pd.DataFrame({"id": part["id"].to_numpy(), "vector": list(v.astype(np.float32))})

    return texts.where("id is not null and text is not null").select("id", "text").mapInPandas(run, "id bigint, vector array<float>")


def pair_scores(pairs: DataFrame, make: Callable[[], Callable[[list[str], list[str]], np.ndarray]], batch: int = 64) -> DataFrame:
    """(qid, id, score) of candidate pairs (qid bigint, id bigint, question, text) by a cross-encoder; raw scores. A pair with a null text gives no row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = make()
        for pdf in batches:
            for part in _parts(pdf, batch):
                s = np.asarray(score(part["question"].tolist(), part["text"].tolist()), dtype=np.float64)
                yield pd.DataFrame({"qid": part["qid"].to_numpy(), "id": part["id"].to_numpy(), "score": s})

    ok = pairs.where("qid is not null and id is not null and question is not null and text is not null").select("qid", "id", "question", "text")
    return ok.mapInPandas(run, "qid bigint, id bigint, score double")


def request_key(model: str = "model", prompt: str = "prompt") -> F.Column:
    """Content address of a request: the first 24 hex digits of the hash of its canonical JSON."""
    return F.substring(F.sha2(F.to_json(F.struct(F.col(model).alias("model"), F.col(prompt).alias("prompt"))), 256), 1, 24)


def cached_calls(requests: DataFrame, cache: DataFrame, make: Callable[[], Callable[[str, str], dict]]) -> tuple[DataFrame, DataFrame]:
    """Replies of requests (id, model, prompt), and what is new for the cache (key, response).

    Equal requests are one call; those in the cache are none. A reply is a dict with ``text`` and ``finish``; replies that were cut off
    (finish is ``length``) are returned, never stored. Requests without model or prompt get no reply. The misses should be written
    once (``session.materialize``) before both results are used, or they are called twice.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = make()
        for pdf in batches:
            yield pd.DataFrame({"key": pdf["key"], "response": [json.dumps(call(m, p), ensure_ascii=False) for m, p in zip(pdf["model"], pdf["prompt"], strict=True)]}).astype(object)

    r = requests.where("model is not null and prompt is not null").withColumn("key", request_key())
    known = cache.where("key is not null").groupBy("key").agg(F.max("response").alias("response"))
    misses = r.groupBy("key").agg(F.first("model").alias("model"), F.first("prompt").alias("prompt")).join(known, "key", "left_anti")
    from ..session import materialize

    called = materialize(misses.select("key", "model", "prompt").mapInPandas(run, "key string, response string"), "calls")
    replies = r.join(known.withColumn("cached", F.lit(True)).unionByName(called.withColumn("cached", F.lit(False))), "key")
    fresh = called.where(F.coalesce(F.get_json_object("response", "$.finish"), F.lit("")) != "length")
    return replies.select("id", "key", "response", "cached"), fresh


VERDICTS = ("correct", "partial", "incorrect")


def graded(replies: DataFrame) -> DataFrame:
    """(id, verdict, faithful, covered, points) of a grader's replies (id, text): the first object in the text; what isn't valid gives nulls, an unknown verdict is none."""
    v = replies.select("id", first_json(F.col("text")).alias("v"))
    verdict = F.try_variant_get("v", "$.correctness", "string")
    points = F.try_variant_get("v", "$.keypoints", "array<variant>")
    return v.select(
        "id", F.when(verdict.isin(*VERDICTS), verdict).alias("verdict"), F.try_variant_get("v", "$.faithful", "boolean").alias("faithful"),
        F.size(F.filter(points, lambda p: F.coalesce(F.try_variant_get(p, "$.covered", "boolean"), F.lit(False)))).alias("covered"), F.size(points).alias("points"),
    )


def grader_agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: ids that two graders both judged, and on how many they agree by verdict and by faithfulness; a null agrees with null."""
    j = a.select("id", F.col("verdict").alias("va"), F.col("faithful").alias("fa")).join(b.select("id", F.col("verdict").alias("vb"), F.col("faithful").alias("fb")), "id")
    return j.agg(F.count("*").alias("judged"), F.count_if(F.col("va").eqNullSafe(F.col("vb"))).alias("same_verdict"), F.count_if(F.col("fa").eqNullSafe(F.col("fb"))).alias("same_faithful"))


def prompted(rows: DataFrame, prompts: DataFrame, version: str) -> DataFrame:
    """``rows`` with ``prompt``: the template of a version (prompts: version, template) with {column} replaced by the row's value, null as the empty text. An unknown version gives a null prompt."""
    t = prompts.where(F.col("version") == version).agg(F.max("template").alias("prompt"))
    out = rows.crossJoin(t)  # one row
    for c in rows.columns:
        out = out.withColumn("prompt", F.replace("prompt", F.lit("{" + c + "}"), F.coalesce(F.col(c).cast("string"), F.lit(""))))
    return out


def principal_of(questions: DataFrame, principals: DataFrame, default: str = "system") -> DataFrame:
    """``questions`` (principal) with the role and tenant of who asks; unnamed or unknown ones get the default role and no tenant."""
    p = principals.where("principal is not null").groupBy("principal").agg(F.max(F.struct("role", "tenant")).alias("_p"))
    return questions.join(p, "principal", "left").select(*questions.columns, F.coalesce("_p.role", F.lit(default)).alias("role"), F.col("_p.tenant").alias("tenant"))


def rendered(blocks: DataFrame) -> DataFrame:
    """(qid, context): the blocks of a question (qid, nth, cid, label, text) as one text, in order, each under its mark and label."""
    one = F.concat(F.lit("["), F.col("cid"), F.lit("] "), F.coalesce("label", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")))
    b = blocks.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("nth", one.alias("t")))).alias("b"))
    return b.select("qid", F.array_join(F.transform("b", lambda x: x["t"]), "\n\n").alias("context"))
