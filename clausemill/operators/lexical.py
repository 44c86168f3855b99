"""BM25 over an inverted index kept as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens


def postings(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, term, tf, dl): one row per term of a text, with its count and the text's token count. Null texts have none."""
    one = docs.select(F.col(id_col).alias("id"), tokens(F.col(text_col)).alias("t"))
    return one.select("id", F.size("t").alias("dl"), F.explode("t").alias("term")).groupBy("id", "term", "dl").agg(F.count("*").alias("tf"))


def corpus_stats(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """One row: n_docs, avgdl. Texts without a token count as length 0."""
    return docs.select(F.size(tokens(F.col(text_col))).alias("dl")).agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"))


def term_weights(post: DataFrame, stats: DataFrame, epsilon: float = 0.25) -> DataFrame:
    """(term, df, idf_lucene, idf_okapi). Negative okapi values become epsilon times the mean over all terms."""
    return frequency_weights(post.groupBy("term").agg(F.count("*").alias("df")), stats, epsilon)


def frequency_weights(frequencies: DataFrame, stats: DataFrame, epsilon: float = 0.25) -> DataFrame:
    """The same from (term, df)."""
    t = frequencies.crossJoin(stats.select("n_docs"))  # one row of statistics
    ratio = (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)
    t = t.select("term", "df", F.ln(1 + ratio).alias("idf_lucene"), F.ln(ratio).alias("raw"))
    mean = t.agg(F.avg("raw").alias("mean"))
    return t.crossJoin(mean).select("term", "df", "idf_lucene", F.when(F.col("raw") >= 0, F.col("raw")).otherwise(epsilon * F.col("mean")).alias("idf_okapi"))


def contributions(queries: DataFrame, post: DataFrame, stats: DataFrame, idf: Column, weights: DataFrame, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(qid, id, term, contribution): each query token that a text holds; a token that occurs twice in the query counts twice.

    Only postings of query terms are touched: the equi-join on ``term`` is the inverted index, skew of frequent terms
    is left to AQE.
    """
    q = queries.select("qid", F.explode(tokens(F.col("text"))).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("qtf"))
    w = weights.select("term", idf.alias("idf"))
    hit = q.join(w, "term").join(post, "term").crossJoin(stats.select("avgdl"))  # one row of statistics
    norm = F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl"))
    return hit.select("qid", "id", "term", (F.col("qtf") * F.col("idf") * F.col("tf") * (k1 + 1) / norm).alias("contribution"))


def scores(contribution: DataFrame, digits: int = 6) -> DataFrame:
    """(qid, id, score), rounded before ranking so that ties are ties on every engine."""
    return contribution.groupBy("qid", "id").agg(F.round(F.sum("contribution"), digits).alias("score"))


def top(scored: DataFrame, k: int | None, by: str = "score") -> DataFrame:
    """The k best per query (all, if None) with their rank; ties go to the smaller id."""
    w = Window.partitionBy("qid").orderBy(F.desc(by), "id")
    ranked = scored.withColumn("rank", F.row_number().over(w))
    return ranked if k is None else ranked.where(F.col("rank") <= k)
