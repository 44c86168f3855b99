"""Numeric facts of answers against the text they cite."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import citation_spans, fact_pairs
from ..session import materialize


def citation_issues(answers: DataFrame, blocks: DataFrame) -> DataFrame:
    """(id, span, fact, kind) of facts that the cited text doesn't hold; facts of the question aren't checked.

    answers: (id, question, answer); blocks: (id, cid, docs array<string>) with their ``text`` or the facts ``held`` in it. kind: ``uncited`` (one per span, fact
    null), ``absent`` (in no block), ``imprecise`` (in a block that shares a document with the cited ones), else
    ``misattributed``. Null answers have no spans; blocks of one (id, cid) are one block. Everything is an equi-join on
    (id, fact) or (id, cid); nothing is paired within an answer but its own spans and blocks.
    """
    a = answers.select("id", fact_pairs(F.col("question")).alias("asked"), F.posexplode(citation_spans(F.col("answer"))).alias("span", "s"))
    a = a.select("id", "span", F.col("s.cited").alias("cited"), "asked", fact_pairs(F.col("s.text")).alias("held"))
    # written once: a filter on the facts would otherwise work them out anew in every branch
    a = materialize(a, "spans").select("id", "span", "cited", F.array_except("held", "asked").alias("facts")).where(F.size("facts") > 0)
    uncited = a.where(F.size("cited") == 0).select("id", "span", F.lit(None).cast("string").alias("fact"), F.lit("uncited").alias("kind"))
    b = blocks if "held" in blocks.columns else blocks.withColumn("held", fact_pairs(F.col("text")))
    b = materialize(b.select("id", "cid", "docs", "held"), "held")
    cited = a.where(F.size("cited") > 0)
    named = cited.select("id", "span", F.explode("cited").alias("cid")).join(b.select("id", "cid", "docs", "held"), ["id", "cid"], "left")
    support = named.groupBy("id", "span").agg(F.flatten(F.collect_list("held")).alias("supported"), F.array_distinct(F.flatten(F.collect_list("docs"))).alias("cited_docs"))
    facts = cited.select("id", "span", F.explode("facts").alias("fact")).join(support, ["id", "span"]).where(~F.array_contains("supported", F.col("fact")))
    holders = b.select("id", F.explode("held").alias("fact"), "docs")
    j = facts.join(holders, ["id", "fact"], "left").groupBy("id", "span", "fact").agg(
        F.count("docs").alias("n"), F.bool_or(F.arrays_overlap("docs", "cited_docs")).alias("near")
    )
    kind = F.when(F.col("n") == 0, "absent").when(F.coalesce("near", F.lit(False)), "imprecise").otherwise("misattributed")
    return uncited.union(j.select("id", "span", "fact", kind.alias("kind")))


def context_facts(runs: DataFrame, chunks: DataFrame) -> DataFrame:
    """(id, cid, docs, held) of the chunks that each context block of a run names; chunks: (chunk_key, doc_id, text).

    A chunk's facts are found once, however many blocks name it. A number that ends one chunk and a unit that
    begins the next make no fact. Unknown chunks hold none.
    """
    c = runs.select("id", F.explode("context").alias("c")).select("id", "c.cid", F.explode("c.chunk_ids").alias("chunk_key"))
    f = materialize(chunks.select("chunk_key", "doc_id", fact_pairs(F.col("text")).alias("held")), "facts")
    j = c.join(f, "chunk_key")
    return j.groupBy("id", "cid").agg(F.array_distinct(F.flatten(F.collect_list("held"))).alias("held"), F.collect_set("doc_id").alias("docs"))
