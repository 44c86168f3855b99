"""Readers and writers of plain files: registries, JSON lines, keyed JSON, word lists, binary files with checksums, reports."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StringType, StructType


def registry(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """CSV with a header and a given schema; a row that doesn't fit it gets nulls rather than failing the scan."""
    return spark.read.schema(schema).csv(path, header=True, mode="PERMISSIVE")


def json_lines(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """One object per line. The schema is never inferred: optional fields that a file lacks are null columns."""
    return spark.read.schema(schema).json(path)


def keyed_json(spark: SparkSession, path: str, schema: StructType, key: str = "id") -> DataFrame:
    """An object of objects as rows, its keys as column ``key``."""
    text = spark.read.text(path, wholetext=True)
    parsed = text.select(F.from_json("value", MapType(StringType(), schema)).alias("m"))
    return parsed.select(F.explode("m").alias(key, "v")).select(key, "v.*")


def word_list(spark: SparkSession, path: str) -> DataFrame:
    """(term): trimmed lines without blank ones and # comments, each once."""
    t = spark.read.text(path).select(F.trim("value").alias("term"))
    return t.where((F.col("term") != "") & ~F.col("term").startswith("#")).distinct()


def checksums(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(file, bytes, sha256) of the files of a folder; content is hashed where it is read."""
    b = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return b.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def verified(found: DataFrame, expected: DataFrame) -> DataFrame:
    """(file, status): ok, changed or missing for every expected file (file, sha256)."""
    j = expected.select("file", F.col("sha256").alias("want")).join(found.select("file", "sha256"), "file", "left")
    return j.select("file", F.when(F.col("sha256").isNull(), "missing").when(F.lower("want") == F.col("sha256"), "ok").otherwise("changed").alias("status"))


def aligned(left: DataFrame, right: DataFrame, key: str) -> tuple[int, int]:
    """Keys that only the left, and only the right side has: (0, 0) means both describe the same rows."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.join(b, key, "left_anti").count(), b.join(a, key, "left_anti").count()


def cached_calls(requests: DataFrame, cache: DataFrame, key_cols: list[str]) -> tuple[DataFrame, DataFrame]:
    """(hits, misses) of requests by content key: the first 24 hex digits of the SHA-256 of the key columns. Misses are distinct, so no call is made twice.

    cache: (cache_key, response).
    """
    keyed = requests.withColumn("cache_key", F.substring(F.sha2(F.to_json(F.struct(*key_cols)), 256), 1, 24))
    hits = keyed.join(cache.select("cache_key", "response"), "cache_key")
    misses = keyed.join(cache.select("cache_key"), "cache_key", "left_anti").dropDuplicates(["cache_key"])
    return hits, misses


def append_cache(calls: DataFrame, path: str) -> None:
    """Append (cache_key, response, finish_reason) to the cache table; cut replies are never stored."""
    calls.where("finish_reason is null or finish_reason <> 'length'").select("cache_key", "response").write.mode("append").parquet(path)


def write_json_lines(df: DataFrame, path: str, order: list[str]) -> None:
    """JSON lines in a fixed order: range-sorted files that read in name order give the same bytes on every run."""
    df.orderBy(*order).write.mode("overwrite").option("lineSep", "\n").json(path)


def markdown_table(df: DataFrame, most: int = 200) -> str:
    """A small result as a Markdown table; a bar in a cell becomes a full-width one. A larger result is refused, not cut."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")

    def cell(v: object) -> str:
        return "" if v is None else str(v).replace("|", "｜").replace("\n", " ")

    head = "| " + " | ".join(df.columns) + " |\n|" + "---|" * len(df.columns)
    return "\n".join([head, *("| " + " | ".join(cell(v) for v in r) + " |" for r in rows)]) + "\n"


def write_report(path: str, body: str, heading: str = "## Conclusion") -> None:
    """Write a report; the part from ``heading`` on that someone wrote by hand into an earlier one is kept."""
    kept = ""
    if os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            old = f.read()
        at = old.find("\n" + heading)
        kept = old[at:] if at >= 0 else ""
    with open(path, "w", encoding="utf-8", newline="\n") as f:
        f.write(body.rstrip("\n") + "\n" + kept)


def write_matrix(vectors: DataFrame, path: str, id_col: str = "id", vector_col: str = "vector") -> None:
    """Vectors by id as Parquet, beside them what they are (rows, dimensions) as one JSON line: ids and vectors can't get out of step."""
    vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector")).write.mode("overwrite").parquet(f"{path}/vectors")
    v = vectors.sparkSession.read.parquet(f"{path}/vectors")
    v.agg(F.count("*").alias("rows"), F.min(F.size("vector")).alias("least_dim"), F.max(F.size("vector")).alias("most_dim")).coalesce(1).write.mode("overwrite").json(f"{path}/meta")


def write_back(rows: DataFrame, decisions: DataFrame, path: str, key: str = "id") -> DataFrame:
    """``rows`` with the columns of ``decisions`` (key and others; one row per key) as a new version at ``path``; rows without a decision keep what they had, or null. The source isn't touched."""
    new = [c for c in decisions.columns if c != key]
    d = decisions.select(key, F.lit(True).alias("_hit"), *[F.col(c).alias(f"_{c}") for c in new])
    j = rows.join(d, key, "left")
    old = {c: F.col(c) if c in rows.columns else F.lit(None) for c in new}
    j.select(*[c for c in rows.columns if c not in new], *[F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(old[c]).alias(c) for c in new]).write.mode("errorifexists").parquet(path)
    return rows.sparkSession.read.parquet(path)


def optional(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines at ``path``, or an empty frame of the schema where nothing is there: for the optional side of a left join."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return spark.read.schema(schema).json(path)
    return spark.createDataFrame([], schema)
