"""Session helpers shared by all operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir``. Only a session on one machine may do without it and gets a folder of its own; on a cluster that would lose rows, so it raises."""
    got = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not got:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all executors share (master {master})")
        got = f"file://{tempfile.mkdtemp(prefix='clausemill-')}"
        spark.conf.set("spark.checkpoint.dir", got)
    return got.rstrip("/")


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def materialize(df: DataFrame, label: str = "t") -> DataFrame:
    """Write ``df`` into the shared folder and read it back: lineage ends at files that outlive an executor.

    The files go when the application ends, or with ``clear`` once a query's result is consumed.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/clausemill/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    p, fs = _path(spark, path)
    fs.deleteOnExit(p)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Delete all that this application has written with ``materialize``; frames that still read it can't be used any more."""
    p, fs = _path(spark, f"{shared_dir(spark)}/clausemill/{spark.sparkContext.applicationId}")
    fs.delete(p, True)


def spread(df: DataFrame, *key: str) -> DataFrame:
    """``df`` by hash of ``key`` over a fixed number of partitions, before work that is heavy for its bytes.

    AQE sizes partitions by bytes and would leave a few tasks to do all of it; a number that is asked for is kept.
    """
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    return df.repartition(n, *key)
