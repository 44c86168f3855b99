import hashlib
import json

from pyspark.sql import types as T

from clausemill.sources import files
from clausemill.streaming import events


def test_readers(spark, tmp_path):
    (tmp_path / "r.csv").write_text("doc_id,pages\nа,3\nb,x\n", encoding="utf-8")
    rows = files.registry(spark, str(tmp_path / "r.csv"), "doc_id string, pages int").orderBy("doc_id").collect()
    assert [r["pages"] for r in rows] == [None, 3]
    (tmp_path / "l.jsonl").write_text('{"a": 1}\n{"a": 2, "b": "x"}\n')
    assert {(r["a"], r["b"]) for r in files.json_lines(spark, str(tmp_path / "l.jsonl"), "a int, b string").collect()} == {(1, None), (2, "x")}
    (tmp_path / "k.json").write_text(json.dumps({"p1": {"role": "staff"}, "p2": {}}))
    got = files.keyed_json(spark, str(tmp_path / "k.json"), T.StructType([T.StructField("role", T.StringType())])).collect()
    assert {(r["id"], r["role"]) for r in got} == {("p1", "staff"), ("p2", None)}
    (tmp_path / "w.txt").write_text("# head\n a \n\na\nb\n")
    assert {r["term"] for r in files.word_list(spark, str(tmp_path / "w.txt")).collect()} == {"a", "b"}


def test_checksums_and_alignment(spark, tmp_path):
    d = tmp_path / "bin"
    d.mkdir()
    (d / "x.bin").write_bytes(b"abc")
    want = spark.createDataFrame([("x.bin", hashlib.sha256(b"abc").hexdigest().upper()), ("y.bin", "0")], "file string, sha256 string")
    got = {r["file"]: r["status"] for r in files.verified(files.checksums(spark, str(d)), want).collect()}
    assert got == {"x.bin": "ok", "y.bin": "missing"}
    a, b = spark.range(3), spark.range(1, 5)
    assert files.aligned(a, b, "id") == (1, 2)


def test_cache_and_sinks(spark, tmp_path):
    req = spark.createDataFrame([("m", "q1"), ("m", "q1"), ("m", "q2")], "model string, q string")
    empty = spark.createDataFrame([], "cache_key string, response string")
    hits, misses = files.cached_calls(req, empty, ["model", "q"])
    assert hits.count() == 0 and misses.count() == 2
    from pyspark.sql import functions as F

    files.append_cache(misses.withColumn("response", F.lit("r")).withColumn("finish_reason", F.when(F.col("q") == "q2", "length").otherwise("stop")), str(tmp_path / "cache"))
    hits, misses = files.cached_calls(req, spark.read.parquet(str(tmp_path / "cache")), ["model", "q"])
    assert hits.count() == 2 and misses.count() == 1
    files.write_json_lines(spark.range(5), str(tmp_path / "out"), ["id"])
    assert spark.read.json(str(tmp_path / "out")).count() == 5
    p = str(tmp_path / "r.md")
    files.write_report(p, "# A\n")
    open(p, "a").write("\n## Conclusion\nby hand\n")
    files.write_report(p, "# B\n")
    assert open(p).read() == "# B\n\n## Conclusion\nby hand\n"
    assert "a｜b" in files.markdown_table(spark.createDataFrame([("a|b",)], "x string"))


def test_stream_of_events(spark, sf, tmp_path):
    src = tmp_path / "in"
    spark.read.parquet(f"{sf}/events.parquet").coalesce(1).write.parquet(str(src))
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    q = events.error_rates(events.read_events(spark, str(src))).writeStream.format("memory").queryName("rates").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert spark.table("rates").count() > 0
