"""Every core query against its SQL on the smallest tables, and on empty ones."""

import glob
import math
import os

import duckdb
import numpy as np
import pytest

from clausemill.plans import catalogue, retrieval

Q, SQL = catalogue.queries(), catalogue.oracle_sql()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return str(v)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for p in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, duck, sf, name):
    df = Q[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted([plain(r[c]) for c in columns] for r in df.collect())
    cur = duck.execute(SQL[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == columns
    assert sorted([plain(r[names.index(c)]) for c in columns] for r in cur.fetchall()) == got


@pytest.mark.parametrize("name", sorted(set(Q) - set(SQL)))
def test_runs(spark, sf, name):
    assert Q[name](spark, sf).count() >= 0


@pytest.fixture(scope="module")
def empty(spark, sf, tmp_path_factory):
    d = tmp_path_factory.mktemp("empty")
    for p in glob.glob(f"{sf}/*.parquet"):
        spark.read.parquet(p).limit(0).write.parquet(f"{d}/{os.path.basename(p)}")
    return str(d)


@pytest.mark.parametrize("name", ["bm25_topk", "dense_topk", "citation_check", "latency_quantiles", "clause_segments", "routing_policies", "greedy_dedup", "context_blocks"])
def test_empty_tables(spark, empty, name):
    assert Q[name](spark, empty).count() == 0


@pytest.mark.parametrize("least", [0.3, 0.9])
def test_greedy_dedup_judges_every_vector(spark, sf, least):
    """By brute force, at the threshold of the query and at one that many vectors of the tables reach."""
    rows = sorted((r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").where("vec_id is not null and embedding is not null").collect())
    v = np.array([e for _, e in rows], dtype=float)
    kept, want = [], {}
    for i, (vec_id, _) in enumerate(rows):
        want[vec_id] = not kept or bool((np.round(v[kept] @ v[i], 6) < least).all())
        if want[vec_id]:
            kept.append(i)
    got = retrieval.greedy_dedup(spark, sf, least).collect()
    assert {r["id"]: r["kept"] for r in got} == want and len(got) == len(want)
    assert least > 0.3 or (False in want.values() and True in want.values())
