"""Registered queries of the core operators."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import reports, retrieval, runs, texts

_ALL: dict[str, tuple] = {**retrieval.CATALOGUE, **texts.CATALOGUE, **runs.CATALOGUE, **reports.CATALOGUE}


#: columns that are int on the SQL side; everywhere else integers are bigint there
_INT = ("hit", "label", "k", "line_no", "page_start", "page_end", "first_line", "added")


def _wide(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """Integer columns as bigint, so that both engines give the same schema."""

    @wraps(f)
    def run(spark: SparkSession, d: str) -> DataFrame:
        df = f(spark, d)
        return df.withColumns({c: F.col(c).cast("bigint") for c, t in df.dtypes if t == "int"}) if any(t == "int" for _, t in df.dtypes) else df

    return run


def _wide_sql(name: str, sql: str) -> str:
    ints = [c for c in _INT if c in _INT_OF.get(name, ())]
    return f"select * replace ({', '.join(f'cast({c} as bigint) as {c}' for c in ints)}) from ({sql}) as x" if ints else sql


_INT_OF = {
    "question_ranks": ("hit",), "rrf_weight_sweep": ("k",), "best_per_group_search": ("label",), "neighbor_expansion": ("added",), "line_chunks": ("line_no",),
    "unit_texts": ("page_start", "page_end"), "clause_segments": ("first_line",),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _wide(f) for name, (f, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: _wide_sql(name, sql) for name, (_, sql) in _ALL.items() if sql}
