"""Replay of tool episodes: registry, argument validation, repeats, guard, forced last round.

A policy proposes calls; what follows from them is data processing and is done for all live episodes of a step at once.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Tool:
    """A tool by name: its arguments with their JSON type (STRING, BIGINT, BOOLEAN, ...), which of them must be there, and allowed values."""

    name: str
    types: dict[str, str]
    required: tuple[str, ...] = ()
    allowed: dict[str, tuple[str, ...]] = field(default_factory=dict)


def validation_error(tools: list[Tool], name: Column, raw: Column) -> Column:
    """The first rule that a call breaks: unknown_tool, bad_json, not_object, missing:a, unknown:a, enum:a, type:a; null for a good call.

    A boolean is no number and a number no string: types are those of the JSON itself.
    """
    v = F.try_parse_json(raw)
    checks = F.when(~name.isin([t.name for t in tools]), "unknown_tool").when(v.isNull(), "bad_json").when(~F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), "not_object")
    keys = F.json_object_keys(raw)
    for t in tools:
        mine = name == t.name
        for a in t.required:
            checks = checks.when(mine & ~F.array_contains(keys, a), f"missing:{a}")
        extra = F.array_except(keys, F.array(*[F.lit(a) for a in t.types]) if t.types else F.array().cast("array<string>"))
        checks = checks.when(mine & (F.size(extra) > 0), F.concat(F.lit("unknown:"), F.element_at(extra, 1)))
        for a, kind in t.types.items():
            got = F.schema_of_variant(F.try_variant_get(v, f"$.{a}", "variant"))
            if a in t.allowed:
                value = F.try_variant_get(v, f"$.{a}", "string")
                checks = checks.when(mine & F.array_contains(keys, a) & ~F.coalesce(value.isin(list(t.allowed[a])), F.lit(False)), f"enum:{a}")
            checks = checks.when(mine & F.array_contains(keys, a) & (F.coalesce(got, F.lit("VOID")) != kind), f"type:{a}")
    return checks


def signature(name: Column, raw: Column) -> Column:
    """Calls with the same tool and arguments, in whatever order these stand, share a signature."""
    keys, values = F.array_sort(F.json_object_keys(raw)), F.from_json(raw, "map<string,string>")
    return F.concat_ws("&", name, F.array_join(F.transform(keys, lambda k: F.concat_ws("=", k, F.element_at(values, k))), "&"))


def marked_repeats(calls: DataFrame) -> DataFrame:
    """Calls (episode, step, sig, error) with ``first_step``, the earlier good call they repeat; null for a first call. Errors aren't remembered."""
    good = calls.where("error is null").groupBy("episode", "sig").agg(F.min("step").alias("_first"))
    j = calls.join(good, ["episode", "sig"], "left")
    return j.withColumn("first_step", F.when(F.col("_first") < F.col("step"), F.col("_first"))).drop("_first")


def guarded(submissions: DataFrame, budget: int = 1) -> DataFrame:
    """Submissions (episode, step, severe, forced) with ``accepted``: one with severe issues is sent back while the budget lasts, never in the forced round; what comes after the accepted one is dropped."""
    w = Window.partitionBy("episode").orderBy("step")
    s = submissions.withColumn("_bad", F.sum(F.when(F.col("severe") > 0, 1).otherwise(0)).over(w))
    s = s.withColumn("accepted", (F.col("severe") == 0) | F.col("forced") | (F.col("_bad") > budget))
    first = F.min(F.when(F.col("accepted"), F.col("step"))).over(Window.partitionBy("episode"))
    return s.withColumn("_first", first).where(F.col("_first").isNull() | (F.col("step") <= F.col("_first"))).drop("_bad", "_first")


def finished(calls: DataFrame, max_steps: int, last_tool: str) -> DataFrame:
    """(episode, steps, tool_calls, errors, repeats, stop): how episodes of calls (episode, step, tool, error, first_step) end.

    ``submitted`` with a good call of the last tool within max_steps, ``text`` without any call in the last step,
    else ``forced``.
    """
    inside = calls.where(F.col("step") <= max_steps + 1)
    g = inside.groupBy("episode").agg(
        F.max("step").alias("steps"), F.count("tool").alias("tool_calls"), F.count("error").alias("errors"), F.count("first_step").alias("repeats"),
        F.min(F.when((F.col("tool") == last_tool) & F.col("error").isNull(), F.col("step"))).alias("_s"), F.max(F.when(F.col("tool").isNull(), F.col("step"))).alias("_t"),
    )
    return g.withColumn("stop", F.when(F.col("_s") <= max_steps, "submitted").when(F.col("_t") == F.col("steps"), "text").otherwise("forced")).drop("_s", "_t")
