"""Lines to texts, headers, chunks and segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import cjk_chars, join_lines, masked_numbers


def latest(df: DataFrame, key: str, by: str = "loaded_at") -> DataFrame:
    """One row per key, the last loaded; an aggregate that combines before the shuffle, not a sort."""
    rest = [c for c in df.columns if c != key]
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(F.col(by).alias("_by"), *rest)).alias("_r")).select(key, *[F.col(f"_r.{c}").alias(c) for c in rest])


def units_once(units: DataFrame) -> DataFrame:
    """Units once per id, with text, pages and size."""
    u = latest(units, "unit_id")
    page = F.transform("lines", lambda x: x["page"])
    text = join_lines(F.transform("lines", lambda x: x["line"]))
    return u.select(
        "unit_id", "doc_id", "section", "part", "section_title", "clause_id", "title", F.array_min(page).alias("page_start"), F.array_max(page).alias("page_end"),
        F.coalesce(text, F.lit("")).alias("text"),
    ).withColumn("n_chars", F.char_length("text"))


def page_lines(units: DataFrame) -> DataFrame:
    """(unit_id, doc_id, page, line_no, line): long form; null and empty lines dropped, private-use characters removed."""
    u = latest(units, "unit_id").select("unit_id", "doc_id", F.posexplode("lines").alias("line_no", "x"))
    line = F.regexp_replace(F.col("x.line"), "[\\uE000-\\uF8FF]", "")
    return u.select("unit_id", "doc_id", F.col("x.page").alias("page"), "line_no", line.alias("line")).where("line is not null and line <> ''")


def repeated_headers(lines: DataFrame, group: str = "doc_id", page: str = "page", most_chars: int = 40, share: float = 0.3) -> DataFrame:
    """(group, key, pages): masked short lines with two Han characters or more on at least max(3, share of the pages) distinct pages."""
    n = lines.groupBy(group).agg(F.countDistinct(page).alias("all_pages"))
    short = lines.where((F.char_length("line") <= most_chars) & (cjk_chars(F.col("line")) >= 2)).withColumn("key", masked_numbers(F.col("line")))
    seen = short.groupBy(group, "key").agg(F.countDistinct(page).alias("pages"))
    return seen.join(n, group).where(F.col("pages") >= F.greatest(F.lit(3), F.floor(F.col("all_pages") * share))).select(group, "key", "pages")


def without_headers(lines: DataFrame, headers: DataFrame, group: str = "doc_id") -> DataFrame:
    """Lines whose masked form is no repeated header of their group, whatever their length."""
    keyed = lines.withColumn("key", masked_numbers(F.col("line")))
    return keyed.join(headers.select(group, "key"), [group, "key"], "left_anti").drop("key")


def segments(lines: DataFrame, group: str, order: str, starts: Column) -> DataFrame:
    """Gaps and islands: a segment begins at each line where ``starts`` holds; lines before the first are segment 0."""
    w = Window.partitionBy(group).orderBy(order)
    return lines.withColumn("segment", F.sum(F.when(starts, 1).otherwise(0)).over(w))


def long_split(lines: Column, soft: int = 450, hard: int = 700, item: str = r"^\s*(?:[（(]?[0-9一二三四五六七八九十]+[）)．.、]|[-•●])") -> Column:
    """Sizes of the pieces of a unit: a break before a line once the piece has ``soft`` characters and the line is a list item, or ``hard`` characters.

    A running sum with reset, folded over the lines.
    """
    start = F.struct(F.array().cast("array<int>").alias("done"), F.lit(0).alias("size"))

    def step(s: Column, t: Column) -> Column:
        cut = (s["size"] > 0) & ((s["size"] >= hard) | ((s["size"] >= soft) & t.rlike(item)))
        return F.struct(F.when(cut, F.concat(s["done"], F.array(s["size"]))).otherwise(s["done"]).alias("done"), (F.when(cut, F.lit(0)).otherwise(s["size"]) + F.char_length(t)).alias("size"))

    return F.aggregate(lines, start, step, lambda s: F.when(s["size"] > 0, F.concat(s["done"], F.array(s["size"]))).otherwise(s["done"]))
