"""Problem 4: oversized items in pieces, cut at natural boundaries, with overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Boundaries by strength: sentence and item ends, clause marks, white space.
STRONG, MIDDLE, WEAK = "。！？!?；;\\n", "，、：,:）)", "\\s"


def joined(lines: Column) -> Column:
    """Text of the lines in reading order; a blank only between two ASCII letters or digits that a line break parted. Null lines count as empty."""
    texts = F.filter(F.transform(lines, lambda x: F.coalesce(x["line"], F.lit(""))), lambda t: t != "")
    glued = F.array_join(texts, "\x1e")
    return F.coalesce(F.regexp_replace(F.regexp_replace(glued, "(?<=[A-Za-z0-9])\x1e(?=[A-Za-z0-9])", " "), "\x1e", ""), F.lit(""))


def total_chars(lines: Column) -> Column:
    """Code points of the line texts together; nulls count 0."""
    return F.aggregate(F.coalesce(lines, F.array()), F.lit(0), lambda n, x: n + F.coalesce(F.char_length(x["line"]), F.lit(0)))


#: pieces that an overlap looks back over; shorter ones end at a boundary, so that it begins at one if these don't fill it
LOOKBACK = 3


def cut_pattern(limit: Column) -> Column:
    """Alternatives in order of boundary strength, each up to ``limit`` characters and at least half of it; then the same boundaries in the first half, the last one first; then any characters."""
    half = F.greatest(F.lit(0), F.floor(limit / 2) - 1).cast("string")
    top = (limit - 1).cast("string")
    late = [F.concat(F.lit(".{"), half, F.lit(","), top, F.lit(f"}}[{marks}]")) for marks in (STRONG, MIDDLE, WEAK)]
    early = [F.concat(F.lit(".{0,"), half, F.lit(f"}}[{marks}]")) for marks in (STRONG, MIDDLE, WEAK)]
    return F.concat(F.lit("(?s)("), F.concat_ws("|", *late, *early, F.concat(F.lit(".{1,"), limit.cast("string"), F.lit("}"))), F.lit(")"))


def lap_of(max_chars: Column, overlap: Column) -> Column:
    """Overlap that is used: less than half the limit, so that every piece goes on."""
    return F.least(F.greatest(overlap, F.lit(0)), F.floor((max_chars - 1) / 2).cast("int"))


def lead_of(back: Column, start: Column, lap: Column) -> Column:
    """What a piece repeats of the characters ``back`` before it: from behind their first sentence end on, else clause mark, else all."""

    def behind(marks: str) -> Column:
        return F.when(F.regexp_like(back, F.lit(f"[{marks}][\\s\\S]")), F.regexp_replace(back, f"^[^{marks}]*[{marks}]+(?=[\\s\\S])", ""))

    return F.when((start <= lap) | (lap == 0), back).otherwise(F.coalesce(behind(STRONG), behind(MIDDLE), back))


def with_pieces(items: DataFrame, key: str) -> DataFrame:
    """Items (key, body_text, max_chars, overlap_chars), one row per key -> one row per piece with piece_no, start, lead, body.

    piece = lead + body has at most max_chars characters, and the bodies together are the text. Bodies come from one
    pass of the regex, what a piece repeats from the ``LOOKBACK`` bodies before it; where a body starts is a running sum over
    the pieces, in the partitioning that the items have. So the work is linear in the text however many pieces it makes.
    """
    lap = lap_of(F.col("max_chars"), F.col("overlap_chars"))
    a = items.select(key, lap.alias("lap"), F.regexp_extract_all("body_text", cut_pattern(F.col("max_chars") - lap), F.lit(1)).alias("bodies"))
    bodies = F.col("bodies")
    back = lambda i: F.right(F.array_join(F.slice(bodies, F.greatest(i - (LOOKBACK - 1), F.lit(1)), F.least(i, F.lit(LOOKBACK))), ""), F.col("lap"))
    ps = F.transform(bodies, lambda t, i: F.struct(t.alias("body"), back(i).alias("back")))
    b = a.select(key, "lap", F.posexplode(ps).alias("piece_no", "p")).select(key, "lap", "piece_no", F.col("p.body").alias("body"), F.col("p.back").alias("back"))
    before = Window.partitionBy(key).orderBy("piece_no").rowsBetween(Window.unboundedPreceding, -1)
    c = b.withColumn("start", F.coalesce(F.sum(F.char_length("body")).over(before), F.lit(0)).cast("int"))
    return c.select(key, "piece_no", "start", lead_of(F.col("back"), F.col("start"), F.col("lap")).alias("lead"), "body")


def split_oversized(units: DataFrame, limits: DataFrame) -> DataFrame:
    """(unit_id, piece_no, start, lead_chars, n_chars, text): the pieces of every unit whose line texts exceed max_chars of its section.

    units: unit_id, section, lines array<struct<.., line>>; limits: section, max_chars, overlap_chars (a few rows, one per
    section; broadcast only behind Spark's own size check). Units of one id count once (the last loaded, else the longest);
    null or empty lines, units under the limit, and sections without a limit give no row; a limit under 2 is read as 2.
    """
    loaded = F.col("loaded_at") if "loaded_at" in units.columns else F.lit(0)
    one = (
        units.where("unit_id is not null")
        .select("unit_id", "section", F.struct(loaded, total_chars(F.col("lines")), "lines", "section").alias("v"))
        .groupBy("unit_id")
        .agg(F.max("v").alias("v"))
        .select("unit_id", F.col("v.section").alias("section"), F.col("v.lines").alias("lines"))
    )
    lim = limits.where("section is not null and max_chars is not null").groupBy("section").agg(F.min("max_chars").alias("max_chars"), F.max(F.coalesce("overlap_chars", F.lit(0))).alias("overlap_chars"))
    big = one.join(lim, "section").where(total_chars(F.col("lines")) > F.col("max_chars"))
    items = big.select("unit_id", joined(F.col("lines")).alias("body_text"), F.greatest("max_chars", F.lit(2)).alias("max_chars"), "overlap_chars")
    cut = with_pieces(items, "unit_id").withColumn("text", F.concat("lead", "body"))
    return cut.select("unit_id", "piece_no", "start", F.char_length("lead").alias("lead_chars"), F.char_length("text").alias("n_chars"), "text")
