"""Corpus building, cleaning and sampling over documents, units and candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import corpus, quantiles
from ..sources.tables import table
from . import sqltext as S


def source_registry_profile(spark: SparkSession, d: str) -> DataFrame:
    """Per source: documents, missing texts, and sizes at p10, p50, p90 (index n q div 10) and the maximum."""
    t = table(spark, d, "documents").select("source", F.col("text").isNull().alias("missing"), F.char_length("text").alias("chars"))
    n = t.groupBy("source").agg(F.count("*").alias("documents"), F.count_if("missing").alias("missing"))
    at = {f"p{q}0": quantiles.at_rank("chars", F.floor(F.col("n") * q / 10) + 1) for q in (1, 5, 9)}
    r = quantiles.exact_ranks(t, "source", "chars").groupBy("source").agg(*[c.alias(k) for k, c in at.items()], F.max("chars").alias("max_chars"))
    return n.alias("n").join(r.alias("r"), F.col("n.source").eqNullSafe(F.col("r.source")), "left").select("n.*", *at, "max_chars")


_AT = ", ".join(f"max(case when i = n * {q} // 10 + 1 then c end) as p{q}0" for q in (1, 5, 9))
PROFILE = f"""with k as (select source, length(text) as c, row_number() over (partition by source, text is null order by length(text)) as i, count(text) over (partition by source) as n from documents)
select source, count(*) as documents, count(case when c is null then 1 end) as missing, {_AT}, max(c) as max_chars from k group by source"""


def line_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Non-blank lines of the documents with their place and size."""
    t = table(spark, d, "documents").where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return t.where("trim(line) <> ''").select("doc_id", "line_no", F.char_length("line").alias("n_chars"), F.md5("line").alias("line_md5"))


LINES = """select doc_id, cast(i - 1 as int) as line_no, length(l) as n_chars, md5(l) as line_md5 from (select doc_id, unnest(string_split(text, chr(10))) as l, generate_subscripts(string_split(text, chr(10)), 1) as i from documents where text is not null) where trim(l) <> ''"""


def noise_filtered_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Lines of 20 characters or more of which a fifth or more are Han characters, counted per source."""
    t = table(spark, d, "documents").where("text is not null").select("source", F.explode(F.split("text", "\n")).alias("line"))
    kept = (F.char_length("line") >= 20) & (X.cjk_chars(F.col("line")) >= 0.2 * F.char_length("line"))
    return t.groupBy("source").agg(F.count("*").alias("lines"), F.count_if(kept).alias("kept"))


NOISE = """select source, count(*) as lines, count(case when length(l) >= 20 and len(regexp_extract_all(l, '[一-鿿]')) >= 0.2 * length(l) then 1 end) as kept from (select source, unnest(string_split(text, chr(10))) as l from documents where text is not null) group by source"""

_PL = """u0 as (select *, row_number() over (partition by unit_id order by loaded_at desc) as rn from units where unit_id is not null),
l as (select unit_id, doc_id, x.page as page, i - 1 as line_no, x.line as line from (select unit_id, doc_id, unnest(lines) as x, generate_subscripts(lines, 1) as i from u0 where rn = 1) where x.line is not null and x.line <> '')"""

#: share of a source's texts on which a line is boilerplate
_OFTEN = 0.01


def _text_lines(spark: SparkSession, d: str) -> DataFrame:
    """Non-blank lines of the documents of each source, a text standing for a page."""
    t = table(spark, d, "documents").where("text is not null and source is not null").select("source", "doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return t.where("trim(line) <> ''")


def repeated_line_headers(spark: SparkSession, d: str) -> DataFrame:
    """Short lines that stand in many texts of a source, numbers masked."""
    return corpus.repeated_headers(_text_lines(spark, d), "source", "doc_id", share=_OFTEN)


def header_free_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines and characters that are left of each source without its repeated lines."""
    lines = _text_lines(spark, d)
    return corpus.without_headers(lines, corpus.repeated_headers(lines, "source", "doc_id", share=_OFTEN), "source").groupBy("source").agg(F.count("*").alias("lines"), F.sum(F.char_length("line")).alias("chars"))


_TL = f"""l as (select source, doc_id, l as line, regexp_replace(l, '[0-9一二三四五六七八九十百零〇]+', '#', 'g') as key from (select source, doc_id, unnest(string_split(text, chr(10))) as l from documents where text is not null and source is not null) where trim(l) <> ''),
n as (select source, count(distinct doc_id) as pages from l group by source),
h as (select source, key, count(distinct doc_id) as pages from l where length(line) <= 40 and len(regexp_extract_all(line, '[一-鿿]')) >= 2 group by source, key),
hh as (select h.* from h join n on n.source = h.source where h.pages >= greatest(3, floor(n.pages * {_OFTEN})))"""
HEADERS = f"with {_TL} select source, key, pages from hh"
HEADER_FREE = f"with {_TL} select source, count(*) as lines, cast(sum(length(line)) as bigint) as chars from l where not exists (select 1 from hh where hh.source = l.source and hh.key = l.key) group by source"


def unit_texts(spark: SparkSession, d: str) -> DataFrame:
    """Units with their lines joined, pages and size."""
    return corpus.units_once(table(spark, d, "units")).select("unit_id", "doc_id", "page_start", "page_end", "n_chars", F.md5("text").alias("text_md5"))


UNIT_TEXTS = f"with {S.UNITS} select unit_id, doc_id, page_start, page_end, length(text) as n_chars, md5(text) as text_md5 from u"


def clause_read(spark: SparkSession, d: str) -> DataFrame:
    """One clause of one product as one text of at most 6000 characters, guide pages left out; ambiguous where parts differ."""
    u = corpus.units_once(table(spark, d, "units")).where("section <> 'guide' and clause_id is not null")
    g = u.groupBy("doc_id", "clause_id").agg(F.countDistinct("part").alias("parts"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("unit_id", "text"))), lambda x: x["text"]), "").alias("t"))
    return g.select("doc_id", "clause_id", "parts", (F.col("parts") > 1).alias("ambiguous"), F.char_length(F.left("t", F.lit(6000))).alias("n_chars"), F.md5(F.left("t", F.lit(6000))).alias("text_md5"))


CLAUSE = f"""with {S.UNITS}, g as (select doc_id, clause_id, count(distinct part) as parts, left(string_agg(text, '' order by unit_id), 6000) as t from u where section <> 'guide' and clause_id is not null group by 1, 2)
select doc_id, clause_id, parts, parts > 1 as ambiguous, length(t) as n_chars, md5(t) as text_md5 from g"""

_HEADING = r"^(第[0-9一二三四五六七八九十百]+[章节条]|[0-9]+(\.[0-9]+)+\s|问：|客户：|楼主：|\[[0-9]{2}:[0-9]{2}\])"


def clause_segments(spark: SparkSession, d: str) -> DataFrame:
    """Segments of each document's lines: one begins at every heading; what stands before the first is segment 0."""
    t = table(spark, d, "documents").where("text is not null and doc_id is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    s = corpus.segments(t, "doc_id", "line_no", F.col("line").rlike(_HEADING))
    return s.groupBy("doc_id", "segment").agg(F.count("*").alias("lines"), F.min("line_no").alias("first_line"), F.sum(F.char_length("line")).alias("chars"))


SEGMENTS = f"""with l as (select doc_id, unnest(string_split(text, chr(10))) as l, cast(generate_subscripts(string_split(text, chr(10)), 1) - 1 as int) as n from documents where text is not null),
s as (select *, sum(case when regexp_matches(l, '{_HEADING}') then 1 else 0 end) over (partition by doc_id order by n) as segment from l)
select doc_id, cast(segment as bigint) as segment, count(*) as lines, min(n) as first_line, cast(sum(length(l)) as bigint) as chars from s group by doc_id, segment"""


def long_unit_split(spark: SparkSession, d: str) -> DataFrame:
    """Sizes of the pieces of each unit after the greedy fold over its lines."""
    u = corpus.latest(table(spark, d, "units"), "unit_id")
    t = F.filter(F.transform("lines", lambda x: x["line"]), lambda t: t.isNotNull() & (t != ""))
    return u.select("unit_id", F.posexplode(corpus.long_split(F.coalesce(t, F.array().cast("array<string>")))).alias("sub_index", "n_chars"))


LONG_SPLIT = """with u0 as (select *, row_number() over (partition by unit_id order by loaded_at desc) as rn from units where unit_id is not null),
t as (select unit_id, list_filter(list_transform(coalesce(lines, []), lambda x: x.line), lambda t: t is not null and t <> '') as ts from u0 where rn = 1),
f as (select unit_id, list_reduce(ts, lambda s, t: case when s.size > 0 and (s.size >= 700 or (s.size >= 450 and regexp_matches(t, '^\\s*(?:[（(]?[0-9一二三四五六七八九十]+[)）．.、]|[-•●])')))
then struct_pack(done := list_append(s.done, s.size), size := cast(length(t) as bigint)) else struct_pack(done := s.done, size := s.size + length(t)) end, struct_pack(done := cast([] as bigint[]), size := cast(0 as bigint))) as s from (select unit_id, ts from t)),
g as (select unit_id, case when s.size > 0 then list_append(s.done, s.size) else s.done end as p from f)
select unit_id, cast(generate_subscripts(p, 1) - 1 as bigint) as sub_index, unnest(p) as n_chars from g"""


def entity_detection(spark: SparkSession, d: str) -> DataFrame:
    """Model names that each document mentions: words equi-joined with the alias table; the empty set means no filter."""
    alias = table(spark, d, "gen_v3_p2_blind").where("model is not null").select(F.lower("model").alias("word")).distinct()
    w = table(spark, d, "documents").where("text is not null").select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9]+(?:-[a-z0-9]+)+)"), F.lit(1)))).alias("word"))
    return w.join(alias, "word").groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("word")), ",").alias("entities"), F.count("*").alias("n"))


ENTITIES = """with a as (select distinct lower(model) as word from gen_v3_p2_blind where model is not null),
w as (select distinct doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+(?:-[a-z0-9]+)+')) as word from documents where text is not null)
select doc_id, string_agg(word, ',' order by word) as entities, count(*) as n from w join a using (word) group by doc_id"""


def candidate_format_filter(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of 6 to 120 characters with a Han character, per writer."""
    c = corpus.latest(table(spark, d, "blind_v3_candidates").select("cand_id", "loaded_at", "writer", "question"), "cand_id")
    ok = F.char_length("question").between(6, 120) & F.col("question").rlike("[一-鿿]")
    return c.groupBy("writer").agg(F.count("*").alias("candidates"), F.count_if(ok).alias("kept"))


_CAND = "c as (select * from (select *, row_number() over (partition by cand_id order by loaded_at desc) as rn from blind_v3_candidates where cand_id is not null) where rn = 1)"
FORMAT = f"with {_CAND} select writer, count(*) as candidates, count(case when length(question) between 6 and 120 and regexp_matches(question, '[一-鿿]') then 1 end) as kept from c group by writer"


def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    """Five candidates per writer in an order by hash of seed and id, the same on every engine and run."""
    c = corpus.latest(table(spark, d, "blind_v3_candidates").select("cand_id", "loaded_at", "writer"), "cand_id").where("writer is not null")
    w = Window.partitionBy("writer").orderBy(F.md5(F.concat(F.lit("7:"), F.col("cand_id").cast("string"))), "cand_id")
    return c.withColumn("place", F.row_number().over(w)).where("place <= 5").select("writer", "place", "cand_id")


SAMPLE = f"with {_CAND} select writer, place, cand_id from (select writer, cand_id, row_number() over (partition by writer order by md5('7:' || cand_id), cand_id) as place from c where writer is not null) where place <= 5"


def pii_redaction_counts(spark: SparkSession, d: str) -> DataFrame:
    """Personal data found per source, kind after kind."""
    n = X.pii_counts(F.col("text"))
    return table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("documents"), *[F.sum(c).alias(k) for k, c in n.items()])


PII = """with r as (select source, doc_id, unnest(list_concat(regexp_extract_all(coalesce(text, ''), '[0-9]+[Xx]?'), [''])) as t from documents),
k as (select source, length(regexp_replace(t, '[Xx]$', '')) as n, regexp_matches(t, '[Xx]$') as x, t from r),
c as (select source, sum(case when n = 18 or (n = 17 and x) then 1 else 0 end) as id_card, sum(case when n in (16, 19) or (n = 17 and not x) then 1 else 0 end) as bank_card,
sum(case when n = 11 and regexp_matches(t, '^1[3-9]') then 1 else 0 end) as mobile from k group by source)
select d.source, d.documents, cast(c.id_card as bigint) as id_card, cast(c.bank_card as bigint) as bank_card, cast(c.mobile as bigint) as mobile, d.email from
(select source, count(*) as documents, cast(sum(len(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)+'))) as bigint) as email from documents group by source) d
join c on c.source is not distinct from d.source"""


def pii_redacted_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", X.redacted(F.col("text")).alias("text"))


def _redact_sql(t: str, pattern: str, mark: str) -> str:
    """Matches that no digit stands beside; twice, as neighbours share what stands between them."""
    once = f"regexp_replace({t}, '(^|[^0-9])({pattern})($|[^0-9])', '\\1<{mark}>\\3', 'g')"
    return f"regexp_replace({once}, '(^|[^0-9])({pattern})($|[^0-9])', '\\1<{mark}>\\3', 'g')"


_RED = _redact_sql(_redact_sql(_redact_sql("text", "[0-9]{17}[0-9Xx]", "id_card"), "[0-9]{16,19}", "bank_card"), "1[3-9][0-9]{9}", "mobile")
REDACTED = f"select doc_id, regexp_replace({_RED}, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)+', '<email>', 'g') as text from documents"


def date_extraction(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").select("doc_id", X.dates(F.col("text")).alias("x")).where(F.size("x") > 0)
    return t.select("doc_id", F.size("x").alias("n"), F.array_join("x", ",").alias("dates"))


_DAY = "'([0-9]{4})\\s*[-年]\\s*([0-9]{1,2})\\s*[-月]\\s*([0-9]{1,2})'"
DAYS = f"""with k as (select doc_id, regexp_extract_all(text, {_DAY}, 1) as y, regexp_extract_all(text, {_DAY}, 2) as m, regexp_extract_all(text, {_DAY}, 3) as d from documents where text is not null),
l as (select doc_id, list_transform(y, lambda v, i: v || '-' || lpad(m[i], 2, '0') || '-' || lpad(d[i], 2, '0')) as x from k),
u as (select doc_id, list_filter(x, lambda v, i: list_position(x, v) = i) as x from l where len(x) > 0)
select doc_id, len(x) as n, array_to_string(x, ',') as dates from u"""


def amount_extraction(spark: SparkSession, d: str) -> DataFrame:
    """Amounts per source: how many different ones the documents name, and the largest."""
    t = table(spark, d, "documents").select("source", F.explode(X.amounts(F.col("text"))).alias("amount"))
    return t.groupBy("source").agg(F.count("*").alias("amounts"), F.max("amount").alias("largest"), F.sum("amount").alias("total"))


_SUM = "'([0-9][0-9,]*(?:\\.[0-9]+)?)\\s*(万)?'"
AMOUNTS = f"""with k as (select doc_id, source, regexp_extract_all(text, {_SUM}, 1) as a, regexp_extract_all(text, {_SUM}, 2) as w from documents where text is not null),
v as (select doc_id, source, unnest(list_transform(a, lambda v, i: cast(replace(v, ',', '') as double) * case when w[i] = '万' then 10000 else 1 end)) as v from k),
l as (select distinct doc_id, source, cast(round_even(v, 0) as bigint) as amount from v where v < 1e12)
select source, count(*) as amounts, max(amount) as largest, cast(sum(amount) as bigint) as total from l group by source"""


def clause_labels(spark: SparkSession, d: str) -> DataFrame:
    u = corpus.units_once(table(spark, d, "units"))
    return u.select("unit_id", X.clause_label(F.col("doc_id"), F.col("section"), F.col("part"), F.col("clause_id"), F.col("title")).alias("label"))


LABELS = f"""with {S.UNITS} select unit_id, case when section = 'guide' then concat_ws(' ', doc_id, 'guide', nullif(trim(clause_id), '')) else concat_ws(' ', doc_id, nullif(trim(part), ''), nullif(trim(clause_id), ''), nullif(trim(title), '')) end as label from u"""


def header_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages, lines and characters of each product: the corpus profile."""
    lines = corpus.page_lines(table(spark, d, "units"))
    return lines.groupBy("doc_id").agg(F.countDistinct("page").alias("pages"), F.countDistinct("unit_id").alias("units"), F.count("*").alias("lines"), F.sum(F.char_length("line")).alias("chars"))


PAGES = f"with {_PL} select doc_id, count(distinct page) as pages, count(distinct unit_id) as units, count(*) as lines, cast(sum(length(line)) as bigint) as chars from l group by doc_id"

CATALOGUE = {
    "date_extraction": (date_extraction, DAYS),
    "amount_extraction": (amount_extraction, AMOUNTS),
    "clause_labels": (clause_labels, LABELS),
    "corpus_profile": (header_pages, PAGES),
    "source_registry_profile": (source_registry_profile, PROFILE),
    "line_chunks": (line_chunks, LINES),
    "noise_filtered_chunks": (noise_filtered_chunks, NOISE),
    "repeated_line_headers": (repeated_line_headers, HEADERS),
    "header_free_lines": (header_free_lines, HEADER_FREE),
    "unit_texts": (unit_texts, UNIT_TEXTS),
    "clause_read": (clause_read, CLAUSE),
    "clause_segments": (clause_segments, SEGMENTS),
    "long_unit_split": (long_unit_split, LONG_SPLIT),
    "entity_detection": (entity_detection, ENTITIES),
    "candidate_format_filter": (candidate_format_filter, FORMAT),
    "stratified_sample": (stratified_sample, SAMPLE),
    "pii_redaction_counts": (pii_redaction_counts, PII),
    "pii_redacted_text": (pii_redacted_text, REDACTED),
}
