"""Projections, joins and report tables over units, golden sets and runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.numeric import share
from ..operators import corpus, quantiles
from ..sources.tables import table
from . import runs
from . import sqltext as S


def chunk_projection(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of the units: key doc::part or -::clause#k (k counts units of one clause, kept where the noise filter drops one), pages, size, and the text under its headings for the index."""
    u = corpus.units_once(table(spark, d, "units"))
    bare = lambda c: F.nullif(F.trim(F.coalesce(F.col(c), F.lit(""))), F.lit(""))
    key = F.concat_ws("::", F.coalesce("doc_id", F.lit("")), F.coalesce(bare("part"), F.lit("-")), F.coalesce("clause_id", F.lit("")))
    c = u.withColumn("clause_key", key).withColumn("sub_index", F.row_number().over(Window.partitionBy("clause_key").orderBy("unit_id")) - 1)
    index_text = F.concat_ws("｜", "doc_id", bare("part"), bare("section_title"), bare("title"), "text")
    kept = (F.col("n_chars") >= 20) & (X.cjk_chars(F.col("text")) >= 0.2 * F.col("n_chars"))
    return c.where(kept).select(F.concat("clause_key", F.lit("#"), F.col("sub_index").cast("string")).alias("chunk_id"), "unit_id", F.col("sub_index").cast("bigint"), F.col("n_chars").cast("bigint"), F.md5(index_text).alias("index_md5"))


CHUNKS = f"""with {S.UNITS}, k as (select *, coalesce(doc_id, '') || '::' || coalesce(nullif(trim(coalesce(part, '')), ''), '-') || '::' || coalesce(clause_id, '') as ck from u),
c as (select *, row_number() over (partition by ck order by unit_id) - 1 as si from k)
select ck || '#' || si as chunk_id, unit_id, cast(si as bigint) as sub_index, cast(length(text) as bigint) as n_chars,
md5(concat_ws('｜', doc_id, nullif(trim(coalesce(part, '')), ''), nullif(trim(coalesce(section_title, '')), ''), nullif(trim(coalesce(title, '')), ''), text)) as index_md5
from c where length(text) >= 20 and len(regexp_extract_all(text, '[一-鿿]')) >= 0.2 * length(text)"""


def title_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines per product, and those that could be a title."""
    lines = corpus.page_lines(table(spark, d, "units"))
    return lines.groupBy("doc_id").agg(F.count("*").alias("lines"), F.count_if(X.title_like(F.col("line"))).alias("titles"))


TITLES = """with u0 as (select *, row_number() over (partition by unit_id order by loaded_at desc) as rn from units where unit_id is not null),
l as (select doc_id, x.line as t from (select doc_id, unnest(lines) as x from u0 where rn = 1) where x.line is not null and x.line <> '')
select doc_id, count(*) as lines, count(case when regexp_matches(t, '^[一-鿿]') and not regexp_matches(t, '[，。；：、！？,.;:!?]') and length(t) <= 30 then 1 end) as titles from l group by doc_id"""


def titled_segments(spark: SparkSession, d: str) -> DataFrame:
    """Segments of each document with the title that follows a bare heading number: the next line where that could be one, else the rest of the heading line; and the last part heading (chapter) before them."""
    t = table(spark, d, "documents").where("text is not null and doc_id is not null").select("doc_id", F.posexplode(F.split("text", "\\n")).alias("line_no", "line"))
    w = Window.partitionBy("doc_id").orderBy("line_no")
    number = F.regexp_extract("line", _NUMBER, 1)
    rest = F.trim(F.regexp_replace("line", _NUMBER, ""))
    l = t.withColumns({"number": number, "rest": rest, "next": F.lead("line").over(w), "chapter": F.when(F.col("line").rlike(_CHAPTER), F.trim("line"))})
    l = l.withColumn("chapter", F.last("chapter", True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    title = F.when((F.col("rest") == "") & X.title_like(F.col("next")), F.col("next")).otherwise(F.left("rest", F.lit(30)))
    return l.where("number <> ''").select("doc_id", F.col("line_no").cast("bigint").alias("line_no"), "number", title.alias("title"), "chapter")


_NUMBER = "^([0-9]+(?:[.][0-9]+)+|第[0-9一二三四五六七八九十百]+条)[ 　]*"
_CHAPTER = "^第[0-9一二三四五六七八九十百]+[章节部]"
SEGMENTS = f"""with l as (select doc_id, unnest(string_split(text, chr(10))) as l, generate_subscripts(string_split(text, chr(10)), 1) - 1 as n from documents where text is not null and doc_id is not null),
k as (select *, regexp_extract(l, '{_NUMBER}', 1) as number, trim(regexp_replace(l, '{_NUMBER}', '')) as rest, lead(l) over (partition by doc_id order by n) as nx, case when regexp_matches(l, '{_CHAPTER}') then trim(l) end as ch from l),
c as (select *, last_value(ch ignore nulls) over (partition by doc_id order by n rows between unbounded preceding and current row) as chapter from k)
select doc_id, cast(n as bigint) as line_no, number, case when rest = '' and regexp_matches(nx, '^[一-鿿]') and not regexp_matches(nx, '[，。；：、！？,.;:!?]') and length(nx) <= 30 then nx else left(rest, 30) end as title, chapter from c where number <> ''"""


def verified_sets(spark: SparkSession, d: str) -> DataFrame:
    """Per golden set: rows, verified ones, and whether all are."""
    sets = [table(spark, d, n).where("id is not null").groupBy("id").agg(F.max("verified_by").alias("who")).select(F.lit(n).alias("golden_set"), "who") for n in _SETS]
    u = sets[0].union(sets[1]).union(sets[2])
    return u.groupBy("golden_set").agg(F.count("*").alias("rows"), F.count("who").alias("verified"), F.bool_and(F.col("who").isNotNull()).alias("all_verified"))


_SETS = ("golden_blind_v1", "golden_blind_v3", "golden_blind_v6")
_ALL = " union all ".join(f"select '{n}' as golden_set, max(verified_by) as who from {n} where id is not null group by id" for n in _SETS)
VERIFIED = f"select golden_set, count(*) as rows, count(who) as verified, bool_and(who is not null) as all_verified from ({_ALL}) group by golden_set"


def missing_points(spark: SparkSession, d: str) -> DataFrame:
    """Key points that an answer of a golden question lacks: what was asked for except what is there, per model; runs without any are complete."""
    j = runs._judged(spark, d)
    have = F.filter("must_include", lambda p: F.contains(F.coalesce(F.col("answer"), F.lit("")), p))
    m = j.withColumn("missing", F.size(F.array_except(F.coalesce("must_include", F.array().cast("array<string>")), F.coalesce(have, F.array().cast("array<string>")))))
    return m.groupBy("model").agg(F.count("*").alias("runs"), F.count_if(F.col("missing") == 0).alias("complete"), F.sum("missing").alias("missing"))


MISSING = f"""with {runs.RUNS}, {runs._GOLD}, k as (select model, len(list_distinct(list_filter(coalesce(mi, []), lambda p: p is not null and not contains(coalesce(answer, ''), p)))) as missing from j)
select model, count(*) as runs, count(case when missing = 0 then 1 end) as complete, cast(sum(missing) as bigint) as missing from k group by model"""


def refusal_flags(spark: SparkSession, d: str) -> DataFrame:
    """Per model: answers that count as refused, as they are parsed output that says it isn't answerable, or begin with a phrase of refusal; and those that say they can't tell."""
    r = runs._runs(spark, d, "model", "answer").withColumn("v", X.first_json(F.col("answer")))
    told = F.coalesce(F.try_variant_get("v", "$.refused", "boolean"), F.lit(False))
    begins = F.coalesce(F.trim("answer").rlike(runs._REFUSES), F.lit(False))
    return r.groupBy("model").agg(F.count("*").alias("runs"), F.count_if(told).alias("told"), F.count_if(told | begins).alias("refused"), F.count_if(X.insufficient(F.col("answer"))).alias("insufficient"))


REFUSALS = f"""with {runs.RUNS}, k as (select model, answer, regexp_extract(answer, '([{{](?s).*[}}])', 1) as t from r), v as (select model, answer, case when t <> '' and json_valid(t) then cast(t as json) end as v from k),
f as (select model, answer, coalesce(json_extract_string(v, '$.refused') = 'true', false) as told, coalesce(regexp_matches(trim(answer), '{runs._REFUSES_SQL}'), false) as begins from v)
select model, count(*) as runs, count(case when told then 1 end) as told, count(case when told or begins then 1 end) as refused, count(case when regexp_matches(answer, '{X.INSUFFICIENT}') then 1 end) as insufficient from f group by model"""


def system_comparison(spark: SparkSession, d: str) -> DataFrame:
    """Systems (runs) side by side on golden questions: verdicts, right refusals, tokens and median seconds; a left join, so a system without a judged question stays with zeros."""
    g = table(spark, d, "golden_blind_v1").where("id is not null").groupBy("id").agg(F.max(F.struct("must_include", F.col("type").alias("gtype"))).alias("g"))
    j = runs._runs(spark, d, "run", "answer", "refused", "usage", "seconds").join(g, "id", "left")
    covered = F.size(F.filter("g.must_include", lambda p: F.contains(F.coalesce(F.col("answer"), F.lit("")), p)))
    points, judged = F.size("g.must_include"), F.col("g").isNotNull() & F.col("g.must_include").isNotNull()
    return j.groupBy("run").agg(
        F.count("*").alias("runs"), F.count_if(judged).alias("judged"), F.count_if(judged & (covered == points)).alias("correct"), F.count_if(judged & (covered > 0) & (covered < points)).alias("partial"),
        F.count_if((F.col("g.gtype") == "refuse") & F.col("refused")).alias("right_refusals"), F.sum(F.when(F.col("usage.completion") >= 0, F.col("usage.completion"))).alias("tokens"),
        F.round(F.median(F.when(F.col("seconds") >= 0, F.col("seconds"))), 6).alias("median_seconds"),
    )


SYSTEMS = f"""with {runs.RUNS}, g as (select id, any_value(must_include) as mi, any_value(type) as gtype from golden_blind_v1 where id is not null group by id),
j as (select r.*, gtype, mi is not null as judged, len(mi) as points, len(list_filter(mi, lambda p: contains(coalesce(answer, ''), p))) as covered from r left join g on g.id = r.id)
select run, count(*) as runs, count(case when judged then 1 end) as judged, count(case when judged and covered = points then 1 end) as correct, count(case when judged and covered > 0 and covered < points then 1 end) as partial,
count(case when gtype = 'refuse' and refused then 1 end) as right_refusals, cast(sum(case when usage.completion >= 0 then usage.completion end) as bigint) as tokens, round(median(case when seconds >= 0 then seconds end), 6) as median_seconds from j group by run"""


def security_by_type(spark: SparkSession, d: str) -> DataFrame:
    """Per type of golden question: runs that leak nothing outside quotations and, where that is asked, refuse."""
    j = runs._judged(spark, d)
    bare = F.regexp_replace(F.coalesce(F.col("answer"), F.lit("")), runs.QUOTED, "")
    leak = F.coalesce(F.exists("must_not_include", lambda p: (p != "") & F.contains(bare, p)), F.lit(False))
    denied = F.coalesce("refused", F.lit(False))
    return j.groupBy("gtype").agg(F.count("*").alias("runs"), F.count_if(~leak & ((F.col("gtype") != "refuse") | denied)).alias("passed"), F.count_if(denied).alias("denials"))


SECURITY = f"""with {runs.RUNS}, {runs._GOLD}, k as (select gtype, coalesce(refused, false) as denied, coalesce(len(list_filter(mn, lambda p: p <> '' and contains(regexp_replace(coalesce(answer, ''), '{runs.QUOTED}', '', 'g'), p))), 0) > 0 as leak from j)
select gtype, count(*) as runs, count(case when not leak and (gtype <> 'refuse' or denied) then 1 end) as passed, count(case when denied then 1 end) as denials from k group by gtype"""


def episode_latency(spark: SparkSession, d: str) -> DataFrame:
    """Per user as an episode: seconds and calls of its steps by kind, folded over the ordered steps; the gap to the step before is its time, at most an hour."""
    e = table(spark, d, "events").where("user_id is not null")
    gap = F.unix_micros(F.col("ts").cast("timestamp")) - F.lag(F.unix_micros(F.col("ts").cast("timestamp"))).over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    s = e.withColumn("ms", F.least(F.coalesce(gap, F.lit(0)), F.lit(3_600_000_000)).cast("double") / 1000)
    tool = F.col("event_type") != "error"
    return s.groupBy("user_id").agg(F.count_if(tool).alias("calls"), F.round(F.sum(F.when(tool, F.col("ms"))), 3).alias("call_ms"), F.round(share(F.sum(F.when(tool, F.col("ms"))), F.nullif(F.sum("ms"), F.lit(0.0))), 6).alias("call_share"))


LATENCY = """with s as (select user_id, event_type, cast(least(coalesce(epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by ts, event_id), 0), 3600000000) as double) / 1000 as ms from events where user_id is not null)
select user_id, count(case when event_type <> 'error' then 1 end) as calls, round(sum(case when event_type <> 'error' then ms end), 3) as call_ms, round(sum(case when event_type <> 'error' then ms end) / nullif(sum(ms), 0), 6) as call_share from s group by user_id"""


def ops_table(spark: SparkSession, d: str) -> DataFrame:
    """Per run: calls, P50, P95 (nearest rank) and longest seconds, tokens per call, share of reasoning, calls that came from the cache."""
    r = runs._runs(spark, d, "run", "usage", "seconds", "cached")
    q = quantiles.exact_ranks(r.where("seconds >= 0"), "run", "seconds").groupBy("run").agg(
        quantiles.at_rank("seconds", quantiles.nearest(0.5)).alias("p50"), quantiles.at_rank("seconds", quantiles.nearest(0.95)).alias("p95"), F.max("seconds").alias("longest")
    )
    n = r.groupBy("run").agg(
        F.count("*").alias("calls"), F.round(F.avg("usage.prompt"), 6).alias("avg_prompt"), F.round(F.avg("usage.completion"), 6).alias("avg_completion"),
        F.round(share(F.sum("usage.reasoning"), F.sum("usage.completion")), 6).alias("reasoning_share"), F.count_if(F.coalesce("cached", F.lit(False))).alias("cached"),
    )
    return n.join(q, "run", "left")


OPS = f"""with {runs.RUNS}, k as (select run, seconds, row_number() over (partition by run order by seconds) as i, count(*) over (partition by run) as n from r where seconds >= 0),
q as (select run, max(case when i = least(n, greatest(1, cast(round_even(0.5 * n + 0.5, 0) as bigint))) then seconds end) as p50, max(case when i = least(n, greatest(1, cast(round_even(0.95 * n + 0.5, 0) as bigint))) then seconds end) as p95, max(seconds) as longest from k group by run),
c as (select run, count(*) as calls, round(avg(usage.prompt), 6) as avg_prompt, round(avg(usage.completion), 6) as avg_completion, round(sum(usage.reasoning) / nullif(cast(sum(usage.completion) as double), 0), 6) as reasoning_share, count(case when cached then 1 end) as cached from r group by run)
select c.*, q.p50, q.p95, q.longest from c left join q on q.run = c.run"""


def severe_issues(spark: SparkSession, d: str) -> DataFrame:
    """Runs by model with a severe citation issue left in them: a fact that is nowhere in the context, or only in blocks of other documents than the cited ones."""
    found = runs._issues(spark, d).where(F.col("kind").isin("absent", "misattributed"))
    r = runs._runs(spark, d, "model")
    j = r.join(found.groupBy("id").agg(F.count("*").alias("n")), "id", "left")
    return j.groupBy("model").agg(F.count("*").alias("runs"), F.count("n").alias("residual"), F.coalesce(F.sum("n"), F.lit(0)).alias("issues"))


SEVERE = f"""{runs.ISSUES}, n as (select id, count(*) as n from issues where kind in ('absent', 'misattributed') group by id)
select model, count(*) as runs, count(n) as residual, cast(coalesce(sum(n), 0) as bigint) as issues from r left join n on n.id = r.id group by model"""


def writer_rank_order(spark: SparkSession, d: str) -> DataFrame:
    """Candidates in a given order of writers (by how many they wrote, then name), then rank and id; their place."""
    c = corpus.latest(table(spark, d, "blind_v3_candidates").select("cand_id", "loaded_at", "writer", "rank"), "cand_id").where("writer is not null")
    order = c.groupBy("writer").agg(F.count("*").alias("n"))
    order = order.withColumn("writer_order", F.row_number().over(Window.orderBy(F.desc("n"), "writer")))  # one row per writer, a small table
    w = Window.partitionBy("writer").orderBy(F.col("rank").asc_nulls_last(), "cand_id")
    return c.join(order, "writer").select("writer", "writer_order", F.row_number().over(w).alias("place"), "cand_id")


ORDERED = """with c as (select * from (select *, row_number() over (partition by cand_id order by loaded_at desc) as rn from blind_v3_candidates where cand_id is not null) where rn = 1 and writer is not null),
o as (select writer, row_number() over (order by count(*) desc, writer) as writer_order from c group by writer)
select c.writer, writer_order, row_number() over (partition by c.writer order by rank nulls last, cand_id) as place, cand_id from c join o on o.writer = c.writer"""


def call_ids(spark: SparkSession, d: str) -> DataFrame:
    """Session id of each run as a name-based UUID of model and id, and its asking day checked as an ISO date."""
    r = runs._runs(spark, d, "model", "asked_at")
    day = X.iso_date(F.date_format("asked_at", "yyyy-MM-dd"))
    return r.select("id", X.named_uuid(F.concat_ws(":", F.coalesce("model", F.lit("")), "id")).alias("session"), day["day"].alias("day"), day["error"].alias("error"))


_H = "sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode(coalesce(model, '') || ':' || id))"
CALL_IDS = f"""with {runs.RUNS}, h as (select id, asked_at, {_H} as h from r)
select id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || translate(substr(h, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab') || substr(h, 18, 3) || '-' || substr(h, 21, 12) as session,
cast(asked_at as date) as day, case when asked_at is null then 'bad_date' end as error from h"""

CATALOGUE = {
    "chunk_projection": (chunk_projection, CHUNKS),
    "title_lines": (title_lines, TITLES),
    "titled_segments": (titled_segments, SEGMENTS),
    "verified_sets": (verified_sets, VERIFIED),
    "missing_points": (missing_points, MISSING),
    "refusal_flags": (refusal_flags, REFUSALS),
    "system_comparison": (system_comparison, SYSTEMS),
    "security_by_type": (security_by_type, SECURITY),
    "episode_latency": (episode_latency, LATENCY),
    "ops_table": (ops_table, OPS),
    "severe_issues": (severe_issues, SEVERE),
    "writer_rank_order": (writer_rank_order, ORDERED),
    "call_ids": (call_ids, CALL_IDS),
}
