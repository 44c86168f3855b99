"""Analytics over run rows, events and orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.numeric import share
from ..operators import corpus, grounding, quantiles
from ..session import materialize
from ..sources.tables import table
from . import sqltext as S

RUNS = "r as (select * from (select *, row_number() over (partition by id order by loaded_at desc) as rn from gen_v3_p2_blind where id is not null) where rn = 1)"


def _runs(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Run rows once per id, as last loaded, with only the columns asked for."""
    return corpus.latest(table(spark, d, "gen_v3_p2_blind").select("id", "loaded_at", *columns), "id").drop("loaded_at")


def latency_quantiles(spark: SparkSession, d: str) -> DataFrame:
    """Nearest-rank P50 and P95, interpolated median and maximum of seconds per model."""
    r = quantiles.exact_ranks(_runs(spark, d, "model", "seconds").where("seconds >= 0"), "model", "seconds")
    return r.groupBy("model").agg(
        F.max("n").alias("runs"), quantiles.at_rank("seconds", quantiles.nearest(0.5)).alias("p50"), quantiles.at_rank("seconds", quantiles.nearest(0.95)).alias("p95"),
        F.round(quantiles.median("seconds"), 6).alias("median"), F.max("seconds").alias("max_seconds"),
    )


LATENCY = f"""with {RUNS}, k as (select model, seconds, row_number() over (partition by model order by seconds) as i, count(*) over (partition by model) as n from r where seconds >= 0)
select model, max(n) as runs, max(case when i = least(n, greatest(1, cast(round_even(0.5 * n + 0.5, 0) as bigint))) then seconds end) as p50,
max(case when i = least(n, greatest(1, cast(round_even(0.95 * n + 0.5, 0) as bigint))) then seconds end) as p95, round(median(seconds), 6) as median, max(seconds) as max_seconds from k group by model"""


def upper_median_chars(spark: SparkSession, d: str) -> DataFrame:
    """Lower bound and upper median (index n div 2) of the context size per type."""
    r = quantiles.exact_ranks(_runs(spark, d, "type", "context_chars"), "type", "context_chars")
    return r.groupBy("type").agg(F.min("context_chars").alias("least"), quantiles.at_rank("context_chars", F.floor(F.col("n") / 2) + 1).alias("upper_median"))


UPPER_MEDIAN = f"""with {RUNS}, k as (select type, context_chars, row_number() over (partition by type order by context_chars) as i, count(*) over (partition by type) as n from r where context_chars is not null)
select type, min(context_chars) as least, max(case when i = n // 2 + 1 then context_chars end) as upper_median from k group by type"""


def ops_error_rates(spark: SparkSession, d: str) -> DataFrame:
    r = _runs(spark, d, "model", "answer", "finish_reason", "parse_ok", "invalid_citations")
    return r.groupBy("model").agg(
        F.count("*").alias("runs"),
        F.count_if(F.coalesce(F.col("answer"), F.lit("")) == "").alias("empty"),
        F.count_if(F.col("finish_reason") == "length").alias("truncated"),
        F.count_if(~F.col("finish_reason").isin("stop", "length")).alias("abnormal"),
        F.count_if(~F.col("parse_ok")).alias("parse_failed"),
        F.count_if(F.size("invalid_citations") > 0).alias("invalid_citation_runs"),
        F.coalesce(F.sum(F.when(F.col("invalid_citations").isNotNull(), F.size("invalid_citations"))), F.lit(0)).alias("invalid_citations"),
    )


ERRORS = f"""with {RUNS} select model, count(*) as runs, count(case when coalesce(answer, '') = '' then 1 end) as empty, count(case when finish_reason = 'length' then 1 end) as truncated,
count(case when finish_reason not in ('stop', 'length') then 1 end) as abnormal, count(case when not parse_ok then 1 end) as parse_failed,
count(case when len(invalid_citations) > 0 then 1 end) as invalid_citation_runs, cast(coalesce(sum(len(invalid_citations)), 0) as bigint) as invalid_citations from r group by model"""


def generation_summary(spark: SparkSession, d: str) -> DataFrame:
    """Counts and conditional ratios per type and in total. Ratios are of answerable runs or, of these, those whose context holds evidence; tokens, calls and invalid citations are of all runs. Unknown flags count as not set, unknown arrays as empty."""
    r = _runs(spark, d, "type", "refused", "relevant_in_context", "cited", "cited_relevant", "invalid_citations", "parse_ok", "finish_reason", "usage", "cached", "context_chars")
    no = lambda c: F.coalesce(F.col(c), F.lit(False))
    n = lambda c: F.when(F.col(c).isNull(), 0).otherwise(F.size(c))
    a, refused = F.coalesce(F.col("type") != "refuse", F.lit(True)), no("refused")
    ok = a & (n("relevant_in_context") > 0)
    part = lambda x, of, name: F.round(share(F.count_if(x), F.count_if(of)), 6).alias(name)
    return r.groupingSets([["type"], []], "type").agg(
        F.count_if(a).alias("n_answerable"), F.count_if(~a).alias("n_refuse"), part(ok, a, "context_hit"), part(a & refused, a, "false_refusal"), part(ok & refused, ok, "false_refusal_ctx_ok"),
        part(~a & refused, ~a, "correct_refusal"), part(a & (n("cited") > 0), a, "answer_has_citation"), F.round(share(F.sum(n("invalid_citations")), F.sum(n("cited"))), 6).alias("invalid_citation_rate"),
        F.round(F.count_if(ok & ~refused & (n("cited_relevant") > 0)) / F.greatest(F.lit(1), F.count_if(ok & ~refused)), 6).alias("cites_evidence"),
        F.count_if(F.col("parse_ok") == F.lit(False)).alias("parse_fail"), F.count_if(F.col("finish_reason") == "length").alias("truncated"),
        F.sum("usage.prompt").alias("tokens_prompt"), F.sum("usage.completion").alias("tokens_completion"), F.sum("usage.reasoning").alias("tokens_reasoning"),
        F.count_if(~no("cached")).alias("api_calls"), F.round(F.avg("context_chars"), 6).alias("avg_context_chars"),
    )


def _part_sql(x: str, of: str, name: str) -> str:
    return f"round(count(case when {x} then 1 end) / nullif(cast(count(case when {of} then 1 end) as double), 0), 6) as {name}"


GENERATION = f"""with {RUNS}, k as (select *, coalesce(type <> 'refuse', true) as a, coalesce(refused, false) as f, coalesce(type <> 'refuse', true) and coalesce(len(relevant_in_context), 0) > 0 as ok from r)
select type, count(case when a then 1 end) as n_answerable, count(case when not a then 1 end) as n_refuse, {_part_sql("ok", "a", "context_hit")}, {_part_sql("a and f", "a", "false_refusal")}, {_part_sql("ok and f", "ok", "false_refusal_ctx_ok")},
{_part_sql("not a and f", "not a", "correct_refusal")}, {_part_sql("a and len(cited) > 0", "a", "answer_has_citation")}, round(sum(coalesce(len(invalid_citations), 0)) / nullif(cast(sum(coalesce(len(cited), 0)) as double), 0), 6) as invalid_citation_rate,
round(count(case when ok and not f and len(cited_relevant) > 0 then 1 end) / cast(greatest(1, count(case when ok and not f then 1 end)) as double), 6) as cites_evidence,
count(case when not parse_ok then 1 end) as parse_fail, count(case when finish_reason = 'length' then 1 end) as truncated, cast(sum(usage.prompt) as bigint) as tokens_prompt, cast(sum(usage.completion) as bigint) as tokens_completion,
cast(sum(usage.reasoning) as bigint) as tokens_reasoning, count(case when not coalesce(cached, false) then 1 end) as api_calls, round(avg(context_chars), 6) as avg_context_chars from k group by grouping sets ((type), ())"""


def usage_profile(spark: SparkSession, d: str) -> DataFrame:
    """Per model: mean tokens, share of reasoning in completion, mean seconds, cached share; negative readings don't count."""
    r = _runs(spark, d, "model", "usage", "seconds", "cached")
    return r.groupBy("model").agg(
        F.round(F.avg("usage.prompt"), 6).alias("avg_prompt"), F.round(F.avg("usage.completion"), 6).alias("avg_completion"),
        F.round(share(F.sum("usage.reasoning"), F.sum(F.when(F.col("usage.reasoning").isNotNull(), F.col("usage.completion")))), 6).alias("reasoning_share"),
        F.round(F.avg(F.when(F.col("seconds") >= 0, F.col("seconds"))), 4).alias("avg_seconds"), F.round(F.avg(F.col("cached").cast("int")), 6).alias("cached_share"),
    )


USAGE = f"""with {RUNS} select model, round(avg(usage.prompt), 6) as avg_prompt, round(avg(usage.completion), 6) as avg_completion,
round(sum(usage.reasoning) / nullif(cast(sum(case when usage.reasoning is not null then usage.completion end) as double), 0), 6) as reasoning_share,
round(avg(case when seconds >= 0 then seconds end), 4) as avg_seconds, round(avg(cast(cached as int)), 6) as cached_share from r group by model"""


def context_citations(spark: SparkSession, d: str) -> DataFrame:
    """Per run: citations of the answer in order of first appearance, and those that no block of its context bears."""
    r = _runs(spark, d, "answer", "context")
    c = r.select("id", X.citations(F.col("answer")).alias("c"), F.coalesce(F.transform("context", lambda b: b["cid"]), F.array().cast("array<string>")).alias("have"))
    return c.select("id", F.array_join("c", ",").alias("cited"), F.array_join(F.array_except("c", "have"), ",").alias("invalid"))


_CITED = "list_transform(regexp_extract_all(coalesce(answer, ''), '\\[C([0-9]+)\\]', 1), lambda n: 'C' || n)"
CITATIONS = f"""with {RUNS}, k as (select id, {_CITED} as c, coalesce(list_transform(context, lambda b: b.cid), []) as have from r),
f as (select id, list_filter(c, lambda x, i: list_position(c, x) = i) as c, have from k)
select id, array_to_string(c, ',') as cited, array_to_string(list_filter(c, lambda x: not list_contains(have, x)), ',') as invalid from f"""


def citation_spans(spark: SparkSession, d: str) -> DataFrame:
    """Per run: spans that citations own, their characters, and whether text behind the last citation is left without one."""
    s = _runs(spark, d, "answer").select("id", F.explode(X.citation_spans(F.col("answer"))).alias("s"))
    owned = F.size("s.cited") > 0
    return s.groupBy("id").agg(
        F.count_if(owned).alias("owned"), F.sum(F.when(owned, F.char_length("s.text")).otherwise(0)).alias("owned_chars"), F.count_if(~owned).alias("unowned"), F.sum(F.size("s.cited")).alias("marks")
    )


SPANS = f"""with {RUNS}, k as (select id, regexp_extract_all(coalesce(answer, ''), '((?s).*?)((?:\\[C[0-9]+\\])+)', 1) as b, regexp_extract_all(coalesce(answer, ''), '((?s).*?)((?:\\[C[0-9]+\\])+)', 2) as g,
regexp_replace(coalesce(answer, ''), '(?s)^.*\\[C[0-9]+\\]', '') as rest from r),
x as (select id, unnest(b) as t, unnest(list_transform(g, lambda y: len(regexp_extract_all(y, 'C[0-9]+')))) as n from k union all select id, rest, 0 from k),
y as (select * from x where regexp_replace(t, '[\\s\\p{{Z}}\\x{{0085}}]', '', 'g') <> '')
select id, count(case when n > 0 then 1 end) as owned, cast(sum(case when n > 0 then length(t) else 0 end) as bigint) as owned_chars, count(case when n = 0 then 1 end) as unowned, cast(sum(n) as bigint) as marks from y group by id"""


def uncited_sentences(spark: SparkSession, d: str) -> DataFrame:
    """Per run: sentences of 8 letters or digits and more that bear no citation."""
    s = _runs(spark, d, "answer").select("id", F.explode(X.sentences(F.col("answer"))).alias("s"))
    long = F.char_length(F.regexp_replace("s", "[^0-9A-Za-z一-鿿]", "")) >= 8
    return s.groupBy("id").agg(F.count("*").alias("sentences"), F.count_if(long & ~F.col("s").rlike(X.CITATION)).alias("uncited"))


UNCITED = f"""with {RUNS}, s as (select id, unnest(string_split(regexp_replace(coalesce(answer, ''), '([。；！？])', '\\1' || chr(10), 'g'), chr(10))) as s from r),
t as (select id, s from s where regexp_replace(s, '[\\s\\p{{Z}}\\x{{0085}}]', '', 'g') <> '')
select id, count(*) as sentences, count(case when length(regexp_replace(s, '[^0-9A-Za-z一-鿿]', '', 'g')) >= 8 and not regexp_matches(s, '\\[C[0-9]+\\]') then 1 end) as uncited from t group by id"""


def numeric_facts(spark: SparkSession, d: str) -> DataFrame:
    """Distinct (number, unit) facts of each answer, sorted."""
    return _runs(spark, d, "answer").select("id", F.array_join(F.array_sort(X.fact_pairs(F.col("answer"))), ";").alias("facts"))


FACTS = f"with {RUNS} select id, array_to_string({S.facts('answer')}, ';') as facts from r"


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    """Clauses under the key that contexts name them by, without the piece number."""
    u = corpus.units_once(table(spark, d, "units"))
    key = F.concat_ws("::", "doc_id", F.when(F.coalesce("part", F.lit("")) == "", "-").otherwise(F.col("part")), "clause_id")
    return u.select(key.alias("chunk_key"), "doc_id", "unit_id", "text").groupBy("chunk_key", "doc_id").agg(F.min_by("text", "unit_id").alias("text"))


def _issues(spark: SparkSession, d: str) -> DataFrame:
    """(id, span, fact, kind) of the numeric facts of each answer that the blocks it cites don't hold."""
    r = _runs(spark, d, "question", "answer", "context")
    bare = r.withColumn("context", F.transform("context", lambda b: F.struct(b["cid"].alias("cid"), F.transform(b["chunk_ids"], lambda c: F.substring_index(c, "#", 1)).alias("chunk_ids"))))
    return grounding.citation_issues(r, grounding.context_facts(bare, _chunks(spark, d)))


def citation_check(spark: SparkSession, d: str) -> DataFrame:
    """Numeric facts of each answer against the blocks it cites, by kind of issue."""
    return _issues(spark, d).groupBy("kind").agg(F.count("*").alias("issues"), F.countDistinct("id").alias("runs"))


def adversarial_detection(spark: SparkSession, d: str) -> DataFrame:
    """Answers whose first number is changed: is the change seen in the facts? Per type, over answers with a fact."""
    r = _runs(spark, d, "type", "answer").where(F.size(X.fact_pairs(F.col("answer"))) > 0)
    m = r.withColumn("changed", F.regexp_replace("answer", r"^([^0-9]*?)([0-9]+(?:\.[0-9]+)?)(\s*(?:%|日|元|次|个月|周岁))", "$19$2$3")).where("changed <> answer")
    seen = F.size(F.array_except(X.fact_pairs(F.col("changed")), X.fact_pairs(F.col("answer")))) > 0
    return m.groupBy("type").agg(F.count("*").alias("mutated"), F.count_if(seen).alias("detected"))


_CHANGED = r"regexp_replace(answer, '^([^0-9]*?)([0-9]+(?:\.[0-9]+)?)(\s*(?:%|日|元|次|个月|周岁))', '\19\2\3')"
ADVERSARIAL = f"""with {RUNS}, k as (select type, answer, {_CHANGED} as changed from r where answer is not null), m as (select type, {S.facts('answer')} as a, {S.facts('changed')} as b, changed <> answer as c from k)
select type, count(*) as mutated, count(case when len(list_filter(b, lambda f: not list_contains(a, f))) > 0 then 1 end) as detected from m where c and len(a) > 0 group by type"""

_GROUPED = "'((?s).*?)((?:\\[C[0-9]+\\])+)'"
ISSUES = f"""with {RUNS}, {S.UNITS},
ch as (select chunk_key, doc_id, {S.facts('text')} as held from (select concat_ws('::', doc_id, case when coalesce(part, '') = '' then '-' else part end, clause_id) as chunk_key, doc_id, arg_min(text, unit_id) as text from u group by 1, 2)),
cx as (select id, c.cid as cid, regexp_replace(unnest(c.chunk_ids), '#.*$', '') as chunk_key from (select id, unnest(context) as c from r)),
b as (select id, cid, list_distinct(flatten(list(held))) as held, list(distinct doc_id) as docs from cx join ch on ch.chunk_key = cx.chunk_key group by 1, 2),
sp0 as (select id, question, regexp_extract_all(coalesce(answer, ''), {_GROUPED}, 1) as t, regexp_extract_all(coalesce(answer, ''), {_GROUPED}, 2) as g, regexp_replace(coalesce(answer, ''), '(?s)^.*\\[C[0-9]+\\]', '') as rest from r),
sp1 as (select id, question, unnest(t) as t, unnest(g) as g, generate_subscripts(t, 1) as span from sp0 union all select id, question, rest, '', 1000000 from sp0),
sp as (select id, span, regexp_extract_all(g, 'C[0-9]+') as cited, list_filter({S.facts('t')}, lambda f: not list_contains(asked, f)) as facts from (select *, {S.facts('question')} as asked from sp1)),
sup as (select s.id, s.span, flatten(list(b.held)) as supported, list_distinct(flatten(list(b.docs))) as docs from (select id, span, unnest(cited) as cid from sp where len(facts) > 0 and len(cited) > 0) s join b on b.id = s.id and b.cid = s.cid group by 1, 2),
fx as (select f.id, f.span, f.fact, sup.docs from (select id, span, unnest(facts) as fact from sp where len(cited) > 0) f left join sup on sup.id = f.id and sup.span = f.span where not coalesce(list_contains(sup.supported, f.fact), false)),
hb as (select id, unnest(held) as fact, docs from b),
issues as (select id, span, null as fact, 'uncited' as kind from sp where len(facts) > 0 and len(cited) = 0
union all select fx.id, fx.span, fx.fact, case when count(hb.docs) = 0 then 'absent' when bool_or(coalesce(list_has_any(hb.docs, fx.docs), false)) then 'imprecise' else 'misattributed' end from fx left join hb on hb.id = fx.id and hb.fact = fx.fact group by 1, 2, 3)"""
CHECK = f"{ISSUES} select kind, count(*) as issues, count(distinct id) as runs from issues group by kind"

_GOLD = """g as (select id, any_value(must_include) as mi, any_value(must_not_include) as mn, any_value(type) as gtype from golden_blind_v1 where id is not null group by id),
j as (select r.*, gtype, mi, mn, len(list_filter(mi, lambda p: contains(coalesce(answer, ''), p))) as covered, len(mi) as points from r join g on g.id = r.id)"""


def _judged(spark: SparkSession, d: str) -> DataFrame:
    """Runs of golden questions with the key points their answers cover. A strict join by id."""
    g = table(spark, d, "golden_blind_v1").where("id is not null").groupBy("id").agg(F.max(F.struct("must_include", "must_not_include", F.col("type").alias("gtype"))).alias("g"))
    r = _runs(spark, d, "model", "answer", "refused", "relevant_in_context", "invalid_citations").join(g, "id").select("*", "g.*").drop("g")
    has = F.filter("must_include", lambda p: F.contains(F.coalesce(F.col("answer"), F.lit("")), p))
    return r.withColumn("covered", F.size(has)).withColumn("points", F.size("must_include"))


def _verdict() -> Column:
    return F.when(F.col("points") == F.col("covered"), "correct").when(F.col("covered") > 0, "partial").otherwise("incorrect")


_VERDICT_SQL = "case when points = covered then 'correct' when covered > 0 then 'partial' else 'incorrect' end"


def judge_summary(spark: SparkSession, d: str) -> DataFrame:
    j = _judged(spark, d).withColumn("verdict", _verdict())
    return j.groupBy("gtype", "verdict").agg(F.count("*").alias("runs"), F.count_if(F.col("refused")).alias("refused"))


JUDGE = f"with {RUNS}, {_GOLD} select gtype, {_VERDICT_SQL} as verdict, count(*) as runs, count(case when refused then 1 end) as refused from j group by 1, 2"


def failure_attribution(spark: SparkSession, d: str) -> DataFrame:
    """Why a run isn't correct: it answers what should be refused, the context lacks the evidence, or the generation failed."""
    cause = (
        F.when((F.col("gtype") == "refuse") & ~F.coalesce("refused", F.lit(False)), "over_answer").when(F.col("gtype") == "refuse", "correct")
        .when(F.col("points") == F.col("covered"), "correct").when(F.size("relevant_in_context") == 0, "retrieval").otherwise("generation")
    )
    return _judged(spark, d).withColumn("cause", cause).groupBy("cause").agg(F.count("*").alias("runs"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


ATTRIBUTION = f"""with {RUNS}, {_GOLD} select case when gtype = 'refuse' and not coalesce(refused, false) then 'over_answer' when gtype = 'refuse' then 'correct' when points = covered then 'correct'
when len(relevant_in_context) = 0 then 'retrieval' else 'generation' end as cause, count(*) as runs, min(id) as first_id, max(id) as last_id from j group by 1"""

_REFUSES = "^(抱歉|对不起|很遗憾|根据提供的条款无法|无法|暂无法|不清楚|I am sorry|I'm )"


def calibration_agreement(spark: SparkSession, d: str) -> DataFrame:
    """The stored refusal flag against the rule on the answer's beginning, per model."""
    r = _runs(spark, d, "model", "answer", "refused").withColumn("rule", F.coalesce(F.col("answer").rlike(_REFUSES), F.lit(False)))
    return r.groupBy("model").agg(
        F.count("*").alias("runs"), F.count_if(F.col("refused") == F.col("rule")).alias("agree"), F.count_if(F.col("rule") & ~F.col("refused")).alias("rule_only"), F.count_if(~F.col("rule") & F.col("refused")).alias("flag_only")
    )


_REFUSES_SQL = _REFUSES.replace("'", "''")
CALIBRATION = f"""with {RUNS}, k as (select *, coalesce(regexp_matches(answer, '{_REFUSES_SQL}'), false) as rule from r)
select model, count(*) as runs, count(case when refused = rule then 1 end) as agree, count(case when rule and not refused then 1 end) as rule_only, count(case when not rule and refused then 1 end) as flag_only from k group by model"""


def checker_contingency(spark: SparkSession, d: str) -> DataFrame:
    """Citation checker against key-point verdict: who finds fault."""
    j = _judged(spark, d)
    a, b = F.coalesce(F.size("invalid_citations") > 0, F.lit(False)), F.col("points") > F.col("covered")
    who = F.when(a & b, "both").when(a, "checker only").when(b, "verdict only").otherwise("neither")
    return j.groupBy(who.alias("who")).agg(F.count("*").alias("runs"))


CONTINGENCY = f"""with {RUNS}, {_GOLD}, k as (select coalesce(len(invalid_citations) > 0, false) as a, points > covered as b from j)
select case when a and b then 'both' when a then 'checker only' when b then 'verdict only' else 'neither' end as who, count(*) as runs from k group by 1"""


# The four styles of quotation.
QUOTED = '“[^”]*”|"[^"]*"|「[^」]*」|‘[^’]*’'


def leak_scoring(spark: SparkSession, d: str) -> DataFrame:
    """Forbidden strings that an answer holds outside quotation marks, per model and type; runs with a hit fail."""
    j = _judged(spark, d)
    bare = F.regexp_replace(F.coalesce(F.col("answer"), F.lit("")), QUOTED, "")
    hits = F.size(F.filter("must_not_include", lambda p: (p != "") & F.contains(bare, p)))
    return j.withColumn("hits", hits).groupBy("model", "gtype").agg(F.count("*").alias("runs"), F.count_if(F.col("hits") > 0).alias("leaking"), F.sum("hits").alias("hits"))


LEAK = f"""with {RUNS}, {_GOLD}, k as (select model, gtype, len(list_filter(mn, lambda p: p <> '' and contains(regexp_replace(coalesce(answer, ''), '{QUOTED}', '', 'g'), p))) as hits from j)
select model, gtype, count(*) as runs, count(case when hits > 0 then 1 end) as leaking, cast(sum(hits) as bigint) as hits from k group by model, gtype"""


def _paired(spark: SparkSession, d: str) -> DataFrame:
    """Runs of two nightly systems, paired by an explicit ordinal within product, type and day."""
    r = _runs(spark, d, "run", "product", "type", "asked_at", "question", "refused", "seconds").withColumn("day", F.to_date("asked_at")).withColumn("product", F.coalesce("product", F.lit("")))
    w = Window.partitionBy("run", "product", "type", "day").orderBy("id")
    r = r.where(F.col("run").isin("nightly-a", "nightly-b")).withColumn("n", F.row_number().over(w))
    key = ["product", "type", "day", "n"]
    a, b = (r.where(F.col("run") == f"nightly-{s}").select(*key, F.col("id").alias(f"id_{s}"), F.col("question").alias(f"q_{s}"), F.coalesce("refused", F.lit(False)).alias(f"refused_{s}"), F.col("seconds").alias(f"sec_{s}")) for s in "ab")
    return a.join(b, key)


def routing_policies(spark: SparkSession, d: str) -> DataFrame:
    """Offline simulation: which of two systems would answer under each policy, the answer rate and the seconds; the oracle takes the cheaper that answers."""
    p = _paired(spark, d)
    shape = (F.regexp_count("q_a", F.lit("[?？]")) >= 2) | F.col("q_a").rlike("另外|还有|顺便问|再确认|比较|区别")
    cascade = F.col("refused_a")
    oracle = F.col("refused_a") & ~F.col("refused_b")
    rules = F.array(*[F.struct(F.lit(n).alias("policy"), c.alias("to_b")) for n, c in (("always_a", F.lit(False)), ("always_b", F.lit(True)), ("shape", shape), ("cascade", cascade), ("shape_or_cascade", shape | cascade), ("oracle", oracle))])
    x = p.select("*", F.explode(rules).alias("r")).select("*", "r.policy", "r.to_b")
    sec = F.when(F.col("to_b"), F.col("sec_b")).otherwise(F.col("sec_a"))
    both = F.col("policy").isin("cascade", "shape_or_cascade") & F.col("to_b") & F.col("refused_a")
    spent = sec + F.when(both, F.col("sec_a")).otherwise(0.0)
    return x.groupBy("policy").agg(
        F.count("*").alias("items"), F.count_if("to_b").alias("routed"), F.count_if(~F.when(F.col("to_b"), F.col("refused_b")).otherwise(F.col("refused_a"))).alias("answered"),
        F.round(F.avg(F.when(spent >= 0, spent)), 4).alias("avg_seconds"),
    )


ROUTING = f"""with {RUNS}, k as (select *, cast(asked_at as date) as day, coalesce(product, '') as prod, row_number() over (partition by run, coalesce(product, ''), type, cast(asked_at as date) order by id) as n from r where run in ('nightly-a', 'nightly-b')),
p as (select a.question as qa, coalesce(a.refused, false) as ra, coalesce(b.refused, false) as rb, a.seconds as sa, b.seconds as sb from (select * from k where run = 'nightly-a') a join (select * from k where run = 'nightly-b') b on a.prod = b.prod and a.type = b.type and a.day = b.day and a.n = b.n),
s as (select *, len(regexp_extract_all(qa, '[?？]')) >= 2 or regexp_matches(qa, '另外|还有|顺便问|再确认|比较|区别') as shape from p),
x as (select s.*, policy, case policy when 'always_a' then false when 'always_b' then true when 'shape' then shape when 'cascade' then ra when 'shape_or_cascade' then shape or ra else ra and not rb end as tb
from s, (select unnest(['always_a', 'always_b', 'shape', 'cascade', 'shape_or_cascade', 'oracle']) as policy)),
y as (select *, (case when tb then sb else sa end) + case when policy in ('cascade', 'shape_or_cascade') and tb and ra then sa else 0.0 end as spent from x)
select policy, count(*) as items, count(case when tb then 1 end) as routed, count(case when not (case when tb then rb else ra end) then 1 end) as answered, round(avg(case when spent >= 0 then spent end), 4) as avg_seconds from y group by policy"""


def call_cache(spark: SparkSession, d: str) -> DataFrame:
    """Content-addressed calls per model: distinct keys are calls, repeats are hits; cut replies are never stored."""
    r = _runs(spark, d, "model", "question", "finish_reason").withColumn("key", F.substring(F.sha2(F.concat_ws("\n", "model", "question"), 256), 1, 24))
    per = r.groupBy("model", "key").agg(F.count("*").alias("n"), F.bool_or(F.coalesce(F.col("finish_reason") != "length", F.lit(False))).alias("stored"))
    return per.groupBy("model").agg(F.sum("n").alias("calls"), F.count("*").alias("distinct_calls"), F.sum(F.when(F.col("stored"), F.col("n") - 1).otherwise(0)).alias("hits"), F.min("key").alias("first_key"))


CACHE = f"""with {RUNS}, k as (select model, substr(sha256(model || chr(10) || question), 1, 24) as key, count(*) as n, bool_or(coalesce(finish_reason <> 'length', false)) as stored from r group by 1, 2)
select model, cast(sum(n) as bigint) as calls, count(*) as distinct_calls, cast(sum(case when stored then n - 1 else 0 end) as bigint) as hits, min(key) as first_key from k group by model"""


def wrapped_answers(spark: SparkSession, d: str) -> DataFrame:
    """Answers that are unparsed output: the first object in them, its strings among the citations (at most four)."""
    r = _runs(spark, d, "answer").where(F.contains("answer", F.lit('"answer"'))).withColumn("v", X.first_json(F.col("answer")))
    cites = F.try_variant_get("v", "$.citations", "array<variant>")
    strings = F.slice(F.filter(cites, lambda c: F.schema_of_variant(c) == "STRING"), 1, 4)
    return r.select("id", F.col("v").isNotNull().alias("parsed"), F.coalesce(F.char_length(F.try_variant_get("v", "$.answer", "string")), F.lit(0)).alias("answer_chars"), F.coalesce(F.size(strings), F.lit(0)).alias("citations"))


WRAPPED = f"""with {RUNS}, k as (select id, regexp_extract(answer, '([{{](?s).*[}}])', 1) as t from r where contains(answer, '"answer"')), v as (select id, case when t <> '' and json_valid(t) then cast(t as json) end as v from k)
select id, v is not null as parsed, coalesce(length(json_extract_string(v, '$.answer')), 0) as answer_chars, case when v is null then 0 else least(4, len(json_extract_string(v, '$.citations[*]'))) end as citations from v"""


def tool_call_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Repeated calls of one signature (user, kind, arguments): errors aren't remembered, later ones point to the first."""
    e = table(spark, d, "events").where("event_type <> 'error'")
    s = e.groupBy("user_id", "event_type", "props").agg(F.count("*").alias("n"), F.min(F.struct("ts", "event_id")).alias("first"))
    return s.where("n > 1").select("user_id", "event_type", "props", (F.col("n") - 1).alias("repeats"), F.col("first.event_id").alias("first_event"))


DEDUP = """select user_id, event_type, props, count(*) - 1 as repeats, arg_min(event_id, struct_pack(ts := ts, e := event_id)) as first_event from events where event_type <> 'error' group by 1, 2, 3 having count(*) > 1"""


def trajectory_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Episodes (one per user): steps, errors, how the first eight steps end: submitted at the first purchase within them, else forced."""
    e = table(spark, d, "events").withColumn("step", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    per = e.groupBy("user_id").agg(F.count("*").alias("steps"), F.count_if(F.col("event_type") == "error").alias("errors"), F.min(F.when(F.col("event_type") == "purchase", F.col("step"))).alias("submit"))
    return per.select("user_id", "steps", "errors", F.when(F.col("submit") <= 8, "submitted").otherwise("forced").alias("stop"), F.least(F.coalesce("submit", F.lit(9)), F.lit(9), "steps").cast("bigint").alias("rounds"))


TRAJECTORY = """with e as (select *, row_number() over (partition by user_id order by ts, event_id) as step from events)
select user_id, count(*) as steps, count(case when event_type = 'error' then 1 end) as errors, case when min(case when event_type = 'purchase' then step end) <= 8 then 'submitted' else 'forced' end as stop,
least(coalesce(min(case when event_type = 'purchase' then step end), 9), 9, count(*)) as rounds from e group by user_id"""


def json_arg_validation(spark: SparkSession, d: str) -> DataFrame:
    """Arguments against their schema, an object with an integer k from 0 to 79: the first rule that fails names the error."""
    v = table(spark, d, "events").select("event_type", F.try_parse_json("props").alias("v"))
    kind = F.schema_of_variant("v")
    k = F.schema_of_variant(F.try_variant_get("v", "$.k", "variant"))
    n = F.try_variant_get("v", "$.k", "bigint")
    code = (
        F.when(F.col("v").isNull(), "bad_json").when(~F.startswith(kind, F.lit("OBJECT")), "not_object").when(k.isNull(), "missing")
        .when(k != "BIGINT", "type").when((n < 0) | (n > 79), "enum").otherwise("ok")
    )
    return v.groupBy("event_type", code.alias("code")).agg(F.count("*").alias("calls"))


JSON_ARGS = """with v as (select event_type, case when json_valid(props) then cast(props as json) end as v from events)
select event_type, case when v is null then 'bad_json' when json_type(v) <> 'OBJECT' then 'not_object' when json_extract(v, '$.k') is null then 'missing'
when json_type(v, '$.k') not in ('UBIGINT', 'BIGINT') then 'type' when cast(json_extract(v, '$.k') as bigint) not between 0 and 79 then 'enum' else 'ok' end as code, count(*) as calls from v group by 1, 2"""


def date_window_calc(spark: SparkSession, d: str) -> DataFrame:
    """First and last day of a period of whole days from an order's date, its first day counted or not."""
    o = table(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("start"), (F.col("o_orderkey") % 180 + 1).cast("int").alias("days"), (F.col("o_orderkey") % 2 == 0).alias("counted"))
    return o.select("o_orderkey", F.when(F.col("counted"), F.col("start")).otherwise(F.date_add("start", 1)).alias("first_day"), F.date_add("start", F.col("days") - F.when(F.col("counted"), 1).otherwise(0)).alias("last_day"))


DATES = """select o_orderkey, cast(o_orderdate as date) + case when o_orderkey % 2 = 0 then 0 else 1 end as first_day,
cast(o_orderdate as date) + cast(o_orderkey % 180 + 1 - case when o_orderkey % 2 = 0 then 1 else 0 end as int) as last_day from orders"""

CATALOGUE = {
    "latency_quantiles": (latency_quantiles, LATENCY),
    "upper_median_chars": (upper_median_chars, UPPER_MEDIAN),
    "ops_error_rates": (ops_error_rates, ERRORS),
    "generation_summary": (generation_summary, GENERATION),
    "usage_profile": (usage_profile, USAGE),
    "context_citations": (context_citations, CITATIONS),
    "citation_spans": (citation_spans, SPANS),
    "uncited_sentences": (uncited_sentences, UNCITED),
    "numeric_facts": (numeric_facts, FACTS),
    "citation_check": (citation_check, CHECK),
    "adversarial_detection": (adversarial_detection, ADVERSARIAL),
    "judge_summary": (judge_summary, JUDGE),
    "failure_attribution": (failure_attribution, ATTRIBUTION),
    "calibration_agreement": (calibration_agreement, CALIBRATION),
    "checker_contingency": (checker_contingency, CONTINGENCY),
    "leak_scoring": (leak_scoring, LEAK),
    "routing_policies": (routing_policies, ROUTING),
    "call_cache": (call_cache, CACHE),
    "wrapped_answers": (wrapped_answers, WRAPPED),
    "tool_call_dedup": (tool_call_dedup, DEDUP),
    "trajectory_metrics": (trajectory_metrics, TRAJECTORY),
    "json_arg_validation": (json_arg_validation, JSON_ARGS),
    "date_window_calc": (date_window_calc, DATES),
}
