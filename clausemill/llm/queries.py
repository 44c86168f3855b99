"""Registered queries of the training-data operators, and the SQL that some of them are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import corpus
from ..plans import sqltext as S
from ..session import materialize
from ..sources.tables import table
from . import abuse, bpe, lookalike, mixing, neardup, overlap, pairs, quantile, split, truncation


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return pairs.broken_pairs(table(spark, d, "gen_v3_p2_blind"))


def p1_rates(spark: SparkSession, d: str) -> DataFrame:
    """Defects per model: each id counts once."""
    g = table(spark, d, "gen_v3_p2_blind")
    own = g.where("id is not null").groupBy("id").agg(F.min("model").alias("model"))
    j = own.join(pairs.broken_pairs(g), "id", "left")
    n = F.count("*")
    return j.groupBy("model").agg(n.alias("records"), *[F.count_if(F.col("defect") == k).alias(k) for k in pairs.DEFECTS], (F.count("defect") / n).alias("defect_share"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncated(table(spark, d, "gen_v3_p2_blind2_1"))


def p2_rates(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "gen_v3_p2_blind2_1")
    return truncation.truncation_rates(g, materialize(truncation.truncated(g), "cut"))


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    both = [table(spark, d, n).select(F.col("cand_id").alias("id"), F.col("question").alias("text")) for n in ("blind_v3_candidates", "blind_v5_candidates")]
    return both[0].union(both[1])


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.group_pairs(neardup.similar_groups(_candidates(spark, d)))


def p3_groups(spark: SparkSession, d: str) -> DataFrame:
    return neardup.near_duplicates(_candidates(spark, d))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_pieces(spark, d).select("unit_id").distinct()


def p4_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split.split_oversized(table(spark, d, "units"), table(spark, d, "split_limits"))


def p4_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Per oversized unit: characters of its text that the pieces cover, and whether each piece keeps the limit, repeats no more than the overlap, begins where the one before ended and numbers go on."""
    lim = table(spark, d, "split_limits").select("section", "max_chars", "overlap_chars")
    own = corpus.latest(table(spark, d, "units").select("unit_id", "loaded_at", "section"), "unit_id").join(lim, "section").select("unit_id", "max_chars", "overlap_chars")
    p = p4_pieces(spark, d).join(own, "unit_id")
    return p.groupBy("unit_id").agg(
        F.sum(F.col("n_chars") - F.col("lead_chars")).alias("covered"), F.bool_and(F.col("n_chars") <= F.col("max_chars")).alias("within_limit"), F.bool_and(F.col("lead_chars") <= F.col("overlap_chars")).alias("within_overlap"),
        (F.max(F.col("start") + F.col("n_chars") - F.col("lead_chars")) == F.sum(F.col("n_chars") - F.col("lead_chars"))).alias("no_gap"), (F.max("piece_no") + 1 == F.count("*")).alias("numbered"),
    )


def _held(spark: SparkSession, d: str) -> DataFrame:
    both = [table(spark, d, n).select("id", "question", "writer", F.lit(n).alias("split")) for n in ("golden_blind_v3", "golden_blind_v6")]
    return both[0].union(both[1])


def p5_coverage(spark: SparkSession, d: str) -> DataFrame:
    train = table(spark, d, "golden_blind_v1").select("id", F.col("question").alias("text"))
    return overlap.cross_overlaps(train, _held(spark, d).select("id", F.col("question").alias("text")))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_coverage(spark, d).select("id_a", "id_b")


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlap_report(p5_coverage(spark, d), _held(spark, d))


def _named(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({"g0": "model", "g1": "type", "g2": "day"})


def p6_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return _named(quantile.percentiles(quantile.summaries(quantile.readings(table(spark, d, "gen_v3_p2_blind"))), few=True))


def _overall(values: DataFrame, eps: float = quantile.EPS) -> DataFrame:
    """Percentiles per model and measure, from the summaries of its types and days."""
    s = quantile.summaries(values, eps)
    one = s.withColumn("part", F.xxhash64("g1", "g2", "part")).withColumn("g1", F.lit("all")).withColumn("g2", F.lit(None).cast("date"))
    return quantile.percentiles(one, eps=eps)


def p6_model_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles per model and measure, from the summaries of its types and days."""
    return _named(_overall(quantile.readings(table(spark, d, "gen_v3_p2_blind")))).drop("type", "day")


def p6_model_bounds(spark: SparkSession, d: str) -> DataFrame:
    """The percentiles per model against the true ranks of all readings: is each within its bound, and the bound within eps of the group?"""
    values = quantile.readings(table(spark, d, "gen_v3_p2_blind"))
    t = _named(quantile.true_ranks(values.withColumn("g1", F.lit("all")).withColumn("g2", F.lit(None).cast("date")), _overall(values)))
    return t.select("model", "metric", "n", (F.col("off") <= F.col("rank_error")).alias("within_bound"), (F.col("rank_error") <= quantile.EPS * F.col("n") + 1).alias("bound_within_eps"))


def p6_coarse_bounds(spark: SparkSession, d: str) -> DataFrame:
    """The same over all models for an error of 5 %, so that values are left out in small tables too: is there a sketch behind it?"""
    values = quantile.readings(table(spark, d, "gen_v3_p2_blind")).withColumns({"g0": F.lit("all"), "g1": F.lit("all"), "g2": F.lit(None).cast("date")})
    t = quantile.true_ranks(values, quantile.percentiles(quantile.summaries(values, 0.05), eps=0.05, few=True))
    return t.select("metric", "n", (F.col("off") <= F.col("rank_error")).alias("within_bound"), (F.col("rank_error") <= 0.05 * F.col("n") + 1).alias("bound_within_eps"), (F.col("rank_error") > 0).alias("sketched"))


def p7_forms(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.canonical_values(lookalike.fields(table(spark, d, "golden_blind_v6")))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.same_look_pairs(p7_forms(spark, d))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode_corpus(table(spark, d, "documents"))


def p9_selection(spark: SparkSession, d: str) -> DataFrame:
    units = materialize(mixing.sized(table(spark, d, "documents")), "sized")
    return mixing.balanced_selection(units, mixing.quotas(units, table(spark, d, "mix_targets")))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    units = materialize(mixing.sized(table(spark, d, "documents")), "sized")
    q = mixing.quotas(units, table(spark, d, "mix_targets"))
    return mixing.mix_shares(mixing.balanced_selection(units, q), q)


def p9_balance(spark: SparkSession, d: str) -> DataFrame:
    """Per target source: are its tokens as planned but for a thousandth or its largest two rows, are rows taken floor(c) or floor(c) + 1 times, and never more than max_repeats?"""
    units = materialize(mixing.sized(table(spark, d, "documents")), "sized")
    q = mixing.quotas(units, table(spark, d, "mix_targets"))
    got = mixing.balanced_selection(units, q)
    most = units.groupBy("source").agg(F.max("tokens").alias("largest"))
    per = got.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.min("copies").alias("least"), F.max("copies").alias("most"))
    j = q.join(most, "source", "left").join(per, "source", "left")
    off = F.abs(F.coalesce("tokens", F.lit(0)) - F.col("quota"))
    return j.select(
        "source", "target_share", "max_repeats", (off <= F.greatest(0.001 * F.col("quota"), 2 * F.coalesce("largest", F.lit(0)))).alias("as_planned"),
        F.coalesce((F.col("least") >= F.greatest(F.floor(F.col("copies") + 1e-12), F.lit(1))) & (F.col("most") <= F.floor(F.col("copies") + 1e-12) + 1), F.lit(True)).alias("copies_even"),
        F.coalesce(F.col("most") <= F.col("max_repeats"), F.lit(True)).alias("within_repeats"),
    )


def p10_scores(spark: SparkSession, d: str) -> DataFrame:
    return abuse.scored(table(spark, d, "documents"), table(spark, d, "doc_labels"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return abuse.unsafe(p10_scores(spark, d))


def p10_rates(spark: SparkSession, d: str) -> DataFrame:
    return abuse.rates(p10_scores(spark, d))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Of each problem the query with fixed columns first."""
    return {
        f.__name__: f
        for f in (
            p1_found, p1_rates, p2_found, p2_rates, p3_found, p3_groups, p4_found, p4_pieces, p4_coverage, p5_found, p5_coverage, p5_report,
            p6_percentiles, p6_model_percentiles, p6_model_bounds, p6_coarse_bounds, p7_found, p7_forms, p8_ids, p9_selection, p9_shares, p9_balance, p10_found, p10_scores, p10_rates,
        )
    }


_WIDE = "".join(chr(c) for c in (*range(0xFF10, 0xFF1A), *range(0xFF21, 0xFF3B), *range(0xFF41, 0xFF5B)))
_NARROW = "".join(chr(ord(c) - 0xFEE0) for c in _WIDE)


def _plain_sql(column: str) -> str:
    return f"regexp_replace(translate({column}, '{_WIDE}', '{_NARROW}'), '[^\\p{{L}}\\p{{N}}]', '', 'g')"


def _grams_sql(name: str) -> str:
    """CTEs of distinct character pairs and their number, from a CTE ``name`` (id, n)."""
    return f"""{name}_g as (select distinct id, substr(n, i, 2) as g from (select id, n, unnest(range(1, greatest(length(n), 2))) as i from {name} where n <> '') where true),
{name}_s as (select id, count(*) as c from {name}_g group by id)"""


def oracle_sql() -> dict[str, str]:
    """Plain all-pairs SQL for what SQL can express."""
    p3 = f"""with recursive t as (select cand_id as id, min({_plain_sql('question')}) as n from (select cand_id, question from blind_v3_candidates union all
select cand_id, question from blind_v5_candidates) where question is not null and cand_id is not null group by cand_id),
{_grams_sql('t')},
l as (select x.id as a, y.id as b from t_g x join t_g y on x.g = y.g join t_s sx on sx.id = x.id join t_s sy on sy.id = y.id where x.id <> y.id
group by x.id, y.id having count(*) >= 0.5 * (min(sx.c) + min(sy.c) - count(*))),
r(id, root) as (select distinct a, a from l union select r.id, l.b from r join l on l.a = r.root),
c as (select id, min(root) as root from r group by id)
select x.id as id_a, y.id as id_b from c x join c y on x.root = y.root and x.id < y.id"""
    p5 = f"""with t as (select id, min({_plain_sql('question')}) as n from golden_blind_v1 where question is not null group by id),
h as (select id, min({_plain_sql('question')}) as n from (select id, question from golden_blind_v3 union all select id, question from golden_blind_v6) where question is not null group by id),
{_grams_sql('t')},
{_grams_sql('h')}
select x.id as id_a, y.id as id_b from t_g x join h_g y on x.g = y.g join t_s sx on sx.id = x.id join h_s sy on sy.id = y.id
group by x.id, y.id having count(*) >= 0.5 * (min(sx.c) + min(sy.c) - count(*))"""
    p4 = """with u as (select unit_id, section, max(coalesce(list_sum(list_transform(lines, lambda x: coalesce(length(x.line), 0))), 0)) as n from units group by unit_id, section)
select u.unit_id from u join split_limits s on s.section = u.section where u.n > s.max_chars"""
    ranked = ", ".join(f"max(case when r = greatest(1, cast(ceil({q} * n - 1e-9) as bigint)) then value end) as p{round(q * 100)}" for q in (0.5, 0.9, 0.95, 0.99))
    p6 = f"""with one as (select arg_max(struct_pack(model := model, type := type, asked_at := asked_at, seconds := seconds, p := usage.prompt, c := usage.completion), loaded_at) as r
from gen_v3_p2_blind where id is not null group by id),
v as (select r.model as model, r.type as type, cast(r.asked_at as date) as day, 'seconds' as metric, r.seconds as value from one
union all select r.model, r.type, cast(r.asked_at as date), 'prompt', cast(r.p as double) from one
union all select r.model, r.type, cast(r.asked_at as date), 'completion', cast(r.c as double) from one),
k as (select *, row_number() over (partition by model, type, day, metric order by value) as r, count(*) over (partition by model, type, day, metric) as n from v where value >= 0)
select model, type, day, metric, max(n) as n, {ranked}, cast(0 as bigint) as rank_error from k group by model, type, day, metric"""
    one = p6[: p6.index(",\nk as")]
    bounds = one + " select model, metric, count(*) as n, true as within_bound, true as bound_within_eps from v where value >= 0 group by model, metric"
    coarse = one + " select metric, count(*) as n, true as within_bound, true as bound_within_eps, true as sketched from v where value >= 0 group by metric"
    p4_coverage = f"""with {S.UNITS}, k as (select u.unit_id, length(u.text) as n, (select coalesce(sum(coalesce(length(x.line), 0)), 0) from (select unnest(lines) as x)) as chars, u.section from u join u0 on u0.unit_id = u.unit_id and u0.rn = 1)
select k.unit_id, k.n as covered, true as within_limit, true as within_overlap, true as no_gap, true as numbered from k join split_limits s on s.section = k.section where k.chars > s.max_chars"""
    shares = """with t as (select source, max(coalesce(target_share, 0)) as target_share, max(coalesce(max_repeats, 0)) as max_repeats from mix_targets where source is not null group by source)
select source, target_share, cast(max_repeats as int) as max_repeats, true as as_planned, true as copies_even, true as within_repeats from t"""
    return {"p4_coverage": p4_coverage, "p9_balance": shares, "p3_found": p3, "p4_found": p4, "p5_found": p5, "p6_percentiles": p6, "p6_model_bounds": bounds, "p6_coarse_bounds": coarse}
