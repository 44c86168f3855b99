"""SQL pieces shared by the oracles."""

from __future__ import annotations

QUESTIONS = """q as (select cast(substr(id, 2) as bigint) as qid, min(question) as text, min(type) as type from golden_blind_v1
where question is not null and cast(substr(id, 2) as bigint) % 20 = 0 group by 1)"""


def glue(lines: str) -> str:
    """Text of a list of lines, as the operator joins them."""
    t = f"array_to_string(list_filter(list_transform({lines}, lambda x: coalesce(x.line, '')), lambda t: t <> ''), chr(30))"
    once = f"regexp_replace({t}, '([A-Za-z0-9])' || chr(30) || '([A-Za-z0-9])', '\\1 \\2', 'g')"
    twice = f"regexp_replace({once}, '([A-Za-z0-9])' || chr(30) || '([A-Za-z0-9])', '\\1 \\2', 'g')"
    return f"coalesce(replace({twice}, chr(30), ''), '')"


UNITS = f"""u0 as (select *, row_number() over (partition by unit_id order by loaded_at desc) as rn from units where unit_id is not null),
u as (select unit_id, doc_id, section, part, section_title, clause_id, title, list_min(list_transform(lines, lambda x: x.page)) as page_start,
list_max(list_transform(lines, lambda x: x.page)) as page_end, {glue('lines')} as text from u0 where rn = 1)"""


def tokens(text: str) -> str:
    low = f"lower(coalesce({text}, ''))"
    pairs = f"list_filter(list_transform(range(1, greatest(length({low}), 1)), lambda i: substr({low}, i, 2)), lambda x: regexp_full_match(x, '[一-鿿]{{2}}'))"
    return f"list_concat(regexp_extract_all({low}, '[a-z0-9]+'), {pairs})"


INDEX = f"""docs as (select unit_id as id, {tokens('text')} as t from u),
st as (select count(*) as n_docs, avg(len(t)) as avgdl from docs),
p as (select id, len(t) as dl, term, count(*) as tf from (select id, t, unnest(t) as term from docs) group by id, len(t), term),
w0 as (select term, count(*) as df, any_value(n_docs) as n_docs from p, st group by term),
w as (select term, df, ln(1 + (n_docs - df + 0.5) / (df + 0.5)) as lucene, ln((n_docs - df + 0.5) / (df + 0.5)) as raw from w0),
wk as (select *, case when raw >= 0 then raw else 0.25 * (select avg(raw) from w) end as okapi from w)"""

HITS = f"""qt as (select qid, term, count(*) as qtf from (select qid, unnest({tokens('text')}) as term from q) group by qid, term),
hit as (select qid, id, qt.term as term, qtf * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl)) as f, lucene, okapi from qt join wk on qt.term = wk.term join p on p.term = qt.term, st)"""


def ranked_hits(idf: str) -> str:
    return f"""sc as (select qid, id, round(sum({idf} * f), 6) as score from hit group by qid, id),
r as (select *, row_number() over (partition by qid order by score desc, id) as rank from sc)"""


def bm25(idf: str) -> str:
    return "with " + ",\n".join((QUESTIONS, UNITS, INDEX, HITS, ranked_hits(idf)))


def facts(text: str) -> str:
    """List of the distinct "number unit" facts of a text, as ``functions.text.fact_pairs`` gives them. RE2 has no look-ahead: years before 内 and 以 are set aside while dates are masked."""
    from ..functions.text import FACTS

    t = f"translate(coalesce({text}, ''), 'ⅠⅡⅢⅣⅤ', '12345')"
    day = "[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}|(?:[0-9]{4}\\s*年\\s*)?[0-9]{1,2}\\s*月\\s*[0-9]{1,2}\\s*日"
    t = f"regexp_replace({t}, '([0-9]{{4}}\\s*)年(\\s*[内以])', '\\1' || chr(31) || '\\2', 'g')"
    t = f"replace(regexp_replace({t}, '{day}|[0-9]{{4}}\\s*年', ' ', 'g'), chr(31), '年')"
    digit = "case when c = '两' then 2 when c = '〇' then 0 else position(c in '零一二三四五六七八九') - 1 end"
    unit = "case c when '十' then 10 when '百' then 100 when '千' then 1000 end"
    numeral = f"""list_reduce(list_filter(string_split(n, ''), lambda c: c <> ''), lambda s, c: case when {unit} is not null then struct_pack(t := s.t + greatest(s.c, 1) * {unit}, c := cast(0 as bigint)) else struct_pack(t := s.t, c := cast({digit} as bigint)) end,
struct_pack(t := cast(0 as bigint), c := cast(0 as bigint)))"""
    plain = f"case when regexp_matches(n, '^[0-9]+[.]') then regexp_replace(regexp_replace(n, '0+$', ''), '[.]$', '') when regexp_matches(n, '^[0-9]') then n else cast(({numeral}).t + ({numeral}).c as varchar) end"
    pairs = f"list_zip(regexp_extract_all({t}, '{FACTS}', 1), regexp_extract_all({t}, '{FACTS}', 2))"
    as_ = "case u when '天' then '日' when '％' then '%' when '周岁' then '岁' else u end"
    normed = f"list_transform(list_transform({pairs}, lambda p: struct_pack(n := p[1], u := p[2])), lambda q: list_transform([q], lambda x: struct_pack(n := list_transform([x.n], lambda n: {plain})[1], u := list_transform([x.u], lambda u: {as_})[1]))[1])"
    kept = f"list_filter({normed}, lambda f: not ((f.n = '1' and f.u = '次') or (f.u = '种' and cast(f.n as double) < 10) or (f.u = '年' and cast(f.n as double) >= 1900)))"
    return f"list_sort(list_distinct(list_transform({kept}, lambda f: f.n || ' ' || f.u)))"
