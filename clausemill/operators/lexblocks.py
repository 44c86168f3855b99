"""BM25 of a query set against a corpus in blocks: nothing is written per pair of a query and a text.

The corpus is kept as blocks of postings, the queries as blocks of weighted terms; each two of them meet in one task by a cross
join of the block tables, which has no shuffle. What leaves a task are its own best rows per query, or counts.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..session import materialize

#: texts of a block, queries of a block, queries whose terms are laid out at once, queries scored at once
TEXTS, QUERIES, AT_ONCE, ROWS = 2048, 4096, 1024, 128
#: rows a task keeps before it sends them on
HELD = 4_000_000

_WORD = re.compile("[a-z0-9]+")
_HAN, _WIDE = 0x4E00, 0x9FFF - 0x4E00 + 1
_STATE = "qid bigint, id bigint, score double, grp string"


def _terms(texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Text number and code of each token of lower-case texts, and the words behind the codes from ``_WIDE ** 2`` on: the tokens of ``functions.text.tokens``."""
    a = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64) - _HAN
    of = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts])[: len(a)]
    han = (a >= 0) & (a < _WIDE)
    at = np.flatnonzero(han[:-1] & han[1:])
    known: dict[str, int] = {}
    rows, codes = [], []
    for i, t in enumerate(texts):
        for w in _WORD.findall(t):
            rows.append(i)
            codes.append(known.setdefault(w, _WIDE * _WIDE + len(known)))
    return np.concatenate([of[at], np.array(rows, dtype=np.int64)]), np.concatenate([a[at] * _WIDE + a[at + 1], np.array(codes, dtype=np.int64)]), list(known)


def _code(term: str, words: dict[str, int]) -> int:
    if len(term) == 2 and term[0] > "z":
        return (ord(term[0]) - _HAN) * _WIDE + ord(term[1]) - _HAN
    return words.get(term, -1)


def _spelled(code: int, words: list[str]) -> str:
    return words[code - _WIDE * _WIDE] if code >= _WIDE * _WIDE else chr(code // _WIDE + _HAN) + chr(code % _WIDE + _HAN)


def _postings(texts: list[str]) -> dict:
    """codes (sorted) with the texts at[codes i : i + 1] that hold them, tf, and the token count dl of each text."""
    rows, codes, words = _terms(texts)
    key, tf = np.unique(codes * len(texts) + rows, return_counts=True)
    code, first = np.unique(key // len(texts), return_index=True)
    return {"codes": code, "at": np.append(first, len(key)), "docs": (key % len(texts)).astype(np.uint16), "tf": tf.astype(np.min_scalar_type(tf.max(initial=0))), "dl": np.bincount(rows, minlength=len(texts)), "words": words}


def index(docs: DataFrame, group: str | None = None) -> DataFrame:
    """(postings, n, len): blocks of the texts of ``docs`` (id bigint, text, and ``group``, the column that scopes or quotas go by), written once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lo in range(0, len(pdf), TEXTS):
                part = pdf.iloc[lo : lo + TEXTS]
                p = _postings(part["low"].tolist()) | {"ids": part["id"].to_numpy(), "grp": part["grp"].to_numpy(dtype=object)}
                yield pd.DataFrame({"postings": [pickle.dumps(p)], "n": [len(part)], "len": [int(p["dl"].sum())]})

    grp = (F.col(group) if group else F.lit(None)).cast("string")
    one = docs.select(F.col("id").cast("bigint").alias("id"), F.lower(F.coalesce("text", F.lit(""))).alias("low"), grp.alias("grp"))
    return materialize(one.mapInPandas(run, "postings binary, n bigint, len bigint"), "index")


def stats(blocks: DataFrame) -> DataFrame:
    """One row: n_docs, avgdl."""
    return blocks.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_docs"), (F.sum("len").cast("double") / F.sum("n")).alias("avgdl"))


def frequencies(blocks: DataFrame) -> DataFrame:
    """(term, df)"""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for b in pdf["postings"]:
                p = pickle.loads(b)
                yield pd.DataFrame({"term": [_spelled(int(c), p["words"]) for c in p["codes"]], "df": np.diff(p["at"]).astype(np.int64)})

    return blocks.select("postings").mapInPandas(run, "term string, df bigint").groupBy("term").agg(F.sum("df").alias("df"))


def weighted(queries: DataFrame, weights: DataFrame, idf: Column) -> DataFrame:
    """(qid, grp, terms, ws) of the queries (qid, text, and grp if they have one): known terms in order, with their count in the query times idf."""
    own = [c for c in ("grp",) if c in queries.columns]
    q = queries.select("qid", *own, F.explode(tokens(F.col("text"))).alias("term")).groupBy("qid", *own, "term").agg(F.count("*").alias("qtf"))
    q = q.join(weights.select("term", idf.alias("idf")), "term").withColumn("w", F.col("qtf") * F.col("idf"))
    one = q.groupBy("qid", *own).agg(F.array_sort(F.collect_list(F.struct("term", "w"))).alias("t"))
    return materialize(one.select("qid", (F.col("grp") if own else F.lit(None)).cast("string").alias("grp"), F.col("t.term").alias("terms"), F.col("t.w").alias("ws")), "weighted")


def _blocks(queries: DataFrame, stats_: DataFrame, candidates: bool = False) -> DataFrame:
    """(b, queries): pickled blocks of about QUERIES queries by hash, with the mean length of the texts."""
    n = max(1, -(-queries.count() // QUERIES))
    own = ["qid", "grp", "terms", "ws", *["c_ids", "c_scores"] * candidates]
    rows = queries.withColumn("b", F.pmod(F.xxhash64("qid", F.lit(3)), F.lit(n))).groupBy("b").agg(F.collect_list(F.struct(*own)).alias("r"))
    flat = rows.select("b", F.col("r.qid").alias("qid"), F.col("r.grp").alias("grp"), *[F.flatten(f"r.{c}").alias(c) for c in own[2:]], *[F.transform(f"r.{c}", F.size).alias(f"n_{c}") for c in own[2:]])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                vocabulary, term = np.unique(np.array(r["terms"], dtype=object).astype(str), return_inverse=True)
                d = {"qid": np.array(r["qid"]), "grp": np.array(r["grp"], dtype=object), "vocabulary": vocabulary.tolist(), "term": term.astype(np.int32), "w": np.array(r["ws"]), "at": np.cumsum([0, *r["n_ws"]]), "avgdl": r["avgdl"]}
                if candidates:
                    d |= {"c_ids": np.array(r["c_ids"]), "c_scores": np.array(r["c_scores"]), "c_at": np.cumsum([0, *r["n_c_ids"]])}
                out.append(pickle.dumps(d))
            yield pd.DataFrame({"b": pdf["b"], "queries": out})

    return materialize(flat.crossJoin(stats_.select("avgdl")).mapInPandas(run, "b bigint, queries binary"), "queries").coalesce(1)  # one row of statistics


def _norm(tf: np.ndarray, dl: np.ndarray, avgdl: float, k1: float, b: float) -> np.ndarray:
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))


def _scored(doc: dict, q: dict, digits: int, k1: float, b: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(numbers of queries, their scores of all texts of the block, -inf where they have no word in common), ROWS queries at a time."""
    words = {w: _WIDE * _WIDE + i for i, w in enumerate(doc["words"])}
    codes = np.array([_code(t, words) for t in q["vocabulary"]], dtype=np.int64)
    place = np.minimum(np.searchsorted(doc["codes"], codes), max(0, len(doc["codes"]) - 1))
    there = doc["codes"][place] == codes if len(doc["codes"]) else np.zeros(len(codes), dtype=bool)
    numbers = np.arange(len(q["qid"]))
    n = len(doc["ids"])
    for lo in range(0, len(numbers), AT_ONCE):
        some = numbers[lo : lo + AT_ONCE]
        used = np.unique(np.concatenate([q["term"][q["at"][i] : q["at"][i + 1]] for i in some]))
        rows: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for t in used[there[used]].tolist():
            f, to = doc["at"][place[t]], doc["at"][place[t] + 1]
            held = doc["docs"][f:to].astype(np.intp)
            rows[t] = held, _norm(doc["tf"][f:to].astype(float), doc["dl"][held], q["avgdl"], k1, b)
        for at in range(0, len(some), ROWS):
            part = some[at : at + ROWS]
            s, hit = np.zeros((len(part), n)), np.zeros((len(part), n), dtype=bool)
            for j, i in enumerate(part.tolist()):
                own = slice(q["at"][i], q["at"][i + 1])
                mine = [(*rows[x], w) for x, w in zip(q["term"][own].tolist(), q["w"][own].tolist(), strict=True) if x in rows]
                if not mine:
                    continue
                held, values, ws = zip(*mine, strict=True)
                texts = np.concatenate(held)
                # term after term, in the order of the query: a text's score doesn't depend on the block that it stands in
                s[j] = np.bincount(texts, np.concatenate(values) * np.repeat(ws, [len(x) for x in held]), n)
                if min(ws) > 0:
                    np.greater(s[j], 0, out=hit[j])
                else:  # with weights of 0 and below it a word in common need not show in the sum
                    hit[j, texts] = True
            s = np.round(s, digits)
            s[~hit] = -np.inf
            yield part, s


def _best(q: np.ndarray, g: np.ndarray | None, ids: np.ndarray, s: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best rows of each query (and group), ties to the smaller id."""
    order = np.lexsort((ids, -s, q) if g is None else (ids, -s, g, q))
    a = q[order]
    new = np.ones(len(a), dtype=bool)
    new[1:] = (a[1:] != a[:-1]) if g is None else (a[1:] != a[:-1]) | (g[order][1:] != g[order][:-1])
    start = np.flatnonzero(new)
    nth = np.arange(len(a)) - np.repeat(start, np.diff(np.append(start, len(a))))
    return order[nth < k]


def _queries_of(cache: dict, b: int, payload: bytes) -> dict:
    if b not in cache:
        if len(cache) >= 16:
            cache.clear()
        cache[b] = pickle.loads(payload)
    return cache[b]


def _met(blocks: DataFrame, q: DataFrame) -> DataFrame:
    return blocks.select("postings").crossJoin(q)


def best(blocks: DataFrame, queries: DataFrame, stats_: DataFrame, k: int, scoped: bool = False, per_group: bool = False, digits: int = 6, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(qid, id, score, grp): a superset of the k best texts of each query, cut to the best k of each task.

    ``scoped``: only texts whose group is the query's; ``per_group``: the k best of each group of a query.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache: dict[int, dict] = {}
        state: dict[int, list] = {}
        floor: dict[int, np.ndarray] = {}
        qids: dict[int, np.ndarray] = {}

        def rows(of: int) -> pd.DataFrame:
            qi, ids, s, g = state[of]
            return pd.DataFrame({"qid": qids[of][qi], "id": ids, "score": s, "grp": g})

        last, doc = None, {}
        for pdf in batches:
            for payload, nb, qs in zip(pdf["postings"], pdf["b"], pdf["queries"], strict=True):
                if payload != last:
                    last, doc = payload, pickle.loads(payload)
                    names, group = _grouped(doc["grp"])
                q = _queries_of(cache, nb, qs)
                least = floor.setdefault(nb, np.full(len(q["qid"]), -np.inf))
                qids[nb] = q["qid"]
                got = []
                for part, s in _scored(doc, q, digits, k1, b):
                    if scoped:
                        own = np.array([names.get(x, -2) for x in q["grp"][part]])
                        s[own[:, None] != group[None, :]] = -np.inf
                    if per_group:
                        keep = s > -np.inf
                        for g in np.unique(group):
                            at = np.flatnonzero(group == g)
                            if len(at) > k:
                                own = s[:, at]
                                keep[:, at] &= own >= np.partition(own, len(at) - k, axis=1)[:, len(at) - k, None]
                    else:
                        keep = (s >= least[part, None]) & (s > -np.inf)
                        many = np.flatnonzero(keep.sum(axis=1) > 4 * k)
                        if len(many) and s.shape[1] > k:
                            keep[many] &= s[many] >= np.partition(s[many], s.shape[1] - k, axis=1)[:, s.shape[1] - k, None]
                    r, c = np.nonzero(keep)
                    got.append((part[r], doc["ids"][c], s[r, c], c))
                if not got:
                    continue
                qi, ids, s, c = (np.concatenate(x) for x in zip(*got, strict=True))
                top = _best(qi, group[c] if per_group else None, ids, s, k)
                new = [qi[top], ids[top], s[top], doc["grp"][c[top]]]
                old = state.get(nb)
                if old is not None:
                    new = [np.concatenate(x) for x in zip(old, new, strict=True)]
                    if not per_group:
                        top = _best(new[0], None, new[1], new[2], k)
                        new = [x[top] for x in new]
                state[nb] = new
                if not per_group:
                    n = np.bincount(new[0], minlength=len(least))
                    low = np.full(len(least), np.inf)
                    np.minimum.at(low, new[0], new[2])
                    least[n >= k] = np.maximum(least, low)[n >= k]
                if sum(len(x[0]) for x in state.values()) > HELD:
                    for of in state:
                        yield rows(of)
                    state.clear()
        for of in state:
            yield rows(of)

    return _met(blocks, _blocks(queries, stats_)).mapInPandas(run, _STATE)


def _grouped(grp: np.ndarray) -> tuple[dict, np.ndarray]:
    """Number of each group of a block, and of each text; texts without one are -1."""
    names = {x: i for i, x in enumerate(dict.fromkeys(x for x in grp if x is not None))}
    return names, np.array([names.get(x, -1) for x in grp])


def ranks(blocks: DataFrame, queries: DataFrame, stats_: DataFrame, candidates: DataFrame, digits: int = 6, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(qid, id, rank) of the candidates (qid, id, score) among all texts that have a word of the query: those with a better score, or the same and a smaller id, are counted."""
    c = candidates.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("id", "score"))).alias("c"))
    q = queries.join(c, "qid").select("qid", "grp", "terms", "ws", F.col("c.id").alias("c_ids"), F.col("c.score").alias("c_scores"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache: dict[int, dict] = {}
        state: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        last, doc = None, {}
        for pdf in batches:
            for payload, nb, qs in zip(pdf["postings"], pdf["b"], pdf["queries"], strict=True):
                if payload != last:
                    last, doc = payload, pickle.loads(payload)
                q = _queries_of(cache, nb, qs)
                if nb not in state:
                    state[nb] = (np.repeat(q["qid"], np.diff(q["c_at"])), q["c_ids"], np.zeros(len(q["c_ids"]), dtype=np.int64))
                better, ids = state[nb][2], doc["ids"]
                for part, s in _scored(doc, q, digits, k1, b):
                    for i, own in zip(part.tolist(), s, strict=True):
                        f, to = q["c_at"][i], q["c_at"][i + 1]
                        ordered, cs = np.sort(own), q["c_scores"][f:to]
                        lo, hi = np.searchsorted(ordered, cs, "left"), np.searchsorted(ordered, cs, "right")
                        better[f:to] += len(own) - hi
                        for j in np.flatnonzero(hi > lo).tolist():
                            better[f + j] += np.count_nonzero(ids[own == cs[j]] < q["c_ids"][f + j])
                if sum(len(x[2]) for x in state.values()) > HELD:
                    for x in state.values():
                        yield pd.DataFrame(dict(zip(("qid", "id", "better"), x, strict=True)))
                    state.clear()
        for x in state.values():
            yield pd.DataFrame(dict(zip(("qid", "id", "better"), x, strict=True)))

    counted = _met(blocks, _blocks(q, stats_, True)).mapInPandas(run, "qid bigint, id bigint, better bigint")
    return counted.groupBy("qid", "id").agg((F.sum("better") + 1).cast("int").alias("rank"))


def pair_contributions(pairs: DataFrame, docs: DataFrame, queries: DataFrame, stats_: DataFrame, digits: int = 6, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(qid, id, term, contribution, score): of the few pairs (qid, id) given, score as the blocks give it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for qid, id_, low, terms, ws, avgdl in zip(*(pdf[c] for c in ("qid", "id", "low", "terms", "ws", "avgdl")), strict=True):
                p = _postings([low])
                words = {w: _WIDE * _WIDE + i for i, w in enumerate(p["words"])}
                tf = dict(zip(p["codes"].tolist(), p["tf"].tolist(), strict=True))
                acc, own = np.zeros(1), []
                for t, w in zip(terms, ws, strict=True):
                    if n := tf.get(_code(t, words)):
                        x = _norm(np.array([float(n)]), p["dl"], avgdl, k1, b) * w
                        acc += x
                        own.append((qid, id_, t, float(x[0])))
                out += [(*x, float(np.round(acc, digits)[0])) for x in own]
            yield pd.DataFrame(out, columns=["qid", "id", "term", "contribution", "score"])

    d = docs.select("id", F.lower(F.coalesce("text", F.lit(""))).alias("low"))
    j = pairs.select("qid", "id").distinct().join(d, "id").join(queries.select("qid", "terms", "ws"), "qid").crossJoin(stats_.select("avgdl"))  # one row of statistics
    return j.mapInPandas(run, "qid bigint, id bigint, term string, contribution double, score double")
