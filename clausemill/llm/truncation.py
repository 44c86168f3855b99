"""Problem 2: text cut off by field limits or in transfer."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, spread
from . import endmodel
from .blocks import facing
from .dart import mix
from .near import classes
from .textnorm import codes


@dataclass(frozen=True)
class Prefixes:
    """What a text that lost its end has in common with its copy is the copy's beginning, however much is lost.

    Every text is signed at prefixes of ``first`` shingles of n characters and on by ``ratio``: b bands of r min-hashes each. least:
    similarity, by edits, of a cut text to the beginning of its copy.
    """

    n: int = 5
    first: int = 24
    ratio: float = 1.5
    b: int = 4
    r: int = 3
    least: float = 0.8

    def lengths(self, shingles: int) -> list[int]:
        out, x = [], self.first
        while x <= shingles:
            out.append(x)
            x = int(np.ceil(x * self.ratio))
        return out


def prefix_bands(texts: list[str], how: Prefixes) -> list[np.ndarray]:
    """Per text (prefixes, b) band keys: min-hashes of every prefix come from one running minimum over the parts between their ends."""
    size = np.array([max(0, len(t) - how.n + 1) for t in texts], dtype=np.int64)
    marks = np.array(how.lengths(int(size.max(initial=0))), dtype=np.int64)
    count = np.searchsorted(marks, size, "right")
    out = [np.zeros((0, how.b), dtype=np.int64)] * len(texts)
    used = np.flatnonzero(count)
    if not len(used):
        return out
    a = codes("".join(texts[i] for i in used)).astype(np.uint64)
    m = len(a) - how.n + 1
    h = np.zeros(m, dtype=np.uint64)
    for j in range(how.n):
        h = mix((h + np.uint64(j + 1)) * np.uint64(0x9E3779B97F4A7C15) ^ a[j : m + j])
    count, long = count[used], np.array([len(texts[i]) for i in used], dtype=np.int64)
    # the parts of a text between the ends of its prefixes, and behind them one that is left out: what runs over into the next text
    n = count + 1
    first = np.cumsum(n) - n
    nth = np.arange(n.sum()) - np.repeat(first, n)
    starts = np.repeat(np.cumsum(long) - long, n) + np.concatenate([[0], marks])[nth]
    low = np.empty((how.b * how.r, len(starts)), dtype=np.uint64)
    for c, seed in enumerate(mix(np.arange(1, how.b * how.r + 1, dtype=np.uint64))):
        low[c] = np.minimum.reduceat(mix(h ^ seed), np.minimum(starts, m - 1))
    for k in range(1, int(count.max())):
        at = first[count > k] + k
        low[:, at] = np.minimum(low[:, at], low[:, at - 1])
    keep = nth < np.repeat(count, n)
    low = low[:, keep].reshape(how.b, how.r, -1)
    key = mix(marks.astype(np.uint64))[nth[keep]][:, None] + mix(np.arange(1, how.b + 1, dtype=np.uint64))[None, :]
    for c in range(how.r):
        key = mix(key ^ low[:, c].T) * np.uint64(0x9E3779B97F4A7C15)
    for i, part in zip(used.tolist(), np.split(key.view(np.int64), np.cumsum(count)[:-1]), strict=True):
        out[i] = part
    return out


def ends_at(short: str, long: str, least: float) -> int | None:
    """Where in ``long`` the best alignment of all of ``short`` with its beginning ends; None if they are less alike than ``least``.

    Edit distances to every beginning of ``long`` in a band around the length of ``short``, by bit-parallel columns.
    """
    m = len(short)
    if long.startswith(short):
        return m
    most = int((1 - least) * m + 1e-9)
    n = min(len(long), m + most)
    if n < m - most:
        return None
    same, to = 0, min(m, n)  # what both begin with costs no edits
    while same < to:
        half = (same + to + 1) // 2
        same, to = (half, to) if long.startswith(short[same:half], same) else (same, half - 1)
    short, long, m, n = short[same:], long[same:], m - same, n - same
    peq: dict[str, int] = {}
    for i, c in enumerate(short):
        peq[c] = peq.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, d = full, 0, m
    best, at = m, 0
    for j in range(n):
        eq = peq.get(long[j], 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | (~(xh | pv) & full), pv & xh
        d += bool(ph & top) - bool(mh & top)
        # the beginning of long is fixed: a row more costs one
        ph, mh = (ph << 1 | 1) & full, mh << 1 & full
        pv, mv = mh | (~(xv | ph) & full), ph & xv
        if d < best or (d == best and abs(j + 1 - m) < abs(at - m)):
            best, at = d, j + 1
    return at + same if best <= most else None


def ends_at_all(shorts: list[str], longs: list[str], least: float) -> list[int | None]:
    """``ends_at`` of each of ``shorts`` with the one of ``longs`` beside it: their columns stand side by side in one long number, a lane each with room for the carry."""
    lanes, own = len(shorts), {t: i for i, t in enumerate(dict.fromkeys(shorts))}
    m = np.array([len(t) for t in shorts], dtype=np.int32)
    most = ((1 - least) * m + 1e-9).astype(np.int32)
    n = np.minimum(np.array([len(t) for t in longs], dtype=np.int32), m + most)
    width, far = int(m.max()) // 8 + 1, int(n.max())
    known = codes("".join(own))
    alphabet = np.unique(known)
    size = np.array([len(t) for t in own])
    where = np.arange(len(known)) - np.repeat(np.cumsum(size) - size, size)
    table = np.zeros((len(own), len(alphabet) + 1, width), dtype=np.uint8)
    np.bitwise_or.at(table, (np.repeat(np.arange(len(own)), size), np.searchsorted(alphabet, known), where // 8), (1 << where % 8).astype(np.uint8))
    table = table.reshape(-1, width)
    chars = codes("".join(t[:far].ljust(far, "\0") for t in longs)).reshape(lanes, far)
    at = np.minimum(np.searchsorted(alphabet, chars), len(alphabet) - 1)
    at[(alphabet[at] != chars) | (np.arange(far) >= n[:, None])] = len(alphabet)
    rows = (at + (np.array([own[t] for t in shorts]) * (len(alphabet) + 1))[:, None]).T.copy()
    full = int.from_bytes(b"".join(((1 << k) - 1).to_bytes(width, "little") for k in m.tolist()), "little")
    one = int.from_bytes((b"\1" + b"\0" * (width - 1)) * lanes, "little")
    last, bit = np.arange(lanes) * width + (m - 1) // 8, ((m - 1) % 8).astype(np.uint8)

    def top(x: int) -> np.ndarray:
        return (np.frombuffer(x.to_bytes(width * lanes, "little"), dtype=np.uint8)[last] >> bit & 1).astype(np.int32)

    pv, mv, d = full, 0, m.copy()
    best, at = d.copy(), np.zeros(lanes, dtype=np.int32)
    for j in range(far):
        eq = int.from_bytes(table[rows[j]].tobytes(), "little")
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | (full & ~(xh | pv)), pv & xh
        d += top(ph) - top(mh)
        ph, mh = (ph << 1 | one) & full, mh << 1 & full
        pv, mv = mh | (full & ~(xv | ph)), ph & xv
        new = (j < n) & ((d < best) | ((d == best) & (np.abs(j + 1 - m) < np.abs(at - m))))
        best[new], at[new] = d[new], j + 1
    return [a if ok else None for a, ok in zip(at.tolist(), (best <= most).tolist(), strict=True)]


#: damage at the end of a text that is no part of it
_DAMAGE = "\ufffd… "


def cut_against(short: str, long: str, least: float) -> bool | None:
    """Does ``short`` end inside a clause of its copy ``long``? False: it ends where a sentence of it does; None: not comparable, or the copy has a mark there that tells nothing."""
    s = short.rstrip(_DAMAGE)
    m, most = len(s), int((1 - least) * len(s) + 1e-9)
    # what is aligned at the end must be the same there, and of what is before at least one piece: looked for first, as the alignment can only end in this window
    window = long[max(0, m - most - 12) : m + most + 2]
    if s[-2:] not in window or (m >= 8 and s[-5:-2] not in window and s[-8:-5] not in window):
        return None
    return _told(s, long, ends_at(s, long, least))


def _told(s: str, long: str, at: int | None) -> bool | None:
    """What ``long`` tells of ``s`` if the best alignment ends at ``at``."""
    if at is None or at >= len(long) or s[-2:] not in long[max(0, at - 4) : at + 2]:
        return None
    here, before = long[at], long[at - 1]
    if here in "。！？!?；;\n" or before in "。！？!?；;\n":
        return False
    return True if here.isalnum() and before.isalnum() else None


class _Places:
    """Where the runs of two and of three characters of many texts stand."""

    def __init__(self, texts: list[str]):
        a = codes("\0".join([*texts, ""])).astype(np.uint64)
        self.length = np.array([len(t) for t in texts], dtype=np.int64)
        first = np.cumsum(self.length + 1) - self.length - 1
        a[first + self.length] = 0x1FFFFF  # no character
        self.owner = np.repeat(np.arange(len(texts)), self.length + 1)
        self.at = np.arange(len(a)) - first[self.owner]
        self.runs = {}
        for n in (2, 3):
            v = np.zeros(max(0, len(a) - n + 1), dtype=np.uint64)
            for j in range(n):
                v = v << np.uint64(21) | a[j : len(v) + j]
            order = np.argsort(v, kind="stable")
            self.runs[n] = v[order], order

    def having(self, run: str, lo: int, hi: int) -> np.ndarray:
        """Which texts have ``run`` between ``lo`` and ``hi``?"""
        v, order = self.runs[len(run)]
        code = np.uint64(0)
        for c in run:
            code = code << np.uint64(21) | np.uint64(ord(c))
        i = order[np.searchsorted(v, code, "left") : np.searchsorted(v, code, "right")]
        at = self.at[i]
        out = np.zeros(len(self.length), dtype=bool)
        out[self.owner[i[(at >= lo) & (at + len(run) <= hi)]]] = True
        return out


def against_all(shorts: list[str], longs: list[str], least: float) -> list[bool | None]:
    """``cut_against`` of each of ``shorts`` with all of ``longs`` that are longer: True if one is, else False if one is, else None.

    What no pair can do without, the same last characters in the window, is looked up for all of ``longs`` at once.
    """
    longs = sorted(set(longs), key=len)
    places = _Places(longs) if len(shorts) * len(longs) > 256 else None
    said: list[bool | None] = [None] * len(shorts)
    open_: dict[int, list[int]] = {}
    ends = [t.rstrip(_DAMAGE) for t in shorts]
    for x, (short, s) in enumerate(zip(shorts, ends, strict=True)):
        m, most = len(s), int((1 - least) * len(s) + 1e-9)
        if places and m >= 8:
            lo, hi = max(0, m - most - 12), m + most + 2
            has = (places.having(s[-5:-2], lo, hi) | places.having(s[-8:-5], lo, hi)) & places.having(s[-2:], lo, hi)
            open_[x] = np.flatnonzero(has & (places.length > len(short))).tolist()
            continue
        for long in longs:
            if len(long) > len(short):
                got = cut_against(short, long, least)
                said[x] = said[x] if got is None else got
                if got:
                    break
    # a text is done once it is found cut, so few pairs of each come first
    step = 8
    while open_ := {x: ys for x, ys in open_.items() if ys and not said[x]}:
        pairs = [(x, y) for x, ys in open_.items() for y in ys[:step]]
        for i in range(0, len(pairs), 512):
            part = pairs[i : i + 512]
            if len(part) < 8:
                at = [ends_at(ends[x], longs[y], least) for x, y in part]
            else:
                at = ends_at_all([ends[x] for x, _ in part], [longs[y] for _, y in part], least)
            for (x, y), a in zip(part, at, strict=True):
                got = _told(ends[x], longs[y], a)
                said[x] = said[x] if got is None else got or bool(said[x])
        open_ = {x: ys[step:] for x, ys in open_.items()}
        step *= 4
    return said


def _by_copy(least: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rids, told = [], []
            for xr, xs, ys in zip(*(pdf[c] for c in ("x_rid", "x_norm", "y_norm")), strict=True):
                for rid, said in zip(xr, against_all(list(xs), list(ys), least), strict=True):
                    if said is not None:
                        rids.append(rid)
                        told.append(said)
            yield pd.DataFrame({"rid": np.array(rids, dtype=np.int64), "cut": np.array(told, dtype=bool)})

    return run


def _text(t: str | None) -> str:
    return (endmodel.unwrap(t)[0] if t else "").strip()


def _parts(pdf: pd.DataFrame, most: int = 50_000) -> Iterator[tuple[np.ndarray, list[str]]]:
    """rid and norm of a batch, about ``most`` characters at a time."""
    rids, texts, at = pdf["rid"].to_numpy(), pdf["norm"].tolist(), 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size + len(texts[to]) < most):
            size += len(texts[to])
            to += 1
        yield rids[at:to], texts[at:to]
        at = to


def _open(how: Prefixes):
    """(rid, norm) -> (rid, key, upto): keys of the longest prefix of each text that may have lost its end, and how many characters of a text can matter to those with that prefix."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for rids, texts in _parts(pdf.loc[[endmodel.by_form(t)[0] is not False for t in pdf["norm"]]]):
                bands = prefix_bands(texts, how)
                some = [i for i, b in enumerate(bands) if len(b)]
                if some:
                    ends = np.array([how.lengths(len(texts[i]))[len(bands[i]) - 1] for i in some])
                    longest = np.ceil(ends * how.ratio).astype(np.int64) + how.n - 2
                    upto = longest + ((1 - how.least) * longest + 1e-9).astype(np.int64) + 2
                    yield pd.DataFrame({"rid": np.repeat(rids[some], how.b), "key": np.concatenate([bands[i][-1] for i in some]), "upto": np.repeat(upto, how.b)})

    return run


#: bits of the table of wanted keys
_WANTED = 24


def _slot(keys: np.ndarray) -> np.ndarray:
    return (mix(keys.view(np.uint64)) >> np.uint64(64 - _WANTED)).astype(np.int64)


def _table(keys: DataFrame) -> np.ndarray:
    """Bits that are set for every key of ``keys`` and some others: of a fixed size (2 MB), whatever the number of keys."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            slot = np.unique(_slot(pdf["key"].to_numpy()))
            word, first = np.unique(slot >> 6, return_index=True)
            yield pd.DataFrame({"word": word, "bits": np.bitwise_or.reduceat(np.uint64(1) << (slot & 63).astype(np.uint64), first).view(np.int64) if len(word) else np.zeros(0, dtype=np.int64)})

    table = np.zeros(1 << (_WANTED - 6), dtype=np.int64)
    words = keys.select("key").mapInPandas(run, "word bigint, bits bigint").groupBy("word").agg(F.bit_or("bits").alias("bits"))
    chunk = words.groupBy((F.col("word") % 64).alias("c")).agg(F.collect_list("word").alias("w"), F.collect_list("bits").alias("b"))
    for r in chunk.toLocalIterator():
        table[np.array(r["w"], dtype=np.int64)] = np.array(r["b"], dtype=np.int64)
    return table.view(np.uint64)


def _wanted(how: Prefixes, table: np.ndarray):
    """(rid, norm) -> (rid, key): keys of all prefixes that ``table`` knows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for rids, texts in _parts(pdf):
                bands = prefix_bands(texts, how)
                keys = np.concatenate([b.ravel() for b in bands])
                slot = _slot(keys)
                known = (table[slot >> 6] >> (slot & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
                yield pd.DataFrame({"rid": np.repeat(rids, [b.size for b in bands])[known], "key": keys[known]})

    return run


def cut_by_copy(texts: DataFrame, how: Prefixes = Prefixes()) -> DataFrame:
    """(id, cut) of the texts (id bigint, text) that have a longer verified near copy to compare with.

    cut is true if some copy goes on inside a clause where the text ends, false if copies only tell that a sentence ends there. A
    text without a closing mark meets every text that has a prefix like it, whatever that lost or has more; pairs are
    compared in blocks, so a beginning that very many texts share is no single task's work, and none of them is left out. Of the
    longer texts only as many characters are sent on as can matter, each such beginning once.
    """
    one = classes(texts, _text).groupBy("id").agg(F.min("norm").alias("norm"))
    return _cut_classes(one, how)


def _cut_classes(forms: DataFrame, how: Prefixes = Prefixes()) -> DataFrame:
    """The same of (id, norm), each id once."""
    member = materialize(forms.select("id", "norm", F.xxhash64("norm").alias("rid")), "member")
    reps = materialize(spread(member.select("rid", "norm").distinct(), "rid"), "reps")
    cut = materialize(reps.mapInPandas(_open(how), "rid bigint, key bigint, upto bigint"), "open")
    # a prefix that no other text has finds nothing; of the rest only those of a cut text matter
    wanted = cut.groupBy("key").agg(F.min("upto").alias("upto"))
    whole = materialize(reps.mapInPandas(_wanted(how, _table(cut)), "rid bigint, key bigint").join(wanted, "key"), "whole")
    shared = materialize(whole.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "shared")
    left = cut.join(shared, "key", "left_semi").join(reps, "rid").select("key", "rid", "norm")
    right = whole.join(shared, "key", "left_semi").join(reps, "rid").select("key", F.substring("norm", F.lit(1), F.col("upto").cast("int")).alias("norm")).distinct()
    right = right.select("key", F.xxhash64("norm").alias("rid"), "norm")
    found = facing(left, right, "key", 1024).mapInPandas(_by_copy(how.least), "rid bigint, cut boolean").groupBy("rid").agg(F.bool_or("cut").alias("cut"))
    return materialize(found.join(member.select("id", "rid"), "rid").select("id", "cut"), "bycopy")


def _by_end(model: dict[int, np.ndarray]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.loc[endmodel.break_off(model, pdf["text"].tolist()), ["n"]]

    return run


def truncated(records: DataFrame, id_col: str = "id", text_col: str = "answer") -> DataFrame:
    """(id): records whose text breaks off inside a sentence or word.

    Records with a verified near copy that is longer (min-hash banding of prefixes over five-character shingles, then
    alignment) are cut if that goes on inside a clause where they end, and whole if a sentence ends there; all others are
    scored by the terminality of their last words (see ``endmodel``), so the finish flag isn't needed. Null ids, null
    and empty texts are no cases; texts of which several rows exist count once per id; an empty table gives no row; other
    columns are never read.
    """
    r = records.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    # a text that many rows have is judged once
    texts = materialize(r.groupBy("text").agg(F.count("*").alias("rows")).withColumn("n", F.xxhash64("text")), "texts")
    model = endmodel.fit(texts.select("text", "rows"))
    copied = _cut_classes(classes(texts.select(F.col("n").alias("id"), "text"), _text)).withColumnRenamed("id", "n")
    by_end = texts.select("n", "text").join(copied, "n", "left_anti").mapInPandas(_by_end(model), "n bigint")
    cut = by_end.union(copied.where("cut").select("n"))
    return r.select("id", F.xxhash64("text").alias("n")).join(cut, "n", "left_semi").select("id").distinct()


def truncation_rates(records: DataFrame, cut: DataFrame, source_col: str = "model") -> DataFrame:
    """(source, records, truncated, share): how often each source truncates; rows of one id count once, a null source is its own."""
    own = records.where("id is not null").groupBy("id").agg(F.min(source_col).alias("source"))
    j = own.join(cut.withColumn("cut", F.lit(1)), "id", "left")
    return j.groupBy("source").agg(F.count("*").alias("records"), F.count("cut").alias("truncated"), (F.count("cut") / F.count("*")).alias("share"))
