"""Where may a text end? A character n-gram model of sentence ends.

The model holds, for hashed contexts of 8, 5, 3, 2 and 1 characters, how often the context occurs in the
corpus and how often a sentence, citation group or value ends right after it. Its tables have a fixed size
(``ORDERS``), so merging and broadcasting them is bounded whatever the corpus holds. What a cell holds of other contexts
is about the median cell of its table; that much is taken off, and a context that isn't well above it counts as unknown,
so in a corpus of more varied text more endings are left to shorter contexts, whose tables stay exact.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: context length -> bits of its table
ORDERS = {8: 20, 5: 19, 3: 17, 2: 16, 1: 13}
CHUNK = 1 << 13
_PAD, _EOS, _OPEN = "\x02", "\x03", "\x04"
_ENDS = np.array(sorted(map(ord, "。！？!?；[\"\x03")), dtype=np.uint32)
_NUM = re.compile(r"\d+(?:\.\d+)*")
_DOT = re.compile(r"\.(?=\s|\"|\\n|$)")
_GAP = re.compile(r"\s+\[")
_CITE_TAIL = re.compile(r"(?:\s*\[C\d+\])+\s*$")
_OPEN_CITE = re.compile(r"\[(?:C\d*)?$")
_WRAP = re.compile(r"^\s*(?:```(?:json)?\s*)?\{[\s.…]*\"answer\"\s*:\s*(?:\"|null)", re.I)
_WRAP_END = re.compile(r"(?<!\\)\"\s*(?:,\s*\"|\}\s*(?:```)?\s*$|,?\s*$)")
_CUT_MARK = re.compile(r"(?:�+|\\u[0-9a-fA-F]{0,3}|\\u[0-9a-fA-F]{4}|(?:…|\.\.\.)*[\[［【(（](?:截断|未完|truncated|cut)[\]］】)）]?|\s*<(?:eof|eos|end|cut|trunc\w*)>?)$", re.I)
_NUMBER_DOT = re.compile(r"(?:第|[Cc]lause |[Ss]ection |[Ii]tem |[Aa]rticle )\d+(?:\.\d+)*\.$")
# Words that no sentence closes with.
_LEADS_ON = re.compile(r"(?:以及|包括|但是|不过|因为|由于|如果|若是|并且|而且|或者|其中|例如|比如|根据|按照|依照|关于|对于|至于|除了|\b(?:the|an?|of|and|or|to|for|with|from|by|if|because|including|such as|but|that|which|whose))$", re.I)
_CLOSERS = "”’」』）)】》\"'*"


def unwrap(text: str) -> tuple[str, bool]:
    """The answer inside unparsed model output, and whether the value was closed. Other texts come back as they are."""
    m = _WRAP.match(text)
    if not m:
        return text, True
    if m.group(0).lower().endswith("null"):
        return "", True
    rest = text[m.end() :]
    end = _WRAP_END.search(rest)
    return (rest[: end.start()], True) if end else (rest, False)


def shape(text: str) -> str:
    """Numbers become one digit, full stops one mark, blanks before a citation go."""
    return _GAP.sub("[", _DOT.sub("。", _NUM.sub("0", text)))


def _known_whole(shaped: str) -> bool:
    return len(shaped) < max(ORDERS)


def _hash(a: np.ndarray, n: int, bits: int) -> np.ndarray:
    """Hash of the n characters that end at each position from n-1 on."""
    h = np.zeros(len(a) - n + 1, dtype=np.uint64)
    for k in range(n):
        h = (h ^ a[k : len(a) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def _codes(texts: list[str]) -> np.ndarray:
    pad = _PAD * max(ORDERS)
    return np.frombuffer((pad + (_EOS + pad).join(texts) + _EOS).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    tables = {n: np.zeros((2, 1 << b), dtype=np.int64) for n, b in ORDERS.items()}
    some = False
    for pdf in batches:
        # the end of a text is what is in question and counts neither way, but where the context reaches back to its start and so knows all of it
        some_text = [bool(t) for t in pdf["text"]]
        texts = [u if _known_whole(u) else u + _OPEN for u in (shape(unwrap(t)[0]) for t in pdf["text"] if t)]
        rows = pdf["rows"].to_numpy()[some_text] if "rows" in pdf else None
        for at in range(0, len(texts), 4000):
            a = _codes(texts[at : at + 4000])
            some = True
            times = None
            if rows is not None and rows[at : at + 4000].max() > 1:  # each character, and the mark behind its text, as often as the text
                times = np.repeat(rows[at : at + 4000], [len(t) + 1 + max(ORDERS) for t in texts[at : at + 4000]]).astype(np.float64)
            for n, bits in ORDERS.items():
                h = _hash(a[:-1], n, bits)
                here, after = a[n - 1 : -1], a[n:]
                real = (here > 4) & (after != 4)
                ends = real & np.isin(after, _ENDS)
                weight = (None, None) if times is None else (times[n - 1 : -1][real], times[n - 1 : -1][ends])
                tables[n][0] += np.bincount(h[real], weight[0], 1 << bits).astype(np.int64)
                tables[n][1] += np.bincount(h[ends], weight[1], 1 << bits).astype(np.int64)
    if not some:
        return
    for n, t in tables.items():
        for c in range(0, t.shape[1], CHUNK):
            part = t[:, c : c + CHUNK]
            if part.any():
                yield pd.DataFrame({"n": [n], "chunk": [c // CHUNK], "counts": [part.astype("<i8").tobytes()]})


def _merge(key: tuple, pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total = None
    for pdf in pdfs:
        for b in pdf["counts"]:
            x = np.frombuffer(b, dtype="<i8")
            total = x.astype(np.int64) if total is None else total + x
    yield pd.DataFrame({"n": [key[0]], "chunk": [key[1]], "counts": [total.astype("<i8").tobytes()]})


def fit(texts: DataFrame) -> dict[int, np.ndarray]:
    """Count all values of the column ``text``, each as often as ``rows`` says if there is that column. Each task sends its tables in chunks that are added up by chunk.

    Only the fixed-size tables (28 MB) reach the driver; the load of table n, its median cell, is put under -n. Nulls and empty texts are skipped; an empty frame gives
    tables of zeros.
    """
    parts = texts.select("text", *["rows"] * ("rows" in texts.columns)).mapInPandas(_count, "n int, chunk int, counts binary")
    merged = parts.groupBy("n", "chunk").applyInPandas(_merge, "n int, chunk int, counts binary")
    model = {n: np.zeros((2, 1 << b), dtype=np.int64) for n, b in ORDERS.items()}
    for r in merged.toLocalIterator():
        model[r["n"]][:, r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] = np.frombuffer(bytes(r["counts"]), dtype="<i8").reshape(2, -1)
    small = {n: np.minimum(t, 2**31 - 1).astype(np.int32) for n, t in model.items()}
    return small | {-n: np.median(t, axis=1) for n, t in small.items() if n > 2}


def end_shares(model: dict[int, np.ndarray], texts: list[str], own: list[int], least: int = 3) -> np.ndarray:
    """Share of ends after the last characters of each text, by the longest context that the corpus knows; NaN where it knows none. own: 1 for a text that the longest context holds whole: its own end is left out, and no shorter context is asked, as it would be one inside a sentence."""
    out = np.full(len(texts), np.nan)
    if not texts:
        return out
    widest = max(ORDERS)
    tails = [shape(t[-64:])[-widest:].rjust(widest, _PAD) for t in texts]
    a = np.frombuffer("".join(tails).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).reshape(len(texts), widest).astype(np.uint64)
    less = np.array(own, dtype=np.float64)
    for n, bits in ORDERS.items():
        h = np.zeros(len(texts), dtype=np.uint64)
        for k in range(widest - n, widest):
            h = (h ^ a[:, k]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(32)
        h = ((h * np.uint64(0xC4CEB9FE1A85EC53)) >> np.uint64(64 - bits)).astype(np.int64)
        load = model.get(-n, np.zeros(2))
        total, ends = model[n][0, h] - less - load[0], model[n][1, h] - less - load[1]
        use = np.isnan(out) & ((less == 0) | (n == widest)) & (total >= least + 4 * load[0])
        out[use] = np.maximum(ends[use], 0) / total[use]
    return out


def by_form(text: str | None) -> tuple[bool | None, str, int]:
    """(breaks off, body, own): what the form of a text's end tells of whether it breaks off; None where only the model can, and then the text to ask it about with the number of its own ends."""
    if text is None:
        return False, "", 0
    t, closed = unwrap(text)
    t = t.rstrip().rstrip("\u200b\ufeff \u3000").rstrip()
    if t.endswith("```"):
        t = t[:-3].rstrip()
    if not t:
        return False, "", 0
    if _CUT_MARK.search(t) or _OPEN_CITE.search(t):
        return True, "", 0
    body = _CITE_TAIL.sub("", t)
    bare = body.rstrip(_CLOSERS + " ")
    if not bare:
        return False, "", 0
    last = bare[-1]
    if last in "。！？!?":
        return False, "", 0
    if last == ".":
        return bool(_NUMBER_DOT.search(bare)), "", 0
    if last in "，、：；,:;（(“‘「《—" or _LEADS_ON.search(bare):
        return True, "", 0
    if body.count("“") > body.count("”") or body.count("（") > body.count("）"):
        return True, "", 0
    return None, bare, int(bare == t and _known_whole(shape(t)))


def break_off(model: dict[int, np.ndarray], texts: list[str | None], threshold: float = 0.35) -> np.ndarray:
    """Which texts end inside a sentence or word?

    Null, empty and blank texts don't. A mark of transfer damage at the end does; a closed sentence doesn't; the rest is
    decided, for the whole batch at once, by the share of ends after the last characters. An ending of which even the
    last character is unknown is left undecided, as whole.
    """
    told = [by_form(t) for t in texts]
    out = np.array([bool(x) for x, _, _ in told], dtype=bool)
    ask = [i for i, (x, _, _) in enumerate(told) if x is None]
    shares = end_shares(model, [told[i][1] for i in ask], [told[i][2] for i in ask])
    out[ask] = shares < threshold
    return out


def breaks_off(model: dict[int, np.ndarray], text: str | None, threshold: float = 0.35) -> bool:
    """``break_off`` of one text."""
    return bool(break_off(model, [text], threshold)[0])
