"""Problem 1: broken prompt and response pairs, each with its one defect."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import endmodel, refusal
from .language import LANGS, other_language

DEFECTS = ("empty", "copied", "refusal", "other_language", "truncated")
_CITE = re.compile(r"\s*\[C\d+\]")
_LABEL = re.compile(r"^\s*(?:答复?|回答|回复|问题?|您?的?问题是|您的问题是|您问的是|关于|Q|A|Question|Answer|You asked)\s*(?:[：:]\s*|(?=[“\"]))", re.I)
_NOTHING = {"", "null", "none", "na", "nan", "nil", "无", "空", "暂无", "没有", "undefined", "empty", "略", "待补充", "答", "answer"}
#: so many letters and digits are more than any label with a word for nothing has
_MUCH = re.compile(r"(?:[\W_]*[^\W_]){48}")


class _Plain(dict):
    """Character -> its letters and digits in compatibility form, without case and marks; worked out once."""

    def __missing__(self, c: int) -> str:
        self[c] = "".join(x for x in unicodedata.normalize("NFKD", chr(c)).casefold() if x.isalnum())
        return self[c]


_PLAIN = _Plain()


def _plain(text: str) -> str:
    return text.translate(_PLAIN)


def says_nothing(text: str | None) -> bool:
    """Null, blank, or only marks, labels, citations and words for nothing."""
    if text is None:
        return True
    t = _CITE.sub("", endmodel.unwrap(text)[0])
    return not _MUCH.match(t) and _plain(_LABEL.sub("", t, count=1)) in _NOTHING


def copies(question: str | None, answer: str) -> bool:
    """Gives back the question, once or more, with at most a label around it."""
    q = _plain(question or "")
    if len(q) < 4:
        return False
    t = _CITE.sub("", endmodel.unwrap(answer)[0])
    a = _plain(t)
    if not a:
        return False
    if q in a:
        return len(a.replace(q, "")) <= 6
    if not 0.8 <= len(a) / len(q) <= 1.3:
        return False
    x, y = ({s[i : i + 2] for i in range(len(s) - 1)} for s in (q, _plain(_LABEL.sub("", t, count=1))))
    return len(x & y) >= 0.7 * len(x | y)


def _reply(answer: str) -> str:
    """What an answer says: unwrapped, without citations and label."""
    return _LABEL.sub("", _CITE.sub("", endmodel.unwrap(answer)[0]), count=1)


def _find(model: dict[int, np.ndarray], refusals: np.ndarray):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids, qs, answers = pdf["id"].tolist(), pdf["question"].tolist(), pdf["answer"].tolist()
            kinds = ["empty" if says_nothing(a) else "copied" if copies(q, a) else None for q, a in zip(qs, answers, strict=True)]
            # the rest is judged for the whole batch at once, one question after the other
            rest = [i for i, k in enumerate(kinds) if k is None]
            replies = [_reply(answers[i]) for i in rest]
            told = {
                "refusal": refusal.declining(refusals, replies),
                "other_language": other_language([qs[i] or "" for i in rest], replies),
                "truncated": endmodel.break_off(model, [answers[i] for i in rest]),
            }
            for n, i in enumerate(rest):
                kinds[i] = next((k for k, is_ in told.items() if is_[n]), None)
            yield pd.DataFrame([(i, k) for i, k in zip(ids, kinds, strict=True) if k], columns=["id", "defect"], dtype=object)

    return run


def broken_pairs(pairs: DataFrame, id_col: str = "id", question_col: str = "question", answer_col: str = "answer", refused_col: str = "refused") -> DataFrame:
    """(id, defect): one row per id whose answer is no usable reply to its question.

    Two passes over the texts, neither of which shuffles them: one counts sentence ends (see ``endmodel``), one
    judges each pair: ``empty``, ``copied``, ``refusal`` by phrases and a score fitted on a bounded sample of the refusal flags
    (see ``refusal``; without such a column on general sentences alone), then the languages by the naive Bayes posteriors
    of both sides, then ``truncated`` by end-of-text likelihood. Only the defective ids are shuffled, to count each once.
    Null answers are ``empty``; a null or very short question has no language and nothing to copy; rows with a null id
    are no cases; repeated rows count once; an empty table gives no row. Other columns are never read.
    """
    p = pairs.select(F.col(id_col).cast("string").alias("id"), F.col(question_col).alias("question"), F.col(answer_col).alias("answer")).where("id is not null")
    model = endmodel.fit(p.select(F.col("answer").alias("text")))
    flags = pairs.select(F.col(id_col).cast("string").alias("id"), F.col(answer_col).alias("answer"), F.col(refused_col).alias("refused")) if refused_col in pairs.columns else None
    refusals = refusal.fit(flags) if flags is not None else refusal.train([], [])
    found = p.mapInPandas(_find(model, refusals), "id string, defect string")
    return found.groupBy("id").agg(F.min("defect").alias("defect"))


__all__ = ["DEFECTS", "LANGS", "broken_pairs", "copies", "says_nothing"]
