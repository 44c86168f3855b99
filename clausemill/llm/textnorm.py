"""Plain form of short texts for comparing: width folded, white space and punctuation dropped."""

from __future__ import annotations

import re
import unicodedata

import numpy as np

_DROP = re.compile(r"[\W_]+")


def plain(text: str | None) -> str:
    """Letters and digits in compatibility form; case and accents stay. Null gives the empty text."""
    return _DROP.sub("", unicodedata.normalize("NFKC", text)) if text else ""


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def grams(texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and value (the packed code points for n <= 3, else a hash) of each distinct n-gram; texts under n characters give their whole as one."""
    from .dart import mix

    rows, values = [], []
    for i, t in enumerate(texts):
        if not t:
            continue
        a = codes(t).astype(np.uint64)
        m = min(n, len(a))
        v = np.zeros(len(a) - m + 1, dtype=np.uint64)
        for k in range(m):
            part = a[k : len(a) - m + 1 + k]
            v = (v << np.uint64(21)) | part if n <= 3 else mix((v + np.uint64(k + 1)) * np.uint64(0x9E3779B97F4A7C15) ^ part)
        v = np.unique(v)
        rows.append(np.full(len(v), i, dtype=np.int64))
        values.append(v)
    if not rows:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    return np.concatenate(rows), np.concatenate(values)
