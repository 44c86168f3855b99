"""Problem 8: encoding of a corpus with a public byte-level BPE vocabulary, in batched numpy merge rounds."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame

#: where the vocabulary lies; a parameter of every operator here
DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the published pattern by which this vocabulary's texts are parted into words.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
_SHIFT = np.int64(20)
_NONE = np.int64(2**62)
#: words whose ids a worker remembers
CACHE = 400_000


class Vocabulary:
    """Ids of the bytes, and sorted pair keys with the id, which is the rank, of what they merge to."""

    def __init__(self, path: str):
        ranks: dict[bytes, int] = {}
        with open(path, "rb") as f:
            for line in f:
                if line.strip():
                    token, rank = line.split()
                    ranks[base64.b64decode(token)] = int(rank)
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        keys, merged = [], []
        self.inside = np.zeros((256, 256), dtype=bool)
        for token, rank in ranks.items():
            if len(token) > 1:
                b = np.frombuffer(token, dtype=np.uint8)
                self.inside[b[:-1], b[1:]] = True
                for i in range(1, len(token)):
                    left, right = ranks.get(token[:i]), ranks.get(token[i:])
                    if left is not None and right is not None:
                        keys.append((left << int(_SHIFT)) | right)
                        merged.append(rank)
        order = np.argsort(keys)
        self.keys, self.merged = np.array(keys, dtype=np.int64)[order], np.array(merged, dtype=np.int64)[order]
        self.words: dict[str, list[int]] = {}
        self.split = regex.compile(PATTERN).findall

    def merge_rounds(self, parts: list[bytes]) -> list[list[int]]:
        """Ids of each non-empty part. Every round merges, in each part, all places of its lowest-rank pair; parts without a pair leave."""
        flat = np.frombuffer(b"".join(parts), dtype=np.uint8)
        size = np.array([len(p) for p in parts], dtype=np.int64)
        sym, own = self.byte[flat], np.repeat(np.arange(len(parts)), size)
        done_sym, done_own = [], []
        while len(sym):
            same = np.append(own[:-1] == own[1:], False)
            key = np.append((sym[:-1] << _SHIFT) | sym[1:], np.int64(-1))
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.where(same & (self.keys[at] == key), self.merged[at], _NONE)
            starts = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            low = np.minimum.reduceat(rank, starts)
            low = np.repeat(low, np.diff(np.append(starts, len(sym))))
            over = low == _NONE
            if over.any():
                done_sym.append(sym[over])
                done_own.append(own[over])
            hit = (rank == low) & ~over
            # in a run of places that overlap, every other one from the left
            if (hit[1:] & hit[:-1]).any():
                i = np.arange(len(hit))
                run = i - np.maximum.accumulate(np.where(hit, -1, i))
                hit &= run % 2 == 1
            sym = np.where(hit, low, sym)
            stay = ~over & ~np.append(False, hit[:-1])
            sym, own = sym[stay], own[stay]
        s, o = np.concatenate(done_sym), np.concatenate(done_own)
        s = s[np.argsort(o, kind="stable")]
        return [x.tolist() for x in np.split(s, np.cumsum(np.bincount(o, minlength=len(parts)))[:-1])]

    def parts(self, word: bytes) -> list[bytes]:
        """Where no token of the vocabulary holds two neighbouring bytes, no merge can cross: the word falls into parts there."""
        if len(word) < 4:
            return [word]
        b = np.frombuffer(word, dtype=np.uint8)
        cuts = np.flatnonzero(~self.inside[b[:-1], b[1:]]) + 1
        if not len(cuts):
            return [word]
        edges = [0, *cuts.tolist(), len(word)]
        return [word[i:j] for i, j in zip(edges[:-1], edges[1:], strict=True)]

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        """Ids of each text; null and empty texts have none."""
        if len(self.words) > CACHE:
            self.words.clear()
        split = [self.split(t) if t else [] for t in texts]
        fresh = {w for ws in split for w in ws} - self.words.keys()
        if fresh:
            known: dict[bytes, list[int]] = {}
            of = [(w, self.parts(w.encode("utf-8", "replace"))) for w in fresh]
            unique = list({p for _, ps in of for p in ps})
            for at in range(0, len(unique), 20_000):
                some = unique[at : at + 20_000]
                known.update(zip(some, self.merge_rounds(some), strict=True))
            for w, ps in of:
                self.words[w] = [i for p in ps for i in known[p]]
        words = self.words
        return [[i for w in ws for i in words[w]] for ws in split]


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encode_corpus(docs: DataFrame, vocabulary_path: str = DEFAULT_VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): token ids of every text, without special tokens, whose strings are ordinary text.

    One narrow pass, no shuffle. Null and empty texts have the empty list; every row gives one row, repeated ids and null
    ids too; very long words are parted where no merge can cross, so a round's work stays in proportion; an empty table
    gives no row; other columns are never read.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v = vocabulary(vocabulary_path)
        for pdf in batches:
            for at in range(0, len(pdf), 1000):
                part = pdf.iloc[at : at + 1000]
                yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "ids": v.encode(list(part["text"]))})

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.selectExpr(f"`{id_col}` as doc_id", f"`{text_col}` as text").mapInPandas(run, f"doc_id {kind}, ids array<int>")


def token_counts(docs: DataFrame, keep: list[str], vocabulary_path: str = DEFAULT_VOCABULARY, text_col: str = "text") -> DataFrame:
    """``keep`` columns and ``tokens``, the number of ids of the text (0 for null and empty texts)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v = vocabulary(vocabulary_path)
        for pdf in batches:
            counts = [len(x) for at in range(0, len(pdf), 1000) for x in v.encode(list(pdf["__text"].iloc[at : at + 1000]))]
            yield pdf.drop(columns="__text").assign(tokens=np.array(counts, dtype=np.int64))

    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.selectExpr(*[f"`{c}`" for c in keep], f"`{text_col}` as __text").mapInPandas(run, f"{fields}, tokens bigint")
