"""Problem 7: visually identical text with different characters, in one consistent form."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Letters that look the same as the Latin letter of the same place.
_SAME = (
    ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοϲϳ", "ABEZHIKMNOPTYXocj"),
    ("АВЕКМНОРСТХЅІЈԌԚԜУаеорсухѕіјһԁԛԝ", "ABEKMHOPCTXSIJGQWYaeopcyxsijhdqw"),
    ("‐‑⁃", "---"),
    ("ıɡɑ", "iga"),
)
# Radicals of the supplement block that look the same as a simplified character.
# Katakana that look the same as a Han character or hiragana.
_KANA = ("ロニカエタトハヘベペ", "口二力工夕卜八へべぺ")
_RADICALS = ("⺟⺠⻁⻄⻅⻆⻉⻋⻓⻔⻘⻙⻚⻛⻜⻝⻢⻣⻤⻥⻦⻧⻨⻩⻬⻮⻰⻳⻑⻗⻫⻭⻯⻱", "母民虎西见角贝车长门青韦页风飞食马骨鬼鱼鸟卤麦黄齐齿龙龟長雨斉歯竜亀")
_WIDE = re.compile("[！-～￠-￦｡-￮]")


def _fixed() -> dict[str, str]:
    """Character -> the one it is written as. Only the look counts: superscripts, fractions, ligatures and other compatibility forms stay."""
    t = {a: b for x, y in (*_SAME, _KANA, _RADICALS) for a, b in zip(x, y, strict=True)}
    for c in range(0x2F00, 0x2FD6):  # radicals as characters
        t[chr(c)] = unicodedata.normalize("NFKC", chr(c))
    for c in (*range(0xFF01, 0xFF5F), *range(0xFF61, 0xFFBF), *range(0xFFE0, 0xFFE7)):  # full and half width
        n = unicodedata.normalize("NFKC", chr(c))
        t[chr(c)] = t.get(n, n)
    return t


TABLE = _fixed()
# the full-width form of a character is what the half-width one stands for, so that both ways of writing meet
_SPACE = re.compile(r"\s")


def ignorable(c: str) -> bool:
    """Takes no place: format characters, variation selectors, fillers, soft hyphens. Marks that are seen are not among them."""
    return unicodedata.category(c) == "Cf" or "︀" <= c <= "️" or "\U000e0100" <= c <= "\U000e01ef" or c in "͏ᅟᅠㅤﾠ឴឵" or (unicodedata.category(c) == "Cc" and not c.isspace())


def look(c: str) -> str:
    """What one character of decomposed text looks like; nothing for an ignorable one."""
    if ignorable(c):
        return ""
    if c.isspace():
        return " "
    return TABLE.get(c, c)


def by_table(text: str) -> str:
    """Canonical form by the table alone."""
    if text.isascii():
        return _SPACE.sub(" ", "".join(map(look, text)) if re.search(r"[\x00-\x08\x0e-\x1f\x7f]", text) else text)
    return unicodedata.normalize("NFC", seen(text))


def seen(text: str) -> str:
    """What a text looks like, character for character and mark for mark."""
    # a folded character may decompose again (half-width katakana marks, radicals)
    return unicodedata.normalize("NFD", "".join(map(look, unicodedata.normalize("NFD", text))))


class Trie:
    """Vocabulary of words by what their characters look like, walked by a weighted edit automaton.

    Edges bear looks, so look-alikes read the same edge and ignorables none: both cost 0. Of words of one look the first
    is the spelling.
    """

    def __init__(self, words: list[str]):
        self.root: dict = {}
        for w in words:
            node = self.root
            for c in seen(w):
                node = node.setdefault(c, {})
            node.setdefault("", w)

    def find(self, token: str, budget: int = 0) -> tuple[str, float] | None:
        """Nearest word within ``budget``; look-alikes and ignorables cost 0, any other substitution, insertion or deletion 1."""
        states: dict[int, tuple[dict, int]] = {id(self.root): (self.root, 0)}

        def put(to: dict, node: dict, cost: int) -> None:
            if cost <= budget and to.get(id(node), (node, budget + 1))[1] > cost:
                to[id(node)] = (node, cost)
                for c, child in node.items() if cost < budget else ():
                    if c:
                        put(to, child, cost + 1)

        if budget:
            states = {}
            put(states, self.root, 0)
        for c in seen(token):
            nxt: dict[int, tuple[dict, int]] = {}
            for node, cost in states.values():
                if c in node:
                    put(nxt, node[c], cost)
                if cost < budget:
                    put(nxt, node, cost + 1)
                    for k, child in node.items():
                        if k and k != c:
                            put(nxt, child, cost + 1)
            if not nxt:
                return None
            states = nxt
        ends = [(n[""], cost) for n, cost in states.values() if "" in n]
        return min(ends, key=lambda x: (x[1], x[0])) if ends else None


_MARKS = "\u0300-\u036f\u1ab0-\u1aff\u20d0-\u20ff"
_LETTER = "A-Za-z\u00c0-\u02af\u0370-\u03ff\u0400-\u052f\u1e00-\u1fff\uff21-\uff3a\uff41-\uff5a"
_KATAKANA = "\u30a1-\u30fa\u30fc\uff66-\uff9f"
#: words of alphabets with their marks, and runs of katakana with the Han characters that stand for some of them
_WORD = re.compile(f"[{_LETTER}][{_LETTER}{_MARKS}]*|[{_KATAKANA}{_KANA[1]}][{_KATAKANA}{_KANA[1]}\u3099\u309a]*")
_REAL_KANA = re.compile(f"(?![{_KANA[0]}])[{_KATAKANA}]")


def _bare(text: str) -> str:
    """Decomposed, without what takes no place: so a word's look never depends on what is hidden in it."""
    d = unicodedata.normalize("NFD", text)
    return d if d.isascii() and d.isprintable() else "".join(c for c in d if not ignorable(c))


def words(text: str) -> list[str]:
    return _WORD.findall(_bare(text))


def canonical(text: str | None, trie: Trie, memory: dict[str, str] | None = None) -> str | None:
    """One form for all texts of one look: a word that the trie's automaton reads gets the spelling of the vocabulary, all else goes by the table. Null stays null.

    The automaton reads a word only at cost 0, so it and its spelling look the same; as the trie has one spelling per
    look, words of one look get one form, and a word by table can't meet another look's spelling.
    """
    if text is None:
        return None
    memory = {} if memory is None else memory
    t = _bare(text)
    out, at = [], 0
    for m in _WORD.finditer(t):
        w = m.group(0)
        got = memory.get(w)
        if got is None:
            hit = trie.find(w)
            if len(memory) > 200_000:
                memory.clear()
            got = memory[w] = unicodedata.normalize("NFC", hit[0]) if hit else by_table(w)
        out += [by_table(t[at : m.start()]), got]
        at = m.end()
    out.append(by_table(t[at:]))
    return "".join(out).strip()


def clean(word: str) -> bool:
    """Fit to be a vocabulary spelling: of one alphabet, not in a form of another width; of katakana, one that has more than the characters of another script's look."""
    if _WIDE.search(word):
        return False
    kinds = {unicodedata.name(c, "?").split()[0] for c in word if not unicodedata.combining(c)} - {"KATAKANA-HIRAGANA"}
    return kinds == {"KATAKANA"} and bool(_REAL_KANA.search(word)) or len(kinds) == 1 and kinds <= {"LATIN", "GREEK", "CYRILLIC"}


def vocabulary(texts: DataFrame, most: int = 20_000, least: int = 3) -> list[str]:
    """Clean words seen ``least`` times or more, of those of one look the most frequent one, in all at most the ``most`` frequent: a vocabulary of bounded size. Words beyond it go by the table, all of one look alike."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            w = pd.Series([w for t in pdf["text"] if t for w in words(t) if len(w) > 1], dtype=object).value_counts()
            w = w[[clean(x) for x in w.index]]
            yield pd.DataFrame({"word": [unicodedata.normalize("NFC", x) for x in w.index], "seen": [seen(x) for x in w.index], "n": w.to_numpy().astype(int)}).astype({"word": object, "seen": object})

    counts = texts.select("text").mapInPandas(run, "word string, seen string, n bigint").groupBy("seen", "word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    # of equal counts the smaller spelling
    best = counts.groupBy("seen").agg(F.max("n").alias("n"), F.min(F.struct(-F.col("n"), "word"))["word"].alias("word"))
    return [r["word"] for r in best.orderBy(F.desc("n"), "word").limit(most).toLocalIterator()]


def canonical_values(values: DataFrame, most: int = 20_000) -> DataFrame:
    """(id, field_name, text) -> the same with ``form``: null texts stay, with a null form."""
    trie_words = vocabulary(values.where("text is not null"), most)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trie, memory = Trie(trie_words), {}
        for pdf in batches:
            yield pdf.assign(form=[canonical(t, trie, memory) for t in pdf["text"]])

    return values.select("id", "field_name", "text").mapInPandas(run, "id string, field_name string, text string, form string")


def fields(golden: DataFrame) -> DataFrame:
    """(id, field_name, text): the quote and the entries of must_include, one row each; null arrays and entries give none."""
    g = golden.where("id is not null")
    quote = g.select("id", F.lit("evidence_quote").alias("field_name"), F.col("evidence_quote").alias("text"))
    entries = g.select("id", F.lit("must_include").alias("field_name"), F.explode("must_include").alias("text"))
    return quote.union(entries).where("text is not null")


def same_look_pairs(forms: DataFrame) -> DataFrame:
    """(field_name, id_a, id_b): different ids, id_a < id_b, with texts of one form that differ in a character.

    Copies of a text are folded before the join, and a form with one spelling gives nothing. Blank texts (an empty form)
    are no cases; repeated rows and entries count once.
    """
    f = forms.where("form is not null and form <> ''").select("field_name", "form", "text", "id").distinct()
    spelled = f.groupBy("field_name", "form").agg(F.min("text").alias("lo"), F.max("text").alias("hi")).where("lo <> hi").select("field_name", "form")
    f = f.join(spelled, ["field_name", "form"], "left_semi")
    x, y = (f.select("field_name", "form", F.col("text").alias(f"t{s}"), F.col("id").alias(f"id_{s}")) for s in "ab")
    return x.join(y, ["field_name", "form"]).where("id_a < id_b and ta <> tb").select("field_name", "id_a", "id_b").distinct()
