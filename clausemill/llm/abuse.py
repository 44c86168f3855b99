"""Problem 10: abusive, hateful or sexually explicit content, however it is spelled."""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lookalike import ignorable, look

# Base terms by kind, those that are abuse by themselves and those that are only where someone is meant by
# them. Written as in condensed text (no blanks or marks, lower case); ~ lets two characters be replaced by sound.
STRONG = {
    "abuse": "傻逼~ 傻13 傻叉 大傻叉 脑残 猪脑子 狗脑子 狗东西 贱人 贱货 贱骨头 婊 屄 王八蛋 王八羔子 混蛋 混账东西 人渣 蠢货 蠢猪 蠢驴 死骗子 滚犊子 滚蛋 滚远点 滚出去 滚开 给我滚 滚你妈 不要脸的 臭不要脸 狗嘴 狗屁 操你妈~ 操你大爷 操你全家 操你祖宗 操他妈~ 操死你 日你妈 干你娘 你妈死了 你妈逼~ 妈逼 去你妈的~ 他妈的 他娘的 他奶奶的 尼玛 草泥马 草你马 曹尼玛 狗娘养的 狗日的 狗杂种 狗腿子 龟孙子 龟儿子 小杂种 猪狗不如 禽兽不如 没脑子 没带脑子 没长脑子 脑子进水 脑子被驴踢 老不死的 丧尽天良 放你娘的屁 臭垃圾 死废物 你个辣鸡 辣鸡东西 去吃屎 吃屎吧 不是人养的 算什么东西 恶心透了 死肥猪 臭流氓 丑八怪 瞎了你的狗眼 狗眼",
    "threat": "打断你的腿 打断狗腿 砍死你 弄死你 打死你 整死你 捅死你 揍死你 揍扁你 杀了你 杀你全家 死全家 全家死光 全家死绝 去死吧 赶紧去死 怎么不去死 快去死 不得好死 等着挨揍 要你狗命 要你的命 断子绝孙 出门被车撞 被车撞死 早点投胎 赶紧投胎 下地狱吧 浪费空气 扒了你的皮 泼你硫酸 废了你 放你的血 让你见血",
    "hate": "不配当人 不配做人 不配活着 的命不值钱 就该绝后 全关起来 通通关起来 劣等货 劣等民族 劣等人种 低等民族 低等人 贱民 滚回老家 滚回你们 支那猪 黑鬼 死瘸子 死残废 死聋子 都该死光 都该枪毙 种族清洗 该被灭绝 外地狗 乡巴佬",
    "sexual": "约炮 裸聊 裸照 艳照 叫床 口交 肛交 群交 乳交 做爱 内射 颜射 啪啪啪 一夜情 援交 卖淫 奶子 巨乳 爆乳 大奶子 骚货 骚逼~ 骚女 淫荡 淫娃 淫水 荡妇 色情直播 色情视频 色情网 成人视频 成人电影 黄色视频 黄片 女优 轮奸 迷奸 强奸你 乱伦 自慰 鸡巴 鸡八 几把大 脱光了 扒光 骑在我身上 包你射 射得爽 射在她 上床吗 小姐上门 包夜 性奴 无码高潮 操逼~ 操得爽 舔我的 摸她的胸 揉她的胸",
}
WEAK = {
    "abuse": "白痴 弱智 智障 杂种 废物 垃圾 辣鸡 畜生 饭桶 骗子 闭嘴 恶心 变态 神经病 蠢 贱 脑子 无耻 狗",
    "threat": "挨揍 揍你 绝症 投胎 碰见你 等着瞧 弄死 砍死 捅死 活着 去死 该死 打断",
    "hate": "害虫 蛀虫 蛆虫 绝后 人种 死光 死绝 赶出去 关起来 劣等 低贱 天生就是 见一个打一个 灭绝 寄生虫",
    "sexual": "无码 高潮 偷拍 强奸 色情 性交 射精 内裤 嫖 揉 胸 裸 屁股 射 爽 上门",
}
#: English words and phrases (without blanks, for letters that were spaced out)
STRONG_EN = {
    "abuse": "fuck fucking fucked fucker fuckers shit shitty bastard bastards motherfucker bitch bitches bullshit asshole assholes dickhead dumbass jackass cunt wanker twat moron moronic faggot nigger imbecile shithead douchebag sb nmsl cnm wcnm cnmd tmd mlgb pieceofshit sonofabitch shutthefuckup stupidbitch fuckyou gofuckyourself fuckoff",
    "threat": "kys killyourself hopeyoudie iwillkillyou willkillyou killyouall burninhell dieinafire smashyourface breakyourlegs beatyouup slityourthroat goandhang",
    "hate": "subhuman subhumans untermensch arevermin areparasites aresubhuman gastheverymin",
    "sexual": "blowjob handjob porn porno pornhub cumshot deepthroat gangbang whore whores slut sluts horny nudes sendnudes suckmycock suckmydick wanttofuck fucktonight",
}
WEAK_EN = {
    "abuse": "idiot idiots idiotic stupid scum trash retard retarded brainless worthless pathetic ugly uglyface crap filthy loser",
    "threat": "die kill smash hang rot",
    "hate": "vermin parasites parasite wipedout cripples inferior getridofthem exterminate",
    "sexual": "cock dick pussy tits naked nude sexy ass sucked suck sex boobs",
}
# Harmless words that hold a term; what lies in one of them is no term.
HARMLESS = "医疗废物 废物处理 废物处置 废物回收 垃圾短信 垃圾邮件 垃圾分类 垃圾桶 垃圾箱 垃圾车 路口交 出口交 入口交 窗口交 接口交 港口交 渡口交 关口交 口交通 口交叉 口交汇 口交接 口交易 口交费 做爱心 做爱国 做爱好 叫床位 叫床单 牲畜生 家畜生 畜生产 畜生长 牛奶子 羊奶子 奶子鱼 奶子菜 混蛋白 白痴呆 除去死 人渣滓 热狗 狗咬 狗粮 狗绳 遛狗 导盲犬 人种痘 人种植 注射 放射 辐射 射频 反射 照射 射线 折射 胸部 胸外 胸腔 胸痛 胸闷 胸片 开胸 胸椎 胸透 心胸 胸科 屁股针 上门收 上门核 上门取 揉捏 爽约 凉爽 爽口 裸眼 裸露 贵贱 贱卖 愚蠢病 去死角 去死皮 大连 海狗 狗尾草"
# First and last of the characters of one sound, in the order of the national standard character set.
SOUNDS = {
    "sha": "莎煞", "bi": "逼陛", "cao": "操草", "ni": "妮溺", "ma": "妈吗", "si": "斯巳", "gun": "辊棍", "jian": "歼建", "ren": "壬纫", "zha": "扎诈", "gou": "钩够", "za": "匝杂", "zhong": "中众",
    "zi": "兹字", "chun": "春蠢", "huo": "豁祸", "nao": "挠淖", "can": "餐灿", "zhu": "珠驻", "bai": "白拜", "chi": "吃炽", "fei": "菲费", "wu": "巫误", "la": "垃啦", "ji": "击纪", "wang": "汪妄", "ba": "芭爸",
    "dan": "耽蛋", "hun": "荤混", "qu": "趋去", "nai": "氖奈", "pao": "抛泡", "yue": "曰阅", "ai": "埃隘", "zuo": "昨座", "chuang": "疮创", "jiao": "蕉窖", "luo": "萝络", "she": "奢设", "sao": "搔嫂",
    "qiang": "枪抢", "yin": "茵印", "dang": "当档", "se": "瑟涩", "kou": "抠寇", "qun": "裙群", "chu": "初处", "sheng": "声圣", "ta": "塌踏", "de": "德的", "biao": "标表", "pian": "篇骗", "gui": "瑰贵", "sun": "孙笋",
    "niang": "娘酿", "du": "都渡", "tui": "推退", "pi": "坯譬", "zui": "嘴罪", "tou": "偷透",
}
# Further characters that stand for one by sound or shape.
AS = {"艹": "操", "肏": "操", "槽": "操", "儍": "傻", "屄": "逼", "婊": "表", "妳": "你", "祂": "他", "她": "他", "圾": "击", "4": "死"}
# What shows that someone is meant, and that words are reported or forbidden, not used.
_MEANT = re.compile("你|妳|尼玛|他们|她们|这[帮群种些]|那[帮群种些]|回帖的|客服是|都是|个个|全是|就该|们[都就该]|活该|死全|东西|玩意|家伙|全家|凭什么|赔钱|下面的|她|女|妹|视频|私信|全程|(?:you|your|youre|they|theyare|these|those|this|all|shouldbe|his|her|my|girls|gofor|hot)")
_CITES = re.compile("禁止|不得|不要使用|请勿|严禁|屏蔽词|敏感词|举报|侮辱性|不文明|原话|骂道|曾骂|所谓|该词|一词|条例|投诉称|forbidden|prohibited|theword|quote|mustnot|neversay")
_QUOTED = re.compile("[“\"「『《][^“”\"「」『』《》]{1,24}[”\"」』》]")
_SEP = re.compile(r"(?<=[a-z])[_*·.\-~|'’•]+(?=[a-z])")
_TOKEN = re.compile("[a-z0-9]+")
#: characters before and behind a term that its context is read from
WINDOW = 14
_DIGITS = str.maketrans("013457@$", "oieastas")
# Words of one's own that are an edit away from a listed one.
_PLAIN = set("shut shot ship shift suit skit spit slit shirt shin bustard bastarda regard reward retards retardant petard wander walker wankel waker britches birches botches batches vermis verein pron cnut assole whose where bitten pitch hitch witch ditch batch botch butch birch bith stud slot slit slum honey horn hornby shore whorl mormon modes nodes dudes rudest funk buck duck luck tuck puck fucus cult cunning cunts kyst tards moran moroni".split())


@dataclass(frozen=True)
class Term:
    kind: str
    strong: bool
    edits: int  # Levenshtein edits that are allowed
    budget: float  # cost of replacements by sound or shape that is allowed


#: cost of a character of the same sound or shape
BY_SOUND = 0.4


@lru_cache(1)
def terms() -> dict[str, Term]:
    """Terms of running text. Allowed by length: two characters are exact, three may have one replaced by sound, four two; from five (Latin: eight) on also one edit."""
    out = {}
    for strong, by in ((True, STRONG), (False, WEAK)):
        for kind, ws in by.items():
            for w in ws.split():
                t = w.rstrip("~")
                n = len(t)
                out[t] = Term(kind, strong, int(n >= 5), 0.8 if w != t or n >= 4 else 0.4 if n == 3 else 0.0)
    for strong, by in ((True, STRONG_EN), (False, WEAK_EN)):
        for kind, ws in by.items():
            out |= {w: Term(kind, strong, int(len(w) >= 9), 0.0) for w in ws.split() if len(w) >= 8}
    return out


@lru_cache(1)
def _words() -> dict[str, Term]:
    """English words that count as whole tokens."""
    return {w: Term(kind, strong, 0, 0.0) for strong, by in ((True, STRONG_EN), (False, WEAK_EN)) for kind, ws in by.items() for w in ws.split()}


@lru_cache(1)
def _sound() -> tuple[dict[int, str], dict[str, str]]:
    """Character -> the first character of its sound, and syllable -> that character; from the order of the character set."""
    order = [bytes([a, b]).decode("gb2312") for a in range(0xB0, 0xD7) for b in range(0xA1, 0xFF)]
    order += [bytes([0xD7, b]).decode("gb2312") for b in range(0xA1, 0xFA)]
    place = {c: i for i, c in enumerate(order)}
    key = {ord(c): first for first, last in SOUNDS.values() for c in order[place[first] : place[last] + 1]}
    key |= {ord(a): key.get(ord(b), b) for a, b in AS.items()}
    return key, {s: v[0] for s, v in SOUNDS.items()}


def sounds(text: str) -> str:
    """The text with each character as the first of its sound; as long as the text."""
    return text.translate(_sound()[0])


class LexiconTrie:
    """Trie of the lexicon intersected with Levenshtein automata: the band of the edit table is the automaton's state."""

    def __init__(self, words: dict[str, int], backwards: bool = False):
        self.root: dict = {}
        for w, k in words.items():
            node = self.root
            for c in reversed(w) if backwards else w:
                node = node.setdefault(c, {})
            node[""] = (w, max(k, node[""][1] if "" in node else 0))
        self.longest = max(map(len, words))

    def find(self, text: str, start: int, exact: int = 0) -> list[tuple[str, int, int]]:
        """(term, end, edits): terms that read from ``start`` with at most one edit: substitution, insertion, deletion or swap of neighbours.

        The first ``exact`` characters are known to stand as they are written, so the walk begins below them. A state
        is (characters read, edits); once the edit is spent only the text's own next character is followed.
        """
        s = text[start : start + self.longest + 1]
        node, out = self.root, []
        for c in s[:exact]:
            node = node.get(c)
            if node is None:
                return out
        row = {j: abs(j - exact) for j in range(max(0, exact - 1), min(len(s), exact + 1) + 1)}
        before = {j: abs(j - exact + 1) for j in range(max(0, exact - 2), exact + 1)} if exact else {}
        todo = [(node, exact, row, before, s[exact - 1] if exact else "")]
        while todo:
            node, depth, row, before, last = todo.pop()
            if 0 not in row.values() and 0 not in before.values():
                for j in row:
                    n, i = node, j
                    while n is not None:
                        if "" in n and n[""][1]:
                            out.append((n[""][0], start + i, 1))
                        n = n.get(s[i]) if i < len(s) else None
                        i += 1
                continue
            if "" in node:
                w, k = node[""]
                end = min(row, key=lambda j: (row[j], abs(j - depth)))
                if row[end] <= k:
                    out.append((w, start + end, row[end]))
            for c, child in node.items():
                if c:
                    new: dict[int, int] = {}
                    for j in range(max(0, depth), min(len(s), depth + 2) + 1):
                        v = row.get(j, 2) + 1
                        if j:
                            v = min(v, new.get(j - 1, 2) + 1, row.get(j - 1, 2) + (s[j - 1] != c))
                            if j > 1 and before and s[j - 1] == last and s[j - 2] == c:
                                v = min(v, before.get(j - 2, 2) + 1)
                        if v <= 1:
                            new[j] = v
                    if new:
                        todo.append((child, depth + 1, new, row, c))
        return out


@lru_cache(1)
def _matcher() -> tuple[ahocorasick.Automaton, LexiconTrie, LexiconTrie, dict[str, list[str]], ahocorasick.Automaton]:
    """Finds where a term may stand, by sound: terms without an edit whole; of the others one half must be there, and the trie is walked from that half on, forwards or backwards."""
    pieces: dict[str, set[tuple[str, str]]] = {}
    by_key: dict[str, list[str]] = {}
    edits: dict[str, int] = {}
    for w, t in terms().items():
        key = sounds(w)
        by_key.setdefault(key, []).append(w)
        edits[key] = max(t.edits, edits.get(key, 0))
        pieces.setdefault(key, set()).add(("", key))
        if t.edits:
            cut = len(key) // 2
            turn = key[: cut - 1] + key[cut] + key[cut - 1] + key[cut + 1 :]  # a swap at the cut leaves neither half
            if turn != key:
                pieces.setdefault(turn, set()).add(("swap", key))
            pieces.setdefault(key[:cut], set()).add(("head", key))
            pieces.setdefault(key[cut:], set()).add(("tail", key))
    a, h = ahocorasick.Automaton(), ahocorasick.Automaton()
    for p, v in pieces.items():
        a.add_word(p, (len(p), sorted(v)))
    a.make_automaton()
    for w in HARMLESS.split():
        h.add_word(w, len(w))
    h.make_automaton()
    return a, LexiconTrie(edits), LexiconTrie(edits, True), by_key, h


@lru_cache(1)
def _word_trie() -> LexiconTrie:
    return LexiconTrie({w: 1 for w in _words() if len(w) >= 4 and w.isalpha() and w not in ("nmsl", "mlgb", "wcnm", "cnmd")})


@lru_cache(1 << 16)
def misspelt(token: str) -> str | None:
    """The listed word that a whole token is one edit away from, first letter kept; words under six letters allow a doubled letter, swapped neighbours and a digit for a letter only."""
    if len(token) < 4 or not token[0].isalpha() or token in _PLAIN:
        return None
    for w in sorted({w for w, end, edits in _word_trie().find(token, 0) if edits and end == len(token)}):
        if w[0] != token[0] or not _words()[w].strong:
            continue
        doubled = len(token) == len(w) + 1 and any(token[i] == token[i + 1] and token[:i] + token[i + 1 :] == w for i in range(len(w)))
        swapped = len(token) == len(w) and sorted(token) == sorted(w)
        if len(w) >= 6 or doubled or swapped or token.translate(_DIGITS) == w:
            return w
    return None


class _Fold(dict):
    """Character -> its plain form, worked out once per character."""

    def __missing__(self, c: int) -> str:
        d = unicodedata.normalize("NFKC", chr(c)).lower()
        self[c] = d if "一" <= d <= "鿿" else "".join("" if ignorable(x) else look(x) for x in d).lower()
        return self[c]


class _Letters(dict):
    """Letters and digits stay, all else goes."""

    def __missing__(self, c: int) -> str:
        self[c] = chr(c) if chr(c).isalnum() else ""
        return self[c]


_FOLD, _LETTERS = _Fold(), _Letters()
_SYLLABLE = re.compile(f"(?<![a-z])({'|'.join(sorted(SOUNDS, key=len, reverse=True))})(?![a-z])|(?<=[傻煞沙莎])[bx](?![a-z])|(?<![a-z])shabi(?![a-z])")
_HAN = re.compile("[一-鿿]")


def folded(text: str) -> str:
    """Width and look-alikes folded, ignorables dropped, lower case."""
    return text.translate(_FOLD)


def _spoken(m: re.Match) -> str:
    """A syllable in Latin letters as a character of its sound, where it stands beside a Han character."""
    t, s = m.string, m.group(0)
    if s == "shabi":
        return "傻笔"
    if s in "bx":
        return "笔"
    around = t[max(0, m.start() - 1) : m.start()] + t[m.end() : m.end() + 1]
    return _sound()[1][s] if _HAN.search(around) else s


def condensed(fold: str) -> str:
    """Letters and digits alone; Latin syllables between Han characters as a character of their sound."""
    return _SYLLABLE.sub(_spoken, fold.translate(_LETTERS))


@dataclass(frozen=True)
class Finding:
    kind: str
    term: str
    strong: bool
    cost: float
    meant: bool
    cited: bool
    start: int


def findings(text: str | None) -> list[Finding]:
    """Terms of the lexicon that a text holds, misspelt ones included, each with its context."""
    if not text:
        return []
    automaton, trie, backwards, by_key, harmless = _matcher()
    fold = folded(text)
    s = condensed(fold)
    keys = sounds(s)
    hits: list[tuple[float, int, int, str]] = []
    turned = ""
    seen: set[tuple[int, int, str]] = set()

    def add(start: int, end: int, key: str, edits: int) -> None:
        if (start, end, key) in seen:
            return
        seen.add((start, end, key))
        got = s[start:end]
        for w in by_key[key]:
            t = terms()[w]
            if edits > t.edits:
                continue
            if edits:
                if len(set(w) & set(got)) < len(set(w)) - 2 or len(set(key) & set(keys[start:end])) < len(set(key)) - 1:
                    continue
                hits.append((1.0, start, end, w))
            else:
                cost = BY_SOUND * sum(x != y for x, y in zip(w, got, strict=True))
                if cost <= t.budget + 1e-9:
                    hits.append((cost, start, end, w))

    for end, (n, uses) in automaton.iter(keys):
        start = end - n + 1
        for side, key in uses:
            if side == "head":
                for k, stop, edits in trie.find(keys, start, n):
                    if edits:
                        add(start, stop, k, edits)
            elif side == "tail":
                turned = turned or keys[::-1]
                for k, stop, edits in backwards.find(turned, len(keys) - 1 - end, n):
                    if edits:
                        add(len(keys) - stop, end + 1, k, edits)
            else:
                add(start, end + 1, key, int(side == "swap"))
    spans = [(end - n + 1, end + 1) for end, n in harmless.iter(s)] if hits else []
    best: list[tuple[float, int, int, str, Term]] = []
    # a place tells once: strong before weak, cheaper, longer first
    for cost, a, b, w in sorted(hits, key=lambda h: (not terms()[h[3]].strong, h[0], h[1] - h[2], h[1], h[3])):
        if any(x <= a and b <= y or (x < b and a < y and len(w) <= 2) for x, y in spans) or any(a < y and x < b for _, x, y, _, _ in best):
            continue
        best.append((cost, a, b, w, terms()[w]))
    for m in _TOKEN.finditer(_SEP.sub("", fold)):
        w, cost = m.group(0), 0.0
        if w not in _words():
            w, cost = misspelt(w), 1.0
        if w and not any(w in x[3] or x[3] in w for x in best):
            at = s.find(m.group(0))
            best.append((cost, at, at + len(m.group(0)), w, _words()[w]))
    if not best:
        return []
    quoted = [condensed(q.group(0)) for q in _QUOTED.finditer(fold)]
    out = []
    for cost, a, b, w, t in best:
        window = s[max(0, a - WINDOW) : b + WINDOW]
        cited = bool(_CITES.search(s[max(0, a - 2 * WINDOW) : b + WINDOW])) and any(s[a:b] in q for q in quoted)
        out.append(Finding(t.kind, w, t.strong, cost, bool(_MEANT.search(window)), cited, a))
    return out


#: what the score of a term is made of
FEATURES = ("strong", "weak", "cost", "meant", "company", "cited")
#: weights before any label is seen
PRIOR = np.array([2.4, -2.2, -0.9, 1.5, 1.9, -6.0])
#: how sure these are: standard deviation of each weight
SPREAD = np.array([0.5, 0.5, 0.3, 0.5, 0.4, 0.8])
#: labelled documents that the weights are fitted on, at most
LABELLED = 5000


def features(found: list[Finding]) -> np.ndarray:
    """One row per term: its strength, cost, context, and how much else is near it."""
    rows = []
    for f in found:
        near = [g for g in found if g is not f and abs(g.start - f.start) <= 3 * WINDOW and not g.cited]
        company = min(2.0, sum(1.0 if g.strong else 0.75 for g in near))
        rows.append((float(f.strong), float(not f.strong), f.cost, float(f.meant), company, float(f.cited)))
    return np.array(rows).reshape(-1, len(FEATURES))


def fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights most likely after the labels: logistic regression around PRIOR, by Newton's method. No labels leave PRIOR."""
    w = PRIOR.copy()
    precision = np.diag(1 / SPREAD**2)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (y - p) - precision @ (w - PRIOR)
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + precision, gradient)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return w


def score(text: str | None, weights: np.ndarray = PRIOR) -> tuple[float, str | None]:
    """Score in [0, 1) of the worst term in its context, and its kind. Null, empty and blank texts score 0."""
    found = findings(text)
    if not found:
        return 0.0, None
    z = features(found) @ weights
    k = int(z.argmax())
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, float(z[k]))))), found[k].kind


def context_weights(docs: DataFrame, labels: DataFrame | None, most: int = LABELLED) -> np.ndarray:
    """Context weights fitted on rated documents (labels: doc_id, unsafe), each by its worst term.

    At most ``most`` of them, those of the smallest hash, are read and reach the driver, as six numbers each; a document
    of contradicting ratings counts with each. No labels, or none with a term, leave the prior weights.
    """
    if labels is None:
        return PRIOR
    sample = labels.where("doc_id is not null and unsafe is not null").select("doc_id", "unsafe").orderBy(F.xxhash64("doc_id"), "doc_id", "unsafe").limit(most)
    rated = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # ``most`` rows

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for text, y in zip(pdf["text"], pdf["unsafe"], strict=True):
                x = features(findings(text))
                if len(x):
                    rows.append((*x[(x @ PRIOR).argmax()], float(y > 0)))
            yield pd.DataFrame(rows, columns=[*FEATURES, "unsafe"], dtype=float)

    got = rated.mapInPandas(run, ", ".join(f"{c} double" for c in (*FEATURES, "unsafe"))).collect()
    if not got:
        return PRIOR
    # the same rows in any order give the same weights
    x = np.array(sorted(map(tuple, got)))
    return np.round(fit(x[:, :-1], x[:, -1]), 9)


def scored(docs: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(doc_id, source, score, category): every row of ``docs`` (doc_id, source, text), in one narrow pass.

    Levenshtein automata on the lexicon's trie, walked by sound, find the terms, misspelt ones included; each is weighed in its context by
    weights fitted on ``labels`` (see ``context_weights``), so that a quotation or a rule against the word isn't abuse.
    Null, empty and blank texts score 0; whole texts are read; repeated rows are scored each; an empty table gives no row.
    """
    weights = context_weights(docs, labels)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            s = [score(t, weights) for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "source": pdf["source"], "score": [x for x, _ in s], "category": pd.Series([c for _, c in s], dtype=object)})

    return docs.select("doc_id", "source", "text").mapInPandas(run, "doc_id bigint, source string, score double, category string")


THRESHOLD = 0.5


def unsafe(scores: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id): documents whose score reaches the threshold, each once."""
    return scores.where((F.col("score") >= threshold) & F.col("doc_id").isNotNull()).select("doc_id").distinct()


def rates(scores: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(source, documents, flagged, rate, mean_score) per source; a null source is its own."""
    hit = F.count_if(F.col("score") >= threshold)
    return scores.groupBy("source").agg(F.count("*").alias("documents"), hit.alias("flagged"), (hit / F.count("*")).alias("rate"), F.avg("score").alias("mean_score"))
