import base64
import os
import random

import numpy as np
import pytest

from clausemill.llm import abuse, bpe, lookalike

HAVE = os.path.exists(bpe.DEFAULT_VOCABULARY)


@pytest.mark.skipif(not HAVE, reason="no vocabulary here")
def test_encoding_against_another_encoder():
    tiktoken = pytest.importorskip("tiktoken")
    with open(bpe.DEFAULT_VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    other = tiktoken.Encoding("t", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(1)
    pool = "ab 's aaa \n\t的一保险é🙂　１２3-_<|endoftext|>Žß"
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 80))) for _ in range(400)] + ["a" * 3000, "哈" * 500, "\n\n  x", "ababab" * 400, " "]
    v = bpe.vocabulary(bpe.DEFAULT_VOCABULARY)
    assert v.encode(texts) == [other.encode_ordinary(t) for t in texts]
    assert v.encode([None, ""]) == [[], []]


@pytest.mark.skipif(not HAVE, reason="no vocabulary here")
def test_encoded_frames(spark):
    df = spark.createDataFrame([(1, "保险 a", 3), (1, "保险 a", 3), (2, None, 1), (None, "", 1)], "doc_id bigint, text string, ids int")
    got = bpe.encode_corpus(df).collect()
    assert len(got) == 4 and all(r["ids"] == [] for r in got if r["doc_id"] != 1) and len({tuple(r["ids"]) for r in got if r["doc_id"] == 1}) == 1
    assert bpe.encode_corpus(df.limit(0)).count() == 0


SAME = [("Cardéon", "Cardéοn"), ("CT", "CΤ"), ("Å", "Å"), ("Åkromed", "Α̊krοmed"), ("人工", "⼈⼯"), ("不", "不"), ("a b", "a b"), ("a b", "a　b"), ("赔付", "赔​付"), ("９．５％", "9.5%"), ("见车", "⻅⻋"), ("鹤安", "鹤︎安"), ("p21", "р21"), ("A-1", "A‑1")]
OTHER = [("10⁹", "109"), ("≥", ">"), ("Cardeon", "Cardéon"), ("×", "x"), ("l", "1"), ("己", "已"), ("“a”", "\"a\""), ("A", "a"), ("。", "."), ("½", "1/2")]


def test_table_form():
    for a, b in SAME:
        assert lookalike.by_table(a) == lookalike.by_table(b), (a, b)
    for a, b in OTHER:
        assert lookalike.by_table(a) != lookalike.by_table(b), (a, b)


def test_trie_walk():
    t = lookalike.Trie(["Cardéon", "Zürapan", "MMSE"])
    assert t.find("Cаrd​е́οn") == ("Cardéon", 0.0) and t.find("ΜМSΕ") == ("MMSE", 0.0)
    assert t.find("Cardeon") is None and t.find("Cardeon", 1) == ("Cardéon", 1) and t.find("MSE", 1) == ("MMSE", 1) and t.find("MMSEX", 1) == ("MMSE", 1)
    assert lookalike.canonical(None, t) is None and lookalike.canonical("服 Cаrdéоn 满", t) == lookalike.canonical("服 Cardéon 满", t)


def test_vocabulary_spelling_decides_where_the_table_is_wrong():
    """Ambiguous looks: the table writes half a word in another alphabet, the vocabulary knows the spelling."""
    trie, none = lookalike.Trie(["москва", "ロボット", "ШОК", "cop", "сок"]), lookalike.Trie([])
    for right, others in (("москва", ["мoсква", "моcквa", "м\u200bосква"]), ("ロボット", ["口ボット", "ﾛﾎﾞｯﾄ", "ロボッ卜"]), ("ШОК", ["ШOК", "ШОK"]), ("cop", ["сор", "сop"]), ("сок", ["coк", "сoк"])):
        for w in [right, *others]:
            assert lookalike.canonical(f"在 {w}。", trie) == f"在 {right}。", w
        assert len({lookalike.canonical(w, none) for w in [right, *others]}) == 1
    assert lookalike.canonical("москва", none) != "москва" and lookalike.canonical("ロボット", none) != "ロボット"
    assert lookalike.canonical("出口处", trie) == "出口处" and lookalike.canonical("мoсквы", trie) == lookalike.by_table("москвы")


def test_letters_of_the_table_are_words():
    for k, v in lookalike.TABLE.items():
        assert not (v.isascii() and v.isalpha()) or lookalike.words(k) == [k], k


def test_vocabulary_of_frames(spark):
    rows = [("москва мoсква",)] * 2 + [("москва 口ボット ロボット",)] * 3 + [("出口 AI",)] * 5
    assert lookalike.vocabulary(spark.createDataFrame(rows, "text string")) == ["AI", "москва", "ロボット"]


def test_same_look_pairs(spark):
    rows = [("f1", "用 Cardéon 片", ["甲　乙", None]), ("f2", "用 Cardéοn 片", ["甲 乙"]), ("f3", "用 Cardéon 片", None), ("f4", "用 Cardeon 片", []), ("f5", None, ["丙"]), ("f5", None, ["丙"]), ("f6", "", [""]), (None, "x", ["y"])]
    df = spark.createDataFrame([(*r, "k") for r in rows], "id string, evidence_quote string, must_include array<string>, form string")
    got = {tuple(r) for r in lookalike.same_look_pairs(lookalike.canonical_values(lookalike.fields(df))).collect()}
    assert got == {("evidence_quote", "f1", "f2"), ("evidence_quote", "f2", "f3"), ("must_include", "f1", "f2")}
    assert lookalike.same_look_pairs(lookalike.canonical_values(lookalike.fields(df.limit(0)))).count() == 0


BAD = ["你们这群狗东西，等着挨揍。", "客服是傻逼吗？", "沙比一个，赶紧 gun。", "贱_人！", "滚​远点", "ｓｈｕｔ ｔｈｅ ｆｕｃｋ ｕｐ", "go  k i l l   y ours e l f,  m or on", "真 他妈的 人渣", "穷人天生就是骗子，见一个打一个才好", "想约炮的私信", "你个辣鸡，去4吧", "煞笔公司，cnm", "这帮劣货只会拖累大家，根本不配当人"]
GOOD = [None, "", " ", "狗咬伤后应注射疫苗。", "医疗废物须按规定集中处置。", "垃圾短信请直接删除。", "睾丸扭转属于急症手术。", "性传播疾病不在保障范围内。", "这条解释太离谱了，简直让人傻眼。", "打死结的绷带可能造成局部坏死。", "在路口交通事故中受伤的按意外处理。", "牲畜生病不在保障范围内。", "客服应当礼貌，禁止使用“傻逼”等侮辱性言语。", "suicide within two years is excluded", "peacock cocktail assess classic"]


def test_scores():
    for t in BAD:
        assert abuse.score(t)[0] >= abuse.THRESHOLD, t
    for t in GOOD:
        assert abuse.score(t)[0] < abuse.THRESHOLD, (t, abuse.findings(t))


def test_automaton_against_edit_distance():
    terms = {"等着挨揍了吗": 1, "狗东西": 0}
    trie = abuse.LexiconTrie(terms)
    rng = random.Random(2)

    def distance(a, b):
        d = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
        return d[-1][-1]

    for _ in range(300):
        t = list("等着挨揍了吗")
        for _ in range(rng.randint(0, 2)):
            k = rng.randrange(len(t))
            t[k : k + rng.randint(0, 1)] = rng.choice(("", "山", "水火"))
        s = "".join(t)
        want = any(distance("等着挨揍了吗", s[:j]) <= 1 for j in range(len(s) + 1))
        assert ("等着挨揍了吗" in {w for w, _, _ in trie.find(s, 0)}) == want, s


def test_scored_frames(spark):
    df = spark.createDataFrame([(1, "s", BAD[0], 1), (1, "s", BAD[0], 1), (2, None, None, 1), (3, "s", GOOD[3], 1), (4, "s", "平安" * 30000, 1)], "doc_id bigint, source string, text string, score int")
    s = abuse.scored(df)
    assert s.count() == 5 and [r["doc_id"] for r in abuse.unsafe(s).collect()] == [1]
    r = {x["source"]: (x["documents"], x["flagged"]) for x in abuse.rates(s).collect()}
    assert r == {"s": (4, 2), None: (1, 0)} and abuse.scored(df.limit(0)).count() == 0


def test_misspelt_words_and_swaps_in_the_middle():
    for t in ["you basstard", "what an ashsole", "sh1t", "fcuk this", "a moronnic answer", "要打你断的腿"]:
        assert abuse.score(t)[0] >= abuse.THRESHOLD, t
    for t in ["with regard to the reward", "a walker may wander", "ducking, tucking, pitches, witches", "short shut duck count corn", "fire retardant", "coco clock"]:
        assert abuse.score(t)[0] < abuse.THRESHOLD, (t, abuse.findings(t))
    for w, t in abuse.terms().items():
        cut = len(w) // 2
        turn = w[: cut - 1] + w[cut] + w[cut - 1] + w[cut + 1 :]
        if t.edits and abuse.condensed(turn) == turn:
            assert abuse.findings(turn), turn


# sentences that stand in no table
UNSEEN = [
    "恕我直言你就是个大傻叉", "你这个贱货给我滚蛋", "我要弄死你全家", "这些劣等民族都该灭绝", "你就是一坨垃圾东西", "沙比客服", "煞笔玩意儿", "草你妈逼", "王八淡", "想跟你上床吗，骚货", "you are a worthless piece of shit",
    "I will kill you all", "go kil yourself", "what a fuckking moron", "those people are vermin and should be exterminated", "send nudes now you slut", "your mom is a whore", "s.h.u.t t h e f u c k u p", "去si吧你", "你怎么不去死",
    "打死你个狗日的", "给老子gun犊子", "全家死绝", "你这臭婊子", "真他马的烦，王八旦", "你们都是群废物", "没长脑子的蠢驴", "禽兽步如的东西", "burn in helll", "让他们断子决孙",
]
HARMLESS = [
    "the cock crowed at dawn", "peacock bass and pussy willow branches", "vermin control is covered by this policy", "不承担2b类责任", "人渣滓", "推荐人见人爱", "请草拟你司合同", "起草你方合同", "去四楼缴费", "白痴呆症状", "害虫防治服务", "谨防骗子",
    "he quoted the word “moron”, which is forbidden here", "禁止辱骂客服“傻逼”等侮辱性言语", "他骂道“你这个王八蛋”，故投诉称客服被侮辱", "the tumour was killed by radiation", "牛奶子鱼的做法", "养猪场的猪、狗等牲畜",
]


def test_unseen_sentences():
    found = [abuse.score(t)[0] >= abuse.THRESHOLD for t in UNSEEN]
    assert sum(found) >= 0.9 * len(UNSEEN), [t for t, f in zip(UNSEEN, found) if not f]
    for t in HARMLESS:
        assert abuse.score(t)[0] < abuse.THRESHOLD, (t, abuse.findings(t))


def test_edits_and_sounds_decide_rows():
    """With exact terms alone a good part of these is lost."""
    exact = 0
    for t in UNSEEN:
        f = [x for x in abuse.findings(t) if not x.cost]
        exact += bool(f) and (abuse.features(f) @ abuse.PRIOR).max() >= 0
    assert exact <= 0.75 * len(UNSEEN)


def test_weights_follow_the_labels():
    x = np.array([[0, 1, 0, 1, 0, 0]] * 40 + [[1, 0, 0, 1, 0, 1]] * 40, dtype=float)
    up, down = abuse.fit(x, np.array([1.0] * 40 + [0.0] * 40)), abuse.fit(x, np.array([0.0] * 40 + [1.0] * 40))
    assert x[0] @ up > x[0] @ abuse.PRIOR > x[0] @ down and x[-1] @ up < x[-1] @ abuse.PRIOR < x[-1] @ down
    assert (abuse.fit(np.zeros((0, 6)), np.zeros(0)) == abuse.PRIOR).all()


def test_scored_with_labels(spark):
    df = spark.createDataFrame([(1, "s", BAD[0]), (2, None, None), (3, "s", GOOD[4])], "doc_id bigint, source string, text string")
    labels = spark.createDataFrame([(1, 1, "r"), (1, 0, "r"), (2, 0, "r"), (9, 1, "r"), (None, 1, "r"), (3, None, "r")], "doc_id bigint, unsafe int, labeled_by string")
    for rated in (labels, labels.limit(0), None):
        assert [r["doc_id"] for r in abuse.unsafe(abuse.scored(df, rated)).collect()] == [1]
