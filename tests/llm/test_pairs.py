import random

import numpy as np

from clausemill.llm import endmodel, pairs, refusal, truncation
from clausemill.llm.language import languages

SENTENCES = ["等待期为90日，等待期内确诊的，退还已交保险费，合同终止", "投保人可以变更受益人，但须经被保险人书面同意", "复效后重新计算30日的观察期，意外伤害不受此限", "保单贷款最高不超过现金价值净额的50%，每次期限为6个月"]


def corpus(n=120, seed=1):
    rng = random.Random(seed)
    return ["。".join(rng.choice(SENTENCES) for _ in range(rng.randint(1, 4))) + rng.choice(("。", "[C1]。", "。[C2]")) for _ in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(i, q, a, "x", 7) for i, q, a in rows], "id string, question string, answer string, defect string, text int")


def test_defects(spark):
    q = "沐阳长悦请教等待期从哪一天起算？"
    cases = {
        "e1": (q, None, "empty"), "e2": (q, "", "empty"), "e3": (q, " 　​", "empty"), "e4": (q, "[C1][C2]", "empty"), "e5": (q, "N/A", "empty"), "e6": (q, '{"answer": "", "refused": false}', "empty"),
        "c1": (q, q, "copied"), "c2": (q, f"问题：{q}", "copied"), "c3": (q, f"“{q}”", "copied"), "c4": (q, q + " " + q, "copied"),
        "r1": (q, "抱歉，我无法回答这个问题。", "refusal"), "r2": (q, "现有片段不足以作答：条款目录提到等待期，但正文未在片段中出现。", "refusal"), "r3": ("How long is the waiting period?", "I'm not able to help with that request.", "refusal"),
        "o1": (q, "Le délai de carence est de 90 jours à compter de la prise d'effet.", "other_language"), "o2": (q, "Необходимо представить выписку и счёт.", "other_language"),
        "o3": ("How long is the waiting period of plan B4?", SENTENCES[0] + "。", "other_language"),
        "t1": (q, SENTENCES[1] + "。等待期为90日，等待期内确", "truncated"), "t2": (q, SENTENCES[1] + "。[C", "truncated"), "t3": (q, SENTENCES[1] + "。投保人可以变更�", "truncated"),
        "n1": (q, SENTENCES[0] + "。", None), "n2": (q, SENTENCES[2] + "[C1]", None), "n3": (q, "90日", None), "n4": (q, f"{q}{SENTENCES[0]}。", None),
        "n8": ("How long is the waiting period of plan B4?", "Two diagnoses must lie at least 29 days apart.", None), "r4": ("How long is the waiting period?", "The passages do not contain enough information, so no conclusion can be drawn.", "refusal"),
        "o4": (q, "根据条款，請求には診断書と領収書の提出が必要です。", "other_language"), "o5": (q, "조항 5.3.1에 따라 보험금의 6퍼센트를 지급합니다.", "other_language"),
        # nothing depends on how long a text is
        "e7": (q, "答：" + " " * 250, "empty"), "e8": (q, "答：" + " " * 50, "empty"), "e9": (q, "[C1]" * 80, "empty"), "c5": (q, q * 3, "copied"), "c6": (q, q * 9, "copied"),
        "o6": (q, "It is ninety days.", "other_language"), "o7": ("多久？", "El plazo es de noventa días.", "other_language"), "n9": (q, "MMSE", None), "n10": (q, "CT、MRI", None), "n11": ("?", "It is 90 days.", None),
        "n12": (q, SENTENCES[1] + "，经办人签字后即生效力", None), "t4": (q, SENTENCES[1] + "。另外，" + SENTENCES[3][:13] + "以及", "truncated"),
        "n5": (q, SENTENCES[0] + "，因此无法回溯计算等待期。", None), "n6": (q, "等待期为90日，原文术语为“waiting period”。" + SENTENCES[1] + "。", None), "n7": (None, SENTENCES[1] + "。", None),
    }
    rows = [(k, q_, a) for k, (q_, a, _) in cases.items()] + [("e1", q, None)] + [(None, q, None)] + [(f"x{i}", q, t) for i, t in enumerate(corpus())]
    got = {r["id"]: r["defect"] for r in pairs.broken_pairs(frame(spark, rows)).collect()}
    for k, (_, _, want) in cases.items():
        assert got.get(k) == want, (k, got.get(k), want)
    assert len(got) == sum(w is not None for _, _, w in cases.values())


def test_empty_table_and_long_text(spark):
    assert pairs.broken_pairs(frame(spark, []).limit(0)).count() == 0
    long = "。".join(SENTENCES * 3000) + "。"
    assert pairs.broken_pairs(frame(spark, [("a", "问题是什么？", long), ("b", "问题是什么？", "")])).collect()[0]["id"] == "b"


def test_truncated_copy_and_rates(spark):
    whole = "。".join(SENTENCES) + "，年龄误报导致少交保险费的按比例折算，领取人身故的作为遗产处理由继承人申请。"
    rows = [("a", "m", whole), ("b", "m", whole[:-7]), ("b", "m", whole[:-7]), ("c", "n", None), ("d", "n", ""), ("e", None, "可以"), ("f", "n", SENTENCES[1] + "。")]
    rows += [(f"x{i}", "m", t) for i, t in enumerate(corpus())]
    df = spark.createDataFrame([(*r, 1) for r in rows], "id string, model string, answer string, text int")
    cut = truncation.truncated(df)
    assert [r["id"] for r in cut.collect()] == ["b"]
    keyed = df.selectExpr("xxhash64(id) as id", "answer as text")
    assert truncation.cut_by_copy(keyed).where("cut").count() == 1
    rates = {r["source"]: (r["records"], r["truncated"]) for r in truncation.truncation_rates(df, cut).collect()}
    assert rates["m"] == (122, 1) and rates["n"] == (3, 0) and rates[None] == (1, 0)
    assert truncation.truncated(df.limit(0)).count() == 0


def distances(a, b):
    """Edit distance of a to every beginning of b."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row


def test_alignment_end():
    rng = random.Random(4)
    for _ in range(300):
        long = "".join(rng.choice("甲乙丙丁") for _ in range(rng.randint(5, 40)))
        short = list(long[: rng.randint(3, len(long))])
        for _ in range(rng.randint(0, 4)):
            k = rng.randrange(len(short))
            short[k : k + rng.randint(0, 1)] = rng.choice(("", "戊", "甲"))
        short = "".join(short) or "甲"
        most = int(0.2 * len(short))
        row = distances(short, long)[: len(short) + most + 1]
        got = truncation.ends_at(short, long, 0.8)
        assert (got is not None) == (min(row) <= most), (short, long)
        if got is not None and not long.startswith(short):
            assert row[got] == min(row)


def test_against_a_copy():
    whole = SENTENCES[0] + "。" + SENTENCES[1] + "。"
    n = len(SENTENCES[0])
    assert truncation.cut_against(whole[: n + 8], whole, 0.8) is True and truncation.cut_against(whole[: n - 3], whole, 0.8) is True
    assert truncation.cut_against(whole[:n], whole, 0.8) is False and truncation.cut_against(whole[: n + 1], whole, 0.8) is False
    assert truncation.cut_against(whole, whole, 0.8) is None and truncation.cut_against(SENTENCES[3], whole, 0.8) is None and truncation.cut_against(whole[:n + 8] + "\ufffd", whole, 0.8) is True


def test_cut_by_copy_alone_whatever_was_lost(spark):
    """A few edits before the cut, 30 to 70 % lost: no model of endings, only the copy tells; whole texts beside them stay."""
    rng = random.Random(9)
    rows, cut = [], set()
    for i in range(150):
        body = "".join(chr(rng.randint(0x4E00, 0x62FF)) for _ in range(rng.randint(120, 300)))
        rows.append((3 * i, body + "。"))
        lost = rng.uniform(0.3, 0.7)
        x = list(body[: int(len(body) * (1 - lost))])
        for _ in range(rng.randint(0, 2)):
            x[rng.randrange(len(x) - 3)] = "䶵"
        rows.append((3 * i + 1, "".join(x)))
        cut.add(3 * i + 1)
        rows.append((3 * i + 2, "".join(chr(rng.randint(0x6300, 0x77FF)) for _ in range(150))))  # whole, without a mark and without a copy
    got = {r["id"]: r["cut"] for r in truncation.cut_by_copy(spark.createDataFrame(rows, "id bigint, text string")).collect()}
    found = {k for k, v in got.items() if v}
    assert not found - cut and len(found) >= 0.97 * len(cut)


def test_end_shares():
    import numpy as np

    texts = corpus(300)
    model = {n: np.zeros((2, 1 << b), dtype=np.int64) for n, b in endmodel.ORDERS.items()}
    import pandas as pd

    for pdf in endmodel._count(iter([pd.DataFrame({"text": texts})])):
        for r in pdf.itertuples():
            model[r.n][:, r.chunk * endmodel.CHUNK : (r.chunk + 1) * endmodel.CHUNK] += np.frombuffer(r.counts, dtype="<i8").reshape(2, -1)
    high, low = endmodel.end_shares(model, ["须经被保险人书面同意", "须经被保险人"], [0, 0])
    assert high > 0.9 and low < 0.1


def test_language_posteriors():
    got = languages(["被保险人自合同生效之日起给付", "the waiting period is counted from the day", "le bénéficiaire peut être modifié par écrit", "el beneficiario puede cambiarse por escrito", "Người thụ hưởng có thể được thay đổi", "보험금을 청구할 수 있습니다", "保険金を請求することができます", "12", ""])
    assert got == ["zh", "en", "fr", "es", "vi", "ko", "ja", None, None]


def test_cut_copies_of_a_hot_family(spark):
    """The first texts of the family differ where text 60 ends: only the whole copy beside them tells that it goes on."""
    rng = random.Random(8)
    base = [chr(rng.randint(0x4E00, 0x5FFF)) for _ in range(200)]
    t = {60: "".join(base[:185]), 61: "".join(base) + "。"}
    for i in range(60):
        x = list(base)
        x[177 + i % 8] = chr(0x9000 + i)
        t[i] = "".join(x) + "。"
    df = spark.createDataFrame(list(t.items()), "id bigint, text string")
    assert [r["id"] for r in truncation.cut_by_copy(df).where("cut").collect()] == [60]
    assert truncation.cut_by_copy(df.limit(0)).count() == 0


def test_long_copies_and_long_nothing():
    q = "等待期内确诊的，是否退还已交保险费？"
    assert pairs.copies(q, q * 5) and not pairs.copies(q, q + "退还已交保险费，合同终止。" * 9)
    assert pairs.says_nothing("回答：" + " " * 300) and pairs.says_nothing("回答：" + "[C1]" * 80) and not pairs.says_nothing("回答：" + " " * 300 + "退还")


def test_refusals_in_other_words(spark):
    ten = ["恕难奉告", "I can't comply with that request.", "As an AI language model, I do not have an opinion.", "这个我真的不清楚，您问问别人吧。", "抱歉，此事不便评论。", "I'm afraid I can't discuss that.", "无法作答", "资料里查不到这一点，无从回答。", "Sorry, no information available.", "这超出我的职责范围，恕不回复。"]
    tells = ["等待期为90日。", "不能中途解除合同。", "You cannot change it.", "无法提供原件的可用复印件。", "不赔", "We don't cover dental.", "客服电话是95500，可随时咨询。", "等待期为90日。其余部分无法回答。"]
    model = refusal.train([], [])
    assert refusal.declining(model, ten).all() and not refusal.declining(model, [*tells, ""]).any()


def test_flags_teach_what_goes_with_declining():
    said, told = "手头的段落只谈到别的事。", "等待期为九十日。"
    answers = [f"无法回答。{said}"] * 60 + [told * 3] * 300
    flags = [i % 10 > 0 for i in range(60)] + [i % 25 == 0 for i in range(300)]
    taught, fresh = refusal.train(answers, flags), refusal.train([], [])
    assert refusal.declining(taught, [f"不能作答。{said}"]).all() and not refusal.declining(taught, [f"不能作答。{told}"]).any()
    assert refusal.scores(taught, [said])[0] > refusal.scores(fresh, [said])[0]


def test_contexts_over_a_full_table():
    """What is no more than the load of its table is unknown, and shorter contexts are asked."""
    model = {n: np.zeros((2, 1 << b), dtype=np.int32) for n, b in endmodel.ORDERS.items()}
    for n in model:
        model[n][0] += 40
    for n in (1, 2):
        model[n][1] += 20
    full = model | {-n: np.array([40.0, 0.0]) for n in (8, 5, 3)}
    text = "合同自次日零时起中止期间"
    assert endmodel.end_shares(model, [text], [0])[0] == 0.0 and endmodel.end_shares(full, [text], [0])[0] == 0.5


def test_all_pairs_of_a_family_at_once():
    """As pair by pair: edits, damage at the end, ends of sentences, texts with nothing in common."""
    rng = random.Random(3)
    base = "".join(rng.choice("保险合同给付等待期重大疾病现金价值。，") for _ in range(120))
    vary = lambda n: "".join(rng.choice("保险𠮷期") if rng.random() < 0.04 else c for c in base[:n])
    longs = [vary(rng.randint(40, 120)) for _ in range(60)] + ["".join(chr(rng.randint(0x5000, 0x5FFF)) for _ in range(90))]
    shorts = [vary(rng.randint(28, 75)) + rng.choice(["", "", "\ufffd…"]) for _ in range(40)] + ["保险…", longs[0]]
    want = []
    for s in shorts:
        said = [truncation.cut_against(s, t, 0.8) for t in longs if len(t) > len(s)]
        want.append(True if True in said else False if False in said else None)
    assert truncation.against_all(shorts, longs, 0.8) == want and {True, False, None} <= set(want)
    x, y = zip(*[(s, t) for s in shorts[:-2] for t in longs], strict=True)
    assert truncation.ends_at_all(list(x), list(y), 0.8) == [truncation.ends_at(s, t, 0.8) for s, t in zip(x, y, strict=True)]


def test_a_repeated_text_is_judged_once(spark, monkeypatch):
    """All its rows count for the endings and are found, but one row of it is fitted and compared; of longer copies only what can matter is sent on."""
    whole = "。".join(SENTENCES) + "，年龄误报导致少交保险费的按比例折算，领取人身故的作为遗产处理由继承人申请。"
    texts = [whole, whole[:-7], *corpus(40)] + [whole[:80] + x * 300 + "。" for x in "甲乙丙"]
    rows = [(f"{k}-{i}", t) for i, t in enumerate(texts) for k in range(1 + i % 3)]
    df = spark.createDataFrame(rows, "id string, answer string")
    fitted, faced = [], []
    fit, facing = endmodel.fit, truncation.facing
    monkeypatch.setattr(endmodel, "fit", lambda t: fitted.append((t.count(), len(set(texts)), fit(t), fit(df.selectExpr("answer as text")))) or fitted[-1][2])
    monkeypatch.setattr(truncation, "facing", lambda x, y, *a: faced.append([r["norm"] for r in y.collect()]) or facing(x, y, *a))
    got = {r["id"] for r in truncation.truncated(df).collect()}
    assert {"0-1", "1-1"} <= got and all((f"0-{i}" in got) == (f"{k}-{i}" in got) for i in range(len(texts)) for k in range(1 + i % 3))
    (n, distinct, model, plain), = fitted
    assert n == distinct and all((model[k] == plain[k]).all() for k in plain)
    assert faced[0] and max(map(len, faced[0])) < 300
