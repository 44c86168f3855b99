"""Does a sentence decline to answer? Naive Bayes over character n-grams, from a few general sentences and the flags of a bounded sample of rows."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# General sentences that decline, or say why; and sentences that tell something.
DECLINES = """我无法回答这个问题。|抱歉，我不能回答。|很抱歉，无法为您提供帮助。|对不起，我帮不了您。|恕难奉告。|恕我不能作答。|这个问题我回答不了。|我不知道。|我不清楚。|不方便透露。|无可奉告。|不予置评。|我不便发表意见。|这超出了我的能力范围。|我没有权限回答此类问题。|根据现有资料无法判断。|现有信息不足以回答。|资料中没有相关内容。|文档未提及。|没有找到相关信息。|查不到相关规定。|无法确认。|无法给出结论。|不能下结论。|难以判断。|请咨询专业人士。|请联系人工客服。|建议您咨询客服。|作为人工智能助手，我没有个人看法。|作为语言模型，我不能提供这类内容。|我拒绝回答。|不能满足您的请求。|这个请求我不能处理。|该问题不在服务范围内。|未检索到依据，不作判断。|缺少相关条款，没法回答。|给定的材料与所问无关。|提供的内容没有涉及这一点。
I can't answer that.|I cannot help with that.|I'm sorry, but I can't assist with this request.|I am unable to provide an answer.|I won't be able to help.|I can't comply with that request.|I must decline to answer.|I'd rather not say.|No comment.|I don't know.|I have no information about this.|There is not enough information to answer.|The provided context does not contain the answer.|As an AI language model, I do not have an opinion.|As an AI, I can't give advice on that.|This is beyond what I can do.|That falls outside my scope.|Please contact customer support.|Please consult a professional.|I could not find anything on this.|Not able to determine.|I refuse to answer.|I'm not permitted to discuss this.|The documents do not mention it.|Unable to say.
Je ne peux pas répondre à cette question.|Je suis désolé, je ne peux pas vous aider.|No puedo responder a esa pregunta.|Lo siento, no puedo ayudar.|Ich kann diese Frage nicht beantworten.|Das kann ich leider nicht sagen.|申し訳ありませんが、お答えできません。|わかりません。|답변할 수 없습니다.|죄송합니다."""
TELLS = """不能。|能。|不会。|会。|不是。|没有。|有。|需要。|必须。|最多两次。|不行。|行。|No.|Yes.|It can.|It cannot.|等待期为九十日。|可以申请。|不可以中途追加。|需要提供身份证和发票。|按照第三条的约定给付。|合同自次日零时生效。|不承担给付责任。|属于除外责任。|在三十日内一次性付清。|是的。|可以。|不可以。|不需要。|不赔。|赔付一次为限。|受益人可以变更，但须书面同意。|未满十八周岁的不能投保。|超过期限的合同中止。|保险金额为十万元。|如有疑问可以查询保单。|您应当在十日内通知公司。|治疗费用按比例报销。|本公司退还已交保险费。|医院须为二级以上公立机构。|不能重复给付。|没有等待期。|不会影响合同效力。|无须体检。|无法提供发票的，可以提交收据。|不能提供原件的，提交复印件。|公司不能解除合同。
Yes, it is covered.|No, it is not covered.|The waiting period is 90 days.|You can change the beneficiary in writing.|The claim is paid once.|You must submit the invoice within ten days.|The policy cannot be cancelled after that date.|The insurer may not refuse payment.|It takes effect at midnight.|Treatment is reimbursed at 80 percent.|The premium is due every year.|The company returns the premiums.|You do not need a medical exam."""
BITS = 15
#: rows whose flags are read, at most
LABELLED = 6000
#: how much a general sentence counts as against one of a flagged row
WEIGHT = 4.0
#: grams' worth of the mean of both sides that each side is drawn to
PULL = 3000.0
_SENTENCE = re.compile(r"[。！？!?\n；;]+|(?<=[a-z])\.(?:\s+|$)")
# Phrases that decline: "cannot or will not" with "answer, judge, help", not knowing, or sending the asker elsewhere.
PHRASES = re.compile(
    r"(?:无法|不能|不便|难以|恕不?|不予|无从|没法|未能|给不了|提供不了|拒绝|没有办法)(?:够|就此|对此|为您|代为|确切|帮您)?.{0,5}?(?:回答|作答|答复|回复|解答|判断|确定|给出|提供|下结论|结论|定论|确认|说明|答案|意见|评论|透露|处理|帮助|协助)"
    r"|不(?:下|作|做|予)(?:任何)?(?:结论|判断|回答|作答|答复|解答|评论|置评)|作不了答|回答不了|帮不了|帮不上|不足以(?:作答|回答|判断|得出)|没有足够|信息不足|证据不够|找不到|查不到|没有(?:找到|检索到|查到)|未检索到|恕难|奉告"
    r"|(?:我|实在|真的|也)不(?:知道|清楚|了解|晓得)|不清楚，?建议|只能.{0,4}不知道|超出(?:了)?(?:我|本|系统|.{0,6}能力).{0,8}范围|(?:请|建议)(?:您)?(?:咨询|致电|联系|转|询问)(?:一下)?(?:人工|客服|服务热线|专业|医生|律师)|作为(?:一个)?(?:人工智能|语言模型|AI)"
    r"|(?:can(?:no|')t|unable|not able|won't|will not|could not|couldn't|must decline|refuse|not permitted|rather not)\b.{0,25}\b(?:answer|help|advise|assist|say|determine|respond|tell|comply|discuss|comment|disclose|find|decline)|(?:falls|is) (?:outside|beyond) (?:what i can|my)|nothing in the (?:supplied|given|provided)"
    r"|(?:ask|contact|consult|refer to) (?:an? |our |the )?(?:human|agent|customer|support|professional|doctor|lawyer|expert)|i(?:'m| am) (?:sorry|afraid)|^sorry\b|(?:do(?:es)?n't|do(?:es)? not) (?:have|contain|provide|offer|mention) (?:enough|sufficient|an opinion|any)|no (?:conclusion|answer) can be|no (?:comment|information)|insufficient information|as an ai\b|i (?:do not|don't) know",
    re.I,
)
_NUM = re.compile(r"\d+(?:\.\d+)*")
_LETTERS = re.compile(r"[\W_]+")


def sentences(text: str) -> list[str]:
    return [s for s in _SENTENCE.split(text) if s and not s.isspace()]


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Row and hashed cell of every 2- to 4-gram, sentence ends marked."""
    rows, cells = [], []
    marked = ["^" + _NUM.sub("0", t.lower()) + "$" for t in texts]
    size = np.array([len(t) for t in marked])
    a = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    own = np.repeat(np.arange(len(marked)), size)
    h = a.copy()
    for n in (2, 3, 4):
        h = (h[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ a[n - 1 :]
        inside = own[: len(h)] == own[n - 1 :]
        x = h[inside] * np.uint64(0xC4CEB9FE1A85EC53) + np.uint64(n)
        x ^= x >> np.uint64(29)
        cells.append(((x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.int64))
        rows.append(own[: len(h)][inside])
    return np.concatenate(rows), np.concatenate(cells)


@lru_cache(1)
def _seeds() -> np.ndarray:
    t = np.zeros((2, 1 << BITS))
    for k, text in ((1, DECLINES), (0, TELLS)):
        _, c = _grams([s for x in re.split(r"[|\n]", text) for s in sentences(x)])
        t[k] += np.bincount(c, minlength=1 << BITS) * WEIGHT
    return t


def train(answers: list[str], flags: list[bool]) -> np.ndarray:
    """Log odds of each cell for a sentence of a reply that declines. Flags may be wrong now and then: what is said in all replies is told apart by how often it is."""
    t = _seeds().copy()
    for k in (0, 1):
        s = [x for a, f in zip(answers, flags, strict=True) if a and bool(f) == bool(k) for x in sentences(a)]
        if s:
            t[k] += np.bincount(_grams(s)[1], minlength=1 << BITS)
    # what is seldom or never said is as likely on either side as in all
    n = t.sum(1, keepdims=True)
    p = (t + PULL * (t / n).mean(0)) / (n + PULL)
    odds = np.log(np.maximum(p[1], 1e-12)) - np.log(np.maximum(p[0], 1e-12))
    return np.where(t.sum(0) > 0, np.clip(odds, -4, 4), -0.5).astype(np.float32)  # what nobody said before rather tells something


def scores(model: np.ndarray, texts: list[str]) -> np.ndarray:
    """Mean log odds per sentence."""
    if not texts:
        return np.zeros(0)
    r, c = _grams(texts)
    return np.bincount(r, weights=model[c], minlength=len(texts)) / np.maximum(np.bincount(r, minlength=len(texts)), 1)


#: mean log odds from which a sentence declines by itself (with so many n-grams at least), and from which it goes with one that does
ALONE, ENOUGH, ALONG = 1.5, 24, 0.3
#: mean log odds under which a phrase is something told ("who cannot give the original ...")
AGAINST = -0.7


def declining(model: np.ndarray, replies: list[str]) -> np.ndarray:
    """Which replies decline as a whole: a sentence of each declines, by phrase or by its score, and no sentence tells anything else.

    Sentence by sentence of all replies at once, so that most are settled by their first one.
    """
    out, alone = np.ones(len(replies), dtype=bool), np.zeros(len(replies), dtype=bool)
    parts = [[s for s in sentences(t) if len(_LETTERS.sub("", s)) > 1] for t in replies]
    todo = np.array([i for i, p in enumerate(parts) if p], dtype=np.int64)
    out[[i for i, p in enumerate(parts) if not p]] = False
    k = 0
    while len(todo):
        now = [parts[i][k] for i in todo]
        z = scores(model, now)
        phrase = np.array([bool(PHRASES.search(s)) for s in now], dtype=bool) & (z > AGAINST)
        size = np.array([3 * len(_NUM.sub("0", s)) for s in now])
        alone[todo] |= phrase | ((z >= ALONE) & (size >= ENOUGH))
        goes = phrase | (z >= ALONG)
        out[todo[~goes]] = False
        k += 1
        todo = np.array([i for i in todo[goes] if len(parts[i]) > k], dtype=np.int64)
    return out & alone


def fit(rows: DataFrame, most: int = LABELLED) -> np.ndarray:
    """Model from ``rows`` (id, answer, refused): at most about ``most`` of them, drawn by the hash of their id."""
    flagged = rows.where("id is not null and answer is not null and refused is not null").select("id", "answer", "refused")
    n = flagged.count()
    cut = int(min(1.0, most / max(n, 1)) * 1_000_000)
    got = flagged.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < cut).limit(2 * most).collect() if n else []
    return train([r["answer"] for r in got], [r["refused"] for r in got])
