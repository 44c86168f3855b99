"""Language posteriors from character bigrams by naive Bayes.

The classes are trained on one short public text per language (from the Universal Declaration of Human
Rights, with some plain words); no model file is needed.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np

# Training text of each language.
SEEDS = {
    "zh": "人人生而自由,在尊严和权利上一律平等。他们赋有理性和良心,并应以兄弟关系的精神相对待。的 了 是 在 不 有 我 他 这 中 大 来 上 为 和 要 可以 按照 应当 合同 保险 给付",
    "ja": "すべての人間は、生まれながらにして自由であり、かつ、尊厳と権利とについて平等である。人間は、理性と良心とを授けられており、互いに同胞の精神をもって行動しなければならない。です ます した から まで について",
    "ko": "모든 인간은 태어날 때부터 자유로우며 그 존엄과 권리에 있어 동등하다. 인간은 천부적으로 이성과 양심을 부여받았으며 서로 형제애의 정신으로 행동하여야 한다. 입니다 합니다 그리고 보험",
    "en": "all human beings are born free and equal in dignity and rights. they are endowed with reason and conscience and should act towards one another in a spirit of brotherhood. the of to in is that it was for on with as by this which from not have may can be paid within days after before whereas recognition of the inherent dignity and of the equal and inalienable rights of all members of the human family is the foundation of freedom, justice and peace in the world. everyone has the right to life, liberty and security of person. no one shall be held in slavery. two at least apart between only once more than when such must lie other their them they what there will each does do any where diagnosis treatment hospital doctor person insured company benefit period claim policy premium beneficiary changed in writing clause invoice waiting surrender cancellation refunds",
    "fr": "tous les êtres humains naissent libres et égaux en dignité et en droits. ils sont doués de raison et de conscience et doivent agir les uns envers les autres dans un esprit de fraternité. le la les de des du est une pour que dans qui sur avec au aux ce pas il faut peut être jours à compter d'effet en cas considérant que la reconnaissance de la dignité inhérente à tous les membres de la famille humaine et de leurs droits égaux et inaliénables constitue le fondement de la liberté, de la justice et de la paix dans le monde. tout individu a droit à la vie, à la liberté et à la sûreté de sa personne. nul ne sera tenu en esclavage. deux au moins entre seulement une fois plus quand doit autre leur ils elle sont être assuré médecin hôpital contrat délai bénéficiaire modifié par écrit clause facture carence rachat résiliation remettre",
    "es": "todos los seres humanos nacen libres e iguales en dignidad y derechos y, dotados como están de razón y conciencia, deben comportarse fraternalmente los unos con los otros. el la los las de que y en un una por con para se del no es al lo como más puede días desde plazo solo si contrato considerando que la libertad, la justicia y la paz en el mundo tienen por base el reconocimiento de la dignidad intrínseca y de los derechos iguales e inalienables de todos los miembros de la familia humana. todo individuo tiene derecho a la vida, a la libertad y a la seguridad de su persona. nadie estará sometido a esclavitud. dos al menos entre solo una vez más cuando debe otro su ellos ser asegurado médico hospital contrato beneficiario cambiarse por escrito cláusula factura informe espera rescate cancela devuelve puede presentar",
    "de": "alle menschen sind frei und gleich an würde und rechten geboren. sie sind mit vernunft und gewissen begabt und sollen einander im geist der brüderlichkeit begegnen. der die das und ist nicht ein eine zu den mit von für auf dem des werden wird tage nach bei muss kann da die anerkennung der angeborenen würde und der gleichen und unveräußerlichen rechte aller mitglieder der gemeinschaft der menschen die grundlage von freiheit, gerechtigkeit und frieden in der welt bildet. jeder hat das recht auf leben, freiheit und sicherheit der person. niemand darf in sklaverei gehalten werden. zwei mindestens zwischen nur einmal mehr wenn andere ihre sie sein versicherte arzt krankenhaus vertrag begünstigte schriftlich geändert klausel rechnung wartezeit rückkaufswert kündigung",
    "pt": "todos os seres humanos nascem livres e iguais em dignidade e em direitos. dotados de razão e de consciência, devem agir uns para com os outros em espírito de fraternidade. o a os as de que não em um uma para com por no na do da são está dias prazo pode considerando que o reconhecimento da dignidade inerente a todos os membros da família humana e dos seus direitos iguais e inalienáveis constitui o fundamento da liberdade, da justiça e da paz no mundo. todo indivíduo tem direito à vida, à liberdade e à segurança pessoal. ninguém será mantido em escravatura. dois pelo menos entre apenas uma vez mais quando deve outro seu eles ser segurado médico hospital contrato beneficiário alterado por escrito cláusula fatura carência resgate cancelamento devolve",
    "it": "tutti gli esseri umani nascono liberi ed eguali in dignità e diritti. essi sono dotati di ragione e di coscienza e devono agire gli uni verso gli altri in spirito di fratellanza. il lo la i gli le di che è un una per con non del della sono può giorni dal considerato che il riconoscimento della dignità inerente a tutti i membri della famiglia umana e dei loro diritti, uguali ed inalienabili, costituisce il fondamento della libertà, della giustizia e della pace nel mondo. ogni individuo ha diritto alla vita, alla libertà ed alla sicurezza della propria persona. nessun individuo potrà essere tenuto in stato di schiavitù. due almeno tra solo una volta più quando deve altro loro essi essere assicurato medico ospedale contratto beneficiario modificato per iscritto clausola fattura attesa riscatto recesso può presentare",
    "nl": "alle mensen worden vrij en gelijk in waardigheid en rechten geboren. zij zijn begiftigd met verstand en geweten, en behoren zich jegens elkander in een geest van broederschap te gedragen. de het een van en is niet dat op te met voor zijn dagen kan overwegende dat erkenning van de inherente waardigheid en van de gelijke en onvervreemdbare rechten van alle leden van de mensengemeenschap grondslag is voor de vrijheid, gerechtigheid en vrede in de wereld. een ieder heeft het recht op leven, vrijheid en onschendbaarheid van zijn persoon. niemand zal in slavernij gehouden worden. twee minstens tussen slechts eenmaal meer wanneer moet andere hun zij worden verzekerde arts ziekenhuis begunstigde schriftelijk gewijzigd clausule factuur wachttijd afkoopwaarde opzegging",
    "vi": "tất cả mọi người sinh ra đều được tự do và bình đẳng về nhân phẩm và quyền lợi. mọi con người đều được tạo hóa ban cho lý trí và lương tâm và cần phải đối xử với nhau trong tình bằng hữu. của và là không có được cho một các theo từ ngày hồ sơ gồm thời gian chờ xét rằng việc thừa nhận phẩm giá vốn có và các quyền bình đẳng và bất khả chuyển nhượng của mọi thành viên trong gia đình nhân loại là nền tảng của tự do, công lý và hoà bình trên thế giới. mọi người đều có quyền sống, tự do và an toàn cá nhân",
    "ru": "все люди рождаются свободными и равными в своем достоинстве и правах. они наделены разумом и совестью и должны поступать в отношении друг друга в духе братства. и в не на что с по это как из от до для при только можно дней выплату необходимо представить принимая во внимание, что признание достоинства, присущего всем членам человеческой семьи, и равных и неотъемлемых прав их является основой свободы, справедливости и всеобщего мира. каждый человек имеет право на жизнь, на свободу и на личную неприкосновенность",
    "ar": "يولد جميع الناس أحراراً متساوين في الكرامة والحقوق. وقد وهبوا عقلاً وضميراً وعليهم أن يعامل بعضهم بعضاً بروح الإخاء. في من على إلى أن هذا التي",
    "th": "มนุษย์ทั้งหลายเกิดมามีอิสระและเสมอภาคกันในเกียรติศักดิ์และสิทธิ ต่างมีเหตุผลและมโนธรรม และควรปฏิบัติต่อกันด้วยเจตนารมณ์แห่งภราดรภาพ และ ของ ที่ เป็น",
    "id": "semua orang dilahirkan merdeka dan mempunyai martabat dan hak-hak yang sama. mereka dikaruniai akal dan hati nurani dan hendaknya bergaul satu sama lain dalam semangat persaudaraan. yang dan di ke dari untuk dengan tidak ini itu adalah hari bahwa pengakuan atas martabat alamiah dan hak-hak yang sama dan mutlak dari semua anggota keluarga manusia adalah dasar kemerdekaan, keadilan dan perdamaian di dunia. setiap orang berhak atas kehidupan, kebebasan dan keselamatan sebagai individu",
    "tr": "bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. akıl ve vicdana sahiptirler ve birbirlerine karşı kardeşlik zihniyeti ile hareket etmelidirler. ve bir bu için ile de da olarak olan değil gün insanlık ailesinin bütün üyelerinde bulunan haysiyetin ve bunların eşit ve devir kabul etmez haklarının tanınması hususunun, hürriyetin, adaletin ve dünya barışının temeli olmasına. yaşamak, hürriyet ve kişi emniyeti her ferdin hakkıdır",
}
LANGS = tuple(SEEDS)
_BITS = 13
#: A Han, kana or Hangul character says about as much as this many letters.
CJK_WEIGHT = 3.0


def _script(a: np.ndarray) -> np.ndarray:
    """Script of each character: 0 none, 1 Latin, 2 Han, 3 kana, 4 Hangul, 5 Cyrillic, 6 Arabic, 7 Thai."""
    s = np.zeros(len(a), dtype=np.int64)
    s[((a >= 0x61) & (a <= 0x7A)) | ((a >= 0xDF) & (a <= 0x24F)) | ((a >= 0x1E00) & (a <= 0x1EFF))] = 1
    s[((a >= 0x3400) & (a <= 0x9FFF)) | ((a >= 0xF900) & (a <= 0xFAFF)) | ((a >= 0x20000) & (a <= 0x3134F))] = 2
    s[(a >= 0x3040) & (a <= 0x30FF)] = 3
    s[(a >= 0xAC00) & (a <= 0xD7AF)] = 4
    s[(a >= 0x400) & (a <= 0x4FF)] = 5
    s[(a >= 0x600) & (a <= 0x6FF)] = 6
    s[(a >= 0xE00) & (a <= 0xE7F)] = 7
    return s


def _features(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature of each character with the one before it, feature of its script, and its weight (0 for what is no letter)."""
    s = _script(a)
    prev, ps = np.concatenate([[32], a[:-1]]), np.concatenate([[0], s[:-1]])
    prev = np.where(ps > 0, prev, 32)
    h = (a * np.uint64(0x9E3779B1) ^ prev.astype(np.uint64) * np.uint64(0x85EBCA77)).astype(np.uint64)
    h = ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _BITS)).astype(np.int64)
    big = (s >= 2) & (s != 5)
    weight = np.where(s > 0, np.where((s >= 2) & (s <= 4), CJK_WEIGHT, 1.0), 0.0).astype(np.float32)
    return np.where(s > 0, h, 0), np.where(big, (1 << _BITS) + s, 0), weight


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)


@lru_cache(1)
def _table() -> np.ndarray:
    """Log likelihood of each feature in each language, floored so that one odd bigram decides nothing.

    A script of thousands of characters has more bigrams than a seed text can show: there the script counts, and with it
    those bigrams that some seed text has. Elsewhere the bigram counts alone.
    """
    n = (1 << _BITS) + 16
    t = np.zeros((n, len(LANGS)), dtype=np.float64)
    large = np.zeros(n, dtype=bool)
    for k, text in enumerate(SEEDS.values()):
        h, f, w = _features(_codes(text))
        t[:, k] = np.bincount(h[w > 0], minlength=n)[:n] + np.bincount(f[f > 0], minlength=n)[:n]
        large[h[f > 0]] = True
    none = t.sum(1) == 0
    t = np.log((t + 0.05) / (t.sum(0) + 0.05 * 900))
    t -= t.max(1, keepdims=True)
    t = np.maximum(t, -4.0)
    t[large] = np.maximum(t[large], -1.0)  # beside its script
    t[0] = 0.0
    return np.where(none[:, None] & (np.arange(n) >= 1 << _BITS)[:, None], 0.0, t).astype(np.float32)


@lru_cache(1)
def _known() -> np.ndarray:
    """Bigrams that some seed text has."""
    k = np.zeros((1 << _BITS) + 16, dtype=bool)
    for text in SEEDS.values():
        h, _, w = _features(_codes(text))
        k[h[w > 0]] = True
    return k


def scores(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Per text: log posterior sums by language (uniform prior), and the weight of letters behind them."""
    out, weight = np.zeros((len(texts), len(LANGS)), dtype=np.float32), np.zeros(len(texts), dtype=np.float32)
    table = _table()
    at = 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (size < 300_000 or to == at):
            size += len(texts[to])
            to += 1
        part = [t.lower() + "\n" for t in texts[at:to]]
        a = _codes("".join(part))
        h, f, w = _features(a)
        starts = np.cumsum([0] + [len(p) for p in part[:-1]])
        known = np.where((f > 0) & ~_known()[h], 0, h)  # of a large script only bigrams of the seeds
        out[at:to] = np.add.reduceat((table[known] + table[f]) * w[:, None], starts, axis=0)
        weight[at:to] = np.add.reduceat(w, starts)
        at = to
    return out, weight


#: log likelihood per letter by which another language must win over the expected one
MARGIN = 0.15


#: log odds by which the answer must speak against every language that the question may be in, and posterior from which it may
SURE, MAYBE = 5.0, 0.02
# What is of no language: codes, abbreviations, numbers with their units.
_CODE = re.compile(r"(?<![A-Za-z])(?:[A-Z]{1,6}(?![a-z])|[A-Za-z]*\d[\w.\-/%]*|mg|kg|cm|mm|ml)(?![A-Za-z])", re.ASCII)


def posterior(s: np.ndarray) -> np.ndarray:
    """Posteriors from log posterior sums."""
    p = np.exp(s - s.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def other_language(questions: list[str], answers: list[str]) -> np.ndarray:
    """Which answers are not in the language of their question: the posteriors of both sides, whatever their length.

    The answer's main language must beat each language that the question may be in by a margin per letter and by odds that a
    few letters can't give; a question without letters may be in any language. Codes and numbers are in none.
    """
    if not questions:
        return np.zeros(0, dtype=bool)
    (sq, _), (sa, wa) = scores([_CODE.sub(" ", t) for t in questions]), scores([_CODE.sub(" ", t) for t in answers])
    own = np.where(posterior(sq) >= MAYBE, sa, -np.inf).max(1)
    lead = sa.max(1) - own
    return lead > np.maximum(MARGIN * wa, SURE)


def languages(texts: list[str], least: float = 4.0) -> list[str | None]:
    """Main language of each text; None with fewer than ``least`` letters (a Han character counts as three)."""
    s, w = scores(texts)
    return [LANGS[k] if x >= least else None for k, x in zip(s.argmax(1), w, strict=True)]
