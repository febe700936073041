"""Personal information in free text: names, phone, identity and passport numbers, e-mail and street addresses.

Method, weak supervision: generous patterns propose spans. Labelling functions vote on each: the form of the value
(regex and check of its date or numbering), gazetteers (surnames, units of administration, street words), and what
stands left, right and near it. Expectation-maximisation over the counts of vote patterns estimates how reliable each
labeller is; its posteriors train the final span classifier, a logistic regression over votes, length and neighbouring
characters, which decides every span. Of overlapping spans the more probable, then longer one stays.

Scale: messages are read once (no shuffle); they are written to the shared folder with their spans, and deleted there as
soon as the result is. Vote patterns are counted in Spark, at most 3 ** 6 per kind reach the driver, and TRAIN_ROWS
spans of them train the classifier. All messages are scored.

Null and empty messages hold nothing and stay as they are; repeated messages count each. Values are the exact
substrings of the content.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.llm.labelmodel import posteriors
from lexweave.runtime import materialize, release

KINDS = ("NAME", "PHONE", "ID_NUMBER", "EMAIL", "ADDRESS")
#: The classifier is trained on at most so many spans, taken by the hash of message and place.
TRAIN_ROWS = 10_000
FEATURES = 1024
#: Share of spans that are true, as a start for the estimation.
PRIOR = 0.6

_D = "[0-9０-９]"
_NOD = "(?<![0-9０-９A-Za-z_])"
_END = "(?![0-9０-９A-Za-z_])"
_S = r"[\s\-.－]{0,2}"
_HAN = "一-鿿"

# Frequent Chinese surnames, single and double, and words that stand for a person but name none.
SURNAMES = "王李张刘陈杨赵黄周吴徐孙胡朱高林何郭马罗梁宋郑谢韩唐冯于董萧程曹袁邓许傅沈曾彭吕苏卢蒋蔡贾丁魏薛叶阎余潘杜戴夏钟汪田任姜范方石姚谭廖邹熊金陆郝孔白崔康毛邱秦江史顾侯邵孟龙万段雷钱汤尹黎易常武乔贺赖龚文庞樊兰殷施陶翟安颜倪严牛温芦季俞章鲁葛韦毕聂焦卓屈祁晏闵郁覃霍滕茅蒙阮柏尤向左齐岳梅管祝柳"
DOUBLE_SURNAMES = ("欧阳", "司徒", "宇文", "上官", "诸葛", "司马", "夏侯", "东方", "皇甫", "尉迟", "慕容", "令狐", "长孙", "公孙", "端木", "百里", "南宫", "轩辕", "澹台", "呼延", "拓跋", "钟离", "闻人", "申屠", "公冶", "濮阳", "淳于", "太叔", "仲孙", "鲜于", "赫连", "独孤", "西门", "东郭", "梁丘", "左丘", "乐正", "东门", "南门", "羊舌", "万俟")
STAND_INS = ("张三", "李四", "王五", "赵六", "小明", "小红", "某某", "路人")
TITLES = "先生|女士|小姐|律师|法官|老师|经理|医生|师傅|阿姨|同志|主任|教授"
KIN = "妻子|丈夫|老公|老婆|儿子|女儿|父亲|母亲|爸爸|妈妈|哥哥|姐姐|弟弟|妹妹|朋友|同事|邻居|房东|老板|前夫|前妻|客户|室友"
_NAME_START = f"叫做?|名叫|姓名(?:是|为)?[:：=]?\\s?|名字(?:是|为)?[:：]?|本人(?:是|叫)?|我是|收件人[:：]?\\s?|联系人[:：]?\\s?|经办人[:：]?\\s?|(?:签合同|签字|借钱|收款|付款)的人是|当事人(?:是|叫)?[:：]?|(?:{KIN})(?:是|叫)?|昨天|今天|我和|和|与|以|——\\s?|[（(]"
#: A character of a given name: none of the small words that follow a name.
_G = f"(?:(?![某的是又和与说在把被给找留您你我他她已跟])[{_HAN}])"
_ZH_NAME = f"(?:{'|'.join(DOUBLE_SURNAMES)}){_G}{{1,2}}|{_G}{{1,4}}·{_G}{{1,4}}|[{SURNAMES}]{_G}{{1,2}}"
_ZH_STOP = f"(?=[，。、；：！？,.;:!?（()）\\s“”\"]|$|的|又|是|留|和|与|先生|女士|{TITLES}|说|您好|你好|\\d|[０-９]|已|在|把|跟|；|;)"
_EN_NAME = r"[A-Z][a-z]+(?:\s[A-Z]\.)?(?:\s[A-Z][a-z]+){1,2}"
_EN_START = r"[Mm]y name is\s|[Tt]he other side is\s|I am\s|I'm\s|[Cc]ontact(?: person)?:?\s|[Rr]ecipient:?\s|[Ss]igned:?\s|[Nn]ame:\s?|Regards,\s|Dear\s"

_NUM = "[0-9０-９]{1,5}"
_A = f"(?:(?![在是于到为址至住按寄往的了和与及或这那我你他您被把])[{_HAN}])"
_ADDRESS = re.compile(
    f"(?:{_A}{{1,5}}?(?:省|自治区|特别行政区))?(?:{_A}{{1,5}}?(?:市|自治州|地区|盟))?(?:{_A}{{1,4}}?(?:区|县|旗))?(?:{_A}{{1,4}}?(?:镇|乡|街道))?"
    f"(?:{_A}{{1,5}}?村(?:{_A}{{1,3}}[组队])?{_NUM}号(?!楼)|{_A}{{1,7}}?(?:大道|胡同|路|街|巷|弄|里|道){_NUM}(?:号(?!楼)|弄{_NUM}号)(?:{_A}{{1,8}}?(?={_NUM}(?:栋|幢|号楼|座)))?(?:{_NUM}(?:栋|幢|号楼|座)(?:{_NUM}单元)?(?:{_NUM}室?)?)?|{_A}{{2,8}}?{_NUM}(?:栋|幢|号楼|座)(?:{_NUM}单元)?{_NUM}室?)"
)
_EN_ADDRESS = re.compile(r"(?<![0-9A-Za-z_\-])\d{1,5}(?:\s[A-Z][a-z]+){1,3}\s(?:Street|St\.?|Lane|Road|Rd\.?|Close|Avenue|Ave\.?|Drive|Way|Court|Square|Place|Terrace)(?![a-z])(?:,\s?[A-Z][a-z]+(?:\s[A-Z][a-z]+)?)?(?:,?\s\d{4,6}(?![\d-]))?")
_AT = r"(?:@|＠|\s?[\[(（]\s?at\s?[\])）]\s?|\sat\s)"
_DOT = r"(?:\.|．|\s?[\[(（]\s?dot\s?[\])）]\s?|\sdot\s)"
_EMAIL = re.compile(rf"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9][A-Za-z0-9._%+\-]*{_AT}[A-Za-z0-9\-]+(?:{_DOT}[A-Za-z0-9\-]+)*{_DOT}[A-Za-z]{{2,}}", re.IGNORECASE)
_PREFIX = rf"(?:[+＋]?[(（]?[+＋]?(?:0086|86|００８６|８６)[)）]?{_S})?"
_MOBILE = re.compile(rf"{_NOD}{_PREFIX}[1１][3-9３-９]{_D}{_S}{_D}{{4}}{_S}{_D}{{4}}(?:\s?(?:转|ext\.?|分机)\s?{_D}{{1,6}})?{_END}")
_LANDLINE = re.compile(rf"(?<![0-9０-９A-Za-z_\-]){_PREFIX}(?:[(（][0０]{_D}{{2,3}}[)）]\s?|[0０]{_D}{{2,3}}[\-－\s]){_D}{{7,8}}(?:\s?(?:转|ext\.?|分机|-)\s?{_D}{{1,6}})?{_END}")
_ABROAD = re.compile(rf"(?<![0-9０-９A-Za-z_])(?:[+＋](?!86){_D}{{1,3}}(?:[\s\-]{_D}{{2,4}}){{1,4}}|[(（]{_D}{{3}}[)）]\s?{_D}{{3,4}}(?:[\s\-]{_D}{{4}})?){_END}")
_SPELLED = re.compile("(?<![一二三四五六七八九零〇幺])[一幺][三四五六七八九][一二三四五六七八九零〇幺]{9}(?![一二三四五六七八九零〇幺十百千])|(?<![一二三四五六七八九零〇幺])零[一二三四五六七八九零〇幺]{2,3}[\\-\\s]?[一二三四五六七八九零〇幺]{7,8}(?![一二三四五六七八九零〇幺])")
_ID18 = re.compile(rf"(?<![0-9０-９A-Za-z_\-])[1-9１-９]{_D}{{5}}{_S}{_D}{{8}}{_S}{_D}{{3}}[0-9０-９XxＸｘ](?![0-9０-９A-Za-z_])")
_ID15 = re.compile(rf"(?<![0-9０-９A-Za-z_\-])[1-9１-９]{_D}{{14}}(?![0-9０-９A-Za-z_])")
_PASSPORT = re.compile(r"(?<![0-9A-Za-z_\-])[A-Z]{1,2}\d{7,8}(?![0-9A-Za-z_])")
_NAMES = [re.compile(f"(?:{_NAME_START})({_ZH_NAME}){_ZH_STOP}"), re.compile(f"(?:{_EN_START})({_EN_NAME})"), re.compile(f"(?:{_NAME_START})\\s?({_EN_NAME})"), re.compile(f"({_ZH_NAME})(?=(?:{TITLES}))"), re.compile(f"(?:叫|姓名[:：=]?|本人|收件人|联系人[:：]?)([{_HAN}]{{2,3}})(?=[，；;（(\\s])"), re.compile(f"(?:^|\\n)({_ZH_NAME}|{_EN_NAME})(?=(?:您好|你好|，您))")]

# What a labeller looks for beside a span.
_LEFT_GOOD = {
    "PHONE": re.compile(r"(?:手机号?|电话|联系方式|号码|微信|tel|phone|致电|拨打|reach me at|call)[^，。;；\n]{0,6}$|[（(：:=\s]$", re.IGNORECASE),
    "ID_NUMBER": re.compile(r"(?:身份证号?码?|证件号?码?|护照号?|passport|ID)[^，。\n]{0,6}$|[，,]\s?$", re.IGNORECASE),
    "EMAIL": re.compile(r"(?:邮箱|邮件|发到|发送到|发至|e-?mail|mail|reach me at|or)[^，。\n]{0,6}$", re.IGNORECASE),
    "ADDRESS": re.compile(r"(?:住在?|地址|住址|房子在|位于|寄到|送到|家在|按|live at|address)[^，。\n]{0,4}$|[，,：:\s（(]$", re.IGNORECASE),
    "NAME": re.compile(r"(?:叫做?|姓名[:：=]?|名字[是:：]?|本人|收件人[:：]?|联系人[:：]?|的人是|妻子|丈夫|房东|昨天|我和|以|——\s?|name is |other side is |[（(])\s?$", re.IGNORECASE),
}
_LEFT_BAD = re.compile(r"(?:金额|流水|订单号?|编号(?:为|是)?|下载量有?|案号是?|合同(?:编号|号)|信用代码|会话|发票|单号|票据|流水号|chat_|工号|账单)[^，。；;\n]{0,4}$")
_RIGHT_BAD = re.compile(r"^\s?(?:元|万|次|号(?!码)|的收据|个|份|件|天|年|公里|人次|那天|%|某|公司|法院|派出所|委员会)")
_RIGHT_GOOD = {
    "PHONE": re.compile(r"^(?:[，。；;）)\s]|，晚上|$|or )"),
    "ID_NUMBER": re.compile(r"^(?:[，。；;）)\s]|被|$)"),
    "EMAIL": re.compile(r"^(?:[，。；;）)\s.]|$)"),
    "ADDRESS": re.compile(r"^(?:[，。；;）)\s.]|确定|$)"),
    "NAME": re.compile(r"^(?:[，。；;）)（(\s.,:]|$|的身份证|的名义|又来|是同事|留[的了]|[您你]好|已)"),
}
_WIDE = {ord("０") + i: str(i) for i in range(10)} | {ord("Ｘ"): "X", ord("ｘ"): "X", ord("x"): "X"}

_NUMBERED = (
    ("PHONE", re.compile(f"{_D}{{3}}|[一二三四五六七八九零〇幺]{{8}}"), (_MOBILE, _LANDLINE, _ABROAD, _SPELLED)),
    ("ID_NUMBER", re.compile(f"{_D}{{6}}"), (_ID18, _ID15, _PASSPORT)),
    ("ADDRESS", re.compile(f"{_D}(?:号|弄|栋|幢|座)"), (_ADDRESS,)),
    ("ADDRESS", re.compile(r"\d [A-Z][a-z]"), (_EN_ADDRESS,)),
)


def _digits(v: str) -> str:
    return re.sub(r"[^0-9X]", "", v.translate(_WIDE))


def _date_like(d: str) -> bool:
    return d.isdigit() and 1 <= int(d[4:6]) <= 12 and 1 <= int(d[6:8]) <= 31 and 1900 <= int(d[:4]) <= 2035


def _form(kind: str, v: str) -> str:
    """Vote on the value itself."""
    if kind == "ID_NUMBER":
        if v[0].isalpha():
            return "+"
        d = _digits(v)
        return "+" if (_date_like(d[6:14]) if len(d) == 18 else _date_like("19" + d[6:12])) else "-"
    if kind == "PHONE":
        d = _digits(v)
        return "+" if re.search(r"[\s\-.()（）+转－＋]", v) or len(d) != 11 else "0"
    if kind == "EMAIL":
        return "+"
    if kind == "ADDRESS":
        return "+" if len(re.findall("省|自治区|市|区|县|镇|乡|村|路|街|巷|道|胡同|号|弄|栋|幢|楼|室|单元|,", v)) >= 2 or v[0].isdigit() else "-"
    return "-" if any(s in v for s in STAND_INS) or "某" in v or v[-1] in "甲乙丙丁" else "0"


def _gazetteer(kind: str, v: str) -> str:
    if kind == "NAME":
        return "-" if any(s in v for s in STAND_INS) else "+" if v.startswith(DOUBLE_SURNAMES) or "·" in v or v[0] in SURNAMES or v[0].isascii() else "-"
    if kind == "ADDRESS":
        return "+" if re.search("省|自治区|市|区|县|镇|乡|小区|公寓|花园|苑|新村|Street|Lane|Road|Close|Avenue|路|街|巷|大道|胡同", v) else "0"
    if kind == "PHONE":
        d = _digits(v)
        return "+" if re.fullmatch(r"(?:0086|86)?1[3-9]\d{9}\d{0,6}|0\d{9,17}|\d{5,12}", d) or not d else "-"
    if kind == "ID_NUMBER":
        return "+" if v[0] in "123456789１２３４５６７８９GPEDS" else "0"
    return "+" if re.search(r"(?:com|net|org|cn|edu|gov|example|test|invalid)$", v, re.IGNORECASE) else "0"


def spans(text: str) -> list[tuple[str, int, int]]:
    """All proposed (kind, start, end), overlapping ones included."""
    out: set[tuple[str, int, int]] = set()
    # Cheap tests first: most messages hold no number that is long enough, and no house number.
    for kind, test, patterns in _NUMBERED:
        if test.search(text):
            for p in patterns:
                out.update((kind, m.start(), m.end()) for m in p.finditer(text))
    if "@" in text or "＠" in text or "at" in text.lower():
        out.update(("EMAIL", m.start(), m.end()) for m in _EMAIL.finditer(text))
    for p in _NAMES:
        at = 0
        while m := p.search(text, at):
            out.add(("NAME", m.start(1), m.end(1)))
            at = m.start() + 1
    return sorted(out, key=lambda s: (s[1], s[2], s[0]))


def vote_string(text: str, kind: str, a: int, b: int, others: list[tuple[str, int, int]]) -> str:
    left, right, v = text[max(0, a - 14) : a], text[b : b + 6], text[a:b]
    bad = _LEFT_BAD.search(left)
    greeted = kind == "NAME" and right[:2] in ("您好", "你好") and (not left or left[-1] in "\n>。！")
    return "".join(
        (
            _form(kind, v),
            _gazetteer(kind, v),
            "-" if bad else "+" if greeted or _LEFT_GOOD[kind].search(left) else "0",
            "-" if _RIGHT_BAD.match(right) else "+" if _RIGHT_GOOD[kind].match(right) else "0",
            "+" if any(k != kind and (b <= x <= b + 12 or y <= a <= y + 12) for k, x, y in others) else "0",
            "-" if bad or _RIGHT_BAD.match(right) else "0",
        )
    )


def _features(text: str, kind: str, a: int, b: int, votes: str) -> list[int]:
    base = KINDS.index(kind) * 20
    out = [base, 101 + KINDS.index(kind) * 8 + min(7, (b - a) // 4)]
    out += [base + 1 + 3 * i + "-0+".index(v) for i, v in enumerate(votes)]
    for n, s in ((1, text[max(0, a - 1) : a] or "^"), (2, text[max(0, a - 2) : a] or "^"), (3, text[b : b + 1] or "$"), (4, text[b : b + 2] or "$")):
        h = 2166136261 + n
        for c in kind + s:
            h = ((h ^ ord(c)) * 16777619) & 0xFFFFFFFF
        out.append(160 + h % (FEATURES - 160))
    return out


_SPAN = "array<struct<kind:string,a:int,b:int,votes:string,features:array<int>>>"


def propose(messages: DataFrame, everything: bool = False) -> DataFrame:
    """(msg_id, content, spans) of the messages in which anything is proposed, or of all."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("a", pa.int32()), ("b", pa.int32()), ("votes", pa.string()), ("features", pa.list_(pa.int32()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            rows = []
            for i, t in zip(ids, texts):
                found = spans(t) if t else []
                if found or everything:
                    one = []
                    for k, a, b in found:
                        v = vote_string(t, k, a, b, found)
                        one.append({"kind": k, "a": a, "b": b, "votes": v, "features": _features(t, k, a, b, v)})
                    rows.append((i, t, one))
            if rows:
                i, t, s = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(t, pa.string()), pa.array(s, kind)], names=["msg_id", "content", "spans"])

    src = messages.select(F.col("msg_id").cast("bigint").alias("msg_id"), F.col("content").cast("string").alias("content"))
    src = src if everything else src.where(F.length("content") > 0)
    return src.mapInArrow(run, f"msg_id bigint, content string, spans {_SPAN}")


def train(proposed: DataFrame) -> np.ndarray:
    """Weights of the span classifier, trained on the label model's posteriors."""
    flat = proposed.select("msg_id", F.explode("spans").alias("s")).select("msg_id", "s.*")
    counts: dict[str, dict[str, int]] = {k: {} for k in KINDS}
    for r in flat.groupBy("kind", "votes").count().collect():
        counts[r["kind"]][r["votes"]] = r["count"]
    post = {k: posteriors(c, PRIOR, trust=6.0, most_cases=0.98) for k, c in counts.items()}
    sample = flat.orderBy(F.xxhash64("msg_id", "a", "b", "kind"), "msg_id", "a", "b", "kind").limit(TRAIN_ROWS).select("kind", "votes", "features").collect()
    w = np.zeros(FEATURES)
    if not sample:
        return w
    x = np.array([r["features"] for r in sample])  # every span has the same number of features
    y = np.array([post[r["kind"]].get(r["votes"], 0.0) for r in sample])
    speed, l2 = np.zeros(FEATURES), 1e-3
    for _ in range(300):
        p = 1 / (1 + np.exp(-np.clip(w[x].sum(axis=1), -30, 30)))
        g = np.bincount(x.ravel(), np.repeat(p - y, x.shape[1]), FEATURES) / len(y) + l2 * w
        speed = 0.9 * speed - 0.9 * g
        w = w + speed
    return w


def choose(found: list[dict], weights: np.ndarray, least: float = 0.5) -> list[tuple[str, int, int, float]]:
    """Spans above the threshold, the best first where they overlap, in order of place."""
    scored = [(1 / (1 + np.exp(-float(weights[s["features"]].sum()))), s["b"] - s["a"], -s["a"], s) for s in found]
    out: list[tuple[str, int, int, float]] = []
    for p, _, _, s in sorted(scored, key=lambda x: (-round(x[0], 1), -x[1], -x[0], -x[2], x[3]["kind"])):
        if p >= least and all(s["b"] <= a or b <= s["a"] for _, a, b, _ in out):
            out.append((s["kind"], s["a"], s["b"], p))
    return sorted(out, key=lambda x: x[1])


def find_pii(messages: DataFrame) -> DataFrame:
    """(msg_id, pii_kind, pii_value): each distinct item of each message."""
    proposed = materialize(propose(messages), "pii-spans")
    weights = train(proposed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, t, s in zip(*(b.column(k).to_pylist() for k in range(3))):
                rows += sorted({(i, k, t[x:y]) for k, x, y, _ in choose(s, weights)})
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["msg_id", "pii_kind", "pii_value"])

    out = materialize(proposed.mapInArrow(run, "msg_id bigint, pii_kind string, pii_value string"), "pii-items")
    release(proposed)  # no message stays in the shared folder
    return out


def redact(messages: DataFrame) -> DataFrame:
    """(msg_id, content): every message, items replaced by [NAME], [PHONE], [ID_NUMBER], [EMAIL] or [ADDRESS]."""
    proposed = materialize(propose(messages, everything=True), "pii-spans")
    weights = train(proposed)

    def clean(t: str | None, found: list[dict]) -> str | None:
        for k, x, y, _ in reversed(choose(found, weights) if found else []):
            t = f"{t[:x]}[{k}]{t[y:]}"
        return t

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [clean(t, s) for t, s in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["msg_id", "content"])

    out = materialize(proposed.mapInArrow(run, "msg_id bigint, content string"), "pii-redacted")
    release(proposed)  # no personal data stays in the shared folder
    return out
