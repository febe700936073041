import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from lexweave.llm import split, unify


def pieces(spark, rows, **kw):
    d = spark.createDataFrame(rows, "chunk_id int, text string, article_no string, piece_no int")
    return split.split_texts(d, **kw).orderBy("chunk_id", "piece_no").collect()


def check(rows, texts, limit, overlap):
    by = {}
    for r in rows:
        by.setdefault(r.chunk_id, []).append(r)
    for i, t in texts.items():
        if not t:
            assert i not in by
            continue
        whole = ""
        for n, r in enumerate(by[i], 1):
            assert r.piece_no == n and len(r.piece_text) <= limit and r.overlap_chars <= overlap
            assert t[r.piece_start : r.piece_start + len(r.piece_text)] == r.piece_text
            whole += r.piece_text[r.overlap_chars :]
        assert whole == t and (len(by[i]) > 1) == (len(t) > limit)


def test_split_round_trip_and_limits(spark):
    random.seed(4)
    alphabet = "甲乙丙丁𠮷é́ ，。；！\n\r\n\r\nab1."
    texts = {i: "".join(random.choice(alphabet) for _ in range(random.choice([1, 59, 60, 61, 130, 500]))) for i in range(60)}
    texts |= {100: None, 101: "", 102: "甲" * 700, 103: "\r\n" * 200, 104: "á" * 200, 105: "𠮷" * 61}
    rows = [(i, t, "第一条", 9) for i, t in texts.items()] * 1
    got = pieces(spark, rows, limit=60, overlap=15)
    check(got, texts, 60, 15)
    assert {r.article_no for r in got} == {"第一条"} and {r.input_piece_no for r in got} == {9}
    for r in got:
        if r.chunk_id == 103 and r.piece_no > 1:
            assert not r.piece_text[r.overlap_chars :].startswith("\n")
        if r.chunk_id == 104:
            assert not r.piece_text[r.overlap_chars :].startswith("́")


def test_split_prefers_strong_boundaries(spark):
    t = "甲" * 30 + "。" + "乙" * 20 + "\n" + "丙" * 5 + "，" + "丁" * 60
    got = pieces(spark, [(1, t, None, 1)], limit=60, overlap=0)
    assert [r.piece_text for r in got][0] == "甲" * 30 + "。" + "乙" * 20 + "\n"
    assert pieces(spark, [(1, t, None, 1)][:0], limit=60, overlap=0) == []


def test_split_overlap_starts_at_a_sentence(spark):
    t = ("一二三四五六七八九。" * 20)[:-1]
    got = pieces(spark, [(1, t, None, 1)], limit=60, overlap=25)
    assert all(r.piece_text.startswith("一") and r.overlap_chars == 20 for r in got[1:])


def test_split_overlap_is_long_before_it_is_strong(spark):
    t = "甲" * 30 + "，" + "乙" * 12 + "。" + "丙" * 4 + "。" + "丁" * 60
    got = pieces(spark, [(1, t, None, 1)], limit=60, overlap=24)
    assert got[1].piece_text.startswith("乙") and got[1].overlap_chars == 18  # not just the last short sentence


def test_split_of_a_very_long_text(spark):
    random.seed(5)
    t = "".join(random.choice("甲乙丙丁戊己庚辛，。\n") for _ in range(400_000))
    got = pieces(spark, [(1, t, None, 1)], limit=600, overlap=150)
    check(got, {1: t}, 600, 150)


FAKES = {
    "第ー千二〸条 甲": "第一千二十条　甲",
    "债权⼈应当在⼆十日": "债权人应当在二十日",
    "按照２０５0元": "按照2050元",
    "达到РМ值，使用КМ 300": "达到PM值，使用KM 300",
    "São Вrela": "São Brela",
    "Lünt规则": "Lünt规则",
    "审计​机构﻿": "审计机构",
    "人カ资源": "人力资源",
    "行年": "行年",
    "达到Αxо库": "达到Axo库",
    "Χ光": "X光",
    "第ニ○四条": "第二〇四条",
    "⻓期": "长期",
    "甲　乙": "甲 乙",
    "（ー）拒绝": "（一）拒绝",
}
FAKES |= {
    "\u212aelvin": "Kelvin",
    "ℳode": "Mode",
    "第Ⅷ级": "第VIII级",
    "ⅰ": "i",
    "ɡood": "good",
    "pӏan": "plan",
    "օk": "ok",
    "Ꭺbc": "Abc",
    "甲\U0001bca0乙": "甲乙",
    "ﬁle": "file",
    "𝟛号": "3号",
    "ｶﾞｽ": "ガス",
}
PLAIN = ["第一条　甲乙，丙（丁）。\r\n", "《Договор о переправах》", "《Акт о реках》", "α射线、β系数", "㎡与①和℃", "𠮷棠𣲙塘", "データ", "Zérah Ørsel São", "二〇四", "half, width; 1%", "", "ー", "300 \u212a", "5ℓ", "10Ω与m²", "№ 3、½、⑴ ㈠ Ⓐ", "…，％（A）～", "ŀla ĳs", "ภาษาไทยน้ำ", "ㅋㅋ", "Հայերեն", "ᏣᎳᎩ", "ϑ", "[ɡʊd]", "ℝ", "السلام"]


def test_ordinary_forms():
    assert {k: unify.ordinary(k) for k in FAKES} == FAKES
    assert [unify.ordinary(t) for t in PLAIN] == PLAIN


@settings(max_examples=300, deadline=None, suppress_health_check=[HealthCheck.too_slow])
@given(st.text())
def test_ordinary_is_idempotent(t):
    once = unify.ordinary(t)
    assert unify.ordinary(once) == once


def test_changed_values_and_keys(spark):
    rows = [(i, k, None) for i, k in enumerate(FAKES)] + [(100 + i, p, "第1‌2条") for i, p in enumerate(PLAIN)] + [(200, None, "")]
    d = spark.createDataFrame(rows, "chunk_id int, text string, article_no string").selectExpr("*", "'x' as ordinary", "'y' as field_name")
    got = {(r.chunk_id, r.field_name): r.ordinary for r in unify.changed_values(d, "chunk_id", ["text", "article_no"]).collect()}
    want = {(i, "text"): v for i, v in enumerate(FAKES.values())} | {(100 + i, "article_no"): "第12条" for i in range(len(PLAIN))}
    assert got == want
    u = {r.chunk_id: r.text for r in unify.unify(d, ["text"]).collect()}
    assert u[200] is None and u[0] == list(FAKES.values())[0] and u[100] == PLAIN[0]
    assert unify.changed_values(d.limit(0), "chunk_id", ["text"]).count() == 0
    assert unify.comparison_key("ＡＢＣ ß") == unify.comparison_key("abc SS")
