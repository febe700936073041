from lexweave.llm import pairs as P
from lexweave.llm import pii
from lexweave.llm.labelmodel import best_cutoff, posteriors

CASES = {
    "对方叫祁菡苒，手机154.2244.1234，请问怎么办？": {("NAME", "祁菡苒"), ("PHONE", "154.2244.1234")},
    "收件人屈澈昕 0609-2360476转697 望梧市岚西县青砚街63号汀花公寓10号楼3单元301\n老板不给钱": {("NAME", "屈澈昕"), ("PHONE", "0609-2360476转697"), ("ADDRESS", "望梧市岚西县青砚街63号汀花公寓10号楼3单元301")},
    "本人蒙骁，身份证号239716 19731115 5328。": {("NAME", "蒙骁"), ("ID_NUMBER", "239716 19731115 5328")},
    "我的邮箱是a.b+c (at) example.com，微信同手机号一五四七八九六九五七五。": {("EMAIL", "a.b+c (at) example.com"), ("PHONE", "一五四七八九六九五七五")},
    "My name is Ysolde H. Morwick. I live at 215 Saltmarsh Lane, Ostwick 00436. Call (555) 0177": {("NAME", "Ysolde H. Morwick"), ("ADDRESS", "215 Saltmarsh Lane, Ostwick 00436"), ("PHONE", "(555) 0177")},
    "假设张三打了李四，涉案金额15446602463元，订单号203999462646597552，案号是（2023）云岚03民初8742号": set(),
    "法院在柏岭市，王某和陈某都在场，合同编号HT-832728352": set(),
    "": set(),
}


def messages(spark, n=40):
    rows, i = [], 0
    for _ in range(n):
        for t in CASES:
            rows.append((i, t))
            i += 1
    return spark.createDataFrame(rows + [(i, None)], "msg_id int, content string")


def test_items_found_and_replaced(spark):
    m = messages(spark).selectExpr("*", "1 as spans", "'x' as pii_kind")
    got = {}
    for r in pii.find_pii(m).collect():
        got.setdefault(r.msg_id, set()).add((r.pii_kind, r.pii_value))
    texts = {r.msg_id: r.content for r in m.collect()}
    for i, t in texts.items():
        assert got.get(i, set()) == CASES.get(t, set()), t
    clean = {r.msg_id: r.content for r in pii.redact(m).collect()}
    assert len(clean) == len(texts) and clean[0] == "对方叫[NAME]，手机[PHONE]，请问怎么办？"
    assert clean[max(texts)] is None and clean[5] == texts[5] and clean[7] == ""
    assert pii.find_pii(m.limit(0)).count() == 0 and pii.redact(m.limit(0)).count() == 0


def test_no_message_stays_behind(spark, tmp_path, monkeypatch):
    from lexweave import runtime

    monkeypatch.setattr(runtime, "shared_dir", lambda spark: tmp_path.as_uri())
    m = messages(spark)
    left = lambda: sorted(p.name.rsplit("-", 1)[0] for p in (tmp_path / "lexweave").iterdir())
    clean = pii.redact(m)
    assert left() == ["pii-redacted"] and not any("154.2244.1234" in (r.content or "") for r in clean.collect())
    pii.find_pii(m)
    assert left() == ["pii-items", "pii-redacted"]
    runtime.clear_written(spark)
    assert left() == []


def test_label_model_finds_reliabilities():
    import random

    random.seed(1)
    counts = {}
    truth = {}
    for _ in range(20000):
        y = random.random() < 0.1
        v = "".join(random.choices("+-0", (a if y else b, b if y else a, 20))[0] for a, b in ((70, 10), (60, 20), (55, 5)))
        counts[v] = counts.get(v, 0) + 1
        truth[v] = truth.get(v, 0) + y
    post = posteriors(counts, 0.1)
    assert abs(post["+++"] - truth["+++"] / counts["+++"]) < 0.15 and post["---"] < 0.05
    assert posteriors({}) == {} and best_cutoff([]) == 0.5
    assert 0.55 < best_cutoff([(0.9, 10, True), (0.6, 5, True), (0.55, 8, False), (0.1, 100, False)]) <= 0.6


QUESTION = "房东一直不退押金，该去哪个部门投诉？"
GOOD = "建议您先整理合同，再向司法所提出书面申请。需要注意，收据最好保留原件，并做一份备份。"
ANSWERS = {
    "empty": ["", " \n", "无", "null", "<br>", "```\n```", "​", "……", None],
    "refusal": ["抱歉，我无法回答这个问题。", "这个问题超出了我能处理的范围。", "I'm sorry, but I can't help with that request."],
    "copy": [QUESTION, "问：" + QUESTION, QUESTION + " " + QUESTION],
    "language": ["First collect the papers. Then file the short form with the board; it depends on the contract.", "Die Kosten hängen vom Fall ab. Bewahren Sie die Originale auf."],
    "truncated": [GOOD + "若对方已经搬走了，举证责任的分配会对", GOOD + "\n3. ", GOOD[:-1] + "，但是"],
    None: [GOOD, GOOD + "\n希望能帮到您", "针对您提到的“" + QUESTION + "”，说明如下。\n" + GOOD, "抱歉让您久等了，下面逐条说明。" + GOOD, GOOD + "\n附：In the event of default the lessee shall pay all sums due."],
}


def chat(spark, n=60):
    rows, want = [], {}
    for _ in range(n):
        for kind, answers in ANSWERS.items():
            for a in answers if kind else answers * 12:
                i = len(rows)
                rows += [(i, "hot", i, "human", QUESTION), (i + 1, "hot", i + 1, "assistant" if i % 3 else "ai", a)]
                want[i + 1] = kind
    rows.append((rows[0][0] + 10**6, "hot", 0, "human", QUESTION))
    rows += [(10**7, None, 0, "ai", GOOD), (10**7 + 1, "x", 5, None, GOOD), (10**7 + 2, "x", 9, "ai", "")]
    want[10**7 + 2] = "empty"
    return spark.createDataFrame(rows, "msg_id bigint, session_id string, pos bigint, type string, content string"), want


def test_defects(spark):
    m, want = chat(spark)
    got = {r.msg_id: r.defect for r in P.found_defects(m).collect()}
    texts = {r.msg_id: r.content for r in m.collect()}
    wrong = {(texts[i], w, got.get(i)) for i, w in want.items() if got.get(i) != w}
    assert not wrong and set(got) <= set(want)
    assert P.found_defects(m.limit(0)).count() == 0


def test_planted_defects_are_found(spark):
    m, _ = chat(spark)
    p = P.answer_pairs(m).cache()
    shapes = P.finished_shapes(p)
    model = P.defect_model(P.voted(p, shapes), P.voted(P.planted_defects(p), shapes, ("planted",)))
    rows = P.voted(P.planted_defects(p), shapes, ("planted",)).collect()
    for k in P.PRECEDENCE:
        post, cut = model[k]
        cases = [r for r in rows if r.planted == k]
        assert 0.3 <= cut <= 0.9 and len(cases) > 100
        if k != "truncated":  # cut where it happens to end well, an answer is not truncated
            assert sum(post.get(r[k], 1) >= cut for r in cases) >= 0.95 * len(cases), k


def test_long_copies_follow_the_same_rule(spark):
    long = "".join(f"第{i}份合同的押金为什么没有退还，应当找谁？" for i in range(20))
    near = "另" + long[:100] + "改" + long[101:250] + "动" + long[251:]
    rows = []
    for i in range(0, 600, 2):
        rows += [(i, "s", i, "human", long), (i + 1, "s", i + 1, "ai", near if i % 60 == 0 else long if i % 60 == 30 else GOOD)]
    got = {r.msg_id: r.defect for r in P.found_defects(spark.createDataFrame(rows, "msg_id bigint, session_id string, pos bigint, type string, content string")).collect()}
    assert got == {i + 1: "copy" for i in range(0, 600, 30)}


def test_asked_language(spark):
    en = "First collect the papers. Then file the short form with the board; it depends on the contract."
    rows = []
    for i in range(0, 400, 2):
        rows += [(i, "s", i, "human", "请用英文回答：" + QUESTION), (i + 1, "s", i + 1, "ai", en if i % 40 else GOOD)]
    got = {r.msg_id for r in P.found_defects(spark.createDataFrame(rows, "msg_id bigint, session_id string, pos bigint, type string, content string")).collect()}
    assert got == {i + 1 for i in range(0, 400, 40)}


def test_every_answer_is_planted_and_counts_equal_the_rows(spark):
    from collections import Counter

    m, _ = chat(spark, 40)
    p = P.answer_pairs(m).cache()
    shapes = P.finished_shapes(p)
    many = p.where("question is not null and length(answer) > 60 and length(question) > 8").count()
    rows = Counter((r.planted, *(r[k] for k in P.PRECEDENCE)) for r in P.voted(P.planted_defects(p), shapes, ("planted",)).collect())
    assert many > 1000 and sum(rows.values()) == 6 * many
    counted = Counter()
    for r in P.planted_votes(p, shapes).collect():
        counted[(r.planted, *(r[k] for k in P.PRECEDENCE))] += r.cases
    assert counted == Counter({k: n for k, n in rows.items() if k[0]})
