import math

import numpy as np
from pyspark.sql import functions as F

from lexweave.operators import prompt as P
from lexweave.operators import retrieve as R


def brute_bm25(texts, query):
    toks = [[c for c in (t or "") if not c.isspace()] for t in texts]
    n, avg = len(texts), sum(map(len, toks)) / len(texts)
    df = {}
    for t in toks:
        for c in set(t):
            df[c] = df.get(c, 0) + 1
    raw = {c: math.log(n - d + 0.5) - math.log(d + 0.5) for c, d in df.items()}
    mean = sum(raw.values()) / len(raw)
    idf = {c: v if v >= 0 else 0.25 * mean for c, v in raw.items()}
    out = []
    for t in toks:
        s = 0.0
        for c in query:
            if c in idf and not c.isspace():
                tf = t.count(c)
                s += idf[c] * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(t) / avg))
        out.append(round(s, 6))
    return out


def test_bm25_against_brute_force(spark):
    texts = ["借款合同 借款", "赔偿责任", None, "", "合同责任赔偿合同合同", "借 款"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    want = brute_bm25(texts, "借款 款责")
    got = R.bm25_top(d, "借款 款责", 10).collect()
    order = sorted(range(len(texts)), key=lambda i: (-want[i], i))
    assert [r.doc_id for r in got] == order and all(abs(r.score - want[r.doc_id]) < 1e-5 for r in got)


def test_bm25_without_matching_token(spark):
    d = spark.createDataFrame([(2, "甲"), (1, "乙")], "doc_id int, text string")
    assert [(r.doc_id, r.score, r["rank"]) for r in R.bm25_top(d, "zz", 5).collect()] == [(1, 0.0, 1), (2, 0.0, 2)]
    assert R.bm25_top(d.limit(0), "甲", 5).count() == 0


def test_bm25_of_many_questions_against_brute_force(spark):
    rng = np.random.default_rng(2)
    texts = ["".join(rng.choice(list("甲乙丙丁戊己庚辛 壬癸"), int(n))) for n in rng.integers(0, 60, 80)] + [None, "甲甲"]
    asked = [(7, "甲乙乙 子"), (8, "癸"), (9, ""), (10, None), (11, "子丑"), (None, "甲")]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    q = spark.createDataFrame(asked, "query_id int, question string")
    for block in (2, 1024):
        got = {}
        for r in R.bm25_top_batch(R.character_index(d), q, 5, block=block).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.doc_id, r.score))
        assert set(got) == {7, 8}
        for i, t in asked[:2]:
            want = brute_bm25(texts, t)
            order = sorted((i for i in range(len(texts)) if any(c in (texts[i] or "") for c in t if not c.isspace())), key=lambda i: (-want[i], i))[:5]
            assert [i for i, _ in got[i]] == order and all(abs(s - want[k]) < 1e-5 for k, s in got[i])
    assert R.bm25_top_batch(R.character_index(d.limit(0)), q).count() == 0 and R.bm25_top_batch(R.character_index(d), q.limit(0)).count() == 0


def test_vectors(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(40, 8)).astype("float32")
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(99, None)]
    d = spark.createDataFrame(rows, "vec_id int, embedding array<float>")
    dist = ((v.astype(float)[:, None] - v.astype(float)[None]) ** 2).sum(-1)
    one = R.vector_top(d, rows[3][1], 5).collect()
    assert [r.vec_id for r in one] == list(np.argsort(dist[3])[:5])
    many = R.vector_top_batch(d, d.where("vec_id % 10 = 0"), 4, block=2).collect()
    got = {}
    for r in many:
        got.setdefault(r.query_id, {})[r["rank"]] = r.vec_id
    assert {q: [x[i] for i in range(1, 5)] for q, x in got.items()} == {q: list(np.argsort(dist[q], kind="stable")[:4]) for q in (0, 10, 20, 30)}


def test_fusion_ties_representatives_and_repeats(spark):
    v = spark.createDataFrame([("A", 1, "v"), ("B", 2, "v")], "k string, rank int, x string")
    b = spark.createDataFrame([("B", 1, "b"), ("A", 2, "b"), ("C", 3, "b")], "k string, rank int, x string")
    got = R.rrf_fuse([v, b], ["k"], carry=["x"]).orderBy("rank").collect()
    assert [(r.k, round(r.rrf_score, 9), r.x) for r in got] == [("A", 0.032522475, "b"), ("B", 0.032522475, "b"), ("C", 0.015873016, "b")]
    twice = spark.createDataFrame([("A", 1), ("A", 2), ("B", 3)], "k string, rank int")
    assert R.rrf_fuse([twice], ["k"], k=1).first().k == "A"
    assert R.rrf_fuse([v.limit(0), b.limit(0)], ["k"]).count() == 0


def test_evidence_and_prompt(spark):
    d = spark.createDataFrame([(2, "s", None, "第二条", "乙"), (1, None, "c", "第一条", "甲")], "rank int, source string, chapter string, article_no string, text string")
    ctx = P.evidence(d).first().context
    assert ctx == "source= chapter=c article=第一条\\n原文片段：甲\\n\\nsource=s chapter= article=第二条\\n原文片段：乙"
    assert P.evidence(d.limit(0)).first().context == "无相关参考资料"
    p = spark.range(1).select(P.render(F.lit("C"), F.lit("Q"), F.lit("[用户] h")).alias("prompt"))
    assert p.first().prompt.endswith("C\n[用户] h\n问题：Q")
    assert P.answer(p).first().answer == p.first().prompt
    assert P.answer(p, lambda ps: [x[-1] for x in ps]).first().answer == "Q"
    assert P.preview(spark.createDataFrame([("a\nb" + "c" * 300,)], "text string")).first().preview == "a b" + "c" * 217


def test_document_key(spark):
    d = spark.createDataFrame([(None, "c", "1", "2", "t" * 130), ("", "c", "1", "2", "t" * 120)], "a string, b string, c string, d string, t string")
    keys = [r[0] for r in d.select(R.document_key(*(F.col(x) for x in "abcdt"))).collect()]
    assert keys[0] == keys[1]


def test_source_filter(spark):
    from lexweave.config import Config

    d = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "doc_id int, source string")
    assert [r.doc_id for r in R.by_source(d, Config(source_filter="a")).collect()] == [1]
    assert R.by_source(d).count() == 3


def test_vectors_of_many_dimensions(spark):
    v = np.random.default_rng(4).normal(size=(20, 300))
    d = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "vec_id int, embedding array<double>")
    got = [r.vec_id for r in R.vector_top(d, [float(x) for x in v[2]], 5).collect()]
    assert got == list(np.argsort(((v - v[2]) ** 2).sum(1))[:5])
