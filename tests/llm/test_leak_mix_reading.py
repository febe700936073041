import random

import numpy as np
import pyarrow as pa
import pytest

from lexweave.llm import leak, mix, reading
from lexweave.llm.grams import gram_hashes, letters_only


def sentence(rng, n=40):
    return "".join(chr(0x4E00 + rng.randrange(1500)) for _ in range(n))


def test_leaks_against_brute_force(spark):
    rng = random.Random(3)
    items = [(i, sentence(rng, 90), sentence(rng, 80)) for i in range(40)] + [(40, None, ""), (41, "What must a tenant prove before the deposit is returned by the landlord in full?", "The tenant shows the contract and the receipt.")]
    docs = []
    for k in range(160):
        i = rng.randrange(40)
        q, a = items[i][1:]
        body = {0: q, 1: q[:60], 2: q[:20], 3: "\n".join(a[x : x + 10] for x in range(0, 80, 10)), 4: q[:45] + sentence(rng, 30) + q[45:], 5: q[:30] + "甲" + q[31:60] + "乙" + q[61:], 6: ""}[k % 7]
        docs.append((k, sentence(rng, 700) + body + sentence(rng, 500)))
    docs += [(500, None), (501, ""), (502, "WHAT must a tenant\n\nprove before the Deposit is returned by the landlord?"), (0, docs[0][1])]
    d = spark.createDataFrame(docs, "doc_id int, text string").selectExpr("*", "1 as item_id")
    it = spark.createDataFrame(items, "item_id int, question string, answer string")
    got = sorted((r.doc_id, r.item_id) for r in leak.leaked_items(d, it).collect())
    want = []
    for k, t in docs:
        text = "".join(c for c in (t or "").lower() if c.isalnum())
        for i, *sides in items:
            best = 0.0
            for side in sides:
                own, n = "".join(c for c in (side or "").lower() if c.isalnum()), leak.CHECK[i == 41]
                held = {x + j for x in range(len(own) - n + 1) if own[x : x + n] in text for j in range(n)}
                best = max(best, len(held) / max(1, len(own)))
            if best >= leak.HELD:
                want.append((k, i))
    assert got == sorted(want) and len(got) > 80
    assert leak.leaked_items(d.limit(0), it).count() == 0 and leak.leaked_items(d, it.limit(0)).count() == 0


@pytest.mark.parametrize("size", [400, 1000, 3000, 10_000])
def test_long_and_scattered_items(size):
    rng = random.Random(size)
    q, a = sentence(rng, 60), sentence(rng, size)
    ix = leak.ItemIndex([(7, q, a)] + [(100 + i, sentence(rng, 80), sentence(rng, 80)) for i in range(50)])
    scattered = "".join(a[x : x + 20] + sentence(rng, 300) for x in range(0, size, 20))
    half = sentence(rng, 5000) + a[size // 3 : size // 3 + size * 11 // 20] + sentence(rng, 5000)
    few = "".join(c if rng.random() > 0.01 else "囗" for c in a[: size * 3 // 5])
    none = sentence(rng, 3000) + a[: size // 4] + sentence(rng, 3000)
    got = ix.match([sentence(rng, 500) + a + sentence(rng, 500), scattered, half, few, none])
    assert [g[:2] for g in got] == [(0, 0), (1, 0), (2, 0), (3, 0)]


def test_recall_of_retrieval_under_edits():
    """Items held to 60 % with some characters changed: nearly all are found; held to 30 %: none."""
    rng = random.Random(12)
    items = [(i, sentence(rng, rng.randrange(60, 200)), sentence(rng, rng.randrange(60, 200))) for i in range(200)]
    ix = leak.ItemIndex(items)

    def part(t, share, changed):
        x = rng.randrange(len(t) - int(len(t) * share) + 1)
        own = list(t[x : x + int(len(t) * share)])
        for _ in range(changed):
            own[rng.randrange(len(own))] = "囗"
        return sentence(rng, 400) + "".join(own) + sentence(rng, 400)

    for share, changed, least, most in ((1.0, 3, 0.99, 1), (0.6, 0, 0.99, 1), (0.6, 1, 0.9, 1), (0.3, 0, 0, 0)):
        hit = {(d, i) for d, i, *_ in ix.match([part(t[1 + i % 2], share, changed) for i, t in enumerate(items)])}
        assert least <= sum((i, i) in hit for i in range(200)) / 200 <= most, (share, changed)
        assert len(hit) <= 202


def test_index_is_linear_and_closed_blocks_stay_unread():
    import pickle

    rng = random.Random(13)
    items = [(i, sentence(rng, 85), sentence(rng, 85)) for i in range(2000)]
    small, large = (len(pickle.dumps(leak.ItemIndex(items[:n]))) for n in (1000, 2000))
    assert large < 2.1 * small and large / (2000 * 170) < 60
    ix = leak.ItemIndex(items)
    ix.match(["".join(t[1][:8] for t in items[:800:8]) + items[5][1]])
    assert ix.read < 150, ix.read  # a hundred blocks have terms in the text, one is read


def test_index_in_blocks_gives_the_same(spark, monkeypatch):
    rng = random.Random(4)
    items = [(i, sentence(rng, 50), sentence(rng, 50)) for i in range(30)]
    docs = [(i, sentence(rng, 200) + items[i % 30][1]) for i in range(60)]
    d, it = spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(items, "item_id int, question string, answer string")
    one = sorted((r.doc_id, r.item_id) for r in leak.leaked_items(d, it).collect())
    monkeypatch.setattr(leak, "MAX_INDEX_CHARS", 1000)
    assert one == sorted((r.doc_id, r.item_id) for r in leak.leaked_items(d, it).collect()) == [(i, i % 30) for i in range(60)]


def test_flight_keeps_balance():
    rng = np.random.default_rng(2)
    x, pi = rng.integers(5, 900, size=700), np.full(700, 0.37)
    p = mix.flight(x, pi, 1)
    left = (p > 0) & (p < 1)
    assert left.sum() <= 2
    assert abs(p.sum() - pi.sum()) < 1e-4 and abs((p * x).sum() - (pi * x).sum()) < 1e-2
    hits = np.mean([mix.flight(x[:9], np.full(9, 0.3), s) for s in range(3000)], axis=0)
    assert abs(hits - 0.3).max() < 0.05  # every document keeps its probability
    same = mix.flight(np.full(50, 7), np.full(50, 0.5), 3)
    assert ((same > 0) & (same < 1)).sum() <= 2


def corpus(spark):
    rng = random.Random(6)
    rows = []
    for k in range(1500):
        s = rng.choices(["Big_Source", "big-source ", "mid", "small", "unasked", None], (40, 10, 25, 5, 15, 5))[0]
        rows.append((k, "".join(rng.choice("abcdefgh 甲乙丙丁") for _ in range(rng.randrange(10, 120))), s))
    rows += [(5000 + i, rows[i][1], rows[i][2]) for i in range(50)] + [(9000, None, "mid"), (9001, "  ", "mid"), (None, "x", "mid")]
    return spark.createDataFrame(rows, "doc_id int, text string, source string").selectExpr("*", "1 as tokens", "2 as copies")


@pytest.mark.parametrize("block", [64, 4096])
def test_mix_reaches_its_shares(spark, monkeypatch, block):
    monkeypatch.setattr(mix, "BLOCK", block)
    d = corpus(spark)
    t = spark.createDataFrame([("big_source", 0.5, 1), ("mid", 0.3, 2), ("small", 0.15, 4), ("nothing", 0.05, 3)], "source string, target_share double, max_repeats int")
    rep = {r.source: r for r in mix.mix_report(d, t).collect()}
    assert rep["nothing"].used_tokens == 0 and rep["nothing"].actual_share == 0
    for s in ("big_source", "mid", "small"):
        assert abs(rep[s].actual_share - rep[s].target_share / 0.95) < 0.01
        assert rep[s].most_copies <= rep[s].max_repeats
    got = mix.mix_sources(d, t).collect()
    assert len({r.doc_id for r in got}) == len(got) and not any(r.doc_id >= 5000 for r in got)
    assert all(r.copies <= rep[r.source].max_repeats for r in got)


def test_mix_caps_and_empty(spark):
    d = corpus(spark)
    t = spark.createDataFrame([("mid", 0.5, 1), ("small", 0.5, 2)], "source string, target_share double, max_repeats int")
    rep = {r.source: r for r in mix.mix_report(d, t, total_tokens=10**9).collect()}
    assert all(r.cap_reached and r.used_tokens == r.available_tokens * r.max_repeats for r in rep.values())
    rep = {r.source: r for r in mix.mix_report(d, t, mix.AVAILABLE).collect()}
    total = sum(r.available_tokens for r in rep.values())
    assert rep["small"].cap_reached and rep["small"].actual_share < 0.5 and rep["small"].used_tokens == 2 * rep["small"].available_tokens
    assert abs(rep["mid"].used_tokens - total / 2) < 200
    assert mix.mix_sources(d.limit(0), t).count() == 0
    assert mix.mix_sources(d, t.limit(0)).count() == 0 and mix.mix_report(d, t.limit(0)).count() == 0


def test_token_counts_are_exact(spark):
    import tiktoken  # noqa: F401

    enc = mix.encoder(mix.TOKENIZER)
    texts = ["Hello world, it's 3.14", "合同 responsibilities\n\n", "<|endoftext|>", ""]
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in d.select(mix.token_count(d["t"])).collect()] == [len(enc.encode_ordinary(t)) for t in texts]
    assert [enc.decode(enc.encode_ordinary(t)) for t in texts] == texts


def graded(spark, n=600):
    rng = random.Random(8)
    words = [[sentence(rng, 6) for _ in range(60)] for _ in range(5)]
    rows, level = [], {}
    for k in range(n):
        lv = rng.randrange(5)
        near = [words[min(4, max(0, lv + rng.choice([-1, 0, 0, 0, 1])))] for _ in range(40)]
        rows.append((k, "，".join(rng.choice(w) for w in near)))
        level[k] = lv + 1
    labels = [(k, level[k], "a") for k in range(0, n, 5)] + [(0, None, "b"), (5, level[5], "b"), (10**6, 3, "a"), (1, 99, "a")]
    return spark.createDataFrame(rows + [(7000, None), (7001, " \n"), (7002, "?"), (0, rows[0][1])], "doc_id int, text string"), spark.createDataFrame(labels, "doc_id int, reading_level int, rater string"), level


def test_reading_levels_on_held_out_grades(spark):
    d, labels, level = graded(spark)
    got = {r.doc_id: r.reading_level for r in reading.reading_levels(d.selectExpr("*", "1 as grade", "2 as nodes"), labels).collect()}
    held = [k for k in level if k % 5]
    assert set(got) == set(level) | {7002} and set(got.values()) <= {1, 2, 3, 4, 5}
    assert np.mean([got[k] == level[k] for k in held]) > 0.85 and max(abs(got[k] - level[k]) for k in held) <= 2


def test_reading_without_grades_or_documents(spark):
    d, labels, _ = graded(spark, 20)
    assert {r.reading_level for r in reading.reading_levels(d, labels.limit(0)).collect()} == {None}
    assert reading.reading_levels(d.limit(0), labels).count() == 0
    assert [len(reading.decoded(pa.array([x], pa.binary()))[0]) for x in reading.word_nodes(["abc abc", "", "甲乙丙丁戊己", "甲乙丙丁戊己"])] == [4, 0, 2, 2]


def test_coded_nodes_come_back():
    rng = np.random.default_rng(3)
    texts = [np.unique(rng.integers(0, 1 << 20, n)) for n in (0, 1, 3, 5000, 0, 40)] + [np.array([0]), np.array([65534, 65535, 131070, 200000])]
    cut = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    blobs = reading.coded(np.concatenate(texts), cut)
    nodes, doc = reading.decoded(pa.array(blobs, pa.binary()))
    assert [nodes[doc == i].tolist() for i in range(len(texts))] == [t.tolist() for t in texts]


def test_sums_do_not_depend_on_the_number_of_tasks(spark):
    from lexweave.llm import sums

    def run(batches):
        total = np.zeros((2, 40_000))
        for b in batches:
            total[1, b.column(0).to_numpy()] += 1
        yield from sums.parts(total)

    for tasks in (1, 150):
        got = sums.add_up(spark.range(0, 40_000, 1, tasks), run, (2, 40_000))
        assert (got[0] == 0).all() and (got[1] == 1).all()
    assert (sums.add_up(spark.range(0), run, (2, 40_000)) == 0).all()


def test_reading_ends_when_words_stand_still(spark):
    d, labels, level = graded(spark, 300)
    one = {r.doc_id: r.reading_level for r in reading.reading_levels(d, labels, tolerance=10.0).collect()}
    many = {r.doc_id: r.reading_level for r in reading.reading_levels(d, labels, nodes=1 << 12).collect()}
    assert set(one) == set(many) and np.mean([many[k] == level[k] for k in level]) > 0.85
