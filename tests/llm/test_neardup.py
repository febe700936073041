import random

import numpy as np
import pytest

from lexweave.llm import neardup as N
from lexweave.llm.grams import gram_hashes


def make(seed=1, groups=25, alone=150):
    random.seed(seed)
    pool = [chr(0x4E00 + i) for i in range(2500)]
    fresh = lambda n: "".join(random.choice(pool) for _ in range(n))
    stock = fresh(25)
    rows, group = [], {}
    for g in range(groups):
        base = [fresh(40) for _ in range(5)]
        for _ in range(random.choice([2, 3, 5])):
            parts = list(base)
            random.shuffle(parts)
            parts[0] = parts[0][:10] + fresh(4) + parts[0][14:]
            rows.append(f"第{len(rows)}条　" + "，".join(parts) + "。")
            group[len(rows) - 1] = g
    for _ in range(alone):
        rows.append(f"第{len(rows)}条　" + stock + fresh(150))
    rows += [rows[0].replace("第0条", "第九条").replace("，", "，\n"), rows[0]]
    group[len(rows) - 2] = group[len(rows) - 1] = group[0]
    want = {(a, b) for a in group for b in group if a < b and group[a] == group[b]}
    return rows, want


@pytest.mark.parametrize("hot", [False, True])
def test_pairs_against_the_planted_groups(spark, monkeypatch, hot):
    if hot:  # every mask counts as hot, so all groups are split into blocks
        monkeypatch.setattr(N, "MAX_GROUP", 2)
        monkeypatch.setattr(N, "SAMPLE", 1)
        monkeypatch.setattr(N, "COPIES", 1)
    rows, want = make()
    d = spark.createDataFrame([(i, t, 7) for i, t in enumerate(rows)], "chunk_id int, text string, id int")
    got = [(r.a, r.b) for r in N.duplicate_pairs(d).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_edited_copies_in_a_large_group(spark):
    """A third of all rows is one provision, each copy with a passage of its own inserted."""
    rng = np.random.default_rng(3)
    fresh = lambda n: "".join(map(chr, rng.integers(0x4E00, 0x4E00 + 2500, n)))
    base = fresh(280)
    at = rng.integers(0, 240, size=120).tolist()
    rows = [base[:i] + fresh(42) + base[i:] for i in at] + [fresh(250) for _ in range(240)]
    d = spark.createDataFrame(list(enumerate(rows)), "chunk_id int, text string")
    got = {(r.a, r.b) for r in N.duplicate_pairs(d).collect()}
    assert all(b < 120 for _, b in got) and len(got) >= 0.99 * 120 * 119 / 2


def edited(rng, c, kind):
    """A copy of an array of characters with edits of the given kind."""
    if kind.startswith("kept"):  # single characters replaced, all over the text
        c = c.copy()
        gone = rng.random(len(c)) >= int(kind[4:]) / 100
        c[gone] = rng.integers(0x4E00, 0x4E00 + 3000, gone.sum())
        return c
    at = int(rng.integers(0, len(c)))
    if kind == "inserted":
        return np.concatenate([c[:at], rng.integers(0x4E00, 0x4E00 + 3000, len(c) // 3), c[at:]])
    if kind == "scattered insertions":
        return np.insert(c, rng.integers(0, len(c), len(c) // 12), rng.integers(0x4E00, 0x4E00 + 3000, len(c) // 12))
    parts = np.array_split(c, 6)
    return np.concatenate([parts[i] for i in rng.permutation(6)])


@pytest.mark.parametrize("kind, least", [("kept90", 0.99), ("kept85", 0.97), ("kept80", 0.87), ("inserted", 0.99), ("scattered insertions", 0.98), ("reordered", 0.99)])
def test_recall_by_kind_of_edit(kind, least):
    """Pairs meet in a mask, stay within the radius and keep their share of characters."""
    rng = np.random.default_rng(4)
    ones = [rng.integers(0x4E00, 0x4E00 + 3000, int(rng.integers(150, 500))).astype(np.uint32) for _ in range(800)]
    twos = [edited(rng, c, kind).astype(np.uint32) for c in ones]
    starts = lambda ts: np.concatenate([[0], np.cumsum([len(t) for t in ts])])
    x, y = (N.sketches(np.concatenate(ts), starts(ts))[0] for ts in (ones, twos))
    spread = [N.sketches(np.concatenate(ts), starts(ts), spread=True)[0] for ts in (ones, twos)]
    f = np.concatenate([np.concatenate([N.fingerprints(s), N.fingerprints(p, N.SPREAD_PLANES)], axis=1) for s, p in zip((x, y), spread)])
    ok = np.zeros(800, dtype=bool)
    ok[N._near(np.arange(800), np.arange(800, 1600), list(f.T[: N.PLANES]), None, N.UNEQUAL)] = True
    ok &= N.likely(f, np.arange(800), np.arange(800, 1600))
    ok &= (N.masks(x) == N.masks(y)).any(axis=1)
    text = lambda c: "".join(map(chr, c))
    kept = [N.kept_share(N._grams(text(a)), N._grams(text(b))) >= N.SAME for a, b in zip(ones, twos)]
    assert np.mean(ok & kept) >= least, (np.mean(ok), np.mean(kept))


def test_one_passage_or_stock_phrases_are_no_copy():
    rng = np.random.default_rng(6)
    stock = [rng.integers(0x4E00, 0x4E00 + 3000, 15) for _ in range(20)]
    text = lambda *cs: N._grams("".join(map(chr, np.concatenate(cs))))
    fresh = lambda n: rng.integers(0x4E00, 0x4E00 + 3000, n)
    for _ in range(50):
        a, b = ([x for i in rng.permutation(20)[:8] for x in (stock[i], fresh(6))] for _ in range(2))
        assert N.kept_share(text(*a), text(*b)) < N.SAME
        one = fresh(130)
        assert N.kept_share(text(one, fresh(150)), text(fresh(150), one)) < N.SAME
        assert N.kept_share(text(one), text(one, one)) < N.SAME


def test_nodes_of_other_groups_are_pruned():
    """4,096 fingerprints below one mask: 64 groups of 64 close copies. Whole nodes go; every near pair stays."""
    rng = np.random.default_rng(9)
    centre = rng.integers(0, 1 << 16, (64, N.SLOTS))
    slots = np.repeat(centre, 64, axis=0)
    other = rng.random(slots.shape) < 0.02
    slots[other] = rng.integers(0, 1 << 16, other.sum())
    f = N.fingerprints(slots.astype(np.uint16))
    f = f[np.argsort(N.gray_rank(f[:, 0]), kind="stable")]
    count = {}
    zero = np.zeros(len(f), dtype=np.int64)
    a, b = N.group_pairs(zero, zero, f, count=count)
    everything = len(f) * (len(f) - 1) // 2
    assert len(a) >= 64 * 64 * 63 // 2 and sum(count.values()) < 0.6 * everything, count
    i, j = rng.integers(0, len(f), (2, 20000))
    got = set(zip(a.tolist(), b.tolist()))
    unlike = np.bitwise_count(np.bitwise_or.reduce(f[i] ^ f[j], axis=1))
    assert all((min(x, y), max(x, y)) in got for x, y, d in zip(i.tolist(), j.tolist(), unlike) if x != y and d <= N.UNEQUAL)


def test_classes(spark):
    rows, want = make(2, 6, 20)
    d = spark.createDataFrame(list(enumerate(rows)), "chunk_id int, text string")
    got = {r.id: r for r in N.duplicate_classes(d).collect()}
    least = {i: min([a for a, b in want if b == i] + [i]) for i in range(len(rows))}
    assert {i: r.class_id for i, r in got.items()} == least
    assert sum(r.links for i, r in got.items() if least[i] == i and not any(i in p for p in want)) == 0


def test_nulls_blanks_repeats_and_empty(spark):
    d = spark.createDataFrame([(1, None), (2, ""), (3, "。。 "), (4, "甲乙"), (5, "甲 乙"), (5, "甲 乙"), (None, "甲乙"), (6, "丙")], "chunk_id int, text string")
    assert [(r.a, r.b) for r in N.duplicate_pairs(d).collect()] == [(4, 5)]
    assert N.duplicate_pairs(d.limit(0)).count() == 0
    assert {r.id: r.class_id for r in N.duplicate_classes(d).collect()} == {4: 4, 5: 4, 6: 6}


def test_group_join_equals_all_pairs():
    rng = np.random.default_rng(5)
    slots = rng.integers(0, 1 << 16, (12, N.SLOTS))[rng.integers(0, 12, 480)]
    other = rng.random(slots.shape) < 0.1
    slots[other] = rng.integers(0, 1 << 16, other.sum())
    f = N.fingerprints(slots.astype(np.uint16))
    group, side = rng.integers(0, 5, size=len(f)), rng.integers(0, 2, size=len(f))
    side[group < 2] = 0
    order = np.lexsort((N.gray_rank(f[:, 0]), side, group))
    group, side, f = group[order], side[order], f[order]
    a, b = N.group_pairs(group, side, f, 12)
    got = {(min(x, y), max(x, y)) for x, y in zip(a.tolist(), b.tolist())}
    two = {g for g in range(5) if len(set(side[group == g])) == 2}
    unlike = np.bitwise_count(np.bitwise_or.reduce(f[:, None] ^ f[None], axis=2))
    want = {(i, j) for i in range(len(f)) for j in range(i + 1, len(f)) if group[i] == group[j] and (group[i] not in two or side[i] != side[j]) and unlike[i, j] <= 12}
    assert got == want and len(got) == len(a) > 500


def test_gray_neighbours_differ_in_one_bit():
    v = np.arange(64, dtype=np.uint64)
    code = v ^ (v >> np.uint64(1))
    assert (N.gray_rank(code) == v).all()


def test_gram_hashes_are_local():
    x = np.arange(50, dtype=np.uint32) % 7
    for n in (1, 4, 5, 8, 12, 18):
        h = gram_hashes(x, n)
        assert len(h) == 51 - n
        for i in range(len(h)):
            for j in range(len(h)):
                assert (h[i] == h[j]) == (x[i : i + n] == x[j : j + n]).all()
    assert len(gram_hashes(x[:3], 4)) == 0


def test_agreement_by_chance_makes_no_candidate():
    """Of unrelated fingerprints, whose slots agree by chance only, hardly any pair goes on to the comparison of texts."""
    rng = np.random.default_rng(11)
    f = rng.integers(0, 1 << 64, (1000, N.PLANES + N.SPREAD_PLANES), dtype=np.uint64)
    a, b = np.triu_indices(1000, 1)
    assert N.likely(f, a, b).sum() <= 5


def test_hot_groups_travel_once():
    """A group of some thousand rows is compared whole in one task, equal to all pairs; none of its rows is sent twice."""
    assert N.MAX_GROUP >= 10_000
    rng = np.random.default_rng(12)
    slots = rng.integers(0, 1 << 16, (3001, N.SLOTS))
    slots[:, :30] = np.where(rng.random((3001, 30)) < 0.7, slots[0, :30], slots[:, :30])
    f = N.fingerprints(slots.astype(np.uint16))
    f = f[np.argsort(N.gray_rank(f[:, 0]), kind="stable")]
    zero = np.zeros(len(f), dtype=np.int64)
    a, b = N.group_pairs(zero, zero, f)
    want = 0
    for i in range(len(f) - 1):
        want += int((np.bitwise_count(np.bitwise_or.reduce(f[i + 1 :] ^ f[i], axis=1)) <= N.UNEQUAL).sum())
    assert want == len(a) == len(set(zip(a.tolist(), b.tolist()))) and (a < b).all() and want > 10_000


def test_grams_of_a_batch_equal_those_of_single_texts():
    """Texts with repeats, too short ones and empty ones are prepared together; each occurrence keeps its number and place."""
    texts = ["甲乙丙甲乙丙甲乙丙", "", "甲", "甲乙", "甲乙丙", "丁" * 7]
    got = N._gram_sets(texts)
    for t, g in zip(texts, got):
        assert all((x == y).all() and len(x) == len(y) for x, y in zip(g, N._grams(t)))
        assert [t[p : p + 3] for p in g[4]] == sorted((t[i : i + 3] for i in range(len(t) - 2)), key=lambda x: g[1][t.index(x)])
    assert got[0][2].tolist() == [0, 0, 0, 1, 1, 1, 2] and got[5][2].tolist() == [0, 1, 2, 3, 4]
    assert N.kept_share(got[0], got[0]) == 1.0 and N.kept_share(got[4], got[0]) == 0.0


@pytest.mark.parametrize("hot", [False, True])
def test_masks_are_shuffled_in_parts(spark, monkeypatch, hot):
    """No stage shuffles the fingerprints of all tables, and all tables together still find every pair."""
    if hot:  # every group split into blocks, which meet pairwise in every part
        monkeypatch.setattr(N, "MAX_GROUP", 2)
        monkeypatch.setattr(N, "SAMPLE", 1)
    rows, want = make()
    chars, starts = N.bodies(rows)
    texts = ["".join(map(chr, chars[i:j])) for i, j in zip(starts[:-1], starts[1:])]
    d = spark.createDataFrame([(i, bytearray(t.encode())) for i, t in enumerate(texts)], "id bigint, body binary")
    sc = spark.sparkContext._jsc.sc()
    stages = lambda: sc.statusStore().stageList(None, False, False, spark._sc._gateway.new_array(spark._jvm.double, 0), spark._jvm.java.util.ArrayList())
    sc.listenerBus().waitUntilEmpty(30_000)
    known = {stages().apply(i).stageId() for i in range(stages().size())}
    got = {(r.a, r.b) for r in N.candidate_pairs(d).collect()}
    sc.listenerBus().waitUntilEmpty(30_000)
    after = stages()
    sent = [x.shuffleWriteRecords() for x in map(after.apply, range(after.size())) if x.stageId() not in known]
    assert want <= got
    if not hot:
        assert 0 < max(sent) <= len(rows) * N.TABLES // 2


def test_parts_of_the_tables_are_all_of_them(spark):
    d = spark.createDataFrame([(7, list(range(N.TABLES)), bytearray(b"x"))], "id bigint, masks array<bigint>, fp binary")
    edges = [N.TABLES * k // N.PASSES for k in range(N.PASSES + 1)]
    got = [r["mask"] for i, j in zip(edges, edges[1:]) for r in N._masked(d, i, j).collect()]
    assert got == [r["mask"] for r in N._masked(d).collect()] == list(range(N.TABLES))
