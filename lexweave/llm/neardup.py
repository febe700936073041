"""Near-duplicate texts: the same or edited copies, wherever the edits stand.

Bodies: the ordinary form of a text without its leading article label, letters and digits only, case-folded. Rows of
equal body are exact copies and are represented by their lowest id from then on.

Method, a Gray-order hierarchical index over groups that share a masked bit pattern:
1. Fingerprints. The pairs of neighbouring characters of a body, repeats counted, are drawn into SLOTS independent
   minima. All weigh the same, so two texts agree in a slot as often as their pairs do, however many other texts share
   them. PLANES bits of the first 64 slots make the fingerprint, one word for each plane. SPREAD_PLANES words more come from
   64 minima over spread grams: two such pairs APART places from one another, which stock phrases do not share.
2. Masks. WIDTH slots are a masked bit pattern; fingerprints that share one stand below the same top node. Below it
   they are sorted by Gray rank, every FAN neighbours are factored into a node that keeps the bits they all
   share, FAN nodes into an upper node and so on.
3. Search. The hierarchy is joined with itself from the top. Over the bits that both nodes share the differing slots
   are accumulated plane by plane; a pair of nodes is dropped with everything below it once they exceed UNEQUAL. Of the
   pairs of leaves left those stay that differ in few slots (SURE), or in not too many of the spread ones (SPREAD).
4. Verification. Of the candidates the characters in common are counted: the 3-grams of the longer body found in the
   other, and where that leaves a doubt only those on diagonals with enough in common. Their share must reach SAME.

What prunes: the masks do most of the search, as the radius must be wide (copies with a fifth of their characters
replaced differ in half of all slots). Nodes of different groups of copies are dropped whole; unrelated
fingerprints share too few bits for that and are dropped at the leaves.

Scale: bodies are shuffled once to merge exact copies, ids, masks and fingerprints TABLES times, and the bodies of
candidates once a side for verification. Masks are joined in PASSES, so that only a part of those copies of the fingerprints
is on disk at a time; all tables have their turn. Unrelated texts meet by their stock phrases; how many do grows with the square of
the rows that share them, and WIDTH sets how fast. Top nodes of more than MAX_GROUP rows (found by a sample of ids, only
to plan) are split into blocks that meet pairwise, and so are large groups of exact copies; no row is dropped and none
waits for a hot group. Classes come from connected components over the links between representatives, with written
tables as cut lineage; nothing of the corpus goes to the driver.

Null texts, null ids and texts without letters belong to no group; a row repeated as a whole counts once. Bodies under
two letters match exact copies only.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.llm.grams import code_points, gram_hashes, gram_owner, letters_only, slices
from lexweave.llm.unify import ordinary
from lexweave.runtime import materialize, release

#: Characters of a gram, for the fingerprints and for the verification.
SKETCHED, GRAM = 2, 3
#: Slots, and of how many a mask is made; each table has slots of its own.
SLOTS, WIDTH = 72, 3
TABLES = SLOTS // WIDTH
#: So many times in turn a part of the tables is shuffled and joined.
PASSES = 3
PLANES, SPREAD_PLANES = 3, 6
APART = 12
#: Most of the 64 slots of a candidate that may differ; most where the spread ones do not matter; most of the spread ones.
#: With six planes one spread slot in 64 agrees by chance, so texts that share none of them are hardly ever candidates.
UNEQUAL, SURE, SPREAD = 39, 27, 55
#: Share of the longer body's characters that must remain in the other ("about seven tenths").
SAME = 0.65
#: Shares of common 3-grams that decide without a look at the diagonals.
SURELY = (0.40, 0.85)
#: With less than this on shared diagonals single characters cannot make up for the rest.
LEAST = 0.35
FAN = 8
MAX_GROUP = 16384
PAIRS = 2_000_000
#: So many pairs of lowest nodes are compared at once; what they need stays in the processor's cache.
LEAVES = 1024
SAMPLE = 64
#: Bits of a place in a text beside a hash.
PLACE = 26
COPIES = 1000
FACTORS = np.random.default_rng(7).integers(0, 1 << 31, max(64, SLOTS)).astype(np.uint32) * np.uint32(2) + np.uint32(1)
LABEL = re.compile(r"^\s*第[^\s。，；：]{1,16}条[\s　]*")


def bodies(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return letters_only([LABEL.sub("", ordinary(t), count=1) for t in texts])


def numbered(key: np.ndarray) -> np.ndarray:
    """For each place of a sorted array which occurrence of its value it is."""
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    return np.arange(len(key)) - np.repeat(first, np.diff(np.r_[first, len(key)]))


def spread_hashes(chars: np.ndarray) -> np.ndarray:
    """A hash for each place of the two characters there and the two APART places on."""
    h = gram_hashes(chars, 2)
    size = max(0, len(h) - APART)
    return (h[:size] * np.uint64(0x9E3779B97F4A7C15) ^ h[len(h) - size :]) * np.uint64(0xD6E8FEB86659FD93)


def sketches(chars: np.ndarray, starts: np.ndarray, spread: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(texts, SLOTS) 16-bit slot values, or (texts, 64) of spread grams, and which texts have any gram."""
    n = len(starts) - 1
    h = spread_hashes(chars) if spread else gram_hashes(chars, SKETCHED)
    owner, whole = gram_owner(starts, APART + 2 if spread else SKETCHED, len(h))
    key = np.sort(owner[whole].astype(np.uint64) << np.uint64(40) | h[whole] >> np.uint64(24))
    some = np.bincount(owner[whole], minlength=n) > 0
    slots = np.zeros((n, 64 if spread else SLOTS), dtype=np.uint16)
    if not len(key):
        return slots, some
    # The second, third ... occurrence of a gram in a text is a gram of its own.
    x = ((key & np.uint64((1 << 40) - 1)) + (numbered(key).astype(np.uint64) << np.uint64(40))) * np.uint64(0xBF58476D1CE4E5B9)
    x = ((x ^ x >> np.uint64(29)) * np.uint64(0x94D049BB133111EB) >> np.uint64(32)).astype(np.uint32)
    text = np.flatnonzero(some)
    begin = np.searchsorted(key, text.astype(np.uint64) << np.uint64(40))
    for k, by in enumerate(FACTORS[: slots.shape[1]]):
        least = np.minimum.reduceat(x * by, begin)
        slots[text, k] = (least ^ least >> np.uint32(15)) * np.uint32(0x2C1B3C6D) >> np.uint32(16)
    return slots, some


def fingerprints(slots: np.ndarray, planes: int = PLANES) -> np.ndarray:
    """(texts, planes): word p holds one bit of each of the first 64 slots."""
    bits = np.concatenate([slots[:, :64] >> p & 1 for p in range(7, 7 + planes)], axis=1).astype(np.uint8)
    return np.packbits(bits, axis=1).view(">u8").astype(np.uint64)


def masks(slots: np.ndarray) -> np.ndarray:
    """(texts, TABLES): for each table the values of its slots, the masked pattern a group shares, and its number."""
    out = np.repeat(np.arange(TABLES, dtype=np.uint64)[None, :], len(slots), axis=0)
    for i in range(WIDTH):
        out = out * np.uint64(1 << 16) + slots[:, i::WIDTH][:, :TABLES].astype(np.uint64)
    return out.view(np.int64)


def gray_rank(v: np.ndarray) -> np.ndarray:
    """Place of a bit pattern in Gray order."""
    v = v.copy()
    for s in (1, 2, 4, 8, 16, 32):
        v ^= v >> np.uint64(s)
    return v


def _near(a: np.ndarray, b: np.ndarray, bits: list[np.ndarray], shared: list[np.ndarray] | None, most: int) -> np.ndarray:
    """Places of the pairs of nodes whose accumulated differences stay within most; planes are taken two by two."""
    at, x, y, unlike = None, a, b, None
    for p in range(0, len(bits), 2):
        for q in range(p, min(p + 2, len(bits))):
            d = bits[q][x]
            d ^= bits[q][y]
            if shared is not None:
                d &= shared[q][x] & shared[q][y]
            unlike = d if unlike is None else np.bitwise_or(unlike, d, out=unlike)
        good = np.flatnonzero(np.bitwise_count(unlike) <= most)
        at = good if at is None else at[good]
        if p + 2 < len(bits):
            x, y, unlike = x[good], y[good], unlike[good]
    return at


def _leaves(a: np.ndarray, b: np.ndarray, lo: np.ndarray, hi: np.ndarray, bits: list[np.ndarray], most: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of leaves below pairs of lowest nodes, FAN leaves against FAN others in one square without places for each pair."""
    at = np.minimum(np.arange(FAN)[:, None], (hi - lo - 1)[None, :]) + lo  # a node with fewer leaves repeats its last
    leaves = [w[at] for w in bits]
    unlike, more = np.empty((2, FAN, FAN, LEAVES), dtype=np.uint64)
    bit = np.empty((FAN, FAN, LEAVES), dtype=np.uint8)
    n, found = len(a), []
    a, b = (np.r_[v, np.zeros(-n % LEAVES, dtype=v.dtype)] for v in (a, b))
    for k in range(0, n, LEAVES):
        x, y = a[k : k + LEAVES], b[k : k + LEAVES]
        for p, w in enumerate(leaves):
            np.bitwise_xor(w.take(x, axis=1)[:, None, :], w.take(y, axis=1)[None, :, :], out=more if p else unlike)
            if p:
                np.bitwise_or(unlike, more, out=unlike)
        i, z = np.divmod(np.flatnonzero(np.bitwise_count(unlike, out=bit) <= most), LEAVES)
        x, y = x[z], y[z]
        ca, cb = lo[x] + i // FAN, lo[y] + i % FAN
        real = (k + z < n) & (ca < hi[x]) & (cb < hi[y]) & ((x != y) | (ca < cb))
        found.append((ca[real], cb[real]))
    return tuple(np.concatenate(x) for x in zip(*found))


def likely(f: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs of leaves differ in few slots, or in not too many of the spread ones."""
    words = [np.ascontiguousarray(w) for w in f.T]
    good = np.zeros(len(a), dtype=bool)
    if len(a):
        good[_near(a, b, words[:PLANES], None, SURE)] = True
        good[_near(a, b, words[PLANES:], None, SPREAD)] = True
    return good


def group_pairs(group: np.ndarray, side: np.ndarray, f: np.ndarray, most: int = UNEQUAL, count: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places that differ in at most so many slots, in the same group; rows are sorted by (group, side, Gray rank).

    A group of one side is joined with itself, one of two sides (blocks of a split group) across. count takes how
    many pairs of nodes were compared on each level, leaves being level 0.
    """
    none = np.zeros(0, dtype=np.int64)
    if len(f) < 2:
        return none, none
    run = np.concatenate([[0], np.cumsum((group[1:] != group[:-1]) | (side[1:] != side[:-1]))])
    words = [np.ascontiguousarray(w) for w in f.T]
    # Levels of nodes: group and side, bits all below share, their mask, first and last child.
    levels = [(run, words, None, np.arange(len(f)), np.arange(len(f)) + 1)]
    while True:
        r, bits, shared, _, _ = levels[-1]
        first = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
        if len(first) == len(r):
            break
        inside = np.arange(len(r)) - np.repeat(first, np.diff(np.r_[first, len(r)]))
        cut = np.flatnonzero(inside % FAN == 0)
        up_bits, up_shared = [], []
        for p, w in enumerate(bits):
            low = np.bitwise_and.reduceat(w, cut)
            same = ~(low ^ np.bitwise_or.reduceat(w, cut))
            if shared is not None:
                same &= np.bitwise_and.reduceat(shared[p], cut)
            up_bits.append(low & same)
            up_shared.append(same)
        levels.append((r[cut], up_bits, up_shared, cut, np.r_[cut[1:], len(r)]))
    r = levels[-1][0]
    g, s = group[np.searchsorted(run, r)], side[np.searchsorted(run, r)]
    many = np.diff(np.r_[np.flatnonzero(np.r_[True, run[1:] != run[:-1]]), len(run)]) > 1
    both = np.flatnonzero((g[1:] == g[:-1]) & (s[1:] != s[:-1]))
    crossed = np.zeros(len(r), dtype=bool)
    crossed[both] = crossed[both + 1] = True
    own = np.flatnonzero(~crossed & many)
    a, b = np.r_[own, both], np.r_[own, both + 1]
    for level in range(len(levels) - 1, 0, -1):
        _, _, _, lo, hi = levels[level]
        _, bits, shared, _, _ = levels[level - 1]
        if not len(a):
            return none, none
        if level == 1:
            if count is not None:
                size, other = hi[a] - lo[a], hi[b] - lo[b]
                count[0] = int(np.where(a == b, size * (size - 1) // 2, size * other).sum())
            return _leaves(a, b, lo, hi, bits, most)
        found = []
        for i, j in slices(((hi[a] - lo[a]) * (hi[b] - lo[b])).tolist(), PAIRS):
            # Children of the first node, then for each those of the second; below one and the same node each pair once.
            size = hi[a[i:j]] - lo[a[i:j]]
            at = np.repeat(np.arange(i, j), size)
            ca = np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size) + lo[a[at]]
            start = np.where(a[at] == b[at], ca, lo[b[at]])
            size = hi[b[at]] - start
            cb = np.arange(int(size.sum())) + np.repeat(start - (np.cumsum(size) - size), size)
            ca = np.repeat(ca, size)
            if count is not None:
                count[level - 1] = count.get(level - 1, 0) + len(ca)
            near = _near(ca, cb, bits, shared, most)
            found.append((ca[near], cb[near]))
        a, b = (np.concatenate(x) for x in zip(*found))
    return a, b


def _hashed(src: DataFrame) -> DataFrame:
    """(id, h1, h2, body) of every text that has letters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for x, y in slices([len(s) for s in texts], 500_000):
                chars, starts = bodies(texts[x:y])
                raw = chars.astype("<u4").tobytes()
                body = [raw[4 * i : 4 * j].decode("utf-32-le", "surrogatepass") for i, j in zip(starts[:-1].tolist(), starts[1:].tolist())]
                h = np.array([divmod(xxhash.xxh3_128_intdigest(raw[4 * i : 4 * j]), 1 << 64) for i, j in zip(starts[:-1].tolist(), starts[1:].tolist())], dtype=np.uint64).reshape(-1, 2).view(np.int64)
                out = pa.RecordBatch.from_arrays([ids.slice(x, y - x), pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array([b.encode("utf-8", "replace") for b in body], pa.binary())], names=["id", "h1", "h2", "body"])
                yield out.filter(pa.array(np.diff(starts) > 0))

    return src.mapInArrow(run, "id bigint, h1 bigint, h2 bigint, body binary")


def _decoded(column: pa.Array) -> list[str]:
    return [b.decode("utf-8") for b in column.to_pylist()]


def _sketched(reps: DataFrame) -> DataFrame:
    """(id, masks, fp) of every body with a gram; masks has one for each of the TABLES."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(zero_copy_only=False), _decoded(batch.column(1))
            for x, y in slices([len(s) + 500 for s in texts], 500_000):  # at most a thousand texts at once
                points = code_points(texts[x:y])
                slots, some = sketches(*points)
                words = np.concatenate([fingerprints(slots), fingerprints(sketches(*points, spread=True)[0], SPREAD_PLANES)], axis=1)
                slots, own = slots[some], ids[x:y][some]
                if len(own):
                    each = pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1, dtype=np.int32) * TABLES), pa.array(masks(slots).reshape(-1)))
                    yield pa.RecordBatch.from_arrays([pa.array(own), each, pa.array([w.tobytes() for w in words[some]], pa.binary())], names=["id", "masks", "fp"])

    return reps.select("id", "body").mapInArrow(run, "id bigint, masks array<bigint>, fp binary")


def _masked(sketched: DataFrame, first: int = 0, end: int = TABLES) -> DataFrame:
    """(mask, id, fp): a row for every body and table from first on, before end."""
    return sketched.select(F.explode(F.slice("masks", first + 1, end - first)).alias("mask"), "id", "fp")


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of each group (grp, blk, id, fp) of a partition sorted by group; groups are held back until complete."""
    rest: pa.Table | None = None

    def pairs(t: pa.Table) -> Iterator[pa.RecordBatch]:
        grp, blk, ids = (t.column(i).to_numpy() for i in range(3))
        group = np.concatenate([[0], np.cumsum(grp[1:] != grp[:-1])])
        more = np.flatnonzero((np.bincount(group) > 1)[group])
        if not len(more):
            return
        f = np.frombuffer(b"".join(t.column(3).take(pa.array(more)).to_pylist()), dtype=np.uint64).reshape(-1, PLANES + SPREAD_PLANES)
        group, blk, ids = group[more], blk[more], ids[more]
        order = np.lexsort((gray_rank(f[:, 0]), blk, group))
        group, blk, ids, f = group[order], blk[order], ids[order], f[order]
        first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        size = np.diff(np.r_[first, len(group)])
        for i, j in slices((size * size).tolist(), PAIRS):  # groups with so many pairs at a time
            u, v = int(first[i]), int(first[j - 1] + size[j - 1])
            a, b = group_pairs(group[u:v], blk[u:v], f[u:v, :PLANES])
            good = likely(f[u:v], a, b)
            x, y = ids[u + a[good]], ids[u + b[good]]
            x, y = x[x != y], y[x != y]
            key = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1), axis=0) if len(x) else np.zeros((0, 2), dtype=np.int64)
            for k in range(0, len(key), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(key[k : k + 100_000, 0]), pa.array(key[k : k + 100_000, 1])], names=["a", "b"])

    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = pa.concat_tables([rest, t]).combine_chunks() if rest is not None else t
        if t.num_rows < 50_000:
            rest = t
            continue
        m = t.column(0).to_numpy()
        change = np.flatnonzero(m[1:] != m[:-1])
        if not len(change):
            rest = t
            continue
        cut = int(change[-1]) + 1
        yield from pairs(t.slice(0, cut))
        rest = t.slice(cut)
    if rest is not None and rest.num_rows:
        yield from pairs(rest)


def _blocks_met(rows: DataFrame, blocks: str) -> DataFrame:
    """Rows of a split group, once for every block theirs meets: (lo, hi) names the pair of blocks, blk the own one."""
    own = F.pmod(F.xxhash64("id"), F.col(blocks)).cast("int")
    d = rows.withColumn("blk", own).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col(blocks) - 1)))
    return d.withColumns({"lo": F.least("blk", "_other"), "hi": F.greatest("blk", "_other")}).drop("_other", blocks)


def candidate_pairs(reps: DataFrame) -> DataFrame:
    """(a, b), a < b, distinct: representatives (id, body) that share a mask and enough slots; a written table."""
    sketched = materialize(_sketched(reps), "dup-sketches", compression="zstd")
    sample = _masked(sketched.where(F.pmod(F.xxhash64("id"), F.lit(SAMPLE)) == 0))
    hot = materialize(sample.groupBy("mask").count().where(F.col("count") >= MAX_GROUP // SAMPLE).select("mask", F.ceil(F.col("count") * SAMPLE / MAX_GROUP * 2).cast("int").alias("blocks")), "dup-hot")
    some, parts = not hot.isEmpty(), []
    for k in range(PASSES):
        masked = _masked(sketched, TABLES * k // PASSES, TABLES * (k + 1) // PASSES)
        if some:
            met = _blocks_met(masked.join(hot, "mask", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))), "blocks")
            rows = met.select(F.when(F.col("hi") == 0, F.col("mask")).otherwise(F.xxhash64("mask", "lo", "hi")).alias("grp"), "blk", "id", "fp")
        else:
            rows = masked.select(F.col("mask").alias("grp"), F.lit(0).alias("blk"), "id", "fp")
        # One key of one number: Spark sorts it without comparing rows. Groups of equal hash would only be compared together.
        rows = rows.repartition("grp").sortWithinPartitions("grp")
        parts.append(materialize(rows.mapInArrow(_joined, "a bigint, b bigint").distinct(), "dup-pass"))
    release(sketched, hot)
    out = materialize(reduce(DataFrame.unionByName, parts).distinct(), "dup-candidates")
    release(*parts)
    return out


def _gram_sets(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each text its characters, the gram at each place and which occurrence of it that is, the sorted grams and their places."""
    chars, starts = code_points(texts)
    h = gram_hashes(chars, GRAM)
    owner, whole = gram_owner(starts, GRAM, len(h))
    at = np.flatnonzero(whole)
    begin = np.concatenate([[0], np.cumsum(np.maximum(np.diff(starts) - GRAM + 1, 0))])
    # Hash and place in one number: sorting it is stable.
    h = h[at] >> np.uint64(PLACE)
    key = h << np.uint64(PLACE) | (at - starts[owner[at]]).astype(np.uint64)
    for i, j in zip(begin[:-1].tolist(), begin[1:].tolist()):
        key[i:j].sort()
    s, order = key >> np.uint64(PLACE), (key & np.uint64((1 << PLACE) - 1)).astype(np.int64)
    new = np.ones(len(s), dtype=bool)
    new[1:] = s[1:] != s[:-1]
    new[begin[:-1][np.diff(begin) > 0]] = True
    first = np.flatnonzero(new)
    occurrence = np.empty(len(s), dtype=np.int64)
    occurrence[np.repeat(begin[:-1], np.diff(begin)) + order] = np.arange(len(s)) - np.repeat(first, np.diff(np.append(first, len(s))))
    return [(chars[a:b], h[i:j], occurrence[i:j], s[i:j], order[i:j]) for a, b, i, j in zip(starts[:-1].tolist(), starts[1:].tolist(), begin[:-1].tolist(), begin[1:].tolist())]


def _grams(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    return _gram_sets([text])[0]


def _covered(places: np.ndarray, size: int) -> np.ndarray:
    """Which of size characters the grams that begin at the places cover."""
    mark = np.zeros(size, dtype=bool)
    for k in range(GRAM):
        mark[places + k] = True
    return mark


def kept_share(one: tuple, other: tuple) -> float:
    """Share of the longer body's characters that remain in the other one, wherever they stand.

    Grams in common decide if they cover little or nearly all. In between only those on a diagonal count beside which
    (8 places either way) at least 24 places agree, and on such a diagonal single characters count too, near a gram.
    """
    if len(one[0]) < len(other[0]):
        one, other = other, one
    size = len(one[0])
    if not len(other[3]) or len(other[0]) < SAME * size:
        return 0.0
    # The second occurrence of a gram here meets the second one there.
    at = np.minimum(np.searchsorted(other[3], one[1]) + one[2], len(other[3]) - 1)
    x = np.flatnonzero((other[3][at] == one[1]) & (other[2][other[4][at]] == one[2]))
    share = np.count_nonzero(_covered(x, size)) / size
    if not SURELY[0] <= share < SURELY[1]:
        return share
    y = other[4][at[x]]
    shift = x - y + len(other[0])
    there = np.bincount(shift, minlength=size + len(other[0]) + 1)
    near = np.convolve(there, np.ones(17, dtype=np.int64), "same") >= 24
    good = near[shift]
    x, shift = x[good], shift[good]
    mark = _covered(x, size)
    if mark.sum() < LEAST * size:
        return float(mark.sum()) / size
    for d in np.unique(shift):
        if there[d] < 8:
            continue
        on = x[shift == d]
        off = int(d) - len(other[0])
        u, v = max(int(on[0]) - 8, off, 0), min(int(on[-1]) + GRAM + 8, len(other[0]) + off, size)
        step = np.zeros(v - u + 1, dtype=np.int64)
        np.add.at(step, np.maximum(on - 8 - u, 0), 1)
        np.add.at(step, np.minimum(on + GRAM + 8 - u, v - u), -1)
        mark[u:v] |= (one[0][u:v] == other[0][u - off : v - off]) & (np.cumsum(step)[:-1] > 0)
    return float(mark.sum()) / size


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = [batch.column(i).to_pylist() for i in (0, 1)]
        texts = [_decoded(batch.column(i)) for i in (2, 3)]
        share = np.zeros(batch.num_rows)
        fits = [k for k, (x, y) in enumerate(zip(*texts)) if min(len(x), len(y)) >= SAME * max(len(x), len(y))]
        for i, j in slices([len(texts[0][k]) + len(texts[1][k]) for k in fits], 300_000):
            known = {ids[side][k]: texts[side][k] for k in fits[i:j] for side in (0, 1)}
            known = dict(zip(known, _gram_sets(list(known.values()))))
            for k in fits[i:j]:
                share[k] = kept_share(known[ids[0][k]], known[ids[1][k]])
        good = share >= SAME
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(good)), batch.column(1).filter(pa.array(good)), pa.array(share[good])], names=["a", "b", "share"])


def near_duplicates(df: DataFrame, key: str = "chunk_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(id, rep) of every text with letters, and the verified links (a, b, share) between representatives; written tables."""
    src = df.select(F.col(f"`{key}`").cast("bigint").alias("id"), F.col(f"`{text}`").cast("string").alias("t")).where("id is not null and length(t) > 0")
    rows = materialize(_hashed(src), "dup-bodies", compression="zstd")
    first = rows.groupBy("h1", "h2").agg(F.min("id").alias("rep"))
    held = materialize(rows.select("h1", "h2", "id").join(first, ["h1", "h2"]).distinct(), "dup-held")
    # Only exact copies are taken out, so no body moves where they are few enough for Spark to send them to all.
    reps = materialize(rows.join(held.where("id <> rep").select("h1", "h2", "id"), ["h1", "h2", "id"], "left_anti").select("id", "body"), "dup-representatives", compression="zstd")
    members = materialize(held.select("id", "rep").distinct(), "dup-members")
    release(rows, held)
    found = candidate_pairs(reps)
    wanted = found.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    texts = reps.join(wanted, "id", "left_semi").dropDuplicates(["id"])
    both = found.join(texts.select(F.col("id").alias("a"), F.col("body").alias("ta")), "a").join(texts.select(F.col("id").alias("b"), F.col("body").alias("tb")), "b")
    links = materialize(both.select("a", "b", "ta", "tb").mapInArrow(_verified, "a bigint, b bigint, share double"), "dup-links")
    release(found, reps)
    return members, links


def duplicate_pairs(df: DataFrame, key: str = "chunk_id", text: str = "text") -> DataFrame:
    """(a, b), a < b: every pair of rows that are copies of one another, exact copies included."""
    members, links = near_duplicates(df, key, text)
    x, y = (members.select(F.col("id").alias(n), F.col("rep").alias(f"r{n}")) for n in ("x", "y"))
    linked = links.select("a", "b").join(x, F.col("a") == F.col("rx")).select("x", "b").join(y, F.col("b") == F.col("ry")).select("x", "y")
    several = members.groupBy("rep").count().where("count > 1").select("rep", F.ceil(F.col("count") / COPIES).cast("int").alias("blocks"))
    met = _blocks_met(members.join(several, "rep"), "blocks")
    left, right = met.where("blk = lo").select("rep", "lo", "hi", F.col("id").alias("x")), met.where("blk = hi").select("rep", "lo", "hi", F.col("id").alias("y"))
    same = left.join(right, ["rep", "lo", "hi"]).where("lo < hi or x < y").select("x", "y")
    return linked.unionByName(same).where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def duplicate_classes(df: DataFrame, key: str = "chunk_id", text: str = "text") -> DataFrame:
    """(id, class_id, links): every row with letters, its class (lowest id reachable) and its links to other texts."""
    members, links = near_duplicates(df, key, text)
    edges = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degree = edges.groupBy(F.col("a").alias("rep")).agg(F.count("*").alias("links"))
    label = materialize(edges.groupBy(F.col("a").alias("rep")).agg(F.least(F.min("b"), F.first("a")).alias("c")), "dup-labels")
    last = label
    while True:
        near = edges.join(label.select(F.col("rep").alias("b"), "c"), "b").groupBy(F.col("a").alias("rep")).agg(F.min("c").alias("n"))
        step = label.join(near, "rep", "left").select("rep", F.col("c").alias("old"), F.least("c", F.coalesce("n", "c")).alias("c"))
        hop = step.select(F.col("rep").alias("c"), F.col("c").alias("top"))
        new = materialize(step.join(hop, "c", "left").select("rep", "old", F.coalesce("top", "c").alias("c")), "dup-labels")
        release(last)
        last, label = new, new.select("rep", "c")
        if new.where("c <> old").isEmpty():
            break
    out = members.join(label, "rep", "left").join(degree, "rep", "left")
    return out.select("id", F.coalesce("c", "rep").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))
