"""Reading level of each document by harmonic propagation over a document-word graph.

Method: a bipartite graph of documents and word nodes (character 5-grams of the case-folded text, and whole Latin
words, hashed to a number of nodes that can be set). Graded documents are clamped to the mean of their raters. In each
distributed iteration a document takes the weighted mean of its words, a word the mean of its documents; edges of words
whose documents differ much in difficulty weigh less. The iterations end when no word moves by more than TOLERANCE, at the
latest after a given number. A last pass cuts the continuous difficulty into levels where the graded documents say so.

Scale: the edges are written once to the shared folder (about two bytes an edge) and read per iteration; what travels is
three vectors of nodes per task, of at most sums.MOST_TASKS tasks, added up in a tree whose groups have at most
sums.FAN_IN pieces, and one vector to every worker. The number of nodes is the one thing to raise for a larger
vocabulary. Labels join by Spark's own choice of join. No text is cut or sampled.

Null or blank texts have no row. Null grades are left out; grades of unknown documents are ignored. Without any
grade the level is null. A text without any word node gets the level of the mean difficulty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.llm.grams import code_points, gram_hashes, gram_owner, letter_tables, slices
from lexweave.llm.sums import add_up, parts
from lexweave.runtime import materialize

#: Default number of word nodes, a power of two of at most 2 ** 24.
NODES = 1 << 17
GRAM = 5
BINS = 2048
#: The most iterations, and the change of a word's difficulty that no longer counts.
ITERATIONS = 10
TOLERANCE = 0.05
#: Marks a gap of so many nodes in the coded edges.
GAP = 0xFFFF
#: A graded document counts so many times an ungraded one in the mean of a word.
CLAMP_WEIGHT = 4.0
PRIOR = 5.0
LEVELS = 5
BLANK = "(?U)^[\\s\\x{feff}\\x{200b}]*$"


def coded(nodes: np.ndarray, cut: np.ndarray) -> list[bytes]:
    """Sorted nodes of each text as 16-bit distances from the one before; longer ones are preceded by gaps."""
    step = np.diff(nodes, prepend=0).astype(np.int64)
    begin = cut[:-1][np.diff(cut) > 0]
    step[begin] = nodes[begin]
    gaps = step // GAP
    at = np.cumsum(gaps + 1) - 1
    out = np.full(int(at[-1]) + 1 if len(at) else 0, GAP, dtype="<u2")
    out[at] = step % GAP
    ends = np.concatenate([[0], at + 1])[cut]
    return [out[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])]


def decoded(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of a batch of coded texts and whose they are."""
    texts = column.to_pylist()
    size = np.fromiter((len(t) // 2 for t in texts), dtype=np.int64, count=len(texts))
    v = np.frombuffer(b"".join(texts), dtype="<u2").astype(np.int64)
    upto = np.concatenate([[0], np.cumsum(v)])
    doc = np.repeat(np.arange(len(texts)), size)
    first = np.cumsum(size) - size
    real = v != GAP
    return (upto[1:] - upto[first[doc]])[real], doc[real]


def word_nodes(texts: list[str], nodes: int = NODES) -> list[bytes]:
    """The distinct word nodes of each text, coded."""
    fold, _ = letter_tables()
    chars, starts = code_points(texts)
    chars = fold[chars]
    bits = nodes.bit_length() - 1
    small = len(texts) < 1 << (32 - bits)
    kind = np.uint32 if small else np.uint64
    h = gram_hashes(chars, GRAM) >> np.uint64(64 - bits)
    owner, whole = gram_owner(starts, GRAM, len(h))
    keys = [(owner[whole].astype(kind) << kind(bits)) | h[whole].astype(kind)]
    latin = np.flatnonzero(((chars >= 97) & (chars <= 122)) | ((chars >= 0xDF) & (chars <= 0xFF)))
    if len(latin):
        whose = np.searchsorted(starts, latin, side="right") - 1
        first = np.flatnonzero(np.r_[True, (latin[1:] != latin[:-1] + 1) | (whose[1:] != whose[:-1])])
        place = np.arange(len(latin)) - np.repeat(first, np.diff(np.r_[first, len(latin)]))
        with np.errstate(over="ignore"):
            part = (chars[latin].astype(np.uint64) + np.uint64(7)) * (place.astype(np.uint64) + np.uint64(3)) ** np.uint64(5)
            word = (np.add.reduceat(part, first) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - bits)
        keys.append((whose[first].astype(kind) << kind(bits)) | word.astype(kind))
    u = np.sort(np.concatenate(keys))
    u = u[np.r_[True, u[1:] != u[:-1]]] if len(u) else u
    cut = np.searchsorted(u, (np.arange(len(texts) + 1, dtype=np.uint64) << np.uint64(bits)))
    return coded((u & kind(nodes - 1)).astype(np.int64), cut)


def document_nodes(docs: DataFrame, key: str = "doc_id", text: str = "text", nodes: int = NODES) -> DataFrame:
    """(key, nodes): one row per document that has text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column(0), b.column(1).to_pylist()
            for x, y in slices([len(t) for t in texts], 500_000):
                yield pa.RecordBatch.from_arrays([ids.slice(x, y - x), pa.array(word_nodes(texts[x:y], nodes), pa.binary())], names=[key, "nodes"])

    src = docs.select(F.col(f"`{key}`").cast("bigint").alias(key), F.col(f"`{text}`").alias("_t")).where(~F.col("_t").rlike(BLANK))
    return src.mapInArrow(run, f"{key} bigint, nodes binary")


def _scores(nodes: pa.Array, f: np.ndarray, g: np.ndarray, mean: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document scores of a batch, its edges' nodes and their documents."""
    ix, doc = decoded(nodes)
    w = g[ix]
    den = np.bincount(doc, w, len(nodes))
    num = np.bincount(doc, w * f[ix], len(nodes))
    return np.where(den > 0, num / np.maximum(den, 1e-12), mean), ix, doc


def _pass(graph: DataFrame, f: np.ndarray, g: np.ndarray, mean: float, graded: bool) -> tuple[np.ndarray, np.ndarray]:
    """One half of an iteration: sums per word over graded documents (their grades) or over the others (their scores)."""
    vectors = graph.sparkSession.sparkContext.broadcast((f, g))
    n = len(f)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, g = vectors.value
        sums, moments = np.zeros((3, n)), np.zeros(5)
        for b in batches:
            y = b.column(1).to_numpy(zero_copy_only=False).astype(float)
            s, ix, doc = _scores(b.column(0), f, g, mean)
            known = ~np.isnan(y)
            moments += [known.sum(), s[known].sum(), y[known].sum(), (s[known] ** 2).sum(), (s[known] * y[known]).sum()]
            v, use = (np.nan_to_num(y), known[doc]) if graded else (s, ~known[doc])
            e, i = v[doc[use]], ix[use]
            sums += [np.bincount(i, minlength=n), np.bincount(i, e, n), np.bincount(i, e * e, n)]
        yield from parts(np.concatenate([sums.reshape(-1), moments]))

    got = add_up(graph.select("nodes", "grade"), run, (3 * n + 5,))
    vectors.unpersist()
    return got[: 3 * n].reshape(3, n), got[3 * n :]


def reading_levels(docs: DataFrame, labels: DataFrame, iterations: int = ITERATIONS, nodes: int = NODES, tolerance: float = TOLERANCE) -> DataFrame:
    """(doc_id, difficulty, reading_level) for every document that has text."""
    grades = labels.where(F.col("reading_level").between(1, LEVELS)).groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.avg("reading_level").alias("grade"))
    graph = materialize(document_nodes(docs, nodes=nodes).join(grades, "doc_id", "left").select("doc_id", "nodes", "grade"), "reading-graph")
    # The sums over clamped documents stay the same in every iteration.
    start = graph.where("grade is not null")
    known, moments = _pass(start, np.full(nodes, 3.0), np.ones(nodes), 3.0, True)
    if moments[0] == 0:
        return graph.select("doc_id", F.lit(None).cast("double").alias("difficulty"), F.lit(None).cast("bigint").alias("reading_level"))
    mean = moments[2] / moments[0]
    spread = 1.2 + mean**2
    known = known * CLAMP_WEIGHT
    sums, f = known, None
    for i in range(max(1, iterations)):
        last, f = f, (sums[1] + PRIOR * mean) / (sums[0] + PRIOR)
        g = 1 / np.maximum((sums[2] + PRIOR * spread) / (sums[0] + PRIOR) - f**2, 0.02)
        if i == iterations - 1 or last is not None and np.abs(f - last).max() <= tolerance:
            break
        free, m = _pass(graph, f, g, mean, False)
        # Means of means shrink: the graded documents say by how much, and all scores are stretched back alike.
        n, sx, sy, sxx, sxy = m
        var = n * sxx - sx * sx
        a = (n * sxy - sx * sy) / var if n > 1 and var > 1e-9 else 1.0
        c = (sy - a * sx) / n
        moved = np.stack([free[0], a * free[1] + c * free[0], a * a * free[2] + 2 * a * c * free[1] + c * c * free[0]])
        sums = known + moved
    f = np.clip(f, 1, LEVELS)
    scored = _score(graph, f, g, mean)
    cuts = _cuts(scored.where("grade is not null"))
    level = F.lit(1)
    for c in cuts:
        level = level + F.when(F.col("difficulty") > c, 1).otherwise(0)
    return scored.select("doc_id", "difficulty", level.cast("bigint").alias("reading_level"))


def _score(graph: DataFrame, f: np.ndarray, g: np.ndarray, mean: float) -> DataFrame:
    vectors = graph.sparkSession.sparkContext.broadcast((f, g))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, g = vectors.value
        for b in batches:
            s, _, _ = _scores(b.column(1), f, g, mean)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), b.column(2)], names=["doc_id", "difficulty", "grade"])

    return graph.mapInArrow(run, "doc_id bigint, difficulty double, grade double")


def _cuts(graded: DataFrame) -> list[float]:
    """Where one level ends and the next begins: the place with the fewest graded documents on the wrong side."""
    width = (LEVELS - 1) / BINS
    rows = graded.groupBy(F.least(F.floor((F.col("difficulty") - 1) / width), F.lit(BINS - 1)).alias("bin"), F.col("grade")).count().collect()
    out, least = [], 1.0
    for k in range(1, LEVELS):
        below, above = np.zeros(BINS + 1), np.zeros(BINS + 1)
        for b, y, n in rows:
            (above if y > k + 0.25 else below)[int(b) + 1] += n
        wrong = np.cumsum(above) + below.sum() - np.cumsum(below)
        best = np.flatnonzero(wrong == wrong.min())
        least = max(least, 1 + width * float(best[len(best) // 2]))
        out.append(least)
    return out
