"""Retrieval: BM25 over characters, exact vector search, reciprocal rank fusion.

BM25 explodes no text: characters are counted on arrays of code points per Arrow batch, frequencies are summed per task
before they move (the vocabulary bounds what is shuffled), and scoring is one pass. Many questions over the same
documents go through a written index: the distinct characters of each document with their counts, read once for a block of
questions. Lists are cut by orderBy + limit, which Spark runs as a top-k per partition, or by the k best of every task
and question. Ties go to the smaller id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.config import DEFAULT, Config
from lexweave.functions import text as X


def _count_characters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of every character of a partition, counted on arrays of code points."""
    blank = np.zeros(0x110000, dtype=bool)
    blank[X.BLANKS] = True
    tf, df = np.zeros(0x110000, dtype=np.int64), np.zeros(0x110000, dtype=np.int64)
    for batch in batches:
        texts = batch.column(0).to_pylist()
        at = 0
        while at < len(texts):
            # At most 2048 texts at once, so a text's number and a code point share 32 bits.
            end, size = at, 0
            while end < len(texts) and end - at < 2048 and (end == at or size < 1_000_000):
                size += len(texts[end])
                end += 1
            part = texts[at:end]
            chars = np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
            owner = np.repeat(np.arange(len(part), dtype=np.uint32), [len(t) for t in part])
            keep = ~blank[chars]
            chars, owner = chars[keep], owner[keep]
            tf += np.bincount(chars, minlength=0x110000)
            pairs = np.sort((owner << np.uint32(21)) | chars)
            first = pairs[np.r_[True, pairs[1:] != pairs[:-1]]] if len(pairs) else pairs
            df += np.bincount(first & np.uint32(0x1FFFFF), minlength=0x110000)
            at = end
    found = np.flatnonzero(tf)
    yield pa.RecordBatch.from_arrays([pa.array([chr(c) for c in found], pa.string()), pa.array(tf[found]), pa.array(df[found])], names=["token", "tf", "df"])


def term_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """(token, tf, df): occurrences and documents of every character.

    Counted per partition before anything moves: what is shuffled is one row per distinct character and task.
    """
    part = docs.select(F.col(text).alias("t")).where(F.length("t") > 0).mapInArrow(_count_characters, "token string, tf bigint, df bigint")
    return part.groupBy("token").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))


def _index_characters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    blank = np.zeros(0x110000, dtype=bool)
    blank[X.BLANKS] = True
    for batch in batches:
        texts = batch.column(1).to_pylist()
        for a in range(0, len(texts), 500):
            part = [t or "" for t in texts[a : a + 500]]
            chars = np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
            owner = np.repeat(np.arange(len(part)), [len(t) for t in part])
            keep = ~blank[chars]
            pair, tf = np.unique(owner[keep] << 21 | chars[keep], return_counts=True)
            ends = np.searchsorted(pair >> 21, np.arange(len(part) + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(v.astype(np.int32))) for v in (pair & 0x1FFFFF, tf)]
            length = np.bincount(owner[keep], minlength=len(part))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, len(part)), pa.array(length), *lists], names=["key", "length", "codes", "counts"])


def character_index(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, length, codes, counts): the distinct characters of each document and how often they occur; to be written once."""
    src = docs.select(F.col(key), F.col(text).cast("string"))
    return src.mapInArrow(_index_characters, f"key {dict(docs.dtypes)[key]}, length bigint, codes array<int>, counts array<int>").withColumnRenamed("key", key)


def index_statistics(index: DataFrame) -> DataFrame:
    """(code, df) from a character index, without its texts."""
    return index.select(F.explode_outer("codes").alias("code")).where("code is not null").groupBy("code").agg(F.count("*").alias("df"))


def idf_table(stats: DataFrame, documents: int, cfg: Config = DEFAULT) -> DataFrame:
    """stats (with df) and idf, negative values raised to epsilon times the mean of all."""
    raw = stats.withColumn("_raw", F.log(F.lit(float(documents)) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.agg(F.avg("_raw").alias("_mean"))
    return raw.crossJoin(F.broadcast(mean)).withColumn("idf", F.when(F.col("_raw") < 0, F.col("_mean") * cfg.bm25_epsilon).otherwise(F.col("_raw"))).drop("_raw", "_mean")


def _keep_best(near_d, near_i, d, i, k: int):
    """The k smallest of two tables of values (a row per query) with their ids; ties to the smaller id."""
    d, i = np.concatenate([near_d, d], axis=1), np.concatenate([near_i, i], axis=1)
    if d.shape[1] > 4 * k:  # only what is not worse than the k-th can stay
        bound = np.partition(d, k - 1, axis=1)[:, k - 1 : k]
        most = max(k, int((d <= bound).sum(axis=1).max()))
        some = np.argpartition(np.where(d <= bound, 0, 1), min(most, d.shape[1]) - 1, axis=1)[:, :most]
        d, i = np.take_along_axis(d, some, 1), np.take_along_axis(i, some, 1)
    order = np.lexsort((i, d), axis=1)[:, :k]
    return np.take_along_axis(d, order, 1), np.take_along_axis(i, order, 1)


def bm25_top_batch(index: DataFrame, questions: DataFrame, k: int = DEFAULT.bm25_k, key: str = "doc_id", question_key: str = "query_id", question: str = "question", cfg: Config = DEFAULT, block: int = 1024) -> DataFrame:
    """(question_key, key, score, rank): the k best documents for each of many questions, by a written character index.

    Questions go out in blocks of a fixed number; a task keeps k rows per question, and only those are shuffled. Documents
    without any character of a question are not listed. Statistics come from the index, one row per distinct character.
    """
    n, total = index.agg(F.count("*"), F.sum("length")).first()
    average = (total or 0) / max(1, n) or 1.0
    idf = {r["code"]: r["idf"] for r in idf_table(index_statistics(index), n, cfg).collect()}
    asked = questions.select(F.col(question_key).cast("bigint").alias("q"), F.col(question).cast("string").alias("t")).where("q is not null and t is not null")
    blocks = max(1, math.ceil(asked.count() / block))
    out = None
    for b in range(blocks):
        part = (asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == b)).orderBy("q", "t").collect()
        codes = sorted({ord(c) for r in part for c in r["t"] if ord(c) in idf})
        at = {c: i for i, c in enumerate(codes)}
        weight = np.zeros((len(codes), len(part)))
        for j, r in enumerate(part):
            for c in r["t"]:
                if ord(c) in at:
                    weight[at[ord(c)], j] += idf[ord(c)]
        shared = index.sparkSession.sparkContext.broadcast((np.array([r["q"] for r in part], dtype=np.int64), np.array(codes, dtype=np.int64), weight))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, codes, weight = shared.value
            if not len(codes):
                return
            place = np.full(0x110000, -1)
            place[codes] = np.arange(len(codes))
            best_d, best_i = np.zeros((len(ids), 0)), np.zeros((len(ids), 0), dtype=np.int64)
            for batch in batches:
                for a in range(0, batch.num_rows, 2000):
                    one = batch.slice(a, 2000)
                    lists, counts = one.column(2), one.column(3)
                    size = np.diff(lists.offsets.to_numpy())
                    own, p = np.repeat(np.arange(len(size)), size), place[lists.flatten().to_numpy()]
                    tf = counts.flatten().to_numpy().astype(float)
                    norm = cfg.bm25_k1 * (1 - cfg.bm25_b + cfg.bm25_b * one.column(1).to_numpy() / average)
                    use = p >= 0
                    own, p, tf = own[use], p[use], tf[use]
                    m = np.zeros((len(size), len(codes)))
                    m[own, p] = tf * (cfg.bm25_k1 + 1) / (tf + norm[own])
                    score = np.round(m @ weight, 6)
                    shares = (m > 0).astype(np.float32) @ (weight != 0).astype(np.float32) > 0
                    d = np.where(shares, -score, np.inf).T
                    best_d, best_i = _keep_best(best_d, best_i, d, np.broadcast_to(one.column(0).to_numpy(zero_copy_only=False), d.shape), k)
            found = np.isfinite(best_d)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, best_d.shape[1])[found.reshape(-1)]), pa.array(best_i[found]), pa.array(-best_d[found])], names=[question_key, key, "score"])

        src = index.select(F.col(key).cast("bigint").alias(key), "length", "codes", "counts")
        found = src.mapInArrow(run, f"{question_key} bigint, {key} bigint, score double")
        out = found if out is None else out.unionByName(found)
    w = Window.partitionBy(question_key).orderBy(F.desc("score"), key)
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def bm25_scores(docs: DataFrame, query: str, key: str = "doc_id", text: str = "text", cfg: Config = DEFAULT) -> DataFrame:
    """(key, score) of every document; repeated query characters count repeatedly; null texts count as empty.

    The corpus statistics that come to the driver are one row per distinct character, bounded by Unicode.
    """
    tokens = [c for c in query if not c.isspace()]
    n = docs.count()
    stats = term_statistics(docs, text).collect()
    raw = {r["token"]: math.log(n - r["df"] + 0.5) - math.log(r["df"] + 0.5) for r in stats}
    mean = math.fsum(raw.values()) / max(1, len(raw))
    wanted = [(ord(c), tokens.count(c) * (raw[c] if raw[c] >= 0 else cfg.bm25_epsilon * mean)) for c in sorted(set(tokens)) if c in raw]
    average = sum(r["tf"] for r in stats) / max(1, n) or 1.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blank = np.zeros(0x110000, dtype=bool)
        blank[X.BLANKS] = True
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            sizes = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
            score = np.zeros(len(texts))
            for a in range(0, len(texts), 1000):
                part = texts[a : a + 1000]
                chars = np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
                ends = np.concatenate([[0], np.cumsum(sizes[a : a + 1000])])
                inside = lambda at, ends=ends: np.diff(np.searchsorted(at, ends)).astype(float)
                norm = cfg.bm25_k1 * (1 - cfg.bm25_b + cfg.bm25_b * (np.diff(ends) - inside(np.flatnonzero(blank[chars]))) / average)
                for c, weight in wanted:
                    tf = inside(np.flatnonzero(chars == c))
                    score[a : a + 1000] += weight * tf * (cfg.bm25_k1 + 1) / (tf + norm)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], names=[key, "score"])

    return docs.select(key, F.col(text).cast("string").alias("_t")).mapInArrow(run, f"`{key}` {dict(docs.dtypes)[key]}, score double")


def top(scored: DataFrame, key: str, k: int, descending: bool = True, column: str = "score") -> DataFrame:
    """The k best rows with their rank from 1; the window sees only those k rows."""
    order = [F.col(column).desc() if descending else F.col(column).asc(), F.col(key).asc()]
    best = scored.orderBy(*order).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def bm25_top(docs: DataFrame, query: str, k: int = DEFAULT.bm25_k, key: str = "doc_id", text: str = "text", cfg: Config = DEFAULT) -> DataFrame:
    """The k best documents; also those with score 0 where fewer match."""
    s = bm25_scores(docs, query, key, text, cfg).select(key, F.round("score", 6).alias("score"))
    return top(s, key, k)


def squared_distance(vector: Column, query: list[float]) -> Column:
    """Squared L2 distance to a fixed vector, unrolled so that it stays in generated code, as long as that is not too long."""
    if len(query) > 256:
        other = F.array(*map(F.lit, map(float, query)))
        return F.aggregate(F.zip_with(vector, other, lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)), F.lit(0.0), lambda a, x: a + x)
    out = F.lit(0.0)
    for i, q in enumerate(query):
        d = vector[i].cast("double") - F.lit(float(q))
        out = out + d * d
    return out


def vector_top(vectors: DataFrame, query: list[float], k: int = DEFAULT.vector_k, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k nearest by exact squared L2 distance; null vectors are no neighbours."""
    s = vectors.where(F.size(vector) == len(query)).select(key, F.round(squared_distance(F.col(vector), query), 6).alias("distance"))
    return top(s, key, k, descending=False, column="distance")


def vector_top_batch(vectors: DataFrame, queries: DataFrame, k: int = DEFAULT.vector_k, key: str = "vec_id", vector: str = "embedding", block: int = 4096) -> DataFrame:
    """(query_id, key, distance, rank) for a set of query vectors against all rows, block by block of queries.

    A block of queries is broadcast with that bound; a partition keeps k rows per query, and only those are shuffled.
    """
    n = max(1, math.ceil(queries.count() / block))
    rows = queries.select(F.col(key).cast("bigint").alias("q"), F.col(vector).alias("v"))
    out = None
    for b in range(n):
        part = (rows if n == 1 else rows.where(F.pmod(F.xxhash64("q"), F.lit(n)) == b)).orderBy("q").collect()
        ids, qs = np.array([r["q"] for r in part], dtype=np.int64), np.array([r["v"] for r in part], dtype=np.float64)
        shared = vectors.sparkSession.sparkContext.broadcast((ids, qs))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, qs = shared.value
            if not len(ids):
                return
            near_d = np.full((len(ids), 0), np.inf)
            near_i = np.zeros((len(ids), 0), dtype=np.int64)
            for batch in batches:
                if not batch.num_rows:
                    continue
                step = max(1, 16_000_000 // (8 * len(ids)))  # a table of distances takes 16 MB at most
                for a in range(0, batch.num_rows, step):
                    part = batch.slice(a, step)
                    v = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(part.num_rows, -1)
                    d = np.round((v * v).sum(1)[None, :] - 2 * qs @ v.T + (qs * qs).sum(1)[:, None], 6)
                    near_d, near_i = _keep_best(near_d, near_i, d, np.broadcast_to(part.column(0).to_numpy(zero_copy_only=False), d.shape), k)
            m = near_d.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, m)), pa.array(near_i.reshape(-1)), pa.array(near_d.reshape(-1))], names=["query_id", key, "distance"])

        dimension = len(qs[0]) if len(qs) else 0
        found = vectors.where(F.size(vector) == dimension).select(F.col(key).cast("bigint").alias(key), vector).mapInArrow(run, f"query_id bigint, {key} bigint, distance double")
        out = found if out is None else out.unionByName(found)
    w = Window.partitionBy("query_id").orderBy("distance", key)
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def rrf_fuse(lists: list[DataFrame], key: list[str], k: int = DEFAULT.final_k, rrf_k: int = DEFAULT.rrf_k, carry: list[str] | None = None) -> DataFrame:
    """Ranked lists (key, rank, carried columns) fused by reciprocal rank.

    A key repeated in one list counts twice; the carried columns are those of the row seen last; ties keep the order
    in which keys were first seen.
    """
    carry = carry or []
    rows = None
    for i, d in enumerate(lists):
        one = d.select(*key, F.lit(i).alias("list_idx"), F.col("rank").cast("bigint").alias("rank"), *carry)
        rows = one if rows is None else rows.unionByName(one)
    seen = F.struct("list_idx", "rank")
    out = rows.groupBy(*key).agg(F.round(F.sum(1.0 / (F.lit(rrf_k) + F.col("rank"))), 9).alias("rrf_score"), F.min(seen).alias("first_seen"), *[F.max_by(c, seen).alias(c) for c in carry])
    order = [F.desc("rrf_score"), F.asc("first_seen")]
    best = out.orderBy(*order).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*order))).drop("first_seen")


def by_source(docs: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Only documents of the configured source, where one is set; for the input of either recall."""
    return docs.where(F.col("source") == cfg.source_filter) if cfg.source_filter else docs


class HybridRetriever:
    """Vector and keyword recall behind two callables that return ranked frames (key, rank, carried columns)."""

    def __init__(self, vector_recall, keyword_recall, key: list[str], carry: list[str] | None = None, cfg: Config = DEFAULT):
        self.vector_recall, self.keyword_recall = vector_recall, keyword_recall
        self.key, self.carry, self.cfg = key, carry or [], cfg

    def retrieve(self, query: str) -> DataFrame:
        lists = [self.vector_recall(query, self.cfg.vector_k), self.keyword_recall(query, self.cfg.bm25_k)]
        return rrf_fuse(lists, self.key, self.cfg.final_k, self.cfg.rrf_k, self.carry)


def document_key(source: Column, chapter: Column, article_no: Column, chunk_end: Column, text: Column) -> Column:
    """One identity per chunk: its metadata and the first 120 characters, stable between processes."""
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in (source, chapter, article_no, chunk_end)]
    return F.concat_ws("|", *parts, F.substring(F.coalesce(text, F.lit("")), 1, 120))
