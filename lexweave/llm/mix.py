"""A mix of sources at target weights.

Sizes are tokens of a public tokenizer. Every source gets total * target_share tokens; where that is more than it has,
its documents repeat, at most max_repeats times in all (exact copies under other ids are the same document: the lowest
id stands for them). The total is given, or is the largest at which every source that has documents still reaches its
share; a source whose cap binds gives all it may.

Method: whole repeats first; the rest is one inclusion probability per source, turned into a sample by the cube
method: in blocks of bounded size the probabilities move along the null space of the balancing constraints (tokens and
documents) until each is 0 or 1 but for at most two, the undecided of all blocks meet again in blocks, round after
round, and a landing step over the last few picks the rounding closest to the balance.

Scale: texts are read once, for counting; after that only (id, source, tokens) moves. Blocks hold at most BLOCK rows
whatever the size of a source. What reaches the driver is one row per source.

Null and blank texts, null ids, null sources and sources without target are left out; source spellings are folded (case, blanks,
hyphens). A target without documents is reported with zero; null shares count as 0, null repeats as 1.
"""

from __future__ import annotations

import base64
import math
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexweave.runtime import materialize

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: The pre-tokenizer of the public byte-level vocabularies (a fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BLOCK = 4096
#: As a total: all tokens of the targets' sources, each text counted once.
AVAILABLE = "available"
_encoders: dict[str, object] = {}


def encoder(path: str):
    """The tokenizer of a vocabulary file, built once per worker from the copy Spark sent there."""
    if path not in _encoders:
        import tiktoken

        sent = SparkFiles.get(os.path.basename(path))
        with open(sent if os.path.exists(sent) else path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
        _encoders[path] = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def token_count(text: Column, path: str = TOKENIZER) -> Column:
    SparkSession.active().sparkContext.addFile(path)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoder(path)
        for s in batches:
            yield pd.Series([len(enc.encode_ordinary(t)) if t else 0 for t in s], dtype="int64")

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, T.LongType())(text)


def canonical_source(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(c)), "[\\s-]+", "_")


def sized_documents(docs: DataFrame, targets: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, tokens): one row per distinct text of a target's source."""
    t = targets.select(canonical_source(F.col("source")).alias("source")).where("source is not null").distinct()
    d = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), canonical_source(F.col("source")).alias("source"), F.col("text").alias("_t"))
    d = d.where("doc_id is not null").where(~F.col("_t").rlike("(?U)^\\s*$")).join(t, "source", "left_semi")
    d = d.select("doc_id", "source", token_count(F.col("_t"), path).alias("tokens"), F.xxhash64("_t").alias("h1"), F.xxhash64("_t", F.lit(1)).alias("h2"))
    one = d.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "source", "tokens")).alias("m"))
    return one.select("m.doc_id", "m.source", "m.tokens")


def flight(tokens: np.ndarray, pi: np.ndarray, seed: int) -> np.ndarray:
    """The flight phase on one block: all but at most two probabilities end at 0 or 1; count and tokens stay balanced."""
    rng = np.random.default_rng(seed)
    p = [float(x) for x in pi]
    x = [float(v) for v in tokens]
    start = list(p)
    todo = list(rng.permutation(len(p)))
    live: list[int] = []
    eps = 1e-9
    while True:
        live = [i for i in live if eps < p[i] < 1 - eps]
        while len(live) < 3 and todo:
            i = int(todo.pop())
            if eps < p[i] < 1 - eps:
                live.append(i)
        if len(live) < 3:
            return np.round(np.array(p), 9)
        i, j, k = live
        # Null space of the columns (1, x) / start of the three.
        a1, b1, c1 = 1 / start[i], 1 / start[j], 1 / start[k]
        a2, b2, c2 = x[i] * a1, x[j] * b1, x[k] * c1
        u = [b1 * c2 - c1 * b2, c1 * a2 - a1 * c2, a1 * b2 - b1 * a2]
        if max(map(abs, u)) < 1e-12:
            # All alike: any direction that keeps the count.
            u = [1 / a1, -1 / b1, 0.0]
        up = down = math.inf
        for v, q in zip(u, (p[i], p[j], p[k])):
            if v > 0:
                up, down = min(up, (1 - q) / v), min(down, q / v)
            elif v < 0:
                up, down = min(up, -q / v), min(down, -(1 - q) / v)
        step = up if rng.random() * (up + down) < down else -down
        for v, n in zip(u, (i, j, k)):
            p[n] = min(1.0, max(0.0, p[n] + step * v))
            p[n] = 0.0 if p[n] < eps else 1.0 if p[n] > 1 - eps else p[n]


def _flight_pdf(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("doc_id", ignore_index=True)
    seed = int(pdf["doc_id"].iloc[0]) & 0x7FFFFFFF
    return pdf.assign(pi=flight(pdf["tokens"].to_numpy(), pdf["pi"].to_numpy(), seed))


def _land_pdf(pdf: pd.DataFrame) -> pd.DataFrame:
    """Landing: of all roundings of the last probabilities the one nearest to the balance of tokens, then of documents."""
    pdf = _flight_pdf(pdf)
    p, x = pdf["pi"].to_numpy().copy(), pdf["tokens"].to_numpy(dtype=float)
    left = np.flatnonzero((p > 0) & (p < 1))
    best = None
    for bits in range(1 << len(left)):
        s = np.array([bits >> n & 1 for n in range(len(left))], dtype=float)
        miss = (abs(((s - p[left]) * x[left]).sum()), abs((s - p[left]).sum()))
        best = min(best, (miss, bits)) if best else (miss, bits)
    if best:
        p[left] = [best[1] >> n & 1 for n in range(len(left))]
    return pdf.assign(pi=p)


_COLUMNS = ["doc_id", "source", "tokens", "whole", "pi"]
_SCHEMA = "doc_id bigint, source string, tokens bigint, whole int, pi double"


def _blocked(df: DataFrame, sizes: dict[str, int], salt: int) -> DataFrame:
    number = F.create_map(*[x for s, n in sizes.items() for x in (F.lit(s), F.lit(max(1, math.ceil(1.1 * n / BLOCK))))])
    return df.withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit(salt)), number[F.col("source")]))


def mix_plan(sized: DataFrame, targets: DataFrame, total_tokens: int | str | None = None) -> list[dict]:
    """One row per target: what it has, its budget of tokens, whole repeats and the probability of one more."""
    have = {r["source"]: (r["n"], r["tokens"]) for r in sized.groupBy("source").agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens")).collect()}
    want = targets.groupBy(canonical_source(F.col("source")).alias("source")).agg(F.sum(F.coalesce("target_share", F.lit(0.0))).alias("share"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("cap")).where("source is not null").orderBy("source").collect()
    full = [have[w["source"]][1] * w["cap"] / w["share"] for w in want if w["source"] in have and w["share"] > 0 and have[w["source"]][1] > 0]
    if total_tokens == AVAILABLE:
        total = sum(have[w["source"]][1] for w in want if w["source"] in have and w["share"] > 0)
    else:
        total = total_tokens if total_tokens is not None else (min(full) if full else 0)
    out = []
    for w in want:
        n, tokens = have.get(w["source"], (0, 0))
        rate = min(total * w["share"] / tokens, w["cap"]) if tokens else 0.0
        whole = int(math.floor(rate + 1e-12))
        out.append({"source": w["source"], "share": w["share"], "cap": w["cap"], "n": n, "available": tokens, "budget": total * w["share"], "whole": whole, "pi": max(0.0, rate - whole) if rate - whole > 1e-12 else 0.0})
    return out


def _mixed(docs: DataFrame, targets: DataFrame, total_tokens: int | str | None, path: str) -> tuple[DataFrame, list[dict]]:
    sized = materialize(sized_documents(docs, targets, path), "mix-sizes")
    plan = mix_plan(sized, targets, total_tokens)
    spark = docs.sparkSession
    terms = spark.createDataFrame([(p["source"], p["whole"], p["pi"]) for p in plan], "source string, whole int, pi double")
    df = sized.join(F.broadcast(terms), "source").select(*_COLUMNS)
    open_, n, done, salt = df.where("pi > 0"), {p["source"]: p["n"] for p in plan if p["pi"] > 0 and p["n"]}, [df.where("pi = 0")], 0
    while n and max(n.values()) > BLOCK // 2:
        flown = materialize(_blocked(open_, n, salt).groupBy("source", "block").applyInPandas(lambda pdf: _flight_pdf(pdf[_COLUMNS]), _SCHEMA), "mix-flight")
        done.append(flown.where("pi = 0 or pi = 1"))
        open_, salt = flown.where("pi > 0 and pi < 1"), salt + 1
        n = {r["source"]: r["count"] for r in open_.groupBy("source").count().collect()}
    done.append(open_.groupBy("source").applyInPandas(_land_pdf, _SCHEMA))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select("doc_id", "source", "tokens", (F.col("whole") + F.col("pi").cast("int")).alias("copies")), plan


def mix_sources(docs: DataFrame, targets: DataFrame, total_tokens: int | str | None = None, path: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, tokens, copies): the documents of the mix and how often each is used."""
    return _mixed(docs, targets, total_tokens, path)[0].where("copies > 0")


def mix_report(docs: DataFrame, targets: DataFrame, total_tokens: int | str | None = None, path: str = TOKENIZER) -> DataFrame:
    """Per target: target and actual share, documents and tokens used, the highest repeat, and whether the cap binds."""
    mixed, plan = _mixed(docs, targets, total_tokens, path)
    used = mixed.where("copies > 0").groupBy("source").agg(F.count("*").alias("documents"), F.sum(F.col("tokens") * F.col("copies")).alias("used_tokens"), F.max("copies").cast("bigint").alias("most_copies"))
    asked = docs.sparkSession.createDataFrame([(p["source"], p["share"], int(p["cap"]), p["n"], p["available"], p["n"] > 0 and p["whole"] >= p["cap"]) for p in plan], "source string, target_share double, max_repeats int, available_documents bigint, available_tokens bigint, cap_reached boolean")
    out = asked.join(used, "source", "left").fillna(0, ["documents", "used_tokens", "most_copies"])
    whole = used.agg(F.sum("used_tokens").alias("_all"))
    return out.crossJoin(F.broadcast(whole)).withColumn("actual_share", F.when(F.col("_all") > 0, F.col("used_tokens") / F.col("_all")).otherwise(0.0)).drop("_all")
