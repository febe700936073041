"""Ingestion: cleaning, deduplication, structure, chunking, metadata.

Cleaning is one projection per document (no shuffle). Structure needs one shuffle by document, which all windows and
the packing share; a window never holds more than one document. Null and empty texts have no lines and no chunks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.config import DEFAULT, Config
from lexweave.functions import text as X


def clean_text(c: Column, cfg: Config = DEFAULT) -> Column:
    """Body of a statute: lines stripped, noise and the contents list removed, the headings in force kept."""
    ls = F.filter(X.lines(X.body_start(X.unix_lines(c))), lambda x: ~X.is_noise(x, cfg.title_lines))
    marked = F.transform(ls, lambda x: F.struct(x.alias("line"), X.line_kind(x).alias("kind")))
    first = F.array_position(F.transform(marked, lambda m: m["kind"]), F.lit("a")).cast("int")
    state = F.aggregate(
        F.slice(marked, F.lit(1), F.greatest(first - 1, F.lit(0))),
        F.struct(F.lit("").alias("p"), F.lit("").alias("c"), F.lit("").alias("s")),
        lambda a, m: F.struct(
            F.when(m["kind"] == "p", m["line"]).otherwise(a["p"]).alias("p"),
            F.when(m["kind"] == "p", "").when(m["kind"] == "c", m["line"]).otherwise(a["c"]).alias("c"),
            F.when(m["kind"].isin("p", "c"), "").when(m["kind"] == "s", m["line"]).otherwise(a["s"]).alias("s"),
        ),
        lambda a: F.filter(F.array(a["p"], a["c"], a["s"]), lambda x: x != ""),
    )
    kept = F.when(first > 0, F.concat(state, F.slice(ls, first, F.size(ls)))).otherwise(ls)
    return F.when(F.length(c) > 0, X.strip(F.array_join(kept, "\n"))).otherwise(c)


def new_documents(docs: DataFrame, registry: DataFrame, key: str, arrival: list[str], md5: str = "md5") -> DataFrame:
    """Documents whose hash is not registered, the first arrival of each hash."""
    fresh = docs.join(registry.select(F.lower(F.trim("md5")).alias(md5)).distinct(), md5, "left_anti")
    order = F.struct(*[F.col(a) for a in arrival], F.col(key))
    first = fresh.groupBy(md5).agg(F.min(order).alias("_f")).select(md5, F.col(f"_f.{key}").alias(key))
    return fresh.join(first, [md5, key], "left_semi")


def document_lines(docs: DataFrame, key: str, cleaned: str) -> DataFrame:
    """(key, pos, line, kind) of cleaned texts, article labels inside a line broken out first."""
    # A plain posexplode() would filter for empty arrays first, and so clean every text twice.
    d = docs.select(key, F.posexplode_outer(X.lines(X.break_articles(F.col(cleaned)))).alias("pos", "line")).where("line is not null")
    return d.withColumn("kind", X.line_kind(F.col("line")))


def article_units(docs: DataFrame, key: str, cleaned: str) -> DataFrame:
    """(key, unit_ord, part, chapter, section, article_no, text): articles with the headings in force above them."""
    w = Window.partitionBy(key).orderBy("pos")
    line, kind = F.col("line"), F.col("kind")

    def carried(own: str, resets: list[str]) -> Column:
        return F.coalesce(F.last(F.when(kind == own, line).when(kind.isin(resets), "") if resets else F.when(kind == own, line), ignorenulls=True).over(w), F.lit(""))

    rows = document_lines(docs, key, cleaned).withColumns({"unit_ord": F.sum((kind == "a").cast("int")).over(w), "part": carried("p", []), "chapter": carried("c", ["p"]), "section": carried("s", ["p", "c"])})
    rows = rows.where("unit_ord > 0 and kind in ('a', 't')")
    parts = F.array_sort(F.collect_list(F.struct("pos", "line")))
    head = F.min(F.struct("pos", "part", "chapter", "section", "line"))
    out = rows.groupBy(key, "unit_ord").agg(head.alias("h"), X.strip(F.array_join(F.transform(parts, lambda x: x["line"]), "\n")).alias("text"))
    return out.select(key, "unit_ord", "h.part", "h.chapter", "h.section", F.regexp_extract("h.line", f"^({X.ARTICLE})", 1).alias("article_no"), "text")


def chapter_ends(units: DataFrame, key: str) -> DataFrame:
    """(key, chapter, article_end): the last article of each chapter, by its heading alone."""
    return units.where("chapter <> '' and article_no <> ''").groupBy(key, "chapter").agg(F.max_by("article_no", "unit_ord").alias("article_end"))


def _scoped(units: DataFrame, key: str) -> DataFrame:
    """One row per (document, chapter, section) with its units in order; members need not be neighbours."""
    u = F.struct("unit_ord", F.length("text").alias("len"), "part", "article_no", "text")
    return units.groupBy(key, "chapter", "section").agg(F.array_sort(F.collect_list(u)).alias("us"))


def pack_chunks(units: DataFrame, key: str, max_chars: int = DEFAULT.chunk_size) -> DataFrame:
    """(key, chapter, section, scope_ord, chunk_no, first, last, units): greedy packing without overlap, as one fold."""
    start = F.struct(F.lit(0).alias("len"), F.lit(0).alias("no"), F.array().cast("array<int>").alias("out"))

    def add(a: Column, x: Column) -> Column:
        over = (a["len"] > 0) & (a["len"] + 1 + x["len"] > max_chars)
        size = F.when(over | (a["len"] == 0), x["len"]).otherwise(a["len"] + 1 + x["len"])
        no = F.when(over | (a["no"] == 0), a["no"] + 1).otherwise(a["no"])
        return F.struct(size.alias("len"), no.alias("no"), F.concat(a["out"], F.array(no)).alias("out"))

    s = _scoped(units, key).withColumn("nos", F.aggregate("us", start, add, lambda a: a["out"]))
    s = s.select(key, "chapter", "section", F.element_at("us", 1)["unit_ord"].alias("scope_ord"), F.explode(F.arrays_zip("us", "nos")).alias("z"))
    s = s.select(key, "chapter", "section", "scope_ord", F.col("z.nos").alias("chunk_no"), "z.us.*")
    return _chunk_rows(s, key)


def pack_chunks_overlapping(units: DataFrame, key: str, max_chars: int, overlap: int) -> DataFrame:
    """The same with whole articles repeated: the next chunk starts overlap articles back, suffix chunks included.

    The end of the chunk that starts at an article follows from running lengths by a search; only the chain of starts is
    walked, which no built-in expression carries with overlap. One scope of one document is one small group.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("unit_ord", ignore_index=True)
        # Every article costs its length and a line break; a chunk from i to e - 1 saves one break.
        upto = np.concatenate([[0], np.cumsum(pdf["len"].to_numpy() + 1)])
        ends = np.maximum(np.searchsorted(upto, upto[:-1] + max_chars + 1, side="right") - 1, np.arange(1, len(upto)))
        following = np.maximum(ends - overlap, np.arange(1, len(upto)))
        starts = [0]
        while following[starts[-1]] < len(pdf):
            starts.append(int(following[starts[-1]]))
        size = ends[starts] - np.array(starts)
        at = np.arange(size.sum()) + np.repeat(np.array(starts) - (np.cumsum(size) - size), size)
        number = np.repeat(np.arange(1, len(starts) + 1, dtype="int32"), size)
        return pdf.iloc[at].reset_index(drop=True).assign(chunk_no=number, scope_ord=pdf["unit_ord"].iloc[0])[cols]

    flat = units.select(key, "chapter", "section", "unit_ord", F.length("text").alias("len"), "part", "article_no", "text")
    types = dict(flat.dtypes)
    cols = [key, "chapter", "section", "scope_ord", "chunk_no", "unit_ord", "len", "part", "article_no", "text"]
    schema = ", ".join(f"`{c}` {'int' if c == 'chunk_no' else types['unit_ord'] if c == 'scope_ord' else types[c]}" for c in cols)
    return _chunk_rows(flat.groupBy(key, "chapter", "section").applyInPandas(run, schema), key)


def _chunk_rows(rows: DataFrame, key: str) -> DataFrame:
    by = rows.groupBy(key, "chapter", "section", "scope_ord", "chunk_no")
    parts = F.array_sort(F.collect_list(F.struct("unit_ord", "text")))
    return by.agg(
        F.min_by("part", "unit_ord").alias("part"),
        F.min_by("article_no", "unit_ord").alias("article_no"),
        F.max_by("article_no", "unit_ord").alias("chunk_article_end"),
        F.count("*").alias("n_units"),
        X.strip(F.array_join(F.transform(parts, lambda x: x["text"]), "\n")).alias("text"),
    )


def with_metadata(chunks: DataFrame, units: DataFrame, docs: DataFrame, key: str, operator: str = "", create_time: str | None = None) -> DataFrame:
    """Chunks with source, operator, creation time and the last article of their chapter."""
    when = F.lit(create_time) if create_time is not None else F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss")
    out = chunks.join(chapter_ends(units, key), [key, "chapter"], "left").join(docs.select(key, "source"), key, "left")
    return out.withColumns({"article_end": F.coalesce("article_end", "chunk_article_end"), "operator": F.lit(operator), "create_time": when, "source": F.coalesce("source", F.lit(""))})


def ingest(docs: DataFrame, registry: DataFrame, key: str = "upload_id", arrival: tuple[str, ...] = ("received_at",), cfg: Config = DEFAULT, create_time: str | None = None, hash_of: str = "cleaned") -> DataFrame:
    """Chunks of the documents not stored so far. hash_of: whether a document's hash is that of its cleaned or raw text."""
    d = docs.withColumn("cleaned", clean_text(F.col("text"), cfg))
    d = new_documents(d.withColumn("md5", X.md5_hex(F.col("cleaned" if hash_of == "cleaned" else "text"))), registry, key, list(arrival))
    units = article_units(d, key, "cleaned")
    packed = pack_chunks(units, key, cfg.chunk_size) if cfg.chunk_overlap_articles == 0 else pack_chunks_overlapping(units, key, cfg.chunk_size, cfg.chunk_overlap_articles)
    return with_metadata(packed, units, d, key, create_time=create_time)


def plain_chunks(docs: DataFrame, key: str, cleaned: str, size: int) -> DataFrame:
    """(key, ord, text): cleaned texts cut every size characters, headings and all, as stored before structure was kept."""
    d = docs.where(F.length(cleaned) > 0).select(key, F.col(cleaned).alias("_t"), F.explode_outer(F.sequence(F.lit(0), F.floor((F.length(cleaned) - 1) / size).cast("int"))).alias("ord"))
    return d.select(key, F.col("ord").cast("bigint").alias("ord"), F.substring("_t", F.col("ord") * size + 1, F.lit(size)).alias("text"))


def ingest_status(docs: DataFrame, registry: DataFrame, key: str = "upload_id", arrival: tuple[str, ...] = ("received_at",), cfg: Config = DEFAULT, hash_of: str = "cleaned") -> DataFrame:
    """(key, md5, status): repeat, warn (no article found or nothing in it, hash not kept) or success.

    A null text counts as an empty one.
    """
    docs = docs.withColumn("text", F.coalesce("text", F.lit("")))
    d = docs.withColumn("cleaned", clean_text(F.col("text"), cfg)).withColumn("md5", X.md5_hex(F.col("cleaned" if hash_of == "cleaned" else "text")))
    some = F.exists(X.lines(X.break_articles(F.col("cleaned"))), lambda x: X.line_kind(x) == "a")
    d = d.select(key, "md5", *arrival, F.coalesce(some, F.lit(False)).alias("some"))
    known = registry.select(F.lower(F.trim("md5")).alias("md5"), F.lit(True).alias("known")).distinct()
    first = d.groupBy("md5").agg(F.min(F.struct(*arrival, key)).alias("f"))
    d = d.join(known, "md5", "left").join(first.select("md5", F.col(f"f.{key}").alias("first_key")), "md5", "left")
    again = F.coalesce("known", F.lit(False)) | (F.col("some") & (F.col(key) != F.col("first_key")))
    return d.select(key, "md5", F.when(again, "repeat").when(~F.col("some"), "warn").otherwise("success").alias("status"))


def line_chapter_ends(docs: DataFrame, key: str, cleaned: str) -> DataFrame:
    """(key, chapter, article_end): the last article label named anywhere under each chapter, references included."""
    ls = docs.select(key, F.posexplode_outer(X.lines(F.col(cleaned))).alias("pos", "line")).where("line is not null")
    chapter = ls["line"].rlike(X.CHAPTER)
    w = Window.partitionBy(key).orderBy("pos")
    ls = ls.withColumns({"chapter": F.last(F.when(chapter, ls["line"]), ignorenulls=True).over(w), "last_no": F.when(~chapter, X.last_match(F.col("line"), X.ARTICLE))})
    return ls.where("chapter is not null and last_no is not null").groupBy(key, "chapter").agg(F.max_by("last_no", "pos").alias("article_end"))


def carried_metadata(chunks: DataFrame, key: str, order: str, ends: DataFrame) -> DataFrame:
    """Metadata of plain chunks: headings found in a chunk hold until others follow. Other columns are kept."""
    w = Window.partitionBy(key).orderBy(order)
    found = {k: X.last_match(F.col("text"), X.heading_lines(c)) for k, c in (("_p", "编"), ("_c", "章"), ("_s", "节"))}
    d = chunks.withColumns(found | {"_nos": X.all_matches(F.col("text"), X.ARTICLE)})
    hit = {k: F.col(k).isNotNull() for k in ("_p", "_c", "_s")}
    last = lambda c: F.coalesce(F.last(c, ignorenulls=True).over(w), F.lit(""))
    d = d.withColumns(
        {
            "part": last(F.col("_p")),
            "chapter": last(F.coalesce("_c", F.when(hit["_p"], ""))),
            "section": last(F.coalesce("_s", F.when(hit["_p"] | hit["_c"], ""))),
            "_carry": F.last(F.try_element_at("_nos", F.lit(-1)), ignorenulls=True).over(w),
        }
    )
    d = d.withColumns({"article_no": F.coalesce(F.try_element_at("_nos", F.lit(1)), "_carry", F.lit("")), "chunk_article_end": F.coalesce(F.try_element_at("_nos", F.lit(-1)), F.lit(""))})
    d = d.join(ends.select(key, "chapter", F.col("article_end").alias("_e")), [key, "chapter"], "left")
    return d.withColumn("article_end", F.coalesce(F.nullif("_e", F.lit("")), "chunk_article_end")).drop("_p", "_c", "_s", "_nos", "_carry", "_e")


def insert_batches(chunks: DataFrame, key: str, order: list[str], size: int = DEFAULT.insert_batch) -> DataFrame:
    """A batch number from 0 for every chunk of a document, in order."""
    w = Window.partitionBy(key).orderBy(*order)
    return chunks.withColumn("batch", F.floor((F.row_number().over(w) - 1) / size))


def embed_in_batches(chunks: DataFrame, embed, dimension_type: str = "array<float>", size: int = DEFAULT.insert_batch) -> DataFrame:
    """Chunks with an embedding from embed(list of texts), called on batches of the given size inside each partition."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            vectors: list = []
            for i in range(0, len(pdf), size):
                got = embed(pdf["text"].iloc[i : i + size].tolist())
                if len(got) != len(pdf["text"].iloc[i : i + size]):
                    raise ValueError("texts and vectors differ in number")
                vectors += [list(map(float, v)) for v in got]
            yield pdf.assign(embedding=vectors)

    return chunks.mapInPandas(run, ", ".join([*(f"`{c}` {t}" for c, t in chunks.dtypes), f"embedding {dimension_type}"]))
