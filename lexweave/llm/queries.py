"""The pN_ queries: each operator with its production parameters over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.llm import leak, mix, neardup, pairs, pii, reading, split, unify
from lexweave.runtime import read_table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return split.split_texts(read_table(spark, d, "legal_chunker").select("chunk_id", "text")).where("piece_no = 2").select("chunk_id")


def p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    t = read_table(spark, d, "legal_chunker").select("chunk_id", "text", "article_no", "chapter", "section")
    return split.split_texts(t).select("chunk_id", "piece_no", "piece_start", "overlap_chars", "piece_text", "article_no", "chapter", "section")


def p1_rebuilt(spark: SparkSession, d: str) -> DataFrame:
    """Every text put together again from its pieces, and whether all of them keep the limits."""
    p = split.split_texts(read_table(spark, d, "legal_chunker").select("chunk_id", "text"))
    new = F.struct("piece_no", F.substring("piece_text", F.col("overlap_chars") + 1, F.length("piece_text")).alias("s"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(new)), lambda x: x["s"]), "")
    short = F.max(F.length("piece_text")) <= split.CHUNK_SIZE
    return p.groupBy("chunk_id").agg(whole.alias("text"), short.alias("short"), (F.max("overlap_chars") <= split.CHUNK_OVERLAP).alias("overlap_kept"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.duplicate_pairs(read_table(spark, d, "legal_chunker")).select(F.col("a").alias("chunk_id_a"), F.col("b").alias("chunk_id_b"))


def p2_classes(spark: SparkSession, d: str) -> DataFrame:
    t = read_table(spark, d, "legal_chunker").select("chunk_id", "text", "source")
    return neardup.duplicate_classes(t).join(t.select(F.col("chunk_id").alias("id"), "source"), "id").select(F.col("id").alias("chunk_id"), "class_id", "links", "source")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.find_pii(read_table(spark, d, "history_store"))


def p3_redacted(spark: SparkSession, d: str) -> DataFrame:
    return pii.redact(read_table(spark, d, "history_store"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return unify.changed_values(read_table(spark, d, "legal_chunker"), "chunk_id", ["text", "article_no"]).select("chunk_id", "field_name")


def p4_unified(spark: SparkSession, d: str) -> DataFrame:
    t = read_table(spark, d, "legal_chunker").select("chunk_id", "text", "article_no")
    return unify.unify(t, ["text", "article_no"]).withColumn("text_key", unify.key_column(F.col("text")))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return pairs.found_defects(read_table(spark, d, "history_store"))


def p5_flags(spark: SparkSession, d: str) -> DataFrame:
    return pairs.flag_defects(read_table(spark, d, "history_store")).select("msg_id", "defect", F.round("posterior", 6).alias("posterior"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return leak.leaked_items(read_table(spark, d, "documents"), read_table(spark, d, "eval_items")).select("doc_id", "item_id")


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return mix.mix_sources(read_table(spark, d, "documents"), read_table(spark, d, "mix_targets"))


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return mix.mix_report(read_table(spark, d, "documents"), read_table(spark, d, "mix_targets"))


def p7_available(spark: SparkSession, d: str) -> DataFrame:
    """The report of a mix as large as its sources: where a cap binds, a source falls short of its share."""
    return mix.mix_report(read_table(spark, d, "documents"), read_table(spark, d, "mix_targets"), mix.AVAILABLE)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return reading.reading_levels(read_table(spark, d, "documents"), read_table(spark, d, "reading_labels")).select("doc_id", "reading_level")


def p8_profile(spark: SparkSession, d: str) -> DataFrame:
    docs = read_table(spark, d, "documents")
    got = reading.reading_levels(docs, read_table(spark, d, "reading_labels"))
    by = docs.select("doc_id", mix.canonical_source(F.col("source")).alias("source"))
    return got.join(by, "doc_id").groupBy("source", "reading_level").agg(F.count("*").alias("documents"), F.round(F.avg("difficulty"), 4).alias("mean_difficulty"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p1_found, p1_pieces, p1_rebuilt, p2_found, p2_classes, p3_found, p3_redacted, p4_found, p4_unified, p5_found, p5_flags, p6_found, p7_mix, p7_report, p7_available, p8_found, p8_profile)}

# The other operators are no SQL: they are tested against brute force, round trips and held-out grades.
ORACLE_SQL: dict[str, str] = {
    "p1_found": "SELECT chunk_id FROM legal_chunker WHERE length(text) > 600",
    "p1_rebuilt": "SELECT chunk_id, text, true AS short, true AS overlap_kept FROM legal_chunker WHERE length(text) > 0",
}
