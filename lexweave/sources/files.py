"""Files in and tables out: uploads, session histories, session metadata, the chunk store and its registry."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.functions import text as X
from lexweave.runtime import delete_at_exit, scratch_path

MESSAGE_JSON = "array<struct<type:string,data:struct<content:string,type:string>>>"
META_JSON = "map<string,struct<pinned:boolean>>"


def read_uploads(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(source, text, size_bytes, received_at) of .txt files in strict UTF-8, and those that do not decode."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").option("recursiveFileLookup", "true").load(path)
    d = raw.select(F.element_at(F.split("path", "/"), -1).alias("source"), F.try_validate_utf8(F.col("content").cast("string")).alias("text"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("received_at"))
    return d.where("text is not null"), d.where("text is null").drop("text")


def read_sessions(spark: SparkSession, path: str, names: str = "chat_*") -> DataFrame:
    """(session_id, pos, type, content, stored_at) of files named chat_*; a broken file is an empty session."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", names).load(path)
    d = raw.select(F.element_at(F.split("path", "/"), -1).alias("session_id"), F.col("modificationTime").alias("stored_at"), F.coalesce(F.from_json(F.col("content").cast("string"), MESSAGE_JSON), F.array().cast(MESSAGE_JSON)).alias("ms"))
    return d.select("session_id", "stored_at", F.posexplode("ms").alias("pos", "m")).select("session_id", F.col("pos").cast("bigint").alias("pos"), X.canonical_type(F.col("m.type")).alias("type"), F.col("m.data.content").alias("content"), "stored_at")


def read_session(spark: SparkSession, path: str, session_id: str) -> DataFrame:
    """One session's messages: only its file is opened. No row where there is none or the name is no session's."""
    if not re.fullmatch(X.VALID_SESSION_ID, session_id):
        return read_sessions(spark, path).limit(0)
    return read_sessions(spark, path, session_id)


def read_session_meta(spark: SparkSession, path: str) -> DataFrame:
    """(session_id, pinned) of one JSON file, parsed in a task; a missing entry, file or a broken file has no rows.

    Spark's readers pass over names that begin with a dot, so such a file is copied first, by the file system.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(conf)
    if not fs.exists(p):
        return spark.createDataFrame([], "session_id string, pinned boolean")
    if p.getName().startswith((".", "_")):
        seen = jvm.org.apache.hadoop.fs.Path(scratch_path(spark, "session-meta"))
        jvm.org.apache.hadoop.fs.FileUtil.copy(fs, p, seen.getFileSystem(conf), seen, False, conf)
        path = seen.toString()
        delete_at_exit(spark, path)
    raw = spark.read.text(path, wholetext=True)
    entries = F.explode_outer(F.coalesce(F.from_json("value", META_JSON), F.create_map().cast(META_JSON))).alias("session_id", "m")
    return raw.select(entries).where("session_id is not null").select("session_id", F.coalesce("m.pinned", F.lit(False)).alias("pinned"))


def save_session_meta(pins: DataFrame, path: str) -> None:
    """Write (session_id, pinned) as one JSON file that read_session_meta() reads; one row per session, the file's form."""
    entry = F.struct(F.coalesce("pinned", F.lit(False)).alias("pinned"))
    whole = pins.where("session_id is not null").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("session_id", entry))))).alias("value"))
    spark = pins.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    made, target = jvm.org.apache.hadoop.fs.Path(scratch_path(spark, "session-meta")), jvm.org.apache.hadoop.fs.Path(path)
    whole.coalesce(1).write.text(made.toString())
    fs, to = made.getFileSystem(conf), target.getFileSystem(conf)
    part = next(f.getPath() for f in fs.listStatus(made) if f.getPath().getName().startswith("part-"))
    jvm.org.apache.hadoop.fs.FileUtil.copy(fs, part, to, target, False, True, conf)
    fs.delete(made, True)


def session_json(messages: DataFrame) -> DataFrame:
    """(session_id, json): histories in their file form; sessions are compressed first, so a group is bounded."""
    one = F.struct(F.col("type"), F.struct(F.coalesce("content", F.lit("")).alias("content"), F.col("type")).alias("data"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("ord", one.alias("m")))), lambda x: x["m"])
    return messages.groupBy("session_id").agg(F.to_json(ordered).alias("json"))


def all_documents(d: DataFrame) -> DataFrame:
    """Every chunk of a chunk store, null strings as empty ones, without the vectors."""
    keep = [c for c in d.columns if c != "embedding"]
    return d.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) if t == "string" else F.col(c) for c, t in d.dtypes if c in keep])


def append_chunks(chunks: DataFrame, path: str) -> None:
    chunks.write.mode("append").parquet(path)


def append_fingerprints(docs: DataFrame, path: str) -> None:
    """Only after the chunks are written, so a crash between the two is repaired by the next run."""
    docs.select("md5").distinct().write.mode("append").parquet(path)


def clear_session(spark: SparkSession, path: str, session_id: str) -> None:
    """Leave an empty history under a valid session name."""
    if spark.range(1).where(F.lit(session_id).rlike(X.VALID_SESSION_ID)).isEmpty():
        raise ValueError("no session name")
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{session_id}")
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    out.write(bytearray(b"[]"))
    out.close()
