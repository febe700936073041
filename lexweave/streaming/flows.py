"""Streams: continuous ingestion with deduplication, and chat memory as keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lexweave.config import DEFAULT, Config
from lexweave.functions import text as X
from lexweave.operators import ingest as I
from lexweave.runtime import materialize, release

UPLOAD_SCHEMA = "upload_id bigint, source string, text string, size_bytes bigint, received_at timestamp_ntz"


def ingest_stream(spark: SparkSession, folder: str, chunk_path: str, registry_path: str, checkpoint: str, cfg: Config = DEFAULT, create_time: str | None = None) -> StreamingQuery:
    """Parquet uploads arriving in a folder become chunks once; chunks carry the batch, so a repeated batch is replaced.

    Each batch writes its chunks and hashes under its own number: writing it again after a failure overwrites them.
    """

    def one(batch: DataFrame, number: int) -> None:
        s = batch.sparkSession
        fs_path = s._jvm.org.apache.hadoop.fs.Path(registry_path)
        there = fs_path.getFileSystem(s._jsc.hadoopConfiguration()).exists(fs_path)
        known = s.read.option("basePath", registry_path).parquet(registry_path).where(F.col("batch") != number).select("md5") if there else s.createDataFrame([], "md5 string")
        d = batch.withColumn("cleaned", I.clean_text(F.col("text"), cfg)).withColumn("md5", X.md5_hex(F.col("cleaned")))
        # Both are used by the two writes below, so they are made once.
        fresh = materialize(I.new_documents(d, known, "upload_id", ["received_at"]), "stream-uploads")
        units = materialize(I.article_units(fresh, "upload_id", "cleaned"), "stream-units")
        chunks = I.with_metadata(I.pack_chunks(units, "upload_id", cfg.chunk_size), units, fresh, "upload_id", create_time=create_time)
        chunks.write.mode("overwrite").parquet(f"{chunk_path}/batch={number}")
        fresh.join(units.select("upload_id").distinct(), "upload_id", "left_semi").select("md5").distinct().write.mode("overwrite").parquet(f"{registry_path}/batch={number}")
        release(units, fresh)

    stream = spark.readStream.schema(UPLOAD_SCHEMA).parquet(folder)
    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


STATE = "kinds array<string>, contents array<string>, summary string"
OUT = "session_id string, rounds int, tokens bigint, summary string"


def memory_stream(messages: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Per session the state of its compressed memory after each batch of messages (session_id, pos, type, content).

    The state holds at most the kept rounds and one clipped summary.
    """
    tag, sep = cfg.summary_tag, cfg.line_sep
    cost = lambda c: max(1, len(c or "") // 2) + 6

    def update(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kinds, contents, summary = state.get if state.exists else ([], [], "")
        items = list(zip(kinds, contents))
        new = pd.concat(list(pdfs)).sort_values("pos")
        for t, c in zip(new["type"], new["content"]):
            t = {"user": "human", "assistant": "ai"}.get(t, t)
            if t == "system" and c and c.startswith(tag):
                summary = c[len(tag) :].strip()
            else:
                items.append((t, c or ""))
        rounds: list[list] = []
        for m in items:
            if not rounds or m[0] == "human":
                rounds.append([])
            rounds[-1].append(m)
        older, recent = rounds[: -cfg.keep], rounds[-cfg.keep :]
        if cfg.summary_enabled and len(rounds) >= cfg.trigger and older:
            label = {"human": "用户", "ai": "助手"}
            lines = sep.join(f"[{label.get(t, '系统')}] {c}" for r in older for t, c in r)
            summary = sep.join(filter(None, [summary, lines])).strip()[: cfg.summary_chars]
        head = cost(f"{tag}{sep}{summary}") if summary else 0
        while len(recent) > 1 and head + sum(cost(c) for r in recent for _, c in r) > cfg.budget:
            recent = recent[1:]
        flat = [m for r in recent for m in r]
        state.update(([t for t, _ in flat], [c for _, c in flat], summary))
        yield pd.DataFrame({"session_id": [key[0]], "rounds": [len(recent)], "tokens": [head + sum(cost(c) for _, c in flat)], "summary": [summary]})

    return messages.groupBy("session_id").applyInPandasWithState(update, OUT, STATE, "update", GroupStateTimeout.NoTimeout)
