"""Sessions: labels, listing, pins, deletion, display.

Nothing here sorts or windows over one session's messages; labels and times are aggregates that combine map-side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexweave.config import DEFAULT, Config
from lexweave.functions import text as X
from lexweave.runtime import materialize


def latest_pins(meta: DataFrame) -> DataFrame:
    """(session_id, pinned): the newest row of each session; null counts as not pinned."""
    order = F.struct(F.col("updated_at"), F.coalesce("pinned", F.lit(False)))
    return meta.where("session_id is not null").groupBy("session_id").agg(F.coalesce(F.max_by("pinned", order), F.lit(False)).alias("pinned"))


def is_pinned(meta: DataFrame, session_id: str) -> DataFrame:
    return latest_pins(meta).where(F.col("session_id") == session_id)


def session_labels(messages: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """(session_id, label): the start of the first human message, a default where there is none."""
    human = X.canonical_type(F.col("type")) == "human"
    first = F.min(F.when(human & F.col("content").isNotNull(), F.struct("pos", "msg_id", "content")))
    d = messages.where("session_id is not null").groupBy("session_id").agg(first.alias("f"))
    text = F.substring(X.strip(F.col("f.content")), 1, cfg.label_chars)
    return d.select("session_id", F.coalesce(F.nullif(text, F.lit("")), F.lit(cfg.default_label)).alias("label"))


def list_sessions(messages: DataFrame, meta: DataFrame) -> DataFrame:
    """(session_id, pinned, last_stored): pinned first, then newest, then by name; only names that begin with chat_."""
    s = messages.where(F.startswith("session_id", F.lit("chat_"))).groupBy("session_id").agg(F.max("stored_at").alias("last_stored"))
    d = s.join(latest_pins(meta), "session_id", "left").withColumn("pinned", F.coalesce("pinned", F.lit(False)))
    return d.select("session_id", "pinned", "last_stored").orderBy(F.desc("pinned"), F.desc("last_stored"), F.lower("session_id"))


def numbered(df: DataFrame, *order) -> DataFrame:
    """df with its place (from 1) in the given order: sorted by ranges, counted per range, no single task for all rows."""
    d = df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id())
    d = materialize(d.withColumns({"_range": F.shiftright("_at", 33), "_at": F.col("_at").bitwiseAND((1 << 33) - 1)}), "numbered")
    sizes = d.groupBy("_range").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # over one row per range
    offset = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return d.join(F.broadcast(offset), "_range").withColumn("place", F.col("_before") + F.col("_at") + 1).drop("_range", "_at", "_before")


def placed_sessions(messages: DataFrame, meta: DataFrame) -> DataFrame:
    """The list of sessions with the place of each."""
    return numbered(list_sessions(messages, meta), F.desc("pinned"), F.desc("last_stored"), F.lower("session_id"), F.col("session_id"))


def with_active(sessions: DataFrame, active: str) -> DataFrame:
    """The list with the active session at its head when it is not stored yet."""
    spark = sessions.sparkSession
    mine = spark.createDataFrame([(active,)], "session_id string").join(sessions.select("session_id"), "session_id", "left_anti")
    return mine.select("session_id", F.lit(False).alias("pinned"), F.lit(None).cast("timestamp_ntz").alias("last_stored"), F.lit(0).alias("place")).unionByName(sessions.withColumn("place", F.lit(1)))


def sidebar(messages: DataFrame, meta: DataFrame, active: str, cfg: Config = DEFAULT) -> DataFrame:
    """(session_id, label, pinned, active, last_stored)."""
    return list_sessions(messages, meta).join(session_labels(messages, cfg), "session_id").withColumn("active", F.col("session_id") == active)


def toggled_pins(log: DataFrame) -> DataFrame:
    """(session_id, pinned): pinned when toggled an odd number of times."""
    return log.where("session_id is not null").groupBy("session_id").agg((F.count("*") % 2 == 1).alias("pinned"))


def set_pins(meta: DataFrame, changes: DataFrame) -> DataFrame:
    """Metadata with changes (session_id, pinned, updated_at) put over it."""
    return latest_pins(meta.select("session_id", "pinned", "updated_at").unionByName(changes.select("session_id", "pinned", "updated_at")))


def toggle(meta: DataFrame, session_ids: DataFrame) -> DataFrame:
    """Pins with those of the given sessions turned over; unknown sessions become pinned."""
    hit = session_ids.select("session_id").distinct().withColumn("_hit", F.lit(True))
    d = latest_pins(meta).join(hit, "session_id", "full")
    pinned = F.coalesce("pinned", F.lit(False))
    return d.select("session_id", F.when(F.col("_hit"), ~pinned).otherwise(pinned).alias("pinned"))


def delete_sessions(rows: DataFrame, session_ids: DataFrame) -> DataFrame:
    """Messages or metadata without the given sessions; ids that are no session names are ignored."""
    return rows.join(session_ids.where(F.col("session_id").rlike(X.VALID_SESSION_ID)).select("session_id").distinct(), "session_id", "left_anti")


def apply_actions(meta: DataFrame, actions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A log (session_id, action, at) of new, pin, unpin and delete folded: (pins, sessions to delete)."""
    last = actions.groupBy("session_id").agg(F.max_by("action", "at").alias("last"), F.max_by("action", F.when(F.col("action").isin("pin", "unpin"), F.col("at"))).alias("pin"), F.max("at").alias("at"))
    gone = last.where("last = 'delete'").select("session_id")
    pins = set_pins(meta, last.where("pin in ('pin', 'unpin')").select("session_id", (F.col("pin") == "pin").alias("pinned"), F.col("at").alias("updated_at")))
    return pins.join(gone, "session_id", "left_anti"), gone


def display_history(messages: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """(session_id, pos, role, content) without summaries; a session with nothing to show has one greeting at 0."""
    from lexweave.operators.memory import stored_once

    m = stored_once(messages)
    seen = m.where(~X.is_summary(F.col("type"), F.col("content"), cfg.summary_tag)).select("session_id", "pos", X.ui_role(F.col("type")).alias("role"), F.coalesce("content", F.lit("")).alias("content"))
    bare = m.select("session_id").distinct().join(seen.select("session_id").distinct(), "session_id", "left_anti")
    return seen.unionByName(bare.select("session_id", F.lit(0).cast("bigint").alias("pos"), F.lit("assistant").alias("role"), F.lit(cfg.greeting).alias("content")))
