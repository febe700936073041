"""Chat memory: rounds, sliding window, summary, token budget.

Running sums are blocked: a session is cut into blocks of BLOCK positions, summed inside, and the blocks' totals are
summed in turn. So a session that holds a third of all messages spreads over many tasks. What is collected per session
(the start of a transcript, the recent rounds) is bounded by parameters.

Messages stored twice (same session and position) count once; null contents count as empty; an unknown type is treated
as system. Sessions without messages have no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.config import DEFAULT, Config
from lexweave.functions import text as X
from lexweave.runtime import materialize, release

BLOCK = 4096


def stored_once(messages: DataFrame) -> DataFrame:
    """(session_id, pos, msg_id, type, content): one row per session and position, the first stored."""
    m = messages.where("session_id is not null and pos is not null")
    return m.groupBy("session_id", "pos").agg(F.min(F.struct("msg_id", X.canonical_type(F.col("type")).alias("type"), "content")).alias("m")).select("session_id", "pos", "m.*")


def running_sum(df: DataFrame, keys: list[str], order: str, values: dict[str, Column], block: int = BLOCK) -> DataFrame:
    """df with inclusive running sums of values along order, per key, in blocks of positions."""
    d = df.withColumn("_block", F.floor(F.col(order) / block)).withColumns({f"_v_{n}": v for n, v in values.items()})
    inside = Window.partitionBy(*keys, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    totals = d.groupBy(*keys, "_block").agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in values])
    totals = totals.select(*keys, "_block", *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in values])
    local = d.withColumns({n: F.sum(f"_v_{n}").over(inside) for n in values})
    return local.join(totals, [*keys, "_block"]).withColumns({n: F.col(n) + F.col(f"_o_{n}") for n in values}).drop("_block", *[f"_{x}_{n}" for n in values for x in "vo"])


def rounds(messages: DataFrame, cfg: Config = DEFAULT, once: bool = False) -> DataFrame:
    """Messages that are no summary, with round_id from 0: a human message opens a round unless the round is empty.

    once: the messages come from stored_once() already.
    """
    m = (messages if once else stored_once(messages)).where(~X.is_summary(F.col("type"), F.col("content"), cfg.summary_tag))
    r = running_sum(m, ["session_id"], "pos", {"humans": (F.col("type") == "human").cast("bigint")})
    first = m.groupBy("session_id").agg(F.min(F.struct("pos", (F.col("type") == "human").cast("bigint").alias("h"))).alias("f")).select("session_id", F.col("f.h").alias("opens"))
    return r.join(first, "session_id").withColumn("round_id", F.col("humans") - F.coalesce("opens", F.lit(0))).drop("humans", "opens")


def session_rounds(messages: DataFrame, cfg: Config = DEFAULT, once: bool = False) -> DataFrame:
    """(session_id, rounds) of every session that has a message besides summaries."""
    m = (messages if once else stored_once(messages)).where(~X.is_summary(F.col("type"), F.col("content"), cfg.summary_tag))
    a = m.groupBy("session_id").agg(F.count_if(F.col("type") == "human").alias("h"), F.min(F.struct("pos", F.col("type"))).alias("f"))
    return a.select("session_id", (F.col("h") + F.when(F.coalesce(F.col("f.type") == "human", F.lit(False)), 0).otherwise(1)).alias("rounds"))


def old_summary(messages: DataFrame, cfg: Config = DEFAULT, once: bool = False) -> DataFrame:
    """(session_id, old_summary): the last tagged system message without its tag."""
    s = (messages if once else stored_once(messages)).where(X.is_summary(F.col("type"), F.col("content"), cfg.summary_tag))
    return s.groupBy("session_id").agg(F.max_by("content", "pos").alias("c")).select("session_id", X.without_tag(F.col("c"), cfg.summary_tag).alias("old_summary"))


def transcript(older: DataFrame, chars: int, cfg: Config = DEFAULT) -> DataFrame:
    """(session_id, transcript): labelled lines in order, the first chars characters of them.

    Lines that begin beyond the limit are filtered by their running length before anything is collected.
    """
    line = F.concat(F.lit("["), X.role_label(F.col("type")), F.lit("] "), F.coalesce("content", F.lit("")))
    sep = len(cfg.line_sep)
    d = older.select("session_id", "pos", line.alias("line"))
    d = running_sum(d, ["session_id"], "pos", {"upto": (F.length("line") + sep).cast("bigint")})
    start = F.col("upto") - F.length("line") - sep
    early = F.when(start <= chars, F.struct("pos", F.substring("line", 1, chars).alias("line")))
    # Where the whole transcript ends once blanks at its end are gone: only then may the clipped one end earlier.
    ends = F.max(start + F.length(F.regexp_replace("line", f"[{X.WS}]+\\z", "")))
    got = d.groupBy("session_id").agg(F.collect_list(early).alias("ls"), ends.alias("ends"))
    joined = F.array_join(F.transform(F.array_sort("ls"), lambda x: x["line"]), cfg.line_sep)
    return got.select("session_id", F.substring(joined, F.lit(1), F.least(F.lit(chars), F.col("ends")).cast("int")).alias("transcript"))


def fallback_summary(old: Column, lines: Column, cfg: Config = DEFAULT) -> Column:
    """Old summary and transcript, both without outer blanks, joined and clipped: the summary without a model."""
    both = F.concat_ws(cfg.line_sep, F.nullif(old, F.lit("")), F.nullif(lines, F.lit("")))
    return F.substring(both, 1, cfg.summary_chars)


def summary_prompt(old: Column, lines: Column, cfg: Config = DEFAULT) -> Column:
    """A request to a model for an updated summary."""
    none = F.lit("（无）")
    return F.concat(F.lit(f"请更新这段对话的摘要，保留事实、诉求、结论和未决问题。{cfg.line_sep}旧摘要：{cfg.line_sep}"), F.coalesce(F.nullif(old, F.lit("")), none), F.lit(f"{cfg.line_sep}新对话：{cfg.line_sep}"), F.coalesce(F.nullif(lines, F.lit("")), none))


def memory_state(messages: DataFrame, cfg: Config = DEFAULT, summarise=None, once: bool = False, numbered: DataFrame | None = None) -> DataFrame:
    """(session_id, total_rounds, triggered, summary): what the compression decides per session.

    summarise(old, transcript) -> Column replaces the clipped transcript, e.g. by a pandas UDF that calls a model.
    numbered: what rounds() gave for these messages, where it is at hand.
    """
    numbered = rounds(messages, cfg, once) if numbered is None else numbered
    total = session_rounds(messages, cfg, once).withColumnRenamed("rounds", "total_rounds")
    fire = total.where(F.lit(cfg.summary_enabled) & (F.col("total_rounds") >= cfg.trigger) & (F.col("total_rounds") > cfg.keep))
    older = numbered.join(fire, "session_id").where(F.col("round_id") < F.col("total_rounds") - cfg.keep)
    lines = transcript(older, cfg.summary_chars, cfg)
    d = total.join(old_summary(messages, cfg, once), "session_id", "full").join(lines, "session_id", "left")
    d = d.withColumns({"total_rounds": F.coalesce("total_rounds", F.lit(0)), "triggered": F.col("transcript").isNotNull(), "old_summary": F.coalesce("old_summary", F.lit(""))})
    new = (summarise or (lambda o, t: fallback_summary(o, t, cfg)))(F.col("old_summary"), F.col("transcript"))
    return d.select("session_id", "total_rounds", "triggered", F.when(F.col("triggered"), F.substring(new, 1, cfg.summary_chars)).otherwise(F.col("old_summary")).alias("summary"))


def kept_rounds(messages: DataFrame, state: DataFrame, cfg: Config = DEFAULT, numbered: DataFrame | None = None) -> DataFrame:
    """(session_id, round_id): recent rounds within the token budget, the newest always."""
    r = (rounds(messages, cfg) if numbered is None else numbered).join(state, "session_id")
    window = F.col("round_id") >= F.col("total_rounds") - cfg.keep
    r = r.where((window | ~F.col("triggered")) if cfg.lossless else window)
    per = r.groupBy("session_id", "round_id").agg(F.sum(X.message_tokens(F.col("content"))).alias("tokens"))
    text = F.concat(F.lit(cfg.summary_tag + cfg.line_sep), F.col("summary"))
    head = state.select("session_id", F.when(F.col("summary") != "", X.message_tokens(text)).otherwise(0).alias("head"))
    newest = Window.partitionBy("session_id").orderBy(F.desc("round_id"))
    upto = newest.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    per = per.join(head, "session_id").withColumns({"upto": F.sum("tokens").over(upto), "n": F.row_number().over(newest)})
    return per.where((F.col("n") == 1) | (F.col("head") + F.col("upto") <= cfg.budget)).select("session_id", "round_id", "tokens", "head")


def compress(messages: DataFrame, cfg: Config = DEFAULT, summarise=None) -> DataFrame:
    """(session_id, ord, type, content): the history after compression; the summary, if any, comes first as ord -1.

    Messages stored once, their rounds and the state are each read several times, so they are written to the shared folder.
    """
    m = materialize(stored_once(messages), "memory-once")
    numbered = materialize(rounds(m, cfg, True), "memory-rounds")
    state = materialize(memory_state(m, cfg, summarise, True, numbered), "memory-state")
    kept = numbered.join(kept_rounds(m, state, cfg, numbered).select("session_id", "round_id"), ["session_id", "round_id"])
    head = state.where("summary <> ''").select("session_id", F.lit(-1).cast("bigint").alias("ord"), F.lit("system").alias("type"), F.concat(F.lit(cfg.summary_tag + cfg.line_sep), F.col("summary")).alias("content"))
    out = materialize(head.unionByName(kept.select("session_id", F.col("pos").alias("ord"), "type", "content")), "memory-history")
    release(m, numbered, state)
    return out


def append_messages(stored: DataFrame, new: DataFrame) -> DataFrame:
    """(session_id, pos, msg_id, type, content): stored messages, once each, and new ones behind the last of their session.

    new has (session_id, pos, type, content) with positions of its own from 0; sessions not stored so far begin with them.
    """
    old = stored_once(stored)
    last = old.groupBy("session_id").agg(F.max("pos").alias("_last"))
    fresh = new.where("session_id is not null and pos is not null").select("session_id", F.col("pos").cast("bigint").alias("pos"), X.canonical_type(F.col("type")).alias("type"), "content")
    placed = fresh.join(last, "session_id", "left").withColumn("pos", F.col("pos") + F.coalesce(F.col("_last") + 1, F.lit(0)))
    none = F.lit(None).cast(dict(old.dtypes)["msg_id"]).alias("msg_id")
    return old.unionByName(placed.select("session_id", "pos", none, "type", "content"))


def add_messages(stored: DataFrame, new: DataFrame, cfg: Config = DEFAULT, summarise=None) -> DataFrame:
    """The history to be stored after new messages: read, append, compress (ord, type, content per session)."""
    return compress(append_messages(stored, new), cfg, summarise)
