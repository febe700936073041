"""Evidence and prompt assembly; model calls are a hook."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.config import DEFAULT, Config
from lexweave.functions.text import role_label
from lexweave.operators.memory import add_messages, compress
from lexweave.runtime import materialize

TEMPLATE = "你是严谨的法律信息助手，只依据所给资料回答，资料不足时直接说明。{sep}资料：{sep}{context}"


def evidence(ranked: DataFrame, by: list[str] | None = None, cfg: Config = DEFAULT) -> DataFrame:
    """(by..., context): ranked chunks (rank, source, chapter, article_no, text) as one string per query.

    A query has at most the fused list's length of rows, so a group is small.
    """
    null = lambda c: F.coalesce(F.col(c), F.lit(""))
    block = F.concat(F.lit("source="), null("source"), F.lit(" chapter="), null("chapter"), F.lit(" article="), null("article_no"), F.lit(f"{cfg.line_sep}原文片段："), null("text"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("rank", block.alias("b")))), lambda x: x["b"])
    joined = F.array_join(ordered, cfg.line_sep * 2)
    return ranked.groupBy(*(by or [])).agg(F.when(F.count("*") == 0, cfg.no_evidence).otherwise(joined).alias("context"))


def history_text(messages: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """(session_id, history): compressed messages (session_id, ord, type, content) as lines; bounded by the budget."""
    line = F.concat(F.lit("["), role_label(F.col("type")), F.lit("] "), F.coalesce("content", F.lit("")))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("ord", line.alias("l")))), lambda x: x["l"])
    return messages.groupBy("session_id").agg(F.array_join(ordered, "\n").alias("history"))


def render(context: Column, question: Column, history: Column | None = None, cfg: Config = DEFAULT) -> Column:
    """System text with the evidence, history, question."""
    head, tail = TEMPLATE.replace("{sep}", cfg.line_sep).split("{context}")
    parts = [F.concat(F.lit(head), context, F.lit(tail))]
    if history is not None:
        parts.append(F.nullif(history, F.lit("")))
    return F.concat_ws("\n", *parts, F.concat(F.lit("问题："), question))


def answer(prompts: DataFrame, model=None, prompt: str = "prompt") -> DataFrame:
    """prompts with an answer column from model(list of prompts); without a model the prompt itself."""
    if model is None:
        return prompts.withColumn("answer", F.col(prompt))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(answer=model(pdf[prompt].tolist()))

    return prompts.mapInPandas(run, ", ".join([*(f"`{c}` {t}" for c, t in prompts.dtypes), "answer string"]))


def preview(ranked: DataFrame, chars: int = 220) -> DataFrame:
    """Ranked chunks with the start of their text on one line."""
    return ranked.withColumn("preview", F.substring(F.replace(F.col("text"), F.lit("\n"), F.lit(" ")), 1, chars))


def session_prompts(stored: DataFrame, questions: DataFrame, context: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """(session_id, question, prompt): evidence, the session's history as it is kept, the question.

    questions has (session_id, question), context one row (context). A session without history has none in its prompt.
    """
    history = history_text(compress(stored, cfg), cfg)
    d = questions.join(history, "session_id", "left").crossJoin(F.broadcast(context.select("context").limit(1)))
    return d.select("session_id", "question", render(F.col("context"), F.col("question"), F.col("history"), cfg).alias("prompt"))


def chat_turn(stored: DataFrame, questions: DataFrame, context: DataFrame, model=None, cfg: Config = DEFAULT, summarise=None) -> tuple[DataFrame, DataFrame]:
    """One turn of every session asked: (session_id, question, prompt, answer) and the histories to be stored after it.

    The answers are written before they are used twice, so the model sees each prompt once.
    """
    answered = materialize(answer(session_prompts(stored, questions, context, cfg), model), "chat-answers")
    both = F.explode(F.array(F.struct(F.lit(0).alias("pos"), F.lit("human").alias("type"), F.col("question").alias("content")), F.struct(F.lit(1).alias("pos"), F.lit("ai").alias("type"), F.col("answer").alias("content"))))
    return answered, add_messages(stored, answered.select("session_id", both.alias("m")).select("session_id", "m.*"), cfg, summarise)
