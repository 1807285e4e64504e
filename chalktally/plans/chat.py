"""A batch of chat requests: before the model is called, and after it answered."""

from __future__ import annotations

import datetime as dt
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chalktally.functions import expr
from chalktally.operators import changes, gate, prompts, usage
from chalktally.sources.tables import Tables


class Prepared(NamedTuple):
    decisions: DataFrame
    prompts: DataFrame
    sessions: DataFrame


def prepare(
    tables: Tables, requests: DataFrame, today: dt.date, k: int = prompts.HISTORY
) -> Prepared:
    """Decisions for all requests, the message lists of the admitted ones, and
    the sessions with the applied rule bound."""
    decisions = gate.chat_decisions(
        requests, tables.users, tables.sessions, tables.usage_stats, today
    )
    admitted = decisions.where(F.col("status") == 200)
    return Prepared(
        decisions,
        prompts.assemble(
            admitted,
            tables.sessions,
            tables.users,
            tables.teacher_rules,
            tables.messages,
            k,
        ),
        changes.bind_rules(tables.sessions, tables.users, tables.teacher_rules, admitted),
    )


class Settled(NamedTuple):
    messages: DataFrame
    usage_stats: DataFrame


def answers(admitted: DataFrame, replies: DataFrame) -> DataFrame:
    """Every admitted request with its reply and token counts.

    ``admitted`` has request_id, user_id, session_id, message, created_at;
    ``replies`` has request_id, reply and token counts. A request whose stream
    broke off before the first chunk gets an empty reply and the default counts.
    """
    asked = admitted.select("request_id", "user_id", "session_id", "message", "created_at")
    got = replies.select("request_id", "reply", "prompt_tokens", "completion_tokens")
    return _filled(asked.join(got, "request_id", "left"))


def answers_in_time(admitted: DataFrame, replies: DataFrame, within: str) -> DataFrame:
    """``answers`` on two streams, each with its watermark on ``created_at`` and
    ``started_at``: a reply belongs to a request if it starts with it or up to
    ``within`` later. A request is kept until its reply comes or, by both
    watermarks, no longer can; then it has an empty reply."""
    asked = admitted.select("request_id", "user_id", "session_id", "message", "created_at")
    got = replies.select(
        F.col("request_id").alias("_of"), "started_at", "reply", "prompt_tokens", "completion_tokens"
    )
    late = F.col("created_at") + F.expr(f"INTERVAL {within}")
    same = (
        (F.col("request_id") == F.col("_of"))
        & (F.col("started_at") >= F.col("created_at"))
        & (F.col("started_at") <= late)
    )
    return _filled(asked.join(got, same, "left").drop("_of", "started_at"))


def _filled(answered: DataFrame) -> DataFrame:
    return (
        answered.withColumn("reply", F.coalesce("reply", F.lit("")))
        .withColumn("prompt_tokens", expr.tokens_or_default("prompt_tokens"))
        .withColumn("completion_tokens", expr.tokens_or_default("completion_tokens"))
        .withColumn("total_tokens", F.col("prompt_tokens") + F.col("completion_tokens"))
    )


def message_pairs(answered: DataFrame) -> DataFrame:
    """The two message rows of every answered request: the user's without token
    counts, the model's with them."""
    counts = ("prompt_tokens", "completion_tokens", "total_tokens")

    def row(sender: str, content: str, with_counts: bool):
        fields = [F.when(F.lit(with_counts), F.col(c)).cast("int").alias(c) for c in counts]
        return F.struct(F.lit(sender).alias("sender"), F.col(content).alias("content"), *fields)

    pair = F.array(row("user", "message", False), row("llm", "reply", True))
    return answered.select(
        "request_id", "session_id", "created_at", F.explode(pair).alias("m")
    ).select(
        F.concat_ws(":", F.col("request_id").cast("string"), "m.sender").alias("id"),
        "session_id",
        "m.*",
        "created_at",
    )


def settle(admitted: DataFrame, replies: DataFrame, usage_stats: DataFrame) -> Settled:
    """Message rows to append and the next usage snapshot. Exactly the admitted
    requests are charged, each once."""
    answered = answers(admitted, replies)
    return Settled(
        message_pairs(answered), usage.merge(usage_stats, usage.daily(answered))
    )
