"""The message list a request sends to the model."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chalktally.functions import expr
from chalktally.operators import rules as rule_ops

# Fixed value: how many earlier messages go along.
HISTORY = 20


def history(messages: DataFrame, k: int = HISTORY) -> DataFrame:
    """The last ``k`` messages of each session with ``position`` 1 = oldest.

    The rank limit is applied before the exchange too, so a session of any
    length sends at most ``k`` rows from each task.
    """
    newest = Window.partitionBy("session_id").orderBy(
        F.desc("created_at"), F.desc(expr.sender_rank("sender")), F.desc("id")
    )
    kept = F.count("*").over(Window.partitionBy("session_id"))
    return (
        messages.select("id", "session_id", "sender", "content", "created_at")
        .withColumn("_age", F.row_number().over(newest))
        .where(F.col("_age") <= k)
        .withColumn("position", (kept - F.col("_age") + 1).cast("int"))
        .select(
            "session_id", "position", "id", expr.chat_role("sender").alias("role"), "content"
        )
    )


def history_lists(messages: DataFrame, k: int = HISTORY) -> DataFrame:
    """One row per session: its last ``k`` messages as an array, oldest first."""
    entry = F.struct("position", "role", "content")
    return (
        history(messages, k)
        .groupBy("session_id")
        .agg(F.sort_array(F.collect_list(entry)).alias("history"))
        .withColumn(
            "history",
            F.transform("history", lambda m: F.struct(m.role.alias("role"), m.content.alias("content"))),
        )
    )


def system_text(users: DataFrame, rules: DataFrame) -> DataFrame:
    """Per user the applied rule and the system prompt that carries it."""

    def with_text(df: DataFrame) -> DataFrame:
        return df.withColumn("text", expr.rule_text("rules_json")).drop("rules_json")

    targeted = with_text(rule_ops.first_targeted(rules)).withColumnRenamed("user_id", "id")
    everyone = with_text(rule_ops.first_for_everyone(rules)).select(F.struct("rule_id", "text"))
    targeted_rule = F.when(F.col("rule_id").isNotNull(), F.struct("rule_id", "text"))
    return (
        users.select("id")
        .join(targeted, "id", "left")
        .select(
            F.col("id").alias("user_id"),
            F.coalesce(targeted_rule, everyone.scalar()).alias("rule"),
        )
        .select(
            "user_id",
            F.col("rule.rule_id").alias("rule_id"),
            expr.system_prompt("rule.text").alias("system_prompt"),
        )
    )


def assemble(
    requests: DataFrame,
    sessions: DataFrame,
    users: DataFrame,
    rules: DataFrame,
    messages: DataFrame,
    k: int = HISTORY,
) -> DataFrame:
    """Add ``payload`` to admitted requests (``session_id``, ``message``): system
    prompt, the session's last messages, the new message.

    An admitted request comes from the owner of its session. System prompt and
    history are therefore brought together per session, and the requests, of
    which there are many more, are joined once.
    """

    def entry(role: str, content: str):
        return F.struct(F.lit(role).alias("role"), F.col(content).alias("content"))

    # Only messages and sessions that a request asks for are ordered and moved.
    asked = requests.select("session_id").distinct()
    lists = history_lists(messages.join(asked, "session_id", "left_semi"), k)
    nothing = F.array().cast(lists.schema["history"].dataType)
    contexts = (
        sessions.select(F.col("id").alias("session_id"), "user_id")
        .join(asked, "session_id", "left_semi")
        .join(system_text(users, rules).select("user_id", "system_prompt"), "user_id")
        .join(lists, "session_id", "left")
        .select(
            "session_id",
            F.concat(
                F.array(entry("system", "system_prompt")), F.coalesce("history", nothing)
            ).alias("_context"),
        )
    )
    return (
        requests.join(contexts, "session_id")
        .withColumn("payload", F.concat("_context", F.array(entry("user", "message"))))
        .drop("_context")
    )
