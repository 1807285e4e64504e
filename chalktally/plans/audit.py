"""Conversation history for teachers and for the owners of sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chalktally.functions import expr
from chalktally.operators import gate, sessions


def student_history(
    session_rows: DataFrame, users: DataFrame, messages: DataFrame, **paging
) -> DataFrame:
    """Live sessions of live students with messages and printed title."""
    wanted = sessions.auditable(session_rows, users)
    nested = sessions.with_messages(wanted, messages, subset=True, **paging)
    return nested.withColumn("label", expr.title("title"))


def read_sessions(
    requests: DataFrame, users: DataFrame, session_rows: DataFrame, messages: DataFrame, **paging
) -> tuple[DataFrame, DataFrame]:
    """Decisions for requests to read a session by id, and the sessions that at
    least one allowed request asked for, with their messages."""
    decisions = gate.session_read_decisions(requests, users, session_rows)
    asked = decisions.where(F.col("status") == 200).select(F.col("session_id").alias("id"))
    wanted = session_rows.join(asked.distinct(), "id", "left_semi")
    return decisions, sessions.with_messages(wanted, messages, subset=True, **paging)
