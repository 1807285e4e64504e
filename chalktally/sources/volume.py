"""The five tables and batches of changes, derived from the provided parquet
tables ``customer``, ``events`` and ``conversations``.

Ids are LONG here. Each function reads its one file and selects; nothing is
gathered, so everything grows with the files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chalktally.functions import expr
from chalktally.operators import usage as usage_ops
from chalktally.sources.tables import Tables


HOT_USER = 2


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _k() -> Column:
    return F.get_json_object("props", "$.k").cast("int")


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return _read(spark, sf_dir, "customer").select(
        key.alias("id"),
        F.col("c_name").alias("username"),
        F.when(key % 50 == 0, "admin")
        .when(key % 10 == 1, "teacher")
        .otherwise("student")
        .alias("role"),
        (key % 7 * 40).cast("int").alias("daily_token_quota"),
        (key % 11 == 5).alias("is_deleted"),
    )


def requests_of(events: DataFrame) -> DataFrame:
    """Chat requests from event rows, batch or stream. A third of them is one
    user's; the others mostly ask for a session of their own."""
    failed = F.col("event_type") == "error"
    hot = F.col("event_id") % 3 == 0
    prompt = F.when(failed, 0).otherwise(_k())
    completion = F.when(failed, 0).otherwise(F.floor("value").cast("int"))
    return events.where(F.col("event_type").isin("click", "view", "error")).select(
        F.col("event_id").alias("request_id"),
        F.when(hot, HOT_USER).otherwise(F.col("user_id")).alias("user_id"),
        F.when(hot, F.col("event_id") % 6 * 3)
        .otherwise(F.col("user_id") + F.col("event_id") % 2)
        .alias("session_id"),
        F.col("ts").cast("timestamp").alias("created_at"),
        expr.tokens_or_default(prompt).alias("prompt_tokens"),
        expr.tokens_or_default(completion).alias("completion_tokens"),
        expr.total_tokens(prompt, completion).alias("total_tokens"),
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests_of(_read(spark, sf_dir, "events"))


def timed_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests with the end of their replies: up to five hours later, some over
    midnight, and every 41st a day and a quarter after that."""
    key = F.col("request_id")
    minutes = (key % 97 * 3 + F.when(key % 41 == 0, 1800).otherwise(0)).cast("int")
    return requests(spark, sf_dir).select(
        "request_id",
        "user_id",
        F.col("created_at").alias("started_at"),
        F.timestamp_add("MINUTE", minutes, F.col("created_at")).alias("ended_at"),
        "total_tokens",
    )


def quota_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases edit the buyer's quota when they happen, and every 60th event, if it
    is one, that of the user who asks most."""
    user = F.when(F.col("event_id") % 60 == 0, HOT_USER).otherwise(F.col("user_id"))
    return (
        _read(spark, sf_dir, "events")
        .where(F.col("event_type") == "purchase")
        .select(
            F.col("event_id").alias("change_id"),
            user.alias("user_id"),
            F.col("ts").cast("timestamp").alias("changed_at"),
            (F.floor("value") * 4).cast("int").alias("daily_token_quota"),
        )
    )


def chat_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests with the text of the new message, some of them empty."""
    asked = F.concat(F.lit("Question "), F.col("request_id").cast("string"))
    text = F.when(F.col("request_id") % 23 == 0, "").otherwise(asked)
    return requests(spark, sf_dir).withColumn("message", text)


def usage_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage_ops.daily(requests(spark, sf_dir))


def teacher_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    user = F.col("user_id")
    return (
        _read(spark, sf_dir, "events")
        .where(F.col("event_type") == "signup")
        .select(
            F.col("event_id").alias("id"),
            (F.floor(user / 10) * 10 + 1).cast("long").alias("teacher_id"),
            F.when(_k() % 25 != 0, user).alias("student_id"),
            F.when(F.col("event_id") % 17 == 3, "plain words")
            .otherwise(F.col("props"))
            .alias("rules_json"),
            (F.col("value") > 20).alias("is_active"),
        )
    )


def _session_start() -> Column:
    return F.date_add(F.lit("2024-01-01").cast("date"), (F.col("conv_id") % 30).cast("int")).cast(
        "timestamp"
    )


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = F.col("conv_id")
    return (
        _read(spark, sf_dir, "conversations")
        .select("conv_id")
        .distinct()
        .select(
            conv.alias("id"),
            F.when(conv % 3 == 0, HOT_USER).otherwise(conv - conv % 2).alias("user_id"),
            F.lit(None).cast("long").alias("applied_rule_id"),
            F.when(conv % 4 != 0, F.concat(F.lit("Chat "), conv.cast("string"))).alias("title"),
            (conv % 9 == 4).alias("is_deleted"),
            _session_start().alias("created_at"),
        )
    )


def messages_of(conversations: DataFrame) -> DataFrame:
    """Messages from conversation rows, one minute per turn, batch or stream. A
    third of all conversations is one session, so others have no messages."""
    conv = F.col("conv_id")
    by_user = F.col("role") == "user"
    size = F.length("text")
    quarter = F.floor(size / 4)
    return conversations.where(F.col("role") != "system").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"),
        F.when(conv % 3 == 0, 0).otherwise(conv).cast("long").alias("session_id"),
        F.when(by_user, "user").otherwise("llm").alias("sender"),
        F.col("text").alias("content"),
        F.when(~by_user, quarter).cast("int").alias("prompt_tokens"),
        F.when(~by_user, size - quarter).cast("int").alias("completion_tokens"),
        F.when(~by_user, size).cast("int").alias("total_tokens"),
        F.timestamp_add("MINUTE", F.col("turn").cast("int"), _session_start()).alias("created_at"),
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages_of(_read(spark, sf_dir, "conversations"))


def chunks_of(messages: DataFrame) -> DataFrame:
    """Reply chunks: every model message cut after each blank. Each chunk has
    its place in the reply; the last one carries the token counts, unless the
    message id is a multiple of 3 (a model that reports none). Every seventh
    stream breaks off after three chunks."""
    pieces = F.split("content", "(?<= )")
    last = F.col("seq") == F.col("_n") - 1
    reported = last & (F.col("request_id") % 3 != 0)
    return (
        messages.where(F.col("sender") == "llm")
        .select(
            F.col("id").alias("request_id"),
            "session_id",
            F.col("created_at").alias("started_at"),
            F.col("prompt_tokens").alias("_prompt"),
            F.col("completion_tokens").alias("_completion"),
            pieces.alias("_pieces"),
        )
        .withColumn("_n", F.size("_pieces"))
        .select("*", F.posexplode("_pieces").alias("seq", "delta"))
        .where((F.col("request_id") % 7 != 0) | (F.col("seq") < 3))
        .select(
            "request_id",
            "session_id",
            "started_at",
            "seq",
            "delta",
            F.when(reported, F.col("_prompt")).alias("prompt_tokens"),
            F.when(reported, F.col("_completion")).alias("completion_tokens"),
        )
    )


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks_of(messages(spark, sf_dir))


def arriving_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks with the time they came at: forty seconds apart, and every fifth reply
    is silent for ten minutes before its sixth chunk."""
    pause = F.when((F.col("request_id") % 5 == 0) & (F.col("seq") >= 5), 600).otherwise(0)
    seconds = (F.col("seq") * 40 + pause).cast("int")
    return chunks(spark, sf_dir).withColumn(
        "arrived_at", F.timestamp_add("SECOND", seconds, F.col("started_at"))
    )


def reply_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies to the requests: each gets the first model message of its session,
    but every eleventh nothing at all."""
    first = (
        messages(spark, sf_dir)
        .where(F.col("sender") == "llm")
        .groupBy("session_id")
        .agg(F.min_by(F.struct("content", "prompt_tokens", "completion_tokens"), "id").alias("m"))
    )
    answered = requests(spark, sf_dir).where(F.col("request_id") % 11 != 0)
    return chunks_of(
        answered.join(first, "session_id").select(
            F.col("request_id").alias("id"), "session_id", "created_at",
            F.lit("llm").alias("sender"), "m.*",
        )
    )


def message_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages some of which break a rule of their table."""
    key = F.col("id")
    return messages(spark, sf_dir).withColumns(
        {
            "sender": F.when(key % 11 == 0, "bot").otherwise(F.col("sender")),
            "content": F.when(key % 13 != 0, F.col("content")),
        }
    )


def torn_tables(spark: SparkSession, sf_dir: str) -> Tables:
    """The tables after some users and sessions were lost."""
    whole = tables(spark, sf_dir)
    return whole._replace(
        users=whole.users.where(F.col("id") % 13 != 4),
        sessions=whole.sessions.where(F.col("id") % 7 != 3),
    )


def user_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    name = F.concat(F.lit("Customer#"), F.lpad((key * 2).cast("string"), 9, "0"))
    return _read(spark, sf_dir, "customer").select(
        key.alias("row_id"),
        (-key - 1).alias("id"),
        F.when(key % 13 == 0, "").otherwise(name).alias("username"),
        F.when(F.col("c_mktsegment") == "BUILDING", "guest").otherwise("student").alias("role"),
        F.floor("c_acctbal").cast("int").alias("daily_token_quota"),
    )


def quota_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases set the buyer's quota to the amount, minus ten so that some
    are refused."""
    return (
        _read(spark, sf_dir, "events")
        .where(F.col("event_type") == "purchase")
        .select(
            F.col("event_id").alias("change_id"),
            (F.col("user_id") * 3).alias("user_id"),
            (F.floor("value") - 10).cast("int").alias("daily_token_quota"),
        )
    )


def deletions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        _read(spark, sf_dir, "events")
        .where(F.col("event_type") == "error")
        .select(
            F.col("event_id").alias("change_id"), (F.col("user_id") * 15).alias("user_id")
        )
    )


def toggle_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        _read(spark, sf_dir, "events")
        .where(F.col("event_type") == "click")
        .select(
            F.col("event_id").alias("change_id"),
            (F.col("event_id") % 50 * 20).alias("rule_id"),
        )
    )


def new_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A session per purchase; the title repeats the properties, for some users
    often enough to be too long."""
    return (
        _read(spark, sf_dir, "events")
        .where(F.col("event_type") == "purchase")
        .select(
            (F.col("event_id") + 1_000_000_000).alias("id"),
            "user_id",
            F.when(
                F.col("user_id") % 5 != 0, F.repeat("props", (F.col("user_id") % 40).cast("int"))
            ).alias("title"),
            F.col("ts").cast("timestamp").alias("created_at"),
        )
    )


def new_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule per purchase, for the buyer or for everyone, as a JSON object; some
    have no teacher."""
    return (
        _read(spark, sf_dir, "events")
        .where(F.col("event_type") == "purchase")
        .select(
            (F.col("event_id") + 1_000_000_000).alias("id"),
            F.when(
                F.col("event_id") % 19 != 0,
                (F.floor(F.col("user_id") / 10) * 10 + 1).cast("long"),
            ).alias("teacher_id"),
            F.when(F.col("user_id") % 7 != 0, F.col("user_id")).alias("student_id"),
            F.struct(_k().alias("level")).alias("rules_json"),
            F.when(F.col("event_id") % 3 != 0, F.col("value") > 50).alias("is_active"),
        )
    )


def tables(spark: SparkSession, sf_dir: str) -> Tables:
    return Tables(
        users(spark, sf_dir),
        teacher_rules(spark, sf_dir),
        usage_stats(spark, sf_dir),
        sessions(spark, sf_dir),
        messages(spark, sf_dir),
    )
