"""
the SQL that DuckDB runs on the same parquet files.

Dates, instants and nested results are rendered as strings so that both engines
return the same plain values.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import oracle_queries
from chalktally import session
from chalktally.functions import expr
from chalktally.operators import (
    changes,
    checks,
    gate,
    prompts,
    replay,
    rules,
    sessions,
    usage,
    users,
)
from chalktally.plans import audit, chat, overview
from chalktally.sources import by_session, tables, volume
from chalktally.streaming import gate as gate_stream
from chalktally.streaming import replies as stream_replies
from chalktally.streaming import usage as stream_usage

try:
    import chalktally.llm.queries as llm
    import corpus_pipeline
except ModuleNotFoundError as missing:
    if missing.name not in ("chalktally.llm", "chalktally.llm.queries", "corpus_pipeline"):
        raise
    llm = None

TODAY = dt.date(2024, 1, 15)

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def _register(query: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _plain(query(session.configure(spark), sf_dir))

    _QUERIES[query.__name__] = run
    return query


def _plain(df: DataFrame) -> DataFrame:
    """Dates and instants as text."""
    for field in df.schema.fields:
        kind = field.dataType.typeName()
        if kind == "date":
            df = df.withColumn(field.name, F.date_format(field.name, "yyyy-MM-dd"))
        elif kind in ("timestamp", "timestamp_ntz"):
            df = df.withColumn(field.name, F.date_format(field.name, "yyyy-MM-dd HH:mm:ss"))
    return df


def _joined(array: str, *fields: str):
    """An array of structs as text, ``a|b`` per element, elements apart by #."""
    return F.array_join(
        F.transform(array, lambda m: F.concat_ws("|", *(m[f].cast("string") for f in fields))), "#"
    )


# --- users, usage, quota ---------------------------------------------------


@_register
def active_users(spark, sf):
    return users.active(volume.users(spark, sf))


@_register
def active_user_count(spark, sf):
    return users.active_count(volume.users(spark, sf))


@_register
def resolve_names(spark, sf):
    names = volume.users(spark, sf).select("username")
    return users.resolve_names(names, volume.users(spark, sf))


@_register
def student_overview(spark, sf):
    return usage.student_overview(volume.users(spark, sf), volume.usage_stats(spark, sf), TODAY)


@_register
def quota_pct_band(spark, sf):
    use = usage.quota_use(
        volume.users(spark, sf), volume.usage_stats(spark, sf), TODAY
    )
    return usage.with_quota_share(use, "used", "limit")


@_register
def student_quota_share(spark, sf):
    return overview.student_overview(
        volume.users(spark, sf), volume.usage_stats(spark, sf), TODAY
    )


@_register
def quota_use(spark, sf):
    return usage.quota_use(volume.users(spark, sf), volume.usage_stats(spark, sf), TODAY)


@_register
def usage_rollup(spark, sf):
    return usage.daily(volume.requests(spark, sf))


@_register
def usage_from_messages(spark, sf):
    return usage.rollup(volume.messages(spark, sf), volume.sessions(spark, sf))


@_register
def usage_merge(spark, sf):
    rows = volume.requests(spark, sf)
    noon = F.hour("created_at") < 12
    return usage.merge(usage.daily(rows.where(noon)), usage.daily(rows.where(~noon)))


@_register
def usage_drift(spark, sf):
    rows = volume.requests(spark, sf)
    judged = gate.quota_replay(rows, volume.users(spark, sf))
    admitted = judged.where(~F.col("refused"))
    return checks.usage_drift(usage.daily(rows), usage.daily(admitted))


@_register
def usage_drift_by_digests(spark, sf):
    """The same of two tables that lie stored."""
    rows = volume.requests(spark, sf)
    admitted = gate.quota_replay(rows, volume.users(spark, sf)).where(~F.col("refused"))
    return checks.usage_drift_by_digests(
        session.stored(usage.daily(rows), "usage"), session.stored(usage.daily(admitted), "usage")
    )


# --- decisions -------------------------------------------------------------


@_register
def quota_replay(spark, sf):
    judged = gate.quota_replay(volume.requests(spark, sf), volume.users(spark, sf))
    return judged.select("request_id", "user_id", "refused")


@_register
def landing_replay(spark, sf):
    """Usage is written when a reply ends."""
    judged = replay.landing_replay(volume.timed_requests(spark, sf), volume.users(spark, sf))
    return judged.select("request_id", "user_id", "refused")


@_register
def quota_in_force(spark, sf):
    found = replay.quota_in_force(
        volume.requests(spark, sf), volume.users(spark, sf), volume.quota_history(spark, sf)
    )
    return found.select("request_id", "user_id", "version", "quota")


@_register
def history_replay(spark, sf):
    """The quota is edited within the day."""
    judged = replay.history_replay(
        volume.requests(spark, sf), volume.users(spark, sf), volume.quota_history(spark, sf)
    )
    return judged.select("request_id", "user_id", "refused")


@_register
def replay_decisions(spark, sf):
    judged = gate.replay_decisions(
        volume.requests(spark, sf), volume.users(spark, sf), volume.sessions(spark, sf)
    )
    return judged.select("request_id", "user_id", "session_id", "status")


def _chat_decisions(spark, sf):
    return gate.chat_decisions(
        volume.chat_requests(spark, sf),
        volume.users(spark, sf),
        volume.sessions(spark, sf),
        volume.usage_stats(spark, sf),
        TODAY,
    )


@_register
def chat_decisions(spark, sf):
    return _chat_decisions(spark, sf).select("request_id", "user_id", "session_id", "status")


@_register
def session_read_decisions(spark, sf):
    judged = gate.session_read_decisions(
        volume.requests(spark, sf), volume.users(spark, sf), volume.sessions(spark, sf)
    )
    return judged.select("request_id", "user_id", "session_id", "status")


@_register
def role_decisions(spark, sf):
    kind = F.col("request_id") % 3
    named = F.when(kind == 0, "user").when(kind == 1, "teacher").otherwise("admin")
    judged = gate.role_decisions(
        volume.requests(spark, sf).withColumn("gate", named), volume.users(spark, sf), "gate"
    )
    return judged.select("request_id", "user_id", "gate", "status")


@_register
def audit_decisions(spark, sf):
    asked = volume.requests(spark, sf).select("request_id", F.col("user_id").alias("student_id"))
    return gate.audit_decisions(asked, volume.users(spark, sf))


@_register
def own_accounts(spark, sf):
    asked = volume.requests(spark, sf).select("request_id", "user_id")
    return gate.own_accounts(asked, volume.users(spark, sf))


@_register
def areas(spark, sf):
    return gate.areas(volume.users(spark, sf))


# --- rules and prompts -----------------------------------------------------


@_register
def rules_matching(spark, sf):
    return rules.matching(volume.users(spark, sf), volume.teacher_rules(spark, sf))


@_register
def rules_match_counts(spark, sf):
    return rules.match_counts(volume.users(spark, sf), volume.teacher_rules(spark, sf))


@_register
def effective_rule(spark, sf):
    return rules.effective(volume.users(spark, sf), volume.teacher_rules(spark, sf))


@_register
def rules_by_teacher(spark, sf):
    return rules.by_teacher(volume.teacher_rules(spark, sf))


@_register
def history_last_k(spark, sf):
    return prompts.history(volume.messages(spark, sf), 4).select(
        "session_id", "position", "id", "role", "content"
    )


@_register
def history_last_20(spark, sf):
    return prompts.history(volume.messages(spark, sf)).select(
        "session_id", "position", "id", "role"
    )


@_register
def prompt_text(spark, sf):
    lists = prompts.history_lists(volume.messages(spark, sf), 4)
    return lists.select("session_id", _joined("history", "role", "content").alias("history"))


@_register
def system_text(spark, sf):
    return prompts.system_text(volume.users(spark, sf), volume.teacher_rules(spark, sf))


@_register
def prompt_payload(spark, sf):
    prepared = chat.prepare(volume.tables(spark, sf), volume.chat_requests(spark, sf), TODAY)
    return prepared.prompts.select(
        "request_id", _joined("payload", "role", "content").alias("payload")
    )


# --- sessions --------------------------------------------------------------


@_register
def session_listing(spark, sf):
    return sessions.listing(volume.sessions(spark, sf))


@_register
def session_audit(spark, sf):
    return sessions.audit(volume.sessions(spark, sf), volume.users(spark, sf))


@_register
def session_summary(spark, sf):
    return sessions.summary(volume.sessions(spark, sf), volume.messages(spark, sf))


@_register
def newest_session(spark, sf):
    return sessions.newest(volume.sessions(spark, sf))


def _nested(df: DataFrame) -> DataFrame:
    text = _joined("messages", "id", "sender", "content", "total_tokens")
    return df.withColumn("messages", text)


@_register
def sessions_with_messages(spark, sf):
    return _nested(
        sessions.with_messages(volume.sessions(spark, sf), volume.messages(spark, sf))
    )


def _by_session(spark: SparkSession, sf: str, long: int) -> by_session.BySession:
    folder = session.work_dir(spark, "by_session")
    name = folder.rsplit("/", 1)[1].replace("-", "_")
    by_session.save(volume.sessions(spark, sf), volume.messages(spark, sf), name, folder, long=long)
    return by_session.load(spark, name)


@_register
def stored_session_summary(spark, sf):
    """Counted where the messages lie; sessions of more than 8 messages apart."""
    return by_session.summary(_by_session(spark, sf, 8))


@_register
def stored_sessions_with_messages(spark, sf):
    return _nested(by_session.with_messages(_by_session(spark, sf, by_session.LONG)))


@_register
def stored_sessions_in_pages(spark, sf):
    """Pages of three messages; sessions of more than 8 messages are split in grains."""
    return _nested(by_session.with_messages(_by_session(spark, sf, 8), page_size=3))


@_register
def stored_history_last_20(spark, sf):
    return by_session.history(_by_session(spark, sf, 8)).select(
        "session_id", "position", "id", "role"
    )


@_register
def sessions_in_pages(spark, sf):
    return _nested(
        sessions.with_messages(
            volume.sessions(spark, sf), volume.messages(spark, sf), page_size=3
        )
    )


@_register
def student_history(spark, sf):
    return _nested(
        audit.student_history(
            volume.sessions(spark, sf), volume.users(spark, sf), volume.messages(spark, sf)
        )
    ).select("id", "user_id", "label", "page", "messages")


@_register
def read_sessions(spark, sf):
    _, nested = audit.read_sessions(
        volume.requests(spark, sf),
        volume.users(spark, sf),
        volume.sessions(spark, sf),
        volume.messages(spark, sf),
    )
    return _nested(nested).select("id", "user_id", "page", "messages")


# --- changes and checks ----------------------------------------------------


def _create_users(spark, sf):
    return changes.create_users(volume.users(spark, sf), volume.user_candidates(spark, sf))


@_register
def create_users(spark, sf):
    return _create_users(spark, sf).statuses


@_register
def create_users_snapshot(spark, sf):
    return _create_users(spark, sf).snapshot


@_register
def set_quota(spark, sf):
    return changes.set_quota(volume.users(spark, sf), volume.quota_changes(spark, sf)).snapshot


@_register
def set_quota_status(spark, sf):
    return changes.set_quota(volume.users(spark, sf), volume.quota_changes(spark, sf)).statuses


@_register
def soft_delete(spark, sf):
    return changes.soft_delete(volume.users(spark, sf), volume.deletions(spark, sf)).statuses


@_register
def soft_delete_snapshot(spark, sf):
    return changes.soft_delete(volume.users(spark, sf), volume.deletions(spark, sf)).snapshot


@_register
def toggle_rules(spark, sf):
    return changes.toggle_rules(
        volume.teacher_rules(spark, sf), volume.toggle_changes(spark, sf)
    ).snapshot


@_register
def toggle_rules_status(spark, sf):
    return changes.toggle_rules(
        volume.teacher_rules(spark, sf), volume.toggle_changes(spark, sf)
    ).statuses


@_register
def create_sessions(spark, sf):
    return changes.create_sessions(
        volume.sessions(spark, sf), volume.new_sessions(spark, sf)
    ).snapshot


@_register
def create_sessions_status(spark, sf):
    return changes.create_sessions(
        volume.sessions(spark, sf), volume.new_sessions(spark, sf)
    ).statuses


@_register
def create_rules(spark, sf):
    return changes.create_rules(
        volume.teacher_rules(spark, sf), volume.new_rules(spark, sf)
    ).snapshot


@_register
def create_rules_status(spark, sf):
    return changes.create_rules(
        volume.teacher_rules(spark, sf), volume.new_rules(spark, sf)
    ).statuses


@_register
def bind_rules(spark, sf):
    admitted = _chat_decisions(spark, sf).where(F.col("status") == 200)
    return changes.bind_rules(
        volume.sessions(spark, sf),
        volume.users(spark, sf),
        volume.teacher_rules(spark, sf),
        admitted,
    ).select("id", "user_id", "applied_rule_id")


def _purged(spark, sf):
    tables = volume.tables(spark, sf)
    bound = changes.bind_rules(
        tables.sessions, tables.users, tables.teacher_rules, tables.sessions.select(
            F.col("id").alias("session_id")
        )
    )
    gone = volume.users(spark, sf).where("is_deleted").select(F.col("id").alias("user_id"))
    return changes.purge_users(tables._replace(sessions=bound), gone)


@_register
def purge_messages(spark, sf):
    return _purged(spark, sf).messages.select("id", "session_id")


@_register
def purge_sessions(spark, sf):
    return _purged(spark, sf).sessions.select("id", "user_id", "applied_rule_id")


@_register
def purge_rules(spark, sf):
    return _purged(spark, sf).teacher_rules


@_register
def purge_usage(spark, sf):
    return _purged(spark, sf).usage_stats


@_register
def purge_accounts(spark, sf):
    return _purged(spark, sf).users


@_register
def validate_users(spark, sf):
    checked = checks.validate(volume.user_candidates(spark, sf), "users")
    return checked.select("row_id", "username", "reason")


@_register
def validate_messages(spark, sf):
    return checks.validate(volume.message_candidates(spark, sf), "messages").select("id", "reason")


@_register
def validate_requests(spark, sf):
    checked = checks.validate(volume.chat_requests(spark, sf), "requests")
    return checked.select("request_id", "reason")


@_register
def duplicates(spark, sf):
    return checks.duplicates(volume.user_candidates(spark, sf), ["username"])


@_register
def orphan_requests(spark, sf):
    found = checks.orphans(
        volume.requests(spark, sf), "session_id", volume.sessions(spark, sf)
    )
    return found.select("request_id", "user_id", "session_id")


@_register
def orphan_counts(spark, sf):
    return checks.orphan_counts(volume.torn_tables(spark, sf))


@_register
def stored_usage_drift(spark, sf):
    return checks.stored_usage_drift(volume.tables(spark, sf))


# --- after the model answered, streams -------------------------------------


@_register
def reply_assembly(spark, sf):
    return stream_replies.assemble_batch(volume.chunks(spark, sf))


def _settled(spark, sf):
    """Admitted requests and what the model said; some replies break off, some
    never begin."""
    admitted = _chat_decisions(spark, sf).where(F.col("status") == 200)
    replies = stream_replies.assemble_for(admitted, volume.reply_chunks(spark, sf))
    return chat.settle(admitted, replies, volume.usage_stats(spark, sf))


@_register
def settle_messages(spark, sf):
    return _settled(spark, sf).messages


@_register
def settle_usage(spark, sf):
    return _settled(spark, sf).usage_stats


@_register
def stored_tables(spark, sf):
    """The tables saved, the answered requests appended, all read back."""
    folder = session.work_dir(spark, "tables")
    given = volume.tables(spark, sf)
    declared = (tables.conform(df, name) for name, df in given._asdict().items())
    tables.save(tables.Tables(*declared), folder)
    tables.init(spark, folder)
    tables.append_messages(tables.conform(_settled(spark, sf).messages, "messages"), folder)
    stored = tables.load(spark, folder)
    return usage.rollup(stored.messages, stored.sessions)


def _arriving(spark: SparkSession, parts: list[DataFrame], purpose: str) -> DataFrame:
    """Rows that arrive part after part, as a stream that takes about a part a trigger,
    so that there are no more triggers where tables lie in more files."""
    folder = f"{session.work_dir(spark, purpose)}/in"
    written = [0]
    for part in parts:
        with session.setting(spark, *session.CLEANED):
            part.write.mode("append").option("compression", "zstd").parquet(folder)
        written.append(len(spark.read.schema(part.schema).parquet(folder).inputFiles()))
    most = max(b - a for a, b in zip(written, written[1:]))
    reader = spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", max(2, most))
    return reader.parquet(folder)


def _by_part(df: DataFrame, part, n: int) -> list[DataFrame]:
    """Rows without a part come first."""
    numbered = F.coalesce(part, F.lit(0))
    return [df.where(numbered == i) for i in range(n)]


def _dealt(spark: SparkSession, df: DataFrame, part, n: int) -> list[DataFrame]:
    """``_by_part`` where the part isn't known before the rows are made: they are made
    once, not for every part."""
    stored = session.stored(df.withColumn("_part", part.cast("int")), "parts")
    return [rows.drop("_part") for rows in _by_part(stored, F.col("_part"), n)]


@_register
def stream_reply_assembly(spark, sf):
    """Chunks in the order of their requests, some of each request a part later,
    and last a chunk of nobody from which on all requests count as closed."""
    chunks = volume.chunks(spark, sf)
    week = F.floor((F.dayofmonth("started_at") - 1) / 8) + (F.col("seq") % 4 == 3).cast("int")
    last = _nobody(spark, chunks, "started_at")
    stream = _arriving(spark, [*_dealt(spark, chunks, week, 5), last], "chunks")
    out = session.work_dir(spark, "replies")
    replies = stream_replies.assemble(stream, delay="20 days")
    stream_replies.write_replies(
        replies, f"{out}/table", f"{out}/checkpoint", available_now=True
    ).awaitTermination()
    return spark.read.parquet(f"{out}/table").where("request_id is not null")


def _nobody(spark: SparkSession, like: DataFrame, *times: str) -> DataFrame:
    """A row of nobody at a time after which all that came before is over."""
    return spark.range(1).select(
        *(
            F.lit("2024-06-01" if f.name in times else None).cast(f.dataType).alias(f.name)
            for f in like.schema.fields
        )
    )


@_register
def stream_replies_by_silence(spark, sf):
    """Chunks in the order of their arrival, in five parts."""
    chunks = volume.arriving_chunks(spark, sf)
    week = F.floor((F.dayofmonth("arrived_at") - 1) / 8)
    last = _nobody(spark, chunks, "arrived_at", "started_at")
    stream = _arriving(spark, [*_dealt(spark, chunks, week, 4), last], "chunks")
    out = session.work_dir(spark, "replies")
    replies = stream_replies.assemble_by_silence(stream, "5 minutes", delay="20 days")
    stream_replies.write_replies(
        replies, f"{out}/table", f"{out}/checkpoint", available_now=True
    ).awaitTermination()
    return spark.read.schema(replies.schema).parquet(f"{out}/table").where("request_id is not null")


@_register
def stream_settle_messages(spark, sf):
    """Admitted requests and their replies, both while they arrive; some replies never
    begin."""
    asked, chunks = volume.chat_requests(spark, sf), volume.reply_chunks(spark, sf)
    week = F.floor(F.dayofmonth("created_at") / 8)
    # Joins filter missing keys before the watermark sees them: a row of nobody needs some.
    last = _nobody(spark, asked, "created_at").fillna(-1, ["user_id", "session_id"])
    requests = _arriving(spark, [*_by_part(asked, week, 4), last], "asked")
    pieces = _arriving(
        spark,
        [
            *_by_part(chunks, F.floor(F.dayofmonth("started_at") / 8), 4),
            _nobody(spark, chunks, "started_at").fillna(-1, ["request_id", "session_id"]),
        ],
        "chunks",
    )
    judged = gate.chat_decisions(
        requests.withWatermark("created_at", "20 days"),
        volume.users(spark, sf),
        volume.sessions(spark, sf),
        volume.usage_stats(spark, sf),
        TODAY,
    ).where(F.col("status") == 200)
    replies = stream_replies.assemble(pieces, delay="20 days")
    out = session.work_dir(spark, "answered")
    pairs = chat.message_pairs(chat.answers_in_time(judged, replies, "10 minutes"))
    stream_replies.write_replies(
        pairs, f"{out}/table", f"{out}/checkpoint", available_now=True
    ).awaitTermination()
    return spark.read.schema(pairs.schema).parquet(f"{out}/table")


def _requests_arriving(spark: SparkSession, sf: str) -> DataFrame:
    rows = volume.requests(spark, sf)
    return _arriving(spark, _by_part(rows, F.floor(F.dayofmonth("created_at") / 8), 4), "requests")


@_register
def stream_daily_usage(spark, sf):
    out = session.work_dir(spark, "usage")
    stream_usage.write_ledger(
        _requests_arriving(spark, sf), f"{out}/ledger", f"{out}/checkpoint", available_now=True
    ).awaitTermination()
    return stream_usage.current(spark, f"{out}/ledger")


@_register
def stream_folded_usage(spark, sf):
    """Rows that land up to three days late; two folds, and the rest from the ledger."""
    out = session.work_dir(spark, "usage")
    ledger, snapshot = f"{out}/ledger", f"{out}/snapshot"
    late = F.date_add(expr.day("created_at"), (F.col("request_id") % 4).cast("int"))
    stream_usage.write_ledger(
        _requests_arriving(spark, sf), ledger, f"{out}/checkpoint", available_now=True, landed=late
    ).awaitTermination()
    for until in (dt.date(2024, 1, 10), dt.date(2024, 1, 20)):
        stream_usage.fold(spark, ledger, snapshot, until)
    return stream_usage.current(spark, ledger, snapshot=snapshot)


@_register
def stream_closed_days(spark, sf):
    out = session.work_dir(spark, "days")
    days = stream_usage.daily_usage(_requests_arriving(spark, sf), delay="8 days")
    stream_usage.write_closed_days(
        days, f"{out}/table", f"{out}/checkpoint", available_now=True
    ).awaitTermination()
    return spark.read.parquet(f"{out}/table")


def _three_parts(requests: DataFrame) -> list[DataFrame]:
    """By time of arrival, the bounds in the middle of a day."""
    at = F.col("created_at")
    bounds = [F.lit(f"2024-01-{day} 12:00:00").cast("timestamp") for day in (10, 20)]
    return _by_part(requests, (at >= bounds[0]).cast("int") + (at >= bounds[1]).cast("int"), 3)


@_register
def stream_gate(spark, sf):
    """Requests that arrive in three parts; the stream stops after each and goes on
    from its checkpoint, so usage of the day that a bound cuts is kept in state."""
    requests = volume.requests(spark, sf)
    folder = session.work_dir(spark, "gate")
    for part in _three_parts(requests):
        part.write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(requests.schema).parquet(f"{folder}/in")
        decided = gate_stream.decide(
            stream, volume.users(spark, sf), volume.sessions(spark, sf), delay="2 days"
        )
        gate_stream.write_decisions(
            decided, f"{folder}/out", f"{folder}/checkpoint", available_now=True
        ).awaitTermination()
    out = spark.read.schema(decided.schema).parquet(f"{folder}/out")
    return out.select("request_id", "user_id", "session_id", "status")


@_register
def gate_batches(spark, sf):
    """The requests in three batches, each judged with what the earlier ones left in
    a store."""
    store = session.work_dir(spark, "gate")
    for number, batch in enumerate(_three_parts(volume.requests(spark, sf))):
        gate_stream.process_batch(
            batch, number, volume.users(spark, sf), volume.sessions(spark, sf), store
        )
    decided = gate_stream.decisions(spark, store)
    return decided.select("request_id", "user_id", "session_id", "status")


_LLM: dict[str, Query] = {}
_LLM_SQL: dict[str, str] = {}
if llm is not None:
    _LLM = llm.QUERIES | {"pipeline": corpus_pipeline.run}
    _LLM_SQL = dict(llm.ORACLE_SQL)
    if corpus_pipeline.ORACLE_SQL is not None:
        _LLM_SQL["pipeline"] = corpus_pipeline.ORACLE_SQL


def entry(spark: SparkSession) -> DataFrame:
    """Student overview with quota share."""
    return _QUERIES["student_quota_share"](spark, "/root/testdata/sf0.001")


def queries() -> dict[str, Query]:
    return _QUERIES | _LLM


def oracle_sql() -> dict[str, str]:
    return oracle_queries.all_sql() | _LLM_SQL
