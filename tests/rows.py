"""Small hand-written tables in the declared schemas."""

from __future__ import annotations

import datetime as dt

from chalktally.sources import tables as tb

TODAY = dt.date(2024, 3, 4)


def at(minute: int, day: int = 4) -> dt.datetime:
    return dt.datetime(2024, 3, day, 10, 0) + dt.timedelta(minutes=minute)


def table(spark, name: str, rows=()):
    return spark.createDataFrame(list(rows), tb.SCHEMAS[name])


def user(id, role="student", quota=50_000, deleted=False, name=None):
    return (id, name or id, role, quota, deleted)


def message(id, session, sender, content, minute, tokens=None):
    prompt, completion = tokens or (None, None)
    total = prompt + completion if tokens else None
    return (id, session, sender, content, prompt, completion, total, at(minute))


def tables(spark, **given) -> tb.Tables:
    return tb.Tables(*(table(spark, name, given.get(name, ())) for name in tb.Tables._fields))


def academy(spark) -> tb.Tables:
    """A music course: an admin, two teachers, three students and one who left. One
    student is close to a small quota and has two sessions, another only asked
    yesterday and waits for an answer, the third has nothing. One rule is for a
    student, one for all, one is switched off."""
    return tables(
        spark,
        users=[
            user("vega", "admin"),
            user("pilar", "teacher"),
            user("quentin", "teacher", quota=900),
            user("chen", quota=300),
            user("ana"),
            user("boris", quota=0),
            user("dora", deleted=True),
        ],
        teacher_rules=[
            ("r1", "pilar", "chen", '{"style": "haiku", "max": 3}', True),
            ("r2", "quentin", None, "no spoilers", True),
            ("r3", "pilar", "ana", "[]", False),
        ],
        usage_stats=[("chen", TODAY, 280, 9), ("ana", TODAY - dt.timedelta(days=1), 77, 3)],
        sessions=[
            ("s1", "chen", None, "Scales", False, at(0)),
            ("s2", "ana", None, None, False, at(2)),
            ("s3", "chen", None, "Chords", False, at(4)),
        ],
        messages=[
            message("m1", "s1", "user", "What is a fifth?", 0),
            message("m2", "s1", "llm", "Seven semitones.", 0, (40, 8)),
            message("m3", "s3", "user", "And a fourth?", 4),
            message("m4", "s3", "llm", "Five.", 4, (12, 3)),
            message("m5", "s2", "user", "Which key is this in?", 2),
        ],
    )


def as_dict(df, key, value):
    return {row[key]: row[value] for row in df.collect()}


def as_set(df, *columns):
    return {tuple(row[c] for c in columns) for row in df.collect()}
