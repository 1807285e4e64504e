"""The rules of the platform on small tables, each with its edge cases."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from chalktally.functions import expr
from chalktally.operators import (
    changes,
    checks,
    gate,
    prompts,
    rules,
    sessions,
    usage,
    users,
)
from chalktally.plans import audit, chat, overview
from chalktally.sources import seed
from chalktally.sources import tables as tb
from rows import TODAY, academy, as_dict, as_set, at, message, table, tables, user


@pytest.fixture
def room(spark):
    return academy(spark)


# --- users and usage -------------------------------------------------------


def test_active_users_leave_out_the_deleted(room):
    assert as_set(users.active(room.users), "id") == {
        ("vega",), ("pilar",), ("quentin",), ("chen",), ("ana",), ("boris",)
    }
    assert users.active_count(room.users).collect()[0].active_users == 6
    assert "hashed_password" not in users.active(room.users).columns


def test_overview_shows_students_without_usage_as_zero(room):
    got = overview.student_overview(room.users, room.usage_stats, TODAY)
    assert as_set(got, "id", "tokens_used_today", "request_count_today", "band") == {
        ("chen", 280, 9, "danger"), ("ana", 0, 0, "ok"), ("boris", 0, 0, "ok")
    }


def test_overview_does_not_count_other_days(room):
    got = usage.student_overview(room.users, room.usage_stats, TODAY - dt.timedelta(days=1))
    assert as_dict(got, "id", "tokens_used_today") == {"chen": 0, "ana": 77, "boris": 0}


def test_quota_use_is_for_every_role(room):
    got = usage.quota_use(room.users, room.usage_stats, TODAY)
    assert as_set(got, "id", "used", "limit") == {
        ("vega", 0, 50_000), ("pilar", 0, 50_000), ("quentin", 0, 900),
        ("chen", 280, 300), ("ana", 0, 50_000), ("boris", 0, 0),
    }


def test_quota_share_bounds(spark):
    cases = [(0, 0), (5, 0), (70, 100), (71, 100), (90, 100), (91, 100), (250, 100), (1, 200)]
    df = spark.createDataFrame(cases, "used long, quota int")
    got = [tuple(r)[2:] for r in usage.with_quota_share(df, "used", "quota").collect()]
    assert got == [
        (0.0, "ok", "0%"), (0.0, "ok", "0%"), (70.0, "ok", "70%"), (71.0, "warn", "71%"),
        (90.0, "warn", "90%"), (91.0, "danger", "91%"), (100.0, "danger", "100%"),
        (0.5, "ok", "1%"),
    ]


def test_resolve_names_ignores_deleted_accounts(spark, room):
    names = spark.createDataFrame([("chen",), ("dora",), ("nobody",)], "username string")
    assert as_dict(users.resolve_names(names, room.users), "username", "user_id") == {
        "chen": "chen", "dora": None, "nobody": None
    }


def test_usage_of_messages_counts_model_rows_only(room):
    got = usage.rollup(room.messages, room.sessions)
    assert as_set(got, "user_id", "date", "tokens_used", "request_count") == {
        ("chen", TODAY, 63, 2)
    }


def test_merge_adds_to_a_day_and_inserts_another(spark, room):
    delta = table(
        spark, "usage_stats", [("chen", TODAY, 6, 1), ("ana", TODAY, 20, 1)]
    )
    twice = usage.merge(usage.merge(room.usage_stats, delta), delta)
    assert as_set(twice, "user_id", "tokens_used", "request_count") == {
        ("chen", 292, 11), ("ana", 40, 2), ("ana", 77, 3)
    }


# --- gates -----------------------------------------------------------------


def test_role_gates(spark, room):
    callers = ["vega", "quentin", "boris", "dora", "ghost"]
    asked = spark.createDataFrame(
        [(u, g) for u in callers for g in ("user", "teacher", "admin")], "user_id string, gate string"
    )
    got = as_set(gate.role_decisions(asked, room.users, "gate"), "user_id", "gate", "status")
    assert got == {
        ("vega", "user", 200), ("vega", "teacher", 200), ("vega", "admin", 200),
        ("quentin", "user", 200), ("quentin", "teacher", 200), ("quentin", "admin", 403),
        ("boris", "user", 200), ("boris", "teacher", 403), ("boris", "admin", 403),
        ("dora", "user", 401), ("dora", "teacher", 401), ("dora", "admin", 401),
        ("ghost", "user", 401), ("ghost", "teacher", 401), ("ghost", "admin", 401),
    }


def test_own_accounts(spark, room):
    asked = spark.createDataFrame([("ana",), ("dora",), ("ghost",)], "user_id string")
    assert as_set(gate.own_accounts(asked, room.users), "user_id", "username", "status") == {
        ("ana", "ana", 200), ("dora", None, 401), ("ghost", None, 401)
    }


def test_areas_by_role(room):
    assert as_set(gate.areas(room.users), "id", "area") == {
        ("vega", "Admin Panel"), ("vega", "Teacher Console"), ("vega", "AI Chat"),
        *((t, area) for t in ("pilar", "quentin") for area in ("Teacher Console", "AI Chat")),
        ("chen", "AI Chat"), ("ana", "AI Chat"), ("boris", "AI Chat"),
    }


@pytest.fixture
def lounge(spark):
    """Two students with quota 100, one session each, and one deleted session."""
    return tables(
        spark,
        users=[user("one", quota=100), user("two", quota=100), user("zero", quota=0),
               user("gone", deleted=True)],
        teacher_rules=[("r9", "t", "one", '{"instruction": "Use metric units"}', True)],
        sessions=[
            ("s1", "one", None, None, False, at(0)),
            ("s2", "two", None, "", False, at(1)),
            ("s3", "one", "r0", "Old", True, at(2)),
            ("s4", "zero", None, None, False, at(3)),
        ],
        messages=[message("a", "s1", "user", "hi", -5), message("b", "s1", "llm", "hello", -5, (1, 1))],
    )


def _requests(spark, rows):
    return spark.createDataFrame(
        [(i, u, s, m, at(i)) for i, (u, s, m) in enumerate(rows)],
        "request_id long, user_id string, session_id string, message string, created_at timestamp",
    )


def test_chat_gate_order_and_quota_boundary(spark, lounge):
    asked = _requests(
        spark,
        [("one", "s1", "x"), ("one", "s2", "x"), ("one", "s3", "x"), ("one", "none", "x"),
         ("ghost", "s1", "x"), ("gone", "s1", "x"), ("two", "s2", "x"), ("zero", "s4", "x")],
    )

    def decide(*rows):
        stats = table(spark, "usage_stats", rows)
        got = gate.chat_decisions(asked, lounge.users, lounge.sessions, stats, TODAY)
        return [r.status for r in got.orderBy("request_id").collect()]

    # Quota 0 without a usage row passes.
    assert decide() == [200, 404, 404, 404, 401, 401, 200, 200]
    assert decide(("one", TODAY, 99, 1))[0] == 200
    # At the quota is over it, and only the caller's own session gets that far.
    assert decide(("one", TODAY, 100, 1))[:3] == [429, 404, 404]
    assert decide(("one", TODAY - dt.timedelta(days=1), 100, 1))[0] == 200
    assert decide(("zero", TODAY, 0, 0))[7] == 429


def test_session_read_gate(spark, lounge):
    asked = _requests(
        spark,
        [("one", "s1", ""), ("one", "s3", ""), ("one", "s2", ""), ("one", "none", ""), ("gone", "s1", "")],
    )
    decided, nested = audit.read_sessions(
        asked, lounge.users, lounge.sessions, lounge.messages
    )
    # A deleted session stays readable for its owner; 404 comes before 403.
    assert as_dict(decided, "request_id", "status") == {0: 200, 1: 200, 2: 403, 3: 404, 4: 401}
    assert {r.id: [m.content for m in r.messages] for r in nested.collect()} == {
        "s1": ["hi", "hello"], "s3": []
    }


def test_audit_gate(spark, room):
    asked = spark.createDataFrame(
        [("chen",), ("boris",), ("pilar",), ("dora",), ("ghost",)],
        "student_id string",
    )
    assert as_dict(gate.audit_decisions(asked, room.users), "student_id", "status") == {
        "chen": 200, "boris": 200, "pilar": 404, "dora": 404, "ghost": 404
    }


# --- rules and prompts -----------------------------------------------------


@pytest.fixture
def staff(spark):
    rows = [
        ("r1", "t1", "a", '{"b": 1, "a": [1, 2]}', True),
        ("r2", "t1", "a", "second", True),
        ("r0", "t1", "b", "off", False),
        ("r4", "t2", None, "plain words", True),
        ("r3", "t2", None, '"quoted é"', False),
    ]
    return table(spark, "teacher_rules", rows)


def test_effective_rule(spark, staff):
    people = table(spark, "users", [user("a"), user("b"), user("t1", "teacher")])
    # Targeted before everyone's, the lowest id among several; everyone's rule
    # reaches any role and any teacher's students.
    assert as_dict(rules.effective(people, staff), "user_id", "rule_id") == {
        "a": "r1", "b": "r4", "t1": "r4"
    }
    none = staff.where("student_id is not null")
    assert as_dict(rules.effective(people, none), "user_id", "rule_id") == {
        "a": "r1", "b": None, "t1": None
    }


def test_matching_rules(spark, staff):
    people = table(spark, "users", [user("a"), user("b")])
    assert as_set(rules.matching(people, staff), "user_id", "rule_id") == {
        ("a", "r1"), ("a", "r2"), (None, "r4")
    }
    assert as_set(rules.match_counts(people, staff), "user_id", "targeted", "everyone", "matching") == {
        ("a", 2, 1, 3), ("b", 0, 1, 1)
    }
    assert as_set(rules.matching_one(staff, "a"), "id") == {("r1",), ("r2",), ("r4",)}


def test_rules_of_a_teacher(staff):
    assert as_set(rules.of_teacher(staff, "t2"), "id", "scope", "state") == {
        ("r4", "All Students", "Active"), ("r3", "All Students", "Inactive")
    }
    assert rules.of_teacher(staff, "t3").count() == 0
    assert as_set(rules.by_teacher(staff), "id", "scope") >= {("r1", "Targeted")}


@pytest.mark.parametrize(
    ("raw", "text"),
    [
        ('{"b": 1, "a": [1, 2]}', '{"a":[1,2],"b":1}'),
        ("plain words", '"plain words"'),
        ('"quoted é"', '"quoted é"'),
        ("not { json", '"not { json"'),
        ("[]", "[]"),
        ("1.50", "1.5"),
        (None, None),
    ],
)
def test_rule_text(spark, raw, text):
    df = spark.createDataFrame([(raw,)], "raw string")
    assert df.select(expr.rule_text("raw").alias("t")).collect()[0].t == text


def test_a_broken_or_huge_rule_affects_its_own_row_only(spark):
    rows = [(0, "[1]"), (1, "1" * 5000), (2, "[" * 3000 + "]" * 3000), (3, '{"a": '), (4, "x" * 100_000)]
    df = spark.createDataFrame(rows, "i int, raw string")
    got = as_dict(df.select("i", expr.rule_text("raw").alias("t")), "i", "t")
    assert got[0] == "[1]" and got[3] == '"{\\"a\\": "' and got[4] == '"' + "x" * 100_000 + '"'
    assert all(got[i] for i in (1, 2))


def test_system_text(spark, staff):
    people = table(spark, "users", [user("a"), user("b")])
    base = "You are a helpful AI assistant."
    head = base + "\n\nTeacher Instructions:\n"
    assert as_dict(prompts.system_text(people, staff), "user_id", "system_prompt") == {
        "a": head + '{"a":[1,2],"b":1}', "b": head + '"plain words"'
    }
    off = staff.withColumn("is_active", F.lit(False))
    assert as_dict(prompts.system_text(people, off), "user_id", "system_prompt") == {
        "a": base, "b": base
    }


def test_history_is_the_last_twenty_oldest_first(spark):
    rows = [message(f"{i:02}", "s", "user" if i % 2 else "llm", f"t{i}", i) for i in range(23)]
    rows += [message("x", "short", "user", "only", 0)]
    got = prompts.history(table(spark, "messages", rows))
    texts = {r.position: r.content for r in got.where("session_id = 's'").collect()}
    assert [texts[i] for i in sorted(texts)] == [f"t{i}" for i in range(3, 23)]
    assert sorted(texts) == list(range(1, 21))
    assert as_set(got.where("session_id = 'short'"), "position", "content") == {(1, "only")}


def test_question_before_answer_at_the_same_instant(spark):
    rows = [message("a", "s", "llm", "answer", 5, (1, 1)), message("b", "s", "user", "question", 5)]
    lists = prompts.history_lists(table(spark, "messages", rows))
    assert [m.content for m in lists.collect()[0].history] == ["question", "answer"]
    cut = prompts.history_lists(table(spark, "messages", rows), 1)
    assert [m.content for m in cut.collect()[0].history] == ["answer"]


def test_payload(spark, lounge):
    asked = _requests(spark, [("one", "s1", "What is a prime?"), ("two", "s2", "first")])
    got = chat.prepare(lounge, asked, TODAY)
    lists = {r.request_id: [(m.role, m.content) for m in r.payload] for r in got.prompts.collect()}
    units = '\n\nTeacher Instructions:\n{"instruction":"Use metric units"}'
    assert lists[0] == [
        ("system", "You are a helpful AI assistant." + units),
        ("user", "hi"), ("assistant", "hello"), ("user", "What is a prime?"),
    ]
    assert lists[1] == [("system", "You are a helpful AI assistant."), ("user", "first")]
    assert as_dict(got.sessions, "id", "applied_rule_id") == {
        "s1": "r9", "s2": None, "s3": "r0", "s4": None
    }


def test_settle_stores_pairs_and_charges_once(spark, lounge):
    asked = _requests(spark, [("one", "s1", "What is a prime?"), ("two", "s2", "cut off")])
    replies = spark.createDataFrame(
        [(0, "One with two divisors.", 33, 6)],
        "request_id long, reply string, prompt_tokens int, completion_tokens int",
    )
    stats = table(spark, "usage_stats", [("two", TODAY, 1, 1)])
    got = chat.settle(asked, replies, stats)
    assert as_set(got.messages, "id", "sender", "content", "prompt_tokens", "completion_tokens", "total_tokens") == {
        ("0:user", "user", "What is a prime?", None, None, None),
        ("0:llm", "llm", "One with two divisors.", 33, 6, 39),
        ("1:user", "user", "cut off", None, None, None),
        ("1:llm", "llm", "", 10, 10, 20),
    }
    assert as_set(got.usage_stats, "user_id", "tokens_used", "request_count") == {
        ("one", 39, 1), ("two", 21, 2)
    }
    both = lounge.messages.unionByName(got.messages)
    texts = [m.content for m in sessions.with_messages(lounge.sessions, both).where("id = 's1'").collect()[0].messages]
    assert texts == ["hi", "hello", "What is a prime?", "One with two divisors."]


# --- sessions --------------------------------------------------------------


def test_listing_newest_first(spark):
    rows = [
        ("a", "u", None, "Tides", False, at(0)),
        ("b", "u", None, "Moons", False, at(5)),
        ("d", "u", None, None, False, at(5)),
        ("c", "u", None, "gone", True, at(9)),
        ("e", "v", None, "Comets", False, at(1)),
    ]
    df = table(spark, "sessions", rows)
    got = [(r.user_id, r.id) for r in sessions.listing(df).collect()]
    assert got == [("u", "d"), ("u", "b"), ("u", "a"), ("v", "e")]
    assert as_dict(sessions.newest(df), "user_id", "id") == {"u": "d", "v": "e"}


def test_audit_is_for_live_students(spark, room):
    extra = table(
        spark,
        "sessions",
        [("x1", "pilar", None, "t", False, at(1)), ("x2", "dora", None, "d", False, at(1)),
         ("x3", "boris", None, "", False, at(1)), ("x4", "chen", None, "del", True, at(1))],
    )
    every = room.sessions.unionByName(extra)
    assert [r.id for r in sessions.audit(every, room.users).collect()] == ["s2", "x3", "s3", "s1"]
    nested = audit.student_history(every, room.users, room.messages)
    assert {(r.id, r.label): len(r.messages) for r in nested.collect()} == {
        ("s1", "Scales"): 2, ("s2", "Untitled Session"): 1, ("s3", "Chords"): 2,
        ("x3", "Untitled Session"): 0,
    }
    counts = sessions.summary(every, room.messages)
    assert as_set(counts.where("user_id in ('chen', 'boris')"), "id", "title", "message_count") == {
        ("s1", "Scales", 2), ("s3", "Chords", 2), ("x3", "Untitled Session", 0)
    }


# --- changes ---------------------------------------------------------------


def _candidates(spark, rows):
    return spark.createDataFrame(
        rows, "row_id long, id string, username string, role string, daily_token_quota int"
    )


def test_create_users(spark, room):
    new = _candidates(
        spark,
        [
            (1, "n1", "fresh", None, None),
            (2, "n2", "fresh", "teacher", 5),
            (3, "n3", "chen", None, None),
            (4, "n4", "dora", None, None),
            (5, "n5", "", None, None),
            (6, "n6", "x" * 151, None, None),
            (7, "n7", "neg", None, -5),
            (8, "n8", "odd", "guest", None),
            (9, "n9", None, None, None),
            (0, "n0", "later", "guest", None),
            (10, "n10", "later", "admin", 0),
        ],
    )
    got = changes.create_users(room.users, new)
    assert as_dict(got.statuses, "row_id", "status") == {
        0: 422, 1: 201, 2: 409, 3: 409, 4: 409, 5: 422, 6: 422, 7: 422, 8: 422, 9: 422, 10: 201
    }
    fresh = got.snapshot.where("id like 'n%'")
    assert as_set(fresh, "id", "username", "role", "daily_token_quota", "is_deleted") == {
        ("n1", "fresh", "student", 50_000, False), ("n10", "later", "admin", 0, False)
    }
    assert got.snapshot.count() == 9


def test_seed_accounts_fit_an_empty_installation_once(spark):
    first = changes.create_users(table(spark, "users"), seed.account_candidates(spark))
    assert first.snapshot.count() == 4
    again = changes.create_users(first.snapshot, seed.account_candidates(spark))
    assert {r.status for r in again.statuses.collect()} == {409}


def test_set_quota(spark, room):
    rows = [(1, "chen", 10), (3, "chen", 35), (2, "chen", 20), (4, "chen", -5),
            (5, "dora", 7), (6, "ghost", 7), (7, "quentin", 0), (8, "vega", None)]
    df = spark.createDataFrame(rows, "change_id long, user_id string, daily_token_quota int")
    got = changes.set_quota(room.users, df)
    assert as_dict(got.statuses, "change_id", "status") == {
        1: 200, 2: 200, 3: 200, 4: 422, 5: 404, 6: 404, 7: 200, 8: 422
    }
    assert as_dict(got.snapshot, "id", "daily_token_quota") == {
        "vega": 50_000, "pilar": 50_000, "quentin": 0,
        "chen": 35, "ana": 50_000, "boris": 0, "dora": 50_000,
    }


def test_soft_delete_keeps_the_row(spark, room):
    rows = [(1, "ana"), (2, "ana"), (3, "dora"), (4, "ghost")]
    df = spark.createDataFrame(rows, "change_id long, user_id string")
    got = changes.soft_delete(room.users, df)
    assert as_dict(got.statuses, "change_id", "status") == {1: 204, 2: 404, 3: 404, 4: 404}
    assert as_dict(got.snapshot, "id", "is_deleted") == {
        **dict.fromkeys(("vega", "pilar", "quentin", "chen", "boris"), False), "ana": True, "dora": True
    }


def test_toggles(spark, staff):
    rows = [(1, "r1"), (2, "r2"), (3, "r1"), (4, "none"), (5, "r0")]
    df = spark.createDataFrame(rows, "change_id long, rule_id string")
    got = changes.toggle_rules(staff, df)
    assert as_set(got.statuses, "change_id", "status", "is_active") == {
        (1, 200, False), (2, 200, False), (3, 200, True), (4, 404, None), (5, 200, True)
    }
    assert as_dict(got.snapshot, "id", "is_active") == {
        "r1": True, "r2": False, "r0": True, "r4": True, "r3": False
    }
    twice = changes.toggle_rules(got.snapshot, df).snapshot
    assert as_set(twice, *staff.columns) == as_set(staff, *staff.columns)


def test_create_sessions_and_rules(spark, room):
    new = spark.createDataFrame(
        [("n1", "boris", None, at(1)), ("n2", "boris", "t" * 256, at(1)), ("n3", "boris", "t" * 255, at(1))],
        "id string, user_id string, title string, created_at timestamp",
    )
    got = changes.create_sessions(room.sessions, new)
    assert as_dict(got.statuses, "id", "status") == {"n1": 201, "n2": 422, "n3": 201}
    assert as_set(got.snapshot, "id", "is_deleted") == {
        *((s, False) for s in ("s1", "s2", "s3", "n1", "n3"))
    }
    wanted = spark.createDataFrame(
        [("q1", "pilar", None, {"k": "v"}, None), ("q2", "pilar", "boris", {}, False)],
        "id string, teacher_id string, student_id string, rules_json map<string,string>, is_active boolean",
    )
    got = changes.create_rules(room.teacher_rules, wanted)
    assert as_set(got.snapshot.where("id like 'q%'"), "id", "student_id", "rules_json", "is_active") == {
        ("q1", None, '{"k":"v"}', True), ("q2", "boris", "{}", False)
    }


def test_bind_needs_an_admitted_request(spark, room):
    some = spark.createDataFrame([("s1",), ("s2",), ("s1",)], "session_id string")
    got = changes.bind_rules(room.sessions, room.users, room.teacher_rules, some)
    assert as_dict(got, "id", "applied_rule_id") == {
        "s1": "r1", "s2": "r2", "s3": None
    }
    got = changes.bind_rules(room.sessions, room.users, room.teacher_rules, some.limit(0))
    assert as_dict(got, "id", "applied_rule_id") == dict.fromkeys(("s1", "s2", "s3"))


def test_purge_takes_everything_along(spark, room):
    more = room._replace(
        sessions=room.sessions.unionByName(
            table(spark, "sessions", [("s7", "boris", "r1", None, False, at(1)),
                                      ("s8", "boris", "r2", None, False, at(1))])
        ),
    )
    gone = spark.createDataFrame([("chen",), ("chen",)], "user_id string")
    left = changes.purge_users(more, gone)
    assert left.users.count() == 6
    assert as_set(left.teacher_rules, "id") == {("r2",), ("r3",)}
    assert as_set(left.usage_stats, "user_id") == {("ana",)}
    assert as_set(left.messages, "id") == {("m5",)}
    assert as_dict(left.sessions, "id", "applied_rule_id") == {"s2": None, "s7": None, "s8": "r2"}
    by_teacher = changes.purge_users(more, spark.createDataFrame([("pilar",)], "user_id string"))
    assert as_set(by_teacher.teacher_rules, "id") == {("r2",)}
    assert by_teacher.messages.count() == 5


# --- checks ----------------------------------------------------------------


def test_validate(spark):
    asked = spark.createDataFrame([("hi",), ("",), (" \n",), (None,)], "message string")
    got = checks.validate(asked, "requests")
    assert [r.reason for r in got.collect()] == [None, "message", "message", "message"]
    odd = spark.createDataFrame(
        [("m", "s", "system", "x", at(0)), ("m", "s", "llm", None, at(0))],
        "id string, session_id string, sender string, content string, created_at timestamp",
    )
    got = checks.validate(odd, "messages")
    assert [r.reason for r in got.collect()] == ["sender", "content missing"]


def test_duplicates_and_orphans(spark, room):
    again = room.usage_stats.unionByName(room.usage_stats)
    found = checks.duplicates(again, checks.UNIQUE_KEYS["usage_stats"]).collect()
    assert [r.n for r in found] == [2, 2]
    assert checks.duplicates(room.users, checks.UNIQUE_KEYS["users"]).count() == 0
    lost = table(
        spark,
        "sessions",
        [("s8", "ghost", None, None, False, at(0)), ("s9", "ana", "r7", None, False, at(0))],
    )
    bad = room._replace(sessions=room.sessions.unionByName(lost))
    assert as_set(checks.orphans(bad.sessions, "user_id", bad.users), "id") == {("s8",)}
    counts = as_dict(checks.orphan_counts(bad), "reference", "orphans")
    assert len(counts) == 6
    assert {k for k, n in counts.items() if n} == {"sessions.user_id", "sessions.applied_rule_id"}


def test_stored_usage_drift(room):
    drift = checks.stored_usage_drift(room).orderBy("user_id").collect()
    assert [(r.user_id, r.stored_tokens, r.expected_tokens) for r in drift] == [
        ("ana", 77, None), ("chen", 280, 63)
    ]
    exact = room._replace(usage_stats=usage.rollup(room.messages, room.sessions))
    assert checks.stored_usage_drift(exact).count() == 0


# --- tables ----------------------------------------------------------------


@pytest.mark.parametrize("buckets", [1, 7, 4096])
def test_drift_by_digests_is_the_drift(spark, buckets):
    day = [TODAY + dt.timedelta(days=i) for i in range(20)]
    kept = {(f"u{i}", d): (i + 1, 2) for i in range(25) for d in day}
    seen = dict(kept)
    seen["u3", day[4]] = (2, 4)  # counts the other way round
    del seen["u9", day[0]]
    seen["new", day[1]] = (1, 1)

    def side(rows):
        return table(spark, "usage_stats", [(*k, *v) for k, v in rows.items()])

    columns = ("user_id", "date", "stored_tokens", "stored_requests", "expected_tokens", "expected_requests")
    got = checks.usage_drift_by_digests(side(kept), side(seen), buckets)
    assert as_set(got, *columns) == as_set(checks.usage_drift(side(kept), side(seen)), *columns)
    assert got.count() == 3 and got.columns == checks.usage_drift(side(kept), side(seen)).columns
    args = (["user_id", "date"], ["tokens_used", "request_count"], buckets)
    one, other = checks.digests(side(kept), *args), checks.digests(side(seen), *args)
    assert 1 <= checks.differing(one, other).count() <= 3
    assert checks.differing(one, checks.digests(side(kept).repartition(5), *args)).isEmpty()
    # Both sides lose the buckets that are the same before they are joined.
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftSemi") == 2
    assert plan.index("Join FullOuter") < plan.index("Join LeftSemi")


def test_digests_tell_nulls_and_copies_apart(spark):
    def of(*rows):
        df = spark.createDataFrame(rows, "k int, a int, b int")
        return [tuple(r) for r in checks.digests(df, ["k"], ["a", "b"], 1).collect()]

    different = [of((1, None, 2)), of((1, 2, None)), of((1, 2, None), (1, 2, None)), of((1, 5, 5), (1, 5, 5))]
    assert len({str(d) for d in different}) == 4
    assert of() == []


def test_tables_round_trip(spark, room, tmp_path):
    tb.init(spark, str(tmp_path / "new"))
    tb.init(spark, str(tmp_path / "new"))
    empty = tb.load(spark, str(tmp_path / "new"))
    assert [df.count() for df in empty] == [0] * 5
    tb.append_messages(room.messages, str(tmp_path / "new"))
    tb.append_messages(room.messages, str(tmp_path / "new"))
    assert tb.load(spark, str(tmp_path / "new")).messages.count() == 10
    tb.save(room, str(tmp_path / "copy"))
    back = tb.load(spark, str(tmp_path / "copy"))
    for name, schema in tb.SCHEMAS.items():
        assert as_set(getattr(back, name), *schema.names) == as_set(
            getattr(room, name), *schema.names
        )
    plan = back.messages.where(F.col("created_date") == F.lit(TODAY))._jdf.queryExecution()
    assert "PartitionFilters: [isnotnull(created_date" in plan.toString()
