import hashlib
import itertools
import random
import re
import zlib

import duckdb
import pytest

from chalktally.llm import conversations, conversations_sql, queries

GOOD = re.compile("(s?(ua)+)?")
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
NAMES = {"u": "user", "a": "assistant"}


def faults(rows):
    """blank, duplicate, truncated or None per (role, text)."""
    out, seen = [], set()
    for role, text in rows:
        bare = text.strip(SPACE)
        out.append(
            "blank" if not bare
            else "duplicate" if (role, text) in seen
            else "truncated" if bare[-1] not in ".!?"
            else None
        )
        seen.add((role, text))
    return out


def cheapest(rows):
    """(cost, letters, lines) over all states with whole strings, inserting freely."""
    wanted = {"": "u", "s": "u", "u": "a", "a": "u"}

    def inserts(best):
        for _ in range(2):
            for state, (cost, letters, lines) in list(best.items()):
                new = wanted[state]
                way = (cost + 3, letters + "I", (*lines, f"{NAMES[new]}:"))
                best[new] = min(best.get(new, way), way)
        return best

    best = {"": (0, "", ())}
    for (role, text), fault in zip(rows, faults(rows), strict=True):
        best = inserts(best)
        after = {}
        for state, (cost, letters, lines) in best.items():
            ways = [(state, (cost + 4, letters + "D", lines))]
            if fault not in ("blank", "duplicate"):
                more = 3 if fault == "truncated" else 0
                legal = {"": "us", "s": "u", "u": "a", "a": "u"}[state]
                if role[:1] and role[:1] in legal:
                    ways.append((role[0], (cost + more, letters + "K", (*lines, f"{role}:{text}"))))
                new = wanted[state]
                ways.append((new, (cost + 3 + more, letters + "R", (*lines, f"{NAMES[new]}:{text}"))))
            for new, way in ways:
                after[new] = min(after.get(new, way), way)
        best = after
    best = inserts(best)
    return min(best[s] for s in ("", "a") if s in best)


def by_trying(rows, longest):
    """The same over all strings of letters."""
    found = []
    marks = faults(rows)
    for n in range(longest + 1):
        for letters in itertools.product("DIKR", repeat=n):
            if sum(x != "I" for x in letters) != len(rows):
                continue
            roles, lines, cost, at = "", [], 0, 0
            for x in letters:
                role, text = rows[at] if x != "I" else ("", "")
                at += x != "I"
                fault = marks[at - 1] if x != "I" else None
                if x == "D":
                    cost += 4
                    continue
                if fault in ("blank", "duplicate"):
                    cost = 1000
                cost += {"I": 3, "R": 3, "K": 0}[x] + (3 if fault == "truncated" else 0)
                new = "a" if roles[-1:] == "u" else "u"
                roles += role[:1] or "?" if x == "K" else new
                lines.append(f"{role if x == 'K' else NAMES[new]}:{text}")
            if GOOD.fullmatch(roles) and cost < 1000:
                found.append((cost, "".join(letters), tuple(lines)))
    return min(found)


def expected(rows):
    """Per conversation what the contract says, of rows after damage."""
    groups = {}
    for conv_id, turn, role, text in rows:
        groups.setdefault(conv_id, []).append((turn, *(" " if x is None else x for x in (role, text))))
    out = {}
    for conv_id, found in groups.items():
        found.sort(key=lambda r: (r[0] is not None, r[0], hashlib.md5(f"{len(r[1])}:{r[1]}{r[2]}".encode()).hexdigest()))
        pairs = [r[1:] for r in found]
        turns = [t for t, *_ in found if t is not None]
        kinds = faults(pairs)
        starts = [r[:1] for r, _ in pairs]
        cost, letters, lines = cheapest(pairs)
        out[conv_id] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
            *(kinds.count(k) for k in ("blank", "duplicate", "truncated")),
            sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(starts)),
            cost, letters, "\n".join(lines),
        )
    return out


def some_rows(rng, conv_id, n):
    roles = ["user", "assistant", "system", "tool", "agent", "", None, "user", "assistant", "user", "assistant"]
    texts = ["Yes.", "No!", "what", "", " \n", None, "Why?", "go on\x0b", "…", "é.\t"]
    texts += [f"text {i}{e}" for i in range(n) for e in ("", ".")]
    return [
        (conv_id, rng.choice([None, *range(n), *range(n)]), rng.choice(roles), rng.choice(texts)) for _ in range(n)
    ]


def check(spark, rows):
    df = spark.createDataFrame(
        [(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, said string, n int"
    )
    want = expected(rows)
    for digest in (False, True):
        got = conversations.repaired(df.repartition(7), digest).collect()
        assert len(got) == len(want)
        for r in got:
            *most, text = want[r.conv_id]
            assert tuple(r)[1:-1] == tuple(most), r.conv_id
            assert r.repaired == (hashlib.sha256(text.encode()).hexdigest() if digest else text)


def test_against_plain_version(spark):
    rng = random.Random(5)
    rows = [r for c in [None, *range(150)] for r in some_rows(rng, c, rng.randint(1, 14))]
    rows += [(200, 0, "user", "same.")] * 9 + [(201, i, "user", "same.") for i in range(9)]
    rows += [(202, i, "aaus"[i % 4], f"{i}.") for i in range(300)]
    check(spark, rows)


def test_in_pieces(spark, monkeypatch):
    first_pass = conversations._first_pass

    def small(*args):
        run = first_pass(*args)

        def of_task(batches):
            conversations.PIECE_ROWS = 3
            return run(batches)

        return of_task

    monkeypatch.setattr(conversations, "_first_pass", small)
    rng = random.Random(6)
    rows = [r for c in range(40) for r in some_rows(rng, c, rng.randint(1, 40))]
    rows += [(50, 0, "user", "same.")] * 50
    check(spark, rows)


@pytest.mark.parametrize("seed", range(40))
def test_dynamic_programme_against_all_edits(seed):
    rng = random.Random(seed)
    n = rng.randint(0, 4)
    rows = [(rng.choice(["user", "assistant", "system", "x"]), rng.choice(["a.", "b.", "c", ""])) for _ in range(n)]
    assert cheapest(rows) == by_trying(rows, 6 if n == 4 else 7)


def test_ties_by_first_difference():
    trails = conversations.Trails()
    rng = random.Random(1)
    ends = []
    for _ in range(40):
        node = 0
        for _ in range(rng.choice([33])):
            node = trails.add(node, rng.choice(["D", "K"]) if rng.random() < 0.2 else "R")
        ends.append(node)
    for _ in range(40):
        node = rng.choice(ends)
        for _ in range(rng.randint(1, 33)):
            node = trails.up[node][0]
        while len(trails.steps(node)) < 33:
            node = trails.add(node, rng.choice(["D", "K"]))
        ends.append(node)
    for a, b in itertools.product(ends, ends):
        assert trails.less(a, b) == (trails.steps(a) < trails.steps(b))
    trails.value = [0] * len(trails.value)  # every hash met by chance
    for a, b in itertools.product(ends[:20], ends):
        assert trails.less(a, b) == (trails.steps(a) < trails.steps(b))


def torn(rows):
    out = []
    for conv_id, turn, role, text in rows:
        fate = zlib.crc32(":".join(" " if x is None else str(x) for x in (conv_id, turn)).encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        row = (conv_id, turn, "user" if fate == 4 else role, text)
        out += [row] * (0 if fate == 0 else 2 if fate == 3 else 1)
    return out


def test_query_and_sql(spark, tmp_path):
    rng = random.Random(8)
    rows = [r for c in [None, *range(120)] for r in some_rows(rng, c, rng.randint(1, 8))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    want = expected(torn(rows))
    nothing = (0, 0, 0, 0, 0, 0, "", "")
    got = queries.op13_conversation_repair(spark, str(tmp_path))
    found = {r.conv_id: tuple(r)[1:] for r in got.collect()}
    assert set(found) == {r[0] for r in rows} and set(found) - set(want)
    for conv_id, values in found.items():
        *most, text = want.get(conv_id, nothing)
        assert values == (*most, hashlib.sha256(text.encode()).hexdigest())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    assert {r[0]: r[1:] for r in con.execute(conversations_sql.sql()).fetchall()} == found


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversations.repaired(df).collect() == []
