"""Structure of conversations repaired by the cheapest edits, with an audit of them.

A conversation's roles should be ``(s?(ua)+)?``: at most one system turn, then pairs
of user and assistant. Rows are kept (cost 0), given another role (R, 3), deleted
(D, 4; a must for blank and repeated ones), turns without text are inserted (I, 3),
and a truncated row that stays adds 3. Of the cheapest edits those count whose
letters, in order, come first in ASCII.

The dynamic programme runs over (row, state), the state being what the last role
was. What a state has been reached by is a node that points to the one before, so
prefixes are shared. A node knows its ancestors 1, 2, 4 ... edits back and a rolling
hash of all its letters; equal costs are decided by searching, with these, the first
edit in which both differ. Equal hashes are verified: the nodes before that edit
must be the same.

Rows are dealt to tasks by ranges of (conversation, turn), so a conversation of any
length is spread over many, and a task reads its rows in order. A conversation that
lies within a task and isn't long is finished there. Of others each piece is solved
from every state to every state; pieces are put together by the same programme over
pieces, for which the ranks of a piece's letters are enough, and then written out
in a stream, piece by piece.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chalktally.llm import shared

#: What a task holds of a conversation before it goes on as a piece.
PIECE_ROWS, PIECE_CHARS = 4096, 4_000_000
OUT_ROWS = 2000

# Costs, and the states that the last role leads to.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = 4
NAMES = {USER: "user", ASSISTANT: "assistant"}
LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}
FINE, CUT, GONE = range(3)

_MODULUS, _BASE = (1 << 61) - 1, 1_000_003


class Trails:
    """Sequences that share their beginnings. Node 0 is the empty one; ``less``
    compares sequences of the same number of steps."""

    def __init__(self) -> None:
        self.step: list = [None]
        self.value = [0]
        self.up: list[list[int]] = [[]]
        self.codes: dict = {}

    def add(self, parent: int, step) -> int:
        code = self.codes.setdefault(step, len(self.codes) + 1)
        up, k = [parent], 0
        while k < len(self.up[up[k]]):
            up.append(self.up[up[k]][k])
            k += 1
        self.step.append(step)
        self.value.append((self.value[parent] * _BASE + code) % _MODULUS)
        self.up.append(up)
        return len(self.step) - 1

    def steps(self, node: int) -> list:
        out = []
        while node:
            out.append(self.step[node])
            node = self.up[node][0]
        return out[::-1]

    def less(self, one: int, other: int) -> bool:
        a, b = one, other
        if a == b:
            return False
        k = len(self.up[a])
        while k:
            k -= 1
            if k < len(self.up[a]):
                x, y = self.up[a][k], self.up[b][k]
                if self.value[x] != self.value[y]:
                    a, b = x, y
        if self.up[a][0] != self.up[b][0] or self.step[a] == self.step[b]:
            return self.steps(one) < self.steps(other)  # hashes met by chance
        return self.step[a] < self.step[b]


@dataclass
class Best:
    """Per state the least cost and its trail."""

    trails: Trails
    cost: list[int | None]
    node: list[int]

    @classmethod
    def at(cls, state: int) -> Best:
        cost: list[int | None] = [None] * STATES
        cost[state] = 0
        return cls(Trails(), cost, [0] * STATES)

    def advance(self, ways: list[tuple[int, int, int, object]]) -> None:
        """One step along the best of ``ways`` (from, to, cost, step) into each state.
        Of different states no trail begins with another, so trails decide before
        steps do."""
        cost: list[int | None] = [None] * STATES
        chosen: list = [None] * STATES
        for source, target, price, step in ways:
            if self.cost[source] is None:
                continue
            total, node = self.cost[source] + price, self.node[source]
            if cost[target] is None or total < cost[target]:
                cost[target], chosen[target] = total, (node, step)
            elif total == cost[target]:
                rival, other = chosen[target]
                if (step < other) if node == rival else self.trails.less(node, rival):
                    chosen[target] = (node, step)
        self.cost = cost
        self.node = [self.trails.add(*c) if c else 0 for c in chosen]


def _ways(initial: str, kind: int, count: int) -> list[tuple[int, int, int, str]]:
    """The edits of a row. Inserting before a deletion is never first in ASCII, and
    inserting twice before a row never cheapest."""
    gone = [(s, s, DELETE * count, "D" * count) for s in range(STATES)]
    if kind == GONE:
        return gone
    more = TRUNCATED if kind == CUT else 0
    u = ("K", more) if initial == "u" else ("R", more + REROLE)
    a = ("K", more) if initial == "a" else ("R", more + REROLE)
    ways = [(s, USER, u[1], u[0]) for s in (START, SYSTEM, ASSISTANT)]
    ways += [(USER, USER, u[1] + INSERT, "I" + u[0]), (USER, ASSISTANT, a[1], a[0])]
    ways += [(s, ASSISTANT, a[1] + INSERT, "I" + a[0]) for s in (START, SYSTEM, ASSISTANT)]
    if initial == "s":
        ways.append((START, SYSTEM, more, "K"))
    return gone + ways


# Every edit but many deletions at once has few forms.
_WAYS = {(i, k): _ways(i, k, 1) for i in ("s", "u", "a", "") for k in (FINE, CUT, GONE)}
#: Letters and cost that make a state a good end.
ENDS = {START: ("", 0), ASSISTANT: ("", 0), USER: ("I", INSERT), SYSTEM: ("II", 2 * INSERT)}


@dataclass
class Part:
    """Rows of one conversation in order, and what is counted over them."""

    conv_id: object
    rows: list[tuple[str, str, int, int]] = field(default_factory=list)
    chars: int = 0
    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0
    turns: int = 0
    first: str | None = None
    last: str | None = None
    low: int | None = None
    high: int | None = None

    def add(self, turn: int | None, role: str, text: str, n: int, fresh: bool) -> None:
        said = text.strip("\x20\x09\x0a\x0b\x0c\x0d")
        initial = role[:1]
        if not said:
            self.blank += n
            self.rows.append((role, "", GONE, n))
        else:
            if fresh:
                cut = said[-1] not in ".!?"
                self.truncated += cut
                self.rows.append((role, text, CUT if cut else FINE, 1))
            again = n - fresh
            if again:
                self.duplicate += again
                self.rows.append((role, "", GONE, again))
        self.chars += len(text)
        self.illegal += n - 1 + (self.last is not None and (self.last, initial) not in LEGAL)
        if self.first is None:
            self.first = initial
        self.last = initial
        if turn is not None:
            if self.high != turn:
                self.turns += 1
            self.low = turn if self.low is None else self.low
            self.high = turn

    def full(self) -> bool:
        return len(self.rows) >= PIECE_ROWS or self.chars >= PIECE_CHARS

    def solved(self, start: int = START) -> Best:
        best = Best.at(start)
        for role, _, kind, n in self.rows:
            key = (role[:1] if role[:1] in ("s", "u", "a") else "", kind)
            best.advance(_WAYS[key] if n == 1 else _ways(*key, n))
        return best


def finish(best: Best) -> tuple[int, int, str]:
    """(cost, state, letters at the end) of the best good end."""
    chosen = None
    for state, (letters, price) in ENDS.items():
        if best.cost[state] is None:
            continue
        total = best.cost[state] + price
        if chosen is None or total < chosen[0]:
            chosen = (total, state, letters)
        elif total == chosen[0] and best.trails.less(best.node[state], best.node[chosen[1]]):
            chosen = (total, state, letters)
    return chosen


def lines(rows: list[tuple[str, str, int]], letters: str, state: int) -> tuple[list[str], int]:
    """The repaired rows as ``role:text``, and the state they end in. ``rows`` are
    (role, text, count); ``letters`` may go on behind them."""
    out: list[str] = []
    wanted = (USER, USER, ASSISTANT, USER)
    letter = iter(letters)

    def inserted(state: int) -> int:
        state = wanted[state]
        out.append(f"{NAMES[state]}:")
        return state

    for role, text, n in rows:
        edit = next(letter)
        if edit == "I":
            state = inserted(state)
            edit = next(letter)
        if edit == "D":
            for _ in range(n - 1):
                next(letter)
            continue
        if edit == "K":
            state = SYSTEM if role[:1] == "s" else wanted[state]
        else:
            state = wanted[state]
            role = NAMES[state]
        out.append(f"{role}:{text}")
    for _ in letter:
        state = inserted(state)
    return out, state


_COUNTS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long"
_SHAPE = (
    "pos long, blank long, duplicate long, truncated long, illegal long, turns long, "
    "first string, last string, low long, high long, costs array<long>, ranks array<int>"
)
_BODY = "audits array<string>, roles array<string>, texts array<string>, counts array<long>"


def _names(schema: str) -> list[str]:
    return [part.split()[0] for part in schema.split(", ")]


def _type(kind: str) -> pa.DataType:
    plain = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    return pa.list_(plain[kind[6:-1]]) if kind.startswith("array<") else plain[kind]


def _batch(rows: list[dict], schema: str, ids: pa.DataType) -> pa.RecordBatch:
    names, kinds = ["conv_id"], [ids]
    for part in schema.split(", "):
        name, kind = part.split()
        names.append(name)
        kinds.append(_type(kind))
    arrays = [pa.array([r.get(n) for r in rows], k) for n, k in zip(names, kinds, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, names)


def _said(role: Column, text: Column) -> Column:
    return F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))


def ordered(rows: DataFrame) -> DataFrame:
    """Equal rows as one with their number ``n``, by ranges of conversation and
    turn, in order; before the row in which a role first says a text there is one
    with n = 0. Equal rows are counted before they are dealt."""
    space = F.lit(" ")
    said = rows.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), space).alias("role"),
        F.coalesce(F.col("text").cast("string"), space).alias("text"),
    ).withColumn("said", _said(F.col("role"), F.col("text")))
    grouped = said.groupBy("conv_id", "turn", "said", "role", "text").agg(F.count("*").alias("n"))
    # The least of structs: without a turn comes first.
    first = said.groupBy("conv_id", "said").agg(F.min(F.struct("turn")).alias("least"))
    marks = first.select(
        "conv_id", F.col("least.turn").alias("turn"), "said",
        F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"),
        F.lit(0).cast("long").alias("n"),
    )
    order = ("conv_id", "turn", "said")
    return grouped.unionByName(marks).repartitionByRange(*order).sortWithinPartitions(*order, "n")


def _solved_alone(part: Part, digest: bool) -> dict:
    best = part.solved()
    cost, state, end = finish(best)
    audit = "".join(best.trails.steps(best.node[state])) + end
    text = "\n".join(lines([(r, t, n) for r, t, _, n in part.rows], audit, START)[0])
    return {
        "conv_id": part.conv_id,
        "gaps": part.high - part.low + 1 - part.turns if part.turns else 0,
        "blank": part.blank, "duplicate": part.duplicate, "truncated": part.truncated,
        "illegal": part.illegal, "cost": cost, "audit": audit,
        "repaired": hashlib.sha256(text.encode()).hexdigest() if digest else text,
    }


def _piece(part: Part, pos: int) -> dict:
    costs: list = []
    audits: list = []
    for start in range(STATES):
        best = part.solved(start)
        costs += best.cost
        audits += [
            None if c is None else "".join(best.trails.steps(n))
            for c, n in zip(best.cost, best.node, strict=True)
        ]
    rank = {a: i for i, a in enumerate(sorted({a for a in audits if a is not None}))}
    same = ("blank", "duplicate", "truncated", "illegal", "turns", "first", "last", "low", "high")
    return {
        "conv_id": part.conv_id, "pos": pos, "costs": costs, "audits": audits,
        "ranks": [rank.get(a) for a in audits],
        "roles": [r for r, *_ in part.rows], "texts": [t for _, t, *_ in part.rows],
        "counts": [n for *_, n in part.rows],
    } | {name: getattr(part, name) for name in same}


def _columns(batch: pa.RecordBatch) -> Iterator[tuple]:
    return zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _first_pass(digest: bool, schema: str):
    """Conversations that lie within a task, finished; pieces of the others. Of the
    first and the last one of a task the rest may lie elsewhere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        pos = (context.partitionId() if context else 0) << 32
        out: list[dict] = []
        part: Part | None = None
        mark: tuple | None = None
        ids = None
        inside = False
        for batch in batches:
            ids = batch["conv_id"].type
            for conv_id, turn, said, role, text, n in _columns(batch):
                if part is not None and part.conv_id != conv_id:
                    if inside:
                        out.append(_solved_alone(part, digest))
                    elif part.rows:
                        out.append(_piece(part, pos))
                        pos += 1
                    inside, part = True, Part(conv_id)
                elif part is None:
                    part = Part(conv_id)
                elif part.full():
                    out.append(_piece(part, pos))
                    pos += 1
                    inside, part = False, Part(conv_id)
                if n == 0:
                    mark = (conv_id, turn, said)
                else:
                    part.add(turn, role, text, n, mark == (conv_id, turn, said))
                if len(out) >= OUT_ROWS or (out and "pos" in out[-1]):
                    yield _batch(out, schema, ids)
                    out = []
        if part is not None and part.rows:
            out.append(_piece(part, pos))
        if out:
            yield _batch(out, schema, ids)

    return run


_CHOICE = "pos long, start int, target int, " + _COUNTS + ", ending string"


def _choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per piece the states it leads from and to, with the last one the counts of
    the whole conversation. Pieces come in order."""
    held: list[tuple] = []
    names: list[str] = []
    ids = None

    def chosen() -> list[dict]:
        best = Best.at(START)
        total = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "turns"), 0)
        low = high = last = None
        for row in held:
            p = dict(zip(names, row, strict=True))
            ways = [
                (s, t, p["costs"][STATES * s + t], (p["ranks"][STATES * s + t], s, t))
                for s in range(STATES)
                for t in range(STATES)
                if p["costs"][STATES * s + t] is not None
            ]
            best.advance(ways)
            for name in total:
                total[name] += p[name]
            if last is not None and (last, p["first"]) not in LEGAL:
                total["illegal"] += 1
            if high is not None and p["low"] == high:
                total["turns"] -= 1
            last = p["last"]
            low = p["low"] if low is None else low
            high = high if p["high"] is None else p["high"]
        cost, state, end = finish(best)
        path = best.trails.steps(best.node[state])
        at = names.index("pos")
        out = [
            {"conv_id": row[0], "pos": row[at], "start": s, "target": t}
            for row, (_, s, t) in zip(held, path, strict=True)
        ]
        turns = total.pop("turns")
        out[-1] |= total
        out[-1] |= {"cost": cost, "ending": end, "gaps": high - low + 1 - turns if turns else 0}
        return out

    for batch in batches:
        names, ids = batch.schema.names, batch["conv_id"].type
        for row in _columns(batch):
            if held and held[0][0] != row[0]:
                yield _batch(chosen(), _CHOICE, ids)
                held = []
            held.append(row)
    if held:
        yield _batch(chosen(), _CHOICE, ids)


_RESULT = _COUNTS + ", audit string, repaired string"


def _write_out(digest: bool):
    """Pieces behind their choices, in order: the letters, and the text hashed as it
    comes by (or kept, if wanted)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        choice: dict = {}
        audit: list[str] = []
        kept: list[str] = []
        text = hashlib.sha256()
        begun = False
        for batch in batches:
            names, ids = batch.schema.names, batch["conv_id"].type
            for row in _columns(batch):
                p = dict(zip(names, row, strict=True))
                if p["start"] is not None:
                    choice = p
                    continue
                letters = p["audits"][STATES * choice["start"] + choice["target"]]
                letters += choice["ending"] or ""
                audit.append(letters)
                rows = list(zip(p["roles"], p["texts"], p["counts"], strict=True))
                made, _ = lines(rows, letters, choice["start"])
                if made:
                    joined = ("\n" if begun else "") + "\n".join(made)
                    begun = True
                    if digest:
                        text.update(joined.encode())
                    else:
                        kept.append(joined)
                if choice["cost"] is not None:
                    done = {n: choice[n] for n in ("conv_id", *_names(_COUNTS))}
                    done["audit"] = "".join(audit)
                    done["repaired"] = text.hexdigest() if digest else "".join(kept)
                    yield _batch([done], _RESULT, ids)
                    audit, kept, text, begun = [], [], hashlib.sha256(), False

    return run


def repaired(rows: DataFrame, digest: bool = False) -> DataFrame:
    """Per conversation of ``rows`` (conv_id, turn, role, text): conv_id, gaps, blank,
    duplicate, truncated, illegal, cost, audit and repaired, the rows after the
    cheapest edits as ``role:text`` with line feeds between, or with ``digest`` the
    SHA-256 of that in hexadecimal, for which no text is held whole.

    Rows are taken by turn, those without one first, and those of one turn by a
    hash of role and text. A null role or text is one blank; rows without a
    conv_id are a conversation; other columns aren't looked at; an empty table
    gives an empty result. Equal rows are duplicates of the first of them.
    """
    ids = rows.schema["conv_id"].dataType.simpleString()
    schema = f"{_RESULT}, {_SHAPE}, {_BODY}"
    # Both parts have counts of the same names: those of a piece are its own.
    names = list(dict.fromkeys(_names(schema)))
    kinds = dict(reversed([p.split() for p in schema.split(", ")]))
    schema = ", ".join(f"{n} {kinds[n]}" for n in names)
    first = shared.written(
        ordered(rows).select("conv_id", "turn", "said", "role", "text", "n")
        .mapInArrow(_first_pass(digest, schema), f"conv_id {ids}, {schema}"),
        "conversations",
    )
    done = first.where("pos is null").select("conv_id", *_names(_RESULT))
    pieces = first.where("pos is not null")
    choices = shared.written(
        pieces.select("conv_id", *_names(_SHAPE))
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "pos")
        .mapInArrow(_choose, f"conv_id {ids}, {_CHOICE}"),
        "choices",
    )
    stream = (
        choices.unionByName(pieces.select("conv_id", "pos", *_names(_BODY)), allowMissingColumns=True)
        .repartition("conv_id")
        # The choice, which has a start, comes before its piece.
        .sortWithinPartitions("conv_id", "pos", F.col("start").asc_nulls_last())
    )
    rest = stream.mapInArrow(_write_out(digest), f"conv_id {ids}, {_RESULT}")
    return done.unionByName(rest)
