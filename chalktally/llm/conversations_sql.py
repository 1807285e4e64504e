"""DuckDB SQL for the conversation query: a recursion over rows that carries, for
every state, the least of (cost, letters so far, repaired text so far)."""

from __future__ import annotations

_SAID = "md5(CAST(length(role) AS VARCHAR) || ':' || role || text)"
_LEGAL = "('su', 'ua', 'au')"


def _way(state: int, cost: str, letters: str, lines: str) -> str:
    """Onwards from a state, NULL where that can't be reached."""
    s = f"w.s{state}"
    return (
        f"CASE WHEN {s} IS NULL THEN NULL ELSE {{'c': {s}.c + {cost}, 'a': {s}.a || {letters},"
        f" 'r': {s}.r || {lines}}} END"
    )


def _least(*ways: str) -> str:
    return f"list_min([{', '.join(ways)}])"


def sql() -> str:
    gone = [_way(s, "4", "'D'", "''") for s in range(4)]
    more = "(CASE WHEN o.fault = 'truncated' THEN 3 ELSE 0 END)"
    line = "chr(10) || {} || ':' || o.text"
    to = {}
    for letter, name, other in (("u", "user", "assistant"), ("a", "assistant", "user")):
        cost = f"CASE WHEN o.initial = '{letter}' THEN 0 ELSE 3 END + {more}"
        edit = f"CASE WHEN o.initial = '{letter}' THEN 'K' ELSE 'R' END"
        role = f"CASE WHEN o.initial = '{letter}' THEN o.role ELSE '{name}' END"
        said = line.format(f"({role})")
        straight = (0, 1, 3) if letter == "u" else (2,)
        turned = (2,) if letter == "u" else (0, 1, 3)
        to[letter] = [_way(s, cost, edit, said) for s in straight] + [
            _way(s, f"3 + {cost}", f"'I' || {edit}", f"chr(10) || '{other}:' || {said}") for s in turned
        ]
    stay = "o.fault IN ('blank', 'duplicate')"
    system = _way(0, more, "'K'", line.format("o.role"))

    def arrived(state: int, ways: list[str]) -> str:
        kept = f"CASE WHEN {stay} THEN NULL ELSE {_least(*ways)} END" if ways else "NULL"
        if state == 1:
            kept = f"CASE WHEN {stay} OR o.initial <> 's' THEN NULL ELSE {system} END"
        return _least(gone[state], kept) + f" AS s{state}" if kept != "NULL" else f"{gone[state]} AS s{state}"

    kind = "STRUCT(c BIGINT, a VARCHAR, r VARCHAR)"
    return rf"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda x, i:
    CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, n)) turned),
given AS (
  SELECT conv_id, coalesce(CAST(conv_id AS VARCHAR), ' ') k, conv_id IS NULL lost, turn,
    coalesce(role, ' ') role, coalesce(text, ' ') text,
    xor(4294967295, list_reduce(
      list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''),
        lambda c: CAST(ascii(c) AS BIGINT)),
      lambda x, c: xor(x >> 8, turned[(xor(x, c) & 255) + 1]), CAST(4294967295 AS BIGINT))) % 20 fate
  FROM conversations, crc),
torn AS (
  SELECT k, lost, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END role,
    CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(generate_series(1, CASE WHEN fate = 3 THEN 2 ELSE 1 END)) copy
  FROM given WHERE fate <> 0),
placed AS (
  SELECT *, left(role, 1) initial, row_number() OVER (PARTITION BY k, lost ORDER BY turn NULLS FIRST, {_SAID}, copy) i
  FROM torn),
o AS (
  SELECT *, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) said,
    CASE WHEN rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) = '' THEN 'blank'
      WHEN row_number() OVER (PARTITION BY k, lost, role, text ORDER BY i) > 1 THEN 'duplicate'
      WHEN right(rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) NOT IN ('.', '!', '?') THEN 'truncated'
    END fault,
    lag(initial) OVER (PARTITION BY k, lost ORDER BY i) || initial pair
  FROM placed),
w(k, lost, i, s0, s1, s2, s3) AS (
  SELECT DISTINCT k, lost, CAST(0 AS BIGINT), CAST({{'c': 0, 'a': '', 'r': ''}} AS {kind}),
    CAST(NULL AS {kind}), CAST(NULL AS {kind}), CAST(NULL AS {kind}) FROM o
  UNION ALL
  SELECT w.k, w.lost, o.i, {arrived(0, [])}, {arrived(1, [system])}, {arrived(2, to["u"])}, {arrived(3, to["a"])}
  FROM w JOIN o ON o.k = w.k AND o.lost = w.lost AND o.i = w.i + 1),
ends AS (
  SELECT k, lost, {_least(
      _way(0, "0", "''", "''"), _way(3, "0", "''", "''"),
      _way(2, "3", "'I'", "chr(10) || 'assistant:'"),
      _way(1, "6", "'II'", "chr(10) || 'user:' || chr(10) || 'assistant:'"))} f
  FROM w WHERE i = (SELECT max(i) FROM o WHERE o.k = w.k AND o.lost = w.lost)),
counts AS (
  SELECT k, lost, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) gaps,
    count(*) FILTER (fault = 'blank') blank, count(*) FILTER (fault = 'duplicate') duplicate,
    count(*) FILTER (fault = 'truncated') truncated,
    count(*) FILTER (pair IS NOT NULL AND pair NOT IN {_LEGAL}) illegal
  FROM o GROUP BY k, lost)
SELECT g.conv_id, coalesce(gaps, 0) gaps, coalesce(blank, 0) blank, coalesce(duplicate, 0) duplicate,
  coalesce(truncated, 0) truncated, coalesce(illegal, 0) illegal, coalesce(f.c, 0) "cost",
  coalesce(f.a, '') audit, sha256(coalesce(substr(f.r, 2), '')) repaired_sha256
FROM (SELECT DISTINCT conv_id, k, lost FROM given) g
LEFT JOIN counts USING (k, lost) LEFT JOIN ends USING (k, lost)
"""
