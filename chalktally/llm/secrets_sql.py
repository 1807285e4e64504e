"""DuckDB SQL for the secrets query: every window counted anew."""

from __future__ import annotations

from chalktally.llm import secrets

_BASE = {"assign": secrets.ASSIGN, "access": "AKIA[A-Z0-9]+", "hex": "[0-9a-f]+"}


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _located(name: str, source: str, pattern: str) -> str:
    """(rid, i, x, y, st): matches x, what stands before them, and where they start."""
    p = _quoted(pattern)
    return f"""
{name}_m AS (SELECT rid, regexp_extract_all(t, {p}) f, string_split_regex(t, {p}) b FROM {source}),
{name}_u AS (SELECT rid, f[i] x, b[i] y, i FROM (
  SELECT rid, f, b, unnest(generate_series(1, len(f))) i FROM {name}_m)),
{name} AS (SELECT rid, i, x, y,
  sum(length(x) + length(y)) OVER (PARTITION BY rid ORDER BY i) - length(x) st FROM {name}_u)"""


def _long_enough(kind: str) -> str:
    part = f"regexp_extract(x, {_quoted(secrets.ASSIGN)}, 2)" if kind == "assign" else "x"
    return f"length({part}) >= {secrets.FEWEST[kind]}"


def _masked(name: str, found: str, source: str, kind: str) -> str:
    return f"""
{name} AS (SELECT rid, coalesce(s, '') || b[len(f) + 1] t FROM {found}_m LEFT JOIN (
  SELECT rid, string_agg(y || CASE WHEN {_long_enough(kind)} THEN repeat(' ', length(x)) ELSE x END, '' ORDER BY i) s
  FROM {found} GROUP BY rid) USING (rid))"""


def _entropy(rank: int, chars: secrets.CharClass, source: str) -> str:
    name, w = chars.name, chars.window
    known = [f"regexp_matches(x, {_quoted(p.replace('*+', '*'))})" for p in secrets.ALLOW]
    known += [f"regexp_matches(right(y, 240), {_quoted(p)})" for p in secrets.ALLOW_BEFORE]
    sums = ", ".join(str(secrets.scaled(c)) for c in range(1, w + 1))
    letter = f"[{chars.pattern}]"
    return f"""{_located(name, source, f"{letter}{{{w},}}")},
{name}_w AS (SELECT rid, i, st, j, substr(x, j, {w}) w FROM (
  SELECT rid, i, st, x, unnest(generate_series(1, length(x) - {w - 1})) j
  FROM {name} WHERE NOT ({" OR ".join(known)}))),
{name}_h AS (SELECT rid, i, st, j FROM {name}_w WHERE list_sum(list_transform(
  list_distinct(string_split(w, '')),
  lambda c: list_extract([{sums}], {w} - length(replace(w, c, ''))))) <= {chars.most}),
{name}_n AS (SELECT *, CASE WHEN j - lag(j) OVER (PARTITION BY rid, i ORDER BY j) <= {w} THEN 0 ELSE 1 END n FROM {name}_h),
{name}_g AS (SELECT *, sum(n) OVER (PARTITION BY rid, i ORDER BY j) g FROM {name}_n),
{name}_s AS (SELECT rid, st + min(j) - 1 st, {rank} k, st + max(j) + {w - 1} en, '{name}' kind
  FROM {name}_g GROUP BY rid, i, st, g)"""


def sql() -> str:
    parts = ["d AS (SELECT row_number() OVER () rid, doc_id, coalesce(text, '') t FROM documents)"]
    base, source = [], "d"
    for rank, (kind, pattern) in enumerate(_BASE.items()):
        parts.append(_located(kind, "d", pattern))
        parts.append(_located(f"{kind}_left", source, pattern))
        parts.append(_masked(f"left_{kind}", f"{kind}_left", source, kind))
        source = f"left_{kind}"
        base.append(
            f"SELECT rid, st, {rank} k, st + length(x) en, '{kind}' kind FROM {kind} WHERE {_long_enough(kind)}"
        )
    parts.append("base AS (" + " UNION ALL ".join(base) + ")")
    added = ["SELECT * FROM base"]
    for rank, chars in enumerate(secrets.CLASSES, len(_BASE)):
        parts.append(_entropy(rank, chars, source))
        added.append(f"SELECT * FROM {chars.name}_s")
    parts.append("every AS (" + " UNION ALL ".join(added) + ")")
    text = "string_agg(kind || ':' || CAST(st AS BIGINT) || ':' || CAST(en AS BIGINT), ',' ORDER BY st, k, en)"
    parts.append(
        "b AS (SELECT rid, "
        + ", ".join(f"count(*) FILTER (kind = '{k}') n_{k}" for k in _BASE)
        + f", {text} s FROM base GROUP BY rid)"
    )
    parts.append(f"e AS (SELECT rid, {text} s FROM every GROUP BY rid)")
    counts = ", ".join(f"coalesce(n_{k}, 0) n_{k}" for k in _BASE)
    return (
        "WITH "
        + ",\n".join(parts)
        + f"\nSELECT doc_id, {counts}, sha256(coalesce(b.s, '')) base_sha256, coalesce(e.s, '') spans"
        + " FROM d LEFT JOIN b USING (rid) LEFT JOIN e USING (rid)"
    )
