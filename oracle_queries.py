"""The registered queries as DuckDB SQL over the provided parquet tables."""

from __future__ import annotations

# A reply and its counts from a message m; every seventh breaks off after three
# pieces, and so does its report of the counts.
_BROKEN = "m.id % 7 = 0 AND len(string_split(m.content, ' ')) > 3"
_REPLY = f"""
          CASE WHEN {_BROKEN}
            THEN CONCAT(array_to_string(string_split(m.content, ' ')[1:3], ' '), ' ')
            ELSE m.content END AS reply,
          CASE WHEN m.id % 3 = 0 OR m.prompt_tokens = 0 OR {_BROKEN} THEN 10
            ELSE m.prompt_tokens END AS prompt_tokens,
          CASE WHEN m.id % 3 = 0 OR m.completion_tokens = 0 OR {_BROKEN} THEN 10
            ELSE m.completion_tokens END AS completion_tokens"""

# Views over the provided tables, each may use the ones above it.
VIEWS = {
    "v_users": """
        SELECT c_custkey AS id, c_name AS username,
          CASE WHEN c_custkey % 50 = 0 THEN 'admin' WHEN c_custkey % 10 = 1 THEN 'teacher'
               ELSE 'student' END AS role,
          CAST((c_custkey % 7) * 40 AS INT) AS daily_token_quota,
          c_custkey % 11 = 5 AS is_deleted
        FROM customer""",
    "v_requests_raw": """
        SELECT event_id AS request_id, CASE WHEN event_id % 3 = 0 THEN 2 ELSE user_id END AS user_id,
          CASE WHEN event_id % 3 = 0 THEN event_id % 6 * 3 ELSE user_id + event_id % 2 END
            AS session_id, ts AS created_at,
          CAST(ts AS DATE) AS usage_date,
          CASE WHEN event_type = 'error' THEN 0
               ELSE CAST(json_extract_string(props, '$.k') AS INT) END AS raw_prompt,
          CASE WHEN event_type = 'error' THEN 0 ELSE CAST(FLOOR(value) AS INT) END AS raw_completion
        FROM events WHERE event_type IN ('click', 'view', 'error')""",
    "v_requests": """
        SELECT request_id, user_id, session_id, created_at, usage_date,
          COALESCE(NULLIF(raw_prompt, 0), 10) + COALESCE(NULLIF(raw_completion, 0), 10)
            AS total_tokens
        FROM v_requests_raw""",
    "v_usage": """
        SELECT user_id, usage_date AS date, CAST(SUM(total_tokens) AS BIGINT) AS tokens_used,
          CAST(COUNT(*) AS INT) AS request_count
        FROM v_requests GROUP BY user_id, usage_date""",
    "v_quota_history": """
        SELECT event_id AS change_id, CASE WHEN event_id % 60 = 0 THEN 2 ELSE user_id END AS user_id,
          ts AS changed_at, CAST(FLOOR(value) * 4 AS INT) AS daily_token_quota
        FROM events WHERE event_type = 'purchase'""",
    "v_in_force": """
        SELECT r.request_id, r.user_id, r.created_at, r.usage_date, r.total_tokens,
          CAST(coalesce(h.version, 0) AS INT) AS version,
          CASE WHEN h.version IS NULL THEN u.daily_token_quota ELSE h.daily_token_quota END AS quota
        FROM v_requests r
        LEFT JOIN v_users u ON u.id = r.user_id
        ASOF LEFT JOIN (
          SELECT user_id, changed_at, max(version) AS version, max_by(daily_token_quota, version) AS daily_token_quota
          FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY changed_at, change_id) AS version
                FROM v_quota_history) x GROUP BY user_id, changed_at) h
          ON h.user_id = r.user_id AND r.created_at >= h.changed_at""",
    "v_today": "SELECT * FROM v_usage WHERE date = DATE '2024-01-15'",
    "v_rules": """
        SELECT event_id AS id, CAST(FLOOR(user_id / 10) * 10 + 1 AS BIGINT) AS teacher_id,
          CASE WHEN CAST(json_extract_string(props, '$.k') AS INT) % 25 = 0 THEN NULL
               ELSE user_id END AS student_id,
          CASE WHEN event_id % 17 = 3 THEN 'plain words' ELSE props END AS rules_json,
          value > 20 AS is_active
        FROM events WHERE event_type = 'signup'""",
    "v_sessions": """
        SELECT conv_id AS id,
          CASE WHEN conv_id % 3 = 0 THEN 2 ELSE conv_id - conv_id % 2 END AS user_id, CAST(NULL AS BIGINT) AS applied_rule_id,
          CASE WHEN conv_id % 4 = 0 THEN NULL ELSE CONCAT('Chat ', CAST(conv_id AS VARCHAR)) END
            AS title,
          conv_id % 9 = 4 AS is_deleted, DATE '2024-01-01' + CAST(conv_id % 30 AS INT) AS created_at
        FROM (SELECT DISTINCT conv_id FROM conversations) x""",
    "v_messages": """
        SELECT *, ROW_NUMBER() OVER (PARTITION BY session_id
          ORDER BY created_date, turn, sender = 'llm', id) AS n
        FROM (SELECT conv_id * 1000 + turn AS id,
          CASE WHEN conv_id % 3 = 0 THEN 0 ELSE conv_id END AS session_id, turn,
          CASE WHEN role = 'user' THEN 'user' ELSE 'llm' END AS sender, text AS content,
          CASE WHEN role = 'user' THEN NULL ELSE CAST(FLOOR(LENGTH(text) / 4) AS INT) END
            AS prompt_tokens,
          CASE WHEN role = 'user' THEN NULL
               ELSE CAST(LENGTH(text) - FLOOR(LENGTH(text) / 4) AS INT) END AS completion_tokens,
          CASE WHEN role = 'user' THEN NULL ELSE CAST(LENGTH(text) AS INT) END AS total_tokens,
          DATE '2024-01-01' + CAST(conv_id % 30 AS INT) AS created_date
        FROM conversations WHERE role <> 'system') x""",
    "v_candidates": """
        SELECT c_custkey AS row_id, -c_custkey - 1 AS id,
          CASE WHEN c_custkey % 13 = 0 THEN ''
               ELSE CONCAT('Customer#', LPAD(CAST(c_custkey * 2 AS VARCHAR), 9, '0')) END
            AS username,
          CASE WHEN c_mktsegment = 'BUILDING' THEN 'guest' ELSE 'student' END AS role,
          CAST(FLOOR(c_acctbal) AS INT) AS daily_token_quota
        FROM customer""",
    "v_checked": """
        SELECT *, CASE WHEN role NOT IN ('student', 'teacher', 'admin') THEN 'role'
          WHEN LENGTH(username) NOT BETWEEN 1 AND 150 THEN 'username'
          WHEN daily_token_quota < 0 THEN 'daily_token_quota' END AS reason
        FROM v_candidates""",
    "v_quota_changes": """
        SELECT event_id AS change_id, user_id * 3 AS user_id,
          CAST(FLOOR(value) - 10 AS INT) AS daily_token_quota
        FROM events WHERE event_type = 'purchase'""",
    "v_deletions": """
        SELECT event_id AS change_id, user_id * 15 AS user_id
        FROM events WHERE event_type = 'error'""",
    "v_toggles": """
        SELECT event_id AS change_id, event_id % 50 * 20 AS rule_id
        FROM events WHERE event_type = 'click'""",
    "v_new_sessions": """
        SELECT event_id + 1000000000 AS id, user_id,
          CASE WHEN user_id % 5 = 0 THEN NULL
               ELSE REPEAT(props, CAST(user_id % 40 AS INT)) END AS title, ts AS created_at
        FROM events WHERE event_type = 'purchase'""",
    "v_replay": """
        SELECT r.request_id, r.user_id, r.session_id, r.usage_date, r.total_tokens,
          COALESCE(SUM(r.total_tokens) OVER (PARTITION BY r.user_id, r.usage_date
            ORDER BY r.created_at, r.request_id
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= u.daily_token_quota, FALSE)
            AS refused
        FROM v_requests r LEFT JOIN v_users u ON u.id = r.user_id""",
    "v_door": """
        SELECT r.*, u.daily_token_quota AS quota,
          CASE WHEN u.id IS NULL OR u.is_deleted THEN 401 WHEN z.id IS NULL THEN 404 END AS refusal
        FROM v_requests r LEFT JOIN v_users u ON u.id = r.user_id
          LEFT JOIN v_sessions z
            ON z.id = r.session_id AND z.user_id = r.user_id AND NOT z.is_deleted""",
    "v_in_order": """
        SELECT request_id, user_id, session_id, COALESCE(refusal,
          CASE WHEN SUM(CASE WHEN refusal IS NULL THEN total_tokens END)
            OVER (PARTITION BY user_id, usage_date ORDER BY created_at, request_id
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= quota THEN 429 END,
          200) AS status
        FROM v_door""",
    "v_decided": """
        SELECT d.request_id, d.user_id, d.session_id, d.created_at, d.usage_date,
          CASE WHEN d.refusal = 401 THEN 401 WHEN d.request_id % 23 = 0 THEN 422
            ELSE COALESCE(d.refusal, CASE WHEN t.tokens_used >= d.quota THEN 429 END, 200) END
            AS status
        FROM v_door d LEFT JOIN v_today t ON t.user_id = d.user_id""",
    "v_effective": """
        SELECT u.id AS user_id, COALESCE(t.rid, g.rid) AS rule_id
        FROM v_users u LEFT JOIN (SELECT student_id, MIN(id) AS rid FROM v_rules
            WHERE is_active AND student_id IS NOT NULL GROUP BY student_id) t
          ON t.student_id = u.id
          CROSS JOIN (SELECT MIN(id) AS rid FROM v_rules
            WHERE is_active AND student_id IS NULL) g""",
    "v_system": """
        SELECT e.user_id, e.rule_id, CONCAT('You are a helpful AI assistant.',
          CASE WHEN r.id IS NULL THEN '' ELSE CONCAT(CHR(10), CHR(10), 'Teacher Instructions:',
            CHR(10), CASE WHEN json_valid(r.rules_json) THEN CAST(json(r.rules_json) AS VARCHAR)
              ELSE CONCAT('"', r.rules_json, '"') END) END) AS system_prompt
        FROM v_effective e LEFT JOIN v_rules r ON r.id = e.rule_id""",
    "v_ranked": """
        SELECT *, ROW_NUMBER() OVER (PARTITION BY session_id ORDER BY n DESC) AS age,
          CASE WHEN sender = 'user' THEN 'user' ELSE 'assistant' END AS role
        FROM v_messages""",
    "v_pages": """
        SELECT session_id, page, string_agg(CONCAT_WS('|', CAST(id AS VARCHAR), sender, content,
            CAST(total_tokens AS VARCHAR)), '#' ORDER BY n) AS messages
        FROM (SELECT *, CAST(FLOOR((n - 1) / 1000) AS INT) AS page FROM v_messages) x
        GROUP BY session_id, page""",
    "v_nested": """
        SELECT z.*, COALESCE(p.page, 0) AS page, COALESCE(p.messages, '') AS messages
        FROM v_sessions z LEFT JOIN v_pages p ON p.session_id = z.id""",
    "v_first": """
        SELECT session_id, arg_min(content, id) AS content, arg_min(prompt_tokens, id) AS prompt_tokens,
          arg_min(completion_tokens, id) AS completion_tokens
        FROM v_messages WHERE sender = 'llm' GROUP BY session_id""",
    "v_replies": f"""
        SELECT id AS request_id, session_id, created_date + to_minutes(turn) AS started_at,
          {_REPLY}
        FROM v_messages m WHERE sender = 'llm'""",
    "v_answered": f"""
        SELECT id AS request_id, {_REPLY}
        FROM (SELECT r.request_id AS id, f.* FROM v_requests r JOIN v_first f
          ON f.session_id = r.session_id WHERE r.request_id % 11 <> 0) m""",
    "v_answers": """
        SELECT d.request_id, d.user_id, d.session_id, d.created_at, d.usage_date,
          COALESCE(p.reply, '') AS reply, COALESCE(p.prompt_tokens, 10) AS prompt_tokens,
          COALESCE(p.completion_tokens, 10) AS completion_tokens
        FROM v_decided d LEFT JOIN v_answered p ON p.request_id = d.request_id
        WHERE d.status = 200""",
    "v_bound": """
        SELECT z.id, z.user_id, e.rule_id AS applied_rule_id
        FROM v_sessions z LEFT JOIN v_effective e ON e.user_id = z.user_id""",
    "v_left_users": "SELECT id FROM v_users WHERE id % 13 <> 4",
    "v_gone": "SELECT id FROM v_users WHERE is_deleted",
    "v_kept_rules": """
        SELECT * FROM v_rules r WHERE NOT EXISTS (SELECT 1 FROM v_gone g
          WHERE g.id = r.teacher_id OR g.id = r.student_id)""",
}

_STAMP = "'%Y-%m-%d %H:%M:%S'"

_DUPLICATE_OR_TAKEN = """
    SELECT c.row_id, c.username, c.reason,
      CASE WHEN c.reason IS NOT NULL THEN 422
        WHEN e.username IS NOT NULL OR ROW_NUMBER() OVER (
          PARTITION BY c.username, c.reason IS NULL ORDER BY c.row_id) > 1 THEN 409
        ELSE 201 END AS status
    FROM v_checked c LEFT JOIN v_users e ON e.username = c.username"""

_REPLIES = f"""
    SELECT request_id, session_id, strftime(started_at, {_STAMP}) AS started_at, reply,
      prompt_tokens, completion_tokens, prompt_tokens + completion_tokens AS total_tokens
    FROM v_replies"""

_USAGE = """SELECT user_id, strftime(date, '%Y-%m-%d') AS date, tokens_used, request_count
            FROM v_usage"""

_OVERVIEW = """
    SELECT u.id, u.username, u.daily_token_quota,
      COALESCE(t.tokens_used, 0) AS tokens_used_today,
      COALESCE(t.request_count, 0) AS request_count_today
    FROM v_users u LEFT JOIN v_today t ON t.user_id = u.id
    WHERE u.role = 'student' AND NOT u.is_deleted"""


def _share(query: str, used: str, quota: str) -> str:
    return f"""
    SELECT *, CASE WHEN pct > 90 THEN 'danger' WHEN pct > 70 THEN 'warn' ELSE 'ok' END AS band,
      CONCAT(CAST(CAST(ROUND(pct) AS INT) AS VARCHAR), '%') AS pct_label
    FROM (SELECT *, CASE WHEN {quota} > 0
            THEN LEAST(CAST({used} AS DOUBLE) / CAST({quota} AS DOUBLE) * 100.0, 100.0)
            ELSE 0.0 END AS pct FROM ({query}) a) b"""


def _sessions(where: str) -> str:
    return f"""
    SELECT id, user_id, applied_rule_id, title, is_deleted,
      strftime(created_at, {_STAMP}) AS created_at
    FROM v_sessions z WHERE {where}"""


_LIVE_STUDENT = """EXISTS (SELECT 1 FROM v_users u
      WHERE u.id = z.user_id AND u.role = 'student' AND NOT u.is_deleted)"""

SQL = {
    "active_users": "SELECT * FROM v_users WHERE NOT is_deleted",
    "active_user_count": "SELECT COUNT(*) AS active_users FROM v_users WHERE NOT is_deleted",
    "resolve_names": """
        SELECT n.username, u.id AS user_id, u.role FROM v_users n
        LEFT JOIN (SELECT * FROM v_users WHERE NOT is_deleted) u ON u.username = n.username""",
    "student_overview": _OVERVIEW,
    "student_quota_share": _share(_OVERVIEW, "tokens_used_today", "daily_token_quota"),
    "quota_pct_band": _share(
        """SELECT u.id, COALESCE(t.tokens_used, 0) AS used, u.daily_token_quota AS "limit"
           FROM v_users u LEFT JOIN v_today t ON t.user_id = u.id WHERE NOT u.is_deleted""",
        "used",
        '"limit"',
    ),
    "quota_use": """
        SELECT u.id, COALESCE(t.tokens_used, 0) AS used, u.daily_token_quota AS "limit"
        FROM v_users u LEFT JOIN v_today t ON t.user_id = u.id WHERE NOT u.is_deleted""",
    "usage_rollup": _USAGE,
    "usage_from_messages": """
        SELECT z.user_id, strftime(m.created_date, '%Y-%m-%d') AS date,
          CAST(SUM(m.total_tokens) AS BIGINT) AS tokens_used,
          CAST(COUNT(*) AS INT) AS request_count
        FROM v_messages m JOIN v_sessions z ON z.id = m.session_id WHERE m.sender = 'llm'
        GROUP BY z.user_id, m.created_date""",
    "usage_merge": _USAGE,
    "usage_drift": """
        SELECT s.user_id, strftime(s.date, '%Y-%m-%d') AS date, s.tokens_used AS stored_tokens,
          s.request_count AS stored_requests, e.tokens AS expected_tokens,
          e.requests AS expected_requests
        FROM v_usage s LEFT JOIN (SELECT user_id, usage_date,
            CAST(SUM(total_tokens) AS BIGINT) AS tokens, CAST(COUNT(*) AS INT) AS requests
            FROM v_replay WHERE NOT refused GROUP BY user_id, usage_date) e
          ON e.user_id = s.user_id AND e.usage_date = s.date
        WHERE s.tokens_used IS DISTINCT FROM e.tokens
          OR s.request_count IS DISTINCT FROM e.requests""",
    "quota_replay": "SELECT request_id, user_id, refused FROM v_replay",
    "replay_decisions": "SELECT * FROM v_in_order",
    "landing_replay": """
        WITH RECURSIVE timed AS (
          SELECT request_id, user_id, created_at AS started_at, total_tokens,
            created_at + to_minutes(request_id % 97 * 3
              + CASE WHEN request_id % 41 = 0 THEN 1800 ELSE 0 END) AS ended_at
          FROM v_requests),
        moves AS (
          SELECT request_id, user_id, started_at AS moment, 1 AS kind, 0 AS tokens FROM timed
          UNION ALL SELECT request_id, user_id, ended_at, 0, total_tokens FROM timed),
        e AS (
          SELECT m.*, CAST(moment AS DATE) AS day, u.daily_token_quota AS quota,
            row_number() OVER (PARTITION BY user_id ORDER BY moment, kind, request_id) AS n
          FROM moves m LEFT JOIN v_users u ON u.id = m.user_id),
        w AS (
          SELECT user_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS DATE) AS day, CAST(NULL AS BIGINT) AS used,
            CAST([] AS BIGINT[]) AS lost, CAST(NULL AS BIGINT) AS request_id, CAST(NULL AS BOOLEAN) AS refused
          FROM (SELECT DISTINCT user_id FROM e) x
          UNION ALL
          SELECT user_id, n, day,
            CASE WHEN kind = 0 AND NOT list_contains(lost, request_id)
              THEN coalesce(was, 0) + tokens ELSE was END,
            CASE WHEN kind = 1 AND coalesce(was >= quota, false) THEN list_append(lost, request_id)
              ELSE lost END,
            CASE WHEN kind = 1 THEN request_id END, coalesce(was >= quota, false)
          FROM (SELECT e.*, w.lost, CASE WHEN w.day = e.day THEN w.used END AS was
                FROM w JOIN e ON e.user_id = w.user_id AND e.n = w.n + 1) s)
        SELECT request_id, user_id, refused FROM w WHERE request_id IS NOT NULL""",
    "quota_in_force": "SELECT request_id, user_id, version, quota FROM v_in_force",
    "history_replay": """
        WITH RECURSIVE e AS (
          SELECT *, row_number() OVER (PARTITION BY user_id, usage_date ORDER BY created_at, request_id) AS n
          FROM v_in_force),
        w AS (
          SELECT user_id, usage_date, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS used,
            CAST(NULL AS BIGINT) AS request_id, CAST(NULL AS BOOLEAN) AS refused
          FROM (SELECT DISTINCT user_id, usage_date FROM e) x
          UNION ALL
          SELECT e.user_id, e.usage_date, e.n,
            CASE WHEN coalesce(w.used >= e.quota, false) THEN w.used
              ELSE coalesce(w.used, 0) + e.total_tokens END,
            e.request_id, coalesce(w.used >= e.quota, false)
          FROM w JOIN e ON e.user_id = w.user_id AND e.usage_date = w.usage_date AND e.n = w.n + 1)
        SELECT request_id, user_id, refused FROM w WHERE request_id IS NOT NULL""",
    "stream_gate": "SELECT * FROM v_in_order",
    "gate_batches": "SELECT * FROM v_in_order",
    "chat_decisions": "SELECT request_id, user_id, session_id, status FROM v_decided",
    "session_read_decisions": """
        SELECT r.request_id, r.user_id, r.session_id,
          CASE WHEN u.id IS NULL OR u.is_deleted THEN 401 WHEN z.id IS NULL THEN 404
               WHEN z.user_id <> r.user_id THEN 403 ELSE 200 END AS status
        FROM v_requests r LEFT JOIN v_users u ON u.id = r.user_id
          LEFT JOIN v_sessions z ON z.id = r.session_id""",
    "role_decisions": """
        SELECT request_id, user_id, gate,
          CASE WHEN role IS NULL OR is_deleted THEN 401
            WHEN gate = 'user' OR role = 'admin' OR (gate = 'teacher' AND role = 'teacher')
            THEN 200 ELSE 403 END AS status
        FROM (SELECT r.request_id, r.user_id, CASE r.request_id % 3 WHEN 0 THEN 'user'
                WHEN 1 THEN 'teacher' ELSE 'admin' END AS gate, u.role, u.is_deleted
              FROM v_requests r LEFT JOIN v_users u ON u.id = r.user_id) q""",
    "audit_decisions": """
        SELECT r.request_id, r.user_id AS student_id,
          CASE WHEN u.role = 'student' AND NOT u.is_deleted THEN 200 ELSE 404 END AS status
        FROM v_requests r LEFT JOIN v_users u ON u.id = r.user_id""",
    "own_accounts": """
        SELECT r.request_id, r.user_id, u.username, u.role, u.daily_token_quota, u.is_deleted,
          CASE WHEN u.id IS NULL THEN 401 ELSE 200 END AS status
        FROM v_requests r LEFT JOIN (SELECT * FROM v_users WHERE NOT is_deleted) u
          ON u.id = r.user_id""",
    "areas": """
        SELECT u.id, u.role, a.area FROM v_users u
        JOIN (VALUES ('admin', 'Admin Panel'), ('admin', 'Teacher Console'), ('admin', 'AI Chat'),
          ('teacher', 'Teacher Console'), ('teacher', 'AI Chat'), ('student', 'AI Chat'))
          a(role, area) ON a.role = u.role WHERE NOT u.is_deleted""",
    "rules_matching": """
        SELECT r.student_id AS user_id, r.id AS rule_id FROM v_rules r
        WHERE r.is_active AND (r.student_id IS NULL
          OR EXISTS (SELECT 1 FROM v_users u WHERE u.id = r.student_id))""",
    "rules_match_counts": """
        SELECT u.id AS user_id, COUNT(r.student_id) AS targeted,
          COUNT(r.id) - COUNT(r.student_id) AS everyone, COUNT(r.id) AS matching
        FROM v_users u LEFT JOIN v_rules r
          ON r.is_active AND (r.student_id = u.id OR r.student_id IS NULL)
        GROUP BY u.id""",
    "effective_rule": "SELECT * FROM v_effective",
    "rules_by_teacher": """
        SELECT teacher_id, id, student_id, rules_json, is_active,
          CASE WHEN student_id IS NULL THEN 'All Students' ELSE 'Targeted' END AS scope,
          CASE WHEN is_active THEN 'Active' ELSE 'Inactive' END AS state
        FROM v_rules""",
    "history_last_k": """
        SELECT session_id, CAST(ROW_NUMBER() OVER (PARTITION BY session_id ORDER BY age DESC) AS INT)
          AS position, id, role, content FROM v_ranked WHERE age <= 4""",
    "history_last_20": """
        SELECT session_id, CAST(ROW_NUMBER() OVER (PARTITION BY session_id ORDER BY age DESC) AS INT)
          AS position, id, role FROM v_ranked WHERE age <= 20""",
    "prompt_text": """
        SELECT session_id, string_agg(CONCAT(role, '|', content), '#' ORDER BY n) AS history
        FROM v_ranked WHERE age <= 4 GROUP BY session_id""",
    "system_text": "SELECT * FROM v_system",
    "prompt_payload": """
        SELECT d.request_id, CONCAT('system|', s.system_prompt,
          CASE WHEN h.history IS NULL THEN '' ELSE CONCAT('#', h.history) END,
          '#user|Question ', CAST(d.request_id AS VARCHAR)) AS payload
        FROM v_decided d JOIN v_system s ON s.user_id = d.user_id
          LEFT JOIN (SELECT session_id, string_agg(CONCAT(role, '|', content), '#' ORDER BY n)
              AS history FROM v_ranked WHERE age <= 20 GROUP BY session_id) h
            ON h.session_id = d.session_id
        WHERE d.status = 200""",
    "session_listing": _sessions("NOT is_deleted"),
    "session_audit": _sessions(f"NOT is_deleted AND {_LIVE_STUDENT}"),
    "session_summary": """
        SELECT z.id, z.user_id, COALESCE(NULLIF(z.title, ''), 'Untitled Session') AS title,
          COUNT(m.id) AS message_count
        FROM v_sessions z LEFT JOIN v_messages m ON m.session_id = z.id
        WHERE NOT z.is_deleted GROUP BY z.id, z.user_id, z.title""",
    "newest_session": f"""
        SELECT user_id, id, title, applied_rule_id, strftime(created_at, {_STAMP}) AS created_at
        FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id
                ORDER BY created_at DESC, id DESC) AS n FROM v_sessions WHERE NOT is_deleted) x
        WHERE n = 1""",
    "sessions_with_messages": f"""
        SELECT id, user_id, applied_rule_id, title, is_deleted,
          strftime(created_at, {_STAMP}) AS created_at, page, messages FROM v_nested""",
    "sessions_in_pages": f"""
        SELECT z.id, z.user_id, z.applied_rule_id, z.title, z.is_deleted,
          strftime(z.created_at, {_STAMP}) AS created_at, COALESCE(p.page, 0) AS page,
          COALESCE(p.messages, '') AS messages
        FROM v_sessions z LEFT JOIN (
          SELECT session_id, page, string_agg(CONCAT_WS('|', CAST(id AS VARCHAR), sender, content,
            CAST(total_tokens AS VARCHAR)), '#' ORDER BY n) AS messages
          FROM (SELECT *, CAST(FLOOR((n - 1) / 3) AS INT) AS page FROM v_messages) x
          GROUP BY session_id, page) p ON p.session_id = z.id""",
    "student_history": f"""
        SELECT z.id, z.user_id, COALESCE(NULLIF(z.title, ''), 'Untitled Session') AS label,
          z.page, z.messages
        FROM v_nested z WHERE NOT z.is_deleted AND {_LIVE_STUDENT}""",
    "read_sessions": """
        SELECT z.id, z.user_id, z.page, z.messages FROM v_nested z
        WHERE EXISTS (SELECT 1 FROM v_requests r JOIN v_users u ON u.id = r.user_id
          WHERE r.session_id = z.id AND r.user_id = z.user_id AND NOT u.is_deleted)""",
    "create_users": _DUPLICATE_OR_TAKEN,
    "create_users_snapshot": f"""
        SELECT id, username, role, daily_token_quota, is_deleted FROM v_users
        UNION ALL SELECT c.id, c.username, c.role, c.daily_token_quota, FALSE
        FROM v_candidates c JOIN ({_DUPLICATE_OR_TAKEN}) s ON s.row_id = c.row_id
        WHERE s.status = 201""",
    "set_quota": """
        SELECT u.id, u.username, u.role, CASE WHEN u.is_deleted THEN u.daily_token_quota
            ELSE COALESCE(c.q, u.daily_token_quota) END AS daily_token_quota, u.is_deleted
        FROM v_users u LEFT JOIN (SELECT user_id, arg_max(daily_token_quota, change_id) AS q
            FROM v_quota_changes WHERE daily_token_quota >= 0 GROUP BY user_id) c
          ON c.user_id = u.id""",
    "set_quota_status": """
        SELECT c.change_id, c.user_id, CASE WHEN c.daily_token_quota < 0 THEN 422
          WHEN u.id IS NULL OR u.is_deleted THEN 404 ELSE 200 END AS status
        FROM v_quota_changes c LEFT JOIN v_users u ON u.id = c.user_id""",
    "soft_delete": """
        SELECT c.change_id, c.user_id, CASE WHEN u.id IS NULL OR u.is_deleted OR ROW_NUMBER()
            OVER (PARTITION BY c.user_id ORDER BY c.change_id) > 1 THEN 404 ELSE 204 END AS status
        FROM v_deletions c LEFT JOIN v_users u ON u.id = c.user_id""",
    "soft_delete_snapshot": """
        SELECT id, username, role, daily_token_quota, is_deleted
          OR EXISTS (SELECT 1 FROM v_deletions c WHERE c.user_id = u.id) AS is_deleted
        FROM v_users u""",
    "toggle_rules": """
        SELECT r.id, r.teacher_id, r.student_id, r.rules_json,
          r.is_active <> (COALESCE(c.n, 0) % 2 = 1) AS is_active
        FROM v_rules r LEFT JOIN (SELECT rule_id, COUNT(*) AS n FROM v_toggles GROUP BY rule_id) c
          ON c.rule_id = r.id""",
    "toggle_rules_status": """
        SELECT c.change_id, c.rule_id, CASE WHEN r.id IS NULL THEN 404 ELSE 200 END AS status,
          r.is_active <> (ROW_NUMBER() OVER (PARTITION BY c.rule_id ORDER BY c.change_id) % 2 = 1)
            AS is_active
        FROM v_toggles c LEFT JOIN v_rules r ON r.id = c.rule_id""",
    "create_sessions": f"""
        SELECT id, user_id, applied_rule_id, title, is_deleted,
          strftime(created_at, {_STAMP}) AS created_at FROM v_sessions
        UNION ALL SELECT id, user_id, NULL, title, FALSE, strftime(created_at, {_STAMP})
        FROM v_new_sessions WHERE title IS NULL OR LENGTH(title) <= 255""",
    "create_sessions_status": """
        SELECT id, CASE WHEN LENGTH(title) > 255 THEN 'title' END AS reason,
          CASE WHEN LENGTH(title) > 255 THEN 422 ELSE 201 END AS status
        FROM v_new_sessions""",
    "create_rules": """
        SELECT id, teacher_id, student_id, rules_json, is_active FROM v_rules
        UNION ALL SELECT event_id + 1000000000, CAST(FLOOR(user_id / 10) * 10 + 1 AS BIGINT),
          CASE WHEN user_id % 7 <> 0 THEN user_id END,
          CONCAT('{"level":', json_extract_string(props, '$.k'), '}'),
          CASE WHEN event_id % 3 = 0 THEN TRUE ELSE value > 50 END
        FROM events WHERE event_type = 'purchase' AND event_id % 19 <> 0""",
    "create_rules_status": """
        SELECT event_id + 1000000000 AS id,
          CASE WHEN event_id % 19 = 0 THEN 'teacher_id missing' END AS reason,
          CASE WHEN event_id % 19 = 0 THEN 422 ELSE 201 END AS status
        FROM events WHERE event_type = 'purchase'""",
    "bind_rules": """
        SELECT b.id, b.user_id, CASE WHEN EXISTS (SELECT 1 FROM v_decided d
            WHERE d.session_id = b.id AND d.status = 200) THEN b.applied_rule_id END
          AS applied_rule_id
        FROM v_bound b""",
    "purge_accounts": """
        SELECT id, username, role, daily_token_quota, is_deleted FROM v_users
        WHERE NOT is_deleted""",
    "purge_usage": f"""
        SELECT * FROM ({_USAGE}) x WHERE user_id NOT IN (SELECT id FROM v_gone)""",
    "purge_rules": "SELECT id, teacher_id, student_id, rules_json, is_active FROM v_kept_rules",
    "purge_sessions": """
        SELECT id, user_id, CASE WHEN applied_rule_id IN (SELECT id FROM v_kept_rules)
          THEN applied_rule_id END AS applied_rule_id
        FROM v_bound WHERE user_id NOT IN (SELECT id FROM v_gone)""",
    "purge_messages": """
        SELECT m.id, m.session_id FROM v_messages m WHERE m.session_id NOT IN (
          SELECT id FROM v_sessions WHERE user_id IN (SELECT id FROM v_gone))""",
    "validate_users": "SELECT row_id, username, reason FROM v_checked",
    "validate_messages": """
        SELECT id, CASE WHEN id % 13 = 0 THEN 'content missing'
          WHEN id % 11 = 0 THEN 'sender' END AS reason
        FROM v_messages""",
    "duplicates": """
        SELECT username, COUNT(*) AS n FROM v_candidates GROUP BY username HAVING COUNT(*) > 1""",
    "orphan_requests": """
        SELECT request_id, user_id, session_id FROM v_requests
        WHERE session_id NOT IN (SELECT id FROM v_sessions)""",
    "orphan_counts": """
        SELECT 'teacher_rules.teacher_id' AS reference, COUNT(*) AS orphans FROM v_rules
          WHERE teacher_id NOT IN (SELECT id FROM v_left_users)
        UNION ALL SELECT 'teacher_rules.student_id', COUNT(*) FROM v_rules
          WHERE student_id NOT IN (SELECT id FROM v_left_users)
        UNION ALL SELECT 'usage_stats.user_id', COUNT(*) FROM v_usage
          WHERE user_id NOT IN (SELECT id FROM v_left_users)
        UNION ALL SELECT 'sessions.user_id', COUNT(*) FROM v_sessions
          WHERE id % 7 <> 3 AND user_id NOT IN (SELECT id FROM v_left_users)
        UNION ALL SELECT 'sessions.applied_rule_id', COUNT(*) FROM v_sessions
          WHERE applied_rule_id NOT IN (SELECT id FROM v_rules)
        UNION ALL SELECT 'messages.session_id', COUNT(*) FROM v_messages
          WHERE session_id NOT IN (SELECT id FROM v_sessions WHERE id % 7 <> 3)""",
    "stored_usage_drift": """
        SELECT COALESCE(s.user_id, e.user_id) AS user_id,
          strftime(COALESCE(s.date, e.date), '%Y-%m-%d') AS date,
          s.tokens_used AS stored_tokens, s.request_count AS stored_requests,
          e.tokens AS expected_tokens, e.requests AS expected_requests
        FROM v_usage s FULL JOIN (SELECT z.user_id, m.created_date AS date,
            CAST(SUM(m.total_tokens) AS BIGINT) AS tokens, CAST(COUNT(*) AS INT) AS requests
            FROM v_messages m JOIN v_sessions z ON z.id = m.session_id WHERE m.sender = 'llm'
            GROUP BY z.user_id, m.created_date) e
          ON e.user_id = s.user_id AND e.date = s.date
        WHERE s.tokens_used IS DISTINCT FROM e.tokens
          OR s.request_count IS DISTINCT FROM e.requests""",
    "reply_assembly": _REPLIES,
    "stream_reply_assembly": _REPLIES,
    "settle_messages": f"""
        SELECT CONCAT(CAST(d.request_id AS VARCHAR), ':user') AS id, d.session_id,
          'user' AS sender, CONCAT('Question ', CAST(d.request_id AS VARCHAR)) AS content,
          CAST(NULL AS INT) AS prompt_tokens, CAST(NULL AS INT) AS completion_tokens,
          CAST(NULL AS INT) AS total_tokens, strftime(d.created_at, {_STAMP}) AS created_at
        FROM v_answers d
        UNION ALL SELECT CONCAT(CAST(d.request_id AS VARCHAR), ':llm'), d.session_id, 'llm',
          d.reply, d.prompt_tokens, d.completion_tokens,
          d.prompt_tokens + d.completion_tokens, strftime(d.created_at, {_STAMP})
        FROM v_answers d""",
    "stream_settle_messages": f"""
        SELECT CONCAT(CAST(d.request_id AS VARCHAR), ':user') AS id, d.session_id,
          'user' AS sender, CONCAT('Question ', CAST(d.request_id AS VARCHAR)) AS content,
          CAST(NULL AS INT) AS prompt_tokens, CAST(NULL AS INT) AS completion_tokens,
          CAST(NULL AS INT) AS total_tokens, strftime(d.created_at, {_STAMP}) AS created_at
        FROM v_answers d
        UNION ALL SELECT CONCAT(CAST(d.request_id AS VARCHAR), ':llm'), d.session_id, 'llm',
          d.reply, d.prompt_tokens, d.completion_tokens,
          d.prompt_tokens + d.completion_tokens, strftime(d.created_at, {_STAMP})
        FROM v_answers d""",
    "stream_replies_by_silence": f"""
        SELECT request_id, session_id, strftime(min(arrived_at), {_STAMP}) AS begun,
          string_agg(delta, '' ORDER BY seq) AS reply,
          CASE WHEN max(p) IS NULL OR max(p) = 0 THEN 10 ELSE max(p) END AS prompt_tokens,
          CASE WHEN max(c) IS NULL OR max(c) = 0 THEN 10 ELSE max(c) END AS completion_tokens,
          CASE WHEN max(p) IS NULL OR max(p) = 0 THEN 10 ELSE max(p) END
            + CASE WHEN max(c) IS NULL OR max(c) = 0 THEN 10 ELSE max(c) END AS total_tokens
        FROM (
          SELECT id AS request_id, session_id, seq,
            words[seq + 1] || CASE WHEN seq < pieces - 1 THEN ' ' ELSE '' END AS delta,
            CASE WHEN seq = pieces - 1 AND id % 3 <> 0 THEN prompt_tokens END AS p,
            CASE WHEN seq = pieces - 1 AND id % 3 <> 0 THEN completion_tokens END AS c,
            CAST(created_date AS TIMESTAMP) + to_minutes(turn) + to_seconds(seq * 40 + CASE WHEN id % 5 = 0 AND seq >= 5 THEN 600 ELSE 0 END) AS arrived_at
          FROM (SELECT *, len(words) AS pieces, unnest(generate_series(0, len(words) - 1)) AS seq
                FROM (SELECT *, string_split(content, ' ') AS words FROM v_messages WHERE sender = 'llm') a) b
          WHERE id % 7 <> 0 OR seq < 3) x
        GROUP BY request_id, session_id, CASE WHEN request_id % 5 = 0 AND seq >= 5 THEN 1 ELSE 0 END""",
    "settle_usage": """
        SELECT user_id, strftime(date, '%Y-%m-%d') AS date,
          CAST(SUM(tokens) AS BIGINT) AS tokens_used, CAST(SUM(n) AS INT) AS request_count
        FROM (SELECT user_id, date, tokens_used AS tokens, request_count AS n FROM v_usage
              UNION ALL SELECT user_id, usage_date, prompt_tokens + completion_tokens, 1
              FROM v_answers) x
        GROUP BY user_id, date""",
    "stored_tables": """
        SELECT CAST(user_id AS VARCHAR) AS user_id, strftime(date, '%Y-%m-%d') AS date,
          CAST(SUM(tokens) AS BIGINT) AS tokens_used, CAST(COUNT(*) AS INT) AS request_count
        FROM (SELECT z.user_id, m.created_date AS date, m.total_tokens AS tokens
              FROM v_messages m JOIN v_sessions z ON z.id = m.session_id WHERE m.sender = 'llm'
              UNION ALL SELECT z.user_id, a.usage_date, a.prompt_tokens + a.completion_tokens
              FROM v_answers a JOIN v_sessions z ON z.id = a.session_id) x
        GROUP BY user_id, date""",
    "validate_requests": """
        SELECT request_id, CASE WHEN request_id % 23 = 0 THEN 'message' END AS reason
        FROM v_requests""",
    "stream_daily_usage": _USAGE,
    "stream_folded_usage": _USAGE,
    "stream_closed_days": f"""
        SELECT * FROM ({_USAGE}) x
        WHERE CAST(date AS DATE) <= (SELECT MAX(usage_date) - 8 FROM v_requests)""",
}


def _used(sql: str) -> list[str]:
    """The views a statement needs, also through other views, in view order."""
    found = {name for name in VIEWS if _mentions(sql, name)}
    for name in reversed(VIEWS):
        if name in found:
            found |= {other for other in VIEWS if _mentions(VIEWS[name], other)}
    return [name for name in VIEWS if name in found]


def _mentions(sql: str, name: str) -> bool:
    words = sql.replace("(", " ").replace(")", " ").replace(",", " ").split()
    return name in words


SQL["usage_drift_by_digests"] = SQL["usage_drift"]
for _name in ("session_summary", "sessions_with_messages", "sessions_in_pages", "history_last_20"):
    SQL[f"stored_{_name}"] = SQL[_name]


def all_sql() -> dict[str, str]:
    out = {}
    for name, sql in SQL.items():
        views = ", ".join(f"{view} AS ({VIEWS[view]})" for view in _used(sql))
        sql, recursive = sql.strip(), "WITH RECURSIVE "
        if views and sql.startswith(recursive):
            out[name] = f"{recursive}{views}, {sql.removeprefix(recursive)}"
        else:
            out[name] = f"WITH {views} {sql}" if views else sql
    return out
