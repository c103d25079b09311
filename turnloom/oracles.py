"""SQL that gives the expected result of each registered query straight from the tables."""

from __future__ import annotations

from turnloom.queries import SECRETS

TS = "strftime(make_timestamp((1767225600 + conv_id * 86400 + turn) * 1000000), '%Y-%m-%dT%H:%M:%S')"

BLOCK = f"""
WITH u AS (
  SELECT *, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS next_user
  FROM conversations WHERE role = 'user'
), a AS (
  SELECT conv_id, turn, text, CASE (conv_id + turn) % 3 WHEN 0 THEN 'model-a' WHEN 1 THEN 'model-b' END AS model
  FROM conversations WHERE role = 'assistant'
), j AS (
  SELECT u.conv_id, u.turn, any_value(u.text) AS prompt_text, any_value(u.next_user) AS next_user,
         count(a.turn) AS n, string_agg(a.text, '' ORDER BY a.turn) AS response_text,
         sum(length(a.text))::BIGINT AS token_count, arg_min(a.model, a.turn) AS model
  FROM u LEFT JOIN a ON a.conv_id = u.conv_id AND a.turn > u.turn AND (u.next_user IS NULL OR a.turn < u.next_user)
  GROUP BY ALL
), t AS (
  SELECT *, '/logs/.claude/projects/p' || (conv_id % 7) || '/s' || conv_id || '.jsonl' AS path,
         's' || conv_id AS session_id, {TS} AS prompt_ts,
         CASE conv_id % 4 WHEN 0 THEN 'cli' WHEN 1 THEN 'sdk-cli' ELSE 'unknown' END AS surface,
         '/work/p' || (conv_id % 7) || CASE WHEN conv_id % 3 = 0 THEN ' @main' ELSE '' END AS project_context
  FROM j WHERE next_user IS NOT NULL OR (n > 0 AND conv_id % 2 = 0 AND conv_id % 10 <> 4)
)
"""

STORE = f"""
WITH u AS (
  SELECT *, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS next_user
  FROM conversations WHERE role = 'user' AND trim(text) <> '' AND text[1] <> '/'
), j AS (
  SELECT u.conv_id, u.turn, any_value(u.text) AS prompt_text, any_value(u.next_user) AS next_user, count(a.turn) AS n,
         nullif(string_agg(a.text, '' ORDER BY a.turn), '') AS response_text,
         arg_min(CASE (a.conv_id + a.turn) % 3 WHEN 0 THEN 'model-a' WHEN 1 THEN 'model-b' ELSE '<synthetic>' END, a.turn) FILTER (a.turn IS NOT NULL) AS model
  FROM u LEFT JOIN conversations a ON a.conv_id = u.conv_id AND a.role = 'assistant' AND a.turn > u.turn AND (u.next_user IS NULL OR a.turn < u.next_user)
  GROUP BY ALL
), t AS (SELECT *, 'g' || conv_id AS session_id, {TS} AS prompt_ts FROM j WHERE next_user IS NOT NULL OR n > 0)
"""

ROLLOUT_ALL = f"""
WITH k AS (
  SELECT * FROM conversations
  WHERE role <> 'system' AND NOT (role = 'assistant' AND conv_id % 5 = 0 AND turn % 4 = 1)
), n AS (
  SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text, max(turn) OVER (PARTITION BY conv_id) AS last_turn,
         last_value(CASE WHEN role = 'user' AND turn % 4 = 2 THEN
             CASE (conv_id + turn) % 3 WHEN 0 THEN 'model-a' WHEN 1 THEN 'model-b' ELSE '<synthetic>' END END IGNORE NULLS)
           OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS model
  FROM k WINDOW w AS (PARTITION BY conv_id ORDER BY turn)
), p AS (
  SELECT *, '/logs/.codex/sessions/2026/01/0' || (conv_id % 9 + 1) || '/rollout-' || conv_id || '.jsonl' AS path
  FROM n
)"""

ROLLOUT = (
    ROLLOUT_ALL
    + f""", t AS (
  SELECT *, 'r' || conv_id AS session_id, 'cli' AS surface, text AS prompt_text,
         CASE WHEN next_role = 'assistant' THEN next_text END AS response_text, {TS} AS prompt_ts,
         '/work/r' || (conv_id % 5) AS project_context
  FROM p WHERE role = 'user' AND conv_id % 11 <> 0
    AND (next_role = 'assistant' OR (next_role IS NULL AND conv_id % 2 = 0))
)
"""
)

# The secret patterns as written for an RE2 engine, in order.
RE2_PATTERNS = {
    "sk_key": r"sk-[a-zA-Z0-9-]{20,}",
    "pem_key": r"(?s)-----BEGIN [A-Z ]*KEY-----.*?-----END [A-Z ]*KEY-----",
    "github_token": r"gh[pousr]_[A-Za-z0-9]{20,}",
    "aws_access_key": r"AKIA[0-9A-Z]{16}",
    "google_access_token": r"ya29\.[0-9A-Za-z_\-]+",
    "google_refresh_token": r"1//[0-9A-Za-z_\-]+",
    "bearer": r"(?i)bearer\s+[A-Za-z0-9._\-]+",
    "assignment": r"(?i)(api[_\-]?key|secret|token|password)\s*=\s*\S+",
}


def _with_secret(text: str, key: str) -> str:
    cases = " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(SECRETS))
    return f"{text} || CASE {key} % {len(SECRETS)} {cases} END"


def _scrub(sql: str) -> str:
    for pattern in RE2_PATTERNS.values():
        sql = f"regexp_replace({sql}, '{pattern}', '«REDACTED»', 'g')"
    return sql


NATION_DIR = "'/home/u' || n_nationkey || '/.claude' || CASE WHEN n_nationkey = 0 THEN '' ELSE '-' || n_nationkey END"
NATION_KEY = "CASE WHEN n_nationkey = 0 THEN 'device-token' ELSE 'device-token-claude-' || n_nationkey END"

TURN_EVENTS = f"""
WITH e AS (
  SELECT conv_id, turn, CASE WHEN conv_id % 5 > 0 THEN 's' || conv_id END AS session_id, text AS prompt_text,
         CASE WHEN turn % 4 <> 0 THEN upper(role) END AS response_text, {TS} AS prompt_ts,
         CASE WHEN turn % 3 > 0 THEN turn % 2 END AS token_count, CASE WHEN conv_id % 2 = 0 THEN 'model-a' END AS model
  FROM conversations
)
"""

DOCS = """
WITH d AS (
  SELECT doc_id, source AS employee_id, sha256('CLAUDE_CODE|' || lang || '|' || text || '|2026-01-01T00:00:00') AS content_hash
  FROM documents
)"""

ORDER_SPOOL = r"""
WITH s AS (
  SELECT lower(regexp_replace(o_orderpriority, '[^A-Za-z0-9]+', '-', 'g')) AS queue_slug,
         lpad((o_orderkey // 3000)::VARCHAR, 6, '0') AS spool_file, o_orderkey, o_custkey
  FROM orders
), b AS (
  SELECT *, row_number() OVER (PARTITION BY queue_slug, spool_file ORDER BY o_orderkey) - 1 AS place FROM s
)"""

# With every file at rest at the end, a last prompt settles once answered (block log) or at once.
STORED = (
    BLOCK.replace("WHERE next_user IS NOT NULL OR (n > 0 AND conv_id % 2 = 0 AND conv_id % 10 <> 4)", "WHERE next_user IS NOT NULL OR (n > 0 AND conv_id % 10 <> 4)")
    + ", r AS (SELECT * FROM ("
    + ROLLOUT.replace("(next_role IS NULL AND conv_id % 2 = 0)", "next_role IS NULL")
    + " SELECT * FROM t))"
    + """, s AS (
  SELECT 'CLAUDE_CODE' AS source_tool, session_id, prompt_text, response_text, token_count,
         project_context, model, prompt_ts FROM t
  UNION ALL
  SELECT 'CODEX', session_id, prompt_text, response_text, NULL, project_context, model, prompt_ts FROM r
)
, stored AS (SELECT s.* REPLACE ("""
    + _scrub("prompt_text")
    + " AS prompt_text, "
    + _scrub("response_text")
    + " AS response_text), '1.0' AS client_version FROM s)"
)

SQL = {
    "line_positions": """
        WITH l AS (
          SELECT source, doc_id, unnest(string_split(text, chr(10))) AS line,
                 generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no
          FROM documents)
        SELECT source, doc_id, line_no,
               coalesce(sum(strlen(line) + 1) OVER (PARTITION BY source ORDER BY doc_id, line_no
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS byte_offset,
               sum(strlen(line) + 1) OVER (PARTITION BY source)::BIGINT AS file_size
        FROM l""",
    "strict_lines": "SELECT event_id, event_id % 10 IN (0, 7, 9) AS valid FROM events",
    "effective_cursors": """
        WITH c AS (
          SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN o_custkey ELSE 0 END
                                  WHEN o_orderkey % 5 = 1 THEN 0 ELSE o_custkey * 3 END AS c
          FROM orders)
        SELECT o_orderkey, CASE WHEN c > 2000 + o_orderkey % 100 THEN 0 ELSE c END AS start_offset FROM c""",
    "claude_turns": BLOCK
    + "SELECT path, session_id, surface, prompt_text, response_text, prompt_ts, project_context FROM t",
    "claude_turns_chunked": BLOCK
    + "SELECT path, session_id, surface, prompt_text, response_text, prompt_ts, token_count, project_context, model FROM t",
    "claude_turn_tokens": BLOCK + "SELECT session_id, prompt_ts, token_count FROM t",
    "claude_turn_model": BLOCK + "SELECT session_id, prompt_ts, model FROM t",
    "claude_held_cursors": BLOCK
    + """, h AS (SELECT conv_id, turn FROM j WHERE next_user IS NULL AND NOT (n > 0 AND conv_id % 2 = 0 AND conv_id % 10 <> 4))
        SELECT c.conv_id, h.turn AS held_turn, h.turn IS NULL AS at_end
        FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN h ON h.conv_id = c.conv_id""",
    "synthetic_filter_report": """
        SELECT reason, sum(n)::BIGINT AS n_lines FROM (
          SELECT CASE role WHEN 'assistant' THEN 'not_user' WHEN 'system' THEN 'marker' ELSE 'kept' END AS reason,
                 CASE WHEN role = 'assistant' AND turn % 4 = 1 THEN 2 ELSE 1 END AS n
          FROM conversations
          UNION ALL SELECT CASE (conv_id + turn) % 9 WHEN 4 THEN 'no_text' WHEN 5 THEN 'invalid' WHEN 6 THEN 'not_user' ELSE 'prefix' END, 1
          FROM conversations WHERE (conv_id + turn) % 9 < 7) GROUP BY 1""",
    "late_replies": """
        WITH f AS (SELECT conv_id, min(turn) FILTER (role = 'user') AS first_prompt FROM conversations WHERE turn >= 1 GROUP BY conv_id)
        SELECT '/logs/.claude/projects/p' || (c.conv_id % 7) || '/s' || c.conv_id || '.jsonl' AS path,
               sum(CASE WHEN turn % 4 = 1 THEN 2 ELSE 1 END)::BIGINT AS n_late
        FROM conversations c JOIN f ON f.conv_id = c.conv_id
        WHERE role = 'assistant' AND turn >= 1 AND (first_prompt IS NULL OR turn < first_prompt) GROUP BY 1""",
    "codex_turns": ROLLOUT
    + "SELECT path, session_id, surface, prompt_text, response_text, prompt_ts, project_context FROM t",
    "codex_turns_chunked": ROLLOUT
    + "SELECT path, session_id, prompt_text, response_text, prompt_ts, project_context, model FROM t",
    "codex_model_carry": ROLLOUT + "SELECT session_id, prompt_ts, model FROM t",
    "codex_exec_excluded": ROLLOUT
    + """SELECT p.path, 1 AS n_headers, count(t.turn) AS n_turns
         FROM p LEFT JOIN t ON t.conv_id = p.conv_id AND t.turn = p.turn GROUP BY p.path""",
    "codex_emission_gate": ROLLOUT
    + "SELECT session_id, prompt_text, response_text, prompt_ts FROM t WHERE last_turn < 4 OR turn >= 4",
    "codex_idle_flush": ROLLOUT + "SELECT session_id, prompt_text, prompt_ts FROM t WHERE response_text IS NULL",
    "codex_lost_prompts": ROLLOUT
    + """SELECT path, count(*) AS n_lost FROM p
         WHERE role = 'user' AND next_role = 'user' AND conv_id % 11 <> 0 GROUP BY path""",
    "rollout_kind_report": """
        SELECT kind, count(*) AS n_lines FROM (
          SELECT CASE role WHEN 'system' THEN 'E' WHEN 'user' THEN 'U' ELSE 'A' END AS kind FROM conversations
          WHERE NOT (role = 'assistant' AND conv_id % 5 = 0 AND turn % 4 = 1)
          UNION ALL SELECT 'H' FROM conversations WHERE turn = 0
          UNION ALL SELECT 'M' FROM conversations WHERE role = 'user' AND turn % 4 = 2
          UNION ALL SELECT CASE (conv_id + turn) % 7 WHEN 0 THEN 'I' WHEN 1 THEN 'C' WHEN 2 THEN 'O' END
          FROM conversations WHERE (conv_id + turn) % 7 < 4) GROUP BY kind""",
    "carry_forward_events": """
        SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN value END IGNORE NULLS) OVER (
          PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_signup_value
        FROM events""",
    "next_pair_events": """
        SELECT event_id, next_event_id FROM (
          SELECT event_id, event_type, lead(event_id) OVER w AS next_event_id, lead(event_type) OVER w AS next_type
          FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
        WHERE event_type = 'view' AND next_type = 'purchase'""",
    "segment_events": """
        SELECT event_id, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (
          PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS segment
        FROM events""",
    "hot_user_scan": """
        WITH e AS (SELECT * REPLACE (CASE WHEN event_id % 3 = 0 THEN -1 ELSE user_id END AS user_id) FROM events)
        SELECT event_id,
          last_value(CASE WHEN event_type = 'signup' THEN value END IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_signup_value,
          lead(event_id) OVER w AS next_event_id,
          sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS segment,
          coalesce(sum(event_id) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ids_before,
          sum(event_id) OVER (PARTITION BY user_id)::BIGINT AS ids_of_user
        FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""",
    "events_in_scan_order": BLOCK
    + ", r AS (SELECT * FROM ("
    + ROLLOUT
    + """ SELECT * FROM t))
      SELECT row_number() OVER (ORDER BY a, path, prompt_ts) AS position, source_tool, path, session_id, prompt_text FROM (
        SELECT 1 AS a, 'CLAUDE_CODE' AS source_tool, path, session_id, prompt_text, prompt_ts FROM t
        UNION ALL SELECT 2, 'CODEX', path, session_id, prompt_text, prompt_ts FROM r)""",
    "idle_users": """
        SELECT user_id, strftime(max(ts), '%Y-%m-%dT%H:%M:%S') AS last_ts FROM events
        GROUP BY user_id HAVING max(ts) < TIMESTAMP '2024-01-29 23:50:00'""",
    "redact_documents": f"SELECT doc_id, {_scrub(_with_secret('text', 'doc_id'))} AS text FROM documents",
    "redact_pages": f"SELECT page_id, {_scrub(_with_secret('html', 'page_id'))} AS html FROM pages",
    "secret_hits_by_pattern": f"WITH d AS (SELECT {_with_secret('text', 'doc_id')} AS text FROM documents) "
    + " UNION ALL ".join(
        f"SELECT '{name}' AS pattern, count(*) FILTER (regexp_matches(text, '{p}')) AS n_docs FROM d"
        for name, p in RE2_PATTERNS.items()
    ),
    "rfc3339_parse": """
        SELECT event_id, CASE WHEN event_id % 6 IN (3, 4) THEN '0001-01-01T00:00:00'
          ELSE strftime(ts + CASE event_id % 6 WHEN 1 THEN INTERVAL '-9 hours' WHEN 2 THEN INTERVAL '210 minutes'
                             ELSE INTERVAL '0 hours' END, '%Y-%m-%dT%H:%M:%S') END AS ts
        FROM events""",
    "surface_normalize": """
        SELECT CASE (props->>'$.k')::INT % 4 WHEN 0 THEN 'cli' WHEN 1 THEN 'sdk-cli' ELSE 'unknown' END AS surface,
               count(*) AS n FROM events GROUP BY 1""",
    "project_context": """
        SELECT conv_id, turn, nullif(CASE WHEN conv_id % 4 = 0 THEN '' ELSE '/w/' || conv_id END ||
               CASE WHEN turn % 2 = 0 THEN ' @main' ELSE '' END, '') AS project_context FROM conversations""",
    "slug_token_keys": """
        WITH s AS (SELECT c_custkey, CASE WHEN c_custkey % 10 IN (0, 1) THEN 'claude'
            ELSE lower(c_mktsegment) || '-' || replace(lower(c_name), '#', '-') END AS slug FROM customer)
        SELECT c_custkey, slug, CASE WHEN c_custkey % 10 = 0 THEN 'device-token' ELSE 'device-token-' || slug END AS token_key
        FROM s""",
    "resolve_dirs": """
        SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '/home/u0/.claude'
          WHEN 1 THEN '/srv/n' || c_nationkey || '/' || c_custkey WHEN 2 THEN '/home/u0/.claude-' || c_custkey
          ELSE '/home/up/' || c_custkey END AS dir FROM customer""",
    "attribute_events": """
        SELECT CASE WHEN user_id % 30 = 0 THEN 'device-token' ELSE 'device-token-claude-' || (user_id % 30) END AS token_key,
               CASE WHEN user_id % 30 = 0 THEN 'default' ELSE 'claude-' || (user_id % 30) END AS queue_slug,
               count(*) AS n_events
        FROM events WHERE user_id % 30 IN (SELECT n_nationkey FROM nation) GROUP BY ALL""",
    "primary_machine_events": """
        SELECT event_id, '/home/u0/.claude' AS config_dir, 'device-token' AS token_key, 'default' AS queue_slug
        FROM events""",
    "registry_collisions": """
        SELECT 'device-token-' || replace(lower(p_brand), '#', '-') AS token_key,
               count(DISTINCT (p_size % 4) || '/' || p_brand || (p_partkey % 2)) AS n_dirs
        FROM part GROUP BY 1 HAVING count(DISTINCT (p_size % 4) || '/' || p_brand || (p_partkey % 2)) > 1""",
    "registry_upsert_remove": f"""
        WITH r AS (SELECT n_nationkey, n_regionkey, {NATION_DIR} AS config_dir, {NATION_KEY} AS token_key FROM nation),
        w AS (SELECT DISTINCT s_suppkey % 40 AS j FROM supplier),
        grown AS (
          SELECT config_dir, token_key, CASE WHEN n_nationkey > 0 AND n_nationkey IN (SELECT j FROM w) THEN 'updated' ELSE 'kept' END AS status
          FROM r WHERE n_nationkey = 0 OR n_regionkey <> 2
          UNION ALL SELECT '/home/u' || j || '/.claude-' || j, 'device-token-claude-' || j, 'added' FROM w
          WHERE j = 0 OR j NOT IN (SELECT n_nationkey FROM nation)
          UNION ALL SELECT '/other/claude-' || (r_regionkey + 1), 'device-token-claude-' || (r_regionkey + 1), 'collision' FROM region)
        SELECT * FROM grown""",
    "registry_removal_report": f"""
        WITH w AS (SELECT DISTINCT s_suppkey % 40 AS j FROM supplier)
        SELECT '/home/u' || j || '/.claude' || CASE WHEN j = 0 THEN '' ELSE '-' || j END AS config_dir,
               CASE WHEN n_nationkey IS NOT NULL THEN {NATION_KEY} END AS token_key,
               CASE WHEN j = 0 THEN 'refused' WHEN n_nationkey IS NOT NULL THEN 'removed' ELSE 'not found' END AS outcome
        FROM w LEFT JOIN nation ON n_nationkey = j""",
    "enrollment_status": """
        SELECT '/c/' || c_custkey AS config_dir, 'device-token-' || c_custkey AS token_key,
               CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') THEN 'enrolled' ELSE 'no token' END AS status
        FROM customer""",
    "content_hashes": TURN_EVENTS
    + """SELECT session_id, prompt_ts AS prompt_ts_text,
         sha256('CLAUDE_CODE|' || coalesce(session_id, '') || '|' || prompt_text || '|' || prompt_ts) AS content_hash FROM e""",
    "wire_events": TURN_EVENTS
    + """SELECT conv_id, turn, session_id, prompt_text, response_text, prompt_ts, token_count, model,
         concat_ws(',', 'sourceTool', 'surface', CASE WHEN session_id IS NOT NULL THEN 'sessionId' END, 'promptText',
           CASE WHEN response_text IS NOT NULL THEN 'responseText' END, 'promptTs',
           CASE WHEN token_count IS NOT NULL THEN 'tokenCount' END, 'clientVersion',
           CASE WHEN model IS NOT NULL THEN 'model' END) AS wire_keys FROM e""",
    "dedup_first_writer": DOCS
    + " SELECT employee_id, content_hash, min(doc_id) AS doc_id FROM d GROUP BY employee_id, content_hash",
    "dedup_incremental": DOCS
    + """ SELECT employee_id, content_hash, doc_id, (doc_id % 3)::VARCHAR AS pass_id FROM d
      QUALIFY row_number() OVER (PARTITION BY employee_id, content_hash ORDER BY doc_id % 3, doc_id) = 1""",
    "dedup_against_stored": DOCS
    + """ SELECT employee_id, content_hash, min(doc_id) AS doc_id FROM d WHERE NOT EXISTS (
            SELECT 1 FROM labels l JOIN d AS s ON s.doc_id = l.doc_id
            WHERE s.employee_id = d.employee_id AND s.content_hash = d.content_hash)
          GROUP BY employee_id, content_hash""",
    "ingest_counts": DOCS
    + """, r AS (SELECT *, row_number() OVER (PARTITION BY employee_id, content_hash ORDER BY doc_id) AS rn FROM d)
        SELECT doc_id // 100 AS batch, count(*) FILTER (rn = 1) AS accepted, count(*) FILTER (rn > 1) AS duplicates
        FROM r GROUP BY 1""",
    "upload_batches": ORDER_SPOOL
    + "SELECT queue_slug, spool_file, o_orderkey, place // 100 AS batch, place % 100 AS seq FROM b",
    "upload_envelopes": TURN_EVENTS
    + """, b AS (SELECT *, conv_id // 50 AS spool_file,
             (row_number() OVER (PARTITION BY conv_id // 50 ORDER BY conv_id, turn) - 1) // 30 AS batch FROM e)
        SELECT spool_file, batch, count(*) AS n_events, count(*)::INT AS n_decoded,
               arg_min(prompt_text, conv_id * 100000 + turn) AS first_prompt,
               arg_max(prompt_ts, conv_id * 100000 + turn) AS last_ts
        FROM b GROUP BY spool_file, batch""",
    "pending_batches": ORDER_SPOOL
    + """, f AS (SELECT queue_slug, min(spool_file) AS first_failed FROM (
            SELECT queue_slug, spool_file FROM b GROUP BY queue_slug, spool_file, place // 100 HAVING max(o_custkey) % 7 = 0)
          GROUP BY queue_slug)
        SELECT b.queue_slug, b.spool_file, count(*) AS n_events FROM b JOIN f USING (queue_slug)
        WHERE b.spool_file >= first_failed GROUP BY ALL""",
    "failure_summary": """
        WITH d AS (SELECT DISTINCT '/logs/.codex/sessions/2026/01/0' || (conv_id % 9 + 1) AS dir
                   FROM conversations WHERE conv_id % 6 = 0),
        s AS (SELECT 'CODEX' AS source, count(*) AS n_failed, string_agg(dir, ', ' ORDER BY dir) AS places FROM d)
        SELECT *, n_failed || '개 폴더 수집 실패: ' || places AS message FROM s WHERE n_failed > 0""",
    "merge_cursors": """
        SELECT '/f/' || o_orderkey AS path, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey + 100000 ELSE o_custkey END AS cursor
        FROM orders WHERE o_orderkey % 3 <> 0 OR o_orderkey % 2 = 0""",
    "incremental_equals_full": BLOCK
    + "SELECT path, session_id, prompt_text, response_text, prompt_ts, token_count, model FROM t",
    "run_once_events": STORED + " SELECT * FROM stored",
    "streaming_turns": STORED + " SELECT * FROM stored",
    # Home u1 has no token, so its rollouts are nobody's, and u1's team folder has two keys but is collected all the same.
    "collect_edge_cases": STORED
    + """, ev AS (
        SELECT 'event' AS kind, source_tool, 'u' || (conv % 2) AS home, CASE WHEN source_tool = 'CLAUDE_CODE' AND conv % 4 > 1 THEN 'claude-team' ELSE 'default' END AS detail,
               session_id, prompt_text FROM (SELECT *, substr(session_id, 2)::BIGINT AS conv FROM stored) WHERE source_tool = 'CLAUDE_CODE' OR conv % 2 = 0),
      c AS (SELECT DISTINCT conv_id FROM conversations WHERE conv_id % 2 = 0),
      er AS (
        SELECT 'error' AS kind, 'CODEX' AS source_tool, 'u0' AS home, 'no session header' AS detail, 'rollout-' || x || '-' || conv_id || '.jsonl' AS session_id, NULL AS prompt_text
        FROM c, (SELECT unnest(['empty', 'bare']) AS x)
        UNION ALL SELECT 'error', 'registry', 'u1', 'several token keys', '.claude-team', NULL),
      q AS (SELECT count(DISTINCT home || detail) AS n_queues FROM ev)
      SELECT u.*, n_queues FROM (SELECT * FROM ev UNION ALL SELECT * FROM er) u, q""",
    "deliver_once": r"""
      WITH s AS (SELECT lower(regexp_replace(o_orderpriority, '[^A-Za-z0-9]+', '-', 'g')) AS queue_slug, (o_orderkey % 3)::VARCHAR AS pass FROM orders),
      n AS (SELECT queue_slug, pass, count(*) AS n FROM s GROUP BY ALL),
      -- The failing run sends the first batch of the second file and no more of that queue.
      r AS (SELECT *, queue_slug[1] IN ('1', '3') AS broken FROM n)
      SELECT '1' AS run, queue_slug, pass, (CASE WHEN broken AND pass = '1' THEN least(n, 100) ELSE n END)::BIGINT AS n_events FROM r WHERE NOT broken OR pass < '2'
      UNION ALL SELECT '2', queue_slug, pass, n::BIGINT FROM r WHERE broken AND pass > '0'""",
    "third_format_turns": STORE
    + " SELECT 'GEMINI' AS source_tool, 'cli' AS surface, session_id, prompt_text, response_text, prompt_ts, model FROM t",
    "third_format_precedence": STORE
    + " SELECT session_id, CASE WHEN conv_id % 4 = 0 THEN 'whole' ELSE 'nested' END AS layout, prompt_text, response_text FROM t",
    "third_format_cwd": STORE
    + """ SELECT session_id, CASE WHEN conv_id % 3 = 0 THEN '/work/g' || (conv_id % 5) WHEN conv_id % 4 = 0 THEN '/real/p0' ELSE 'p' || (conv_id % 4) END AS project_context,
      count(*) AS n_turns FROM t GROUP BY ALL""",
    "unchanged_files_skipped": """
      WITH f AS (SELECT DISTINCT conv_id, unnest(CASE conv_id % 4 WHEN 0 THEN [2, 3] WHEN 1 THEN [1, 3] WHEN 2 THEN [1, 2] ELSE [1, 2, 3] END) AS layout FROM conversations)
      SELECT layout, count(*) AS n_opened, p AS pass FROM f, (VALUES (0), (1), (2)) v(p) WHERE p <> 1 OR conv_id % 5 = 0 GROUP BY ALL""",
    "stream_lines_growing": r"""
      WITH l AS (SELECT source, doc_id, replace(text, chr(10), ' ') AS line FROM documents)
      SELECT source, (sum(octet_length(encode(line)) + 1) OVER (PARTITION BY source ORDER BY doc_id) - octet_length(encode(line)) - 1)::BIGINT AS byte_offset,
             md5(line) AS line_md5, NULL::VARCHAR AS error FROM l""",
    "stateful_turns": BLOCK.replace("WHERE next_user IS NOT NULL OR (n > 0 AND conv_id % 2 = 0 AND conv_id % 10 <> 4)", "WHERE next_user IS NOT NULL OR (n > 0 AND conv_id % 10 <> 4)")
    + " SELECT path, session_id, prompt_text, response_text, prompt_ts, token_count, model FROM t",
    "stream_deliver": r"""
      SELECT CASE WHEN o_orderpriority[1] IN ('1', '3') AND o_orderkey % 3 > 0 THEN '2' ELSE '1' END AS run,
             lower(regexp_replace(o_orderpriority, '[^A-Za-z0-9]+', '-', 'g')) AS queue_slug, (o_orderkey % 3)::VARCHAR AS pass, count(*) AS n_events
      FROM orders GROUP BY ALL""",
}
