"""The views of ``views`` as SQL, composed into WITH clauses."""

from __future__ import annotations

from checks.views import CATEGORIES, COLUMN_POOL, PRIORITIES, SEVERITIES, SOURCES, STATES, TEMPLATES
from faultline.functions.signatures import CATALOGUE, Signature, ranked
from faultline.operators.logs import ERROR_KEYWORDS


def quote(text: str | None) -> str:
    if text is None:
        return "NULL"
    return "'" + text.replace("'", "''") + "'"


def items(values: list) -> str:
    return "[" + ", ".join(quote(v) for v in values) + "]"


DAG = "'dag_' || (user_id % 20)"
TASK = "'task_' || (user_id % 7)"
K = "CAST(json_extract_string(props, '$.k') AS INTEGER)"
SPACE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def ts(expr: str) -> str:
    return f"strftime({expr}, '%Y-%m-%d %H:%M:%S.%f')"


def strip(expr: str) -> str:
    return f"regexp_replace(regexp_replace({expr}, '^{SPACE}+', ''), '{SPACE}+$', '')"


def catalogue_rows(signatures: list[Signature]) -> str:
    rows = []
    for rank, (idx, s) in enumerate(ranked(signatures)):
        for rx, regex in enumerate(s.regexes):
            rows.append(
                f"({rank}, {idx}, {rx}, {quote(s.name)}, {quote(s.category)}, {quote(s.severity)}, "
                f"{quote(s.description)}, {quote(s.recommendation)}, {quote(regex)})"
            )
    return (
        "SELECT * FROM (VALUES " + ", ".join(rows)
        + ") AS t(rk, sig_idx, rx_idx, name, category, severity, description, recommendation, regex)"
    )


def matches_cte(source: str, key: str, text: str, signatures: list[Signature], prefix: str = "") -> list[tuple[str, str]]:
    """CTEs: hits per regex, matches per family, the primary family."""
    return [
        (f"{prefix}cat", catalogue_rows(signatures)),
        (f"{prefix}hits", f"SELECT {key} AS k, c.*, regexp_extract_all({text}, regex, 0, 'i') AS m "
                          f"FROM {source}, {prefix}cat c"),
        (f"{prefix}fam", f"SELECT k, rk, sig_idx, name, category, severity, description, recommendation, "
                         f"flatten(list(m ORDER BY rx_idx)) AS matches FROM {prefix}hits WHERE len(m) > 0 "
                         "GROUP BY ALL"),
        (f"{prefix}prim", f"SELECT * FROM {prefix}fam QUALIFY row_number() OVER (PARTITION BY k ORDER BY rk) = 1"),
    ]


ANY_REGEX = "|".join(f"(?:{r})" for s in CATALOGUE for r in s.regexes)
KEYWORDS = "|".join(ERROR_KEYWORDS)
N = "(conv_id + turn)"


def parsed(source: str, keys: str) -> str:
    """The verdict in each reply, null where it holds none."""
    return rf"""
        SELECT {keys}, CASE WHEN json_valid(obj) AND CAST(json_extract(obj, '$.confidence') AS DOUBLE)
                   BETWEEN 0 AND 1 THEN CAST(obj AS JSON) END AS verdict
        FROM (SELECT {keys}, regexp_extract(CASE WHEN contains(raw, '```json')
                  THEN regexp_extract(raw, '(?s)```json(.*)```', 1) ELSE raw END, '(?s)(\{{.*\}})', 1) AS obj
              FROM {source})"""


VIEWS: dict[str, str] = {
    "failures": f"""
        SELECT event_id, {DAG} AS dag_id, {TASK} AS task_id, 'run_' || event_id AS run_id,
               CAST(event_id % 3 + 1 AS INTEGER) AS try_number, {items(TEMPLATES)}[event_id % 20 + 1] AS error_message,
               {items(STATES)}[event_id % 6 + 1] AS state, ts AS failed_at
        FROM events WHERE event_type = 'error'""",
    "runs": f"""
        SELECT {DAG} AS dag_id, 'run_' || lpad(CAST(event_id AS VARCHAR), 12, '0') AS run_id,
               CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'running' ELSE 'success' END AS state,
               ts AS execution_date, value AS duration_seconds FROM events""",
    "runs_star": """
        SELECT 'dag_' || (o_custkey % 20) AS dag_id, 'run_' || lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS run_id,
               CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'success' ELSE 'running' END AS state,
               o_orderdate AS execution_date, o_totalprice AS duration_seconds FROM orders""",
    "commits": """
        SELECT md5(CAST(event_id AS VARCHAR)) AS sha, substr(md5(CAST(event_id AS VARCHAR)), 1, 7) AS short_sha,
               'user_' || user_id AS author, 'user_' || user_id || '@example.com' AS email,
               'change ' || event_id AS message, ts AS date,
               ['dags/dag_' || (user_id % 20) || '.py', 'lib/util_' || (event_id % 3) || '.py'] AS files_changed,
               event_id, user_id
        FROM events WHERE event_type = 'signup'""",
    "task_instances": f"""
        SELECT {DAG} AS dag_id, {TASK} AS task_id, 'run_' || event_id AS run_id,
               CASE WHEN event_type = 'error' THEN 'failed' ELSE 'success' END AS state,
               CASE WHEN event_type <> 'purchase' THEN floor(value * 1000) / 1000.0 END AS duration_seconds,
               CAST(event_id % 3 + 1 AS INTEGER) AS try_number, 3 AS max_tries,
               CASE WHEN event_id % 2 = 0 THEN 'PythonOperator' END AS operator FROM events""",
    "plain_logs": f"""
        SELECT doc_id, source, text || chr(10) || {items(TEMPLATES)}[doc_id % 20 + 1] AS stdout FROM documents""",
    "log_lines": """
        SELECT doc_id, unnest(string_split(stdout, chr(10))) AS line,
               generate_subscripts(string_split(stdout, chr(10)), 1) - 1 AS line_no FROM plain_logs""",
    "stripped": f"SELECT doc_id, stdout, string_split({strip('stdout')}, chr(10)) AS lines FROM plain_logs",
    "snippets": f"""
        SELECT doc_id, len(lines) AS log_lines, length(stdout) > 100000 AS truncated, length(stdout) AS n_chars,
               CASE WHEN len(hits) > 0
                    THEN array_to_string(lines[greatest(1, hits[1] - 5):least(len(lines), hits[-1] + 9)], chr(10))
                    ELSE array_to_string(lines[greatest(1, len(lines) - 49):len(lines)], chr(10)) END AS snippet
        FROM (SELECT *, list_filter(range(1, len(lines) + 1),
                                    lambda i: regexp_matches(lower(lines[i]), '{KEYWORDS}')) AS hits FROM stripped)""",
    "key_lines": f"""
        SELECT doc_id, list({strip('line')} ORDER BY line_no) AS key_log_lines FROM (
            SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS n FROM log_lines
            WHERE regexp_matches(line, {quote(ANY_REGEX)}, 'i'))
        WHERE n <= 10 GROUP BY doc_id""",
    "raw_checks": f"""
        SELECT event_id AS check_id, 'src_' || (user_id % 15) AS source_name,
               CASE WHEN user_id % 15 < 9 THEN 'api' WHEN user_id % 15 < 12 THEN 'database'
                    WHEN user_id % 15 = 12 THEN 'file' WHEN user_id % 15 = 14 THEN 'api' END AS source_type,
               {K} AS k, CASE WHEN {K} < 85 THEN 200 WHEN {K} < 92 THEN 503 END AS status_code,
               CASE WHEN {K} < 92 THEN NULL WHEN {K} < 96 THEN 'timeout' ELSE 'connect' END AS exception_kind,
               'host unreachable ' || {K} AS exception_text, value AS raw_latency,
               CASE WHEN {K} % 25 = 0 THEN 0 ELSE CAST(floor(value * 1000) AS BIGINT) END AS row_count,
               {items(COLUMN_POOL)}[1:3 + {K} % 3] AS columns, ts AS last_checked
        FROM events WHERE event_type IN ('view', 'click')""",
    "checks": """
        SELECT check_id, source_name, coalesce(source_type, 'api') AS source_type, row_count, columns, last_checked,
               CASE WHEN coalesce(source_type, 'api') = 'api' THEN exception_kind IS NULL AND status_code = 200
                    WHEN source_type = 'database' THEN exception_kind IS NULL ELSE FALSE END AS reachable,
               CASE WHEN coalesce(source_type, 'api') IN ('api', 'database') AND exception_kind IS NULL
                    THEN raw_latency END AS latency_ms,
               CASE WHEN source_type = 'file' THEN 'Unknown source type: file'
                    WHEN source_type = 'database' AND exception_kind = 'timeout' THEN 'Connection timeout'
                    WHEN source_type = 'database' AND exception_kind IS NOT NULL THEN exception_text
                    WHEN source_type = 'database' THEN NULL
                    WHEN exception_kind = 'timeout' THEN 'Timeout'
                    WHEN exception_kind = 'connect' THEN 'Connection failed: ' || exception_text
                    WHEN status_code <> 200 THEN 'HTTP ' || status_code END AS error_message
        FROM raw_checks""",
    "drift": """
        SELECT *, CASE WHEN before <> 0 THEN (row_count - before) / CAST(before AS DOUBLE) * 100 END AS delta_pct,
               row_count = 0 OR coalesce(before > 0 AND row_count >= 10 * before, FALSE) AS volume_anomaly,
               CASE WHEN old IS NOT NULL
                    THEN list_sort(list_filter(columns, lambda x: NOT list_contains(old, x))) END AS added,
               CASE WHEN old IS NOT NULL
                    THEN list_sort(list_filter(old, lambda x: NOT list_contains(columns, x))) END AS removed
        FROM (SELECT *, lag(row_count) OVER w AS before, lag(columns) OVER w AS old FROM checks
              WINDOW w AS (PARTITION BY source_name ORDER BY last_checked, check_id))""",
    "metrics": f"""
        SELECT ts AS timestamp, least(value, 100.0) AS cpu_percent, CAST({K} AS DOUBLE) AS memory_percent,
               {K} AS active_connections FROM events WHERE event_type = 'purchase'""",
    "external_events": f"""
        SELECT event_id AS external_id, ts AS event_time, {DAG} AS dag_id, {TASK} AS task_id, event_type AS title
        FROM events WHERE event_type IN ('view', 'click', 'signup', 'purchase')""",
    "incidents": f"""
        SELECT 'inc_' || vec_id AS incident_id, 'dag_' || (vec_id % 20) AS dag_id, 'task_' || (vec_id % 7) AS task_id,
               'old_' || vec_id AS run_id, {items(CATEGORIES)}[label % 10 + 1] AS error_category,
               {items(SEVERITIES)}[vec_id % 4 + 1] AS severity,
               TIMESTAMP '2023-12-01' + to_hours(CAST(vec_id AS BIGINT)) AS date, 'cause ' || vec_id AS root_cause_summary,
               'detailed cause ' || vec_id AS root_cause,
               CASE WHEN vec_id % 5 = 0 THEN 'known fix ' || vec_id END AS resolution,
               CAST(embedding AS DOUBLE[]) AS embedding
        FROM embeddings""",
    "resolutions": """
        SELECT event_id AS update_id, 'inc_' || (event_id % 700) AS incident_id, 'fix ' || event_id AS resolution,
               ts AS updated_at FROM events WHERE event_type = 'click'""",
    "latest": """
        SELECT * FROM resolutions
        QUALIFY row_number() OVER (PARTITION BY incident_id ORDER BY updated_at DESC, update_id DESC) = 1""",
    "replies": f"""
        SELECT conv_id, turn, CASE WHEN {N} % 5 = 0 THEN 'Here it is:' || chr(10) || '```json' || chr(10) || body
                   || chr(10) || '```' || chr(10) || 'Done.'
               WHEN {N} % 5 IN (1, 3) THEN body WHEN {N} % 5 = 2 THEN 'I think ' || body || ' is right'
               ELSE text END AS raw
        FROM (SELECT *, '{{"error_category":"' || {items(CATEGORIES)}[{N} % 10 + 1] || '","severity":"'
                  || {items(SEVERITIES)}[{N} % 4 + 1] || '","root_cause":' || CAST(to_json(text) AS VARCHAR)
                  || ',"root_cause_summary":"turn ' || turn || '","confidence":'
                  || CASE WHEN {N} % 5 = 3 THEN '1.5' ELSE '0.' || ({N} % 9 + 1) END
                  || ',"evidence":["e' || turn || '","f"],"recommendations":[{{"action":"check ' || conv_id || '"'
                  || coalesce({items([None if p is None else ',"priority":' + p for p in PRIORITIES])}
                              [(conv_id * 7 + turn) % 8 + 1], '')
                  || '}}],"immediate_action":' || CASE WHEN {N} % 2 = 0 THEN '"stop"' ELSE 'null' END || '}}' AS body
              FROM conversations)""",
    "parsed": parsed("replies", "conv_id, turn"),
    "first_reply": "SELECT conv_id, min(raw) AS raw FROM replies GROUP BY conv_id",
    "answers": parsed("first_reply", "conv_id"),
    "dags": f"SELECT DISTINCT {DAG} AS dag_id FROM events",
    "dag_files": """
        SELECT CASE page_id % 5 WHEN 0 THEN 'proj/dags/team/etl_dag_' || (page_id % 23) || 'x' || page_id || '.py'
                    WHEN 1 THEN 'jobs' || page_id || '/dag_' || (page_id % 23) || '.py'
                    WHEN 2 THEN 'jobs' || page_id || '/dag_dag_' || (page_id % 23) || '.py'
                    WHEN 3 THEN 'jobs' || page_id || '/dag_' || (page_id % 23) || '_dag.py'
                    ELSE 'misc/page_' || page_id || '.py' END AS path,
               html || CASE WHEN page_id % 5 = 4
                            THEN chr(10) || 'with DAG(dag_id="dag_' || (page_id % 23) || '"):' ELSE '' END AS content
        FROM pages""",
    "neighbours": """
        SELECT p.incident_id AS probe_id, i.incident_id, list_distance(p.embedding, i.embedding) ** 2 AS distance
        FROM incidents p JOIN incidents i ON p.incident_id <> i.incident_id""",
    "nearest": """
        SELECT *, row_number() OVER (PARTITION BY probe_id ORDER BY distance, incident_id) AS rank,
               greatest(0.0, least(1.0, 1.0 - distance)) AS similarity_score
        FROM neighbours QUALIFY rank <= 5""",
}

VIEWS |= {
    "sig": "SELECT k AS doc_id, list(f ORDER BY rk) AS fams FROM log_fam f GROUP BY k",
    "hist": """
        SELECT event_id, max(execution_date) FILTER (n <= 20 AND state = 'success') AS last_success,
               max(execution_date) FILTER (n <= 20 AND state = 'failed') AS last_failure,
               list(state ORDER BY n) FILTER (n <= 20) AS states,
               list_sum(list(duration_seconds ORDER BY n) FILTER (n <= 20 AND state = 'success' AND duration_seconds <> 0))
                   / count(*) FILTER (n <= 20 AND state = 'success' AND duration_seconds <> 0) AS avg_duration,
               CASE WHEN count(*) FILTER (recent) > 0 THEN count(*) FILTER (recent AND state = 'failed')
                   / count(*) FILTER (recent) ELSE 0 END AS failure_rate,
               count(*) FILTER (recent) AS total_7d
        FROM (SELECT f.event_id, r.*, r.execution_date > f.failed_at - INTERVAL 7 DAY AS recent,
                     row_number() OVER (PARTITION BY f.event_id ORDER BY r.execution_date DESC, r.run_id DESC) AS n
              FROM failures f JOIN runs r ON r.dag_id = f.dag_id AND r.execution_date <= f.failed_at)
        GROUP BY event_id""",
    "recent": """
        SELECT f.event_id, list(k ORDER BY k.date DESC, k.sha DESC)[1:20] AS recent_commits FROM failures f JOIN (
            SELECT sha, short_sha, author, message, date FROM commits) k
            ON k.date <= f.failed_at AND k.date >= f.failed_at - INTERVAL 24 HOUR GROUP BY f.event_id""",
    "last_commit": """
        SELECT f.event_id, k.short_sha, date_diff('microsecond', k.date, f.failed_at) / 1e6 / 3600 AS hours
        FROM failures f ASOF LEFT JOIN (SELECT *, unnest(files_changed) AS file FROM commits) k
          ON k.file = 'dags/' || f.dag_id || '.py' AND f.failed_at >= k.date""",
    "asof_metrics": """
        SELECT f.event_id, m.cpu_percent, m.memory_percent, m.timestamp AS taken_at
        FROM failures f ASOF LEFT JOIN metrics m ON f.failed_at >= m.timestamp""",
    "asof_sources": """
        SELECT event_id, list(a ORDER BY i) AS sources FROM (
            SELECT f.event_id, s.i, k.source_name, k.reachable, k.latency_ms, k.delta_pct,
                   coalesce(len(k.added) + len(k.removed) > 0, FALSE) AS schema_changed
            FROM (SELECT event_id, failed_at FROM failures) f CROSS JOIN (SELECT unnest(range(0, 15)) AS i) s
            ASOF JOIN drift k ON k.source_name = 'src_' || s.i AND f.failed_at >= k.last_checked) a GROUP BY event_id""",
    "similar_list": """
        SELECT f.event_id, list(s ORDER BY s.rank) AS similar_incidents FROM failures f JOIN (
            SELECT n.probe_id, n.rank, n.incident_id, i.date, i.dag_id, i.task_id, i.root_cause, i.resolution
            FROM nearest n JOIN incidents i USING (incident_id)) s ON s.probe_id = 'inc_' || f.event_id
        GROUP BY f.event_id""",
    "ctx": """
        SELECT f.*, sha256(f.dag_id || chr(31) || f.task_id || chr(31) || f.run_id || chr(31) || f.try_number)
                   AS failure_id, t.state AS task_state, t.duration_seconds, t.max_tries, t.operator,
               n.doc_id IS NOT NULL AS has_context, n.log_lines, n.snippet, right(p.stdout, 2000) AS tail, g.fams,
               coalesce(kl.key_log_lines, []) AS key_log_lines, h.last_success, h.last_failure, h.states, h.avg_duration, h.failure_rate,
               h.total_7d, coalesce(r.recent_commits, []) AS recent_commits, l.hours, l.short_sha AS last_sha,
               coalesce(s.sources, []) AS sources, m.cpu_percent, m.memory_percent, m.taken_at, sl.similar_incidents
        FROM failures f LEFT JOIN task_instances t USING (dag_id, run_id, task_id)
        LEFT JOIN snippets n ON n.doc_id = f.event_id LEFT JOIN plain_logs p ON p.doc_id = f.event_id
        LEFT JOIN sig g ON g.doc_id = f.event_id LEFT JOIN key_lines kl ON kl.doc_id = f.event_id
        LEFT JOIN hist h ON h.event_id = f.event_id LEFT JOIN recent r ON r.event_id = f.event_id
        LEFT JOIN last_commit l ON l.event_id = f.event_id LEFT JOIN asof_sources s ON s.event_id = f.event_id
        LEFT JOIN asof_metrics m ON m.event_id = f.event_id LEFT JOIN similar_list sl ON sl.event_id = f.event_id""",
    "rep": """
        SELECT failure_id AS report_id, dag_id, task_id, run_id, failed_at AS failure_time, event_id,
               if(ok, json_extract_string(verdict, '$.error_category'), coalesce(p.category, 'unknown')) AS error_category,
               if(ok, json_extract_string(verdict, '$.severity'), coalesce(p.severity, 'medium')) AS severity,
               if(ok, json_extract_string(verdict, '$.root_cause'), coalesce(p.description,
                  'Unable to determine root cause from available information')) AS root_cause,
               if(ok, json_extract_string(verdict, '$.root_cause_summary'), coalesce(p.description,
                  'Unknown error - manual investigation required')) AS root_cause_summary,
               if(ok, CAST(json_extract(verdict, '$.confidence') AS DOUBLE), if(p IS NULL, 0.2, 0.6)::DOUBLE) AS confidence,
               if(ok, CAST(json_extract(verdict, '$.evidence') AS VARCHAR[]),
                  coalesce(list_transform(p.matches[1:3], lambda m: 'Pattern match: ' || m), [])) AS evidence,
               key_log_lines, list_transform(recent_commits[1:3], lambda k: k.short_sha || ': ' || k.message)
                   AS recent_changes,
               if(ok, json_extract_string(verdict, '$.recommendations[0].action'),
                  coalesce(p.recommendation, 'Review full logs manually')) AS action,
               if(ok, json_extract_string(verdict, '$.immediate_action'), NULL) AS immediate_action,
               coalesce(similar_incidents, []) AS similar_incidents,
               if(ok, 'tester', NULL) AS llm_model, len(sources) > 0 AS has_sources, taken_at IS NOT NULL AS has_metrics,
               ok
        FROM (SELECT c.*, fams[1] AS p, v.verdict, v.verdict IS NOT NULL AS ok FROM ctx c
              LEFT JOIN answers v ON v.conv_id = c.event_id WHERE c.has_context)""",
}

VIEWS |= {
    name: sql for name, sql in matches_cte("plain_logs", "doc_id", "stdout", CATALOGUE, prefix="log_")
}

DEPENDS = {
    "log_hits": ["plain_logs", "log_cat"], "log_fam": ["log_hits"], "log_prim": ["log_fam"],
    "log_lines": ["plain_logs"], "stripped": ["plain_logs"], "snippets": ["stripped"], "key_lines": ["log_lines"],
    "checks": ["raw_checks"], "drift": ["checks"], "latest": ["resolutions"], "parsed": ["replies"], "first_reply": ["replies"], "answers": ["first_reply"],
    "neighbours": ["incidents"], "nearest": ["neighbours"], "sig": ["log_fam"], "hist": ["failures", "runs"],
    "recent": ["failures", "commits"], "last_commit": ["failures", "commits"], "asof_metrics": ["failures", "metrics"],
    "asof_sources": ["failures", "drift"], "similar_list": ["failures", "nearest"],
    "ctx": ["failures", "task_instances", "snippets", "sig", "key_lines", "hist", "recent", "last_commit",
            "asof_sources", "asof_metrics", "similar_list"],
    "rep": ["ctx", "answers"],
}


def query(views: list[str], body: str, extra: list[tuple[str, str]] = ()) -> str:
    """``WITH`` the named views (and theirs), then ``extra`` CTEs, then the body."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for needed in DEPENDS.get(name, []):
            add(needed)
        if name not in ordered:
            ordered.append(name)

    for name in views:
        add(name)
    ctes = [(name, VIEWS[name]) for name in ordered] + list(extra)
    if not ctes:
        return body
    return "WITH " + ", ".join(f"{name} AS ({sql})" for name, sql in ctes) + " " + body


__all__ = ["SOURCES", "matches_cte", "query", "quote", "strip", "ts"]
