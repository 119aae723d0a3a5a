"""Context rows, reports and their texts."""

from __future__ import annotations

from dataclasses import replace

from pyspark.ml import Transformer
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, functions as F

from checks import views as v
from checks.registry import _checks, _with_file, register, rounded, similar
from checks.sql_views import query, ts
from faultline.functions import render
from faultline.functions.vectors import add_vector
from faultline.operators import context, health, incidents as inc, logs, metrics as metric_ops, reports
from faultline.operators.context import failure_id
from faultline.plans import triage as plan
from faultline.session import settled

c, lit = F.col, F.lit
OPTIONS = plan.Options(sources=tuple(v.SOURCES), enable_metrics=True, model_name="tester")


def failures(spark, sf) -> DataFrame:
    return _with_file(v.failures(spark, sf))


def tables(spark, sf, with_similar: bool = True) -> plan.Tables:
    probes = v.failures(spark, sf).withColumn("probe", v.tagged("inc_", c("event_id")))
    replies = v.replies(spark, sf).withColumn("event_id", c("conv_id"))
    keyed = plan.with_ids(v.failures(spark, sf)).select("event_id", "failure_id").join(replies, "event_id")
    return plan.Tables(
        task_instances=v.task_instances(spark, sf), task_logs=v.task_logs(spark, sf), dag_runs=v.runs(spark, sf),
        commits=v.commits(spark, sf), source_checks=health.with_drift(_checks(spark, sf)),
        metrics=v.metrics(spark, sf), replies=keyed.select("failure_id", "raw"),
        similar=plan.add_similar(probes, similar(spark, sf), v.incidents(spark, sf), "probe") if with_similar else None,
    )


def contexts(spark, sf, **extra) -> DataFrame:
    return plan.build_context(failures(spark, sf), tables(spark, sf), OPTIONS, **extra)


def report_rows(spark, sf) -> DataFrame:
    return plan.triage(failures(spark, sf), tables(spark, sf), OPTIONS)


@register("context_rows", query(["ctx"], f"""
    SELECT event_id, has_context, task_state, CAST(log_lines AS INTEGER) AS log_lines, duration_seconds,
           CAST(len(recent_commits) AS INTEGER) AS n_commits, round(hours, 6) AS hours_since_last_change, last_sha,
           CAST(len(sources) AS INTEGER) AS n_sources, {ts('taken_at')} AS metrics_at,
           round(failure_rate, 6) AS failure_rate_7d, CAST(total_7d AS INTEGER) AS total_runs_7d,
           CAST(coalesce(len(similar_incidents), 0) AS INTEGER) AS n_similar FROM ctx"""))
def _(spark, sf):
    return contexts(spark, sf).select(
        "event_id", "has_context", c("task.state").alias("task_state"), "log_lines", "task.duration_seconds",
        F.size("git.recent_commits").alias("n_commits"),
        F.round("git.hours_since_last_change", 6).alias("hours_since_last_change"),
        c("git.last_commit.short_sha").alias("last_sha"), F.size("sources").alias("n_sources"),
        v.ts_text("metrics.timestamp").alias("metrics_at"),
        F.round("dag_history.failure_rate_7d", 6).alias("failure_rate_7d"), "dag_history.total_runs_7d",
        F.size(F.coalesce("similar_incidents", F.array())).alias("n_similar"))


@register("context_history_asof", query(["ctx"], f"""
    SELECT event_id, {ts('last_success')} AS last_success, {ts('last_failure')} AS last_failure,
           array_to_string(states, ',') AS states, round(avg_duration, 6) AS avg_duration_seconds,
           round(failure_rate, 6) AS failure_rate_7d, CAST(total_7d AS INTEGER) AS total_runs_7d,
           coalesce(last_failure <= failed_at, TRUE) AS in_the_past FROM ctx"""))
def _(spark, sf):
    """The history in every context is the one at the failure's time."""
    past = lambda name: c(f"dag_history.{name}")
    return contexts(spark, sf).select(
        "event_id", v.ts_text(past("last_success")).alias("last_success"),
        v.ts_text(past("last_failure")).alias("last_failure"),
        v.joined(F.transform(past("recent_runs"), lambda r: r["state"]), ",").alias("states"),
        F.round(past("avg_duration_seconds"), 6).alias("avg_duration_seconds"),
        F.round(past("failure_rate_7d"), 6).alias("failure_rate_7d"), past("total_runs_7d").alias("total_runs_7d"),
        F.coalesce(past("last_failure") <= c("failed_at"), lit(True)).alias("in_the_past"))


@register("context_duplicate_attempts", query(["failures"], """
    SELECT event_id, 'run_' || event_id AS run_id, least(try_number, 2) AS attempt FROM failures"""))
def _(spark, sf):
    """Two earlier attempts and one later one of every task leave one context per failure, with the attempt it saw."""
    attempts = v.task_instances(spark, sf).withColumn("try_number", F.explode(F.array(lit(1), lit(2), lit(9))))
    logs_twice = v.task_logs(spark, sf)
    some = tables(spark, sf, with_similar=False)
    doubled = plan.Tables(
        task_instances=attempts, task_logs=logs_twice.unionByName(logs_twice), dag_runs=some.dag_runs,
        replies=some.replies.unionByName(some.replies))
    rows = plan.build_context(failures(spark, sf), doubled)
    return rows.select("event_id", "run_id", c("task.try_number").alias("attempt"))


@register("collectors_used", query(["ctx"], """
    SELECT event_id, array_to_string(list_filter(['airflow', 'git', if(len(sources) > 0, 'source_health', ''),
               if(taken_at IS NOT NULL, 'metrics', '')], lambda x: x <> ''), ',') AS collectors_used FROM ctx"""))
def _(spark, sf):
    from faultline.operators.context import collectors_used

    return contexts(spark, sf).select("event_id", v.joined(collectors_used(), ",").alias("collectors_used"))


@register("gate_errors", query(["ctx"], """
    SELECT event_id, 'Airflow collection failed|Cannot build context: missing Airflow data|No context for LLM analysis'
        AS errors FROM ctx WHERE NOT has_context"""))
def _(spark, sf):
    return contexts(spark, sf).where(~c("has_context")).select("event_id", v.joined("errors").alias("errors"))


@register("failures_without_report", query(["ctx"], """
    SELECT event_id, failure_id FROM ctx WHERE NOT has_context"""))
def _(spark, sf):
    rows = plan.with_ids(failures(spark, sf))
    done = report_rows(spark, sf).select(c("report_id").alias("failure_id"))
    return rows.join(done, "failure_id", "left_anti").select("event_id", "failure_id")


def _na(expr: str) -> str:
    return f"CASE WHEN {expr} IS NULL OR {expr} = 0 THEN 'N/A' ELSE CAST({expr} AS VARCHAR) END"


CONTEXT_TEXT = f"""
    '## Failed Task' || chr(10) || '- DAG: ' || dag_id || chr(10) || '- Task: ' || task_id || chr(10) || '- State: '
    || task_state || chr(10) || '- Try: ' || try_number || '/' || max_tries || chr(10) || '- Duration: '
    || {_na('duration_seconds')} || 's' || chr(10) || '- Operator: ' || coalesce(operator, 'unknown') || chr(10) || chr(10)
    || '## Error Logs' || chr(10) || '```' || chr(10) || if(snippet = '', tail, snippet) || chr(10) || '```'
    || chr(10) || chr(10) || '## DAG History' || chr(10) || '- Last success: '
    || coalesce({ts('last_success')} || '+00:00', 'Never') || chr(10) || '- Recent runs: ['
    || array_to_string(states[1:5], ', ') || ']' || chr(10) || '- Failure rate (7d): '
    || printf('%.1f', failure_rate * 100) || '%' || chr(10) || '- Avg duration: ' || {_na('avg_duration')} || 's'
    || if(len(recent_commits) = 0, '', chr(10) || chr(10) || '## Recent Git Changes' || chr(10)
          || array_to_string(list_transform(recent_commits[1:3], lambda k:
                 '  - ' || k.short_sha || ': ' || left(k.message, 50) || ' (' || k.author || ')'), chr(10))
          || chr(10) || '- Hours since last DAG change: ' || {_na('hours')})
    || if(len(sources) = 0, '', chr(10) || chr(10) || '## Source Health' || chr(10)
          || array_to_string(list_transform(sources, lambda s: '  - ' || s.source_name || ': '
                 || if(s.reachable, '✓', '✗') || ' (' || {_na('s.latency_ms')} || 'ms)'
                 || if(s.schema_changed, ' [SCHEMA CHANGED]', '')
                 || if(coalesce(s.delta_pct, 0) = 0, '', ' [Volume: ' || printf('%+.1f', s.delta_pct) || '%]')), chr(10)))
    || if(taken_at IS NULL, '', chr(10) || chr(10) || '## Infrastructure Metrics' || chr(10) || '- CPU: '
          || {_na('cpu_percent')} || '%' || chr(10) || '- Memory: ' || {_na('memory_percent')} || '%' || chr(10)
          || '- Disk: N/A%')"""
PATTERN_TEXT = """coalesce(array_to_string(list_transform(fams[1:5], lambda m: '- **' || m.name || '** (' || m.category
    || ', ' || m.severity || '): ' || m.description || chr(10) || '  Matches: '
    || array_to_string(m.matches[1:3], ', ') || chr(10) || '  Recommendation: ' || m.recommendation), chr(10)),
    'No known error patterns detected.')"""
SIMILAR_TEXT = """coalesce(array_to_string(list_transform(similar_incidents[1:3], lambda s: '- ['
    || strftime(s.date, '%Y-%m-%d') || '] ' || s.dag_id || '/' || s.task_id || ': ' || s.root_cause
    || coalesce(chr(10) || '  Resolution: ' || s.resolution, '')), chr(10)), 'No similar past incidents found.')"""


@register("context_text", query(["ctx"], f"SELECT event_id, {CONTEXT_TEXT} AS context FROM ctx WHERE has_context"))
def _(spark, sf):
    rows = contexts(spark, sf).where("has_context")
    # The SQL prints every instant with its microseconds; so does the library unless they are zero.
    return rows.select("event_id", render.context_text().alias("context"))


@register("prompts", query(["ctx"], f"""
    SELECT failure_id, 'Diagnose this pipeline failure.' || chr(10) || chr(10) || {CONTEXT_TEXT} || chr(10) || chr(10)
        || '## Pattern Matching Results' || chr(10) || {PATTERN_TEXT} || chr(10) || chr(10)
        || '## Similar Past Incidents' || chr(10) || {SIMILAR_TEXT} || chr(10) || chr(10)
        || 'Name the root cause that the evidence supports best.' AS user_prompt
    FROM ctx WHERE has_context"""))
def _(spark, sf):
    return reports.prompts(contexts(spark, sf)).select("failure_id", "user_prompt")


@register("incident_section", query(["ctx"], f"SELECT event_id, {SIMILAR_TEXT} AS section FROM ctx"))
def _(spark, sf):
    return contexts(spark, sf).select("event_id", render.incident_section(c("similar_incidents")).alias("section"))


@register("query_texts", query(["ctx"], """
    SELECT event_id, 'DAG: ' || dag_id || chr(10) || 'Task: ' || task_id || chr(10) || 'Error: '
        || coalesce(nullif(snippet, ''), error_message, '') AS query_text FROM ctx"""))
def _(spark, sf):
    return contexts(spark, sf).select("event_id", inc.query_text(
        c("dag_id"), c("task_id"), c("error_snippet"), c("error_message")).alias("query_text"))


REPORTS = """
    SELECT report_id, dag_id, error_category, severity, root_cause, root_cause_summary, confidence,
           array_to_string(evidence, '|') AS evidence, array_to_string(key_log_lines, chr(10)) AS key_log_lines,
           array_to_string(recent_changes, '|') AS recent_changes, action, immediate_action,
           len(similar_incidents) > 0 AS is_recurring, CAST(len(similar_incidents) AS INTEGER) AS recurrence_count,
           llm_model FROM rep"""


def _shown(rows: DataFrame) -> DataFrame:
    return rows.select(
        "report_id", "dag_id", "error_category", "severity", "root_cause", "root_cause_summary", "confidence",
        v.joined("evidence").alias("evidence"), v.joined("key_log_lines", "\n").alias("key_log_lines"),
        v.joined("recent_changes").alias("recent_changes"), c("recommendations")[0]["action"].alias("action"),
        "immediate_action", "is_recurring", "recurrence_count", "llm_model")


@register("reports", query(["rep"], REPORTS))
def _(spark, sf):
    return _shown(report_rows(spark, sf))


def line_tables(spark, sf) -> plan.Tables:
    """The logs as lines."""
    lines = logs.explode_lines(v.task_logs(spark, sf), context.LOG_KEYS, stripped=False)
    return replace(tables(spark, sf), task_logs=None, log_lines=lines)


@register("reports_from_lines", query(["rep"], REPORTS))
def _(spark, sf):
    return _shown(plan.triage(failures(spark, sf), line_tables(spark, sf), OPTIONS))


@register("contexts_from_lines", query(["ctx"], """
    SELECT event_id, has_context, CAST(log_lines AS INTEGER) AS log_lines, md5(snippet) AS snippet, md5(tail) AS tail,
           coalesce(array_to_string(list_transform(fams, lambda f: f.name), ','), '') AS families FROM ctx WHERE has_context"""))
def _(spark, sf):
    rows = plan.build_context(failures(spark, sf), line_tables(spark, sf), OPTIONS).where("has_context")
    return rows.select("event_id", "has_context", "log_lines", F.md5("error_snippet").alias("snippet"), F.md5("stdout_tail").alias("tail"),
                       v.joined(F.transform("matches", lambda m: m["name"]), ",").alias("families"))


LETTERS = "0123456789aeiost"


class LetterCounts(Transformer):
    """A vectoriser that SQL can state: how often a text holds each of some letters."""

    def _transform(self, dataset: DataFrame) -> DataFrame:
        text = c([name for name in dataset.columns if name != "_kept"][0])
        counts = F.array(*[(F.char_length(text) - F.char_length(F.replace(text, lit(x)))).cast("double") for x in LETTERS])
        return dataset.withColumn("_unit", array_to_vector(counts))


def letter_counts(text: str, letters: str = LETTERS) -> str:
    return "[" + ", ".join(f"CAST(length({text}) - length(replace({text}, '{x}', '')) AS DOUBLE)" for x in letters) + "]"


@register("triage_similar", query(["ctx", "incidents"], f"""
    SELECT event_id, CAST(rank AS INTEGER) AS rank, incident_id, error_category, root_cause, round(score, 6) AS similarity_score FROM (
        SELECT p.event_id, i.*, greatest(0.0, least(1.0, 1.0 - list_distance(p.vec, i.vec) ** 2)) AS score,
               row_number() OVER (PARTITION BY p.event_id ORDER BY round(list_distance(p.vec, i.vec) ** 2), incident_id) AS rank
        FROM (SELECT event_id, {letter_counts("query_text")} AS vec FROM (
                SELECT event_id, 'DAG: ' || dag_id || chr(10) || 'Task: ' || task_id || chr(10) || 'Error: '
                       || coalesce(nullif(snippet, ''), error_message, '') AS query_text FROM ctx)) p,
             (SELECT incident_id, error_category, root_cause, {letter_counts("text")} AS vec
              FROM incidents JOIN documents ON 'inc_' || doc_id = incident_id) i) WHERE rank <= 5"""))
def _(spark, sf):
    """The search inside triage: the contexts' own texts against stored vectors, made by one vectoriser."""
    texts = v.table(spark, sf, "documents").select(v.tagged("inc_", c("doc_id")).alias("incident_id"), "text")
    stored = v.incidents(spark, sf).drop("embedding").join(add_vector(texts, "text", LetterCounts()).drop("text"), "incident_id")
    inputs = replace(tables(spark, sf, with_similar=False), incidents=stored, vectoriser=LetterCounts())
    rows = plan.build_context(failures(spark, sf), inputs, OPTIONS)
    return rows.select("event_id", F.posexplode("similar_incidents").alias("pos", "s")).select(
        "event_id", (c("pos") + 1).alias("rank"), "s.incident_id", "s.error_category", "s.root_cause", F.round("s.similarity_score", 6).alias("similarity_score"))


SUMMARY = """'[' || upper(severity) || '] ' || dag_id || '/' || task_id || ': ' || root_cause_summary || ' (Confidence: '
    || printf('%.0f', confidence * 100) || '%)'"""


@register("summaries", query(["rep"], f"SELECT report_id, {SUMMARY} AS summary FROM rep"))
def _(spark, sf):
    return reports.summaries(report_rows(spark, sf))


FILE_NAME = """strftime(failure_time, '%Y%m%d_%H%M%S') || '_' || dag_id || '_' || task_id || '_'
    || left(report_id, 8) || '.txt'"""


@register("file_names", query(["rep"], f"SELECT report_id, {FILE_NAME} AS file_name FROM rep"))
def _(spark, sf):
    return reports.file_names(report_rows(spark, sf))


EMOJI = "CASE severity WHEN 'critical' THEN '🔴' WHEN 'high' THEN '🟠' WHEN 'medium' THEN '🟡' ELSE '🟢' END"


def _block(text: str) -> str:
    return "',{\"type\":\"section\",\"text\":{\"type\":\"mrkdwn\",\"text\":' || " + f"to_json({text}) || '}}}}'"


CHAT = f"""'{{"blocks":[{{"type":"header","text":{{"type":"plain_text","text":' ||
    to_json({EMOJI} || ' Pipeline Failure: ' || dag_id || '/' || task_id) || '}}}},{{"type":"section","fields":[' ||
    '{{"type":"mrkdwn","text":' || to_json('*Category:*' || chr(10) || error_category) || '}},{{"type":"mrkdwn","text":'
    || to_json('*Confidence:*' || chr(10) || printf('%.0f', confidence * 100) || '%') || '}}]}}'
    || ',{{"type":"section","text":{{"type":"mrkdwn","text":' || to_json('*Root Cause:*' || chr(10) || root_cause)
    || '}}}}'
    || if(coalesce(immediate_action, '') = '', '', ',{{"type":"section","text":{{"type":"mrkdwn","text":'
          || to_json('*🚨 Immediate Action:*' || chr(10) || immediate_action) || '}}}}')
    || if(len(evidence) = 0, '', ',{{"type":"section","text":{{"type":"mrkdwn","text":' || to_json('*Evidence:*'
          || chr(10) || array_to_string(list_transform(evidence[1:3], lambda e: '• ' || e), chr(10))) || '}}}}')
    || if(len(similar_incidents) = 0, '', ',{{"type":"context","elements":[{{"type":"mrkdwn","text":' || to_json('📚 '
          || len(similar_incidents) || ' similar incidents found. Last occurrence: '
          || strftime(similar_incidents[1].date, '%Y-%m-%d')) || '}}]}}')
    || ']'"""


@register("chat_payload", query(["rep"], f"""
    SELECT report_id, {CHAT} || ',"channel":"#alerts"}}' AS payload FROM rep"""))
def _(spark, sf):
    return reports.notifications(report_rows(spark, sf), "#alerts")


@register("simple_messages", query(["rep"], f"""
    SELECT report_id, '{{"text":' || to_json({SUMMARY}) || '}}' AS payload FROM rep"""))
def _(spark, sf):
    return report_rows(spark, sf).select("report_id", render.simple_message(render.summary()).alias("payload"))


NL2 = "chr(10) || chr(10)"


def _part(condition: str, title: str, body: str) -> str:
    return f"if({condition}, '', {NL2} || '{title}' || {NL2} || {body})"


def _bullets(array: str) -> str:
    return f"array_to_string(list_transform({array}, lambda e: '- ' || e), chr(10))"


UTC = "strftime(failure_time, '%Y-%m-%d %H:%M:%S UTC')"
PRIORITY = "1"
MARKDOWN = f"""'# 🔍 RCA Report: ' || dag_id || '/' || task_id || {NL2} || '**Report ID:** `' || report_id || '`' || chr(10)
    || '**Generated:** ' || {UTC} || {NL2} || '---' || {NL2} || '## Summary' || {NL2} || '| Field | Value |' || chr(10)
    || '|-------|-------|' || chr(10) || '| **DAG** | ' || dag_id || ' |' || chr(10) || '| **Task** | ' || task_id
    || ' |' || chr(10) || '| **Run ID** | ' || run_id || ' |' || chr(10) || '| **Failure Time** | ' || {UTC} || ' |'
    || chr(10) || '| **Category** | ' || error_category || ' |' || chr(10) || '| **Severity** | ' || {EMOJI} || ' '
    || upper(severity) || ' |' || chr(10) || '| **Confidence** | ' || printf('%.0f', confidence * 100) || '% |'
    || {NL2} || '---' || {NL2} || '## Root Cause' || {NL2} || root_cause
    || {_part('len(evidence) = 0', '### Evidence', _bullets('evidence'))}
    || {_part('len(key_log_lines) = 0', '### Key Log Lines',
              "'```' || chr(10) || array_to_string(key_log_lines[1:10], chr(10)) || chr(10) || '```'")}
    || {_part('len(recent_changes) = 0', '### Recent Changes', _bullets('recent_changes'))}
    || {NL2} || '---' || {NL2} || '## Recommendations'
    || if(coalesce(immediate_action, '') = '', '', {NL2} || '> **Immediate Action:** ' || immediate_action)
    || {NL2} || '1. **' || action || '**' || chr(10) || '   - Priority: ' || priority || '/5'
    || if(len(similar_incidents) = 0, '', {NL2} || '---' || {NL2} || '## Similar Past Incidents' || {NL2}
          || '| Date | DAG/Task | Root Cause | Resolution |' || chr(10)
          || '|------|----------|------------|------------|' || chr(10)
          || array_to_string(list_transform(similar_incidents[1:5], lambda s: '| ' || strftime(s.date, '%Y-%m-%d')
                 || ' | ' || s.dag_id || '/' || s.task_id || ' | ' || left(s.root_cause, 50) || '... | '
                 || coalesce(s.resolution, 'N/A') || ' |'), chr(10))
          || {NL2} || '**This appears to be a recurring issue** (' || len(similar_incidents) || ' similar incidents)')
    || {NL2} || '---' || {NL2} || '## Metadata' || {NL2} || '- **Analysis Duration:** N/Ams' || chr(10)
    || '- **LLM Model:** ' || coalesce(llm_model, 'N/A') || chr(10) || '- **Collectors Used:** airflow, git'
    || if(has_sources, ', source_health', '') || if(has_metrics, ', metrics', '')"""

PRIORITY_CTE = ("prio", """
    SELECT conv_id, CASE json_type(json_extract(verdict, '$.recommendations[0].priority'))
               WHEN 'BOOLEAN' THEN 1 WHEN 'UBIGINT' THEN least(5, CAST(p AS BIGINT))
               WHEN 'VARCHAR' THEN CASE WHEN p = '4' THEN 4 WHEN p = 'critical' THEN 1 WHEN p = 'HIGH' THEN 2 ELSE 3 END
               ELSE 3 END AS priority
    FROM (SELECT *, json_extract_string(verdict, '$.recommendations[0].priority') AS p FROM answers
          WHERE verdict IS NOT NULL)""")
WITH_PRIORITY = ("full_rep", """
    SELECT r.*, CASE WHEN r.ok THEN p.priority ELSE 1 END AS priority FROM rep r LEFT JOIN prio p ON p.conv_id = r.event_id""")


@register("markdown", query(["rep"], f"SELECT report_id, {MARKDOWN} AS body FROM full_rep",
                            [PRIORITY_CTE, WITH_PRIORITY]))
def _(spark, sf):
    return reports.export(report_rows(spark, sf), "markdown")


def _esc(expr: str) -> str:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        expr = f"replace({expr}, '{raw}', '{safe}')"
    return expr


HTML = f"""'<!DOCTYPE html>' || chr(10) || '<html>' || chr(10) || '<head>' || chr(10) || '<title>RCA Report - ' || dag_id
    || '/' || task_id || '</title>' || chr(10) || '<style>{render.HTML_STYLE}</style>' || chr(10) || '</head>' || chr(10)
    || '<body>' || chr(10) || '<h1>RCA Report</h1>' || chr(10) || '<p><strong>' || dag_id || '/' || task_id
    || '</strong></p>' || chr(10) || '<h2>Summary</h2>' || chr(10) || '<table class="summary-table">' || chr(10)
    || '<tr><th>Report ID</th><td><code>' || report_id || '</code></td></tr>' || chr(10)
    || '<tr><th>Failure Time</th><td>' || {UTC} || '</td></tr>' || chr(10)
    || '<tr><th>Category</th><td>' || error_category || '</td></tr>' || chr(10)
    || '<tr><th>Severity</th><td><span class="severity-' || severity || '">' || upper(severity) || '</span></td></tr>'
    || chr(10) || '<tr><th>Confidence</th><td>' || printf('%.0f', confidence * 100) || '%</td></tr>' || chr(10)
    || '</table>' || chr(10) || '<h2>Root Cause</h2>' || chr(10) || '<div class="root-cause"><p>'
    || {_esc('root_cause')} || '</p></div>'
    || if(len(evidence) = 0, '', chr(10) || '<h2>Evidence</h2>' || chr(10) || '<div class="evidence"><ul>'
          || array_to_string(list_transform(evidence, lambda e: '<li>' || {_esc('e')} || '</li>'), '') || '</ul></div>')
    || if(len(key_log_lines) = 0, '', chr(10) || '<h2>Key Log Lines</h2>' || chr(10) || '<div class="log-lines">'
          || array_to_string(list_transform(key_log_lines[1:10], lambda e: {_esc('e')} || '<br>'), chr(10)) || '</div>')
    || chr(10) || '<h2>Recommendations</h2>'
    || if(coalesce(immediate_action, '') = '', '', chr(10)
          || '<div class="immediate-action"><strong>Immediate Action:</strong> ' || immediate_action || '</div>')
    || chr(10) || '<div class="recommendation"><strong>1. ' || action || '</strong><ul><li>Priority: ' || priority
    || '/5</li></ul></div>' || chr(10) || '<hr>' || chr(10) || '<p>Generated at ' || {UTC} || ' | Model: '
    || coalesce(llm_model, 'N/A') || ' | Duration: N/Ams</p>' || chr(10) || '</body>' || chr(10) || '</html>'"""


@register("html", query(["rep"], f"SELECT report_id, {HTML} AS body FROM full_rep", [PRIORITY_CTE, WITH_PRIORITY]))
def _(spark, sf):
    return reports.export(report_rows(spark, sf), "html")


@register("json_report", query(["rep"], f"""
    SELECT report_id, error_category, CAST(confidence AS VARCHAR) AS confidence, root_cause,
           strftime(failure_time, '%Y-%m-%dT%H:%M:%S.%fZ') AS failure_time, CAST(priority AS VARCHAR) AS priority,
           similar_incidents[1].incident_id AS first_similar, CAST(len(similar_incidents) AS VARCHAR) AS recurrence_count,
           TRUE AS null_fields_kept FROM full_rep""", [PRIORITY_CTE, WITH_PRIORITY]))
def _(spark, sf):
    body = reports.export(report_rows(spark, sf), "json")
    field = lambda path: F.get_json_object("body", f"$.{path}")
    return body.select(
        "report_id", field("error_category").alias("error_category"), field("confidence").alias("confidence"),
        field("root_cause").alias("root_cause"), field("failure_time").alias("failure_time"),
        field("recommendations[0].priority").alias("priority"),
        field("similar_incidents[0].incident_id").alias("first_similar"),
        field("recurrence_count").alias("recurrence_count"),
        c("body").contains('"analysis_duration_ms":null').alias("null_fields_kept"))


@register("get_report", query(["rep"], f"""
    SELECT report_id, {MARKDOWN} AS body FROM full_rep WHERE report_id = (SELECT min(report_id) FROM rep)""",
    [PRIORITY_CTE, WITH_PRIORITY]))
def _(spark, sf):
    """The look-up of the first id."""
    # Read for the id and for the report.
    rows = settled(report_rows(spark, sf), "report-rows")
    first = rows.agg(F.min("report_id")).first()[0]
    return reports.get_report(rows, first, "markdown")


@register("incident_documents", query(["rep"], """
    SELECT report_id AS incident_id, 'DAG: ' || dag_id || chr(10) || 'Task: ' || task_id || chr(10) || 'Category: '
        || error_category || chr(10) || 'Root cause: ' || root_cause
        || if(len(evidence) = 0, '', chr(10) || 'Evidence: ' || array_to_string(evidence[1:3], '; '))
        || if(len(key_log_lines) = 0, '', chr(10) || 'Key logs: ' || array_to_string(key_log_lines[1:5], ' ')) AS text,
        '{"root_cause":' || to_json(root_cause) || ',"evidence":' || to_json(evidence) || ',"recommendations":[{"action":'
        || to_json(action) || ',"priority":' || priority || ',"estimated_effort":null,"automated":false}],"resolution":null}'
        AS document FROM full_rep""", [PRIORITY_CTE, WITH_PRIORITY]))
def _(spark, sf):
    rows = report_rows(spark, sf)
    return rows.select(
        c("report_id").alias("incident_id"), inc.incident_text(rows).alias("text"),
        inc.incident_document().alias("document"))


@register("custom_provider", query(["failures", "external_events"], """
    SELECT f.event_id, CAST(count(external_id) AS BIGINT) AS nearby FROM failures f LEFT JOIN external_events e
      ON e.dag_id = f.dag_id AND e.task_id = f.task_id
     AND event_time BETWEEN failed_at - INTERVAL 30 MINUTE AND failed_at + INTERVAL 5 MINUTE GROUP BY f.event_id"""))
def _(spark, sf):
    from faultline.operators.context import add_providers

    def nearby(rows: DataFrame) -> DataFrame:
        pairs = metric_ops.external_events_window(rows, v.external_events(spark, sf))
        return pairs.groupBy("failure_id").agg(F.count("*").alias("n"))

    rows = add_providers(plan.with_ids(failures(spark, sf)), {"monitoring": nearby})
    return rows.select("event_id", F.coalesce("monitoring.n", lit(0)).alias("nearby"))


@register("provider_failure", query(["ctx", "external_events"], """
    SELECT c.event_id, CAST(count(external_id) AS BIGINT) AS nearby, c.has_context,
           if(c.has_context, '', 'Airflow collection failed;Cannot build context: missing Airflow data;No context for LLM analysis;')
           || 'raises collection failed: no route to the service;fails_late collection failed' AS errors
    FROM ctx c LEFT JOIN external_events e ON e.dag_id = c.dag_id AND e.task_id = c.task_id
     AND event_time BETWEEN failed_at - INTERVAL 30 MINUTE AND failed_at + INTERVAL 5 MINUTE
    GROUP BY c.event_id, c.has_context"""))
def _(spark, sf):
    """One provider raises while it is planned, one in its tasks; the third one's rows and all contexts are there."""
    def nearby(rows: DataFrame) -> DataFrame:
        pairs = metric_ops.external_events_window(rows, v.external_events(spark, sf))
        return pairs.groupBy("failure_id").agg(F.count("*").alias("n"))

    def raises(rows: DataFrame) -> DataFrame:
        raise ConnectionError("no route to the service")

    def fails_late(rows: DataFrame) -> DataFrame:
        return rows.select("failure_id", F.when(c("failure_id").isNotNull(), F.raise_error(lit("bad answer"))).alias("answer"))

    providers = {"raises": raises, "monitoring": nearby, "fails_late": context.Declared(fails_late, "answer string")}
    found = contexts(spark, sf, providers=providers).where("raises IS NULL AND fails_late.answer IS NULL")
    # How Spark words a task's error is its own affair.
    texts = F.transform("errors", lambda e: F.regexp_replace(e, r"^(fails_late collection failed): .*$", "$1"))
    return found.select("event_id", F.coalesce("monitoring.n", lit(0)).alias("nearby"), "has_context",
                        v.joined(texts, ";").alias("errors"))


@register("verdict_hook", query(["ctx"], """
    SELECT failure_id AS report_id, CASE WHEN regexp_matches(snippet, 'Timeout') THEN 'volume_anomaly'
               ELSE coalesce(fams[1].category, 'unknown') END AS error_category FROM ctx WHERE has_context"""))
def _(spark, sf):
    """A stand-in for a model: it blames volume for every timeout in the log part and fails to answer otherwise."""
    def answer(prompts: DataFrame) -> DataFrame:
        log_part = F.regexp_extract("user_prompt", r"(?s)## Error Logs\n```\n(.*?)\n```\n\n## DAG History", 1)
        body = lit('{"error_category":"volume_anomaly","severity":"low","root_cause":"slow","root_cause_summary":"slow",'
                   '"confidence":1}')
        return prompts.select("failure_id", F.when(log_part.contains("Timeout"), body).otherwise("?").alias("raw"))

    rows = plan.triage(failures(spark, sf), tables(spark, sf), OPTIONS, verdict_fn=answer)
    return rows.select("report_id", "error_category")
