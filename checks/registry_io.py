"""Readers, writers and streams: written to the shared folder, read back, compared with the view itself."""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.ml import PipelineModel
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.sql import DataFrame, functions as F

from checks import views as v
from checks.registry import REGISTRY, categorised, register, rounded
from checks.registry_reports import CHAT, FILE_NAME, HTML, LETTERS, MARKDOWN, OPTIONS, PRIORITY_CTE, SUMMARY, WITH_PRIORITY
from checks.registry_reports import contexts, failures, letter_counts, report_rows, tables
from checks.registry import MESSAGE_CATEGORY
from checks.sql_views import query, ts
from faultline.functions import render
from faultline.operators import incidents as inc, reports
from faultline.plans import triage as plan
from faultline.session import mounted, settled, shared_dir
from faultline.sources import readers, sinks
from faultline.streaming import recurrence, streams

c, lit = F.col, F.lit
ISO = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"


def iso(name: str):
    return F.date_format(name, ISO).alias(name)


def as_json(spark, df: DataFrame, purpose: str) -> str:
    path = shared_dir(spark, purpose)
    df.write.json(path)
    return path


# --- readers ---------------------------------------------------------------------------------------------------------


def _payload_path(spark, sf) -> str:
    path = shared_dir(spark, "payloads")
    v.payloads(spark, sf).select("value").write.text(path)
    return path


@register("normalized_events", query(["failures"], f"""
    SELECT dag_id, task_id, run_id, {ts('failed_at')} AS execution_date, {ts('failed_at')} AS failed_at,
           CASE WHEN state = 'crashed' THEN 'failed' ELSE state END AS state, error_message, try_number
    FROM failures WHERE event_id % 10 > 2"""))
def _(spark, sf):
    good, _ = readers.read_failure_events(spark, _payload_path(spark, sf), arrived="arrived_at")
    return good.withColumn("execution_date", v.ts_text("execution_date")).withColumn(
        "failed_at", v.ts_text("failed_at"))


@register("quarantine", query(["failures"], """
    SELECT ['malformed JSON', 'missing field', 'bad execution_date'][event_id % 10 + 1] AS problem,
           CAST(count(*) AS BIGINT) AS n FROM failures WHERE event_id % 10 <= 2 GROUP BY 1"""))
def _(spark, sf):
    _, bad = readers.read_failure_events(spark, _payload_path(spark, sf), arrived="arrived_at")
    return bad.groupBy("problem").agg(F.count("*").alias("n"))


@register("wall_clock_events", query(["failures"], f"""
    SELECT run_id, {ts('failed_at + INTERVAL 2 HOUR')} AS wall_clock, {ts('failed_at')} AS converted FROM failures"""))
def _(spark, sf):
    """A local time with offset: kept as it reads, or converted."""
    local = F.concat(F.date_format(c("failed_at") + F.expr("INTERVAL 2 HOURS"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"),
                     lit("+02:00"))
    raw = v.failures(spark, sf).select(
        "dag_id", "task_id", "run_id", local.alias("execution_date"), "state", "try_number",
        c("error_message").alias("exception"))
    kept = readers.shape_failure_events(raw, wall_clock=True).select(
        "run_id", v.ts_text("execution_date").alias("wall_clock"))
    moved = readers.shape_failure_events(raw).select("run_id", v.ts_text("execution_date").alias("converted"))
    return kept.join(moved, "run_id")


@register("read_task_instances", query(["task_instances"], """
    SELECT dag_id, task_id, run_id, state, duration_seconds, try_number, CAST(max_tries AS INTEGER) AS max_tries, operator
    FROM task_instances"""))
def _(spark, sf):
    rows = v.task_instances(spark, sf).drop("duration_seconds")
    path = as_json(spark, rows.withColumn("start_date", iso("start_date")).withColumn("end_date", iso("end_date")),
                   "instances")
    return readers.read_task_instances(spark, path).select(
        "dag_id", "task_id", "run_id", "state", "duration_seconds", "try_number", "max_tries", "operator")


@register("read_dag_runs", query(["runs"], f"""
    SELECT dag_id, run_id, state, {ts('execution_date')} AS execution_date, floor(duration_seconds) AS duration_seconds
    FROM runs"""))
def _(spark, sf):
    end = c("execution_date") + F.make_dt_interval(secs=F.floor("duration_seconds"))
    rows = v.runs(spark, sf).select(
        "dag_id", "run_id", "state", iso("execution_date"), F.date_format("execution_date", ISO).alias("start_date"),
        F.date_format(end, ISO).alias("end_date"))
    return readers.read_dag_runs(spark, as_json(spark, rows, "runs")).withColumn(
        "execution_date", v.ts_text("execution_date"))


@register("read_commits", query(["commits"], f"""
    SELECT sha, short_sha, author, email, message, {ts('date')} AS date, array_to_string(files_changed, ',')
        AS files_changed, if(user_id % 2 = 0, 'even', '') AS repository FROM commits"""))
def _(spark, sf):
    raw = v.raw_commits(spark, sf).withColumn(
        "repository", F.when(F.regexp_extract("author", r"\d+", 0).cast("int") % 2 == 0, "even"))
    path = as_json(spark, raw.withColumn("date", iso("date")), "commits")
    return readers.read_commits(spark, path).withColumn("date", v.ts_text("date")).withColumn(
        "files_changed", v.joined("files_changed", ","))


@register("read_source_checks", query(["raw_checks"], f"""
    SELECT check_id, source_name, source_type, status_code, exception_kind, row_count, array_to_string(columns, ',')
        AS columns, {ts('last_checked')} AS last_checked FROM raw_checks"""))
def _(spark, sf):
    path = as_json(spark, v.raw_checks(spark, sf).withColumn("last_checked", iso("last_checked")), "checks")
    return readers.read_source_checks(spark, path).select(
        "check_id", "source_name", "source_type", "status_code", "exception_kind", "row_count",
        v.joined("columns", ",").alias("columns"), v.ts_text("last_checked").alias("last_checked"))


@register("read_metrics", query(["metrics"], f"""
    SELECT {ts('timestamp')} AS timestamp, cpu_percent, memory_percent, active_connections FROM metrics"""))
def _(spark, sf):
    path = shared_dir(spark, "metrics")
    v.metrics(spark, sf).write.parquet(path)
    return readers.read_metrics(spark, path).select(
        v.ts_text("timestamp").alias("timestamp"), "cpu_percent", "memory_percent", "active_connections")


@register("read_external_events", query(["external_events"], f"""
    SELECT external_id AS event_id, {ts('event_time')} AS event_time, dag_id, task_id, title FROM external_events"""))
def _(spark, sf):
    rows = v.external_events(spark, sf).select(
        c("external_id").alias("event_id"), F.date_format("event_time", ISO).alias("ts"), "dag_id", "task_id", "title")
    return readers.read_external_events(spark, as_json(spark, rows, "external")).withColumn(
        "event_time", v.ts_text("event_time"))


@register("read_responses", query(["replies"], """
    SELECT conv_id || '/' || turn AS failure_id, md5(raw) AS digest FROM replies"""))
def _(spark, sf):
    rows = v.replies(spark, sf).select(F.concat_ws("/", "conv_id", "turn").alias("failure_id"), "raw")
    return readers.read_responses(spark, as_json(spark, rows, "replies")).select(
        "failure_id", F.md5("raw").alias("digest"))


@register("read_incidents", query(["incidents"], """
    SELECT incident_id, error_category, severity, resolution, CAST(len(embedding) AS INTEGER) AS dims FROM incidents"""))
def _(spark, sf):
    path = shared_dir(spark, "incidents")
    sinks.write_by_day(v.incidents(spark, sf), path, "error")
    return readers.read_incidents(spark, path).select(
        "incident_id", "error_category", "severity", "resolution", F.size("embedding").alias("dims"))


def _write_files(rows: DataFrame, root: str) -> None:
    """One file per row (path, content) under a shared folder."""
    root = mounted(root)

    def save(part: Iterator) -> None:
        for row in part:
            target = os.path.join(root, row.path)
            os.makedirs(os.path.dirname(target), exist_ok=True)
            with open(target, "w", encoding="utf-8", newline="") as out:
                out.write(row.content)

    rows.select("path", "content").foreachPartition(save)


@register("read_task_logs", query(["plain_logs"], """
    SELECT 'dag_' || (user_id % 20) AS dag_id, 'task_' || (user_id % 7) AS task_id,
           'run_' || event_id || '__2024-01-15T00:00:00+00:00 50%' AS run_id,
           CAST(event_id % 3 + 1 AS INTEGER) AS try_number, md5(stdout) AS digest
    FROM plain_logs JOIN events ON event_id = doc_id"""))
def _(spark, sf):
    root = shared_dir(spark, "logs")
    path = F.concat(lit("dags/"), "dag_id", lit("/dagRuns/"), c("run_id"), lit("__2024-01-15T00:00:00+00:00 50%/taskInstances/"),
                    "task_id", lit("/logs/"), c("try_number").cast("string"))
    _write_files(v.task_logs(spark, sf).select(path.alias("path"), c("stdout").alias("content")), root)
    return readers.read_task_logs(spark, root).withColumn("digest", F.md5("stdout")).drop("stdout")


@register("read_log_lines", query(["plain_logs"], """
    SELECT 'dag_' || (user_id % 20) AS dag_id, 'task_' || (user_id % 7) AS task_id, 'run_' || event_id AS run_id,
           CAST(event_id % 3 + 1 AS INTEGER) AS try_number, unnest(string_split(stdout, chr(10))) AS line,
           CAST(generate_subscripts(string_split(stdout, chr(10)), 1) - 1 AS BIGINT) AS line_no
    FROM plain_logs JOIN events ON event_id = doc_id"""))
def _(spark, sf):
    root = shared_dir(spark, "logs")
    path = F.concat(lit("dags/"), "dag_id", lit("/dagRuns/"), c("run_id"), lit("/taskInstances/"), "task_id", lit("/logs/"),
                    c("try_number").cast("string"))
    _write_files(v.task_logs(spark, sf).select(path.alias("path"), c("stdout").alias("content")), root)
    return readers.read_log_lines(spark, root)


@register("read_dag_files", query(["dag_files"], "SELECT path, md5(content) AS digest FROM dag_files"))
def _(spark, sf):
    root = shared_dir(spark, "dagfiles") + "/dags"
    _write_files(v.dag_files(spark, sf), root)
    return readers.read_dag_files(spark, root).select("path", F.md5("content").alias("digest"))


# --- writers ---------------------------------------------------------------------------------------------------------


@register("write_reports", query(["rep"], f"""
    SELECT report_id, {FILE_NAME} AS file_name, md5({MARKDOWN}) AS digest,
           strftime(failure_time, '%Y-%m-%d') AS failure_date FROM full_rep""", [PRIORITY_CTE, WITH_PRIORITY]))
def _(spark, sf):
    path = shared_dir(spark, "reports")
    sinks.write_reports(report_rows(spark, sf), path)
    return spark.read.parquet(path).select(
        "report_id", "file_name", F.md5("body").alias("digest"), c("failure_date").cast("string").alias("failure_date"))


@register("write_report_files", query(["rep"], f"""
    SELECT {FILE_NAME} AS file_name, md5({MARKDOWN}) AS digest FROM full_rep""", [PRIORITY_CTE, WITH_PRIORITY]))
def _(spark, sf):
    path = shared_dir(spark, "files")
    sinks.write_report_files(report_rows(spark, sf), path)
    files = spark.read.text(path, wholetext=True)
    return files.select(
        F.substring_index(c("_metadata.file_path"), "/", -1).alias("file_name"), F.md5("value").alias("digest"))


@register("write_notifications", query(["rep"], f"""
    SELECT {CHAT} || ',"channel":"#alerts"}}' AS payload FROM rep"""))
def _(spark, sf):
    path = shared_dir(spark, "notifications")
    sinks.write_notifications(report_rows(spark, sf), path, "#alerts")
    return spark.read.text(path).select(c("value").alias("payload"))


@register("write_prompts", REGISTRY["prompts"][1])
def _(spark, sf):
    path = shared_dir(spark, "prompts")
    sinks.write_prompts(contexts(spark, sf, complete_only=True), path)
    return spark.read.parquet(path).where(F.length("system_prompt") > 0).select("failure_id", "user_prompt")


APPENDED = """
    SELECT incident_id, error_category, root_cause_summary FROM incidents
    UNION ALL SELECT report_id, error_category, root_cause_summary FROM rep"""


INCIDENT_TEXT = """'DAG: ' || dag_id || chr(10) || 'Task: ' || task_id || chr(10) || 'Category: '
        || error_category || chr(10) || 'Root cause: ' || root_cause
        || if(len(evidence) = 0, '', chr(10) || 'Evidence: ' || array_to_string(evidence[1:3], '; '))
        || if(len(key_log_lines) = 0, '', chr(10) || 'Key logs: ' || array_to_string(key_log_lines[1:5], ' '))"""


def letter_model(letters: str = LETTERS) -> PipelineModel:
    """The letter counts as a model that can be stored."""
    counts = ", ".join(
        f"CAST(char_length(text) - char_length(replace(text, '{x}', '')) AS DOUBLE) AS _{i}" for i, x in enumerate(letters))
    return PipelineModel([
        SQLTransformer(statement=f"SELECT *, {counts} FROM __THIS__"),
        VectorAssembler(inputCols=[f"_{i}" for i in range(len(letters))], outputCol="_unit")])


def _vector_text(frame: DataFrame) -> DataFrame:
    return frame.withColumn("vector", v.joined(F.transform("embedding", lambda x: x.cast("int").cast("string")), ","))


@register("append_incidents", query(["rep", "incidents"], f"""
    SELECT incident_id, error_category, root_cause_summary, NULL AS vector FROM incidents UNION ALL
    SELECT report_id, error_category, root_cause_summary,
           array_to_string(list_transform({letter_counts("text")}, lambda x: CAST(CAST(x AS INTEGER) AS VARCHAR)), ',')
    FROM (SELECT *, {INCIDENT_TEXT} AS text FROM rep)"""))
def _(spark, sf):
    """Appending the same reports twice stores each once, with the vector of its text."""
    path = shared_dir(spark, "history")
    sinks.create_incidents(spark, path, letter_model())
    sinks.write_by_day(v.incidents(spark, sf).drop("embedding"), path, "append")
    rows = shared_dir(spark, "history-reports")
    report_rows(spark, sf).write.parquet(rows)
    for _ in range(2):
        sinks.append_incidents(spark, spark.read.parquet(rows), path)
    return _vector_text(readers.read_incidents(spark, path)).select("incident_id", "error_category", "root_cause_summary", "vector")


@register("refresh_vectors", query(["rep"], f"""
    SELECT report_id AS incident_id, 2 AS versions,
           array_to_string(list_transform({letter_counts("text", "xyz")}, lambda x: CAST(CAST(x AS INTEGER) AS VARCHAR)), ',') AS vector
    FROM (SELECT *, {INCIDENT_TEXT} AS text FROM rep)"""))
def _(spark, sf):
    """A history whose vectors come from another model than its first one."""
    old, new = shared_dir(spark, "history-old"), shared_dir(spark, "history-new")
    first, second = letter_model(), letter_model("xyz")
    sinks.create_incidents(spark, old, first)
    sinks.append_incidents(spark, report_rows(spark, sf), old)
    sinks.refresh_vectors(spark, old, new, second)
    rows = _vector_text(readers.read_incidents(spark, new))
    versions = rows.select("vector_version").union(readers.read_incidents(spark, old).select("vector_version")).agg(
        F.count_distinct("vector_version").cast("int")).scalar()
    return rows.select("incident_id", versions.alias("versions"), "vector")


@register("append_incidents_frame", query(["rep", "incidents"], APPENDED))
def _(spark, sf):
    records = inc.incident_records(report_rows(spark, sf))
    twice = records.unionByName(records)
    return inc.append_incidents(v.incidents(spark, sf), twice).select(
        "incident_id", "error_category", "root_cause_summary")


@register("upsert_resolutions", query(["incidents", "latest"], """
    SELECT i.incident_id, coalesce(l.resolution, i.resolution) AS resolution, l.resolution IS NOT NULL AS is_new
    FROM incidents i LEFT JOIN latest l USING (incident_id)"""))
def _(spark, sf):
    """In place, the same updates twice."""
    path = shared_dir(spark, "upserted")
    sinks.write_by_day(v.incidents(spark, sf), path, "error")
    for _ in range(2):
        sinks.upsert_resolutions(spark, path, v.resolutions(spark, sf))
    rows = inc.read_back(readers.read_incidents(spark, path))
    return rows.select("incident_id", "resolution", c("resolution").startswith("fix ").alias("is_new")).withColumn(
        "is_new", F.coalesce("is_new", lit(False)))


@register("write_resolved_version", query(["incidents", "latest"], """
    SELECT i.incident_id, coalesce(l.resolution, i.resolution) AS resolution
    FROM incidents i LEFT JOIN latest l USING (incident_id)"""))
def _(spark, sf):
    path = shared_dir(spark, "resolved")
    rows = inc.apply_resolutions(v.incidents(spark, sf), v.resolutions(spark, sf)).drop("resolution_updated")
    sinks.write_incident_version(rows, path)
    return inc.read_back(readers.read_incidents(spark, path)).select("incident_id", "resolution")


@register("export_formats", query(["rep"], f"""
    SELECT report_id, 'markdown' AS format, md5({MARKDOWN}) AS digest FROM full_rep
    UNION ALL SELECT report_id, 'html', md5({HTML}) FROM full_rep""", [PRIORITY_CTE, WITH_PRIORITY]))
def _(spark, sf):
    path = shared_dir(spark, "export")
    # Read once for each format.
    rows = settled(report_rows(spark, sf), "report-rows")
    for fmt in ("markdown", "html"):
        reports.export(rows, fmt).withColumn("format", lit(fmt)).write.mode("append").parquet(path)
    return spark.read.parquet(path).select("report_id", "format", F.md5("body").alias("digest"))


# --- streams ---------------------------------------------------------------------------------------------------------


def _drain(spark, df: DataFrame, purpose: str) -> DataFrame:
    path = shared_dir(spark, purpose)
    streams.run_once(df, path, shared_dir(spark, f"{purpose}-checkpoint"))
    return spark.read.schema(df.schema).parquet(path)


def _event_path(spark, rows: DataFrame, purpose: str) -> str:
    return as_json(spark, rows.withColumn("failed_at", iso("failed_at")), purpose)


def attempts(spark, sf) -> DataFrame:
    """Every attempt calls back, a minute after the one before."""
    tries = F.explode(F.sequence(lit(1), c("try_number")))
    return v.failures(spark, sf).withColumn("attempt", tries).select(
        "event_id", "dag_id", "task_id", "run_id", "state", c("attempt").alias("try_number"), "error_message",
        (c("failed_at") + F.make_dt_interval(mins=c("attempt") - 1)).alias("failed_at"))


@register("stream_failures", query(["failures"], """
    SELECT event_id, dag_id, CASE WHEN state = 'crashed' THEN 'failed' ELSE state END AS state FROM failures"""))
def _(spark, sf):
    source = streams.stream_failures(spark, _event_path(spark, v.failures(spark, sf), "events"))
    return _drain(spark, source.select("event_id", "dag_id", "state"), "stream-failures")


@register("stream_quarantine", query(["failures"], """
    SELECT coalesce(['malformed JSON', 'missing field', 'bad execution_date'][event_id % 10 + 1], '') AS problem,
           CAST(count(*) AS BIGINT) AS n, CAST(count(error_message) FILTER (event_id % 10 > 2) AS BIGINT) AS n_messages
    FROM failures GROUP BY 1"""))
def _(spark, sf):
    """Callback payloads as a stream: good rows and quarantined ones in two sinks, nothing lost."""
    good, bad = streams.stream_callbacks(spark, _payload_path(spark, sf), arrived="arrived_at")
    rows = _drain(spark, good, "stream-good").withColumn("problem", lit("")).unionByName(
        _drain(spark, bad, "stream-bad"))
    message = F.when(c("problem") == "", c("error_message"))
    return rows.groupBy("problem").agg(F.count("*").alias("n"), F.count(message).alias("n_messages"))


@register("stream_dedupe", query(["failures"], """
    SELECT dag_id, task_id, run_id FROM failures"""))
def _(spark, sf):
    source = streams.stream_failures(spark, _event_path(spark, attempts(spark, sf), "attempts"))
    return _drain(spark, streams.dedupe_attempts(source).select("dag_id", "task_id", "run_id"), "stream-dedupe")


@register("stream_failure_rate", query(["runs"], f"""
    SELECT dag_id, {ts('window_end')} AS window_end, CAST(count(*) AS BIGINT) AS total_runs,
           CAST(count(*) FILTER (state = 'failed') AS BIGINT) AS failed_runs,
           round(count(*) FILTER (state = 'failed') / count(*), 6) AS failure_rate
    FROM (SELECT *, unnest(generate_series(date_trunc('day', execution_date) + INTERVAL 1 DAY,
                                           date_trunc('day', execution_date) + INTERVAL 7 DAY, INTERVAL 1 DAY)) AS window_end
          FROM runs)
    WHERE window_end <= (SELECT max(execution_date) FROM runs) - INTERVAL 1 HOUR GROUP BY dag_id, window_end"""))
def _(spark, sf):
    path = as_json(spark, v.runs(spark, sf).withColumn("execution_date", iso("execution_date")), "run-events")
    schema = "dag_id string, run_id string, state string, execution_date timestamp, duration_seconds double"
    source = spark.readStream.schema(schema).json(path)
    return _drain(spark, streams.failure_rate_windows(source), "stream-rate").select(
        "dag_id", v.ts_text("window_end").alias("window_end"), "total_runs", "failed_runs", rounded("failure_rate"))


@register("stream_sessions", query(["failures"], f"""
    SELECT dag_id, task_id, {ts('min(failed_at)')} AS session_start, CAST(count(*) AS BIGINT) AS attempts FROM (
        SELECT *, sum(fresh) OVER (PARTITION BY dag_id, task_id ORDER BY failed_at, event_id, try_no) AS s FROM (
            SELECT *, CASE WHEN failed_at - lag(failed_at) OVER (PARTITION BY dag_id, task_id
                                ORDER BY failed_at, event_id, try_no) < INTERVAL 10 MINUTE THEN 0 ELSE 1 END AS fresh
            FROM (SELECT event_id, dag_id, task_id, t AS try_no, failed_at + to_minutes(CAST(t - 1 AS BIGINT)) AS failed_at
                  FROM (SELECT *, unnest(range(1, try_number + 1)) AS t FROM failures))))
    GROUP BY dag_id, task_id, s HAVING max(failed_at) + INTERVAL 10 MINUTE <= (
        SELECT max(failed_at + to_minutes(CAST(try_number - 1 AS BIGINT))) FROM failures) - INTERVAL 1 HOUR"""))
def _(spark, sf):
    source = streams.stream_failures(spark, _event_path(spark, attempts(spark, sf), "session-events"))
    return _drain(spark, streams.retry_sessions(source), "stream-sessions").select(
        "dag_id", "task_id", v.ts_text("session_start").alias("session_start"), "attempts")


@register("stream_recurrence", query(["failures"], f"""
    SELECT dag_id, task_id, error_category, {ts('as_of')} AS as_of, CAST(count(*) AS BIGINT) AS failures
    FROM (SELECT *, unnest(generate_series(date_trunc('day', failed_at) + INTERVAL 1 DAY,
                                           date_trunc('day', failed_at) + INTERVAL 30 DAY, INTERVAL 1 DAY)) AS as_of
          FROM categorised)
    WHERE as_of <= (SELECT max(failed_at) FROM failures) - INTERVAL 1 HOUR
    GROUP BY dag_id, task_id, error_category, as_of""", MESSAGE_CATEGORY))
def _(spark, sf):
    source = streams.stream_failures(spark, _event_path(spark, categorised(spark, sf), "recurrence-events"))
    return _drain(spark, streams.recurrence_windows(source), "stream-recurrence").withColumn(
        "as_of", v.ts_text("as_of"))


@register("stream_recurrence_state", query(["failures"], """
    SELECT event_id, recurrence_30d FROM (
        SELECT event_id, failed_at, CAST(count(*) OVER (PARTITION BY dag_id, task_id, error_category ORDER BY failed_at
            RANGE BETWEEN INTERVAL 30 DAY PRECEDING AND INTERVAL '0.000001 seconds' PRECEDING) AS BIGINT) AS recurrence_30d
        FROM categorised)
    WHERE failed_at < date_trunc('millisecond', (SELECT max(failed_at) FROM failures)) - INTERVAL 1 HOUR""", MESSAGE_CATEGORY))
def _(spark, sf):
    """The state of each failure's key, event by event, for all that the watermark has passed."""
    source = streams.stream_failures(spark, _event_path(spark, categorised(spark, sf), "recurrence-state-events"))
    path = shared_dir(spark, "recurrence-state")
    partials = recurrence.recurrence_partials(source, spread=2)
    recurrence.run_recurrence(partials, path, shared_dir(spark, "recurrence-state-checkpoint")).awaitTermination()
    counts = recurrence.recurrence_counts(spark.read.schema(partials.schema).parquet(path), spread=2)
    return counts.select(c("event_key").cast("long").alias("event_id"), "recurrence_30d")


def _stream_triage(spark, sf) -> tuple[str, str]:
    """Paths of the reports and of the incident history after the stream has run twice over the same input."""
    static = tables(spark, sf)
    source = _event_path(spark, failures(spark, sf), "triage-events")
    schema = streams.STREAM_SCHEMA + ", dag_file_path string"
    out, history, checkpoint = (shared_dir(spark, f"triage-{part}") for part in ("out", "history", "checkpoint"))
    sinks.create_incidents(spark, history)
    for _ in range(2):
        streams.stream_triage(
            streams.stream_failures(spark, source, schema), lambda batch: plan.triage(batch, static, OPTIONS),
            out, checkpoint, history).awaitTermination()
    return out, history


@register("stream_triage", query(["rep"], f"SELECT report_id, error_category, {SUMMARY} AS summary FROM rep"))
def _(spark, sf):
    out, _ = _stream_triage(spark, sf)
    return spark.read.parquet(out).select("report_id", "error_category", render.summary().alias("summary"))


@register("stream_incident_append", query(["rep"], "SELECT report_id AS incident_id, root_cause_summary FROM rep"))
def _(spark, sf):
    _, history = _stream_triage(spark, sf)
    return readers.read_incidents(spark, history).select("incident_id", "root_cause_summary")
