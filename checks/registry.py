"""Query name -> (DataFrame builder, SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from checks import views as v
from checks.sql_views import catalogue_rows, matches_cte, query, strip, ts
from faultline.functions.signatures import CATALOGUE, Signature, signature_catalog
from faultline.functions.text import strip as strip_text
from faultline.operators import (
    commits as commit_ops, health, history, incidents as inc, logs, metrics as metric_ops, signature_index, sketches,
    verdicts,
)
from faultline.plans import triage as plan
from faultline.session import shared_dir

Builder = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[Builder, str | None]] = {}
c, lit = F.col, F.lit


def register(name: str, sql: str | None):
    def keep(fn: Builder) -> Builder:
        REGISTRY[name] = (fn, sql)
        return fn

    return keep


def rounded(name: str, digits: int = 6) -> Column:
    return F.round(name, digits).alias(name)


# --- logs ------------------------------------------------------------------------------------------------------------


@register("signature_catalog", query([], f"""
    SELECT CAST(sig_idx AS INTEGER) AS sig_idx, CAST(rx_idx AS INTEGER) AS rx_idx, name, category, severity, regex,
           CAST(count(doc_id) AS BIGINT) AS n_logs
    FROM ({catalogue_rows(CATALOGUE)}) LEFT JOIN documents ON regexp_matches(text, regex, 'i') GROUP BY ALL"""))
def _(spark, sf):
    """How many raw texts each regex of the catalogue hits (the prose holds none)."""
    docs = v.table(spark, sf, "documents").select("doc_id", c("text").alias("stdout"))
    rows = logs.explode_lines(docs, ["doc_id"], stripped=False)
    hits = logs.line_matches(rows, ["doc_id"]).select("sig_idx", "rx_idx", "doc_id").distinct()
    counted = hits.groupBy("sig_idx", "rx_idx").agg(F.count("*").alias("n_logs"))
    table = signature_catalog(spark).drop("description", "recommendation")
    return table.join(counted, ["sig_idx", "rx_idx"], "left").fillna({"n_logs": 0})


@register("match_signatures", query(["plain_logs"], """
    SELECT k AS doc_id, CAST(row_number() OVER (PARTITION BY k ORDER BY rk) - 1 AS INTEGER) AS position,
           CAST(sig_idx AS INTEGER) AS sig_idx, name, category, severity, CAST(len(matches) AS INTEGER) AS n_matches,
           array_to_string(matches, '|') AS matches FROM fam""",
    matches_cte("plain_logs", "doc_id", "stdout", CATALOGUE)))
def _(spark, sf):
    rows = logs.match_signatures(v.plain_logs(spark, sf), ["doc_id"])
    return rows.select(
        "doc_id", "position", "sig_idx", "name", "category", "severity", "n_matches", v.joined("matches").alias("matches")
    )


@register("signature_frequency", query(["plain_logs"], """
    SELECT name, category, severity, CAST(count(*) AS BIGINT) AS n_logs,
           CAST(sum(len(matches)) AS BIGINT) AS n_matches, CAST(count(DISTINCT source) AS BIGINT) AS n_sources
    FROM fam JOIN plain_logs ON k = doc_id GROUP BY ALL""",
    matches_cte("plain_logs", "doc_id", "stdout", CATALOGUE)))
def _(spark, sf):
    return logs.signature_frequency(v.plain_logs(spark, sf), "source").select(
        "name", "category", "severity", "n_logs", "n_matches", c("n_groups").alias("n_sources")
    )


@register("primary_error", query(["plain_logs"], """
    SELECT doc_id, name, category, severity, CAST(len(matches) AS INTEGER) AS n_matches
    FROM plain_logs LEFT JOIN prim ON k = doc_id""", matches_cte("plain_logs", "doc_id", "stdout", CATALOGUE)))
def _(spark, sf):
    rows = logs.primary_error(v.plain_logs(spark, sf), ["doc_id"])
    return rows.select("doc_id", "primary.name", "primary.category", "primary.severity",
                       F.when(c("primary").isNotNull(), F.size("primary.matches")).alias("n_matches"))


FALLBACK_SQL = query(["plain_logs"], """
    SELECT doc_id, coalesce(category, 'unknown') AS error_category, coalesce(severity, 'medium') AS severity,
           coalesce(description, 'Unable to determine root cause from available information') AS root_cause,
           coalesce(description, 'Unknown error - manual investigation required') AS root_cause_summary,
           CASE WHEN k IS NULL THEN 0.2::DOUBLE ELSE 0.6::DOUBLE END AS confidence,
           coalesce(array_to_string(list_transform(matches[1:3], lambda m: 'Pattern match: ' || m), '|'), '') AS evidence,
           coalesce(recommendation, 'Review full logs manually') AS action
    FROM plain_logs LEFT JOIN prim ON k = doc_id""", matches_cte("plain_logs", "doc_id", "stdout", CATALOGUE))


@register("fallback_verdict", FALLBACK_SQL)
def fallback_verdict(spark, sf):
    rows = plan.classify_logs(v.plain_logs(spark, sf))
    return rows.select(
        "doc_id", "error_category", "severity", "root_cause", "root_cause_summary", "confidence",
        v.joined("evidence").alias("evidence"), c("recommendations")[0]["action"].alias("action"),
    )


@register("key_lines", query(["plain_logs", "key_lines"], """
    SELECT doc_id, coalesce(array_to_string(key_log_lines, chr(10)), '') AS key_log_lines
    FROM plain_logs LEFT JOIN key_lines USING (doc_id)"""))
def _(spark, sf):
    rows = logs.match_logs(v.plain_logs(spark, sf))
    return rows.select("doc_id", v.joined("key_log_lines", "\n").alias("key_log_lines"))


@register("error_snippet", query(["snippets"], "SELECT doc_id, snippet FROM snippets"))
def _(spark, sf):
    return v.plain_logs(spark, sf).select("doc_id", logs.error_snippet(c("stdout")).alias("snippet"))


@register("log_profile", query(["snippets"], """
    SELECT doc_id, CAST(log_lines AS INTEGER) AS log_lines, truncated,
           CAST(length(snippet) AS INTEGER) AS snippet_chars FROM snippets"""))
def _(spark, sf):
    rows = logs.profile_logs(v.plain_logs(spark, sf))
    return rows.select("doc_id", "log_lines", "truncated", F.length("error_snippet").alias("snippet_chars"))


@register("log_tails", query(["plain_logs"], "SELECT doc_id, right(stdout, 2000) AS tail FROM plain_logs"))
def _(spark, sf):
    return v.plain_logs(spark, sf).select("doc_id", logs.tail_chars(c("stdout")).alias("tail"))


@register("explode_lines", query(["stripped"], f"""
    SELECT doc_id, CAST(i - 1 AS INTEGER) AS line_no, lines[i] AS line,
           regexp_matches(lower(lines[i]), '{"|".join(logs.ERROR_KEYWORDS)}') AS has_keyword
    FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM stripped)"""))
def _(spark, sf):
    rows = logs.explode_lines(v.plain_logs(spark, sf), ["doc_id"])
    return rows.withColumn("has_keyword", logs.has_error_keyword(c("line")))


@register("line_matches", query(["log_lines"], """
    SELECT k AS doc_id, name, CAST(count(*) AS BIGINT) AS n_matches, CAST(count(DISTINCT line_no) AS BIGINT) AS n_lines
    FROM (SELECT doc_id AS k, line_no, name, unnest(regexp_extract_all(line, regex, 0, 'i')) AS m
          FROM log_lines, cat) GROUP BY ALL""", [("cat", catalogue_rows(CATALOGUE))]))
def _(spark, sf):
    rows = logs.line_matches(v.log_lines(spark, sf), ["doc_id"])
    per_line = rows.groupBy("doc_id", "name", "line_no").agg(F.count("*").alias("n"))
    return per_line.groupBy("doc_id", "name").agg(F.sum("n").alias("n_matches"), F.count("*").alias("n_lines"))


@register("line_key_lines", query(["key_lines"], """
    SELECT doc_id, CAST(i AS INTEGER) AS rank, key_log_lines[i] AS line
    FROM (SELECT *, unnest(range(1, len(key_log_lines) + 1)) AS i FROM key_lines)"""))
def _(spark, sf):
    return logs.line_key_lines(v.log_lines(spark, sf), ["doc_id"]).select("doc_id", "rank", "line")


@register("line_snippet", query(["plain_logs", "snippets"], """
    SELECT doc_id, CAST(len(string_split(snippet, chr(10))) AS BIGINT) AS n_lines, md5(snippet) AS digest
    FROM snippets"""))
def _(spark, sf):
    stripped = v.plain_logs(spark, sf).withColumn("stdout", strip_text(c("stdout")))
    lines = logs.explode_lines(stripped, ["doc_id"], stripped=False)
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"])
    return logs.line_snippet(lines, ["doc_id"]).groupBy("doc_id").agg(
        F.count("*").alias("n_lines"), F.md5(F.array_join(ordered, "\n")).alias("digest")
    )


@register("custom_signatures", query([], r"""
    SELECT doc_id, name, CAST(len(m) AS INTEGER) AS n_matches, array_to_string(m, '|') AS matches FROM (
        SELECT doc_id, 'numbers' AS name, regexp_extract_all(text, '[0-9]+', 0) AS m FROM documents UNION ALL
        SELECT doc_id, 'fr_marks', regexp_extract_all(text, 'ê[a-z]+', 0, 'i') FROM documents UNION ALL
        SELECT doc_id, 'articles', list_concat(regexp_extract_all(text, '\bthe ([a-z]+)\b', 1, 'i'),
                                               regexp_extract_all(text, 'und[a-z]*', 0, 'i')) FROM documents)
    WHERE len(m) > 0"""))
def _(spark, sf):
    custom = [
        Signature("numbers", "volume_anomaly", "high", ("[0-9]+",), "digits", "count"),
        Signature("fr_marks", "data_quality", "low", ("ê[a-z]+",), "accents", "decode"),
        Signature("articles", "configuration_error", "critical", (r"\bthe ([a-z]+)\b", "und[a-z]*"), "words", "read"),
    ]
    docs = v.documents(spark, sf).select("doc_id", c("text").alias("stdout"))
    rows = logs.match_signatures(docs, ["doc_id"], custom=custom)
    return rows.select("doc_id", "name", "n_matches", v.joined("matches").alias("matches"))


# A word matches as often as it can be taken out of a line; a prefix and everything up to the last e at most once.
@register("custom_signatures_large", """
    WITH words AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[a-z]{6,}', 0)) AS word FROM documents),
    named AS (SELECT word, row_number() OVER (ORDER BY md5(word), word) - 1 AS sig_idx FROM words QUALIFY sig_idx < 5000),
    lines AS (SELECT doc_id, unnest(string_split(lower(text), chr(10))) AS line FROM documents),
    hits AS (
        SELECT doc_id, sig_idx, word, (length(line) - length(replace(line, word, ''))) // length(word) AS n
        FROM lines JOIN named ON contains(line, word)
        UNION ALL
        SELECT doc_id, sig_idx, word, CAST(contains(substr(line, strpos(line, substr(word, 1, 5)) + 5), 'e') AS BIGINT) AS n
        FROM lines JOIN named ON contains(line, substr(word, 1, 5)))
    SELECT sig_idx, word AS name, count(DISTINCT doc_id) AS n_logs, CAST(sum(n) AS BIGINT) AS n_matches FROM hits
    WHERE n > 0 GROUP BY sig_idx, word""")
def _(spark, sf):
    """A catalogue of 10,000 regexes, made of words of the documents, over all their lines."""
    docs = v.documents(spark, sf)
    words = docs.select(F.explode(F.regexp_extract_all("text", lit("[a-z]{6,}"), lit(0))).alias("word")).distinct()
    named = words.orderBy(F.md5("word"), "word").limit(5000).withColumn(
        "sig_idx", F.row_number().over(Window.orderBy(F.md5("word"), "word")) - 1)
    rules = named.select("sig_idx", c("word").alias("name"), lit("unknown").alias("category"), lit("low").alias("severity"),
                         F.posexplode(F.array(c("word"), F.concat(F.substring("word", 1, 5), lit(".*E")))).alias("rx_idx", "regex"))
    lines = logs.explode_lines(docs, ["doc_id"], "text", stripped=False)
    index = signature_index.build_signature_index(rules)
    found = signature_index.indexed_matches(lines, ["doc_id"], index).groupBy("sig_idx", "name", "doc_id").agg(F.count("*").alias("n"))
    return found.groupBy("sig_idx", "name").agg(F.count("*").alias("n_logs"), F.sum("n").alias("n_matches")).withColumn(
        "sig_idx", c("sig_idx").cast("long"))


@register("display_caps", query(["plain_logs"], """
    SELECT k AS doc_id, string_agg('- **' || name || '** (' || category || ', ' || severity || '): ' || description
        || chr(10) || '  Matches: ' || array_to_string(matches[1:3], ', ') || chr(10) || '  Recommendation: '
        || recommendation, chr(10) ORDER BY rk) AS section
    FROM (SELECT * FROM fam QUALIFY row_number() OVER (PARTITION BY k ORDER BY rk) <= 5) GROUP BY k
    UNION ALL SELECT doc_id, 'No known error patterns detected.' FROM plain_logs
    WHERE doc_id NOT IN (SELECT k FROM fam)""", matches_cte("plain_logs", "doc_id", "stdout", CATALOGUE)))
def _(spark, sf):
    from faultline.functions.render import pattern_section

    rows = logs.match_logs(v.plain_logs(spark, sf), with_key_lines=False)
    return rows.select("doc_id", pattern_section(c("matches")).alias("section"))


# --- history ---------------------------------------------------------------------------------------------------------


def _history_sql(view: str) -> str:
    return query([view], f"""
        SELECT dag_id, {ts("max(execution_date) FILTER (state = 'success')")} AS last_success,
               {ts("max(execution_date) FILTER (state = 'failed')")} AS last_failure,
               round(avg(duration_seconds) FILTER (state = 'success' AND duration_seconds <> 0), 6) AS avg_duration_seconds,
               round(CASE WHEN count(*) FILTER (recent) > 0 THEN count(*) FILTER (recent AND state = 'failed')
                     / count(*) FILTER (recent) ELSE 0 END, 6) AS failure_rate_7d,
               CAST(count(*) FILTER (recent) AS INTEGER) AS total_runs_7d
        FROM (SELECT *, execution_date > (SELECT max(execution_date) FROM {view}) - INTERVAL 7 DAY AS recent
              FROM {view} QUALIFY row_number() OVER (PARTITION BY dag_id ORDER BY execution_date DESC, run_id DESC) <= 20)
        GROUP BY dag_id""")


def _history(runs: DataFrame) -> DataFrame:
    return history.dag_history(runs).select(
        "dag_id", v.ts_text("last_success").alias("last_success"), v.ts_text("last_failure").alias("last_failure"),
        rounded("avg_duration_seconds"), rounded("failure_rate_7d"), "total_runs_7d",
    )


register("dag_history", _history_sql("runs"))(lambda spark, sf: _history(v.runs(spark, sf)))
register("dag_history_star", _history_sql("runs_star"))(lambda spark, sf: _history(v.runs_star(spark, sf)))


@register("recent_runs", query(["runs_star"], f"""
    SELECT dag_id, string_agg(state || '@' || {ts('execution_date')} || '/' || CAST(floor(duration_seconds) AS BIGINT),
                              '|' ORDER BY execution_date DESC, run_id DESC) AS recent_runs
    FROM (SELECT * FROM runs_star
          QUALIFY row_number() OVER (PARTITION BY dag_id ORDER BY execution_date DESC, run_id DESC) <= 20)
    GROUP BY dag_id"""))
def _(spark, sf):
    text = F.transform("recent_runs", lambda r: F.concat(
        r["state"], lit("@"), v.ts_text(r["execution_date"]), lit("/"),
        F.floor(r["duration_seconds"]).cast("string")))
    return history.recent_runs(v.runs_star(spark, sf)).select("dag_id", v.joined(text).alias("recent_runs"))


@register("rolling_failure_rate_7d", query(["runs"], """
    SELECT dag_id, run_id, CAST(count(*) OVER w AS BIGINT) AS total_runs_7d,
           CAST(count(*) FILTER (state = 'failed') OVER w AS BIGINT) AS failed_runs_7d,
           round(count(*) FILTER (state = 'failed') OVER w / count(*) OVER w, 6) AS failure_rate_7d
    FROM runs WINDOW w AS (PARTITION BY dag_id ORDER BY execution_date
        RANGE BETWEEN INTERVAL '6 days 23 hours 59 minutes 59.999999 seconds' PRECEDING AND CURRENT ROW)"""))
def _(spark, sf):
    return history.rolling_failure_rate(v.runs(spark, sf)).select(
        "dag_id", "run_id", "total_runs_7d", "failed_runs_7d", rounded("failure_rate_7d")
    )


@register("previous_failure", query(["runs"], f"""
    SELECT dag_id, run_id, {ts('''max(CASE WHEN state = 'failed' THEN execution_date END) OVER (
        PARTITION BY dag_id ORDER BY execution_date, run_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)''')}
        AS previous_failure FROM runs"""))
def _(spark, sf):
    return history.previous_failure(v.runs(spark, sf)).select(
        "dag_id", "run_id", v.ts_text("previous_failure").alias("previous_failure")
    )


# --- commits ---------------------------------------------------------------------------------------------------------


@register("recent_commits", query(["failures", "commits"], """
    SELECT f.event_id, CAST(row_number() OVER (PARTITION BY f.event_id ORDER BY date DESC, sha DESC) AS INTEGER) AS rank,
           short_sha, message, author
    FROM failures f JOIN commits ON date <= failed_at AND date >= failed_at - INTERVAL 24 HOUR
    QUALIFY rank <= 20"""))
def _(spark, sf):
    rows = commit_ops.recent_commits(v.failures(spark, sf), v.commits(spark, sf))
    return rows.select("event_id", F.posexplode("recent_commits").alias("pos", "k")).select(
        "event_id", (c("pos") + 1).alias("rank"), "k.short_sha", "k.message", "k.author"
    )


@register("recent_commits_by_repository", query(["failures", "commits"], """
    SELECT f.event_id, CAST(row_number() OVER (PARTITION BY f.event_id ORDER BY date DESC, sha DESC) AS INTEGER) AS rank,
           'repo_' || (user_id % 2) AS repository, short_sha
    FROM failures f JOIN commits ON date <= failed_at AND date >= failed_at - INTERVAL 24 HOUR
        AND user_id % 2 = CAST(substr(dag_id, 5) AS INTEGER) % 2
    QUALIFY rank <= 20"""))
def _(spark, sf):
    """Two repositories: even and odd DAGs, changed by even and odd users."""
    commits = v.commits(spark, sf).withColumn(
        "repository", v.tagged("repo_", F.regexp_extract("author", r"\d+", 0).cast("int") % 2))
    failures = v.failures(spark, sf).withColumn("repository", v.tagged("repo_", F.regexp_extract("dag_id", r"\d+", 0).cast("int") % 2))
    rows = commit_ops.recent_commits(failures, commits)
    return rows.select("event_id", "repository", F.posexplode("recent_commits").alias("pos", "k")).select(
        "event_id", (c("pos") + 1).alias("rank"), "repository", "k.short_sha")


@register("commit_scan", query(["commits"], f"""
    SELECT repo, short_sha, CAST(n AS INTEGER) AS rank, {ts('date')} AS date FROM (
        SELECT *, max(old) OVER (PARTITION BY repo ORDER BY n) AS stopped FROM (
            SELECT 'repo_' || (user_id % 11) AS repo, short_sha, date - to_days(CAST(event_id % 5 AS INTEGER)) AS date,
                   row_number() OVER (PARTITION BY user_id % 11 ORDER BY event_id DESC) AS n,
                   date - to_days(CAST(event_id % 5 AS INTEGER)) < TIMESTAMP '2024-01-26' AS old
            FROM commits) WHERE n <= 20) WHERE NOT stopped"""))
def _(spark, sf):
    rows = v.events(spark, sf, "signup").select(
        v.tagged("repo_", c("user_id") % 11).alias("repo"), (-c("event_id")).alias("position"),
        F.substring(F.md5(c("event_id").cast("string")), 1, 7).alias("short_sha"),
        (v.instant("ts") - F.make_dt_interval((c("event_id") % 5).cast("int"))).alias("date"),
        F.to_timestamp(lit("2024-01-26 00:00:00")).alias("since"),
    )
    return commit_ops.commit_scan(rows, "repo", "position", "since").select(
        "repo", "short_sha", "rank", v.ts_text("date").alias("date")
    )


@register("file_commits", query(["commits"], """
    SELECT file, short_sha, CAST(row_number() OVER (PARTITION BY file ORDER BY date DESC, sha DESC) AS INTEGER) AS rank
    FROM (SELECT *, unnest(files_changed) AS file FROM commits) QUALIFY rank <= 10"""))
def _(spark, sf):
    return commit_ops.file_commits(v.commits(spark, sf)).select("file", "short_sha", "rank")


def _with_file(failures: DataFrame) -> DataFrame:
    return failures.withColumn("dag_file_path", F.concat(lit("dags/"), c("dag_id"), lit(".py")))


LAST_COMMIT = ("last_commit", """
    SELECT f.*, k.short_sha, date_diff('microsecond', k.date, f.failed_at) / 3600000000.0 AS hours
    FROM failures f ASOF LEFT JOIN (SELECT *, unnest(files_changed) AS file FROM commits) k
      ON k.file = 'dags/' || f.dag_id || '.py' AND f.failed_at >= k.date""")


@register("last_commit_asof", query(["failures", "commits"], """
    SELECT event_id, short_sha, round(hours, 6) AS hours_since_last_change FROM last_commit""", [LAST_COMMIT]))
def _(spark, sf):
    rows = commit_ops.last_commit_asof(_with_file(v.failures(spark, sf)), v.commits(spark, sf))
    return rows.select("event_id", "last_commit.short_sha", rounded("hours_since_last_change"))


@register("suspect_regressions", query(["failures", "commits"], """
    SELECT event_id, dag_id, short_sha FROM last_commit WHERE hours <= 24""", [LAST_COMMIT]))
def _(spark, sf):
    rows = commit_ops.suspect_regressions(_with_file(v.failures(spark, sf)), v.commits(spark, sf))
    return rows.select("event_id", "dag_id", "last_commit.short_sha")


@register("resolve_dag_files", query(["dags", "dag_files"], r"""
    SELECT d.dag_id, b.path AS dag_file_path, CAST(b.priority AS INTEGER) AS priority FROM (
        SELECT dag_id FROM dags UNION ALL SELECT 'nowhere' FROM (SELECT count(*) FROM dags)) d LEFT JOIN (
    SELECT dag_id, path, priority FROM (
        SELECT d.dag_id, f.path, CASE
            WHEN regexp_matches(path, '(^|/)dags/(.*/)?[^/]*' || d.dag_id || '[^/]*\.py$') THEN 1
            WHEN regexp_matches(path, '(^|/)' || d.dag_id || '\.py$') THEN 2
            WHEN regexp_matches(path, '(^|/)dag_' || d.dag_id || '\.py$') THEN 3
            WHEN regexp_matches(path, '(^|/)' || d.dag_id || '_dag\.py$') THEN 4
            WHEN contains(content, 'dag_id="' || d.dag_id || '"') THEN 5 END AS priority
        FROM dags d, dag_files f)
    WHERE priority IS NOT NULL QUALIFY row_number() OVER (PARTITION BY dag_id ORDER BY priority, path) = 1) b
    ON b.dag_id = d.dag_id"""))
def _(spark, sf):
    """All DAGs of the events and one that no file defines."""
    known = v.dags(spark, sf)
    nowhere = known.agg(F.count("*")).select(lit("nowhere").alias("dag_id"))
    return commit_ops.resolve_dag_files(known.unionByName(nowhere), v.dag_files(spark, sf))


# --- health, metrics -------------------------------------------------------------------------------------------------


def _checks(spark, sf) -> DataFrame:
    return health.normalize_source_checks(v.raw_checks(spark, sf))


@register("source_checks", query(["checks"], """
    SELECT check_id, source_name, source_type, reachable, latency_ms, error_message FROM checks"""))
def _(spark, sf):
    return _checks(spark, sf).select(
        "check_id", "source_name", "source_type", "reachable", "latency_ms", "error_message")


@register("source_summary", query(["checks"], """
    SELECT source_name, CAST(count(*) AS BIGINT) AS checks, round(avg(CAST(reachable AS DOUBLE)), 6) AS reachable_share,
           round(avg(latency_ms), 6) AS latency_mean, round(quantile_cont(latency_ms, 0.95), 6) AS latency_p95
    FROM checks GROUP BY source_name"""))
def _(spark, sf):
    return health.source_summary(_checks(spark, sf)).select(
        "source_name", "checks", rounded("reachable_share"), rounded("latency_mean"), rounded("latency_p95"))


@register("volume_delta", query(["drift"], """
    SELECT check_id, source_name, row_count, before AS row_count_previous, round(delta_pct, 6) AS row_count_delta_pct
    FROM drift"""))
def _(spark, sf):
    return health.with_drift(_checks(spark, sf)).select(
        "check_id", "source_name", "row_count", "row_count_previous", rounded("row_count_delta_pct"))


@register("volume_anomaly", query(["drift"], """
    SELECT check_id, source_name, row_count, before AS row_count_previous FROM drift WHERE volume_anomaly"""))
def _(spark, sf):
    return health.with_drift(_checks(spark, sf)).where("volume_anomaly").select(
        "check_id", "source_name", "row_count", "row_count_previous")


@register("schema_drift", query(["drift"], """
    SELECT check_id, coalesce(len(added) + len(removed) > 0, FALSE) AS schema_changed,
           array_to_string(added, ',') AS columns_added, array_to_string(removed, ',') AS columns_removed FROM drift"""))
def _(spark, sf):
    return health.with_drift(_checks(spark, sf)).select(
        "check_id", "schema_changed", v.joined("columns_added", ",").alias("columns_added"),
        v.joined("columns_removed", ",").alias("columns_removed"))


ASOF_SOURCES = ("asof_sources", """
    SELECT f.event_id, s.i, k.* FROM (SELECT event_id, failed_at FROM failures) f
    CROSS JOIN (SELECT unnest(range(0, 15)) AS i) s
    ASOF JOIN drift k ON k.source_name = 'src_' || s.i AND f.failed_at >= k.last_checked""")


@register("source_health_asof", query(["failures", "drift"], """
    SELECT f.event_id, coalesce(string_agg(source_name || '=' || reachable || '/' || row_count || '/'
               || coalesce(CAST(before AS VARCHAR), '-') || '/' || coalesce(a.error_message, ''), '|' ORDER BY i), '')
               AS sources, CAST(count(a.i) AS INTEGER) AS n_sources
    FROM failures f LEFT JOIN asof_sources a USING (event_id) GROUP BY f.event_id""", [ASOF_SOURCES]))
def _(spark, sf):
    rows = health.source_health_asof(v.failures(spark, sf), health.with_drift(_checks(spark, sf)), v.SOURCES)
    text = F.transform("sources", lambda s: F.concat(
        s["source_name"], lit("="), s["reachable"].cast("string"), lit("/"), s["row_count"].cast("string"), lit("/"),
        F.coalesce(s["row_count_previous"].cast("string"), lit("-")), lit("/"),
        F.coalesce(s["error_message"], lit(""))))
    return rows.select("event_id", v.joined(text).alias("sources"), F.size("sources").alias("n_sources"))


@register("metrics_asof", query(["failures", "metrics"], f"""
    SELECT event_id, {ts('m.timestamp')} AS taken_at, cpu_percent, memory_percent, active_connections
    FROM failures f ASOF LEFT JOIN metrics m ON f.failed_at >= m.timestamp"""))
def _(spark, sf):
    rows = metric_ops.metrics_asof(v.failures(spark, sf), v.metrics(spark, sf))
    return rows.select("event_id", v.ts_text("metrics.timestamp").alias("taken_at"), "metrics.cpu_percent",
                       "metrics.memory_percent", "metrics.active_connections")


@register("external_events_window", query(["failures", "external_events"], """
    SELECT event_id, external_id, title FROM failures f JOIN external_events e USING (dag_id, task_id)
    WHERE event_time BETWEEN failed_at - INTERVAL 30 MINUTE AND failed_at + INTERVAL 5 MINUTE"""))
def _(spark, sf):
    rows = metric_ops.external_events_window(v.failures(spark, sf), v.external_events(spark, sf))
    return rows.select("event_id", "external_id", "title")


# --- incidents -------------------------------------------------------------------------------------------------------


def _probes(incidents: DataFrame) -> DataFrame:
    return incidents.select(c("incident_id").alias("probe_id"), "error_category", "embedding")


def similar(spark, sf, **options) -> DataFrame:
    """Every stored incident looks for its neighbours among all others."""
    stored = v.incidents(spark, sf)
    return inc.similar_incidents(_probes(stored), stored, exclude_self=True, **options)


@register("similar_incidents", query(["nearest"], """
    SELECT probe_id, incident_id, CAST(rank AS INTEGER) AS rank, round(distance, 6) AS distance,
           round(similarity_score, 6) AS similarity_score FROM nearest"""))
def _(spark, sf):
    return similar(spark, sf).select(
        "probe_id", "incident_id", "rank", rounded("distance"), rounded("similarity_score"))


@register("similar_by_category", query(["incidents"], """
    SELECT p.incident_id AS probe_id, i.incident_id, p.error_category,
           round(list_distance(p.embedding, i.embedding) ** 2, 6) AS distance
    FROM incidents p JOIN incidents i ON p.incident_id <> i.incident_id AND p.error_category = i.error_category
    QUALIFY row_number() OVER (PARTITION BY p.incident_id
        ORDER BY list_distance(p.embedding, i.embedding), i.incident_id) <= 5"""))
def _(spark, sf):
    stored = v.incidents(spark, sf)
    found = inc.similar_incidents(_probes(stored), stored, category="error_category", exclude_self=True)
    return found.join(stored.select("incident_id", "error_category"), "incident_id").select(
        "probe_id", "incident_id", "error_category", rounded("distance"))


@register("similar_cosine", query(["incidents"], """
    SELECT p.incident_id AS probe_id, i.incident_id,
           round(1 - list_cosine_similarity(p.embedding, i.embedding), 6) AS distance
    FROM incidents p JOIN incidents i ON p.incident_id <> i.incident_id
    QUALIFY row_number() OVER (PARTITION BY p.incident_id
        ORDER BY list_cosine_similarity(p.embedding, i.embedding) DESC, i.incident_id) <= 5"""))
def _(spark, sf):
    return similar(spark, sf, metric="cosine").select("probe_id", "incident_id", rounded("distance"))


@register("recurrence", query(["incidents", "nearest"], """
    SELECT i.incident_id AS probe_id, count(s.incident_id) > 0 AS is_recurring,
           CAST(count(s.incident_id) AS INTEGER) AS recurrence_count
    FROM incidents i LEFT JOIN nearest s ON s.probe_id = i.incident_id GROUP BY 1"""))
def _(spark, sf):
    stored = v.incidents(spark, sf)
    return inc.recurrence(similar(spark, sf), _probes(stored))


def categorised(spark, sf) -> DataFrame:
    """Failures with the category of their message."""
    rows = logs.match_logs(v.failures(spark, sf), "error_message", with_key_lines=False)
    return rows.withColumn(
        "error_category", F.coalesce(F.get("matches", lit(0))["category"], lit("unknown"))
    ).drop("matches")


MESSAGE_CATEGORY = [*matches_cte("failures", "event_id", "error_message", CATALOGUE), ("categorised", """
    SELECT f.*, coalesce(category, 'unknown') AS error_category FROM failures f LEFT JOIN prim ON k = event_id""")]


@register("recurrence_30d", query(["failures"], """
    SELECT event_id, error_category, CAST(count(*) OVER (PARTITION BY dag_id, task_id, error_category ORDER BY failed_at
        RANGE BETWEEN INTERVAL 30 DAY PRECEDING AND INTERVAL '0.000001 seconds' PRECEDING) AS BIGINT) AS recurrence_30d
    FROM categorised""", MESSAGE_CATEGORY))
def _(spark, sf):
    return inc.recurrence_30d(categorised(spark, sf)).select(
        "event_id", "error_category", "recurrence_30d")


@register("incident_statistics", query(["incidents"], """
    SELECT CAST(count(*) AS BIGINT) AS total_incidents, 'incidents' AS collection_name FROM incidents"""))
def _(spark, sf):
    return inc.incident_statistics(v.incidents(spark, sf))


def _distribution_sql(kind: str) -> str:
    return query(["incidents"], f"""
        SELECT error_category, severity, dag_id, CAST(count(*) AS BIGINT) AS incidents,
               CAST(grouping(error_category, severity, dag_id) AS BIGINT) AS level
        FROM incidents GROUP BY {kind} (error_category, severity, dag_id)""")


register("incident_distribution", _distribution_sql("ROLLUP"))(
    lambda spark, sf: inc.incident_distribution(v.incidents(spark, sf)))
register("incident_distribution_cube", _distribution_sql("CUBE"))(
    lambda spark, sf: inc.incident_distribution(v.incidents(spark, sf), cube=True))


@register("apply_resolutions", query(["incidents", "latest"], """
    SELECT i.incident_id, coalesce(l.resolution, i.resolution) AS resolution, l.resolution IS NOT NULL AS updated,
           l.resolution AS document_resolution, i.root_cause AS document_root_cause
    FROM incidents i LEFT JOIN latest l USING (incident_id)"""))
def _(spark, sf):
    rows = inc.apply_resolutions(v.incidents(spark, sf), v.resolutions(spark, sf))
    return rows.select(
        "incident_id", "resolution", c("resolution_updated").alias("updated"),
        F.get_json_object("document", "$.resolution").alias("document_resolution"),
        F.get_json_object("document", "$.root_cause").alias("document_root_cause"))


@register("updatable", query(["incidents", "resolutions"], """
    SELECT update_id, incident_id FROM resolutions WHERE incident_id IN (SELECT incident_id FROM incidents)"""))
def _(spark, sf):
    return inc.updatable(v.resolutions(spark, sf), v.incidents(spark, sf)).select("update_id", "incident_id")


@register("rejected_updates", query(["incidents", "resolutions"], """
    SELECT update_id, incident_id FROM resolutions WHERE incident_id NOT IN (SELECT incident_id FROM incidents)"""))
def _(spark, sf):
    return inc.rejected(v.resolutions(spark, sf), v.incidents(spark, sf)).select("update_id", "incident_id")


@register("unresolved", query(["incidents", "resolutions"], """
    SELECT incident_id FROM incidents WHERE resolution IS NULL
      AND incident_id NOT IN (SELECT incident_id FROM resolutions)"""))
def _(spark, sf):
    return inc.unresolved(v.incidents(spark, sf), v.resolutions(spark, sf)).select("incident_id")


@register("incident_lookup", query(["incidents"], """
    SELECT incident_id, dag_id, task_id, error_category, severity, root_cause_summary, resolution FROM incidents
    WHERE incident_id = 'inc_35'"""))
def _(spark, sf):
    return inc.incident_lookup(v.incidents(spark, sf), "inc_35").select(
        "incident_id", "dag_id", "task_id", "error_category", "severity", "root_cause_summary", "resolution")


@register("read_back", query(["incidents"], """
    SELECT incident_id, root_cause, resolution FROM incidents"""))
def _(spark, sf):
    return inc.read_back(v.incidents(spark, sf)).select("incident_id", "root_cause", "resolution")


@register("text_similar_incidents", None)
def _(spark, sf):
    docs = v.table(spark, sf, "documents").select("doc_id", "text")
    probes = docs.withColumnRenamed("doc_id", "probe_id")
    stored = docs.withColumnRenamed("doc_id", "incident_id")
    return inc.text_similar_incidents(probes, stored, "text", exclude_self=True).select(
        "probe_id", "incident_id", "rank", rounded("distance"), rounded("similarity_score"))


# --- verdicts --------------------------------------------------------------------------------------------------------


@register("parsed_verdicts", query(["parsed"], """
    SELECT conv_id, turn, verdict IS NOT NULL AS valid, json_extract_string(verdict, '$.error_category') AS error_category,
           json_extract_string(verdict, '$.severity') AS severity, json_extract_string(verdict, '$.root_cause') AS root_cause,
           json_extract_string(verdict, '$.root_cause_summary') AS root_cause_summary,
           CAST(json_extract(verdict, '$.confidence') AS DOUBLE) AS confidence,
           json_extract_string(verdict, '$.evidence[0]') || '|' || json_extract_string(verdict, '$.evidence[1]') AS evidence,
           json_extract_string(verdict, '$.immediate_action') AS immediate_action FROM parsed"""))
def _(spark, sf):
    rows = verdicts.parse_replies(v.replies(spark, sf))
    return rows.select(
        "conv_id", "turn", c("model_verdict").isNotNull().alias("valid"), "model_verdict.error_category",
        "model_verdict.severity", "model_verdict.root_cause", "model_verdict.root_cause_summary",
        "model_verdict.confidence", v.joined("model_verdict.evidence").alias("evidence"),
        "model_verdict.immediate_action")


@register("priorities", query(["parsed"], """
    SELECT conv_id, turn, json_extract_string(verdict, '$.recommendations[0].action') AS action,
           CAST(CASE json_type(json_extract(verdict, '$.recommendations[0].priority'))
                WHEN 'BOOLEAN' THEN 1 WHEN 'UBIGINT' THEN least(5, greatest(1, CAST(p AS BIGINT)))
                WHEN 'BIGINT' THEN least(5, greatest(1, CAST(p AS BIGINT)))
                WHEN 'VARCHAR' THEN if(TRY_CAST(p AS BIGINT) IS NOT NULL, least(5, greatest(1, TRY_CAST(p AS BIGINT))),
                    CASE lower(p) WHEN 'critical' THEN 1 WHEN 'immediate' THEN 1 WHEN 'high' THEN 2 WHEN 'low' THEN 4
                    ELSE 3 END) ELSE 3 END AS INTEGER) AS priority
    FROM (SELECT *, json_extract_string(verdict, '$.recommendations[0].priority') AS p FROM parsed)
    WHERE verdict IS NOT NULL"""))
def _(spark, sf):
    rows = verdicts.parse_replies(v.replies(spark, sf)).where("model_verdict IS NOT NULL")
    return rows.select("conv_id", "turn", F.explode("model_verdict.recommendations").alias("r")).select(
        "conv_id", "turn", "r.action", "r.priority")


# --- daily sketches --------------------------------------------------------------------------------------------------

SINCE, UNTIL = "2024-01-08", "2024-01-19"


def _days(spark, daily: DataFrame, purpose: str) -> DataFrame:
    """Written by day, one half of the days twice, and read back."""
    path = shared_dir(spark, purpose)
    sketches.write_daily(daily, path)
    sketches.write_daily(daily.where("day(day) % 2 = 0"), path)
    return spark.read.schema(daily.schema).parquet(path)


@register("source_summary_period", query(["checks"], f"""
    SELECT source_name, CAST(count(*) AS BIGINT) AS checks, round(avg(CAST(reachable AS DOUBLE)), 6) AS reachable_share,
           round(avg(latency_ms), 6) AS latency_mean, TRUE AS p50_within, TRUE AS p95_within
    FROM checks WHERE CAST(last_checked AS DATE) BETWEEN DATE '{SINCE}' AND DATE '{UNTIL}' GROUP BY source_name"""))
def _(spark, sf):
    """The estimates are tested against the exact ranks: at most half a percent of the values off, and one value."""
    checks = _checks(spark, sf)
    since, until = lit(SINCE).cast("date"), lit(UNTIL).cast("date")
    daily = _days(spark, sketches.daily_source_checks(checks), "daily-checks")
    found = sketches.source_summary_period(daily, since, until)
    exact = checks.where(F.to_date("last_checked").between(since, until)).select("source_name", "latency_ms").join(
        found.select("source_name", "latency_p50", "latency_p95"), "source_name")
    below = lambda q: F.count_if(c("latency_ms") < c(f"latency_p{q}"))
    upto = lambda q: F.count_if(c("latency_ms") <= c(f"latency_p{q}"))
    n = F.count("latency_ms")
    near = lambda q: (below(q) <= (q / 100 + 0.005) * n + 1) & (upto(q) >= (q / 100 - 0.005) * n - 1)
    within = exact.groupBy("source_name").agg((near(50) | (n == 0)).alias("p50_within"), (near(95) | (n == 0)).alias("p95_within"))
    return found.join(within, "source_name").select(
        "source_name", "checks", rounded("reachable_share"), rounded("latency_mean"), "p50_within", "p95_within")


@register("signature_frequency_period", query(["failures"], f"""
    SELECT CAST(sig_idx AS INTEGER) AS sig_idx, name, CAST(count(*) AS BIGINT) AS n_logs,
           CAST(sum(len(matches)) AS BIGINT) AS n_matches, TRUE AS groups_within
    FROM fam JOIN failures ON event_id = k WHERE CAST(failed_at AS DATE) BETWEEN DATE '{SINCE}' AND DATE '{UNTIL}'
    GROUP BY sig_idx, name""", matches_cte("failures", "event_id", "error_message", CATALOGUE)))
def _(spark, sf):
    """Distinct runs of each family are estimated within five percent of their exact number."""
    rows = v.failures(spark, sf).select("run_id", "failed_at", c("error_message").alias("stdout"))
    since, until = lit(SINCE).cast("date"), lit(UNTIL).cast("date")
    found = sketches.signature_frequency_period(
        _days(spark, sketches.daily_signatures(rows, "run_id", "failed_at"), "daily-signatures"), since, until)
    exact = logs.match_signatures(rows.where(F.to_date("failed_at").between(since, until)), ["run_id"]).groupBy("sig_idx").agg(
        F.count_distinct("run_id").alias("_exact"))
    return found.join(exact, "sig_idx").select(
        "sig_idx", "name", "n_logs", "n_matches", (F.abs(c("n_groups") - c("_exact")) <= 0.05 * c("_exact") + 1).alias("groups_within"))
