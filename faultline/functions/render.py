"""Texts made from context and report rows: prompt, summary, chat payload, markdown, HTML, JSON.

Each renderer is one Column over the declared columns; optional parts are null and fall out of concat_ws.  The labels and
headings of sections are fixed values: readers of reports look for them.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from faultline.functions import text as t
from faultline.schemas import CATEGORIES, SEVERITIES

c = F.col
NO_SIGNATURES = "No known error patterns detected."
NO_INCIDENTS = "No similar past incidents found."

SYSTEM_PROMPT = (
    "You diagnose failed data pipeline tasks. From the task, its log, its run history, recent changes, the state of "
    "its sources, known error signatures and similar past incidents, name the most likely root cause, say how sure "
    "you are, and list what to do.\n\n"
    "Answer with one JSON object with the fields error_category (one of " + ", ".join(CATEGORIES) + "), severity (one "
    "of " + ", ".join(SEVERITIES) + "), root_cause, root_cause_summary, confidence (0 to 1), evidence (list of texts), "
    "contributing_factors (list of texts), recommendations (list of objects with action, priority 1 to 5, "
    "estimated_effort, automated) and immediate_action (text or null)."
)


def _join(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _lines(array: Column, line) -> Column:
    return F.array_join(F.transform(array, line), "\n")


def pattern_section(matches: Column) -> Column:
    """The first 5 families with at most 3 matches each."""
    block = _lines(F.slice(matches, 1, 5), lambda m: _join(
        "- **", m["name"], "** (", m["category"], ", ", m["severity"], "): ", m["description"],
        "\n  Matches: ", F.array_join(F.slice(m["matches"], 1, 3), ", "),
        "\n  Recommendation: ", m["recommendation"],
    ))
    return F.when(t.has_items(matches), block).otherwise(NO_SIGNATURES)


def incident_section(similar: Column) -> Column:
    """The first 3 similar incidents, with their resolutions."""
    block = _lines(F.slice(similar, 1, 3), lambda s: _join(
        "- [", F.date_format(s["date"], "yyyy-MM-dd"), "] ", s["dag_id"], "/", s["task_id"], ": ", s["root_cause"],
        F.when(t.truthy(s["resolution"]), _join("\n  Resolution: ", s["resolution"])).otherwise(""),
    ))
    return F.when(t.has_items(similar), block).otherwise(NO_INCIDENTS)


def context_text() -> Column:
    """Sections of a context row, joined by blank lines; optional ones only where there is data."""
    task, history, git, metrics = c("task"), c("dag_history"), c("git"), c("metrics")
    task_part = _join(
        "## Failed Task\n- DAG: ", c("dag_id"), "\n- Task: ", c("task_id"), "\n- State: ", task["state"],
        "\n- Try: ", task["try_number"].cast("string"), "/", task["max_tries"].cast("string"),
        "\n- Duration: ", t.number_or_na(task["duration_seconds"]), "s\n- Operator: ",
        t.text_or(task["operator"], "unknown"),
    )
    log_part = _join(
        "## Error Logs\n```\n", F.coalesce(t.non_empty(c("error_snippet")), c("stdout_tail")), "\n```"
    )
    runs = history["recent_runs"]
    history_part = F.when(t.has_items(runs), _join(
        "## DAG History\n- Last success: ", F.coalesce(t.instant_text(history["last_success"]), F.lit("Never")),
        "\n- Recent runs: [",
        F.array_join(F.transform(F.slice(runs, 1, 5), lambda r: F.coalesce(r["state"], F.lit("unknown"))), ", "),
        "]\n- Failure rate (7d): ", t.percent(history["failure_rate_7d"], 1),
        "\n- Avg duration: ", t.number_or_na(history["avg_duration_seconds"]), "s",
    ))
    git_part = F.when(t.has_items(git["recent_commits"]), _join(
        "## Recent Git Changes\n",
        _lines(F.slice(git["recent_commits"], 1, 3), lambda k: _join(
            "  - ", k["short_sha"], ": ", F.substring(k["message"], 1, 50), " (", k["author"], ")")),
        "\n- Hours since last DAG change: ", t.number_or_na(git["hours_since_last_change"]),
    ))
    delta = lambda s: s["row_count_delta_pct"]
    source_part = F.when(t.has_items(c("sources")), _join(
        "## Source Health\n",
        _lines(c("sources"), lambda s: _join(
            "  - ", s["source_name"], ": ", F.when(s["reachable"], "✓").otherwise("✗"),
            " (", t.number_or_na(s["latency_ms"]), "ms)",
            F.when(s["schema_changed"], " [SCHEMA CHANGED]").otherwise(""),
            F.when(delta(s).isNotNull() & (delta(s) != 0), _join(" [Volume: ", t.signed_percent(delta(s)), "]"))
            .otherwise(""),
        )),
    ))
    metrics_part = F.when(metrics.isNotNull(), _join(
        "## Infrastructure Metrics\n- CPU: ", t.number_or_na(metrics["cpu_percent"]), "%\n- Memory: ",
        t.number_or_na(metrics["memory_percent"]), "%\n- Disk: ", t.number_or_na(metrics["disk_percent"]), "%",
    ))
    return F.concat_ws("\n\n", task_part, log_part, history_part, git_part, source_part, metrics_part)


def user_prompt(context: Column, patterns: Column, incidents: Column) -> Column:
    return _join(
        "Diagnose this pipeline failure.\n\n", context, "\n\n## Pattern Matching Results\n", patterns,
        "\n\n## Similar Past Incidents\n", incidents, "\n\nName the root cause that the evidence supports best.",
    )


def summary() -> Column:
    return _join(
        "[", F.upper("severity"), "] ", c("dag_id"), "/", c("task_id"), ": ", c("root_cause_summary"),
        " (Confidence: ", t.percent(c("confidence")), ")",
    )


def file_name() -> Column:
    return _join(
        F.date_format("failure_time", "yyyyMMdd_HHmmss"), "_", c("dag_id"), "_", c("task_id"), "_",
        F.substring("report_id", 1, 8), ".txt",
    )


def chat_payload(channel: str | None = None) -> Column:
    """JSON with header, category and confidence, root cause, and the optional blocks that apply."""
    def typed(kind: str, body: Column) -> Column:
        return F.struct(F.lit(kind).alias("type"), body.alias("text"))

    def block(kind: str, text: Column | None = None, fields: Column | None = None,
              elements: Column | None = None) -> Column:
        piece = "struct<type:string,text:string>"
        return F.struct(
            F.lit(kind).alias("type"),
            (F.lit(None) if text is None else text).cast(piece).alias("text"),
            (F.lit(None) if fields is None else fields).cast(f"array<{piece}>").alias("fields"),
            (F.lit(None) if elements is None else elements).cast(f"array<{piece}>").alias("elements"),
        )

    similar = c("similar_incidents")
    blocks = F.array_compact(F.array(
        block("header", typed("plain_text", _join(
            t.severity_emoji(c("severity")), " Pipeline Failure: ", c("dag_id"), "/", c("task_id")))),
        block("section", fields=F.array(
            typed("mrkdwn", _join("*Category:*\n", c("error_category"))),
            typed("mrkdwn", _join("*Confidence:*\n", t.percent(c("confidence")))),
        )),
        block("section", typed("mrkdwn", _join("*Root Cause:*\n", c("root_cause")))),
        F.when(t.truthy(c("immediate_action")), block("section", typed("mrkdwn", _join(
            "*🚨 Immediate Action:*\n", c("immediate_action"))))),
        F.when(t.has_items(c("evidence")), block("section", typed("mrkdwn", _join(
            "*Evidence:*\n", _lines(F.slice("evidence", 1, 3), lambda e: _join("• ", e)))))),
        F.when(t.has_items(similar), block("context", elements=F.array(typed("mrkdwn", _join(
            "📚 ", F.size(similar).cast("string"), " similar incidents found. Last occurrence: ",
            F.date_format(F.get(similar, F.lit(0))["date"], "yyyy-MM-dd")))))),
    ))
    fields = [blocks.alias("blocks")]
    if channel:
        fields.append(F.lit(channel).alias("channel"))
    return F.to_json(F.struct(*fields))


def simple_message(text: Column, channel: str | None = None) -> Column:
    fields = [text.alias("text")]
    if channel:
        fields.append(F.lit(channel).alias("channel"))
    return F.to_json(F.struct(*fields))


def _section(condition: Column, title: str, body: Column) -> Column:
    return F.when(condition, _join(title, "\n\n", body))


def _numbered(items: Column, line) -> Column:
    return F.transform(items, lambda item, index: line(item, (index + 1).cast("string")))


def markdown() -> Column:
    similar = c("similar_incidents")
    table = _join(
        "| Field | Value |\n|-------|-------|",
        "\n| **DAG** | ", c("dag_id"), " |\n| **Task** | ", c("task_id"), " |\n| **Run ID** | ", c("run_id"),
        " |\n| **Failure Time** | ", t.utc_text(c("failure_time")), " |\n| **Category** | ", c("error_category"),
        " |\n| **Severity** | ", t.severity_badge(c("severity")), " |\n| **Confidence** | ",
        t.fixed(c("confidence") * 100, 0), "% |",
    )
    bullets = lambda items: _lines(items, lambda item: _join("- ", item))
    recommendations = F.array_join(_numbered(c("recommendations"), lambda r, n: F.concat_ws(
        "\n", _join(n, ". **", r["action"], "**"), _join("   - Priority: ", r["priority"].cast("string"), "/5"),
        F.when(t.truthy(r["estimated_effort"]), _join("   - Effort: ", r["estimated_effort"])),
        F.when(r["automated"], F.lit("   - ✅ Can be automated")),
    )), "\n\n")
    past = F.when(t.has_items(similar), F.concat_ws(
        "\n\n", F.lit("---"), F.lit("## Similar Past Incidents"),
        _join(
            "| Date | DAG/Task | Root Cause | Resolution |\n|------|----------|------------|------------|\n",
            _lines(F.slice(similar, 1, 5), lambda s: _join(
                "| ", F.date_format(s["date"], "yyyy-MM-dd"), " | ", s["dag_id"], "/", s["task_id"], " | ",
                F.substring(s["root_cause"], 1, 50), "... | ", t.text_or(s["resolution"], "N/A"), " |")),
        ),
        F.when(c("is_recurring"), _join(
            "**This appears to be a recurring issue** (", c("recurrence_count").cast("string"),
            " similar incidents)")),
    ))
    duration = c("analysis_duration_ms")
    return F.concat_ws(
        "\n\n",
        _join("# 🔍 RCA Report: ", c("dag_id"), "/", c("task_id")),
        _join("**Report ID:** `", c("report_id"), "`\n**Generated:** ", t.utc_text(c("generated_at"))),
        F.lit("---\n\n## Summary"), table,
        F.lit("---\n\n## Root Cause"), c("root_cause"),
        _section(t.has_items(c("evidence")), "### Evidence", bullets(c("evidence"))),
        _section(t.has_items(c("key_log_lines")), "### Key Log Lines", _join(
            "```\n", F.array_join(F.slice("key_log_lines", 1, 10), "\n"), "\n```")),
        _section(t.has_items(c("contributing_factors")), "### Contributing Factors",
                 bullets(c("contributing_factors"))),
        _section(t.has_items(c("recent_changes")), "### Recent Changes", bullets(c("recent_changes"))),
        F.lit("---\n\n## Recommendations"),
        F.when(t.truthy(c("immediate_action")), _join("> **Immediate Action:** ", c("immediate_action"))),
        F.when(t.has_items(c("recommendations")), recommendations),
        past,
        F.lit("---\n\n## Metadata"),
        _join(
            "- **Analysis Duration:** ",
            F.when(duration.isNull() | (duration == 0), "N/A").otherwise(duration.cast("string")),
            "ms\n- **LLM Model:** ", t.text_or(c("llm_model"), "N/A"), "\n- **Collectors Used:** ",
            F.array_join("collectors_used", ", "),
        ),
    )


HTML_STYLE = (
    "body{font-family:sans-serif;max-width:900px;margin:auto}th{text-align:left;padding-right:1em}"
    ".severity-critical{color:#b00}.severity-high{color:#c50}.severity-medium{color:#a80}.severity-low{color:#282}"
    ".log-lines{background:#222;color:#eee;font-family:monospace}"
)


def html() -> Column:
    """Subset of the markdown; every value is escaped."""
    e = lambda name: t.escape_html(c(name))
    row = lambda head, value: _join("<tr><th>", head, "</th><td>", value, "</td></tr>")
    recommendations = F.array_join(_numbered(c("recommendations"), lambda r, n: _join(
        '<div class="recommendation"><strong>', n, ". ", t.escape_html(r["action"]), "</strong><ul><li>Priority: ",
        r["priority"].cast("string"), "/5</li>",
        F.when(t.truthy(r["estimated_effort"]), _join(
            "<li>Estimated Effort: ", t.escape_html(r["estimated_effort"]), "</li>")).otherwise(""),
        "</ul></div>",
    )), "\n")
    duration = c("analysis_duration_ms")
    return F.concat_ws(
        "\n",
        F.lit("<!DOCTYPE html>\n<html>\n<head>"),
        _join("<title>RCA Report - ", e("dag_id"), "/", e("task_id"), "</title>"),
        F.lit(f"<style>{HTML_STYLE}</style>\n</head>\n<body>\n<h1>RCA Report</h1>"),
        _join("<p><strong>", e("dag_id"), "/", e("task_id"), "</strong></p>"),
        F.lit('<h2>Summary</h2>\n<table class="summary-table">'),
        row("Report ID", _join("<code>", e("report_id"), "</code>")),
        row("Failure Time", t.utc_text(c("failure_time"))),
        row("Category", e("error_category")),
        row("Severity", _join(
            '<span class="severity-', c("severity"), '">', F.upper("severity"), "</span>")),
        row("Confidence", _join(t.fixed(c("confidence") * 100, 0), "%")),
        F.lit("</table>\n<h2>Root Cause</h2>"),
        _join('<div class="root-cause"><p>', e("root_cause"), "</p></div>"),
        F.when(t.has_items(c("evidence")), _join(
            '<h2>Evidence</h2>\n<div class="evidence"><ul>',
            F.array_join(F.transform("evidence", lambda x: _join("<li>", t.escape_html(x), "</li>")), ""),
            "</ul></div>")),
        F.when(t.has_items(c("key_log_lines")), _join(
            '<h2>Key Log Lines</h2>\n<div class="log-lines">',
            F.array_join(F.transform(
                F.slice("key_log_lines", 1, 10), lambda x: _join(t.escape_html(x), "<br>")), "\n"), "</div>")),
        F.lit("<h2>Recommendations</h2>"),
        F.when(t.truthy(c("immediate_action")), _join(
            '<div class="immediate-action"><strong>Immediate Action:</strong> ', e("immediate_action"), "</div>")),
        F.when(t.has_items(c("recommendations")), recommendations),
        _join(
            "<hr>\n<p>Generated at ", t.utc_text(c("generated_at")), " | Model: ",
            t.escape_html(t.text_or(c("llm_model"), "N/A")), " | Duration: ",
            F.when(duration.isNull() | (duration == 0), "N/A").otherwise(duration.cast("string")), "ms</p>"),
        F.lit("</body>\n</html>"),
    )


def json_report(columns: list[str]) -> Column:
    """All fields including nulls, times in ISO form with microseconds."""
    return F.to_json(F.struct(*columns), {
        "ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    })
