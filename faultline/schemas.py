"""Declared schemas.  Nothing is inferred."""

from __future__ import annotations

FAILURE_STATES = ["failed", "upstream_failed", "skipped", "up_for_retry", "up_for_reschedule"]
CATEGORIES = [
    "resource_exhaustion", "schema_mismatch", "source_unavailable", "data_quality", "permission_error",
    "code_regression", "volume_anomaly", "network_error", "configuration_error", "unknown",
]
SEVERITIES = ["critical", "high", "medium", "low"]

# Raw callback payload: execution_date is text, and the event time is the arrival time, not a payload field.
FAILURE_EVENT_JSON = (
    "dag_id string, task_id string, run_id string, execution_date string, state string, "
    "try_number int, exception string, log_url string"
)
TASK_INSTANCE_JSON = (
    "dag_id string, task_id string, run_id string, state string, start_date string, end_date string, "
    "try_number int, max_tries int, operator string, pool string, queue string"
)
DAG_RUN_JSON = (
    "dag_id string, run_id string, state string, execution_date string, start_date string, end_date string"
)
COMMIT_JSON = (
    "sha string, author string, email string, message string, date string, files_changed array<string>, repository string"
)
SOURCE_CHECK_JSON = (
    "check_id bigint, source_name string, source_type string, status_code int, expected_status int, "
    "exception_kind string, exception_text string, latency_ms double, row_count bigint, columns array<string>, "
    "last_checked string"
)
METRICS = (
    "timestamp timestamp, cpu_percent double, memory_percent double, memory_used_gb double, disk_percent double, "
    "active_connections int, worker_slots_available int"
)
EXTERNAL_EVENT_JSON = "event_id bigint, ts string, dag_id string, task_id string, title string"
REPLY_JSON = "failure_id string, raw string"
INCIDENT = (
    "incident_id string, dag_id string, task_id string, run_id string, error_category string, severity string, "
    "confidence double, date timestamp, root_cause_summary string, document string, resolution string, "
    "embedding array<float>, text string, vector_version string"
)
RECENT_RUN = "struct<state:string,execution_date:timestamp,duration_seconds:double>"
RECOMMENDATION = "struct<action:string,priority:int,estimated_effort:string,automated:boolean>"
COMMIT = (
    "struct<sha:string,short_sha:string,author:string,email:string,message:string,date:timestamp,"
    "files_changed:array<string>>"
)
SIMILAR = (
    "struct<incident_id:string,date:timestamp,dag_id:string,task_id:string,error_category:string,"
    "root_cause:string,resolution:string,similarity_score:double>"
)
SOURCE_HEALTH = (
    "struct<source_name:string,source_type:string,reachable:boolean,latency_ms:double,error_message:string,"
    "row_count:bigint,row_count_previous:bigint,row_count_delta_pct:double,schema_changed:boolean,"
    "last_checked:timestamp>"
)
METRICS_SNAPSHOT = (
    "struct<timestamp:timestamp,cpu_percent:double,memory_percent:double,memory_used_gb:double,"
    "disk_percent:double,active_connections:int,worker_slots_available:int>"
)
TASK = (
    "struct<state:string,start_date:timestamp,end_date:timestamp,duration_seconds:double,try_number:int,"
    "max_tries:int,operator:string,pool:string,queue:string>"
)
