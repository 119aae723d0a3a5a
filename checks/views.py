"""The given tables, read as the library's inputs (Spark side).  ``sql_views`` states the same views in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from faultline.schemas import CATEGORIES, FAILURE_STATES, SEVERITIES
from faultline.sources.readers import duration_seconds, shape_commits

c, lit = F.col, F.lit

# Log lines with known families (two lines in number 16).
TEMPLATES = [
    "ERROR - java.lang.OutOfMemoryError: Java heap space",
    "container OOMKilled, exit code 137",
    "OSError: [Errno 28] No space left on device",
    "TimeoutError: Connection to api.external.com timed out after 30s",
    "KeyError: column 'customer_id' not found",
    "ValueError: cannot cast 'abc' to INT",
    "parse error: malformed record, unexpected token",
    "Connection refused to database:5432",
    "HTTP 503 Service Unavailable",
    "socket.gaierror: Name or service not known",
    "NOT NULL constraint failed: orders.id",
    "IntegrityError: duplicate key value, UNIQUE index",
    "AssertionError: expectation row_count failed",
    "HTTP 403 Forbidden - Access Denied",
    "JWT token has expired",
    "SSLError: certificate verify failed",
    "Connection refused\nNo space left on device",
    "Task failed with exit code 137 (OOM Killed)",
    "TypeError: unsupported operand type(s) for +: 'int' and 'str'",
    "Task completed",
]
STATES = [*FAILURE_STATES, "crashed"]
SOURCES = [f"src_{i}" for i in range(15)]
COLUMN_POOL = ["id", "name", "email", "created_at", "amount"]
PRIORITIES = ['4.7', '"4"', '"critical"', 'true', 'null', None, '9', '"HIGH"']


# Declared, so that no file is opened to infer a schema.
SCHEMAS = {
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def pick(values: list, index: Column) -> Column:
    """The literal list's element at ``index``."""
    return F.get(F.array(*[lit(v) for v in values]), index.cast("int"))


def instant(name: str) -> Column:
    return c(name).cast("timestamp")


def tagged(prefix: str, number: Column) -> Column:
    return F.concat(lit(prefix), number.cast("string"))


def dag_of() -> Column:
    return tagged("dag_", c("user_id") % 20)


def task_of() -> Column:
    return tagged("task_", c("user_id") % 7)


def events(spark, sf_dir, *types: str) -> DataFrame:
    """Events by type: each type plays one input."""
    rows = table(spark, sf_dir, "events")
    return rows.where(c("event_type").isin(*types)) if types else rows


def props_k() -> Column:
    return F.get_json_object("props", "$.k").cast("int")


def failures(spark, sf_dir) -> DataFrame:
    return events(spark, sf_dir, "error").select(
        "event_id", dag_of().alias("dag_id"), task_of().alias("task_id"),
        tagged("run_", c("event_id")).alias("run_id"), (c("event_id") % 3 + 1).cast("int").alias("try_number"),
        pick(TEMPLATES, c("event_id") % 20).alias("error_message"),
        pick(STATES, c("event_id") % 6).alias("state"), instant("ts").alias("failed_at"),
    )


def runs(spark, sf_dir) -> DataFrame:
    state = F.when(c("event_type") == "error", "failed").when(c("event_type") == "signup", "running")
    return events(spark, sf_dir).select(
        dag_of().alias("dag_id"), tagged("run_", F.lpad(c("event_id").cast("string"), 12, "0")).alias("run_id"),
        state.otherwise("success").alias("state"), instant("ts").alias("execution_date"),
        c("value").alias("duration_seconds"),
    )


def runs_star(spark, sf_dir) -> DataFrame:
    state = F.when(c("o_orderstatus") == "F", "failed").when(c("o_orderstatus") == "O", "success")
    return table(spark, sf_dir, "orders").select(
        tagged("dag_", c("o_custkey") % 20).alias("dag_id"),
        tagged("run_", F.lpad(c("o_orderkey").cast("string"), 12, "0")).alias("run_id"),
        state.otherwise("running").alias("state"), instant("o_orderdate").alias("execution_date"),
        c("o_totalprice").alias("duration_seconds"),
    )


def raw_commits(spark, sf_dir) -> DataFrame:
    return events(spark, sf_dir, "signup").select(
        F.md5(c("event_id").cast("string")).alias("sha"), tagged("user_", c("user_id")).alias("author"),
        F.concat(lit("user_"), c("user_id").cast("string"), lit("@example.com")).alias("email"),
        F.concat(lit(" change "), c("event_id").cast("string"), lit("\n\nlonger text")).alias("message"),
        instant("ts").alias("date"),
        F.array(F.concat(lit("dags/dag_"), (c("user_id") % 20).cast("string"), lit(".py")),
                F.concat(lit("lib/util_"), (c("event_id") % 3).cast("string"), lit(".py"))).alias("files_changed"),
    )


def commits(spark, sf_dir) -> DataFrame:
    return shape_commits(raw_commits(spark, sf_dir))


def task_instances(spark, sf_dir) -> DataFrame:
    """An instance per event; purchases never ended."""
    end = F.when(c("event_type") != "purchase", instant("ts"))
    start = F.timestamp_micros(F.unix_micros(instant("ts")) - F.floor(c("value") * 1000) * 1000)
    return events(spark, sf_dir).select(
        dag_of().alias("dag_id"), task_of().alias("task_id"), tagged("run_", c("event_id")).alias("run_id"),
        F.when(c("event_type") == "error", "failed").otherwise("success").alias("state"),
        start.alias("start_date"), end.alias("end_date"), duration_seconds(start, end).alias("duration_seconds"),
        (c("event_id") % 3 + 1).cast("int").alias("try_number"), lit(3).alias("max_tries"),
        F.when(c("event_id") % 2 == 0, "PythonOperator").alias("operator"), lit("default_pool").alias("pool"),
        lit("default").alias("queue"),
    )


DOCUMENTS_A_TASK = 2_000


def documents(spark, sf_dir) -> DataFrame:
    """The given file may be one row group, that is one task; logs come as many files, so its rows are dealt to all cores, and to
    as many tasks as keep a task's texts few."""
    rows = table(spark, sf_dir, "documents")
    tasks = max(spark.sparkContext.defaultParallelism, -(-rows.count() // DOCUMENTS_A_TASK))
    return rows.repartition(tasks, "doc_id")


def plain_logs(spark, sf_dir) -> DataFrame:
    """Documents as logs: the whole text, then a line with a known family."""
    return documents(spark, sf_dir).select(
        "doc_id", "source", F.concat(c("text"), lit("\n"), pick(TEMPLATES, c("doc_id") % 20)).alias("stdout")
    )


def log_lines(spark, sf_dir) -> DataFrame:
    return plain_logs(spark, sf_dir).select("doc_id", F.posexplode(F.split("stdout", "\n", -1)).alias("line_no", "line"))


def task_logs(spark, sf_dir) -> DataFrame:
    """The log of document d belongs to the attempt of event d."""
    keys = events(spark, sf_dir).select(
        c("event_id").alias("doc_id"), dag_of().alias("dag_id"), task_of().alias("task_id"),
        tagged("run_", c("event_id")).alias("run_id"), (c("event_id") % 3 + 1).cast("int").alias("try_number"),
    )
    return plain_logs(spark, sf_dir).drop("source").join(keys, "doc_id").drop("doc_id")


def raw_checks(spark, sf_dir) -> DataFrame:
    k, source = props_k(), c("user_id") % 15
    kind = F.when(source < 9, "api").when(source < 12, "database").when(source == 12, "file").when(source == 14, "api")
    return events(spark, sf_dir, "view", "click").select(
        c("event_id").alias("check_id"), tagged("src_", source).alias("source_name"), kind.alias("source_type"),
        F.when(k < 85, 200).when(k < 92, 503).alias("status_code"), lit(200).alias("expected_status"),
        F.when(k < 92, lit(None).cast("string")).when(k < 96, "timeout").otherwise("connect").alias("exception_kind"),
        F.when(k >= 92, F.concat(lit("host unreachable "), k.cast("string"))).alias("exception_text"),
        c("value").alias("latency_ms"),
        F.when(k % 25 == 0, lit(0)).otherwise(F.floor(c("value") * 1000)).cast("bigint").alias("row_count"),
        F.slice(F.array(*[lit(x) for x in COLUMN_POOL]), lit(1), (k % 3 + 3).cast("int")).alias("columns"),
        instant("ts").alias("last_checked"),
    )


def metrics(spark, sf_dir) -> DataFrame:
    k = props_k()
    return events(spark, sf_dir, "purchase").select(
        instant("ts").alias("timestamp"), F.least(c("value"), lit(100.0)).alias("cpu_percent"),
        k.cast("double").alias("memory_percent"), (c("value") / 10).alias("memory_used_gb"),
        lit(None).cast("double").alias("disk_percent"), k.alias("active_connections"),
        (lit(100) - k).cast("int").alias("worker_slots_available"),
    )


def external_events(spark, sf_dir) -> DataFrame:
    return events(spark, sf_dir, "view", "click", "signup", "purchase").select(
        c("event_id").alias("external_id"), instant("ts").alias("event_time"), dag_of().alias("dag_id"),
        task_of().alias("task_id"), c("event_type").alias("title"),
    )


def incidents(spark, sf_dir) -> DataFrame:
    vec = c("vec_id")
    cause = tagged("cause ", vec)
    resolution = F.when(vec % 5 == 0, F.concat(lit("known fix "), vec.cast("string")))
    document = F.to_json(F.struct(
        F.concat(lit("detailed "), cause).alias("root_cause"), F.array(cause).alias("evidence"),
        F.array().cast("array<struct<action:string,priority:int,estimated_effort:string,automated:boolean>>")
        .alias("recommendations"), lit(None).cast("string").alias("resolution"),
    ), {"ignoreNullFields": "false"})
    return table(spark, sf_dir, "embeddings").select(
        tagged("inc_", vec).alias("incident_id"), tagged("dag_", vec % 20).alias("dag_id"),
        tagged("task_", vec % 7).alias("task_id"), tagged("old_", vec).alias("run_id"),
        pick(CATEGORIES, c("label") % 10).alias("error_category"), pick(SEVERITIES, vec % 4).alias("severity"),
        lit(0.6).alias("confidence"),
        F.timestamp_seconds(F.unix_timestamp(lit("2023-12-01 00:00:00")) + vec * 3600).alias("date"),
        cause.alias("root_cause_summary"), document.alias("document"), resolution.alias("resolution"), "embedding",
    )


def resolutions(spark, sf_dir) -> DataFrame:
    return events(spark, sf_dir, "click").select(
        c("event_id").alias("update_id"), tagged("inc_", c("event_id") % 700).alias("incident_id"),
        tagged("fix ", c("event_id")).alias("resolution"), instant("ts").alias("updated_at"),
    )


def replies(spark, sf_dir) -> DataFrame:
    """Every turn as a model reply: fenced, bare, within prose, with a confidence out of range, or no JSON at all."""
    n = c("conv_id") + c("turn")
    priority = pick([None if p is None else f',"priority":{p}' for p in PRIORITIES], (c("conv_id") * 7 + c("turn")) % 8)
    text = F.to_json(F.struct(c("text").alias("t")))
    body = F.concat(
        lit('{"error_category":"'), pick(CATEGORIES, n % 10), lit('","severity":"'), pick(SEVERITIES, n % 4),
        lit('","root_cause":'), F.expr("substring(t, 6, length(t) - 6)"), lit(',"root_cause_summary":"turn '),
        c("turn").cast("string"), lit('","confidence":'),
        F.when(n % 5 == 3, "1.5").otherwise(F.concat(lit("0."), (n % 9 + 1).cast("string"))),
        lit(',"evidence":["e'), c("turn").cast("string"), lit('","f"],"recommendations":[{"action":"check '),
        c("conv_id").cast("string"), lit('"'), F.coalesce(priority, lit("")), lit('}],"immediate_action":'),
        F.when(n % 2 == 0, '"stop"').otherwise("null"), lit("}"),
    )
    raw = (
        F.when(n % 5 == 0, F.concat(lit("Here it is:\n```json\n"), body, lit("\n```\nDone.")))
        .when(n % 5 == 1, body).when(n % 5 == 2, F.concat(lit("I think "), body, lit(" is right")))
        .when(n % 5 == 3, body).otherwise(c("text"))
    )
    return table(spark, sf_dir, "conversations").withColumn("t", text).select("conv_id", "turn", raw.alias("raw"))


def dags(spark, sf_dir) -> DataFrame:
    return events(spark, sf_dir).select(dag_of().alias("dag_id")).distinct()


def dag_files(spark, sf_dir) -> DataFrame:
    """A page is a source file; its name or its text may point to a DAG."""
    n, kind = (c("page_id") % 23).cast("string"), c("page_id") % 5
    page = c("page_id").cast("string")
    path = (
        F.when(kind == 0, F.concat(lit("proj/dags/team/etl_dag_"), n, lit("x"), page, lit(".py")))
        .when(kind == 1, F.concat(lit("jobs"), page, lit("/dag_"), n, lit(".py")))
        .when(kind == 2, F.concat(lit("jobs"), page, lit("/dag_dag_"), n, lit(".py")))
        .when(kind == 3, F.concat(lit("jobs"), page, lit("/dag_"), n, lit("_dag.py")))
        .otherwise(F.concat(lit("misc/page_"), page, lit(".py")))
    )
    quoted = F.when(kind == 4, F.concat(lit('\nwith DAG(dag_id="dag_'), n, lit('"):'))).otherwise("")
    return table(spark, sf_dir, "pages").select(path.alias("path"), F.concat(c("html"), quoted).alias("content"))


def payloads(spark, sf_dir) -> DataFrame:
    """Failures as raw callback lines; of every ten one is cut off, one lacks its task and one has no proper date."""
    kind = c("event_id") % 10
    instant_text = F.date_format("failed_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    line = F.to_json(F.struct(
        "event_id", "dag_id", F.when(kind != 1, c("task_id")).alias("task_id"), "run_id",
        F.when(kind == 2, lit("yesterday")).otherwise(instant_text).alias("execution_date"), "state", "try_number",
        c("error_message").alias("exception"),
        F.date_format("failed_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("arrived_at"),
    ))
    broken = F.when(c("event_id") % 10 == 0, F.substring(line, 1, 20)).otherwise(line)
    return failures(spark, sf_dir).select("event_id", broken.alias("value"))


def ts_text(name: str | Column) -> Column:
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def joined(array: str | Column, separator: str = "|") -> Column:
    return F.array_join(array, separator)

