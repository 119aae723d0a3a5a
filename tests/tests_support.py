"""Small inputs shared by test modules."""

import datetime as dt

from faultline.plans import triage as plan

T0 = dt.datetime(2024, 1, 15, 10, 0)


def small_tables(spark, **extra):
    instances = spark.createDataFrame([("d", "r1", "t", "failed", T0, T0, 0.0, 1, 3, None, None, None)],
        "dag_id string, run_id string, task_id string, state string, start_date timestamp, end_date timestamp, "
        "duration_seconds double, try_number int, max_tries int, operator string, pool string, queue string")
    logs = spark.createDataFrame([("d", "r1", "t", 1, "a\njava.lang.OutOfMemoryError: Java heap space"), ("d", "r2", "t", 1, "x")],
        "dag_id string, run_id string, task_id string, try_number int, stdout string")
    runs = spark.createDataFrame([("d", "r1", "failed", T0, 5.0)],
        "dag_id string, run_id string, state string, execution_date timestamp, duration_seconds double")
    return plan.Tables(instances, logs, runs, **extra)


def failure_frame(spark):
    return spark.createDataFrame(
        [("d", "t", "r1", 1, T0, None, "failed"), ("d", "t", "r2", 1, T0, "m", "failed"), ("d", "t", "r3", 1, T0, "m", "failed")],
        "dag_id string, task_id string, run_id string, try_number int, failed_at timestamp, error_message string, state string")
