"""The incident history: look-up, similar incidents, resolutions, recurrence, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from faultline.functions.text import non_empty
from faultline.functions.vectors import add_vector, fit_vectoriser, similarity_score
from faultline.operators.neighbours import nearest_incidents
from faultline.operators.timeline import DAY, rolling_counts
from faultline.session import settled

# Similar incidents returned, the recurrence window, the display name of the store.
MAX_SIMILAR = 5
RECURRENCE_DAYS = 30


def similar_incidents(
    probes: DataFrame, incidents: DataFrame, k: int = MAX_SIMILAR, category: str | None = None, **options
) -> DataFrame:
    """The k most similar incidents of each probe, with distance, score and rank."""
    found = nearest_incidents(probes, incidents, k, group=category, **options)
    return found.withColumn("similarity_score", similarity_score(F.col("distance")))


def text_similar_incidents(
    probes: DataFrame, incidents: DataFrame, text: str, k: int = MAX_SIMILAR, model=None, features: int = 256, **options
) -> DataFrame:
    """Similar incidents by the distance of their texts.  ``model`` replaces the default vectoriser."""
    model = model or fit_vectoriser(incidents, text, features)
    keep = lambda df: settled(add_vector(df, text, model).drop(text), "vectors")
    return similar_incidents(keep(probes), keep(incidents), k, **options)


def query_text(dag_id: Column, task_id: Column, snippet: Column, message: Column) -> Column:
    error = F.coalesce(non_empty(snippet), message, F.lit(""))
    return F.concat(F.lit("DAG: "), dag_id, F.lit("\nTask: "), task_id, F.lit("\nError: "), error)


def read_back(incidents: DataFrame) -> DataFrame:
    """Adds root_cause and resolution as a reader of the store sees them: from the document, else the metadata."""
    document = F.from_json("document", "root_cause string, resolution string")
    return (
        incidents.withColumn("_doc", document)
        .withColumn("root_cause", F.coalesce("_doc.root_cause", "root_cause_summary"))
        .withColumn("resolution", F.coalesce(non_empty(F.col("_doc.resolution")), non_empty(F.col("resolution"))))
        .drop("_doc")
    )


def similar_lists(found: DataFrame, incidents: DataFrame, probe_id: str = "probe_id", id_col: str = "incident_id") -> DataFrame:
    """One row per probe with ``similar_incidents``, at most k structs, best first."""
    details = read_back(incidents).select(
        F.col(id_col), "date", "dag_id", "task_id", "error_category", "root_cause", "resolution"
    )
    entry = F.struct(
        F.col(id_col).alias("incident_id"), "date", "dag_id", "task_id", "error_category", "root_cause",
        "resolution", "similarity_score",
    )
    listed = found.join(details, id_col).groupBy(probe_id).agg(
        F.sort_array(F.collect_list(F.struct("rank", entry.alias("incident")))).alias("ranked")
    )
    return listed.select(probe_id, F.transform("ranked", lambda x: x["incident"]).alias("similar_incidents"))


def recurrence(found: DataFrame, probes: DataFrame, probe_id: str = "probe_id") -> DataFrame:
    """is_recurring and recurrence_count as the report states them: any, and how many, similar incidents."""
    counts = found.groupBy(probe_id).agg(F.count("*").cast("int").alias("n"))
    return probes.select(probe_id).join(counts, probe_id, "left").select(
        probe_id, F.col("n").isNotNull().alias("is_recurring"), F.coalesce("n", F.lit(0)).alias("recurrence_count")
    )


def recurrence_30d(
    failures: DataFrame, time: str = "failed_at", days: int = RECURRENCE_DAYS
) -> DataFrame:
    """Adds how often the same DAG, task and category failed in [t - 30 days, t)."""
    return rolling_counts(
        failures, ["dag_id", "task_id", "error_category"], time, {"recurrence_30d": F.lit(1)},
        lower_us=-days * DAY * 1_000_000 - 1, upper_us=-1,
    )


def latest_updates(updates: DataFrame) -> DataFrame:
    """The last resolution written per incident; each map task keeps one per incident."""
    return updates.groupBy("incident_id").agg(
        F.max_by("resolution", F.struct("updated_at", "update_id")).alias("_new"),
        F.max("updated_at").alias("_at"),
    )


def apply_resolutions(incidents: DataFrame, updates: DataFrame) -> DataFrame:
    """Sets the resolution in metadata and document of incidents that have an update."""
    joined = incidents.join(latest_updates(updates), "incident_id", "left")
    has_new = F.col("_new").isNotNull()
    document = F.from_json(
        "document",
        "root_cause string, evidence array<string>, "
        "recommendations array<struct<action:string,priority:int,estimated_effort:string,automated:boolean>>, "
        "resolution string",
    )
    rewritten = F.to_json(
        F.struct(
            document["root_cause"].alias("root_cause"), document["evidence"].alias("evidence"),
            document["recommendations"].alias("recommendations"), F.col("_new").alias("resolution"),
        ),
        {"ignoreNullFields": "false"},
    )
    return (
        joined.withColumn("document", F.when(has_new & F.col("document").isNotNull(), rewritten)
                          .otherwise(F.col("document")))
        .withColumn("resolution", F.coalesce("_new", "resolution"))
        .withColumn("resolution_updated", has_new)
        .drop("_new", "_at")
    )


def updatable(updates: DataFrame, incidents: DataFrame) -> DataFrame:
    """Updates that hit a stored incident."""
    return updates.join(incidents.select("incident_id"), "incident_id", "left_semi")


def rejected(updates: DataFrame, incidents: DataFrame) -> DataFrame:
    """Updates for unknown incidents: nothing is written for them."""
    return updates.join(incidents.select("incident_id"), "incident_id", "left_anti")


def unresolved(incidents: DataFrame, updates: DataFrame) -> DataFrame:
    """Incidents without a resolution of their own or by update."""
    return incidents.where(non_empty(F.col("resolution")).isNull()).join(
        updates.select("incident_id"), "incident_id", "left_anti"
    )


def new_incidents(existing: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidates whose id is not stored yet, one per id, the earliest first."""
    fresh = candidates.join(existing.select("incident_id"), "incident_id", "left_anti")
    others = [c for c in candidates.columns if c != "incident_id"]
    first = F.min_by(F.struct(*others), F.struct("date", "root_cause_summary"))
    return fresh.groupBy("incident_id").agg(first.alias("_row")).select("incident_id", "_row.*").select(
        *candidates.columns
    )


def append_incidents(existing: DataFrame, candidates: DataFrame) -> DataFrame:
    return existing.unionByName(new_incidents(existing, candidates), allowMissingColumns=True)


def incident_statistics(incidents: DataFrame, collection: str = "incidents") -> DataFrame:
    return incidents.agg(F.count("*").alias("total_incidents")).withColumn("collection_name", F.lit(collection))


def incident_distribution(incidents: DataFrame, cube: bool = False) -> DataFrame:
    """Counts by category, severity and DAG with all subtotals; ``level`` is the grouping id."""
    by = ["error_category", "severity", "dag_id"]
    grouped = incidents.cube(*by) if cube else incidents.rollup(*by)
    return grouped.agg(F.count("*").alias("incidents"), F.grouping_id().cast("bigint").alias("level"))


def incident_lookup(incidents: DataFrame, incident_id: str) -> DataFrame:
    return incidents.where(F.col("incident_id") == incident_id)


# --- documents -------------------------------------------------------------------------------------------------------


def incident_text(reports: DataFrame) -> Column:
    """The text that describes a report: ids, category, cause, at most 3 evidence items and 5 key lines."""
    evidence = F.when(F.size("evidence") > 0, F.concat(
        F.lit("Evidence: "), F.array_join(F.slice("evidence", 1, 3), "; ")))
    lines = F.when(F.size("key_log_lines") > 0, F.concat(
        F.lit("Key logs: "), F.array_join(F.slice("key_log_lines", 1, 5), " ")))
    return F.concat_ws(
        "\n", F.concat(F.lit("DAG: "), F.col("dag_id")), F.concat(F.lit("Task: "), F.col("task_id")),
        F.concat(F.lit("Category: "), F.col("error_category")),
        F.concat(F.lit("Root cause: "), F.col("root_cause")), evidence, lines,
    )


def incident_document(resolution: Column | None = None) -> Column:
    resolution = F.lit(None).cast("string") if resolution is None else resolution
    return F.to_json(
        F.struct("root_cause", "evidence", "recommendations", resolution.alias("resolution")),
        {"ignoreNullFields": "false"},
    )


def incident_records(reports: DataFrame, resolution: Column | None = None, with_text: bool = False) -> DataFrame:
    """Reports as incident rows, keyed by the report id; ``with_text`` adds the text that a vector is made of."""
    text = [incident_text(reports).alias("_text")] if with_text else []
    kept = F.lit(None).cast("string") if resolution is None else non_empty(resolution)
    return reports.select(
        F.col("report_id").alias("incident_id"), "dag_id", "task_id", "run_id", "error_category", "severity",
        "confidence", F.col("failure_time").alias("date"), "root_cause_summary",
        incident_document(resolution).alias("document"), kept.alias("resolution"), *text,
    )
