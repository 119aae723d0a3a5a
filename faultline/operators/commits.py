"""Commits near a failure, and the file that defines a DAG."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from faultline import schemas
from faultline.operators.timeline import HOUR, Timeline, asof_join, last_rows, segmented_scan
from faultline.session import settled

# Look-back, commits read per repository and per file.
LOOKBACK_HOURS = 24
MAX_COMMITS = 20
MAX_FILE_COMMITS = 10
# Where the file of DAG X may be, by falling priority, then the text that names it.
#   **/dags/**/*X*.py   **/X.py   **/dag_X.py   **/X_dag.py   dag_id="X"


def commit_struct() -> Column:
    return F.struct("sha", "short_sha", "author", "email", "message", "date", "files_changed")


def repository_of(failures: DataFrame, commits: DataFrame) -> list[str]:
    """The key of a commit's time line: its repository, where both sides know it."""
    return ["repository"] if "repository" in failures.columns and "repository" in commits.columns else []


def recent_commits(
    failures: DataFrame, commits: DataFrame, time: str = "failed_at", hours: int = LOOKBACK_HOURS,
    limit: int = MAX_COMMITS,
) -> DataFrame:
    """Adds ``recent_commits``: the newest commits of the failure's repository in the ``hours`` before it.

    Where only one side has a column ``repository``, all commits are of one repository.  Commits are numbered in theirs;
    each distinct instant asked for finds the number reached by then, the failures take it, and their lists are slices of blocks of
    numbered commits (``last_rows``).  The failures are shuffled twice, so they should be narrow.
    """
    on = repository_of(failures, commits)
    numbered = settled(segmented_scan(
        commits.where("date IS NOT NULL").select(
            *on, F.lit(0).alias("_all"), commit_struct().alias("commit"), F.col("date").alias("_date"), F.col("sha").alias("_sha"),
            F.lit(1).cast("bigint").alias("n")),
        on or ["_all"], ["_date", "_sha"], totals={"n": "n"}), "commits")
    points = failures.select(*on, F.col(time).alias("_at")).where("_at IS NOT NULL").distinct()
    line = Timeline(numbered, "_date", {"_n": F.col("n")}, ("_sha", "n"))
    reached = asof_join(points, [line], on, "_at").where("_n IS NOT NULL").select(
        *[F.col(k).alias(f"_{k}") for k in on], "_at", "_n")
    same = [F.col(k) == F.col(f"_{k}") for k in on] + [F.col(time) == F.col("_at")]
    columns = [c for c in failures.columns if c != "recent_commits"]
    asked = failures.select(*columns).join(reached, same, "left").select(*columns, F.lit(0).alias("_all"), "_n")
    found = last_rows(
        asked, numbered.select(*(on or ["_all"]), "n", F.col("commit").alias("value")), on or ["_all"], "_n", limit, "_newest")
    since = F.col(time) - F.expr(f"INTERVAL {hours} HOURS")
    listed = F.filter(F.col("_newest"), lambda c: c["date"] >= since)
    none = F.array().cast(f"array<{schemas.COMMIT}>")
    return found.select(*columns, F.coalesce(listed, none).alias("recent_commits"))


def commit_scan(commits: DataFrame, repository: str, position: str, since: str, limit: int = MAX_COMMITS) -> DataFrame:
    """The commits a scan in log order reads: the first ``limit`` of each repository, up to the first too old one."""
    log_order = Window.partitionBy(repository).orderBy(position)
    head = commits.withColumn("rank", F.row_number().over(log_order)).where(F.col("rank") <= limit)
    too_old = (F.col("date") < F.col(since)).cast("int")
    stopped = F.max(too_old).over(Window.partitionBy(repository).orderBy("rank"))
    return head.withColumn("_stopped", stopped).where("_stopped = 0").drop("_stopped")


def file_commits(commits: DataFrame, limit: int = MAX_FILE_COMMITS) -> DataFrame:
    """The newest commits per changed file."""
    touched = commits.withColumn("file", F.explode(F.array_distinct("files_changed")))
    newest = Window.partitionBy("file").orderBy(F.col("date").desc(), F.col("sha").desc())
    return touched.withColumn("rank", F.row_number().over(newest)).where(F.col("rank") <= limit)


def last_commit_asof(
    failures: DataFrame, commits: DataFrame, file: str = "dag_file_path", time: str = "failed_at"
) -> DataFrame:
    """Adds ``last_commit``, the newest commit to the DAG's file (in its repository, if known) at or before the failure,
    and the hours since."""
    on = [*repository_of(failures, commits), file]
    touched = commits.select(F.explode(F.array_distinct("files_changed")).alias(file), "*")
    timeline = Timeline(touched, "date", {"last_commit": commit_struct()}, ("sha",))
    joined = asof_join(failures, [timeline], on, time)
    seconds = (F.unix_micros(F.col(time)) - F.unix_micros(F.col("last_commit.date"))) / 1_000_000
    return joined.withColumn("hours_since_last_change", seconds / HOUR)


def suspect_regressions(
    failures: DataFrame, commits: DataFrame, file: str = "dag_file_path", time: str = "failed_at",
    hours: int = LOOKBACK_HOURS,
) -> DataFrame:
    """Failures whose own DAG file changed within the look-back."""
    return last_commit_asof(failures, commits, file, time).where(F.col("hours_since_last_change") <= hours)


def resolve_dag_files(dags: DataFrame, files: DataFrame) -> DataFrame:
    """dag_id with the path of its file, or null; the smallest path of the best priority wins.

    Every test is an equality: a path offers the names it could define (each piece of its base name under a ``dags``
    folder, the base name itself, without prefix, without suffix, and the ids quoted in its text), and these
    join with the ids.  Only pieces as long as some id are offered.  Files that know their ``repository`` hand it on.
    """
    wanted = dags.select("dag_id").where(F.col("dag_id").isNotNull()).distinct()
    lengths = wanted.agg(F.sort_array(F.collect_set(F.length("dag_id")))).scalar()
    stem = F.regexp_extract("path", r"([^/]*)\.py$", 1)
    is_python = F.col("path").rlike(r"\.py$")
    in_dags = F.col("path").rlike(r"(^|/)dags/.*\.py$")
    where_from = ["repository"] if "repository" in files.columns else []
    shaped = files.select(
        "path", *where_from, stem.alias("stem"), is_python.alias("is_python"), in_dags.alias("in_dags"), lengths.alias("lengths"),
        F.regexp_extract_all("content", F.lit(r'dag_id="([^"\n]*)"'), F.lit(1)).alias("quoted"),
    )
    no_names = F.array().cast("array<string>")

    def pieces(text: Column) -> Column:
        by_length = F.transform(
            F.filter(F.col("lengths"), lambda size: size <= F.length(text)),
            lambda size: F.transform(
                F.sequence(F.lit(1), F.length(text) - size + 1), lambda begin: F.substring(text, begin, size)
            ),
        )
        return F.array_distinct(F.flatten(by_length))

    def offer(condition: Column, names: Column, priority: int) -> Column:
        return F.transform(
            F.when(condition, names).otherwise(no_names),
            lambda name: F.struct(name.alias("dag_id"), F.lit(priority).alias("priority")),
        )

    name = F.col("stem")
    offers = F.concat(
        offer(F.col("in_dags"), pieces(name), 1),
        offer(F.col("is_python"), F.array(name), 2),
        offer(F.col("is_python") & name.startswith("dag_"), F.array(F.substr(name, F.lit(5))), 3),
        offer(F.col("is_python") & name.endswith("_dag"),
              F.array(F.substr(name, F.lit(1), F.length(name) - 4)), 4),
        offer(F.size("quoted") > 0, F.array_distinct("quoted"), 5),
    )
    offered = shaped.select("path", *where_from, F.explode(offers).alias("offer")).select("path", *where_from, "offer.*")
    best = offered.join(wanted, "dag_id", "left_semi").groupBy("dag_id").agg(
        F.min(F.struct("priority", "path", *where_from)).alias("best")
    )
    return wanted.join(best, "dag_id", "left").select(
        "dag_id", F.col("best.path").alias("dag_file_path"), F.col("best.priority").alias("priority"),
        *[F.col(f"best.{c}").alias(c) for c in where_from]
    )
