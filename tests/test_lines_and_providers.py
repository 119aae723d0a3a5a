"""Line-wise logs against whole texts, and providers that fail."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from checks.views import TEMPLATES
from faultline.operators import commits, context, logs
from faultline.plans import triage as plan
from faultline.sources import readers
from tests_support import failure_frame, small_tables

T0 = dt.datetime(2024, 1, 15, 10, 0)


def texts():
    draw = random.Random(4)
    pieces = [*TEMPLATES, "plain work", "  indented", "", " \t", "Café   odd", "killed", "x" * 300, "　wide", "tail\r"]
    made = ["\n".join(draw.choice(pieces) for _ in range(draw.choice([1, 3, 12, 70, 200]))) for _ in range(60)]
    return made + ["", "\n\n", "  \n error \n  ", "one line", "\n" * 30 + "Connection refused" + "\n" * 2100, "y\n" * 3000,
                   "error\n" + "z" * 100_000, "x" * 99_999]


def test_lines_say_what_texts_say(spark):
    rows = spark.createDataFrame(list(enumerate(texts())), "id int, stdout string")
    whole = logs.match_logs(logs.profile_logs(rows)).withColumn("stdout_tail", logs.tail_chars(F.col("stdout")))
    lines = logs.explode_lines(rows, ["id"], stripped=False).repartition(7)
    names = ["log_lines", "truncated", "error_snippet", "key_log_lines", "stdout_tail"]
    listed = lambda m: [(f.sig_idx, f.name, f.severity, f.recommendation, list(f.matches)[:10]) for f in m]
    want = {r.id: (*[r[n] for n in names], listed(r.matches)) for r in whole.collect()}
    got = {r.id: (*[r[n] for n in names], listed(r.matches)) for r in logs.profile_lines(lines, ["id"]).collect()}
    assert set(got) == set(want)
    for i, expected in want.items():
        assert got[i] == expected, texts()[i]


def test_long_snippets_keep_both_ends(spark):
    body = ["error first"] + [f"line {i}" for i in range(1000)] + ["killed last"]
    rows = spark.createDataFrame([(1, "\n".join(body))], "id int, stdout string")
    got = logs.profile_lines(logs.explode_lines(rows, ["id"], stripped=False), ["id"], snippet_lines=40).first().error_snippet
    assert got.split("\n") == [*body[:20], "... 962 lines left out ...", *body[-20:]]


def test_lines_list_all_matches_and_snippets_in_full(spark):
    body = ["error first", *[f"Connection refused {i}" for i in range(25)], *[f"line {i}" for i in range(21_000)], "killed last"]
    rows = spark.createDataFrame([(1, "\n".join(body))], "id int, stdout string")
    whole = logs.match_logs(logs.profile_logs(rows)).first()
    got = logs.profile_lines(logs.explode_lines(rows, ["id"], stripped=False).repartition(5), ["id"]).first()
    assert got.matches == whole.matches and max(len(m.matches) for m in got.matches) >= 25
    assert got.error_snippet == whole.error_snippet == "\n".join(body)


def test_files_are_numbered_by_many_tasks(spark, tmp_path):
    """Files of several splits and of one, with runs of empty lines and odd line ends."""
    draw = random.Random(6)
    files = {}
    for no, count in enumerate([1, 30, 5000, 20_000, 0]):
        folder = tmp_path / f"dags/d+{no}/dagRuns/r+{no}/taskInstances/t/logs"
        os.makedirs(folder)
        files[f"d+{no}"] = [draw.choice(["", f"line {i} " + "w" * draw.randint(0, 40), "carriage\rreturn", "é x"]) for i in range(count)]
        (folder / "2").write_text("".join(x + "\n" for x in files[f"d+{no}"][:-1]) + "".join(files[f"d+{no}"][-1:]), "utf-8", newline="")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "32k")
    try:
        lines = readers.read_log_lines(spark, str(tmp_path))
        table = [r for r in lines.collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert {(r.task_id, r.try_number) for r in table} == {("t", 2)} and all(r.run_id == "r" + r.dag_id[1:] for r in table)
    for name, body in files.items():
        found = sorted((r.line_no, r.line) for r in table if r.dag_id == name)
        # A last line without text and without a line end is no line.
        body = body[:-1] if body and not body[-1] else body
        assert found == list(enumerate(body))


def test_triage_of_lines_holds_no_text(spark):
    some = small_tables(spark)
    lines = logs.explode_lines(some.task_logs, context.LOG_KEYS, stripped=False)
    by_line = plan.Tables(some.task_instances, None, some.dag_runs, log_lines=lines.drop("stdout"))
    assert plan.triage(failure_frame(spark), by_line).collect() == plan.triage(failure_frame(spark), some).collect()
    sized = lines.withColumn("line", F.substring("line", 1, 100_000))
    contexts = plan.build_context(failure_frame(spark), plan.Tables(some.task_instances, None, some.dag_runs, log_lines=sized))
    assert "stdout" not in contexts.drop("stdout_tail").columns


def good(rows):
    return rows.groupBy("failure_id").agg(F.count("*").alias("n"))


def raises(rows):
    raise RuntimeError("no route\nsecond line")


def no_such_column(rows):
    return rows.select("failure_id", "absent")


def fails_in_task(rows):
    return rows.select("failure_id", F.raise_error(F.lit("late")).cast("string").alias("answer"))


def test_a_failing_provider_fails_nothing(spark):
    providers = {"a": raises, "b": good, "c": no_such_column, "d": context.Declared(fails_in_task, "answer string, n int"), "e": good}
    rows = plan.build_context(failure_frame(spark), small_tables(spark), providers=providers)
    assert dict(rows.dtypes)["d"] == "struct<answer:string,n:int>" and dict(rows.dtypes)["b"] == "struct<n:bigint>"
    for r in rows.collect():
        assert (r.a, r.c, r.d, r.b.n, r.e.n) == (None, None, None, 1, 1)
        assert [e.split(" ")[0] for e in r.errors][-3:] == ["a", "c", "d"] and r.errors[-3] == "a collection failed: no route"
    report = plan.triage(failure_frame(spark), small_tables(spark), providers=providers).collect()
    assert len(report) == 1


def test_providers_see_narrow_rows(spark):
    seen = []
    plan.build_context(failure_frame(spark), small_tables(spark), providers={"p": lambda rows: seen.append(rows.columns) or good(rows)})
    assert "failure_id" in seen[0] and "stdout_tail" not in seen[0] and "dag_history" not in seen[0]


@pytest.mark.parametrize("known", [True, False])
def test_commits_of_the_failures_repository(spark, known):
    at = lambda h: T0 - dt.timedelta(hours=h)
    rows = [(f"{r}{i:02d}", "m", f"repo_{r}", at(i * 0.5), ["dags/x.py"]) for r in "ab" for i in range(30)] * 2
    schema = "sha string, message string, repository string, date timestamp, files_changed array<string>"
    table = readers.shape_commits(spark.createDataFrame(rows, schema).withColumns({"author": F.lit("w"), "email": F.lit("w")}))
    fails = spark.createDataFrame(
        [(1, "repo_a", T0), (2, "repo_b", at(3.25)), (3, None, T0), (4, "repo_c", T0), (5, "repo_a", None), (6, "repo_a", at(20))],
        "id int, repository string, failed_at timestamp").withColumn("dag_file_path", F.lit("dags/x.py"))
    fails = fails if known else fails.drop("repository")
    got = {r.id: [c.sha for c in r.recent_commits] for r in commits.recent_commits(fails, table, hours=6).collect()}
    for r in fails.collect():
        mine = [x for x in rows if r.failed_at and x[3] <= r.failed_at and (not known or x[2] == r.repository)]
        newest = sorted(mine, key=lambda x: (x[3], x[0]), reverse=True)[:20]
        assert got[r.id] == [x[0] for x in newest if x[3] >= r.failed_at - dt.timedelta(hours=6)]
    last = {r.id: r.last_commit and r.last_commit.sha for r in commits.last_commit_asof(fails, table).collect()}
    assert (last[1], last[2]) == (("a00", "b07") if known else ("b00", "b07")) and (last[4] is None) == known


def test_the_file_of_a_dag_names_its_repository(spark):
    files = spark.createDataFrame([("dags/d.py", "x", "repo_a"), ("lib/d.py", "x", "repo_b")], "path string, content string, repository string")
    commits_of = readers.shape_commits(spark.createDataFrame(
        [("s1", "m", "repo_a", T0, ["dags/d.py"]), ("s2", "m", "repo_b", T0, ["dags/d.py"])],
        "sha string, message string, repository string, date timestamp, files_changed array<string>").withColumns(
            {"author": F.lit("w"), "email": F.lit("w")}))
    some = small_tables(spark, commits=commits_of, dag_files=files)
    row = plan.build_context(failure_frame(spark), some).where("run_id = 'r1'").first()
    assert row.repository == "repo_a" and [c.sha for c in row.git.recent_commits] == ["s1"] and row.git.last_commit.sha == "s1"
