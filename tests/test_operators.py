import json
import random
from datetime import datetime

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from helpers import AS_OF, END, START, job, requests_of, rows_of, state_of, state_row
from jobtide.operators.deletes import delete_jobs, delete_targets, mark_deleted
from jobtide.operators.lookup import failed_jobs, found_jobs, lookup_jobs, public_rows
from jobtide.operators.manifests import (
    result_answers, result_manifest, upload_manifest, with_urls,
)
from jobtide.operators.sinks import read_answers, save_state_table, write_answers, write_state
from jobtide.operators.submissions import (
    apply_submissions, build_parameters, plan_submissions, submission_documents,
)
from jobtide.schemas import STATE_COLUMNS
from jobtide.sources.configs import parse_starts

EPOCH = datetime(1970, 1, 1)


def jobs(spark):
    return state_of(
        spark,
        state_row(1, "Running"), state_row(2, "Succeeded"), state_row(3, "Failed"),
        state_row(4, None, started=None, updated=None, workflow_name=None, remote_uid=None),
        state_row(5, "Pending"), state_row(6, "Error", updated=AS_OF))


# Joins

def test_a_job_most_requests_ask_for_is_split_over_tasks(spark, small_skew):
    asked = spark.range(40_000, numPartitions=4).select(
        F.col("id").alias("pos"),
        F.when(F.col("id") % 10 > 0, F.lit(job(1))).otherwise(
            F.concat(F.lit(job(1)[:-4]), F.lpad((F.col("id") % 50).cast("string"), 4, "0"))).alias("job_id"),
        F.lit("s1").alias("secret"))
    state = spark.range(50).select(
        F.concat(F.lit(job(1)[:-4]), F.lpad(F.col("id").cast("string"), 4, "0")).alias("job_id"),
        F.lit("s1").alias("secret"), F.lit("Running").alias("status"), F.lit(START).alias("started"),
        F.lit(END).alias("updated"), F.lit("n").alias("name"))
    answers = lookup_jobs(asked, state, AS_OF)
    assert answers.where("outcome = 'OK'").count() == 40_000
    answers.collect()
    assert "skew=true" in answers._jdf.queryExecution().executedPlan().toString()


# Lookups

LOOKUPS = [(0, 1, "s1"), (1, 2, "s2"), (2, 9, "s9"), (3, 1, "wrong"), (4, 4, "s4"), (5, 1, "s1"),
           (6, 6, "s6"), (7, 2, "S2"), (8, 4, "wrong"), (9, 3, "s3"), (10, 5, "s5")]


def test_lookup(spark):
    answers = lookup_jobs(requests_of(spark, *LOOKUPS), jobs(spark), AS_OF).cache()
    assert [tuple(r) for r in answers.orderBy("pos").collect()] == [
        (0, job(1), "OK", "RUNNING", START, AS_OF, "sample_1"),
        (1, job(2), "OK", "SUCCESSFUL", START, END, "sample_2"),
        (2, job(9), "NOT_FOUND", None, None, None, None),
        (3, job(1), "UNAUTHORIZED", None, None, None, None),
        (4, job(4), "OMITTED", None, None, None, None),
        (5, job(1), "OK", "RUNNING", START, AS_OF, "sample_1"),
        (6, job(6), "OK", "ERROR", START, AS_OF, "sample_6"),
        (7, job(2), "UNAUTHORIZED", None, None, None, None),
        (8, job(4), "UNAUTHORIZED", None, None, None, None),
        (9, job(3), "OK", "ERROR", START, END, "sample_3"),
        (10, job(5), "OK", "INIT", START, AS_OF, "sample_5"),
    ]
    assert rows_of(found_jobs(answers), "pos") == [(0,), (1,), (10,), (5,), (6,), (9,)]
    assert rows_of(failed_jobs(answers)) == [
        (2, job(9), "NOT_FOUND"), (3, job(1), "UNAUTHORIZED"), (7, job(2), "UNAUTHORIZED"),
        (8, job(4), "UNAUTHORIZED")]


def test_public_rows_leave_out_unstarted(spark):
    assert rows_of(public_rows(jobs(spark)), "job_id", "status") == [
        (job(1), "RUNNING"), (job(2), "SUCCESSFUL"), (job(3), "ERROR"), (job(5), "INIT"),
        (job(6), "ERROR")]


def test_answers_are_written_in_request_order(spark, tmp_path):
    answers = lookup_jobs(requests_of(spark, *reversed(LOOKUPS)), jobs(spark), AS_OF)
    write_answers(answers, str(tmp_path / "out"), ["pos"])
    found = spark.read.json(str(tmp_path / "out" / "list=jobs" / "range=0"))
    assert {"jobID", "jobStatus", "started", "updated", "name", "pos"} == set(found.columns)
    assert found.count() == 6
    assert [line["pos"] for line in written(tmp_path / "out" / "list=failedJobs" / "range=0")] == [2, 3, 7, 8]


def written(folder):
    return [json.loads(line) for part in sorted(folder.glob("part-*")) for line in part.read_text().splitlines()]


def test_answers_are_dealt_in_ranges_in_one_pass(spark, tmp_path):
    out = tmp_path / "out"
    answers = lookup_jobs(requests_of(spark, *reversed(LOOKUPS)), jobs(spark), AS_OF)
    write_answers(answers, str(out), ["pos"], per_range=3)
    folders = sorted((out / "list=failedJobs").glob("range=*"))
    assert [f.name for f in folders] == ["range=0", "range=1", "range=2"]
    assert [[line["pos"] for line in written(f)] for f in folders] == [[2], [3], [7, 8]]
    assert all(set(line) == {"pos", "jobID", "jobStatus"} for f in folders for line in written(f))
    rows = read_answers(spark, str(out))
    assert rows_of(rows.where("list = 'failedJobs'"), "range", "line_no", "pos", "jobStatus") == [
        (0, 0, 2, "NOT_FOUND"), (1, 0, 3, "UNAUTHORIZED"), (2, 0, 7, "UNAUTHORIZED"), (2, 1, 8, "UNAUTHORIZED")]
    assert rows.where("list = 'jobs'").count() == 6
    with pytest.raises(AnalysisException):
        write_answers(answers, str(out), ["pos"])


def test_answers_of_many_bodies_and_none(spark, tmp_path):
    answers = lookup_jobs(requests_of(spark, *LOOKUPS), jobs(spark), AS_OF).withColumn(
        "request_id", F.concat(F.lit("file:/a b="), F.col("pos") % 2))
    write_answers(answers, str(tmp_path / "out"), ["request_id", "pos"], per_range=1)
    found = spark.read.json(str(tmp_path / "out"))
    assert rows_of(found.where("list = 'failedJobs'"), "request_id", "range", "pos") == [
        ("file:/a b=0", 2, 2), ("file:/a b=0", 8, 8), ("file:/a b=1", 3, 3), ("file:/a b=1", 7, 7)]
    write_answers(answers.where("false"), str(tmp_path / "none"), ["pos"])
    assert not list((tmp_path / "none").glob("list=*"))


# Deletes

def delete_one_by_one(requests, secrets):
    left, outcomes = dict(secrets), []
    for pos, number, secret in sorted(requests):
        refused = number in left and left[number] != secret
        removed = number in left and not refused
        outcomes.append((pos, job(number), "UNAUTHORIZED" if refused else "OK", removed))
        if removed:
            del left[number]
    return outcomes, left


def test_delete_equals_one_by_one(spark):
    rng = random.Random(5)
    asked = [(pos, 0 if rng.random() < 0.33 else rng.randrange(40),
              "right" if rng.random() < 0.15 else "wrong") for pos in range(300)]
    known = {n: "right" for n in range(30)}
    state = state_of(spark, *[state_row(n, secret="right") for n in known])
    outcomes, remaining = delete_jobs(requests_of(spark, *asked), state)
    expected, left = delete_one_by_one(asked, known)
    assert [tuple(r) for r in outcomes.orderBy("pos").collect()] == expected
    assert rows_of(remaining, "job_id") == [(job(n),) for n in sorted(left)]
    assert remaining.columns == STATE_COLUMNS


def test_delete_targets(spark):
    state = state_of(
        spark,
        state_row(1, archived=True), state_row(2),
        state_row(3, archived=True, remote_uid=None), state_row(4, workflow_name=None),
        state_row(5))
    asked = requests_of(spark, *[(n, n, f"s{n}") for n in range(1, 5)])
    targets = delete_targets(mark_deleted(asked, state), "ns")
    assert rows_of(targets, "job_id", "delete_path") == [
        (job(1), f"/api/v1/archived-workflows/{job(901)}"),
        (job(2), "/api/v1/workflows/ns/wf-2"), (job(3), None), (job(4), None)]


# Submissions

def starts_of(spark, *rows):
    """Rows of (pos, job number, secret, origin)."""
    config = {"translationTable": 4, "completeGenome": False, "keepContigHeaders": False,
              "minContigLength": 0, "compliant": False}
    bodies = [(pos, origin, json.dumps({"job": {"jobID": job(n), "secret": secret}, "config": config}))
              for pos, n, secret, origin in rows]
    good, rejected = parse_starts(spark.createDataFrame(bodies, "pos long, origin string, body string"))
    assert rejected.count() == 0
    return good


PARAMETERS = "--replicons /data/replicons.tsv --translation-table 4 --gram ?"


def test_build_parameters(spark):
    starts = starts_of(spark, (0, 1, "s1", None))
    assert rows_of(build_parameters(starts), "job_id", "parameters") == [(job(1), PARAMETERS)]


def test_plan_submissions(spark):
    starts = starts_of(spark, (0, 1, "s1", "a.b"), (1, 4, "s4", None), (2, 9, "x", None), (3, 1, "x", "o"))
    plans = plan_submissions(starts, jobs(spark), "annotate", "1.0", "ns")
    rows = [r.asDict() for r in plans.orderBy("pos").collect()]
    assert [r["outcome"] for r in rows] == ["OK", "OK", "NOOP", "UNAUTHORIZED"]
    assert rows[0] == dict(
        pos=0, job_id=job(1), outcome="OK", namespace="ns", resource_kind="WorkflowTemplate",
        resource_name="annotate-1.0", generate_name=f"annotate-{job(1)}-",
        labels=f"jobid={job(1)},name=sample_1,origin=a.b,secret=s1",
        parameters=[f"jobid={job(1)}", f"parameter={PARAMETERS}"])
    assert "origin=Unknown" in rows[1]["labels"]
    assert rows[2]["labels"] is None and rows[3]["parameters"] is None
    body = json.loads(submission_documents(plans.where("pos = 0")).first().body)
    assert body == {
        "namespace": "ns", "resourceKind": "WorkflowTemplate", "resourceName": "annotate-1.0",
        "submitOptions": {"labels": rows[0]["labels"], "parameters": rows[0]["parameters"],
                          "serviceAccount": None, "generateName": f"annotate-{job(1)}-"}}


def test_apply_submissions(spark):
    created = datetime(2024, 4, 30)
    results = spark.createDataFrame([
        (0, job(4), "new-0", START), (1, job(4), "new-1", created), (2, job(9), "x", created),
    ], "pos long, job_id string, name string, creation_timestamp timestamp")
    after = apply_submissions(jobs(spark), results, AS_OF)
    assert after.columns == STATE_COLUMNS and after.count() == 6
    unstarted = dict(started=None, updated=None, workflow_name=None, remote_uid=None)
    changed = dict(unstarted, status="Pending", started=created, updated=AS_OF, workflow_name="new-1")
    assert rows_of(after.where(F.col("job_id") == job(4))) == [state_row(4, **changed)]
    assert rows_of(after.where(F.col("job_id") == job(1))) == [state_row(1)]


def test_spent_submissions_do_not_turn_time_back(spark):
    results = spark.createDataFrame(
        [(5, job(1), "old", START), (9, job(2), "new", START), (7, job(3), "same", START), (1, job(5), "first", START)],
        "pos long, job_id string, name string, creation_timestamp timestamp")
    seen = jobs(spark).withColumn("listed", F.when(F.col("job_id") != job(5), F.lit(7)))
    after = apply_submissions(seen, results, AS_OF, listed="listed")
    assert after.columns == STATE_COLUMNS
    changed = {r.job_id: r.workflow_name for r in after.collect() if r.status == "Pending"}
    assert changed == {job(2): "new", job(5): "first"}
    assert rows_of(after.where(F.col("job_id") == job(3))) == [state_row(3, "Failed")]


# File lists

@pytest.mark.parametrize("strict, outcomes", [
    (False, ["NOT_FINISHED", "OK", "NOT_FOUND", "UNAUTHORIZED", "OK", "NOT_FINISHED"]),
    (True, ["NOT_FINISHED", "OK", "NOT_FOUND", "UNAUTHORIZED", "NOT_FINISHED", "NOT_FINISHED"]),
])
def test_results(spark, strict, outcomes):
    answers = result_answers(requests_of(spark, *LOOKUPS), jobs(spark), strict)
    seen = answers.orderBy("pos").limit(6).collect()
    assert [r.outcome for r in seen] == outcomes
    if not strict:
        assert (seen[4].started, seen[4].updated, seen[4].name) == (EPOCH, EPOCH, "sample_4")


def test_result_manifest(spark):
    answers = result_answers(requests_of(spark, (1, 2, "s2"), (2, 1, "s1"), (3, 2, "s2")), jobs(spark))
    files = result_manifest(answers)
    assert files.count() == 28
    first = rows_of(files.where("pos = 1"), "kind", "key", "filename")
    assert len(first) == 14
    assert ("GFF3", f"jobs/{job(2)}/results/result.gff3", "sample_2.gff3") in first
    assert ("TSVInference", f"jobs/{job(2)}/results/result.inference.tsv", "sample_2.inference.tsv") in first
    url = with_urls(files, "https://s3.org", "b").where("pos = 1 and kind = 'PNGCircularPlot'").first().url
    assert url == (f"https://b.s3.org/jobs/{job(2)}/results/result.png?response-content-disposition="
                   "attachment%3B+filename%3D%22sample_2.png%22")


def test_upload_manifest(spark):
    files = with_urls(upload_manifest(jobs(spark).where(F.col("job_id") == job(1))), "s3.org", "b")
    assert rows_of(files) == [
        (job(1), link, f"jobs/{job(1)}/inputs/{file}", f"http://b.s3.org/jobs/{job(1)}/inputs/{file}")
        for link, file in [("uploadLinkFasta", "fastadata.fasta"), ("uploadLinkProdigal", "prodigal.tf"),
                           ("uploadLinkReplicons", "replicons.tsv")]]


# Stored state

def test_state_versions_are_not_overwritten(spark, tmp_path):
    path = str(tmp_path / "v1")
    write_state(jobs(spark), path)
    assert spark.read.parquet(path).count() == 6
    with pytest.raises(Exception, match="already exists"):
        write_state(jobs(spark), path)


def test_bucketed_state_is_not_shuffled(spark):
    save_state_table(jobs(spark), "job_state", 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        answers = lookup_jobs(requests_of(spark, *LOOKUPS), spark.table("job_state"), AS_OF)
        plan = answers._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("drop table job_state")
    assert plan.count("Exchange") == 1


def test_few_requests_do_not_move_the_state(spark, tmp_path):
    state_path, request_path = str(tmp_path / "state"), str(tmp_path / "requests")
    write_state(state_of(spark, *[state_row(n, secret=f"s{n}") for n in range(3000)]), state_path)
    requests_of(spark, *LOOKUPS).coalesce(1).write.parquet(request_path)
    stored, asked = spark.read.parquet(state_path), spark.read.parquet(request_path)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "8000")
    try:
        plain = lookup_jobs(asked, stored, AS_OF)
        assert "LeftSemi" not in plain._jdf.queryExecution().executedPlan().toString()
        thinned = lookup_jobs(asked, stored, AS_OF, few=True)
        plan = thinned._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "LeftSemi" in plan
        assert rows_of(thinned) == rows_of(plain)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_state_scan_is_pruned_and_filtered(spark, tmp_path):
    path = str(tmp_path / "state")
    write_state(jobs(spark), path)
    plan = public_rows(spark.read.parquet(path))._jdf.queryExecution().executedPlan().toString()
    read = plan[plan.index("ReadSchema"):]
    assert "workflow_name" not in read and "secret" not in read
    assert "IsNotNull(status)" in plan
