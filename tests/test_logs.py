import gzip
import json

import pytest
from pyspark.sql import functions as F

from helpers import job, requests_of, rows_of, state_of, state_row
from jobtide.operators.logs import (
    ERROR_TEXT, assemble_logs, broken_logs, clean_lines, log_chunks, log_paths, parse_lines,
)
from jobtide.sources.logs import read_archived_logs, read_log_lines

LINES = "job_id string, part long, line_no long, line string"
ARCHIVED = "job_id string, part long, line_no long, line string, open_ended boolean"


def envelope(content):
    return json.dumps({"result": {"content": content}})


def lines_of(spark, *rows):
    """Rows of (job number, line number, line)."""
    return spark.createDataFrame([(job(n), 0, at, line) for n, at, line in rows], LINES)


def test_clean_lines(spark):
    raw = ["", "  ", "\u00a0", envelope("a"), envelope("b") + "\r", envelope(""), envelope("x argo=true y"),
           envelope("ARGO=true"), "  " + envelope("c")]
    parsed = parse_lines(lines_of(spark, *[(1, i, line) for i, line in enumerate(raw)]))
    assert rows_of(clean_lines(parsed), "line_no", "content") == [
        (3, "a"), (4, "b"), (5, ""), (7, "ARGO=true"), (8, "c")]
    assert broken_logs(parsed).count() == 0


@pytest.mark.parametrize("line", [
    "nope", "{}", '{"result":{}}', '{"result":{"content":5}}', '{"result":{"content":null}}',
    envelope("a") + " x", '{"result":"a"}'])
def test_malformed_lines(spark, line):
    parsed = parse_lines(lines_of(spark, (1, 0, line), (2, 0, envelope("fine"))))
    assert rows_of(broken_logs(parsed)) == [(job(1),)]


def logged_jobs(spark):
    return state_of(
        spark,
        state_row(1), state_row(2, "Error"), state_row(3, archived=True),
        state_row(4, archived=True, remote_uid=None), state_row(5, workflow_name=None, status=None),
        state_row(6), state_row(7, "Succeeded"), state_row(8, "Error", archived=True),
        state_row(9, archived=True))


def test_assemble_logs(spark):
    lines = lines_of(
        spark,
        *[(1, i, envelope(f"l{i}")) for i in range(9)], (1, 9, envelope("argo=true")),
        (2, 0, envelope("hidden")), (3, 0, envelope("hidden")),
        (6, 0, envelope("fine")), (6, 1, "broken"), (99, 0, envelope("nobody asks")))
    archived = spark.createDataFrame([
        (job(3), 0, 0, "raw argo=true", False), (job(3), 0, 1, "", False), (job(3), 0, 2, "last \r", True),
        (job(1), 0, 0, "no", False),
    ], ARCHIVED)
    asked = [(n, n, f"s{n}") for n in range(1, 11)] + [(11, 1, "s1"), (12, 1, "x"), (13, 3, "x")]
    answers, chunks = assemble_logs(
        requests_of(spark, *asked), logged_jobs(spark), lines, archived, chunk_lines=4)
    assert [tuple(r) for r in answers.orderBy("pos").collect()] == [
        (1, job(1), "OK", "LINES", None),
        (2, job(2), "OK", "ERROR_TEXT", ERROR_TEXT),
        (3, job(3), "OK", "ARCHIVED", None),
        (4, job(4), "OK", "NONE", ""),
        (5, job(5), "OK", "NONE", ""),
        (6, job(6), "OK", "LINES", None),
        (7, job(7), "OK", "LINES", None),
        (8, job(8), "OK", "ERROR_TEXT", ERROR_TEXT),
        (9, job(9), "OK", "ARCHIVED", None),
        (10, job(10), "NOT_FOUND", None, None),
        (11, job(1), "OK", "LINES", None),
        (12, job(1), "UNAUTHORIZED", None, None),
        (13, job(3), "UNAUTHORIZED", None, None)]
    assert [tuple(r) for r in chunks.orderBy("job_id", "part", "chunk", "section").collect()] == [
        (job(1), 0, 0, 0, "l0\nl1\nl2\nl3\n", False),
        (job(1), 0, 1, 0, "l4\nl5\nl6\nl7\n", False),
        (job(1), 0, 2, 0, "l8\n", False),
        (job(3), 0, 0, 0, "raw argo=true\n\nlast \r", False),
        (job(6), 0, 0, 0, None, True),
        (job(7), 0, 0, 0, "", False),
        (job(9), 0, 0, 0, "", False)]


def test_each_log_table_is_read_once_and_only_for_wanted_jobs(spark, tmp_path):
    lines_of(spark, (1, 0, envelope("a")), (1, 1, "broken"), (6, 0, envelope("b"))).write.parquet(str(tmp_path / "live"))
    spark.createDataFrame([(job(3), 0, 0, "x", False)], ARCHIVED).write.parquet(str(tmp_path / "kept"))
    _, chunks = assemble_logs(
        requests_of(spark, *[(n, n, f"s{n}") for n in (1, 3, 6)]), logged_jobs(spark),
        spark.read.parquet(str(tmp_path / "live")), spark.read.parquet(str(tmp_path / "kept")))
    assert {r.job_id: r.text for r in chunks.collect()} == {job(1): None, job(3): "x\n", job(6): "b\n"}
    # places of files are cut to this length in a plan
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    final = chunks._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    final = final[:final.index("Initial Plan")]
    # a reused exchange shows what it reuses by number only
    read = [part for part in final.split("FileScan parquet")[1:]]
    assert sum("/live" in part.split("\n")[0] for part in read) == 1
    assert sum("/kept" in part.split("\n")[0] for part in read) == 1
    # the jobs are joined below the parse
    above = final[:final.index("/live")].lower()
    assert above.rindex("join") > above.rindex("parsejson")


def test_long_chunks_come_in_sections(spark):
    pieces = spark.createDataFrame(
        [(job(1), 0, i, "x" * n) for i, n in enumerate([3, 3, 3, 20, 1, 1, 4])] + [(job(2), 0, 0, "y")],
        "job_id string, part long, line_no long, piece string")
    chunks = log_chunks(pieces, chunk_lines=5, chunk_bytes=8)
    assert [tuple(r) for r in chunks.orderBy("job_id", "chunk", "section").collect()] == [
        (job(1), 0, 0, 0, "x" * 9), (job(1), 0, 0, 1, "x" * 20), (job(1), 0, 0, 3, "x"),
        (job(1), 0, 1, 0, "x" * 5), (job(2), 0, 0, 0, "y")]


def test_log_paths(spark):
    paths = log_paths(state_of(
        spark, state_row(1), state_row(2, "Error"), state_row(3, archived=True),
        state_row(4, archived=True, workflow_name=None), state_row(5, archived=True, remote_uid=None),
        state_row(6, workflow_name=None)), "space")
    assert rows_of(paths, "source", "log_path", "job_id", order="kept")[0][0] == "LINES"
    assert {r.job_id: r.log_path for r in paths.collect()} == {
        job(1): "/api/v1/workflows/space/wf-1/log?logOptions.container=main", job(2): None,
        job(3): f"/artifact-files/space/archived-workflows/{job(903)}/wf-3/outputs/main-logs",
        job(4): f"/artifact-files/space/archived-workflows/{job(904)}//outputs/main-logs",
        job(5): None, job(6): None}


def whole_logs(chunks):
    ordered = chunks.orderBy("job_id", "part", "chunk", "section").collect()
    texts = {}
    for row in ordered:
        texts[row.job_id] = texts.get(row.job_id, "") + row.text
    return texts


def test_logs_from_files_keep_every_byte(spark, tmp_path):
    running = [f"step {i} " + "y" * (i % 29) for i in range(3000)]
    archived = "".join(f"raw {i}\r\n" for i in range(3000))
    texts = {3: archived + "open end", 9: archived, 10: "\n", 11: "", 12: "\ufeffmarked"}
    packed = {13: archived + "open end", 14: archived}
    (tmp_path / "live").mkdir()
    (tmp_path / "kept").mkdir()
    (tmp_path / "live" / f"{job(1)}.log").write_text(
        "\r\n".join(envelope(line) for line in running) + "\r\n")
    for number, text in texts.items():
        (tmp_path / "kept" / f"{job(number)}.log").write_bytes(text.encode())
    for number, text in packed.items():
        (tmp_path / "kept" / f"{job(number)}.log.gz").write_bytes(gzip.compress(text.encode()))
    texts |= packed
    state = state_of(spark, state_row(1), *[state_row(n, archived=True) for n in texts])
    asked = requests_of(spark, (0, 1, "s1"), *[(n, n, f"s{n}") for n in texts])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        _, chunks = assemble_logs(
            asked, state, read_log_lines(spark, str(tmp_path / "live")),
            read_archived_logs(spark, str(tmp_path / "kept")), chunk_lines=100)
        chunks = chunks.cache()
        seen = whole_logs(chunks)
        longest = chunks.agg(F.max(F.length("text"))).first()[0]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert seen[job(1)] == "".join(line + "\n" for line in running)
    assert {n: seen[job(n)] for n in texts} == {n: t.lstrip("\ufeff") for n, t in texts.items()}
    assert longest < 100 * 45


def test_one_long_log_is_spread_over_tasks(spark):
    pieces = spark.range(100_000).select(
        F.lit(job(1)).alias("job_id"), F.lit(0).cast("long").alias("part"),
        F.col("id").alias("line_no"), F.lit("x\n").alias("piece"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        chunks = log_chunks(pieces, chunk_lines=1000)
        sizes = chunks.groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sum(r["count"] for r in sizes) == 100 and len(sizes) == 8
