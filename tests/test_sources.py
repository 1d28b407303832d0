import bz2
import gzip
import json
from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from helpers import END, job, rows_of
from jobtide.operators.state import flatten_snapshots, latest_state
from jobtide.session import clear_scratch, fresh_path
from jobtide.sources.configs import parse_starts, read_starts
from jobtide.sources.inits import parse_inits, read_inits
from jobtide.sources.logs import read_archived_logs, read_log_lines
from jobtide.sources.requests import parse_requests, read_requests
from jobtide.sources.snapshots import explode_items, parse_snapshots, read_snapshot_lines, read_snapshots
from jobtide.sources.submit_results import parse_submit_results, read_submit_results
from jobtide.sources.text_lines import read_lines


def bodies_of(spark, *bodies):
    return spark.createDataFrame(
        [(f"r{i}", b) for i, b in enumerate(bodies)], "request_id string, body string")


def test_snapshots_explode_in_order(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({
        "metadata": {"x": 1},
        "items": [
            {"metadata": {"name": "w1", "uid": job(1), "labels": {"jobid": job(1)}, "extra": 1},
             "status": {"phase": "Running", "startedAt": "2024-04-01T08:00:00Z"}},
            {"metadata": {"name": "w2", "uid": job(2), "labels": {}},
             "status": {"phase": "Failed", "startedAt": None}},
        ]}, indent=1))
    (tmp_path / "b.json").write_text('{"items": []}')
    (tmp_path / "c.json").write_text('{"items": [')
    items = explode_items(read_snapshots(spark, str(tmp_path)))
    seen = rows_of(items.select(
        F.regexp_extract("snapshot", "([^/]*)$", 1), "pos", "metadata.name", "status.startedAt"))
    assert seen == [
        ("a.json", 0, "w1", "2024-04-01T08:00:00Z"), ("a.json", 1, "w2", None),
        ("c.json", 0, None, None)]
    assert items.where("snapshot_ts is null").count() == 0


def test_snapshot_lines_equal_documents(spark, tmp_path):
    items = [
        {"metadata": {"name": f"w{i}", "uid": job(i), "labels": {"jobid": job(i % 50)}},
         "status": {"phase": "Omitted" if i == 700 else "Running", "startedAt": "2024-04-01T08:00:00Z"}}
        for i in range(1000)]
    (tmp_path / "whole").mkdir()
    (tmp_path / "lines").mkdir()
    (tmp_path / "whole" / "a.json").write_text(json.dumps({"items": items}))
    (tmp_path / "lines" / "a.json").write_text("\n".join(map(json.dumps, items)) + "\n\n")
    documents = read_snapshots(spark, str(tmp_path / "whole"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        lines = read_snapshot_lines(spark, str(tmp_path / "lines"))
        assert lines.rdd.getNumPartitions() > 1
        for on_error in ["quarantine", "prefix"]:
            good, rejects = flatten_snapshots(lines, END, on_error)
            wanted, refused = flatten_snapshots(documents, END, on_error)
            names = ["job_id", "workflow_name"]
            assert rows_of(good, *names) == rows_of(wanted, *names)
            assert rows_of(latest_state(good), *names) == rows_of(latest_state(wanted), *names)
            assert rejects.groupBy("reason").count().collect() == refused.groupBy("reason").count().collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    (tmp_path / "lines" / "a.json").write_text("{broken\n" + json.dumps(items[0]) + "\n")
    _, rejects = flatten_snapshots(read_snapshot_lines(spark, str(tmp_path / "lines")), END)
    assert [r.reason for r in rejects.collect()] == ["bad_document"]


SOUND = {"metadata": {"name": "w", "uid": job(1), "labels": {"jobid": job(1), "secret": "s"}},
         "status": {"phase": "Running", "startedAt": "2024-04-01T08:00:00Z"}}


@pytest.mark.parametrize("part, field, value, reason", [
    ("metadata", "name", 5, "bad_name"), ("metadata", "uid", 5, "bad_uid"),
    ("metadata", "resourceVersion", 5, "bad_resource_version"),
    ("metadata", "labels", {"jobid": job(1), "secret": 7}, "bad_label"),
    ("metadata", "labels", {"jobid": job(1), "x": None}, "bad_label"),
    ("metadata", "labels", "x", "bad_label"), ("status", "phase", 1, "bad_phase"),
    ("status", "startedAt", 7, "bad_started_at"), ("status", "finishedAt", True, "bad_finished_at"),
    ("status", "finishedAt", None, None), ("metadata", "more", 5, None)])
def test_snapshot_values_are_texts(spark, part, field, value, reason):
    item = SOUND | {part: SOUND[part] | {field: value}}
    bodies = spark.createDataFrame([("a", END, json.dumps({"items": [item]}))],
                                   "snapshot string, snapshot_ts timestamp, body string")
    good, rejects = flatten_snapshots(parse_snapshots(bodies), END)
    seen = [(r.reason, r.unreadable) for r in rejects.collect()]
    assert (good.count(), seen) == ((1, []) if reason is None else (0, [(reason, True)]))


@pytest.mark.parametrize("body", ['{"items":[]} x', '{"items":[]}{}', '{"items":{}}', "[]", "", "{}", None,
                                  '{"items":[7]}', '{"items":[{"metadata":[],"status":{}}]}'])
def test_undecodable_snapshots(spark, body):
    bodies = spark.createDataFrame([("a", END, body)], "snapshot string, snapshot_ts timestamp, body string")
    _, rejects = flatten_snapshots(parse_snapshots(bodies), END)
    assert rows_of(rejects, "reason") == [("bad_document",)]


def test_requests(spark):
    good, rejected = parse_requests(bodies_of(
        spark,
        json.dumps({"jobs": [{"secret": "a", "jobID": job(1).upper()},
                             {"secret": "a", "jobID": "urn:uuid:" + job(1), "more": 1}]}),
        '{"jobs": []}',
        json.dumps({"jobs": [{"secret": "a", "jobID": job(1)}, {"secret": "b", "jobID": "x"}]}),
        json.dumps({"jobs": [{"secret": 7, "jobID": job(1)}]}),
        json.dumps({"jobs": [{"jobID": job(1)}]}),
        json.dumps({"jobs": [{"secret": None, "jobID": job(1)}]}),
        '{"jobs": [null]}',
        '{"jobs": null}',
        '{}',
        '{"jobs": []} trailing',
        'nope',
    ))
    assert rows_of(good) == [("r0", 0, job(1), "a"), ("r0", 1, job(1), "a")]
    assert rows_of(rejected, "request_id", "reason") == [
        ("r10", "bad_list"), ("r2", "bad_job"), ("r3", "bad_job"), ("r4", "bad_job"),
        ("r5", "bad_job"), ("r6", "bad_job"), ("r7", "bad_list"), ("r8", "bad_list"),
        ("r9", "bad_list")]


def test_read_requests_from_files(spark, tmp_path):
    body = json.dumps({"jobs": [{"secret": "a", "jobID": job(1)}]})
    (tmp_path / "r.jsonl").write_text(f"{body}\n\n{body}\nbroken\n")
    good, rejected = read_requests(spark, str(tmp_path))
    assert good.select("request_id").distinct().count() == 2
    assert rejected.count() == 1


BASE = {"translationTable": 11, "completeGenome": True, "keepContigHeaders": False,
        "minContigLength": 1, "compliant": True}


def start(drop=(), job_part=None, **config):
    fields = {k: v for k, v in (BASE | config).items() if k not in drop}
    return json.dumps({"job": job_part or {"secret": "s1", "jobID": job(1)}, "config": fields})


def parsed_start(spark, body):
    good, rejected = parse_starts(bodies_of(spark, body))
    row = good.select("job_id", "secret", "config.*").first()
    reject = rejected.select("reason").first()
    return row, reject and reject[0]


def test_start_defaults(spark):
    row, reason = parsed_start(spark, start())
    assert reason is None
    assert row.asDict() == {
        "job_id": job(1), "secret": "s1", "prodigal_training_file": None, "has_replicons": True,
        "translation_table": 11, "complete_genome": True, "keep_contig_headers": False,
        "min_contig_length": Decimal(1), "derm_type": None, "genus": None, "species": None,
        "strain": None, "plasmid": None, "locus": None, "locus_tag": None, "compliant": True}


@pytest.mark.parametrize("config, column, value", [
    ({"hasReplicons": False}, "has_replicons", False),
    ({"translationTable": 255}, "translation_table", 255),
    ({"minContigLength": 0}, "min_contig_length", Decimal(0)),
    ({"minContigLength": 2**64 - 1}, "min_contig_length", Decimal(2**64 - 1)),
    ({"minContigLength": 2**63}, "min_contig_length", Decimal(2**63)),
    ({"dermType": "DIDERM"}, "derm_type", "DIDERM"),
    ({"dermType": None}, "derm_type", None),
    ({"genus": ""}, "genus", ""),
    ({"genus": None}, "genus", None),
    ({"prodigalTrainingFile": ""}, "prodigal_training_file", ""),
    ({"unknown": 1}, "compliant", True),
])
def test_start_values(spark, config, column, value):
    row, reason = parsed_start(spark, start(**config))
    assert reason is None
    assert row[column] == value


@pytest.mark.parametrize("body, reason", [
    (start(hasReplicons=None), "bad hasReplicons"),
    (start(translationTable=256), "bad translationTable"),
    (start(translationTable=-1), "bad translationTable"),
    (start(translationTable="4"), "bad translationTable"),
    (start(translationTable=4.5), "bad translationTable"),
    (start(translationTable=4.0), "bad translationTable"),
    (start(translationTable=None), "bad translationTable"),
    (start(drop=["translationTable"]), "missing translationTable"),
    (start(minContigLength=2**64), "bad minContigLength"),
    (start(minContigLength=-1), "bad minContigLength"),
    (start(completeGenome="true"), "bad completeGenome"),
    (start(drop=["compliant"]), "missing compliant"),
    (start(dermType="diderm"), "bad dermType"),
    (start(genus=5), "bad genus"),
    (start(job_part={"secret": "s", "jobID": "x"}), "bad jobID"),
    (start(job_part={"jobID": job(1)}), "bad secret"),
    (start() + "{}", "bad document"),
    ("", "bad document"),
    ("{", "bad document"),
])
def test_start_rejects(spark, body, reason):
    row, seen = parsed_start(spark, body)
    assert row is None
    assert seen == reason


def test_read_starts_from_files(spark, tmp_path):
    (tmp_path / "s.jsonl").write_text(start() + "\n" + start(genus=5) + "\n")
    good, rejected = read_starts(spark, str(tmp_path))
    assert (good.count(), rejected.count()) == (1, 1)


def test_line_order_holds_over_splits(spark, tmp_path):
    lines = [f"line {i} " + "x" * (i % 37) for i in range(5000)]
    (tmp_path / "a.log").write_text("\n".join(lines) + "\n")
    (tmp_path / "b.log").write_text("only")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        read = read_lines(spark, str(tmp_path)).where(F.col("file").endswith("a.log"))
        ordered = [tuple(r) for r in read.select("line_no", "line", "open_ended").orderBy("line_no").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert ordered == [(i, line, False) for i, line in enumerate(lines)]


def test_line_numbers_depend_on_nothing_but_the_file(spark, tmp_path):
    body = json.dumps({"jobs": [{"secret": "a", "jobID": job(1)}]})
    (tmp_path / "m.jsonl").write_text(f"{body}\n" * 500)

    def ids():
        good, _ = read_requests(spark, str(tmp_path))
        return rows_of(good.where("request_id like '%m.jsonl%'"), "request_id")

    alone = ids()
    assert len(set(alone)) == 500 and alone[0][0].endswith("m.jsonl:0")
    (tmp_path / "a.jsonl").write_text(f"{body}\n" * 300)
    (tmp_path / "z.jsonl").write_text("short\n")
    assert ids() == alone
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    try:
        assert ids() == alone
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_lines_end_at_newline_only(spark, tmp_path):
    (tmp_path / "a.log").write_bytes(b"one\rtwo\r\nthree")
    assert rows_of(read_lines(spark, str(tmp_path)), "line") == [("one\rtwo\r",), ("three",)]


def test_log_files_are_named_by_job(spark, tmp_path):
    name = job(1).replace("-", "")
    (tmp_path / f"{name}.log").write_text("a\n")
    assert rows_of(read_log_lines(spark, str(tmp_path)), "job_id", "line") == [(job(1), "a")]
    assert rows_of(read_archived_logs(spark, str(tmp_path)), "job_id", "part", "line_no", "open_ended") == [
        (job(1), 0, 0, False)]


def test_files_of_one_job_keep_their_order(spark, tmp_path):
    (tmp_path / f"{job(1)}.a").write_text("one\ntwo")
    (tmp_path / f"{job(1)}.b").write_text("three\n")
    assert rows_of(read_archived_logs(spark, str(tmp_path)), "part", "line_no", "line", "open_ended") == [
        (0, 0, "one", False), (0, 1, "two", True), (1, 0, "three", False)]


@pytest.mark.parametrize("text, ends", [(b"a\nb", [False, True]), (b"a\nb\n", [False, False]), (b"a\n\n", [False, False])])
def test_packed_logs_know_their_end(spark, tmp_path, text, ends):
    (tmp_path / f"{job(1)}.log.gz").write_bytes(gzip.compress(text))
    lines = read_archived_logs(spark, str(tmp_path))
    assert rows_of(lines, "job_id", "line_no", "open_ended") == [(job(1), i, e) for i, e in enumerate(ends)]


def test_other_packings_are_refused(spark, tmp_path):
    (tmp_path / f"{job(1)}.log.bz2").write_bytes(bz2.compress(b"a\nb"))
    with pytest.raises(Exception, match="neither plain nor gzip"):
        read_archived_logs(spark, str(tmp_path)).collect()


def test_submit_results(spark):
    rows = spark.createDataFrame([
        (1, job(1), '{"metadata":{"name":"w","creationTimestamp":"2024-04-01T08:00:00Z"}}'),
        (2, job(2), '{"metadata":{"name":"w"}}'),
        (3, job(3), '{"message":"denied"}'),
        (4, job(4), "nope"),
        (5, job(5), '{"metadata":{"name":5,"creationTimestamp":"2024-04-01T08:00:00Z"}}'),
        (6, job(6), '{"metadata":{"name":"w","creationTimestamp":"2024-04-01T08:00:00Z"}} x'),
        (7, job(7), '{"metadata":{"name":"w","creationTimestamp":7}}'),
        (8, job(8), None),
    ], "pos long, job_id string, body string")
    assert rows_of(parse_submit_results(rows)) == [(1, job(1), "w", datetime(2024, 4, 1, 8))]


@pytest.mark.parametrize("body, reason", [
    ('{"name":"My genome","repliconTableType":"CSV"}', None),
    ('{"name":"","repliconTableType":"TSV","more":1}', None),
    ('{"repliconTableType":"CSV"}', "missing name"),
    ('{"name":7,"repliconTableType":"CSV"}', "bad name"),
    ('{"name":null,"repliconTableType":"CSV"}', "bad name"),
    ('{"name":"n"}', "missing repliconTableType"),
    ('{"name":"n","repliconTableType":"csv"}', "bad repliconTableType"),
    ('{"name":"n","repliconTableType":null}', "bad repliconTableType"),
    ('nope', "bad document"),
])
def test_inits(spark, body, reason):
    bodies = spark.createDataFrame([(job(1), "k", body)], "job_id string, secret string, body string")
    good, rejected = parse_inits(bodies)
    if reason is None:
        assert rows_of(good, "job_id", "secret", "name") == [(job(1), "k", json.loads(body)["name"])]
        assert rejected.count() == 0
    else:
        assert good.count() == 0
        assert rows_of(rejected, "reason") == [(reason,)]


def test_inits_and_answers_from_files(spark, tmp_path):
    (tmp_path / "inits").mkdir()
    (tmp_path / "answers").mkdir()
    rows = [{"job_id": job(i), "secret": "k", "body": json.dumps({"name": f"n{i}", "repliconTableType": kind})}
            for i, kind in enumerate(["CSV", "x"])]
    (tmp_path / "inits" / "a.jsonl").write_text("\n".join(map(json.dumps, rows)) + "\n")
    good, rejected = read_inits(spark, str(tmp_path / "inits"))
    assert rows_of(good) == [(job(0), "k", "n0")]
    assert rows_of(rejected, "job_id", "reason") == [(job(1), "bad repliconTableType")]
    body = {"metadata": {"name": "w", "creationTimestamp": "2024-04-01T08:00:00Z"}}
    (tmp_path / "answers" / "a.jsonl").write_text(
        json.dumps({"job_id": job(1), "body": json.dumps(body)}) + "\n" + json.dumps({"job_id": job(2), "body": "{}"}))
    answers = read_submit_results(spark, str(tmp_path / "answers"))
    assert rows_of(answers, "pos.line_no", "job_id", "name") == [(0, job(1), "w")]


def test_a_file_that_comes_later_shifts_no_line(spark, tmp_path):
    for name in ("b.txt", "d.txt"):
        (tmp_path / name).write_text("".join(f"{name}{i}\n" for i in range(50)))
    lines = read_lines(spark, str(tmp_path))
    (tmp_path / "a.txt").write_text("x" * 100_000 + "\n")  # the largest file is planned first
    assert sorted((r.line, r.line_no) for r in lines.collect()) == sorted(
        (f"{name}{i}", i) for name in ("b.txt", "d.txt") for i in range(50))


def test_scratch_is_removed_by_a_call(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("jobtide.session.shared_dir", lambda _: str(tmp_path))
    (tmp_path / "other").mkdir()
    path = fresh_path(spark, "made")
    spark.range(3).write.parquet(path)
    clear_scratch(spark)
    clear_scratch(spark)
    with pytest.raises(AnalysisException):
        spark.read.parquet(path)
    assert (tmp_path / "other").exists()


def test_odd_items_are_read_alike_from_documents_and_lines(spark, tmp_path):
    meta, status = {"name": "w", "uid": "u", "labels": {"a": "x"}}, {"phase": "Running", "startedAt": "t"}
    odd = [5, "x", None, True, [], {}, {"a": 1}, {"a": None, "b": "y"}]
    items = [{}, {"metadata": meta, "status": status}, {"metadata": meta}, {"status": status}, *odd]
    items += [{"metadata": v, "status": status} for v in odd] + [{"metadata": meta, "status": v} for v in odd]
    items += [{"metadata": {**meta, n: v}, "status": status} for n in ("name", "uid", "resourceVersion", "labels") for v in odd]
    items += [{"metadata": meta, "status": {**status, n: v}} for n in ("phase", "startedAt", "finishedAt") for v in odd]
    (tmp_path / "whole").mkdir()
    (tmp_path / "lines").mkdir()
    (tmp_path / "whole" / "a.json").write_text(json.dumps({"items": items}))
    (tmp_path / "lines" / "a.json").write_text("\n".join(map(json.dumps, items)))
    columns = ["pos", "to_json(metadata) m", "to_json(status) s", "type_fault"]
    whole = explode_items(read_snapshots(spark, str(tmp_path / "whole"))).selectExpr(*columns)
    lines = read_snapshot_lines(spark, str(tmp_path / "lines")).selectExpr(*columns)
    seen = rows_of(whole)
    assert seen == rows_of(lines) and len(seen) == len(items)
    assert {r[3] for r in seen} == {None, "bad_name", "bad_uid", "bad_resource_version", "bad_label", "bad_phase",
                                    "bad_started_at", "bad_finished_at"}
