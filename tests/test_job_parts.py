import re
from pathlib import Path

import pytest

from helpers import job, requests_of, rows_of, state_of, state_row
from jobtide.operators.logs import assemble_logs
from jobtide.operators.state import upsert_state
from jobtide.schemas import STATE_SCHEMA
from jobtide.sources.job_parts import of_ids, of_jobs, part_name, parts_of, read_by_job, upsert_by_job, write_by_job

PARTS = 8


def stored(spark, path, count=200, parts=PARTS):
    write_by_job(state_of(spark, *[state_row(n) for n in range(count)]), str(path), parts)
    return read_by_job(spark, str(path), STATE_SCHEMA)


def scan_of(df):
    """The file scan of a plan without a shuffle, after it has run."""
    rows = df._jdf.queryExecution()
    plan = rows.executedPlan()
    rows.toRdd().count()
    return plan.collectLeaves().apply(0)


def files_of(path):
    return {str(f.relative_to(path)): f.stat().st_mtime_ns for f in Path(path).rglob("part-*.parquet")}


def test_a_lookup_of_one_job_opens_one_folder_and_skips_row_groups(spark, tmp_path):
    table = stored(spark, tmp_path / "state", 2_000)
    found = of_ids(table, [job(17)])
    assert rows_of(found) == rows_of(state_of(spark, state_row(17)))
    scan = scan_of(of_ids(table, [job(17)]))
    assert scan.metrics().apply("numPartitions").value() == 1
    assert scan.metrics().apply("numOutputRows").value() < 2_000 / 4
    # an id inside the folder's range that is not there: a job between two stored ones
    absent = next(j for j in (job(n) + "x" for n in range(500, 600)))
    missing = of_ids(table, [absent])
    assert missing.count() == 0
    assert scan_of(of_ids(table, [absent])).metrics().apply("numOutputRows").value() == 0
    assert of_ids(table, []).count() == 0
    assert rows_of(of_ids(table, [job(1), job(1), job(5_000), job(3)]), "job_id") == [(job(1),), (job(3),)]


@pytest.mark.parametrize("few", [False, True])
def test_rows_of_wanted_jobs(spark, tmp_path, few):
    table = stored(spark, tmp_path / "state")
    wanted = requests_of(spark, (0, 5, "s5"), (1, 6, "x"), (2, 999, "x"))
    seen = of_jobs(table, wanted, few)
    assert rows_of(seen, "job_id") == [(job(5),), (job(6),)]
    assert part_name(PARTS) not in seen.columns
    if few:
        assert 1 <= len(parts_of(wanted, PARTS)) <= 3
        plan = seen._jdf.queryExecution().executedPlan().toString()
        assert part_name(PARTS) in re.search(r"PartitionFilters: \[([^\]]*)", plan)[1]


def test_folders_are_pruned_while_a_join_runs(spark, tmp_path):
    table = stored(spark, tmp_path / "state")
    wanted = requests_of(spark, (0, 5, "s5"), (1, 6, "x")).where("pos = 0")
    plan = of_jobs(table, wanted)._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.lower()


def test_readers_and_writers_find_the_number_of_folders(spark, tmp_path):
    table = stored(spark, tmp_path / "state", 20, parts=3)
    assert part_name(3) in table.columns
    upsert_by_job(spark, str(tmp_path / "state"), state_of(spark, state_row(5, "Failed")))
    seen = read_by_job(spark, str(tmp_path / "state"), STATE_SCHEMA)
    assert part_name(3) in seen.columns and seen.count() == 20
    write_by_job(state_of(spark, state_row(1)).limit(0), str(tmp_path / "none"))
    none = read_by_job(spark, str(tmp_path / "none"), STATE_SCHEMA)
    assert of_ids(none, [job(1)]).count() == 0 and of_jobs(none, table).count() == 0
    upsert_by_job(spark, str(tmp_path / "none"), state_of(spark, state_row(5)), 2)
    assert rows_of(of_ids(read_by_job(spark, str(tmp_path / "none"), STATE_SCHEMA), [job(5)]), "job_id") == [(job(5),)]


def test_upsert_rewrites_only_touched_folders(spark, tmp_path):
    path = tmp_path / "state"
    stored(spark, path)
    before = files_of(path)
    whole = state_of(spark, *[state_row(n) for n in range(200)])
    changes = state_of(spark, state_row(5, "Failed"), state_row(7_000))
    touched = upsert_by_job(spark, str(path), changes, PARTS)
    assert touched == parts_of(changes, PARTS) and 1 <= len(touched) <= 2
    after = files_of(path)
    for name, written in before.items():
        part = int(name.split("=")[1].split("/")[0])
        assert (after.get(name) == written) == (part not in touched)
    seen = read_by_job(spark, str(path), STATE_SCHEMA)
    assert rows_of(seen.drop(part_name(PARTS))) == rows_of(upsert_state(whole, changes))
    assert upsert_by_job(spark, str(path), changes.limit(0), PARTS) == []
    assert files_of(path) == after


def test_logs_of_stored_tables_equal_those_of_others(spark, tmp_path):
    lines = spark.createDataFrame(
        [(job(n), 0, i, f'{{"result":{{"content":"l{n}-{i}"}}}}') for n in range(60) for i in range(5)],
        "job_id string, part long, line_no long, line string")
    archived = spark.createDataFrame(
        [(job(n), 0, 0, f"a{n}", False) for n in range(60, 80)],
        "job_id string, part long, line_no long, line string, open_ended boolean")
    state = state_of(spark, *[state_row(n, archived=n >= 60) for n in range(80)])
    requests = requests_of(spark, *[(n, n, f"s{n}") for n in (1, 3, 61, 90)])
    kept = []
    for table, name in [(lines, "lines"), (archived, "archived")]:
        write_by_job(table, str(tmp_path / name), PARTS, ["part", "line_no"])
        kept.append(read_by_job(spark, str(tmp_path / name), table.schema))
    expected = rows_of(assemble_logs(requests, state, lines, archived)[1])
    assert len(expected) == 3
    assert rows_of(assemble_logs(requests, state, *kept)[1]) == expected
    assert rows_of(assemble_logs(requests, state, *kept, few=True)[1]) == expected


def test_a_hot_job_fills_several_files(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "20000")
    rows = spark.range(40_000).selectExpr(
        f"case when id % 3 > 0 then '{job(1)}' else concat('j', id) end as job_id", "id as line_no", "sha2(string(id), 256) as line")
    write_by_job(rows, str(tmp_path / "lines"), PARTS, ["line_no"])
    spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    hot = parts_of(spark.createDataFrame([(job(1),)], "job_id string"), PARTS)[0]
    assert sum(f"={hot}/" in name for name in files_of(tmp_path / "lines")) > 2
    assert read_by_job(spark, str(tmp_path / "lines"), rows.schema).count() == 40_000
