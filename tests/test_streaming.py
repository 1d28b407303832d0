import json
import os
import random
from datetime import datetime, timedelta

import pyarrow as pa
from pyspark.sql import functions as F

from helpers import job, rows_of
from jobtide.operators.state import change_feed, flatten_snapshots, fold_changes, latest_state
from jobtide.schemas import STATE_COLUMNS, STATE_SCHEMA
from jobtide.sources.snapshots import read_snapshots, stream_snapshots
from jobtide.streaming import job_fold
from jobtide.streaming.state_stream import (
    read_stream_state,
    roll_up,
    start_fold_stream,
    start_state_stream,
    stored_schema,
)

EVENT = "seq long, kind string, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in STATE_SCHEMA)


def item(number, phase, version):
    return {
        "metadata": {"name": f"wf-{number}", "uid": job(900 + number), "resourceVersion": str(version),
                     "labels": {"jobid": job(number), "secret": f"s{number}"}},
        "status": {"phase": phase, "startedAt": "2024-04-01T08:00:00.123456789Z"}}


def write_snapshot(folder, name, when, *items):
    path = folder / name
    path.write_text(json.dumps({"items": list(items)}))
    os.utime(path, (when, when))


def flat_stream(spark, folder, on_error="quarantine", archive=None):
    items = stream_snapshots(spark, str(folder), files_per_trigger=1, archive=archive and str(archive))
    return flatten_snapshots(items, F.col("snapshot_ts"), on_error)[0]


def drain(spark, folder, out, on_error="quarantine", archive=None, **more):
    rows = flat_stream(spark, folder, on_error, archive)
    query = start_state_stream(rows, f"{out}/changes", f"{out}/checkpoint", drain=True, **more)
    query.awaitTermination()
    return read_stream_state(spark, f"{out}/changes", stored_schema(rows))


def batch_state(spark, folder, on_error="quarantine"):
    good, _ = flatten_snapshots(read_snapshots(spark, str(folder)), F.col("snapshot_ts"), on_error)
    return latest_state(good)


def test_stream_equals_batch_over_restarts(spark, tmp_path):
    folder, out = tmp_path / "in", tmp_path / "out"
    folder.mkdir()
    write_snapshot(folder, "a.json", 1_000, item(1, "Pending", 1), item(2, "Running", 1), item(1, "Init", 2))
    write_snapshot(folder, "b.json", 2_000, item(1, "Running", 3), item(3, "Pending", 1))
    write_snapshot(folder, "bad.json", 2_500, {"metadata": {"name": "x"}, "status": {}})
    first = drain(spark, folder, out)
    assert rows_of(first, "job_id", "status", "resource_version") == [
        (job(1), "Running", "3"), (job(2), "Running", "1"), (job(3), "Pending", "1")]
    write_snapshot(folder, "c.json", 3_000, item(2, "Succeeded", 1))
    write_snapshot(folder, "late.json", 1_500, item(3, "Failed", 9))
    write_snapshot(folder, "empty.json", 4_000)
    second = drain(spark, folder, out)
    assert rows_of(second, *STATE_COLUMNS) == rows_of(batch_state(spark, folder), *STATE_COLUMNS)
    assert rows_of(second, "job_id", "status") == [
        (job(1), "Running"), (job(2), "Succeeded"), (job(3), "Pending")]


def test_batches_store_only_changed_jobs(spark, tmp_path):
    folder, out = tmp_path / "in", tmp_path / "out"
    folder.mkdir()
    write_snapshot(folder, "a.json", 1_000, *[item(n, "Pending", 1) for n in range(20)])
    write_snapshot(folder, "b.json", 2_000, item(3, "Running", 2))
    drain(spark, folder, out).count()
    sizes = spark.read.parquet(f"{out}/changes").groupBy("batch").count().collect()
    assert sorted(r["count"] for r in sizes) == [1, 20]


def test_stored_base_replaces_early_batches(spark, tmp_path):
    folder, out = tmp_path / "in", tmp_path / "out"
    folder.mkdir()
    write_snapshot(folder, "a.json", 1_000, item(1, "Pending", 1), item(2, "Pending", 1))
    drain(spark, folder, out).write.parquet(f"{out}/base")
    write_snapshot(folder, "b.json", 2_000, item(1, "Running", 2), item(3, "Pending", 1))
    whole = drain(spark, folder, out)
    schema = stored_schema(flat_stream(spark, folder))
    later = read_stream_state(spark, f"{out}/changes", schema, base=f"{out}/base", after_batch=0)
    assert rows_of(later) == rows_of(whole)
    assert "PartitionFilters: [isnotnull(batch" in later._jdf.queryExecution().executedPlan().toString()


def test_rewritten_batch_leaves_no_duplicates(spark, tmp_path):
    folder, out = tmp_path / "in", tmp_path / "out"
    folder.mkdir()
    write_snapshot(folder, "a.json", 1_000, item(1, "Pending", 1))
    drain(spark, folder, out).count()
    commit = out / "checkpoint" / "commits"
    for name in ["0", ".0.crc"]:
        if (commit / name).exists():
            (commit / name).unlink()
    again = drain(spark, folder, out)
    assert rows_of(again, "job_id", "status") == [(job(1), "Pending")]
    assert spark.read.parquet(f"{out}/changes").count() == 1


def test_prefix_policy_in_a_stream(spark, tmp_path):
    folder, out = tmp_path / "in", tmp_path / "out"
    folder.mkdir()
    write_snapshot(folder, "a.json", 1_000, item(1, "Pending", 1), item(2, "Odd", 1), item(3, "Pending", 1))
    first = drain(spark, folder, out, "prefix")
    assert rows_of(first, "job_id", "status") == [(job(1), "Pending")]
    broken = item(4, "Running", 1)
    broken["metadata"]["name"] = 7
    write_snapshot(folder, "b.json", 2_000, item(1, "Running", 2), item(2, "Running", 2), item(5, "?", 1), item(3, "Failed", 2))
    write_snapshot(folder, "c.json", 3_000, item(1, "Failed", 3), broken)
    second = drain(spark, folder, out, "prefix")
    assert rows_of(second, *STATE_COLUMNS) == rows_of(batch_state(spark, folder, "prefix"), *STATE_COLUMNS)
    assert rows_of(second, "job_id", "status") == [(job(1), "Running"), (job(2), "Running")]


def test_rows_equal_to_the_stored_ones_are_not_written(spark, tmp_path):
    folder, out = tmp_path / "in", tmp_path / "out"
    folder.mkdir()
    done = [item(n, "Succeeded", 1) for n in range(20)]
    for one in done:
        one["status"]["finishedAt"] = "2024-04-01T09:00:00Z"
    write_snapshot(folder, "a.json", 1_000, *done)
    write_snapshot(folder, "b.json", 2_000, *done, item(30, "Running", 2))
    write_snapshot(folder, "c.json", 3_000, *done[1:], item(0, "Failed", 2))
    state = drain(spark, folder, out)
    sizes = spark.read.parquet(f"{out}/changes").groupBy("batch").count().collect()
    assert sorted((r.batch, r["count"]) for r in sizes) == [(0, 20), (1, 1), (2, 1)]
    assert rows_of(state, *STATE_COLUMNS) == rows_of(batch_state(spark, folder), *STATE_COLUMNS)
    files = [f for f in (out / "changes" / "batch=0").glob("part-*.parquet")]
    assert len(files) == 1


def test_rolled_up_state_replaces_what_it_holds(spark, tmp_path):
    folder, out = tmp_path / "in", tmp_path / "out"
    folder.mkdir()
    write_snapshot(folder, "a.json", 1_000, item(1, "Pending", 1), item(2, "Pending", 1))
    drain(spark, folder, out)
    schema = stored_schema(flat_stream(spark, folder))
    last = roll_up(spark, f"{out}/changes", schema, f"{out}/base0")
    assert last == 0
    write_snapshot(folder, "b.json", 2_000, item(1, "Running", 2), item(3, "Pending", 1))
    whole = drain(spark, folder, out, base=f"{out}/base0", after_batch=last)
    again = roll_up(spark, f"{out}/changes", schema, f"{out}/base1", base=f"{out}/base0", after_batch=last)
    assert again == 1
    later = read_stream_state(spark, f"{out}/changes", schema, base=f"{out}/base1", after_batch=again)
    assert rows_of(later) == rows_of(whole)
    assert spark.read.parquet(f"{out}/base1").count() == 3


def test_state_is_kept_on_disk(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    write_snapshot(folder, "a.json", 1_000, item(1, "Pending", 1))
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    drain(spark, folder, tmp_path / "out")
    assert "RocksDB" in (tmp_path / "out" / "checkpoint" / "offsets" / "0").read_text()


def event(chance, seq, jobs):
    kind = chance.choice(["INIT", "SNAPSHOT", "START", "START", "DELETE"])
    number = chance.randrange(jobs)
    # few values, so that rows that change nothing are among them
    when = datetime(2024, 4, 1) + timedelta(hours=chance.randrange(3), microseconds=seq % 2)
    secret = chance.choice(["s", "s", "t", None])
    full, listed = kind in ("INIT", "SNAPSHOT"), kind == "SNAPSHOT"
    return (seq, kind, job(number), "uid" if listed else None, None, chance.choice("ab") if full else None,
            chance.choice(["Running", "Failed"]) if listed else None, when if kind in ("START", "SNAPSHOT") else None,
            when if listed else None, "wf" if kind == "START" else None, secret, False if full else None)


def fold_drain(spark, folder, out, **more):
    streams = {kind: spark.readStream.schema(EVENT).parquet(str(folder)).where(F.col("kind") == kind)
               for kind in ("SNAPSHOT", "INIT", "START", "DELETE")}
    feed = change_feed(*streams.values())
    start_fold_stream(feed, f"{out}/changes", f"{out}/checkpoint", drain=True, **more).awaitTermination()
    return stored_schema(feed, ["seq"])


def test_fold_in_a_stream_equals_the_batch_fold_over_restarts(spark, tmp_path):
    chance = random.Random(5)
    events = [event(chance, seq, 25) for seq in range(900)]
    # late events come in a later batch, and others before their turn
    chance.shuffle(events)
    folder, out = tmp_path / "in", tmp_path / "out"
    shown = None
    for part in range(3):
        rows = events[part * 300:part * 300 + 300]
        spark.createDataFrame(rows, EVENT).coalesce(1).write.mode("append").parquet(str(folder))
        schema = fold_drain(spark, folder, out)
        state = read_stream_state(spark, f"{out}/changes", schema, ["seq"])
        expected = fold_changes(spark.createDataFrame(events[:part * 300 + 300], EVENT))
        assert rows_of(state, *STATE_COLUMNS) == rows_of(expected, *STATE_COLUMNS)
        # a batch has the jobs whose view changed, and no others
        seen = {r.job_id: tuple(r)[1:] for r in expected.collect()}
        batch = spark.read.schema(schema).parquet(f"{out}/changes/batch={part}").collect()
        if shown is not None:
            changed = {j for j in seen.keys() | shown.keys() if seen.get(j) != shown.get(j)}
            assert sorted(r.job_id for r in batch) == sorted(changed)
        assert {r.job_id for r in batch if not r.deleted} <= seen.keys()
        shown = seen


def test_a_new_checkpoint_goes_on_from_a_base(spark, tmp_path):
    chance = random.Random(6)
    folder, out, anew = tmp_path / "in", tmp_path / "out", tmp_path / "anew"
    early = [event(chance, seq, 12) for seq in range(60)]
    spark.createDataFrame(early, EVENT).write.parquet(str(folder))
    schema = fold_drain(spark, folder, out)
    last = roll_up(spark, f"{out}/changes", schema, f"{out}/base", ["seq"])
    # after the base come whole rows, and acts on rows of the base
    late = [event(chance, seq, 12) for seq in range(60, 120)]
    spark.createDataFrame(late, EVENT).write.parquet(str(tmp_path / "late"))
    fold_drain(spark, tmp_path / "late", anew, base=f"{out}/base")
    state = read_stream_state(spark, f"{anew}/changes", schema, ["seq"], base=f"{out}/base")
    known = rows_of(spark.read.schema(schema).parquet(f"{out}/base"), "job_id")
    assert last == 0 and known
    expected = fold_changes(spark.createDataFrame(early + late, EVENT))
    assert rows_of(state, *STATE_COLUMNS) == rows_of(expected, *STATE_COLUMNS)


def test_the_sink_reads_no_file_and_joins_nothing(spark, tmp_path):
    folder = tmp_path / "in"
    spark.createDataFrame([event(random.Random(7), 1, 1)], EVENT).write.parquet(str(folder))
    rows = spark.readStream.schema(EVENT).parquet(str(folder))
    query = start_fold_stream(rows, f"{tmp_path}/changes", f"{tmp_path}/checkpoint", drain=True)
    query.awaitTermination()
    plan = query._jsq.explainInternal(False)
    assert "TransformWithState" in plan or "transformWithState" in plan
    assert "Join" not in plan and "Coalesce" not in plan and plan.count("FileScan") <= 1


def test_read_snapshots_are_archived(spark, tmp_path):
    folder, out, archive = tmp_path / "in", tmp_path / "out", tmp_path / "read"
    folder.mkdir()
    left, polls = [], 12
    for n in range(polls):
        write_snapshot(folder, f"{n:03}.json", 1_000 + n, item(n % 4, "Running", n))
        if n % 4 == 3:
            state = drain(spark, folder, out, archive=archive)
            left.append(len(list(folder.glob("*.json"))))
    # the files of the last batch, and of one being moved, may be there still
    assert max(left) <= 2
    assert rows_of(state, "job_id", "status", "resource_version") == [
        (job(k), "Running", str(8 + k)) for k in range(4)]
    assert len(list(folder.glob("*.json"))) + len(list(archive.rglob("*.json"))) == polls
    assert list((out / "checkpoint" / "state").rglob("*.changelog"))


def fold_rows(*rows):
    names = ["job_id", "kind", "secret", "order_seq", "name"]
    return pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows])


def test_rows_made_void_by_later_batches_are_dropped(monkeypatch):
    batches = [fold_rows(*[(f"j{j}", "SNAPSHOT", "s", 10 * b + j % 3, f"{b}") for j in range(20)]) for b in range(9)]
    batches += [fold_rows(("j0", "START", "s", 99, "t"), ("j0", "START", "t", 98, "t")),
                fold_rows(("j0", "START", "s", 97, "u"), ("j0", "DELETE", "s", 96, "u"))]
    kept = pa.Table.from_batches(job_fold._combined(iter(batches))).to_pylist()
    last = sorted((r["job_id"], r["kind"], r["secret"], r["name"]) for r in kept)
    assert last == sorted([(f"j{j}", "SNAPSHOT", "s", "8") for j in range(20)] + [
        ("j0", "START", "s", "t"), ("j0", "START", "t", "t"), ("j0", "DELETE", "s", "u")])
    # what cannot be held goes on, and nothing is lost by that
    monkeypatch.setattr(job_fold, "_HELD_ROWS", 30)
    more = [r for b in job_fold._combined(iter(batches)) for r in b.to_pylist()]
    assert len(kept) < len(more) and all(r in more for r in kept)


def test_the_processor_gets_one_row_of_a_job(spark, tmp_path):
    folder, out = tmp_path / "in", tmp_path / "out"
    events = [(n, "SNAPSHOT", job(n % 5), "uid", None, "a", "Running", datetime(2024, 4, 1), None, None, "s", False)
              for n in range(200)]
    spark.createDataFrame(events, EVENT).repartition(8).write.parquet(str(folder))
    rows = spark.readStream.schema(EVENT).parquet(str(folder))
    query = start_fold_stream(rows, f"{out}/changes", f"{out}/checkpoint", drain=True)
    query.awaitTermination()
    plan = query._jsq.explainInternal(False)
    below = plan[plan.index("ransformWithState"):]
    # rows of a job meet, are combined, and only then go to the state
    assert below.count("MapInArrow") >= 2 and below.count("Exchange hashpartitioning") >= 2
    state = read_stream_state(spark, f"{out}/changes", stored_schema(rows, ["seq"]), ["seq"])
    assert rows_of(state, "job_id", "seq") == [(job(n), 195 + n) for n in range(5)]
