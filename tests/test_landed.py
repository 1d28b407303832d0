import json
from datetime import datetime

from pyspark.sql import functions as F

from helpers import job, rows_of
from jobtide.operators.state import flatten_snapshots
from jobtide.sources.landed import land_snapshots, read_landed_fields, read_landed_items
from jobtide.sources.snapshots import parse_snapshots

NOON = datetime(2024, 4, 1, 12)
SHAPE = "snapshot string, snapshot_ts timestamp, body string"


def item(n, **status):
    return {"metadata": {"name": f"w{n}", "uid": job(100 + n), "resourceVersion": str(n),
                         "labels": {"jobid": job(n), "secret": f"s{n}", "name": "x"}},
            "spec": {"steps": [n, n + 1], "image": "tool:1"},
            "status": {"phase": "Running", "startedAt": "2024-04-01T08:00:00Z"} | status}


def bodies(spark, *texts):
    return spark.createDataFrame([(f"p{i}", NOON, t) for i, t in enumerate(texts)], SHAPE)


def texts():
    return [
        json.dumps({"items": [item(1), item(2, phase=5), item(3, startedAt=None), 7, None]}),
        '{"items": [', '{"items": []}', "", '{"items": {}}', None,
        json.dumps({"items": [{"metadata": {"labels": {"a": 1}}}, {}, item(4)]}),
        json.dumps({"items": [item(5), item(6), item(7, phase="Odd"), item(8)]})]


def test_landed_items_equal_parsed_ones(spark, tmp_path):
    rows = bodies(spark, *texts())
    land_snapshots(rows, str(tmp_path / "landed"), "a")
    for policy in ("quarantine", "prefix"):
        plain = flatten_snapshots(parse_snapshots(rows), NOON, policy)
        landed = flatten_snapshots(read_landed_items(spark, str(tmp_path / "landed")), NOON, policy)
        for mine, other in zip(landed, plain, strict=True):
            rows_read = rows_of(mine.select([F.col(c).cast("string") for c in mine.columns]))
            assert rows_read == rows_of(other.select([F.col(c).cast("string") for c in mine.columns]))
            assert rows_read


def test_a_batch_landed_again_replaces_itself(spark, tmp_path):
    path = str(tmp_path / "landed")
    land_snapshots(bodies(spark, json.dumps({"items": [item(1), item(2)]})), path, "a")
    land_snapshots(bodies(spark, json.dumps({"items": [item(3)]})), path, "b")
    land_snapshots(bodies(spark, json.dumps({"items": [item(4, phase=1)]})), path, "a")
    seen = read_landed_fields(spark, path, phase="$.status.phase", image="$.spec.image", none="$.x.y")
    assert rows_of(seen, "batch", "pos", "phase", "image", "none") == [
        ("a", 0, None, "tool:1", None), ("b", 0, "Running", "tool:1", None)]


def test_a_read_asks_for_the_named_fields_only(spark, tmp_path):
    path = str(tmp_path / "landed")
    land_snapshots(bodies(spark, json.dumps({"items": [item(n) for n in range(50)]})), path, "a")
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    try:
        plans = [df._jdf.queryExecution().executedPlan().toString() for df in (
            read_landed_fields(spark, path, phase="$.status.phase").select("phase"),
            flatten_snapshots(read_landed_items(spark, path), NOON)[0])]
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    read = [p.split("ReadSchema: ")[1].split("\n")[0] for p in plans]
    assert read[0].strip() == "struct<item:struct<0:variant>>"
    # no read of the whole item
    assert "item:variant" not in read[1] and "item:struct<" in read[1]


def test_no_texts(spark, tmp_path):
    land_snapshots(bodies(spark, "x").where("false"), str(tmp_path / "landed"), "a")
    assert read_landed_items(spark, str(tmp_path / "landed")).collect() == []
