"""Workflow snapshots: nested JSON documents, one per poll."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobtide.functions.json import field, is_whole, kind, parse_document, text_of
from jobtide.functions.once import compute_once
from jobtide.sources.text_lines import read_lines

# The fields that are read, and their kinds in the fault they have if they are no text.
_META = {"name": "bad_name", "uid": "bad_uid", "resourceVersion": "bad_resource_version"}
_STATUS = {"phase": "bad_phase", "startedAt": "bad_started_at", "finishedAt": "bad_finished_at"}


# The shape of an item.
ITEM_TYPE = ("struct<metadata: struct<name: string, uid: string, resourceVersion: string, "
             "labels: map<string, string>>, status: struct<phase: string, startedAt: string, "
             "finishedAt: string>, type_fault: string>")


# What is taken from an item, as it is written; null where there is no object.
_WRITTEN_META = "struct<" + ", ".join(f"{n}: variant" for n in [*_META, "labels"]) + ">"
_WRITTEN_STATUS = "struct<" + ", ".join(f"{n}: variant" for n in _STATUS) + ">"


def _part(item: Column, path: str) -> Column:
    return F.try_variant_get(item, path, "variant")


def _judged_item(meta: dict[str, Column], status: dict[str, Column], kinds: dict[str, Column], labels: Column,
                 has_meta: Column, has_status: Column) -> Column:
    """An item of its written fields, their kinds and the texts of its labels by key."""
    def fault(name, why):
        return F.when(~kinds[name].isin("STRING", "VOID"), why)

    def text(name, value):
        return F.when(kinds[name] == "STRING", F.try_variant_get(value, "$", "string")).alias(name)

    raw_labels = meta["labels"]
    # A label that is no text has null for its text.
    bad_label = F.exists(F.map_values(labels), lambda v: v.isNull()) | (
        labels.isNull() & raw_labels.isNotNull() & (kind(raw_labels) != "VOID"))
    faults = [fault(n, why) for n, why in _META.items()]
    faults += [F.when(bad_label, "bad_label")]
    faults += [fault(n, why) for n, why in _STATUS.items()]
    texts = F.struct(*[text(n, meta[n]) for n in _META], labels.alias("labels"))
    return F.struct(
        F.when(has_meta, texts).alias("metadata"),
        F.when(has_status, F.struct(*[text(n, status[n]) for n in _STATUS])).alias("status"),
        F.coalesce(*faults).alias("type_fault"))


def _label_texts(labels: Column) -> Column:
    return F.transform_values(labels, lambda _, v: text_of(v))


def item_of(item: Column) -> Column:
    """``struct<metadata, status, type_fault>`` of a variant; numbers are not taken for text."""
    def is_object(path):
        return F.startswith(kind(_part(item, path)), F.lit("OBJECT"))

    meta = {n: _part(item, f"$.metadata.{n}") for n in [*_META, "labels"]}
    status = {n: _part(item, f"$.status.{n}") for n in _STATUS}
    kinds = {n: kind((meta | status)[n]) for n in [*_META, *_STATUS]}
    labels = _label_texts(F.try_variant_get(item, "$.metadata.labels", "map<string, variant>"))
    return _judged_item(meta, status, kinds, labels, is_object("$.metadata"), is_object("$.status"))


def _items_of(variants: Column) -> Column:
    """:func:`item_of` of each in an array.

    A lambda works out again whatever it names twice, so its steps are arrays of their own and
    each object is gone through once.
    """
    def parts(item):
        return F.struct(F.try_variant_get(item, "$.metadata", _WRITTEN_META).alias("meta"),
                        F.try_variant_get(item, "$.status", _WRITTEN_STATUS).alias("status"))

    def known(x):
        meta, status = x["meta"], x["status"]
        labels = _label_texts(F.try_variant_get(meta["labels"], "$", "map<string, variant>"))
        return F.struct(
            meta.alias("meta"), status.alias("status"), labels.alias("labels"),
            *[kind(meta[n]).alias(f"kind_{n}") for n in _META],
            *[kind(status[n]).alias(f"kind_{n}") for n in _STATUS])

    def judged(x):
        meta, status = x["meta"], x["status"]
        return _judged_item(
            {n: meta[n] for n in [*_META, "labels"]}, {n: status[n] for n in _STATUS},
            {n: x[f"kind_{n}"] for n in [*_META, *_STATUS]}, x["labels"], meta.isNotNull(), status.isNotNull())

    return F.transform(F.transform(F.transform(variants, parts), known), judged)


def snapshot_variants(bodies: DataFrame) -> DataFrame:
    """``(snapshot, snapshot_ts, variants)``: the listed items of each text as they are written.

    Null for a text that is not exactly one document with a list of items.
    """
    kept = ["snapshot", "snapshot_ts"]
    parsed = compute_once(bodies.select(*kept, "body"), kept, parse_document(F.col("body")).alias("document"))
    document = F.col("document")
    listed = F.try_variant_get(document, "$[0].items", "array<variant>")
    return parsed.select(*kept, F.when(is_whole(document), listed).alias("variants"))


def parse_snapshots(bodies: DataFrame) -> DataFrame:
    """Documents ``(snapshot, snapshot_ts, items)`` of texts ``(snapshot, snapshot_ts, body)``.

    A text that is not exactly one document with a list of items has one null item, so that
    it can be rejected; an empty list has none.
    """
    none = F.array(F.lit(None).cast(ITEM_TYPE))
    return snapshot_variants(bodies).select(
        "snapshot", "snapshot_ts", F.coalesce(_items_of(F.col("variants")), none).alias("items"))


def explode_items(documents: DataFrame) -> DataFrame:
    """``(snapshot, snapshot_ts, pos, metadata, status, type_fault)``, one row per workflow."""
    return documents.select(
        "snapshot", "snapshot_ts", F.posexplode("items").alias("pos", "item"),
    ).select("snapshot", "snapshot_ts", "pos", "item.*")


def _bodies(raw: DataFrame) -> DataFrame:
    return raw.select(
        F.col("_metadata.file_path").alias("snapshot"),
        F.col("_metadata.file_modification_time").alias("snapshot_ts"),
        F.col("value").alias("body"))


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """Documents of a folder of snapshot files."""
    return parse_snapshots(_bodies(spark.read.text(path, wholetext=True)))


def read_snapshot_lines(spark: SparkSession, path: str) -> DataFrame:
    """Items of snapshots stored with one item per line, one file per poll.

    A document is read by one task, a file of lines in splits: use this for snapshots too
    large for a task. ``pos`` is the number of the line in its file.
    """
    lines = read_lines(spark, path).where(F.trim("line") != "").select(
        F.col("file").alias("snapshot"), F.col("file_time").alias("snapshot_ts"),
        F.col("line_no").alias("pos"), "line")
    place = ["snapshot", "snapshot_ts", "pos"]
    parsed = compute_once(lines, place, parse_document(F.col("line")).alias("document"))
    whole = F.when(is_whole(F.col("document")), field(F.col("document"), ""))
    decoded = compute_once(parsed, place, whole.alias("variant"))
    return compute_once(decoded, place, item_of(F.col("variant")).alias("item")).select(*place, "item.*")


def stream_snapshots(spark: SparkSession, path: str,
                     files_per_trigger: int | None = None, archive: str | None = None) -> DataFrame:
    """Documents of a folder that more files come to.

    With ``archive`` files of finished batches move to that folder (outside ``path``, on the
    same file system), so that a poll lists what is new and not all that ever came.
    """
    reader = spark.readStream
    if archive:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return parse_snapshots(_bodies(reader.text(path, wholetext=True)))
