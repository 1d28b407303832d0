"""Snapshot items landed once as shredded variants and read back by single fields.

A text is parsed when it is landed. Its items are stored whole, fields that are not read today
included, and the writer puts common fields into columns of their own; a later read asks the
files for the fields it names and not for the items.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobtide.functions.json import text_of
from jobtide.functions.once import compute_once
from jobtide.sources.snapshots import item_of, snapshot_variants

PLACE = ["snapshot", "snapshot_ts", "pos"]
LANDED_SCHEMA = "snapshot string, snapshot_ts timestamp, pos int, item variant, batch string"


def land_snapshots(bodies: DataFrame, path: str, batch: str) -> None:
    """Store the items of texts ``(snapshot, snapshot_ts, body)`` in the folder of ``batch``.

    A batch that is landed again replaces itself, so a job that failed can be run again. An
    unreadable text has one null item, so that it can still be rejected; an empty list has none.
    """
    documents = snapshot_variants(bodies)
    none = F.array(F.lit(None).cast("variant"))
    items = documents.select(
        "snapshot", "snapshot_ts", F.posexplode(F.coalesce("variants", none)).alias("pos", "item"))
    items.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def _stored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LANDED_SCHEMA).parquet(path)


def read_landed_items(spark: SparkSession, path: str) -> DataFrame:
    """``(snapshot, snapshot_ts, pos, metadata, status, type_fault)`` of all landed batches.

    The same rows as from the texts, for ``flatten_snapshots``.
    """
    judged = compute_once(_stored(spark, path), PLACE, item_of(F.col("item")).alias("judged"))
    return judged.select(*PLACE, "judged.*")


def read_landed_fields(spark: SparkSession, path: str, **paths: str) -> DataFrame:
    """The place of each item, its batch, and the fields at ``paths`` (``name="$.a.b"``).

    A field that is no text is null.
    """
    fields = [text_of(F.try_variant_get("item", at, "variant")).alias(name) for name, at in paths.items()]
    return _stored(spark, path).select(*PLACE, "batch", *fields)
