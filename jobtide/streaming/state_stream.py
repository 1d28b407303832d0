"""Snapshots in, changed job rows out, micro-batch by micro-batch."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from jobtide.operators.state import SNAPSHOT_ORDER
from jobtide.schemas import STATE_COLUMNS, STATE_VALUES
from jobtide.session import configure_streaming
from jobtide.streaming.job_fold import fold_stream

# Fixed value: seconds between two polls.
POLL_INTERVAL = "15 seconds"
_ADAPTIVE = "spark.sql.adaptive.enabled"


def start_state_stream(rows: DataFrame, path: str, checkpoint: str,
                       order: list[str] | None = None, drain: bool = False,
                       base: str | None = None, after_batch: int | None = None,
                       rows_per_file: int = 1_000_000) -> StreamingQuery:
    """Keep the changed rows of every micro-batch of listed jobs under ``path``.

    The newest row per job in ``order`` counts; see :func:`start_fold_stream`.
    """
    events = rows.withColumn("kind", F.lit("SNAPSHOT"))
    return start_fold_stream(events, path, checkpoint, order or SNAPSHOT_ORDER, drain, base, after_batch, rows_per_file)


def start_fold_stream(events: DataFrame, path: str, checkpoint: str, order: list[str] | None = None,
                      drain: bool = False, base: str | None = None, after_batch: int | None = None,
                      rows_per_file: int = 1_000_000) -> StreamingQuery:
    """Fold a stream of job events and keep what every micro-batch changes under ``path``.

    ``events`` is a stream of ``kind``, the state columns and ``order`` (by default ``seq``), as
    :func:`jobtide.operators.state.change_feed` makes it of listed jobs, registrations, starts
    and deletes.

    A batch owns one sub-folder and overwrites it, so a batch that is run again after a
    failure leaves no duplicates, and no batch reads or rewrites what earlier ones stored: what
    has changed is known from the state (:mod:`jobtide.streaming.job_fold`). The write is dealt
    by size, in files of at most ``rows_per_file``.

    A new checkpoint begins with the state of ``base`` and of the batches after ``after_batch``
    if a base is named; a checkpoint that has a state goes on with it.

    The state store is set to keep its rows on disk. ``drain`` handles what is there and
    stops; otherwise a poll starts every 15 seconds.
    """
    spark = configure_streaming(events.sparkSession)
    order = order or ["seq"]
    initial = None
    if base is not None:
        initial = spark.read.schema(stored_schema(events, order)).parquet(base)
        if after_batch is None:
            initial = _newest(initial.withColumn("batch", F.lit(-1)), order)
        else:
            initial = read_stream_state(spark, path, stored_schema(events, order), order, base, after_batch)

    def store(batch: DataFrame, batch_id: int) -> None:
        # A stream turns adaptive execution off for its own plans; this write may use it, and
        # only by it are the parts dealt by size.
        settings = batch.sparkSession.conf
        before = settings.get(_ADAPTIVE)
        settings.set(_ADAPTIVE, "true")
        try:
            (batch.hint("rebalance").write.mode("overwrite").option("maxRecordsPerFile", rows_per_file)
             .parquet(f"{path}/batch={batch_id}"))
        finally:
            settings.set(_ADAPTIVE, before)

    writer = (
        fold_stream(events, order, initial).writeStream
        .outputMode("update")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(store)
    )
    if drain:
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime=POLL_INTERVAL).start()


def _newest(stored: DataFrame, order: list[str]) -> DataFrame:
    """Per job the row of the last batch, if the job was not deleted in it."""
    kept = [*STATE_VALUES, *order]
    newest = stored.groupBy("job_id").agg(F.max_by(F.struct(*kept, "deleted"), "batch").alias("newest"))
    return newest.where("not coalesce(newest.deleted, false)").select(
        "job_id", *[f"newest.{c}" for c in kept])


def read_stream_state(spark: SparkSession, path: str, schema: T.StructType,
                      order: list[str] | None = None, base: str | None = None,
                      after_batch: int | None = None, before_batch: int | None = None) -> DataFrame:
    """Current state from the stored changes, with the order columns of each row.

    A job has at most one row in a batch, and that of the last batch counts. Once such a state
    has been written as a ``base``, name it and the last batch in it, and only later batches are
    read. Reading a batch twice does no harm.
    """
    stored = spark.read.schema(T.StructType([*schema, T.StructField("batch", T.LongType())])).parquet(path)
    if after_batch is not None:
        stored = stored.where(F.col("batch") > after_batch)
    if before_batch is not None:
        stored = stored.where(F.col("batch") < before_batch)
    if base is not None:
        stored = stored.unionByName(spark.read.schema(schema).parquet(base).withColumn("batch", F.lit(-1)))
    return _newest(stored, order or SNAPSHOT_ORDER)


def roll_up(spark: SparkSession, path: str, schema: T.StructType, to: str,
            order: list[str] | None = None, base: str | None = None,
            after_batch: int | None = None) -> int | None:
    """Write the state so far as a new base under ``to``; the last batch in it.

    Readers that name the new base and that batch no longer need the folders up to it, nor
    the old base. The stream may go on meanwhile: batches after the last one are left out.
    """
    batches = spark.read.schema(T.StructType([*schema, T.StructField("batch", T.LongType())])).parquet(path)
    last = batches.agg(F.max("batch")).first()[0]
    if last is None:
        last = after_batch
    until = None if last is None else last + 1
    state = read_stream_state(spark, path, schema, order, base, after_batch, until)
    state.write.mode("errorifexists").parquet(to)
    return last


def stored_schema(rows: DataFrame, order: list[str] | None = None) -> T.StructType:
    """Schema of the stored changes, so that a reader need not infer it."""
    order = order or SNAPSHOT_ORDER
    return rows.select(*STATE_COLUMNS, *order, F.lit(False).alias("deleted")).schema
