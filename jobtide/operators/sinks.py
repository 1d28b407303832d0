"""Writers."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobtide.sources.text_lines import read_lines

TIME_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"  # the default keeps milliseconds only


def write_state(state: DataFrame, path: str) -> None:
    """Write a state version to a path of its own; a version is never changed later."""
    state.write.mode("errorifexists").parquet(path)


def save_state_table(state: DataFrame, table: str, buckets: int) -> None:
    """Store state bucketed by job, so that joins on the job need not shuffle it."""
    (state.write.mode("overwrite").bucketBy(buckets, "job_id").sortBy("job_id")
     .format("parquet").saveAsTable(table))


def write_answers(answers: DataFrame, path: str, order: list[str], per_range: int = 1_000_000) -> None:
    """Lookup answers as two JSON lists in request order; omitted jobs are in neither.

    The last column of ``order`` is a whole number, the place of a request. It gives the
    range of ``per_range`` places that a row belongs to, so both lists are dealt to their
    files in one pass, without sampling or holding the answers. A range is one sorted file:
    ``list=jobs`` or ``list=failedJobs``, then a folder for each earlier column of ``order``
    (which should have few values), then ``range=N``. Folders by their values and N, and lines in their file, are in request order.
    A place has one row, so a file has at most ``per_range`` lines. ``order`` is never null.
    """
    *outer, place = order
    found = F.col("outcome") == "OK"
    dealt = ["list", *outer, "range"]
    rows = answers.where("outcome in ('OK', 'NOT_FOUND', 'UNAUTHORIZED')").select(
        F.when(found, "jobs").otherwise("failedJobs").alias("list"), *outer,
        F.expr(f"(`{place}` - pmod(`{place}`, {per_range})) div {per_range}").alias("range"),
        place, F.col("job_id").alias("jobID"),
        F.when(found, F.col("status")).otherwise(F.col("outcome")).alias("jobStatus"),
        *[F.when(found, F.col(c)).alias(c) for c in ("started", "updated", "name")])
    (rows.repartition(*dealt).sortWithinPartitions(*dealt, place)
     .write.partitionBy(*dealt).option("timestampFormat", TIME_FORMAT).json(path))


def read_answers(spark: SparkSession, path: str, place: str = "pos") -> DataFrame:
    """Lines of :func:`write_answers` for ``order`` ``[place]``, with ``list``, ``range`` and ``line_no``."""
    shape = f"`{place}` long, jobID string, jobStatus string, started timestamp, updated timestamp, name string"
    folder = F.regexp_extract("file", r"/list=([A-Za-z]+)/range=-?[0-9]+/", 1)
    number = F.regexp_extract("file", r"/list=[A-Za-z]+/range=(-?[0-9]+)/", 1)
    return read_lines(spark, path).select(
        folder.alias("list"), number.cast("long").alias("range"), "line_no",
        F.from_json("line", shape).alias("row")).select("list", "range", "line_no", "row.*")


def land_items(checked: DataFrame, path: str) -> None:
    """Store classified snapshot items, good and bad ones in folders of their own.

    Documents are then parsed once, and later reads prune columns and skip the rejects.
    """
    verdict = F.when(F.col("reason").isNull(), "accepted").otherwise("rejected")
    (checked.withColumn("verdict", verdict)
     .write.mode("errorifexists").partitionBy("verdict").parquet(path))
