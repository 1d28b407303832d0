"""Lines of text files with their number, read in splits."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Endings of files that Spark unpacks as it reads them.
PACKED = r"\.(gz|bz2|deflate|lz4|snappy|zst|xz)\z"


def file_stem(path: Column) -> Column:
    """File name without folder, packing and last extension."""
    bare = F.regexp_replace(path, PACKED, "")
    return F.regexp_extract(bare, r"([^/]+?)(?:\.[^/.]*)?\z", 1)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(file, file_time, line_no, line, open_ended)`` for every ``\\n``-ended line.

    ``line_no`` counts from the beginning of the file. Files stay splittable: lines are
    counted per split first, in a scan of its own, and the splits of a file are added up;
    so a line's number depends neither on the size of the splits nor on other files.

    ``open_ended`` marks a last line without a newline after it: a file that ends in one
    has as many bytes as its lines plus one each (a byte order mark, three bytes long, is
    not part of the first line). The size of a packed file does not say; there it is null.
    """
    # one listing for both scans: a file that comes later must not shift the rows of one of them
    listed = spark.read.option("lineSep", "\n").text(path)
    lines = listed.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_modification_time").alias("file_time"),
        F.col("_metadata.file_size").alias("file_size"),
        F.col("_metadata.file_block_start").alias("part"),
        F.monotonically_increasing_id().alias("row"),
        F.col("value").alias("line"))

    parts = lines.groupBy("file", "file_size", "part").agg(
        F.min("row").alias("first"), F.count(F.lit(1)).alias("lines"),
        F.sum(F.octet_length("line") + 1).alias("bytes"))
    in_file = Window.partitionBy("file")
    before = in_file.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    extra = F.sum("bytes").over(in_file) - F.col("file_size")
    placed = parts.select(
        "file", "part", "first",
        F.coalesce(F.sum("lines").over(before), F.lit(0)).alias("before"),
        F.sum("lines").over(in_file).alias("total"),
        F.when(~F.col("file").rlike(PACKED), extra.isin(1, -2)).alias("open"))
    number = F.col("row") - F.col("first") + F.col("before")
    last = number == F.col("total") - 1
    return lines.join(placed, ["file", "part"]).select(
        "file", "file_time", number.alias("line_no"), "line",
        F.when(last, F.col("open")).otherwise(F.lit(False)).alias("open_ended"))


def read_bodies(spark: SparkSession, path: str) -> DataFrame:
    """One request body per line, as ``(request_id, body)``; the id is the file and line."""
    lines = read_lines(spark, path)
    return lines.where(F.trim("line") != "").select(
        F.concat_ws(":", "file", "line_no").alias("request_id"),
        F.col("line").alias("body"),
    )


def read_job_bodies(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """``(pos, *keys, body)`` of JSON lines that carry a body as text beside its keys.

    ``pos`` orders by file and line.
    """
    shape = ", ".join(f"{name} string" for name in [*keys, "body"])
    lines = read_lines(spark, path).where(F.trim("line") != "")
    read = F.from_json("line", shape)
    return lines.select(F.struct("file", "line_no").alias("pos"), read.alias("row")).select("pos", "row.*")
