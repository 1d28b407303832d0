"""Job logs: files named by job id."""

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from jobtide.functions.ids import canonical_uuid
from jobtide.sources.text_lines import file_stem, read_lines


def read_log_lines(spark: SparkSession, path: str) -> DataFrame:
    """Enveloped lines of running jobs: ``(job_id, part, line_no, line)``."""
    return _by_job(read_lines(spark, path)).drop("open_ended")


def read_archived_logs(spark: SparkSession, path: str) -> DataFrame:
    """Raw lines of archived jobs: ``(job_id, part, line_no, line, open_ended)``.

    Files may be packed by gzip. Other packings are refused, as nothing tells whether the
    last line of such a file ends in a newline.
    """
    lines = read_lines(spark, path)
    ends = _gzip_ends(spark, path)
    known = F.when(F.col("open_ended").isNotNull(), F.col("open_ended")).when(
        F.col("open").isNotNull(), F.col("open")).otherwise(F.raise_error(
            F.concat(F.lit("neither plain nor gzip: "), "file")).cast("boolean"))
    return _by_job(lines.join(ends, "file", "left").withColumn("open_ended", known).drop("open"))


def _gzip_ends(spark: SparkSession, path: str) -> DataFrame:
    """``(file, open)`` of gzip files: whether their text ends without a newline.

    One task reads one packed file, as it does for its lines; the text is not kept.
    """
    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            opens = [_last_byte(c.as_py()) not in (b"", b"\n") for c in batch.column("content")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("file"), pa.array(opens, pa.bool_())], ["file", "open"])

    files = (spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
             .select(F.col("_metadata.file_path").alias("file"), "content"))
    return files.mapInArrow(last, "file string, open boolean")


def _last_byte(packed: bytes) -> bytes:
    seen = b""
    while packed:
        worker = zlib.decompressobj(31)
        for at in range(0, len(packed), 1 << 16):
            text = worker.decompress(packed[at:at + (1 << 16)])
            seen = text[-1:] or seen
            if worker.eof:
                packed = packed[at + (1 << 16) - len(worker.unused_data):]
                break
        else:
            break
    return seen


def _by_job(lines: DataFrame) -> DataFrame:
    """``part`` numbers the files of a job by name; nearly all jobs have one."""
    job_id = canonical_uuid(file_stem(F.col("file")))
    files = lines.select("file").distinct().withColumn("job_id", job_id)
    order = Window.partitionBy("job_id").orderBy("file")
    numbered = files.withColumn("part", (F.row_number().over(order) - 1).cast("long"))
    return lines.join(numbered, "file").select("job_id", "part", "line_no", "line", "open_ended")
