"""Tables stored by job, so that a few jobs are found without reading the others.

A row lies in the folder named by a hash of its job. Inside, rows are sorted by job and files
carry Bloom filters of the jobs (or dictionaries, where a file has few jobs), so a read for some
jobs opens their folders only and skips the row groups without them. A folder is dealt by size: a
job with very many rows fills several files and is written by several tasks.

The number of folders is part of the column's name, so readers and later writers cannot assume
another one. A table written without rows has no folders and no such column.
"""

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobtide.operators.state import upsert_state
from jobtide.schemas import STATE_SCHEMA

# For some ten million jobs or a terabyte of logs; each folder is at least one file.
PARTS = 512
_NAME = re.compile(r"job_part_of_(\d+)")


def part_name(parts: int) -> str:
    return f"job_part_of_{parts}"


def job_part(job_id: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(job_id), F.lit(parts)).cast("int")


def _dealt(rows: DataFrame, parts: int) -> DataFrame:
    return rows.withColumn(part_name(parts), job_part(F.col("job_id"), parts))


def _writer(rows: DataFrame, parts: int, order: list[str]):
    name = part_name(parts)
    return (
        _dealt(rows, parts).hint("rebalance", F.col(name)).sortWithinPartitions(name, "job_id", *order).write
        .option("parquet.bloom.filter.enabled#job_id", "true")
        .option("parquet.bloom.filter.adaptive.enabled", "true")
        .partitionBy(name))


def write_by_job(rows: DataFrame, path: str, parts: int = PARTS, order: list[str] | None = None) -> None:
    """Store ``rows`` by their ``job_id``; inside a job they are sorted by ``order``."""
    _writer(rows, parts, order or []).mode("errorifexists").parquet(path)


def read_by_job(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The stored rows with their part column, which :func:`of_jobs` uses and drops.

    ``schema`` is that of the rows; no file is opened to infer it.
    """
    return spark.read.schema(schema).parquet(path)


def _part_column(table: DataFrame) -> re.Match | None:
    return next((m for m in map(_NAME.fullmatch, table.columns) if m), None)


def parts_of(jobs: DataFrame, parts: int) -> list[int]:
    """The folders that hold ``jobs``, on the driver: ``parts`` numbers at most."""
    return sorted(r[0] for r in jobs.select(job_part(F.col("job_id"), parts)).distinct().collect())


def of_jobs(table: DataFrame, jobs: DataFrame, few: bool = False) -> DataFrame:
    """The rows of ``table`` whose job is in ``jobs``, which names a job once.

    A table stored by job is joined on its part column too, so that Spark can prune folders while
    it runs. ``few`` finds the folders of the jobs first, in a run of ``jobs`` of its own, and
    then lists and opens no others. Any other table is joined on the job alone.
    """
    found = _part_column(table)
    if found is None:
        return table.join(jobs.select("job_id"), "job_id")
    name, parts = found[0], int(found[1])
    if few:
        table = table.where(F.col(name).isin(parts_of(jobs, parts)))
    return table.join(_dealt(jobs.select("job_id"), parts), [name, "job_id"]).drop(name)


def of_ids(table: DataFrame, job_ids: list[str]) -> DataFrame:
    """The rows of some jobs given by name, from a table read by :func:`read_by_job`.

    Each job is a comparison with its id and folder, which are both pushed into the scan: no
    other folder is listed, and row groups whose filter lacks the job are skipped.
    """
    name = _part_column(table)
    if name is None:
        return table.where(F.col("job_id").isin(job_ids))
    session = table.sparkSession
    wanted = F.lit(False)
    if job_ids:
        part = job_part(F.col("job_id"), int(name[1]))
        rows = session.createDataFrame([(j,) for j in sorted(set(job_ids))], "job_id string")
        for row in rows.select("job_id", part.alias("part")).collect():
            wanted = wanted | ((F.col(name[0]) == row.part) & (F.col("job_id") == row.job_id))
    return table.where(wanted).drop(name[0])


def upsert_by_job(spark: SparkSession, path: str, changes: DataFrame, parts: int = PARTS) -> list[int]:
    """Replace whole state rows in a stored state; the folders that were rewritten.

    ``changes`` holds at most one row per job; ``parts`` counts for a state without rows. Only folders with a changed job are read and
    written; files of the others stay as they are. A folder is replaced when all tasks are done,
    so a lost executor leaves the old state. One writer at a time, as with any such folder; a
    reader meanwhile may have to start again.
    """
    stored = read_by_job(spark, path, STATE_SCHEMA)
    found = _part_column(stored)
    parts = int(found[1]) if found else parts
    touched = parts_of(changes, parts)
    if touched:
        old = stored.where(F.col(found[0]).isin(touched)) if found else stored
        (_writer(upsert_state(old, changes), parts, [])
         .option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path))
    return touched
