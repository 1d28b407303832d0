"""Answers of the workflow server to submissions."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobtide.functions.json import field, is_whole, parse_document, text_of
from jobtide.functions.once import compute_once
from jobtide.functions.times import parse_rfc3339
from jobtide.sources.text_lines import read_job_bodies


def parse_submit_results(bodies: DataFrame) -> DataFrame:
    """``(pos, job_id, body)`` to ``(pos, job_id, name, creation_timestamp)``.

    A body that is not one document with both fields as text changes nothing and is left
    out.
    """
    kept = ["pos", "job_id"]
    parsed = compute_once(bodies.select(*kept, "body"), kept, parse_document(F.col("body")).alias("document"))
    document = F.col("document")
    answer = parsed.where(is_whole(document)).select(
        *kept, text_of(field(document, ".metadata.name")).alias("name"),
        parse_rfc3339(text_of(field(document, ".metadata.creationTimestamp"))).alias("creation_timestamp"))
    return answer.dropna(subset=["name", "creation_timestamp"])


def read_submit_results(spark: SparkSession, path: str) -> DataFrame:
    """Answers stored as ``{"job_id": ..., "body": "..."}`` lines; ``pos`` is their place."""
    return parse_submit_results(read_job_bodies(spark, path, ["job_id"]))
