"""Job registrations: a name and a table type, with the id and secret given to the job."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobtide.functions.json import field, is_whole, kind, parse_document, text_of
from jobtide.functions.once import compute_once
from jobtide.sources.text_lines import read_job_bodies

# The words a table type may be. Which one it is has no further effect.
TABLE_TYPES = ["CSV", "TSV"]


def parse_inits(bodies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split ``(job_id, secret, body)`` into ``(job_id, secret, name)`` and rejected bodies."""
    kept = bodies.columns
    parsed = compute_once(bodies, kept, parse_document(F.col("body")).alias("document"))
    document = F.col("document")
    fields = parsed.select(
        *kept, is_whole(document).alias("whole"),
        field(document, ".name").alias("raw_name"),
        field(document, ".repliconTableType").alias("raw_type"))
    reason = (
        F.when(~F.coalesce("whole", F.lit(False)), "bad document")
        .when(F.col("raw_name").isNull(), "missing name")
        .when(kind(F.col("raw_name")) != "STRING", "bad name")
        .when(F.col("raw_type").isNull(), "missing repliconTableType")
        .when(~F.coalesce(text_of(F.col("raw_type")).isin(TABLE_TYPES), F.lit(False)),
              "bad repliconTableType")
    )
    checked = compute_once(
        fields, kept, text_of(F.col("raw_name")).alias("name"), reason.alias("reason"))
    accepted = checked.where("reason is null").select("job_id", "secret", "name")
    rejected = checked.where("reason is not null").select("job_id", "body", "reason")
    return accepted, rejected


def read_inits(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Registrations stored as ``{"job_id": ..., "secret": ..., "body": "..."}`` lines."""
    bodies = read_job_bodies(spark, path, ["job_id", "secret"])
    return parse_inits(bodies.drop("pos"))
