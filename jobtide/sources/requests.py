"""Status requests: a JSON list of (secret, job id) pairs per body."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobtide.functions.ids import canonical_uuid
from jobtide.functions.json import is_whole, parse_document, text_of
from jobtide.functions.once import compute_once
from jobtide.sources.text_lines import read_bodies


def parse_requests(bodies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split ``(request_id, body)`` into request rows and rejected bodies.

    One bad pair rejects its whole body. Accepted rows are
    ``(request_id, pos, job_id, secret)``, ``pos`` being the place in the list.
    """
    kept = ["request_id", "body"]
    parsed = compute_once(bodies, kept, parse_document(F.col("body")).alias("document"))
    pairs = F.try_variant_get("document", "$[0].jobs", "array<struct<secret variant, jobID variant>>")
    # in two steps, as a lambda works out a part as often as it is named
    texts = F.transform(pairs, lambda p: F.struct(
        text_of(p["secret"]).alias("secret"), text_of(p["jobID"]).alias("raw")))
    typed = F.transform(texts, lambda p: F.struct(
        canonical_uuid(p["raw"]).alias("job_id"), p["secret"].alias("secret")))
    listed = compute_once(parsed, kept, F.when(is_whole(F.col("document")), typed).alias("pairs"))
    reason = (
        F.when(F.col("pairs").isNull(), "bad_list")
        .when(F.exists("pairs", lambda p: p["job_id"].isNull() | p["secret"].isNull()), "bad_job"))
    checked = compute_once(listed, kept, F.col("pairs"), reason.alias("reason"))
    accepted = (
        checked.where("reason is null")
        .select("request_id", F.posexplode("pairs").alias("pos", "pair"))
        .select("request_id", "pos", "pair.job_id", "pair.secret"))
    rejected = checked.where("reason is not null").select("request_id", "body", "reason")
    return accepted, rejected


def read_requests(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return parse_requests(read_bodies(spark, path))
