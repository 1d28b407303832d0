"""Job starts: a job reference plus a config whose fields are checked one by one."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobtide.functions.ids import canonical_uuid
from jobtide.functions.json import is_whole, kind, parse_document, text_of
from jobtide.functions.once import compute_once
from jobtide.sources.text_lines import read_bodies

# JSON field, column name and rule, in the order they are checked.
CONFIG_FIELDS = [
    ("prodigalTrainingFile", "prodigal_training_file", "optional text"),
    ("hasReplicons", "has_replicons", "flag, true if missing"),
    ("translationTable", "translation_table", "unsigned 8 bit"),
    ("completeGenome", "complete_genome", "flag"),
    ("keepContigHeaders", "keep_contig_headers", "flag"),
    ("minContigLength", "min_contig_length", "unsigned 64 bit"),
    ("dermType", "derm_type", "optional derm word"),
    ("genus", "genus", "optional text"),
    ("species", "species", "optional text"),
    ("strain", "strain", "optional text"),
    ("plasmid", "plasmid", "optional text"),
    ("locus", "locus", "optional text"),
    ("locusTag", "locus_tag", "optional text"),
    ("compliant", "compliant", "flag"),
]
# The words a derm type may be.
DERM_TYPES = ["UNKNOWN", "MONODERM", "DIDERM"]
MAX_U64 = str(2**64 - 1)


_VARIANTS = ", ".join(f"{name} variant" for name, _, _ in CONFIG_FIELDS)
_SHAPE = f"struct<job struct<secret variant, jobID variant>, config struct<{_VARIANTS}>>"


def _typed(value: Column, written: Column, rule: str) -> Column:
    """The value of a field if it keeps its rule, null if it is absent or does not."""
    def read_as(type_name: str) -> Column:
        return F.try_variant_get(value, "$", type_name)

    if rule.startswith("optional"):
        text = F.when(written == "STRING", read_as("string"))
        return F.when(text.isin(DERM_TYPES), text) if rule == "optional derm word" else text
    if rule.startswith("flag"):
        flag = F.when(written == "BOOLEAN", read_as("boolean"))
        return flag if rule == "flag" else F.when(written.isNull(), F.lit(True)).otherwise(flag)
    if rule == "unsigned 8 bit":
        number = F.when(written == "BIGINT", read_as("smallint"))
        return F.when(number.between(0, 255), number)
    # Whole numbers past the signed range are written as decimals without a fraction.
    whole = (written == "BIGINT") | written.isin("DECIMAL(19,0)", "DECIMAL(20,0)")
    number = F.when(whole, read_as("decimal(20,0)"))
    return F.when(number.between(F.lit(0), F.lit(MAX_U64).cast("decimal(20,0)")), number)


def _problem(name: str, value: Column, written: Column, rule: str) -> Column:
    if rule.startswith("optional"):
        return F.when(value.isNull() & (written != "VOID"), f"bad {name}")
    return F.when(value.isNull() & written.isNull(), f"missing {name}").when(
        value.isNull(), f"bad {name}")


def parse_starts(bodies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split ``(request_id, body, ...)`` into checked starts and rejected bodies.

    Starts carry ``job_id``, ``secret`` and a ``config`` struct; other input columns
    (``origin``) pass through.
    """
    carried = [c for c in bodies.columns if c != "body"]
    kept = [*carried, "body"]
    parsed = compute_once(bodies, kept, parse_document(F.col("body")).alias("document"))
    # Each step is its own projection, so that later ones read columns and do not repeat it.
    raw = parsed.select(
        *kept, is_whole(F.col("document")).alias("whole"),
        F.try_variant_get("document", "$[0]", _SHAPE).alias("raw"))
    written = raw.select(
        "*",
        text_of(F.col("raw.job.jobID")).alias("raw_job_id"),
        text_of(F.col("raw.job.secret")).alias("secret"),
        *[kind(F.col(f"raw.config.{name}")).alias(f"kind_{column}")
          for name, column, _ in CONFIG_FIELDS])
    typed = written.select(
        "*", canonical_uuid(F.col("raw_job_id")).alias("job_id"),
        *[_typed(F.col(f"raw.config.{name}"), F.col(f"kind_{column}"), rule).alias(column)
          for name, column, rule in CONFIG_FIELDS])
    reason = F.coalesce(
        F.when(~F.coalesce("whole", F.lit(False)), "bad document"),
        F.when(F.col("job_id").isNull(), "bad jobID"),
        F.when(F.col("secret").isNull(), "bad secret"),
        *[_problem(name, F.col(column), F.col(f"kind_{column}"), rule)
          for name, column, rule in CONFIG_FIELDS])
    checked = compute_once(
        typed, kept, F.col("job_id"), F.col("secret"),
        F.struct(*[column for _, column, _ in CONFIG_FIELDS]).alias("config"),
        reason.alias("reason"))
    good = checked.where("reason is null").select(*carried, "job_id", "secret", "config")
    rejected = checked.where("reason is not null").select(*carried, "body", "reason")
    return good, rejected


def read_starts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return parse_starts(read_bodies(spark, path))
