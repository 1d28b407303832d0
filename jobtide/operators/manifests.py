"""Lists of a job's input and result files."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobtide.functions.status import results_ready
from jobtide.functions.times import or_epoch
from jobtide.functions.urls import download_name, input_key, object_url, result_key
from jobtide.operators.lookup import match_state

# Result kinds and their file extensions.
RESULT_FILES = [
    ("EMBL", "embl"),
    ("FAA", "faa"),
    ("FAAHypothetical", "hypotheticals.faa"),
    ("FFN", "ffn"),
    ("FNA", "fna"),
    ("GBFF", "gbff"),
    ("GFF3", "gff3"),
    ("JSON", "json"),
    ("TSV", "tsv"),
    ("TSVHypothetical", "hypotheticals.tsv"),
    ("TSVInference", "inference.tsv"),
    ("TXTLogs", "txt"),
    ("PNGCircularPlot", "png"),
    ("SVGCircularPlot", "svg"),
]
# Upload links and the input files they are for.
INPUT_FILES = [
    ("uploadLinkFasta", "fastadata.fasta"),
    ("uploadLinkProdigal", "prodigal.tf"),
    ("uploadLinkReplicons", "replicons.tsv"),
]


def _rows_of(table: list[tuple[str, str]], first: str, second: str) -> Column:
    return F.explode(F.array(*[
        F.struct(F.lit(a).alias(first), F.lit(b).alias(second)) for a, b in table]))


def result_answers(requests: DataFrame, state: DataFrame, strict: bool = False,
                   few: bool = False) -> DataFrame:
    """Per request: OK, NOT_FOUND, UNAUTHORIZED or NOT_FINISHED, with the job's data.

    A job that was never started counts as ready unless ``strict``; its missing times
    are given as the epoch.
    """
    matched = match_state(
        requests, state, ["status", "started", "updated", "name"], few)
    waiting = (F.col("access") == "OK") & ~results_ready(F.col("state_status"), strict)
    ok = F.col("outcome") == "OK"
    kept = [c for c in requests.columns if c not in ("job_id", "secret")]
    return matched.withColumn(
        "outcome", F.when(waiting, "NOT_FINISHED").otherwise(F.col("access"))
    ).select(
        *kept, "job_id", "outcome",
        F.when(ok, or_epoch(F.col("state_started"))).alias("started"),
        F.when(ok, or_epoch(F.col("state_updated"))).alias("updated"),
        F.when(ok, F.col("state_name")).alias("name"))


def result_manifest(answers: DataFrame) -> DataFrame:
    """The result files of every OK answer, one row per file.

    Files are listed, not looked for: a listed file need not exist.
    """
    kept = [c for c in answers.columns if c != "outcome"]
    ready = answers.where("outcome = 'OK'")
    files = ready.select(*kept, _rows_of(RESULT_FILES, "kind", "extension").alias("file"))
    return files.select(
        *kept, "file.kind",
        result_key(F.col("job_id"), F.col("file.extension")).alias("key"),
        download_name(F.col("name"), F.col("file.extension")).alias("filename"))


def upload_manifest(jobs: DataFrame) -> DataFrame:
    """The input files each job may upload, one row per file."""
    files = jobs.select("job_id", _rows_of(INPUT_FILES, "link", "file").alias("input"))
    return files.select("job_id", "input.link", input_key(F.col("job_id"), F.col("input.file")).alias("key"))


def with_urls(manifest: DataFrame, endpoint: str, bucket: str) -> DataFrame:
    """Add the unsigned object URL of each file."""
    filename = F.col("filename") if "filename" in manifest.columns else None
    return manifest.withColumn("url", object_url(F.lit(endpoint), F.lit(bucket), F.col("key"), filename))
