"""Job logs: routing, cleaning and joining lines to text.

Log text comes in chunks of a bounded number of lines and bytes, so that one very long log
is spread over many tasks. Concatenating a job's chunks in (part, chunk, section) order
gives its whole log. Text is given once per job and not once per request.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from jobtide.functions.json import field, is_whole, parse_document, text_of
from jobtide.functions.once import compute_once
from jobtide.functions.text import drop_cr, has_text, is_runner_line
from jobtide.operators.lookup import match_state
from jobtide.sources.job_parts import of_jobs

# Fixed value: shown in place of the log of a job that ended in an internal error.
ERROR_TEXT = "Internal server error, please contact the administrator or try again later."
CHUNK_LINES = 10_000
CHUNK_BYTES = 8 << 20


def _log_source(prefix: str = ""):
    """Where a job's log comes from; the order of the tests matters."""
    def col(name):
        return F.col(prefix + name)

    return (
        F.when(col("status") == "Error", "ERROR_TEXT")
        .when(col("archived") & col("remote_uid").isNotNull(), "ARCHIVED")
        .when(col("archived"), "NONE")
        .when(col("workflow_name").isNotNull(), "LINES")
        .otherwise("NONE")
    )


def route_logs(requests: DataFrame, state: DataFrame, few: bool = False) -> DataFrame:
    """Per request: access, log source, and the text where it needs no log table."""
    matched = match_state(
        requests, state, ["status", "archived", "remote_uid", "workflow_name"], few)
    routed = matched.withColumn("source", F.when(F.col("access") == "OK", _log_source("state_")))
    kept = [c for c in requests.columns if c not in ("job_id", "secret")]
    text = F.when(F.col("source") == "ERROR_TEXT", ERROR_TEXT).when(F.col("source") == "NONE", "")
    return routed.select(*kept, "job_id", F.col("access").alias("outcome"), "source", text.alias("text"))


def log_paths(state: DataFrame, namespace: str) -> DataFrame:
    """``(job_id, source, log_path)``: where the workflow server keeps each job's log.

    An archived log is named by the workflow's uid and name, where an unknown name is
    empty; a running one by its name. Null where there is no log.
    """
    source = _log_source()
    # Path formats of the workflow server.
    archived = F.concat(
        F.lit(f"/artifact-files/{namespace}/archived-workflows/"), F.col("remote_uid"), F.lit("/"),
        F.coalesce("workflow_name", F.lit("")), F.lit("/outputs/main-logs"))
    live = F.concat(
        F.lit(f"/api/v1/workflows/{namespace}/"), F.col("workflow_name"),
        F.lit("/log?logOptions.container=main"))
    return state.select(
        "job_id", source.alias("source"),
        F.when(source == "ARCHIVED", archived).when(source == "LINES", live).alias("log_path"))


def wanted_logs(requests: DataFrame, state: DataFrame) -> DataFrame:
    """``(job_id, source)`` of every job that an allowed request asks for, once each."""
    asked = requests.select("job_id", "secret").distinct()
    jobs = state.select("job_id", "secret", _log_source().alias("source"))
    return jobs.join(asked, ["job_id", "secret"], "left_semi").select("job_id", "source")


def parse_lines(lines: DataFrame) -> DataFrame:
    """Non-blank enveloped lines with their ``content``, null if a line is malformed."""
    kept = ["job_id", "part", "line_no"]
    enveloped = lines.withColumn("line", drop_cr(F.col("line"))).where(has_text(F.col("line")))
    parsed = enveloped.select(*kept, parse_document(F.col("line")).alias("document"))
    document = F.col("document")
    content = F.when(is_whole(document), text_of(field(document, ".result.content")))
    return compute_once(parsed, kept, content.alias("content"))


def clean_lines(parsed: DataFrame) -> DataFrame:
    """Readable lines that are not the workflow runner's own."""
    return parsed.where(F.col("content").isNotNull() & ~is_runner_line(F.col("content")))


def broken_logs(parsed: DataFrame) -> DataFrame:
    """Jobs whose log cannot be given because a line is malformed."""
    return parsed.where("content is null").select("job_id").distinct()


def log_chunks(pieces: DataFrame, chunk_lines: int = CHUNK_LINES,
               chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``(job_id, part, chunk, section, text)`` from ordered pieces of text.

    A chunk is a fixed range of line numbers. Where its text is longer than
    ``chunk_bytes`` it comes in several sections, by the bytes before each line in the
    chunk; a longer line is a section of its own. A chunk with a null piece has null text.
    """
    chunk = F.floor(F.col("line_no") / chunk_lines)
    inside = Window.partitionBy("job_id", "part", "chunk").orderBy("line_no")
    before = F.sum(F.coalesce(F.octet_length("piece"), F.lit(0))).over(
        inside.rowsBetween(Window.unboundedPreceding, -1))
    section = F.floor(F.coalesce(before, F.lit(0)) / chunk_bytes)
    return (
        pieces.withColumn("chunk", chunk).withColumn("section", section)
        .groupBy("job_id", "part", "chunk", "section")
        .agg(F.sort_array(F.collect_list(F.struct("line_no", "piece"))).alias("lines"),
             F.bool_or(F.col("piece").isNull()).alias("broken"))
        .select("job_id", "part", "chunk", "section",
                F.when(~F.col("broken"), F.array_join("lines.piece", "")).alias("text"))
    )


def assemble_logs(requests: DataFrame, state: DataFrame, lines: DataFrame, archived: DataFrame,
                  chunk_lines: int = CHUNK_LINES, chunk_bytes: int = CHUNK_BYTES,
                  few: bool = False) -> tuple[DataFrame, DataFrame]:
    """Answers per request (:func:`route_logs`) and log chunks per wanted job.

    ``lines`` is ``(job_id, part, line_no, line)``; ``archived`` also has ``open_ended``.
    Only lines of wanted jobs are parsed, and each table is read once. Every wanted job
    with a log table has at least one chunk, so an empty log is ``""``; a malformed line
    leaves its job with one chunk of null text and ``log_error`` set. From tables stored by job
    (:mod:`jobtide.sources.job_parts`) only folders of wanted jobs are read; with ``few`` these are
    found first.
    """
    wanted = wanted_logs(requests, state).where("source in ('LINES', 'ARCHIVED')")
    place = ["job_id", "part", "line_no"]

    def of(source: str, table: DataFrame) -> DataFrame:
        return of_jobs(table, wanted.where(F.col("source") == source), few)

    parsed = parse_lines(of("LINES", lines))
    # a malformed line is a null piece; the runner's own lines are none
    told = parsed.where(F.col("content").isNull() | ~is_runner_line(F.col("content"))).select(
        *place, F.concat("content", F.lit("\n")).alias("piece"))
    stored = of("ARCHIVED", archived).select(
        *place, F.concat("line", F.when(F.col("open_ended"), "").otherwise("\n")).alias("piece"))
    chunks = log_chunks(told.unionByName(stored), chunk_lines, chunk_bytes)
    # Both uses of the chunks need the same shuffled lines, so these are read once.
    broken = chunks.where("text is null").select("job_id").distinct().withColumn("log_error", F.lit(True))
    jobs = (wanted.select("job_id").join(broken, "job_id", "left")
            .withColumn("log_error", F.coalesce("log_error", F.lit(False))))
    whole = chunks.where("text is not null")
    zero = F.lit(0).cast("long")
    answers = jobs.join(whole, (jobs["job_id"] == whole["job_id"]) & ~jobs["log_error"], "left").select(
        jobs["job_id"], *[F.coalesce(c, zero).alias(c) for c in ("part", "chunk", "section")],
        F.when(~F.col("log_error"), F.coalesce("text", F.lit(""))).alias("text"), "log_error")
    return route_logs(requests, state, few), answers
