"""Registered queries: every operator, run over the whole test tables."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobtide.functions.ids import canonical_uuid
from jobtide.functions.rendering import pair_string, pairs
from jobtide.functions.status import is_terminal, known_phase, public_status, results_ready
from jobtide.functions.text import clean_name, clean_origin, quote
from jobtide.functions.times import parse_rfc3339
from jobtide.functions.urls import encoded_disposition
from jobtide.operators import deletes, logs, lookup, manifests, sinks, state, submissions
from jobtide.plans import tables
from jobtide.schemas import STATE_SCHEMA
from jobtide.session import configure, fresh_path
from jobtide.sources import job_parts
from jobtide.sources.configs import parse_starts
from jobtide.sources.inits import parse_inits
from jobtide.sources.landed import land_snapshots, read_landed_items
from jobtide.sources.requests import parse_requests, read_requests
from jobtide.sources.snapshots import parse_snapshots, read_snapshots, stream_snapshots
from jobtide.sources.submit_results import parse_submit_results
from jobtide.streaming import state_stream

Query = Callable[[SparkSession, str], DataFrame]

ENDPOINT, BUCKET = "https://s3.example.org", "results"
STORED_PARTS = 16
ANSWER_RANGE = 10_000
PREFIX, TOOL_VERSION, NAMESPACE = "annotate", "1.2.3", "jobs"

_QUERIES: dict[str, Query] = {}


def _query(build: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _plain_times(build(configure(spark), sf_dir))

    _QUERIES[build.__name__] = run
    return build


def _plain_times(df: DataFrame) -> DataFrame:
    """UTC instants as plain timestamps, the type the checks compare."""
    return df.select(*[
        F.col(f.name).cast("timestamp_ntz").alias(f.name)
        if isinstance(f.dataType, T.TimestampType) else F.col(f.name)
        for f in df.schema])


def _as_of():
    return F.expr(tables.AS_OF)


def _state(spark, sf_dir, *columns):
    feed = tables.view(spark, sf_dir, tables.FEED)
    return state.latest_state(feed, order=["seq"], columns=list(columns))


ANSWERED = ["secret", "status", "started", "updated", "name"]
LOGGED = ["secret", "status", "archived", "remote_uid", "workflow_name"]


def _requests(spark, sf_dir):
    return tables.view(spark, sf_dir, tables.REQUESTS)


# State from snapshots and change feeds

@_query
def latest_state(spark, sf_dir):
    return _state(spark, sf_dir)


@_query
def fold_changes(spark, sf_dir):
    return state.fold_changes(tables.view(spark, sf_dir, tables.CHANGES))


@_query
def live_state(spark, sf_dir):
    """The change feed as the tables its kinds of events are kept in."""
    feed = tables.view(spark, sf_dir, tables.CHANGES)

    def of(kind):
        return feed.where(F.col("kind") == kind)

    return state.live_state(of("SNAPSHOT"), of("INIT"), of("START"), of("DELETE"))


@_query
def register_jobs(spark, sf_dir):
    return state.register_jobs(tables.view(spark, sf_dir, tables.INITS))


@_query
def init_scan(spark, sf_dir):
    accepted, _ = parse_inits(tables.view(spark, sf_dir, tables.INIT_BODIES))
    return state.register_jobs(accepted)


@_query
def init_rejects(spark, sf_dir):
    return parse_inits(tables.view(spark, sf_dir, tables.INIT_BODIES))[1]


@_query
def upsert_state(spark, sf_dir):
    new = state.register_jobs(tables.view(spark, sf_dir, tables.NEW_JOBS))
    return state.upsert_state(_state(spark, sf_dir), new)


@_query
def tombstoned_state(spark, sf_dir):
    feed = tables.view(spark, sf_dir, tables.FEED)
    seen = feed.groupBy("job_id").agg(
        F.max_by("secret", "seq").alias("secret"), F.max_by("arrived", "seq").alias("snapshot_ts"))
    return state.apply_tombstones(seen, tables.view(spark, sf_dir, tables.TOMBSTONES))


def _flat(spark, sf_dir, on_error="quarantine"):
    documents = parse_snapshots(tables.snapshot_bodies(spark, sf_dir))
    return state.flatten_snapshots(documents, _as_of(), on_error)


@_query
def flatten_state(spark, sf_dir):
    return _flat(spark, sf_dir)[0]


@_query
def flatten_landed(spark, sf_dir):
    """Items landed as variants, in two batches, and read back by their fields."""
    path = fresh_path(spark, "landed")
    bodies = tables.snapshot_bodies(spark, sf_dir)
    first = F.pmod(F.xxhash64("snapshot"), F.lit(2)) == 0
    land_snapshots(bodies.where(first), path, "1")
    land_snapshots(bodies.where(~first), path, "2")
    return state.flatten_snapshots(read_landed_items(spark, path), _as_of())[0]


@_query
def state_rejects(spark, sf_dir):
    return _flat(spark, sf_dir)[1].select("snapshot", "pos", "reason", "unreadable")


@_query
def prefix_policy(spark, sf_dir):
    good, _ = _flat(spark, sf_dir, "prefix")
    return good.select("snapshot", "pos", "job_id", "status")


@_query
def prefix_rejects(spark, sf_dir):
    return _flat(spark, sf_dir, "prefix")[1].select("snapshot", "pos", "reason", "unreadable")


@_query
def snapshot_files(spark, sf_dir):
    """Snapshots through files and their reader; what a file is called is left out."""
    path = fresh_path(spark, "snapshots")
    tables.write_snapshots(spark, sf_dir, path)
    good, _ = state.flatten_snapshots(read_snapshots(spark, path), _as_of())
    return good.drop("snapshot", "snapshot_ts", "pos")


@_query
def poll_state(spark, sf_dir):
    """The files polled as a stream; rows are ordered by what is in them."""
    path = fresh_path(spark, "polled")
    tables.write_snapshots(spark, sf_dir, f"{path}/snapshots")
    rows, _ = state.flatten_snapshots(stream_snapshots(spark, f"{path}/snapshots"), _as_of())
    order = ["begun", "flow"]
    rows = rows.withColumn("begun", F.col("started")).withColumn("flow", F.col("workflow_name"))
    query = state_stream.start_state_stream(
        rows, f"{path}/changes", f"{path}/checkpoint", order=order, drain=True)
    query.awaitTermination()
    stored = state_stream.read_stream_state(
        spark, f"{path}/changes", state_stream.stored_schema(rows, order), order)
    return stored.select(*state.STATE_COLUMNS)


@_query
def snapshot_state(spark, sf_dir):
    return state.latest_state(_flat(spark, sf_dir)[0])


@_query
def stream_state(spark, sf_dir):
    source = tables.read(spark, sf_dir, "events")
    # As a pattern the path may be one file or a folder of files.
    events = spark.readStream.schema(source.schema).parquet(f"{sf_dir}/event[s].parquet")
    rows = events.selectExpr(*tables.FEED[1])
    path = fresh_path(spark, "stream-state")
    query = state_stream.start_state_stream(
        rows, f"{path}/changes", f"{path}/checkpoint", order=["seq"], drain=True)
    query.awaitTermination()
    schema = state_stream.stored_schema(rows, ["seq"])
    stored = state_stream.read_stream_state(spark, f"{path}/changes", schema, ["seq"])
    return stored.select(*state.STATE_COLUMNS)


@_query
def stream_fold(spark, sf_dir):
    """The change feed as four streams: listed jobs, registrations, starts and deletes."""
    schema = tables.read(spark, sf_dir, "events").schema

    def of(kind):
        events = spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet")
        return events.selectExpr(*tables.CHANGES[1]).where(F.col("kind") == kind)

    feed = state.change_feed(of("SNAPSHOT"), of("INIT"), of("START"), of("DELETE"))
    path = fresh_path(spark, "stream-fold")
    query = state_stream.start_fold_stream(feed, f"{path}/changes", f"{path}/checkpoint", drain=True)
    query.awaitTermination()
    schema = state_stream.stored_schema(feed, ["seq"])
    return state_stream.read_stream_state(spark, f"{path}/changes", schema, ["seq"]).select(*state.STATE_COLUMNS)


# The state as a table stored by job

def _stored_by_job(spark, rows, label, order=None):
    """``rows`` written by job and read back; few folders, as the test tables are small."""
    path = fresh_path(spark, label)
    job_parts.write_by_job(rows, path, STORED_PARTS, order)
    return path, job_parts.read_by_job(spark, path, rows.schema)


@_query
def upsert_stored(spark, sf_dir):
    """New jobs written into a stored state, folder by folder."""
    path, _ = _stored_by_job(spark, _state(spark, sf_dir), "state-by-job")
    new = state.register_jobs(tables.view(spark, sf_dir, tables.NEW_JOBS))
    job_parts.upsert_by_job(spark, path, new, STORED_PARTS)
    return job_parts.read_by_job(spark, path, STATE_SCHEMA).select(*state.STATE_COLUMNS)


@_query
def lookup_stored(spark, sf_dir):
    """The lookup of all requests against a stored state, pruned to the requested jobs."""
    rows = _state(spark, sf_dir, *ANSWERED)
    _, stored = _stored_by_job(spark, rows, "lookup-by-job")
    requests = _requests(spark, sf_dir)
    asked = job_parts.of_jobs(stored, requests.select("job_id").distinct(), few=True)
    return lookup.lookup_jobs(requests, asked, _as_of())


# Requests and lookups

@_query
def request_scan(spark, sf_dir):
    return parse_requests(tables.view(spark, sf_dir, tables.REQUEST_BODIES))[0]


@_query
def request_rejects(spark, sf_dir):
    return parse_requests(tables.view(spark, sf_dir, tables.REQUEST_BODIES))[1]


@_query
def request_files(spark, sf_dir):
    """Requests through files and their reader; ids that come from file names are left out."""
    path = fresh_path(spark, "requests")
    tables.write_requests(spark, sf_dir, path)
    accepted, _ = read_requests(spark, path)
    return accepted.select("pos", "job_id", "secret")


def _answers(spark, sf_dir):
    return lookup.lookup_jobs(
        _requests(spark, sf_dir), _state(spark, sf_dir, *ANSWERED), _as_of())


@_query
def job_lookup(spark, sf_dir):
    return _answers(spark, sf_dir)


@_query
def lookup_found(spark, sf_dir):
    return lookup.found_jobs(_answers(spark, sf_dir))


@_query
def lookup_failed(spark, sf_dir):
    return lookup.failed_jobs(_answers(spark, sf_dir))


@_query
def answer_files(spark, sf_dir):
    """Answers through the two written lists, each line with its number in the file of its range."""
    path = fresh_path(spark, "answers")
    sinks.write_answers(_answers(spark, sf_dir), path, ["pos"], per_range=ANSWER_RANGE)
    return sinks.read_answers(spark, path)


@_query
def public_state(spark, sf_dir):
    return lookup.public_rows(_state(spark, sf_dir, *ANSWERED))


@_query
def request_lookup(spark, sf_dir):
    """Lookups straight from request bodies, told apart by body and place."""
    accepted, _ = parse_requests(tables.view(spark, sf_dir, tables.REQUEST_BODIES))
    return lookup.lookup_jobs(accepted, _state(spark, sf_dir, *ANSWERED), _as_of())


# Deletes

def _deletes(spark, sf_dir):
    requests = tables.view(spark, sf_dir, tables.DELETES)
    return requests, deletes.mark_deleted(requests, _state(spark, sf_dir))


@_query
def delete_outcomes(spark, sf_dir):
    requests = tables.view(spark, sf_dir, tables.DELETES)
    return deletes.delete_outcomes(requests, _state(spark, sf_dir, "secret"))


@_query
def delete_remaining(spark, sf_dir):
    return deletes.remaining_state(_deletes(spark, sf_dir)[1])


@_query
def delete_targets(spark, sf_dir):
    return deletes.delete_targets(_deletes(spark, sf_dir)[1], NAMESPACE)


# Configs and submissions

def _starts(spark, sf_dir):
    bodies = tables.view(spark, sf_dir, tables.START_BODIES)
    good, rejected = parse_starts(bodies)
    return good.withColumn("origin", clean_origin(F.col("raw_origin"))).drop("raw_origin"), rejected


@_query
def config_scan(spark, sf_dir):
    return _starts(spark, sf_dir)[0].select(
        "pos", "job_id", "secret", "origin", "config.*",
    ).withColumn("min_contig_length", F.col("min_contig_length").cast("string"))


@_query
def config_rejects(spark, sf_dir):
    return _starts(spark, sf_dir)[1].select("pos", "reason")


@_query
def job_parameters(spark, sf_dir):
    return submissions.build_parameters(_starts(spark, sf_dir)[0]).select("pos", "job_id", "parameters")


def _plans(spark, sf_dir):
    return submissions.plan_submissions(
        _starts(spark, sf_dir)[0], _state(spark, sf_dir, "secret", "name"), PREFIX, TOOL_VERSION, NAMESPACE)


@_query
def submission_manifest(spark, sf_dir):
    return _plans(spark, sf_dir).withColumn("parameters", F.array_join("parameters", "\n"))


@_query
def submission_documents(spark, sf_dir):
    return submissions.submission_documents(_plans(spark, sf_dir))


def _results(spark, sf_dir):
    return parse_submit_results(tables.view(spark, sf_dir, tables.SUBMIT_RESULTS))


@_query
def submit_results(spark, sf_dir):
    return _results(spark, sf_dir)


@_query
def apply_submissions(spark, sf_dir):
    return submissions.apply_submissions(
        _state(spark, sf_dir), _results(spark, sf_dir), _as_of())


# Logs

@_query
def log_lines(spark, sf_dir):
    return logs.clean_lines(logs.parse_lines(tables.log_lines(spark, sf_dir)))


@_query
def broken_logs(spark, sf_dir):
    return logs.broken_logs(logs.parse_lines(tables.log_lines(spark, sf_dir)))


@_query
def log_chunks(spark, sf_dir):
    lines = logs.clean_lines(logs.parse_lines(tables.log_lines(spark, sf_dir)))
    pieces = lines.select("job_id", "part", "line_no", F.concat("content", F.lit("\n")).alias("piece"))
    return logs.log_chunks(pieces, chunk_lines=2, chunk_bytes=400)


@_query
def log_paths(spark, sf_dir):
    return logs.log_paths(_state(spark, sf_dir, *LOGGED), NAMESPACE)


def _logs(spark, sf_dir):
    return logs.assemble_logs(
        _requests(spark, sf_dir), _state(spark, sf_dir, *LOGGED),
        tables.log_lines(spark, sf_dir), tables.archived_lines(spark, sf_dir))


@_query
def job_logs_stored(spark, sf_dir):
    """The logs of the wanted jobs from tables stored by job."""
    place = ["part", "line_no"]
    _, lines = _stored_by_job(spark, tables.log_lines(spark, sf_dir), "lines-by-job", place)
    _, archived = _stored_by_job(spark, tables.archived_lines(spark, sf_dir), "archived-by-job", place)
    return logs.assemble_logs(
        _requests(spark, sf_dir), _state(spark, sf_dir, *LOGGED), lines, archived)[1]


@_query
def log_routing(spark, sf_dir):
    return _logs(spark, sf_dir)[0]


@_query
def job_logs(spark, sf_dir):
    return _logs(spark, sf_dir)[1]


# File lists

def _result_answers(spark, sf_dir, strict=False):
    return manifests.result_answers(
        _requests(spark, sf_dir), _state(spark, sf_dir, *ANSWERED), strict)


@_query
def result_answers(spark, sf_dir):
    return _result_answers(spark, sf_dir)


@_query
def result_answers_strict(spark, sf_dir):
    return _result_answers(spark, sf_dir, strict=True)


@_query
def result_manifest(spark, sf_dir):
    return manifests.result_manifest(_result_answers(spark, sf_dir))


@_query
def result_urls(spark, sf_dir):
    files = manifests.result_manifest(_result_answers(spark, sf_dir))
    return manifests.with_urls(files, ENDPOINT, BUCKET).select("pos", "kind", "filename", "url")


@_query
def upload_manifest(spark, sf_dir):
    jobs = state.register_jobs(tables.view(spark, sf_dir, tables.INITS))
    return manifests.with_urls(manifests.upload_manifest(jobs), "http://s3.example.org", BUCKET)


# Column functions

@_query
def status_map(spark, sf_dir):
    phase = F.expr(f"coalesce({tables.PHASE}, event_type)")
    known = known_phase(phase)
    return tables.read(spark, sf_dir, "events").select(
        "event_id", phase.alias("phase"), known.alias("known"),
        public_status(known).alias("status"), is_terminal(known).alias("terminal"),
        results_ready(known).alias("ready"), results_ready(known, strict=True).alias("finished"))


@_query
def name_cleanup(spark, sf_dir):
    return tables.read(spark, sf_dir, "documents").select(
        "doc_id", clean_name(F.col("text")).alias("name"))


@_query
def origin_cleanup(spark, sf_dir):
    return tables.read(spark, sf_dir, "pages").select(
        "page_id", clean_origin(F.col("url")).alias("origin"),
        clean_origin(F.col("html")).alias("html_origin"))


@_query
def quoted_text(spark, sf_dir):
    return tables.read(spark, sf_dir, "documents").select(
        "doc_id", quote(F.col("text")).alias("quoted"))


@_query
def uuid_forms(spark, sf_dir):
    raw = F.expr(tables.UUID_FORMS)
    return tables.read(spark, sf_dir, "events").select(
        "event_id", raw.alias("raw"), canonical_uuid(raw).alias("canonical"))


@_query
def time_forms(spark, sf_dir):
    raw = F.expr(tables.TIME_FORMS)
    return tables.read(spark, sf_dir, "events").select(
        "event_id", raw.alias("raw"), parse_rfc3339(raw).alias("instant"))


@_query
def label_strings(spark, sf_dir):
    labels = F.create_map(
        F.lit("segment"), F.col("c_mktsegment"), F.lit("name"), F.col("c_name"),
        F.lit("key"), F.col("c_custkey").cast("string"))
    return tables.read(spark, sf_dir, "customer").select(
        "c_custkey", pair_string(labels).alias("labels"),
        F.array_join(pairs(labels), "\n").alias("parameters"))


@_query
def download_headers(spark, sf_dir):
    return tables.read(spark, sf_dir, "pages").select(
        "page_id", encoded_disposition(F.col("url")).alias("disposition"))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)
