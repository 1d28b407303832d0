"""The job-state table: from snapshots, from change feeds, and its updates."""

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobtide.functions.ids import canonical_uuid
from jobtide.functions.once import compute_once
from jobtide.functions.status import known_phase
from jobtide.functions.text import clean_name
from jobtide.functions.times import moment, parse_rfc3339
from jobtide.schemas import (
    DEFAULT_NAME, DEFAULT_SECRET, LABEL_ARCHIVED, LABEL_JOB_ID, LABEL_NAME, LABEL_SECRET,
    STATE_COLUMNS, STATE_SCHEMA, STATE_VALUES,
)

SNAPSHOT_ORDER = ["snapshot_ts", "snapshot", "pos"]


def _typed(meta: Column, status: Column) -> Column:
    """The parts of an item that need work, each worked out once."""
    def label(key: str) -> Column:
        return F.try_element_at(meta["labels"], F.lit(key))

    return F.struct(
        label(LABEL_JOB_ID).alias("raw_job_id"),
        canonical_uuid(label(LABEL_JOB_ID)).alias("job_id"),
        canonical_uuid(meta["uid"]).alias("remote_uid"),
        known_phase(status["phase"]).alias("phase"),
        parse_rfc3339(status["startedAt"]).alias("started"),
        parse_rfc3339(status["finishedAt"]).alias("finished"),
        label(LABEL_NAME).alias("raw_name"),
        label(LABEL_SECRET).alias("raw_secret"),
    )


def _judged(meta: Column, status: Column, fault: Column, typed: Column, as_of: Column) -> Column:
    """An item as a state row, with the reason if it cannot be one.

    ``unreadable`` marks faults that make the whole document undecodable; the other
    faults concern the item alone.
    """
    labels = meta["labels"]
    # Looking for a value that is not there gives null if the array holds a null.
    null_label = F.array_contains(F.map_values(labels), "\0").isNull()
    unreadable = (
        F.when(meta.isNull() | status.isNull(), "bad_document")
        .when(fault.isNotNull(), fault)
        .when(meta["name"].isNull(), "missing_name")
        .when(meta["uid"].isNull(), "missing_uid")
        .when(typed["remote_uid"].isNull(), "bad_uid")
        .when(labels.isNull(), "missing_labels")
        .when(null_label, "bad_label")
        .when(status["phase"].isNull(), "missing_phase")
        .when(status["startedAt"].isNull(), "missing_started_at")
        .when(typed["started"].isNull(), "bad_started_at")
        .when(status["finishedAt"].isNotNull() & typed["finished"].isNull(), "bad_finished_at")
    )
    unusable = (
        F.when(typed["raw_job_id"].isNull(), "missing_jobid")
        .when(typed["job_id"].isNull(), "bad_jobid")
        .when(typed["phase"].isNull(), "unknown_phase")
    )
    return F.struct(
        typed["job_id"].alias("job_id"), typed["remote_uid"].alias("remote_uid"),
        meta["resourceVersion"].alias("resource_version"),
        F.coalesce(typed["raw_name"], F.lit(DEFAULT_NAME)).alias("name"),
        typed["phase"].alias("phase"), typed["started"].alias("started"),
        F.coalesce(typed["finished"], as_of).alias("updated"),
        meta["name"].alias("workflow_name"),
        F.coalesce(typed["raw_secret"], F.lit(DEFAULT_SECRET)).alias("secret"),
        F.coalesce(F.map_contains_key(labels, LABEL_ARCHIVED), F.lit(False)).alias("archived"),
        typed["raw_secret"].isNull().alias("secret_missing"),
        unreadable.isNotNull().alias("unreadable"),
        F.coalesce(unreadable, unusable).alias("reason"),
    )


def _check_documents(documents: DataFrame, as_of: Column) -> DataFrame:
    """One checked row per item, with what its document's other items decide.

    The items are judged inside the document, before they are made rows, so the place of
    the first bad one is known without bringing them together again, also in a stream.
    """
    kept = [c for c in documents.columns if c != "items"]
    first = F.transform("items", lambda x: F.struct(
        x["metadata"].alias("metadata"), x["status"].alias("status"),
        x["type_fault"].alias("type_fault"), _typed(x["metadata"], x["status"]).alias("typed")))
    checked = F.transform(first, lambda x: F.struct(
        x["metadata"].alias("metadata"), x["status"].alias("status"),
        _judged(x["metadata"], x["status"], x["type_fault"], x["typed"], as_of).alias("row")))
    whole = compute_once(documents, kept, checked.alias("checked"))
    places = F.transform("checked", lambda x, i: F.when(
        x["row"]["reason"].isNotNull() & ~x["row"]["unreadable"], i))
    return (
        whole.select(
            *kept, F.array_min(places).alias("first_bad"),
            F.exists("checked", lambda x: x["row"]["unreadable"]).alias("lost"),
            F.posexplode("checked").alias("pos", "item"))
        .select(*kept, "pos", "item.metadata", "item.status", "item.row.*", "first_bad", "lost"))


def _check_items(items: DataFrame, as_of: Column, prefix: bool) -> DataFrame:
    """The same for items that come as rows; only ``prefix`` brings a snapshot's together."""
    fault = F.col("type_fault") if "type_fault" in items.columns else F.lit(None).cast("string")
    kept = [c for c in items.columns if c != "type_fault"]
    meta, status = F.col("metadata"), F.col("status")
    typed = items.withColumn("typed", _typed(meta, status))
    judged = compute_once(typed, kept, _judged(meta, status, fault, F.col("typed"), as_of).alias("row"))
    checked = judged.select(*kept, "row.*")
    if not prefix:
        return checked
    faults = (
        checked.where("reason is not null")
        .groupBy("snapshot")
        .agg(F.min(F.when(~F.col("unreadable"), F.col("pos"))).alias("first_bad"),
             F.bool_or("unreadable").alias("lost")))
    return checked.join(faults, "snapshot", "left")


def classify_items(source: DataFrame, as_of: Column | datetime,
                   on_error: str = "quarantine") -> DataFrame:
    """Snapshot items as state rows, each with the ``reason`` it is rejected for or null.

    ``source`` holds documents, ``(snapshot, snapshot_ts, items)``, or items as rows.
    ``on_error="quarantine"`` rejects bad items only. ``on_error="prefix"`` also drops
    every item from the first bad one on, and the whole snapshot if any of its items is
    unreadable. ``as_of`` stands in for the finish time of unfinished jobs; in a stream
    use the ``snapshot_ts`` column.
    """
    if on_error not in ("quarantine", "prefix"):
        raise ValueError(f"on_error is 'quarantine' or 'prefix', not {on_error!r}")
    prefix = on_error == "prefix"
    if "items" in source.columns:
        checked = _check_documents(source, moment(as_of))
    else:
        checked = _check_items(source, moment(as_of), prefix)
    if prefix:
        checked = checked.withColumn("reason", F.coalesce(
            F.col("reason"),
            F.when(F.col("lost"), "snapshot_unreadable"),
            F.when(F.col("pos") > F.col("first_bad"), "after_bad_item")))
    return checked.drop("first_bad", "lost")


def split_items(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """State rows and reject rows of classified items."""
    good = checked.where("reason is null").select(
        "snapshot", "snapshot_ts", "pos",
        *[F.col("phase").alias("status") if c == "status" else F.col(c) for c in STATE_COLUMNS],
        "secret_missing")
    rejects = checked.where("reason is not null").select(
        "snapshot", "snapshot_ts", "pos", "reason", "unreadable", "metadata", "status")
    return good, rejects


def flatten_snapshots(source: DataFrame, as_of: Column | datetime,
                      on_error: str = "quarantine") -> tuple[DataFrame, DataFrame]:
    """State rows and reject rows of snapshot items, see :func:`classify_items`.

    To parse the documents only once for both, land the classified items first.
    """
    return split_items(classify_items(source, as_of, on_error))


def latest_state(rows: DataFrame, order: list[str] | None = None,
                 columns: list[str] | None = None) -> DataFrame:
    """Last row per job in arrival order, the whole row replacing earlier ones.

    An aggregate rather than a ranked window: each task first reduces its own rows to
    one per job, so a job with very many rows is never gathered. The row travels as one
    value, so name the state ``columns`` to keep if not all are needed. Each task sorts its
    rows by job to reduce them, as a row with texts cannot be updated in a hash table.
    """
    values = [c for c in columns or STATE_VALUES if c != "job_id"]
    newest = newest_row(values, order or SNAPSHOT_ORDER)
    return rows.groupBy("job_id").agg(newest).select("job_id", *[f"newest.{c}" for c in values])


def newest_row(values: list[str], order: list[str]) -> Column:
    """Aggregate ``newest``: the values of the row that is last in ``order``, and the order."""
    arrival = F.struct(*[F.col(c).alias(f"order_{c}") for c in order])
    return F.max(F.struct(arrival.alias("arrival"), *values)).alias("newest")


def fold_changes(feed: DataFrame) -> DataFrame:
    """State after a feed of INIT, SNAPSHOT, START and DELETE events.

    ``feed`` has ``seq`` (unique per job), ``kind`` and the state columns. INIT and
    SNAPSHOT rows are full. START and DELETE rows act only if their secret equals that
    of the full row before them; a START brings workflow name, start and update time.

    Only events after a job's last full row can matter, and among them only those
    with that row's own secret. So per (job, secret) the last full row, the last DELETE
    and the last START say all: two aggregates that reduce inside each task before the
    shuffle, and no window over whole histories.
    """
    kind, seq = F.col("kind"), F.col("seq")
    full_seq = F.when(kind.isin("INIT", "SNAPSHOT"), seq)
    start_seq = F.when(kind == "START", seq)
    row = [c for c in STATE_VALUES if c != "secret"]
    by_secret = (
        feed.groupBy("job_id", "secret")
        .agg(
            F.max(full_seq).alias("full_seq"),
            F.max_by(F.struct(*row), full_seq).alias("full"),
            F.max(F.when(kind == "DELETE", seq)).alias("delete_seq"),
            F.max(start_seq).alias("start_seq"),
            F.max_by(F.struct("workflow_name", "started", "updated"), start_seq).alias("start"),
        )
        .where("full_seq is not null")
    )
    parts = ["secret", "full_seq", "full", "delete_seq", "start_seq", "start"]
    current = (
        by_secret.groupBy("job_id")
        .agg(F.max_by(F.struct(*parts), F.col("full_seq")).alias("current"))
        .select("job_id", "current.*")
        .where("delete_seq is null or delete_seq < full_seq")
        .withColumn("started_again", F.coalesce(F.expr("start_seq > full_seq"), F.lit(False)))
    )

    def value(name: str) -> Column:
        kept = F.col(f"full.{name}")
        if name == "status":
            kept = F.when(F.col("started_again"), F.lit("Pending")).otherwise(kept)
        elif name in ("workflow_name", "started", "updated"):
            kept = F.when(F.col("started_again"), F.col(f"start.{name}")).otherwise(kept)
        return kept.alias(name)

    return current.select(*[
        F.col(c) if c in ("job_id", "secret") else value(c) for c in STATE_COLUMNS])


def live_state(listed: DataFrame, inits: DataFrame | None = None, starts: DataFrame | None = None,
               deletes: DataFrame | None = None) -> DataFrame:
    """The one state of all that is known, see :func:`change_feed` and :func:`fold_changes`."""
    return fold_changes(change_feed(listed, inits, starts, deletes))


def change_feed(listed: DataFrame, inits: DataFrame | None = None, starts: DataFrame | None = None,
                deletes: DataFrame | None = None) -> DataFrame:
    """Listed rows, registrations, starts and deletes as one feed; tables or streams.

    Each table has a ``seq``, in one order of arrival over all of them. ``listed`` has the
    state columns (a base, or what a stream has stored), ``inits`` ``(job_id, secret, name)``,
    ``starts`` ``(job_id, secret, workflow_name, started, updated)`` and ``deletes``
    ``(job_id, secret)``.
    """
    kinds = [(listed, "SNAPSHOT")]
    if inits is not None:
        kinds.append((register_jobs(inits, "seq"), "INIT"))
    kinds += [(rows, kind) for rows, kind in ((starts, "START"), (deletes, "DELETE")) if rows is not None]
    feed = None
    for rows, kind in kinds:
        event = rows.select("seq", F.lit(kind).alias("kind"), *[
            F.col(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name)
            for f in STATE_SCHEMA])
        feed = event if feed is None else feed.unionByName(event)
    return feed


def register_jobs(inits: DataFrame, *kept: str) -> DataFrame:
    """State rows of new jobs from ``(job_id, secret, name)``: nothing known but these."""
    given = {
        "job_id": F.col("job_id"),
        "secret": F.col("secret"),
        "name": clean_name(F.col("name")),
        "archived": F.lit(False),
    }
    return inits.select(*kept, *[
        given.get(f.name, F.lit(None).cast(f.dataType)).alias(f.name) for f in STATE_SCHEMA])


def upsert_state(state: DataFrame, changes: DataFrame) -> DataFrame:
    """Replace whole rows by key. ``changes`` holds at most one row per job."""
    untouched = state.join(changes.select("job_id"), "job_id", "left_anti")
    return untouched.select(*STATE_COLUMNS).unionByName(changes.select(*STATE_COLUMNS))


def apply_tombstones(state: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Hide jobs deleted since they were last listed.

    ``state`` carries ``snapshot_ts``; ``tombstones`` is ``(job_id, secret, deleted_at)``.
    A job that a later snapshot still lists comes back.
    """
    last = tombstones.groupBy("job_id", "secret").agg(F.max("deleted_at").alias("deleted_at"))
    return (
        state.join(last, ["job_id", "secret"], "left")
        .where("deleted_at is null or snapshot_ts > deleted_at")
        .drop("deleted_at")
    )
