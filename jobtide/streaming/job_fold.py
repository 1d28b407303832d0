"""The change feed folded job by job in a stream, giving out only what changed.

A stateful processor keyed by job keeps the job's last full row and, by secret, the last START
and DELETE that came after it in order. Events may arrive in any order, within a batch and over
batches: the view after a batch is that of ``fold_changes`` over all events so far.

What was given out last follows from the state as it was, so a batch yields a job only if its
view differs from that, without reading anything that was written.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from jobtide.schemas import STATE_SCHEMA, STATE_VALUES

FULL = ("INIT", "SNAPSHOT")
STARTED = [c for c in STATE_VALUES if c in ("workflow_name", "started", "updated")]
# Secrets of a job held in memory before they go to the state store.
_HELD_SECRETS = 10_000
# Rows, and bytes of them, that a task holds to compare them with later ones, and rows it sends at once.
_HELD_ROWS = 100_000
_HELD_BYTES = 64 << 20
_SENT_ROWS = 10_000


def _plain(field: T.StructField) -> T.StructField:
    """Instants travel as whole microseconds, so that no time zone of a worker touches them."""
    kind = T.LongType() if isinstance(field.dataType, T.TimestampType) else field.dataType
    return T.StructField(field.name, kind)


def _renamed(fields: list[T.StructField], prefix: str) -> list[T.StructField]:
    return [T.StructField(prefix + f.name, f.dataType) for f in fields]


def _rank(order: tuple) -> tuple:
    """For comparing: a null comes before any value."""
    return tuple((v is not None, v) for v in order)


class JobFold(StatefulProcessor):
    """One job's events to its changed view."""

    def __init__(self, order_fields: list[T.StructField]):
        self.order = [f.name for f in order_fields]
        values = [_plain(f) for f in STATE_SCHEMA if f.name in STATE_VALUES]
        order = [_plain(f) for f in order_fields]
        self.full_schema = T.StructType([
            T.StructField("known", T.BooleanType()), T.StructField("acts", T.LongType()),
            *_renamed(order, "order_"), *values])
        self.acts_schema = T.StructType([
            T.StructField("start_known", T.BooleanType()), *_renamed(order, "start_"),
            *[f for f in values if f.name in STARTED],
            T.StructField("delete_known", T.BooleanType()), *_renamed(order, "delete_")])

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.full = handle.getValueState("full", self.full_schema)
        self.acts = handle.getMapState("acts", "secret string", self.acts_schema)

    def close(self) -> None:
        pass

    # Parts of the stored tuples

    def _load(self):
        """(order, values) of the last full row or None, and how many secrets have acts."""
        stored = self.full.get()
        if stored is None:
            return None, 0
        cut = 2 + len(self.order)
        row = (tuple(stored[2:cut]), tuple(stored[cut:])) if stored[0] else None
        return row, stored[1]

    def _save(self, row, acts: int) -> None:
        order, values = row or ((None,) * len(self.order), (None,) * len(STATE_VALUES))
        self.full.update((row is not None, acts, *order, *values))

    def _unpacked(self, stored):
        """(START as (order, values) or None, order of the DELETE or None)."""
        n = len(self.order)
        start = (tuple(stored[1:1 + n]), tuple(stored[1 + n:4 + n])) if stored[0] else None
        return start, tuple(stored[5 + n:]) if stored[4 + n] else None

    def _packed(self, start, delete) -> tuple:
        none = (None,) * len(self.order)
        begun, brought = start or (none, (None,) * len(STARTED))
        return (start is not None, *begun, *brought, delete is not None, *(delete or none))

    @staticmethod
    def _key(secret: str | None) -> tuple:
        return ("" if secret is None else "=" + secret,)

    # The fold

    def _view(self, row, acts: int):
        """What the job shows: None if nothing is known, else (order, values or None if deleted)."""
        if row is None:
            return None
        order, values = row
        stored = self.acts.getValue(self._key(values[STATE_VALUES.index("secret")])) if acts else None
        start, delete = self._unpacked(stored) if stored else (None, None)
        if delete is not None and _rank(delete) > _rank(order):
            return delete, None
        if start is None or not _rank(start[0]) > _rank(order):
            return row
        shown = dict(zip(STATE_VALUES, values, strict=True), status="Pending",
                     **dict(zip(STARTED, start[1], strict=True)))
        return start[0], tuple(shown[c] for c in STATE_VALUES)

    def _add_acts(self, met: dict, row, acts: int) -> int:
        """Store the acts that come after the full row; how many secrets have any."""
        after = _rank(row[0]) if row else ()
        for secret, (start, delete) in met.items():
            start = start if start and _rank(start[0]) > after else None
            delete = delete if delete and _rank(delete) > after else None
            if start is None and delete is None:
                continue
            key = self._key(secret)
            stored = self.acts.getValue(key) if acts else None
            if stored is None:
                acts += 1
            else:
                known_start, known_delete = self._unpacked(stored)
                start = max((s for s in (start, known_start) if s), key=lambda s: _rank(s[0]), default=None)
                delete = max((d for d in (delete, known_delete) if d), key=_rank, default=None)
            self.acts.updateValue(key, self._packed(start, delete))
        met.clear()
        return acts

    def _prune(self, row) -> int:
        """Forget acts from before the full row; how many secrets have others."""
        after, left = _rank(row[0]), 0
        for key, stored in list(self.acts.iterator()):
            start, delete = self._unpacked(stored)
            newer = (start and _rank(start[0]) > after) or (delete and _rank(delete) > after)
            left += bool(newer)
            if not newer:
                self.acts.removeKey(key)
        return left

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        row, acts = self._load()
        shown = self._view(row, acts)
        newest, met = row, {}
        for event in rows:
            order = tuple(event["order_" + c] for c in self.order)
            if event["kind"] in FULL:
                if newest is None or _rank(order) > _rank(newest[0]):
                    newest = order, tuple(event[c] for c in STATE_VALUES)
                continue
            start, delete = met.get(event["secret"], (None, None))
            if event["kind"] == "DELETE":
                delete = max((d for d in (delete, order) if d is not None), key=_rank)
            elif start is None or _rank(order) > _rank(start[0]):
                start = order, tuple(event[c] for c in STARTED)
            met[event["secret"]] = start, delete
            if len(met) >= _HELD_SECRETS:
                acts = self._add_acts(met, newest, acts)
        if newest is not row and acts:
            acts = self._prune(newest)
        acts = self._add_acts(met, newest, acts)
        self._save(newest, acts)
        view = self._view(newest, acts)
        if view is not None and (shown is None or view[1] != shown[1]):
            order, values = view
            yield Row(job_id=key[0], **dict(zip(STATE_VALUES, values or [None] * len(STATE_VALUES), strict=True)),
                      **{"order_" + c: v for c, v in zip(self.order, order, strict=True)},
                      deleted=values is None)

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:
        order = tuple(initialState["order_" + c] for c in self.order)
        self._save((order, tuple(initialState[c] for c in STATE_VALUES)), 0)


def _in_micros(rows: DataFrame, order: list[str], *kept: str) -> DataFrame:
    def plain(name: str, to: str):
        column = F.col(name)
        if isinstance(rows.schema[name].dataType, T.TimestampType):
            column = F.unix_micros(column)
        return column.alias(to)

    return rows.select(*kept, "job_id", *[plain(c, c) for c in STATE_VALUES],
                       *[plain(c, "order_" + c) for c in order])


def _last_ones(table: pa.Table) -> pa.Table:
    """Of these rows the ones a fold can need: per job the last full row, and per secret the
    last START and DELETE."""
    places = [n for n in table.column_names if n.startswith("order_")]
    keys = table.select(["job_id", "kind", "secret", *places]).to_pandas()
    full = keys["kind"].isin(FULL)
    keys["kind"] = keys["kind"].where(~full, "FULL")
    keys["secret"] = keys["secret"].where(~full, None)
    ordered = keys.sort_values(places, na_position="first", kind="stable")
    last = ordered[~ordered.duplicated(["job_id", "kind", "secret"], keep="last")]
    return table.take(pa.array(np.sort(last.index.to_numpy())))


def _combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of a task without those that others of them make void.

    Rows left over are held and met by later ones, until they are too many to hold: then they
    go on as they are.
    """
    held, rows, size = [], 0, 0
    for batch in batches:
        held.append(batch)
        rows, size = rows + batch.num_rows, size + batch.nbytes
        if rows >= _HELD_ROWS or size >= _HELD_BYTES:
            few = _last_ones(pa.Table.from_batches(held))
            if 2 * few.num_rows >= _HELD_ROWS or 2 * few.nbytes >= _HELD_BYTES:
                yield from few.to_batches(max_chunksize=_SENT_ROWS)
                held, rows, size = [], 0, 0
            else:
                held, rows, size = few.to_batches(), few.num_rows, few.nbytes
    if held:
        yield from _last_ones(pa.Table.from_batches(held)).to_batches(max_chunksize=_SENT_ROWS)


def fold_stream(events: DataFrame, order: list[str], initial: DataFrame | None = None) -> DataFrame:
    """Changed views of jobs, in update mode: state columns, ``order`` columns and ``deleted``.

    ``events`` has ``kind`` (INIT, SNAPSHOT, START or DELETE), the state columns and the columns
    of ``order``, by which all events of a job are arranged. ``initial`` has state and order
    columns and is the state that a new checkpoint begins with; a job has one row in it.
    """
    fields = [events.schema[c] for c in order]
    plain = _in_micros(events, order, "kind")
    # A task has few rows of each job before they are brought together, and the processor takes
    # each row by itself: so it gets what is left when all rows of a job have met.
    met = plain.mapInArrow(_combined, plain.schema).repartition("job_id")
    few = met.mapInArrow(_combined, plain.schema)
    output = T.StructType([
        *[_plain(f) for f in STATE_SCHEMA], *_renamed([_plain(f) for f in fields], "order_"),
        T.StructField("deleted", T.BooleanType())])
    given = None if initial is None else _in_micros(initial, order).groupBy("job_id")
    folded = few.groupBy("job_id").transformWithState(
        JobFold(fields), output, outputMode="Update", timeMode="None", initialState=given)

    def back(field: T.StructField, name: str):
        timed = isinstance(field.dataType, T.TimestampType)
        return (F.timestamp_micros(name) if timed else F.col(name)).alias(field.name)

    return folded.select(*[back(f, f.name) for f in STATE_SCHEMA],
                         *[back(f, "order_" + f.name) for f in fields], "deleted")


