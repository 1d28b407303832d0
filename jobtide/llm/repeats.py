"""Repeated byte strings across documents, by hashes of strings grouped by minimizer.

This replaces the suffix arrays of dictionary and parse of prefix-free parsing; none is built.
Only equality of strings is asked for, not their order, and groups by trigger need no order
over the whole corpus.

Rolling hashes choose trigger strings: of every ``WINDOW`` consecutive ones the smallest
(the first of equal ones). A trigger belongs to all the strings of ``LENGTH`` bytes whose
smallest it is; they begin in one stretch of places, and the phrase is the text they cover.
Equal strings have equal triggers at equal distances, so a string can only be repeated where
its trigger is, whatever documents lie between.

The parse is the list of the overlapping phrases by (trigger, phrase, place), all as hashes. In that order, all strings of
a phrase seen before are repeated at once, and a phrase alone at its trigger repeats
nothing: the dictionary's order settles the rest. Only triggers with several phrases need
their texts: there, the strings of the distinct phrases are put in order among themselves
(as hashes of their bytes, since all have one length and only equality matters) and the
first place of each is found. A text that occurs a thousand times costs its phrases once.

Groups are streamed in sorted order with a state of one row. Phrases of one trigger are
compared in bounded parts; what is first in its part of a larger group goes on to one more
exact round, by single strings. So nothing unbounded is held by one task.

A place is (document id, start); a null id comes first. What is found goes back to its rows
by id and a hash of the text, so rows that share an id (or have none) keep their marks apart.
Defined results: a null text is empty; texts under ``LENGTH`` bytes keep all. Of rows with
equal ids, equal starts are one place, and none of them is earlier than another; rows equal
in both get equal results. An empty table gives an empty table. Result columns replace
columns of the same names.
"""

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobtide.llm import scratch, texts

LENGTH = 100
TRIGGER = 32
WINDOW = LENGTH - TRIGGER + 1
PART = 4096  # phrases of one trigger that are compared at once
SEGMENT = texts.PIECE_BYTES - 2 * LENGTH

_PLACE = np.uint64((1 << 20) - 1)
_SIZE = np.uint64(0xC2B2AE3D27D4EB4F)
_NO_ID = -(1 << 63)
_CODEC = pa.Codec("zstd", compression_level=6)

SLOTS = 1 << 19  # phrases that a task remembers

PHRASE = "trigger long, phrase long, size int, doc long, start long, key long"
PHRASE_ORDER = ["trigger", "phrase", "size", "doc", "start", "key"]
RESULTS = ["n_bytes", "n_removed", "n_spans", "kept_sha256"]


def _sums(data: np.ndarray) -> np.ndarray:
    up, _ = texts._ladders()
    values = data.astype(np.uint64)
    values += np.uint64(1)
    values *= up[:len(values)]
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=sums[1:])
    return sums


def _hashes(sums: np.ndarray, begin: np.ndarray, end: np.ndarray, size: np.ndarray) -> np.ndarray:
    _, down = texts._ladders()
    return texts.mixed((sums[end] - sums[begin]) * down[begin] + size.astype(np.uint64) * _SIZE)


def phrases(data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """Per phrase: row, trigger hash, phrase hash, first string's start in the row, strings.

    At most ``texts.PIECE_BYTES`` bytes at once.
    """
    empty = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return empty, empty.astype(np.uint64), empty.astype(np.uint64), empty, empty
    sums = _sums(data)
    n = len(data) - TRIGGER + 1
    every = np.arange(n)
    hashes = _hashes(sums, every, every + TRIGGER, np.zeros(1))
    least = (hashes & ~_PLACE) | every.astype(np.uint64)
    width = 1
    while 2 * width <= WINDOW:
        least = np.minimum(least[:len(least) - width], least[width:])
        width *= 2
    least = np.minimum(least[:len(least) - (WINDOW - width)], least[WINDOW - width:])
    at = (least & _PLACE).astype(np.int64)
    row = np.full(len(at), -1, np.int64)  # of the string that begins here, if it is whole
    for i in np.flatnonzero(ends - starts >= LENGTH).tolist():
        row[starts[i]:ends[i] - LENGTH + 1] = i
    first = np.flatnonzero((row >= 0) & ((np.diff(at, prepend=-1) != 0) | (np.diff(row, prepend=-2) != 0)))
    stop = np.minimum(np.append(first[1:], len(at)), ends[row[first]] - LENGTH + 1)
    size = stop - first
    whole = _hashes(sums, first, stop - 1 + LENGTH, size)
    return row[first], hashes[at[first]], whole, first - starts[row[first]], size


def _segments(data: np.ndarray, start: int, end: int) -> Iterator[tuple[int, np.ndarray]]:
    """A long text in parts that share ``LENGTH - 1`` bytes: every string is in one part."""
    for low in range(start, max(start + 1, end - LENGTH + 1), SEGMENT):
        yield low - start, data[low:min(end, low + SEGMENT + LENGTH - 1)]


def text_key(raw: bytes) -> int:
    """Tells the texts of one id apart."""
    return int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little", signed=True)


class _Seen:
    """Finds phrases that have an earlier place in the same task, and gives them a negative size.

    They are repeats wherever the first one is, so they need not meet the others of their
    trigger: their trigger becomes a hash of their place, which deals them out evenly. In a
    batch all are found; from batch to batch a table of fixed size remembers phrases, the
    newest in each slot. What it forgets is only sent once more. A text of a hundred
    thousand copies, or a passage of every document, thus sends few rows a task.
    """

    def __init__(self):
        self.table = np.zeros((SLOTS, 5), np.int64)  # trigger, phrase, size, doc, start

    def __call__(self, trigger, phrase, size, doc, start, key):
        if not len(trigger):
            return trigger, phrase, size, doc, start, key
        order = np.lexsort((key, start, doc, size, phrase, trigger))
        trigger, phrase, size, doc, start, key = (x[order] for x in (trigger, phrase, size, doc, start, key))
        new = np.ones(len(trigger), bool)
        new[1:] = (trigger[1:] != trigger[:-1]) | (phrase[1:] != phrase[:-1]) | (size[1:] != size[:-1])
        heads = np.flatnonzero(new)
        first = np.cumsum(new) - 1
        first_doc, first_start = self._earliest(
            *(x[heads] for x in (trigger.view(np.int64), phrase.view(np.int64), size, doc, start)))
        again = (doc != first_doc[first]) | (start != first_start[first])
        place = texts.mixed(texts.mixed(texts.mixed(doc.astype(np.uint64)) + start.astype(np.uint64)) + key.view(np.uint64))
        return np.where(again, place, trigger), phrase, np.where(again, -size, size), doc, start, key

    def _earliest(self, *heads):
        """The earliest known place of each phrase; the table then holds it."""
        slot = (heads[0] ^ heads[1]) & (SLOTS - 1)
        old = self.table[slot]
        doc, start = heads[3], heads[4]
        known = (old[:, 0] == heads[0]) & (old[:, 1] == heads[1]) & (old[:, 2] == heads[2])
        earlier = known & ((old[:, 3] < doc) | ((old[:, 3] == doc) & (old[:, 4] < start)))
        doc, start = np.where(earlier, old[:, 3], doc), np.where(earlier, old[:, 4], start)
        self.table[slot] = np.stack([*heads[:3], doc, start], axis=1)
        return doc, start


def _parse(batches: Iterator[pa.RecordBatch], doc_id: str, text: str):
    seen = _Seen()

    def batch_of(ids, keys, found, shift=0):
        row, trigger, phrase, start, size = found
        trigger, phrase, size, doc, start, key = seen(trigger, phrase, size, ids[row], start + shift, keys[row])
        return pa.RecordBatch.from_arrays(
            [pa.array(trigger.view(np.int64)), pa.array(phrase.view(np.int64)), pa.array(size.astype(np.int32)),
             pa.array(doc), pa.array(start), pa.array(key)], PHRASE_ORDER)

    for batch in batches:
        for piece in texts.pieces(batch, text):
            data, starts, ends = texts.text_bytes(piece.column(text))
            ids = piece.column(doc_id).fill_null(_NO_ID).to_numpy()
            keys = np.array([text_key(data[a:b].tobytes()) for a, b in zip(starts, ends, strict=True)], np.int64)
            if len(data) <= texts.PIECE_BYTES:
                yield batch_of(ids, keys, phrases(data, starts, ends))
                continue
            for shift, part in _segments(data, int(starts[0]), int(ends[0])):
                yield batch_of(ids, keys, phrases(part, np.array([0]), np.array([len(part)])), shift)


def _packed(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Start and number of strings in one number."""
    return (start << 8) | size


class _Firsts:
    """Goes through phrases sorted by trigger, phrase, size, place and key.

    Later places of a phrase are repeats. The first place of a trigger with several phrases
    is open; whether the very first has company is known once the next phrase comes. Other
    texts at the first place are open at once.
    """

    def __init__(self):
        self.last, self.place, self.waiting = None, (0, 0), None

    def __call__(self, trigger, phrase, size, doc, start, key):
        """(repeated, open) as places in the batch; -1 stands for the row that was waiting."""
        def changed(values, before):
            out = np.ones(len(values), bool)
            out[1:] = values[1:] != values[:-1]
            if before is not None:
                out[0] = values[0] != before
            return out

        before = self.last or [None] * 6
        new_trigger = changed(trigger, before[0])
        new_phrase = new_trigger | changed(phrase, before[1]) | changed(size, before[2])
        new_row = changed(doc, before[3]) | changed(start, before[4]) | changed(key, before[5])
        heads = np.flatnonzero(new_phrase)
        number = np.cumsum(new_phrase)
        first_doc, first_start = (np.append(np.array([held], np.int64), column[heads])[number]
                                  for held, column in zip(self.place, (doc, start), strict=True))
        at_first = (doc == first_doc) & (start == first_start)
        opened = heads[~new_trigger[heads]]
        with_next = heads[:-1][new_trigger[heads[:-1]] & ~new_trigger[heads[1:]]]
        open_rows = np.concatenate([with_next, opened, np.flatnonzero(~new_phrase & new_row & at_first)])
        waiting = self.waiting
        if len(heads):
            if waiting is not None and not new_trigger[heads[0]]:
                open_rows = np.append(open_rows, -1)
            last = int(heads[-1])
            self.waiting = last if new_trigger[last] else None
        self.last = [c[-1] for c in (trigger, phrase, size, doc, start, key)]
        self.place = int(first_doc[-1]), int(first_start[-1])
        return np.flatnonzero(~new_phrase & new_row & ~at_first), open_rows, bool(len(heads))


MARK = "doc long, key long, packed long"


def _marks(doc, key, packed, is_open) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(doc), pa.array(key), pa.array(packed), pa.array(is_open)], ["doc", "key", "packed", "open"])


def _settle(batches: Iterator[pa.RecordBatch]):
    """(doc, key, packed, open) of repeated and of open phrases."""
    firsts, held = _Firsts(), None
    for batch in batches:
        if not batch.num_rows:
            continue
        known = batch.filter(pc.less(batch.column("size"), 0))
        if known.num_rows:  # repeats of their own task
            _, _, size, doc, start, key = (known.column(i).to_numpy() for i in range(6))
            yield _marks(doc, key, _packed(start, -size.astype(np.int64)), np.zeros(len(doc), bool))
            batch = batch.filter(pc.greater(batch.column("size"), 0))
            if not batch.num_rows:
                continue
        trigger, phrase, size, doc, start, key = (batch.column(i).to_numpy() for i in range(6))
        size = size.astype(np.int64)
        again, opened, heads = firsts(trigger, phrase, size, doc, start, key)
        packed = _packed(start, size)
        rows = np.concatenate([again, opened[opened >= 0]]).astype(np.int64)
        found = [column[rows] for column in (doc, key, packed)]
        flags = np.arange(len(rows)) >= len(again)
        if (opened == -1).any():
            found = [np.append(column, one) for column, one in zip(found, held, strict=True)]
            flags = np.append(flags, True)
        if heads and firsts.waiting is not None:
            held = tuple(column[firsts.waiting] for column in (doc, key, packed))
        yield _marks(*found, flags)


def _pack_text(batches: Iterator[pa.RecordBatch], text: str):
    """Texts as compressed bytes: they go through two shuffles."""
    for batch in batches:
        raw = [(v.as_py() or "").encode() for v in batch.column(text)]
        names = [n for n in batch.schema.names if n != text]
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(n) for n in names],
             pa.array([_CODEC.compress(r, asbytes=True) for r in raw], pa.binary()),
             pa.array([len(r) for r in raw], pa.int64()), pa.array([text_key(r) for r in raw], pa.int64())],
            [*names, "_r_text", "_r_size", "_r_key"])


def _unpacked(value: pa.Scalar, size: int) -> np.ndarray:
    return np.frombuffer(_CODEC.decompress(value.as_py(), size, asbytes=True), np.uint8) if size else np.zeros(0, np.uint8)


def _places(data: np.ndarray, marks: pa.Scalar):
    """(start, strings) of a text's marks."""
    found = np.unique(marks.values.to_numpy())
    start, size = found >> 8, found & 0xFF
    inside = start + size - 1 + LENGTH <= len(data)
    return start[inside], size[inside]


def _open_texts(batches: Iterator[pa.RecordBatch]):
    """(trigger, doc, key, start, bytes) of the open phrases of each document.

    Equal rows give theirs once, as far as the task remembers them.
    """
    docs, keys, starts, found = [], [], [], []
    done: dict[tuple, None] = {}

    def flush():
        # a phrase's trigger is the smallest of its first string
        heads = np.frombuffer(b"".join(f[:LENGTH] for f in found), np.uint8)
        low = np.arange(len(found)) * LENGTH
        _, trigger, _, _, _ = phrases(heads, low, low + LENGTH)
        out = pa.RecordBatch.from_arrays(
            [pa.array(trigger.view(np.int64)), pa.array(docs, pa.int64()), pa.array(keys, pa.int64()),
             pa.array(starts, pa.int64()), pa.array(found, pa.binary())], ["trigger", "doc", "key", "start", "bytes"])
        for column in (docs, keys, starts, found):
            column.clear()
        return out

    for batch in batches:
        for i in range(batch.num_rows):
            doc, key = batch.column("_r_doc")[i].as_py(), batch.column("_r_key")[i].as_py()
            if (doc, key) in done:
                continue
            if len(done) >= PART:
                done.pop(next(iter(done)))
            done[doc, key] = None
            data = _unpacked(batch.column("_r_text")[i], batch.column("_r_size")[i].as_py())
            start, size = _places(data, batch.column("_r_marks")[i])
            raw = data.tobytes()
            for low, strings in zip(start.tolist(), size.tolist(), strict=True):
                docs.append(doc)
                keys.append(key)
                starts.append(low)
                found.append(raw[low:low + strings - 1 + LENGTH])
                if len(found) >= PART:
                    yield flush()
    if found:
        yield flush()


def _strings(found: list[bytes], docs: np.ndarray, starts: np.ndarray):
    """Two hashes of every string of the phrases, with its place and its phrase's number."""
    parts = []
    for first in range(0, len(found), PART):
        some = found[first:first + PART]
        lengths = np.array([len(p) for p in some])
        data = np.frombuffer(b"".join(some), np.uint8)
        low = np.cumsum(lengths) - lengths
        size = lengths - LENGTH + 1
        which = np.repeat(np.arange(len(size)), size)
        inside = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size)
        begin = low[which] + inside
        end = begin + LENGTH
        one = _hashes(_sums(data), begin, end, np.ones(1))
        other = _hashes(_sums(data[::-1] ^ 0x5A), len(data) - end, len(data) - begin, np.ones(1))
        which += first
        parts.append((one.view(np.int64), other.view(np.int64), docs[which], starts[which] + inside, which))
    return tuple(np.concatenate(columns) for columns in zip(*parts, strict=True))


def _compare_part(table: pa.Table, whole: bool) -> pa.RecordBatch:
    """Repeated strings among phrases; unless these are ``whole`` triggers, the first of each
    string is given too, with its hashes, as one before it may be in another part."""
    one, other, doc, start, which = _strings(
        table.column("bytes").to_pylist(), table.column("doc").to_numpy(), table.column("start").to_numpy())
    trigger, key = (table.column(name).to_numpy()[which] for name in ("trigger", "key"))
    order = np.lexsort((key, start, doc, other, one, trigger))
    one, other, doc, start, key, trigger = (x[order] for x in (one, other, doc, start, key, trigger))
    new = np.ones(len(one), bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in (trigger, one, other)], axis=0)
    head = np.flatnonzero(new)[np.cumsum(new) - 1]
    later = (doc != doc[head]) | (start != start[head])
    again = np.flatnonzero(later)
    first = np.flatnonzero(~later) if not whole else np.zeros(0, np.int64)
    rows = np.concatenate([again, first])
    return pa.RecordBatch.from_arrays(
        [pa.array(doc[rows]), pa.array(key[rows]), pa.array(_packed(start[rows], 1)), pa.array(one[rows]),
         pa.array(other[rows]), pa.array(start[rows]), pa.array(np.arange(len(rows)) >= len(again))],
        ["doc", "key", "packed", "one", "other", "start", "open"])


def _compare(batches: Iterator[pa.RecordBatch]):
    """Strings of phrases sorted by trigger, compared in parts of some ``PART`` phrases.

    A trigger with more phrases is cut into several parts.
    """
    held: list[pa.RecordBatch] = []
    cut = None

    def compared(table: pa.Table):
        keys = table.column("trigger").to_numpy()
        mine = int(np.searchsorted(keys, cut, side="right")) if cut is not None and len(keys) and keys[0] == cut else 0
        for part, whole in ((table.slice(0, mine), False), (table.slice(mine), True)):
            if part.num_rows:
                yield _compare_part(part, whole)

    for batch in batches:
        for low in range(0, batch.num_rows, PART):
            held.append(batch.slice(low, PART))
            if sum(b.num_rows for b in held) < 2 * PART:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            keys = table.column("trigger").to_numpy()
            edge = int(np.searchsorted(keys, keys[-1]))
            if edge == 0:
                cut, edge = int(keys[0]), len(keys)
            yield from compared(table.slice(0, edge))
            held = table.slice(edge).to_batches()
    if held:
        yield from compared(pa.Table.from_batches(held).combine_chunks())


def _later(batches: Iterator[pa.RecordBatch]):
    """Marks of single strings that are not the first of theirs; sorted by hashes and place."""
    firsts = _Firsts()
    for batch in batches:
        if batch.num_rows:
            one, other, doc, start, key = (
                batch.column(n).to_numpy() for n in ("one", "other", "doc", "start", "key"))
            again, _, _ = firsts(one, other, np.zeros(len(one), np.int64), doc, start, key)
            yield batch.select(["doc", "key", "packed"]).take(pa.array(again))


def _finish(batches: Iterator[pa.RecordBatch], doc_id: str, with_text: bool):
    for batch in batches:
        names = [n for n in batch.schema.names if not n.startswith("_r_")]
        removed, spans, digests, kept_texts = [], [], [], []
        for i in range(batch.num_rows):
            size = batch.column("_r_size")[i].as_py()
            data = _unpacked(batch.column("_r_text")[i], size)
            marks = batch.column("_r_marks")[i]
            edge = np.zeros(size + 1, np.int32)
            if marks.is_valid:
                start, strings = _places(data, marks)
                np.add.at(edge, start, 1)
                np.add.at(edge, start + strings - 1 + LENGTH, -1)
            gone = np.cumsum(edge)[:size] > 0
            kept = data[~gone].tobytes()
            removed.append(int(gone.sum()))
            spans.append(int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum()))
            digests.append(hashlib.sha256(kept).hexdigest())
            if with_text:
                kept_texts.append(kept)
        columns = [batch.column(n) for n in names] + [
            batch.column("_r_size"), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests)]
        names = [*names, *RESULTS]
        if with_text:
            columns.append(pa.array(kept_texts, pa.binary()))
            names.append("kept")
        yield pa.RecordBatch.from_arrays(columns, names)


def _sorted_map(rows: DataFrame, by: list[str], key: str, run: Callable, schema: str) -> DataFrame:
    return rows.repartition(key).sortWithinPartitions(*by).mapInArrow(run, schema)


def remove_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", with_text: bool = False) -> DataFrame:
    """``docs`` without its text, with ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256``.

    With ``with_text`` the remaining bytes come as ``kept``. ``doc_id`` is a whole number.
    """
    source = docs.drop(*RESULTS, "kept").withColumn(doc_id, F.col(doc_id).cast("long"))
    ids = source.select(doc_id, text)
    parse = ids.mapInArrow(lambda batches: _parse(batches, doc_id, text), PHRASE)
    settled = scratch.stored(_sorted_map(
        parse, PHRASE_ORDER, "trigger", _settle, f"{MARK}, open boolean"), "phrases")

    kept = [f for f in source.schema if f.name != text]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    packed = source.mapInArrow(lambda batches: _pack_text(batches, text), f"{schema}, _r_text binary, _r_size long, _r_key long")
    place = F.coalesce(F.col(f"`{doc_id}`"), F.lit(_NO_ID))

    def with_marks(marks: DataFrame, columns: list[str], how: str) -> DataFrame:
        # a set, as tasks may find the same
        lists = (marks.groupBy(F.col("doc").alias("_r_doc"), F.col("key").alias("_r_key"))
                 .agg(F.collect_set("packed").alias("_r_marks")).hint("shuffle_hash"))
        return packed.select(*[F.col(f"`{c}`") for c in columns], "_r_text", "_r_size", "_r_key",
                             place.alias("_r_doc")).join(lists, ["_r_doc", "_r_key"], how)

    opened = with_marks(settled.filter("open"), [], "inner").mapInArrow(
        _open_texts, "trigger long, doc long, key long, start long, bytes binary")
    compared = scratch.stored(_sorted_map(
        opened, ["trigger"], "trigger", _compare,
        f"{MARK}, one long, other long, start long, open boolean"), "strings")
    later = _sorted_map(compared.filter("open"), ["one", "other", "doc", "start", "key"], "one", _later, MARK)
    marks = (settled.filter("not open").select("doc", "key", "packed")
             .union(compared.filter("not open").select("doc", "key", "packed")).union(later))
    extra = "n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_text else "")
    return with_marks(marks, [f.name for f in kept], "left").mapInArrow(
        lambda batches: _finish(batches, doc_id, with_text), f"{schema}, {extra}")
