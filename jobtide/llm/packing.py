"""Vector best-fit packing of documents into training sequences.

A sequence has three capacities: tokens, documents, and attention cost (the sum of squared
lengths). Pieces are packed longest first, each into the open sequence that fits it best
under all three: the least weighted norm of what is left (``norm``) or the largest weighted
dot product of demand and room (``dot``); a new sequence is opened where none has room.

Pieces of one length are alike, so the whole choice is made on the histogram of lengths, of
at most ``tokens`` rows however large the table is. Sequences with the same room are alike
too: the plan moves them in groups, and lists for each length which stretch of its pieces
goes to which stretch of sequences, and at which offset. Pieces are numbered within their
length by task counters and a running sum over tasks, so no group of equal pieces is ever
brought together, and each piece then reads its place from the plan.

Defined results: a null text is empty: only the end id. Documents longer than a sequence are
cut into full pieces and a rest; only these are cut. Ties between equal pieces are settled
by their numbers. Repeated rows are packed each. An empty table gives an empty table.
"""

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jobtide.llm import scratch, texts
from jobtide.llm.token_ids import tokenizer_for

PIECE = "piece int, start long, length long, ids_crc32 long"
RESULTS = ["piece", "start", "length", "ids_crc32", "input_ids", "sequence_id", "offset"]


@dataclass(frozen=True)
class Capacity:
    """What a sequence holds; ``None`` for no limit but that of the tokens."""

    tokens: int = 2048
    documents: int | None = None
    attention: int | None = None
    weights: tuple[float, float, float] = (1.0, 1.0, 1.0)
    rule: str = "norm"

    def limits(self) -> np.ndarray:
        # a piece has at least one token, and lengths that sum to n have squares of at most n * n
        return np.array([self.tokens, self.documents or self.tokens,
                         self.attention or self.tokens ** 2], np.int64)


@dataclass
class Plan:
    """Stretches of pieces, sorted by length and then by number."""

    length: np.ndarray
    number: np.ndarray
    count: np.ndarray
    sequence: np.ndarray
    copies: np.ndarray
    offset: np.ndarray
    sequences: int

    def places(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of pieces given by length and number within it."""
        mark = np.searchsorted(self.length, length, side="left")
        last = np.searchsorted(self.length, length, side="right")
        # all stretches of a length are searched at once, by halving
        low, high = mark, last
        while (high - low > 1).any():
            middle = (low + high) // 2
            right = (high - low > 1) & (self.number[np.minimum(middle, len(self.number) - 1)] <= number)
            low, high = np.where(right, middle, low), np.where(right, high, np.maximum(middle, low + 1))
        at = number - self.number[low]
        return (self.sequence[low] + at // self.copies[low],
                self.offset[low] + at % self.copies[low] * length)


def make_plan(lengths: dict[int, int], capacity: Capacity) -> Plan:
    """Where the pieces of each length go; ``lengths`` says how many there are of each."""
    limits = capacity.limits()
    weights = np.array(capacity.weights) / limits.astype(float) ** 2
    room = np.zeros((0, 3), np.int64)
    first, amount = np.zeros(0, np.int64), np.zeros(0, np.int64)
    shortest = min(lengths, default=0)
    rows, opened = [], 0
    for length in sorted(lengths, reverse=True):
        left, number = lengths[length], 0
        demand = np.array([length, 1, length * length], np.int64)
        if (demand > limits).any():
            raise ValueError(f"a piece of {length} tokens fits no empty sequence")
        while left:
            fits = np.flatnonzero((room >= demand).all(axis=1))
            if len(fits):
                if capacity.rule == "norm":
                    best = fits[np.argmin((((room[fits] - demand) ** 2) * weights).sum(axis=1))]
                    copies = int((room[best] // demand).min())
                else:
                    best = fits[np.argmax((room[fits] * demand * weights).sum(axis=1))]
                    copies = 1
                space, begin, size = room[best], int(first[best]), int(amount[best])
            else:
                best, space, begin = -1, limits, opened
                copies = int((limits // demand).min())
                size = -(-left // copies)
                opened += size
            full = min(size, left // copies)
            rest = left - full * copies if full < size else 0
            changed = [(begin, full, copies), (begin + full, 1, rest)] if rest else [(begin, full, copies)]
            used = full + (1 if rest else 0)
            keep_room, keep_first, keep_amount = [], [], []
            for start, count, each in changed:
                if count == 0:
                    continue
                rows.append((length, number, count * each, start, each, int(limits[0] - space[0])))
                number += count * each
                left -= count * each
                after = space - each * demand
                if after[0] >= shortest and after[1] > 0 and after[2] >= shortest ** 2:
                    keep_room.append(after)
                    keep_first.append(start)
                    keep_amount.append(count)
            if used < size:
                keep_room.append(space)
                keep_first.append(begin + used)
                keep_amount.append(size - used)
            if best >= 0:
                room, first, amount = (np.delete(x, best, axis=0) for x in (room, first, amount))
            if keep_room:
                room = np.concatenate([room, np.array(keep_room, np.int64)])
                first = np.concatenate([first, np.array(keep_first, np.int64)])
                amount = np.concatenate([amount, np.array(keep_amount, np.int64)])
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 6).T
    return Plan(*table, sequences=opened)


def _cut(batches: Iterator[pa.RecordBatch], text: str, vocabulary: str, tokens: int, end_id: int,
         with_ids: bool):
    """Pieces of documents, numbered within their length by this task."""
    tokenizer = tokenizer_for(vocabulary)
    met = np.zeros(tokens + 1, np.int64)
    block = TaskContext.get().partitionId()
    for batch in batches:
        kept = [n for n in batch.schema.names if n != text]
        for part in texts.pieces(batch, text):
            ids, counts = tokenizer.ids(part.column(text))
            ends = np.cumsum(counts)
            whole = np.insert(ids, ends, end_id)  # the end id after each text
            counts = counts + 1
            firsts = np.cumsum(counts) - counts
            parts = -(-counts // tokens)
            row = np.repeat(np.arange(len(counts)), parts)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
            start = piece * tokens
            length = np.minimum(tokens, counts[row] - start)
            begin = firsts[row] + start
            raw = whole.astype("<u4").view(np.uint8).data
            crc = np.array([zlib.crc32(raw[4 * a:4 * b]) for a, b in
                            zip(begin.tolist(), (begin + length).tolist(), strict=True)], np.int64)
            order = np.argsort(length, kind="stable")
            ordered = length[order]
            fresh = np.flatnonzero(np.diff(ordered, prepend=-1))
            inside = np.arange(len(ordered)) - np.repeat(fresh, np.diff(np.append(fresh, len(ordered))))
            number = np.empty(len(length), np.int64)
            number[order] = met[ordered] + inside
            met += np.bincount(length, minlength=tokens + 1)
            columns = [part.column(n).take(pa.array(row)) for n in kept]
            columns += [pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc)]
            names = [*kept, "piece", "start", "length", "ids_crc32"]
            if with_ids:
                marks = np.append(begin, len(whole)).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(marks, pa.array(whole.astype(np.int32))))
                names.append("input_ids")
            columns += [pa.array(np.full(len(row), block, np.int64)), pa.array(number)]
            yield pa.RecordBatch.from_arrays(columns, [*names, "_p_block", "_p_number"])


def cut_documents(
    docs: DataFrame, vocabulary: str, text: str = "text", tokens: int = 2048, end_id: int = 0,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece of at most ``tokens`` ids, stored once in the shared folder."""
    own = docs.drop(*RESULTS)
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema if f.name != text]
    ids = ["input_ids array<int>"] if with_ids else []
    cut = own.mapInArrow(
        lambda batches: _cut(batches, text, vocabulary, tokens, end_id, with_ids),
        ", ".join([*kept, PIECE, *ids, "_p_block long", "_p_number long"]))
    return scratch.stored(cut, "pieces")


def pack_pieces(pieces: DataFrame, capacity: Capacity) -> DataFrame:
    """``pieces`` of ``cut_documents`` with ``sequence_id`` and ``offset``."""
    spark = pieces.sparkSession
    counted = pieces.groupBy("_p_block", "length").count()
    before = Window.partitionBy("length").orderBy("_p_block").rowsBetween(Window.unboundedPreceding, -1)
    bases = scratch.stored(counted.withColumn(
        "_p_base", F.coalesce(F.sum("count").over(before), F.lit(0))), "blocks")
    # at most capacity.tokens rows
    lengths = {r.length: r.n for r in bases.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    plan = spark.sparkContext.broadcast(make_plan(lengths, capacity))

    def place(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            number = (batch.column("_p_number").to_numpy() + batch.column("_p_base").to_numpy())
            sequence, offset = plan.value.places(batch.column("length").to_numpy(), number)
            names = [n for n in batch.schema.names if not n.startswith("_p_")]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(n) for n in names], pa.array(sequence), pa.array(offset)],
                [*names, "sequence_id", "offset"])

    numbered = pieces.join(bases.drop("count"), ["_p_block", "length"])
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema
            if not f.name.startswith("_p_")]
    ordered = numbered.select(*[F.col(f"`{c}`") for c in pieces.columns], "_p_base")
    return ordered.mapInArrow(place, ", ".join([*kept, "sequence_id long", "offset long"]))


def pack_documents(
    docs: DataFrame, vocabulary: str, text: str = "text", capacity: Capacity | None = None,
    with_ids: bool = False,
) -> DataFrame:
    """Pieces of ``docs`` with their sequences; the text itself is left out.

    With ``with_ids`` each piece also carries its ids. Result columns replace columns of the
    same names.
    """
    capacity = capacity or Capacity()
    return pack_pieces(cut_documents(docs, vocabulary, text, capacity.tokens, with_ids=with_ids),
                       capacity)
