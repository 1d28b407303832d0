"""Texts of Arrow batches as byte arrays, in pieces of bounded size."""

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

PIECE_BYTES = 1 << 20

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def pieces(batch: pa.RecordBatch, column: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of at most ``limit`` bytes in ``column``; a longer row is alone."""
    ends = text_ends(batch.column(column))
    begin, base = 0, 0
    while begin < batch.num_rows:
        end = max(begin + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(begin, end - begin)
        begin, base = end, int(ends[end - 1])


def text_ends(column: pa.Array) -> np.ndarray:
    return text_bytes(column)[2]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes of the column end to end, and where each row starts and ends; null is empty."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)
    marks = np.frombuffer(offsets, kind, len(column) + 1, column.offset * kind().itemsize)
    marks = marks.astype(np.int64)
    low, high = int(marks[0]), int(marks[-1])
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[low:high], marks[:-1] - low, marks[1:] - low


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    v = values.astype(np.uint64, copy=True)
    v ^= v >> np.uint64(32)
    v *= np.uint64(0xD6E8FEB86659FD93)
    v ^= v >> np.uint64(32)
    v *= np.uint64(0xD6E8FEB86659FD93)
    v ^= v >> np.uint64(32)
    return v


def powers(count: int, base: int = int(_MULTIPLIER)) -> np.ndarray:
    """1, m, m * m, ... as 64-bit values that wrap around."""
    out = np.ones(count, np.uint64)
    done = 1
    step = np.array([base], np.uint64)  # an array, as scalars warn when they wrap around
    while done < count:
        take = min(done, count - done)
        out[done:done + take] = out[:take] * step
        done += take
        step = step * step
    return out


@cache
def _ladders() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse, for pieces of the usual size."""
    inverse = pow(int(_MULTIPLIER), -1, 1 << 64)
    return powers(PIECE_BYTES), powers(PIECE_BYTES, inverse)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span; spans are in order, not empty and do not overlap.

    The sum of (value + 1) times a power by the place in the span, scrambled.
    """
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    if len(data) <= PIECE_BYTES:
        up, down = _ladders()
        values = data.astype(np.uint64)
        values += np.uint64(1)
        values *= up[:len(data)]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
        totals = (sums[ends] - sums[starts]) * down[starts]
    else:  # one very long text: powers only up to the longest span
        total = int(lengths.sum())
        firsts = np.cumsum(lengths) - lengths
        place = np.arange(total, dtype=np.int64) - np.repeat(firsts, lengths)
        values = data[place + np.repeat(starts, lengths)].astype(np.uint64) + np.uint64(1)
        totals = np.add.reduceat(values * powers(int(lengths.max()))[place], firsts)
    return mixed(totals + lengths.astype(np.uint64) * _MULTIPLIER)
