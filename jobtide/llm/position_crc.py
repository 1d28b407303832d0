"""CRC-32 of very many byte spans at once, by position tables.

The register of a CRC is linear over exclusive or: started from zero, it is the sum of what
each byte leaves behind, which depends on the byte and its distance from the end only. These
contributions are a table; a span's are looked up together and joined by one
``bitwise_xor.reduceat``. What the usual start value leaves is a constant of the length.

The table reaches ``BLOCK`` bytes back. A longer span is cut into blocks from its end, and
the blocks' values are folded two by two: the earlier one is moved on by the length of the
later one, in a logarithmic number of rounds.
"""

from functools import cache

import numpy as np

BLOCK = 64
# Blocks looked up at a time, so that memory is bounded however long texts and words are.
_SLICE = 1 << 14
# Fixed value: the reversed polynomial of CRC-32.
_POLYNOMIAL = 0xEDB88320
_ONES = np.uint32(0xFFFFFFFF)


@cache
def byte_table() -> np.ndarray:
    """The register after one byte, from zero."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(_POLYNOMIAL), table >> 1)
    return table


@cache
def position_table() -> np.ndarray:
    """By distance from the end times 256 plus the byte: what is left of it at the end."""
    rows = [byte_table()]
    for _ in range(BLOCK - 1):
        rows.append((rows[-1] >> 8) ^ byte_table()[rows[-1] & 255])
    return np.concatenate(rows)


@cache
def _mover(power: int) -> np.ndarray:
    """The register moved on by 2 ** ``power`` zero bytes, as a table for each of its bytes."""
    if power == 0:
        places = np.arange(256, dtype=np.uint32)
        values = np.stack([places << np.uint32(8 * i) for i in range(4)])
        return (values >> 8) ^ byte_table()[values & 255]
    half = _mover(power - 1)
    return _apply(half, half)


def _apply(table: np.ndarray, registers: np.ndarray) -> np.ndarray:
    out = table[0][registers & 255]
    for i in range(1, 4):
        out = out ^ table[i][(registers >> np.uint32(8 * i)) & 255]
    return out


def moved(registers: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each register moved on by as many zero bytes as its length says."""
    out = registers.astype(np.uint32, copy=True)
    left, power = lengths.astype(np.int64, copy=True), 0
    while left.any():
        odd = np.flatnonzero(left & 1)
        out[odd] = _apply(_mover(power), out[odd])
        left >>= 1
        power += 1
    return out


@cache
def _length_constants() -> np.ndarray:
    """The CRC of so many zero bytes, for lengths up to a block."""
    lengths = np.arange(BLOCK + 1)
    return moved(np.full(BLOCK + 1, _ONES), lengths) ^ _ONES


def _registers(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """From zero, the registers after spans of 1 to ``BLOCK`` bytes."""
    table = position_table()
    out = np.empty(len(starts), np.uint32)
    for low in range(0, len(starts), _SLICE):
        begin, end = starts[low:low + _SLICE], ends[low:low + _SLICE]
        lengths = end - begin
        firsts = np.cumsum(lengths) - lengths
        # the place of each byte, and how far it is from its span's end
        place = np.arange(int(lengths.sum())) + np.repeat(begin - firsts, lengths)
        back = np.repeat(end - 1, lengths) - place
        left = table[(back << 8) + data[place]]
        out[low:low + _SLICE] = np.bitwise_xor.reduceat(left, firsts)
    return out


def span_crcs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The CRC-32 (unsigned, as in zlib) of each span of the bytes; spans may overlap or be empty."""
    lengths = ends - starts
    out = np.zeros(len(starts), np.uint32)  # that of no bytes
    short = np.flatnonzero((lengths > 0) & (lengths <= BLOCK))
    out[short] = _registers(data, starts[short], ends[short]) ^ _length_constants()[lengths[short]]
    long = np.flatnonzero(lengths > BLOCK)
    if len(long):
        out[long] = (_folded(data, starts[long], ends[long])
                     ^ moved(np.full(len(long), _ONES), lengths[long]) ^ _ONES)
    return out


def _folded(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    blocks = -(-(ends - starts) // BLOCK)
    span = np.repeat(np.arange(len(blocks)), blocks)
    number = np.arange(len(span)) - np.repeat(np.cumsum(blocks) - blocks, blocks)  # from the end
    end = ends[span] - number * BLOCK
    value = _registers(data, np.maximum(starts[span], end - BLOCK), end)
    power = BLOCK.bit_length() - 1
    while len(value) > len(blocks):
        # an odd block lies before the even one that comes right ahead of it in this order
        later = np.flatnonzero(number & 1)
        value[later - 1] ^= _apply(_mover(power), value[later])
        even = np.flatnonzero((number & 1) == 0)
        value, number = value[even], number[even] >> 1
        power += 1
    return value
