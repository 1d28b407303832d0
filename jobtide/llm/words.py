"""Words of Arrow text columns as byte spans: runs of letters, digits and non-ASCII bytes."""

import numpy as np
import pyarrow as pa

from jobtide.llm import texts

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.zeros(256, bool)
_IS_WORD[48:58] = _IS_WORD[97:123] = _IS_WORD[128:] = True


def word_spans(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes with A-Z lower-cased, where each word begins and ends, and how many each row has."""
    data, starts, _ = texts.text_bytes(column)
    lowered = _LOWER[data]
    inside = _IS_WORD[lowered]
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    before[starts[starts < len(data)]] = False
    begins = np.flatnonzero(inside & ~before)
    # a word ends where the next byte is outside or begins a row
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    after[starts[(starts > 0) & (starts <= len(data))] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    firsts = np.searchsorted(begins, starts)
    return lowered, begins, ends, np.diff(np.append(firsts, len(begins)))
