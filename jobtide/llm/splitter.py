"""Splitting texts into words for tokenizers by a small deterministic machine.

The machine reads character classes and marks where words begin. A text stream is cut into
chunks; each chunk is run from every state at once, which gives its state map, and the maps
are composed by a parallel prefix scan. That tells the state each chunk really begins in,
and a second run marks the borders. All chunks take their steps together, as array
operations, so neither run is a loop over characters.
"""

import sys
import unicodedata
from functools import cache

import numpy as np

CHUNK = 128

# Character classes. Letters that end contractions have classes of their own.
_NAMES = ["space", "white", "letter", "number", "other", "quote", "s t m d", "r", "v", "e", "l"]
SPACE, WHITE, LETTER, NUMBER, OTHER, QUOTE, STMD, R, V, E, L = range(len(_NAMES))
_FIRST = 16  # added to the class of a text's first character
_CLASSES = 2 * _FIRST

# The characters with the property White_Space.
_WHITE_SPACE = [9, 10, 11, 12, 13, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029,
                0x202F, 0x205F, 0x3000]

# States. RUN_*: in white space; one or several characters, the last a space or not.
(START, ONE_SPACE, ONE_WHITE, RUN_SPACE, RUN_WHITE, IN_LETTERS, IN_NUMBERS, IN_OTHERS,
 QUOTED, QUOTE_R, QUOTE_V, QUOTE_L, ENDED) = range(13)
_STATES = 13

# What a step marks: a word begins at this character, at the one before, or both.
HERE, BEFORE = 1, 2


@cache
def class_table() -> np.ndarray:
    table = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    major = np.frombuffer(
        "".join(unicodedata.category(chr(c))[0] for c in range(sys.maxunicode + 1)).encode(), np.uint8)
    table[major == ord("L")] = LETTER
    table[major == ord("N")] = NUMBER
    table[_WHITE_SPACE] = WHITE
    table[ord(" ")] = SPACE
    table[ord("'")] = QUOTE
    for letters, kind in (("stmd", STMD), ("r", R), ("v", V), ("e", E), ("l", L)):
        table[[ord(c) for c in letters]] = kind
    return table


def _kind(symbol: int) -> int:
    return LETTER if symbol >= STMD else symbol


def _step(state: int, symbol: int, spaces_join: bool) -> tuple[int, int]:
    """The state after ``symbol`` and the marks; the rules of the split pattern.

    ``spaces_join``: the last space of a run belongs to the word after it and runs are
    words; else white space only separates, and each number is a word.
    """
    marks = 0
    if state in (QUOTE_R, QUOTE_V, QUOTE_L):
        if symbol == (L if state == QUOTE_L else E):
            return ENDED, 0
        marks, state = BEFORE, IN_LETTERS  # no contraction: the letter begins a word
    if state == QUOTED:
        if symbol == STMD:
            return ENDED, 0
        if symbol in (R, V, L):
            return {R: QUOTE_R, V: QUOTE_V, L: QUOTE_L}[symbol], 0
        state = IN_OTHERS
    kind = _kind(symbol)
    if kind in (SPACE, WHITE):
        if state in (ONE_SPACE, ONE_WHITE, RUN_SPACE, RUN_WHITE):
            return (RUN_SPACE if kind == SPACE else RUN_WHITE), marks
        return (ONE_SPACE if kind == SPACE else ONE_WHITE), marks | HERE
    joined = False
    if state in (ONE_SPACE, ONE_WHITE, RUN_SPACE, RUN_WHITE):
        if spaces_join:
            if state in (RUN_SPACE, RUN_WHITE):
                marks |= BEFORE
            joined = state in (ONE_SPACE, RUN_SPACE)
        state = START
    target = {LETTER: IN_LETTERS, NUMBER: IN_NUMBERS, OTHER: IN_OTHERS, QUOTE: IN_OTHERS}[kind]
    same = state == target and (spaces_join or target != IN_NUMBERS)
    if not same and not joined:
        marks |= HERE
        if kind == QUOTE:
            return QUOTED, marks
    return target, marks


@cache
def machine(spaces_join: bool) -> tuple[np.ndarray, np.ndarray]:
    """Next states and marks by ``state * _CLASSES + class``."""
    after = np.zeros(_STATES * _CLASSES, np.uint8)
    marks = np.zeros(_STATES * _CLASSES, np.uint8)
    for state in range(_STATES):
        for symbol in range(len(_NAMES)):
            place = state * _CLASSES + symbol
            after[place], marks[place] = _step(state, symbol, spaces_join)
            # the first of a text begins anew, whatever the text before it ended in
            fresh, mark = _step(START, symbol, spaces_join)
            pending = BEFORE if state in (QUOTE_R, QUOTE_V, QUOTE_L) else 0
            after[place + _FIRST], marks[place + _FIRST] = fresh, mark | HERE | pending
    return after, marks


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The characters of UTF-8 bytes, and the byte each begins at."""
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    first = data[lead]
    points = first.astype(np.uint32)
    if len(lead) == len(data):
        return points, lead
    padded = np.concatenate([data, np.zeros(3, np.uint8)])
    for low, keep, more in ((0xC0, 0x1F, 1), (0xE0, 0x0F, 2), (0xF0, 0x07, 3)):
        high = {0xC0: 0xE0, 0xE0: 0xF0, 0xF0: 0x100}[low]
        some = np.flatnonzero((first >= low) & (first < high))
        value = points[some] & keep
        for i in range(1, more + 1):
            value = (value << 6) | (padded[lead[some] + i] & 0x3F)
        points[some] = value
    return points, lead


@cache
def images(spaces_join: bool) -> tuple[np.ndarray, np.ndarray]:
    """The states that can follow each class (few), and which of them follows each state."""
    after, _ = machine(spaces_join)
    sets = [sorted(set(after[symbol::_CLASSES].tolist())) for symbol in range(_CLASSES)]
    width = max(map(len, sets))
    states = np.array([s + s[:1] * (width - len(s)) for s in sets], np.uint8)
    which = np.zeros((_STATES, _CLASSES), np.uint8)
    for symbol, members in enumerate(sets):
        for state in range(_STATES):
            which[state, symbol] = members.index(after[state * _CLASSES + symbol])
    return states, which


def entry_states(classes: np.ndarray, spaces_join: bool) -> np.ndarray:
    """The state each chunk (column) of ``classes`` begins in.

    After its first character a chunk can only be in few states; it is run from each of
    these, which gives its whole state map.
    """
    after, _ = machine(spaces_join)
    few, which = images(spaces_join)
    steps, chunks = classes.shape
    ends = few[classes[0]].T.copy()
    for i in range(1, steps):
        ends = after[ends.astype(np.int16) * _CLASSES + classes[i]]
    maps = np.take_along_axis(ends.T, which[:, classes[0]].T.astype(np.intp), axis=1)
    reach = 1
    while reach < chunks:  # maps[i] becomes the map of all chunks up to i
        maps[reach:] = np.take_along_axis(maps[reach:], maps[:-reach].astype(np.intp), axis=1)
        reach *= 2
    entry = np.full(chunks, START, np.uint8)
    entry[1:] = maps[:-1, START]
    return entry


def word_starts(classes: np.ndarray, firsts: np.ndarray, spaces_join: bool) -> np.ndarray:
    """The characters words begin at; ``firsts``: the first character of each text."""
    n = len(classes)
    if n == 0:
        return np.zeros(0, np.int64)
    after, marks = machine(spaces_join)
    symbols = classes.copy()
    symbols[firsts] += _FIRST
    chunks = -(-n // CHUNK)
    padded = np.full(chunks * CHUNK, WHITE + _FIRST, np.uint8)
    padded[:n] = symbols
    table = np.ascontiguousarray(padded.reshape(chunks, CHUNK).T)
    state = entry_states(table, spaces_join)
    found = np.empty((CHUNK, chunks), np.uint8)
    for i in range(CHUNK):
        place = state.astype(np.int16) * _CLASSES + table[i]
        state, found[i] = after[place], marks[place]
    found = found.T.reshape(-1)
    begins = (found[:n] & HERE) != 0
    begins[:-1] |= (found[1:n] & BEFORE) != 0
    # one character past the end is a text's first: it closes a pending contraction
    last = found[n] if n < len(found) else marks[int(state[-1]) * _CLASSES + WHITE + _FIRST]
    begins[-1] |= (last & BEFORE) != 0
    return np.flatnonzero(begins)


def first_characters(lead: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The first character of each text that has any, given where texts start and end."""
    return np.searchsorted(lead, starts[ends > starts])
