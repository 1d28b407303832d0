"""Token counts by a compiled finite-state tokenizer.

A byte-pair tokenizer is compiled into deterministic transducers. The first splits texts
into words (``splitter``; chunk state maps composed by a prefix scan). The second reads the
bytes of a word; each transition carries the change in the number of tokens, so a word's
count is the sum over its path. A word always begins in the start state: the map of any
chunk that holds a border is constant, and words are lanes that step together.

A state is what the next tokens can depend on: the longest end of the bytes read that
begins a vocabulary entry, and for each cut in it the last token of the bytes up to there,
with its count. The last token after one more byte is the one vocabulary entry ending there
that stands beside the last token before it in a tokenization of the two alone; a sequence
whose neighbours all do so is the tokenization of its bytes.

States and transitions are made when first met, and dropped all together beyond
``MAX_STATES``, so memory is bounded and every text is counted whole.

Defined results: a null text counts as empty, with no tokens; repeated rows get equal counts.
Strings of special tokens are single tokens where the tokenizer's file says so.
"""

import json
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from jobtide.llm import splitter, texts

MAX_STATES = 300_000


def byte_of_character() -> dict[str, int]:
    """The printable stand-ins of bytes in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(b): b for b in plain}
    for i, b in enumerate(b for b in range(256) if b not in set(plain)):
        table[chr(256 + i)] = b
    return table


class Merges:
    """The vocabulary and merge order of a byte-level tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        to_byte = byte_of_character()
        self.token = {bytes(to_byte[c] for c in name): i for name, i in spec["model"]["vocab"].items()}
        self.spelled = {i: name for name, i in self.token.items()}
        self.rank: dict[tuple[bytes, bytes], int] = {}
        for order, pair in enumerate(spec["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.rank[bytes(to_byte[c] for c in left), bytes(to_byte[c] for c in right)] = order
        self.special = [t["content"].encode() for t in spec["added_tokens"]]
        self._beside: dict[tuple[bytes, bytes], bool] = {}

    def tokenize(self, word: bytes) -> list[bytes]:
        """Merge the pair of lowest order, leftmost first, until none is left."""
        parts = [word[i:i + 1] for i in range(len(word))]
        while len(parts) > 1:
            order = [(self.rank.get(pair, len(self.rank)), i)
                     for i, pair in enumerate(zip(parts, parts[1:], strict=False))]
            best, i = min(order)
            if best == len(self.rank):
                break
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def beside(self, left: bytes, right: bytes) -> bool:
        """Whether the two, alone, stay two tokens; ``left`` may be empty."""
        known = self._beside.get((left, right))
        if known is None:
            expected = [left, right] if left else [right]
            known = self._beside[left, right] = self.tokenize(left + right) == expected
        return known


class Transducer:
    """Word bytes to token counts; states are numbers, made when first met."""

    def __init__(self, merges: Merges, max_states: int = MAX_STATES):
        self.merges, self.max_states = merges, max_states
        self.prefixes = {name[:i] for name in merges.token for i in range(len(name) + 1)}
        self._forget()

    def _forget(self) -> None:
        start = (b"", (b"",), (0,))
        self.states, self.number = [start], {start: 0}
        self.column = np.full(256, -1, np.int64)
        self.columns = 0
        self.table = np.full((1024, 32), -1, np.int32)
        self.merges._beside.clear()

    def _next(self, state, byte: bytes):
        """The state after ``byte`` and the change in the number of tokens."""
        tail, last, count = state
        read = tail + byte
        for cut in range(len(read)):
            name = read[cut:]
            if name in self.merges.token and self.merges.beside(last[cut], name):
                break
        else:
            raise ValueError(f"the vocabulary lacks the byte {byte!r}")
        now = count[cut] + 1
        lasts, counts = (*last, name), (*count, now)
        keep = next(i for i in range(len(read) + 1) if read[i:] in self.prefixes)
        return (read[keep:], lasts[keep:], tuple(c - now for c in counts[keep:])), now

    def _make(self, keys: np.ndarray) -> None:
        """Fill in transitions; a key is ``state * 256 + byte``."""
        for key in keys.tolist():
            state, byte = divmod(key, 256)
            if self.column[byte] < 0:
                self.column[byte] = self.columns
                self.columns += 1
                if self.columns > self.table.shape[1]:
                    wider = np.full((len(self.table), 2 * self.table.shape[1]), -1, np.int32)
                    wider[:, :self.table.shape[1]] = self.table
                    self.table = wider
            target, change = self._next(self.states[state], bytes([byte]))
            number = self.number.setdefault(target, len(self.states))
            if number == len(self.states):
                self.states.append(target)
                if number >= len(self.table):
                    more = np.full((len(self.table) // 4, self.table.shape[1]), -1, np.int32)
                    self.table = np.concatenate([self.table, more])
            self.table[state, self.column[byte]] = number * 256 + change + 128

    def count(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Tokens of each word ``data[start:end]``; words step together, longest first."""
        if len(self.states) > self.max_states:
            self._forget()
        lengths = ends - starts
        order = np.argsort(-lengths, kind="stable")
        begin, size = starts[order], lengths[order]
        active = np.searchsorted(-size, -np.arange(int(size[0]) if len(size) else 0), side="left")
        state = np.zeros(len(order), np.int64)
        total = np.zeros(len(order), np.int32)
        for step, lanes in enumerate(active.tolist()):
            byte = data[begin[:lanes] + step]
            now = state[:lanes]
            column = self.column[byte]
            found = self.table[now, column]
            missing = np.flatnonzero((found < 0) | (column < 0))
            if len(missing):
                self._make(np.unique(now[missing] * 256 + byte[missing]))
                found = self.table[now, self.column[byte]]
            state[:lanes] = found >> 8
            total[:lanes] += (found & 255) - 128
        result = np.empty(len(order), np.int32)
        result[order] = total
        return result


def _special_ranges(data: bytes, special: list[bytes], starts, ends) -> list[tuple[int, int, int]]:
    """(row, start, end) of special strings inside rows, leftmost first, not overlapping."""
    found = []
    if any(s in data for s in special):
        for row, (a, b) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
            at = a
            while True:
                hits = [(data.find(s, at, b), -len(s)) for s in special]
                hits = [h for h in hits if h[0] >= 0]
                if not hits:
                    break
                place, size = min(hits)
                found.append((row, place, place - size))
                at = place - size
    return found


def count_tokens_of(column: pa.Array, transducer: Transducer) -> np.ndarray:
    """Tokens of each text of the column."""
    data, starts, ends = texts.text_bytes(column)
    counts = np.zeros(len(starts), np.int64)
    rows = np.arange(len(starts))
    found = _special_ranges(data.tobytes(), transducer.merges.special, starts, ends)
    if found:
        owner, low, high = np.array(found).T
        counts += np.bincount(owner, minlength=len(starts))
        keep = np.ones(len(data), bool)
        for a, b in zip(low, high, strict=True):
            keep[a:b] = False
        # texts are cut at special strings, which are taken out
        every = np.concatenate([rows, owner])
        cut_starts, cut_ends = np.concatenate([starts, high]), np.concatenate([ends, low])
        order = np.lexsort((cut_starts, every))
        starts, ends = cut_starts[order], cut_ends[np.lexsort((cut_ends, every))]
        rows = every[order]
        shift = np.concatenate([[0], np.cumsum(keep)])
        data, starts, ends = data[keep], shift[starts], shift[ends]
    points, lead = splitter.code_points(data)
    firsts = splitter.first_characters(lead, starts, ends)
    words = splitter.word_starts(splitter.class_table()[points], firsts, spaces_join=True)
    begin = lead[words]
    end = np.append(begin[1:], len(data)) if len(begin) else begin
    tokens = transducer.count(data, begin, end)
    filled = np.flatnonzero(ends > starts)
    owner = filled[np.searchsorted(starts[filled], begin, side="right") - 1]
    return counts + np.bincount(rows[owner], tokens, len(counts)).astype(np.int64)


@cache
def transducer_for(path: str) -> Transducer:
    """One per Python worker: later tasks go on with the states made by earlier ones."""
    return Transducer(Merges(path))


def _count(batches: Iterator[pa.RecordBatch], text: str, path: str):
    transducer = transducer_for(path)
    for batch in batches:
        names = [n for n in batch.schema.names if n != text]
        for piece in texts.pieces(batch, text):
            _, starts, ends = texts.text_bytes(piece.column(text))
            counts = count_tokens_of(piece.column(text), transducer)
            yield pa.RecordBatch.from_arrays(
                [*[piece.column(n) for n in names], pa.array(ends - starts), pa.array(counts)],
                [*names, "n_bytes", "n_tokens"])


def count_tokens(docs: DataFrame, vocabulary: str, text: str = "text") -> DataFrame:
    """``docs`` without its text, with ``n_bytes`` (UTF-8) and ``n_tokens``.

    ``vocabulary`` is the path of a byte-level tokenizer file, readable on every executor.
    Result columns replace columns of the same names.
    """
    own = docs.drop("n_bytes", "n_tokens")
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema if f.name != text]
    return own.mapInArrow(lambda batches: _count(batches, text, vocabulary),
                          ", ".join([*kept, "n_bytes long", "n_tokens long"]))
