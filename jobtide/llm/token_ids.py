"""Token ids of whole texts with a lower-casing word tokenizer.

The words of a batch are found by the splitter's machine and told apart by their hashes;
the tokenizer library is asked once for each distinct word and its ids are put in place.
Texts with characters that lower-casing or Unicode normalization could change in length or
join, and texts with special strings, go to the library whole.

Defined results: a null text is empty and has no ids.
"""

from functools import cache

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from jobtide.llm import splitter, texts

# Below this, characters stand in normal form for themselves.
PLAIN = 0x250
KNOWN_WORDS = 1 << 20
_SLOTS = 1 << 20


@cache
def _lowered() -> tuple[np.ndarray, np.ndarray]:
    """Lower-case characters, and which ones are plain enough to use them."""
    low = np.arange(PLAIN, dtype=np.uint32)
    plain = np.ones(PLAIN, bool)
    for c in range(PLAIN):
        lower = chr(c).lower()
        if len(lower) == 1 and ord(lower) < PLAIN:
            low[c] = ord(lower)
        else:
            plain[c] = False
    return low, plain


class WordTokenizer:
    """Ids of texts, with the words met so far kept up to ``KNOWN_WORDS``."""

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self._forget()

    def _forget(self) -> None:
        self.hashes = np.zeros(0, np.uint64)  # sorted, with the word's number
        self.numbers = np.zeros(0, np.int64)
        self.firsts = np.zeros(0, np.int64)  # by number: where its ids are in flat
        self.sizes = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.int32)
        # the word last met for each slot of hashes, to look up most words at once
        self.slot_hash = np.zeros(_SLOTS, np.uint64)
        self.slot_number = np.full(_SLOTS, -1, np.int32)

    def _learn(self, hashes: np.ndarray, words: list[str]) -> None:
        """Ask the library for the ids of new words, many of them in one text."""
        parts, sizes = [], []
        for i in range(0, len(words), 2000):
            some = words[i:i + 2000]
            encoded = self.library.encode(" ".join(some), add_special_tokens=False)
            parts.append(np.array(encoded.ids, np.int32))
            sizes.append(np.bincount(np.array(encoded.word_ids), minlength=len(some)))
        sizes = np.concatenate(sizes)
        numbers = np.concatenate([self.numbers, len(self.sizes) + np.arange(len(words))])
        hashes = np.concatenate([self.hashes, hashes])
        order = np.argsort(hashes)
        self.hashes, self.numbers = hashes[order], numbers[order]
        self.firsts = np.concatenate([self.firsts, len(self.flat) + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.flat = np.concatenate([self.flat, *parts])

    def ids(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the column's texts end to end, and how many each text has."""
        data, starts, ends = texts.text_bytes(column)
        low, plain = _lowered()
        points, lead = splitter.code_points(data)
        odd = np.flatnonzero(points >= PLAIN)
        odd = np.union1d(odd, np.flatnonzero(~plain[np.minimum(points, PLAIN - 1)]))
        whole = np.zeros(len(starts), bool)
        filled = np.flatnonzero(ends > starts)
        whole[filled[np.searchsorted(starts[filled], lead[odd], side="right") - 1]] = True
        raw = data.tobytes()
        if any(s.encode() in raw for s in self.special):
            for row in filled.tolist():
                text = raw[starts[row]:ends[row]]
                whole[row] |= any(s.encode() in text for s in self.special)
        firsts = splitter.first_characters(lead, starts, ends)
        lower = low[np.minimum(points, PLAIN - 1)]
        classes = splitter.class_table()[lower]
        begin = splitter.word_starts(classes, firsts, spaces_join=False)
        end = np.append(begin[1:], len(points)) if len(begin) else begin
        owner = filled[np.searchsorted(starts[filled], lead[begin], side="right") - 1]
        used = (classes[begin] > splitter.WHITE) & ~whole[owner]
        begin, end, owner = begin[used], end[used], owner[used]
        sizes, flat_at = self._words(lower, begin, end)
        counts = np.bincount(owner, sizes, len(starts)).astype(np.int64)
        special = {}
        if whole.any():
            odd_rows = np.flatnonzero(whole)
            encoded = self.library.encode_batch(
                [raw[starts[r]:ends[r]].decode() for r in odd_rows], add_special_tokens=False)
            special = {r: np.array(e.ids, np.int32) for r, e in zip(odd_rows.tolist(), encoded, strict=True)}
            for row, ids in special.items():
                counts[row] = len(ids)
        total = int(sizes.sum())
        place = np.arange(total) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(flat_at, sizes)
        out = self.flat[place]
        if special:
            firsts = np.cumsum(counts) - counts
            merged = np.empty(int(counts.sum()), np.int32)
            mine = np.ones(len(merged), bool)
            for row, ids in special.items():
                merged[firsts[row]:firsts[row] + len(ids)] = ids
                mine[firsts[row]:firsts[row] + len(ids)] = False
            merged[mine] = out
            out = merged
        return out, counts

    def _words(self, lower: np.ndarray, begin: np.ndarray, end: np.ndarray):
        """Per word: its number of ids, and where they begin in ``flat``."""
        if len(begin) == 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        hashes = texts.span_hashes(lower, begin, end)
        if len(self.hashes) > KNOWN_WORDS:
            self._forget()
        slots = (hashes & np.uint64(_SLOTS - 1)).astype(np.int64)
        numbers = self.slot_number[slots].astype(np.int64)
        missed = np.flatnonzero((numbers < 0) | (self.slot_hash[slots] != hashes))
        if len(missed):
            distinct, first, back = np.unique(hashes[missed], return_index=True, return_inverse=True)
            at = np.searchsorted(self.hashes, distinct)
            known = at < len(self.hashes)
            known[known] = self.hashes[at[known]] == distinct[known]
            new = missed[first[~known]]
            if len(new):
                words = [lower[begin[i]:end[i]].tobytes().decode("utf-32-le") for i in new.tolist()]
                self._learn(distinct[~known], words)
                at = np.searchsorted(self.hashes, distinct)
            numbers[missed] = self.numbers[at][back]
            self.slot_hash[slots[missed]] = hashes[missed]
            self.slot_number[slots[missed]] = numbers[missed]
        return self.sizes[numbers], self.firsts[numbers]


@cache
def tokenizer_for(path: str) -> WordTokenizer:
    """One per Python worker."""
    return WordTokenizer(path)
