"""Byte-pair encoding by backtracking over longest token matches, and decoding by offsets.

A word is encoded without replaying merges. One pass of an Aho-Corasick automaton over the
reversed word (all tokens reversed) gives the longest token that starts at each place. From
the left, the longest match is taken if it can stand next to the token before it; if not, the
longest token that is a prefix of it, and so on; if none is left, the token before is taken
back, its end is marked dead, and shorter ones are tried there. As no place is entered again
once it is dead, the work is linear in the word, and the result is the one that merging in
order of rank gives: a chain of tokens is that result if and only if each two neighbours are.

Two tokens are compatible if merging their joined text keeps the border between them. That is
read off the merges of both, undone from the latest to the earliest: the border is lost as
soon as the pieces next to it form a pair that merges before both of them are made. Answers
are kept in a table.

Decoding looks ids up in one byte string of all tokens with a table of offsets.

Defined results: a null text is empty; an empty text has no ids, and its decoded text is empty.
Strings of special tokens inside a text become these tokens, as the library does by default.
Repeated rows are encoded each. An empty table gives an empty table. Very long texts and words
take linear time; only a text's own ids are held. Result columns replace columns of the same
names.
"""

import json
import re
import struct
import sys
import unicodedata
from collections.abc import Iterator
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from tokenizers import Regex, normalizers, pre_tokenizers

from jobtide.llm import splitter, texts

RESULTS = ["n_tokens", "ids_bytes", "decoded"]
# Words kept with their ids, and how long a word may be for that; pairs kept with their answer.
KNOWN_WORDS, KNOWN_LENGTH, KNOWN_PAIRS = 1 << 18, 48, 1 << 20
# Ids decoded at a time.
_IDS = 1 << 16
# What marks the last byte of a word among the symbols.
_LAST = 256


def _byte_letters() -> list[str]:
    """Vocabulary files write bytes as letters: printable ones as themselves, others from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(256, 512))
    return [chr(b) if b in set(own) else chr(next(others)) for b in range(256)]


def _ranges(member: np.ndarray) -> str:
    """The inside of a regular-expression class of the code points that are members."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], member.view(np.int8), [0]])))
    return "".join(f"\\U{a:08x}-\\U{b - 1:08x}" for a, b in edge.reshape(-1, 2).tolist())


@cache
def _word_pattern(limit: int) -> re.Pattern:
    """Words of texts with code points under ``limit``: small classes are faster."""
    table = splitter.class_table()[:limit]
    letters = _ranges((table == splitter.LETTER) | (table >= splitter.STMD))
    numbers = _ranges(table == splitter.NUMBER)
    white = _ranges((table == splitter.SPACE) | (table == splitter.WHITE))
    return re.compile(f"'(?:[stmd]|re|ve|ll)|[{letters}]+|[{numbers}]|[^{white}{letters}{numbers}]+")


@cache
def _unassigned() -> np.ndarray:
    """By code point: whether Python's tables do not know it, though those of the library may."""
    return np.array([unicodedata.category(chr(c)) == "Cn" for c in range(sys.maxunicode + 1)])


_ASTRAL = re.compile("[\U00010000-\U0010ffff]")
# The library's own steps before the merges, for texts with such characters.
_NORMAL = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])
_SPLIT = pre_tokenizers.Split(
    Regex(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"), "removed", invert=True)


def split_words(text: str) -> list[str]:
    """The text in normal form and lower case, as words: contractions, letters, one digit, others."""
    if text.isascii():
        return _word_pattern(128).findall(text.lower())
    if _unassigned()[np.frombuffer(text.encode("utf-32-le"), "<u4")].any():
        return [word for word, _ in _SPLIT.pre_tokenize_str(_NORMAL.normalize_str(text))]
    # no special form of sigma at the end of words
    lowered = unicodedata.normalize("NFC", text).replace("\u03a3", "\u03c3").lower()
    limit = sys.maxunicode + 1 if _ASTRAL.search(lowered) else 1 << 16
    return _word_pattern(limit).findall(lowered)


class Codec:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            stored = json.load(file)
        model = stored["model"]
        suffix = model["end_of_word_suffix"]
        steps = [n["type"] for n in (stored["normalizer"] or {}).get("normalizers", [])]
        if model["type"] != "BPE" or not suffix or steps != ["NFC", "Replace", "Lowercase"]:
            raise ValueError("only lower-casing BPE vocabularies with word ends can be read")
        letters = {letter: chr(b) for b, letter in enumerate(_byte_letters())}

        def symbols(token: str) -> str:
            ended = token.endswith(suffix)
            plain = [letters[c] for c in (token[:-len(suffix)] if ended else token)]
            if ended:
                plain[-1] = chr(ord(plain[-1]) + _LAST)
            return "".join(plain)

        vocab = model["vocab"]
        size = max([*vocab.values(), *[t["id"] for t in stored["added_tokens"]]]) + 1
        self.left, self.right = [-1] * size, [-1] * size
        self.rank = [-1] * size  # of single bytes: before every merge
        self.merged: dict[int, int] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            first, second, token = vocab[a], vocab[b], vocab[a + b]
            self.left[token], self.right[token], self.rank[token] = first, second, rank
            self.merged[first << 32 | second] = token
        self.pairs: dict[int, bool] = {}
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.length = [1] * size
        forms = {}
        for token, number in vocab.items():
            form = symbols(token)
            # merging never makes a token whose own text merges to something else
            if self.left[number] >= 0 and not self._keeps_border(
                    self.left[number], self.right[number], self.rank[number]):
                continue
            if self.left[number] < 0 and len(form) > 1:
                continue
            forms[form] = number
            self.length[number] = len(form)
        self.whole = forms
        self.starts = ahocorasick.Automaton()
        for form, number in forms.items():
            self.starts.add_word(form[::-1], number)
        self.starts.make_automaton()
        # the longest token that is a shorter prefix of each token
        self.shorter = [-1] * size
        for form, number in forms.items():
            for end in range(len(form) - 1, 0, -1):
                if form[:end] in forms:
                    self.shorter[number] = forms[form[:end]]
                    break
        self.special = {t["content"]: t["id"] for t in stored["added_tokens"]}
        names = {**{i: t for t, i in vocab.items()}, **{i: t for t, i in self.special.items()}}
        written = [names[i].encode() + b" " if i in names else b"" for i in range(size)]
        self.offsets = np.concatenate([[0], np.cumsum([len(w) for w in written])])
        self.letters = np.frombuffer(b"".join(written), np.uint8)

    def _keeps_border(self, a: int, b: int, before: int) -> bool:
        """Whether no merge of a rank under ``before`` joins the end of ``a`` and the start of ``b``."""
        limit = before
        while True:
            joined = self.merged.get(a << 32 | b)
            if joined is not None and self.rank[joined] < limit:
                return False
            # undo the later of the two merges; of its parts only the one at the border counts.
            # From here on, what joins across must come before the undone merge; on equal ranks
            # (one token twice) the left one is made first, so it is undone last
            if self.left[a] < 0 and self.left[b] < 0:
                return True
            if self.rank[a] > self.rank[b]:
                limit, a = self.rank[a], self.right[a]
            else:
                limit, b = self.rank[b] + 1, self.left[b]

    def compatible(self, a: int, b: int) -> bool:
        key = a << 32 | b
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) >= KNOWN_PAIRS:
                self.pairs.clear()
            found = self.pairs[key] = self._keeps_border(a, b, 1 << 62)
        return found

    def word_ids(self, word: str) -> list[int]:
        """The ids of one word that has been lower-cased and split off."""
        raw = word.encode().decode("latin-1")
        form = raw[:-1] + chr(ord(raw[-1]) + _LAST)
        if form in self.whole:  # the longest match is the word
            return [self.whole[form]]
        size = len(form)
        longest = [-1] * (size + 1)
        length, shorter, compatible = self.length, self.shorter, self.compatible
        for back, token in self.starts.iter(form[::-1]):
            place = size - 1 - back
            if longest[place] < 0 or length[token] > length[longest[place]]:
                longest[place] = token
        alive = bytearray(b"\1") * (size + 1)
        ids: list[int] = []
        place, token = 0, longest[0]
        while place < size:
            while token >= 0 and not (
                    alive[place + length[token]] and (not ids or compatible(ids[-1], token))):
                token = shorter[token]
            if token >= 0:
                ids.append(token)
                place += length[token]
                token = longest[place]
            else:
                alive[place] = 0
                last = ids.pop()
                place -= length[last]
                token = shorter[last]
        return ids

    def _packed(self, word: str) -> bytes:
        """The ids of a word not among the ones met lately."""
        packed = self.older.get(word)
        if packed is None:
            ids = self.word_ids(word)
            packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(word) <= KNOWN_LENGTH:
            if len(self.known) >= KNOWN_WORDS:  # words not met again are forgotten
                self.known, self.older = {}, self.known
            self.known[word] = packed
        return packed

    def _plain(self, text: str) -> bytes:
        words = split_words(text)
        found = list(map(self.known.get, words))
        if None in found:
            # a word that is new here twice is found the second time
            found = [p or self.known.get(w) or self._packed(w) for p, w in zip(found, words, strict=True)]
        return b"".join(found)

    def encode(self, text: str | None) -> bytes:
        """Ids of the whole text as little-endian 32-bit integers."""
        text = text or ""
        if not any(s in text for s in self.special):
            return self._plain(text)
        out = []
        for part in re.split("(" + "|".join(map(re.escape, self.special)) + ")", text):
            if part in self.special:
                out.append(struct.pack("<I", self.special[part]))
            else:
                out.append(self._plain(part))
        return b"".join(out)

    def decode(self, ids: np.ndarray) -> bytes:
        """The tokens' texts with one space between, in UTF-8; ids without a token are left out."""
        out = []
        for low in range(0, len(ids), _IDS):
            some = ids[low:low + _IDS].astype(np.int64)
            some = some[some < len(self.offsets) - 1]
            begin = self.offsets[some]
            size = self.offsets[some + 1] - begin
            place = np.arange(int(size.sum())) + np.repeat(begin - (np.cumsum(size) - size), size)
            out.append(self.letters[place].tobytes())
        return b"".join(out)[:-1]


@cache
def codec_for(path: str) -> Codec:
    """One per Python worker."""
    return Codec(path)


def _run(docs: DataFrame, drop: list[str], without: str | None, work, results: str) -> DataFrame:
    """``docs`` without ``drop`` and ``without``, with the columns that ``work`` makes of a batch."""
    own = docs.drop(*drop)
    kept = [f for f in own.schema if f.name != without]
    names = [part.split()[0] for part in results.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for columns, part in work(batch):
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(f.name) for f in kept], *columns], [*[f.name for f in kept], *names])

    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept]
    return own.mapInArrow(run, ", ".join([*schema, results]))


def encode_texts(docs: DataFrame, vocabulary: str, text: str = "text") -> DataFrame:
    """``docs`` with ``n_tokens`` and ``ids_bytes``, the ids as little-endian 32-bit integers."""
    def work(batch: pa.RecordBatch):
        codec = codec_for(vocabulary)
        for part in texts.pieces(batch, text):
            ids = [codec.encode(t) for t in part.column(text).to_pylist()]
            yield [pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary())], part

    return _run(docs, ["n_tokens", "ids_bytes"], None, work, "n_tokens long, ids_bytes binary")


def decode_ids(encoded: DataFrame, vocabulary: str, ids: str = "ids_bytes") -> DataFrame:
    """``encoded`` with ``decoded``: the text of its ids; null ids are none."""
    def work(batch: pa.RecordBatch):
        codec = codec_for(vocabulary)
        for part in texts.pieces(batch, ids):
            found = [codec.decode(np.frombuffer(i or b"", "<u4")).decode() for i in part.column(ids).to_pylist()]
            yield [pa.array(found, pa.string())], part

    return _run(encoded, ["decoded"], None, work, "decoded string")


def round_trip(docs: DataFrame, vocabulary: str, text: str = "text") -> DataFrame:
    """``docs`` without the text, with ``n_tokens``, ``ids_bytes`` and ``decoded``, in one pass."""
    def work(batch: pa.RecordBatch):
        codec = codec_for(vocabulary)
        for part in texts.pieces(batch, text):
            ids = [codec.encode(t) for t in part.column(text).to_pylist()]
            found = [codec.decode(np.frombuffer(i, "<u4")).decode() for i in ids]
            yield [pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary()),
                   pa.array(found, pa.string())], part

    return _run(docs, RESULTS, text, work, "n_tokens long, ids_bytes binary, decoded string")
