"""Benchmark decontamination by winnowed fingerprints.

Texts become words, words become 64-bit hashes. Of every ``w`` consecutive k-grams the one
with the smallest hash (the last of equal ones) is a fingerprint, in documents and in
benchmark items alike. A shared span of ``k + w - 1`` words thus always shares one. A shared
fingerprint is extended to the windows that hold it, and each of these is compared word by
word with the item window of the same hash. Items shorter than a window are looked up whole:
k is their length and w is 1.

A place of a document is extended once, however many fingerprints and item places meet there,
and equal windows of items are one, with the list of their items. So the work is linear in the
text and the benchmark, for periodic texts and for phrases that very many items share too.

The benchmark is sent to the tasks in blocks of about ``block_bytes`` of text. Nothing is
shuffled, and no document is compared with another. If there are several blocks, the documents
are stored after each but the last, so that tasks hold one block at a time; the driver builds
one block at a time as well.

Defined results: null and empty texts have no words, no hits and are not contaminated; an
empty benchmark hits nothing. Items with equal ids are one item, a null id counts as ''.
Repeated documents get equal results. Result columns replace columns of the same names.
"""

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobtide.llm import scratch, texts
from jobtide.llm.columns import only_kept

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.zeros(256, bool)
_IS_WORD[48:58] = _IS_WORD[97:123] = _IS_WORD[128:] = True


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the column, and how many words each row has."""
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
    row_ends = starts[(starts > 0) & (starts <= len(data))] - 1
    after[row_ends] = False
    ends = np.flatnonzero(inside & ~after) + 1
    firsts = np.searchsorted(begins, starts)
    counts = np.diff(np.append(firsts, len(begins)))
    return texts.span_hashes(lowered, begins, ends), counts


_ONE, _OTHER = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F


def gram_hashes(words: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-grams inside rows, and the place of their first words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.zeros(n, np.uint64)
    for i in range(k):
        total = total * np.uint64(_ONE) + words[i:i + n]
    places = np.flatnonzero(rows[:n] == rows[k - 1:])
    return texts.mixed(total[places]), places


def hashes_at(words: np.ndarray, places: np.ndarray, k: int, base: int = _ONE) -> np.ndarray:
    """Hashes of the k-grams that begin at ``places``."""
    total = np.zeros(len(places), np.uint64)
    for i in range(k):
        total = total * np.uint64(base) + words[places + i]
    return texts.mixed(total)


def winnowed(grams: np.ndarray, places: np.ndarray, rows: np.ndarray, w: int):
    """The fingerprints: of each window of ``w`` grams in a row, the last smallest one."""
    n = len(grams) - w + 1
    if w == 1 or n <= 0:
        return (grams, places) if w == 1 else (grams[:0], places[:0])
    best, at = grams[:n].copy(), np.zeros(n, np.int64)
    for i in range(1, w):
        other = grams[i:i + n]
        lower = other <= best
        best[lower] = other[lower]
        at[lower] = i
    whole = rows[places[:n]] == rows[places[w - 1:]]
    # a row with fewer grams than a window has none; grams of a row are consecutive
    chosen = np.unique((np.arange(n) + at)[whole])
    return grams[chosen], places[chosen]


@dataclass
class Level:
    """Windows of ``k + w - 1`` words of a block's items, and their fingerprints."""

    k: int
    w: int
    prints: np.ndarray  # distinct and sorted
    windows: np.ndarray  # hashes of the distinct windows, sorted
    at: np.ndarray  # where each of these occurs first in the block's words
    marks: np.ndarray  # where its items begin in ``items``, and one more
    items: np.ndarray

    @property
    def span(self) -> int:
        return self.k + self.w - 1


@dataclass
class Index:
    """A block of items: their ids, all their words, and the levels (k, w)."""

    names: list[str]
    words: np.ndarray
    levels: list[Level] = field(default_factory=list)


def _windows(words: np.ndarray, rows: np.ndarray, members: np.ndarray, span: int):
    """Distinct windows of the member rows: hashes, first places, marks of their items, items."""
    hashes, places = gram_hashes(words, rows, span)
    mine = members[rows[places]]
    hashes, places = hashes[mine], places[mine]
    second, owner = hashes_at(words, places, span, _OTHER), rows[places]
    order = np.lexsort((owner, second, hashes))
    hashes, second, places, owner = hashes[order], second[order], places[order], owner[order]
    other = np.ones(len(order), bool)
    other[1:] = (hashes[1:] != hashes[:-1]) | (second[1:] != second[:-1])
    entry = other.copy()
    entry[1:] |= owner[1:] != owner[:-1]
    firsts = np.flatnonzero(other)
    marks = np.append(np.cumsum(entry)[firsts] - 1, entry.sum())
    return hashes[firsts], places[firsts], marks, owner[entry]


def build_index(items: list[tuple[str, str]], window: int, k: int) -> Index:
    column = pa.array([text or "" for _, text in items], pa.large_string())
    words, lengths = word_hashes(column)
    index = Index([name or "" for name, _ in items], words)
    rows = np.repeat(np.arange(len(items)), lengths)
    short = sorted({int(n) for n in lengths if 0 < n < window})
    levels = [(k, window - k + 1, lengths >= window)] if (lengths >= window).any() else []
    levels += [(n, 1, lengths == n) for n in short]
    for size, w, members in levels:
        prints, places = winnowed(*gram_hashes(words, rows, size), rows, w)
        prints = np.unique(prints[members[rows[places]]])
        index.levels.append(Level(size, w, prints, *_windows(words, rows, members, size + w - 1)))
    return index


def _expanded(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all ranges end to end, and the range each is of."""
    each = high - low
    source = np.repeat(np.arange(len(low)), each)
    return np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each) + low[source], source


def _matches(words: np.ndarray, rows: np.ndarray, ends: np.ndarray, firsts: np.ndarray,
             index: Index, level: Level) -> tuple[np.ndarray, np.ndarray]:
    """Places at which a window of the level occurs, and its number."""
    prints, at = winnowed(*gram_hashes(words, rows, level.k), rows, level.w)
    nearest = np.searchsorted(level.prints, prints)
    known = nearest < len(level.prints)
    known[known] = level.prints[nearest[known]] == prints[known]
    hit = at[known]
    # the windows that hold a shared fingerprint begin from low to high
    low = np.maximum(firsts[rows[hit]], hit - (level.w - 1))
    high = np.minimum(hit, ends[rows[hit]] - level.span) + 1
    low, high = low[high > low], high[high > low]
    size = len(words) + 1
    starts = np.flatnonzero(np.cumsum(np.bincount(low, minlength=size) - np.bincount(high, minlength=size)) > 0)
    hashes = hashes_at(words, starts, level.span)
    window, source = _expanded(np.searchsorted(level.windows, hashes, side="left"),
                               np.searchsorted(level.windows, hashes, side="right"))
    starts = starts[source]
    same = np.ones(len(starts), bool)
    for i in range(level.span):
        same &= words[starts + i] == index.words[level.at[window] + i]
    return starts[same], window[same]


def find_hits(words: np.ndarray, counts: np.ndarray, index: Index):
    """The hit words as (row, first word in row, end word in row), and (row, item) of all items hit."""
    rows = np.repeat(np.arange(len(counts)), counts)
    ends = np.cumsum(counts)
    firsts = ends - counts
    covered = np.zeros(len(words) + 1, np.int64)
    found = [np.zeros((2, 0), np.int64)]
    for level in index.levels:
        starts, window = _matches(words, rows, ends, firsts, index, level)
        if len(starts) == 0:
            continue
        size = len(words) + 1
        covered += np.bincount(starts, minlength=size) - np.bincount(starts + level.span, minlength=size)
        pairs = np.unique(rows[starts] * len(level.windows) + window)
        row, window = pairs // len(level.windows), pairs % len(level.windows)
        entry, source = _expanded(level.marks[window], level.marks[window + 1])
        found.append(np.stack([row[source], level.items[entry]]))
    hit = np.cumsum(covered)[:-1] > 0
    begins, stops = hit.copy(), hit.copy()
    begins[1:] &= ~hit[:-1] | (rows[1:] != rows[:-1])
    stops[:-1] &= ~hit[1:] | (rows[1:] != rows[:-1])
    first, last = np.flatnonzero(begins), np.flatnonzero(stops)
    spans = rows[first], first - firsts[rows[first]], last + 1 - firsts[rows[first]]
    each = max(1, len(index.names))
    pairs = np.unique(np.concatenate(found, axis=1).T @ np.array([each, 1]))
    return spans, (pairs // each, pairs % each)


def _search(batches: Iterator[pa.RecordBatch], text: str, index: Index):
    for batch in batches:
        for piece in texts.pieces(batch, text):
            words, counts = word_hashes(piece.column(text))
            (row, first, end), (owner, item) = find_hits(words, counts, index)
            number = np.arange(len(counts) + 1)
            spans = pa.ListArray.from_arrays(
                np.searchsorted(row, number).astype(np.int32), pa.StructArray.from_arrays(
                    [pa.array(first.astype(np.int32)), pa.array(end.astype(np.int32))], ["first", "end"]))
            items = pa.ListArray.from_arrays(
                np.searchsorted(owner, number).astype(np.int32),
                pa.array([index.names[i] for i in item.tolist()], pa.string()))
            columns = [piece.column(c) for c in piece.schema.names]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(counts.astype(np.int64)), spans, items],
                [*piece.schema.names, "_d_words", "_d_spans", "_d_items"])


def _blocks(benchmark: DataFrame, item_id: str, text: str, block_bytes: int):
    """The benchmark as lists of (id, text) of bounded size, one at a time, and whether it is the last."""
    sized = benchmark.select(F.col(item_id).cast("string").alias("id"), F.col(text).alias("text"))
    total = sized.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = int(total) // block_bytes + 1
    for part in range(parts):
        mine = sized.filter(F.pmod(F.xxhash64("id", "text"), F.lit(parts)) == part)
        yield [tuple(r) for r in mine.collect()], part == parts - 1


def _covered(spans: Column) -> Column:
    """How many words lie in at least one of the spans, which are sorted by their start."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("to"))
    return F.aggregate(
        spans, start,
        lambda a, s: F.struct(
            (a.n + F.greatest(F.lit(0), s.end - F.greatest(s.first, a.to))).alias("n"),
            F.greatest(a.to, s.end).alias("to")),
        lambda a: a.n)


def mark_contamination(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id",
    item_text: str = "text", window: int = 13, k: int = 5, one_in: int = 20,
    block_bytes: int = 16 << 20,
) -> DataFrame:
    """``docs`` with ``n_words``, ``n_hit``, ``hit_spans``, ``hit_items``, ``contaminated``.

    ``hit_spans`` are word numbers, ends exclusive, per block of the benchmark; ``hit_items`` sorted, distinct ids. A
    document is contaminated if at least one in ``one_in`` of its words is hit.
    """
    spark = docs.sparkSession
    out = docs.drop("n_words", "n_hit", "hit_spans", "hit_items", "contaminated")
    for number, (block, last) in enumerate(_blocks(benchmark, item_id, item_text, block_bytes)):
        sent = spark.sparkContext.broadcast(build_index(block, window, k))
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema)
        found = "_d_words long, _d_spans array<struct<first:int,end:int>>, _d_items array<string>"

        def search(batches, sent=sent):
            return _search(batches, text, sent.value)

        seen = out.mapInArrow(search, f"{schema}, {found}")
        if number:
            seen = (seen.withColumn("hit_spans", F.concat("hit_spans", "_d_spans"))
                    .withColumn("hit_items", F.concat("hit_items", "_d_items"))
                    .drop("_d_words", "_d_spans", "_d_items"))
        else:
            seen = seen.withColumnsRenamed({
                "_d_words": "n_words", "_d_spans": "hit_spans", "_d_items": "hit_items"})
        out = seen
        if not last:
            out = scratch.stored(seen, "decontaminated")
            sent.unpersist()
    hits = _covered(F.array_sort("hit_spans"))
    return (out.withColumn("n_hit", hits)
            .withColumn("hit_items", F.array_sort(F.array_distinct("hit_items")))
            .withColumn("contaminated",
                        (F.col("n_hit") > 0) & (F.col("n_hit") * one_in >= F.col("n_words"))))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with their own columns only."""
    return only_kept(docs, text, lambda d: mark_contamination(d, benchmark, text),
                     "not contaminated")
