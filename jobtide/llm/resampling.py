"""Importance resampling towards a target distribution over hashed word runs.

Features are runs of consecutive words; a feature's bucket is its CRC-32 modulo the number of
buckets. Bucket counts of the raw documents and of the target texts give each bucket a gain, a
scaled logarithm of how much likelier it is in the target; a document's weight is the sum over
its features. Adding Gumbel noise made from its id and drawing the highest scores samples
without replacement in proportion to the weights.

The texts are read twice, once for the counts and once for the weights, and never shuffled:
tasks send out at most one count per bucket. CRCs are taken from position tables
(:mod:`jobtide.llm.position_crc`). Ranks come from a range sort of narrow rows by (score, id)
with a row number as its last key, so that equal rows can be split between tasks, and from the
sizes of the sorted parts.

Defined results: null and empty texts have no features and weight 0. A null id counts as '' in
the noise and comes last among equal scores. Equal rows are drawn one by one; those that tie in
score, id, features and weight take neighbouring ranks in any order. An empty target, or empty
documents, leave counts at 0. An empty table gives an empty table. Very long texts and words are
hashed in slices of bounded size. Result columns replace columns of the same names.
"""

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobtide.llm import scratch, texts
from jobtide.llm.position_crc import span_crcs
from jobtide.llm.words import word_spans

RESULTS = ["n_words", "n_features", "weight", "score", "rank"]
# Spans hashed at a time.
_SPANS = 1 << 17


def feature_crcs(column: pa.Array, shortest: int = 1, longest: int = 1):
    """Pieces of (row, CRC-32) of the column's word runs, and how many words each row has."""
    data, begins, ends, counts = word_spans(column)
    rows = np.repeat(np.arange(len(counts)), counts)
    if longest > 1:
        data, begins, ends = _joined(data, begins, ends)

    def found() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for n in range(shortest, longest + 1):
            for low in range(0, len(begins) - n + 1, _SPANS):
                first = np.arange(low, min(low + _SPANS, len(begins) - n + 1))
                first = first[rows[first] == rows[first + n - 1]]
                yield rows[first], span_crcs(data, begins[first], ends[first + n - 1])

    return found(), counts


def _joined(data: np.ndarray, begins: np.ndarray, ends: np.ndarray):
    """The words end to end with one space between, and their new places."""
    lengths = ends - begins
    starts = np.cumsum(lengths + 1) - lengths - 1
    out = np.full(int((lengths + 1).sum()), 32, np.uint8)
    inside = np.zeros(len(data) + 1, np.int8)
    inside[begins] += 1
    inside[ends] -= 1
    word_bytes = data[np.cumsum(inside[:-1], dtype=np.int8).astype(bool)]
    keep = np.ones(len(out), bool)
    keep[starts + lengths] = False
    out[keep] = word_bytes
    return out, starts, starts + lengths


def bucket_counts(df: DataFrame, text: str, buckets: int, shortest: int = 1, longest: int = 1) -> DataFrame:
    """``bucket``, ``n``: how many features of all texts fall into each bucket that has any."""

    def count(batches: Iterator[pa.RecordBatch]):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for piece in texts.pieces(batch, text):
                found, _ = feature_crcs(piece.column(text), shortest, longest)
                for _, crcs in found:
                    total += np.bincount(crcs % np.uint32(buckets), minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    mine = df.select(F.col(f"`{text}`"))
    return (mine.mapInArrow(count, "bucket long, n long")
            .groupBy("bucket").agg(F.sum("n").alias("n")))


def bucket_gains(docs: DataFrame, target: DataFrame, text: str = "text", target_text: str = "text",
                 buckets: int = 10_000, shortest: int = 1, longest: int = 1) -> np.ndarray:
    """Each bucket's gain in thousandths; only the counts, one per bucket, reach the driver."""
    raw, wanted = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    for df, column, counts in ((docs, text, raw), (target, target_text, wanted)):
        for r in bucket_counts(df, column, buckets, shortest, longest).collect():
            counts[r.bucket] = r.n
    above, below = float(raw.sum() + buckets), float(wanted.sum() + buckets)
    return np.array([math.floor(1000 * math.log((t + 1.0) * above / ((s + 1.0) * below)))
                     for s, t in zip(raw.tolist(), wanted.tolist(), strict=True)], np.int64)


def gumbel_noise(seed: int | str, key) -> int:
    """Noise in thousandths from the seed and a document's id."""
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    return math.floor(-1000 * math.log(-math.log((int(digest[:8], 16) + 0.5) / 4294967296)))


def score_documents(
    docs: DataFrame, target: DataFrame, text: str = "text", doc_id: str = "doc_id",
    target_text: str = "text", buckets: int = 10_000, shortest: int = 1, longest: int = 1,
    seed: int | str = 2024, keep_text: bool = True,
) -> DataFrame:
    """``docs`` with ``n_words``, ``n_features``, ``weight`` and ``score``."""
    own = docs.drop(*RESULTS)
    gains = bucket_gains(own, target, text, target_text, buckets, shortest, longest)
    kept = [f for f in own.schema if keep_text or f.name != text]

    def score(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for piece in texts.pieces(batch, text):
                found, words = feature_crcs(piece.column(text), shortest, longest)
                features = np.zeros(len(words), np.int64)
                weights = np.zeros(len(words), np.int64)
                for rows, crcs in found:
                    gain = gains[crcs % np.uint32(buckets)]
                    features += np.bincount(rows, minlength=len(words))
                    # rows come in order, so sums of integers over them stay exact
                    first = np.flatnonzero(np.diff(rows, prepend=-1))
                    if len(first):
                        weights[rows[first]] += np.add.reduceat(gain, first)
                noise = [gumbel_noise(seed, key) for key in piece.column(doc_id).to_pylist()]
                columns = [piece.column(f.name) for f in kept]
                results = [words.astype(np.int64), features, weights,
                           weights + np.array(noise, np.int64)]
                yield pa.RecordBatch.from_arrays(
                    [*columns, *map(pa.array, results)],
                    [*[f.name for f in kept], "n_words", "n_features", "weight", "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return own.mapInArrow(
        score, f"{schema}, n_words long, n_features long, weight long, score long")


def draw_highest(scored: DataFrame, doc_id: str = "doc_id", percent: int = 10, min_words: int = 20) -> DataFrame:
    """``scored`` with ``rank`` for the drawn part of the documents of enough words."""
    spark = scored.sparkSession
    # stored, as the range sort reads its input twice and rows need fixed numbers
    rows = scratch.stored(scored.withColumn("_r_row", F.monotonically_increasing_id()), "scored")
    enough = F.col("n_words") >= min_words
    keys = [F.col("score").desc(), F.col(f"`{doc_id}`").asc_nulls_last(), "n_features", "weight", "_r_row"]
    placed = scratch.stored(
        rows.filter(enough).repartitionByRange(*keys).sortWithinPartitions(*keys)
        .withColumn("_r_place", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("_r_place", 33)
    # one row per sorted part
    sizes = sorted((r.part, r.n) for r in placed.groupBy(part.alias("part")).agg(
        F.count("*").alias("n")).collect())
    drawn = percent * sum(n for _, n in sizes) // 100
    before, bases = 0, []
    for number, n in sizes:
        bases.append((number, before))
        before += n
    parts = spark.createDataFrame(bases, "_r_part long, _r_base long")
    place = F.col("_r_base") + F.col("_r_place").bitwiseAND((1 << 33) - 1) + 1
    ranked = (placed.withColumn("_r_part", part).join(F.broadcast(parts), "_r_part")
              .withColumn("rank", F.when(place <= drawn, place)))
    rest = rows.filter(~enough).withColumn("rank", F.lit(None).cast("long"))
    names = [F.col(f"`{c}`") for c in [*scored.columns, "rank"]]
    return ranked.select(*names).unionAll(rest.select(*names))


def resample(
    docs: DataFrame, target: DataFrame, text: str = "text", doc_id: str = "doc_id",
    target_text: str = "text", percent: int = 10, min_words: int = 20, **features,
) -> DataFrame:
    """``docs`` with words, features, weight, score and, for the drawn ones, the rank."""
    scored = score_documents(docs, target, text, doc_id, target_text, **features)
    return draw_highest(scored, doc_id, percent, min_words)
