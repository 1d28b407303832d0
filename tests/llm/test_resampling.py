import hashlib
import math
import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from jobtide.llm.position_crc import BLOCK, span_crcs
from jobtide.llm.resampling import resample

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, rank string, note string"


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def runs(text, longest):
    words = WORD.findall(lowered(text))
    return [" ".join(words[i:i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def brute_force(docs, target, longest=1, buckets=10_000, percent=10, min_words=20):
    """(doc_id, features, weight, score, rank) one by one."""
    def bucket(feature):
        return zlib.crc32(feature.encode()) % buckets

    raw, wanted = [0] * buckets, [0] * buckets
    for texts, counts in (([t for _, t in docs], raw), (target, wanted)):
        for text in texts:
            for feature in runs(text, longest):
                counts[bucket(feature)] += 1
    gain = [math.floor(1000 * math.log((t + 1) * (sum(raw) + buckets) / ((s + 1) * (sum(wanted) + buckets))))
            for s, t in zip(raw, wanted, strict=True)]
    rows = []
    for key, text in docs:
        features = runs(text, longest)
        weight = sum(gain[bucket(f)] for f in features)
        h = int(hashlib.sha256(f"2024:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        noise = math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([key, len(features), weight, weight + noise, None, len(runs(text, 1))])
    enough = sorted((r for r in rows if r[5] >= min_words), key=lambda r: (
        -r[3], r[0] is None, r[0], r[1], r[2]))
    for place, row in enumerate(enough[:percent * len(enough) // 100], 1):
        row[4] = place
    return [tuple(r[:5]) for r in rows]


def ordered(rows):
    return sorted(rows, key=lambda row: [(v is None, v or 0) for v in row])


def check(spark, docs, target, **more):
    table = spark.createDataFrame([(k, t, "old", "n") for k, t in docs], DOCS).repartition(3)
    benchmark = spark.createDataFrame([(t,) for t in target], "text string")
    options = {"longest": more["longest"]} if "longest" in more else {}
    out = resample(table, benchmark, percent=more.get("percent", 10),
                   min_words=more.get("min_words", 20), **options)
    assert out.columns == ["doc_id", "text", "note", "n_words", "n_features", "weight", "score", "rank"]
    seen = [tuple(r) for r in out.select("doc_id", "n_features", "weight", "score", "rank").collect()]
    assert ordered(seen) == ordered(brute_force(docs, target, **more))
    return out


def test_span_crcs_equal_the_library():
    rng = np.random.default_rng(7)
    data = rng.integers(0, 256, 200_000).astype(np.uint8)
    starts = rng.integers(0, 1000, 400)
    ends = starts + np.concatenate([
        np.arange(2 * BLOCK + 2), rng.integers(0, 5000, 400 - 2 * BLOCK - 2)])
    starts, ends = np.append(starts, [0, 77]), np.append(ends, [200_000, 77])
    raw = data.tobytes()
    assert span_crcs(data, starts, ends).tolist() == [
        zlib.crc32(raw[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
    assert span_crcs(data, starts[:0], ends[:0]).tolist() == []


def some_texts(count, seed=3):
    rng = random.Random(seed)
    words = ["the", "Über", "naïve", "x1", "日本", "a" * 70, "B" * 200] + [f"w{i}" for i in range(60)]
    return [rng.choice([" ", "\n", "--"]).join(rng.choices(words, k=rng.randint(0, 60))) for _ in range(count)]


def test_against_one_by_one(spark):
    docs = list(enumerate(some_texts(150)))
    check(spark, docs, some_texts(20, seed=4))
    check(spark, docs, some_texts(20, seed=4), longest=3, percent=33, min_words=5)


def test_odd_rows(spark):
    text = " ".join(f"w{i}" for i in range(30))
    docs = ([(1, None), (2, ""), (3, "..."), (None, text), (None, text + " more"), (4, "z" * 300_000),
             (5, "long word " * 40_000)] + [(7, text)] * 40 + [(8, text)] * 3)
    out = check(spark, docs, ["w1 w2 w3", None, ""], percent=60)
    ranks = [r.rank for r in out.filter("rank is not null").collect()]
    assert sorted(ranks) == list(range(1, len(ranks) + 1))


def test_equal_rows_are_dealt_to_several_parts(spark):
    text = " ".join(f"w{i}" for i in range(30))
    docs = spark.range(0, 20_000, 1, 4).select(F.lit(1).cast("long").alias("doc_id"), F.lit(text).alias("text"))
    out = resample(docs, spark.createDataFrame([("w1",)], "text string"), percent=50)
    ranks = out.filter("rank is not null")
    assert ranks.select("rank").distinct().count() == 10_000 == ranks.agg(F.max("rank")).first()[0]


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    target = spark.createDataFrame([("a b",)], "text string")
    assert resample(none, target).count() == 0
    docs = spark.createDataFrame([(1, "a b c", "", "")], DOCS)
    assert [r.weight for r in resample(docs, target.limit(0)).collect()] == [
        sum(math.floor(1000 * math.log(10_003 / (2 * 10_000))) for _ in range(3))]
