import random
import re
import time
import tracemalloc

import pyarrow as pa
import pytest

from jobtide.llm.decontamination import (
    build_index,
    drop_contaminated,
    find_hits,
    mark_contamination,
    word_hashes,
)

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def words_of(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(text, items):
    words = words_of(text)
    hit, names = set(), set()
    for name, item in items:
        other = words_of(item)
        if not other:
            continue
        n = min(13, len(other))
        windows = {tuple(other[i:i + n]) for i in range(len(other) - n + 1)}
        for i in range(len(words) - n + 1):
            if tuple(words[i:i + n]) in windows:
                hit |= set(range(i, i + n))
                names.add(name)
    return (len(words), len(hit), sorted(names),
            len(hit) > 0 and 20 * len(hit) >= len(words))


def seen(row):
    return row.n_words, row.n_hit, list(row.hit_items), row.contaminated


def frames(spark, docs, items):
    return (spark.createDataFrame(docs, "doc_id long, text string, n_words string"),
            spark.createDataFrame(items, "item_id string, text string"))


@pytest.mark.parametrize("block_bytes", [1 << 20, 300])
def test_against_brute_force(spark, block_bytes):
    draw = random.Random(3)
    items = [(str(i), " ".join(draw.choice("a b C d é 7".split()) for _ in range(draw.choice([0, 1, 4, 9, 12, 13, 14, 30]))))
             for i in range(30)]
    docs = []
    for i in range(120):
        parts = []
        for _ in range(draw.randrange(6)):
            parts.append(" ".join(draw.choice("a b c d É 7 x y".split()) for _ in range(draw.randrange(25))))
            source = draw.choice(items)[1].split()
            low = draw.randrange(len(source) + 1)
            parts.append(draw.choice([" ", "\n", ", "]).join(source[low:]))
        docs.append((i, "-".join(parts), "clash"))
    docs += [(500, None, None), (501, "", None), (502, "...", None), docs[3], docs[3]]
    left, right = frames(spark, docs, items)
    marked = mark_contamination(left.drop("n_words"), right, block_bytes=block_bytes).collect()
    assert len(marked) == len(docs)
    for row in marked:
        assert seen(row) == brute(row.text, items), row.text
    assert any(row.contaminated for row in marked)


def test_sample_tables(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    bench = spark.read.parquet(f"{folder}/benchmark.parquet")
    items = [(str(r.item_id), r.text) for r in bench.collect()]
    for row in mark_contamination(docs, bench).collect():
        assert seen(row) == brute(row.text, items)


def test_long_text_and_hits_in_it(spark):
    item = " ".join(f"w{i}" for i in range(40))
    text = "z " * 300_000 + item + " q" * 100_000
    left, right = frames(spark, [(1, text, None)], [("i", item)])
    row = mark_contamination(left.drop("n_words"), right).first()
    assert (row.n_words, row.n_hit, row.contaminated) == (400_040, 40, False)


def test_periodic_texts_and_phrases_of_very_many_items(spark):
    draw = random.Random(4)
    items = [("one", "a " * 200), ("two", "a b " * 40), ("short", "a a"), ("three", "a b c " * 9 + "d")]
    items += [(f"p{i}", f"q{i} answer the question with one of the letters below and say why you chose it")
              for i in range(40)]
    docs = [(0, "a " * 300, None), (1, "a b " * 30 + "a b c " * 20, None), (2, "b " * 50 + "a b c " * 8 + "d e", None),
            (3, "x answer the question with one of the letters below and say why you chose it " * 5, None),
            (4, "a b a", None), *[(5 + i, " ".join(draw.choice("aab") for _ in range(200)), None) for i in range(10)]]
    left, right = frames(spark, docs, items)
    for row in mark_contamination(left.drop("n_words"), right).collect():
        assert seen(row) == brute(row.text, items), row.doc_id


def test_work_is_linear_in_a_text_of_one_word():
    index = build_index([("i", "a " * 1_000)], 13, 5)
    words, counts = word_hashes(pa.array(["a " * 500_000, "b " * 100]))
    tracemalloc.start()
    begin = time.process_time()
    spans, items = find_hits(words, counts, index)
    taken, peak = time.process_time() - begin, tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [s.tolist() for s in spans] == [[0], [0], [500_000]] and [i.tolist() for i in items] == [[0], [0]]
    assert taken < 5 and peak < 500e6


def test_empty_tables(spark):
    left, right = frames(spark, [(1, "a b c", None)], [])
    row = mark_contamination(left.drop("n_words"), right).first()
    assert seen(row) == (3, 0, [], False)
    assert mark_contamination(left.filter("false").drop("n_words"), right).count() == 0


def test_drop_keeps_columns_with_clashing_names(spark):
    item = " ".join(f"w{i}" for i in range(15))
    left, right = frames(spark, [(1, "a b c", "x"), (2, item, "y")], [("i", item)])
    kept = drop_contaminated(left, right)
    assert [tuple(r) for r in kept.collect()] == [(1, "a b c", "x")]
    assert kept.columns == left.columns
