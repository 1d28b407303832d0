import hashlib
import random

import numpy as np
import pytest

from jobtide.llm import repeats, texts
from jobtide.llm.repeats import remove_repeats


def brute(docs):
    """(bytes, removed, spans, digest) per row of (id, text), by a dictionary of all strings."""
    first = {}
    for doc_id, text in docs:
        data = (text or "").encode()
        key = -(1 << 63) if doc_id is None else doc_id
        for i in range(len(data) - 99):
            place = (key, i)
            string = data[i:i + 100]
            if string not in first or place < first[string]:
                first[string] = place
    out = []
    for doc_id, text in docs:
        data = (text or "").encode()
        key = -(1 << 63) if doc_id is None else doc_id
        gone = bytearray(len(data))
        for i in range(len(data) - 99):
            if first[data[i:i + 100]] < (key, i):
                gone[i:i + 100] = b"\x01" * 100
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((doc_id, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def seen(rows):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows), key=str)


def corpus(seed, count=60):
    draw = random.Random(seed)
    letters = "abcdefé \n"

    def some(low, high):
        return "".join(draw.choice(letters) for _ in range(draw.randrange(low, high)))

    passages = [some(60, 500) for _ in range(8)]
    docs = []
    for i in range(count):
        parts = []
        for _ in range(draw.randrange(4)):
            parts.append(some(0, 200))
            passage = draw.choice(passages)
            low = draw.randrange(len(passage))
            parts.append(draw.choice([passage, passage, passage[low:], passage[:low]]))
        docs.append((draw.randrange(1000) * 100 + i, "".join(parts)))
    docs += [(50, "a" * 1000), (51, "ab" * 400), (52, "x" + "ab" * 300), (53, "z" * 99), (54, "z" * 100),
             (55, "z" * 100), (56, ""), (57, None), (None, passages[0]), (None, "b" + passages[0])]
    docs += [docs[3], docs[3], (docs[4][0], "other " + (docs[5][1] or ""))]
    return docs


@pytest.mark.parametrize("part", [4096, 3])
def test_against_brute_force(spark, monkeypatch, part):
    monkeypatch.setattr(repeats, "PART", part)
    docs = corpus(part)
    table = spark.createDataFrame(docs, "doc_id long, text string")
    result = remove_repeats(table)
    assert result.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert seen(result.collect()) == brute(docs)


def test_long_texts_are_cut_into_segments(spark):
    draw = random.Random(1)
    long = "".join(draw.choice("abcdefgh ") for _ in range(2 * texts.PIECE_BYTES + 500))
    shared = long[repeats.SEGMENT - 150:repeats.SEGMENT + 150]
    docs = [(2, long), (3, "x" * 40 + shared + "y" * 40), (1, "q" + long[100_000:100_400])]
    rows = {r.doc_id: r for r in remove_repeats(spark.createDataFrame(docs, "doc_id long, text string"),
                                                with_text=True).collect()}
    assert (rows[3].n_removed, rows[3].n_spans) == (300, 1)
    assert bytes(rows[3].kept) == b"x" * 40 + b"y" * 40
    assert (rows[2].n_removed, rows[1].n_removed) == (400, 0)


def test_sample_documents(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs = [(r.doc_id, r.text) for r in table.collect()]
    result = remove_repeats(table)
    assert seen(result.collect()) == brute(docs)
    assert result.columns[1:4] == ["lang", "source", "n_chars"]


def test_empty_table_and_clashing_names(spark):
    table = spark.createDataFrame([(1, "a" * 150, 7, "m", "d")],
                                  "doc_id int, text string, n_removed int, marks string, doc string")
    row = remove_repeats(table).first()
    assert (row.n_removed, row.marks, row.doc) == (149, "m", "d")
    assert remove_repeats(table.filter("false")).count() == 0


def test_many_rows_of_one_id(spark):
    draw = random.Random(7)

    def some(count):
        return "".join(draw.choice("abcdefgh ") for _ in range(count))

    head, passage = some(130), some(260)
    docs = [(None, head + some(150)) for _ in range(150)]  # the same start of different texts
    docs += [(None, some(40) + passage[i % 50:] + some(30)) for i in range(150)]
    docs += [(9, passage + "same")] * 40 + [(9, "x" + passage)] * 3 + [(11, "y" * 30 + head)] * 5
    draw.shuffle(docs)
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert seen(remove_repeats(table).collect()) == brute(docs)


def test_a_hundred_thousand_rows_of_no_id(spark):
    table = spark.range(100_000).selectExpr(
        "cast(null as long) doc_id",
        "if(id % 2 = 0, repeat('shared passage ', 12), concat(id, repeat(' and so on', 12))) text")
    found = remove_repeats(table).groupBy("n_bytes", "n_removed").count().collect()
    # equal rows are one place; periodic texts repeat themselves
    assert {r.n_removed for r in found if r.n_bytes == 180} == {165}
    assert sum(r["count"] for r in found) == 100_000


def test_tasks_remember_phrases_from_batch_to_batch():
    passage = np.frombuffer(random.Random(3).randbytes(400), np.uint8)
    seen_here = repeats._Seen()

    def sent(doc):
        _, trigger, phrase, start, size = repeats.phrases(passage, np.array([0]), np.array([400]))
        ids, keys = np.full(len(size), doc), np.full(len(size), 5)
        return seen_here(trigger, phrase, size, ids, start, keys)[2]

    assert (sent(7) > 0).all()
    assert (sent(8) < 0).all()
    assert (sent(3) > 0).all()  # earlier than all before
    assert (sent(7) < 0).all()
