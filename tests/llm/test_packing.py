import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from jobtide.llm.packing import Capacity, make_plan, pack_documents

PATH = public_tokenizers.path("word_bpe_49k.json")


def check_plan(lengths, capacity):
    plan = make_plan(lengths, capacity)
    limits = capacity.limits()
    used = defaultdict(list)
    for length, count in lengths.items():
        sequence, offset = plan.places(np.full(count, length), np.arange(count))
        for s, o in zip(sequence.tolist(), offset.tolist(), strict=True):
            used[s].append((o, length))
    assert len(used) == plan.sequences
    for members in used.values():
        members.sort()
        at = 0
        for offset, length in members:
            assert offset == at
            at += length
        sizes = np.array([length for _, length in members])
        assert sizes.sum() <= limits[0] and len(sizes) <= limits[1] and (sizes ** 2).sum() <= limits[2]
    return used


def one_by_one(lengths, capacity):
    """Sequences that plain best fit opens, piece after piece."""
    limits = capacity.limits()
    weights = np.array(capacity.weights) / limits.astype(float) ** 2
    rooms = []
    for length in sorted(Counter(lengths).elements(), reverse=True):
        demand = np.array([length, 1, length * length])
        fits = [r for r in rooms if (r >= demand).all()]
        if not fits:
            rooms.append(limits - demand)
            continue
        if capacity.rule == "norm":
            best = min(fits, key=lambda r: (((r - demand) ** 2) * weights).sum())
        else:
            best = max(fits, key=lambda r: (r * demand * weights).sum())
        best -= demand
    return len(rooms)


@pytest.mark.parametrize("capacity", [
    Capacity(64), Capacity(64, rule="dot"), Capacity(64, documents=3), Capacity(64, attention=1500),
    Capacity(64, documents=4, attention=64 * 64 // 2, rule="dot", weights=(2.0, 0.5, 1.0))])
def test_plans_against_packing_one_by_one(capacity):
    draw = random.Random(1)
    top = int(min(64, capacity.limits()[2] ** 0.5))
    for _ in range(15):
        lengths = Counter(draw.randrange(1, top + 1) for _ in range(draw.randrange(1, 150)))
        used = check_plan(lengths, capacity)
        assert len(used) <= one_by_one(lengths, capacity) + 1
    assert check_plan({}, capacity) == {}


def test_plan_size_does_not_grow_with_the_table():
    small = {n: 4000 - n for n in range(1, 2049)}
    large = {n: c * 10**6 for n, c in small.items()}
    assert len(make_plan(large, Capacity()).length) <= 2 * len(make_plan(small, Capacity()).length) + 5000
    plan = make_plan(large, Capacity())
    total = sum(n * c for n, c in large.items())
    assert plan.sequences <= 1.001 * -(-total // 2048)


def verify(rows, docs, tokens=2048):
    library = Tokenizer.from_file(PATH)
    wanted = Counter()
    for doc_id, text in docs:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        for piece, start in enumerate(range(0, len(ids), tokens)):
            part = ids[start:start + tokens]
            wanted[doc_id, piece, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert wanted == Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for members in sequences.values():
        at = 0
        for offset, length in sorted(members):
            assert offset == at
            at += length
        assert at <= tokens
    return sequences


def test_sample_documents(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = pack_documents(table, PATH).collect()
    sequences = verify(rows, [(r.doc_id, r.text) for r in table.collect()])
    total = sum(r.length for r in rows)
    assert len(sequences) <= 1.02 * total / 2048 + 1


def test_corner_cases(spark):
    docs = [(1, None), (2, ""), (3, "word " * 5000), (4, "a b"), (4, "a b"), (None, "Ünï ΑΣ 漢字 '"),
            (5, "x <|endoftext|> y"), (6, "'s 'S don't 12 ½ ..!'ll"), (7, "\n \t")]
    table = spark.createDataFrame([(*d, 9) for d in docs], "doc_id long, text string, offset int")
    packed = pack_documents(table, PATH, with_ids=True)
    assert packed.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "input_ids",
                              "sequence_id", "offset"]
    rows = packed.collect()
    verify(rows, docs)
    assert all(len(r.input_ids) == r.length for r in rows)
    assert pack_documents(table.filter("false"), PATH).count() == 0
