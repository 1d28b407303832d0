import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from jobtide.llm import near_dedup
from jobtide.llm.near_dedup import components, dart_signature, drop_near_duplicates, near_classes

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def shingles(text):
    words = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4)))


def jaccard(a, b):
    return len(a & b) / len(a | b)


def brute_classes(docs):
    """Class of each place in ``docs``, from all pairs."""
    sets = [shingles(t) for _, t in docs]
    label = list(range(len(docs)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j] and jaccard(sets[i], sets[j]) >= 0.8:
                label[root(i)] = root(j)
    groups = defaultdict(list)
    for i in range(len(docs)):
        groups[root(i)].append(docs[i][0])
    return sorted(sorted(g) for g in groups.values())


def seen_classes(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r.class_id].append(r.doc_id)
    for head, members in groups.items():
        assert head == min(members)
        assert all(r.class_size == len(members) for r in rows if r.class_id == head)
    return sorted(sorted(g) for g in groups.values())


def families(seed, count, words, edits):
    """Texts in families of near copies, each an edit of another of its family."""
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    docs = []
    for _ in range(count):
        base = [draw.choice(vocabulary) for _ in range(draw.randrange(*words))]
        family = [base]
        for _ in range(draw.choice([0, 0, 1, 2, 12])):
            copy = list(draw.choice(family))
            for _ in range(draw.randrange(edits)):
                copy[draw.randrange(len(copy))] = draw.choice(vocabulary)
            family.append(copy)
        docs += [" ".join(f) for f in family]
    draw.shuffle(docs)
    return [(i, t) for i, t in enumerate(docs)]


def test_signature_agreement_is_the_weighted_similarity():
    draw = np.random.default_rng(2)
    elements = draw.integers(0, 2**63, 300, dtype=np.uint64)
    m, n = draw.uniform(0.2, 4, 200), draw.uniform(0.2, 4, 200)
    a, b = elements[:200], elements[60:260]
    both = np.minimum(m[60:], n[:140]).sum()
    expected = both / (m.sum() + n.sum() - both)
    agree = (dart_signature(a, m, 4000) == dart_signature(b, n, 4000)).mean()
    assert abs(agree - expected) < 0.03
    plain = (dart_signature(a, None, 4000) == dart_signature(b, None, 4000)).mean()
    assert abs(plain - 140 / 260) < 0.03
    units = np.ones(200)
    assert (dart_signature(a, units, 500) == dart_signature(a, units, 500)).all()


def test_small_sets_have_whole_signatures():
    one = np.array([5], np.uint64)
    assert len(set(dart_signature(one, None, 160).tolist())) == 160


@pytest.mark.parametrize("tile", [512, 3])
def test_classes_against_all_pairs(spark, monkeypatch, tile):
    monkeypatch.setattr(near_dedup, "TILE", tile)
    docs = families(7, 40, (20, 120), 6)
    table = spark.createDataFrame(docs, "doc_id long, text string")
    assert seen_classes(near_classes(table).collect()) == brute_classes(docs)


def test_corner_cases(spark):
    long = " ".join(f"v{i % 977}" for i in range(200_000))
    docs = [(1, None), (2, ""), (3, " .. "), (4, "one two"), (5, "One, two!"), (6, "one"),
            (7, long), (8, long + " end"), (9, "a b c d e"), (9, "a b c d e"), (10, "x y z w v u")]
    table = spark.createDataFrame([(*d, "s") for d in docs], "doc_id long, text string, class_id string")
    assert seen_classes(near_classes(table).collect()) == [
        [1], [2], [3], [4, 5], [6], [7, 8], [9, 9], [10]]
    kept = drop_near_duplicates(table)
    assert kept.columns == table.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 4, 6, 7, 9, 10]
    nameless = table.withColumn("doc_id", F.lit(None).cast("long"))
    assert drop_near_duplicates(nameless).count() == 8
    assert near_classes(table.filter("false")).count() == 0


def test_components(spark):
    draw = random.Random(4)
    links = [(i, i + 1) for i in range(40)] + [(100 + draw.randrange(60), 100 + draw.randrange(60)) for _ in range(50)]
    labels = {r.node: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    for a, b in links:
        assert labels[a] == labels[b]
    assert {labels[i] for i in range(41)} == {0}
    assert all(label <= node for node, label in labels.items())
