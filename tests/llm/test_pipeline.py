import re
from collections import Counter

import corpus_pipeline
from test_decontamination import brute as contamination
from test_near_dedup import brute_classes
from test_packing import verify
from test_secret_scan import brute as base_secrets

FOLDER = "/root/testdata/sf0.001"


def base_failed(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {i + d for i in range(len(words) - 2) if grams[tuple(words[i:i + 3])] > 1 for d in range(3)}
    return len(words) < 50 or 100 * len(covered) > 50 * len(words)


def run_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, results = docs.columns, [docs.collect()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, FOLDER)
        assert docs.columns == columns
        results.append(docs.collect())
    return results


def test_stages_against_brute_force(spark):
    raw, good, single, clean, bare = run_stages(spark)
    assert not any(base_failed(r.text) for r in good)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    kept = {r.doc_id for r in good}
    for r in raw:
        if labels.get(r.doc_id) == 1 and not base_failed(r.text):
            assert r.doc_id in kept
        if labels.get(r.doc_id) == 0:
            assert r.doc_id not in kept
    classes = brute_classes([(r.doc_id, r.text) for r in good])
    assert sorted(r.doc_id for r in single) == sorted(c[0] for c in classes)
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    assert {r.doc_id for r in clean} == {r.doc_id for r in single if not contamination(r.text, items)[3]}
    assert len(clean) < len(single) < len(good) < len(raw)
    texts = {r.doc_id: r.text for r in clean}
    assert {r.doc_id for r in bare} == set(texts)
    for r in bare:
        assert not base_secrets(r.text)
        if r.text != texts[r.doc_id]:
            assert "[secret]" in r.text
        else:
            assert not base_secrets(texts[r.doc_id])


def test_run_packs_what_the_stages_keep(spark):
    bare = run_stages(spark)[-1]
    rows = corpus_pipeline.run(spark, FOLDER).collect()
    verify(rows, [(r.doc_id, r.text) for r in bare])


def test_registered(spark):
    import __spark_entry__ as contract

    names = [n for n in contract.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert contract.queries()["pipeline"] is corpus_pipeline.run
    assert "pipeline" not in contract.oracle_sql()


def odd_documents(spark):
    prose = " ".join(f"word{i}" for i in range(80)) + "."
    other = " ".join(f"other{i}" for i in range(80)) + " token = \"abcdefgh12345\"."
    rows = [(1, prose, "en", None, 5, "x", 7, "a"), (None, None, None, None, None, None, None, None),
            (2, "", "en", "s", 0, "y", 1, "b"), (3, prose, "en", "s", 5, "z", 2, "c"),
            (3, prose, "en", "s", 5, "z", 2, "c"), (4, other, "en", "s", 5, "w", 3, "d"), (None, other + " end.", "", "", 1, "", 1, "")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, "
                                       "kept string, n_words int, secrets string")


def test_stages_take_odd_rows_and_names(spark):
    docs = odd_documents(spark)
    counts = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, FOLDER)
        assert out.columns == docs.columns
        rows = out.collect()
        counts[name] = len(rows)
        assert stage(spark, docs.filter("false"), FOLDER).count() == 0
        for row in rows:
            assert (row.kept, row.n_words) in {("x", 7), (None, None), ("y", 1), ("z", 2), ("w", 3), ("", 1)}
    assert counts == {"quality rules": 5, "near duplicates": 4, "benchmark decontamination": 7, "secret scans": 7}
    pack = corpus_pipeline.STAGES[-1][1]
    packed = pack(spark, docs, FOLDER)
    assert packed.count() == 7 and packed.columns[0] == "doc_id"
    assert pack(spark, docs.filter("false"), FOLDER).count() == 0
