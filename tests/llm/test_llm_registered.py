"""The queries here that SQL can express, against DuckDB over whole tables."""

import os

import duckdb
import pytest

from jobtide.llm import oracles, queries

TESTDATA = os.environ.get("TESTDATA_DIR", "/root/testdata/sf0.001")
SCHEMAS = {
    "op1_best_fit_packing": "doc_id piece start length ids_crc32 sequence_id offset",
    "op2_suffix_array_dedup": "doc_id n_bytes n_removed n_spans kept_sha256",
    "op3_url_filter": "page_id host path rule verdict",
    "op4_secret_scan": "doc_id n_assign n_access n_hex base_sha256 spans",
    "op5_warc": "page_id payload_bytes payload_digest record_type refers_to",
    "op6_benchmark_decontamination": "doc_id n_words n_hit n_items items_sha256 contaminated",
    "op7_token_counts": "doc_id n_bytes n_tokens over_limit",
    "op8_near_dedup": "doc_id class_id class_size",
    "op9_html_extraction": "page_id url text n_chars",
    "op10_quality_rules": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op11_centroid_clustering": "vec_id cluster distance cluster_inertia inertia centroid_sha256",
    "op12_importance_resampling": "doc_id n_features weight score rank",
    "op13_bpe_codec": "doc_id n_tokens ids_sha256 decoded_sha256",
}


def ordered(rows):
    return sorted(rows, key=lambda row: [(v is None, str(v)) for v in row])


@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
def test_query_equals_oracle(spark, name):
    connection = duckdb.connect()
    for table in ("documents", "pages", "benchmark", "embeddings"):
        connection.execute(f"create view {table} as select * from read_parquet('{TESTDATA}/{table}.parquet')")
    result = queries.queries()[name](spark, TESTDATA)
    columns = sorted(result.columns)
    expected = connection.execute(oracles.oracle_sql()[name])
    names = [d[0] for d in expected.description]
    assert sorted(names) == columns
    places = [names.index(c) for c in columns]
    wanted = ordered(tuple(row[i] for i in places) for row in expected.fetchall())
    assert ordered(tuple(row[c] for c in columns) for row in result.collect()) == wanted


@pytest.mark.parametrize("name", sorted(SCHEMAS))
def test_columns_and_rows(spark, name):
    result = queries.queries()[name](spark, TESTDATA)
    assert result.columns == SCHEMAS[name].split()
    table = {"page_id": "pages", "vec_id": "embeddings"}.get(result.columns[0], "documents")
    rows = spark.read.parquet(f"{TESTDATA}/{table}.parquet").count()
    assert result.count() == rows if name != "op1_best_fit_packing" else result.count() >= rows
