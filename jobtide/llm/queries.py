"""The registered queries of the operators here, each over its whole table.

Contract digests are made from the operators' own outputs.
"""

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobtide.llm import (
    bpe_codec,
    centroids,
    decontamination,
    html_extract,
    near_dedup,
    packing,
    quality,
    repeats,
    resampling,
    scratch,
    secret_scan,
    token_counts,
    url_filter,
    warc,
)

Query = Callable[[SparkSession, str], DataFrame]

SITE_RULES = [
    url_filter.site_rule("net/", "block"),
    url_filter.site_rule("example.net/en/", "allow"),
    url_filter.site_rule("example.com/de/", "block"),
    url_filter.site_rule("org/fr/", "allow"),
]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    packed = packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    judged = url_filter.filter_urls(pages, [*SITE_RULES, *url_filter.PATTERN_RULES])
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    spans = F.col("secrets")
    base = F.filter(spans, lambda s: s.kind != "random")

    def count(kind):
        return F.size(F.filter(spans, lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")

    return secret_scan.scan_secrets(docs, keep_text=False).select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(secret_scan.span_list(base), 256).alias("base_sha256"),
        secret_scan.span_list(spans).alias("spans"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch.fresh_path(spark, "archives")
    warc.write_archives(warc.plan_records(_table(spark, sf_dir, "pages"), "page_id", "url", "html"), path)
    entries = warc.read_archives(spark, path, keep_payload=False)
    return entries.filter("problem = ''").select(
        F.col("record_id").try_cast("long").alias("page_id"), "payload_bytes", "payload_digest",
        "record_type", F.col("refers_to").try_cast("long").alias("refers_to"))


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = decontamination.mark_contamination(docs, _table(spark, sf_dir, "benchmark"))
    return marked.select(
        "doc_id", "n_words", "n_hit", F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"), "contaminated")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = token_counts.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 512)


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_classes(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_extract.extract_text(pages).select("page_id", "url", "text", "n_chars")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge_quality(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                         "n_repeat_words", "base_failed", "kept")


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return centroids.cluster_vectors(vectors)


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = resampling.score_documents(docs, _table(spark, sf_dir, "benchmark"), keep_text=False)
    return resampling.draw_highest(scored).select("doc_id", "n_features", "weight", "score", "rank")


def op13_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe_codec.round_trip(docs, public_tokenizers.path("word_bpe_49k.json"))
    return coded.select("doc_id", "n_tokens", F.sha2("ids_bytes", 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


def queries() -> dict[str, Query]:
    return {build.__name__: build for build in [
        op1_best_fit_packing, op2_suffix_array_dedup, op3_url_filter, op4_secret_scan, op5_warc,
        op6_benchmark_decontamination, op7_token_counts, op8_near_dedup, op9_html_extraction,
        op10_quality_rules, op11_centroid_clustering, op12_importance_resampling,
        op13_bpe_codec,
    ]}
