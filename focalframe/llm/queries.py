"""The queries of the training-data operators with their production parameters, and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracles
from .common import table
from .conversation import damaged, repair_conversations
from .decontam import contaminated
from .filter_audit import audit_filters
from .html_extract import extract_main_text
from .langid import identify
from .license_scan import scan_licenses, templates_of
from .line_dedup import dedup_lines
from .mixing import mix_sources
from .ngram_join import ngram_jaccard_join
from .topk import integer_vectors, top_k
from .toxicity import score_toxicity
from .url_filter import judge_urls, split_url
from .warc import archive


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), short_copies=True)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, index = archive(table(spark, sf_dir, "pages"))
    return index.select(F.col("page").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", F.col("date").alias("captured"), "position")


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


def op5_top_k_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = integer_vectors(table(spark, sf_dir, "embeddings"))
    queries = vectors.where(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    return top_k(vectors, queries, k=5)


def page_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, bad): labels of the documents that pages show; the number in a page's path is the document's id."""
    path = split_url("url")[1]
    pages = table(spark, sf_dir, "pages").select("page_id", path.alias("path"))
    shown = pages.select("page_id", F.expr("try_cast(regexp_extract(path, '^/[^/]*/([0-9]+)', 1) AS bigint)").alias("doc_id"))
    bad = F.when((F.col("toxic") == 1) | (F.col("quality") == 0), 1).when((F.col("toxic") == 0) & (F.col("quality") == 1), 0)
    return shown.join(table(spark, sf_dir, "labels").select("doc_id", bad.alias("bad")), "doc_id").select("page_id", "bad")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), page_labels(spark, sf_dir))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(table(spark, sf_dir, "documents"), k=3, percent=90).select("doc_id", "n_shingles", "component_id")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang")).select("doc_id", "held_out", "lang_pred", "score", "ambiguous")


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations that lost all their turns have zeros, an empty audit and the hash of an empty text."""
    conversations = table(spark, sf_dir, "conversations")
    report, _ = repair_conversations(damaged(conversations))
    every = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    out = every.alias("c").join(report.alias("r"), F.col("c.conv_id").eqNullSafe(F.col("r.conv_id")), "left")
    zeros = [F.coalesce(F.col(f"r.{c}"), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("c.conv_id", *zeros, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"), templates_of(spark)).drop("blocks")


QUERIES = {
    f.__name__: f
    for f in (
        op1_line_dedup,
        op2_toxicity,
        op3_warc,
        op4_source_mixing,
        op5_top_k_search,
        op6_url_filter,
        op7_benchmark_decontamination,
        op8_ngram_jaccard_join,
        op9_language_id,
        op10_html_extraction,
        op11_conversation_repair,
        op12_filter_audit,
        op13_license_scan,
    )
}
ORACLES = {"op3_warc": oracles.OP3, "op4_source_mixing": oracles.OP4, "op5_top_k_search": oracles.OP5, "op6_url_filter": oracles.OP6, "op8_ngram_jaccard_join": oracles.OP8, "op11_conversation_repair": oracles.OP11, "op12_filter_audit": oracles.OP12, "op13_license_scan": oracles.OP13}
