"""A corpus pipeline of five stages over ``documents``: each takes the documents that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from focalframe.llm.common import BROADCAST_IDS, here, release, table, written
from focalframe.llm.decontam import decontaminate
from focalframe.llm.langid import identify
from focalframe.llm.line_dedup import dedup_lines
from focalframe.llm.mixing import mix_sources
from focalframe.llm.ngram_join import ngram_jaccard_join


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter and those whose language stays ambiguous; nothing else changes."""
    named = identify(docs).where((F.col("lang_pred") != "und") & ~F.col("ambiguous"))
    return named.select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated lines out; a document goes when nothing but white space is left of it."""
    left = dedup_lines(docs, short_copies=True)
    return left.where((F.col("n_removed") == 0) | F.col("text").rlike(r"\S")).select(*docs.columns)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near duplicates the document of the smallest id; of rows with equal id and text one stays."""
    before = here()
    joined = written(ngram_jaccard_join(docs, k=5, percent=80), "joined")
    extra = written(joined.where("component_id <> doc_id").select("doc_id").distinct(), "extra")
    few = extra.count() <= BROADCAST_IDS
    kept = docs.join(F.broadcast(extra) if few else extra, "doc_id", "left_anti").select(*docs.columns)
    repeated = written(joined.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 and doc_id is not null").select("doc_id"), "repeated")
    release(before, extra, repeated)
    n = repeated.count()
    if not n:
        return kept
    side = F.broadcast(repeated) if n <= BROADCAST_IDS else repeated
    once = kept.join(side, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]).select(*docs.columns)
    return kept.join(side, "doc_id", "left_anti").select(*docs.columns).unionByName(once)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that contain a benchmark item."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix of the sources takes."""
    return mix_sources(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("ngram_join", ngram_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mixing", source_mixing),
]

#: No SQL: language ID, SimHash candidates and edit similarity have none; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; between stages a table is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES = {"pipeline": ORACLE_SQL}
