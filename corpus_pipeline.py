"""Corpus preparation: one call of a training-data operator per stage.

Documents that the quality classifier rejects go; one document of each group of near
duplicates stays (the smallest id); documents that hold benchmark passages go; secrets
are masked in the text, so that no clean document is lost; the rest is packed.

Rows: NULL and empty texts pass every filter that does not reject them (they are no
duplicates and hold neither passages nor secrets); rows with a NULL doc_id are never
taken for duplicates; repeated rows with one doc_id become one; an empty table gives an
empty result; extra columns are carried along until packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinlens.llm import decontaminate, jaccard, packing, quality_knn, secrets
from twinlens.llm.queries import documents, tokenizer
from twinlens.session import durable

BROADCAST_ROWS = 1_000_000  # ids; above it the joins shuffle


def _few(ids: DataFrame) -> DataFrame:
    return F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_knn.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def one_per_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = durable(jaccard.near_duplicates(docs))
    dropped = found.where("component_id <> doc_id").select("doc_id")
    repeated = docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    repeated = durable(repeated)
    kept = docs.join(_few(dropped), "doc_id", "left_anti")
    again = kept.join(_few(repeated), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return kept.join(_few(repeated), "doc_id", "left_anti").unionByName(again.select(*docs.columns)).select(*docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    hit = durable(decontaminate.overlaps(docs, benchmark).select("doc_id").distinct())
    return docs.join(_few(hit), "doc_id", "left_anti").select(*docs.columns)


def masked_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer("word_bpe_49k.json"))


STAGES = [
    ("quality_classifier", good_quality),
    ("ngram_jaccard_join", one_per_group),
    ("benchmark_decontamination", without_benchmark),
    ("secret_scans", masked_secrets),
    ("best_fit_packing", packed),
]
ORACLE_SQL: str | None = None  # learned votes and tokenizers are no SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packing of ``documents`` after all stages; each stage is written and read again."""
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
