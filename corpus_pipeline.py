"""Training-corpus pipeline over ``documents``: five stages, each written as Parquet and read again by the next.

1. quality_classifier: documents that it rejects go;
2. ngram_jaccard_join: of each group of near duplicates (5-word shingles, similarity 0.8 or more) the smallest id stays;
3. substring_dedup: word spans of 30 words or more that stand earlier in the corpus are cut out; a document of which
   nothing is left goes;
4. benchmark_decontamination: documents that hold a 10-word window of a benchmark item go;
5. byte_level_bpe: token ids of what is left, with the decoded text's digest.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from pagelens.llm import bpe, common, decontaminate, ngram_join, quality, substring_dedup

SPAN_WORDS = 30

#: Training, seating and components can't be written in SQL; tests/llm holds run() against brute force.
ORACLE_SQL = None


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.release(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.classify(docs, labels).where(~F.col("rejected")).select("row.*")


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.release(spark)
    # repeated rows of one id stay together: a row goes when its component has a smaller id
    gone = ngram_join.ngram_jaccard_join(docs, size=5, percent=80).where("not kept").select(F.col("doc_id").alias("gone_id")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["gone_id"], "left_anti")


def substring_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.release(spark)
    names = docs.columns
    cut = substring_dedup.substring_dedup(docs, length=SPAN_WORDS, carry=names)
    cut = cut.where("n_removed = 0 or n_removed < n_words")
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("row.text"))
    size = F.when(F.col("n_removed") > 0, F.length("kept")).otherwise(F.col("row.n_chars")) if "n_chars" in names else None
    return cut.select(*[text.alias(c) if c == "text" else size.cast("long").alias(c) if c == "n_chars" else F.col(f"row.{c}").alias(c) for c in names])


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.release(spark)
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def byte_level_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.release(spark)
    out = bpe.bpe_roundtrip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_classifier),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("substring_dedup", substring_removal),
    ("benchmark_decontamination", benchmark_decontamination),
    ("byte_level_bpe", byte_level_bpe),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of the documents that pass all stages."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    outputs = []
    for name, stage in STAGES:
        path = f"{common.shared_dir(spark).rstrip('/')}/pipeline/{name}-{common.uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        for old in outputs:  # the stage that read it is written
            common.delete(spark, old)
        outputs = [path]
        docs = spark.read.parquet(path)
    common._TABLES.append((spark, outputs[0]))
    return docs
