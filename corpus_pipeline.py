"""From raw documents to a training mix, in five stages.

Every stage reads what the one before it has kept, as a table; its decisions take effect:

* quality: documents that the weakly supervised scorer rejects go;
* near_duplicates: of each component of five-word shingle sets with a Jaccard similarity of 0.8 or more, the document with the
  smallest id stays;
* decontamination: documents that hold most of a benchmark item, in one piece or in parts, go;
* secrets: every base span and every live-looking owned span is masked; all documents stay;
* mixing: sources are weighted; the result has, per document, how often the mix takes it and how many words that makes.

All but the last return the columns of documents, whatever columns it has besides. Very long texts pass through every stage whole. Nulls, empty and very short texts can't be
judged and stay; of rows that repeat id and text one stays; of texts that tie as copies the one with the smallest id stays; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pairloom.llm import decontaminate, jaccard, mixing, quality, secrets
from pairloom.llm.store import forget, staged


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.filter_documents(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.deduplicate(docs, k=5, num=8, den=10)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secrets_stage),
    ("mixing", mixing_stage),
]

#: Not expressible: training, components and tiling are iterative; tests hold each stage against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for ``documents``. A stage's table goes when the next one's is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
        if before is not None:
            forget(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
