"""A corpus pipeline: quality classifier, host rules, near-duplicate join, best-fit packing.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the
last return the columns of ``documents``, and any further ones, whatever they are called. ``run``
writes each stage's result as Parquet in the folder that the executors share and reads it again
for the next; the folders go when the driver's process ends. Python gets texts in Arrow batches,
whose bytes Spark bounds (``spark.sql.execution.arrow.maxBytesPerBatch``).

Null texts count as empty ones and, like these, fail the classifier or the base rules. Rows with
a null id are judged like others; the join keeps one of a class that has no id. Repeated rows and
ties: the classifier and the rules decide by text and host alone, the join keeps one row of equal
ones. Very long texts are read whole. An empty table gives an empty one in every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from framesift.llm import host_rules, jaccard_join, packing, rule_ensemble
from framesift.llm.common import id_split, shared_folder, table

#: Score below which the classifier rejects a document.
QUALITY = 0.7


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least QUALITY; learns from labelled ones of the learning split."""
    model = rule_ensemble.fit(docs, table(spark, sf_dir, "labels"), id_split("doc_id", 4) != 2)
    return rule_ensemble.filter_documents(docs, model, QUALITY)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and their host's verdict keep; a null host is a host of its own name."""
    return host_rules.filter_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group linked by five-word shingles at a similarity of 0.8; those without words stay."""
    return jaccard_join.keep_first(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of at most 4096 tokens; a null text is its end token alone."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("best_fit_packing", best_fit_packing),
]

#: SQL can express neither the fitted classifier nor the search for good bins.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over ``documents``; returns the last one's rows."""
    docs, folder = table(spark, sf_dir, "documents"), shared_folder(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
