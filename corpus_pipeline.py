"""The corpus pipeline: documents through quality rules, quality classifier, line and near-copy deduplication, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratafit.llm import jaccard_join, line_dedup, packing, quality_classifier, quality_rules
from stratafit.llm.common import dropped, kept, materialise, read
from stratafit.llm.queries import tokenizer_path


def quality_rule_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality rules keep. Null, empty and very short texts go; so do outliers of their source. Repeated rows
    are judged each, null languages and sources are groups of their own, an empty table stays one."""
    return quality_rules.kept_rows(docs)


def quality_classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents at or above the ranker's threshold. It is learned from the labelled ones of all documents, not of those that
    are left; null labels and ids teach nothing. Repeated rows are scored alike, an empty table stays one."""
    ranker = quality_classifier.fit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return quality_classifier.accepted(docs, ranker)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes boilerplate lines out; n_chars, if it is there, becomes the length of what is left where lines went. A line counts once
    for each family of near copies, so that these reach the next stage whole. All rows stay, null and empty texts as they are."""
    rows = line_dedup.deduplicated(docs, near_copies=True)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        rows = rows.withColumn("n_chars", F.when(F.col("__lines.n_dropped") > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return rows.select(*docs.columns)


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest id, nulls last; texts without words are no copies."""
    return jaccard_join.keep_one(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in their sequences. Null texts count as empty, each row is a document of its own."""
    return packing.packed(docs, tokenizer_path("byte_bpe_50k.json"), 1024)


STAGES = [
    ("quality_rules", quality_rule_stage),
    ("quality_classifier", quality_classifier_stage),
    ("line_dedup", line_dedup_stage),
    ("jaccard_join", near_copy_stage),
    ("packing", packing_stage),
]

#: The minimum covariance determinant, the ranker and the tokenizer have no SQL form: tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written and read again; what a stage has written on its way is deleted when it is done, and its result
    when the next one is."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before = docs
        with kept(f"stage-{name}"):
            docs = materialise(stage(spark, before, sf_dir), f"stage-{name}")
        dropped(before)
    return docs
