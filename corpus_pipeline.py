"""A corpus clean-up in five stages: quality rules, quality classifier, SimHash near-duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) with docs of the columns of `documents`, works on all of docs and returns the documents that
it keeps, with the same columns; the last returns the packed pieces. run() writes each stage's result as Parquet in the
shared folder and reads it back for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prosodia.llm import compression_classifier, packing, quality_rules, similar_sets, suffix_dedup
from prosodia.llm.common import discard, publish, unused


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the learnt fences keep."""
    # a row's own columns stand apart, whatever their names
    own = "_own"
    rows = docs.select(F.struct(*docs.columns).alias(own), "text", "lang", "source")
    return quality_rules.apply_quality_rules(rows).where("kept").select(f"{own}.*")


def classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose calibrated score is at least the classifier's cut. The model is learnt from the labelled rows of the
    unfiltered table: what the rules have taken away is what bad text looks like."""
    model = compression_classifier.learn(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = unused("_score", docs.columns)
    return compression_classifier.with_score(docs, model, out=score).where(F.col(score) >= compression_classifier.CUT).select(docs.columns)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by Jaccard similarity of 5-word shingles >= 0.8, the one of least id; of rows that repeat that id, one."""
    return similar_sets.keep_one(docs)


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages that an earlier document (or place) has; those with no word left go."""
    return suffix_dedup.deduplicate(docs, mode="later", min_len=PASSAGE).where(F.length(F.translate("text", " \t\n\x0b\x0c\r", "")) > 0).select(docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed."""
    return packing.best_fit_packing(docs)


#: Bytes of the shortest passage that stage 4 cuts: fewer than fifty words take.
PASSAGE = 240

STAGES = [
    ("quality_rules", quality_rules_stage),
    ("quality_classifier", classifier_stage),
    ("simhash_near_dedup", near_duplicates_stage),
    ("suffix_array_dedup", repeats_stage),
    ("best_fit_packing", packing_stage),
]
#: SQL has no zstandard and no tokenizer; tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, done = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        docs = publish(stage(spark, docs, sf_dir), name)
        if done:
            discard(done.pop())
        done.append(docs)
    return STAGES[-1][1](spark, docs, sf_dir)
