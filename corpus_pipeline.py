"""A corpus, cleaned and packed: quality, repeated lines, near duplicates, personal data, packing.

Each stage is a function of (spark, docs, sf_dir); its result is written as Parquet and read again as the next
one's docs. All but the last return the columns of docs, whatever their names. An empty table passes through every stage
as an empty one; rows without doc_id go through like all others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lorekeep.llm import bpe, lines, neardup, packing, pii, quality
from lorekeep.llm.common import read, stash

#: No SQL expresses these stages as a whole; the tests hold them against plain Python on small tables.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be bad (score under 0.5) go. A null text is judged as an empty one;
    repeated rows are judged alike, so all of them stay or go; ties in a vote go by the sample's order; without a labelled
    document that may teach, all score 0.5 and stay."""
    voter = quality.train(docs, read(spark, sf_dir, "labels").where(~quality.held_out()).select("doc_id", "quality"))
    return quality.keep(docs, voter)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of repeated three-line windows go; a document that loses all its lines goes with them. Null texts
    and texts of fewer than three lines stay as they are; the first occurrence is that of least doc_id, then text, then
    position; rows equal in doc_id and text share one outcome."""
    return lines.clean(docs)


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates, the document of least doc_id (then text hash) stays, once; one without doc_id only
    where none of the class has one. Texts without words (null ones, too) are one class; of rows equal in doc_id and text
    the one whose columns come first as JSON stays."""
    return neardup.keep_first(docs)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and disclosing terms are replaced in the texts; no row goes. A null text stays null; repeated rows are
    treated alike and count as documents each."""
    return pii.clean(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their place in a sequence. A null or empty text is the single end token; repeated
    rows are packed each; pieces of equal length are interchangeable and take their places by their columns' order."""
    return packing.pack(docs, bpe.tokenizer_path(packing.DEFAULT_TOKENIZER))


STAGES = [
    ("quality_classifier", quality_stage),
    ("line_dedup", line_stage),
    ("minhash_near_dedup", near_dup_stage),
    ("pii", pii_stage),
    ("best_fit_packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir), name)
    return docs
