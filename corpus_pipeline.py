"""The corpus pipeline: quality rules, line dedup, near-duplicate join, substring dedup, packing.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes as
Parquet in the shared folder and reads again as the next one's documents. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shopledger.llm.common import read_table
from shopledger.llm.jaccard_join import without_near_duplicates
from shopledger.llm.line_dedup import dedup_lines
from shopledger.llm.packing import pack_documents
from shopledger.llm.quality_rules import kept_documents
from shopledger.llm.substring_dedup import dedup_substrings
from shopledger.session import through_table

#: Near duplicates: five-word shingles, a similarity of 0.8 or more.
NEAR_WORDS, NEAR_PERCENT = 5, 80
#: Repeated line runs of any length, so a line that recurs between differing neighbours goes too.
LEAST_LINES = 1


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go; each row is judged by its own text, whatever its id."""
    return kept_documents(docs, read_table(spark, sf_dir, "labels"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated lines and line runs, from one line up, are deleted from the texts."""
    return dedup_lines(docs, min_lines=LEAST_LINES)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays; rows that repeat id and text become one."""
    return without_near_duplicates(docs, words=NEAR_WORDS, percent=NEAR_PERCENT)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Word windows that also start earlier are cut out of the texts."""
    return dedup_substrings(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1,024 tokens with their sequence and offset."""
    return pack_documents(docs)


STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("near_duplicates", near_duplicate_stage),
    ("substring_dedup", substring_stage),
    ("best_fit_packing", packing_stage),
]

#: Scores and packing have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = through_table(docs, name)
    return docs
