"""From raw documents to packed sequences: quality, exact copies, near copies, benchmark passages, packing.

Every stage but the last returns rows of its input with the columns of documents, whatever else a table holds; null in
any column but doc_id and text passes through. Null and empty texts are documents of length 0. An empty table gives an
empty result. Rows that repeat a doc_id stay or go as each stage says. Rows without doc_id are scored by the first stage
and left out by the second, as they can't be named.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from terrapix.llm.common import release, stored
from terrapix.llm.decontaminate import decontaminate
from terrapix.llm.exact_dedup import exact_dedup
from terrapix.llm.near_dedup import near_dedup
from terrapix.llm.packing import pack
from terrapix.llm.quality import keep_good

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the labelled ones, predicts as good; the others go.

    Labels that are null or neither 0 nor 1 don't count; of several for one document the largest does. Without labels
    of both classes all documents stay, and a score of just 0.5 stays. Repeated rows stay or go alike, by their text.
    """
    return keep_good(docs.select(COLUMNS), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the smallest doc_id stays.

    Null and empty texts are equal. Rows that repeat a doc_id stay where one of them stays, so rows that repeat both id
    and text stay together.
    """
    return docs.select(COLUMNS).join(exact_dedup(docs).where("kept").select("doc_id"), "doc_id", "left_semi")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by five-word shingles at similarity 0.8 or more, the smallest doc_id stays.

    Texts without words are linked with nothing and stay; a text of fewer words is one shingle. Rows that repeat a
    doc_id stay where one of them stays.
    """
    return docs.select(COLUMNS).join(near_dedup(docs).where("kept").select("doc_id"), "doc_id", "left_semi")


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark; those that hold ten of an item's words in a row go.

    A shorter item goes as a whole; items without words or id find nothing, and an empty benchmark keeps all. Rows that
    repeat a doc_id go where one of them goes.
    """
    hits = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return docs.select(COLUMNS).join(hits.where("n_hit > 0").select("doc_id"), "doc_id", "left_anti")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All that is left, as pieces of sequences; texts without tokens are the end's id alone, repeated rows packed each."""
    return pack(docs)


STAGES = [("quality", quality), ("exact_dedup", exact), ("near_dedup", near), ("decontaminate", clean), ("packing", packing)]

#: SQL can't express the classifier, the tokens or the packing; tests/llm/test_pipeline.py checks every stage by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; each but the last is written and read again, then deleted."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        release(*last)
        last = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
