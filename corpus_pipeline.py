"""From raw documents to packed training sequences, in five stages.

Quality rules, boilerplate lines, near copies, personal data, packing. Each stage takes
(spark, docs, sf_dir), works on all rows that its predecessor kept, and returns the
columns of docs; the last returns packed pieces. Extra columns of documents pass
through all stages but the last, whatever their names. Stages that pass whole texts to
Python set the session's Arrow batches to 1,000 rows if they are larger.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docflow.llm import lines, neardup, packing, pii, quality
from docflow.llm.common import small_batches, stash, table

#: For this demonstration; a job of its own keeps its own key.
KEY = "docflow-demo-key"

#: Near copies share PERCENT / 100 of their runs of SHINGLE words; op1's own contract has other values.
SHINGLE, PERCENT = 5, 80


def _carried(docs: DataFrame, *needed: str) -> DataFrame:
    """The needed columns, and whole rows as _row, out of the way of an operator's own names."""
    return docs.select(F.struct("*").alias("_row"), *needed)


def _with_text(docs: DataFrame, names: list[str]) -> DataFrame:
    """Rows carried, with the text that an operator has made of theirs."""
    row: Column = F.col("_row").withField("text", F.col("text"))
    if "n_chars" in names:
        row = row.withField("n_chars", F.length("text").cast("long"))
    return docs.select(row.alias("_row")).select("_row.*")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules and whose host is not rejected. Null and empty texts have no words and go."""
    small_batches(spark)
    judged = quality.judge(_carried(docs, "source", "text"), ["_row", "source"])
    return judged.where("kept").select("_row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that their host repeats."""
    return _with_text(lines.drop_boilerplate(_carried(docs, "source", "text")), docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least id of each group of near copies. Null ids belong to no group and stay.

    Of several rows of that id one stays, the one whose columns have the least digest; so it is the same in every run.
    """
    small_batches(spark)
    found = neardup.clusters(docs, n=SHINGLE, percent=PERCENT)
    least = found.where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("_id")).distinct()
    rows = _carried(docs, "doc_id")
    kept = rows.join(least, F.col("doc_id") == F.col("_id"), "left_semi").groupBy("doc_id").agg(F.min_by("_row", F.sha2(F.to_json("_row"), 256)).alias("_row"))
    return kept.select("_row").unionByName(rows.where(F.col("doc_id").isNull()).select("_row")).select("_row.*")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with pseudonyms for personal data."""
    return _with_text(pii.mask(_carried(docs, "text"), KEY), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences: doc_id, start, length, ids, doc_tokens, sequence_id, offset."""
    small_batches(spark)
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near duplicates", near_duplicates),
    ("personal data", personal_data),
    ("packing", pack),
]

#: Near copies, pseudonyms and packing are beyond SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each but the last written to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
