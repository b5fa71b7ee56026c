"""Corpus pipeline: toxicity, line dedup, near-dedup, pseudonyms and packing, each stage written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telemill.llm import lines, minhash, packing, pii, toxicity
from telemill.llm.queries import PSEUDONYM_KEY
from telemill.llm.shared import BROADCAST_IDS, numbered
from telemill.plans.storage import store

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """The columns of documents, n_chars counted anew."""
    return docs.withColumn("n_chars", F.char_length(text).cast("long")).select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels that are not held out, does not call toxic."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels.filter(~toxicity.held_out()))
    return _documents(toxicity.without_toxic(docs, model))


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the boilerplate lines of their source."""
    return _documents(lines.drop_boilerplate(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near duplicates: that of smallest doc_id, nulls last, and of rows that share it one.

    Rows are told apart by numbers of their own, not by doc_id: rows that share a doc_id, or have none, go only if they
    are near copies. Rows without words are copies of nothing, so each stays.
    """
    rows = numbered(docs, *COLUMNS)
    gone = store(minhash.row_classes(rows).filter("NOT kept").select("row"), "gone")
    return _documents(rows.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, "row", "left_anti"))


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with pseudonyms in place of personal data."""
    return _documents(pii.pseudonymise(docs, PSEUDONYM_KEY))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document in a sequence of packing.CAPACITY words."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_boilerplate),
    ("near_dedup", drop_near_duplicates),
    ("pii", hide_personal_data),
    ("packing", pack),
]

#: No SQL: the classifier, the similarity join and the packing are not expressible.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), name)
    return docs
