"""The corpus pipeline: five stages over `documents`, each written and read again.

Every stage but the last returns the columns of documents; a stage works on all
that its predecessor kept.  Defined cases are those of the operators.  Rows with
a null id link with nothing, so the second stage keeps them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storelens.llm import mixing, ngram_join, packing, pii, quality_rules
from storelens.llm.common import keep, table
from storelens.llm.queries import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.keep_good(docs.select(*COLUMNS))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that of the smallest id."""
    gone = ngram_join.near_duplicates(docs).where("doc_id <> component_id").select(F.col("doc_id").alias("__gone"))
    return docs.select(*COLUMNS).join(keep(gone), F.col("doc_id") == F.col("__gone"), "left_anti")


def mask_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data masked; n_chars is that of the new text."""
    return pii.mask(docs.select("doc_id", "text", "lang", "source")).select(
        "doc_id", "text", "lang", "source", F.char_length("text").cast("long").alias("n_chars"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's rate says, in the shuffled order."""
    return mixing.replicate(docs.select(*COLUMNS)).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, packed into sequences of 1024 ids."""
    return packing.pack(docs, tokenizer_path())


STAGES = [("quality rules", quality), ("n-gram Jaccard join", deduplicate), ("PII", mask_pii), ("mixing", mix), ("packing", pack)]
ORACLE_SQL = None  # tokens and the field's spans are beyond SQL; tests compare with a plain version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = keep(docs)
    return docs
