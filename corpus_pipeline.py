"""A corpus pipeline of five stages; each stage's rows are written as Parquet and read by the next.

Every stage decides row by row, not by id, so a row with a null or repeated id is kept or dropped for its own text; whole
texts of any length are read; an empty table stays empty; further columns are carried along, whatever their names.

Quality classifier (rejected documents go), exact dedup, SimHash near-dedup (one document of each group stays),
benchmark decontamination, and SentencePiece encoding. Every stage but the last returns the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.llm import decontamination, exact_dedup, quality, sentencepieces, simhash
from tallyline.llm.common import shared_folder, table

#: A document is rejected if it is less likely than this to be good; below 0.5, so that doubt keeps a document.
LEAST_QUALITY = 0.4


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that are scored below LEAST_QUALITY, by a classifier fitted on their labelled rows. A null text
    is scored as an empty one; equal rows have equal scores. Without labels of both classes every document stays."""
    return quality.drop_low_quality(docs, table(spark, sf_dir, "labels"), least=LEAST_QUALITY)


def exact_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with one row of each text, white space aside: the one with the most characters, then the smallest id, a null id
    last. Null and blank texts are equal. Of rows that tie in all this any one stays."""
    return exact_dedup.drop_exact_duplicates(docs)


def simhash_near_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with one row of each group that near fingerprints link, that of the smallest id, a null id last. Texts without
    words, null ones among them, are one group."""
    return simhash.drop_near_duplicates(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those in which a window of the benchmark occurs. A null text has no words and stays; equal rows are
    decided alike; items without words have no window."""
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def sentencepiece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, ids, n_pieces and exact: whether decoding the ids gives the text back. Null and empty texts have
    no pieces; every row of docs has one row."""
    found = docs.select("doc_id", "lang", "source", sentencepieces.encoded(F.col("text"), sentencepieces.shared(spark)).alias("e"))
    return found.select("doc_id", "lang", "source", "e.ids", F.size("e.ids").cast("long").alias("n_pieces"), "e.exact")


STAGES = [
    ("quality classifier", quality_classifier),
    ("exact dedup", exact_deduplication),
    ("SimHash near-dedup", simhash_near_deduplication),
    ("benchmark decontamination", benchmark_decontamination),
    ("SentencePiece encoding", sentencepiece_encoding),
]

#: The classifier and the tokenizer have no SQL form; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over all documents; the stages' Parquet goes to the shared checkpoint folder."""
    folder = f"{shared_folder(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
