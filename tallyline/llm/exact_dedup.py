"""Exact duplicates by progressive refinement: length, then a hash of the beginning, then a hash of the whole.

Texts are equal when they are identical after their white space (space and \\x09-\\x0D) is deleted.

Defined cases: a null text counts as empty, and empty texts are equal to each other. Rows that repeat a doc_id share
one verdict. A null doc_id sorts after every other. Other columns of the input are neither read nor returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.llm.common import checkpointed, join_counted, keep_one, possibly_in, table, text_key

#: Characters of the normalised text that the second step hashes.
PREFIX_CHARS = 256


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")


def _digest(norm: Column) -> Column:
    return F.unhex(F.sha2(norm, 256))


def _measured(docs: DataFrame, prefix_chars: int) -> DataFrame:
    """doc_id, text_key, cp (code points of the text), norm, len and head (hash of norm's beginning)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text_key().alias("text_key"), F.length(text).alias("cp"), normalised(text).alias("norm"))
    return rows.select("*", F.length("norm").alias("len"), F.xxhash64(F.substring("norm", 1, prefix_chars)).alias("head"))


def _shared(rows: DataFrame, keys: list[str]) -> tuple[DataFrame, int]:
    """The keys that more than one row has, and how many there are; rows are counted before the shuffle."""
    out = checkpointed(rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").drop("n"))
    return out, out.count()


def refined(docs: DataFrame, prefix_chars: int = PREFIX_CHARS) -> tuple[DataFrame, DataFrame, int]:
    """The rows that length and prefix hash don't tell apart, with their full hash, and the keys (len, head) they share.

    Each step reads only what the one before left: lengths of all rows; the prefix hash where a length is shared; the
    full hash, from a new scan, where length and prefix hash are. What is written and shuffled are numbers and, for
    the last rows, digests. Text itself is never grouped or sorted.
    """
    rows = _measured(docs, prefix_chars)
    lengths, n_lengths = _shared(rows.select("len"), ["len"])
    heads, n_heads = _shared(join_counted(rows.select("len", "head"), lengths, ["len"], "left_semi", n_lengths), ["len", "head"])
    near = possibly_in(rows, "head", heads.select("head"), n_heads)  # so that no text is joined, only digests
    left = near.select("doc_id", "text_key", "cp", "len", "head", _digest(F.col("norm")).alias("digest"))
    return checkpointed(join_counted(left, heads, ["len", "head"], "left_semi", n_heads)), heads, n_heads


def exact_groups(docs: DataFrame, prefix_chars: int = PREFIX_CHARS, with_digest: bool = False) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept and, if asked for, digest (binary SHA-256).

    Of equal texts the one with the most code points in its original form stays, then the smallest doc_id. Rows that a
    step of refined() settles are alone in their group; a digest that the caller wants of them is made in the scan that
    returns them. A group of any size is counted before the shuffle, and the join that tells rows their group is one
    whose large partitions adaptive execution splits.
    """
    left, heads, n_heads = refined(docs, prefix_chars)
    best = F.min(F.struct((-F.col("cp")).alias("c"), F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("d")))
    groups = left.groupBy("len", "digest").agg(best.alias("best"), F.count("*").alias("group_size"))
    groups = checkpointed(groups.select("len", "digest", F.col("best.d").alias("keep_id"), "group_size"))
    members = join_counted(left, groups, ["len", "digest"], "inner")
    alone = _measured(docs, prefix_chars).select("doc_id", "len", "head", _digest(F.col("norm")).alias("digest"))
    alone = join_counted(alone, heads, ["len", "head"], "left_anti", n_heads).withColumn("keep_id", F.col("doc_id")).withColumn("group_size", F.lit(1).cast("long"))
    out = ["doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), *(["digest"] if with_digest else [])]
    return alone.select(*out).unionByName(members.select(*out))


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """docs with one row of each text, the one that exact_groups keeps; all columns remain.

    Null and blank texts are equal to each other, so one of them stays. Of rows that repeat doc_id and text one stays,
    also with a null doc_id; a doc_id with two texts is decided for each of them. An empty table stays empty.
    """
    left, _, _ = refined(docs)
    return keep_one(docs, left.select("doc_id", "text_key", F.col("digest").alias("group"), (-F.col("cp")).alias("order")))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_groups(table(spark, sf_dir, "documents"), with_digest=True)
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


QUERIES = {"op3_exact_dedup": op3_exact_dedup}

ORACLE_SQL = {
    "op3_exact_dedup": r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS cp, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm FROM documents),
r AS (SELECT doc_id, norm, row_number() OVER (PARTITION BY norm ORDER BY cp DESC, doc_id) AS k, count(*) OVER (PARTITION BY norm) AS group_size FROM t),
g AS (SELECT norm, doc_id AS keep_id FROM r WHERE k = 1)
SELECT r.doc_id, g.keep_id, r.group_size, r.doc_id = g.keep_id AS kept, sha256(r.norm) AS text_sha256
FROM r JOIN g ON r.norm = g.norm"""
}
