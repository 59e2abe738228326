"""Small helpers shared by the text operators."""

from __future__ import annotations

import tempfile

import numpy as np

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of ids or keys that may be broadcast after they were counted; beyond it the join shuffles.
MAX_BROADCAST_ROWS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the cluster's shared checkpoint folder and read back: cuts lineage, survives lost executors."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where none is set, a temporary folder, but only if all tasks run on this machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that every node sees")
    return tempfile.mkdtemp(prefix="checkpoint-")


def join_counted(left: DataFrame, right: DataFrame, on: list[str] | Column, how: str, rows: int | None = None) -> DataFrame:
    """Join with a right side that is broadcast only if its counted rows are few; otherwise Spark shuffles.

    right should be cheap to count (checkpointed). Its rows hold a few numbers or one digest each.
    """
    rows = right.count() if rows is None else rows
    return left.join(F.broadcast(right) if rows <= MAX_BROADCAST_ROWS else right.hint("merge"), on, how)


#: Bits of the table by which possibly_in tells keys apart: for each key, and at most (8 or 16 MB).
BITS_A_KEY, MOST_BITS = 32, 1 << 27


def possibly_in(df: DataFrame, key: str, keys: DataFrame, n: int | None = None) -> DataFrame:
    """df's rows whose key occurs in `keys` (a column of that name), and by chance a few others: a join can follow.

    The keys set bits of a table that every task gets. Its size is bounded, so with very many keys it passes more of
    the others, never fewer of those that occur.
    """
    n = keys.count() if n is None else n
    bits = min(MOST_BITS, 1 << max(12, (BITS_A_KEY * n - 1).bit_length()))
    place = F.pmod(F.xxhash64(key), F.lit(bits))
    marked = keys.select(F.shiftright(place, 6).alias("word"), F.expr("1L").alias("one"), place.bitwiseAND(63).cast("int").alias("bit"))
    words = marked.select("word", F.expr("shiftleft(one, bit)").alias("bits")).unionByName(df.sparkSession.range(bits >> 6).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("bits")))
    words = words.groupBy("word").agg(F.bit_or("bits").alias("bits"))
    # every word occurs, so a word's place in the sorted array is its number
    table = words.agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "bits"))), lambda w: w["bits"])).scalar()
    word = F.get(table, F.shiftright(place, 6).cast("int"))
    return df.where(F.call_function("shiftrightunsigned", word, place.bitwiseAND(63).cast("int")).bitwiseAND(1) == 1)


def text_key() -> Column:
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def keep_one(docs: DataFrame, ranked: DataFrame) -> DataFrame:
    """docs with exactly one row of each group; all columns remain.

    ranked has a row for each of docs: doc_id, text_key, group, and order, the least of which stays.
    Of rows that repeat both id and text any one stays, so only such rows are ever grouped with their text.
    """
    ranked = checkpointed(ranked)
    order = F.struct("order", F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("d"), F.col("text_key").alias("k"))
    best = checkpointed(ranked.groupBy("group").agg(F.min(order).alias("best"), F.count("*").alias("n")).where("n > 1"))
    many = join_counted(ranked, best, ["group"], "inner").groupBy(F.col("doc_id").alias("_gone_doc"), F.col("text_key").alias("_gone_key"))
    stays = F.col("doc_id").eqNullSafe(F.col("best.d")) & (F.col("text_key") == F.col("best.k"))
    marks = checkpointed(many.agg(F.first(stays).alias("_stays"), F.count("*").alias("_n")).where("NOT _stays OR _n > 1").drop("_n"))
    keyed = docs.withColumn("_row_key", text_key())
    on = keyed["doc_id"].eqNullSafe(marks["_gone_doc"]) & (keyed["_row_key"] == marks["_gone_key"])
    once = join_counted(keyed, marks, on, "left_anti").select(docs.columns)
    again = marks.where("_stays")
    if not again.count():
        return once
    repeated = join_counted(keyed, again, on, "left_semi").dropDuplicates(["doc_id", "_row_key"])
    return once.unionByName(repeated.select(docs.columns))


def crc_of_id(column: str = "doc_id") -> Column:
    """crc32 of the id as text, which deals rows into folds; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")))


def bounded_sample(df: DataFrame, key: str, rows: int, total: int) -> DataFrame:
    """At most `rows` of df's `total` rows, chosen by the hash of a key.

    Only rows whose hash falls in the share that is needed, and half as much again, leave their tasks; of these the
    smallest hashes stay. What is gathered is bounded by `rows`, however many tasks there are.
    """
    parts = 1 << 30
    share = parts if total <= 2 * rows else int(1.5 * parts * rows / total) + 1
    near = df if share >= parts else df.where(F.pmod(F.xxhash64(key), F.lit(parts)) < share)
    return near.orderBy(F.xxhash64(key), key).limit(rows)


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, may_learn: Column, rows_a_class: int) -> DataFrame:
    """(doc_id, label, text): at most rows_a_class labelled documents of each class, chosen by the hashes of their ids.

    Classes are 0 and 1. The ids are chosen without the texts; their number bounds the broadcast and the result. A
    null label or id, and ids that are labelled with both classes, are left out. Of an id's several texts the one that
    sorts first counts; a null one counts as empty.
    """
    known = labels.where(F.col(column).isin(0, 1) & F.col("doc_id").isNotNull() & may_learn).groupBy("doc_id").agg(F.min(column).alias("label"), F.max(column).alias("other"))
    known = known.where("label = other").select("doc_id", "label")
    sizes = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    chosen = [bounded_sample(known.where(F.col("label") == k), "doc_id", rows_a_class, sizes.get(k, 0)) for k in (0, 1)]
    chosen = checkpointed(chosen[0].unionByName(chosen[1]))
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    return texts.groupBy("doc_id", "label").agg(F.min("text").alias("text"))


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def platt(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 50) -> tuple[float, float]:
    """(a, b) of the logistic curve sigmoid(a x + b), each class with half the weight; x may have any scale."""
    scale = float(np.std(x)) or 1.0
    f = np.stack([x / scale, np.ones_like(x)], axis=1)
    w = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    t, c = np.where(y == 1, 0.999, 0.001), np.zeros(2)
    for _ in range(steps):
        p = sigmoid(f @ c)
        step = np.linalg.solve((f * (w * p * (1 - p))[:, None]).T @ f + ridge * np.eye(2), f.T @ (w * (p - t)) + ridge * c)
        c -= step
        if np.abs(step).max() < 1e-9:
            break
    return c[0] / scale, c[1]
