"""Mixing sources to target weights: how often each document is taken, by pivotal dependent rounding.

A source's target is a share of all words by its weight, but at most CAP times its size; what is above goes to the
others by weight until none is above. A document of a source is to be taken target / size times. The whole part of that
number is certain. The fractional parts are rounded together: two documents meet, words are moved at random from one to
the other, so that the expectation of each stays, until one has a whole number of copies. The other one goes on. No words
are lost on the way, so all of a source but one document is settled with the source's words exactly as wanted, and the
last one is rounded to the nearer number: a source misses its target by at most half of one of its documents.

Documents meet in a reduction tree. They are dealt into blocks of about BLOCK_DOCS by a hash; each block leaves one
document; FAN_IN blocks become one, until a source has one. Within a block they meet by size, all pairs of a round at once.
Only (source, id, size) is shuffled, never text. Draws come from hashes of ids, so reruns agree whatever the number of
tasks.

Defined cases: a null text has no words, and such documents are taken 0 times. A null source is a source, the last one.
Rows that repeat source, id and size are one item with a number of rows: they are taken as often as one of them would be,
and differ by at most one copy. An id in two sources is in both. Very long texts only count their words. An empty table
has no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyline.llm.common import checkpointed, join_counted, table

WEIGHTS, SHARE, CAP = (3, 1, 2), 1.5, 2
BLOCK_DOCS, FAN_IN = 4096, 64
#: Copies as near as this to a whole number are that number.
NEAR = 1e-9
#: Rows that one item is unfolded to at a time.
UNFOLD = 4096

c = F.col


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def items(docs: DataFrame) -> DataFrame:
    """(source, doc_id, size, rows): documents without their texts; equal ones are counted before the shuffle."""
    return docs.select("source", "doc_id", words(c("text")).alias("size")).groupBy("source", "doc_id", "size").agg(F.count("*").alias("rows"))


def ranked(sources: DataFrame) -> DataFrame:
    """Adds place, from 0, by source (code points, null last). Ranges of sources are numbered in parallel."""
    dealt = checkpointed(sources.repartitionByRange(c("source").asc_nulls_last()).withColumn("_part", F.spark_partition_id()))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # a row for each part
    counts = dealt.groupBy("_part").count().withColumn("_before", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    inner = F.row_number().over(W.partitionBy("_part").orderBy(c("source").asc_nulls_last()))
    return dealt.withColumn("_inner", inner).join(F.broadcast(counts), "_part").withColumn("place", c("_inner") + c("_before") - 1).drop("_part", "_inner", "_before")


def with_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """Adds place and target to sources (source, size): each round, sources above their cap get it and the rest is shared anew.

    A source that is above its cap stays above, since what is shared anew only adds, so the rounds are a rising level of
    words a unit of weight. Each round is one aggregate of two sums, and settles at least one source.
    """
    weight = F.element_at(F.array(*map(F.lit, weights)), (c("place") % len(weights) + 1).cast("int"))
    s = checkpointed(ranked(sources).withColumn("weight", weight))
    wanted = share * (s.agg(F.sum("size").alias("n")).first()["n"] or 0)
    level, above = 0.0, -1
    while True:
        over = c("weight") * F.lit(level) > cap * c("size")
        r = s.agg(F.sum(F.when(over, cap * c("size")).otherwise(0)).alias("capped"), F.sum(F.when(over, 0).otherwise(c("weight"))).alias("weight"), F.count_if(over).alias("above")).first()
        if r["above"] == above or not r["weight"]:
            break
        above, level = r["above"], (wanted - r["capped"]) / r["weight"]
    return s.withColumn("target", F.least(c("weight") * F.lit(level), (cap * c("size")).cast("double"))).drop("weight")


def mixed_hash(*parts: np.ndarray) -> np.ndarray:
    """A draw in [0, 1) from whole numbers, by the finalising steps of a 64-bit multiply-xorshift hash (fixed constants)."""
    h = np.zeros(len(parts[0]), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for p in parts:
            h = (h ^ p.astype(np.uint64)) + np.uint64(0x9E3779B97F4A7C15)
            h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            h ^= h >> np.uint64(31)
    return (h >> np.uint64(11)) * 2.0**-53


def paired(group: np.ndarray, size: np.ndarray, part: np.ndarray, draw: np.ndarray, seed: int) -> np.ndarray:
    """The fractional parts after pairing: of each group at most one is left that is not 0 or 1.

    group is sorted; draw has a number for each item. In a round neighbours of a group meet, all pairs at once.
    """
    part = part.copy()
    for turn in range(64):
        open_ = np.flatnonzero((part > 0) & (part < 1))
        g = group[open_]
        starts = np.flatnonzero(np.diff(g, prepend=g[:1] - 1))
        place = np.arange(len(g)) - np.repeat(starts, np.diff(np.append(starts, len(g))))
        left = np.flatnonzero((place[:-1] % 2 == 0) & (g[1:] == g[:-1]))
        if not len(left):
            return part
        i, j = open_[left], open_[left + 1]
        to_i = np.minimum(size[i] * (1 - part[i]), size[j] * part[j])  # words that may move from j to i
        to_j = np.minimum(size[i] * part[i], size[j] * (1 - part[j]))
        gives = mixed_hash(draw[i], draw[j], np.full(len(i), seed + turn)) * (to_i + to_j) < to_j
        words_ = np.where(gives, to_i, -to_j)
        for k, moved in ((i, words_), (j, -words_)):
            p = part[k] + moved / size[k]
            part[k] = np.where(p < NEAR, 0.0, np.where(p > 1 - NEAR, 1.0, p))
    raise AssertionError("a round settles one of every pair")


def met(rows: DataFrame, seed: int) -> DataFrame:
    """One level of the tree: rows (number, block, doc_id, size, rows, draw, copies, part) meet within number and block.

    A block's rows go to one task; a task reads whole blocks, one after the other, and holds one batch and one block.
    """
    names = ["number", "block", "doc_id", "size", "rows", "draw", "copies", "part"]
    dealt = rows.select(*names).repartition("number", "block").sortWithinPartitions("number", "block", "size", "draw", "doc_id")

    def settle(t: pa.Table) -> pa.RecordBatch:
        number, block = t["number"].to_numpy(), t["block"].to_numpy()
        group = np.cumsum((np.diff(number, prepend=number[:1]) != 0) | (np.diff(block, prepend=block[:1]) != 0))
        part = paired(group, t["size"].to_numpy().astype(np.float64), t["part"].to_numpy(), t["draw"].to_numpy().astype(np.int64), seed)
        return t.set_column(names.index("part"), "part", pa.array(part)).combine_chunks().to_batches()[0]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            waiting.append(batch)
            number, block = batch["number"].to_numpy(), batch["block"].to_numpy()
            same = (number == number[-1]) & (block == block[-1])
            if same.all() and len(waiting) > 1 and (waiting[-2]["number"][-1].as_py(), waiting[-2]["block"][-1].as_py()) == (number[0], block[0]):
                continue  # the block goes on
            t = pa.Table.from_batches(waiting)
            whole = t.num_rows - int(same.sum())  # the last block may go on in the next batch
            if whole:
                yield settle(t.slice(0, whole))
            waiting = t.slice(whole).to_batches()
        if waiting:
            yield settle(pa.Table.from_batches(waiting))

    kinds = dict(rows.dtypes)
    return dealt.mapInArrow(run, ", ".join(f"{k} {kinds[k]}" for k in names))


def rounded(found: DataFrame, most_blocks: int, seed: int) -> DataFrame:
    """(number, doc_id, size, rows, copies): the tree over items (number, docs, doc_id, size, rows, times).

    times is how often each row of an item is to be taken. Of `rows` equal rows together, rows x times has a whole part,
    which is given to them evenly, and a fraction, which one of them takes into the tree.
    """
    total = c("rows") * (c("times") - F.floor("times"))
    total = F.when(F.abs(total - F.round(total)) < NEAR, F.round(total)).otherwise(total)
    draw = F.xxhash64("number", "doc_id", "size", F.lit(seed))
    rows = found.select("number", "docs", "doc_id", "size", "rows", draw.alias("draw"), (F.floor("times").cast("long") * c("rows") + F.floor(total).cast("long")).alias("copies"), (total - F.floor(total)).alias("part"))
    rows = rows.withColumn("block", F.pmod("draw", F.greatest(F.ceil(c("docs") / BLOCK_DOCS).cast("long"), F.lit(1))))
    open_ = (c("part") > 0) & (c("part") < 1) & (c("size") > 0)
    settled = [rows.where(~open_)]
    rows, level = rows.where(open_), 0
    while True:
        rows = checkpointed(met(rows, seed + 1000 * level))
        settled.append(rows)
        if most_blocks <= 1:
            break
        rows = rows.where(open_).withColumn("block", F.expr(f"block div {FAN_IN}"))
        most_blocks, level = -(-most_blocks // FAN_IN), level + 1
    names = ["number", "doc_id", "size", "rows", "copies", "part"]
    out = settled[0].select(*names)
    for k, level_rows in enumerate(settled[1:]):
        last = k == len(settled) - 2
        out = out.unionByName((level_rows if last else level_rows.where(~open_)).select(*names))
    copies = c("copies") + F.when(c("size") > 0, F.when(c("part") >= 0.5, 1).otherwise(0)).otherwise(0)
    return out.select("number", "doc_id", "size", "rows", copies.alias("copies"))


def unfolded(found: DataFrame, most_rows: int) -> DataFrame:
    """A row for each row of an item, with `copies` of it; the item's copies are dealt evenly, the first rows take one more.

    An item with very many rows is unfolded in pieces, which are dealt to all tasks in between.
    """
    if most_rows <= 1:
        return found.drop("rows")
    pieces = found.withColumn("_from", F.explode(F.sequence(F.lit(0).cast("long"), (c("rows") - 1), F.lit(UNFOLD).cast("long"))))
    if most_rows > UNFOLD:
        pieces = pieces.repartition("doc_id", "_from")
    each = pieces.withColumn("_row", F.explode(F.sequence("_from", F.least(c("_from") + UNFOLD, c("rows")) - 1)))
    return each.withColumn("copies", F.expr("copies div rows") + F.when(c("_row") < c("copies") % c("rows"), 1).otherwise(0)).drop("rows", "_from", "_row")


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP, seed: int = 42) -> DataFrame:
    """(source, doc_id, size, source_size, target, copies): one row for each of docs. cap is a whole number.

    Reruns with one seed agree.
    """
    found = checkpointed(items(docs))
    sources = found.groupBy("source").agg(F.sum(c("size") * c("rows")).alias("size"), F.count("*").alias("docs"))
    sources = with_targets(sources, weights, share, cap).select(c("place").cast("long").alias("number"), c("source").alias("_source"), c("size").alias("source_size"), "docs", "target")
    sources = checkpointed(sources)
    most = sources.agg(F.max("docs").alias("docs")).first()["docs"] or 0
    if not most:
        return docs.limit(0).select("source", "doc_id", words(c("text")).alias("size"), F.lit(0).cast("long").alias("source_size"), F.lit(0.0).alias("target"), F.lit(0).cast("long").alias("copies"))
    times = F.when(c("size") > 0, c("target") / c("source_size")).otherwise(0.0)
    joined = join_counted(found, sources, c("source").eqNullSafe(c("_source")), "inner").select("number", "docs", "doc_id", "size", "rows", times.alias("times"))
    done = rounded(joined, -(-most // BLOCK_DOCS), seed)
    most_rows = found.agg(F.max("rows").alias("rows")).first()["rows"]
    each = unfolded(done, most_rows)
    back = sources.select(c("number").alias("_number"), c("_source").alias("source"), "source_size", "target")
    return join_counted(each, back, c("number") == c("_number"), "inner").select("source", "doc_id", "size", "source_size", "target", "copies")


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixed(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", (c("copies") * c("size")).alias("taken"))


QUERIES = {"op13_mixing": op13_mixing}

ORACLE_SQL: dict[str, str] = {}  # SQL cannot draw; tests hold sizes, targets and words against a brute-force version
