"""SimHash near-duplicates found through pivot distance tables.

Each fingerprint's Hamming distances to fixed reference fingerprints are tabulated. Two fingerprints at distance r
differ by at most r in every column of that table, so a pair with a larger difference in any column is discarded, and
what survives is verified bit by bit.

The columns also say where pairs can meet. The references are zero and, for each two neighbouring bits, the fingerprint
with just these set; a column less the column of zero is -2, 0 or 2, and two fingerprints at distance r differ in at
most r of these 32 values. Dealt into r + 3 groups, at least three groups agree in all their columns. So rows meet in
cells: one for each choice of three groups, keyed by the values in them. A pair counts in the first cell that it
shares, which the groups that agree tell, so each pair in reach is formed once and no other pair leaves the join.

Defined cases: null, empty and blank texts have fingerprint zero and are linked like others. A text of fewer words
than a shingle is one shingle. Rows that repeat a doc_id count once as a node; each gets its row. A null doc_id is
never the smallest while another exists. Other columns are not read.
"""

from __future__ import annotations

import random
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.llm.common import checkpointed, keep_one, table, text_key

#: The contract's 3-word shingles and 3 bits; hash seed; further references that only discard.
SHINGLE, RADIUS, SEED, EXTRA_PIVOTS = 3, 3, 42, 8

#: Zero, then one reference for each two neighbouring bits.
CELL_PIVOTS = [0, *(3 << i for i in range(0, 64, 2))]
#: A cell's key ends in the number of its choice of groups, below this.
CELL_NUMBERS = 64


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """The SimHash of a text in UTF-8, as an unsigned number."""
    words = text.lower().split() if text else []  # of bytes: A-Z only, and white space is \x20 and \x09-\x0D
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    h = xxhash.xxh64_intdigest
    hashes = np.fromiter((h(joined[a:b], SEED) for a, b in zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist())), ">u8")
    votes = np.zeros(64, np.int64)
    for part in range(0, len(hashes), 8192):  # a very long text is unpacked piece by piece
        votes += np.unpackbits(hashes[part : part + 8192].view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, *more: Column) -> DataFrame:
    """doc_id and fp (the fingerprint's 64 bits as a long)."""

    def scan(texts: pa.Array) -> pa.Array:
        return pa.array(np.fromiter((fingerprint(t, shingle) for t in texts.cast(pa.binary()).to_pylist()), np.uint64, len(texts)).view(np.int64))

    return docs.select("doc_id", *more, F.arrow_udf(scan, "bigint")("text").alias("fp"))


def extra_pivots(n: int = EXTRA_PIVOTS) -> list[int]:
    draw = random.Random(SEED)
    return [draw.getrandbits(64) for _ in range(n)]


def distance_table(fps: np.ndarray, pivots: list[int]) -> np.ndarray:
    """Hamming distances, a row for each fingerprint and a column for each pivot."""
    return np.bitwise_count(fps[:, None] ^ np.array(pivots, np.uint64)[None, :])


def cells(fps: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """The keys of each fingerprint's cells, a column for each choice of three groups of columns."""
    d = distance_table(fps, CELL_PIVOTS).astype(np.int64)
    value = (d[:, 1:] - d[:, :1]) // 2 + 1
    groups = [value[:, g] @ 3 ** np.arange(len(g)) for g in _groups(radius)]
    size = 3 ** (-(-32 // (radius + 3)))
    return np.stack([((groups[a] * size + groups[b]) * size + groups[c]) * CELL_NUMBERS + k for k, (a, b, c) in enumerate(combinations(range(radius + 3), 3))], axis=1)


def _groups(radius: int) -> list[np.ndarray]:
    """The pairs of bits, 0 to 31, of each group."""
    return np.array_split(np.arange(32), radius + 3)


def first_cell(agree: Column, radius: int) -> Column:
    """The number of the first cell that two fingerprints share, from a bit for each group in which they agree."""
    choices = list(combinations(range(radius + 3), 3))
    first = [next((k for k, c in enumerate(choices) if all(m >> g & 1 for g in c)), -1) for m in range(1 << (radius + 3))]
    return F.element_at(F.array(*map(F.lit, first)), agree + 1)


def agreeing_groups(a: Column, b: Column, radius: int) -> Column:
    """A number with a bit for each group whose pairs of bits all have the same count of ones in a and b."""
    low = F.lit(0x5555555555555555)
    one = lambda x: x.bitwiseXOR(F.shiftrightunsigned(x, 1))
    two = lambda x: x.bitwiseAND(F.shiftrightunsigned(x, 1))
    apart = one(a).bitwiseXOR(one(b)).bitwiseOR(two(a).bitwiseXOR(two(b))).bitwiseAND(low)
    out = F.lit(0)
    for g, pairs in enumerate(_groups(radius)):
        mask = sum(1 << 2 * int(i) for i in pairs)
        out += F.when(apart.bitwiseAND(F.lit(mask)) == 0, 1 << g).otherwise(0)
    return out


def links(fps: DataFrame, radius: int = RADIUS, pivots: list[int] | None = None) -> DataFrame:
    """Pairs (a, b), a < b, of the distinct fingerprints in column fp that differ in 1 to radius bits."""
    pivots = extra_pivots() if pivots is None else pivots
    names = [f"p{i}" for i in range(len(pivots))]

    def spread(batches):
        for batch in batches:
            fp = batch.column("fp").to_numpy(zero_copy_only=False)
            for at in range(0, len(fp), 4096):
                part = fp[at : at + 4096]
                keys, far = cells(part.view(np.uint64), radius), distance_table(part.view(np.uint64), pivots).astype(np.int8)
                n = keys.shape[1]
                columns = [keys.ravel(), np.repeat(part, n), *(np.repeat(far[:, i], n) for i in range(len(pivots)))]
                yield pa.record_batch([pa.array(c) for c in columns], names=["cell", "fp", *names])

    tables = fps.select("fp").mapInArrow(spread, ", ".join(["cell long", "fp long", *(f"{p} byte" for p in names)]))
    a = tables.toDF("cell", "a", *(f"a_{p}" for p in names))
    b = tables.toDF("cell", "b", *(f"b_{p}" for p in names))
    survives = F.col("a") < F.col("b")
    for p in names:
        survives &= F.abs(F.col(f"a_{p}") - F.col(f"b_{p}")) <= radius
    verified = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius
    once = first_cell(agreeing_groups(F.col("a"), F.col("b"), radius), radius) == F.col("cell") % CELL_NUMBERS
    return a.join(b.hint("merge"), "cell").where(survives).where(verified).where(once).select("a", "b")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, root for every node of the edges (a, b); root is the smallest node that can be reached.

    Alternating large-star and small-star rounds: each is a grouped minimum, counted before the shuffle, and a join
    that adaptive execution splits where one node has many edges. A round's edges never exceed the last one's nodes
    and edges, and rounds end when the edges no longer change.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct()
    e, before = checkpointed(e), None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        # a node with several smaller neighbours is linked to the least of them, which is also one of its pairs
        e = checkpointed(small.unionByName(least.select("u", F.col("m").alias("v"))).where("u > v").distinct())
        now = tuple(e.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_duplicate_groups(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp and component_id, the smallest doc_id that links of at most radius bits reach.

    Copies of one fingerprint are counted before any shuffle and stand as one node, so a group of any size costs one
    row in the search. Only ids and fingerprints are moved, never texts.
    """
    rows = checkpointed(fingerprints(docs, shingle))
    return rows.join(labels(rows, radius), "fp").select("doc_id", "fp", "component_id")


def labels(rows: DataFrame, radius: int = RADIUS) -> DataFrame:
    """fp, component_id and component, the fingerprint that stands for all that links reach, of rows (doc_id, fp)."""
    nodes = checkpointed(rows.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    found = components(links(nodes, radius))
    members = found.join(nodes, found["node"] == nodes["fp"]).select("fp", "root", "rep")
    smallest = members.groupBy("root").agg(F.min("rep").alias("component_id"))
    linked = checkpointed(members.join(smallest, "root").select("fp", "component_id", "root"))
    return checkpointed(nodes.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "rep").alias("component_id"), F.coalesce("root", "fp").alias("component")))


def drop_near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """docs with one row of each group, one of the smallest doc_id; all columns remain."""
    rows = checkpointed(fingerprints(docs, shingle, text_key().alias("text_key")))
    return keep_one(docs, rows.join(labels(rows, radius), "fp").select("doc_id", "text_key", F.col("component").alias("group"), F.lit(0).alias("order")))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_duplicate_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op4_simhash": op4_simhash}
ORACLE_SQL: dict[str, str] = {}
