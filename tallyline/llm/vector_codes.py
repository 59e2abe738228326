"""Vectors compressed to codes of codebook entries, found by partial-distance search.

Components become whole numbers, and a vector is cut into equal consecutive parts. Every position of a part has a
codebook. A part's code is its nearest entry by squared Euclidean distance, the lower index of equal ones. Codebooks
begin with the parts of the smallest ids and are moved to the means of their parts a stated number of times.

The search goes through the dimensions of a part by falling variance of the codebook's entries. After each one the entry
that looks best is measured in full, and every entry whose distance so far is already above the best full one goes. Only
what is strictly above goes, so ties are kept and the result is that of a full search.

Defined cases: a vector that is null or holds null or non-finite components gets no row. A shorter vector is filled up
with zeros to the longest one's length, and that to a multiple of the number of parts. Components are at most
`largest(dims)` from zero (524,288 times 256 for 64 dimensions), so that distances fit 64 bits. Rows that repeat an id
count each; a null id comes after every other. With fewer rows than entries a codebook has as many entries as rows; an
empty table has no rows. Sums of errors over a label stop at the largest long. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.llm.common import checkpointed, join_counted, table
from tallyline.llm.vectors import dimensions, finite, floored

FACTOR, PARTS, ENTRIES, ROUNDS = 256, 16, 64, 2
#: Vectors that are searched at a time; with 64 entries the distances of one part take 2 MB.
SLICE = 4096


def largest(dims: int) -> int:
    """Components up to this bound have distances, summed over all dimensions, of at most 2^62."""
    return math.isqrt((1 << 62) // max(dims, 1)) // 2


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of x the index of book's nearest row, the lowest of equal ones, and the squared distance."""
    order = np.argsort(-np.var(book.astype(np.float64), axis=0), kind="stable")
    x, book = x[:, order], book[:, order]
    rows, entries = np.repeat(np.arange(len(x)), len(book)), np.tile(np.arange(len(book)), len(x))
    so_far = np.zeros(len(rows), dtype=np.int64)
    best = np.full(len(x), np.iinfo(np.int64).max)
    first = np.arange(len(x)) * len(book)  # where each row's remaining entries begin; the best one always remains
    for k in range(x.shape[1]):
        so_far += (x[rows, k] - book[entries, k]) ** 2
        least = np.minimum.reduceat(so_far, first)
        if k + 1 < x.shape[1]:
            hopeful = np.flatnonzero(so_far == least[rows])
            hopeful = hopeful[np.diff(rows[hopeful], prepend=-1) > 0]
            rest = x[:, k + 1 :] - book[entries[hopeful], k + 1 :]
            best = np.minimum(best, least + (rest * rest).sum(axis=1))
        else:
            best = least
        stays = so_far <= best[rows]
        rows, entries, so_far = rows[stays], entries[stays], so_far[stays]
        first = np.flatnonzero(np.diff(rows, prepend=-1) > 0)
    return entries[first], best


def assigned(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, errors) of rows of whole numbers: a column for each part. books: part x entry x position."""
    parts, _, width = books.shape
    codes, errors = np.zeros((len(x), parts), dtype=np.int64), np.zeros((len(x), parts), dtype=np.int64)
    for low in range(0, len(x), SLICE):
        for p in range(parts):
            codes[low : low + SLICE, p], errors[low : low + SLICE, p] = nearest(x[low : low + SLICE, p * width : (p + 1) * width], books[p])
    return codes, errors


def first_books(rows: DataFrame, vector: str, vec_id: str, parts: int, entries: int, dims: int, factor: int) -> np.ndarray:
    """Codebooks of the first rows by id. Ids alone are ordered first, then vectors are read only of those."""
    order = [F.col(vec_id).asc_nulls_last()]
    ids = [r[0] for r in rows.select(vec_id).orderBy(*order).limit(entries).collect()]
    if len(ids) == entries and ids[-1] is not None:
        rows = rows.where(F.col(vec_id) <= F.lit(ids[-1]))
    few = rows.select(vec_id, vector).orderBy(*order, vector).limit(entries).collect()
    x = floored(pa.array([r[vector] for r in few], pa.list_(pa.float64())), dims, factor, largest(dims))
    return x.reshape(len(few), parts, dims // parts).transpose(1, 0, 2)


def moved(rows: DataFrame, vector: str, books: np.ndarray, factor: int) -> np.ndarray:
    """Each entry at the floor of the mean of its parts. A task sends one row of sums for each entry that it used."""
    parts, entries, width = books.shape
    limit = largest(parts * width)

    def sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((parts * entries, width), dtype=np.int64), np.zeros(parts * entries, dtype=np.int64)
        for batch in batches:
            x = floored(batch.column(0), parts * width, factor, limit)
            codes, _ = assigned(x, books)
            place = (codes + np.arange(parts) * entries).ravel()
            count += np.bincount(place, minlength=parts * entries)
            np.add.at(total, place, x.reshape(-1, width))
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(count[used]), pa.array(list(total[used]), pa.list_(pa.int64()))], names=["place", "n", "total"])

    found = rows.select(vector).mapInArrow(sums, "place long, n long, total array<long>").groupBy("place")
    found = found.agg(F.sum("n").alias("n"), *[F.sum(F.get("total", F.lit(i))).alias(f"t{i}") for i in range(width)])
    out = books.copy()
    for r in found.collect():  # at most one row for each entry
        out[divmod(r["place"], entries)] = [r[f"t{i}"] // r["n"] for i in range(width)]
    return out


def fitted(rows: DataFrame, vector: str = "embedding", vec_id: str = "vec_id", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, factor: int = FACTOR) -> np.ndarray | None:
    """Codebooks (part x entry x position) of all rows, whose vectors are finite; None of an empty table.

    They have entries x dimensions numbers, whatever the number of rows.
    """
    dims = -(-dimensions(rows, vector) // parts) * parts
    if not dims:
        return None
    books = first_books(rows, vector, vec_id, parts, entries, dims, factor)
    for _ in range(rounds):
        books = moved(rows, vector, books, factor)
    return books


def encoded(rows: DataFrame, books: np.ndarray, vector: str = "embedding", keep: tuple[str, ...] = ("vec_id", "label"), factor: int = FACTOR) -> DataFrame:
    """The columns `keep` with code (two hex digits a part, three or more if there are over 256 entries) and error."""
    parts, entries, width = books.shape
    digits = max(2, len(f"{entries - 1:x}"))
    names = np.array([f"{k:0{digits}x}" for k in range(entries)])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, errors = assigned(floored(batch.column(batch.num_columns - 1), parts * width, factor, largest(parts * width)), books)
            code = pa.array(["".join(row) for row in names[codes]], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], code, pa.array(errors.sum(axis=1))], names=[*keep, "code", "error"])

    kinds = dict(rows.dtypes)
    return rows.select(*keep, vector).mapInArrow(run, ", ".join([*(f"`{k}` {kinds[k]}" for k in keep), "code string", "error long"]))


def decoded(code: str, books: np.ndarray) -> list[int]:
    """The whole numbers that a code stands for."""
    digits = len(code) // len(books)
    return [int(v) for p, book in enumerate(books) for v in book[int(code[p * digits : (p + 1) * digits], 16)]]


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def with_label_error(codes: DataFrame) -> DataFrame:
    """Adds label_error, the errors summed over equal labels; null labels are equal. Labels are summed before the shuffle."""
    top = F.lit((1 << 63) - 1).cast("decimal(38,0)")
    sums = codes.groupBy(F.col("label").alias("_label")).agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), top).cast("long").alias("label_error"))
    return join_counted(codes, checkpointed(sums), F.col("label").eqNullSafe(F.col("_label")), "inner").drop("_label")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = finite(table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding"), "embedding")
    books = fitted(rows)
    codes = rows.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")) if books is None else checkpointed(encoded(rows, books))
    return with_label_error(codes).select("vec_id", "code", "error", "label_error", F.lit(digest(np.zeros((0, 0, 0), dtype=int) if books is None else books)).alias("codebooks_sha256"))


QUERIES = {"op11_vector_codes": op11_vector_codes}


def _round(k: int) -> str:
    """SQL of one round: distances of every part to its entries, the nearest, and the moved entries."""
    return f"""a{k} AS MATERIALIZED (SELECT rid, p, min((d, e)) AS b FROM (SELECT rid, parts.p, e, list_sum(list_transform(list_zip(part, entry), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM parts JOIN c{k} ON parts.p = c{k}.p) GROUP BY rid, p),
m{k} AS (SELECT p, e, list(v ORDER BY i) AS entry FROM (SELECT p, b[2] AS e, i, CAST(floor(sum(part[i]) / count(*)) AS BIGINT) AS v FROM (SELECT a{k}.p, b, part, unnest(range(1, len(part) + 1)) AS i FROM a{k} JOIN parts USING (rid, p)) GROUP BY ALL) GROUP BY p, e),
c{k + 1} AS MATERIALIZED (SELECT c{k}.p, c{k}.e, coalesce(m{k}.entry, c{k}.entry) AS entry FROM c{k} LEFT JOIN m{k} ON m{k}.p = c{k}.p AND m{k}.e = c{k}.e)"""


ORACLE_SQL = {
    "op11_vector_codes": f"""WITH kept AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda v: CAST(floor(256 * CAST(v AS DOUBLE)) AS BIGINT)) AS x, row_number() OVER (ORDER BY vec_id) AS rid
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
parts AS MATERIALIZED (SELECT rid, p, x[p * len(x) // 16 + 1:(p + 1) * len(x) // 16] AS part FROM kept, range(16) AS t(p)),
c0 AS MATERIALIZED (SELECT p, rid - 1 AS e, part AS entry FROM parts WHERE rid <= 64),
{_round(0)},
{_round(1)},
{_round(2).partition(",\nm2")[0]},
h AS (SELECT sha256(string_agg(array_to_string(entry, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c2),
f AS (SELECT rid, string_agg(printf('%02x', b[2]), '' ORDER BY p) AS code, CAST(sum(b[1]) AS BIGINT) AS error FROM a2 GROUP BY rid)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM kept JOIN f USING (rid), h"""
}
