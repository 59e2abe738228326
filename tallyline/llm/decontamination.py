"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The alphabet is words and a block is two of them. For the windows of one length, a shift table says how far the
search may jump after a block, a bucket of windows hangs on each last block, and a window is found only if the words
before that block compare equal.

Defined cases: a null or empty text has no words and no hits. An item without words has no window. Rows that repeat
an item_id are one item with the windows of all; windows of a null item_id mark words as hit but name no item. An
empty benchmark finds nothing. Repeated documents each get their own row. Very long texts are searched whole, and very
long items are cut into overlapping pieces. Other columns are not read.
"""

from __future__ import annotations

from collections import defaultdict
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.llm.common import table

#: Words of a window, and words of a block.
WINDOW, BLOCK = 10, 2
#: Bytes of the benchmark whose tables a task holds at once, and of documents that it holds against them before the next.
BYTES_A_TABLE, BYTES_A_PART = 1_000_000, 8_000_000

#: Bytes of UTF-8: A-Z become a-z, other ASCII that is neither a letter nor a digit becomes a space.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))

_FOUND = "struct<n_words:bigint,starts:array<int>,ends:array<int>,items:array<string>>"


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


def windows_of(words: list[bytes], window: int = WINDOW) -> list[tuple[bytes, ...]]:
    """Each run of `window` words; all words if they are fewer; nothing if there are none."""
    if not words:
        return []
    return [tuple(words[i : i + window]) for i in range(max(1, len(words) - window + 1))]


class SearchTables(NamedTuple):
    """For windows of one length m: what Wu-Manber search looks up. far is the jump after a block of no window."""

    m: int
    b: int
    far: int
    shift: dict
    buckets: dict


def search_tables(windows: dict[tuple[bytes, ...], list[str]], block: int = BLOCK) -> SearchTables:
    m = len(next(iter(windows)))
    b = min(block, m)
    shift: dict[tuple[bytes, ...], int] = {}
    buckets: dict[tuple[bytes, ...], list] = {}
    for window, items in windows.items():
        for end in range(b, m + 1):
            key = window[end - b : end]
            shift[key] = min(shift.get(key, m - b + 1), m - end)
        buckets.setdefault(window[m - b :], []).append((window, items))
    return SearchTables(m, b, m - b + 1, shift, buckets)


def search(tables: SearchTables, words: list[bytes]):
    """(first word, items) of each occurrence."""
    m, b, far, shift, buckets = tables
    jump_after = shift.get
    at, n = m, len(words)
    while at <= n:
        key = tuple(words[at - b : at])
        jump = jump_after(key, far)
        if jump:
            at += jump
            continue
        here = tuple(words[at - m : at])
        for window, items in buckets[key]:
            if window == here:
                yield at - m, items
        at += 1


def tables_of(items: list[tuple[str | None, bytes]], window: int = WINDOW) -> list[SearchTables]:
    by_length: dict[int, dict] = defaultdict(dict)
    same: dict[bytes, bytes] = {}  # equal words are held once
    for item, text in items:
        for w in windows_of([same.setdefault(x, x) for x in words_of(text)], window):
            names = by_length[len(w)].setdefault(w, [])
            if item is not None and item not in names:
                names.append(item)
    return [search_tables(windows) for _, windows in sorted(by_length.items())]


def _parts(benchmark: DataFrame, window: int, size: int):
    """The benchmark in lists of (item, text) of bounded size; its rows come to the driver one partition at a time.

    A long item is cut into pieces that share a window less one word, which have the windows of the whole.
    """
    part, bytes_ = [], 0
    for row in benchmark.select(F.col("item_id").cast("string"), F.coalesce("text", F.lit(""))).toLocalIterator():
        text = row[1].encode()
        words = words_of(text) if len(text) > size else []
        step = max(1, size // 8)
        for piece in [b" ".join(words[i : i + step + window - 1]) for i in range(0, max(1, len(words) - window + 1), step)] if words else [text]:
            part.append((row[0], piece))
            bytes_ += len(piece)
            if bytes_ >= size:
                yield part
                part, bytes_ = [], 0
    if part:
        yield part


def with_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, bytes_a_table: int = BYTES_A_TABLE) -> tuple[DataFrame, str]:
    """docs with one more column, and its name: struct(n_words, starts, ends, items), the hit runs of words, ends
    exclusive, and the items that occur.

    The benchmark is a given set of queries: every document is held against all of it, in one scan without a shuffle.
    It is broadcast as texts in parts of bytes_a_table; a task builds the tables of one part at a time, lets go of its
    texts, and holds a bounded number of documents against them before the next, so its memory depends on neither the
    benchmark's size nor the documents'. Each executor's disk gets the benchmark's texts once, and each document is
    scanned once for every part: a benchmark of n parts costs n scans of the words, not of the table.
    """
    name = "_hits"
    while name in docs.columns:
        name = f"_{name}"
    parts = [benchmark.sparkSession.sparkContext.broadcast(part) for part in _parts(benchmark, window, bytes_a_table)]
    return docs.withColumn(name, _search_udf(parts, window)(F.col("text"))), name


def _search_udf(parts: list, window: int):
    held: list = []  # the number of the part whose tables are held, and the tables

    def tables(k: int) -> list[SearchTables]:
        if not held or held[0] != k:
            held.clear()
            held.extend((k, tables_of(parts[k].value, window)))
            vars(parts[k]).pop("_value", None)  # a worker would keep every part's texts that it has read; they stay on its disk
        return held[1]

    def groups(raws: list) -> list[list]:
        """The texts in parts of bounded size; with a single table each for itself."""
        out, size = [[]], 0
        for raw in raws:
            if out[-1] and (len(parts) < 2 or size + len(raw or b"") > BYTES_A_PART):
                out.append([])
                size = 0
            out[-1].append(raw)
            size += len(raw or b"")
        return out if raws else []

    def scan(texts: pa.Array) -> pa.Array:
        out = []
        for raws in groups(texts.cast(pa.binary()).to_pylist()):
            docs = [(words_of(raw), [], set()) for raw in raws]
            order = range(len(parts)) if not held or held[0] == 0 else range(len(parts) - 1, -1, -1)  # so that tables serve twice
            for k in order:
                for t in tables(k):
                    for words, spans, items in docs:
                        for start, names in search(t, words):
                            spans.append((start, start + t.m))
                            items.update(names)
            for words, spans, items in docs:
                starts, ends = merged(spans)
                out.append({"n_words": len(words), "starts": starts, "ends": ends, "items": sorted(items)})
        return pa.array(out, pa.struct([("n_words", pa.int64()), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32())), ("items", pa.list_(pa.string()))]))

    return F.arrow_udf(scan, _FOUND)


def merged(spans: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Sorted spans with those that overlap or touch joined."""
    starts: list[int] = []
    ends: list[int] = []
    for a, b in sorted(spans):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, bytes_a_table: int = BYTES_A_TABLE) -> DataFrame:
    """doc_id, n_words, starts, ends, items for each document."""
    found, name = with_hits(docs.select("doc_id", "text"), benchmark, window, bytes_a_table)
    return found.select("doc_id", f"{name}.*")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs without those in which a benchmark window occurs; all columns remain."""
    found, name = with_hits(docs, benchmark, window)
    return found.where(F.size(f"{name}.starts") == 0).drop(name)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate(F.zip_with("starts", "ends", lambda a, b: (b - a).cast("long")), F.lit(0).cast("long"), lambda x, y: x + y)
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("starts") > 0).alias("contaminated"),
    )


QUERIES = {"op1_decontamination": op1_decontamination}

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE_SQL = {
    "op1_decontamination": f"""
WITH b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS m, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS k
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT m FROM bw),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
dw AS (SELECT doc_id, i, m, array_to_string(list_slice(w, i, i + m - 1), ' ') AS k
  FROM (SELECT doc_id, w, m, unnest(generate_series(1, len(w) - m + 1)) AS i FROM d, sizes WHERE len(w) >= m)),
f AS (SELECT dw.doc_id, dw.i, dw.m, bw.item_id FROM dw JOIN bw ON dw.m = bw.m AND dw.k = bw.k),
p AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + m - 1)) AS pos FROM f),
h AS (SELECT doc_id, count(*) AS n_hit FROM p GROUP BY doc_id),
s AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
  FROM (SELECT DISTINCT doc_id, item_id FROM f) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(s.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(s.ids, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN s ON d.doc_id = s.doc_id"""
}
