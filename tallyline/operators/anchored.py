"""Windows that each key opens itself: one begins with an event, and the next with the first event past its length.

Where a window begins depends on the one before, so a key's events are needed in order. Rows are dealt by key and sorted
by Spark, and each Arrow batch is cut at once: a vectorised binary search finds for every row the first one past its
length, and only the beginnings of windows are then walked, for all keys of the batch together. What passes from one
batch to the next is the open window of the last key, so memory does not grow with a key.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import DataFrame


def first_past(t: np.ndarray, low: np.ndarray, high: np.ndarray, limit: np.ndarray, at_end: bool) -> np.ndarray:
    """For each row the first index in [low, high) whose time is past the limit, or at it if `at_end`; high if none is."""
    low, high = low.copy(), high.copy()
    while (open_ := low < high).any():
        middle = (low + high) // 2
        value = t[np.minimum(middle, len(t) - 1)]
        past = value >= limit if at_end else value > limit
        high = np.where(open_ & past, middle, high)
        low = np.where(open_ & ~past, middle + 1, low)
    return low


def cut(t: np.ndarray, starts: np.ndarray, length: np.ndarray, at_end: bool, closes: bool, carried: tuple[int, int] | None) -> tuple[np.ndarray, np.ndarray, bool]:
    """Window begin and position of every row of a batch, and whether its last window is closed.

    starts are the first rows of each key; length is that of each row's key; carried is the open window (begin, rows so far) of the first one. A row past
    the length belongs to the window that it closes if `closes`, and begins the next one otherwise.
    """
    rows, ends = len(t), np.append(starts[1:], len(t))
    end_of = np.repeat(ends, ends - starts)
    at = np.arange(rows)
    after = first_past(t, at, end_of, t + length, at_end) + closes  # the beginning of the window after one that begins here
    heads = np.zeros(rows, dtype=bool)
    front = starts.copy()
    if carried is not None:
        front[0] = first_past(t, front[:1], ends[:1], np.array([carried[0] + length[0]]), at_end)[0] + closes
    limit = ends
    while len(front):
        inside = front < limit
        front, limit = front[inside], limit[inside]
        heads[front] = True
        front = after[front]
    head = np.maximum.accumulate(np.where(heads, at, -1))
    begin, n = t[head], at - head + 1
    if carried is not None:
        begin, n = np.where(head < 0, carried[0], begin), np.where(head < 0, at + 1 + carried[1], n)
    last = t[-1] - begin[-1]
    return begin, n, bool(closes and (last >= length[-1] if at_end else last > length[-1]))


def anchored(rows: DataFrame, keys: list[str], t: str, tie: str, length: int | str, at_end: bool = False, closes: bool = False) -> DataFrame:
    """Adds begin_us and n, the row's position in its window. Keys and times are not null. length may name a column of whole
    numbers, one for each key.

    A row past the length (at or past it, if `at_end`) begins a window, or with `closes` is the last of the old one.
    """
    names = rows.columns
    dealt = rows.repartition(*keys).sortWithinPartitions(*keys, t, tie)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, carried = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(names.index(k)) for k in keys]
            changed = np.zeros(batch.num_rows, dtype=bool)
            changed[0] = True
            for column in columns:
                changed[1:] |= pa.compute.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
            if tuple(c[0].as_py() for c in columns) != last:
                carried, last = None, None
            times = batch.column(names.index(t)).to_numpy()
            lengths = np.full(len(times), length) if isinstance(length, int) else batch.column(names.index(length)).to_numpy()
            begin, n, closed = cut(times, np.flatnonzero(changed), lengths, at_end, closes, carried)
            last = tuple(c[-1].as_py() for c in columns)
            carried = None if closed else (int(begin[-1]), int(n[-1]))
            if closed:
                last = None  # the key's next row begins a window
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(begin, pa.int64()), pa.array(n, pa.int64())], names=[*names, "begin_us", "n"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return dealt.mapInArrow(run, f"{kinds}, begin_us long, n long")
