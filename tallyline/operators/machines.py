"""State machines over a key's messages in order, one definition for tables and streams.

A machine is a few pure functions on what a key holds. `folded` runs one over a table: Spark deals rows by key and sorts
them, and a task walks its keys with one batch and one key's state in memory. tallyline.streaming.keyed runs the same
machine as the keyed state of a stream.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


class Machine:
    """STATE, MESSAGE and OUT are DDL of what is held (rows), of a message without its time, and of a result."""

    STATE: str
    MESSAGE: str
    OUT: str

    def load(self, rows: list[tuple]):
        """What is held, from rows of STATE; none for a new key."""
        raise NotImplementedError

    def dump(self, held) -> list[tuple]:
        """Rows of STATE; none if nothing is held."""
        raise NotImplementedError

    def take(self, held, t: int, message: tuple):
        """(held, closed) after a message; times never fall."""
        raise NotImplementedError

    def sweep(self, held, now: int):
        """(held, closed) once time has come to now."""
        raise NotImplementedError

    def wakes(self, held) -> int | None:
        """The next time at which a sweep may change what is held."""
        raise NotImplementedError

    def out(self, closed: tuple) -> tuple:
        """A row of OUT."""
        return closed


def folded(rows: DataFrame, keys: list[str], t: str, tie: str, machine: Machine, end_us: int) -> DataFrame:
    """(keys, OUT) of a machine over all rows, whose other columns are messages by name; closed by a sweep at end_us."""
    names = [f.name for f in T.StructType.fromDDL(machine.MESSAGE).fields]
    dealt = rows.select(*keys, t, tie, *names).repartition(*keys).sortWithinPartitions(*keys, t, tie)
    schema = T.StructType([*(rows.schema[k] for k in keys), *T.StructType.fromDDL(machine.OUT).fields])
    arrow, n = to_arrow_schema(schema), len(keys)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, None
        for batch in batches:
            out: list[tuple] = []
            for now, own in groupby(zip(*batch.to_pydict().values(), strict=True), key=lambda r: r[:n]):
                if now != key:
                    if key is not None:
                        out += [(*key, *machine.out(x)) for x in machine.sweep(held, end_us)[1]]
                    key, held = now, machine.load([])
                for r in own:
                    held, closed = machine.take(held, r[n], r[n + 2 :])
                    out += [(*key, *machine.out(x)) for x in closed]
            yield _batch(out, arrow)
        if key is not None:
            yield _batch([(*key, *machine.out(x)) for x in machine.sweep(held, end_us)[1]], arrow)

    return dealt.mapInArrow(run, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
