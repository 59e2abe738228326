"""State machines as the keyed state of a stream, closed by timers of event time: registrations, requests, open calls.

A key holds its messages until the watermark has passed them, so that what it says depends neither on their order nor on
how they fall into batches. What is still open when a source is read up is closed by a clock: one row without a key that
moves the watermark on. A query therefore runs twice over one checkpoint, the second time with the clock's file.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from tallyline.operators import open_calls, registration, requests
from tallyline.operators.intervals import S
from tallyline.operators.machines import Machine
from tallyline.session import table
from tallyline.sources.calls import calls
from tallyline.streaming.jobs import LATE, shared_folder

c = F.col
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: A clock stands so far behind the last message, which is later than any state is held.
CLOCK_US = 30 * 86_400 * S


#: Keys share this many slots of state; it is fixed for a checkpoint. And messages that a task packs at once.
SLOTS, PACK_ROWS = 4096, 100_000


def packed(rows: DataFrame) -> DataFrame:
    """(slot, first_us, last_us, rows) of (slot, ..., t, ...): messages of a slot as one value, with their least and last time.

    A call of a state costs as much as many messages, so messages travel and wait in packs.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read: list[pa.RecordBatch] = []
        for batch in batches:
            read.append(batch)
            if sum(b.num_rows for b in read) >= PACK_ROWS:
                yield _packs(read)
                read = []
        if any(b.num_rows for b in read):
            yield _packs(read)

    return rows.mapInArrow(run, "slot int, first_us bigint, last_us bigint, rows binary")


def _packs(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    whole = pa.Table.from_batches(batches).sort_by("slot")
    slots, times = whole["slot"].to_pylist(), whole["t"].to_pylist()
    messages = list(zip(*(whole[name].to_pylist() for name in whole.column_names if name != "slot"), strict=True))
    out, begin = [], 0
    for slot, n in ((k, sum(1 for _ in own)) for k, own in groupby(slots)):
        own = slice(begin, begin + n)
        out.append((slot, min(times[own]), max(times[own]), pickle.dumps(messages[own])))
        begin += n
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["slot", "first_us", "last_us", "rows"])


class Keyed(StatefulProcessor):
    """transformWithState of a machine: packs of messages (keys, t, tie, MESSAGE) of a slot in, what it closes out.

    A slot is a state for all keys of one hash: packs that wait, and what each key holds. One timer stands for it, at the
    earliest thing that may happen: a message becomes due, or a sweep changes what is held. A key that holds nothing has no
    state, nor has a slot of such keys. Messages that the watermark has passed when they come are late and left out.
    """

    def __init__(self, machine: Machine, keys: list[str]):
        self.machine, self.keys = machine, keys
        self.names = [f.name for f in T.StructType.fromDDL(machine.MESSAGE).fields]
        self.outs = [f.name for f in T.StructType.fromDDL(machine.OUT).fields]

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "rows binary")
        self.waiting = handle.getListState("waiting", "rows binary")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        if key[0] < 0:  # a clock
            return
        watermark, at, new = timerValues.getCurrentWatermarkInMs(), len(self.keys), []
        for first_us, pack in ((r["first_us"], bytes(r["rows"])) for r in rows):
            if first_us <= watermark * 1000:
                left = [m for m in pickle.loads(pack) if m[at] > watermark * 1000]
                if not left:
                    continue
                first_us, pack = min(m[at] for m in left), pickle.dumps(left)
            new.append((first_us, pack))
        if new:
            self.waiting.appendList([(pack,) for _, pack in new])
            self._wake(min(first_us for first_us, _ in new), watermark)
        yield from ()  # nothing is said before the watermark has passed it

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        watermark, n = timerValues.getCurrentWatermarkInMs(), len(self.keys)
        now, found = watermark * 1000, self.held.get()
        before = pickle.loads(bytes(found[0])) if found else {}
        due: dict[tuple, list[tuple]] = {}
        left: list[tuple] = []
        for (pack,) in self.waiting.get():
            for m in pickle.loads(bytes(pack)):
                if m[n] <= now:
                    due.setdefault(m[:n], []).append(m)
                else:
                    left.append(m)
        after, times, closed = {}, [], []
        for one in {**before, **due}:
            held, own = self.machine.load(before.get(one, [])), sorted(due.get(one, ()), key=lambda m: m[n : n + 2])
            for m in own:
                held, out = self.machine.take(held, m[n], m[n + 2 :])
                closed += [(one, x) for x in out]
            held, out = self.machine.sweep(held, now)
            closed += [(one, x) for x in out]
            rows = self.machine.dump(held)
            if rows:
                after[one] = [tuple(r) for r in rows]
            t = self.machine.wakes(held)
            if t is not None:
                times.append(t)
        if after:
            self.held.update((pickle.dumps(after),))
        elif found:
            self.held.clear()
        if due:
            self.waiting.clear()
            if left:
                self.waiting.put([(pickle.dumps(left),)])
        if left:
            times.append(min(m[n] for m in left))
        if times:
            self._wake(min(times), watermark)
        made = Row(*self.keys, *self.outs)
        for one, x in closed:
            yield made(*one, *self.machine.out(x))

    def _wake(self, t: int, watermark: int) -> None:
        """An earlier timer replaces a later one. Those that the watermark has passed are about to end."""
        at = max(-(-t // 1000), watermark + 1)
        standing = [x for x in self.handle.listTimers() if x > watermark]
        if not standing or at < min(standing):
            for other in standing:
                self.handle.deleteTimer(other)
            self.handle.registerTimer(at)

    def close(self) -> None:
        pass


@contextmanager
def rocksdb(spark: SparkSession):
    """Keyed states with timers are kept in RocksDB, on disk and not on the heap; set while a query starts."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def nullable(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields])


def machine_stream(messages: DataFrame, keys: list[str], machine: Machine, folder: str, late: str = LATE, t: str = "b_us", tie: str = "call_id") -> DataFrame:
    """(keys, OUT): what a machine closes, from a stream of messages and of the rows of a clock's folder."""
    spark, schema = messages.sparkSession, nullable(messages.schema)
    spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{folder}/clock")
    rows = messages.unionByName(spark.readStream.schema(schema).parquet(f"{folder}/clock"))
    job = Keyed(machine, keys)
    slot = F.when(c(keys[0]).isNull(), -1).otherwise(F.pmod(F.xxhash64(*keys), F.lit(SLOTS))).cast("int")  # a clock has no key
    rows = packed(rows.select(slot.alias("slot"), *keys, c(t).alias("t"), c(tie).alias("tie"), *job.names))
    rows = rows.withColumn("at", F.timestamp_micros("last_us")).withWatermark("at", late)
    out = T.StructType([*(schema[k] for k in keys), *T.StructType.fromDDL(machine.OUT).fields])
    return rows.groupBy("slot").transformWithState(job, out, "append", "eventtime")


def drained(stream: DataFrame, folder: str, schema: T.StructType, clock_us: int | None, t: str = "b_us") -> DataFrame:
    """The rows of a machine_stream once its source is read up and, if a clock is given, everything before it is closed."""
    spark = stream.sparkSession

    def run() -> None:
        with rocksdb(spark):
            writer = stream.writeStream.outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{folder}/checkpoint")
            query = writer.format("parquet").option("path", f"{folder}/rows").start()
            query.awaitTermination()

    run()
    if clock_us is not None:
        row = tuple(clock_us if f.name == t else None for f in schema.fields)
        spark.createDataFrame([row], nullable(schema)).write.mode("append").parquet(f"{folder}/clock")
        run()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


def _run(spark: SparkSession, sf_dir: str, derive, keys: list[str], machine: Machine, tie: str = "call_id") -> DataFrame:
    """A machine as a stream over the folder's files, closed by a clock behind the last message."""
    folder = shared_folder(spark)
    events = table(spark, sf_dir, "events")
    messages = derive(calls(spark.readStream.schema(events.schema).parquet(f"{sf_dir}/[e]vents.parquet")))
    last = derive(calls(events)).agg(F.max("b_us").alias("t")).first()["t"] or 0
    return drained(machine_stream(messages, keys, machine, folder, tie=tie), folder, messages.schema, last + CLOCK_US)


def stream_registrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All segments of registrations, those that expired behind the last message included."""
    return _run(spark, sf_dir, registration.registrations, registration.KEYS, registration.Registrations())


def stream_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every request with its repeats and the response that answers it, if any."""
    return requests.summary(_run(spark, sf_dir, requests.messages, requests.RELATION, requests.Requests()))


def stream_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts of all rules on open calls, as rows of an alert sink: rule, time, and what is known as JSON."""
    known = open_calls.rules(spark, sf_dir)
    found = _run(spark, sf_dir, lambda calls_: open_calls.messages(calls_, known), open_calls.KEYS, open_calls.OpenCalls(), "tie")
    return found.select("rule", "at_us", F.to_json(F.struct("caller", "n")).alias("alert_info"))


QUERIES = {f.__name__: f for f in (stream_registrations, stream_requests, stream_alerts)}

ORACLE_SQL = {
    "stream_registrations": registration.walk(f"(SELECT max(t) FROM r) + {CLOCK_US}"),
    "stream_requests": requests.WALK,
    "stream_alerts": f"""SELECT rule, at_us, '{{"caller":"' || caller || '","n":' || n || '}}' AS alert_info FROM ({open_calls.WALK})""",
}
