"""Registrations and requests: windows, folds, streams of several batches and SQL agree."""

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyline.operators import open_calls, registration, requests, rtp, sequences
from tallyline.operators.intervals import S
from tallyline.operators.machines import folded
from tallyline.streaming import keyed

MESSAGE = "caller string, sensor_id long, call_id long, b_us long, state string, expires_s long"
KINDS = ["ok", "ok", "failed", "unknown", "unregister"]


def walk(machine, messages, end):
    """messages: (t, tie, *message) of one key."""
    held, out = machine.load([]), []
    for t, _, *m in sorted(messages, key=lambda m: m[:2]):
        held, closed = machine.take(held, t, tuple(m))
        held = machine.load(machine.dump(held))  # as a stream's state does between batches
        out += closed
    return [machine.out(x) for x in out + machine.sweep(held, end)[1]]


def registered(*messages):
    """(second, state, expires_s) of one identity -> (state, from, to, n) in seconds, closed long after."""
    return sorted((s, a // S, b // S, n) for s, a, b, n in walk(registration.Registrations(), [(t * S, k, *m) for k, (t, *m) in enumerate(messages)], 10**6 * S))


def test_a_segment_times_out_from_its_beginning():
    got = registered((0, "unknown", 0), (400, "unknown", 0), (800, "unknown", 0))
    assert got == [("unknown", 0, 400, 2), ("unknown", 800, 800, 1)]


def test_a_failure_does_not_end_a_good_segment():
    got = registered((0, "ok", 500), (60, "failed", 0), (120, "ok", 500))
    assert got == [("expired", 620, 620, 0), ("failed", 60, 60, 1), ("ok", 0, 120, 2)]


def test_expiry_by_the_next_message_and_by_the_sweep():
    assert registered((0, "ok", 60), (61, "ok", 60)) == [("expired", 60, 60, 0), ("expired", 121, 121, 0), ("ok", 0, 0, 1), ("ok", 61, 61, 1)]
    assert registered((0, "ok", 60), (60, "ok", 60)) == [("expired", 120, 120, 0), ("ok", 0, 60, 2)]
    assert registered((0, "ok", 60), (100, "failed", 0)) == [("expired", 60, 60, 0), ("failed", 100, 100, 1), ("ok", 0, 0, 1)]


def test_an_identity_is_put_out():
    assert registered((0, "failed", 0), (61, "failed", 0)) == [("failed", 0, 0, 1), ("failed", 61, 61, 1)]
    assert registered((0, "failed", 0), (60, "failed", 0)) == [("failed", 0, 60, 2)]
    assert registered((0, "ok", 10_800), (7300, "ok", 10_800)) == [("ok", 0, 0, 1), ("ok", 7300, 7300, 1)]  # gone before it could expire
    assert registered((0, "unknown", 0), (100, "failed", 0), (250, "failed", 0)) == [("failed", 100, 250, 2), ("unknown", 0, 0, 1)]


def random_messages(seed, n=400, keys=6):
    random = np.random.default_rng(seed)
    gaps = random.choice([1, 20, 59, 60, 61, 300, 599, 601, 3000, 7199, 7201, 20_000], n, p=[0.1, 0.15, 0.1, 0.05, 0.1, 0.15, 0.1, 0.1, 0.05, 0.03, 0.03, 0.04])
    t = np.cumsum(gaps) * S + random.integers(0, 3, n) * (S // 2)
    return [(f"u{random.integers(keys)}", 1, i, int(t[i]), KINDS[random.integers(5)], int(random.choice([60, 600, 3600, 10_800]))) for i in range(n)]


@pytest.mark.parametrize("seed, hot", [(1, 10**9), (2, 0), (3, 10**9), (4, 0)])
def test_windows_equal_the_walk(spark, monkeypatch, seed, hot):
    monkeypatch.setattr(sequences, "SPLIT_ROWS", hot)  # with 0 every key is split by day
    rows = random_messages(seed)
    end = max(r[3] for r in rows) + (5000 if seed % 2 else 10**6) * S
    got = registration.segments(spark.createDataFrame(rows, MESSAGE), registration.KEYS, end).collect()
    want = []
    for key in {r[0] for r in rows}:
        want += [(key, 1, *x) for x in walk(registration.Registrations(), [(r[3], r[2], r[4], r[5]) for r in rows if r[0] == key], 1 << 60)]
    # until `end` segments are the same, but what expires later is left out
    held = [w for w in want if w[2] != "expired" or w[3] < end]
    assert {tuple(r) for r in got} <= set(want)
    assert sorted(w for w in map(tuple, got) if w[2] != "expired") == sorted(w for w in held if w[2] != "expired")
    if seed % 2 == 0:
        assert sorted(map(tuple, got)) == sorted(want)


def in_files(spark, rows, schema, folder, files, shuffle):
    order = np.random.default_rng(5).permutation(len(rows)) if shuffle else np.arange(len(rows))
    for k, part in enumerate(np.array_split(order, files)):
        spark.createDataFrame([rows[i] for i in part], schema).coalesce(1).write.parquet(f"{folder}/{k:02}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


@pytest.mark.parametrize("shuffle, late", [(True, "60 days"), (False, "1 minute")])
def test_a_stream_of_several_batches_equals_the_walk(spark, tmp_path, shuffle, late):
    rows = random_messages(7, n=150, keys=4)
    source = in_files(spark, rows, MESSAGE, f"{tmp_path}/in", 4, shuffle)
    job = keyed.machine_stream(source, registration.KEYS, registration.Registrations(), f"{tmp_path}/out", late)
    got = keyed.drained(job, f"{tmp_path}/out", source.schema, max(r[3] for r in rows) + 100 * 86_400 * S)
    want = []
    for key in {r[0] for r in rows}:
        want += [(key, 1, *x) for x in walk(registration.Registrations(), [(r[3], r[2], r[4], r[5]) for r in rows if r[0] == key], 1 << 60)]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def asked(*messages):
    """(second, id, asks, callid, cseq, number) of one relation -> (request, repeats, response)."""
    out = walk(requests.Requests(), [(t * S, i, i, *m) for t, i, *m in messages], 10**9 * S)
    return sorted((x[2], x[5], x[6]) for x in out)


def test_responses_find_the_open_request_of_their_call_and_number():
    assert asked((0, 1, True, "a", 1, 0), (1, 2, True, "a", 2, 0), (2, 3, False, "a", 1, 200)) == [(1, 1, 3), (2, 1, None)]
    assert asked((0, 1, True, "a", 1, 0), (1, 2, True, "a", 1, 0), (2, 3, False, "a", 1, 200), (3, 4, False, "a", 1, 200)) == [(1, 2, 3)]
    assert asked((0, 1, False, "a", 1, 200), (1, 2, True, "a", 1, 0)) == [(2, 1, None)]
    assert asked((0, 1, True, "a", 1, 0), (1, 2, False, "a", 1, 200), (2, 3, True, "a", 1, 0)) == [(1, 1, 2), (3, 1, None)]


def test_the_oldest_request_is_put_out_and_silence_ends_a_relation():
    six = [(k, k, True, f"c{k}", 1, 0) for k in range(6)]
    assert asked(*six, (9, 9, False, "c0", 1, 200), (10, 10, False, "c1", 1, 200))[:2] == [(0, 1, None), (1, 1, 10)]
    assert asked((0, 1, True, "a", 1, 0), (301, 2, False, "a", 1, 200)) == [(1, 1, None)]
    assert asked((0, 1, True, "a", 1, 0), (300, 2, False, "a", 1, 200)) == [(1, 1, 2)]


REQUEST = "src_ip long, sensor_id long, b_us long, call_id long, asks boolean, callid string, cseq long, number long"


def random_requests(seed, n=300):
    random = np.random.default_rng(seed)
    t = (1000 + np.cumsum(random.choice([0, 1, 30, 90, 299, 301], n))) * S
    return [(int(random.integers(3)), 0, int(t[i]), i, bool(random.random() < 0.6), f"c{random.integers(4)}", int(random.integers(2)), int(random.choice([200, 404, 500]))) for i in range(n)]


@pytest.mark.parametrize("hot", [0, 10**9])
def test_tracked_requests_equal_the_walk_in_table_and_stream(spark, tmp_path, monkeypatch, hot):
    monkeypatch.setattr(sequences, "SPLIT_ROWS", hot)
    rows = random_requests(11)
    want = []
    for key in range(3):
        want += [(key, 0, *x) for x in walk(requests.Requests(), [(r[2], r[3], *r[3:]) for r in rows if r[0] == key], 1 << 60)]
    got = requests.tracked(spark.createDataFrame(rows, REQUEST), requests.RELATION)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    if hot:
        source = in_files(spark, rows, REQUEST, f"{tmp_path}/in", 3, True)
        job = keyed.machine_stream(source, requests.RELATION, requests.Requests(), f"{tmp_path}/out", "10 days")
        got = keyed.drained(job, f"{tmp_path}/out", source.schema, 10**9 * S)
        assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_folds_of_nothing_and_over_batches(spark):
    rows = spark.createDataFrame(random_requests(3), REQUEST).withColumn("tie", F.col("call_id"))
    want = sorted(map(str, folded(rows, ["src_ip"], "b_us", "tie", requests.Requests(), 1 << 60).collect()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 5)
    try:
        assert sorted(map(str, folded(rows, ["src_ip"], "b_us", "tie", requests.Requests(), 1 << 60).collect())) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert folded(rows.limit(0), ["src_ip"], "b_us", "tie", requests.Requests(), 1 << 60).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 400), st.sampled_from(KINDS), st.sampled_from([60, 600, 3600, 10_800])), max_size=30))
def test_every_message_is_in_one_segment(found):
    t, rows = 0, []
    for gap, kind, expires in found:
        t += gap
        rows.append((t, kind, expires))
    out = registered(*rows)
    assert sum(n for *_, n in out) == len(rows)
    assert all(b - a <= registration.TIMEOUT_S for s, a, b, _ in out)


def opened(*messages):
    """(second, call, connects, least, hours) of one key -> (second, calls open)."""
    return [(t // S, n) for t, n in walk(open_calls.OpenCalls(), [(t * S, i, *m) for i, (t, *m) in enumerate(messages)], 10**9 * S)]


def test_alerts_on_open_calls():
    assert opened((0, 1, True, 2, 0), (1, 2, True, 2, 0), (2, 1, False, 2, 0), (3, 3, True, 2, 0)) == [(1, 2), (3, 2)]
    assert opened((0, 1, True, 1, 0), (1, 2, True, 1, 0), (2, 3, True, 1, 0)) == [(0, 1), (2, 3)]  # not within a second
    assert opened((0, 1, True, 1, 1), (3600, 2, True, 1, 1), (3601, 3, True, 1, 1)) == [(0, 1), (3601, 2)]  # once an hour
    forgotten = open_calls.PURGE_S
    assert opened((0, 1, True, 2, 0), (forgotten, 2, True, 2, 0)) == [(forgotten, 2)]
    assert opened((0, 1, True, 2, 0), (forgotten + 1, 2, True, 2, 0)) == []


def test_a_stream_of_alerts_equals_the_table(spark, tmp_path):
    random = np.random.default_rng(9)
    schema = "rule string, caller string, b_us long, tie long, call_id long, connects boolean, least long, hours long"
    rows = []
    for i in range(120):
        t = (1000 + int(random.integers(0, 3000))) * S
        key = ("r", f"u{random.integers(3)}")
        rows.append((*key, t, 2 * i + 1, i, True, 2, 0))
        if i % 3:
            rows.append((*key, t + int(random.integers(1, 400)) * S, 2 * i, i, False, 2, 0))
    want = sorted(map(tuple, folded(spark.createDataFrame(rows, schema), open_calls.KEYS, "b_us", "tie", open_calls.OpenCalls(), 1 << 60).collect()))
    assert len(want) > 20
    source = in_files(spark, rows, schema, f"{tmp_path}/in", 3, True)
    job = keyed.machine_stream(source, open_calls.KEYS, open_calls.OpenCalls(), f"{tmp_path}/out", "10 days", tie="tie")
    got = keyed.drained(job, f"{tmp_path}/out", source.schema, 10**9 * S)
    assert sorted(map(tuple, got.collect())) == want


def streamed(*numbers, step_ms=20):
    """Sequence numbers -> (packets, lost, reordered, runs by length)."""
    (n, lost, reordered, runs), = walk(rtp.Sequences(), [(k * step_ms * 1000, k, s % rtp.MODULUS) for k, s in enumerate(numbers)], 1 << 60)
    return n, lost, reordered, {k + 1: v for k, v in enumerate(runs) if v}


def test_sequence_numbers():
    # the third packet is the second that follows another; it counts as one before the base, which is two early ones
    assert streamed(*range(10)) == (8, 0, 2, {})
    assert streamed(*range(65530, 65546)) == (14, 0, 2, {})  # over the end of the range
    assert streamed(0, 1, 2, 3, 6, 7, 8) == (5, 2, 2, {2: 1})
    assert streamed(0, 5, 9, 20)[0] == 0  # never two that follow each other
    assert streamed(0, 1, 2, 4, 3, 5) == (4, 0, 3, {1: 1})  # one came late
    assert streamed(0, 1, 2, 10_000, 10_001, 10_002, step_ms=5000)[:2] == (3, 0)  # a restart once the next packet follows it
    assert streamed(0, 1, 2, 2500, 2501)[3] == {}  # too many to be lost within a second
    assert streamed(0, 1, 2, 2500, 2501, step_ms=5000)[3] == {10: 1}


class Calls:
    """A handle of a stateful processor that holds everything here and counts what is asked of it."""

    def __init__(self):
        self.n, self.timers, self.value, self.list = 0, set(), None, []

    def getValueState(self, *_):  # noqa: N802
        return self

    getListState = getValueState  # noqa: N815

    def __getattribute__(self, name):
        if name in ("update", "put", "appendList", "registerTimer", "deleteTimer", "listTimers"):
            self.n += 1
        return object.__getattribute__(self, name)

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None

    def appendList(self, rows):  # noqa: N802
        self.list += rows

    def listTimers(self):  # noqa: N802
        return iter(self.timers)

    def registerTimer(self, t):  # noqa: N802
        self.timers.add(t)

    def deleteTimer(self, t):  # noqa: N802
        self.timers.discard(t)

    def getCurrentWatermarkInMs(self):  # noqa: N802
        return self.watermark


class Waits(Calls):
    def get(self):
        return iter(self.list)

    def clear(self):
        self.list = []

    def put(self, rows):
        self.list = rows


def test_calls_of_a_state_do_not_grow_with_keys_and_messages(spark):
    calls = []
    for keys, n in ((3, 40), (300, 4000)):
        random, handle, waits = np.random.default_rng(2), Calls(), Waits()
        rows = [(f"u{random.integers(keys)}", 1, int(random.integers(1, 90_000)) * S, i, KINDS[random.integers(5)], 600) for i in range(n)]
        names = ["caller", "sensor_id", "t", "tie", "state", "expires_s"]
        pack = keyed._packs([pa.RecordBatch.from_pylist([{"slot": 5, **dict(zip(names, r, strict=True))} for r in rows[k::4]]) for k in range(4)])
        assert pack.num_rows == 1  # of all messages of a slot
        job = keyed.Keyed(registration.Registrations(), registration.KEYS)
        handle.getListState = lambda *_, waits=waits: waits
        job.init(handle)
        got = []
        handle.watermark = 0
        got += job.handleInputRows((5,), iter(pack.to_pylist()), handle)
        for day in (50_000, 10**7):
            handle.watermark = day * 1000
            handle.timers = {t for t in handle.timers if t > handle.watermark}
            got += job.handleExpiredTimer((5,), handle, None)
            assert got and waits.list == [] or day == 50_000
        assert handle.value is None and not handle.timers  # nothing is held, so there is no state
        got += job.handleInputRows((5,), iter(pack.to_pylist()), handle)
        assert waits.list == []  # they are late
        want = []
        for key in {r[0] for r in rows}:
            want += [(key, 1, *x) for x in walk(registration.Registrations(), [(r[2], r[3], r[4], r[5]) for r in rows if r[0] == key], 1 << 60)]
        assert sorted(map(tuple, got)) == sorted(want)
        calls.append(handle.n + waits.n)
    assert calls[0] == calls[1] < 15
