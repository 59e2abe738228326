import datetime
import os

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from tallyline.streaming import jobs


def write(spark, folder, rows, name):
    spark.createDataFrame(rows, "event_id long, at timestamp, user_id long, event_type string, value double").coalesce(1).write.parquet(f"{folder}/{name}")


def at(minute):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=minute)


def stream(spark, folder):
    schema = "event_id long, at timestamp, user_id long, event_type string, value double"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


def test_upsert_updates_a_bucket_over_batches(spark, tmp_path):
    write(spark, tmp_path, [(1, at(1), 1, "a", 1.0)], "in1")
    write(spark, tmp_path, [(2, at(2), 1, "a", 2.0), (3, at(20), 1, "b", 4.0)], "in2")
    out = jobs.drain(jobs.quarter_counts(stream(spark, tmp_path)), f"{tmp_path}-out", ["bucket", "event_type"], "update")
    got = sorted((r["event_type"], r["n"], r["total"]) for r in out.collect())
    assert got == [("a", 2, 3.0), ("b", 1, 4.0)]


def test_upsert_rewrites_only_the_parts_of_a_batch(spark, tmp_path):
    out = f"{tmp_path}/out"
    sink = jobs.upsert(out, ["bucket"], F.expr("bucket div 10"))
    batches = [[(1, 1), (2, 1), (11, 1)], [(12, 5), (11, 2)], [(12, 6)], []]
    for epoch in (0, 1, 2, 1, 2, 3):  # batches that are run again change nothing
        sink(spark.createDataFrame(batches[epoch], "bucket long, n long"), epoch)
        if epoch == 1:
            assert sorted(d for d in os.listdir(f"{out}/version=1") if d.startswith("part=")) == ["part=1"]
    schema = spark.createDataFrame([], "bucket long, n long").schema
    table = jobs.Versioned(spark, out, schema)
    assert sorted((r["bucket"], r["n"]) for r in table.table().collect()) == [(1, 1), (2, 1), (11, 2), (12, 6)]
    assert table.rows(table.parts(0)).count() == 0
    # versions that no kept manifest names are gone, and so are old manifests
    assert table.epochs() == [3, 2, 1]
    for epoch in (4, 5):
        sink(spark.createDataFrame([(13, 1)], schema), epoch)
    assert table.epochs() == [5, 4, 3] and sorted(d for d in os.listdir(out) if d.startswith("version=")) == ["version=0", "version=2", "version=4", "version=5"]
    assert sorted((r["bucket"], r["n"]) for r in table.table().collect()) == [(1, 1), (2, 1), (11, 2), (12, 6), (13, 1)]


def test_a_batch_without_its_manifest_does_not_count(spark, tmp_path):
    out, schema = f"{tmp_path}/out", spark.createDataFrame([], "bucket long, n long").schema
    sink = jobs.upsert(out, ["bucket"], F.lit(0), added=("n",))
    sink(spark.createDataFrame([(1, 1)], schema), 0)
    spark.createDataFrame([(1, 99)], schema).write.parquet(f"{out}/version=1/part=0")  # it died before its manifest
    assert [r["n"] for r in jobs.Versioned(spark, out, schema).table().collect()] == [1]
    for _ in range(2):
        sink(spark.createDataFrame([(1, 2), (1, 3), (2, 1)], schema), 1)
        assert sorted(map(tuple, jobs.Versioned(spark, out, schema).table().collect())) == [(1, 6), (2, 1)]


def test_percentiles_of_several_batches_equal_those_of_all(spark, tmp_path):
    import numpy as np

    random = np.random.default_rng(4)
    rows = [(k, at(int(random.integers(0, 4000))), 1, "ab"[k % 2], float(random.integers(0, 30))) for k in range(600)]
    for k in range(3):
        write(spark, tmp_path, rows[k::3], f"in{k}")
    kept = jobs.drain(jobs.value_counts(stream(spark, tmp_path)), f"{tmp_path}-out", ["event_type", "day", "value"], part=F.col("day"), added=("n",))
    got = {(r["event_type"], r["day"]): (r["perc95"], r["perc99"]) for r in jobs.ranks_of_counts(kept, ["event_type", "day"], "value", "n", (95, 99)).collect()}
    want = {}
    for _, t, _, kind, value in rows:
        if value:
            want.setdefault((kind, int(t.replace(tzinfo=datetime.UTC).timestamp()) // 86400), []).append(value)
    pick = lambda v, p: sorted(v)[min(int(len(v) * p / 100 + 0.5), len(v) - 1)]
    assert got == {k: (pick(v, 95), pick(v, 99)) for k, v in want.items()}


def test_duplicates_within_the_watermark_go(spark, tmp_path):
    write(spark, tmp_path, [(1, at(1), 1, "a", 1.0), (1, at(2), 1, "a", 1.0)], "in1")
    write(spark, tmp_path, [(1, at(3), 1, "a", 1.0), (2, at(3), 1, "a", 1.0)], "in2")
    out = jobs.drain(jobs.deduplicated(stream(spark, tmp_path), ["event_id"]), f"{tmp_path}-out")
    assert sorted(r["event_id"] for r in out.collect()) == [1, 2]


def test_queries_keep_every_row_of_many_unordered_files(spark, tmp_path):
    import duckdb

    n = 230  # rows are late from the third batch on
    folder = tmp_path / "events.parquet"
    folder.mkdir()
    for k in range(n):  # newest first
        rows = [{"event_id": 10 * k + i, "ts": at(300 * (n - k) + i), "user_id": i % 2, "event_type": "a", "value": 1.0} for i in range(3)]
        pq.write_table(pa.Table.from_pylist(rows), folder / f"{k:03}.parquet")
        os.utime(folder / f"{k:03}.parquet", (1_700_000_000 + k,) * 2)
    db = duckdb.connect()
    db.execute("SET TimeZone='UTC'")
    db.execute(f"CREATE VIEW events AS SELECT * REPLACE (CAST(ts AS TIMESTAMP) AS ts) FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    for name in ("stream_quarter_counts", "dedup_within_watermark"):
        want = sorted(db.execute(jobs.ORACLE_SQL[name]).fetchall())
        assert sorted(map(tuple, jobs.QUERIES[name](spark, str(tmp_path)).collect())) == want
    assert len(want) == 3 * n
    source = spark.readStream.schema("event_id long, ts timestamp, user_id long, event_type string, value double").option("maxFilesPerTrigger", 50).parquet(f"{folder}")
    one = source.select(F.expr("unix_seconds(ts) div 900 * 900").alias("bucket"), F.lit(1).cast("bigint").alias("n"))
    kept = jobs.drain(one, f"{tmp_path}-late", ["bucket"], part=F.expr("bucket div 86400"), added=("n",))
    assert kept.agg(F.sum("n")).first()[0] == 3 * n  # five batches, the oldest rows last


def test_alerts_are_written_once_as_json(spark, tmp_path):
    write = jobs.alert_sink(str(tmp_path), "window", "judged_us")
    batch = spark.createDataFrame([(7, 1, 5, 3)], "user_id long, begin_us long, judged_us long, n long")
    for epoch in (0, 1, 1):
        write(batch, epoch)
    rows = spark.read.parquet(str(tmp_path)).collect()
    assert sorted((r["batch"], r["rule"], r["at_us"], r["alert_info"]) for r in rows) == [(k, "window", 5, '{"user_id":7,"begin_us":1,"judged_us":5,"n":3}') for k in (0, 1)]
