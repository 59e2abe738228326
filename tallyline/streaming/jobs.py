"""Structured Streaming twins of the batch metrics and rules.

Each job is a function from a streaming DataFrame of call records to a streaming result, so any source works. The
queries at the end run one over a folder of files until it is read up, and return the table that its sink holds.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tallyline.operators.intervals import S
from tallyline.sources.calls import CDR
from tallyline.session import table

c = F.col
LATE = "2 hours"


def shared_folder(spark: SparkSession) -> str:
    """A new folder that all executors see: under spark.checkpoint.dir, or a temporary one if all tasks run on this machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that every node sees")
        root = tempfile.mkdtemp(prefix="stream-")
    return f"{root}/stream-{uuid.uuid4().hex}"


def events_stream(spark: SparkSession, sf_dir: str, files_a_batch: int | None = None) -> DataFrame:
    """The events table as a stream of call begins; by default one batch, so that no row is late whatever the files' order."""
    schema = table(spark, sf_dir, "events").schema
    reader = spark.readStream.schema(schema)
    reader = reader if files_a_batch is None else reader.option("maxFilesPerTrigger", files_a_batch)
    e = reader.parquet(f"{sf_dir}/[e]vents.parquet")  # as a pattern, it may be a file or a folder
    return e.select("event_id", c("ts").cast("timestamp").alias("at"), "user_id", "event_type", "value")


def quarter_counts(events: DataFrame, late: str = LATE) -> DataFrame:
    """Calls by type and quarter of an hour; a call later than the watermark is dropped with its closed window."""
    w = events.withWatermark("at", late).groupBy(F.window("at", "15 minutes").alias("w"), "event_type")
    return w.agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total")).select(F.unix_seconds("w.start").alias("bucket"), "event_type", "n", "total")


def deduplicated(events: DataFrame, keys: list[str], late: str = LATE) -> DataFrame:
    """The first of equal events within the watermark."""
    return events.withWatermark("at", late).dropDuplicatesWithinWatermark(keys)


def anchored_alerts(events: DataFrame, length_s: int, limit: int) -> DataFrame:
    """Keys with at least `limit` events in a window that begins at their first; judged at the next event past it.

    The state of a key is its window's begin and count. It times out with the watermark once the window is over.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        begin, n = state.get if state.exists else (None, 0)
        out = []
        for at in pd.concat([rows["at"] for rows in batches]).sort_values():  # a key's rows come in several frames
            t = int(at.value // 1000)
            begin, n = (t, 1) if begin is None else (begin, n + 1)
            if t > begin + length_s * S:
                if n >= limit:
                    out.append((key[0], begin, t, n))
                begin, n = None, 0
        if begin is None:
            state.remove()
        else:
            state.update((begin, n))
            state.setTimeoutTimestamp(max(begin // 1000 + length_s * 1000, state.getCurrentWatermarkMs()) + 86_400_000)
        if out:
            yield pd.DataFrame(out, columns=["user_id", "begin_us", "judged_us", "n"])

    grouped = events.withWatermark("at", LATE).groupBy("user_id")
    return grouped.applyInPandasWithState(update, "user_id long, begin_us long, judged_us long, n long", "begin_us long, n long", "append", GroupStateTimeout.EventTimeTimeout)


class Versioned:
    """A table of parts in a folder, each part a version of its own: what a batch does not touch is neither read nor written.

    A batch writes new versions of its parts and then a manifest, the list of each part's version, which is what counts:
    until it is there, readers see the batch before, and a batch that is run again writes the same. Versions that no
    manifest kept names are deleted. Manifests have a row for each part, whatever the number of rows.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: T.StructType, kept: int = 3):
        self.spark, self.folder, self.schema, self.kept = spark, folder, schema, kept
        self.fs = spark._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def epochs(self, before: int | None = None) -> list[int]:
        """Batches that ended, the last one first; their number is bounded, since old manifests go."""
        if not self.fs.exists(self._path("manifest")):
            return []
        found = [s.getPath() for s in self.fs.listStatus(self._path("manifest"))]
        whole = [int(f.getName().split("=")[1]) for f in found if self.fs.exists(self._path(f"manifest/{f.getName()}/_SUCCESS"))]
        return sorted((e for e in whole if before is None or e < before), reverse=True)

    def parts(self, before: int | None = None) -> DataFrame:
        """(part, version): the last manifest, or the last one before a batch."""
        ended = self.epochs(before)
        if not ended:
            return self.spark.createDataFrame([], "part bigint, version bigint")
        return self.spark.read.schema("part bigint, version bigint").parquet(f"{self.folder}/manifest/epoch={ended[0]}")

    def rows(self, parts: DataFrame) -> DataFrame:
        """The rows of listed parts; only their folders are read."""
        listed = [(r["part"], r["version"]) for r in parts.collect()]
        if not listed:
            return self.spark.createDataFrame([], self.schema)
        folders = [f"{self.folder}/version={v}/part={p}" for p, v in listed]
        return self.spark.read.schema(self.schema).parquet(*folders)

    def table(self) -> DataFrame:
        return self.rows(self.parts())

    def write(self, rows: DataFrame, part: Column, epoch: int, merge) -> None:
        """merge(old, new) of the parts that rows touch becomes their version `epoch`."""
        rows = rows.withColumn("part", part.cast("bigint")).persist()
        touched = rows.select("part").distinct()
        before = self.parts(epoch)
        old = self.rows(before.join(touched, "part", "left_semi"))
        out = merge(old, rows.drop("part")).withColumn("part", part.cast("bigint"))
        out.write.mode("overwrite").partitionBy("part").parquet(f"{self.folder}/version={epoch}")
        now = before.join(touched, "part", "left_anti").unionByName(touched.withColumn("version", F.lit(epoch).cast("bigint")))
        now.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/manifest/epoch={epoch}")
        rows.unpersist()
        self._vacuum()

    def _vacuum(self) -> None:
        ended = self.epochs()
        named: set[tuple[int, int]] = set()
        for e in ended[: self.kept]:
            named |= {(r["part"], r["version"]) for r in self.spark.read.parquet(f"{self.folder}/manifest/epoch={e}").collect()}
        for e in ended[self.kept :]:
            self.fs.delete(self._path(f"manifest/epoch={e}"), True)
        for version in self.fs.listStatus(self._path("")):
            name = version.getPath().getName()
            if not name.startswith("version=") or int(name.split("=")[1]) > (ended[0] if ended else -1):
                continue
            held = [s.getPath() for s in self.fs.listStatus(version.getPath()) if s.getPath().getName().startswith("part=")]
            old = [p for p in held if (int(p.getName().split("=")[1]), int(name.split("=")[1])) not in named]
            for path in [version.getPath()] if len(old) == len(held) else old:
                self.fs.delete(path, True)


def upsert(folder: str, keys: list[str], part: Column, added: tuple[str, ...] = ()):
    """A foreachBatch sink of a Versioned table: rows of a batch replace those of the same keys, or with `added` are summed
    with them.

    `part` is a whole number that follows from the keys, such as the day of a bucket.
    """

    def merge(old: DataFrame, new: DataFrame) -> DataFrame:
        if added:
            return old.unionByName(new).groupBy(*keys).agg(*[F.sum(name).alias(name) for name in added])
        return old.join(new.select(*keys), keys, "left_anti").unionByName(new)

    def write(batch: DataFrame, epoch: int) -> None:
        Versioned(batch.sparkSession, folder, batch.schema).write(batch, part, epoch, merge)

    return write


def alert_sink(folder: str, rule: str, time_us: str):
    """A foreachBatch sink: each row is an alert of a rule, as JSON with its event time; a batch that is run again
    replaces what it wrote before."""

    def write(batch: DataFrame, epoch: int) -> None:
        info = F.to_json(F.struct(*batch.columns))
        batch.select(F.lit(rule).alias("rule"), c(time_us).alias("at_us"), info.alias("alert_info")).write.mode("overwrite").parquet(f"{folder}/batch={epoch}")

    return write


def drain(stream: DataFrame, folder: str, keys: list[str] | None = None, mode: str = "append", part: Column | None = None, added: tuple[str, ...] = ()) -> DataFrame:
    """Runs a stream until its source is read up; returns the sink's table, upserted where keys are named."""
    spark, rows = stream.sparkSession, f"{folder}/rows"
    writer = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{folder}/checkpoint")
    if keys is None:
        writer.format("parquet").option("path", rows).start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(rows)
    writer.foreachBatch(upsert(rows, keys, F.lit(0) if part is None else part, added)).start().awaitTermination()
    return Versioned(spark, rows, stream.schema).table()


def value_counts(events: DataFrame) -> DataFrame:
    """(event_type, day, value, n): one row of n = 1 for each call that was measured, to be added up."""
    measured = events.where("value <> 0")
    return measured.select("event_type", F.expr("unix_seconds(at) div 86400").alias("day"), "value", F.lit(1).cast("bigint").alias("n"))


def stream_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest-rank percentiles of values by type and day, from counts of values that every batch adds to.

    What is kept between batches are distinct values and their counts, so percentiles are exact however often they are
    asked for, and a batch touches only the days that it has rows of.
    """
    kept = drain(value_counts(events_stream(spark, sf_dir)), shared_folder(spark), ["event_type", "day", "value"], part=c("day"), added=("n",))
    return ranks_of_counts(kept, ["event_type", "day"], "value", "n", (95, 99))


def ranks_of_counts(counted: DataFrame, keys: list[str], value: str, n: str, percents: tuple[int, ...]) -> DataFrame:
    """Nearest-rank percentiles of (keys, value, n)."""
    w = W.partitionBy(*keys)
    r = counted.withColumn("_to", F.sum(n).over(w.orderBy(value).rowsBetween(W.unboundedPreceding, 0))).withColumn("_all", F.sum(n).over(w))
    at = lambda p: F.least(F.round(c("_all") * p / 100.0).cast("bigint"), c("_all") - 1)
    return r.groupBy(*keys).agg(*(F.max(F.when((c("_to") > at(p)) & (c("_to") - c(n) <= at(p)), c(value))).alias(f"perc{p}") for p in percents))


def stream_quarter_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls by type and quarter of an hour. Batches add to the table, so a call counts however late it comes."""
    e = events_stream(spark, sf_dir)
    one = e.select(F.expr("unix_seconds(at) div 900 * 900").alias("bucket"), "event_type", F.lit(1).cast("bigint").alias("n"), c("value").alias("total"))
    kept = drain(one, shared_folder(spark), ["bucket", "event_type"], part=F.expr("bucket div 86400"), added=("n", "total"))
    return kept.withColumn("total", F.round("total", 6))


def dedup_within_watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events_stream(spark, sf_dir)
    return drain(deduplicated(e, ["event_id"]).select("event_id", "user_id", "event_type"), shared_folder(spark))


def stream_anchored_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drain(anchored_alerts(events_stream(spark, sf_dir), 6 * 3600, 3), shared_folder(spark))


QUERIES = {f.__name__: f for f in (stream_quarter_counts, stream_percentiles, dedup_within_watermark, stream_anchored_alerts)}

ORACLE_SQL = {
    "stream_percentiles": """SELECT event_type, day, max(CASE WHEN rn = least(CAST(round(n * 95 / 100.0) AS BIGINT), n - 1) THEN value END) AS perc95, max(CASE WHEN rn = least(CAST(round(n * 99 / 100.0) AS BIGINT), n - 1) THEN value END) AS perc99
FROM (SELECT event_type, epoch_us(ts) // 86400000000 AS day, value, row_number() OVER w - 1 AS rn, count(*) OVER (PARTITION BY event_type, epoch_us(ts) // 86400000000) AS n FROM events WHERE value <> 0
  WINDOW w AS (PARTITION BY event_type, epoch_us(ts) // 86400000000 ORDER BY value)) GROUP BY event_type, day""",
    "stream_quarter_counts": "SELECT epoch_us(ts) // 900000000 * 900 AS bucket, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2",
    "dedup_within_watermark": "SELECT DISTINCT event_id, user_id, event_type FROM events",
    "stream_anchored_alerts": f"""WITH RECURSIVE r AS (SELECT user_id, b_us, row_number() OVER (PARTITION BY user_id ORDER BY b_us, call_id) AS rn FROM {CDR}),
w AS (SELECT user_id, rn, b_us AS begin_us, CAST(1 AS BIGINT) AS n, false AS closed, b_us FROM r WHERE rn = 1
 UNION ALL SELECT r.user_id, r.rn, CASE WHEN w.closed THEN r.b_us ELSE w.begin_us END, CASE WHEN w.closed THEN 1 ELSE w.n + 1 END, NOT w.closed AND r.b_us > w.begin_us + 21600000000, r.b_us FROM w JOIN r ON r.user_id = w.user_id AND r.rn = w.rn + 1)
SELECT user_id, begin_us, b_us AS judged_us, n FROM w WHERE closed AND n >= 3""",
}
