"""Roll-ups of streams, traffic, registrations, fixed-size series and storage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyline.operators.intervals import S, r6
from tallyline.session import table
from tallyline.sources.calls import CDR, CDR_RTP, cdr, cdr_rtp

c = F.col


def rtp_stat_10s(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jitter and loss by source address and ten seconds."""
    r = cdr_rtp(spark, sf_dir).withColumn("bucket", F.expr("t_us div 10000000 * 10"))
    loss = c("lost") / (c("received") + 2 + c("lost")) * 100
    return r.groupBy("saddr", "bucket").agg(F.count("*").alias("n"), F.max("jitter_x10").alias("jitter_max"), r6(F.sum("jitter_x10") / F.count("*")).alias("jitter_avg"), r6(F.max(loss)).alias("loss_max"), F.sum("lost").alias("lost"))


def flow_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Octets and packets of (source, destination, class) in five minutes."""
    f = cdr(spark, sf_dir).withColumn("bucket", F.expr("b_us div 300000000 * 300"))
    return f.groupBy("src_ip", "dst_ip", "codec", "bucket").agg(F.sum("dur_us").alias("octets"), F.count("*").alias("packets"))


def traffic_in_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each flow goes out of its source and into its destination; by five minutes, and their sums by hour and day."""
    f = cdr(spark, sf_dir)
    none = F.lit(0).cast("bigint")
    ends = F.array(F.struct(c("src_ip").alias("ip"), c("dur_us").alias("out"), none.alias("in")), F.struct(c("dst_ip").alias("ip"), none.alias("out"), c("dur_us").alias("in")))
    finest = f.select(F.expr("b_us div 300000000 * 300").alias("at"), F.explode(ends).alias("e")).groupBy("at", "e.ip").agg(F.sum("e.out").alias("out"), F.sum("e.in").alias("in"), F.count("*").alias("n"))
    grains = F.array(*(F.struct(F.lit(g).alias("grain"), F.expr(f"at div {w} * {w}").alias("bucket")) for g, w in (("interval", 300), ("hour", 3600), ("day", 86400))))
    rows = finest.select("ip", "out", "in", "n", F.explode(grains).alias("g"))
    return rows.groupBy("g.grain", "g.bucket", "ip").agg(F.sum("out").alias("octets_out"), F.sum("in").alias("octets_in"), F.sum("n").alias("flows"))


def register_failed_minute(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed registrations by sensor, both addresses and minute; details beyond a limit only count on."""
    f = cdr(spark, sf_dir).where("lsr >= 400").withColumn("bucket", F.expr("b_us div 60000000 * 60"))
    n = F.count("*")
    return f.groupBy("sensor_id", "src_ip", "dst_ip", "bucket").agg(F.least(n, F.lit(1000)).alias("counter"), F.greatest(n - 1000, F.lit(0)).alias("counter_2"))


def active_registrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Callers by sensor whose latest state is good."""
    last = cdr(spark, sf_dir).groupBy("sensor_id", "caller").agg(F.max_by("lsr", F.struct("b_us", "call_id")).alias("lsr"))
    return last.groupBy("sensor_id").agg(F.count_if(c("lsr") == 200).alias("active"), F.count("*").alias("known"))


RRD_ROWS = 760


def rrd_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series of four resolutions with mean, least and most, each keeping its last 760 rows.

    The finest grain is summed once and the coarser ones from it. The kept rows are those whose step is among the last
    760 steps before the latest, so no ranking is needed.
    """
    steps = cdr(spark, sf_dir).withColumn("step", F.expr("b_us div 300000000")).groupBy("sensor_id", "step").agg(F.sum("dur_us").alias("s"), F.count("*").alias("n"), F.min("dur_us").alias("lo"), F.max("dur_us").alias("hi"))
    sizes = F.array(*map(F.lit, (1, 24, 168, 8760)))
    rows = steps.withColumn("size", F.explode(sizes)).groupBy("sensor_id", "size", F.floor(c("step") / c("size")).cast("bigint").alias("slot")).agg(F.sum("s").alias("s"), F.sum("n").alias("n"), F.min("lo").alias("v_min"), F.max("hi").alias("v_max"))
    latest = rows.groupBy("sensor_id", "size").agg(F.max("slot").alias("latest"))
    return rows.join(latest, ["sensor_id", "size"]).where(c("slot") > c("latest") - RRD_ROWS).select("sensor_id", "size", "slot", r6(c("s") / c("n") / S).alias("v_avg"), "v_min", "v_max")


def retention_running_sum(spark: SparkSession, sf_dir: str, limit: int = 8_000_000) -> DataFrame:
    """Days to drop, oldest first, until what is newer fits a size. Days are summed first; there are few."""
    days = table(spark, sf_dir, "orders").groupBy(F.expr("unix_micros(cast(o_orderdate AS timestamp)) div 86400000000").alias("day")).agg(F.sum(F.floor("o_totalprice").cast("bigint")).alias("size"), F.count("*").alias("files"))
    newer = F.sum("size").over(W.orderBy(F.desc("day")).rowsBetween(W.unboundedPreceding, 0))
    return days.withColumn("kept_size", newer).where(c("kept_size") > limit).select("day", "size", "files")


def retention_by_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows older than each table's days, counted back from the newest."""
    o = table(spark, sf_dir, "orders").select(F.expr("unix_micros(cast(o_orderdate AS timestamp)) div 86400000000").alias("day"), "o_orderpriority")
    newest = o.agg(F.max("day").alias("newest"))
    days = F.when(c("o_orderpriority").startswith("1"), 71).when(c("o_orderpriority").startswith("2"), 2).otherwise(30)
    return o.crossJoin(F.broadcast(newest)).groupBy("o_orderpriority").agg(F.count_if(c("day") < c("newest") - days).alias("dropped"), F.count_if(c("day") >= c("newest") - days).alias("kept"))


def spool_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes by part and sensor with subtotals and a total."""
    o = table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderpriority", F.floor("o_totalprice").cast("bigint").alias("size"))
    return o.rollup("o_orderpriority", "o_orderstatus").agg(F.sum("size").alias("size"), F.count("*").alias("files"), F.grouping_id().cast("int").alias("level"))


QUERIES = {f.__name__: f for f in (rtp_stat_10s, flow_rollup, traffic_in_out, register_failed_minute, active_registrations, rrd_rollup, retention_running_sum, retention_by_age, spool_sizes)}

ORACLE_SQL = {
    "rtp_stat_10s": f"""SELECT saddr, t_us // 10000000 * 10 AS bucket, count(*) AS n, max(jitter_x10) AS jitter_max, round(CAST(sum(jitter_x10) AS DOUBLE) / count(*), 6) AS jitter_avg,
  round(max(CAST(lost AS DOUBLE) / (received + 2 + lost) * 100), 6) AS loss_max, sum(lost) AS lost FROM {CDR_RTP} GROUP BY saddr, t_us // 10000000 * 10""",
    "flow_rollup": f"SELECT src_ip, dst_ip, codec, b_us // 300000000 * 300 AS bucket, sum(dur_us) AS octets, count(*) AS packets FROM {CDR} GROUP BY src_ip, dst_ip, codec, b_us // 300000000 * 300",
    "traffic_in_out": f"""WITH e AS (SELECT src_ip AS ip, dur_us AS o, 0 AS i, b_us FROM {CDR} UNION ALL SELECT dst_ip, 0, dur_us, b_us FROM {CDR}),
g AS (SELECT 'interval' AS grain, b_us // 300000000 * 300 AS bucket, * FROM e UNION ALL SELECT 'hour', b_us // 3600000000 * 3600, * FROM e UNION ALL SELECT 'day', b_us // 86400000000 * 86400, * FROM e)
SELECT grain, bucket, ip, sum(o) AS octets_out, sum(i) AS octets_in, count(*) AS flows FROM g GROUP BY grain, bucket, ip""",
    "register_failed_minute": f"""SELECT sensor_id, src_ip, dst_ip, b_us // 60000000 * 60 AS bucket, least(count(*), 1000) AS counter, greatest(count(*) - 1000, 0) AS counter_2 FROM {CDR} WHERE lsr >= 400
GROUP BY sensor_id, src_ip, dst_ip, b_us // 60000000 * 60""",
    "active_registrations": f"""SELECT sensor_id, count(*) FILTER (WHERE lsr = 200) AS active, count(*) AS known FROM (SELECT sensor_id, caller, lsr, row_number() OVER (PARTITION BY sensor_id, caller ORDER BY b_us DESC, call_id DESC) AS rn FROM {CDR})
WHERE rn = 1 GROUP BY sensor_id""",
    "rrd_rollup": f"""WITH s AS (SELECT sensor_id, size, b_us // 300000000 // size AS slot, dur_us FROM {CDR}, (VALUES (1), (24), (168), (8760)) AS z(size)),
r AS (SELECT sensor_id, size, slot, round(CAST(sum(dur_us) AS DOUBLE) / count(*) / 1000000, 6) AS v_avg, min(dur_us) AS v_min, max(dur_us) AS v_max FROM s GROUP BY sensor_id, size, slot)
SELECT sensor_id, size, slot, v_avg, v_min, v_max FROM (SELECT *, max(slot) OVER (PARTITION BY sensor_id, size) AS latest FROM r) WHERE slot > latest - 760""",
    "retention_running_sum": """SELECT day, size, files FROM (SELECT *, sum(size) OVER (ORDER BY day DESC ROWS UNBOUNDED PRECEDING) AS kept_size FROM (SELECT epoch_us(o_orderdate) // 86400000000 AS day,
  sum(CAST(floor(o_totalprice) AS BIGINT)) AS size, count(*) AS files FROM orders GROUP BY 1)) WHERE kept_size > 8000000""",
    "retention_by_age": """WITH o AS (SELECT epoch_us(o_orderdate) // 86400000000 AS day, o_orderpriority, CASE WHEN o_orderpriority LIKE '1%' THEN 71 WHEN o_orderpriority LIKE '2%' THEN 2 ELSE 30 END AS days FROM orders)
SELECT o_orderpriority, count(*) FILTER (WHERE day < newest - days) AS dropped, count(*) FILTER (WHERE day >= newest - days) AS kept FROM o, (SELECT max(day) AS newest FROM o) GROUP BY o_orderpriority""",
    "spool_sizes": """WITH o AS (SELECT o_orderpriority, o_orderstatus, CAST(floor(o_totalprice) AS BIGINT) AS size FROM orders)
SELECT o_orderpriority, o_orderstatus, sum(size) AS size, count(*) AS files, 0 AS level FROM o GROUP BY o_orderpriority, o_orderstatus
UNION ALL SELECT o_orderpriority, NULL, sum(size), count(*), 1 FROM o GROUP BY o_orderpriority UNION ALL SELECT NULL, NULL, sum(size), count(*), 3 FROM o""",
}
