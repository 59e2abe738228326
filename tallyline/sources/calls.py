"""Call records derived from the driver's tables, as DataFrames and as the same views in DuckDB SQL.

Every column is an expression on its own row, so scans stay pruned and nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.session import table

#: 10.0.0.0 and 192.168.0.0 as numbers.
CALLER_NET, CALLED_NET = 167772160, 3232235520


def micros(column: str) -> Column:
    return F.unix_micros(F.col(column).cast("timestamp"))


def cdr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Call records from the table of events."""
    return calls(table(spark, sf_dir, "events"))


def calls(e: DataFrame) -> DataFrame:
    """Call records from events, of a table or a stream."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    base = e.select(
        F.col("event_id").alias("call_id"),
        "user_id",
        "event_type",
        "value",
        micros("ts").alias("b_us"),
        F.round(F.col("value") * 1000000).cast("bigint").alias("dur_us"),
        k.alias("k"),
    )
    prefix = F.element_at(F.array(*map(F.lit, ("0049", "0044", "420", "001"))), (F.col("k") % 4 + 1).cast("int"))
    lsr = F.when(F.col("event_type") == "signup", 486).when(F.col("event_type") == "error", F.element_at(F.array(*map(F.lit, (503, 404, 301))), (F.col("k") % 3 + 1).cast("int"))).otherwise(200)
    return base.select(
        "*",
        (F.col("b_us") + F.col("dur_us")).alias("e_us"),
        (F.col("user_id") % 4).alias("sensor_id"),
        F.concat(F.lit("420"), F.lpad(F.col("user_id").cast("string"), 6, "0")).alias("caller"),
        F.concat(prefix, F.lpad(F.col("k").cast("string"), 6, "0")).alias("called"),
        (F.lit(CALLER_NET) + F.col("user_id")).alias("src_ip"),
        (F.lit(CALLED_NET) + F.col("k") % 16).alias("dst_ip"),
        lsr.alias("lsr"),
        F.when(lsr == 200, F.expr("dur_us div 5 * 4")).alias("connect_us"),
        F.element_at(F.array(*map(F.lit, (0, 8, 18))), (F.col("k") % 3 + 1).cast("int")).alias("codec"),
        F.when(F.col("k") % 10 == 0, 1).when(F.col("k") % 10 == 1, 2).when(F.col("k") % 10 == 2, 102).otherwise(3).alias("bye"),
        F.greatest(F.lit(10).cast("bigint"), F.lit(45) - F.expr("dur_us div 10000000")).alias("mos_x10"),
        (F.col("k") % 5 != 0).alias("a_rtp"),
        (F.col("k") % 7 != 0).alias("b_rtp"),
        F.concat(F.lit("ua"), (F.col("user_id") % 5).cast("string")).alias("ua"),
    )


CDR = """(SELECT *, b_us + dur_us AS e_us, user_id % 4 AS sensor_id, '420' || lpad(CAST(user_id AS VARCHAR), 6, '0') AS caller,
  (CASE k % 4 WHEN 0 THEN '0049' WHEN 1 THEN '0044' WHEN 2 THEN '420' ELSE '001' END) || lpad(CAST(k AS VARCHAR), 6, '0') AS called,
  167772160 + user_id AS src_ip, 3232235520 + k % 16 AS dst_ip,
  CASE WHEN lsr = 200 THEN dur_us // 5 * 4 END AS connect_us,
  CASE k % 3 WHEN 0 THEN 0 WHEN 1 THEN 8 ELSE 18 END AS codec,
  CASE k % 10 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 102 ELSE 3 END AS bye,
  greatest(10, 45 - dur_us // 10000000) AS mos_x10, k % 5 <> 0 AS a_rtp, k % 7 <> 0 AS b_rtp, 'ua' || CAST(user_id % 5 AS VARCHAR) AS ua
 FROM (SELECT *, CASE WHEN event_type = 'signup' THEN 486 WHEN event_type = 'error' THEN (CASE k % 3 WHEN 0 THEN 503 WHEN 1 THEN 404 ELSE 301 END) ELSE 200 END AS lsr
  FROM (SELECT event_id AS call_id, user_id, event_type, value, epoch_us(ts) AS b_us, CAST(round(value * 1000000) AS BIGINT) AS dur_us,
    CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)))"""


def cdr_rtp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Media streams of calls from lineitem."""
    li = table(spark, sf_dir, "lineitem")
    received = (F.col("l_quantity") * 100).cast("bigint")
    return li.select(
        F.col("l_orderkey").alias("cdr_id"),
        F.col("l_linenumber").alias("idx"),
        (F.lit(CALLED_NET) + F.col("l_suppkey")).alias("saddr"),
        F.col("l_partkey").alias("ssrc"),
        received.alias("received"),
        F.round(F.col("l_quantity") * 100 * F.col("l_discount")).cast("bigint").alias("lost"),
        F.round(F.col("l_tax") * 1000).cast("bigint").alias("jitter_x10"),
        F.expr("unix_micros(cast(l_shipdate AS timestamp))").alias("t_us"),
    )


CDR_RTP = """(SELECT l_orderkey AS cdr_id, l_linenumber AS idx, 3232235520 + l_suppkey AS saddr, l_partkey AS ssrc,
  CAST(l_quantity * 100 AS BIGINT) AS received, CAST(round(l_quantity * 100 * l_discount) AS BIGINT) AS lost,
  CAST(round(l_tax * 1000) AS BIGINT) AS jitter_x10, epoch_us(l_shipdate) AS t_us FROM lineitem)"""


def cdr_billing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls to rate, from orders and their customers."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return o.join(c, o["o_custkey"] == c["c_custkey"]).select(
        F.col("o_orderkey").alias("id"),
        F.col("c_custkey").alias("customer_id"),
        F.col("c_mktsegment").alias("domain"),
        F.col("c_nationkey").alias("nation"),
        F.expr("unix_micros(cast(o_orderdate AS timestamp))").alias("calldate_us"),
        (F.lit(1) + F.floor("o_totalprice").cast("bigint") % 3600).alias("dur_s"),
        F.col("o_orderpriority").alias("number_class"),
    )


CDR_BILLING = """(SELECT o_orderkey AS id, c_custkey AS customer_id, c_mktsegment AS domain, c_nationkey AS nation, epoch_us(o_orderdate) AS calldate_us,
  1 + CAST(floor(o_totalprice) AS BIGINT) % 3600 AS dur_s, o_orderpriority AS number_class FROM orders JOIN customer ON o_custkey = c_custkey)"""

# Small dimensions that the queries look things up in.
COUNTRY_PREFIXES = [("49", "DE"), ("44", "GB"), ("4400", "GB-L"), ("420", "CZ"), ("1", "US"), ("10", "US-L")]
GEO_RANGES = [(167772160, 167772191, "DE"), (167772192, 167772223, "GB"), (167772224, 167772287, "CZ"), (167772240, 167772250, "CZ-P"), (167772288, 167837695, "US")]
IP_GROUPS = [(167772160, 27, "clients"), (167772160, 24, "site"), (167772192, 27, "servers"), (3232235520, 29, "trunks"), (3232235520, 16, "lan")]
BILLING_RULES = [(1, 0.6, 1.2, 60, 1), (2, 1.2, 2.4, 30, 30), (3, 0.9, 1.5, 60, 6)]
BILLING_ASSIGNMENTS = [(1, 1, 167772160, 167772223, None, None), (2, 2, None, None, "0049", None), (3, 3, 167772160, 167772175, "0044", None), (4, 1, None, None, "0044", "ua1"), (5, 2, None, None, None, "ua2")]


def small(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A dimension written out above; its size is fixed, so it may be broadcast."""
    return F.broadcast(spark.createDataFrame(rows, schema))


def values(rows: list[tuple], names: str) -> str:
    """The same dimension as a DuckDB table expression."""
    one = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)
    return f"(VALUES {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) AS {names}"
