"""Alert rules in batch form. Their streaming twins are in tallyline.streaming.

Rules that restart their own windows use tallyline.operators.anchored; counts of what is going on at once use running sums.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.functions import semantics as X
from tallyline.operators.anchored import anchored
from tallyline.operators.intervals import S
from tallyline.operators.sequences import plus_minus, running
from tallyline.sources.calls import CDR, cdr

c = F.col


def judged(rows: DataFrame, keys: list[str], length_us: int, limit: int) -> DataFrame:
    """Windows that begin with a key's first event and are judged at its first event past the length.

    That event is still counted; the next one begins a new window.
    """
    w = anchored(rows.select(*keys, "b_us", "call_id"), keys, "b_us", "call_id", length_us, closes=True)
    return w.where((c("b_us") > c("begin_us") + length_us) & (c("n") >= limit)).select(*keys, "begin_us", c("b_us").alias("judged_us"), "n")


def fraud_packet_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source addresses with at least 3 events in a window of six hours that begins at their first event."""
    return judged(cdr(spark, sf_dir), ["src_ip"], 6 * 3600 * S, 3)


def fraud_register_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over registrations, which are the signup events here."""
    return judged(cdr(spark, sf_dir).where("event_type = 'signup'"), ["src_ip"], 24 * 3600 * S, 2)


def fraud_sequential(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated calls from one address to one destination, international ones only."""
    return judged(cdr(spark, sf_dir).where("called LIKE '00%'"), ["src_ip", "dst_ip"], 5 * 86400 * S, 3)


def suppressed(alerts: DataFrame, keys: list[str], t: str, tie: str, hours: int) -> DataFrame:
    """Alerts of one key at most once in so many hours, counted from the last one that was raised."""
    columns = alerts.columns
    return anchored(alerts, keys, t, tie, hours * 3600 * S, at_end=True).where("n = 1").select(*columns)


def suppress_repeats(spark: SparkSession, sf_dir: str, hours: int = 12) -> DataFrame:
    return suppressed(cdr(spark, sf_dir).where("lsr >= 400").select("caller", "b_us", "call_id"), ["caller"], "b_us", "call_id", hours)


def fraud_concurrent_calls(spark: SparkSession, sf_dir: str, limit: int = 3) -> DataFrame:
    """Begins of calls at which a sensor has at least `limit` calls at once: local, international and both."""
    calls = cdr(spark, sf_dir).withColumn("scope", F.when(X.like(c("called"), "420%"), "local").otherwise("international"))
    split = running(plus_minus(calls, ["sensor_id", "scope"]), ["sensor_id", "scope"])
    whole = running(plus_minus(calls, ["sensor_id"]), ["sensor_id"]).withColumn("scope", F.lit("both"))
    return split.unionByName(whole).where((c("d") == 1) & (c("n") >= limit)).groupBy("sensor_id", "scope").agg(F.count("*").alias("alerts"), F.max("n").alias("most"), F.min("t").alias("first_us"))


def fraud_concurrent_streams(spark: SparkSession, sf_dir: str, limit: int = 2) -> DataFrame:
    """The same by unordered pairs of address groups."""
    a, b = F.shiftright("src_ip", 6), F.shiftright("dst_ip", 3)
    calls = cdr(spark, sf_dir).where("a_rtp OR b_rtp").withColumn("ip_a", F.least(a, b)).withColumn("ip_b", F.greatest(a, b))
    n = running(plus_minus(calls, ["ip_a", "ip_b"]), ["ip_a", "ip_b"])
    return n.where((c("d") == 1) & (c("n") >= limit)).groupBy("ip_a", "ip_b").agg(F.count("*").alias("alerts"), F.max("n").alias("most"))


def fraud_time_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concurrent calls with another limit in each of two periods of the day."""
    n = running(plus_minus(cdr(spark, sf_dir), ["sensor_id"]), ["sensor_id"]).where("d = 1")
    hour = F.floor(c("t") / (3600 * S)) % 24
    limit = F.when(X.hour_gate(hour, 22, 5), 2).when(X.hour_gate(hour, 6, 21), 4)
    return n.where(c("n") >= limit).groupBy("sensor_id", limit.alias("period_limit")).agg(F.count("*").alias("alerts"))


def fraud_destination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls to listed countries by caller and destination: alerts, and their first time."""
    listed = X.number_matches(c("called"), ["0049%", "001%"])
    return cdr(spark, sf_dir).where(listed & (c("lsr") == 200)).groupBy("caller", "called").agg(F.count("*").alias("n"), F.min("b_us").alias("first_us"))


QUERIES = {f.__name__: f for f in (fraud_packet_window, fraud_register_count, fraud_sequential, suppress_repeats, fraud_concurrent_calls, fraud_concurrent_streams, fraud_time_periods, fraud_destination)}


def _anchored_sql(keys: list[str], where: str, length_us: int, limit: int) -> str:
    """The fold as a recursion over each key's rows."""
    k, on = ", ".join(keys), " AND ".join(f"r.{x} = w.{x}" for x in keys)
    rk = ", ".join(f"r.{x}" for x in keys)
    return f"""WITH RECURSIVE r AS (SELECT {k}, b_us, row_number() OVER (PARTITION BY {k} ORDER BY b_us, call_id) AS rn FROM {CDR} WHERE {where}),
w AS (SELECT {k}, rn, b_us AS begin_us, CAST(1 AS BIGINT) AS n, false AS closed, b_us FROM r WHERE rn = 1
 UNION ALL SELECT {rk}, r.rn, CASE WHEN w.closed THEN r.b_us ELSE w.begin_us END, CASE WHEN w.closed THEN 1 ELSE w.n + 1 END, NOT w.closed AND r.b_us > w.begin_us + {length_us}, r.b_us FROM w JOIN r ON {on} AND r.rn = w.rn + 1)
SELECT {k}, begin_us, b_us AS judged_us, n FROM w WHERE closed AND n >= {limit}"""


def _running_sql(keys: str, rows: str) -> str:
    return f"""(SELECT {keys}, t, d, sum(d) OVER (PARTITION BY {keys} ORDER BY t, d ROWS UNBOUNDED PRECEDING) AS n FROM (SELECT {keys}, b_us AS t, 1 AS d FROM {rows} UNION ALL SELECT {keys}, e_us, -1 FROM {rows}))"""


_SCOPED = f"(SELECT *, CASE WHEN called LIKE '420%' THEN 'local' ELSE 'international' END AS scope FROM {CDR})"
_PAIRS = f"(SELECT *, least(dst_ip >> 3, src_ip >> 6) AS ip_a, greatest(dst_ip >> 3, src_ip >> 6) AS ip_b FROM {CDR} WHERE a_rtp OR b_rtp)"

ORACLE_SQL = {
    "fraud_packet_window": _anchored_sql(["src_ip"], "true", 6 * 3600 * S, 3),
    "fraud_register_count": _anchored_sql(["src_ip"], "event_type = 'signup'", 24 * 3600 * S, 2),
    "fraud_sequential": _anchored_sql(["src_ip", "dst_ip"], "called LIKE '00%'", 5 * 86400 * S, 3),
    "suppress_repeats": f"""WITH RECURSIVE r AS (SELECT caller, b_us, call_id, row_number() OVER (PARTITION BY caller ORDER BY b_us, call_id) AS rn FROM {CDR} WHERE lsr >= 400),
w AS (SELECT caller, b_us, call_id, rn, b_us AS last_us, true AS raised FROM r WHERE rn = 1
 UNION ALL SELECT r.caller, r.b_us, r.call_id, r.rn, CASE WHEN r.b_us < w.last_us + 43200000000 THEN w.last_us ELSE r.b_us END, r.b_us >= w.last_us + 43200000000 FROM w JOIN r ON r.caller = w.caller AND r.rn = w.rn + 1)
SELECT caller, b_us, call_id FROM w WHERE raised""",
    "fraud_concurrent_calls": f"""SELECT sensor_id, scope, count(*) AS alerts, max(n) AS most, min(t) AS first_us FROM (SELECT sensor_id, scope, t, d, n FROM {_running_sql('sensor_id, scope', _SCOPED)}
  UNION ALL SELECT sensor_id, 'both', t, d, n FROM {_running_sql('sensor_id', CDR)}) WHERE d = 1 AND n >= 3 GROUP BY sensor_id, scope""",
    "fraud_concurrent_streams": f"SELECT ip_a, ip_b, count(*) AS alerts, max(n) AS most FROM {_running_sql('ip_a, ip_b', _PAIRS)} WHERE d = 1 AND n >= 2 GROUP BY ip_a, ip_b",
    "fraud_time_periods": f"""SELECT sensor_id, period_limit, count(*) AS alerts FROM (SELECT *, CASE WHEN t // 3600000000 % 24 >= 22 OR t // 3600000000 % 24 <= 5 THEN 2 ELSE 4 END AS period_limit FROM {_running_sql('sensor_id', CDR)} WHERE d = 1)
WHERE n >= period_limit GROUP BY sensor_id, period_limit""",
    "fraud_destination": f"SELECT caller, called, count(*) AS n, min(b_us) AS first_us FROM {CDR} WHERE (called LIKE '0049%' OR called LIKE '001%') AND lsr = 200 GROUP BY caller, called",
}
