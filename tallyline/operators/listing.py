"""Listings, encodings and the smaller rules: JSON series, sessions, restarting counters, periods and message rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyline.functions import semantics as X
from tallyline.functions.json_filter import call_filter
from tallyline.operators.anchored import anchored
from tallyline.operators.intervals import QUARTER, QUARTERS, S, counted_to, quarters, r6
from tallyline.operators.sequences import previous
from tallyline.session import table
from tallyline.sources.calls import CDR, cdr

c = F.col


def chart_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series values as JSON by quarter: counts by response, and counts by ordinal."""
    q = quarters(cdr(spark, sf_dir))
    as_json = lambda key: F.concat(F.lit("{"), F.array_join(F.array_sort(F.collect_list(F.concat(F.lit('"'), c(key), F.lit('":'), c("n").cast("string")))), ","), F.lit("}"))
    area = q.where("first").groupBy("bucket", c("lsr").cast("string").alias("key")).agg(F.count("*").alias("n")).groupBy("bucket").agg(as_json("key").alias("area"))
    ordinals = q.groupBy("bucket", c("ordinal").cast("string").alias("key")).agg(F.count("*").alias("n")).groupBy("bucket").agg(as_json("key").alias("ordinals"))
    return ordinals.join(area, "bucket", "left")


def chart_value_combination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The combined value encoding of a series: most, least, sum, count, percentiles (p5 of 95 and p9 of 99 percent, from
    the best value down), and the value histogram, as a struct in JSON."""
    rows = cdr(spark, sf_dir).where("mos_x10 <> 0").withColumn("bucket", F.expr("b_us div 86400000000 * 86400"))
    v = rows.groupBy("bucket", "mos_x10").agg(F.count("*").alias("n"))
    entry = F.concat(F.lit('"'), c("mos_x10").cast("string"), F.lit('":'), c("n").cast("string"))
    w = W.partitionBy("bucket")  # at most one row for each value of the scale
    v = v.withColumn("_to", F.sum("n").over(w.orderBy(F.desc("mos_x10")).rowsBetween(W.unboundedPreceding, 0))).withColumn("_all", F.sum("n").over(w))
    at = lambda p: F.least(F.round(c("_all") * p / 100.0).cast("bigint"), c("_all") - 1)
    rank = lambda p: F.max(F.when((c("_to") > at(p)) & (c("_to") - c("n") <= at(p)), c("mos_x10")))
    return v.groupBy("bucket").agg(
        rank(95).alias("p5"), rank(99).alias("p9"),
        F.max("mos_x10").alias("m"), F.min("mos_x10").alias("i"), F.sum(c("mos_x10") * c("n")).alias("s"), F.sum("n").alias("c"), F.concat(F.lit("{"), F.array_join(F.array_sort(F.collect_list(entry)), ","), F.lit("}")).alias("vm")
    )


def histogram_reduced(spark: SparkSession, sf_dir: str, parts: int = 50) -> DataFrame:
    """A value histogram made smaller: if there are at least twice as many distinct values as parts, each run of
    (values div parts) neighbours merges to its weighted mean."""
    v = cdr(spark, sf_dir).groupBy("event_type", "value").agg(F.count("*").alias("n"))
    ranked = counted_to(v.withColumn("_n", F.lit(1)), ["event_type"], "value")
    run = F.greatest(F.lit(1), F.floor(c("_all") / parts))
    ranked = ranked.withColumn("part", F.floor((c("_to") - 1) / run).cast("bigint"))
    return ranked.groupBy("event_type", "part").agg(r6(F.sum(c("value") * c("n")) / F.sum("n")).alias("value"), F.sum("n").alias("n"))


def filter_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filter given as a JSON-like record."""
    spec = {"caller": ["%0042", "%0017"], "caller_type": "0", "response": {"white": ["2", "4"], "black": ["404"]}, "codec": [0, 8], "connected": None, "duration": [5, 300]}
    return cdr(spark, sf_dir).where(call_filter(spec)).select("call_id", "caller", "called", "lsr", "codec")


def in_period(at: Column, hours: tuple[int, int], weekdays: tuple[int, int], days: tuple[int, int], months: tuple[int, int]) -> Column:
    """Hour, weekday (Monday 0), day and month ranges, each of which may wrap."""
    return X.all_of(X.hour_gate(F.hour(at), *hours), X.hour_gate(F.weekday(at), *weekdays), X.hour_gate(F.dayofmonth(at), *days), X.hour_gate(F.month(at), *months))


def period_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.timestamp_seconds(c("b_us") / S)
    inside = in_period(at, (20, 6), (5, 1), (25, 10), (12, 2))
    return cdr(spark, sf_dir).groupBy("sensor_id").agg(F.count_if(inside).alias("inside"), F.count_if(~inside).alias("outside"))


def message_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages are stored as digests unless a rule on header or content keeps the text."""
    t = table(spark, sf_dir, "conversations")
    keep = c("role").rlike("^sys") | c("text").rlike("(?i)^the ")
    return t.select("conv_id", "turn", F.when(keep, c("text")).otherwise(F.sha2("text", 256)).alias("stored"), keep.alias("plain"))


def send_call_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a notification rule sends: the first matching call of each caller, with its parameters."""
    hits = cdr(spark, sf_dir).where(X.any_of(X.number_matches(c("called"), ["0044%"]), X.network(c("dst_ip"), 30) == 3232235524))
    first = hits.groupBy("caller").agg(F.min_by(F.struct("call_id", "called", "src_ip"), F.struct("b_us", "call_id")).alias("x"), F.count("*").alias("matches"))
    return first.select("caller", "x.call_id", F.concat(F.lit("caller="), c("caller"), F.lit("&called="), c("x.called"), F.lit("&ip="), X.inet_ntoa(c("x.src_ip"))).alias("parameters"), "matches")


def counter_restart(spark: SparkSession, sf_dir: str, interval_s: int = 86_400) -> DataFrame:
    """Counters by address that begin anew with the first event after their interval."""
    rows = cdr(spark, sf_dir).select("src_ip", "b_us", "call_id")
    return anchored(rows, ["src_ip"], "b_us", "call_id", interval_s * S).select("src_ip", "call_id", "begin_us", "n")


def session_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of each caller: events with gaps of less than six hours."""
    calls = cdr(spark, sf_dir).withColumn("at", F.timestamp_micros("b_us"))
    s = calls.groupBy("caller", F.session_window("at", "6 hours").alias("w")).agg(F.count("*").alias("n"))
    return s.select("caller", F.unix_micros("w.start").alias("begin_us"), "n")


def change_country_register(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The country rule on registrations, here signups: country and address differ from the last ones."""
    r = cdr(spark, sf_dir).where("event_type = 'signup'").withColumn("country", F.expr("k div 16 % 4"))
    r = previous(r, ["caller"], ["country", "dst_ip"])
    return r.where("previous.country <> country AND previous.dst_ip <> dst_ip").select("call_id", "caller", c("previous.country").alias("old_country"), "country")


QUERIES = {
    f.__name__: f
    for f in (chart_json, chart_value_combination, histogram_reduced, filter_json, period_gate, message_hash, send_call_info, counter_restart, session_counts, change_country_register)
}

def _wraps(value: str, begin: int, end: int) -> str:
    return f"({value} BETWEEN {begin} AND {end})" if begin <= end else f"({value} >= {begin} OR {value} <= {end})"


_AT = "make_timestamp(b_us)"
_INSIDE = " AND ".join((_wraps("b_us // 3600000000 % 24", 20, 6), _wraps("(b_us // 86400000000 + 3) % 7", 5, 1), _wraps(f"day({_AT})", 25, 10), _wraps(f"month({_AT})", 12, 2)))

ORACLE_SQL = {
    "chart_json": f"""WITH a AS (SELECT bucket, '{{' || string_agg('"' || key || '":' || n, ',' ORDER BY '"' || key || '":' || n) || '}}' AS area FROM (SELECT bucket, CAST(lsr AS VARCHAR) AS key, count(*) AS n FROM {QUARTERS} WHERE first GROUP BY 1, 2) GROUP BY bucket),
o AS (SELECT bucket, '{{' || string_agg('"' || key || '":' || n, ',' ORDER BY '"' || key || '":' || n) || '}}' AS ordinals FROM (SELECT bucket, CAST(ordinal AS VARCHAR) AS key, count(*) AS n FROM {QUARTERS} GROUP BY 1, 2) GROUP BY bucket)
SELECT o.bucket, o.ordinals, a.area FROM o LEFT JOIN a ON o.bucket = a.bucket""",
    "chart_value_combination": f"""WITH r AS (SELECT bucket, mos_x10, row_number() OVER (PARTITION BY bucket ORDER BY mos_x10 DESC) - 1 AS rn, count(*) OVER (PARTITION BY bucket) AS c FROM (SELECT *, b_us // 86400000000 * 86400 AS bucket FROM {CDR}) WHERE mos_x10 <> 0),
p AS (SELECT bucket, max(CASE WHEN rn = least(CAST(round(c * 95 / 100.0) AS BIGINT), c - 1) THEN mos_x10 END) AS p5, max(CASE WHEN rn = least(CAST(round(c * 99 / 100.0) AS BIGINT), c - 1) THEN mos_x10 END) AS p9 FROM r GROUP BY bucket)
SELECT bucket, max(mos_x10) AS m, min(mos_x10) AS i, sum(mos_x10 * n) AS s, sum(n) AS c, any_value(p5) AS p5, any_value(p9) AS p9, '{{' || string_agg('"' || mos_x10 || '":' || n, ',' ORDER BY '"' || mos_x10 || '":' || n) || '}}' AS vm
FROM (SELECT bucket, mos_x10, count(*) AS n FROM r GROUP BY 1, 2) JOIN p USING (bucket) GROUP BY bucket""",
    "histogram_reduced": f"""SELECT event_type, part, round(sum(value * n) / sum(n), 6) AS value, sum(n) AS n FROM (SELECT *, CASE WHEN distinct_values // 50 > 1 THEN (rn - 1) // (distinct_values // 50) ELSE rn - 1 END AS part
  FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value) AS rn, count(*) OVER (PARTITION BY event_type) AS distinct_values FROM (SELECT event_type, value, count(*) AS n FROM {CDR} GROUP BY event_type, value)))
GROUP BY event_type, part""",
    "filter_json": f"""SELECT call_id, caller, called, lsr, codec FROM {CDR} WHERE (caller LIKE '%0042' OR caller LIKE '%0017' OR called LIKE '%0042' OR called LIKE '%0017') AND lsr // 100 IN (2, 4) AND lsr <> 404 AND codec IN (0, 8)
  AND dur_us BETWEEN 5000000 AND 300000000""",
    "period_gate": f"SELECT sensor_id, count(*) FILTER (WHERE {_INSIDE}) AS inside, count(*) FILTER (WHERE NOT ({_INSIDE})) AS outside FROM {CDR} GROUP BY sensor_id",
    "message_hash": "SELECT conv_id, turn, CASE WHEN plain THEN text ELSE sha256(text) END AS stored, plain FROM (SELECT *, starts_with(role, 'sys') OR starts_with(lower(text), 'the ') AS plain FROM conversations)",
    "send_call_info": f"""SELECT caller, call_id, 'caller=' || caller || '&called=' || called || '&ip=' || (src_ip >> 24) || '.' || ((src_ip >> 16) & 255) || '.' || ((src_ip >> 8) & 255) || '.' || (src_ip & 255) AS parameters, matches
FROM (SELECT *, count(*) OVER (PARTITION BY caller) AS matches, row_number() OVER (PARTITION BY caller ORDER BY b_us, call_id) AS rn FROM {CDR} WHERE called LIKE '0044%' OR dst_ip // 4 * 4 = 3232235524) WHERE rn = 1""",
    "counter_restart": f"""WITH RECURSIVE r AS (SELECT src_ip, call_id, b_us, row_number() OVER (PARTITION BY src_ip ORDER BY b_us, call_id) AS rn FROM {CDR}),
w AS (SELECT src_ip, call_id, rn, b_us AS begin_us, CAST(1 AS BIGINT) AS n FROM r WHERE rn = 1
 UNION ALL SELECT r.src_ip, r.call_id, r.rn, CASE WHEN r.b_us <= w.begin_us + 86400000000 THEN w.begin_us ELSE r.b_us END, CASE WHEN r.b_us <= w.begin_us + 86400000000 THEN w.n + 1 ELSE 1 END FROM w JOIN r ON r.src_ip = w.src_ip AND r.rn = w.rn + 1)
SELECT src_ip, call_id, begin_us, n FROM w""",
    "session_counts": f"""SELECT caller, min(b_us) AS begin_us, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY caller ORDER BY b_us, call_id ROWS UNBOUNDED PRECEDING) AS s
  FROM (SELECT *, CASE WHEN b_us - lag(b_us) OVER (PARTITION BY caller ORDER BY b_us, call_id) < 21600000000 THEN 0 ELSE 1 END AS fresh FROM {CDR})) GROUP BY caller, s""",
    "change_country_register": f"""SELECT call_id, caller, old_country, country FROM (SELECT *, lag(country) OVER w AS old_country, lag(dst_ip) OVER w AS old_ip FROM (SELECT *, k // 16 % 4 AS country FROM {CDR} WHERE event_type = 'signup')
  WINDOW w AS (PARTITION BY caller ORDER BY b_us, call_id)) WHERE old_country <> country AND old_ip <> dst_ip""",
}
