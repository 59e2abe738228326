"""Interval metrics: how calls are assigned to time buckets, and what is measured in each bucket.

Totals are plain grouped aggregates. Per-second occupancy is not expanded to seconds: a call adds two events to each
bucket that it touches, and a running sum over these events gives runs of seconds with the same occupancy.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyline.sources.calls import CDR, cdr

S = 1_000_000
QUARTER = 900


def r6(c: Column) -> Column:
    return F.round(c, 6)


def end_second(e_us: Column) -> Column:
    """The second in which a call ends; a fraction of more than 1000 us counts as a started second."""
    return F.floor(e_us / S).cast("bigint") + F.when(e_us % S > 1000, 1).otherwise(0)


END_SECOND = "(e_us // 1000000 + CASE WHEN e_us % 1000000 > 1000 THEN 1 ELSE 0 END)"


def expand(calls: DataFrame, width: int, begin: Column, end: Column) -> DataFrame:
    """One row for each bucket that a call touches: bucket (its first second), ordinal, first and last."""
    a, b = F.floor(begin / width).cast("bigint"), F.floor(end / width).cast("bigint")
    out = calls.withColumn("_a", a).withColumn("_b", b).withColumn("_i", F.explode(F.sequence("_a", "_b")))
    return out.select(
        *calls.columns,
        (F.col("_i") * width).alias("bucket"),
        (F.col("_i") - F.col("_a")).alias("ordinal"),
        (F.col("_i") == F.col("_a")).alias("first"),
        (F.col("_i") == F.col("_b")).alias("last"),
    )


def quarters(calls: DataFrame) -> DataFrame:
    return expand(calls, QUARTER, F.floor(F.col("b_us") / S), end_second(F.col("e_us")))


def minutes(calls: DataFrame) -> DataFrame:
    return expand(calls, 60, F.floor(F.col("b_us") / S), F.floor(F.col("e_us") / S))


def expanded_sql(width: int, end: str) -> str:
    return f"""(SELECT c.*, i * {width} AS bucket, i - b_us // 1000000 // {width} AS ordinal, i = b_us // 1000000 // {width} AS first, i = {end} // {width} AS last
  FROM (SELECT *, unnest(generate_series(b_us // 1000000 // {width}, {end} // {width})) AS i FROM {CDR}) c)"""


QUARTERS, MINUTES = expanded_sql(QUARTER, END_SECOND), expanded_sql(60, "(e_us // 1000000)")


def minute_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls by minute: touching it, beginning, ending, and continuing from the minute before."""
    count = lambda c: F.count_if(c)
    return minutes(cdr(spark, sf_dir)).groupBy("bucket").agg(F.count("*").alias("touching"), count(F.col("first")).alias("began"), count(F.col("last")).alias("ended"), count(F.col("ordinal") == 1).alias("second_minute"))


def chart_minute(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chart series by (series, minute, sensor): all calls and connected calls. Each filter is one boolean column."""
    m = minutes(cdr(spark, sf_dir).withColumn("connected", F.col("connect_us").isNotNull()))
    series = m.withColumn("series", F.explode(F.when(F.col("connected"), F.array(F.lit("all"), F.lit("connected"))).otherwise(F.array(F.lit("all")))))
    return series.groupBy("series", "bucket", "sensor_id").agg(
        F.count("*").alias("touching"),
        F.count_if(F.col("first")).alias("total"),
        r6(F.sum(F.when(F.col("first"), F.col("dur_us"))) / S).alias("seconds"),
    )


#: Rows that a task should get, so that what it holds does not grow with the table; and rows of a key that are combined
#: before they meet in one task.
TASK_ROWS, HOT_ROWS = 20_000, 1_000_000


def dealt(rows: DataFrame, keys: list[str], bound: str) -> tuple[DataFrame, bool]:
    """rows dealt by keys to as many tasks as their number asks for, so that grouping by the keys needs no further exchange;
    and whether they were dealt.

    Where keys are almost one a row, hash tables before an exchange combine nothing and hold whatever a task reads. `bound`
    is one of the keys, of few values: no key has more rows than it. If one might have over HOT_ROWS, rows stay where they
    are, and aggregates combine them there.
    """
    sizes = rows.groupBy(bound).count().agg(F.sum("count").alias("n"), F.max("count").alias("most")).first()
    if (sizes["most"] or 0) > HOT_ROWS:
        return rows, False
    return rows.repartition(max(1, -(-(sizes["n"] or 0) // TASK_ROWS)), *keys), True


def overlap(calls: DataFrame, width: int = QUARTER) -> DataFrame:
    """Adds overlap_us: the connected part of a call, which ends when the call ends, inside the row's bucket."""
    begin = F.greatest(F.col("e_us") - F.col("connect_us"), F.col("bucket") * S)
    inside = F.greatest(F.lit(0), F.least(F.col("e_us"), (F.col("bucket") + width) * S) - begin)
    return calls.withColumn("overlap_us", F.when(F.col("connect_us").isNotNull(), inside))


def minutes_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connected minutes inside each quarter of an hour, and all connected minutes of every call that touches it."""
    q = overlap(quarters(cdr(spark, sf_dir).where("connect_us IS NOT NULL")))
    return q.groupBy("sensor_id", "bucket").agg(r6(F.sum("overlap_us") / (60 * S)).alias("minutes"), r6(F.sum("connect_us") / (60 * S)).alias("minutes_all"))


def occupancy(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Minimum, maximum and mean over the occupied seconds of each bucket, from rows with bucket, b_us and e_us."""
    start = F.greatest(F.floor(F.col("b_us") / S), F.col("bucket"))
    stop = F.least(end_second(F.col("e_us")), F.col("bucket") + QUARTER - 1) + 1  # inclusive
    events = rows.select(*keys, "bucket", F.explode(F.array(F.struct(start.alias("t"), F.lit(1).alias("d")), F.struct(stop.alias("t"), F.lit(-1).alias("d")))).alias("x"))
    steps = events.select(*keys, "bucket", "x.t", "x.d").groupBy(*keys, "bucket", "t").agg(F.sum("d").alias("d"))
    w = W.partitionBy(*keys, "bucket").orderBy("t")
    runs = steps.withColumn("n", F.sum("d").over(w.rowsBetween(W.unboundedPreceding, 0))).withColumn("seconds", F.lead("t").over(w) - F.col("t")).where("n > 0")
    return runs.groupBy(*keys, "bucket").agg(F.min("n").alias("cc_min"), F.max("n").alias("cc_max"), r6(F.sum(F.col("n") * F.col("seconds")) / F.sum("seconds")).alias("cc_avg"))


def concurrency_min_max_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return occupancy(quarters(cdr(spark, sf_dir)), ["sensor_id"])


def starts(calls: DataFrame, keys: list[str]) -> DataFrame:
    """Calls begun per second of each quarter: least (0 counts), most, and the mean over the whole width."""
    per_second = calls.groupBy(*keys, F.floor(F.col("b_us") / S).alias("t")).agg(F.count("*").alias("n"))
    bucket = (F.floor(F.col("t") / QUARTER) * QUARTER).cast("bigint").alias("bucket")
    return per_second.groupBy(*keys, bucket).agg(F.lit(0).cast("bigint").alias("cps_min"), F.max("n").alias("cps_max"), r6(F.sum("n") / QUARTER).alias("cps_avg"))


def cps_min_max_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return starts(cdr(spark, sf_dir), ["sensor_id"])


def value_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """count, sum, min, max, avg of the call's seconds by its first quarter; zeros are not measured."""
    c = cdr(spark, sf_dir).where("dur_us <> 0").withColumn("bucket", (F.floor(F.col("b_us") / (QUARTER * S)) * QUARTER).cast("bigint"))
    v = F.col("dur_us") / S
    return c.groupBy("bucket").agg(F.count("*").alias("n"), r6(F.sum("dur_us") / S).alias("v_sum"), r6(F.min(v)).alias("v_min"), r6(F.max(v)).alias("v_max"), r6(F.sum("dur_us") / F.count("*") / S).alias("v_avg"))


def counted_to(counted: DataFrame, keys: list[str], value: str, parts: int = 64) -> DataFrame:
    """Adds _to, the sum of _n over values up to the row's, and _all, for groups that may be large.

    Approximate quantiles cut a group into blocks of values; sums within the blocks run in parallel, and what comes
    before a block is a prefix sum over the few block totals. So the sums are exact whatever the cuts are.
    """
    cuts = counted.groupBy(*keys).agg(F.percentile_approx(value, [i / parts for i in range(1, parts)], 1000).alias("_cuts"))
    rows = counted.join(cuts, keys).withColumn("_block", F.size(F.filter("_cuts", lambda x: x < F.col(value)))).drop("_cuts")
    inner = W.partitionBy(*keys, "_block").orderBy(value).rowsBetween(W.unboundedPreceding, 0)
    blocks = W.partitionBy(*keys).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    totals = rows.groupBy(*keys, "_block").agg(F.sum("_n").alias("_sum"))
    totals = totals.withColumn("_before", F.coalesce(F.sum("_sum").over(blocks), F.lit(0))).withColumn("_all", F.sum("_sum").over(W.partitionBy(*keys)))
    return rows.withColumn("_to", F.sum("_n").over(inner)).join(totals.drop("_sum"), [*keys, "_block"]).withColumn("_to", F.col("_to") + F.col("_before")).drop("_block", "_before")


#: Groups that may have more rows than this are ordered in blocks.
BLOCK_ROWS = 1_000_000


def nearest_rank(rows: DataFrame, keys: list[str], value: str, percents: list[int], descending: bool = False, prefix: str = "perc", large: bool = False) -> DataFrame:
    """Nearest-rank percentiles: 0-based index least(round(n p / 100), n - 1) of the sorted values, or of the reverse.

    Equal values are counted first, so what is sorted in a group is its distinct values; with `large`, in blocks if a
    group has more than BLOCK_ROWS rows, which are counted.
    """
    counted = rows.groupBy(*keys, value).agg(F.count("*").alias("_n"))
    if large and (rows.groupBy(*keys).count().agg(F.max("count").alias("n")).first()["n"] or 0) > BLOCK_ROWS:
        counted = counted_to(counted, keys, value)
        if descending:
            counted = counted.withColumn("_to", F.col("_all") - F.col("_to") + F.col("_n"))
    else:
        order = F.desc(value) if descending else F.asc(value)
        counted = counted.withColumn("_to", F.sum("_n").over(W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, 0))).withColumn("_all", F.sum("_n").over(W.partitionBy(*keys)))
    pick = lambda p: F.least(F.round(F.col("_all") * p / 100.0).cast("bigint"), F.col("_all") - 1)
    hit = lambda p: (F.col("_to") > pick(p)) & (F.col("_to") - F.col("_n") <= pick(p))
    return counted.groupBy(*keys).agg(*(F.max(F.when(hit(p), F.col(value))).alias(f"{prefix}{p}") for p in percents))


def _nearest_rank_sql(rows: str, key: str, value: str, order: str) -> str:
    return f"""SELECT {key}, max(CASE WHEN rn = least(CAST(round(n * 95 / 100.0) AS BIGINT), n - 1) THEN {value} END) AS perc95,
  max(CASE WHEN rn = least(CAST(round(n * 99 / 100.0) AS BIGINT), n - 1) THEN {value} END) AS perc99
FROM (SELECT {key}, {value}, row_number() OVER (PARTITION BY {key} ORDER BY {value} {order}) - 1 AS rn, count(*) OVER (PARTITION BY {key}) AS n FROM {rows}) GROUP BY {key}"""


def perc95_nearest_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_rank(cdr(spark, sf_dir).where("value <> 0"), ["event_type"], "value", [95, 99], large=True)


def perc95_desc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For qualities, where the worst are the smallest: percentiles of the descending order."""
    return nearest_rank(cdr(spark, sf_dir).where("mos_x10 <> 0"), ["sensor_id"], "mos_x10", [95, 99], descending=True, large=True)


def lsr_matches(lsr: Column, whole: list[int], prefixes: list[str]) -> Column:
    """Whether a response code is listed or begins with one of the prefixes."""
    text = lsr.cast("string")
    found = lsr.isin(*whole)
    for p in prefixes:
        found |= text.startswith(p)
    return found


#: Codes and prefixes that count as an effective answer, and for the session ratio.
NER = ([600, 603, 604, 607, 608], ["2", "3", "4"])
SEER = [200, 480, 486, 600, 603]


def ratios() -> list[Column]:
    """asr, acd, ner, seer of a group of calls; a ratio of nothing is null."""
    connected = F.col("connect_us").isNotNull()
    not_3 = ~F.col("lsr").cast("string").startswith("3")
    return [
        r6(F.count_if(connected) / F.count("*") * 100).alias("asr"),
        r6(F.sum("connect_us") / F.count_if(connected) / S).alias("acd"),
        r6(F.count_if(connected | lsr_matches(F.col("lsr"), *NER)) / F.count("*") * 100).alias("ner"),
        r6(F.try_divide(F.count_if(F.col("lsr").isin(*SEER)), F.count_if(not_3)) * 100).alias("seer"),
    ]


_CONNECTED = "count(*) FILTER (WHERE connect_us IS NOT NULL)"
_ASR = f"round({_CONNECTED} * 1.0 / count(*) * 100, 6)"
_ACD = f"round(CAST(sum(connect_us) AS DOUBLE) / nullif({_CONNECTED}, 0) / 1000000, 6)"
_NER = "round(count(*) FILTER (WHERE connect_us IS NOT NULL OR lsr IN (600, 603, 604, 607, 608) OR lsr // 100 IN (2, 3, 4)) * 1.0 / count(*) * 100, 6)"
_SEER = "round(count(*) FILTER (WHERE lsr IN (200, 480, 486, 600, 603)) * 1.0 / nullif(count(*) FILTER (WHERE lsr // 100 <> 3), 0) * 100, 6)"


def _first_quarter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cdr(spark, sf_dir).withColumn("bucket", (F.floor(F.col("b_us") / (QUARTER * S)) * QUARTER).cast("bigint"))


def asr_acd(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _first_quarter(spark, sf_dir).groupBy("sensor_id", "bucket").agg(F.count("*").alias("n"), F.count("connect_us").alias("connected"), *ratios()[:1], r6(F.try_divide(F.sum("connect_us"), F.count("connect_us")) / S).alias("acd"))
    return c


def ner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _first_quarter(spark, sf_dir).groupBy("src_ip").agg(ratios()[2])


def seer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _first_quarter(spark, sf_dir).groupBy("src_ip").agg(ratios()[3])


def short_call_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of connected calls that were connected for less than 30 and 60 seconds."""
    c = cdr(spark, sf_dir).where("connect_us IS NOT NULL")
    share = lambda s: r6(F.count_if(F.col("connect_us") < s * S) / F.count("*") * 100).alias(f"short_{s}")
    return c.groupBy("sensor_id").agg(F.count("*").alias("connected"), share(30), share(60))


#: Categories of calls that are counted, as SQL that both engines read; a null is not counted.
CATEGORIES = {
    "sip_response": "concat(CAST(lsr AS STRING), CASE lsr WHEN 200 THEN ' OK' WHEN 486 THEN ' Busy Here' WHEN 404 THEN ' Not Found' ELSE '' END)",
    "sip_response_base": "concat(substring(CAST(lsr AS STRING), 1, 1), 'XX')",
    "codecs": "CASE codec WHEN 0 THEN 'PCMU' WHEN 8 THEN 'PCMA' WHEN 18 THEN 'G729' END",
    "ip_src": "CAST(src_ip AS STRING)",
    "ip_dst": "CAST(dst_ip AS STRING)",
    "rtp_ip_src": "CASE WHEN a_rtp THEN CAST(src_ip AS STRING) END",
    "rtp_ip_dst": "CASE WHEN b_rtp THEN CAST(dst_ip AS STRING) END",
    "domain_src": "concat('Domain', CAST(user_id % 7 AS STRING))",
    "domain_dst": "concat('DOMAIN', CAST(k % 9 AS STRING))",
    "caller_countries": "CASE WHEN caller LIKE '420%' THEN 'CZ' END",
    "called_countries": "CASE WHEN called LIKE '0049%' THEN 'DE' WHEN called LIKE '0044%' THEN 'GB' WHEN called LIKE '420%' THEN 'CZ' WHEN called LIKE '001%' THEN 'US' END",
    "sip_src_ip_countries": "CASE WHEN src_ip < 167772192 THEN 'DE' WHEN src_ip < 167772224 THEN 'GB' WHEN src_ip < 167772288 THEN 'CZ' ELSE 'US' END",
    "sip_dst_ip_countries": "CASE WHEN dst_ip < 3232235528 THEN 'CZ' END",
}


def category_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of lower-cased categories by the quarter in which a call begins."""
    c = _first_quarter(spark, sf_dir)
    kinds = F.array(*(F.struct(F.lit(area).alias("area"), F.lower(F.expr(x)).alias("category")) for area, x in CATEGORIES.items()))
    return c.select("bucket", F.explode(kinds).alias("x")).where("x.category IS NOT NULL").groupBy("bucket", "x.area", "x.category").agg(F.count("*").alias("n"))


HISTOGRAM = [5, 30, 60, 120, 300]


def bucket_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls by the first interval whose upper bound exceeds the duration, else behind the last."""
    v, index = F.col("dur_us") / S, F.lit(len(HISTOGRAM))
    for i in reversed(range(len(HISTOGRAM))):
        index = F.when(v < HISTOGRAM[i], i).otherwise(index)
    return cdr(spark, sf_dir).groupBy("sensor_id", index.alias("interval_index")).agg(F.count("*").alias("n"))


def code_matches(code: Column, pattern: str) -> Column:
    """Whether a code begins with a pattern whose trailing X stand for any digit."""
    return code.cast("string").startswith(pattern.rstrip("X"))


def prefix_param_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A series with a parameter counts only calls whose response matches it."""
    patterns = ["2XX", "3XX", "4XX", "48X", "503"]
    hits = F.filter(F.array(*(F.when(code_matches(F.col("lsr"), p), F.lit(p)) for p in patterns)), lambda x: x.isNotNull())
    return _first_quarter(spark, sf_dir).select("sensor_id", F.explode(hits).alias("param")).groupBy("sensor_id", "param").agg(F.count("*").alias("n"))


def ordinal_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many calls are in their first, second, ... quarter, by bucket."""
    return quarters(cdr(spark, sf_dir)).groupBy("bucket", "ordinal").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (minute_expand, chart_minute, minutes_overlap, concurrency_min_max_avg, cps_min_max_avg, value_metrics, perc95_nearest_rank, perc95_desc, asr_acd, ner, seer, short_call_pct, category_area, bucket_histogram, prefix_param_match, ordinal_counts)}

_FIRST = f"(SELECT *, b_us // 900000000 * 900 AS bucket FROM {CDR})"
_SECONDS = f"""(SELECT sensor_id, bucket, unnest(generate_series(greatest(b_us // 1000000, bucket), least({END_SECOND}, bucket + 899))) AS t FROM {QUARTERS})"""

ORACLE_SQL = {
    "minute_expand": f"SELECT bucket, count(*) AS touching, count(*) FILTER (WHERE first) AS began, count(*) FILTER (WHERE last) AS ended, count(*) FILTER (WHERE ordinal = 1) AS second_minute FROM {MINUTES} GROUP BY bucket",
    "chart_minute": f"""SELECT series, bucket, sensor_id, count(*) AS touching, count(*) FILTER (WHERE first) AS total, round(CAST(sum(CASE WHEN first THEN dur_us END) AS DOUBLE) / 1000000, 6) AS seconds
FROM (SELECT 'all' AS series, * FROM {MINUTES} UNION ALL SELECT 'connected' AS series, * FROM {MINUTES} WHERE connect_us IS NOT NULL) GROUP BY series, bucket, sensor_id""",
    "minutes_overlap": f"""SELECT sensor_id, bucket, round(CAST(sum(greatest(0, least(e_us, (bucket + 900) * 1000000) - greatest(e_us - connect_us, bucket * 1000000))) AS DOUBLE) / 60000000, 6) AS minutes,
  round(CAST(sum(connect_us) AS DOUBLE) / 60000000, 6) AS minutes_all FROM {QUARTERS} WHERE connect_us IS NOT NULL GROUP BY sensor_id, bucket""",
    "concurrency_min_max_avg": f"""SELECT sensor_id, bucket, min(n) AS cc_min, max(n) AS cc_max, round(CAST(sum(n) AS DOUBLE) / count(*), 6) AS cc_avg
FROM (SELECT sensor_id, bucket, t, count(*) AS n FROM {_SECONDS} GROUP BY sensor_id, bucket, t) GROUP BY sensor_id, bucket""",
    "cps_min_max_avg": f"""SELECT sensor_id, t // 900 * 900 AS bucket, CAST(0 AS BIGINT) AS cps_min, max(n) AS cps_max, round(CAST(sum(n) AS DOUBLE) / 900, 6) AS cps_avg
FROM (SELECT sensor_id, b_us // 1000000 AS t, count(*) AS n FROM {CDR} GROUP BY 1, 2) GROUP BY 1, 2""",
    "value_metrics": f"""SELECT bucket, count(*) AS n, round(CAST(sum(dur_us) AS DOUBLE) / 1000000, 6) AS v_sum, round(min(dur_us) / 1000000.0, 6) AS v_min, round(max(dur_us) / 1000000.0, 6) AS v_max,
  round(CAST(sum(dur_us) AS DOUBLE) / count(*) / 1000000, 6) AS v_avg FROM {_FIRST} WHERE dur_us <> 0 GROUP BY bucket""",
    "perc95_nearest_rank": _nearest_rank_sql(f"{CDR} WHERE value <> 0", "event_type", "value", "ASC"),
    "perc95_desc": _nearest_rank_sql(f"{CDR} WHERE mos_x10 <> 0", "sensor_id", "mos_x10", "DESC"),
    "asr_acd": f"SELECT sensor_id, bucket, count(*) AS n, count(connect_us) AS connected, {_ASR} AS asr, {_ACD} AS acd FROM {_FIRST} GROUP BY sensor_id, bucket",
    "ner": f"SELECT src_ip, {_NER} AS ner FROM {CDR} GROUP BY src_ip",
    "seer": f"SELECT src_ip, {_SEER} AS seer FROM {CDR} GROUP BY src_ip",
    "short_call_pct": f"""SELECT sensor_id, count(*) AS connected, round(count(*) FILTER (WHERE connect_us < 30000000) * 1.0 / count(*) * 100, 6) AS short_30,
  round(count(*) FILTER (WHERE connect_us < 60000000) * 1.0 / count(*) * 100, 6) AS short_60 FROM {CDR} WHERE connect_us IS NOT NULL GROUP BY sensor_id""",
    "category_area": "SELECT bucket, area, category, count(*) AS n FROM ("
    + " UNION ALL ".join(f"SELECT bucket, '{area}' AS area, lower({x}) AS category FROM {_FIRST}" for area, x in CATEGORIES.items())
    + ") WHERE category IS NOT NULL GROUP BY bucket, area, category",
    "bucket_histogram": f"""SELECT sensor_id, CASE WHEN dur_us < 5000000 THEN 0 WHEN dur_us < 30000000 THEN 1 WHEN dur_us < 60000000 THEN 2 WHEN dur_us < 120000000 THEN 3 WHEN dur_us < 300000000 THEN 4 ELSE 5 END AS interval_index,
  count(*) AS n FROM {CDR} GROUP BY 1, 2""",
    "prefix_param_match": f"""SELECT sensor_id, param, count(*) AS n FROM {CDR}, (VALUES ('2XX', '2%'), ('3XX', '3%'), ('4XX', '4%'), ('48X', '48%'), ('503', '503%')) AS p(param, pattern)
WHERE CAST(lsr AS VARCHAR) LIKE pattern GROUP BY sensor_id, param""",
    "ordinal_counts": f"SELECT bucket, ordinal, count(*) AS n FROM {QUARTERS} GROUP BY bucket, ordinal",
}
