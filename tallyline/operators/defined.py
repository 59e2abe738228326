"""Series that are rows of a table: a row says which calls it takes and what it measures of them; no code is added for one.

A row names a value, or none for any, of each of a few fields. Calls are summed by these fields and the bucket first. Rows
that name the same fields meet those sums by equality of them; there are at most 2^4 choices of fields, and a sum gives
one key for each choice that occurs. So series and sums may both be many, and nothing is compared with all of the other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.operators.intervals import QUARTER, QUARTERS, S, quarters, r6
from tallyline.session import table
from tallyline.sources.calls import cdr

c = F.col
FIELDS = ["sensor_id", "codec", "response", "connected"]
#: Parts that the buckets of a profile are dealt to when series meet their values.
BLOCKS = 16


def _key(chosen: Column) -> Column:
    """The values of the chosen fields, one after the other; others are left out. Fields are numbers, none is null."""
    return F.concat_ws(",", *(F.when(chosen.bitwiseAND(1 << k) != 0, F.concat(F.lit(f"{k}="), c(name).cast("string"))) for k, name in enumerate(FIELDS)))


def matched(sums: DataFrame, series: DataFrame) -> DataFrame:
    """sums (FIELDS, ...) with the columns of every series (FIELDS or null, ...) that takes them; several may take one."""
    mask = sum((F.when(c(name).isNotNull(), 1 << k).otherwise(0) for k, name in enumerate(FIELDS)), F.lit(0))
    named = series.withColumn("_mask", mask).withColumn("_key", _key(c("_mask"))).drop(*FIELDS)
    masks = sorted(r["_mask"] for r in named.select("_mask").distinct().collect())  # at most 16
    each = sums.withColumn("_mask", F.explode(F.array(*map(F.lit, masks))) if masks else F.lit(-1))
    return each.withColumn("_key", _key(c("_mask"))).join(named, ["_mask", "_key"]).drop("_mask", "_key", *FIELDS)


def profiles(series: DataFrame) -> DataFrame:
    """(series, profile, measure, takes) for each series and measure: takes are its definitions and how often each is listed,
    profile the same as text, with the measure. Series that are defined alike have one profile, whatever their number."""
    one = series.groupBy("series", "measure", *FIELDS).agg(F.count("*").alias("times"))
    listed = one.groupBy("series", "measure").agg(F.array_sort(F.collect_list(F.struct(*FIELDS, "times"))).alias("takes"))  # bounded by the values of FIELDS
    return listed.select("series", F.to_json(F.struct("measure", "takes")).alias("profile"), "measure", "takes")


def measured(calls: DataFrame, series: DataFrame) -> DataFrame:
    """(series, bucket, value) of calls by quarter of an hour, as each series measures them: calls that touch the quarter,
    that begin in it, or the mean seconds of those that begin.

    Values are made once for each profile, so sums do not multiply with series; names meet them at the end. Buckets are
    dealt to BLOCKS, so that a profile of many series is not one task.
    """
    fields = calls.withColumn("response", F.expr("lsr div 100")).withColumn("connected", c("connect_us").isNotNull().cast("int"))
    q = quarters(fields).groupBy(*FIELDS, "bucket").agg(F.count("*").alias("touching"), F.count_if("first").alias("began"), F.sum(F.when(c("first"), c("dur_us"))).alias("us"))
    named = profiles(series)
    distinct = named.dropDuplicates(["profile"]).select("profile", "measure", F.explode("takes").alias("x")).select("profile", "measure", "x.*")
    total = matched(q, distinct).groupBy("profile", "measure", "bucket").agg(*(F.sum(c(k) * c("times")).alias(k) for k in ("touching", "began", "us")))
    value = F.when(c("measure") == "touching", c("touching").cast("double")).when(c("measure") == "began", c("began").cast("double")).otherwise(r6(F.try_divide(c("us"), c("began")) / S))
    values = total.select("profile", "bucket", value.alias("value"), F.expr(f"pmod(bucket div {QUARTER}, {BLOCKS})").cast("int").alias("_block")).where("value IS NOT NULL")
    names = named.select("series", "profile", F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1))).alias("_block"))
    return values.join(names, ["profile", "_block"]).select("series", "bucket", "value")


def definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A series for each supplier, from its number; the table has a row for each series that a user defined."""
    k = c("s_suppkey")
    pick = lambda values, x: F.element_at(F.array(*(F.lit(v).cast("bigint") for v in values)), (x % len(values) + 1).cast("int"))
    measure = F.element_at(F.array(*map(F.lit, ("touching", "began", "seconds"))), (k % 3 + 1).cast("int"))
    return table(spark, sf_dir, "supplier").select(c("s_name").alias("series"), measure.alias("measure"), pick((0, 1, 2, 3, None), k).alias("sensor_id"), pick((0, None, 8, 18), k).alias("codec"), pick((2, 4, None), F.expr("s_suppkey div 3")).alias("response"), pick((None, 1), F.expr("s_suppkey div 7")).alias("connected"))


def series_from_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measured(cdr(spark, sf_dir), definitions(spark, sf_dir))


QUERIES = {f.__name__: f for f in (series_from_table,)}

ORACLE_SQL = {
    "series_from_table": f"""WITH s AS (SELECT s_name AS series, ['touching', 'began', 'seconds'][s_suppkey % 3 + 1] AS measure, [0, 1, 2, 3, NULL][s_suppkey % 5 + 1] AS a, [0, NULL, 8, 18][s_suppkey % 4 + 1] AS b, [2, 4, NULL][s_suppkey // 3 % 3 + 1] AS d, [NULL, 1][s_suppkey // 7 % 2 + 1] AS e FROM supplier),
q AS (SELECT sensor_id, codec, lsr // 100 AS response, CASE WHEN connect_us IS NULL THEN 0 ELSE 1 END AS connected, bucket, first, dur_us FROM {QUARTERS}),
g AS (SELECT series, bucket, any_value(measure) AS measure, count(*) AS touching, count(*) FILTER (WHERE first) AS began, sum(dur_us) FILTER (WHERE first) AS us FROM q JOIN s ON (a IS NULL OR a = sensor_id) AND (b IS NULL OR b = codec) AND (d IS NULL OR d = response) AND (e IS NULL OR e = connected) GROUP BY series, bucket),
v AS (SELECT series, bucket, CASE measure WHEN 'touching' THEN CAST(touching AS DOUBLE) WHEN 'began' THEN CAST(began AS DOUBLE) ELSE round(CAST(us AS DOUBLE) / nullif(began, 0) / 1000000, 6) END AS value FROM g)
SELECT * FROM v WHERE value IS NOT NULL""",
}
