"""Rating: the price of calls in slices, with and without peak hours, and roll-ups of prices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.functions import semantics as X
from tallyline.operators.intervals import S
from tallyline.sources.calls import BILLING_RULES, CDR_BILLING, cdr_billing, small, values

c = F.col
RULES = "rule_id int, price double, price_peak double, t1 int, t2 int"

# The minutes of peak rates, the first day of the weekend (Saturday), and holidays of a fixed date.
PEAK_BEGIN, PEAK_END, WEEKEND_START = 8 * 60, 18 * 60, 5
FIXED_HOLIDAYS = [(1, 1), (5, 1), (12, 25), (12, 26)]


def rated(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = cdr_billing(spark, sf_dir).withColumn("rule_id", (c("nation") % 3 + 1).cast("int"))
    return calls.join(small(spark, BILLING_RULES, RULES), "rule_id")


def price(seconds: Column, per_minute: Column, t1: Column, t2: Column) -> Column:
    """A first slice of t1 seconds and further ones of t2, each begun one counted whole; no duration counts as 1 s.

    With equal slices, all of the call is in slices of t1.
    """
    d = F.greatest(seconds, F.lit(1))
    slices = lambda x, t: F.ceil(x / t)
    more = F.when(d > t1, slices(d - t1, t2) * t2).otherwise(0)
    return F.when(t1 == t2, slices(d, t1) * t1).otherwise(t1 + more) * per_minute / 60


def rate_call(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls without peak rates; a rule that lacks a price or a slice sets none."""
    return rated(spark, sf_dir).where("price > 0 AND t1 > 0 AND t2 > 0").select("id", "rule_id", F.round(price(c("dur_s"), c("price"), c("t1"), c("t2")), 6).alias("price"))


def easter(year: Column) -> Column:
    """Easter Sunday of a year as days since 1970, by the Gregorian computus."""
    div = lambda x, y: F.floor(x / y)
    golden, century, rest = year % 19, div(year, 100), year % 100
    moon = (19 * golden + century - div(century, 4) - div(century - div(century + 8, 25) + 1, 3) + 15) % 30
    weekday = (32 + 2 * (century % 4) + 2 * div(rest, 4) - moon - rest % 4) % 7
    after = moon + weekday - 7 * div(golden + 11 * moon + 22 * weekday, 451) + 21
    return F.unix_date(F.make_date(year, F.lit(3), F.lit(1))) + after


def is_working(day: Column) -> Column:
    """Whether a day since 1970 is neither at the weekend nor a holiday."""
    date = F.date_from_unix_date(day.cast("int"))
    fixed = X.any_of(*((F.month(date) == m) & (F.dayofmonth(date) == d) for m, d in FIXED_HOLIDAYS))
    after_easter = day - easter(F.year(date))
    return (F.pmod(F.weekday(date) - WEEKEND_START, F.lit(7)) > 1) & ~fixed & ~after_easter.isin(-2, 1)


def peak_at(now: Column, working: Column, begin: int = PEAK_BEGIN, end: int = PEAK_END) -> tuple[Column, Column]:
    """Whether a second has peak rates, and when that is asked again: at the next change, or at midnight.

    Begin and end are minutes of the day; the time between them may go past midnight. A change keeps the seconds of the
    minute at which it was asked for.
    """
    midnight = F.floor(now / 86_400) * 86_400
    minute, second = F.floor((now - midnight) / 60), now % 60
    at = lambda m: midnight + m * 60 + second
    first, then = sorted((begin, end))
    until = F.when(working & (minute < first), at(first)).when(working & (minute < then), at(then)).otherwise(midnight + 86_400)
    inside = (minute >= begin) & (minute < end) if begin < end else (minute >= begin) | (minute < end)
    return working & inside & F.lit(begin != end), until


def price_with_peak(begin_s: Column, seconds: Column, normal: Column, peak: Column, t1: Column, t2: Column, begin: int = PEAK_BEGIN, end: int = PEAK_END) -> Column:
    """Slices with the rate of the second in which they begin; all but the first end where the rate may change.

    The first slice is t1 seconds, or with equal slices the whole call, and is never cut. Each is rounded up to its
    unit, t1 for the first and t2 for the others, and moves the clock. A day has at most three changes, which bounds the
    slices; what working days are is found once for each day of the call.
    """
    first_day = F.floor(begin_s / 86_400)
    length = F.greatest(seconds, F.lit(1))
    days = F.floor((begin_s + length) / 86_400) - first_day + 1  # what is left ends there, since now + left never changes
    working = F.when(days == 1, F.array(is_working(first_day))).otherwise(F.transform(F.sequence(first_day, first_day + days - 1), is_working))
    start = F.struct(begin_s.cast("bigint").alias("now"), length.cast("bigint").alias("left"), F.lit(0.0).alias("total"), working.alias("working"))

    def rate(s: Column) -> Column:
        high, until = peak_at(s["now"], F.get(s["working"], (F.floor(s["now"] / 86_400) - first_day).cast("int")), begin, end)
        return F.struct(F.when(high, peak).otherwise(normal).alias("price"), until.alias("until"))

    def billed(s: Column, k: Column, r: Column) -> Column:
        size = F.when(k > 1, F.least(s["left"], r["until"] - s["now"])).when(t1 != t2, t1).otherwise(s["left"])
        unit = F.when(k == 1, t1).otherwise(t2)
        return (F.ceil(size / unit) * unit).cast("bigint")

    def on(s: Column, r: Column, n: Column) -> Column:
        return F.struct((s["now"] + n).alias("now"), (s["left"] - n).alias("left"), (s["total"] + n * r["price"] / 60).alias("total"), s["working"].alias("working"))

    def step(s: Column, k: Column) -> Column:
        return F.when(s["left"] > 0, X.let(rate(s), lambda r: X.let(billed(s, k, r), lambda n: on(s, r, n)))).otherwise(s)

    walked = F.aggregate(F.sequence(F.lit(1).cast("bigint"), 2 + 3 * days), start, step, lambda s: s["total"])
    # most calls are one slice, or two of which no change of rates cuts the second: they need no walk
    cost = lambda n, unit, high: F.ceil(n / unit).cast("bigint") * unit * F.when(high, peak).otherwise(normal) / 60
    rest, later = length - t1, begin_s + t1
    high, _ = peak_at(begin_s, is_working(first_day), begin, end)
    high_later, until = peak_at(later, is_working(F.floor(later / 86_400)), begin, end)
    return F.when(t1 == t2, cost(length, t1, high)).when(rest <= 0, cost(t1, t1, high)).when(rest <= until - later, cost(t1, t1, high) + cost(rest, t2, high_later)).otherwise(walked)


def rate_call_peak(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls with peak rates on working days; a rule that lacks a price, a peak price or a slice sets none."""
    calls = rated(spark, sf_dir).where("price > 0 AND price_peak > 0 AND t1 > 0 AND t2 > 0")
    amount = price_with_peak(F.expr("calldate_us div 1000000"), c("dur_s"), c("price"), c("price_peak"), c("t1"), c("t2"))
    return calls.select("id", "rule_id", F.round(amount, 6).alias("price"))


def billing_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices by hour, day, week and month and by customer and domain, as whole hundred-thousandths.

    Calls are summed by hour, nation and domain first; what is left of them becomes a row for each grain and subject.
    """
    calls = rated(spark, sf_dir).withColumn("price", price(c("dur_s"), c("price"), c("t1"), c("t2")))
    finest = calls.groupBy(F.expr("calldate_us div 3600000000").alias("hour"), "nation", "domain").agg(F.sum(F.round(c("price") * 100000).cast("bigint")).alias("p"), F.count("*").alias("n"))
    day = F.expr("hour div 24")
    at = F.timestamp_seconds(c("hour") * 3600)
    grains = F.array(
        F.struct(F.lit("hour").alias("grain"), c("hour").alias("part")),
        F.struct(F.lit("day").alias("grain"), day.alias("part")),
        F.struct(F.lit("week").alias("grain"), F.floor((day + 3) / 7).alias("part")),
        F.struct(F.lit("month").alias("grain"), (F.year(at) * 12 + F.month(at)).cast("bigint").alias("part")),
    )
    subjects = F.array(F.struct(F.lit("nation").alias("subject"), c("nation").cast("string").alias("value")), F.struct(F.lit("domain").alias("subject"), c("domain").alias("value")))
    rows = finest.select(F.explode(grains).alias("g"), subjects.alias("s"), "p", "n")
    rows = rows.select("g.grain", "g.part", F.explode("s").alias("s"), "p", "n")
    return rows.groupBy("grain", "part", "s.subject", "s.value").agg(F.sum("p").alias("price_100000"), F.sum("n").alias("n"))


QUERIES = {f.__name__: f for f in (rate_call, rate_call_peak, billing_rollup)}

_RATED = f"(SELECT * FROM (SELECT *, nation % 3 + 1 AS rid FROM {CDR_BILLING}) JOIN {values(BILLING_RULES, 'r(rule_id, price, price_peak, t1, t2)')} ON rid = rule_id)"
_PRICE = "CAST(CASE WHEN t1 = t2 THEN ((dur_s + t1 - 1) // t1) * t1 ELSE t1 + CASE WHEN dur_s > t1 THEN ((dur_s - t1 + t2 - 1) // t2) * t2 ELSE 0 END END AS DOUBLE) * CAST(price AS DOUBLE) / 60"

_EASTER = """(SELECT y, make_date(y, 3, 1) + CAST(h + l - 7 * ((a + 11 * h + 22 * l) // 451) + 21 AS INTEGER) AS easter FROM (SELECT *, (32 + 2 * (b % 4) + 2 * (y % 100 // 4) - h - y % 100 % 4) % 7 AS l
  FROM (SELECT *, (19 * a + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30 AS h FROM (SELECT y, y % 19 AS a, y // 100 AS b FROM range(1960, 2060) t(y)))))"""

_PEAK_PRICE = f"""WITH RECURSIVE days AS (SELECT d // 86400 AS day, isodow(dt) < 6 AND strftime(dt, '%m-%d') NOT IN ('01-01', '05-01', '12-25', '12-26') AND CAST(dt AS DATE) - easter NOT IN (-2, 1) AS working
  FROM (SELECT d, make_timestamp(d * 1000000) AS dt FROM range(0, 2000000000, 86400) t(d)) JOIN {_EASTER} ON year(dt) = y),
calls AS (SELECT id, rule_id, calldate_us // 1000000 AS now, greatest(dur_s, 1) AS left_s, CAST(price AS DOUBLE) AS price, CAST(price_peak AS DOUBLE) AS price_peak, t1, t2 FROM {_RATED}),
s AS (SELECT id, rule_id, now, left_s, price, price_peak, t1, t2, 0 AS k, CAST(0 AS DOUBLE) AS total FROM calls
 UNION ALL SELECT id, rule_id, now + billed, left_s - billed, price, price_peak, t1, t2, k + 1, total + billed * CASE WHEN high THEN price_peak ELSE price END / 60
 FROM (SELECT *, ((size + unit - 1) // unit) * unit AS billed FROM (SELECT *, CASE WHEN k = 0 THEN t1 ELSE t2 END AS unit, CASE WHEN k = 0 AND t1 <> t2 THEN t1 WHEN k = 0 THEN left_s ELSE least(left_s, until - now) END AS size
  FROM (SELECT s.*, working AND minute >= 480 AND minute < 1080 AS high,
    CASE WHEN working AND minute < 480 THEN day * 86400 + 28800 + now % 60 WHEN working AND minute < 1080 THEN day * 86400 + 64800 + now % 60 ELSE (day + 1) * 86400 END AS until
   FROM (SELECT *, now % 86400 // 60 AS minute FROM s WHERE left_s > 0) s JOIN days ON day = now // 86400))))
SELECT id, rule_id, round(total, 6) AS price FROM s WHERE left_s <= 0"""

ORACLE_SQL = {
    "rate_call_peak": _PEAK_PRICE,
    "rate_call": f"SELECT id, rule_id, round({_PRICE}, 6) AS price FROM {_RATED}",
    "billing_rollup": f"""WITH p AS (SELECT *, CAST(round({_PRICE} * 100000) AS BIGINT) AS p FROM {_RATED}),
g AS (SELECT 'hour' AS grain, calldate_us // 3600000000 AS part, * FROM p UNION ALL SELECT 'day', calldate_us // 86400000000, * FROM p UNION ALL SELECT 'week', (calldate_us // 86400000000 + 3) // 7, * FROM p
 UNION ALL SELECT 'month', CAST(year(make_timestamp(calldate_us)) * 12 + month(make_timestamp(calldate_us)) AS BIGINT), * FROM p),
s AS (SELECT grain, part, 'nation' AS subject, CAST(nation AS VARCHAR) AS value, p FROM g UNION ALL SELECT grain, part, 'domain', domain, p FROM g)
SELECT grain, part, subject, value, sum(p) AS price_100000, count(*) AS n FROM s GROUP BY grain, part, subject, value""",
}
