"""Ordered computations over each key's events: running sums, previous values, segments and recursions.

A window needs a key's rows in one task only where the result truly depends on their order. Running concurrency goes
through blocks of time with prefix sums over the blocks, so a hot key is split; the jitter recursion is linear and
becomes one weighted sum; what is left uses window functions, which stream a key's sorted rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyline.operators.intervals import S, r6
from tallyline.session import table
from tallyline.sources.calls import CDR, cdr

c = F.col
DAY = 86_400 * S


def plus_minus(calls: DataFrame, keys: list[str]) -> DataFrame:
    """Two rows for each call: (keys, t, d) with d = 1 at its begin and -1 at its end."""
    return calls.select(*keys, F.explode(F.array(F.struct(c("b_us").alias("t"), F.lit(1).alias("d")), F.struct(c("e_us").alias("t"), F.lit(-1).alias("d")))).alias("x")).select(*keys, "x.t", "x.d")


#: A key with more rows than this is split into blocks of time; below it one task walks a key, which shuffles only once.
SPLIT_ROWS = 1_000_000


def has_hot_key(rows: DataFrame, keys: list[str]) -> bool:
    """Whether a key has more than SPLIT_ROWS rows, counted before anything is shuffled whole."""
    return (rows.groupBy(*keys).count().agg(F.max("count").alias("n")).first()["n"] or 0) > SPLIT_ROWS


def running(events: DataFrame, keys: list[str], block_us: int = DAY, order: tuple[str, ...] = ("t", "d"), split: bool = True) -> DataFrame:
    """Adds n, the running sum of d by t (by default ends before begins at one time), exactly.

    Sums within blocks of time run in parallel; what came before a block is a prefix sum over the few block totals.
    Without `split` a key is one window.
    """
    if not split:
        return events.withColumn("n", F.sum("d").over(W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)))
    events = events.withColumn("_block", F.floor(c("t") / block_us))
    inner = W.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    outer = W.partitionBy(*keys).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    totals = events.groupBy(*keys, "_block").agg(F.sum("d").alias("_sum")).withColumn("_before", F.coalesce(F.sum("_sum").over(outer), F.lit(0)))
    within = events.withColumn("_n", F.sum("d").over(inner))
    return within.join(totals.select(*keys, "_block", "_before"), [*keys, "_block"]).withColumn("n", c("_n") + c("_before")).drop("_block", "_n", "_before")


def carried(rows: DataFrame, keys: list[str], values: dict[str, tuple[Column, Column]], t: str = "b_us", tie: str = "call_id", block_us: int = DAY, split: bool = True) -> DataFrame:
    """Adds for each name (value, condition) the value of the key's latest earlier row that meets the condition, or null.

    Blocks of time run in parallel, so a hot key is split; a block's first rows take what the blocks before left.
    Without `split` a key is one window. Values are not null.
    """
    back = lambda w: w.rowsBetween(W.unboundedPreceding, -1)
    latest = lambda name, w: F.last(F.when(values[name][1], values[name][0]), ignorenulls=True).over(back(w))
    if not split:
        w = W.partitionBy(*keys).orderBy(t, tie)
        return rows.select("*", *[latest(name, w).alias(name) for name in values])
    rows = rows.withColumn("_block", F.floor(c(t) / block_us))
    last = rows.groupBy(*keys, "_block").agg(*[F.max_by(F.when(cond, value), F.when(cond, F.struct(t, tie))).alias(name) for name, (value, cond) in values.items()])
    outer = back(W.partitionBy(*keys).orderBy("_block"))
    last = last.select(*keys, "_block", *[F.last(name, ignorenulls=True).over(outer).alias(f"_{name}_before") for name in values])
    inner = W.partitionBy(*keys, "_block").orderBy(t, tie)
    rows = rows.select("*", *[latest(name, inner).alias(f"_{name}_inner") for name in values]).join(last, [*keys, "_block"])
    out = rows.select("*", *[F.coalesce(f"_{name}_inner", f"_{name}_before").alias(name) for name in values])
    return out.drop("_block", *[f"_{name}_{where}" for name in values for where in ("inner", "before")])


def previous(rows: DataFrame, keys: list[str], columns: list[str], t: str = "b_us", tie: str = "call_id", block_us: int = DAY, split: bool = True) -> DataFrame:
    """Adds previous, a struct of columns of the key's row before this one; null for the first."""
    return carried(rows, keys, {"previous": (F.struct(*columns), F.lit(True))}, t, tie, block_us, split)


def running_concurrency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most calls that each sensor had at once, and the mean over its events."""
    n = running(plus_minus(cdr(spark, sf_dir), ["sensor_id"]), ["sensor_id"])
    return n.groupBy("sensor_id").agg(F.max("n").alias("most"), F.count("*").alias("events"), r6(F.sum(F.when(c("d") == 1, c("n"))) / F.count_if(c("d") == 1)).alias("mean_at_begin"))


_RUNNING = f"""(SELECT sensor_id, src_ip, t, d, sum(d) OVER (PARTITION BY sensor_id ORDER BY t, d ROWS UNBOUNDED PRECEDING) AS n
  FROM (SELECT sensor_id, src_ip, b_us AS t, 1 AS d FROM {CDR} UNION ALL SELECT sensor_id, src_ip, e_us, -1 FROM {CDR}))"""


def change_country(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connected calls whose caller's country differs from the one of its previous call to the same address."""
    calls = cdr(spark, sf_dir).where("connect_us IS NOT NULL").withColumn("country", F.element_at(F.array(*map(F.lit, ("DE", "GB", "CZ", "US"))), (F.expr("k div 16") % 4 + 1).cast("int")))
    calls = previous(calls, ["caller", "dst_ip"], ["country"])
    return calls.where("previous.country <> country").select("call_id", "caller", "dst_ip", c("previous.country").alias("previous"), "country")


def segments(rows: DataFrame, keys: list[str], state: str, t: str, tie: str) -> DataFrame:
    """Runs of one state: keys, state, first and last time and the number of rows."""
    same = c("previous").isNotNull() & c(state).eqNullSafe(c(f"previous.{state}"))
    split = has_hot_key(rows, keys)
    changes = previous(rows, keys, [state], t, tie, split=split).select(*keys, state, c(t).alias("t"), c(tie).alias("tie"), F.when(same, 0).otherwise(1).alias("d"))
    numbered = running(changes, keys, order=("t", "tie"), split=split)
    return numbered.groupBy(*keys, c("n").alias("segment"), state).agg(F.min("t").alias("from_us"), F.max("t").alias("to_us"), F.count("*").alias("n"))


def state_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registration-like states of each caller, joined while they do not change."""
    calls = cdr(spark, sf_dir).withColumn("state", F.when(c("lsr") == 200, "ok").when(c("lsr").isin(401, 403, 404), "failed").otherwise("unknown"))
    return segments(calls, ["caller"], "state", "b_us", "call_id")


def moving_avg_30(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = W.partitionBy("caller").orderBy("b_us", "call_id").rowsBetween(-29, 0)
    return cdr(spark, sf_dir).select("call_id", r6(F.sum("dur_us").over(w) / F.count("*").over(w) / S).alias("avg_30"))


def jitter_rfc3550(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J += (|d| - J) / 16 over each caller's calls: the last J is a sum of |d| / 16 with weights of powers of 15/16."""
    back = F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("call_id"))) - 1
    return cdr(spark, sf_dir).select("user_id", (F.abs("value") / 16 * F.pow(F.lit(15 / 16), back)).alias("part")).groupBy("user_id").agg(r6(F.sum("part")).alias("jitter"))


def minute_maxima(calls: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, minute, first, n): the most calls (b_us, e_us) that a key had at once in each minute from its first to its last,
    those without any event included: what was going on when a minute began counts in it. first is its first minute."""
    events = running(plus_minus(calls, keys), keys).withColumn("minute", F.floor(c("t") / (60 * S)))
    seen = events.groupBy(*keys, "minute").agg(F.max("n").alias("most"), F.max_by("n", F.struct("t", "d")).alias("at_end"))
    spine = seen.groupBy(*keys).agg(F.min("minute").alias("a"), F.max("minute").alias("b")).select(*keys, c("a").alias("first"), F.explode(F.sequence("a", "b")).alias("minute"))
    full = spine.join(seen, [*keys, "minute"], "left")  # a row a minute, however many calls there are
    before = F.last("at_end", ignorenulls=True).over(W.partitionBy(*keys).orderBy("minute").rowsBetween(W.unboundedPreceding, -1))
    return full.select(*keys, "minute", "first", F.greatest(F.coalesce("most", F.lit(0)), F.coalesce(before, F.lit(0))).cast("bigint").alias("n"))


def drops(per_minute: DataFrame, rules: DataFrame) -> DataFrame:
    """(rule, minute, n, mean): minutes in which a rule sees a drop.

    per_minute (minute, first, n) has no gaps; it has one row a minute, so one window over it is small. rules: rule, back
    (minutes before, of which the whole mean is taken), percent and number (limits of the drop; 0 is none), both (whether
    both limits must be met, else one) and least (means below it are not looked at; 0 is none). The sum of the minutes
    before is the difference of two running sums, which meet in one grouping whatever `back` is.
    """
    sums = per_minute.withColumn("sum", F.sum("n").over(W.orderBy("minute").rowsBetween(W.unboundedPreceding, 0)))
    here = F.struct(c("minute").alias("at"), "first", "n", "sum", F.lit(None).cast("bigint").alias("old"))
    later = F.struct((c("minute") + c("back") + 1).alias("at"), "first", F.lit(None).cast("bigint").alias("n"), F.lit(None).cast("bigint").alias("sum"), c("sum").alias("old"))
    rule = [k for k in rules.columns]
    both_ = sums.crossJoin(F.broadcast(rules)).select(*rule, F.explode(F.array(here, later)).alias("x")).select(*rule, "x.*")
    m = both_.groupBy(*rule, c("at").alias("minute"), "first").agg(F.max("n").alias("n"), F.max("sum").alias("sum"), F.max("old").alias("old"))
    m = m.where(c("n").isNotNull() & (c("minute") - c("back") >= c("first"))).withColumn("mean", F.expr("(sum - n - coalesce(old, 0)) div back"))
    diff = c("mean") - c("n")
    by_share, by_number = (c("percent") > 0) & (diff * 100 >= c("percent") * c("mean")), (c("number") > 0) & (diff >= c("number"))
    unmet = (c("percent") > 0) & ~by_share | (c("number") > 0) & ~by_number
    alert = (c("n") < c("mean")) & ((c("least") == 0) | (c("mean") >= c("least"))) & (by_share | by_number) & ~(c("both") & unmet)
    return m.where(alert).select("rule", "minute", "n", "mean")


def drop_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule for each region, from its number; the table has a row for each rule that a user wrote."""
    k = c("r_regionkey")
    return table(spark, sf_dir, "region").select(c("r_name").alias("rule"), (k + 2).cast("bigint").alias("back"), (k * 20).alias("percent"), (k % 3).alias("number"), (k % 2 == 1).alias("both"), (k % 2 * 2).alias("least"))


def concurrency_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minutes in which the connected calls of all sensors together dropped, by rule."""
    calls = cdr(spark, sf_dir).where("connect_us IS NOT NULL").withColumn("b_us", c("e_us") - c("connect_us"))
    return drops(minute_maxima(calls, []), drop_rules(spark, sf_dir))


def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest call of each relation, and its totals."""
    calls = cdr(spark, sf_dir)
    last = F.max_by(F.struct("call_id", "lsr", "dur_us"), F.struct("b_us", "call_id"))
    return calls.groupBy("caller", "dst_ip").agg(last.alias("x"), F.count("*").alias("n"), F.min("b_us").alias("first_us")).select("caller", "dst_ip", "x.call_id", "x.lsr", "x.dur_us", "n", "first_us")


def response_delay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole means of response delays, as sum div count."""
    return cdr(spark, sf_dir).where("connect_us IS NOT NULL").groupBy("caller").agg(F.expr("sum(dur_us - connect_us) div count(*)").alias("rrd_avg"))


QUERIES = {f.__name__: f for f in (running_concurrency, change_country, state_segments, moving_avg_30, jitter_rfc3550, concurrency_drop, latest_per_key, response_delay)}

ORACLE_SQL = {
    "running_concurrency": f"SELECT sensor_id, max(n) AS most, count(*) AS events, round(CAST(sum(CASE WHEN d = 1 THEN n END) AS DOUBLE) / count(*) FILTER (WHERE d = 1), 6) AS mean_at_begin FROM {_RUNNING} GROUP BY sensor_id",
    "change_country": f"""SELECT call_id, caller, dst_ip, previous, country FROM (SELECT *, lag(country) OVER (PARTITION BY caller, dst_ip ORDER BY b_us, call_id) AS previous
  FROM (SELECT *, CASE k // 16 % 4 WHEN 0 THEN 'DE' WHEN 1 THEN 'GB' WHEN 2 THEN 'CZ' ELSE 'US' END AS country FROM {CDR} WHERE connect_us IS NOT NULL)) WHERE previous <> country""",
    "state_segments": f"""SELECT caller, segment, state, min(b_us) AS from_us, max(b_us) AS to_us, count(*) AS n FROM (SELECT *, sum(changed) OVER (PARTITION BY caller ORDER BY b_us, call_id ROWS UNBOUNDED PRECEDING) AS segment
  FROM (SELECT *, CASE WHEN state = lag(state) OVER (PARTITION BY caller ORDER BY b_us, call_id) THEN 0 ELSE 1 END AS changed
  FROM (SELECT *, CASE WHEN lsr = 200 THEN 'ok' WHEN lsr IN (401, 403, 404) THEN 'failed' ELSE 'unknown' END AS state FROM {CDR}))) GROUP BY caller, segment, state""",
    "moving_avg_30": f"""SELECT call_id, round(CAST(sum(dur_us) OVER w AS DOUBLE) / count(*) OVER w / 1000000, 6) AS avg_30 FROM {CDR} WINDOW w AS (PARTITION BY caller ORDER BY b_us, call_id ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)""",
    "jitter_rfc3550": f"""WITH RECURSIVE r AS (SELECT user_id, abs(value) AS v, row_number() OVER (PARTITION BY user_id ORDER BY call_id) AS rn FROM {CDR}),
j AS (SELECT user_id, rn, v / 16 AS a FROM r WHERE rn = 1 UNION ALL SELECT r.user_id, r.rn, j.a + (r.v - j.a) / 16 FROM j JOIN r ON r.user_id = j.user_id AND r.rn = j.rn + 1)
SELECT user_id, round(a, 6) AS jitter FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY rn DESC) AS last FROM j) WHERE last = 1""",
    "concurrency_drop": f"""WITH c AS (SELECT e_us - connect_us AS b, e_us AS e FROM {CDR} WHERE connect_us IS NOT NULL),
x AS (SELECT t, d, sum(d) OVER (ORDER BY t, d ROWS UNBOUNDED PRECEDING) AS n FROM (SELECT b AS t, 1 AS d FROM c UNION ALL SELECT e, -1 FROM c)),
k AS (SELECT t // 60000000 AS minute, max(n) AS most, arg_max(n, (t, d)) AS at_end FROM x GROUP BY 1),
p AS (SELECT m.minute, CAST(greatest(coalesce(most, 0), coalesce(last_value(at_end IGNORE NULLS) OVER (ORDER BY m.minute ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS BIGINT) AS n
  FROM (SELECT unnest(generate_series((SELECT min(minute) FROM k), (SELECT max(minute) FROM k))) AS minute) m LEFT JOIN k ON k.minute = m.minute),
r AS (SELECT r_name AS rule, r_regionkey + 2 AS back, r_regionkey * 20 AS percent, r_regionkey % 3 AS number, r_regionkey % 2 = 1 AS both_, r_regionkey % 2 * 2 AS least_ FROM region),
q AS (SELECT rule, p.minute, p.n, CAST(sum(o.n) AS BIGINT) // any_value(back) AS mean, any_value(percent) AS percent, any_value(number) AS number, any_value(both_) AS both_, any_value(least_) AS least_
  FROM p, r JOIN p o ON o.minute BETWEEN p.minute - back AND p.minute - 1 GROUP BY rule, p.minute, p.n HAVING count(*) = any_value(back))
SELECT rule, minute, n, mean FROM q WHERE n < mean AND (least_ = 0 OR mean >= least_)
  AND list_contains([percent > 0 AND (mean - n) * 100 >= percent * mean, number > 0 AND mean - n >= number], true)
  AND NOT (both_ AND ((percent > 0 AND (mean - n) * 100 < percent * mean) OR (number > 0 AND mean - n < number)))""",
    "latest_per_key": f"""SELECT caller, dst_ip, call_id, lsr, dur_us, n, first_us FROM (SELECT *, count(*) OVER (PARTITION BY caller, dst_ip) AS n, min(b_us) OVER (PARTITION BY caller, dst_ip) AS first_us,
  row_number() OVER (PARTITION BY caller, dst_ip ORDER BY b_us DESC, call_id DESC) AS rn FROM {CDR}) WHERE rn = 1""",
    "response_delay": f"SELECT caller, CAST(sum(dur_us - connect_us) // count(*) AS BIGINT) AS rrd_avg FROM {CDR} WHERE connect_us IS NOT NULL GROUP BY caller",
}
