"""Registrations as states: segments of one state, expiry of good ones, and which identities are still held.

An identity keeps two lists of segments, one of failed registrations and one of all others, so a failure does not end a
good segment. A message extends the last segment of its list if the state is the same and the segment did not begin over
TIMEOUT_S before; it begins one otherwise. A good segment expires when a message of the identity, or the sweep after a
grace, comes later than its last message and what that asked for; an expired segment of no length follows it. An identity
is put out when its last state is long over, sooner if it only ever failed, and begins anew with its next message.

All of this follows from a few facts of each row's neighbours, so it is one chain of windows that are split by day, and
windows that open themselves for the timeout. `Registrations` is the same message by message, for a stream's keyed state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyline.operators.anchored import anchored
from tallyline.operators.intervals import S
from tallyline.operators.machines import Machine
from tallyline.operators.sequences import carried, has_hot_key, previous, running
from tallyline.session import table
from tallyline.sources.calls import CDR, cdr

c = F.col
KEYS = ["caller", "sensor_id"]
TIMEOUT_S, GRACE_S = 600, 30
#: How long an identity is held after its last message: one that only failed, and any other.
FAILED_HELD_S, HELD_S = 60, 7200
#: Calls of the tables are hours apart; as registrations their times are this much denser.
DENSER = 100


def state(lsr: Column, messages: Column, expires: Column, many: int = 10) -> Column:
    """failed, unregister, ok, many_messages or unknown, from the response, the number of messages and the expiry asked for."""
    return (
        F.when(lsr.isin(401, 403, 404, 699) | (messages <= 1), "failed")
        .when((lsr == 200) & (expires == 0), "unregister")
        .when(lsr == 200, "ok")
        .when(messages > many, "many_messages")
        .otherwise("unknown")
    )


def registrations(calls: DataFrame) -> DataFrame:
    """Calls taken as registrations: KEYS, call_id, b_us, state and expires_s."""
    expires = F.element_at(F.array(*map(F.lit, (0, 60, 600, 3600, 10800))), (c("k") % 5 + 1).cast("int"))
    return calls.select(*KEYS, "call_id", F.expr(f"b_us div {DENSER}").alias("b_us"), expires.cast("bigint").alias("expires_s"), state(c("lsr"), c("k") % 12, expires).alias("state"))


def second(t: Column) -> Column:
    return F.floor(t / S)


def lives(rows: DataFrame, keys: list[str], split: bool) -> DataFrame:
    """Adds failed, and life, a number: rows of one life are those between which the identity was not put out.

    Between two messages that did not fail lie only failed ones. The first of them is late if it comes too long after the
    last state; from then on the identity has only failed, and is put out by the shorter rule until another message
    succeeds. So whether a row begins a life follows from the row before it, the last message before it that did not
    fail, and whether one of the failed rows since that one was late.
    """
    place, every = F.struct("b_us", "call_id"), F.lit(True)
    rows = rows.withColumn("failed", c("state") == "failed")
    before = carried(rows, keys, {"_last": (c("b_us"), every), "_other": (F.struct("b_us", "call_id", "state", "expires_s"), ~c("failed"))}, split=split)
    good = c("_other.state") == "ok"
    swept = good & (c("_other.expires_s") + GRACE_S < HELD_S)
    held_from = F.when(swept, F.greatest(c("_other.b_us") + c("_other.expires_s") * S, "_last")).when(good, c("_other.b_us")).otherwise(c("_last"))
    late = c("_other").isNotNull() & (c("b_us") > held_from + HELD_S * S)
    late = carried(before.withColumn("_late", late), keys, {"_late_row": (place, c("_late"))}, split=split)
    only_failed = c("_other").isNull() | F.coalesce(c("_late_row") > F.struct("_other.b_us", "_other.call_id"), F.lit(False))
    begins = c("_last").isNull() | F.when(only_failed, c("b_us") > c("_last") + FAILED_HELD_S * S).otherwise(c("_late"))
    marked = late.withColumn("t", c("b_us")).withColumn("d", F.when(begins, 1).otherwise(0))
    return running(marked, keys, order=("t", "call_id"), split=split).withColumn("life", c("n")).select(*rows.columns, "life")


def segments(rows: DataFrame, keys: list[str], now_us: int | None = None) -> DataFrame:
    """(keys, state, from_us, to_us, n): all segments of registrations, and those that expired until now_us (the last message)."""
    split = has_hot_key(rows, keys)
    lived, listed = lives(rows, keys, split), [*keys, "life", "failed"]
    runs = previous(lived, listed, ["b_us", "state", "expires_s"], split=split)
    over = (c("previous.state") == "ok") & (second(c("previous.b_us")) + c("previous.expires_s") < second(c("b_us")))
    starts = c("previous").isNull() | (c("previous.state") != c("state")) | over
    runs = runs.withColumn("t", c("b_us")).withColumn("d", F.when(starts, 1).otherwise(0)).drop("previous")
    runs = running(runs, listed, order=("t", "call_id"), split=split).withColumn("run", c("n")).drop("n", "d", "t")
    runs = anchored(runs, [*listed, "run"], "b_us", "call_id", (TIMEOUT_S + 1) * S, at_end=True)
    last = F.max_by("expires_s", F.struct("b_us", "call_id")).alias("expires_s")
    found = runs.groupBy(*listed, "run", "state", c("begin_us").alias("from_us")).agg(F.max("b_us").alias("to_us"), F.count("*").alias("n"), last)
    life = W.partitionBy(*keys, "life")
    good = found.withColumn("next_us", F.lead("from_us").over(W.partitionBy(*listed).orderBy("run", "from_us"))).withColumn("end_us", F.max("to_us").over(life))
    if split:
        good = good.join(found.groupBy(*keys).agg(F.max("life").alias("last_life")), keys)
    else:
        good = good.withColumn("last_life", F.max("life").over(W.partitionBy(*keys)))
    now = rows.agg(F.max("b_us").alias("now_us")) if now_us is None else rows.sparkSession.range(1).select(F.lit(now_us).alias("now_us"))
    good = good.crossJoin(F.broadcast(now))  # one row
    over_s = second(c("to_us")) + c("expires_s")
    swept = (c("expires_s") + GRACE_S < HELD_S) & ((c("life") < c("last_life")) | (over_s + GRACE_S < second(c("now_us"))))
    expired = (c("state") == "ok") & F.when(c("next_us").isNotNull(), over_s < second(c("next_us"))).otherwise((over_s < second(c("end_us"))) | swept)
    at = c("to_us") + c("expires_s") * S
    one = F.struct("state", "from_us", "to_us", "n")
    two = F.struct(F.lit("expired").alias("state"), at.alias("from_us"), at.alias("to_us"), F.lit(0).cast("bigint").alias("n"))
    return good.select(*keys, F.explode(F.when(expired, F.array(one, two)).otherwise(F.array(one))).alias("x")).select(*keys, "x.*")


def sweep(held: dict, now: int) -> tuple[dict, list[tuple]]:
    """What an identity holds after sweeps until `now`, and the segments that they closed. held: its last segment
    (state, from_us, to_us, expires_s, n) of each list, under "other" and "failed"."""
    out, other, failed = [], held.get("other"), held.get("failed")
    if other and other[0] == "ok" and other[3] + GRACE_S < HELD_S and other[2] // S + other[3] + GRACE_S < now // S:
        out += [other, ("expired", other[2] + other[3] * S, other[2] + other[3] * S, 0, 0)]
        other = ("gone", 0, other[2] + other[3] * S, 0, 0)
    if other:
        last = other[2] if other[0] == "ok" or not failed else max(other[2], failed[2])
        over = now > last + HELD_S * S
    else:
        over = failed is not None and now > failed[2] + FAILED_HELD_S * S
    if over:
        return {}, out + [x for x in (other, failed) if x and x[0] != "gone"]
    return {k: v for k, v in (("other", other), ("failed", failed)) if v}, out


def take(held: dict, t: int, kind: str, expires_s: int) -> tuple[dict, list[tuple]]:
    """What an identity holds after a message, and the segments that it closed."""
    held, out = sweep(held, t)
    other = held.get("other")
    if other and other[0] == "ok" and other[2] // S + other[3] < t // S:
        out += [other, ("expired", other[2] + other[3] * S, other[2] + other[3] * S, 0, 0)]
        held["other"] = ("gone", 0, other[2] + other[3] * S, 0, 0)
    where = "failed" if kind == "failed" else "other"
    last = held.get(where)
    if last and last[0] == kind and (t - last[1]) // S <= TIMEOUT_S:
        held[where] = (kind, last[1], t, expires_s, last[4] + 1)
    else:
        out += [last] if last and last[0] != "gone" else []
        held[where] = (kind, t, t, expires_s, 1)
    return held, out


def next_sweep(held: dict) -> int | None:
    """The next time at which a sweep may change what is held."""
    other, failed = held.get("other"), held.get("failed")
    if other and other[0] == "ok" and other[3] + GRACE_S < HELD_S:
        return other[2] + (other[3] + GRACE_S + 1) * S
    if other:
        return (other[2] if other[0] == "ok" or not failed else max(other[2], failed[2])) + HELD_S * S + 1
    return failed[2] + FAILED_HELD_S * S + 1 if failed else None


class Registrations(Machine):
    """The same, message by message: what an identity holds is its last segment of each list."""

    STATE = "list string, state string, from_us bigint, to_us bigint, expires_s bigint, n bigint"
    MESSAGE = "state string, expires_s bigint"
    OUT = "state string, from_us bigint, to_us bigint, n bigint"

    def load(self, rows: list[tuple]) -> dict:
        return {r[0]: tuple(r[1:]) for r in rows}

    def dump(self, held: dict) -> list[tuple]:
        return [(k, *v) for k, v in held.items()]

    def take(self, held: dict, t: int, message: tuple) -> tuple[dict, list[tuple]]:
        return take(held, t, *message)

    def sweep(self, held: dict, now: int) -> tuple[dict, list[tuple]]:
        return sweep(held, now)

    def wakes(self, held: dict) -> int | None:
        return next_sweep(held)

    def out(self, closed: tuple) -> tuple:
        kind, from_us, to_us, _, n = closed
        return kind, from_us, to_us, n


def registration_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All segments up to the last message."""
    return segments(registrations(cdr(spark, sf_dir)), KEYS)


def registrations_held(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identities by sensor: known ones, those still held at the end of the table, and those that were put out."""
    rows = registrations(cdr(spark, sf_dir))
    by_key = rows.groupBy(*KEYS).agg(F.max("b_us").alias("last_us"), F.every(c("state") == "failed").alias("only_failed")).crossJoin(F.broadcast(rows.agg(F.max("b_us").alias("now_us"))))
    held = c("now_us") - c("last_us") <= F.when(c("only_failed"), FAILED_HELD_S * S).otherwise(HELD_S * S)
    return by_key.groupBy("sensor_id").agg(F.count("*").alias("known"), F.count_if(held).alias("held"), F.count_if(~held & c("only_failed")).alias("failed_out"), F.count_if(~held & ~c("only_failed")).alias("others_out"))


def registration_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often and how long an identity was in each state."""
    found = segments(registrations(cdr(spark, sf_dir)), KEYS)
    return found.groupBy(*KEYS, "state").agg(F.count("*").alias("segments"), F.sum("n").alias("messages"), F.max(c("to_us") - c("from_us")).alias("longest_us"))


def state_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When good registrations expired, the last ones of the table included."""
    return segments(registrations(cdr(spark, sf_dir)), KEYS).where("state = 'expired'").select(*KEYS, c("from_us").alias("expired_us"))


def alerts(found: DataFrame, rules: DataFrame) -> DataFrame:
    """(rule, begin_us, at_us, n): alerts on segments (KEYS, ua, state, from_us, to_us).

    rules: rule, kind (agent, short or expired), pattern and negated (of agents; no agent meets only a negated one),
    within_s (a good or unknown state is lost within this time), interval_s and least. Segments that meet a rule count
    from its first one; the first one past the interval still counts, ends it and begins the next. Without an interval
    every `least` segments are an alert.
    """
    before = W.partitionBy(*KEYS).orderBy("from_us", "to_us", "state")
    lasting = ("ok", "unknown")
    e = found.where("state <> 'failed'").select("*", F.lag("state").over(before).alias("old"), F.lag("to_us").over(before).alias("old_to"))
    lost = ~c("state").isin(*lasting) & c("old").isin(*lasting) & (c("from_us") > c("old_to")) & (c("from_us") - c("old_to") <= c("within_s") * S)
    agent = F.coalesce(F.rlike(c("ua"), c("pattern")), F.lit(False)) != c("negated")
    meets = F.when(c("kind") == "agent", agent).when(c("kind") == "short", lost).otherwise(c("state") == "expired")
    e = e.crossJoin(F.broadcast(rules)).where(meets)
    tie = F.xxhash64(*KEYS, "state").alias("tie")
    timed = e.where("interval_s > 0").select("rule", "least", c("from_us").alias("t"), tie, (c("interval_s") * S).alias("length"))
    w = anchored(timed, ["rule"], "t", "tie", "length")
    w = w.groupBy("rule", "least", "begin_us").agg(F.count("*").alias("n"))
    by_rule = W.partitionBy("rule").orderBy("begin_us")
    w = w.select("rule", "least", "begin_us", F.lead("begin_us").over(by_rule).alias("at_us"), (c("n") + F.when(F.lag("n").over(by_rule).isNull(), 1).otherwise(0)).alias("n"))
    every = e.where("interval_s = 0").select("rule", "least", c("from_us").alias("t"), tie, F.lit(1).alias("d"))
    every = running(every, ["rule"], order=("t", "tie")).where("n % least = 0")
    every = every.select("rule", F.lit(None).cast("bigint").alias("begin_us"), c("t").alias("at_us"), c("least").alias("n"))
    return w.where("at_us IS NOT NULL AND n >= least").select("rule", "begin_us", "at_us", "n").unionByName(every)


def register_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule for each region, from its number; the table has a row for each rule that a user wrote."""
    k = c("r_regionkey")
    return table(spark, sf_dir, "region").select(
        c("r_name").alias("rule"), F.when(k < 2, "agent").when(k == 3, "expired").otherwise("short").alias("kind"), F.lit("^ua[01]$").alias("pattern"), (k == 1).alias("negated"),
        (k * 120).cast("bigint").alias("within_s"), F.when(k == 4, 0).otherwise((k + 1) * 600).cast("bigint").alias("interval_s"), (k + 3).cast("bigint").alias("least"),
    )


def fraud_register(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts on agents, on registrations that were lost soon, and on expired ones, by rules of a table."""
    found = segments(registrations(cdr(spark, sf_dir)), KEYS).withColumn("ua", F.concat(F.lit("ua"), (F.substring("caller", 4, 6).cast("bigint") % 5).cast("string")))
    return alerts(found, register_rules(spark, sf_dir))


def register_cache(spark: SparkSession, sf_dir: str, held_s: int = 60) -> DataFrame:
    """Which registrations of a pair of addresses a cache answers: those that come, in whole seconds, less than a minute
    after the last one that it let pass."""
    rows = cdr(spark, sf_dir).select("src_ip", "dst_ip", F.expr(f"b_us div {DENSER * 100} div {S} * {S}").alias("t"), "call_id")
    return anchored(rows, ["src_ip", "dst_ip"], "t", "call_id", held_s * S, at_end=True).select("src_ip", "dst_ip", "call_id", (c("n") > 1).alias("hit"))


QUERIES = {f.__name__: f for f in (registration_segments, registrations_held, registration_states, state_expiry, fraud_register, register_cache)}

_ROWS = f"""(SELECT *, CASE WHEN lsr IN (401, 403, 404, 699) OR k % 12 <= 1 THEN 'failed' WHEN lsr = 200 AND expires_s = 0 THEN 'unregister'
  WHEN lsr = 200 THEN 'ok' WHEN k % 12 > 10 THEN 'many_messages' ELSE 'unknown' END AS state
  FROM (SELECT caller, sensor_id, call_id, b_us // {DENSER} AS b_us, k, lsr, [0, 60, 600, 3600, 10800][k % 5 + 1] AS expires_s FROM {CDR}))"""


def walk(now: str, rows: str = _ROWS) -> str:
    """SQL that walks each identity's messages one after the other: sweeps, expiry, then the list of the message."""
    s, over = f"1000000", f"CASE WHEN o1 IS NULL THEN f_to IS NOT NULL AND t > f_to + {FAILED_HELD_S * S} WHEN o1 = 'ok' OR f_to IS NULL THEN t > o1_to + {HELD_S * S} ELSE t > greatest(o1_to, f_to) + {HELD_S * S} END"
    other, failed = "[{'state': o, 'from_us': o_from, 'to_us': o_to, 'n': o_n}]", "[{'state': 'failed', 'from_us': f_from, 'to_us': f_to, 'n': f_n}]"
    expired = f"[{{'state': 'expired', 'from_us': o_to + o_e * {s}, 'to_us': o_to + o_e * {s}, 'n': CAST(0 AS BIGINT)}}]"
    swept = f"""SELECT *, CASE WHEN x1 THEN 'gone' ELSE o END AS o1, CASE WHEN x1 THEN o_to + o_e * {s} ELSE o_to END AS o1_to
   FROM (SELECT *, coalesce(o = 'ok' AND o_e + {GRACE_S} < {HELD_S} AND o_to // {s} + o_e + {GRACE_S} < t // {s}, false) AS x1 FROM joined)"""
    return f"""WITH RECURSIVE r AS (SELECT caller, sensor_id, b_us AS t, state, CAST(expires_s AS BIGINT) AS e, row_number() OVER (PARTITION BY caller, sensor_id ORDER BY b_us, call_id) AS rn FROM {rows}),
w AS (SELECT caller, sensor_id, rn, CASE WHEN state <> 'failed' THEN state END AS o, t AS o_from, t AS o_to, e AS o_e, CAST(1 AS BIGINT) AS o_n, CASE WHEN state = 'failed' THEN t END AS f_from, CASE WHEN state = 'failed' THEN t END AS f_to, CAST(1 AS BIGINT) AS f_n,
  CAST([] AS STRUCT(state VARCHAR, from_us BIGINT, to_us BIGINT, n BIGINT)[]) AS done FROM r WHERE rn = 1
 UNION ALL SELECT caller, sensor_id, rn,
  CASE WHEN bad THEN o3 ELSE state END, CASE WHEN bad OR same THEN o_from ELSE t END, CASE WHEN bad THEN o3_to ELSE t END, CASE WHEN bad THEN o_e ELSE e END, CASE WHEN bad THEN o_n WHEN same THEN o_n + 1 ELSE 1 END,
  CASE WHEN NOT bad THEN f3 WHEN f_same THEN f_from ELSE t END, CASE WHEN NOT bad THEN f3_to ELSE t END, CASE WHEN NOT bad THEN f_n WHEN f_same THEN f_n + 1 ELSE 1 END,
  list_concat(list_concat(CASE WHEN x1 OR x2 THEN list_concat({other}, {expired}) ELSE [] END, CASE WHEN dead AND NOT x1 AND o IS NOT NULL AND o <> 'gone' THEN {other} WHEN NOT dead AND NOT bad AND NOT same AND o3 IS NOT NULL AND o3 <> 'gone' THEN {other} ELSE [] END),
   CASE WHEN f_to IS NOT NULL AND (dead OR bad AND NOT f_same) THEN {failed} ELSE [] END)
 FROM (SELECT *, state = 'failed' AS bad, coalesce(o3 = state AND (t - o_from) // {s} <= {TIMEOUT_S}, false) AS same, coalesce(f3_to IS NOT NULL AND (t - f3) // {s} <= {TIMEOUT_S}, false) AS f_same
  FROM (SELECT *, CASE WHEN dead THEN NULL WHEN x2 THEN 'gone' ELSE o1 END AS o3, CASE WHEN x2 THEN o_to + o_e * {s} ELSE o1_to END AS o3_to, CASE WHEN NOT dead THEN f_from END AS f3, CASE WHEN NOT dead THEN f_to END AS f3_to
   FROM (SELECT *, NOT dead AND coalesce(o1 = 'ok' AND o_to // {s} + o_e < t // {s}, false) AS x2
    FROM (SELECT *, {over} AS dead FROM ({swept.replace('FROM joined', 'FROM (SELECT r.*, w.* EXCLUDE (caller, sensor_id, rn) FROM w JOIN r ON r.caller = w.caller AND r.sensor_id = w.sensor_id AND r.rn = w.rn + 1)')})))))),
z AS (SELECT *, {now} AS t FROM w QUALIFY row_number() OVER (PARTITION BY caller, sensor_id ORDER BY rn DESC) = 1)
SELECT caller, sensor_id, x.state, x.from_us, x.to_us, x.n FROM (SELECT caller, sensor_id, unnest(done) AS x FROM w)
UNION ALL SELECT caller, sensor_id, o, o_from, o_to, o_n FROM z WHERE o <> 'gone'
UNION ALL SELECT caller, sensor_id, 'failed', f_from, f_to, f_n FROM z WHERE f_to IS NOT NULL
UNION ALL SELECT caller, sensor_id, 'expired', o_to + o_e * {s}, o_to + o_e * {s}, 0 FROM z WHERE o = 'ok' AND o_e + {GRACE_S} < {HELD_S} AND o_to // {s} + o_e + {GRACE_S} < t // {s}"""


_SEGMENTS = f"({walk('(SELECT max(t) FROM r)')})"

ORACLE_SQL = {
    "registration_segments": walk("(SELECT max(t) FROM r)"),
    "registration_states": f"SELECT caller, sensor_id, state, count(*) AS segments, CAST(sum(n) AS BIGINT) AS messages, max(to_us - from_us) AS longest_us FROM {_SEGMENTS} GROUP BY caller, sensor_id, state",
    "state_expiry": f"SELECT caller, sensor_id, from_us AS expired_us FROM {_SEGMENTS} WHERE state = 'expired'",
    "fraud_register": f"""WITH RECURSIVE g AS (SELECT *, 'ua' || CAST(CAST(substr(caller, 4, 6) AS BIGINT) % 5 AS VARCHAR) AS ua, lag(state) OVER v AS old, lag(to_us) OVER v AS old_to FROM {_SEGMENTS} WHERE state <> 'failed'
  WINDOW v AS (PARTITION BY caller, sensor_id ORDER BY from_us, to_us, state)),
p AS (SELECT r_name AS rule, k, k * 120000000 AS within_us, CASE WHEN k = 4 THEN 0 ELSE (k + 1) * 600000000 END AS length, k + 3 AS least FROM (SELECT r_name, CAST(r_regionkey AS BIGINT) AS k FROM region)),
e AS (SELECT rule, length, least, from_us AS t, row_number() OVER (PARTITION BY rule ORDER BY from_us) AS rn FROM g, p
  WHERE CASE k WHEN 0 THEN ua IN ('ua0', 'ua1') WHEN 1 THEN ua NOT IN ('ua0', 'ua1') WHEN 3 THEN state = 'expired'
    ELSE state NOT IN ('ok', 'unknown') AND old IN ('ok', 'unknown') AND from_us > old_to AND from_us - old_to <= within_us END),
w AS (SELECT rule, rn, t AS begin_us, CAST(1 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS from_us, t AS at_us, CAST(NULL AS BIGINT) AS told FROM e WHERE rn = 1 AND length > 0
 UNION ALL SELECT e.rule, e.rn, CASE WHEN e.t - w.begin_us > length THEN e.t ELSE w.begin_us END, CASE WHEN e.t - w.begin_us > length THEN 0 ELSE w.n + 1 END, w.begin_us, e.t, CASE WHEN e.t - w.begin_us > length AND w.n + 1 >= least THEN w.n + 1 END
 FROM w JOIN e ON e.rule = w.rule AND e.rn = w.rn + 1)
SELECT rule, from_us AS begin_us, at_us, told AS n FROM w WHERE told IS NOT NULL
UNION ALL SELECT rule, NULL, t, least FROM e WHERE length = 0 AND rn % least = 0""",
    "register_cache": f"""WITH RECURSIVE r AS (SELECT src_ip, dst_ip, call_id, t, row_number() OVER (PARTITION BY src_ip, dst_ip ORDER BY t, call_id) AS rn FROM (SELECT *, b_us // {DENSER * 100} // 1000000 AS t FROM {CDR})),
w AS (SELECT src_ip, dst_ip, call_id, rn, t AS kept, false AS hit FROM r WHERE rn = 1
 UNION ALL SELECT r.src_ip, r.dst_ip, r.call_id, r.rn, CASE WHEN w.kept + 60 <= r.t THEN r.t ELSE w.kept END, w.kept + 60 > r.t FROM w JOIN r ON r.src_ip = w.src_ip AND r.dst_ip = w.dst_ip AND r.rn = w.rn + 1)
SELECT src_ip, dst_ip, call_id, hit FROM w""",
    "registrations_held": f"""WITH r AS (SELECT * FROM {_ROWS}), k AS (SELECT caller, sensor_id, max(b_us) AS last_us, bool_and(state = 'failed') AS only_failed FROM r GROUP BY caller, sensor_id),
h AS (SELECT *, (SELECT max(b_us) FROM r) - last_us <= CASE WHEN only_failed THEN 60000000 ELSE 7200000000 END AS held FROM k)
SELECT sensor_id, count(*) AS known, count(*) FILTER (WHERE held) AS held, count(*) FILTER (WHERE NOT held AND only_failed) AS failed_out, count(*) FILTER (WHERE NOT held AND NOT only_failed) AS others_out FROM h GROUP BY sensor_id""",
}
