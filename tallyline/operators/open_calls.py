"""Calls that a key has open at once, by rules of a table: alerts with limits, purge of forgotten calls and suppression.

A connected call is open until its end, or until PURGE_S after it was connected if no end is seen. A rule looks at local
or international calls of a caller or at both; it alerts when a call is connected and at least `least` are open, not
within a second of its last alert, and if `hours` are set not until they have passed since the last one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.functions import semantics as X
from tallyline.operators.intervals import S
from tallyline.operators.machines import Machine, folded
from tallyline.session import table
from tallyline.sources.calls import CDR, cdr

c = F.col
KEYS = ["rule", "caller"]
PURGE_S = 240
#: Calls of one caller are hours apart in the tables; here their begins are this much denser.
DENSER = 300


def rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule for each region, from its number; the table has a row for each rule that a user wrote."""
    k = c("r_regionkey")
    return table(spark, sf_dir, "region").select(c("r_name").alias("rule"), F.element_at(F.array(*map(F.lit, ("local", "international", "both"))), (k % 3 + 1).cast("int")).alias("scope"), (k % 2 + 2).cast("bigint").alias("least"), F.expr("bigint(r_regionkey div 2)").alias("hours"))


def messages(calls: DataFrame, known: DataFrame) -> DataFrame:
    """(rule, caller, b_us, call_id, connects, least, hours): for each rule that looks at a call its connection and its
    end; every fifth call has none. Rules are few: they are joined by scope to calls of a table or a stream."""
    own = F.when(X.like(c("called"), "420%"), "local").otherwise("international")
    end = F.expr(f"b_us div {DENSER} + dur_us")
    rows = calls.where("connect_us IS NOT NULL").select("caller", "call_id", "k", "connect_us", end.alias("end"), F.explode(F.array(own, F.lit("both"))).alias("scope"))
    rows = rows.select("*", F.explode(F.array(F.lit(True), F.lit(False))).alias("connects")).where("connects OR k % 5 <> 0")
    at, tie = c("end") - F.when(c("connects"), c("connect_us")).otherwise(0), c("call_id") * 2 + c("connects").cast("bigint")
    return rows.join(F.broadcast(known), "scope").select("rule", "caller", at.alias("b_us"), tie.alias("tie"), "call_id", "connects", "least", "hours")


class OpenCalls(Machine):
    """Held are open calls (id, time) in order, and the time of the last alert under the id None."""

    STATE = "call_id bigint, t bigint"
    MESSAGE = "call_id bigint, connects boolean, least bigint, hours bigint"
    OUT = "at_us bigint, n bigint"

    def load(self, rows: list[tuple]) -> dict:
        return dict(map(tuple, rows))

    def dump(self, held: dict) -> list[tuple]:
        return list(held.items())

    def take(self, held: dict, t: int, message: tuple) -> tuple[dict, list[tuple]]:
        call_id, connects, least, hours = message
        held, _ = self.sweep(held, t)
        if not connects:
            held.pop(call_id, None)
            return held, []
        held[call_id] = t
        n, last = len(held) - (None in held), held.get(None)
        if n < least or last is not None and t <= last + max(S, hours * 3600 * S):
            return held, []
        held[None] = t
        return held, [(t, n)]

    def sweep(self, held: dict, now: int) -> tuple[dict, list[tuple]]:
        return {k: t for k, t in held.items() if k is None or t + PURGE_S * S >= now}, []

    def wakes(self, held: dict) -> int | None:
        open_ = [t for k, t in held.items() if k is not None]
        return min(open_) + PURGE_S * S + 1 if open_ else None


def alerts_open_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When a rule saw too many calls of a caller at once, and how many."""
    return folded(messages(cdr(spark, sf_dir), rules(spark, sf_dir)), KEYS, "b_us", "tie", OpenCalls(), 1 << 62)


QUERIES = {f.__name__: f for f in (alerts_open_calls,)}

WALK = f"""WITH RECURSIVE p AS (SELECT r_name AS rule, ['local', 'international', 'both'][k % 3 + 1] AS scope, k % 2 + 2 AS least, k // 2 AS hours FROM (SELECT r_name, CAST(r_regionkey AS BIGINT) AS k FROM region)),
x AS (SELECT caller, call_id, k, CASE WHEN called LIKE '420%' THEN 'local' ELSE 'international' END AS own, b_us // {DENSER} + dur_us AS e, b_us // {DENSER} + dur_us - connect_us AS b FROM {CDR} WHERE connect_us IS NOT NULL),
m AS (SELECT caller, call_id, own, b AS t, true AS connects FROM x UNION ALL SELECT caller, call_id, own, e, false FROM x WHERE k % 5 <> 0),
r AS (SELECT rule, caller, call_id, t, connects, least, hours, row_number() OVER (PARTITION BY rule, caller ORDER BY t, call_id * 2 + CAST(connects AS BIGINT)) AS rn FROM m JOIN p ON scope = own OR scope = 'both'),
w AS (SELECT rule, caller, CAST(0 AS BIGINT) AS rn, CAST([] AS STRUCT(id BIGINT, t BIGINT)[]) AS q, CAST(NULL AS BIGINT) AS last, CAST(NULL AS BIGINT) AS at_us, CAST(NULL AS BIGINT) AS n FROM r WHERE rn = 1
 UNION ALL SELECT rule, caller, rn, q, CASE WHEN alert THEN t ELSE last END, CASE WHEN alert THEN t END, CASE WHEN alert THEN len(q) END
 FROM (SELECT *, connects AND len(q) >= least AND (last IS NULL OR t > last + greatest(1000000, hours * 3600000000)) AS alert
  FROM (SELECT r.*, w.last, list_concat([y FOR y IN w.q IF y.t + {PURGE_S * S} >= r.t AND y.id <> r.call_id], CASE WHEN connects THEN [{{'id': r.call_id, 't': r.t}}] ELSE [] END) AS q FROM w JOIN r ON r.rule = w.rule AND r.caller = w.caller AND r.rn = w.rn + 1)))
SELECT rule, caller, at_us, n FROM w WHERE at_us IS NOT NULL"""

ORACLE_SQL = {"alerts_open_calls": WALK}
