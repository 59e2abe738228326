"""Requests and their responses: which response answers a request, repeats, and requests that were never answered.

A relation (the two ends) has a queue of its latest requests. A response answers the oldest open request of its call id
and sequence number; one that finds none is dropped. A request that equals an open one is a repeat of it. The queue holds
MOST requests: a new one puts the oldest out, answered or not, and what was put out can no longer be answered. A relation
that is silent for RELATION_S is let go. Good is a request whose response came within the limit of its last repeat, with
200 or another listed number.

What a queue holds follows from every message before, so a relation's messages pass in order; but silence ends a
relation, so only messages of one busy period need to meet in a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.functions import semantics as X
from tallyline.operators.intervals import S
from tallyline.operators.machines import Machine, folded
from tallyline.operators.sequences import has_hot_key, previous, running
from tallyline.sources.calls import CDR, cdr

c = F.col
RELATION = ["src_ip", "sensor_id"]
#: Open and answered requests that a relation keeps, and the silence after which it is let go.
MOST, RELATION_S = 5, 300
#: Calls of the tables are hours apart; as messages their times are this much denser.
DENSER = 400
QUALIFY_S, GOOD_NUMBERS = 60, (404, 486)


def messages(calls: DataFrame) -> DataFrame:
    """Calls taken as messages: clicks, purchases and signups ask, all others answer; few call ids, so that they cross."""
    k = c("k")
    return calls.select(
        *RELATION, F.expr(f"b_us div {DENSER}").alias("b_us"), "call_id", (~c("event_type").isin("view", "error")).alias("asks"),
        F.concat(F.lit("c"), (k % 3).cast("string")).alias("callid"), F.expr("k div 3 % 2").cast("bigint").alias("cseq"), c("lsr").cast("bigint").alias("number"),
    )


class Requests(Machine):
    """A relation's queue: [callid, cseq, id of the first request, its time, the last one's, requests, id of the response,
    its time, its number]."""

    STATE = "callid string, cseq bigint, request_id bigint, first_us bigint, last_us bigint, n bigint, response_id bigint, response_us bigint, number bigint"
    MESSAGE = "call_id bigint, asks boolean, callid string, cseq bigint, number bigint"
    OUT = STATE

    def load(self, rows: list[tuple]) -> list[list]:
        return [list(r) for r in rows]

    def dump(self, held: list[list]) -> list[tuple]:
        return [tuple(r) for r in held]

    def take(self, held: list[list], t: int, message: tuple) -> tuple[list[list], list[tuple]]:
        held, closed = self.sweep(held, t)
        call_id, asks, callid, cseq, number = message
        open_ = next((r for r in held if r[0] == callid and r[1] == cseq and r[6] is None), None)
        if not asks:
            if open_:
                open_[6:] = [call_id, t, number]
        elif open_:
            open_[4], open_[5] = t, open_[5] + 1
        else:
            held.append([callid, cseq, call_id, t, t, 1, None, None, None])
            if len(held) > MOST:
                closed.append(tuple(held.pop(0)))
        return held, closed

    def sweep(self, held: list[list], now: int) -> tuple[list[list], list[tuple]]:
        if held and now > self.wakes(held) - 1:
            return [], [tuple(r) for r in held]
        return held, []

    def wakes(self, held: list[list]) -> int | None:
        return max(r[7] or r[4] for r in held) + RELATION_S * S + 1 if held else None


def with_quality(found: DataFrame, limit_s: int = QUALIFY_S, good: tuple[int, ...] = GOOD_NUMBERS) -> DataFrame:
    """Adds took_us, from the last repeat to the response (null without one), and qualify_ok."""
    took = c("response_us") - c("last_us")
    return found.withColumn("took_us", took).withColumn("qualify_ok", X.known((took <= limit_s * S) & ((c("number") == 200) | c("number").isin(*good))))


def tracked(rows: DataFrame, relation: list[str]) -> DataFrame:
    """(relation, callid, cseq, request_id, first_us, last_us, n, response_id, response_us, number): a row for each request."""
    split = has_hot_key(rows, relation)
    rows = previous(rows, relation, ["b_us"], split=split)
    silent = c("previous").isNull() | (c("b_us") - c("previous.b_us") > RELATION_S * S)
    rows = rows.withColumn("t", c("b_us")).withColumn("d", F.when(silent, 1).otherwise(0)).drop("previous")
    rows = running(rows, relation, order=("t", "call_id"), split=split).withColumnRenamed("n", "period").withColumn("tie", c("call_id"))
    return folded(rows, [*relation, "period"], "b_us", "tie", Requests(), (1 << 62)).drop("period")


def summary(found: DataFrame) -> DataFrame:
    return with_quality(found).select(*RELATION, "request_id", "callid", "cseq", "first_us", "last_us", "n", "response_id", "took_us", "qualify_ok")


def oldest_unanswered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every request with its repeats and the response that answers it, if any."""
    return summary(tracked(messages(cdr(spark, sf_dir)), RELATION))


QUERIES = {f.__name__: f for f in (oldest_unanswered,)}

_ROWS = f"""(SELECT src_ip, sensor_id, b_us // {DENSER} AS t, call_id, event_type NOT IN ('view', 'error') AS asks, 'c' || (k % 3) AS callid, k // 3 % 2 AS cseq, CAST(lsr AS BIGINT) AS number FROM {CDR})"""
_ITEM = "STRUCT(callid VARCHAR, cseq BIGINT, request_id BIGINT, first_us BIGINT, last_us BIGINT, n BIGINT, response_id BIGINT, response_us BIGINT, number BIGINT)"
_NEW = "[{'callid': callid, 'cseq': cseq, 'request_id': call_id, 'first_us': t, 'last_us': t, 'n': CAST(1 AS BIGINT), 'response_id': CAST(NULL AS BIGINT), 'response_us': CAST(NULL AS BIGINT), 'number': CAST(NULL AS BIGINT)}]"
_AGAIN = "[struct_update(q1[i], last_us := t, n := q1[i].n + 1)]"
_ANSWERED = "[struct_update(q1[i], response_id := call_id, response_us := t, number := number)]"

#: The queue of every relation walked message by message.
WALK = f"""WITH RECURSIVE r AS (SELECT *, row_number() OVER (PARTITION BY src_ip, sensor_id ORDER BY t, call_id) AS rn FROM {_ROWS}),
w AS (SELECT src_ip, sensor_id, CAST(0 AS BIGINT) AS rn, CAST([] AS {_ITEM}[]) AS q, CAST([] AS {_ITEM}[]) AS done FROM r WHERE rn = 1
 UNION ALL SELECT src_ip, sensor_id, rn, CASE WHEN len(q2) > {MOST} THEN q2[2:] ELSE q2 END, list_concat(CASE WHEN silent THEN q ELSE [] END, CASE WHEN len(q2) > {MOST} THEN q2[:1] ELSE [] END)
 FROM (SELECT *, CASE WHEN i IS NULL THEN CASE WHEN asks THEN list_concat(q1, {_NEW}) ELSE q1 END ELSE list_concat(list_concat(q1[:i - 1], CASE WHEN asks THEN {_AGAIN} ELSE {_ANSWERED} END), q1[i + 1:]) END AS q2
  FROM (SELECT *, list_position([x.callid = callid AND x.cseq = cseq AND x.response_id IS NULL FOR x IN q1], true) AS i
   FROM (SELECT *, CASE WHEN silent THEN [] ELSE q END AS q1 FROM (SELECT r.*, w.q, coalesce(t > list_max([coalesce(x.response_us, x.last_us) FOR x IN w.q]) + {RELATION_S * S}, false) AS silent
    FROM w JOIN r ON r.src_ip = w.src_ip AND r.sensor_id = w.sensor_id AND r.rn = w.rn + 1))))),
x AS (SELECT src_ip, sensor_id, unnest(done) AS x FROM w UNION ALL SELECT src_ip, sensor_id, unnest(q) FROM w QUALIFY rn = max(rn) OVER (PARTITION BY src_ip, sensor_id))
SELECT src_ip, sensor_id, x.request_id, x.callid, x.cseq, x.first_us, x.last_us, x.n, x.response_id, x.response_us - x.last_us AS took_us,
 coalesce(x.response_us - x.last_us <= {QUALIFY_S * S} AND x.number IN (200, {', '.join(map(str, GOOD_NUMBERS))}), false) AS qualify_ok FROM x"""

ORACLE_SQL = {"oldest_unanswered": WALK}
