"""Sequence numbers of media streams: probation, cycles, restarts, and what was lost, reordered or came twice.

A stream is one direction of one call, so it has no more packets than a call lasts; streams are dealt over all tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.operators.intervals import S
from tallyline.operators.machines import Machine, folded
from tallyline.sources.calls import CDR, cdr

c = F.col
KEYS = ["sensor_id", "codec", "dst_ip"]
# Fixed values of the public algorithm for sequence numbers (RFC 3550, A.1), and of the rule for restarts without a mark.
MODULUS, SEQUENTIAL, MISORDER, DROPOUT = 1 << 16, 2, 100, 3000
RESTART_LOST, RESTART_MS = 200, 1000
RUNS = 10


def packets(calls: DataFrame) -> DataFrame:
    """Calls taken as packets: numbers mostly follow each other, some come late, and some jump. Times are this much denser."""
    base = F.expr("call_id div 192 + IF(k % 29 = 0, 5000 + k % 2, 0) - IF(k % 5 = 0, k % 4, 0)")
    return calls.select(*KEYS, F.expr("b_us div 20000").alias("b_us"), "call_id", F.pmod(base, F.lit(MODULUS)).alias("seq"))


class Sequences(Machine):
    """(probation, base, highest, bad, cycles, received, last lost, time of the last packet; packets, lost, reordered and runs
    of 1 to 9 and more lost ones). A sequence counts once two packets follow each other; a jump counts as a restart if the
    packet after it follows it, or at once if it is too large for the time since the last packet."""

    STATE = "probation bigint, base bigint, highest bigint, bad bigint, cycles bigint, received bigint, last_lost bigint, at bigint, packets bigint, lost bigint, reordered bigint, runs array<bigint>"
    MESSAGE = "seq bigint"
    OUT = "packets bigint, lost bigint, reordered bigint, runs array<bigint>"

    def load(self, rows: list[tuple]) -> list | None:
        return [*rows[0][:-1], list(rows[0][-1])] if rows else None

    def dump(self, held: list | None) -> list[tuple]:
        return [tuple(held)] if held else []

    def take(self, held: list | None, t: int, message: tuple) -> tuple[list, list[tuple]]:
        (seq,) = message
        if held is None:
            return [SEQUENTIAL, seq, (seq - 1) % MODULUS, MODULUS + 1, 0, 0, 0, t, 0, 0, 0, [0] * RUNS], []
        probation, base, highest, bad, cycles, received, last_lost, at, n, lost, reordered, runs = held
        if cycles + seq - base - 1 - received - last_lost > RESTART_LOST and abs(t - at) < RESTART_MS * 1000:
            cycles, base, highest = cycles - base + highest, seq, seq
        counts, ahead = True, (seq - highest) % MODULUS
        if probation:
            probation = probation - 1 if seq == highest + 1 else SEQUENTIAL - 1
            highest, counts = seq, not probation
            if counts:
                base, bad, cycles, received = seq, MODULUS + 1, 0, 0
        elif ahead < DROPOUT:
            cycles += MODULUS if seq < highest else 0
            highest = seq
        elif ahead <= MODULUS - MISORDER:
            counts = seq == bad
            if counts:
                base, highest, bad, cycles, received = seq, seq, MODULUS + 1, 0, 0
            else:
                bad = (seq + 1) % MODULUS
        if counts:
            n, received, at = n + 1, received + 1, t
            now = cycles + highest - base - 1 - received
            if now > last_lost:
                runs = [*runs]
                runs[min(now - last_lost, RUNS) - 1] += 1
            else:
                reordered += last_lost - now
            lost, last_lost = max(0, lost + now - last_lost), now
        return [probation, base, highest, bad, cycles, received, last_lost, at, n, lost, reordered, runs], []

    def sweep(self, held: list | None, now: int) -> tuple[list | None, list[tuple]]:
        return (None, [tuple(held[8:])]) if held and now > held[7] + 86_400 * S else (held, [])

    def wakes(self, held: list | None) -> int | None:
        return held[7] + 86_400 * S + 1 if held else None


def rtp_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets, lost and reordered ones of each stream, and how often 1, 2, ... and 10 or more were lost in a row."""
    return folded(packets(cdr(spark, sf_dir)), KEYS, "b_us", "call_id", Sequences(), 1 << 62).withColumn("runs", F.array_join(c("runs").cast("array<string>"), ","))


def seq_gap_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of lost packets by sensor and length, 10 for ten and more."""
    found = folded(packets(cdr(spark, sf_dir)), KEYS, "b_us", "call_id", Sequences(), 1 << 62)
    runs = found.select("sensor_id", F.posexplode("runs").alias("at", "n")).where("n > 0")
    return runs.groupBy("sensor_id", (c("at") + 1).alias("length")).agg(F.sum("n").alias("n"))


QUERIES = {f.__name__: f for f in (rtp_sequences, seq_gap_histogram)}

_KEYS = ", ".join(KEYS)
_M = MODULUS
#: Each stream walked packet by packet, one step of the rules after the other.
WALK = f"""WITH RECURSIVE r AS (SELECT {_KEYS}, b_us // 20000 AS t, ((call_id // 192 + CASE WHEN k % 29 = 0 THEN 5000 + k % 2 ELSE 0 END - CASE WHEN k % 5 = 0 THEN k % 4 ELSE 0 END) % {_M} + {_M}) % {_M} AS seq,
  row_number() OVER (PARTITION BY {_KEYS} ORDER BY b_us // 20000, call_id) AS rn FROM {CDR}),
w AS (SELECT {_KEYS}, rn, CAST({SEQUENTIAL} AS BIGINT) AS probation, CAST(seq AS BIGINT) AS base, CAST((seq + {_M - 1}) % {_M} AS BIGINT) AS highest, CAST({_M + 1} AS BIGINT) AS bad, CAST(0 AS BIGINT) AS cycles, CAST(0 AS BIGINT) AS received,
  CAST(0 AS BIGINT) AS last_lost, t AS seen_at, CAST(0 AS BIGINT) AS packets, CAST(0 AS BIGINT) AS lost, CAST(0 AS BIGINT) AS reordered, CAST(0 AS BIGINT) AS run FROM r WHERE rn = 1
 UNION ALL SELECT {_KEYS}, rn, probation2, base2, highest2, bad2, cycles2, CASE WHEN counts THEN received2 + 1 ELSE received2 END, CASE WHEN counts THEN now ELSE last_lost END, CASE WHEN counts THEN t ELSE seen_at END, CASE WHEN counts THEN packets + 1 ELSE packets END,
  CASE WHEN counts THEN greatest(0, lost + now - last_lost) ELSE lost END, CASE WHEN counts THEN reordered + greatest(0, last_lost - now) ELSE reordered END, CASE WHEN counts AND now > last_lost THEN least(now - last_lost, {RUNS}) ELSE 0 END
 FROM (SELECT *, cycles2 + highest2 - base2 - 1 - received2 - 1 AS now FROM (SELECT *,
   CASE WHEN kind = 'again' THEN {SEQUENTIAL - 1} WHEN kind IN ('next', 'valid') THEN probation - 1 ELSE probation END AS probation2, kind IN ('valid', 'order', 'restart', 'old') AS counts,
   CASE WHEN kind IN ('valid', 'restart') THEN seq ELSE base1 END AS base2, CASE WHEN kind IN ('jump', 'old') THEN highest1 ELSE seq END AS highest2, CASE WHEN kind IN ('valid', 'restart') THEN {_M + 1} WHEN kind = 'jump' THEN (seq + 1) % {_M} ELSE bad END AS bad2,
   CASE WHEN kind IN ('valid', 'restart') THEN 0 WHEN kind = 'order' AND seq < highest1 THEN cycles1 + {_M} ELSE cycles1 END AS cycles2, CASE WHEN kind IN ('valid', 'restart') THEN 0 ELSE received END AS received2
  FROM (SELECT *, CASE WHEN probation > 0 THEN CASE WHEN seq <> highest1 + 1 THEN 'again' WHEN probation > 1 THEN 'next' ELSE 'valid' END WHEN (seq - highest1 + {_M}) % {_M} < {DROPOUT} THEN 'order'
     WHEN (seq - highest1 + {_M}) % {_M} > {_M - MISORDER} THEN 'old' WHEN seq = bad THEN 'restart' ELSE 'jump' END AS kind
   FROM (SELECT *, CASE WHEN fresh THEN cycles - base + highest ELSE cycles END AS cycles1, CASE WHEN fresh THEN seq ELSE base END AS base1, CASE WHEN fresh THEN seq ELSE highest END AS highest1
    FROM (SELECT w.* EXCLUDE (rn), r.rn, r.t, r.seq, cycles + seq - base - 1 - received - last_lost > {RESTART_LOST} AND abs(t - seen_at) < {RESTART_MS * 1000} AS fresh FROM w JOIN r ON {' AND '.join(f'r.{k} = w.{k}' for k in KEYS)} AND r.rn = w.rn + 1))))))"""

ORACLE_SQL = {
    "rtp_sequences": WALK + f" SELECT {_KEYS}, arg_max(packets, rn) AS packets, arg_max(lost, rn) AS lost, arg_max(reordered, rn) AS reordered, {" || ',' || ".join(f'count(*) FILTER (WHERE run = {k})' for k in range(1, RUNS + 1))} AS runs FROM w GROUP BY {_KEYS}",
    "seq_gap_histogram": WALK + " SELECT sensor_id, run AS length, count(*) AS n FROM w WHERE run > 0 GROUP BY sensor_id, run",
}
