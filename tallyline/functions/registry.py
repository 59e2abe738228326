"""The functions of this library for SQL users, as temporary SQL functions that Catalyst inlines."""

from __future__ import annotations

from pyspark.sql import SparkSession

from tallyline.functions.voice import G711_CUBIC_SQL, G711_RATING_SQL

DEFINITIONS = {
    "ip_to_long": ("(ip STRING) RETURNS BIGINT", r"CASE WHEN ip RLIKE '^[0-9]{1,3}([.][0-9]{1,3}){3}$' AND forall(split(ip, '[.]'), x -> x::int <= 255) THEN aggregate(split(ip, '[.]'), 0L, (a, x) -> a * 256 + x::bigint) END"),
    "mos_g711": ("(loss DOUBLE, burst DOUBLE) RETURNS DOUBLE", f"CASE WHEN loss = 0 OR burst = 0 THEN 4.5D WHEN loss > 0.5 THEN 1D ELSE greatest(1D, least(4.5D, aggregate(array({G711_RATING_SQL.format(d='D')}), 0D, (a, r) -> {G711_CUBIC_SQL.format(d='D')}))) END"),
    "packet_loss_pct": ("(lost BIGINT, received BIGINT) RETURNS DOUBLE", "lost / (received + 2 + lost) * 100D"),
    "rate_call": ("(seconds BIGINT, price DOUBLE, t1 INT, t2 INT) RETURNS DOUBLE", "CASE WHEN t1 = t2 THEN ceil(greatest(seconds, 1) / t1) * t1 ELSE t1 + CASE WHEN greatest(seconds, 1) > t1 THEN ceil((greatest(seconds, 1) - t1) / t2) * t2 ELSE 0 END END * price / 60D"),
    "code_matches": ("(code INT, pattern STRING) RETURNS BOOLEAN", "startswith(code::string, rtrim('X', pattern))"),
}


def register(spark: SparkSession) -> None:
    for name, (signature, body) in DEFINITIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{signature} RETURN {body}")
