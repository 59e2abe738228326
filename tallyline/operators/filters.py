"""Record filters: comparisons with two truth values, lists of addresses and numbers, groups, gates and rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.functions import semantics as X
from tallyline.session import table
from tallyline.sources.calls import CDR, CDR_RTP, IP_GROUPS, cdr, cdr_rtp, small, values

c = F.col


def filter_formula_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = cdr(spark, sf_dir)
    forms = {"prefix": X.like(c("called"), "0049%"), "suffix": X.like(c("called"), "%42"), "part": X.like(c("called"), "%0007%"), "wild": X.like(c("ua"), "UA_"), "none": X.like(c("ua"), "")}
    return calls.select("call_id", *(f.alias(k) for k, f in forms.items())).where(X.any_of(*(c(k) for k in forms)))


def filter_formula_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comparisons with null are false and their negations true; `is` compares null-ness only."""
    calls = cdr(spark, sf_dir)
    return calls.select(
        "call_id",
        X.gt(c("connect_us"), 100_000_000).alias("is_long"),
        X.not_(X.gt(c("connect_us"), 100_000_000)).alias("is_not_long"),
        X.eq(c("connect_us"), F.lit(None)).alias("eq_null"),
        X.is_(c("connect_us"), F.lit(None)).alias("is_null"),
        X.ne(c("connect_us"), 0).alias("ne_zero"),
    )


def filter_in_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = cdr(spark, sf_dir)
    return calls.where(X.in_(c("lsr"), [404, 486, 503]) & X.not_in(c("codec"), [18])).select("call_id", "lsr", "codec", "called")


def filter_bitmask(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = cdr(spark, sf_dir)
    return calls.where((c("k").bitwiseAND(12) != 0) & (F.shiftright("k", 4).bitwiseAND(1) == 1)).select("call_id", "k", F.shiftleft("k", 2).alias("k4"), c("k").bitwiseOR(1).alias("k_or"))


def filter_arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole division of whole numbers, 0 by zero; if, coalesce, and greatest and least of the first two."""
    calls = cdr(spark, sf_dir)
    return calls.select(
        "call_id",
        X.divide_int(c("dur_us"), c("k") % 7).alias("whole"),
        F.round(X.divide_float(c("dur_us"), c("k") % 7), 6).alias("fraction"),
        X.if_(c("connect_us") > 50_000_000, F.lit("long"), F.lit("short")).alias("size"),
        F.coalesce("connect_us", "dur_us").alias("any_us"),
        F.greatest(c("k"), c("user_id")).alias("most"),
        F.least(c("k"), c("user_id")).alias("least"),
    )


def filter_child_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditions on child rows: existence, count and maximum, as one pre-aggregated join."""
    orders = table(spark, sf_dir, "orders").select(c("o_orderkey").alias("id"))
    child = cdr_rtp(spark, sf_dir).where("lost > 100").groupBy(c("cdr_id").alias("id")).agg(F.count("*").alias("n_lossy"), F.max("lost").alias("most_lost"))
    return orders.join(child, "id").where("n_lossy >= 2")


def filter_number_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """White and black lists of numbers: exact, prefix, suffix, part, and intervals."""
    white = X.number_matches(c("called"), ["0049%", "0044000010-0044000040", "%77", "420000001"])
    black = X.number_matches(c("called"), ["%13", "0049000020-0049000029"])
    return cdr(spark, sf_dir).where(X.listed(c("called"), white, black)).select("call_id", "caller", "called")


def filter_ip_cidr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """White and black lists of addresses and networks; an address ending in zero octets is a network."""
    nets = [(167772160, 26), (3232235520, X.classless(3232235520))]
    white = X.any_of(*(X.network(c("src_ip"), m) == X.network(F.lit(n), m) for n, m in nets))
    black = X.network(c("dst_ip"), 30) == 3232235524
    return cdr(spark, sf_dir).where(X.listed(c("src_ip"), white, black)).select("call_id", "src_ip", "dst_ip", X.inet_ntoa(c("src_ip")).alias("src"), X.broadcast_address(c("dst_ip"), 30).alias("dst_last"))


def filter_response_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Response codes by prefix; without a white list nothing passes."""
    some, none = X.response_listed(c("lsr"), ["4", "5"], ["48"]), X.response_listed(c("lsr"), [], ["48"])
    return cdr(spark, sf_dir).groupBy("lsr").agg(F.count_if(some).alias("listed"), F.count_if(none).alias("without_white"))


def filter_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups: alternatives inside, all groups required; either direction where a condition names none."""
    either = X.any_of(X.like(c("caller"), "%0042"), X.like(c("called"), "%0042"))
    codecs = X.any_of(c("codec") == 8, c("codec") == 18)
    long = X.all_of(X.ge(c("connect_us"), 10_000_000), X.le(c("dur_us"), 400_000_000))
    return cdr(spark, sf_dir).where(X.any_of(either, X.all_of(codecs, long, c("sensor_id") == 1))).select("call_id", "caller", "called", "codec", "sensor_id")


def filter_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alternatives and requirements by indentation level."""
    rule = X.by_level([(0, c("sensor_id") == 1), (1, c("codec") == 8), (1, c("codec") == 18), (2, c("lsr") == 200), (0, c("lsr") == 503)])
    return cdr(spark, sf_dir).where(rule).select("call_id", "sensor_id", "codec", "lsr")


def filter_time_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours that wrap past midnight, on working days."""
    at = F.timestamp_seconds(c("b_us") / 1_000_000)
    hour, day = F.hour(at), F.weekday(at)
    return cdr(spark, sf_dir).where(X.hour_gate(hour, 22, 5) & (day < 5)).groupBy(hour.alias("hour"), day.alias("weekday")).agg(F.count("*").alias("n"))


def filter_codec_legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codec conditions on both legs: included in either, excluded from both, equal, different."""
    a, b = c("codec"), F.element_at(F.array(*map(F.lit, (0, 8, 18))), (c("user_id") % 3 + 1).cast("int"))
    return cdr(spark, sf_dir).groupBy("sensor_id").agg(
        F.count_if((a == 8) | (b == 8)).alias("included"), F.count_if((a != 8) & (b != 8)).alias("excluded"), F.count_if(a == b).alias("same"), F.count_if(a != b).alias("different")
    )


def filter_no_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls that survive the rules which keep records from being stored, by response, network or number."""
    drop = X.any_of(X.in_(c("lsr"), [404]), X.network(c("src_ip"), 29) == 167772168, X.number_matches(c("called"), ["%99"]), (c("lsr") == 503) & X.like(c("ua"), "%3"))
    return cdr(spark, sf_dir).where(~drop).groupBy("lsr").agg(F.count("*").alias("kept"))


def filter_pair_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules on two numbers: both, either, and in both directions."""
    a, b = X.like(c("caller"), "42000001%"), X.like(c("called"), "0049%")
    a2, b2 = X.like(c("called"), "42000001%"), X.like(c("caller"), "0049%")
    return cdr(spark, sf_dir).groupBy("sensor_id").agg(F.count_if(a & b).alias("n_and"), F.count_if(a | b).alias("n_or"), F.count_if((a & b) | (a2 & b2)).alias("n_both_directions"))


def user_restriction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that a restricted user may see: own networks and own number range."""
    own_ip = X.any_of(X.network(c("src_ip"), 27) == 167772160, X.network(c("dst_ip"), 30) == 3232235520)
    own_number = X.number_matches(c("caller"), ["420000010-420000060"])
    return cdr(spark, sf_dir).where(own_ip & own_number).select("call_id", "caller", "src_ip", "dst_ip")


def longest_mask_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most specific network of each address: an equality join for each mask that the rules use, then the longest."""
    rules = small(spark, IP_GROUPS, "network long, mask int, name string")
    masks = sorted({m for _, m, _ in IP_GROUPS})
    calls = cdr(spark, sf_dir).groupBy("src_ip").agg(F.count("*").alias("n"))
    keyed = calls.withColumn("_m", F.explode(F.array(*(F.struct(F.lit(m).alias("mask"), X.network(c("src_ip"), m).alias("network")) for m in masks)))).select("src_ip", "n", "_m.mask", "_m.network")
    best = keyed.join(rules, ["network", "mask"]).groupBy("src_ip", "n").agg(F.max_by("name", "mask").alias("name"), F.max("mask").alias("mask"))
    return best


def topk_with_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A listing's page: sorted by a field, ties by id in the same direction, with the count before the limit."""
    calls = cdr(spark, sf_dir).where("lsr = 200")
    total = calls.agg(F.count("*").alias("total"))
    return calls.orderBy(F.desc("dur_us"), F.desc("call_id")).limit(20).select("call_id", "dur_us", "called").crossJoin(F.broadcast(total))


def having_distinct_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of (caller, sensor) groups that have more than 12 different destinations."""
    calls = cdr(spark, sf_dir)
    dup = calls.groupBy("caller", "sensor_id").agg(F.count_distinct("dst_ip").alias("n_dst")).where("n_dst > 12")
    return calls.join(dup, ["caller", "sensor_id"]).select("call_id", "caller", "sensor_id", "dst_ip", "n_dst")


def side_union_and_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set operations: addresses of either side, white less black ones, and those of both."""
    calls = cdr(spark, sf_dir)
    callers, called = calls.select(c("caller").alias("number")), calls.select(c("called").alias("number"))
    parts = {"union": callers.union(called).distinct(), "only_caller": callers.subtract(called), "white_less_black": called.where(X.like(c("number"), "0049%")).subtract(called.where(X.like(c("number"), "%1"))), "both": callers.intersect(called)}
    out = None
    for name, part in parts.items():
        one = part.select(F.lit(name).alias("part"), "number")
        out = one if out is None else out.unionByName(one)
    return out


QUERIES = {
    f.__name__: f
    for f in (filter_formula_like, filter_formula_null, filter_in_list, filter_bitmask, filter_arithmetic, filter_child_select, filter_number_list, filter_ip_cidr, filter_response_prefix, filter_group, filter_levels, filter_time_gate, filter_codec_legs, filter_no_store, filter_pair_direction, user_restriction, longest_mask_match, topk_with_total, having_distinct_dup, side_union_and_lists)
}

ORACLE_SQL = {
    "filter_formula_like": f"""SELECT * FROM (SELECT call_id, called LIKE '0049%' AS prefix, called LIKE '%42' AS suffix, contains(called, '0007') AS part, lower(ua) LIKE 'ua_' AS wild, false AS none FROM {CDR})
WHERE prefix OR suffix OR part OR wild""",
    "filter_formula_null": f"""SELECT call_id, coalesce(connect_us > 100000000, false) AS is_long, NOT coalesce(connect_us > 100000000, false) AS is_not_long, false AS eq_null, connect_us IS NULL AS is_null,
  coalesce(connect_us <> 0, false) AS ne_zero FROM {CDR}""",
    "filter_in_list": f"SELECT call_id, lsr, codec, called FROM {CDR} WHERE lsr IN (404, 486, 503) AND codec NOT IN (18)",
    "filter_bitmask": f"SELECT call_id, k, k * 4 AS k4, k | 1 AS k_or FROM {CDR} WHERE (k & 12) <> 0 AND ((k >> 4) & 1) = 1",
    "filter_arithmetic": f"""SELECT call_id, CASE WHEN k % 7 = 0 THEN 0 ELSE dur_us // (k % 7) END AS whole, CASE WHEN k % 7 = 0 THEN 0.0 ELSE round(CAST(dur_us AS DOUBLE) / (k % 7), 6) END AS fraction,
  CASE WHEN connect_us > 50000000 THEN 'long' ELSE 'short' END AS size, coalesce(connect_us, dur_us) AS any_us, greatest(k, user_id) AS most, least(k, user_id) AS least FROM {CDR}""",
    "filter_child_select": f"""SELECT o_orderkey AS id, n_lossy, most_lost FROM orders JOIN (SELECT cdr_id, count(*) AS n_lossy, max(lost) AS most_lost FROM {CDR_RTP} WHERE lost > 100 GROUP BY cdr_id) ON o_orderkey = cdr_id
WHERE n_lossy >= 2""",
    "filter_number_list": f"""SELECT call_id, caller, called FROM {CDR} WHERE (called LIKE '0049%' OR (length(called) = 10 AND CAST(called AS BIGINT) BETWEEN 44000010 AND 44000040) OR called LIKE '%77' OR called = '420000001')
  AND NOT (called LIKE '%13' OR (length(called) = 10 AND CAST(called AS BIGINT) BETWEEN 49000020 AND 49000029))""",
    "filter_ip_cidr": f"""SELECT call_id, src_ip, dst_ip, (src_ip >> 24) || '.' || ((src_ip >> 16) & 255) || '.' || ((src_ip >> 8) & 255) || '.' || (src_ip & 255) AS src, dst_ip // 4 * 4 + 3 AS dst_last
FROM {CDR} WHERE (src_ip // 64 = 167772160 // 64 OR src_ip // 65536 = 3232235520 // 65536) AND dst_ip // 4 * 4 <> 3232235524""",
    "filter_response_prefix": f"SELECT lsr, count(*) FILTER (WHERE (lsr // 100 IN (4, 5)) AND lsr // 10 <> 48) AS listed, CAST(0 AS BIGINT) AS without_white FROM {CDR} GROUP BY lsr",
    "filter_group": f"""SELECT call_id, caller, called, codec, sensor_id FROM {CDR} WHERE caller LIKE '%0042' OR called LIKE '%0042'
  OR (codec IN (8, 18) AND coalesce(connect_us >= 10000000, false) AND dur_us <= 400000000 AND sensor_id = 1)""",
    "filter_levels": f"SELECT call_id, sensor_id, codec, lsr FROM {CDR} WHERE (sensor_id = 1 AND (codec = 8 OR (codec = 18 AND lsr = 200))) OR lsr = 503",
    "filter_time_gate": f"""SELECT hour, weekday, count(*) AS n FROM (SELECT CAST(b_us // 3600000000 % 24 AS INTEGER) AS hour, CAST((b_us // 86400000000 + 3) % 7 AS INTEGER) AS weekday FROM {CDR})
WHERE (hour >= 22 OR hour <= 5) AND weekday < 5 GROUP BY hour, weekday""",
    "filter_codec_legs": f"""SELECT sensor_id, count(*) FILTER (WHERE codec = 8 OR b = 8) AS included, count(*) FILTER (WHERE codec <> 8 AND b <> 8) AS excluded, count(*) FILTER (WHERE codec = b) AS same,
  count(*) FILTER (WHERE codec <> b) AS different FROM (SELECT *, CASE user_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 8 ELSE 18 END AS b FROM {CDR}) GROUP BY sensor_id""",
    "filter_no_store": f"SELECT lsr, count(*) AS kept FROM {CDR} WHERE NOT (lsr = 404 OR src_ip // 8 * 8 = 167772168 OR called LIKE '%99' OR (lsr = 503 AND ua LIKE '%3')) GROUP BY lsr",
    "filter_pair_direction": f"""SELECT sensor_id, count(*) FILTER (WHERE caller LIKE '42000001%' AND called LIKE '0049%') AS n_and, count(*) FILTER (WHERE caller LIKE '42000001%' OR called LIKE '0049%') AS n_or,
  count(*) FILTER (WHERE (caller LIKE '42000001%' AND called LIKE '0049%') OR (called LIKE '42000001%' AND caller LIKE '0049%')) AS n_both_directions FROM {CDR} GROUP BY sensor_id""",
    "user_restriction": f"""SELECT call_id, caller, src_ip, dst_ip FROM {CDR} WHERE (src_ip // 32 * 32 = 167772160 OR dst_ip // 4 * 4 = 3232235520) AND length(caller) = 9 AND CAST(caller AS BIGINT) BETWEEN 420000010 AND 420000060""",
    "longest_mask_match": f"""SELECT src_ip, n, name, mask FROM (SELECT src_ip, n, name, mask, row_number() OVER (PARTITION BY src_ip ORDER BY mask DESC) AS rn
  FROM (SELECT src_ip, count(*) AS n FROM {CDR} GROUP BY src_ip), {values(IP_GROUPS, 'g(network, mask, name)')} WHERE (src_ip >> (32 - mask)) = (network >> (32 - mask))) WHERE rn = 1""",
    "topk_with_total": f"SELECT call_id, dur_us, called, (SELECT count(*) FROM {CDR} WHERE lsr = 200) AS total FROM {CDR} WHERE lsr = 200 ORDER BY dur_us DESC, call_id DESC LIMIT 20",
    "having_distinct_dup": f"""SELECT call_id, caller, sensor_id, dst_ip, n_dst FROM {CDR} JOIN (SELECT caller, sensor_id, count(DISTINCT dst_ip) AS n_dst FROM {CDR} GROUP BY caller, sensor_id HAVING count(DISTINCT dst_ip) > 12) USING (caller, sensor_id)""",
    "side_union_and_lists": f"""SELECT 'union' AS part, number FROM (SELECT caller AS number FROM {CDR} UNION SELECT called FROM {CDR}) UNION ALL SELECT 'only_caller', number FROM (SELECT caller AS number FROM {CDR} EXCEPT SELECT called FROM {CDR})
UNION ALL SELECT 'white_less_black', number FROM (SELECT DISTINCT called AS number FROM {CDR} WHERE called LIKE '0049%' AND called NOT LIKE '%1') UNION ALL SELECT 'both', number FROM (SELECT caller AS number FROM {CDR} INTERSECT SELECT called FROM {CDR})""",
}
