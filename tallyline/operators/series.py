"""Series of seconds and intervals as JSON, capture rules by domain and header, meters of traffic, and levels of samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.functions import semantics as X
from tallyline.functions.json_filter import call_filter, restriction
from tallyline.functions.voice import energy_level
from tallyline.operators.intervals import END_SECOND, HISTOGRAM, QUARTER, QUARTERS, S, end_second, quarters
from tallyline.operators.lookups import prefix_join
from tallyline.sources.calls import CDR, cdr, small, values

c = F.col


def whole_seconds(steps: Column, begin: Column, width: int) -> Column:
    """The value at each of a bucket's seconds from its changes, an array of (t, n) in order of t; 0 before the first."""
    until = lambda i: F.when(i + 1 < F.size(steps), F.get(steps, i + 1)["t"]).otherwise(begin + width)
    runs = F.transform(steps, lambda s, i: F.array_repeat(s["n"], (until(i) - s["t"]).cast("int")))
    return F.concat(F.array_repeat(F.lit(0).cast("bigint"), (F.get(steps, F.lit(0))["t"] - begin).cast("int")), F.flatten(runs))


def second_series(pool: Column, zeros_count: bool) -> Column:
    """A series of seconds as JSON: most, least, sum and count of its values and the values; zeros count only if asked."""
    held = pool if zeros_count else F.filter(pool, lambda n: n > 0)
    total = F.aggregate(held, F.lit(0).cast("bigint"), lambda a, n: a + n)
    least = F.lit(0).cast("bigint") if zeros_count else F.array_min(held)
    return F.to_json(F.struct(F.lit("mia").alias("_"), F.array_max(held).alias("m"), least.alias("i"), total.alias("s"), F.size(held).cast("bigint").alias("c"), pool.alias("p")))


def chart_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls going on and calls begun at each second of a sensor's quarters.

    Changes are summed by second first, so the array that a bucket gathers has at most one entry for each second.
    """
    rows = quarters(cdr(spark, sf_dir))
    enter, leave = F.greatest(F.floor(c("b_us") / S), c("bucket")), F.least(end_second(c("e_us")), c("bucket") + QUARTER - 1) + 1
    change = lambda t, going, begun: F.struct(t.cast("bigint").alias("t"), F.lit(going).cast("bigint").alias("going"), begun.cast("bigint").alias("begun"))
    changes = rows.select("sensor_id", "bucket", F.explode(F.array(change(enter, 1, c("first").cast("int")), change(leave, -1, F.lit(0)))).alias("x"))
    by_second = changes.groupBy("sensor_id", "bucket", "x.t").agg(F.sum("x.going").alias("going"), F.sum("x.begun").alias("begun")).where(c("t") < c("bucket") + QUARTER)
    found = by_second.groupBy("sensor_id", "bucket").agg(F.array_sort(F.collect_list(F.struct("t", "going", "begun"))).alias("a"))
    sums = F.aggregate("a", F.array().cast("array<struct<t:bigint,n:bigint>>"), lambda done, x: F.concat(done, F.array(F.struct(x["t"].alias("t"), (F.coalesce(F.get(done, F.size(done) - 1)["n"], F.lit(0)) + x["going"]).alias("n")))))
    found = found.select("sensor_id", "bucket", sums.alias("going"), F.map_from_entries(F.transform("a", lambda x: F.struct(x["t"], x["begun"]))).alias("begun"))
    each = F.transform(F.sequence(c("bucket"), c("bucket") + QUARTER - 1), lambda t: F.coalesce(F.try_element_at("begun", t), F.lit(0).cast("bigint")))
    return found.select("sensor_id", "bucket", second_series(whole_seconds(c("going"), c("bucket"), QUARTER), False).alias("going"), second_series(each, True).alias("begun"))


def chart_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of each quarter by interval of their duration, as an array with a place for every interval."""
    v = c("dur_us") / S
    place = F.coalesce(*(F.when(v < bound, i) for i, bound in enumerate(HISTOGRAM)), F.lit(len(HISTOGRAM)))
    q = cdr(spark, sf_dir).select(F.expr("b_us div 900000000 * 900").alias("bucket"), place.alias("place"))
    counts = q.groupBy("bucket").agg(*(F.count_if(c("place") == i).alias(f"n{i}") for i in range(len(HISTOGRAM) + 1)))
    return counts.select("bucket", F.to_json(F.struct(F.lit("array").alias("_"), F.array(*(f"n{i}" for i in range(len(HISTOGRAM) + 1))).alias("v"))).alias("series"))


# Capture rules as (position, domain, direction: 0 both, 1 source, 2 destination, flags), and by header as
# (content, kind, flags), the first kind that matches counting.
DOMAIN_RULES = [(1, "d3", 0, 1), (2, "d1", 1, 2), (3, "d5", 2, 4), (4, "d1", 0, 8)]
HEADER_RULES = [("agent-7", "exact", 1), ("agent-1", "prefix", 2), ("agent-12", "prefix", 4), ("[05]$", "regexp", 8), ("^agent-3", "regexp", 16)]


def domain_rule(calls: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds the flags of the first rule, by position, that names a call's source or destination domain; null if none.

    Rules meet the distinct domains of either side, so a hot domain is looked up once.
    """
    ends = calls.select(F.explode(F.array(F.struct(c("domain_src").alias("domain"), F.lit(1).alias("end")), F.struct(c("domain_dst").alias("domain"), F.lit(2).alias("end")))).alias("x")).select("x.*").distinct()
    best = ends.join(rules, "domain").where((c("direction") == 0) | (c("direction") == c("end"))).groupBy("domain", "end").agg(F.min(F.struct("position", "flags")).alias("rule"))
    side = lambda end, name, rule: best.where(c("end") == end).select(c("domain").alias(name), c("rule").alias(rule))
    both = calls.join(side(1, "domain_src", "_s"), "domain_src", "left").join(side(2, "domain_dst", "_d"), "domain_dst", "left")
    return both.withColumn("flags", F.least("_s", "_d")["flags"]).drop("_s", "_d")


def header_rule(headers: DataFrame, rules: DataFrame, longest: int = 64) -> DataFrame:
    """Adds the flags of the rule that a header meets: equal, else the longest prefix, else the first expression.

    Only distinct contents are looked up; expressions are few, and each is one pass over what is left.
    """
    of = lambda kind: rules.where(c("kind") == kind).select("pattern", "flags")
    distinct = headers.select("header").where("header IS NOT NULL AND header <> ''").distinct()
    equal = distinct.join(of("exact").withColumnRenamed("pattern", "header"), "header").select("header", F.lit(0).alias("rank"), F.lit("").alias("pattern"), "flags")
    by_prefix = prefix_join(distinct, "header", of("prefix").select(c("pattern").alias("prefix"), c("flags").alias("country")), longest).select("header", F.lit(1).alias("rank"), c("prefix").alias("pattern"), c("country").alias("flags"))
    listed = of("regexp").groupBy().agg(F.array_sort(F.collect_list(F.struct("pattern", "flags"))).alias("expressions"))
    by_expression = distinct.join(F.broadcast(listed)).select("header", F.explode("expressions").alias("e")).where(F.expr("header RLIKE e.pattern")).select("header", F.lit(2).alias("rank"), "e.pattern", "e.flags")
    best = equal.unionByName(by_prefix).unionByName(by_expression).groupBy("header").agg(F.min_by("flags", F.struct("rank", "pattern")).alias("flags"))
    return headers.join(best, "header", "left")


def _domains(calls: DataFrame) -> DataFrame:
    return calls.select("call_id", F.concat(F.lit("d"), (c("user_id") % 7).cast("string")).alias("domain_src"), F.concat(F.lit("d"), (c("k") % 9).cast("string")).alias("domain_dst"))


def capture_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return domain_rule(_domains(cdr(spark, sf_dir)), small(spark, DOMAIN_RULES, "position int, domain string, direction int, flags int")).select("call_id", "flags")


def capture_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    headers = cdr(spark, sf_dir).select("call_id", F.concat(F.lit("agent-"), (c("k") % 130).cast("string")).alias("header"))
    return header_rule(headers, small(spark, HEADER_RULES, "pattern string, kind string, flags int")).select("call_id", "flags")


# Meters as (meter, network and mask of its addresses or None for all traffic, begin and last fetch in seconds).
METERS = [(1, None, None, 1704067200, 1705000000), (2, 167772160, 27, 1704067200, 1706000000), (3, 3232235520, 30, 1704500000, 1705500000)]
IDLE_S = 120


def live_meter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Octets and packets of each meter, of all traffic or by the side whose address it holds, the source before the
    destination, until it has not been fetched for 120 seconds; voice packets also apart."""
    side = lambda net, mask: F.lit("all") if net is None else F.when(X.network(c("src_ip"), mask) == net, "src").when(X.network(c("dst_ip"), mask) == net, "dst")
    hits = [F.when((c("b_us") >= begin * S) & (c("b_us") <= (fetched + IDLE_S) * S), F.struct(F.lit(m).alias("meter"), side(net, mask).alias("side"))) for m, net, mask, begin, fetched in METERS]
    rows = cdr(spark, sf_dir).select((c("dur_us") % 1500).alias("octets"), (c("a_rtp") & c("b_rtp")).alias("voip"), F.explode(F.array(*hits)).alias("x")).where("x.side IS NOT NULL")
    return rows.groupBy("x.meter", "x.side").agg(F.sum("octets").alias("octets"), F.count("*").alias("packets"), F.coalesce(F.sum(F.when(c("voip"), c("octets"))), F.lit(0)).alias("voip_octets"), F.count_if("voip").alias("voip_packets"))


def energy_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean absolute sample of 20 encoded bytes of each call; 0 for codecs other than 0 and 8."""
    payload = F.transform(F.sequence(F.lit(0), F.lit(19)), lambda i: ((c("k") * 7 + i * 13) % 256).cast("int"))
    return cdr(spark, sf_dir).select("call_id", "codec", energy_level(payload, c("codec")).alias("level"))


GROUPS = {"agents": ["agent-1%", "agent-2_"], "lab": ["d1", "d2"], "west": [(167772160, 26)], "office": ["420000010-420000059"]}
FILTERS = {
    1: {"src_ip_group": ["west"], "caller_agent_group": ["agents"], "country_called": ["!DE", "!US"], "vlan": [1, 2, 3], "calldate": (1704500000 * S, 1706500000 * S)},
    2: {"caller_group": ["office"], "caller_type": "0", "exclude_codec": [18], "src_port": [5060, 5061], "src_port_type": "0"},
    3: {"OR": True, "caller_domain": ["d3"], "caller_domain_type": "0", "codec_compare": True, "proxy_ip": [(167772161, 32)], "headers": {"caller_name": ["name 4%"]}},
}


def described(calls: DataFrame) -> DataFrame:
    """Calls with what records of theirs also hold: domains, agents, countries, ports, proxies and the codecs of both legs."""
    text = lambda head, n: F.concat(F.lit(head), n.cast("string"))
    return calls.select(
        "*",
        text("d", c("user_id") % 7).alias("domain_src"),
        text("d", c("k") % 9).alias("domain_dst"),
        text("name ", c("user_id") % 50).alias("caller_name"),
        F.element_at(F.array(*map(F.lit, ("DE", "GB", "CZ", "US"))), (c("k") % 4 + 1).cast("int")).alias("country_called"),
        (c("k") % 6).alias("vlan"),
        (F.lit(5060) + c("user_id") % 4).alias("src_port"),
        (F.lit(5060) + c("k") % 5).alias("dst_port"),
        F.array(F.lit(167772160) + c("k") % 3, F.lit(167772170) + c("user_id") % 3).alias("proxy_ips"),
        c("codec").alias("codec_a"),
        F.element_at(F.array(*map(F.lit, (0, 8, 18))), (c("user_id") % 3 + 1).cast("int")).alias("codec_b"),
        text("agent-", c("k") % 130).alias("agent"),
    )


def filter_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of three filter records each call meets."""
    calls = described(cdr(spark, sf_dir))
    return calls.select("call_id", *(call_filter(spec, GROUPS, {"ua": "agent"}).alias(f"filter_{n}") for n, spec in FILTERS.items())).where("filter_1 OR filter_2 OR filter_3")


def restricted_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What two users may see: one with all of their conditions met, the other with any."""
    calls = described(cdr(spark, sf_dir))
    one = restriction(addresses=[(167772160, 26)], numbers=["420000010-420000059", "0049%"], domains=["d1", "d3"], vlans=[0, 1, 2])
    other = restriction(numbers=["420000007"], headers={"caller_name": ["name 11"]}, vlans=[5], any_of=True)
    return calls.select("call_id", one.alias("user_1"), other.alias("user_2")).where("user_1 OR user_2")


QUERIES = {f.__name__: f for f in (chart_seconds, chart_intervals, capture_domain, capture_header, live_meter, energy_levels, filter_records, restricted_rows)}

_SECONDS = f"""q AS (SELECT * FROM {QUARTERS}), s AS (SELECT DISTINCT sensor_id, bucket, unnest(generate_series(bucket, bucket + 899)) AS t FROM q),
g AS (SELECT sensor_id, bucket, t, count(*) AS n FROM (SELECT sensor_id, bucket, unnest(generate_series(greatest(b_us // 1000000, bucket), least({END_SECOND}, bucket + 899))) AS t FROM q) GROUP BY ALL),
b AS (SELECT sensor_id, bucket, b_us // 1000000 AS t, count(*) AS n FROM q WHERE first GROUP BY ALL),
a AS (SELECT s.sensor_id, s.bucket, s.t, coalesce(g.n, 0) AS going, coalesce(b.n, 0) AS begun FROM s LEFT JOIN g ON g.sensor_id = s.sensor_id AND g.bucket = s.bucket AND g.t = s.t LEFT JOIN b ON b.sensor_id = s.sensor_id AND b.bucket = s.bucket AND b.t = s.t)"""
_PLACE = "CASE " + " ".join(f"WHEN dur_us / 1000000.0 < {bound} THEN {i}" for i, bound in enumerate(HISTOGRAM)) + f" ELSE {len(HISTOGRAM)} END"


def _in(ip: str, net: int, mask: int) -> str:
    return f"{ip} >> {32 - mask} = {net >> (32 - mask)}"


def _meter_sql(meter: int, net: int | None, mask: int | None, begin: int, fetched: int) -> str:
    side = "'all'" if net is None else f"CASE WHEN {_in('src_ip', net, mask)} THEN 'src' WHEN {_in('dst_ip', net, mask)} THEN 'dst' END"
    return f"SELECT {meter} AS meter, {side} AS side, dur_us % 1500 AS octets, a_rtp AND b_rtp AS voip FROM {CDR} WHERE b_us BETWEEN {begin * S} AND {(fetched + IDLE_S) * S}"


# Both laws expand a byte to a magnitude: four bits of mantissa, shifted by three of exponent.
_U, _A = "xor(b, 255)", "xor(b, 85)"
_LEVEL = f"""CASE codec WHEN 0 THEN (list_sum(list_transform(bytes, lambda b: ((({_U} & 15) * 8 + 132) << (({_U} & 112) >> 4)) - 132)) // 20)
  WHEN 8 THEN (list_sum(list_transform(bytes, lambda b: CASE WHEN ({_A} & 112) = 0 THEN ({_A} & 15) * 16 + 8 ELSE (({_A} & 15) * 16 + 264) << ((({_A} & 112) >> 4) - 1) END)) // 20) ELSE 0 END"""

ORACLE_SQL = {
    "chart_seconds": f"""WITH {_SECONDS} SELECT sensor_id, bucket,
  '{{"_":"mia","m":' || max(going) || ',"i":' || min(going) FILTER (WHERE going > 0) || ',"s":' || sum(going) || ',"c":' || count(*) FILTER (WHERE going > 0) || ',"p":[' || string_agg(going, ',' ORDER BY t) || ']}}' AS going,
  '{{"_":"mia","m":' || max(begun) || ',"i":0,"s":' || sum(begun) || ',"c":900,"p":[' || string_agg(begun, ',' ORDER BY t) || ']}}' AS begun FROM a GROUP BY sensor_id, bucket""",
    "chart_intervals": f"""SELECT bucket, '{{"_":"array","v":[' || {" || ',' || ".join(f"count(*) FILTER (WHERE place = {i})" for i in range(len(HISTOGRAM) + 1))} || ']}}' AS series
FROM (SELECT b_us // 900000000 * 900 AS bucket, {_PLACE} AS place FROM {CDR}) GROUP BY bucket""",
    "capture_domain": f"""SELECT call_id, (SELECT arg_min(flags, position) FROM {values(DOMAIN_RULES, 'r(position, domain, direction, flags)')}
  WHERE (direction IN (0, 1) AND domain = 'd' || user_id % 7) OR (direction IN (0, 2) AND domain = 'd' || k % 9)) AS flags FROM {CDR}""",
    "capture_header": f"""SELECT call_id, CASE WHEN k % 130 = 7 THEN 1 WHEN k % 130 // 10 = 12 OR k % 130 = 12 THEN 4 WHEN starts_with(CAST(k % 130 AS VARCHAR), '1') THEN 2
  WHEN k % 10 IN (0, 5) THEN 8 WHEN starts_with(CAST(k % 130 AS VARCHAR), '3') THEN 16 END AS flags FROM (SELECT call_id, k FROM {CDR})""",
    "live_meter": f"""SELECT meter, side, sum(octets) AS octets, count(*) AS packets, coalesce(sum(CASE WHEN voip THEN octets END), 0) AS voip_octets, count(*) FILTER (WHERE voip) AS voip_packets
FROM ({' UNION ALL '.join(_meter_sql(*m) for m in METERS)}) WHERE side IS NOT NULL GROUP BY meter, side""",
    "energy_levels": f"SELECT call_id, codec, CAST({_LEVEL} AS BIGINT) AS level FROM (SELECT call_id, codec, list_transform(range(0, 20), lambda i: CAST((k * 7 + i * 13) % 256 AS INTEGER)) AS bytes FROM {CDR})",
    "filter_records": f"""SELECT * FROM (SELECT call_id, (src_ip >> 6 = 2621440) AND (starts_with(agent, 'agent-1') OR regexp_full_match(agent, 'agent-2.')) AND k % 4 IN (1, 2) AND k % 6 IN (1, 2, 3) AND b_us >= 1704500000000000 AND b_us < 1706500000000000 AS filter_1,
  ((caller >= '420000010' AND caller <= '420000059') OR (called >= '420000010' AND called <= '420000059' AND length(called) = 9)) AND codec <> 18 AND (user_id % 4 IN (0, 1) OR k % 5 IN (0, 1)) AS filter_2,
  user_id % 7 = 3 OR k % 9 = 3 OR k % 3 = user_id % 3 OR k % 3 = 1 OR starts_with('name ' || user_id % 50, 'name 4') AS filter_3
 FROM (SELECT *, 'agent-' || k % 130 AS agent FROM {CDR})) WHERE filter_1 OR filter_2 OR filter_3""",
    "restricted_rows": f"""SELECT * FROM (SELECT call_id, src_ip >> 6 = 2621440 AND (caller BETWEEN '420000010' AND '420000059' OR (called BETWEEN '420000010' AND '420000059' AND length(called) = 9) OR called LIKE '0049%')
  AND (user_id % 7 IN (1, 3) OR k % 9 IN (1, 3)) AND k % 6 IN (0, 1, 2) AS user_1, caller = '420000007' OR called = '420000007' OR user_id % 50 = 11 OR k % 6 = 5 AS user_2 FROM {CDR}) WHERE user_1 OR user_2""",
}
