"""Rules and dimensions that come as tables: lists of numbers, periods, customers, groups; and encodings of ratios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyline.functions import semantics as X
from tallyline.functions import voice
from tallyline.operators.intervals import NER, S, SEER, dealt, lsr_matches, nearest_rank, r6
from tallyline.operators.rating import price, rated
from tallyline.session import table
from tallyline.sources.calls import BILLING_RULES, CDR, CDR_BILLING, CDR_RTP, cdr, cdr_rtp, small, values

c = F.col

#: (list, pattern): exact, prefix%, %suffix, %part% and from-to, as a table would hold them.
NUMBER_RULES = [("white", "0049%"), ("white", "0044000010-0044000040"), ("white", "%77"), ("white", "420000001"), ("white", "%0008%"), ("black", "%13"), ("black", "0049000020-0049000029")]


def listed_numbers(numbers: DataFrame, rules: DataFrame, number: str = "number", longest: int = 16) -> DataFrame:
    """Numbers on a white list and on no black one, from a table of rules (list, pattern) of any size.

    Each kind of rule is an equality join: a number carries its beginnings and ends, an interval the blocks of a
    hundred thousand numbers of one length that it touches. Only rules for a part in the middle are tried one by one.
    """
    r = rules.withColumn("head", c("pattern").startswith("%")).withColumn("tail", c("pattern").endswith("%"))
    text, between = F.regexp_replace("pattern", "^%|%$", ""), c("pattern").rlike(r"^\d+-\d+$")
    r = r.withColumn("text", text).withColumn("kind", F.when(between, "interval").when(c("head") & c("tail"), "part").when(c("tail"), "prefix").when(c("head"), "suffix").otherwise("exact"))
    distinct = numbers.select(number).distinct()
    sizes = F.sequence(F.lit(1), F.least(F.lit(longest), F.length(number)))
    keys = F.concat(
        F.array(F.struct(F.lit("exact").alias("kind"), c(number).alias("text"))),
        F.transform(sizes, lambda n: F.struct(F.lit("prefix").alias("kind"), F.substring(c(number), F.lit(1), n).alias("text"))),
        F.transform(sizes, lambda n: F.struct(F.lit("suffix").alias("kind"), F.substring(c(number), -n, n).alias("text"))),
    )
    found = distinct.select(number, F.explode(keys).alias("k")).select(number, "k.*").join(r.where("kind IN ('exact', 'prefix', 'suffix')"), ["kind", "text"]).select(number, "list")
    block = lambda x: F.floor(x / 100_000)
    low, high = (F.split("pattern", "-")[i] for i in (0, 1))
    ranges = r.where("kind = 'interval'").select("list", F.length(low).alias("size"), low.cast("bigint").alias("low"), high.cast("bigint").alias("high"))
    ranges = ranges.withColumn("block", F.explode(F.sequence(block(c("low")), block(c("high")))))
    whole = distinct.where(c(number).rlike(r"^\d{1,18}$")).withColumn("value", c(number).cast("bigint")).withColumn("size", F.length(number)).withColumn("block", block(c("value")))
    found = found.unionByName(whole.join(ranges, ["size", "block"]).where("value BETWEEN low AND high").select(number, "list"))
    found = found.unionByName(distinct.join(r.where("kind = 'part'").select("list", "text"), F.contains(c(number), c("text"))).select(number, "list"))
    return found.groupBy(number).agg(F.bool_or(c("list") == "white").alias("white"), F.bool_or(c("list") == "black").alias("black")).where("white AND NOT black").select(number)


def number_rules_from_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = cdr(spark, sf_dir).select("call_id", "caller", c("called").alias("number"))
    return calls.join(listed_numbers(calls, small(spark, NUMBER_RULES, "list string, pattern string")), "number")


def ratio_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratios as pairs that add up over groups, in JSON: both parts of acd, asr, ner and seer; none where the lower is 0."""
    calls = cdr(spark, sf_dir).withColumn("day", F.expr("b_us div 86400000000"))
    connected = c("connect_us").isNotNull()
    parts = calls.groupBy("sensor_id", "day").agg(
        F.coalesce(F.expr("sum(connect_us) div 1000000"), F.lit(0)).alias("seconds"),
        F.count_if(connected).alias("connected"),
        F.count("*").alias("n"),
        F.count_if(connected | lsr_matches(c("lsr"), *NER)).alias("effective"),
        F.count_if(c("lsr").isin(*SEER)).alias("session"),
        F.count_if(~c("lsr").cast("string").startswith("3")).alias("not_3"),
    )

    def pair(v1: str, v2: str) -> Column:
        return F.when(c(v2) > 0, F.to_json(F.struct(F.lit("cmp2").alias("_"), c(v1).alias("v1"), c(v2).alias("v2"))))

    return parts.select("sensor_id", "day", pair("seconds", "connected").alias("acd"), pair("connected", "n").alias("asr"), pair("effective", "n").alias("ner"), pair("session", "not_3").alias("seer"))


def mos_by_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score by codec: its own formula for 18, the best score for unconnected streams of fewer than 100 packets."""
    r = cdr_rtp(spark, sf_dir).where("received + lost > 0").withColumn("codec", F.element_at(F.array(*map(F.lit, (0, 8, 18))), (c("ssrc") % 3 + 1).cast("int")))
    loss, burst, brief = c("lost") / (c("received") + c("lost")), c("jitter_x10") / 20.0, (c("cdr_id") % 2 == 0) & (c("received") < 100)
    mos = F.when(brief, F.when(c("codec") == 18, 3.92).otherwise(4.5)).when(c("codec") == 18, voice.mos_e_model(loss, burst)).otherwise(voice.mos_g711(loss, burst))
    return r.select("cdr_id", "idx", "codec", r6(mos).alias("mos"))


def stream_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loss and jitter of streams by source and day: mean, most, and the worst 5 and 1 in a hundred by nearest rank."""
    r = cdr_rtp(spark, sf_dir).select("saddr", F.expr("t_us div 86400000000").alias("day"), "jitter_x10", F.expr("lost * 1000 div (received + 2 + lost)").alias("loss_x10"))
    keys = ["saddr", "day"]
    r, _ = dealt(r, keys, "day")
    base = r.groupBy(*keys).agg(F.count("*").alias("n"), *(f for v in ("loss_x10", "jitter_x10") for f in (r6(F.sum(v) / F.count("*")).alias(f"{v}_avg"), F.max(v).alias(f"{v}_max"))))
    for v in ("loss_x10", "jitter_x10"):
        base = base.join(nearest_rank(r.where(c(v) != 0), keys, v, [95, 99], prefix=f"{v}_perc"), keys, "left")
    return base


# Periods of the day with the alert that they belong to, as (alert, begin hour, end hour, limit).
PERIODS = [(1, 22, 5, 2), (1, 6, 21, 4), (2, 0, 23, 6)]


def alerts_by_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of each hour joined with the periods of alerts that hold it; hours of alerts past their limit."""
    hours = F.when(c("begin") <= c("end"), F.sequence("begin", "end")).otherwise(F.concat(F.sequence(c("begin"), F.lit(23)), F.sequence(F.lit(0), c("end"))))
    periods = small(spark, PERIODS, "alert int, begin int, end int, period_limit int").withColumn("hour", F.explode(hours))
    calls = cdr(spark, sf_dir).groupBy("sensor_id", F.expr("b_us div 3600000000").alias("at")).agg(F.count("*").alias("n")).withColumn("hour", (c("at") % 24).cast("int"))
    return calls.join(periods, "hour").where("n >= period_limit").select("alert", "sensor_id", "at", "n", "period_limit")


def customer_by_address(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traffic of customers, whose addresses are a table."""
    owners = table(spark, sf_dir, "customer").select((F.lit(167_772_160) + c("c_custkey")).alias("src_ip"), c("c_mktsegment").alias("segment"))
    flows = cdr(spark, sf_dir).groupBy("src_ip").agg(F.sum("dur_us").alias("octets"), F.count("*").alias("flows"))
    return flows.join(owners, "src_ip", "left").groupBy(F.coalesce("segment", F.lit("?")).alias("segment")).agg(F.sum("octets").alias("octets"), F.sum("flows").alias("flows"), F.count("*").alias("addresses"))


def prefix_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of customer prefixes with the address groups they name; a group that names none stays."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    prefixes = n.select(c("n_nationkey").alias("prefix_id"), c("n_name").alias("prefix"), F.when(c("n_nationkey") % 3 > 0, c("n_regionkey")).alias("group_id"))
    return prefixes.join(r, c("group_id") == c("r_regionkey"), "left").select("prefix_id", "prefix", c("r_name").alias("address_group"))


def size_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and numbers of partitions by group of tables, the group being the part of the table's name before a sign."""
    p = table(spark, sf_dir, "orders").select(F.concat_ws("_", F.lower(F.substring("o_orderpriority", 3, 20)), F.date_format("o_orderdate", "yyyyMM")).alias("part"), F.floor("o_totalprice").cast("bigint").alias("size"))
    return p.groupBy(F.substring_index("part", "_", 1).alias("table_group")).agg(F.sum("size").alias("size"), F.count_distinct("part").alias("partitions"))


def register_filter(spec: dict) -> Column:
    """The condition of a filter record on registrations: contact and digest numbers, addresses, agents, state, expiry."""
    one = {
        "caller": lambda v: X.number_matches(c("caller"), v),
        "src_ip": lambda v: X.any_of(*(X.network(c("src_ip"), m) == X.network(F.lit(n), m) for n, m in v)),
        "dst_ip": lambda v: X.any_of(*(X.network(c("dst_ip"), m) == X.network(F.lit(n), m) for n, m in v)),
        "ua": lambda v: X.any_of(*(X.like(c("ua"), p) for p in v)),
        "sensor_id": lambda v: X.in_(c("sensor_id"), v),
        "state": lambda v: X.in_(F.when(c("lsr") == 200, "ok").otherwise("failed"), v),
        "expires": lambda v: X.known(F.expr("dur_us div 1000000").between(*v)),
    }
    return X.all_of(*(one[k](v) for k, v in spec.items() if v is not None))


def filter_registrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = {"caller": ["%1", "%2", "420000100-420000149"], "src_ip": [(167_772_160, 25)], "dst_ip": None, "ua": ["ua%"], "state": ["failed", "ok"], "expires": (10, 300)}
    return cdr(spark, sf_dir).where(register_filter(spec)).select("call_id", "caller", "src_ip", "ua")


def rerated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of a list of ids whose price changes under new rules, with both prices."""
    calls = rated(spark, sf_dir)
    wanted = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(c("l_orderkey").alias("id")).distinct()
    new = small(spark, [(k, p * 2 if k == 2 else p, t1, t2) for k, p, _, t1, t2 in BILLING_RULES], "rule_id int, new_price double, new_t1 int, new_t2 int")
    both = calls.join(wanted, "id", "left_semi").join(new, "rule_id")
    both = both.select("id", "rule_id", F.round(price(c("dur_s"), c("price"), c("t1"), c("t2")), 6).alias("old"), F.round(price(c("dur_s"), c("new_price"), c("new_t1"), c("new_t2")), 6).alias("new"))
    return both.where("old <> new")


QUERIES = {f.__name__: f for f in (number_rules_from_table, ratio_pairs, mos_by_codec, stream_quality, alerts_by_period, customer_by_address, prefix_groups, size_by_group, filter_registrations, rerated)}

_PAIR = lambda v1, v2, name: f"""CASE WHEN {v2} > 0 THEN '{{"_":"cmp2","v1":' || {v1} || ',"v2":' || {v2} || '}}' END AS {name}"""
_PRICE = lambda p: f"round(CAST(CASE WHEN t1 = t2 THEN ((dur_s + t1 - 1) // t1) * t1 ELSE t1 + CASE WHEN dur_s > t1 THEN ((dur_s - t1 + t2 - 1) // t2) * t2 ELSE 0 END END AS DOUBLE) * CAST({p} AS DOUBLE) / 60, 6)"



def _ranked_sql(v: str) -> str:
    pick = lambda p: f"max(CASE WHEN rn = least(CAST(round(n * {p} / 100.0) AS BIGINT), n - 1) THEN {v} END) AS {v}_perc{p}"
    return f"(SELECT saddr, day, {pick(95)}, {pick(99)} FROM (SELECT saddr, day, {v}, row_number() OVER (PARTITION BY saddr, day ORDER BY {v}) - 1 AS rn, count(*) OVER (PARTITION BY saddr, day) AS n FROM r WHERE {v} <> 0) GROUP BY saddr, day)"


ORACLE_SQL = {
    "stream_quality": f"""WITH r AS (SELECT saddr, t_us // 86400000000 AS day, jitter_x10, lost * 1000 // (received + 2 + lost) AS loss_x10 FROM {CDR_RTP}),
b AS (SELECT saddr, day, count(*) AS n, {', '.join(f'round(CAST(sum({v}) AS DOUBLE) / count(*), 6) AS {v}_avg, max({v}) AS {v}_max' for v in ('loss_x10', 'jitter_x10'))} FROM r GROUP BY saddr, day)
SELECT * FROM b LEFT JOIN {_ranked_sql('loss_x10')} USING (saddr, day) LEFT JOIN {_ranked_sql('jitter_x10')} USING (saddr, day)""",
    "number_rules_from_table": f"""SELECT called AS number, call_id, caller FROM {CDR} WHERE (called LIKE '0049%' OR (length(called) = 10 AND CAST(called AS BIGINT) BETWEEN 44000010 AND 44000040) OR called LIKE '%77' OR called = '420000001' OR contains(called, '0008'))
  AND NOT (called LIKE '%13' OR (length(called) = 10 AND CAST(called AS BIGINT) BETWEEN 49000020 AND 49000029))""",
    "ratio_pairs": f"""SELECT sensor_id, day, {_PAIR('seconds', 'connected', 'acd')}, {_PAIR('connected', 'n', 'asr')}, {_PAIR('effective', 'n', 'ner')}, {_PAIR('session', 'not_3', 'seer')}
FROM (SELECT sensor_id, b_us // 86400000000 AS day, CAST(coalesce(sum(connect_us), 0) // 1000000 AS BIGINT) AS seconds, count(connect_us) AS connected, count(*) AS n,
  count(*) FILTER (WHERE connect_us IS NOT NULL OR lsr IN (600, 603, 604, 607, 608) OR lsr // 100 IN (2, 3, 4)) AS effective, count(*) FILTER (WHERE lsr IN (200, 480, 486, 600, 603)) AS session,
  count(*) FILTER (WHERE lsr // 100 <> 3) AS not_3 FROM {CDR} GROUP BY 1, 2)""",
    "mos_by_codec": f"""SELECT cdr_id, idx, codec, round(CASE WHEN brief THEN CASE WHEN codec = 18 THEN 3.92 ELSE 4.5 END
  WHEN codec = 18 THEN CASE WHEN e <= 0 THEN 1.0 ELSE least(4.5, 1.0 + 0.035 * e + e * (e - 60) * (100.0 - e) * 7e-6) END
  WHEN loss = 0 OR burst = 0 THEN 4.5 WHEN loss > 0.5 THEN 1.0 ELSE greatest(1.0, least(4.5, {voice.G711_CUBIC_SQL.format(d='')})) END, 6) AS mos
FROM (SELECT *, CASE WHEN burst <> 0 THEN {voice.G711_RATING_SQL.format(d='')} END AS r, 93.2 - (11.0 + 84.0 * (loss * 100) / (loss * 100 / greatest(burst, 1.0) + 19.0)) AS e
  FROM (SELECT *, CAST(lost AS DOUBLE) / (received + lost) AS loss, jitter_x10 / 20.0 AS burst, cdr_id % 2 = 0 AND received < 100 AS brief, CASE ssrc % 3 WHEN 0 THEN 0 WHEN 1 THEN 8 ELSE 18 END AS codec FROM {CDR_RTP} WHERE received + lost > 0))""",
    "alerts_by_period": f"""SELECT alert, sensor_id, at_hour AS at, n, period_limit FROM (SELECT sensor_id, b_us // 3600000000 AS at_hour, count(*) AS n FROM {CDR} GROUP BY 1, 2), {values(PERIODS, 'p(alert, h1, h2, period_limit)')}
WHERE n >= period_limit AND CASE WHEN h1 <= h2 THEN at_hour % 24 BETWEEN h1 AND h2 ELSE at_hour % 24 >= h1 OR at_hour % 24 <= h2 END""",
    "customer_by_address": f"""SELECT coalesce(c_mktsegment, '?') AS segment, sum(octets) AS octets, sum(flows) AS flows, count(*) AS addresses FROM (SELECT src_ip, sum(dur_us) AS octets, count(*) AS flows FROM {CDR} GROUP BY src_ip)
LEFT JOIN customer ON src_ip = 167772160 + c_custkey GROUP BY 1""",
    "prefix_groups": "SELECT n_nationkey AS prefix_id, n_name AS prefix, r_name AS address_group FROM nation LEFT JOIN region ON n_nationkey % 3 > 0 AND n_regionkey = r_regionkey",
    "size_by_group": """SELECT lower(substring(o_orderpriority, 3, 20)) AS table_group, sum(CAST(floor(o_totalprice) AS BIGINT)) AS size, count(DISTINCT strftime(o_orderdate, '%Y%m')) AS partitions FROM orders GROUP BY 1""",
    "filter_registrations": f"""SELECT call_id, caller, src_ip, ua FROM {CDR} WHERE (caller LIKE '%1' OR caller LIKE '%2' OR (length(caller) = 9 AND CAST(caller AS BIGINT) BETWEEN 420000100 AND 420000149)) AND src_ip // 128 = 167772160 // 128
  AND ua LIKE 'ua%' AND dur_us // 1000000 BETWEEN 10 AND 300""",
    "rerated": f"""SELECT id, rule_id, old, new FROM (SELECT id, rule_id, {_PRICE('price')} AS old, {_PRICE('CASE WHEN rule_id = 2 THEN price * 2 ELSE price END')} AS new
FROM (SELECT *, nation % 3 + 1 AS rid FROM {CDR_BILLING}) JOIN {values(BILLING_RULES, 'r(rule_id, price, price_peak, t1, t2)')} ON rid = rule_id WHERE id IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')) WHERE old <> new""",
}
