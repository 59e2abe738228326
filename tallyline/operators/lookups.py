"""Joins: longest prefix, ranges, best weight, children, existence, codebooks and request-response pairs.

Prefix and range lookups become equality joins: a number carries each of its prefixes, a range each block of addresses
that it touches. The few rules of a rule set, whose number is fixed, are an array literal that each row searches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyline.functions import semantics as X
from tallyline.session import table
from tallyline.sources.calls import BILLING_ASSIGNMENTS, CDR, CDR_BILLING, CDR_RTP, COUNTRY_PREFIXES, GEO_RANGES, cdr, cdr_billing, cdr_rtp, small, values

c = F.col
LONGEST_PREFIX = max(len(p) for p, _ in COUNTRY_PREFIXES)


def international(number: Column) -> Column:
    """A number without its leading zeros."""
    return F.regexp_replace(number, "^0+", "")


def prefix_join(rows: DataFrame, number: str, prefixes: DataFrame, longest: int) -> DataFrame:
    """Adds prefix and country of the longest prefix of a number; rows without one are dropped.

    Distinct numbers are looked up once, so a hot number is exploded once.
    """
    distinct = rows.select(number).distinct()
    sizes = F.sequence(F.lit(1), F.least(F.lit(longest), F.length(number)))
    exploded = distinct.select(number, F.explode(F.transform(sizes, lambda n: F.substring(c(number), F.lit(1), n))).alias("prefix"))
    best = exploded.join(prefixes, "prefix").groupBy(number).agg(F.max_by(F.struct("prefix", "country"), F.length("prefix")).alias("_m"))
    return rows.join(best.select(number, "_m.prefix", "_m.country"), number)


def longest_prefix_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = cdr(spark, sf_dir).select("call_id", international(c("called")).alias("number"))
    return prefix_join(calls.where("number <> ''"), "number", small(spark, COUNTRY_PREFIXES, "prefix string, country string"), LONGEST_PREFIX)


def range_join(points: DataFrame, value: str, ranges: DataFrame, low: str, high: str, bits: int = 16) -> DataFrame:
    """Points joined with every range that holds them, through the blocks of 2**bits values that a range touches."""
    blocks = ranges.withColumn("_block", F.explode(F.sequence(F.shiftright(low, bits), F.shiftright(high, bits))))
    keyed = points.withColumn("_block", F.shiftright(value, bits))
    return keyed.join(blocks, "_block").where(c(value).between(c(low), c(high))).drop("_block")


def range_join_geoip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The country of each source address: of the ranges that hold it, the one that begins last."""
    calls = cdr(spark, sf_dir).groupBy("src_ip").agg(F.count("*").alias("n"))
    ranges = small(spark, GEO_RANGES, "ip_from long, ip_to long, country string")
    found = range_join(calls, "src_ip", ranges, "ip_from", "ip_to")
    best = found.groupBy("src_ip", "n").agg(F.max_by("country", "ip_from").alias("country"))
    return best


def text_range_join(points: DataFrame, value: str, ranges: DataFrame, low: str, high: str) -> DataFrame:
    """Points joined with every range that holds them, compared as text, ends included.

    All texts of a range begin with what its ends have in common. That beginning is the key; a point gives one for each
    length that occurs. So ranges and points may both be many, and a range meets only points of its own beginning.
    """
    same = lambda n: F.substring(c(low), F.lit(1), n) == F.substring(c(high), F.lit(1), n)
    size = F.size(F.filter(F.sequence(F.lit(0), F.least(F.length(low), F.length(high))), same)) - 1
    keyed = ranges.where(c(low) <= c(high)).withColumn("_size", size).withColumn("_begin", F.substring(c(low), F.lit(1), c("_size")))
    sizes = sorted(r["_size"] for r in keyed.select("_size").distinct().collect())  # no more than the longest number has digits
    each = points.withColumn("_size", F.explode(F.array(*map(F.lit, sizes))) if sizes else F.lit(-1))
    each = each.withColumn("_begin", F.substring(c(value), F.lit(1), c("_size")))
    return each.join(keyed, ["_size", "_begin"]).where(c(value).between(c(low), c(high))).drop("_size", "_begin")


def number_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers by ranges of numbers, compared as text: every seventh one has ten numbers, some share some."""
    calls = cdr(spark, sf_dir).groupBy("caller").agg(F.count("*").alias("n"))
    number = lambda x: F.concat(F.lit("420"), F.lpad(x.cast("string"), 6, "0"))
    k = c("c_custkey")
    r = table(spark, sf_dir, "customer").where("c_custkey % 7 = 0").select(number(k).alias("number_from"), number(k + 9).alias("number_to"), k.alias("customer_id"))
    return text_range_join(calls, "caller", r, "number_from", "number_to").select("caller", "n", "customer_id")


def best_assignments(calls: DataFrame, rules: DataFrame, longest: int = 16) -> DataFrame:
    """src_ip, called, username with the assignment of the greatest weight, from a table of assignments of any size:
    id, rule_id, ip_from, ip_to, prefix, user.

    An address in the range weighs 30, a number with the prefix 20; beside these, or without either in the rule, the
    rule's user weighs 100, and no user where the call has none 1. Both conditions are equality joins, through blocks
    of addresses and the beginnings of numbers, over what is distinct in the calls.
    """
    keys = ["src_ip", "called", "username"]
    combos = calls.select(*keys).distinct()
    ips = range_join(combos.select("src_ip").distinct(), "src_ip", rules.where("ip_from IS NOT NULL"), "ip_from", "ip_to").select("src_ip", "id", F.lit(30).alias("w"))
    sizes = F.sequence(F.lit(1), F.least(F.lit(longest), F.length("called")))
    heads = combos.select("called").distinct().select("called", F.explode(F.transform(sizes, lambda n: F.substring(c("called"), F.lit(1), n))).alias("prefix"))
    numbers = heads.join(rules.where("prefix IS NOT NULL"), "prefix").select("called", "id", F.lit(20).alias("w"))
    free = rules.where("ip_from IS NULL AND prefix IS NULL").select(F.coalesce("user", F.lit("")).alias("username"), "id", F.lit(0).alias("w"))
    hits = combos.join(ips, "src_ip").unionByName(combos.join(numbers, "called")).unionByName(combos.join(free, "username"))
    hits = hits.groupBy(*keys, "id").agg(F.sum("w").alias("base")).join(rules.select("id", "rule_id", "user"), "id")
    named = c("user").isNotNull()
    weight = F.when(named & (c("user") == c("username")), c("base") + 100).when(named, 0).when(c("username") == "", c("base") + 1).otherwise(c("base"))
    best = hits.withColumn("weight", weight.cast("int")).where("weight > 0").groupBy(*keys).agg(F.max_by(F.struct("id", "rule_id", "weight"), F.struct(c("weight"), -c("id"))).alias("_b"))
    return best.select(*keys, c("_b.id").alias("assignment_id"), "_b.rule_id", "_b.weight")


def best_weight_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The billing assignment of each call with the greatest weight; ties go to the lowest id. An assignment that names
    a user and does not match it weighs nothing."""
    calls = cdr(spark, sf_dir).withColumn("username", F.when(c("k") % 4 != 0, c("ua")).otherwise("")).select("call_id", "src_ip", "called", "username")
    rules = small(spark, BILLING_ASSIGNMENTS, "id int, rule_id int, ip_from long, ip_to long, prefix string, user string")
    return calls.join(best_assignments(calls, rules), ["src_ip", "called", "username"]).select("call_id", "assignment_id", "rule_id", "weight")


# Number patterns as (kind, pattern, class), fixed numbers before regular expressions before prefixes.
NUMBER_PATTERNS = [("fixed", "0049000007", "vip"), ("regex", "^0049.*7$", "de-seven"), ("regex", "^00[0-9]+77$", "double-seven"), ("prefix", "0049", "de"), ("prefix", "00", "international"), ("prefix", "420", "home")]


def number_pattern_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pattern of each called number: a fixed number, else the longest matching expression, else the longest prefix."""
    pass_of = {"fixed": 3, "regex": 2, "prefix": 1}
    hits = []
    for kind, pattern, name in NUMBER_PATTERNS:
        hit = c("called") == pattern if kind == "fixed" else c("called").rlike(pattern) if kind == "regex" else c("called").startswith(pattern)
        hits.append(F.when(hit, F.struct(F.lit(pass_of[kind]).alias("pass"), F.lit(len(pattern)).alias("size"), F.lit(name).alias("name"))))
    numbers = cdr(spark, sf_dir).groupBy("called").agg(F.count("*").alias("n")).withColumn("_b", F.array_max(F.filter(F.array(*hits), lambda h: h.isNotNull())))
    return numbers.where("_b IS NOT NULL").select("called", "n", c("_b.name").alias("number_type"), c("_b.pass").alias("pass"))


def left_join_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls with their first stream where there is one, on the composite key (id, index)."""
    o = table(spark, sf_dir, "orders").select(c("o_orderkey").alias("cdr_id"), F.lit(1).alias("idx"), "o_orderpriority")
    rtp = cdr_rtp(spark, sf_dir).where("received > 2000").select("cdr_id", "idx", "saddr", "received", "lost")
    return o.join(rtp, ["cdr_id", "idx"], "left")


def semi_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls that have a stream which lost more than 400 packets, and those that have none, as semi and anti join."""
    o = table(spark, sf_dir, "orders").select(c("o_orderkey").alias("cdr_id"), c("o_custkey").alias("customer"))
    lossy = cdr_rtp(spark, sf_dir).where("lost > 400").select("cdr_id")
    some, none = o.join(lossy, "cdr_id", "left_semi"), o.join(lossy, "cdr_id", "left_anti")
    return some.withColumn("part", F.lit("some")).unionByName(none.withColumn("part", F.lit("none"))).groupBy("part", "customer").agg(F.count("*").alias("n"))


def dedup_prefer_rtp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record of each call id that several sensors saw: one with media before the rest, then the earliest."""
    seen = cdr(spark, sf_dir).withColumn("key", F.concat_ws("-", "caller", (c("k") % 20).cast("string"))).withColumn("has_rtp", (c("a_rtp") | c("b_rtp")).cast("int"))
    best = F.min_by(F.struct("call_id", "sensor_id", "has_rtp"), F.struct(-c("has_rtp"), c("b_us"), c("call_id")))
    return seen.groupBy("key").agg(best.alias("b"), F.count("*").alias("seen")).select("key", "b.call_id", "b.sensor_id", "b.has_rtp", "seen")


def codebook_upsert(spark: SparkSession, sf_dir: str, blocks: int = 256) -> DataFrame:
    """Ids of strings: known ones keep theirs, new ones get the next by their order.

    The strings of least hash are an even sample; they cut the order into blocks that are numbered in parallel, and a
    block begins after the sizes of those before it. The cuts follow from the strings alone, so a lost task repeats them.
    """
    texts = cdr(spark, sf_dir).select(c("called").alias("text")).distinct()
    known = texts.where("text LIKE '420%'").withColumn("id", F.substring("text", 4, 6).cast("bigint"))
    new = texts.join(known, "text", "left_anti")
    last = known.agg(F.coalesce(F.max("id"), F.lit(0)).alias("last"))
    cuts = new.orderBy(F.xxhash64("text"), "text").limit(blocks - 1).agg(F.array_sort(F.collect_list("text")).alias("cuts"))
    placed = new.crossJoin(F.broadcast(cuts)).select("text", F.size(F.filter("cuts", lambda x: x < c("text"))).alias("block"))
    sizes = placed.groupBy("block").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(W.orderBy("block").rowsBetween(W.unboundedPreceding, 0)) - c("n"))
    ranked = placed.withColumn("rn", F.row_number().over(W.partitionBy("block").orderBy("text"))).join(F.broadcast(sizes), "block").crossJoin(F.broadcast(last))
    return known.withColumn("is_new", F.lit(False)).unionByName(ranked.select("text", (c("last") + c("before") + c("rn")).alias("id"), F.lit(True).alias("is_new")))


def rule_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules with the sorted members of their groups."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return r.join(n, r["r_regionkey"] == n["n_regionkey"]).groupBy("r_name").agg(F.array_join(F.array_sort(F.collect_list("n_name")), ",").alias("members"), F.count("*").alias("n_members"))


def country_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of places joined with itself on the parent's id."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    places = r.select((c("r_regionkey") + 1000).alias("id"), c("r_name").alias("name"), F.lit(None).cast("int").alias("parent_id")).unionByName(n.select(c("n_nationkey").alias("id"), c("n_name").alias("name"), (c("n_regionkey") + 1000).alias("parent_id")))
    p = places.select(c("id").alias("parent_id"), c("name").alias("parent"))
    return places.join(p, "parent_id").select("id", "name", "parent")


CURRENCIES = [(0, "USD", 1.0), (1, "EUR", 1.1), (2, "CZK", 0.04)]


def currency_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Billed calls by currency; a code without a rate keeps its calls at rate 1."""
    rates = small(spark, CURRENCIES, "code int, currency string, rate double")
    calls = cdr_billing(spark, sf_dir).withColumn("code", c("nation") % 5).join(rates, "code", "left")
    return calls.groupBy("code", F.coalesce("currency", F.lit("?")).alias("currency")).agg(F.count("*").alias("n"), F.round(F.sum("dur_s") * F.max(F.coalesce("rate", F.lit(1.0))), 4).alias("weighted"))


def req_resp_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests with the response that follows them in the same dialog; unanswered ones stay."""
    t = table(spark, sf_dir, "conversations")
    req = t.where("turn % 2 = 0").select("conv_id", (c("turn") + 1).alias("cseq"), F.length("text").alias("request_size"))
    resp = t.where("turn % 2 = 1").groupBy("conv_id", c("turn").alias("cseq")).agg(F.min(F.length("text")).alias("response_size"))
    return req.join(resp, ["conv_id", "cseq"], "left")


def rtcp_rtd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Round trips: a report matches the sender report of the same (source, timestamp); only positive times count."""
    sr = cdr_rtp(spark, sf_dir).select("ssrc", c("cdr_id").alias("lsr"), (F.expr("t_us div 1000000") * 65536).alias("sent"))
    rr = table(spark, sf_dir, "lineitem").select(c("l_partkey").alias("ssrc"), c("l_orderkey").alias("lsr"), (F.expr("unix_micros(cast(l_shipdate AS timestamp)) div 1000000") * 65536 + c("l_linenumber") * 65536 * 3).alias("arrived"), (c("l_quantity").cast("bigint") * 6553).alias("dlsr"))
    ticks = c("arrived") - c("sent") - c("dlsr")
    return sr.join(rr, ["ssrc", "lsr"]).where(ticks > 0).groupBy("ssrc").agg(F.count("*").alias("n"), F.round(F.avg(ticks) / 65536 * 1000, 3).alias("rtd_ms"))


def handover_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls that continue another one: same number suffix, begun inside the other call's time range.

    The suffix and the day are equality keys, so the range test sees calls of one suffix and day or the day after.
    """
    calls = cdr(spark, sf_dir)
    day = lambda t: F.floor(t / 86_400_000_000)
    post = calls.select(c("call_id").alias("post_id"), F.substring("called", -6, 6).alias("suffix"), c("b_us").alias("post_us"), day(c("b_us")).alias("day"))
    pre = calls.select(c("call_id").alias("pre_id"), F.substring("caller", -6, 6).alias("suffix"), "b_us", "e_us", F.explode(F.sequence(day(c("b_us")), day(c("e_us")))).alias("day"))
    return post.join(pre, ["suffix", "day"]).where("post_us > b_us AND post_us <= e_us").select("post_id", "pre_id", "suffix")


def http_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests and responses by key, where bodies that repeat by their digest count once."""
    t = table(spark, sf_dir, "conversations").withColumn("digest", F.md5("text"))
    once = t.groupBy("digest", "role").agg(F.min(F.struct("conv_id", "turn")).alias("x")).select("digest", "role", "x.conv_id", "x.turn")
    return once.groupBy("conv_id").agg(F.count_if(c("role") == "user").alias("requests"), F.count_if(c("role") != "user").alias("responses"))


def reassign_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls whose stored country differs from the one that is found now."""
    calls = cdr(spark, sf_dir).select("call_id", international(c("called")).alias("number"), F.element_at(F.array(*map(F.lit, ("DE", "GB", "CZ", "US"))), (c("k") % 4 + 1).cast("int")).alias("stored"))
    now = prefix_join(calls.where("number <> ''"), "number", small(spark, COUNTRY_PREFIXES, "prefix string, country string"), LONGEST_PREFIX)
    return now.where("stored <> country").select("call_id", "stored", "country")


QUERIES = {
    f.__name__: f
    for f in (longest_prefix_match, range_join_geoip, number_range_join, best_weight_match, number_pattern_rank, left_join_children, semi_exists, dedup_prefer_rtp, codebook_upsert, rule_groups, country_parents, currency_left_join, req_resp_match, rtcp_rtd, handover_match, http_pairs, reassign_diff)
}

_COUNTRY = f"""(SELECT call_id, number, k, prefix, country FROM (SELECT call_id, number, k, prefix, country, row_number() OVER (PARTITION BY call_id ORDER BY length(prefix) DESC) AS rn
  FROM (SELECT call_id, k, regexp_replace(called, '^0+', '') AS number FROM {CDR}) JOIN {values(COUNTRY_PREFIXES, 'p(prefix, country)')} ON starts_with(number, prefix)) WHERE rn = 1)"""


def _weights_sql() -> str:
    rows = []
    for number, rule, ip_from, ip_to, prefix, user in BILLING_ASSIGNMENTS:
        ip = f"CASE WHEN src_ip BETWEEN {ip_from} AND {ip_to} THEN 30 ELSE 0 END" if ip_from is not None else "0"
        num = f"CASE WHEN starts_with(called, '{prefix}') THEN 20 ELSE 0 END" if prefix is not None else "0"
        base = f"({ip} + {num})"
        fits = f"({base} > 0 OR {'true' if ip_from is None and prefix is None else 'false'})"
        weight = f"CASE WHEN {fits} AND username = '{user}' THEN {base} + 100 ELSE 0 END" if user is not None else f"CASE WHEN {fits} AND username = '' THEN {base} + 1 ELSE {base} END"
        rows.append(f"SELECT call_id, {number} AS assignment_id, {rule} AS rule_id, {weight} AS weight FROM c")
    return f"""WITH c AS (SELECT *, CASE WHEN k % 4 <> 0 THEN ua ELSE '' END AS username FROM {CDR}), w AS ({' UNION ALL '.join(rows)})
SELECT call_id, assignment_id, rule_id, weight FROM (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY weight DESC, assignment_id) AS rn FROM w WHERE weight > 0) WHERE rn = 1"""


def _patterns_sql() -> str:
    rows = []
    for kind, pattern, name in NUMBER_PATTERNS:
        hit = f"called = '{pattern}'" if kind == "fixed" else f"regexp_matches(called, '{pattern}')" if kind == "regex" else f"starts_with(called, '{pattern}')"
        rows.append(f"SELECT called, n, '{name}' AS number_type, {dict(fixed=3, regex=2, prefix=1)[kind]} AS pass, {len(pattern)} AS size FROM c WHERE {hit}")
    return f"WITH c AS (SELECT called, count(*) AS n FROM {CDR} GROUP BY called), h AS ({' UNION ALL '.join(rows)}) SELECT called, n, number_type, pass FROM (SELECT *, row_number() OVER (PARTITION BY called ORDER BY pass DESC, size DESC) AS rn FROM h) WHERE rn = 1"


ORACLE_SQL = {
    "longest_prefix_match": f"SELECT call_id, number, prefix, country FROM {_COUNTRY}",
    "range_join_geoip": f"""SELECT src_ip, n, country FROM (SELECT src_ip, n, country, row_number() OVER (PARTITION BY src_ip ORDER BY ip_from DESC) AS rn FROM (SELECT src_ip, count(*) AS n FROM {CDR} GROUP BY src_ip)
  JOIN {values(GEO_RANGES, 'g(ip_from, ip_to, country)')} ON src_ip BETWEEN ip_from AND ip_to) WHERE rn = 1""",
    "number_range_join": f"""SELECT caller, n, c_custkey AS customer_id FROM (SELECT caller, count(*) AS n FROM {CDR} GROUP BY caller) JOIN customer ON c_custkey % 7 = 0
  AND caller BETWEEN '420' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') AND '420' || lpad(CAST(c_custkey + 9 AS VARCHAR), 6, '0')""",
    "best_weight_match": _weights_sql(),
    "number_pattern_rank": _patterns_sql(),
    "left_join_children": f"""SELECT o_orderkey AS cdr_id, 1 AS idx, o_orderpriority, saddr, received, lost FROM orders LEFT JOIN (SELECT * FROM {CDR_RTP} WHERE received > 2000) r ON o_orderkey = r.cdr_id AND r.idx = 1""",
    "semi_exists": f"""SELECT part, customer, count(*) AS n FROM (SELECT o_custkey AS customer, CASE WHEN o_orderkey IN (SELECT cdr_id FROM {CDR_RTP} WHERE lost > 400) THEN 'some' ELSE 'none' END AS part FROM orders) GROUP BY part, customer""",
    "dedup_prefer_rtp": f"""SELECT key, call_id, sensor_id, has_rtp, seen FROM (SELECT *, count(*) OVER (PARTITION BY key) AS seen, row_number() OVER (PARTITION BY key ORDER BY has_rtp DESC, b_us, call_id) AS rn
  FROM (SELECT *, caller || '-' || CAST(k % 20 AS VARCHAR) AS key, CASE WHEN a_rtp OR b_rtp THEN 1 ELSE 0 END AS has_rtp FROM {CDR})) WHERE rn = 1""",
    "codebook_upsert": f"""WITH t AS (SELECT DISTINCT called AS text FROM {CDR}), known AS (SELECT text, CAST(substring(text, 4, 6) AS BIGINT) AS id FROM t WHERE text LIKE '420%')
SELECT text, id, false AS is_new FROM known UNION ALL SELECT text, (SELECT coalesce(max(id), 0) FROM known) + row_number() OVER (ORDER BY text) AS id, true AS is_new FROM t WHERE text NOT LIKE '420%'""",
    "rule_groups": "SELECT r_name, string_agg(n_name, ',' ORDER BY n_name) AS members, count(*) AS n_members FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY r_name",
    "country_parents": "SELECT n_nationkey AS id, n_name AS name, r_name AS parent FROM nation JOIN region ON n_regionkey = r_regionkey",
    "currency_left_join": f"""SELECT code, coalesce(currency, '?') AS currency, count(*) AS n, round(CAST(sum(dur_s) AS DOUBLE) * max(CAST(coalesce(rate, 1.0) AS DOUBLE)), 4) AS weighted FROM (SELECT *, nation % 5 AS code FROM {CDR_BILLING})
  LEFT JOIN {values(CURRENCIES, 'r(rcode, currency, rate)')} ON code = rcode GROUP BY code, currency""",
    "req_resp_match": """SELECT q.conv_id, q.turn + 1 AS cseq, length(q.text) AS request_size, r.response_size FROM conversations q
LEFT JOIN (SELECT conv_id, turn, min(length(text)) AS response_size FROM conversations WHERE turn % 2 = 1 GROUP BY conv_id, turn) r ON q.conv_id = r.conv_id AND q.turn + 1 = r.turn WHERE q.turn % 2 = 0""",
    "rtcp_rtd": f"""SELECT ssrc, count(*) AS n, round(avg(ticks) / 65536 * 1000, 3) AS rtd_ms FROM (SELECT s.ssrc, epoch_us(l_shipdate) // 1000000 * 65536 + l_linenumber * 65536 * 3 - s.t_us // 1000000 * 65536 - CAST(l_quantity AS BIGINT) * 6553 AS ticks
  FROM {CDR_RTP} s JOIN lineitem ON s.ssrc = l_partkey AND s.cdr_id = l_orderkey) WHERE ticks > 0 GROUP BY ssrc""",
    "handover_match": f"""SELECT a.call_id AS post_id, b.call_id AS pre_id, substring(a.called, length(a.called) - 5, 6) AS suffix FROM {CDR} a JOIN {CDR} b
  ON substring(a.called, length(a.called) - 5, 6) = substring(b.caller, length(b.caller) - 5, 6) AND a.b_us > b.b_us AND a.b_us <= b.e_us""",
    "http_pairs": """SELECT conv_id, count(*) FILTER (WHERE role = 'user') AS requests, count(*) FILTER (WHERE role <> 'user') AS responses FROM (SELECT conv_id, role, row_number() OVER (PARTITION BY md5(text), role ORDER BY conv_id, turn) AS rn
  FROM conversations) WHERE rn = 1 GROUP BY conv_id""",
    "reassign_diff": f"SELECT call_id, stored, country FROM (SELECT call_id, country, CASE k % 4 WHEN 0 THEN 'DE' WHEN 1 THEN 'GB' WHEN 2 THEN 'CZ' ELSE 'US' END AS stored FROM {_COUNTRY}) WHERE stored <> country",
}
