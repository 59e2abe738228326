"""The wide aggregate products: per-address statistics, problem counters and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyline.operators.intervals import END_SECOND, NER, QUARTER, QUARTERS, S, SEER, dealt, end_second, expand, expanded_sql, lsr_matches, overlap, quarters, r6
from tallyline.sources.calls import CDR, cdr

KEYS = ["side", "sensor_id", "ip", "bucket"]

#: What is measured once for each call, as SQL that both engines read: (expression, divisor, whether small values are bad).
MEASURES = {
    "mos": ("mos_x10", 10, True),
    "packet_loss": ("k % 23", 1, False),
    "jitter": ("k * 3 % 41", 1, False),
    "delay": ("k % 9 * 10", 1, False),
    "pdd": ("k % 13 * 100", 1, False),
    "pbd": ("k % 17 * 50", 1, False),
    "mos_xr_min": ("mos_x10 - k % 3", 10, True),
    "mos_xr_avg": ("mos_x10 - k % 2", 10, True),
    "mos_silence_min": ("k % 7 + 34", 10, True),
    "mos_silence_avg": ("k % 5 + 36", 10, True),
    "packet_lost_connected": ("CASE WHEN connect_us IS NOT NULL THEN k % 23 END", 1, False),
}
STAT_VALUES = ["mos", "packet_loss", "jitter", "delay"]
SUMMARY_VALUES = ["pdd", "pbd", "mos", "mos_xr_min", "mos_xr_avg", "mos_silence_min", "mos_silence_avg", "packet_lost_connected", "jitter", "delay"]
PERCENTS = (95, 99)
PRICES = {"price_customer": 1.2, "price_operator": 0.6}


def sides(rows: DataFrame) -> DataFrame:
    """Each row once for its source and once for its destination address."""
    both = F.array(F.struct(F.lit("src").alias("side"), F.col("src_ip").alias("ip")), F.struct(F.lit("dst").alias("side"), F.col("dst_ip").alias("ip")))
    return rows.withColumn("_s", F.explode(both)).select("*", "_s.side", "_s.ip").drop("_s")


def none_if_zero(c: Column) -> Column:
    """Stored ratios and minutes of exactly zero are null."""
    return F.nullif(c, F.lit(0.0))


def counters(rows: DataFrame, keys: list[str]) -> DataFrame:
    """What adds up over calls: counts by answer, ratios and prices of calls that begin in the bucket, minutes inside it."""
    first, connected = F.col("first"), F.col("connect_us").isNotNull()
    began, answered = F.count_if(first), F.count_if(first & connected)
    seconds = F.sum(F.when(first, F.col("connect_us")))
    return rows.groupBy(*keys).agg(
        began.alias("count_all"),
        answered.alias("count_connected"),
        *(F.count_if(first & F.col("lsr").cast("string").startswith(str(k))).alias(f"count_lsr_{k}") for k in (3, 4, 5, 6)),
        F.count_if(first & (F.col("a_rtp") | F.col("b_rtp"))).alias("count_exists_rtp"),
        none_if_zero(F.expr("(coalesce(sum(overlap_us), 0) + 30) div 60") / S).alias("minutes"),  # rounded half up in whole numbers
        none_if_zero(r6(F.try_divide(answered, began) * 100)).alias("asr"),
        r6(F.try_divide(seconds, answered) / S).alias("acd"),
        none_if_zero(r6(F.try_divide(F.count_if(first & (connected | lsr_matches(F.col("lsr"), *NER))), began) * 100)).alias("ner"),
        none_if_zero(r6(F.try_divide(F.count_if(first & F.col("lsr").isin(*SEER)), F.count_if(first & ~F.col("lsr").cast("string").startswith("3"))) * 100)).alias("seer"),
        *(r6(seconds * rate / (60 * S)).alias(name) for name, rate in PRICES.items()),
    )


def distributions(rows: DataFrame, keys: list[str], width: int, values: list[str], by_keys: bool = False) -> DataFrame:
    """Occupancy, begins per second, and mean and nearest-rank percentiles of measures, all from one counted table.

    A call gives (kind, x, n): +1 and -1 at the seconds where it enters and leaves the bucket, its second of begin, and
    its measures other than zero. They are counted by x first, so what is then ordered inside a bucket are its seconds
    and distinct values, however many calls it has. One exchange by the keys serves the windows and the last aggregate; rows
    that are dealt `by_keys` already need none of their facts, of which there are many for each call.
    """
    fact = lambda kind, x, n=1: F.struct(F.lit(kind).cast("byte").alias("kind"), x.cast("bigint").alias("x"), F.lit(n).cast("bigint").alias("n"))
    enter = F.greatest(F.floor(F.col("b_us") / S), F.col("bucket"))
    leave = F.least(end_second(F.col("e_us")), F.col("bucket") + width - 1) + 1
    own = [fact(1, F.floor(F.col("b_us") / S))]
    for kind, name in enumerate(values, 2):
        x = F.expr(MEASURES[name][0])
        own.append(F.when(x != 0, fact(kind, -x if MEASURES[name][2] else x)))  # the worst value comes last
    both = [fact(0, enter), fact(0, leave, -1)]
    facts = rows.select(*keys, F.explode(F.when(F.col("first"), F.array(*both, *own)).otherwise(F.array(*both))).alias("f")).where("f IS NOT NULL")
    counted = facts.groupBy(*keys, "f.kind", "f.x").agg(F.sum("f.n").alias("n"))
    counted = counted if by_keys else counted.repartition(*keys)
    whole = W.partitionBy(*keys, "kind")
    to = F.sum("n").over(whole.orderBy("x").rowsBetween(W.unboundedPreceding, 0))
    counted = counted.select("*", to.alias("to"), (F.lead("x").over(whole.orderBy("x")) - F.col("x")).alias("seconds"), F.sum("n").over(whole).alias("total"))
    kind, n, to, x = F.col("kind"), F.col("n"), F.col("to"), F.col("x")
    busy, begun = (kind == 0) & (to > 0), kind == 1
    out = [
        F.min(F.when(busy, to)).alias("cc_min"),
        F.max(F.when(busy, to)).alias("cc_max"),
        r6(F.sum(F.when(busy, to * F.col("seconds"))) / F.sum(F.when(busy, F.col("seconds")))).alias("cc_avg"),
        F.max(F.when(begun, F.lit(0).cast("bigint"))).alias("cps_min"),
        F.max(F.when(begun, n)).alias("cps_max"),
        r6(F.sum(F.when(begun, n)) / width).alias("cps_avg"),
    ]
    for k, name in enumerate(values, 2):
        sign, divisor = -1 if MEASURES[name][2] else 1, MEASURES[name][1]
        out.append(r6(F.try_divide(F.sum(F.when(kind == k, x * n)), F.sum(F.when(kind == k, n))) * sign / divisor).alias(f"{name}_avg"))
        for p in PERCENTS:
            at = F.least(F.round(F.col("total") * p / 100.0).cast("bigint"), F.col("total") - 1)
            out.append((F.max(F.when((kind == k) & (to > at) & (to - n <= at), x * sign)) / divisor).alias(f"{name}_perc{p}"))
    return counted.groupBy(*keys).agg(*out)


def product(rows: DataFrame, keys: list[str], width: int, values: list[str]) -> DataFrame:
    """Counters and distributions of calls by bucket; rows are calls expanded over the buckets that they touch."""
    rows, by_keys = dealt(rows, keys, "bucket")
    return counters(overlap(rows, width), keys).join(distributions(rows, keys, width, values, by_keys), keys, "left")


def _product_sql(calls: str, keys: list[str], width: int, values: list[str]) -> str:
    k = ", ".join(keys)
    began, answered = "count(*) FILTER (WHERE first)", "count(connect_us) FILTER (WHERE first)"
    seconds = "CAST(sum(CASE WHEN first THEN connect_us END) AS DOUBLE)"
    ctes, joins = [], []
    for name in values:
        x, divisor, worst_small = MEASURES[name]
        ranks = ", ".join(f"max(CASE WHEN rn = least(CAST(round(n * {p} / 100.0) AS BIGINT), n - 1) THEN x END) / {divisor:.1f} AS {name}_perc{p}" for p in PERCENTS)
        ctes.append(f"""v_{name} AS (SELECT {k}, round(avg(x) / {divisor}, 6) AS {name}_avg, {ranks} FROM (SELECT {k}, x, row_number() OVER (PARTITION BY {k} ORDER BY x {'DESC' if worst_small else 'ASC'}) - 1 AS rn,
  count(*) OVER (PARTITION BY {k}) AS n FROM (SELECT {k}, {x} AS x FROM q WHERE first) WHERE x <> 0) GROUP BY {k})""")
        joins.append(f" LEFT JOIN v_{name} USING ({k})")
    prices = ", ".join(f"round({seconds} * {rate} / 60000000, 6) AS {name}" for name, rate in PRICES.items())
    return f"""WITH q AS (SELECT *, greatest(0, least(e_us, (bucket + {width}) * 1000000) - greatest(e_us - connect_us, bucket * 1000000)) AS overlap_us FROM {calls}),
base AS (SELECT {k}, {began} AS count_all, {answered} AS count_connected, {', '.join(f'count(*) FILTER (WHERE first AND lsr // 100 = {c}) AS count_lsr_{c}' for c in (3, 4, 5, 6))},
  count(*) FILTER (WHERE first AND (a_rtp OR b_rtp)) AS count_exists_rtp, nullif(CAST((CAST(coalesce(sum(CASE WHEN connect_us IS NOT NULL THEN overlap_us END), 0) AS BIGINT) + 30) // 60 AS DOUBLE) / 1000000, 0) AS minutes,
  nullif(round({answered} * 1.0 / nullif({began}, 0) * 100, 6), 0) AS asr, round({seconds} / nullif({answered}, 0) / 1000000, 6) AS acd,
  nullif(round(count(*) FILTER (WHERE first AND (connect_us IS NOT NULL OR lsr IN (600, 603, 604, 607, 608) OR lsr // 100 IN (2, 3, 4))) * 1.0 / nullif({began}, 0) * 100, 6), 0) AS ner,
  nullif(round(count(*) FILTER (WHERE first AND lsr IN (200, 480, 486, 600, 603)) * 1.0 / nullif(count(*) FILTER (WHERE first AND lsr // 100 <> 3), 0) * 100, 6), 0) AS seer, {prices} FROM q GROUP BY {k}),
busy AS (SELECT {k}, min(n) AS cc_min, max(n) AS cc_max, round(CAST(sum(n) AS DOUBLE) / count(*), 6) AS cc_avg FROM (SELECT {k}, t, count(*) AS n
  FROM (SELECT {k}, unnest(generate_series(greatest(b_us // 1000000, bucket), least({END_SECOND}, bucket + {width - 1}))) AS t FROM q) GROUP BY {k}, t) GROUP BY {k}),
begun AS (SELECT {k}, CAST(0 AS BIGINT) AS cps_min, max(n) AS cps_max, round(CAST(sum(n) AS DOUBLE) / {width}, 6) AS cps_avg
  FROM (SELECT {k}, b_us // 1000000 AS t, count(*) AS n FROM q WHERE first GROUP BY ALL) GROUP BY {k}),
{', '.join(ctes)}
SELECT * FROM base LEFT JOIN busy USING ({k}) LEFT JOIN begun USING ({k}){''.join(joins)}"""


def cdr_stat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarter-hour statistics of each address on either side.

    Calls and their measures count where they begin; occupancy and minutes count in every quarter that they touch.
    """
    return product(sides(quarters(cdr(spark, sf_dir))), KEYS, QUARTER, STAT_VALUES)


_SIDES = f"(SELECT 'src' AS side, src_ip AS ip, * FROM {QUARTERS} UNION ALL SELECT 'dst' AS side, dst_ip AS ip, * FROM {QUARTERS})"
CDR_STAT = _product_sql(_SIDES, KEYS, QUARTER, STAT_VALUES)

# The networks of own servers and of public trunks (network, mask), and the flag bits that are counted.
SERVER_NETS, TRUNK_NETS = [(3232235520, 30), (167772192, 27)], [(167772160, 27)]
FLAGS = {"missing_srtp_key": 1, "fas": 2, "zerossrc": 4, "sipalg": 8}
BYE_CODES = [2, *range(100, 111)]


def in_nets(ip: Column, nets: list[tuple[int, int]]) -> Column:
    found = F.lit(False)
    for net, mask in nets:
        found |= F.shiftright(ip, 32 - mask) == net >> (32 - mask)
    return found


#: The score on a side: that of the caller for the source, and of the called one for the destination.
SIDE_MOS = "CASE side WHEN 'src' THEN mos_x10 ELSE greatest(10, mos_x10 - k % 4) END"


def cdr_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problem counters by address, by number and by both, for all calls and for those of each origin."""
    c = cdr(spark, sf_dir).withColumn("bucket", (F.floor(F.col("b_us") / (QUARTER * S)) * QUARTER).cast("bigint"))
    own = in_nets(F.col("dst_ip"), SERVER_NETS) & ~in_nets(F.col("src_ip"), SERVER_NETS)
    kinds = F.array(F.lit("all"), F.when(own, F.lit("own_clients")), F.when(in_nets(F.col("src_ip"), SERVER_NETS), F.lit("own_servers")), F.when(in_nets(F.col("src_ip"), TRUNK_NETS), F.lit("public_trunks")))
    c = c.withColumn("problem_type", F.explode(F.filter(kinds, lambda k: k.isNotNull())))
    both = F.array(F.struct(F.lit("src").alias("side"), F.col("src_ip").alias("ip"), F.col("caller").alias("number")), F.struct(F.lit("dst").alias("side"), F.col("dst_ip").alias("ip"), F.col("called").alias("number")))
    c = c.withColumn("_s", F.explode(both)).select("*", "_s.side", "_s.ip", "_s.number").drop("_s")
    mos, connected = F.expr(SIDE_MOS), F.col("connect_us").isNotNull()
    counts = {
        "count_all": F.lit(True),
        "count_connected": connected,
        "count_mos_lt_31": (mos > 0) & (mos < 31),
        "count_mos_lt_36": (mos >= 31) & (mos < 36),
        "count_mos_lt_40": (mos >= 36) & (mos < 40),
        "count_interrupted": F.col("bye") == 1,
        "count_one_way": connected & (F.col("a_rtp") != F.col("b_rtp")),
        "count_missing_rtp": connected & ~F.col("a_rtp") & ~F.col("b_rtp"),
        **{f"count_{name}": F.col("k").bitwiseAND(bit) != 0 for name, bit in FLAGS.items()},
        **{f"count_bye_{b}": F.col("bye") == b for b in BYE_CODES},
    }
    # The finest groups first, so that calls are shuffled once and the coarser groups add up what is left of them.
    common = ["sensor_id", "problem_type", "side", "bucket"]
    finest = c.groupBy(*common, "ip", "number").agg(*(F.count_if(condition).alias(name) for name, condition in counts.items()))
    keys = [F.col(k) for k in (*common, "ip", "number")]
    sets = [[F.col(k) for k in (*common, part)] for part in ("ip", "number")]
    coarse = finest.groupingSets(sets, *keys).agg(F.when(F.grouping("number") == 1, "ip").otherwise("number").alias("grouped_by"), *(F.sum(name).alias(name) for name in counts))
    return finest.withColumn("grouped_by", F.lit("comb")).unionByName(coarse)


def _nets_sql(ip: str, nets: list[tuple[int, int]]) -> str:
    return "(" + " OR ".join(f"({ip} >> {32 - m}) = {net >> (32 - m)}" for net, m in nets) + ")"


_KINDS = f"""(SELECT 'all' AS problem_type, c.* FROM {CDR} c UNION ALL SELECT 'own_clients', c.* FROM {CDR} c WHERE {_nets_sql('dst_ip', SERVER_NETS)} AND NOT {_nets_sql('src_ip', SERVER_NETS)}
  UNION ALL SELECT 'own_servers', c.* FROM {CDR} c WHERE {_nets_sql('src_ip', SERVER_NETS)} UNION ALL SELECT 'public_trunks', c.* FROM {CDR} c WHERE {_nets_sql('src_ip', TRUNK_NETS)})"""

CDR_PROBLEMS = f"""WITH s AS (SELECT 'src' AS side, src_ip AS ip, caller AS number, b_us // 900000000 * 900 AS bucket, * FROM {_KINDS} UNION ALL SELECT 'dst', dst_ip, called, b_us // 900000000 * 900, * FROM {_KINDS}),
g AS (SELECT 'ip' AS grouped_by, ip AS g_ip, NULL AS g_number, * FROM s UNION ALL SELECT 'number', NULL, number, * FROM s UNION ALL SELECT 'comb', ip, number, * FROM s)
SELECT sensor_id, problem_type, side, bucket, g_ip AS ip, g_number AS number, grouped_by, count(*) AS count_all, count(connect_us) AS count_connected,
  count(*) FILTER (WHERE {SIDE_MOS} > 0 AND {SIDE_MOS} < 31) AS count_mos_lt_31, count(*) FILTER (WHERE {SIDE_MOS} >= 31 AND {SIDE_MOS} < 36) AS count_mos_lt_36,
  count(*) FILTER (WHERE {SIDE_MOS} >= 36 AND {SIDE_MOS} < 40) AS count_mos_lt_40, count(*) FILTER (WHERE bye = 1) AS count_interrupted,
  count(*) FILTER (WHERE connect_us IS NOT NULL AND a_rtp <> b_rtp) AS count_one_way, count(*) FILTER (WHERE connect_us IS NOT NULL AND NOT a_rtp AND NOT b_rtp) AS count_missing_rtp,
  {', '.join(f'count(*) FILTER (WHERE (k & {bit}) <> 0) AS count_{name}' for name, bit in FLAGS.items())},
  {', '.join(f'count(*) FILTER (WHERE bye = {b}) AS count_bye_{b}' for b in BYE_CODES)}
FROM g GROUP BY sensor_id, problem_type, side, bucket, g_ip, g_number, grouped_by"""

SUMMARY = ["sensor_id", "src_ip", "dst_ip", "src_number", "dst_number", "codec", "lsr", "lsr_text", "bucket"]
SUMMARY_WIDTH = 300
# The texts of responses that summaries are keyed by, in lower case.
LSR_TEXTS = {200: "ok", 301: "moved permanently", 404: "not found", 486: "busy here", 503: "service unavailable"}


def summary(calls: DataFrame, digits: int | None) -> DataFrame:
    """Five-minute summaries by both addresses, the first digits of both numbers (all if None), codec and response."""
    part = lambda number: F.substring(number, 1, digits) if digits else F.col(number)
    text = F.lower(F.element_at(F.create_map(*(F.lit(v) for pair in LSR_TEXTS.items() for v in pair)), F.col("lsr")))
    calls = calls.select("*", part("caller").alias("src_number"), part("called").alias("dst_number"), text.alias("lsr_text"))
    return product(expand(calls, SUMMARY_WIDTH, F.floor(F.col("b_us") / S), end_second(F.col("e_us"))), SUMMARY, SUMMARY_WIDTH, SUMMARY_VALUES)


def cdr_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary(cdr(spark, sf_dir), 6)


def cdr_summary_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary by whole numbers."""
    return summary(cdr(spark, sf_dir), None)


def _summary_sql(number: str) -> str:
    text = "CASE lsr " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in LSR_TEXTS.items()) + " END"
    return _product_sql(f"(SELECT *, {number.format('caller')} AS src_number, {number.format('called')} AS dst_number, {text} AS lsr_text FROM {expanded_sql(SUMMARY_WIDTH, END_SECOND)})", SUMMARY, SUMMARY_WIDTH, SUMMARY_VALUES)


QUERIES = {f.__name__: f for f in (cdr_stat, cdr_problems, cdr_summary, cdr_summary_numbers)}
ORACLE_SQL = {"cdr_stat": CDR_STAT, "cdr_problems": CDR_PROBLEMS, "cdr_summary": _summary_sql("substring({}, 1, 6)"), "cdr_summary_numbers": _summary_sql("{}")}
