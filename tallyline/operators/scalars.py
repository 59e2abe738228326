"""Queries over the scalar functions: voice quality, numbers, addresses, text, digests, JSON and calendar."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.functions import semantics as X
from tallyline.functions import voice
from tallyline.operators.intervals import r6
from tallyline.session import table
from tallyline.sources.calls import CDR, CDR_RTP, cdr, cdr_rtp

c = F.col


def mos_g711(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = cdr_rtp(spark, sf_dir).withColumn("loss", F.coalesce(F.try_divide(c("lost"), c("received") + c("lost")), F.lit(0.0))).withColumn("burst", c("jitter_x10") / 20.0)
    return r.select("cdr_id", "idx", r6(voice.mos_g711(c("loss"), c("burst"))).alias("mos"))


def mos_e_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = cdr_rtp(spark, sf_dir).withColumn("loss", F.coalesce(F.try_divide(c("lost"), c("received") + c("lost")), F.lit(0.0))).withColumn("burst", c("jitter_x10") / 20.0)
    return r.select("cdr_id", "idx", r6(voice.mos_e_model(c("loss"), c("burst"))).alias("mos"))


def packet_loss_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cdr_rtp(spark, sf_dir).select("cdr_id", "idx", r6(voice.packet_loss_pct(c("lost"), c("received"))).alias("loss_pct"))


def delay_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted delays from class counts, which are parts of the call's numbers here."""
    n = [(c("received") % (i + 3)).alias(f"d{i}") for i in range(7)]
    total = F.lit(0)
    for i in range(7):
        total += c("received") % (i + 3)
    return cdr_rtp(spark, sf_dir).select("cdr_id", "idx", voice.delay_sum([c("received") % (i + 3) for i in range(len(n))]).alias("delay_sum"), total.alias("delay_n"))


def burst_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    hist = F.array(*((c("lost") % (i + 2)) for i in range(5)))
    share, ratio = voice.loss_and_burst(hist, c("received"))
    return cdr_rtp(spark, sf_dir).select("cdr_id", "idx", r6(share).alias("loss"), r6(ratio).alias("burst"))


def time_weighted_mos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean scores weighted by the time that they hold."""
    return cdr(spark, sf_dir).groupBy("sensor_id").agg(r6(F.sum(c("mos_x10") * c("dur_us")) / F.sum("dur_us") / 10).alias("mos"))


def normalize_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.when(c("k") % 3 == 0, F.concat(F.lit("9"), c("called"))).otherwise(c("called"))
    out = voice.normalize_number(number, ["9"], ["00"], "420")
    return cdr(spark, sf_dir).select("call_id", number.alias("number"), out.alias("normalized"))


def ip_to_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = X.inet_ntoa(c("src_ip"))
    return cdr(spark, sf_dir).select("call_id", text.alias("ip"), X.inet_aton(text).alias("number"), X.network(c("src_ip"), 26).alias("net"), X.broadcast_address(c("src_ip"), 26).alias("last"), X.is_private(c("src_ip")).alias("private"))


def text_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = cdr(spark, sf_dir)
    joined = F.concat_ws(",", "caller", "called", "ua")
    return calls.select(
        "call_id",
        F.reverse("called").alias("reversed"),
        F.upper("ua").alias("up"),
        F.element_at(F.split(joined, ","), 2).alias("second"),
        F.regexp_extract("called", r"^0+([1-9]+)", 1).alias("digits"),
        F.regexp_replace("called", "[0-4]", "x").alias("masked"),
        F.lpad(c("k").cast("string"), 4, "0").alias("padded"),
        F.concat(F.substring("caller", 1, 5), F.lit("***")).alias("hidden"),
    )


def digest_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.md5("text").alias("md5"), F.sha2("text", 256).alias("sha256"), F.base64(F.encode(F.substring("source", 1, 4), "UTF-8")).alias("b64"))


def json_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths in JSON text, and JSON made of columns."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"), F.to_json(F.struct(c("event_id").alias("i"), c("event_type").alias("t"))).alias("j"))


def calendar_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Begins of the day, month and next day, the weekday, and whole days between dates."""
    d = table(spark, sf_dir, "orders").groupBy(c("o_orderdate").cast("date").alias("day")).agg(F.count("*").alias("n"))
    day = c("day")
    return d.select(
        F.date_format(day, "yyyy-MM-dd").alias("day"),
        "n",
        F.date_format(F.date_add(day, 1), "yyyy-MM-dd").alias("next_day"),
        F.date_format(F.trunc(day, "month"), "yyyy-MM-dd").alias("month_begin"),
        F.weekday(day).cast("int").alias("weekday"),
        F.datediff(day, F.lit("1995-01-01").cast("date")).cast("int").alias("days"),
    )


def dedup_by_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts once by their digest: the least id of each and how often it came."""
    d = table(spark, sf_dir, "documents")
    return d.groupBy(F.md5("text").alias("digest")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))


def scan_with_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selected columns of rows that meet conditions, pushed to the scan, and a page of them."""
    return table(spark, sf_dir, "orders").where((c("o_orderstatus") == "F") & (c("o_totalprice") > 1000)).select("o_orderkey", "o_orderpriority", r6(c("o_totalprice") + 0.0).alias("price")).orderBy("o_orderkey").limit(100)


QUERIES = {f.__name__: f for f in (mos_g711, mos_e_model, packet_loss_pct, delay_buckets, burst_ratio, time_weighted_mos, normalize_number, ip_to_long, text_functions, digest_functions, json_functions, calendar_functions, dedup_by_digest, scan_with_limit)}

_LOSS = f"(SELECT *, CAST(lost AS DOUBLE) / (received + lost) AS loss, jitter_x10 / 20.0 AS burst FROM {CDR_RTP})"
_HIST = "".join(f", lost % {i + 2} AS h{i}" for i in range(5))

ORACLE_SQL = {
    "mos_g711": f"""SELECT cdr_id, idx, round(CASE WHEN loss = 0 OR burst = 0 THEN 4.5 WHEN loss > 0.5 THEN 1.0 ELSE greatest(1.0, least(4.5, {voice.G711_CUBIC_SQL.format(d='')})) END, 6) AS mos
FROM (SELECT *, CASE WHEN burst <> 0 THEN {voice.G711_RATING_SQL.format(d='')} END AS r FROM {_LOSS})""",
    "mos_e_model": f"""SELECT cdr_id, idx, round(CASE WHEN r <= 0 THEN 1.0 ELSE least(4.5, 1.0 + 0.035 * r + r * (r - 60) * (100.0 - r) * 7e-6) END, 6) AS mos
FROM (SELECT *, 93.2 - (11.0 + 84.0 * (loss * 100) / (loss * 100 / greatest(burst, 1.0) + 19.0)) AS r FROM {_LOSS})""",
    "packet_loss_pct": f"SELECT cdr_id, idx, round(CAST(lost AS DOUBLE) / (received + 2 + lost) * 100, 6) AS loss_pct FROM {CDR_RTP}",
    "delay_buckets": f"""SELECT cdr_id, idx, {' + '.join(f'received % {i + 3} * {m}' for i, m in enumerate(voice.DELAY_MIDDLES))} AS delay_sum, {' + '.join(f'received % {i + 3}' for i in range(7))} AS delay_n FROM {CDR_RTP}""",
    "burst_ratio": f"""SELECT cdr_id, idx, round(CASE WHEN l < 5 THEN 0.0 ELSE CAST(l AS DOUBLE) / (received + l) END, 6) AS loss,
  round(CASE WHEN l < 5 THEN 0.0 ELSE greatest(1.0, CAST(l AS DOUBLE) / n * (1 - CAST(l AS DOUBLE) / (received + l))) END, 6) AS burst
FROM (SELECT *, h0 + 2 * h1 + 3 * h2 + 4 * h3 + 5 * h4 AS l, h0 + h1 + h2 + h3 + h4 AS n FROM (SELECT *{_HIST} FROM {CDR_RTP}))""",
    "time_weighted_mos": f"SELECT sensor_id, round(CAST(sum(mos_x10 * dur_us) AS DOUBLE) / sum(dur_us) / 10, 6) AS mos FROM {CDR} GROUP BY sensor_id",
    "normalize_number": f"""SELECT call_id, number, CASE WHEN foreign_ OR length(digits) >= 9 THEN digits ELSE '420' || digits END AS normalized FROM (SELECT *, regexp_replace(CASE WHEN foreign_ THEN substring(cut, 3) ELSE cut END, '^[0+]+', '') AS digits
  FROM (SELECT *, starts_with(cut, '00') AS foreign_ FROM (SELECT *, CASE WHEN starts_with(number, '9') THEN substring(number, 2) ELSE number END AS cut FROM (SELECT call_id, CASE WHEN k % 3 = 0 THEN '9' || called ELSE called END AS number FROM {CDR}))))""",
    "ip_to_long": f"""SELECT call_id, (src_ip >> 24) || '.' || ((src_ip >> 16) & 255) || '.' || ((src_ip >> 8) & 255) || '.' || (src_ip & 255) AS ip, src_ip AS number, src_ip // 64 * 64 AS net, src_ip // 64 * 64 + 63 AS last, true AS private FROM {CDR}""",
    "text_functions": f"""SELECT call_id, reverse(called) AS reversed, upper(ua) AS up, called AS second, regexp_extract(called, '^0+([1-9]+)', 1) AS digits, regexp_replace(called, '[0-4]', 'x', 'g') AS masked,
  lpad(CAST(k AS VARCHAR), 4, '0') AS padded, substring(caller, 1, 5) || '***' AS hidden FROM {CDR}""",
    "digest_functions": "SELECT doc_id, md5(text) AS md5, sha256(text) AS sha256, base64(encode(substring(source, 1, 4))) AS b64 FROM documents",
    "json_functions": """SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, '{"i":' || event_id || ',"t":"' || event_type || '"}' AS j FROM events""",
    "calendar_functions": """SELECT strftime(day, '%Y-%m-%d') AS day, n, strftime(day + INTERVAL 1 DAY, '%Y-%m-%d') AS next_day, strftime(date_trunc('month', day), '%Y-%m-%d') AS month_begin, CAST((dayofweek(day) + 6) % 7 AS INTEGER) AS weekday,
  CAST(date_diff('day', DATE '1995-01-01', day) AS INTEGER) AS days FROM (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders GROUP BY 1)""",
    "dedup_by_digest": "SELECT md5(text) AS digest, min(doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY 1",
    "scan_with_limit": "SELECT o_orderkey, o_orderpriority, round(o_totalprice + 0.0, 6) AS price FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 1000 ORDER BY o_orderkey LIMIT 100",
}
