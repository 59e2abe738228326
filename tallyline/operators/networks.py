"""Networks of IPv4 and IPv6 addresses in layers: which is the most specific of the first layer that holds an address.

An address is two 64-bit halves; an IPv4 address is its mapped IPv6 address, so its network lengths are longer by 96. For
every length that occurs in the table of networks, of which there are at most 129, an address gives one key, its bits up
to that length; the key meets networks of that length by equality. So networks may be as many as addresses, and
neither is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.session import table
from tallyline.sources.calls import CALLER_NET, CDR, cdr

c = F.col
#: The lower half of a mapped IPv4 address begins so, and its network lengths are this much longer.
MAPPED, MAPPED_BITS = 0xFFFF << 32, 96
DOC_NET = 0x20010DB8 << 32


def kept_bits(half: Column, bits: Column) -> Column:
    """The first bits (0 to 64) of a half; the others are zero."""
    return F.when(bits >= 64, half).when(bits <= 0, F.lit(0).cast("bigint")).otherwise(half.bitwiseAND(F.call_function("shiftleft", F.lit(-1).cast("bigint"), (64 - bits).cast("int"))))


def network_key(hi: Column, lo: Column, bits: Column) -> list[Column]:
    return [bits.cast("int").alias("bits"), kept_bits(hi, bits).alias("net_hi"), kept_bits(lo, bits - 64).alias("net_lo")]


def located(addresses: DataFrame, networks: DataFrame) -> DataFrame:
    """addresses (hi, lo, ...), which are distinct, with layer, bits and names of the networks that hold them.

    networks: layer, hi, lo, bits, name. Of the least layer that has any, the longest network counts; several names of it
    are joined in order. Addresses in no network have nulls.
    """
    keyed = networks.select("layer", "name", *network_key(c("hi"), c("lo"), c("bits"))).distinct()
    lengths = [r["bits"] for r in networks.select(c("bits").cast("int").alias("bits")).distinct().collect()]  # at most 129
    if not lengths:
        return addresses.select("*", F.lit(None).cast("int").alias("layer"), F.lit(None).cast("int").alias("bits"), F.lit(None).cast("string").alias("names"))
    each = addresses.select("hi", "lo", F.explode(F.array(*map(F.lit, sorted(lengths)))).alias("b")).select("hi", "lo", *network_key(c("hi"), c("lo"), c("b")))
    found = each.join(keyed, ["bits", "net_hi", "net_lo"]).groupBy("hi", "lo", "layer", "bits").agg(F.array_join(F.array_sort(F.collect_set("name")), ",").alias("names"))
    best = found.groupBy("hi", "lo").agg(F.min_by(F.struct("layer", "bits", "names"), F.struct("layer", -c("bits"))).alias("x")).select("hi", "lo", "x.*")
    return addresses.join(best, ["hi", "lo"], "left")


def networks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' own networks before those of nations, some of which share one."""
    own = table(spark, sf_dir, "customer").where("c_custkey % 10 = 0").select(F.lit(0).alias("layer"), F.lit(0).cast("bigint").alias("hi"), (F.lit(MAPPED + CALLER_NET) + c("c_custkey")).alias("lo"), F.lit(MAPPED_BITS + 30).alias("bits"), c("c_mktsegment").alias("name"))
    k = c("n_nationkey").cast("bigint")
    n = table(spark, sf_dir, "nation")
    v4 = n.select(F.lit(1), F.lit(0).cast("bigint"), F.lit(MAPPED + CALLER_NET) + k * 32, F.lit(MAPPED_BITS + 27), "n_name")
    v6 = n.select(F.lit(1), F.lit(DOC_NET) + k % 16 * 65536, F.lit(0).cast("bigint"), F.lit(48), "n_name")
    wide = n.where("n_nationkey = 0").select(F.lit(1), F.lit(DOC_NET), F.lit(0).cast("bigint"), F.lit(32), "n_name")
    return own.unionAll(v4).unionAll(v6).unionAll(wide)


def network_countries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Callers by address, of both families, with the networks that hold them."""
    v6 = c("k") % 2 == 1
    hi = F.when(v6, F.lit(DOC_NET) + c("user_id") % 20 * 65536 + c("k") % 3).otherwise(F.lit(0).cast("bigint"))
    lo = F.when(v6, c("src_ip") * 65537).otherwise(F.lit(MAPPED) + c("src_ip"))
    return located(cdr(spark, sf_dir).groupBy(hi.alias("hi"), lo.alias("lo")).agg(F.count("*").alias("n")), networks(spark, sf_dir))


QUERIES = {f.__name__: f for f in (network_countries,)}

ORACLE_SQL = {
    "network_countries": f"""WITH a AS (SELECT hi, lo, count(*) AS n FROM (SELECT CASE WHEN k % 2 = 1 THEN {DOC_NET} + user_id % 20 * 65536 + k % 3 ELSE 0 END AS hi, CASE WHEN k % 2 = 1 THEN src_ip * 65537 ELSE {MAPPED} + src_ip END AS lo FROM {CDR}) GROUP BY 1, 2),
m AS (SELECT hi, lo, 0 AS layer, 126 AS bits, c_mktsegment AS name FROM a JOIN customer ON c_custkey % 10 = 0 AND hi = 0 AND lo >> 2 = ({MAPPED + CALLER_NET} + c_custkey) >> 2
 UNION SELECT hi, lo, 1, 123, n_name FROM a JOIN nation ON hi = 0 AND lo >> 5 = ({MAPPED + CALLER_NET} + n_nationkey * 32) >> 5
 UNION SELECT hi, lo, 1, 48, n_name FROM a JOIN nation ON hi >> 16 = ({DOC_NET} + n_nationkey % 16 * 65536) >> 16
 UNION SELECT hi, lo, 1, 32, n_name FROM a JOIN nation ON n_nationkey = 0 AND hi >> 32 = {DOC_NET >> 32}),
b AS (SELECT hi, lo, layer, bits, string_agg(name, ',' ORDER BY name) AS names FROM m GROUP BY hi, lo, layer, bits QUALIFY row_number() OVER (PARTITION BY hi, lo ORDER BY layer, bits DESC) = 1)
SELECT a.hi, a.lo, n, layer, bits, names FROM a LEFT JOIN b ON b.hi = a.hi AND b.lo = a.lo""",
}
