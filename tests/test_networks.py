"""Networks of both address families against ipaddress, and drops of concurrency on small tables."""

import ipaddress

import numpy as np
from pyspark.sql import functions as F

from tallyline.operators import networks, sequences
from tallyline.operators.intervals import S


def halves(address):
    n = int(address)
    if address.version == 4:
        n |= 0xFFFF << 32
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    return signed(n >> 64), signed(n & (1 << 64) - 1)


def test_layers_lengths_and_ties_equal_a_search(spark):
    random = np.random.default_rng(2)
    nets, rows = [], []
    for k in range(120):
        if k % 2:
            net = ipaddress.ip_network((int(random.integers(0, 1 << 12)) << 20, int(random.integers(0, 33))), strict=False)
        else:
            net = ipaddress.ip_network((int(random.integers(0, 8)) << 125 | int(random.integers(0, 4)) << 62, int(random.integers(0, 129))), strict=False)
        nets.append((int(random.integers(0, 3)), net, f"n{k % 90}"))
        rows.append((nets[-1][0], *halves(net.network_address), net.prefixlen + (96 if net.version == 4 else 0), nets[-1][2]))
    nets = [n for n in nets if n[1].prefixlen or n[1].version == 4]
    rows = [r for r in rows if r[3]]  # ::/0 also holds mapped addresses
    addresses = [ipaddress.ip_address(int(random.integers(0, 1 << 32))) for _ in range(150)]
    addresses += [ipaddress.ip_address(int(random.integers(0, 8)) << 125 | int(random.integers(0, 4)) << 62 | int(random.integers(1, 99))) for _ in range(150)]
    wide = lambda net: int(halves(net.network_address)[0]) == 0 and net.version == 6
    nets, rows = zip(*[(n, r) for n, r in zip(nets, rows, strict=True) if not wide(n[1])], strict=True)
    got = networks.located(spark.createDataFrame(sorted({halves(a) for a in addresses}), "hi long, lo long"), spark.createDataFrame(list(rows), "layer int, hi long, lo long, bits int, name string"))
    found = {(r["hi"], r["lo"]): (r["layer"], r["bits"], r["names"]) for r in got.collect()}
    some = 0
    for a in addresses:
        hold = [(layer, -net.prefixlen - (96 if net.version == 4 else 0), name) for layer, net, name in nets if net.version == a.version and a in net]
        best = min((h[:2] for h in hold), default=None)
        want = (best[0], -best[1], ",".join(sorted({h[2] for h in hold if h[:2] == best}))) if best else (None, None, None)
        assert found[halves(a)] == want, a
        some += best is not None
    assert some > 50


def test_no_networks(spark):
    none = spark.createDataFrame([], "layer int, hi long, lo long, bits int, name string")
    assert networks.located(spark.createDataFrame([(0, 1)], "hi long, lo long"), none).first()["names"] is None


CALLS = "b_us long, e_us long"
RULES = "rule string, back long, percent long, number long, both boolean, least long"


def test_a_drop_to_nothing_is_seen(spark):
    full = [(m * 60 * S + k * S, m * 60 * S + (k + 20) * S) for m in [*range(10), *range(15, 20)] for k in range(4)]
    per_minute = sequences.minute_maxima(spark.createDataFrame(full, CALLS), [])
    assert [(r["minute"], r["n"]) for r in per_minute.orderBy("minute").collect()] == [(m, 4 if m < 10 or m >= 15 else 0) for m in range(20)]
    rules = spark.createDataFrame([("any", 5, 30, 1, False, 0), ("both", 5, 30, 3, True, 0), ("large", 5, 30, 1, False, 4)], RULES)
    got = {(r["rule"], r["minute"]): (r["n"], r["mean"]) for r in sequences.drops(per_minute, rules).collect()}
    assert got[("any", 10)] == (0, 4) and {m for r, m in got if r == "any"} == {10, 11, 12, 13}
    assert {m for r, m in got if r == "both"} == {10, 11} and {m for r, m in got if r == "large"} == {10}


def test_what_goes_on_counts_in_later_minutes(spark):
    rows = spark.createDataFrame([(10 * S, 200 * S), (20 * S, 30 * S)], CALLS)
    got = sequences.minute_maxima(rows, []).orderBy("minute").select("minute", "n").collect()
    assert [tuple(r) for r in got] == [(0, 2), (1, 1), (2, 1), (3, 1)]
    assert sequences.minute_maxima(rows.where(F.lit(False)), []).count() == 0


def test_text_ranges_equal_a_search(spark):
    from tallyline.operators.lookups import text_range_join

    random = np.random.default_rng(6)
    number = lambda: "".join(random.choice(list("0123"), int(random.integers(1, 6))))
    ranges = [tuple(sorted((number(), number()))) for _ in range(60)] + [("12", "12"), ("0", "3333"), ("3", "1")]
    points = sorted({number() for _ in range(120)})
    got = text_range_join(spark.createDataFrame([(p,) for p in points], "v string"), "v", spark.createDataFrame(ranges, "a string, b string"), "a", "b").collect()
    assert sorted(map(tuple, got)) == sorted((p, a, b) for p in points for a, b in ranges if a <= p <= b)
    none = spark.createDataFrame([], "a string, b string")
    assert text_range_join(spark.createDataFrame([("1",)], "v string"), "v", none, "a", "b").count() == 0


def test_a_row_of_the_table_is_a_series(spark):
    from tallyline.operators.defined import matched

    sums = spark.createDataFrame([(s, k, r, n, 1) for s in range(2) for k in (0, 8) for r in (2, 4) for n in (0, 1)], "sensor_id long, codec long, response long, connected int, n long")
    rows = [("all", None, None, None, None), ("one", 1, None, 4, None), ("each", 1, 8, 2, 1), ("none", 7, None, None, None)]
    series = spark.createDataFrame(rows, "series string, sensor_id long, codec long, response long, connected long")
    got = {r["series"]: r["n"] for r in matched(sums, series).groupBy("series").agg(F.sum("n").alias("n")).collect()}
    assert got == {"all": 16, "one": 4, "each": 1}
    assert matched(sums, series.limit(0)).count() == 0


def test_series_that_are_defined_alike_are_measured_once(spark):
    from tallyline.operators.defined import measured, profiles
    from tallyline.operators.intervals import S

    calls = spark.createDataFrame([(k % 2, 0, 200, 900 * S * (k % 3) + k, 900 * S * (k % 3) + 10 * S, 10 * S, 8 * S) for k in range(12)], "sensor_id long, codec long, lsr int, b_us long, e_us long, dur_us long, connect_us long")
    alike = [(f"s{k}", "began", k % 2, None, None, None) for k in range(40)]
    rows = [*alike, ("twice", "touching", 0, None, None, None), ("twice", "touching", 0, None, None, None), ("two", "began", 0, None, None, None), ("two", "began", 1, None, None, None), (None, None, None, 0, 2, 1)]
    series = spark.createDataFrame(rows, "series string, measure string, sensor_id long, codec long, response long, connected long")
    assert profiles(series).select("profile").distinct().count() == 5  # and not 43: sums meet profiles only
    got = {}
    for r in measured(calls, series).collect():
        got.setdefault(r["series"], []).append(r["value"])
    assert got == {**{f"s{k}": [2.0] * 3 for k in range(40)}, "twice": [4.0] * 3, "two": [4.0] * 3, None: [10.0] * 3}
