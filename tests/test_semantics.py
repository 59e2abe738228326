"""The quirks of the filter language, of metrics and of rating, on hand-made values."""

import datetime
import ipaddress
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyline.functions import semantics as X
from tallyline.functions import voice
from tallyline.operators import intervals, rating, sequences, series
from tallyline.operators.anchored import anchored


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


L = F.lit


def null():
    return F.lit(None).cast("long")


@pytest.mark.parametrize(
    "column, want",
    [
        (lambda: X.eq(null(), L(1)), False),
        (lambda: X.not_(X.eq(null(), L(1))), True),
        (lambda: X.ne(null(), L(1)), False),
        (lambda: X.is_(null(), L(None)), True),
        (lambda: X.is_(L(1), L(2)), True),
        (lambda: X.in_(null(), [1]), False),
        (lambda: X.like(L("xABy"), "%ab%"), True),
        (lambda: X.like(L("abcd"), "a_c%"), True),
        (lambda: X.like(L("abbc"), "a%c"), False),
        (lambda: X.like(L("a%c"), "a%c"), True),
        (lambda: X.like(L("axb"), "%a_b%"), False),
        (lambda: X.like(L("abc"), ""), False),
        (lambda: X.like(L("ABC"), "abc"), True),
        (lambda: X.divide_int(L(7), L(2)), 3),
        (lambda: X.divide_int(L(7), L(0)), 0),
        (lambda: X.divide_float(L(7), L(0)), 0.0),
        (lambda: X.inet_aton(L("10.0.0.1")), 167772161),
        (lambda: X.inet_aton(L("10.0.0.256")), None),
        (lambda: X.inet_aton(L("nonsense")), None),
        (lambda: X.inet_ntoa(L(3232235521)), "192.168.0.1"),
        (lambda: X.response_listed(L(200), ["3"], []), False),
        (lambda: X.response_listed(L(486), ["4"], []), True),
        (lambda: X.response_listed(L(486), [], []), False),
        (lambda: X.response_listed(L(486), ["4"], ["48"]), False),
        (lambda: X.any_of(), False),
        (lambda: X.all_of(), True),
        (lambda: X.number_matches(L("420000015"), ["420000010-420000020"]), True),
        (lambda: X.number_matches(L("42000001"), ["420000010-420000020"]), False),
        (lambda: X.hour_gate(L(23), 22, 5), True),
        (lambda: X.hour_gate(L(12), 22, 5), False),
        (lambda: voice.packet_loss_pct(L(5), L(93)), 5.0),
        (lambda: voice.mos_g711(L(0.0), L(1.0)), 4.5),
        (lambda: voice.mos_g711(L(0.6), L(1.0)), 1.0),
        (lambda: F.round(rating.price(L(75), L(0.6), L(60), L(1)), 6), 0.75),
        (lambda: F.round(rating.price(L(10), L(0.6), L(60), L(1)), 6), 0.6),
        (lambda: F.round(rating.price(L(31), L(1.2), L(30), L(30)), 6), 1.2),
        (lambda: F.round(rating.price(L(0), L(0.6), L(60), L(1)), 6), 0.6),
    ],
)
def test_values(spark, column, want):
    assert one(spark, column()) == want


def test_levels(spark):
    yes, no = L(True), L(False)
    assert one(spark, X.by_level([(0, yes), (1, no), (1, yes)])) is True
    assert one(spark, X.by_level([(0, yes), (1, no)])) is False
    assert one(spark, X.by_level([(0, no), (1, yes), (0, yes)])) is True


@pytest.mark.parametrize("descending, want", [(False, 20), (True, 1)])
def test_nearest_rank_of_twenty(spark, descending, want):
    rows = spark.range(1, 21).select(L(1).alias("k"), F.col("id").alias("v"))
    assert intervals.nearest_rank(rows, ["k"], "v", [95], descending).first()["perc95"] == want


def test_minutes_of_a_short_call(spark):
    calls = spark.createDataFrame([(59_000_000, 61_000_000)], "b_us long, e_us long")
    got = [(r["bucket"], r["first"], r["last"]) for r in intervals.minutes(calls).orderBy("bucket").collect()]
    assert got == [(0, True, False), (60, False, True)]


def test_a_fraction_of_a_second_reaches_the_next_quarter(spark):
    calls = spark.createDataFrame([(0, 899_500_000), (0, 899_000_500)], "b_us long, e_us long")
    assert sorted(r["bucket"] for r in intervals.quarters(calls).collect()) == [0, 0, 900]


def test_easter_and_working_days(spark):
    years = {1995: (4, 16), 2000: (4, 23), 2008: (3, 23), 2024: (3, 31), 2025: (4, 20), 2038: (4, 25)}
    rows = spark.createDataFrame([(y,) for y in years], "y int").select("y", F.date_from_unix_date(rating.easter(F.col("y")).cast("int")).alias("d")).collect()
    assert {r["y"]: (r["d"].month, r["d"].day) for r in rows} == years
    day = lambda y, m, d: L((datetime.date(y, m, d) - datetime.date(1970, 1, 1)).days)
    expected = {(2024, 3, 29): False, (2024, 4, 1): False, (2024, 4, 2): True, (2024, 12, 25): False, (2024, 4, 6): False, (2024, 4, 7): False}
    assert {d: one(spark, rating.is_working(day(*d))) for d in expected} == expected


def price_brute(begin, seconds, normal, peak, t1, t2, start, end):
    """Slice by slice with clock times."""
    holidays = {datetime.date(2024, *d) for d in ((1, 1), (5, 1), (12, 25), (12, 26), (3, 29), (4, 1))}
    now, left, total, k = datetime.datetime(1970, 1, 1) + datetime.timedelta(seconds=begin), max(1, seconds), 0.0, 0
    while left > 0:
        minute = now.hour * 60 + now.minute
        works = now.weekday() < 5 and now.date() not in holidays
        changes = [now.replace(hour=m // 60, minute=m % 60) for m in (start, end) if works and m > minute]
        until = min([*changes, datetime.datetime.combine(now.date() + datetime.timedelta(1), datetime.time())])
        high = works and (start <= minute < end if start < end else minute >= start or minute < end)
        size = t1 if k == 0 and t1 != t2 else left
        if k:
            size = min(size, int((until - now).total_seconds()))
        unit = t2 if k else t1
        size = -(-size // unit) * unit
        total += size * (peak if high else normal) / 60
        now, left, k = now + datetime.timedelta(seconds=size), left - size, k + 1
    return round(total, 6)


def test_peak_prices_match_a_clock(spark):
    base = int(datetime.datetime(2024, 3, 27, tzinfo=datetime.UTC).timestamp())  # a Wednesday before Easter
    draw = random.Random(4)
    calls = [(base + draw.randrange(14 * 86400), draw.choice([1, 59, 75, 600, 7200, 200_000]), *draw.choice([(60, 1), (30, 30), (60, 6), (1, 60), (45, 7)])) for _ in range(150)]
    calls += [(base + 8 * 3600 - 60, 120, 30, 30), (base + 86400 - 10, 90, 60, 1)]
    df = spark.createDataFrame(calls, "b long, d int, t1 int, t2 int")
    for start, end in ((480, 1080), (1200, 390)):
        got = df.select(F.round(rating.price_with_peak(F.col("b"), F.col("d"), L(1.2), L(2.4), F.col("t1"), F.col("t2"), start, end), 6)).collect()
        assert [r[0] for r in got] == pytest.approx([price_brute(b, d, 1.2, 2.4, t1, t2, start, end) for b, d, t1, t2 in calls])
    assert price_brute(base + 8 * 3600 - 60, 120, 1.2, 2.4, 30, 30, 480, 1080) == 2.4  # equal slices are never cut


def test_numbers_below_zero_and_patterns_with_line_ends(spark):
    assert [one(spark, X.divide_int(L(a), L(b))) for a, b in ((-7, 2), (7, -2), (2**62 + 1, 1), (-1, 0))] == [-3, -3, 2**62 + 1, 0]
    assert [one(spark, X.like(L(t), "abc")) for t in ("abc", "abc\n", "xabc")] == [True, False, False]


def test_numbers_with_several_skip_prefixes(spark):
    normal = lambda n, **more: one(spark, voice.normalize_number(L(n), ["9", "80", "777"], ["00"], "420", **more))
    assert [normal(n) for n in ("9123456", "80123456", "777123456", "980004912345678", "123456")] == ["420123456", "420123456", "420123456", "4912345678", "420123456"]
    assert normal("9112", exclude=["911"]) == "9112"


def test_large_groups_rank_as_small_ones(spark):
    rows = spark.range(5000).select((F.col("id") % 2).alias("k"), ((F.col("id") * 7919) % 1013 / 7.0).alias("v"))
    for descending in (False, True):
        small, large = (intervals.nearest_rank(rows, ["k"], "v", [50, 95, 99], descending, large=large).orderBy("k").collect() for large in (False, True))
        assert small == large


def test_previous_crosses_blocks(spark):
    rows = spark.createDataFrame([(k, t, t) for k in (1, 2) for t in (0, 3, 40, 41, 300, 900)], "k long, b_us long, call_id long")
    got = sequences.previous(rows, ["k"], ["b_us"], block_us=50).select("k", "b_us", "previous.b_us").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(k, t, p) for k in (1, 2) for t, p in zip((0, 3, 40, 41, 300, 900), (None, 0, 3, 40, 41, 300))], key=str)


@settings(max_examples=20, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(0, 50), st.integers(1, 30)), min_size=1, max_size=12))
def test_running_sum_in_blocks_equals_the_plain_one(spark, calls):
    df = spark.createDataFrame([(k, b, b + d) for k, b, d in calls], "k long, b_us long, e_us long")
    got = sorted((r["k"], r["t"], r["d"], r["n"]) for r in sequences.running(sequences.plus_minus(df, ["k"]), ["k"], block_us=7).collect())
    want, n = [], {}
    for k, t, d in sorted([(k, b, 1) for k, b, _ in calls] + [(k, b + d, -1) for k, b, d in calls]):
        n[k] = n.get(k, 0) + d
        want.append((k, t, d, n[k]))
    assert got == sorted(want)


@pytest.mark.parametrize("at_end", [False, True])
@pytest.mark.parametrize("closes", [False, True])
def test_anchored_windows_over_batches_equal_a_walk(spark, at_end, closes):
    rng = random.Random(3)
    rows = [(rng.choice((0, 0, 0, 1, 2)), rng.randrange(400), i) for i in range(1500)] + [(9, 5, -1)]
    df = spark.createDataFrame(rows, "k long, t long, tie long")
    want, state = [], {}
    for k, t, tie in sorted(rows):
        begin, n = state.get(k) or (t, 0)
        past = t >= begin + 13 if at_end else t > begin + 13
        if past and n and not closes:
            begin, n, past = t, 0, False
        want.append((k, t, tie, begin, n + 1))
        state[k] = None if past and closes and n else (begin, n + 1)
    for size in ("1", "7", "100", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            got = anchored(df, ["k"], "t", "tie", 13, at_end, closes).collect()
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert sorted(map(tuple, got)) == sorted(want), size
    assert anchored(df.limit(0), ["k"], "t", "tie", 13, at_end, closes).count() == 0


def test_minutes_count_each_call_once_at_its_begin(spark):
    total = intervals.minute_expand(spark, "/root/testdata/sf0.001").agg(F.sum("began"), F.sum("ended")).first()
    assert total[0] == total[1] == spark.read.parquet("/root/testdata/sf0.001/events.parquet").count()


def test_addresses_of_version_6(spark):
    good = {"::1": 1, "fe80::1:2": ipaddress.ip_address("fe80::1:2"), "2001:db8:0:0:1:0:0:1": ipaddress.ip_address("2001:db8::1:0:0:1"), "::": 0, "1::": 1 << 112, "2001:DB8::": ipaddress.ip_address("2001:db8::")}
    assert {t: one(spark, X.inet6_aton(L(t))) for t in good} == {t: f"{int(n):032x}" for t, n in good.items()}
    for bad in ("1:2", ":::", "1::2::3", "12345::", "g::1", "1:2:3:4:5:6:7:8:9", ""):
        assert one(spark, X.inet6_aton(L(bad))) is None, bad
    net = ipaddress.ip_network("2001:db80::/29")
    assert one(spark, X.network6(X.inet6_aton(L("2001:db87:1::5")), 29)) == f"{int(net.network_address):032x}"


def test_energy_of_samples_equals_the_tables_of_the_standard(spark):
    def u_law(b):
        b = ~b & 255
        return (((b & 15) << 3) + 132 << (b >> 4 & 7)) - 132

    def a_law(b):
        b ^= 85
        m, e = (b & 15) << 4, b >> 4 & 7
        return m + 8 if e == 0 else m + 264 << e - 1

    for codec, law in ((0, u_law), (8, a_law)):
        got = one(spark, F.transform(F.sequence(L(0), L(255)), lambda b: voice.energy_level(F.array(b), L(codec))))
        assert list(got) == [law(b) for b in range(256)]
    assert one(spark, voice.energy_level(F.array().cast("array<int>"), L(0))) == 0 == one(spark, voice.energy_level(F.array(L(3)), L(18)))


def test_rules_of_domains_and_headers_with_nulls(spark):
    calls = spark.createDataFrame([(1, "a", "b"), (2, "b", None), (3, None, None), (4, "x", "a")], "call_id long, domain_src string, domain_dst string")
    rules = spark.createDataFrame([(2, "a", 1, 10), (1, "b", 2, 20), (3, "b", 0, 30)], "position int, domain string, direction int, flags int")
    got = {r["call_id"]: r["flags"] for r in series.domain_rule(calls, rules).collect()}
    assert got == {1: 20, 2: 30, 3: None, 4: None}
    headers = spark.createDataFrame([(1, "abc"), (2, "ab"), (3, "abd"), (4, "zzc"), (5, ""), (6, None), (7, "abc")], "call_id long, header string")
    rules = spark.createDataFrame([("ab", "exact", 1), ("a", "prefix", 2), ("abc", "prefix", 3), ("c$", "regexp", 4)], "pattern string, kind string, flags int")
    got = {r["call_id"]: r["flags"] for r in series.header_rule(headers, rules).collect()}
    assert got == {1: 3, 2: 1, 3: 2, 4: 4, 5: None, 6: None, 7: 3}
    assert {r["flags"] for r in series.header_rule(headers, rules.limit(0)).collect()} == {None}


def test_rows_are_dealt_to_as_many_tasks_as_they_ask_for(spark, monkeypatch):
    monkeypatch.setattr(intervals, "TASK_ROWS", 100)
    monkeypatch.setattr(intervals, "HOT_ROWS", 200)
    rows = spark.range(1000).selectExpr("id % 7 AS bucket", "id % 50 AS k")
    got, by_keys = intervals.dealt(rows, ["k", "bucket"], "bucket")
    assert by_keys and got.rdd.getNumPartitions() == 10 and got.count() == 1000
    assert got.select("k", "bucket", F.spark_partition_id()).distinct().count() == rows.distinct().count()
    assert intervals.dealt(rows.limit(0), ["k", "bucket"], "bucket")[0].rdd.getNumPartitions() == 1
    monkeypatch.setattr(intervals, "HOT_ROWS", 100)  # a key may be hot: combined where it is
    assert intervals.dealt(rows, ["k", "bucket"], "bucket") == (rows, False)


def test_summaries_do_not_exchange_facts(spark, monkeypatch):
    from tallyline.operators import products

    monkeypatch.setattr(intervals, "TASK_ROWS", 40)
    plans, found = [], []
    for hot in (10**6, 0):
        monkeypatch.setattr(intervals, "HOT_ROWS", hot)
        df = products.cdr_summary(spark, "/root/testdata/sf0.001")
        plans.append([line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in line])
        found.append(sorted(map(repr, df.collect())))
    assert found[0] == found[1] and len(found[0]) > 1000
    assert len(plans[0]) == 2 < len(plans[1])  # calls for counters and for distributions


def test_quality_of_streams_groups_where_rows_are_dealt(spark, monkeypatch):
    from tallyline.operators import dimensions

    monkeypatch.setattr(intervals, "TASK_ROWS", 500)
    df = dimensions.stream_quality(spark, "/root/testdata/sf0.001")
    lines = [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in line]
    assert len(lines) == 3 and all("REPARTITION_BY_NUM" in line for line in lines)
    monkeypatch.setattr(intervals, "HOT_ROWS", 0)
    assert sorted(map(repr, df.collect())) == sorted(map(repr, dimensions.stream_quality(spark, "/root/testdata/sf0.001").collect()))
