import json

from pyspark.sql import functions as F

from tallyline.functions import registry
from tallyline.functions.json_filter import call_filter
from tallyline.plans.engine import Engine
from tallyline.sources import files
from tallyline.sources.calls import cdr

SF = "/root/testdata/sf0.001"


def test_bundle_of_tables(spark, tmp_path):
    (tmp_path / "a").write_text('csv_header:cdr:id,name\ncsv_header:next:id,ua\ncsv_row:cdr:1,"x, \\"y\\""\ncsv_row:next:1,phone\ncsv_row:cdr:2,\n')
    got = sorted((r["table"], tuple(r["names"]), tuple(r["values"])) for r in files.read_bundle(spark, str(tmp_path)).collect())
    assert got == [("cdr", ("id", "name"), ("1", 'x, "y"')), ("cdr", ("id", "name"), ("2", "")), ("next", ("id", "ua"), ("1", "phone"))]


def test_csv_and_json_round_trips(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,b"), (2, None)], "id int, name string")
    files.export(df, f"{tmp_path}/c")
    files.export(df, f"{tmp_path}/j", "json")
    want = [(1, "a,b"), (2, None)]
    assert [tuple(r) for r in files.read_csv(spark, f"{tmp_path}/c", df.schema).orderBy("id").collect()] == want
    assert [tuple(r) for r in files.read_json(spark, f"{tmp_path}/j", df.schema).orderBy("id").collect()] == want


def test_append_by_day(spark, tmp_path):
    df = spark.sql("SELECT 1 AS id, timestamp'2024-01-01 10:00:00' AS at UNION ALL SELECT 2, timestamp'2024-01-02 10:00:00'")
    files.append(df, f"{tmp_path}/t", "at")
    files.append(df, f"{tmp_path}/t", "at")
    assert spark.read.parquet(f"{tmp_path}/t").where("day = '2024-01-02'").count() == 2


def test_sql_functions(spark):
    registry.register(spark)
    assert spark.sql("SELECT ip_to_long('10.0.0.300'), ip_to_long('x'), round(mos_g711(0.02, 1.5), 3)").first()[:2] == (None, None)
    row = spark.sql("SELECT ip_to_long('10.0.0.1') AS a, packet_loss_pct(5, 93) AS b, round(rate_call(75, 0.6, 60, 1), 6) AS c, code_matches(486, '48X') AS d, code_matches(200, '4XX') AS e").first()
    assert tuple(row) == (167772161, 5.0, 0.75, True, False)


def test_filter_records(spark):
    calls = cdr(spark, SF)
    n = lambda spec: calls.where(call_filter(spec)).count()
    assert n({}) == calls.count()
    assert n({"codec": ["!8"]}) + n({"codec": [8]}) == calls.count()
    one_way, either = n({"caller": ["%0001"]}), n({"caller": ["%0001"], "caller_type": "0"})
    assert either >= one_way
    assert n({"codec": [0], "sensor_id": [1], "OR": True}) == calls.where("codec = 0 OR sensor_id = 1").count()
    assert n({"src_ip": [(167772160, 28)]}) == calls.where(F.col("src_ip").between(167772160, 167772175)).count()


def test_engine_pages(spark):
    e = Engine(spark, SF)
    rows = e.list_calls(sort="dur_us", descending=True, limit=5).collect()
    assert [r["dur_us"] for r in rows] == sorted((r["dur_us"] for r in rows), reverse=True) and len(rows) == 5
    page = json.loads(e.list_calls_json({"codec": [0]}, limit=3))
    assert page[1][0]["total"] == e.total_calls({"codec": [0]}) and len(page) == 5
    first = e.calls().orderBy("b_us").first()
    assert e.active_at(first["b_us"] // 1_000_000 + 1).where(F.col("call_id") == first["call_id"]).count() == int(first["e_us"] > (first["b_us"] // 1_000_000 + 1) * 1_000_000)
    assert set(e.masked(e.list_calls()).select(F.length("caller")).distinct().collect()[0]) == {8}
    assert e.query("asr_acd").count() > 0 and e.history(first["caller"]).count() > 0
