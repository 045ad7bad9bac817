"""Tables by key range: what a change rewrites, and what it leaves."""

import os

import pytest
from pyspark.sql import functions as F

from realty_spark.operators import cities, load
from realty_spark.sources.tables import RangeTable, range_of


def files(path):
    return {os.path.relpath(os.path.join(d, f), path) for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


def rows(df, *columns):
    return sorted(df.select(*columns).collect(), key=str)


def test_upsert_rewrites_touched_ranges(spark, tmp_path):
    old = spark.range(1000).selectExpr("id", "CAST(id % 7 AS INT) AS a", "concat('x', id) AS b")
    path = str(tmp_path / "t")
    table = RangeTable.create(old, path, "id", 10)
    assert len(table.bounds()) == 9 and rows(table.read(), "id", "a", "b") == rows(old, "id", "a", "b")
    low = table.bounds()[3]
    fresh = spark.createDataFrame([(low, 70, None), (low + 1, None, None), (low + 1, 71, "y")], "id long, a int, c string").drop("c")
    before = files(path)
    assert table.upsert(fresh) == [4]
    changed = {f.split("/")[0] for f in before ^ files(path)}
    assert changed == {"key_range=4"} and table.touched(fresh) == [4]
    once = fresh.filter("a IS NULL OR id = a - 70 + %d" % low).groupBy("id").agg(F.first("a").alias("a"))
    got = {r.id: (r.a, r.b) for r in table.read().collect()}
    assert got[low] == (70, f"x{low}") and got[low + 1] == ((low + 1) % 7, f"x{low + 1}") and len(got) == 1000  # of repeated keys the first in order, null first
    assert once.count() == 2
    assert table.upsert(fresh.limit(0)) == [] and table.delete(fresh.limit(0)) == []


def test_upsert_is_the_full_join(spark, tmp_path):
    old = spark.sql("SELECT id AS city_id, concat('c', lpad(id, 3, '0')) AS insee_code, IF(id % 3 = 0, NULL, id) AS price FROM range(300)")
    fresh = spark.sql("SELECT concat('c', lpad(id * 2, 3, '0')) AS insee_code, id AS price FROM range(100, 260) WHERE id % 2 = 0 UNION ALL SELECT NULL, 5")
    table = RangeTable.create(old, str(tmp_path / "t"), "insee_code", 8)
    table.upsert(fresh)
    want = cities.upsert(old, fresh.selectExpr("NULL AS city_id", "insee_code", "price"), "insee_code").drop("action")
    assert rows(table.read(), "city_id", "insee_code", "price") == rows(want, "city_id", "insee_code", "price")
    table.upsert(fresh.filter("insee_code IS NOT NULL"))  # a second run changes nothing
    assert rows(table.read(), "city_id", "insee_code", "price") == rows(want, "city_id", "insee_code", "price")


def test_delete_empties_a_range(spark, tmp_path):
    old = spark.range(100).selectExpr("IF(id = 99, NULL, id) AS id", "id AS v")
    path = str(tmp_path / "t")
    table = RangeTable.create(old, path, "id", 5)
    low = table.bounds()[0]
    before = files(path)
    assert table.delete(spark.range(low).unionByName(spark.createDataFrame([(None,)], "id long"))) == [0]
    assert {f.split("/")[0] for f in before ^ files(path)} == {"key_range=0"}
    assert sorted(r.v for r in table.read().collect()) == list(range(low, 100))
    assert table.upsert(spark.createDataFrame([(0, 5)], "id long, v long")) == [0]
    assert sorted(r.v for r in table.read().collect()) == sorted([*range(low, 100), 5])


def test_conf_is_restored(spark, tmp_path):
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    table = RangeTable.create(spark.range(10), str(tmp_path / "t"), "id", 1)
    assert table.bounds() == [] and spark.conf.get("spark.sql.sources.partitionOverwriteMode") == before
    empty = RangeTable.create(spark.range(10).limit(0), str(tmp_path / "e"), "id", 4)
    assert empty.bounds() == [] and empty.read().columns == ["id"] and empty.read().count() == 0
    assert table.delete(spark.range(10)) == [0] and table.read().count() == 0  # all rows gone
    assert table.upsert(spark.range(3)) == [0] and sorted(r.id for r in table.read().collect()) == [0, 1, 2]


@pytest.mark.parametrize("bounds", [[], [5], [1, 4, 6], list(range(0, 40, 3))])
def test_range_of(spark, bounds):
    got = spark.range(-2, 45).select("id", range_of(F.col("id"), bounds).alias("r")).collect()
    assert all(x.r == sum(b <= x.id for b in bounds) for x in got)


def test_store_touches_the_cities_of_a_run(spark, tmp_path):
    """Keys are hashes all over; ranges are of cities, so that a run about two cities rewrites theirs."""
    columns = "address_raw string, city_id int, sale_date date, property_type string, price int, source_url string, latitude double, longitude double, insee_code string"
    made = "SELECT concat(id, ' A') AS address_raw, CAST(id % 40 AS INT) AS city_id, DATE'2020-01-01' AS sale_date, 'house' AS property_type, CAST(id AS INT) AS price, concat('u', id) AS source_url, 1D AS latitude, 2D AS longitude, '59001' AS insee_code FROM range(800)"
    none = spark.createDataFrame([], "source_url string, address_key string")
    kept = ["address_key", "city_id", "address_raw", "price", "source_url"]
    first = load.load_addresses(spark.sql(made), none).select(kept)
    path = str(tmp_path / "t")
    table = RangeTable.create(first, path, "address_key", 8, by="city_id")
    run = spark.createDataFrame([("3 A", 3, None, "house", 9, "u3", 1.0, 2.0, "59001"), ("5 X", 4, None, "house", 7, "new", 1.0, 2.0, "59001")], columns).withColumn("sale_date", F.to_date(F.lit("2021-01-01")))
    loaded = load.load_addresses(run.unionByName(run.withColumn("price", F.lit(None).cast("int"))), table.read().select("source_url", "address_key"))
    before = files(path)
    assert load.store(loaded, table) == table.touched(run) and len(table.touched(run)) <= 2
    assert {f.split("/")[0] for f in before ^ files(path)} == {f"key_range={k}" for k in table.touched(run)}
    got = {r.source_url: r.price for r in table.read().collect()}
    assert len(got) == 801 and got["u3"] == 9 and got["new"] == 7 and got["u4"] == 4
    load.store(load.load_addresses(run, table.read().select("source_url", "address_key")), table)
    assert {r.source_url: r.price for r in table.read().collect()} == got and table.read().count() == 801
    assert table.delete(table.read().filter("source_url = 'new'").select("address_key", "city_id")) == table.touched(run.filter("city_id = 4"))
    assert table.read().count() == 800
