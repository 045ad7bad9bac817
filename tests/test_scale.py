"""Prefix sums and places against sorting, weighted draws without whole groups, streams that read no earlier output, exports that are run again, and inputs that are scanned once."""

import random
import shutil
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from realty_spark.operators import assign, prefix, slices
from realty_spark.plans import pipeline
from realty_spark.schemas import RAW_SALE
from realty_spark.sources import files
from realty_spark.streaming import incremental


def priced(spark, seed=3):
    r = random.Random(seed)
    top = [10, 4095, 4096, 4097, 300_000, 2**24, 2**36 + 5, 2**50]
    rows = [(k, r.choice([r.randrange(t) for t in top] + [5, -7, -5000, None])) for k in (None, "a", "b") for _ in range(200)]
    rows += [("hot", r.randrange(25_000_000)) for _ in range(4000)] + [("one", 9)]
    return rows, spark.createDataFrame(rows, "k string, price long")


@pytest.mark.parametrize("bits, levels", [(12, 3), (3, 2), (2, 1), (5, 0)])
def test_sums_before(spark, bits, levels):
    rows, df = priced(spark)
    counts = df.groupBy("k", "price").agg(F.count("*").alias("n")).withColumn("m", F.col("n") * 2)
    got = prefix.sums_before(counts, ["k"], "price", ["n", "m"], bits, levels).collect()
    low = lambda p: -(10**18) if p is None else p
    for x in got:
        if x.k != "hot" or x.price % 50 == 0:
            want = sum(k == x.k and low(p) < low(x.price) for k, p in rows)
            assert (x.n_before, x.m_before) == (want, 2 * want)
    assert len(got) == len(set(rows))


def test_windows_hold_one_prefix(spark):
    """No window gathers a group: each is of a prefix, whose rows are bounded by the bits."""
    rows, df = priced(spark)
    plan = prefix.sums_before(df.groupBy("k", "price").agg(F.count("*").alias("n")), ["k"], "price", ["n"])._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert len(windows) == 4 and sum("__p" in line.split("], [")[1] for line in windows) == 3
    counts = df.filter("k = 'hot'").groupBy("k", "price").agg(F.count("*").alias("n"))
    tables = prefix._levels(counts, ["k"], "price", ["n"], prefix.BITS, prefix.LEVELS)
    held = [t.groupBy("__g", f"__p{i + 1}").count().agg(F.max("count")).first()[0] for i, t in enumerate(tables)]
    assert max(held) <= 2**prefix.BITS and held[-1] == 1 and held[0] < counts.count() / 20


def test_quantiles_are_places_of_the_order(spark):
    rows, df = priced(spark)
    shares = {"p0": 0.0, "p05": 0.05, "p50": 0.5, "p95": 0.95, "p1": 0.9999999}
    got = {x.k: x for x in slices.positional_quantiles(df, ["k"], "price", shares).collect()}
    for k in (None, "a", "b", "hot", "one"):
        own = sorted(p for q, p in rows if q == k and p is not None and p > 0)
        assert (got[k].n, got[k].least, got[k].most) == (len(own), own[0], own[-1])
        assert [got[k][name] for name in shares] == [own[int(p * len(own))] for p in shares.values()]
    assert slices.positional_quantiles(df.limit(0), ["k"], "price", shares).collect() == []
    by_half = df.withColumn("price", F.col("price") / 2)
    assert {x.k: x.p50 for x in slices.positional_quantiles(by_half, ["k"], "price", shares).collect()} == {k: x.p50 / 2 for k, x in got.items()}


def test_slices_of_one_large_key(spark):
    rows, df = priced(spark)
    got = slices.capped_slices(df.filter("k = 'hot' AND price IS NOT NULL"), ["k"], 40).collect()
    own = sorted(p for k, p in rows if k == "hot")
    assert sum(x.n for x in got) == len(own) and max(x.n for x in got) < 40
    for x in got:
        assert x.n == sum(x.band_min <= p < x.band_max for p in own)


RAW = [(f"{i} rue X", "Lille", str(100_000 + i), "50", "2", "15/01/2023", "maison", f"https://example.com/{i}") for i in range(30)]


def test_batches_read_no_earlier_output(spark, tmp_path):
    source, target, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    df = spark.createDataFrame(RAW, RAW_SALE)
    df.limit(20).coalesce(1).write.parquet(source)
    assert incremental.ingest(spark, source, RAW_SALE, target, state).count() == 20
    away = tmp_path / "away"
    for batch in Path(target).glob("batch=*"):  # what was loaded can't be read
        shutil.move(str(batch), away / batch.name) if away.mkdir(exist_ok=True) is None else None
    more = spark.createDataFrame([*RAW, *[(*x[:7], None) for x in RAW[:2]], ("7 rue Y", *RAW[3][1:])], RAW_SALE)
    more.repartition(3).write.mode("append").parquet(source)
    fresh = incremental.ingest(spark, source, RAW_SALE, target, state, files=1)
    assert sorted(int(x.source_url.rsplit("/", 1)[1]) for x in fresh.collect() if x.source_url) == list(range(20, 30))
    assert fresh.filter("source_url IS NULL").count() == 2
    assert incremental.ingest(spark, source, RAW_SALE, target, state).count() == 12
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("HDFSBackedStateStoreProvider")


def test_export_twice_is_once(spark, tmp_path):
    path = str(tmp_path / "x")
    rows = [("1 A", "LILLE", 10), ("2 A", "LILLE", 20), ("1 B", "LENS", 5), ("", "", 0)]
    df = spark.createDataFrame(rows, "address_raw string, city_name string, price int")
    read = lambda: sorted((r.city, r.run, r.address_raw) for r in spark.read.option("header", True).csv(path).collect())
    for _ in range(2):
        files.export(df, path, "r1")
    files.export(df.filter("price = 20"), path, "r2")
    first = [("LENS", "r1", "1 B"), ("LILLE", "r1", "1 A"), ("LILLE", "r1", "2 A")]
    assert read() == sorted([*first, ("LILLE", "r2", "2 A")])
    files.export(df.filter("price <= 10"), path, "r1")  # a city and a row less
    files.export(df.filter("city_name = 'LENS'"), path, "r2")
    assert read() == [("LENS", "r1", "1 B"), ("LENS", "r2", "1 B"), ("LILLE", "r1", "1 A")]


def test_enrichment_scans_its_input_once(spark, tmp_path):
    """Rows that pass the first stage are counted as they pass: each of them once, for rows, statistics and all other results."""
    passed = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(x):
        passed.add(1)
        return x

    raw = spark.createDataFrame(RAW, RAW_SALE)
    raw.write.parquet(str(tmp_path / "raw"))
    raw = spark.read.parquet(str(tmp_path / "raw")).withColumn("address", seen("address"))
    cities = spark.createDataFrame([("c1", "LILLE", "59000", "59350", None, None)], "city_id string, name string, postal_code string, insee_code string, last_scraped string, house_price_avg int")
    answers = spark.createDataFrame([(f"{i} RUE X, LILLE, 59000", 50.6, 3.0, 0.9) for i in range(0, 30, 2)], "q string, latitude double, longitude double, score double")
    certificates = spark.createDataFrame([(1, "D1", "59350", "4 rue X", "50.6,3.0", "C", None, None)], "certificate_id long, dpe_number string, code_insee string, adresse string, geopoint string, etiquette_dpe string, annee_construction string, periode_construction string")
    out = pipeline.enrich(spark, raw, pipeline.Inputs(cities, certificates, answers), F.to_date(F.lit("2024-01-01")))
    assert {(x.stage, x.n_in, x.n_out, x.n_rejected) for x in out.stats.collect()} >= {("normalize", 30, 30, 0), ("resolve", 30, 30, 0), ("geocode", 30, 15, 15), ("certificates", 15, 15, 0), ("load", 15, 15, 0)}
    assert out.rows.count() == 15 and out.report.count() == 15 and out.certificates.count() == 3 and out.rows.filter("dpe_number = 'D1'").count() == 3
    assert passed.value == 30


def offered(spark):
    """One client with most of the rows, one with fewer than wanted, one who wants none, one without a number, and equal weights."""
    rows = [(c, i, w, 1 + i % m) for c, n, w, m in ((1, 3000, 40, 3000), (2, 5, 40, 2), (3, 50, 0, 7), (4, 50, None, 7), (5, 400, 1, 1), (None, 60, 7, 60)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "client_id long, address_id long, wanted int, weight long").repartition(7)


def drawn_by_sorting(df):
    keyed = df.withColumn("key", F.ln(assign.N.uniform(F.lit(11), F.col("client_id"), F.col("address_id"))) / F.col("weight")).collect()
    out = set()
    for c in {r.client_id for r in keyed}:
        own = sorted((r for r in keyed if r.client_id == c), key=lambda r: (-r.key, r.address_id))
        out |= {(c, r.address_id, k) for k, r in enumerate(own, 1) if k <= (r.wanted or 0)}
    return out


@pytest.mark.parametrize("ranked", [1000, 0])
def test_weighted_draws(spark, monkeypatch, ranked):
    """Ranks cut by Spark and rows cut by levels of the keys draw what sorting each client draws."""
    monkeypatch.setattr(assign, "RANKED", ranked)
    rows, df = offered(spark)
    got = [(r.client_id, r.address_id, r.rn) for r in assign.weighted_sample(df, 11, 40).collect()]
    assert len(got) == len(set(got)) and set(got) == drawn_by_sorting(df)
    assert assign.weighted_sample(df.limit(0), 11, 40).count() == 0


def test_draws_send_few_rows(spark):
    """Up to RANKED rows a partition ranks its own before the shuffle; beyond, levels leave little more than is wanted."""
    rows, df = offered(spark)
    plan = assign.weighted_sample(df, 11, 40)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("WindowGroupLimit", plan.index("Exchange")) > plan.index("Exchange")
    assert "Partial" in plan
    keyed = df.withColumn("__key", F.ln(assign.N.uniform(F.lit(11), F.col("client_id"), F.col("address_id"))) / F.col("weight"))
    left = {r.client_id: r["count"] for r in assign._upper(keyed).groupBy("client_id").count().collect()}
    assert 40 <= left[1] <= 60 and left[2] == 5 and 1 <= left[5] <= 10 and 3 not in left and 4 not in left
