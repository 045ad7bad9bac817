"""Linkage of crowded places against brute force, shares of hot keys, cells, and the text ratio against difflib."""

import math
import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from realty_spark.functions.ratio import ratio
from realty_spark.operators import enrich, skew

SALE = "address_id long, insee_code string, postal_code string, city_name string, address_raw string, latitude double, longitude double"
CERTIFICATE = "certificate_id long, dpe_number string, code_insee string, code_postal string, commune string, adresse string, geopoint string, etiquette_dpe string, annee_construction string, periode_construction string"


def metres(x, y, u, v):
    h = math.sin(math.radians(u - x) / 2) ** 2 + math.cos(math.radians(x)) * math.cos(math.radians(u)) * math.sin(math.radians(v - y) / 2) ** 2
    return round(2 * 6371 * math.atan2(math.sqrt(h), math.sqrt(1 - h)) * 1000, 6)


def test_ratio_is_difflib(spark):
    r = random.Random(3)
    words = ["RUE", "AV", "DE", "LA", "REPUBLIQUE", "GENERAL", "12", "B", "PL", "PRES", "É", "ab"]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    pairs = [("", ""), ("a", ""), ("", "b"), (None, "a"), ("a", None), ("abcd", "bcde"), ("aaaa", "aa"), ("ab" * 100, "ba" * 100)]
    for _ in range(1500):
        a = text(r.randint(1, 6))
        b = list(a)
        for _ in range(r.randint(0, 6)):
            b[r.randrange(len(b)) :][:1] = [r.choice("ABE 1é")]
            b.insert(r.randrange(len(b) + 1), r.choice("ABE 1é"))
        pairs.append((a, "".join(b) if r.random() < 0.7 else text(r.randint(1, 6))))
    letters = lambda s, n: "".join(r.choice(s) for _ in range(n))
    pairs += [(letters("abc", r.randint(0, 30)), letters("abc", r.randint(0, 30))) for _ in range(400)]
    pairs += [(letters("abcdefghijklmnopqrstuvwxyz0123456789", 230), letters("abcdefghijklmnopqrstuvwxyz0123456789", r.randint(195, 260))) for _ in range(20)]
    pairs += [(t, t[:70] + letters("XYZ ", 9) + t[60:]) for t in (text(60) for _ in range(20))]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string").select("i", ratio(F.col("a"), F.col("b")).alias("r"))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
    got = {x.i: x.r for x in df.collect()}
    assert got == {i: None if a is None or b is None else pytest.approx(SequenceMatcher(None, a, b).ratio(), abs=1e-12) for i, (a, b) in enumerate(pairs)}


@pytest.mark.parametrize("most", [40, 20_000])
@pytest.mark.parametrize("fallback, strict", [(False, True), (True, True), (False, False)])
def test_crowded_place(spark, most, fallback, strict):
    """A third of all certificates and sales at one number of one street; some copies but for their ids."""
    r = random.Random(7)
    streets = ["RUE A", "RUE AB", "AV DE LA GARE", "PL X"]

    def side(n):
        rows = []
        for i in range(n):
            if i % 3 == 0:
                rows.append((i, "59001", f"5 {streets[i % 2]}", 50.0 + (i % 5) * 2e-5, 3.0 + (i % 3) * 3e-5))
            else:
                number = "" if i % 7 == 0 else f"{r.randint(1, 9)} "
                rows.append((i, r.choice(["59001", "59002", None]), number + r.choice(streets), 50 + r.randint(0, 9) * 4e-5, 3 + r.randint(0, 9) * 4e-5))
        return rows

    s, c = side(240), side(300)
    post = lambda i: "59000" if i % 4 else None
    sales = spark.createDataFrame([(i, loc, post(i), "Lille", a, x, y) for i, loc, a, x, y in s], SALE)
    certs = spark.createDataFrame([(i, f"N{i % 90:03}" if i % 11 else None, loc, post(i), "LILLE", a, f"{x!r},{y!r}", "C", None, None) for i, loc, a, x, y in c], CERTIFICATE)
    got = {x.address_id: (x.certificate_id, x.distance_m) for x in enrich.link_certificates(sales, certs, fallback=fallback, strict=strict, most=most).collect()}
    number = lambda t: int(t.split()[0]) if t.split()[0].isdigit() else None
    want = {}
    for i, loc, a, x, y in s:
        best = None
        for j, cloc, b, u, v in c:
            here = loc is not None and loc == cloc or fallback and post(i) and post(i) == post(j)
            m, n = number(a), number(b)
            bare = m is None or n is None
            d = metres(x, y, u, v)
            if here and d <= 20 and (not strict if bare else abs(m - n) <= 2):
                alike = round(SequenceMatcher(None, a, b).ratio(), 6)
                if alike >= (0.85 if bare else 0.7):
                    dpe = f"N{j % 90:03}" if j % 11 else None
                    best = min(best or (9e9,), (d, dpe is None, dpe or "", j))
        if best:
            want[i] = (best[3], best[0])
    assert got == want and len(want) > 100


def test_cells_hold_what_is_near(spark):
    r = random.Random(5)
    rows = []
    for _ in range(3000):
        lat, lon = r.choice([r.uniform(-85, 85), r.uniform(88.999, 89.001), 90 - r.random() * 1e-3, -89.0]), r.choice([r.uniform(-180, 180), 180 - r.random() * 1e-4, -180 + r.random() * 1e-4])
        u = min(90.0, max(-90.0, lat + r.uniform(-1.8e-4, 1.8e-4)))
        v = lon + r.uniform(-1, 1) * 1.8e-4 / max(math.cos(math.radians(lat)), 1e-3)
        v = v - 360 if v > 180 else v + 360 if v < -180 else v
        if metres(lat, lon, u, v) <= 20:
            rows.append((lat, lon, u, v))
    df = spark.createDataFrame(rows, "latitude double, longitude double, u double, v double")
    own = F.struct(F.floor(F.col("latitude") / enrich.CELL).alias("cy"), F.when(F.abs("latitude") > 89, -1).otherwise(F.pmod(F.floor(F.col("longitude") / enrich.CELL), F.lit(2**17))).alias("cx"))
    near = enrich._cells(F.col("u"), F.col("v"), 20.0)
    told = df.select("u", F.exists(near, lambda x: (x["cy"] == own["cy"]) & (x["cx"] == own["cx"])).alias("held"), F.size(near).alias("n"))
    assert len(rows) > 500 and told.filter("NOT held").isEmpty()
    assert told.filter("abs(u) < 60").agg(F.avg("n")).first()[0] < 2.5


def test_shares_of_hot_keys(spark):
    """One key has half of all rows: no share of it is far over the bound, and the join is the plain one."""
    many = spark.range(20_000).selectExpr("CASE WHEN id % 2 = 0 THEN 0 ELSE id % 1000 END AS k", "id")
    few = spark.range(1000).selectExpr("id AS k", "id * 2 AS v")
    left, right = skew.dealt(many, few, ["k"], F.xxhash64("id"), most=200)
    sizes = [x["count"] for x in left.groupBy("k", "__share").count().collect()]
    assert max(sizes) < 400 and right.count() == 999 + 10_000 // 200 + (10_000 % 200 > 0)
    got = skew.skew_join(many, few, ["k"], F.xxhash64("id"), most=200)
    assert sorted(map(tuple, got.select("k", "id", "v").collect())) == sorted(map(tuple, many.join(few, "k").select("k", "id", "v").collect()))
    assert skew.hot_keys(many, ["k"], most=5, bound=3).count() == 3
