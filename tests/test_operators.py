"""Operators on rows worked out by hand, and invariants."""

import datetime as dt
import sys
import unicodedata
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from realty_spark.functions import numbers as NF
from realty_spark.functions import text as T
from realty_spark.operators import assign, dedup, enrich, normalize, slices
from realty_spark.plans import pipeline
from realty_spark.schemas import RAW_SALE
from realty_spark.sources import files, pages
from realty_spark.streaming import incremental

RAW = [
    ("123 Rue de la République", "Lille", "300000", "120", "4", "15/01/2023", "maison", "https://example.com/1"),
    ("12 bis rue de l'Œuvre", "Marcq-en-Barœul", "1 200", "45.9", "x", "5/1/2023", "Château", None),
    ("  ", "Lille", "100000", "10", "1", "31/02/2023", "maison", "https://example.com/1"),
    ("1 rue X", "Lille", "inf", "10", "1", "01/02/2023", "terrains", "https://example.com/3"),
    (None, None, None, None, None, None, None, None),
]


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]


def test_normalize(spark):
    judged = normalize.with_reason(spark.createDataFrame(RAW, RAW_SALE)).collect()
    assert (judged[0].address_raw, judged[0].city_name, judged[0].property_type) == ("123 RUE DE LA REPUBLIQUE", "LILLE", "house")
    assert judged[0].sale_date == dt.date(2023, 1, 15)
    assert (judged[1].city_name, judged[1].property_type, judged[1].price, judged[1].surface, judged[1].rooms) == ("MARCQ EN BARUL", "other", 0, 45, 0)
    assert [r.reason for r in judged] == [None, "price", "address", "price", "address"]
    with pytest.raises(ValueError, match="price"):
        normalize.normalize(spark.createDataFrame([("a", "b")], "address string, city string"))


def test_fold_is_nfkd(spark):
    """Every assigned code point alone, and long texts of many at once."""
    want = lambda t: unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode()
    letters = [chr(c) for c in range(1, sys.maxunicode + 1) if unicodedata.category(chr(c)) not in ("Cn", "Cs", "Co")]
    texts = letters + ["".join(letters[k : k + 500]) for k in range(0, len(letters), 500)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, x string").select("i", T.fold(F.col("x")).alias("y")).collect()
    assert len(rows) > 100_000 and [r.i for r in rows if r.y != want(texts[r.i])] == []
    assert one(spark, None, T.fold) is None and one(spark, "ﬁ Ⅷ ẞ ９ Việt ﷺ", T.fold) == want("ﬁ Ⅷ ẞ ９ Việt ﷺ")


def test_text(spark):
    assert one(spark, "12 B, avenue X, Lille", lambda c: T.parse_address(c)["number"]) is not None
    assert one(spark, "rue X", lambda c: T.parse_address(c)["number"]) is None
    assert one(spark, "3 rue A 59000 Lille", lambda c: T.parse_address(c)["city"]) == "59000 LILLE"
    assert one(spark, "12 Avenue Foch (bât. B) 75001", T.match_form) == "12 AV FOCH"
    assert one(spark, "1000.0", T.postcode) == "01000"
    assert one(spark, "2A004", T.insee) == "2A004" and one(spark, "AB123", T.insee) is None
    assert one(spark, "97411", T.department) == "974" and one(spark, "2B033", T.department) == "2B"
    assert one(spark, "12,5 m²", T.listing_surface) == 12.5


def test_dates_and_numbers(spark):
    got = [one(spark, x, NF.strict_date) for x in ("5/1/2023", "31/02/2023", "5/1/23", "2023-01-05", None)]
    assert got == [dt.date(2023, 1, 5), None, None, None, None]
    assert [one(spark, x, NF.lenient_int) for x in ("120.7", "-3.9", "nan", "inf", "1e12", None)] == [120, -3, 0, 0, 0, 0]


def test_price_rounds_half_even(spark):
    row = spark.sql("SELECT 100500D AS price, 0D AS r, 1D AS y, 'D' AS c").select(NF.estimated_price(F.col("price"), F.col("r"), F.col("y"), F.col("c")).alias("p")).first()
    assert row.p == 100000


def test_keep_first_keeps_null_urls(spark):
    rows = [(1, None, "A", "L", 1, 1, 1, None), (2, None, "B", "L", 1, 1, 1, None), (3, "u", "C", "L", 1, 1, 1, None), (4, "u", "D", "L", 1, 1, 1, None)]
    df = spark.createDataFrame(rows, "id int, source_url string, address_raw string, city_name string, price int, surface int, rooms int, sale_date date")
    assert sorted(r.id for r in dedup.keep_first(df, "id").collect()) == [1, 2, 3]


def test_linkage_is_brute_force(spark):
    import random

    rnd = random.Random(3)
    streets = ["RUE A", "RUE AB", "AVENUE DE LA GARE", "PLACE X"]
    side = lambda n: [(i, "59001", f"{rnd.randint(1, 12)} {rnd.choice(streets)}", 45 + rnd.randint(0, 9) * 3e-5, 3 + rnd.randint(0, 9) * 3e-5) for i in range(n)]
    s, c = side(80), side(60)
    sales = spark.createDataFrame(s, "address_id long, insee_code string, address_raw string, latitude double, longitude double")
    certs = spark.createDataFrame([(i, f"N{i}", loc, a, f"{x!r},{y!r}", "C", None, None) for i, loc, a, x, y in c], "certificate_id long, dpe_number string, code_insee string, adresse string, geopoint string, etiquette_dpe string, annee_construction string, periode_construction string")
    got = {r.address_id: r.certificate_id for r in enrich.link_certificates(sales, certs).collect()}
    import math

    want = {}
    for i, _, a, x, y in s:
        best = None
        for j, _, b, u, v in c:
            h = math.sin(math.radians(u - x) / 2) ** 2 + math.cos(math.radians(x)) * math.cos(math.radians(u)) * math.sin(math.radians(v - y) / 2) ** 2
            d = round(2 * 6371 * math.atan2(math.sqrt(h), math.sqrt(1 - h)) * 1000, 6)
            f = lambda t: (" " + t).replace(" AVENUE ", " AV ").replace(" PLACE ", " PL ").strip()
            if abs(int(a.split()[0]) - int(b.split()[0])) <= 2 and d <= 20 and round(SequenceMatcher(None, f(a), f(b)).ratio(), 6) >= 0.7:
                best = min(best or (9e9,), (d, f"N{j}", j))
        if best:
            want[i] = best[2]
    assert got == want and want


def test_sample_is_weighted_and_stable(spark):
    rows = spark.range(2000).selectExpr("id AS client_id").crossJoin(spark.sql("SELECT explode(sequence(1, 6)) AS address_id")).selectExpr("client_id", "address_id", "date_add(DATE'1996-01-01', CAST(address_id AS INT)) AS sale_date", "3 AS wanted")
    weighted = assign.with_weight(rows)
    a = assign.weighted_sample(weighted, 1, 3).select("client_id", "address_id")
    b = assign.weighted_sample(weighted.repartition(5), 1, 3).select("client_id", "address_id")
    assert a.exceptAll(b).isEmpty() and a.count() == 6000
    share = [r.n / 2000 for r in a.groupBy("address_id").agg(F.count("*").alias("n")).orderBy("address_id").collect()]
    assert all(abs(x - y) < 0.04 for x, y in zip(share, (0.739, 0.671, 0.584, 0.480, 0.345, 0.181)))


def test_capped_slices(spark):
    df = spark.range(5000).selectExpr("id % 3 AS city_id", "CAST(id * id % 997 AS INT) AS price").union(spark.range(300).selectExpr("0L", "5"))
    got = slices.capped_slices(df, ["city_id"]).collect()
    assert sum(r.n for r in got) == 5300
    assert all(r.n < 99 or r.band_max - r.band_min == 1 for r in got)
    for city in range(3):
        bands = sorted((r.band_min, r.band_max) for r in got if r.city_id == city)
        assert all(a[1] <= b[0] for a, b in zip(bands, bands[1:]))


def test_pages(spark):
    card = '<div class="card"><span class="address">1 rue A - Lille 59000</span><b class="price">250 000 €</b><i class="surface">45,5 m²</i><i class="rooms">3</i><a href="/x" data-date="1673740800000">Maison<br></a></div>'
    html = f'<div class="list">{card}<div class="card skeleton">{"x" * 40}</div><div class="card hidden">{"y" * 40}</div><div class="card">kurz</div></div>'
    df = spark.createDataFrame([(1, html), (2, "<p>nothing</p>"), (3, "<div class=list><div class=card><b"), (4, None)], "page_id long, html string")
    got = pages.listings(df, container="list", card="card").collect()
    assert len(got) == 1
    r = got[0]
    assert (r.address, r.city, r.postal_code, r.price, r.surface, r.rooms, r.property_type, r.property_url) == ("1 rue A", "Lille", "59000", 250000, 45.5, 3, "house", "https://example.com/x")
    assert r.sale_date == dt.date(2023, 1, 15)


def test_type_falls_back(spark):
    shapes = [
        ('<p class="type"><svg>appartement</svg><span> Maisons </span></p>', "house"), ('<p class="type"><svg>maison</svg>un beau Terrain</p>', "land"), ('<span>de</span><span>Locaux Commerciaux maison</span>', "other"),
        ('<span>maison</span>', "house"), ('<p>vente: grande maison et appartement</p>', "apartment"), ('<p class="alt">Local</p>', "other"), ('<p>rien du tout ici</p>', "other"), ('<p class="type"><span>Autre</span></p><p>maison</p>', "other"),
    ]
    html = "".join(f'<div class="card"><p class="address">{i} rue longue - Ville</p>{x}</div>' for i, (x, _) in enumerate(shapes))
    got = pages.listings(spark.createDataFrame([(1, f'<div class="list">{html}</div>')], "page_id long, html string"), container="list", card="card").orderBy("place").collect()
    assert [r.property_type for r in got] == [t for _, t in shapes]


def test_files(spark, tmp_path):
    df = spark.createDataFrame(RAW, RAW_SALE)
    files.write_stage(df, f"{tmp_path}/stage", "csv")
    plain = lambda rows: sorted(str([(x or "").strip() for x in r]) for r in rows)  # noqa: E731  blanks are written as nothing
    back = files.read_csv(spark, f"{tmp_path}/stage", RAW_SALE)
    assert plain(back.collect()) == plain(RAW) and back.schema == RAW_SALE
    files.write_stage(df, f"{tmp_path}/stage")
    assert spark.read.parquet(f"{tmp_path}/stage").count() == len(RAW)

    lines = "address,city,price,surface,rooms,sale_date,property_type,property_url\n" + "1 rue A,Lille,1,2,3,01/01/2023,maison,u\n" * 40
    for name, text in {"Lille_2023.csv": lines, "export-59100.csv": lines, "Saint-Omer_a.csv": lines, "lillers_1.csv": lines, "lille_small.csv": lines[:90], "lille.txt": lines}.items():
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / name).write_text(text)
    cities = spark.createDataFrame([(1, "Lille", "59000"), (2, "Roubaix", "59100"), (3, "Saint Omer", "62500"), (4, None, None)], "city_id long, name string, postal_code string")
    got = files.city_files(spark, f"{tmp_path}/in", RAW_SALE, cities).groupBy("file_name", "city_id").count().collect()
    assert {(r.file_name, r.city_id, r["count"]) for r in got} == {("Lille_2023.csv", 1, 40), ("export-59100.csv", 2, 40), ("Saint-Omer_a.csv", 3, 40)}

    sales = spark.createDataFrame([("A", "Lille", 1, 0), ("", "Roubaix", 5, 2), (None, None, 0, 0), ("", "", 0, None)], "address_raw string, city_name string, price int, rooms int")
    files.export(sales, f"{tmp_path}/out", "r1")
    back = spark.read.option("header", True).csv(f"{tmp_path}/out")
    assert {(r.city_name, r.price, r.city, r.run) for r in back.collect()} == {("Lille", "1", "Lille", "r1"), ("Roubaix", "5", "Roubaix", "r1")}
    files.export(sales.filter("price = 0"), f"{tmp_path}/none", "r2")
    empty = spark.read.option("header", True).csv(f"{tmp_path}/none/run=r2")
    assert empty.count() == 0 and empty.columns == sales.columns
    assert sales.filter(files.not_empty(["address_raw", "city_name", "price", "rooms"])).count() == 2


def test_ratio_bound(spark):
    import random

    r = random.Random(5)
    rows = [("".join(r.choice("AB C") for _ in range(r.randint(0, 9))), "".join(r.choice("AB D") for _ in range(r.randint(0, 9)))) for _ in range(200)]
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", enrich.ratio_bound(F.col("a"), F.col("b")).alias("most")).collect()
    assert all(SequenceMatcher(None, x.a, x.b).ratio() <= x.most + 1e-9 for x in got) and any(x.most < 0.7 for x in got)
    kept = enrich.similar(spark.createDataFrame(rows, "a string, b string"), "a", "b", "ratio", 0.7).collect()
    assert sorted((x.a, x.b) for x in kept) == sorted((a, b) for a, b in rows if round(SequenceMatcher(None, a, b).ratio(), 6) >= 0.7)


def test_names_of_departments(spark):
    from realty_spark.sources.departments import rows

    names = {r[0]: (r[1], r[2]) for r in rows()}
    assert len(names) == 101 and names["974"] == ("La Réunion", "La Réunion") and names["90"][0] == "Territoire de Belfort"
    assert names["2A"] == ("Corse-du-Sud", "Corse") and names["59"] == ("Nord", "Hauts-de-France")


def test_cache_is_refreshed_by_location(spark):
    rows = [(1, "A", "2002-12-20 00:00:00"), (2, "A", "2002-12-01 23:59:59"), (3, "B", "2002-12-02 00:00:00"), (4, "C", None)]
    df = spark.createDataFrame(rows, "certificate_id long, code_insee string, fetched_at string")
    fresh, old = enrich.cached(df, F.to_date(F.lit("2003-01-01")))
    assert [r.certificate_id for r in fresh.collect()] == [3] and {r.code_insee for r in old.collect()} == {"A", "C"}


def test_feeds_reach_the_linkage(spark):
    feed = spark.createDataFrame([("D1", "12", "Rue A", "59000", "Lille", "45.0,3.0", "C", "59350")], "numero_dpe string, numero_voie_ban string, nom_rue_ban string, code_postal_ban string, nom_commune_ban string, geo_point string, Etiquette_DPE string, code_insee_ban string")
    pool = enrich.certificate_pool(enrich.conformed(feed, 1))
    sales = spark.createDataFrame([(7, "59350", "12 rue A 59000 Lille", 45.0, 3.0001)], "address_id long, insee_code string, address_raw string, latitude double, longitude double")
    r = enrich.link_certificates(sales, pool).first()
    assert (r.address_id, r.dpe_number, r.dpe_energy_class, r.dpe_date) == (7, "D1", "C", None)
    assert pool.first().adresse == "12 Rue A 59000 Lille"


def test_enrichment_keeps_stages_and_fails_without_places(spark, tmp_path):
    cities = spark.createDataFrame([("c1", "LILLE", "59000", "59350", None, None)], "city_id string, name string, postal_code string, insee_code string, last_scraped string, house_price_avg int")
    market = spark.createDataFrame([("c1", "59350", 2500)], "city_id string, insee_code string, house_price_avg int")
    raw = spark.createDataFrame(RAW, RAW_SALE)
    answers = spark.createDataFrame([("123 RUE DE LA REPUBLIQUE, LILLE, 59000", 50.6, 3.0, 0.9)], "q string, latitude double, longitude double, score double")
    as_of = F.to_date(F.lit("2024-01-01"))
    out = pipeline.enrich(spark, raw, pipeline.Inputs(cities, None, answers, None, market), as_of, keep=str(tmp_path))
    r = out.rows.first()
    assert (r.city_id, r.action, r.department, out.cities.first().house_price_avg, out.certificates.count(), out.report.first().success) == ("c1", "inserted", "59", 2500, 0, True)
    assert {(x.stage, x.n_in, x.n_out) for x in out.stats.collect()} >= {("normalize", 5, 1), ("resolve", 1, 1), ("geocode", 1, 1), ("load", 1, 1)}
    assert sorted(p.name for p in tmp_path.iterdir())[0] == "1_normalize" and len(list(tmp_path.iterdir())) == 7
    with pytest.raises(ValueError, match="geocoded"):
        pipeline.run_enrichment(spark, raw, pipeline.Inputs(cities, None, answers.limit(0)), as_of)


def test_stage_bounds(spark):
    df = spark.createDataFrame(RAW, RAW_SALE)
    with pytest.raises(ValueError):
        pipeline.run_enrichment(spark, df, pipeline.Inputs(df), F.to_date(F.lit("2024-01-01")), 3, 2)


def test_incremental_is_idempotent(spark, tmp_path):
    df = spark.createDataFrame(RAW[:1] + [(*RAW[0][:7], "https://example.com/9")], RAW_SALE)
    source, target, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    df.limit(1).write.parquet(source)
    assert incremental.ingest(spark, source, RAW_SALE, target, state).count() == 1
    df.write.mode("append").parquet(source)
    n = incremental.ingest(spark, source, RAW_SALE, target, state).count()
    assert n == incremental.ingest(spark, source, RAW_SALE, target, state).count() <= 2
