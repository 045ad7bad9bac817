"""Stages 3 to 6: geocoder answers, certificates, linkage and price estimates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from realty_spark.functions import geo as G
from realty_spark.functions import numbers as N
from realty_spark.functions import text as T
from realty_spark.functions.ratio import ratio
from realty_spark.operators.dedup import first_by
from realty_spark.operators.skew import HOT_ROWS, skew_join

#: Degrees of a cell in which sales and certificates meet, about 300 m of latitude: a whole number of them goes around the globe.
CELL = 360 / 2**17


def geocode(sales: DataFrame, answers: DataFrame) -> DataFrame:
    """Sales with the geocoder's answer to their full address (column q); result_* columns go before plain ones."""
    value = lambda c: F.coalesce(*(F.col(x).try_cast("double") for x in (f"result_{c}", c) if x in answers.columns))
    label = F.coalesce(*(F.col(x) for x in ("result_label", "label") if x in answers.columns), F.lit("Non disponible"))
    score = F.coalesce(value("score"), F.lit(0.0))
    got = answers.select("q", value("latitude").alias("latitude"), value("longitude").alias("longitude"), label.alias("address_normalized"), score.alias("geocoding_score"))
    key = T.query_key(F.col("address_raw"), F.col("city_name"), F.col("postal_code"))
    out = sales.withColumn("q", key).join(first_by(got, ["q"], [F.desc("geocoding_score"), "latitude", "longitude"]), "q", "left").drop("q")
    return out.withColumns({"address_normalized": F.coalesce("address_normalized", F.lit("Non disponible")), "geocoding_score": F.coalesce("geocoding_score", F.lit(0.0))})


def geocoded(sales: DataFrame, least_score: float = 0.1, box: tuple[float, float, float, float] | None = None, distance_km: float = 0.0) -> DataFrame:
    """Sales with coordinates and a score that is null or high enough; ``box``: min_lat, min_lon, max_lat, max_lon, off by default, widened
    by ``distance_km`` on each side."""
    if box:
        up, along = G.lat_degrees(distance_km), distance_km / (math.cos(math.radians((box[0] + box[2]) / 2)) * G.KM_PER_LON)
        box = (box[0] - up, box[1] - along, box[2] + up, box[3] + along)
    out = sales.filter(F.col("latitude").isNotNull() & F.col("longitude").isNotNull() & (F.col("geocoding_score").isNull() | (F.col("geocoding_score") >= least_score)))
    return out.filter(F.col("latitude").between(box[0], box[2]) & F.col("longitude").between(box[1], box[3])) if box else out


def location_key(insee: Column, postal: Column, city: Column) -> Column:
    blank = F.lit("")
    return F.coalesce(F.nullif(insee, blank), F.nullif(F.substr(postal, F.lit(1), F.lit(5)), blank), F.nullif(F.regexp_extract(city, "(\\d{5})", 1), blank))


def conformed(feed: DataFrame, priority: int) -> DataFrame:
    """A certificate feed under the names of the certificate table; ``priority`` orders feeds.

    An address is the first of the address columns, else put together from its parts.  certificate_id is made of what identifies a certificate.
    """
    # Names that feeds use for one column.
    names = {
        "dpe_number": ["dpe_number", "N°DPE", "numero_dpe"],
        "adresse": ["adresse", "Adresse_brute", "adresse_brut", "adresse_ban", "geo_adresse"],
        "geopoint": ["_geopoint", "geo_point", "geopoint", "coordinates_ban", "coordonnees_ban"],
        "etiquette_dpe": ["etiquette_dpe", "Etiquette_DPE", "classe_consommation_energie"],
        "etiquette_ges": ["etiquette_ges", "Etiquette_GES", "classe_estimation_ges"],
        "annee_construction": ["annee_construction", "Année_construction"],
        "periode_construction": ["periode_construction"],
        "date_reception": ["date_reception", "Date_réception_DPE", "date_reception_dpe"],
        "date_etablissement": ["date_etablissement", "Date_établissement_DPE", "date_etablissement_dpe"],
        "code_insee": ["code_insee", "code_insee_ban"],
        "code_postal": ["code_postal", "code_postal_ban"],
        "commune": ["commune", "nom_commune_ban"],
    }
    parts = ["numero_voie_ban", "nom_rue_ban", "code_postal_ban", "nom_commune_ban"]
    null = F.lit(None).cast("string")
    text = lambda n: F.nullif(F.col(f"`{n}`").cast("string"), F.lit(""))
    columns = {c: F.coalesce(*(text(n) for n in own if n in feed.columns), null) for c, own in names.items()}
    columns["adresse"] = F.coalesce(columns["adresse"], F.nullif(F.concat_ws(" ", *(text(n) for n in parts if n in feed.columns)), F.lit("")))
    out = feed.select(*(c.alias(n) for n, c in columns.items()), F.lit(priority).alias("feed_priority"))
    key = N.stable_id(*(F.col(c) for c in ("feed_priority", "dpe_number", "adresse", "geopoint", "code_insee", "code_postal", "commune")))
    return out.withColumn("certificate_id", key)


def cached(certificates: DataFrame, now: Column, days: int = 30, fetched: str = "fetched_at") -> tuple[DataFrame, DataFrame]:
    """(certificates fetched within ``days``, locations whose certificates are to be fetched again); one old or undated row makes a location old."""
    old = F.coalesce(now.cast("timestamp").cast("long") - F.col(fetched).cast("timestamp").cast("long") > days * 86400, F.lit(True))
    outdated = certificates.groupBy("code_insee").agg(F.max(old).alias("old")).filter("old").select("code_insee")
    return certificates.join(outdated, "code_insee", "left_anti"), outdated


def certificate_pool(feeds: DataFrame, order: str = "certificate_id", cap: int | None = None, stop_after: int | None = None) -> DataFrame:
    """Certificates, one per number by feed priority; those without a number all stay.

    ``cap``: at most so many per location.  ``stop_after``: a feed counts only while those before it gave at most so many.  Both off by default.
    """
    numbered = first_by(feeds.filter("dpe_number IS NOT NULL"), ["dpe_number"], ["feed_priority", order])
    out = numbered.unionByName(feeds.filter("dpe_number IS NULL"))
    if stop_after is not None:
        w = Window.partitionBy("code_insee").orderBy("feed_priority").rangeBetween(Window.unboundedPreceding, -1)
        out = out.withColumn("__before", F.coalesce(F.count("*").over(w), F.lit(0))).filter(F.col("__before") <= stop_after).drop("__before")
    if cap is not None:
        w = Window.partitionBy("code_insee").orderBy("feed_priority", order)
        out = out.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= cap).drop("__rn")
    return out


def construction_year(cert: DataFrame) -> Column:
    return F.coalesce(F.col("annee_construction").try_cast("int"), F.nullif(F.regexp_extract("periode_construction", "(\\d{4})", 1), F.lit("")).try_cast("int"))


def ratio_bound(a: Column, b: Column) -> Column:
    """What the ratio cannot exceed: twice the letters that both texts have, each as often as it occurs in both, by the lengths' sum."""
    letters = F.array_distinct(F.split(a, ""))
    times = lambda text, c: F.length(text) - F.length(F.replace(text, c, F.lit("")))
    both = F.aggregate(letters, F.lit(0), lambda n, c: n + F.when(c == "", 0).otherwise(F.least(times(a, c), times(b, c))))
    return F.when(F.length(a) + F.length(b) == 0, 1.0).otherwise(2 * both / (F.length(a) + F.length(b)))


def levenshtein_similarity(a: Column, b: Column) -> Column:
    return 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))


def similar(pairs: DataFrame, a: str, b: str, measure: str, least: float) -> DataFrame:
    """``pairs`` with ``similarity`` of the texts in columns ``a`` and ``b``; those under ``least`` go.

    The ratio is reckoned once for each two texts, and only where lengths and letters allow ``least``.
    """
    if measure != "ratio":
        return pairs.withColumn("similarity", F.round(levenshtein_similarity(F.col(a), F.col(b)), 6)).filter(F.col("similarity") >= least)
    x, y = F.length(a), F.length(b)
    able = pairs.filter(2 * F.least(x, y) >= (least - 1e-6) * (x + y))
    scored = able.select(F.col(a).alias("__a"), F.col(b).alias("__b")).distinct()
    scored = scored.filter(ratio_bound(F.col("__a"), F.col("__b")) >= least - 1e-6)
    scored = scored.withColumn("similarity", F.round(ratio(F.col("__a"), F.col("__b")), 6)).filter(F.col("similarity") >= least)
    return able.join(scored, (F.col(a) == F.col("__a")) & (F.col(b) == F.col("__b"))).drop("__a", "__b")


def _optional(df: DataFrame, *names: str, kind: str = "string") -> Column:
    """The first of the columns that there are and that is not null."""
    return F.coalesce(*(F.col(n).cast("string") for n in names if n in df.columns), F.lit(None).cast("string")).try_cast(kind)


def _locations(insee: Column, postal: Column, city: Column, fallback: bool) -> Column:
    """The keys of a place: its code, and with ``fallback`` its postcode, and its name with the postcode."""
    if not fallback:
        return F.array(insee)
    blank = F.lit("")
    postal = F.nullif(postal, blank)
    keys = F.array(F.concat(F.lit("insee "), F.nullif(insee, blank)), F.concat(F.lit("post "), postal), F.concat(F.lit("city "), F.upper(F.nullif(city, blank)), F.lit(" "), postal))
    return F.array_compact(keys)


def _cells(lat: Column, lon: Column, metres: float) -> Column:
    """Array of (cy, cx): the cells within ``metres`` of a point; columns go around the globe and are one near the poles."""
    up = metres / 1000 / G.KM_PER_LAT * 1.1
    wide = up * G.KM_PER_LAT / (G.KM_PER_LON * F.greatest(F.cos(F.radians(lat)), F.lit(0.01)))
    at = lambda x: F.floor(x / CELL)
    rows, columns = F.sequence(at(lat - up), at(lat + up)), F.sequence(at(lon - wide), at(lon + wide))
    columns = F.when(F.abs(lat) > 89 + up, F.array(F.lit(-1).cast("long"))).when(F.abs(lat) > 89 - up, F.array_append(_around(columns), F.lit(-1).cast("long"))).otherwise(_around(columns))
    return F.flatten(F.transform(rows, lambda y: F.transform(columns, lambda x: F.struct(y.alias("cy"), x.alias("cx")))))


def _around(columns: Column) -> Column:
    return F.transform(columns, lambda x: F.pmod(x, F.lit(2**17)))


def link_certificates(
    sales: DataFrame, certificates: DataFrame, similarity: str = "ratio", metres: float = 20.0, least: float = 0.7, fallback: bool = False, strict: bool = True, least_loose: float = 0.85,
    most: int = HOT_ROWS,
) -> DataFrame:
    """The nearest certificate of each sale at its location: street numbers at most 2 apart, at most ``metres`` away, addresses alike.

    Sales: address_id, insee_code, address_raw, latitude, longitude.  Sales of one place (address, codes, point) are parsed and linked once, and
    certificates alike in all but their ids count once, as the first by number and id.  Places meet certificates by an equal join on (location,
    number, cell of the grid), a large city being as many keys as it has cells; keys with over ``most`` certificates are dealt in shares.
    Distance goes before text, which only a few pairs reach.  Equal distances go to the least number, then the least certificate id.
    ``fallback``: postcodes, and city names with postcodes, are locations as well.  Without
    ``strict`` pairs of which one has no number count too, from ``least_loose`` on.
    """
    none = lambda df, c: F.col(c) if c in df.columns else F.lit(None).cast("string")
    s_addr, c_addr = T.parse_address(F.col("address_raw")), T.parse_address(F.col("adresse"))
    known = ["s_locs", "s_number", "s_text", "latitude", "longitude"]
    raw = [F.col("insee_code").alias("insee"), none(sales, "postal_code").alias("postal"), none(sales, "city_name").alias("city"), F.col("address_raw"), F.col("latitude"), F.col("longitude")]
    left = sales.filter("latitude IS NOT NULL AND longitude IS NOT NULL").select("address_id", *raw)
    own = left.columns[1:]
    left = left.withColumn("place", F.md5(F.concat_ws("\x00", *(F.coalesce(F.col(c).cast("string"), F.lit("\x01")) for c in own))))
    places = left.groupBy("place", *own).agg(F.count("*").alias("__n")).select(
        "place", _locations(F.col("insee"), F.col("postal"), F.col("city"), fallback).alias("s_locs"), s_addr["number"].alias("s_number"), T.match_form(F.col("address_raw")).alias("s_text"), "latitude", "longitude"
    )
    places = places.withColumn("num", T.street_digits(F.col("s_number")))
    point = T.geopoint(F.col("geopoint"))
    right = certificates.select(
        F.col("certificate_id"), "dpe_number", _locations(F.col("code_insee"), none(certificates, "code_postal"), none(certificates, "commune"), fallback).alias("c_locs"),
        c_addr["number"].alias("c_number"), T.match_form(F.col("adresse")).alias("c_text"), point["lat"].alias("c_lat"), point["lon"].alias("c_lon"), F.col("etiquette_dpe").alias("dpe_energy_class"),
        _optional(certificates, "etiquette_ges").alias("dpe_ges_class"), _optional(certificates, "date_reception", "date_etablissement", kind="date").alias("dpe_date"), construction_year(certificates).alias("construction_year"),
    ).filter("c_lat IS NOT NULL AND c_lon IS NOT NULL")
    alike = ["c_locs", "c_number", "c_text", "c_lat", "c_lon"]
    own = [c for c in right.columns if c not in alike]
    order = [F.col("dpe_number").isNull().alias("__last"), "dpe_number", "certificate_id"]
    right = right.groupBy(*alike).agg(F.min(F.struct(*order, *(c for c in own if c not in ("dpe_number", "certificate_id")))).alias("__c"))
    right = right.select(*alike, *(F.col(f"__c.{c}").alias(c) for c in own)).withColumn("c_num", T.street_digits(F.col("c_number")))
    at = lambda df, locs: df.withColumn("loc", F.explode(locs)).filter("loc IS NOT NULL")
    here = at(places, "s_locs").withColumns({"cy": F.floor(F.col("latitude") / CELL), "cx": F.when(F.abs("latitude") > 89, -1).otherwise(F.pmod(F.floor(F.col("longitude") / CELL), F.lit(2**17)))})
    near = at(right, "c_locs").withColumn("__cell", F.explode(_cells(F.col("c_lat"), F.col("c_lon"), metres))).withColumns({"cy": F.col("__cell.cy"), "cx": F.col("__cell.cx")}).drop("__cell")

    def met(few: DataFrame, many: DataFrame, keys: list[str]) -> DataFrame:
        got = skew_join(many, few, keys, F.xxhash64("certificate_id"), most=most)
        return got.select("place", "num", *known, *(c for c in right.columns))

    numbered = near.filter("c_num IS NOT NULL").withColumn("num", F.explode(F.sequence(F.col("c_num") - 2, F.col("c_num") + 2)))
    pairs = met(here.filter("num IS NOT NULL"), numbered, ["loc", "num", "cy", "cx"])
    if not strict:
        pairs = pairs.unionByName(met(here.filter("num IS NULL"), near, ["loc", "cy", "cx"]))
        pairs = pairs.unionByName(met(here.filter("num IS NOT NULL"), near.filter("c_num IS NULL"), ["loc", "cy", "cx"]))
    pairs = pairs.withColumn("distance_m", F.round(G.haversine_km(F.col("latitude"), F.col("longitude"), F.col("c_lat"), F.col("c_lon")) * 1000, 6)).filter(F.col("distance_m") <= metres)
    if fallback:
        pairs = pairs.dropDuplicates(["place", "certificate_id", *alike])  # after the distance: a pair that meets at several locations is one
    pairs = similar(pairs, "s_text", "c_text", similarity, least)
    if not strict:
        pairs = pairs.filter((F.col("s_number").isNotNull() & F.col("c_number").isNotNull()) | (F.col("similarity") >= least_loose))
    best = first_by(pairs, ["place"], ["distance_m", F.asc_nulls_last("dpe_number"), "certificate_id"])
    points = N.match_score(F.col("similarity"), F.col("distance_m"), F.col("s_number"), F.col("c_number"), T.numbers_agree(F.col("s_number"), F.col("c_number")))
    best = best.select(
        "place", "certificate_id", "dpe_number", "dpe_date", "dpe_energy_class", "dpe_ges_class", "construction_year", "distance_m", "similarity",
        points.alias("match_points"), F.least(points, F.lit(100)).alias("match_confidence"),
    )
    linked = skew_join(left.select("place", "address_id"), best, ["place"], F.xxhash64("address_id"), most=most)
    return linked.select("address_id", *(c for c in best.columns if c != "place"))


def estimate(sales: DataFrame, as_of: Column, growth: DataFrame | None = None) -> DataFrame:
    """Sales with estimated_price, price_evolution_rate and estimation_confidence; growth is by city and type, 3 percent where unknown."""
    if growth is not None:
        sales = sales.join(growth.select("city_id", "property_type", F.col("rate").alias("__rate")), ["city_id", "property_type"], "left")
    rate = F.coalesce("__rate", F.lit(N.DEFAULT_GROWTH)) if growth is not None else F.lit(N.DEFAULT_GROWTH)
    years, cls = N.age_years(F.col("sale_date"), as_of), F.col("dpe_energy_class")
    out = sales.withColumns(
        {
            "estimated_price": N.estimated_price(F.col("price"), rate, years, cls),
            "price_evolution_rate": N.evolution_rate(rate, years),
            "estimation_confidence": N.estimate_confidence(years, cls, F.col("geocoding_score"), F.col("property_type")),
        }
    )
    return out.drop("__rate")


def estimate_stats(estimated: DataFrame) -> DataFrame:
    mean = lambda c: F.round(F.avg(c) * 100, 4)
    return estimated.agg(F.count("*").alias("n"), mean("price_evolution_rate").alias("mean_evolution"), mean("estimation_confidence").alias("mean_confidence"))


def sampled(certificates: DataFrame, seed: int, n: int = 5) -> DataFrame:
    """``n`` certificates of each location, drawn by hash, as JSON for inspection."""
    w = Window.partitionBy("code_insee").orderBy(N.stable_id(F.lit(seed), F.col("certificate_id")), "certificate_id")
    picked = certificates.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= n)
    return picked.select("code_insee", "certificate_id", F.to_json(F.struct("dpe_number", "adresse")).alias("sample"))
