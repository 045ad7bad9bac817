"""Stage 7: idempotent load with a report per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from realty_spark.functions import geo as G
from realty_spark.functions import numbers as N
from realty_spark.functions import text as T
from realty_spark.operators.dedup import first_by
from realty_spark.sources.tables import RangeTable

REQUIRED = ["address_raw", "city_id", "sale_date", "property_type", "price"]


def load_addresses(sales: DataFrame, existing: DataFrame) -> DataFrame:
    """Each sale with the id it is loaded under: that of its URL where that is loaded, else one made of its natural key.

    ``action``: reused, inserted, or skipped where a required field is missing.  ``existing``: source_url, address_key.
    """
    valid = F.lit(True)
    for c in REQUIRED:
        valid = valid & F.col(c).isNotNull()
    own = N.stable_id(F.coalesce("source_url", F.concat_ws("|", "address_raw", F.col("city_id").cast("string"), F.col("sale_date").cast("string"))))
    known = first_by(existing.select("source_url", F.col("address_key").alias("__known")).filter("source_url IS NOT NULL"), ["source_url"], ["__known"])
    out = sales.join(known, "source_url", "left")
    action = F.when(~valid, "skipped").when(F.col("__known").isNotNull(), "reused").otherwise("inserted")
    return out.withColumns(
        {
            "action": action,
            "address_key": F.when(valid, F.coalesce("__known", own)),
            "department": T.department_of(*(F.col(c) if c in sales.columns else F.lit(None).cast("string") for c in ("department", "insee_code", "postal_code"))),
            "geoposition": G.geojson_point(F.col("latitude"), F.col("longitude")),
        }
    ).drop("__known")


def store(loaded: DataFrame, table: RangeTable) -> list[int]:
    """Bring a table of addresses up to date with the rows of ``load_addresses`` that are not skipped, by address_key; the ranges that were rewritten.

    Columns that the table lacks are left out; a row that is loaded again changes what it has a value for, so a second run changes nothing.
    """
    kept = set(table.read().columns)
    rows = loaded.filter("action <> 'skipped'")
    return table.upsert(rows.select(*(c for c in loaded.columns if c in kept)))


def load_certificates(loaded: DataFrame, as_of: Column) -> DataFrame:
    """Certificate rows of loaded sales with a number or class: address_key, dpe_key, dpe_number, classes, date, construction_year.

    Defaults: class N, date ``as_of``, a number made of the id, and no year outside 1800 to this year.
    """
    rows = loaded.filter(F.col("address_key").isNotNull() & (F.col("dpe_number").isNotNull() | F.col("dpe_energy_class").isNotNull()))
    number = F.coalesce("dpe_number", F.concat(F.lit("AUTO-"), F.substr("address_key", F.lit(1), F.lit(8))))
    year = F.when(F.col("construction_year").between(1800, F.year(as_of)), F.col("construction_year"))
    return rows.select(
        "address_key",
        N.stable_id(F.col("address_key"), number).alias("dpe_key"),
        number.alias("dpe_number"),
        F.coalesce("dpe_energy_class", F.lit("N")).alias("dpe_energy_class"),
        F.coalesce("dpe_ges_class", F.lit("N")).alias("dpe_ges_class"),
        F.coalesce("dpe_date", as_of).alias("dpe_date"),
        year.alias("construction_year"),
    )


def with_first_certificate(addresses: DataFrame, certificates: DataFrame, key: str = "address_key", order: str = "dpe_key") -> DataFrame:
    """Addresses with the first of their certificates as a struct ``certificate``; null where there is none."""
    first = first_by(certificates, [key], [order])
    return addresses.join(first.select(F.col(key).alias("__key"), F.struct(*(c for c in certificates.columns if c != key)).alias("certificate")), F.col(key) == F.col("__key"), "left").drop("__key")


def load_report(loaded: DataFrame) -> DataFrame:
    """address_id, address_raw, city_id, success, error, skipped, reason for each row of ``load_addresses``; an error is that of no row, as all are loaded as one table."""
    skipped = F.col("action") == "skipped"
    missing = F.concat_ws(", ", *(F.when(F.col(c).isNull(), c) for c in REQUIRED))
    return loaded.select(
        "address_id", "address_raw", "city_id", (~skipped).alias("success"), F.lit(None).cast("string").alias("error"), skipped.alias("skipped"),
        F.when(skipped, F.concat(F.lit("missing: "), missing)).alias("reason"),
    )


def success_rate(report: DataFrame) -> DataFrame:
    return report.agg(F.count("*").alias("n"), F.count_if("skipped").alias("n_skipped"), F.round(F.avg(F.col("success").cast("int")) * 100, 6).alias("success_rate"))
