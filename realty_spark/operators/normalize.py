"""Stage 1: raw sales to normalised, valid sales."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from realty_spark.functions import numbers as N
from realty_spark.functions import text as T

# The two spellings of the columns of raw sales.
ALIASES = {"address": "address_raw", "city": "city_name", "property_url": "source_url"}
REQUIRED = ["address", "city", "price", "sale_date", "property_type"]


def require(df: DataFrame, columns: list[str], aliases: dict[str, str] = ALIASES) -> DataFrame:
    """Columns under their first spelling; an error where a required one is missing."""
    for name, other in aliases.items():
        if name not in df.columns and other in df.columns:
            df = df.withColumnRenamed(other, name)
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``df`` with further columns, each reckoned once for a row whatever filters stand on it.

    A filter on a plain column is pushed down together with a copy of its expression; none passes the explosion of an array of one.
    """
    made = F.explode(F.array(F.struct(*(c.alias(name) for name, c in columns.items())))).alias("__made")
    return df.select(*(c for c in df.columns if c not in columns), made).select("*", "__made.*").drop("__made")


def with_reason(raw: DataFrame) -> DataFrame:
    """Normalised sales, valid or not, with ``reason``: the first rule that a row breaks, or null.  Other columns stay."""
    df = require(raw, REQUIRED)
    for c in ("surface", "rooms", "property_url"):
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("string"))
    df = once(
        df,
        {
            "address_raw": T.clean_upper(F.col("address")),
            "city_name": T.clean_upper(F.col("city")),
            "price": N.lenient_int(F.col("price")),
            "surface": N.lenient_int(F.col("surface")),
            "rooms": N.lenient_int(F.col("rooms")),
            "sale_date": N.strict_date(F.col("sale_date")),
            "property_type": T.property_type(F.col("property_type")),
            "source_url": F.col("property_url"),
        },
    ).drop("address", "city", "property_url")
    reason = F.when(F.col("address_raw") == "", "address").when(F.col("city_name") == "", "city").when(F.col("price") <= 0, "price").when(F.col("sale_date").isNull(), "date")
    return df.withColumn("reason", reason)


def normalize(raw: DataFrame) -> DataFrame:
    return with_reason(raw).filter("reason IS NULL").drop("reason")


def stage_stats(judged: DataFrame, stage: str) -> DataFrame:
    """One row: rows in, out and rejected, and rejections by reason."""
    count = lambda c: F.count_if(c)
    return judged.agg(
        F.lit(stage).alias("stage"),
        F.count("*").alias("n_in"),
        count(F.col("reason").isNull()).alias("n_out"),
        count(F.col("reason").isNotNull()).alias("n_rejected"),
        *(count(F.col("reason") == r).alias(f"bad_{r}") for r in ("address", "city", "price", "date")),
    )
