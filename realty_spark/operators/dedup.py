"""Duplicates among sales, and sales already loaded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The columns by which sales are equal.
ATTRIBUTES = ["address_raw", "city_name", "price", "surface", "rooms", "sale_date"]


def first_by(df: DataFrame, keys: list[Column | str], order: list[Column | str]) -> DataFrame:
    """The first row of each key.  Ranked by a window, whose limit of one runs before the shuffle too."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def keep_first(df: DataFrame, order: str, url: str = "source_url", attributes: list[str] = ATTRIBUTES) -> DataFrame:
    """One row per URL, then one per attributes; rows without a URL are no duplicates of each other by URL."""
    by_url = F.coalesce(F.col(url), F.concat(F.lit("\x00"), F.col(order).cast("string")))
    return first_by(first_by(df, [by_url], [order]), attributes, [order])


def keep_best(df: DataFrame, address: str, city: str, sale_date: str, price: str, order: str) -> DataFrame:
    """One row per address in any letter case and city: the latest, then the dearest, then the first."""
    key = F.lower(F.trim(F.col(address)))
    return first_by(df, [key, city], [F.desc_nulls_last(sale_date), F.desc_nulls_last(price), order])


def new_only(df: DataFrame, loaded: DataFrame, url: str = "source_url") -> DataFrame:
    """Rows whose URL is not loaded yet; a null URL never is."""
    return df.join(loaded.select(url).distinct(), url, "left_anti")
