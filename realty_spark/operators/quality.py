"""Data-quality rules: each row with is_valid and the first rule that it breaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from realty_spark.functions import numbers as N

# The pattern of an e-mail address, that of a French telephone number, and the domains of coded columns.
EMAIL = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
PHONE = r"^(\+33|0)[1-9][0-9]{8}$"
SUBSCRIPTIONS = ["decouverte", "pro", "entreprise"]
STATUSES = ["active", "inactive", "suspended", "pending"]
TYPES = ["house", "apartment", "land", "commercial", "other"]


def is_postcode(c: Column) -> Column:
    return F.coalesce(c.rlike("^\\d{5}$"), F.lit(False))


def is_insee(c: Column) -> Column:
    return F.coalesce(c.rlike("^[0-9A-Z]{5}$"), F.lit(False))


def is_date(c: Column) -> Column:
    return N.strict_date(c).isNotNull()


def is_email(c: Column) -> Column:
    return F.coalesce(c.rlike(EMAIL), F.lit(False))


def is_phone(c: Column) -> Column:
    return F.coalesce(F.regexp_replace(c, "[^0-9+]", "").rlike(PHONE), F.lit(False))


def is_confidence(c: Column) -> Column:
    return F.coalesce(c.between(0, 100), F.lit(False))


def _blank(name: str) -> Column:
    return F.col(name).isNull() | (F.col(name).cast("string") == "")


def _judged(df: DataFrame, rules: list[tuple[Column, str]]) -> DataFrame:
    first = F.coalesce(*(F.when(broken, message) for broken, message in rules))
    return df.withColumns({"first_error": first, "is_valid": first.isNull()})


def check_clients(clients: DataFrame, required: tuple[str, ...] = ("first_name", "last_name", "email")) -> DataFrame:
    day, wanted = F.col("send_day").cast("string").try_cast("int"), F.col("addresses_per_report").cast("string").try_cast("int")
    given = lambda c: ~_blank(c)
    return _judged(
        clients,
        [
            *((_blank(c), f"missing {c}") for c in required),
            (~is_email(F.col("email")), "email"),
            (given("telephone") & ~is_phone(F.col("telephone")), "telephone"),
            (given("subscription_type") & ~F.col("subscription_type").isin(SUBSCRIPTIONS), "subscription_type"),
            (given("status") & ~F.col("status").isin(STATUSES), "status"),
            (F.col("send_day").isNotNull() & (day.isNull() | ~day.between(1, 31)), "send_day"),
            (F.col("addresses_per_report").isNotNull() & (wanted.isNull() | (wanted < 0)), "addresses_per_report"),
        ],
    )


def check_sales(raw: DataFrame, required: tuple[str, ...] = ("address", "city", "postal_code", "property_type", "sale_date", "price")) -> DataFrame:
    """Raw sales: required fields, a date as DD/MM/YYYY, a known type, numbers that are not negative."""
    number = lambda c: F.col(c).try_cast("double")
    wrong = lambda c: F.col(c).isNotNull() & (number(c).isNull() | (number(c) < 0))
    return _judged(
        raw,
        [
            *((_blank(c), f"missing {c}") for c in required),
            (~is_postcode(F.col("postal_code")), "postal_code"),
            (~is_date(F.col("sale_date")), "sale_date"),
            (~F.col("property_type").isin(TYPES), "property_type"),
            *((wrong(c), c) for c in ("price", "surface", "rooms")),
        ],
    )


def key_problems(parent: DataFrame, key: str, child: DataFrame, foreign: str) -> DataFrame:
    """Rows of (problem, value, n): keys of the parent that repeat, and keys of the child that no parent has."""
    twice = parent.groupBy(F.col(key).cast("string").alias("value")).agg(F.count("*").alias("n")).filter("n > 1").select(F.lit("duplicate").alias("problem"), "value", "n")
    orphan = child.join(parent.select(F.col(key).alias(foreign)).distinct(), foreign, "left_anti").groupBy(F.col(foreign).cast("string").alias("value")).agg(F.count("*").alias("n"))
    return twice.unionByName(orphan.select(F.lit("orphan").alias("problem"), "value", "n"))
