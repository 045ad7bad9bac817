"""Numbers, dates, prices and scores as column expressions.  ``as_of`` is always given, never the clock."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Price adjustment by energy class.
ENERGY_FACTORS = {"A": 0.05, "B": 0.03, "C": 0.01, "D": 0.0, "E": -0.02, "F": -0.05, "G": -0.08}
DEFAULT_GROWTH, MOST_GROWTH = 0.03, 0.10


def nullable_int(raw: Column) -> Column:
    """Truncated toward zero; null where there is no finite number in range."""
    x = raw.cast("string").try_cast("double")
    return F.when(F.abs(x) < 2147483648.0, F.when(x >= 0, F.floor(x)).otherwise(F.ceil(x))).cast("int")


def lenient_int(raw: Column) -> Column:
    return F.coalesce(nullable_int(raw), F.lit(0))


def strict_date(raw: Column) -> Column:
    """DD/MM/YYYY, single digits allowed, else null."""
    text = F.trim(raw)
    return F.when(text.rlike("^\\d{1,2}/\\d{1,2}/\\d{4}$"), F.try_to_date(text, "d/M/yyyy"))


def epoch_date(millis: Column) -> Column:
    return F.to_date(F.timestamp_millis(millis.try_cast("bigint")))


def age_years(sale_date: Column, as_of: Column) -> Column:
    return F.datediff(as_of, F.coalesce(sale_date, as_of)) / 365.25


def energy_factor(energy_class: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in ENERGY_FACTORS.items() for x in pair))
    return F.coalesce(F.try_element_at(table, energy_class), F.lit(0.0))


def total_growth(rate: Column, years: Column) -> Column:
    """Compound growth, held between plus and minus 10 percent a year."""
    grown = lambda r: F.pow(1 + r, years) - 1
    return F.least(F.greatest(grown(rate), grown(F.lit(-MOST_GROWTH))), grown(F.lit(MOST_GROWTH)))


def estimated_price(price: Column, rate: Column, years: Column, energy_class: Column) -> Column:
    """Sales under half a year keep their price; others grow, are adjusted by class and rounded half-even to thousands."""
    value = price * (1 + total_growth(rate, years)) * (1 + energy_factor(energy_class))
    return F.when(years < 0.5, price.cast("long")).otherwise((F.bround(value / 1000) * 1000).cast("long"))


def evolution_rate(rate: Column, years: Column) -> Column:
    return F.when(years < 0.5, F.lit(0.0)).otherwise(total_growth(rate, years))


def estimate_confidence(years: Column, energy_class: Column, geo_score: Column, kind: Column) -> Column:
    score = F.lit(0.8) - F.least(years * 0.05, F.lit(0.6))
    score += F.when(energy_factor(energy_class) != 0, 0.05).otherwise(0.0)
    score += F.when(geo_score > 0.8, 0.05).otherwise(0.0) + F.when(kind.isNotNull(), 0.05).otherwise(0.0)
    return F.when(years < 0.5, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))


def match_score(similarity: Column, metres: Column, number: Column, other: Column, agree: Column) -> Column:
    """Points of a certificate match without a ceiling; ``least(…, 100)`` is its confidence."""
    text = F.least((similarity * 25).cast("int"), F.lit(25))
    near = F.when(metres < 5, 40).when(metres < 10, 35).when(metres < 15, 25).when(metres < 20, 15).otherwise(0)
    street = F.when(number == other, 25).when(agree, 15).otherwise(0)
    return F.lit(70) + text + near + street


def stable_id(*key: Column) -> Column:
    """The same natural key gives the same id on each run."""
    return F.md5(F.concat_ws("|", *(k.cast("string") for k in key)))


def uniform(*key: Column) -> Column:
    """A number in (0, 1) that depends on the key alone."""
    return (F.conv(F.substr(stable_id(*key), F.lit(1), F.lit(8)), 16, 10).cast("double") + 0.5) / 4294967296.0


def price_per_m2(price: Column, surface: Column) -> Column:
    return price / F.nullif(surface, F.lit(0))
