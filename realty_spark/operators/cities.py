"""Stage 2: cities, their codes, and their refresh."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from realty_spark.functions import text as T
from realty_spark.operators.dedup import first_by


def city_counts(sales: DataFrame) -> DataFrame:
    return sales.groupBy("city_name").agg(F.count("*").alias("n"))


def mode_code(rows: DataFrame, key: str, code: Column, name: str) -> DataFrame:
    """The most frequent non-null code of each key, the least among equals."""
    counted = rows.select(key, code.alias(name)).filter(F.col(name).isNotNull()).groupBy(key, name).agg(F.count("*").alias("n"))
    return first_by(counted, [key], [F.desc("n"), name])


def resolve(sales: DataFrame, cities: DataFrame) -> DataFrame:
    """Sales with their city by upper-case name; of homonyms the one of least id.  Sales without a city go."""
    named = first_by(cities.withColumn("__name", F.upper("name")), ["__name"], ["city_id"])
    return sales.join(named.drop("name"), F.upper("city_name") == F.col("__name")).drop("__name")


def missing(sales: DataFrame, cities: DataFrame) -> DataFrame:
    """Names of cities that are not known."""
    return sales.select(F.upper("city_name").alias("name")).distinct().join(cities.select(F.upper("name").alias("name")), "name", "left_anti")


def from_codes(rows: DataFrame) -> DataFrame:
    """name, postal_code and insee_code modes, department: new cities out of geocoder answers."""
    out = mode_code(rows, "name", T.postcode(F.col("postal_code")), "postal_code").select("name", "postal_code")
    codes = mode_code(rows, "name", T.insee(F.col("insee_code")), "insee_code").select("name", "insee_code")
    return out.join(codes, "name", "full").withColumn("department", T.department(F.col("insee_code")))


def with_new(cities: DataFrame, found: DataFrame) -> DataFrame:
    """Known cities and those newly found by ``from_codes`` under names that are not known in any case; new ones have no city_id."""
    new = found.join(cities.select(F.upper("name").alias("__known")).distinct(), F.upper("name") == F.col("__known"), "left_anti")
    return cities.unionByName(new, allowMissingColumns=True)


def upsert(cities: DataFrame, fresh: DataFrame, key: str = "insee_code") -> DataFrame:
    """Cities with fresh values by key; a null fresh value leaves the old one.  ``action`` tells what happened."""
    old, new = cities.alias("o"), fresh.alias("n")
    both = old.join(new, F.col(f"o.{key}") == F.col(f"n.{key}"), "full")
    columns = [
        (F.coalesce(f"n.{c}", f"o.{c}") if c in fresh.columns else F.col(f"o.{c}")).alias(c) if c != "city_id" else F.coalesce("o.city_id", "n.city_id").alias(c)
        for c in cities.columns
    ]
    action = F.when(F.col(f"o.{key}").isNull(), "inserted").when(F.col(f"n.{key}").isNull(), "kept").otherwise("updated")
    return both.select(*columns, action.alias("action"))


def stale(cities: DataFrame, as_of: Column, days: int = 365, need_insee: bool = True) -> DataFrame:
    """Cities never collected, at an unreadable or too old time, or (``need_insee``) without a code."""
    when = F.try_to_timestamp(F.col("last_scraped").cast("string")).cast("date")
    old = when.isNull() | (F.datediff(as_of, when) > days)
    return cities.filter(old | F.col("insee_code").isNull() if need_insee else old)


def needs_collection(cities: DataFrame, sales: DataFrame, types: list[str], since: str, as_of: Column, fewest: int = 50, days: int = 365) -> DataFrame:
    """Stale cities with fewer than ``fewest`` sales of the wanted types since a day, and their numbers of sales."""
    wanted = sales.filter(F.col("property_type").isin(types) & F.col("sale_date").between(F.to_date(F.lit(since)), as_of))
    counts = wanted.groupBy("city_id").agg(F.count("*").alias("n_sales"))
    found = stale(cities, as_of, days, need_insee=False).join(counts, "city_id", "left").withColumn("n_sales", F.coalesce("n_sales", F.lit(0)))
    return found.filter(F.col("n_sales") < fewest)


def with_departments(cities: DataFrame, departments: DataFrame) -> DataFrame:
    """Names of department and region by the code; region code '00' where there is none.  101 rows are broadcast."""
    code = T.department(F.col("insee_code"))
    return cities.withColumn("department", code).join(F.broadcast(departments), "department", "left").withColumn("region_code", F.coalesce("region_code", F.lit("00")))


def client_cities(clients: DataFrame, cities: DataFrame) -> DataFrame:
    """Each client's chosen cities as an array of (city_id, name), by id."""
    pairs = clients.select("client_id", F.explode("chosen_cities").alias("city_id")).distinct().join(cities.select("city_id", "name"), "city_id")
    return pairs.groupBy("client_id").agg(F.array_sort(F.collect_list(F.struct("city_id", "name"))).alias("cities"))


def ranked(df: DataFrame, key: str, order: list[Column], most: int) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= most)
