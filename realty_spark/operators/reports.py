"""Reports for clients and the administration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from realty_spark.functions import text as T

# The columns of sales that reports show.
SHOWN = ["address_raw", "city_name", "price", "property_type", "surface", "rooms"]


def client_summary(rows: DataFrame) -> DataFrame:
    """Per client: number of sales, total of the prices, and the total over the number, rounded down."""
    total = F.coalesce(F.sum("price"), F.lit(0))
    return rows.groupBy("client_id").agg(F.count("*").alias("n"), total.alias("total"), F.floor(total / F.count("*")).alias("average"))


def client_overview(rows: DataFrame) -> DataFrame:
    """Per client: number, types and price range."""
    return rows.groupBy("client_id").agg(
        F.count("*").alias("total_properties"), F.array_join(F.array_sort(F.collect_set("property_type")), ",").alias("property_types"), F.min("price").alias("min_price"), F.max("price").alias("max_price")
    )


def client_top(rows: DataFrame, most: int = 3) -> DataFrame:
    """The first sales of each client by rn, with labels, and how many more there are."""
    n = F.count("*").over(Window.partitionBy("client_id"))
    out = rows.withColumn("more", F.greatest(n - most, F.lit(0))).filter(F.col("rn") <= most)
    return out.select(
        "client_id", "rn", F.concat_ws(", ", "address_raw", "city_name").alias("header"), T.price_label(F.col("price")).alias("price_label"),
        T.describe(F.col("property_type"), F.col("surface"), F.col("rooms")).alias("details"), "more",
    )


def client_report(rows: DataFrame) -> DataFrame:
    """One row per client: the summary and the first sales as an array."""
    top = client_top(rows).groupBy("client_id").agg(F.array_sort(F.collect_list(F.struct("rn", "header", "price_label", "details"))).alias("top"), F.max("more").alias("more"))
    return client_summary(rows).join(top, "client_id")


def client_page(assignments: DataFrame, sales: DataFrame, client_id: int, limit: int, offset: int) -> DataFrame:
    """A page of a client's sales, newest sending first, with the state of the assignment and the number of all."""
    own = assignments.filter(F.col("client_id") == client_id)
    page = own.join(sales, "address_id").orderBy(F.desc("send_date"), "address_id").offset(offset).limit(limit)
    return page.crossJoin(own.agg(F.count("*").alias("total")))  # one row


def sorted_page(df: DataFrame, by: str, descending: bool, tie: str, limit: int, offset: int = 0) -> DataFrame:
    return df.orderBy(F.desc_nulls_last(by) if descending else F.asc_nulls_first(by), tie).offset(offset).limit(limit)


def assignment_counts(assignments: DataFrame) -> DataFrame:
    return assignments.groupBy("client_id").agg(F.count("*").alias("n_assignments"))


def system_stats(clients: DataFrame, sales: DataFrame, assignments: DataFrame, jobs: DataFrame) -> DataFrame:
    """One row of totals; each table is read once."""
    of_jobs = [F.count_if(F.col("status") == s).alias(f"jobs_{s}") for s in ("pending", "processing", "completed", "failed")]
    parts = [
        clients.agg(F.count("*").alias("n_clients"), F.count_if(F.col("status") == "active").alias("n_active")),
        sales.agg(F.count("*").alias("n_properties")),
        assignments.agg(F.count("*").alias("n_assignments")),
        jobs.agg(*of_jobs),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)  # one row each
    return out
