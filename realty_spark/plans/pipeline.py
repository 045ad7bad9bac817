"""Composite pipelines: enrichment, refresh of cities, collection, assignment and the daily run."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from realty_spark.operators import assign as A
from realty_spark.operators import cities as C
from realty_spark.operators import dedup as D
from realty_spark.operators import enrich as E
from realty_spark.operators import jobs as J
from realty_spark.operators import load as L
from realty_spark.operators import normalize as N
from realty_spark.operators import reports as R
from realty_spark.sources import pages as P
from realty_spark.sources.files import shared_folder


@dataclass
class Inputs:
    """Tables that enrichment draws on; None where there is none."""

    cities: DataFrame
    certificates: DataFrame | None = None
    answers: DataFrame | None = None
    growth: DataFrame | None = None
    market: DataFrame | None = None
    loaded: DataFrame | None = None


STAGES = ["normalize", "resolve", "geocode", "certificates", "refresh", "estimate", "load"]


@dataclass
class Outcome:
    """rows: the last stage's; cities: brought up to date by stage 5; certificates, report: of stage 7; stats: stage, n_in, n_out, n_rejected."""

    rows: DataFrame
    cities: DataFrame
    certificates: DataFrame | None = None
    report: DataFrame | None = None
    stats: DataFrame | None = None


class _Counted:
    """Row counts of stages, taken while a later table is written: no stage runs for its count."""

    def __init__(self):
        self.waiting: list[tuple[str, DataFrame, Observation]] = []
        self.found: dict[str, int] = {}

    def watch(self, name: str, df: DataFrame) -> DataFrame:
        seen = Observation(f"rows of {name}")
        self.waiting.append((name, df, seen))
        return df.observe(seen, F.count(F.lit(1)).alias("n"))

    def settle(self, written: DataFrame) -> None:
        """Read the counts that the writing of ``written`` took.  A table without rows may come of a plan that Spark saw to be empty and never ran; then stages are counted."""
        ran = not written.isEmpty()
        for name, df, seen in self.waiting:
            self.found[name] = seen.get["n"] if ran else df.count()
        self.waiting = []


def enrich(
    spark: SparkSession, start_df: DataFrame, inputs: Inputs, as_of: Column, start: int = 1, end: int = 7, keep: str | None = None, similarity: str = "ratio", days: int = 365
) -> Outcome:
    """Stages ``start`` to ``end`` (1 to 7) on the output of the stage before; ``keep``: a folder for each stage's output.

    Rows are written when they are geocoded and at the end (with ``keep`` after each stage), and read back: each input is scanned once, and
    counts are taken on the way.  Without ``keep`` they lie in a new folder beside the checkpoints.
    Wrong bounds are an error, and so is a geocoding stage that nothing survives.  Stage 5 brings the cities of the sales up to date that
    were not collected within ``days``; no such city is fine.
    """
    if not 1 <= start <= end <= len(STAGES):
        raise ValueError(f"stages must be within 1 and {len(STAGES)}, got {start} to {end}")
    folder, counted, out = keep or shared_folder(spark, "enrichment"), _Counted(), Outcome(start_df, inputs.cities)
    df = counted.watch("input", start_df)
    placed = start_df
    for k in range(start, end + 1):
        name = STAGES[k - 1]
        if name == "normalize":
            df = N.normalize(df)
            df = D.new_only(df, inputs.loaded) if inputs.loaded is not None else df
        elif name == "resolve":
            df = C.resolve(df, inputs.cities.select("city_id", "name", "postal_code", "insee_code"))
        elif name == "geocode":
            df = E.geocoded(E.geocode(df, inputs.answers) if inputs.answers is not None else df)
        elif name == "certificates" and inputs.certificates is not None:
            df = df if "address_id" in df.columns else df.withColumn("address_id", F.xxhash64("address_raw", "city_id", "sale_date", "source_url"))
            found = ["dpe_number", "dpe_date", "dpe_energy_class", "dpe_ges_class", "construction_year"]
            links = E.link_certificates(df, inputs.certificates, similarity).select("address_id", F.col("match_confidence").alias("dpe_match_confidence"), *(F.col(c).alias(f"__{c}") for c in found))
            df = df.join(links, "address_id", "left")
            df = df.withColumns({c: F.coalesce(f"__{c}", *([c] if c in df.columns else [])) for c in found}).drop(*(f"__{c}" for c in found))
        elif name == "refresh" and inputs.market is not None:
            sold = placed.select(F.col("city_id").alias("__city")).distinct()  # later stages keep the sales, and so their cities
            known = inputs.cities.join(sold, F.col("city_id") == F.col("__city"), "left_semi")
            fresh = inputs.market.join(C.stale(known, as_of, days, need_insee=False).select("insee_code"), "insee_code", "left_semi")
            out.cities = C.upsert(inputs.cities, fresh)
        elif name == "estimate":
            df = df if "dpe_energy_class" in df.columns else df.withColumn("dpe_energy_class", F.lit(None).cast("string"))
            df = E.estimate(df, as_of, inputs.growth)
        elif name == "load":
            empty = df.select("source_url", F.lit("").alias("address_key")).limit(0)
            df = L.load_addresses(df, inputs.loaded if inputs.loaded is not None else empty)
        df = counted.watch(name, df)
        if keep or name == "geocode" or k == end:
            path = f"{folder}/{k}_{name}"
            df.write.mode("overwrite").parquet(path)
            df = spark.read.parquet(path)
            counted.settle(df)
            placed = df if k <= STAGES.index("geocode") + 1 or placed is start_df else placed
        if name == "geocode" and not counted.found[name]:
            raise ValueError("no sale could be geocoded")
        if name == "load":
            kinds = {"dpe_number": "string", "dpe_energy_class": "string", "dpe_ges_class": "string", "dpe_date": "date", "construction_year": "int"}
            whole = df.withColumns({c: F.lit(None).cast(kind) for c, kind in kinds.items() if c not in df.columns})
            whole = whole if "address_id" in df.columns else whole.withColumn("address_id", F.col("address_key"))
            out.certificates, out.report = L.load_certificates(whole, as_of), L.load_report(whole)
    names = STAGES[start - 1 : end]
    sizes = [counted.found["input"], *(counted.found[n] for n in names)]
    out.stats = spark.createDataFrame([(n, a, b, a - b) for n, a, b in zip(names, sizes, sizes[1:])], "stage string, n_in long, n_out long, n_rejected long")  # a row a stage
    out.rows = df
    return out


def run_enrichment(spark: SparkSession, start_df: DataFrame, inputs: Inputs, as_of: Column, start: int = 1, end: int = 7, keep: str | None = None, similarity: str = "ratio") -> DataFrame:
    """The rows of ``enrich``."""
    return enrich(spark, start_df, inputs, as_of, start, end, keep, similarity).rows


def refresh_cities(cities: DataFrame, market: DataFrame, as_of: Column, days: int = 365) -> DataFrame:
    """Stale cities brought up to date with market facts by INSEE code; fresh ones stay; ``action`` tells which."""
    old = C.stale(cities, as_of, days)
    facts = market.join(old.select("insee_code"), "insee_code", "left_semi").unionByName(market.join(cities.select("insee_code"), "insee_code", "left_anti"))
    return C.upsert(cities, facts)


def ingest_pages(pages: DataFrame, **shape) -> DataFrame:
    """Listings of pages without duplicates: by URL, then by attributes."""
    found = P.listings(pages, **shape).withColumnsRenamed({"address": "address_raw", "city": "city_name"})
    order = found.withColumn("__order", F.struct("page_id", "place"))
    url = F.nullif(F.col("property_url"), F.lit(""))
    return D.keep_first(order.withColumn("source_url", url), "__order").drop("__order")


def assign_and_report(sales: DataFrame, clients: DataFrame, assigned: DataFrame, as_of: Column, seed: int) -> DataFrame:
    return R.client_report(A.assign(sales, clients, assigned, as_of, seed, columns=R.SHOWN))


def daily_alerts(sales: DataFrame, clients: DataFrame, assigned: DataFrame, as_of: Column) -> DataFrame:
    """The clients due who get fewer sales than they ask for; nothing is drawn."""
    due = A.due(clients, as_of)
    return A.too_few(due, A.assigned_counts(sales, due, assigned, as_of))


def daily_jobs(jobs: DataFrame, as_of: Column) -> DataFrame:
    """Jobs that are due, after their retry."""
    now = as_of.cast("timestamp")
    return J.after_attempt(J.due_jobs(jobs, now), now)


def daily_run(sales: DataFrame, clients: DataFrame, assigned: DataFrame, jobs: DataFrame, as_of: Column, seed: int, columns: list[str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(assignments of the clients due, with ``columns`` of the sales or all; alerts of too few; jobs after their retry)."""
    picked = A.assign(sales, A.due(clients, as_of), assigned, as_of, seed, columns=columns)
    return picked, daily_alerts(sales, clients, assigned, as_of), daily_jobs(jobs, as_of)
