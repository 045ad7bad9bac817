"""Processing jobs: errors, retries, new jobs and clean-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from realty_spark.functions import numbers as N
from realty_spark.operators.dedup import first_by

# Parts of messages of errors that no retry mends.
PERMANENT = ["not found or inactive", "missing required", "invalid client", "no chosen cities", "no property types"]
ACTIVE = ["pending", "processing"]
MOST_ATTEMPTS = 3


def is_permanent(message: Column) -> Column:
    return F.coalesce(F.lower(message).rlike("|".join(PERMANENT)), F.lit(False))


def due_jobs(jobs: DataFrame, now: Column) -> DataFrame:
    return jobs.filter((F.col("status") == "pending") & (F.col("next_attempt") < now))


def after_attempt(jobs: DataFrame, now: Column) -> DataFrame:
    """Due jobs after another attempt with ``outcome`` (true: worked) and ``error_message``: completed, failed_permanent, or pending again in 2^attempt hours."""
    worked = F.coalesce("outcome", F.lit(False))
    over = is_permanent(F.col("error_message")) | (F.col("attempt_count") >= MOST_ATTEMPTS)
    status = F.when(worked, "completed").when(over, "failed_permanent").otherwise("pending")
    again = now + F.make_dt_interval(hours=F.pow(F.lit(2), "attempt_count").cast("int"))
    return jobs.withColumns({"status": status, "next_attempt": F.when(status == "pending", again), "last_attempt": now, "attempt_count": F.when(status == "pending", F.col("attempt_count") + 1).otherwise(F.col("attempt_count"))})


def latest_active(jobs: DataFrame) -> DataFrame:
    return first_by(jobs.filter(F.col("status").isin(ACTIVE)), ["client_id"], [F.desc("created_at"), "job_id"])


def new_jobs(clients: DataFrame, jobs: DataFrame, now: Column) -> DataFrame:
    """A pending job for each client without an active one, due in an hour."""
    busy = jobs.filter(F.col("status").isin(ACTIVE)).select("client_id").distinct()
    return clients.select("client_id").join(busy, "client_id", "left_anti").select(
        N.stable_id(F.col("client_id"), now).alias("job_id"), "client_id", F.lit("pending").alias("status"), F.lit(1).alias("attempt_count"), (now + F.expr("INTERVAL 1 HOUR")).alias("next_attempt")
    )


def with_clients(jobs: DataFrame, clients: DataFrame) -> DataFrame:
    named = clients.select("client_id", F.struct("first_name", "last_name", "email").alias("client"))
    return jobs.join(named, "client_id", "left")


def cleaned(jobs: DataFrame, as_of: Column, days: int, statuses: list[str]) -> tuple[DataFrame, DataFrame]:
    """(jobs that stay, number removed by status): those of the statuses updated over ``days`` days ago go."""
    old = F.coalesce(F.col("status").isin(statuses) & (F.col("updated_on") < F.date_sub(as_of, days)), F.lit(False))
    return jobs.filter(~old), jobs.filter(old).groupBy("status").agg(F.count("*").alias("n_removed"))


def reset_assignments(assignments: DataFrame, client_id: int) -> tuple[DataFrame, DataFrame]:
    gone = F.col("client_id").eqNullSafe(F.lit(client_id))
    return assignments.filter(~gone), assignments.filter(gone).agg(F.count("*").alias("n_removed"))
