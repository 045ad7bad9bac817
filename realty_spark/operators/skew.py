"""Equal joins of tables in which one key may hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys that are dealt in shares at most (they are broadcast): any other has under one in so many rows.  Rows of a key from which on it is dealt.
HOT_KEYS, HOT_ROWS = 10_000, 20_000


def hot_keys(rows: DataFrame, keys: list[str], most: int = HOT_ROWS, bound: int = HOT_KEYS) -> DataFrame:
    """The keys of over ``most`` rows with ``__shares``, the number of shares of at most so many; the ``bound`` largest ones."""
    counts = rows.groupBy(*keys).agg(F.count("*").alias("__n")).filter(F.col("__n") > most)
    return counts.orderBy(F.desc("__n"), *keys).limit(bound).select(*keys, F.ceil(F.col("__n") / most).cast("int").alias("__shares"))


def dealt(many: DataFrame, few: DataFrame, keys: list[str], by: Column, most: int = HOT_ROWS, bound: int = HOT_KEYS) -> tuple[DataFrame, DataFrame]:
    """Both tables with ``__share``: rows of ``many`` with a hot key are dealt by the hash ``by``, those of ``few`` go to each of its shares.

    Keys are measured on ``many`` and must not be null.
    """
    hot = F.broadcast(hot_keys(many, keys, most, bound))
    shares = F.coalesce("__shares", F.lit(1))
    left = many.join(hot, keys, "left").withColumn("__share", F.pmod(by, shares).cast("int")).drop("__shares")
    right = few.join(hot, keys, "left").withColumn("__share", F.explode(F.sequence(F.lit(0), shares - 1))).drop("__shares")
    return left, right


def skew_join(many: DataFrame, few: DataFrame, keys: list[str], by: Column, how: str = "inner", most: int = HOT_ROWS, bound: int = HOT_KEYS) -> DataFrame:
    """``many`` joined with ``few`` on ``keys``; no task gets more than about ``most`` rows of one of the ``bound`` largest keys."""
    left, right = dealt(many, few, keys, by, most, bound)
    return left.join(right, [*keys, "__share"], how).drop("__share")
