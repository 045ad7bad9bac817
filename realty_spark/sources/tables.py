"""Tables kept up to date in place: Parquet by ranges of a key, of which a change rewrites those that it touches."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from realty_spark.operators.dedup import first_by
from realty_spark.sources.files import remove

#: Ranges of a table at most, and rows that their bounds are drawn from for each; the bounds only balance the ranges.
MOST_RANGES, DRAWN = 1000, 100
_RANGE, _OVERWRITE = "key_range", "spark.sql.sources.partitionOverwriteMode"


def range_of(key: Column, bounds: list) -> Column:
    """How many of the ascending bounds are at most ``key``; -1 for a null key.  Each row makes as many comparisons as the bounds' number has bits."""

    def between(a: int, z: int) -> Column:
        if a == z:
            return F.lit(a)
        mid = (a + z) // 2
        return F.when(key < F.lit(bounds[mid]), between(a, mid)).otherwise(between(mid + 1, z))

    return F.when(key.isNull(), -1).otherwise(between(0, len(bounds)))


@dataclass
class RangeTable:
    """A folder with a subfolder for each range of ``by``, which is the key itself, or a column that never changes for a key, such as its city: a
    run about a few cities touches theirs, though its keys may be hashes.

    A change reads the ranges of its keys, by partition pruning, and overwrites these alone: Spark writes them aside and moves them in when the job
    commits, so a change that fails before leaves the table as it was.  One that fails while they are moved is to be run again: changes
    are by key, so the second run gives the same rows.  Tables take one change at a time.
    """

    spark: SparkSession
    path: str
    key: str
    by: str | None = None

    @classmethod
    def create(cls, df: DataFrame, path: str, key: str, ranges: int, by: str | None = None) -> RangeTable:
        """A new table of the rows of ``df`` in about ``ranges`` ranges of equal numbers of keys, or of values of ``by``."""
        ranges, by = min(ranges, MOST_RANGES), by or key
        drawn = df.select(F.col(by).alias("k")).filter("k IS NOT NULL").distinct().orderBy(F.xxhash64("k"), "k").limit(ranges * DRAWN)
        keys = sorted(r.k for r in drawn.collect())
        bounds = sorted({keys[len(keys) * i // ranges] for i in range(1, ranges)}) if keys else []
        table = cls(df.sparkSession, path, key, by)
        stored = df.sparkSession.createDataFrame([(i, b) for i, b in enumerate(bounds)], f"i int, bound {df.schema[by].dataType.simpleString()}")
        stored.coalesce(1).write.mode("overwrite").parquet(f"{path}/_bounds")
        df.limit(0).coalesce(1).write.mode("overwrite").parquet(f"{path}/_schema")  # what a table of no rows is read by
        table._write(df.withColumn(_RANGE, range_of(F.col(by), bounds)))
        return table

    def bounds(self) -> list:
        return [r.bound for r in self.spark.read.parquet(f"{self.path}/_bounds").orderBy("i").collect()]

    def read(self, ranges: list[int] | None = None) -> DataFrame:
        """All rows, or those of some ranges."""
        schema = self.spark.read.parquet(f"{self.path}/_schema").schema.add(_RANGE, T.IntegerType())
        df = self.spark.read.schema(schema).parquet(self.path)
        return (df.filter(F.col(_RANGE).isin(ranges)) if ranges is not None else df).drop(_RANGE)

    def _write(self, df: DataFrame) -> None:
        before = self.spark.conf.get(_OVERWRITE)
        self.spark.conf.set(_OVERWRITE, "dynamic")
        try:
            df.repartition(_RANGE).write.mode("overwrite").partitionBy(_RANGE).parquet(self.path)
        finally:
            self.spark.conf.set(_OVERWRITE, before)

    def _range(self) -> Column:
        return range_of(F.col(self.by or self.key), self.bounds())

    def touched(self, keys: DataFrame) -> list[int]:
        """The ranges of some rows: as many numbers as the table has ranges at most."""
        return sorted(r[0] for r in keys.select(self._range().alias("r")).distinct().collect())

    def upsert(self, fresh: DataFrame) -> list[int]:
        """Bring the rows with the keys of ``fresh`` up to date and add those with new keys; the ranges that were rewritten.

        ``fresh``: the key, ``by`` and some columns; a null value, like a column that is not there, leaves the old one.  Of rows that repeat a key the
        first in the order of all columns counts.  Null keys equal no other: their rows are added.
        """
        ranges = self.touched(fresh)
        if not ranges:
            return []
        old = self.read(ranges)
        known = fresh.filter(F.col(self.key).isNotNull())
        known = first_by(known, [self.key], [c for c in known.columns if c != self.key] or [self.key])
        new = known.unionByName(fresh.filter(F.col(self.key).isNull())).alias("n")
        both = old.alias("o").join(new, F.col(f"o.{self.key}") == F.col(f"n.{self.key}"), "full")
        rows = both.select(*((F.coalesce(f"n.{c}", f"o.{c}") if c in fresh.columns else F.col(f"o.{c}")).alias(c) for c in old.columns))
        self._write(rows.withColumn(_RANGE, self._range()))
        return ranges

    def delete(self, keys: DataFrame) -> list[int]:
        """Remove the rows with these keys (and ``by``); the ranges that were rewritten.  Null keys remove nothing."""
        keys = keys.select(*dict.fromkeys([self.key, self.by or self.key])).filter(F.col(self.key).isNotNull()).distinct()
        ranges = self.touched(keys)
        if not ranges:
            return []
        left = self.read(ranges).join(keys, self.key, "left_anti").withColumn(_RANGE, self._range())
        filled = {r[0] for r in left.select(_RANGE).distinct().collect()}
        self._write(left)
        for r in set(ranges) - filled:  # Spark overwrites no range that gets no row
            remove(self.spark, f"{self.path}/{_RANGE}={r}")
        return ranges
