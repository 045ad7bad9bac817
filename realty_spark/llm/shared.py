"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import contextlib
import contextvars
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_PREFIX = "realty-spark"
#: The list that calls within ``opened`` add their tables to.
_OPENED: contextvars.ContextVar[list[Scratch] | None] = contextvars.ContextVar("opened", default=None)
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH, _DEFAULT_BATCH, _TEXTS = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "1000"


def shared_root(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset, a temporary one in local mode and an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix=f"{_PREFIX}-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def tune(spark: SparkSession) -> None:
    """Arrow batches of 1000 rows where the session has Spark's default: rows hold whole texts, and each task and worker holds a batch."""
    if spark.conf.get(_BATCH) == _DEFAULT_BATCH:
        spark.conf.set(_BATCH, _TEXTS)


class Scratch:
    """Intermediate Parquet tables of one operator call.

    ``save`` writes a table and returns it reread, which cuts the lineage: a lost executor costs
    only the tasks it was running.  ``drop`` removes tables that nothing refers to any longer.
    """

    def __init__(self, spark: SparkSession, name: str):
        tune(spark)
        self.spark = spark
        self.root = f"{shared_root(spark)}/{_PREFIX}/{name}-{uuid.uuid4().hex}"
        opened = _OPENED.get()
        if opened is not None:
            opened.append(self)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        with_cleanup = self.spark.conf.get(_CLEANUP, "false")
        self.spark.conf.set(_CLEANUP, "true")  # the table is whole once it is written: its shuffle files can go
        try:
            df.write.mode("overwrite").parquet(self.path(name))
        finally:
            self.spark.conf.set(_CLEANUP, with_cleanup)
        return self.load(name, df.schema)

    def load(self, name: str, schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            _delete(self.spark, self.path(name))

    def close(self) -> None:
        """Remove all its tables."""
        _delete(self.spark, self.root)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@contextlib.contextmanager
def opened() -> Iterator[list[Scratch]]:
    """The tables that operators called in this block make, for whoever calls them to close once their results have been used.

    Blocks nest, and each lists its own calls alone; tables of other calls stay, as their results read them.
    """
    mine: list[Scratch] = []
    token = _OPENED.set(mine)
    try:
        yield mine
    finally:
        _OPENED.reset(token)


def fresh(name: str, columns: list[str]) -> str:
    """``name``, with underscores before it until no column is called so, in any case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
