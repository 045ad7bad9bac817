"""Incremental ingest: new raw files run through normalisation and an idempotent load, batch by batch."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from realty_spark.operators import dedup as D
from realty_spark.operators import normalize as N

#: The URLs that were seen are keyed state on local disks, of which each batch saves the changes alone.
_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]):
    """Settings of the session that hold within the block; a query keeps those that it was started with."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def ingest(spark: SparkSession, source: str, schema: T.StructType, target: str, checkpoint: str, form: str = "parquet", files: int | None = None) -> DataFrame:
    """Load what is new in folder ``source`` into folder ``target``, one subfolder per batch, and return all of ``target``.

    URLs that were seen are state of the stream, looked up by key: a batch reads its own files and no earlier output, so it costs the same
    however much is loaded.  A URL counts as loaded with the first of its rows that a batch has, any of them where it has several; rows without
    a URL are always new.  Within a batch rows with equal attributes are one, the first by hash.  A batch that runs again overwrites its own
    subfolder; each file is read once, as the checkpoint tells; the query ends when all are.  ``files``: of a batch at most.
    """

    def load(batch: DataFrame, number: int) -> None:
        rows = D.keep_first(batch.withColumn("__order", F.xxhash64(*batch.columns)), "__order").drop("__order")
        rows.write.mode("overwrite").parquet(f"{target}/batch={number}")

    stream = spark.readStream.schema(schema).format(form).option("header", True)
    stream = N.normalize((stream.option("maxFilesPerTrigger", files) if files else stream).load(source))
    once = stream.filter("source_url IS NOT NULL").dropDuplicates(["source_url"])
    rows = once.unionByName(stream.filter("source_url IS NULL"))
    with _settings(spark, _STATE):
        query = rows.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.parquet(target)
