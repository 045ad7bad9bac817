"""Exact dedup through an extendible-hash index kept in shared files; DataFrame functions only.

1. Every text is normalised and keyed by a 64-bit hash; ids, lengths and keys go to a table.
2. The directory has ``2 ** depth`` cells, one for each prefix of a key, and doubles until no cell holds more distinct keys than a
   bucket may.  A bucket is split only while it is overfull: cells whose keys fit in one bucket point at the same one.
   The directory is a table in shared files.  Without a given capacity a bucket holds more keys where there are many, so that a
   partition owns about ``BUCKETS`` of them; a given one makes the directory as deep as the data need.
3. The texts go to the owner tasks of their buckets, which are ranges of keys.  The owner compares the bytes of texts with one key and chains those
   that differ.  A key with a fixed share of all rows is dealt in salted shares, which its owner compares again.
   The chains are written by bucket: the index.
4. Every document is looked up in the index by its bucket and key and finds its text in the chain by digest.  Keys with a fixed
   share of all rows, of which there are few, are looked up by broadcast.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from realty_spark.llm.shared import Scratch, partitions

#: The six bytes that are deleted before texts are compared.
SPACE_CLASS = "[\\x20\\x09-\\x0D]+"
#: Distinct keys of a bucket at least, and buckets for each shuffle partition at most; with more keys a bucket holds more.
CAPACITY, BUCKETS = 128, 16
#: A key with over one in so many rows, and over LEAST_HOT, is hot; there are at most so many.
HOT_SHARE, LEAST_HOT = 100_000, 16
#: Shares that a hot key is dealt in.
SHARES = 64
#: Cells of a directory that is broadcast (16 bytes each); a larger one is joined by shuffle.
SMALL_DIRECTORY = 1 << 16


def normalized(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_CLASS, "")


def cell_of(key: Column, depth: int) -> Column:
    """The first ``depth`` bits of a key."""
    return F.shiftrightunsigned(key, 64 - depth) if depth else F.lit(0).cast("long")


@dataclass
class Index:
    """directory: cell, bucket.  chains: bucket, key, hot, chain of (text_sha256, group_size, keep_id), in files by ranges of keys."""

    depth: int
    directory: DataFrame
    n_cells: int
    chains: DataFrame


def directory(keys: DataFrame, capacity: int) -> tuple[int, DataFrame]:
    """(depth, cell and bucket of every cell in use) for the distinct keys of ``keys``.

    A bucket is named by its prefix under a leading 1, so its name tells its local depth.
    """
    depth = max(0, math.ceil(math.log2(max(1, keys.count()) / capacity)))
    while True:
        cells = keys.groupBy(cell_of(F.col("key"), depth).alias("cell")).agg(F.count("*").alias("n"))
        if depth == 63 or cells.filter(F.col("n") > capacity).isEmpty():
            break
        depth += 1
    bucket = F.expr(f"CASE WHEN depth = 0 THEN 1L ELSE shiftleft(1L, depth) + shiftrightunsigned(cell, {depth} - depth) END")
    above = cells.select("cell", "n", F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("depth")).withColumn("bucket", bucket)
    fits = above.groupBy("bucket").agg(F.sum("n").alias("held")).filter(F.col("held") <= capacity)
    return depth, above.join(fits, "bucket").groupBy("cell").agg(F.min("bucket").alias("bucket"))


def bucketed(rows: DataFrame, cells: DataFrame, depth: int, n_cells: int) -> DataFrame:
    """``rows`` with the bucket of their key."""
    cells = F.broadcast(cells) if n_cells <= SMALL_DIRECTORY else cells
    return rows.withColumn("cell", cell_of(F.col("key"), depth)).join(cells, "cell").drop("cell")


def build_index(rows: DataFrame, keys: DataFrame, scratch: Scratch, capacity: int | None) -> Index:
    """The index of rows of (doc_id, points, key, norm); ``keys``: their keys with n, the number of rows."""
    depth, cells = directory(keys, capacity or max(CAPACITY, keys.count() // (BUCKETS * partitions(rows.sparkSession))))
    cells = scratch.save(cells, "directory")
    n_cells = cells.count()
    limit = max(LEAST_HOT, keys.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] // HOT_SHARE)
    hot = scratch.save(bucketed(keys.filter(F.col("n") > limit).select("key"), cells, depth, n_cells), "hot")
    marked = rows.join(F.broadcast(hot.withColumn("hot", F.lit(True))), "key", "left")
    known, other = marked.filter("hot"), marked.filter("hot IS NULL").drop("bucket")
    if n_cells <= SMALL_DIRECTORY:  # one scan: cells of all keys are at hand
        placed = bucketed(marked.drop("bucket"), cells, depth, n_cells)
    else:
        placed = known.unionByName(bucketed(other, cells, depth, n_cells))
    share = F.when(F.col("hot"), F.pmod(F.xxhash64("doc_id", "points"), F.lit(SHARES))).otherwise(F.lit(0))
    shares = (
        placed.withColumn("share", share)
        .repartition(partitions(rows.sparkSession), "bucket", "share")
        .groupBy("bucket", "share", "key", "norm")
        .agg(F.count("*").alias("n"), F.min(F.struct(-F.col("points"), "doc_id")).alias("best"), F.first("hot").alias("hot"))
        .select("bucket", "key", "hot", F.sha2("norm", 256).alias("text_sha256"), F.when(F.col("hot"), F.col("norm")).alias("norm"), "n", "best")
    )
    shares = scratch.save(shares, "shares")
    chains = (
        shares.groupBy("bucket", "key", "hot", "text_sha256", "norm")
        .agg(F.sum("n").alias("group_size"), F.min("best").alias("best"))
        .groupBy("bucket", "key", "hot")
        .agg(F.collect_list(F.struct("text_sha256", "group_size", F.col("best.doc_id").alias("keep_id"))).alias("chain"))
    )
    first = F.expr("shiftleft(bucket, 65 - length(bin(bucket)))")  # where the bucket's range begins
    chains = scratch.save(chains.repartitionByRange(partitions(rows.sparkSession), first, "bucket").sortWithinPartitions("bucket", "key"), "index")
    scratch.drop("shares", "hot")
    return Index(depth, cells, n_cells, chains)


def exact_dedup(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", capacity: int | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, bucket.

    Texts are equal when their bytes are, after every space, tab, line feed, vertical tab, form feed and
    carriage return has been deleted.  The row with the most code points in its original text stays, then
    the one with the smallest id; a null id comes before all others.  A null text counts as empty, and all
    empty texts form one group.  Rows that repeat an id are members of their own: each counts in
    group_size and all rows of the winning id and text are kept.  An empty table gives an empty result; other columns
    of the input are not read.  ``capacity``: distinct keys of a bucket.
    """
    scratch = Scratch(docs.sparkSession, "exact-dedup")
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.char_length(F.coalesce(F.col(text_col), F.lit(""))).alias("points"),
        normalized(F.col(text_col)).alias("norm"),
    ).withColumn("key", F.xxhash64("norm"))
    entries = scratch.save(rows.select("doc_id", "points", "key", F.sha2("norm", 256).alias("text_sha256")), "entries")
    keys = scratch.save(entries.groupBy("key").agg(F.count("*").alias("n")), "keys")
    index = build_index(rows, keys, scratch, capacity)
    scratch.drop("keys")

    entries = entries.select("doc_id", "key", "text_sha256")
    few = F.broadcast(index.chains.filter("hot").select("key", "bucket", "chain"))
    seen = entries.join(few, "key", "left")
    rest = bucketed(seen.filter("chain IS NULL").drop("bucket", "chain"), index.directory, index.depth, index.n_cells)
    rest = rest.join(index.chains.filter("hot IS NULL").drop("hot"), ["bucket", "key"])
    found = seen.filter("chain IS NOT NULL").unionByName(rest)
    link = F.filter("chain", lambda x: x["text_sha256"] == F.col("text_sha256"))[0]
    found = found.select("doc_id", "text_sha256", "bucket", link.alias("link"))
    return found.select(
        "doc_id", F.col("link.keep_id").alias("keep_id"), F.col("link.group_size").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.col("link.keep_id")).alias("kept"), "text_sha256", "bucket",
    )
