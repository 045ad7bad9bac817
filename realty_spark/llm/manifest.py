"""Merkle manifest of a dataset: a ternary hash tree for each group of rows, and one over the groups' roots.

1. Every row becomes a leaf digest.  Leaves are dealt to ranges of (group, order); places in the ranges and the sizes of the ranges before
   give each leaf its rank, so no group is sorted by one task.
2. The base-3 digits of a rank are grouped away one after another within blocks of ``BASE ** digits`` leaves: each grouping nests three
   children into an array of structs and hashes their digests.  A block is one shuffle and one nested row.
3. The blocks' digests are ranked by their blocks and rolled up likewise until a group has one node; then the groups' roots are.
4. Paths come down: rows of (block, path) meet the nested rows by grouping, and ``transform`` and ``explode`` turn each block into the
   paths of its children, until these are leaves.  Nothing is joined with leaves or nodes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from realty_spark.llm.shared import Scratch, partitions

BASE = 3
#: Digits that are grouped away in one block: 729 leaves, about 150 KB.
DIGITS = 6


def encoded(value: Column) -> Column:
    """``-`` if null, else the number of its UTF-8 bytes, ``:`` and the value."""
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(*values: Column) -> Column:
    return F.sha2(F.concat(*map(encoded, values)), 256)


def hashed(digests: Column) -> Column:
    return F.sha2(F.array_join(digests, ""), 256)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(proof, leaf, lambda x, s: hashed(F.concat(s["left"], F.array(x), s["right"])))


def siblings(proof: Column) -> Column:
    """The siblings of a proof level by level, left to right."""
    return F.flatten(F.transform(proof, lambda s: F.concat(s["left"], s["right"])))


def ranked(rows: DataFrame, order: list[str], scratch: Scratch, name: str) -> DataFrame:
    """``rows`` with the rank in their ``tree`` by ``order``, from 0, and the tree's size n.

    Rows that are equal in the order must be equal in all: they may change places.  Those of one input partition stay together, so
    that many equal rows fill several ranges.
    """
    spark = rows.sparkSession
    ranges = rows.withColumn("dealt", F.spark_partition_id()).repartitionByRange(partitions(spark), "tree", *order, "dealt").drop("dealt")
    ranges = scratch.save(ranges.withColumn("part", F.spark_partition_id()), name)
    counts = ranges.groupBy("tree", "part").agg(F.count("*").alias("held"))
    of_tree = Window.partitionBy("tree")  # as many rows as there are ranges
    before = counts.withColumns({"n": F.sum("held").over(of_tree), "before": F.sum("held").over(of_tree.orderBy("part")) - F.col("held")})
    place = F.row_number().over(Window.partitionBy("tree", "part").orderBy(*order))
    out = ranges.withColumn("place", place).join(before.drop("held"), ["tree", "part"])
    return out.withColumn("rank", F.col("before") + F.col("place") - 1).drop("part", "place", "before")


def rolled_up(nodes: DataFrame, digits: int) -> DataFrame:
    """Blocks (tree, block, n, digest, kids) of nodes (tree, rank, n, digest, payload); n: nodes of the tree at the bottom of its blocks.

    A level is hashed while the tree has several nodes there; a lone node goes up as it is.
    """
    size = BASE**digits
    names = [f"d{k}" for k in range(digits)]
    digit = lambda k: (F.pmod(F.floor(F.col("rank") / BASE**k), F.lit(BASE))).cast("tinyint")
    rows = nodes.select("tree", F.expr(f"rank DIV {size}").alias("block"), "n", *(digit(k).alias(names[k]) for k in range(digits)), "digest", "payload")
    rows = rows.repartition(partitions(nodes.sparkSession), "tree", "block")
    for k in range(digits):
        held = F.struct(F.col(names[k]).alias("digit"), "digest", "payload" if k == 0 else "kids")
        rows = rows.groupBy("tree", "block", "n", *names[k + 1 :]).agg(F.array_sort(F.collect_list(held)).alias("kids"))
        rows = rows.withColumn("digest", F.when(F.col("n") > BASE**k, hashed(F.col("kids.digest"))).otherwise(F.col("kids")[0]["digest"]))
    return rows


def _rounds(nodes: DataFrame, digits: int, scratch: Scratch, name: str) -> list[DataFrame]:
    """Blocks round by round, each over the one before, until every tree has one."""
    out = []
    while True:
        blocks = scratch.save(rolled_up(nodes, digits), f"{name}-{len(out)}")
        out.append(blocks)
        if (blocks.agg(F.max("block")).first()[0] or 0) == 0:
            return out
        above = F.ceil(F.col("n") / BASE**digits).cast("long")
        nodes = blocks.select("tree", F.col("block").alias("rank"), above.alias("n"), "digest", F.struct("block").alias("payload"))


def _let(value: Column, use) -> Column:
    """``use`` of a value that is reckoned once."""
    return F.transform(F.array(value), use)[0]


def _below(kids: Column, path: Column, n: Column, k: int) -> Column:
    """(digest, payload, path) of the nodes ``k`` levels under ``kids``."""

    def own(kid: Column) -> Column:
        side = lambda keep: F.transform(F.filter(kids, keep), lambda x: x["digest"])
        step = F.array(F.struct(side(lambda x: x["digit"] < kid["digit"]).alias("left"), side(lambda x: x["digit"] > kid["digit"]).alias("right")))
        return F.when(n > BASE**k, F.concat(step, path)).otherwise(path)

    if k == 0:
        return F.transform(kids, lambda kid: F.struct(kid["digest"].alias("digest"), kid["payload"].alias("payload"), own(kid).alias("path")))
    return F.flatten(F.transform(kids, lambda kid: _let(own(kid), lambda path: _below(kid["kids"], path, n, k - 1))))


def _unrolled(blocks: DataFrame, paths: DataFrame, digits: int) -> DataFrame:
    """(tree, block, above, digest, payload, path) of the nodes under ``blocks``; ``paths`` (tree, block, path, above) are those of the blocks themselves."""
    first = lambda c: F.first(c, ignorenulls=True).alias(c)
    both = blocks.select("tree", "block", "n", "kids").unionByName(paths, allowMissingColumns=True)
    met = both.groupBy("tree", "block").agg(first("n"), first("kids"), first("path"), first("above"))
    found = met.select("tree", "block", "above", F.explode(_below(F.col("kids"), F.col("path"), F.col("n"), digits - 1)).alias("x"))
    return found.select("tree", "block", "above", "x.digest", "x.payload", "x.path")


_PATH = "array<struct<left: array<string>, right: array<string>>>"


def manifest(rows: DataFrame, leaf: Column, group: Column, order: Column, payload: list[Column], digits: int = DIGITS) -> DataFrame:
    """One row per row of ``rows``: the payload, leaf, subroot, root and proof.

    ``leaf``: a row's digest.  Groups come in the bytewise order of ``group``, null first; leaves of a group by ``order``, null first, then by
    digest; rows equal in all of these must be equal in the payload.  ``proof`` has an entry (left, right: arrays of siblings) for each
    level from the leaf to the root, and is empty for a lone row.  Rows that repeat are leaves of their own.  An empty table gives an
    empty result; columns that no argument names are not read.
    """
    spark, scratch = rows.sparkSession, Scratch(rows.sparkSession, "manifest")
    tree = F.when(group.isNull(), "").otherwise(F.concat(F.lit(" "), group))  # sorts as the group does, and is never null
    leaves = scratch.save(rows.select(tree.alias("tree"), order.alias("place_by"), leaf.alias("digest"), F.struct(*payload).alias("payload")), "leaves")
    leaves = ranked(leaves, ["place_by", "digest"], scratch, "ranked")
    ups = _rounds(leaves.drop("place_by"), digits, scratch, "rows")
    scratch.drop("leaves", "ranked")
    subroots = ups[-1].select(F.lit("").alias("tree"), F.col("tree").alias("place_by"), "digest", F.struct("tree").alias("payload"))
    tops = _rounds(ranked(subroots, ["place_by", "digest"], scratch, "groups").drop("place_by"), digits, scratch, "roots")
    root = tops[-1].select("digest").first()
    root = root[0] if root else None

    paths = spark.range(0 if root is None else 1).select(F.lit("").alias("tree"), F.lit(0).cast("long").alias("block"), F.lit(None).cast("string").alias("above"), F.array().cast(_PATH).alias("path"))
    for k, blocks in reversed(list(enumerate(tops))):
        under = _unrolled(blocks, paths, digits)
        if k:
            paths = under.select("tree", F.col("payload.block").alias("block"), "above", "path")
        else:
            paths = under.select("payload.tree", F.lit(0).cast("long").alias("block"), F.col("digest").alias("above"), "path")
    for k, blocks in reversed(list(enumerate(ups))):
        under = _unrolled(blocks, paths, digits)
        if k:
            paths = under.select("tree", F.col("payload.block").alias("block"), "above", "path")
    return under.select("payload.*", F.col("digest").alias("leaf"), F.col("above").alias("subroot"), F.lit(root).alias("root"), F.col("path").alias("proof"))
