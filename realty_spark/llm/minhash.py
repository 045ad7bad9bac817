"""Near-dedup: universal-hash minima, banding, signature verification, exact confirmation, and connected
components by alternating large-star and small-star.

Documents with one and the same shingle set are one node, so copies are never paired.  Within a bucket nodes
are first paired with its least and its greatest node only.  What is then still in different components of a bucket is
compared by signature, in blocks inside tasks, with all other members; only pairs that pass leave the task.
Every pair that stays is confirmed on the full shingle sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from realty_spark.llm.shared import Scratch, partitions
from realty_spark.llm.words import U, mix, shingle_sets, slices, utf8_column

BANDS, ROWS = 32, 4
#: Nodes of a block of a large bucket, and partners of one node in a task.
BLOCK = 2048


#: Minima of the long signatures, by which the nodes of a bucket that are not yet in one component are compared.
LONG = 1024
#: Values of the functions that a worker holds at once.
HELD = 1 << 18


def hash_family(n: int, seed: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """Multiply-shift functions x -> (a * x + b) mod 2**64 >> 32 with odd a."""
    rng = np.random.default_rng(seed)
    a, b = rng.integers(0, 1 << 63, (2, n), dtype=np.uint64) * U(2) + U(1)
    return a, b


def signatures(sets: np.ndarray, at: np.ndarray, n: int, seed: int = 20) -> np.ndarray:
    """Minima of ``n`` functions over each set; of empty sets the largest value."""
    a, b = hash_family(n, seed)
    step = max(1, HELD // n)
    out = np.full((len(at) - 1, n), 0xFFFFFFFF, np.uint32)
    with np.errstate(over="ignore"):
        for i in range(len(at) - 1):
            for j in range(at[i], at[i + 1], step):
                s = sets[j : min(j + step, at[i + 1])]
                low = ((s[None, :] * a[:, None] + b[:, None]) >> U(32)).min(1).astype(np.uint32)
                np.minimum(out[i], low, out=out[i])
    return out


def band_keys(sig: np.ndarray, bands: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=np.uint64)), (len(sig), bands)).copy()
        for j in range(sig.shape[1] // bands):
            x = mix(x * U(31) + sig[:, j :: sig.shape[1] // bands].astype(np.uint64))
    return x.view(np.int64)


def set_digests(sets: np.ndarray, at: np.ndarray) -> list[bytes | None]:
    """16 bytes that stand for a set; none for the empty set."""
    with np.errstate(over="ignore"):
        a, b = (np.concatenate([[U(0)], np.cumsum(mix(sets ^ U(k)))]) for k in (0x5BF03635, 0xA2F9836E4E441529))
        n = np.diff(at)
        both = np.stack([mix((x[at[1:]] - x[at[:-1]]) * U(2) + n.astype(np.uint64)) for x in (a, b)], 1)
    return [x.tobytes() if k else None for x, k in zip(both, n)]


def _sketched(docs: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    """doc_id, text_key, n_shingles, node, keys, sig (a byte of each minimum)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 2):
                sets, at = shingle_sets(*utf8_column(batch.column(2)), k)
                sig = signatures(sets, at, bands * rows)
                keys = band_keys(sig, bands)
                yield pa.record_batch(
                    [
                        batch.column(0),
                        batch.column(1),
                        pa.array(np.diff(at), pa.int64()),
                        pa.array(set_digests(sets, at), pa.binary()),
                        pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, bands), pa.int32()), pa.array(keys.ravel())),
                        pa.array([x.tobytes() for x in (sig & 0xFF).astype(np.uint8)], pa.binary()),
                    ],
                    ["doc_id", "text_key", "n_shingles", "node", "keys", "sig"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, text_key long, n_shingles long, node binary, keys array<long>, sig binary")


def least_matches(similarity: float, n: int) -> int:
    """Equal minima that a pair of that similarity has but for 3 in a million (4.5 standard deviations)."""
    return math.floor(n * similarity - 4.5 * math.sqrt(n * similarity * (1 - similarity)))


def _alike(pairs: DataFrame, least: int, percent: int) -> DataFrame:
    """Of pairs u, v with u_sig, v_sig, u_size, v_size those that can reach the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(b.num_rows, -1) for c in (2, 3))
            p, q = b.column(4).to_numpy(), b.column(5).to_numpy()
            ok = ((x == y).sum(1) >= least) & (100 * np.minimum(p, q) >= percent * np.maximum(p, q))
            yield pa.record_batch([b.column(0).filter(pa.array(ok)), b.column(1).filter(pa.array(ok))], ["u", "v"])

    return pairs.select("u", "v", "u_sig", "v_sig", "u_size", "v_size").mapInArrow(run, "u binary, v binary")


def _confirmed(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Of pairs u, v those whose full sets reach the similarity.

    The text of v meets those of its partners in one task; a v with over ``BLOCK`` partners is copied to several.  Pairs look up those alone:
    they are at most one in ``BLOCK`` of the pairs, so that Spark seldom has to deal the pairs by v.
    """
    parts = F.ceil(F.count("*") / BLOCK).cast("int")
    shares = pairs.groupBy("v").agg(parts.alias("shares"))
    centre = shares.join(texts, F.col("v") == F.col("node")).select(
        "v", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.lit(None).cast("binary").alias("u"), "body"
    )
    around = (
        pairs.join(shares.filter("shares > 1"), "v", "left")
        .join(texts, F.col("u") == F.col("node"))
        .select("v", F.pmod(F.xxhash64("u"), F.coalesce("shares", F.lit(1))).cast("int").alias("share"), "u", "body")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, mine = None, None
        for whole in batches:
            for batch in slices(whole, 3):
                sets, at = shingle_sets(*utf8_column(batch.column(3)), k)
                found = []
                for i, (v, share, u) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)))):
                    s = sets[at[i] : at[i + 1]]
                    if u is None:
                        key, mine = (v, share), s
                    elif key == (v, share):
                        both = np.searchsorted(mine, s)
                        same = int((mine[np.minimum(both, len(mine) - 1)] == s).sum())
                        if 100 * same >= percent * (len(s) + len(mine) - same):
                            found.append((u, v))
                yield pa.record_batch([pa.array([x[j] for x in found], pa.binary()) for j in (0, 1)], ["u", "v"])

    spark = pairs.sparkSession
    return (
        centre.unionByName(around)
        .repartition(partitions(spark), "v", "share")
        .sortWithinPartitions("v", "share", F.col("u").asc_nulls_first())
        .mapInArrow(run, "u binary, v binary")
    )


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """node, root for every node of undirected edges u, v: alternating large-star and small-star until the
    edges are stars around the least node of each component.  Loops are ignored."""
    at, seen = 0, None
    edges = edges.filter("u <> v").selectExpr("greatest(u, v) AS u", "least(u, v) AS v").distinct()
    while True:
        edges = scratch.save(edges, f"{name}-{at}")
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u") % 1000003)).first()
        if at:
            scratch.drop(f"{name}-{at - 1}")
        if now == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        seen, at = now, at + 1
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(small, "u")
        edges = (
            moved.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).distinct()
        )


def _long_signatures(texts: DataFrame, k: int) -> DataFrame:
    """node, long: a byte of each of LONG minima."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1):
                sig = signatures(*shingle_sets(*utf8_column(batch.column(1)), k), LONG, 21)
                yield pa.record_batch([batch.column(0), pa.array([x.tobytes() for x in (sig & 0xFF).astype(np.uint8)], pa.binary())], ["node", "long"])

    return texts.select("node", "body").mapInArrow(run, "node binary, long binary")


def _mixed(members: DataFrame) -> DataFrame:
    """Of key, node, root those of buckets with several components, with the largest of them and the blocks to cut them into."""
    mixed = (
        members.groupBy("key", "root")
        .agg(F.count("*").alias("n"))
        .groupBy("key")
        .agg(F.max(F.struct("n", "root")).alias("top"), F.sum("n").alias("all"), F.count("*").alias("roots"))
        .filter("roots > 1")
        .select("key", F.col("top.root").alias("top"), F.ceil(F.col("all") / BLOCK).cast("int").alias("wide"), F.ceil((F.col("all") - F.col("top.n")) / BLOCK).cast("int").alias("high"))
    )
    return members.join(mixed, "key")


def _blocks(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs u, v of one bucket in different components whose long signatures are alike.

    In each bucket the nodes outside its largest component meet all nodes.  Both sides of a large bucket are cut into
    blocks, each pair of blocks going to a task of its own.  A pair that shares several buckets is told by the first of them only.
    """
    least = least_matches(percent / 100, LONG)
    own = rows.filter("root <> top").select(
        "key", F.pmod(F.xxhash64("node"), "high").cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("wide") - 1)).alias("j"), F.lit(0).alias("side"), "node", "root", "size", "long", "keys"
    )
    other = rows.select(
        "key", F.explode(F.sequence(F.lit(0), F.col("high") - 1)).alias("i"), F.pmod(F.xxhash64("node"), "wide").cast("int").alias("j"), F.lit(1).alias("side"), "node", "root", "size", "long", "keys"
    )

    def meet(key: tuple | None, left: list, right: list) -> set[tuple[bytes, bytes]]:
        found = set()
        if not left or not right:
            return found
        x, y = (np.frombuffer(b"".join(r[3] for r in side), np.uint8).reshape(len(side), -1) for side in (left, right))
        sizes, roots = np.array([r[2] for r in right]), np.array([r[1] for r in right], dtype=object)
        a, b = (np.array([r[4] for r in side], np.int64) for side in (left, right))
        for r, sig, own in zip(left, x, a):
            near = np.flatnonzero((100 * np.minimum(sizes, r[2]) >= percent * np.maximum(sizes, r[2])) & (roots != r[1]))
            near = near[(y[near] == sig).sum(1) >= least]
            both = b[near] == own
            for i in near[own[both.argmax(1)] == key[0]] if len(near) else ():  # in the first of the pair's buckets only
                found.add((max(r[0], right[i][0]), min(r[0], right[i][0])))
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, left, right, sent = None, [], [], set()

        def out(pairs: set) -> pa.RecordBatch:
            new = pairs - sent
            sent.update(new) if len(sent) < 200_000 else sent.clear()
            return pa.record_batch([pa.array([p[j] for p in new], pa.binary()) for j in (0, 1)], ["u", "v"])

        for b in batches:
            for k, i, j, side, *row in zip(*(c.to_pylist() for c in b.columns)):
                if (k, i, j) != key:
                    yield out(meet(key, left, right))
                    key, left, right = (k, i, j), [], []
                (right if side else left).append(row)
                if len(right) >= BLOCK:  # the left side of a block comes first
                    yield out(meet(key, left, right))
                    right = []
        yield out(meet(key, left, right))

    spark = rows.sparkSession
    return (
        own.unionByName(other)
        .repartition(partitions(spark), "key", "i", "j")
        .sortWithinPartitions("key", "i", "j", "side")
        .mapInArrow(run, "u binary, v binary")
        .distinct()
    )


def near_duplicates(
    docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", k: int = 5, percent: int = 75, bands: int = BANDS, rows: int = ROWS
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept, text_key (xxhash64 of the text, which tells rows of one id apart).

    Two documents are linked when 100 * |A and B| >= percent * |A or B| for their sets of distinct ``k``-word
    shingles; component_id is the least id that can be reached by links, the document's own included, and kept says
    that it is the document's own.  Texts are lower-cased in A-Z; words are runs outside ``[\\x20\\x09-\\x0D]``; fewer than k
    words are one shingle.  A null text or one without words has no shingle and no link.  Rows that repeat an id are
    documents of their own that share it; a null id is reached as null only when a component has no other, and
    is kept then.  An empty table gives an empty result; other columns are not read.

    A linked pair shares a bucket but for about 5 in a million at the least similarity (1 - s**rows) ** bands.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "minhash")
    body = F.col(text_col)
    source = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(body).alias("text_key"), body.alias("body"))
    least = least_matches(percent / 100, bands * rows)

    sketched = scratch.save(_sketched(source, k, bands, rows), "sketched")
    nodes = scratch.save(
        sketched.filter("node IS NOT NULL")
        .groupBy("node")
        .agg(
            F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("first"),
            F.first("n_shingles").alias("size"),
            F.first("keys").alias("keys"),
            F.first("sig").alias("sig"),
        ),
        "nodes",
    )
    keyed = nodes.select(F.explode("keys").alias("key"), "node")
    buckets = keyed.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo <> hi")
    members = scratch.save(keyed.join(buckets, "key"), "members")

    sig = nodes.select("node", "size", "sig")
    star = members.select("node", F.explode(F.array("lo", "hi")).alias("v")).filter("node <> v").withColumnRenamed("node", "u").distinct()
    star = star.join(sig.selectExpr("node AS u", "size AS u_size", "sig AS u_sig"), "u").join(
        sig.selectExpr("node AS v", "size AS v_size", "sig AS v_sig"), "v"
    )
    star = scratch.save(_alike(star, least, percent), "star")

    held = members.select("node").distinct().join(nodes.select("node", "first.doc_id", "first.text_key"), "node")
    texts = scratch.save(
        source.join(held.withColumnRenamed("doc_id", "id"), F.col("doc_id").eqNullSafe(F.col("id")) & (source.text_key == held.text_key)).select("node", "body"),
        "texts",
    )
    linked = scratch.save(_confirmed(star, texts, k, percent), "linked")
    first = scratch.save(components(linked, scratch, "first"), "roots-first")

    placed = members.select("key", "node").join(first, "node", "left").withColumn("root", F.coalesce("root", "node"))
    inside = scratch.save(_mixed(placed), "inside")
    long = scratch.save(_long_signatures(texts.join(inside.select("node").distinct(), "node"), k), "long")
    rest = _blocks(inside.join(nodes.select("node", "size", "keys"), "node").join(long, "node"), percent)
    done = star.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    rest = scratch.save(rest.join(done, ["u", "v"], "left_anti"), "rest")
    more = scratch.save(_confirmed(rest, texts, k, percent), "more")
    edges = more.unionByName(first.select(F.col("node").alias("u"), F.col("root").alias("v")))
    roots = scratch.save(components(edges, scratch, "last"), "roots")

    named = (
        nodes.select("node", F.col("first.doc_id").alias("least"))
        .join(roots, "node", "left")
        .withColumn("root", F.coalesce("root", "node"))
    )
    least_of = scratch.save(named.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    named = scratch.save(named.join(least_of, "root").select("node", "component_id"), "named")
    scratch.drop("nodes", "members", "star", "texts", "linked", "inside", "long", "rest", "more", "least", "roots-first", "roots")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return sketched.join(named, "node", "left").select(
        "doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "text_key"
    )
