"""Substring dedup by content-defined chunking with a gear rolling hash.

A chunk ends where the hash of the last 32 bytes has its upper bits zero, so cuts move with the text: an insertion changes the
chunks around it and no others.  Chunks are deduplicated by a 128-bit digest; the first occurrence stays, by document id and
place.  Later ones are cut out where enough of them follow each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from realty_spark.llm.shared import Scratch, tune
from realty_spark.llm.words import slices

LEAST, BITS, MOST = 16, 5, 1024
#: Bytes of neighbouring repeated chunks from which on they are cut out.
LEAST_RUN = 96
#: A digest with over one in so many repeated chunks, and over LEAST_HOT, is frequent; there are at most so many.
HOT_SHARE, LEAST_HOT = 100_000, 64
_GEAR = np.random.default_rng(7).integers(0, 1 << 32, 256, dtype=np.uint32)


def gear(raw: np.ndarray) -> np.ndarray:
    """h[i] = (h[i-1] << 1) + G[raw[i]] modulo 2**32 at each byte, by doubling: the sum over the last 32 bytes."""
    h = _GEAR[raw]
    span = 1
    while span < 32:
        longer = h.copy()
        longer[span:] += h[:-span] << np.uint32(span)
        h, span = longer, span * 2
    return h


def cuts(raw: np.ndarray, least: int = LEAST, bits: int = BITS, most: int = MOST) -> list[int]:
    """Where the chunks of a text end; each has ``least`` to ``most`` bytes, the last one may have fewer."""
    out, start, n = [], 0, len(raw)
    for c in (np.flatnonzero(gear(raw) >> np.uint32(32 - bits) == 0) + 1).tolist():
        while c - start > most:
            start += most
            out.append(start)
        if c - start >= least:
            start = c
            out.append(c)
    while n - start > most:
        start += most
        out.append(start)
    if n > start:
        out.append(n)
    return out


def chunked(docs: DataFrame) -> DataFrame:
    """Rows of (doc_id, mark, body) as chunks: hi, lo (digest), doc_id, place (mark in the upper, number in the lower 32 bits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 2):
                which, places, digests = [], [], []
                for i, (mark, text) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                    if not text:
                        continue
                    raw = text.encode()
                    ends = cuts(np.frombuffer(raw, np.uint8))
                    digests += [xxhash.xxh3_128_digest(raw[a:b]) for a, b in zip([0, *ends], ends)]
                    places += range(mark << 32, (mark << 32) + len(ends))
                    which += [i] * len(ends)
                both = np.frombuffer(b"".join(digests), ">i8").reshape(-1, 2).astype(np.int64)
                yield pa.record_batch(
                    [pa.array(both[:, 0]), pa.array(both[:, 1]), batch.column(0).take(pa.array(which, pa.int64())), pa.array(places, pa.int64())],
                    ["hi", "lo", "doc_id", "place"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "mark", "body").mapInArrow(run, f"hi long, lo long, doc_id {kind}, place long")


def cut_out(text: str, repeated: np.ndarray, least_run: int) -> tuple[str, list[tuple[int, int]]]:
    """The text without runs of repeated chunks of ``least_run`` bytes or more, and their spans in bytes.

    A span is narrowed to whole characters.
    """
    raw = text.encode()
    ends = cuts(np.frombuffer(raw, np.uint8))
    flags, spans, a = np.zeros(len(ends), bool), [], None
    flags[repeated] = True
    for i, flag in enumerate([*flags.tolist(), False]):
        if flag and a is None:
            a = ends[i - 1] if i else 0
        elif not flag and a is not None:
            b, start, a = ends[i - 1], a, None
            while start < b and raw[start] & 0xC0 == 0x80:
                start += 1
            while b > start and b < len(raw) and raw[b] & 0xC0 == 0x80:
                b -= 1
            if b - start >= least_run:
                spans.append((start, b))
    kept = b"".join(raw[p:q] for p, q in zip([0, *(b for _, b in spans)], [*(a for a, _ in spans), len(raw)]))
    return kept.decode(), spans


def substring_dedup(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", least_run: int = LEAST_RUN) -> DataFrame:
    """``docs`` with the text deduplicated, plus n_bytes, n_removed, n_spans and spans (start, end in bytes).

    Of equal chunks the one in the smallest doc_id, then the earliest in its text, stays; a null id comes first.  Within
    a document repeats count as well.  Null texts stay null and empty ones empty.  Rows that repeat an id with the same text
    are treated as one document and get the same result; with other texts they are told apart by a hash of
    the text.  An empty table gives an empty result; all other columns are carried, and those named like the added ones are replaced.

    Chunk rows are combined before the shuffle by digest, so a passage that fills a third of all documents is a few rows
    for its owner.  Digests with a fixed share of all chunks, of which there are few, are looked up by broadcast; the others by a join, in
    which rows of frequent ones are dealt out by their own places.
    """
    tune(docs.sparkSession)
    added = ["n_bytes", "n_removed", "n_spans", "spans"]
    names = [c for c in docs.columns if c not in added]
    mark = F.pmod(F.xxhash64(F.col(text_col)), F.lit(1 << 31)).alias("mark")
    rows = docs.select(F.struct(*(c for c in names if c != text_col)).alias("row"), F.col(id_col).alias("doc_id"), mark, F.col(text_col).alias("body"))
    chunks = chunked(rows)
    scratch = Scratch(docs.sparkSession, "chunks")
    owners = chunks.groupBy("hi", "lo").agg(F.min(F.struct("doc_id", "place")).alias("first"), F.max(F.struct("doc_id", "place")).alias("last"), F.count("*").alias("n"))
    owners = scratch.save(owners.filter("NOT (first <=> last)").select("hi", "lo", "first", "n"), "owners")
    limit = max(LEAST_HOT, owners.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] // HOT_SHARE)
    hot = owners.filter(F.col("n") > limit).select("hi", "lo", F.col("first").alias("hot_first"))
    cold = owners.filter(F.col("n") <= limit).select(F.col("hi").alias("h"), F.col("lo").alias("l"), "first")
    seen = chunks.join(F.broadcast(hot), ["hi", "lo"], "left")
    own = F.when(F.col("hot_first").isNull(), F.col("hi")).otherwise(F.xxhash64("doc_id", "place"))
    seen = seen.withColumn("own", own).join(cold, (F.col("own") == F.col("h")) & (F.col("lo") == F.col("l")), "left")
    first = F.coalesce("hot_first", "first")
    repeated = (
        seen.filter(first.isNotNull() & ~F.struct("doc_id", "place").eqNullSafe(first))
        .groupBy(F.col("doc_id").alias("id"), F.shiftright("place", 32).alias("its"))
        .agg(F.collect_set(F.col("place").bitwiseAND(F.lit((1 << 32) - 1)).cast("int")).alias("numbers"))
    )

    @F.pandas_udf("text string, spans array<struct<start:int,end:int>>")
    def cleaned(texts: pd.Series, numbers: pd.Series) -> pd.DataFrame:
        got = [(t, []) if t is None or n is None else cut_out(t, np.asarray(n), least_run) for t, n in zip(texts, numbers)]
        return pd.DataFrame({"text": [g[0] for g in got], "spans": [[{"start": a, "end": b} for a, b in g[1]] for g in got]})

    cleaned = cleaned.asNondeterministic()  # else a filter on its result is pushed below it, and each text is cut twice, by two workers of a task
    joined = rows.join(repeated, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("mark") == F.col("its")), "left")
    out = joined.select("row", F.octet_length(F.coalesce("body", F.lit(""))).cast("long").alias("n_bytes"), cleaned("body", "numbers").alias("r"))
    return out.select(
        *(F.col("r.text").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in names),
        "n_bytes",
        F.aggregate("r.spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]).alias("n_removed"),
        F.size("r.spans").cast("long").alias("n_spans"),
        F.col("r.spans").alias("spans"),
    )
