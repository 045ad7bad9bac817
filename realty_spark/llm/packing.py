"""Mixture-controlled packing by deficit round-robin over source queues.

Every source is a queue of tokens.  In a round, a window of ``window`` tokens, the quantum of a queue is its share of the window by weight; what is
still owed to it, or was served ahead, is its deficit, which goes into the next round.  A queue that runs dry leaves its quantum to the others.
Deficits are kept below one token by serving token k of a queue of weight w at virtual time (k + 1/2) / w, so what each queue has been
given up to any window is a function of the queues' lengths alone: tasks place their documents without talking to each other, and
deficits run on across windows and partitions.

Within a window the queues lie one after the other, and the windows end to end are cut into sequences; the
last tokens fill sequences of powers of two, so no sequence needs padding.

The lengths of few sources are known to every task.  Those of many are known to none: their tokens are then sorted by virtual time,
which gives the same windows.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from realty_spark.llm.bpe import loaded
from realty_spark.llm.shared import Scratch, partitions
from realty_spark.llm.words import slices

LENGTH = 2048
#: Tokens of a mixture window: 64 sequences.
WINDOW = 64 * LENGTH
#: The driver and the tasks hold the lengths of so many sources; those of more are sorted by Spark, token by token, with the same result.
MAX_SOURCES = 10_000
#: Numbers of tokens that a worker's schedule remembers: boundaries times queues.
REMEMBERED = 1 << 20
STEP = 256
#: Documents of many sources meet their runs by cells of so many tokens of a source.
CELL = 64
#: Tokens whose times a task reckons at once.
TIMED = 1 << 16
_ONE = 1 << 62


class Schedule:
    """What the queues have given at each window boundary; ``lengths`` and ``weights`` are integers."""

    def __init__(self, lengths: list[int], weights: list[int], window: int = WINDOW, length: int = LENGTH):
        self.lengths, self.weights, self.window, self.length = lengths, weights, window, length
        self.total = sum(lengths)
        self.full = self.total // length * length
        self.known: dict[int, list[int]] = {}
        tail, at, self.ends, self.first = self.total - self.full, self.full, [], self.full // length
        for bit in reversed(range(length.bit_length())):
            if tail >> bit & 1:
                at += 1 << bit
                self.ends.append(at)

    def given(self, boundary: int) -> list[int]:
        """Tokens of each queue among the first ``boundary * window`` tokens served."""
        if boundary not in self.known:
            if len(self.known) * len(self.lengths) > REMEMBERED:
                self.known.clear()
            self.known[boundary] = self._given(min(boundary * self.window, self.total))
        return self.known[boundary]

    def deficits(self, boundary: int) -> list[Fraction]:
        """What is owed to each queue there: its quanta so far less what it was given; of queues that have run dry, 0.  Valid until the first runs dry."""
        given, weight = self.given(boundary), sum(self.weights)
        return [Fraction(boundary * self.window * w, weight) - g if g < n else Fraction(0) for g, w, n in zip(given, self.weights, self.lengths)]

    def _given(self, served: int) -> list[int]:
        def upto(t: int) -> list[int]:
            return [min(n, (2 * t * w + _ONE) // (2 * _ONE)) for n, w in zip(self.lengths, self.weights)]

        low, high = 0, 1 + _ONE * max((n // w + 1 for n, w in zip(self.lengths, self.weights)), default=1)
        while low + 1 < high:
            mid = (low + high) // 2
            low, high = (mid, high) if sum(upto(mid)) <= served else (low, mid)
        took = upto(low)
        for _ in range(served - sum(took)):
            s = min(
                (s for s in range(len(took)) if took[s] < self.lengths[s]),
                key=lambda s: (-(-(2 * took[s] + 1) * _ONE // (2 * self.weights[s])), (2 * took[s] + 1) * _ONE // self.weights[s], s),
            )
            took[s] += 1
        return took

    def places(self, queue: int, start: int, n: int) -> Iterator[tuple[int, int, int]]:
        """(position in the packed stream, offset in the document, length) of a document's runs."""
        low, high, done = 0, -(-self.total // self.window), 0
        while low + 1 < high:
            mid = (low + high) // 2
            low, high = (mid, high) if self.given(mid)[queue] <= start else (low, mid)
        while done < n:
            before, after = self.given(low), self.given(low + 1)
            take = min(n - done, after[queue] - start)
            if take > 0:
                at = low * self.window + sum(after[:queue]) - sum(before[:queue]) + start - before[queue]
                yield at, done, take
                done, start = done + take, start + take
            low += 1

    def pieces(self, queue: int, start: int, n: int) -> Iterator[tuple[int, int, int, int]]:
        """(sequence, offset there, offset in the document, length); no piece crosses a sequence."""
        return self.cut(self.places(queue, start, n))

    def cut(self, places: Iterable[tuple[int, int, int]]) -> Iterator[tuple[int, int, int, int]]:
        """The same for runs with known places in the packed stream."""
        for at, done, left in places:
            while left:
                if at < self.full:
                    sequence, begin, end = at // self.length, at // self.length * self.length, (at // self.length + 1) * self.length
                else:
                    i = bisect_right(self.ends, at)
                    sequence, begin, end = self.first + i, ([self.full] + self.ends)[i], self.ends[i]
                take = min(left, end - at)
                yield sequence, at - begin, done, take
                at, done, left = at + take, done + take, left - take


def tokenized(docs: DataFrame, vocabulary: str, end_id: int, text_col: str, id_col: str, source_col: str) -> DataFrame:
    """doc_id, source, part, at, n, ids: each text's ids, and where it begins among those of its source in its task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(vocabulary, False)
        width = bpe.width
        part, so_far, end = TaskContext.get().partitionId(), {}, end_id.to_bytes(width, "little")
        for batch in batches:
            for rows in slices(batch, 2, 2 << 20):
                ids = [x + end for x in bpe.encode_ids(rows.column(2).to_pylist())]
                n, at = [len(x) // width for x in ids], []
                for source, k in zip(rows.column(1).to_pylist(), n):
                    at.append(so_far.get(source, 0))
                    so_far[source] = at[-1] + k
                yield pa.record_batch(
                    [rows.column(0), rows.column(1), pa.array([part] * len(n), pa.int32()), pa.array(at, pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.binary())],
                    ["doc_id", "source", "part", "at", "n", "ids"],
                )
        bpe.forget()

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("body"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, source string, part int, at long, n long, ids binary")


def pack(
    docs: DataFrame,
    vocabulary: str,
    targets: dict[str | None, int] | Callable[[str | None], int] | None = None,
    end_id: int = 1,
    length: int = LENGTH,
    window: int = WINDOW,
    text_col: str = "text",
    id_col: str = "doc_id",
    source_col: str = "source",
) -> DataFrame:
    """One row per piece: doc_id, source, start, length, ids (little-endian uint32), doc_tokens, sequence_id, offset.

    ``targets``: a positive integer weight for each source, or a function of it; a source without one gets 1.  By default a source weighs
    its number of tokens, so that every window has the mixture of the whole.  A null source is a queue of its own.
    A null or empty text is its end id alone.  Rows that repeat an id are packed each for itself; null ids are
    carried; an empty table gives an empty result; other columns are not read.

    Texts are tokenised once, into a table in the shared folder.  The driver gets one row per source, ``MAX_SOURCES`` and one at most;
    of more sources Spark sorts a row for each token, to the same pieces.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "pack")
    ids = scratch.save(tokenized(docs, vocabulary, end_id, text_col, id_col, source_col), "ids")
    sums = ids.groupBy("source", "part").agg(F.sum("n").alias("n"))
    by_part = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = scratch.save(sums.select("source", "part", "n", F.coalesce(F.sum("n").over(by_part), F.lit(0)).alias("base")), "bases")
    sizes = bases.groupBy("source").agg(F.sum("n").alias("n"))
    weight = targets if callable(targets) else lambda s: targets.get(s, 1)
    own = bases.select(F.col("source").alias("q"), F.col("part").alias("p"), "base")
    placed = ids.join(own, F.col("source").eqNullSafe(F.col("q")) & (F.col("part") == F.col("p")))
    found = sizes.limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        total = bases.agg(F.sum("n")).first()[0]
        sizes = sizes.withColumn("weight", F.udf(weight, "long")("source") if targets else F.col("n"))
        rows = _sorted_places(scratch, placed, bases, sizes, window)
        whole = Schedule([total], [1], window, length)
        return _cut(rows, lambda n, places: whole.cut((p["at"], p["done"], p["n"]) for p in places))
    queues = sorted(((r["source"], r["n"]) for r in found), key=lambda q: (q[0] is None, q[0] or ""))
    lengths = [n for _, n in queues]
    number = {s: i for i, (s, _) in enumerate(queues)}
    schedule = Schedule(lengths, [weight(s) for s, _ in queues] if targets else lengths, window, length)
    rows = placed.select("doc_id", "source", "n", "ids", "source", (F.col("base") + F.col("at")).alias("start"))
    return _cut(rows, lambda n, own, start: schedule.pieces(number[own], start, n))


def _cut(rows: DataFrame, pieces: Callable[..., Iterator[tuple[int, int, int, int]]]) -> DataFrame:
    """The pieces of rows of doc_id, source, n, ids and whatever else ``pieces`` goes by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, STEP):
                rows = batch.slice(i, STEP)
                which, out, raws = [], [], []
                for k, (n, raw, *own) in enumerate(zip(*(rows.column(c).to_pylist() for c in range(2, rows.num_columns)))):
                    width = len(raw) // n
                    for sequence, offset, start, take in pieces(n, *own):
                        which.append(k)
                        out.append((start, take, n, sequence, offset))
                        raws.append(wide(raw[start * width : (start + take) * width], width))
                if not out:
                    continue
                numbers = [pa.array(c, pa.int64()) for c in zip(*out)]
                took = rows.take(pa.array(which))
                yield pa.record_batch(
                    [took.column(0), took.column(1), *numbers[:2], pa.array(raws, pa.binary()), *numbers[2:]],
                    ["doc_id", "source", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
                )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, source string, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def times(first: int, n: int, weight: int) -> tuple[np.ndarray, np.ndarray]:
    """What ``Schedule`` orders tokens by, for ``n`` tokens of a queue: their virtual times, times 2, as a whole number and 62 binary places, with whether the unit begins after them."""
    rest = 2 * np.arange(first, first + n, dtype=np.int64) + 1
    rest, steps = (rest, (16, 16, 16, 14)) if weight < 1 << 46 else (rest.astype(object), (62,))
    whole, rest, places = rest // weight, rest % weight, 0
    for bits in steps:
        rest = rest << bits
        places, rest = places << bits | rest // weight, rest % weight
    late = (places % 2 == 1) | (rest > 0)  # even and without a rest: it still belongs to the unit before
    return whole.astype(np.int64), (2 * places + late).astype(np.int64)


def _ranked(scratch: Scratch, rows: DataFrame, order: list[Column], keep: list[str], name: str) -> DataFrame:
    """The columns ``keep`` of rows with their rank from 0: ranges are sorted in tasks, and each adds the sizes of those before it, one row a range."""
    ranges = rows.repartitionByRange(partitions(scratch.spark), *order).sortWithinPartitions(*order)
    nth = F.monotonically_increasing_id()
    held = scratch.save(ranges.select(*keep, F.shiftright(nth, 33).alias("range"), nth.bitwiseAND((1 << 33) - 1).alias("nth")), name)
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = held.groupBy("range").agg(F.count("*").alias("size"))
    bases = sizes.select("range", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("ranked"))
    return held.join(F.broadcast(bases), "range").select(*keep, (F.col("ranked") + F.col("nth")).alias("rank"))


def _sorted_places(scratch: Scratch, placed: DataFrame, bases: DataFrame, sizes: DataFrame, window: int) -> DataFrame:
    """doc_id, source, n, ids, places (at: in the packed stream, done: in the document, n) for any number of sources.

    Tokens of all sources are ranked by their virtual times, ties by source; ``window`` ranks are a window, where the sources lie one after the other.
    """

    def timed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for queue, weight, first, n in zip(*(c.to_pylist() for c in batch.columns)):
                whole, places = times(first, n, weight)
                yield pa.record_batch([pa.array(np.full(n, queue)), pa.array(np.arange(first, first + n)), pa.array(whole), pa.array(places)], ["queue", "k", "whole", "places"])

    spark = scratch.spark
    ranked = _ranked(scratch, sizes, [F.col("source").asc_nulls_last()], ["source", "weight"], "sources")
    queues = ranked.select(F.col("source").alias("s"), "weight", F.col("rank").alias("queue"))
    same = F.col("source").eqNullSafe(F.col("s"))
    begin = F.explode(F.sequence("base", F.col("base") + F.col("n") - 1, F.lit(TIMED))).alias("first")
    parts = bases.join(queues, same).select("queue", "weight", begin, (F.col("base") + F.col("n")).alias("end"))
    parts = parts.select("queue", "weight", "first", F.least(F.lit(TIMED), F.col("end") - F.col("first")).alias("n")).repartition(partitions(spark), "queue", "first")
    tokens = parts.mapInArrow(timed, "queue long, k long, whole long, places long")
    order = _ranked(scratch, tokens, [F.col("whole"), F.col("places"), F.col("queue")], ["queue", "k"], "tokens")
    runs = order.groupBy(F.expr(f"rank DIV {window}").alias("window"), "queue").agg(F.min("k").alias("first"), F.count("*").alias("took"))
    before = Window.partitionBy("window").orderBy("queue").rowsBetween(Window.unboundedPreceding, -1)
    at = F.col("window") * window + F.coalesce(F.sum("took").over(before), F.lit(0))
    cells = lambda first, n: F.explode(F.sequence(F.floor(first / CELL), F.floor((first + n - 1) / CELL)))
    runs = runs.select("queue", "first", "took", at.alias("at")).withColumn("cell", cells(F.col("first"), F.col("took")))
    start = (F.col("base") + F.col("at")).alias("start")
    own = placed.join(queues, same).select("doc_id", "source", "queue", start, "n", "ids")
    asked = own.select("queue", "start", "n").withColumn("cell", cells(F.col("start"), F.col("n")))
    low, high = F.greatest("first", "start"), F.least(F.col("first") + F.col("took"), F.col("start") + F.col("n"))
    met = asked.join(runs, ["queue", "cell"]).filter((low < high) & (F.floor(low / CELL) == F.col("cell")))
    place = F.struct((F.col("at") + low - F.col("first")).alias("at"), (low - F.col("start")).alias("done"), (high - low).alias("n"))
    places = met.groupBy("queue", "start").agg(F.sort_array(F.collect_list(place)).alias("places"))
    return own.join(places, ["queue", "start"]).select("doc_id", "source", "n", "ids", "places")


def mixture(pieces: DataFrame, length: int = LENGTH, window: int = WINDOW) -> DataFrame:
    """window, source, tokens: how many tokens each window of packed pieces has of each source; the last may be short."""
    return pieces.groupBy(F.floor(F.col("sequence_id") / (window // length)).alias("window"), "source").agg(F.sum("length").alias("tokens"))


def wide(raw: bytes, width: int) -> bytes:
    """Ids of ``width`` bytes as 4 bytes each."""
    return raw if width == 4 else np.frombuffer(raw, "<u2").astype("<u4").tobytes()
