"""Language-model scoring by prediction by partial matching over bytes.

A text is read byte by byte, A-Z lower-cased and white space as it stands, from START to STOP.  The context of a byte is that of the
ORDER bytes before it, whatever they are (``across``); without ``across`` a text is `` w1 w2 ... wn \\n`` and contexts reach back
to the last space only.  Estimation is by method D with symbol exclusion: in a context with
N occurrences of D different bytes, a byte seen n times has (2 n - 1) / 2 N and the escape to the next shorter context D / 2 N, where
bytes already offered by the longer context are left out of N and D; last comes a uniform choice among bytes never seen.

The trie is a table of (context, byte) with counts, spread over tasks by the last two bytes of the context, which keeps a
context and its suffixes down to order 2 together; orders 1 and 0 are at most 256 x 256 numbers and go to all.  A suffix with a fixed share of
the table is opened: it is spread by one byte more, again and again, and its own counts, at most 256, go to all.
Frequent words and frequent (context, byte) pairs, those with a fixed share of all training tokens or bytes and so
bounded in number, are looked up in tasks.  All other words are joined by shuffle; the other pairs of some texts go in one packed
row for each bucket of keys to the task that has the costs of that bucket.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from realty_spark.llm.shared import Scratch, partitions
from realty_spark.llm.words import mix, slices

ORDER = 6
#: Words with one in so many training tokens are held by every worker; there are at most so many.
FREQUENT_WORDS = 250_000
#: The same for (context, byte) pairs.
FREQUENT_PAIRS = 100_000
#: The same for pairs whose contexts reach over words, which are spread more evenly.
ACROSS_PAIRS = 4_000_000
#: Suffixes of contexts that are opened have one in so many pairs, or in four for each partition if these are fewer, and LEAST_OPEN at least.
MOST_OPEN, LEAST_OPEN = 4096, 1000
#: Bytes that are read at once, and pairs that a task counts before it hands them on.
PIECE, MOST_PAIRS = 1 << 20, 3 << 19
#: Blocks of 256 texts whose sums a task holds.
MOST_BLOCKS = 4096
END = b""
#: Of bytes that UTF-8 never has.
START, STOP = b"\xff" * ORDER, b"\xfe"
_SPACE, _NEWLINE = 0x20, 0x0A


def tokens(text: str | None) -> list[bytes]:
    """Words outside ``[\\x20\\x09-\\x0D]``, A-Z lower-cased."""
    return text.encode().lower().split() if text else []


def pair_keys(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(keys, number of keys of each word): for each byte of ``word + space`` the byte in the lowest 8 bits, above it up to
    ORDER bytes of context from the space before the word on.  The end (an empty word) is the one byte \\n."""
    raw = np.frombuffer(b" " + b" ".join(w or b"\n" for w in words) + b" ", np.uint8)
    place = np.arange(len(raw))
    space = np.maximum.accumulate(np.where(raw == _SPACE, place, 0))
    length = np.minimum(place[1:] - space[:-1], ORDER)
    keys = raw[1:].astype(np.int64)
    for j in range(1, min(ORDER, len(keys)) + 1):
        back = np.zeros(len(keys), np.int64)
        back[j - 1 :] = raw[: len(raw) - j]
        keys |= np.where(length >= j, back, 0) << (8 * j)
    keep = raw[:-1] != _NEWLINE
    sizes = np.fromiter((len(w) + 1 for w in words), np.int64, len(words))
    return keys[keep], sizes


def pieces(text: str | None) -> Iterator[bytes]:
    """The text from START to STOP in pieces, each with the ORDER bytes before it."""
    whole = START + (text or "").encode().lower() + STOP
    for a in range(0, len(whole) - ORDER, PIECE):
        yield whole[a : a + PIECE + ORDER]


def running_keys(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(keys, number of keys of each piece): for each byte after a piece's first ORDER the byte in the lowest 8 bits, above it the
    ORDER bytes before it."""
    raw = bytes(8 - 1 - ORDER) + b"".join(parts)
    # eight bytes from each place on, read as one big-endian number
    keys = np.ndarray((len(raw) - 7,), ">u8", raw, strides=(1,)).astype(np.int64) & ((1 << 8 * (ORDER + 1)) - 1)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    keep = np.ones(len(keys) + ORDER, bool)
    keep[((np.cumsum(sizes) - sizes)[:, None] + np.arange(ORDER)).ravel()] = False
    return keys[keep[ORDER:]], sizes - ORDER


def blocks(texts: list[str | None], across: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first, own, keys): the keys of some texts, where ``first + own`` is the number of each key's text and own < 256.
    A text may go on in the next block."""

    def read() -> tuple[int, np.ndarray, np.ndarray]:
        if across:
            keys, sizes = running_keys(held)
        else:
            keys, sizes = pair_keys([w for part in held for w in part])
            sizes = np.add.reduceat(sizes, np.cumsum([0, *map(len, held[:-1])]))
        return of[0], np.repeat(np.array(of) - of[0], sizes), keys

    of, held, size = [], [], 0
    for i, text in enumerate(texts):
        for part in pieces(text) if across else [[*tokens(text), END]]:
            n = len(part) if across else len(text or "") + 2
            if of and (size + n > PIECE or i - of[0] > 255):
                yield read()
                of, held, size = [], [], 0
            of.append(i)
            held.append(part)
            size += n
    if of:
        yield read()


class Opened:
    """Counts of the contexts that are spread over several tasks: by order, sorted (context, byte) keys with counts, and sorted contexts."""

    def __init__(self, ones: np.ndarray):
        self.ones = ones
        self.pairs: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.contexts: dict[int, np.ndarray] = {}
        self.sums: dict[int, np.ndarray] = {}  # by order: columns of totals, kinds, and counts that the order below leaves out

    def add(self, order: int, keys: np.ndarray, counts: np.ndarray) -> None:
        sort = np.argsort(keys)
        keys, counts = keys[sort], counts[sort]
        contexts, of = np.unique(keys >> 8, return_inverse=True)
        below = self.counts(order - 1, keys & ((1 << 8 * order) - 1))
        self.pairs[order], self.contexts[order] = (keys, counts), contexts
        self.sums[order] = np.stack([np.bincount(of, x, len(contexts)) for x in (counts, counts > 0, np.where(counts > 0, below, 0))])

    def counts(self, order: int, keys: np.ndarray) -> np.ndarray:
        if order == 1:
            return self.ones[keys >> 8, keys & 0xFF]
        own, counts = self.pairs[order]
        return counts[np.searchsorted(own, keys)]

    def holds(self, order: int, contexts: np.ndarray) -> np.ndarray:
        own = self.contexts.get(order, np.empty(0, np.int64))
        at = np.minimum(np.searchsorted(own, contexts), max(len(own) - 1, 0))
        return own[at] == contexts if len(own) else np.zeros(len(contexts), bool)


def code_lengths(keys: np.ndarray, counts: np.ndarray, ones: np.ndarray, across: bool = False, opened: Opened | None = None) -> np.ndarray:
    """log10 probability of each key's byte in its context.

    ``keys`` have with a context all others that share its last two bytes, or, where ``opened`` holds these, one byte more, and so on;
    ``ones[a, b]``: count of byte b after byte a, over all.
    """
    symbol, context = keys & 0xFF, keys >> 8
    length = np.full(len(keys), ORDER)
    for k in range(1, 1 if across else ORDER):
        length[context >> (8 * (k - 1)) == _SPACE] = k
    zeros = np.zeros(len(keys))
    n, total, kinds, left_out = ({} for _ in range(4))
    none = ones.sum(0)
    last = context & 0xFF
    n[0], total[0], kinds[0] = none[symbol], zeros + none.sum(), zeros + (none > 0).sum()
    n[1], total[1], kinds[1] = ones[last, symbol], ones.sum(1)[last], (ones > 0).sum(1)[last]
    left_out[0], left_out[1] = zeros, ((ones > 0) @ none)[last]
    for k in range(2, ORDER + 1):
        n[k], total[k], kinds[k], left_out[k] = (zeros.copy() for _ in range(4))
        rows = np.flatnonzero(length >= k)
        if opened and len(rows):
            own = keys[rows] & ((1 << 8 * (k + 1)) - 1)
            known = opened.holds(k, own >> 8)
            if known.any():
                own, told = own[known], rows[known]
                n[k][told] = opened.counts(k, own)
                total[k][told], kinds[k][told], left_out[k][told] = opened.sums[k][:, np.searchsorted(opened.contexts[k], own >> 8)]
                rows = rows[~known]
        if not len(rows):
            continue
        own = keys[rows] & ((1 << 8 * (k + 1)) - 1)
        pairs, one, which = np.unique(own, return_index=True, return_inverse=True)
        count = np.bincount(which, counts[rows], len(pairs))
        _, of = np.unique(pairs >> 8, return_inverse=True)
        n[k][rows] = count[which]
        total[k][rows] = np.bincount(of, count)[of][which]
        kinds[k][rows] = np.bincount(of, count > 0)[of][which]
        left_out[k][rows] = np.bincount(of, np.where(count > 0, n[k - 1][rows[one]], 0))[of][which]
    out, open_ = zeros.copy(), np.ones(len(keys), bool)
    offered, offered_kinds = zeros, zeros
    for k in range(ORDER, -1, -1):
        rest, new = total[k] - offered, kinds[k] - offered_kinds
        hit = open_ & (n[k] > 0)
        out[hit] += np.log10((2 * n[k][hit] - 1) / (2 * rest[hit]))
        open_ &= ~hit
        escape = open_ & (rest > 0)
        out[escape] += np.log10(new[escape] / (2 * rest[escape]))
        offered, offered_kinds = left_out[k], kinds[k]
    out[open_] -= np.log10(256 - kinds[0][open_])
    return out


def _counted(docs: DataFrame) -> DataFrame:
    """word, n: how often each word of (text, held_out) occurs in texts that are not held out; the end is a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 0, 8 << 20):
                learnt, others = Counter(), set()
                for text, held in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    if held:
                        others.update(tokens(text))
                    else:
                        learnt.update(tokens(text))
                        learnt[END] += 1
                others = others.difference(learnt)
                others.add(END)
                words = [*learnt, *others]
                n = np.zeros(len(words), np.int64)
                n[: len(learnt)] = list(learnt.values())
                yield pa.record_batch([pa.array(words, pa.binary()), pa.array(n)], ["word", "n"])

    return docs.select("text", "held_out").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _added(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sums of n.  Keys are sorted with the low byte of their n beside them, which is faster than sorting places; few have more."""
    large = n > 0xFF
    both = np.sort(keys.astype(np.uint64) << np.uint64(8) | (n & 0xFF).astype(np.uint64))
    own = (both >> np.uint64(8)).astype(np.int64)
    first = np.flatnonzero(np.append(True, own[1:] != own[:-1])[: len(own)])
    own, sums = own[first], np.add.reduceat((both & np.uint64(0xFF)).astype(np.int64), first) if len(first) else np.empty(0, np.int64)
    np.add.at(sums, np.searchsorted(own, keys[large]), n[large].astype(np.int64) & ~0xFF)
    return own, sums.astype(np.int32)


def _pairs(docs: DataFrame, across: bool) -> DataFrame:
    """key, n of all (context, byte) pairs of (text, held_out), with those that no training text has at 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.empty(0, np.int64), np.empty(0, np.int32)
        got, size = [none], 0

        def tables() -> Iterator[pa.RecordBatch]:
            own, n = _added(*map(np.concatenate, zip(*got)))
            for a in range(0, len(own), 1 << 17):
                yield pa.record_batch([pa.array(x[a : a + (1 << 17)].astype(np.int64)) for x in (own, n)], ["key", "n"])

        for b in (part for whole in batches for part in slices(whole, 0)):
            held = np.array(b.column(1).to_pylist(), bool)
            for first, own, keys in blocks(b.column(0).to_pylist(), across):
                learnt = ~held[first + own]
                others = np.unique(keys[~learnt])
                own, n = np.unique(keys[learnt], return_counts=True)
                got += [(own, n.astype(np.int32)), (others, np.zeros(len(others), np.int32))]
                size += len(got[-2][0]) + len(others)
                if size > 2 * MOST_PAIRS:
                    got = [_added(*map(np.concatenate, zip(*got)))]
                    size = len(got[0][0])
                    if size > MOST_PAIRS:
                        yield from tables()
                        got, size = [none], 0
        yield from tables()

    return docs.select("text", "held_out").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def _opened(pairs: DataFrame, across: bool, scratch: Scratch) -> Opened:
    """Orders 1 and 0, and the suffixes that are opened: the longer a suffix, the fewer pairs are looked at."""
    low = lambda n: F.col("key").bitwiseAND(F.lit((1 << 8 * n) - 1))
    summed = lambda df, n: df.groupBy(low(n).alias("k")).agg(F.sum("n").alias("n"), F.count("*").alias("rows"))
    by_two = scratch.save(summed(pairs, 3), "suffixes-2")  # 2 ** 24 rows at most
    ones = np.zeros((256, 256), np.int64)
    for r in by_two.groupBy(F.col("k").bitwiseAND(F.lit(0xFFFF)).alias("k")).agg(F.sum("n").alias("n")).collect():  # 65,536 at most
        ones[r["k"] >> 8, r["k"] & 0xFF] = r["n"]
    out, tables = Opened(ones), by_two
    limit = max(LEAST_OPEN, (by_two.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]) // min(4 * partitions(pairs.sparkSession), MOST_OPEN))
    for order in range(2, ORDER if across else 2):
        suffix = F.shiftright("k", 8)
        hot = [r["s"] for r in tables.groupBy(suffix.alias("s")).agg(F.sum("rows").alias("rows")).filter(F.col("rows") > limit).select("s").collect()]  # 4096 at most
        if not hot:
            break
        got = tables.filter(suffix.isin(hot)).select("k", "n").toPandas()  # 256 for each at most
        out.add(order, got["k"].to_numpy(np.int64), got["n"].to_numpy(np.int64))
        tables = scratch.save(summed(pairs.filter(F.shiftright(low(order + 1), 8).isin(hot)), order + 2), f"suffixes-{order + 1}")
    scratch.drop(*(f"suffixes-{order}" for order in range(2, ORDER + 1)))
    return out


def _costed(pairs: DataFrame, opened: Opened, across: bool) -> DataFrame:
    """key, n, cost of each pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if got:
            keys, n = (np.concatenate([b.column(c).to_numpy() for b in got]) for c in (0, 1))
            yield pa.record_batch([pa.array(keys), pa.array(n), pa.array(code_lengths(keys, n, opened.ones, across, opened))], ["key", "n", "cost"])

    context = F.shiftright("key", 8)
    last = lambda k: context.bitwiseAND(F.lit((1 << 8 * k) - 1))
    suffix = last(2)
    for order, held in sorted(opened.contexts.items()):
        suffix = F.when(last(order).isin(held.tolist()), last(order + 1) + F.lit(order << 56)).otherwise(suffix)
    return pairs.repartition(partitions(pairs.sparkSession), suffix).mapInArrow(run, "key long, n long, cost double")


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(keys.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)


def _packed(keys: np.ndarray, own: np.ndarray, times: np.ndarray) -> np.ndarray:
    """12 rows of bytes: 7 of the keys, one of ``own``, 4 of ``times``; bytes of one place side by side compress well."""
    planes = np.empty((12, len(keys)), np.uint8)
    planes[:7] = keys.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :7].T
    planes[7] = own
    planes[8:] = times.astype("<u4").view(np.uint8).reshape(-1, 4).T
    return planes


def _unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    planes = np.frombuffer(zstandard.decompress(blob), np.uint8).reshape(12, -1)
    keys, times = np.zeros((planes.shape[1], 8), np.uint8), np.empty((planes.shape[1], 4), np.uint8)
    keys[:, :7], times[:] = planes[:7].T, planes[8:].T
    return keys.view("<i8").ravel(), planes[7], times.view("<u4").ravel()


def _read(docs: DataFrame, words: dict[bytes, int], base: np.ndarray, pairs: np.ndarray, costs: np.ndarray, buckets: int, across: bool) -> DataFrame:
    """Per row of (doc_id, text, held_out): row, doc_id, held_out, n_tokens, the sums over frequent words and pairs, and the other
    words with their counts.  ``row`` numbers the rows of the table that this is written to.  Between them rows with a bucket: the
    other pairs of the 256 rows from ``row`` on that fall into it."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = (
        f"row long, doc_id {kind}, held_out boolean, n_tokens long, base double, score double, known long, words array<binary>, counts array<int>, "
        "bucket int, pairs binary"
    )
    names = [c.split()[0] for c in schema.split(", ")]

    def sums(texts: list[str | None], row: int, squeeze: zstandard.ZstdCompressor) -> tuple[np.ndarray, list[tuple[int, int, bytes]]]:
        score, rest = np.zeros(len(texts)), []
        for first, own, keys in blocks(texts, across):
            both, times = np.unique(keys.astype(np.uint64) << np.uint64(8) | own.astype(np.uint64), return_counts=True)
            own, keys = (both & np.uint64(0xFF)).astype(np.int64), (both >> np.uint64(8)).astype(np.int64)
            new = np.append(True, keys[1:] != keys[:-1])
            which, keys = np.cumsum(new) - 1, keys[new]
            hit = np.zeros(len(keys), bool)
            if len(pairs):
                at = np.minimum(np.searchsorted(pairs, keys), len(pairs) - 1)
                hit = pairs[at] == keys
                part = np.bincount(own, np.where(hit, costs[at], 0.0)[which] * times)
                score[first : first + len(part)] += part
            rare = np.flatnonzero(~hit[which])
            bucket = _bucket(keys, buckets)[which[rare]]
            order = np.argsort(bucket.astype(np.uint16) if buckets <= 1 << 16 else bucket, kind="stable")  # by digits where they fit in 16 bits
            keys, own, times = keys[which[rare]], own[rare], times[rare]
            planes = _packed(keys[order], own[order], times[order])
            ends = np.cumsum(np.bincount(bucket, minlength=buckets)).tolist()
            rest += [(k, row + first, squeeze.compress(planes[:, a:b].tobytes())) for k, (a, b) in enumerate(zip([0, *ends], ends)) if a < b]
        return score, rest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1)
        value = np.append(base, 0.0)
        row = TaskContext.get().partitionId() << 33
        for whole in batches:
            for batch in slices(whole, 1):
                bases, sizes, known, others, counts, at = [], [], [], [], [], [0]
                texts = batch.column(1).to_pylist()
                for text in texts:
                    own = tokens(text)
                    own.append(END)
                    which = np.fromiter(map(words.get, own, repeat(-1)), np.int64, len(own))
                    bases.append(value[which].sum())
                    sizes.append(len(own))
                    rest = Counter([own[i] for i in np.flatnonzero(which < 0).tolist()])
                    known.append(len(own) - rest.total())
                    others += rest.keys()
                    counts += rest.values()
                    at.append(len(others))
                score, packed = sums(texts, row, squeeze)
                offsets = pa.array(at, pa.int32())
                n = len(texts)
                yield pa.record_batch(
                    [
                        pa.array(np.arange(row, row + n)),
                        batch.column(0),
                        batch.column(2),
                        pa.array(sizes, pa.int64()),
                        pa.array(bases, pa.float64()),
                        pa.array(score),
                        pa.array(known, pa.int64()),
                        pa.ListArray.from_arrays(offsets, pa.array(others, pa.binary())),
                        pa.ListArray.from_arrays(offsets, pa.array(counts, pa.int32())),
                        pa.nulls(n, pa.int32()),
                        pa.nulls(n, pa.binary()),
                    ],
                    names,
                )
                row += n
                for i in range(0, len(packed), 1024):
                    buckets_, rows, blobs = zip(*packed[i : i + 1024])
                    nulls = [pa.nulls(len(rows), t) for t in (batch.column(0).type, pa.bool_(), pa.int64(), pa.float64(), pa.float64(), pa.int64())]
                    lists = [pa.nulls(len(rows), pa.list_(t)) for t in (pa.binary(), pa.int32())]
                    yield pa.record_batch([pa.array(rows, pa.int64()), *nulls, *lists, pa.array(buckets_, pa.int32()), pa.array(blobs, pa.binary())], names)

    return docs.select("doc_id", "text", "held_out").mapInArrow(run, schema)


def _cost_rows(costs: DataFrame, buckets: int) -> DataFrame:
    """bucket, row (-1), pairs: keys and costs of (key, cost) that fall into the bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in chain(batches, [None]):
            if b is not None:
                held.append([b.column(c).to_numpy() for c in (0, 1)])
                size += b.num_rows
            if size > 1 << 20 or b is None and size:
                keys, cost = map(np.concatenate, zip(*held))
                bucket = _bucket(keys, buckets)
                order = np.argsort(bucket, kind="stable")
                both = np.stack([keys, cost.view(np.int64)])[:, order]
                ends = np.cumsum(np.bincount(bucket, minlength=buckets)).tolist()
                got = [(k, both[:, a:b].tobytes()) for k, (a, b) in enumerate(zip([0, *ends], ends)) if a < b]
                yield pa.record_batch([pa.array([k for k, _ in got], pa.int32()), pa.array(np.full(len(got), -1)), pa.array([x for _, x in got], pa.binary())], ["bucket", "row", "pairs"])
                held, size = [], 0

    return costs.select("key", "cost").mapInArrow(run, "bucket int, row long, pairs binary")


def _pair_sums(pairs: DataFrame, costs: DataFrame, buckets: int) -> DataFrame:
    """row, more: the costs of packed pairs, added up for each row.

    A task adds up those of its buckets and hands them on as one row for each block of 256 texts, with the sums of the texts that it has seen.
    """

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, table, keys, cost = None, [], None, None
        sums: dict[int, np.ndarray] = {}

        def told() -> pa.RecordBatch:
            seen = [np.flatnonzero(x) for x in sums.values()]
            blobs = [at.astype(np.uint8).tobytes() + x[at].tobytes() for at, x in zip(seen, sums.values())]
            return pa.record_batch([pa.array(list(sums), pa.int64()), pa.array(blobs, pa.binary())], ["first", "sums"])

        for b in batches:
            for k, first, blob in zip(*(b.column(c).to_pylist() for c in range(3))):
                if k != bucket:
                    bucket, table, keys = k, [], None
                if first < 0:
                    table.append(np.frombuffer(blob, np.int64).reshape(2, -1))
                    continue
                if keys is None:
                    keys, cost = np.concatenate(table, 1)
                    order = np.argsort(keys)
                    keys, cost = keys[order], cost[order].view(np.float64)
                    table = []
                own_keys, own, times = _unpacked(blob)
                if first not in sums and len(sums) >= MOST_BLOCKS:
                    yield told()
                    sums.clear()
                held = sums.setdefault(first, np.zeros(256))
                held += np.bincount(own, cost[np.searchsorted(keys, own_keys)] * times, 256)
        yield told()

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, np.zeros(256)

        def told() -> pa.RecordBatch:
            at = np.flatnonzero(held)
            return pa.record_batch([pa.array(last + at), pa.array(held[at])], ["row", "more"])

        for b in batches:
            for first, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if first != last:
                    if last is not None:
                        yield told()
                    last, held = first, np.zeros(256)
                n = len(blob) // 9
                held[np.frombuffer(blob, np.uint8, n)] += np.frombuffer(blob, np.float64, n, n)
        if last is not None:
            yield told()

    spark = pairs.sparkSession
    both = _cost_rows(costs, buckets).unionByName(pairs.select("bucket", "row", "pairs"))
    found = both.repartition(partitions(spark), "bucket").sortWithinPartitions("bucket", "row").mapInArrow(look_up, "first long, sums binary")
    return found.repartition(partitions(spark), "first").sortWithinPartitions("first").mapInArrow(add_up, "row long, more double")


def score_texts(docs: DataFrame, held_out: Column, text_col: str = "text", id_col: str = "doc_id", across: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    ``held_out``: a condition on the columns of ``docs``; rows for which it is true are scored and not learnt from (null: false).
    score: log10 probability of the whole text; with ``across`` of all its bytes, white space included, by contexts that reach over
    words, else of its words, each by itself.  base_score: the sum over tokens of log10((c + 1) / (N + V + 1)).  A null
    or empty text is its end alone.  Null and repeated ids are carried and repeated rows count each; with nothing to learn from all
    bytes are equally likely; an empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "ppm")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    words = scratch.save(_counted(rows), "words")
    total, kinds = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") > 0)).first()

    pairs = scratch.save(_pairs(rows, across), "pairs")
    opened = _opened(pairs, across, scratch)
    ones = opened.ones
    costs = scratch.save(_costed(pairs, opened, across), "costs")
    scratch.drop("pairs")
    often = F.col("n") > int(ones.sum()) // (ACROSS_PAIRS if across else FREQUENT_PAIRS)
    hot = costs.filter(often).select("key", "cost").toArrow().sort_by("key")
    buckets = 4 * partitions(spark)

    base = F.log10((F.col("n") + 1) / F.lit(float(total + kinds + 1)))
    frequent = words.filter(F.col("n") > total // FREQUENT_WORDS).select("word", base.alias("base")).toPandas()
    number = {bytes(w): i for i, w in enumerate(frequent["word"])}
    read = scratch.save(
        _read(rows, number, frequent["base"].to_numpy(np.float64), hot["key"].to_numpy(), hot["cost"].to_numpy(), buckets, across),
        "read",
    )
    texts = read.filter("bucket IS NULL")
    zero = F.lit(0)
    rare = texts.select("row", F.explode(F.arrays_zip("words", "counts")).alias("w")).select("row", F.col("w.words").alias("word"), F.col("w.counts").alias("times"))
    of_words = (
        rare.join(words.hint("shuffle_hash"), "word")  # a task holds its share of the words, each once, rather than sorting their occurrences
        .groupBy("row")
        .agg(F.sum(F.col("times") * base).alias("more_base"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("more_known"))
        .withColumn("more", F.lit(0.0))
    )
    of_words = scratch.save(of_words, "word-sums")
    of_pairs = _pair_sums(read.filter("bucket IS NOT NULL"), costs.filter(~often), buckets)
    of_pairs = of_pairs.select("row", F.lit(0.0).alias("more_base"), zero.cast("long").alias("more_known"), "more")
    sums = of_words.unionByName(of_pairs).groupBy(F.col("row").alias("r")).agg(*(F.sum(c).alias(c) for c in ("more_base", "more_known", "more")))
    return texts.join(sums, F.col("row") == F.col("r"), "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("more_known", zero)).alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", zero)).alias("base_score"),
        (F.col("score") + F.coalesce("more", zero)).alias("score"),
    )
