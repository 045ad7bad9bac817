"""Suffix-array dedup: bytes covered by a 100-byte string that also starts earlier are cut out.

1. Anchors: in every window of ``LENGTH`` bytes the 32-byte gram of least hash is chosen, so equal windows have equal grams
   at the same place.  Only grams that occur twice are followed up.
2. Around an anchor lies all that a window with it can hold: 68 bytes before it and 100 from it on.  Anchors with the same surroundings
   (by 128 bits of digests) are combined before they are shuffled; all but the first are repeats throughout.
3. Where a gram has different surroundings, their first occurrences are compared byte by byte.  A window that reaches over the anchor by l bytes to the left
   holds one of two strings of 66 bytes, for l <= 34 or l >= 34, so only surroundings that share one of these go on, in a group each.  In a group what lies to the right and what
   lies to the left, read backwards, are texts of blocks; all texts of a task are one text whose suffix array is built by linear grouping (below).
   In its order neighbours of a group are compared byte by byte, which tells for every length which of the group agree so far to the right, and likewise
   to the left: a window is a repeat if an earlier member of its group agrees on both sides.
4. A gram with over ``MOST`` different surroundings is split: its windows are dealt by narrower ranges of l, each with a longer string that its windows
   share, and go through steps 2 and 3 by that string.

Linear grouping (Baier 2016): suffixes are grouped by a prefix, first their first symbol.  Groups are taken in descending order.  For each suffix
of the group the nearest suffix to its left in a lower group, its previous-smaller pointer, has its prefix followed by that of the group; such suffixes
move to the upper end of their own group, those with more repetitions higher.  The groups are then those of the Lyndon prefixes, and one
ascending pass emits the order within them: from each suffix placed, the one before it and its chain of pointers are next in their groups.  No suffix is ever renamed or sorted again.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from realty_spark.llm.shared import Scratch, partitions
from realty_spark.llm.words import U, mix, slices, utf8_column, word_hashes

LENGTH, GRAM = 100, 32
_REACH = LENGTH - GRAM
#: Ranges (least, most) of the number of bytes that a window has to the left of its anchor: all, the two that are told apart
#: within a task, and those that very frequent grams are split by.
WHOLE = [(0, _REACH)]
HALVES = [(0, _REACH // 2), (_REACH // 2, _REACH)]
NARROW = [(a, min(a + 4, _REACH)) for a in range(0, _REACH + 1, 5)]
#: Bytes of a symbol of the text that is sorted.
SYMBOL = 17
#: Surroundings that are read before a text of theirs is sorted, and different ones of a gram from which on it is split.
BATCH, MOST = 24_000, 20_000
#: Bytes of texts in which anchors are looked for at a time.
PIECE = 1 << 18


def linear_grouping(text: list[int]) -> list[int]:
    """The suffix array of symbols >= 1, the end (a symbol 0 that is added) included, which comes first."""
    s = [*text, 0]
    n = len(s)
    kinds = Counter(s)
    start, size, at = {}, {}, 0  # of each group by its first rank
    for c in sorted(kinds):
        start[c], size[at] = at, kinds[c]
        at += kinds[c]
    free = dict(start)
    group, place, order = [0] * n, [0] * n, [0] * n
    for i, c in enumerate(s):
        group[i], place[i] = start[c], free[c]
        order[free[c]] = i
        free[c] += 1
    prev = [-1] * n
    end = n
    while end > 0:
        first = group[order[end - 1]]
        members = order[first:end]
        members.sort()
        times: dict[int, int] = {}
        for i in members:
            p = i - 1
            while p >= 0 and group[p] >= first:
                p = prev[p]
            prev[i] = p
            if p >= 0:
                times[p] = times.get(p, 0) + 1
        moved: dict[int, list[int]] = {}
        for p in times:
            moved.setdefault(group[p], []).append(p)
        for g, ps in moved.items():
            if len(ps) > 1:
                ps.sort(key=times.__getitem__, reverse=True)
            top, new, last = g + size[g], None, 0
            for p in ps:  # from the upper end of the group downwards
                top -= 1
                q, was = order[top], place[p]
                order[was], place[q] = q, was
                order[top], place[p] = p, top
                if times[p] != last:
                    if new is not None:
                        size[top + 1] = new
                        for j in range(top + 1, top + 1 + new):
                            group[order[j]] = top + 1
                    new, last = 0, times[p]
                new += 1
            size[g] -= len(ps)
            size[top] = new
            for j in range(top, top + new):
                group[order[j]] = top
        end = first
    out, free, done = [0] * n, {}, [False] * n
    out[0] = n - 1
    done[n - 1] = True
    for i in range(n):
        p = out[i] - 1
        while p >= 0 and not done[p]:
            g = group[p]
            k = free.get(g, g)
            out[k], free[g], done[p] = p, k + 1, True
            p = prev[p]
    return out


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours, by doubling."""
    span = 1
    while span * 2 <= width:
        x, span = np.minimum(x[:-span], x[span:]), span * 2
    return np.minimum(x[: len(x) - (width - span)], x[width - span :]) if span < width else x


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h, base, span = raw.astype(np.uint64) + U(1), 0x9E3779B97F4A7C15, 1
        while span < GRAM:
            h = h[:-span] * U(base) + h[span:]
            base, span = base * base % (1 << 64), span * 2
        return mix(h)


def anchors(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, places) of the grams that are least, ties included, in some window of LENGTH bytes of one of the texts."""
    if len(raw) < LENGTH:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    left = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(len(raw))  # bytes from here to the text's end
    h = np.full(len(raw), np.iinfo(np.uint64).max)
    found = gram_hashes(raw)
    h[: len(found)] = np.where(left[: len(found)] >= GRAM, found, h[0])
    least = _least(h, _REACH + 1)
    least[left[: len(least)] < LENGTH] = 0
    pad = np.zeros(_REACH, np.uint64)
    most = ~_least(~np.concatenate([pad, least, pad]), _REACH + 1)
    at = np.flatnonzero((most == h) & (left >= GRAM))
    return h[at], at


def all_anchors(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for any number of bytes, which are read in pieces; those of long texts overlap."""
    grams, places, first = [], [], 0
    while first < len(offsets) - 1:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + PIECE, "right")) - 1)
        a, b = int(offsets[first]), int(offsets[last])
        if last > first + 1 or b - a <= PIECE:
            h, at = anchors(raw[a:b], offsets[first : last + 1] - a)
            grams.append(h)
            places.append(at + a)
        else:
            for x in range(a, b, PIECE):
                lo, hi = max(a, x - LENGTH), min(b, x + PIECE + LENGTH)
                h, at = anchors(raw[lo:hi], np.array([0, hi - lo]))
                own = (at + lo >= x) & (at + lo < x + PIECE)
                grams.append(h[own])
                places.append(at[own] + lo)
        first = last
    return (np.concatenate(grams), np.concatenate(places)) if grams else (np.empty(0, np.uint64), np.empty(0, np.int64))


def _keys(raw: np.ndarray, offsets: np.ndarray, which: np.ndarray, at: np.ndarray, least: int, most: int) -> tuple[np.ndarray, ...]:
    """(which of the anchors have a window with ``least`` to ``most`` bytes before them, digest of what these windows share, digest of all they hold)."""
    begin, end = offsets[which], offsets[which + 1]
    lo, hi = np.maximum(at - most, begin), np.minimum(at + LENGTH - least, end)
    ok = np.flatnonzero((hi - lo >= LENGTH) & (at - least >= begin) & (at + LENGTH - most <= end))
    at, lo, hi = at[ok], lo[ok], hi[ok]
    with np.errstate(over="ignore"):
        kind = mix(word_hashes(raw, lo, hi) + (at - lo).astype(np.uint64) * U(0x9E3779B97F4A7C15))
        key = mix(word_hashes(raw, at - least, at + LENGTH - most) + U(least))
    return ok, key, kind


def _anchored(docs: DataFrame) -> DataFrame:
    """key, class, doc_id, mark, place of the anchors of (doc_id, mark, body): digests of the gram and of its surroundings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in slices(whole, 2, 1 << 20)):
            raw, offsets = utf8_column(b.column(2))
            at = all_anchors(raw, offsets)[1]
            which = np.searchsorted(offsets, at, "right") - 1
            ok, key, kind = _keys(raw, offsets, which, at, *WHOLE[0])
            yield _placed(b, which[ok], at[ok] - offsets[which[ok]], [key, kind], {})

    return docs.select("doc_id", "mark", "body").mapInArrow(run, f"key long, class long, {_place(docs)}")


def _place(docs: DataFrame) -> str:
    return f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, mark long, place int"


def _placed(b: pa.RecordBatch, which: np.ndarray, place: np.ndarray, digests: list[np.ndarray], more: dict) -> pa.RecordBatch:
    of = pa.array(which.astype(np.int64))
    columns = [*(pa.array(d.view(np.int64)) for d in digests), b.column(0).take(of), b.column(1).take(of), pa.array(place.astype(np.int32)), *more.values()]
    return pa.record_batch(columns, [*["key", "class"][: len(digests)], "doc_id", "mark", "place", *more])


def _split(held: DataFrame) -> DataFrame:
    """key, class, doc_id, mark, place, side for each of the NARROW ranges at the positions of (doc_id, mark, body, positions)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in slices(whole, 2, 1 << 18)):
            raw, offsets, which, at, _ = _positions(b)
            for side, (least, most) in enumerate(NARROW):
                ok, key, kind = _keys(raw, offsets, which, at, least, most)
                yield _placed(b, which[ok], at[ok] - offsets[which[ok]], [key, kind], {"side": pa.array(np.full(len(ok), side, np.int32))})

    return held.select("doc_id", "mark", "body", "positions").mapInArrow(run, f"key long, class long, {_place(held)}, side int")


def _positions(b: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """(bytes, offsets; text, place and side of each position) of a batch whose column 3 has positions (side, place) in the text of column 2."""
    raw, offsets = utf8_column(b.column(2))
    which = np.repeat(np.arange(b.num_rows), b.column(3).value_lengths().to_numpy())
    side, place = (x.to_numpy(zero_copy_only=False) for x in b.column(3).flatten().flatten())
    at = place + offsets[which]
    order = np.argsort(at, kind="stable")
    return raw, offsets, which[order], at[order], side[order]


def _shown(held: DataFrame) -> DataFrame:
    """key, doc_id, mark, place, side, around of the positions: the bytes around each, one more than their value, and 0 beyond the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in slices(whole, 2, 1 << 20)):
            raw, offsets, which, at, sides = _positions(b)
            for side in np.unique(sides).tolist():
                of_side = np.flatnonzero(sides == side)
                ok, key, _ = _keys(raw, offsets, which[of_side], at[of_side], *(NARROW[side] if side >= 0 else WHOLE[0]))
                ok = of_side[ok]
                for i in range(0, len(ok), 1 << 13):
                    own = ok[i : i + (1 << 13)]
                    of = which[own]
                    index = at[own][:, None] + np.arange(-_REACH, LENGTH)
                    beyond = (index < offsets[of][:, None]) | (index >= offsets[of + 1][:, None])
                    around = raw[np.where(beyond, 0, index)] + np.uint8(1)
                    around[beyond] = 0
                    blob = pa.FixedSizeBinaryArray.from_buffers(pa.binary(_REACH + LENGTH), len(own), [None, pa.py_buffer(around.tobytes())])
                    more = {"side": pa.array(np.full(len(own), side, np.int32)), "around": blob.cast(pa.binary())}
                    yield _placed(b, of, at[own] - offsets[of], [key[i : i + (1 << 13)]], more)

    return held.select("doc_id", "mark", "body", "positions").mapInArrow(run, f"key long, {_place(held)}, side int, around binary")


def _agreeing(order: np.ndarray, group: np.ndarray, sides: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order of the rows, bytes in which each agrees with the one before it; -1 for the first of a group)."""
    here, before = order[1:], order[:-1]
    differ = (sides[here] != sides[before]) | (sides[here] == 0)
    same = np.where(differ.any(1), differ.argmax(1), sides.shape[1])
    same[group[here] != group[before]] = -1
    return order, np.concatenate([[-1], same])


def repeated(group: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least, most) j for which an earlier row of the same group agrees with a row in j bytes of ``left`` and w - j of ``right``; (w + 1, -1) for none.

    Rows are in order of time; both sides have w bytes a row, read from the group's string outwards, 0 beyond the text.
    """
    n, w = left.shape
    width = -(-w // SYMBOL)
    blocks = np.zeros((2, n, width * SYMBOL), np.uint8)
    blocks[0, :, :w], blocks[1, :, :w] = right, left
    ranks = np.unique(blocks.reshape(-1, SYMBOL).view(f"S{SYMBOL}").ravel(), return_inverse=True)[1].reshape(2, n, width)
    kinds = int(group.max(initial=-1)) + 1
    text = np.empty((n, 2, width + 1), np.int64)
    text[:, 0, 0], text[:, 1, 0] = group + 1, group + 1 + kinds
    text[:, :, 1:] = ranks.transpose(1, 0, 2) + 2 * kinds + 1
    order = np.array(linear_grouping(text.ravel().tolist()))[1:]
    step = 2 * (width + 1)
    heads = [order[order % step == k] // step for k in (0, width + 1)]
    (to_right, agree_right), (to_left, agree_left) = (_agreeing(o, group, x) for o, x in zip(heads, (right, left)))
    low, high = np.full(n, w + 1), np.full(n, -1)
    by_right, by_left = np.empty((2, n), np.int64)
    for j in range(w + 1):
        by_right[to_right] = np.cumsum(agree_right < w - j)
        by_left[to_left] = np.cumsum(agree_left < j)
        again = np.ones(n, bool)
        again[np.unique(by_left * (n + 1) + by_right, return_index=True)[1]] = False
        low[again], high[again] = np.minimum(low[again], j), j
    return low, high


def ranges_of(around: np.ndarray, spans: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, lo, hi) from the anchor on, of repeated windows among surroundings in order of time."""
    rows, groups, lefts, rights, leasts, first = [], [], [], [], [], 0
    w = spans[0][1] - spans[0][0]
    for least, most in spans:
        whole = np.flatnonzero((around[:, _REACH - least] > 0) & (around[:, _REACH + LENGTH - most - 1] > 0))
        shared = np.ascontiguousarray(around[whole, _REACH - least : _REACH + LENGTH - most])
        _, group, count = np.unique(shared.view(f"S{shared.shape[1]}").ravel(), return_inverse=True, return_counts=True)
        more = np.flatnonzero(count[group] > 1)
        own = whole[more]
        edge = _REACH + LENGTH - most
        pad = np.zeros((len(own), w - (most - least)), np.uint8)
        rows.append(own)
        groups.append(np.unique(group[more], return_inverse=True)[1] + first)
        first += len(np.unique(group[more]))
        lefts.append(np.hstack([around[own, _REACH - most : _REACH - least][:, ::-1], pad]))
        rights.append(np.hstack([around[own, edge : edge + most - least], pad]))
        leasts.append(np.full(len(own), least))
    row, least = np.concatenate(rows), np.concatenate(leasts)
    low, high = repeated(np.concatenate(groups), np.concatenate(lefts), np.concatenate(rights))
    hit = high >= 0
    # windows with low to high bytes more than least to the left; they overlap, as high - low < LENGTH
    return row[hit], -(least + high)[hit], LENGTH - (least + low)[hit]


def _sorted_out(rows: DataFrame) -> DataFrame:
    """doc_id, mark, lo, hi: byte ranges of repeated windows among (key, doc_id, mark, place, side, around); a task sorts its keys batch by batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(part: pa.Table) -> pa.RecordBatch:
            columns = part.combine_chunks()
            frame = columns.select(["key", "doc_id", "mark", "place", "side"]).to_pandas()
            frame["doc"] = frame["doc_id"].rank(method="dense", na_option="top")
            first = frame.drop_duplicates(["key", "doc", "mark", "place"]).sort_values(["doc", "mark", "place"], kind="stable").index.to_numpy()
            around, _ = utf8_column(columns["around"])
            around, found = around.reshape(-1, _REACH + LENGTH), []
            sides = frame["side"].to_numpy()[first]
            for side in np.unique(sides).tolist():
                own = first[sides == side]
                row, lo, hi = ranges_of(around[own], [NARROW[side]] if side >= 0 else HALVES)
                found.append((own[row], lo, hi))
            row, lo, hi = (np.concatenate(x) for x in zip(*found))
            at, of = frame["place"].to_numpy(np.int64)[row], pa.array(row)
            return pa.record_batch([columns[c].take(of).combine_chunks() for c in ("doc_id", "mark")] + [pa.array(at + lo), pa.array(at + hi)], ["doc_id", "mark", "lo", "hi"])

        held: list[pa.RecordBatch] = []
        for b in batches:
            if b.num_rows:
                held.append(b)
            if sum(x.num_rows for x in held) >= BATCH:
                key = np.concatenate([x.column(0).to_numpy() for x in held])
                cut = int((key != key[-1]).sum())  # the last key may go on
                if cut:
                    part = pa.Table.from_batches(held)
                    yield solve(part.slice(0, cut))
                    held = part.slice(cut).combine_chunks().to_batches()
        if held:
            yield solve(pa.Table.from_batches(held))

    kind = rows.schema["doc_id"].dataType.simpleString()
    return (
        rows.select("key", "doc_id", "mark", "place", "side", "around")
        .repartition(partitions(rows.sparkSession), "key")
        .sortWithinPartitions("key")
        .mapInArrow(run, f"doc_id {kind}, mark long, lo long, hi long")
    )


def without(text: str, ranges: list) -> tuple[bytes, list[tuple[int, int]]]:
    """The bytes outside of the ranges, and the ranges' maximal runs."""
    raw, runs = text.encode(), []
    for lo, hi in sorted((r["lo"], r["hi"]) for r in ranges):
        if runs and lo <= runs[-1][1]:
            runs[-1] = (runs[-1][0], max(hi, runs[-1][1]))
        else:
            runs.append((lo, hi))
    return b"".join(raw[a:b] for a, b in zip([0, *(r[1] for r in runs)], [*(r[0] for r in runs), len(raw)])), runs


def _same(a: DataFrame, b: DataFrame, how: str = "inner") -> DataFrame:
    other = b.withColumnsRenamed({"doc_id": "__doc", "mark": "__mark"})
    return a.join(other, F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.col("mark") == F.col("__mark")), how).drop("__doc", "__mark")


_HERE = ("doc_id", "mark", "place")


def _first_and_again(around: DataFrame, least: F.Column, most: F.Column, scratch: Scratch, name: str) -> tuple[DataFrame, DataFrame]:
    """Of key, class, doc_id, mark, place, side: the first places of each class with the number of classes of its key, and the byte ranges of the others."""
    here = F.struct(*_HERE)
    classes = around.groupBy("key", "class", "side").agg(F.min(here).alias("first"), (F.min(here) != F.max(here)).alias("more"))
    classes = scratch.save(classes, f"{name}-classes")
    again = around.join(classes.filter("more").select("key", "class", "first"), ["key", "class"]).filter(~here.eqNullSafe(F.col("first")))
    again = again.select("doc_id", "mark", F.greatest(F.col("place") - most, F.lit(0)).cast("long").alias("lo"), (F.col("place") + LENGTH - least).cast("long").alias("hi"))
    again = scratch.save(again.groupBy("doc_id", "mark").agg(F.collect_set(F.struct("lo", "hi")).alias("ranges")), f"{name}-again")
    mixed = classes.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    firsts = scratch.save(classes.join(mixed, "key").select("first.*", "side", "n"), f"{name}-firsts")
    scratch.drop(f"{name}-classes")
    return firsts, again


def suffix_dedup(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, spans (lo, hi), kept_sha256.

    A byte of a text in UTF-8 is removed if a string of LENGTH bytes that covers it also starts earlier: in a smaller id or, in the same
    document, before.  A null id is the smallest.  Null texts count as empty; texts under LENGTH bytes stay whole.  Rows that
    repeat an id with the same text are one document with one result; with other texts they are told apart and ordered by a hash of
    the text.  An empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "suffixes")
    body = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.pmod(F.xxhash64(body), F.lit(1 << 31)).alias("mark"), body.alias("body"))
    found = scratch.save(_anchored(rows), "found")
    twice = scratch.save(found.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key"), "twice")
    around = scratch.save(found.join(twice, "key"), "around")
    scratch.drop("found", "twice")
    firsts, again = _first_and_again(around.withColumn("side", F.lit(-1)), F.lit(0), F.lit(_REACH), scratch, "whole")

    def with_text(places: DataFrame) -> DataFrame:
        return _same(rows, places.groupBy("doc_id", "mark").agg(F.collect_set(F.struct("side", "place")).alias("positions")))

    ranges, compared = [again], firsts.filter(F.col("n") <= MOST).drop("n")
    if not firsts.filter(F.col("n") > MOST).isEmpty():
        split = scratch.save(_split(with_text(firsts.filter(F.col("n") > MOST))), "split")
        sides = F.array(*(F.lit(a) for a, _ in NARROW)), F.array(*(F.lit(b) for _, b in NARROW))
        narrow, again = _first_and_again(split, *(F.element_at(x, F.col("side") + 1) for x in sides), scratch, "narrow")
        ranges.append(again)
        compared = compared.unionByName(narrow.drop("n"))
    every = _gathered(_sorted_out(_shown(with_text(compared))))
    for more in ranges:
        every = every.unionByName(more)
    ranges = scratch.save(every.groupBy("doc_id", "mark").agg(F.flatten(F.collect_list("ranges")).alias("ranges")), "ranges")
    scratch.drop("around", "split", "whole-firsts", "whole-again", "narrow-firsts", "narrow-again")

    @F.pandas_udf("n_removed long, spans array<struct<lo:int,hi:int>>, kept_sha256 string")
    def cut(texts: pd.Series, all_ranges: pd.Series) -> pd.DataFrame:
        out = []
        for t, r in zip(texts, all_ranges):
            if t is None:
                out.append((0, [], None))
                continue
            size = len(t.encode())
            kept, runs = without(t, [{"lo": x["lo"], "hi": min(x["hi"], size)} for x in r])
            out.append((size - len(kept), [{"lo": a, "hi": b} for a, b in runs], hashlib.sha256(kept).hexdigest()))
        return pd.DataFrame(out, columns=["n_removed", "spans", "kept_sha256"])

    joined = _same(rows, ranges, "left")
    return joined.select(
        "doc_id", F.octet_length("body").cast("long").alias("n_bytes"), F.when(F.col("ranges").isNull(), F.sha2("body", 256)).alias("sha"),
        cut(F.when(F.col("ranges").isNotNull(), F.col("body")), "ranges").alias("r"),
    ).select(
        "doc_id", "n_bytes", F.col("r.n_removed").alias("n_removed"), F.size("r.spans").cast("long").alias("n_spans"), F.col("r.spans").alias("spans"),
        F.coalesce("r.kept_sha256", "sha").alias("kept_sha256"),
    )


def _gathered(found: DataFrame) -> DataFrame:
    return found.groupBy("doc_id", "mark").agg(F.collect_set(F.struct("lo", "hi")).alias("ranges"))
