"""Spelling variants: words that differ by one letter, found by k-d trees over their letter counts.

1. Words are counted over all texts.
2. One inserted or deleted letter changes the letter counts by one, a replaced one by two: a word's near words have its length and counts
   at an L1 distance of two, or one letter more and its counts plus one.  Words of one length are cut into cells by the top of a k-d
   tree (``Cells``), fitted on a bounded sample of words, which only balances the cells.  A word lives in one cell; it is also sent as a
   query to those later cells of its length, and those of the length above, that the tree can't rule out.
3. A task reads the words of a cell, builds a k-d tree with tight boxes over their distinct letter counts (``Tree``), and runs its
   own words and then the queries, batch by batch, through it: boxes out of range are pruned, leaves compared as matrices.
4. Letter counts in range tell which letter becomes which; the order of letters is verified by making the change at each place
   and looking the result up among the words.
5. Forms are followed to their last by doubling.

A cell with many words, as anagrams have the same counts, is dealt in shares that meet as queries do.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from realty_spark.llm.shared import Scratch, partitions

LETTERS = "A-Za-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_LETTERS, LEAST_TIMES, FACTOR = 7, 2, 10
#: Words that the cells are fitted on at about, words of a cell at about, cells of a length at most, words of a share.
SAMPLE, CELL, CELLS, SHARE = 100_000, 16_384, 1024, 65_536
#: Hashes that words are dealt by.
DEALS = 1 << 30
#: Letter counts in a leaf of a task's tree.
LEAF = 24
#: Letters by their code in Latin-1, which holds them all: a-z, then A-Z as far as the range has them, then the rest.
_DIM = np.zeros(256, np.int64)
_DIM[ord("a") : ord("z") + 1] = np.arange(26)
_DIM[0xC0:0x100] = np.arange(26, 90)
DIMS = 90


def changed(doc_id: Column, text: Column, least: int = LEAST_LETTERS) -> Column:
    """The words of a text in lower case (A-Z alone): runs of letters of which one in 31, by the checksum of id and run, has lost a letter."""
    runs = F.regexp_extract_all(text, F.lit(f"[{LETTERS}]{{{least},}}"), F.lit(0))  # shorter ones do not count, with or without a loss
    key = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"))

    def word(run: Column) -> Column:
        at = (F.crc32(F.concat(key, run).cast("binary")) % F.char_length(run)).cast("int")
        lost = F.concat(F.substring(run, F.lit(1), at), F.substr(run, at + 2))
        return F.when(F.crc32(F.concat(key, run).cast("binary")) % 31 == 0, lost).otherwise(run)

    return F.transform(F.transform(runs, lambda r: F.translate(r, UPPER, LOWER)), word)


def letters_of(words: list[bytes], length: int) -> np.ndarray:
    """Letter codes, a row a word; all words have ``length`` letters."""
    return np.frombuffer(b"".join(words), np.uint8).reshape(len(words), length)


def counts_of(codes: np.ndarray) -> np.ndarray:
    """How often each letter occurs, a row a word."""
    n = len(codes)
    flat = _DIM[codes] + np.arange(n)[:, None] * DIMS
    return np.bincount(flat.ravel(), minlength=n * DIMS).reshape(n, DIMS).astype(np.int32)


class Cells:
    """The top of a k-d tree for words of one length: node i has the children 2i + 1 and 2i + 2; counts up to ``cut`` go left."""

    def __init__(self, counts: np.ndarray, depth: int):
        self.depth = depth
        self.dim, self.cut = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, 1 << 30, np.int64)
        held = {0: counts}
        for i in range(2**depth - 1):
            c = held.pop(i)
            if len(c) > 1:
                d = int(c.var(0).argmax())
                cut = int(np.median(c[:, d]))
                if not (c[:, d] > cut).any():
                    cut -= 1
                self.dim[i], self.cut[i] = d, cut
            left = c[:, self.dim[i]] <= self.cut[i]
            held[2 * i + 1], held[2 * i + 2] = c[left], c[~left]
        # the boxes of all nodes, in the dimensions that are cut
        self.cut_dims = np.unique(self.dim)
        self.low = np.zeros((2 ** (depth + 1) - 1, len(self.cut_dims)), np.int64)
        self.high = np.full_like(self.low, 1 << 30)
        for i, (d, cut) in enumerate(zip(np.searchsorted(self.cut_dims, self.dim), self.cut)):
            for k in (2 * i + 1, 2 * i + 2):
                self.low[k], self.high[k] = self.low[i], self.high[i]
            self.high[2 * i + 1, d] = min(self.high[i, d], cut)
            self.low[2 * i + 2, d] = max(self.low[i, d], cut + 1)

    def home(self, counts: np.ndarray) -> np.ndarray:
        at = np.zeros(len(counts), np.int64)
        for _ in range(self.depth):
            at = 2 * at + 1 + (counts[np.arange(len(counts)), self.dim[at]] > self.cut[at])
        return at - (2**self.depth - 1)

    def reached(self, counts: np.ndarray, more: int, fewer: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) of the cells in which there can be counts with up to ``more`` letters more and ``fewer`` fewer than a row's."""
        row, at = np.arange(len(counts)), np.zeros(len(counts), np.int64)
        x = counts[:, self.cut_dims]
        for _ in range(self.depth):
            row, at = np.concatenate([row, row]), np.concatenate([2 * at + 1, 2 * at + 2])
            own = x[row]
            near = (np.maximum(self.low[at] - own, 0).sum(1) <= more) & (np.maximum(own - self.high[at], 0).sum(1) <= fewer)
            row, at = row[near], at[near]
        return row, at - (2**self.depth - 1)


class Tree:
    """A k-d tree over distinct letter counts with the tight box of every node."""

    def __init__(self, counts: np.ndarray, leaf: int = LEAF):
        self.used = np.flatnonzero(counts.any(0))
        self.points = np.ascontiguousarray(counts[:, self.used].astype(np.int16 if counts.max(initial=0) < 10_000 else np.int32))
        self.nodes: list[tuple] = []
        if len(counts):
            self._build(np.arange(len(counts)), leaf)

    def _build(self, rows: np.ndarray, leaf: int) -> int:
        c = self.points[rows]
        low, high = c.min(0), c.max(0)
        me = len(self.nodes)
        self.nodes.append(None)
        if len(rows) <= leaf:
            self.nodes[me] = (low, high, rows, None)
        else:
            d = int(c.var(0).argmax())
            cut = int(np.median(c[:, d]))
            if cut == high[d]:
                cut -= 1
            left = c[:, d] <= cut
            self.nodes[me] = (low, high, None, (self._build(rows[left], leaf), self._build(rows[~left], leaf)))
        return me

    def search(self, counts: np.ndarray, more: int, fewer: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, point): points that have exactly ``more`` letters more and ``fewer`` fewer than the query."""
        q = counts[:, self.used].astype(self.points.dtype)
        other = counts.sum(1) - q.sum(1)  # letters that no point has
        found: list[tuple[np.ndarray, np.ndarray]] = []
        stack = [(0, np.flatnonzero(other <= fewer))] if self.nodes else []
        while stack:
            node, rows = stack.pop()
            low, high, members, below = self.nodes[node]
            x = q[rows]
            keep = (np.maximum(low - x, 0).sum(1) <= more) & (np.maximum(x - high, 0).sum(1) + other[rows] <= fewer)
            rows = rows[keep]
            if not len(rows):
                continue
            if below:
                stack += [(k, rows) for k in below]
                continue
            for part in np.array_split(rows, max(1, len(rows) // 2048)):  # a matrix of at most 2048 x LEAF x letters
                step = self.points[members][None] - q[part][:, None]
                a, b = np.nonzero((np.maximum(step, 0).sum(2) == more) & (np.maximum(-step, 0).sum(2) + other[part][:, None] == fewer))
                found.append((part[a], members[b]))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


class Words:
    """Words of one length by their letter counts: ``counts`` and, for each row of these, the words."""

    def __init__(self, words: list[bytes], times: list[int], length: int):
        codes = letters_of(words, length)
        order = np.sort(codes, axis=1)
        keys = np.ascontiguousarray(order).view(f"V{length}").ravel()
        _, first, of = np.unique(keys, return_index=True, return_inverse=True)
        self.counts = counts_of(codes[first])
        self.times = dict(zip(words, times))
        self.held: list[list[bytes]] = [[] for _ in first]
        for w, k in zip(words, of.ravel().tolist()):
            self.held[k].append(w)


class Found:
    """Near words as they come up: number, and the most frequent, the least in order among equals."""

    def __init__(self):
        self.best: dict[bytes, list] = {}

    def pair(self, a: bytes, a_times: int, b: bytes, b_times: int) -> None:
        for w, other, times in ((a, b, b_times), (b, a, a_times)):
            got = self.best.get(w)
            if got is None:
                self.best[w] = [1, times, other]
            else:
                got[0] += 1
                if times > got[1] or (times == got[1] and other < got[2]):
                    got[1:] = times, other

    def batch(self) -> pa.RecordBatch:
        rows = list(self.best.items())
        self.best = {}
        text = lambda xs: pa.array([x.decode("latin-1") for x in xs], pa.string())
        return pa.record_batch([text([w for w, _ in rows]), pa.array([v[0] for _, v in rows], pa.int64()), pa.array([v[1] for _, v in rows], pa.int64()), text([v[2] for _, v in rows])], FOUND)


FOUND = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("near_n", pa.int64()), ("near", pa.string())])


def replaced(queries: Words, data: Words, q: int, p: int, found: Found) -> None:
    """Verify the order of letters: words of one count become words of the other by one letter in place of another."""
    step = data.counts[p] - queries.counts[q]
    new, old = _LETTER[step.argmax()], _LETTER[step.argmin()]
    own, its, other = queries.held[q], data.held[p], data.times
    swap = len(own) > len(its)
    if swap:
        own, its, new, old, other = its, own, old, new, queries.times
    mine = data.times if swap else queries.times
    for w in own:
        at = w.find(old)
        while at >= 0:
            v = w[:at] + new + w[at + 1 :]
            if v in other:
                found.pair(w, mine[w], v, other[v])
            at = w.find(old, at + 1)


def inserted(queries: Words, data: Words, q: int, p: int, found: Found) -> None:
    """The same for a letter that the words of the second count have more."""
    letter = _LETTER[(data.counts[p] - queries.counts[q]).argmax()]
    for w in data.held[p]:
        at, seen = w.find(letter), -2
        while at >= 0:
            if at != seen + 1:  # within a run of a letter it is one word whichever is taken out
                v = w[:at] + w[at + 1 :]
                if v in queries.times:
                    found.pair(v, queries.times[v], w, data.times[w])
            seen = at
            at = w.find(letter, at + 1)


_LETTER = [bytes([c]) for c in list(range(ord("a"), ord("z") + 1)) + list(range(0xC0, 0x100))]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, int, list, list]]:
    """((length, cell, share), kind, words, times) of runs of sorted rows, at most a batch each."""
    for b in batches:
        cols = [b.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
        words, times = b.column(4).to_pylist(), b.column(5).to_pylist()
        if not words:
            continue
        change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
        for a, z in zip([0, *change.tolist()], [*change.tolist(), len(words)]):
            yield tuple(int(c[a]) for c in cols[:3]), int(cols[3][a]), words[a:z], times[a:z]


def search_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (length, cell, share, kind, word, n) sorted by the first four; kind 0: words of the cell, 1: queries of its length, 2: of the length below."""
    key, words, times, data, tree = None, [], [], None, None
    found = Found()

    def ready():
        nonlocal data, tree
        if data is None and words:
            data = Words(words, times, key[0])
            tree = Tree(data.counts)
            for part in np.array_split(np.arange(len(data.counts)), max(1, len(data.counts) // 4096)):
                for q, p in zip(*(x.tolist() for x in tree.search(data.counts[part], 1, 1))):
                    if part[q] < p:
                        replaced(data, data, int(part[q]), p, found)

    for its, kind, new_words, new_times in _chunks(batches):
        if its != key:
            ready()
            key, words, times, data, tree = its, [], [], None, None
        if kind == 0:
            words += new_words
            times += new_times
            continue
        ready()
        if data is not None:
            queries = Words(new_words, new_times, key[0] - (kind == 2))
            check = inserted if kind == 2 else replaced
            for q, p in zip(*(x.tolist() for x in tree.search(queries.counts, 1, int(kind == 1)))):
                check(queries, data, q, p, found)
        if len(found.best) > 50_000:
            yield found.batch()
    ready()
    if found.best:
        yield found.batch()


def fit_cells(words: DataFrame, sample: int = SAMPLE, cell: int = CELL) -> dict[int, Cells]:
    """Cells for the lengths of many words, from about ``sample`` words with the least hashes; other lengths are one cell."""
    sizes = {r.length: r.n for r in words.groupBy("length").agg(F.count("*").alias("n")).filter(F.col("n") > cell).collect()}
    if not sizes:
        return {}
    least = math.ceil(DEALS * min(1, sample / sum(sizes.values())))
    drawn = words.filter(F.col("length").isin(list(sizes)) & (F.col("deal") < least)).select("word", "length").collect()
    out = {}
    for length, n in sizes.items():
        own = [r.word.encode("latin-1") for r in drawn if r.length == length]
        depth = math.ceil(math.log2(min(n / cell, CELLS, max(1, len(own) / 16))))
        if depth > 0:
            out[length] = Cells(counts_of(letters_of(own, length)), depth)
    return out


_ROUTED = "length int, cell int, share int, kind int, word binary, n long"


def routed(words: DataFrame, cells: dict[int, Cells], shares: dict[tuple[int, int], int]) -> DataFrame:
    """Each word (word, n, length, deal) in its cell, and as a query in the later shares and cells that may hold near words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lengths = b.column("length").to_numpy()
            for length in np.unique(lengths).tolist():
                own = b.filter(pa.array(lengths == length))
                words = [w.encode("latin-1") for w in own.column("word").to_pylist()]
                counts, deal = counts_of(letters_of(words, length)), own.column("deal").to_numpy()
                rows, out = np.arange(len(words)), []
                of = lambda k, cs: np.array([shares.get((k, c), 1) for c in cs.tolist()], np.int64)  # noqa: E731, B023
                tree = cells.get(length)
                home = tree.home(counts) if tree else np.zeros(len(words), np.int64)
                share = deal % of(length, home)
                out.append((rows, home, share, length, 0))
                row, cell = tree.reached(counts, 1, 1) if tree else (rows, home)
                for r, c, s in _all_shares(row, cell, of(length, cell)):
                    later = (c > home[r]) | ((c == home[r]) & (s > share[r]))
                    out.append((r[later], c[later], s[later], length, 1))
                tree = cells.get(length + 1)
                row, cell = tree.reached(counts, 1, 0) if tree else (rows, np.zeros(len(words), np.int64))
                out += [(r, c, s, length + 1, 2) for r, c, s in _all_shares(row, cell, of(length + 1, cell))]
                texts, times = pa.array(words, pa.binary()), own.column("n")
                for r, c, s, k, kind in out:
                    fixed = lambda x: pa.array(np.full(len(r), x, np.int32))  # noqa: E731, B023
                    yield pa.record_batch([fixed(k), pa.array(c.astype(np.int32)), pa.array(s.astype(np.int32)), fixed(kind), texts.take(pa.array(r)), times.take(pa.array(r))], ["length", "cell", "share", "kind", "word", "n"])

    return words.mapInArrow(run, _ROUTED)


def _all_shares(row: np.ndarray, cell: np.ndarray, shares: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The rows and cells once for each share of the cell, a share at a time."""
    for s in range(int(shares.max(initial=0))):
        on = shares > s
        yield row[on], cell[on], np.full(int(on.sum()), s)


def near_words(words: DataFrame, scratch: Scratch, sample: int = SAMPLE, cell: int = CELL, share: int = SHARE) -> DataFrame:
    """(word, n_near, near_n, near) for the words (word, n) that have near words; near: the most frequent one."""
    spark = words.sparkSession
    words = words.withColumns({"length": F.char_length("word"), "deal": F.pmod(F.xxhash64("word"), F.lit(DEALS))})
    cells = fit_cells(words, sample, cell)
    homes = routed(words, cells, {}).filter("kind = 0").groupBy("length", "cell").agg(F.count("*").alias("n")).filter(F.col("n") > share)
    shares = {(r.length, r.cell): math.ceil(r.n / share) for r in homes.collect()}  # one in at least ``share`` words
    keys = ["length", "cell", "share"]
    dealt = routed(words, cells, shares).repartition(partitions(spark), *keys).sortWithinPartitions(*keys, "kind", "word")
    found = dealt.mapInArrow(search_cells, "word string, n_near long, near_n long, near string")
    best = F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("b")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("b.m")).alias("near_n"), F.col("b.near").alias("near"))


def followed(forms: DataFrame, steps: int, scratch: Scratch) -> DataFrame:
    """(word, root) from (word, form): forms followed to the last in chains of at most ``steps``, each round doubling the steps made."""
    jumps = scratch.save(forms.select("word", F.col("form").alias("root")), "jumps-0")
    for k in range(math.ceil(math.log2(max(1, steps)))):
        on = jumps.select(F.col("word").alias("root"), F.col("root").alias("further"))
        jumps = scratch.save(jumps.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root")), f"jumps-{k + 1}")
        scratch.drop(f"jumps-{k}")
    return jumps


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, cell: int = CELL, share: int = SHARE) -> DataFrame:
    """One row per word of at least 7 letters that occurs at least twice: word, form, root, n, n_near, form_n.

    Near words differ by one letter inserted, deleted or replaced.  The form is the near word of the largest n, ties going to the first in
    code-point order, where that is at least ten times the word's; the root is the last of the forms of forms, the word itself where it
    has none.  A null text has no words, a null id counts as empty, and rows that repeat count each time.  An empty table gives
    an empty result; other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "spelling")
    found = docs.select(F.explode(changed(F.col(id_col), F.col(text_col))).alias("word")).filter(F.char_length("word") >= LEAST_LETTERS)
    words = scratch.save(found.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST_TIMES), "words")
    near = near_words(words, scratch, sample, cell, share)
    joined = words.join(near, "word", "left").withColumn("form", F.when(F.col("near_n") >= FACTOR * F.col("n"), F.col("near")))
    joined = scratch.save(joined.select("word", "form", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(F.col("form").isNotNull(), F.col("near_n")).alias("form_n")), "forms")
    most = joined.agg(F.max("n")).first()[0] or LEAST_TIMES
    steps = math.floor(math.log(most / LEAST_TIMES, FACTOR) + 1e-9) + 1  # n grows tenfold with each
    roots = followed(joined.filter("form IS NOT NULL"), steps, scratch)
    return joined.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
