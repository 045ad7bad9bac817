"""BPE encoding and decoding with forced boundaries.

Two neighbouring bytes that stand side by side in no token of the vocabulary can never be merged into
one, so every such place is a certain cut.  Words are cut there, the fragments are encoded each for
itself, many side by side in numpy, and the ids are concatenated; the result is that of encoding the whole.
Each worker keeps a bounded table of the words it has met.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from realty_spark.llm.shared import tune
from realty_spark.llm.words import slices, utf8_column

#: Entries after which a worker's table of words starts anew: some 80 MB.
MAX_ENTRIES = 400_000
#: The rank of pairs that are not merged.
NONE = np.iinfo(np.int32).max
#: Code points below this have their kind in a table; words with others, or with an apostrophe, are cut into pieces by the pattern.
PLAIN = 0x250
#: Words whose ids are gathered at once.
GATHERED = 1 << 20


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class ForcedBoundaryBpe:
    """A byte-level BPE with a word-end suffix, read from a tokenizer file."""

    def __init__(self, path: str, decoding: bool = True):
        self.decoding = decoding
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in (self.vocab | self.added).items()}
        self.width = 4 if decoding or len(self.tokens) > 1 << 16 else 2  # bytes of an id in the table of words
        pieces = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}")
        self.pieces_of = regex.compile(rf"\n|{pieces}")
        self.odd = regex.compile("[\x1c-\x1f]")
        kinds = [3 if c == "'" else 1 if regex.match(r"\p{L}", c) else 2 if regex.match(r"\p{N}", c) else 0 for c in map(chr, range(PLAIN))]
        self.kinds = np.array([*kinds, 3], np.uint8)  # 1: letter, 2: digit, a piece of its own, 3: by the pattern, 0: all else
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) or r"(?!)")
        symbols = byte_symbols()
        self.inner = np.array([self.vocab[c] for c in symbols], np.int32)
        self.last = np.array([self.vocab[c + self.suffix] for c in symbols], np.int32)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.merged = np.array([self.vocab[a + b] for a, b in pairs], np.int32)
        self.ranks = _Ranks([(self.vocab[a], self.vocab[b]) for a, b in pairs])
        number = {c: b for b, c in enumerate(symbols)}
        self.joined = np.zeros((256, 256), bool)
        for token in self.vocab:
            body = [number[c] for c in (token.removesuffix(self.suffix) if self.suffix else token)]
            self.joined[body[:-1], body[1:]] = True
        self.ids: dict[str, bytes] = {}
        self.shown: dict[str, str] = {}

    def merge(self, rows: np.ndarray) -> np.ndarray:
        """Merge in each row of ids (-1: no more) the pair of least rank, leftmost first, until none is left."""
        n, length = rows.shape
        ranks = np.full((n, length), NONE, np.int32)
        ranks[:, :-1] = self.ranks.find(rows[:, :-1], rows[:, 1:])
        out, live = rows, np.arange(n)
        cols = np.arange(length)
        while len(live):
            at = ranks.argmin(1)
            least = ranks[np.arange(len(live)), at]
            if not (go := least < NONE).all():
                out[live[~go]] = rows[~go]
                live, rows, ranks, at, least = live[go], rows[go], ranks[go], at[go], least[go]
                if not len(live):
                    break
            every = np.arange(len(live))
            later = np.minimum(cols + (cols > at[:, None]), length - 1)
            last = rows[:, -1] >= 0
            rows = np.take_along_axis(rows, later, 1)
            rows[last, -1] = -1
            ranks = np.take_along_axis(ranks, np.minimum(cols + (cols >= at[:, None]), length - 1), 1)
            ranks[:, -1] = NONE
            rows[every, at] = self.merged[least]
            after = np.minimum(at + 1, length - 1)
            ranks[every, at] = np.where(after > at, self.ranks.find(rows[every, at], rows[every, after]), NONE)
            before = np.flatnonzero(at > 0)
            ranks[before, at[before] - 1] = self.ranks.find(rows[before, at[before] - 1], rows[before, at[before]])
        return out

    def merge_long(self, ids: list[int | None]) -> list[int]:
        """The same for one long fragment with a heap and linked neighbours, for n log n time."""
        n = len(ids)
        rank = lambda i, j: self.ranks.of(ids[i], ids[j])
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        first = self.ranks.find(np.array(ids[:-1], np.int32), np.array(ids[1:], np.int32)).tolist()
        heap = [(r, i) for i, r in enumerate(first) if r < NONE]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            if ids[i] is None or (j := after[i]) >= n or rank(i, j) != r:
                continue
            ids[i], ids[j] = int(self.merged[r]), None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := rank(i, k)) < NONE:
                    heapq.heappush(heap, (r, i))
            if (h := before[i]) >= 0 and (r := rank(h, i)) < NONE:
                heapq.heappush(heap, (r, h))
        return [x for x in ids if x is not None]

    def encode_words(self, words: list[str]) -> list[bytes]:
        """The ids of normalised words without white space, ``width`` bytes each."""
        if not words:
            return []
        points = np.frombuffer("\n".join([*words, ""]).encode("utf-32-le"), "<u4")
        kinds, breaks = self.kinds[np.minimum(points, PLAIN)], points == 10
        ends = np.flatnonzero(breaks)
        odd = np.logical_or.reduceat(kinds == 3, np.concatenate([[0], ends[:-1] + 1]))
        if odd.any():
            by_pattern = iter(self._by_pattern([words[i] for i in np.flatnonzero(odd)]))
            plain = iter(self.encode_words([words[i] for i in np.flatnonzero(~odd)]))
            return [next(by_pattern if x else plain) for x in odd.tolist()]
        last = np.append(breaks[1:] | (kinds[1:] != kinds[:-1]) | (kinds[:-1] == 2), True)
        keep, at = ~breaks, np.cumsum(np.where(breaks, 0, np.where(points < 0x80, 1, 2)))
        ends_piece = np.zeros(at[-1], bool)
        ends_piece[at[last & keep] - 1] = True
        return self._merged(np.frombuffer("".join(words).encode(), np.uint8), ends_piece, at[ends])

    def _by_pattern(self, words: list[str]) -> list[bytes]:
        """The same for words that need the pattern to be cut into pieces."""
        pieces = [self.pieces_of.findall(w) for w in words]
        sizes = np.array([len(p.encode()) for p in chain.from_iterable(pieces)], np.int64)
        at = np.concatenate([[0], np.cumsum(sizes)])
        ends_piece = np.zeros(at[-1], bool)
        ends_piece[at[1:] - 1] = True
        return self._merged(np.frombuffer("".join(chain.from_iterable(pieces)).encode(), np.uint8), ends_piece, at[np.cumsum([len(p) for p in pieces])])

    def _merged(self, body: np.ndarray, last: np.ndarray, word_ends: np.ndarray) -> list[bytes]:
        """The ids of each word, from all bytes, whether they end a piece, and where words end; all fragments are merged side by side."""
        if not len(body):
            return [b""] * len(word_ends)
        ids = np.where(last, self.last[body], self.inner[body])
        cut = last.copy()
        cut[:-1] |= ~self.joined[body[:-1], body[1:]]
        ends = np.flatnonzero(cut) + 1
        starts = np.concatenate([[0], ends[:-1]])
        sizes = ends - starts
        counts, blocks = np.ones(len(ends), np.int64), []
        least = 2
        for most in (6, 10, 16, 24, 40, 64):
            which = np.flatnonzero((sizes >= least) & (sizes <= most))
            least = most + 1
            for i in range(0, len(which), 8192):
                some = which[i : i + 8192]
                rows = starts[some][:, None] + np.arange(most)
                rows = np.where(np.arange(most) < sizes[some][:, None], ids[np.minimum(rows, len(ids) - 1)], -1).astype(np.int32)
                rows = self.merge(rows)
                counts[some] = (rows >= 0).sum(1)
                blocks.append((some, rows))
        long = {i: self.merge_long(ids[starts[i] : ends[i]].tolist()) for i in np.flatnonzero(sizes > 64)}
        for i, got in long.items():
            counts[i] = len(got)
        at = np.concatenate([[0], np.cumsum(counts)])
        out = np.empty(at[-1], np.int32)
        single = np.flatnonzero(sizes == 1)
        out[at[single]] = ids[starts[single]]
        for some, rows in blocks:
            full = rows >= 0
            out[(at[some][:, None] + np.arange(rows.shape[1]))[full]] = rows[full]
        for i, got in long.items():
            out[at[i] : at[i + 1]] = got
        by_word = (at[np.searchsorted(ends, word_ends, "right")] * self.width).tolist()
        raw = out.astype(f"<u{self.width}").tobytes()
        return [raw[a:b] for a, b in zip([0, *by_word], by_word)]

    def learn(self, words: Iterable[str]) -> None:
        """Put those of distinct words that the table lacks into it."""
        new = [w for w in words if w not in self.ids]
        if len(self.ids) + len(new) > MAX_ENTRIES:
            self.ids.clear()
            self.shown.clear()
            new = list(words)
        for w in [w for w in new if w[0] == " "]:
            self.ids[w], self.shown[w] = self.added[w[1:]].to_bytes(self.width, "little"), w[1:]
        new = [w for w in new if w[0] != " "]
        for i in range(0, len(new), 50_000):
            some = new[i : i + 50_000]
            got = self.encode_words(some)
            self.ids.update(zip(some, got))
            if self.decoding:
                self.shown.update((w, self.decode(np.frombuffer(x, f"<u{self.width}").tolist())) for w, x in zip(some, got))

    def forget(self) -> None:
        """Empty the tables: a worker that has ended a task holds no memory that its next one, of any kind, may need."""
        self.ids, self.shown = {}, {}

    def split(self, text: str) -> list[str]:
        """Normalised words without white space, and added tokens after a space."""
        out, at = [], 0
        if "<" in text:
            for m in self.special.finditer(text):
                out += self._plain(text[at : m.start()])
                out.append(" " + m[0])
                at = m.end()
        return out + self._plain(text[at:] if at else text)

    def _plain(self, text: str) -> list[str]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # letter by letter: no final sigma
        text = text.lower()
        if self.odd.search(text):  # white space to str.split only
            return [w for w in regex.split(r"\p{White_Space}+", text) if w]
        return text.split()

    def encode_batch(self, texts: list[str | None]) -> list[tuple[bytes, str]]:
        """Ids of each text as little-endian unsigned 32-bit integers, and the decoded text."""
        words = [self.split(t) if t else [] for t in texts]
        self.learn(set().union(*words))
        ids = [b"".join(map(self.ids.__getitem__, ws)) for ws in words]
        return [(x, " ".join(filter(None, map(self.shown.__getitem__, ws)))) for x, ws in zip(ids, words)]

    def encode_ids(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text, ``width`` bytes each; words are looked up once a batch, and their ids gathered in numpy."""
        words = [self.split(t) if t else [] for t in texts]
        ends = np.cumsum([len(ws) for ws in words])
        lines = "\n".join(chain(chain.from_iterable(words), [""])).encode()
        del words
        offsets = np.concatenate([[0], np.flatnonzero(np.frombuffer(lines, np.uint8) == 10) + 1])
        coded = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(lines)]).dictionary_encode()
        codes = coded.indices.to_numpy()
        distinct = utf8_column(coded.dictionary)[0].tobytes().decode().split("\n")[:-1]
        self.learn(distinct)
        known = [self.ids[w] for w in distinct]
        sizes = np.array([len(x) // self.width for x in known], np.int64)
        pool, first = np.frombuffer(b"".join(known), f"<u{self.width}"), np.cumsum(sizes) - sizes
        n = sizes[codes]
        raw = []
        for i in range(0, len(codes), GATHERED):
            own, size = codes[i : i + GATHERED], n[i : i + GATHERED]
            shift = first[own] - (np.cumsum(size) - size)
            raw.append(pool[np.arange(size.sum()) + np.repeat(shift, size)].tobytes())
        whole, at = b"".join(raw), (np.concatenate([[0], np.cumsum(n)])[ends] * self.width).tolist()
        return [whole[a:b] for a, b in zip([0, *at], at)]

    def decode(self, ids: list[int]) -> str:
        """Without a decoder in the file, tokens are joined by spaces."""
        return " ".join([self.tokens[i] for i in ids])


class _Ranks:
    """Pairs of ids -> rank, in an open-addressing table of numpy arrays."""

    BITS = 19

    def __init__(self, pairs: list[tuple[int, int]]):
        self.keys = np.full(1 << self.BITS, -1, np.int64)
        self.values = np.full(1 << self.BITS, NONE, np.int32)
        for r, (a, b) in enumerate(pairs):
            k = a << 32 | b
            i = int(self._slot(np.array([k], np.int64))[0])
            while self.keys[i] not in (-1, k):
                i = (i + 1) & ((1 << self.BITS) - 1)
            if self.keys[i] == -1:
                self.keys[i], self.values[i] = k, r

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The ranks of pairs; NONE where there is none or an id is -1."""
        keys = (a.astype(np.int64) << 32 | b).ravel()
        keys[((a < 0) | (b < 0)).ravel()] = -1
        slot = self._slot(keys)
        out = np.full(len(keys), NONE, np.int32)
        open_ = np.flatnonzero(keys >= 0)
        slot = slot[open_]
        while len(open_):
            held = self.keys[slot]
            same = held == keys[open_]
            out[open_[same]] = self.values[slot[same]]
            on = ~same & (held >= 0)
            open_, slot = open_[on], (slot[on] + 1) & ((1 << self.BITS) - 1)
        return out.reshape(a.shape)

    def of(self, a: int, b: int) -> int:
        return int(self.find(np.array([a], np.int32), np.array([b], np.int32))[0])


_LOADED: dict[tuple[str, bool], ForcedBoundaryBpe] = {}


def loaded(path: str, decoding: bool) -> ForcedBoundaryBpe:
    if (path, decoding) not in _LOADED:
        _LOADED[path, decoding] = ForcedBoundaryBpe(path, decoding)
    return _LOADED[path, decoding]


def encode_decode(docs: DataFrame, vocabulary: str, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, n_tokens, ids (binary, little-endian uint32), decoded.

    ``vocabulary``: path of the tokenizer file, read by every worker.  A null or empty text has no ids and decodes
    to ''.  Null or repeated ids are carried as they are; an empty table gives an empty result; other columns are
    not read.  No shuffle: each task holds one slice of texts and its bounded table of words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(vocabulary, True)
        for batch in batches:
            for part in slices(batch, 1, 2 << 20):
                got = bpe.encode_batch(part.column(1).to_pylist())
                yield pa.record_batch(
                    [
                        part.column(0),
                        pa.array([len(x[0]) // 4 for x in got], pa.int64()),
                        pa.array([x[0] for x in got], pa.binary()),
                        pa.array([x[1] for x in got], pa.string()),
                    ],
                    ["doc_id", "n_tokens", "ids", "decoded"],
                )
        bpe.forget()

    tune(docs.sparkSession)
    rows = docs.selectExpr(f"`{id_col}` AS doc_id", f"`{text_col}` AS body")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids binary, decoded string")
