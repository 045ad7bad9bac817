"""Quality rules: a linear-chain conditional random field labels each line as content or boilerplate.

Each line has a few binned features; the field scores labels by bin and by the label of the line before.  It is fitted by maximum
likelihood on a bounded sample of labelled documents, whose lines carry the label of their document, and decoded by
Viterbi.  A document stays if content lines hold a sufficient share of its words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from realty_spark.llm.words import SPACE, U, mix, slices, utf8_column, word_hashes, word_spans

#: Bounds of the fit: expected number of labelled documents, and lines with a word that one of them may have to be among them.
SAMPLE, MOST_LINES = 2000, 2000
BOILERPLATE, CONTENT = 0, 1
BINS = 8
FEATURES = ("words", "symbols", "digits", "capitals", "ending", "duplicate", "bars", "word length", "repeats", "exclamations", "place")


def _class(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[np.frombuffer(chars.encode(), np.uint8)] = True
    return out


_SYMBOL, _DIGIT, _BAR, _BANG = map(_class, ("#*$%&|<>", "0123456789", "|", "!"))
_CAPITAL = _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_POINT = np.array([(b & 0xC0) != 0x80 for b in range(256)])  # first bytes of code points
_ENDING = np.full(256, 3, np.uint8)
_ENDING[_class("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")] = 2
_ENDING[_class(",;:")] = 1
_ENDING[_class(".?\"')")] = 0


@dataclass
class Lines:
    """Counts of each text and binned features of each of its lines that has a word."""

    n_words: np.ndarray
    word_chars: np.ndarray
    n_symbols: np.ndarray
    n_dup_lines: np.ndarray
    n_repeat_words: np.ndarray
    at: np.ndarray  # offsets of each text's lines
    words: np.ndarray  # of each line
    bins: np.ndarray  # line x feature


def _repeats(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which words lie in a 3-word window that its text has twice or more."""
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    covered = np.zeros(len(h), bool)
    if len(h) >= 3:
        with np.errstate(over="ignore"):
            key = mix(mix(h[:-2]) * U(3) + mix(h[1:-1] + U(1)) * U(5) + mix(h[2:] + U(2)) + mix(doc[:-2].astype(np.uint64)) * U(7))
        inside = np.flatnonzero(doc[:-2] == doc[2:])
        _, which, count = np.unique(key[inside], return_inverse=True, return_counts=True)
        hit = inside[count[which] > 1]
        for j in range(3):
            covered[hit + j] = True
    return covered


def lines_of(raw: np.ndarray, offsets: np.ndarray) -> Lines:
    """Lines are split at \\n, words are runs outside ``[\\x20\\x09-\\x0D]``; case is kept."""
    starts, ends, at = word_spans(raw, offsets)
    h = word_hashes(raw, starts, ends)
    covered = np.concatenate([[0], np.cumsum(_repeats(h, at))])
    breaks = np.flatnonzero(raw == 10)
    # a line begins at the start of each text and after each \n inside it
    first = np.unique(np.concatenate([offsets[:-1], breaks + 1]))
    first = first[first < len(raw)]
    last = np.concatenate([first[1:], [len(raw)]]) if len(first) else first
    w0, w1 = np.searchsorted(starts, first), np.searchsorted(starts, last)
    full = w1 > w0
    first, last, w0, w1 = first[full], last[full], w0[full], w1[full]
    last = last - (raw[last - 1] == 10) if len(last) else last
    doc = np.searchsorted(offsets, first, "right") - 1
    line_at = np.searchsorted(doc, np.arange(len(offsets)))
    with np.errstate(over="ignore"):
        key = mix(word_hashes(raw, first, last) + mix(doc.astype(np.uint64)))
    dup = np.ones(len(first), bool)
    dup[np.unique(key, return_index=True)[1]] = False

    def sums(mask: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        c = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return c[b] - c[a]

    size = np.maximum(last - first, 1)
    words = w1 - w0
    symbol = _SYMBOL[raw]
    chars = sums(_POINT[raw] & ~SPACE[raw], first, last)
    share = lambda table, cuts: np.digitize(sums(table[raw], first, last) / size, cuts)
    count = np.diff(line_at)
    number = np.arange(len(first)) - np.repeat(line_at[:-1], count)
    total = np.repeat(count, count)
    bins = np.stack(
        [
            np.digitize(words, [2, 4, 8, 16, 32, 64]),
            share(_SYMBOL, [1e-9, 0.01, 0.03, 0.08, 0.2]),
            share(_DIGIT, [1e-9, 0.02, 0.1, 0.3]),
            share(_CAPITAL, [1e-9, 0.03, 0.1, 0.3, 0.6]),
            _ENDING[raw[ends[w1 - 1] - 1]] if len(first) else words,
            dup,
            share(_BAR, [1e-9, 0.02, 0.05]),
            np.digitize(chars / np.maximum(words, 1), [2, 3, 4, 6, 8, 12, 24]),
            np.digitize((covered[w1] - covered[w0]) / np.maximum(words, 1), [1e-9, 0.1, 0.3, 0.6, 0.9]),
            share(_BANG, [1e-9, 0.02, 0.1]),
            (number == 0) + 2 * (number == total - 1),
        ],
        1,
    ).astype(np.uint8)
    return Lines(
        np.diff(at),
        sums(_POINT[raw] & ~SPACE[raw], offsets[:-1], offsets[1:]),
        sums(symbol, offsets[:-1], offsets[1:]),
        np.bincount(doc[dup], minlength=len(offsets) - 1),
        covered[at[1:]] - covered[at[:-1]],
        line_at,
        words,
        bins,
    )


class LineField:
    """Weights by feature, bin and label, and by neighbouring labels."""

    def __init__(self, unary: np.ndarray | None = None, pair: np.ndarray | None = None):
        self.unary = np.zeros((len(FEATURES), BINS, 2)) if unary is None else unary
        self.pair = np.zeros((2, 2)) if pair is None else pair

    def scores(self, bins: np.ndarray) -> np.ndarray:
        return sum(self.unary[f, bins[:, f]] for f in range(len(FEATURES))) if len(bins) else np.zeros((0, 2))

    def viterbi(self, scores: np.ndarray) -> list[int]:
        """The best labelling of one text's lines; ties go to content."""
        if not len(scores):
            return []
        (p00, p01), (p10, p11) = self.pair.tolist()
        rows = scores.tolist()
        a, b = rows[0]
        back = []
        for s, t in rows[1:]:
            a0, a1, b0, b1 = a + p00, b + p10, a + p01, b + p11
            back.append((int(a1 >= a0), int(b1 >= b0)))
            a, b = s + max(a0, a1), t + max(b0, b1)
        out = [int(b >= a)]
        for step in reversed(back):
            out.append(step[out[-1]])
        return out[::-1]

    @classmethod
    def fit(cls, texts: list[tuple[np.ndarray, int]], rounds: int = 80, rate: float = 0.2, ridge: float = 1e-3, pair_ridge: float = 0.1) -> "LineField":
        """Maximum likelihood over (bins of the lines, label) of texts: forward-backward on all at once, Adam steps.

        Labels come from whole documents, so no change of label is ever seen; a stronger ridge on the weights between
        lines keeps one odd line from carrying a text with it.
        """
        texts = [x for x in texts if len(x[0])]
        field = cls()
        if len({label for _, label in texts}) < 2:
            field.unary[0, :, CONTENT] = 1  # nothing to tell apart: all is content
            return field
        sample = _Sample(texts)
        params, m, v = np.concatenate([field.unary.ravel(), field.pair.ravel()]), 0.0, 0.0
        ridges = np.concatenate([np.full(field.unary.size, ridge), np.full(4, pair_ridge)])
        for step in range(1, rounds + 1):
            gradient = sample.objective(cls.of(params))[1] + ridges * params
            m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient**2
            params = params - rate * m / (1 - 0.9**step) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        return cls.of(params)

    @classmethod
    def of(cls, params: np.ndarray) -> "LineField":
        cut = len(FEATURES) * BINS * 2
        return cls(params[:cut].reshape(len(FEATURES), BINS, 2), params[cut:].reshape(2, 2))


def _logsum(x: np.ndarray) -> np.ndarray:
    return np.logaddexp(x[..., 0], x[..., 1])


class _Sample:
    """Labelled texts line by line: first the first lines of all texts, the longest text first, then their second lines, and so on."""

    def __init__(self, texts: list[tuple[np.ndarray, int]]):
        texts = sorted(texts, key=lambda x: -len(x[0]))
        self.n, self.length = n, length = len(texts), len(texts[0][0])
        self.alive = alive = np.array([sum(len(b) > t for b, _ in texts) for t in range(length)])  # the first so many have a line t
        self.at = np.concatenate([[0], np.cumsum(alive)])
        self.bins = np.concatenate([np.stack([texts[i][0][t] for i in range(alive[t])]) for t in range(length)])
        self.labels = np.concatenate([[texts[i][1] for i in range(alive[t])] for t in range(length)])
        weight = {c: n / (2 * max(1, sum(x[1] == c for x in texts))) for c in (0, 1)}
        self.by_text = np.array([weight[x[1]] / len(x[0]) for x in texts])  # texts count alike, whatever their length
        self.by_line = np.concatenate([self.by_text[: alive[t]] for t in range(length)])

    def objective(self, field: LineField) -> tuple[float, np.ndarray]:
        """(mean negative log likelihood, its gradient) by forward-backward."""
        at, alive, length = self.at, self.alive, self.length
        score = field.scores(self.bins)
        ahead, behind = score.copy(), np.zeros_like(score)
        for t in range(1, length):
            before = ahead[at[t - 1] : at[t - 1] + alive[t]]
            ahead[at[t] : at[t + 1]] += _logsum((before[:, :, None] + field.pair).swapaxes(1, 2))
        for t in range(length - 2, -1, -1):
            after = behind[at[t + 1] : at[t + 2]] + score[at[t + 1] : at[t + 2]]
            behind[at[t] : at[t] + alive[t + 1]] = _logsum(after[:, None, :] + field.pair)
        whole = _logsum(ahead + behind)  # of each line, that of its text
        marginal = np.exp(ahead + behind - whole[:, None])
        lines = np.arange(len(self.labels))
        loss = (whole[: self.n] * self.by_text).sum() - (score[lines, self.labels] * self.by_line).sum()
        gap = (marginal - (self.labels[:, None] == np.arange(2))) * self.by_line[:, None] / self.n
        unary = np.stack([np.stack([np.bincount(self.bins[:, f], gap[:, c], BINS) for c in (0, 1)], 1) for f in range(len(FEATURES))])
        pair = np.zeros((2, 2))
        for t in range(1, length):
            k = alive[t]
            joint = ahead[at[t - 1] : at[t - 1] + k][:, :, None] + field.pair + (score + behind)[at[t] : at[t + 1]][:, None, :]
            joint = np.exp(joint - np.logaddexp.reduce(joint.reshape(k, 4), 1)[:, None, None])
            own = self.labels[at[t] : at[t + 1]]
            joint[np.arange(k), own, own] -= 1
            pair += (joint * self.by_text[:k, None, None]).sum(0) / self.n
            loss -= (field.pair[own, own] * self.by_text[:k]).sum()
        return loss / self.n, np.concatenate([unary.ravel(), pair.ravel()])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most_lines: int = MOST_LINES) -> LineField:
    """Fit on about ``sample`` documents with a 0/1 quality in ``labels`` (doc_id, quality), drawn by a hash of the id.

    Of contrary labels of one id the lower counts.  Documents with over ``most_lines`` lines with a word are not learnt from, as the driver
    gets a byte for each line and feature; rows that repeat an id are each learnt from.
    """
    rows = labels.filter("quality IN (0, 1) AND doc_id IS NOT NULL").select("doc_id", "quality")
    n = rows.count()
    draw = F.pmod(F.xxhash64(F.lit("crf"), "doc_id"), F.lit(1 << 20)) / (1 << 20)
    chosen = F.broadcast(rows.filter(draw < sample / max(n, 1)).groupBy("doc_id").agg(F.min("quality").alias("quality")))  # about ``sample`` rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 0):
                x = lines_of(*utf8_column(batch.column(0)))
                few = np.diff(x.at) <= most_lines
                bins = [x.bins[a:b].tobytes() for a, b, own in zip(x.at, x.at[1:], few) if own]
                yield pa.record_batch([pa.array(bins, pa.binary()), batch.column(1).filter(pa.array(few))], ["bins", "quality"])

    got = docs.select("doc_id", "text").join(chosen, "doc_id").select("text", "quality").mapInArrow(run, "bins binary, quality int")
    return LineField.fit(
        sorted(((np.frombuffer(bytes(r["bins"]), np.uint8).reshape(-1, len(FEATURES)), r["quality"]) for r in got.collect()), key=lambda x: (x[0].tobytes(), x[1]))
    )


def quality(docs: DataFrame, field: LineField, least_share: float = 0.5, least_words: int = 50, most_repeats: int = 50) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, content_share, labels (a byte per line with a word), kept.

    base_failed: under ``least_words`` words, or over ``most_repeats`` percent of the words in repeated 3-word windows.  Kept: not
    that, and content lines have ``least_share`` of the words.  A null text has no words, so it fails; null and repeated
    ids are carried; an empty table gives an empty result; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1):
                x = lines_of(*utf8_column(batch.column(1)))
                scores = field.scores(x.bins)
                labels = [field.viterbi(scores[a:b]) for a, b in zip(x.at, x.at[1:])]
                flat = np.concatenate([[0], np.cumsum(x.words * np.fromiter((y for z in labels for y in z), np.int64, len(x.words)))])
                share = (flat[x.at[1:]] - flat[x.at[:-1]]) / np.maximum(x.n_words, 1)
                failed = (x.n_words < least_words) | (100 * x.n_repeat_words > most_repeats * x.n_words)
                counts = [pa.array(c, pa.int64()) for c in (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words)]
                yield pa.record_batch(
                    [batch.column(0), *counts, pa.array(failed), pa.array(share), pa.array(map(bytes, labels), pa.binary()), pa.array(~failed & (share >= least_share))],
                    ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "content_share", "labels", "kept"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run,
        f"doc_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, content_share double, labels binary, kept boolean",
    )
