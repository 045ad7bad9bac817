"""Language identification with interpolated Kneser-Ney character models.

One model per language, fitted by one task per language on a bounded sample of labelled texts and kept as sorted arrays of
n-gram keys.  A text gets the language with the least cross-entropy per character; how far it may lie above what texts of
that language usually have is calibrated on labelled texts outside the counts, and texts beyond are rejected.  Texts are read in small
runs, and of a long text a stretch of characters at a time, so a worker's memory does not grow with them.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from realty_spark.llm.shared import tune

ORDER = 4
#: Expected number of labelled texts of a language that are learnt from; the only bound of the fit.
PER_LANGUAGE = 500
#: How much worse than the worst calibration text a text must be to be rejected.
MARGIN = 1.5
UNDETERMINED = "und"
#: Characters that count for the score at most, so that long texts don't all score 1 to the last digit.
SCORED = 200
#: Characters of texts that are read at once, and of them those whose probabilities are held at once.
READ, STEP = 1 << 17, 1 << 15
_SPACE = 32


def _letters() -> np.ndarray:
    """By code point: the key of a letter in 16 bits, 0 for all else; letters beyond 16 bits share the private area."""
    global _LETTERS
    if _LETTERS is None:
        codes = np.arange(sys.maxunicode + 1, dtype=np.uint32)
        is_letter = np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(sys.maxunicode + 1)), bool, len(codes))
        _LETTERS = np.where(is_letter, np.where(codes > 0xFFFF, 0xE000 + codes % 0x1000, codes), 0).astype(np.uint16)
    return _LETTERS


_LETTERS: np.ndarray | None = None


def characters(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(character keys, where each text begins, its number of letters).

    Lower-cased; a run of anything but letters is one space; each text begins with ORDER - 1 spaces and ends with one.
    """
    pad = " " * (ORDER - 1)
    pieces = [f"{pad}{t.lower()} " for t in texts]
    codes = np.frombuffer("".join(pieces).encode("utf-32-le", "surrogatepass"), np.uint32)
    keys = _letters()[codes]
    at = np.concatenate([[0], np.cumsum([len(p) for p in pieces])])
    letters = np.concatenate([[0], np.cumsum(keys != 0)])
    n = letters[at[1:]] - letters[at[:-1]]
    keep = np.ones(len(keys), bool)
    keep[1:] = (keys[1:] != 0) | (keys[:-1] != 0)
    starts = at[:-1]
    for j in range(ORDER - 1):
        keep[starts + j] = True
    kept = np.concatenate([[0], np.cumsum(keep)])
    chars = keys[keep]
    chars[chars == 0] = _SPACE
    return chars.astype(np.uint64), kept[at], n


def gram_keys(chars: np.ndarray, order: int) -> np.ndarray:
    """The key of the n-gram that ends at each character: 16 bits a character; what lies before the first is 0."""
    key = chars.copy()
    for j in range(1, order):
        key[j:] |= chars[:-j] << np.uint64(16 * j)
    return key


def _predicted(at: np.ndarray, n: int) -> np.ndarray:
    """Which characters are predicted: all but the ORDER - 1 spaces before each text."""
    out = np.ones(n, bool)
    for j in range(ORDER - 1):
        out[at[:-1] + j] = False
    return out


@dataclass
class KneserNey:
    """Counts of one language: n-gram keys by order with the discounted share and each context's weight of the lower order."""

    grams: list[np.ndarray] = field(default_factory=list)  # by order 1..ORDER: sorted keys
    shares: list[np.ndarray] = field(default_factory=list)
    contexts: list[np.ndarray] = field(default_factory=list)  # sorted keys of order - 1 characters
    weights: list[np.ndarray] = field(default_factory=list)

    @classmethod
    def fit(cls, texts: list[str]) -> "KneserNey":
        chars, at, _ = characters(texts)
        ok = _predicted(at, len(chars))
        model = cls()
        keys, counts = np.unique(gram_keys(chars, ORDER)[ok], return_counts=True)
        for order in range(ORDER, 0, -1):
            once, twice = (counts == 1).sum(), (counts == 2).sum()
            discount = once / (once + 2 * twice) if once and twice else 0.5
            contexts, place = np.unique(keys >> np.uint64(16), return_inverse=True)
            totals = np.bincount(place, counts, len(contexts))
            model.grams.insert(0, keys)
            model.shares.insert(0, (counts - discount) / totals[place])
            model.contexts.insert(0, contexts)
            model.weights.insert(0, discount * np.bincount(place, minlength=len(contexts)) / totals)
            if order > 1:  # the order below counts the different characters before an n-gram
                keys, counts = np.unique(keys & np.uint64((1 << 16 * (order - 1)) - 1), return_counts=True)
        return model

    def probabilities(self, keys: np.ndarray, order: int) -> np.ndarray:
        """Interpolated probability of the last character of each n-gram after the others."""
        if order == 0:
            return np.full(len(keys), 1 / (1 << 16))
        lower = self.probabilities(keys & np.uint64((1 << 16 * (order - 1)) - 1), order - 1)
        weight = found(self.contexts[order - 1], self.weights[order - 1], keys >> np.uint64(16), 1.0)
        return found(self.grams[order - 1], self.shares[order - 1], keys, 0.0) + weight * lower


def found(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, default: float) -> np.ndarray:
    i = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[i] == wanted, values[i], default)


class Identifier:
    """All languages: at each order the union of their n-grams with a column of log probabilities for each."""

    def __init__(self, models: dict[str, KneserNey]):
        self.langs = sorted(models)
        self.tables, self.backoff = [], []
        for order in range(1, ORDER + 1 if models else 1):
            keys = np.unique(np.concatenate([m.grams[order - 1] for m in models.values()]))
            values = np.stack([np.log10(models[x].probabilities(keys, order)) for x in self.langs], 1).astype(np.float32)
            self.tables.append((keys, values))
            keys = np.unique(np.concatenate([m.contexts[order - 1] for m in models.values()]))
            values = np.stack(
                [np.log10(found(models[x].contexts[order - 1], models[x].weights[order - 1], keys, 1.0)) for x in self.langs], 1
            ).astype(np.float32)
            self.backoff.append((keys, values))
        self.mean, self.spread, self.limit = np.zeros(len(self.langs)), np.ones(len(self.langs)), np.inf

    def logs(self, keys: np.ndarray, order: int) -> np.ndarray:
        """log10 probability of each n-gram's last character in each language."""
        if order == 0:
            return np.full((len(keys), len(self.langs)), -16 * np.log10(2), np.float32)
        table, values = self.tables[order - 1]
        i = np.minimum(np.searchsorted(table, keys), len(table) - 1)
        out = values[i]
        if len(miss := np.flatnonzero(table[i] != keys)):
            short = keys[miss]
            contexts, weights = self.backoff[order - 1]
            j = np.minimum(np.searchsorted(contexts, short >> np.uint64(16)), len(contexts) - 1)
            known = (contexts[j] == short >> np.uint64(16))[:, None]
            out[miss] = self.logs(short & np.uint64((1 << 16 * (order - 1)) - 1), order - 1) + np.where(known, weights[j], 0)
        return out

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(cross-entropy per character and language, mean square of it, predicted characters, letters) of each text."""
        chars, at, letters = characters(texts)
        ok = _predicted(at, len(chars))
        sums, squares = np.zeros((2, len(texts), len(self.langs)))
        for a in range(0, len(chars), STEP):
            b, back = min(a + STEP, len(chars)), min(a, ORDER - 1)
            logs = self.logs(gram_keys(chars[a - back : b], ORDER)[back:], ORDER)
            logs[~ok[a:b]] = 0
            first, last = int(np.searchsorted(at, a, "right")) - 1, int(np.searchsorted(at, b, "left"))
            starts = np.maximum(at[first:last], a) - a
            sums[first:last] += np.add.reduceat(logs, starts, axis=0, dtype=np.float64)
            squares[first:last] += np.add.reduceat(logs * logs, starts, axis=0, dtype=np.float64)
        n = np.maximum(np.diff(at) - (ORDER - 1), 1)
        return -sums / n[:, None], squares / n[:, None], n, letters

    def excess(self, entropy: np.ndarray, n: np.ndarray, lang: np.ndarray) -> np.ndarray:
        """How far cross-entropies lie above their language's mean, in spreads that shrink with the length."""
        return (entropy - self.mean[lang]) / (self.spread[lang] * (1 / np.sqrt(n) + 0.05))

    def calibrate(self, texts: dict[str, list[str]]) -> None:
        """Mean, spread and limit from labelled texts; those that another language fits better are taken for mislabelled and left out."""
        got = []
        for k, lang in enumerate(self.langs):
            if not (own := [t for t in texts.get(lang, []) if t]):
                continue
            entropy, square, n, letters = self.entropies(own)
            e, q, ok = entropy[:, k], square[:, k], letters > 0
            if (told := ok & (entropy.argmin(1) == k)).any():
                ok = told
            if not ok.any():
                continue
            self.mean[k] = np.average(e[ok], weights=n[ok])
            self.spread[k] = max(1e-3, np.sqrt(max(0, np.average(q[ok], weights=n[ok]) - self.mean[k] ** 2)))
            got.append((k, e[ok], n[ok]))
        if got:
            self.limit = MARGIN * max(1.0, *(self.excess(e, n, np.full(len(e), k)).max() for k, e, n in got))

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, score, rejected) of each text."""
        if not self.langs:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts)), characters([t or "" for t in texts])[2] == 0
        entropy, _, n, letters = self.entropies([t or "" for t in texts])
        best = entropy.argmin(1)
        least = entropy[np.arange(len(best)), best]
        odds = np.exp(-np.log(10) * (entropy - least[:, None]) * np.minimum(n, SCORED)[:, None])
        known = letters > 0
        rejected = ~known | (self.excess(least, n, best) > self.limit)
        return [self.langs[b] if k else UNDETERMINED for b, k in zip(best, known)], np.where(known, 1 / odds.sum(1), 0.0), rejected


def fit(labelled: DataFrame, per_language: int = PER_LANGUAGE) -> Identifier:
    """Fit on the rows of (doc_id, text, lang) with a lang and a text.

    About ``per_language`` rows of each language are taken, by a hash of their id; four in five of them are counted and one
    calibrates.  Each language is fitted in a task of its own; the driver gets its arrays, whose size the bound limits.
    """
    tune(labelled.sparkSession)
    rows = labelled.filter("lang IS NOT NULL AND text IS NOT NULL")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    draw = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 20)) / (1 << 20)
    chosen = F.lit(False)
    for lang, n in sorted(sizes.items()):
        chosen = F.when(F.col("lang") == lang, draw < per_language / n).otherwise(chosen)
    sample = rows.filter(chosen).withColumn("part", F.pmod(F.xxhash64(F.lit("part"), "doc_id"), F.lit(5)))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        counted = pdf.text[pdf.part > 0].tolist() or pdf.text.tolist()
        checked = pdf.text[pdf.part == 0].tolist() or counted
        m = KneserNey.fit(counted)
        arrays = [a.tobytes() for x in (m.grams, m.shares, m.contexts, m.weights) for a in x]
        return pd.DataFrame({"lang": [pdf.lang.iloc[0]], "arrays": [arrays], "checked": [checked]})

    models, checked = {}, {}
    for r in sample.groupBy("lang").applyInPandas(one, "lang string, arrays array<binary>, checked array<string>").toLocalIterator():
        read = [np.frombuffer(bytes(a), np.uint64 if i // ORDER % 2 == 0 else np.float64) for i, a in enumerate(r["arrays"])]
        models[r["lang"]] = KneserNey(*(read[i : i + ORDER] for i in range(0, 4 * ORDER, ORDER)))
        checked[r["lang"]] = r["checked"]
    out = Identifier(models)
    out.calibrate(checked)
    return out


def identified(model: Identifier, text: Column, spark) -> Column:
    """A struct of lang_pred, score and rejected for a text column; the model is broadcast, and the fit's bound limits it.

    lang_pred is ``und``, the score 0 and rejected true where the text is null or has no letter; where nothing was learnt, other texts are
    ``und`` with score 0 too, and not rejected.
    """
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("lang_pred string, score double, rejected boolean")
    def predict(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            outs, i = [], 0
            size = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(part), 0).to_numpy(zero_copy_only=False))])
            while i < len(part):
                j = max(i + 1, int(np.searchsorted(size, size[i] + READ, "right")) - 1)
                lang, score, rejected = shared.value.predict(part[i:j].to_pylist())
                outs.append(pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], ["lang_pred", "score", "rejected"]))
                i = j
            yield pa.concat_arrays(outs) if outs else pa.array([], pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())]))

    return predict(text)


def learnable(doc_id: Column, parts: int = 4, held: int = 2) -> Column:
    """True for documents that may be learnt from: crc32 of the id as text, modulo ``parts``, is not ``held``."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts != held


def languages(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, rejected.

    Fits on the learnable documents with a lang, then reads every whole text.  Null, empty and letterless texts
    are ``und`` with score 0; null and repeated ids are carried; an empty table gives an empty result; ties between
    languages fall to the first name.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    model = fit(rows.filter(learnable(F.col("doc_id"))), per_language)
    got = rows.select("doc_id", (~learnable(F.col("doc_id"))).alias("held_out"), identified(model, F.col("text"), docs.sparkSession).alias("r"))
    return got.select("doc_id", "held_out", "r.*")
