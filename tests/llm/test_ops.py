"""The llm operators against brute force, and on nulls, empties, ties, repeats and clashing column names."""

import collections
import fractions
import functools
import hashlib
import heapq
import math
import random
import re
import tempfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("realty_spark.llm")

from realty_spark.llm import bpe, chunks, crf, exact_dedup, langid, licenses, minhash, packing, ppm, suffixes  # noqa: E402
from realty_spark.llm import queries as llm_queries  # noqa: E402
from realty_spark.llm.queries import VOCABULARY  # noqa: E402

SPACE = "[\x20\x09-\x0d]"


def words(t):
    return [w for w in re.split(f"{SPACE}+", t or "") if w]


def corpus(seed=5, n=40):
    r = random.Random(seed)
    vocab = ["".join(r.choice(["th", "on", "er", "é", "ing", "a", "B"]) for _ in range(r.randint(1, 4))) for _ in range(300)]
    texts = [" ".join(r.choice(vocab) for _ in range(r.randint(0, 120))) for _ in range(n)]
    for i in range(0, n - 8, 3):  # near copies
        w = texts[i].split(" ")
        for _ in range(len(w) // 25):
            w[r.randrange(len(w))] = r.choice(vocab)
        texts[i + 1] = " ".join(w)
    texts[3], texts[7] = texts[20], texts[20].replace(" ", "\n", 1) + " "
    texts[11] = texts[12] + " " + texts[13] * 2
    rows = list(enumerate(texts)) + [(100, None), (101, ""), (102, " \n"), (103, "x"), (104, "X"), (105, "ab " * 700)]
    return rows


EDGES = [(1, "same words here again and again"), (1, "same words here again and again"), (1, "other"), (None, "same words here again and again"), (None, None), (2, ""), (3, "Ünïcode 日本 😀 " * 40), (4, "a" * 9000)]


def frame(spark, rows):
    """With columns whose names operators use inside."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.selectExpr("doc_id", "text", "'en' AS lang", "'s' AS source", "0L AS n_chars", "1 AS body", "2 AS mark", "3 AS key", "4 AS node", "5 AS row", "6 AS kept", "7 AS n", "8 AS word", "9 AS base")


ALL = {
    "exact": lambda d: exact_dedup.exact_dedup(d),
    "ppm": lambda d: ppm.score_texts(d, F.col("doc_id") == 2),
    "chunks": lambda d: chunks.substring_dedup(d),
    "crf": lambda d: crf.quality(d, crf.LineField()),
    "suffixes": lambda d: suffixes.suffix_dedup(d),
    "bpe": lambda d: bpe.encode_decode(d, VOCABULARY),
    "pack": lambda d: packing.pack(d, VOCABULARY),
    "licenses": lambda d: licenses.license_scan(d, path_col="source"),
    "minhash": lambda d: minhash.near_duplicates(d),
    "langid": lambda d: langid.languages(d),
}


SAME, OTHER, NULL, EMPTY, WIDE, LONG = "same words here again and again", "other", None, "", EDGES[6][1], EDGES[7][1]
#: What each operator tells of EDGES: rows as (doc_id, ...) in any order.
TOLD = {
    "exact": (["doc_id", "keep_id", "group_size", "kept"], [(1, None, 3, False)] * 2 + [(1, 1, 1, True), (None, None, 3, True), (None, None, 2, True), (2, None, 2, False), (3, 3, 1, True), (4, 4, 1, True)]),
    "ppm": (["doc_id", "held_out", "n_tokens", "n_known"], [(1, False, 7, 7)] * 2 + [(1, False, 2, 2), (None, False, 7, 7), (None, False, 1, 1), (2, True, 1, 1), (3, False, 121, 121), (4, False, 2, 2)]),
    "chunks": (["doc_id", "n_bytes", "text"], [(1, 31, SAME)] * 2 + [(1, 5, OTHER), (None, 31, SAME), (None, 0, None), (2, 0, ""), (3, 880, None), (4, 9000, None)]),
    "crf": (["doc_id", "n_words", "base_failed", "kept"], [(1, 6, True, False)] * 2 + [(1, 1, True, False), (None, 6, True, False), (None, 0, True, False), (2, 0, True, False), (3, 120, True, False), (4, 1, True, False)]),
    "suffixes": (["doc_id", "n_bytes", "n_removed", "n_spans"], [(1, 31, 0, 0)] * 2 + [(1, 5, 0, 0), (None, 31, 0, 0), (None, 0, 0, 0), (2, 0, 0, 0), (3, 880, 858, 1), (4, 9000, 8999, 1)]),
    "bpe": (["doc_id", "decoded"], [(1, SAME.replace(" ", "</w> ") + "</w>")] * 2 + [(1, "other</w>"), (None, SAME.replace(" ", "</w> ") + "</w>"), (None, ""), (2, ""), (3, None), (4, None)]),
    "licenses": (["path", "license", "origin"], [("s", None, "none")] * 8),
    "minhash": (["doc_id", "n_shingles", "component_id", "kept"], [(1, 2, 1, True)] * 2 + [(1, 1, 1, True), (None, 2, 1, False), (None, 0, None, True), (2, 0, 2, True), (3, 3, 3, True), (4, 1, 4, True)]),
    "langid": (["doc_id", "held_out", "lang_pred"], [(1, False, "en")] * 3 + [(None, False, "en"), (None, False, "und"), (2, False, "und"), (3, False, "en"), (4, False, "en")]),
}


@pytest.mark.parametrize("name", ALL)
def test_edges(spark, name):
    rows = ALL[name](frame(spark, EDGES)).collect()
    if name == "pack":  # every row is packed whole, with its end
        by = collections.Counter()
        for r in rows:
            by[r.doc_id] += r.length
        assert by[None] == 7 + 1 and by[2] == 1 and by[1] == 7 + 7 + 2
    else:
        columns, want = TOLD[name]
        text = lambda r: tuple(None if c in ("text", "decoded") and r.doc_id in (3, 4) else r[c] for c in columns)
        assert sorted(map(str, map(text, rows))) == sorted(map(str, want))
    assert ALL[name](frame(spark, EDGES).limit(0)).collect() == []
    assert len(ALL[name](frame(spark, [(7, None)])).collect()) == 1


def test_exact_dedup(spark):
    rows = corpus()
    got = {r.doc_id: r for r in exact_dedup.exact_dedup(frame(spark, rows), capacity=4).collect()}
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[re.sub(SPACE, "", t or "")].append((-len(t or ""), i))
    for norm, members in groups.items():
        for _, i in members:
            r = got[i]
            assert (r.keep_id, r.group_size, r.kept) == (min(members)[1], len(members), i == min(members)[1])
            assert r.text_sha256 == hashlib.sha256(norm.encode()).hexdigest()


@pytest.mark.parametrize("capacity, small", [(3, 1 << 16), (3, 0), (10**6, 1 << 16)])
def test_extendible_index(spark, monkeypatch, capacity, small):
    monkeypatch.setattr(exact_dedup, "SMALL_DIRECTORY", small)
    monkeypatch.setattr(exact_dedup, "LEAST_HOT", 20)
    from realty_spark.llm.shared import Scratch

    rows = [*corpus(), *((500 + i, "hot text") for i in range(30))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    norm = df.select("doc_id", F.char_length(F.coalesce("text", F.lit(""))).alias("points"), exact_dedup.normalized(F.col("text")).alias("norm")).withColumn("key", F.xxhash64("norm"))
    keys = norm.groupBy("key").agg(F.count("*").alias("n"))
    index = exact_dedup.build_index(norm, keys, Scratch(spark, "t"), capacity)
    cells = {r.cell: r.bucket for r in index.directory.collect()}
    chains = index.chains.collect()
    prefix = lambda key, g: (key % (1 << 64)) >> (64 - g) if g else 0
    held = collections.Counter(r.bucket for r in chains)
    assert (index.depth == 0) == (capacity > 100) and set(cells.values()) == set(held) and max(held.values()) <= capacity
    for r in chains:
        g = r.bucket.bit_length() - 1
        assert cells[prefix(r.key, index.depth)] == r.bucket == (1 << g) + prefix(r.key, g)  # owners hold ranges of keys
        if g:  # one split less and it was overfull
            assert sum(prefix(x.key, g - 1) == prefix(r.key, g - 1) for x in chains) > capacity
    assert sum(x["group_size"] for r in chains for x in r.chain) == len(rows)
    assert [r.key for r in chains if r.hot] == [r.key for r in norm.filter("norm = 'hottext'").limit(1).collect()]
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_dedup(df, capacity=capacity).collect()}
    assert got == {(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_dedup(df).collect()} and len(got) == len(rows)
    files = index.chains.select(F.input_file_name().alias("f"), "bucket").distinct().groupBy("bucket").count()
    assert files.agg(F.max("count")).first()[0] == 1  # a bucket lies in one file


def test_ppm(spark, monkeypatch):
    for frequent in (250_000, 50):
        monkeypatch.setattr(ppm, "FREQUENT_WORDS", frequent)
        monkeypatch.setattr(ppm, "FREQUENT_PAIRS", frequent)
        rows = corpus()
        held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
        got = ppm.score_texts(frame(spark, rows), F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2).collect()
        docs = {i: ppm.tokens(t) + [b""] for i, t in rows}
        c = collections.Counter(w for i, ws in docs.items() if not held[i] for w in ws)
        total, kinds = sum(c.values()), len(c)
        trie = collections.defaultdict(collections.Counter)

        def pairs(w):
            s = b" \n" if w == b"" else b" " + w + b" "
            return [(s[max(0, i - ppm.ORDER) : i], s[i]) for i in range(1, len(s))]

        for w, n in c.items():
            for ctx, s in pairs(w):
                for k in range(len(ctx) + 1):
                    trie[ctx[len(ctx) - k :]][s] += n

        def cost(ctx, s):
            out, left_out = 0.0, set()
            for k in range(len(ctx), -1, -1):
                own = {x: n for x, n in trie.get(ctx[len(ctx) - k :], {}).items() if x not in left_out}
                if own and s in own:
                    return out + math.log10((2 * own[s] - 1) / (2 * sum(own.values())))
                if own:
                    out += math.log10(len(own) / (2 * sum(own.values())))
                    left_out |= set(own)
            return out - math.log10(256 - len(left_out))

        for r in got:
            ws = docs[r.doc_id]
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(ws), sum(c[w] > 0 for w in ws), total)
            assert r.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (total + kinds + 1)) for w in ws))
            assert r.score == pytest.approx(sum(cost(x, y) for w in ws for x, y in pairs(w)))


@pytest.mark.parametrize("frequent, piece, least_open", [(4_000_000, 1 << 20, 1000), (50, 64, 20)])
def test_ppm_reads_over_words(spark, monkeypatch, frequent, piece, least_open):
    monkeypatch.setattr(ppm, "LEAST_OPEN", least_open)
    monkeypatch.setattr(ppm, "MOST_OPEN", 4096 if least_open > 20 else 400)
    monkeypatch.setattr(ppm, "partitions", lambda spark: 100)
    monkeypatch.setattr(ppm, "ACROSS_PAIRS", frequent)
    monkeypatch.setattr(ppm, "PIECE", piece)
    rows = [*corpus(), (300, "the rain on the hill\nfalls on"), (301, "on hill falls rain the\non the"), (302, "the rain on the hill falls on")]
    held = {i: i % 7 == 2 or i > 300 for i, _ in rows}
    got = {r.doc_id: r for r in ppm.score_texts(frame(spark, rows), F.expr("doc_id % 7 = 2 OR doc_id > 300"), across=True).collect()}
    docs = {i: b"\xff" * ppm.ORDER + (t or "").encode().lower() + b"\xfe" for i, t in rows}
    trie = collections.defaultdict(collections.Counter)
    for i, s in docs.items():
        for p in range(ppm.ORDER, 0 if held[i] else len(s)):
            for k in range(ppm.ORDER + 1):
                trie[s[p - k : p]][s[p]] += 1

    def cost(ctx, s):
        out, left_out = 0.0, set()
        for k in range(len(ctx), -1, -1):
            own = {x: n for x, n in trie.get(ctx[len(ctx) - k :], {}).items() if x not in left_out}
            if own and s in own:
                return out + math.log10((2 * own[s] - 1) / (2 * sum(own.values())))
            if own:
                out += math.log10(len(own) / (2 * sum(own.values())))
                left_out |= set(own)
        return out - math.log10(256 - len(left_out))

    for i, s in docs.items():
        assert got[i].score == pytest.approx(sum(cost(s[p - ppm.ORDER : p], s[p]) for p in range(ppm.ORDER, len(s))))
    assert got[300].score > got[301].score + 1 and got[300].score != got[302].score
    assert got[301].base_score == pytest.approx(got[302].base_score)


@pytest.mark.parametrize("within", [{}, {"across": True}])
def test_ppm_long_word(spark, within):
    r = random.Random(9)
    text = "".join(r.choice("bcdfghjklmnpqrstvwxyz0123456789") for _ in range(60_000))
    got = ppm.score_texts(frame(spark, [(1, text)]), F.lit(True), **within).first()
    assert got.n_tokens == 2 and got.score == pytest.approx(-(60_001 if within else 60_002) * math.log10(256))


def test_ppm_query_tells_order(spark, tmp_path):
    from realty_spark.llm.queries import op2_ppm

    rows = [*corpus(), (200, "a bc\nd ef"), (201, "ef d bc a"), (202, "a bc d ef")]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.score for r in op2_ppm(spark, str(tmp_path)).collect()}
    assert len({got[200], got[201], got[202]}) == 3


def test_ppm_sums_to_one():
    words_ = [b"the", b"then", b"a", b"", b"on"]
    keys, sizes = ppm.pair_keys(words_)
    own, which = np.unique(keys, return_inverse=True)
    n = np.bincount(which)
    ones = np.zeros((256, 256), np.int64)
    np.add.at(ones, ((own >> 8) & 255, own & 255), n)
    context = int(own[-1]) >> 8
    every = np.unique(np.concatenate([own, (context << 8) + np.arange(256)]))
    counts = np.array([n[np.searchsorted(own, k)] if k in own else 0 for k in every])
    costs = ppm.code_lengths(every, counts, ones)
    assert (10 ** costs[every >> 8 == context]).sum() == pytest.approx(1)


@pytest.mark.parametrize("least_hot", [64, 1])
def test_chunks(spark, monkeypatch, least_hot):
    monkeypatch.setattr(chunks, "LEAST_HOT", least_hot)
    rows = corpus()
    rows[15] = (15, (rows[15][1] or "") + " . " + " ".join(f"w{i}x" for i in range(80)) + " . more")
    rows[25] = (25, "before that " + " ".join(f"w{i}x" for i in range(80)) + " . " + (rows[25][1] or ""))
    first, flagged = {}, collections.defaultdict(list)
    for i, t in sorted(rows):
        raw = (t or "").encode()
        ends = chunks.cuts(np.frombuffer(raw, np.uint8))
        assert [b - a <= chunks.MOST for a, b in zip([0, *ends], ends)].count(False) == 0 and (not raw or ends[-1] == len(raw))
        for k, (a, b) in enumerate(zip([0, *ends], ends)):
            if first.setdefault(raw[a:b], (i, k)) != (i, k):
                flagged[i].append(k)
    got = {r.doc_id: r for r in chunks.substring_dedup(frame(spark, rows)).collect()}
    for i, t in rows:
        text, spans = chunks.cut_out(t, np.array(flagged[i], int), chunks.LEAST_RUN) if t else (t, [])
        assert (got[i].text, got[i].n_spans, got[i].n_removed) == (text, len(spans), sum(b - a for a, b in spans))
    assert got[25].n_removed > 200 and got[15].n_removed == 0


def chunks_again(raw):
    """Byte by byte: a chunk ends at 16 bytes or more where the five upper bits of the rolling hash are zero, and at 1024 bytes."""
    h, start, out = 0, 0, []
    for i, b in enumerate(raw, 1):
        h = ((h << 1) + int(chunks._GEAR[b])) % 2**32
        if i - start == 1024 or i - start >= 16 and h < 2**27:
            out.append((start, i))
            start = i
    return out + [(start, len(raw))] * (start < len(raw))


def passages_cut(rows):
    """(text, n_bytes, n_removed, n_spans) by id: bytes of chunks seen before go where 96 or more of them follow each other."""
    seen, out = set(), {}
    for i, text in sorted(rows):
        raw = (text or "").encode()
        again = bytearray(len(raw))
        for a, b in chunks_again(raw):
            if raw[a:b] in seen:
                again[a:b] = b"r" * (b - a)
            seen.add(raw[a:b])
        gone = []
        for m in re.finditer(b"r+", bytes(again)):
            a, b = m.span()
            while a < b and 0x80 <= raw[a] < 0xC0:
                a += 1
            while a < b < len(raw) and 0x80 <= raw[b] < 0xC0:
                b -= 1
            if b - a >= 96:
                gone.append((a, b))
        kept = b"".join(bytes([c]) for k, c in enumerate(raw) if not any(a <= k < b for a, b in gone))
        out[i] = (None if text is None else kept.decode(), len(raw), sum(b - a for a, b in gone), len(gone))
    return out


def test_chunk_query_is_brute_force(spark, tmp_path):
    """Passages with letters of several bytes, in the middle, twice in one text, and cut short of the bound; whole tables."""
    passage = " ".join(f"été{i}日本" for i in range(60))
    rows = corpus() + [(200, "a " + passage + " b"), (201, "un " + passage + " deux " + passage), (202, passage[:30]), (203, "日" + passage[3:] * 2), (204, passage * 3)]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.text, r.n_bytes, r.n_removed, r.n_spans) for r in llm_queries.op3_substring_dedup(spark, str(tmp_path)).collect()}
    want = passages_cut(rows)
    assert got == want and want[201][3] >= 2 and sum(w[2] > 0 for w in want.values()) > 5


def test_stage_cuts_each_text_once(spark):
    """A filter on the cut texts is not answered by a second evaluation below it, and texts are dealt once."""
    import corpus_pipeline as P

    docs = frame(spark, corpus(n=30)).select("doc_id", "text", "lang", "source", "n_chars")
    for out in (P.substrings(spark, docs, ""), chunks.substring_dedup(docs)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.count("ArrowEvalPython [cleaned(") == 1
        assert not re.search("struct\\([^)]*text, text#", plan)


def test_gear_is_rolling():
    raw = np.frombuffer(random.Random(1).randbytes(300), np.uint8)
    h, want = 0, []
    for b in raw:
        h = ((h << 1) + int(chunks._GEAR[b])) & 0xFFFFFFFF
        want.append(h)
    assert chunks.gear(raw).tolist() == want


def test_line_counts(spark):
    rows = [*corpus(), (200, "a b c\na b c\n\n \na b c\n#x |y\na b c"), (201, "one two three four one two three")]
    for r in crf.quality(frame(spark, rows), crf.LineField()).collect():
        t = dict(rows)[r.doc_id] or ""
        w = words(t)
        tri = collections.Counter(zip(w, w[1:], w[2:]))
        covered = {i + j for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for j in range(3)}
        seen, dup = set(), 0
        for line in t.split("\n"):
            if words(line):
                dup += line in seen
                seen.add(line)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(covered))
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w))


def test_viterbi_and_fit():
    import itertools

    rng = np.random.default_rng(1)
    field = crf.LineField(pair=rng.normal(size=(2, 2)))
    for n in range(1, 8):
        s = rng.normal(size=(n, 2))
        score = lambda y: sum(s[i, y[i]] for i in range(n)) + sum(field.pair[a, b] for a, b in zip(y, y[1:]))
        assert score(field.viterbi(s)) == pytest.approx(max(map(score, itertools.product((0, 1), repeat=n))))
    make = lambda text: crf.lines_of(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())])).bins
    good, bad = make("The plain line of words goes on.\n" * 1 + "Another plain line follows here."), make("BUY!! NOW!! ###\n$$$ 12345 |||")
    learnt = crf.LineField.fit([(good, 1), (bad, 0)] * 20)
    assert learnt.viterbi(learnt.scores(good)) == [1, 1] and learnt.viterbi(learnt.scores(bad)) == [0, 0]


def repeating(seed=12):
    """A corpus whose passages come back in other surroundings, changed here and there, and overlap."""
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdeé ") for _ in range(r.randint(2, 7))) for _ in range(60)]
    passages = ["".join(r.choice(vocab) for _ in range(r.randint(20, 70))) for _ in range(6)]
    texts = []
    for _ in range(40):
        text = ""
        for _ in range(r.randint(1, 4)):
            p = r.choice(passages)
            a, b = sorted((r.randrange(len(p)), r.randrange(len(p))))
            part = list(p[a : b + 1])
            for _ in range(r.randint(0, 2)):
                part[r.randrange(len(part))] = r.choice("xyz")
            text += "".join(part) + r.choice(["", r.choice(vocab), "q"])
        texts.append(text)
    return list(enumerate(texts))


@pytest.mark.parametrize("most, make", [(20_000, corpus), (1, corpus), (20_000, repeating), (1, repeating)])
def test_suffix_dedup(spark, monkeypatch, most, make):
    monkeypatch.setattr(suffixes, "MOST", most)
    monkeypatch.setattr(suffixes, "PIECE", 700)
    rows = make()
    got = {r.doc_id: r for r in suffixes.suffix_dedup(frame(spark, rows)).collect()}
    seen = set()
    for i, t in sorted(rows):
        raw = (t or "").encode()
        covered = bytearray(len(raw))
        for p in range(len(raw) - 99):
            if raw[p : p + 100] in seen:
                covered[p : p + 100] = b"\1" * 100
            seen.add(raw[p : p + 100])
        kept = bytes(b for b, c in zip(raw, covered) if not c)
        spans = sum(c and not (k and covered[k - 1]) for k, c in enumerate(covered))
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == (len(raw), sum(covered), spans, hashlib.sha256(kept).hexdigest())


def windows_again(rows):
    """By brute force: of 168 bytes around anchors, in order of time, the bytes covered by windows over the anchor that an earlier row has at the same place."""
    out = []
    for i, x in enumerate(rows):
        hit = [j for j in range(suffixes._REACH + 1) if 0 not in x[68 - j : 168 - j] and any((x[68 - j : 168 - j] == y[68 - j : 168 - j]).all() for y in rows[:i])]
        out.append({k for j in hit for k in range(-j, 100 - j)})
    return out


def test_suffix_order_decides(monkeypatch):
    r = np.random.default_rng(3)
    rows = np.repeat(r.integers(98, 101, (6, 168)).astype(np.uint8), 12, 0)
    rows[:, 68:100] = 120
    for x in rows:
        x[r.integers(0, 68)] = r.integers(98, 101)
        x[r.integers(100, 168)] = r.integers(98, 101)
        if r.random() < 0.3:
            x[r.integers(140, 168) :] = 0
    r.shuffle(rows)

    def found(spans):
        got = [set() for _ in rows]
        for i, lo, hi in zip(*suffixes.ranges_of(rows, spans)):
            got[i].update(range(lo, hi))
        return got

    want = windows_again(rows)
    assert found(suffixes.HALVES) == want and sum(map(len, want)) > 1000
    narrow = [set().union(*x) for x in zip(*(found([span]) for span in suffixes.NARROW))]
    assert narrow == want
    monkeypatch.setattr(suffixes, "linear_grouping", lambda text: [len(text), *range(len(text))])
    assert found(suffixes.HALVES) != want


def test_field_gradient():
    """Likelihood by all labellings of short texts, and the gradient by finite differences."""
    import itertools

    rng = np.random.default_rng(5)
    texts = [(rng.integers(0, crf.BINS, (n, len(crf.FEATURES))).astype(np.uint8), int(y)) for n, y in ((1, 0), (4, 1), (3, 0), (2, 1), (4, 0))]
    sample = crf._Sample(texts)
    params = rng.normal(size=len(crf.FEATURES) * crf.BINS * 2 + 4) * 0.5
    loss, gradient = sample.objective(crf.LineField.of(params))
    field, want = crf.LineField.of(params), 0.0
    for bins, y in texts:
        s = field.scores(bins)
        score = lambda z: sum(s[i, z[i]] for i in range(len(s))) + sum(field.pair[a, b] for a, b in zip(z, z[1:]))
        every = math.log(sum(math.exp(score(z)) for z in itertools.product((0, 1), repeat=len(s))))
        want += (every - score([y] * len(s))) * (5 / (2 * sum(x[1] == y for x in texts))) / len(s) / 5
    assert loss == pytest.approx(want)
    for k in [*rng.integers(0, len(params) - 4, 12), *range(len(params) - 4, len(params))]:
        step = np.zeros(len(params))
        step[k] = 1e-5
        slope = (sample.objective(crf.LineField.of(params + step))[0] - sample.objective(crf.LineField.of(params - step))[0]) / 2e-5
        assert gradient[k] == pytest.approx(slope, abs=1e-7)


def test_fit_of_contrary_labels_and_long_texts(spark):
    """The lower of contrary labels counts, whatever the order of rows; texts with more lines than allowed are not learnt from."""
    docs = [(i, "\n".join(["A plain sentence of words, which ends here."] * 5) if i % 2 else "BUY | NOW | 99\n" * 5) for i in range(40)]
    labels = [(i, i % 2, 0) for i in range(40)]
    fitted = lambda d, q, **k: crf.fit(spark.createDataFrame(d, "doc_id long, text string"), spark.createDataFrame(q, "doc_id long, quality int, toxic int"), **k)
    plain = fitted(docs, labels)
    for extra in ([(1, 0, 0)], []):
        one, two = fitted(docs, labels + extra), fitted(docs, (extra + labels)[::-1])
        assert np.array_equal(one.unary, two.unary) and np.array_equal(one.pair, two.pair)
        assert np.array_equal(one.unary, plain.unary) == (not extra)
    long = fitted(docs + [(90, "word\n" * 60), (91, None)], labels + [(90, 1, 0), (91, 0, 0), (None, 1, 0), (3, None, 0)], most_lines=50)
    assert np.allclose(long.unary, fitted(docs + [(91, None)], labels + [(91, 0, 0)]).unary)


def test_linear_grouping():
    r = random.Random(4)
    for _ in range(500):
        t = [r.randint(1, r.randint(1, 4)) for _ in range(r.randint(0, 25))] * r.randint(1, 3)
        s = [*t, 0]
        assert suffixes.linear_grouping(t) == sorted(range(len(s)), key=lambda i: s[i:])


def test_bpe_is_the_tokenizer(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(VOCABULARY)
    r = random.Random(3)
    odd = ["", "a<|endoftext|>b <|ENDOFTEXT|>", "ΟΔΥΣΣΕΥΣ İ ﬁ é", "I'll 'S 123½", "\x1ca\x85b\xa0c", "日本 😀", "ab" * 900, "!" * 70]
    odd += ["".join(r.choice("aAbé'ßΣ0१!?<|> \n\x1c　́") for _ in range(30)) for _ in range(300)]
    got = {x.doc_id: x for x in bpe.encode_decode(frame(spark, list(enumerate(odd))), VOCABULARY).collect()}
    for i, s in enumerate(odd):
        ids = t.encode(s, add_special_tokens=False).ids
        assert np.frombuffer(bytes(got[i].ids), "<u4").tolist() == ids and got[i].n_tokens == len(ids)
        assert got[i].decoded == t.decode(ids, skip_special_tokens=False)


def test_ids_of_a_batch_are_gathered(monkeypatch):
    """Ids by distinct words, two bytes each, against the library: words of all kinds, in parts, with a table of words that starts anew."""
    from tokenizers import Tokenizer

    r = random.Random(4)
    texts = [None, "", "\n", "I'll 'S it's", "a1b22²x ªº µ_ʰ ɏ ɐ", "ΟΔΥΣΣΕΥΣ İ ﬁ é", "<|endoftext|>a <|startoftext|>", "日本 😀", "\x1ca\x85b", "word. word, word*** " * 50, "ab" * 900]
    texts += ["".join(r.choice("aAbé'ßΣ0१!?<|> \n\x1c　́²ªɏɐ_") for _ in range(40)) for _ in range(200)] + [None]
    ids = [x.ids for x in Tokenizer.from_file(VOCABULARY).encode_batch([x or "" for x in texts], add_special_tokens=False)]
    coder = bpe.ForcedBoundaryBpe(VOCABULARY, False)
    assert coder.width == 2
    for gathered, entries in ((bpe.GATHERED, bpe.MAX_ENTRIES), (7, 1)):
        monkeypatch.setattr(bpe, "GATHERED", gathered)
        monkeypatch.setattr(bpe, "MAX_ENTRIES", entries)
        assert [np.frombuffer(x, "<u2").tolist() for x in coder.encode_ids(texts)] == ids
        assert [np.frombuffer(x, "<u2").tolist() for x in coder.encode_ids(texts[3:9])] == ids[3:9]
    assert coder.encode_ids([None]) == [b""]


def test_packing(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(VOCABULARY)
    rows = corpus(n=60)
    df = frame(spark, rows).withColumn("source", F.expr("CASE WHEN doc_id % 3 = 0 THEN 'hot' WHEN doc_id % 7 = 1 THEN NULL ELSE concat('s', doc_id % 4) END")).repartition(3)
    ids = {i: t.encode(x or "", add_special_tokens=False).ids + [1] for i, x in rows}
    for targets in (None, {"hot": 1, "s1": 5}):
        got = packing.pack(df, VOCABULARY, targets=targets, length=64, window=256).collect()
        by_doc, by_seq = collections.defaultdict(list), collections.defaultdict(list)
        for r in got:
            by_doc[r.doc_id].append(r)
            by_seq[r.sequence_id].append(r)
            assert np.frombuffer(bytes(r.ids), "<u4").tolist() == ids[r.doc_id][r.start : r.start + r.length]
        for i, own in ids.items():
            pieces = sorted(by_doc[i], key=lambda r: r.start)
            assert [p.start for p in pieces] == [0, *np.cumsum([p.length for p in pieces])[:-1]] and sum(p.length for p in pieces) == len(own)
        sizes = []
        for k in sorted(by_seq):
            pieces = sorted(by_seq[k], key=lambda r: r.offset)
            assert [p.offset for p in pieces] == [0, *np.cumsum([p.length for p in pieces])[:-1]]
            sizes.append(sum(p.length for p in pieces))
        assert all(x == 64 or x & (x - 1) == 0 for x in sizes) and sizes.count(64) == sum(map(len, ids.values())) // 64


def test_packing_holds_targets(spark, monkeypatch):
    """Windows have the target proportions while all sources last, whatever their sizes; sources share queues beyond the bound."""
    rows = [(i, "word " * 50, "abc"[min(i % 7, 2)]) for i in range(140)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = packing.pack(df, VOCABULARY, targets={"a": 3, "b": 2, "c": 1}, length=64, window=256)
    tokens = {(r.window, r.source): r.tokens for r in packing.mixture(got, 64, 256).collect()}
    for w in range(7):
        assert sum(tokens[w, s] for s in "abc") == 256
        assert all(abs(sum(tokens[v, s] for v in range(w + 1)) - (w + 1) * 256 * share / 6) <= 1 for s, share in (("a", 3), ("b", 2), ("c", 1)))
    schedule = packing.Schedule([1020, 1020, 5100], [3, 2, 1], 256, 64)
    assert all(abs(d) < 1 for w in range(7) for d in schedule.deficits(w)) and any(schedule.deficits(1))
    monkeypatch.setattr(packing, "MAX_SOURCES", 2)
    monkeypatch.setattr(packing, "REMEMBERED", 3)
    merged = packing.pack(df, VOCABULARY, length=64, window=256).collect()
    assert sum(r.length for r in merged) == 140 * 51 and {r.source for r in merged} == set("abc")


def test_any_number_of_sources_keeps_its_queues(spark, monkeypatch):
    """The pieces are the same whether the driver holds the sources or Spark sorts their tokens: nulls, equal sizes, weights of all kinds, repeated rows, one source apart."""
    r = random.Random(8)
    names = [None, "", "é", "b", "a", "Z", "\U0001f600", "\uffee"]
    rows = [(i, None if i == 9 else "word " * (i % 5 * 9), names[i % 8]) for i in range(120)] + [(7, "x " * 700, "a"), (7, "x " * 700, "a"), (None, "y", "once")]
    rows += [(1000 + i, "".join(r.choice("ab c") for _ in range(60)), f"s{r.randrange(9)}") for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    table = tempfile.mkdtemp() + "/documents"  # so that all calls read the same partitions
    df.write.parquet(table)
    df = spark.read.parquet(table)
    for targets in (None, {None: 5, "": 2, "a": 3}, lambda s: (1 << 47) + 2 * len(s or "") if s != "b" else 1 << 40):
        pieces = lambda: sorted(map(repr, packing.pack(df, VOCABULARY, targets=targets, length=64, window=256).collect()))  # noqa: E731, B023
        few = pieces()
        with monkeypatch.context() as m:
            m.setattr(packing, "MAX_SOURCES", 3)
            m.setattr(packing, "TIMED", 50)
            assert pieces() == few
    heavy = (1 << 31) - 1, (1 << 50) + 1, 3, 1 << 20
    for w in heavy:
        got = [a << 62 | b >> 1 for a, b in zip(*(x.tolist() for x in packing.times(5, 40, w)))]
        assert got == [(2 * k + 1) * (1 << 62) // w for k in range(5, 45)]


def test_mixture_query_serves_token_by_token(spark, tmp_path, monkeypatch):
    """The query against a queue served one token at a time: the next goes to the source that has the least for its weight."""
    from tokenizers import Tokenizer

    rows = [(i, None if i == 5 else f"word {i} " * (i % 90), None if i % 11 == 0 else f"s{i % 5}" if i % 3 else "hot") for i in range(400)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6).write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("pack", "mixture"):
        monkeypatch.setattr(llm_queries, name, functools.partial(getattr(packing, name), length=64, window=1024))
    got = {(r.window, r.source): r.tokens for r in llm_queries.packing_mixture(spark, str(tmp_path)).collect()}
    t, left = Tokenizer.from_file(VOCABULARY), collections.Counter()
    for _, text, source in rows:
        left[source] += len(t.encode(text or "", add_special_tokens=False).ids) + 1
    assert {s: sum(n for (_, x), n in got.items() if x == s) for s in left} == left
    weight = {s: 1 + zlib.crc32((s or "").encode()) % 4 for s in left}
    heap, so_far, served = [(fractions.Fraction(1, 2 * weight[s]), s or "", s) for s in left], collections.Counter(), 0
    heapq.heapify(heap)
    windows = sum(left.values()) // 1024
    assert windows > 10
    for w in range(windows):
        for _ in range(1024):
            _, name, s = heapq.heappop(heap)
            so_far[s] += 1
            if so_far[s] < left[s]:
                heapq.heappush(heap, (fractions.Fraction(2 * so_far[s] + 1, 2 * weight[s]), name, s))
        assert sum(got.get((w, s), 0) for s in left) == 1024
        assert all(abs(sum(got.get((v, s), 0) for v in range(w + 1)) - so_far[s]) <= 1 for s in left)


def test_windows_hold_the_mixture():
    s = packing.Schedule([5000, 3000, 2000], [5000, 3000, 2000], window=100, length=20)
    for w in range(100):
        took = [b - a for a, b in zip(s.given(w), s.given(w + 1))]
        assert sum(took) == 100 and all(abs(x - y) <= 1 for x, y in zip(took, (50, 30, 20)))
    dry = packing.Schedule([100, 1000], [3, 1], window=100, length=20)
    assert dry.given(1) == [75, 25] and dry.given(11) == [100, 1000]


def test_licenses(spark):
    rows = [("a/LICENSE", "Released under the MIT License."), ("a/x.py", "code"), ("a/b/c/y.py", "code"), ("a/b/COPYING.txt", "Licensed under CC BY-NC 4.0."), ("a/b/z.py", "x\nLicensed under the Apache License, Version 2.0.\n"), ("q.py", "no licence text"), ("ab/x", None)]
    got = {r.path: (r.license, r.origin) for r in licenses.license_scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert got == {
        "a/LICENSE": ("MIT", "own"), "a/x.py": ("MIT", "inherited"), "a/b/c/y.py": ("CC-BY-NC-4.0", "inherited"), "a/b/COPYING.txt": ("CC-BY-NC-4.0", "own"),
        "a/b/z.py": ("Apache-2.0", "own"), "q.py": (None, "none"), "ab/x": (None, "none"),
    }


def test_license_edges(spark):
    """Null paths are one file in no directory; ties go to the first name; of a directory's licence files the better score counts."""
    rows = [
        (None, "Released under the MIT License."), (None, None), ("LICENSE", "Licensed under CC BY-SA 4.0."), ("x", ""), ("a/LICENSE", "Released under the MIT License."), ("a/COPYING", "x\nLicensed under CC BY-NC 4.0.\nsome more"),
        ("t/NOTICE", "Released under the MIT License.\nLicensed under CC BY-NC 4.0."), ("t/LICENSE", "Licensed under CC BY-NC 4.0.\nReleased under the MIT License."), ("t/x", "y"), ("a/b/c/d.py", None), ("a/x", "one"), ("a/x", "All rights reserved."),
    ]
    got = collections.defaultdict(list)
    for r in licenses.license_scan(spark.createDataFrame(rows, "path string, text string")).collect():
        got[r.path].append((r.license, r.origin, r.license_dir))
    assert got == {
        None: [("MIT", "own", None)] * 2, "LICENSE": [("CC-BY-SA-4.0", "own", None)], "x": [("CC-BY-SA-4.0", "inherited", "")], "a/LICENSE": [("MIT", "own", None)], "a/COPYING": [("CC-BY-NC-4.0", "own", None)],
        "t/NOTICE": [("CC-BY-NC-4.0", "own", None)], "t/LICENSE": [("CC-BY-NC-4.0", "own", None)], "t/x": [("CC-BY-NC-4.0", "inherited", "t")], "a/b/c/d.py": [("CC-BY-NC-4.0", "inherited", "a")],
        "a/x": [("proprietary", "own", None)] * 2,
    }


def test_license_query_inherits(spark, tmp_path):
    """The query against its SQL on files with whole licence texts; licences are inherited from several depths."""
    import duckdb

    from realty_spark.llm.queries import license_sql, op8_license_scan

    mit, gpl = licenses._MIT + "\n\n" + licenses._WARRANTY, next(t for n, t in licenses.TEXTS if n == "GPL-3.0")
    texts = {0: "words\nReleased under the MIT License.", 8: "\n".join(["# Copyright 2020 Jane", *("# " + x for x in re.findall(".{1,60}(?: |$)", gpl))]) + "\nimport os", 60: mit + "\nAll rights reserved.", 64: "a\nLicensed under CC BY-NC 4.0.", 122: "b\nLicensed under the Apache License, Version 2.0.", 7: None, 9: ""}
    rows = [(i, texts.get(i, f"text {i}"), "s") for i in range(200)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = op8_license_scan(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(license_sql()).df()[got.columns]
    assert sorted(map(str, want.astype(object).where(want.notna(), None).itertuples(index=False, name=None))) == sorted(str(tuple(r)) for r in got.collect())
    seen = {(r.origin, r.license_dir) for r in got.collect()}
    assert {d.count("/") for o, d in seen if o == "inherited"} >= {1, 2} and next(r for r in got.collect() if r.doc_id == 60).license == "MIT"
    assert next(r for r in got.collect() if r.doc_id == 8).license == "GPL-3.0"


@pytest.mark.parametrize("templates", [licenses.TEMPLATES, licenses.TEXTS])
def test_no_notice_is_passed_over(templates):
    """Whatever comes close to a template has a telling term, or function words alone."""
    r, least = random.Random(2), licenses.LEAST_SCORE
    idf, other = licenses.inverse_frequencies(templates)
    known, vectors = set(licenses.telling_terms(templates, least)), collections.defaultdict(dict)
    for term, i, _, weight in licenses.weights(templates):
        vectors[i][term] = weight
    close = 0
    for _ in range(4000):
        i = r.randrange(len(templates))
        own = licenses.terms(templates[i][1])
        text = [t for t in own if r.random() < 0.8 and (t not in known or r.random() < r.choice([0, 0.3, 1]))] + r.choices(["the", "zq", "of", *own], k=r.randint(0, 6))
        x = {t: n * idf.get(t, other) for t, n in collections.Counter(text).items()}
        norm = math.sqrt(sum(v * v for v in x.values())) or 1
        if max(sum(v * w.get(t, 0) for t, v in x.items()) / norm for w in vectors.values()) >= least:
            close += 1
            assert known & set(text) or set(text) <= licenses.STOP | {"zq"}, text
    assert close > 300


def test_notices_without_the_word_licence(spark):
    rows = [("a/x", "code\n# Permission is hereby granted, free of charge, to any person obtaining a copy of this software, to deal in the Software without restriction.\n"), ("a/y", "# Apache, Version 2.0\n# Licensed under the Apache, Version 2.0\n"), ("a/z", "the version of the file that was found")]
    got = {x.path: (x.own_license, x.origin) for x in licenses.license_scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert got["a/x"] == ("MIT", "own") and got["a/y"][0] == "Apache-2.0" and got["a/z"] == (None, "none")


def test_license_texts(spark):
    L = licenses
    lines = lambda t, sign="": "\n".join(sign + " ".join(t.split()[i : i + 11]) for i in range(0, len(t.split()), 11))
    gpl3 = dict((n, t) for n, t in L.TEXTS if t.startswith("This program") and n == "GPL-3.0")["GPL-3.0"]
    more = "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY."
    mit = "MIT License\n\nCopyright (c) 2021 Jane Example\n\n" + lines(L._MIT) + "\n\nThe above copyright notice and this permission notice shall be included in all\ncopies or substantial portions of the Software.\n\n" + lines(L._WARRANTY)
    bsd = "Copyright (c) 2019, Example Org\nAll rights reserved.\n\n"
    three = L._CLAUSE.replace("the copyright holder", "Example Org")
    rows = [
        ("m/LICENSE", mit), ("m/x.py", "code"),
        ("b/LICENSE", bsd + "\n\n".join(map(lines, (L._BSD, three, L._BSD_WARRANTY)))), ("b/x.py", "code"),
        ("two/COPYING", bsd + "\n\n".join(map(lines, (L._BSD, L._BSD_WARRANTY)))),
        ("g/a.c", "/*\n * Copyright (C) 2020 Jane Example\n *\n" + lines(gpl3, " * ") + "\n *\n" + lines(more, " * ") + "\n */\nint main;"),
        ("h/a.py", "# Copyright 2020 Jane Example\n" + lines(gpl3, "# ") + "\nimport os\n"),
        ("g/COPYING", "GNU GENERAL PUBLIC LICENSE\n Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc.\n Everyone is permitted to copy and distribute verbatim copies\n of this license document, but changing it is not allowed.\n\n" + "The GNU General Public License is a free, copyleft license for software and other kinds of works.\n\n" * 3),
        ("a/LICENSE", "Apache License\n Version 2.0, January 2004\n http://www.apache.org/licenses/\n\n TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION\n\n 1. Definitions.\n"), ("a/x", None),
        ("r/x", "All rights reserved."), ("n/x", "one may not speak of a license here"),
    ]
    got = {r.path: (r.license, r.origin) for r in L.license_scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert got == {
        "m/LICENSE": ("MIT", "own"), "m/x.py": ("MIT", "inherited"), "b/LICENSE": ("BSD-3-Clause", "own"), "b/x.py": ("BSD-3-Clause", "inherited"),
        "two/COPYING": ("BSD-2-Clause", "own"), "g/a.c": ("GPL-3.0", "own"), "h/a.py": ("GPL-3.0", "own"), "g/COPYING": ("GPL-3.0", "own"),
        "a/LICENSE": ("Apache-2.0", "own"), "a/x": ("Apache-2.0", "inherited"), "r/x": ("proprietary", "own"), "n/x": (None, "none"),
    }


@pytest.mark.parametrize("block", [2048, 2])
def test_near_duplicates(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    rows = corpus(n=60)
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t in rows:
        w = words((t or "").translate(low))
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(frame(spark, rows)).collect()}
    assert got == {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}


@pytest.mark.parametrize("n", [128, 1024])
def test_signatures_hold_little(n):
    import tracemalloc

    from realty_spark.llm.words import shingle_sets

    r = np.random.default_rng(4)
    sets, at = np.sort(r.integers(0, 1 << 63, 7000, dtype=np.uint64)), np.array([0, 5000, 5000, 5001, 7000])
    tracemalloc.start()
    got = minhash.signatures(sets, at, n)
    assert tracemalloc.get_traced_memory()[1] < 16 << 20
    a, b = minhash.hash_family(n)
    for x, p, q in zip(got, at, at[1:]):
        want = [min(((v * i + j) % 2**64 >> 32 for v in sets[p:q].tolist()), default=0xFFFFFFFF) for i, j in list(zip(a.tolist(), b.tolist()))[:8]]
        assert x[:8].tolist() == want
    tracemalloc.reset_peak()
    before = tracemalloc.get_traced_memory()[0]
    raw = np.frombuffer(b"word and word " * 150_000, np.uint8)
    shingle_sets(raw, np.array([0, len(raw)]))
    peak = tracemalloc.get_traced_memory()[1] - before
    tracemalloc.stop()
    assert peak < 40 << 20


def test_hashes_of_words_do_not_depend_on_the_step():
    from realty_spark.llm.words import word_hashes, word_spans

    raw = np.frombuffer(b" ".join(b"ab" * (i % 7) + b"c" * (i % 5) for i in range(400)) + b" " + b"x" * 900, np.uint8)
    starts, ends, _ = word_spans(raw, np.array([0, len(raw)]))
    whole = word_hashes(raw, starts, ends)
    assert all((word_hashes(raw, starts, ends, step) == whole).all() for step in (1, 50, 700))


def test_components(spark):
    import uuid

    from realty_spark.llm.shared import Scratch

    r = random.Random(6)
    name = lambda i: i.to_bytes(4, "big")
    edges = [(i, i + 1) for i in range(60) if i % 20 != 19] + [(r.randint(70, 99), r.randint(70, 99)) for _ in range(40)]
    df = spark.createDataFrame([(name(a), name(b)) for a, b in edges], "u binary, v binary")
    got = {bytes(x.node): bytes(x.root) for x in minhash.components(df, Scratch(spark, "t"), uuid.uuid4().hex).collect()}
    parent = {i: i for e in edges for i in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    alone = {a for a in parent if all(x == y for x, y in edges if a in (x, y))}
    assert got == {name(i): name(find(i)) for i in parent if i not in alone}


def test_language_models(spark):
    r = random.Random(8)
    lands = {"xx": ["ka", "mo", "ti", "ra"], "yy": ["über", "sch", "en", "ge"]}
    text = lambda k: " ".join("".join(r.choice(lands[k]) for _ in range(r.randint(1, 3))) for _ in range(30))
    rows = [(i, text(k), k) for i, k in enumerate(r.choice(list(lands)) for _ in range(200))] + [(900, "123 !?", "xx"), (901, None, "yy"), (902, "日本語の文章です" * 9, "xx")]
    got = {x.doc_id: x for x in langid.languages(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert sum(got[i].lang_pred == k for i, _, k in rows[:200]) >= 199
    assert all(0 <= x.score <= 1 for x in got.values()) and not any(got[i].rejected for i in range(200))
    assert got[900].lang_pred == got[901].lang_pred == "und" and got[902].rejected
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, _, _ in rows)


def kneser_ney(texts):
    """Interpolated Kneser-Ney by dictionaries of strings; returns the probability of a character after the three before it."""
    plain = lambda t: "   " + (" ".join(re.findall(r"[^\W\d_]+", t.lower())) + " ").lstrip()
    counts = {4: collections.Counter(s[i - 3 : i + 1] for s in map(plain, texts) for i in range(3, len(s)))}
    for k in (3, 2, 1):
        counts[k] = collections.Counter(g[1:] for g in counts[k + 1])

    def discount(k):
        once, twice = (sum(n == x for n in counts[k].values()) for x in (1, 2))
        return once / (once + 2 * twice) if once and twice else 0.5

    def probability(gram):
        k = len(gram)
        if not k:
            return 1 / 65536
        after = {g: n for g, n in counts[k].items() if g[:-1] == gram[:-1]}
        if not after:
            return probability(gram[1:])
        d, total = discount(k), sum(after.values())
        return max(counts[k][gram] - d, 0) / total + d * len(after) / total * probability(gram[1:])

    return plain, probability


def test_kneser_ney_is_brute_force():
    learnt = {"xx": ["Abra kadabra, abra!", "barbar abra 12 kad"], "yy": ["über den Bach", "den den Über-bach"]}
    model = langid.Identifier({k: langid.KneserNey.fit(t) for k, t in learnt.items()})
    texts = ["abra den!! 3 Bach", "zzz", "kadabra " * 20, "a", "!?"]
    for step in (langid.STEP, 5):
        langid.STEP, kept = step, langid.STEP
        entropy, square, n, letters = model.entropies(texts)
        langid.STEP = kept
        for j, lang in enumerate(sorted(learnt)):
            plain, probability = kneser_ney(learnt[lang])
            for i, t in enumerate(texts[:4]):
                s = plain(t)
                logs = [math.log10(probability(s[p - 3 : p + 1])) for p in range(3, len(s))]
                assert n[i] == len(logs) and entropy[i, j] == pytest.approx(-sum(logs) / len(logs), rel=1e-5)
                assert square[i, j] == pytest.approx(sum(x * x for x in logs) / len(logs), rel=1e-5)
    assert letters.tolist() == [11, 3, 140, 1, 0]


def test_mislabelled_texts_do_not_calibrate():
    r = random.Random(3)
    make = {"xx": lambda: " ".join("".join(r.choice(["ka", "mo", "ti"]) for _ in range(3)) for _ in range(20)), "yy": lambda: " ".join("".join(r.choice(["sch", "en", "ge"]) for _ in range(3)) for _ in range(20))}
    models = {k: langid.KneserNey.fit([f() for _ in range(40)]) for k, f in make.items()}
    clean, dirty = langid.Identifier(models), langid.Identifier(models)
    checked = {k: [f() for _ in range(20)] for k, f in make.items()}
    clean.calibrate(checked)
    dirty.calibrate(checked | {"xx": [*checked["xx"], make["yy"]()]})
    assert dirty.limit == clean.limit and dirty.predict(["lorem ipsum dolor sit amet " * 5])[2][0]


def test_kneser_ney_sums_to_one():
    m = langid.KneserNey.fit(["abra kadabra", "barbar abra"])
    chars = np.arange(1, 1 << 16, dtype=np.uint64)
    for context in ("ab", "xy", "  a"):
        key = np.uint64(0)
        for c in context:
            key = key << np.uint64(16) | np.uint64(ord(c))
        order = len(context) + 1
        p = m.probabilities((key << np.uint64(16)) | chars, order)
        assert p.sum() == pytest.approx(1, abs=1e-3)


def test_pipeline(spark):
    import corpus_pipeline as P

    rows = corpus(n=30)
    docs = frame(spark, rows).select("doc_id", "text", "lang", "source", "n_chars")
    kept = []
    for name, stage in P.STAGES:
        out = stage(spark, docs, "")
        if name != "packing":
            assert out.columns == docs.columns
            kept.append({r.doc_id: r.text for r in out.collect()})
            docs = spark.createDataFrame(out.collect(), docs.schema)
    language, exact, near, cut = kept
    texts = dict(rows)
    odd = frame(spark, EDGES).withColumnsRenamed({"row": "kept_id", "kept": "__told", "n": "text_key", "word": "kept_key", "base": "told", "key": "text_sha256"})
    for name, stage in P.STAGES:
        got = stage(spark, odd, "").collect()
        assert stage(spark, odd.limit(0), "").collect() == []
        ids = [r.doc_id for r in got]
        assert name == "packing" or set(got[0].asDict()) == set(odd.columns)
        if name == "language_id":
            assert len(got) == 6 and all(re.search("[^\\W\\d_]", r.text) for r in got)
        elif name == "exact_dedup":  # of the repeated text the row without id stays, and of the empty ones too
            assert sorted(ids, key=lambda i: (i is not None, i)) == [None, None, 1, 3, 4]
        elif name == "near_dedup":  # all rows of one id and text
            assert sorted(ids, key=lambda i: (i is not None, i)) == [None, 1, 1, 1, 2, 3, 4]
        elif name == "substring_dedup":
            assert len(got) == len(EDGES)
    assert language.keys() == {i for i, t in rows if re.search("[^\\W\\d_]", t or "")}
    groups = collections.defaultdict(list)
    for i in language:
        groups[re.sub(SPACE, "", texts[i])].append((-len(texts[i]), i))
    assert exact.keys() == {min(g)[1] for g in groups.values()}
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets, parent = {}, {i: i for i in exact}
    for i in exact:
        w = words(texts[i].translate(low))
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    assert near.keys() == {i for i in exact if find(i) == i} and len(near) < len(exact)
    first, flagged = {}, collections.defaultdict(list)
    for i in sorted(near):
        raw = texts[i].encode()
        ends = chunks.cuts(np.frombuffer(raw, np.uint8))
        for k, (a, b) in enumerate(zip([0, *ends], ends)):
            if first.setdefault(raw[a:b], (i, k)) != (i, k):
                flagged[i].append(k)
    want = {i: chunks.cut_out(texts[i], np.array(flagged[i], int), chunks.LEAST_RUN)[0] for i in near}
    assert cut == {i: t for i, t in want.items() if t == texts[i] or words(t)}
    assert out.agg(F.sum("length")).first()[0] == out.select("doc_id", "doc_tokens").distinct().agg(F.sum("doc_tokens")).first()[0]
