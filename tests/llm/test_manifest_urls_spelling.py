"""The manifest, the URL filter and the spelling variants against brute force, and on nulls, empties, ties, repeats and clashing column names."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("realty_spark.llm")

from realty_spark.llm import manifest, shared, spelling, urls  # noqa: E402
from realty_spark.llm import queries as Q  # noqa: E402


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(leaves):
    """The root and, for each leaf, its siblings left and right level by level."""
    paths, nodes, places = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(nodes) > 1:
        for j, p in enumerate(places):
            first = p // 3 * 3
            paths[j].append((nodes[first:p], nodes[p + 1 : first + 3]))
        nodes = [digest(*nodes[k : k + 3]) for k in range(0, len(nodes), 3)]
        places = [p // 3 for p in places]
    return nodes[0], paths


def whole(rows):
    """(group, id) of each row to leaf, subroot, root and proof."""
    groups = collections.defaultdict(list)
    for s, i in rows:
        groups[s].append(i)
    found = []
    for s in sorted(groups, key=lambda s: (s is not None, (s or "").encode())):
        ids = sorted(groups[s], key=lambda i: (i is not None, i))
        leaves = [digest(str(i)) for i in ids]
        found.append((s, ids, leaves, *tree(leaves)))
    root, tops = tree([sub for _, _, _, sub, _ in found])
    return sorted((str((s, i)), leaf, sub, root, path + top) for (s, ids, leaves, sub, paths), top in zip(found, tops) for i, leaf, path in zip(ids, leaves, paths)), root


@pytest.mark.parametrize("sizes, digits", [([1], 2), ([1, 2, 3, 4, 9, 10, 28, 83], 2), ([5] * 11, 1), ([800, 30], 6), ([1] * 5, 2)])
def test_manifest(spark, sizes, digits):
    r = random.Random(1)
    rows = [(None if k == 0 else f"s{k}", i) for k, n in enumerate(sizes) for i in r.sample(range(10**6), n)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "source string, doc_id long").withColumns({"tree": F.lit(1), "rank": F.lit(2), "digest": F.lit(3), "block": F.lit(4)})
    made = manifest.manifest(df, F.sha2(F.col("doc_id").cast("string"), 256), F.col("source"), F.col("doc_id"), [F.col("source"), F.col("doc_id")], digits)
    got = made.withColumn("back", manifest.folded(F.col("leaf"), F.col("proof"))).collect()
    want, root = whole(rows)
    assert sorted((str((x.source, x.doc_id)), x.leaf, x.subroot, x.root, [(list(s.left), list(s.right)) for s in x.proof]) for x in got) == want
    assert {x.back for x in got} == {root}


def manifest_rows(spark, rows, tmp_path):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df.withColumns({"kids": F.lit(1), "n": F.lit(1), "leaf": F.lit("x"), "root": F.lit("y")}).write.parquet(f"{tmp_path}/documents.parquet")
    return Q.op11_manifest(spark, str(tmp_path)).collect()


def test_manifest_edges(spark, tmp_path):
    """Nulls in any column, an empty and a long text, a tie of ids, rows that repeat as a whole."""
    rows = [
        (1, "a\nb", "en", "s", 3), (1, "a\nb", "en", "s", 3), (1, "c", "en", "s", 1), (None, "d\n", "en", "s", 2), (2, None, None, None, None), (3, "", "en", "é", 0),
        (4, "x\n" * 5000, "de", "s", 10_000), (5, "\n", "de", "s", 1), (6, "ab\n", "de", "t", 3), (7, "\n\n", "de", "t", 2),
    ]
    enc = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, text: digest(*map(enc, (r[0], r[3], r[2], r[4], text)))
    groups = collections.defaultdict(list)
    for row in rows:
        groups[row[3]].append(row)
    want, subs = [], []
    for s in sorted(groups, key=lambda s: (s is not None, (s or "").encode())):
        own = sorted(groups[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
        subs.append((own, *tree([leaf(r, r[1]) for r in own])))
    root, tops = tree([x[1] for x in subs])
    for (own, sub, paths), top in zip(subs, tops):
        for r, path in zip(own, paths):
            proof = [x for left, right in path + top for x in left + right]
            altered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[1] is not None
            node = leaf(r, r[1].replace("\n", "") if altered else r[1])
            for left, right in path + top:
                node = digest(*left, node, *right)
            want.append((r[0], leaf(r, r[1]), sub, root, digest(*proof), node, node == root))
    got = manifest_rows(spark, rows, tmp_path)
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert {x.verified for x in got} == {True, False}


def test_manifest_of_nothing(spark, tmp_path):
    assert manifest_rows(spark, [], tmp_path) == []
    lone = manifest_rows(spark, [(7, None, None, None, None)], tmp_path / "one")
    assert lone[0].leaf == lone[0].root == lone[0].subroot and lone[0].proof_sha256 == digest() and lone[0].verified


# ---- URL filter

RULES = [
    *(urls.place_rule(n, v) for n, v in [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de", "block"), ("org", "allow"), ("b.net/", "allow")]),
    *map(urls.pattern_rule, ["||ads.", "/print/", "^sid=*x", ".pdf|", "|http://old.", "@@||ads.*/keep^", "a*b*c|", "utm"]),
]


def judged(url):
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match("[^/?#]*", rest)[0]
        path = re.match("[^?#]*", rest[len(host) :], re.S)[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    else:
        host = path = ""
    best = None
    for r in RULES:
        if r.place:
            h, slash, p = r.name.partition("/")
            if (host == h or host.endswith("." + h)) and path.startswith(slash + p) and (best is None or len(r.name) > len(best.name)):
                best = r
    if best:
        return host, path, best.name, best.verdict, None
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in url or "")
    found = [r for r in RULES if not r.place and re.search(r.regex.replace("\\z", "\\Z"), low)]
    hit = next((r for r in found if r.verdict == "allow"), found[0] if found else None)
    return host, path, None, hit.verdict if hit else "allow", hit.name if hit else None


URLS = [
    None, "", "no scheme/print/", "http://Example.NET/en/1", "http://example.net/EN/1", "http://net", "http://net/", "http://www.net/x", "http://xnet/", "http://a.b.net/", "http://b.net/", "http://b.net?x", "https://example.com/de",
    "https://example.com/deal", "https://example.com:80/de", "https://u@example.com/de", "https://a.org", "https://org?x=1", "https://a.org#f", "http://ads.x.fr/", "http://x.ads.fr/a/keep", "http://ads.fr/keeper", "http://ads.fr/keep/",
    "http://x.fr/print/1", "http://x.fr/print", "http://x.fr/?sid=12x", "http://x.fr/?asid=12x", "http://x.fr/a.PDF", "http://x.fr/a.pdf?x", "http://old.fr/", "http://x.fr/http://old.fr", "http://x.fr/a1b2c", "http://x.fr/UTMx", "ftp://é.fr/\n/print/",
    "http://x.fr/" + "a" * 5000, "://net/", "http://ex.fr://net/", "HTTP://ADS.FR/KEEP", "http://x.fr/%20/print/", "http://badsx.fr/", "http://x.fr/\x00",
]


@pytest.mark.parametrize("small", [100_000, 0])
def test_url_filter(spark, monkeypatch, small):
    monkeypatch.setattr(urls, "SMALL_INDEX", small)
    rows = [(i, u) for i, u in enumerate(URLS)] + [(1, "http://ads.fr/")] * 40 + [(None, None)] * 3 + [(None, "http://www.net/x")]
    df = spark.createDataFrame(rows, "page_id long, url string").repartition(3).withColumns({c: F.lit(1) for c in ("token", "rank", "n", "part", "k0", "place", "name", "verdict")})
    got = urls.url_filter(df, RULES)
    assert got.columns == ["page_id", "host", "path", "rule", "verdict", "pattern"]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(str((i, *judged(u))) for i, u in rows)
    assert urls.url_filter(df.limit(0), RULES).collect() == []
    assert {x.verdict for x in urls.url_filter(df, []).collect()} == {"allow"}


def test_rules_are_filed_under_their_rarest_token(spark):
    pages = spark.createDataFrame([(1, "http://a.example.com/print/1"), (2, "http://b.example.com/"), (3, "http://c.example.com/print/2"), (4, "http://d.example.com/rare/print/")], "page_id long, url string")
    rules = [urls.place_rule("example.com/print/", "block"), urls.pattern_rule("||example.com/rare/"), urls.pattern_rule("*x*"), urls.place_rule("example.com/pri", "block"), urls.pattern_rule("/none/print/")]
    index = {r.name: r.token for r in urls.rule_index(pages, "url", urls.rule_table(spark, rules)).collect()}
    assert index == {"example.com/print/": "print", "||example.com/rare/": "rare", "*x*": "", "example.com/pri": "com", "/none/print/": "none"}


def test_tokens_are_in_every_match(spark):
    """Whatever a rule matches has all of the rule's tokens."""
    r = random.Random(4)
    parts = ["http://", "ads", ".", "fr", "/", "print", "1", "-", "?", "sid", "=", "x", "keep", "%", "é", "utm", "net", "example", "com", "en"]
    for _ in range(20_000):
        url = "http://" + "".join(r.choice(parts) for _ in range(r.randint(1, 9)))
        have = set(re.split("[^a-z0-9]+", url.lower()))
        host = re.match("[^/?#]*", url[7:])[0]
        place = host + re.match("[^?#]*", url[7 + len(host) :])[0]
        for rule in RULES:
            if re.search(rule.regex.replace("\\z", "\\Z"), place if rule.place else url):
                assert set(rule.tokens) <= have, (rule, url)


# ---- spelling variants


def variants(rows):
    c = collections.Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            c[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    n = {w: k for w, k in c.items() if len(w) >= 7 and k >= 2}
    letters = sorted(set("".join(n)))
    near = {}
    for w in n:
        edits = {w[:p] + w[p + 1 :] for p in range(len(w))} | {w[:p] + a + w[p:] for p in range(len(w) + 1) for a in letters} | {w[:p] + a + w[p + 1 :] for p in range(len(w)) for a in letters}
        near[w] = {x for x in edits if x in n and x != w}
    form = {w: min(near[w], key=lambda x: (-n[x], x)) for w in n if near[w]}
    form = {w: f for w, f in form.items() if n[f] >= 10 * n[w]}
    out = {}
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None)
    return out


def words_fixture():
    r = random.Random(9)
    syllables = ["th", "er", "on", "an", "re", "é", "is", "Tion", "Ü", "o"]
    base = ["".join(r.choice(syllables) for _ in range(r.randint(3, 5))) for _ in range(150)] + ["aaaaaaa", "aaaaaaaa", "abababab", "babababa", "chainage"]
    rows = []
    for i in range(250):
        own = []
        for w in r.choices(base, weights=[1 + k % 17 for k in range(len(base))], k=40):
            if r.random() < 0.25 and len(w) > 2:
                p = r.randrange(len(w))
                w = r.choice([w[:p] + w[p + 1 :], w[:p] + r.choice("aeé") + w[p:], w[:p] + r.choice("aoÜ") + w[p + 1 :]])
            own.append(w)
        rows.append((i, r.choice([" ", ", ", "-1-", "\n"]).join(own)))
    rows += [(900 + k, " ".join(["chainage"] * 300)) for k in range(2)] + [(902, "chainaga " * 25 + "chainagaa " * 12), (903, "xhainaga xhainaga"), (None, "chainage chainaga"), (904, None), (905, ""), (5, "repeats repeats"), (5, "repeats repeats")]
    return rows + [(906, "z" * 3000 + " " + "z" * 3000), (907, "z" * 2999 + " " + "z" * 2999)]


@pytest.mark.parametrize("sample, cell, share", [(100_000, 16_384, 65_536), (1000, 40, 65_536), (200, 16, 12)])
def test_spelling(spark, sample, cell, share):
    rows = words_fixture()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("word", "n", "length", "form", "deal")})
    want = variants(rows)
    got = {x.word: (x.form, x.root, x.n, x.n_near, x.form_n) for x in spelling.spelling_variants(df, sample=sample, cell=cell, share=share).collect()}
    assert got == want
    assert any(v[3] > 2 for v in want.values()) and any(v[0] and v[1] != v[0] for v in want.values())
    assert spelling.spelling_variants(df.limit(0)).collect() == []


def test_chains_are_followed_to_the_end(spark):
    forms = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(13)] + [("x", "w5")], "word string, form string")
    got = {r.word: r.root for r in spelling.followed(forms, 13, shared.Scratch(spark, "t")).collect()}
    assert got == {**{f"w{i}": "w13" for i in range(13)}, "x": "w13"}


def test_trees_find_all_in_range():
    r = np.random.default_rng(2)
    codes = r.choice(np.frombuffer(b"abcde\xe9", np.uint8), (700, 9))
    counts = np.unique(spelling.counts_of(codes), axis=0)
    queries = np.vstack([counts[::3], spelling.counts_of(r.choice(np.frombuffer(b"abcxyz", np.uint8), (60, 9)))])
    for q, more, fewer in ((queries, 1, 1), (spelling.counts_of(r.choice(np.frombuffer(b"abcde\xe9", np.uint8), (200, 8))), 1, 0)):
        step = counts[None] - q[:, None]
        want = set(zip(*np.nonzero((np.maximum(step, 0).sum(2) == more) & (np.maximum(-step, 0).sum(2) == fewer))))
        got = list(zip(*spelling.Tree(counts, 5).search(q, more, fewer)))
        assert set(got) == want and len(got) == len(want) > 50
        cells = spelling.Cells(counts[::4], 4)
        home, (row, cell) = cells.home(counts), cells.reached(q, more, fewer)
        reached = set(zip(row.tolist(), cell.tolist()))
        assert all((a, home[b]) in reached for a, b in want) and len(reached) < len(q) * 16


def test_anagrams_share_a_cell_in_shares(spark):
    """All words have the same letters: shares meet each other, and words are near only across counts."""
    r = random.Random(1)
    words = sorted({"".join(r.sample("abcdefgh", 8)) for _ in range(300)})
    extra = sorted({w[:3] + "x" + w[4:] for w in words[:100]} | {w[:5] + "q" + w[5:] for w in words[50:120]})
    n = {w: 2 + k % 5 for k, w in enumerate(words + extra)}
    df = spark.createDataFrame(list(n.items()), "word string, n long")
    found = spelling.near_words(df, shared.Scratch(spark, "t"), sample=50, cell=8, share=20)
    got = {x.word: (x.n_near, x.near_n, x.near) for x in found.collect()}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:p] + b[p + 1 :] == a for p in range(len(b)))

    want = {}
    for a in n:
        its = [b for b in n if b != a and near(a, b)]
        if its:
            best = min(its, key=lambda b: (-n[b], b))
            want[a] = (len(its), n[best], best)
    assert got == want and len(want) > 200


# ---- tables of calls


def test_results_outlive_other_calls(spark, tmp_path):
    """Results of several calls, the pipeline's among them, can be held at once; the pipeline leaves its own tables alone."""
    import corpus_pipeline
    from realty_spark.llm.exact_dedup import exact_dedup
    from realty_spark.llm.minhash import near_duplicates

    texts = ["the house by the sea is small and white", "a text of some other words that nobody has read so far", "the house by the sea is small and white"]
    df = spark.createDataFrame([(i, texts[i % 3], "en", "s", 1) for i in range(9)], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    one, two = exact_dedup(df), near_duplicates(df)
    first, second = corpus_pipeline.run(spark, str(tmp_path)), corpus_pipeline.run(spark, str(tmp_path))
    assert one.count() == two.count() == 9 and first.count() == second.count() > 0


def test_opened_lists_own_calls(spark):
    with shared.opened() as outer:
        a = shared.Scratch(spark, "a")
        with shared.opened() as inner:
            b = shared.Scratch(spark, "b")
        c = shared.Scratch(spark, "c")
    d = shared.Scratch(spark, "d")
    assert outer == [a, c] and inner == [b] and d not in outer
    kept, gone = d.save(spark.range(3), "x"), a.save(spark.range(3), "x")
    a.close()
    assert kept.count() == 3
    with pytest.raises(Exception, match="FILE_NOT_EXIST|PATH_NOT_FOUND|does not exist"):
        gone.count()
