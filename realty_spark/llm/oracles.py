"""DuckDB SQL for the queries of the manifest, the URL filter and the spelling variants."""

from __future__ import annotations

from realty_spark.llm.urls import LOWER, UPPER, Rule

#: Levels of the trees of one group and over the groups that the SQL of the manifest is unrolled to.
LEVELS, GROUP_LEVELS = 14, 8


def _crc32(octets: str) -> str:
    """The unsigned checksum of a list of bytes: eight steps a byte, the first with the byte itself."""
    steps = f"flatten(list_transform({octets}, lambda b: [CAST(b AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {steps}), lambda x, y: xor(xor(x, y) >> 1, 3988292384 * (xor(x, y) & 1))), 4294967295)"


def _octets(text: str) -> str:
    """The UTF-8 bytes of a text whose letters lie below U+0800."""
    return f"flatten(list_transform(string_split({text}, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [192 | (unicode(c) >> 6), 128 | (unicode(c) & 63)] END))"


def manifest_sql() -> str:
    part = lambda x: f"CASE WHEN {x} IS NULL THEN '-' ELSE concat(octet_length(encode(CAST({x} AS VARCHAR))), ':', {x}) END"
    leaf = lambda text: "sha256(concat(" + ", ".join(map(part, ("doc_id", "source", "lang", "n_chars", text))) + "))"
    out = [
        f"""WITH docs AS MATERIALIZED (SELECT doc_id, CASE WHEN source IS NULL THEN '' ELSE concat(' ', source) END AS tree, {leaf('text')} AS leaf,
CASE WHEN {_crc32(_octets('CAST(doc_id AS VARCHAR)'))} % 2 = 0 THEN {leaf("replace(text, chr(10), '')")} ELSE {leaf('text')} END AS tampered FROM documents)""",
        """placed AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM docs)""",
        "a0 AS MATERIALIZED (SELECT tree, pos, count(*) OVER (PARTITION BY tree) AS n, leaf AS digest FROM placed)",
    ]

    def levels(name: str, n: int) -> None:
        for k in range(n):
            w = "OVER (PARTITION BY tree, pos // 3 ORDER BY pos ROWS BETWEEN"
            out.append(
                f"""{name}r{k} AS MATERIALIZED (SELECT tree, pos, n, coalesce(string_agg(digest, '') {w} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS lft,
coalesce(string_agg(digest, '') {w} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS rgt FROM {name}{k})"""
            )
            out.append(
                f"""{name}{k + 1} AS MATERIALIZED (SELECT tree, pos // 3 AS pos, (max(n) + 2) // 3 AS n,
CASE WHEN max(n) > 1 THEN sha256(string_agg(digest, '' ORDER BY pos)) ELSE max(digest) END AS digest FROM {name}{k} GROUP BY tree, pos // 3)"""
            )

    def walk(name: str, n: int, source: str) -> str:
        for k in range(n):
            out.append(
                f"""{name}w{k} AS MATERIALIZED (SELECT s.* REPLACE (s.pos // 3 AS pos, CASE WHEN r.n > 1 THEN sha256(concat(lft, cur, rgt)) ELSE cur END AS cur,
CASE WHEN r.n > 1 THEN concat(proof, lft, rgt) ELSE proof END AS proof) FROM {source} s JOIN {name}r{k} r USING (tree, pos))"""
            )
            source = f"{name}w{k}"
        return source

    levels("a", LEVELS)
    out.append(f"b0 AS MATERIALIZED (SELECT '' AS tree, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n, digest, tree AS of_tree FROM a{LEVELS})")
    levels("b", GROUP_LEVELS)
    out.append("start AS MATERIALIZED (SELECT doc_id, leaf, tree, pos, tampered AS cur, '' AS proof FROM placed)")
    last = walk("a", LEVELS, "start")
    out.append(f"up AS MATERIALIZED (SELECT s.* REPLACE ('' AS tree, b0.pos AS pos), b0.digest AS subroot FROM {last} s JOIN b0 ON s.tree = of_tree)")
    last = walk("b", GROUP_LEVELS, "up")
    return ",\n".join(out) + f"\nSELECT doc_id, leaf, subroot, digest AS root, sha256(proof) AS proof_sha256, cur AS folded_root, cur = digest AS verified FROM {last}, (SELECT digest FROM b{GROUP_LEVELS})"


def url_sql(rules: list[Rule]) -> str:
    places = sorted((r for r in rules if r.place), key=lambda r: -len(r.name))
    text = lambda x: "'" + x.replace("'", "''") + "'"

    def fits(rule: Rule) -> str:
        host, slash, path = rule.name.partition("/")
        return f"(host = {text(host)} OR ends_with(host, {text('.' + host)})) AND " + (f"starts_with(path, {text(slash + path)})" if slash else "true")

    def first(verdict: str) -> str:
        return "CASE " + " ".join(f"WHEN regexp_matches(low, {text(r.regex)}) THEN {text(r.name)}" for r in rules if not r.place and r.verdict == verdict) + " END"

    return f"""
WITH u AS (SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, translate(coalesce(url, ''), '{UPPER}', '{LOWER}') AS low FROM u),
r AS (SELECT *, CASE {' '.join(f"WHEN {fits(r)} THEN {text(r.name)}" for r in places)} END AS rule, {first('allow')} AS allows, {first('block')} AS blocks FROM h)
SELECT page_id, host, path, rule, CASE {' '.join(f"WHEN rule = {text(r.name)} THEN {text(r.verdict)}" for r in places)} WHEN allows IS NULL AND blocks IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict,
CASE WHEN rule IS NULL THEN coalesce(allows, blocks) END AS pattern FROM r
"""


def spelling_sql() -> str:
    key = "concat(coalesce(CAST(doc_id AS VARCHAR), ''), ':', run)"
    return f"""
WITH RECURSIVE t AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{{7,}}')), '{UPPER}', '{LOWER}') AS run FROM documents),
h AS (SELECT run, {_crc32(_octets(key))} AS h FROM t),
w AS (SELECT CASE WHEN h % 31 = 0 THEN concat(substr(run, 1, h % length(run)), substr(run, h % length(run) + 2)) ELSE run END AS word FROM h),
n AS MATERIALIZED (SELECT word, count(*) AS n FROM w WHERE length(word) >= 7 GROUP BY word HAVING count(*) >= 2),
v AS MATERIALIZED (SELECT word, n, p, concat(substr(word, 1, p), substr(word, p + 2)) AS cut FROM (SELECT word, n, unnest(range(length(word))) AS p FROM n)),
d AS MATERIALIZED (SELECT DISTINCT v.word, v.n, n.word AS other, n.n AS other_n FROM v JOIN n ON v.cut = n.word),
pairs AS (SELECT a.word, b.word AS other, b.n AS other_n FROM v a JOIN v b ON a.cut = b.cut AND a.p = b.p AND a.word <> b.word
  UNION ALL SELECT word, other, other_n FROM d UNION ALL SELECT other, word, n FROM d),
best AS MATERIALIZED (SELECT word, count(*) AS n_near, arg_min(other, (-other_n, other)) AS near, max(other_n) AS near_n FROM pairs GROUP BY word),
f AS MATERIALIZED (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 10 * n THEN near END AS form, CASE WHEN near_n >= 10 * n THEN near_n END AS form_n FROM n LEFT JOIN best USING (word)),
c(word, place) AS (SELECT word, word FROM f UNION ALL SELECT c.word, f.form FROM c JOIN f ON c.place = f.word WHERE f.form IS NOT NULL)
SELECT f.word, f.form, c.place AS root, f.n, f.n_near, f.form_n FROM f JOIN c ON c.word = f.word JOIN f g ON g.word = c.place WHERE g.form IS NULL
"""
