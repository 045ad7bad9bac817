"""The queries of the llm operators, with SQL where it can express them."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from realty_spark.llm import crf, licenses, manifest, oracles, urls
from realty_spark.llm.bpe import encode_decode
from realty_spark.llm.chunks import substring_dedup
from realty_spark.llm.exact_dedup import exact_dedup
from realty_spark.llm.langid import languages
from realty_spark.llm.minhash import near_duplicates
from realty_spark.llm.packing import mixture, pack
from realty_spark.llm.ppm import score_texts
from realty_spark.llm.spelling import spelling_variants
from realty_spark.llm.suffixes import suffix_dedup

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op2_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 2
    return score_texts(documents(spark, sf_dir), held_out, across=True)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(documents(spark, sf_dir)).select("doc_id", "text", "n_bytes", "n_removed", "n_spans")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    field = crf.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return crf.quality(docs, field).drop("labels")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(documents(spark, sf_dir)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(documents(spark, sf_dir), VOCABULARY).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), VOCABULARY).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def packing_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each source in each window of 64 sequences, packed to weights that differ from the sources' sizes: 1 to 4 by the name's hash."""
    return mixture(pack(documents(spark, sf_dir), VOCABULARY, targets=lambda source: 1 + zlib.crc32((source or "").encode()) % 4))


#: A file tree over documents: their source, two levels of directories by id, and a name; of the texts that end with a notice those of
#: even ids are licence files, in one of the three levels.  Written for DuckDB; Spark SQL names three things differently.
FILE_PATH = r"""
CASE WHEN doc_id % 2 = 0 AND regexp_matches(split_part(coalesce(text, ''), chr(10), -1), '(?i)(licen[cs]e|copyright|all rights reserved|public domain)')
THEN concat_ws('/', coalesce(source, 'none'), CASE WHEN doc_id // 2 % 3 > 0 THEN CAST(doc_id // 1000 AS VARCHAR) END,
               CASE WHEN doc_id // 2 % 3 > 1 THEN CAST(doc_id // 50 AS VARCHAR) END, concat('LICENSE.', doc_id))
ELSE concat_ws('/', coalesce(source, 'none'), CAST(doc_id // 1000 AS VARCHAR), CAST(doc_id // 50 AS VARCHAR), concat(doc_id, '.txt')) END
"""


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = FILE_PATH.replace("//", "DIV").replace("regexp_matches", "regexp_like").replace("VARCHAR", "STRING")
    files = documents(spark, sf_dir).select(F.expr(path).alias("path"), "text")
    doc_id = F.regexp_extract("path", "([0-9]+)([.]txt)?$", 1).cast("long")
    return licenses.license_scan(files).withColumn("doc_id", doc_id)


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir)).drop("text_key")


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages(documents(spark, sf_dir))


def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, fields = documents(spark, sf_dir), ["doc_id", "source", "lang", "n_chars"]
    leaf = lambda text: manifest.leaf_digest(*map(F.col, fields), text)
    altered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    tampered = F.when(altered & F.contains("text", F.lit("\n")), leaf(F.replace("text", F.lit("\n"), F.lit("")))).alias("tampered")
    made = manifest.manifest(docs, leaf(F.col("text")), F.col("source"), F.col("doc_id"), [F.col("doc_id"), tampered])
    root = manifest.folded(F.coalesce("tampered", "leaf"), F.col("proof"))
    made = made.select("doc_id", "leaf", "subroot", "root", manifest.hashed(manifest.siblings(F.col("proof"))).alias("proof_sha256"), root.alias("folded_root"))
    return made.withColumn("verified", F.col("folded_root") == F.col("root"))


#: What is blocked and allowed by host and path, and by the patterns of filter lists: hosts of advertisements and counters, pages that repeat
#: others or hold no text, files that are no pages, sessions; with exceptions.
URL_RULES = [
    *(urls.place_rule(name, verdict) for name, verdict in [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]),
    *map(
        urls.pattern_rule,
        [
            "||ads-track.", "||ads.", "||adserver.", "||doubleclick.", "||stats.", "||tracker.", "||counter.", "||pixel.", "/wp-login.php", "/wp-admin/", "/cgi-bin/", "/cart/", "/checkout/", "/login^", "/signup^",
            "/print/", "/feed/", ".zip|", ".exe|", ".jpg|", ".png|", ".pdf|", "^sessionid=", "^phpsessid=", "^replytocom=", "^utm_source=feed^", "^ref=x^", "||m.*^utm_medium=", "@@||blog.*/en/", "@@/robots.txt|",
        ],
    ),
]


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.url_filter(spark.read.parquet(f"{sf_dir}/pages.parquet"), URL_RULES)


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_exact_dedup": op1_exact_dedup,
        "op2_ppm": op2_ppm,
        "op3_substring_dedup": op3_substring_dedup,
        "op4_quality_rules": op4_quality_rules,
        "op5_suffix_dedup": op5_suffix_dedup,
        "op6_bpe": op6_bpe,
        "op7_packing": op7_packing,
        "packing_mixture": packing_mixture,
        "op8_license_scan": op8_license_scan,
        "op9_minhash": op9_minhash,
        "op10_langid": op10_langid,
        "op11_manifest": op11_manifest,
        "op12_url_filter": op12_url_filter,
        "op13_spelling": op13_spelling,
    }


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else repr(x) for x in r) + ")" for r in rows)


def _scored_sql(of: str, notices: str, templates: list[tuple[str, str]]) -> str:
    """CTEs from ``notices`` (path, notice) to best_{of}: path, license, score of each path's best notice."""
    idf, other = licenses.inverse_frequencies(templates)
    return rf"""
idf_{of}(term, idf) AS (VALUES {_values(sorted(idf.items()))}),
vec_{of}(term, template, license, weight) AS (VALUES {_values(licenses.weights(templates))}),
notices_{of} AS (SELECT DISTINCT path, notice FROM ({notices})),
counted_{of} AS (
  SELECT notice, term, count(*) * any_value(coalesce(idf, {other!r})) AS x
  FROM (SELECT notice, unnest(string_split_regex(lower(notice), '[^a-z0-9]+')) AS term FROM (SELECT DISTINCT notice FROM notices_{of})) t
  LEFT JOIN idf_{of} USING (term) WHERE term <> '' GROUP BY ALL
), norms_{of} AS (SELECT notice, sqrt(sum(x * x)) AS norm FROM counted_{of} GROUP BY ALL),
dots_{of} AS (SELECT notice, template, license, sum(x * weight) AS dot FROM counted_{of} JOIN vec_{of} USING (term) GROUP BY ALL),
scored_{of} AS (
  SELECT notice, license, round(dot / norm, 6) AS score FROM dots_{of} JOIN norms_{of} USING (notice)
  QUALIFY row_number() OVER (PARTITION BY notice ORDER BY round(dot / norm, 6) DESC, template) = 1
), best_{of} AS (
  SELECT path, license, score FROM notices_{of} JOIN scored_{of} USING (notice) WHERE score >= {licenses.LEAST_SCORE}
  QUALIFY row_number() OVER (PARTITION BY path ORDER BY score DESC, license) = 1
)"""


def license_sql() -> str:
    folder = "regexp_replace({}, '/?[^/]*$', '')"
    licence_file = f"regexp_matches(split_part(path, '/', -1), '{licenses.LICENSE_FILE}')"
    telling = lambda x, templates: f"list_has_any(string_split_regex(lower({x}), '[^a-z0-9]+'), {licenses.telling_terms(templates, licenses.LEAST_SCORE)})"
    lines = f"""SELECT path, notice FROM (SELECT path, unnest(ls) AS notice FROM lines UNION ALL SELECT path, text FROM lines WHERE {licence_file}) WHERE {telling('notice', licenses.TEMPLATES)}"""
    code = f"coalesce(list_position(list_transform(ls, lambda x: regexp_matches(x, '{licenses.COMMENT}')), false), 0)"
    blocks = rf"""SELECT path, notice FROM (SELECT path, unnest(string_split_regex(text, '\n(?:[^A-Za-z0-9\n]*\n)+')) AS notice FROM worded
      UNION ALL SELECT path, array_to_string(CASE WHEN {code} = 0 THEN ls ELSE ls[1:{code} - 1] END, chr(10)) FROM worded
      UNION ALL SELECT path, text FROM worded WHERE {licence_file}) WHERE {telling('notice', licenses.TEXTS)}"""
    return rf"""
WITH files AS (SELECT doc_id, text, {FILE_PATH} AS path FROM documents),
lines AS (SELECT path, text, string_split(text, chr(10)) AS ls FROM files WHERE {telling('text', licenses.TEMPLATES)}),
worded AS (SELECT path, text, string_split(text, chr(10)) AS ls FROM files WHERE {telling('text', licenses.TEXTS)}),
{_scored_sql("line", lines, licenses.TEMPLATES)},
{_scored_sql("text", blocks, licenses.TEXTS)},
own AS (
  SELECT path, CASE WHEN l.license IS NOT NULL AND (t.license IS NULL OR (l.license <> '{licenses.RESERVED}' AND l.score >= t.score)) THEN l.license ELSE t.license END AS own_license,
         CASE WHEN l.license IS NOT NULL AND (t.license IS NULL OR (l.license <> '{licenses.RESERVED}' AND l.score >= t.score)) THEN l.score ELSE t.score END AS own_score
  FROM best_line l FULL JOIN best_text t USING (path)
), held AS (
  SELECT {folder.format("path")} AS license_dir, own_license AS from_license FROM own WHERE {licence_file}
  QUALIFY row_number() OVER (PARTITION BY {folder.format("path")} ORDER BY own_score DESC, own_license) = 1
), nearest AS (
  SELECT dir, license_dir, from_license FROM (SELECT DISTINCT {folder.format("path")} AS dir FROM files) d
  JOIN held ON license_dir = '' OR dir = license_dir OR starts_with(dir, license_dir || '/')
  QUALIFY row_number() OVER (PARTITION BY dir ORDER BY length(license_dir) DESC) = 1
)
SELECT f.doc_id, f.path, own_license, own_score, coalesce(own_license, from_license) AS license,
       CASE WHEN own_license IS NOT NULL THEN 'own' WHEN from_license IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin,
       CASE WHEN own_license IS NULL THEN license_dir END AS license_dir
FROM files f LEFT JOIN own USING (path) LEFT JOIN nearest ON dir = {folder.format("f.path")}
"""


ORACLE_SQL: dict[str, str] = {
    "op1_exact_dedup": r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents
), g AS (
  SELECT norm, count(*) AS group_size, arg_min(doc_id, (-points, doc_id)) AS keep_id FROM d GROUP BY norm
)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.norm) AS text_sha256
FROM d JOIN g USING (norm)
""",
    "op8_license_scan": license_sql(),
    "op11_manifest": oracles.manifest_sql(),
    "op12_url_filter": oracles.url_sql(URL_RULES),
    "op13_spelling": oracles.spelling_sql(),
}
