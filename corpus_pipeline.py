"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next.

A stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the
columns of ``documents``, whatever other columns these have.  An empty table gives an empty result in every stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from realty_spark.llm import langid
from realty_spark.llm.chunks import substring_dedup
from realty_spark.llm.exact_dedup import exact_dedup, normalized
from realty_spark.llm.minhash import near_duplicates
from realty_spark.llm.packing import pack
from realty_spark.llm.queries import VOCABULARY, documents
from realty_spark.llm.shared import Scratch, fresh, opened


def _only(docs: DataFrame, decided: DataFrame, key: Column, name: str) -> tuple[DataFrame, list[str]]:
    """The rows of ``docs`` whose doc_id and ``key`` are kept in ``decided``, where the key is called ``name``; and what both are called."""
    own, doc_id, its = (fresh(x, docs.columns) for x in (name, "kept_id", "kept_key"))
    kept = decided.filter("kept").select(F.col("doc_id").alias(doc_id), F.col(name).alias(its)).distinct()
    held = docs.withColumn(own, key)
    return held.join(kept, F.col("doc_id").eqNullSafe(F.col(doc_id)) & (F.col(own) == F.col(its)), "left_semi"), ["doc_id", own]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language models reject go: null, empty and letterless texts, and texts unlike all languages learnt.

    Each row is judged by its own text, so rows that repeat an id, null ids and ties need no rule.  With nothing to learn from, all texts with a letter stay.
    """
    model = langid.fit(docs.select("doc_id", "text", "lang").filter(langid.learnable(F.col("doc_id"))))
    told = fresh("told", docs.columns)
    return docs.withColumn(told, langid.identified(model, F.col("text"), spark)).filter(f"NOT {told}.rejected").select(docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts stays: the longest original, then the smallest id, where null comes first.

    Null and empty texts are one group.  Of rows that repeat the id and the text of the one that stays, one stays.
    """
    kept, key = _only(docs, exact_dedup(docs), F.sha2(normalized(F.col("text")), 256), "text_sha256")
    return kept.dropDuplicates(key).select(docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates stays: the one with the smallest id.

    Texts without words, null ones included, are linked with nothing and stay.  A null id stays only where its component has no other.
    Rows that repeat an id with other texts are documents of their own; with the same text they are one, and all its rows stay.
    """
    key = F.coalesce(F.xxhash64("text"), F.lit(0))
    return _only(docs, near_duplicates(docs), key, "text_key")[0].select(docs.columns)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages are cut out of later documents, by id, where null comes first; documents of which no word is left go.

    Texts in which nothing repeats stay as they are, null and empty ones too.  Rows that repeat an id with the same text are one document with one
    result; with other texts they are told apart by a hash of the text.  n_chars is brought up to date where a text was cut.
    """
    cut = substring_dedup(docs)
    cut = cut.filter((F.col("n_removed") == 0) | F.col("text").rlike("[^\\x20\\x09-\\x0D]"))
    return cut.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of token ids with the mixture of sources of the whole.

    A null or empty text is its end id alone, a null source a queue of its own; rows that repeat an id are packed each for itself.
    """
    return pack(docs, VOCABULARY).select(
        "doc_id", "source", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("substring_dedup", substrings),
    ("packing", packing),
]
#: SQL expresses neither the language models nor near-duplicate components; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; the rows of the last."""
    scratch = Scratch(spark, "pipeline")
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        with opened() as tables:
            docs = scratch.save(stage(spark, docs, sf_dir), name)
        if k:
            scratch.drop(STAGES[k - 1][0])
        for table in tables:
            table.close()
    return docs
