"""URL filter: pattern rules indexed by their rarest literal token; DataFrame functions only.

1. A rule is a regular expression with the literal tokens (runs of ``[a-z0-9]``) that every URL that it matches has as a whole.
2. The tokens of all URLs that some rule has are counted; each rule is filed under its rarest one.  Rules without a token are filed
   under the empty one, which every URL has.
3. Each URL's tokens fetch the rules filed under them, and only those run their expressions; the rest is one aggregate by URL.

Rows that are equal in all that is kept go on as one row with a count for each input partition, so no hot row gathers in a task, and a
URL's candidates come together in the partition that its row was dealt to: there is one shuffle of rows.
"""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rules, which the driver holds as a list, whose index is broadcast (about 200 bytes each); more are joined by token.
SMALL_INDEX = 100_000
_SEPARATOR = "([^a-z0-9_.%-]|\\z)"


@dataclass(frozen=True)
class Rule:
    """``place``: the regex is for host and path, else for the URL in lower case.  ``tokens``: those that each URL it matches has."""

    name: str
    verdict: str
    place: bool
    regex: str
    tokens: tuple[str, ...]


def _quoted(text: str) -> str:
    return re.sub(r"([!-/:-@\[-`{-~])", r"\\\1", text)


def place_rule(name: str, verdict: str) -> Rule:
    """``host/path``: for the host and its subdomains, where the path begins with the rule's; a rule without a slash is for all paths."""
    host, slash, path = name.partition("/")
    end = _quoted(slash + path) if slash else "(/|\\z)"
    whole = re.findall("[a-z0-9]+", host.lower()) + re.findall("[a-z0-9]+(?![a-z0-9]|$)", (slash + path).lower())
    return Rule(name, verdict, True, f"^([^/]*\\.)?{_quoted(host.lower())}{end}", tuple(dict.fromkeys(whole)))


def pattern_rule(pattern: str) -> Rule:
    """A rule of the usual filter lists: ``*`` is anything, ``^`` a separator or the end, ``||`` the beginning of a host or of a label in it,
    ``|`` the beginning or end of the URL, ``@@`` before it an exception.  Letters match in any case."""
    body, verdict = pattern.lower(), "block"
    if body.startswith("@@"):
        body, verdict = body[2:], "allow"
    start = "^[a-z][a-z0-9+.-]*://([^/?#]*\\.)?" if body.startswith("||") else "^" if body.startswith("|") else ""
    anchored, body = bool(start), body.lstrip("|")
    ended, body = body.endswith("|"), body.rstrip("|")
    inner = "".join(".*" if c == "*" else _SEPARATOR if c == "^" else _quoted(c) for c in body)
    bound = ("^" if anchored else "*") + body + ("^" if ended else "*")  # a token is whole where no wildcard touches it
    whole = [m for m in re.findall("(?<=[^*a-z0-9])[a-z0-9]+(?=[^*a-z0-9])", bound)]
    return Rule(pattern, verdict, False, f"(?s){start}{inner}" + ("\\z" if ended else ""), tuple(dict.fromkeys(whole)))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host, A-Z in lower case, and the path; both empty where the URL is null or has no ``://``."""
    rest = F.coalesce(F.when(F.contains(url, F.lit("://")), F.substr(url, F.locate("://", url) + 3)), F.lit(""))
    host, path = F.regexp_extract(rest, "^[^/?#]*", 0), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def tokens_of(url: Column) -> Column:
    """The distinct tokens of a URL, the empty one among them."""
    return F.array_distinct(F.array_append(F.split(F.translate(F.coalesce(url, F.lit("")), UPPER, LOWER), "[^a-z0-9]+"), ""))


def rule_table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """rank, name, verdict, place, regex, tokens: the rules as rows, earlier ones with a lower rank."""
    rows = json.dumps([asdict(r) | {"rank": i} for i, r in enumerate(rules)])
    schema = "array<struct<rank: long, name: string, verdict: string, place: boolean, regex: string, tokens: array<string>>>"
    return spark.range(1).select(F.inline(F.from_json(F.lit(rows), schema)))


def rule_index(urls: DataFrame, url_col: str, rules: DataFrame) -> DataFrame:
    """The rules with the ``token`` that each is filed under: of its tokens that of the fewest URLs, ties going to the first in order."""
    token = rules.select("rank", F.explode("tokens").alias("token"))
    seen = urls.select(F.explode(tokens_of(F.col(url_col))).alias("token")).join(F.broadcast(token.select("token").distinct()), "token", "left_semi")
    counts = seen.groupBy("token").agg(F.count("*").alias("n"))
    rarest = token.join(counts, "token", "left").groupBy("rank").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("b"))
    return rules.join(rarest, "rank", "left").select(*(c for c in rules.columns if c != "tokens"), F.coalesce("b.token", F.lit("")).alias("token"))


def url_filter(pages: DataFrame, rules: list[Rule], url_col: str = "url", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """One row per row of ``pages``: the columns of ``keep``, host, path, rule, verdict and pattern.

    Of the place rules that fit, the one with the longest name decides, ties going to the earlier one; it is ``rule``.  Where none fits, an
    exception among the patterns that match allows, any other blocks, and a URL that none matches is allowed; the first pattern of the kind
    that decides is ``pattern``.  A null URL, or one without ``://``, has an empty host and path, which no place rule fits; patterns without
    a host still look at its text, and a null one is allowed.  Rows that repeat are judged alike and all stay; an empty table gives an
    empty result; columns that are not in ``keep`` are not read.
    """
    spark = pages.sparkSession
    own = [f"k{i}" for i in range(len(keep))]
    table = rule_table(spark, rules)
    index = rule_index(pages, url_col, table)
    index = F.broadcast(index) if len(rules) <= SMALL_INDEX else index
    rows = pages.select(*(F.col(c).alias(o) for c, o in zip(keep, own)), F.col(url_col).alias("url"), F.spark_partition_id().alias("part"))
    rows = rows.groupBy(*own, "url", "part").agg(F.count("*").alias("n"))
    host, path = host_and_path(F.col("url"))
    lowered = F.translate(F.coalesce("url", F.lit("")), UPPER, LOWER)
    found = rows.withColumn("token", F.explode(tokens_of(F.col("url")))).join(index, "token", "left")
    fits = F.when(F.rlike(F.when(F.col("place"), F.concat(host, path)).otherwise(lowered), F.col("regex")), F.col("rank"))
    place, length = F.col("place"), F.char_length("name").cast("long")
    judged = found.withColumn("fits", fits).groupBy(*own, "url", "part", "n").agg(
        F.max(F.when(place, F.shiftleft(length, 32) - F.col("fits"))).alias("longest"),
        F.min(F.when(~place & (F.col("verdict") == "allow"), F.col("fits"))).alias("allows"),
        F.min(F.when(~place & (F.col("verdict") == "block"), F.col("fits"))).alias("blocks"),
    )
    rank = F.when(F.col("longest").isNotNull(), F.pmod(-F.col("longest"), F.lit(1 << 32))).otherwise(F.coalesce("allows", "blocks"))
    names = table.select("rank", "name", "verdict", "place")
    decided = judged.withColumn("rank", rank).join(F.broadcast(names) if len(rules) <= SMALL_INDEX else names, "rank", "left")
    out = decided.withColumn("copy", F.explode(F.array_repeat(F.lit(1), F.col("n").cast("int"))))
    return out.select(
        *(F.col(o).alias(c) for c, o in zip(keep, own)), host.alias("host"), path.alias("path"), F.when(place, F.col("name")).alias("rule"),
        F.coalesce("verdict", F.lit("allow")).alias("verdict"), F.when(~place, F.col("name")).alias("pattern"),
    )
