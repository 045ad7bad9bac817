"""Sums over the smaller values of a group, and values at places of its order, without sorting a group in one task.

Values are summed up by prefixes of their bits: a prefix holds at most ``2 ** BITS`` different prefixes of the level below, or whole
numbers.  Windows run within a prefix alone; what lies before it comes from the level above.  Above ``LEVELS`` levels, that is for
whole numbers of 37 bits or more, the rest of the prefix is one group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BITS, LEVELS = 12, 3
#: Stands for null, which comes first.
_LEAST = -(1 << 62)


def _levels(counts: DataFrame, keys: list[str], value: str, sums: list[str], bits: int, levels: int) -> list[DataFrame]:
    """Level 0: the rows with their group ``__g`` and prefix ``__p1``; level k: (__g, __p{k}, __p{k + 1}, sums) by prefix; the last one's is null.

    A group is a struct, whose nulls are equal.
    """
    prefix = lambda c: F.shiftright(c, bits)
    whole = F.coalesce(F.floor(F.col(value)).cast("long"), F.lit(_LEAST))
    out = [counts.withColumns({"__g": F.struct(*keys), "__p1": prefix(whole)})]
    for k in range(1, levels + 1):
        above = prefix(F.col(f"__p{k}")) if k < levels else F.lit(None).cast("long")
        out.append(out[-1].groupBy("__g", f"__p{k}").agg(*(F.sum(c).alias(c) for c in sums)).withColumn(f"__p{k + 1}", above))
    return out


def _within(level: DataFrame, k: int, by: str, sums: list[str], last: bool) -> DataFrame:
    """``level`` with __b{k}_{c}: the sum of c over what comes before in the same prefix of the level above."""
    w = Window.partitionBy("__g", *([] if last else [f"__p{k + 1}"])).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    return level.withColumns({f"__b{k}_{c}": F.coalesce(F.sum(c).over(w), F.lit(0)) for c in sums})


def sums_before(counts: DataFrame, keys: list[str], value: str, sums: list[str], bits: int = BITS, levels: int = LEVELS) -> DataFrame:
    """``counts``, which has one row for each value of a group, with {c}_before for the columns of ``sums``: their sum over the group's smaller values.

    Null is the least value, null keys are a group.  Values that are no whole numbers are told apart within their whole part.
    """
    own = list(counts.columns)
    tables = _levels(counts, keys, value, sums, bits, levels)
    out = _within(tables[0], 0, value, sums, levels == 0)
    for k in range(1, levels + 1):
        above = _within(tables[k], k, f"__p{k}", sums, k == levels).drop(*sums)
        out = out.join(above, ["__g", f"__p{k}"])
    total = lambda c: sum((F.col(f"__b{k}_{c}") for k in range(1, levels + 1)), F.col(f"__b0_{c}"))
    return out.select(*own, *(total(c).alias(f"{c}_before") for c in sums))


def values_at(counts: DataFrame, keys: list[str], value: str, n: str, places: dict[str, Column], bits: int = BITS, levels: int = LEVELS) -> DataFrame:
    """(keys, {n}, names): for each place, an expression over a group's total {n}, the value that stands there when values are repeated ``n`` times and sorted, from 0.

    From the top only the prefixes that hold a place go on; null where a place is outside.
    """
    tables = _levels(counts, keys, value, [n], bits, levels)
    totals = tables[-1].groupBy("__g").agg(F.sum(n).alias(n))
    asked = totals.select("__g", F.explode(F.array(*(F.struct(F.lit(name).alias("name"), p.cast("long").alias("place")) for name, p in places.items()))).alias("a")).select("__g", "a.*")
    for k in range(levels, -1, -1):
        on = ["__g"] if k == levels else ["__g", f"__p{k + 1}"]
        by = f"__p{k}" if k else value
        level = tables[k].select("__g", *on[1:], by, n)
        held = _within(level if k == levels else level.join(asked.select(*on).distinct(), on, "left_semi"), k, by, [n], k == levels)
        found = asked.join(held, on).filter((F.col("place") >= F.col(f"__b{k}_{n}")) & (F.col("place") < F.col(f"__b{k}_{n}") + F.col(n)))
        asked = found.select("__g", "name", (F.col("place") - F.col(f"__b{k}_{n}")).alias("place"), by)
    picks = asked.groupBy("__g").agg(*(F.max(F.when(F.col("name") == name, F.col(value))).alias(name) for name in places))
    return totals.join(picks, "__g", "left").select("__g.*", n, *places)
