"""Ratcliff-Obershelp similarity as a column expression: no Python runs for it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Second texts from this length on have popular letters: those that are more than one in a hundred, at which no block may begin or grow first.
POPULAR_FROM = 200


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is reckoned once."""
    return F.transform(F.array(value), use)[0]


def popular_letters(text: Column) -> Column:
    n = F.length(text)
    letters = F.array_distinct(F.split(text, ""))
    times = lambda c: n - F.length(F.replace(text, c, F.lit("")))
    found = F.filter(letters, lambda c: (c != "") & (times(c) > F.floor(n / 100) + 1))
    return F.when(n >= POPULAR_FROM, F.array_join(found, "")).otherwise("")


def common_start(a: Column, b: Column) -> Column:
    """How many letters two texts begin with alike."""
    n = F.least(F.length(a), F.length(b))
    same = lambda k, i: F.when((k == i - 1) & (F.substr(a, i, F.lit(1)) == F.substr(b, i, F.lit(1))), i).otherwise(k)
    return F.when(n > 0, F.aggregate(F.sequence(F.lit(1), n), F.lit(0), same)).otherwise(0)


def _longest(x: Column, y: Column) -> Column:
    """struct(i, k): the longest part of ``x`` that ``y`` holds, the first of equals; one letter is tried or one place passed in each step."""
    n = F.length(x)
    state = lambda at, i, k: F.struct(at.alias("at"), i.alias("i"), k.alias("k"))

    def step(s: Column, _: Column) -> Column:
        longer = F.contains(y, F.substr(x, s["at"], s["k"] + 1))
        return F.when(s["at"] + s["k"] > n, s).when(longer, state(s["at"], s["at"], s["k"] + 1)).otherwise(state(s["at"] + 1, s["i"], s["k"]))

    return F.aggregate(F.sequence(F.lit(1), 2 * n), state(F.lit(1), F.lit(1), F.lit(0)), step)


def longest_block(x: Column, y: Column, popular: Column) -> Column:
    """struct(i, j, k): the longest block of ``k`` letters that is at ``i`` of ``x`` and ``j`` of ``y``, the first in ``x``, then in ``y``.

    Blocks are looked for without popular letters, then grown by any that are alike on both sides.
    """
    hidden = lambda t, by: F.call_function("translate", t, popular, F.repeat(F.lit(by), F.length(popular)))
    place = lambda i, j, k: F.struct(i.alias("i"), j.alias("j"), k.alias("k"))

    def within(x0: Column, y0: Column) -> Column:
        return _let(_longest(x0, y0), lambda s: place(s["i"], F.when(s["k"] > 0, F.call_function("instr", y0, F.substr(x0, s["i"], s["k"]))).otherwise(1), s["k"]))

    def grown(b: Column) -> Column:
        before = F.when(b["k"] > 0, common_start(F.reverse(F.substr(x, F.lit(1), b["i"] - 1)), F.reverse(F.substr(y, F.lit(1), b["j"] - 1)))).otherwise(0)
        after = common_start(F.substr(x, b["i"] + b["k"], F.length(x)), F.substr(y, b["j"] + b["k"], F.length(y)))
        return _let(before, lambda n: place(b["i"] - n, b["j"] - n, b["k"] + n + after))

    masked = lambda: _let(F.struct(hidden(x, "\x01").alias("x"), hidden(y, "\x02").alias("y")), lambda m: _let(within(m["x"], m["y"]), grown))
    return F.when(popular == "", within(x, y)).otherwise(masked())


def matched_letters(a: Column, b: Column) -> Column:
    """Letters in the longest block, and in those to its left and to its right, and so on."""
    kind = "struct<todo: array<struct<x: string, y: string>>, n: int>"
    pair = lambda x, y: F.struct(x.alias("x"), y.alias("y"))

    def with_popular(popular: Column) -> Column:
        def step(s: Column, _: Column) -> Column:
            def cut(p: Column, c: Column) -> Column:
                left = pair(F.substr(p["x"], F.lit(1), c["i"] - 1), F.substr(p["y"], F.lit(1), c["j"] - 1))
                right = pair(F.substr(p["x"], c["i"] + c["k"], F.length(p["x"])), F.substr(p["y"], c["j"] + c["k"], F.length(p["y"])))
                whole = F.filter(F.array(left, right), lambda q: (c["k"] > 0) & (q["x"] != "") & (q["y"] != ""))
                return F.struct(F.concat(whole, F.slice(s["todo"], 2, F.size(s["todo"]))).alias("todo"), (s["n"] + c["k"]).alias("n"))

            one = _let(s["todo"][0], lambda p: _let(longest_block(p["x"], p["y"], popular), lambda c: cut(p, c)))
            return F.when(F.size(s["todo"]) == 0, s).otherwise(one)

        start = F.struct(F.array(pair(a, b)).alias("todo"), F.lit(0).alias("n")).cast(kind)
        rounds = F.sequence(F.lit(1), 2 * F.least(F.length(a), F.length(b)) + 1)
        return F.aggregate(rounds, start, step, lambda s: s["n"])

    return F.when((a == "") | (b == ""), 0).otherwise(_let(popular_letters(b), with_popular))


def ratio(a: Column, b: Column) -> Column:
    """Twice the matched letters by all letters; 1 for two empty texts, null where one is null."""
    n = F.length(a) + F.length(b)
    return F.when(n == 0, 1.0).when(n > 0, 2 * matched_letters(a, b) / n)
