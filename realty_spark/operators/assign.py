"""Eligible sales of clients and their weighted random choice, for all clients in one query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from realty_spark.functions import numbers as N
from realty_spark.sources.files import shared_folder

OLDEST_DAYS, YOUNGEST_DAYS = 8 * 365, 6 * 365
#: Clients meet sales in blocks of 2 ** BLOCK_BITS places of a group's order and in shares of about SHARE clients, which bounds what meets under one key.
BLOCK_BITS, SHARE = 12, 4096
#: Ranks up to which Spark drops rows before the shuffle of a window (spark.sql.optimizer.windowGroupLimitThreshold by default).
RANKED = 1000


def due(clients: DataFrame, day: Column) -> DataFrame:
    """Active clients of the day; on a month's last day those of later days too."""
    d = F.dayofmonth(day)
    late = (day == F.last_day(day)) & (F.col("send_day") > d)
    return clients.filter((F.col("status") == "active") & ((F.col("send_day") == d) | late))


def notify(clients: DataFrame, day: Column) -> DataFrame:
    """Those who are due on the day after."""
    return due(clients, F.date_add(day, 1))


def by_preference(sales: DataFrame, types: list[str], cities: list) -> DataFrame:
    """An empty list is no restriction."""
    for column, wanted in (("property_type", types), ("city_id", cities)):
        if wanted:
            sales = sales.filter(F.col(column).isin(wanted))
    return sales


def search(sales: DataFrame, city: str | None = None, types: list[str] | None = None, first: str | None = None, last: str | None = None, postal: str | None = None) -> DataFrame:
    """Sales by any of: part of a city's name in any case, postcode, types, and months MM/YYYY."""
    month = lambda m: F.to_date(F.lit(f"01/{m}"), "dd/MM/yyyy")
    if city:
        sales = sales.filter(F.col("city_name").ilike(f"%{city}%"))
    if postal:
        sales = sales.filter(F.col("postal_code") == postal)
    if types:
        sales = sales.filter(F.col("property_type").isin(types))
    if first:
        sales = sales.filter(F.col("sale_date") >= month(first))
    if last:
        sales = sales.filter(F.col("sale_date") <= F.last_day(month(last)))
    return sales


def _old(sales: DataFrame, as_of: Column) -> DataFrame:
    return sales.filter(F.col("sale_date").between(F.date_sub(as_of, OLDEST_DAYS), F.date_sub(as_of, YOUNGEST_DAYS)))


def _cells(clients: DataFrame) -> DataFrame:
    """(client_id, wanted, city_id, __type) without repeats; a null type is any, and then its city has no other."""
    wish = clients.select("client_id", F.col("addresses_per_report").alias("wanted"), F.explode(F.array_distinct("chosen_cities")).alias("city_id"), "property_type_preferences")
    wish = wish.filter("city_id IS NOT NULL").select("client_id", "wanted", "city_id", F.explode_outer("property_type_preferences").alias("__type"))
    types = wish.groupBy("client_id", "wanted", "city_id").agg(F.bool_or(F.col("__type").isNull()).alias("__any"), F.collect_set("__type").alias("__types"))
    return types.select("client_id", "wanted", "city_id", F.explode_outer(F.when(~F.col("__any"), F.col("__types"))).alias("__type"))


def _in_cells(cells: DataFrame, sales: DataFrame, on: list[str] = []) -> DataFrame:
    """``cells`` joined with the sales that lie in them (and agree in ``on``)."""
    typed = cells.filter("__type IS NOT NULL").withColumnRenamed("__type", "property_type").join(sales, [*on, "city_id", "property_type"])
    free = cells.filter("__type IS NULL").drop("__type").join(sales, [*on, "city_id"])
    return typed.unionByName(free.select(typed.columns))


def _placed(sales: DataFrame, clients: DataFrame, as_of: Column, whole: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, placed, sizes): clients by group ``__g``; the old sales of each group with their place ``__r`` from 1, the newest, and its
    ``__shares``; and the number of its sales ``__n``.

    A group is what clients wish alike: all their cells if ``whole``, so that the place is a weight, else each cell.
    """
    one = F.struct("city_id", "__type")
    cells = _cells(clients)
    held = cells.groupBy("client_id", "wanted").agg(F.array_sort(F.collect_set(one)).alias("__cells")) if whole else cells.withColumn("__cells", F.array(one))
    held = held.withColumn("__g", F.md5(F.to_json("__cells")))
    groups = held.groupBy("__g").agg(F.first("__cells").alias("__cells"), F.ceil(F.count("*") / SHARE).cast("int").alias("__shares"))
    rows = _in_cells(groups.select("__g", "__shares", F.inline("__cells")), _old(sales, as_of))
    sizes = rows.groupBy("__g", "__shares").agg(F.count("*").alias("__n"))
    return held.select("client_id", "wanted", "__g"), with_weight(rows, "__g", "__r"), sizes


def _before(assigned: DataFrame, clients: DataFrame) -> DataFrame:
    """What was assigned to these clients, without repeats."""
    return assigned.select("client_id", "address_id").join(clients.select("client_id").distinct(), "client_id", "left_semi").distinct()


def _spans(members: DataFrame, placed: DataFrame, sizes: DataFrame, assigned: DataFrame) -> DataFrame:
    """The places of its group that are left to a member, those of sales that it was assigned before being taken out: it has all between
    ``__lo`` and ``__hi``, each ``__shift`` places lower than in the group; ``__left`` are its sales in all spans, of which the first begins at 0.
    """
    taken = _before(assigned, members).join(placed.select("__g", "address_id", "__r"), "address_id").join(members, ["client_id", "__g"])
    own = Window.partitionBy("client_id", "wanted", "__g")
    place = own.orderBy("__r")
    edges = members.withColumn("__r", F.lit(0).cast("long")).unionByName(taken.select("client_id", "wanted", "__g", "__r"))
    spans = edges.withColumns({"__next": F.lead("__r").over(place), "__shift": F.row_number().over(place) - 1, "__taken": F.count("*").over(own) - 1}).join(sizes, "__g")
    return spans.select(
        "client_id", "wanted", "__g", F.col("__r").alias("__lo"), F.coalesce("__next", F.col("__n") + 1).alias("__hi"), "__shift", (F.col("__n") - F.col("__taken")).alias("__left"), "__shares"
    )


def _met(spans: DataFrame, placed: DataFrame, likely: Column | None = None) -> DataFrame:
    """Each member with each of its sales and its ``weight``, where ``likely``.  Shuffled are spans by block and sales by group, and none of the pairs."""
    block = lambda c: F.shiftright(c, BLOCK_BITS)
    few = spans.filter(F.col("__hi") - F.col("__lo") > 1).withColumn("__block", F.explode(F.sequence(block(F.col("__lo") + 1), block(F.col("__hi") - 1))))
    few = few.withColumn("__share", F.pmod(F.xxhash64("client_id", "wanted"), F.col("__shares")).cast("int")).drop("__shares")
    many = placed.withColumns({"__block": block(F.col("__r")), "__share": F.explode(F.sequence(F.lit(0), F.col("__shares") - 1))}).drop("__shares")
    between = (F.col("__r") > F.col("__lo")) & (F.col("__r") < F.col("__hi"))
    met = few.join(many, ["__g", "__block", "__share"]).filter(between if likely is None else between & likely)
    return met.withColumn("weight", F.col("__r") - F.col("__shift")).drop("__g", "__block", "__share", "__lo", "__hi", "__r", "__shift")


def eligible(sales: DataFrame, clients: DataFrame, assigned: DataFrame, as_of: Column) -> DataFrame:
    """(client_id, wanted, sale columns): sales 6 to 8 years old in a chosen city and of a chosen type, not yet assigned to the client.

    No chosen types is no restriction.  Sales are placed in the order of their city and type, in which a client has all but those that it was assigned.
    """
    members, placed, sizes = _placed(sales, clients, as_of, whole=False)
    return _met(_spans(members, placed, sizes, assigned), placed).drop("weight", "__left")


def weighted(sales: DataFrame, clients: DataFrame, assigned: DataFrame, as_of: Column) -> DataFrame:
    """The rows of ``eligible`` with their linear weights: of a client's n rows the oldest has n and the newest 1.

    Weights are places in the order of all clients with the same cities and types, less what was assigned to the client of newer sales.
    """
    members, placed, sizes = _placed(sales, clients, as_of, whole=True)
    return _met(_spans(members, placed, sizes, assigned), placed).drop("__left")


def with_weight(rows: DataFrame, of: str = "client_id", name: str = "weight") -> DataFrame:
    """Linear weights: of a client's n rows the oldest has n and the newest 1.

    Days are counted first and summed up from the newest; a row's weight is that sum less its place within its day, so a
    client's rows are sorted by day and not as a whole.
    """
    days = rows.groupBy(of, "sale_date").agg(F.count("*").alias("__k"))
    newest = Window.partitionBy(of).orderBy(F.desc("sale_date")).rowsBetween(Window.unboundedPreceding, 0)
    days = days.select(F.col(of).alias("__c"), F.col("sale_date").alias("__d"), F.sum("__k").over(newest).alias("__upto"))
    place = F.row_number().over(Window.partitionBy(of, "sale_date").orderBy("address_id"))
    placed = rows.withColumn("__place", place)
    joined = placed.join(days, (F.col(of) == F.col("__c")) & F.col("sale_date").eqNullSafe(F.col("__d")))
    return joined.withColumn(name, F.col("__upto") - F.col("__place") + 1).drop("__c", "__d", "__upto", "__place")


def _upper(rows: DataFrame) -> DataFrame:
    """The rows of each client down to the level of keys that holds the last one wanted; ``rows`` have __key below 0.

    Levels are eighths of an octave of the key.  Their counts merge before the shuffle, so a client is some hundred rows for its owner
    however many sales it has; what stays is what is wanted and the rest of one level.
    """
    level = F.floor(8 * F.log2(-F.col("__key")))  # ascends from the keys next to 0, which win
    counts = rows.groupBy("client_id", "wanted", level.alias("__level")).agg(F.count("*").alias("__k"))
    before = Window.partitionBy("client_id", "wanted").orderBy("__level").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("__before", F.coalesce(F.sum("__k").over(before), F.lit(0)))
    last = counts.filter("__before < wanted").groupBy("client_id", "wanted").agg(F.max("__level").alias("__last"))
    last = last.select(F.col("client_id").alias("__c"), F.col("wanted").alias("__w"), "__last")
    found = rows.join(last, F.col("client_id").eqNullSafe(F.col("__c")) & (F.col("wanted") == F.col("__w")))
    return found.filter(level <= F.col("__last")).drop("__c", "__w", "__last")


def weighted_sample(rows: DataFrame, seed: int, most: int) -> DataFrame:
    """Up to ``wanted`` rows of each client without replacement, by weight (Efraimidis-Spirakis keys ln(u) / w).

    u depends on (seed, client, address) alone, so reruns and repartitioning draw the same.  ``most``: a bound of ``wanted`` that the ranking
    is cut by before the shuffle, so that a partition sends on at most that many rows of a client.  Spark cuts up to RANKED rows; beyond
    that counts by level of the key tell which rows can be drawn.  Both draw the same.
    """
    u = N.uniform(F.lit(seed), F.col("client_id"), F.col("address_id"))
    w = Window.partitionBy("client_id").orderBy(F.desc("__key"), "address_id")
    keyed = rows.withColumn("__key", F.ln(u) / F.col("weight"))
    ranked = (_upper(keyed) if most > RANKED else keyed).withColumn("rn", F.row_number().over(w))
    return ranked.filter((F.col("rn") <= most) & (F.col("rn") <= F.col("wanted"))).drop("__key")


def _bounded(spans: DataFrame, seed: int) -> DataFrame:
    """Spans with what a row must reach to be drawn, in all likelihood: ``__rate``, below which -__key lies for some more rows than are wanted,
    and ``__bar``, the least digits of u for that at the highest weight; null and '' where a good part of the rows is wanted.

    1 - exp(-rate w) >= rate w - (rate w)^2 / 2, summed over the weights, gives the rate.
    """
    n, need = F.col("__left").cast("double"), F.least("wanted", "__left")
    some = need + 7 * F.sqrt(need) + 30
    s1, s2 = n * (n + 1) / 2, n * (n + 1) * (2 * n + 1) / 6
    rate = F.when(some <= n / 4, 2 * some / (s1 + F.sqrt(s1 * s1 - 2 * s2 * some)))
    least = F.greatest(F.floor(F.exp(-F.col("__rate") * n) * 4294967296.0) - 1, F.lit(0))
    bar = F.coalesce(F.lpad(F.lower(F.hex(least)), 8, "0"), F.lit(""))
    return spans.withColumn("__rate", rate).withColumns({"__bar": bar, "__salt": F.concat_ws("|", F.lit(seed).cast("string"), F.col("client_id").cast("string"))})


def _likely(spans: DataFrame, placed: DataFrame) -> DataFrame:
    """The rows of ``_met`` above the bounds, with __key.  Digits are compared first, which few rows pass."""
    own = F.concat("__salt", "__address")  # what N.uniform(seed, client, address) is made of, nulls left out
    u = N.uniform(own)
    above = F.col("__rate").isNull() | (F.ln(u) > -F.col("__rate") * (F.col("__r") - F.col("__shift")))
    address = F.coalesce(F.concat(F.lit("|"), F.col("address_id").cast("string")), F.lit(""))
    met = _met(spans, placed.withColumn("__address", address), (F.md5(own) >= F.col("__bar")) & above)
    return met.withColumn("__key", F.ln(u) / F.col("weight")).drop("__rate", "__bar", "__salt", "__address", "__left")


def _drawn(keyed: DataFrame) -> DataFrame:
    w = Window.partitionBy("client_id", "wanted").orderBy(F.desc("__key"), "address_id")
    return keyed.withColumn("rn", F.row_number().over(w)).filter("rn <= wanted").drop("__key")


def _stored(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def assign(sales: DataFrame, clients: DataFrame, assigned: DataFrame, as_of: Column, seed: int, count: int | None = None, columns: list[str] | None = None) -> DataFrame:
    """New assignments of all given clients, with ``columns`` of the sales, or all; ``count`` overrides the clients' own numbers.

    Draws what ``weighted_sample`` draws of ``weighted``.  Each pair is looked at once, and those that can't win go where they are made.  What is drawn is
    written to a new folder beside the checkpoints; clients who got too few for what they have are drawn again out of all their rows.
    """
    if count is not None:
        clients = clients.withColumn("addresses_per_report", F.lit(count))
    members, placed, sizes = _placed(sales, clients.filter("addresses_per_report > 0"), as_of, whole=True)
    if columns is not None:
        placed = placed.select("__g", "__shares", "__r", *dict.fromkeys(["address_id", *columns]))
    folder = shared_folder(sales.sparkSession, "draws")
    spans = _stored(_spans(members, placed, sizes, assigned), f"{folder}/spans")
    picked = _stored(_drawn(_likely(_bounded(spans, seed), placed)), f"{folder}/drawn")
    got = picked.groupBy(F.col("client_id").alias("__c"), F.col("wanted").alias("__w")).agg(F.count("*").alias("__got"))
    same = F.col("client_id").eqNullSafe(F.col("__c")) & (F.col("wanted") == F.col("__w"))
    short = spans.filter("__lo = 0").join(got, same, "left").filter(F.coalesce("__got", F.lit(0)) < F.least("wanted", "__left"))
    short = short.select(F.col("client_id").alias("__c"), F.col("wanted").alias("__w"))
    if not short.isEmpty():
        u = N.uniform(F.lit(seed), F.col("client_id"), F.col("address_id"))
        rest = _met(spans.join(short, same, "left_semi"), placed).drop("__left").withColumn("__key", F.ln(u) / F.col("weight"))
        picked = picked.join(short, same, "left_anti").unionByName(_drawn(_upper(rest)))
    return picked.withColumns({"status": F.lit("new"), "send_date": as_of, "assignment_key": N.stable_id(F.col("client_id"), F.col("address_id"))})


def assigned_counts(sales: DataFrame, clients: DataFrame, assigned: DataFrame, as_of: Column) -> DataFrame:
    """(client_id, n_assigned): how many sales ``assign`` gives each client who gets any, without a draw: of sizes of cells, less what was assigned before."""
    old, cells = _old(sales, as_of), _cells(clients.filter("addresses_per_report > 0"))
    sizes = old.groupBy("city_id", "property_type").agg(F.count("*").alias("__n"))
    gone = old.select("address_id", "city_id", "property_type").join(_before(assigned, cells), "address_id")
    gone = _in_cells(cells, gone, ["client_id"]).withColumn("__n", F.lit(-1))
    both = [x.select("client_id", "wanted", "__n") for x in (_in_cells(cells, sizes), gone)]
    left = both[0].unionByName(both[1]).groupBy("client_id", "wanted").agg(F.least("wanted", F.sum("__n")).alias("__n"))
    return left.filter("__n > 0").groupBy("client_id").agg(F.sum("__n").alias("n_assigned"))


def insufficient(clients: DataFrame, picked: DataFrame, default: int = 10) -> DataFrame:
    """Clients who got fewer than they asked for."""
    return too_few(clients, picked.groupBy("client_id").agg(F.count("*").alias("n_assigned")), default)


def too_few(clients: DataFrame, got: DataFrame, default: int = 10) -> DataFrame:
    """Clients who got fewer than they asked for, by (client_id, n_assigned)."""
    wanted = F.coalesce("addresses_per_report", F.lit(default))
    out = clients.select("client_id", wanted.alias("wanted")).join(got, "client_id", "left").withColumn("n_assigned", F.coalesce("n_assigned", F.lit(0)))
    return out.filter("n_assigned < wanted")
