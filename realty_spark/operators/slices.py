"""Grids, months and price bands: how a market is cut into slices of bounded size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from realty_spark.functions import geo as G
from realty_spark.operators.dedup import first_by
from realty_spark.operators.prefix import sums_before, values_at

# Bounds of the default price bands, and French month names.
BOUNDS = [0, 80000, 120000, 150000, 180000, 220000, 260000, 300000, 350000, 400000, 500000, 600000, 750000, 1000000, 25000000]
MONTHS = ["Janvier", "Février", "Mars", "Avril", "Mai", "Juin", "Juillet", "Août", "Septembre", "Octobre", "Novembre", "Décembre"]
MOST_PRICE = 25000000
CAP = 99


def bounding_boxes(points: DataFrame, key: str) -> DataFrame:
    """The box of each key's points; the default where it has none."""
    ends = {"min_lat": F.min("latitude"), "min_lon": F.min("longitude"), "max_lat": F.max("latitude"), "max_lon": F.max("longitude")}
    return points.groupBy(key).agg(*(F.coalesce(e, F.lit(d)).alias(n) for (n, e), d in zip(ends.items(), G.DEFAULT_BOX)))


def grid_cells(boxes: DataFrame) -> DataFrame:
    """Cells of 17 x 14 km with an overlap of a tenth that cover each box, spread evenly; one centred cell where one is enough."""
    mid = (F.col("min_lat") + F.col("max_lat")) / 2
    df = boxes.withColumns({"w": G.lon_degrees(G.CELL_WIDTH, mid), "h": F.lit(G.lat_degrees(G.CELL_HEIGHT)), "tw": F.col("max_lon") - F.col("min_lon"), "th": F.col("max_lat") - F.col("min_lat")})
    steps = lambda total, size: F.greatest(F.lit(1), F.ceil(F.round(total / (size * (1 - G.OVERLAP)), 9)))
    df = df.withColumns({"nx": steps(F.col("tw"), F.col("w")).cast("int"), "ny": steps(F.col("th"), F.col("h")).cast("int")})
    df = df.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("ny") - 1))).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("nx") - 1)))
    one = (F.col("nx") == 1) & (F.col("ny") == 1)

    def start(low: str, total: str, size: str, n: str, k: str) -> Column:
        spread = F.col(low) + F.when(F.col(n) > 1, F.col(k) * (F.col(total) - F.col(size)) / F.greatest(F.col(n) - 1, F.lit(1))).otherwise(0.0)
        return F.when(one, F.col(low) + F.col(total) / 2 - F.col(size) / 2).otherwise(spread)

    lat, lon = start("min_lat", "th", "h", "ny", "i"), start("min_lon", "tw", "w", "nx", "j")
    kept = [c for c in boxes.columns if c not in ("min_lat", "min_lon", "max_lat", "max_lon")]
    return df.select(*kept, "i", "j", "nx", "ny", lat.alias("cell_lat"), lon.alias("cell_lon"), (lat + F.col("h")).alias("cell_max_lat"), (lon + F.col("w")).alias("cell_max_lon"), F.lit(G.ZOOM).alias("zoom"))


def cell_members(points: DataFrame, cells: DataFrame, key: str) -> DataFrame:
    """Points with each cell that holds them.  Rows and columns are even, so a point's row is reckoned and only its neighbours are joined."""
    shape = cells.groupBy(key).agg(
        F.min("cell_lat").alias("lat0"), F.min("cell_lon").alias("lon0"), F.max("cell_lat").alias("lat1"), F.max("cell_lon").alias("lon1"), F.max("nx").alias("gx"), F.max("ny").alias("gy")
    )
    near = points.join(shape, key)
    at = lambda v, lo, hi, n: F.when(F.col(n) > 1, F.floor((F.col(v) - F.col(lo)) / ((F.col(hi) - F.col(lo)) / (F.col(n) - 1)))).otherwise(0).cast("int")
    near = near.withColumn("i", F.explode(F.sequence(at("latitude", "lat0", "lat1", "gy") - 1, at("latitude", "lat0", "lat1", "gy"))))
    near = near.withColumn("j", F.explode(F.sequence(at("longitude", "lon0", "lon1", "gx") - 1, at("longitude", "lon0", "lon1", "gx"))))
    inside = F.col("latitude").between(F.col("cell_lat"), F.col("cell_max_lat")) & F.col("longitude").between(F.col("cell_lon"), F.col("cell_max_lon"))
    return near.join(cells, [key, "i", "j"]).filter(inside).drop("lat0", "lon0", "lat1", "lon1", "gx", "gy")


def month_slices(cells: DataFrame, first: str, last: str, types: list[str] | None = None) -> DataFrame:
    """Each cell with each month from first to last (YYYY-MM-01) and each of the types, if given: period MM/YYYY, label and property_type."""
    months = cells.sparkSession.range(1).select(F.explode(F.sequence(F.to_date(F.lit(first)), F.to_date(F.lit(last)), F.expr("INTERVAL 1 MONTH"))).alias("month"))
    label = F.concat_ws(" ", F.element_at(F.array(*map(F.lit, MONTHS)), F.month("month")), F.year("month").cast("string"))
    out = cells.crossJoin(F.broadcast(months.select("month", F.date_format("month", "MM/yyyy").alias("period"), label.alias("label"))))  # the months given
    return out.withColumn("property_type", F.explode(F.array(*map(F.lit, types)))) if types else out


def equal_bands(df: DataFrame, low: str, high: str, n: int) -> DataFrame:
    step = (F.col(high) - F.col(low)) / n
    out = df.withColumn("band", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return out.withColumns({"band_min": F.col(low) + F.col("band") * step, "band_max": F.col(low) + (F.col("band") + 1) * step})


def default_band(price: Column) -> Column:
    """The number of the default band of a price, from 0; null outside all."""
    out = F.lit(None).cast("int")
    for i in reversed(range(len(BOUNDS) - 1)):
        out = F.when((price >= BOUNDS[i]) & (price < BOUNDS[i + 1]), i).otherwise(out)
    return out


def positional_quantiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """For each share p the value at place floor(p * n) of a group's sorted values, from 0, and n, the least and the most.

    Rows are first summed to one per (keys, value); places are then looked for by prefixes of the values, so no task sorts a group.
    """
    counted = df.filter(F.col(value) > 0).groupBy(*keys, value).agg(F.count("*").alias("n"))
    picked = values_at(counted, keys, value, "n", {name: F.floor(F.lit(p) * F.col("n")) for name, p in shares.items()})
    ends = counted.groupBy(F.struct(*keys).alias("__g")).agg(F.min(value).alias("least"), F.max(value).alias("most"))
    return picked.withColumn("__g", F.struct(*keys)).join(ends, "__g").select(*keys, "n", "least", "most", *shares)


def data_bands(df: DataFrame, key: str, value: str = "price", parts: int = 6) -> DataFrame:
    """Bands out of a group's prices: up to its 5th percentile, equal parts to the 95th, and the rest; the default bands for groups of under 10."""
    q = positional_quantiles(df, [key], value, {"p05": 0.05, "p95": 0.95})
    low = F.when(F.col("n") >= 20, F.col("p05")).otherwise(F.col("least")).cast("double")
    high = F.when(F.col("n") >= 20, F.col("p95")).otherwise(F.col("most")).cast("double")
    q = q.withColumns({"__l": low, "__h": high}).withColumn("__c", (F.col("__l") + F.col("__h")) / 2)
    tight = F.col("__h") - F.col("__l") < 1000
    q = q.select(key, "n", F.when(tight, F.greatest(F.lit(0.0), F.col("__c") - 500)).otherwise(F.col("__l")).alias("l"), F.when(tight, F.col("__c") + 500).otherwise(F.col("__h")).alias("h"))
    step = (F.col("h") - F.col("l")) / parts
    bands = [F.struct(F.lit(0.0).alias("a"), F.col("l").alias("b"))]
    bands += [F.struct((F.col("l") + i * step).alias("a"), (F.col("l") + (i + 1) * step).alias("b")) for i in range(parts)]
    bands.append(F.struct(F.col("h").alias("a"), F.lit(float(MOST_PRICE)).alias("b")))
    default = F.array(*(F.struct(F.lit(float(a)).alias("a"), F.lit(float(b)).alias("b")) for a, b in zip(BOUNDS, BOUNDS[1:])))
    return q.select(key, "n", F.posexplode(F.when(F.col("n") < 10, default).otherwise(F.array(*bands))).alias("band", "x")).select(key, "n", "band", F.col("x.a").alias("band_min"), F.col("x.b").alias("band_max"))


def refined_bands(df: DataFrame, key: str, low: float = 0.0, high: float = MOST_PRICE, value: str = "price") -> DataFrame:
    """A band cut at its group's sixths (101 sales or more) or quarters; into 8 or 4 equal parts where under 20 have a price."""
    total = df.groupBy(key).agg(F.count("*").alias("n_all"))
    shares = {"s1": 0.167, "s2": 0.333, "s3": 0.5, "s4": 0.667, "s5": 0.833, "q1": 0.25, "q3": 0.75}
    q = total.join(positional_quantiles(df, [key], value, shares), key, "left")
    many, few = F.col("n_all") >= 101, F.coalesce("n", F.lit(0)) < 20
    ends = lambda names: F.array(F.lit(float(low)), *(F.col(c).cast("double") for c in names), F.lit(float(high)))
    equal = lambda n: F.array(*(F.lit(low + i * (high - low) / n) for i in range(n + 1)))
    cuts = F.when(few & many, equal(8)).when(few, equal(4)).when(many, ends(["s1", "s2", "s3", "s4", "s5"])).otherwise(ends(["q1", "s3", "q3"]))
    q = q.select(key, "n_all", cuts.alias("cuts"))
    return q.select(key, "n_all", "cuts", F.explode(F.sequence(F.lit(0), F.size("cuts") - 2)).alias("band")).select(
        key, "n_all", "band", F.element_at("cuts", F.col("band") + 1).alias("band_min"), F.element_at("cuts", F.col("band") + 2).alias("band_max")
    )


def split_point(low: Column, high: Column) -> Column:
    """The middle of a band; narrow ones are cut a fixed step above their start."""
    wide = high - low
    return F.when(wide < 1000, low + 1000).when(wide < 5000, low + 2500).otherwise((low + high) / 2)


def slice_sizes(rows: DataFrame, keys: list[str], cap: int = CAP) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).withColumn("over", F.col("n") >= cap)


def capped_slices(rows: DataFrame, keys: list[str], cap: int = CAP) -> DataFrame:
    """Slices (keys, band_min, band_max, n) with fewer than ``cap`` rows, half-open by price; a slice whose prices cannot be told apart stays.

    Rows are first summed to one per (keys, price).  Sums over the lower prices then give each price its slice: rows are dealt by halves of the cap, so
    that a slice, with the price on which it ends, stays under the cap; a price with half a cap of rows is a slice of its own.
    """
    prices = rows.groupBy(*keys, F.floor("price").alias("price")).agg(F.count("*").alias("n")).withColumn("__big", (F.col("n") >= cap // 2).cast("long"))
    placed = sums_before(prices, keys, "price", ["n", "__big"])
    group, bigs = F.floor(F.col("n_before") / F.lit(max(cap // 2, 1))), F.col("__big_before") + F.col("__big")
    own = F.concat(F.lit("p"), F.coalesce(F.col("price").cast("string"), F.lit("")))
    placed = placed.withColumn("slice", F.when(F.col("__big") == 1, own).otherwise(F.concat_ws("-", group.cast("string"), bigs.cast("string"))))
    return placed.groupBy(*keys, "slice").agg(F.min("price").alias("band_min"), (F.max("price") + 1).alias("band_max"), F.sum("n").alias("n")).drop("slice")


# The groups of types that a slice over the cap is split into before prices are.
TYPE_GROUPS = {"apartment": "apartments", "house": "houses"}


def capped_by_type(rows: DataFrame, keys: list[str], cap: int = CAP) -> DataFrame:
    """Slices (keys, type_group, band_min, band_max, n): keys under the cap are one slice ``all``, others are split by type group and, where that is still too large, by price."""
    group = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in TYPE_GROUPS.items() for x in pair)), F.col("property_type")), F.lit("others"))
    counted = rows.groupBy(*keys, group.alias("type_group")).agg(F.count("*").alias("__n"))
    small = counted.groupBy(*keys).agg((F.sum("__n") < cap).alias("__small"))
    marked = rows.withColumn("type_group", group).join(small, keys)
    marked = marked.withColumn("type_group", F.when(F.col("__small"), F.lit("all")).otherwise(F.col("type_group")))
    whole = marked.groupBy(*keys, "type_group").agg((F.floor(F.min("price"))).alias("band_min"), (F.floor(F.max("price")) + 1).alias("band_max"), F.count("*").alias("n"))
    over = whole.filter(F.col("n") >= cap).select(*keys, "type_group")
    return whole.filter(F.col("n") < cap).unionByName(capped_slices(marked.join(over, [*keys, "type_group"], "left_semi"), [*keys, "type_group"], cap))


def with_subdivisions(parents: DataFrame, parts: DataFrame, key: str) -> DataFrame:
    """The rows collected for slices and those for their subdivisions, each once; ``origin`` tells parent before part."""
    both = parents.withColumn("origin", F.lit("parent")).unionByName(parts.withColumn("origin", F.lit("part")))
    return first_by(both, [key], ["origin"])
