"""The engine's tables, derived from the star-schema tables of a data folder.

Each view is SQL that Spark and DuckDB both read; ``{orders}`` and the like stand for tables and ``{array}`` for the function that makes an array.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

AS_OF = "2003-01-01"

_STREET = "CASE {k} % 4 WHEN 0 THEN 'Rue de la République' WHEN 1 THEN 'Avenue du Général-de-Gaulle' WHEN 2 THEN 'Allée de l''Œuvre (Bât. B)' ELSE 'Place des Prés' END"
_NUMBER = "CAST({k} % 50 + 1 AS STRING)"

VIEWS = {
    "raw_sales": f"""
SELECT o_orderkey AS row_id,
  CASE WHEN o_orderkey % 41 = 0 THEN '  ' WHEN o_orderkey % 13 = 0 THEN {_STREET.format(k="o_custkey")}
       ELSE concat({_NUMBER.format(k="o_orderkey")}, CASE WHEN o_orderkey % 11 = 0 THEN ' B ' ELSE ' ' END, {_STREET.format(k="o_custkey")},
                   CASE WHEN o_orderkey % 3 = 0 THEN concat(', ', n_name) WHEN o_orderkey % 3 = 1 THEN ' 59000 Lille' ELSE '' END) END AS address,
  CASE WHEN o_orderkey % 37 = 0 THEN NULL ELSE concat('Saint-É', lower(n_name)) END AS city,
  CASE WHEN o_orderkey % 17 = 0 THEN '1 200' WHEN o_orderkey % 19 = 0 THEN 'inf' WHEN o_orderkey % 23 = 0 THEN NULL
       ELSE concat(CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING), '.7') END AS price,
  CASE WHEN o_orderkey % 7 = 0 THEN 'x' ELSE concat(CAST(20 + o_orderkey % 180 AS STRING), '.9') END AS surface,
  CAST(1 + o_orderkey % 7 AS STRING) AS rooms,
  CASE WHEN o_orderkey % 43 = 0 THEN '31/02/2023' WHEN o_orderkey % 47 = 0 THEN '2023-01-05'
       ELSE concat(CAST(day(o_orderdate) AS STRING), '/', CAST(month(o_orderdate) AS STRING), '/', CAST(year(o_orderdate) AS STRING)) END AS sale_date,
  CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'Maison' WHEN '2' THEN ' APPARTEMENT' WHEN '3' THEN 'terrains' WHEN '4' THEN 'Local commercial' ELSE 'Château' END AS property_type,
  CASE WHEN o_orderkey % 29 = 0 THEN NULL ELSE concat('https://example.com/sale/', CAST(o_orderkey - o_orderkey % 2 AS STRING)) END AS property_url
FROM {{orders}} JOIN {{customer}} ON o_custkey = c_custkey JOIN {{nation}} ON c_nationkey = n_nationkey
""",
    "sales": f"""
SELECT o_orderkey AS address_id, c_nationkey AS city_id, n_name AS city_name, concat('59', lpad(CAST(c_nationkey AS STRING), 3, '0')) AS insee_code,
  concat({_NUMBER.format(k="o_orderkey")}, ' ', {_STREET.format(k="o_custkey")}) AS address_raw,
  CAST(o_orderdate AS DATE) AS sale_date, concat('59', lpad(CAST(c_nationkey * 7 % 1000 AS STRING), 3, '0')) AS postal_code,
  CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'house' WHEN '2' THEN 'apartment' WHEN '3' THEN 'land' WHEN '4' THEN 'commercial' ELSE 'other' END AS property_type,
  CAST(CASE WHEN o_orderkey % 31 = 0 THEN 0 ELSE 20 + o_orderkey % 180 END AS INT) AS surface, CAST(1 + o_orderkey % 7 AS INT) AS rooms,
  CAST(floor(o_totalprice) AS INT) AS price,
  CASE WHEN o_orderkey % 53 = 0 THEN NULL ELSE CAST(45000000 + (o_orderkey % 50) * 1000 + (o_custkey % 4) * 60000 + (o_orderkey % 7) * 20 AS DOUBLE) / 1000000 END AS latitude,
  CAST(3000000 + c_nationkey * 100000 + (o_orderkey % 5) * 20 AS DOUBLE) / 1000000 AS longitude,
  CASE WHEN o_orderkey % 59 = 0 THEN NULL ELSE CAST(o_orderkey % 21 AS DOUBLE) / 20 END AS geocoding_score,
  CASE o_orderkey % 9 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' WHEN 3 THEN 'D' WHEN 4 THEN 'E' WHEN 5 THEN 'F' WHEN 6 THEN 'G' WHEN 7 THEN 'N' END AS dpe_energy_class,
  concat('https://example.com/sale/', CAST(o_orderkey AS STRING)) AS source_url
FROM {{orders}} JOIN {{customer}} ON o_custkey = c_custkey JOIN {{nation}} ON c_nationkey = n_nationkey
""",
    "cities": """
SELECT n_nationkey AS city_id, n_name AS name, r_name AS region, concat('59', lpad(CAST(n_nationkey AS STRING), 3, '0')) AS insee_code,
  concat('59', lpad(CAST(n_nationkey * 7 % 1000 AS STRING), 3, '0')) AS postal_code, CAST(100000 + n_nationkey * 1000 AS INT) AS house_price_avg,
  CASE WHEN n_nationkey % 4 = 0 THEN NULL WHEN n_nationkey % 4 = 1 THEN 'never' WHEN n_nationkey % 4 = 2 THEN '2001-12-31' ELSE '2002-06-01' END AS last_scraped
FROM {nation} JOIN {region} ON n_regionkey = r_regionkey
""",
    "clients": """
SELECT s_suppkey AS client_id, s_name AS first_name, CASE WHEN s_suppkey % 8 = 5 THEN '' WHEN s_suppkey % 8 <> 6 THEN concat('Martin ', CAST(s_suppkey AS STRING)) END AS last_name, concat('client', CAST(s_suppkey AS STRING), CASE WHEN s_suppkey % 9 = 0 THEN ' at ' ELSE '@' END, 'example.com') AS email,
  CASE s_suppkey % 4 WHEN 0 THEN '06 12 34 56 78' WHEN 1 THEN '+33612345678' WHEN 2 THEN '12345' END AS telephone,
  CASE s_suppkey % 5 WHEN 0 THEN 'decouverte' WHEN 1 THEN 'pro' WHEN 2 THEN 'entreprise' WHEN 3 THEN 'gold' END AS subscription_type,
  CASE WHEN s_suppkey % 10 = 0 THEN 'inactive' ELSE 'active' END AS status, CAST(s_suppkey % 33 AS INT) AS send_day,
  CAST(s_suppkey % 12 + 1 AS INT) AS addresses_per_report,
  {array}(s_nationkey, (s_nationkey + 1) % 25) AS chosen_cities,
  CASE WHEN s_suppkey % 2 = 0 THEN {array}('house', 'apartment') ELSE {array}('apartment', 'land', 'other') END AS property_type_preferences
FROM {supplier}
""",
    "assignments": """
SELECT l_suppkey AS client_id, l_orderkey AS address_id, min(CAST(l_shipdate AS DATE)) AS send_date,
  CASE (l_suppkey + l_orderkey) % 3 WHEN 0 THEN 'new' WHEN 1 THEN 'contacted' ELSE 'sold' END AS status
FROM {lineitem} GROUP BY l_suppkey, l_orderkey
""",
    "certificates": f"""
SELECT p_partkey AS certificate_id, CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE concat('DPE', CAST(p_partkey - p_partkey % 3 AS STRING)) END AS dpe_number,
  CAST(1 + p_partkey % 5 AS INT) AS feed_priority, concat('59', lpad(CAST(p_partkey % 25 AS STRING), 3, '0')) AS code_insee,
  concat(CAST(p_size AS STRING), ' ', {_STREET.format(k="p_partkey")}) AS adresse,
  concat(CAST(CAST(45000000 + (p_size - 1) * 1000 + (p_partkey % 4) * 60000 + (p_partkey % 3) * 30 AS DOUBLE) / 1000000 AS STRING), ',',
         CAST(CAST(3000000 + (p_partkey % 25) * 100000 + (p_partkey % 2) * 40 AS DOUBLE) / 1000000 AS STRING)) AS geopoint,
  CASE p_partkey % 8 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' WHEN 3 THEN 'D' WHEN 4 THEN 'E' WHEN 5 THEN 'F' WHEN 6 THEN 'G' END AS etiquette_dpe,
  concat('59', lpad(CAST(p_partkey % 25 * 7 % 1000 AS STRING), 3, '0')) AS code_postal, concat('NATION_', CAST(p_partkey % 25 AS STRING)) AS commune,
  CASE p_partkey % 5 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' END AS etiquette_ges, CASE WHEN p_partkey % 4 > 0 THEN '2001-06-15' END AS date_reception, '2000-01-02' AS date_etablissement,
  CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE CAST(1700 + p_partkey % 330 AS STRING) END AS annee_construction,
  CASE WHEN p_partkey % 2 = 0 THEN '1948-1974' ELSE 'avant 1948' END AS periode_construction
FROM {{part}}
""",
    "jobs": """
SELECT event_id AS job_id, user_id AS client_id, CASE event_id % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'processing' WHEN 2 THEN 'completed' ELSE 'failed' END AS status,
  CAST(1 + event_id % 3 AS INT) AS attempt_count, ts AS created_at, CAST(ts AS DATE) AS updated_on,
  CASE event_id % 5 WHEN 0 THEN 'Client Not Found or Inactive' WHEN 1 THEN 'timeout' WHEN 2 THEN 'no chosen cities for client' WHEN 3 THEN 'connection reset' END AS error_message
FROM {events}
""",
    "market": """
SELECT c_nationkey AS city_id, min(n_name) AS name, concat('59', lpad(CAST(c_nationkey AS STRING), 3, '0')) AS insee_code,
  CASE WHEN c_nationkey % 3 = 0 THEN NULL ELSE CAST(count(*) AS INT) END AS house_price_avg
FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey WHERE c_nationkey % 2 = 0 GROUP BY c_nationkey
UNION ALL SELECT 100, 'NEWTOWN', '59100', 250000 FROM {region} WHERE r_regionkey = 0
""",
    "growth": """
SELECT n_nationkey AS city_id, 'house' AS property_type, CAST(n_nationkey - 12 AS DOUBLE) / 100 AS rate FROM {nation} WHERE n_nationkey % 2 = 0
UNION ALL SELECT n_nationkey, 'apartment', 0.02e0 FROM {nation}
""",
}
#: Pages of listings and of market prices, rendered out of other views for Spark to read back: page_id, html.
_WORD = "CASE property_type WHEN 'house' THEN 'Maison' WHEN 'apartment' THEN 'Appartement' WHEN 'land' THEN 'Terrain' WHEN 'commercial' THEN 'Local commercial' ELSE 'Autre' END"
_CARD = f"""concat('<div class="card', CASE WHEN address_id % 13 = 5 THEN ' hidden' ELSE '' END, '">', CASE WHEN address_id % 11 = 3 THEN '<div class="skeleton">..............................</div>' ELSE '' END,
  CASE WHEN address_id % 17 = 2 THEN 'kurz' ELSE concat('<p class="address">', address_raw, ' - ', city_name, CASE WHEN address_id % 2 = 0 THEN concat(' ', insee_code) ELSE '' END, '</p>',
    CASE WHEN address_id % 19 = 4 THEN '' ELSE concat('<p class="price"><span>', CAST(price AS STRING), ' €</span></p>') END, '<p class="surface">', CAST(surface AS STRING), ',5 m²</p><p class="rooms"> ', CAST(rooms AS STRING), '</p>',
    CASE address_id % 5 WHEN 0 THEN concat('<p class="type"><svg>icone</svg><span>', {_WORD}, '</span></p>') WHEN 1 THEN concat('<p class="type"><svg>icone</svg> bien ', {_WORD}, '</p>')
      WHEN 2 THEN concat('<span>', {_WORD}, '</span>') WHEN 3 THEN concat('<p>vente: ', {_WORD}, '</p>') ELSE '<p class="alt">Local</p>' END,
    CASE WHEN address_id % 23 = 6 THEN '' ELSE concat('<time data-date="', CAST(CAST(unix_date(sale_date) AS BIGINT) * 86400000 + 43200000 AS STRING), '"></time>') END,
    CASE WHEN address_id % 29 = 0 THEN '' ELSE concat('<a href="/sale/', CAST(address_id - address_id % 2 AS STRING), '">voir</a>') END) END, '</div>')"""
PAGES = {
    "listing_pages": f"""
SELECT page_id, CASE WHEN page_id % 10 = 4 THEN NULL ELSE concat('<html><body><div class="', CASE WHEN page_id % 10 = 5 THEN 'other' ELSE 'list' END, '">', array_join(transform(array_sort(collect_list(struct(address_id, card))), x -> x.card), ''),
  CASE WHEN page_id % 7 = 3 THEN '<div class="card"><p class=' ELSE '</div></body></html>' END) END AS html
FROM (SELECT address_id, address_id DIV 64 AS page_id, {_CARD} AS card FROM {{sales}}) GROUP BY page_id
""",
    "market_pages": """
SELECT city_id AS page_id, CASE WHEN city_id % 9 = 8 THEN NULL ELSE concat('<html><script>var maison = 999;</script><div><p>Maisons - Prix</p>', CASE WHEN city_id % 4 = 1 THEN '' ELSE concat('<p><span>', replace(format_number(house_price_avg, 0), ',', ' '), ' €/m²</span></p>') END,
  '</div><div><p>Appartements - Prix</p>', CASE WHEN city_id % 5 = 2 THEN '' ELSE concat('<p><span>', CAST(1000 + city_id * 13 AS STRING), '\u00a0€</span></p>') END, '</div></html>') END AS html FROM {cities}
""",
}
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]


#: Tables whose rows later work is done on, and bytes from which on a single file of one is dealt to all cores.
DEALT, LEAST_BYTES = ("orders", "part"), 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder.  Where it lies in fewer files than there are cores, and each is read as one part, its rows are dealt to all cores."""
    path = f"{sf_dir}/{name}.parquet"
    df, cores = spark.read.parquet(path), spark.sparkContext.defaultParallelism
    if name not in DEALT or len(df.inputFiles()) >= cores:
        return df
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    size = place.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(place).getLength()
    return df.repartition(cores) if LEAST_BYTES <= size < cores << 27 else df  # larger files are split when they are read


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    used = {t: table(spark, sf_dir, t) for t in TABLES if f"{{{t}}}" in VIEWS[name]}
    return spark.sql(VIEWS[name].replace("{array}", "array"), **used)


def duck(name: str) -> str:
    """The view as a DuckDB subquery."""
    return "(" + VIEWS[name].replace("{array}", "list_value").format(**{t: t for t in TABLES}) + ")"


def pages(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    used = {t: view(spark, sf_dir, t) for t in ("sales", "cities") if f"{{{t}}}" in PAGES[name]}
    return spark.sql(PAGES[name], **used)
