"""Stage files and exports."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share, under that of spark.checkpoint.dir; where this is unset, a temporary one in local mode only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{base or 'file://' + tempfile.mkdtemp(prefix='realty-')}/realty-{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, pattern: str) -> None:
    """Remove the files and folders whose paths fit a pattern, if there are any."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    files = fs_path(pattern).getFileSystem(spark._jsc.hadoopConfiguration())
    for found in files.globStatus(fs_path(pattern)) or []:
        files.delete(found.getPath(), True)


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def city_files(spark: SparkSession, path: str, schema: T.StructType, cities: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """Rows of files whose names hold a city's name or postcode, with city_id; smaller files are skipped."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(path).filter(F.col("length") >= least_bytes)
    names = listed.select(F.element_at(F.split("path", "/"), -1).alias("file_name"))  # a listing: no file is read
    # words of file names and of cities meet by their first: "lille_59000.csv" is of "Lille" and of 59000
    words = F.filter(F.split(F.lower("file_name"), "[^a-z0-9]+"), lambda w: w != "")
    called = cities.select("city_id", F.explode(F.array(F.array_join(F.filter(F.split(F.lower("name"), "[^a-z0-9]+"), lambda w: w != ""), "_"), F.lower("postal_code"))).alias("called")).filter("called <> ''")
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.size(words)), lambda a: F.transform(F.sequence(F.lit(1), F.size(words) - a + 1), lambda n: F.array_join(F.slice(words, a, n), "_"))))
    owner = names.filter(F.size(words) > 0).select("file_name", F.explode(F.array_distinct(runs)).alias("called")).join(called, "called").groupBy("file_name").agg(F.min("city_id").alias("city_id"))
    rows = spark.read.schema(schema).option("header", True).option("pathGlobFilter", "*.csv").csv(path).select("*", F.col("_metadata.file_name").alias("file_name"))
    return rows.join(F.broadcast(owner), "file_name")  # a row a file of the listing


def write_stage(df: DataFrame, path: str, form: str = "parquet") -> None:
    df.write.mode("overwrite").option("header", True).format(form).save(path)


def not_empty(columns: list[str]) -> Column:
    """True where a column of a row is neither null, nor 0, nor ''."""
    out = F.lit(False)
    for c in columns:
        out = out | ~F.coalesce(F.col(c).cast("string"), F.lit("")).isin("", "0", "0.0")
    return out


def export(df: DataFrame, path: str, run: str, city: str = "city_name", main: list[str] | None = None) -> None:
    """CSV files by city and run; rows without a value in the main columns are left out; no row still writes a header.

    A run that is exported again replaces what it had written, in all cities; other runs stay.  An export that fails is to be run again.
    """
    # The main columns.
    main = main or [c for c in ("address_raw", "city_name", "price", "surface", "rooms", "sale_date") if c in df.columns]
    out = df.filter(not_empty(main)).withColumns({"run": F.lit(run), "city": F.col(city)})
    spark = df.sparkSession
    for old in (f"{path}/city=*/run={run}", f"{path}/run={run}"):
        remove(spark, old)
    out.write.mode("append").partitionBy("city", "run").option("header", True).csv(path)
    made = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/city=*/run={run}")
    if not made.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(made):  # no row was written: a header alone
        df.limit(0).coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}/run={run}")
