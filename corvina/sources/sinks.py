"""Sinks. Outputs with one file for each key or of bounded size are partitioned writes; nothing is moved or deleted here, but for
plans (which file goes where) that come as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def json_lines(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Null fields are left out; characters are written as they are."""
    df.write.mode(mode).option("ignoreNullFields", True).json(path)


def by_key(df: DataFrame, key: str, path: str) -> None:
    """A folder for each key. Rows of a key are brought together first, so that it has one file."""
    df.repartition(key).write.mode("overwrite").partitionBy(key).json(path)


def appended(df: DataFrame, path: str, key: str = "sid") -> None:
    """Adds the rows whose key isn't there yet; a run that was broken off can be repeated."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        df = df.join(spark.read.schema(df.schema).json(path).select(key), key, "left_anti")
    df.write.mode("append").json(path)


def sorted_csv(df: DataFrame, path: str, *order: str) -> None:
    """In order over all files, each with a header."""
    df.orderBy(*order).write.mode("overwrite").option("header", True).csv(path)


def stale(present: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """What is to be deleted: present and not wanted."""
    return present.join(wanted.select(key).distinct(), key, "left_anti")


def size_report(spark_path_listing: DataFrame) -> DataFrame:
    """(name, mb) of files given as (path, length)."""
    return spark_path_listing.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.round(F.col("length") / 1e6, 1).alias("mb"))
