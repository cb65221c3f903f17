"""Helpers that the operators of this package share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Only where that setting is absent and driver and
    tasks are one process (tests, one machine) is a temporary folder made; a cluster without the setting is an error."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if sc.getCheckpointDir() is None:
        if not named and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("a cluster needs spark.checkpoint.dir, a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="corvina-"))
    return named or sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder, so that a lost executor costs no recomputation of its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def tidy(spark: SparkSession) -> None:
    """Has the driver collect its garbage, upon which Spark removes the shuffles and cut tables that nothing refers to any more. A chain of
    many steps would else keep them all until the driver's memory is full."""
    spark.sparkContext._jvm.System.gc()


def row_key(doc_id: str, text: str) -> list:
    """Columns that name a row of documents even where ids repeat: the id and a hash of the text."""
    return [F.col(doc_id).alias("_id"), F.xxhash64(F.col(text)).alias("_th")]


def sent_if_few(df: DataFrame, most: int = 200_000) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``most`` rows, which are counted; else as it is, for a join by shuffle.
    For materialised frames of narrow rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
