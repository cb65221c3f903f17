"""Snapshots of a source: what is to be fetched, what has changed, what is new."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvina import rules
from corvina.functions import text as T


def remaining(wanted: DataFrame, done: DataFrame, key: str = "sid") -> DataFrame:
    return wanted.join(done.select(key).distinct(), key, "left_anti")


def to_check(old: DataFrame, ahead: int = 2000) -> DataFrame:
    """Known sids and the next ones."""
    top = old.agg(F.max("sid").alias("top")).select(F.explode(F.sequence(F.col("top") + 1, F.col("top") + ahead)).alias("sid"))
    return old.select("sid").union(top)


def comparable(c: str, kind: str) -> Column:
    return T.strip(F.coalesce(F.array_join(c, " ") if kind.startswith("array") else F.col(c), F.lit("")))


def states(old: DataFrame, new: DataFrame) -> DataFrame:
    """old with ``state``: failed (the new row is an error), gone (no titled new row), there."""
    fetched = new.select(F.col("sid"), F.lit(True).alias("_n"), F.col("error").alias("_e"), F.col("作品名稱").alias("_t"))
    state = F.when(F.col("_e").isNotNull(), "failed").when(F.coalesce("_t", F.lit("")) == "", "gone").otherwise("there")
    return old.join(fetched, "sid", "left").select(*old.columns, state.alias("state"))


def differences(old: DataFrame, new: DataFrame, fields: tuple[str, ...] = rules.FIELDS, most: int = 200) -> DataFrame:
    """(sid, field, old, new): fields of titled new rows that differ after trimming; values are cut for display."""
    kinds = dict(old.dtypes)
    values = lambda name: F.array(*(F.struct(F.lit(f).alias("field"), comparable(f"{name}.{f}", kinds[f]).alias("v")) for f in fields))
    both = old.alias("o").join(new.filter("error is null and coalesce(`作品名稱`, '') <> ''").alias("n"), F.col("o.sid") == F.col("n.sid"))
    pairs = F.zip_with(values("o"), values("n"), lambda a, b: F.struct(a["field"].alias("field"), a["v"].alias("old"), b["v"].alias("new")))
    rows = both.select(F.col("o.sid").alias("sid"), F.explode(F.filter(pairs, lambda x: x["old"] != x["new"])).alias("d"))
    return rows.select("sid", "d.field", F.left("d.old", F.lit(most)).alias("old"), F.left("d.new", F.lit(most)).alias("new"))


def additions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Titled rows behind the largest known sid; the maximum is one row."""
    top = old.agg(F.max("sid").alias("top"))
    return new.filter(F.coalesce("作品名稱", F.lit("")) != "").join(F.broadcast(top), F.col("sid") > F.col("top")).drop("top")


def summary(old: DataFrame, new: DataFrame, date: str) -> DataFrame:
    """One row: date, known, differences, works with differences, gone, failed, new."""
    d = differences(old, new).agg(F.count("*").alias("differences"), F.countDistinct("sid").alias("works_changed"))
    s = states(old, new).agg(F.count("*").alias("known"), F.count_if(F.col("state") == "gone").alias("gone"), F.count_if(F.col("state") == "failed").alias("failed"))
    return s.crossJoin(d).crossJoin(additions(old, new).agg(F.count("*").alias("added"))).withColumn("date", F.lit(date))
