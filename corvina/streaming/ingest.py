"""The crawl log as a stream: the last line of a sid counts, by epoch, then by file and place in it.

Each epoch writes a run: the titled lines of its batch as they come, without a shuffle. Every ``fan`` runs of one length are merged to a
longer one, which has the last line of each sid, so a line is written once for each power of ``fan`` up to the number of epochs, however large the table is. A run is named
by the epochs it spans and complete when it has its mark of success, so an epoch that is given again, or a merge that was broken
off, is written anew and changes nothing."""

from __future__ import annotations

import re

from py4j.java_gateway import JavaObject
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corvina import schemas
from corvina.sources.readers import last_wins

FAN = 8
ORDER = ("_epoch", "_file", "_block", "_line")


def batch_run(lines: DataFrame, epoch: int) -> DataFrame:
    """The titled lines of a batch (value, _file, _block), each with its place. Lines that aren't JSON have no title."""
    rows = lines.withColumns({"_line": F.monotonically_increasing_id(), "r": F.from_json("value", schemas.RAW)})
    rows = rows.select("r.*", F.lit(epoch).cast("long").alias("_epoch"), "_file", "_block", "_line")
    return rows.filter(F.coalesce("作品名稱", F.lit("")) != "")


def store_of(spark: SparkSession, target: str) -> tuple[JavaObject, JavaObject]:
    """The file system of a folder, and its path there."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def complete(spark: SparkSession, target: str) -> list[tuple[int, int]]:
    """(first, last) epochs of the complete runs, the longest of those that begin together first."""
    store, path = store_of(spark, target)
    if not store.exists(path):
        return []
    there = [s.getPath() for s in store.listStatus(path)]
    spans = [re.fullmatch(r"run=(\d+)-(\d+)", p.getName()) for p in there if store.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(((int(m[1]), int(m[2])) for m in spans if m), key=lambda x: (x[0], -x[1]))


def current(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The runs that together hold all epochs, each once."""
    out: list[tuple[int, int]] = []
    for first, last in spans:
        if not out or first > out[-1][1]:
            out.append((first, last))
    return out


def place(target: str, span: tuple[int, int]) -> str:
    return f"{target}/run={span[0]:09d}-{span[1]:09d}"


def merged(spark: SparkSession, target: str, spans: list[tuple[int, int]]) -> tuple[int, int]:
    """Several runs in a row written as one."""
    whole = spans[0][0], spans[-1][1]
    rows = spark.read.parquet(*(place(target, s) for s in spans))
    last_wins(rows, ["sid"], *ORDER).write.mode("overwrite").parquet(place(target, whole))
    return whole


def add(spark: SparkSession, lines: DataFrame, epoch: int, target: str, fan: int = FAN) -> None:
    """One epoch, and the merges that are due with it."""
    batch_run(lines, epoch).write.mode("overwrite").parquet(place(target, (epoch, epoch)))
    length = fan
    while (epoch + 1) % length == 0:
        due = [s for s in current(complete(spark, target)) if epoch + 1 - length <= s[0] and s[1] <= epoch]
        if len(due) > 1:
            merged(spark, target, due)
        length *= fan


def start(spark: SparkSession, source: str, target: str, checkpoint: str, fan: int = FAN, files: int | None = None) -> StreamingQuery:
    """Reads what is there, at most ``files`` files an epoch, and ends."""
    stream = spark.readStream.option("maxFilesPerTrigger", files) if files else spark.readStream
    lines = stream.text(source).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"))
    write = lambda batch, epoch: add(spark, batch, epoch, target, fan)
    return lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def records(spark: SparkSession, target: str) -> DataFrame:
    """The last record of each sid over all epochs; no rows before the first."""
    runs = current(complete(spark, target))
    if not runs:
        return spark.createDataFrame([], schemas.RAW)
    return last_wins(spark.read.parquet(*(place(target, s) for s in runs)), ["sid"], *ORDER).select(*schemas.RAW.names)


def latest(spark: SparkSession, target: str) -> str | None:
    """The folder of one run over all epochs with a row for each sid, which is written if there is none; none before the first epoch."""
    runs = current(complete(spark, target))
    if not runs:
        return None
    if len(runs) > 1 or runs[0][0] < runs[0][1]:
        return place(target, runs[0] if len(runs) == 1 else merged(spark, target, runs))
    last_wins(spark.read.parquet(place(target, runs[0])), ["sid"], *ORDER).write.mode("overwrite").parquet(f"{target}/whole")  # of one epoch
    return f"{target}/whole"


def cleared(spark: SparkSession, target: str) -> list[str]:
    """Deletes the runs that a longer one holds, and says which. For times when nothing reads them."""
    spans = complete(spark, target)
    kept = set(current(spans))
    store, _ = store_of(spark, target)
    gone = [place(target, s) for s in spans if s not in kept]
    for folder in gone:
        store.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder), True)
    return gone
