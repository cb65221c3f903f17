"""Outputs of bounded size: folders with at most so many files, chunks of bytes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvina.operators.stored import stored


def bins(counts: Column, limit: int) -> Column:
    """From an array of struct(key, n) in order of key: an array of struct(key, n, bin). A bin is closed before what would take
    it over the limit; a single key over the limit has a bin of its own. Sequential, over the keys of one group (years or
    editions, not files)."""
    start = F.struct(F.lit(0).alias("bin"), F.lit(0).cast("long").alias("fill"), F.array().cast("array<int>").alias("bins"))

    def add(acc: Column, x: Column) -> Column:
        over = (acc["fill"] > 0) & (acc["fill"] + x["n"] > limit)
        bin_ = acc["bin"] + over.cast("int")
        return F.struct(bin_.alias("bin"), F.when(over, x["n"]).otherwise(acc["fill"] + x["n"]).alias("fill"), F.concat(acc["bins"], F.array(bin_)).alias("bins"))

    numbers = F.aggregate(counts, start, add, lambda acc: acc["bins"])
    return F.zip_with(counts, numbers, lambda x, b: F.struct(x["key"].alias("key"), x["n"].alias("n"), b.alias("bin")))


def greedy(rows: DataFrame, group: str, key: str, limit: int = 300) -> DataFrame:
    """(group, key, n, bin) by first counting the rows of each key."""
    counts = rows.groupBy(group, key).agg(F.count("*").alias("n")).groupBy(group).agg(F.array_sort(F.collect_list(F.struct(F.col(key).alias("key"), "n"))).alias("c"))
    return counts.select(group, F.inline(bins(F.col("c"), limit))).withColumnRenamed("key", key)


def ranged_folders(rows: DataFrame, group: str, key: str, limit: int = 300, unit: str = "年", prefix: str = "") -> DataFrame:
    """(group, key, n, folder): the group's name, with the range of its keys if it has more than one bin."""
    out = greedy(rows, group, key, limit)
    one = Window.partitionBy(group, "bin")
    low, high, several = F.min(key).over(one), F.max(key).over(one), F.max("bin").over(Window.partitionBy(group)) > 0
    span = F.when(low == high, F.concat(F.lit(prefix), low.cast("string"), F.lit(unit))).otherwise(F.concat(F.lit(prefix), low.cast("string"), F.lit("-"), high.cast("string"), F.lit(unit)))
    return out.withColumn("folder", F.when(several, F.concat(F.col(group), F.lit("_"), span)).otherwise(F.col(group))).select(group, key, "n", "folder")


def half_split(rows: DataFrame, group: str, key: str, limit: int = 300) -> DataFrame:
    """(group, key, n, folder): one folder for up to ``limit`` rows, else two, cut at the median of the keys. A half may be
    over the limit."""
    counts = rows.groupBy(group, key).agg(F.count("*").alias("n"))
    whole = counts.groupBy(group).agg(F.sum("n").alias("total"), F.array_sort(F.collect_set(key)).alias("keys"))
    split = whole.withColumn("cut", F.get("keys", F.floor(F.size("keys") / 2).cast("int")))
    before, after = F.filter("keys", lambda k: k < F.col("cut")), F.filter("keys", lambda k: k >= F.col("cut"))
    name = lambda a: F.concat(F.col(group), F.lit("_第"), F.array_min(a).cast("string"), F.when(F.array_min(a) != F.array_max(a), F.concat(F.lit("-"), F.array_max(a).cast("string"))).otherwise(""), F.lit("屆"))
    named = split.select(group, "total", "cut", F.when(F.size(before) > 0, name(before)).alias("_a"), name(after).alias("_b"))
    folder = F.when(F.col("total") <= limit, F.col(group)).when(F.col(key) < F.col("cut"), F.col("_a")).otherwise(F.col("_b"))
    return counts.join(named, group).select(group, key, "n", folder.alias("folder"))


def ranges(sizes: DataFrame, n: int) -> DataFrame:
    """(p, id, size) from (id, size): rows in order of id, in n ranges, each a partition; written, so that they stay where they are."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = TaskContext.get().partitionId()
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.full(b.num_rows, p, np.int32)), *b.columns], ["p", "id", "size"])

    return stored(sizes.repartitionByRange(n, "id").sortWithinPartitions("id", "size").mapInArrow(apply, "p int, id long, size long"))


def passages(size: np.ndarray, start: int, limit: int) -> Callable[[int], tuple[int, int]]:
    """For one range, whose texts begin at the place ``start`` of the whole: from the place where the open chunk began when the range
    is entered to that when it is left, and how many chunks were closed in between."""
    end = start + np.cumsum(size)
    closes = np.searchsorted(end, end - size + limit, "right")  # by the row that a chunk begins with the row that closes it
    place, closed = (end - size).tolist(), [0] * len(size)
    for i in range(len(size) - 1, -1, -1):
        c = int(closes[i])
        if c < len(size):
            last = c + 1 == len(size)
            place[i], closed[i] = (int(end[c]), 1) if last else (place[c + 1], closed[c + 1] + 1)

    def through(x: int) -> tuple[int, int]:
        c = int(np.searchsorted(end, x + limit, "right"))
        if c == len(size):
            return x, 0
        return (int(end[c]), 1) if c + 1 == len(size) else (place[c + 1], closed[c + 1] + 1)

    return through


def crossings(rows: DataFrame, starts: list[int], limit: int) -> DataFrame:
    """(b, x, b2, x2, n): if a chunk that began at x is open as range b is entered, one that began at x2 is as b2 = b + 1 is, and n chunks are
    closed in b. For every x that may be so: the begin of any row that lies at most the limit before the range."""
    n = len(starts)

    def openings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, fill = np.array(starts), None
        for b in batches:
            p, size = b.column(0).to_numpy(), b.column(2).to_numpy()
            if len(size):
                fill = starts[p[0]] if fill is None else fill
                x = fill + np.cumsum(size) - size
                fill = int(x[-1] + size[-1])
                first, last = np.searchsorted(at, x, "left"), np.searchsorted(at, x + limit, "right")
                many = np.maximum(0, last - first)
                which = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first, many)
                yield pa.RecordBatch.from_arrays([pa.array(which.astype(np.int32)), pa.array(np.repeat(x, many))], ["p", "x"])

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sizes, through = None, [], None
        for b in batches:
            out = []
            for p, kind, _, value in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if p != at:
                    at, sizes, through = p, [], None
                if kind == 0:
                    sizes.append(value)
                else:
                    through = through or passages(np.array(sizes, np.int64), starts[p], limit)
                    out.append((p, value, p + 1, *through(value)))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True) if out else ([],) * 5, (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["b", "x", "b2", "x2", "n"])

    opened = rows.mapInArrow(openings, "p int, x long").distinct().select("p", F.lit(1).alias("kind"), F.lit(0).cast("long").alias("id"), F.col("x").alias("value"))
    both = rows.select("p", F.lit(0).alias("kind"), "id", F.col("size").alias("value")).unionByName(opened)
    return both.repartition(n, "p").sortWithinPartitions("p", "kind", "id", "value").mapInArrow(follow, "b int, x long, b2 int, x2 long, n long")


def entered(steps: DataFrame, n: int) -> list[tuple[int, int]]:
    """For each of n ranges the place where the open chunk began as it is entered, and that chunk's number: steps of one, two, four,
    ... ranges by joining them with themselves, then all ranges from the first by the longest steps first."""
    ways = [stored(steps)]
    while 1 << len(ways) < n:
        one, two = ways[-1], ways[-1].toDF("b2", "x2", "b3", "x3", "m")
        ways.append(stored(one.join(two, ["b2", "x2"]).select("b", "x", F.col("b3").alias("b2"), F.col("x3").alias("x2"), (F.col("n") + F.col("m")).alias("n"))))
    known = steps.sparkSession.createDataFrame([(0, 0, 0)], "b int, x long, k long")
    for way in reversed(ways):
        known = stored(known.unionByName(known.join(way, ["b", "x"]).select(F.col("b2").alias("b"), F.col("x2").alias("x"), (F.col("k") + F.col("n")).alias("k"))).filter(F.col("b") < n))
    found = {r.b: (r.x, r.k) for r in known.collect()}  # a row for each range
    return [found.get(b, (0, 0)) for b in range(n)]


def byte_chunks(rows: DataFrame, id_: str, text: str, limit: int = 6_000_000, extra: int = 12, n: int | None = None) -> DataFrame:
    """(id, chunk): texts in order of id, a chunk closed after the text that takes it over the limit; null and empty texts are
    left out. Ids and sizes are put into n ranges. Where the first chunk of a range begins depends on all before it, so each range tells
    for every place where an open chunk may have begun what it makes of it; these steps are joined to longer ones, and then every
    range numbers its own rows. Only sums of ranges go through the driver."""
    sizes = rows.filter(F.coalesce(text, F.lit("")) != "").select(F.col(id_).cast("long").alias("id"), (F.octet_length(text) + extra).cast("long").alias("size"))
    n = n or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = ranges(sizes, n)
    totals = {r.p: r.total for r in placed.groupBy("p").agg(F.sum("size").alias("total")).collect()}
    starts = [0]
    for p in range(n - 1):
        starts.append(starts[-1] + totals.get(p, 0))
    states = entered(crossings(placed, starts, limit), n)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for b in batches:
            if not b.num_rows:
                continue
            p = b.column(0)[0].as_py()
            x, k, fill = state or (*states[p], starts[p])
            end = fill + np.cumsum(b.column(2).to_numpy())
            chunk, at = np.zeros(len(end), np.int32), 0
            while at < len(end):
                c = min(int(np.searchsorted(end, x + limit, "right")), len(end))
                chunk[at : c + 1] = k
                if c < len(end):
                    x, k = int(end[c]), k + 1
                at = c + 1
            state = x, k, int(end[-1])
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(chunk)], ["id", "chunk"])

    return placed.mapInArrow(apply, "id long, chunk int")


def merged_small(groups: DataFrame, existing: DataFrame, least: int = 5) -> DataFrame:
    """(base, stage, n, target): groups of fewer than ``least`` files without a folder go to the stage's rest."""
    there = existing.select("base").distinct().withColumn("_e", F.lit(True))
    small = (F.col("n") < least) & F.col("_e").isNull()
    return groups.join(there, "base", "left").select("base", "stage", "n", F.when(small, F.concat(F.lit("其他_"), F.col("stage"))).otherwise(F.col("base")).alias("target"))


RANGE = r"^(.*)_第(\d+)-(\d+)屆$"


def incremental(files: DataFrame, existing: DataFrame, limit: int = 300, least: int = 5) -> tuple[DataFrame, DataFrame]:
    """New files among the folders that there are: (id, folder) of files (id, base, edition), and (folder, renamed) of folders that get
    another name. existing: (folder, edition, n), the files that each folder has of each edition, an edition null for an empty folder.
    A base is a subject, '_' and a stage, without '_第'.

    Bases with fewer than ``least`` new files and no folder, plain or ranged, go to the stage's rest. Of a base's ranged folders the one
    with the least first edition counts: with room for all that is new it is widened to it, otherwise what is new has a range of its own.
    Without one the plain folder takes what is new if it has room; if not it is renamed to the range it holds. A base without folders has
    a plain one. A folder that isn't there yet and would be over the limit is cut into ranges; an edition over it stays whole.

    The rules run on one row a base, its editions as an array; files are joined to the outcome by base and edition. Files without a base
    or an edition have no folder; no files, no rows."""
    known = files.filter(F.col("base").isNotNull() & F.col("edition").isNotNull())
    counts = known.groupBy("base", "edition").agg(F.count("*").alias("n"))
    heads = existing.groupBy("folder").agg(F.sum("n").alias("held"), F.min("edition").alias("low"), F.max("edition").alias("high"))
    there = heads.select(F.regexp_replace("folder", "_第.*$", "").alias("base")).distinct().withColumn("_e", F.lit(True))
    small = (F.col("n") < least) & F.col("_e").isNull()
    rest = F.concat(F.lit("其他_"), F.substring_index("base", "_", -1))
    names = counts.groupBy("base").agg(F.sum("n").alias("n")).join(there, "base", "left").select("base", F.when(small, rest).otherwise(F.col("base")).alias("_to"))

    by_edition = counts.join(names, "base").groupBy(F.col("_to").alias("base"), F.col("edition").alias("key")).agg(F.sum("n").alias("n"))
    groups = by_edition.groupBy("base").agg(F.array_sort(F.collect_list(F.struct("key", "n"))).alias("counts"), F.sum("n").alias("total"), F.min("key").alias("lo"), F.max("key").alias("hi"))
    plain = heads.select(F.col("folder").alias("base"), F.struct("held", "low", "high").alias("plain"))
    number = lambda i: F.regexp_extract("folder", RANGE, i).cast("int")
    spans = heads.filter(F.col("folder").rlike(RANGE)).select(F.regexp_extract("folder", RANGE, 1).alias("base"), F.struct(number(2).alias("first"), "folder", number(3).alias("last"), "held").alias("range"))
    ranged = spans.groupBy("base").agg(F.min("range").alias("range"))

    span = lambda a, b: F.concat("base", F.lit("_第"), a.cast("string"), F.lit("-"), b.cast("string"), F.lit("屆"))
    fits = lambda f: F.col(f)["held"] + F.col("total") <= limit
    own, widened = span(F.col("lo"), F.col("hi")), span(F.least("range.first", "lo"), F.greatest("range.last", "hi"))
    in_range, in_plain = F.when(fits("range"), widened).otherwise(own), F.when(fits("plain"), F.col("base")).otherwise(own)
    folder = F.when(F.col("range").isNotNull(), in_range).when(F.col("plain").isNotNull(), in_plain).otherwise(F.col("base"))
    plan = groups.join(plain, "base", "left").join(ranged, "base", "left").withColumn("folder", folder)

    before = F.when(F.col("range").isNotNull(), F.when(fits("range"), F.col("range.folder"))).when(~fits("plain"), F.col("base"))
    after = F.when(F.col("range").isNotNull(), widened).otherwise(span(F.col("plain.low"), F.col("plain.high")))
    renames = plan.select(before.alias("folder"), after.alias("renamed")).filter("folder <> renamed")

    made = plan.join(heads.select("folder", F.lit(True).alias("_e")), "folder", "left").withColumn("_cut", (F.col("total") > limit) & F.col("_e").isNull())
    rows = made.select("base", "folder", "_cut", F.inline(bins(F.col("counts"), limit)))
    one = Window.partitionBy("base", "bin")
    final = rows.select(F.col("base").alias("_to"), F.col("key").alias("edition"), F.when(F.col("_cut"), span(F.min("key").over(one), F.max("key").over(one))).otherwise(F.col("folder")).alias("folder"))
    return files.join(names, "base", "left").join(final, ["_to", "edition"], "left").select("id", "folder"), renames


def preview(plan: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(folders with their counts, files in order) of a plan (folder, edition, code, ...)."""
    return plan.groupBy("folder").agg(F.count("*").alias("n"), F.min("edition").alias("first"), F.max("edition").alias("last")).orderBy("folder"), plan.orderBy("folder", "edition", "code")
