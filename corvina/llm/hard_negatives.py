"""Hard negatives by a vector-approximation file: bounds of scores from quantised components, exact scores for few.

Each dimension has ``CELLS`` cells, cut at quantiles over all rows; a vector's approximation is its cell in each. For a
query two tables hold, by dimension and cell, the least and the greatest product that the cell allows (two dimensions share a
table of ``CELLS`` squared entries); summed look-ups bound the score from both sides. First each anchor's positives are found: a
row of its label is scored exactly only if its upper bound reaches the least score that enough rows are known to reach. Then, for
each window that a positive spans, only rows of other labels are scored whose bounds meet the window and whose upper bound reaches
what the first rows of that window are known to reach. The bounds only save work: the results are exact.

Rows are dealt at random to blocks of about ``ROWS``, anchors to groups of about ``ANCHORS``; each (block, group) is streamed by one
task, the block's rows first, then the anchors, so a task holds one block whatever the size of the tables, and no label, vector or
anchor makes a block larger. Blocks return at most the first few rows of each anchor or window, and a ranking merges these. Nothing
but the cells' marks (a row for each dimension) goes through the driver.

Rows with a null id, label, vector or component, or one that isn't finite, take no part. Components are ``floor(scale * x)`` in
double, held within 2^28 on either side; shorter vectors end in zeros. Ties go to the smaller id. Rows that repeat are rows of
their own (a positive that is found twice is reported once); rows of the anchor's id aren't its positives. Empty tables give empty results; only the three named columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvina.llm.common import cut

CELLS, ROWS, ANCHORS, MOST = 32, 4096, 16_384, 1 << 28


def integer_vectors(df: DataFrame, id_: str, label: Column, vector: str, scale: int = 256) -> DataFrame:
    """(u, id, label, v): the rows that take part, named by u, materialised."""
    v = F.col(vector)
    whole = F.forall(v, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    rows = df.filter(F.col(id_).isNotNull() & label.isNotNull() & v.isNotNull() & whole)
    held = lambda x: F.greatest(F.lit(-MOST), F.least(F.lit(MOST), F.floor(x.cast("double") * scale))).cast("int")
    rows = cut(rows.select(F.monotonically_increasing_id().alias("u"), F.col(id_).cast("long").alias("id"), label.cast("long").alias("label"), F.transform(v, held).alias("v")))
    size = rows.agg(F.max(F.size("v"))).first()[0] or 0
    return rows.withColumn("v", F.concat("v", F.array_repeat(F.lit(0), F.lit(size) - F.size("v"))))


def marks(rows: DataFrame, cells: int = CELLS) -> tuple[np.ndarray, np.ndarray]:
    """(low, high): the least and greatest value of each cell, dimensions x cells; an even number of dimensions."""
    shares = F.array(*(F.lit(i / cells) for i in range(1, cells)))
    each = rows.select(F.posexplode("v").alias("d", "x")).groupBy("d").agg(F.percentile_approx("x", shares, F.lit(1000)).alias("q"), F.min("x").alias("least"), F.max("x").alias("most"))
    found = sorted(each.collect())
    low = np.array([[r.least, *r.q] for r in found], np.int64).reshape(-1, cells)
    high = np.array([[*r.q, r.most + 1] for r in found], np.int64).reshape(-1, cells) - 1
    odd = np.zeros((len(found) % 2, cells), np.int64)
    return np.concatenate([low, odd]), np.concatenate([np.maximum(low, high), odd])


class Block:
    """Rows in order of their label, with their approximations."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, v: np.ndarray, low: np.ndarray, high: np.ndarray):
        order = np.lexsort([ids, labels])
        self.ids, self.labels, self.v, self.low, self.high = ids[order], labels[order], v[order].astype(np.int64), low, high
        self.cells = low.shape[1]
        # the cell is the last one whose least value isn't over the component
        code = np.zeros((len(low), len(ids)), np.intp)
        for d in range(v.shape[1]):
            code[d] = np.searchsorted(low[d, 1:], self.v[:, d], "right")
        self.code = code[0::2] * self.cells + code[1::2]

    def bounds(self, q: np.ndarray, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
        """Of the scores of rows first to last with the vector q."""
        a = np.zeros((len(self.low), 1))
        a[: len(q), 0] = q
        x, y = a * self.low, a * self.high
        one = np.empty(x.shape, np.complex128)  # the least product as the real part, the greatest as the other
        one.real, one.imag = np.minimum(x, y), np.maximum(x, y)
        both = (one[0::2, :, None] + one[1::2, None, :]).reshape(-1, self.cells * self.cells)
        total = np.zeros(last - first, np.complex128)
        for table, code in zip(both, self.code, strict=True):
            total += table.take(code[first:last])
        slack = 0.5 + 1e-12 * np.maximum(np.abs(x), np.abs(y)).max(1, initial=0).sum()
        return total.real - slack, total.imag + slack

    def exact(self, q: np.ndarray, which: np.ndarray) -> np.ndarray:
        return self.v[which] @ q

    def positives(self, own: int, label: int, q: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the first n rows of the label."""
        first, last = np.searchsorted(self.labels, [label, label + 1])
        lower, upper = self.bounds(q, first, last)
        other = self.ids[first:last] != own
        lower = lower[other]
        reach = np.partition(lower, -n)[-n] if len(lower) > n else -np.inf
        which = first + np.flatnonzero(other & (upper >= reach))
        score = self.exact(q, which)
        best = np.lexsort([self.ids[which], -score])[:n]
        return self.ids[which[best]], score[best]

    def negatives(self, label: int, q: np.ndarray, windows: list[tuple[int, int]], n: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each window (least score, greatest score) ids and scores of the first n rows of other labels in it."""
        lower, upper = self.bounds(q, 0, len(self.ids))
        other = self.labels != label
        possible = []
        for low, high in windows:
            sure = lower[other & (lower >= low) & (upper <= high)]
            reach = np.partition(sure, -n)[-n] if len(sure) >= n else low
            possible.append(np.flatnonzero(other & (upper >= max(low, reach)) & (lower <= high)))
        every = np.unique(np.concatenate(possible))
        score = self.exact(q, every)
        out = []
        for (low, high), which in zip(windows, possible, strict=True):
            s = score[np.searchsorted(every, which)]
            which, s = which[(s >= low) & (s <= high)], s[(s >= low) & (s <= high)]
            best = np.lexsort([self.ids[which], -s])[:n]
            out.append((self.ids[which[best]], s[best]))
        return out


def dealt(rows: DataFrame, anchors: DataFrame, n_rows: int, n_anchors: int, per_block: int, per_group: int) -> DataFrame:
    """Rows of a block followed by anchors of a group, for every block and group, each (block, group) together."""
    blocks, groups = max(1, math.ceil(n_rows / per_block)), max(1, math.ceil(n_anchors / per_group))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    columns = ["block", "grp", "kind", "u", "id", "label", "v", "w"]
    # the names u are numbers of materialised rows, so a row's block stays the same
    at = lambda n: F.pmod(F.xxhash64("u"), F.lit(n)).cast("int")
    one = rows.withColumns({"block": at(blocks), "grp": every(groups), "kind": F.lit(0), "w": F.lit(None).cast("array<struct<p:long,s:long>>")})
    other = anchors.withColumns({"grp": at(groups), "block": every(blocks), "kind": F.lit(1)})
    return one.select(*columns).unionByName(other.select(*columns)).repartition("block", "grp").sortWithinPartitions("block", "grp", "kind")


def matrix(column: pa.Array, n: int) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(n, len(values) // n if n else 0)


def blocks(batches: Iterator[pa.RecordBatch], low: np.ndarray, high: np.ndarray) -> Iterator[tuple[Block, list[tuple]]]:
    """Each block with some anchors (u, id, label, v, w) at a time."""
    key, parts, block = None, [], None
    for b in batches:
        place = b.column(0).to_numpy().astype(np.int64) << 32 | b.column(1).to_numpy().astype(np.int64)
        kind = b.column(2).to_numpy()
        edges = np.flatnonzero(np.append(True, (place[1:] != place[:-1]) | (kind[1:] != kind[:-1])))
        for start, end in zip(edges.tolist(), [*edges[1:].tolist(), len(place)], strict=True):
            part = b.slice(start, end - start)
            if place[start] != key:
                key, parts, block = place[start], [], None
            v = matrix(part.column(6), end - start)
            if kind[start] == 0:
                parts.append((part.column(4).to_numpy(), part.column(5).to_numpy(), v))
                continue
            if block is None and parts:
                block = Block(*(np.concatenate(x) for x in zip(*parts, strict=True)), low, high)
                parts = []
            if block is not None:
                yield block, list(zip(*(part.column(i).to_pylist() for i in (3, 4, 5)), v.astype(np.int64), part.column(7).to_pylist(), strict=True))


def first(found: DataFrame, by: list[str], score: str, id_: str, n: int) -> DataFrame:
    return found.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), id_))).filter(F.col("rank") <= n)


def mine(df: DataFrame, is_anchor: Column, id_: str = "vec_id", label: Column | str = "label", vector: str = "embedding", positives: int = 5, negatives: int = 3, least: int = 50, most: int = 95, per_block: int = ROWS, per_group: int = ANCHORS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor (``is_anchor``, of the column id) and each of its
    first ``positives`` rows of the same label the first ``negatives`` rows of other labels that have ``least`` to ``most`` percent of the positive's score."""
    rows = integer_vectors(df, id_, F.col(label) if isinstance(label, str) else label, vector)
    low, high = marks(rows)
    anchors = rows.filter(is_anchor)
    n_rows, n_anchors = rows.count(), anchors.count()

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, some in blocks(batches, low, high):
            out = [(u, p, s) for u, own, label, q, _ in some for p, s in zip(*(x.tolist() for x in block.positives(own, label, q, positives)), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*out, strict=True) if out else ([],) * 3)], ["u", "p", "s"])

    nothing = F.lit(None).cast("array<struct<p:long,s:long>>")
    likest = dealt(rows, anchors.withColumn("w", nothing), n_rows, n_anchors, per_block, per_group).mapInArrow(near, "u long, p long, s long")
    spans = first(likest, ["u"], "s", "p", positives).groupBy("u").agg(F.collect_list(F.struct("p", "s")).alias("w"))

    def hard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, some in blocks(batches, low, high):
            out = []
            for u, own, label, q, w in some:
                # a window without a whole number in it has no rows
                spans = [(p, s, -((-least * s) // 100), (most * s) // 100) for p, s in sorted({(x["p"], x["s"]) for x in w})]
                spans = [x for x in spans if x[2] <= x[3]]
                if spans:
                    for (p, s, *_), (ids, scores) in zip(spans, block.negatives(label, q, [x[2:] for x in spans], negatives), strict=True):
                        out += [(u, own, p, s, i, x) for i, x in zip(ids.tolist(), scores.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*out, strict=True) if out else ([],) * 6)], ["u", "anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"])

    asked = cut(anchors.join(spans, "u"))
    found = dealt(rows, asked, n_rows, n_anchors, per_block, per_group).mapInArrow(hard, "u long, anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
    ranked = first(found, ["u", "positive_id", "positive_score"], "negative_score", "negative_id", negatives)
    return ranked.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
