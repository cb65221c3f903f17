"""Line dedup: hashes of lines in range partitions, streamed in order of hash, document and position.

Each document's lines are cut and hashed (128 bits) where the text is read; only (hash, document, positions) is shuffled,
one row for each distinct line of a document, by ranges of (hash, document), and sorted within the partition. A task
streams its partition and holds back the occurrences of one line at most until the line's fate is known, that is of fewer
documents than the threshold. A line in very many documents is spread over several range partitions; the lines at a
partition's edges are therefore left undecided, and settled by a small table with two lines at most for each partition.
What comes out are the positions to drop, gathered as one compressed keep bitmap for each document; texts are
touched again only to apply the bitmaps.

Two policies: ``threshold`` drops every occurrence of a line that at least ``min_docs`` documents have, and ``first``
drops all but the first occurrence (in order of document and position) of every line.

A line is what stands between line feeds, so null and empty texts have one empty line. Lines whose key has fewer than
``min_chars`` characters always stay. Documents are told apart by their id and, where ids repeat, by a hash of the
text; rows equal in both count as one document and each get its result. Null ids are ids like others here.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvina.llm.common import cut

SPACE = b" \t\n\v\f\r"


def line_keys(data: bytes) -> list[bytes]:
    """Lines of a text in UTF-8, with blanks at both ends removed and A-Z in lower case."""
    return [x.strip(SPACE) for x in data.lower().split(b"\n")]


def characters(data: bytes) -> int:
    return len(data) - sum(0x80 <= c < 0xC0 for c in data) if not data.isascii() else len(data)


def hashed_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """(h1, h2, doc, th, at): for each distinct line of a document its hash and its positions."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        schema = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("doc", pa.int64()), ("th", pa.int64()), ("at", pa.list_(pa.int32()))])
        for b in batches:
            made: tuple[list, ...] = ([], [], [], [])
            for doc, th, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                own: dict[bytes, list[int]] = {}
                for i, k in enumerate(line_keys(text.as_buffer().to_pybytes() if text.is_valid else b"")):
                    if k or min_chars <= 0:
                        own.setdefault(k, []).append(i)
                for k, at in own.items():
                    if min_chars <= 1 or characters(k) >= min_chars:
                        for x, y in zip(made, (xxhash.xxh128_digest(k), doc, th, at), strict=True):
                            x.append(y)
            h = np.frombuffer(b"".join(made[0]), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(made[1], pa.int64()), pa.array(made[2], pa.int64()), pa.array(made[3], schema.field("at").type)], schema=schema)

    return docs.mapInArrow(apply, "h1 long, h2 long, doc long, th long, at array<int>")


class Stream:
    """The state of a task that reads one range partition in order."""

    def __init__(self, policy: str, min_docs: int):
        self.policy, self.min_docs = policy, min_docs
        self.key, self.edge, self.n, self.held, self.opened = None, True, 0, [], None

    def rows(self, b: pa.RecordBatch, settled: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*b.columns, pa.array(np.ones(b.num_rows, np.int64)), pa.array(np.full(b.num_rows, settled))], [*b.schema.names, "n", "settled"])

    def later(self, b: pa.RecordBatch, new: np.ndarray) -> pa.RecordBatch:
        """The positions but each line's first; new: which rows open a line."""
        at = [x[1:] if f else x for x, f in zip(b.column(4).to_pylist(), new, strict=True)]
        keep = pa.array([i for i, x in enumerate(at) if x], pa.int64())
        return self.rows(pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(at, b.column(4).type)], b.schema.names).take(keep), True)

    def run(self, b: pa.RecordBatch, key: tuple) -> Iterator[pa.RecordBatch]:
        """Rows of one line, which may have begun in an earlier batch."""
        if key != self.key:
            self.edge, self.key, self.n, self.held, self.opened = self.key is None, key, 0, [], b.slice(0, 1)
        was, self.n = self.n, self.n + b.num_rows
        if self.edge:
            yield self.rows(b, False)
        elif self.policy == "first":
            yield self.later(b, np.arange(b.num_rows) + was == 0)
        elif self.n < self.min_docs:
            self.held.append(b)
        else:
            yield from (self.rows(x, True) for x in [*self.held, b])
            self.held = []

    def end(self) -> Iterator[pa.RecordBatch]:
        """The last line may go on in the next partition: what is held is left open, or else a row without positions
        says in how many documents it has been met."""
        if self.key is None or self.edge:
            return
        yield from (self.rows(x, False) for x in self.held)
        if not self.held:
            x = self.opened
            yield pa.RecordBatch.from_arrays([*x.columns[:4], pa.nulls(1, x.column(4).type), pa.array([self.n], pa.int64()), pa.array([False])], [*x.schema.names, "n", "settled"])


def streamed(lines: DataFrame, policy: str, min_docs: int) -> DataFrame:
    """From lines in order: (h1, h2, doc, th, at, n, settled). Settled rows have positions to drop."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, before = Stream(policy, min_docs), None
        for b in batches:
            if not b.num_rows:
                continue
            # rows that repeat a document's id and text count once
            keys = np.stack([b.column(i).fill_null(-(2**63)).to_numpy() for i in range(4)], 1)
            new = np.concatenate([[before is None or (keys[0] != before).any()], (keys[1:] != keys[:-1]).any(1)])
            before = keys[-1]
            b = b.filter(pa.array(new))
            if not b.num_rows:
                continue
            h = np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()], 1)
            starts = np.concatenate([[0], 1 + np.flatnonzero((h[1:] != h[:-1]).any(1)), [len(h)]])
            yield from state.run(b.slice(0, int(starts[1])), tuple(h[0]))
            if len(starts) == 2:
                continue
            first, last = int(starts[1]), int(starts[-2])
            if first < last:  # lines that begin and end within this batch
                new = np.zeros(len(h), bool)
                new[starts[:-1]] = True
                inner = b.slice(first, last - first)
                if policy == "first":
                    yield state.later(inner, new[first:last])
                else:
                    size = np.repeat(np.diff(starts), np.diff(starts))[first:last]
                    yield state.rows(inner.filter(pa.array(size >= min_docs)), True)
            yield from state.run(b.slice(last), tuple(h[-1]))
        yield from state.end()

    return lines.mapInArrow(apply, "h1 long, h2 long, doc long, th long, at array<int>, n long, settled boolean")


def drops(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", policy: str = "threshold", min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """(doc, th, at): the positions of lines to drop, by document (id and hash of text), one row for each line."""
    if policy not in ("threshold", "first") or min_docs < 1:
        raise ValueError("policy is threshold or first; min_docs is 1 or more")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc"), F.xxhash64(F.col(text)).alias("th"), F.col(text).alias("text"))
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    lines = hashed_lines(rows, min_chars)
    ordered = lines.repartitionByRange(parts, "h1", "h2", "doc", "th").sortWithinPartitions("h1", "h2", "doc", "th")
    found = cut(streamed(ordered, policy, min_docs))
    edges = found.filter("not settled")
    total = edges.groupBy("h1", "h2").agg(F.sum("n").alias("total"), F.min(F.struct("doc", "th")).alias("opened"), F.count(F.when(F.col("at").isNull(), 1)).alias("begun"))
    # at most two lines for each range partition
    edges = edges.filter("at is not null").join(F.broadcast(total), ["h1", "h2"])
    if policy == "threshold":
        more = edges.filter(F.col("total") >= min_docs)
    else:
        opens = (F.col("begun") == 0) & F.struct("doc", "th").eqNullSafe(F.col("opened"))
        more = edges.withColumn("at", F.when(opens, F.slice("at", 2, F.greatest(F.size("at") - 1, F.lit(0)))).otherwise(F.col("at")))
    return found.filter("settled").select("doc", "th", "at").unionByName(more.select("doc", "th", "at")).filter(F.size("at") > 0)


def bitmaps(found: DataFrame) -> DataFrame:
    """(doc, th, n_dropped, keep): the compressed keep bitmap of each document that loses lines; bit i of the bytes is
    line i; lines behind the bitmap's end stay."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, maps = [], []
            for at in b.column(2).to_pylist():
                at = np.unique(np.array([i for x in at for i in x], np.int64))
                keep = np.ones(int(at[-1]) // 8 * 8 + 8, bool)
                keep[at] = False
                n.append(len(at)), maps.append(zlib.compress(np.packbits(keep, bitorder="little").tobytes(), 6))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(maps, pa.binary())], ["doc", "th", "n_dropped", "keep"])

    return found.groupBy("doc", "th").agg(F.collect_list("at").alias("at")).mapInArrow(apply, "doc long, th long, n_dropped long, keep binary")


def kept_text(data: bytes, bitmap: bytes | None) -> tuple[int, bytes]:
    """Number of lines of a text in UTF-8, and the text without those that the bitmap drops."""
    lines = data.split(b"\n")
    if bitmap is None:
        return len(lines), data
    packed = zlib.decompress(bitmap)
    keep = np.unpackbits(np.frombuffer(packed, np.uint8), bitorder="little")[: len(lines)].astype(bool)
    return len(lines), b"\n".join([x for x, k in zip(lines, keep, strict=False) if k] + lines[len(keep) :])


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", policy: str = "threshold", min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """docs with ``text`` less its dropped lines, and the columns ``_n_lines``, ``_n_dropped``. A document whose lines all
    go has the text ''; a null text stays null unless its empty line goes."""
    docs = docs.drop("_n_lines", "_n_dropped")
    maps = bitmaps(drops(docs, doc_id, text, policy, min_docs, min_chars))
    names = docs.columns
    at, end = names.index(text), len(names)
    own = [f"c{i}" for i in range(end)]  # whatever the columns are called
    keyed = docs.toDF(*own)
    keyed = keyed.withColumns({"_doc": F.col(own[names.index(doc_id)]).cast("long"), "_th": F.xxhash64(F.col(own[at]))})
    joined = keyed.join(maps, keyed._doc.eqNullSafe(maps.doc) & (keyed._th == maps.th), "left")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, n = [], []
            for t, m in zip(b.column(at), b.column(end + 1), strict=True):
                k, x = kept_text(t.as_buffer().to_pybytes() if t.is_valid else b"", m.as_py())
                n.append(k), texts.append(x.decode() if t.is_valid or m.is_valid else None)
            columns = list(b.columns[:end])
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n, pa.int64()), b.column(end).fill_null(0)], [*names, "_n_lines", "_n_dropped"])

    schema = docs.withColumns({"_n_lines": F.lit(0).cast("long"), "_n_dropped": F.lit(0).cast("long")}).schema
    return joined.select(*own, "n_dropped", "keep").mapInArrow(apply, schema)
