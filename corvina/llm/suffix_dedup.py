"""Removal of repeated byte strings by blockwise suffix sorting with a difference cover.

Every byte covered by a string of ``length`` bytes that also starts somewhere else, in any document, is removed.

Suffixes are sorted to a depth of ``length`` bytes, one block of suffix buckets at a time:

1. Buckets. A suffix's bucket is the least hash of the k-grams in its first ``length`` bytes, so equal strings share a
   bucket. Successive suffixes mostly share one too; such a run is a segment. Buckets with one segment hold no repeat
   and go no further; only the others' segments are cut out of the texts, each byte string once for each task.
2. Blocks. A task takes whole buckets up to about a MB, names the 160-byte strings at the positions of a difference cover
   modulo 32 by doubling, and sorts the block's suffixes by their first 32 bytes. Longer ties are resolved by the
   cover's names: of any two positions some equal distance under 32 leads both into the cover. The bytes behind
   what a name spans are compared outright. Memory is bounded by the block.
3. Crowded buckets (over ``CROWD`` segments) are split by their segments' bytes, so a copy meets its equals; strings that
   only other splits hold are found by one row for each distinct string and split, aggregated by a 128-bit hash.

Documents are told apart by their id and, where ids repeat or are null, by a 64-bit hash of the text. Rows equal in both are
two documents that repeat each other. Null texts are empty. Texts shorter than ``length`` lose nothing. No text is cut off: long
ones are read in overlapping slices. Ties don't matter: every occurrence of a repeated string goes. Empty tables give empty
results, extra columns are left alone. The table of segments in step 1 only saves work: with it off (``HELD`` 0) the same bytes go.
"""

from __future__ import annotations

import functools
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvina.llm.common import cut

GRAM, SLICE, BLOCK, CROWD, SPLIT = 32, 1 << 18, 1 << 20, 4096, 2048
#: Bytes that a task of the cutting stage holds (segments with what Python needs for each), and bytes of segments in a batch.
HELD, BATCH = 32 << 20, 2 << 20
#: Low bits that give way to the position in a slice; the rest of a gram's hash names the bucket.
PLACE = np.uint64(20)
PERIOD, DEPTH = 32, 160
#: Its differences are all residues modulo 32.
COVER = (0, 1, 2, 3, 7, 11, 19)


@functools.cache
def byte_codes() -> np.ndarray:
    return np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the gram (a power of two) at each position that has one whole."""
    h, width, factor = byte_codes()[data], 1, 0x9E3779B97F4A7C15
    while width < gram:
        h = h[:-width] * np.uint64(factor) + h[width:]
        factor, width = factor * factor % 2**64, 2 * width
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def least(h: np.ndarray, window: int) -> np.ndarray:
    """The minimum of each window."""
    width = 1
    while 2 * width <= window:
        h = np.minimum(h[:-width], h[width:])
        width *= 2
    return np.minimum(h[: len(h) - (window - width)], h[window - width :]) if window > width else h


def segments(data: np.ndarray, ends: np.ndarray, length: int, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts one behind the other (ends: where each one ends): for each segment its bucket, first start and number of starts."""
    if len(data) < length:
        return (np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 2)
    h = gram_hashes(data, gram)
    m = least(h >> PLACE << PLACE | np.arange(len(h), dtype=np.uint64), length - gram + 1)  # of equal hashes the first
    bucket = m >> PLACE
    starts = np.concatenate([[0], ends[:-1]])
    change = np.zeros(len(m) + 1, bool)
    change[1:-1] = bucket[1:] != bucket[:-1]
    change[starts[starts < len(m)]] = True
    stop = np.maximum(ends - length + 1, starts)  # no suffix begins from here on
    change[stop[stop <= len(m)]] = True
    change[-1] = True
    at = np.flatnonzero(change)
    lo, n = at[:-1], np.diff(at)
    text = np.searchsorted(ends, lo, "right")
    ok = lo < stop[np.minimum(text, len(stop) - 1)]
    lo, n = lo[ok], n[ok]
    # where the least hash is met at two places, strings may repeat within the segment: it is cut in two or more
    parts = np.maximum(-(-n // (length - gram + 1)), 1 + (m[lo] != m[lo + n - 1]))
    k = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    n, parts = np.repeat(n, parts), np.repeat(parts, parts)
    lo = np.repeat(lo, np.diff(np.concatenate([np.flatnonzero(k == 0), [len(k)]])))
    return bucket[lo] * np.uint64(0x9E3779B97F4A7C15), lo + n * k // parts, n * (k + 1) // parts - n * k // parts


def slices(column: pa.Array, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, ends, rows, offsets): pieces of the texts of a column, some together, of about SLICE bytes; a text
    longer than that in pieces that overlap, so that every start is in exactly one."""
    parts, rows, offsets, size = [], [], [], 0
    for i, x in enumerate(column):
        data = np.frombuffer(x.as_buffer(), np.uint8) if x.is_valid else np.zeros(0, np.uint8)
        for at in range(0, max(1, len(data) - length + 1), SLICE) if len(data) >= length else ():
            piece = data[at : at + SLICE + length - 1]
            parts.append(piece), rows.append(i), offsets.append(at)
            size += len(piece)
            if size >= SLICE:
                yield np.concatenate(parts), np.cumsum([len(p) for p in parts]), np.array(rows), np.array(offsets)
                parts, rows, offsets, size = [], [], [], 0
    if parts:
        yield np.concatenate(parts), np.cumsum([len(p) for p in parts]), np.array(rows), np.array(offsets)


def filed(docs: DataFrame, length: int) -> DataFrame:
    """(bucket, doc, th, lo, n): the segments of all texts."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc, th = b.column(0), b.column(1)
            for data, ends, rows, offsets in slices(b.column(2), length):
                bucket, lo, n = segments(data, ends, length)
                k = np.searchsorted(ends, lo, "right")
                lo = lo - np.concatenate([[0], ends])[k] + offsets[k]
                take = pa.array(rows[k])
                yield pa.RecordBatch.from_arrays([pa.array(bucket.view(np.int64)), doc.take(take), th.take(take), pa.array(lo), pa.array(n.astype(np.int32))], ["bucket", "doc", "th", "lo", "n"])

    return docs.mapInArrow(apply, "bucket long, doc long, th long, lo long, n int")


def packed(docs: DataFrame) -> DataFrame:
    """(doc, th, z): texts compressed, for a cheaper shuffle."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        z = zstandard.ZstdCompressor(3)
        for b in batches:
            made = [z.compress(x.as_buffer().to_pybytes()) if x.is_valid else z.compress(b"") for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(made, pa.binary())], ["doc", "th", "z"])

    return docs.mapInArrow(apply, "doc long, th long, z binary")


def unpacked(z: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(z)


def merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of intervals, in order; those that touch are joined."""
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    new = np.concatenate([[True], start[1:] > reach[:-1]])
    return start[new], reach[np.concatenate([new[1:], [True]])]


CUT = "part long, bucket long, crowded boolean, seg binary, doc long, th long, lo long, n int"


class Held:
    """The distinct segments that a task has met: where the only occurrence is (n: its starts), or n = 0 if there were
    more, whose ranges are then ``gone``. Fields are arrays of 64 bits; ``size`` counts what Python really takes."""

    def __init__(self) -> None:
        self.number: dict[bytes, int] = {}
        self.bucket, self.count, self.doc, self.th, self.lo, self.n = (array("q") for _ in range(6))
        self.null, self.gone, self.size = array("b"), {}, 0

    def name(self, i: int) -> int | None:
        return None if self.null[i] else self.doc[i]

    def drop(self, doc: int | None, th: int, lo: int, size: int) -> None:
        x = self.gone.get((doc, th))
        if x is None:
            x = self.gone[doc, th] = array("q")
            self.size += 350
        if x and x[-2] <= lo <= x[-1]:  # goes on where the last one ends
            x[-1] = max(x[-1], lo + size)
        else:
            x.extend((lo, lo + size))
            self.size += 24

    def add(self, seg: bytes, bucket: int, count: int, doc: int | None, th: int, lo: int, n: int) -> None:
        i = self.number.setdefault(seg, len(self.number))
        if i < len(self.n):
            if self.n[i]:
                self.drop(self.name(i), self.th[i], self.lo[i], len(seg))
                self.n[i] = 0
            self.drop(doc, th, lo, len(seg))
            return
        for x, value in zip((self.bucket, self.count, self.doc, self.null, self.th, self.lo, self.n), (bucket, count, doc or 0, doc is None, th, lo, n), strict=True):
            x.append(value)
        self.size += len(seg) + 300


def cut_out(texts: DataFrame, length: int) -> DataFrame:
    """From (doc, th, z, found): rows of CUT. With seg: a segment that this task met once (doc, th, lo say where; n: its
    starts), or more often (n = 0). Without: a range of bytes [lo, lo + n) that is to be removed."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        schema = pa.schema([("part", pa.int64()), ("bucket", pa.int64()), ("crowded", pa.bool_()), ("seg", pa.binary()), ("doc", pa.int64()), ("th", pa.int64()), ("lo", pa.int64()), ("n", pa.int32())])
        held = Held()

        def made(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        def flush() -> Iterator[pa.RecordBatch]:
            rows, size = [], 0
            for seg, i in held.number.items():
                bucket, count = held.bucket[i], held.count[i]
                parts = -(-count // SPLIT) if count > CROWD else 1
                part = bucket + (xxhash.xxh64_intdigest(seg) % parts) * 0x9E3779B97F4A7C1 if parts > 1 else bucket
                once = held.n[i] > 0
                rows.append(((part + 2**63) % 2**64 - 2**63, bucket, parts > 1, seg, *((held.name(i), held.th[i], held.lo[i], held.n[i]) if once else (None, None, None, 0))))
                size += len(seg) + 200
                if size >= BATCH:
                    yield made(rows)
                    rows, size = [], 0
            for (doc, th), x in held.gone.items():
                a, b = merged(np.array(x[::2]), np.array(x[1::2]))
                rows += [(xxhash.xxh64_intdigest(f"{doc} {th}") - 2**63, None, None, None, doc, th, s, e - s) for s, e in zip(a.tolist(), b.tolist(), strict=True)]
            if rows:
                yield made(rows)

        for b in batches:
            for doc, th, z, found in zip(*(b.column(i) for i in range(4)), strict=True):
                doc, th, data = doc.as_py(), th.as_py(), unpacked(z.as_py())
                for k, s, m, c in zip(*(found.values.field(i).to_pylist() for i in range(4)), strict=True):
                    held.add(data[s : s + m + length - 1], k, c, doc, th, s, m)
                if held.size > HELD:
                    yield from flush()
                    held = Held()
        if held.size:
            yield from flush()

    return texts.mapInArrow(apply, CUT)


@functools.cache
def distances() -> np.ndarray:
    """For two residues modulo PERIOD the least distance that leads both into the cover."""
    inside = np.isin(np.arange(PERIOD), COVER)
    both = np.stack([inside[(np.arange(PERIOD) + d) % PERIOD] for d in range(PERIOD)])
    return (both[:, :, None] & both[:, None, :]).argmax(0)


def names_of(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return np.unique((first.astype(np.uint64) << np.uint64(32)) | second.astype(np.uint64), return_inverse=True)[1]


def repeats(text: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """For suffixes of a text: the number of the class of equal ``length``-byte strings that each belongs to.

    Sorted by 32 bytes; ties resolved by names at the cover's positions."""
    assert length >= PERIOD + DEPTH
    n = len(text)
    padded = np.concatenate([text, np.zeros(length + PERIOD + 8, np.uint8)])
    word = padded[: n + length + PERIOD].astype(np.uint64)
    width = 1
    while width < 8:
        word = (word[:-width] << np.uint64(8 * width)) | word[width:]
        width *= 2
    # names of the cover's positions: 32 bytes, then 64, 128, 160
    name = np.zeros(n + length + PERIOD, np.int32)
    pos = np.flatnonzero(np.tile(np.isin(np.arange(PERIOD), COVER), n // PERIOD + 1)[:n]).astype(np.int32)
    order = np.lexsort([word[pos + o] for o in (24, 16, 8, 0)])
    s = pos[order]
    new = np.zeros(len(s), bool)
    for o in (0, 8, 16, 24):
        new[1:] |= word[s[1:] + o] != word[s[:-1] + o]
    name[s] = 1 + np.cumsum(new)
    short = name.copy()
    for step in (32, 64):
        name[pos] = 1 + names_of(name[pos], name[pos + step])
    name[pos] = 1 + names_of(name[pos], short[pos + 128])
    # the suffixes by 32 bytes, one word at a time; only ties go on
    group = np.zeros(len(starts), np.int64)
    live = np.arange(len(starts))
    count = 0
    for o in (0, 8, 16, 24):
        if not len(live):
            break
        order = np.lexsort([word[starts[live] + o], group[live]]) if o else np.argsort(word[starts[live]], kind="stable")
        live = live[order]
        w, g = word[starts[live] + o], group[live]
        new = np.concatenate([[True], (w[1:] != w[:-1]) | (g[1:] != g[:-1])])
        group[live] = count + np.cumsum(new) - 1
        count += int(new.sum())
        first = np.flatnonzero(new)
        alone = np.repeat(np.diff(np.concatenate([first, [len(live)]])) == 1, np.diff(np.concatenate([first, [len(live)]])))
        live = live[~alone]
    # long ties: each against its group's first; what differs forms a group of its own for the next round
    table, tail = distances(), range(DEPTH, length - 7, 8)
    tails = sorted({*tail, length - 8})
    rounds = 0
    while len(live):
        g = group[live]
        live = live[np.argsort(g, kind="stable")]
        g = group[live]
        new = np.concatenate([[True], g[1:] != g[:-1]])
        head = live[np.maximum.accumulate(np.where(new, np.arange(len(live)), 0))]
        a, b = starts[head], starts[live]
        d = table[a % PERIOD, b % PERIOD]
        same = name[a + d] == name[b + d]
        for o in tails:
            same &= word[a + o] == word[b + o]
        rest = live[~same]
        if not len(rest):
            break
        group[rest] += count  # groups stay apart: all numbers so far are below count
        count *= 2
        live, rounds = rest, rounds + 1
        if rounds >= 8 or count > 1 << 60:  # many strings with one beginning: the words that are left
            order = np.lexsort([*(word[starts[live] + o] for o in reversed([*range(32, length - 7, 8), length - 8])), group[live]])
            live = live[order]
            new = np.ones(len(live), bool)
            new[1:] = group[live][1:] != group[live][:-1]
            for o in [*range(32, length - 7, 8), length - 8]:
                w = word[starts[live] + o]
                new[1:] |= w[1:] != w[:-1]
            group[live] = count + np.cumsum(new)
            break
    return np.unique(group, return_inverse=True)[1]


OUT = "f1 long, f2 long, doc long, th long, lo long, hi long"


def resolved(rows: DataFrame, length: int) -> DataFrame:
    """From rows of CUT in order of part and segment: ranges to remove (f1 null), and for crowded buckets one row for each
    distinct string of a block (f1, f2: its hash), with its place if it is met once there."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        types = [pa.int64()] * 6
        names = [x.split()[0] for x in OUT.split(", ")]
        segs: list[list] = []  # [bytes, crowded, doc, th, lo, n or 0]
        size, part, out = 0, None, []

        def made(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names)

        def block() -> list:
            out = []
            text = np.frombuffer(b"".join(x[0] for x in segs), np.uint8)
            sizes = np.array([len(x[0]) for x in segs])
            at, n = np.cumsum(sizes) - sizes, sizes - length + 1
            seg = np.repeat(np.arange(len(segs), dtype=np.int32), n)
            inner = (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)).astype(np.int32)
            starts = at.astype(np.int32)[seg] + inner
            cls = repeats(text, starts, length)
            count = np.bincount(cls)
            often = count[cls] > 1
            single = np.array([x[5] > 0 for x in segs])
            crowded = np.array([x[1] for x in segs])
            # ranges of starts that repeat, of segments met once
            hit = often & single[seg]
            edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
            for a, b in zip(edge[::2], edge[1::2], strict=True):
                for c in np.concatenate([[a], a + 1 + np.flatnonzero(np.diff(seg[a:b])), [b]]).astype(int)[:-1]:
                    k = seg[c]
                    stop = min(b, int(np.searchsorted(seg, k, "right")))
                    x = segs[k]
                    out.append((None, None, x[2], x[3], x[4] + int(inner[c]), x[4] + int(inner[stop - 1]) + length))
            if crowded.any():
                known = np.zeros(len(count), bool)
                np.logical_or.at(known, cls, often | ~single[seg])
                first = np.unique(cls, return_index=True)[1]
                data = text.tobytes()
                for w in first[crowded[seg[first]]].tolist():
                    h = xxhash.xxh128_intdigest(data[starts[w] : starts[w] + length])
                    f1, f2 = (h >> 64) - 2**63, h % 2**64 - 2**63
                    x = segs[seg[w]]
                    lo = None if known[cls[w]] else x[4] + int(inner[w])
                    out.append((f1, f2, *((None,) * 4 if lo is None else (x[2], x[3], lo, lo + length))))
            return out

        for b in batches:
            p, seg = b.column(0).to_pylist(), b.column(3).to_pylist()
            for i, x in enumerate(zip(p, b.column(2).to_pylist(), seg, *(b.column(j).to_pylist() for j in (4, 5, 6, 7)), strict=True)):
                now, crowded, data, doc, th, lo, n = x
                if data is None:
                    out.append((None, None, doc, th, lo, lo + n))
                elif segs and now == part and segs[-1][0] == data:  # in other tasks too
                    last = segs[-1]
                    for d, t, s, m in ((last[2], last[3], last[4], last[5]), (doc, th, lo, n)):
                        if m:
                            out.append((None, None, d, t, s, s + len(data)))
                    segs[-1] = [data, crowded, None, None, None, 0]
                else:
                    if size > BLOCK and now != part:
                        out += block()
                        segs, size = [], 0
                    segs.append([data, crowded, doc, th, lo, n])
                    size += len(data)
                    part = now
                if len(out) > 20_000:
                    yield made(out)
                    out = []
        if segs:
            out += block()
        if out:
            yield made(out)

    return rows.mapInArrow(apply, OUT)


def ranges(docs: DataFrame, length: int = 200) -> DataFrame:
    """(doc, th, lo, hi): ranges of bytes that cover what is to be removed. docs: (doc, th, text)."""
    if length < PERIOD + DEPTH:
        raise ValueError(f"length is {PERIOD + DEPTH} or more")
    long = docs.filter(F.octet_length("text") >= length)
    often = filed(long, length).groupBy("bucket").agg(F.count("*").alias("count")).filter("count > 1")
    found = filed(long, length).join(often, "bucket").groupBy("doc", "th").agg(F.array_distinct(F.collect_list(F.struct("bucket", "lo", "n", "count"))).alias("found"))
    a, b = packed(long), found.withColumnsRenamed({"doc": "_doc", "th": "_th"})
    texts = a.join(b, a.doc.eqNullSafe(b._doc) & (a.th == b._th)).select("doc", "th", "z", "found")
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = cut_out(texts, length).repartition(parts, "part").sortWithinPartitions("part", "seg")
    out = cut(resolved(rows, length))
    again = out.filter("f1 is not null").groupBy("f1", "f2").agg(F.count("*").alias("n"), F.collect_list(F.when(F.col("lo").isNotNull(), F.struct("doc", "th", "lo", "hi"))).alias("x")).filter("n > 1")
    return out.filter("f1 is null").select("doc", "th", "lo", "hi").unionByName(again.select(F.inline("x")))


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = 200) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, spans array<struct<lo,hi>>, kept binary) for each row of docs."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("th"), F.col(text).alias("text"))
    spans = ranges(rows, length).groupBy("doc", "th").agg(F.collect_list(F.struct("lo", "hi")).alias("x")).withColumnsRenamed({"doc": "_doc", "th": "_th"})
    a = packed(rows)
    joined = a.join(spans, a.doc.eqNullSafe(spans._doc) & (a.th == spans._th), "left").select("doc", "z", "x")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, span = ["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept"], pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))
        types = [pa.int64()] * 4 + [span, pa.binary()]
        for b in batches:
            rows, size = [], 0
            for doc, z, x in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                data, lo, hi = unpacked(z.as_py()), [], []
                if x.is_valid:
                    lo, hi = (y.tolist() for y in merged(*(x.values.field(i).to_numpy() for i in (0, 1))))
                kept = b"".join(data[s:e] for s, e in zip([0, *hi], [*lo, len(data)], strict=True)) if lo else data
                rows.append((doc, len(data), len(data) - len(kept), len(lo), [{"lo": s, "hi": e} for s, e in zip(lo, hi, strict=True)], kept))
                size += len(kept)
                if size > 8_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return joined.mapInArrow(apply, "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<struct<lo:long,hi:long>>, kept binary")
