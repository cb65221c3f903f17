"""SimHash near-duplicate groups by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 23, 23 and 18 bits (the last padded with zeros to 23). If two
fingerprints differ in two bits at most, then for one of the ordered pairs (1,2), (2,3), (3,1) of segments the first
segments are equal and the second differ in one bit at most. The binary Golay code [23,12,7] is perfect: every word has
one codeword within 3 bits. A fingerprint is filed under (pair, first segment, index of the codeword nearest to its
second segment) and looked up under (pair, first segment, index of every codeword within 4 bits of its second
segment, about five): words that differ in one bit always meet. The meetings are verified.

Only distinct fingerprints take part, so copies cost nothing. A bucket with more than ``BUCKET`` filed fingerprints
isn't paired off: its fingerprints are instead filed under themselves and each of their 64 one-bit neighbours. Members
of such a file differ in two bits at most from each other, and any two that do share a file, so a star over each file
loses no connection and no pairs are made. Components come from alternating large-star and small-star steps on
distributed edges; each round is cut with checkpoint().

Null and empty texts have fingerprint zero and are linked like any other. Rows that repeat get one result each.
Empty tables give empty results.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvina.llm.common import cut

BUCKET = 64
#: Golay generator polynomial x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0xAE3
WIDTHS = (23, 23, 18)
PAIRS = ((0, 1), (1, 2), (2, 0))


def fingerprint(data: bytes | None, words: int = 3, seed: int = 42) -> int:
    """SimHash over the XXH64 of the shingles of a text in UTF-8."""
    import xxhash

    w = (data or b"").lower().split()
    if not w:
        return 0
    shingles = map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False)) if len(w) >= words else [b" ".join(w)]
    h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(seed)), np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, th, fp): th is a hash of the text; fp holds the 64 bits as a signed long. No shuffle."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(x.as_buffer().to_pybytes() if x.is_valid else None, words, seed) for x in b.column(2)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp.view(np.int64))], ["doc_id", "th", "fp"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("th"), F.col(text).alias("text")).mapInArrow(apply, "doc_id long, th long, fp long")


def syndrome(words: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit words by the generator polynomial."""
    r = words.astype(np.uint32).copy()
    for bit in range(22, 10, -1):
        r ^= np.where((r >> np.uint32(bit)) & np.uint32(1), np.uint32(GENERATOR << (bit - 11)), np.uint32(0))
    return r


@functools.cache
def golay() -> tuple[np.ndarray, np.ndarray]:
    """By syndrome: the error of up to 3 bits, and all errors of up to 4 bits (padded with 2^31)."""
    from itertools import combinations

    errors = [np.array([sum(1 << i for i in c) for c in combinations(range(23), n)], np.uint32) for n in range(5)]
    near = np.zeros(2048, np.uint32)
    for e in errors[:4]:
        near[syndrome(e)] = e
    every = [[] for _ in range(2048)]
    for e in np.concatenate(errors):
        every[int(syndrome(e[None])[0])].append(int(e))
    wide = np.full((2048, max(map(len, every))), 1 << 31, np.uint32)
    for s, x in enumerate(every):
        wide[s, : len(x)] = x
    return near, wide


def keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For an array of fingerprints: keys to file under (n x 3), keys to look up (n x m) and which of these count."""
    near, wide = golay()
    fp = fp.astype(np.uint64)
    seg, at = [], 0
    for w in WIDTHS:
        seg.append(((fp >> np.uint64(at)) & np.uint64((1 << w) - 1)).astype(np.uint32))
        at += w
    filed, looked, valid = [], [], []
    for p, (a, b) in enumerate(PAIRS):
        s = syndrome(seg[b])
        base = (np.uint64(p) << np.uint64(40)) | (seg[a].astype(np.uint64) << np.uint64(12))
        filed.append(base | ((seg[b] ^ near[s]) >> np.uint32(11)).astype(np.uint64))
        e = wide[s]
        looked.append(base[:, None] | ((seg[b][:, None] ^ e) >> np.uint32(11)).astype(np.uint64) & np.uint64(0xFFF))
        valid.append(e < (1 << 31))
    return np.stack(filed, 1), np.concatenate(looked, 1), np.concatenate(valid, 1)


def keyed(fps: DataFrame) -> DataFrame:
    """(key, fp, filed): rows to file under a key, and rows to look it up."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            filed, looked, valid = keys(fp)
            key = np.concatenate([filed.ravel(), looked[valid]]).view(np.int64)
            who = np.concatenate([np.repeat(fp, filed.shape[1]), np.broadcast_to(fp[:, None], looked.shape)[valid]]).view(np.int64)
            kind = np.arange(len(key)) < filed.size
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(who), pa.array(kind)], ["key", "fp", "filed"])

    return fps.mapInArrow(apply, "key long, fp long, filed boolean")


def links(fps: DataFrame, bits: int = 2, bucket: int = BUCKET) -> DataFrame:
    """(a, b): links between distinct fingerprints that connect all that differ in ``bits`` (0, 1 or 2) bits at most.
    For ordinary buckets every link, for crowded ones the stars of the module's text. fps: distinct, materialised."""
    if not 0 <= bits <= 2:
        raise ValueError("the keys are complete for at most two differing bits")
    k = keyed(fps.select("fp"))
    crowded = cut(k.filter("filed").groupBy("key").count().filter(F.col("count") > bucket).select("key"))
    calm = k.join(crowded, "key", "left_anti")
    a = calm.filter("filed").select("key", F.col("fp").alias("a"))
    b = calm.filter("not filed").select("key", F.col("fp").alias("b"))
    pairs = a.join(b, "key").filter((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits)).select("a", "b")
    some = k.join(crowded, "key", "left_semi").select("fp").distinct()
    one_bit = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i))
    if bits == 2:
        flips = F.concat(F.array(F.lit(0).cast("long")), one_bit)
        stars = some.select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("hub"))
        least = stars.groupBy("hub").agg(F.min("fp").alias("a"), F.count("*").alias("n")).filter("n > 1").select("hub", "a")
        more = stars.join(least, "hub").filter("fp > a").select("a", F.col("fp").alias("b"))
    elif bits == 1:  # a file under each of the 64 fingerprints with one bit cleared joins exactly the neighbours
        stars = some.select("fp", F.posexplode(one_bit).alias("bit", "one")).select("fp", "bit", F.col("fp").bitwiseAND(F.bitwise_not("one")).alias("hub"))
        more = stars.groupBy("bit", "hub").agg(F.min("fp").alias("a"), F.max("fp").alias("b")).filter("a < b").select("a", "b")
    else:
        more = pairs.limit(0)
    return pairs.unionByName(more).distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root): the least node reachable, for each node of the edges (a, b). Large-star and small-star steps in
    turn; every step is two aggregations or joins on distributed edges, with a cut after each round."""
    e = cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct())
    for _ in range(most_rounds):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.filter("b > a").join(low, "a").select(F.col("m").alias("a"), "b").filter("a < b").distinct()
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low, "b")
        new = cut(small.select(F.col("m").alias("a"), "b").unionByName(small.select(F.col("m").alias("a"), F.col("a").alias("b")).filter("a < b")).distinct())
        diff = e.select("a", "b", F.lit(1).alias("w")).unionByName(new.select("a", "b", F.lit(-1).alias("w"))).groupBy("a", "b").agg(F.sum("w").alias("w")).filter("w <> 0")
        same = diff.isEmpty()
        e = new
        if same:
            break
    else:
        raise RuntimeError(f"components didn't settle in {most_rounds} rounds")
    return e.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(e.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3, seed: int = 42, bits: int = 2, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, th, fp, component_id, root) for each row of docs; root names the component also where ids are null."""
    by_doc = cut(fingerprints(docs, doc_id, text, words, seed))
    fps = cut(by_doc.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(fps, bits, bucket))
    rooted = fps.join(roots, fps.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    final = rooted.join(named, "root").select("fp", "component_id", "root")
    return by_doc.join(final, "fp").select("doc_id", "th", "fp", "component_id", "root")


def first_of_each(docs: DataFrame, grouped: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The row of docs with the least name of each root in grouped (_z, _k, _h, root). The texts are shuffled once."""
    kept = grouped.groupBy("root").agg(F.min(F.struct("_z", "_k", "_h")).alias("x")).select("x.*")
    names, own = docs.columns, [f"c{i}" for i in range(len(docs.columns))]  # whatever the columns are called
    id_, body = (F.col(own[names.index(c)]) for c in (doc_id, text))
    rows = docs.toDF(*own).withColumns({"_z": id_.isNull(), "_k": F.coalesce(id_.cast("long"), F.lit(0)), "_h": F.xxhash64(body)})
    return rows.join(kept, ["_z", "_k", "_h"], "left_semi").dropDuplicates(["_z", "_k", "_h"]).select(*own).toDF(*names)


def representatives(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **how: int) -> DataFrame:
    """The rows of docs with the least id of their component (null ids last, then the least hash of the text); of rows
    equal in both, one. The texts are shuffled once."""
    grouped = near_duplicates(docs, doc_id, text, **how).select(F.col("doc_id").isNull().alias("_z"), F.coalesce("doc_id", F.lit(0)).alias("_k"), F.col("th").alias("_h"), "root")
    return first_of_each(docs, grouped, doc_id, text)
