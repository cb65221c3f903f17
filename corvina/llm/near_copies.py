"""SimHash near-dedup at a similarity: the fuzzy keys of :mod:`corvina.llm.simhash` proposed wide, and an exact comparison.

A text is the set of XXH64 hashes of its shingles of ``words`` words (a shorter text is one shingle, null and empty texts
are the empty one). Its fingerprint has four segments of 23 bits and 128 bits more. Each segment is decoded to the indices of the
``NEAREST`` Golay codewords, where a bit counts as much as its majority among the hashes is clear, as bits with a close vote are
those that differ between near copies. A set is filed under all pairs of indices of every two of its segments. Sets that share a
key and differ in at most ``BITS`` of the further bits (19 do at a similarity of 0.8, with a deviation of 4, and 64 do by chance) are
of one family, and so are those that a chain of such pairs joins. Within a family every two sets are compared whole: they are linked if
their Jaccard similarity is ``similarity`` or more. Nothing below it is linked, and no pair of a family is left out.

At a similarity of 0.8 two segments share one of their four codewords with a probability of 0.85 (votes taken as normally
distributed), and two of four segments do with 0.987 (0.998 at 0.85); a third text like both joins them as well. The README has the
recall measured, on scattered pairs and on thousands of texts with one base.

Only distinct sets take part, so copies cost nothing, and no pair is ever a row: keys and families are streamed by tasks that
return as few links as connect what they found. A key of more than ``MEMBERS`` sets, and a family of more than ``HASHES`` hashes, is cut into
blocks, and each two blocks are a task's group of its own. Before that all are compared with one of them, the hub: those like it are
joined by that, so that only blocks that hold others meet each other and the rest. So work grows with the square of a family only as
far as its members aren't like the hub, and no task holds more than two blocks.

Null ids come last, rows equal in id and text count as one. Texts of any length are read whole. Empty tables give empty results;
extra columns are kept, whatever they are called.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvina.llm.common import cut, sent_if_few, tidy
from corvina.llm.simhash import components, first_of_each, syndrome

WORDS, SIMILARITY, BITS = 5, 0.8, 36
SEGMENTS, WIDTH, NEAREST = 4, 23, 4
KEY = ["_z", "_k", "_h"]
#: The further bits.
MORE = ("c", "d")
#: Sets of a key, and hashes of a family, that a block holds, where each set counts as so many hashes more. Sets whose keys are made together.
MEMBERS, HASHES, EACH, TOGETHER = 1024, 1 << 19, 256, 1024
#: Hubs that the sets of a key are compared with, all keys at a time, before pairs are looked at. Sets of a family that share a hash
#: from which on a matrix is used.
HUBS, DENSE = 4, 8


def shingles(data: bytes | None, words: int = WORDS) -> np.ndarray:
    """The distinct hashes in order."""
    import xxhash

    w = (data or b"").lower().split()
    each = map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False)) if len(w) >= words else [b" ".join(w)]
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, each, repeat(42)), np.uint64))


def votes(h: np.ndarray) -> np.ndarray:
    """How many more hashes have a bit set than not, for 64 bits of the hashes and of three mixtures of them."""
    out = []
    for factor in (1, 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0xD6E8FEB86659FD93):
        ones = np.zeros(64, np.int64)
        for at in range(0, len(h), 1 << 16):
            x = h[at : at + (1 << 16)]
            if factor > 1:
                x = x * np.uint64(factor)
                x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
                x ^= x >> np.uint64(29)
            ones += np.unpackbits(x.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out.append(2 * ones - len(h))
    return np.concatenate(out)


@functools.cache
def codewords() -> np.ndarray:
    """The codewords by index, a column each: 1 for a bit that is set, -1 for one that isn't."""
    data = np.arange(1 << 12, dtype=np.uint32) << np.uint32(11)
    bits = ((data ^ syndrome(data))[:, None] >> np.arange(WIDTH, dtype=np.uint32)) & np.uint32(1)
    return np.ascontiguousarray((bits.astype(np.float32) * 2 - 1).T)


def decoded(v: np.ndarray) -> np.ndarray:
    """Indices of the nearest codewords: rows x SEGMENTS x NEAREST, from rows of votes."""
    soft = v[:, : SEGMENTS * WIDTH].astype(np.float32).reshape(-1, WIDTH)
    found = np.argpartition(soft @ codewords(), -NEAREST, axis=1)[:, -NEAREST:]
    return np.sort(found, axis=1).reshape(-1, SEGMENTS, NEAREST).astype(np.uint16)


def named(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(_z, _k, _h, text): a name for each row, that repeated rows share."""
    id_ = F.col(doc_id)
    return docs.select(id_.isNull().alias("_z"), F.coalesce(id_.cast("long"), F.lit(0)).alias("_k"), F.xxhash64(F.col(text)).alias("_h"), F.col(text).alias("text"))


def signed(rows: DataFrame, words: int) -> DataFrame:
    """(_z, _k, _h, sig, codes, further bits): the hash of the set, its segments' indices and the further bits. No shuffle."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for whole in batches:
            for start in range(0, whole.num_rows, 64):
                b = whole.slice(start, 64)
                sig, v = np.zeros(b.num_rows, np.uint64), np.zeros((b.num_rows, 256), np.int64)
                for i, x in enumerate(b.column(3)):
                    h = shingles(x.as_buffer().to_pybytes() if x.is_valid else None, words)
                    sig[i], v[i] = xxhash.xxh64_intdigest(h.tobytes()), votes(h)
                c = np.packbits(v[:, 128:] > 0, axis=1, bitorder="little").view("<i8")
                yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(sig.view(np.int64)), pa.array([x.tobytes() for x in decoded(v)], pa.binary()), *(pa.array(x.copy()) for x in c.T)], [*KEY, "sig", "codes", *MORE])

    return rows.mapInArrow(apply, "_z boolean, _k long, _h long, sig long, codes binary, " + ", ".join(f"{x} long" for x in MORE))


def filed(sets: DataFrame, together: int = 2) -> DataFrame:
    """(key, sig, further bits) from (sig, codes, further bits): for every choice of ``together`` segments a key for each
    combination of their indices."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, TOGETHER):
                part = b.slice(at, TOGETHER)
                index = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint16).reshape(-1, SEGMENTS, NEAREST).astype(np.int64)
                made = []
                for number, choice in enumerate(combinations(range(SEGMENTS), together)):
                    key = np.full((len(index), 1), 8 * together + number)
                    for s in choice:
                        key = ((key[:, :, None] << 12) | index[:, None, s]).reshape(len(index), -1)
                    made.append(key)
                key = np.concatenate(made, axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), *(pa.array(np.repeat(part.column(i).to_numpy(), key.shape[1])) for i in (0, 2, 3))], ["key", "sig", *MORE])

    return sets.select("sig", "codes", *MORE).mapInArrow(apply, ", ".join(f"{x} long" for x in ("key", "sig", *MORE)))


def blocked(rows: DataFrame, sizes: DataFrame, group: str, block: int) -> DataFrame:
    """rows (group, sig, alone, ...) of large groups with (i, j), for each two blocks that are to meet: those of rows that are alone
    (not like the hub) meet each other and all others. sizes: (group, n_alone, n_other), of which the hub is one."""
    parts = lambda c: F.ceil(F.col(c) / block).cast("int")
    own = F.pmod(F.xxhash64("sig"), F.when(F.col("alone"), F.col("_p")).otherwise(F.col("_q"))).cast("int") + F.when(F.col("alone"), 0).otherwise(F.col("_p"))
    rows = rows.join(sizes.select(group, parts("n_alone").alias("_p"), parts("n_other").alias("_q")), group).filter("_p > 0").withColumn("_own", own)
    other = F.explode(F.sequence(F.lit(0), F.when(F.col("alone"), F.col("_p") + F.col("_q")).otherwise(F.col("_p")) - 1))
    return rows.withColumn("_x", other).filter("_x <> _own").withColumns({"i": F.least("_own", "_x"), "j": F.greatest("_own", "_x")}).drop("_p", "_q", "_own", "_x")


def streamed(rows: DataFrame, by: list[str], columns: list[str], found: Callable[[np.ndarray, list], tuple]) -> DataFrame:
    """(a, b): links of each group, a group being the rows that are equal in ``by``: sorted together, and read by the task as a
    stream. ``found`` gets where each group begins and the columns, for many groups at a time."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def give(part: pa.RecordBatch, edges: np.ndarray) -> pa.RecordBatch:
            a, b = found(edges, part.columns[len(by) :])
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        def edges_of(part: pa.RecordBatch) -> np.ndarray:
            new = np.zeros(part.num_rows, bool)
            new[:1] = True
            for c in part.columns[: len(by)]:
                x = c.to_numpy()
                new[1:] |= x[1:] != x[:-1]
            return np.append(np.flatnonzero(new), part.num_rows)

        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            last = edges_of(b)[-2]
            if last == 0 and all(held[0].column(i)[0] == b.column(i)[b.num_rows - 1] for i in range(len(by))):
                continue  # all of it is one group as yet
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            at = edges_of(whole)
            yield give(whole.slice(0, int(at[-2])), at[:-1])
            held = [whole.slice(int(at[-2]))]
        if held:
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            yield give(whole, edges_of(whole))

    # in order of sig too, so that a group of many keys has the same hub in most of them, and the same links
    return rows.select(*by, *columns).repartition(*by).sortWithinPartitions(*by, "sig").mapInArrow(apply, "a long, b long")


def near(bits: int) -> Column:
    """Whether the further bits of one set and those of another (with a 2 behind their names) differ in so many at most."""
    return sum((F.bit_count(F.col(x).bitwiseXOR(F.col(f"{x}2"))) for x in MORE), F.lit(0)) <= bits


def like(edges: np.ndarray, columns: list, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Of rows (sig, further bits) in groups: as few pairs as join all that differ in ``bits`` at most."""
    sig, *more = (x.to_numpy() for x in columns)
    size = np.diff(edges)
    group = np.repeat(np.arange(len(size)), size)
    some = np.flatnonzero((size > 1)[group])
    sig, group, more = sig[some], group[some], [x[some] for x in more]
    alike = lambda i, j: sum(np.bitwise_count((x[i] ^ x[j]).view(np.uint64)).astype(np.int64) for x in more) <= bits
    of, a, b = np.arange(len(sig)), [], []  # which set each belongs to
    left = of.copy()
    for _ in range(HUBS):  # the first of those left in each group, and those like it
        if not len(left):
            break
        hub = left[np.searchsorted(group[left], group[left], "left")]
        close = alike(hub, left)
        of[left[close]] = hub[close]
        a.append(sig[hub[close]])
        b.append(sig[left[close]])
        left = left[~close]
    # all pairs of groups in which not all belong to one
    several = np.zeros(len(size), bool)
    begins = np.append(True, group[1:] != group[:-1]) if len(group) else np.zeros(0, bool)
    first = np.flatnonzero(begins)[np.cumsum(begins) - 1] if len(group) else of
    several[group[of != of[first]]] = True
    rows = np.flatnonzero(several[group]) if len(group) else of
    met = []
    step = 1
    while len(rows):
        rows = rows[rows + step < len(group)]
        rows = rows[group[rows] == group[np.minimum(rows + step, len(group) - 1)]]
        pairs = rows[of[rows] != of[rows + step]]
        pairs = pairs[alike(pairs, pairs + step)]
        if len(pairs):
            met.append(np.stack([of[pairs], of[pairs + step], pairs, pairs + step]))
        step += 1
    if met:
        met = np.concatenate(met, axis=1)
        _, one = np.unique(np.sort(met[:2], axis=0), axis=1, return_index=True)
        a.append(sig[met[2, one]])
        b.append(sig[met[3, one]])
    a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b))
    return a[a != b], b[a != b]


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """How many hashes each two sets have in common: hashes of few sets by their pairs, the others by products of 0/1 matrices."""
    m, size = len(sets), np.array([len(x) for x in sets])
    of = np.repeat(np.arange(m), size)
    every = np.concatenate(sets)
    order = np.argsort(every, kind="stable")
    every, of = every[order], of[order]
    start = np.flatnonzero(np.append(True, every[1:] != every[:-1]))
    n = np.diff(np.append(start, len(every)))
    out = np.zeros(m * m, np.int32)
    few = (n > 1) & (n < DENSE)
    for step in range(1, DENSE - 1):
        at = start[few & (n > step)]
        for k in range(DENSE - 1 - step):
            x = at[n[np.searchsorted(start, at)] > step + k] + k
            np.add.at(out, of[x] * m + of[x + step], 1)
    out = out.reshape(m, m)
    out += out.T
    many = np.flatnonzero(n >= DENSE)
    width = max(1, (1 << 22) // max(m, 1))
    for at in range(0, len(many), width):
        part = many[at : at + width]
        which = np.repeat(np.arange(len(part)), n[part])
        place = np.arange(len(which)) - np.repeat(np.cumsum(n[part]) - n[part], n[part]) + np.repeat(start[part], n[part])
        table = np.zeros((m, len(part)), np.float32)
        table[of[place], which] = 1
        out += (table @ table.T).astype(np.int32)
    return out


def stars(linked: np.ndarray, sig: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What a symmetric matrix connects: the least sig of each component, and each other of its members."""
    root, left = np.full(len(sig), -1), np.argsort(sig)
    for i in left.tolist():
        if root[i] < 0:
            root[i] = i
            new = np.array([i])
            while len(new):
                new = np.flatnonzero(linked[new].any(0) & (root < 0))
                root[new] = i
    others = np.flatnonzero(root != np.arange(len(sig)))
    return sig[root[others]], sig[others]


def similar(edges: np.ndarray, columns: list, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Of rows (sig, set) in groups: the least set of each component of those that have the similarity, and each other."""
    sig, a, b = columns[0].to_numpy(), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    values, at = columns[1].values.to_numpy(), columns[1].offsets.to_numpy()
    for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        if hi - lo > 1:
            size = np.diff(at[lo : hi + 1])
            common = overlaps([values[at[i] : at[i + 1]] for i in range(lo, hi)])
            linked = common >= (similarity - 1e-9) * (size[:, None] + size[None, :] - common)
            np.fill_diagonal(linked, False)
            x, y = stars(linked, sig[lo:hi])
            a.append(x)
            b.append(y)
    return np.concatenate(a), np.concatenate(b)


def families(least: DataFrame, bits: int, members: int) -> DataFrame:
    """(sig, root): the families of more than one set; least: (sig, codes, further bits), materialised."""
    rows = filed(least)
    large = cut(rows.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > members).select("key"))
    pairs = functools.partial(like, bits=bits)
    if large.isEmpty():
        return components(streamed(rows, ["key"], ["sig", *MORE], pairs)).toDF("sig", "root")
    some = sent_if_few(large)
    out = streamed(rows.join(some, "key", "left_anti"), ["key"], ["sig", *MORE], pairs)
    # the members of large keys next to the hub: the member with the least hash, mostly the same for the keys of a group
    crowd = cut(rows.join(some, "key", "left_semi"))
    hubs = cut(crowd.groupBy("key").agg(F.min(F.struct("sig", *MORE)).alias("x")).select("key", F.col("x.sig").alias("hub"), *(F.col(f"x.{c}").alias(f"{c}2") for c in MORE)))
    told = crowd.join(sent_if_few(hubs), "key").withColumn("alone", ~near(bits))
    sizes = cut(told.groupBy("key").agg(F.count_if("alone").alias("n_alone"), F.count_if(~F.col("alone")).alias("n_other")))
    starred = told.filter("not alone and sig <> hub").select(F.col("hub").alias("a"), F.col("sig").alias("b")).distinct()
    met = streamed(blocked(told, sent_if_few(sizes), "key", members), ["key", "i", "j"], ["sig", *MORE], pairs)
    return components(out.unionByName(starred).unionByName(met)).toDF("sig", "root")


def linked_sets(rows: DataFrame, least: DataFrame, words: int, similarity: float, bits: int, members: int, hashes: int) -> DataFrame:
    """(node, root): for sets that have the similarity with another of their family, the least set that such links lead to; the texts of
    families alone are shingled again."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                sets = [shingles(x.as_buffer().to_pybytes() if x.is_valid else None, words).view(np.int64) for x in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(sets, pa.list_(pa.int64()))], ["root", "sig", "set"])

    wanted = cut(least.select("sig", *KEY).join(families(least, bits, members), "sig"))
    tidy(rows.sparkSession)
    one = rows.join(sent_if_few(wanted), KEY).dropDuplicates(["sig"]).select("root", "sig", "text")
    sets = cut(one.mapInArrow(apply, "root long, sig long, set array<long>").withColumn("n", F.size("set")))
    large = cut(sets.groupBy("root").agg(F.sum(F.col("n") + EACH).alias("total"), F.min("sig").alias("hub")).filter(F.col("total") > hashes))
    pairs = functools.partial(similar, similarity=similarity)
    final = lambda stars: stars.select(F.explode(F.array(F.struct(F.col("b").alias("node"), F.col("a").alias("root")), F.struct(F.col("a").alias("node"), F.col("a").alias("root")))).alias("x")).select("x.*").distinct()
    if large.isEmpty():
        return final(streamed(sets, ["root"], ["sig", "set"], pairs))
    some = sent_if_few(large)
    # a family that is one group has all its links in it
    out = final(streamed(sets.join(some.select("root"), "root", "left_anti"), ["root"], ["sig", "set"], pairs))
    # the hub's set meets the members block by block
    salt = F.ceil(F.col("total") / hashes).cast("int")
    crowd = sets.join(some, "root").withColumn("salt", F.pmod(F.xxhash64("sig"), salt).cast("int"))
    hubs = sets.join(some, "root").filter("sig = hub").select("root", F.col("set").alias("set2"), F.explode(F.sequence(F.lit(0), salt - 1)).alias("salt"))
    common = F.size(F.array_intersect("set", "set2"))
    told = crowd.join(hubs.hint("shuffle_hash"), ["root", "salt"]).withColumn("common", common)
    alone = F.col("common") < (similarity - 1e-9) * (F.col("n") + F.size("set2") - F.col("common"))
    told = cut(told.select("root", "sig", "hub", "n", "set", alone.alias("alone")))
    sizes = cut(told.groupBy("root").agg(F.coalesce(F.sum(F.when(F.col("alone"), F.col("n") + EACH)), F.lit(0)).alias("n_alone"), F.sum(F.when(~F.col("alone"), F.col("n") + EACH)).alias("n_other")))
    starred = told.filter("not alone and sig <> hub").select(F.col("hub").alias("a"), F.col("sig").alias("b"))
    met = streamed(blocked(told.drop("hub", "n"), sent_if_few(sizes), "root", hashes), ["root", "i", "j"], ["sig", "set"], pairs)
    return out.unionByName(components(starred.unionByName(met)))


def groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, similarity: float = SIMILARITY, bits: int = BITS, members: int = MEMBERS, hashes: int = HASHES) -> DataFrame:
    """(_z, _k, _h, root): the component of each row; z, k and h name the row by null id, id and hash of the text."""
    rows = named(docs, doc_id, text)
    by_doc = cut(signed(rows, words))
    least = by_doc.groupBy("sig").agg(F.first("codes").alias("codes"), *(F.first(x).alias(x) for x in MORE), F.min(F.struct(*KEY)).alias("x"))
    least = cut(least.select("sig", "codes", *MORE, "x.*"))
    tidy(docs.sparkSession)
    roots = linked_sets(rows, least, words, similarity, bits, members, hashes)
    return by_doc.select(*KEY, "sig").join(roots, F.col("sig") == F.col("node"), "left").select(*KEY, F.coalesce("root", "sig").alias("root"))


def representatives(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **how: float) -> DataFrame:
    """The rows of docs with the least id of their component (null ids last, then the least hash of the text); of rows
    equal in both, one."""
    return first_of_each(docs, groups(docs, doc_id, text, **how), doc_id, text)
