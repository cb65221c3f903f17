"""Benchmark decontamination by q-gram lemma filtering.

An item of m characters that stands in a text with at most k edits (k = ``rate`` of m, rounded down) shares at least
m + 1 - q(k + 1) of its q-grams with it, on diagonals (place in the text less place in the item) within a band of k + 1.
q is the largest of ``q``, a half, a quarter and so on for which the bound is not empty, so items of any length take
part, the shortest ones (under 1 / ``rate`` characters) without edits.

A text is gone through in overlapping windows in which every occurrence lies whole. A window's distinct q-grams are counted
for each item first, then the characters that both have (the same lemma with q = 1); for the items that are left, shared
q-grams are counted in overlapping diagonal bands of width 2(k + 1), so that every band of k + 1 lies in one. Regions that meet
the bound are kept and verified by banded alignment of the whole item. Exact occurrences have 0 edits and are looked up
directly. A window that repeats an earlier one of the same text can't do better than that and isn't gone through again, so long
runs of one character cost little; counts are made in slices of at most ``SLICE`` entries (or one window's).

Items of more than ``PART`` characters are taken in parts of that length that overlap by a half, the last one ending with the
item, each with its own budget. Items of more than ``SHORT`` characters are taken in parts of that length every ``STRIDE``
characters as well, so every passage of SHORT + STRIDE - 1 = 99 characters of an item that a text holds without the item's
rest is found; shorter passages need luck. A shorter part counts only where no longer one of its item does.

Texts and items are compared in lower case with every white space character as a blank; places refer to the lower-cased
text. Items with fewer than ``min_chars`` characters (by default none but empty ones) and null items are left out. The
benchmark is a stated query set: it is taken in blocks of at most ``BLOCK`` characters, each held as an index that goes to all
tasks, while every text is read whole. Null and empty texts match nothing. Of several places of an item in a text the one with
the fewest edits counts, of these the first. Rows that repeat get the same matches each. Empty tables give empty results.
Extra columns are left alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Q, RATE, MIN_CHARS, PART, SHORT, STRIDE, BLOCK, PIECE = 8, 0.1, 1, 160, 80, 20, 2_000_000, 1 << 20
#: Bits of the table that says whether a q-gram may be an item's; classes of characters; entries that are counted together;
#: characters of texts that are looked up together, with a character between them.
TABLE_BITS, CLASSES, SLICE, TOGETHER, BETWEEN = 20, 64, 1 << 20, 1 << 16, "\uffff"


def folded(text: str) -> str:
    """Lower case, white space as blanks; as long as str.lower() makes it."""
    text = text.lower().replace("\n", " ")
    return text.translate(BLANKS) if BLANK.search(text) else text


BLANKS = {c: " " for c in (*range(9, 14), *range(28, 32), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)}
BLANK = re.compile("[" + "".join(map(chr, BLANKS)) + "]")


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def grams(c: np.ndarray, q: int) -> np.ndarray:
    """A hash of the q-gram (q: a power of two) at each position that has one whole."""
    if len(c) < q:
        return np.zeros(0, np.uint64)
    h, width, factor = (c.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9), 1, 0x9E3779B97F4A7C15
    while width < q:
        h = h[:-width] * np.uint64(factor) + h[width:]
        factor, width = factor * factor % 2**64, 2 * width
    return h ^ (h >> np.uint64(31))


def spread(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers first, first + 1, ... (n of them) of each entry, one behind the other."""
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())


def parts(text: str, size: int = PART, stride: int = PART // 2) -> list[str]:
    if len(text) <= size:
        return [text]
    return [text[at : at + size] for at in range(0, len(text) - size, stride)] + [text[-size:]]


def all_parts(text: str) -> list[str]:
    """Each once: long ones, then short ones."""
    return list(dict.fromkeys(parts(text) + (parts(text, SHORT, STRIDE) if len(text) > SHORT else [])))


def counted(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct numbers in order, and how often each is there."""
    x = np.sort(x)
    at = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)
    return x[at], np.append(at[1:], len(x))[: len(at)] - at


class Group:
    """The q-grams of those items of a block that are filtered by one q."""

    def __init__(self, number: np.ndarray, texts: list[str], k: np.ndarray, q: int):
        self.q, self.number, self.texts, self.k = q, number, texts, k
        self.m = np.array([len(t) for t in texts])
        self.least, self.span = self.m + 1 - q * (k + 1), int((self.m + k).max())
        self.fewest = int(self.least.min())
        all_codes = [codes(t) for t in texts]
        each = [grams(c, q) for c in all_codes]
        sizes = np.array([len(x) for x in each])
        item, at = np.repeat(np.arange(len(each)), sizes), np.concatenate([np.arange(x) for x in sizes])
        self.gram, code = np.unique(np.concatenate(each), return_inverse=True)
        order = np.lexsort((item, code))
        self.first, self.item = np.searchsorted(code[order], np.arange(len(self.gram) + 1)), item[order].astype(np.int32)
        # each item's q-grams in order of their number
        order = np.lexsort((at, code, item))
        self.begin, self.code, self.at = np.concatenate([[0], np.cumsum(sizes)]), code[order].astype(np.int32), at[order].astype(np.int32)
        self.classes = np.stack([np.bincount(c % CLASSES, minlength=CLASSES) for c in all_codes]).astype(np.int32)
        self.table = np.zeros(1 << TABLE_BITS, bool)
        self.table[self.slot(self.gram)] = True

    @staticmethod
    def slot(h: np.ndarray) -> np.ndarray:
        return (h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - TABLE_BITS)

    def hits(self, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of a text's q-grams that items have, and the numbers of these."""
        h = grams(c, self.q)
        at = np.flatnonzero(self.table[self.slot(h)])
        k = np.minimum(np.searchsorted(self.gram, h[at]), len(self.gram) - 1)
        real = self.gram[k] == h[at]
        return at[real], k[real]

    def enough(self, unit: np.ndarray, code: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(units, items): the items of whose q-grams a unit (a text, a window) has as many as the item's bound. The
        q-grams are given by unit in ascending order."""
        unit, code = np.divmod(counted(unit * len(self.gram) + code)[0], len(self.gram))
        n = self.first[code + 1] - self.first[code]
        total, start = np.cumsum(n), 0
        while start < len(unit):
            end = int(np.searchsorted(total, (total[start - 1] if start else 0) + SLICE, "right"))
            end = int(np.searchsorted(unit, unit[min(end, len(unit) - 1)], "left")) if end < len(unit) else end
            if end <= start:  # one unit at least
                end = int(np.searchsorted(unit, unit[start], "right"))
            part = slice(start, end)
            key = np.repeat(unit[part], n[part]) * len(self.m) + self.item[spread(self.first[code[part]], n[part])]
            key, count = counted(key)
            some = count >= self.fewest
            u, i = np.divmod(key[some], len(self.m))
            ok = count[some] >= self.least[i]
            yield u[ok], i[ok]
            start = end

    def windows(self, c: np.ndarray, at: np.ndarray, code: np.ndarray, items: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(item, start, places, codes): windows of a text that may hold one of the items, with the q-grams there."""
        wanted = np.zeros(len(self.gram), bool)
        wanted[self.code[spread(self.begin[items], self.begin[items + 1] - self.begin[items])]] = True
        some = wanted[code]
        at, code = at[some], code[some]
        size, blocks = self.span, -(-len(c) // self.span)
        n = max(1, blocks - 1)  # window w is blocks w and w + 1
        fresh, seen = np.ones(n, bool), set()
        if n > 2:
            for w in range(n):
                key = c[w * size : (w + 2) * size].tobytes()
                fresh[w] = key not in seen
                seen.add(key)
        block = at // size
        w = np.concatenate([block, block - 1])
        ok = (w >= 0) & (w < n)
        ok[ok] = fresh[w[ok]]
        order = np.flatnonzero(ok)
        order = order[np.argsort(w[order], kind="stable")]
        w, place = w[order], order % len(at)
        for units, items in self.enough(w, code[place]):
            for u in counted(units)[0].tolist():
                own = items[units == u]
                here = np.bincount(c[u * size : (u + 2) * size] % CLASSES, minlength=CLASSES)
                own = own[np.minimum(self.classes[own], here).sum(1) >= self.m[own] - self.k[own]]
                if len(own):
                    p = place[np.searchsorted(w, u, "left") : np.searchsorted(w, u, "right")]
                    for i in own.tolist():
                        yield i, u * size, at[p], code[p]

    def bands(self, i: int, at: np.ndarray, code: np.ndarray) -> list[tuple[int, int]]:
        """(lowest, highest) diagonal of the bands that meet an item's bound."""
        own, place = (x[self.begin[i] : self.begin[i + 1]] for x in (self.code, self.at))
        lo = np.searchsorted(own, code, "left")
        n = np.searchsorted(own, code, "right") - lo
        p = place[spread(lo, n)]
        width, most = int(self.k[i]) + 1, int(self.m[i])
        half = (np.repeat(at, n) - p + most) // width
        out = set()
        for shift in (0, 1):  # bands [b, b + 2) * width: each half-band counts for the one it begins and the one before
            # a q-gram of the item counts once for a band
            band = (half + shift) >> 1
            own, count = counted(counted(band * (most + 1) + p)[0] // (most + 1))
            for b in own[count >= self.least[i]].tolist():
                out.add(((2 * b - shift) * width - most, (2 * b - shift + 2) * width - 1 - most))
        return sorted(out)

    def found(self, text: str, c: np.ndarray, at: np.ndarray, code: np.ndarray, items: np.ndarray) -> dict[int, tuple[int, int, int]]:
        """Edits, start and end for each of the items (by number in the block) that a piece of a text holds."""
        out: dict[int, tuple[int, int, int]] = {}
        exact: dict[int, int] = {}
        for i, start, places, own in self.windows(c, at, code, items):
            if i not in exact:
                exact[i] = text.find(self.texts[i])
                if exact[i] >= 0:
                    out[int(self.number[i])] = (0, exact[i], exact[i] + int(self.m[i]))
            if exact[i] >= 0:
                continue
            number, item = int(self.number[i]), codes(self.texts[i])
            for low, high in self.bands(i, places - start, own):
                hit = align(item, c[start : start + 2 * self.span], low, high, int(self.k[i]))
                if hit:
                    hit = (hit[0], hit[1] + start, hit[2] + start)
                    out[number] = min(out.get(number, hit), hit)
        return out


class Index:
    """A block of items, grouped by the q that their bound asks for; an id that is given more than once has several parts."""

    def __init__(self, items: list[tuple[int, str]], q: int, rate: float):
        if q < 1 or q & (q - 1) or not 0 <= rate < 1:
            raise ValueError("q is a power of two, the rate below 1")
        self.ids, self.texts = [i for i, _ in items], [t for _, t in items]
        self.m = np.array([len(t) for t in self.texts], np.int64)
        self.k = np.floor(self.m * rate + 1e-9).astype(np.int64)
        own = np.full(len(items), q)
        while (small := (own > 1) & (self.m + 1 - own * (self.k + 1) < 1)).any():
            own[small] //= 2
        self.groups = [Group(n, [self.texts[i] for i in n], self.k[n], int(x)) for x in np.unique(own)[::-1] if len(n := np.flatnonzero((own == x) & (self.m > 0)))]


def align(item: np.ndarray, text: np.ndarray, low: int, high: int, k: int) -> tuple[int, int, int] | None:
    """The whole item against any part of the text, on the diagonals from low - k to high + k: (edits, start, end) of the
    best alignment of at most k edits, of equals the one that ends first."""
    low, high = low - k, high + k
    width, far = high - low + 1, 1 << 20
    lanes = np.arange(width)
    # row i, lane d: edits of item[:i] against the text up to i + low + d; where that part starts is kept in the low bits,
    # so that one number holds both
    bits = max(1, int(len(text)).bit_length())
    one, unreachable = 1 << bits, far << bits
    # the text on all places that a lane can meet; what is outside matches nothing
    first = low  # of row 1, lane 0: text[i + low + d - 1]
    span = np.full(len(item) + width, 0xFFFFFFFF, np.uint32)
    a, b = max(0, first), min(len(text), first + len(span))
    if a < b:
        span[a - first : b - first] = text[a:b]
    place = lanes + low
    cost = np.where((place >= 0) & (place <= len(text)), np.clip(place, 0, len(text)), unreachable)
    slope, limit = lanes << bits, (k + 1) << bits
    for i in range(1, len(item) + 1):
        across = cost + ((span[i - 1 : i - 1 + width] != item[i - 1]) << bits)
        across[:-1] = np.minimum(across[:-1], cost[1:] + one)
        if i + low < 0:
            across[: min(width, -(i + low))] = unreachable
        if i + high > len(text):
            across[max(0, len(text) - i - low + 1) :] = unreachable
        # left to right: the least of across[j] + (d - j) edits
        cost = np.minimum.accumulate(across - slope) + slope
        if cost.min() >= limit:
            return None
    j = int((cost >> bits).argmin())
    edits, start = int(cost[j]) >> bits, int(cost[j]) & (one - 1)
    return (edits, start, len(item) + low + j) if edits <= k else None


def matches(index: Index, text: str) -> dict[int, tuple[int, int, int]]:
    """For each item (by number) that a folded text holds: edits, start and end."""
    out: dict[int, tuple[int, int, int]] = {}
    for group in index.groups:
        for start in range(0, max(1, len(text) - group.span), PIECE):
            piece = text[start : start + PIECE + group.span]
            c = codes(piece)
            at, code = group.hits(c)
            for _, items in group.enough(np.zeros(len(at), np.int64), code):
                for i, hit in group.found(piece, c, at, code, items).items():
                    hit = (hit[0], hit[1] + start, hit[2] + start)
                    out[i] = min(out.get(i, hit), hit)
    return out


def matches_of_each(index: Index, texts: list[str]) -> list[dict[int, tuple[int, int, int]]]:
    """:func:`matches` of many texts; shorter ones are looked up together."""
    out: list[dict] = [{} for _ in texts]
    start = 0
    while start < len(texts):
        size, end = len(texts[start]), start + 1
        while end < len(texts) and size + len(texts[end]) < TOGETHER:
            size, end = size + len(texts[end]) + 1, end + 1
        if end == start + 1:
            out[start] = matches(index, texts[start])
        else:
            several(index, texts[start:end], out, start)
        start = end
    return out


def several(index: Index, texts: list[str], out: list[dict], first: int) -> None:
    c = codes(BETWEEN.join(texts))
    ends = np.cumsum([len(t) + 1 for t in texts])
    for group in index.groups:
        at, code = group.hits(c)
        text = np.searchsorted(ends, at, "right")
        often = np.bincount(text, minlength=len(texts)) >= group.fewest
        some = often[text]
        at, code, text = at[some], code[some], text[some]
        for units, items in group.enough(text, code):
            for u in counted(units)[0].tolist():
                lo, hi = np.searchsorted(text, u, "left"), np.searchsorted(text, u, "right")
                begin = int(ends[u]) - len(texts[u]) - 1
                found = group.found(texts[u], c[begin : int(ends[u]) - 1], at[lo:hi] - begin, code[lo:hi], items[units == u])
                for i, hit in found.items():
                    out[first + u][i] = min(out[first + u].get(i, hit), hit)


def found_in(index: Index, b: pa.RecordBatch, at: int, names: Iterable) -> Iterator[tuple]:
    """(name, matches) of each row; a few texts are taken as Python strings at a time."""
    names = iter(names.to_pylist() if isinstance(names, pa.Array) else names)
    held, size = [], 0
    for n, t in enumerate(b.column(at), 1):
        held.append(folded(t.as_py()) if t.is_valid else "")
        size += len(held[-1])
        if size >= 4 * TOGETHER or n == b.num_rows:
            yield from zip(islice(names, len(held)), matches_of_each(index, held), strict=True)
            held, size = [], 0


def scan(docs: DataFrame, index: Broadcast, doc_id: str, text: str) -> DataFrame:
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = index.value
        for b in batches:
            rows = []
            for doc, own in found_in(x, b, 1, b.column(0)):
                found: dict[int | None, tuple[int, int, int, int]] = {}
                for i, hit in own.items():
                    ranked = (-int(x.m[i]), *hit)
                    found[x.ids[i]] = min(found.get(x.ids[i], ranked), ranked)
                rows += [(doc, i, *hit[1:]) for i, hit in sorted(found.items(), key=repr)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["doc_id", "item_id", "edits", "start", "end"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(apply, "doc_id long, item_id long, edits long, start long, end long")


def blocks(benchmark: DataFrame, item_id: str, text: str, q: int, rate: float, min_chars: int) -> Iterator[Index]:
    """The benchmark in blocks of bounded size; rows come to the driver a few at a time."""
    held, size = [], 0
    for r in benchmark.select(F.col(item_id).cast("long").alias("i"), F.col(text).alias("t")).filter("t is not null").distinct().toLocalIterator():
        t = folded(r.t).strip()
        if len(t) < max(min_chars, 1):
            continue
        own = all_parts(t)
        held += [(r.i, x) for x in own]
        size += sum(map(len, own))
        if size >= BLOCK:
            yield Index(sorted(held, key=repr), q, rate)
            held, size = [], 0
    if held:
        yield Index(sorted(held, key=repr), q, rate)


def contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", q: int = Q, rate: float = RATE, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, item_id, edits, start, end): a row for each item that a text holds, with the place of its best part (of the longest found). No shuffle."""
    spark: SparkSession = docs.sparkSession
    out = None
    for index in blocks(benchmark, item_id, item_text, q, rate, min_chars):
        part = scan(docs, spark.sparkContext.broadcast(index), doc_id, text)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], "doc_id long, item_id long, edits long, start long, end long")


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", q: int = Q, rate: float = RATE, min_chars: int = MIN_CHARS) -> DataFrame:
    """The rows of docs whose text holds no item."""
    at = docs.columns.index(text)
    for index in blocks(benchmark, item_id, item_text, q, rate, min_chars):
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def apply(batches: Iterator[pa.RecordBatch], sent: Broadcast = sent) -> Iterator[pa.RecordBatch]:
            for b in batches:
                keep = [not own for _, own in found_in(sent.value, b, at, range(b.num_rows))]
                yield b.filter(pa.array(keep, pa.bool_()))

        docs = docs.mapInArrow(apply, docs.schema)
    return docs
