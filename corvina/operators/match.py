"""Files to works: by override, code, title, near title; greedy assignment of what is left; plans of files."""

from __future__ import annotations

from collections import Counter, deque
from collections.abc import Iterator
from difflib import SequenceMatcher
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvina import rules
from corvina.functions import records as R
from corvina.functions import text as T
from corvina.operators.similar import tasks
from corvina.functions.python import nfc, nfkc

#: Titles of a block; titles whose subsequences are looked at together; bits for occurrences of characters, each for one and each for several.
BLOCK, AT_ONCE, OWN, SHARED = 32768, 4096, 192, 128


def parsed(files: DataFrame, name: str = "name") -> DataFrame:
    """files with edition, grp, code, title and key (the title's letters) from the name in composed form."""
    return files.withColumn("_n", nfc(F.col(name))).withColumn("_f", R.filename(F.col("_n"))).select("*", "_f.*").drop("_f").withColumn("key", T.letters(F.col("title")))


def titles(works: DataFrame) -> DataFrame:
    """(edition, key, work): national works by the letters of their title; of equal ones that with the largest id."""
    own = works.filter((F.col("src") == rules.NATIONAL) & (F.col("type") == rules.WORK))
    return own.groupBy(F.col("edition_no").alias("edition"), T.letters(F.col("title")).alias("key")).agg(F.max("id").alias("by_title"))


def by_code(works: DataFrame) -> DataFrame:
    return works.filter(F.coalesce("code", F.lit("")) != "").groupBy(F.col("edition_no").alias("edition"), "code").agg(F.max("id").alias("by_code"))


def common_subsequence(places: dict[str, int], size: int, other: str) -> int:
    """The length of the longest common subsequence of a text, given as the places of each character (a bit each), and another."""
    v = full = (1 << size) - 1
    for c in other:
        u = v & places.get(c, 0)
        v = (v + u | v - u) & full
    return size - v.bit_count()


class Subsequences:
    """Some texts, for the longest common subsequences of another text with all of them at once: the same bits, a word for each text."""

    def __init__(self, keys: list[str]):
        self.keys, self.sizes = keys, np.array([len(k) for k in keys], np.int64)
        codes = np.frombuffer("".join(keys).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.chars, number = np.unique(codes, return_inverse=True)
        # a row for each text; behind a text's end a character that no text has
        self.at = np.full((len(keys), int(self.sizes.max(initial=0))), len(self.chars), np.min_scalar_type(len(self.chars)))
        of = np.repeat(np.arange(len(keys)), self.sizes)
        self.at[of, np.arange(len(of)) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)] = number

    def common(self, text: str, some: np.ndarray | slice) -> np.ndarray:
        """The lengths for the texts at the places ``some``."""
        places = np.arange(len(self.keys))[some]
        if len(text) > 64:
            bits_of: dict[str, int] = {}
            for i, c in enumerate(text):
                bits_of[c] = bits_of.get(c, 0) | 1 << i
            return np.array([common_subsequence(bits_of, len(text), self.keys[i]) for i in places.tolist()], np.int64)
        bits = np.zeros(len(self.chars) + 1, np.uint64)
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        where = np.searchsorted(self.chars, codes)
        for i, (n, c) in enumerate(zip(where.tolist(), codes.tolist(), strict=True)):
            if n < len(self.chars) and self.chars[n] == c:
                bits[n] |= np.uint64(1 << i)
        out = np.empty(len(places), np.int64)
        for lo in range(0, len(places), AT_ONCE):
            part = places[lo : lo + AT_ONCE]
            at = self.at[part, : int(self.sizes[part].max(initial=0))].T.astype(np.intp, order="C")
            v = np.full(len(part), (1 << 64) - 1, np.uint64)
            u, w = np.empty_like(v), np.empty_like(v)
            for row in at:
                np.take(bits, row, out=u, mode="clip")
                np.bitwise_and(u, v, out=u)
                np.add(v, u, out=w)
                np.subtract(v, u, out=v)
                np.bitwise_or(v, w, out=v)
            out[lo : lo + AT_ONCE] = len(text) - np.bitwise_count(v & np.uint64((1 << len(text)) - 1)).astype(np.int64)
        return out


class Occurrences:
    """Some texts, for how many characters another text can have in common with each, wherever they are: a bit for each character's
    first, second... occurrence, so that a few words' bits are counted. The ``OWN`` commonest have a bit of their own, others one of ``SHARED``
    together; what the other text has more than once in such a bit counts as common."""

    def __init__(self, keys: list[str]):
        sizes = np.array([len(k) for k in keys], np.int64)
        codes = np.frombuffer("".join(keys).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        of = np.repeat(np.arange(len(keys)), sizes)
        order = np.argsort(of << 21 | codes, kind="stable")
        of, codes = of[order], codes[order]
        new = np.flatnonzero(np.diff(of, prepend=-1).astype(bool) | np.diff(codes, prepend=-1).astype(bool))
        nth = np.arange(len(of)) - np.repeat(new, np.diff(np.append(new, len(of))))
        found, number, count = np.unique(nth << 21 | codes, return_inverse=True, return_counts=True)
        bit = OWN + np.arange(len(found)) % SHARED
        own = np.argsort(-count, kind="stable")[:OWN]
        bit[own] = np.arange(len(own))
        self.bit = {(chr(x & 0x1FFFFF), x >> 21): b for x, b in zip(found.tolist(), bit.tolist(), strict=True)}
        self.words = np.zeros(((OWN + SHARED) // 64, len(keys)), np.uint64)
        mine = bit[number]
        np.bitwise_or.at(self.words, (mine >> 6, of), np.uint64(1) << (mine & 63).astype(np.uint64))

    def common(self, text: str, some: slice) -> np.ndarray:
        """Upper bounds for the texts at the places ``some``."""
        seen, mask, more = Counter(), 0, 0
        for c in text:
            b = self.bit.get((c, seen[c]))
            seen[c] += 1
            if b is not None:
                more += mask >> b & 1
                mask |= 1 << b
        words = self.words[:, some]
        out = np.full(words.shape[1], more, np.uint8 if len(text) < 256 else np.int64)
        for k, row in enumerate(words):
            m = mask >> 64 * k & (1 << 64) - 1
            if m:
                out += np.bitwise_count(row & np.uint64(m))
        return out


class Alike:
    """Some titles, for which of them can reach a ratio to another. What can't is left out by what bounds it from above: twice the
    characters that two titles can have in common over all characters, by the occurrences of each, then by their longest common
    subsequence, as the matcher's blocks are one. Nearly all titles are left out by the first, which costs a few operations a title."""

    def __init__(self, keys: list[str]):
        self.keys, self.texts, self.occurrences = keys, Subsequences(keys), Occurrences(keys)
        self.sizes = self.texts.sizes.astype(np.float32)

    def bounds(self, title: str, some: slice = slice(None)) -> tuple[np.ndarray, np.ndarray]:
        """The characters in common at most, and all characters, by titles."""
        return self.occurrences.common(title, some), self.sizes[some] + np.float32(len(title))

    def forget(self, place: int) -> None:
        """From now on no other title has anything in common with the one there."""
        self.occurrences.words[:, place] = 0
        self.texts.at[place] = len(self.texts.chars)

    def reaching(self, title: str, bounds: tuple[np.ndarray, np.ndarray], ratio: float, start: int = 0) -> list[tuple[float, int]]:
        """(bound, place) of the titles that can reach it, greatest bounds first; bounds: of the titles from ``start`` on."""
        ratio -= 1e-9
        near = np.flatnonzero(bounds[0] >= np.float32(ratio / 2 - 1e-6) * bounds[1])
        bound = 2 * self.texts.common(title, near + start) / np.maximum(1, self.texts.sizes[near + start] + len(title))
        near, bound = near[bound >= ratio], bound[bound >= ratio]
        order = np.argsort(-bound, kind="stable")
        return list(zip(bound[order].tolist(), (near[order] + start).tolist(), strict=True))


class Titles:
    """Some titles of an edition, in order of their lengths, for the question which of them are likest to another."""

    def __init__(self, keys: list[str], works: list[int]):
        order = sorted(range(len(keys)), key=lambda i: len(keys[i]))
        self.works, self.alike = [works[i] for i in order], Alike([keys[i] for i in order])

    def likest(self, title: str, least: float, margin: float = 1.0) -> list[tuple[float, int]]:
        """(ratio, work) of the two likest from that ratio on; of equal ratios the least work first. What is less than the likest by more
        than ``margin`` may be missing."""
        far = (2 - least) / max(least, 1e-9)
        start, end = np.searchsorted(self.alike.texts.sizes, [len(title) / far - 1e-6, len(title) * far + 1e-6]).tolist()
        if start == end:
            return []
        bounds = self.alike.bounds(title, slice(start, end))
        ratio = lambda i: SequenceMatcher(None, title, self.alike.keys[i]).ratio()
        first = int((bounds[0] / np.maximum(1, bounds[1])).argmax())
        known = {}
        if 2 * int(bounds[0][first]) >= (least - 1e-6) * float(bounds[1][first]):
            known[start + first] = ratio(start + first)
        lowest = max([least, *(r - margin for r in known.values())])
        top: list[tuple[float, int]] = []
        for bound, i in self.alike.reaching(title, bounds, lowest, start):
            if bound < (top[1][0] if len(top) > 1 else 0) - 1e-9:
                break
            r = known[i] if i in known else ratio(i)
            if r >= least:
                top = sorted([*top, (r, self.works[i])], key=lambda x: (-x[0], x[1]))[:2]
        return top


def likest_titles(files: DataFrame, index: DataFrame, least: float, margin: float, block: int) -> DataFrame:
    """(edition, key, r, by_title): for each key of files in each block of its edition's titles the two likest, as far as they are
    within ``margin`` of the block's likest. An edition's titles are dealt to blocks of about ``block``,
    its files to blocks of a fourth, and each two are a group that one task streams, the titles first; so no pair is
    a row, and an edition of any size is shared among tasks."""
    t = index.select("edition", "key", F.col("by_title").alias("work"))
    f = files.select("edition", "key").distinct().withColumn("work", F.lit(None).cast("long"))
    n = [x.groupBy("edition").agg(F.ceil(F.count("*") / size).cast("int").alias(c)) for x, size, c in ((t, block, "nt"), (f, max(1, block // 4), "nf"))]
    parts = n[0].join(n[1], "edition")
    own = lambda c: F.pmod(F.xxhash64("key"), F.col(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    sides = [t.join(parts, "edition").withColumns({"i": own("nt"), "j": every("nf"), "side": F.lit(0)}), f.join(parts, "edition").withColumns({"j": own("nf"), "i": every("nt"), "side": F.lit(1)})]
    columns = ["edition", "i", "j", "side", "key", "work"]
    dealt = sides[0].select(*columns).unionByName(sides[1].select(*columns)).repartition(tasks(files), "edition", "i", "j").sortWithinPartitions("edition", "i", "j", "side")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, keys, works, titles = None, [], [], None
        for b in batches:
            out = []
            for e, i, j, side, key, work in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (e, i, j) != at:
                    at, keys, works, titles = (e, i, j), [], [], None
                if side == 0:
                    keys.append(key)
                    works.append(work)
                elif keys:  # a block may have no title
                    titles = titles or Titles(keys, works)
                    out += [(e, key, r, w) for r, w in titles.likest(key, least, margin)]
            rows = zip(*out, strict=True) if out else ([],) * 4
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(rows, (pa.int32(), pa.string(), pa.float64(), pa.int64()), strict=True)], ["edition", "key", "r", "by_title"])

    return dealt.withColumn("edition", F.col("edition").cast("int")).mapInArrow(apply, "edition int, key string, r double, by_title long")


def near_titles(files: DataFrame, index: DataFrame, least: float = 0.85, margin: float = 0.1, block: int = BLOCK) -> DataFrame:
    """(name, by_near) for files whose title is alike enough to one of their edition's, and clearly less to any other."""
    found = likest_titles(files, index, least - margin, margin, block)
    two = found.withColumn("k", F.row_number().over(Window.partitionBy("edition", "key").orderBy(F.desc("r"), "by_title"))).filter("k <= 2")
    best = two.groupBy("edition", "key").agg(F.max(F.when(F.col("k") == 1, F.struct("r", "by_title"))).alias("one"), F.max(F.when(F.col("k") == 2, F.col("r"))).alias("second"))
    sure = (F.col("one.r") >= least) & (F.coalesce(F.col("one.r") - F.col("second"), F.lit(1.0)) >= margin)
    return files.select("name", "edition", "key").distinct().join(best.filter(sure), ["edition", "key"]).select("name", F.col("one.by_title").alias("by_near"))


def matched(files: DataFrame, works: DataFrame, overrides: DataFrame | None = None, fuzzy: bool = True) -> DataFrame:
    """files (name, ...) with edition, grp, code, title, work (id or null) and how (override, code, title, near)."""
    named = parsed(files)
    if overrides is not None:
        ids = works.select(F.col("id").alias("by_override"))
        known = overrides.filter(~F.col("name").startswith("_")).select(nfc(F.col("name")).alias("_n"), F.col("id").alias("by_override")).join(ids, "by_override", "left_semi")
        named = named.join(known, "_n", "left")
    else:
        named = named.withColumn("by_override", F.lit(None).cast("long"))
    index = titles(works)
    found = named.join(by_code(works), ["edition", "code"], "left").join(index, ["edition", "key"], "left")
    ways = ["by_override", "by_code", "by_title"]
    if fuzzy:
        left = found.filter(F.coalesce(*ways).isNull() & F.col("edition").isNotNull() & ~F.contains("title", F.lit("待核對")))
        found = found.join(near_titles(left, index), "name", "left")
        ways.append("by_near")
    parsed_ok = F.col("edition").isNotNull()
    how = F.coalesce(*(F.when(F.col(w).isNotNull(), w.removeprefix("by_")) for w in ways))
    return found.withColumns({"work": F.when(parsed_ok, F.coalesce(*ways)), "how": F.when(parsed_ok, how)}).drop("_n", "key", *ways)


def strictly_matched(files: DataFrame, works: DataFrame) -> DataFrame:
    """By six-digit code or exact title only; a name that doesn't parse or has no work ends the job with an error."""
    out = matched(files, works, fuzzy=False)
    return out.withColumn("work", F.coalesce("work", F.raise_error(F.concat(F.lit("no work for "), F.col("name"))).cast("long")))


def file_codes(found: DataFrame) -> DataFrame:
    """(sid, code, grp, file) of the matched files; of a work's files that with the last name."""
    return found.filter("work is not null").groupBy(F.col("work").alias("sid")).agg(F.max_by(F.struct("code", "grp", F.col("name").alias("file")), "name").alias("x")).select("sid", "x.*")


class Pool:
    """The free works of an edition, by the letters of their titles. Works of one title are one entry. Equal titles, equal beginnings, and
    titles that hold each other are found by tables; whether one work is likest with some lead is told by upper bounds for all titles at
    once, so that few pairs are aligned, most often one."""

    def __init__(self, ids: list[int], keys: list[str]):
        self.ids, self.free, self.number = ids, [], {}
        for i, k in enumerate(keys):
            n = self.number.setdefault(k, len(self.number))
            if n == len(self.free):
                self.free.append(deque())
            self.free[n].append(i)
        self.left, self.keys = len(self.free), list(self.number)
        self.place = [self.number[k] for k in keys]
        self.begun, self.longer, self.lengths = {}, {}, {}
        for n, k in enumerate(self.keys):
            for table, b in self.beginnings(k):
                table.setdefault(b, [0, 0])
                table[b][0] += len(self.free[n])
                table[b][1] += sum(self.free[n])
            if len(k) >= GRAM:
                self.lengths.setdefault(k[:GRAM], set()).add(len(k))
        self.short = sorted({len(k) for k in self.keys if len(k) < GRAM})
        self.grams, self.having = grams(self.keys)
        self.rest = np.arange(len(self.keys))
        self.alike = Alike(self.keys)

    def beginnings(self, key: str) -> list[tuple[dict, str]]:
        """The tables' entries for a title: its first five characters, and what begins these."""
        return [(self.begun, key[:5]), *((self.longer, key[:n]) for n in range(len(key[:5])))]

    def leads(self, title: str, bounds: tuple[np.ndarray, np.ndarray], known: dict[int, float], only: int | None, least: float, margin: float) -> int | None:
        """The place of the work with the greatest ratio if it is ``least`` at least, and ``margin`` over the next one's, or if it is no
        other than the title ``only``, where there is one. Of the works that haven't been aligned only those count that can come near
        the lead, or can get one. known: ratios by title, for the next rule too."""
        while True:
            first, second, at = -1.0, 0.0, None
            for n, r in known.items():
                for x in [r] * min(2, len(self.free[n])):
                    first, second, at = (x, max(first, second), n) if x > first else (first, max(second, x), at)
            leading = first >= least and first - second >= margin
            lowest = first - margin if leading else max(least, first + margin)
            if lowest > 1 + 1e-9 or (only is not None and not (leading and at == only)):
                return None
            for _, i in self.alike.reaching(title, bounds, lowest):
                n = int(self.rest[i])
                if n in known or not self.free[n]:
                    continue
                r = known[n] = SequenceMatcher(None, title, self.keys[n]).ratio()
                if r > first or (leading and first - r < margin):  # other bounds count now
                    break
            else:
                return self.free[at][0] if leading else None

    def held(self, title: str) -> list[int]:
        """The places of free works whose title holds this one, or is held by it: all if it is one, else two or more."""
        lo, hi = (np.searchsorted(self.grams, hashes(title), side) for side in ("left", "right"))
        rare = int((hi - lo).argmin())
        found = {n for n in self.having[lo[rare] : hi[rare]].tolist() if title in self.keys[n]}
        for i in range(len(title) + 1):
            for size in (*self.short, *self.lengths.get(title[i : i + GRAM], ())):
                if i + size <= len(title) and title[i : i + size] in self.number:
                    found.add(self.number[title[i : i + size]])
        return [i for n in found for i in islice(self.free[n], 2)]

    def those(self, relation: str, title: str) -> list[int]:
        """The places of free works in that relation to a title: the first one of the same; else all if it is one, or two or more."""
        if relation == "same":
            return list(islice(self.free[self.number[title]], 1)) if title in self.number else []
        if relation == "held":
            return self.held(title)
        some = [self.begun.get(title[:n]) for n in range(len(title[:5]) + 1)] + [self.longer.get(title[:5])]
        count, total = (sum(x[k] for x in some if x) for k in range(2))
        return [total] if count == 1 else [-1] * min(count, 2)

    def take(self, title: str) -> int | None:
        """The id of the work that a title goes to, which is then no longer free. ``RULES`` says which works a rule is about, from
        which length of title on, and, where only the likest may be taken, its least ratio and least lead."""
        if not self.left:
            return None
        bounds, known = None, {}
        for least_size, relation, alone, least, margin in RULES:
            if len(title) < least_size:
                continue
            found = self.those(relation, title) if relation else None
            if relation and (not found or (alone and len(found) > 1)):
                continue
            at = found[0] if found else None
            if margin is not None:
                if bounds is None:
                    bounds = self.alike.bounds(title)
                only = self.place[found[0]] if found else None
                for n in (int(self.rest[(bounds[0] / np.maximum(1, bounds[1])).argmax()]) if not known else None, only):
                    if n is not None and n not in known:
                        known[n] = SequenceMatcher(None, title, self.keys[n]).ratio()
                at = self.leads(title, bounds, known, only, least, margin)
                if at is None:
                    continue
            return self.taken(at)
        return None

    def taken(self, at: int) -> int:
        n = self.place[at]
        self.free[n].remove(at)
        for table, b in self.beginnings(self.keys[n]):
            table[b][0] -= 1
            table[b][1] -= at
        if not self.free[n]:
            self.left -= 1
            if 2 * self.left < len(self.rest):  # a smaller table of titles
                self.rest = np.array([i for i in self.rest.tolist() if self.free[i]], np.int64)
                self.alike = Alike([self.keys[i] for i in self.rest.tolist()])
            else:  # no title can have anything in common with it
                self.alike.forget(int(np.searchsorted(self.rest, n)))
        return self.ids[at]


#: Characters of the grams by which titles that hold another are found.
GRAM = 4


def hashes(text: str) -> np.ndarray:
    """Numbers of the text's grams, in their order; different grams may have one."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    out = np.zeros(max(0, len(codes) - GRAM + 1), np.uint64)
    for k in range(GRAM):
        out = out * np.uint64(0x9E3779B97F4A7C15) + codes[k : k + len(out)]
    return out


def grams(keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(grams in order, the number of the title that has each); a title has no gram that goes beyond it."""
    sizes = np.array([len(k) for k in keys], np.int64)
    of = np.repeat(np.arange(len(keys)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(of))
    found = hashes("".join(keys))
    inside = left[: len(found)] >= GRAM
    found, of = found[inside], of[: len(found)][inside]
    order = np.argsort(found, kind="stable")
    return found[order], of[order]


#: Least length of the title, relation to a work's title (the same; one holds the other; one begins with the other's first five
#: characters; any), whether one work alone may have it, least ratio, least lead.
RULES = (
    (0, "same", False, None, None),
    (4, "held", True, None, None),
    (2, "begun", True, 0.0, 0.1),
    (0, None, False, 0.5, 0.2),
)


def assigned(files: DataFrame, works: DataFrame, order: str = "position") -> DataFrame:
    """(name, work) by greedy assignment in the order given: a work that is taken leaves the pool. works: those without a file.
    Pools never cross editions, so each edition is one group; it holds that edition's titles only."""
    left = parsed(files.select("name", order)).filter("edition is not null").select("edition", "name", F.col(order).alias("at"), T.title_key(nfkc(F.col("title"))).alias("key"), F.contains("title", F.lit("待核對")).alias("waiting"))
    pool = works.filter((F.col("src") == rules.NATIONAL) & (F.col("type") == rules.WORK)).select(F.col("edition_no").alias("edition"), "id", T.title_key(nfkc(F.col("title"))).alias("key"))

    def assign(files: pd.DataFrame, works: pd.DataFrame) -> pd.DataFrame:
        works = works.sort_values("id")
        free = Pool(works["id"].tolist(), works["key"].tolist())
        out = [(f.name, None if f.waiting else free.take(f.key)) for f in files.sort_values("at").itertuples()]
        return pd.DataFrame(out, columns=["name", "work"]).astype({"work": "Int64"})

    # partitions that are asked for aren't merged: few rows, much work
    left, pool = (x.repartition(tasks(files), "edition") for x in (left, pool))
    return left.groupBy("edition").cogroup(pool.groupBy("edition")).applyInPandas(assign, "name string, work long")


def sample(found: DataFrame, n: int = 12) -> DataFrame:
    """The same few rows each time, for a look at them."""
    return found.orderBy(F.xxhash64(*found.columns)).limit(n)


def listed_plan(official: DataFrame, disk: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(official rows with the path of their file or null, files that no row asks for); disk: (edition, code, path)."""
    rows = official.select(F.regexp_extract("屆次", r"(\d+)", 1).try_cast("int").alias("edition"), F.col("作品編號").alias("code"), F.col("作品名稱").alias("title"))
    return rows.join(disk, ["edition", "code"], "left"), disk.join(rows.select("edition", "code").distinct(), ["edition", "code"], "left_anti")


def unfetched(works: DataFrame, have: DataFrame) -> DataFrame:
    return works.filter("pdf is not null").join(have.select(F.col("sid").alias("id")), "id", "left_anti")


def top_two(pairs: DataFrame, key: str, score: str, tie: str) -> DataFrame:
    """The two best rows of each key, with the best one's margin over the second."""
    w = Window.partitionBy(key).orderBy(F.desc(score), tie)
    return pairs.withColumn("rank", F.row_number().over(w)).filter("rank <= 2").withColumn("margin", F.when(F.col("rank") == 1, F.col(score) - F.lead(score).over(w)))


def download_name(w: Column | None = None) -> Column:
    """The name under which a national work's file is kept."""
    group = F.coalesce(T.lookup(F.coalesce("stage_detail", "stage"), rules.STAGE_GROUPS), F.lit("組別未知"))
    or_ = lambda c, d: F.coalesce(T.none_if_empty(F.col(c)), F.lit(d))
    text = F.concat(F.lit("第"), F.coalesce(F.col("edition_no").cast("string"), F.lit("None")), F.lit("屆_"), group, F.lit("_"), or_("subject", "科別未知"), F.lit("_"), or_("rank", "未列獎項"), F.lit("_"), or_("code", "000000"), F.lit("_"), F.col("title"))
    return F.concat(T.safe_name(text), F.lit(".pdf"))


def international_name() -> Column:
    or_ = lambda c, d: F.coalesce(T.none_if_empty(F.col(c)), F.lit(d))
    text = F.concat(F.lit("國際_"), F.coalesce(F.col("year").cast("string"), F.lit("None")), F.lit("_"), or_("subject", "科別未知"), F.lit("_"), or_("rank", "未列獎項"), F.lit("_"), F.col("id").cast("string"), F.lit("_"), F.col("title"))
    return F.concat(T.safe_name(text), F.lit(".pdf"))
