"""Fill-in-the-middle: texts cut at two ranks of units and put together again in another order, by sparse events.

Units are told by classes of ASCII characters (:class:`Units`). A maximal run of characters of one such class is one unit;
all other characters count one by one (``each``) or by runs. One Aho-Corasick automaton holds every character of the classes
and the sentinels, so that one pass over a text gives the places where the class may change and tells whether a sentinel
occurs. Between two such events nothing changes: the units of a gap are its length or one, and running sums over the events alone
find the place of any rank by binary search. For code points (``CHARS``) no character changes the class, so the events are the
sentinels.

The two ranks, the form and the order come from the SHA-256 of ``<seed>:<id>``, so a text is always cut alike. A text that is
empty, or has a sentinel in it, or that the share ``rate`` leaves out, stays as it is (plain). No sentinel begins with the end of
another, so the first one of each kind in an output is the real one, and :func:`restored` rebuilds the text from output and form.

Null texts are empty ones; a null id has an empty name. Rows that repeat get one result each, tables may be empty, texts of any
length are read whole. Only id and text are read, so other columns may have any name. No shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Prefix, suffix, middle.
SENTINELS = ("<P>", "<S>", "<M>")
TOGETHER = 64


@dataclass(frozen=True)
class Units:
    """``runs``: classes of ASCII characters whose runs are units; ``each``: whether other characters are units one by one."""

    runs: tuple[str, ...] = ()
    each: bool = True


CHARS = Units()
WORDS = Units((" \t\n\v\f\r",), each=False)


def automaton(units: Units, sentinels: tuple[str, ...]):  # noqa: ANN201
    """Of all characters that change the class (their class as value) and the sentinels (-1)."""
    import ahocorasick

    out = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for s in sentinels:
        out.add_word(s, -1)
    for number, characters in enumerate(units.runs):
        for c in characters:
            out.add_word(c, number)
    out.make_automaton()
    return out


class Scan:
    """The segments of a text: where each starts, the units before it, and whether its characters are units one by one."""

    def __init__(self, text: str, events, units: Units):  # noqa: ANN001
        found = np.array(list(events.iter(text)), np.int64).reshape(-1, 2)
        self.size, self.has_sentinel = len(text), bool((found[:, 1] < 0).any())
        at, of = found[found[:, 1] >= 0].T
        # a run of one class is one segment, and so is what lies between two of them
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1] + 1) | (of[1:] != of[:-1])
        first, last = at[new], np.append(at[np.append(new, True)[1:]] if len(at) else at, []).astype(np.int64)
        gaps = np.append([0], last + 1)
        gaps = gaps[gaps < np.append(first, self.size)]
        start = np.concatenate([first, gaps])
        order = np.argsort(start, kind="stable")
        self.start, self.each = start[order], (np.arange(len(start)) >= len(first))[order] & units.each
        length = np.diff(np.append(self.start, self.size))
        self.before = np.append([0], np.cumsum(np.where(self.each, length, 1)))
        self.n = int(self.before[-1])

    def place(self, rank: int) -> int:
        """Where the unit of a rank starts; the end of the text for a rank as large as the number of units."""
        if rank >= self.n:
            return self.size
        k = int(np.searchsorted(self.before, rank, "right")) - 1
        return int(self.start[k]) + (rank - int(self.before[k]) if self.each[k] else 0)


def draws(seed: int, doc_id: int | None) -> list[int]:
    name = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(name[i : i + 8], 16) for i in (0, 8, 16, 24)]


def transform(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", units: Units = CHARS, seed: int = 1, rate: int = 90, spm: int = 20, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output): n units; form plain, psm or spm; ``rate`` and ``spm`` in percent,
    the latter of the texts that are cut. Lengths in code points, null for plain."""
    p, s, m = sentinels

    def one(events, key: int | None, t: str) -> tuple:  # noqa: ANN001
        scan = Scan(t, events, units)
        h = draws(seed, key)
        if not t or scan.has_sentinel or h[2] % 100 >= rate:
            return key, scan.n, "plain", None, None, t
        a, b = sorted(x % (scan.n + 1) for x in h[:2])
        i, j = scan.place(a), scan.place(b)
        if h[3] % 100 < spm:
            return key, scan.n, "spm", i, j - i, f"{s}{t[j:]}{p}{t[:i]}{m}{t[i:j]}"
        return key, scan.n, "psm", i, j - i, f"{p}{t[:i]}{s}{t[j:]}{m}{t[i:j]}"

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        events = automaton(units, sentinels)
        schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])
        for whole in batches:
            for at in range(0, whole.num_rows, TOGETHER):
                b = whole.slice(at, TOGETHER)
                rows = [one(events, k, t or "") for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    given = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return given.mapInArrow(apply, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text, from output and form alone."""
    p, s, m = sentinels

    def parts(first: str, second: str, third: str) -> list[Column]:
        body = F.substr(output, F.lit(len(first) + 1))
        a = F.substring_index(body, second, 1)
        rest = F.substr(body, F.length(a) + len(second) + 1)
        b = F.substring_index(rest, third, 1)
        return [a, b, F.substr(rest, F.length(b) + len(third) + 1)]

    prefix, suffix, middle = parts(p, s, m)
    suffix2, prefix2, middle2 = parts(s, p, m)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(prefix2, middle2, suffix2)).otherwise(output)
