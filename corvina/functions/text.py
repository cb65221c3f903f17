"""String functions on columns. All of them stay inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: All white space of Unicode, also where Java's plain \s has only ASCII.
BLANKS = r"(?U)\s+"
CJK = r"[一-鿿]"
FULL_WIDTH = "".join(map(chr, range(0xFF01, 0xFF5F)))
HALF_WIDTH = "".join(map(chr, range(0x21, 0x7F)))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def txt(c: Column) -> Column:
    """Null as '', without the two characters backslash and r, without control characters, stripped."""
    return strip(F.regexp_replace(F.replace(F.coalesce(c, F.lit("")), F.lit("\\r"), F.lit("")), r"[\x00-\x08\x0b\x0c\x0e-\x1f]", ""))


def non_empty(c: Column) -> Column:
    return F.filter(c, lambda x: x != "")


def people(c: Column) -> Column:
    return non_empty(F.transform(F.split(txt(c), "[;；、,，]"), strip))


def keywords(c: Column) -> Column:
    """Split at punctuation if there is any, else at blanks if the text has Chinese characters, else not at all."""
    t, marks = txt(c), "[、,，;；/]"
    parts = F.when(t.rlike(marks), F.split(t, marks)).when(t.rlike(CJK), F.split(t, BLANKS)).otherwise(F.array(t))
    return F.array_distinct(non_empty(F.transform(parts, lambda x: F.btrim(x, F.lit(" .。")))))


def letters(c: Column) -> Column:
    """Only letters and digits, of any script."""
    return F.regexp_replace(c, r"[^\p{L}\p{N}]", "")


def title_key(c: Column) -> Column:
    return F.lower(letters(c))


def search_norm(c: Column) -> Column:
    return F.translate(F.translate(F.lower(F.coalesce(c, F.lit(""))), "台", "臺"), FULL_WIDTH, HALF_WIDTH)


def occurrences(c: Column, term: str, most: int) -> Column:
    """Occurrences of a term that don't overlap, counted up to a number; 0 in null."""
    n = ((F.length(c) - F.length(F.replace(c, F.lit(term), F.lit("")))) / len(term)).cast("int")
    return F.least(F.lit(most), F.coalesce(n, F.lit(0)))


def year_of(c: Column) -> Column:
    era, digits = F.regexp_extract(c, r"民國\s*(\d+)", 1), F.regexp_extract(c, r"(\d{4})", 1)
    return F.coalesce(F.nullif(era, F.lit("")).try_cast("int") + 1911, F.nullif(digits, F.lit("")).try_cast("int"))


def edition_of(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"第\s*(\d+)\s*屆", 1), F.lit("")).try_cast("int")


def tokens(c: Column) -> Column:
    """Two-character grams of the runs of Chinese characters, then Latin words of three characters or more."""
    low = F.lower(c)
    pairs = F.flatten(F.transform(F.regexp_extract_all(low, F.lit("([一-鿿]{2,})"), F.lit(1)), lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2)))))
    return F.concat(pairs, F.regexp_extract_all(low, F.lit(r"([a-z][a-z0-9\-]{2,})"), F.lit(1)))


def html_text(c: Column, unescape: Column | None = None) -> Column:
    """Breaks as line feeds, no tags, the five common entities resolved, ideographic blanks as blanks, stripped. Other
    entities need functions.python.unescape, given here as a column of it."""
    t = F.regexp_replace(F.regexp_replace(c, r"<br\s*/?>", "\n"), "<[^>]+>", "")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(char))
    return strip(F.replace(t if unescape is None else unescape, F.lit("　"), F.lit(" ")))


def html_escape(c: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(char), F.lit(entity))
    return c


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """``f(x)`` with x computed once."""
    return F.element_at(F.transform(F.array(x), f), 1)


def scanned(items: Column, state: Column, kind: str, step: Callable[[Column, Column], tuple[Column, Column]], block: int = 256) -> Column:
    """What a pass over an array gives: ``step(state, x)`` is the next state and an array<kind> of what x adds. Results are put together
    by blocks, so that the cost grows with the array and not with its square."""
    none = F.array().cast(f"array<{kind}>")

    def add(acc: Column, x: Column) -> Column:
        after, more = step(acc["s"], x)
        return F.struct(after.alias("s"), F.concat(acc["out"], more).alias("out"))

    def whole(acc: Column, part: Column) -> Column:
        done = F.aggregate(part, F.struct(acc["s"].alias("s"), none.alias("out")), add)
        return let(done, lambda r: F.struct(r["s"].alias("s"), F.concat(acc["out"], F.array(r["out"])).alias("out")))

    last = F.greatest(F.lit(0), F.floor((F.size(items) - 1) / block).cast("int"))
    parts = F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(items, i * block + 1, F.lit(block)))
    return F.aggregate(parts, F.struct(state.alias("s"), F.array().cast(f"array<array<{kind}>>").alias("out")), whole, lambda acc: F.flatten(acc["out"]))


def places(c: Column, term: str) -> Column:
    """Where a term stands in a text, from the left without overlaps: the characters in front of each."""
    quoted = r"\Q" + term.replace(r"\E", r"\E\\E\Q") + r"\E"
    between = lambda p: F.transform(F.slice(p, 1, F.size(p) - 1), F.length)
    found = lambda sizes: scanned(sizes, F.lit(0), "int", lambda at, n: (at + n + len(term), F.array(at + n)))
    return let(F.split(c, quoted), lambda p: let(between(p), found))


def highlight(c: Column, norm: Column, terms: list[str], most: int | None = None) -> Column:
    """The text escaped, with marks around terms, which are found in its normalised form: the places of all terms in order (of equal
    ones that of the earlier term first), each taken if it begins behind the one taken before. Null is an empty text; texts of more than
    ``most`` characters are cut and end in an ellipsis."""
    text, norm = F.coalesce(c, F.lit("")), F.coalesce(norm, F.lit(""))
    if most:
        cut = lambda x: F.when(F.length(text) > most, F.concat(F.left(x, F.lit(most)), F.lit("…"))).otherwise(x)
        text, norm = cut(text), cut(norm)
    hit = "struct<a:int,k:int,b:int>"
    one = lambda n, k, t: F.transform(places(n, t), lambda a: F.struct(a.alias("a"), F.lit(k).alias("k"), (a + len(t)).alias("b")))
    none = F.array().cast(f"array<{hit}>")
    all_ = lambda n: F.array_sort(F.concat(none, *(one(n, k, t) for k, t in enumerate(terms) if t)))
    free = lambda at, x: (F.when(x["a"] >= at, x["b"]).otherwise(at), F.when(x["a"] >= at, F.array(x)).otherwise(none))
    taken = let(let(norm, all_), lambda hits: scanned(hits, F.lit(0), hit, free))
    part = lambda z, a, n: html_escape(F.array_join(F.slice(z["c"], a + 1, n), ""))

    def written(z: Column) -> Column:
        def marked(x: Column, i: Column) -> Column:
            at = F.coalesce(F.get(z["hits"], i - 1)["b"], F.lit(0))
            return F.concat(part(z, at, F.greatest(F.lit(0), x["a"] - at)), F.lit("<mark>"), part(z, x["a"], x["b"] - x["a"]), F.lit("</mark>"))

        end = F.coalesce(F.get(z["hits"], F.size(z["hits"]) - 1)["b"], F.lit(0))
        return F.concat(F.array_join(F.transform(z["hits"], marked), ""), part(z, end, F.size(z["c"])))

    return let(F.struct(F.split(text, "").alias("c"), taken.alias("hits")), written)


def safe_name(c: Column, most: int = 80, illegal: str = r'[\\/:*?"<>|\n\r\t]+') -> Column:
    return F.left(strip(F.regexp_replace(F.coalesce(c, F.lit("")), illegal, "_")), F.lit(most))


def header_filename(c: Column) -> Column:
    """What stands behind the last 'filename=' of a content-disposition header."""
    return F.element_at(F.split(F.coalesce(c, F.lit("")), "filename="), -1)


def paragraphs(c: Column) -> Column:
    """Page numbers go, degrees are put together, line breaks between Chinese characters go, blank lines are at most one."""
    c = F.regexp_replace(c, r"(?mU)^\s*(第\s*\d+\s*頁|[-–—]?\s*\d{1,3}\s*[-–—]?)\s*$", "")
    c = F.regexp_replace(c, r"(\d)\s*\n?\s*o\s*\n?\s*C\b", "$1°C")
    c = F.regexp_replace(c, "[ \t　]{2,}|[\t　]", " ")  # not each single blank by itself
    c = F.regexp_replace(c, "\n(?<=[一-鿿，、；：（）「」]\n)(?=[一-鿿，、；：（）「」])", "")
    return strip(F.regexp_replace(c, "\n{3,}", "\n\n"))


def garbled(c: Column, markers: str, odd: str) -> Column:
    return (F.regexp_count(c, F.lit(markers)) >= 5) | (F.regexp_count(c, F.lit(odd)) >= 30)


def mode_of(values: Column) -> Column:
    """The most frequent element of an array, of equals the one that comes first; null if it is empty."""
    ranked = F.transform(F.array_distinct(values), lambda v: F.struct((-F.size(F.filter(values, lambda x: x == v))).alias("n"), F.array_position(values, v).alias("at"), v.alias("v")))
    return F.array_min(ranked)["v"]


def lookup(c: Column, pairs: tuple[tuple[str, str], ...]) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for p in pairs for x in p)), c)


def none_if_empty(c: Column) -> Column:
    return F.nullif(c, F.lit(""))
