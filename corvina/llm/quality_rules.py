"""Quality rules: base counts, and the divergence of a document from language references.

All of it is DataFrame functions. For each document two histograms are made: characters by class (lower-case letters,
upper-case letters, other letters, digits, white space, the rest), and words by a fixed list of very common words, all
others together. The references are the same histograms summed over all documents of a language. A document passes if
its Jensen-Shannon distance (base 2, from 0 to 1) to the nearest reference is within ``max_chars`` for characters
and ``max_words`` for words; each comparison is made only from ``min_chars`` characters or ``min_words`` words on, as
short texts are far from any reference by chance.

Null and empty texts have no words and fail the base rules. Documents without a language don't add to the references
and are compared like others; if there is no reference at all, the comparisons pass. Every language gives a reference; they
are compared in blocks of ``BLOCK``. Rows that repeat get one result each; their texts count as often in the references.
Texts of any length are read whole, columns but those named are left alone, empty tables give empty results. A distance that two
references share is the same distance, so ties don't matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvina.llm.common import cut

#: Languages that a row is compared with in one go.
BLOCK = 64
#: Very common words of some languages.
COMMON = (
    "the of and to in a is that for it with as was on are by this be at from "
    "le la les de des et un une en que qui dans pour est du au sur par pas il "
    "der die das und ist nicht ein eine zu den mit von auf sich dem im es auch als an "
    "el los las y un una del se no con por su para es lo al como o si"
).split()
BINS = sorted(set(COMMON))
SPACE = r"[\x20\x09-\x0D]"
CLASSES = (r"\p{Ll}", r"\p{Lu}", r"[\p{L}&&[^\p{Ll}\p{Lu}]]", r"\p{Nd}", SPACE)
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated(grams: Column) -> Column:
    """From an array of hashes of 3-word windows, how many words stand in windows found twice or more."""
    by_hash = F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def twice(sorted_: Column) -> Column:
        other = lambda i: F.get(sorted_, i)["h"]
        kept = F.filter(sorted_, lambda x, i: F.coalesce(x["h"] == other(i - 1), F.lit(False)) | F.coalesce(x["h"] == other(i + 1), F.lit(False)))
        return F.transform(kept, lambda x: x["i"])

    # windows in order of position: each adds up to three words, less those that the next one adds
    adds = F.aggregate(F.sort_array(F.element_at(F.transform(F.array(by_hash), twice), 1)), F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
                       lambda acc, i: F.struct((acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n"), i.alias("last")), lambda acc: acc["n"])
    return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0)).otherwise(adds)


def features(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str | None = "lang") -> DataFrame:
    """(doc_id, lang, the base counts, length, chars and words: array<struct<i,c>>, the bins that a text has) for each row."""
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), (F.col(lang) if lang else F.lit(None).cast("string")).alias("lang"), t.alias("t"))
    # what is left of the text when one class after the other is taken out
    for k, c in enumerate(CLASSES):
        rows = rows.withColumn(f"r{k}", F.regexp_replace("t" if k == 0 else f"r{k - 1}", c + "+", ""))
    sizes = [F.length(c) for c in ("t", *(f"r{k}" for k in range(len(CLASSES))))]
    counts = [*((a - b).cast("long") for a, b in zip(sizes, sizes[1:], strict=False)), sizes[-1].cast("long")]
    rows = rows.withColumn("w", F.array_remove(F.split("t", SPACE + "+"), ""))
    rows = rows.withColumns({
        "lines": F.filter(F.split("t", "\n"), lambda x: F.btrim(x, F.lit(" \t\n\v\f\r")) != ""),
        "grams": F.transform(F.slice("w", 1, F.greatest(F.size("w") - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get("w", i + 1), F.get("w", i + 2))),
        "common": F.sort_array(F.filter(F.transform("w", lambda x: F.lower(x)), lambda x: x.isin(COMMON))),
    })
    # in order, so a word's count is how far the next one's first place is
    rows = rows.withColumn("seen", F.array_distinct("common")).withColumn("first", F.transform("seen", lambda x: F.array_position("common", x)))
    bins = F.array(*map(F.lit, BINS))
    count = lambda j: F.coalesce(F.get("first", j + 1), F.size("common") + F.lit(1).cast("long")) - F.get("first", j)
    own = F.transform("seen", lambda x, j: bin_of((F.array_position(bins, x) - 1).cast("int"), count(j)))
    others = F.size("w") - F.size("common")
    return rows.select(
        "doc_id", "lang",
        F.size("w").cast("long").alias("n_words"),
        (sizes[0] - (sizes[-2] - sizes[-1])).cast("long").alias("word_chars"),
        F.regexp_count(f"r{len(CLASSES) - 1}", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated(F.col("grams")).cast("long").alias("n_repeat_words"),
        sizes[0].cast("long").alias("length"),
        F.filter(F.array(*(bin_of(F.lit(i), c) for i, c in enumerate(counts))), lambda x: x["c"] > 0).alias("chars"),
        F.filter(F.concat(own, F.array(bin_of(F.lit(len(BINS)), others.cast("long")))), lambda x: x["c"] > 0).alias("words"),
    )


def bin_of(i: Column, c: Column) -> Column:
    return F.struct(i.alias("i"), c.alias("c"))


def references(made: DataFrame) -> Iterator[tuple[list[list[float]], list[list[float]]]]:
    """Shares of the characters' and of the words' bins by language, of all documents, a block of languages at a time."""
    mark = lambda name, k: F.transform(name, lambda x: F.struct(F.lit(k).alias("kind"), x["i"].alias("i"), x["c"].alias("c")))
    marked = F.concat(mark("chars", 0), mark("words", 1))
    sums = made.filter("lang is not null").select("lang", F.explode(marked).alias("x")).groupBy("lang", "x.kind", "x.i").agg(F.sum("x.c").alias("c"))
    each = cut(sums.groupBy("lang").agg(F.collect_list(F.struct("kind", "i", "c")).alias("bins")))  # as many as there are bins
    sizes, block = (len(CLASSES) + 1, len(BINS) + 1), ([], [])
    for r in each.toLocalIterator():
        for kind, size in enumerate(sizes):
            n = {x.i: x.c for x in r.bins if x.kind == kind}
            if n:
                block[kind].append([n.get(i, 0) / sum(n.values()) for i in range(size)])
        if max(map(len, block)) >= BLOCK:
            yield block
            block = ([], [])
    if any(block):
        yield block


def shares(counts: Column, total: Column) -> Column:
    """The bins that a histogram has: array<struct<p,i>>, from counts of all bins."""
    return F.filter(F.transform(counts, lambda c, i: F.struct((c / F.nullif(total, F.lit(0))).alias("p"), i.alias("i"))), lambda x: x["p"] > 0)


def distance(shares: Column, refs: list[list[float]]) -> Column:
    """The Jensen-Shannon distance of a histogram, given as :func:`shares`, to the nearest reference. With h(x) = -x log2 x
    summed over the bins it is
    the root of h((p + q) / 2) - (h(p) + h(q)) / 2; only the bins that the histogram has are gone through, as what the
    others add depends on the reference alone."""
    if not refs:
        return F.lit(0.0)
    h = lambda x: -x * math.log2(x) if x > 0 else 0.0
    entropy = lambda x: F.when(x > 0, -x * F.log2(x)).otherwise(F.lit(0.0))

    def one(ref: list[float]) -> Column:
        start, half = F.lit(sum(h(q / 2) for q in ref) - sum(map(h, ref)) / 2), [q / 2 for q in ref]
        q, known = F.array(*map(F.lit, half)), F.array(*(F.lit(h(x)) for x in half))
        return F.aggregate(shares, start, lambda a, x: a + entropy(x["p"] / 2 + F.get(q, x["i"])) - F.get(known, x["i"]) - entropy(x["p"]) / 2)

    return F.sqrt(F.greatest(F.lit(0.0), F.least(*(one(r) for r in refs)) if len(refs) > 1 else one(refs[0])))


def judge(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str | None = "lang", max_chars: float = 0.24, max_words: float = 0.4, min_chars: int = 200, min_words: int = 50) -> DataFrame:
    """(doc_id, the base counts, base_failed, char_distance, word_distance, kept); a distance that isn't compared is null."""
    made = cut(features(docs, doc_id, text, lang))
    share = lambda c, n: F.transform(c, lambda x: F.struct((x["c"] / F.col(n)).alias("p"), x["i"].alias("i")))
    out = made.select("doc_id", *BASE, "length", share("chars", "length").alias("chars"), share("words", "n_words").alias("words"), *(F.lit(None).cast("double").alias(c) for c in ("char_distance", "word_distance")))
    compared = {"char_distance": (F.col("length") >= min_chars) & (F.col("length") > 0), "word_distance": (F.col("n_words") >= min_words) & (F.col("n_words") > 0)}
    for n, block in enumerate(references(made)):
        if n:
            out = cut(out)
        out = out.withColumns({name: F.when(when, F.least(name, distance(F.col(bins), refs))) for (name, when), bins, refs in zip(compared.items(), ("chars", "words"), block, strict=True) if refs})
    out = out.select(
        "doc_id", *BASE,
        ((F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).alias("base_failed"), "char_distance", "word_distance",
    )
    near = (F.coalesce("char_distance", F.lit(0.0)) <= max_chars) & (F.coalesce("word_distance", F.lit(0.0)) <= max_words)
    return out.withColumn("kept", ~F.col("base_failed") & near)
