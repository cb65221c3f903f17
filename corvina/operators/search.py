"""Ranked search with facets, novelty checks, snippets."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from functools import reduce
from operator import and_, or_
from urllib.parse import parse_qs, urlencode
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvina import rules
from corvina.functions import records as R
from corvina.functions import text as T

PAGE, MORE = 30, 60
GROUPS = ("src", "stage", "domain", "award")
PARAMS = (("src", "src"), ("st", "stage"), ("dm", "domain"), ("aw", "award"))


def normalised(text: str) -> str:
    table = {ord("台"): "臺"} | {0xFF01 + i: 0x21 + i for i in range(94)}
    return (text or "").lower().translate(table)


@dataclass(frozen=True)
class SearchRequest:
    q: str = ""
    src: frozenset[str] = frozenset()
    stage: frozenset[str] = frozenset()
    domain: frozenset[str] = frozenset()
    award: frozenset[str] = frozenset()
    year_from: int | None = None
    year_to: int | None = None
    city: str = ""
    review: bool = False
    scope: bool = False
    sort: str = "rel"
    shown: int = PAGE
    open: int | None = None
    basket: tuple[int, ...] = field(default=())

    @property
    def terms(self) -> list[str]:
        return normalised(self.q).split()

    @property
    def active(self) -> int:
        """How many filters are set."""
        return sum(len(getattr(self, g)) for g in GROUPS) + sum(map(bool, (self.city, self.year_from, self.year_to, self.review)))

    def more(self) -> SearchRequest:
        return replace(self, shown=self.shown + MORE)

    def toggled(self, id_: int) -> SearchRequest:
        """With a work put into the basket, or taken out of it; the order is that of putting in."""
        return replace(self, basket=tuple(x for x in self.basket if x != id_) if id_ in self.basket else (*self.basket, id_))

    def query_string(self) -> str:
        pairs = [("q", self.q)] + [(p, ",".join(sorted(getattr(self, g)))) for p, g in PARAMS]
        pairs += [("yf", self.year_from), ("yt", self.year_to), ("c", self.city), ("rv", "1" * self.review), ("sc", "1" * self.scope), ("sort", self.sort if self.sort != "rel" else ""), ("w", self.open)]
        return urlencode([(k, v) for k, v in pairs if v])

    @classmethod
    def from_query_string(cls, text: str) -> SearchRequest:
        p = {k: v[0] for k, v in parse_qs(text.removeprefix("?")).items()}
        number = lambda k: int(p[k]) or None if re.fullmatch(r"\d+", p.get(k, "")) else None
        groups = {g: frozenset(p[k].split(",")) for k, g in PARAMS if p.get(k)}
        return cls(q=p.get("q", ""), **groups, year_from=number("yf"), year_to=number("yt"), city=p.get("c", ""), review=p.get("rv") == "1", scope=p.get("sc") == "1", sort=p.get("sort", "rel"), open=number("w"))


def serving(works: DataFrame) -> DataFrame:
    """works with their normalised fields, as a table to be kept for many searches."""
    return works.withColumns({
        "_t": T.search_norm(F.col("title")), "_k": T.search_norm(F.array_join("keywords", " ")), "_o": T.search_norm(F.concat_ws(" ", "school", F.array_join("teachers", " "))), "_a": T.search_norm(F.col("abstract")),
    })


def hit(term: str, scope: bool) -> Column:
    points = F.when(F.contains("_t", F.lit(term)), 6).otherwise(0) + F.when(F.contains("_k", F.lit(term)), 4).otherwise(0)
    return points if scope else points + F.when(F.contains("_o", F.lit(term)), 2).otherwise(0) + T.occurrences(F.col("_a"), term, 3)


def scored(docs: DataFrame, req: SearchRequest) -> DataFrame:
    """The candidates: documents that have all terms, with ``score`` and ``core`` (a title or keyword has a term)."""
    if not req.terms:
        return docs.withColumns({"score": F.lit(1), "core": F.lit(False)})
    hits = {f"_h{i}": hit(t, req.scope) for i, t in enumerate(req.terms)}
    some = docs.withColumns(hits).filter(reduce(and_, (F.col(h) > 0 for h in hits)))
    whole = F.when(F.contains("_t", F.lit("".join(req.terms))), 4).otherwise(0) if len(req.terms) > 1 else F.lit(0)
    core = reduce(or_, (F.contains(c, F.lit(t)) for t in req.terms for c in ("_t", "_k")))
    return some.withColumns({"score": reduce(lambda a, b: a + b, map(F.col, hits)) + whole, "core": core}).drop(*hits)


# ---- posting lists -------------------------------------------------------------------------------------------------

#: Ids of one row of a posting list lie within a span; folders of the index, by a hash of the gram, and parts of each that are made apart.
SPAN, BUCKETS, PARTS = 1 << 16, 64, 16
#: Characters, and entries (text, gram), that are sorted at once; the bits of a text's number.
CHARS, ENTRIES, LOW = 1 << 21, 1 << 22, (1 << 20) - 1


def term_grams(terms: list[str]) -> list[str]:
    """The pairs of neighbouring characters that a document with all terms has; of a term of one character that one."""
    return sorted({g for t in terms for g in ([t[i : i + 2] for i in range(len(t) - 1)] or [t])})


def postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, block, ids) for (id, text): the grams of each text once, put together for as many texts as make some millions of entries.
    An entry is one number, of the gram's characters and the text's, so a sort is all it takes."""

    def give() -> pa.RecordBatch:
        known, rank = np.unique(np.array(ids, np.int64), return_inverse=True)
        entries = np.concatenate(kept)
        entries = np.unique((entries & ~LOW) | rank[entries & LOW])
        gram, id_ = entries >> 20, known[entries & LOW]
        block = id_ // SPAN
        new = np.flatnonzero(np.append(True, (gram[1:] != gram[:-1]) | (block[1:] != block[:-1])))
        names, at = np.unique(gram[new], return_inverse=True)
        words = pa.array([(chr((g >> 21) - 1) if g >> 21 else "") + chr(g & 0x1FFFFF) for g in names.tolist()], pa.string())
        lists = pa.ListArray.from_arrays(pa.array(np.append(new, len(entries)), pa.int32()), pa.array(id_, pa.int64()))
        return pa.RecordBatch.from_arrays([words.take(pa.array(at)), pa.array(block[new], pa.int64()), lists], ["gram", "block", "ids"])

    ids, kept, waiting = [], [], 0
    for b in batches:
        texts, lo = b.column(1).to_pylist(), 0
        upto = np.cumsum([len(t) for t in texts])
        while lo < len(texts):
            hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + CHARS, "right")))
            chars = np.frombuffer("".join(texts[lo:hi]).encode("utf-32-le"), np.uint32).astype(np.int64)
            doc = np.repeat(np.arange(len(ids), len(ids) + hi - lo), [len(t) for t in texts[lo:hi]])
            pairs = np.flatnonzero(doc[1:] == doc[:-1])
            grams = np.concatenate([chars, (chars[pairs] + 1) << 21 | chars[pairs + 1]])
            kept.append(np.unique(grams << 20 | np.concatenate([doc, doc[pairs]])))
            ids += b.column(0)[lo:hi].to_pylist()
            waiting += len(kept[-1])
            lo = hi
            if waiting > ENTRIES or len(ids) > LOW // 2:
                yield give()
                ids, kept, waiting = [], [], 0
    if waiting:
        yield give()


def write_grams(docs: DataFrame, path: str) -> None:
    """The index of serving documents: (bucket, gram, block, ids), gram a character or a pair of neighbours, ids in order, at most a span of
    them in a row however frequent the gram. A folder for each bucket, rows in order of gram, so that a search reads few row groups.
    What is shuffled is the lists of many texts at once, not a row for each text and gram."""
    texts = docs.filter("id is not null").select(F.col("id").cast("long").alias("id"), F.concat_ws("\n", "_t", "_k", "_o", "_a").alias("text"))
    crc = F.crc32(F.encode("gram", "UTF-8"))
    lists = texts.mapInArrow(postings, "gram string, block long, ids array<long>")
    placed = lists.select((crc % BUCKETS).cast("int").alias("bucket"), (F.floor(crc / BUCKETS) % PARTS).cast("int").alias("part"), "gram", "block", "ids").repartition("bucket", "part")
    rows = placed.groupBy("bucket", "part", "gram", "block").agg(F.sort_array(F.flatten(F.collect_list("ids"))).alias("ids")).drop("part")
    rows.sortWithinPartitions("bucket", "gram", "block").write.mode("overwrite").partitionBy("bucket").parquet(path)


def posted(spark: SparkSession, path: str, terms: list[str]) -> DataFrame:
    """(id) of the documents that have all grams of the terms: those with all terms are among them. Lists are intersected within
    blocks, so what is gathered is a row for each gram."""
    grams = term_grams(terms)
    buckets = sorted({crc32(g.encode()) % BUCKETS for g in grams})
    rows = spark.read.parquet(path).filter(F.col("bucket").isin(buckets) & F.col("gram").isin(grams))
    lists = rows.groupBy("block").agg(F.collect_list("ids").alias("l")).filter(F.size("l") == len(grams))
    return lists.select(F.explode(F.aggregate(F.slice("l", 2, len(grams)), F.get("l", F.lit(0)), lambda a, b: F.array_intersect(a, b))).alias("id"))


def narrowed(docs: DataFrame, path: str, req: SearchRequest) -> DataFrame:
    """The serving documents that a request with terms can find, by the index of all of them; without terms all documents. Searches and
    facets give the same rows over these."""
    return docs.join(posted(docs.sparkSession, path, req.terms), "id", "left_semi") if req.terms else docs


# ---- filters and order ---------------------------------------------------------------------------------------------


def stage_label() -> Column:
    return F.coalesce("stage", F.lit("未標示"))


def source_number() -> Column:
    return F.when(F.col("src") == rules.NATIONAL, "0").otherwise("1")


def always(req: SearchRequest) -> Column:
    """The filters that hold for every facet. A null year is within any range."""
    review = (F.col("type") == rules.REVIEW) == F.lit(req.review)
    low = ~F.coalesce(F.col("year") < req.year_from, F.lit(False)) if req.year_from else F.lit(True)
    high = ~F.coalesce(F.col("year") > req.year_to, F.lit(False)) if req.year_to else F.lit(True)
    return review & low & high & (F.col("city").eqNullSafe(req.city) if req.city else F.lit(True))


def award_values() -> Column:
    """A document's values in the award facet: its class, and special or unknown."""
    special = F.size("special") > 0
    values = F.array(R.award_class(F.col("rank")), F.when(special, "special"), F.when(F.col("rank").isNull() & ~special, "unknown"))
    return F.filter(values, lambda x: x.isNotNull())


def facet_values() -> dict[str, Column]:
    return {"src": F.array(source_number()), "stage": F.array(stage_label()), "domain": F.col("domains"), "award": award_values()}


def groups_passed(req: SearchRequest) -> dict[str, Column]:
    wanted = lambda g: F.array(*map(F.lit, sorted(getattr(req, g))))
    return {g: F.arrays_overlap(v, wanted(g)) if getattr(req, g) else F.lit(True) for g, v in facet_values().items()}


def ordered(req: SearchRequest) -> list[Column]:
    """Null years last."""
    sort = req.sort if req.terms or req.sort != "rel" else "new"
    year, id_ = F.col("year").desc_nulls_last(), F.col("id").desc()
    return {"rel": [F.desc("score"), year, id_], "new": [year, id_], "old": [F.col("year").asc_nulls_last(), F.col("id").asc()]}[sort]


def search(docs: DataFrame, req: SearchRequest) -> DataFrame:
    """The hits shown, best first."""
    return passing(scored(docs, req), req).orderBy(*ordered(req)).limit(req.shown)


def passing(candidates: DataFrame, req: SearchRequest) -> DataFrame:
    return candidates.filter(always(req) & reduce(and_, groups_passed(req).values()))


def facets(candidates: DataFrame, req: SearchRequest) -> DataFrame:
    """(facet, value, n): for each facet how many candidates pass the other facets' filters. One pass: a candidate adds to the
    facets for which it passes the rest, and the counts are summed before the shuffle."""
    ok = groups_passed(req)

    def part(group: str, values: Column) -> Column:
        rest = reduce(and_, (c for k, c in ok.items() if k != group))
        named = F.transform(values, lambda x: F.struct(F.lit(group).alias("facet"), x.alias("value")))
        return F.when(rest, named).otherwise(F.array().cast("array<struct<facet:string,value:string>>"))

    parts = [part(g, v) for g, v in facet_values().items()]
    rows = candidates.filter(always(req)).select(F.explode(F.concat(*parts)).alias("f"))
    return rows.groupBy("f.facet", "f.value").agg(F.count("*").alias("n"))


def pickers(docs: DataFrame) -> DataFrame:
    """(kind, value, n): years, newest first, and cities in the order of Chinese."""
    rows = docs.select(F.explode(F.array(F.struct(F.lit("year").alias("kind"), F.col("year").cast("string").alias("value")), F.struct(F.lit("city").alias("kind"), F.col("city").alias("value")))).alias("x")).select("x.*")
    return rows.filter("value is not null").groupBy("kind", "value").agg(F.count("*").alias("n")).orderBy(F.desc("kind"), F.when(F.col("kind") == "year", F.col("value")).desc_nulls_last(), F.expr("value collate zh_Hant"))


def novelty_lines(text: str) -> list[list[str]]:
    """The keywords of each line, behind the label if it has one."""
    out = []
    for line in text.split("\n"):
        m = re.search(r"查證關鍵字[:：]\s*(.+)", line)
        out.append(list(dict.fromkeys(filter(None, re.split(r"[\s、,，;；/]+", normalised(m[1] if m else line))))))
    return [x for x in out if x]


def novelty(docs: DataFrame, lines: list[list[str]], top_full: int | None = None, top_part: int | None = None) -> DataFrame:
    """(line, kind, id, score, year[, rank]): works that mention all keywords of a line (full), or of several keywords half or more
    (part; ten more points for each). Every line is tried on each work as it is read; only what matches goes on."""
    found = []
    for n, words in enumerate(lines):
        points = [F.when(F.contains("_t", F.lit(k)), 6).otherwise(0) + F.when(F.contains("_k", F.lit(k)), 4).otherwise(0) + F.when(F.contains("_a", F.lit(k)), 1).otherwise(0) for k in words]
        hits, score = reduce(lambda a, b: a + b, [(p > 0).cast("int") for p in points]), reduce(lambda a, b: a + b, points)
        row = lambda kind, s, n=n: F.struct(F.lit(n).alias("line"), F.lit(kind).alias("kind"), s.alias("score"))
        one = F.when(hits == len(words), row("full", score))
        found.append(one.when(hits >= (len(words) + 1) // 2, row("part", score + 10 * hits)) if len(words) > 1 else one)
    rows = docs.filter(F.col("type") == rules.WORK).select("id", "year", F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("m"))
    out = rows.select("m.line", "m.kind", "id", "m.score", "year")
    if top_full is None and top_part is None:
        return out
    from pyspark.sql.window import Window

    rank = F.row_number().over(Window.partitionBy("line", "kind").orderBy(F.desc("score"), F.col("year").desc_nulls_last(), "id"))
    return out.withColumn("rank", rank).filter(((F.col("kind") == "full") & (F.col("rank") <= (top_full or 6))) | ((F.col("kind") == "part") & (F.col("rank") <= (top_part or 4))))


def snippet(req: SearchRequest) -> Column:
    """Of the abstract: from 30 characters before the first term that stands behind the 40th; at most 140 characters."""
    start = F.lit(0)
    for t in reversed(req.terms):
        at = F.call_function("instr", F.col("_a"), F.lit(t)) - 1
        start = F.when(at > 40, at - 30).when(at >= 0, 0).otherwise(start)
    text = F.when(start > 0, F.concat(F.lit("…"), F.substring("abstract", start + 1, F.length("abstract")))).otherwise(F.col("abstract"))
    return F.when(F.length(text) > 140, F.concat(F.left(text, F.lit(140)), F.lit("…"))).otherwise(text)


def marked(req: SearchRequest, text: Column, most: int | None = None) -> Column:
    return T.highlight(text, T.search_norm(text), req.terms, most)


def meta_line() -> Column:
    """What is shown below a title: contest, year, edition, stage, subject, awards, school; what is missing is skipped."""
    award = F.array_join(F.filter(F.concat(F.array("rank"), "special"), lambda x: x.isNotNull()), "・")
    guess = F.when(F.col("stage_src") == "推測", F.concat("stage", F.lit("?"))).otherwise(F.col("stage"))
    return F.concat_ws(" · ", "src", F.col("year").cast("string"), F.when(F.col("src") == rules.NATIONAL, T.none_if_empty(F.split_part("edition", F.lit("--"), F.lit(1)))), guess, T.none_if_empty(F.col("subject")), F.when(~F.col("rank").eqNullSafe(rules.UNAWARDED), T.none_if_empty(award)), T.none_if_empty(F.col("school")))


#: What the detail view says of a stage's source, and of what a record doesn't have.
STAGE_NOTES = (("作品編號", "取自官方作品編號"), ("官網組別", "取自官網組別"), ("官網科別", "取自官網科別"), ("推測", "本站依學校名稱推測"))
UNMARKED, NO_SUBJECT, NO_ABSTRACT = "未標示", "（未填）", "這件作品沒有摘要。"


def detail_fields(works: DataFrame) -> DataFrame:
    """(id, at, label, value): the lines of a work's detail view in order, for all works; lines without a value are left out. Values are
    plain text, notes in brackets. Null fields are as empty ones. No shuffle."""
    has = lambda c: T.none_if_empty(F.col(c) if isinstance(c, str) else c)
    noted = lambda value, note: F.concat(value, F.coalesce(F.concat(F.lit("（"), note, F.lit("）")), F.lit("")))
    listing = lambda c, sep="、": has(F.array_join(c, sep))
    domains = F.concat(F.lit("領域："), listing("domains"))
    award = has(F.concat_ws("・", "rank", *[has(F.array_join("special", "・"))]))
    when = F.when(F.col("src") == rules.NATIONAL, has("edition")).otherwise(F.concat(F.col("year").cast("string"), F.lit(" 年")))
    stage = F.coalesce(has("stage_detail"), has("stage"))
    lines = (
        ("編號", F.coalesce(F.concat(F.lit("作品編號 "), has("code")), F.concat(F.lit("SID "), F.col("id").cast("string")))), ("作品", has("title")), ("來源", F.concat_ws("・", "src", when)),
        ("學習階段", F.coalesce(noted(stage, T.lookup(F.col("stage_src"), STAGE_NOTES)), F.lit(UNMARKED))), ("科別", noted(F.coalesce(has("subject"), F.lit(NO_SUBJECT)), domains)),
        ("得獎", F.coalesce(award, F.lit(UNMARKED))), ("出國代表", listing("rep", "；")), ("學校", has(F.concat_ws(" ", has("school"), has("city")))), ("指導老師", listing("teachers")),
        ("關鍵字", listing("keywords")), ("摘要或動機", F.coalesce(has("abstract"), F.lit(NO_ABSTRACT))), ("下載", has("pdf")), ("原始頁面", has("url")),
    )
    rows = F.array(*(F.struct(F.lit(i).alias("at"), F.lit(n).alias("label"), v.alias("value")) for i, (n, v) in enumerate(lines)))
    return works.select("id", F.inline(F.filter(rows, lambda x: x["value"].isNotNull())))


def detail(works: DataFrame, id_: int, similar: DataFrame, plain: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The work of an id, and its neighbours and related works in order, as far as they are in the table. plain: the works before
    ``related`` was joined to them, if at hand, so that it is joined to the one work only."""
    one = works.filter(F.col("id") == id_)
    links = similar.filter(F.col("id") == id_).select(F.lit("similar").alias("kind"), F.col("rank").cast("int").alias("at"), F.col("other").alias("_o"))
    links = links.unionByName(one.select(F.lit("related").alias("kind"), F.posexplode("related").alias("at", "_o")))
    return one, links.join((works if plain is None else plain).select(F.col("id").alias("_o"), "title", "src", "year"), "_o").select("kind", "at", F.col("_o").alias("id"), "title", "src", "year").orderBy("kind", "at")
