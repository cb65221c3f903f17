"""Rules on the fields of records, as column expressions: awards, places, school stages, file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvina import rules
from corvina.functions import text as T


def award(c: Column) -> Column:
    """struct(rank, special, rep) of an award field."""
    chunks = F.split(T.txt(c), "[;；、]")
    is_rep = lambda x: x.rlike("代表|展覽會|博覽會")
    parts = T.non_empty(F.flatten(F.transform(F.filter(chunks, lambda x: ~is_rep(x)), lambda x: F.split(x, T.BLANKS))))
    ranks = F.filter(parts, lambda x: x.isin(*rules.RANKS))
    real = F.filter(ranks, lambda x: ~x.isin(*rules.NO_RANK))

    def special(x: Column) -> Column:
        x = F.replace(F.replace(x, F.lit("(鄉土)教材獎"), F.lit("最佳鄉土教材獎")), F.lit("最佳最佳"), F.lit("最佳"))
        return F.coalesce(T.lookup(x, rules.SPECIAL_SPELLINGS), x)

    return F.struct(
        F.coalesce(F.get(real, F.lit(0)), F.when(F.size(ranks) > 0, F.lit(rules.UNAWARDED))).alias("rank"),
        F.array_distinct(F.transform(F.filter(parts, lambda x: ~x.isin(*rules.RANKS)), special)).alias("special"),
        F.transform(F.filter(chunks, is_rep), lambda x: F.regexp_replace(x, T.BLANKS, "")).alias("rep"),
    )


def award_class(rank: Column) -> Column:
    return F.when(rank.isin(*rules.TOP_RANKS), "top").when(rank.isin(*rules.MERIT_RANKS), "merit").when(rank == rules.UNAWARDED, "none")


def city(c: Column) -> Column:
    """A renamed county, else the full city name that comes first, else a town, else the short name that comes first."""
    s = F.translate(T.txt(c), "台", "臺")
    pairs = lambda p: F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in p))
    listed = lambda p: F.get(F.filter(pairs(p), lambda x: F.contains(s, x["a"])), F.lit(0))["b"]

    def first(p: list[tuple[str, str]]) -> Column:
        found = F.transform(pairs(p), lambda x: F.struct(F.call_function("instr", s, x["a"]).alias("at"), x["b"].alias("b")))
        return F.array_min(F.filter(found, lambda x: x["at"] > 0))["b"]

    return F.coalesce(listed(rules.OLD_COUNTIES), first([(x, x) for x in rules.CITIES]), listed(rules.TOWNS), first([(x[:2], x) for x in rules.SHORT_CITIES]))


def school_stage(c: Column) -> Column:
    s = F.translate(F.coalesce(c, F.lit("")), "臺", "台")
    out = F.lit(None).cast("string")
    for pattern, stage in reversed(rules.SCHOOL_STAGES):
        out = F.when(s.rlike(pattern), stage).otherwise(out)
    return out


def filename(c: Column) -> Column:
    """struct(edition, grp, code, title) of a name like 第N屆_group_..._code_title.pdf; null if it isn't one. Digits that the
    title begins with, each with '_', are codes too, of which the last counts; a group in brackets at the end goes."""
    pattern = r"^第(\d+)屆_([^_]+)_.*?_(\d{2,6})_(.+)\.pdf$"
    part = lambda i: F.regexp_extract(c, pattern, i)
    front = F.regexp_extract(part(4), r"^((?:\d{2,4}_)*)", 1)
    rest = F.substring(part(4), F.length(front) + 1, F.length(part(4)))
    return F.when(
        c.rlike(pattern),
        F.struct(
            part(1).try_cast("int").alias("edition"),
            part(2).alias("grp"),
            F.coalesce(T.none_if_empty(F.regexp_extract(front, r"(\d{2,4})_$", 1)), part(3)).alias("code"),
            F.regexp_replace(rest, "[（(][^）)]*組[）)]$", "").alias("title"),
        ),
    )


def is_document(name: Column) -> Column:
    return F.lower(name).endswith(".pdf") & ~name.startswith("._")


def folder_base(domains: Column, default: str = "其他") -> Column:
    return F.coalesce(T.none_if_empty(F.array_join(domains, "、")), F.lit(default))


def fetch_status(head: Column, error: Column) -> Column:
    """Of a download: ok, not a document, or failed."""
    return F.when(F.substring(head, 1, 5) == F.lit("%PDF-").cast("binary"), "ok").when(error.isNull(), "不是 PDF（連結可能已失效）").otherwise(F.concat(F.lit("下載失敗："), F.left(error, F.lit(60))))
