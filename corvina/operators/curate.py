"""From raw records to works: projection, school stages, official awards, links between contests, quality reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvina import rules
from corvina.functions import records as R
from corvina.functions import text as T
from corvina.sources.readers import PLACE, last_line


#: Tasks that a common title's works are dealt to.
SHARES = 32


def empty_array() -> Column:
    return F.array().cast("array<string>")


def project(raw: DataFrame, subjects: DataFrame | None = None) -> DataFrame:
    """One work for each raw record, with everything that follows from its own fields. subjects: (src, subject, domains), a
    small table; of rows with one key any counts, see :func:`subject_table`."""
    src = F.when(F.contains(F.coalesce("科展類別", F.lit("")), F.lit(rules.NATIONAL)), rules.NATIONAL).otherwise(rules.INTERNATIONAL)
    title, subject, edition = T.txt(F.col("作品名稱")), T.txt(F.col("科別")), F.regexp_replace(T.txt(F.col("屆次")), T.BLANKS, "")
    works = raw.select(
        F.col("sid").cast("long").alias("id"), src.alias("src"), title.alias("title"), edition.alias("edition"), subject.alias("subject"),
        T.txt(F.col("得獎情形")).alias("award_raw"), R.award(F.col("得獎情形")).alias("_award"), T.txt(F.col("學校名稱")).alias("school"), R.city(F.col("學校名稱")).alias("city"),
        T.people(F.col("指導老師")).alias("teachers"), T.keywords(F.col("關鍵字")).alias("keywords"), T.txt(F.col("摘要或動機")).alias("abstract"), F.get("檔案連結", F.lit(0)).alias("pdf"),
    )
    works = works.withColumns({
        "type": F.when((F.col("src") == rules.NATIONAL) & F.contains("title", F.lit(rules.REVIEW)), rules.REVIEW).otherwise(rules.WORK),
        "edition_no": T.edition_of(F.col("edition")), "year": T.year_of(F.col("edition")),
        "rank": F.col("_award.rank"), "special": F.col("_award.special"), "rep": F.col("_award.rep"),
        "url": F.format_string(rules.RECORD_URL, T.lookup(F.col("src"), rules.RECORD_PAGES), F.col("id").cast("string")),
    }).drop("_award")
    if subjects is None:
        return works.withColumn("domains", empty_array())
    return works.join(F.broadcast(subjects), ["src", "subject"], "left").withColumn("domains", F.coalesce("domains", empty_array()))


def subject_table(csv: DataFrame) -> DataFrame:
    """(src, subject, domains) from the table of subjects; of equal keys the last line, or without places of lines the last in order
    of domains."""
    domains = T.non_empty(F.split(F.coalesce("標準領域", F.lit("")), "、"))
    rows = csv.withColumns({"src": F.col("來源"), "subject": F.col("原始科別"), "domains": domains})
    return last_line(rows.select("src", "subject", "domains", *places(csv)), ["src", "subject"], "domains")


def places(rows: DataFrame) -> list[str]:
    return [c for c in PLACE if c in rows.columns]


def codes(works: DataFrame, filenames: DataFrame, file_codes: DataFrame) -> DataFrame:
    """works with ``code`` (from the download's name, else from the matched file if it has six digits) and ``file_group``."""
    named = works.join(filenames.select(F.col("sid").alias("id"), "filename"), "id", "left")
    both = named.join(file_codes.select(F.col("sid").alias("id"), F.col("code").alias("_code"), F.col("grp").alias("file_group")), "id", "left")
    code = F.coalesce(T.none_if_empty(F.regexp_extract(F.coalesce("filename", F.lit("")), rules.CODE_IN_FILENAME, 1)), F.when(F.length("_code") == 6, F.col("_code")))
    return both.withColumn("code", code).drop("filename", "_code")


def neighbour_vote(rows: DataFrame, group: list[str], order: str, base: Column, ambiguous: Column, window: int = 4) -> DataFrame:
    """rows with ``voted``: the base value, or for ambiguous rows the most frequent one of the unambiguous rows among
    ``window`` before and behind it in its group (of equals the first met), if there is one."""
    w = Window.partitionBy(*group).orderBy(order).rowsBetween(-window, window)
    near = F.collect_list(F.when(~F.col("_amb"), F.col("_base"))).over(w)
    marked = rows.withColumn("_base", base).withColumn("_amb", ambiguous | F.col("_base").isNull())
    return marked.withColumn("_near", near).withColumn("voted", F.when(F.col("_amb"), F.coalesce(T.mode_of(F.col("_near")), F.col("_base"))).otherwise(F.col("_base"))).drop("_base", "_amb", "_near")


def stages(works: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """works with stage, stage_src and stage_detail. In this order: the code's first two digits, the listed group, the matched
    file's group, the subject's prefix, the vote of neighbours. Reviews have none. Needs ``code`` and ``file_group``."""
    if groups is not None:
        works = works.join(groups.select(F.col("sid").alias("id"), F.get("groups", F.lit(0)).alias("listed_group")), "id", "left")
    else:
        works = works.withColumn("listed_group", F.lit(None).cast("string"))
    works_only = works.filter(F.col("type") == rules.WORK).select("id", "src", "edition", "school")
    voted = neighbour_vote(works_only, ["src", "edition"], "id", R.school_stage(F.col("school")), F.col("school").rlike(rules.AMBIGUOUS_SCHOOL)).select("id", "voted")
    sure = lambda value, source: F.when(value.isNotNull(), F.struct(value.alias("stage"), F.lit(source).alias("src")))
    found = F.coalesce(
        sure(T.lookup(F.left("code", F.lit(2)), rules.CODE_STAGES), "作品編號"),
        sure(T.lookup(F.col("listed_group"), rules.GROUP_STAGES), "官網組別"),
        sure(T.lookup(F.col("file_group"), rules.FILE_GROUP_STAGES), "官網組別"),
        sure(T.none_if_empty(F.regexp_extract("subject", rules.SUBJECT_STAGE, 1)), "官網科別"),
        sure(F.col("voted"), "推測"),
    )
    out = works.join(voted, "id", "left").withColumn("_s", F.when(F.col("type") == rules.WORK, found))
    split = F.col("_s.stage").isin("高中", "高職")
    return out.withColumns({"stage": F.when(split, "高中職").otherwise(F.col("_s.stage")), "stage_src": F.col("_s.src"), "stage_detail": F.when(split, F.col("_s.stage"))}).drop("_s", "voted", "listed_group", "file_group")


def official_awards(works: DataFrame, official: DataFrame) -> DataFrame:
    """Ranks and special awards from the official list, by edition and code; of works with one key that with the
    largest id. Of lines with one key the last counts, or without places of lines the last in order of the award's text."""
    fixed = F.replace(F.replace(F.replace("名次", F.lit("最佳(鄉土)教材獎"), F.lit("最佳鄉土教材獎")), F.lit("(鄉土)教材獎"), F.lit("最佳鄉土教材獎")), F.lit("奬"), F.lit("獎"))
    listed = official.select(F.regexp_extract("屆次", r"(\d+)", 1).try_cast("int").alias("edition_no"), F.col("作品編號").alias("code"), fixed.alias("official"), *places(official))
    listed = last_line(listed, ["edition_no", "code"], "official")
    target = works.filter(F.coalesce("code", F.lit("")) != "").groupBy("edition_no", "code").agg(F.max("id").alias("id"))
    hit = target.join(listed, ["edition_no", "code"]).select("id", "official", R.award(F.col("official")).alias("_o"))
    out = works.join(hit, "id", "left")
    none, there = F.col("official") == "未列獎項", F.col("official").isNotNull()
    return out.withColumns({
        "rank": F.when(there & none, F.coalesce("rank", F.lit(rules.UNAWARDED))).when(there, F.coalesce("_o.rank", "rank")).otherwise(F.col("rank")),
        "special": F.when(there & ~none, F.array_distinct(F.concat("special", "_o.special"))).otherwise(F.col("special")),
        "award_src": F.when(there, "官方作品資料表"),
    }).drop("official", "_o")


def related(works: DataFrame, form: Callable[[Column], Column] = lambda ids: ids) -> DataFrame:
    """works with ``related``: ids of the other contest's works with the same title, in order; null without any. The titles are
    joined, so a very common one isn't gathered but for its ids. form: what is made of the ids, once for each title. A title's ids meet
    its works in the last join, so they are shuffled SHARES times and not once a work; its works are dealt to as many tasks."""
    key = F.when((F.col("type") == rules.WORK) & F.col("id").isNotNull(), T.title_key(F.col("title")))
    keyed = works.withColumns({"_k": key, "_s": F.pmod(F.xxhash64("id"), F.lit(SHARES)).cast("int")})
    ids = keyed.filter("_k is not null").groupBy("_k", "src").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    both = ids.groupBy("_k").agg(F.count("*").alias("n")).filter("n > 1").select("_k")
    there = F.when(F.col("src") == rules.NATIONAL, rules.INTERNATIONAL).otherwise(rules.NATIONAL)
    other = ids.join(both, "_k").select("_k", there.alias("src"), form(F.col("ids")).alias("related")).withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))))
    return keyed.join(other, ["_k", "src", "_s"], "left").select(*works.columns, "related")


def title_classes(works: DataFrame) -> DataFrame:
    """(id, src, class_id, n_national, n_international): works whose title is in both contests, class_id the least id of the title's
    works. A row for each work however common its title, in place of the arrays of :func:`related`; counts are summed before the shuffle."""
    key = works.filter(F.col("type") == rules.WORK).select("id", "src", T.title_key(F.col("title")).alias("_k"))
    national = F.count_if(F.col("src") == rules.NATIONAL)
    classes = key.groupBy("_k").agg(F.min("id").alias("class_id"), national.alias("n_national"), (F.count("*") - national).alias("n_international"))
    return key.join(classes.filter("n_national > 0 and n_international > 0"), "_k").select("id", "src", "class_id", "n_national", "n_international")


def quality_report(works: DataFrame) -> DataFrame:
    """(report, src, value, n): counts of works by source of stage, stage, subject without domain, rank and special award, and of
    national works without a city. One pass over the works: each row adds to the reports that it concerns."""
    entry = lambda name, src, value, on: F.when(on, F.struct(F.lit(name).alias("report"), src.alias("src"), value.alias("value")))
    true, all_ = F.lit(True), F.lit("*")
    entries = F.array(
        entry("stage_src", F.col("src"), F.col("stage_src"), true), entry("stage", F.col("src"), F.col("stage"), true),
        entry("no_domain", all_, F.col("subject"), F.size("domains") == 0), entry("rank", all_, F.col("rank"), true),
        entry("no_city", F.col("src"), F.lit("missing"), F.col("city").isNull() & (F.col("src") == rules.NATIONAL)),
        entry("no_city", F.col("src"), F.lit("total"), F.col("src") == rules.NATIONAL),
    )
    special = F.transform("special", lambda x: F.struct(F.lit("special").alias("report"), all_.alias("src"), x.alias("value")))
    rows = works.filter(F.col("type") == rules.WORK).select(F.explode(F.filter(F.concat(entries, special), lambda x: x.isNotNull())).alias("e"))
    return rows.groupBy("e.report", "e.src", "e.value").agg(F.count("*").alias("n"))


def curate(raw: DataFrame, subjects: DataFrame, filenames: DataFrame, file_codes: DataFrame, groups: DataFrame | None = None, official: DataFrame | None = None) -> DataFrame:
    """Raw records to works, all steps."""
    works = stages(codes(project(raw, subjects), filenames, file_codes), groups)
    works = official_awards(works, official) if official is not None else works.withColumn("award_src", F.lit(None).cast("string"))
    return related(works)
