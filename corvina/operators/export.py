"""What goes out: short records, the 28-column report, statistics, research packs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvina import rules
from corvina.functions import records as R
from corvina.functions import text as T


def short_records(works: DataFrame, with_text: DataFrame) -> DataFrame:
    """Short keys; what is empty is null and so left out of JSON. with_text: (id) of works with sections."""
    some = lambda c: F.when(F.size(c) > 0, F.col(c))
    text = lambda c: T.none_if_empty(F.col(c))
    flag = with_text.select("id").distinct().withColumn("f", F.lit(1))
    return works.join(flag, "id", "left").select(
        F.col("id").alias("i"), F.when(F.col("src") == rules.NATIONAL, 0).otherwise(1).alias("s"), text("title").alias("t"), F.col("year").alias("y"), text("edition").alias("e"),
        text("stage").alias("g"), text("stage_src").alias("gs"), text("stage_detail").alias("gd"), some("domains").alias("d"), text("subject").alias("sj"), text("rank").alias("r"),
        some("special").alias("sp"), some("rep").alias("rp"), text("school").alias("sc"), text("city").alias("c"), some("teachers").alias("tc"), some("keywords").alias("k"),
        text("code").alias("cd"), text("pdf").alias("p"), F.when(F.col("type") == rules.REVIEW, 1).alias("v"), some("related").alias("rl"), "f",
    )


def info(works: DataFrame, chunks: int, built: str) -> DataFrame:
    """One row: date, works, reviews, files of abstracts."""
    return works.agg(F.lit(built).alias("built"), F.count_if(F.col("type") == rules.WORK).alias("count"), F.count_if(F.col("type") != rules.WORK).alias("reviews"), F.lit(chunks).alias("abstract_files"))


def report(works: DataFrame, authors: DataFrame, with_text: DataFrame, files: DataFrame, folders: DataFrame, checked: str = "") -> DataFrame:
    """The 28 columns of the private workbook. authors: (id, authors), files: (id, file), folders: (file, folder)."""
    both = works.join(authors.select("id", "authors"), "id", "left").join(with_text.select("id").distinct().withColumn("_t", F.lit(True)), "id", "left")
    both = both.join(files.groupBy("id").agg(F.max("file").alias("_file")), "id", "left").join(folders.groupBy(F.col("file").alias("_file")).agg(F.max("folder").alias("_folder")), "_file", "left")
    clean = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "")
    listed = lambda c: F.coalesce(F.array_join(c, "、"), F.lit(""))
    yes = lambda c: F.when(c.isNotNull(), "有").otherwise("")
    names = F.array_join(T.non_empty(F.transform(F.split(F.replace("authors", F.lit("；"), F.lit(";")), ";"), T.strip)), "、")
    columns = {
        "sid": F.col("id"), "作品名稱": clean(F.col("title")), "科展類別": F.when(F.col("src") == rules.NATIONAL, "全國中小學科展").otherwise("臺灣國際科展"), "屆次": clean(F.col("edition")), "年份": F.col("year"),
        "學習階段": F.coalesce("stage_detail", "stage", F.lit("")), "學習階段來源": F.coalesce(T.lookup(F.col("stage_src"), rules.STAGE_SOURCES), F.lit("")), "科別": clean(F.col("subject")), "標準領域": listed("domains"),
        "得獎情形": clean(F.col("award_raw")), "名次": F.coalesce("rank", F.lit("")), "特別獎": listed("special"), "得獎資料來源": F.when(F.col("award_src").isNotNull(), "官方作品資料表").otherwise("科教館網站"),
        "學校名稱": clean(F.col("school")), "縣市": F.coalesce("city", F.lit("")), "指導老師": clean(listed("teachers")), "作者": clean(names), "關鍵字": clean(listed("keywords")), "作品編號": F.coalesce("code", F.lit("")),
        "類型": F.col("type"), "同作品另一科展 sid": listed(F.col("related").cast("array<string>")), "研究內容節錄": yes(F.col("_t")), "本機PDF": yes(F.col("_file")), "分科資料夾": F.coalesce("_folder", F.lit("")),
        "官網核對日期": F.lit(checked), "摘要或動機": clean(F.col("abstract")), "檔案連結": F.coalesce("pdf", F.lit("")), "科教館頁面": F.col("url"),
    }
    return both.select(*(c.alias(n) for n, c in columns.items()))


def statistics(works: DataFrame, with_file: Column, with_text: Column) -> DataFrame:
    """(src, edition, works, with_file, with_text, reviews, place): by contest and edition, national ones first, then by the first
    year of an edition and its first id; the total last, with null keys."""
    is_work = F.col("type") == rules.WORK
    rows = works.withColumns({"_f": F.coalesce(with_file, F.lit(False)), "_x": F.coalesce(with_text, F.lit(False))})
    counts = [F.count_if(is_work).alias("works"), F.count_if(is_work & F.col("_f")).alias("with_file"), F.count_if(is_work & F.col("_x")).alias("with_text"), F.count_if(~is_work).alias("reviews")]
    first = F.min(F.struct(F.coalesce("year", F.lit(0)).alias("y"), F.col("id").alias("i"))).alias("first")
    each = rows.groupBy("src", "edition").agg(*counts, first)
    # the total is of the groups, a small table
    total = each.agg(*(F.sum(c).alias(c) for c in ("works", "with_file", "with_text", "reviews"))).select(F.lit(None).cast("string").alias("src"), F.lit(None).cast("string").alias("edition"), "works", "with_file", "with_text", "reviews", F.lit(None).cast(each.schema["first"].dataType).alias("first"))
    last, other = F.col("src").isNull(), F.col("src") != rules.NATIONAL
    return each.unionByName(total).orderBy(last, other, "first.y", "first.i").drop("first")


def pack_header(topic: str, built: str, n: int, with_text: int, instructions: list[str]) -> list[str]:
    return [f"# 科展研究包：{topic or '自選主題'}", "", f"產生日期：{built}　共 {n} 件作品，其中 {with_text} 件附研究內容節錄", *instructions, "", "## 作品"]


def pack(works: DataFrame, ids: list[int], sections: DataFrame | None = None) -> DataFrame:
    """(at, id, text): the passage of each work of a basket, in its order. sections: (id, secs array<struct<h,t>>)."""
    chosen = works.sparkSession.createDataFrame(list(enumerate(ids)), "at int, id long")
    rows = works.join(F.broadcast(chosen), "id")
    rows = rows.join(sections, "id", "left") if sections is not None else rows.withColumn("secs", F.lit(None).cast("array<struct<h:string,t:string>>"))
    or_ = lambda c, d: F.coalesce(T.none_if_empty(F.col(c)), F.lit(d))
    national = F.col("src") == rules.NATIONAL
    award = T.none_if_empty(F.array_join(F.filter(F.concat(F.array("rank"), "special"), lambda x: x.isNotNull()), "・"))
    parts = [
        F.concat(F.lit("\n### W"), (F.col("at") + 1).cast("string"), F.lit("｜"), F.col("title")),
        F.concat(F.lit("- 來源："), F.when(national, "全國中小學科展").otherwise("臺灣國際科展"), F.lit("　"), F.when(national, F.col("edition")).otherwise(F.concat(F.coalesce(F.col("year").cast("string"), F.lit("undefined")), F.lit(" 年")))),
        F.concat(F.lit("- 學習階段／科別："), F.coalesce("stage_detail", "stage", F.lit("未標示")), F.lit("／"), or_("subject", "未填")),
        F.concat(F.lit("- 得獎："), award),
        F.concat(F.lit("- 學校："), or_("school", "未填")),
        F.when(F.size("keywords") > 0, F.concat(F.lit("- 關鍵字："), F.array_join("keywords", "、"))),
        F.concat(F.lit("- 科教館頁面："), F.col("url")),
        F.concat(F.lit("- PDF 全文："), F.col("pdf")),
        F.concat(F.lit("\n摘要："), or_("abstract", "（無摘要）")),
        F.when(F.size("secs") > 0, F.concat(F.lit("\n研究內容節錄（自動取自 PDF，圖表與公式可能缺漏）：\n"), F.array_join(F.transform("secs", lambda s: F.concat(F.lit("\n#### "), s["h"], F.lit("\n"), s["t"])), "\n"))),
    ]
    return rows.select("at", "id", F.concat_ws("\n", *parts).alias("text")).orderBy("at")


def pack_warning(works: DataFrame, ids: list[int], with_text: DataFrame) -> DataFrame:
    """One row with ``warning``: many works with sections, else many works; null for small packs."""
    few = works.filter(F.col("id").isin(ids)).join(with_text.select("id").distinct().withColumn("_t", F.lit(True)), "id", "left")
    n = few.agg(F.count_if(F.col("_t").isNotNull()).alias("texts"), F.count("*").alias("n"))
    return n.select(F.when(F.col("texts") > 30, "sections").when(F.col("n") > 100, "works").alias("warning"))


def pack_filename(q: str) -> Column:
    return F.concat(F.lit("科展研究包_"), T.safe_name(F.coalesce(T.none_if_empty(F.trim(F.lit(q))), F.lit("自選")), 30, r'[\\/:*?"<>|\s]+'), F.lit(".md"))


award_class = R.award_class
