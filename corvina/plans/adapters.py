"""The driver's tables as the datasets of this engine. The fields that documents don't have are taken from short literal
lists by id, so that the rules meet real Chinese values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SUBJECTS = ("物理科", "國小組化學科", "生物", "數學科", "國中組生物", "高職組農業", "電腦科學", "地球科學", "高中組物理")
DOMAINS = ((("物理科",), "物理"), (("國小組化學科",), "化學"), (("生物", "國中組生物"), "生物"), (("數學科",), "數學"), (("高職組農業",), "農業與食品、生物"), (("電腦科學",), "資訊"))
AWARDS = ("第一名;團體合作獎", "佳作 (鄉土)教材獎", "最佳(鄉土)教材獎", "一等獎；美國代表;未得獎作品", "未得獎作品、第三名", "無", "", "第二名 第一名", "大會獎佳作;最佳創意獎", "四等獎 國際科技展覽會 代表", "特別獎")
SCHOOLS = ("台北縣立板橋高級中學", "國立臺灣師範大學附屬高級中學", "臺南一中", "", "臺北市立大同高級中學(國中部)", "國立清華大學", "高雄市立三民國民小學", "財團法人實驗學校", "彰化縣立員林國民中學", "新竹市科學工業園區實驗高級中學", "花蓮縣玉里國小", "國立臺中高級工業職業學校", "宜蘭縣羅東高中")
TEACHERS = ("王大明；李小華", "陳一", "林、 張三 ,李四", "")
KEYWORDS = ("光合作用 葉綠素", "solar cell", "蚵殼/吸附/蚵殼", "界面活性劑、螞蟻", "ＡＢ測試；台灣", "")
GROUPS = ("國小組", "國中組", "高級中等學校組", "其他")
FILE_GROUPS = ("高中組", "國中教師組", "未知組")
OFFICIAL = ("第一名", "未列獎項", "佳作 最佳團隊奬", "(鄉土)教材獎")


def pick(values: tuple[str, ...], id_: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (id_ % len(values) + 1).cast("int"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw records, one for each document."""
    i = F.col("doc_id")
    year = 1974 + i % 52
    national = i % 4 != 0
    edition = F.when(national, F.concat(F.lit("第"), (year - 1960).cast("string"), F.lit("屆--民國 "), (year - 1911).cast("string"), F.lit("年"))).otherwise(year.cast("string"))
    title = F.left(F.split_part(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(1)), F.lit(60))
    title = F.when(i % 29 == 1, F.concat(F.lit("評語 "), title)).otherwise(title)
    return table(spark, sf_dir, "documents").select(
        i.alias("sid"), title.alias("作品名稱"), F.when(national, "全國中小學科展").otherwise("臺灣國際科展作品").alias("科展類別"), edition.alias("屆次"), pick(SUBJECTS, i).alias("科別"), pick(AWARDS, i).alias("得獎情形"),
        pick(SCHOOLS, i).alias("學校名稱"), pick(TEACHERS, i).alias("指導老師"), F.concat(pick(TEACHERS, i + 1), F.lit("；"), F.col("lang")).alias("作者"), pick(KEYWORDS, i).alias("關鍵字"), F.col("text").alias("摘要或動機"),
        F.when(i % 3 != 0, F.array(F.concat(F.lit("https://example.org/file?id="), i.cast("string")))).otherwise(F.array().cast("array<string>")).alias("檔案連結"), F.lit(None).cast("string").alias("error"),
    )


def subjects(spark: SparkSession) -> DataFrame:
    rows = [(src, s, d.split("、")) for src in ("全國", "國際") for names, d in DOMAINS for s in names]
    return spark.createDataFrame(rows, "src string, subject string, domains array<string>")


def filenames(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    code = F.concat(F.lpad(F.element_at(F.array(*map(F.lit, ("03", "04", "05", "08", "77"))), (i % 5 + 1).cast("int")), 2, "0"), F.lpad((i % 10000).cast("string"), 4, "0"))
    return table(spark, sf_dir, "documents").filter(i % 5 == 2).select(i.alias("sid"), F.concat(F.lit("nphssf2016-"), code, F.lit(".pdf")).alias("filename"))


def file_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    code = F.when(i % 2 == 0, F.lpad((80000 + i % 10000).cast("string"), 6, "0")).otherwise("1234")
    return table(spark, sf_dir, "documents").filter(i % 5 == 3).select(i.alias("sid"), code.alias("code"), pick(FILE_GROUPS, i).alias("grp"), F.concat(F.lit("f"), i.cast("string"), F.lit(".pdf")).alias("file"))


def groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    return table(spark, sf_dir, "documents").filter(i % 7 == 4).select(i.alias("sid"), F.array(pick(GROUPS, i), F.lit("x")).alias("groups"))


def official(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list of a half of the works that have a code by their file name."""
    return official_lines(filenames(spark, sf_dir).filter(F.col("sid") % 2 == 0)).drop("sid")


def official_lines(names: DataFrame) -> DataFrame:
    """A line of the list for each file name, behind the work's id."""
    return names.select("sid", F.concat(F.lit("第"), (1974 + F.col("sid") % 52 - 1960).cast("string"), F.lit("屆")).alias("屆次"), F.substring("filename", 12, 6).alias("作品編號"), pick(OFFICIAL, F.col("sid")).alias("名次"), F.lit("").alias("作品名稱"), F.lit("").alias("儲存檔名"))
