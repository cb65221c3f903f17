"""Sources: JSON lines, JSON objects and arrays, CSV, file listings, zip archives, pages of HTML."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from corvina import schemas
from corvina.functions import text as tx
from corvina.functions.python import unescape


def last_wins(rows: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """Of the rows of a key the last by the order given; an aggregation with partial sums, not a window."""
    rest = [c for c in rows.columns if c not in keys]
    picked = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return picked.select(*keys, "_r.*").select(*rows.columns)


def raw_records(spark: SparkSession, path: str) -> DataFrame:
    """The crawl log: titled rows, of each sid the line that stands last (by file, then place in it). Lines are numbered within
    the splits of a file in order, so the log may have any size."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    rows = lines.select("file", "block", "line", F.from_json("value", schemas.RAW).alias("r")).select("file", "block", "line", "r.*")
    return last_wins(rows.filter(F.coalesce("作品名稱", F.lit("")) != ""), ["sid"], "file", "block", "line").select(*schemas.RAW.names)


def patched(rows: DataFrame, patches: dict[int, dict[str, str]]) -> DataFrame:
    """Fields that are missing in single records, set from a table by sid."""
    for sid, fields in patches.items():
        for name, value in fields.items():
            rows = rows.withColumn(name, F.when((F.col("sid") == sid) & (F.coalesce(name, F.lit("")) == ""), value).otherwise(F.col(name)))
    return rows


def json_map(spark: SparkSession, path: str, value: str) -> DataFrame:
    """A file that is one JSON object, as (sid, value); value: the DDL of its values."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", f"map<string,{value}>")).alias("k", "value")).select(F.col("k").cast("long").alias("sid"), "value")


def json_array(spark: SparkSession, path: str | list[str], schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


#: Where a line stands: its file, the split of it, and the place in that.
PLACE = ("_file", "_block", "_line")


def csv(spark: SparkSession, path: str, schema: T.StructType, place: bool = False) -> DataFrame:
    """With a header; a byte order mark is skipped by the reader. place: with the columns PLACE, for tables of which the last line of a
    key counts."""
    rows = spark.read.schema(schema).option("header", True).option("encoding", "UTF-8").csv(path)
    if not place:
        return rows
    return rows.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_line"))


def last_line(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The last row of each key by place, if the rows have one, else by the order given."""
    return last_wins(rows, keys, *(PLACE if set(PLACE) <= set(rows.columns) else order)).drop(*PLACE)


def documents(spark: SparkSession, path: str, content: bool = False) -> DataFrame:
    """(path, name[, content]) of the PDF files below a folder, without those that begin with '._'."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.[pP][dD][fF]").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return files.withColumn("name", name).filter(~F.col("name").startswith("._")).select("path", "name", *["content"] * content)


def zip_entries(archives: DataFrame) -> DataFrame:
    """(path, name, content, error) of the entries of zip archives given as (path, content); names without the UTF-8
    flag are read as UTF-8 if they are. An archive or entry that can't be read is one row with an error."""

    def apply(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"], strict=True):
                rows = []
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        for e in z.infolist():
                            if e.is_dir():
                                continue
                            name = e.filename
                            if not e.flag_bits & 0x800:
                                try:
                                    name = name.encode("cp437").decode("utf-8")
                                except UnicodeError:
                                    pass
                            try:
                                rows.append((path, name, z.read(e), None))
                            except Exception as error:  # noqa: BLE001  one bad entry doesn't end the archive
                                rows.append((path, name, None, str(error)))
                except zipfile.BadZipFile as error:
                    rows.append((path, None, None, str(error)))
                yield pd.DataFrame(rows, columns=["path", "name", "content", "error"])

    return archives.select("path", "content").mapInPandas(apply, "path string, name string, content binary, error string")


def list_pages(n: Column, size: int = 10) -> Column:
    """Numbers of the pages that list n records."""
    return F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(n / size).cast("int")))


def listed(pages: DataFrame, html: str = "html") -> DataFrame:
    """(cat, sid) pairs that list pages link to."""
    link = F.lit(r"detail\.aspx\?a=\d+&(?:amp;)?cat=(\d+)&(?:amp;)?sid=(\d+)")
    both = F.arrays_zip(F.regexp_extract_all(html, link, F.lit(1)).alias("cat"), F.regexp_extract_all(html, link, F.lit(2)).alias("sid"))
    return pages.select(F.explode(both).alias("x")).select("x.cat", F.col("x.sid").cast("long").alias("sid")).distinct()


def record_pages(pages: DataFrame, sid: str = "sid", html: str = "html", file_link: str = r'href="(https://www\.ntsec\.edu\.tw/article/FileAtt\.ashx\?id=\d+)"') -> DataFrame:
    """Raw records (the schema RAW without error) from record pages: title, label and value paragraphs, abstract, files. Of
    labels that are repeated the last counts."""
    clean = lambda c: tx.html_text(c, unescape(F.regexp_replace(F.regexp_replace(c, r"<br\s*/?>", "\n"), "<[^>]+>", "")))
    pair = F.lit(r'(?s)<p class="title[^"]*">(.*?)</p>\s*<p[^>]*>(.*?)</p>')
    found = pages.select(
        F.col(sid).alias("sid"),
        clean(F.regexp_extract(html, r'(?s)sciencefair-title">.*?<p[^>]*>(.*?)</p>', 1)).alias("_title"),
        F.arrays_zip(F.regexp_extract_all(html, pair, F.lit(1)).alias("k"), F.regexp_extract_all(html, pair, F.lit(2)).alias("v")).alias("_pairs"),
        clean(F.regexp_extract(html, r'(?s)summary-movtivation[^>]*>.*?</h1>\s*<div class="article-content[^"]*">(.*?)</div>', 1)).alias("_abstract"),
        F.regexp_extract_all(html, F.lit(file_link), F.lit(1)).alias("_files"),
    )
    fields = found.select("sid", F.posexplode("_pairs").alias("at", "p")).select("sid", "at", clean(F.col("p.k")).alias("k"), clean(F.col("p.v")).alias("v"))
    by_label = last_wins(fields, ["sid", "k"], "at").groupBy("sid").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("_m"))
    labels = [n for n in schemas.RAW.names if n not in ("sid", "作品名稱", "摘要或動機", "檔案連結", "error")]
    out = found.join(by_label, "sid", "left")
    return out.select("sid", F.col("_title").alias("作品名稱"), *(F.try_element_at("_m", F.lit(n)).alias(n) for n in labels), F.col("_abstract").alias("摘要或動機"), F.col("_files").alias("檔案連結"))


def html_fields(pages: DataFrame, page_id: str = "page_id", html: str = "html") -> DataFrame:
    """Of any page: title, first heading, paragraphs and links, as text."""
    every = lambda pattern: F.regexp_extract_all(html, F.lit(pattern), F.lit(1))
    text = lambda c: tx.html_text(c)
    return pages.select(
        F.col(page_id).alias("page_id"),
        text(F.regexp_extract(html, r"(?s)<title[^>]*>(.*?)</title>", 1)).alias("title"),
        text(F.regexp_extract(html, r"(?s)<h1[^>]*>(.*?)</h1>", 1)).alias("heading"),
        F.transform(every(r"(?s)<p(?:\s[^>]*)?>(.*?)</p>"), text).alias("paragraphs"),
        every(r'<a\s[^>]*href="([^"]*)"').alias("links"),
    )
