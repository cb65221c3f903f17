"""Schemas of the datasets. Readers are always given one, so that keys that are missing become null."""

import re

from pyspark.sql import types as T


TYPES = {"long": T.LongType(), "int": T.IntegerType(), "string": T.StringType()}


def of(fields: str) -> T.StructType:
    """From 'name type, ...'; a type is one of TYPES, array<type> or rows<name:type,...>. Needs no session."""
    out = T.StructType()
    for field in re.split(r",\s+", fields):
        name, kind = field.split(" ", 1)
        if kind.startswith("rows<"):
            kind = T.ArrayType(of(", ".join(x.replace(":", " ") for x in kind[5:-1].split(","))))
        elif kind.startswith("array<"):
            kind = T.ArrayType(TYPES[kind[6:-1]])
        out.add(name, kind if isinstance(kind, T.DataType) else TYPES[kind])
    return out


RAW = of("sid long, 作品名稱 string, 科展類別 string, 屆次 string, 科別 string, 得獎情形 string, 學校名稱 string, 指導老師 string, 作者 string, 關鍵字 string, 摘要或動機 string, 檔案連結 array<string>, error string")
GROUPS = of("sid long, groups array<string>")
FILENAMES = of("sid long, filename string")
CODES = of("sid long, code string, grp string, file string")
OFFICIAL = of("屆次 string, 作品編號 string, 名次 string, 作品名稱 string, 儲存檔名 string")
SUBJECTS = of("來源 string, 原始科別 string, 標準領域 string")
SECTIONS = of("sid long, secs rows<h:string,k:string,text:string>")
SITE_SECTIONS = of("sid long, secs rows<h:string,t:string>")
PAGES = of("sid long, pages array<string>")
WORKS = of(
    "id long, src string, type string, title string, edition string, edition_no int, year int, subject string, domains array<string>, award_raw string, "
    "rank string, special array<string>, rep array<string>, school string, city string, teachers array<string>, keywords array<string>, abstract string, "
    "pdf string, code string, url string, stage string, stage_src string, stage_detail string, award_src string, related array<long>"
)
