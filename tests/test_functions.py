"""The rules on single values, against vectors derived by hand."""

import re

import pytest
from pyspark.sql import functions as F

from corvina import rules
from corvina.functions import records as R
from corvina.functions import text as T
from corvina.functions.python import nfkc, ratio, unescape
from corvina.operators import fulltext


def values(spark, rows, make, kind="string"):
    df = spark.createDataFrame(list(enumerate(rows)), f"i int, x {kind}")
    return [r.v for r in df.select("i", make(F.col("x")).alias("v")).orderBy("i").collect()]


def test_award(spark):
    vectors = [
        ("第一名;團體合作獎", ("第一名", ["團隊合作獎"], [])),
        ("佳作 (鄉土)教材獎", ("佳作", ["最佳鄉土教材獎"], [])),
        ("最佳(鄉土)教材獎", (None, ["最佳鄉土教材獎"], [])),
        ("一等獎；美國代表;未得獎作品", ("一等獎", [], ["美國代表"])),
        ("未得獎作品、第三名", ("第三名", [], [])),
        ("無", ("未得獎", [], [])),
        ("", (None, [], [])),
        (None, (None, [], [])),
        ("第二名 第一名", ("第二名", [], [])),
    ]
    assert [tuple(x) for x in values(spark, [a for a, _ in vectors], R.award)] == [b for _, b in vectors]


def test_award_class(spark):
    assert values(spark, ["第一名", "佳作", "特別獎", "未得獎", "別的", None], R.award_class) == ["top", "merit", "merit", "none", None, None]


def test_keywords_and_people(spark):
    assert values(spark, ["光合作用 葉綠素", "solar cell", "蚵殼/吸附/蚵殼", " 。", None], T.keywords) == [["光合作用", "葉綠素"], ["solar cell"], ["蚵殼", "吸附"], [], []]
    assert values(spark, ["王大明；李小華", " a ,, b", None], T.people) == [["王大明", "李小華"], ["a", "b"], []]


def test_year_and_edition(spark):
    assert values(spark, ["第56屆--民國105年", "2020", "", None], T.year_of) == [2016, 2020, None, None]
    assert values(spark, ["第56屆--民國105年", "2020", None], T.edition_of) == [56, None, None]


def test_city(spark):
    schools = ["台北縣立板橋高級中學", "國立臺灣師範大學附屬高級中學", "臺南一中", "", None, "高雄市立三民國小"]
    assert values(spark, schools, R.city) == ["新北市", "臺北市", "臺南市", None, None, "高雄市"]


def test_school_stage(spark):
    assert values(spark, ["臺北市立大同高級中學(國中部)", "國立清華大學", "臺中高工", "某國小", "x", None], R.school_stage) == ["國中", "大學", "高職", "國小", None, None]


def test_text(spark):
    assert values(spark, [None, "\\r a\x00b 　", " x "], T.txt) == ["", "ab", "x"]
    assert values(spark, ["奈米-銀_粒子 2.0"], T.title_key) == ["奈米銀粒子20"]
    assert values(spark, ["台ＡＢ", None], T.search_norm) == ["臺ab", ""]
    assert values(spark, ["自動化abc實驗 ab-1 甲"], T.tokens) == [["自動", "動化", "實驗", "abc", "ab-1"]]
    assert values(spark, ["aXaXaXaXa", "", None], lambda c: T.occurrences(c, "aX", 3)) == [3, 0, 0]
    assert values(spark, ["<p>a<br/>b &amp; c</p>"], T.html_text) == ["a\nb & c"]
    assert values(spark, ["<a&\"'>"], T.html_escape) == ["&lt;a&amp;&quot;&#39;&gt;"]
    assert values(spark, ["a/b:c*?d", "x" * 99, None], T.safe_name) == ["a_b_c_d", "x" * 80, ""]
    assert values(spark, ["attachment; filename=x.pdf", None], T.header_filename) == ["x.pdf", ""]


def tidy(text):
    """The rule in Python: page numbers, degrees, blanks, line breaks between Chinese characters, blank lines."""
    text = re.sub(r"(?m)^\s*(第\s*\d+\s*頁|[-–—]?\s*\d{1,3}\s*[-–—]?)\s*$", "", text)
    text = re.sub(r"(\d)\s*\n?\s*o\s*\n?\s*C\b", r"\1°C", text)
    text = re.sub("(?<=[一-鿿，、；：（）「」])\n(?=[一-鿿，、；：（）「」])", "", re.sub("[ \t　]+", " ", text))
    return re.sub("\n{3,}", "\n\n", text).strip()


def test_paragraphs_agree_with_the_section_parser(spark):
    texts = ["甲\n12\n乙", "溫度 25\no\nC 時", "中文，\n文字", "a\n\n\n\nb", "第 3 頁\n字", "  x  y　z "]
    assert values(spark, texts, T.paragraphs) == [tidy(t) for t in texts]


def test_mode_takes_the_first_of_equals(spark):
    assert values(spark, [["A", "B", "B", "A"], ["C"], [], ["A", "C", "C", "C"]], T.mode_of, "array<string>") == ["A", "C", None, "C"]


def test_filename(spark):
    names = ["第15屆_國小教師組_物理_佳作_15_088_磁鐵（國小教師組）.pdf", "第56屆_國中組_化學科_第一名_030201_銀粒子.pdf", "other.pdf"]
    assert [x and tuple(x) for x in values(spark, names, R.filename)] == [(15, "國小教師組", "088", "磁鐵"), (56, "國中組", "030201", "銀粒子"), None]


def test_udfs(spark):
    assert values(spark, ["ＡＢ①", None], nfkc) == ["AB1", None]
    assert values(spark, ["&eacute;&amp;", None], unescape) == ["é&", None]
    assert values(spark, ["abcd", "", None], lambda c: ratio(c, F.lit("abxd"))) == [pytest.approx(0.75), 0.0, None]


def test_redaction(spark):
    assert values(spark, ["key sk-abcdefghij0123456789", "x" * 50], fulltext.without_secrets) == ["key 〔已移除疑似金鑰〕", "x" * 50]
    names = fulltext.author_names(F.lit("王大;王大明、李"))
    assert values(spark, ["王大明與王大"], lambda c: fulltext.without_names(c, names)) == ["〔作者〕與〔作者〕"]
    once = values(spark, ["王大明 ghp_0123456789abcdef01"], lambda c: fulltext.without_secrets(fulltext.without_names(c, names)))
    assert values(spark, once, lambda c: fulltext.without_secrets(fulltext.without_names(c, names))) == once


def test_lists_have_their_sizes():
    assert (len(rules.RANKS), len(rules.CITIES), len(rules.TOWNS), len(rules.SHORT_CITIES), len(rules.FIELDS)) == (17, 22, 34, 17, 11)
