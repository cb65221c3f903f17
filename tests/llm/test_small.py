"""Each operator on awkward rows: nulls, empty and long texts, ties, repeated rows, empty tables, extra columns."""

import pytest
from pyspark.sql import functions as F

from corvina.llm import decontamination, language_id, license_scan, line_dedup, quality_rules, quotation_links, sentencepiece_codec, simhash, suffix_dedup, warc
from corvina.llm.queries import model_path

LONG = " ".join(f"w{i % 997} and x{i}" for i in range(40_000))
ROWS = [(1, None, "en"), (2, "", None), (3, LONG, "en"), (4, "the same text and more of it", "en"), (4, "the same text and more of it", "en"), (5, "the same text and more of it", "de"), (None, "no id", None), (6, "\n \t\n", "fr"), (7, "\x00 \U0001f600 é\r\n|", "fr")]


def docs(spark, rows=ROWS):
    """With columns whose names the operators use themselves."""
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for name in ("score", "lang_pred", "fp", "th", "n_dropped", "keep", "component_id", "source", "key", "z", "a", "b", "_th", "doc", "root"):
        df = df.withColumn(name, F.lit("x"))
    return df


EMPTY: list[tuple] = []


def test_decontamination(spark):
    items = spark.createDataFrame([(1, "the same text and more of it"), (2, None), (3, ""), (4, "short"), (5, "the same text and more of it")], "item_id long, text string")
    out = {(r.doc_id, r.item_id, r.edits) for r in decontamination.contaminated(docs(spark), items).collect()}
    assert out == {(4, 1, 0), (5, 1, 0), (4, 5, 0), (5, 5, 0)}
    kept = decontamination.clean(docs(spark), items)
    assert kept.columns == docs(spark).columns and kept.count() == len(ROWS) - 3
    assert decontamination.contaminated(docs(spark, EMPTY), items).count() == 0
    assert decontamination.contaminated(docs(spark), items.limit(0)).count() == 0


@pytest.mark.parametrize("policy", ["threshold", "first"])
def test_line_dedup(spark, policy):
    out = line_dedup.dedup(docs(spark), policy=policy, min_docs=2)
    rows = {(r.doc_id, r.text, r._n_lines, r._n_dropped) for r in out.collect()}
    assert out.count() == len(ROWS) and (1, None, 1, 0) in rows and (2, "", 1, 0) in rows and (6, "\n \t\n", 3, 0) in rows
    # rows 4 are one document; 5 is another
    assert ((4, "", 1, 1) in rows) == (policy == "threshold") and (5, "", 1, 1) in rows
    assert line_dedup.dedup(docs(spark, EMPTY), policy=policy).count() == 0


def test_language_id(spark):
    pieces = language_id.vocabulary(model_path())
    text = {"en": "the house and the garden of the king", "fr": "le jardin et la maison du roi dans la ville"}
    languages, p = language_id.learn(docs(spark, [(i, text[g], g) for i in range(4) for g in text] + ROWS[:2]), pieces)
    assert languages == ["en", "fr"]
    tests = [(1, None, None), (2, "", None), (3, "1234 !!", None), (4, "The garden of the house", None), (5, "LA MAISON DU ROI", None), (6, "a" * 20_000, None), (None, "le roi", None), (8, "漢字", None)]
    out = language_id.identify(docs(spark, tests), pieces, languages, p)
    got = [(r.lang_pred, r.score) for r in out.collect()]
    assert [g for g, _ in got[:5]] == ["und", "und", "und", "en", "fr"] and got[6][0] == "fr" and all(0 <= s <= 1 for _, s in got)
    assert language_id.learn(docs(spark, EMPTY), pieces)[0] == []
    assert {r.lang_pred for r in language_id.identify(docs(spark), pieces, *language_id.learn(docs(spark, EMPTY), pieces)).collect()} == {"und"}


def test_license_scan(spark):
    out = license_scan.scan(docs(spark, [*ROWS, (8, "x " * 500 + "\nReleased under the MIT License.\n" + "y " * 500, None), (9, license_scan.TEMPLATES[0][1].lower().replace(",", ""), None), (10, license_scan.TEMPLATES[0][1][:200], None), (11, "Licensed under CC BY-NC 4.0.", None)]))
    got = [r.license for r in out.collect()]
    assert got == [None] * len(ROWS) + ["MIT", "MIT", None, "CC-BY-NC-4.0"]
    assert license_scan.scan(docs(spark, EMPTY)).count() == 0


def test_sentencepiece(spark):
    out = sentencepiece_codec.encode(docs(spark), model_path()).collect()
    assert [r.decoded for r in out] == [t or "" for _, t, _ in ROWS] and [r.ids for r in out[:2]] == [[2], [2]]
    assert sentencepiece_codec.encode(docs(spark, EMPTY), model_path()).count() == 0


def test_simhash(spark):
    out = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(docs(spark)).collect()}
    assert {(4, 4), (5, 4), (1, 1), (2, 1), (6, 1), (3, 3), (7, 7)} <= out
    kept = simhash.representatives(docs(spark))
    assert kept.columns == docs(spark).columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 3, 4, 7]
    assert simhash.near_duplicates(docs(spark, EMPTY)).count() == 0 and simhash.representatives(docs(spark, EMPTY)).count() == 0


def test_warc(spark, tmp_path):
    rows = [(1, "http://a/ b\n", "x"), (2, None, "x"), (3, "u", None), (4, "u", ""), (4, "u", ""), (None, "n", "x"), (5, "é", LONG), (6, "v", "\r\n\r\nWARC/1.1")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("refers_to", F.lit("x")).withColumn("key", F.lit(1))
    out = warc.round_trip(pages, folder=str(tmp_path / "w"))
    got = sorted((r.page_id or 0, r.record_type, r.refers_to or 0, r.payload_bytes, r.status) for r in out.collect())
    assert got == [(0, "revisit", 1, 1, "ok"), (1, "response", 0, 1, "ok"), (2, "revisit", 1, 1, "ok"), (3, "response", 0, 0, "ok"), (4, "revisit", 3, 0, "ok"), (4, "revisit", 3, 0, "ok"), (5, "response", 0, len(LONG), "ok"), (6, "response", 0, 12, "ok")]
    big = warc.round_trip(pages, folder=str(tmp_path / "v"), min_bytes=2)
    assert {r.record_type for r in big.collect()} == {"response"}
    assert warc.round_trip(pages.limit(0), folder=str(tmp_path / "e")).count() == 0


def test_quality_rules(spark):
    rows = {r.doc_id: r for r in quality_rules.judge(docs(spark)).collect()}
    assert rows[1].n_words == rows[2].n_words == 0 and rows[1].base_failed and not rows[1].kept
    assert rows[3].n_words == 120_000 and not rows[3].base_failed
    assert rows[7].n_symbols == 1
    assert quality_rules.judge(docs(spark, EMPTY)).count() == 0
    assert quality_rules.judge(docs(spark, [(1, "a b", None)])).count() == 1


def test_quotation_links(spark):
    rows = [
        (1, 0, "user", "How do I bake a good loaf of bread?"),
        (1, 1, "assistant", "Use more water and wait longer than you think.\n\nAlso weigh everything."),
        (1, 2, "user", "Ann wrote:\n> Use  MORE water and wait longer than you think.\n>\n> Also weigh everything.\n>> How do I bake a good loaf of bread?\nHow much water?"),
        (2, 0, "user", "> How do I bake a good loaf of bread?\nSame question here, thanks."),
        (2, 1, "user", ">> not found anywhere at all\nok"),
        (3, 0, None, None), (None, 1, "user", "> x"), (3, 0, None, None), (4, 5, "user", "> Same question here, thanks.\n" * 2 + "z"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("own", F.lit(1)).withColumn("hash", F.lit(1))
    out = {(r.conv_id, r.turn): r for r in quotation_links.link(df).collect()}
    assert quotation_links.link(df).count() == len(rows)
    assert (out[1, 2].parent_conv, out[1, 2].parent_turn, out[1, 2].text, out[1, 2].n_quoted) == (1, 1, "How much water?", 2)
    assert (out[2, 0].parent_conv, out[2, 0].parent_turn, out[2, 0].root_conv) == (1, 0, 1)
    assert out[2, 1].parent_conv is None and out[2, 1].root_conv == 2 and out[2, 1].text == "ok"
    # a chain of links over three conversations ends at its first
    assert (out[4, 5].parent_conv, out[4, 5].root_conv, out[4, 5].root_turn) == (2, 1, 0)
    assert out[None, 1].root_conv is None and out[3, 0].text == ""
    assert [r.turn for r in quotation_links.ordered(quotation_links.link(df)).filter("root_conv = 1").collect()] == [0, 1, 2, 0, 5]
    assert quotation_links.link(df.limit(0)).count() == 0


def test_suffix_dedup(spark):
    part = "".join(chr(97 + i * 7 % 26) + chr(65 + i * i % 26) for i in range(150))
    rows = [*ROWS, (10, "left " + part + " right", None), (11, part, None), (12, "a" * 5000, None), (13, "é" * 150, None), (14, "é" * 150, None)]
    out = {r.doc_id: r for r in suffix_dedup.dedup(docs(spark, rows)).collect()}
    assert (out[11].n_removed, out[10].kept, out[12].n_removed, out[13].n_removed) == (300, b"left  right", 5000, 300)
    assert out[1].n_bytes == out[1].n_removed == 0 and out[5].n_removed == 0
    assert suffix_dedup.dedup(docs(spark, EMPTY)).count() == 0
