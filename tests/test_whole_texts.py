"""Queries on full text read every text to its end."""

from corvina.operators import fulltext
from corvina.plans import queries

LONG = " ".join(f"word{i}" for i in range(900))


def documents(spark, tmp_path, texts):
    rows = [(i, t, "en", "web", len(t)) for i, t in texts]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_papers_hold_whole_texts(spark):
    key = "sk-" + "a1" * 12
    w = spark.createDataFrame([(1, LONG), (2, LONG + " 王大明 " + key)], "id long, abstract string")
    papers = queries.papers(w)
    found = {r.sid: "".join(s.text for s in r.secs) for r in fulltext.extracted(papers).collect()}
    headings = ("壹、研究動機\n", "\n貳、研究目的\n", "\n參、研究設備及器材\n", "\n肆、研究方法\n- 3 -\n", "\n伍、研究結果與討論\n", "\n陸、結論\n")
    for r in papers.collect():
        bare = r.text.split("\n\n", 1)[1]
        for h in headings:
            bare = bare.replace(h, "")
        assert bare.startswith(LONG)
    # all sections but the first, as motives are no kind of section
    assert all(len(found[i]) >= 0.8 * len(LONG) for i in (1, 2))
    assert key in found[2]
    (out,) = fulltext.redacted(fulltext.extracted(papers), spark.createDataFrame([(2, "王大明")], "sid long, authors string"), 100_000).filter("sid = 2").collect()
    assert out.named and out.secrets == 1
    body = "".join(s.t for s in out.secs)
    assert key not in body and "王大明" not in body


def test_sections_of_long_papers_are_trimmed(spark):
    w = spark.createDataFrame([(1, LONG * 5)], "id long, abstract string")
    (row,) = fulltext.report(fulltext.extracted(queries.papers(w))).collect()
    assert 11_000 <= row.site_chars <= 12_100


def test_glyph_pages_stand_next_to_whole_texts(spark, tmp_path):
    out = {r.sid: r.text for r in queries.QUERIES["glyph_repair"](spark, documents(spark, tmp_path, [(1, LONG), (2, LONG)])).collect()}
    assert LONG in out[1] and LONG in out[2]
    assert "的，是在的水中實驗。" in out[2]
