"""The pipeline's stages: decisions take effect, clean documents stay."""

import duckdb
from pyspark.sql import functions as F

import corpus_pipeline
from corvina.llm import line_dedup, sentencepiece_codec
from corvina.llm.queries import model_path

DIR = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DIR).cache()
        out[name] = docs
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    assert all(out[n].columns == columns for n in ("language", "lines", "near_copies", "benchmark"))
    n = {k: v.count() for k, v in out.items()}
    assert n["language"] == n["lines"] >= n["near_copies"] >= n["benchmark"] == n["pieces"] > 0.7 * n["language"]
    # exact copies: one of each stays
    texts = [r.text for r in out["near_copies"].select("text").collect()]
    assert len(texts) == len(set(texts))
    # no benchmark item is left
    items = [r[0].lower() for r in duckdb.sql(f"select text from '{DIR}/benchmark.parquet'").fetchall()]
    assert not any(i in r.text.lower() for r in out["benchmark"].select("text").collect() for i in items)
    # a line that ten documents have is gone
    assert line_dedup.drops(out["language"]).count() > 0
    assert corpus_pipeline.run(spark, DIR).count() == n["pieces"]
    made = {r.doc_id: r.ids for r in sentencepiece_codec.encode(out["benchmark"], model_path()).collect()}
    assert {r.doc_id: r.n_tokens for r in out["pieces"].collect()} == {k: len(v) for k, v in made.items()}


EN, FR = "the house and the garden of the king in the old town", "le jardin et la maison du roi dans la vieille ville"
ROWS = [(1, EN, "en"), (2, FR, "fr"), (3, None, "en"), (4, "", None), (5, EN + " today", None), (5, EN + " today", None), (None, "the king of the town", None), (6, "12 34", "en"), (7, "the garden " * 20_000, "en"), *((i, f"the same line\nthe {i} of the king", "en") for i in range(10, 22))]
OWN = ("score", "lang_pred", "_n_lines", "_n_dropped", "_z", "_k", "_h", "sig", "root", "n", "u", "codes", "key", "c", "d", "alone")


def test_stages_keep_columns_of_any_name(spark):
    """Nulls, empty and long texts, repeated rows, and columns that are called like the operators' own."""
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, lang string").withColumns({c: F.col("doc_id") * 2 for c in OWN})
    stayed = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DIR)
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert all(r[c] == (None if r.doc_id is None else 2 * r.doc_id) for r in rows for c in OWN), name
        stayed[name] = sorted((r.doc_id or 0) for r in rows)
    ids = sorted((i or 0) for i, _, _ in ROWS)
    assert stayed["lines"] == stayed["benchmark"] == ids
    assert stayed["language"] == [i for i in ids if i not in (3, 4, 6)]
    # 3 and 4 are alike, and both rows of 5 are like 1: 8 of 9 shingles
    assert stayed["near_copies"] == [i for i in ids if i not in (4, 5)]
    assert corpus_pipeline.STAGES[-1][1](spark, docs, DIR).count() == len(ROWS)


def test_stages_on_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long, score long")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, DIR).count() == 0, name
