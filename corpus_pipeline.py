"""A pipeline over documents: language ID, line dedup, near-dedup by word shingles, benchmark decontamination, SentencePiece coding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corvina.llm import decontamination, language_id, line_dedup, sentencepiece_codec
from corvina.llm import near_copies as shingled
from corvina.llm.common import cut, table
from corvina.llm.queries import model_path


def aside(docs: DataFrame, *used: str) -> DataFrame:
    """docs with the columns that a stage doesn't use under names that no operator gives, so that theirs replace none of them."""
    return docs.toDF(*(c if c in used else f"_own{i}" for i, c in enumerate(docs.columns)))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learned languages stay: those without a letter (null and empty texts too) and those whose best language
    has less than half of the likelihood go. The model is learned from the labelled documents; without any, and from an empty table,
    nothing stays. Rows that repeat are judged alike, texts read whole, other columns kept whatever they are called."""
    own = aside(docs, "doc_id", "text", "lang")
    pieces = language_id.vocabulary(model_path())
    languages, p = language_id.learn(own, pieces)
    found = language_id.identify(own, pieces, languages, p).filter("lang_pred <> 'und' and score >= 0.5")
    return found.select(*own.columns).toDF(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that at least ten documents have are dropped; every row stays, null texts as they are and others perhaps empty. Rows of one id
    are one document. Texts are read whole, other columns kept whatever they are called; an empty table stays empty."""
    own = aside(docs, "doc_id", "text")
    return line_dedup.dedup(own, min_docs=10, min_chars=1).select(*own.columns).toDF(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 or more over five-word shingles the one with the least id stays (null ids come
    last; null and empty texts are alike; of rows equal in id and text one stays). All columns are kept; an empty table stays empty."""
    return shingled.representatives(docs, words=5, similarity=0.8)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, with few edits, go; null and empty texts, and all columns, stay as they are. Rows that repeat
    go or stay together; without items nothing goes, and an empty table stays empty."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each row's whole text; null is empty, which has the end id only. Rows that repeat
    have a result each; an empty table has none."""
    return sentencepiece_codec.digests(sentencepiece_codec.encode(docs, model_path()))


STAGES = [("language", language), ("lines", lines), ("near_copies", near_copies), ("benchmark", benchmark), ("pieces", pieces)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
