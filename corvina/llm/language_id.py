"""Language identification by segmentation-marginalised unigrams.

For every language the pieces of a fixed public vocabulary have probabilities. The likelihood of a text is the sum over
all of its segmentations into pieces, which a forward algorithm gives; as pieces don't cross white space, it is the
product over the text's marked words, and each distinct word is scored once for a task and kept in a bounded table.

Words are the runs of letters of the lower-cased text. Probabilities come from a few rounds of expectation
maximisation over the words of a bounded sample: the ``SAMPLE`` labelled texts of each language (identical rows count once) with
the least hash of id and text. That bound is the only one: all words of these texts count, their expected uses of pieces
are summed by the tasks, and the driver holds what the model itself is, a number for each piece and language. Words of more
than ``LONG`` letters are taken apart after every LONG letters for the fitting (not for scoring). Sums along a word are
rescaled as they go, so that no word is too long or too unlikely. Everything but the fitting covers all data.

Null texts and texts without a letter: ``und`` with score 0. Ties go to the language first in alphabetical order. If no
labelled row is left to learn from, every text is ``und``. Rows that repeat get one result each, null ids are ids like others.
Texts of any length are read whole; empty tables give empty results; columns named like the results are replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvina.llm.common import cut

SAMPLE, ROUNDS, SALTS = 400, 3, 8
MARK = "▁"
LETTERS = re.compile(r"[^\W\d_]+")
#: What a character that no piece covers counts; characters at most that the array code takes; words in a task's table.
UNKNOWN, LONG, ENTRIES = 1e-6, 40, 300_000
#: Letters after which sums along a word are rescaled; words that are gone through together.
RESCALE, WORDS = 8, 20_000
#: Bytes of text that are scored together.
TOGETHER = 1 << 20


def words_of(text: str | None) -> list[str]:
    return LETTERS.findall(text.lower()) if text else []


class Lattice:
    """The arcs of words of equal length, as arrays of piece numbers; 0 is no piece."""

    def __init__(self, pieces: list[str]):
        self.number = {p: i + 1 for i, p in enumerate(pieces)}
        self.widest = max(map(len, pieces), default=1)
        self.size = len(pieces) + 1

    def arcs(self, words: list[str]) -> Iterator[tuple[int, int, np.ndarray]]:
        """(start, end, piece numbers); single characters without a piece get number ``size``."""
        get, length = self.number.get, len(words[0])
        for end in range(1, length + 1):
            for start in range(max(0, end - self.widest), end):
                ids = np.fromiter((get(w[start:end], 0) for w in words), np.int32, len(words))
                if end - start == 1:
                    ids[ids == 0] = self.size
                if ids.any():
                    yield start, end, ids

    def forward(self, arcs: Iterable, n: int, length: int, p: np.ndarray) -> np.ndarray:
        """Natural logarithm of the sum over all segmentations, by word and language."""
        alpha, scale, done = np.zeros((length + 1, n, p.shape[1])), np.zeros((n, p.shape[1])), 0
        alpha[0] = 1
        for start, end, ids in arcs:
            if end > done + RESCALE:
                last, first = alpha[end - 1].copy(), max(0, end - self.widest)
                alpha[first:end] /= last
                scale += np.log(last)
                done = end - 1
            alpha[end] += alpha[start] * p[ids]
        return np.log(alpha[length]) + scale

    def counts(self, words: dict[str, np.ndarray], p: np.ndarray) -> np.ndarray:
        """Expected uses of each piece by language; words: counts by language. Sums are kept as logarithms."""
        total, by = np.zeros_like(p), {}
        for w in words:
            by.setdefault(len(w), []).append(w)
        for length, group in by.items():
            arcs, weight = list(self.arcs(group)), np.array([words[w] for w in group], float)
            alpha, beta = np.zeros((2, length + 1, len(group), p.shape[1]))
            for end, some in groupby(arcs, lambda x: x[1]):
                one = alpha[end - 1]
                alpha[end] = one + np.log(sum(np.exp(alpha[start] - one) * p[ids] for start, _, ids in some))
            for start, some in groupby(sorted(arcs, key=lambda x: -x[0]), lambda x: x[0]):
                one = beta[start + 1]
                beta[start] = one + np.log(sum(np.exp(beta[end] - one) * p[ids] for _, end, ids in some))
            for start, end, ids in arcs:
                np.add.at(total, ids, np.exp(alpha[start] + beta[end] - alpha[length]) * p[ids] * weight)
        total[0] = 0
        return total

    def score(self, words: list[str], p: np.ndarray) -> np.ndarray:
        """Natural logarithm of each word's likelihood by language."""
        out, by = np.zeros((len(words), p.shape[1])), {}
        for i, w in enumerate(words):
            by.setdefault(len(w), []).append(i)
        for length, rows in by.items():
            if length <= LONG:
                group = [words[i] for i in rows]
                out[rows] = self.forward(self.arcs(group), len(group), length, p)
            else:
                for i in rows:
                    out[i] = self.long(words[i], p)
        return out

    def long(self, word: str, p: np.ndarray) -> np.ndarray:
        """One word of any length, in memory that doesn't grow with it: the last sums are kept, rescaled at each step."""
        last, scale = [np.ones(p.shape[1])], np.zeros(p.shape[1])
        for end in range(1, len(word) + 1):
            now = np.zeros(p.shape[1])
            for back in range(1, min(len(last), self.widest) + 1):
                i = self.number.get(word[end - back : end], self.size if back == 1 else 0)
                if i:
                    now += last[-back] * p[i]
            last = [x / now for x in last[-self.widest + 1 :]] + [np.ones_like(now)]
            scale += np.log(now)
        return scale


def vocabulary(model_path: str) -> list[str]:
    """The distinct pieces of lower-cased letters of a SentencePiece model, with or without a marker before them."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
    ordinary = (sp.id_to_piece(i).lower() for i in range(sp.vocab_size()) if not (sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i)))
    return sorted({p for p in ordinary if LETTERS.fullmatch(p.removeprefix(MARK) or "1")} | {MARK})


def sampled(docs: DataFrame, doc_id: str, text: str, lang: str, sample: int) -> DataFrame:
    """(lang, text): the rows of each language with the least hash of id and text. A language is ranked in SALTS parts first,
    each by its tasks, so no task gets more than a few rows of any."""
    rows = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang"), F.xxhash64(F.col(doc_id), F.col(text)).alias("h")).filter("text is not null and lang is not null")
    rank = lambda *by: F.dense_rank().over(Window.partitionBy(*by).orderBy("h"))
    least = rows.select("lang", "h", (F.spark_partition_id() % SALTS).alias("salt")).withColumn("n", rank("lang", "salt")).filter(F.col("n") <= sample).select("lang", "h", "salt").distinct()
    least = least.withColumn("n", rank("lang")).filter(F.col("n") <= sample)
    last = cut(least.groupBy("lang").agg(F.max("h").alias("last")))
    # a row for each language, as the model has
    return rows.join(F.broadcast(last), "lang").filter("h <= last").dropDuplicates(["lang", "h"]).select("lang", "text")


def learn(docs: DataFrame, pieces: list[str], doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE, rounds: int = ROUNDS) -> tuple[list[str], np.ndarray]:
    """Languages in alphabetical order, and probabilities by piece number and language, from the labelled rows given."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t, g in zip(b.column(1), b.column(0).to_pylist(), strict=True):
                n = Counter(MARK + w[at : at + LONG] if not at else w[at : at + LONG] for w in words_of(t.as_py()) for at in range(0, len(w), LONG))
                yield pa.RecordBatch.from_arrays([pa.array([g] * len(n), pa.string()), pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], ["lang", "word", "n"])

    found = sampled(docs, doc_id, text, lang, sample).mapInArrow(words, "lang string, word string, n long")
    found = cut(found.groupBy("word", "lang").agg(F.sum("n").alias("n")))
    languages = sorted(r.lang for r in found.select("lang").distinct().collect())  # a row for each
    p = np.full((len(pieces) + 2, len(languages)), 1 / len(pieces))
    if not languages:
        return [], p
    sent = docs.sparkSession.sparkContext.broadcast((pieces, languages))
    for _ in range(rounds):
        p[0], p[-1] = 0, UNKNOWN
        now = docs.sparkSession.sparkContext.broadcast(p)

        def expected(batches: Iterator[pa.RecordBatch], now: Broadcast = now) -> Iterator[pa.RecordBatch]:
            lattice, at = Lattice(sent.value[0]), {g: i for i, g in enumerate(sent.value[1])}
            total = np.zeros_like(now.value)
            for b in batches:
                for start in range(0, b.num_rows, WORDS):
                    own: dict[str, np.ndarray] = {}
                    for g, w, n in zip(*(c.to_pylist() for c in b.slice(start, WORDS).columns), strict=True):
                        own.setdefault(w, np.zeros(len(at)))[at[g]] += n
                    total += lattice.counts(own, now.value)
            piece, language = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(piece), pa.array(language), pa.array(total[piece, language])], ["piece", "language", "n"])

        c = np.zeros_like(p)
        made = found.select("lang", "word", "n").mapInArrow(expected, "piece long, language long, n double")
        made = made.groupBy("piece", "language").agg(F.sum(F.col("n").cast("decimal(38,9)")).cast("double").alias("n")).toArrow()  # a model's size
        c[made["piece"].to_numpy(), made["language"].to_numpy()] = made["n"].to_numpy()
        c = c[1:-1] + 0.01
        p[1:-1] = c / c.sum(0)
    p[0], p[-1] = 0, UNKNOWN
    return languages, p


class Scorer:
    def __init__(self, pieces: list[str], languages: list[str], p: np.ndarray):
        self.lattice, self.languages, self.p = Lattice(pieces), languages, p
        self.table, self.scores = {}, np.zeros((ENTRIES, len(languages)))

    def look_up(self, words: list[str]) -> np.ndarray:
        """The words' log likelihoods by language. New words are scored together."""
        new = set(words).difference(self.table)
        if len(self.table) + len(new) > ENTRIES:
            self.table, new = {}, set(words)
        table, scores = self.table, self.scores
        if new:
            new = list(new)
            made = self.lattice.score([MARK + w for w in new], self.p)
            made[[not any(map(str.isalpha, w)) for w in new]] = 0
            if len(new) > ENTRIES:  # for these words only
                table, scores = {}, made
            start = len(table)
            table.update(zip(new, range(start, start + len(new)), strict=True))
            scores[start : start + len(new)] = made
        return scores[np.fromiter(map(table.__getitem__, words), np.int64, len(words))]

    def score(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        names, best = ["und"] * len(texts), np.zeros(len(texts))
        words = [words_of(t) for t in texts]
        rows = [k for k, w in enumerate(words) if w]
        if not self.languages or not rows:
            return names, best
        sizes = [len(words[k]) for k in rows]
        total = np.add.reduceat(self.look_up([x for w in words for x in w]), np.cumsum([0, *sizes[:-1]]), axis=0)
        odds = np.exp(total - total.max(1, keepdims=True))
        for k, t, o in zip(rows, total, odds, strict=True):
            if t.any():  # else there is no letter
                names[k], best[k] = self.languages[int(t.argmax())], 1 / o.sum()
        return names, best


def identify(docs: DataFrame, pieces: list[str], languages: list[str], p: np.ndarray, text: str = "text") -> DataFrame:
    """docs with the columns ``lang_pred`` and ``score`` behind its own (which replace columns of these names). No shuffle."""
    docs = docs.drop("lang_pred", "score")
    at = docs.columns.index(text)
    model = docs.sparkSession.sparkContext.broadcast((pieces, languages, p))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*model.value)
        for b in batches:
            names, best, start, size = [], [], 0, 0
            for end, n in enumerate(pc.binary_length(b.column(at)).fill_null(0).to_pylist(), 1):
                size += n
                if size > TOGETHER or end == b.num_rows:
                    x, y = scorer.score(b.column(at).slice(start, end - start).to_pylist())
                    names += x
                    best.append(y)
                    start, size = end, 0
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(names, pa.string()), pa.array(np.concatenate(best) if best else [], pa.float64())], [*b.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(apply, docs.withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0)}).schema)
