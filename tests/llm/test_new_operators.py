"""Hard negatives, the hidden Markov model and fill-in-the-middle next to brute force and SQL."""

import math
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from corvina.llm import fill_in_middle, hard_negatives, hidden_markov
from corvina.llm.queries import oracle_sql, queries

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op13_fill_in_middle"])
def test_agrees_with_sql(spark, name):
    con = duckdb.connect()
    for t in ("embeddings", "documents"):
        con.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    theirs = con.sql(oracle_sql()[name])
    mine = queries()[name](spark, DIR).select(*theirs.columns)
    rows = sorted(map(repr, map(tuple, mine.collect())))
    assert rows == sorted(map(repr, theirs.fetchall())) and rows


def mined(rows, positives=5, negatives=3):
    """Brute force over (id, label, v)."""
    r = [(i, y, [math.floor(256 * x) for x in v]) for i, y, v in rows if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = set()
    for i, y, v in (x for x in r if x[0] % 50 == 0):
        ranked = sorted((-dot(v, w), j, z) for j, z, w in r)
        for s, p, _ in [x for x in ranked if x[2] == y and x[1] != i][:positives]:
            found = [x for x in ranked if x[2] != y and -50 * s <= -100 * x[0] <= -95 * s][:negatives]
            out |= {(i, p, k + 1, n, -s, -t) for k, (t, n, _) in enumerate(found)}
    return out


@pytest.mark.parametrize(("per_block", "per_group"), [(4096, 16_384), (50, 3)])
def test_hard_negatives(spark, per_block, per_group):
    rng = np.random.default_rng(3)
    v = rng.normal(0, 0.2, (600, 7)).round(2)
    v[100:300] = v[100]  # one vector holds a third of the rows
    rows = [(i, int(y), x.tolist()) for i, (y, x) in enumerate(zip(rng.integers(0, 3, 600), v, strict=True))]
    rows += [(1000, None, [1.0]), (None, 1, [1.0]), (1050, 1, None), (1100, 1, [None, 1.0]), (1150, 1, [math.nan]), (1200, 2, [math.inf, 0.0]), (1250, 1, []), (1300, 1, [0.5, -0.5]), (1350, 9, [9e9, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumn("u", F.lit("x")).withColumn("block", F.lit("x"))
    held = [(i, y, None if v is None else [x if x is None or not math.isfinite(x) else min(x, 2**20) for x in v]) for i, y, v in rows]
    out = hard_negatives.mine(df, F.col("id") % 50 == 0, per_block=per_block, per_group=per_group)
    assert {tuple(r) for r in out.collect()} == mined(held)
    assert hard_negatives.mine(df.limit(0), F.col("id") % 50 == 0).count() == 0


def test_few_rows_are_scored_exactly():
    rng = np.random.default_rng(4)
    v = np.floor(256 * rng.normal(0, 0.125, (4000, 64))).astype(np.int64)
    low = np.sort(np.quantile(v, np.arange(hard_negatives.CELLS) / hard_negatives.CELLS, axis=0, method="lower").T.astype(np.int64), 1)
    high = np.concatenate([low[:, 1:] - 1, v.max(0)[:, None]], 1)
    block = hard_negatives.Block(np.arange(4000), np.arange(4000) % 10, v, low, np.maximum(low, high))
    lower, upper = block.bounds(v[7], 0, 4000)
    exact = block.exact(v[7], np.arange(4000))
    assert ((lower <= exact) & (exact <= upper)).all()
    asked = []
    block.exact = lambda q, which, f=block.exact: (asked.append(len(which)), f(q, which))[1]
    _, score = block.positives(7, 7, v[7], 5)
    block.negatives(7, v[7], [(s // 2, s * 95 // 100) for s in score.tolist()], 3)
    assert asked[0] < 100 and asked[1] < 1300, asked  # of 400 and 3600


TEXTS = ["the cat sat on the mat", "the dog sat on the log", "le chat est sur le tapis", "le chien est dans le jardin", None, "", " \t\n\x0b", "unseen words only here", "THE Cat the cat\n\nthe\x1cdog É é"] * 6


def test_hidden_markov_base(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3]), (None, "the cat")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("r", F.lit("x")).withColumn("seq", F.lit(1))
    out = hidden_markov.score(df, F.col("doc_id") % 5 == 2, symbols=3, buckets=4, known=6, shares=(1.0, 1.0))
    cut = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + ["\n"]
    train = Counter(w for i, t in rows if i is None or i % 5 != 2 for w in cut(t))
    n, v = sum(train.values()), len(train)
    want = []
    for i, t in rows:
        w = cut(t)
        want.append((i or 0, i is not None and i % 5 == 2, len(w), sum(train[x] > 0 for x in w), n, round(sum(math.log10((train[x] + 1) / (n + v + 1)) for x in w), 9)))
    got = out.collect()
    assert sorted((r.doc_id or 0, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 9)) for r in got) == sorted(want)
    assert all(r.score < 0 for r in got)
    assert hidden_markov.score(df.limit(0), F.col("doc_id") % 5 == 2).count() == 0
    # nothing to learn from
    assert hidden_markov.score(df, F.lit(True)).filter("score < 0 and base_score = 0 and n_known = 0").count() == len(rows)


def test_base_score_of_a_long_text(spark):
    """Known and unknown words, in great number: as exact as a short text."""
    texts = ["w1 w2 " * 150_000, " ".join(f"u{i}" for i in range(150_000)), "w1"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.base_score for r in hidden_markov.score(df, F.lit(False), symbols=2, buckets=4, known=2, shares=(1.0,)).collect()}
    train = Counter(w for t in texts for w in [*t.split(), "\n"])
    n, v = sum(train.values()), len(train)
    for i, t in enumerate(texts):
        assert math.isclose(got[i], math.fsum(math.log10((train[w] + 1) / (n + v + 1)) for w in [*t.split(), "\n"]), rel_tol=1e-14)


def model(states=3, size=11, seed=1):
    rng = np.random.default_rng(seed)
    share = lambda *s: (x := rng.random(s)) / x.sum(-1, keepdims=True)
    return hidden_markov.Model(share(2, states), share(states, states), np.ascontiguousarray(share(states, size).T))


def test_likelihood_is_the_sum_over_all_paths(monkeypatch):
    m, rng = model(), np.random.default_rng(2)
    lengths = np.array([1, 5, 0, 700, 64, 65, 3])
    symbols = rng.integers(0, 11, lengths.sum()).astype(np.uint16)
    at, want = 0, []
    for n in lengths.tolist():
        a, log = m.first[0].copy(), 0.0
        for t in range(n):
            a = (a if t == 0 else a @ m.move) * m.emit[symbols[at + t]]
            log, a = log + math.log10(a.sum()), a / a.sum()
        want.append(log)
        at += n
    assert np.allclose(hidden_markov.likelihoods(symbols, lengths, m), want)
    monkeypatch.setattr(hidden_markov, "LONG", 50)
    monkeypatch.setattr(hidden_markov, "SEGMENT", 16)
    assert np.allclose(hidden_markov.likelihoods(symbols, lengths, m), want)
    # three tokens, all 27 paths
    p = sum(m.first[0][i] * m.emit[symbols[-3], i] * m.move[i, j] * m.emit[symbols[-2], j] * m.move[j, k] * m.emit[symbols[-1], k] for i in range(3) for j in range(3) for k in range(3))
    assert math.isclose(want[-1], math.log10(p))


def test_expected_counts_by_brute_force(monkeypatch):
    monkeypatch.setattr(hidden_markov, "WINDOW", 4)
    m, rng = model(2, 5), np.random.default_rng(5)
    lengths = np.array([3, 6, 1, 4])
    symbols = rng.integers(0, 5, lengths.sum()).astype(np.uint16)
    first, move, emit = np.zeros((2, 2)), np.zeros((2, 2)), np.zeros((5, 2))
    at = 0
    for n in lengths.tolist():
        for w in range(0, n, 4):
            s = symbols[at + w : at + min(n, w + 4)]
            paths = [[(x >> i) & 1 for i in range(len(s))] for x in range(1 << len(s))]
            p = np.array([m.first[int(w > 0)][z[0]] * np.prod([m.emit[a, b] for a, b in zip(s, z, strict=True)]) * np.prod([m.move[a, b] for a, b in zip(z, z[1:], strict=False)]) for z in paths])
            for z, x in zip(paths, p / p.sum(), strict=True):
                first[int(w > 0), z[0]] += x
                for a, b in zip(z, z[1:], strict=False):
                    move[a, b] += x
                for a, b in zip(s, z, strict=True):
                    emit[a, b] += x
        at += n
    got = hidden_markov.expected_counts(symbols, lengths, m)
    assert all(np.allclose(a, b, atol=1e-4) for a, b in zip(got, (first, move, emit), strict=True))


def test_a_proper_distribution(spark):
    """The probabilities of all texts of one word, seen or not, and of the empty one make at most 1, and the words of a bucket with the unseen one 1."""
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    counted = hidden_markov.counts(df, 4)
    v = hidden_markov.vocabulary(counted, 3, 4, 6)
    by = Counter()
    own = set(v.names[v.symbols < 3].tolist())
    for r in counted.filter("b >= 0").collect():
        if r.h not in own:
            by[r.b] += (r.c + 1) / (v.bucket_tokens[r.b] + v.bucket_words[r.b] + 1)
    assert all(math.isclose(by[b] + 1 / (v.bucket_tokens[b] + v.bucket_words[b] + 1), 1) for b in range(4))


def test_training_beats_the_unigrams(spark):
    out = queries()["op12_hidden_markov"](spark, "/root/testdata/sf0.01")
    held = out.filter("held_out").selectExpr("sum(score)", "sum(base_score)").first()
    assert held[0] > held[1]


def units(text, how):
    return list(text) if how == fill_in_middle.CHARS else re.findall(r"[ \t\n\v\f\r]+|[^ \t\n\v\f\r]+", text)


@pytest.mark.parametrize("how", [fill_in_middle.CHARS, fill_in_middle.WORDS, fill_in_middle.Units((" ", "abc"), each=True)])
def test_ranks(how):
    events = fill_in_middle.automaton(how, fill_in_middle.SENTINELS)
    for text in ["", " ", "a", "  two  words ", "é\U0001f600 x\n\ny", "abc cab  zz a<P>b", "x" * 100, " \t \n"]:
        want = re.findall(r" +|[abc]+|[^ abc]", text) if how.runs[:1] == (" ",) else units(text, how)
        scan = fill_in_middle.Scan(text, events, how)
        assert scan.n == len(want) and scan.has_sentinel == ("<P>" in text)
        assert [scan.place(r) for r in range(len(want) + 1)] == [len("".join(want[:r])) for r in range(len(want) + 1)]


def test_fill_in_middle_edges(spark):
    rows = [(1, None), (2, ""), (3, "with <P> in it"), (4, "<S"), (None, "no id"), (5, "same"), (5, "same"), (6, "é\U0001f600\x00" * 50_000), *((i, f"text {i} <S x P> <") for i in range(10, 60))]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("x")).withColumn("form", F.lit("x")).withColumn("output", F.lit("x"))
    for how in (fill_in_middle.CHARS, fill_in_middle.WORDS):
        out = fill_in_middle.transform(df, units=how).withColumn("back", fill_in_middle.restored(F.col("output"), F.col("form"))).collect()
        assert sorted((r.doc_id or 0, r.back) for r in out) == sorted((i or 0, t or "") for i, t in rows)
        assert {r.form for r in out} == {"plain", "psm", "spm"} and all(r.form == "plain" for r in out if r.doc_id in (1, 2, 3))
        assert all(r.n == len(units(r.back, how)) for r in out)
    assert fill_in_middle.transform(df.limit(0)).count() == 0
