"""Language models: unlikely and long words, the sample's bound, expected uses."""

import numpy as np
import pytest

from corvina.llm import language_id

PIECES = ["a", "b", "ab", "ba", "▁", "▁a", "bab"]


def test_unlikely_words_have_a_score():
    letters = [chr(97 + i) for i in range(26)] + ["▁", "qu", "▁qu"]
    p = np.full((len(letters) + 2, 2), 1e-9)
    p[0] = 0
    p[letters.index("q") + 1, 1] = 2e-9
    for n in (7, 8, 9, 38, 39, 40, 41, 300, 5_000):
        scorer = language_id.Scorer(letters, ["x", "y"], p)
        names, best = scorer.score(["q" * n, "z" * n, "é" * n])
        assert names == ["y", "x", "x"] and np.isfinite(best).all() and (best >= 0).all() and (best <= 1).all()
        assert np.allclose(best[1:], 0.5)


def test_rescaled_sums_agree():
    lattice, rng = language_id.Lattice(PIECES), np.random.default_rng(1)
    p = rng.random((len(PIECES) + 2, 2)) * 1e-6
    p[0] = 0
    words = ["▁" + "".join(rng.choice(["a", "b", "c"], 39)) for _ in range(20)]
    assert np.allclose(lattice.score(words, p), [lattice.long(w, p) for w in words])


def test_expected_uses_sum_all_segmentations():
    lattice, p = language_id.Lattice(PIECES), np.random.default_rng(2).random((len(PIECES) + 2, 1))
    p[0] = 0

    def ways(word):
        if not word:
            return [[]]
        return [[word[:n], *rest] for n in range(1, len(word) + 1) if word[:n] in lattice.number for rest in ways(word[n:])]

    for word in ("▁abab", "▁babab"):
        every = [(np.prod([p[lattice.number[x], 0] for x in w]), w) for w in ways(word)]
        total, want = sum(q for q, _ in every), np.zeros(len(p))
        for q, w in every:
            for x in w:
                want[lattice.number[x]] += 3 * q / total
        assert np.allclose(lattice.counts({word: np.array([3.0])}, p)[:, 0], want)


@pytest.mark.parametrize("parts", [1, 5])
def test_the_sample_is_bounded(spark, parts):
    """With a hot language, null ids, and ids and rows that repeat."""
    rows = [(i if i % 3 else None, f"text {i % 300}", "hot") for i in range(900)] + [(7, f"other {i}", "few") for i in range(20)] + [(8, "same", "one")] * 30 + [(9, None, "none"), (10, "x", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(parts)
    got = language_id.sampled(docs, "doc_id", "text", "lang", 50).collect()
    n = {g: sum(r.lang == g for r in got) for g in ("hot", "few", "one", "none")}
    assert n == {"hot": 50, "few": 20, "one": 1, "none": 0} and len(got) == 71
    again = language_id.sampled(docs.repartition(3), "doc_id", "text", "lang", 50).collect()
    assert sorted(r.text for r in got) == sorted(r.text for r in again)


def test_long_words_are_learned_from(spark):
    docs = spark.createDataFrame([(1, "a" * 100, "long"), (2, "b b b", "short")], "doc_id long, text string, lang string")
    languages, p = language_id.learn(docs, ["a", "b", "▁"])
    assert languages == ["long", "short"] and p[1, 0] > 0.9 and p[2, 1] > 0.4
