"""Near copies by five-word shingles, next to all pairs compared."""

import random

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from corvina.llm import near_copies


def edited(rng, words, n):
    out = list(words)
    for i in rng.sample(range(len(out)), n):
        out[i] = f"e{rng.randrange(10**9)}"
    return out


def texts():
    rng = random.Random(5)
    out = ["", "one two", "one two"]
    for _ in range(20):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(120, 400))]
        out += [" ".join(edited(rng, base, n)) for n in (0, 1, 2, 4, 8)]
    return out


def kept(rows):
    """Brute force: the least id of each component of pairs at 0.8 or more."""
    sets = {i: {" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, t in rows for w in [t.split()]}
    root = {i: i for i in sets}
    for i in sets:
        for j in sets:
            if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((root[i], root[j]))
                root = {k: a if r == b else r for k, r in root.items()}
    return {i for i, r in root.items() if i == r}


@pytest.mark.parametrize("sizes", [{}, {"members": 2, "hashes": 500}])
def test_by_brute_force(spark, sizes):
    rows = list(enumerate(texts()))
    out = near_copies.representatives(spark.createDataFrame(rows, "doc_id long, text string"), **sizes)
    assert {r.doc_id for r in out.collect()} == kept(rows)


def crowd(seed, n, edits, words=400):
    """Texts of one base, each with so many words replaced at random."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(3000)}" for _ in range(words)]
    return [(i, " ".join(edited(rng, base, rng.choice(edits)))) for i in range(n)]


def kept_by_matrix(rows):
    """As :func:`kept`, for many texts."""
    sets = [{" ".join(w[k : k + 5]) for k in range(len(w) - 4)} for _, t in rows for w in [t.split()]]
    number = {}
    table = np.zeros((len(sets), len(set().union(*sets))), np.float32)
    for i, x in enumerate(sets):
        table[i, [number.setdefault(g, len(number)) for g in x]] = 1
    common, size = table @ table.T, table.sum(1)
    linked = common >= (0.8 - 1e-9) * (size[:, None] + size - common)
    root = np.arange(len(sets))
    while True:  # the least number of those linked, until nothing changes
        new = np.where(linked, root[None, :], len(sets)).min(1)
        if (new == root).all():
            return {rows[i][0] for i in range(len(rows)) if root[i] == i}, (linked.sum() - len(sets)) // 2
        root = new


@pytest.mark.parametrize(("n", "edits", "sizes"), [(400, (4, 5, 6, 7), {}), (400, (4, 6, 6, 7), {"members": 50, "hashes": 20_000}), (2000, (4, 6, 6, 6, 7, 7, 7), {}), (2000, (5, 7, 7, 7, 8), {"members": 300, "hashes": 200_000})])
def test_crowds_of_one_base(spark, n, edits, sizes):
    """Thousands of texts of which a few in a hundred pairs reach 0.8, most come near to it."""
    rows = crowd(n, n, edits)
    want, pairs = kept_by_matrix(rows)
    assert 0 < pairs < 0.2 * n * n / 2 and len(want) < n
    out = near_copies.representatives(spark.createDataFrame(rows, "doc_id long, text string"), **sizes)
    got = {r.doc_id for r in out.collect()}
    assert want <= got  # nothing goes wrongly
    assert n - len(got) >= 0.99 * (n - len(want)), (pairs, n - len(want), n - len(got))
    print(pairs, n - len(want), n - len(got))


def test_overlaps_and_stars():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, rng.integers(0, 50))) for _ in range(30)]
    want = np.array([[len(np.intersect1d(a, b)) for b in sets] for a in sets])
    got = near_copies.overlaps(sets)
    np.fill_diagonal(got, 0), np.fill_diagonal(want, 0)
    assert (got == want).all()
    linked = np.zeros((5, 5), bool)
    linked[0, 3] = linked[3, 0] = linked[3, 4] = linked[4, 3] = linked[0, 4] = linked[4, 0] = True
    root, other = near_copies.stars(linked, np.array([50, 20, 30, 10, 40]))
    assert sorted(zip(root.tolist(), other.tolist(), strict=True)) == [(10, 40), (10, 50)]


def test_like_joins_all_that_are_like():
    rng = np.random.default_rng(2)
    base = rng.integers(-(1 << 62), 1 << 62, (6, 2))
    rows = np.stack([base[rng.integers(0, 6)] ^ (1 << rng.integers(0, 60, 2)) ^ (1 << rng.integers(0, 60, 2)) for _ in range(300)])
    edges = np.array([0, 1, 3, 100, 300])
    a, b = near_copies.like(edges, [pa.array(np.arange(300)), *(pa.array(x) for x in rows.T.copy())], 6)
    differ = np.bitwise_count((rows[:, None] ^ rows[None]).view(np.uint64)).sum(2)
    group = np.repeat(np.arange(4), np.diff(edges))
    near = (differ <= 6) & (group[:, None] == group)

    def roots(pairs):
        r = np.arange(300)
        for _ in range(300):
            for x, y in pairs:
                r[x] = r[y] = min(r[x], r[y])
        return r.tolist()

    assert all(near[x, y] for x, y in zip(a, b, strict=True))
    assert roots(list(zip(a, b, strict=True))) == roots(np.argwhere(near).tolist())
    assert len(a) < 700


def test_the_stage_drops_edited_copies(spark):
    rng = random.Random(7)
    base = [f"w{rng.randrange(3000)}" for _ in range(200)]
    rows = [(1, " ".join(base)), (2, " ".join(edited(rng, base, 3))), (3, " ".join(f"v{i}" for i in range(200)))]
    out = corpus_pipeline.near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert {r.doc_id for r in out.collect()} == {1, 3}


def test_empty_table(spark):
    assert near_copies.representatives(spark.createDataFrame([], "doc_id long, text string")).count() == 0
