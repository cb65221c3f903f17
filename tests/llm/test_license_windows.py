"""License scans: every window, next to brute force."""

import random
from collections import Counter

import pytest

from corvina.llm import license_scan

MIT = license_scan.words(license_scan.TEMPLATES[0][1])


def best_of_all(template, text, t):
    grams = lambda w: list(zip(w, w[1:], strict=False))
    own, all_ = Counter(grams(template)), grams(text)
    n, best = sum(own.values()), 0.0
    for i in range(len(all_)):
        window, shared = Counter(), 0
        for j in range(i, len(all_)):
            window[all_[j]] += 1
            shared += window[all_[j]] <= own[all_[j]]
            best = max(best, 2 * shared / (n + j - i + 1))
    return best if best >= t - 1e-12 else None


def found(templates, text, t=0.8):
    x = license_scan.Templates(templates, t)
    return {f[1]: f[0] for f in x.find(text)}


@pytest.mark.parametrize(("n", "dice"), [(40, 0.885), (50, 0.861), (70, 0.817)])
def test_a_block_inserted_in_the_middle(n, dice):
    text = MIT[:80] + [f"new{i}" for i in range(n)] + MIT[80:]
    got = found(license_scan.TEMPLATES[:1], " ".join(["front"] * 9 + text + ["end"] * 9))
    assert round(got[0], 3) == dice


def test_common_bigrams_elsewhere_hide_nothing():
    template = "a b a b a b a b a b c d e f g h i j k l m n o p q r s t u v".split()
    text = "a b " * 40 + "x y z " + " ".join(template[:20] + ["new"] + template[20:])
    assert found((("T", " ".join(template)),), text)[0] == pytest.approx(best_of_all(template, text.split(), 0.8))


def test_by_brute_force():
    rng = random.Random(2)
    some = 0
    for _ in range(300):
        template = [rng.choice("abcdef") for _ in range(rng.randrange(4, 16))]
        text = [rng.choice("abcdefx") for _ in range(rng.randrange(30))]
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(text) + 1)
            copy = list(template)
            for _ in range(rng.randrange(4)):
                copy.insert(rng.randrange(len(copy) + 1), rng.choice("abyz"))
            text[at:at] = copy
        t = rng.choice((0.6, 0.8, 0.9))
        true = best_of_all(template, text, t)
        some += true is not None
        assert found((("T", " ".join(template)),), " ".join(text), t).get(0) == (None if true is None else pytest.approx(true))
    assert some > 100


def test_whole_texts_are_found(spark):
    """Each licence by itself, among other words with some of its words changed, and two in one document."""
    full = dict(license_scan.full_texts())
    assert set(full) == {"Apache-2.0", "CC0-1.0", "GFDL-1.3", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0"}
    rng, rows, names = random.Random(3), [], sorted(full)
    for i, n in enumerate(names):
        own = full[n].split()
        for at in rng.sample(range(len(own)), len(own) // 30):
            own[at] = "changed"
        rows += [(2 * i, full[n]), (2 * i + 1, "some words before " * 40 + " ".join(own) + " and behind" * 300)]
    rows += [(100, full["MPL-2.0"] + "\n" + full["Apache-2.0"]), (101, full["GPL-3.0"][:15_000]), (102, None), (103, "")]
    got = {r.doc_id: r for r in license_scan.scan(spark.createDataFrame([(*r, "own") for r in rows], "doc_id long, text string, license string")).collect()}
    for i, n in enumerate(names):
        assert (got[2 * i].license, got[2 * i].dice, got[2 * i].n_words) == (n, 1.0, len(license_scan.words(full[n])))
        assert n in got[2 * i + 1].licenses and got[2 * i + 1].dice > 0.8  # a notice within the text may have more, as it has no changed word
    assert {"MPL-2.0", "Apache-2.0"} <= set(got[100].licenses)
    assert "GPL-3.0" not in got[101].licenses and got[102].license is None and got[103].licenses == []


def test_memory_grows_with_the_texts():
    """A thousand templates of a thousand words of their own: no table of all pairs of words."""
    templates = tuple((f"t{k}", " ".join(f"w{k}x{i}" for i in range(1000))) for k in range(1000))
    x = license_scan.Templates(templates, 0.8)
    assert sum(a.nbytes for a in (x.gram, x.first, x.holder)) < 50 << 20
    assert [f[:2] for f in x.find("a " + templates[7][1])] == [(1.0, 7)]
