"""Operators against brute force, the library or an exact round trip."""

import hashlib
import io
import random
import zlib
from array import array
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash

from corvina.llm import decontamination, language_id, line_dedup, queries, quality_rules, sentencepiece_codec, simhash, suffix_dedup, warc

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents():
    return duckdb.sql(f"select doc_id, text, lang from '{DIR}/documents.parquet' order by 1").fetchall()


def table(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize("name", ["op2_line_dedup", "op7_warc"])
def test_agrees_with_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    mine, theirs = queries.queries()[name](spark, DIR), con.sql(queries.oracle_sql()[name])
    order = lambda names: sorted(range(len(names)), key=lambda i: names[i])
    a = sorted(repr([r[i] for i in order(mine.columns)]) for r in mine.collect())
    assert a == sorted(repr([r[i] for i in order(theirs.columns)]) for r in theirs.fetchall())


def edits_anywhere(item, text):
    """Fewest edits of the item against any part of the text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_decontamination_by_brute_force():
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "eta", "the", "of"]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, say(rng.choice((6, 10, 20)))) for i in range(12)]
    index = decontamination.Index(items, decontamination.Q, decontamination.RATE)
    for _ in range(40):
        i = rng.randrange(12)
        t = list(items[i][1])
        for _ in range(rng.randrange(8)):
            at = rng.randrange(len(t))
            t[at : at + rng.randrange(2)] = rng.choice(("x", "", "yz"))
        text = say(rng.randrange(15)) + " " + "".join(t) + " " + say(rng.randrange(15))
        found = decontamination.matches(index, text)
        for k, (_, item) in enumerate(items):
            best = edits_anywhere(item, text)
            assert (k in found) == (best <= index.k[k])
            if k in found:
                assert best <= found[k][0] <= index.k[k] or found[k][0] == best


def test_planted_items_are_found(spark):
    n = queries.op1_decontamination(spark, DIR).select("doc_id").distinct().count()
    con = duckdb.sql(f"select count(distinct doc_id) from '{DIR}/documents.parquet' d, '{DIR}/benchmark.parquet' b where contains(d.text, b.text)").fetchall()
    assert n >= con[0][0] > 0


def kept_lines(docs, policy, min_docs):
    keys = lambda t: [x.strip(" \t\n\v\f\r").translate({c: c + 32 for c in range(65, 91)}) for x in (t or "").split("\n")]
    n = Counter(k for _, t in docs for k in set(keys(t)))
    seen, out = set(), {}
    for d, t in sorted(docs):
        kept = []
        for line, k in zip((t or "").split("\n"), keys(t), strict=True):
            gone = k != "" and (n[k] >= min_docs if policy == "threshold" else k in seen)
            seen.add(k)
            if not gone:
                kept.append(line)
        out[d] = "\n".join(kept)
    return out


@pytest.mark.parametrize(("policy", "parts"), [("threshold", 1), ("threshold", 7), ("first", 7)])
def test_lines_by_brute_force(spark, policy, parts):
    """With a very common line, which is spread over several range partitions."""
    rng = random.Random(5)
    docs = [(i, "\n".join(["Hot "] + [rng.choice("abcdefghijklm") * rng.randrange(3) for _ in range(rng.randrange(6))])) for i in range(300)]
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        out = {r.doc_id: r.text for r in line_dedup.dedup(table(spark, docs), policy=policy, min_docs=25).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert out == kept_lines(docs, policy, 25)


def test_language_held_out(spark):
    out = queries.op3_language_id(spark, DIR.replace("0.001", "0.01")).collect()
    lang = dict(duckdb.sql(f"select doc_id, lang from '{DIR.replace('0.001', '0.01')}/documents.parquet'").fetchall())
    test = [r for r in out if r.held_out and lang[r.doc_id]]
    assert len(test) > 200 and sum(r.lang_pred == lang[r.doc_id] for r in test) > 0.97 * len(test)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out)


def test_forward_algorithm_sums_all_segmentations():
    pieces = ["a", "b", "ab", "ba", "▁", "▁a", "bab"]
    lattice, p = language_id.Lattice(pieces), np.random.default_rng(1).random((len(pieces) + 2, 2))
    p[0] = 0

    def total(word, k):
        if not word:
            return 1.0
        return sum(p[lattice.number[word[:n]], k] * total(word[n:], k) for n in range(1, len(word) + 1) if word[:n] in lattice.number)

    words = ["▁abab", "▁babab", "▁" + "ab" * 10]
    got = np.exp(lattice.score(words, p))
    assert np.allclose(got, [[total(w, k) for k in (0, 1)] for w in words])
    assert np.allclose(np.exp([lattice.long(w, p) for w in words]), got)


def test_pieces_are_the_library_s(documents):
    import sentencepiece

    with open(queries.model_path(), "rb") as f:
        codec = sentencepiece_codec.ChunkCodec(f.read(), entries=500)
    sp = sentencepiece.SentencePieceProcessor(model_file=queries.model_path())
    rng = random.Random(2)
    odd = ["".join(rng.choice(" ▁\n\tab.,é😀\x00漢<s>") for _ in range(rng.randrange(40))) for _ in range(300)]
    texts = [t or "" for _, t, _ in documents] + odd + ["", " ", "▁", "x" * 300 + " y", "  a"]
    assert codec.separable
    for at in range(0, len(texts), 20):
        for t, (ids, decoded) in zip(texts[at : at + 20], codec.encode(texts[at : at + 20]), strict=True):
            want = sp.encode(t, add_eos=True)
            assert array("i", ids).tolist() == want and decoded == sp.decode(want)


def simple_fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(fps, bits=2):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    fps = list(root)
    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= bits:
                root[find(a)] = find(b)
    return {f: find(f) for f in fps}


def test_simhash_by_brute_force(spark, documents):
    fp = {d: simple_fingerprint(t) for d, t, _ in documents}
    root = roots(list(fp.values()))
    least = {}
    for d, f in fp.items():
        least[root[f]] = min(d, least.get(root[f], d))
    out = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in queries.op6_simhash(spark, DIR).collect()}
    assert out == {d: (f, least[root[f]]) for d, f in fp.items()}


@pytest.mark.parametrize(("bits", "bucket"), [(2, 64), (2, 2), (1, 2)])
def test_links_of_close_fingerprints(spark, bits, bucket):
    """Chains and clusters, with ordinary and with crowded buckets."""
    rng = random.Random(bits * 10 + bucket)
    fps = [rng.getrandbits(64) for _ in range(60)]
    for _ in range(200):
        x = rng.choice(fps)
        for _ in range(rng.randrange(1, 4)):
            x ^= 1 << rng.randrange(64)
        fps.append(x)
    fps += [fps[0] ^ (1 << i) for i in range(64)]
    fps = list(dict.fromkeys(fps))
    df = spark.createDataFrame([(x - 2**64 if x >> 63 else x,) for x in fps], "fp long")
    out = {r.node % 2**64: r.root for r in simhash.components(simhash.links(df, bits, bucket)).collect()}
    groups = lambda pairs: sorted(sorted(g) for g in pairs.values())
    mine, theirs = {}, {}
    for f, r in roots(fps, bits).items():
        theirs.setdefault(r, []).append(f)
        mine.setdefault(out.get(f, f"alone {f}"), []).append(f)
    assert groups(mine) == groups(theirs)


def test_golay_code():
    near, wide = simhash.golay()
    assert len(set(near.tolist())) == 2048 and max(int(x).bit_count() for x in near) == 3
    x = np.arange(0, 1 << 23, 9973, dtype=np.uint32)
    assert not simhash.syndrome(x ^ near[simhash.syndrome(x)]).any()


def test_archive_reader_finds_damage():
    good = b"".join(warc.page_record(i, "u", b"payload %d" % i * 50, None, "1970-01-01T00:00:00Z") for i in range(3))
    read = lambda data: [(r["status"], r["fields"].get("page-id")) for r in warc.records(io.BytesIO(data))]
    assert read(good) == [("ok", "0"), ("ok", "1"), ("ok", "2")]
    assert [x[0] for x in read(good[:-20])] == ["ok", "ok", "truncated"]
    plain = zlib.decompress(good, 31)
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    assert read(z.compress(plain.replace(b"payload 0", b"payload X", 1)) + z.flush())[0][0].endswith("differs")
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    assert [x[0] for x in read(z.compress(plain + b"more") + z.flush())] == ["longer than Content-Length"]
    assert [x[0] for x in read(b"nonsense")] == ["not gzip"]
    payloads = [r["payload"] for r in warc.records(io.BytesIO(good), payloads=True)]
    assert payloads == [b"payload %d" % i * 50 for i in range(3)]


def test_quality_by_brute_force(spark, documents):
    import re

    out = {r.doc_id: r for r in queries.op9_quality_rules(spark, DIR).collect()}
    for d, t, _ in documents:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        n = Counter(grams)
        again = {j for i, g in enumerate(grams) if n[g] > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in t.split("\n") if x.strip(" \t\n\v\f\r")]
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(again))
        assert tuple(out[d][k] for k in quality_rules.BASE) == want
        assert out[d].base_failed == (len(w) < 50 or 100 * len(again) > 50 * len(w)) and (not out[d].kept or not out[d].base_failed)


def test_distance_is_the_jensen_shannon_distance(spark):
    from pyspark.sql import functions as F

    refs, counts = [[0.5, 0.5, 0.0], [0.1, 0.2, 0.7]], [3, 0, 1]
    df = spark.createDataFrame([(counts,)], "c array<long>").select(quality_rules.shares(F.col("c"), F.lit(4)).alias("s"))
    got = df.select(quality_rules.distance(F.col("s"), refs).alias("d")).collect()[0].d

    def js(p, q):
        kl = lambda a, b: sum(x * np.log2(x / y) for x, y in zip(a, b, strict=True) if x > 0)
        m = [(x + y) / 2 for x, y in zip(p, q, strict=True)]
        return ((kl(p, m) + kl(q, m)) / 2) ** 0.5

    assert got == pytest.approx(min(js([0.75, 0, 0.25], r) for r in refs))


def brute_removal(rows, length=200):
    data = [(d, (t or "").encode()) for d, t in rows]
    n = Counter(b[i : i + length] for _, b in data for i in range(len(b) - length + 1))
    out = {}
    for d, b in data:
        covered = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if n[b[i : i + length]] > 1:
                covered[i : i + length] = b"\x01" * length
        spans = sum(c and not p for c, p in zip(covered, b"\x00" + covered, strict=False))
        out[d] = (len(b), sum(covered), spans, hashlib.sha256(bytes(x for x, c in zip(b, covered, strict=True) if not c)).hexdigest())
    return out


@pytest.mark.parametrize(("crowd", "block", "held"), [(4096, 4 << 20, 32 << 20), (3, 3000, 32 << 20), (4096, 1 << 20, 0), (3, 3000, 0)])
def test_suffixes_by_brute_force(spark, documents, crowd, block, held, monkeypatch):
    """Also with crowded buckets, small blocks and periodic texts, and without the table of segments already met."""
    rng = random.Random(1)
    rows = [(d, t) for d, t, _ in documents][:120]
    part = "".join(rng.choice("abcd") for _ in range(400))
    rows += [(1000 + i, "".join(rng.choice("xyz") for _ in range(rng.randrange(90))) + part[rng.randrange(150) : 250 + rng.randrange(150)] + "".join(rng.choice("xyz") for _ in range(90))) for i in range(20)]
    rows += [(2000, "ab" * 400), (2001, "abc" * 100 + part), (2002, "q" * 199), (2003, "q" * 200), (2004, part[:100] * 7)]
    for name, value in (("CROWD", crowd), ("SPLIT", max(1, crowd // 2)), ("BLOCK", block), ("HELD", held)):
        monkeypatch.setattr(suffix_dedup, name, value)
    made = suffix_dedup.dedup(table(spark, rows)).collect()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in made}
    assert got == brute_removal(rows)


@pytest.mark.parametrize("rounds", [3, 30])
def test_classes_of_equal_strings(rounds):
    """Long ties of many kinds: strings with one beginning and different ends."""
    rng = random.Random(rounds)
    head = "".join(rng.choice("ab") for _ in range(150))
    segs = [(head + "".join(rng.choice("ab") for _ in range(rng.choice((3, 60)))) + "c" * 100)[:260] for _ in range(rounds)]
    segs += segs[:2]
    text, starts = np.frombuffer("".join(segs).encode(), np.uint8), []
    at = 0
    for s in segs:
        starts += range(at, at + len(s) - 199)
        at += len(s)
    cls = suffix_dedup.repeats(text, np.array(starts), 200)
    data = text.tobytes()
    want: dict[bytes, int] = {}
    expected = [want.setdefault(data[s : s + 200], len(want)) for s in starts]
    assert len(set(zip(cls.tolist(), expected, strict=True))) == len(set(cls.tolist())) == len(want)
