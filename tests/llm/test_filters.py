"""Decontamination with common q-grams, short items and exact numbers of edits; the chunk table; damaged archives."""

import io
import random
import resource
import time

import pytest

from corvina.llm import decontamination, queries, sentencepiece_codec, warc


def say(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 9))) for _ in range(n))


def index(items):
    return decontamination.Index([(i, x) for i, t in items for x in decontamination.all_parts(t)], decontamination.Q, decontamination.RATE)


def test_runs_of_one_character_take_little():
    """200 items that hold a dashed rule, against texts of dashes."""
    rng = random.Random(1)
    rules = index([(i, say(rng, 20) + " " + "-" * 40 + " " + say(rng, 25)) for i in range(200)])
    same = index([(1, "-" * 150 + "x" * 10)])
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    for n in (1_000, 5_000, 100_000, 1_000_000):
        start = time.process_time()
        assert decontamination.matches(rules, "-" * n) == {}
        assert time.process_time() - start < 1
    assert decontamination.matches(same, "a" + "-" * 100_000)[0][0] == 10
    table = "".join(rng.choice(("-" * rng.randrange(1, 60), "+", "|")) for _ in range(3_000))
    assert decontamination.matches(rules, table) == {}
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 200_000


def best_edits(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_edits_are_the_fewest_for_items_of_any_length(spark):
    rng = random.Random(4)
    items = [(i, "".join(rng.choice("abcd ") for _ in range(n)).strip() or "a") for i, n in enumerate((1, 2, 5, 9, 10, 15, 16, 20, 23, 24, 30, 31, 40, 60, 79))]
    docs = []
    for d in range(40):
        parts = []
        for _ in range(4):
            t = list(rng.choice(items)[1])
            for _ in range(rng.randrange(6)):
                at = rng.randrange(len(t) + 1)
                t[at : at + rng.randrange(2)] = rng.choice(("x", "", "yz"))
            parts += ["".join(t), "".join(rng.choice("xyzw ") for _ in range(rng.randrange(30)))]
        docs.append((d, "".join(parts)))
    out = decontamination.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    # the operator strips nothing inside a text but folds white space, which these texts don't have besides blanks
    want = {(d, i, e) for d, t in docs for i, x in items if (e := best_edits(x, t)) <= len(x) // 10}
    assert {(r.doc_id, r.item_id, r.edits) for r in out.collect()} == want and len(want) > 100


def test_texts_together_as_one_by_one():
    rng = random.Random(9)
    items = [(i, say(rng, 30)) for i in range(20)]
    own = index(items)
    texts = ["", "x", *(say(rng, 40) + (items[i % 20][1][: 120 + i] if i % 3 else "") + say(rng, 20) for i in range(60))]
    together = decontamination.matches_of_each(own, texts)
    assert together == [decontamination.matches(own, t) for t in texts] and sum(map(bool, together)) >= 35


def test_long_chunks_are_put_aside():
    with open(queries.model_path(), "rb") as f:
        codec = sentencepiece_codec.ChunkCodec(f.read())
    words = [f"word{i}" for i in range(500)]
    list(codec.encode([" ".join([*words, "x" * 70]), "https://" + "y" * 200 + " word1"]))
    assert len(codec.ids) == len(codec.text) == 500
    known = dict(codec.ids)
    assert [d for _, d in codec.encode(["word3 " + "z" * 99, None])] == ["word3 " + "z" * 99, ""]
    assert codec.ids == known


@pytest.fixture
def members():
    return [warc.page_record(i, "u" * (3_000_000 if i == 1 else 3), b"payload %d" % i * 5_000, None, "1970-01-01T00:00:00Z") for i in range(4)]


def read(data):
    return [(r["status"], r["fields"].get("page-id")) for r in warc.records(io.BytesIO(data))]


def test_heads_of_any_length(members):
    assert read(b"".join(members)) == [("ok", str(i)) for i in range(4)]


def test_a_damaged_record_loses_only_itself(members):
    whole = [("ok", "0"), ("ok", "2"), ("ok", "3")]
    broken = bytearray(members[1])
    broken[40:80] = b"\xff" * 40
    cut_off = members[1][: len(members[1]) // 2]
    for bad in (bytes(broken), cut_off, b"nonsense" * 20_000, b"\x1f\x8b\x08" * 9, warc.zlib.compress(b"WARC/1.1\r\n\r\n", wbits=31)):
        out = read(members[0] + bad + members[2] + members[3])
        assert [x for x in out if x[0] == "ok"] == whole and len(out) == 4
    assert read(members[0][:-5]) == [("truncated", "0")]


def test_as_many_readers_as_archives(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"u{i}", f"page {i} " * 200) for i in range(200)], "page_id long, url string, html string").repartition(1)
    archives = warc.write(warc.revisits(pages), (tmp_path / "w").as_uri(), archive_bytes=2_000)
    assert archives.count() > 20
    assert warc.round_trip(pages, folder=str(tmp_path / "v")).filter("status = 'ok'").count() == 200
