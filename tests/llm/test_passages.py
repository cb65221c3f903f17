"""Passages of an item without its rest, and the longest part's place where the whole item stands."""

import random

from corvina.llm import decontamination


def say(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 9))) for _ in range(n))


def found(item, text):
    index = decontamination.Index([(1, x) for x in decontamination.all_parts(item)], decontamination.Q, decontamination.RATE)
    return decontamination.matches(index, text)


def test_every_passage_of_the_stated_length_is_found():
    rng = random.Random(11)
    shortest = decontamination.SHORT + decontamination.STRIDE - 1
    for n in (100, 130, 150, 170, 225, 400, 900):
        item = (say(rng, 200))[:n].strip()
        for _ in range(6):
            at = rng.randrange(len(item) - shortest + 1)
            assert found(item, say(rng, 60) + item[at : at + shortest] + say(rng, 60)), (n, at)
        assert not found(item, say(rng, 120))


def test_a_passage_is_a_row_and_its_document_goes(spark):
    rng = random.Random(12)
    item = say(rng, 60)[:260]
    docs = spark.createDataFrame([(1, say(rng, 40) + item[77:177] + say(rng, 40)), (2, say(rng, 80)), (3, "x " + item + " y")], "doc_id long, text string")
    items = spark.createDataFrame([(7, item)], "item_id long, text string")
    rows = {r.doc_id: r for r in decontamination.contaminated(docs, items).collect()}
    assert set(rows) == {1, 3}
    assert (rows[3].edits, rows[3].end - rows[3].start) == (0, decontamination.PART)
    assert [r.doc_id for r in decontamination.clean(docs, items).collect()] == [2]
