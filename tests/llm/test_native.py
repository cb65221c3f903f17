"""The operators in DataFrame functions next to their SQL, on rows made to be awkward."""

import random

import duckdb
import pytest

from corvina.llm import quality_rules, queries, quotation_links

DIR = "/root/testdata/sf0.001"


def rows_of(found, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr([r[i] for i in order]) for r in found)


@pytest.mark.parametrize("name", ["op8_quotation_links", "op9_quality_rules"])
def test_agrees_with_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    mine, theirs = queries.queries()[name](spark, DIR), con.sql(queries.oracle_sql()[name])
    assert rows_of(mine.collect(), mine.columns) == rows_of(theirs.fetchall(), theirs.columns)


def conversations(rng):
    """Nested quotations, short and long ones, copies, ties, null keys and texts, chains over conversations."""
    say = lambda: " ".join(rng.choice(["Yes", "water", "Bread", "the", "oven", "is", "hot", "now"]) for _ in range(rng.choice((1, 2, 9, 12))))
    rows, said = [], []
    for conv in range(80):
        for turn in range(rng.randrange(1, 6)):
            parts = []
            for _ in range(rng.randrange(4)):
                old = rng.choice(said) if said and rng.random() < 0.8 else say()
                mark = rng.choice(("> ", ">", ">> ", "> > ", " >", ">\t"))
                if rng.random() < 0.4:
                    parts.append(rng.choice(("Ann wrote:", "On Monday Bob writes :", "Eva schrieb:", "no one")))
                parts += [mark + x for x in old.split("\n")] + rng.choice(([], [">"], ["", "  "], [say()]))
            parts += [rng.choice(("", "\t")) + say() for _ in range(rng.randrange(3))]
            text = rng.choice(("\n", "\n", "\r\n", "\n\n")).join(parts)
            said += [x for x in (say(), text, *parts) if x]
            rows.append((conv if rng.random() < 0.95 else None, turn if rng.random() < 0.95 else None, "user", rng.choice((text, text, text, text.upper(), None))))
    return rows + rows[:5]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_links_agree_with_sql(spark, seed):
    rows = conversations(random.Random(seed))
    con = duckdb.connect()
    con.sql("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    con.executemany("insert into conversations values (?, ?, ?, ?)", rows)
    theirs = con.sql(queries.oracle_sql()["op8_quotation_links"])
    mine = quotation_links.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert rows_of(mine.collect(), mine.columns) == rows_of(theirs.fetchall(), theirs.columns)
    assert mine.filter("parent_conv is not null").count() > 20 and mine.filter("root_conv <> conv_id").count() > 3


def test_every_language_has_a_reference(spark, monkeypatch):
    """More languages than a block; a document passes by the reference of its own, however rare."""
    monkeypatch.setattr(quality_rules, "BLOCK", 3)
    rows = [(i, " ".join(chr(97 + i) * 3 + str(k % 10) * i for k in range(60)), f"l{i}") for i in range(10)]
    out = {r.doc_id: r for r in quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string"), max_chars=1e-6).collect()}
    assert all(out[i].char_distance < 1e-6 and not out[i].base_failed == (out[i].n_repeat_words <= 30) for i in range(10))
