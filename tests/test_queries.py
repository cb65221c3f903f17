"""Every query with SQL of its own, side by side over the smallest tables."""

import os

import duckdb
import pytest

from corvina.plans.queries import QUERIES, SQL

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def other():
    con = duckdb.connect()
    for f in os.listdir(DIR):
        con.sql(f"create view {f.split('.')[0]} as select * from '{DIR}/{f}'")
    return con


def rows(found, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr([round(r[i], 6) if isinstance(r[i], float) else r[i] for i in order]) for r in found)


@pytest.mark.parametrize("name", sorted(SQL))
def test_agrees_with_sql(spark, other, name):
    mine = QUERIES[name](spark, DIR)
    theirs = other.sql(SQL[name])
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert rows([tuple(r) for r in mine.collect()], mine.columns) == rows(theirs.fetchall(), theirs.columns)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, DIR).count() >= 0


def test_fuzzy_match_finds_most_of_the_misspelt(spark):
    out = QUERIES["fuzzy_match"](spark, DIR).collect()
    right = [r for r in out if r.work == r.position]
    assert len(right) >= 0.7 * len(out)


def test_learned_repairs(spark):
    assert {(r.wrong, r.right) for r in QUERIES["learn_repair"](spark, DIR).collect()} <= {("烉", "e"), ("炻", "o")}
