"""Every national work has a file to match."""

from corvina import rules
from corvina.plans import queries

DIR = "/root/testdata/sf0.001"


def test_a_file_for_each_national_work(spark):
    w = queries.works(spark, DIR)
    own = {r.id for r in w.filter(w.src == rules.NATIONAL).filter(w.type == rules.WORK).collect()}
    assert {r.position for r in queries.misspelt(w).collect()} == own
    assert {r.position for r in queries.QUERIES["fuzzy_match"](spark, DIR).collect()} == own
