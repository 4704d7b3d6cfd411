"""Every registered query against its SQL, or its rows against plain Python."""

import random
import unicodedata

import compare
import pytest
from pyspark.sql import functions as F

from tallyleaf import registry
from tallyleaf.functions import helpers

QUERIES, ORACLES = registry.queries(), registry.oracles()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    compare.same(spark, QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows(spark, name):
    assert QUERIES[name](spark, compare.DATA).count() > 0


def test_partitions_do_not_matter(spark):
    q = QUERIES["j2_current_trials"]
    one = sorted(map(str, q(spark, compare.DATA).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        assert sorted(map(str, q(spark, compare.DATA).collect())) == one
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_nfkc(spark):
    texts = ["ＡＢＣ１２", "ﬁne", "plain", None, "½"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1).select(helpers.nfkc("t")).collect()]
    assert got == [t if t is None else unicodedata.normalize("NFKC", t) for t in texts]


def test_seeded_permutation(spark):
    for seed, order in spark.range(20).select("id", helpers.seeded_permutation(F.col("id"), F.lit(9))).collect():
        want = list(range(1, 10))
        random.Random(seed).shuffle(want)
        assert order == want


def test_anchors_of_all_items(spark):
    """test_sql compares the rows; here, that no item number is left out."""
    rows = QUERIES["w9_anchored_rows_all"](spark, compare.DATA)
    assert rows.agg(F.max("slot_id")).first()[0] > "q3"
