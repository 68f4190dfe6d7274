"""Rows that earlier forms lost: NULL keys, repeated points, strata with several cases."""

import itertools
import math

import pytest
from pyspark.sql import functions as F

from heredium import storage
from heredium.operators import intervals, ordered, ranks, regression


def test_scan_carries_state_under_a_null_key(spark, rows):
    d = spark.createDataFrame([(None, 0, 1), (None, 1, 2), (None, 2, 3), ("a", 0, 5), ("a", 1, 6)], "k string, b int, v long")
    out = ordered.previous(d, ["k"], "b", ["v"], F.col("v"), "p")
    assert {(k, v): p for k, v, p in ((r.k, r.v, r.p) for r in out.collect())} == {(None, 1): None, (None, 2): 1, (None, 3): 2, ("a", 5): None, ("a", 6): 5}


def test_distribution_keeps_a_null_key(spark):
    d = spark.createDataFrame([(None, 1.0), (None, 2.0), ("a", 3.0)], "k string, v double")
    got = {(r.k, r.v): (r.before, r.total) for r in ranks.distribution(d, ["k"], "v").collect()}
    assert got == {(None, 1.0): (0, 2), (None, 2.0): (1, 2), ("a", 3.0): (0, 1)}


def test_semi_filter_keeps_repeated_points_on_every_level(spark):
    points = spark.createDataFrame([("c", 100), ("c", 100), ("c", 5_000_000), ("c", 9)], "chrom string, pos long")
    spans = spark.createDataFrame([("c", 90, 110), ("c", 50, 4_000_000), ("c", 4_999_000, 5_000_500)], "chrom string, b_start long, b_end long")
    hit = sorted(r.pos for r in intervals.point_filter(points, spans, "left_semi").collect())
    missed = [r.pos for r in intervals.point_filter(points, spans, "left_anti").collect()]
    assert hit == [100, 100, 5_000_000] and missed == [9]


def test_conditional_logistic_with_two_cases(spark):
    strata = [([1, 1, 0], [2.0, 1.0, 0.0]), ([1, 0], [1.0, 0.0]), ([1, 0, 0], [0.0, 1.0, 2.0]), ([0, 0], [1.0, 0.0]), ([1, 1, 0, 0], [1.0, 3.0, 0.0, 2.0])]
    data = [("k", s, c, x) for s, (cs, xs) in enumerate(strata) for c, x in zip(cs, xs)]
    got = regression.conditional_logistic(spark.createDataFrame(data, "key string, s int, c int, x double"), ["key"], "s", "c", "x").first()

    def loglik(b):
        total = 0.0
        for cs, xs in strata:
            m = sum(cs)
            if 0 < m < len(cs):
                total += b * sum(x for c, x in zip(cs, xs) if c) - math.log(sum(math.exp(b * sum(p)) for p in itertools.combinations(xs, m)))
        return total

    best = max((i / 1000 for i in range(-3000, 3001)), key=loglik)
    assert got.n_strata == 4 and got.beta == pytest.approx(best, abs=2e-3)


def test_shared_folder_is_the_sessions(spark):
    assert storage.shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
