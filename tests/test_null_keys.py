"""A NULL key is a key like any other."""

import pytest
from pyspark.sql import functions as F

from heredium.operators import panel, ranks
from heredium.plans import episignature as es
from heredium.plans import methylation as me

DATA = [(k, fam, float(v), float((v * 7) % 5)) for k in (None, "a") for fam, v in ((None, 1), (1, 2), (1, 3), (2, 5), (2, 5), (3, 8), (3, 9), (4, 12))]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(DATA, "k string, fam int, v double, y double")


@pytest.fixture(scope="module")
def named(rows):
    """The same rows with names in place of the NULLs."""
    return rows.fillna("none", ["k"]).fillna(-9, ["fam"])


def same(a, b, keys):
    fill = lambda d: sorted(tuple(("none" if c == "k" else -9) if r[c] is None and c in keys else r[c] for c in d.columns) for r in d.collect())
    x, y = fill(a), fill(b)
    assert x == y and x
    assert any(r["k"] is None for r in a.collect())


CASES = {
    "spearman": lambda d: ranks.spearman(d, ["k"], "v", "y"),
    "robust_z": lambda d: panel.robust_z(d, ["k"], "v"),
    "moments": lambda d: panel.leave_one_out_moments(d, ["k"], "v"),
    "leave_one_out": lambda d: panel.leave_one_out(d, ["k"], "fam", {"n": F.lit(1)}),
    "leave_out_for": lambda d: panel.leave_out_for(d.select("k", "fam").distinct(), d, ["k"], "fam", {"n": F.lit(1)}),
    "quantile": lambda d: ranks.empirical_quantile(d, d.where("v > 2"), ["k"], "v"),
    "percentile": lambda d: panel.leave_one_out_linear_percentile(d, ["k"], "v", 0.3, F.col("v") > 2, "p"),
    "nearest_rank": lambda d: panel.leave_one_out_percentile(d, ["k"], "fam", "v", 0.9, 2, 2),
    "impute": lambda d: me.impute(d, "k", "v"),
    "auc": lambda d: ranks.auc(d.withColumn("l", (F.col("y") > 1).cast("int")), ["k"], "v", "l"),
}


@pytest.mark.parametrize("name", CASES)
def test_null_keys_stay(rows, named, name):
    same(CASES[name](rows), CASES[name](named), ("k", "fam"))


def test_null_values_stay(spark):
    d = spark.createDataFrame([(1, 2.0), (2, None), (3, 4.0)], "i int, v double")
    assert sorted((r.i, r.b) for r in es.quantile_bins(d, "v", 2, "b").collect() if r.v is not None) == [(1, 0), (3, 1)]
    assert es.quantile_bins(d, "v", 2, "b").count() == 3
    q = ranks.empirical_quantile(d.withColumn("k", F.lit(None).cast("int")), d.withColumn("k", F.lit(None).cast("int")), ["k"], "v")
    assert {r.i: r.q for r in q.collect()} == {1: 0.0, 2: None, 3: 0.5}


def test_null_regions_keep_their_controls(spark):
    d = spark.createDataFrame([(r, s, float(s * s % 7)) for r in (None, 1) for s in range(6)], "region_id int, sample_id int, b double")
    got = es.loo_regions(d, F.col("sample_id") < 5).collect()
    by = {r: sorted((x.sample_id, round(x.mu, 9), round(x.sd, 9), round(x.p5, 9)) for x in got if x.region_id == r) for r in (None, 1)}
    assert by[None] == by[1] and len(by[1]) == 6
