"""Resampling vectors, exact conditional fits, active sets and folds against brute force."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from heredium.operators import regression as rg
from heredium.operators import resampling as rs
from heredium.plans import episignature as es
from heredium.plans import learning as ml


def test_conditional_logistic_equals_enumeration(spark):
    rng = np.random.default_rng(3)
    strata = []
    for s in range(25):
        n, m = int(rng.integers(3, 7)), int(rng.integers(1, 3))
        x = np.column_stack((rng.integers(0, 3, n), rng.normal(size=n) * 100, rng.random(n)))
        strata.append((x, rng.permutation(n) < m))
    data = [("k", s, int(c), float(a), float(b), float(d)) for s, (x, cases) in enumerate(strata) for (a, b, d), c in zip(x, cases)]
    data += [("k", 900, 1, None, 1.0, 1.0), ("k", 901, 1, 1.0, 1.0, 1.0), ("k", 902, 1, 1.0, 2.0, 3.0), ("k", 902, 0, 1.0, 2.0, 3.0)]
    df = spark.createDataFrame(data, "key string, s int, c int, x1 double, x2 double, x3 double")
    got = {r.covariate: r for r in rg.conditional_logistic(df, ["key"], "s", "c", ["x1", "x2", "x3"]).collect()}
    beta = np.array([got[f"x{i}"].beta for i in (1, 2, 3)])

    def moments(b):
        grad, info = np.zeros(3), np.zeros((3, 3))
        for x, cases in strata:
            sums = np.array([x[list(i)].sum(0) for i in itertools.combinations(range(len(x)), int(cases.sum()))])
            w = np.exp(sums @ b - (sums @ b).max())
            w /= w.sum()
            mean = w @ sums
            grad += x[cases].sum(0) - mean
            info += (sums - mean).T @ ((sums - mean) * w[:, None])
        return grad, info

    grad, info = moments(beta)
    scale = np.sqrt(np.diag(info))
    assert np.abs(grad / scale).max() < 1e-6                             # the likelihood is flat there
    assert [got[f"x{i}"].se for i in (1, 2, 3)] == pytest.approx(np.sqrt(np.diag(np.linalg.inv(info))), rel=1e-6)
    assert got["x1"].n_strata == 25


def test_conditional_logistic_wide_exposures(spark):
    data = [("k", s, c, x) for s in range(40) for c, x in ((1, 1e6 * (s % 5)), (0, 1e6 * ((s * 3) % 7)), (0, -2e6))]
    r = rg.conditional_logistic(spark.createDataFrame(data, "key string, s int, c int, x double"), ["key"], "s", "c", "x").first()
    assert math.isfinite(r.beta) and r.se > 0
    same = spark.createDataFrame([("k", s, int(i == s % 2), float(i), 2.0 * i) for s in range(9) for i in range(2)], "key string, s int, c int, x double, y double")
    assert all(r.se is None for r in rg.conditional_logistic(same, ["key"], "s", "c", ["x", "y"]).collect())


def test_nnls_meets_the_optimality_conditions():
    rng = np.random.default_rng(8)
    for _ in range(200):
        n, k = int(rng.integers(5, 40)), int(rng.integers(1, 8))
        x, y = rng.random((n, k)), rng.normal(size=n) + 0.3
        w = rg._active_set(x.T @ x, x.T @ y)
        grad = x.T @ y - x.T @ x @ w
        assert (w >= 0).all() and grad.max() < 1e-8 and np.abs(grad[w > 0]).max(initial=0) < 1e-8


def test_t_tail_against_integration():
    for df in (1, 2, 5, 30, 400):
        t = np.array([0.0, 0.3, 1.0, 2.5, 8.0])
        grid = np.linspace(-60, 60, 2_000_001)
        dens = np.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / np.sqrt(df * np.pi) * (1 + grid ** 2 / df) ** (-(df + 1) / 2)
        inside = np.array([np.trapezoid(dens[np.abs(grid) <= x], grid[np.abs(grid) <= x]) if x else 0.0 for x in t])
        assert rg.t_two_sided(t, np.full(5, float(df))) == pytest.approx(1 - inside, abs=2e-4)
    z = np.array([0.1, 0.5, 1, 3.7, 14, 99, 1e4])
    assert rg._lgamma(z) == pytest.approx([math.lgamma(x) for x in z], rel=1e-13, abs=1e-13)


def test_weights_are_draws_with_replacement(spark, monkeypatch):
    w = {r.i: r.w for r in rs.bootstrap_weights(spark.createDataFrame([(i,) for i in range(17)], "i long"), "i", 50, 3).collect()}
    m = np.array([w[i] for i in range(17)])
    assert m.shape == (17, 50) and (m.sum(0) == 17).all() and 0.25 < (m == 0).mean() < 0.5


def test_matched_null_equals_a_loop(spark, monkeypatch):
    monkeypatch.setattr(rs, "SAMPLES", 3)                                # several blocks of samples
    monkeypatch.setattr(rs, "HELD", 200)                                 # sums are handed over often
    rng = np.random.default_rng(1)
    b = rng.random((7, 30))
    b[2, 4] = np.nan
    vals = [(s, r, None if np.isnan(b[s, r]) else float(b[s, r]), 0.5, 0.1 + 0.01 * r) for s in range(7) for r in range(30)]
    v = spark.createDataFrame(vals, "sample_id long, region_id long, b double, mu double, sd double").withColumn("p5", F.lit(0.1))
    regions = spark.createDataFrame([(st, r, float(r % 7 - 3), r % 4 if r != 9 else 77) for st in (0, 1) for r in range(st, 30, 2)], "set_id long, region_id long, target double, bin int")
    pool = spark.createDataFrame([(r % 4, r) for r in range(30)], "bin int, region_id long")
    draws = es.matched_draws(regions, pool, 40, 5)
    rows = draws.collect()
    assert len(rows) == 40 * 30                                          # a region of an empty bin draws from the whole pool
    assert all(r.region_id % 4 in {x % 4 for x in range(30)} for r in rows)
    obs = es.score_sets(v, regions.select("set_id", "region_id", "target"))
    got = {(r.sample_id, r.set_id): r for r in rs.matched_null(obs, v, draws, 40).collect()}
    seen = {(r.sample_id, r.set_id): r for r in obs.collect()}
    for (s, st), r in got.items():
        null = []
        for rep in range(1, 41):
            pick = [(x.region_id, x.target) for x in rows if x.set_id == st and x.rep == rep and not np.isnan(b[s, x.region_id])]
            d, t = np.array([b[s, i] - 0.5 for i, _ in pick]), np.array([y for _, y in pick])
            null.append((np.mean(d / np.array([0.1 + 0.01 * i for i, _ in pick])), np.corrcoef(d, t)[0, 1]))
        z, sh = np.array(null).T
        o = seen[(s, st)]
        assert r.p_mean_z == pytest.approx((np.sum(np.abs(z) >= abs(o.mean_z) - 1e-9) + 1) / 41)
        assert r.p_shape_r == pytest.approx((np.sum(sh >= o.shape_r - 1e-9) + 1) / 41)
    assert len(got) == 14


def test_bootstrap_ranks_equal_a_loop(spark, monkeypatch):
    monkeypatch.setattr(rs, "SAMPLES", 4)
    rng = np.random.default_rng(2)
    b = rng.random((11, 12))
    v = spark.createDataFrame([(s, r, float(b[s, r])) for s in range(11) for r in range(12)], "sample_id long, region_id long, b double")
    sets = spark.createDataFrame([(0, r, float(r % 5)) for r in range(12)], "set_id long, region_id long, target double")
    w = rs.bootstrap_weights(v.where("sample_id < 9"), "sample_id", 25, 4)
    weight = {r.sample_id: r.w for r in w.collect()}
    got = rs.bootstrap_ranks(rs.bootstrap_shapes(v, sets, w, F.col("sample_id") >= 9, 25)).collect()
    assert len(got) == 50
    t = np.arange(12) % 5
    for r in got:
        drawn = [s for s in range(9) for _ in range(weight[s][r.rep - 1])]
        shape = lambda own, rest: np.corrcoef(b[own] - b[rest].mean(0), t)[0, 1]
        mine = shape(r.sample_id, drawn)
        others = [shape(s, drawn[:i] + drawn[i + 1:]) for i, s in enumerate(drawn)]
        assert r.shape_r == pytest.approx(mine) and r.rank == 1 + sum(o > mine for o in others) and r.n == 10


def test_folds_balance_load(spark):
    sizes = spark.createDataFrame([(f, 1 + f % 5, f % 10 == 0) for f in range(40)], "fam int, n long, blood boolean")
    got = {r.fam: r.fold for r in ml.family_folds(sizes, "fam", 4, first="blood").collect()}
    load = [sum(1 + f % 5 for f in got if got[f] == k) for k in range(4)]
    assert len(got) == 40 and all(got[f] == 0 for f in range(0, 40, 10)) and max(load) - min(load) <= 5
    with pytest.raises(Exception, match="fewer than"):
        ml.family_folds(sizes.limit(3), "fam", 4, min_families=1).collect()


def test_sums_are_handed_over_a_bounded_part_at_a_time(monkeypatch):
    monkeypatch.setattr(rs, "TOLD", 8)
    held = rs._Sums()
    for k in range(10):
        held.at((k,), (2, 3))[:] += k
    parts = list(held.told(["k"], [rs.pa.int64()]))
    assert [p.num_rows for p in parts] == [2] * 5 and held.size == 0 and not held.by
    got = {k: np.frombuffer(v, "<f8").tolist() for p in parts for k, v in zip(p.column("k").to_pylist(), p.column("v").to_pylist(), strict=True)}
    assert got == {k: [float(k)] * 6 for k in range(10)} and list(held.told(["k"], [rs.pa.int64()])) == []
