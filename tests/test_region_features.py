"""Feature registry, cis fits by sufficient statistics, canyon extents, cell compartments."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from heredium.operators import regression as rg
from heredium.plans import features as ft
from heredium.plans import methylation as me


def test_cis_fits_equal_dense_fits(spark):
    rng = np.random.default_rng(6)
    m = [(s, r, float(rng.random()), float(s % 5), float(rng.random())) for s in range(30) for r in (1, 2)]
    m[3] = (*m[3][:2], None, *m[3][3:])
    v = [(k, "SNV" if k < 5 else "SV", s, "chr1", 1000 * k, float(rng.integers(1, 3))) for k in range(8) for s in range(30) if rng.random() < 0.3]
    meth = spark.createDataFrame(m, "sample_id long, region_id long, value double, age double, epi double")
    var = spark.createDataFrame(v, "variant_id long, arm string, sample_id long, chrom string, pos long, dosage double")
    isl = spark.createDataFrame([(1, "chr1", 2000, 4000), (2, "chr1", 6000, 7500)], "region_id long, chrom string, start long, end long")
    got = {(r.region_id, r.variant_id): r for r in me.cis_fits(var, isl, meth, ["age", "epi"], 1000, {"SNV": 2, "SV": 9}).collect()}
    carriers = {k: sum(x[0] == k for x in v) for k in range(8)}
    here = {(r, k) for r, lo, hi in ((1, 1000, 5000), (2, 5000, 8500)) for k in range(8) if lo <= 1000 * k < hi}
    present = {(r, k): sum(1 for x in v if x[0] == k and not (x[2], r) == (m[3][0], m[3][1])) for r, k in here}
    assert set(got) == {(r, k) for r, k in here if present[(r, k)] >= (2 if k < 5 else 9)} and carriers
    for (r, k), f in got.items():
        dose = {x[2]: x[5] for x in v if x[0] == k}
        rows = [(dose.get(s, 0.0), a, e, y) for s, reg, y, a, e in m if reg == r and y is not None]
        dense = rg.ols(spark.createDataFrame([(0, *x) for x in rows], "k int, d double, a double, e double, y double"), ["k"], "y", ["d", "a", "e"]).first()
        assert (f.n, f.beta, f.se, f.p) == (dense.n, pytest.approx(dense.beta), pytest.approx(dense.se), pytest.approx(dense.p))
    best = me.cis_scan(var, isl, meth, ["age", "epi"], 1000).collect()
    assert all(b.p_bonf == pytest.approx(min(1, b.p * b.n_tests)) and b.q >= b.p_bonf - 1e-12 for b in best) and best


def test_extents_stop_at_gaps_and_high_cpgs(spark):
    track = [(100, .5), (900, .05), (1000, .05), (1100, .04), (1500, .03), (1600, .6), (1700, .02), (2300, .01), (2900, .01)]
    cpg = spark.createDataFrame([(1, "chr1", p, b) for p, b in track] + [(2, "chr1", 1200, .5), (2, "chr1", 1300, .01)], "sample_id long, chrom string, pos long, beta double")
    reg = spark.createDataFrame([(7, "chr1", 800, 1400), (8, "chr1", 1500, 3000), (9, "chr1", 1550, 1650)], "region_id long, chrom string, start long, end long")
    got = {(r.sample_id, r.region_id): r.width for r in me.own_extents(cpg, reg).collect()}
    assert got == {(1, 7): 1500 - 900 + 2}                # 8: its CpG has no neighbour within the gap; 9: not low; sample 2: not low at the centre


def test_registry(spark):
    row = ("SNV", "A", "C", "chrX", 5000000, "M", 30, 20, [10, 8], [20, 0], [18, 1], [60, 0, 70], None, [40, 1, 99], '{"allele_index":1,"n_alts":2}')
    d = spark.createDataFrame([row, ("TR", *row[1:-1], '{"child_al":[20,31],"outlier_allele_idx":1,"motifs":"CAG,CA"}')],
                              "variant_class string, ref string, alt string, chrom string, start long, sex string, caller_gq int, caller_dp int, child_ad array<int>, father_ad array<int>, mother_ad array<int>, child_pl array<int>, father_pl array<int>, mother_pl array<int>, payload string")
    m = ft.matrix(d, ["start"])
    s, t = sorted(m.collect(), key=lambda r: r.variant_class)
    assert (s.child_AR, s.min_PL2, s.multiallelic, s.haploid_flag, s.indel_flag) == (10 / 9, 99, 1, 1, 0)
    assert s.min_AR == pytest.approx(18 / 2) and s.max_AR == 20 and s.child_AL_expanded is None
    assert (t.child_AL_expanded, t.child_AL_other, t.n_motifs, t.child_AR) == (31, 20, 2, None)
    assert "qd_child" not in m.columns and "gnomad_af" not in m.columns           # no source here
    r = {x.feature: x.status for x in ft.report(m).collect()}
    assert r["qd_child"] == "never_produced" and r["haploid_flag"] == "constant" and len(r) == len(ft.REGISTRY)
    safe = ft.matrix(d.withColumns({"gnomad_af": F.lit(0.1), "caller_filter": F.lit("PASS")}), ["start"], safe_only=True)
    assert not {"gnomad_af", "site_filter_fail"} & set(safe.columns)
    ft.assert_safe([c for c in safe.columns if c in ft.REGISTRY])
    with pytest.raises(ValueError, match="gnomad_af"):
        ft.assert_safe(["child_AR", "gnomad_af"])


def test_two_compartments_without_blood(spark):
    m = spark.createDataFrame([(1, "epithelium", 0.5), (1, "granulocyte", 0.45), (2, "epithelium", 0.02), (3, "other", 0.3)], "sample_id long, target string, u double")
    atlas = spark.createDataFrame([("epithelium", "epithelium", 0.95), ("epithelium", "blood", 0.05), ("granulocyte", "granulocyte", 0.9)], "target string, cell string, u double")
    got = {r.sample_id: (r.tissue_share, r.cell_share) for r in me.two_compartments(m, atlas, m.where("sample_id = 77").select("sample_id")).collect()}
    assert got == {1: (pytest.approx(0.5), pytest.approx(0.5)), 2: (0.0, None), 3: (None, None)}
    got = {r.sample_id: r.tissue_share for r in me.two_compartments(m, atlas, m.where("sample_id = 2").select("sample_id")).collect()}
    assert got[1] == pytest.approx((0.5 - 0.02) / 0.93) and got[2] == 0
