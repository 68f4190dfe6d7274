import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from heredium.functions import genotype as g
from heredium.functions import numeric as nm
from heredium.functions import reads as rd
from heredium.functions import rules
from heredium.operators import panel, ranks
from heredium.operators import regression as rg


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


@pytest.mark.parametrize("pos,ref,alt,want", [
    (100, "GAT", "GT", (101, "A", "")), (101, "AT", "T", (101, "A", "")), (5, "A", "G", (5, "A", "G")), (5, "ca", "cg", (6, "A", "G")),
    (7, "A", "AT", (8, "", "T")), (7, "ACGT", "ACGT", (11, "", "")), (7, "TTT", "T", (8, "TT", ""))])
def test_canonical_allele(spark, pos, ref, alt, want):
    c = one(spark, g.canonical_allele(F.lit(pos), F.lit(ref), F.lit(alt))).c0
    assert (c.pos, c.ref, c.alt) == want


@pytest.mark.parametrize("gt,alleles,phased,zyg", [("0|1", [0, 1], True, "het"), ("1/1", [1, 1], False, "hom_alt"), ("./1", None, False, "missing"), ("0", [0], False, "hom_ref"), ("1", [1], False, "hemizygous"), (".", None, False, "missing")])
def test_genotype_text(spark, gt, alleles, phased, zyg):
    p = g.parse_gt(F.lit(gt))
    r = one(spark, p["alleles"], p["phased"], g.zygosity(p["alleles"]))
    assert (r.c0, r.c1, r.c2) == (alleles, phased, zyg)


@pytest.mark.parametrize("a,b,fa,mo,want", [(0, 1, [0, 0], [1, 1], 1), (1, 0, [0, 0], [0, 1], -1), (0, 1, [0, 1], [0, 1], 0), (0, 1, [0, 0], [0, 0], None)])
def test_mendel_vote(spark, a, b, fa, mo, want):
    assert one(spark, g.mendel_vote(F.lit(a), F.lit(b), F.array(*map(F.lit, fa)), F.array(*map(F.lit, mo)))).c0 == want


def test_sex_rules(spark):
    r = one(spark, g.skip_for_phasing(F.lit("chrX"), F.lit(5_000_000), F.lit("M")), g.skip_for_phasing(F.lit("chrX"), F.lit(20_000), F.lit("M")), g.skip_for_phasing(F.lit("chrX"), F.lit(5_000_000), F.lit("F")), g.normalise_sex(F.lit(" Male ")), g.rare(F.lit(None).cast("double"), 0.001))
    assert list(r) == [True, False, False, "M", True]


def test_cigar_functions(spark):
    ops = rd.placed(rd.parse_cigar(F.lit("3S5M2D4M1I3M")), F.lit(100))
    seq = F.lit("SSSACGTAGGGGTCCC")
    r = one(spark, rd.base_at(ops, seq, F.lit(101)), rd.base_at(ops, seq, F.lit(105)), rd.base_at(ops, seq, F.lit(106)), rd.base_at(ops, seq, F.lit(108)), rd.base_at(ops, seq, F.lit(112)), rd.indel_at(ops, F.lit(105), 0), rd.aligned_at(ops, F.lit(105)), rd.aligned_at(ops, F.lit(107)), rd.base_at(ops, seq, F.lit(99)))
    assert list(r)[:5] == ["A", "A", None, "G", "C"] and (r.c5.op, r.c5.len) == ("D", 2) and list(r)[6:] == [False, True, None]


def sig(spark, cigar, start, end, sa, svtype, svlen, bp):
    parts = F.array(*[F.struct(F.lit(c).alias("chrom"), F.lit(p).alias("pos"), F.lit(x).alias("cigar")) for c, p, x in sa]) if sa else F.lit(None).cast("array<struct<chrom:string,pos:int,cigar:string>>")
    return one(spark, rd.junction_signature(rd.placed(rd.parse_cigar(F.lit(cigar)), F.lit(start)), F.lit(start), F.lit(end), F.lit("chr1"), parts, F.lit(svtype), F.lit(svlen), F.lit(bp[0]), F.lit(bp[1]))).c0


def test_junction_signature(spark):
    assert sig(spark, "1000M5000D1000M", 9000, 16000, [], "DEL", -5000, (10000, 15000))
    assert not sig(spark, "1000M900D1000M", 9000, 11900, [], "DEL", -5000, (10000, 15000))
    assert not sig(spark, "1000M5000I1000M", 9000, 11000, [], "DEL", -5000, (10000, 15000))
    assert sig(spark, "8000M4000S", 2000, 10000, [("chr1", 45000, "4000M")], "DEL", -35000, (10000, 45000))
    assert not sig(spark, "8000M4000S", 2000, 10000, [("chr2", 45000, "4000M")], "DEL", -35000, (10000, 45000))
    assert not sig(spark, "8000M4000S", 2000, 10000, [("chr1", 10100, "50M")], "DEL", -35000, (10000, 45000))


def test_repeat_support_tolerance(spark):
    s = lambda n: rd.support_tr(F.lit(n), F.lit(50), F.array(F.lit(44)), F.lit(10))
    assert list(one(spark, s(50), s(52), s(47), s(44), s(42), s(30))) == ["ALT", "ALT", "AMB", "REF", "REF", "AMB"]


def test_sequence_context(spark):
    r = one(spark, rd.homopolymer_run(F.lit("GAAAAT"), F.lit(3)), rd.base_entropy(F.lit("ACGTACGT")), rd.base_entropy(F.lit("AAAA")), rd.is_cpg(F.lit("TACGT"), F.lit(4)), rd.is_cpg(F.lit("TACT"), F.lit(1)))
    assert list(r) == [4, 2.0, 0.0, True, False]


def test_repeat_class(spark):
    v = lambda c, rec=False, d=False: rules.repeat_class(F.array(*map(F.lit, c)), F.lit(rec), F.lit(d), F.lit(60), F.lit(40), F.lit(30))["verdict"]
    assert list(one(spark, v([20, 70]), v([20, 70], True), v([45]), v([35]), v([0, 0], d=True))) == ["PATHOGENIC_RANGE", "benign", "INTERMEDIATE", "unclassified", "benign"]


def test_lgamma_and_tests(spark):
    for x in (1.0, 2.5, 10.0, 333.0, 1e6):
        assert one(spark, nm.lgamma(F.lit(x))).c0 == pytest.approx(math.lgamma(x), rel=1e-12, abs=1e-12)
    for t, n in ((3, 10), (5, 10), (0, 7), (480, 1000)):
        pm = [math.comb(n, i) / 2**n for i in range(n + 1)]
        r = one(spark, nm.binom_doubled_tail(F.lit(t), F.lit(n)), nm.binom_min_likelihood(F.lit(t), F.lit(n)))
        assert r.c0 == pytest.approx(min(1, 2 * sum(pm[: min(t, n - t) + 1])), rel=1e-9)
        assert r.c1 == pytest.approx(min(1, sum(p for p in pm if p <= pm[t] * (1 + 1e-7))), rel=1e-9)
    a, b, c, d = 3, 9, 11, 4
    tot = math.comb(a + b + c + d, a + b)
    ps = {x: math.comb(a + c, x) * math.comb(b + d, a + b - x) / tot for x in range(max(0, a + b - b - d), min(a + b, a + c) + 1)}
    assert one(spark, nm.fisher_two_sided(*map(F.lit, (a, b, c, d)))).c0 == pytest.approx(sum(p for p in ps.values() if p <= ps[a] * (1 + 1e-7)), rel=1e-9)
    for z in (0.0, 0.3, 1.96, 4.5, 9.0):
        assert one(spark, nm.normal_two_sided(F.lit(z))).c0 == pytest.approx(math.erfc(z / math.sqrt(2)), rel=1e-8)


def test_large_binomial_is_cheap_and_finite(spark):
    assert 0 < one(spark, nm.binom_doubled_tail(F.lit(499_000), F.lit(1_000_000))).c0 < 0.05


def test_genotype_likelihood(spark):
    r = [one(spark, nm.genotype_likelihood(F.lit(a), F.lit(b))).c0.gt for a, b in ((20, 0), (10, 10), (0, 20), (0, 0))]
    assert r == ["0/0", "0/1", "1/1", "./."]


def test_ranks_against_numpy(spark):
    r = random.Random(3)
    data = [("hot" if r.random() < 0.8 else "k", float(r.randrange(40)), int(r.random() < 0.4)) for _ in range(600)]
    d = spark.createDataFrame(data, "k string, v double, y int")
    got = {(x.k, x.v): x for x in ranks.average_rank(d, ["k"], "v").collect()}
    for k in ("hot", "k"):
        v = np.sort([x[1] for x in data if x[0] == k])
        for u in set(v):
            at = np.where(v == u)[0] + 1
            assert got[k, u].avg_rank == at.mean() and got[k, u].cnt == len(at)
    q = ranks.linear_percentile(d, ["k"], "v", {"p": 0.3}).collect()
    assert {x.k: x.p for x in q} == pytest.approx({k: np.percentile([x[1] for x in data if x[0] == k], 30) for k in ("hot", "k")})
    a = {x.k: x.roc_auc for x in ranks.auc(d, ["k"], "v", "y").collect()}
    for k in ("hot", "k"):
        p, n = [x[1] for x in data if x[0] == k and x[2]], [x[1] for x in data if x[0] == k and not x[2]]
        assert a[k] == pytest.approx(np.mean([(i > j) + 0.5 * (i == j) for i in p for j in n]))


def test_benjamini_hochberg_monotone(spark):
    p = [0.01, 0.02, 0.03, 0.04, 0.5, 0.04]
    d = spark.createDataFrame([(x,) for x in p], "p double")
    got = {r.p: r.q for r in ranks.benjamini_hochberg(d, [], "p").collect()}
    assert got == pytest.approx({0.01: 0.048, 0.02: 0.048, 0.03: 0.048, 0.04: 0.048, 0.5: 0.5})


def test_leave_one_out_percentiles(spark):
    r = random.Random(9)
    vals = [(i, round(r.random(), 3), i % 4 != 0) for i in range(15)] + [(90, 0.5, True), (91, 0.5, True)]
    d = spark.createDataFrame(vals, "i int, v double, ctl boolean").withColumn("k", F.lit(1))
    out = panel.leave_one_out_linear_percentile(d, ["k"], "v", 0.05, F.col("ctl"), "p")
    for row in out.collect():
        pool = [v for i, v, c in vals if c and i != row.i]
        assert row.p == pytest.approx(np.percentile(pool, 5))


def test_leave_family_out_histogram(spark):
    r = random.Random(4)
    data = [(1, i % 6, r.randrange(20, 30)) for i in range(40)]
    d = spark.createDataFrame(data, "site int, fam int, v int")
    for row in panel.leave_one_out_percentile(d, ["site"], "fam", "v", 0.99, 10, 5).collect():
        rest = sorted(v for _, f, v in data if f != row.fam)
        assert row.pct_loo == rest[math.ceil(0.99 * len(rest)) - 1] and row.max_loo == rest[-1]


def test_second_family_is_left_out_once(spark, rows):
    d = spark.createDataFrame([(1, 1, 5), (1, 2, 3), (1, 3, 1)], "site int, fam int, n int")
    q = spark.createDataFrame([(1, 1, 2), (1, 1, 1), (1, 9, 3), (2, 1, 2)], "site int, fam int, fam2 int")
    got = panel.leave_out_for(q, d, ["site"], "fam", {"n": F.col("n")}, "fam2")
    assert rows(got, "site", "fam", "fam2", "n_loo") == [(1, 1, 1, 4), (1, 1, 2, 1), (1, 9, 3, 8), (2, 1, 2, 0)]


def test_regressions(spark):
    r = np.random.default_rng(1)
    x, c = r.normal(size=60), r.normal(size=60)
    y = 2 + 0.7 * x - 0.3 * c + 0.2 * r.normal(size=60)
    d = spark.createDataFrame([(1, float(a), float(b), float(v)) for a, b, v in zip(x, c, y)], "k int, x double, c double, y double")
    f = rg.ols(d, ["k"], "y", ["x", "c"]).first()
    m = np.column_stack([np.ones(60), x, c])
    beta, rss, *_ = np.linalg.lstsq(m, y, rcond=None)
    assert list(f.coef) == pytest.approx(list(beta)) and f.se == pytest.approx(math.sqrt(rss[0] / 57 * np.linalg.inv(m.T @ m)[1, 1]))
    assert rg.t_two_sided(np.array([2.0, 0.5]), np.array([10.0, 3.0])) == pytest.approx([0.0733880, 0.6514379], rel=1e-4)
    w = spark.createDataFrame([(1, float(a), float(b), float(0.7 * a + 0.3 * b)) for a, b in r.random((50, 2))], "k int, a double, b double, y double")
    fr = rg.nnls(w, ["k"], "y", ["a", "b"]).first()
    assert (fr.a, fr.b) == pytest.approx((0.7, 0.3), abs=1e-4)


def test_conditional_logistic_matches_pair_odds(spark):
    # discordant pairs 1:1 with a binary exposure: beta = log(b / c)
    data = []
    for i in range(30):
        hit = i < 20
        data += [(1, i, 1, int(hit)), (1, i, 0, int(not hit))]
    f = rg.conditional_logistic(spark.createDataFrame(data, "k int, fam int, case int, x int"), ["k"], "fam", "case", "x").first()
    assert f.n_strata == 30 and f.beta == pytest.approx(math.log(2), rel=1e-6)
