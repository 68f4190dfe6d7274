"""Transmission arms, gene flags and age fits on rows small enough to count by hand."""

from pyspark.sql import functions as F

from heredium.functions import rules
from heredium.plans import burden, clinical, phenotype

WIDE = "symbol string, chrom string, pos long, affected int, rare boolean, c_a1 int, c_a2 int, f_a1 int, f_a2 int, m_a1 int, m_a2 int, " + ", ".join(f"{r}_{x} int" for r in "cfm" for x in ("gq", "dp"))


def meiosis(symbol, affected, rare, parent, transmitted):
    f, m = ((0, 1), (0, 0)) if parent == "father" else ((0, 0), (0, 1))
    return (symbol, "chr1", 5, affected, rare, 0, int(transmitted), *f, *m, *[30] * 6)


def test_arms(spark):
    rows = [meiosis("A", 1, True, "mother", True)] * 3 + [meiosis("A", 1, False, "mother", False), meiosis("A", 1, None, "father", True), meiosis("A", 0, True, "mother", False), meiosis("A", None, True, "mother", True)]
    rows += [meiosis("B", 1, True, "father", False)] * 2 + [meiosis("C", 1, True, "father", True), meiosis("C", 1, True, "mother", False)]
    genes = spark.createDataFrame([("A", "Maternal", 0.3, None), ("B", "Paternal", None, "flagged"), ("C", "Isoform", 0.1, None), ("D", "Paternal", 0.3, None)], "symbol string, expressed string, s_het double, flag string")
    arms = burden.expressed_arms(spark.createDataFrame(rows, WIDE), genes, F.col("rare"))
    got = {(r.symbol, r.tested, r.variant_set): tuple(r[a] for a in burden.ARMS) for r in arms.collect()}
    assert len(got) == 15                                                    # A, B, D once and C from either parent, three sets each
    assert got["A", "mother", "rare"] == (3, 0, 0, 0, 0, 1) and got["A", "mother", "common"] == (0, 1, 1, 0, 0, 0) and got["A", "mother", "all"] == (3, 1, 1, 0, 0, 1)
    assert got["C", "father", "rare"] == (1, 0, 0, 1, 0, 0) and got["D", "father", "all"] == (0,) * 6
    ranked = {(r.symbol, r.tested): (r["rank"], r.n_tests, round(r.p, 6), round(r.bonferroni_p, 6)) for r in burden.ranked_arms(arms).collect()}
    assert ranked == {("A", "mother"): (1, 4, 0.25, 1.0), ("B", "father"): (2, 4, 0.5, 1.0), ("C", "father"): (3, 4, 1.0, 1.0), ("C", "mother"): (3, 4, 1.0, 1.0)}
    tiers = {(r.variant_set, r.tier): (r.n_genes, r.excluded, r.t, r.nt, r.p) for r in burden.collapsed_arms(arms).collect()}
    assert tiers["rare", "lof_t1"][:4] == (2, "", 3, 0) and tiers["rare", "lof_t3"] == (0, "B", 0, 0, None) and tiers["all", "all_tiers"][:4] == (2, "B", 3, 1)
    empty = burden.expressed_arms(spark.createDataFrame([], WIDE), genes, F.col("rare"))
    assert burden.ranked_arms(empty).count() == 0 and burden.collapsed_arms(empty.where("symbol = 'D'")).where("p IS NULL").count() == 6


def test_gene_flags_and_order(spark):
    s = lambda *g: spark.createDataFrame([(x,) for x in g], "symbol string")
    flags = clinical.gene_flags([[("SFARI_hc", s("A")), ("SFARI", s("A", "B", "B"))], [("TIER1_GENE", s("B", "C"))]])
    assert {r.symbol: r.gene_flags for r in flags.collect()} == {"A": "SFARI_hc", "B": "SFARI;TIER1_GENE", "C": "TIER1_GENE"}
    rows = spark.createDataFrame([("SNV", 1, "A"), ("SV_DEL", 2, "A"), ("TR", 1, "C"), ("SV_DUP", 9, "B"), ("SNV", 1, "X")], "class string, family_id long, symbol string")
    d = clinical.priority_list(rows, flags, "TIER1_GENE", ("SFARI_hc",))
    assert [(r["class"], r.symbol) for r in d.collect()] == [("SV_DUP", "B"), ("TR", "C"), ("SV_DEL", "A"), ("SNV", "A")]


def test_age_fits(spark):
    calls = [("x", "paternal")] + [("y", "paternal")] * 3 + [("y", "maternal"), ("z", None)] + [("z", "paternal")] * 5 + [("w", "paternal")]
    ages = spark.createDataFrame([("x", 20.0, 30.0), ("y", 30.0, 20.0), ("z", 40.0, 25.0), ("w", None, 25.0), ("v", 40.0, 25.0)], "child_id string, father_age double, mother_age double")
    got = {(r.source, r.origin, r.age_of): r for r in phenotype.origin_age_fits(spark.createDataFrame(calls, "child_id string, s string"), ages, ["s"]).collect()}
    assert len(got) == 4 and all(r.n == 3 for r in got.values())
    own = got["s", "paternal", "father"]
    assert (own.n_calls, round(own.r, 9), round(own.slope, 9)) == (9, 1.0, 0.2)
    assert got["all", "any", "father"].n_calls == 11 and round(got["s", "maternal", "father"].r, 9) == 0.0
    flat = phenotype.origin_age_fits(spark.createDataFrame([("x", None)], "child_id string, s string"), ages, ["s"]).collect()
    assert all(r.r == 0 and r.slope == 0 for r in flat)


def test_ages_all_alike_have_no_slope(spark):
    ages = spark.createDataFrame([("x", 30.0, 25.0), ("y", 30.0, 27.0)], "child_id string, father_age double, mother_age double")
    calls = spark.createDataFrame([("x", "paternal"), ("x", "maternal"), ("y", "maternal"), ("y", "maternal")], "child_id string, s string")
    got = {(r.origin, r.age_of): (r.n, r.n_calls, r.r, r.slope) for r in phenotype.origin_age_fits(calls, ages, ["s"]).collect()}
    assert got["paternal", "father"] == (2, 1, 0, 0) and got["maternal", "father"] == (2, 3, 0, 0) and got["any", "father"] == (2, 4, 0, 0)
    assert tuple(round(x, 9) for x in got["maternal", "mother"]) == (2, 3, 1, 0.5)


def test_relevance(spark):
    rows = [(1, "coding_LoF", None), (2, "UTR_loss", 0.5), (3, "frameshift_variant", None), (4, "intronic", 0.5), (9, "stop_gained", 0.18), (9, "stop_gained", 0.1), (9, "missense", 0.9), (1, None, None), (2, "coding_duplication(gain,flag)", None)]
    d = spark.createDataFrame(rows, "r int, i string, s double").select(rules.clinical_relevance(F.col("r"), F.col("i"), F.col("s")).alias("x"))
    assert [r.x.split(":")[0] for r in d.collect()] == ["HIGH", "MODERATE", "MODERATE", "LOW", "MODERATE", "NONE", "NONE", "LOW", "HIGH"]
