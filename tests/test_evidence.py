import pytest
from pyspark.sql import functions as F

from heredium.plans import clinical
from heredium.plans import evidence as ev

QUIET = {"F1": (0, 12), "F2": (0, 12), "M1": (0, 12), "M2": (0, 12)}


def row(spark, C1=(10, 0), C2=(0, 10), un=(0, 0), hap1="P", f_hap=1, m_hap=1, **parents):
    p = QUIET | parents
    cells = {"C1": C1, "C2": C2, "C_un": un, "F_un": (0, 0), "M_un": (0, 0), **p}
    vals = {f"{k}_{n}": v for k, (a, r) in cells.items() for n, v in (("dp", a + r), ("alt", a), ("ref", r))}
    cols = [F.lit(v).cast("long").alias(k) for k, v in vals.items()]
    return spark.range(1).select(*cols, F.lit(hap1).cast("string").alias("child_hap1_is"), F.lit(f_hap).cast("int").alias("f_hap"), F.lit(m_hap).cast("int").alias("m_hap"))


CASES = [
    (dict(), "germline_DNM_phased", 6), (dict(C2=(5, 5)), "phase_conflict_artifact", None), (dict(F1=(4, 8), M1=(4, 8)), "phase_conflict_artifact", None),
    (dict(F1=(6, 6)), "inherited_missed_in_parent", None), (dict(F1=(4, 20)), "parental_mosaic_transmitted", None), (dict(F1=(2, 8)), "inconclusive", None),
    (dict(C1=(2, 10)), "inconclusive", None), (dict(C1=(10, 8)), "child_postzygotic_mosaic", None), (dict(C1=(3, 4)), "inconclusive", None),
    (dict(f_hap=None), "germline_DNM_unphased", None), (dict(M2=(0, 2)), "germline_DNM_unphased", None), (dict(hap1=None), "germline_DNM_unphased", None)]


@pytest.mark.parametrize("kw,cls,score", CASES)
def test_phase_class_branches(spark, kw, cls, score):
    r = ev.phase_class(ev.origin(ev.features(row(spark, **kw)))).first()
    assert r.phase_class == cls
    if score is not None:
        assert r.rule_score == score


@pytest.mark.parametrize("kw,origin,reason", [
    (dict(), "paternal", "OK"), (dict(hap1="M"), "maternal", "OK"), (dict(C1=(4, 0), C2=(4, 0)), "undetermined", "ALT_ON_BOTH_CHILD_HAPLOTYPES"), (dict(C1=(1, 9), C2=(1, 9)), "undetermined", "TIED_ALT_READS"),
    (dict(C1=(0, 9)), "undetermined", "NO_TAGGED_ALT_READS"), (dict(hap1=None), "undetermined", "CHILD_BLOCK_UNORIENTED"), (dict(f_hap=None), "paternal", "OK_TRANSMITTED_HAP_UNRESOLVED")])
def test_origin_reasons(spark, kw, origin, reason):
    r = ev.origin(ev.features(row(spark, **kw))).first()
    assert (r.parent_of_origin, r.poo_reason) == (origin, reason)


def test_origin_cleared_near_switch(spark):
    r = ev.reclassify(row(spark).withColumn("dist_switch", F.lit(40_000))).first()
    assert r.parent_of_origin == "undetermined" and r.poo_reason.startswith("PHASE_SWITCH_RISK") and r.poo_confidence is None
    assert ev.reclassify(row(spark).withColumn("dist_switch", F.lit(60_000))).first().parent_of_origin == "paternal"


@pytest.mark.parametrize("kw,best", [(dict(), "germline"), (dict(F1=(10, 0)), "inherited"), (dict(C1=(10, 10)), "child_mosaic"), (dict(C1=(5, 5), C2=(5, 5), F1=(4, 4), M1=(4, 4), F2=(5, 5), M2=(4, 5)), "artefact")])
def test_posterior_prefers_the_generating_hypothesis(spark, kw, best):
    r = ev.posterior(ev.features(row(spark, **kw))).first().asDict()
    post = {h: r[f"post_{h}"] for h in ev.PRIOR}
    assert max(post, key=post.get) == best and sum(post.values()) == pytest.approx(1)


BASE = dict(phase_class="germline_DNM_phased", variant_class="SNV", rf_q=0.995, flags="", rule_score=6, hap_obs_k5=6, phase_score=0.95, delta_units=5, gnomad_af=None, catalog_af=None, founder_recurrence=0, cohort_ac_loo=0, mask_overlap=0)
DECISIONS = [
    (dict(), "TIER1", "YES"), (dict(rf_q=0.96), "TIER2", "CANDIDATE"), (dict(rf_q=0.9), "BELOW_TAU", "NO"), (dict(phase_class="inconclusive"), "RF_UNSUPPORTED:inconclusive", "NO"),
    (dict(phase_class="inherited_missed_in_parent"), "DEMOTED:inherited_missed_in_parent", "NO"), (dict(phase_class="child_postzygotic_mosaic"), "MOSAIC:child_postzygotic_mosaic", "NO"),
    (dict(gnomad_af=0.01), "RULES:gnomad", "NO"), (dict(mask_overlap=1, cohort_ac_loo=1), "RULES:cohort+mask", "NO"), (dict(variant_class="SV", rf_q=0.5, flags="SV_DEPTH_EVIDENCE"), "TIER1_SV_DEPTH", "YES"),
    (dict(variant_class="SV", mask_overlap=1), "TIER1", "YES"), (dict(variant_class="TR", rf_q=0.998, delta_units=2), "TIER2_TR_SIZE", "NO"), (dict(variant_class="TR", rf_q=0.995), "BELOW_TAU", "NO"),
    (dict(rf_q=None), "PHASE_ONLY", "YES"), (dict(rf_q=None, phase_score=0.5), "LOW_POSTERIOR", "NO"), (dict(rf_q=None, hap_obs_k5=5), "HAP_UNOBSERVED", "NO"), (dict(rf_q=None, phase_class="germline_DNM_unphased"), "NOT_PHASED_GERMLINE", "NO")]


def test_decision_table(spark):
    schema = "i int, phase_class string, variant_class string, rf_q double, flags string, rule_score int, hap_obs_k5 int, phase_score double, delta_units int, gnomad_af double, catalog_af double, founder_recurrence int, cohort_ac_loo int, mask_overlap int"
    d = spark.createDataFrame([(i, *(BASE | kw).values()) for i, (kw, _, _) in enumerate(DECISIONS)], schema)
    got = {r.i: (r.decision_reason, r.dnm_call) for r in ev.decide(d).collect()}
    assert got == {i: (why, call) for i, (_, why, call) in enumerate(DECISIONS)}


SV = dict(svtype="DEL", length=20000, phase_class="germline_DNM_phased", cohort_ac_loo=0, founder_recurrence=0, mask_overlap=0.0, parent_junction=0, f_ratio=1.0, m_ratio=1.0, sv_ratio=0.5, junction_both_ends=1, child_junction=5, child_support=5, het_persistence=0.0, rule_score=6, rf_q=None)
VERDICTS = [(dict(), "PASS"), (dict(f_ratio=0.5), "FAIL"), (dict(parent_junction=2), "FAIL"), (dict(mask_overlap=0.6), "FAIL"), (dict(het_persistence=0.9), "REVIEW"), (dict(sv_ratio=0.95, het_persistence=0.9), "FAIL"),
            (dict(svtype="DUP", sv_ratio=1.5, het_persistence=0.9), "PASS"), (dict(svtype="DUP", sv_ratio=1.0), "REVIEW"), (dict(svtype="INS", sv_ratio=None), "PASS"), (dict(svtype="INS", sv_ratio=None, rule_score=1, child_support=0, child_junction=0), "FAIL"),
            (dict(junction_both_ends=0, het_persistence=None), "REVIEW"), (dict(sv_ratio=0.95, junction_both_ends=0, het_persistence=0.1), "FAIL")]


def test_sv_quality(spark):
    schema = "i int, svtype string, length int, phase_class string, cohort_ac_loo int, founder_recurrence int, mask_overlap double, parent_junction int, f_ratio double, m_ratio double, sv_ratio double, junction_both_ends int, child_junction int, child_support int, het_persistence double, rule_score int, rf_q double"
    d = spark.createDataFrame([(i, *(SV | kw).values()) for i, (kw, _) in enumerate(VERDICTS)], schema)
    assert {r.i: r.quality_verdict for r in clinical.sv_quality(d).collect()} == {i: v for i, (_, v) in enumerate(VERDICTS)}
