"""Six-haplotype read evidence, phase class, origin, likelihood and the final de novo decision.

Wide rows hold counts named ``C1_alt`` ... ``M2_ref`` (role C/F/M, haplotype 1/2), untagged counts ``C_un_alt`` ...,
``child_hap1_is`` (P, M or NULL) and the transmitted haplotypes ``f_hap``, ``m_hap`` (1, 2 or NULL).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numeric as nm
from ..functions import reads as rd
from ..functions import rules
from ..functions.genotype import error_allowance
from ..operators import intervals as iv
from ..storage import cut

ROWS = [f"{r}{h}" for r in "CFM" for h in (1, 2)]
PARENT_ROWS = ROWS[2:]


@dataclass(frozen=True)
class ClassParams:
    """Thresholds of the phase classes."""

    k: int = 5
    germline_frac: float = 0.8
    mosaic_frac: float = 0.7
    mosaic_depth: int = 15
    mosaic_minor: int = 3
    inherited_frac: float = 0.3
    min_alt: int = 3
    min_mapq: int = 20
    amb_frac: float = 0.3
    near_bp: int = 50000
    del_ratio: float = 0.7
    parent_ratio: float = 0.85
    het_persist: float = 0.35


def haplotype_rows(obs: DataFrame, keys: list[str], min_mapq: int = 20) -> DataFrame:
    """Long matrix: per role and haplotype (0 = untagged) depth, support, mapping quality, mismatch, clipping, allele length."""
    alt, ref = F.col("support") == "ALT", F.col("support") == "REF"
    return obs.where(F.col("mapq") >= min_mapq).groupBy(*keys, "role", "hp").agg(
        F.count("*").alias("dp"), F.count_if(alt).alias("alt"), F.count_if(ref).alias("ref"), F.count_if(~alt & ~ref).alias("amb"),
        F.avg("mapq").alias("mapq_mean"), F.avg((F.col("mapq") == 0).cast("int")).alias("mapq0_frac"),
        F.avg(F.when(alt, F.col("nm"))).alias("nm_alt"), F.avg(F.when(ref, F.col("nm"))).alias("nm_ref"),
        F.avg(F.when(alt, F.col("clipped"))).alias("clip_alt_frac"), F.avg(F.when(alt, F.col("supplementary"))).alias("supp_alt_frac"),
        F.avg("al").alias("al_mean"), F.when(F.count("al") > 1, F.stddev_pop("al")).alias("al_sd"))


def haplotype_matrix(obs: DataFrame, keys: list[str], min_mapq: int = 20) -> DataFrame:
    """Wide matrix in one hash aggregate. An unreadable read counts as depth, never as an observation."""
    aggs = []
    for role in "CFM":
        for hp, name in ((1, f"{role}1"), (2, f"{role}2"), (0, f"{role}_un")):
            here = (F.col("role") == role) & (F.col("hp") == hp)
            aggs += [F.count_if(here).alias(f"{name}_dp"), F.count_if(here & (F.col("support") == "ALT")).alias(f"{name}_alt"),
                     F.count_if(here & (F.col("support") == "REF")).alias(f"{name}_ref")]
    return obs.where(F.col("mapq") >= min_mapq).groupBy(*keys).agg(*aggs)


def majority_phase_set(obs: DataFrame, keys: list[str]) -> DataFrame:
    """Phase set most tagged reads of a role carry; ties go to the smaller set."""
    n = obs.where((F.col("hp") > 0) & F.col("ps").isNotNull()).groupBy(*keys, "role", "ps").agg(F.count("*").alias("n"))
    return n.groupBy(*keys, "role").agg(F.min_by("ps", F.struct(-F.col("n"), F.col("ps"))).alias("ps"), F.max("n").alias("n_reads"))


def _n(row: str) -> Column:
    return F.col(f"{row}_alt") + F.col(f"{row}_ref")


def _clean(row: str) -> Column:
    return F.col(f"{row}_alt") <= error_allowance(_n(row))


def _pick(first: Column, a: str, b: str, field: str) -> Column:
    return F.when(first, F.col(f"{a}_{field}")).otherwise(F.col(f"{b}_{field}"))


def features(m: DataFrame, p: ClassParams = ClassParams()) -> DataFrame:
    """Unlabelled features: the child haplotype with more alt reads is A (the first on ties), the other O."""
    a_is_1 = F.col("C1_alt") >= F.col("C2_alt")
    d = m.withColumns({f"A_{f}": _pick(a_is_1, "C1", "C2", f) for f in ("dp", "alt", "ref")} | {f"O_{f}": _pick(a_is_1, "C2", "C1", f) for f in ("dp", "alt", "ref")})
    tagged = F.col("C1_alt") + F.col("C2_alt")
    d = d.withColumns({
        "c_alt_hap_frac": F.when(_n("A") > 0, F.col("A_alt") / _n("A")), "c_alt_confined": _clean("O").cast("int"),
        "c_alt_tagged_frac": F.when(tagged + F.col("C_un_alt") > 0, tagged / (tagged + F.col("C_un_alt"))),
        "p_min_hap_dp": F.least(*[F.col(f"{r}_dp") for r in PARENT_ROWS]), "p_max_alt_any_hap": F.greatest(*[F.col(f"{r}_alt") for r in PARENT_ROWS]),
        "p_n_haps_with_alt": sum(((~_clean(r)).cast("int") for r in PARENT_ROWS), F.lit(0)),
        "p_max_alt_hap_frac": F.greatest(*[F.when(_n(r) > 0, F.col(f"{r}_alt") / _n(r)).otherwise(0.0) for r in PARENT_ROWS])})
    for k in (3, 5):
        d = d.withColumn(f"p_n_haps_obs_k{k}", sum(((_n(r) >= k).cast("int") for r in PARENT_ROWS), F.lit(0)))
        d = d.withColumn(f"hap_obs_k{k}", F.col(f"p_n_haps_obs_k{k}") + (_n("C1") >= k).cast("int") + (_n("C2") >= k).cast("int"))
    return d


def origin(d: DataFrame) -> DataFrame:
    """Parent of origin with its reason, and counts on the transmitted (T) and untransmitted (U) haplotype of that parent.

    Equal alt counts carry no information about the parent and stay undetermined.
    """
    hap1_p = F.col("child_hap1_is") == "P"
    for name, a, b in (("CP", "C1", "C2"), ("CM", "C2", "C1")):
        d = d.withColumns({f"{name}_{f}": _pick(hap1_p, a, b, f) for f in ("alt", "ref")})
    reason = (F.when(F.col("child_hap1_is").isNull(), "CHILD_BLOCK_UNORIENTED").when((F.col("CP_alt") == 0) & (F.col("CM_alt") == 0), "NO_TAGGED_ALT_READS")
              .when(~_clean("CP") & ~_clean("CM"), "ALT_ON_BOTH_CHILD_HAPLOTYPES").when(F.col("CP_alt") == F.col("CM_alt"), "TIED_ALT_READS"))
    known = reason.isNull()
    parent = F.when(known, F.when(F.col("CP_alt") > F.col("CM_alt"), "F").otherwise("M"))
    d = d.withColumns({"__why": reason, "origin_parent": parent})
    hap = F.when(F.col("origin_parent") == "F", F.col("f_hap")).when(F.col("origin_parent") == "M", F.col("m_hap"))
    d = d.withColumn("t_hap", hap)
    for f in ("alt", "ref"):
        def of(h: Column) -> Column:
            out = F.lit(None).cast("long")
            for r in PARENT_ROWS:
                out = F.when((F.col("origin_parent") == r[0]) & (h == int(r[1])), F.col(f"{r}_{f}")).otherwise(out)
            return out
        d = d.withColumns({f"T_{f}": of(F.col("t_hap")), f"U_{f}": of(3 - F.col("t_hap"))})
    on, off = F.greatest("CP_alt", "CM_alt"), F.least("CP_alt", "CM_alt")
    return d.withColumns({
        "parent_of_origin": F.when(F.col("origin_parent") == "F", "paternal").when(F.col("origin_parent") == "M", "maternal").otherwise("undetermined"),
        "poo_reason": F.coalesce("__why", F.when(F.col("t_hap").isNull(), "OK_TRANSMITTED_HAP_UNRESOLVED").otherwise("OK")),
        "poo_confidence": F.when(F.col("origin_parent").isNotNull(), on / (on + off))}).drop("__why")


def clear_near_switch(d: DataFrame) -> DataFrame:
    """Blanks an origin the phase geometry cannot support (a change point or child switch within reach)."""
    hit = F.filter(F.split("flags", ";"), lambda x: x.isin("NEAR_CHANGE_POINT_F", "NEAR_CHANGE_POINT_M", "NEAR_CHILD_SWITCH"))
    bad = (F.size(hit) > 0) & (F.col("parent_of_origin") != "undetermined")
    return d.withColumn("__bad", bad).withColumns({
        "poo_reason": F.when(F.col("__bad"), F.concat(F.lit("PHASE_SWITCH_RISK:"), F.concat_ws(",", F.array_sort(hit)))).otherwise(F.col("poo_reason")),
        "poo_confidence": F.when(~F.col("__bad"), F.col("poo_confidence")),
        "parent_of_origin": F.when(F.col("__bad"), "undetermined").otherwise(F.col("parent_of_origin"))}).drop("__bad")


def phase_class(d: DataFrame, p: ClassParams = ClassParams()) -> DataFrame:
    """Ordered rules on a row with :func:`features` and :func:`origin`; adds ``phase_class``, ``rule_score``, ``flags``.

    Distances ``dist_change_f``, ``dist_change_m``, ``dist_switch`` are used where the row has them.
    """
    yes = lambda c: F.coalesce(c, F.lit(False))
    n = lambda r: _n(r)
    frac = F.col("c_alt_hap_frac")
    t_known = F.col("t_hap").isNotNull() & (F.col("parent_of_origin") != "undetermined")
    tn, ta = F.col("T_alt") + F.col("T_ref"), F.col("T_alt")
    t_dirty, t_part = ta > error_allowance(tn), ta < p.inherited_frac * tn
    all_seen = F.lit(True)
    all_quiet = F.lit(True)
    seen_quiet = F.lit(True)
    for r in PARENT_ROWS:
        all_seen = all_seen & (n(r) >= p.k) & _clean(r)
        all_quiet = all_quiet & _clean(r)
        seen_quiet = seen_quiet & ((n(r) == 0) | _clean(r))
    mosaic_shape = yes(frac <= p.mosaic_frac) & _clean("O") & all_seen
    cls = (
        F.when((~_clean("A") & ~_clean("O")) | (F.col("p_n_haps_with_alt") >= 2), "phase_conflict_artifact")
        .when(yes(t_known & (tn >= p.k) & (ta >= F.greatest(F.lit(3.0), p.inherited_frac * tn))), "inherited_missed_in_parent")
        .when(yes(t_known & t_dirty & t_part), F.when((tn >= p.mosaic_depth) & (ta >= p.mosaic_minor), "parental_mosaic_transmitted").otherwise("inconclusive"))
        .when(F.col("A_alt") + F.col("C_un_alt") < p.min_alt, "inconclusive")
        .when(mosaic_shape, F.when((n("A") >= p.mosaic_depth) & (F.col("A_alt") >= p.min_alt) & (F.col("A_ref") >= p.mosaic_minor), "child_postzygotic_mosaic").otherwise("inconclusive"))
        .when((F.col("A_alt") >= p.min_alt) & yes(frac >= p.germline_frac) & _clean("O") & (n("A") >= p.k) & (n("O") >= p.k) & all_seen & yes(t_known & ~t_dirty), "germline_DNM_phased")
        .when(_clean("O") & seen_quiet & (frac.isNull() | (frac >= p.germline_frac) | (F.col("A_alt") + F.col("O_alt") == 0)), "germline_DNM_unphased")
        .otherwise("inconclusive"))
    score = sum((yes(c).cast("int") for c in (frac >= p.germline_frac, _clean("O"), t_known & (tn >= p.k) & ~t_dirty,
                                             t_known & (F.col("U_alt") + F.col("U_ref") >= p.k), F.col(f"hap_obs_k{p.k}") == 6, all_quiet)), F.lit(0))
    amb = F.lit(False)
    for r in ROWS:
        amb = amb | ((F.col(f"{r}_dp") >= 3) & ((F.col(f"{r}_dp") - n(r)) > p.amb_frac * F.col(f"{r}_dp")))
    near = {}
    for name, col in (("NEAR_CHANGE_POINT_F", "dist_change_f"), ("NEAR_CHANGE_POINT_M", "dist_change_m"), ("NEAR_CHILD_SWITCH", "dist_switch")):
        if col in d.columns:
            near[name] = F.col(col) <= p.near_bp
    fl = rules.flags(LOW_HAP_DEPTH=F.col(f"hap_obs_k{p.k}") < 6, AMBIGUOUS_READS=amb, CHILD_BLOCK_UNORIENTED=F.col("child_hap1_is").isNull(), **near)
    return d.withColumns({"phase_class": cls, "rule_score": score, "flags": F.concat_ws(";", fl)})


def interval_class(d: DataFrame, p: ClassParams = ClassParams()) -> DataFrame:
    """Depth-led class of deletions; rows it does not decide keep their read-led ``phase_class`` and ``rule_score``.

    Reads ``sv_ratio`` (child inside / flank), ``f_ratio``, ``m_ratio``, ``junction_both_ends``, ``het_persistence``, ``tagged_loss``.
    """
    yes = lambda c: F.coalesce(c, F.lit(False))
    r, het = F.col("sv_ratio"), F.col("het_persistence")
    fr, mr = F.col("f_ratio"), F.col("m_ratio")
    measured = fr.isNotNull() | mr.isNotNull()
    parent_low = yes(F.least(fr, mr) <= p.del_ratio)
    parents_full = measured & yes(F.least(fr, mr) >= p.parent_ratio)
    low = r <= p.del_ratio
    germ = F.when(F.col("parent_of_origin") != "undetermined", "germline_DNM_phased").otherwise("germline_DNM_unphased")
    call = F.when(r.isNotNull(), F.when(parent_low, "inherited_missed_in_parent").when(
        low & parents_full, F.when(~yes(F.col("junction_both_ends") > 0), "inconclusive").when(yes(het > p.het_persist), "child_postzygotic_mosaic").otherwise(germ)
    ).when(~low & yes(het > p.het_persist), "phase_conflict_artifact"))
    score = sum((yes(c).cast("int") for c in (low, F.col("junction_both_ends") > 0, het <= p.het_persist, parents_full, fr.isNotNull() & mr.isNotNull(),
                                             (F.coalesce("tagged_loss", F.lit(0.0)) > 0.1) | yes(r <= 0.6))), F.lit(0))
    d = d.withColumn("sv_class", call)
    flags = F.when(F.col("sv_class").isNotNull(), F.concat_ws(";", F.nullif("flags", F.lit("")), F.lit("SV_DEPTH_EVIDENCE"))).otherwise(F.col("flags"))
    return d.withColumns({"phase_class": F.coalesce("sv_class", "phase_class"), "rule_score": F.when(F.col("sv_class").isNotNull(), score).otherwise(F.col("rule_score")), "flags": flags})


def reclassify(evidence: DataFrame, p: ClassParams = ClassParams()) -> DataFrame:
    """Features, origin and class again from stored counts; reads are not needed."""
    return clear_near_switch(phase_class(origin(features(evidence, p)), p))


# Error and mis-tagging rates, grid size and prior weights of the hypotheses.
EPS, DELTA, GRID = 0.01, 0.03, 40
PRIOR = {"germline": 0.003, "inherited": 0.10, "parental_mosaic": 0.0003, "child_mosaic": 0.0005, "artefact": 0.8962}


def posterior(d: DataFrame) -> DataFrame:
    """Posterior of the five hypotheses from the counts of A, O, untagged, T/U and the other parent's two haplotypes.

    Without a known transmitted haplotype the origin parent's rows are an unordered pair; without a known origin the
    parent with more alt reads stands in. Every hypothesis covers the same rows, so binomial coefficients cancel and are left out.
    """
    f_alt, m_alt = F.col("F1_alt") + F.col("F2_alt"), F.col("M1_alt") + F.col("M2_alt")
    a_is_1 = F.col("C1_alt") >= F.col("C2_alt")
    lab = F.when(F.col("child_hap1_is").isNotNull(), F.when((F.col("child_hap1_is") == "P") == a_is_1, "F").otherwise("M"))
    d = d.withColumn("__p", F.coalesce(lab, F.when(f_alt >= m_alt, "F").otherwise("M")))
    is_f = F.col("__p") == "F"
    d = d.withColumn("__h", F.when(is_f, F.col("f_hap")).otherwise(F.col("m_hap")))
    second = F.coalesce(F.col("__h") == 2, F.lit(False))
    rows = {"A": ("A",), "O": ("O",), "N": ("C_un",)}
    cols: dict[str, Column] = {}
    for f in ("alt", "ref"):
        for name, (src,) in rows.items():
            cols[f"__{name}_{f}"] = F.col(f"{src}_{f}")
        one, two = F.when(is_f, F.col(f"F1_{f}")).otherwise(F.col(f"M1_{f}")), F.when(is_f, F.col(f"F2_{f}")).otherwise(F.col(f"M2_{f}"))
        cols[f"__T_{f}"], cols[f"__U_{f}"] = F.when(second, two).otherwise(one), F.when(second, one).otherwise(two)
        cols[f"__V_{f}"] = F.when(is_f, F.col(f"M1_{f}")).otherwise(F.col(f"F1_{f}"))
        cols[f"__W_{f}"] = F.when(is_f, F.col(f"M2_{f}")).otherwise(F.col(f"F2_{f}"))
    d = d.withColumns(cols)

    def row(r: str, prob) -> Column:
        """Log-likelihood kernel; ``prob`` is a number or a grid entry struct(lp, lq)."""
        lp, lq = (F.lit(math.log(prob)), F.lit(math.log1p(-prob))) if isinstance(prob, float) else (prob["lp"], prob["lq"])
        return F.col(f"__{r}_alt") * lp + F.col(f"__{r}_ref") * lq

    def grid(a: float, b: float, scale: float = 1.0) -> list[tuple[float, float]]:
        ps = [scale * (a + (b - a) * (i + 0.5) / GRID) for i in range(GRID)]
        return [(math.log(x), math.log1p(-x)) for x in ps]

    def entries(*cols: list[tuple[float, float]]) -> Column:
        one = lambda v: F.struct(F.lit(v[0]).alias("lp"), F.lit(v[1]).alias("lq"))
        return F.array(*[F.struct(*[one(c[i]).alias(f"g{k}") for k, c in enumerate(cols)]) for i in range(GRID)])

    hi, lo = 1 - EPS - DELTA, EPS + DELTA
    known = F.col("__h").isNotNull()

    def pair(pt, pu) -> Column:
        straight, crossed = row("T", pt) + row("U", pu), row("T", pu) + row("U", pt)
        return F.when(known, straight).otherwise(nm.log_sum_exp([straight, crossed]) - math.log(2))

    parent_mosaic, child_mosaic, shared = entries(grid(0.02, 0.5)), entries(grid(0.05, 0.8), grid(0.05, 0.8, 0.5)), entries(grid(0.0, 1.0))
    d = d.withColumns({"__child": row("A", hi) + row("O", lo) + row("N", 0.5), "__other": row("V", EPS) + row("W", EPS), "__ref": pair(EPS, EPS), "__inh": pair(hi, lo),
                       "__pm": nm.array_log_sum_exp(F.transform(parent_mosaic, lambda x: pair(x["g0"], EPS))) - math.log(GRID),
                       "__cm": nm.array_log_sum_exp(F.transform(child_mosaic, lambda x: row("A", x["g0"]) + row("N", x["g1"]))) - math.log(GRID),
                       "__ar": nm.array_log_sum_exp(F.transform(shared, lambda x: sum((row(r, x["g0"]) for r in "AONTUVW"), F.lit(0.0)))) - math.log(GRID)})
    c = F.col
    ll = {"germline": c("__child") + c("__ref") + c("__other"), "inherited": c("__child") + c("__inh") + c("__other"), "parental_mosaic": c("__child") + c("__other") + c("__pm"),
          "child_mosaic": c("__cm") + row("O", lo) + c("__ref") + c("__other"), "artefact": c("__ar")}
    d = d.withColumns({f"__ll_{h}": v for h, v in ll.items()})
    z = nm.log_sum_exp([c(f"__ll_{h}") + math.log(PRIOR[h]) for h in PRIOR])
    d = d.withColumn("__z", z)
    alts = [h for h in PRIOR if h != "germline"]
    best = F.array_max(F.array(*[F.struct(c(f"__ll_{h}").alias("v"), F.lit(-i).alias("i"), F.lit(h).alias("h")) for i, h in enumerate(alts)]))
    out = {f"post_{h}": F.exp(c(f"__ll_{h}") + math.log(PRIOR[h]) - c("__z")) for h in PRIOR}
    d = d.withColumns(out | {"best_alternative": best["h"], "log10_lr": (c("__ll_germline") - best["v"]) / math.log(10)})
    return d.withColumn("phase_score", c("post_germline")).drop(*[x for x in d.columns if x.startswith("__")])


@dataclass(frozen=True)
class FinalParams:
    """Score tiers per class and rule-layer limits."""

    tau1: tuple = (("SNV", 0.99), ("INDEL", 0.99), ("SV", 0.99), ("TR", 0.999))
    tau2: tuple = (("SNV", 0.95), ("INDEL", 0.95), ("SV", 0.97), ("TR", 0.997))
    af_max: float = 0.001
    tr_units: int = 3
    depth_rule_score: int = 6
    phase_only_score: float = 0.9


DEMOTED = ("phase_conflict_artifact", "inherited_missed_in_parent", "parental_mosaic_transmitted")
MOSAIC = ("child_postzygotic_mosaic", "parental_mosaic_transmitted")
GERMLINE = ("germline_DNM_phased", "germline_DNM_unphased")


def _by_class(pairs: tuple) -> Column:
    out = F.lit(None).cast("double")
    for k, v in pairs:
        out = F.when(F.col("variant_class") == k, v).otherwise(out)
    return out


def rules_failed(p: FinalParams = FinalParams()) -> Column:
    """Names of the failing population rules joined by '+'; unknown values pass, and the mask is only a flag for SVs."""
    bad = {"gnomad": F.col("gnomad_af") >= p.af_max, "catalog": F.col("catalog_af") >= p.af_max, "recurrence": F.col("founder_recurrence") > 0,
           "cohort": F.col("cohort_ac_loo") > 0, "mask": (F.col("mask_overlap") == 1) & (F.col("variant_class") != "SV")}
    return F.concat_ws("+", rules.flags(**bad))


def decide(d: DataFrame, p: FinalParams = FinalParams()) -> DataFrame:
    """``dnm_call`` YES / CANDIDATE / NO, ``dnm_tier`` and ``decision_reason``; score-led with a score, phase-led without."""
    cls, q = F.col("phase_class"), F.col("rf_q")
    d = d.withColumns({"__fail": rules_failed(p), "__t1": _by_class(p.tau1), "__t2": _by_class(p.tau2)})
    fails = F.col("__fail") != ""
    rule = F.concat(F.lit("RULES:"), "__fail")
    depth = (F.col("variant_class") == "SV") & F.col("flags").contains("SV_DEPTH_EVIDENCE") & cls.isin(*GERMLINE) & (F.col("rule_score") >= p.depth_rule_score)
    scored = q.isNotNull() & F.col("__t1").isNotNull()
    tier = F.when(q >= F.col("__t1"), 1).when(q >= F.col("__t2"), 2).otherwise(0)
    by_score = (F.when(tier == 0, "BELOW_TAU").when(~cls.isin(*GERMLINE), F.concat(F.lit("RF_UNSUPPORTED:"), cls))
                .when((tier == 2) & (F.col("variant_class") == "TR") & ~F.coalesce(F.col("delta_units") >= p.tr_units, F.lit(False)), "TIER2_TR_SIZE")
                .when(fails, rule).when(tier == 1, "TIER1").otherwise("TIER2"))
    by_phase = (F.when(cls != "germline_DNM_phased", "NOT_PHASED_GERMLINE").when(F.col("hap_obs_k5") < 6, "HAP_UNOBSERVED")
                .when(F.coalesce(F.col("phase_score") >= p.phase_only_score, F.lit(False)), "PHASE_ONLY").otherwise("LOW_POSTERIOR"))
    reason = (F.when(cls.isin(*DEMOTED), F.concat(F.lit("DEMOTED:"), cls)).when(cls.isin(*MOSAIC), F.concat(F.lit("MOSAIC:"), cls))
              .when(depth, F.when(fails, rule).otherwise("TIER1_SV_DEPTH")).when(scored, by_score).otherwise(by_phase))
    d = d.withColumn("decision_reason", reason)
    r = F.col("decision_reason")
    call = F.when(r.isin("TIER1", "TIER1_SV_DEPTH", "PHASE_ONLY"), "YES").when(r == "TIER2", "CANDIDATE").otherwise("NO")
    return d.withColumns({"dnm_call": call, "dnm_tier": F.when(r == "TIER2", 2).when(call == "YES", 1).otherwise(0), "call_mode": F.when(q.isNull(), "phase_only").otherwise("rf+phase"),
                          "mosaic_flag": cls.isin(*MOSAIC).cast("int")}).drop("__fail", "__t1", "__t2")


def probe_points(events: DataFrame, id_cols: list[str], window: int = 300, probe: int = 2000, points: int = 5, room: int = 200) -> DataFrame:
    """Depth probe points of each interval event: up to three windows inside, one either side, a few points per window."""
    n = F.col("end") - F.col("start")
    roomy = n - 2 * window >= room
    d = events.withColumns({"__lo": F.when(roomy, F.col("start") + window).otherwise(F.col("start") + F.floor(n / 4)), "__hi": F.when(roomy, F.col("end") - window).otherwise(F.col("end") - F.floor(n / 4))})
    d = d.withColumn("__span", F.greatest(F.col("__hi") - F.col("__lo"), F.lit(1)))
    k = F.when(F.col("__span") <= probe, 1).otherwise(F.least(F.lit(3), F.greatest(F.lit(1), F.floor(F.col("__span") / probe)))).cast("int")
    half = F.floor(F.least(F.lit(probe), F.col("__span")) / 2)
    centre = lambda i: F.col("__lo") + F.floor((i + 0.5) * F.col("__span") / F.col("__k"))
    win = lambda side, a, b: F.struct(F.lit(side).alias("side"), a.cast("long").alias("a"), b.cast("long").alias("b"))
    d = d.withColumns({"__k": k, "__half": half})
    inside = F.transform(F.sequence(F.lit(0), F.col("__k") - 1), lambda i: win("in", centre(i) - F.col("__half"), centre(i) + F.col("__half")))
    zero = F.lit(0)
    flanks = F.array(win("fl", F.greatest(zero, F.col("start") - window - probe), F.greatest(zero, F.col("start") - window)), win("fl", F.col("end") + window, F.col("end") + window + probe))
    d = d.select(*id_cols, "chrom", F.col("__k").alias("n_in"), F.explode(F.concat(inside, flanks)).alias("w")).where(F.col("w.b") > F.col("w.a"))
    pts = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.col("w.a") + F.floor((i + 0.5) * (F.col("w.b") - F.col("w.a")) / points))
    weight = 1.0 / points / F.when(F.col("w.side") == "in", F.col("n_in")).otherwise(2)
    return d.select(*id_cols, "chrom", F.col("w.side").alias("side"), weight.alias("weight"), F.explode(pts).alias("pos"))


def aligned_blocks(reads: DataFrame, min_mapq: int) -> DataFrame:
    """``chrom, sample_id, b_start, b_end, hp``: the reference blocks a primary read is aligned to, deletions and skips left out. A read without a CIGAR is one block."""
    d = reads.where(F.col("mapq") >= min_mapq)
    if "supplementary" in d.columns:
        d = d.where(F.col("supplementary") == 0)
    hp = F.coalesce(F.when(F.col("hp").isin(1, 2), F.col("hp")), F.lit(0)).alias("hp")
    if "cigar" not in d.columns:
        return d.select("chrom", "sample_id", F.col("ref_start").alias("b_start"), F.col("ref_end").alias("b_end"), hp)
    block = rd.operations(F.col("cigar"), F.col("ref_start"), *rd.BOTH)["ops"]
    return d.select("chrom", "sample_id", hp, block.alias("ops")).select("chrom", "sample_id", "hp", F.explode("ops").alias("c")).select("chrom", "sample_id", F.col("c.r").alias("b_start"), (F.col("c.r") + F.col("c.len")).alias("b_end"), "hp")


def interval_depth(events: DataFrame, reads: DataFrame, members: DataFrame, id_cols: list[str], min_flank: float = 5, min_mapq: int = 5, window: int = 300, probe: int = 2000, room: int = 200) -> DataFrame:
    """Per event and role: mean depth inside and in the flanks per haplotype, ratios and loss of tagged fraction.

    ``members`` maps an event to its samples (``id_cols, role, sample_id``); every one of them has a row, with zero depth where no read is
    aligned. Probe points join aligned blocks by sample and bin; one row per (event, role) comes out, never collected reads.
    """
    pts = probe_points(events, id_cols, window, probe, room=room).join(members, id_cols)
    blocks = aligned_blocks(reads, min_mapq)
    if "cigar" in reads.columns:
        blocks = cut(blocks)               # the join looks at them twice
    hit = iv.point_join(pts, blocks, keys=("chrom", "sample_id"))
    names = [f"{s}_{h}" for s in ("in", "fl") for h in (0, 1, 2)]
    aggs = [F.sum(F.when((F.col("side") == n[:2]) & (F.col("hp") == int(n[3])), F.col("weight")).otherwise(0.0)).alias(n) for n in names]
    d = members.select(*id_cols, "role").join(events.select(*id_cols), id_cols).distinct().join(hit.groupBy(*id_cols, "role").agg(*aggs), [*id_cols, "role"], "left").fillna(0.0, names)
    tot = {s: F.col(f"{s}_0") + F.col(f"{s}_1") + F.col(f"{s}_2") for s in ("in", "fl")}
    tag = {s: F.when(tot[s] > 0, (F.col(f"{s}_1") + F.col(f"{s}_2")) / tot[s]) for s in ("in", "fl")}
    return d.withColumns({"dp_in": tot["in"], "dp_fl": tot["fl"], "ratio_all": F.when(tot["fl"] >= min_flank, tot["in"] / tot["fl"]), "tagged_in": tag["in"], "tagged_fl": tag["fl"], "tagged_loss": tag["fl"] - tag["in"]}
                         | {f"ratio_{h}": F.when(F.col(f"fl_{h}") >= min_flank, F.col(f"in_{h}") / F.col(f"fl_{h}")) for h in (1, 2)})


def junction_counts(events: DataFrame, reads: DataFrame, members: DataFrame, named: DataFrame, id_cols: list[str], window: int = 300, len_tol: float = 0.3, sa_tol: int = 2000) -> DataFrame:
    """Per event and role: reads at either breakpoint that carry this event's junction, by haplotype, and whether both ends have two.

    A split read counts only if it ends at one breakpoint and its other part lands at the other one. ``named`` (``id_cols, read_id``) lists reads
    the caller gives as supporting. A read counts once at each breakpoint; events and roles without such reads have zeros."""
    ends = F.array(F.struct(F.lit(1).alias("side"), F.col("start").alias("p")), F.struct(F.lit(2).alias("side"), F.col("end").alias("p")))
    q = events.drop("sample_id").join(members, id_cols).withColumn("at", F.explode(F.when(F.col("start") == F.col("end"), F.slice(ends, 1, 1)).otherwise(ends)))
    q = q.select(*id_cols, "role", "sample_id", "chrom", "start", "end", "svtype", "svlen", F.col("at.side").alias("side"), F.greatest(F.lit(0), F.col("at.p") - window - 1).alias("w_lo"), (F.col("at.p") + window).alias("w_hi"))
    # A read is walked once, before it meets anything; of its CIGAR only insertions and deletions go on. Where it is walked it is written, as the join looks at it several times.
    r = reads.withColumn("__o", rd.operations(F.col("cigar"), F.col("ref_start"), "I", "D"))
    r = cut(r.select("sample_id", "chrom", "read_id", "supplementary", F.col("ref_start").alias("b_start"), F.col("__o.end").alias("b_end"), "hp", F.col("__o.ops").alias("ops"), "sa"))
    hit = iv.overlap_join(q, r, ("w_lo", "w_hi"), keys=("chrom", "sample_id"))
    s, e, a, b = F.col("start"), F.col("end"), F.col("b_start"), F.col("b_end")
    covers = rd.spans(a, b, s - window, s + window) | rd.spans(a, b, e - window, e + window)
    touches = ((a <= s) & (s <= b)) | ((a <= e) & (e <= b))
    sign = rd.junction_signature(F.col("ops"), a, b, F.col("chrom"), F.col("sa"), F.col("svtype"), F.col("svlen"), s, e, window, len_tol, sa_tol)
    hit = hit.join(named.select(*id_cols, "read_id", F.lit(True).alias("__named")).distinct(), [*id_cols, "read_id"], "left")
    yes = rd.support_sv(F.coalesce("__named", F.lit(False)), sign, covers, touches) == "ALT"
    # The first alignment of a read at a breakpoint speaks for it.
    first = hit.groupBy(*id_cols, "role", "side", "read_id").agg(F.min(F.struct(a, F.col("supplementary"), yes.alias("yes"), F.coalesce(F.when(F.col("hp").isin(1, 2), F.col("hp")), F.lit(0)).alias("hp"))).alias("r"))
    g = first.where("r.yes").groupBy(*id_cols, "role").agg(*[F.count_if(F.col("r.hp") == h).alias(f"junc_{h}") for h in (0, 1, 2)], *[F.count_if(F.col("side") == k).alias(f"__n{k}") for k in (1, 2)])
    names = ["junc_0", "junc_1", "junc_2", "__n1", "__n2"]
    d = members.select(*id_cols, "role").join(events.select(*id_cols), id_cols).distinct().join(g, [*id_cols, "role"], "left").fillna(0, names)
    return d.withColumn("junc_both_ends", ((F.col("__n1") >= 2) & (F.col("__n2") >= 2)).cast("int")).drop("__n1", "__n2")


def het_persistence(events: DataFrame, genotypes: DataFrame, id_cols: list[str], flank: int = 20000, window: int = 300, min_sites: int = 20) -> DataFrame:
    """Heterozygous fraction inside an event over its mean in the two flanks; no site inside means loss of heterozygosity.

    An event is one interval from flank to flank, so a site meets it once; which of the three zones it lies in is told at the pair."""
    s, e = F.col("start"), F.col("end")
    zones = {"in": (s + window, e - window), "l": (s - flank, s - window), "r": (e + window, e + flank)}
    lo, hi = F.least(s + min(-flank, window), e + window), F.greatest(e + max(flank, -window), s - window)
    z = events.select(*id_cols, "sample_id", "chrom", "start", "end", lo.alias("b_start"), hi.alias("b_end"))
    hit = iv.point_join(genotypes.select("sample_id", "chrom", "pos", (F.col("a1") != F.col("a2")).cast("int").alias("het")), z, keys=("sample_id", "chrom"))
    within = {k: (F.col("pos") >= a) & (F.col("pos") < b) for k, (a, b) in zones.items()}
    aggs = [F.count_if(w).alias(f"n_{k}") for k, w in within.items()] + [F.avg(F.when(w, F.col("het"))).alias(f"f_{k}") for k, w in within.items()]
    g = hit.groupBy(*id_cols).agg(*aggs).where("n_in + n_l + n_r > 0")
    both = F.when(F.col("f_l").isNotNull() & F.col("f_r").isNotNull(), (F.col("f_l") + F.col("f_r")) / 2).otherwise(F.coalesce("f_l", "f_r"))
    d = g.withColumn("flank_frac", both)
    ok = (F.col("n_l") + F.col("n_r") >= min_sites) & (F.col("flank_frac") > 0)
    return d.select(*id_cols, F.col("n_in").alias("sites_inside"), (F.col("n_l") + F.col("n_r")).alias("sites_flank"), F.when(ok, F.coalesce("f_in", F.lit(0.0)) / F.col("flank_frac")).alias("het_persistence"))
