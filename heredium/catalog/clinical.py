"""Tiering, panel, clinical, inheritance and burden queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import genotype as g
from ..functions import rules
from ..operators import intervals as iv
from ..operators import trio
from ..plans import burden, clinical, inheritance, repeats, tiering
from .aggregates import TR_TRIO, repeat_calls
from .evidence import CLASSED, classified
from .genotypes import TRIO
from .overlaps import OV, features, svs
from .registry import query

LOF = "('stop_gained', 'frameshift_variant')"


@query("lof_site_table", "C26", f"""SELECT s.site_id, s.chrom, s.pos, CASE WHEN s.s_het >= 0.18 THEN 1 WHEN s.s_het >= 0.03 THEN 2 ELSE 3 END AS tier FROM fx_site s WHERE s.consequence IN {LOF} AND coalesce(s.gnomad_af, -1) < 0.001
 AND NOT EXISTS (SELECT 1 FROM fx_interval i WHERE i.kind = 'mask' AND i.chrom = s.chrom AND i.start < s.pos AND s.pos <= i."end")""")
def _(t):
    d = iv.point_filter(tiering.tier_sites(t("fx_site"), 0.001), features(t, "kind = 'mask'"), "left_anti", bounds=iv.LEFT_OPEN)
    return d.select("site_id", "chrom", "pos", "tier")


@query("denovo_tiers", "C30", f"""WITH {TRIO}, d AS (SELECT child_id, site_id FROM trio WHERE c_a1 <> c_a2 AND f_a1 + f_a2 = 0 AND m_a1 + m_a2 = 0)
SELECT d.child_id, d.site_id, CASE WHEN s.consequence IN {LOF} THEN CASE WHEN s.s_het >= 0.18 THEN 'LoF_1' WHEN s.s_het >= 0.03 THEN 'LoF_2' ELSE 'LoF_3' END WHEN s.consequence = 'missense_variant' THEN CASE coalesce((s.s_het > 0.05)::INT, 0) + coalesce((s.s_het > 0.1)::INT, 0) + coalesce((s.s_het > 0.2)::INT, 0) + coalesce((s.s_het > 0.3)::INT, 0) WHEN 4 THEN 'missense_1' WHEN 3 THEN 'missense_2' WHEN 2 THEN 'missense_3' WHEN 1 THEN 'missense_4' ELSE 'missense_0' END ELSE 'other' END AS tier
FROM d JOIN fx_site s ON s.site_id = d.site_id WHERE coalesce(s.gnomad_af, -1) < 0.001""")
def _(t):
    w = trio.trio_where(t("fx_genotype"), t("fx_pedigree"), F.expr("a1 <> a2"), F.expr("a1 = 0 AND a2 = 0"), ["a1", "a2"], ["site_id"], ["a1", "a2"])
    return tiering.denovo_tiers(w.select("child_id", "site_id"), t("fx_site"), ["site_id"], 0.001).select("child_id", "site_id", "tier")


@query("repeat_screen", "C27,F10,A3,T4", """WITH m0 AS (SELECT site_id, least(al1, al2) AS lo, greatest(al1, al2) AS hi, count(*) AS c FROM fx_tr GROUP BY 1, 2, 3), m AS (SELECT site_id, lo, hi, c / CAST(sum(c) OVER (PARTITION BY site_id) AS DOUBLE) AS fr, sum(c) OVER (PARTITION BY site_id) AS n, row_number() OVER (PARTITION BY site_id ORDER BY c DESC, lo, hi) AS rn FROM m0),
x AS (SELECT t.*, p.affected, CASE WHEN t.site_id % 8 = 0 THEN least(al1, al2) ELSE greatest(al1, al2) END AS allele FROM fx_tr t JOIN fx_pedigree p ON p.sample_id = t.sample_id),
y AS (SELECT *, CASE WHEN allele = al1 THEN sd1 ELSE sd2 END AS sd, CASE WHEN allele >= 60 THEN 'PATHOGENIC_RANGE' WHEN allele >= 34 THEN 'INTERMEDIATE' WHEN allele <= 30 THEN 'benign' ELSE 'unclassified' END AS v0 FROM x),
z AS (SELECT y.*, CASE WHEN sd < 5 OR y.site_id % 20 = 0 THEN 'NOT_CALLABLE' WHEN v0 IN ('PATHOGENIC_RANGE', 'INTERMEDIATE') AND m.fr >= 0.05 AND m.n >= 20 AND allele IN (m.lo, m.hi) THEN 'NOT_CALLABLE' ELSE v0 END AS v1, max(CASE WHEN affected = 0 THEN allele END) OVER (PARTITION BY y.site_id, y.family_id) AS um FROM y JOIN m ON m.site_id = y.site_id AND m.rn = 1)
SELECT CASE WHEN affected = 1 AND v1 IN ('PATHOGENIC_RANGE', 'INTERMEDIATE') AND um >= allele THEN v1 || '_NOT_EXPLANATORY' ELSE v1 END AS verdict, count(*) AS n FROM z GROUP BY 1""")
def _(t):
    ped = t("fx_pedigree").select("sample_id", "affected")
    calls = t("fx_tr").join(ped, "sample_id").select(F.col("site_id").alias("trid"), "sample_id", "family_id", "affected", F.array("al1", "al2").alias("counts"), F.array("sd1", "sd2").alias("sd"), F.array(F.lit(0.9)).alias("purity"), (F.col("site_id") % 20 == 0).alias("dropout"))
    cat = t("fx_site").where("site_id % 4 = 0").select(F.col("site_id").alias("trid"), (F.col("site_id") % 8 == 0).alias("recessive"), F.lit(False).alias("distinct_motif"), F.lit(60).alias("path_min"), F.lit(34).alias("inter_min"), F.lit(30).alias("benign_max"), F.lit(True).alias("motif_known"))
    m = repeats.modal_genotype(t("fx_tr")).select(F.col("site_id").alias("trid"), F.array("modal_lo", "modal_hi").alias("modal_alleles"), "modal_frac", "n_called")
    return repeats.screen(calls, cat, m, modal_frac=0.05, modal_called=20).groupBy("verdict").agg(F.count("*").alias("n"))


@query("panel_sv_overlap", "C29,J12", f"""WITH p AS (SELECT *, sv_id % 17 AS ac, sample_id // 4 AS fam FROM fx_sv WHERE sample_id % 4 < 2), q AS (SELECT s.sv_id, max(p.ac) AS m FROM fx_sv s JOIN p ON p.chrom = s.chrom AND p.svtype = s.svtype AND p.fam <> s.sample_id // 4 AND s.start < p."end" AND p.start < s."end"
 AND 2 * (least(s."end", p."end") - greatest(s.start, p.start)) >= s."end" - s.start AND 2 * (least(s."end", p."end") - greatest(s.start, p.start)) >= p."end" - p.start GROUP BY 1) SELECT s.sv_id, coalesce(q.m, 0) AS max_ac FROM fx_sv s LEFT JOIN q ON q.sv_id = s.sv_id WHERE s.sample_id % 4 >= 2""")
def _(t):
    from ..plans.panelsv import panel_max_ac

    fam = F.floor(F.col("sample_id") / 4)
    ev = svs(t, "sample_id % 4 >= 2").select("sv_id", "chrom", "svtype", "start", "end", fam.alias("family_id"))
    pn = svs(t, "sample_id % 4 < 2").select("chrom", "svtype", F.col("start").alias("b_start"), F.col("end").alias("b_end"), fam.alias("p_family"), (F.col("sv_id") % 17).alias("ac"))
    return panel_max_ac(ev, pn, ["sv_id"]).select("sv_id", "max_ac")


GENE_RANKS = "gr AS (SELECT symbol, min(r) AS best_rank FROM (SELECT symbol, 1 AS r FROM fx_site WHERE s_het >= 0.49 UNION ALL SELECT symbol, 3 FROM fx_site WHERE gnomad_af IS NULL AND site_id % 3 = 0) x GROUP BY symbol)"


def gene_ranks(t):
    s = t("fx_site")
    return clinical.gene_sets([("constrained", 1, s.where("s_het >= 0.49")), ("rare", 3, s.where("gnomad_af IS NULL AND site_id % 3 = 0"))])


@query("sv_priority", "C31", f"""WITH {GENE_RANKS}, h AS (SELECT s.sv_id, min(gr.best_rank) AS r FROM fx_sv s JOIN fx_interval i ON {OV} AND i.kind = 'CDS' JOIN gr ON gr.symbol = i.symbol WHERE s.svtype IN ('DEL', 'DUP', 'INS', 'INV') GROUP BY 1)
SELECT s.sv_id, CAST(least(coalesce(h.r, 4), 4) + CASE WHEN s.sv_id % 17 >= 6 THEN 10 ELSE 0 END AS INT) AS priority FROM fx_sv s LEFT JOIN h ON h.sv_id = s.sv_id WHERE s.svtype IN ('DEL', 'DUP', 'INS', 'INV')""")
def _(t):
    ev = svs(t, "svtype IN ('DEL', 'DUP', 'INS', 'INV')").withColumn("family_id", F.floor(F.col("sample_id") / 4))
    ac = ev.select("sv_id", (F.col("sv_id") % 17).alias("max_ac"))
    return clinical.sv_priority(ev, features(t, "kind = 'CDS'").drop("kind"), gene_ranks(t).select("symbol", "best_rank"), ac, ["sv_id"]).select("sv_id", "priority")


@query("validation_outcome", "C33", f"""WITH {TRIO}, r AS (SELECT CASE WHEN f_a1 + f_a2 > 0 AND f_dp >= 6 AND m_a1 + m_a2 > 0 AND m_dp >= 6 THEN 'allele_in_both_parents' WHEN f_a1 + f_a2 > 0 AND f_dp >= 6 THEN 'allele_in_father' WHEN m_a1 + m_a2 > 0 AND m_dp >= 6 THEN 'allele_in_mother'
 WHEN c_a1 + c_a2 = 0 THEN 'proband_no_support' WHEN c_dp < 6 THEN 'proband_low_coverage' WHEN f_dp < 6 THEN 'father_low_coverage' WHEN m_dp < 6 THEN 'mother_low_coverage' ELSE 'proband_alt_parents_ref' END AS reason FROM trio)
SELECT reason, CASE WHEN reason LIKE 'allele_in%' THEN 'REFUTED' WHEN reason = 'proband_alt_parents_ref' THEN 'CONFIRMED' ELSE 'UNINFORMATIVE' END AS outcome, count(*) AS n FROM r GROUP BY 1, 2""")
def _(t):
    w = trio.trio_wide(t("fx_genotype"), t("fx_pedigree"), ["a1", "a2", "dp"])
    d = w.select(*[(F.col(f"{r}_a1") + F.col(f"{r}_a2")).alias(f"{r}_alt") for r in "cfm"], *[f"{r}_dp" for r in "cfm"])
    return clinical.validation_outcome(d).groupBy("reason", "outcome").agg(F.count("*").alias("n"))


@query("sv_read_review", "C34", """WITH x AS (SELECT sv_id, "end" - start AS n, sv_id % 5 AS jl, sv_id % 7 AS jr, (sv_id % 11) / 10.0E0 AS i1, (sv_id % 25) AS hs, (sv_id % 13) / 13.0E0 AS hi FROM fx_sv)
SELECT sv_id, CASE WHEN least(jl, jr) < 2 THEN 'FAIL_junction_reads' WHEN n < 5000 THEN 'PASS_small_event' WHEN hs >= 20 AND hi > 0.8E0 * 0.5E0 THEN 'FAIL_het_SNVs_persist' WHEN i1 <= 0.6E0 THEN 'PASS_constitutional_consistent' ELSE 'FAIL_no_haplotype_depletion' END AS review FROM x""")
def _(t):
    i = F.col("sv_id")
    d = t("fx_sv").select("sv_id", (F.col("end") - F.col("start")).alias("length"), (i % 5).alias("junction_left"), (i % 7).alias("junction_right"), (i % 11 / 10.0).alias("in_1"), F.lit(1.0).alias("fl_1"), F.lit(1.0).alias("in_2"), F.lit(1.0).alias("fl_2"), (i % 25).alias("het_sites"), (i % 13 / 13.0).alias("het_in"), F.lit(0.5).alias("het_flank"))
    return clinical.read_review(d).select("sv_id", "review")


QX = "CASE WHEN cand % 23 = 0 THEN 2 ELSE 0 END AS cohort_ac_loo, CASE WHEN cand % 19 = 0 THEN 1 ELSE 0 END AS founder_recurrence, CASE WHEN cand % 4 = 0 THEN NULL ELSE (cand % 10) / 5000.0D END AS gnomad_af, CAST(NULL AS DOUBLE) AS rf_q"


def _quality_rows(t):
    return classified(t).selectExpr("*", *[e for e in QX.split(", ")], "C1_dp + C2_dp + C_un_dp AS child_dp", "CASE cand % 5 WHEN 0 THEN 'YES' WHEN 1 THEN 'CANDIDATE' ELSE 'NO' END AS dnm_call")


Q_SQL = f"""{CLASSED}, q AS (SELECT cl.*, cl.cand % 23 = 0 OR cl.cand % 19 = 0 OR phase_class IN ('phase_conflict_artifact', 'inherited_missed_in_parent', 'parental_mosaic_transmitted') AS common, greatest(F1_alt, F2_alt, M1_alt, M2_alt) AS pm, phase_class LIKE 'germline%' AS germ FROM cl)"""


@query("small_variant_quality", "C35", f"""WITH {Q_SQL} SELECT cand, CASE WHEN common OR (cand % 4 <> 0 AND (cand % 10) / 5000.0E0 >= 0.001) OR pm >= 2 OR coalesce(T_alt, 0) >= 2 THEN 'FAIL' WHEN phase_class = 'child_postzygotic_mosaic' THEN 'REVIEW'
 WHEN A_alt + C_un_alt >= 3 AND O_alt <= greatest(1.0E0, 0.05E0 * (O_alt + O_ref)) AND rule_score >= 5 AND germ AND C1_dp + C2_dp + C_un_dp >= 8 THEN 'PASS' WHEN germ AND rule_score >= 3 AND A_alt + C_un_alt >= 3 THEN 'REVIEW' ELSE 'FAIL' END AS quality_verdict FROM q""")
def _(t):
    return clinical.small_variant_quality(_quality_rows(t)).select("cand", "quality_verdict")


@query("repeat_quality", "C35", f"""WITH {Q_SQL} SELECT cand, CASE WHEN common THEN 'FAIL' WHEN cand % 5 = 0 AND germ THEN 'PASS' WHEN cand % 5 = 1 OR rule_score >= 3 THEN 'REVIEW' ELSE 'FAIL' END AS quality_verdict FROM q""")
def _(t):
    return clinical.repeat_quality(_quality_rows(t)).select("cand", "quality_verdict")


SVQ = "CASE WHEN sv_id % 9 = 0 THEN NULL ELSE (40 + sv_id % 110) / 100.0{E} END AS sv_ratio, CASE WHEN sv_id % 8 = 0 THEN NULL ELSE (65 + sv_id % 60) / 100.0{E} END AS f_ratio, (68 + sv_id % 55) / 100.0{E} AS m_ratio, sv_id % 2 AS junction_both_ends, CASE WHEN sv_id % 6 = 0 THEN NULL ELSE (sv_id % 100) / 100.0{E} END AS het_persistence, sv_id % 7 AS rule_score, sv_id % 4 AS child_junction, sv_id % 5 AS child_support, CASE WHEN sv_id % 12 = 0 THEN 2 WHEN sv_id % 5 = 0 THEN 1 ELSE 0 END AS parent_junction, (sv_id % 70) / 100.0{E} AS mask_overlap, CASE WHEN sv_id % 10 = 3 THEN 0.4{E} END AS rf_q, CASE WHEN sv_id % 3 = 0 THEN 'germline_DNM_phased' ELSE 'inconclusive' END AS phase_class, CASE WHEN sv_id % 31 = 0 THEN 1 ELSE 0 END AS cohort_ac_loo"


@query("sv_quality", "C35", f"""WITH x AS (SELECT sv_id, svtype, "end" - start AS n, {SVQ.replace('{E}', 'E0')} FROM fx_sv WHERE svtype <> 'BND'), y AS (SELECT *, svtype = 'DUP' AS dup, least(f_ratio, m_ratio) AS lo, greatest(f_ratio, m_ratio) AS hi, svtype IN ('DEL', 'DUP') AND sv_ratio IS NOT NULL AS on_depth, greatest(child_junction, child_support) AS sup FROM x),
z AS (SELECT *, CASE WHEN dup THEN sv_ratio >= 1.3 ELSE sv_ratio <= 0.7 END AS dok, CASE WHEN dup THEN TRUE ELSE lo > 0.7 AND lo >= 0.85 END AS pok, NOT dup AND n >= 5000 AND coalesce(het_persistence > 0.35, FALSE) AS persists, NOT dup AND coalesce(het_persistence <= 0.35, FALSE) AS lost FROM y)
SELECT sv_id, CASE WHEN cohort_ac_loo > 0 OR mask_overlap >= 0.5 OR parent_junction > 1 OR (svtype = 'DEL' AND lo <= 0.7) OR (dup AND hi >= 1.3) THEN 'FAIL'
 WHEN on_depth THEN CASE WHEN dok AND pok AND (junction_both_ends > 0 OR lost) AND NOT persists THEN 'PASS' WHEN NOT dok AND persists THEN 'FAIL' WHEN dok OR (junction_both_ends > 0 AND sup >= 2) THEN 'REVIEW' ELSE 'FAIL' END
 WHEN sup >= 3 AND parent_junction = 0 AND rule_score >= 5 AND phase_class LIKE 'germline%' THEN 'PASS' WHEN (rule_score >= 3 AND parent_junction = 0) OR coalesce(rf_q >= 0.3, FALSE) THEN 'REVIEW' ELSE 'FAIL' END AS quality_verdict FROM z""")
def _(t):
    d = svs(t, "svtype <> 'BND'").selectExpr("sv_id", "svtype", "end - start AS length", *[e if e.startswith(("CASE", "sv_id", "(")) else e for e in SVQ.replace("{E}", "D").split(", ")], "0 AS founder_recurrence")
    return clinical.sv_quality(d).select("sv_id", "quality_verdict")


@query("clinical_arms", "C36,F13,J9", f"""WITH {GENE_RANKS}, sh AS (SELECT symbol, max(s_het) AS s_het FROM fx_site GROUP BY symbol), h AS (SELECT s.sv_id, s.svtype, i.symbol, max(CASE WHEN i.kind = 'CDS' THEN 1 ELSE 0 END) AS c, max(CASE WHEN i.kind IN ('UTR5', 'UTR3') THEN 1 ELSE 0 END) AS u FROM fx_sv s JOIN fx_interval i ON {OV} GROUP BY 1, 2, 3),
k AS (SELECT h.*, coalesce(gr.best_rank, 9) AS pr, sh.s_het, svtype <> 'BND' AND c = 1 AS hi, svtype <> 'BND' AND c = 0 AND u = 1 AS mid FROM h LEFT JOIN gr ON gr.symbol = h.symbol LEFT JOIN sh ON sh.symbol = h.symbol)
SELECT sv_id, symbol, CAST(pr AS INT) AS panel_rank, CASE WHEN pr <= 2 AND hi THEN 'HIGH: LoF-type variant in a high-confidence panel gene' WHEN pr <= 2 AND mid THEN 'MODERATE: non-truncating variant in a high-confidence panel gene' WHEN pr <= 4 AND hi THEN 'MODERATE: LoF-type variant in a panel gene' WHEN pr <= 4 THEN 'LOW: panel gene, uncertain impact' WHEN s_het >= 0.18 AND hi THEN 'MODERATE: LoF-type variant in a constrained gene off-panel' ELSE 'NONE: off-panel' END AS relevance FROM k""")
def _(t):
    sh = t("fx_site").groupBy("symbol").agg(F.max("s_het").alias("s_het"))
    d = clinical.arm_rows(svs(t), features(t), gene_ranks(t).select("symbol", "best_rank"), sh, ["sv_id"])
    return d.select("sv_id", "symbol", "panel_rank", "relevance")


@query("report_counts", "C37,A27", """SELECT chrom, CAST(sum(CASE WHEN svtype = 'DEL' THEN 1 ELSE 0 END) AS BIGINT) AS "DEL", CAST(sum(CASE WHEN svtype = 'DUP' THEN 1 ELSE 0 END) AS BIGINT) AS "DUP", CAST(sum(CASE WHEN svtype = 'INS' THEN 1 ELSE 0 END) AS BIGINT) AS "INS" FROM fx_sv GROUP BY chrom""")
def _(t):
    return t("fx_sv").groupBy("chrom").pivot("svtype", ["DEL", "DUP", "INS"]).agg(F.count("sv_id")).na.fill(0)


@query("acceptance_check", "C37", """SELECT e.sv_id, CASE WHEN s.sv_id IS NULL THEN 0 ELSE 1 END AS found FROM (SELECT l_orderkey AS sv_id FROM lineitem WHERE l_linenumber = 7 GROUP BY 1) e LEFT JOIN fx_sv s ON s.sv_id = e.sv_id AND s.svtype = 'DEL'""")
def _(t):
    expected = t("lineitem").where("l_linenumber = 7").select(F.col("l_orderkey").alias("sv_id")).distinct()
    return clinical.acceptance(svs(t, "svtype = 'DEL'"), expected, ["sv_id"])


@query("inherited_lof", "C38", f"""WITH {TRIO} SELECT t.child_id, t.site_id, s.symbol, CASE WHEN f_a1 + f_a2 > 0 AND m_a1 + m_a2 > 0 THEN 'both' WHEN f_a1 + f_a2 > 0 THEN 'father' ELSE 'mother' END AS transmitted_from FROM trio t JOIN fx_site s ON s.site_id = t.site_id
WHERE s.consequence IN {LOF} AND s.s_het >= 0.18 AND coalesce(s.gnomad_af, -1) < 0.001 AND c_gq >= 20 AND c_dp >= 10 AND c_a1 + c_a2 > 0 AND f_a1 + f_a2 + m_a1 + m_a2 > 0""")
def _(t):
    tiers = tiering.tier_sites(t("fx_site"), 0.001).where("tier = 1")
    w = trio.trio_wide(t("fx_genotype").join(tiers.select("site_id"), "site_id", "left_semi"), t("fx_pedigree"), ["a1", "a2", "gq", "dp"])
    return inheritance.inherited_lof(w, tiers, ["site_id"]).select("child_id", "site_id", "symbol", "transmitted_from")


@query("inherited_sv", "C38", f"""SELECT DISTINCT s.sv_id, i.symbol, CASE WHEN s.sv_id % 3 = 0 AND s.sv_id % 2 = 0 THEN 'both' WHEN s.sv_id % 3 = 0 THEN 'father' ELSE 'mother' END AS transmitted_from FROM fx_sv s JOIN fx_interval i ON {OV} AND i.kind = 'CDS' WHERE s.sv_id % 3 = 0 OR s.sv_id % 2 = 0""")
def _(t):
    car = t("fx_sv").select("sv_id", (F.col("sv_id") % 3 == 0).alias("father"), (F.col("sv_id") % 2 == 0).alias("mother"))
    return inheritance.inherited_sv(svs(t), features(t, "kind = 'CDS'"), car).select("sv_id", "symbol", "transmitted_from")


@query("inherited_repeats", "C38,A4", f"""WITH {TR_TRIO} SELECT child_id, site_id, CASE WHEN greatest(f1, f2) > threshold - 12 AND greatest(m1, m2) > threshold - 12 THEN 'both' WHEN greatest(f1, f2) > threshold - 12 THEN 'father' ELSE 'mother' END AS transmitted_from FROM tt WHERE greatest(c1, c2) > threshold - 12 AND (greatest(f1, f2) > threshold - 12 OR greatest(m1, m2) > threshold - 12)""")
def _(t):
    return inheritance.inherited_repeats(repeats.trio_repeats(repeat_calls(t), t("fx_pedigree")).withColumn("threshold", F.col("threshold") - 12)).select("child_id", "site_id", "transmitted_from")


@query("inheritance_models", "C39", """WITH s AS (SELECT site_id, symbol, gnomad_af, site_id % 4 AS n_hom, chrom FROM fx_site WHERE coalesce(gnomad_af, -1) < 0.005), g AS (SELECT * FROM fx_genotype WHERE gq >= 20 AND dp >= 10),
w AS (SELECT c.sample_id AS child_id, c.family_id, p.sex, p.affected, s.*, c.a1 c1, c.a2 c2, coalesce(f.a1 + f.a2 > 0, FALSE) AS f, coalesce(m.a1 + m.a2 > 0, FALSE) AS m FROM g c JOIN fx_pedigree p ON p.sample_id = c.sample_id AND p.father_id IS NOT NULL JOIN s ON s.site_id = c.site_id LEFT JOIN g f ON f.sample_id = p.father_id AND f.site_id = c.site_id LEFT JOIN g m ON m.sample_id = p.mother_id AND m.site_id = c.site_id),
k AS (SELECT *, CASE WHEN chrom = 'chrX' AND sex = 'M' THEN CASE WHEN c1 + c2 > 0 AND m AND NOT f AND coalesce(gnomad_af, -1) < 0.0001 THEN 'X_LINKED' END WHEN c1 + c2 = 2 AND site_id % 2 = 0 THEN CASE WHEN m AND f AND n_hom <= 2 THEN 'HOMOZYGOUS' END WHEN c1 <> c2 AND site_id % 3 > 0 AND coalesce(gnomad_af, -1) < 0.0001 AND m <> f THEN 'DOMINANT_INHERITED' END AS model FROM w)
SELECT k.child_id, k.site_id, k.model, CASE WHEN k.f AND k.m THEN 'both parents' WHEN k.m THEN 'maternal' ELSE 'paternal' END AS inherited_from, CASE WHEN EXISTS (SELECT 1 FROM w b WHERE b.family_id = k.family_id AND b.site_id = k.site_id AND b.affected = 0 AND b.c1 + b.c2 > 0 AND (k.model <> 'HOMOZYGOUS' OR b.c1 = b.c2)) THEN 1 ELSE 0 END AS shared FROM k WHERE model IS NOT NULL AND affected = 1""")
def _(t):
    i = F.col("site_id")
    req = F.array_compact(F.array(F.lit("x_hemizygous"), F.when(i % 2 == 0, "biallelic"), F.when(i % 3 > 0, "monoallelic")))
    s = t("fx_site").select("site_id", "symbol", "gnomad_af", (i % 4).alias("n_hom"), req.alias("requirements"))
    return inheritance.inheritance_models(t("fx_genotype"), t("fx_pedigree"), s).select("child_id", "site_id", "model", "inherited_from", "shared")


@query("prioritised_findings", "C40,U1", f"""WITH {TRIO}, cur AS (SELECT DISTINCT p_brand AS symbol, CASE WHEN p_brand LIKE '%1' THEN 'established' ELSE 'incidental_carrier' END AS list FROM part WHERE p_brand LIKE '%1' OR p_brand LIKE '%2')
SELECT CASE cur.list WHEN 'established' THEN 1 WHEN 'incidental_carrier' THEN 2 ELSE 3 END AS tier, count(*) AS n FROM trio t JOIN fx_site s ON s.site_id = t.site_id LEFT JOIN cur ON cur.symbol = s.symbol WHERE s.consequence IN {LOF} AND s.s_het >= 0.18 AND c_gq >= 20 AND c_dp >= 10 AND c_a1 + c_a2 > 0 AND f_a1 + f_a2 + m_a1 + m_a2 > 0 GROUP BY 1""")
def _(t):
    tiers = tiering.tier_sites(t("fx_site")).where("tier = 1")
    w = trio.trio_wide(t("fx_genotype").join(tiers.select("site_id"), "site_id", "left_semi"), t("fx_pedigree"), ["a1", "a2", "gq", "dp"])
    rows = inheritance.inherited_lof(w, tiers.drop("tier").withColumn("tier", F.lit(1)), ["site_id"]).drop("tier").withColumn("parent_affected", F.lit(0))
    cur = t("part").where("p_brand LIKE '%1' OR p_brand LIKE '%2'").select(F.col("p_brand").alias("symbol"), F.when(F.col("p_brand").like("%1"), "established").otherwise("incidental_carrier").alias("list"), F.lit("curated").alias("note")).distinct()
    return inheritance.prioritise(rows, cur).groupBy("tier").agg(F.count("*").alias("n"))


TDT = f"""{TRIO}, u AS (SELECT s.symbol, s.consequence, CASE WHEN f_a1 <> f_a2 AND m_a1 + m_a2 = 0 AND t.chrom <> 'chrX' THEN 'father' WHEN m_a1 <> m_a2 AND f_a1 + f_a2 = 0 THEN 'mother' END AS parent, CASE WHEN c_a1 + c_a2 > 0 THEN 1 ELSE 0 END AS tr FROM trio t JOIN fx_site s ON s.site_id = t.site_id WHERE least(c_gq, f_gq, m_gq) >= 20 AND least(c_dp, f_dp, m_dp) >= 10),
cn AS (SELECT symbol, CAST(sum(tr) AS BIGINT) AS t, CAST(sum(1 - tr) AS BIGINT) AS nt FROM u WHERE parent IS NOT NULL GROUP BY symbol)"""

#: The rule of ``trio.transmission_flags``: a father's calls in the pseudoautosomal ends of X are those of an autosome (sites get there on larger tables).
_NOT_X, _NOT_X_BUT_PAR = "AND t.chrom <> 'chrX' THEN", f"AND (t.chrom <> 'chrX' OR {' OR '.join(f't.pos BETWEEN {lo} AND {hi}' for lo, hi in g.PAR_X)}) THEN"
TDT_PAR = TDT.replace(_NOT_X, _NOT_X_BUT_PAR)


@query("gene_transmission_tests", "C41,M3", f"""WITH {TDT_PAR}, b AS (SELECT cn.*, t + nt AS n, least(t, nt) AS lo FROM cn), p AS (SELECT symbol, t, nt, n, sum(CASE WHEN i <= lo THEN exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2)) ELSE 0 END) AS tail FROM (SELECT *, unnest(range(0, n + 1)) AS i FROM b) x GROUP BY 1, 2, 3, 4)
SELECT symbol, t, nt, round(t / CAST(n AS DOUBLE), 6) AS t_frac, round(least(1, 2 * tail), 6) AS p_tail FROM p""")
def _(t):
    w = trio.trio_wide(t("fx_genotype"), t("fx_pedigree"), ["a1", "a2", "gq", "dp"]).join(t("fx_site").select("site_id", "symbol"), "site_id")
    d = burden.with_tests(burden.transmission_counts(w, ["symbol"]))
    return d.select("symbol", "t", "nt", F.round("t_frac", 6).alias("t_frac"), F.round("p_tail", 6).alias("p_tail"))


@query("ranked_gene_burden", "C41,U4", f"""WITH {TDT} SELECT symbol, t, nt FROM cn WHERE symbol NOT IN (SELECT DISTINCT symbol FROM fx_interval WHERE kind = 'mask' AND "end" - start > 2900) ORDER BY t - nt DESC, symbol""")
def _(t):
    w = trio.trio_wide(t("fx_genotype"), t("fx_pedigree"), ["a1", "a2", "gq", "dp"]).join(t("fx_site").select("site_id", "symbol"), "site_id")
    flagged = t("fx_interval").where("kind = 'mask' AND end - start > 2900").select("symbol").distinct()
    d = burden.transmission_counts(w, ["symbol"]).join(flagged, "symbol", "left_anti")
    return d.orderBy((F.col("t") - F.col("nt")).desc(), "symbol")


@query("ascertainment", "C42,U4", """WITH m AS (SELECT g.sample_id, CASE coalesce((s.s_het > 0.05)::INT, 0) + coalesce((s.s_het > 0.1)::INT, 0) + coalesce((s.s_het > 0.2)::INT, 0) + coalesce((s.s_het > 0.3)::INT, 0) WHEN 4 THEN 1 WHEN 3 THEN 2 WHEN 2 THEN 3 WHEN 1 THEN 4 ELSE 0 END AS tier FROM fx_genotype g JOIN fx_site s ON s.site_id = g.site_id WHERE s.consequence = 'missense_variant' AND g.a1 + g.a2 > 0 AND g.gq >= 20 AND g.dp >= 10)
SELECT CASE WHEN p.affected = 1 THEN 'cohort' ELSE 'pool' END AS grp, count(DISTINCT m.sample_id) AS n_samples, CAST(sum(CASE WHEN tier = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tier1, CAST(sum(CASE WHEN tier = 2 THEN 1 ELSE 0 END) AS BIGINT) AS tier2 FROM m JOIN fx_pedigree p ON p.sample_id = m.sample_id GROUP BY 1""")
def _(t):
    s = F.col("s_het")
    tiers = t("fx_site").where("consequence = 'missense_variant'").withColumn("tier", rules.missense_tier(s > 0.05, s > 0.1, s > 0.2, s > 0.3))
    per = tiering.counts_per_sample(t("fx_genotype"), tiers, ["site_id"])
    d = per.join(t("fx_pedigree").select("sample_id", "affected"), "sample_id")
    return d.groupBy(F.when(F.col("affected") == 1, "cohort").otherwise("pool").alias("grp")).agg(F.count("*").alias("n_samples"), F.sum("tier1").alias("tier1"), F.sum("tier2").alias("tier2"))


@query("combined_priority_list", "C32,T1", """WITH u AS (SELECT 'sv' AS cls, sv_id AS id, CASE svtype WHEN 'DEL' THEN 1 WHEN 'DUP' THEN 2 ELSE 3 END AS pr, "end" - start AS size FROM fx_sv UNION ALL SELECT 'small', site_id, CASE WHEN consequence = 'stop_gained' THEN 1 WHEN consequence = 'missense_variant' THEN 2 ELSE 4 END, 1 FROM fx_site UNION ALL SELECT 'tr', cand, 3, 60 FROM fx_candidate WHERE variant_class = 'TR')
SELECT cls, id, pr FROM u ORDER BY pr, size DESC, cls, id""")
def _(t):
    sv = t("fx_sv").select(F.lit("sv").alias("cls"), F.col("sv_id").alias("id"), F.when(F.col("svtype") == "DEL", 1).when(F.col("svtype") == "DUP", 2).otherwise(3).alias("pr"), (F.col("end") - F.col("start")).alias("size"))
    cons = F.col("consequence")
    sm = t("fx_site").select(F.lit("small").alias("cls"), F.col("site_id").alias("id"), F.when(cons == "stop_gained", 1).when(cons == "missense_variant", 2).otherwise(4).alias("pr"), F.lit(1).cast("long").alias("size"))
    tr = t("fx_candidate").where("variant_class = 'TR'").select(F.lit("tr").alias("cls"), F.col("cand").alias("id"), F.lit(3).alias("pr"), F.lit(60).cast("long").alias("size"))
    return sv.unionByName(sm).unionByName(tr).orderBy("pr", F.col("size").desc(), "cls", "id").select("cls", "id", "pr")


IMPRINTED = f"""{TRIO}, gn AS (SELECT s.symbol, CASE CAST(substr(s.symbol, 7) AS INT) % 3 WHEN 0 THEN 'Maternal' WHEN 1 THEN 'Paternal' ELSE 'Isoform' END AS expressed, s.s_het, k.flag FROM (SELECT symbol, min(s_het) AS s_het FROM fx_site WHERE site_id % 3 = 0 GROUP BY 1) s LEFT JOIN (SELECT symbol, 'long_mask' AS flag FROM fx_interval WHERE kind = 'mask' AND "end" - start > 2940 GROUP BY 1) k ON k.symbol = s.symbol),
u AS (SELECT s.symbol, t.affected, coalesce(s.gnomad_af < 0.001, TRUE) AS rare, CASE WHEN f_a1 <> f_a2 AND m_a1 + m_a2 = 0 AND t.chrom <> 'chrX' THEN 'father' WHEN m_a1 <> m_a2 AND f_a1 + f_a2 = 0 THEN 'mother' END AS parent, CASE WHEN c_a1 + c_a2 > 0 THEN 1 ELSE 0 END AS tr FROM trio t JOIN fx_site s ON s.site_id = t.site_id WHERE s.consequence IN {LOF} AND least(c_gq, f_gq, m_gq) >= 20 AND least(c_dp, f_dp, m_dp) >= 10),
v AS (SELECT u.*, sets.variant_set FROM u JOIN (VALUES ('rare'), ('common'), ('all')) sets(variant_set) ON variant_set = 'all' OR (variant_set = 'rare') = rare WHERE parent IS NOT NULL),
gt AS (SELECT gn.*, p.tested, sets.variant_set FROM gn JOIN (VALUES ('mother'), ('father')) p(tested) ON expressed NOT IN ('Maternal', 'Paternal') OR (expressed = 'Maternal') = (tested = 'mother') CROSS JOIN (VALUES ('rare'), ('common'), ('all')) sets(variant_set)),
arm AS (SELECT gt.symbol, gt.expressed, gt.tested, gt.variant_set, gt.s_het, gt.flag, CAST(coalesce(sum(CASE WHEN parent = tested AND affected = 1 THEN tr END), 0) AS BIGINT) AS t, CAST(coalesce(sum(CASE WHEN parent = tested AND affected = 1 THEN 1 - tr END), 0) AS BIGINT) AS nt,
 CAST(coalesce(sum(CASE WHEN parent <> tested AND affected = 1 THEN tr END), 0) AS BIGINT) AS silenced_t, CAST(coalesce(sum(CASE WHEN parent <> tested AND affected = 1 THEN 1 - tr END), 0) AS BIGINT) AS silenced_nt,
 CAST(coalesce(sum(CASE WHEN parent = tested AND affected = 0 THEN tr END), 0) AS BIGINT) AS sib_t, CAST(coalesce(sum(CASE WHEN parent = tested AND affected = 0 THEN 1 - tr END), 0) AS BIGINT) AS sib_nt FROM gt LEFT JOIN v ON v.symbol = gt.symbol AND v.variant_set = gt.variant_set GROUP BY 1, 2, 3, 4, 5, 6)"""
_TAILS = "(SELECT DISTINCT least(t, nt) AS lo, t + nt AS n FROM {}) z, LATERAL (SELECT least(1, 2 * sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2)))) AS p FROM (SELECT unnest(range(0, lo + 1)) AS i) y) pp"


def imprinted_arms(t):
    """Fixture: a brand stands for a gene; its number names the parent whose allele is expressed, a long masked interval flags it."""
    lof = t("fx_site").where(rules.consequence_class(F.col("consequence")) == "lof").select("site_id", "symbol", "gnomad_af")
    # What the site alone decides is asked before a genotype moves; of a trio only the key and four fields of each member do, and a gene's name comes to it at the end.
    calls = t("fx_genotype").join(lof.select("site_id"), "site_id", "left_semi").where((F.col("gq") >= 20) & (F.col("dp") >= 10))
    w = trio.trio_wide(calls, t("fx_pedigree"), ["a1", "a2", "gq", "dp"], ["site_id", "chrom", "pos"]).join(lof, "site_id")
    part = F.substring("symbol", 7, 9).cast("int") % 3
    flagged = t("fx_interval").where("kind = 'mask' AND end - start > 2940").select("symbol", F.lit("long_mask").alias("flag")).distinct()
    genes = t("fx_site").where("site_id % 3 = 0").groupBy("symbol").agg(F.min("s_het").alias("s_het")).join(flagged, "symbol", "left")
    return burden.expressed_arms(w, genes.withColumn("expressed", F.when(part == 0, "Maternal").when(part == 1, "Paternal").otherwise("Isoform")), g.rare(F.col("gnomad_af"), 0.001))


@query("imprinted_transmission_ranked", "C41,M3", f"""WITH {IMPRINTED.replace(_NOT_X, _NOT_X_BUT_PAR)}, r AS (SELECT * FROM arm WHERE variant_set = 'rare' AND t + nt > 0), b AS (SELECT lo, n, p FROM {_TAILS.format('r')})
SELECT rank() OVER (ORDER BY round(ln(p), 9)) AS rank, symbol, tested, t, nt, silenced_t, silenced_nt, sib_t, sib_nt, round(p + 1e-9, 6) AS p, round(least(1, p * count(*) OVER ()) + 1e-9, 6) AS bonferroni_p, flag FROM r JOIN b ON b.lo = least(t, nt) AND b.n = t + nt""")
def _(t):
    d = burden.ranked_arms(imprinted_arms(t))
    return d.select("rank", "symbol", "tested", *burden.ARMS, *[F.round(F.col(c) + 1e-9, 6).alias(c) for c in ("p", "bonferroni_p")], "flag")


@query("imprinted_tier_burden", "C41,U4", f"""WITH {IMPRINTED}, e AS (SELECT arm.*, k.tier FROM arm JOIN (VALUES ('lof_t1'), ('lof_t2'), ('lof_t3'), ('all_tiers')) k(tier) ON k.tier = 'all_tiers' OR k.tier = CASE WHEN s_het >= 0.18 THEN 'lof_t1' WHEN s_het >= 0.03 THEN 'lof_t2' ELSE 'lof_t3' END WHERE expressed IN ('Maternal', 'Paternal')),
c AS (SELECT variant_set, tier, count(*) FILTER (flag IS NULL) AS n_genes, coalesce(string_agg(CASE WHEN flag IS NOT NULL THEN symbol END, ';' ORDER BY symbol), '') AS excluded, {', '.join(f'CAST(coalesce(sum({a}) FILTER (flag IS NULL), 0) AS BIGINT) AS {a}' for a in burden.ARMS)} FROM e GROUP BY 1, 2), b AS (SELECT lo, n, p FROM {_TAILS.format('c')})
SELECT variant_set, tier, n_genes, excluded, {', '.join(burden.ARMS)}, round(CASE WHEN t + nt > 0 THEN p END + 1e-9, 6) AS p FROM c JOIN b ON b.lo = least(t, nt) AND b.n = t + nt""")
def _(t):
    return burden.collapsed_arms(imprinted_arms(t)).select("variant_set", "tier", "n_genes", "excluded", *burden.ARMS, F.round(F.col("p") + 1e-9, 6).alias("p"))     # fractions of powers of two lie on the edge of rounding


@query("flagged_priority_list", "C32,T1,U1", f"""WITH {TRIO}, fs AS (SELECT symbol, max(CASE WHEN site_id % 50 = 7 THEN 2 WHEN site_id % 50 < 4 THEN 1 ELSE 0 END) AS a, max(CASE WHEN site_id % 60 = 11 THEN 2 WHEN site_id % 60 < 3 THEN 1 ELSE 0 END) AS b, max(CASE WHEN s_het >= 0.5 THEN 1 ELSE 0 END) AS c FROM fx_site GROUP BY 1),
fl AS (SELECT symbol, concat_ws(';', CASE a WHEN 2 THEN 'SFARI_hc' WHEN 1 THEN 'SFARI' END, CASE b WHEN 2 THEN 'DDG2P_conf' WHEN 1 THEN 'DDG2P' END, CASE c WHEN 1 THEN 'TIER1_GENE' END) AS gene_flags FROM fs WHERE a + b + c > 0),
rw AS (SELECT CASE WHEN length(t.ref) <> length(t.alt) THEN 'indel' ELSE 'SNV' END AS class, t.family_id, t.site_id AS id, s.symbol, s.consequence FROM trio t JOIN fx_site s ON s.site_id = t.site_id WHERE c_a1 <> c_a2 AND f_a1 + f_a2 = 0 AND m_a1 + m_a2 = 0
 UNION ALL SELECT DISTINCT 'SV_' || s.svtype, s.sample_id // 4, s.sv_id, i.symbol, 'coding_' || s.svtype FROM fx_sv s JOIN fx_interval i ON {OV} AND i.kind = 'CDS' WHERE s.svtype <> 'BND'
 UNION ALL SELECT 'TR', c.family_id, c.cand, s.symbol, 'TR_expansion' FROM fx_candidate c JOIN fx_site s ON s.site_id = c.cand WHERE c.variant_class = 'TR')
SELECT class, CAST(family_id AS BIGINT) AS family_id, id, rw.symbol, consequence, gene_flags, CASE WHEN gene_flags LIKE '%TIER1_GENE%' THEN 0 ELSE 1 END AS after_first, CASE WHEN gene_flags LIKE '%SFARI_hc%' OR gene_flags LIKE '%DDG2P_conf%' THEN 0 ELSE 1 END AS after_sure, CASE WHEN class LIKE 'SV%' THEN 0 ELSE 1 END AS after_sv FROM rw JOIN fl ON fl.symbol = rw.symbol""")
def _(t):
    s = t("fx_site")
    flags = clinical.gene_flags([[("SFARI_hc", s.where("site_id % 50 = 7")), ("SFARI", s.where("site_id % 50 < 4"))], [("DDG2P_conf", s.where("site_id % 60 = 11")), ("DDG2P", s.where("site_id % 60 < 3"))], [("TIER1_GENE", s.where("s_het >= 0.5"))]])
    w = trio.trio_wide(t("fx_genotype"), t("fx_pedigree"), ["a1", "a2"]).where(trio.het("c") & trio.hom_ref("f") & trio.hom_ref("m"))
    small = w.join(s.select("site_id", "symbol", "consequence"), "site_id").select(F.when(F.length("ref") != F.length("alt"), "indel").otherwise("SNV").alias("class"), "family_id", F.col("site_id").alias("id"), "symbol", "consequence")
    sv = iv.overlap_join(svs(t, "svtype <> 'BND'"), features(t, "kind = 'CDS'")).select(F.concat(F.lit("SV_"), "svtype").alias("class"), F.floor(F.col("sample_id") / 4).alias("family_id"), F.col("sv_id").alias("id"), "symbol", F.concat(F.lit("coding_"), "svtype").alias("consequence")).distinct()
    tr = t("fx_candidate").where("variant_class = 'TR'").join(s.select(F.col("site_id").alias("cand"), "symbol"), "cand").select(F.lit("TR").alias("class"), "family_id", F.col("cand").alias("id"), "symbol", F.lit("TR_expansion").alias("consequence"))
    return clinical.priority_list(small.unionByName(sv).unionByName(tr), flags, "TIER1_GENE", ("SFARI_hc", "DDG2P_conf")).select("class", "family_id", "id", "symbol", "consequence", "gene_flags", "after_first", "after_sure", "after_sv")
