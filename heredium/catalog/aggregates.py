"""Cohort counts, panels, percentiles and repeat distributions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import genotype as g
from ..operators import panel
from ..plans import repeats as rp
from .registry import query

def founder():
    return F.col("slot") < 2


@query("panel_counts", "A1", """SELECT site_id, CAST(sum(a1 + a2) AS BIGINT) AS ac, 2 * count(*) AS an, round(sum(a1 + a2) / (2.0E0 * count(*)), 6) AS af FROM fx_genotype WHERE slot < 2 GROUP BY site_id""")
def _(t):
    d = t("fx_genotype").where(founder()).groupBy("site_id").agg(F.sum(F.col("a1") + F.col("a2")).alias("ac"), (F.count("*") * 2).alias("an"))
    return d.withColumn("af", F.round(F.col("ac") / F.col("an"), 6))


LOO = """f AS (SELECT site_id, family_id, sum(a1 + a2) AS ac, 2 * count(*) AS an, sum(CASE WHEN a1 + a2 > 0 THEN 1 ELSE 0 END) AS carriers FROM fx_genotype GROUP BY 1, 2)"""


@query("panel_leave_family_out", "A2,C29", f"""WITH {LOO}
SELECT site_id, family_id, CAST(sum(ac) OVER w - ac AS BIGINT) AS ac_loo, CAST(sum(an) OVER w - an AS BIGINT) AS an_loo, CAST(sum(carriers) OVER w - carriers AS BIGINT) AS carriers_loo FROM f WINDOW w AS (PARTITION BY site_id)""")
def _(t):
    n = F.col("a1") + F.col("a2")
    d = panel.leave_one_out(t("fx_genotype"), ["site_id"], "family_id", {"ac": n, "an": F.lit(2), "carriers": (n > 0).cast("int")})
    return d.select("site_id", "family_id", "ac_loo", "an_loo", "carriers_loo")


@query("panel_leave_two_out", "A2", f"""WITH {LOO}, k AS (SELECT (SELECT count(*) FROM part) AS sites, (SELECT count(*) // 4 FROM supplier) AS fams), q AS (SELECT sv_id, (sv_id * 13) % sites AS site_id, sv_id % fams AS family_id, (sv_id * 7) % fams AS second_family FROM fx_sv, k),
t AS (SELECT site_id, sum(ac) AS ac FROM f GROUP BY 1) SELECT q.sv_id, CAST(coalesce(t.ac, 0) - coalesce(a.ac, 0) - CASE WHEN q.family_id <> q.second_family THEN coalesce(b.ac, 0) ELSE 0 END AS BIGINT) AS ac_loo
FROM q LEFT JOIN t ON t.site_id = q.site_id LEFT JOIN f a ON a.site_id = q.site_id AND a.family_id = q.family_id LEFT JOIN f b ON b.site_id = q.site_id AND b.family_id = q.second_family""")
def _(t):
    i = F.col("sv_id")
    k = t("part").agg(F.count("*").alias("sites")).crossJoin(F.broadcast(t("supplier").agg(F.floor(F.count("*") / 4).alias("fams"))))       # one row
    q = t("fx_sv").crossJoin(F.broadcast(k)).select("sv_id", ((i * 13) % F.col("sites")).alias("site_id"), (i % F.col("fams")).alias("family_id"), ((i * 7) % F.col("fams")).alias("second_family"))
    d = panel.leave_out_for(q, t("fx_genotype"), ["site_id"], "family_id", {"ac": F.col("a1") + F.col("a2")}, "second_family")
    return d.select("sv_id", "ac_loo")


@query("modal_genotype", "A3", """WITH c AS (SELECT site_id, least(al1, al2) AS lo, greatest(al1, al2) AS hi, count(*) AS c FROM fx_tr GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY c DESC, lo, hi) AS rn, sum(c) OVER (PARTITION BY site_id) AS n, count(*) OVER (PARTITION BY site_id) AS d FROM c)
SELECT site_id, CAST(n AS BIGINT) AS n_called, d AS n_distinct, lo AS modal_lo, hi AS modal_hi, round(c / CAST(n AS DOUBLE), 6) AS modal_frac FROM r WHERE rn = 1""")
def _(t):
    return rp.modal_genotype(t("fx_tr")).withColumn("modal_frac", F.round("modal_frac", 6))


FOUNDER_ALLELES = """fa AS (SELECT site_id, family_id, al1 AS len FROM fx_tr WHERE slot < 2 AND sd1 >= 5 UNION ALL SELECT site_id, family_id, al2 FROM fx_tr WHERE slot < 2 AND sd2 >= 5)"""


@query("founder_percentiles", "A4", f"""WITH {FOUNDER_ALLELES} SELECT site_id, count(*) AS n_founder_alleles, quantile_disc(len, 0.5) AS p50, quantile_disc(len, 0.99) AS p99, max(len) AS founder_max FROM fa GROUP BY site_id HAVING count(*) >= 8""")
def _(t):
    return rp.locus_stats(rp.alleles_long(t("fx_tr").where(founder()), 5).where("ok"), 8)


@query("founder_percentiles_loo", "A4", f"""WITH {FOUNDER_ALLELES}, n AS (SELECT site_id, count(*) AS n FROM fa GROUP BY site_id HAVING count(*) >= 8), fam AS (SELECT DISTINCT site_id, family_id FROM fa),
r AS (SELECT fam.site_id, fam.family_id, count(*) AS n_rest, quantile_disc(fa.len, 0.99) AS p, max(fa.len) AS m FROM fam JOIN fa ON fa.site_id = fam.site_id AND fa.family_id <> fam.family_id GROUP BY 1, 2),
al AS (SELECT site_id, quantile_disc(len, 0.99) AS p, max(len) AS m FROM fa GROUP BY 1)
SELECT fam.site_id, fam.family_id, CASE WHEN coalesce(r.n_rest, 0) >= 6 THEN r.p ELSE al.p END AS pct_loo, CASE WHEN coalesce(r.n_rest, 0) >= 6 THEN r.m ELSE al.m END AS max_loo
FROM fam JOIN n ON n.site_id = fam.site_id JOIN al ON al.site_id = fam.site_id LEFT JOIN r ON r.site_id = fam.site_id AND r.family_id = fam.family_id""")
def _(t):
    a = rp.alleles_long(t("fx_tr").where(founder()), 5).where("ok")
    return panel.leave_one_out_percentile(a, ["site_id"], "family_id", "len", 0.99, 8, 6).select("site_id", "family_id", "pct_loo", "max_loo")


THRESH = f"""{FOUNDER_ALLELES}, n AS (SELECT site_id, quantile_disc(len, 0.99) AS p99, max(len) AS mx FROM fa GROUP BY site_id HAVING count(*) >= 8), fam AS (SELECT DISTINCT site_id, family_id FROM fa),
r AS (SELECT fam.site_id, fam.family_id, count(*) AS n_rest, quantile_disc(fa.len, 0.99) AS p, max(fa.len) AS m FROM fam JOIN fa ON fa.site_id = fam.site_id AND fa.family_id <> fam.family_id GROUP BY 1, 2),
calls AS (SELECT t.*, CASE WHEN coalesce(r.n_rest, 0) >= 6 THEN r.p ELSE n.p99 END + 9 AS threshold, CASE WHEN coalesce(r.n_rest, 0) >= 6 THEN r.m ELSE n.mx END AS founder_max, t.sd1 >= 5 AND t.sd2 >= 5 AS called
 FROM fx_tr t JOIN n ON n.site_id = t.site_id LEFT JOIN r ON r.site_id = t.site_id AND r.family_id = t.family_id)"""


def repeat_calls(t):
    return rp.outlier_calls(t("fx_tr"), founder(), F.lit(9), 5, 8, 6)


@query("repeat_outliers", "A5,C28", f"""WITH {THRESH}
SELECT c.sample_id, CAST(sum(CASE WHEN called THEN 1 ELSE 0 END) AS BIGINT) AS loci_called, CAST(sum(CASE WHEN called AND greatest(al1, al2) > threshold THEN 1 ELSE 0 END) AS BIGINT) AS outlier_loci,
 CAST(sum(CASE WHEN called AND greatest(al1, al2) > threshold AND s.consequence <> 'intron_variant' THEN 1 ELSE 0 END) AS BIGINT) AS outlier_coding,
 round(10000.0E0 * sum(CASE WHEN called AND greatest(al1, al2) > threshold THEN 1 ELSE 0 END) / greatest(sum(CASE WHEN called THEN 1 ELSE 0 END), 1), 3) AS per_10k
FROM calls c JOIN fx_site s ON s.site_id = c.site_id GROUP BY c.sample_id""")
def _(t):
    d = repeat_calls(t).join(t("fx_site").select("site_id", "consequence"), "site_id")
    g = d.groupBy("sample_id").agg(F.count_if("called").alias("loci_called"), F.count_if("outlier").alias("outlier_loci"), F.count_if(F.col("outlier") & (F.col("consequence") != "intron_variant")).alias("outlier_coding"))
    return g.withColumn("per_10k", F.round(10000.0 * F.col("outlier_loci") / F.greatest(F.col("loci_called"), F.lit(1)), 3))


TR_TRIO = f"""{THRESH}, tt AS (SELECT c.sample_id AS child_id, c.site_id, c.chrom, c.threshold, c.founder_max, c.al1 c1, c.al2 c2, f.al1 f1, f.al2 f2, m.al1 m1, m.al2 m2
 FROM calls c JOIN fx_pedigree p ON p.sample_id = c.sample_id AND p.father_id IS NOT NULL JOIN calls f ON f.sample_id = p.father_id AND f.site_id = c.site_id AND f.called JOIN calls m ON m.sample_id = p.mother_id AND m.site_id = c.site_id AND m.called WHERE c.called)"""


@query("repeat_denovo_expansions", "C28,C8", f"""WITH {TR_TRIO} SELECT child_id, site_id, greatest(c1, c2) - greatest(f1, f2, m1, m2) AS excess_over_parents FROM tt WHERE greatest(c1, c2) > greatest(f1, f2, m1, m2) + 9 AND greatest(c1, c2) > founder_max""")
def _(t):
    return rp.denovo_expansions(rp.trio_repeats(repeat_calls(t), t("fx_pedigree")), F.lit(9)).select("child_id", "site_id", "excess_over_parents")


@query("repeat_transmission", "C28,A26", f"""WITH {TR_TRIO} SELECT chrom, CAST(sum(CASE WHEN greatest(c1, c2) > threshold THEN 1 ELSE 0 END) AS BIGINT) AS t, CAST(sum(CASE WHEN greatest(c1, c2) > threshold THEN 0 ELSE 1 END) AS BIGINT) AS nt
FROM tt WHERE chrom <> 'chrX' AND (f1 > threshold)::INT + (f2 > threshold)::INT + (m1 > threshold)::INT + (m2 > threshold)::INT = 1 GROUP BY chrom""")
def _(t):
    d = rp.expansion_transmission(rp.trio_repeats(repeat_calls(t), t("fx_pedigree")))
    return d.groupBy("chrom").agg(F.count_if("transmitted").alias("t"), F.count_if(~F.col("transmitted")).alias("nt"))


@query("counts_per_tier", "A6", """SELECT g.sample_id, CAST(sum(CASE WHEN s.s_het >= 0.18 THEN 1 ELSE 0 END) AS BIGINT) AS tier1, CAST(sum(CASE WHEN s.s_het >= 0.03 AND s.s_het < 0.18 THEN 1 ELSE 0 END) AS BIGINT) AS tier2,
 CAST(sum(CASE WHEN s.s_het IS NULL OR s.s_het < 0.03 THEN 1 ELSE 0 END) AS BIGINT) AS tier3
FROM fx_genotype g JOIN fx_site s ON s.site_id = g.site_id WHERE g.gq >= 20 AND g.dp >= 10 AND g.a1 + g.a2 > 0 AND s.consequence IN ('stop_gained', 'frameshift_variant') GROUP BY g.sample_id""")
def _(t):
    from ..plans.tiering import counts_per_sample, tier_sites

    return counts_per_sample(t("fx_genotype"), tier_sites(t("fx_site")), ["site_id"])


@query("score_coverage", "A7", """SELECT consequence, count(*) AS n, CAST(sum(CASE WHEN gnomad_af IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_af, CAST(sum(CASE WHEN gnomad_af < 0.001 THEN 1 ELSE 0 END) AS BIGINT) AS n_rare,
 CAST(sum(CASE WHEN s_het >= 0.18 AND gnomad_af < 0.001 THEN 1 ELSE 0 END) AS BIGINT) AS n_both FROM fx_site GROUP BY consequence""")
def _(t):
    rare, high = F.col("gnomad_af") < 0.001, F.col("s_het") >= 0.18
    return t("fx_site").groupBy("consequence").agg(F.count("*").alias("n"), F.count("gnomad_af").alias("n_af"), F.count_if(rare).alias("n_rare"), F.count_if(rare & high).alias("n_both"))


@query("cpg_counts", "A16,S9", """SELECT chrom, pos, CAST(sum(depth * 2) AS BIGINT) AS cov, round(sum(CASE WHEN sample_id % 2 = 0 THEN depth ELSE 0 END) / CAST(greatest(sum(depth), 1) AS DOUBLE), 6) AS beta FROM fx_cpg GROUP BY 1, 2 HAVING sum(depth) >= 200""")
def _(t):
    from ..plans.methylation import sum_counts

    parts = t("fx_cpg").select("chrom", "pos", F.when(F.col("sample_id") % 2 == 0, F.col("depth")).otherwise(0).alias("mod"), F.when(F.col("sample_id") % 2 == 0, 0).otherwise(F.col("depth")).alias("unmod"))
    d = sum_counts(parts, ["chrom", "pos"], 200)
    return d.select("chrom", "pos", (F.col("depth") * 2).alias("cov"), F.round("beta", 6).alias("beta"))


@query("probe_missingness", "A18", """WITH m AS (SELECT cpg_id, sample_id, CASE WHEN depth >= 18 THEN beta END AS b FROM fx_cpg), s AS (SELECT cpg_id, avg(b) AS mean_b, count(b) AS n, count(*) AS tot FROM m GROUP BY cpg_id)
SELECT m.sample_id, count(*) AS n_probes, CAST(sum(CASE WHEN m.b IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_imputed, round(avg(coalesce(m.b, s.mean_b)), 6) AS mean_beta FROM m JOIN s ON s.cpg_id = m.cpg_id WHERE 2 * (s.tot - s.n) <= s.tot GROUP BY 1""")
def _(t):
    from ..plans.methylation import impute

    m = t("fx_cpg").select("cpg_id", "sample_id", F.when(F.col("depth") >= 18, F.col("beta")).alias("beta"))
    d = impute(m, "cpg_id", "beta", 0.5)
    return d.groupBy("sample_id").agg(F.count("*").alias("n_probes"), F.count_if("imputed").alias("n_imputed"), F.round(F.avg("beta"), 6).alias("mean_beta"))


REGION = """rm AS (SELECT c.sample_id, r.region_id, avg(c.beta) AS b, count(*) AS n FROM fx_cpg c JOIN fx_region r ON r.chrom = c.chrom AND r.start <= c.pos AND c.pos < r."end" GROUP BY 1, 2)"""


def region_table(t):
    from ..plans.methylation import region_means

    r = t("fx_region").select("region_id", "chrom", F.col("start").alias("b_start"), F.col("end").alias("b_end"))
    return region_means(t("fx_cpg"), r, ["sample_id"], 1, 0).select("sample_id", "region_id", F.col("mean_beta").alias("b"), "n_cpg")


@query("leave_one_out_moments", "A19", f"""WITH {REGION}, s AS (SELECT region_id, count(*) AS n, sum(b) AS s, sum(b * b) AS q FROM rm GROUP BY 1)
SELECT rm.sample_id, rm.region_id, s.n - 1 AS loo_n, round((s.s - rm.b) / (s.n - 1), 6) AS loo_mean, round(sqrt(greatest((s.q - rm.b * rm.b - (s.s - rm.b) * (s.s - rm.b) / (s.n - 1)) / (s.n - 2), 0)), 6) AS loo_sd FROM rm JOIN s ON s.region_id = rm.region_id""")
def _(t):
    d = panel.leave_one_out_moments(region_table(t), ["region_id"], "b")
    return d.select("sample_id", "region_id", "loo_n", F.round("loo_mean", 6).alias("loo_mean"), F.round("loo_sd", 6).alias("loo_sd"))


@query("leave_one_out_p5", "A19", f"""WITH {REGION} SELECT a.sample_id, a.region_id, round(quantile_cont(b.b, 0.05), 6) AS p5 FROM rm a JOIN rm b ON b.region_id = a.region_id AND b.sample_id <> a.sample_id GROUP BY 1, 2""")
def _(t):
    d = panel.leave_one_out_linear_percentile(region_table(t).withColumn("ctl", F.lit(True)), ["region_id"], "b", 0.05, F.col("ctl"), "p5")
    return d.select("sample_id", "region_id", F.round("p5", 6).alias("p5"))


@query("robust_z", "A20", f"""WITH {REGION}, m AS (SELECT region_id, median(b) AS med FROM rm GROUP BY 1), d AS (SELECT rm.region_id, median(abs(rm.b - m.med)) AS mad FROM rm JOIN m ON m.region_id = rm.region_id GROUP BY 1)
SELECT rm.sample_id, rm.region_id, round((rm.b - m.med) / greatest(d.mad * 1.4826, 0.02), 5) AS rz FROM rm JOIN m ON m.region_id = rm.region_id JOIN d ON d.region_id = rm.region_id""")
def _(t):
    return panel.robust_z(region_table(t), ["region_id"], "b").select("sample_id", "region_id", F.round("rz", 5).alias("rz"))


@query("transmission_counts", "A26,C41", f"""WITH t AS (SELECT s.consequence AS cls, c.sample_id AS child_id, p.affected, c.a1 + c.a2 AS c, f.a1 + f.a2 AS f, m.a1 + m.a2 AS m, c.chrom, c.pos,
 least(c.gq, f.gq, m.gq) AS q, least(c.dp, f.dp, m.dp) AS d FROM fx_genotype c JOIN fx_pedigree p ON p.sample_id = c.sample_id AND p.father_id IS NOT NULL JOIN fx_genotype f ON f.sample_id = p.father_id AND f.site_id = c.site_id
 JOIN fx_genotype m ON m.sample_id = p.mother_id AND m.site_id = c.site_id JOIN fx_site s ON s.site_id = c.site_id),
u AS (SELECT *, CASE WHEN f = 1 AND m = 0 AND (chrom <> 'chrX' OR {' OR '.join(f'pos BETWEEN {lo} AND {hi}' for lo, hi in g.PAR_X)}) THEN 'father' WHEN m = 1 AND f = 0 THEN 'mother' END AS parent FROM t WHERE q >= 20 AND d >= 10)
SELECT coalesce(cls, 'all') AS cls, coalesce(parent, 'pooled') AS parent, coalesce(CAST(affected AS STRING), 'both') AS affected, CAST(sum(CASE WHEN c > 0 THEN 1 ELSE 0 END) AS BIGINT) AS t, CAST(sum(CASE WHEN c = 0 THEN 1 ELSE 0 END) AS BIGINT) AS nt
FROM u WHERE parent IS NOT NULL GROUP BY GROUPING SETS ((cls, parent, affected), (cls, affected), (cls))""")
def _(t):
    from ..operators import trio
    from ..plans.burden import transmission_sets

    # every site of the table is in the trio rows: a father's call in the pseudoautosomal ends of X (sites get there on larger tables) is like an autosome's
    w = trio.trio_wide(t("fx_genotype"), t("fx_pedigree"), ["a1", "a2", "gq", "dp"]).join(t("fx_site").select("site_id", F.col("consequence").alias("cls")), "site_id")
    d = transmission_sets(w, [["cls", "parent", "affected"], ["cls", "affected"], ["cls"]])
    return d.select(F.coalesce("cls", F.lit("all")).alias("cls"), F.coalesce("parent", F.lit("pooled")).alias("parent"), F.coalesce(F.col("affected").cast("string"), F.lit("both")).alias("affected"), "t", "nt")


@query("confusion_matrix", "A27", """WITH o AS (SELECT cand, CASE cand % 4 WHEN 0 THEN 'paternal' WHEN 1 THEN 'maternal' WHEN 2 THEN 'paternal' ELSE 'none' END AS truth, CASE total_price % 3 WHEN 0 THEN 'paternal' WHEN 1 THEN 'maternal' ELSE 'none' END AS call FROM fx_candidate)
SELECT truth, CAST(sum(CASE WHEN call = 'paternal' THEN 1 ELSE 0 END) AS BIGINT) AS paternal, CAST(sum(CASE WHEN call = 'maternal' THEN 1 ELSE 0 END) AS BIGINT) AS maternal, CAST(sum(CASE WHEN call = 'none' THEN 1 ELSE 0 END) AS BIGINT) AS none,
 round(avg(CASE WHEN call = 'none' THEN NULL WHEN call = truth THEN 1.0E0 ELSE 0 END), 6) AS agreement FROM o GROUP BY truth""")
def _(t):
    d = t("fx_candidate").select(
        F.when(F.col("cand") % 4 == 3, "none").when(F.col("cand") % 2 == 0, "paternal").otherwise("maternal").alias("truth"),
        F.element_at(F.array(F.lit("paternal"), F.lit("maternal"), F.lit("none")), (F.col("total_price") % 3 + 1).cast("int")).alias("call"))
    called = F.when(F.col("call") != "none", (F.col("call") == F.col("truth")).cast("double"))
    return d.groupBy("truth").agg(*[F.count_if(F.col("call") == c).alias(c) for c in ("paternal", "maternal", "none")], F.round(F.avg(called), 6).alias("agreement"))


@query("group_quartiles", "A30", """SELECT grp, count(*) AS n, quantile_disc(numeric_value, 0.25) AS q1, quantile_disc(numeric_value, 0.5) AS q2, quantile_disc(numeric_value, 0.75) AS q3, round(median(numeric_value), 6) AS med FROM fx_phenotype GROUP BY grp""")
def _(t):
    from ..operators import ranks

    d = t("fx_phenotype").select("grp", "numeric_value")
    disc = ranks.index_percentile(d, ["grp"], "numeric_value", {"q1": 0.25, "q2": 0.5, "q3": 0.75}, "nearest_rank")
    return disc.join(ranks.linear_percentile(d, ["grp"], "numeric_value", {"med": 0.5}), "grp").select("grp", "n", "q1", "q2", "q3", F.round("med", 6).alias("med"))


@query("variable_coverage", "A31", """SELECT grp, count(*) AS n, count(CASE WHEN asked = 1 THEN answer END) AS n_valid, round(count(CASE WHEN asked = 1 THEN answer END) / CAST(count(*) AS DOUBLE), 6) AS coverage,
 round(avg(CASE WHEN asked = 1 AND answer IS NOT NULL THEN CASE WHEN answer > 0 THEN 1.0E0 ELSE 0 END END), 6) AS frac_positive FROM fx_phenotype GROUP BY grp""")
def _(t):
    from ..plans.phenotype import coverage

    valid = F.when(F.col("asked") == 1, F.col("answer"))
    d = coverage(t("fx_phenotype"), ["grp"], valid, F.col("answer") > 0)
    return d.select("grp", "n", "n_valid", F.round("coverage", 6).alias("coverage"), F.round("frac_positive", 6).alias("frac_positive"))
