"""Phenotype, methylation, signature and X-chromosome queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ranks
from ..operators import regression as rg
from ..operators import resampling as rs
from ..operators import trio
from ..plans import episignature as es
from ..plans import methylation as me
from ..plans import phenotype as ph
from ..plans import xinactivation as xi
from ..storage import cut
from .aggregates import REGION, region_table
from .genotypes import TRIO
from .registry import query


def regions(t):
    return t("fx_region").select("region_id", "chrom", F.col("start").alias("b_start"), F.col("end").alias("b_end"))


@query("phenotype_numeric", "C43,A30", """WITH r AS (SELECT ordinal AS k, CASE WHEN grp = 'MACHINERY' THEN 1 ELSE 0 END AS g, numeric_value AS v FROM fx_phenotype), s AS (SELECT *, row_number() OVER (PARTITION BY k, g ORDER BY v) AS rn, count(*) OVER (PARTITION BY k, g) AS n FROM r)
SELECT CAST(k AS BIGINT) AS k, CAST(max(CASE WHEN g = 1 THEN n END) AS BIGINT) AS n1, max(CASE WHEN g = 1 AND rn = least(CAST(floor(0.5E0 * n) AS BIGINT), n - 1) + 1 THEN v END) AS median_carrier, max(CASE WHEN g = 0 AND rn = least(CAST(floor(0.5E0 * n) AS BIGINT), n - 1) + 1 THEN v END) AS median_other FROM s GROUP BY k""")
def _(t):
    d = t("fx_phenotype").withColumn("k", F.col("ordinal").cast("long"))
    return ph.compare_numeric(d, ["k"], "numeric_value", F.col("grp") == "MACHINERY").select("k", "n1", "median_carrier", "median_other")


@query("phenotype_categorical", "C43,M3", """SELECT CAST(ordinal AS BIGINT) AS k, CAST(sum(CASE WHEN c AND p THEN 1 ELSE 0 END) AS BIGINT) AS a, CAST(sum(CASE WHEN c AND NOT p THEN 1 ELSE 0 END) AS BIGINT) AS b, CAST(sum(CASE WHEN NOT c AND p THEN 1 ELSE 0 END) AS BIGINT) AS c, CAST(sum(CASE WHEN NOT c AND NOT p THEN 1 ELSE 0 END) AS BIGINT) AS d
FROM (SELECT ordinal, grp = 'MACHINERY' AS c, answer > 0 AS p FROM fx_phenotype WHERE asked = 1 AND answer IS NOT NULL) x GROUP BY 1""")
def _(t):
    d = t("fx_phenotype").where("asked = 1").withColumn("k", F.col("ordinal").cast("long"))
    return ph.compare_categorical(d, ["k"], F.col("answer") > 0, F.col("grp") == "MACHINERY").select("k", "a", "b", "c", "d")


DEFN = [(s, f, 1 + (s * f) % 3) for s in range(4) for f in range(6) if (s + f) % 2 == 0]
FEAT = "SELECT c_custkey AS subject_id, f, CASE WHEN (c_custkey + f) % 5 = 0 THEN 'unknown' WHEN (c_custkey * (f + 2)) % 7 < 3 THEN 'present' ELSE 'absent' END AS state FROM customer, (VALUES (0), (1), (2), (3), (4), (5)) y(f)"
DEFN_SQL = "def(syndrome, f, w) AS (VALUES " + ", ".join(f"({a}, {b}, {c})" for a, b, c in DEFN) + ")"


def phenotype_features(t):
    c = F.col("c_custkey")
    d = t("customer").select(c.alias("subject_id"), F.explode(F.array(*[F.lit(i) for i in range(6)])).alias("feature"))
    state = F.when((F.col("subject_id") + F.col("feature")) % 5 == 0, "unknown").when((F.col("subject_id") * (F.col("feature") + 2)) % 7 < 3, "present").otherwise("absent")
    return d.withColumn("state", state), F.broadcast(t.spark.createDataFrame(DEFN, "syndrome int, feature int, weight int"))


@query("syndrome_scores", "C44", f"""WITH fe AS ({FEAT}), {DEFN_SQL} SELECT subject_id, syndrome, count(*) AS n_known, round(sum(CASE WHEN state = 'present' THEN w ELSE 0 END) / CAST(sum(w) AS DOUBLE), 6) AS score FROM fe JOIN def ON def.f = fe.f WHERE state <> 'unknown' GROUP BY 1, 2""")
def _(t):
    return ph.syndrome_scores(*phenotype_features(t)).select("subject_id", "syndrome", "n_known", F.round("score", 6).alias("score"))


@query("syndrome_specificity", "C44", f"""WITH fe AS ({FEAT}), {DEFN_SQL} SELECT syndrome, fe.f AS feature, count(*) AS n_known, round(avg(CASE WHEN state = 'present' THEN 1.0E0 ELSE 0 END), 6) AS frac_present FROM fe JOIN def ON def.f = fe.f WHERE state <> 'unknown' GROUP BY 1, 2""")
def _(t):
    return ph.specificity(*phenotype_features(t)).withColumn("frac_present", F.round("frac_present", 6))


@query("promoter_islands", "C45,J21", """SELECT i.region_id, g.symbol FROM fx_region i JOIN fx_interval g ON g.kind = 'gene' AND g.chrom = i.chrom AND i.start < g.start + 2001 AND g.start - 2000 < i."end" """)
def _(t):
    genes = t("fx_interval").where("kind = 'gene'").select("symbol", "chrom", F.col("start").alias("tss"))
    return me.promoter_islands(t("fx_region"), genes, 2000).select("region_id", "symbol")


HAP = """hp AS (SELECT c.sample_id, r.region_id, avg(CASE WHEN hap = 'hap1' THEN beta END) AS h1, avg(CASE WHEN hap = 'hap2' THEN beta END) AS h2, avg(beta) AS combined FROM fx_cpg c JOIN fx_region r ON r.chrom = c.chrom AND r.start <= c.pos AND c.pos < r."end" GROUP BY 1, 2)"""
ASM = f"""{HAP}, cl AS (SELECT *, CASE WHEN nm * 10 >= 9 * ns THEN CASE WHEN h1 > h2 THEN 'maternal' ELSE 'paternal' END WHEN nm * 10 <= ns THEN CASE WHEN h1 > h2 THEN 'paternal' ELSE 'maternal' END ELSE 'unassigned' END AS mp FROM (SELECT *, 10 AS ns, (sample_id + region_id) % 11 AS nm FROM hp WHERE h1 IS NOT NULL AND h2 IS NOT NULL AND abs(h1 - h2) >= 0.05 AND sample_id % 6 <> 5) x)"""


def hap_table(t):
    return me.haplotype_islands(t("fx_cpg"), regions(t))


def asm(t):
    h = hap_table(t).withColumn("p", F.when(F.col("sample_id") % 6 == 5, 0.5).otherwise(1e-4))
    o = h.select("sample_id", "region_id", F.lit(10).alias("n_sites"), ((F.col("sample_id") + F.col("region_id")) % 11).alias("n_mat"))
    return h, me.asm_calls(h, o, 0.05)


@query("asm_catalogue", "C47,A23", f"""WITH {ASM}, dt AS (SELECT region_id, count(*) AS n_data FROM hp WHERE h1 IS NOT NULL AND h2 IS NOT NULL GROUP BY 1), g AS (SELECT region_id, count(*) AS n_asm, CAST(sum(CASE WHEN mp = 'maternal' THEN 1 ELSE 0 END) AS BIGINT) AS m, CAST(sum(CASE WHEN mp = 'paternal' THEN 1 ELSE 0 END) AS BIGINT) AS p FROM cl GROUP BY 1)
SELECT g.region_id, dt.n_data, n_asm, m AS n_maternal, p AS n_paternal, CASE WHEN m + p >= 5 AND 10 * greatest(m, p) >= 9 * (m + p) THEN CASE WHEN m > p THEN 'imprinted_like_maternal_methylated' ELSE 'imprinted_like_paternal_methylated' END WHEN n_asm >= 5 AND m + p >= 4 AND 4 * m >= m + p AND 4 * m <= 3 * (m + p) THEN 'sequence_dependent_ASM' WHEN n_asm >= 5 THEN 'frequent_ASM_unclassified' ELSE 'sporadic_ASM' END AS class FROM g JOIN dt ON dt.region_id = g.region_id""")
def _(t):
    h, c = asm(t)
    return me.asm_catalogue(c, h).select("region_id", "n_data", "n_asm", "n_maternal", "n_paternal", "class")


@query("imprinting_loss", "C47", f"""WITH {HAP} SELECT sample_id, region_id, CASE WHEN combined <= 0.05 THEN 'both_unmethylated' ELSE 'both_methylated' END AS pattern FROM hp WHERE region_id % 2 = 0 AND abs(h1 - h2) < 0.05 AND (combined <= 0.05 OR combined >= 0.1)""")
def _(t):
    return me.imprinting_loss(hap_table(t), t("fx_region").where("region_id % 2 = 0"), 0.05, 0.05, 0.1).select("sample_id", "region_id", "pattern")


def cis_variants(t):
    """Genotypes and repeat lengths of the families, read as samples of the methylation cohort: sparse carriers in three arms."""
    s, i = F.col("sample_id"), F.col("site_id")
    arm = F.when(i % 10 == 9, "SV").otherwise("SNV")
    at = [F.concat(F.lit("chr"), (1 + i % 22).cast("string")).alias("chrom"), (3000000 + 8 * i).alias("pos")]
    v = t("fx_genotype").where("a1 + a2 > 0").select(i.alias("variant_id"), arm.alias("arm"), (s % 24).alias("sample_id"), *at, (F.col("a1") + F.col("a2")).alias("dosage"))
    r = t("fx_tr").select((i + 1000000).alias("variant_id"), F.lit("TR").alias("arm"), (s % 24).alias("sample_id"), *at, F.greatest("al1", "al2").alias("dosage"))
    return v.unionByName(r).groupBy("variant_id", "arm", "sample_id", "chrom", "pos").agg(F.max("dosage").alias("dosage"))


CIS = f"""{REGION}, v0 AS (SELECT site_id AS variant_id, CASE WHEN site_id % 10 = 9 THEN 'SV' ELSE 'SNV' END AS arm, sample_id % 24 AS sample_id, concat('chr', 1 + site_id % 22) AS chrom, 3000000 + 8 * site_id AS pos, a1 + a2 AS dosage FROM fx_genotype WHERE a1 + a2 > 0
 UNION ALL SELECT site_id + 1000000, 'TR', sample_id % 24, concat('chr', 1 + site_id % 22), 3000000 + 8 * site_id, greatest(al1, al2) FROM fx_tr), v AS (SELECT variant_id, arm, sample_id, chrom, pos, max(dosage) AS dosage FROM v0 GROUP BY ALL),
pr AS (SELECT s.variant_id, s.arm, f.region_id FROM (SELECT DISTINCT variant_id, arm, chrom, pos FROM v) s JOIN fx_region f ON f.chrom = s.chrom AND f.start - 1000 <= s.pos AND s.pos < f."end" + 1000),
x AS (SELECT pr.variant_id, pr.arm, rm.region_id, rm.b AS y, CAST(coalesce(v.dosage, 0) AS DOUBLE) AS d, CAST(rm.sample_id % 5 AS DOUBLE) AS c FROM pr JOIN rm ON rm.region_id = pr.region_id LEFT JOIN v ON v.variant_id = pr.variant_id AND v.arm = pr.arm AND v.sample_id = rm.sample_id),
m AS (SELECT variant_id, arm, region_id, count(*) AS n, count(*) FILTER (d <> 0) AS nc, var_pop(d) * count(*) AS dd, var_pop(c) * count(*) AS cc, covar_pop(c, d) * count(*) AS cd, covar_pop(d, y) * count(*) AS dy, covar_pop(c, y) * count(*) AS cy, var_pop(y) * count(*) AS yy FROM x GROUP BY 1, 2, 3),
b AS (SELECT *, dd * cc - cd * cd AS det FROM m WHERE nc >= CASE arm WHEN 'SNV' THEN 3 WHEN 'SV' THEN 2 ELSE 5 END AND n > 3),
f AS (SELECT *, (dy * cc - cy * cd) / det AS beta, (cy * dd - dy * cd) / det AS gamma FROM b WHERE det > 1e-9),
t AS (SELECT *, beta / sqrt((yy - beta * dy - gamma * cy) / (n - 3) * cc / det) AS t FROM f)"""


@query("cis_fits", "C48", f"""WITH {CIS} SELECT region_id, variant_id, arm, nc AS n_carriers, n, round(beta + 1e-9, 6) AS beta, round(t + 1e-9, 5) AS t FROM t""")
def _(t):
    m = region_table(t).select("sample_id", "region_id", F.col("b").alias("value"), (F.col("sample_id") % 5).cast("double").alias("age"))
    d = me.cis_fits(cis_variants(t), t("fx_region"), m, ["age"], 1000, {"SNV": 3, "SV": 2, "TR": 5}).where("t IS NOT NULL AND NOT isnan(t)")
    return d.select("region_id", "variant_id", "arm", "n_carriers", "n", F.round(F.col("beta") + 1e-9, 6).alias("beta"), F.round(F.col("t") + 1e-9, 5).alias("t"))     # off the edge of rounding


@query("cis_scan", "C48,W8", f"""WITH {CIS}, r AS (SELECT *, row_number() OVER (PARTITION BY region_id, arm ORDER BY round(abs(t), 6) DESC, variant_id) AS rn, count(*) OVER (PARTITION BY region_id, arm) AS n_tests FROM t)
SELECT region_id, arm, variant_id, n_tests, nc AS n_carriers, round(beta + 1e-9, 6) AS beta FROM r WHERE rn = 1""")
def _(t):
    m = region_table(t).select("sample_id", "region_id", F.col("b").alias("value"), (F.col("sample_id") % 5).cast("double").alias("age"))
    d = me.cis_scan(cis_variants(t), t("fx_region"), m, ["age"], 1000, {"SNV": 3, "SV": 2, "TR": 5})
    return d.select("region_id", "arm", "variant_id", "n_tests", "n_carriers", F.round(F.col("beta") + 1e-9, 6).alias("beta"))


SIG = """cp AS (SELECT CASE cpg_id % 3 WHEN 0 THEN 'sigA' WHEN 1 THEN 'sigB' ELSE 'sigC' END AS signature, CASE WHEN sample_id < 12 THEN 'src1' ELSE 'src2' END AS source, chrom, pos AS start, pos + 1 AS "end", CASE WHEN cpg_id % 5 = 0 AND sample_id >= 12 THEN -1 WHEN (cpg_id + sample_id) % 7 = 0 THEN NULL ELSE 1 END AS direction, CASE WHEN sample_id % 4 = 0 THEN beta END AS delta FROM fx_cpg)"""


def signature_cpgs(t):
    i, s = F.col("cpg_id"), F.col("sample_id")
    sig = F.element_at(F.array(F.lit("sigA"), F.lit("sigB"), F.lit("sigC")), (i % 3 + 1).cast("int"))
    direction = F.when((i % 5 == 0) & (s >= 12), -1).when((i + s) % 7 == 0, None).otherwise(1)
    return t("fx_cpg").select(sig.alias("signature"), F.when(s < 12, "src1").otherwise("src2").alias("source"), "chrom", F.col("pos").alias("start"), (F.col("pos") + 1).alias("end"), direction.alias("direction"), F.when(s % 4 == 0, F.col("beta")).alias("delta"))


@query("signature_regions", "C49,S18,A10", f"""WITH {SIG}, s AS (SELECT signature, chrom, start - 450 AS s, "end" + 450 AS e, source, direction FROM cp), d AS (SELECT DISTINCT signature, chrom, s, e FROM s), o AS (SELECT *, max(e) OVER (PARTITION BY signature, chrom ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM d),
gi AS (SELECT *, sum(CASE WHEN pe IS NULL OR s > pe THEN 1 ELSE 0 END) OVER (PARTITION BY signature, chrom ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS gid FROM o), m AS (SELECT signature, chrom, gid, min(s) AS ms, max(e) AS me FROM gi GROUP BY 1, 2, 3),
v AS (SELECT m.signature, m.chrom, m.ms, m.me, s.source, sum(s.direction) AS v, min(s.direction) AS lo, max(s.direction) AS hi FROM m JOIN s ON s.signature = m.signature AND s.chrom = m.chrom AND s.s >= m.ms AND s.e <= m.me GROUP BY 1, 2, 3, 4, 5),
g AS (SELECT signature, chrom, ms, me, count(CASE WHEN v <> 0 THEN 1 END) AS ns, min(sign(v)) AS a, max(sign(v)) AS b, min(lo) <> max(hi) AS cf, sum(v) AS net FROM v GROUP BY 1, 2, 3, 4)
SELECT signature, chrom, ms AS start, me AS stop, ns AS n_sources, CASE WHEN net > 0 THEN '+' WHEN net < 0 THEN '-' ELSE '.' END AS direction, CASE WHEN cf THEN 1 ELSE 0 END AS conflict FROM g""")
def _(t):
    d = es.harmonise(signature_cpgs(t), 450)
    return d.select("signature", "chrom", "start", F.col("end").alias("stop"), "n_sources", "direction", "conflict")


@query("sample_manifest", "C50,S4", """WITH c AS (SELECT g.sample_id, CAST(sum(CASE WHEN s.consequence IN ('stop_gained', 'frameshift_variant', 'missense_variant') AND coalesce(s.gnomad_af, -1) < 0.001 AND g.a1 + g.a2 > 0 THEN 1 ELSE 0 END) AS BIGINT) AS n FROM fx_genotype g JOIN fx_site s ON s.site_id = g.site_id GROUP BY 1), v AS (SELECT sample_id, count(*) AS n_sv FROM fx_sv WHERE svtype <> 'BND' GROUP BY 1)
SELECT p.sample_id, CASE WHEN p.father_id IS NULL THEN 'parent' WHEN p.affected = 1 THEN 'child' ELSE 'sibling' END AS role, coalesce(c.n, 0) AS n_rare_nonsilent, coalesce(v.n_sv, 0) AS n_sv FROM fx_pedigree p LEFT JOIN c ON c.sample_id = p.sample_id LEFT JOIN v ON v.sample_id = p.sample_id""")
def _(t):
    from ..functions import genotype as g
    from ..functions import rules

    s = t("fx_site").where(g.rare(F.col("gnomad_af"), 0.001) & rules.consequence_class(F.col("consequence")).isin("lof", "missense")).select("site_id")
    c = t("fx_genotype").where("a1 + a2 > 0").join(s, "site_id", "left_semi").groupBy("sample_id").agg(F.count("*").alias("n"))
    v = t("fx_sv").where("svtype <> 'BND'").groupBy("sample_id").agg(F.count("*").alias("n_sv"))
    z = F.lit(0).cast("long")
    role = F.when(F.col("father_id").isNull(), "parent").when(F.col("affected") == 1, "child").otherwise("sibling")
    return t("fx_pedigree").join(c, "sample_id", "left").join(v, "sample_id", "left").select("sample_id", role.alias("role"), F.coalesce("n", z).alias("n_rare_nonsilent"), F.coalesce("n_sv", z).alias("n_sv"))


@query("methylation_sample_qc", "C51,A18,A20", """WITH m AS (SELECT cpg_id, sample_id, CASE WHEN depth >= 18 THEN beta END AS b FROM fx_cpg), k AS (SELECT cpg_id, avg(b) AS mu FROM m GROUP BY 1 HAVING count(*) - count(b) <= 0.5 * count(*)),
s AS (SELECT m.sample_id, avg(coalesce(b, mu)) AS level, avg(CASE WHEN b IS NULL THEN 1.0E0 ELSE 0 END) AS na, CAST(m.sample_id % 7 AS DOUBLE) AS age FROM m JOIN k ON k.cpg_id = m.cpg_id GROUP BY 1, 4), f AS (SELECT regr_slope(level, age) AS b, regr_intercept(level, age) AS i FROM s),
r AS (SELECT s.*, level - i - b * age AS resid FROM s, f), d AS (SELECT median(level) AS ml, median(resid) AS mr FROM r), e AS (SELECT greatest(1.4826 * median(abs(level - ml)), 1e-9) AS sl, greatest(1.4826 * median(abs(resid - mr)), 1e-9) AS sr FROM r, d),
z AS (SELECT sample_id, na, (level - ml) / sl AS zl, (resid - mr) / sr AS zr FROM r, d, e), w AS (SELECT *, concat_ws(';', CASE WHEN abs(zl) > 3 THEN 'outlier_level' END, CASE WHEN abs(zr) > 3 THEN 'outlier_resid' END, CASE WHEN na > 0.6 THEN 'missing' END) AS reasons FROM z)
SELECT sample_id, round(zl, 4) AS z_level, round(zr, 4) AS z_resid, reasons, CASE WHEN reasons <> '' THEN 1 ELSE 0 END AS qc_outlier FROM w""")
def _(t):
    m = t("fx_cpg").select("cpg_id", "sample_id", F.when(F.col("depth") >= 18, F.col("beta")).alias("beta"))
    s = me.impute(m, "cpg_id", "beta").groupBy("sample_id").agg(F.avg("beta").alias("level"), F.avg(F.col("imputed").cast("double")).alias("na_frac"))
    s = s.withColumns({"age": (F.col("sample_id") % 7).cast("double"), "__k": F.lit(0)})
    s = rg.residuals(s, ["__k"], "level", ["age"], "resid").drop("__k")
    d = es.sample_outliers(s, {"level": 3.0, "resid": 3.0}, 0.6)
    return d.select("sample_id", F.round("z_level", 4).alias("z_level"), F.round("z_resid", 4).alias("z_resid"), "reasons", "qc_outlier")


def scored_regions(t):
    return es.loo_regions(region_table(t), F.col("sample_id") < 18)


def sets(t):
    return t("fx_region").select((F.col("region_id") % 3).alias("set_id"), "region_id", ((F.col("region_id") * 7) % 11 - 5).cast("double").alias("target"))


@query("signature_scores", "C52,A17,A19", f"""WITH {REGION}, p AS (SELECT a.sample_id, a.region_id, a.b, avg(c.b) AS mu, stddev_samp(c.b) AS sd, quantile_cont(c.b, 0.05) AS p5 FROM rm a JOIN rm c ON c.region_id = a.region_id AND c.sample_id < 18 AND c.sample_id <> a.sample_id GROUP BY 1, 2, 3)
SELECT sample_id, region_id % 3 AS set_id, count(*) AS n_used, round(avg((b - mu) / sd), 5) AS mean_z, round(corr(b - mu, (region_id * 7) % 11 - 5), 5) AS shape_r, round(avg(CASE WHEN b < p5 THEN 1.0E0 ELSE 0 END), 5) AS frac_below_p5 FROM p GROUP BY 1, 2""")
def _(t):
    d = es.score_sets(scored_regions(t), sets(t))
    return d.select("sample_id", "set_id", "n_used", *[F.round(c, 5).alias(c) for c in ("mean_z", "shape_r", "frac_below_p5")])


def pool_table(t):
    """Every region with its mean CpG count and its width, which differs a little from region to region."""
    n = region_table(t).groupBy("region_id").agg(F.avg("n_cpg").alias("n_cpg"))
    return n.withColumn("width", (7040 + 100 * (F.col("region_id") % 5)).cast("double"))


N_DRAWS, N_BOOT = 1000, 200          # the reference's counts
MD5 = "CAST(concat('0x', substr(md5({}), 1, 8)) AS BIGINT)"
_SCORE = """CASE WHEN count(*) >= 5 THEN avg(z) END AS mean_z, CASE WHEN count(*) >= 5 AND var_pop(d) * count(*) > 1e-15 AND var_pop(t) * count(*) > 1e-15 THEN corr(d, t) END AS shape_r"""
NULLS = f"""{REGION}, v AS (SELECT a.sample_id, a.region_id, a.b - avg(c.b) AS d, (a.b - avg(c.b)) / stddev_samp(c.b) AS z FROM rm a JOIN rm c ON c.region_id = a.region_id AND c.sample_id < 18 AND c.sample_id <> a.sample_id GROUP BY a.sample_id, a.region_id, a.b HAVING stddev_samp(c.b) > 0),
pl AS (SELECT region_id, avg(n) AS n_cpg, CAST(7040 + 100 * (region_id % 5) AS DOUBLE) AS width FROM rm GROUP BY 1),
ed AS (SELECT list_distinct(quantile_cont(n_cpg, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS en, list_distinct(quantile_cont(width, [1 / 3.0E0, 2 / 3.0E0])) AS ew FROM pl),
bn AS (SELECT region_id, len(list_filter(en, lambda x: x < n_cpg)) * 100 + len(list_filter(ew, lambda x: x < width)) AS bin FROM pl, ed),
po AS (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY region_id) - 1 AS at, count(*) OVER (PARTITION BY bin) AS size FROM bn),
dr AS (SELECT s.region_id % 3 AS set_id, r.rep, CAST((s.region_id * 7) % 11 - 5 AS DOUBLE) AS t, p.region_id FROM (SELECT po.region_id, po.bin, po.size FROM fx_region f JOIN po ON po.region_id = f.region_id) s CROSS JOIN (SELECT unnest(range(1, {N_DRAWS + 1})) AS rep) r
  JOIN po p ON p.bin = s.bin AND p.at = {MD5.format("concat_ws(':', 11, s.region_id % 3, s.region_id, r.rep)")} % s.size),
nu AS (SELECT sample_id, set_id, rep, {_SCORE} FROM dr JOIN v ON v.region_id = dr.region_id GROUP BY 1, 2, 3),
ob AS (SELECT sample_id, region_id % 3 AS set_id, {_SCORE} FROM (SELECT *, CAST((region_id * 7) % 11 - 5 AS DOUBLE) AS t FROM v) x GROUP BY 1, 2)"""


@query("permutation_null", "C53,P8", f"""WITH {NULLS} SELECT o.sample_id, o.set_id, count(n.mean_z) AS n_null, round(CASE WHEN o.mean_z IS NOT NULL THEN (count(*) FILTER (abs(n.mean_z) >= abs(o.mean_z) - 1e-9) + 1) / (count(n.mean_z) + 1.0E0) END, 6) AS p_mean_z,
 round(CASE WHEN o.shape_r IS NOT NULL THEN (count(*) FILTER (n.shape_r >= o.shape_r - 1e-9) + 1) / (count(n.shape_r) + 1.0E0) END, 6) AS p_shape_r FROM ob o JOIN nu n ON n.sample_id = o.sample_id AND n.set_id = o.set_id GROUP BY 1, 2, o.mean_z, o.shape_r""")
def _(t):
    v = cut(scored_regions(t))
    pool = pool_table(t)
    s = sets(t).join(pool, "region_id")
    s, pool = es.match_bins(s, pool, {"n_cpg": 10, "width": 3})
    draws = es.matched_draws(s, pool, N_DRAWS, 11)
    p = rs.matched_null(es.score_sets(v, sets(t)), v, draws, N_DRAWS)
    return p.select("sample_id", "set_id", "n_null", F.round("p_mean_z", 6).alias("p_mean_z"), F.round("p_shape_r", 6).alias("p_shape_r"))


def annotations(t):
    """Two classes of overlapping intervals."""
    r = t("fx_region")
    one = r.select(F.when(F.col("region_id") % 2 == 0, "island").otherwise("shore").alias("cls"), "chrom", F.col("start").alias("b_start"), F.col("end").alias("b_end"))
    return one.unionByName(r.where("region_id % 3 = 0").select(F.lit("island").alias("cls"), "chrom", (F.col("start") - 500).alias("b_start"), (F.col("start") + 900).alias("b_end")))


@query("layer2_features", "C54,A21", """WITH an AS (SELECT CASE WHEN region_id % 2 = 0 THEN 'island' ELSE 'shore' END AS cls, chrom, start AS s, "end" AS e FROM fx_region UNION ALL SELECT 'island', chrom, start - 500, start + 900 FROM fx_region WHERE region_id % 3 = 0)
SELECT sample_id, cls, count(*) AS ncpg, round(avg(beta), 6) AS beta FROM fx_cpg c JOIN (SELECT 'island' AS cls UNION ALL SELECT 'shore') k ON EXISTS (SELECT 1 FROM an WHERE an.cls = k.cls AND an.chrom = c.chrom AND an.s <= c.pos AND c.pos < an.e) GROUP BY 1, 2""")
def _(t):
    return me.class_features(t("fx_cpg"), annotations(t)).withColumn("beta", F.round("beta", 6))


CANYON_SETS = """cy AS (SELECT region_id, chrom, start + 300 AS s, "end" - 700 AS e FROM fx_region WHERE region_id % 2 = 1)"""


def canyon_regions(t):
    return t("fx_region").where("region_id % 2 = 1").select("region_id", "chrom", (F.col("start") + 300).alias("start"), (F.col("end") - 700).alias("end"))


@query("canyon_features", "A22,C54", f"""WITH {CANYON_SETS}, z AS (SELECT chrom, 'interior' AS z, s AS a, e AS b FROM cy UNION ALL SELECT chrom, 'inner', s, least(s + 1500, e) FROM cy UNION ALL SELECT chrom, 'outer', greatest(s - 1500, 0), s FROM cy UNION ALL SELECT chrom, 'inner', greatest(e - 1500, s), e FROM cy UNION ALL SELECT chrom, 'outer', e, e + 1500 FROM cy),
h AS (SELECT sample_id, avg(beta) FILTER (z = 'interior') AS i, avg(beta) FILTER (z = 'inner') AS n, avg(beta) FILTER (z = 'outer') AS o FROM fx_cpg c JOIN z ON z.chrom = c.chrom AND z.a <= c.pos AND c.pos < z.b GROUP BY 1),
l AS (SELECT *, beta < 0.5 AS low, lag(beta < 0.5) OVER w AS pl, lag(pos) OVER w AS pp FROM fx_cpg WINDOW w AS (PARTITION BY sample_id, chrom ORDER BY pos)), r AS (SELECT *, sum(CASE WHEN low AND coalesce(pl, false) AND pos - pp <= 1000 THEN 0 ELSE 1 END) OVER (PARTITION BY sample_id, chrom ORDER BY pos) AS run FROM l),
x AS (SELECT sample_id, chrom, run, min(pos) AS lo, max(pos) AS hi FROM r WHERE low GROUP BY 1, 2, 3), c AS (SELECT r.sample_id, cy.region_id, r.chrom, arg_min(r.low, r.pos) AS low, arg_min(r.run, r.pos) AS run FROM cy JOIN r ON r.chrom = cy.chrom AND (cy.s + cy.e) // 2 <= r.pos AND r.pos < cy.e GROUP BY 1, 2, 3),
o AS (SELECT c.sample_id, sum(hi - lo + 2) AS w, avg(hi - lo + 2) AS m, count(*) AS n FROM c JOIN x ON x.sample_id = c.sample_id AND x.chrom = c.chrom AND x.run = c.run WHERE c.low AND hi > lo GROUP BY 1)
SELECT p.sample_id, round(h.i, 6) AS canyon_interior_beta, round(h.o - h.n, 6) AS canyon_edge_slope, coalesce(o.w, 0)::BIGINT AS canyon_total_bp, round(o.m, 4) AS canyon_mean_width_bp, coalesce(o.n, 0) AS canyon_n FROM (SELECT DISTINCT sample_id FROM fx_cpg) p LEFT JOIN h ON h.sample_id = p.sample_id LEFT JOIN o ON o.sample_id = p.sample_id""")
def _(t):
    d = me.canyon_features(t("fx_cpg"), canyon_regions(t), 0.5, 1000, 1500)
    return d.select("sample_id", F.round("canyon_interior_beta", 6).alias("canyon_interior_beta"), F.round("canyon_edge_slope", 6).alias("canyon_edge_slope"), "canyon_total_bp", F.round("canyon_mean_width_bp", 4).alias("canyon_mean_width_bp"), "canyon_n")


@query("residual_features", "C54,M5", """WITH f AS (SELECT sample_id, CASE WHEN cpg_id % 2 = 0 THEN 'even' ELSE 'odd' END AS feature, avg(beta) AS value FROM fx_cpg GROUP BY 1, 2), x AS (SELECT *, CASE WHEN sample_id % 7 <> 3 THEN (sample_id * 5) % 11 * 1.0E0 END AS a0 FROM f),
mm AS (SELECT avg(a0) AS m FROM (SELECT DISTINCT sample_id, a0 FROM x) d), y AS (SELECT sample_id, feature, value, coalesce(a0, m) AS a FROM x, mm), k AS (SELECT feature, regr_slope(value, a) AS b, regr_intercept(value, a) AS i FROM y WHERE sample_id < 20 GROUP BY 1),
r AS (SELECT y.*, value - i - b * a AS resid FROM y JOIN k ON k.feature = y.feature), s AS (SELECT feature, sqrt(sum(resid * resid) / (count(*) - 2)) AS sd FROM r WHERE sample_id < 20 GROUP BY 1) SELECT r.sample_id, r.feature, round(resid / sd, 5) AS scaled FROM r JOIN s ON s.feature = r.feature""")
def _(t):
    f = t("fx_cpg").groupBy("sample_id", F.when(F.col("cpg_id") % 2 == 0, "even").otherwise("odd").alias("feature")).agg(F.avg("beta").alias("value"))
    f = f.withColumn("age", F.when(F.col("sample_id") % 7 != 3, ((F.col("sample_id") * 5) % 11).cast("double")))
    return me.residual_features(f, ["age"], F.col("sample_id") < 20).select("sample_id", "feature", F.round("scaled", 5).alias("scaled"))


@query("panel_report_card", "C55,W1")
def _(t):
    s = es.score_sets(scored_regions(t), sets(t))
    e = t("fx_cpg").select("sample_id").distinct().select("sample_id", (F.col("sample_id") % 3).alias("set_id"), F.when(F.col("sample_id") % 2 == 0, 1).otherwise(-1).alias("sign"))
    return es.panel_report(s, e, 0.25).select("sample_id", "set_id", "rank", "observed")


@query("bootstrap_ranks", "C56", f"""WITH {REGION}, cn AS (SELECT sample_id, row_number() OVER (ORDER BY sample_id) - 1 AS at, count(*) OVER () AS n FROM (SELECT DISTINCT sample_id FROM rm WHERE sample_id < 18) x),
w AS (SELECT r.rep, c.sample_id, count(*) AS w FROM cn k CROSS JOIN (SELECT unnest(range(1, {N_BOOT + 1})) AS rep) r JOIN cn c ON c.at = {MD5.format("concat_ws(':', 7, r.rep, k.at)")} % k.n GROUP BY 1, 2),
ct AS (SELECT w.rep, rm.region_id, sum(w) AS n, sum(w * b) AS s, sum(w * b * b) AS q FROM w JOIN rm ON rm.sample_id = w.sample_id GROUP BY 1, 2),
wh AS (SELECT rep, sample_id, w, 1 AS own FROM w UNION ALL SELECT rep, sample_id, 0, 0 FROM (SELECT DISTINCT sample_id FROM rm WHERE sample_id >= 18) y CROSS JOIN (SELECT unnest(range(1, {N_BOOT + 1})) AS rep) r),
l AS (SELECT wh.rep, wh.sample_id, wh.w, wh.own, rm.region_id, rm.b, ct.n - own AS m, ct.s - own * rm.b AS s, ct.q - own * rm.b * rm.b AS q FROM wh JOIN rm ON rm.sample_id = wh.sample_id JOIN ct ON ct.rep = wh.rep AND ct.region_id = rm.region_id),
e AS (SELECT *, b - s / m AS d, CAST((region_id * 7) % 11 - 5 AS DOUBLE) AS t FROM l WHERE m > 1 AND (q - s * s / m) / (m - 1) > 1e-15),
sh AS (SELECT rep, sample_id, w, own, region_id % 3 AS set_id, CASE WHEN count(*) >= 5 AND var_pop(d) * count(*) > 1e-15 AND var_pop(t) * count(*) > 1e-15 THEN corr(d, t) END AS r FROM e GROUP BY 1, 2, 3, 4, 5),
k AS (SELECT a.sample_id, a.set_id, a.rep, a.r, 1 + coalesce(sum(c.w) FILTER (c.r > a.r), 0) AS rank, sum(c.w) + 1 AS n FROM sh a JOIN sh c ON c.set_id = a.set_id AND c.rep = a.rep AND c.own = 1 WHERE a.own = 0 GROUP BY 1, 2, 3, 4)
SELECT sample_id, set_id, count(*) AS n_boot, round(avg(r), 6) AS mean_shape_r, CAST(median(rank) AS DOUBLE) AS median_rank, round(avg(CASE WHEN rank = 1 THEN 1.0E0 ELSE 0 END), 6) AS share_first, max(n)::BIGINT AS n FROM k WHERE r IS NOT NULL GROUP BY 1, 2""")
def _(t):
    """All samples from 18 on against 200 resamples of the controls."""
    v = cut(region_table(t).select("sample_id", "region_id", "b"))
    w = rs.bootstrap_weights(v.where("sample_id < 18"), "sample_id", N_BOOT, 7)
    d = rs.bootstrap_ranks(cut(rs.bootstrap_shapes(v, sets(t), w, F.col("sample_id") >= 18, N_BOOT))).where("shape_r IS NOT NULL")
    return d.groupBy("sample_id", "set_id").agg(F.count("*").alias("n_boot"), F.round(F.avg("shape_r"), 6).alias("mean_shape_r"), F.median("rank").cast("double").alias("median_rank"),
                                                F.round(F.avg((F.col("rank") == 1).cast("double")), 6).alias("share_first"), F.max("n").alias("n"))


_ZS = "{0} AS (SELECT a.sample_id, a.region_id % 3 AS set_id, (a.b - avg(c.b)) / stddev_samp(c.b) AS z FROM {1} a JOIN {1} c ON c.region_id = a.region_id AND c.sample_id < 18 AND c.sample_id <> a.sample_id GROUP BY a.sample_id, a.region_id, a.b HAVING stddev_samp(c.b) > 0)"
_SM = "SELECT '{0}' AS setting, sample_id, set_id, CASE WHEN count(*) >= 5 THEN avg(z) END AS mean_z FROM {1} GROUP BY 2, 3"
SENSITIVITY = f"""{REGION}, r8 AS (SELECT * FROM rm WHERE n >= 8), cr AS (SELECT region_id FROM rm WHERE sample_id < 18 GROUP BY 1 HAVING count(*) >= 8 AND stddev_pop(b) > 0 AND abs(corr(b, (sample_id * 5) % 7 / 7.0E0)) > 0.3), rc AS (SELECT * FROM rm WHERE region_id NOT IN (SELECT region_id FROM cr)),
{_ZS.format('z1', 'rm')}, {_ZS.format('z8', 'r8')}, {_ZS.format('zc', 'rc')}, al AS ({_SM.format('min_cpgs=1', 'z1')} UNION ALL {_SM.format('min_cpgs=8', 'z8')} UNION ALL {_SM.format('composition_clean', 'zc')})"""


@query("score_sensitivity", "C56", f"""WITH {SENSITIVITY} SELECT setting, set_id, count(mean_z) AS n, round(avg(mean_z), 5) AS mean_z, round(stddev(mean_z), 5) AS sd_z FROM al GROUP BY 1, 2""")
def _(t):
    """Scores over CpG floors, and over the regions that do not follow a cell fraction."""
    base = cut(region_table(t))
    fractions = base.select("sample_id").distinct().withColumn("fraction", (F.col("sample_id") * 5) % 7 / 7.0)
    clean = es.composition_clean(base, fractions, F.col("sample_id") < 18, 0.3)
    out = None
    for name, v in (("min_cpgs=1", base), ("min_cpgs=8", base.withColumn("b", F.when(F.col("n_cpg") >= 8, F.col("b")))), ("composition_clean", base.join(clean, "region_id"))):
        d = es.score_sets(es.loo_regions(v, F.col("sample_id") < 18), sets(t)).select(F.lit(name).alias("setting"), "sample_id", "set_id", "mean_z")
        out = d if out is None else out.unionByName(d)
    return out.groupBy("setting", "set_id").agg(F.count("mean_z").alias("n"), F.round(F.avg("mean_z"), 5).alias("mean_z"), F.round(F.stddev("mean_z"), 5).alias("sd_z"))


@query("anonymised_aggregates", "C57", f"""WITH {REGION} SELECT 'S' || CAST(1000 + sample_id * 7 AS STRING) AS sample_id, count(*) AS n_regions, round(avg(b), 6) AS mean_beta FROM rm WHERE sample_id % 5 <> 4 GROUP BY 1""")
def _(t):
    ids = t("fx_cpg").where("sample_id % 5 <> 4").select("sample_id").distinct().withColumn("study_id", F.concat(F.lit("S"), (1000 + F.col("sample_id") * 7).cast("string")))
    return es.anonymise(region_table(t), ids).groupBy("sample_id").agg(F.count("*").alias("n_regions"), F.round(F.avg("b"), 6).alias("mean_beta"))


@query("na_by_threshold", "C57", f"""WITH {REGION} SELECT k AS min_cpgs, round(avg(CASE WHEN n < k THEN 1.0E0 ELSE 0 END), 6) AS na_frac FROM rm, (VALUES (1), (4), (8), (9)) y(k) GROUP BY 1""")
def _(t):
    return es.na_by_threshold(region_table(t), [1, 4, 8, 9]).withColumn("na_frac", F.round("na_frac", 6))


@query("island_sets", "C58,P8", """WITH g AS (SELECT region_id, chrom, start, CASE WHEN chrom = 'chr7' THEN 'x_like' ELSE 'autosome' END AS grp FROM fx_region WHERE "end" - start BETWEEN 100 AND 10000),
r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY md5(concat_ws(':', 5, chrom, start)), chrom, start) AS rn FROM g) SELECT region_id, grp FROM r WHERE rn <= 3""")
def _(t):
    grp = F.when(F.col("chrom") == "chr7", "x_like").otherwise("autosome")
    return xi.island_sets(t("fx_region"), grp, 100, 10000, 3, 5).select("region_id", "grp")


@query("x_block_orientation", "C59", f"""WITH {TRIO}, v AS (SELECT child_id, c_ps, CASE WHEN c_a1 = f_a1 THEN 1 ELSE -1 END AS v FROM trio WHERE chrom = 'chrX' AND sex = 'F' AND c_a1 <> c_a2 AND c_phased = 1 AND f_a1 = f_a2), g AS (SELECT child_id, c_ps, count(*) AS n, sum(v) AS s FROM v GROUP BY 1, 2)
SELECT child_id, c_ps, n, CASE WHEN n < 2 OR (abs(s) + n) * 10 < 9 * 2 * n THEN 'unresolved' WHEN s > 0 THEN 'hap1_paternal' ELSE 'hap2_paternal' END AS orientation FROM g""")
def _(t):
    return x_orientation(t)


def x_orientation(t):
    return xi.orient_x_blocks(trio.trio_wide(t("fx_genotype").where("chrom = 'chrX'"), t("fx_pedigree"), ["a1", "a2", "phased", "ps"]), 2, 0.9)


def x_values(t):
    """Islands of the derived tracks, half of the samples read as male."""
    return hap_table(t).withColumn("sex", F.when(F.col("sample_id") % 2 == 0, "M").otherwise("F"))


INFORMATIVE = f"""{HAP}, iv AS (SELECT region_id, count(CASE WHEN sample_id % 2 = 0 THEN 1 END) AS nm, count(CASE WHEN sample_id % 2 = 1 THEN 1 END) AS nf, median(CASE WHEN sample_id % 2 = 0 THEN combined END) AS mm, median(CASE WHEN sample_id % 2 = 1 THEN combined END) AS fm FROM hp GROUP BY 1)"""


@query("informative_islands", "C60", f"""WITH {INFORMATIVE} SELECT region_id, round(mm, 6) AS male_median, round(fm, 6) AS female_median FROM iv WHERE nm >= 5 AND nf >= 5 AND mm < 0.2 AND fm BETWEEN 0.02 AND 0.75""")
def _(t):
    d = xi.informative_islands(x_values(t), 5, 0.2, (0.02, 0.75))
    return d.select("region_id", F.round("male_median", 6).alias("male_median"), F.round("female_median", 6).alias("female_median"))


@query("inactivation_skew", "C60,F23")
def _(t):
    v = cut(x_values(t))
    v = v.withColumn("combined", F.when(F.col("sex") == "M", F.col("combined") / 3).otherwise(F.col("combined") * 2))
    inf = xi.informative_islands(v, 5, 0.2, (0.02, 0.9))
    orient = v.where("sample_id % 3 = 0").select("sample_id", "region_id", F.when(F.col("region_id") % 2 == 0, 1).otherwise(-1).alias("sign"))
    return xi.skew(v, inf, v.select("region_id").distinct().where("region_id % 4 = 1"), orient, 3)


@query("gene_xci_status", "C61", f"""WITH {INFORMATIVE}, gn AS (SELECT symbol, min(chrom) AS chrom, min(start) AS start, min(start) + 3000 AS e, min(start) AS tss FROM fx_interval WHERE kind = 'gene' GROUP BY symbol),
h AS (SELECT gn.symbol, r.region_id, iv.mm, iv.fm, row_number() OVER (PARTITION BY gn.symbol ORDER BY iv.mm - iv.fm, r.region_id) AS rn FROM gn JOIN fx_region r ON r.chrom = gn.chrom AND (abs(r.start - gn.tss) <= 20000 OR (r.start >= gn.start AND r."end" <= gn.e)) JOIN iv ON iv.region_id = r.region_id)
SELECT gn.symbol, CASE WHEN h.symbol IS NULL THEN 'no covered island' WHEN h.mm < 0.2 AND h.fm >= 0.04 THEN 'subject' WHEN h.mm < 0.2 THEN 'escapes' ELSE 'uninformative' END AS status FROM gn LEFT JOIN h ON h.symbol = gn.symbol AND h.rn = 1""")
def _(t):
    g = t("fx_interval").where("kind = 'gene'").groupBy("symbol").agg(F.min("chrom").alias("chrom"), F.min("start").alias("start"))
    g = g.withColumns({"end": F.col("start") + 3000, "tss": F.col("start")})
    med = x_values(t).groupBy("region_id").agg(F.median(F.when(F.col("sex") == "M", F.col("combined"))).alias("male_median"), F.median(F.when(F.col("sex") == "F", F.col("combined"))).alias("female_median"))
    return xi.gene_status(g, t("fx_region"), med, 20000, 0.2, 0.04).select("symbol", "status")


@query("sv_parental_haplotype", "C62", f"""WITH {TRIO}, v AS (SELECT child_id, c_ps, CASE WHEN c_a1 = f_a1 THEN 1 ELSE -1 END AS v FROM trio WHERE chrom = 'chrX' AND sex = 'F' AND c_a1 <> c_a2 AND c_phased = 1 AND f_a1 = f_a2), g AS (SELECT child_id, c_ps, count(*) AS n, sum(v) AS s FROM v GROUP BY 1, 2),
o AS (SELECT child_id, c_ps, CASE WHEN s > 0 THEN 1 ELSE 2 END AS pat FROM g WHERE n >= 2 AND (abs(s) + n) * 10 >= 18 * n), j AS (SELECT r.read_id % 500 AS sv_id, r.sample_id, r.ps, r.hp FROM fx_read r WHERE r.chrom = 'chrX' AND r.hp IS NOT NULL)
SELECT j.sv_id, j.sample_id AS child_id, CASE WHEN sum(CASE WHEN j.hp <> o.pat THEN 1 ELSE 0 END) = 0 THEN 'paternal' WHEN sum(CASE WHEN j.hp = o.pat THEN 1 ELSE 0 END) = 0 THEN 'maternal' ELSE 'unresolved' END AS parent FROM j JOIN o ON o.child_id = j.sample_id AND o.c_ps = j.ps GROUP BY 1, 2""")
def _(t):
    j = t("fx_read").where("chrom = 'chrX' AND hp IS NOT NULL").select((F.col("read_id") % 500).alias("sv_id"), F.col("sample_id").alias("child_id"), "ps", "hp")
    return xi.sv_parental_haplotype(j, x_orientation(t), ["sv_id", "child_id"]).select("sv_id", "child_id", "parent")


@query("x_denovo_screen", "C63", f"""WITH {TRIO} SELECT CASE WHEN s.consequence IN ('stop_gained', 'frameshift_variant') THEN 'lof' WHEN s.consequence = 'missense_variant' THEN 'missense' WHEN s.consequence = 'synonymous_variant' THEN 'synonymous' ELSE 'other' END AS cls, t.sex, count(*) AS n, CAST(sum(CASE WHEN t.pos BETWEEN 3500000 AND 4000000 THEN 1 ELSE 0 END) AS BIGINT) AS n_centre
FROM trio t JOIN fx_site s ON s.site_id = t.site_id WHERE t.chrom = 'chrX' AND c_a1 + c_a2 > 0 AND f_a1 + f_a2 = 0 GROUP BY 1, 2""")
def _(t):
    w = trio.trio_wide(t("fx_genotype").where("chrom = 'chrX'"), t("fx_pedigree"), ["a1", "a2"]).where(trio.carries("c") & trio.hom_ref("f"))
    return xi.x_screen(w, t("fx_site"), (3500000, 4000000)).groupBy("cls", "sex").agg(F.count("*").alias("n"), F.sum("in_centre").alias("n_centre"))


@query("x_burden", "C63,M4", f"""WITH {TRIO} SELECT t.affected, CAST(sum(CASE WHEN s.consequence IN ('stop_gained', 'frameshift_variant') THEN 1 ELSE 0 END) AS BIGINT) AS n_lof, CAST(sum(CASE WHEN s.consequence = 'synonymous_variant' THEN 1 ELSE 0 END) AS BIGINT) AS n_synonymous FROM trio t JOIN fx_site s ON s.site_id = t.site_id WHERE t.chrom = 'chrX' AND c_a1 + c_a2 > 0 GROUP BY 1""")
def _(t):
    g = t("fx_genotype").where("chrom = 'chrX' AND a1 + a2 > 0").select("sample_id", "site_id").join(trio.complete_trios(t("fx_pedigree")).select("sample_id", "affected"), "sample_id").join(t("fx_site").select("site_id", "consequence"), "site_id")
    return g.groupBy("affected").agg(F.count_if(F.col("consequence").isin("stop_gained", "frameshift_variant")).alias("n_lof"), F.count_if(F.col("consequence") == "synonymous_variant").alias("n_synonymous"))
