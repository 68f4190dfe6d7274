"""Genotype predicates and equality joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import genotype as g
from ..functions import rules
from ..operators import intervals as iv
from ..operators import selection as sel
from ..operators import trio
from ..storage import cut
from .registry import query

TRIO = """trio AS (
  SELECT c.sample_id AS child_id, c.family_id, p.sex, p.affected, c.site_id, c.chrom, c.pos, c.ref, c.alt,
         c.a1 AS c_a1, c.a2 AS c_a2, c.phased AS c_phased, c.ps AS c_ps, c.gq AS c_gq, c.dp AS c_dp, c.ad_ref AS c_ad_ref, c.ad_alt AS c_ad_alt,
         f.a1 AS f_a1, f.a2 AS f_a2, f.phased AS f_phased, f.ps AS f_ps, f.gq AS f_gq, f.dp AS f_dp, f.ad_ref AS f_ad_ref, f.ad_alt AS f_ad_alt,
         m.a1 AS m_a1, m.a2 AS m_a2, m.phased AS m_phased, m.ps AS m_ps, m.gq AS m_gq, m.dp AS m_dp, m.ad_ref AS m_ad_ref, m.ad_alt AS m_ad_alt
  FROM fx_genotype c JOIN fx_pedigree p ON p.sample_id = c.sample_id AND p.father_id IS NOT NULL
  LEFT JOIN fx_genotype f ON f.sample_id = p.father_id AND f.site_id = c.site_id
  LEFT JOIN fx_genotype m ON m.sample_id = p.mother_id AND m.site_id = c.site_id)"""
QC3 = "c_gq >= 20 AND f_gq >= 20 AND m_gq >= 20 AND c_dp >= 10 AND f_dp >= 10 AND m_dp >= 10"
AB = "(c_ad_alt * 4 >= c_ad_ref + c_ad_alt AND c_ad_alt * 4 <= 3 * (c_ad_ref + c_ad_alt))"
DENOVO = (f"c_a1 <> c_a2 AND f_a1 + f_a2 = 0 AND m_a1 + m_a2 = 0 AND f_ad_alt = 0 AND m_ad_alt = 0 AND {QC3} AND {AB}")
LOF_SQL = "('stop_gained', 'frameshift_variant')"


def _wide(t, fields=None):
    return trio.trio_wide(t("fx_genotype"), t("fx_pedigree"), fields)


@query("trio_merge", "J1", f"""WITH {TRIO}
SELECT child_id, chrom, count(*) AS n_sites, CAST(sum(c_a1 + c_a2) AS BIGINT) AS child_alt, CAST(sum(f_a1 + f_a2) AS BIGINT) AS father_alt,
       CAST(sum(m_a1 + m_a2) AS BIGINT) AS mother_alt, count(f_a1) AS n_father, count(m_a1) AS n_mother
FROM trio GROUP BY child_id, chrom""")
def _(t):
    d = trio.trio_merge(t("fx_genotype"), t("fx_pedigree"), ["a1", "a2"])
    return d.groupBy("child_id", "chrom").agg(
        F.count("*").alias("n_sites"), *[F.sum(F.col(f"{r}_a1") + F.col(f"{r}_a2")).alias(n) for r, n in
                                         (("c", "child_alt"), ("f", "father_alt"), ("m", "mother_alt"))],
        F.count("f_a1").alias("n_father"), F.count("m_a1").alias("n_mother"))


@query("trio_columns", "J2", f"""WITH {TRIO}
SELECT chrom, c_a1 + c_a2 AS child_alt, f_a1 + f_a2 AS father_alt, m_a1 + m_a2 AS mother_alt, count(*) AS n,
       CAST(sum(c_gq) AS BIGINT) AS gq_sum FROM trio GROUP BY 1, 2, 3, 4""")
def _(t):
    d = _wide(t, ["a1", "a2", "gq"])
    k = [(F.col(f"{r}_a1") + F.col(f"{r}_a2")).alias(n) for r, n in (("c", "child_alt"), ("f", "father_alt"), ("m", "mother_alt"))]
    return d.groupBy("chrom", *k).agg(F.count("*").alias("n"), F.sum("c_gq").alias("gq_sum"))


@query("genotype_qc", "P1", """SELECT sample_id, count(*) AS n_pass, CAST(sum(CASE WHEN a1 <> a2 THEN 1 ELSE 0 END) AS BIGINT) AS n_het
FROM fx_genotype WHERE gq >= 20 AND dp >= 10 AND (a1 = a2 OR (ad_alt * 4 >= ad_ref + ad_alt AND ad_alt * 4 <= 3 * (ad_ref + ad_alt)))
GROUP BY sample_id""")
def _(t):
    d = t("fx_genotype")
    het = F.col("a1") != F.col("a2")
    ok = g.qc_pass(F.col("gq"), F.col("dp")) & (~het | g.allele_balance(F.col("ad_ref"), F.col("ad_alt")).between(0.25, 0.75))
    return d.where(ok).groupBy("sample_id").agg(F.count("*").alias("n_pass"), F.count_if(het).alias("n_het"))


@query("denovo_raw", "P2,C8", f"""WITH {TRIO}
SELECT child_id, site_id, chrom, pos, ref, alt, c_gq, c_dp, c_ad_alt FROM trio WHERE {DENOVO}""")
def _(t):
    d = trio.trio_where(t("fx_genotype"), t("fx_pedigree"), *trio.denovo_tests(), ["gq", "dp", "ad_alt"], tested=["a1", "a2", "gq", "dp", "ad_ref", "ad_alt"])
    return d.select("child_id", *trio.SITE, "c_gq", "c_dp", "c_ad_alt")


@query("denovo_rare_unmasked", "P3,J10,A6,C25", f"""WITH {TRIO},
kept AS (SELECT t.child_id, s.consequence FROM trio t JOIN fx_site s ON s.site_id = t.site_id
  WHERE {DENOVO.replace('c_a1 <>', 't.c_a1 <>')} AND coalesce(s.gnomad_af, -1) < 0.001
  AND NOT EXISTS (SELECT 1 FROM fx_interval i WHERE i.kind = 'mask' AND i.chrom = t.chrom AND i.start < t.pos AND t.pos <= i."end"))
SELECT p.sample_id AS child_id, p.family_id, count(k.child_id) AS n_denovo,
       CAST(coalesce(sum(CASE WHEN k.consequence IN {LOF_SQL} THEN 1 ELSE 0 END), 0) AS BIGINT) AS n_lof,
       CAST(coalesce(sum(CASE WHEN k.consequence = 'missense_variant' THEN 1 ELSE 0 END), 0) AS BIGINT) AS n_missense
FROM fx_pedigree p LEFT JOIN kept k ON k.child_id = p.sample_id
WHERE p.father_id IS NOT NULL GROUP BY p.sample_id, p.family_id""")
def _(t):
    mask = t("fx_interval").where("kind = 'mask'").select("chrom", F.col("start").alias("b_start"), F.col("end").alias("b_end"))
    sites = t("fx_site").where(g.rare(F.col("gnomad_af"), 0.001)).select("site_id", "chrom", "pos", rules.consequence_class(F.col("consequence")).alias("cls"))
    sites = cut(iv.point_filter(sites, mask, "left_anti", bounds=iv.LEFT_OPEN).select("site_id", "cls"))
    # Rarity and mask are the site's alone, so genotypes at other sites never reach the trio aggregate.
    rare = t("fx_genotype").join(sites.select("site_id"), "site_id", "left_semi")
    kept = trio.trio_where(rare, t("fx_pedigree"), *trio.denovo_tests(), ["a1", "a2"], ["site_id"], ["gq", "dp", "ad_ref", "ad_alt"]).select("child_id", "site_id").join(sites, "site_id")
    n = kept.groupBy("child_id").agg(F.count("*").alias("n"), F.count_if(F.col("cls") == "lof").alias("l"), F.count_if(F.col("cls") == "missense").alias("m"))
    kids = trio.complete_trios(t("fx_pedigree")).select(F.col("sample_id").alias("child_id"), "family_id")
    z = F.lit(0).cast("long")
    return kids.join(n, "child_id", "left").select("child_id", "family_id", F.coalesce("n", z).alias("n_denovo"),
                                                   F.coalesce("l", z).alias("n_lof"), F.coalesce("m", z).alias("n_missense"))


@query("sex_chromosome_rules", "P4", """WITH x AS (SELECT t.chrom, p.sex,
  CASE WHEN t.chrom IN ('chrY', 'Y', 'chrM', 'MT', 'chrEBV') THEN 1
       WHEN t.chrom IN ('chrX', 'X') AND p.sex = 'M' AND NOT (t.pos BETWEEN 10001 AND 2781479 OR t.pos BETWEEN 155701383 AND 156030895) THEN 1 ELSE 0 END AS skip
  FROM fx_genotype t JOIN fx_pedigree p ON p.sample_id = t.sample_id)
SELECT sex, chrom, count(*) AS n, CAST(sum(skip) AS BIGINT) AS n_skipped FROM x GROUP BY sex, chrom""")
def _(t):
    d = t("fx_genotype").select("sample_id", "chrom", "pos").join(t("fx_pedigree").select("sample_id", "sex"), "sample_id")
    skip = g.skip_for_phasing(F.col("chrom"), F.col("pos"), F.col("sex"))
    return d.groupBy("sex", "chrom").agg(F.count("*").alias("n"), F.count_if(skip).alias("n_skipped"))


@query("consequence_classes", "P5", """SELECT CASE WHEN consequence IN ('stop_gained', 'frameshift_variant') THEN 'lof' WHEN consequence = 'missense_variant' THEN 'missense'
  WHEN consequence = 'synonymous_variant' THEN 'synonymous' ELSE 'other' END AS cls, symbol, count(*) AS n FROM fx_site GROUP BY 1, 2""")
def _(t):
    joined = F.concat(F.col("consequence"), F.lit("&NMD_transcript_variant"))
    return t("fx_site").groupBy(rules.consequence_class(joined).alias("cls"), "symbol").agg(F.count("*").alias("n"))


# A site's annotation string: up to three transcripts, fields consequence|gene|lof|mane|canonical.
ANN = """concat(consequence, '|', symbol, '|', CASE WHEN site_id % 3 = 0 THEN 'HC' ELSE '' END, '||,intron_variant|', symbol, '||',
  CASE WHEN site_id % 2 = 0 THEN 'NM_1' ELSE '' END, '|,upstream_gene_variant|', symbol, '|||', CASE WHEN site_id % 5 = 0 THEN 'YES' ELSE '' END)"""


@query("pick_transcript", "P6", """SELECT site_id, CASE WHEN site_id % 3 = 0 THEN consequence WHEN site_id % 2 = 0 THEN 'intron_variant'
  WHEN site_id % 5 = 0 THEN 'upstream_gene_variant' ELSE consequence END AS consequence,
  CASE WHEN site_id % 3 = 0 THEN 'HC' WHEN site_id % 2 = 0 THEN 'MANE' WHEN site_id % 5 = 0 THEN 'canonical' ELSE 'any' END AS basis FROM fx_site""")
def _(t):
    d = t("fx_site").select("site_id", F.posexplode(F.split(F.expr(ANN), ",")).alias("i", "ann"))
    f = F.split("ann", r"\|")
    rank = F.when(f[2] == "HC", 0).when(f[3] != "", 1).when(f[4] != "", 2).otherwise(3)
    d = d.select("site_id", "i", f[0].alias("consequence"), rank.alias("r"))
    basis = F.element_at(F.array(*[F.lit(x) for x in ("HC", "MANE", "canonical", "any")]), F.col("r") + 1)
    return sel.best_per_key(d.withColumn("basis", basis), ["site_id"], [F.col("r"), F.col("i")], ["consequence", "basis"])


@query("class_thresholds", "P7", """WITH cfg(variant_class, tau) AS (VALUES ('SV', 0.4E0), ('TR', 0.7E0))
SELECT c.cand, coalesce(f.tau, 0.5E0) AS tau FROM fx_candidate c LEFT JOIN cfg f ON f.variant_class = c.variant_class
WHERE (c.cand % 10) / 10.0E0 >= coalesce(f.tau, 0.5E0)""")
def _(t):
    cfg = t.spark.createDataFrame([("SV", 0.4), ("TR", 0.7)], "variant_class string, tau double")
    d = t("fx_candidate").select("cand", "variant_class").join(F.broadcast(cfg), "variant_class", "left")
    tau = F.coalesce("tau", F.lit(0.5))
    return d.where(F.col("cand") % 10 / 10.0 >= tau).select("cand", tau.alias("tau"))


@query("seeded_sample", "P8,T5", """SELECT sample_id, site_id, chrom FROM (SELECT sample_id, site_id, chrom, row_number() OVER (PARTITION BY sample_id, chrom ORDER BY md5(concat_ws(':', 7, site_id)), site_id) AS rn FROM fx_genotype WHERE a1 <> a2) x WHERE rn <= 3""")
def _(t):
    return sel.sample_n(t("fx_genotype").where("a1 <> a2").select("sample_id", "site_id", "chrom"), ["sample_id", "chrom"], ["site_id"], 3, 7)


@query("domain_restriction", "P9", f"""WITH {TRIO}
SELECT child_id, count(*) AS n_kept, CAST(sum(CASE WHEN c_a1 + c_a2 > 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_label1
FROM trio WHERE f_dp >= 12 AND m_dp >= 12 AND abs(length(alt) - length(ref)) <= 50 GROUP BY child_id""")
def _(t):
    short = F.abs(F.length("alt") - F.length("ref")) <= 50
    carries = F.coalesce((F.col("a1") > 0) | (F.col("a2") > 0), F.lit(False))
    d = trio.trio_codes(t("fx_genotype"), t("fx_pedigree"), F.when(short, carries.cast("int")), F.col("dp"), ["site_id"])
    return d.where("c IS NOT NULL AND f >= 12 AND m >= 12").groupBy("child_id").agg(F.count("*").alias("n_kept"), F.sum("c").alias("n_label1"))


@query("sv_keep_list", "P10", """SELECT sv_id, chrom, start, CASE WHEN "end" > start THEN "end" ELSE start + 1 END AS sv_end, svtype
FROM (SELECT sv_id, chrom, start, svtype, CASE WHEN sv_id % 9 = 0 THEN NULL ELSE "end" END AS "end" FROM fx_sv) x WHERE svtype IN ('DEL', 'DUP', 'INS', 'INV')""")
def _(t):
    d = t("fx_sv").withColumn("end", F.when(F.col("sv_id") % 9 != 0, F.col("end")))
    fixed = F.when(F.col("end") > F.col("start"), F.col("end")).otherwise(F.col("start") + 1)
    return d.where(F.col("svtype").isin("DEL", "DUP", "INS", "INV")).select("sv_id", "chrom", "start", fixed.alias("sv_end"), "svtype")


TIER_SQL = """tier AS (SELECT site_id, chrom, pos, ref, alt, CASE WHEN s_het >= 0.18 THEN 1 WHEN s_het >= 0.03 THEN 2 ELSE 3 END AS tier
  FROM fx_site WHERE consequence IN ('stop_gained', 'frameshift_variant'))"""


def _tiers(t):
    s = t("fx_site").where(rules.consequence_class(F.col("consequence")) == "lof")
    return s.withColumn("tier", rules.lof_tier(F.col("s_het")))


@query("allele_keyed_join", "J3", f"""WITH {TIER_SQL}
SELECT g.sample_id, t.tier, count(*) AS n FROM fx_genotype g JOIN tier t ON g.chrom = t.chrom AND g.pos = t.pos AND g.ref = t.ref AND g.alt = t.alt
WHERE g.a1 + g.a2 > 0 GROUP BY 1, 2""")
def _(t):
    key = ["chrom", "pos", "ref", "alt"]
    d = t("fx_genotype").where("a1 + a2 > 0").select("sample_id", *key).join(_tiers(t).select(*key, "tier"), key)
    return d.groupBy("sample_id", "tier").agg(F.count("*").alias("n"))


@query("frequency_join", "J4", """WITH pop AS (SELECT p_partkey AS site_id, p_size / 1000.0E0 AS new_af FROM part WHERE p_partkey % 3 = 0)
SELECT s.site_id, coalesce(p.new_af, s.gnomad_af, -1) AS af, coalesce(s.gnomad_af, -1) AS old_af FROM fx_site s LEFT JOIN pop p ON p.site_id = s.site_id""")
def _(t):
    pop = t("part").where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("site_id"), (F.col("p_size") / 1000.0).alias("new_af"))
    absent = F.lit(-1.0)
    return t("fx_site").join(pop, "site_id", "left").select(
        "site_id", F.coalesce("new_af", "gnomad_af", absent).alias("af"), F.coalesce("gnomad_af", absent).alias("old_af"))


@query("constraint_lookup", "J5,F21", """WITH byid AS (SELECT p_brand AS symbol, max(p_partkey) % 1000 AS v FROM part WHERE p_size > 25 GROUP BY p_brand),
bysym AS (SELECT p_brand AS symbol, count(*) AS v FROM part GROUP BY p_brand)
SELECT s.site_id, coalesce(CASE WHEN s.site_id % 2 = 0 THEN i.v END, b.v) AS v FROM fx_site s LEFT JOIN byid i ON i.symbol = s.symbol LEFT JOIN bysym b ON b.symbol = s.symbol""")
def _(t):
    part = t("part")
    byid = part.where("p_size > 25").groupBy("p_brand").agg((F.max("p_partkey") % 1000).alias("by_id")).select(
        F.concat(F.lit("ENSG_"), "p_brand").alias("gene_id"), "by_id")
    bysym = part.groupBy(F.col("p_brand").alias("symbol")).agg(F.count("*").alias("by_symbol"))
    site = t("fx_site").withColumn("gene_id", g.versionless(F.when(F.col("site_id") % 2 == 0, F.concat(F.lit("ENSG_"), "symbol", F.lit(".12"))).otherwise("")))
    # one row per gene on the right sides: Spark broadcasts them while they are below its threshold
    return site.join(byid, "gene_id", "left").join(bysym, "symbol", "left").select("site_id", F.coalesce("by_id", "by_symbol").alias("v"))


@query("score_fallback_join", "J6", """WITH score AS (SELECT pos, chrom, alt, site_id % 97 AS score FROM fx_site WHERE site_id % 2 = 0),
anyallele AS (SELECT chrom, pos, max(score) AS score FROM score GROUP BY chrom, pos)
SELECT s.site_id, coalesce(e.score, a.score, -1) AS score, CASE WHEN e.score IS NOT NULL THEN 'exact' WHEN a.score IS NOT NULL THEN 'position' ELSE 'none' END AS basis
FROM (SELECT site_id, chrom, pos, CASE WHEN site_id % 4 = 0 THEN 'N' ELSE alt END AS alt FROM fx_site) s
LEFT JOIN score e ON e.chrom = s.chrom AND e.pos = s.pos AND e.alt = s.alt LEFT JOIN anyallele a ON a.chrom = s.chrom AND a.pos = s.pos""")
def _(t):
    bare = F.regexp_replace("chrom", "^chr", "")
    score = t("fx_site").where("site_id % 2 = 0").select(
        g.with_chr(bare).alias("chrom"), "pos", "alt", (F.col("site_id") % 97).alias("exact"))
    pos_any = score.groupBy("chrom", "pos").agg(F.max("exact").alias("any_allele"))
    s = t("fx_site").select("site_id", "chrom", "pos", F.when(F.col("site_id") % 4 == 0, "N").otherwise(F.col("alt")).alias("alt"))
    d = s.join(score, ["chrom", "pos", "alt"], "left").join(pos_any, ["chrom", "pos"], "left")
    return d.select("site_id", F.coalesce("exact", "any_allele", F.lit(-1).cast("long")).alias("score"),
                    F.when(F.col("exact").isNotNull(), "exact").when(F.col("any_allele").isNotNull(), "position").otherwise("none").alias("basis"))


@query("canonical_allele_join", "J7,F1", """SELECT site_id, CASE WHEN site_id % 10 = 9 THEN pos + 1 ELSE pos END AS core_pos,
  CASE WHEN site_id % 10 = 9 THEN '' ELSE ref END AS core_ref, CASE WHEN site_id % 10 = 9 THEN 'AT' ELSE alt END AS core_alt FROM fx_site""")
def _(t):
    def keyed(d):
        c = g.canonical_allele(F.col("pos"), F.col("ref"), F.col("alt"))
        return d.withColumn("c", c).select("site_id", "chrom", F.col("c.pos").alias("core_pos"), F.col("c.ref").alias("core_ref"), F.col("c.alt").alias("core_alt"))

    padded = t("fx_site").select(
        F.col("site_id"), "chrom", (F.col("pos") - 2).alias("pos"), F.concat(F.lit("gc"), "ref", F.lit("GGC")).alias("ref"),
        F.concat(F.lit("GC"), "alt", F.lit("GGC")).alias("alt"))
    return keyed(padded).join(keyed(t("fx_site")).drop("site_id"), ["chrom", "core_pos", "core_ref", "core_alt"]).select(
        "site_id", "core_pos", "core_ref", "core_alt")


@query("fuzzy_indel_match", "J8", """WITH a AS (SELECT site_id, chrom, pos FROM fx_site WHERE site_id % 10 = 9),
b AS (SELECT site_id AS base_id, chrom, pos + site_id % 45 - 10 AS bpos FROM fx_site WHERE site_id % 10 = 9)
SELECT a.site_id, b.base_id, abs(b.bpos - a.pos) AS dist FROM a JOIN b ON a.chrom = b.chrom AND abs(b.bpos - a.pos) <= 20""")
def _(t):
    from ..plans.denovo import fuzzy_indel

    ins = t("fx_site").where("site_id % 10 = 9").select("site_id", "chrom", (F.col("pos") + 1).alias("pos"), F.lit("").alias("ref"), F.lit("AT").alias("alt"))
    base = ins.select(F.col("site_id").alias("base_id"), "chrom", (F.col("pos") + F.col("site_id") % 45 - 10).alias("bpos"), F.col("ref").alias("bref"), F.col("alt").alias("balt"))
    return fuzzy_indel(ins, base, ["chrom"], 20).select("site_id", "base_id", "dist")


@query("source_lists", "J22", """WITH l AS (SELECT site_id, 'high' AS src FROM fx_site WHERE site_id % 3 = 0 UNION ALL SELECT site_id, 'low' FROM fx_site WHERE site_id % 2 = 0)
SELECT s.site_id, coalesce(string_agg(l.src, ';' ORDER BY l.src), '') AS source_list,
  CASE WHEN max(CASE WHEN l.src = 'high' THEN 2 WHEN l.src = 'low' THEN 1 ELSE 0 END) = 2 THEN 'HIGH' WHEN max(CASE WHEN l.src = 'low' THEN 1 ELSE 0 END) = 1 THEN 'LOW' ELSE 'NONE' END AS source_tier
FROM fx_site s LEFT JOIN l ON l.site_id = s.site_id GROUP BY s.site_id""")
def _(t):
    s = t("fx_site").select("site_id")
    lists = s.where("site_id % 3 = 0").withColumns({"src": F.lit("high"), "r": F.lit(2)}).unionByName(
        s.where("site_id % 2 = 0").withColumns({"src": F.lit("low"), "r": F.lit(1)}))
    per = lists.groupBy("site_id").agg(F.concat_ws(";", F.array_sort(F.collect_set("src"))).alias("l"), F.max("r").alias("r"))
    tier = F.when(F.col("r") == 2, "HIGH").when(F.col("r") == 1, "LOW").otherwise("NONE")
    return s.join(per, "site_id", "left").select("site_id", F.coalesce("l", F.lit("")).alias("source_list"), tier.alias("source_tier"))


@query("gene_panel_semi_join", "J23", """SELECT site_id, symbol FROM fx_site s WHERE EXISTS (SELECT 1 FROM part p WHERE p.p_brand = s.symbol AND p.p_size >= 50 AND p.p_partkey % 7 = 0)""")
def _(t):
    panel = t("part").where("p_size >= 50 AND p_partkey % 7 = 0").select(F.col("p_brand").alias("symbol"))
    return t("fx_site").select("site_id", "symbol").join(panel, "symbol", "left_semi")


@query("ordered_sources", "J24", """WITH u AS (SELECT site_id, 0 AS r, pos % 13 AS v FROM fx_site WHERE site_id % 2 = 0 UNION ALL SELECT site_id, 1, pos % 17 FROM fx_site WHERE site_id % 3 = 0
  UNION ALL SELECT site_id, 2, pos % 19 FROM fx_site WHERE site_id % 5 <> 1), k AS (SELECT site_id, min(r) AS r FROM u GROUP BY site_id)
SELECT u.site_id, u.r AS source_rank, u.v FROM u JOIN k ON k.site_id = u.site_id AND k.r = u.r""")
def _(t):
    s = t("fx_site")
    src = [s.where(c).select("site_id", (F.col("pos") % m).alias("v")) for c, m in (("site_id % 2 = 0", 13), ("site_id % 3 = 0", 17), ("site_id % 5 <> 1", 19))]
    return sel.first_source(src, ["site_id"])


@query("side_tables", "J25,T4", """WITH side AS (SELECT l_partkey AS site_id, max(l_quantity) AS q FROM lineitem GROUP BY l_partkey)
SELECT s.site_id, coalesce(side.q, -1) AS q FROM fx_site s LEFT JOIN side ON side.site_id = s.site_id""")
def _(t):
    side = t("lineitem").select(F.col("l_partkey").alias("site_id"), F.col("l_quantity").alias("q"))
    one = sel.best_per_key(side, ["site_id"], [-F.col("q")], ["q"])
    return t("fx_site").select("site_id").join(one, "site_id", "left").select("site_id", F.coalesce("q", F.lit(-1.0)).alias("q"))


@query("transmitting_parent", "J26", f"""WITH {TRIO}
SELECT child_id, CASE WHEN f_a1 + f_a2 > 0 AND m_a1 + m_a2 > 0 THEN 'both' WHEN f_a1 + f_a2 > 0 THEN 'father' WHEN m_a1 + m_a2 > 0 THEN 'mother' ELSE 'none' END AS parent,
  count(*) AS n FROM trio WHERE c_a1 + c_a2 > 0 GROUP BY 1, 2""")
def _(t):
    d = _wide(t, ["a1", "a2"]).where(trio.carries("c"))
    return d.groupBy("child_id", trio.transmitting_parent().alias("parent")).agg(F.count("*").alias("n"))


@query("cohort_precedence", "J27", """WITH w AS (SELECT DISTINCT family_id, site_id FROM fx_call WHERE family_id % 3 = 0), e AS (SELECT DISTINCT family_id, site_id FROM fx_call WHERE site_id % 2 = 0)
SELECT 'family' AS rule, count(*) AS n FROM e WHERE family_id NOT IN (SELECT family_id FROM w)
UNION ALL SELECT 'family_variant', count(*) FROM e WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.family_id = e.family_id AND w.site_id = e.site_id)""")
def _(t):
    from ..plans.burden import without_seen

    genomes, exomes = t("fx_call").where("family_id % 3 = 0"), t("fx_call").where("site_id % 2 = 0")
    out = [without_seen(exomes, genomes, k).agg(F.count("*").alias("n")).select(F.lit(n).alias("rule"), "n")
           for n, k in (("family", ["family_id"]), ("family_variant", ["family_id", "site_id"]))]
    return out[0].unionByName(out[1])


@query("identity_check", "J28", """WITH pr AS (SELECT l_suppkey AS a, l_partkey % 200 AS b, count(*) AS score FROM lineitem GROUP BY 1, 2),
sym AS (SELECT a AS s, b AS o, score FROM pr WHERE a <> b UNION ALL SELECT b, a, score FROM pr WHERE a <> b),
one AS (SELECT s, o, max(score) AS score FROM sym GROUP BY s, o),
r AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY score DESC, o) AS rn FROM one)
SELECT x.s AS sample_id, x.o AS best, x.score AS best_score, coalesce(y.score, 0) AS second_score,
  CASE WHEN x.score < 2 * coalesce(y.score, 0) THEN 'AMBIGUOUS' WHEN x.o = x.s + 1 THEN 'PASS' ELSE 'SWAP' END AS verdict
FROM r x LEFT JOIN r y ON y.s = x.s AND y.rn = 2 WHERE x.rn = 1""")
def _(t):
    from ..plans.cohort_qc import identity_matrix

    pairs = t("lineitem").groupBy(F.col("l_suppkey").alias("a"), (F.col("l_partkey") % 200).alias("b")).agg(F.count("*").alias("score"))
    return identity_matrix(pairs, F.col("sample_id") + 1, ratio=2)


@query("relatedness", "J29", """WITH g AS (SELECT sample_id, site_id, a1 + a2 AS n FROM fx_genotype), p AS (
 SELECT a.sample_id AS a, b.sample_id AS b, count(*) AS n_sites, count(*) FILTER (abs(a.n - b.n) = 2) AS ibs0, count(*) FILTER (a.n = b.n) AS ibs2, count(*) FILTER (a.n = 1 AND b.n = 1) AS shared_het,
  count(*) FILTER (a.n = 1) AS hets_a, count(*) FILTER (b.n = 1) AS hets_b FROM g a JOIN g b ON b.site_id = a.site_id AND a.sample_id < b.sample_id GROUP BY 1, 2),
r AS (SELECT p.*, CASE k.father_id WHEN p.a THEN 'father' ELSE CASE k.mother_id WHEN p.a THEN 'mother' ELSE 'none' END END AS relation FROM p LEFT JOIN fx_pedigree k ON k.sample_id = p.b)
SELECT CASE relation WHEN 'none' THEN a ELSE b END AS sample_id, CASE relation WHEN 'none' THEN b ELSE a END AS other_id, relation, n_sites, ibs0, ibs2, shared_het, CASE relation WHEN 'none' THEN hets_a ELSE hets_b END AS hets_a,
 CASE relation WHEN 'none' THEN hets_b ELSE hets_a END AS hets_b, CASE WHEN least(hets_a, hets_b) > 0 THEN CAST(shared_het - 2 * ibs0 AS DOUBLE) / least(hets_a, hets_b) END AS relatedness FROM r""")
def _(t):
    from ..plans import cohort_qc

    return cohort_qc.relatedness(t("fx_genotype"), t("fx_pedigree"), ["site_id"])


@query("coordinate_lift", "J30", """WITH blk AS (SELECT chrom, start AS b_start, start + 700 AS b_end, 50000 + interval_id * 13 AS off FROM fx_interval)
SELECT s.sv_id, s.chrom, s.start + b.off AS new_start, least(s."end", b.b_end) + b.off AS new_end
FROM fx_sv s JOIN blk b ON b.chrom = s.chrom AND b.b_start <= s.start AND s.start < b.b_end
WHERE (least(s."end", b.b_end) - s.start) * 100 >= 5 * (s."end" - s.start)""")
def _(t):
    from ..plans.cohort_qc import lift

    blocks = t("fx_interval").select("chrom", F.col("start").alias("b_start"), (F.col("start") + 700).alias("b_end"), (50000 + F.col("interval_id") * 13).alias("offset"))
    return lift(t("fx_sv").select("sv_id", "chrom", "start", "end"), blocks, 0.05).select("sv_id", "chrom", "new_start", "new_end")


@query("fold_assignment", "J31", """SELECT g.family_id % 5 AS fold, CASE WHEN g.family_id % 5 = 2 THEN 'test' ELSE 'train' END AS part, count(*) AS n FROM fx_genotype g GROUP BY 1, 2""")
def _(t):
    folds = t("fx_pedigree").select("family_id", (F.col("family_id") % 5).alias("fold")).distinct()
    d = t("fx_call").join(folds, "family_id")
    return d.groupBy("fold", F.when(F.col("fold") == 2, "test").otherwise("train").alias("part")).agg((F.count("*") * 4).alias("n"))


@query("denovo_funnel", "A33", f"""WITH {TRIO}
SELECT child_id, count(*) AS n_sites, CAST(sum(CASE WHEN p THEN 1 ELSE 0 END) AS BIGINT) AS n_putative,
 CAST(sum(CASE WHEN p AND q >= 20 THEN 1 ELSE 0 END) AS BIGINT) AS n_gq20, CAST(sum(CASE WHEN p AND q >= 30 THEN 1 ELSE 0 END) AS BIGINT) AS n_gq30,
 CAST(sum(CASE WHEN p AND q >= 20 AND least(c_dp, f_dp, m_dp) >= 10 THEN 1 ELSE 0 END) AS BIGINT) AS n_gq_dp,
 CAST(sum(CASE WHEN p AND length(ref) <> length(alt) THEN 1 ELSE 0 END) AS BIGINT) AS n_indel
FROM (SELECT *, c_a1 <> c_a2 AND f_a1 + f_a2 = 0 AND m_a1 + m_a2 = 0 AS p, least(c_gq, f_gq, m_gq) AS q FROM trio) x GROUP BY child_id""")
def _(t):
    d = _wide(t, ["a1", "a2", "gq", "dp"])
    p, q = trio.het("c") & trio.hom_ref("f") & trio.hom_ref("m"), F.least("c_gq", "f_gq", "m_gq")
    return d.groupBy("child_id").agg(
        F.count("*").alias("n_sites"), F.count_if(p).alias("n_putative"), F.count_if(p & (q >= 20)).alias("n_gq20"), F.count_if(p & (q >= 30)).alias("n_gq30"),
        F.count_if(p & (q >= 20) & (F.least("c_dp", "f_dp", "m_dp") >= 10)).alias("n_gq_dp"),
        F.count_if(p & (F.length("ref") != F.length("alt"))).alias("n_indel"))
