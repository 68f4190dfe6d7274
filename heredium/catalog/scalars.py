"""Scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import genotype as g
from ..functions import numeric as nm
from ..functions import reads as rd
from ..functions import rules
from .registry import query

GT = "CASE site_id % 6 WHEN 0 THEN '0/1' WHEN 1 THEN '1|0' WHEN 2 THEN './.' WHEN 3 THEN '1' WHEN 4 THEN '0|0' ELSE '1/2' END"


@query("genotype_text", "F2,F3", f"""WITH x AS (SELECT sample_id, site_id % 6 AS k FROM fx_genotype) SELECT CASE k WHEN 0 THEN '0/1' WHEN 1 THEN '1|0' WHEN 2 THEN './.' WHEN 3 THEN '1' WHEN 4 THEN '0|0' ELSE '1/2' END AS gt,
 CASE k WHEN 2 THEN 'missing' WHEN 3 THEN 'hemizygous' WHEN 4 THEN 'hom_ref' ELSE 'het' END AS zygosity, CASE WHEN k IN (1, 4) THEN 1 ELSE 0 END AS phased, CASE k WHEN 2 THEN 0 WHEN 4 THEN 0 WHEN 5 THEN 2 ELSE 1 END AS n_alt, count(*) AS n FROM x GROUP BY 1, 2, 3, 4""")
def _(t):
    d = t("fx_genotype").select(F.expr(GT).alias("gt")).withColumn("p", g.parse_gt(F.col("gt")))
    al = F.col("p.alleles")
    n_alt = F.coalesce(F.when(al.isNotNull(), g.alt_count(al)), F.lit(0))
    return d.groupBy("gt", g.zygosity(al).alias("zygosity"), F.col("p.phased").cast("int").alias("phased"), n_alt.alias("n_alt")).agg(F.count("*").alias("n"))


@query("allele_ratios", "F6", """SELECT sample_id, round(sum(ad_ref / CAST(ad_alt + 1 AS DOUBLE)), 5) AS ratio_sum, round(sum(CASE WHEN ad_ref + ad_alt > 0 THEN ad_alt / CAST(ad_ref + ad_alt AS DOUBLE) END), 5) AS ab_sum FROM fx_genotype GROUP BY sample_id""")
def _(t):
    r, a = F.col("ad_ref"), F.col("ad_alt")
    return t("fx_genotype").groupBy("sample_id").agg(F.round(F.sum(g.allele_ratio(r, a)), 5).alias("ratio_sum"), F.round(F.sum(g.allele_balance(r, a)), 5).alias("ab_sum"))


@query("pl_triplets", "F6", """SELECT site_id, a, site_id % 7 AS pl0, (site_id + (a * (a + 1)) // 2) % 7 AS pl1, (site_id + (a * (a + 1)) // 2 + a) % 7 AS pl2 FROM (SELECT site_id, 1 + site_id % 3 AS a FROM fx_site) x""")
def _(t):
    d = t("fx_site").select("site_id", (1 + F.col("site_id") % 3).cast("int").alias("a"), F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: (F.col("site_id") + i) % 7).alias("pl"))
    p = g.pl_of_genotype(F.col("pl"), F.col("a"))
    return d.select("site_id", F.col("a").cast("long").alias("a"), *[p[i].alias(f"pl{i}") for i in range(3)])


@query("quality_by_depth", "F7,F8", """SELECT sample_id, round(sum(CASE WHEN dp > 0 THEN coalesce(CASE WHEN site_id % 2 = 0 THEN site_id % 90 END, gq) / CAST(dp AS DOUBLE) END), 5) AS qd_sum, round(sum(greatest(1.0E0, 0.05E0 * (ad_ref + ad_alt))), 5) AS allowance FROM fx_genotype GROUP BY sample_id""")
def _(t):
    qual = F.when(F.col("site_id") % 2 == 0, F.col("site_id") % 90)
    return t("fx_genotype").groupBy("sample_id").agg(F.round(F.sum(g.quality_by_depth(qual, F.col("gq"), F.col("dp"))), 5).alias("qd_sum"), F.round(F.sum(g.error_allowance(F.col("ad_ref") + F.col("ad_alt"))), 5).alias("allowance"))


@query("repeat_motifs", "F9", """SELECT site_id, CASE site_id % 3 WHEN 0 THEN 9 WHEN 1 THEN 6 ELSE 15 END AS excess, greatest(site_id % 40, site_id % 23) AS longest FROM fx_site""")
def _(t):
    m = F.expr("CASE site_id % 3 WHEN 0 THEN 'CAG,CAGCAG' WHEN 1 THEN '.' ELSE 'AAGGG,AAAAG' END")
    mc = F.concat(F.lit("1_"), (F.col("site_id") % 40).cast("string"), F.lit(",2_"), (F.col("site_id") % 23).cast("string"))
    return t("fx_site").select("site_id", rules.repeat_excess(m).alias("excess"), F.array_max(rules.motif_counts(mc, F.lit(1))).cast("long").alias("longest"))


@query("repeat_classes", "F10", """WITH x AS (SELECT sample_id, site_id, CASE WHEN site_id % 8 = 0 THEN least(al1, al2) ELSE greatest(al1, al2) END AS allele, greatest(al1, al2) AS mx, site_id % 12 = 0 AS nocall FROM fx_tr)
SELECT CASE WHEN nocall THEN 'NO_CALL' WHEN allele >= 60 THEN 'PATHOGENIC_RANGE' WHEN allele >= 34 THEN 'INTERMEDIATE' WHEN allele <= 30 THEN 'benign' ELSE 'unclassified' END AS verdict, count(*) AS n, CAST(sum(CASE WHEN nocall THEN 0 ELSE allele END) AS BIGINT) AS allele_sum FROM x GROUP BY 1""")
def _(t):
    counts = F.when(F.col("site_id") % 12 != 0, F.array("al1", "al2"))
    c = rules.repeat_class(counts, F.col("site_id") % 8 == 0, F.lit(False), F.lit(60), F.lit(34), F.lit(30))
    d = t("fx_tr").select(c.alias("c"))
    return d.groupBy(F.col("c.verdict").alias("verdict")).agg(F.count("*").alias("n"), F.sum(F.coalesce("c.allele", F.lit(0))).alias("allele_sum"))


@query("variant_tiers", "F11,F13", """SELECT site_id, CASE WHEN s_het >= 0.18 THEN 1 WHEN s_het >= 0.03 THEN 2 ELSE 3 END AS lof_tier, CASE WHEN s_het IS NULL THEN 'unknown' WHEN s_het >= 0.18 THEN 'high' WHEN s_het >= 0.03 THEN 'moderate' ELSE 'low' END AS band,
 CASE coalesce((gnomad_af < 0.001)::INT, 0) + coalesce((s_het > 0.2)::INT, 0) + (site_id % 2 = 0)::INT + (site_id % 3 = 0)::INT WHEN 4 THEN 1 WHEN 3 THEN 2 WHEN 2 THEN 3 WHEN 1 THEN 4 ELSE 0 END AS missense_tier FROM fx_site""")
def _(t):
    s = F.col("s_het")
    return t("fx_site").select("site_id", rules.lof_tier(s).alias("lof_tier"), rules.s_het_band(s).alias("band"), rules.missense_tier(F.col("gnomad_af") < 0.001, s > 0.2, F.col("site_id") % 2 == 0, F.col("site_id") % 3 == 0).alias("missense_tier"))


@query("sv_lengths", "F14", """SELECT svtype, count(*) AS n, CAST(sum(coalesce(CASE WHEN sv_id % 3 = 0 THEN sv_id % 5000 END, CASE WHEN svtype IN ('DEL', 'DUP', 'INV') THEN "end" - start END, 0)) AS BIGINT) AS len_sum FROM fx_sv GROUP BY svtype""")
def _(t):
    ln = rules.sv_length(F.when(F.col("sv_id") % 3 == 0, -(F.col("sv_id") % 5000)), F.col("start"), F.col("end"), F.col("svtype"))
    return t("fx_sv").groupBy("svtype").agg(F.count("*").alias("n"), F.sum(F.coalesce(ln, F.lit(0))).alias("len_sum"))


# Reads of 5 clipped bases, 20 aligned, a deletion or insertion of 4, then 20 aligned, over a periodic sequence.
@query("cigar_walk", "F15,F17,S12", """WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, 1000 + l_orderkey % 50 AS rs, CASE WHEN l_partkey % 2 = 0 THEN 'D' ELSE 'I' END AS op, 1000 + l_partkey % 120 AS pos FROM lineitem),
o AS (SELECT *, pos - 1 - rs AS d FROM r), q AS (SELECT *, CASE WHEN d >= 0 AND d < 20 THEN 5 + d WHEN op = 'D' AND d >= 24 AND d < 44 THEN d + 1 WHEN op = 'I' AND d >= 20 AND d < 40 THEN d + 9 END AS qi FROM o)
SELECT op, coalesce(CASE qi % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'C' WHEN 2 THEN 'G' WHEN 3 THEN 'T' END, '-') AS base, count(*) AS n, CAST(sum(CASE WHEN abs(rs + 20 - pos) <= 3 THEN 1 ELSE 0 END) AS BIGINT) AS n_indel FROM q GROUP BY 1, 2""")
def _(t):
    d = t("lineitem").select((1000 + F.col("l_orderkey") % 50).alias("rs"), F.when(F.col("l_partkey") % 2 == 0, "D").otherwise("I").alias("op"), (1000 + F.col("l_partkey") % 120).alias("pos"))
    ops = rd.placed(rd.parse_cigar(F.concat(F.lit("5S20M4"), "op", F.lit("20M"))), F.col("rs"))
    d = d.withColumn("ops", ops)
    base = rd.base_at(F.col("ops"), F.repeat(F.lit("ACGT"), F.lit(13)), F.col("pos"))
    indel = rd.indel_at(F.col("ops"), F.col("pos"), 3).isNotNull()
    return d.groupBy("op", F.coalesce(base, F.lit("-")).alias("base")).agg(F.count("*").alias("n"), F.count_if(indel).alias("n_indel"))


@query("junction_signature", "F16", """SELECT CASE WHEN (svtype = 'DEL' AND sv_id % 4 = 0) OR sv_id % 4 = 1 THEN 1 ELSE 0 END AS hit, svtype, count(*) AS n FROM fx_sv GROUP BY 1, 2""")
def _(t):
    d = t("fx_sv").withColumn("len", F.col("end") - F.col("start"))
    k = F.col("sv_id") % 4
    text = F.when(k == 0, F.concat(F.lit("1000M"), F.col("len").cast("string"), F.lit("D1000M"))).otherwise("2000M")
    rs = F.when(k == 1, F.col("start") - 2000).otherwise(F.col("start") - 1000)
    re_ = F.when(k == 1, F.col("start")).when(k == 0, F.col("end") + 1000).otherwise(F.col("start") + 1000)
    sa = F.when(k == 1, F.array(F.struct(F.col("chrom").alias("chrom"), F.col("end").alias("pos"), F.lit("1500M").alias("cigar"))))
    hit = rd.junction_signature(rd.placed(rd.parse_cigar(text), rs), rs, re_, F.col("chrom"), sa, F.col("svtype"), F.col("len"), F.col("start"), F.col("end"))
    return d.groupBy(hit.cast("int").alias("hit"), "svtype").agg(F.count("*").alias("n"))


@query("repeat_read_support", "F17", """WITH x AS (SELECT al1, al2, 18 + site_id % 40 AS len, least(6, greatest(0, (abs(al2 - al1) - 1) // 2)) AS tol FROM fx_tr)
SELECT CASE WHEN abs(len - al2) <= tol AND abs(len - al1) <= tol THEN 'AMB' WHEN abs(len - al2) <= tol THEN 'ALT' WHEN abs(len - al1) <= tol THEN 'REF' ELSE 'AMB' END AS support, count(*) AS n FROM x GROUP BY 1""")
def _(t):
    s = rd.support_tr(18 + F.col("site_id") % 40, F.col("al2"), F.array("al1"), F.lit(6))
    return t("fx_tr").groupBy(s.alias("support")).agg(F.count("*").alias("n"))


@query("sequence_context", "F18", """WITH x AS (SELECT site_id, repeat('A', CAST(site_id % 6 AS INT)) || repeat(ref, CAST(1 + site_id % 4 AS INT)) || 'CGTACG' AS seq, site_id % 6 + 1 AS p, ref, 1 + site_id % 4 AS reps FROM fx_site)
SELECT site_id, CAST(reps + CASE WHEN ref = 'A' THEN site_id % 6 ELSE 0 END + CASE WHEN ref = 'C' THEN 1 ELSE 0 END AS BIGINT) AS run,
 CASE WHEN substr(seq, p, 2) = 'CG' OR (p > 1 AND substr(seq, p - 1, 2) = 'CG') THEN 1 ELSE 0 END AS cpg FROM x""")
def _(t):
    seq = F.concat(F.repeat(F.lit("A"), (F.col("site_id") % 6).cast("int")), F.repeat("ref", (1 + F.col("site_id") % 4).cast("int")), F.lit("CGTACG"))
    at = (F.col("site_id") % 6 + 1).cast("int")
    d = t("fx_site").select("site_id", seq.alias("seq"), at.alias("at"))
    return d.select("site_id", rd.homopolymer_run(F.col("seq"), F.col("at")).cast("long").alias("run"), rd.is_cpg(F.col("seq"), F.col("at")).cast("int").alias("cpg"))


@query("genotype_likelihood", "F20", """WITH x AS (SELECT sample_id, ad_ref AS r, ad_alt AS a FROM fx_genotype), l AS (SELECT *, -10 * (a * log10(0.01) + r * log10(0.99)) AS l0, -10 * ((a + r) * log10(0.5)) AS l1, -10 * (a * log10(0.99) + r * log10(0.01)) AS l2 FROM x)
SELECT CASE WHEN r + a = 0 THEN './.' WHEN l0 <= l1 AND l0 <= l2 THEN '0/0' WHEN l1 <= l2 THEN '0/1' ELSE '1/1' END AS gt, count(*) AS n FROM l GROUP BY 1""")
def _(t):
    gl = nm.genotype_likelihood(F.col("ad_ref"), F.col("ad_alt"))
    return t("fx_genotype").groupBy(gl["gt"].alias("gt")).agg(F.count("*").alias("n"))


@query("tri_state_coding", "F22", """SELECT grp, CASE WHEN asked = 0 OR answer IS NULL THEN 'unknown' WHEN answer > 0 THEN 'present' ELSE 'absent' END AS state, count(*) AS n FROM fx_phenotype GROUP BY 1, 2""")
def _(t):
    s = rules.tri_state(F.col("asked") == 1, F.col("answer"), F.col("answer") > 0)
    return t("fx_phenotype").groupBy("grp", s.alias("state")).agg(F.count("*").alias("n"))


@query("x_skew", "F23", """WITH x AS (SELECT sample_id, avg(CASE WHEN hap = 'hap1' THEN beta END) - avg(CASE WHEN hap = 'hap2' THEN beta END) AS d, 2 * avg(beta) - 0.04 AS span FROM fx_cpg GROUP BY sample_id),
y AS (SELECT sample_id, 0.5 + d / (2 * span) AS trio, 0.5 + sqrt(greatest(d * d - 0.0004, 0)) / (2 * span) AS folded FROM x WHERE span > 0.05)
SELECT sample_id, round(trio, 6) AS trio, round(folded, 6) AS folded, CASE WHEN folded >= 0.9 THEN 'extreme' WHEN folded >= 0.8 THEN 'marked' WHEN folded >= 0.7 THEN 'skewed' ELSE '' END AS band FROM y""")
def _(t):
    hap = lambda h: F.avg(F.when(F.col("hap") == h, F.col("beta")))
    d = t("fx_cpg").groupBy("sample_id").agg((hap("hap1") - hap("hap2")).alias("d"), (2 * F.avg("beta") - 0.04).alias("span")).where("span > 0.05")
    f = rules.folded_skew(F.col("d"), F.lit(0.02), F.col("span"))
    return d.select("sample_id", F.round(rules.trio_skew(F.col("d"), F.col("span")), 6).alias("trio"), F.round(f, 6).alias("folded"), rules.skew_band(f).alias("band"))


@query("transforms", "F24", """SELECT site_id, round(log10(1 + pos), 6) AS log_pos, round(sqrt(pos % 1000 + site_id), 6) AS root FROM fx_site""")
def _(t):
    return t("fx_site").select("site_id", F.round(F.log10(1 + F.col("pos")), 6).alias("log_pos"), F.round(F.sqrt(F.col("pos") % 1000 + F.col("site_id")), 6).alias("root"))


@query("sv_impacts", "F12", """WITH h AS (SELECT s.sv_id, s.svtype, max(CASE WHEN i.kind = 'CDS' THEN 1 ELSE 0 END) AS c, max(CASE WHEN i.kind IN ('UTR5', 'UTR3') THEN 1 ELSE 0 END) AS u FROM fx_sv s LEFT JOIN fx_interval i ON i.chrom = s.chrom AND s.start < i."end" AND i.start < s."end" GROUP BY 1, 2)
SELECT svtype, CASE WHEN svtype = 'BND' THEN 'excluded_BND' WHEN c = 0 AND u = 0 THEN 'intronic_or_exon_noncoding'
 WHEN svtype = 'DEL' THEN CASE WHEN c = 1 THEN 'coding_LoF' ELSE 'UTR_loss' END WHEN svtype = 'INS' THEN CASE WHEN c = 1 THEN 'coding_LoF_insertion' ELSE 'UTR_insertion' END
 WHEN svtype = 'DUP' THEN CASE WHEN c = 1 THEN 'coding_duplication(gain,flag)' ELSE 'UTR_duplication' END ELSE CASE WHEN c = 1 THEN 'coding_inversion' ELSE 'UTR_inversion' END END AS impact, count(*) AS n FROM h GROUP BY 1, 2""")
def _(t):
    from ..plans.clinical import event_kinds
    from .overlaps import features, svs

    k = svs(t).join(event_kinds(svs(t), features(t), ["sv_id"]), "sv_id", "left")
    kinds = F.coalesce("kinds", F.array().cast("array<string>"))
    return k.groupBy("svtype", rules.sv_impact(F.col("svtype"), kinds).alias("impact")).agg(F.count("*").alias("n"))


@query("coding_consequence", "F19,P5", """WITH e AS (SELECT interval_id, chrom, start, "end" FROM fx_interval WHERE kind = 'CDS'), v AS (SELECT interval_id, start + (7 * interval_id) % 60 AS p0, (7 * interval_id) % 60 AS ci, CASE interval_id % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'G' ELSE 'T' END AS alt FROM e),
c AS (SELECT *, ci % 9 AS m FROM v), n AS (SELECT *, substr('ATGGCTTAC', CAST(m - m % 3 + 1 AS INT), 3) AS codon FROM c), w AS (SELECT *, substr(codon, 1, CAST(m % 3 AS INT)) || alt || substr(codon, CAST(m % 3 AS INT) + 2) AS new FROM n),
a AS (SELECT *, CASE codon WHEN 'ATG' THEN 'M' WHEN 'GCT' THEN 'A' ELSE 'Y' END AS a0, CASE new WHEN 'ATG' THEN 'M' WHEN 'GTG' THEN 'V' WHEN 'TTG' THEN 'L' WHEN 'AAG' THEN 'K' WHEN 'AGG' THEN 'R' WHEN 'ATA' THEN 'I' WHEN 'ATT' THEN 'I' WHEN 'GCT' THEN 'A' WHEN 'ACT' THEN 'T' WHEN 'TCT' THEN 'S' WHEN 'GAT' THEN 'D' WHEN 'GGT' THEN 'G' WHEN 'GTT' THEN 'V' WHEN 'GCA' THEN 'A' WHEN 'GCG' THEN 'A'
 WHEN 'TAC' THEN 'Y' WHEN 'AAC' THEN 'N' WHEN 'GAC' THEN 'D' WHEN 'TGC' THEN 'C' WHEN 'TTC' THEN 'F' WHEN 'TAA' THEN '*' WHEN 'TAG' THEN '*' WHEN 'TAT' THEN 'Y' END AS a1 FROM w)
SELECT interval_id, CASE WHEN a0 = a1 THEN 'synonymous' WHEN a1 = '*' THEN 'nonsense' WHEN ci < 3 THEN 'start_loss' ELSE 'missense' END AS class, 'p.' || a0 || CAST(ci // 3 + 1 AS STRING) || a1 AS detail FROM a""")
def _(t):
    from ..plans.consequence import coding_consequence

    e = t("fx_interval").where("kind = 'CDS'").withColumn("symbol", F.col("interval_id").cast("string"))
    alt = F.element_at(F.array(F.lit("A"), F.lit("G"), F.lit("T")), (F.col("interval_id") % 3 + 1).cast("int"))
    v = e.select("interval_id", "chrom", (F.col("start") + (7 * F.col("interval_id")) % 60 + 1).alias("pos"), F.lit("N").alias("ref"), alt.alias("alt"), F.col("symbol").alias("own"))
    exons = e.select("symbol", "chrom", F.col("start").alias("e_start"), F.col("end").alias("e_end"), F.lit(0).alias("c_start"))
    tx = e.select("symbol", F.lit(1).alias("strand"), F.repeat(F.lit("ATGGCTTAC"), F.ceil((F.col("end") - F.col("start")) / 9).cast("int")).alias("cds"))
    return coding_consequence(v, exons, tx, ["interval_id", "own"]).where("own = symbol").select("interval_id", "class", "detail")
