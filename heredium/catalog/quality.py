"""Source parsing and data-quality queries. Text lines are composed from the given tables and parsed back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans import audit
from ..sources import sinks, text
from ..storage import cut
from .registry import query

VCF_LINE = """concat_ws('\t', chrom, pos, '.', ref, alt, '50', 'PASS', concat('AC=', a1 + a2, ';DB'), 'GT:GQ:DP:AD:PS', concat(a1, CASE WHEN phased = 1 THEN '|' ELSE '/' END, a2, ':', gq, ':', dp, ':', ad_ref, ',', ad_alt, CASE WHEN phased = 1 THEN concat(':', ps) ELSE '' END))"""


def vcf_lines(t):
    g = t("fx_genotype").withColumn("file", F.concat(F.lit("s"), F.col("sample_id"), F.lit(".vcf")))
    head = g.select("file", "sample_id").distinct().select("file", F.concat(F.lit("#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\t"), F.col("sample_id").cast("string")).alias("line"))
    return cut(g.select("file", F.expr(VCF_LINE).alias("line")).unionByName(head))        # written once: the parser reads lines more than once, as it would files


@query("vcf_genotypes", "S1,S2,F2", """SELECT CAST(sample_id AS STRING) AS sample_id, chrom, count(*) AS n, CAST(sum(a1 + a2) AS BIGINT) AS n_alt, CAST(sum(phased) AS BIGINT) AS n_phased, CAST(sum(ad_alt) AS BIGINT) AS ad_alt, CAST(sum(CASE WHEN phased = 1 THEN ps ELSE 0 END) AS BIGINT) AS ps_sum FROM fx_genotype GROUP BY 1, 2""")
def _(t):
    d = text.genotype_rows(text.parse_vcf(vcf_lines(t)))
    return d.groupBy("sample_id", "chrom").agg(F.count("*").alias("n"), F.sum(F.aggregate("alleles", F.lit(0), lambda a, x: a + x)).alias("n_alt"), F.count_if("phased").alias("n_phased"), F.sum(F.col("ad")[1]).alias("ad_alt"), F.sum(F.coalesce("ps", F.lit(0))).alias("ps_sum"))


@query("vcf_info", "S2", """SELECT chrom, CAST(sum(a1 + a2) AS BIGINT) AS ac, count(*) AS n_db FROM fx_genotype GROUP BY chrom""")
def _(t):
    d = text.parse_vcf(vcf_lines(t))
    return d.groupBy("chrom").agg(F.sum(F.col("info")["AC"].cast("long")).alias("ac"), F.count_if(F.col("info")["DB"] == "1").alias("n_db"))


@query("complete_trios", "S3,S4", """SELECT c.sample_id, c.sex FROM fx_pedigree c JOIN fx_pedigree f ON f.sample_id = c.father_id JOIN fx_pedigree m ON m.sample_id = c.mother_id WHERE m.sample_id % 12 <> 1""")
def _(t):
    from ..operators.trio import complete_trios

    p = t("fx_pedigree").where("NOT (slot = 1 AND sample_id % 12 = 1)")
    sexes = p.select("sample_id", F.when(F.col("sex") == "M", "1").otherwise("female").alias("sex"))
    m = text.build_manifest(p.select("sample_id", "family_id"), p.select("sample_id", "father_id", "mother_id"), sexes, p.where("affected = 1"))
    return complete_trios(m).select("sample_id", "sex")


@query("bed_features", "S6,S5", """SELECT chrom, kind, count(*) AS n, CAST(sum("end" - start) AS BIGINT) AS bp FROM fx_interval GROUP BY 1, 2""")
def _(t):
    lines = t("fx_interval").select(F.concat_ws("\t", "chrom", F.col("start").cast("string"), F.col("end").cast("string"), "kind").alias("line"))
    d = text.parse_bed(lines.unionByName(t.spark.createDataFrame([("#header",), ("track name=x",)], "line string")), ["kind"])
    return d.groupBy("chrom", "kind").agg(F.count("*").alias("n"), F.sum(F.col("end") - F.col("start")).alias("bp"))


@query("gff_symbols", "S7", """SELECT symbol, count(*) AS n_exons, CAST(sum("end" - start) AS BIGINT) AS bp FROM fx_interval GROUP BY symbol""")
def _(t):
    i = t("fx_interval")
    line = lambda kind, attrs: F.concat_ws("\t", "chrom", F.lit("src"), F.lit(kind), (F.col("start") + 1).cast("string"), F.col("end").cast("string"), F.lit("."), F.lit("+"), F.lit("."), attrs).alias("line")
    k = F.col("interval_id").cast("string")
    lines = i.select(line("gene", F.concat(F.lit("ID=g"), k, F.lit(";Name="), F.col("symbol")))).unionByName(
        i.select(line("mRNA", F.concat(F.lit("ID=t"), k, F.lit(";Parent=g"), k)))).unionByName(i.select(line("exon", F.concat(F.lit("ID=e"), k, F.lit(";Parent=t"), k))))
    d = text.resolve_symbols(text.parse_gff(lines)).where("kind = 'exon'")
    return d.groupBy("symbol").agg(F.count("*").alias("n_exons"), F.sum(F.col("end") - F.col("start")).alias("bp"))


@query("pileup_rows", "S9", """SELECT chrom, count(*) AS n, CAST(sum(depth) AS BIGINT) AS depth FROM fx_cpg WHERE depth >= 10 GROUP BY chrom""")
def _(t):
    lines = t("fx_cpg").select(F.concat_ws("\t", "chrom", F.col("pos").cast("string"), (F.col("pos") + 1).cast("string"), F.round(100 * F.col("beta"), 3).cast("string"), "hap", F.col("depth").cast("string")).alias("line"))
    return text.parse_pileup(lines, 10).groupBy("chrom").agg(F.count("*").alias("n"), F.sum("depth").alias("depth"))


@query("parquet_scan", "S8,A7", """SELECT p_brand, count(*) AS n FROM part WHERE p_size > 25 AND p_type = 'PROMO' GROUP BY p_brand""")
def _(t):
    return t("part").where("p_size > 25 AND p_type = 'PROMO'").groupBy("p_brand").agg(F.count("*").alias("n"))


@query("sites_vcf_lines", "S15", """SELECT chrom || chr(9) || CAST(pos AS STRING) || chr(9) || '.' || chr(9) || ref || chr(9) || alt || chr(9) || '.' || chr(9) || 'PASS' || chr(9) || 'GENE=' || symbol || CASE WHEN s_het IS NULL THEN '' ELSE ';SH=' || CAST(CAST(round(s_het * 100) AS BIGINT) AS STRING) END AS value FROM fx_site""")
def _(t):
    return sinks.sites_vcf(t("fx_site"), {"GENE": F.col("symbol"), "SH": F.round(F.col("s_het") * 100).cast("long")})


@query("sites_bed_lines", "S16", """SELECT DISTINCT chrom || chr(9) || CAST(pos - 2 AS STRING) || chr(9) || CAST(pos + 1 AS STRING) AS value FROM fx_genotype WHERE a1 <> a2""")
def _(t):
    return sinks.sites_bed(t("fx_genotype").where("a1 <> a2"), 1)


@query("wide_mean_difference", "S18", """SELECT cpg_id, round(avg(beta) FILTER (sample_id % 2 = 0) - avg(beta) FILTER (sample_id % 2 = 1), 6) AS delta FROM (SELECT cpg_id, sample_id, CASE WHEN depth > 5 THEN beta END AS beta FROM fx_cpg) x GROUP BY 1""")
def _(t):
    of = lambda s: F.max(F.when((F.col("sample_id") == s) & (F.col("depth") > 5), F.col("beta"))).alias(f"s{s}")
    w = t("fx_cpg").groupBy("cpg_id").agg(*[of(s) for s in range(24)])
    return text.mean_difference(w, [f"s{s}" for s in range(0, 24, 2)], [f"s{s}" for s in range(1, 24, 2)]).select("cpg_id", F.round("delta", 6).alias("delta"))


@query("summary_rows", "S17", """SELECT sample_id, count(*) AS n_sites, CAST(sum(CASE WHEN a1 <> a2 THEN 1 ELSE 0 END) AS BIGINT) AS n_het, round(avg(CASE WHEN a1 <> a2 THEN 1.0E0 ELSE 0 END), 6) AS het_frac, '1' AS params_version FROM fx_genotype GROUP BY 1""")
def _(t):
    het = F.col("a1") != F.col("a2")
    return t("fx_genotype").groupBy("sample_id").agg(F.count("*").alias("n_sites"), F.count_if(het).alias("n_het"), F.round(F.avg(het.cast("double")), 6).alias("het_frac"), F.lit("1").alias("params_version"))


@query("vocabulary_check", "Q1", """SELECT CASE WHEN v.w IS NULL THEN 'FAIL' ELSE 'WARN' END AS level, 'vocabulary:svtype' AS "check", coalesce(s.svtype, v.w) AS detail FROM (SELECT DISTINCT svtype FROM fx_sv) s FULL OUTER JOIN (VALUES ('DEL'), ('DUP'), ('INS'), ('CNV')) v(w) ON v.w = s.svtype WHERE v.w IS NULL OR s.svtype IS NULL""")
def _(t):
    return audit.vocabulary(t("fx_sv"), "svtype", ["DEL", "DUP", "INS", "CNV"])


@query("row_count_check", "Q2", """WITH a AS (SELECT chrom, count(*) AS n FROM fx_sv GROUP BY 1), b AS (SELECT chrom, count(*) AS n FROM fx_sv WHERE svtype <> 'BND' OR chrom = 'chr1' GROUP BY 1) SELECT 'FAIL' AS level, 'row_counts' AS "check", a.chrom || '/' || CAST(a.n AS STRING) || '/' || CAST(coalesce(b.n, 0) AS STRING) AS detail FROM a LEFT JOIN b ON b.chrom = a.chrom WHERE a.n <> coalesce(b.n, 0)""")
def _(t):
    return audit.row_counts(t("fx_sv"), t("fx_sv").where("svtype <> 'BND' OR chrom = 'chr1'"), ["chrom"])


@query("column_status", "Q3,Q7", """SELECT * FROM (VALUES ('WARN', 'columns', 'one:constant'), ('FAIL', 'columns', 'nothing:empty'), ('FAIL', 'columns', 'gone:missing')) v(level, "check", detail) WHERE (SELECT count(*) FROM part) > 0""")
def _(t):
    d = t("fx_site").withColumns({"one": F.lit(1), "nothing": F.lit(None).cast("string")})
    return audit.column_status(d, ["chrom", "one", "nothing", "gone"])


@query("completeness_check", "Q5", """SELECT 'FAIL' AS level, 'missing_output' AS "check", CAST(sample_id AS STRING) AS detail FROM fx_pedigree WHERE sample_id NOT IN (SELECT sample_id FROM fx_sv) UNION ALL SELECT 'WARN', 'stray_output', CAST(sample_id AS STRING) FROM (SELECT DISTINCT sample_id FROM fx_sv) x WHERE sample_id % 4 < 2""")
def _(t):
    p, s = t("fx_pedigree"), t("fx_sv")
    a = audit.completeness(p, s, ["sample_id"]).where("level = 'FAIL'")
    return a.unionByName(audit.completeness(p.where("slot >= 2"), s, ["sample_id"]).where("level = 'WARN'"))


@query("version_check", "Q6", """SELECT 'FAIL' AS level, 'single_version' AS "check", '1,2' AS detail WHERE (SELECT count(DISTINCT s_suppkey % 2) FROM supplier) > 1""")
def _(t):
    return audit.single_version(t("supplier").withColumn("params_version", F.when(F.col("s_suppkey") % 2 == 0, "1").otherwise("2")))


@query("fill_rate_check", "Q7", """SELECT 'FAIL' AS level, 'fill_rate:v' AS "check", CAST(round(avg(CASE WHEN p_partkey % 3 = 0 THEN 0.0E0 ELSE 1 END), 4) AS STRING) AS detail FROM part""")
def _(t):
    d = t("part").withColumn("v", F.when(F.col("p_partkey") % 3 == 0, " ").when(F.col("p_partkey") % 3 == 1, ".").otherwise("x"))
    return audit.fill_rate(d, "v", 0.9)


@query("findings_table", "Q8", """SELECT level, count(*) AS n FROM (SELECT CASE WHEN v.w IS NULL THEN 'FAIL' ELSE 'WARN' END AS level FROM (SELECT DISTINCT svtype FROM fx_sv) s FULL OUTER JOIN (VALUES ('DEL'), ('DUP'), ('INS'), ('CNV')) v(w) ON v.w = s.svtype WHERE v.w IS NULL OR s.svtype IS NULL
 UNION ALL SELECT 'FAIL' FROM fx_pedigree p WHERE (SELECT count(*) FROM fx_sv s WHERE s.sample_id = p.sample_id) < 130) x GROUP BY level""")
def _(t):
    return audit.failures(audit.findings(audit.vocabulary(t("fx_sv"), "svtype", ["DEL", "DUP", "INS", "CNV"]), audit.minimum_events(t("fx_sv"), t("fx_pedigree"), "sample_id", 130)))


@query("island_profile_rows", "S10", """SELECT concat('s', sample_id) AS sample_id, count(*) AS n, round(sum(round(beta, 6)), 4) AS total FROM fx_cpg GROUP BY 1""")
def _(t):
    of = lambda s: F.coalesce(F.max(F.when(F.col("sample_id") == s, F.round("beta", 6))).cast("string"), F.lit("."))
    c = t("fx_cpg").groupBy("chrom", "pos").agg(*[of(s).alias(f"s{s}") for s in range(24)])
    row = lambda cols: F.concat_ws("\t", "chrom", F.col("pos").cast("string"), (F.col("pos") + 1).cast("string"), F.lit("i"), *cols).alias("line")
    # two files list their samples in different column orders
    files = {"p": [f"s{s}" for s in range(0, 24, 2)], "q": [f"s{s}" for s in range(23, 0, -2)]}
    lines = None
    for name, cols in files.items():
        d = c.select(F.lit(name).alias("file"), row(cols))
        lines = d if lines is None else lines.unionByName(d)
    heads = t.spark.createDataFrame([(n, "\t".join(["chrom", "start", "end", "label", *cols])) for n, cols in files.items()], "file string, line string")
    d = text.island_profile(lines.unionByName(heads)).where("value IS NOT NULL")
    return d.groupBy("sample_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("catalogue_entries", "S11", """SELECT interval_id, symbol, read_id FROM (SELECT interval_id, symbol, unnest([interval_id * 2, interval_id * 2 + 1]) AS read_id FROM fx_interval) x""")
def _(t):
    entry = F.to_json(F.struct("interval_id", "symbol", F.array(F.col("interval_id") * 2, F.col("interval_id") * 2 + 1).alias("reads")))
    lines = t("fx_interval").select(entry.alias("line"))
    return text.parse_catalogue(lines, "interval_id bigint, symbol string, reads array<bigint>", "reads").select("interval_id", "symbol", F.col("reads").alias("read_id"))


@query("hashed_read_names", "S14", """SELECT read_id, substr(sha256('salt' || CAST(read_id AS STRING)), 1, 16) AS hashed FROM (SELECT DISTINCT read_id FROM fx_read) x""")
def _(t):
    return t("fx_read").select("read_id").distinct().withColumn("hashed", sinks.hashed(F.col("read_id"), "salt"))
