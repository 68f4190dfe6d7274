"""Interval, nearest and window-by-position queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules
from ..operators import intervals as iv
from ..operators import ordered
from ..operators import selection as sel
from .registry import query


def features(t, where: str = "1 = 1"):
    return t("fx_interval").where(where).select("chrom", F.col("start").alias("b_start"), F.col("end").alias("b_end"), "interval_id", "symbol", "kind")


def svs(t, where: str = "1 = 1"):
    return t("fx_sv").where(where)


OV = 'i.chrom = s.chrom AND s.start < i."end" AND i.start < s."end"'


@query("overlap_gene_sets", "J9", f"""SELECT s.sv_id, string_agg(DISTINCT i.symbol, ';' ORDER BY i.symbol) AS genes, count(*) AS n_features
FROM fx_sv s JOIN fx_interval i ON {OV} AND i.kind <> 'mask' GROUP BY s.sv_id""")
def _(t):
    hit = iv.overlap_join(svs(t), features(t, "kind <> 'mask'"))
    return hit.groupBy("sv_id").agg(F.concat_ws(";", F.array_sort(F.collect_set("symbol"))).alias("genes"), F.count("*").alias("n_features"))


@query("overlap_pairs", "J9", f"""SELECT s.sv_id, i.interval_id, least(s."end", i."end") - greatest(s.start, i.start) AS overlap_bp FROM fx_sv s JOIN fx_interval i ON {OV}""")
def _(t):
    hit = iv.overlap_join(svs(t), features(t))
    return hit.select("sv_id", "interval_id", iv.overlap_length(F.col("start"), F.col("end"), F.col("b_start"), F.col("b_end")).alias("overlap_bp"))


@query("mask_anti_join", "J10,U4", f"""SELECT s.sv_id, s.chrom FROM fx_sv s WHERE NOT EXISTS (SELECT 1 FROM fx_interval i WHERE {OV} AND i.kind = 'mask')""")
def _(t):
    return iv.interval_anti(svs(t), features(t, "kind = 'mask'"), ["sv_id"]).select("sv_id", "chrom")


MERGED = """mk AS (SELECT chrom, start, "end" FROM fx_interval WHERE kind IN ('mask', 'gene')),
mo AS (SELECT *, max("end") OVER (PARTITION BY chrom ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM mk),
mg AS (SELECT *, sum(CASE WHEN pe IS NULL OR start > pe THEN 1 ELSE 0 END) OVER (PARTITION BY chrom ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS gid FROM mo),
merged AS (SELECT chrom, min(start) AS start, max("end") AS "end", count(*) AS n FROM mg GROUP BY chrom, gid)"""


@query("fraction_masked", "J11", f"""WITH {MERGED}, ov AS (SELECT s.sv_id, sum(least(s."end", i."end") - greatest(s.start, i.start)) AS bp FROM fx_sv s JOIN merged i ON {OV} GROUP BY s.sv_id)
SELECT s.sv_id, CAST(coalesce(ov.bp, 0) AS BIGINT) AS covered_bp,
  CASE WHEN s."end" - s.start <= 50 THEN CASE WHEN coalesce(ov.bp, 0) > 0 THEN 1 ELSE 0 END WHEN coalesce(ov.bp, 0) * 2 >= s."end" - s.start THEN 1 ELSE 0 END AS masked
FROM fx_sv s LEFT JOIN ov ON ov.sv_id = s.sv_id""")
def _(t):
    cov = iv.covered_fraction(svs(t), features(t, "kind IN ('mask', 'gene')"), ["sv_id"])
    n, bp = F.col("end") - F.col("start"), F.coalesce("covered_bp", F.lit(0).cast("long"))
    flag = F.when(n <= 50, bp > 0).otherwise(bp * 2 >= n).cast("int")
    return svs(t).join(cov, "sv_id", "left").select("sv_id", bp.alias("covered_bp"), flag.alias("masked"))


@query("reciprocal_overlap_max", "J12,A29", """WITH p AS (SELECT *, sv_id % 17 AS ac FROM fx_sv WHERE sv_id % 3 = 0),
q AS (SELECT s.sv_id, p.ac FROM fx_sv s JOIN p ON p.chrom = s.chrom AND p.svtype = s.svtype AND p.sv_id <> s.sv_id AND s.start < p."end" AND p.start < s."end"
  AND 2 * (least(s."end", p."end") - greatest(s.start, p.start)) >= s."end" - s.start AND 2 * (least(s."end", p."end") - greatest(s.start, p.start)) >= p."end" - p.start)
SELECT s.sv_id, coalesce(max(q.ac), 0) AS max_ac, count(q.ac) AS n_match FROM fx_sv s LEFT JOIN q ON q.sv_id = s.sv_id GROUP BY s.sv_id""")
def _(t):
    panel = svs(t, "sv_id % 3 = 0").select("chrom", "svtype", F.col("sv_id").alias("p_id"), F.col("start").alias("b_start"), F.col("end").alias("b_end"), (F.col("sv_id") % 17).alias("ac"))
    hit = iv.overlap_join(svs(t).select("sv_id", "chrom", "svtype", "start", "end"), panel, keys=("chrom", "svtype")).where("p_id <> sv_id")
    best = iv.reciprocal(hit, ("start", "end"), ("b_start", "b_end")).groupBy("sv_id").agg(F.max("ac").alias("m"), F.count("*").alias("n"))
    z = F.lit(0).cast("long")
    return svs(t).select("sv_id").join(best, "sv_id", "left").select("sv_id", F.coalesce("m", z).alias("max_ac"), F.coalesce("n", z).alias("n_match"))


SVC = """sv AS (SELECT sv_id, chrom, start AS pos, "end" - start AS len, sv_id % 17 AS ac,
  CASE WHEN svtype = 'INS' THEN start ELSE "end" END AS e, CASE svtype WHEN 'INS' THEN 'INSDUP' WHEN 'DUP' THEN 'INSDUP' WHEN 'BND' THEN NULL ELSE svtype END AS cls FROM fx_sv)"""


@query("sv_match_multi", "J13", f"""WITH {SVC}, m AS (SELECT a.sv_id, b.sv_id AS panel_id, b.ac,
 concat(CASE WHEN abs(b.pos - a.pos) <= 500 THEN '+left' ELSE '' END, CASE WHEN a.e > a.pos AND b.e > b.pos AND abs(b.e - a.e) <= 500 THEN '+right' ELSE '' END,
   CASE WHEN abs(a.len - b.len) <= greatest(500, a.len // 10) THEN '+length' ELSE '' END,
   CASE WHEN a.e > a.pos AND b.e > b.pos AND least(a.e, b.e) - greatest(a.pos, b.pos) > 0 AND 2 * (least(a.e, b.e) - greatest(a.pos, b.pos)) >= greatest(a.e - a.pos, b.e - b.pos) THEN '+ro' ELSE '' END) AS basis
 FROM sv a JOIN sv b ON a.chrom = b.chrom AND a.cls = b.cls AND b.sv_id % 3 = 0 AND a.sv_id <> b.sv_id AND b.pos >= a.pos - a.len - 500 AND b.pos <= a.e + 500),
r AS (SELECT *, row_number() OVER (PARTITION BY sv_id ORDER BY ac DESC, panel_id) AS rn FROM m WHERE basis <> '')
SELECT sv_id, panel_id, ac, substr(basis, 2) AS basis FROM r WHERE rn = 1""")
def _(t):
    from ..plans.panelsv import match_sv

    cls = rules.sv_match_class(F.col("svtype"))
    point = F.when(F.col("svtype") == "INS", F.col("start")).otherwise(F.col("end"))
    d = svs(t).select("sv_id", "chrom", cls.alias("cls"), F.col("start").alias("pos"), point.alias("stop"), (F.col("end") - F.col("start")).alias("len"))
    panel = d.where("sv_id % 3 = 0").select("chrom", "cls", F.col("sv_id").alias("panel_id"), F.col("pos").alias("p_pos"), F.col("stop").alias("p_stop"), F.col("len").alias("p_len"), (F.col("sv_id") % 17).alias("ac"))
    m = match_sv(d, panel).where("panel_id <> sv_id")
    return sel.best_per_key(m, ["sv_id"], [-F.col("ac"), F.col("panel_id")], ["panel_id", "ac", "basis"])


@query("sv_match_nearest", "J14", """WITH m AS (SELECT a.sv_id, b.sv_id AS other_id, abs(a.start - b.start) AS dpos FROM fx_sv a JOIN fx_sv b ON a.chrom = b.chrom AND a.svtype = b.svtype AND b.sv_id % 3 = 1
 AND a.sv_id <> b.sv_id AND abs(a.start - b.start) <= 2500 AND 10 * least(a."end" - a.start, b."end" - b.start) >= 7 * greatest(a."end" - a.start, b."end" - b.start)),
r AS (SELECT *, row_number() OVER (PARTITION BY sv_id ORDER BY dpos, other_id) AS rn FROM m) SELECT sv_id, other_id, dpos FROM r WHERE rn = 1""")
def _(t):
    from ..plans.panelsv import match_start_size

    d = svs(t).select("sv_id", "chrom", "svtype", F.col("start").alias("pos"), (F.col("end") - F.col("start")).alias("len"))
    other = d.where("sv_id % 3 = 1").select("chrom", "svtype", F.col("sv_id").alias("other_id"), F.col("pos").alias("o_pos"), F.col("len").alias("o_len"))
    m = match_start_size(d, other, 2500, 0.7).where("other_id <> sv_id")
    return sel.best_per_key(m, ["sv_id"], [F.col("dpos"), F.col("other_id")], ["other_id", "dpos"])


@query("sv_match_baseline", "J15", """WITH c AS (SELECT a.sv_id, b.sv_id AS base_id, CASE WHEN abs(a.start - b.start) <= 500 AND abs(a."end" - b."end") <= 500 THEN 0
  WHEN a.svtype IN ('DEL', 'DUP', 'INV') THEN CASE WHEN 2 * (least(a."end", b."end") - greatest(a.start, b.start)) >= a."end" - a.start AND 2 * (least(a."end", b."end") - greatest(a.start, b.start)) >= b."end" - b.start THEN 1 END
  WHEN abs(a.start - b.start) <= 500 THEN 2 END AS pr FROM fx_sv a JOIN fx_sv b ON a.chrom = b.chrom AND (a.svtype = b.svtype OR (a.svtype IN ('INS', 'DUP') AND b.svtype IN ('INS', 'DUP')))
  AND b.sv_id % 3 = 0 AND a.sv_id % 3 <> 0 AND a.start < b."end" + 500 AND b.start < a."end" + 500),
r AS (SELECT *, row_number() OVER (PARTITION BY sv_id ORDER BY pr, base_id) AS rn FROM c WHERE pr IS NOT NULL) SELECT sv_id, base_id, pr AS basis FROM r WHERE rn = 1""")
def _(t):
    from ..plans.panelsv import match_baseline

    d = svs(t).select("sv_id", "chrom", "svtype", "start", "end")
    base = d.where("sv_id % 3 = 0").select("chrom", F.col("svtype").alias("b_type"), F.col("sv_id").alias("base_id"), F.col("start").alias("b_start"), F.col("end").alias("b_end"))
    return match_baseline(d.where("sv_id % 3 <> 0"), base, ["sv_id"], "base_id")


@query("nearest_segment", "J16", """WITH seg AS (SELECT interval_id, chrom, start, "end" FROM fx_interval),
d AS (SELECT s.sv_id, g.interval_id, greatest(g.start - s.start, s.start - g."end", 0) AS dist, g.start AS gs FROM fx_sv s JOIN seg g ON g.chrom = s.chrom AND s.start >= g.start - 30000 AND s.start <= g."end" + 30000),
r AS (SELECT *, row_number() OVER (PARTITION BY sv_id ORDER BY dist, gs, interval_id) AS rn FROM d) SELECT sv_id, interval_id, dist AS seg_dist FROM r WHERE rn = 1""")
def _(t):
    q = svs(t).select("sv_id", "chrom", F.col("start").alias("pos"))
    return iv.nearest_segment(q, features(t, "true"), ["sv_id"], 30000, ["interval_id"], tie=["b_start", "interval_id"]).select("sv_id", "interval_id", "seg_dist")


@query("nearest_point", "J17", """WITH p AS (SELECT DISTINCT chrom, start AS pt FROM fx_interval), d AS (SELECT s.sv_id, min(abs(s.start - p.pt)) AS dist,
 max(CASE WHEN p.pt <= s.start THEN p.pt END) AS prev_point, min(CASE WHEN p.pt >= s.start THEN p.pt END) AS next_point FROM fx_sv s LEFT JOIN p ON p.chrom = s.chrom GROUP BY s.sv_id)
SELECT sv_id, coalesce(dist, -1) AS dist_point, coalesce(prev_point, -1) AS prev_point, coalesce(next_point, -1) AS next_point FROM d""")
def _(t):
    q = svs(t).select("sv_id", "chrom", F.col("start").alias("pos"))
    d = iv.nearest_points(q, t("fx_interval").select("chrom", F.col("start").alias("pos")))
    none = F.lit(-1).cast("long")
    return d.select("sv_id", *[F.coalesce(c, none).alias(c) for c in ("dist_point", "prev_point", "next_point")])


@query("containing_segment", "J18,J32", """WITH seg AS (SELECT interval_id, chrom, start, start + 900 * (1 + interval_id % 15) AS e FROM fx_interval)
SELECT s.sv_id, g.interval_id, s.start - g.start AS left_dist, g.e - s.start AS right_dist FROM fx_sv s JOIN seg g ON g.chrom = s.chrom AND g.start <= s.start AND s.start < g.e""")
def _(t):
    seg = t("fx_interval").select("chrom", "interval_id", F.col("start").alias("b_start"), (F.col("start") + 900 * (1 + F.col("interval_id") % 15)).alias("b_end"))
    hit = iv.point_join(svs(t).select("sv_id", "chrom", F.col("start").alias("pos")), seg)
    return hit.select("sv_id", "interval_id", (F.col("pos") - F.col("b_start")).alias("left_dist"), (F.col("b_end") - F.col("pos")).alias("right_dist"))


@query("point_bounds", "J19", """WITH s AS (SELECT site_id, chrom, 3000000 + 728 * site_id + 60 * (site_id % 51) AS pos FROM fx_site), h AS (
 SELECT 'half_open' AS bounds, s.site_id FROM (SELECT site_id, 'chr' || CAST(1 + site_id % 22 AS STRING) AS chrom, pos FROM s) s JOIN fx_interval i ON i.chrom = s.chrom AND i.start <= s.pos AND s.pos < i."end"
 UNION ALL SELECT 'closed', s.site_id FROM (SELECT site_id, 'chr' || CAST(1 + site_id % 22 AS STRING) AS chrom, pos FROM s) s JOIN fx_interval i ON i.chrom = s.chrom AND i.start <= s.pos AND s.pos <= i."end"
 UNION ALL SELECT 'left_open', s.site_id FROM (SELECT site_id, 'chr' || CAST(1 + site_id % 22 AS STRING) AS chrom, pos FROM s) s JOIN fx_interval i ON i.chrom = s.chrom AND i.start < s.pos AND s.pos <= i."end")
SELECT bounds, count(*) AS n FROM h GROUP BY bounds""")
def _(t):
    pts = t("fx_site").select("site_id", F.concat(F.lit("chr"), (1 + F.col("site_id") % 22).cast("string")).alias("chrom"), (3000000 + 728 * F.col("site_id") + 60 * (F.col("site_id") % 51)).alias("pos"))
    out = None
    for name, b in (("half_open", iv.HALF_OPEN), ("closed", iv.CLOSED), ("left_open", iv.LEFT_OPEN)):
        d = iv.point_join(pts, features(t), bounds=b).agg(F.count("*").alias("n")).where("n > 0").select(F.lit(name).alias("bounds"), "n")
        out = d if out is None else out.unionByName(d)
    return out


@query("point_to_region", "J20,A17", """SELECT c.sample_id, r.region_id, count(*) AS n_cpg, round(avg(c.beta), 6) AS mean_beta, round(avg(c.depth), 6) AS mean_depth
FROM fx_cpg c JOIN fx_region r ON r.chrom = c.chrom AND r.start <= c.pos AND c.pos < r."end" GROUP BY 1, 2""")
def _(t):
    from ..plans.methylation import region_means

    r = t("fx_region").select("region_id", "chrom", F.col("start").alias("b_start"), F.col("end").alias("b_end"))
    d = region_means(t("fx_cpg"), r, ["sample_id"], min_cpgs=0, min_depth=0)
    return d.select("sample_id", "region_id", "n_cpg", F.round("mean_beta", 6).alias("mean_beta"), F.round("mean_depth", 6).alias("mean_depth"))


@query("region_means_floored", "A17", """WITH m AS (SELECT c.sample_id, r.region_id, count(*) AS n_cpg, avg(c.beta) AS b, avg(c.depth) AS d
FROM fx_cpg c JOIN fx_region r ON r.chrom = c.chrom AND r.start <= c.pos AND c.pos < r."end" GROUP BY 1, 2)
SELECT sample_id, region_id, n_cpg, CASE WHEN n_cpg >= 3 AND d >= 15 THEN round(b, 6) END AS mean_beta FROM m""")
def _(t):
    from ..plans.methylation import region_means

    r = t("fx_region").select("region_id", "chrom", F.col("start").alias("b_start"), F.col("end").alias("b_end"))
    d = region_means(t("fx_cpg"), r, ["sample_id"], min_cpgs=3, min_depth=15)
    return d.select("sample_id", "region_id", "n_cpg", F.round("mean_beta", 6).alias("mean_beta"))


@query("proximity_window", "J21", """SELECT s.sv_id, i.interval_id FROM fx_sv s JOIN fx_interval i ON i.chrom = s.chrom AND i.start - 3000 <= s.start AND s.start <= i."end" + 3000 WHERE i.kind = 'CDS'""")
def _(t):
    b = features(t, "kind = 'CDS'").withColumns({"b_start": F.col("b_start") - 3000, "b_end": F.col("b_end") + 3000})
    return iv.point_join(svs(t).select("sv_id", "chrom", F.col("start").alias("pos")), b, bounds=iv.CLOSED).select("sv_id", "interval_id")


@query("binned_coverage", "A9,C6", """WITH x AS (SELECT sample_id, chrom, unnest(range(ref_start // 1000, (ref_end - 1) // 1000 + 1)) AS b, ref_start, ref_end,
 CASE WHEN mapq < 20 THEN 'lowmapq' WHEN hp = 1 THEN 'hap1' WHEN hp = 2 THEN 'hap2' ELSE 'untagged' END AS cat FROM fx_read),
y AS (SELECT *, least(ref_end, (b + 1) * 1000) - greatest(ref_start, b * 1000) AS ov FROM x)
SELECT sample_id, chrom, count(DISTINCT b) AS n_bins, round(sum(CASE WHEN cat = 'hap1' THEN ov ELSE 0 END) / 1000.0E0, 4) AS hap1, round(sum(CASE WHEN cat = 'hap2' THEN ov ELSE 0 END) / 1000.0E0, 4) AS hap2,
 round(sum(CASE WHEN cat = 'untagged' THEN ov ELSE 0 END) / 1000.0E0, 4) AS untagged, round(sum(CASE WHEN cat = 'lowmapq' THEN ov ELSE 0 END) / 1000.0E0, 4) AS lowmapq FROM y GROUP BY 1, 2""")
def _(t):
    from ..plans.phasing import haplotype_depth

    d = haplotype_depth(t("fx_read"))
    return d.groupBy("sample_id", "chrom").agg(F.count("*").alias("n_bins"), *[F.round(F.sum(f"dp_{c}"), 4).alias(c) for c in ("hap1", "hap2", "untagged", "lowmapq")])


@query("merged_intervals", "A10", f"""WITH {MERGED} SELECT chrom, start, "end" AS stop, n AS n_parts FROM merged""")
def _(t):
    m = iv.merge(t("fx_interval").where("kind IN ('mask', 'gene')"), extra={"n_parts": F.count("*")})
    return m.select("chrom", "start", F.col("end").alias("stop"), "n_parts")


@query("merged_padded_names", "A10", """WITH mk AS (SELECT chrom, start - 250 AS s, "end" + 250 AS e, symbol FROM fx_interval),
mo AS (SELECT *, max(e) OVER (PARTITION BY chrom ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM mk),
mg AS (SELECT *, sum(CASE WHEN pe IS NULL OR s > pe THEN 1 ELSE 0 END) OVER (PARTITION BY chrom ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS gid FROM mo)
SELECT chrom, min(s) AS start, max(e) AS stop, count(DISTINCT symbol) AS n_sources, string_agg(DISTINCT symbol, ';' ORDER BY symbol) AS names FROM mg GROUP BY chrom, gid""")
def _(t):
    m = iv.merge(t("fx_interval"), pad=250, extra={"n_sources": F.count_distinct("symbol"), "names": F.concat_ws(";", F.array_sort(F.collect_set("symbol")))})
    return m.select("chrom", "start", F.col("end").alias("stop"), "n_sources", "names")


@query("masked_bp", "A11", f"""WITH {MERGED} SELECT coalesce(chrom, 'total') AS chrom, CAST(sum("end" - start) AS BIGINT) AS bp FROM merged GROUP BY ROLLUP (chrom)""")
def _(t):
    m = iv.merge(t("fx_interval").where("kind IN ('mask', 'gene')"))
    return m.rollup("chrom").agg(F.sum(F.col("end") - F.col("start")).alias("bp")).withColumn("chrom", F.coalesce("chrom", F.lit("total")))


CANYON = """c AS (SELECT chrom, pos, avg(beta) AS b, count(*) AS n FROM fx_cpg GROUP BY chrom, pos HAVING count(*) >= 5),
l AS (SELECT *, lag(pos) OVER (PARTITION BY chrom ORDER BY pos) AS pp FROM c WHERE b < 0.30),
g AS (SELECT *, sum(CASE WHEN pp IS NULL OR pos - pp > 2000 THEN 1 ELSE 0 END) OVER (PARTITION BY chrom ORDER BY pos ROWS UNBOUNDED PRECEDING) AS gid FROM l)"""


@query("cohort_track", "A21", """SELECT chrom, pos, count(*) AS n, round(avg(beta), 6) AS mean_beta FROM fx_cpg WHERE depth >= 5 GROUP BY chrom, pos HAVING count(*) >= 10""")
def _(t):
    from ..plans.methylation import cohort_track

    return cohort_track(t("fx_cpg").where("depth >= 5"), 10).select("chrom", "pos", "n", F.round("mean_beta", 6).alias("mean_beta"))


@query("low_methylation_runs", "A22", f"""WITH {CANYON} SELECT chrom, min(pos) AS start, max(pos) AS stop, count(*) AS n FROM g GROUP BY chrom, gid HAVING max(pos) - min(pos) >= 1500""")
def _(t):
    from ..plans.methylation import canyons, cohort_track

    d = canyons(cohort_track(t("fx_cpg"), 5), 0.30, 2000, 1500)
    return d.select("chrom", "start", F.col("end").alias("stop"), "n")


@query("interval_recurrence", "A24", """SELECT chrom, start, svtype, count(DISTINCT fam) AS n_families FROM (SELECT chrom, start // 5000 AS start, svtype, sample_id // 4 AS fam FROM fx_sv) x GROUP BY 1, 2, 3 HAVING count(DISTINCT fam) > 1""")
def _(t):
    d = t("fx_sv").select("chrom", F.floor(F.col("start") / 5000).alias("start"), "svtype", F.floor(F.col("sample_id") / 4).alias("fam"))
    return d.groupBy("chrom", "start", "svtype").agg(F.count_distinct("fam").alias("n_families")).where("n_families > 1")


@query("coding_bp_covered", "A25", f"""WITH tot AS (SELECT symbol, chrom, sum("end" - start) AS total_bp, min(start) AS gs, max("end") AS ge FROM fx_interval WHERE kind = 'CDS' GROUP BY 1, 2)
SELECT s.sv_id, i.symbol, CAST(sum(least(s."end", i."end") - greatest(s.start, i.start)) AS BIGINT) AS coding_bp, CAST(max(t.total_bp) AS BIGINT) AS total_bp,
 max(CASE WHEN s.start <= t.gs AND t.ge <= s."end" THEN 1 ELSE 0 END) AS whole_gene
FROM fx_sv s JOIN fx_interval i ON {OV} AND i.kind = 'CDS' JOIN tot t ON t.symbol = i.symbol AND t.chrom = i.chrom GROUP BY 1, 2""")
def _(t):
    from ..plans.inheritance import coding_consequence

    return coding_consequence(svs(t), features(t, "kind = 'CDS'"), ["sv_id"])


@query("block_overlap_check", "W10,Q4", """WITH b AS (SELECT sample_id, chrom, ps, hp, min(ref_start) AS start, max(ref_end) AS "end" FROM fx_read WHERE hp IS NOT NULL GROUP BY 1, 2, 3, 4),
l AS (SELECT *, lag("end") OVER (PARTITION BY sample_id, chrom ORDER BY start, "end") AS pe, lag(ps) OVER (PARTITION BY sample_id, chrom ORDER BY start, "end") AS pps FROM b)
SELECT CASE WHEN ps = pps THEN 'FAIL' ELSE 'WARN' END AS level, count(*) AS n FROM l WHERE pe > start GROUP BY 1""")
def _(t):
    from ..plans.audit import block_overlaps

    b = t("fx_read").where("hp IS NOT NULL").groupBy("sample_id", "chrom", "ps", "hp").agg(F.min("ref_start").alias("start"), F.max("ref_end").alias("end"))
    return block_overlaps(b, ["sample_id", "chrom"], "ps").groupBy("level").agg(F.count("*").alias("n"))


@query("nearby_informative", "W12,C46", """WITH s AS (SELECT chrom, 3000000 + 728 * site_id AS pos, CASE WHEN site_id % 5 < 3 THEN 1 ELSE -1 END AS v FROM (SELECT site_id, 'chr' || CAST(1 + site_id % 22 AS STRING) AS chrom FROM fx_site) x),
w AS (SELECT r.region_id, (r.start + r."end") // 2 AS mid, r.chrom FROM fx_region r),
n AS (SELECT w.region_id, count(CASE WHEN abs(s.pos - w.mid) <= 20000 THEN 1 END) AS n20, coalesce(sum(CASE WHEN abs(s.pos - w.mid) <= 20000 THEN s.v END), 0) AS v20,
 count(CASE WHEN abs(s.pos - w.mid) <= 50000 THEN 1 END) AS n50, coalesce(sum(CASE WHEN abs(s.pos - w.mid) <= 50000 THEN s.v END), 0) AS v50 FROM w LEFT JOIN s ON s.chrom = w.chrom GROUP BY w.region_id)
SELECT region_id, CASE WHEN n20 >= 2 THEN 'local20' WHEN n50 >= 2 THEN 'local50' ELSE 'none' END AS basis,
 CASE WHEN n20 >= 2 THEN CASE WHEN v20 > 0 THEN 'paternal' WHEN v20 < 0 THEN 'maternal' ELSE 'tied' END WHEN n50 >= 2 THEN CASE WHEN v50 > 0 THEN 'paternal' WHEN v50 < 0 THEN 'maternal' ELSE 'tied' END ELSE 'none' END AS origin FROM n""")
def _(t):
    from ..plans.methylation import local_origin

    sites = t("fx_site").select(F.concat(F.lit("chr"), (1 + F.col("site_id") % 22).cast("string")).alias("chrom"), (3000000 + 728 * F.col("site_id")).alias("site_pos"),
                                F.when(F.col("site_id") % 5 < 3, 1).otherwise(-1).alias("vote"))
    mid = t("fx_region").select("region_id", "chrom", F.floor((F.col("start") + F.col("end")) / 2).alias("pos"))
    return local_origin(mid, sites, ["region_id"], (20000, 50000), 2)


@query("edge_bands", "W13", """WITH e AS (SELECT region_id, chrom, 'left' AS edge, start AS at FROM fx_region UNION ALL SELECT region_id, chrom, 'right', "end" FROM fx_region)
SELECT e.region_id, e.edge, CASE WHEN (e.edge = 'left') = (c.pos >= e.at) THEN 'inside' ELSE 'outside' END AS side, count(*) AS n, round(avg(c.beta), 6) AS mean_beta
FROM e JOIN fx_cpg c ON c.chrom = e.chrom AND c.pos >= e.at - 1000 AND c.pos < e.at + 1000 GROUP BY 1, 2, 3""")
def _(t):
    from ..plans.methylation import edge_bands

    d = edge_bands(t("fx_region").select("region_id", "chrom", "start", "end"), t("fx_cpg"), 1000)
    return d.groupBy("region_id", "edge", "side").agg(F.count("*").alias("n"), F.round(F.avg("beta"), 6).alias("mean_beta"))


@query("read_run_numbers", "W4", """WITH v AS (SELECT l_suppkey AS sample_id, l_orderkey, l_linenumber, l_partkey, CASE WHEN l_discount < 0.05 THEN 1 ELSE -1 END AS sign FROM lineitem),
l AS (SELECT *, lag(sign) OVER (PARTITION BY sample_id ORDER BY l_orderkey, l_linenumber, l_partkey) AS p FROM v)
SELECT sample_id, count(*) AS n_votes, CAST(sum(CASE WHEN p IS NULL OR p <> sign THEN 1 ELSE 0 END) AS BIGINT) AS n_runs FROM l GROUP BY sample_id""")
def _(t):
    d = t("lineitem").select(F.col("l_suppkey").alias("sample_id"), "l_orderkey", "l_linenumber", "l_partkey", F.when(F.col("l_discount") < 0.05, 1).otherwise(-1).alias("sign"))
    d = d.withColumn("bin", ordered.position_bin(F.col("l_orderkey"), 12))
    d = ordered.previous(d, ["sample_id"], "bin", ["l_orderkey", "l_linenumber", "l_partkey"], F.col("sign"), "p")
    first = F.col("p").isNull() | (F.col("p") != F.col("sign"))
    return d.groupBy("sample_id").agg(F.count("*").alias("n_votes"), F.count_if(first).alias("n_runs"))
