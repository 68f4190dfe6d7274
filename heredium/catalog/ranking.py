"""Ranks, cumulative curves, selection, de-duplication and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ranks
from ..operators import selection as sel
from ..operators import trio
from .aggregates import REGION, region_table
from .genotypes import DENOVO, TRIO
from .registry import query


@query("rank_descending", "W1,C55", f"""WITH {REGION} SELECT sample_id, region_id, rank() OVER w AS rank, round(CASE WHEN count(*) OVER (PARTITION BY sample_id) > 1 THEN (rank() OVER w - 1) / CAST(count(*) OVER (PARTITION BY sample_id) - 1 AS DOUBLE) END, 6) AS pct
FROM rm WINDOW w AS (PARTITION BY sample_id ORDER BY round(b, 9) DESC)""")
def _(t):
    """Means that agree to nine decimals are equal: the last digits of a mean depend on the order of its sum."""
    d = region_table(t).withColumn("b", F.round("b", 9))
    r = ranks.rank_desc(d, ["sample_id"], "b")
    return d.join(r, ["sample_id", "b"]).select("sample_id", "region_id", "rank", F.round("pct", 6).alias("pct"))


@query("average_rank", "W2", """SELECT subject_id, rank() OVER (ORDER BY ordinal) + (count(*) OVER (PARTITION BY ordinal) - 1) / 2.0E0 AS avg_rank FROM fx_phenotype""")
def _(t):
    d = t("fx_phenotype").select("subject_id", "ordinal")
    return d.join(ranks.average_rank(d, [], "ordinal"), "ordinal").select("subject_id", "avg_rank")


SCORED = """sc AS (SELECT l_suppkey AS fold, l_quantity AS score, CASE WHEN l_discount < 0.03 OR l_quantity > 40 THEN 1 ELSE 0 END AS label FROM lineitem)"""


def scored(t):
    label = ((F.col("l_discount") < 0.03) | (F.col("l_quantity") > 40)).cast("int")
    return t("lineitem").select(F.col("l_suppkey").alias("fold"), F.col("l_quantity").alias("score"), label.alias("label"))


@query("cumulative_precision", "W3,M2", f"""WITH {SCORED}, g AS (SELECT score, count(*) AS n, sum(label) AS p FROM sc GROUP BY score)
SELECT score, CAST(sum(p) OVER w AS BIGINT) AS tp, CAST(sum(n) OVER w AS BIGINT) AS n_called, round(sum(p) OVER w / CAST(sum(n) OVER w AS DOUBLE), 6) AS precision, round(sum(p) OVER w / CAST(sum(p) OVER () AS DOUBLE), 6) AS recall
FROM g WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING)""")
def _(t):
    d = ranks.precision_recall(scored(t), [], "score", "label")
    return d.select("score", "tp", "n_called", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query("empirical_quantile", "W6,M10", """WITH r AS (SELECT l_suppkey % 5 AS cls, l_extendedprice AS v FROM lineitem WHERE l_discount < 0.05), q AS (SELECT o_custkey % 5 AS cls, o_orderkey, floor(o_totalprice / 10) AS v FROM orders),
c AS (SELECT cls, v FROM r), n AS (SELECT cls, count(*) AS n FROM r GROUP BY cls),
u AS (SELECT cls, v, 0 AS k, NULL AS o_orderkey FROM c UNION ALL SELECT cls, v, 1, o_orderkey FROM q),
z AS (SELECT cls, v, k, o_orderkey, sum(1 - k) OVER (PARTITION BY cls ORDER BY v RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - sum(1 - k) OVER (PARTITION BY cls, v) AS below FROM u)
SELECT z.o_orderkey, round(z.below / CAST(n.n AS DOUBLE), 8) AS q FROM z JOIN n ON n.cls = z.cls WHERE z.k = 1""")
def _(t):
    ref = t("lineitem").where("l_discount < 0.05").select((F.col("l_suppkey") % 5).alias("cls"), F.col("l_extendedprice").alias("v"))
    q = t("orders").select((F.col("o_custkey") % 5).alias("cls"), "o_orderkey", F.floor(F.col("o_totalprice") / 10).cast("double").alias("v"))
    return ranks.empirical_quantile(q, ref, ["cls"], "v").select("o_orderkey", F.round("q", 8).alias("q"))


@query("best_per_key", "W7", """WITH r AS (SELECT l_partkey, l_orderkey, l_linenumber, l_extendedprice, row_number() OVER (PARTITION BY l_partkey ORDER BY l_quantity DESC, l_extendedprice, l_orderkey, l_linenumber) AS rn FROM lineitem)
SELECT l_partkey, l_orderkey, l_linenumber, l_extendedprice FROM r WHERE rn = 1""")
def _(t):
    order = [-F.col("l_quantity"), F.col("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber")]
    return sel.best_per_key(t("lineitem"), ["l_partkey"], order, ["l_orderkey", "l_linenumber", "l_extendedprice"])


@query("benjamini_hochberg", "W8", """WITH p AS (SELECT l_suppkey % 4 AS grp, l_orderkey, l_linenumber, l_partkey, ((l_orderkey * 131 + l_partkey * 17) % 9973 + 1) / 9974.0E0 AS p FROM lineitem),
r AS (SELECT *, count(*) OVER (PARTITION BY grp) AS m, count(*) OVER (PARTITION BY grp ORDER BY p RANGE UNBOUNDED PRECEDING) AS rk FROM p),
q AS (SELECT *, min(p * m / rk) OVER (PARTITION BY grp ORDER BY p DESC RANGE UNBOUNDED PRECEDING) AS q FROM r)
SELECT DISTINCT grp, round(p, 8) AS p, round(least(q, 1), 8) AS q FROM q""")
def _(t):
    p = t("lineitem").select((F.col("l_suppkey") % 4).alias("grp"), (((F.col("l_orderkey") * 131 + F.col("l_partkey") * 17) % 9973 + 1) / 9974.0).alias("p"))
    return ranks.benjamini_hochberg(p, ["grp"], "p").select("grp", F.round("p", 8).alias("p"), F.round("q", 8).alias("q"))


@query("carrier_rank", "W9,C44", """WITH s AS (SELECT c_custkey AS subject_id, c_nationkey % 6 AS own, (c_custkey * (y.s + 3) + CAST(floor(c_acctbal + 100000) AS BIGINT)) % 101 AS score, y.s AS syndrome FROM customer, (VALUES (0), (1), (2), (3), (4), (5)) y(s)),
r AS (SELECT *, rank() OVER (PARTITION BY syndrome ORDER BY score DESC) AS rk, count(*) OVER (PARTITION BY syndrome) AS n, count(*) OVER (PARTITION BY syndrome ORDER BY score DESC RANGE UNBOUNDED PRECEDING) AS ge FROM s)
SELECT subject_id, own AS syndrome, score, rk AS rank, round(ge / CAST(n AS DOUBLE), 6) AS p FROM r WHERE own = syndrome""")
def _(t):
    from ..plans.phenotype import own_rank

    c = F.col("c_custkey")
    d = t("customer").select(c.alias("subject_id"), (F.col("c_nationkey") % 6).alias("own"), "c_acctbal", F.explode(F.array(*[F.lit(i) for i in range(6)])).alias("syndrome"))
    d = d.withColumn("score", F.pmod(F.col("subject_id") * (F.col("syndrome") + 3) + F.floor(F.col("c_acctbal") + 100000), F.lit(101)))
    return own_rank(d).select("subject_id", "syndrome", "score", "rank", F.round("p", 6).alias("p"))


@query("neighbour_pairs", "W11,C64", """WITH d AS (SELECT sample_id, family_id % 4 AS fold, row_number() OVER (PARTITION BY family_id % 4 ORDER BY (sample_id * 7919) % 10007, sample_id) - 1 AS rn, count(*) OVER (PARTITION BY family_id % 4) AS n FROM fx_pedigree WHERE slot = 2)
SELECT a.fold, a.sample_id AS host, b.sample_id AS donor FROM d a JOIN d b ON b.fold = a.fold AND b.rn = CASE WHEN xor(a.rn, 1) < a.n THEN xor(a.rn, 1) ELSE 0 END WHERE a.n > 1""")
def _(t):
    d = t("fx_pedigree").where("slot = 2").select("sample_id", (F.col("family_id") % 4).alias("fold"))
    return sel.pair_neighbours(d, ["fold"], [(F.col("sample_id") * 7919) % 10007, F.col("sample_id")], "sample_id")


@query("priority_order", "T1", """SELECT sv_id, CASE svtype WHEN 'DEL' THEN 1 WHEN 'DUP' THEN 2 WHEN 'INS' THEN 3 ELSE 4 END AS priority FROM fx_sv ORDER BY 2, "end" - start DESC, sv_id""")
def _(t):
    pr = F.when(F.col("svtype") == "DEL", 1).when(F.col("svtype") == "DUP", 2).when(F.col("svtype") == "INS", 3).otherwise(4)
    return t("fx_sv").withColumn("priority", pr).orderBy("priority", (F.col("end") - F.col("start")).desc(), "sv_id").select("sv_id", "priority")


@query("top_priority", "T2", """SELECT sv_id, CASE svtype WHEN 'DEL' THEN 1 WHEN 'DUP' THEN 2 WHEN 'INS' THEN 3 ELSE 4 END AS priority FROM fx_sv ORDER BY 2, "end" - start DESC, sv_id LIMIT 100""")
def _(t):
    """The hundred first of the priority order: the top-k operator."""
    pr = F.when(F.col("svtype") == "DEL", 1).when(F.col("svtype") == "DUP", 2).when(F.col("svtype") == "INS", 3).otherwise(4)
    return t("fx_sv").withColumn("priority", pr).orderBy("priority", (F.col("end") - F.col("start")).desc(), "sv_id").limit(100).select("sv_id", "priority")


@query("distinct_alleles", "T3", """SELECT chrom, count(*) AS n_alleles FROM (SELECT DISTINCT chrom, pos, ref, alt FROM fx_genotype WHERE a1 + a2 > 0) x GROUP BY chrom""")
def _(t):
    return t("fx_genotype").where("a1 + a2 > 0").dropDuplicates(["chrom", "pos", "ref", "alt"]).groupBy("chrom").agg(F.count("*").alias("n_alleles"))


@query("union_classes", "U1,C32", """SELECT 'sv' AS cls, chrom, count(*) AS n FROM fx_sv GROUP BY chrom UNION ALL SELECT 'site', chrom, count(*) FROM fx_site GROUP BY chrom UNION ALL SELECT 'tr', chrom, count(*) FROM fx_tr GROUP BY chrom""")
def _(t):
    parts = [t(f).select(F.lit(c).alias("cls"), "chrom") for c, f in (("sv", "fx_sv"), ("site", "fx_site"), ("tr", "fx_tr"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("cls", "chrom").agg(F.count("*").alias("n"))


@query("union_candidates", "U2,S16", """SELECT count(*) AS n, CAST(sum(pos) AS BIGINT) AS pos_sum FROM (SELECT chrom, pos FROM fx_site UNION SELECT chrom, pos FROM fx_genotype WHERE a1 <> a2) x""")
def _(t):
    u = t("fx_site").select("chrom", "pos").union(t("fx_genotype").where("a1 <> a2").select("chrom", "pos")).distinct()
    return u.agg(F.count("*").alias("n"), F.sum("pos").alias("pos_sum"))


@query("siblings_shared", "U3,C25", f"""WITH {TRIO}, d AS (SELECT child_id, family_id, site_id FROM trio WHERE c_a1 + c_a2 > 0 AND f_a1 + f_a2 < 2 AND m_a1 + m_a2 < 2)
SELECT a.family_id, count(*) AS n_shared FROM d a JOIN d b ON a.family_id = b.family_id AND a.site_id = b.site_id AND a.child_id < b.child_id GROUP BY 1""")
def _(t):
    d = trio.trio_where(t("fx_genotype"), t("fx_pedigree"), F.expr("a1 > 0 OR a2 > 0"), F.expr("a1 + a2 < 2"), ["a1", "a2"], ["site_id"], ["a1", "a2"])
    odd = F.col("child_id") % 2
    a, b = d.where(odd == 0).select("family_id", "site_id"), d.where(odd == 1).select("family_id", "site_id")
    return a.intersect(b).groupBy("family_id").agg(F.count("*").alias("n_shared"))


@query("lost_to_filter", "U4", """SELECT symbol, chrom FROM fx_site EXCEPT SELECT symbol, chrom FROM fx_site WHERE gnomad_af IS NULL AND s_het >= 0.3""")
def _(t):
    s = t("fx_site")
    return s.select("symbol", "chrom").subtract(s.where("gnomad_af IS NULL AND s_het >= 0.3").select("symbol", "chrom"))


@query("gene_set_union", "U5", """WITH g AS (SELECT symbol, 'constrained' AS s, 1 AS r FROM fx_site WHERE s_het >= 0.45 UNION ALL SELECT symbol, 'coding', 2 FROM fx_interval WHERE kind = 'CDS' UNION ALL SELECT symbol, 'rare', 3 FROM fx_site WHERE gnomad_af IS NULL)
SELECT symbol, string_agg(DISTINCT s, ';' ORDER BY s) AS sets, min(r) AS best_rank FROM g GROUP BY symbol""")
def _(t):
    from ..plans.clinical import gene_sets

    s = t("fx_site")
    return gene_sets([("constrained", 1, s.where("s_het >= 0.45")), ("coding", 2, t("fx_interval").where("kind = 'CDS'")), ("rare", 3, s.where("gnomad_af IS NULL"))])
