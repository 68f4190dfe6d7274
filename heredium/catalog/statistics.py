"""Tests, regressions, scores and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numeric as nm
from ..operators import ranks
from ..operators import regression as rg
from ..operators import trio
from ..plans import learning as ml
from ..plans import methylation as me
from ..plans import phenotype
from .evidence import CLASSED, classified
from .ranking import SCORED, scored
from .registry import query


@query("roc_auc", "M2", f"""WITH {SCORED}, g AS (SELECT fold, score, sum(label) AS p, count(*) AS n FROM sc GROUP BY 1, 2), c AS (SELECT *, sum(n - p) OVER (PARTITION BY fold ORDER BY score ROWS UNBOUNDED PRECEDING) - (n - p) AS below, sum(p) OVER (PARTITION BY fold) AS tp, sum(n - p) OVER (PARTITION BY fold) AS tn FROM g)
SELECT fold, CAST(max(tp) AS BIGINT) AS n_pos, round(sum(p * (below + (n - p) / 2.0E0)) / CAST(max(tp) * max(tn) AS DOUBLE), 6) AS roc_auc FROM c GROUP BY fold""")
def _(t):
    return ranks.auc(scored(t), ["fold"], "score", "label").select("fold", "n_pos", F.round("roc_auc", 6).alias("roc_auc"))


@query("reliability_bins", "M2", f"""WITH {SCORED} SELECT CAST(least(floor(score / 51.0E0 * 10), 9) AS BIGINT) AS bin, count(*) AS n, round(avg(score / 51.0E0), 6) AS mean_score, round(avg(CAST(label AS DOUBLE)), 6) AS observed FROM sc GROUP BY 1""")
def _(t):
    d = ml.reliability(scored(t).withColumn("p", F.col("score") / 51.0), "p", "label")
    return d.select("bin", "n", F.round("mean_score", 6).alias("mean_score"), F.round("observed", 6).alias("observed"))


@query("operating_point", "M2", f"""WITH {SCORED}, g AS (SELECT fold, score, sum(label) AS p, count(*) AS n FROM sc GROUP BY 1, 2), c AS (SELECT *, sum(p) OVER w AS tp, sum(n - p) OVER w AS fp, sum(p) OVER (PARTITION BY fold) AS np, sum(n - p) OVER (PARTITION BY fold) AS nn FROM g WINDOW w AS (PARTITION BY fold ORDER BY score DESC ROWS UNBOUNDED PRECEDING))
SELECT fold, min(score) AS threshold, round(max(tp / CAST(np AS DOUBLE)), 6) AS recall FROM c WHERE fp / CAST(nn AS DOUBLE) <= 0.2 GROUP BY fold""")
def _(t):
    return ml.threshold_at(scored(t), ["fold"], "score", "label", 0.2).withColumn("recall", F.round("recall", 6))


CELLS = "SELECT l_suppkey AS k, CAST(sum(CASE WHEN l_discount < 0.05 AND l_quantity > 25 THEN 1 ELSE 0 END) AS BIGINT) AS a, CAST(sum(CASE WHEN l_discount < 0.05 AND l_quantity <= 25 THEN 1 ELSE 0 END) AS BIGINT) AS b, CAST(sum(CASE WHEN l_discount >= 0.05 AND l_quantity > 25 THEN 1 ELSE 0 END) AS BIGINT) AS c, CAST(sum(CASE WHEN l_discount >= 0.05 AND l_quantity <= 25 THEN 1 ELSE 0 END) AS BIGINT) AS d FROM {lineitem} GROUP BY l_suppkey"
_LC = lambda n, k: f"(lgamma({n} + 1) - lgamma({k} + 1) - lgamma({n} - {k} + 1))"


@query("fisher_exact", "M3", f"""WITH x AS ({CELLS.format(lineitem='lineitem')}), q AS (SELECT *, a + b AS r1, a + c AS c1, a + b + c + d AS n FROM x), u AS (SELECT *, unnest(range(greatest(0, r1 + c1 - n), least(r1, c1) + 1)) AS i FROM q),
l AS (SELECT *, {_LC('c1', 'i')} + {_LC('(n - c1)', '(r1 - i)')} - {_LC('n', 'r1')} AS lp, {_LC('c1', 'a')} + {_LC('(n - c1)', '(r1 - a)')} - {_LC('n', 'r1')} AS lo FROM u)
SELECT k, round(least(1, sum(CASE WHEN lp <= lo + 1e-7 THEN exp(lp) ELSE 0 END)), 6) AS p FROM l GROUP BY k""")
def _(t):
    d = t.spark.sql(CELLS, lineitem=t("lineitem"))
    return d.select("k", F.round(nm.fisher_two_sided(*[F.col(c) for c in "abcd"]), 6).alias("p"))


@query("binomial_tests", "M3", f"""WITH x AS (SELECT k, a AS t, a + b AS n FROM ({CELLS.format(lineitem='lineitem')}) y), u AS (SELECT *, unnest(range(0, n + 1)) AS i FROM x), l AS (SELECT *, exp({_LC('n', 'i')} - n * ln(2)) AS p, exp({_LC('n', 't')} - n * ln(2)) AS po FROM u)
SELECT k, round(least(1, sum(CASE WHEN p <= po * (1 + 1e-7) THEN p ELSE 0 END)), 6) AS p_minlik, round(least(1, 2 * sum(CASE WHEN i <= least(t, n - t) THEN p ELSE 0 END)), 6) AS p_tail FROM l GROUP BY k""")
def _(t):
    d = t.spark.sql(CELLS, lineitem=t("lineitem")).select("k", F.col("a").alias("t"), (F.col("a") + F.col("b")).alias("n"))
    return d.select("k", F.round(nm.binom_min_likelihood(F.col("t"), F.col("n")), 6).alias("p_minlik"), F.round(nm.binom_doubled_tail(F.col("t"), F.col("n")), 6).alias("p_tail"))


@query("mann_whitney", "M4,C43", """WITH r AS (SELECT l_suppkey % 7 AS k, CASE WHEN l_discount < 0.05 THEN 1 ELSE 0 END AS g, l_quantity AS v FROM lineitem), c AS (SELECT k, v, count(*) AS n, sum(g) AS g FROM r GROUP BY 1, 2),
w AS (SELECT *, sum(n) OVER (PARTITION BY k ORDER BY v ROWS UNBOUNDED PRECEDING) - n + (n + 1) / 2.0E0 AS rk FROM c), s AS (SELECT k, CAST(sum(g) AS BIGINT) AS n1, CAST(sum(n) - sum(g) AS BIGINT) AS n2, sum(g * rk) AS rs, sum(CAST(n AS DOUBLE) * n * n - n) AS ties, CAST(sum(n) AS DOUBLE) AS nn FROM w GROUP BY k)
SELECT k, n1, n2, round(rs - n1 * (n1 + 1) / 2.0E0, 3) AS u, round((rs - n1 * (n1 + 1) / 2.0E0 - n1 * n2 / 2.0E0) / sqrt(n1 * n2 / 12.0E0 * (nn + 1 - ties / (nn * (nn - 1)))), 6) AS z FROM s""")
def _(t):
    d = t("lineitem").select((F.col("l_suppkey") % 7).alias("k"), (F.col("l_discount") < 0.05).alias("g"), F.col("l_quantity").alias("v"))
    return ranks.mann_whitney(d, ["k"], "v", F.col("g")).select("k", "n1", "n2", F.round("u", 3).alias("u"), F.round("z", 6).alias("z"))


@query("spearman", "M4", """WITH d AS (SELECT l_suppkey % 7 AS k, l_quantity AS x, l_discount AS y FROM lineitem), r AS (SELECT k, rank() OVER (PARTITION BY k ORDER BY x) + (count(*) OVER (PARTITION BY k, x) - 1) / 2.0E0 AS rx, rank() OVER (PARTITION BY k ORDER BY y) + (count(*) OVER (PARTITION BY k, y) - 1) / 2.0E0 AS ry FROM d)
SELECT k, count(*) AS n, round(corr(rx, ry), 6) AS rho FROM r GROUP BY k""")
def _(t):
    d = t("lineitem").select((F.col("l_suppkey") % 7).alias("k"), F.col("l_quantity").alias("x"), F.col("l_discount").alias("y"))
    return ranks.spearman(d, ["k"], "x", "y").withColumn("rho", F.round("rho", 6))


@query("linear_regression", "M5", """SELECT l_suppkey AS k, count(*) AS n, round(regr_slope(l_extendedprice, l_quantity), 4) AS beta, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept FROM lineitem GROUP BY 1 HAVING count(*) >= 5""")
def _(t):
    d = t("lineitem").select(F.col("l_suppkey").alias("k"), F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"))
    return rg.ols(d, ["k"], "y", ["x"]).select("k", "n", F.round("beta", 4).alias("beta"), F.round(F.get("coef", F.lit(0)), 3).alias("intercept"))


@query("regression_with_covariates", "M5,C48")
def _(t):
    d = t("lineitem").select(F.col("l_suppkey").alias("k"), F.col("l_quantity").alias("x"), F.col("l_discount").alias("c1"), F.col("l_tax").alias("c2"), F.col("l_extendedprice").alias("y"))
    return rg.ols(d, ["k"], "y", ["x", "c1", "c2"]).select("k", "n", F.round("beta", 4).alias("beta"), F.round("se", 4).alias("se"), F.round("p", 6).alias("p"))


@query("conditional_logistic", "M6")
def _(t):
    g = t("fx_genotype").where("slot >= 2").join(t("fx_site").select("site_id", "consequence"), "site_id")
    carries = F.col("a1") + F.col("a2") > 0
    m = g.groupBy("consequence", "family_id", "sample_id", "slot").agg(F.count_if(carries).alias("n_carried"), F.avg(F.col("dp").cast("double")).alias("depth"), F.count_if(F.col("gq") < 20).alias("n_low"))
    d = rg.conditional_logistic(m.withColumn("case", (F.col("slot") == 2).cast("int")), ["consequence"], "family_id", "case", ["n_carried", "depth", "n_low"])
    return d.select("consequence", "covariate", "n_strata", *[F.round(c, 5).alias(c) for c in ("beta", "se", "z")])


_CELLS = ("neutrophil", "lymphocyte", "monocyte")
#: All supports of three weights: each one's least squares by Cramer's rule; the best non-negative one is the solution.
NNLS = """x AS (SELECT sample_id, beta AS y, (cpg_id * 31) % 97 / 97.0E0 AS a, (cpg_id * 57) % 97 / 97.0E0 AS b, (cpg_id * 83) % 97 / 97.0E0 AS c FROM fx_cpg),
m AS (SELECT sample_id, count(*) AS n, sum(a*a) AS aa, sum(b*b) AS bb, sum(c*c) AS cc, sum(a*b) AS ab, sum(a*c) AS ac, sum(b*c) AS bc, sum(a*y) AS ay, sum(b*y) AS b_y, sum(c*y) AS cy, sum(y*y) AS yy FROM x GROUP BY 1),
d AS (SELECT *, aa*(bb*cc - bc*bc) - ab*(ab*cc - bc*ac) + ac*(ab*bc - bb*ac) AS det FROM m),
s AS (SELECT *, ay/aa AS w1, 0.0E0 AS w2, 0.0E0 AS w3 FROM d UNION ALL SELECT *, 0, b_y/bb, 0 FROM d UNION ALL SELECT *, 0, 0, cy/cc FROM d
 UNION ALL SELECT *, (ay*bb - b_y*ab)/(aa*bb - ab*ab), (aa*b_y - ab*ay)/(aa*bb - ab*ab), 0 FROM d UNION ALL SELECT *, (ay*cc - cy*ac)/(aa*cc - ac*ac), 0, (aa*cy - ac*ay)/(aa*cc - ac*ac) FROM d
 UNION ALL SELECT *, 0, (b_y*cc - cy*bc)/(bb*cc - bc*bc), (bb*cy - bc*b_y)/(bb*cc - bc*bc) FROM d
 UNION ALL SELECT *, (ay*(bb*cc - bc*bc) - ab*(b_y*cc - bc*cy) + ac*(b_y*bc - bb*cy))/det, (aa*(b_y*cc - bc*cy) - ay*(ab*cc - bc*ac) + ac*(ab*cy - b_y*ac))/det, (aa*(bb*cy - b_y*bc) - ab*(ab*cy - b_y*ac) + ay*(ab*bc - bb*ac))/det FROM d),
f AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY yy - 2*(w1*ay + w2*b_y + w3*cy) + w1*w1*aa + w2*w2*bb + w3*w3*cc + 2*(w1*w2*ab + w1*w3*ac + w2*w3*bc)) AS rn FROM s WHERE w1 >= 0 AND w2 >= 0 AND w3 >= 0),
g AS (SELECT *, w1 + w2 + w3 AS t FROM f WHERE rn = 1), h AS (SELECT *, w1/t AS p, w2/t AS q, w3/t AS r FROM g)"""


@query("cell_fractions", "M7", f"""WITH {NNLS} SELECT sample_id, n AS n_markers, round(p, 5) AS neutrophil, round(q, 5) AS lymphocyte, round(r, 5) AS monocyte, round(t, 5) AS raw_sum, round(yy - 2*(p*ay + q*b_y + r*cy) + p*p*aa + q*q*bb + r*r*cc + 2*(p*q*ab + p*r*ac + q*r*bc), 4) AS rss FROM h""")
def _(t):
    d = t("fx_cpg").select("sample_id", F.col("beta").alias("y"), *[((F.col("cpg_id") * p) % 97 / 97.0).alias(n) for n, p in zip(_CELLS, (31, 57, 83), strict=True)])
    return rg.nnls(d, ["sample_id"], "y", list(_CELLS)).select("sample_id", "n_markers", *[F.round(c, 5).alias(c) for c in (*_CELLS, "raw_sum")], F.round("rss", 4).alias("rss"))


@query("two_compartments", "M7", """WITH m AS (SELECT sample_id, CASE cpg_id % 3 WHEN 0 THEN 'epithelium' WHEN 1 THEN 'granulocyte' ELSE 'other' END AS target, 1 - beta AS u FROM fx_cpg),
s AS (SELECT sample_id, avg(u) FILTER (target = 'epithelium') AS ut, avg(u) FILTER (target = 'granulocyte') AS uc FROM m GROUP BY 1), z AS (SELECT avg(ut) AS z FROM s WHERE sample_id % 6 = 0)
SELECT sample_id, round(ut, 6) AS u_tissue, round(greatest(0, least(1, (ut - z) / (0.95E0 - z))), 6) AS tissue_share, round(greatest(0, least(1, uc / 0.9E0)), 6) AS cell_share FROM s, z""")
def _(t):
    target = F.element_at(F.array(F.lit("epithelium"), F.lit("granulocyte"), F.lit("other")), (F.col("cpg_id") % 3 + 1).cast("int"))
    m = t("fx_cpg").select("sample_id", target.alias("target"), (1 - F.col("beta")).alias("u"))
    atlas = t.spark.createDataFrame([("epithelium", "epithelium", 0.95), ("epithelium", "blood", 0.05), ("granulocyte", "granulocyte", 0.9)], "target string, cell string, u double")
    d = me.two_compartments(m, atlas, m.where("sample_id % 6 = 0").select("sample_id"))
    return d.select("sample_id", *[F.round(c, 6).alias(c) for c in ("u_tissue", "tissue_share", "cell_share")])


@query("fold_quantile_score", "M10,W6", """WITH s AS (SELECT o_orderkey, y.s AS seed, o_custkey % 3 AS fold, (o_orderkey * (y.s + 5)) % 211 AS score FROM orders, (VALUES (1), (2)) y(s)), r AS (SELECT o_custkey % 3 AS fold, y.s AS seed, (o_orderkey * (y.s + 11)) % 223 AS score FROM orders, (VALUES (1), (2)) y(s) WHERE o_orderstatus = 'F'),
rn AS (SELECT fold, seed, count(*) AS n FROM r GROUP BY 1, 2), rc AS (SELECT fold, seed, score, count(*) AS c FROM r GROUP BY 1, 2, 3), v AS (SELECT DISTINCT fold, seed, score FROM s), b AS (SELECT v.fold, v.seed, v.score, coalesce(sum(rc.c), 0) AS below FROM v LEFT JOIN rc ON rc.fold = v.fold AND rc.seed = v.seed AND rc.score < v.score GROUP BY 1, 2, 3)
SELECT s.o_orderkey, round(avg(b.below / CAST(rn.n AS DOUBLE)), 8) AS rf_q FROM s JOIN b ON b.fold = s.fold AND b.seed = s.seed AND b.score = s.score JOIN rn ON rn.fold = s.fold AND rn.seed = s.seed GROUP BY 1""")
def _(t):
    seeds = F.explode(F.array(F.lit(1), F.lit(2)))
    o = t("orders").select("o_orderkey", (F.col("o_custkey") % 3).alias("fold"), "o_orderstatus", seeds.alias("seed"))
    s = o.withColumn("score", ((F.col("o_orderkey") * (F.col("seed") + 5)) % 211).cast("double"))
    r = o.where("o_orderstatus = 'F'").withColumn("score", ((F.col("o_orderkey") * (F.col("seed") + 11)) % 223).cast("double"))
    return ml.fold_quantile_score(s, r, ["fold", "seed"], ["o_orderkey"]).withColumn("rf_q", F.round("rf_q", 8))


@query("reranked_scores", "M11", f"""WITH {CLASSED} SELECT cand, (cand % 100) / 100.0E0 + CASE WHEN phase_class IN ('phase_conflict_artifact', 'inherited_missed_in_parent') THEN -1e6 WHEN phase_class = 'germline_DNM_phased' THEN 1e6 ELSE 0 END AS score FROM cl""")
def _(t):
    return classified(t).select("cand", ml.rerank(F.col("cand") % 100 / 100.0, F.col("phase_class")).alias("score"))


_SHUFFLED = " UNION ALL ".join(
    f"SELECT '{fam}' AS family, {i} AS shuffle, h.label, {expr} AS score FROM (SELECT *, row_number() OVER (ORDER BY md5(concat_ws(':', {7 + 2 * i + 1}, id)), id) AS rn FROM d) h JOIN (SELECT *, row_number() OVER (ORDER BY md5(concat_ws(':', {7 + 2 * i}, id)), id) AS rn FROM d) o ON o.rn = h.rn"
    for fam, expr in (("amount", "round(o.q / 50 - 5 * h.disc, 4)"), ("discount", "round(h.q / 50 - 5 * o.disc, 4)"), ("tax", "round(h.q / 50 - 5 * h.disc, 4)")) for i in range(3))


@query("permutation_importance", "M12", f"""WITH d AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS id, l_quantity AS q, l_discount AS disc, CASE WHEN l_discount < 0.03 OR l_quantity > 40 THEN 1 ELSE 0 END AS label FROM lineitem),
e AS (SELECT '' AS family, 0 AS shuffle, label, round(q / 50 - 5 * disc, 4) AS score FROM d UNION ALL {_SHUFFLED}), g AS (SELECT family, shuffle, score, sum(label) AS p, count(*) - sum(label) AS n FROM e GROUP BY 1, 2, 3),
c AS (SELECT *, sum(n) OVER (PARTITION BY family, shuffle ORDER BY score) - n AS below, sum(p) OVER (PARTITION BY family, shuffle) AS tp, sum(n) OVER (PARTITION BY family, shuffle) AS tn FROM g),
a AS (SELECT family, shuffle, sum(p * (below + n / 2.0E0)) / (max(tp) * max(tn)) AS auc FROM c GROUP BY 1, 2), l AS (SELECT a.family, a.auc, b.auc - a.auc AS loss FROM a, (SELECT auc FROM a WHERE family = '') b WHERE a.family <> '')
SELECT family, round(avg(auc), 5) AS auc, round(avg(loss), 5) AS importance, round(min(loss), 5) AS least, round(max(loss), 5) AS most FROM l GROUP BY 1""")
def _(t):
    d = t("lineitem").select(F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]).alias("id"), F.col("l_quantity").alias("q"), F.col("l_discount").alias("disc"), F.col("l_tax").alias("tax"))
    d = d.withColumn("label", ((F.col("disc") < 0.03) | (F.col("q") > 40)).cast("int"))
    r = ml.permutation_importance(d, {"amount": ["q"], "discount": ["disc"], "tax": ["tax"]}, lambda x: x.withColumn("score", F.round(F.col("q") / 50 - 5 * F.col("disc") + 0.0 * F.col("tax"), 4)), "label")
    return r.select("family", *[F.round(c, 5).alias(c) for c in ("auc", "importance", "least", "most")])


@query("presence_guard", "M13,P9", """WITH d AS (SELECT CASE WHEN consequence = 'missense_variant' THEN 1 ELSE 0 END AS label, gnomad_af, s_het FROM fx_site), u AS (SELECT 'gnomad_af' AS feature, label, CASE WHEN gnomad_af IS NULL THEN 0.0E0 ELSE 1 END AS p FROM d UNION ALL SELECT 's_het', label, CASE WHEN s_het IS NULL THEN 0.0E0 ELSE 1 END FROM d)
SELECT feature, round(avg(CASE WHEN label = 1 THEN p END), 6) AS present_1, round(avg(CASE WHEN label = 0 THEN p END), 6) AS present_0 FROM u GROUP BY feature""")
def _(t):
    d = t("fx_site").withColumn("label", (F.col("consequence") == "missense_variant").cast("int"))
    return ml.presence_guard(d, ["gnomad_af", "s_het"], "label", 0.05).select("feature", F.round("present_1", 6).alias("present_1"), F.round("present_0", 6).alias("present_0"))


@query("parental_age", "M14", """SELECT c_mktsegment AS origin, count(*) AS n, round(corr(c_acctbal, c_nationkey), 6) AS r, round(regr_slope(c_acctbal, c_nationkey), 4) AS slope FROM customer GROUP BY 1""")
def _(t):
    return t("customer").groupBy(F.col("c_mktsegment").alias("origin")).agg(F.count("*").alias("n"), F.round(F.corr("c_acctbal", "c_nationkey"), 6).alias("r"), F.round(F.regr_slope("c_acctbal", "c_nationkey"), 4).alias("slope"))


_ORIGIN = """CASE WHEN child_hap1_is IS NULL OR {h} THEN 'undetermined' WHEN ({k}) = (child_hap1_is = 'P') THEN 'paternal' ELSE 'maternal' END"""
_AGES = """SELECT sample_id AS child_id, 20 + (7 * father_id) % 31 AS father_age, CASE WHEN sample_id % 20 <> 10 THEN 18 + (5 * mother_id) % 27 END AS mother_age FROM fx_pedigree WHERE father_id IS NOT NULL"""


@query("parental_age_by_origin", "M14", f"""WITH o AS (SELECT cand, count(*) FILTER (hp = 1) AS a1, count(*) FILTER (hp = 2) AS a2 FROM fx_obs WHERE role = 'C' AND support = 'ALT' GROUP BY 1), k AS (SELECT c.sample_id AS child_id, {_ORIGIN.format(h='least(a1, a2) > 0 OR a1 = a2', k='a1 > 0')} AS unanimous, {_ORIGIN.format(h='a1 = a2', k='a1 > a2')} AS majority FROM fx_candidate c JOIN o ON o.cand = c.cand),
ag AS ({_AGES}), d AS (SELECT a.child_id, max(father_age) AS fa, max(mother_age) AS ma, count(*) AS total, count(*) FILTER (unanimous = 'paternal') AS up, count(*) FILTER (unanimous = 'maternal') AS um, count(*) FILTER (majority = 'paternal') AS mp, count(*) FILTER (majority = 'maternal') AS mm FROM k JOIN ag a ON a.child_id = k.child_id WHERE mother_age IS NOT NULL GROUP BY 1),
l AS (SELECT 'all' AS source, 'any' AS origin, 'father' AS age_of, total AS y, fa AS x FROM d UNION ALL SELECT 'unanimous', 'paternal', 'father', up, fa FROM d UNION ALL SELECT 'unanimous', 'maternal', 'mother', um, ma FROM d UNION ALL SELECT 'unanimous', 'maternal', 'father', um, fa FROM d
 UNION ALL SELECT 'majority', 'paternal', 'father', mp, fa FROM d UNION ALL SELECT 'majority', 'maternal', 'mother', mm, ma FROM d UNION ALL SELECT 'majority', 'maternal', 'father', mm, fa FROM d)
SELECT source, origin, age_of, count(*) AS n, CAST(sum(y) AS BIGINT) AS n_calls, round(CASE WHEN min(x) < max(x) AND min(y) < max(y) THEN corr(y, x) ELSE 0 END, 6) AS r, round(CASE WHEN min(x) < max(x) AND min(y) < max(y) THEN regr_slope(y, x) ELSE 0 END, 6) AS slope FROM l GROUP BY 1, 2, 3""")
def _(t):
    reads = t("fx_obs").where("role = 'C' AND support = 'ALT'").groupBy("cand").agg(F.count_if(F.col("hp") == 1).alias("a1"), F.count_if(F.col("hp") == 2).alias("a2"))
    d = t("fx_candidate").join(reads, "cand")
    calls = d.selectExpr("sample_id AS child_id", _ORIGIN.format(h="least(a1, a2) > 0 OR a1 = a2", k="a1 > 0") + " AS unanimous", _ORIGIN.format(h="a1 = a2", k="a1 > a2") + " AS majority")
    ages = trio.complete_trios(t("fx_pedigree")).selectExpr("sample_id AS child_id", "20 + (7 * father_id) % 31 AS father_age", "CASE WHEN sample_id % 20 <> 10 THEN 18 + (5 * mother_id) % 27 END AS mother_age")
    fits = phenotype.origin_age_fits(calls, ages, ["unanimous", "majority"])
    return fits.select("source", "origin", "age_of", "n", "n_calls", F.round("r", 6).alias("r"), F.round("slope", 6).alias("slope"))


def labelled(t):
    """Rows of families with a label, phase and caller features; folds closed under family."""
    fam = F.floor(F.col("l_suppkey") / 4)
    sizes = t("lineitem").groupBy(fam.alias("family_id")).agg(F.count("*").alias("n"))
    d = t("lineitem").select(fam.alias("family_id"), F.col("l_quantity").alias("alt"), F.col("l_discount").alias("phase_support"), F.col("l_tax").alias("noise"), ((F.col("l_discount") < 0.03) | (F.col("l_quantity") > 40)).cast("int").alias("label"))
    return d.join(ml.family_folds(sizes, "family_id", 2), "family_id")


@query("family_grouped_cv", "M8,M9,C64")
def _(t):
    d, out = labelled(t), None
    for which in ("full", "no_phase", "phase_only"):
        s = ml.nested_cv(d, "family_id", ml.ablated(["alt", "phase_support", "noise"], ("phase_",), which), "logistic", ({"maxIter": 2000, "regParam": 0.01, "tol": 1e-3}, {"maxIter": 2000, "regParam": 1.0, "tol": 1e-3}), 2)
        s = s.select(F.lit(which).alias("features"), F.round("raw", 6).alias("score"), "label")
        out = s if out is None else out.unionByName(s)
    return ranks.auc(out, ["features"], "score", "label").select("features", "n", "n_pos", F.round("roc_auc", 3).alias("roc_auc"))


@query("boosted_scores", "M8")
def _(t):
    """Families of fold 0 scored by trees fitted on the others."""
    d = labelled(t).withColumn("weight", F.lit(1.0))
    fitted = ml.fit(d.where("fold <> 0"), ["alt", "phase_support", "noise"], "boosted", ml.GRID[2])
    return ml.predict(fitted, d.where("fold = 0")).groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg("p"), 4).alias("mean_p"))


@query("family_folds", "C64,J31", """WITH RECURSIVE z AS (SELECT family_id, count(*) AS n FROM fx_call GROUP BY 1),
o AS (SELECT *, row_number() OVER (ORDER BY family_id % 9 = 0 DESC, n DESC, md5(concat_ws(':', 1, family_id)), family_id) AS i FROM z),
g AS (SELECT 0::BIGINT AS i, NULL::BIGINT AS family_id, 0::BIGINT AS k, [0, 0, 0, 0, 0]::BIGINT[] AS load
  UNION ALL SELECT i, family_id, k, list_transform(load, lambda x, j: x + CASE WHEN j = k THEN n ELSE 0 END) FROM (SELECT o.i, o.family_id, o.n, g.load, CASE WHEN o.family_id % 9 = 0 THEN 1 ELSE list_position(g.load, list_min(g.load)) END AS k FROM g JOIN o ON o.i = g.i + 1) s)
SELECT family_id, CAST(k - 1 AS INT) AS fold FROM g WHERE i > 0""")
def _(t):
    sizes = t("fx_call").groupBy("family_id").agg(F.count("*").alias("n")).withColumn("blood", F.col("family_id") % 9 == 0)
    return ml.family_folds(sizes, "family_id", 5, first="blood")


@query("isotonic_calibration", "M9", f"""WITH {SCORED}, g AS (SELECT score, CAST(sum(label) AS DOUBLE) AS s, count(*) AS n FROM sc GROUP BY 1), c AS (SELECT *, sum(s) OVER (ORDER BY score) AS cs, sum(n) OVER (ORDER BY score) AS cn FROM g),
ij AS (SELECT i.score AS i, j.score AS j, (j.cs - i.cs + i.s) / CAST(j.cn - i.cn + i.n AS DOUBLE) AS a FROM c i JOIN c j ON j.score >= i.score), m AS (SELECT k.score, ij.i, min(ij.a) AS lo FROM g k JOIN ij ON ij.i <= k.score AND ij.j >= k.score GROUP BY 1, 2)
SELECT score, round(max(lo), 6) AS calibrated FROM m GROUP BY 1""")
def _(t):
    d = ml.calibrate(scored(t).select("score", "label"), "score", "label")
    return d.select("score", F.round("calibrated", 6).alias("calibrated")).distinct()
