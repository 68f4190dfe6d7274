"""De novo candidates, read evidence, classification and final decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import genotype as g
from ..operators import intervals as iv
from ..operators import panel, trio


def fuzzy_indel(calls: DataFrame, baseline: DataFrame, keys: list[str], window: int = 20, prefix: int = 20) -> DataFrame:
    """Indels matched by the same length change within ``window``, or at the same position by a long allele prefix.

    Both sides hold canonical cores; the baseline has ``bpos, bref, balt``.
    """
    calls = calls.where(F.length("ref") != F.length("alt"))
    p = calls.withColumns({"__s": F.col("pos") - window, "__e": F.col("pos") + window + 1})
    q = baseline.withColumns({"__bs": F.col("bpos"), "__be": F.col("bpos") + 1})
    hit = iv.overlap_join(p, q, ("__s", "__e"), ("__bs", "__be"), tuple(keys), a_points=True)
    same = (F.length("balt") - F.length("bref")) == (F.length("alt") - F.length("ref"))
    long_alt = (F.length("balt") >= prefix) & F.col("alt").startswith(F.col("balt")) & (F.col("ref") == F.col("bref"))
    long_ref = (F.length("bref") >= prefix) & F.col("ref").startswith(F.col("bref")) & (F.col("alt") == F.col("balt"))
    ok = same | ((F.col("pos") == F.col("bpos")) & (long_alt | long_ref))
    return hit.where(ok).withColumn("dist", F.abs(F.col("bpos") - F.col("pos"))).drop("__s", "__e", "__bs", "__be")


def annotate(candidates: DataFrame, genotypes: DataFrame, sites: DataFrame) -> DataFrame:
    """Population frequency, cohort and founder counts without the child's family, and sharing between siblings.

    Counts are one aggregate per (site, family) and one over families; the candidate's family is subtracted.
    """
    n = F.col("a1") + F.col("a2")
    founder = (F.col("slot") < 2) & (n > 0)
    d = panel.leave_out_for(candidates, genotypes, ["site_id"], "family_id", {"cohort_ac": n, "founder_recurrence": founder.cast("int")})
    kids = genotypes.where((F.col("slot") >= 2) & (n > 0)).groupBy("family_id", "site_id").agg(F.count_distinct("sample_id").alias("__k"))
    d = d.join(sites.select("site_id", "gnomad_af"), "site_id", "left").join(kids, ["family_id", "site_id"], "left")
    return d.withColumn("sib_shared", F.coalesce((F.col("__k") > 1).cast("int"), F.lit(0))).drop("__k")


PAYLOAD = "svtype string, svlen bigint, child_al array<bigint>, delta_units bigint"


def class_columns(d: DataFrame) -> DataFrame:
    """SV type and length, and repeat lengths by parental haplotype, out of the JSON payload."""
    d = d.withColumn("__p", F.from_json("class_payload", PAYLOAD))
    pat_first = F.coalesce(F.col("child_hap1_is"), F.lit("P")) == "P"
    al = F.col("__p.child_al")
    first, second = F.get(al, F.lit(0)), F.get(al, F.lit(1))
    return d.withColumns({"svtype": F.col("__p.svtype"), "svlen": F.col("__p.svlen"), "paternal_len": F.when(pat_first, first).otherwise(second), "maternal_len": F.when(pat_first, second).otherwise(first)}).drop("__p")


def concordance(final: DataFrame, baseline: DataFrame, keys: list[str]) -> DataFrame:
    """Status of every call against a baseline set matched on ``keys``."""
    b = baseline.select(*keys).distinct().withColumn("__hit", F.lit(True))
    hit, call = F.coalesce("__hit", F.lit(False)), F.col("dnm_call")
    status = (F.when(hit, F.when(call == "YES", "concordant_YES").when(call == "CANDIDATE", "original_tier2").otherwise("original_only"))
              .when(call == "YES", "module_only").when(call == "CANDIDATE", "module_tier2").otherwise("neither"))
    return final.join(b, keys, "left").withColumn("status", status).drop("__hit")


def concordance_counts(rows: DataFrame, by: list[str]) -> DataFrame:
    names = ("concordant_YES", "original_only", "original_tier2", "module_only", "module_tier2", "neither")
    return rows.groupBy(*by).agg(*[F.count_if(F.col("status") == s).alias(s) for s in names])


def truth_labels(wide: DataFrame, min_gq: int = 20, min_dp: int = 10, neg_dp: int = 20) -> DataFrame:
    """Label 1 / 0 / -1 with its reason from exome trio genotypes of the same allele."""
    c = F.col
    n = lambda r: c(f"{r}_a1") + c(f"{r}_a2")
    low = lambda r: ~F.coalesce((c(f"{r}_gq") >= min_gq) & (c(f"{r}_dp") >= min_dp), F.lit(False))
    holds = lambda r: F.coalesce(n(r) > 0, F.lit(False)) | F.coalesce(c(f"{r}_ad_alt") >= 3, F.lit(False))
    reason = F.when(n("c").isNull() | c("c_dp").isNull(), "child_uncalled")
    for r, who in (("f", "father"), ("m", "mother")):
        reason = reason.when(holds(r), f"parent_carries_{who}")
    reason = reason.when(n("c") == 2, "child_hom_alt").when((n("c") == 1) & (low("c") | F.coalesce(c("c_ad_alt") < 2, F.lit(False))), "child_low_quality")
    for r, who in (("f", "father"), ("m", "mother")):
        reason = reason.when((n("c") == 1) & low(r), f"{who}_low_quality").when((n("c") == 1) & (c(f"{r}_ad_alt") > 0), f"{who}_alt_read")
    reason = reason.when(n("c") == 1, "wes_de_novo").when((c("c_dp") >= neg_dp) & (c("c_gq") >= min_gq), "child_hom_ref").otherwise("child_inconclusive")
    label = F.when(c("reason") == "wes_de_novo", 1).when(c("reason").startswith("parent_carries") | (c("reason") == "child_hom_ref"), 0).otherwise(-1)
    return wide.withColumn("reason", reason).withColumn("label", label)


def recovery(plan: DataFrame, evidence: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """How many planted events came back with the planted class, and on how many all six haplotypes were observable."""
    d = plan.join(evidence.select(*keys, "phase_class", "hap_obs_k5"), keys, "left")
    return d.groupBy(*by).agg(F.count("*").alias("n_planted"), F.count_if(F.col("phase_class") == F.col("planted")).alias("n_recovered"), F.count_if(F.col("hap_obs_k5") == 6).alias("n_observable"))


def size_recall(d: DataFrame, by: list[str], tau: float = 0.99, min_rule: int = 6) -> DataFrame:
    """Recall by size of the score path, the depth path and either."""
    germ = F.col("phase_class").startswith("germline")
    score = F.coalesce((F.col("rf_q") >= tau) & germ, F.lit(False))
    depth = germ & (F.col("rule_score") >= min_rule)
    r = lambda c, n: F.round(F.avg(c.cast("double")), 6).alias(n)
    return d.groupBy(*by).agg(F.count("*").alias("n"), r(score, "recall_score"), r(depth, "recall_depth"), r(score | depth, "recall_combined"))


def read_backed_origin(reads: DataFrame, keys: list[str], min_reads: int = 3, min_control: float = 0.8) -> DataFrame:
    """Origin from reads that also carry a parentally informative allele (``vote`` +1 paternal, -1 maternal).

    The alt reads must agree; as a control most REF reads must carry the other parent's allele.
    """
    n = lambda s, v: F.count_if((F.col("support") == s) & (F.col("vote") == v))
    d = reads.groupBy(*keys).agg(n("ALT", 1).alias("ap"), n("ALT", -1).alias("am"), n("REF", 1).alias("rp"), n("REF", -1).alias("rm"))
    origin = F.when((F.col("ap") >= min_reads) & (F.col("am") == 0), "paternal").when((F.col("am") >= min_reads) & (F.col("ap") == 0), "maternal").otherwise("unresolved")
    ref = F.col("rp") + F.col("rm")
    other = F.when(F.col("ap") > F.col("am"), F.col("rm")).otherwise(F.col("rp"))
    control = F.when(ref == 0, "no_control").when(other >= min_control * ref, "pass").otherwise("fail")
    return d.select(*keys, origin.alias("origin"), control.alias("control"))


def genetic_sex(genotypes: DataFrame, male_below: float) -> DataFrame:
    d = genotypes.where(F.col("chrom") == "chrX").groupBy("sample_id").agg(F.avg((F.col("a1") != F.col("a2")).cast("double")).alias("x_het"))
    return d.withColumn("genetic_sex", F.when(F.col("x_het") < male_below, "M").otherwise("F"))


def nested_arms(h1: Column, max_af: float = 0.001, max_recurrence: int = 3) -> tuple[Column, Column, Column]:
    """The first arm, and the two that also ask the site and the cohort."""
    h2 = h1 & (F.col("mask_overlap") == 0) & g.rare(F.col("gnomad_af"), max_af)
    return h1, h2, h2 & (F.coalesce("founder_recurrence_loo", F.lit(0)) < max_recurrence) & (F.col("sib_shared") == 0)


def small_variant_arms(wide: DataFrame, max_af: float = 0.001, max_recurrence: int = 3) -> DataFrame:
    """Three nested heuristic arms with pass flags; the sweep score is the child's genotype quality."""
    h1, h2, h3 = nested_arms(F.coalesce(trio.denovo_predicate(), F.lit(False)), max_af, max_recurrence)
    out = wide.withColumns({"h1_pass": h1, "h2_pass": h2, "h3_pass": h3})
    return out.withColumns({f"h{i}_score": F.when(F.col(f"h{i}_pass"), F.col("c_gq")).otherwise(F.col("c_gq") - 1e6) for i in (1, 2, 3)})


def sv_arm(child_alt: Column, father_alt: Column, mother_alt: Column, mask_frac: Column, panel_ac: Column, max_mask: float = 0.5, max_ac: int = 6) -> Column:
    called = (child_alt > 0) & (father_alt == 0) & (mother_alt == 0)
    return called & (F.coalesce(mask_frac, F.lit(0.0)) < max_mask) & (F.coalesce(panel_ac, F.lit(0)) < max_ac)


def repeat_arm(child: Column, parents: Column, min_gain: int = 50, min_ratio: float = 1.5) -> Column:
    c, p = F.array_max(child), F.array_max(parents)
    return (p > 0) & (c >= min_ratio * p) & (c - p >= min_gain)
