"""Tandem repeats: panel distributions, outliers, expansions, locus screen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..operators import panel
from ..operators import selection as sel

LONG = ["sample_id", "family_id", "site_id"]


def alleles_long(tr: DataFrame, min_support: int, keep: list[str] | None = None) -> DataFrame:
    """One row per allele with its own spanning-read support tested (not the better allele's)."""
    each = F.explode(F.array(*[F.struct(F.col(f"al{i}").alias("len"), F.col(f"sd{i}").alias("sd")) for i in (1, 2)]))
    cols = keep or [c for c in tr.columns if c not in ("al1", "al2", "sd1", "sd2")]
    return tr.select(*cols, each.alias("a")).select(*cols, F.col("a.len").alias("len"), (F.col("a.sd") >= min_support).alias("ok"))


def modal_genotype(tr: DataFrame) -> DataFrame:
    """Most frequent unordered allele pair per locus, ties to the smaller pair: n called, n distinct, modal fraction."""
    g = tr.select("site_id", F.least("al1", "al2").alias("lo"), F.greatest("al1", "al2").alias("hi"))
    c = g.groupBy("site_id", "lo", "hi").agg(F.count("*").alias("c"))
    n = c.groupBy("site_id").agg(F.sum("c").alias("n_called"), F.count("*").alias("n_distinct"),
                                 F.min_by(F.struct("lo", "hi", "c"), F.struct(-F.col("c"), F.col("lo"), F.col("hi"))).alias("m"))
    return n.select("site_id", "n_called", "n_distinct", F.col("m.lo").alias("modal_lo"), F.col("m.hi").alias("modal_hi"), (F.col("m.c") / F.col("n_called")).alias("modal_frac"))


def locus_stats(founder_alleles: DataFrame, min_alleles: int) -> DataFrame:
    """Nearest-rank p50 and p99 and the maximum of the passing founder alleles per locus (one histogram per locus)."""
    h = founder_alleles.groupBy("site_id", "len").agg(F.count("*").alias("c")).groupBy("site_id").agg(
        F.sort_array(F.collect_list(F.struct(F.col("len").cast("long").alias("v"), F.col("c")))).alias("h"), F.sum("c").alias("n"))
    h = h.where(F.col("n") >= min_alleles)
    return h.select("site_id", F.col("n").alias("n_founder_alleles"), panel.histogram_percentile(F.col("h"), F.col("n"), 0.5).alias("p50"),
                    panel.histogram_percentile(F.col("h"), F.col("n"), 0.99).alias("p99"), F.element_at("h", -1)["v"].alias("founder_max"))


def thresholds(tr: DataFrame, is_founder: Column, excess: Column, min_support: int, min_all: int, min_rest: int) -> DataFrame:
    """Per locus and family: outlier threshold and founder maximum without the family's own founders."""
    a = alleles_long(tr.where(is_founder), min_support).where("ok")
    loo = panel.leave_one_out_percentile(a, ["site_id"], "family_id", "len", 0.99, min_all, min_rest)
    return loo.select("site_id", "family_id", (F.col("pct_loo") + excess).alias("threshold"), F.col("max_loo").alias("founder_max"))


def outlier_calls(tr: DataFrame, is_founder: Column, excess: Column, min_support: int = 5, min_all: int = 100, min_rest: int = 90) -> DataFrame:
    """Every genotype at a scored locus with its leave-one-family-out threshold, ``called`` and ``outlier`` flags.

    A family none of whose founders passed at the locus is judged against all founders.
    """
    a = alleles_long(tr.where(is_founder), min_support).where("ok")
    st = locus_stats(a, min_all).select("site_id", F.col("p99"), F.col("founder_max").alias("max_all"))
    th = thresholds(tr, is_founder, excess, min_support, min_all, min_rest)
    d = tr.join(st, "site_id").join(th, ["site_id", "family_id"], "left")
    t = F.coalesce(F.col("threshold"), F.col("p99") + excess)
    called = (F.col("sd1") >= min_support) & (F.col("sd2") >= min_support)
    return d.withColumns({"threshold": t, "founder_max": F.coalesce("founder_max", "max_all"), "called": called,
                          "outlier": called & (F.greatest("al1", "al2") > t)}).drop("p99", "max_all")


def trio_repeats(calls: DataFrame, pedigree: DataFrame) -> DataFrame:
    """Child and parental allele pairs side by side at loci where all three are called, with the child's threshold."""
    from ..operators.trio import _roles

    d = calls.where("called").join(_roles(pedigree), "sample_id")
    aggs = [F.max(F.when(F.col("role") == r, F.col(c))).alias(f"{r.lower()}_{c}") for r in "CFM" for c in ("al1", "al2")]
    g = d.groupBy("child_id", "family_id", "affected", "site_id", "chrom", "pos").agg(*aggs, F.max("threshold").alias("threshold"), F.max("founder_max").alias("founder_max"))
    return g.where("c_al1 IS NOT NULL AND f_al1 IS NOT NULL AND m_al1 IS NOT NULL")


def denovo_expansions(trios: DataFrame, excess: Column) -> DataFrame:
    """Child allele longer than every parental allele by the excess and than every founder allele."""
    cmax, pmax = F.greatest("c_al1", "c_al2"), F.greatest("f_al1", "f_al2", "m_al1", "m_al2")
    d = trios.where((cmax > pmax + excess) & (cmax > F.col("founder_max")))
    return d.withColumn("excess_over_parents", cmax - pmax)


def expansion_transmission(trios: DataFrame) -> DataFrame:
    """T and NT of loci where exactly one of four parental alleles is an outlier; autosomes only."""
    over = lambda c: (F.col(c) > F.col("threshold")).cast("int")
    one = over("f_al1") + over("f_al2") + over("m_al1") + over("m_al2") == 1
    t = over("c_al1") + over("c_al2") > 0
    return trios.where(one & ~F.col("chrom").isin("chrX", "chrY")).withColumn("transmitted", t)


def screen(calls: DataFrame, catalogue: DataFrame, modal: DataFrame, min_support: int = 5, min_purity: float = 0.80,
           modal_frac: float = 0.95, modal_called: int = 50) -> DataFrame:
    """Verdict of every (locus, sample) against a repeat catalogue.

    ``calls``: trid, sample_id, affected, counts array, sd array, purity array, dropout. ``catalogue``: trid, recessive,
    distinct_motif, path_min, inter_min, benign_max, motif_known. ``modal``: trid, modal_alleles array, modal_frac, n_called.
    Quality gates every verdict; a call equal to the panel's mode is not callable; an affected carrier is demoted when
    an unaffected relative carries the same or a larger allele.
    """
    d = calls.join(catalogue, "trid").join(modal, "trid", "left")
    cls = rules.repeat_class(F.col("counts"), F.col("recessive"), F.col("distinct_motif"), F.col("path_min"), F.col("inter_min"), F.col("benign_max"))
    d = d.withColumn("__c", cls).withColumns({"allele": F.col("__c.allele"), "verdict": F.col("__c.verdict")}).drop("__c")
    at = F.array_position("counts", F.col("allele")).cast("int")
    own_sd = F.when((at > 0) & (F.size("sd") == F.size("counts")), F.try_element_at("sd", at)).otherwise(F.array_min("sd"))
    qc = rules.flags(low_spanning=own_sd.isNull() | (own_sd < min_support), low_purity=F.array_min("purity") < min_purity,
                     coverage_dropout=F.col("dropout"), motif_unknown=~F.col("motif_known"))
    gated = F.when(F.size("qc") > 0, "NOT_CALLABLE").otherwise(F.col("verdict"))
    at_mode = (F.col("modal_frac") >= modal_frac) & (F.col("n_called") >= modal_called) & F.array_contains("modal_alleles", F.col("allele"))
    hit = F.col("verdict").isin("PATHOGENIC_RANGE", "INTERMEDIATE")
    d = d.withColumn("qc", qc).withColumn("verdict", gated)
    d = d.withColumn("verdict", F.when(hit & F.coalesce(at_mode, F.lit(False)), "NOT_CALLABLE").otherwise(F.col("verdict")))
    healthy = d.where("affected = 0").groupBy("trid", "family_id").agg(F.max("allele").alias("unaffected_max"))
    d = d.join(healthy, ["trid", "family_id"], "left")
    demote = (F.col("affected") == 1) & hit & F.coalesce(F.col("unaffected_max") >= F.col("allele"), F.lit(False))
    return d.withColumn("verdict", F.when(demote, F.concat("verdict", F.lit("_NOT_EXPLANATORY"))).otherwise(F.col("verdict")))
