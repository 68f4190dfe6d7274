"""Clinical arms: gene sets, quality verdicts, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..operators import intervals as iv


def gene_sets(sets: list[tuple[str, int, DataFrame]]) -> DataFrame:
    """Gene to its sorted set labels and best rank; each set has a ``symbol`` column."""
    u = None
    for name, rank, df in sets:
        d = df.select("symbol").distinct().withColumns({"s": F.lit(name), "r": F.lit(rank)})
        u = d if u is None else u.unionByName(d)
    return u.groupBy("symbol").agg(F.concat_ws(";", F.array_sort(F.collect_set("s"))).alias("sets"), F.min("r").alias("best_rank"))


def gene_flags(ladders: list[list[tuple[str, DataFrame]]]) -> DataFrame:
    """Labels of each symbol in the order of the ladders, joined by ``;``; of one ladder (surest set first) a gene has the first label it is in."""
    u = None
    for i, ladder in enumerate(ladders):
        for j, (label, genes) in enumerate(ladder):
            d = genes.select("symbol", F.lit(i).alias("i"), F.struct(F.lit(j).alias("j"), F.lit(label).alias("label")).alias("step"))
            u = d if u is None else u.unionByName(d)
    first = u.groupBy("symbol", "i").agg(F.min("step").alias("step"))
    labels = F.transform(F.array_sort(F.collect_list(F.struct("i", F.col("step.label").alias("label")))), lambda x: x["label"])     # one a ladder
    return first.groupBy("symbol").agg(F.array_join(labels, ";").alias("gene_flags"))


def priority_list(rows: DataFrame, flags: DataFrame, first: str, sure: tuple[str, ...]) -> DataFrame:
    """Rows of all variant classes in flagged genes, in reading order: genes labelled ``first``, then those with a sure label, then structural events, then by family.

    ``rows``: class (structural ones begin with ``SV``), family_id, symbol and whatever else is to be told.
    """
    d = rows.join(flags, "symbol")
    has = F.split("gene_flags", ";")
    later = lambda c: (~c).cast("int")
    d = d.withColumns({"after_first": later(F.array_contains(has, first)), "after_sure": later(F.arrays_overlap(has, F.array(*[F.lit(x) for x in sure]))), "after_sv": later(F.col("class").startswith("SV"))})
    return d.orderBy("after_first", "after_sure", "after_sv", "family_id")


def event_kinds(events: DataFrame, features: DataFrame, id_cols: list[str]) -> DataFrame:
    """The set of feature kinds each event touches."""
    return iv.overlap_join(events, features).groupBy(*id_cols).agg(F.collect_set("kind").alias("kinds"))


# Reasons for phase classes that are not de novo.
NOT_DE_NOVO = {"phase_conflict_artifact": "PHASE_CONFLICT", "inherited_missed_in_parent": "INHERITED", "parental_mosaic_transmitted": "PARENTAL_MOSAIC"}


def _common() -> dict[str, Column]:
    """Rejections of every class."""
    out = {label: F.col("phase_class") == cls for cls, label in NOT_DE_NOVO.items()}
    return out | {"SEEN_IN_OTHER_FAMILY": F.coalesce(F.col("cohort_ac_loo") > 0, F.lit(False)), "IN_FOUNDER_PANEL": F.coalesce(F.col("founder_recurrence") > 0, F.lit(False))}


def _verdict(d: DataFrame, fails: dict[str, Column], criteria: dict[str, Column], passed: Column, review: Column, notes: Column | None = None) -> DataFrame:
    """Failure reasons first; otherwise signed criteria, their count, and PASS / REVIEW / FAIL."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    d = d.withColumn("__f", rules.flags(**{k: yes(v) for k, v in fails.items()}))
    clear = F.size("__f") == 0
    marks = F.array(*[F.concat(F.when(yes(v), "+").otherwise("-"), F.lit(k)) for k, v in criteria.items()])
    met = sum((yes(v).cast("int") for v in criteria.values()), F.lit(0))
    verdict = F.when(~clear, "FAIL").when(yes(passed), "PASS").when(yes(review), "REVIEW").otherwise("FAIL")
    return d.withColumns({"quality_verdict": verdict, "quality_reasons": F.concat_ws(";", F.when(clear, marks).otherwise(F.col("__f")), *([notes] if notes is not None else [])),
                          "quality_met": F.when(clear, met).otherwise(0)}).drop("__f")


def small_variant_quality(d: DataFrame, max_af: float = 0.001, min_alt: int = 3, min_dp: int = 8) -> DataFrame:
    """SNV and indel verdict from phase class, parental reads, rule score and depth."""
    germ = F.col("phase_class").startswith("germline_DNM")
    fails = _common() | {"COMMON_IN_POPULATION": F.col("gnomad_af") >= max_af, "PARENT_ALT_READS": (F.col("p_max_alt_any_hap") >= 2) | (F.coalesce("T_alt", F.lit(0)) >= 2)}
    alt = F.col("A_alt") + F.col("C_un_alt")
    crit = {"ALT_READS": alt >= min_alt, "ALT_CONFINED": F.col("c_alt_confined") == 1, "PARENTS_ALT_FREE": F.col("p_max_alt_any_hap") <= 1, "RULE_SCORE": F.col("rule_score") >= 5,
            "GERMLINE_CLASS": germ, "CHILD_DP": F.col("child_dp") >= min_dp}
    allok = F.lit(True)
    for c in crit.values():
        allok = allok & c
    mosaic = F.col("phase_class") == "child_postzygotic_mosaic"
    return _verdict(d, fails, crit, allok & ~mosaic, mosaic | (germ & (F.col("rule_score") >= 3) & (alt >= min_alt)) | (F.col("rf_q") >= 0.3), F.when(mosaic, "POSTZYGOTIC_MOSAIC"))


def repeat_quality(d: DataFrame) -> DataFrame:
    germ = F.col("phase_class").startswith("germline_DNM")
    crit = {"CALLED_TIER1": F.col("dnm_call") == "YES", "RULE_SCORE": F.col("rule_score") >= 5, "GERMLINE_CLASS": germ, "ALT_CONFINED": F.col("c_alt_confined") == 1}
    return _verdict(d, _common(), crit, (F.col("dnm_call") == "YES") & germ, (F.col("dnm_call") == "CANDIDATE") | (F.col("rule_score") >= 3) | (F.col("rf_q") >= 0.3))


def sv_quality(d: DataFrame, del_ratio: float = 0.7, dup_ratio: float = 1.3, parent_ratio: float = 0.85, het_max: float = 0.35, het_len: int = 5000) -> DataFrame:
    """Structural variant verdict: depth path for deletions and duplications with a ratio, breakpoint path otherwise.

    Duplications are judged on gained depth and never on heterozygosity; the heterozygosity criterion needs a long event.
    """
    c = F.col
    yes = lambda x: F.coalesce(x, F.lit(False))
    dup, dele = c("svtype") == "DUP", c("svtype").isin("DEL", "CNV")
    lo, hi = F.least("f_ratio", "m_ratio"), F.greatest("f_ratio", "m_ratio")
    fails = _common() | {"FAIL_MOSTLY_REPEAT": c("mask_overlap") >= 0.5, "PARENT_JUNCTION_READS": c("parent_junction") > 1, "PARENT_DEPTH_DEPLETED": dele & (lo <= del_ratio), "PARENT_DEPTH_GAINED": dup & (hi >= dup_ratio)}
    on_depth = (dup | dele) & c("sv_ratio").isNotNull()
    depth_ok = yes(F.when(dup, c("sv_ratio") >= dup_ratio).otherwise(c("sv_ratio") <= del_ratio))
    measured = c("f_ratio").isNotNull() | c("m_ratio").isNotNull()
    parents_ok = F.when(dup, measured).otherwise(measured & yes((lo > del_ratio) & (lo >= parent_ratio)))
    both, support = c("junction_both_ends") > 0, F.greatest(c("child_junction"), c("child_support"))
    long_del = ~dup & (c("length") >= het_len)
    persists = long_del & yes(c("het_persistence") > het_max)
    lost = ~dup & yes(c("het_persistence") <= het_max)
    germ = c("phase_class").startswith("germline_DNM")
    pass_depth = depth_ok & parents_ok & (yes(both) | lost) & ~persists
    fail_depth = ~depth_ok & persists
    review_depth = ~fail_depth & (depth_ok | (yes(both) & (support >= 2)))
    pass_bp = (support >= 3) & (c("parent_junction") == 0) & (c("rule_score") >= 5) & germ
    review_bp = ((c("rule_score") >= 3) & (c("parent_junction") == 0)) | (c("rf_q") >= 0.3)
    crit = {"DEPTH": F.when(on_depth, depth_ok), "PARENTS_NOT_DEPLETED": F.when(on_depth, parents_ok), "JUNCTION_BOTH_ENDS": F.when(on_depth, both), "LOSS_OF_HETEROZYGOSITY": F.when(on_depth & long_del, lost),
            "CHILD_SUPPORT": support >= F.when(on_depth, 2).otherwise(3), "PARENTS_NO_SUPPORT": c("parent_junction") == 0, "RULE_SCORE": c("rule_score") >= 5, "GERMLINE_CLASS": germ}
    note = F.when(on_depth & persists & depth_ok, "DEPTH_LOST_BUT_HETS_PERSIST").when(on_depth & fail_depth, "NO_DEPTH_LOSS_HETS_PERSIST")
    return _verdict(d, fails, crit, F.when(on_depth, pass_depth).otherwise(pass_bp), F.when(on_depth, review_depth).otherwise(review_bp), note)


def arm_rows(events: DataFrame, features: DataFrame, panel_ranks: DataFrame, s_het: DataFrame, id_cols: list[str]) -> DataFrame:
    """Panel-led rows: one per event and touched gene, with impact, best panel rank and relevance label."""
    hit = iv.overlap_join(events, features).groupBy(*id_cols, "svtype", "symbol").agg(F.collect_set("kind").alias("kinds"))
    d = hit.join(panel_ranks, "symbol", "left").join(s_het, "symbol", "left").withColumn("panel_rank", F.coalesce("best_rank", F.lit(9)))
    d = d.withColumn("impact", rules.sv_impact(F.col("svtype"), F.col("kinds")))
    return d.withColumn("relevance", rules.clinical_relevance(F.col("panel_rank"), F.col("impact"), F.col("s_het"))).drop("best_rank", "kinds")


def validation_outcome(d: DataFrame, min_dp: int = 6) -> DataFrame:
    """Short-read outcome of a long-read event from the trio's alt counts and depths (NULL = missing)."""
    ok = lambda r: F.coalesce(F.col(f"{r}_dp") >= min_dp, F.lit(False))
    has = lambda r: F.coalesce(F.col(f"{r}_alt") > 0, F.lit(False))
    f_car, m_car = has("f") & ok("f"), has("m") & ok("m")
    reason = (F.when(f_car & m_car, "allele_in_both_parents").when(f_car, "allele_in_father").when(m_car, "allele_in_mother")
              .when(~has("c"), "proband_no_support").when(~ok("c"), "proband_low_coverage")
              .when(F.col("f_alt").isNull() | ~ok("f"), "father_low_coverage").when(F.col("m_alt").isNull() | ~ok("m"), "mother_low_coverage").otherwise("proband_alt_parents_ref"))
    d = d.withColumn("reason", reason)
    outcome = F.when(F.col("reason").startswith("allele_in"), "REFUTED").when(F.col("reason") == "proband_alt_parents_ref", "CONFIRMED").otherwise("UNINFORMATIVE")
    return d.withColumn("outcome", outcome)


def read_review(d: DataFrame) -> DataFrame:
    """Read-level verdict: junction reads at both ends, then one haplotype depleted or heterozygosity lost for long events."""
    c = F.col
    depleted = F.lit(False)
    for h in (1, 2):
        depleted = depleted | ((c(f"fl_{h}") > 0) & (c(f"in_{h}") <= 0.6 * c(f"fl_{h}")))
    enough = c("het_sites") >= 20
    persist = enough & (c("het_flank") > 0.05) & (c("het_in") > 0.8 * c("het_flank"))
    v = (F.when(F.least("junction_left", "junction_right") < 2, "FAIL_junction_reads").when(c("length") < 5000, "PASS_small_event")
         .when(F.coalesce(persist, F.lit(False)), "FAIL_het_SNVs_persist").when(depleted, "PASS_constitutional_consistent").otherwise("FAIL_no_haplotype_depletion"))
    return d.withColumn("review", v)


def sv_priority(events: DataFrame, gene_features: DataFrame, ranks: DataFrame, panel_ac: DataFrame, id_cols: list[str]) -> DataFrame:
    """Priority 1 to 4 by the best gene set touched, +20 when the interval recurs across families, +10 at panel AC >= 6."""
    touched = iv.overlap_join(events, gene_features).join(ranks, "symbol").groupBy(*id_cols).agg(F.min("best_rank").alias("r"))
    rec = events.groupBy("chrom", "start", "end", "svtype").agg(F.count_distinct("family_id").alias("n_families"))
    d = events.join(touched, id_cols, "left").join(rec, ["chrom", "start", "end", "svtype"]).join(panel_ac, id_cols, "left")
    base = F.least(F.coalesce("r", F.lit(4)), F.lit(4))
    add = F.when(F.col("n_families") > 1, 20).otherwise(0) + F.when(F.coalesce("max_ac", F.lit(0)) >= 6, 10).otherwise(0)
    return d.withColumn("priority", base + add).drop("r")


def acceptance(found: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """Every expected row with whether it was found."""
    f = found.select(*keys).distinct().withColumn("__f", F.lit(1))
    return expected.join(f, keys, "left").withColumn("found", F.coalesce("__f", F.lit(0))).drop("__f")
