"""Classification expressions: consequence classes, tiers, repeats, impacts, phenotype coding."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Consequence terms of each class.
LOF_TERMS = ("stop_gained", "frameshift_variant", "splice_acceptor_variant", "splice_donor_variant", "start_lost", "stop_lost")
MISSENSE_TERMS = ("missense_variant",)
INFRAME_TERMS = ("inframe_insertion", "inframe_deletion")
SYNONYMOUS_TERMS = ("synonymous_variant", "stop_retained_variant")


def _any(tokens: Column, terms: tuple[str, ...]) -> Column:
    return F.arrays_overlap(tokens, F.array(*[F.lit(t) for t in terms]))


def consequence_class(csq: Column) -> Column:
    """Most severe class among the ``&``-joined terms."""
    tok = F.split(csq, "&")
    return (
        F.when(_any(tok, LOF_TERMS), "lof").when(_any(tok, MISSENSE_TERMS), "missense")
        .when(_any(tok, INFRAME_TERMS), "inframe").when(_any(tok, SYNONYMOUS_TERMS), "synonymous").otherwise("other")
    )


def lof_tier(s_het: Column) -> Column:
    """Tier 1 at s_het >= 0.18, tier 2 at >= 0.03, tier 3 below or unknown."""
    return F.when(s_het >= 0.18, 1).when(s_het >= 0.03, 2).otherwise(3)


# Score columns and the rank score each must reach.
MISSENSE_SCORES = {"ClinPred_rankscore": 0.4298, "AlphaMissense_rankscore": 0.9603, "popEVE_converted_rankscore": 0.9209, "MPC_rankscore": 0.8947}


def missense_passed() -> list[Column]:
    """The four score tests; scores may be text."""
    return [F.col(c).try_cast("double") >= t for c, t in MISSENSE_SCORES.items()]


def missense_tier(*passed: Column) -> Column:
    """Tier 1 when all four scores pass, down to 4 for one; an absent score is not passed. 0 = none."""
    n = sum((F.coalesce(p, F.lit(False)).cast("int") for p in passed), F.lit(0))
    return F.when(n > 0, 5 - n).otherwise(0)


def s_het_band(s_het: Column) -> Column:
    return F.when(s_het.isNull(), "unknown").when(s_het >= 0.18, "high").when(s_het >= 0.03, "moderate").otherwise("low")


def sv_impact(svtype: Column, kinds: Column) -> Column:
    """Impact of an event from its type and the set of feature kinds it touches."""
    coding = F.array_contains(kinds, "CDS")
    utr = F.arrays_overlap(kinds, F.array(F.lit("UTR5"), F.lit("UTR3")))

    def graded(on_coding: str, on_utr: str) -> Column:
        return F.when(coding, on_coding).when(utr, on_utr).otherwise("intronic_or_exon_noncoding")

    return (
        F.when(svtype == "BND", "excluded_BND")
        .when(svtype.isin("DEL", "CNV"), graded("coding_LoF", "UTR_loss"))
        .when(svtype == "INS", graded("coding_LoF_insertion", "UTR_insertion"))
        .when(svtype == "DUP", graded("coding_duplication(gain,flag)", "UTR_duplication"))
        .when(svtype == "INV", graded("coding_inversion", "UTR_inversion"))
        .otherwise("other")
    )


# Impact groups by the first letters of an impact, and the label of each (worst panel rank, impact group); the first that fits is told.
IMPACT_GROUPS = {
    "lof": ("coding_LoF", "LoF_HC", "stop_gained", "frameshift", "splice_donor", "splice_acceptor", "start_lost", "coding_inversion", "coding_dup"),
    "mild": ("missense", "UTR_", "coding_duplication", "inframe", "splice_region", "TR_"),
}
RELEVANCE = (
    (2, "lof", "HIGH: LoF-type variant in a high-confidence panel gene"),
    (2, "mild", "MODERATE: non-truncating variant in a high-confidence panel gene"),
    (4, "lof", "MODERATE: LoF-type variant in a panel gene"),
    (4, None, "LOW: panel gene, uncertain impact"),
)
OFF_PANEL = {"constrained": "MODERATE: LoF-type variant in a constrained gene off-panel", "other": "NONE: off-panel"}


def _starts_with_any(text: Column, heads: tuple[str, ...]) -> Column:
    return reduce(lambda x, y: x | y, [text.startswith(h) for h in heads])


def clinical_relevance(panel_rank: Column, impact: Column, s_het: Column) -> Column:
    """Label by the gene's panel rank and the impact; off the panel only a loss of function at s_het >= 0.18 counts."""
    group = {name: F.coalesce(_starts_with_any(impact, heads), F.lit(False)) for name, heads in IMPACT_GROUPS.items()} | {None: F.lit(True)}
    constrained = F.coalesce(s_het >= 0.18, F.lit(False)) & group["lof"]
    label = F.when(constrained, OFF_PANEL["constrained"]).otherwise(OFF_PANEL["other"])
    for worst, name, text in reversed(RELEVANCE):
        label = F.when((panel_rank <= worst) & group[name], text).otherwise(label)
    return label


def sv_length(svlen: Column, start: Column, end: Column, svtype: Column) -> Column:
    """|SVLEN|, else END - POS for interval types (an insertion's END says nothing about its length)."""
    return F.coalesce(F.abs(svlen), F.when(svtype.isin("DEL", "DUP", "INV", "CNV"), end - start))


# Event types that are one class for matching.
MATCH_CLASS = {"INS": "INSDUP", "DUP": "INSDUP", "DEL": "DEL", "INV": "INV"}


def sv_match_class(svtype: Column) -> Column:
    out = F.lit(None).cast("string")
    for k, v in MATCH_CLASS.items():
        out = F.when(svtype == k, v).otherwise(out)
    return out


def shortest_motif(motifs: Column) -> Column:
    """Length of the shortest motif of a comma list, 2 when none is given."""
    lens = F.transform(F.filter(F.split(motifs, ","), lambda m: ~m.isin("", ".")), lambda m: F.length(m))
    return F.coalesce(F.array_min(lens), F.lit(2))


def repeat_excess(motifs: Column, units: int = 3, floor_bp: int = 6) -> Column:
    return F.greatest(F.lit(floor_bp), units * shortest_motif(motifs))


def motif_counts(mc: Column, index: Column) -> Column:
    """Per-allele count of one motif from 'a_b_c,a_b_c'."""
    return F.filter(
        F.transform(F.split(mc, ","), lambda a: F.get(F.split(a, "_"), index).try_cast("int")), lambda x: x.isNotNull())


def repeat_class(counts: Column, recessive: Column, distinct_motif: Column, path_min: Column, inter_min: Column,
                 benign_max: Column) -> Column:
    """struct(allele, verdict): recessive loci are judged on the smaller of two alleles."""
    allele = F.when(recessive & (F.size(counts) > 1), F.array_min(counts)).otherwise(F.array_max(counts))
    absent = distinct_motif & (F.array_max(counts) == 0)
    verdict = (
        F.when(F.coalesce(F.size(counts), F.lit(0)) <= 0, "NO_CALL").when(absent, "benign")
        .when(allele >= path_min, "PATHOGENIC_RANGE").when(allele >= inter_min, "INTERMEDIATE")
        .when(allele <= benign_max, "benign").otherwise("unclassified")
    )
    return F.struct(F.when(absent, 0).otherwise(allele).alias("allele"), verdict.alias("verdict"))


def tri_state(asked: Column, answer: Column, present: Column) -> Column:
    """present / absent / unknown: a question that was not asked, or has no answer, is unknown."""
    return F.when(~F.coalesce(asked, F.lit(False)) | answer.isNull(), "unknown").when(present, "present").otherwise("absent")


def skew_band(skew: Column) -> Column:
    return F.when(skew >= 0.90, "extreme").when(skew >= 0.80, "marked").when(skew >= 0.70, "skewed").otherwise("")


def trio_skew(mean_signed_diff: Column, span: Column) -> Column:
    return 0.5 + mean_signed_diff / (2 * span)


def folded_skew(observed: Column, noise_floor: Column, span: Column) -> Column:
    """Unsigned haplotype difference with the noise floor removed in quadrature."""
    signal = F.sqrt(F.greatest(observed * observed - noise_floor * noise_floor, F.lit(0.0)))
    return 0.5 + signal / (2 * span)


def flags(**conditions: Column) -> Column:
    """Names of the true conditions, in the order given."""
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in conditions.items()]))
