"""Inherited variants: coding consequence of events, inheritance models, prioritisation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import genotype as g
from ..operators import intervals as iv
from ..operators import trio


def coding_consequence(events: DataFrame, cds: DataFrame, id_cols: list[str]) -> DataFrame:
    """Coding bases of each gene an event covers, the gene's total, and whether the event spans the whole gene."""
    gene = cds.groupBy("symbol", "chrom").agg(F.sum(F.col("b_end") - F.col("b_start")).alias("total_bp"), F.min("b_start").alias("g_start"), F.max("b_end").alias("g_end"))
    hit = iv.overlap_join(events, cds)
    ov = iv.overlap_length(F.col("start"), F.col("end"), F.col("b_start"), F.col("b_end"))
    per = hit.groupBy(*id_cols, "symbol", "chrom").agg(F.sum(ov).alias("coding_bp"), F.min("start").alias("start"), F.max("end").alias("end"))
    d = per.join(gene, ["symbol", "chrom"])
    whole = ((F.col("start") <= F.col("g_start")) & (F.col("g_end") <= F.col("end"))).cast("int")
    return d.select(*id_cols, "symbol", "coding_bp", "total_bp", whole.alias("whole_gene"))


def carriers_with_parent(wide: DataFrame, min_gq: int = 20, min_dp: int = 10) -> DataFrame:
    """Children who carry, quality passed, with the transmitting parent."""
    ok = g.qc_pass(F.col("c_gq"), F.col("c_dp"), min_gq, min_dp) & trio.carries("c")
    return wide.where(ok).withColumn("transmitted_from", trio.transmitting_parent())


def inherited_lof(wide: DataFrame, tiers: DataFrame, site: list[str]) -> DataFrame:
    """Constrained loss-of-function variants carried by a child and at least one parent."""
    d = carriers_with_parent(wide).where("transmitted_from <> 'none'")
    return d.join(tiers.select(*site, "tier", "symbol"), site)


def inherited_sv(events: DataFrame, genes: DataFrame, carriers: DataFrame) -> DataFrame:
    """Coding events of a child with the parent carrying the same event (``carriers``: sv_id, father, mother flags)."""
    hit = iv.overlap_join(events, genes).select("sv_id", "symbol").distinct()
    src = F.when(F.col("father") & F.col("mother"), "both").when(F.col("father"), "father").when(F.col("mother"), "mother").otherwise("none")
    return hit.join(carriers.withColumn("transmitted_from", src), "sv_id").where("transmitted_from <> 'none'")


def inherited_repeats(trios: DataFrame) -> DataFrame:
    """Outlier repeat alleles a child shares with a parent."""
    over = lambda r: F.greatest(f"{r}_al1", f"{r}_al2") > F.col("threshold")
    src = F.when(over("f") & over("m"), "both").when(over("f"), "father").when(over("m"), "mother").otherwise("none")
    return trios.where(over("c")).withColumn("transmitted_from", src).where("transmitted_from <> 'none'")


@dataclass(frozen=True)
class ModelParams:
    """Limits of the inheritance models."""

    dominant_af: float = 1e-4
    recessive_af: float = 5e-3
    max_hom: int = 2
    min_gq: int = 20
    min_dp: int = 10


def inheritance_models(genotypes: DataFrame, pedigree: DataFrame, sites: DataFrame, p: ModelParams = ModelParams()) -> DataFrame:
    """DOMINANT_INHERITED, HOMOZYGOUS and X_LINKED findings of affected children.

    ``sites``: site_id, symbol, requirements array, gnomad_af, n_hom. The gene's allelic requirement picks the model, a
    frequency not known counts as rare, and an unaffected sibling with the same finding is reported in ``shared``.
    """
    q = g.qc_pass(F.col("gq"), F.col("dp"), p.min_gq, p.min_dp)
    keep = sites.where(g.rare(F.col("gnomad_af"), p.recessive_af)).select("site_id")
    good = genotypes.where(q).join(keep, "site_id", "left_semi")
    wide = trio.trio_wide(good, pedigree, ["a1", "a2", "gq"], ["site_id", "chrom", "pos"]).join(sites, "site_id")
    af = F.coalesce("gnomad_af", F.lit(-1.0))
    c, f, m = trio.carries("c"), trio.carries("f"), trio.carries("m")
    het, hom = c & trio.het("c"), c & (F.col("c_a1") == F.col("c_a2"))
    req = lambda r: F.array_contains("requirements", r)
    x = (F.col("chrom") == "chrX") & (F.col("sex") == "M") & req("x_hemizygous")
    low = af < p.dominant_af
    model = (F.when(x, F.when(c & m & ~f & low, "X_LINKED"))
             .when(hom & req("biallelic"), F.when(m & f & (F.coalesce("n_hom", F.lit(-1)) <= p.max_hom), "HOMOZYGOUS"))
             .when(het & req("monoallelic") & low & (m != f), "DOMINANT_INHERITED"))
    source = F.when(f & m, "both parents").when(m, "maternal").otherwise("paternal")
    d = wide.withColumns({"model": model, "inherited_from": source}).where("model IS NOT NULL")
    sib = wide.where((F.col("affected") == 0) & c).select("family_id", "site_id", F.col("child_id").alias("sib_id"), hom.alias("sib_hom"))
    hits = d.where("affected = 1").join(sib, ["family_id", "site_id"], "left")
    same = F.when(F.col("model") == "HOMOZYGOUS", F.col("sib_hom")).otherwise(F.col("sib_id").isNotNull())
    return hits.groupBy("child_id", "family_id", "site_id", "symbol", "model", "inherited_from").agg(F.max(F.coalesce(same, F.lit(False)).cast("int")).alias("shared"))


def prioritise(rows: DataFrame, curation: DataFrame) -> DataFrame:
    """Tier 1 established gene, 2 incidental, 3 constrained only, with the reason; ``curation`` has symbol, list, note."""
    d = rows.join(curation, "symbol", "left")
    x_son = (F.col("chrom") == "chrX") & (F.col("sex") == "M") & (F.col("transmitted_from") == "mother")
    tier = F.when(F.col("list").startswith("incidental"), 2).when(F.col("list") == "established", 1).otherwise(3)
    why = (F.when(F.col("list").startswith("incidental"), F.concat_ws(", ", "list", "note")).when(F.col("list") == "established", F.concat(
        F.col("note"), F.when(F.col("parent_affected") == 1, "; co-segregates with an affected parent").when(x_son, "; X-linked, from the mother to an affected son").otherwise("; from an unaffected parent")))
           .otherwise("constrained gene, no established link"))
    return d.withColumns({"tier": tier, "rationale": why})
