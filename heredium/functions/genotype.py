"""Genotype and allele expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import bind

# First and last base of the two pseudoautosomal regions of GRCh38 chrX.
PAR_X = ((10001, 2781479), (155701383, 156030895))
# Contigs that never carry a biparental autosomal genotype.
NON_BIPARENTAL = ("chrY", "Y", "chrM", "MT", "chrEBV")


def canonical_allele(pos: Column, ref: Column, alt: Column) -> Column:
    """struct(pos, ref, alt) with the shared prefix, then the shared suffix, removed; a core may become empty."""

    def shared(a: Column, b: Column) -> Column:
        n = F.least(F.length(a), F.length(b))
        differs = F.zip_with(F.slice(F.split(a, ""), F.lit(1), n), F.slice(F.split(b, ""), F.lit(1), n), lambda x, y: x != y)
        return F.when(n == 0, F.lit(0)).otherwise(F.coalesce(F.nullif(F.array_position(differs, True).cast("int"), F.lit(0)) - 1, n))

    whole = F.struct(pos.cast("long").alias("pos"), F.upper(ref).alias("ref"), F.upper(alt).alias("alt"))
    headed = bind(whole, lambda c: F.struct(c["pos"].alias("pos"), c["ref"].alias("ref"), c["alt"].alias("alt"), shared(c["ref"], c["alt"]).alias("h")))
    cut = bind(headed, lambda c: F.struct(
        (c["pos"] + c["h"]).alias("pos"), F.substring(c["ref"], c["h"] + 1, F.length(c["ref"])).alias("ref"),
        F.substring(c["alt"], c["h"] + 1, F.length(c["alt"])).alias("alt")))
    tailed = bind(cut, lambda c: F.struct(c["pos"].alias("pos"), c["ref"].alias("ref"), c["alt"].alias("alt"),
                                          shared(F.reverse(c["ref"]), F.reverse(c["alt"])).alias("t")))
    return bind(tailed, lambda c: F.struct(
        c["pos"].alias("pos"), F.substring(c["ref"], F.lit(1), F.length(c["ref"]) - c["t"]).alias("ref"),
        F.substring(c["alt"], F.lit(1), F.length(c["alt"]) - c["t"]).alias("alt")))


def parse_gt(gt: Column) -> Column:
    """struct(alleles, phased): ``alleles`` is NULL when any allele is missing."""
    parts = F.split(F.translate(gt, "|", "/"), "/")
    alleles = F.transform(parts, lambda x: x.try_cast("int"))
    missing = F.exists(alleles, lambda x: x.isNull())
    return F.struct(F.when(~missing, alleles).alias("alleles"), gt.contains("|").alias("phased"))


def alt_count(alleles: Column) -> Column:
    return F.size(F.filter(alleles, lambda x: x > 0))


def called_count(alleles: Column) -> Column:
    return F.size(F.filter(alleles, lambda x: x.isNotNull()))


def is_het(alleles: Column) -> Column:
    return (F.size(alleles) == 2) & (alleles[0] != alleles[1])


def is_hom_ref(alleles: Column) -> Column:
    """All called alleles are reference; a haploid 0 counts."""
    return (F.size(alleles) > 0) & F.forall(alleles, lambda x: x == 0)


def zygosity(alleles: Column) -> Column:
    n, k = F.size(alleles), alt_count(alleles)
    return (
        F.when(alleles.isNull() | (called_count(alleles) < n), "missing")
        .when((n == 1) & (k == 1), "hemizygous")
        .when(k == 0, "hom_ref")
        .when(alleles[0] != alleles[1], "het")
        .otherwise("hom_alt")
    )


def mendel_vote(a: Column, b: Column, father: Column, mother: Column) -> Column:
    """+1 first haplotype is paternal, -1 maternal, 0 uninformative, NULL Mendelian-inconsistent.

    ``a|b`` is the child's phased pair; ``father`` and ``mother`` are arrays of carried alleles.
    """
    pat = F.array_contains(father, a) & F.array_contains(mother, b)
    mat = F.array_contains(father, b) & F.array_contains(mother, a)
    return F.when(pat & mat, 0).when(pat, 1).when(mat, -1)


def in_par(pos: Column) -> Column:
    hit = F.lit(False)
    for lo, hi in PAR_X:
        hit = hit | pos.between(lo, hi)
    return hit


def is_x(chrom: Column) -> Column:
    return chrom.isin("chrX", "X")


def hemizygous_region(chrom: Column, pos: Column, sex: Column) -> Column:
    """A male's non-pseudoautosomal X, where one allele is carried."""
    return is_x(chrom) & ~in_par(pos) & (sex == "M")


def skip_for_phasing(chrom: Column, pos: Column, sex: Column) -> Column:
    return chrom.isin(*NON_BIPARENTAL) | hemizygous_region(chrom, pos, sex)


def parental_alleles(a: Column, b: Column, phased: Column, hap1_is: Column) -> Column:
    """struct(paternal, maternal) allele of the child; NULLs where the block is not oriented."""
    pat = F.when(a == b, a).when(phased & (hap1_is == "P"), a).when(phased & (hap1_is == "M"), b)
    mat = F.when(a == b, a).when(phased & (hap1_is == "P"), b).when(phased & (hap1_is == "M"), a)
    return F.struct(pat.alias("paternal"), mat.alias("maternal"))


def allele_ratio(ref_depth: Column, alt_depth: Column) -> Column:
    return ref_depth / (alt_depth + 1)


def allele_balance(ref_depth: Column, alt_depth: Column) -> Column:
    total = ref_depth + alt_depth
    return F.when(total > 0, alt_depth / total)


def pl_of_genotype(pl: Column, a: Column) -> Column:
    """Phred likelihoods of 0/0, 0/a and a/a from a VCF PL array (index of j/k, j <= k, is k(k+1)/2 + j)."""
    base = (a * (a + 1) / 2).cast("int")
    return F.array(F.get(pl, F.lit(0)), F.get(pl, base), F.get(pl, (base + a).cast("int")))


def quality_by_depth(qual: Column, gq: Column, depth: Column) -> Column:
    """Site quality over depth, falling back to genotype quality where the site has none."""
    return F.when(depth > 0, F.coalesce(qual, gq) / depth)


def error_allowance(n: Column, reads: float = 1.0, frac: float = 0.05) -> Column:
    return F.greatest(F.lit(reads), frac * n)


def qc_pass(gq: Column, dp: Column, min_gq: int = 20, min_dp: int = 10) -> Column:
    return F.coalesce(gq >= min_gq, F.lit(False)) & F.coalesce(dp >= min_dp, F.lit(False))


def rare(af: Column, below: float) -> Column:
    """Absent from the population table means rare."""
    return F.coalesce(af, F.lit(-1.0)) < below


def normalise_sex(value: Column) -> Column:
    v = F.lower(F.trim(value))
    return F.when(v.isin("1", "m", "male"), "M").when(v.isin("2", "f", "female"), "F").otherwise("U")


def versionless(value: Column) -> Column:
    return F.regexp_replace(value, r"\..*", "")


def with_chr(value: Column) -> Column:
    return F.when(value.startswith("chr"), value).otherwise(F.concat(F.lit("chr"), value))


def without_probe_suffix(value: Column) -> Column:
    """Array probe ids carry a design suffix after an underscore."""
    return F.regexp_replace(value, r"_.*$", "")
