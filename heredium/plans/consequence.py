"""Coding consequence of variants against transcript models held as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import intervals as iv
from ..operators import selection as sel

# The standard genetic code, bases in TCAG order.
BASES = "TCAG"
AMINO = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"


def amino_acid(codon: Column) -> Column:
    at = lambda i: F.instr(F.lit(BASES), F.substring(codon, i, 1)) - 1
    return F.substring(F.lit(AMINO), 16 * at(1) + 4 * at(2) + at(3) + 1, F.lit(1))


def complement(seq: Column) -> Column:
    return F.translate(seq, "ACGT", "TGCA")


def coding_consequence(variants: DataFrame, exons: DataFrame, transcripts: DataFrame, id_cols: list[str], pad: int = 8) -> DataFrame:
    """Class and detail of each variant near a coding exon: the protein change of a substitution, the first coding base and size of an indel, otherwise place and alleles.

    ``variants``: ids, chrom, pos (1-based), ref, alt. ``exons``: symbol, chrom, e_start, e_end (coding part, 0-based
    half-open), c_start (coding index of the exon's first base in transcript order). ``transcripts``: symbol, strand (+1/-1), cds.
    """
    v = variants.withColumns({"__s": F.col("pos") - 1, "__e": F.col("pos") - 1 + F.length("ref")})
    x = exons.withColumns({"b_start": F.col("e_start") - pad, "b_end": F.col("e_end") + pad})
    d = iv.overlap_join(v, x, ("__s", "__e")).join(transcripts, "symbol")
    inside = F.least("__e", "e_end") - F.greatest("__s", "e_start")
    core = (F.least(F.col("__e"), F.col("e_start")) > F.greatest(F.col("__s"), F.col("e_start") - 2)) | (F.least(F.col("__e"), F.col("e_end") + 2) > F.greatest(F.col("__s"), F.col("e_end")))
    ci = F.col("c_start") + F.when(F.col("strand") == 1, F.col("__s") - F.col("e_start")).otherwise(F.col("e_end") - 1 - F.col("__s"))
    d = d.withColumns({"__in": F.greatest(inside, F.lit(0)), "__ci": ci})
    k, off = F.floor(F.col("__ci") / 3), F.pmod(F.col("__ci"), F.lit(3))
    codon = F.substring(F.col("cds"), (3 * k + 1).cast("int"), F.lit(3))
    base = F.when(F.col("strand") == 1, F.col("alt")).otherwise(complement(F.col("alt")))
    d = d.withColumns({"__k": k, "__codon": codon, "__new": F.overlay(codon, base, (off + 1).cast("int"), 1)})
    a0, a1 = amino_acid(F.col("__codon")), amino_acid(F.col("__new"))
    d = d.withColumns({"__a0": a0, "__a1": a1})
    snv = (F.length("ref") == 1) & (F.length("alt") == 1)
    change = F.length("alt") - F.length("ref")
    cls = (F.when(F.col("__in") <= 0, F.when(core, "splice_donor_acceptor").otherwise("splice_region"))
           .when(snv, F.when(F.col("__a0") == F.col("__a1"), "synonymous").when(F.col("__a1") == "*", "nonsense").when(F.col("__a0") == "*", "stop_loss").when(F.col("__k") == 0, "start_loss").otherwise("missense"))
           .when(F.col("__in") < F.length("ref"), "splice_indel").when(change % 3 == 0, "inframe_indel").otherwise("frameshift"))
    # the first coding base touched; where the transcript runs backwards that is the last base of the reference allele
    first = F.col("c_start") + F.when(F.col("strand") == 1, F.greatest("__s", "e_start") - F.col("e_start")).otherwise(F.col("e_end") - F.least("__e", "e_end"))
    size = F.when(change % 3 == 0, F.concat(F.when(change < 0, "del").otherwise("ins"), F.abs(change).cast("string"))).otherwise("fs")
    detail = (F.when(snv & (F.col("__in") > 0), F.concat(F.lit("p."), "__a0", (F.col("__k") + 1).cast("string"), "__a1"))
              .when(F.col("__in") < F.length("ref"), F.concat(F.col("pos").cast("string"), "ref", F.lit(">"), "alt"))
              .otherwise(F.concat(F.lit("c."), (first + 1).cast("string"), size)))
    d = d.withColumns({"class": cls, "detail": detail})
    # an exon the variant lies in outranks a neighbour it is merely close to
    return sel.best_per_key(d, [*id_cols, "symbol"], [-F.col("__in"), F.col("e_start")], ["class", "detail"])
