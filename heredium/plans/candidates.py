"""De novo candidates of three classes in one schema, from the genotypes of a trio.

``genotypes`` are long rows (``sample_id`` and the site's columns); ``trios`` has ``family_id, child_id, father_id,
mother_id``. A member has one row a site. What a genotype shows alone is tested before it moves: a member that is
not called, a child without an alternative allele. The others go once to each couple their sample belongs to, where
a window over the couple and the site puts the parents beside their children. A trio with a member missing or not
called has no candidate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

COLUMNS = ("family_id", "sample_id", "variant_id", "chrom", "start", "end", "ref", "alt", "variant_class", "caller_gq", "caller_dp", "father_gq", "mother_gq", "father_dp", "mother_dp", "payload")
LONGEST_ALLELE = 50                  # symbols of an SV allele that are written out


def trio_rows(genotypes: DataFrame, trios: DataFrame, site: list[str], values: list[str], child: Column, parent: Column) -> DataFrame:
    """One row per (child, site) with structs ``child``, ``father``, ``mother`` of the values, where the child passes its test and both parents theirs.

    Both tests are on the columns of one genotype; NULL is no pass."""
    kids = trios.where("father_id IS NOT NULL AND mother_id IS NOT NULL").select("family_id", "father_id", "mother_id", "child_id")
    couple = ["family_id", "father_id", "mother_id"]
    # A child that is its own parent has no allele its parents lack: roles are told by the ids, which spares a column.
    members = kids.select(*couple, F.explode(F.array("father_id", "mother_id", "child_id")).alias("sample_id")).distinct()
    is_parent = (F.col("sample_id") == F.col("father_id")) | (F.col("sample_id") == F.col("mother_id"))
    d = genotypes.select("sample_id", *site, F.struct(*values).alias("child"), child.alias("__c"), parent.alias("__p")).where("__c OR __p").join(members, "sample_id")
    d = d.where(F.when(is_parent, F.col("__p")).otherwise(F.col("__c"))).drop("__c", "__p")
    key = [*couple, *site]
    d = d.repartition(*key).sortWithinPartitions(*key)      # before the window's two columns are added: they neither move nor are sorted
    of = lambda who: F.max(F.when(F.col("sample_id") == F.col(who), F.col("child"))).over(W.partitionBy(*key))  # noqa: E731 - one row a member and site
    d = d.withColumns({"father": of("father_id"), "mother": of("mother_id")}).where(~is_parent & F.col("father").isNotNull() & F.col("mother").isNotNull())
    return d.withColumnRenamed("sample_id", "child_id").drop("father_id", "mother_id")


def _called() -> Column:
    return F.coalesce(F.size("alleles") > 0, F.lit(False)) & ~F.exists("alleles", lambda x: x.isNull())


def _carries() -> Column:
    return F.array_max("alleles") > 0


def _record(variant_id: Column, start: Column, end: Column, ref: Column, alt: Column, cls: Column, depth: bool, payload: dict[str, Column]) -> list[Column]:
    """The common columns; ``payload`` holds what only one class has, as JSON."""
    none = F.lit(None).cast("long")
    dp = {m: F.col(f"{m}.dp").cast("long") if depth else none for m in ("child", "father", "mother")}
    gq = {m: F.col(f"{m}.gq").cast("long") for m in ("child", "father", "mother")}
    return [F.col("family_id"), F.col("child_id").alias("sample_id"), variant_id.alias("variant_id"), F.col("chrom"), start.cast("long").alias("start"), end.cast("long").alias("end"),
            ref.alias("ref"), alt.alias("alt"), cls.alias("variant_class"), gq["child"].alias("caller_gq"), dp["child"].alias("caller_dp"), gq["father"].alias("father_gq"), gq["mother"].alias("mother_gq"),
            dp["father"].alias("father_dp"), dp["mother"].alias("mother_dp"), F.to_json(F.struct(*[c.alias(n) for n, c in payload.items()])).alias("payload")]


def small_variants(genotypes: DataFrame, trios: DataFrame) -> DataFrame:
    """SNV and INDEL: a row for every allele of the child that neither parent has. Columns: chrom, pos, ref, alts, alleles, gq, dp."""
    d = trio_rows(genotypes, trios, ["chrom", "pos", "ref", "alts"], ["alleles", "gq", "dp"], _called() & _carries(), _called())
    own = F.filter(F.array_except("child.alleles", F.array_union("father.alleles", "mother.alleles")), lambda a: a > 0)
    d = d.withColumn("allele", F.explode(F.array_sort(own)))
    alt = F.get("alts", F.col("allele").cast("int") - 1)
    d = d.withColumn("alt", alt)
    cls = F.when((F.length("ref") == 1) & (F.length("alt") == 1), "SNV").otherwise("INDEL")
    name = F.concat_ws(":", "chrom", F.col("pos").cast("string"), "ref", "alt")
    return d.select(*_record(name, F.col("pos"), F.col("pos") + F.greatest(F.length("ref"), F.lit(1)) - 1, F.col("ref"), F.col("alt"), cls, True,
                             {"allele_index": F.col("allele"), "n_alts": F.size("alts")}))


def structural_variants(genotypes: DataFrame, trios: DataFrame) -> DataFrame:
    """The child carries an alternative allele and both parents are called without one. Columns: chrom, pos, sv_name, ref, alts, svtype, svlen, end, alleles, gq."""
    site = ["chrom", "pos", "sv_name", "ref", "alts", "svtype", "svlen", "end"]
    d = trio_rows(genotypes, trios, site, ["alleles", "gq"], _called() & _carries(), _called() & ~_carries())
    kind, alt = F.coalesce("svtype", F.lit("NA")), F.get("alts", F.lit(0))
    stated = F.when(F.col("end") != 0, F.col("end"))
    end = F.coalesce(stated, F.when((kind == "DEL") & (F.col("svlen") != 0), F.col("pos") + F.abs("svlen")), F.col("pos"))
    name = F.when(F.coalesce("sv_name", F.lit("")).isin("", "."), F.concat_ws(":", "chrom", F.col("pos").cast("string"), kind)).otherwise(F.col("sv_name"))
    short = F.when(F.length(alt) <= LONGEST_ALLELE, alt).otherwise(F.concat(F.lit("<"), kind, F.lit(":"), F.length(alt).cast("string"), F.lit("bp>")))
    return d.select(*_record(name, F.col("pos"), end, F.substring("ref", 1, LONGEST_ALLELE), short, F.lit("SV"), False, {"svtype": kind, "svlen": F.col("svlen"), "end": end}))


def motif_unit(motifs: Column) -> Column:
    """Length of the shortest motif of a comma-separated list, at least 1."""
    return F.greatest(F.lit(1), F.coalesce(F.array_min(F.filter(F.transform(F.split(motifs, ","), F.length), lambda n: n > 0)), F.lit(1)))


def repeats(genotypes: DataFrame, trios: DataFrame, min_units: int = 1, min_bp: int = 1) -> DataFrame:
    """A row for every child length beyond the longest or below the shortest parental one by a margin of whole units.

    Columns: chrom, pos, end, trid, motifs, alleles (lengths in bp), gq."""
    d = trio_rows(genotypes, trios, ["chrom", "pos", "end", "trid", "motifs"], ["alleles", "gq"], _called(), _called())
    both = F.concat("father.alleles", "mother.alleles")
    d = d.withColumns({"unit": motif_unit(F.col("motifs")), "longest": F.array_max(both), "shortest": F.array_min(both)})
    d = d.select("*", F.posexplode("child.alleles").alias("place", "al"))
    margin = F.greatest(F.lit(min_bp), F.lit(min_units) * F.col("unit"))
    up, down = F.col("al") - F.col("longest"), F.col("shortest") - F.col("al")
    way = F.when(up >= margin, "expansion").when(down >= margin, "contraction")
    d = d.withColumns({"direction": way, "delta": F.when(up >= margin, up).otherwise(down)}).where(F.col("direction").isNotNull())
    name = F.concat(F.coalesce("trid", F.concat_ws(":", "chrom", F.col("pos").cast("string"))), F.lit(":a"), F.col("place").cast("string"))
    alt = F.concat(F.lit("<AL="), F.col("al").cast("string"), F.lit(">"))
    return d.select(*_record(name, F.col("pos"), F.coalesce("end", "pos"), F.lit("<TR>"), alt, F.lit("TR"), False, {
        "trid": F.col("trid"), "motifs": F.col("motifs"), "motif_unit_bp": F.col("unit"), "child_al": F.col("child.alleles"), "father_al": F.col("father.alleles"), "mother_al": F.col("mother.alleles"),
        "outlier_allele_idx": F.col("place"), "direction": F.col("direction"), "delta_bp": F.col("delta"), "delta_units": F.round(F.col("delta") / F.col("unit"), 2)}))


def candidates(small: DataFrame | None, sv: DataFrame | None, tr: DataFrame | None, trios: DataFrame) -> DataFrame:
    """All three classes, one schema."""
    parts = [f(g, trios) for f, g in ((small_variants, small), (structural_variants, sv), (repeats, tr)) if g is not None]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def listed(found: DataFrame, lists: DataFrame) -> DataFrame:
    """Adds ``source_list`` (names joined by ';') and ``list_tier`` (the best of HIGH and LOW) from ``lists`` (name, tier, variant_class group, chrom, start, ref, alt, svtype, trid).

    Small variants match by position and alleles, SVs by position and type, repeats by locus."""
    small = F.concat_ws("|", F.lit("small"), "chrom", F.col("start").cast("string"), "ref", "alt")
    sv = lambda kind: F.concat_ws("|", F.lit("sv"), "chrom", F.col("start").cast("string"), kind)
    tr = lambda locus: F.concat_ws("|", F.lit("tr"), locus)
    by = lambda kind, locus: F.when(F.col("variant_class") == "SV", sv(kind)).when(F.col("variant_class") == "TR", tr(locus)).otherwise(small)
    keys = lists.select(by(F.col("svtype"), F.col("trid")).alias("__key"), "name", "tier").groupBy("__key").agg(
        F.concat_ws(";", F.array_sort(F.collect_set("name"))).alias("source_list"), F.min(F.when(F.col("tier") == "HIGH", 1).otherwise(2)).alias("__t"))
    d = found.withColumn("__key", by(F.get_json_object("payload", "$.svtype"), F.get_json_object("payload", "$.trid")))
    return d.join(keys, "__key", "left").withColumn("list_tier", F.when(F.col("__t") == 1, "HIGH").when(F.col("__t") == 2, "LOW")).drop("__key", "__t")
