"""Trio-shaped views of a long genotype table and the predicates on them.

``genotypes`` has one row per (sample, site); ``pedigree`` one per sample with
``father_id`` and ``mother_id``. Only complete trios are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import genotype as g

SITE = ["site_id", "chrom", "pos", "ref", "alt"]
FIELDS = ["a1", "a2", "phased", "ps", "gq", "dp", "ad_ref", "ad_alt"]


def complete_trios(pedigree: DataFrame) -> DataFrame:
    """Children whose father and mother are both in the table."""
    kids = pedigree.where(F.col("father_id").isNotNull() & F.col("mother_id").isNotNull())
    ids = pedigree.select(F.col("sample_id").alias("__id"))
    for parent in ("father_id", "mother_id"):
        kids = kids.join(ids, F.col(parent) == F.col("__id"), "left_semi")
    return kids


def _roles(pedigree: DataFrame) -> DataFrame:
    kids = complete_trios(pedigree)
    role = lambda c, r: F.struct(F.col(c).alias("sample_id"), F.lit(r).alias("role"))
    members = F.array(role("sample_id", "C"), role("father_id", "F"), role("mother_id", "M"))
    return kids.select(F.col("sample_id").alias("child_id"), "sex", "affected", F.explode(members).alias("m")).select(
        "child_id", "sex", "affected", F.col("m.sample_id").alias("sample_id"), F.col("m.role").alias("role"))


def trio_merge(genotypes: DataFrame, pedigree: DataFrame, fields: list[str] | None = None, site: list[str] | None = None) -> DataFrame:
    """Child rows with their parents' columns left-joined on the full allele key."""
    fields, site = fields or FIELDS, site or SITE
    kids = complete_trios(pedigree).select(F.col("sample_id").alias("child_id"), "family_id", "father_id", "mother_id", "sex", "affected")
    c = genotypes.select(F.col("sample_id").alias("child_id"), *site, *[F.col(f).alias(f"c_{f}") for f in fields]).join(kids, "child_id")
    for role, parent in (("f", "father_id"), ("m", "mother_id")):
        p = genotypes.select(F.col("sample_id").alias(parent), *site, *[F.col(f).alias(f"{role}_{f}") for f in fields])
        c = c.join(p, [parent, *site], "left")
    return c


def trio_wide(genotypes: DataFrame, pedigree: DataFrame, fields: list[str] | None = None, site: list[str] | None = None) -> DataFrame:
    """The same rows with one shuffle: each genotype goes to the trios its sample is in, one hash aggregate per (child, site)."""
    fields, site = fields or FIELDS, site or SITE
    d = genotypes.select("sample_id", "family_id", *site, *fields).join(_roles(pedigree), "sample_id")
    aggs = [F.max(F.when(F.col("role") == r, F.col(f))).alias(f"{r.lower()}_{f}") for r in "CFM" for f in fields]
    seen = F.max(F.when(F.col("role") == "C", 1)).alias("__c")
    return d.groupBy("child_id", "family_id", "sex", "affected", *site).agg(seen, *aggs).where(F.col("__c") == 1).drop("__c")


def trio_codes(genotypes: DataFrame, pedigree: DataFrame, child: Column, parent: Column, site: list[str] | None = None) -> DataFrame:
    """``child_id``, the site and ``c, f, m``: one number of the child's genotype and one of each parent's, NULL where a parent has none.

    Both numbers are of the plain columns of one genotype and are worked out before anything moves, so a trio row is its key and three
    numbers. Use it where counts follow; ``site`` may be whatever names a site."""
    site = site or SITE
    who = _roles(pedigree).select("child_id", "sample_id", "role")
    d = genotypes.select("sample_id", *site, F.struct(child.cast("long").alias("C"), parent.cast("long").alias("P")).alias("__n"))
    d = d.select("sample_id", *site, F.inline(F.array("__n"))).join(who, "sample_id")
    own = F.when(F.col("role") == "C", F.col("C")).otherwise(F.col("P"))
    code = lambda r: F.max(F.when(F.col("role") == r, own)).alias(r.lower())
    there = F.max(F.when(F.col("role") == "C", 1)).alias("__c")
    return d.groupBy("child_id", *site).agg(there, code("C"), code("F"), code("M")).where(F.col("__c") == 1).drop("__c")


def trio_where(genotypes: DataFrame, pedigree: DataFrame, child: Column, parent: Column, fields: list[str] | None = None, site: list[str] | None = None, tested: list[str] | None = None) -> DataFrame:
    """The child's part of those rows of :func:`trio_wide` whose child genotype passes ``child`` and whose two parents' pass ``parent``.

    Both tests are on the plain columns (``tested``) of one genotype, so they run before anything moves; of the parents only the site moves, and trio rows
    are never built. Use it where nothing else of the parents is wanted."""
    fields, site = fields or FIELDS, site or SITE
    kids = complete_trios(pedigree).select(F.col("sample_id").alias("child_id"), "father_id", "mother_id", "sex", "affected")
    read = dict.fromkeys(["sample_id", "family_id", *site, *fields, *(tested or FIELDS)])
    genotypes = genotypes.select(F.inline(F.array(F.struct(*read))))       # one-row generator: the tests do not repeat the arithmetic of the columns
    d = genotypes.where(child).select(F.col("sample_id").alias("child_id"), "family_id", *site, *[F.col(f).alias(f"c_{f}") for f in fields]).join(kids, "child_id")
    names = {c: f"__{i}" for i, c in enumerate(site)}
    for role in ("father_id", "mother_id"):
        ids = kids.select(F.col(role).alias("__p")).distinct()
        ok = genotypes.where(parent).select(F.col("sample_id").alias("__p"), *[F.col(c).alias(n) for c, n in names.items()]).join(ids, "__p", "left_semi")
        on = [F.col(role) == F.col("__p"), *[F.col(c).eqNullSafe(F.col(n)) for c, n in names.items()]]
        d = d.join(ok, on, "left_semi")
    return d.drop("father_id", "mother_id")


def denovo_tests(min_gq: int = 20, min_dp: int = 10, ab: tuple[float, float] = (0.25, 0.75)) -> tuple[Column, Column]:
    """:func:`denovo_predicate` as a test of the child's genotype and one of either parent's, for :func:`trio_where`."""
    ok = g.qc_pass(F.col("gq"), F.col("dp"), min_gq, min_dp)
    bal = g.allele_balance(F.col("ad_ref"), F.col("ad_alt"))
    return (F.col("a1") != F.col("a2")) & bal.between(*ab) & ok, (F.col("a1") == 0) & (F.col("a2") == 0) & (F.col("ad_alt") == 0) & ok


def het(role: str) -> Column:
    return F.col(f"{role}_a1") != F.col(f"{role}_a2")


def hom_ref(role: str) -> Column:
    return (F.col(f"{role}_a1") == 0) & (F.col(f"{role}_a2") == 0)


def carries(role: str) -> Column:
    return F.coalesce((F.col(f"{role}_a1") > 0) | (F.col(f"{role}_a2") > 0), F.lit(False))


def denovo_predicate(min_gq: int = 20, min_dp: int = 10, ab: tuple[float, float] = (0.25, 0.75)) -> Column:
    """Child het in the balance window, both parents hom-ref without an alt read, quality on all three."""
    bal = g.allele_balance(F.col("c_ad_ref"), F.col("c_ad_alt"))
    ok = het("c") & hom_ref("f") & hom_ref("m") & bal.between(*ab) & (F.col("f_ad_alt") == 0) & (F.col("m_ad_alt") == 0)
    for r in "cfm":
        ok = ok & g.qc_pass(F.col(f"{r}_gq"), F.col(f"{r}_dp"), min_gq, min_dp)
    return ok


def vote() -> Column:
    return g.mendel_vote(F.col("c_a1"), F.col("c_a2"), F.array("f_a1", "f_a2"), F.array("m_a1", "m_a2"))


def transmitting_parent() -> Column:
    f, m = carries("f"), carries("m")
    return F.when(f & m, "both").when(f, "father").when(m, "mother").otherwise("none")


def transmission_flags(min_gq: int = 20, min_dp: int = 10) -> dict[str, Column]:
    """T and NT of a meiosis with exactly one het parent, the other hom-ref; a father's non-PAR X is never het."""
    father_het = het("f") & ~(g.is_x(F.col("chrom")) & ~g.in_par(F.col("pos")))
    one = (father_het & hom_ref("m")) | (het("m") & hom_ref("f"))
    ok = one
    for r in "cfm":
        ok = ok & g.qc_pass(F.col(f"{r}_gq"), F.col(f"{r}_dp"), min_gq, min_dp)
    ok = F.coalesce(ok, F.lit(False))
    return {"informative": ok, "t": ok & carries("c"), "nt": ok & ~carries("c"),
            "parent": F.when(father_het, F.lit("father")).otherwise("mother")}
