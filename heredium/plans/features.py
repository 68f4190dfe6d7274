"""A registry of candidate features: each has a source, a formula, the classes it applies to and whether it may train a model.

The registry compiles into one projection of the evidence rows, whatever number of features is asked, and one aggregate
reports which of them carry something. A feature whose source columns a table lacks is left out and reported.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SMALL, ALL = ("SNV", "INDEL"), ("SNV", "INDEL", "SV", "TR")
# Pseudo-autosomal regions of chrX, GRCh38, both ends inside.
PAR = ((10001, 2781479), (155701383, 156030895))


@dataclass(frozen=True)
class Feature:
    name: str
    source: str                      # caller, payload, evidence or annotation
    needs: tuple[str, ...]
    classes: tuple[str, ...]
    safe: bool                       # available to both labels alike, so it may train a model
    formula: Callable[[], Column]


REGISTRY: dict[str, Feature] = {}


def _add(name: str, source: str, needs: tuple[str, ...], formula: Callable[[], Column], classes: tuple[str, ...] = ALL, safe: bool = True) -> None:
    REGISTRY[name] = Feature(name, source, needs, classes, safe, formula)


def _c(name: str) -> Column:
    return F.col(name)


def _allele() -> Column:
    """Index of the candidate's allele in AD; 1 beyond small variants."""
    return F.when(_c("variant_class").isin(*SMALL), F.coalesce(F.get_json_object("payload", "$.allele_index").cast("int"), F.lit(1))).otherwise(1)


def _ratio(ad: str) -> Column:
    return _c(ad)[0] / (F.get(ad, _allele()) + 1)


def _both(f: Callable[[Column, Column], Column], a: Column, b: Column) -> Column:
    """The smaller or larger of two values; NULLs do not count."""
    return f(a, b)


def _pl(pl: str, genotype: int) -> Column:
    """PL of 0/0, 0/a or a/a; NULL for all three where the list is too short."""
    a = _allele()
    het = F.floor(a * (a + 1) / 2).cast("int")
    at = (F.lit(0), het, het + a)[genotype]
    return F.when(F.size(pl) > het + a, F.get(pl, at))


def _payload(key: str, kind: str = "string") -> Column:
    return F.get_json_object("payload", f"$.{key}").cast(kind)


def _list(key: str) -> Column:
    return F.from_json(F.get_json_object("payload", f"$.{key}"), "array<bigint>")


def _own() -> Column:
    return F.coalesce(_payload("outlier_allele_idx", "int"), F.lit(0))


for _n, _f in (("min", F.least), ("max", F.greatest)):
    _add(f"{_n}_AR", "caller", ("father_ad", "mother_ad"), lambda f=_f: _both(f, _ratio("father_ad"), _ratio("mother_ad")), SMALL)
    _add(f"{_n}_GQ", "caller", ("father_gq", "mother_gq"), lambda f=_f: _both(f, _c("father_gq"), _c("mother_gq")))
    _add(f"{_n}_DP", "caller", ("father_dp", "mother_dp"), lambda f=_f: _both(f, _c("father_dp"), _c("mother_dp")))
    for _i in range(3):
        _add(f"{_n}_PL{_i}", "caller", ("father_pl", "mother_pl"), lambda f=_f, i=_i: _both(f, _pl("father_pl", i), _pl("mother_pl", i)), SMALL)
_add("child_AR", "caller", ("child_ad",), lambda: _ratio("child_ad"), SMALL)
_add("child_GQ", "caller", ("caller_gq",), lambda: _c("caller_gq"))
_add("child_DP", "caller", ("caller_dp",), lambda: _c("caller_dp"))
for _i in range(3):
    _add(f"child_PL{_i}", "caller", ("child_pl",), lambda i=_i: _pl("child_pl", i), SMALL)
_add("child_AB", "caller", ("child_ad",), lambda: F.when(_c("child_ad")[0] + F.get("child_ad", _allele()) > 0, F.get("child_ad", _allele()) / (_c("child_ad")[0] + F.get("child_ad", _allele()))), SMALL)
_add("indel_flag", "caller", (), lambda: (_c("variant_class") == "INDEL").cast("int"), SMALL)
_add("haploid_flag", "caller", ("chrom", "start", "sex"), lambda: F.coalesce((_c("sex") == "M") & (_c("chrom").isin("chrY", "Y") | (_c("chrom").isin("chrX", "X") & ~(_c("start").between(*PAR[0]) | _c("start").between(*PAR[1])))), F.lit(False)).cast("int"))
_add("qd_child", "caller", ("child_pl", "caller_gq", "caller_dp", "c_dp_hapA", "c_dp_hapO"), lambda: F.round(_numerator() / _denominator(), 4))
_add("site_filter_fail", "caller", ("caller_filter",), lambda: (~F.coalesce("caller_filter", F.lit("")).isin(".", "PASS", "")).cast("int"), safe=False)
_add("multiallelic", "payload", ("payload",), lambda: (F.coalesce(_payload("n_alts", "int"), F.lit(1)) > 1).cast("int"), SMALL)
_add("indel_len", "caller", ("ref", "alt"), lambda: F.abs(F.length("ref") - F.length("alt")), ("INDEL",))
_add("svlen_log10", "payload", ("payload",), lambda: F.round(F.log10(F.when(_payload("svlen", "long") != 0, F.abs(_payload("svlen", "long")))), 3), ("SV",))
_add("bp_homology_len", "payload", ("payload",), lambda: _payload("homlen", "long"), ("SV",))
_add("child_sv_support", "caller", ("child_ad",), lambda: F.get("child_ad", F.lit(1)), ("SV",))
_add("max_parent_sv_support", "caller", ("father_ad", "mother_ad"), lambda: _both(F.greatest, F.get("father_ad", F.lit(1)), F.get("mother_ad", F.lit(1))), ("SV",))
_add("child_AL_expanded", "payload", ("payload",), lambda: F.get(_list("child_al"), _own()), ("TR",))
_add("child_AL_other", "payload", ("payload",), lambda: F.array_min(F.filter(_list("child_al"), lambda x, i: i != _own())), ("TR",))
_add("delta_motif_units_nearest_parent", "payload", ("payload",), lambda: _payload("delta_units", "double"), ("TR",))
_add("motif_len", "payload", ("payload",), lambda: _payload("motif_unit_bp", "int"), ("TR",))
_add("n_motifs", "payload", ("payload",), lambda: F.when(_payload("motifs") != "", F.size(F.split(_payload("motifs"), ","))), ("TR",))
_add("locus_len_ref", "caller", ("start", "end"), lambda: _c("end") - _c("start") + 1, ("TR",))
for _n in ("c_alt_hap_frac", "c_alt_confined", "c_alt_tagged_frac", "p_min_hap_dp", "p_max_alt_any_hap", "p_n_haps_with_alt", "p_max_alt_hap_frac", "hap_obs_k3", "hap_obs_k5"):
    _add(_n, "evidence", (_n,), lambda n=_n: _c(n))
for _n in ("gnomad_af", "cohort_ac_loo"):
    _add(_n, "annotation", (_n,), lambda n=_n: _c(n), safe=False)


def _numerator() -> Column:
    """Evidence against the reference on the child's own scale: PL of 0/0, else GQ."""
    return F.coalesce(_pl("child_pl", 0).cast("double"), _c("caller_gq").cast("double"))


def _denominator() -> Column:
    """Readable depth on the child's haplotypes, else the caller's depth; never 0."""
    seen = F.coalesce(_c("c_dp_hapA"), F.lit(0)) + F.coalesce(_c("c_dp_hapO"), F.lit(0))
    d = F.when(seen > 0, seen.cast("double")).otherwise(_c("caller_dp").cast("double"))
    return F.when(d > 0, d)


def chosen(classes: list[str] | None = None, safe_only: bool = False) -> list[Feature]:
    return [f for f in REGISTRY.values() if (not safe_only or f.safe) and (classes is None or set(f.classes) & set(classes))]


def matrix(rows: DataFrame, id_cols: list[str], classes: list[str] | None = None, safe_only: bool = False) -> DataFrame:
    """``id_cols, variant_class`` and the asked features the table can give, NULL outside a feature's classes. One projection."""
    have = set(rows.columns)
    cols = []
    for f in chosen(classes, safe_only):
        if set(f.needs) <= have:
            value = f.formula()
            cols.append((value if set(f.classes) == set(ALL) else F.when(F.col("variant_class").isin(*f.classes), value)).alias(f.name))
    return rows.select(*id_cols, "variant_class", *cols)


def report(table: DataFrame, classes: list[str] | None = None, safe_only: bool = False) -> DataFrame:
    """``feature, source, n, status``: produced, constant (one value) or never_produced, for every asked feature, from one aggregate."""
    asked = chosen(classes, safe_only)
    have = [f for f in asked if f.name in table.columns]
    one = table.agg(F.count("*").alias("__rows"), *[F.struct(F.count(f.name).alias("n"), F.min(F.col(f.name).cast("string")).alias("lo"), F.max(F.col(f.name).cast("string")).alias("hi")).alias(f.name) for f in have])
    none = F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("string").alias("lo"), F.lit(None).cast("string").alias("hi"))
    cells = [F.struct(F.lit(f.name).alias("feature"), F.lit(f.source).alias("source"), (F.col(f.name) if f in have else none).alias("s")) for f in asked]
    d = one.select(F.explode(F.array(*cells)).alias("r")).select("r.feature", "r.source", F.col("r.s.n").alias("n"), F.col("r.s.lo").alias("lo"), F.col("r.s.hi").alias("hi"))
    status = F.when(F.col("n") == 0, "never_produced").when(F.col("lo") == F.col("hi"), "constant").otherwise("produced")
    return d.select("feature", "source", "n", status.alias("status"))


def assert_safe(columns: list[str]) -> None:
    """Raises when a column is unknown or must not train a model."""
    bad = [c for c in columns if c not in REGISTRY or not REGISTRY[c].safe]
    if bad:
        raise ValueError(f"not for training: {bad}")
