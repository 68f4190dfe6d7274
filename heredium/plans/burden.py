"""Transmission and burden tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numeric as nm
from ..functions import rules
from ..operators import ranks, trio
from ..storage import cut


def without_seen(rows: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the secondary cohort whose key the primary cohort does not have."""
    return rows.join(seen.select(*keys).distinct(), keys, "left_anti")


def transmission_counts(wide: DataFrame, by: list[str]) -> DataFrame:
    """T and NT per group; every subset row is an ordinary group, the pooled row has NULL group columns."""
    fl = trio.transmission_flags()
    d = wide.withColumns({"parent": fl["parent"], "__t": fl["t"], "__nt": fl["nt"]}).where(fl["informative"])
    return d.groupBy(*by).agg(F.count_if("__t").alias("t"), F.count_if("__nt").alias("nt"))


def with_tests(counts: DataFrame) -> DataFrame:
    """Transmitted fraction and the three two-sided binomial p-values."""
    t, n = F.col("t"), F.col("t") + F.col("nt")
    return counts.withColumns({
        "t_frac": F.when(n > 0, t / n), "p_tail": nm.binom_doubled_tail(t, n),
        "p_minlik": nm.binom_min_likelihood(t, n), "p_normal": nm.binom_normal_cc(t, n)})


def transmission_sets(wide: DataFrame, sets: list[list[str]]) -> DataFrame:
    """T and NT for several groupings in one pass; a column outside a grouping is NULL in its rows."""
    fl = trio.transmission_flags()
    cols = list(dict.fromkeys(c for s in sets for c in s))
    d = wide.withColumns({"parent": fl["parent"], "__t": fl["t"], "__nt": fl["nt"]}).where(fl["informative"])
    # one base aggregate, then the subtotals from it
    base = d.groupBy(*cols).agg(F.count_if("__t").alias("__t"), F.count_if("__nt").alias("__nt"))
    g = base.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in cols])
    return g.agg(F.sum("__t").alias("t"), F.sum("__nt").alias("nt"))


VARIANT_SETS = ("rare", "common", "all")
ARMS = ("t", "nt", "silenced_t", "silenced_nt", "sib_t", "sib_nt")


def expressed_arms(wide: DataFrame, genes: DataFrame, rare: Column) -> DataFrame:
    """Transmission arms of genes that express one parent's allele: one row per gene, tested parent and variant set.

    ``wide``: trio rows with ``symbol`` and ``affected`` (1 proband, 0 sibling, NULL neither); ``genes``: symbol,
    expressed ('Maternal', 'Paternal'; anything else is tested from either parent), s_het, flag (NULL: none).
    ``t`` / ``nt`` count the tested parent to probands, ``silenced_*`` the other parent to probands, ``sib_*`` the
    tested parent to siblings. A gene without meioses has zeros.
    """
    base = transmission_counts(wide.withColumn("rare", F.coalesce(rare, F.lit(False))), ["symbol", "parent", "affected", "rare"])
    base = base.withColumn("variant_set", F.explode(F.array(F.lit("all"), F.when(F.col("rare"), "rare").otherwise("common"))))
    e = F.col("expressed")
    tested = F.when(e == "Maternal", F.array(F.lit("mother"))).when(e == "Paternal", F.array(F.lit("father"))).otherwise(F.array(F.lit("mother"), F.lit("father")))
    rows = genes.withColumn("tested", F.explode(tested)).withColumn("variant_set", F.explode(F.array(*[F.lit(v) for v in VARIANT_SETS])))
    d = rows.join(base, ["symbol", "variant_set"], "left")
    mine, kid = F.col("parent") == F.col("tested"), F.col("affected") == 1
    arms = {"": mine & kid, "silenced_": ~mine & kid, "sib_": mine & ~kid}
    sums = [F.coalesce(F.sum(F.when(c, F.col(x))), F.lit(0)).cast("long").alias(f"{name}{x}") for name, c in arms.items() for x in ("t", "nt")]
    return d.groupBy("symbol", "expressed", "tested", "variant_set", "s_het", "flag").agg(*sums)


def _with_p(d: DataFrame) -> DataFrame:
    """Two-sided binomial p at 1/2; the test is symmetric, so counts that mirror each other have one p."""
    n = F.col("t") + F.col("nt")
    return d.withColumns({"t_frac": F.when(n > 0, F.col("t") / n), "p": nm.binom_min_likelihood(F.greatest("t", "nt"), n)})


def ranked_arms(arms: DataFrame, variant_set: str = "rare") -> DataFrame:
    """Tests of one variant set with at least one meiosis: p, its rank (ties share the first) and the Bonferroni p over all of them."""
    d = cut(_with_p(arms.where((F.col("variant_set") == variant_set) & (F.col("t") + F.col("nt") > 0))))        # a row a gene; ranks and rows come from it
    d = d.withColumn("__p", F.round(F.log("p"), 9) + 0.0)
    order = ranks.distribution(d, ["variant_set"], "__p").select("variant_set", "__p", (F.col("before") + 1).alias("rank"), F.col("total").alias("n_tests"))
    d = d.join(order, ["variant_set", "__p"])
    return d.withColumn("bonferroni_p", F.least(F.lit(1.0), F.col("p") * F.col("n_tests"))).drop("__p")


def collapsed_arms(arms: DataFrame) -> DataFrame:
    """Arms summed over genes by variant set and constraint tier (and all tiers), flagged genes and those tested from either parent left out.

    ``n_genes`` are the genes summed, ``excluded`` the flagged ones by name.
    """
    d = arms.where(F.col("expressed").isin("Maternal", "Paternal"))
    d = d.withColumn("tier", F.explode(F.array(F.lit("all_tiers"), F.concat(F.lit("lof_t"), rules.lof_tier(F.col("s_het")).cast("string")))))
    kept = F.col("flag").isNull()
    sums = [F.coalesce(F.sum(F.when(kept, F.col(a))), F.lit(0)).cast("long").alias(a) for a in ARMS]
    names = F.concat_ws(";", F.array_sort(F.collect_set(F.when(~kept, F.col("symbol")))))
    return _with_p(d.groupBy("variant_set", "tier").agg(F.count_if(kept).alias("n_genes"), names.alias("excluded"), *sums))
