"""Loss-of-function and missense tiers and per-sample counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import genotype as g
from ..functions import rules


def tier_sites(sites: DataFrame, max_af: float | None = None) -> DataFrame:
    """Loss-of-function sites with their constraint tier; an unknown frequency passes, an unknown s_het is tier 3."""
    d = sites.where(rules.consequence_class(F.col("consequence")) == "lof")
    if max_af is not None:
        d = d.where(g.rare(F.col("gnomad_af"), max_af))
    return d.withColumn("tier", rules.lof_tier(F.col("s_het")))


def counts_per_sample(genotypes: DataFrame, tiers: DataFrame, key: list[str], n_tiers: int = 3) -> DataFrame:
    """Carried sites per tier and sample; low-quality genotypes are skipped."""
    ok = g.qc_pass(F.col("gq"), F.col("dp")) & (F.col("a1") + F.col("a2") > 0)
    d = genotypes.where(ok).select("sample_id", *key).join(tiers.select(*key, "tier"), key)
    return d.groupBy("sample_id").agg(*[F.count_if(F.col("tier") == i).alias(f"tier{i}") for i in range(1, n_tiers + 1)])


def denovo_tiers(calls: DataFrame, sites: DataFrame, key: list[str], max_af: float, passed: list | None = None) -> DataFrame:
    """Final tier of each rare de novo call: constraint for loss of function, passed scores for missense.

    ``passed`` are the score tests (see :func:`rules.missense_passed`); by default four cuts of the constraint score.
    """
    s = F.col("s_het")
    cls = rules.consequence_class(F.col("consequence"))
    mis = rules.missense_tier(*(passed or [s > 0.05, s > 0.1, s > 0.2, s > 0.3]))
    tier = F.when(cls == "lof", F.concat(F.lit("LoF_"), rules.lof_tier(s))).when(cls == "missense", F.concat(F.lit("missense_"), mis)).otherwise("other")
    d = sites.where(g.rare(F.col("gnomad_af"), max_af)).select(*key, "symbol", tier.alias("tier"))
    return calls.join(d, key)
