"""Methylation signatures: regions, scores, permutation nulls, ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..operators import intervals as iv
from ..operators import ordered, panel, ranks, resampling


def harmonise(cpgs: DataFrame, pad: int = 250, min_regions: int = 20) -> DataFrame:
    """Signature regions from padded CpGs and intervals of all sources.

    ``cpgs``: signature, source, chrom, start, end, direction (+1/-1/NULL), delta. A source votes by the sign of its summed
    directions; tier 1 needs two voting sources that agree and no mixed directions inside; small signatures are DROPPED.
    """
    d = cpgs.withColumns({"__s": F.greatest(F.col("start") - pad, F.lit(0)), "__e": F.col("end") + pad})
    m = iv.merge(d, ("signature", "chrom"), "__s", "__e", 0, {"n_rows": F.count("*")}).select("signature", "chrom", F.col("__s").alias("b_start"), F.col("__e").alias("b_end"), "n_rows")
    hit = iv.point_join(d, m, "__s", keys=("signature", "chrom"))
    region = ["signature", "chrom", "b_start", "b_end", "n_rows"]
    src = hit.groupBy(*region, "source").agg(F.sum("direction").alias("v"), F.min("direction").alias("lo"), F.max("direction").alias("hi"), F.sum("delta").alias("ds"), F.count("delta").alias("dn"))
    vote = F.signum(F.coalesce("v", F.lit(0)))
    g = src.groupBy(*region).agg(F.concat_ws(",", F.array_sort(F.collect_set("source"))).alias("sources"), F.count_if(vote != 0).alias("n_sources"),
                                 F.min(F.when(vote != 0, vote)).alias("__a"), F.max(F.when(vote != 0, vote)).alias("__b"), F.min("lo").alias("__lo"), F.max("hi").alias("__hi"),
                                 F.sum("v").alias("__v"), F.sum("ds").alias("__ds"), F.sum("dn").alias("__dn"))
    conflict = F.coalesce(F.col("__lo") != F.col("__hi"), F.lit(False))
    net = F.signum(F.coalesce("__v", F.lit(0)))
    agree = (F.col("n_sources") > 0) & (F.col("__a") == F.col("__b"))
    n = g.groupBy("signature").agg(F.count("*").alias("n_regions"))
    g = g.join(n, "signature")
    return g.select("signature", "chrom", F.col("b_start").alias("start"), F.col("b_end").alias("end"), "sources", "n_sources",
                    F.when(net > 0, "+").when(net < 0, "-").otherwise(".").alias("direction"), F.when(F.col("__dn") > 0, F.col("__ds") / F.col("__dn")).alias("delta"),
                    F.when(F.coalesce(agree, F.lit(False)) & (F.col("n_sources") >= 2) & ~conflict, 1).otherwise(2).alias("tier"), conflict.cast("int").alias("conflict"),
                    F.when(F.col("n_regions") >= min_regions, "OK").otherwise("DROPPED").alias("status"))


def loo_regions(region_values: DataFrame, is_control: Column) -> DataFrame:
    """Region values with mean, SD and 5th percentile of the controls, always without the scored sample."""
    d = region_values.withColumn("ctl", is_control).withColumn("cv", F.when(F.col("ctl"), F.col("b")))
    s = d.groupBy("region_id").agg(F.count("cv").alias("__n"), F.sum("cv").alias("__s"), F.sum(F.col("cv") * F.col("cv")).alias("__q"))
    own, has = F.coalesce("cv", F.lit(0.0)), F.col("cv").isNotNull().cast("int")
    d = ordered.join_null_safe(d, s, ["region_id"], "inner")
    n, tot, sq = F.col("__n") - has, F.col("__s") - own, F.col("__q") - own * own
    d = d.withColumns({"mu": F.when(n > 0, tot / n), "sd": F.when(n > 1, F.sqrt(F.greatest((sq - tot * tot / n) / (n - 1), F.lit(0.0))))})
    d = d.drop("__n", "__s", "__q", "cv")
    return panel.leave_one_out_linear_percentile(d, ["region_id"], "b", 0.05, F.col("ctl"), "p5").drop("ctl")


def score_sets(values: DataFrame, sets: DataFrame, min_regions: int = 5, by: list[str] | None = None) -> DataFrame:
    """mean_z, shape_r, frac_below_p5 and na_frac per sample and set from :func:`loo_regions` rows.

    ``sets``: set_id (plus ``by``), region_id, target (published delta or its sign). One aggregate; no matrix exists.
    """
    keys = ["sample_id", "set_id", *(by or [])]
    d = values.join(sets, "region_id")
    ok = F.col("b").isNotNull() & F.col("mu").isNotNull() & (F.col("sd") > 0)
    delta = F.when(ok, F.col("b") - F.col("mu"))
    d = d.withColumns({"__d": delta, "__z": delta / F.col("sd"), "__t": F.when(ok, F.col("target"))})
    g = d.groupBy(*keys).agg(F.count("__z").alias("n_used"), F.avg("b").alias("__ab"), F.avg(F.col("b").isNull().cast("double")).alias("na_frac"), F.avg("__z").alias("__mz"),
                             F.when((F.stddev_pop("__t") > 0) & (F.stddev_pop("__d") > 0), F.corr("__d", "__t")).alias("__r"), F.avg(F.when(ok & F.col("p5").isNotNull(), (F.col("b") < F.col("p5")).cast("double"))).alias("__f"))
    enough = F.col("n_used") >= min_regions
    return g.select(*keys, "n_used", "na_frac", F.when(enough, F.col("__mz")).alias("mean_z"), F.when(enough, F.col("__r")).alias("shape_r"), F.when(enough, F.col("__f")).alias("frac_below_p5"))


def match_bins(regions: DataFrame, pool: DataFrame, by: dict[str, int]) -> tuple[DataFrame, DataFrame]:
    """Both tables with ``bin``: joint bins of the ``by`` columns at the pool's quantiles (column -> number of bins)."""
    edges = None
    for c, n in by.items():
        e = ranks.linear_percentile(pool.select(F.lit(0).alias("__k"), c), ["__k"], c, {f"q{i}": i / n for i in range(1, n)})
        e = e.select("__k", F.array_distinct(F.array(*[f"q{i}" for i in range(1, n)])).alias(f"__e_{c}"))
        edges = e if edges is None else edges.join(e, "__k")
    edges = F.broadcast(edges.drop("__k"))                         # one row of quantiles

    def binned(d: DataFrame) -> DataFrame:
        at = None
        for c in by:
            i = F.size(F.filter(f"__e_{c}", lambda x: x < F.col(c)))
            at = i if at is None else at * 100 + i
        return d.crossJoin(edges).withColumn("bin", at.cast("int")).drop(*[f"__e_{c}" for c in by])

    return binned(regions), binned(pool)


def matched_draws(regions: DataFrame, pool: DataFrame, n_perm: int, seed: int) -> DataFrame:
    """Bin-matched random sets: each region of each replicate takes a pool region of its bin, of the whole pool where its bin is empty.

    ``regions``: set_id, region_id, target, bin. ``pool``: region_id, bin. The pool is numbered inside its bin and as a whole; a draw is a
    place computed from md5 text, so every draw is one equality join. ``set_id, rep, region_id, target`` comes out."""
    every = pool.select("bin", F.col("region_id").alias("drawn")).unionByName(pool.select(F.lit(-1).alias("bin"), F.col("region_id").alias("drawn")))
    p = resampling.numbered(every, ["bin"], "drawn")
    sizes = every.groupBy("bin").agg(F.count("*").alias("size"))
    d = regions.join(sizes.select("bin", F.lit(1).alias("__has")), "bin", "left")
    d = d.withColumn("bin", F.when(F.col("__has") == 1, F.col("bin")).otherwise(-1)).join(sizes, "bin")
    d = d.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(n_perm))))
    d = d.withColumn("at", resampling.md5_int(F.lit(seed), "set_id", "region_id", "rep") % F.col("size"))
    return d.join(p, ["bin", "at"]).select("set_id", "rep", F.col("drawn").alias("region_id"), "target")


def composition_clean(values: DataFrame, fractions: DataFrame, is_control: Column, limit: float = 0.5, least: int = 8) -> DataFrame:
    """``region_id`` of the regions whose control values do not follow a cell fraction: correlation within the limit, or too few values to say."""
    d = values.where(is_control & F.col("b").isNotNull()).join(fractions.where(F.col("fraction").isNotNull()), "sample_id")
    g = d.groupBy("region_id").agg(F.count("*").alias("n"), F.stddev_pop("b").alias("sb"), F.stddev_pop("fraction").alias("sf"), F.corr("b", "fraction").alias("r"))
    drop = g.where((F.col("n") >= least) & (F.col("sb") > 0) & (F.col("sf") > 0) & (F.abs("r") > limit)).select("region_id")
    return values.select("region_id").distinct().join(drop, "region_id", "left_anti")


def quantile_bins(df: DataFrame, value: str, n: int, name: str) -> DataFrame:
    """Bins at the n-quantiles of a region table by exact ranks."""
    r = ranks.distribution(df, [], value).select(value, F.least(F.floor(F.col("before") * n / F.col("total")), F.lit(n - 1)).alias(name))
    return ordered.join_null_safe(df, r, [value], "left")


def sample_outliers(df: DataFrame, checks: dict[str, float], max_na: float) -> DataFrame:
    """Robust z of each measure and the reasons a sample stands out."""
    d = df
    for c in checks:
        d = panel.robust_z(d, [], c, 1e-9).withColumnRenamed("rz", f"z_{c}").drop("med", "scale")
    why = rules.flags(**{f"outlier_{c}": F.abs(F.col(f"z_{c}")) > lim for c, lim in checks.items()}, missing=F.col("na_frac") > max_na)
    return d.withColumn("reasons", F.concat_ws(";", why)).withColumn("qc_outlier", (F.col("reasons") != "").cast("int"))


def panel_report(scores: DataFrame, expected: DataFrame, top_pct: float = 0.05) -> DataFrame:
    """Rank of each expected sample on its signature; hit when it ranks in the top share in the expected direction."""
    r = ranks.rank_desc(scores.where("mean_z IS NOT NULL"), ["set_id"], "mean_z").select("set_id", "mean_z", "rank", "pct", "total")
    d = expected.join(scores, ["sample_id", "set_id"]).join(r, ["set_id", "mean_z"])
    pct = F.when(F.col("sign") > 0, F.col("pct")).otherwise(1 - F.col("pct"))
    return d.withColumn("observed", F.when(pct <= top_pct, "hit").otherwise("miss"))


def anonymise(df: DataFrame, id_map: DataFrame, id_col: str = "sample_id") -> DataFrame:
    """Rows under study ids; a sample without one is dropped, so no original id can pass."""
    return df.join(id_map, id_col).drop(id_col).withColumnRenamed("study_id", id_col)


def na_by_threshold(region_values: DataFrame, min_cpgs: list[int]) -> DataFrame:
    """Share of region values that would be NULL at each CpG floor."""
    t = F.explode(F.array(*[F.lit(k) for k in min_cpgs]))
    return region_values.select(t.alias("min_cpgs"), "n_cpg").groupBy("min_cpgs").agg(F.avg((F.col("n_cpg") < F.col("min_cpgs")).cast("double")).alias("na_frac"))
