"""Cohort counts that leave a family out, by subtraction instead of self joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ordered import join_null_safe


def leave_one_out(df: DataFrame, item: list[str], family: str, sums: dict[str, Column]) -> DataFrame:
    """Per (item, family): each sum, its total over all families and ``<name>_loo`` without the family."""
    part = df.groupBy(*item, family).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    total = part.groupBy(*item).agg(*[F.sum(n).alias(f"{n}_total") for n in sums])
    return join_null_safe(part, total, item, "inner").withColumns({f"{n}_loo": F.col(f"{n}_total") - F.col(n) for n in sums})


def leave_out_for(queries: DataFrame, df: DataFrame, item: list[str], family: str, sums: dict[str, Column],
                  second_family: str | None = None) -> DataFrame:
    """Counts for query rows (item, family[, second family]) without those families; absent items count 0."""
    part = df.groupBy(*item, family).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    total = part.groupBy(*item).agg(*[F.sum(n).alias(f"__t_{n}") for n in sums])
    own = part.select(*item, family, *[F.col(n).alias(f"__o_{n}") for n in sums])
    out = join_null_safe(join_null_safe(queries, total, item, "left"), own, [*item, family], "left")
    if second_family:
        sec = part.select(*item, F.col(family).alias(second_family), *[F.col(n).alias(f"__s_{n}") for n in sums])
        out = join_null_safe(out, sec, [*item, second_family], "left")
    zero = F.lit(0)
    for n in sums:
        v = F.coalesce(f"__t_{n}", zero) - F.coalesce(f"__o_{n}", zero)
        if second_family:
            differs = F.coalesce(F.col(second_family) != F.col(family), zero.cast("boolean"))
            v = v - F.when(differs, F.coalesce(f"__s_{n}", zero)).otherwise(0)
        out = out.withColumn(f"{n}_loo", v)
    return out.drop(*[f"__{p}_{n}" for n in sums for p in "tos"])


def histogram_percentile(hist: Column, n: Column, q: float) -> Column:
    """Nearest-rank percentile of a sorted ``array<struct<v, c>>`` histogram with ``n`` counts."""
    rank = F.greatest(F.ceil(F.lit(q) * n), F.lit(1))
    start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("long").alias("hit"))
    walk = F.aggregate(hist, start, lambda acc, h: F.struct(
        (acc["seen"] + h["c"]).alias("seen"),
        F.coalesce(acc["hit"], F.when(acc["seen"] + h["c"] >= rank, h["v"])).alias("hit")))
    return walk["hit"]


def leave_one_out_percentile(df: DataFrame, item: list[str], family: str, value: str, q: float, min_all: int,
                             min_rest: int) -> DataFrame:
    """Per (item, family): nearest-rank percentile and maximum of the values of the other families.

    Works on histograms (one entry per distinct value of an item), never on pairs of rows. Where too few values
    remain the percentile and maximum over all families are returned; items below ``min_all`` are dropped.
    """
    cnt = df.groupBy(*item, family, value).agg(F.count("*").alias("c"))
    allv = cnt.groupBy(*item, value).agg(F.sum("c").alias("c"))
    hist = allv.groupBy(*item).agg(
        F.sort_array(F.collect_list(F.struct(F.col(value).cast("long").alias("v"), F.col("c")))).alias("hist"),
        F.sum("c").alias("n"))
    hist = hist.where(F.col("n") >= min_all)
    hist = hist.withColumns({"pct_all": histogram_percentile(F.col("hist"), F.col("n"), q),
                             "max_all": F.element_at("hist", -1)["v"]})
    own = cnt.groupBy(*item, family).agg(
        F.map_from_entries(F.collect_list(F.struct(F.col(value).cast("long"), F.col("c")))).alias("own"), F.sum("c").alias("n_own"))
    d = join_null_safe(own, hist, item, "inner")
    rest = F.filter(F.transform("hist", lambda h: F.struct(
        h["v"].alias("v"), (h["c"] - F.coalesce(F.try_element_at(F.col("own"), h["v"]), F.lit(0))).alias("c"))), lambda h: h["c"] > 0)
    d = d.withColumns({"rest": rest, "n_rest": F.col("n") - F.col("n_own")})
    enough = F.col("n_rest") >= min_rest
    return d.select(
        *item, family, "n", "n_rest", "pct_all", "max_all",
        F.when(enough, histogram_percentile(F.col("rest"), F.col("n_rest"), q)).otherwise(F.col("pct_all")).alias("pct_loo"),
        F.when(enough, F.element_at("rest", -1)["v"]).otherwise(F.col("max_all")).alias("max_loo"))


def leave_one_out_moments(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Adds ``loo_n``, ``loo_mean`` and ``loo_sd`` (sample SD) of the key without the row itself."""
    v = F.col(value)
    s = df.groupBy(*keys).agg(F.count(v).alias("__n"), F.sum(v).alias("__s"), F.sum(v * v).alias("__q"))
    has = v.isNotNull().cast("int")
    n = F.col("__n") - has
    tot, sq = F.col("__s") - F.coalesce(v, F.lit(0.0)), F.col("__q") - F.coalesce(v * v, F.lit(0.0))
    mean = F.when(n > 0, tot / n)
    sd = F.when(n > 1, F.sqrt(F.greatest((sq - tot * tot / n) / (n - 1), F.lit(0.0))))
    return join_null_safe(df, s, keys, "inner").withColumns({"loo_n": n, "loo_mean": mean, "loo_sd": sd}).drop("__n", "__s", "__q")


def robust_z(df: DataFrame, keys: list[str], value: str, floor: float = 0.02) -> DataFrame:
    """Adds ``med``, ``scale`` = max(1.4826 MAD, floor) and ``rz``."""
    med = df.groupBy(*keys).agg(F.median(value).alias("med")) if keys else df.agg(F.median(value).alias("med"))
    d = join_null_safe(df, med, keys, "inner") if keys else df.join(F.broadcast(med))
    dev = F.abs(F.col(value) - F.col("med"))
    mad = (d.groupBy(*keys) if keys else d.groupBy()).agg(F.median(dev).alias("__mad"))
    d = join_null_safe(d, mad, keys, "inner") if keys else d.join(F.broadcast(mad))
    d = d.withColumn("scale", F.greatest(F.col("__mad") * 1.4826, F.lit(floor))).drop("__mad")
    return d.withColumn("rz", (F.col(value) - F.col("med")) / F.col("scale"))


def leave_one_out_linear_percentile(df: DataFrame, keys: list[str], value: str, q: float, is_control: Column, name: str) -> DataFrame:
    """Adds the linear percentile of a key's control values without the row itself (all of them for a non-control).

    Dropping one value from a sorted list shifts the later ones by one place, so three order statistics of the
    key answer every row; nothing is joined row to row.
    """
    d = df.withColumn("__ctl", is_control & F.col(value).isNotNull())
    w = W.partitionBy(*keys)
    c = d.where("__ctl").select(*keys, F.col(value).alias("__v"), F.row_number().over(w.orderBy(value)).alias("__i"), F.count("*").over(w).alias("__n"))

    def order_stats(n: Column, tag: str) -> list[Column]:
        h = (n - 1) * F.lit(q)
        return [F.max(F.when(F.col("__i") == F.floor(h) + 1 + k, F.col("__v"))).alias(f"__{tag}{k}") for k in range(3)]

    s = c.groupBy(*keys).agg(F.max("__n").alias("__n"), *order_stats(F.col("__n") - 1, "l"), *order_stats(F.col("__n"), "a"))
    d = join_null_safe(d, s, keys, "left")

    def interpolate(n: Column, lo: Column, hi: Column) -> Column:
        h = (n - 1) * F.lit(q)
        return lo + (F.coalesce(hi, lo) - lo) * (h - F.floor(h))

    v, n = F.col(value), F.col("__n")
    kept = lambda k: F.when(F.col(f"__l{k}") < v, F.col(f"__l{k}")).otherwise(F.col(f"__l{k + 1}"))
    without = F.when(n > 1, interpolate(n - 1, kept(0), kept(1)))
    out = F.when(F.col("__ctl"), without).otherwise(interpolate(n, F.col("__a0"), F.col("__a1")))
    return d.withColumn(name, out).drop("__ctl", "__n", *[f"__{t}{k}" for t in "la" for k in range(3)])
