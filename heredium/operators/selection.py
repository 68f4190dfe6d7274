"""Picking rows per key without sorting whole keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def best_per_key(df: DataFrame, keys: list[str], order: list[Column], keep: list[str]) -> DataFrame:
    """One row per key, the first by ``order`` (ascending; negate numbers to prefer large ones). Combines map-side."""
    picked = F.min_by(F.struct(*keep), F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)]))
    return df.groupBy(*keys).agg(picked.alias("__p")).select(*keys, *[F.col(f"__p.{c}").alias(c) for c in keep])


def top_n(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """At most ``n`` rows per key; the limit is applied before the shuffle as well as after it."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n).drop("__rn")


def sample_n(df: DataFrame, keys: list[str], id_cols: list[str], n: int, seed: int) -> DataFrame:
    """A seeded sample of ``n`` rows per key, by md5 text of seed and ids: the same on any partitioning and any engine."""
    return top_n(df, keys, [F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in id_cols])), *[F.col(c) for c in id_cols]], n)


def first_source(sources: list[DataFrame], keys: list[str]) -> DataFrame:
    """Ordered sources: a later one answers only keys no earlier one had. All share one schema, one row per key."""
    ranked = [d.withColumn("source_rank", F.lit(i)) for i, d in enumerate(sources)]
    u = ranked[0]
    for d in ranked[1:]:
        u = u.unionByName(d)
    rest = [c for c in u.columns if c not in keys and c != "source_rank"]
    return best_per_key(u, keys, [F.col("source_rank")], ["source_rank", *rest])


def thin(df: DataFrame, keys: list[str], order: list[str], limit: int) -> DataFrame:
    """Evenly spaced rows when a key has more than ``limit``, always with its last row."""
    w = W.partitionBy(*keys)
    n = F.count("*").over(w)
    rn = F.row_number().over(w.orderBy(*order))
    step = F.when(F.col("__n") > limit, F.floor(F.col("__n") / limit) + 1).otherwise(1)
    d = df.withColumns({"__n": n, "__rn": rn})
    return d.where((F.pmod(F.col("__rn") - 1, step) == 0) | (F.col("__rn") == F.col("__n"))).drop("__n", "__rn")


def pair_neighbours(df: DataFrame, keys: list[str], order: list[Column], id_col: str) -> DataFrame:
    """Adjacent pairing inside a key, each as host and donor; an odd last one takes the first row as donor."""
    w = W.partitionBy(*keys).orderBy(*order)
    d = df.select(*keys, id_col, (F.row_number().over(w) - 1).alias("rn"), F.count("*").over(W.partitionBy(*keys)).alias("n"))
    mate = F.col("rn").bitwiseXOR(1)
    d = d.withColumn("mate", F.when(mate < F.col("n"), mate).otherwise(0))
    donors = d.select(*keys, F.col("rn").alias("mate"), F.col(id_col).alias("donor"))
    return d.where("n > 1").join(donors, [*keys, "mate"]).select(*keys, F.col(id_col).alias("host"), "donor")
