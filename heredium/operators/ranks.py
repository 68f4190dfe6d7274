"""Ranks, cumulative curves and rank tests from one ordered distribution per key.

Everything here is read off a table with one row per distinct (key, value):
how many rows have it, how many come before it, how many there are. Ties cost
nothing, and the order is cut into value bins so that no key is one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import normal_two_sided
from .ordered import join_null_safe, scan, scans, value_bin


def distribution(df: DataFrame, keys: list[str], value: str, sums: dict[str, Column] | None = None,
                 descending: bool = False, weight: str | None = None) -> DataFrame:
    """Per distinct non-null value: ``cnt``, ``before`` (rows strictly earlier), ``total`` and for each of ``sums``
    its own sum and ``<name>_before``, ``<name>_total``. A NULL key is a key like any other. A row counts ``weight`` times."""
    return _binned(df, keys, value, sums, descending, weight).drop("__bin", "__neg", "__all")


def _binned(df: DataFrame, keys: list[str], value: str, sums: dict[str, Column] | None = None, descending: bool = False, weight: str | None = None) -> DataFrame:
    """The distribution with the bins it was made in (``__bin``) and, without keys, a constant one (``__all``)."""
    sums = sums or {}
    k = list(keys) or ["__all"]
    d = df.where(F.col(value).isNotNull())
    if not keys:
        d = d.withColumn("__all", F.lit(0))
    d = d.groupBy(*k, value).agg((F.sum(weight) if weight else F.count("*")).alias("cnt"), *[F.sum(c).alias(n) for n, c in sums.items()])
    d = value_bin(d, value, "__bin")
    o = value
    if descending:
        o = "__neg"
        d = d.withColumns({"__neg": -F.col(value), "__bin": -F.col("__bin")})
    before = {"before": (F.col("cnt"), "sum"), **{f"{n}_before": (F.col(n), "sum") for n in sums}}
    return scans(d, k, "__bin", [o], before, inclusive=False, totals={"before": "total", **{f"{n}_before": f"{n}_total" for n in sums}})


def rank_desc(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Distinct values with ``rank`` (ties take the minimum, largest first) and ``pct`` = (rank-1)/(n-1)."""
    d = distribution(df, keys, value, descending=True)
    return d.withColumns({"rank": F.col("before") + 1, "pct": F.when(F.col("total") > 1, F.col("before") / (F.col("total") - 1))})


def average_rank(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Distinct values with the mean rank of their ties, smallest first."""
    return distribution(df, keys, value).withColumn("avg_rank", F.col("before") + (F.col("cnt") + 1) / 2)


def empirical_quantile(df: DataFrame, reference: DataFrame, keys: list[str], value: str, name: str = "q") -> DataFrame:
    """Adds the fraction of the key's reference values strictly below each row's value."""
    u = df.select(*keys, value).distinct().withColumn("__r", F.lit(0)).unionByName(
        reference.select(*keys, value).withColumn("__r", F.lit(1)))
    d = distribution(u, keys, value, {"__nr": F.col("__r")})
    q = d.select(*keys, value, F.when(F.col("__nr_total") > 0, F.col("__nr_before") / F.col("__nr_total")).alias(name))
    return join_null_safe(df, q, [*keys, value], "left")


def benjamini_hochberg(df: DataFrame, keys: list[str], p: str) -> DataFrame:
    """Distinct p-values with the step-up ``q``: the smallest p*m/rank over this and larger p-values, at most 1."""
    raw = F.col(p) * F.col("total") / (F.col("before") + F.col("cnt"))
    d = _binned(df, keys, p).withColumns({"__neg": -F.col(p), "__bin": -F.col("__bin"), "__raw": raw})
    d = scan(d, list(keys) or ["__all"], "__bin", ["__neg"], -F.col("__raw"), "__m", "max")
    return d.withColumn("q", F.least(F.lit(1.0), -F.col("__m"))).drop("__raw", "__m", "__bin", "__neg", "__all")


def precision_recall(df: DataFrame, keys: list[str], score: str, label: str) -> DataFrame:
    """Per distinct score, highest first: cumulative positives, calls, precision, recall and false-positive rate."""
    d = distribution(df, keys, score, {"pos": F.col(label).cast("long")}, descending=True)
    tp, n = F.col("pos_before") + F.col("pos"), F.col("before") + F.col("cnt")
    neg = F.col("total") - F.col("pos_total")
    return d.withColumns({"tp": tp, "n_called": n, "precision": tp / n, "recall": F.when(F.col("pos_total") > 0, tp / F.col("pos_total")),
                          "fpr": F.when(neg > 0, (n - tp) / neg)})


def auc(df: DataFrame, keys: list[str], score: str, label: str, weight: str | None = None) -> DataFrame:
    """ROC-AUC by ranks (ties count half), average precision over distinct scores, Brier score when scores are in [0,1]. A row counts ``weight`` times."""
    pos = F.col(label).cast("long") * (F.col(weight) if weight else F.lit(1))
    d = distribution(df, keys, score, {"pos": pos}, descending=True, weight=weight)
    neg, neg_total = F.col("cnt") - F.col("pos"), F.col("total") - F.col("pos_total")
    neg_before = F.col("before") - F.col("pos_before")
    wins = F.col("pos") * (neg_total - neg_before - neg) + F.col("pos") * neg / 2
    ap = F.col("pos") * (F.col("pos_before") + F.col("pos")) / (F.col("before") + F.col("cnt"))
    sq = F.col("pos") * F.pow(1 - F.col(score), 2) + neg * F.pow(F.col(score), 2)
    g = d.groupBy(*keys).agg(F.sum(wins).alias("w"), F.sum(ap).alias("a"), F.sum(sq).alias("b"), F.sum("cnt").alias("n"),
                             F.sum("pos").alias("n_pos"))
    n_neg = F.col("n") - F.col("n_pos")
    return g.select(*keys, "n", "n_pos",
                    F.when((F.col("n_pos") > 0) & (n_neg > 0), F.col("w") / (F.col("n_pos") * n_neg)).alias("roc_auc"),
                    F.when(F.col("n_pos") > 0, F.col("a") / F.col("n_pos")).alias("pr_auc"), (F.col("b") / F.col("n")).alias("brier"))


def mann_whitney(df: DataFrame, keys: list[str], value: str, group: Column) -> DataFrame:
    """U of the rows where ``group`` is 1, tie-corrected z and two-sided normal p."""
    d = distribution(df, keys, value, {"g": group.cast("long")})
    r = F.col("g") * (F.col("before") + (F.col("cnt") + 1) / 2)
    g = d.groupBy(*keys).agg(F.sum(r).alias("r"), F.sum("g").alias("n1"), F.sum("cnt").alias("n"),
                             F.sum(F.pow(F.col("cnt"), 3) - F.col("cnt")).alias("ties"))
    n1, n = F.col("n1"), F.col("n")
    n2 = n - n1
    u = F.col("r") - n1 * (n1 + 1) / 2
    var = n1 * n2 / 12 * ((n + 1) - F.col("ties") / (n * (n - 1)))
    z = F.when(var > 0, (u - n1 * n2 / 2) / F.sqrt(var))
    return g.select(*keys, "n1", n2.alias("n2"), u.alias("u"), z.alias("z"), normal_two_sided(z).alias("p"))


def spearman(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Rank correlation over rows where both values are present."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*keys, x, y).agg(F.count("*").alias("__c"))
    d = both
    for v, name in ((x, "__rx"), (y, "__ry")):             # ranks meet distinct pairs, so a value many rows share is a few rows
        u = both.groupBy(*keys, v).agg(F.sum("__c").alias("__w"))
        r = distribution(u, keys, v, {"__k": F.col("__w")})
        r = r.select(*keys, v, (F.col("__k_before") + (F.col("__k") + 1) / 2 - (F.col("__k_total") + 1) / 2).alias(name))
        d = join_null_safe(d, r, [*keys, v], "inner")
    c = F.col("__c")
    s = {n: F.sum(c * F.col(a) * F.col(b)) for n, a, b in (("xy", "__rx", "__ry"), ("xx", "__rx", "__rx"), ("yy", "__ry", "__ry"))}
    return d.groupBy(*keys).agg(F.sum(c).alias("n"), F.when((s["xx"] > 0) & (s["yy"] > 0), s["xy"] / F.sqrt(s["xx"] * s["yy"])).alias("rho"))


def index_percentile(df: DataFrame, keys: list[str], value: str, quantiles: dict[str, float], rule: str) -> DataFrame:
    """Percentiles by row index: ``floor_index`` takes sorted[int(q*n)] (zero-based), ``nearest_rank`` sorted[ceil(q*n)-1]."""
    d = distribution(df, keys, value)

    def at(q: float) -> Column:
        if rule == "floor_index":
            return F.least(F.floor(F.lit(q) * F.col("total")), F.col("total") - 1)
        return F.greatest(F.ceil(F.lit(q) * F.col("total")) - 1, F.lit(0))

    hit = lambda q: (F.col("before") <= at(q)) & (at(q) < F.col("before") + F.col("cnt"))
    return d.groupBy(*keys).agg(F.sum("cnt").alias("n"), *[F.max(F.when(hit(q), F.col(value))).alias(n) for n, q in quantiles.items()])


def linear_percentile(df: DataFrame, keys: list[str], value: str, quantiles: dict[str, float]) -> DataFrame:
    """Linearly interpolated percentiles, exact, from the ordered distribution."""
    d = distribution(df, keys, value)

    def at(index: Column) -> Column:
        return F.max(F.when((F.col("before") <= index) & (index < F.col("before") + F.col("cnt")), F.col(value)))

    aggs = []
    for n, q in quantiles.items():
        h = (F.col("total") - 1) * F.lit(q)
        aggs += [at(F.floor(h)).alias(f"__lo_{n}"), at(F.ceil(h)).alias(f"__hi_{n}"), F.max(h - F.floor(h)).alias(f"__f_{n}")]
    g = d.groupBy(*keys).agg(*aggs)
    return g.select(*keys, *[(F.col(f"__lo_{n}") + (F.col(f"__hi_{n}") - F.col(f"__lo_{n}")) * F.col(f"__f_{n}")).alias(n) for n in quantiles])
