"""Phenotype coverage, comparisons and syndrome scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def coverage(df: DataFrame, keys: list[str], valid: Column, positive: Column) -> DataFrame:
    """Rows, valid answers, their share and the positive fraction among valid answers."""
    return df.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count(valid).alias("n_valid"), (F.count(valid) / F.count("*")).alias("coverage"),
        F.avg(F.when(valid.isNotNull(), positive.cast("double"))).alias("frac_positive"))


def own_rank(scores: DataFrame) -> DataFrame:
    """Rank of each carrier on its own syndrome among everyone scored on it, and p = share scoring at least as high.

    ``scores`` has subject_id, own, syndrome, score.
    """
    from ..operators import ranks

    r = ranks.rank_desc(scores, ["syndrome"], "score").withColumn("p", (F.col("before") + F.col("cnt")) / F.col("total"))
    return scores.where(F.col("own") == F.col("syndrome")).join(r, ["syndrome", "score"])


def compare_numeric(df: DataFrame, keys: list[str], value: str, carrier: Column) -> DataFrame:
    """Rank test of carriers against the rest with index-rule medians of both groups."""
    from ..operators import ranks

    d = df.withColumn("__c", carrier.cast("int"))
    mw = ranks.mann_whitney(d, keys, value, F.col("__c"))
    med = ranks.index_percentile(d, [*keys, "__c"], value, {"m": 0.5}, "floor_index").groupBy(*keys).agg(
        F.max(F.when(F.col("__c") == 1, F.col("m"))).alias("median_carrier"), F.max(F.when(F.col("__c") == 0, F.col("m"))).alias("median_other"))
    return mw.join(med, keys)


def compare_categorical(df: DataFrame, keys: list[str], positive: Column, carrier: Column) -> DataFrame:
    """2x2 counts and Fisher's exact p per key, unknown answers left out."""
    from ..functions.numeric import fisher_two_sided

    d = df.where(positive.isNotNull() & carrier.isNotNull())
    g = d.groupBy(*keys).agg(F.count_if(carrier & positive).alias("a"), F.count_if(carrier & ~positive).alias("b"), F.count_if(~carrier & positive).alias("c"), F.count_if(~carrier & ~positive).alias("d"))
    return g.withColumn("p", fisher_two_sided(*[F.col(x) for x in "abcd"]))


def syndrome_scores(features: DataFrame, definition: DataFrame) -> DataFrame:
    """Subject by syndrome score: weighted present features over the weights that could be judged (unknown is not absent).

    ``features``: subject_id, feature, state. ``definition``: syndrome, feature, weight.
    """
    d = features.where("state <> 'unknown'").join(definition, "feature")
    g = d.groupBy("subject_id", "syndrome").agg(F.sum(F.when(F.col("state") == "present", F.col("weight")).otherwise(0)).alias("hit"), F.sum("weight").alias("judged"), F.count("*").alias("n_known"))
    return g.withColumn("score", F.when(F.col("judged") > 0, F.col("hit") / F.col("judged")))


def specificity(features: DataFrame, definition: DataFrame) -> DataFrame:
    """How common each defining feature is among everyone with an answer."""
    d = features.where("state <> 'unknown'").join(definition, "feature")
    return d.groupBy("syndrome", "feature").agg(F.count("*").alias("n_known"), F.avg((F.col("state") == "present").cast("double")).alias("frac_present"))


def origin_age_fits(calls: DataFrame, ages: DataFrame, sources: list[str]) -> DataFrame:
    """Correlation and slope (calls a year) of de novo counts on parental ages, calls split by each source of origin.

    ``calls``: child_id and one column per source ('paternal', 'maternal', anything else unassigned); ``ages``:
    child_id, father_age, mother_age. Only children with calls and both ages count. Fits: all calls on the father's age,
    and for each source paternal calls on the father's, maternal calls on the mother's and, as a control, on the father's
    age. A constant side has r and slope 0.
    """
    origins = ("paternal", "maternal")
    per = calls.groupBy("child_id").agg(F.count("*").alias("total"), *[F.count_if(F.col(s) == o).alias(f"{s}_{o}") for s in sources for o in origins])
    d = per.join(ages.dropna(subset=["father_age", "mother_age"]), "child_id")
    fit = lambda s, o, age, y: F.struct(F.lit(s).alias("source"), F.lit(o).alias("origin"), F.lit(age).alias("age_of"), F.col(y).cast("double").alias("y"), F.col(f"{age}_age").cast("double").alias("x"))
    fits = [fit("all", "any", "father", "total")]
    for s in sources:
        fits += [fit(s, "paternal", "father", f"{s}_paternal"), fit(s, "maternal", "mother", f"{s}_maternal"), fit(s, "maternal", "father", f"{s}_maternal")]
    long = d.select(F.inline(F.array(*fits)))
    d = long.groupBy("source", "origin", "age_of").agg(
        F.count("*").alias("n"), F.sum("y").cast("long").alias("n_calls"), F.covar_pop("x", "y").alias("xy"), F.var_pop("x").alias("xx"), F.var_pop("y").alias("yy"),
        ((F.min("x") < F.max("x")) & (F.min("y") < F.max("y"))).alias("moved"))
    # From the sums, as corr and regr_slope divide by a constant side's spread before anything can leave it out.
    fit_of = lambda v: F.when(F.col("moved"), v).otherwise(0.0)
    return d.select("source", "origin", "age_of", "n", "n_calls", fit_of(F.try_divide("xy", F.sqrt(F.col("xx") * F.col("yy")))).alias("r"), fit_of(F.try_divide("xy", "xx")).alias("slope"))
