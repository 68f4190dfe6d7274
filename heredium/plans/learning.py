"""Folds, scores, guards and models."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import ElementwiseProduct, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import ordered, ranks
from ..storage import cut


def family_folds(sizes: DataFrame, family: str, n_folds: int, seed: int = 1, first: str | None = None, min_families: int = 0) -> DataFrame:
    """Folds closed under family: the largest family goes to the fold with the least load so far, ties of size in seeded order.

    ``sizes``: one row per family with ``n``; families whose column ``first`` is true all go to fold 0, before the others. The choice depends
    on every one before it, so it runs over one row per family in one task that holds ``n_folds`` numbers. A fold with fewer than
    ``min_families`` families is an error."""
    front = F.coalesce(F.col(first), F.lit(False)) if first else F.lit(False)
    d = sizes.select(family, F.col("n").cast("long").alias("n"), front.alias("front"), F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(family).cast("string"))).alias("h"))
    d = d.repartition(1).sortWithinPartitions(F.desc("front"), F.desc("n"), "h", family)
    kind = sizes.schema[family].dataType.simpleString()

    def run(batches):
        load, count = [0] * n_folds, [0] * n_folds
        for b in batches:
            folds = []
            for n, pinned in zip(b["n"], b["front"], strict=True):
                k = 0 if pinned else min(range(n_folds), key=lambda i: (load[i], i))
                load[k] += n
                count[k] += 1
                folds.append(k)
            yield b[[family]].assign(fold=folds)
        if sum(count) and min(count) < min_families:
            raise ValueError(f"a fold has fewer than {min_families} families: {count}")

    return d.mapInPandas(run, f"`{family}` {kind}, fold int")


def fold_quantile_score(scored: DataFrame, reference: DataFrame, keys: list[str], id_cols: list[str]) -> DataFrame:
    """Mean over seeds of the fraction of the fold's reference scores strictly below; ``keys`` name fold, class and seed."""
    q = ranks.empirical_quantile(scored, reference, keys, "score")
    return q.groupBy(*id_cols).agg(F.avg("q").alias("rf_q"))


def rerank(score: Column, phase_class: Column) -> Column:
    """Scores moved below everything for demoted classes and above everything for rescued ones."""
    demote = phase_class.isin("phase_conflict_artifact", "inherited_missed_in_parent")
    return score + F.when(demote, -1e6).when(phase_class == "germline_DNM_phased", 1e6).otherwise(0.0)


def presence_guard(df: DataFrame, features: list[str], label: str, max_gap: float) -> DataFrame:
    """Per feature: share present in either label; a gap above ``max_gap`` would leak the label."""
    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).isNotNull().cast("double").alias("p")) for f in features]))
    d = df.select(label, cells.alias("c")).groupBy("c.feature").agg(F.avg(F.when(F.col(label) == 1, F.col("c.p"))).alias("present_1"), F.avg(F.when(F.col(label) == 0, F.col("c.p"))).alias("present_0"))
    return d.withColumn("leaks", F.when(F.abs(F.col("present_1") - F.col("present_0")) > max_gap, 1).otherwise(0))


def reliability(df: DataFrame, score: str, label: str, bins: int = 10) -> DataFrame:
    b = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1))
    return df.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg(score).alias("mean_score"), F.avg(F.col(label).cast("double")).alias("observed"))


def threshold_at(df: DataFrame, keys: list[str], score: str, label: str, max_fpr: float) -> DataFrame:
    """Lowest score whose false-positive rate stays within the limit, and the recall there."""
    d = ranks.precision_recall(df, keys, score, label).where(F.col("fpr") <= max_fpr)
    return d.groupBy(*keys).agg(F.min(score).alias("threshold"), F.max("recall").alias("recall"))


# The boosted trees tried in nested cross-validation, the forest's trees, the logistic model's iterations and penalty.
GRID = (
    {"maxDepth": 4, "stepSize": 0.1, "maxIter": 300, "minInstancesPerNode": 5, "subsamplingRate": 0.8},
    {"maxDepth": 6, "stepSize": 0.05, "maxIter": 600, "minInstancesPerNode": 10, "subsamplingRate": 0.8},
    {"maxDepth": 3, "stepSize": 0.2, "maxIter": 200, "minInstancesPerNode": 20, "subsamplingRate": 0.9},
)
FOREST = {"numTrees": 400, "maxDepth": 10, "minInstancesPerNode": 5}
LOGISTIC = {"maxIter": 2000, "regParam": 0.01}


def model(name: str, params: dict | None = None, seed: int = 1):
    """A classifier by name with its parameters; trees with a fixed seed."""
    kw = dict(labelCol="label", featuresCol="x", weightCol="weight")
    if name == "boosted":
        return GBTClassifier(seed=seed, cacheNodeIds=True, **kw, **(GRID[0] if params is None else params))
    if name == "forest":
        return RandomForestClassifier(seed=seed, **kw, **(FOREST if params is None else params))
    return LogisticRegression(**kw, **(LOGISTIC if params is None else params))


# Fixed value: parts into which rows that share features, label and weight are dealt before a fit that draws rows.
SHARES = 64


def distinct_rows(df: DataFrame, cols: list[str], shares: int = 1) -> DataFrame:
    """Features, ``label`` and the summed ``weight`` of rows equal in them; ``shares`` > 1 keeps up to as many parts of each, dealt by a hash of the whole row."""
    part = F.pmod(F.xxhash64(*sorted(df.columns)), F.lit(shares)) if shares > 1 else F.lit(0)
    d = df.groupBy(*cols, "label", part.alias("__part")).agg(F.sum("weight").alias("weight"))
    return d.drop("__part").repartition(df.sparkSession.sparkContext.defaultParallelism)       # few rows, read by every round


def fit(df: DataFrame, cols: list[str], name: str, params: dict | None = None, seed: int = 1):
    """A fitted pipeline. Every round of a fit reads all rows, so rows equal in features and label go in once with their summed weight.

    The logistic model is the same for it, as its features are scaled by the deviations of all rows. Boosted trees count rows in ``minInstancesPerNode``; where all weights are one value that is a share
    of the total weight, otherwise their rows go in as they are. What a round leaves out by ``subsamplingRate`` is then one of ``SHARES`` parts of such rows."""
    est = model(name, params, seed)
    stages = [VectorAssembler(inputCols=cols, outputCol="x")]
    if name == "logistic":
        every = stages[0].transform(df.select(*cols, "weight")).agg(Summarizer.std(F.col("x"), F.col("weight")).alias("s")).first()
        df = cut(distinct_rows(df, cols))
        if est.getStandardization() and every.s is not None:                                       # the deviation of summed weights is another one
            stages = [VectorAssembler(inputCols=cols, outputCol="__raw"), ElementwiseProduct(scalingVec=[1 / v if v else 0.0 for v in every.s], inputCol="__raw", outputCol="x")]
            est = est.setStandardization(False)
    elif name == "boosted":
        w = df.agg(F.min("weight").alias("lo"), F.max("weight").alias("hi"), F.count("*").alias("n")).first()
        least = est.getMinInstancesPerNode() / max(w.n, 1)
        if w.n and w.lo == w.hi and least < 0.5:
            df = cut(distinct_rows(df, cols, SHARES if est.getSubsamplingRate() < 1 else 1))
            est = est.setMinInstancesPerNode(1).setMinWeightFractionPerNode(least * (1 - 1e-9))       # the weights of so many rows, whatever their sum is rounded to
    return Pipeline(stages=[*stages, est]).fit(df)


def predict(fitted, df: DataFrame) -> DataFrame:
    """Adds ``p``, the probability of label 1."""
    return fitted.transform(df).withColumn("p", vector_to_array("probability")[1]).drop("x", "__raw", "rawPrediction", "probability", "prediction")


def weighted(train: DataFrame) -> DataFrame:
    """Class weights from the given rows alone, so that both labels weigh the same."""
    balance = train.groupBy("label").agg(F.count("*").alias("__n"))
    total = balance.agg(F.sum("__n").alias("__t"))
    return train.join(F.broadcast(balance.crossJoin(total).select("label", (F.col("__t") / (2 * F.col("__n"))).alias("weight"))), "label")   # two rows


def ablated(features: list[str], prefixes: tuple[str, ...], which: str) -> list[str]:
    """``full``, ``no_phase`` (without columns of the prefixes) or ``phase_only`` (only those)."""
    phase = [c for c in features if c.startswith(prefixes)]
    return {"full": list(features), "no_phase": [c for c in features if c not in phase], "phase_only": phase}[which]


def nested_cv(df: DataFrame, family: str, features: list[str], name: str = "boosted", grid: tuple[dict, ...] = GRID, inner_folds: int = 3, seed: int = 0, calibrated: bool = True) -> DataFrame:
    """The rows with held-out ``raw`` and ``p``, and ``chosen``, the place in the grid of their fold's model.

    ``df``: ``family``, ``label``, ``fold`` (outer folds closed under family) and features without NULLs. Inside every outer training part
    its families are dealt into inner folds; each entry of the grid is scored by the precision-recall area of the pooled inner scores, and the
    best one is fitted on the whole training part. Isotonic calibration sees those inner scores only, so nothing of a test fold reaches its
    model. A fold without both labels in its training part has no model and NULL scores. The loops are over folds and grid; rows stay on the cluster."""
    df = cut(df)
    out = None
    for k in sorted(r.fold for r in df.select("fold").distinct().collect()):                    # a few folds
        train, test = df.where(F.col("fold") != k), df.where(F.col("fold") == k)
        if train.select("label").distinct().count() < 2:
            part = test.withColumns({"raw": F.lit(None).cast("double"), "p": F.lit(None).cast("double"), "chosen": F.lit(None).cast("int")})
            out = part if out is None else out.unionByName(part)
            continue
        inner = family_folds(train.groupBy(family).agg(F.count("*").alias("n")), family, inner_folds, seed + 17 * int(k)).withColumnRenamed("fold", "inner")
        train = cut(train.join(inner, family))
        best, best_area, pooled = 0, -1.0, None
        for i, params in enumerate(grid):
            scores = None
            for j in range(inner_folds):
                own = train.where(F.col("inner") != j)
                if own.select("label").distinct().count() < 2:
                    continue
                s = predict(fit(weighted(own), features, name, params, seed + 1), train.where(F.col("inner") == j)).select("label", F.col("p").alias("raw"))
                scores = s if scores is None else scores.unionByName(s)
            if scores is None:
                continue
            scores = cut(scores)
            area = ranks.auc(scores.withColumn("__k", F.lit(0)), ["__k"], "raw", "label").first().pr_auc or 0.0
            if area > best_area:
                best, best_area, pooled = i, area, scores
        part = predict(fit(weighted(train), features, name, grid[best], seed + 1), test).withColumnRenamed("p", "raw").withColumn("chosen", F.lit(best))
        part = isotonic(pooled, "raw", "label").transform(part).withColumnRenamed("calibrated", "p") if calibrated and pooled is not None else part.withColumn("p", F.col("raw"))
        part = cut(part.select(*df.columns, "raw", "p", "chosen"))
        out = part if out is None else out.unionByName(part)
    return out


def isotonic(points: DataFrame, score: str, label: str):
    """Isotonic fit of a label on a score; rows of one score are one point with their number as weight, scores in 4,096 steps of equal width."""
    grid = F.round(F.col(score) * 4096) / 4096           # bounds what the fit gathers
    g = points.groupBy(grid.alias(score)).agg(F.avg(F.col(label).cast("double")).alias(label), F.count("*").cast("double").alias("__w"))
    return IsotonicRegression(featuresCol=score, labelCol=label, weightCol="__w", predictionCol="calibrated").fit(g)


def calibrate(df: DataFrame, score: str, label: str) -> DataFrame:
    """Isotonic calibration of held-out scores; rows of one score are one point with their number as weight."""
    points = df.groupBy(score).agg(F.avg(F.col(label).cast("double")).alias(label), F.count("*").cast("double").alias("__w"))
    m = IsotonicRegression(featuresCol=score, labelCol=label, weightCol="__w", predictionCol="calibrated").fit(points)
    return m.transform(df)


def permutation_importance(df: DataFrame, families: dict[str, list[str]], score, label: str, seed: int = 7, shuffles: int = 3) -> DataFrame:
    """Loss of ROC-AUC when a block of columns is shuffled across rows: mean and range over ``shuffles`` shuffles.

    ``score`` adds a column ``score`` to a frame without ``id``: a formula or a fitted model. Rows (``id`` is unique) are numbered in two orders
    of md5 text by a binned running count and matched by number, so no ordering runs in one task. All families of a shuffle share its two orders
    and its join; only scores with their counts are kept. ``df`` is read twice for every order: cut it if it is dear to make.
    """
    moved = list(dict.fromkeys(c for cols in families.values() for c in cols))
    kept = [c for c in df.columns if c != "id"]

    def numbered(s: int, cols: dict[str, str]) -> DataFrame:
        # the sixteen bytes order as their hex text does; unique ids have no equal ones, so the id itself need not travel
        h = df.select(F.unhex(F.md5(F.concat_ws(":", F.lit(str(s)), F.col("id").cast("string")))).alias("__h"), *[F.col(c).alias(n) for c, n in cols.items()])
        h = h.withColumns({"__all": F.lit(0), "__b": F.conv(F.hex(F.substring("__h", 1, 1)), 16, 10).cast("int")})
        return ordered.scan(h, ["__all"], "__b", ["__h", *cols.values()], F.lit(1), "__i", "sum").drop("__h", "__all", "__b")

    def scored(d: DataFrame) -> DataFrame:
        return score(d).groupBy("family", "shuffle", "score", label).agg(F.count("*").alias("n"))

    every = scored(df.select(F.lit("").alias("family"), F.lit(0).alias("shuffle"), *kept))
    for i in range(shuffles):
        donors = numbered(seed + 2 * i, {c: f"__o_{c}" for c in moved})
        both = numbered(seed + 2 * i + 1, {c: c for c in kept}).join(donors, "__i")
        as_in = [F.struct(F.lit(fam).alias("family"), *[F.col(f"__o_{c}" if c in cols else c).alias(c) for c in moved]) for fam, cols in families.items()]
        d = both.withColumn("__f", F.explode(F.array(*as_in)))
        every = every.unionByName(scored(d.select("__f.*", F.lit(i).alias("shuffle"), *[c for c in kept if c not in moved])))
    every = cut(every)                                   # read by the cut points and the curves
    a = cut(ranks.auc(every, ["family", "shuffle"], "score", label, "n").select("family", "shuffle", "roc_auc"))        # a row a family and shuffle
    base = a.where("family = ''").select(F.col("roc_auc").alias("base"))
    d = a.where("family <> ''").crossJoin(F.broadcast(base)).withColumn("loss", F.col("base") - F.col("roc_auc"))
    return d.groupBy("family").agg(F.avg("roc_auc").alias("auc"), F.avg("loss").alias("importance"), F.min("loss").alias("least"), F.max("loss").alias("most"))
