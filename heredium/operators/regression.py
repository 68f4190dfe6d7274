"""Many small fits from sufficient statistics.

The sums are ordinary aggregates, combined before the shuffle; what reaches Python is one
short row per fit, solved in batches by partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c = np.ones_like(x)
    d = 1.0 / np.where(np.abs(1 - (a + b) * x / (a + 1)) < tiny, tiny, 1 - (a + b) * x / (a + 1))
    h = d.copy()
    for m in range(1, 200):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + num / np.where(np.abs(c) < tiny, tiny, c)
            h = h * c * d
    return h


def _lgamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function for x > 0: the argument is raised above 15, where Stirling's series has double precision."""
    x = np.asarray(x, dtype=float)
    product, z = np.ones_like(x), x.copy()
    for _ in range(15):
        low = z < 15
        product = np.where(low, product * z, product)
        z = np.where(low, z + 1, z)
    i = 1 / (z * z)
    series = (1 / 12 - i * (1 / 360 - i * (1 / 1260 - i * (1 / 1680 - i / 1188)))) / z
    return (z - 0.5) * np.log(z) - z + 0.5 * np.log(2 * np.pi) + series - np.log(product)


def t_two_sided(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """Two-sided p of Student's t through the regularised incomplete beta function."""
    x = df / (df + t * t)
    a, b = df / 2.0, np.full_like(df, 0.5)
    front = np.exp(_lgamma(a + b) - _lgamma(a) - _lgamma(b) + a * np.log(np.clip(x, 1e-300, 1)) + b * np.log(np.clip(1 - x, 1e-300, 1)))
    low = front * _beta_fraction(a, b, x) / a
    high = 1 - front * _beta_fraction(b, a, 1 - x) / b
    return np.where(x >= 1, 1.0, np.where(x < (a + 1) / (a + b + 2), low, high))


def ols(df: DataFrame, keys: list[str], y: str, xs: list[str], min_rows: int = 5) -> DataFrame:
    """Per key: coefficient, standard error, t and p of the first of ``xs`` with an intercept; ``coef`` has all of them."""
    cols = ["__one", *xs, y]
    d = df.dropna(subset=[*xs, y]).withColumn("__one", F.lit(1.0))
    k = len(xs) + 1
    pairs = [(i, j) for i in range(k + 1) for j in range(i, k + 1)]
    g = d.groupBy(*keys).agg(F.count("*").alias("n"), F.array(*[F.sum(F.col(cols[i]).cast("double") * F.col(cols[j]).cast("double")) for i, j in pairs]).alias("s"))
    return solve_sums(g.where(F.col("n") >= max(min_rows, k + 1)), keys, k)


def solve_sums(g: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Least squares from cross-products: ``g`` has the keys, ``n`` and ``s``, the upper triangle over intercept, k - 1 columns and the outcome.

    Where the first column is a combination of the intercept and the others, its ``beta, se, t, p`` are NULL; ``coef`` is the shortest solution."""
    pairs = [(i, j) for i in range(k + 1) for j in range(i, k + 1)]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in g.select(*keys).schema.fields) + ", n long, beta double, se double, t double, p double, coef array<double>"

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if pdf.empty:
                continue
            s = np.stack(pdf["s"].to_numpy())
            full = np.zeros((len(pdf), k + 1, k + 1))
            for c, (i, j) in enumerate(pairs):
                full[:, i, j] = full[:, j, i] = s[:, c]
            xtx, xty, yty = full[:, :k, :k], full[:, :k, k], full[:, k, k]
            inv = np.linalg.pinv(xtx)
            beta = np.einsum("nij,nj->ni", inv, xty)
            dof = pdf["n"].to_numpy() - k
            rss = np.maximum(yty - np.einsum("ni,ni->n", beta, xty), 0)
            others = [i for i in range(k) if i != 1]
            shared = xtx[:, others, 1]
            own = xtx[:, 1, 1] - np.einsum("ni,nij,nj->n", shared, np.linalg.pinv(xtx[:, others][:, :, others]), shared)     # what the other columns leave of it
            slope = np.where(own > 1e-10 * xtx[:, 1, 1], beta[:, 1], np.nan)
            se = np.sqrt(np.maximum(rss / dof * inv[:, 1, 1], 0))
            se = np.where(np.isnan(slope), np.nan, se)
            with np.errstate(divide="ignore", invalid="ignore"):
                t = np.where(se > 0, slope / se, np.nan)
            out = pdf[keys].copy()
            out["n"], out["beta"], out["se"], out["t"] = pdf["n"], slope, se, t
            out["p"] = np.where(np.isnan(t), np.nan, t_two_sided(np.nan_to_num(t), dof.astype(float)))
            out["coef"] = list(beta)
            yield out

    return g.mapInPandas(solve, schema)


def residuals(df: DataFrame, keys: list[str], y: str, xs: list[str], name: str) -> DataFrame:
    """Adds the residual of ``y`` on ``xs`` within each key."""
    fit = ols(df, keys, y, xs).select(*keys, "coef")
    d = df.join(fit, keys, "left") if keys else df.crossJoin(F.broadcast(fit))
    pred: Column = F.get("coef", F.lit(0))
    for i, x in enumerate(xs):
        pred = pred + F.get("coef", F.lit(i + 1)) * F.col(x)
    return d.withColumn(name, F.col(y) - pred).drop("coef")


def _subset_moments(logw: np.ndarray, x: np.ndarray, m: int) -> tuple[float, np.ndarray, np.ndarray]:
    """Log of the summed weight, mean vector and covariance of the exposure sum over all choices of ``m`` members.

    Members come one by one; for every size the subsets with and without the new member are mixed by their weights, which stay logarithms."""
    k = x.shape[1]
    total = np.full(m + 1, -np.inf)
    total[0] = 0.0
    mean, cov = np.zeros((m + 1, k)), np.zeros((m + 1, k, k))
    for a, v in zip(logw, x, strict=True):
        old, new = total[1:], total[:-1] + a
        both = np.logaddexp(old, new)
        with np.errstate(invalid="ignore"):
            p = np.where(np.isfinite(both), np.exp(new - both), 0.0)[:, None]
        gap = mean[:-1] + v - mean[1:]
        cov[1:] = (1 - p)[:, :, None] * cov[1:] + p[:, :, None] * cov[:-1] + (p * (1 - p))[:, :, None] * gap[:, :, None] * gap[:, None, :]
        mean[1:] = mean[1:] + p * gap
        total[1:] = both
    return float(total[m]), mean[m], cov[m]


def conditional_logistic(members: DataFrame, keys: list[str], stratum: str, case: str, x: str | list[str]) -> DataFrame:
    """Per key and covariate: log odds ratio, SE and z by the exact conditional likelihood of strata with any number of cases.

    ``x`` names one covariate or several fitted together; members with a NULL in one of them are left out. Strata with the same
    exposures and as many cases are one pattern with a count, so a fit sees few rows however many families there are. Strata without
    a case, without a control or with equal exposures say nothing and are left out. Newton steps are halved while the likelihood falls;
    covariates that cannot be told apart have NULL standard errors.
    """
    xs = [x] if isinstance(x, str) else list(x)
    seen = members.dropna(subset=[case, *xs])
    v = F.array(*[F.col(c).cast("double") for c in xs])
    s = seen.groupBy(*keys, stratum).agg(F.array(*[F.sum(F.when(F.col(case) == 1, F.col(c))).cast("double") for c in xs]).alias("cx"), F.count_if(F.col(case) == 1).alias("nc"),
                                         F.sort_array(F.collect_list(v)).alias("xs"))
    tells = (F.col("nc") >= 1) & (F.col("nc") < F.size("xs")) & (F.array_min("xs") != F.array_max("xs"))
    pat = s.where(tells).groupBy(*keys, "nc", "cx", "xs").agg(F.count("*").alias("w"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pat.select(*keys).schema.fields) + ", covariate string, n_strata long, beta double, se double, z double"

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        k = len(xs)
        every = [np.stack(v).astype(float) for v in pdf["xs"]]
        scale = np.maximum(np.concatenate(every).std(axis=0), 1e-12)
        rows = [(e / scale, np.asarray(c, float) / scale, int(m), float(w)) for e, c, m, w in zip(every, pdf["cx"], pdf["nc"], pdf["w"], strict=True)]

        def at(beta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
            like, grad, info = 0.0, np.zeros(k), np.zeros((k, k))
            for e, c, m, w in rows:
                total, mean, cov = _subset_moments(e @ beta, e, m)
                like += w * (float(c @ beta) - total)
                grad += w * (c - mean)
                info += w * cov
            return like, grad, info

        beta = np.zeros(k)
        like, grad, info = at(beta)
        for _ in range(100):
            step = np.linalg.pinv(info, rcond=1e-10) @ grad
            step *= min(1.0, 4.0 / max(np.abs(step).max(), 1e-300))
            for _half in range(30):
                new = at(beta + step)
                if new[0] >= like - 1e-12:
                    break
                step /= 2
            beta, (like, grad, info) = beta + step, new
            if np.abs(step).max() < 1e-10:
                break
        told = np.linalg.matrix_rank(info, tol=1e-9 * max(1.0, np.abs(info).max())) == k
        se = np.sqrt(np.diag(np.linalg.inv(info))) / scale if told else np.full(k, np.nan)
        beta = beta / scale
        key = pdf.iloc[0][keys].tolist()
        return pd.DataFrame([[*key, c, int(pdf["w"].sum()), beta[i], se[i], beta[i] / se[i] if se[i] > 0 else float("nan")] for i, c in enumerate(xs)],
                            columns=[*keys, "covariate", "n_strata", "beta", "se", "z"])

    return pat.groupBy(*keys).applyInPandas(fit, schema)


def _active_set(q: np.ndarray, b: np.ndarray) -> np.ndarray:
    """w >= 0 with the least w'qw - 2b'w: variables enter by their gradient and leave at zero until no gradient is positive."""
    k = len(b)
    w, free = np.zeros(k), np.zeros(k, bool)
    tol = 1e-12 * max(1.0, np.abs(b).max())
    for _ in range(10 * k + 10):
        grad = b - q @ w
        grad[free] = -np.inf
        if free.all() or grad.max() <= tol:
            break
        free[int(np.argmax(grad))] = True
        while True:
            s = np.zeros(k)
            s[free] = np.linalg.lstsq(q[np.ix_(free, free)], b[free], rcond=None)[0]
            if s[free].min() > 0:
                w = s
                break
            low = free & (s <= 0)
            move = np.min(w[low] / np.maximum(w[low] - s[low], 1e-300))
            w = w + move * (s - w)
            free &= w > tol * 1e-3
            w[~free] = 0.0
            if not free.any():
                break
    return w


def nnls(df: DataFrame, keys: list[str], y: str, xs: list[str]) -> DataFrame:
    """Non-negative least squares per key from cross-products, scaled to fractions that sum to one.

    Also ``n_markers`` (rows used), ``raw_sum`` (of the weights before scaling) and ``rss`` of the fractions. Weights that are all zero stay so."""
    cols = [*xs, y]
    k = len(xs)
    pairs = [(i, j) for i in range(k + 1) for j in range(i, k + 1)]
    g = df.dropna(subset=cols).groupBy(*keys).agg(F.count("*").alias("n_markers"), F.array(*[F.sum(F.col(cols[i]) * F.col(cols[j])) for i, j in pairs]).alias("s"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in g.select(*keys).schema.fields) + ", " + ", ".join(f"`{x}` double" for x in xs) + ", n_markers long, raw_sum double, rss double"

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if pdf.empty:
                continue
            s = np.stack(pdf["s"].to_numpy())
            full = np.zeros((len(pdf), k + 1, k + 1))
            for c, (i, j) in enumerate(pairs):
                full[:, i, j] = full[:, j, i] = s[:, c]
            w = np.stack([_active_set(f[:k, :k], f[:k, k]) for f in full])
            total = w.sum(axis=1)
            share = w / np.where(total > 0, total, 1.0)[:, None]
            out = pdf[keys].copy()
            for i, x in enumerate(xs):
                out[x] = share[:, i]
            out["n_markers"], out["raw_sum"] = pdf["n_markers"], total
            out["rss"] = np.maximum(np.einsum("ni,nij,nj->n", share, full[:, :k, :k], share) - 2 * np.einsum("ni,ni->n", share, full[:, :k, k]) + full[:, k, k], 0)
            yield out

    return g.mapInPandas(solve, schema)
