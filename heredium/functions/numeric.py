"""Numeric expressions: log-gamma, exact tests, distributions, draws."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

def bind(value: Column, body) -> Column:
    """``body(value)`` with the value worked out once, however often the body mentions it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


# Lanczos coefficients for g = 7, n = 9.
LANCZOS = (
    0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059,
    12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7,
)


def lgamma(x: Column) -> Column:
    """log Gamma for x >= 1, one closed expression (no lookup, stays in generated code)."""
    z = x - 1.0
    series = F.lit(LANCZOS[0])
    for i, c in enumerate(LANCZOS[1:], start=1):
        series = series + F.lit(c) / (z + float(i))
    t = z + 7.5
    return 0.5 * math.log(2 * math.pi) + (z + 0.5) * F.log(t) - t + F.log(series)


def log_choose(n: Column, k: Column) -> Column:
    return lgamma(n + 1.0) - lgamma(k + 1.0) - lgamma(n - k + 1.0)


def log_binom(k: Column, n: Column, p: Column | float) -> Column:
    """log P(K = k) for Binomial(n, p); 0 observations give 0."""
    pp = F.least(F.greatest(p if isinstance(p, Column) else F.lit(p), F.lit(1e-9)), F.lit(1 - 1e-9))
    return F.when(n == 0, F.lit(0.0)).otherwise(log_choose(n, k) + k * F.log(pp) + (n - k) * F.log(1 - pp))


def normal_two_sided(z: Column) -> Column:
    """2(1 - Phi(|z|)) by the continued fraction of erfc for large z and its series for small z."""
    def tail(x: Column) -> Column:
        steps = F.sequence(F.lit(1), F.lit(60))
        start = F.struct(x.alias("term"), x.alias("total"))

        def step(acc: Column, k: Column) -> Column:
            term = acc["term"] * (-(x * x)) / k
            return F.struct(term.alias("term"), (acc["total"] + term / (2 * k + 1)).alias("total"))

        series = 1 - 2 / math.sqrt(math.pi) * F.aggregate(steps, start, step)["total"]
        frac = F.aggregate(F.reverse(steps), F.lit(0.0), lambda acc, k: (k / 2.0) / (x + acc))
        return F.when(x < 2.5, series).otherwise(F.exp(-(x * x)) / math.sqrt(math.pi) / (x + frac))

    return F.when(z.isNotNull(), bind(F.abs(z) / math.sqrt(2.0), tail))


def _reach(n: Column) -> Column:
    """Terms further than this from the mode or the observed count are below double precision."""
    return F.ceil(10 * F.sqrt(n.cast("double"))) + 50


def binom_doubled_tail(t: Column, n: Column) -> Column:
    """Exact two-sided binomial p at 1/2: twice the smaller tail, at most 1."""
    lo = F.least(t, n - t).cast("long")
    tail = F.aggregate(
        F.sequence(F.greatest(lo - _reach(n), F.lit(0).cast("long")), lo), F.lit(0.0),
        lambda acc, i: acc + F.exp(log_choose(n.cast("double"), i.cast("double")) - n * math.log(2.0)),
    )
    return F.when(n > 0, F.least(F.lit(1.0), 2 * tail))


def binom_min_likelihood(k: Column, n: Column, p: float = 0.5) -> Column:
    """Exact two-sided binomial p: total probability of outcomes no likelier than the observed one."""
    mode, reach = F.floor(n * p), _reach(n)
    first = F.greatest(F.least(k, mode) - reach, F.lit(0).cast("long")).cast("long")
    last = F.least(F.greatest(k, mode) + reach, n).cast("long")
    terms = F.transform(F.sequence(first, last), lambda i: F.exp(log_binom(i.cast("double"), n.cast("double"), p)))

    def total(ts: Column) -> Column:
        return bind(F.element_at(ts, (k - first + 1).cast("int")) * (1 + 1e-7), lambda obs: F.aggregate(
            ts, F.lit(0.0), lambda acc, x: acc + F.when(x <= obs, x).otherwise(0.0)))

    return F.when(n > 0, F.least(F.lit(1.0), bind(terms, total)))


def binom_normal_cc(t: Column, n: Column) -> Column:
    """Normal approximation at 1/2 with continuity correction."""
    z = F.greatest(F.abs(t - n / 2.0) - 0.5, F.lit(0.0)) / F.sqrt(n / 4.0)
    return F.when(n > 0, normal_two_sided(z))


def fisher_two_sided(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Fisher's exact p of a 2x2 table: tables with the same margins no likelier than the observed one."""
    r1, c1, n = a + b, a + c, a + b + c + d

    def logp(x: Column) -> Column:
        return (log_choose(c1.cast("double"), x.cast("double"))
                + log_choose((n - c1).cast("double"), (r1 - x).cast("double"))
                - log_choose(n.cast("double"), r1.cast("double")))

    mean, reach = F.floor(r1 * c1 / n), _reach(n)
    lo = F.greatest(F.lit(0).cast("long"), r1 + c1 - n, F.least(a, mean) - reach)
    hi = F.least(r1, c1, F.greatest(a, mean) + reach)
    terms = F.transform(F.sequence(lo.cast("long"), hi.cast("long")), logp)
    total = bind(terms, lambda ts: bind(F.element_at(ts, (a - lo + 1).cast("int")) + 1e-7, lambda obs: F.aggregate(
        ts, F.lit(0.0), lambda acc, x: acc + F.when(x <= obs, F.exp(x)).otherwise(0.0))))
    return F.least(F.lit(1.0), total)


def genotype_likelihood(ref: Column, alt: Column, error: float = 0.01) -> Column:
    """struct(pl, gt, gq) of a diploid site under binomial sampling with a per-read error rate."""
    raw = [-10 / math.log(10) * (alt * math.log(p) + ref * math.log(1 - p)) for p in (error, 0.5, 1 - error)]
    best = F.least(*raw)
    pl = [F.round(x - best).cast("int") for x in raw]
    gt = F.when(pl[0] == 0, "0/0").when(pl[1] == 0, "0/1").otherwise("1/1")
    second = F.sort_array(F.array(*pl))[1]
    return F.struct(F.array(*pl).alias("pl"), F.when(ref + alt > 0, gt).otherwise("./.").alias("gt"),
                    F.when(ref + alt > 0, F.least(second, F.lit(99))).otherwise(0).alias("gq"))


def draw(*keys: Column, seed: int = 0) -> Column:
    """A number in [0, 1) fixed by the keys and the seed, whatever the partitioning."""
    h = F.xxhash64(*keys, F.lit(seed))
    return F.pmod(h, F.lit(1 << 30)) / float(1 << 30)


def log_sum_exp(values: list[Column]) -> Column:
    top = F.greatest(*values)
    total = F.lit(0.0)
    for v in values:
        total = total + F.exp(v - top)
    return top + F.log(total)


def array_log_sum_exp(values: Column) -> Column:
    def summed(v: Column) -> Column:
        return bind(F.array_max(v), lambda top: top + F.log(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + F.exp(x - top))))

    return bind(values, summed)
