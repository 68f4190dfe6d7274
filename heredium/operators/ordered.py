"""Scans over ordered data that never put a whole key into one task.

A key (chromosome, sample, score column) may hold a third of all rows, so a plain
window over it would be one task. Here each key is cut into bins that follow the
order; the window runs inside (key, bin), one summary row per bin carries the
state across bins, and both are joined. Bins per key are few, rows per bin small.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_LOCAL, _CARRY = "__local", "__carry"


def position_bin(pos: Column, bits: int = 20) -> Column:
    return F.shiftright(pos.cast("long"), bits)


def value_bin(df: DataFrame, value: str, name: str, rows: int = 4096, most: int = 1024) -> DataFrame:
    """Bins of near-equal row count over a numeric column, about ``rows`` rows each and at most ``most`` bins.

    One pass counts the rows and takes quantiles; the driver reads one number per possible bin, ``most`` - 1 at most."""
    at = F.expr("array(" + ", ".join(f"{i / most}D" for i in range(1, most)) + ")")
    row = df.agg(F.count(value).alias("n"), F.percentile_approx(F.col(value).cast("double"), at, F.lit(10000)).alias("c")).first()
    bins = max(1, min(most, (row.n if row is not None else 0) // rows))
    cuts = sorted({row.c[most * i // bins - 1] for i in range(1, bins)}) if bins > 1 else []
    if not cuts:
        return df.withColumn(name, F.lit(0))
    splits = [float("-inf"), *cuts, float("inf")]
    src = df.withColumn("__v", F.col(value).cast("double"))
    out = Bucketizer(splits=splits, inputCol="__v", outputCol=name, handleInvalid="keep").transform(src)
    return out.withColumn(name, F.col(name).cast("int")).drop("__v")


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Equality join on ``keys`` in which NULL equals NULL; the left side's keys stay."""
    names = {k: f"__r{i}" for i, k in enumerate(keys)}
    r = right.withColumnsRenamed(names)
    on = [left[k].eqNullSafe(r[n]) for k, n in names.items()]
    return left.join(r, on, how).drop(*names.values())


def scan(df: DataFrame, keys: list[str], bin: str, order: list[str], value: Column, name: str, how: str,
         inclusive: bool = True) -> DataFrame:
    """Adds ``name``: running sum, max, last non-null value at or before, or first non-null value at or after.

    ``order`` must be consistent with ``bin`` (all rows of a lower bin come first) and total within a key.
    """
    return scans(df, keys, bin, order, {name: (value, how)}, inclusive)


def scans(df: DataFrame, keys: list[str], bin: str, order: list[str], measures: dict[str, tuple[Column, str]],
          inclusive: bool = True, totals: dict[str, str] | None = None) -> DataFrame:
    """Several scans of the same order at once: one window, one row per bin, one join, however many ``measures``.

    ``measures`` maps a new column to its value and kind, as in ``scan``; ``first_after`` looks the other way and
    goes with none of the other kinds. ``totals`` names, for running sums, a column for the sum over the whole key.
    """
    back = {how == "first_after" for _, how in measures.values()}
    if len(back) != 1:
        raise ValueError("scans of one order and direction only")
    back = back.pop()
    totals = totals or {}
    names = list(measures)
    src = df.withColumns({f"__value{i}": measures[n][0] for i, n in enumerate(names)})
    # One struct is the partition of the window and the key of the join: NULL equals NULL in it, and the join finds the window's rows where they are.
    part = ["__part"]
    src = src.withColumn("__part", F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], F.col(bin).alias("bin")))
    asc = [F.col(c).desc() if back else F.col(c).asc() for c in order]
    w = W.partitionBy(*part).orderBy(*asc).rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
    whole = [F.col(f"__part.k{i}") for i in range(len(keys))]
    at_bin = F.col("__part.bin")
    bins = W.partitionBy(*whole).orderBy(at_bin.desc() if back else at_bin.asc()).rowsBetween(W.unboundedPreceding, -1)
    pick, at = (F.min_by if back else F.max_by), F.struct(*order)
    local, summary, carry, joined = {}, [], {}, {}
    for i, n in enumerate(names):
        v, s, here, before = f"__value{i}", f"__s{i}", f"{_LOCAL}{i}", f"{_CARRY}{i}"
        how = measures[n][1]
        if how == "sum":
            local[here], carry[before] = F.sum(v).over(w), F.sum(s).over(bins)
            summary.append(F.sum(v).alias(s))
            joined[n] = F.coalesce(F.col(here), F.lit(0)) + F.coalesce(F.col(before), F.lit(0))
            if n in totals:
                carry[totals[n]] = F.sum(s).over(W.partitionBy(*whole))
        elif how == "max":
            local[here], carry[before] = F.max(v).over(w), F.max(s).over(bins)
            summary.append(F.max(v).alias(s))
            joined[n] = F.greatest(here, before)
        elif how in ("last", "first_after"):
            local[here], carry[before] = F.last(v, ignorenulls=True).over(w), F.last(s, ignorenulls=True).over(bins)
            summary.append(pick(F.col(v), F.when(F.col(v).isNotNull(), at)).alias(s))
            joined[n] = F.coalesce(here, before)
        else:
            raise ValueError(how)
    helpers = [f"__s{i}" for i in range(len(names))]
    per_bin = src.groupBy(*part).agg(*summary).withColumns(carry).drop(*helpers)
    out = src.withColumns(local).join(per_bin, part, "left")
    return out.withColumns(joined).drop("__part", *[f"{x}{i}" for x in ("__value", _LOCAL, _CARRY) for i in range(len(names))])


def runs(df: DataFrame, keys: list[str], bin: str, order: list[str], breaks_after: Column, name: str) -> DataFrame:
    """Number of the maximal run each row belongs to; ``breaks_after`` is 1 on the first row of a run."""
    return scan(df, keys, bin, order, breaks_after.cast("long"), name, "sum")


def previous(df: DataFrame, keys: list[str], bin: str, order: list[str], value: Column, name: str) -> DataFrame:
    """``lag`` across bins; the value must not be NULL."""
    return scan(df, keys, bin, order, value, name, "last", inclusive=False)
