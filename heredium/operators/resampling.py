"""Resampling in one scan: vectors over replicates are summed instead of running one plan for each replicate.

A row of work is one region with the values of a block of samples; what it adds to every replicate is one small matrix.
Tasks keep sums by block and set, hand them over when they hold too much, and the partial sums are added by key.
Draws come from md5 text, so they are the same on any engine and any number of tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ordered

SAMPLES, HELD = 256, 1 << 23         # samples of a block; numbers a task holds before it hands sums over
TOLD = 1 << 19                       # numbers handed over at a time
STATS = 7                            # n, z, d, d^2, t, t^2, d t


def md5_int(*parts: Column | str) -> Column:
    """A number below 2^32 from the md5 of the parts joined by ':'."""
    text = F.concat_ws(":", *[(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def numbered(df: DataFrame, keys: list[str], id_col: str, name: str = "at") -> DataFrame:
    """Rows numbered from 0 by ``id_col`` inside each key."""
    k = keys or ["__all"]
    d = df if keys else df.withColumn("__all", F.lit(0))
    d = ordered.scan(ordered.value_bin(d, id_col, "__b"), k, "__b", [id_col], F.lit(1), "__i", "sum")
    return d.withColumn(name, F.col("__i") - 1).drop("__b", "__i", "__all")


def bootstrap_weights(members: DataFrame, id_col: str, n_rep: int, seed: int) -> DataFrame:
    """``id_col, w``: how often each member is drawn in each replicate, drawing as many as there are with replacement."""
    m = numbered(members.select(id_col).distinct(), [], id_col)
    n = m.agg(F.count("*").alias("n"))                     # one row
    picks = m.crossJoin(F.broadcast(n)).select(F.col("at").alias("k"), "n", F.explode(F.sequence(F.lit(1), F.lit(n_rep))).alias("rep"))
    picks = picks.select("rep", (md5_int(F.lit(seed), "rep", "k") % F.col("n")).alias("at")).groupBy("at", "rep").agg(F.count("*").alias("c"))
    got = picks.groupBy("at").agg(F.map_from_entries(F.collect_list(F.struct("rep", "c"))).alias("by"))
    w = F.transform(F.sequence(F.lit(1), F.lit(n_rep)), lambda r: F.coalesce(F.try_element_at("by", r), F.lit(0)).cast("int"))
    return m.join(got, "at", "left").withColumn("by", F.coalesce("by", F.create_map().cast("map<int,bigint>"))).select(id_col, w.alias("w"))


def blocks(values: DataFrame, *cols: str) -> DataFrame:
    """One row per (region, block of samples): ``sample``, and an array of each of ``cols`` in the same order."""
    b = F.pmod(F.xxhash64("sample_id"), F.lit(1 << 20)).cast("int")
    n = values.select("sample_id").distinct().count()
    d = values.withColumn("block", F.pmod(b, F.lit(-(-n // SAMPLES) or 1)).cast("int"))
    d = d.groupBy("region_id", "block").agg(F.sort_array(F.collect_list(F.struct("sample_id", *cols))).alias("x"))
    return d.select("region_id", "block", *[F.col(f"x.{c}").alias(c) for c in ("sample_id", *cols)])


class _Sums:
    """Sums of equally shaped arrays by key."""

    def __init__(self):
        self.by: dict[tuple, np.ndarray] = {}
        self.size = 0

    def at(self, key: tuple, shape: tuple[int, ...]) -> np.ndarray:
        if key not in self.by:
            self.by[key] = np.zeros(shape)
            self.size += self.by[key].size
        return self.by[key]

    def told(self, names: list[str], types: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
        """Hands all sums over, a bounded number of them at a time, and forgets each as it goes."""
        while self.by:
            keys, packed, size = [], [], 0
            while self.by and size < TOLD:
                key, v = self.by.popitem()
                keys.append(key)
                packed.append(v.astype("<f8").tobytes())
                size += v.size
            yield pa.RecordBatch.from_arrays([*[pa.array([k[i] for k in keys], t) for i, t in enumerate(types)], pa.array(packed, pa.binary())], names=[*names, "v"])
        self.size = 0


def vector_sums(df: DataFrame, keys: dict[str, str], add: Callable[[dict, _Sums], None]) -> DataFrame:
    """``keys, v``: for each row ``add`` puts arrays into the sums; ``v`` is the packed sum of a key over all rows."""
    types = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Sums()
        for b in batches:
            for i in range(b.num_rows):                    # a row at a time: as Python objects a batch is several times its size
                add({n: b.column(n)[i].as_py() for n in b.schema.names}, held)
                if held.size > HELD:
                    yield from held.told(list(keys), [types[t] for t in keys.values()])
        yield from held.told(list(keys), [types[t] for t in keys.values()])

    parts = df.mapInArrow(run, ", ".join(f"{n} {t}" for n, t in keys.items()) + ", v binary")

    @F.pandas_udf("binary")
    def total(v: pd.Series) -> bytes:
        out = None
        for x in v:
            a = np.frombuffer(x, "<f8")
            out = a.copy() if out is None else out + a
        return out.tobytes() if out is not None else b""

    return parts.groupBy(*keys).agg(total("v").alias("v"))


def _floats(x: list) -> np.ndarray:
    return np.array([np.nan if v is None else v for v in x], dtype=np.float64)


def scores(sums: np.ndarray, min_regions: int) -> tuple[np.ndarray, np.ndarray]:
    """``mean_z`` and ``shape_r`` from the seven sums along the first axis; NaN below the floor or without spread."""
    n, z, d, dd, t, tt, dt = sums
    with np.errstate(divide="ignore", invalid="ignore"):
        mean = np.where(n >= min_regions, z / n, np.nan)
        vd, vt = dd - d * d / n, tt - t * t / n
        r = np.where((n >= min_regions) & (vd > 1e-15) & (vt > 1e-15), (dt - d * t / n) / np.sqrt(vd * vt), np.nan)
    return mean, r


def matched_null(observed: DataFrame, pool_values: DataFrame, draws: DataFrame, n_rep: int, min_regions: int = 5) -> DataFrame:
    """``sample_id, set_id, p_mean_z, p_shape_r, n_null``: (hits + 1) / (n + 1), two-sided for the mean and one-sided for the shape.

    ``observed``: sample_id, set_id, mean_z, shape_r. ``pool_values``: sample_id, region_id, b, mu, sd. ``draws``: set_id, rep, region_id, target.
    All replicates are summed in one pass over the pool. A null value within 1e-9 of the observed one counts as reaching it."""
    ok = F.col("b").isNotNull() & F.col("mu").isNotNull() & (F.col("sd") > 0)
    v = pool_values.select("sample_id", "region_id", F.when(ok, (F.col("b") - F.col("mu")) / F.col("sd")).alias("z"), F.when(ok, F.col("b") - F.col("mu")).alias("d"))
    hits = draws.groupBy("region_id").agg(F.collect_list(F.struct("set_id", "rep", "target")).alias("h"))
    hits = hits.select("region_id", F.col("h.set_id").alias("sets"), F.col("h.rep").alias("reps"), F.col("h.target").alias("targets"))
    work = blocks(v, "z", "d").join(hits, "region_id")

    def add(row: dict, held: _Sums) -> None:
        z, d = _floats(row["z"]), _floats(row["d"])
        there = np.isfinite(d)
        z, d = np.where(there, z, 0), np.where(there, d, 0)
        sets, reps, targets = np.array(row["sets"]), np.array(row["reps"]) - 1, np.array(row["targets"], dtype=np.float64)
        for s in np.unique(sets):
            mine = sets == s
            n, t, tt = (np.bincount(reps[mine], w, n_rep) for w in (None, targets[mine], targets[mine] ** 2))
            for k, sample in enumerate(row["sample_id"]):
                if there[k]:
                    held.at((sample, int(s)), (STATS, n_rep))[:] += np.stack((n, z[k] * n, d[k] * n, d[k] ** 2 * n, t, tt, d[k] * t))

    sums = vector_sums(work, {"sample_id": "long", "set_id": "long"}, add).join(observed, ["sample_id", "set_id"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                nz, nr = scores(np.frombuffer(r.v, "<f8").reshape(STATS, n_rep), min_regions)
                p = []
                for null, seen in ((np.abs(nz), None if pd.isna(r.mean_z) else abs(r.mean_z)), (nr, None if pd.isna(r.shape_r) else r.shape_r)):
                    null = null[~np.isnan(null)]
                    p.append(None if seen is None else float((np.sum(null >= seen - 1e-9) + 1) / (len(null) + 1)))
                out.append((r.sample_id, r.set_id, *p, int(np.sum(~np.isnan(nz)))))
            yield pd.DataFrame(out, columns=["sample_id", "set_id", "p_mean_z", "p_shape_r", "n_null"])

    return sums.mapInPandas(run, "sample_id long, set_id long, p_mean_z double, p_shape_r double, n_null long")


def bootstrap_shapes(values: DataFrame, sets: DataFrame, weights: DataFrame, scored: Column, n_rep: int, min_regions: int = 5) -> DataFrame:
    """``sample_id, set_id, rep, w, shape_r`` of the drawn controls and of the ``scored`` samples in every replicate of the controls.

    ``values``: sample_id, region_id, b. ``weights``: sample_id, w (times drawn per replicate). A control is measured against the drawn
    controls without one copy of itself, a scored sample against all of them. One pass sums the controls of each region, one the scores."""
    v = values.where(F.col("b").isNotNull()).join(weights, "sample_id", "left").withColumn("scored", F.coalesce(scored, F.lit(False))).where(F.col("w").isNotNull() | F.col("scored"))
    rows = blocks(v, "b", "w", "scored")

    def region_sums(row: dict, held: _Sums) -> None:
        total = held.at((row["region_id"],), (3, n_rep))
        for b, w, s in zip(row["b"], row["w"], row["scored"], strict=True):
            if w is not None and not s:
                w = np.array(w, dtype=np.float64)
                total += np.stack((w, w * b, w * b * b))

    per = vector_sums(rows, {"region_id": "long"}, region_sums).withColumnRenamed("v", "controls")
    mine = sets.groupBy("region_id").agg(F.collect_list(F.struct(F.col("set_id").cast("long").alias("set_id"), F.col("target").cast("double").alias("target"))).alias("s"))
    work = rows.join(per, "region_id").join(mine.select("region_id", F.col("s.set_id").alias("sets"), F.col("s.target").alias("targets")), "region_id")

    def score_sums(row: dict, held: _Sums) -> None:
        n, s, q = np.frombuffer(row["controls"], "<f8").reshape(3, n_rep)
        for sample, b, w, is_scored in zip(row["sample_id"], row["b"], row["w"], row["scored"], strict=True):
            own = 0.0 if is_scored else (np.array(w) > 0).astype(np.float64)
            m = n - own
            with np.errstate(divide="ignore", invalid="ignore"):
                mu = (s - own * b) / m
                var = ((q - own * b * b) - m * mu * mu) / (m - 1)
            ok = ((m > 1) & (var > 1e-15) & (True if is_scored else own > 0)).astype(np.float64)
            d = np.where(ok > 0, b - mu, 0.0)
            z = np.where(ok > 0, d / np.sqrt(np.where(ok > 0, var, 1.0)), 0.0)
            for k, t in zip(row["sets"], row["targets"], strict=True):
                if t is not None:
                    held.at((sample, k), (STATS, n_rep))[:] += np.stack((ok, z, d, d * d, t * ok, t * t * ok, d * t))

    sums = vector_sums(work, {"sample_id": "long", "set_id": "long"}, score_sums)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(r.sample_id, r.set_id, [None if np.isnan(x) else float(x) for x in scores(np.frombuffer(r.v, "<f8").reshape(STATS, n_rep), min_regions)[1]])
                                for r in b.itertuples(index=False)], columns=["sample_id", "set_id", "r"])

    out = sums.mapInPandas(run, "sample_id long, set_id long, r array<double>").join(weights, "sample_id", "left").withColumn("is_scored", F.coalesce(scored, F.lit(False)))
    out = out.select("sample_id", "set_id", "w", "is_scored", F.posexplode("r").alias("at", "shape_r"))
    return out.select("sample_id", "set_id", (F.col("at") + 1).alias("rep"), "is_scored", F.when(F.col("is_scored"), 0).otherwise(F.coalesce(F.get("w", F.col("at")), F.lit(0))).alias("w"), "shape_r")


def bootstrap_ranks(shapes: DataFrame) -> DataFrame:
    """``sample_id, set_id, rep, shape_r, rank, n``: place of each scored sample among the drawn controls, copies counted, highest first."""
    controls = shapes.where(~F.col("is_scored") & (F.col("w") > 0)).groupBy("set_id", "rep").agg(F.sum("w").alias("n"), F.collect_list(F.when(F.col("shape_r").isNotNull(), F.struct("shape_r", "w"))).alias("c"))
    d = shapes.where("is_scored").select("sample_id", "set_id", "rep", "shape_r").join(controls, ["set_id", "rep"])
    above = F.aggregate(F.filter("c", lambda x: x["shape_r"] > F.col("shape_r")), F.lit(0).cast("long"), lambda a, x: a + x["w"])
    return d.select("sample_id", "set_id", "rep", "shape_r", F.when(F.col("shape_r").isNotNull(), above + 1).alias("rank"), (F.col("n") + 1).alias("n"))
