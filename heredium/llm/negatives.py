"""Hard-negative mining by threshold joins over a norm-bounded inverted index.

Vectors become integers. Rows are dealt over slices and anchors over blocks, both of bounded size, and
each (slice, block) cell is one group. In a cell the rows are indexed by dimension, those with most
mass first: the dimensions from the place on where a row's suffix norm times the largest anchor norm
is under the threshold are left out of the lists. An anchor accumulates partial scores list by list;
a row is dropped once its partial score plus the product of the remaining norms is under the anchor's
threshold, and what is left is scored exactly in integers. Thresholds start high and are lowered, for
the anchors that need it, until their windows are full or the window's end is reached.

First each anchor's positives are found, then for each of them the rows of other labels inside its
window. Either search runs over one slice in ``SEED`` first; the scores that fill a window there are
thresholds for all other slices, so that these return little. No cell returns more than the rows asked
for an anchor and window, and results of cells are ranked together.

Rows with a null label or vector, or a null or non-finite component, take no part. A row without
``vec_id`` is no anchor; it can be a positive or a negative, after others of equal score. Rows that
agree in id, label and vector are one row; rows that share only the id are rows of their own, and are
no positives or negatives of an anchor with that id. Shorter vectors count as followed by zeros. A
component whose integer does not fit 32 bits is refused with an error. Extra columns are ignored. An
empty table, or one without anchors, gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import cut
from .frames import partitions

POSITIVES, NEGATIVES = 5, 5
LOW, HIGH = 80, 100                  # a negative's score against its positive's, in hundredths
SLICE, BLOCK = 1 << 18, 1 << 18      # rows and anchors of a cell at most, about
LEAST = 1 << 12                      # rows for which a slice of their own is worth while
SEED = 16
STEP, AT_ONCE, GUESS = 8, 64, 64     # dimensions of a list, anchors accumulated together, rows that guess a threshold
_NONE = np.iinfo(np.int64).min


def integer_rows(table: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, label, tie, v (little-endian 32-bit integers): rows that take part, each once."""
    x = F.col("embedding")
    usable = F.col("label").isNotNull() & x.isNotNull() & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = table.where(F.coalesce(usable, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
                                                                F.transform(x, lambda c: c.cast("double")).alias("v"))

    def run(batches):
        for b in batches:
            lists = b.column("v")
            flat = np.floor(np.asarray(lists.flatten(), dtype=np.float64) * scale)
            if len(flat) and np.abs(flat).max() >= 1 << 31:
                raise ValueError("a component does not fit 32 bits after scaling")
            raw = flat.astype("<i4").tobytes()
            ends = np.concatenate(([0], np.cumsum(np.asarray(lists.value_lengths(), dtype=np.int64)))) * 4
            v = [raw[s:e] for s, e in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array(v, pa.binary())], names=["vec_id", "label", "v"])

    return rows.mapInArrow(run, "vec_id long, label long, v binary").distinct().withColumn("tie", F.xxhash64("label", "v"))


def matrix(packed: pa.ChunkedArray) -> np.ndarray:
    """One row of integers per vector, padded with zeros to the longest."""
    vs = packed.to_pylist()
    width = max((len(v) for v in vs), default=0) // 4
    if all(len(v) == 4 * width for v in vs):
        return np.frombuffer(b"".join(vs), "<i4").reshape(len(vs), width)
    out = np.zeros((len(vs), width), "<i4")
    for i, v in enumerate(vs):
        out[i, : len(v) // 4] = np.frombuffer(v, "<i4")
    return out


def products(a: np.ndarray, x: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows ``i`` of ``a`` and ``j`` of ``x``."""
    out = np.empty(len(i), np.int64)
    for lo in range(0, len(i), 1 << 16):
        part = slice(lo, lo + (1 << 16))
        out[part] = np.einsum("pd,pd->p", a[i[part]].astype(np.int64), x[j[part]].astype(np.int64))
    return out


class Index:
    """Lists by dimension over some rows, cut by suffix norms for the threshold of each search."""

    def __init__(self, x: np.ndarray):
        self.dims = np.argsort(-(x.astype(np.float64) ** 2).sum(0), kind="stable")
        self.ints = x[:, self.dims]
        self.rest = self._rest(self.ints)
        # Partial sums are integers: exact in 32-bit floats while norms allow, in 64-bit ones far beyond.
        self.kind = np.float32 if len(x) == 0 or self.rest[:, 0].max() < 2048 else np.float64
        self.x = self.ints.astype(self.kind)

    @staticmethod
    def _rest(x: np.ndarray) -> np.ndarray:
        """Norm of the dimensions from each place on."""
        squares = np.cumsum((x.astype(np.float64) ** 2)[:, ::-1], axis=1)[:, ::-1]
        return np.sqrt(np.concatenate((squares, np.zeros((len(x), 1))), axis=1))

    def hits(self, a: np.ndarray, least: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(anchor, row, score) of the pairs with least <= score < below, thresholds being by anchor."""
        out = [self._some(a[lo: lo + AT_ONCE], least[lo: lo + AT_ONCE], below[lo: lo + AT_ONCE], lo) for lo in range(0, len(a), AT_ONCE)]
        return tuple(np.concatenate(z) for z in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3

    def _some(self, a, least, below, first):
        a = a[:, self.dims]
        norms = self._rest(a)
        n, d = self.x.shape
        kind = self.kind if norms[:, 0].max() < 4096 else np.float64
        lowest, most = float(least.min()), float(norms[:, 0].max())
        need = lowest / most if most and lowest > 0 else 0.0
        ends = -(-(self.rest[:, :d] >= need * (1 - 1e-9)).sum(1) // STEP) * STEP      # dimensions listed, in steps; the suffix is omitted
        order = np.argsort(-ends, kind="stable")
        x, rest, ends = self.x[order], self.rest[order], np.minimum(ends[order], d)
        listed = int((ends > 0).sum())
        score = np.zeros((len(a), listed), kind)
        q, bar = a.astype(kind), least.astype(np.float64)[:, None]
        alive = None
        for k in range(0, d, STEP):
            m = int((ends > k).sum())                    # the list of these dimensions
            if not m:
                break
            score[:, :m] += q[:, k: k + STEP] @ x[:m, k: k + STEP].T
            to = min(k + STEP, d)
            if 2 * to >= d and (to == d or (to // STEP) % 2 == 0):
                at = np.minimum(ends[:listed], to)
                left = norms[:, at] * rest[np.arange(listed), at]
                alive = score + left * (1 + 1e-6) + 0.5 >= bar
                if alive.mean() < 1 / 32:
                    break
        if alive is None:
            at = ends[:listed]
            alive = score + norms[:, at] * rest[np.arange(listed), at] * (1 + 1e-6) + 0.5 >= bar
        i, j = np.nonzero(alive)
        j = order[j]
        s = products(a, self.ints, i, j)
        ok = (s >= least[i]) & (s < below[i])
        return i[ok] + first, j[ok], s[ok]


def _levels(low: np.ndarray, high: np.ndarray) -> list[np.ndarray]:
    """Thresholds from high to low: two between, then the low end itself."""
    gap = np.where(low == _NONE, 0, high - low)
    return [np.where(low == _NONE, high, low + (gap * 2) // 5), np.where(low == _NONE, high // 2, low + gap // 6), low]


def _first(anchor: np.ndarray, score: np.ndarray, ids: np.ndarray, ties: np.ndarray, n: int) -> np.ndarray:
    """Positions of the first ``n`` of each anchor: highest score, then smallest id, then tie."""
    order = np.lexsort((ties, ids, -score, anchor))
    a = anchor[order]
    starts = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1]))) if len(a) else np.zeros(0, np.int64)
    rank = np.arange(len(a)) - np.repeat(starts, np.diff(np.append(starts, len(a))))
    return order[rank < n]


def _columns(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids (null: the largest number), their presence, ties, labels."""
    ids = t.column("vec_id").combine_chunks()
    return np.asarray(ids.fill_null(np.iinfo(np.int64).max)), np.asarray(ids.is_valid()), np.asarray(t.column("tie")), np.asarray(t.column("label"))


_HIT = [("anchor_id", pa.int64()), ("anchor_tie", pa.int64()), ("window", pa.int32()), ("other_id", pa.int64()), ("other_tie", pa.int64()), ("score", pa.int64())]
HIT = "anchor_id long, anchor_tie long, window int, other_id long, other_tie long, score long"


def _told(anchor_id, anchor_tie, window, ids, there, ties, score) -> pa.Table:
    other = pa.array(ids, pa.int64(), mask=~there)
    return pa.table([pa.array(anchor_id, pa.int64()), pa.array(anchor_tie, pa.int64()), pa.array(window, pa.int32()), other, pa.array(ties, pa.int64()), pa.array(score, pa.int64())],
                    schema=pa.schema(_HIT))


def _width(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = max(a.shape[1], x.shape[1])
    return tuple(np.pad(z, ((0, 0), (0, d - z.shape[1]))) if z.shape[1] < d else z for z in (a, x))


def _positives(rows: pa.Table, anchors: pa.Table, n: int) -> pa.Table:
    """The first ``n`` rows of the anchor's label in this slice; ``floors[0]`` of an anchor is a score that ``n`` rows elsewhere reach."""
    ids, there, ties, labels = _columns(rows)
    a_ids, _, a_ties, a_labels = _columns(anchors)
    a, x = _width(matrix(anchors.column("v")), matrix(rows.column("v")))
    floors = np.array([f[0] if f and f[0] is not None else _NONE for f in anchors.column("floors").to_pylist()], np.int64)
    out = []
    for label in np.unique(a_labels):
        mine, those = np.flatnonzero(a_labels == label), np.flatnonzero(labels == label)
        if not len(those):
            continue
        index = Index(x[those])
        some = those[:GUESS]
        i, j = np.repeat(np.arange(len(mine)), len(some)), np.tile(some, len(mine))
        s = products(a[mine], x, i, j)
        s[ids[j] == a_ids[mine][i]] = _NONE
        s = s.reshape(len(mine), len(some))
        low = np.sort(s, axis=1)[:, -n] if len(some) >= n else np.full(len(mine), _NONE)
        low = np.maximum(low, floors[mine])
        norms = np.sqrt((a[mine].astype(np.float64) ** 2).sum(1)) * (index.rest[:, 0].max() if len(those) else 0)
        high = np.maximum(norms.astype(np.int64) + 1, low)
        below, open_ = np.full(len(mine), np.iinfo(np.int64).max), np.arange(len(mine))
        held: list[tuple[np.ndarray, ...]] = []
        for level in _levels(low, high):
            if not len(open_):
                break
            i, j, s = index.hits(a[mine[open_]], level[open_], below[open_])
            i, j = open_[i], those[j]
            ok = ids[j] != a_ids[mine[i]]
            held.append((i[ok], j[ok], s[ok]))
            full = np.bincount(np.concatenate([h[0] for h in held]), minlength=len(mine)) >= n
            below[open_] = level[open_]
            open_ = open_[~full[open_] & (level[open_] > low[open_])]
        i, j, s = (np.concatenate(z) for z in zip(*held, strict=True))
        keep = _first(i, s, ids[j], ties[j], n)
        i, j, s = mine[i[keep]], j[keep], s[keep]
        out.append(_told(a_ids[i], a_ties[i], np.zeros(len(i), np.int32), ids[j], there[j], ties[j], s))
    return pa.concat_tables(out) if out else pa.schema(_HIT).empty_table()


def _negatives(rows: pa.Table, anchors: pa.Table, n: int, low: int, high: int) -> pa.Table:
    """For each window of an anchor the first ``n`` rows of other labels in this slice; ``floors`` are scores by window that ``n`` rows elsewhere reach."""
    ids, there, ties, labels = _columns(rows)
    a_ids, _, a_ties, a_labels = _columns(anchors)
    a, x = _width(matrix(anchors.column("v")), matrix(rows.column("v")))
    scores, floors = anchors.column("scores").to_pylist(), anchors.column("floors").to_pylist()
    # Windows with whole ends: from the smallest integer that reaches ``low`` hundredths to the largest within ``high``.
    windows = [[(w, max(-((-low * p) // 100), f[w] if f and f[w] is not None else _NONE), (high * p) // 100) for w, p in enumerate(ps)]
               for ps, f in zip(scores, floors, strict=True)]
    windows = [[w for w in ws if w[1] <= w[2]] for ws in windows]
    mine = np.array([i for i, ws in enumerate(windows) if ws], np.int64)
    if not len(mine) or not len(x):
        return pa.schema(_HIT).empty_table()
    index = Index(x)
    bottom = np.array([min(w[1] for w in windows[i]) for i in mine], np.int64)
    below = np.array([max(w[2] for w in windows[i]) for i in mine], np.int64) + 1
    levels, open_ = _levels(bottom, below - 1), np.arange(len(mine))
    held: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in mine]
    for level in levels:
        if not len(open_):
            break
        i, j, s = index.hits(a[mine[open_]], level[open_], below[open_])
        i = open_[i]
        ok = (labels[j] != a_labels[mine[i]]) & (ids[j] != a_ids[mine[i]])
        i, j, s = i[ok], j[ok], s[ok]
        order = np.argsort(i, kind="stable")
        i, j, s = i[order], j[order], s[order]
        cuts = np.searchsorted(i, np.append(open_, len(mine)))
        still = []
        for k, o in enumerate(open_):
            lo, hi = cuts[k], np.searchsorted(i, o, side="right")
            held[o].append((j[lo:hi], s[lo:hi]))
            got, t = np.concatenate([h[1] for h in held[o]]), level[o]
            if any(t > lo_w and np.count_nonzero((got >= lo_w) & (got <= hi_w)) < n for _, lo_w, hi_w in windows[mine[o]]):
                still.append(o)
        below[open_] = level[open_]
        open_ = np.array(still, np.int64)
    out = []
    for o, m in enumerate(mine):
        j, s = (np.concatenate(z) for z in zip(*held[o], strict=True))
        for w, lo_w, hi_w in windows[m]:
            inside = np.flatnonzero((s >= lo_w) & (s <= hi_w))
            if len(inside):
                keep = inside[_first(np.zeros(len(inside), np.int64), s[inside], ids[j[inside]], ties[j[inside]], n)]
                out.append((np.full(len(keep), m), np.full(len(keep), w), j[keep], s[keep]))
    if not out:
        return pa.schema(_HIT).empty_table()
    m, w, j, s = (np.concatenate(z) for z in zip(*out, strict=True))
    return _told(a_ids[m], a_ties[m], w, ids[j], there[j], ties[j], s)


def _ranked(hits: DataFrame, n: int) -> DataFrame:
    order = W.partitionBy("anchor_id", "anchor_tie", "window").orderBy(F.desc("score"), F.asc_nulls_last("other_id"), "other_tie")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def _search(rows: DataFrame, anchors: DataFrame, slices: int, blocks: int, kernel, n: int) -> DataFrame:
    """First ``n`` hits of each anchor and window over all slices: some slices first, whose scores are thresholds for the others."""
    empty = anchors.withColumn("floors", F.lit(None).cast("array<long>"))

    def cells(which: list[int], asked: DataFrame) -> DataFrame:
        left = rows.where(F.col("slice").isin(which)).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        right = asked.withColumn("slice", F.explode(F.array(*map(F.lit, which))))
        right = right.select(*[F.col(c).alias(c) for c in right.columns])              # both sides come from one table
        return left.groupBy("slice", "block").cogroup(right.groupBy("slice", "block")).applyInArrow(
            lambda x, y: kernel(x, y) if x.num_rows and y.num_rows else pa.schema(_HIT).empty_table(), HIT)

    seed, others = [s for s in range(slices) if s % SEED == 0], [s for s in range(slices) if s % SEED]
    found = cut(_ranked(cells(seed, empty), n).drop("rank"))
    if not others:
        return _ranked(found, n)
    full = found.groupBy("anchor_id", "anchor_tie", "window").agg(F.count("*").alias("k"), F.min("score").alias("low")).where(F.col("k") == n)
    by = full.groupBy("anchor_id", "anchor_tie").agg(F.map_from_entries(F.collect_list(F.struct("window", "low"))).alias("lows"))
    known = anchors.join(by, (F.col("vec_id") == F.col("anchor_id")) & (F.col("tie") == F.col("anchor_tie")), "left")
    known = known.withColumn("floors", F.transform(F.sequence(F.lit(0), F.lit(POSITIVES_MAX)), lambda w: F.try_element_at("lows", w))).drop("lows", "anchor_id", "anchor_tie")
    return _ranked(found.unionByName(cells(others, known)), n)


POSITIVES_MAX = 63                   # windows of an anchor at most


def mined(table: DataFrame, anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = 256,
          slice_rows: int = SLICE, block_rows: int = BLOCK, least: int = LEAST) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. ``anchor``: which rows are anchors, by ``vec_id`` and ``label``."""
    if not 1 <= positives <= POSITIVES_MAX + 1:
        raise ValueError("between 1 and 64 positives")
    spark = table.sparkSession
    rows = cut(integer_rows(table, scale))
    n = rows.count()
    is_anchor = F.coalesce(anchor, F.lit(False)) & F.col("vec_id").isNotNull()
    n_anchors = rows.where(is_anchor).count()
    slices = max(1, -(-n // slice_rows), min(partitions(spark), -(-n // least)))
    blocks = max(1, -(-n_anchors // block_rows))
    dealt = rows.withColumn("slice", F.pmod(F.xxhash64("vec_id", "tie"), F.lit(slices)).cast("int"))
    anchors = rows.where(is_anchor).withColumn("block", F.pmod(F.xxhash64("tie", "vec_id"), F.lit(blocks)).cast("int"))
    pos = cut(_search(dealt, anchors, slices, blocks, lambda x, y: _positives(x, y, positives), positives))
    windows = pos.groupBy("anchor_id", "anchor_tie").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "score"))), lambda p: p["score"]).alias("scores"))   # at most ``positives``
    asked = cut(anchors.join(windows, (F.col("vec_id") == F.col("anchor_id")) & (F.col("tie") == F.col("anchor_tie"))).drop("anchor_id", "anchor_tie"))
    neg = _search(dealt, asked, slices, blocks, lambda x, y: _negatives(x, y, negatives, low, high), negatives)
    p = pos.select("anchor_id", "anchor_tie", (F.col("rank") - 1).cast("int").alias("window"), F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return neg.join(p, ["anchor_id", "anchor_tie", "window"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("other_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mined(table.withColumn("label", label), F.col("vec_id") % 100 == 0)


OP11_SQL = """
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
           WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score FROM r a, r b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5),
n AS (SELECT p.anchor_id, p.other_id AS positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.other_id ORDER BY s.score DESC, s.other_id)::INTEGER AS rank,
             s.other_id AS negative_id, p.score AS positive_score, s.score AS negative_score
      FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score)
SELECT * FROM n WHERE rank <= 5
"""
