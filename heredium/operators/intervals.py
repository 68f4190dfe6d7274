"""Interval operators on (chrom, start, end) tables, half-open unless said otherwise.

The overlap join is an equality join on hierarchical bins: level L has bins of
2^(14+3L) bases and an interval belongs to the first level whose bins are at
least as wide as it is, so it touches at most two bins there. A pair is formed
on the coarser of the two levels and kept in its first shared bin. An interval
therefore yields a few rows however long it is, and no pair needs a range
comparison against a whole chromosome.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import position_bin, scan

BASE_BITS, STEP_BITS, TOP = 14, 3, 7

# Bound conventions as half-open spans: name -> (start offset, end offset) applied to the stated pair.
HALF_OPEN = (0, 0)      # start <= x < end
CLOSED = (0, 1)         # start <= x <= end
LEFT_OPEN = (1, 1)      # start < x <= end


def _level(start: Column, end: Column) -> Column:
    out = F.lit(TOP)
    for lv in range(TOP - 1, -1, -1):
        out = F.when(end - start <= (1 << (BASE_BITS + STEP_BITS * lv)), lv).otherwise(out)
    return out


def _bin(pos: Column, level: Column) -> Column:
    return F.call_function("shiftright", pos.cast("long"), (F.lit(BASE_BITS) + F.lit(STEP_BITS) * level).cast("int"))


def _levels(df: DataFrame) -> list[int]:
    """The levels present in a side: at most eight small integers."""
    row = df.agg(F.collect_set("__lv").alias("s")).first()
    return sorted(row.s)


def _spread(df: DataFrame, start: str, end: str, levels: list[int], strict: bool, own: bool) -> DataFrame:
    """Rows of ``df`` once per (level, bin): its own level, or the listed levels at or above (above: ``strict``) it."""
    if own:
        d = df.withColumn("__l", F.col("__lv"))
    else:
        d = df.withColumn("__l", F.explode(_numbers(levels))).where(F.col("__l") >= F.col("__lv") + (1 if strict else 0))
    s, e = F.col(start), F.greatest(F.col(end) - 1, F.col(start))
    return d.withColumn("__b", F.explode(F.sequence(_bin(s, F.col("__l")), _bin(e, F.col("__l")))))


def _numbers(levels: list[int]) -> Column:
    return F.array(*[F.lit(x) for x in levels]) if levels else F.array().cast("array<int>")


def overlap_join(a: DataFrame, b: DataFrame, a_span: tuple[str, str] = ("start", "end"),
                 b_span: tuple[str, str] = ("b_start", "b_end"), keys: tuple[str, ...] = ("chrom",),
                 a_points: bool = False) -> DataFrame:
    """All overlapping pairs with the columns of both sides (``b`` has the keys and otherwise its own names).

    ``a_points`` says every left interval is at most one base-level bin long, which saves looking.
    """
    (sa, ea), (sb, eb) = a_span, b_span
    left = a.withColumn("__lv", F.lit(0) if a_points else _level(F.col(sa), F.col(ea)))
    right = b.withColumn("__lv", _level(F.col(sb), F.col(eb)))
    la = [0] if a_points else _levels(left)
    lb = _levels(right)

    def pairs(x: DataFrame, y: DataFrame) -> DataFrame:
        first = F.greatest(_bin(F.col(sa), F.col("__l")), _bin(F.col(sb), F.col("__l")))
        hit = x.join(y.drop("__lv"), [*keys, "__l", "__b"]).where(
            (F.col(sa) < F.col(eb)) & (F.col(sb) < F.col(ea)) & (F.col("__b") == first))
        return hit.select(*a.columns, *[c for c in b.columns if c not in keys])

    out = pairs(_spread(left, sa, ea, lb, False, False), _spread(right, sb, eb, [], False, True))
    if la and lb and max(la) > min(lb):
        out = out.unionByName(pairs(_spread(left, sa, ea, [], False, True), _spread(right, sb, eb, la, True, False)))
    return out


def point_join(points: DataFrame, b: DataFrame, pos: str = "pos", b_span: tuple[str, str] = ("b_start", "b_end"),
               bounds: tuple[int, int] = HALF_OPEN, keys: tuple[str, ...] = ("chrom",)) -> DataFrame:
    """Points inside intervals under a stated bound convention. A point lies in one bin of each level present, so a pair meets once."""
    q = b.withColumns({"__bs": F.col(b_span[0]) + bounds[0], "__be": F.col(b_span[1]) + bounds[1]})
    q = q.withColumn("__lv", _level(F.col("__bs"), F.col("__be")))
    levels = _levels(q)
    p = points.withColumn("__l", F.lit(levels[0]) if len(levels) == 1 else F.explode(_numbers(levels)))
    p = p.withColumn("__b", _bin(F.col(pos), F.col("__l")))
    hit = p.join(_spread(q, "__bs", "__be", [], False, True).drop("__lv"), [keys[0], "__b", "__l", *keys[1:]]).where((F.col("__bs") <= F.col(pos)) & (F.col(pos) < F.col("__be")))
    return hit.select(*points.columns, *[c for c in b.columns if c not in keys])


def point_filter(points: DataFrame, b: DataFrame, how: str, pos: str = "pos", b_span: tuple[str, str] = ("b_start", "b_end"),
                 bounds: tuple[int, int] = HALF_OPEN, keys: tuple[str, ...] = ("chrom",)) -> DataFrame:
    """``left_semi`` or ``left_anti`` of points against intervals, without an id: one bin join per interval level."""
    q = b.select(*keys, (F.col(b_span[0]) + bounds[0]).alias("__bs"), (F.col(b_span[1]) + bounds[1]).alias("__be"))
    q = q.withColumn("__lv", _level(F.col("__bs"), F.col("__be")))
    levels = _levels(q)
    if not levels:
        return points if how == "left_anti" else points.limit(0)
    out, hits = points, None
    for lv in levels:                              # each level sees the points no level before it has taken, so no point is taken twice
        side = _spread(q.where(F.col("__lv") == lv), "__bs", "__be", [], False, True).drop("__lv", "__l")
        left = out.withColumn("__pb", _bin(F.col(pos), F.lit(lv)))
        cond = [left[k] == side[k] for k in keys] + [left["__pb"] == side["__b"], side["__bs"] <= left[pos], left[pos] < side["__be"]]
        if how == "left_semi":
            part = left.join(side, cond, "left_semi").drop("__pb")
            hits = part if hits is None else hits.unionByName(part)
        out = left.join(side, cond, "left_anti").drop("__pb")
    return out if how == "left_anti" else hits


def interval_anti(a: DataFrame, b: DataFrame, id_cols: list[str], a_span: tuple[str, str] = ("start", "end"),
                  b_span: tuple[str, str] = ("b_start", "b_end"), keys: tuple[str, ...] = ("chrom",)) -> DataFrame:
    """Intervals of ``a`` touching nothing in ``b``."""
    hit = overlap_join(a.select(*id_cols, *[k for k in keys if k not in id_cols], *a_span),
                       b.select(*keys, *b_span), a_span, b_span, keys)
    return a.join(hit.select(*id_cols).distinct(), id_cols, "left_anti")


def overlap_length(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return F.least(a_end, b_end) - F.greatest(a_start, b_start)


def merge(df: DataFrame, keys: tuple[str, ...] = ("chrom",), start: str = "start", end: str = "end", pad: int = 0,
          extra: dict[str, Column] | None = None, bits: int = 20) -> DataFrame:
    """Union of overlapping or book-ended intervals; ``extra`` aggregates are computed per merged interval."""
    k = list(keys)
    d = df.withColumns({"__s": F.col(start) - pad, "__e": F.col(end) + pad})
    d = d.withColumn("__bin", position_bin(F.col("__s"), bits))
    order = ["__s", "__e"]
    d = scan(d, k, "__bin", order, F.col("__e"), "__before", "max", inclusive=False)
    opens = F.when(F.col("__before").isNull() | (F.col("__s") > F.col("__before")), 1).otherwise(0)
    d = scan(d, k, "__bin", order, opens, "__run", "sum")
    aggs = [F.min("__s").alias(start), F.max("__e").alias(end), *[c.alias(n) for n, c in (extra or {}).items()]]
    return d.groupBy(*k, "__run").agg(*aggs).drop("__run")


def covered_fraction(a: DataFrame, b: DataFrame, id_cols: list[str], a_span: tuple[str, str] = ("start", "end"),
                     b_span: tuple[str, str] = ("b_start", "b_end"), keys: tuple[str, ...] = ("chrom",)) -> DataFrame:
    """``id_cols, covered_bp``: bases of each ``a`` interval covered by the union of ``b``."""
    m = merge(b.select(*keys, *b_span), keys, *b_span)
    hit = overlap_join(a.select(*id_cols, *[k for k in keys if k not in id_cols], *a_span), m, a_span, b_span, keys)
    ov = overlap_length(F.col(a_span[0]), F.col(a_span[1]), F.col(b_span[0]), F.col(b_span[1]))
    return hit.groupBy(*id_cols).agg(F.sum(ov).alias("covered_bp"))


def reciprocal(hit: DataFrame, a_span: tuple[str, str], b_span: tuple[str, str], frac: float = 0.5) -> DataFrame:
    """Keeps pairs whose overlap reaches ``frac`` of each length."""
    s, e, bs, be = (F.col(c) for c in (*a_span, *b_span))
    ov = overlap_length(s, e, bs, be)
    return hit.where((ov >= frac * (e - s)) & (ov >= frac * (be - bs)))


def nearest_points(queries: DataFrame, points: DataFrame, pos: str = "pos", point_pos: str = "pos",
                   keys: tuple[str, ...] = ("chrom",), bits: int = 20) -> DataFrame:
    """Adds ``prev_point``, ``next_point`` and ``dist_point`` (NULL when the key has no point)."""
    k = list(keys)
    q = queries.withColumns({"__q": F.lit(1), "__at": F.col(pos), "__pt": F.lit(None).cast("long")})
    p = points.select(*k, F.lit(0).alias("__q"), F.col(point_pos).alias("__at"), F.col(point_pos).cast("long").alias("__pt")).distinct()
    u = q.unionByName(p, allowMissingColumns=True).withColumn("__bin", position_bin(F.col("__at"), bits))
    u = scan(u, k, "__bin", ["__at", "__q"], F.col("__pt"), "prev_point", "last")
    u = u.withColumn("__o", 1 - F.col("__q"))
    u = scan(u, k, "__bin", ["__at", "__o"], F.col("__pt"), "next_point", "first_after")
    d = F.least(F.col(pos) - F.col("prev_point"), F.col("next_point") - F.col(pos))
    return u.where("__q = 1").withColumn("dist_point", d).select(*queries.columns, "prev_point", "next_point", "dist_point")


def nearest_segment(queries: DataFrame, segments: DataFrame, id_cols: list[str], margin: int, payload: list[str],
                    pos: str = "pos", b_span: tuple[str, str] = ("b_start", "b_end"), keys: tuple[str, ...] = ("chrom",),
                    tie: list[str] | None = None) -> DataFrame:
    """``id_cols``, ``seg_dist`` and the payload of the closest closed segment within ``margin`` (0 when inside)."""
    p = queries.withColumns({"__ps": F.col(pos) - margin, "__pe": F.col(pos) + margin + 1})
    q = segments.withColumn("__be", F.col(b_span[1]) + 1)
    hit = overlap_join(p, q, ("__ps", "__pe"), (b_span[0], "__be"), keys)
    dist = F.greatest(F.col(b_span[0]) - F.col(pos), F.col(pos) - F.col(b_span[1]), F.lit(0))
    best = F.min_by(F.struct(*payload), F.struct(F.col("__d"), *(tie or [b_span[0]])))
    out = hit.withColumn("__d", dist).groupBy(*id_cols).agg(F.min("__d").alias("seg_dist"), best.alias("__p"))
    return out.select(*id_cols, "seg_dist", *[F.col(f"__p.{c}").alias(c) for c in payload])


def binned_coverage(reads: DataFrame, keys: list[str], category: str, categories: list[str], width: int = 1000,
                    start: str = "ref_start", end: str = "ref_end", bits: int = 10) -> DataFrame:
    """Mean depth per bin and category: each read adds its overlap to every bin it touches.

    Reads move, not their bins: they go to cells of ``2 ** bits`` bins and are cut into bins there, so the sums need no further shuffle."""
    w = width
    first, last = F.floor(F.col(start) / w), F.floor((F.col(end) - 1) / w)
    cells = F.explode(F.sequence(F.shiftright(first, bits), F.shiftright(last, bits)))
    d = reads.select(*keys, F.col(category).alias("__c"), F.col(start).alias("__s"), F.col(end).alias("__e"), cells.alias("__cell")).repartition(*keys, "__cell")
    inside = F.sequence(F.greatest(F.floor(F.col("__s") / w), F.shiftleft("__cell", bits)), F.least(F.floor((F.col("__e") - 1) / w), F.shiftleft(F.col("__cell") + 1, bits) - 1))
    d = d.withColumn("bin", F.explode(inside))
    ov = F.least(F.col("__e"), (F.col("bin") + 1) * w) - F.greatest(F.col("__s"), F.col("bin") * w)
    return (
        d.groupBy(*keys, "__cell", "bin")
        .agg(*[(F.sum(F.when(F.col("__c") == c, ov).otherwise(0)) / w).alias(f"dp_{c}") for c in categories])
        .withColumns({"start": F.col("bin") * w, "end": (F.col("bin") + 1) * w}).drop("__cell", "bin")
    )


def low_runs(df: DataFrame, keys: list[str], pos: str, low: Column, max_gap: int, bits: int = 20) -> DataFrame:
    """Runs of rows where ``low`` holds, broken by a gap above ``max_gap``: start, end (last position) and count."""
    d = df.where(low).withColumn("__bin", position_bin(F.col(pos), bits))
    d = scan(d, keys, "__bin", [pos], F.col(pos), "__prev", "last", inclusive=False)
    opens = F.when(F.col("__prev").isNull() | (F.col(pos) - F.col("__prev") > max_gap), 1).otherwise(0)
    d = scan(d, keys, "__bin", [pos], opens, "__run", "sum")
    return d.groupBy(*keys, "__run").agg(F.min(pos).alias("start"), F.max(pos).alias("end"), F.count("*").alias("n")).drop("__run")
