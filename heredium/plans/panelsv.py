"""Structural-variant matching between call sets and panels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import intervals as iv
from ..operators import selection as sel


def match_sv(events: DataFrame, panel: DataFrame, tol: int = 500, pct: float = 0.10, ro: float = 0.5) -> DataFrame:
    """Pairs of one match class agreeing on a boundary, on length or by reciprocal overlap of the longer, with the basis.

    ``events`` has ``chrom, cls, pos, stop, len`` (an insertion has stop = pos), ``panel`` the same as ``p_*``. The
    panel start must lie within length + tolerance of the event, so a length-only match is a local one.
    """
    a = events.withColumns({"__s": F.col("pos") - F.col("len") - tol, "__e": F.col("stop") + tol + 1})
    b = panel.withColumns({"__bs": F.col("p_pos"), "__be": F.col("p_pos") + 1})
    hit = iv.overlap_join(a, b, ("__s", "__e"), ("__bs", "__be"), ("chrom", "cls"))
    spans = (F.col("stop") > F.col("pos")) & (F.col("p_stop") > F.col("p_pos"))
    ov = F.least("stop", "p_stop") - F.greatest("pos", "p_pos")
    longer = F.greatest(F.col("stop") - F.col("pos"), F.col("p_stop") - F.col("p_pos"), F.lit(1))
    close_len = F.abs(F.col("p_len") - F.col("len")) <= F.greatest(F.lit(tol), F.floor(F.round(pct * F.col("len"), 6)))
    basis = F.concat_ws(
        "+", F.when(F.abs(F.col("p_pos") - F.col("pos")) <= tol, "left"),
        F.when(spans & (F.abs(F.col("p_stop") - F.col("stop")) <= tol), "right"),
        F.when((F.col("len") > 0) & (F.col("p_len") > 0) & close_len, "length"),
        F.when(spans & (ov > 0) & (ov / longer >= ro), "ro"))
    return hit.withColumn("basis", basis).where("basis <> ''").drop("__s", "__e", "__bs", "__be")


def match_start_size(events: DataFrame, other: DataFrame, window: int = 500, ratio: float = 0.7) -> DataFrame:
    """Pairs of one type whose starts are within ``window`` and whose sizes agree by ``ratio``; adds ``dpos``."""
    a = events.withColumns({"__s": F.col("pos") - window, "__e": F.col("pos") + window + 1})
    b = other.withColumns({"__bs": F.col("o_pos"), "__be": F.col("o_pos") + 1})
    hit = iv.overlap_join(a, b, ("__s", "__e"), ("__bs", "__be"), ("chrom", "svtype"), a_points=2 * window < 1 << iv.BASE_BITS)
    ok = F.least("len", "o_len") >= ratio * F.greatest("len", "o_len")
    return hit.where(ok).withColumn("dpos", F.abs(F.col("pos") - F.col("o_pos"))).drop("__s", "__e", "__bs", "__be")


def match_baseline(events: DataFrame, baseline: DataFrame, id_cols: list[str], base_id: str, tol: int = 500, ro: float = 0.5) -> DataFrame:
    """Best baseline event per event: both ends within ``tol`` (0), reciprocal overlap for interval types (1), start only (2)."""
    a = events.withColumns({"__s": F.col("start") - tol, "__e": F.col("end") + tol})
    hit = iv.overlap_join(a, baseline, ("__s", "__e"), ("b_start", "b_end"))
    either = F.col("svtype").isin("INS", "DUP") & F.col("b_type").isin("INS", "DUP")
    hit = hit.where((F.col("svtype") == F.col("b_type")) | either)
    near_s = F.abs(F.col("start") - F.col("b_start")) <= tol
    near_e = F.abs(F.col("end") - F.col("b_end")) <= tol
    n, m = F.col("end") - F.col("start"), F.col("b_end") - F.col("b_start")
    ov = iv.overlap_length(F.col("start"), F.col("end"), F.col("b_start"), F.col("b_end"))
    rec = (ov > 0) & (ov >= ro * n) & (ov >= ro * m)
    basis = F.when(near_s & near_e, 0).when(F.col("svtype").isin("DEL", "DUP", "INV"), F.when(rec, 1)).when(near_s, 2)
    hit = hit.withColumn("basis", basis).where("basis IS NOT NULL")
    return sel.best_per_key(hit, id_cols, [F.col("basis"), F.col(base_id)], [base_id, "basis"])


def panel_max_ac(events: DataFrame, panel: DataFrame, id_cols: list[str], frac: float = 0.5) -> DataFrame:
    """Largest panel allele count over reciprocal matches from other families, 0 without a match."""
    hit = iv.overlap_join(events, panel, keys=("chrom", "svtype")).where("p_family <> family_id")
    best = iv.reciprocal(hit, ("start", "end"), ("b_start", "b_end"), frac).groupBy(*id_cols).agg(F.max("ac").alias("__m"))
    return events.join(best, id_cols, "left").withColumn("max_ac", F.coalesce("__m", F.lit(0).cast("long"))).drop("__m")
