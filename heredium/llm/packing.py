"""Best-fit packing by exact-complement hashing.

Documents become pieces of at most ``capacity`` tokens. What is packed is the histogram of piece
lengths, which has at most ``capacity`` entries however many documents there are: a hash index of the
lengths on hand answers, for each gap, which single length, pair sum or triple sum fills it exactly,
and as many copies of the combination as the counts allow are consumed at once. What cannot be
completed exactly is packed best-fit, longest first. The plan is a bounded list of patterns with
multiplicities. Pieces then take their places by their rank among the pieces of their length; ranks
are counted in buckets, so that a length held by a third of all rows is not one task.

Null texts count as empty (one piece: the end id). Repeated rows are packed like any other; a null
``doc_id`` stays null. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import cut
from .frames import documents, partitions, text_of
from .tokens import encoded, vocabulary

CAPACITY, END = 4096, 1


def pieces(docs: DataFrame, vocab: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32. A document's ids are followed by ``end``."""
    tail, width = np.asarray([end], dtype="<u4").tobytes(), 4 * capacity

    def run(batches):
        for b in batches:
            doc = b.column("doc_id").to_pylist()
            rows: list[tuple] = []
            for i, ids in encoded(vocab, b.column("text").to_pylist()):
                raw = ids + tail
                rows.extend((doc[i], k, at // 4, min(width, len(raw) - at) // 4, zlib.crc32(raw[at: at + width])) for k, at in enumerate(range(0, len(raw), width)))
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return text_of(docs).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


class _Stock:
    """Counts by length, and the lengths on hand in order."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.n = np.zeros(capacity + 1, dtype=np.int64)
        for k, v in counts.items():
            self.n[k] = v
        self.order = np.flatnonzero(self.n)

    def take(self, lengths: tuple[int, ...], times: int) -> None:
        for x in lengths:
            self.n[x] -= times
        if any(not self.n[x] for x in lengths):
            self.order = self.order[self.n[self.order] > 0]

    def times(self, lengths: tuple[int, ...]) -> int:
        """How often all these lengths can be taken together."""
        return min(int(self.n[x]) // lengths.count(x) for x in lengths)

    def pair(self, total: int, most: int) -> tuple[int, int] | None:
        """Two lengths on hand with this sum, the longer one as long as it can be but at most ``most``."""
        a = self.order[np.searchsorted(self.order, (total + 1) // 2): np.searchsorted(self.order, min(most, total - 1), side="right")]
        ok = np.flatnonzero((self.n[a] > 0) & (self.n[total - a] > (2 * a == total)))
        return (int(a[ok[-1]]), total - int(a[ok[-1]])) if len(ok) else None

    def complement(self, gap: int, held: int) -> tuple[int, ...] | None:
        """One, two or three lengths on hand that sum to ``gap``, the fewest and longest first, one ``held`` being taken."""
        self.n[held] -= 1
        try:
            if self.n[gap] > 0:
                return (gap,)
            if found := self.pair(gap, gap):
                return found
            for a in map(int, self.order[np.searchsorted(self.order, (gap + 2) // 3): np.searchsorted(self.order, gap - 1)][::-1]):
                if self.n[a] > 0:
                    self.n[a] -= 1
                    rest = self.pair(gap - a, a)
                    self.n[a] += 1
                    if rest:
                        return a, *rest
            return None
        finally:
            self.n[held] += 1


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths and how many sequences follow each; their sums never exceed ``capacity``."""
    stock, out = _Stock(counts, capacity), []
    left: dict[int, int] = {}
    while len(stock.order):                              # longest first: fill its gap exactly or put it aside
        x = int(stock.order[-1])
        if x == capacity:
            pattern: tuple[int, ...] | None = (x,)
        else:
            found = stock.complement(capacity - x, x)
            pattern = (x, *found) if found else None
        if pattern is None:
            left[x] = int(stock.n[x])
            stock.take((x,), left[x])
            continue
        k = stock.times(pattern)
        out.append((pattern, k))
        stock.take(pattern, k)
    # Best fit: the longest opens a sequence, the longest that still fits goes in, as often as counts allow.
    open_gaps: list[tuple[int, tuple[int, ...], int]] = []   # (gap, pattern, sequences) by gap
    for x, n in sorted(left.items(), reverse=True):
        while n:
            i = bisect_left(open_gaps, (x,))
            if i == len(open_gaps):
                room = capacity // x
                full, rest = divmod(n, room)
                if full:
                    insort(open_gaps, (capacity - room * x, (x,) * room, full))
                if rest:
                    insort(open_gaps, (capacity - rest * x, (x,) * rest, 1))
                break
            gap, pattern, m = open_gaps.pop(i)
            k = min(n, m)
            if m > k:
                insort(open_gaps, (gap, pattern, m - k))
            insort(open_gaps, (gap - x, (*pattern, x), k))
            n -= k
    return out + [(p, m) for _, p, m in open_gaps]


def _places(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int, int, int]]:
    """(length, first rank, ranks, first sequence, copies in a sequence, offset of the first copy, pattern) of each run of places."""
    used: dict[int, int] = {}
    out, sequence = [], 0
    for p, (pattern, m) in enumerate(patterns):
        at = 0
        for x in dict.fromkeys(pattern):
            c = pattern.count(x)
            out.append((x, used.get(x, 0), m * c, sequence, c, at, p))
            used[x] = used.get(x, 0) + m * c
            at += c * x
        sequence += m
    return out


def pack(table: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces; ``table`` is read three times and should be materialised."""
    spark = table.sparkSession
    counts = {r.length: r.n for r in table.groupBy("length").agg(F.count("*").alias("n")).collect()}   # at most ``capacity`` rows
    places = _places(plan(counts, capacity))
    # Rank within a length: buckets of the rows, a running count over buckets, a window inside each bucket.
    width = max(1, partitions(spark))
    order = [F.col("doc_id").asc_nulls_first(), F.col("piece"), F.col("ids_crc32"), F.col("start")]
    t = table.withColumn("__b", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(width)).cast("int"))
    per = t.groupBy("length", "__b").agg(F.count("*").alias("__n"))
    before = per.withColumn("__before", F.coalesce(F.sum("__n").over(W.partitionBy("length").orderBy("__b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    ranked = t.withColumn("__r", F.row_number().over(W.partitionBy("length", "__b").orderBy(*order)) - 1)
    ranked = ranked.join(before, ["length", "__b"]).withColumn("__rank", F.col("__r") + F.col("__before"))
    # The plan has a few rows for each of at most ``capacity`` lengths: one array per length, looked up by rank.
    schema = "length long, first long, n long, sequence long, copies long, at long"
    runs = spark.createDataFrame([p[:6] for p in places], schema)
    runs = runs.groupBy("length").agg(F.sort_array(F.collect_list(F.struct("first", "n", "sequence", "copies", "at"))).alias("__runs"))
    hit = F.element_at(F.filter("__runs", lambda r: (r["first"] <= F.col("__rank")) & (F.col("__rank") < r["first"] + r["n"])), 1)
    placed = ranked.join(F.broadcast(runs), "length").withColumn("__at", hit).withColumn("__k", F.col("__rank") - F.col("__at.first"))
    copies = F.col("__at.copies")
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("__at.sequence") + F.floor(F.col("__k") / copies)).cast("long").alias("sequence_id"),
        (F.col("__at.at") + (F.col("__k") % copies) * F.col("length")).cast("long").alias("offset"),
    )


def packed(docs: DataFrame, vocab: str | None = None, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    return pack(cut(pieces(docs, vocab or vocabulary("word_bpe_49k.json"), capacity, end)), capacity)


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(documents(spark, sf_dir))
