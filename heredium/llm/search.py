"""Ranked lexical search by pair-bound MaxScore.

One pass turns each document into the terms of the asked items that it holds, with their counts (and
its length), written once; document counts, total length and document frequencies are summed from
partial counts. A second pass forms blocks of ``BLOCK`` documents where they lie: inverted lists with
integer impacts, each list's maximum, and for pairs of an item's terms the intersection of their lists
with the joint maximum impact. A document that holds both terms of a pair gains at most the joint
maximum from them and one that holds one of them at most that one's own, so the larger of these bounds
the pair, which is below the sum of the two maxima wherever the two never peak together. Pairs are the
neighbours among an item's terms by falling weight, and terms are met in that order; as soon as the pair bound of what is left is under the tenth score held, no new
document enters, and those held whose score and bound are under it leave. The tenth scores go on from
block to block within a task. Every task returns at most ten documents an item; these are ranked
together at the end.

Items are asked in blocks of a bounded number of (item, term) rows, each block a pass of its own over
the written documents; only such a block travels to the tasks.

Null texts, items and documents, hold no term: such a document is not counted and such an item has no
rows. Null ids of documents sort first among equal scores; null items are one item each. Repeated
documents are documents of their own. Rows of the same item id are ranked as one item with the terms
of them all. Extra columns are ignored. Empty tables give no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import cut
from .frames import documents, text_of

TOP, BLOCK = 10, 4096
#: (item, term) rows of a block of items: at most about 40 MB in a task.
ASKED = 400_000

_KEPT = frozenset([*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)])
_FOLD = bytes((c + 32 if 65 <= c <= 90 else c) if c in _KEPT else 32 for c in range(256))


def terms(text: str) -> list[bytes]:
    """Maximal runs of ASCII letters, digits and all characters beyond ASCII; A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split()


def item_terms(items: DataFrame) -> DataFrame:
    """item_id, term (UTF-8): each term of an item once."""
    d = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where(F.col("text").isNotNull())

    def run(batches):
        for b in batches:
            ids, out = [], []
            for i, t in zip(b.column("item_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                got = set(terms(t))
                ids += [i] * len(got)
                out += got
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], names=["item_id", "term"])

    return d.mapInArrow(run, "item_id long, term binary").distinct()


def vectors(docs: DataFrame, asked: list[bytes]) -> DataFrame:
    """doc_id, n (terms with repeats), term (places in ``asked``), tf: one row per document that has a term at all."""
    place = {t: i for i, t in enumerate(asked)}

    def run(batches):
        get = place.get
        for b in batches:
            ids, n, t, tf, ends = [], [], [], [], [0]
            for i, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                words = terms(text)
                if not words:
                    continue
                hit = np.fromiter((p for p in map(get, words) if p is not None), np.int32)
                which, count = np.unique(hit, return_counts=True)
                ids.append(i)
                n.append(len(words))
                t.append(which)
                tf.append(count)
                ends.append(ends[-1] + len(which))
            if ids:
                ends = pa.array(ends, pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x), ty)) for x, ty in ((t, pa.int32()), (tf, pa.int64()))]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), *lists], names=["doc_id", "n", "term", "tf"])

    return text_of(docs).mapInArrow(run, "doc_id long, n long, term array<int>, tf array<long>")


class Block:
    """Inverted lists over some documents: per term the rows that hold it, ascending, and their impacts."""

    def __init__(self, rows: np.ndarray, term: np.ndarray, impact: np.ndarray, n_docs: int, pairs: Iterable[tuple[int, int]]):
        order = np.argsort(term, kind="stable")
        self.rows, self.impacts, self.n_docs = rows[order], impact[order], n_docs
        held, first = np.unique(term[order], return_index=True)
        ends = np.append(first, len(order))[1:]
        self.lists = {int(t): (int(a), int(b)) for t, a, b in zip(held, first, ends, strict=True)}
        tops = np.maximum.reduceat(self.impacts, first) if len(first) else []
        self.most = {int(t): int(x) for t, x in zip(held, tops, strict=True)}
        #: Joint maximum impact over the intersection of two lists, for pairs whose lists are both here (0: they never meet).
        self.joint = {p: self._joint(*p) for p in pairs if p[0] in self.lists and p[1] in self.lists}

    def list_of(self, t: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.lists[t]
        return self.rows[a:b], self.impacts[a:b]

    def _joint(self, s: int, t: int) -> int:
        (r1, i1), (r2, i2) = sorted((self.list_of(s), self.list_of(t)), key=lambda x: len(x[0]))
        at = np.searchsorted(r2, r1)
        ok = at < len(r2)
        ok[ok] = r2[at[ok]] == r1[ok]
        return int((i1[ok] + i2[at[ok]]).max()) if ok.any() else 0

    def bounds(self, by: list[int]) -> list[int]:
        """What the terms from each place on can add to one document together: from the end, the better of taking a term
        alone and of taking it with the one after it as a pair."""
        out = [0] * (len(by) + 1)
        for k in range(len(by) - 1, -1, -1):
            a = self.most[by[k]]
            out[k] = a + out[k + 1]
            joint = self.joint.get((by[k], by[k + 1])) if k + 1 < len(by) else None
            if joint is not None:
                out[k] = min(out[k], max(joint, a, self.most[by[k + 1]]) + out[k + 2])
        return out

    def best(self, asked: list[int], floor_score: int, top: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows and scores that may be among the ``top`` of an item, whose terms come by falling weight; scores under ``floor_score`` are of no use."""
        by = [t for t in asked if t in self.lists]
        none = np.zeros(0, np.int64)
        if not by or sum(self.most[t] for t in by) < floor_score:
            return none, none
        left = self.bounds(by)
        if left[0] < floor_score:                        # the whole block is skipped
            return none, none
        score, k, least = np.zeros(self.n_docs, np.int64), 0, floor_score
        while k < len(by) and left[k] >= least:          # essential lists: any document of theirs may enter
            rows, gain = self.list_of(by[k])
            score[rows] += gain                          # a row occurs once in a list
            k += 1
            if self.n_docs > top and left[k] >= least:
                least = max(least, int(np.partition(score, self.n_docs - top)[self.n_docs - top]))
        at = np.flatnonzero((score > 0) & (score + left[k] >= least))
        held = score[at]
        while k < len(by) and len(at):                   # the others are looked up for the documents held
            rows, gain = self.list_of(by[k])
            where = np.searchsorted(rows, at)
            ok = where < len(rows)
            ok[ok] = rows[where[ok]] == at[ok]
            held[ok] += gain[where[ok]]
            k += 1
            if len(at) > top:
                least = max(least, int(np.partition(held, len(held) - top)[len(held) - top]))
                keep = held + left[k] >= least
                at, held = at[keep], held[keep]
        return at, held


def impacts(tf: np.ndarray, m: np.ndarray, w: np.ndarray) -> np.ndarray:
    return w * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))


def _ranked(table: DataFrame, items: list[int | None], asked: list[list[int]], weight: np.ndarray, n_docs: int, length: int, top: int, block: int) -> DataFrame:
    """The best documents of each item among those of each task: item, doc_id, score. ``asked``: terms by falling weight."""
    pairs = {(s, t) for q in asked for s, t in zip(q, q[1:])}        # noqa: B905 - neighbours

    def blocks(batches) -> Iterator[tuple[np.ndarray, list, list]]:
        held: list[pa.RecordBatch] = []
        n = 0
        for b in batches:
            at = 0
            while at < b.num_rows:
                part = b.slice(at, block - n)
                held.append(part)
                n, at = n + part.num_rows, at + part.num_rows
                if n == block:
                    yield pa.Table.from_batches(held)
                    held, n = [], 0
        if held:
            yield pa.Table.from_batches(held)

    def run(batches):
        best: list[list[tuple[int, int, int | None]]] = [[] for _ in items]     # heaps of (score, order, doc_id)
        for t in blocks(batches):
            ids = t.column("doc_id").to_pylist()
            lists = t.column("term").combine_chunks()
            sizes = np.asarray(lists.value_lengths())
            term = np.asarray(lists.flatten()).astype(np.int64)
            tf = np.asarray(t.column("tf").combine_chunks().flatten()).astype(np.int64)
            rows = np.repeat(np.arange(len(ids)), sizes)
            n = np.asarray(t.column("n").combine_chunks())
            m = 10 + (90 * n * n_docs) // length
            b = Block(rows, term, impacts(tf, m[rows], weight[term]), len(ids), pairs)
            for i, q in enumerate(asked):
                heap = best[i]
                at, score = b.best(q, heap[0][0] if len(heap) == top else 1, top)
                for r, s in zip(at.tolist(), score.tolist(), strict=True):
                    x = (s, -(ids[r] if ids[r] is not None else -(1 << 63)), ids[r])
                    if len(heap) < top:
                        heapq.heappush(heap, (x[0], x[1]))
                    elif x[:2] > heap[0]:
                        heapq.heapreplace(heap, (x[0], x[1]))
        out = [(i, None if o == 1 << 63 else -o, s) for i, heap in enumerate(best) for s, o in heap]
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], y) for k, y in enumerate((pa.int32(), pa.int64(), pa.int64()))], names=["item", "doc_id", "score"])

    return table.mapInArrow(run, "item int, doc_id long, score long")


def statistics(table: DataFrame, n_terms: int) -> tuple[int, int, np.ndarray]:
    """N, L and the document frequency of each asked term, from one partial count a task."""

    def run(batches):
        docs, length, df = 0, 0, np.zeros(n_terms, np.int64)
        for b in batches:
            docs += b.num_rows
            length += int(np.asarray(b.column("n")).sum())
            t = np.asarray(b.column("term").flatten())
            if len(t):
                df += np.bincount(t, minlength=n_terms)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((at, [-1, -2]))), pa.array(np.concatenate((df[at], [docs, length])))], names=["term", "df"])

    got = table.select("n", "term").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()   # a row per asked term of this block
    df, docs, length = np.zeros(n_terms, np.int64), 0, 0
    for r in got:
        if r.term == -1:
            docs = r.df
        elif r.term == -2:
            length = r.df
        else:
            df[r.term] = r.df
    return docs, length, df


def _blocks(table: DataFrame, asked: int) -> Iterator[list[tuple[int | None, list[bytes]]]]:
    """Items with their terms, in blocks of about ``asked`` rows: one range of items is on the driver at a time."""
    per = table.groupBy("item_id").agg(F.count("*").alias("n"))
    total = per.agg(F.sum("n")).first()[0] or 0
    parts = max(1, -(-total // asked))
    if parts == 1:
        dealt = [table]
    else:
        by = table.withColumn("part", F.pmod(F.xxhash64("item_id"), F.lit(parts)))
        dealt = [by.where(F.col("part") == p) for p in range(parts)]
    for d in dealt:
        rows: dict[int | None, list[bytes]] = {}
        for r in d.select("item_id", "term").toLocalIterator():
            rows.setdefault(r.item_id, []).append(bytes(r.term))
        if rows:
            yield sorted(((i, sorted(t)) for i, t in rows.items()), key=lambda x: (x[0] is not None, x[0] or 0))


def ranked(docs: DataFrame, items: DataFrame, top: int = TOP, block: int = BLOCK, asked: int = ASKED) -> DataFrame:
    """item_id, rank, doc_id, score: the ``top`` documents of each item with a score above 0."""
    spark = docs.sparkSession
    out: DataFrame | None = None
    for part in _blocks(cut(item_terms(items)), asked):
        names = sorted({t for _, ts in part for t in ts})
        place = {t: i for i, t in enumerate(names)}
        table = cut(vectors(docs, names))
        n_docs, length, df = statistics(table, len(names))
        if not n_docs:
            continue
        weight = np.array([floor(1000 * log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], np.int64)
        asked_terms = [sorted((place[t] for t in ts), key=lambda p: (-weight[p], p)) for _, ts in part]
        got = _ranked(table, [i for i, _ in part], asked_terms, weight, n_docs, length, top, block)
        order = W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
        got = got.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
        ids = spark.createDataFrame([(k, i) for k, (i, _) in enumerate(part)], "item int, item_id long")       # at most ``asked`` rows
        got = got.join(F.broadcast(ids), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
        out = got if out is None else out.unionByName(got)
    return out if out is not None else spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP13_SQL = r"""
WITH d AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM d GROUP BY ALL),
len AS (SELECT doc_id, count(*) AS n FROM d GROUP BY ALL),
tot AS (SELECT count(*) AS big_n, sum(n)::BIGINT AS big_l FROM len),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY ALL),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
s AS (SELECT q.item_id, tf.doc_id, sum(floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * df.df + 1)::DOUBLE))::BIGINT * ((1000000000 * tf.tf) // (1000 * tf.tf + 8 * (10 + (90 * n * big_n) // big_l))))::BIGINT AS score
      FROM q JOIN tf USING (term) JOIN df USING (term) JOIN len USING (doc_id) CROSS JOIN tot GROUP BY ALL),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0)
SELECT * FROM r WHERE rank <= 10
"""
