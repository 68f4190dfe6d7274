"""N-gram Jaccard join with Bayesian candidate pruning.

Texts are classes of equal word sequences; a class is one text however many copies it has. The
five-word shingles of each class are reduced to ``HASHES`` MinHash values (one permutation cut into
bins, empty bins filled from a bin drawn by a fixed rule), which serve twice: ``HASHES / ROWS`` bands
of ``ROWS`` values find candidate pairs, and pairs are then compared value by value in steps of
``STEP``. After each step the posterior probability that the similarity reaches the threshold, given
the matches so far and a uniform prior, is looked up; below ``TOLERANCE`` the pair is dropped. What
is left is verified exactly on the shingles of the texts.

A pair of similarity 0.8 shares no band with probability 3e-6, and is dropped wrongly with about the
tolerance; both fall quickly above the threshold. A pair is taken in the first band it shares, so it
is compared once. Buckets of more than ``BLOCK`` classes are cut into blocks and each pair of blocks
is a unit of its own; pairs travel inside arrays, never as rows, and no unit holds more than two
blocks. Texts are sent only to units with surviving pairs.

Texts of fewer than five words have one shingle, of all their words; texts without words form one
class, with no links but to each other. Null texts count as empty. Copies count as links of one
another. Null ids get a class like any other; repeated rows count as copies.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import cut
from .frames import NO_ID, documents, partitions, text_of, unused
from .words import U64, grams, mix, slices, words_of

THRESHOLD, SIZE = 0.8, 5
HASHES, ROWS, STEP, TOLERANCE, BLOCK = 96, 4, 16, 1e-6, 256
BANDS = HASHES // ROWS


def least_matches(threshold: float = THRESHOLD, hashes: int = HASHES, step: int = STEP, tolerance: float = TOLERANCE) -> dict[int, int]:
    """After so many values compared: the fewest matches at which P(similarity >= threshold) is not below the tolerance."""
    out = {}
    for n in range(step, hashes + 1, step):
        # With a uniform prior the posterior is Beta(m + 1, n - m + 1); its upper tail is a binomial sum.
        tail = np.cumsum([math.comb(n + 1, k) * threshold**k * (1 - threshold) ** (n + 1 - k) for k in range(n + 2)])
        out[n] = next(m for m in range(n + 1) if tail[m] >= tolerance)
    return out


def minhashes(gram: np.ndarray, doc: np.ndarray, docs: int, hashes: int = HASHES) -> np.ndarray:
    """One row of ``hashes`` 32-bit values per document; ``gram`` are shingle hashes and ``doc`` whose they are. All zero without shingles."""
    out = np.full((docs, hashes), 0xFFFFFFFF, dtype=np.uint32)
    where = (gram >> U64(32)) * U64(hashes) >> U64(32)
    value = (gram & U64(0xFFFFFFFF)).astype(np.uint32)
    value[value == 0xFFFFFFFF] = 0
    np.minimum.at(out.reshape(-1), doc * hashes + where.astype(np.int64), value)
    empty = out == 0xFFFFFFFF
    none = empty.all(axis=1)
    out[none], empty[none] = 0, False
    turn = 0
    start = empty.copy()
    while empty.any():                                     # every empty bin follows its own fixed sequence of bins to a filled one
        d, b = np.nonzero(empty)
        turn += 1
        to = (mix(b.astype(U64) * U64(0x9E3779B97F4A7C15) + U64(turn)) >> U64(32)) * U64(hashes) >> U64(32)
        to = to.astype(np.int64)
        ok = ~start[d, to]
        out[d[ok], b[ok]] = out[d[ok], to[ok]]
        empty[d[ok], b[ok]] = False
    return out


def _sequence_keys(w, docs: int) -> list[bytes]:
    """128 bits of each document's word sequence."""
    if not len(w.hash):
        return [b"\0" * 16] * docs
    doc, at = w.doc(), np.arange(len(w.hash)) - np.repeat(w.first[:-1], np.diff(w.first))
    n = np.diff(w.first).astype(U64)
    keys = np.zeros((docs, 2), dtype=U64)
    for k, salt in enumerate((0xA0761D6478BD642F, 0xE7037ED1A0B428DB)):
        part = mix(w.hash + mix(at.astype(U64) + U64(salt)))
        np.add.at(keys[:, k], doc, part)
        keys[:, k] = mix(keys[:, k] + n * U64(salt))
    keys[n == 0] = 0
    return [k.tobytes() for k in keys]


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, class (key of the word sequence), sketch (MinHash values), has (whether there are shingles): one row per document."""

    def run(batches):
        for b in batches:
            keys, sketches, has = [], [], []
            for lo, hi, raw, offsets in slices(b.column("text")):
                w = words_of(raw, offsets)
                d, left, g = w.doc(), w.left(), grams(w.hash, SIZE)
                ok = left[: len(g)] >= SIZE
                gram, doc = g[ok], d[: len(g)][ok]
                short = np.flatnonzero((np.diff(w.first) > 0) & (np.diff(w.first) < SIZE))
                if len(short):                                # the one shingle of a short text
                    one = np.array([grams(w.hash[w.first[i]: w.first[i + 1]], int(w.first[i + 1] - w.first[i]))[0] for i in short], dtype=U64)
                    gram, doc = np.concatenate((gram, one)), np.concatenate((doc, short))
                sk = minhashes(gram, doc, hi - lo)
                keys += _sequence_keys(w, hi - lo)
                sketches += [s.tobytes() for s in sk]
                has += (np.diff(w.first) > 0).tolist()
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(keys, pa.binary()), pa.array(sketches, pa.binary()), pa.array(has, pa.bool_())],
                                             names=["doc_id", "class", "sketch", "has"])

    return text_of(docs).mapInArrow(run, "doc_id long, class binary, sketch binary, has boolean")


def classes(sig: DataFrame) -> DataFrame:
    """One row per class: class, rep (smallest id), copies, sketch, has."""
    return sig.groupBy("class").agg(F.min(F.coalesce("doc_id", F.lit(NO_ID))).alias("rep"), F.count("*").alias("copies"), F.min("sketch").alias("sketch"), F.first("has").alias("has"))


def _surviving(batches, bounds: dict[int, int]) -> Iterator[pa.RecordBatch]:
    """Rows in order of (band key, i, j): pairs of each unit whose first shared band this is and that the posterior keeps."""
    def flush(rows: list[tuple]) -> Iterator[tuple]:
        at, n = 0, len(rows)
        left, right = [], []
        while at < n:
            end = at
            while end < n and rows[end][:3] == rows[at][:3]:
                end += 1
            side = np.array([r[4] for r in rows[at:end]])
            i, j = rows[at][1], rows[at][2]
            if i == j:
                a, b = np.triu_indices(end - at, 1)
            else:
                a, b = np.meshgrid(np.flatnonzero(side == i), np.flatnonzero(side == j), indexing="ij")
                a, b = a.ravel(), b.ravel()
            left.append(a + at)
            right.append(b + at)
            at = end
        left, right = (np.concatenate(left), np.concatenate(right)) if left else (np.empty(0, int), np.empty(0, int))
        sk = np.frombuffer(b"".join(r[5] for r in rows), dtype=np.uint32).reshape(n, HASHES)
        band = np.array([r[3] for r in rows])
        kept_l, kept_r = [], []
        for lo in range(0, len(left), 20_000):
            a, b = left[lo: lo + 20_000], right[lo: lo + 20_000]
            same = sk[a] == sk[b]
            first = same.reshape(len(a), BANDS, ROWS).all(axis=2).argmax(axis=1)
            ok = first == band[a]
            a, b, same = a[ok], b[ok], same[ok]
            matches = np.zeros(len(a), dtype=np.int64)
            for k, least in bounds.items():
                matches += same[:, k - STEP: k].sum(axis=1)
                ok = matches >= least
                a, b, same, matches = a[ok], b[ok], same[ok], matches[ok]
            kept_l.append(a)
            kept_r.append(b)
        l, r = (np.concatenate(kept_l), np.concatenate(kept_r)) if kept_l else (np.empty(0, int), np.empty(0, int))
        unit = np.array([hash(x[:3]) for x in rows])           # rows of a unit are together
        order = np.argsort(l, kind="stable")
        l, r = l[order], r[order]
        cuts = np.flatnonzero(np.diff(unit[l])) + 1 if len(l) else []
        for part_l, part_r in zip(np.split(l, cuts), np.split(r, cuts), strict=True):
            if len(part_l):
                x = rows[part_l[0]]
                yield x[0], x[1], x[2], np.unique(np.concatenate((part_l, part_r))), part_l, part_r

    held: list[tuple] = []

    def told(done: list[tuple]) -> Iterator[pa.RecordBatch]:
        out = list(flush(done))
        if out:
            members = [[done[m][6] for m in x[3]] for x in out]
            pairs = [np.stack((np.searchsorted(x[3], x[4]), np.searchsorted(x[3], x[5])), axis=1).astype("<i4").tobytes() for x in out]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int32()), pa.array([x[2] for x in out], pa.int32()),
                                              pa.array(members, pa.list_(pa.binary())), pa.array(pairs, pa.binary())], names=["key", "i", "j", "members", "pairs"])

    for b in batches:
        held += zip(*(b.column(c).to_pylist() for c in ("key", "i", "j", "band", "side", "sketch", "class")), strict=True)
        while len(held) > 4096:
            end = 4096
            while end < len(held) and held[end][:3] == held[end - 1][:3]:
                end += 1
            if end == len(held):
                break                                           # the unit may go on in the next batch
            yield from told(held[:end])
            held = held[end:]
    if held:
        yield from told(held)


def candidate_units(cls: DataFrame) -> DataFrame:
    """key, i, j, members (classes), pairs (positions among them): what the bands bring together and the posterior keeps."""
    bands = cls.where("has").select("class", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(b, F.substring("sketch", b * (4 * ROWS) + 1, F.lit(4 * ROWS))))).alias("band", "key"))
    held = bands.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    met = bands.join(held, "key").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    met = met.withColumn("side", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    met = met.join(cls.select("class", "sketch"), "class")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    met = met.select("class", "sketch", "band", "key", "side", other)
    met = met.select("class", "sketch", "band", "key", "side", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"))
    bounds = least_matches()
    met = met.repartition(partitions(cls.sparkSession), "key", "i", "j").sortWithinPartitions("key", "i", "j")
    return met.mapInArrow(lambda b: _surviving(b, bounds), "key long, i int, j int, members array<binary>, pairs binary")


def shingles_of(text: str) -> set[bytes]:
    w = text.encode().split()
    return {b" ".join(w[i: i + SIZE]) for i in range(len(w) - SIZE + 1)} if len(w) >= SIZE else ({b" ".join(w)} if w else set())


def _verified(batches, threshold: float) -> Iterator[pa.RecordBatch]:
    """Rows in order of (unit, kind): texts of a unit, then its pairs. Gives per class of a unit its partners, and a forest."""
    schema = pa.schema([("class", pa.binary()), ("root", pa.binary()), ("partners", pa.list_(pa.binary())), ("similarity", pa.list_(pa.float64())), ("links", pa.int64())])
    unit, texts = None, {}
    for b in batches:
        out: list[tuple] = []
        for u, kind, c, copies, text, members, pairs in zip(*(b.column(x).to_pylist() for x in ("unit", "kind", "class", "copies", "text", "members", "pairs")), strict=True):
            if u != unit:
                unit, texts = u, {}
            if kind == 0:
                texts[c] = (shingles_of(text), copies)
                continue
            near: dict[int, list[tuple[int, float]]] = {}
            root = list(range(len(members)))

            def find(x: int, root=root) -> int:
                while root[x] != x:
                    root[x] = root[root[x]]
                    x = root[x]
                return x

            sets = [texts[m] for m in members]
            for x, y in np.frombuffer(pairs, dtype="<i4").reshape(-1, 2).tolist():
                s, t = sets[x][0], sets[y][0]
                both = len(s & t)
                j = both / (len(s) + len(t) - both)
                if j >= threshold:
                    near.setdefault(x, []).append((y, j))
                    near.setdefault(y, []).append((x, j))
                    a, z = find(x), find(y)
                    root[max(a, z)] = min(a, z)
            out += [(members[x], members[find(x)], [members[y] for y, _ in n], [j for _, j in n], sum(sets[y][1] for y, _ in n)) for x, n in near.items()]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], schema.field(k).type) for k in range(5)], schema=schema)


def links(docs: DataFrame, cls: DataFrame, sig: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """class, root, partners, similarity, links: verified links of each class, split over units; each link is in one unit and told at both ends."""
    units = cut(candidate_units(cls).withColumn("unit", F.struct("key", "i", "j")))
    wanted = units.select("unit", F.explode("members").alias("class"))
    reps = cls.join(wanted.select("class").distinct(), "class", "left_semi").select("class", "rep", "copies")
    # One text for each class wanted: the rows that hold its smallest id; rows that share that id may hold other texts.
    text = text_of(docs).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("rep"), "text")
    keyed = reps.join(text, "rep")
    ids = sig.groupBy(F.coalesce("doc_id", F.lit(NO_ID)).alias("rep")).agg(F.count_distinct("class").alias("n")).where("n > 1")
    if not ids.isEmpty():                                        # an id with several texts: tell them apart by their words
        keyed = _of_class(keyed)
    keyed = keyed.groupBy("class", "rep").agg(F.max("copies").alias("copies"), F.min("text").alias("text")) if not ids.isEmpty() else keyed.dropDuplicates(["class"])
    none = F.lit(None)
    rows = wanted.join(keyed, "class").select("unit", F.lit(0).alias("kind"), "class", "copies", "text", none.cast("array<binary>").alias("members"), none.cast("binary").alias("pairs"))
    rows = rows.unionByName(units.select("unit", F.lit(1).alias("kind"), none.cast("binary").alias("class"), none.cast("long").alias("copies"), none.cast("string").alias("text"), "members", "pairs"))
    rows = rows.withColumn("unit", F.concat_ws(":", "unit.key", "unit.i", "unit.j")).repartition(partitions(docs.sparkSession), "unit").sortWithinPartitions("unit", "kind")
    return rows.mapInArrow(lambda b: _verified(b, threshold), "class binary, root binary, partners array<binary>, similarity array<double>, links long")


def _of_class(keyed: DataFrame) -> DataFrame:
    """Only rows whose text has the word sequence of their class."""
    columns = keyed.columns

    def run(batches):
        for b in batches:
            keys = []
            for lo, hi, raw, offsets in slices(b.column("text")):
                keys += _sequence_keys(words_of(raw, offsets), hi - lo)
            yield b.filter(pa.array([x == y for x, y in zip(keys, b.column("class").to_pylist(), strict=True)], pa.bool_()))

    return keyed.select(*columns).mapInArrow(run, keyed.schema)


def components(edges: DataFrame) -> DataFrame:
    """node, comp (smallest node it hangs together with) for an edge table (a, b), by alternating star steps; each step is written out."""
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = cut(e)
    while True:
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))          # larger neighbours to the least
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        new = cut(small.where("u <> v").distinct())
        if new.exceptAll(e).isEmpty() and e.exceptAll(new).isEmpty():
            return new.groupBy("u").agg(F.min("v").alias("comp")).withColumnRenamed("u", "node")
        e = new


def join(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, class_id (smallest id of its group of linked texts), rep_id (smallest id of its text), n_copies, n_links."""
    sig = cut(signatures(docs))
    cls = cut(classes(sig))
    found = cut(links(docs, cls, sig, threshold))
    per = found.groupBy("class").agg(F.sum("links").alias("links"))
    comp = components(found.select(F.col("class").alias("a"), F.col("root").alias("b")))
    reps = comp.join(cls.select(F.col("class").alias("node"), "rep"), "node")
    low = comp.select("comp").distinct().join(cls.select(F.col("class").alias("comp"), F.col("rep").alias("own")), "comp")
    group = reps.groupBy("comp").agg(F.min("rep").alias("least")).join(low, "comp").withColumn("group_id", F.least("least", "own"))
    member = comp.join(group.select("comp", "group_id"), "comp").select(F.col("node").alias("class"), "group_id")
    member = member.unionByName(group.select(F.col("comp").alias("class"), "group_id"))
    c = cls.drop("sketch").join(per, "class", "left").join(member, "class", "left")
    c = c.select("class", F.col("rep").alias("rep_id"), F.coalesce("group_id", "rep").alias("class_id"), F.col("copies").alias("n_copies"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"))
    return sig.select("doc_id", "class").join(c, "class").select("doc_id", "class_id", "rep_id", "n_copies", "n_links")


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows that stay when one document of each group of linked texts is kept: the one with the group's smallest id.

    Of rows that repeat an id, one stays for each of its texts.
    """
    j = cut(join(docs, threshold))
    columns, (own, stays, rows) = docs.columns, unused(docs, "own", "stays", "rows")
    stay = j.where(F.coalesce("doc_id", F.lit(NO_ID)) == F.col("class_id")).groupBy(F.col("class_id").alias(stays)).agg(F.count("*").alias(rows))
    d = docs.withColumn(own, F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)))
    once = d.join(stay.where(F.col(rows) == 1), F.col(own) == F.col(stays), "left_semi").select(*columns)
    more = stay.where(F.col(rows) > 1)
    if more.isEmpty():
        return once
    again = d.join(more, F.col(own) == F.col(stays), "left_semi").dropDuplicates([own, "text"]).select(*columns)
    return once.unionByName(again)


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(documents(spark, sf_dir))
