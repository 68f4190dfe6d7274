"""Substring dedup with repeated-phrase automata.

A window is ``WINDOW`` consecutive words; windows that start anywhere twice are recurring, and every
word under one is removed. The windows of a corpus are too many to count one by one, so each is
represented by its anchor, the smallest hash among the ``GRAM``-word runs in it. Equal windows have
equal anchors, and neighbouring windows mostly share one, so a run of windows with one anchor is a
single row. Then:

1. anchors are counted, summed before the shuffle; those met once are done with;
2. the runs of the other anchors are cut out of the texts as segments and sent to their anchor's shard;
3. in a shard the windows of the segments are counted: recurring passages are confirmed there;
4. the shard's confirmed windows are compiled into an Aho-Corasick automaton over words (each distinct
   word of the shard is one symbol, so matches are exact), and all its segments stream through it;
5. the spans found go back to their documents, whose words outside of spans are kept.

An anchor with more than ``HOT`` runs is dealt over several shards by document. What is confirmed
inside one of them is not enough there, so its windows are also counted across shards by a 128-bit
hash, summed before the shuffle, and the recurring ones are sent to each of the anchor's shards.

Null texts have no words. Rows are told apart by id and text: repeated rows are occurrences of their
own and get equal results; a null id stays null. Texts shorter than a window lose nothing. Extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .frames import documents, partitions, row_key, text_of
from .words import U64, Words, grams, slices, words_of

WINDOW, GRAM, HOT, SHARD = 35, 8, 1024, 1024


def _sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` over each ``width`` values in a row, by doubling."""
    done, out = 1, x
    while done < width:
        step = min(done, width - done)
        out = pick(out[:-step], out[step:])
        done += step
    return out


def anchor_runs(w: Words, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: (document, first window, windows, anchor) and, last, in how many places of the run the anchor stands, or more."""
    n = len(w.hash)
    none = tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, U64, np.int64))
    if n < window:
        return none
    g = grams(w.hash, gram)
    width = window - gram + 1
    anchor = _sliding(g, width, np.minimum)
    at = np.arange(len(anchor))
    doc = w.doc()[: len(anchor)]
    valid = w.left()[: len(anchor)] >= window
    if not valid.any():
        return none
    begins = valid.copy()
    begins[1:] &= ~valid[:-1] | (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(begins)
    number = np.cumsum(begins) - 1
    length = np.bincount(number[valid], minlength=len(first))
    value = anchor[first]
    # An anchor stands in two places of a run where the smallest gram repeats: two such places follow each other.
    padded = np.concatenate((np.zeros(width - 1, U64), np.where(valid, anchor, U64(0)), np.zeros(len(g) - len(anchor), U64)))
    chosen = np.flatnonzero(g == _sliding(padded, width, np.maximum))
    again = np.zeros(len(g) + 1, dtype=np.int64)
    again[chosen[1:][g[chosen[1:]] == g[chosen[:-1]]] + 1] = 1
    again = np.cumsum(again)
    places = 1 + again[first + length + width - 1] - again[first + 1]
    return doc[first], at[first] - w.first[doc[first]], length, value, places


def _counts(batches) -> Iterator[pa.RecordBatch]:
    """anchor, places, runs: summed over each batch."""
    for b in batches:
        parts = [anchor_runs(words_of(raw, o)) for _, _, raw, o in slices(b.column("text"))]
        value, places = (np.concatenate([p[k] for p in parts]) if parts else np.empty(0, t) for k, t in ((3, U64), (4, np.int64)))
        u, inverse, runs = np.unique(value, return_inverse=True, return_counts=True)
        total = np.bincount(inverse, weights=places, minlength=len(u)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(total), pa.array(runs.astype(np.int64))], names=["anchor", "places", "runs"])


def _runs(batches) -> Iterator[pa.RecordBatch]:
    """k1, k2, first, length, anchor of every run."""
    for b in batches:
        k1, k2 = (np.asarray(b.column(c)) for c in ("k1", "k2"))
        for lo, _, raw, o in slices(b.column("text")):
            doc, first, length, value, _ = anchor_runs(words_of(raw, o))
            yield pa.RecordBatch.from_arrays([pa.array(k1[lo + doc]), pa.array(k2[lo + doc]), pa.array(first.astype(np.int32)), pa.array(length.astype(np.int32)), pa.array(value.view(np.int64))],
                                             names=["k1", "k2", "first", "length", "anchor"])


_SEGMENT = "anchor long, salt int, salts int, k1 long, k2 long, at int, words binary"


def _segments(batches) -> Iterator[pa.RecordBatch]:
    """Words under each flagged run of a document."""
    for b in batches:
        rows: list[tuple] = []
        for k1, k2, text, flags in zip(*(b.column(c).to_pylist() for c in ("k1", "k2", "text", "flags")), strict=True):
            w = text.encode().split()
            for f in flags:
                at, salts = f["first"], f["salts"]
                rows.append((f["anchor"], zlib.crc32(b"%d %d %d" % (k1, k2, at)) % salts, salts, k1, k2, at, b" ".join(w[at: at + f["length"] + WINDOW - 1])))
        types = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["anchor", "salt", "salts", "k1", "k2", "at", "words"])


def _digest(window: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(window), digest_size=16).digest()


def _hot_windows(batches) -> Iterator[pa.RecordBatch]:
    """anchor, salts, digest, n of the windows of hot anchors, summed over each batch."""
    for b in batches:
        seen: Counter = Counter()
        for a, s, words in zip(*(b.column(c).to_pylist() for c in ("anchor", "salts", "words")), strict=True):
            w = words.split()
            seen.update((a, s, _digest(w[i: i + WINDOW])) for i in range(len(w) - WINDOW + 1))
        rows = [(a, s, x, n) for (a, s, x), n in seen.items()]
        types = (pa.int64(), pa.int32(), pa.binary(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["anchor", "salts", "digest", "n"])


def _symbol(i: int) -> str:
    return chr(i + 1 if i < 0xD7FF else i + 0x0801)        # surrogates are left out


def shard_spans(segments: list[tuple[int, int, list[bytes]]], confirmed: list[set[bytes] | None], window: int = WINDOW) -> list[list[tuple[int, int]]]:
    """Recurring spans of each segment (anchor, salt, words), in words of the segment.

    ``confirmed``: for a segment of a hot anchor the digests of its recurring windows, else None: counted here.
    """
    import ahocorasick

    symbols: dict[bytes, str] = {}
    coded = []
    for _, _, w in segments:
        coded.append("".join([symbols.get(x) or symbols.setdefault(x, _symbol(len(symbols))) for x in w]))
    seen: Counter = Counter()
    phrases: set[str] = set()
    for (_, _, w), c, known in zip(segments, coded, confirmed, strict=True):
        if known is None:
            seen.update(c[i: i + window] for i in range(len(c) - window + 1))
        else:
            phrases.update(c[i: i + window] for i in range(len(c) - window + 1) if c[i: i + window] not in phrases and _digest(w[i: i + window]) in known)
    phrases.update(p for p, n in seen.items() if n > 1)
    if not phrases:
        return [[] for _ in segments]
    automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
    for p in phrases:
        automaton.add_word(p)
    automaton.make_automaton()
    out = []
    for c in coded:
        spans: list[list[int]] = []
        for end, _ in automaton.iter(c):
            start = end - window + 1
            if spans and start <= spans[-1][1]:
                spans[-1][1] = end + 1
            else:
                spans.append([start, end + 1])
        out.append([(s, e) for s, e in spans])
    return out


def _located(batches) -> Iterator[pa.RecordBatch]:
    """Rows in order of (anchor, salt, kind): digests of a hot anchor's recurring windows, then segments. Whole anchors gather into shards."""
    group, known, fresh = None, None, 0
    segments: list[tuple] = []
    places: list[tuple] = []
    confirmed: list[set[bytes] | None] = []

    def told() -> pa.RecordBatch:
        rows = [(k1, k2, at + s, at + e) for (k1, k2, at), spans in zip(places, shard_spans(segments, confirmed), strict=True) for s, e in spans]
        types = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["k1", "k2", "start", "end"])

    for b in batches:
        for a, salt, kind, k1, k2, at, salts, words in zip(*(b.column(c).to_pylist() for c in ("anchor", "salt", "kind", "k1", "k2", "at", "salts", "words")), strict=True):
            if (a, salt) != group:
                if fresh >= SHARD:
                    yield told()
                    segments, places, confirmed, fresh = [], [], [], 0
                group, known = (a, salt), None
            if salts > 1 and known is None:
                known = set()
            if kind == 0:
                known.add(words)
            else:
                segments.append((a, salt, words.split()))
                places.append((k1, k2, at))
                confirmed.append(known)
                fresh += 1
    if segments:
        yield told()


def keyed_documents(docs: DataFrame) -> DataFrame:
    """The columns every join on the texts sends, so that their shuffle is written once and reused."""
    return text_of(docs).select(*row_key(), "doc_id", "text")


def recurring_spans(docs: DataFrame) -> DataFrame:
    """k1, k2, spans (array of start, end in words): documents with words under recurring windows."""
    n = partitions(docs.sparkSession)
    keyed = keyed_documents(docs)
    counts = keyed.select("text").mapInArrow(_counts, "anchor long, places long, runs long")
    anchors = counts.groupBy("anchor").agg(F.sum("places").alias("places"), F.sum("runs").alias("runs")).where("places > 1")
    anchors = anchors.select("anchor", F.ceil(F.col("runs") / HOT).cast("int").alias("salts"))
    runs = keyed.select("k1", "k2", "text").mapInArrow(_runs, "k1 long, k2 long, first int, length int, anchor long").join(anchors, "anchor")

    def segments_of(r: DataFrame) -> DataFrame:
        flags = r.groupBy("k1", "k2").agg(F.collect_set(F.struct("first", "length", "anchor", "salts")).alias("flags"))    # within one document
        return keyed.join(flags, ["k1", "k2"]).mapInArrow(_segments, _SEGMENT)

    columns = ["anchor", "salt", "kind", "k1", "k2", "at", "salts", "words"]
    zero = F.lit(0)
    hot = segments_of(runs.where("salts > 1")).mapInArrow(_hot_windows, "anchor long, salts int, digest binary, n long")
    hot = hot.groupBy("anchor", "salts", "digest").agg(F.sum("n").alias("n")).where("n > 1")
    hot = hot.select("anchor", F.explode(F.sequence(zero, F.col("salts") - 1)).alias("salt"), zero.alias("kind"), zero.cast("long").alias("k1"), zero.cast("long").alias("k2"), zero.alias("at"), "salts", F.col("digest").alias("words"))
    rows = segments_of(runs).select("anchor", "salt", F.lit(1).alias("kind"), "k1", "k2", "at", "salts", "words").unionByName(hot.select(*columns))
    rows = rows.repartition(n, "anchor", "salt").sortWithinPartitions("anchor", "salt", "kind")
    spans = rows.mapInArrow(_located, "k1 long, k2 long, start int, end int")
    return spans.groupBy("k1", "k2").agg(F.collect_set(F.struct("start", "end")).alias("spans"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept: the words outside recurring windows, joined by one space."""
    keyed = keyed_documents(docs)
    j = keyed.join(recurring_spans(docs), ["k1", "k2"], "left")

    def run(batches):
        for b in batches:
            rows: list[tuple] = []
            for text, spans in zip(b.column("text").to_pylist(), b.column("spans").to_pylist(), strict=True):
                w = text.encode().split()
                kept, at = w, 0
                if spans:
                    kept = []
                    for s, e in sorted((x["start"], x["end"]) for x in spans):
                        kept += w[at:s] if s > at else []
                        at = max(at, e)
                    kept += w[at:]
                rows.append((len(w), len(w) - len(kept), b" ".join(kept).decode()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string())))],
                                             names=["doc_id", "n_words", "n_removed", "kept"])

    return j.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")


def op1_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
