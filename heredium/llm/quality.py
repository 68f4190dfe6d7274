"""Quality classifier: logistic regression on hashed word n-grams, learnt with follow-the-regularised-leader updates.

Features are the words and word pairs of a text, as written and as shapes (letters, digits and marks
of a word, runs shortened), and a word following itself, hashed to ``2**BITS`` weights and divided by the root of their number. A
score is a sparse dot product. Labels are learnt on a bounded sample: labelled rows are kept by a
hash of their id at the rate ``SAMPLE / labelled``, dealt to ``SHARDS`` tasks that run FTRL-proximal
over their share, and the weights are averaged; each round starts from the average before.

An empty or null text has no features and is scored by the bias alone. A null id is never held out
and never a training row. Labels that disagree on an id count as the higher one. Without labels every
score is 0.5. Repeated rows get equal scores; columns other than ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .frames import documents, text_of
from .words import U64, grams, mix, slices, words_of

BITS, SAMPLE, SHARDS, ROUNDS, PASSES, BAR = 18, 16_000, 8, 2, 2, 0.3
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.02, 0.5


@dataclass
class Model:
    weight: np.ndarray
    bias: float


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _shape_table() -> np.ndarray:
    """Class of each byte: upper case, lower case and other letters, digits; marks stay themselves."""
    t = np.arange(256, dtype=np.uint8)
    t[ord("A"): ord("Z") + 1] = ord("A")
    t[ord("a"): ord("z") + 1] = ord("a")
    t[128:] = ord("a")
    t[ord("0"): ord("9") + 1] = ord("0")
    return t


_SHAPE = _shape_table()


def _shaped(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes as shapes, runs of one class reduced to one byte."""
    if not len(raw):
        return raw, offsets
    s = _SHAPE[raw]
    keep = np.ones(len(s), dtype=bool)
    keep[1:] = s[1:] != s[:-1]
    edge = offsets[(offsets > 0) & (offsets < len(s))]
    keep[edge] = True
    at = np.concatenate(([0], np.cumsum(keep)))
    return s[keep], at[offsets]


def features(raw: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and the document each belongs to, for the documents of a slice."""
    index, doc = [], []
    for view, (r, o) in enumerate(((raw, offsets), _shaped(raw, offsets))):
        w = words_of(r, o)
        d = w.doc()
        index.append(mix(w.hash + U64(view + 1)))
        doc.append(d)
        if len(w.hash) > 1:
            pair = grams(w.hash, 2)
            ok = d[1:] == d[:-1]
            index.append(mix(pair[ok] + U64(view + 1)))
            doc.append(d[:-1][ok])
            if not view:                                   # a word twice in a row, whichever word it is
                twice = d[1:][ok & (w.hash[1:] == w.hash[:-1])]
                index.append(np.full(len(twice), 0xD1B54A32D192ED03, dtype=U64))
                doc.append(twice)
    return (np.concatenate(index) >> U64(64 - bits)).astype(np.int64), np.concatenate(doc)


def _ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], start: Model, passes: int) -> Model:
    """FTRL-proximal from ``start``; a row is (feature numbers, values, label)."""
    size = len(start.weight) + 1
    w = np.append(start.weight, start.bias)
    n = np.zeros(size)
    z = -w * (BETA / ALPHA + L2) - np.sign(w) * L1     # the state whose weights are ``start``
    for _ in range(passes):
        for index, value, label in rows:
            p = 1 / (1 + np.exp(-np.clip(w[index] @ value, -30, 30)))
            g = (p - label) * value
            square = n[index] + g * g
            sigma = (np.sqrt(square) - np.sqrt(n[index])) / ALPHA
            zi = z[index] + g - sigma * w[index]
            n[index], z[index] = square, zi
            w[index] = np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(square)) / ALPHA + L2))
    return Model(w[:-1], float(w[-1]))


def _rows(texts: pd.Series, labels: pd.Series, bits: int) -> list[tuple[np.ndarray, np.ndarray, int]]:
    out, label = [], labels.to_numpy()
    for lo, hi, raw, offsets in slices(pa.array(texts, pa.string())):
        index, doc = features(raw, offsets, bits)
        order = np.argsort(doc, kind="stable")
        for i, part in enumerate(np.split(index[order], np.searchsorted(doc[order], np.arange(1, hi - lo)))):
            u, c = np.unique(part, return_counts=True)
            out.append((np.append(u, 1 << bits), np.append(c / max(1.0, len(part)) ** 0.5, 1.0), int(label[lo + i])))
    return out


def _learner(sent, bits: int, passes: int):
    def learn(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["turn", "text"])
        m = _ftrl(_rows(part["text"], part["label"], bits), sent.value, passes)
        return pd.DataFrame({"weight": [m.weight.astype("<f4").tobytes()], "bias": [m.bias], "n": [len(part)]})

    return learn


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, bits: int = BITS, shards: int = SHARDS,
          rounds: int = ROUNDS, passes: int = PASSES) -> Model:
    """Learns from labelled rows that are not held out; ``sample`` bounds how many are expected."""
    spark = docs.sparkSession
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max("quality").cast("int").alias("label"))
    n = known.count()
    order = F.pmod(F.xxhash64("id", F.lit("quality")), F.lit(1_000_000))
    picked = known.where(order < int(1_000_000 * min(1.0, sample / max(1, n)))).select("id", "label")
    rows = text_of(docs).join(F.broadcast(picked), F.col("doc_id") == F.col("id")).select(   # at most about ``sample`` ids
        F.pmod(F.xxhash64("id", F.lit("shard")), F.lit(shards)).alias("shard"), F.xxhash64("id", F.lit("order")).alias("turn"), "text", "label")
    model = Model(np.zeros(1 << bits), 0.0)
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(model)
        got = rows.groupBy("shard").applyInPandas(_learner(sent, bits, passes), "weight binary, bias double, n long").collect()   # at most ``shards`` rows
        if got:
            total = sum(g.n for g in got)
            model = Model(sum(np.frombuffer(g.weight, "<f4").astype(float) * g.n for g in got) / total, sum(g.bias * g.n for g in got) / total)
    return model


def scores(text: pa.Array, model: Model) -> np.ndarray:
    bits = int(len(model.weight)).bit_length() - 1
    out = np.empty(len(text))
    for lo, hi, raw, offsets in slices(text):
        index, doc = features(raw, offsets, bits)
        n = np.bincount(doc, minlength=hi - lo)
        dot = np.bincount(doc, weights=model.weight[index], minlength=hi - lo) / np.sqrt(np.maximum(1, n)) + model.bias
        out[lo:hi] = 1 / (1 + np.exp(-np.clip(dot, -30, 30)))
    return out


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(scores(b.column("text"), sent.value), pa.float64())], names=["doc_id", "score"])

    return text_of(docs).mapInArrow(run, "doc_id long, score double")


def accepted(docs: DataFrame, model: Model, bar: float = BAR) -> DataFrame:
    """The rows whose score reaches ``bar``, as they are."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(scores(b.column("text").cast(pa.string()), sent.value) >= bar))

    return docs.mapInArrow(run, docs.schema)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    s = scored(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return s.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= BAR).cast("int").alias("predicted"))
