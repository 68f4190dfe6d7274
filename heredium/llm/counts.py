"""Token counts as delta-maintained rollups.

A change inserts, deletes or revises the count of one document. Changes become signed sums by source,
language and tokenizer version, and a batch of them is one folder of a store, written under its batch
id: committing the same id again replaces or keeps that folder and never adds to it. Totals are the
sums over committed batches, so they can be folded into one folder at any time.

Null sources, languages and counts are groups and zeros of their own; repeated change rows count as
often as they are given; a batch without changes commits an empty folder. Keys whose sums return to
zero stay, with zeros. A null text has no tokens.
"""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import cut, shared_folder
from .frames import documents
from .pii import redact
from .tokens import counted, vocabulary

KEYS, SUMS = ["source", "lang", "tokenizer"], ["docs", "tokens", "chars"]
_STORED = "source string, lang string, tokenizer string, docs long, tokens long, chars long"


def token_counts(docs: DataFrame, vocabs: dict[str, str]) -> DataFrame:
    """doc_id, source, lang, tokenizer, tokens, chars: one row per document and tokenizer version (name -> vocabulary file)."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"),
                    F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def run(batches):
        for b in batches:
            texts = b.column("text").to_pylist()
            chars = pa.array([len(t) for t in texts], pa.int64())
            counts = counted(tuple(vocabs.values()), texts)
            for k, name in enumerate(vocabs):
                n = pa.array([c[k] for c in counts], pa.int64())
                cols = [b.column("doc_id"), b.column("source"), b.column("lang"), pa.array([name] * len(texts), pa.string()), n, chars]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "source", "lang", "tokenizer", "tokens", "chars"])

    return d.mapInArrow(run, "doc_id long, source string, lang string, tokenizer string, tokens long, chars long")


def inserts(counts: DataFrame) -> DataFrame:
    return _signed(counts, 1, F.col("tokens"), F.col("chars"))


def deletes(counts: DataFrame) -> DataFrame:
    return _signed(counts, -1, -F.col("tokens"), -F.col("chars"))


def revisions(counts: DataFrame) -> DataFrame:
    """Rows with the counts held so far and ``new_tokens``, ``new_chars``: the difference, and no change in documents."""
    return _signed(counts, 0, F.col("new_tokens") - F.col("tokens"), F.col("new_chars") - F.col("chars"))


def _signed(counts: DataFrame, docs: int, tokens, chars) -> DataFrame:
    zero = F.lit(0).cast("long")
    return counts.select(*KEYS, F.lit(docs).cast("long").alias("docs"), F.coalesce(tokens, zero).cast("long").alias("tokens"), F.coalesce(chars, zero).cast("long").alias("chars"))


class Store:
    """A folder of committed batches."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._at = spark._jvm.org.apache.hadoop.fs.Path(path)
        self._fs = self._at.getFileSystem(spark._jsc.hadoopConfiguration())

    def _done(self, name: str) -> bool:
        return self._fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}/_SUCCESS"))

    def batches(self) -> list[str]:
        """Names of the committed batches."""
        if not self._fs.exists(self._at):
            return []
        return sorted(n for s in self._fs.listStatus(self._at) if self._done(n := s.getPath().getName()))

    def commit(self, batch: str, *changes: DataFrame) -> bool:
        """Writes the summed changes under ``batch``; False if that batch is in already. A broken write leaves no mark and is replaced."""
        if self._done(batch):
            return False
        every = changes[0]
        for c in changes[1:]:
            every = every.unionByName(c)
        sums = every.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in SUMS])
        sums.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/{batch}")    # a row per key: sources x languages x versions
        return True

    def totals(self, only: Iterable[str] | None = None) -> DataFrame:
        names = list(only) if only is not None else self.batches()
        if not names:
            return self.spark.createDataFrame([], _STORED)
        every = self.spark.read.schema(_STORED).parquet(*[f"{self.path}/{n}" for n in names])
        return every.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in SUMS])


def op6_token_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in; toxic ones out again; documents whose personal data is then redacted revised to the counts of their new text.
    The last two batches are sent twice. Totals are those of a recount of all documents that stay, as they are then."""
    import uuid

    vocabs = {"byte_bpe_50k": vocabulary("byte_bpe_50k.json"), "word_bpe_49k": vocabulary("word_bpe_49k.json")}
    docs = documents(spark, sf_dir)
    counts = cut(token_counts(docs, vocabs))
    toxic = spark.read.parquet(f"{sf_dir}/labels.parquet").where(F.col("toxic") == 1).select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    # A revision is a difference, so old and new rows need not meet: repeated and null ids are no matter.
    # Redacting comes first, where the documents are read: only texts that change meet the toxic ids.
    redone = redactions(docs)
    changed = cut(redone.join(toxic, redone["doc_id"].cast("long") == toxic["doc_id"], "left_anti"))
    zero = F.lit(0).cast("long")
    before = token_counts(changed.withColumn("text", F.col("old")), vocabs).withColumns({"new_tokens": zero, "new_chars": zero})
    after = token_counts(changed, vocabs).withColumns({"new_tokens": F.col("tokens"), "new_chars": F.col("chars")}).withColumns({"tokens": zero, "chars": zero})
    store = Store(spark, f"{shared_folder(spark)}/rollup-{uuid.uuid4().hex}")
    store.commit("000001", inserts(counts))
    for _ in range(2):
        store.commit("000002", deletes(counts.join(toxic, "doc_id", "left_semi")))
        store.commit("000003", revisions(before), revisions(after))
    return store.totals()


def redactions(docs: DataFrame) -> DataFrame:
    """doc_id, source, lang, old, text: the documents whose text changes when personal data is redacted."""
    d = docs.select("doc_id", "source", "lang", F.col("text").cast("string").alias("old"))

    def run(batches):
        for b in batches:
            old = b.column("old").to_pylist()
            new = [None if t is None else redact(t) for t in old]
            at = [i for i, (x, y) in enumerate(zip(old, new, strict=True)) if x != y]
            if at:
                yield pa.RecordBatch.from_arrays([*b.take(pa.array(at, pa.int64())).columns, pa.array([new[i] for i in at], pa.string())], names=["doc_id", "source", "lang", "old", "text"])

    return d.mapInArrow(run, d.withColumn("text", F.col("old")).schema)
