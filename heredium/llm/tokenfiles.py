"""Token ids of documents in files of coded blocks, in ascending id order.

Documents are dealt by range of id and sorted; a task tokenises its range as it streams by and writes
a part for every ``PART`` ids or so. A part is a row of a Parquet file: its range and number, the ids
and lengths of its documents, and its coded blocks (see ``idcoder``), each ``BLOCK`` ids but the last.
Parts hold whole documents. Reading a part checks every block; where a document starts among all ids
is the sum over the parts before it.

Null texts count as empty (the end id alone); null ids come first; rows that share an id follow by the
hash of their text, and repeated rows are written as often as they come. Extra columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import shared_folder
from . import idcoder
from .frames import documents, partitions, text_of
from .tokens import encoded, vocabulary

PART, END = 1 << 23, 2
_FILE = "range int, part int, doc_ids array<long>, lengths array<long>, blocks array<binary>"
_TYPES = pa.schema([("range", pa.int32()), ("part", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("blocks", pa.list_(pa.binary()))])


def write(docs: DataFrame, path: str, vocab: str, end: int = END, part: int = PART) -> None:
    tail = np.asarray([end], "<u4").tobytes()

    def run(batches):
        where, number = TaskContext.get().partitionId(), 0
        held: list[np.ndarray] = []
        names: list[int | None] = []
        total = 0

        def told() -> pa.RecordBatch:
            ids = np.concatenate(held)
            blocks = idcoder.encode([ids[i: i + idcoder.BLOCK] for i in range(0, len(ids), idcoder.BLOCK)])
            return pa.RecordBatch.from_pylist([{"range": where, "part": number, "doc_ids": names, "lengths": [len(x) for x in held], "blocks": blocks}], schema=_TYPES)

        for b in batches:
            doc = b.column("doc_id").to_pylist()
            for i, ids in encoded(vocab, b.column("text").to_pylist()):
                wide = np.frombuffer(ids + tail, "<u4")
                if wide.max() > 0xFFFF:                  # before the cast, which would wrap it
                    raise ValueError("ids of 65,536 and above do not fit this format")
                held.append(wide.astype(np.uint16))
                names.append(doc[i])
                total += len(held[-1])
                if total >= part:
                    yield told()
                    held, names, total, number = [], [], 0, number + 1
        if held:
            yield told()

    d = text_of(docs).withColumn("tie", F.xxhash64("text"))
    d = d.repartitionByRange(partitions(docs.sparkSession), F.col("doc_id").asc_nulls_first(), "tie").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie")
    d.select("doc_id", "text").mapInArrow(run, _FILE).write.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids (little-endian unsigned 32-bit): the documents of the files."""
    return _documents(spark, path, True)


def _documents(spark: SparkSession, path: str, with_ids: bool) -> DataFrame:
    files = spark.read.schema(_FILE).parquet(path)
    # Where each part starts among all ids is joined to the parts, a row each, before they are decoded: no document moves.
    sums = files.select("range", "part", F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    ranges = sums.groupBy("range").agg(F.sum("n").alias("n"))                         # one row per write task
    upto = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.select("range", upto(W.orderBy("range")).alias("base"))
    parts = sums.select("range", "part", upto(W.partitionBy("range").orderBy("part")).alias("more")).join(ranges, "range")
    parts = parts.select("range", "part", (F.col("base") + F.col("more")).cast("long").alias("base"))

    def run(batches):
        for b in batches:
            for row in range(b.num_rows):
                r = {n: b.column(n)[row].as_py() for n in b.schema.names}
                raw = np.concatenate(idcoder.decode(r["blocks"])).astype("<u4").tobytes()
                at = np.concatenate(([0], np.cumsum(r["lengths"])))
                cut = [raw[4 * x: 4 * y] for x, y in zip(at[:-1], at[1:], strict=True)]
                last = pa.array(cut, pa.binary()) if with_ids else pa.array([zlib.crc32(x) for x in cut], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(r["doc_ids"], pa.int64()), pa.array(at[:-1] + r["base"]), pa.array(r["lengths"], pa.int64()), last], names=["doc_id", "start", "n_tokens", "ids" if with_ids else "ids_crc32"])

    return files.join(parts, ["range", "part"]).mapInArrow(run, f"doc_id long, start long, n_tokens long, {'ids binary' if with_ids else 'ids_crc32 long'}")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/token-files-{uuid.uuid4().hex}"
    write(documents(spark, sf_dir), path, vocabulary("byte_bpe_50k.json"))
    return _documents(spark, path, False)
