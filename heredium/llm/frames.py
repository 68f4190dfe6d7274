"""Small DataFrame helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NO_ID = -(1 << 63)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_of(docs: DataFrame, *keep: str) -> DataFrame:
    """``doc_id``, ``text`` (null: empty) and the columns named; nothing else travels."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *keep)


def row_key() -> list[Column]:
    """``k1``, ``k2``: rows that agree in both have the same id and the same text, so they may share a result."""
    return [F.coalesce(F.col("doc_id"), F.lit(NO_ID)).alias("k1"), F.xxhash64("text").alias("k2")]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names given, lengthened until no column of ``df`` has them."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        out.append(n)
    return out
