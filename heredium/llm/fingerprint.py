"""Threshold-scaled sketches: of the hashes of all runs of twelve code points, those below a fixed fraction.

A shingle is kept or not by its hash alone, whatever the text's length, and one in eight is kept. So the
sketch of a union is the union of sketches, and the share of one text's kept hashes that another kept
estimates how much of the first lies in the second, however unequal their lengths. Shingles of code
points give even a sentence a dozen kept hashes. A text of fewer than twelve code points has one shingle,
itself. A text whose hashes all lie above the threshold keeps its smallest one as a mark: a mark never
counts in an estimate, which is null (unknown) where nothing else is left; the query then says 1 for equal
fingerprints and 0 for others. The empty text has no shingle and is alike only to itself.

Everything is DataFrame expressions. Null texts count as empty. Null ids come last in descending
order; rows that share an id follow each other by the hash of their text, so repeated rows are each
other's next document. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from math import inf, nextafter

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .frames import documents, partitions, text_of
from .native import let

FRACTION, SIZE = 8, 12               # one hash in so many is kept; code points of a shingle
ROWS = 2048                          # rows of a range of ids, about
_SHINGLES = f"(?s)(?=(.{{{SIZE}}}))"


def _below(every: Column, fraction: int) -> Column:
    """The hashes below the threshold."""
    return F.filter(every, lambda h: h < -(1 << 63) + (1 << 64) // fraction) if fraction > 1 else every


def _kept(every: Column, fraction: int) -> Column:
    """Sorted distinct kept hashes; the smallest of all where none lies below the threshold."""
    return let(_below(every, fraction), lambda kept: F.when((F.size(kept) == 0) & (F.size(every) > 0), F.array(F.array_min(every))).otherwise(F.sort_array(F.array_distinct(kept))))


def shingles(text: Column) -> Column:
    """Every run of ``SIZE`` code points, in linear time; a shorter text is its own; none of the empty text."""
    short = F.when(text == "", F.array().cast("array<string>")).otherwise(F.array(text))
    return F.when(F.length(text) >= SIZE, F.regexp_extract_all(text, F.lit(_SHINGLES), F.lit(1))).otherwise(short)


def sketch(text: Column, fraction: int = FRACTION) -> Column:
    """Sorted distinct kept hashes; of a text that is not empty, at least one."""
    return let(F.transform(shingles(text), lambda s: F.xxhash64(s)), lambda every: _kept(every, fraction))


def merge(a: Column, b: Column, fraction: int = FRACTION) -> Column:
    """Sketch of both texts together."""
    return let(F.array_union(a, b), lambda every: _kept(every, fraction))


def containment(a: Column, b: Column, fraction: int = FRACTION) -> Column:
    """Estimated share of ``a``'s shingles that are in ``b``; of nothing, 1; null where no hash of ``a`` lies below the threshold."""
    return F.when(F.size(a) == 0, 1.0).otherwise(let(_below(a, fraction), lambda mine: F.when(F.size(mine) > 0, F.size(F.array_intersect(mine, b)) / F.size(mine))))


def likeness(a: Column, b: Column, fraction: int = FRACTION) -> Column:
    """Estimated share of the shingles of either text that are in both; of nothing, 1, of one empty text, 0; null where no hash of either lies below the threshold."""
    def of(every: Column) -> Column:
        both = F.size(F.array_intersect(every["a"], every["b"]))
        return F.when(F.size(every["a"]) + F.size(every["b"]) > 0, both / (F.size(every["a"]) + F.size(every["b"]) - both))

    known = let(F.struct(_below(a, fraction).alias("a"), _below(b, fraction).alias("b")), of)
    return F.when(F.size(a) + F.size(b) == 0, 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(known)


def as_text(s: Column) -> Column:
    """Sixteen hexadecimal digits for each kept hash, in order."""
    return F.array_join(F.transform(s, lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))), "")


def _ranges(d: DataFrame) -> DataFrame:
    """Adds ``bin`` (higher ids, higher bins; null ids -1) and ``sub``: ranges of about ``ROWS`` rows.

    Ranges are cut at quantiles of the ids. An id that fills whole ranges by itself has one of its own, which is cut by ``tie``, as null ids are."""
    key = F.col("doc_id").cast("double")
    size = d.agg(F.count("*").alias("n"), F.count("doc_id").alias("ids")).first()
    most = 16 * partitions(d.sparkSession)                # bounds what the driver holds and the rows of ``tops``
    bins = max(1, min(most, size.ids // ROWS))
    cuts = d.agg(F.percentile_approx(key, F.array(*[F.lit(i / bins) for i in range(1, bins)]), F.lit(10 * most)).alias("c")).first().c if bins > 1 else []
    hot = {c: n for c in set(cuts or []) if (n := cuts.count(c)) > 1}
    edges = sorted({x for c in cuts or [] for x in ((c, nextafter(c, inf)) if c in hot else (c,))})
    splits = [-inf, *edges, inf]
    if len(splits) > 2:
        d = Bucketizer(splits=splits, inputCol="__id", outputCol="__bin", handleInvalid="keep").transform(d.withColumn("__id", F.coalesce(key, F.lit(float(splits[1]) - 1))))
        d = d.withColumn("bin", F.when(F.col("doc_id").isNull(), -1).otherwise(F.col("__bin").cast("int"))).drop("__id", "__bin")
    else:
        d = d.withColumn("bin", F.when(F.col("doc_id").isNull(), -1).otherwise(0))
    parts = {splits.index(c): n + 1 for c, n in hot.items()}
    if size.n > size.ids:
        parts[-1] = max(1, min(most, (size.n - size.ids) // ROWS))
    many = F.lit(1)
    for b, n in parts.items():
        many = F.when(F.col("bin") == b, n).otherwise(many)
    return d.withColumn("sub", F.floor((F.col("tie").cast("double") / 2.0 ** 64 + 0.5) * many).cast("int"))


def with_next(docs: DataFrame, fraction: int = FRACTION) -> DataFrame:
    """doc_id, text, sketch, text and sketch of the next document in descending id order, the first following the last.

    Ids are cut into ranges and each is one window; the first document of the range that comes next is
    added at the end of a range. One shuffle carries the texts; sketches, as long as their texts, are made after it.
    """
    d = _ranges(text_of(docs).withColumn("tie", F.xxhash64("text")))
    first = F.struct(F.coalesce(-F.col("doc_id"), F.lit((1 << 63) - 1)), "tie")
    tops = d.groupBy("bin", "sub").agg(F.min_by(F.struct("doc_id", "tie"), first).alias("top"))
    down = W.orderBy(F.col("bin").desc(), F.col("sub"))  # a row per range
    here = F.struct("bin", "sub")
    last = F.max_by(here, F.struct(-F.col("bin"), "sub")).over(W.partitionBy())
    tops = tops.select("bin", "sub", F.coalesce(F.lag(here).over(down), last).alias("before"), F.col("top.doc_id").alias("top_id"), F.col("top.tie").alias("top_tie"))
    t = tops.select(F.col("bin").alias("t_bin"), F.col("sub").alias("t_sub"), "before", "top_id", "top_tie")
    found = (F.col("bin") == F.col("t_bin")) & (F.col("sub") == F.col("t_sub")) & F.col("doc_id").eqNullSafe(F.col("top_id")) & (F.col("tie") == F.col("top_tie"))
    extra = d.join(F.broadcast(t), found).groupBy("before", "doc_id", "tie").agg(F.min("text").alias("text"))         # one, however often the first row is repeated
    extra = extra.select("doc_id", "text", "tie", F.col("before.bin").alias("bin"), F.col("before.sub").alias("sub"), F.lit(1).alias("added"))
    rows = d.withColumn("added", F.lit(0)).unionByName(extra)
    w = W.partitionBy("bin", "sub").orderBy("added", F.col("doc_id").desc_nulls_last(), "tie")
    rows = rows.withColumn("next_text", F.lead("text").over(w)).where("added = 0")
    return rows.select("doc_id", "text", sketch(F.col("text"), fraction).alias("sketch"), "next_text", sketch(F.col("next_text"), fraction).alias("next_sketch"))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = with_next(documents(spark, sf_dir))
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - third), F.substring("next_text", F.lit(1), third))
    d = d.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "sketch", "next_sketch")
    d = d.withColumn("edited_sketch", sketch(F.col("edited")))
    near = lambda a, b: F.coalesce(likeness(F.col(a), F.col(b)), (F.col(a) == F.col(b)).cast("double"))
    return d.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), as_text(F.col("sketch")).alias("fingerprint"),
        as_text(F.col("edited_sketch")).alias("edited_fingerprint"), near("sketch", "edited_sketch").alias("near_edited"), near("sketch", "next_sketch").alias("near_next"),
    )
