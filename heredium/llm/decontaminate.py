"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly.

Documents are partitioned by the size of their set of five-word shingles (powers of two). In a
partition with sets of up to ``u`` hashes, one permutation is cut into at least ``2 * u`` bins by
leading bits, and a document's signature is its smallest hash in each bin; a shingle of a document is
in its signature with probability 0.78 or more, however long the document. An item has a signature
for every partition (a hash that is the smallest of its bin stays so in finer bins, so one number per
hash says from which partition on). A document and an item are candidates if their signatures agree
in a bin. An item of ten shingles, eight of them in a document, is missed about five times in a
million. Items with fewer than ``TINY`` shingles are looked up by all hashes of the documents, so
none of them is missed. Candidates are verified on the shingles themselves: ``shared / item
shingles`` must reach the threshold.

Words are runs of letters and digits in lower case. Items and documents of fewer than five words have
no shingles and match nothing; null texts count as empty; null ids stay null; repeated rows are
reported for each row; repeated items likewise by ``item_id``. Extra columns are ignored. DataFrame
expressions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .frames import NO_ID, documents, row_key, text_of, unused
from .native import NOT_ALNUM, let, shingle_hashes, shingle_texts, words

THRESHOLD, TINY, BROADCAST_ROWS = 0.8, 8, 500_000


def _words(text):
    return words(F.lower(text), NOT_ALNUM)


def items_of(benchmark: DataFrame) -> DataFrame:
    """item_id, item (number of the row's text), shingles (distinct), for items that have any."""
    b = benchmark.select("item_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    b = b.select("item_id", shingle_texts(_words(F.col("text"))).alias("item_shingles")).where(F.size("item_shingles") > 0)
    return b.withColumn("item_key", F.xxhash64("item_id", "item_shingles")).dropDuplicates(["item_id", "item_shingles"])


def item_signatures(benchmark: DataFrame) -> DataFrame:
    """hash, item_key, item_size and ``bits``: the hash is the smallest of its bin where bins have more leading bits than that."""
    b = benchmark.select("item_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    b = b.select("item_id", _words(F.col("text")).alias("w"))
    b = b.select(F.xxhash64("item_id", shingle_texts(F.col("w"))).alias("item_key"), F.sort_array(F.array_distinct(shingle_hashes(F.col("w"), whole=False))).alias("h"))
    b = b.select("item_key", F.size("h").alias("item_size"), "h", F.posexplode("h").alias("i", "hash"))
    before = F.when(F.col("i") > 0, F.get("h", F.col("i") - 1))
    same = F.coalesce(64 - F.length(F.bin(F.col("hash").bitwiseXOR(before))), F.lit(-1))      # leading bits shared with the next smaller hash
    return b.select("hash", "item_key", "item_size", same.alias("bits")).distinct()


def candidates(docs: DataFrame, benchmark: DataFrame, tiny: int = TINY) -> DataFrame:
    """Distinct (k1, k2, item_key) whose signatures agree in a bin."""
    items = item_signatures(benchmark)
    size = items.agg(F.count("*").alias("n"), F.min("item_size").alias("least")).first()
    all_hashes = size.least is not None and size.least < tiny
    d = text_of(docs).select(*row_key(), F.sort_array(F.array_distinct(shingle_hashes(_words(F.col("text")), whole=False))).alias("h"))
    d = d.where(F.size("h") > 0).withColumn("bits", F.floor(F.log2(F.size("h"))).cast("int") + 2)     # bins: over twice the partition's largest set

    def bin_of(x):
        return F.call_function("shiftright", x, 64 - F.col("bits"))

    keep = let(F.col("h"), lambda h: F.filter(h, lambda x, i: (i == 0) | (bin_of(x) != bin_of(F.get(h, i - 1)))))
    if all_hashes:
        rows = d.select("k1", "k2", "bits", F.explode("h").alias("hash")).withColumn("least", F.lit(False)).unionByName(
            d.select("k1", "k2", "bits", F.explode(keep).alias("hash")).withColumn("least", F.lit(True)))
        agree = F.when(F.col("least"), F.col("bits") > F.col("item_bits")).otherwise(F.col("item_size") < tiny)
    else:
        rows, agree = d.select("k1", "k2", "bits", F.explode(keep).alias("hash")), F.col("bits") > F.col("item_bits")
    items = items.withColumnRenamed("bits", "item_bits")
    if size.n <= BROADCAST_ROWS:                         # about 40 bytes a row; beyond, Spark shuffles both sides
        items = F.broadcast(items)
    return rows.join(items, "hash").where(agree).select("k1", "k2", "item_key").distinct()


def matches(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document row and item contained in it: k1, k2, doc_id, item_id, shared, item_shingles, containment."""
    items = items_of(benchmark)
    found = candidates(docs, benchmark)
    d = text_of(docs).select("doc_id", "text", *row_key())
    pairs = d.join(found, ["k1", "k2"]).join(items, "item_key")
    shared = F.size(F.array_intersect(shingle_texts(_words(F.col("text"))), "item_shingles"))
    n = F.size("item_shingles")
    out = pairs.select("k1", "k2", "doc_id", "item_id", shared.cast("long").alias("shared"), n.cast("long").alias("item_shingles"))
    out = out.withColumn("containment", F.col("shared") / F.col("item_shingles"))
    return out.where(F.col("containment") >= threshold)


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of documents that contain no item, as they are."""
    columns, (k1, k2, bad1, bad2) = docs.columns, unused(docs, "k1", "k2", "bad1", "bad2")
    bad = matches(docs, benchmark, threshold).select(F.col("k1").alias(bad1), F.col("k2").alias(bad2)).distinct()
    d = docs.withColumns({k1: F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), k2: F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))})
    return d.join(bad, (F.col(k1) == F.col(bad1)) & (F.col(k2) == F.col(bad2)), "left_anti").select(*columns)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("k1", "k2")


OP10_SQL = r"""
WITH dw AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
ds AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM dw WHERE len(w) >= 5)),
bw AS (SELECT item_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark),
bs AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS i FROM bw WHERE len(w) >= 5)),
bn AS (SELECT item_id, count(*) AS item_shingles FROM bs GROUP BY item_id)
SELECT doc_id, item_id, count(*) AS shared, item_shingles, count(*) / item_shingles AS containment
FROM ds JOIN bs USING (s) JOIN bn USING (item_id) GROUP BY doc_id, item_id, item_shingles HAVING count(*) / item_shingles >= 0.8
"""
