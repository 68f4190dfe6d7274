"""Merkle fixity audit of WARC segments.

A page becomes a response record; records lie one after another in segments of consecutive page ids.
A leaf is the hash of a record with its offset range, a node the hash of up to ``FANOUT`` children in
order. Leaves meet in a root per segment, segment roots in one root. Two replicas are compared from
the top: only branches whose hashes differ are followed, so equal parts are never joined below the
node that vouches for them. Records under a differing leaf are named by what became of them:
``corrupt`` (bytes differ), ``moved`` (same bytes at another offset), ``missing`` or ``extra``.

Null page ids lie in a segment of their own (``NO_PAGE``; told as null); null urls and bodies count as empty; repeated rows are
separate records (ordered by their hash, so equal rows are interchangeable). Empty replicas have no
root and agree with each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import cut

SEGMENT, FANOUT = 1024, 16
NO_PAGE = -(1 << 62)     # below the segment of every page id


def record(url: Column, body: Column) -> Column:
    """The text of a response record."""
    body, url = F.coalesce(body, F.lit("")), F.coalesce(url, F.lit(""))
    head = F.concat(F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: "), url, F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    return F.concat(head, body, F.lit("\r\n\r\n"))


def records(pages: DataFrame) -> DataFrame:
    """page_id, segment, record_no, at (offset), length and digest of each record; bodies are hashed where they are read."""
    r = record(F.col("url").cast("string"), F.col("html").cast("string"))
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.sha2(r.cast("binary"), 256).alias("digest"), F.octet_length(r).cast("long").alias("length"))
    p = p.withColumn("segment", F.coalesce(F.floor(F.col("page_id") / SEGMENT), F.lit(NO_PAGE)).cast("long"))
    w = W.partitionBy("segment").orderBy(F.col("page_id").asc_nulls_first(), "digest")
    upto = F.coalesce(F.sum("length").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return p.select("page_id", "segment", (F.row_number().over(w) - 1).cast("long").alias("record_no"), upto.cast("long").alias("at"), "length", "digest")


def _node(position: Column, first: str, end: str) -> list[Column]:
    """Hash of the children in order and the range they span."""
    kids = F.sort_array(F.collect_list(F.struct(position.alias("p"), F.col("hash").alias("h"))))     # at most FANOUT
    return [F.sha2(F.array_join(F.transform(kids, lambda k: F.concat_ws(":", k["p"].cast("string"), k["h"])), ",").cast("binary"), 256).alias("hash"),
            F.min(first).alias("first"), F.max(end).alias("end")]


def _base(*sides: DataFrame) -> int:
    """The smallest segment of page ids on any side: trees to be compared count their parts from the same one."""
    least = [x.where(F.col("segment") != NO_PAGE).agg(F.min("segment")).first()[0] for x in sides]
    return min((int(x) for x in least if x is not None), default=0)


def _part(base: int) -> Column:
    """Segments counted from 1, null page ids at 0, so that division by ``FANOUT`` brings all of them to 0."""
    return F.when(F.col("segment") == NO_PAGE, F.lit(0)).otherwise(F.col("segment") - F.lit(base) + 1).cast("long")


def tree(leaves: DataFrame, base: int | None = None) -> list[DataFrame]:
    """Levels from the leaves up to the one root: part (segment group), node, hash, first, end; ``up_*`` is the parent's key."""
    part = _part(_base(leaves) if base is None else base)
    level = leaves.select(part.alias("part"), F.col("record_no").alias("node"),
                          F.sha2(F.concat_ws(":", "at", "length", "digest").cast("binary"), 256).alias("hash"), F.col("at").alias("first"), (F.col("at") + F.col("length")).alias("end"))
    size = leaves.agg(F.max("record_no").alias("r"), F.min(part).alias("lo"), F.max(part).alias("hi")).first()
    levels, most = [level], int(size.r or 0)
    while most:                                          # inside segments
        level = level.groupBy("part", F.floor(F.col("node") / FANOUT).cast("long").alias("up")).agg(*_node(F.col("node"), "first", "end")).withColumnRenamed("up", "node")
        level = cut(level)
        levels.append(level)
        most //= FANOUT
    low, high, over = int(size.lo or 0), int(size.hi or 0), 0
    while low != high:                                   # over segments: ``node`` is -1, -2 ... so that keys of levels never meet
        over += 1
        level = level.groupBy(F.floor(F.col("part") / FANOUT).cast("long").alias("up")).agg(*_node(F.col("part"), "first", "end"))
        level = cut(level.select(F.col("up").alias("part"), F.lit(-over).cast("long").alias("node"), "hash", "first", "end"))
        levels.append(level)
        low, high = low // FANOUT, high // FANOUT
    return levels


def _inside(levels: int, leaves: DataFrame) -> int:
    most, n = int(leaves.agg(F.max("record_no")).first()[0] or 0), 0
    while most:
        most, n = most // FANOUT, n + 1
    return min(n, levels - 1)


def compare(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """(segment, record_no) of leaves that differ, found from the roots down; both are results of ``records``."""
    base = _base(ours, theirs)
    a, b = tree(ours, base), tree(theirs, base)
    inside_a, inside_b = _inside(len(a), ours), _inside(len(b), theirs)
    spark = ours.sparkSession
    none = spark.createDataFrame([], "segment long, record_no long")
    same_shape = len(a) == len(b) and inside_a == inside_b
    if not same_shape:                                   # trees of unlike height: the highest level both have inside segments
        a, b = a[: min(inside_a, inside_b) + 1], b[: min(inside_a, inside_b) + 1]
    inside = min(inside_a, inside_b)

    def unlike(x: DataFrame, y: DataFrame) -> DataFrame:
        y = y.select(F.col("part").alias("p2"), F.col("node").alias("n2"), F.col("hash").alias("h2"))
        j = x.join(y, (F.col("part") == F.col("p2")) & (F.col("node") == F.col("n2")), "full")
        return j.where(~F.col("hash").eqNullSafe(F.col("h2"))).select(F.coalesce("part", "p2").alias("part"), F.coalesce("node", "n2").alias("node"))

    top = len(a) - 1
    bad = cut(unlike(a[top], b[top]))
    for k in range(top - 1, -1, -1):
        if bad.isEmpty():
            return none
        if k >= inside:                                  # the children of an over-segment node
            up = F.floor(F.col("part") / FANOUT).cast("long")
            below = [t[k].join(bad.select(F.col("part").alias("up")), up == F.col("up"), "left_semi") for t in (a, b)]
        else:
            key = bad.select(F.col("part").alias("up_part"), F.col("node").alias("up"))
            below = [t[k].join(key, (F.col("part") == F.col("up_part")) & (F.floor(F.col("node") / FANOUT).cast("long") == F.col("up")), "left_semi") for t in (a, b)]
        bad = cut(unlike(*below))
    segment = F.when(F.col("part") == 0, F.lit(NO_PAGE)).otherwise(F.col("part") + F.lit(base - 1)).cast("long")
    return bad.select(segment.alias("segment"), F.col("node").alias("record_no"))


def audit(pages: DataFrame, replica: DataFrame) -> DataFrame:
    """Every record of either replica: page_id, segment, at, length, digest (of ``pages``; of the replica for an extra one), status."""
    ours, theirs = cut(records(pages)), cut(records(replica))
    bad = compare(ours, theirs)
    at = ["segment", "record_no"]
    mine = ours.join(bad.withColumn("__bad", F.lit(True)), at, "left").withColumn("__turn", F.row_number().over(W.partitionBy("segment", "page_id", "__bad").orderBy("record_no")))
    other = theirs.join(bad, at, "left_semi").withColumn("__turn", F.row_number().over(W.partitionBy("segment", "page_id").orderBy("record_no")))
    other = other.select(F.col("segment").alias("s2"), F.col("page_id").alias("p2"), F.col("__turn").alias("t2"), F.col("at").alias("a2"), F.col("length").alias("l2"), F.col("digest").alias("d2"))
    match = (F.col("segment") == F.col("s2")) & F.col("page_id").eqNullSafe(F.col("p2")) & (F.col("__turn") == F.col("t2")) & F.col("__bad")
    j = mine.join(other, match, "full")
    status = (F.when(F.col("digest").isNull(), "extra").when(F.col("__bad").isNull(), "ok").when(F.col("d2").isNull(), "missing")
              .when(F.col("digest") != F.col("d2"), "corrupt").when(F.col("at") != F.col("a2"), "moved").otherwise("ok"))
    return j.select(F.coalesce("page_id", "p2").alias("page_id"), F.nullif(F.coalesce("segment", "s2"), F.lit(NO_PAGE)).alias("segment"), F.coalesce("at", "a2").alias("at"),
                    F.coalesce("length", "l2").alias("length"), F.coalesce("digest", "d2").alias("digest"), status.alias("status"))


def worn(pages: DataFrame) -> DataFrame:
    """A replica with known wear: every 97th body has its first character struck, every 389th page is gone."""
    struck = F.concat(F.lit("#"), F.substring("html", 2, 1 << 30))
    return pages.where(F.coalesce(F.col("page_id") % 389 != 11, F.lit(True))).withColumn("html", F.when(F.col("page_id") % 97 == 5, struck).otherwise(F.col("html")))


def op9_fixity_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return audit(pages, worn(pages))


OP9_SQL = """
WITH both_sides AS (
  SELECT 0 AS side, page_id, url, html FROM pages
  UNION ALL
  SELECT 1, page_id, url, CASE WHEN page_id % 97 = 5 THEN '#' || substr(html, 2) ELSE html END FROM pages WHERE page_id % 389 <> 11
), rec AS (
  SELECT side, page_id, 'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url || chr(13) || chr(10)
    || 'Content-Length: ' || CAST(strlen(html) AS VARCHAR) || chr(13) || chr(10) || chr(13) || chr(10) || html || chr(13) || chr(10) || chr(13) || chr(10) AS r FROM both_sides
), placed AS (
  SELECT side, page_id, CAST(page_id // 1024 AS BIGINT) AS segment, CAST(strlen(r) AS BIGINT) AS length, sha256(r) AS digest,
    CAST(coalesce(sum(strlen(r)) OVER (PARTITION BY side, page_id // 1024 ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS at FROM rec
)
SELECT a.page_id, a.segment, a.at, a.length, a.digest,
  CASE WHEN b.digest IS NULL THEN 'missing' WHEN a.digest <> b.digest THEN 'corrupt' WHEN a.at <> b.at THEN 'moved' ELSE 'ok' END AS status
FROM (SELECT * FROM placed WHERE side = 0) a LEFT JOIN (SELECT * FROM placed WHERE side = 1) b USING (page_id)
"""
