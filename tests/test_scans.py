"""Several scans of one order at once, against plain windows; bins by row count; names beside cells."""

import random

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from heredium.operators import ordered, ranks
from heredium.sources import text


def _sample(spark, n=400):
    rng = random.Random(3)
    keys = ["a", "b", None, "c"]
    data = [(keys[min(3, int(rng.random() * 6))], i, rng.choice([None, *range(5)])) for i in range(n)]
    return spark.createDataFrame(data, "k string, at int, v int").withColumn("bin", F.floor(F.col("at") / 37).cast("int"))


def test_scans_equal_windows(spark):
    d = _sample(spark)
    for inclusive in (True, False):
        w = W.partitionBy("k").orderBy("at").rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
        v = F.col("v")
        got = ordered.scans(d, ["k"], "bin", ["at"], {"s": (v, "sum"), "m": (v, "max"), "l": (v, "last")}, inclusive, totals={"s": "t"})
        want = d.withColumns({"s": F.coalesce(F.sum(v).over(w), F.lit(0)), "m": F.max(v).over(w), "l": F.last(v, ignorenulls=True).over(w), "t": F.sum(v).over(W.partitionBy("k"))})
        key = lambda df: sorted(map(repr, df.select("k", "at", "v", "s", "m", "l", "t").collect()))
        assert key(got) == key(want)


def test_scans_refuse_two_directions(spark):
    d = _sample(spark, 5)
    try:
        ordered.scans(d, ["k"], "bin", ["at"], {"a": (F.col("v"), "last"), "b": (F.col("v"), "first_after")})
    except ValueError:
        return
    raise AssertionError("two directions in one scan")


def test_bins_follow_row_counts(spark):
    d = spark.range(1000).select((F.col("id") * F.col("id")).alias("x"))
    sizes = [r["count"] for r in ordered.value_bin(d, "x", "b", rows=100, most=16).groupBy("b").count().collect()]
    assert len(sizes) == 10 and max(sizes) < 200 and sum(sizes) == 1000
    assert ordered.value_bin(d, "x", "b").where("b <> 0").isEmpty()
    assert ordered.value_bin(d.limit(0), "x", "b").isEmpty()


def test_ranks_over_many_bins(spark, monkeypatch):
    few = ordered.value_bin
    monkeypatch.setattr(ranks, "value_bin", lambda df, value, name: few(df, value, name, rows=10))
    d = _sample(spark).where("v IS NOT NULL").withColumn("p", (F.col("at") % 97 + 1) / 100.0)
    got = {(r.k, r.p): (r.before, r.cnt, r.total, r.g, r.g_before, r.g_total) for r in ranks.distribution(d, ["k"], "p", {"g": F.col("v")}, descending=True).collect()}
    every = [(r.k, r.p, r.v) for r in d.collect()]
    for (k, p), row in got.items():
        mine = [(q, v) for kk, q, v in every if kk == k]
        assert row == (sum(q > p for q, _ in mine), sum(q == p for q, _ in mine), len(mine), sum(v for q, v in mine if q == p), sum(v for q, v in mine if q > p), sum(v for _, v in mine))
    for r in ranks.benjamini_hochberg(d, ["k"], "p").collect():
        mine = sorted(q for kk, q, _ in every if kk == r.k)
        assert abs(r.q - min(1.0, min(q * len(mine) / sum(x <= q for x in mine) for q in mine if q >= r.p))) < 1e-12


def test_names_stay_with_their_file(spark):
    head = "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\t"
    lines = [("x", head + "s1\ts2"), ("y", head + "s3"), ("x", "1\t5\t.\tA\tT\t9\tPASS\tAC=1\tGT:DP\t0/1:7\t0/0"), ("y", "1\t6\t.\tA\tT\t9\tPASS\t.\tGT\t1/1\t0/1")]
    d = text.parse_vcf(spark.createDataFrame(lines, "file string, line string"))
    got = sorted((r.file, r.pos, r.sample_id or "", r.fmt["GT"], r.fmt.get("DP")) for r in d.collect())
    assert got == [("x", 5, "s1", "0/1", "7"), ("x", 5, "s2", "0/0", None), ("y", 6, "", "0/1", None), ("y", 6, "s3", "1/1", None)]
