import random

import pytest
from pyspark.sql import functions as F

from heredium.operators import intervals as iv
from heredium.operators import ordered
from heredium.plans import evidence as ev


def make(seed, n, longest):
    r = random.Random(seed)
    out = []
    for i in range(n):
        # two thirds of the rows on one chromosome, lengths from one base to far beyond a bin
        chrom = "chr1" if r.random() < 0.66 else "chr2"
        s = r.randrange(0, 3_000_000)
        out.append((i, chrom, s, s + r.choice([1, 5, 300, 20_000, 400_000, longest])))
    return out


@pytest.fixture(scope="module")
def sides(spark):
    a, b = make(1, 160, 2_500_000), make(2, 120, 900_000)
    da = spark.createDataFrame(a, "a_id int, chrom string, start long, end long")
    db = spark.createDataFrame(b, "b_id int, chrom string, b_start long, b_end long")
    return a, b, da, db


def brute(a, b):
    return sorted((x[0], y[0]) for x in a for y in b if x[1] == y[1] and x[2] < y[3] and y[2] < x[3])


def test_overlap_join_matches_brute_force(sides, rows):
    a, b, da, db = sides
    assert rows(iv.overlap_join(da, db), "a_id", "b_id") == brute(a, b)


@pytest.mark.parametrize("bounds,test", [(iv.HALF_OPEN, lambda s, p, e: s <= p < e), (iv.CLOSED, lambda s, p, e: s <= p <= e), (iv.LEFT_OPEN, lambda s, p, e: s < p <= e)])
def test_point_bounds(spark, sides, rows, bounds, test):
    _, b, _, db = sides
    pts = [(i, b[i][1], b[i][2 + i % 2]) for i in range(len(b))]
    dp = spark.createDataFrame(pts, "p int, chrom string, pos long")
    want = sorted((p, y[0]) for p, c, at in pts for y in b if c == y[1] and test(y[2], at, y[3]))
    assert rows(iv.point_join(dp, db, bounds=bounds), "p", "b_id") == want
    hit = {p for p, _ in want}
    assert rows(iv.point_filter(dp, db, "left_anti", bounds=bounds), "p") == sorted((p,) for p, _, _ in pts if p not in hit)
    assert rows(iv.point_filter(dp, db, "left_semi", bounds=bounds), "p") == sorted((p,) for p in hit)


def test_anti_and_covered(sides, rows):
    a, b, da, db = sides
    hit = {x for x, _ in brute(a, b)}
    assert rows(iv.interval_anti(da, db, ["a_id"]), "a_id") == sorted((x[0],) for x in a if x[0] not in hit)
    small = [x for x in a if x[3] - x[2] <= 20_000]
    want = []
    for x in small:
        cells = set()
        for y in b:
            if y[1] == x[1]:
                cells.update(range(max(x[2], y[2]), min(x[3], y[3])))
        if cells:
            want.append((x[0], len(cells)))
    got = iv.covered_fraction(da.where("end - start <= 20000"), db, ["a_id"])
    assert rows(got, "a_id", "covered_bp") == sorted(want)


@pytest.mark.parametrize("bits", [12, 20])
def test_merge_across_bins(sides, rows, bits):
    a, _, da, _ = sides
    want = []
    for chrom in ("chr1", "chr2"):
        cur = None
        for s, e in sorted((x[2], x[3]) for x in a if x[1] == chrom):
            if cur and s <= cur[1]:
                cur[1] = max(cur[1], e)
            else:
                cur = [s, e]
                want.append((chrom, cur))
    assert rows(iv.merge(da, bits=bits), "chrom", "start", "end") == sorted((c, s, e) for c, (s, e) in want)


def test_bookended_intervals_merge(spark, rows):
    d = spark.createDataFrame([("c", 0, 10), ("c", 10, 20), ("c", 21, 30)], "chrom string, start long, end long")
    assert rows(iv.merge(d), "start", "end") == [(0, 20), (21, 30)]


def test_nearest_points(spark, rows):
    r = random.Random(5)
    pts = sorted(r.sample(range(5_000_000), 40))
    qs = [r.randrange(5_000_000) for _ in range(80)] + pts[:5]
    dp = spark.createDataFrame([("c", p) for p in pts], "chrom string, pos long")
    dq = spark.createDataFrame([(i, "c", q) for i, q in enumerate(qs)] + [(999, "empty", 5)], "i int, chrom string, pos long")
    got = {r.i: r.dist_point for r in iv.nearest_points(dq, dp, bits=14).collect()}
    assert got == {i: min(abs(q - p) for p in pts) for i, q in enumerate(qs)} | {999: None}


def test_scans_cross_bins(spark):
    data = [("hot", i, (i * 37) % 11, None if i % 3 else i) for i in range(200)] + [("k", 1, 5, 1)]
    d = spark.createDataFrame(data, "k string, pos int, v int, mark int").withColumn("b", F.floor(F.col("pos") / 9).cast("int"))
    d = ordered.scan(d, ["k"], "b", ["pos"], F.col("v"), "run_sum", "sum")
    d = ordered.scan(d, ["k"], "b", ["pos"], F.col("v"), "top_before", "max", inclusive=False)
    d = ordered.scan(d, ["k"], "b", ["pos"], F.col("mark"), "prev", "last", inclusive=False)
    d = ordered.scan(d, ["k"], "b", ["pos"], F.col("mark"), "next", "first_after")
    got = {r.pos: r for r in d.where("k = 'hot'").collect()}
    vals = [x[2] for x in data[:200]]
    for i in range(200):
        assert got[i].run_sum == sum(vals[: i + 1])
        assert got[i].top_before == (max(vals[:i]) if i else None)
        assert got[i].prev == (None if i == 0 else (i - 1) // 3 * 3)
        assert got[i].next == (-(-i // 3) * 3 if -(-i // 3) * 3 < 200 else None)


def test_low_runs_and_depth(spark, rows):
    pos = [0, 100, 400, 2000, 2100, 9000]
    d = spark.createDataFrame([("c", p, 0.05) for p in pos] + [("c", 300, 0.9)], "chrom string, pos long, beta double")
    assert rows(iv.low_runs(d, ["chrom"], "pos", F.col("beta") < 0.1, 500), "start", "end", "n") == [(0, 400, 3), (2000, 2100, 2), (9000, 9000, 1)]
    r = spark.createDataFrame([(500, 2500, "a"), (900, 1000, "b")], "ref_start long, ref_end long, cls string")
    got = iv.binned_coverage(r, [], "cls", ["a", "b"])
    assert rows(got, "start", "dp_a", "dp_b") == [(0, 0.5, 0.1), (1000, 1.0, 0.0), (2000, 0.5, 0.0)]


def test_nearest_segment_prefers_inside(spark, rows):
    s = spark.createDataFrame([("c", 100, 200, "in"), ("c", 250, 300, "near"), ("c", 90_000, 90_100, "far")], "chrom string, b_start long, b_end long, name string")
    q = spark.createDataFrame([(1, "c", 200), (2, "c", 240), (3, "c", 50_000)], "q int, chrom string, pos long")
    assert rows(iv.nearest_segment(q, s, ["q"], 30_000, ["name"]), "q", "name", "seg_dist") == [(1, "in", 0), (2, "near", 10)]


def test_reads_move_not_their_bins(spark):
    r = spark.createDataFrame([(i % 3, 1_020_000 + 900 * i, 1_027_500 + 900 * i, "ab"[i % 2]) for i in range(60)], "s int, ref_start long, ref_end long, cls string")
    d = iv.binned_coverage(r, ["s"], "cls", ["a", "b"])
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "REPARTITION_BY_COL" in plan          # the one that moves the reads
    want = {}
    for x in r.collect():
        for p in range(x.ref_start, x.ref_end, 100):
            k = (x.s, p // 1000 * 1000, x.cls)
            want[k] = want.get(k, 0) + 100
    got = {(x.s, x.start, c): x[f"dp_{c}"] * 1000 for x in d.collect() for c in "ab" if x[f"dp_{c}"]}       # the cell ends at 1,024,000
    assert got == want


def test_points_move_once_for_each_level_and_nothing_else(spark):
    pts = spark.createDataFrame([("chr1", p, i) for i, p in enumerate([0, 5, 16383, 16384, 700000, 2000000, None])], "chrom string, pos long, id int")
    spans = [(0, 6), (16383, 16385), (16000, 900000), (0, 3000000), (7, 7), (9, 4), (None, 8)]
    for take in (spans, spans[:1], []):
        b = spark.createDataFrame([("chr1", s, e, k) for k, (s, e) in enumerate(take)], "chrom string, b_start long, b_end long, k int")
        for bounds in (iv.HALF_OPEN, iv.CLOSED, iv.LEFT_OPEN):
            got = iv.point_join(pts, b, bounds=bounds)
            want = sorted((i, k) for i, p in enumerate([0, 5, 16383, 16384, 700000, 2000000]) for k, (s, e) in enumerate(take) if s is not None and s + bounds[0] <= p < e + bounds[1])
            assert sorted((r.id, r.k) for r in got.collect()) == want and got.columns == ["chrom", "pos", "id", "b_start", "b_end", "k"]
            assert "lambda" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_an_event_is_one_interval_for_its_three_zones(spark):
    ev_rows = [(1, 5, "chr1", 1000, 2000), (2, 5, "chr1", 1000, 1100), (3, 5, "chr1", 2000, 1000), (4, 6, "chr1", 9000, 9100), (5, 5, "chr1", 10 ** 6, 2 * 10 ** 6)]
    sites = [(5, "chr1", p, a, b) for p, a, b in [(500, 0, 1), (950, 0, 1), (1200, 0, 0), (1500, 0, 1), (1600, None, 1), (2150, 0, 1), (2400, 1, 1), (1500000, 0, 1)]] + [(6, "chr1", 9050, 0, 1)]
    events = spark.createDataFrame(ev_rows, "sv_id int, sample_id int, chrom string, start long, end long")
    calls = spark.createDataFrame(sites, "sample_id int, chrom string, pos long, a1 int, a2 int")
    for flank, window in ((600, 100), (600, 0), (50, 100), (5000, 300)):
        want = []
        for i, s, _, a, b in ev_rows:
            zones = {"in": (a + window, b - window), "l": (a - flank, a - window), "r": (b + window, b + flank)}
            seen = {k: [None if x is None else int(x != y) for m, _, p, x, y in sites if m == s and lo <= p < hi] for k, (lo, hi) in zones.items()}
            if any(seen.values()):
                mean = {k: [x for x in v if x is not None] for k, v in seen.items()}
                mean = {k: sum(v) / len(v) if v else None for k, v in mean.items()}
                both = [mean[k] for k in "lr" if mean[k] is not None]
                n, f = len(seen["l"]) + len(seen["r"]), sum(both) / len(both) if both else None
                want.append((i, len(seen["in"]), n, (mean["in"] or 0.0) / f if n >= 1 and f else None))
        d = ev.het_persistence(events, calls, ["sv_id"], flank, window, 1)
        assert sorted(tuple(r) for r in d.collect()) == sorted(want) and d.columns == ["sv_id", "sites_inside", "sites_flank", "het_persistence"]
        d = ev.het_persistence(events.where("sv_id < 5"), calls, ["sv_id"], flank, window, 1)
        assert d._jdf.queryExecution().optimizedPlan().toString().count("Generate explode(") == 1       # of bins of events: sites meet one level, and zones are no rows
