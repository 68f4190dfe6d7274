"""Results that only larger tables reach: ties of means, dosages all samples share, sites in the pseudoautosomal ends."""

from pathlib import Path

import duckdb
import pytest

from pyspark.sql import functions as F

import __spark_entry__ as entry
from heredium.operators import ordered, trio
from heredium.plans import learning as ml
from heredium.plans import methylation as me
from heredium.tables import BASE, Tables
from tests.conftest import SF
from tools.check_oracle import rows as normal


def same_as_sql(spark, folder, name):
    con = duckdb.connect()
    for t in BASE:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder if (folder / f'{t}.parquet').exists() else SF}/{t}.parquet'")
    df = entry.queries()[name](spark, str(folder))
    cur = con.execute(entry.oracle_sql()[name])
    got = df.collect()
    assert normal(df.columns, got) == normal([d[0] for d in cur.description], cur.fetchall())
    return got


def test_means_of_the_same_values_tie(spark, tmp_path):
    values = [0.1, 55.57, 211.03, 310.99, 7.77, 560.21, 123.45, 99.99]
    events = [(24 * (22 * j + c) + s, values[(j * (1 + 2 * (c % 4)) + c + s) % 8], "click") for j in range(8) for c in range(22) for s in range(24)]
    duckdb.connect().execute("CREATE TABLE e (event_id BIGINT, value DOUBLE, event_type VARCHAR)").executemany("INSERT INTO e VALUES (?, ?, ?)", events).execute(f"COPY e TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    got = same_as_sql(spark, tmp_path, "rank_descending")
    assert len(got) == 22 * 24 and {(r["rank"], r["pct"]) for r in got} == {(1, 0.0)}


def test_dosage_all_samples_share_has_no_effect(spark):
    meth = spark.createDataFrame([(s, 1, (s * 37 % 11) / 11, float(s % 5)) for s in range(12)], "sample_id long, region_id long, value double, age double")
    isl = spark.createDataFrame([(1, "chr1", 0, 1000)], "region_id long, chrom string, start long, end long")
    dose = {("SNV", 1): lambda s: 2.0, ("SNV", 2): lambda s: 1.0 + s % 5, ("SNV", 3): lambda s: 1.0 + s % 2, ("TR", 3): lambda s: 20.0 + s % 3}
    var = spark.createDataFrame([(k, arm, s, "chr1", 500, f(s)) for (arm, k), f in dose.items() for s in range(12)], "variant_id long, arm string, sample_id long, chrom string, pos long, dosage double")
    got = {(r.arm, r.variant_id): r for r in me.cis_fits(var, isl, meth, ["age"], 0, {"SNV": 3, "TR": 3}).collect()}
    assert set(got) == set(dose) and {r.n_carriers for r in got.values()} == {12}          # one id in two arms is two variants
    assert all((got["SNV", k].beta, got["SNV", k].t, got["SNV", k].p) == (None, None, None) for k in (1, 2))
    assert all(got[x].t is not None for x in (("SNV", 3), ("TR", 3)))
    best = {r.arm: r for r in me.cis_scan(var, isl, meth, ["age"], 0, {"SNV": 3, "TR": 3}).collect()}
    assert (best["SNV"].variant_id, best["SNV"].n_tests, best["TR"].n_tests) == (3, 1, 1)


@pytest.mark.parametrize("name", ["gene_transmission_tests", "imprinted_transmission_ranked", "transmission_counts"])
def test_fathers_transmit_in_the_pseudoautosomal_ends(spark, tmp_path, name):
    con = duckdb.connect()
    con.execute(f"COPY (SELECT i AS s_suppkey FROM range(80) r(i)) TO '{tmp_path}/supplier.parquet' (FORMAT parquet)")
    con.execute(f"""COPY (SELECT i AS p_partkey, concat('Brand#', 1 + i % 3) AS p_brand, CASE i % 2 WHEN 0 THEN 'PROMO' ELSE 'SMALL' END AS p_type, CAST(1 + i % 50 AS INT) AS p_size
                    FROM range(152000, 153400) r(i) WHERE i % 23 = 22) TO '{tmp_path}/part.parquet' (FORMAT parquet)""")      # X alone, 14 sites in its second end
    con.execute(f"COPY (SELECT s_suppkey AS l_suppkey, p_partkey AS l_partkey FROM '{tmp_path}/supplier.parquet', '{tmp_path}/part.parquet') TO '{tmp_path}/lineitem.parquet' (FORMAT parquet)")
    got = same_as_sql(spark, tmp_path, name)
    if name == "transmission_counts":
        assert sum(r.t + r.nt for r in got if r.parent == "father") > 0


def test_families_of_a_shuffle_share_its_join(spark):
    d = spark.createDataFrame([(i, i % 7 / 7, i % 5 / 5, i % 3 / 3, int(i % 7 > 3)) for i in range(60)], "id long, a double, b double, c double, label int")
    seen = []
    got = ml.permutation_importance(d, {"a": ["a"], "b": ["b", "c"]}, lambda x: seen.append(x.columns) or x.withColumn("score", F.col("a") + 0 * F.col("b")), "label").collect()
    assert len(seen) == 4 and {r.family: r.importance > 0 for r in got} == {"a": True, "b": False}         # the rows as they are and three shuffles


def test_a_scan_moves_its_rows_once(spark):
    d = spark.createDataFrame([(None, 0, 1), (None, 0, 2), (None, 1, 3), (1, 0, 4), (1, 2, 5)], "k int, b int, v long")
    before = {x: spark.conf.get(x) for x in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        out = ordered.scan(d, ["k"], "b", ["v"], F.col("v"), "r", "sum")
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert sorted((r.k or 0, r.v, r.r) for r in out.collect()) == [(0, 1, 1), (0, 2, 3), (0, 3, 6), (1, 4, 4), (1, 5, 9)]
    finally:
        for x, v in before.items():
            spark.conf.set(x, v)
    assert plan.count("Exchange hashpartitioning") == 4       # the rows, and three of one row a bin


def test_tested_before_moving_equals_tested_after(spark):
    t = Tables(spark, SF)
    calls, pedigree = t("fx_genotype").withColumn("ref", F.when(F.col("site_id") % 3 > 0, F.col("ref"))), t("fx_pedigree")
    cols = ["child_id", "family_id", "sex", "affected", *trio.SITE, "c_gq", "c_dp"]
    want = trio.trio_wide(calls, pedigree).where(trio.denovo_predicate(0, 0)).select(cols).collect()
    got = trio.trio_where(calls, pedigree, *trio.denovo_tests(0, 0), ["gq", "dp"]).select(cols)
    assert sorted(map(str, got.collect())) == sorted(map(str, want)) and want            # a NULL in the allele key meets a NULL
    assert "max(" not in got._jdf.queryExecution().executedPlan().toString()   # no trio rows are built


def test_counted_trios_are_a_key_and_three_numbers(spark):
    t = Tables(spark, SF)
    calls = t("fx_genotype").withColumn("ref", F.when(F.col("site_id") % 3 > 0, F.col("ref"))).where("slot <> 1 OR site_id % 5 > 0")     # NULLs in the key, mothers without a row
    n = F.col("a1") + F.col("a2")
    want = trio.trio_wide(calls, t("fx_pedigree")).selectExpr("child_id", *trio.SITE, "c_a1 + c_a2 AS c", "f_dp AS f", "m_dp AS m")
    got = trio.trio_codes(calls, t("fx_pedigree"), n, F.col("dp"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.where("m IS NULL").count() > 0
    for name in ("domain_restriction", "heuristic_arms", "relatedness"):
        plan = entry.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("max(") == 4 and "affected" not in plan          # the child's row, and three numbers


def test_equal_rows_enter_a_fit_once_and_change_nothing(spark):
    d = spark.createDataFrame([(i, float(i % 6), float(i % 4), int((i * i) % 7 > 2), 1.0) for i in range(900)], "id long, a double, b double, label int, weight double")
    assert ml.distinct_rows(d, ["a", "b"]).count() <= 12 * 2 and ml.distinct_rows(d, ["a", "b"], 4).agg(F.sum("weight")).first()[0] == 900
    for name, params in (("logistic", {"maxIter": 200, "regParam": 0.01, "tol": 1e-9}), ("boosted", {"maxDepth": 2, "stepSize": 0.2, "maxIter": 3, "minInstancesPerNode": 80})):
        plain = ml.Pipeline(stages=[ml.VectorAssembler(inputCols=["a", "b"], outputCol="x"), ml.model(name, params)]).fit(d)
        fitted = ml.fit(d, ["a", "b"], name, params)
        want = {r.id: r.p for r in ml.predict(plain, d).collect()}
        got = {r.id: r.p for r in ml.predict(fitted, d).collect()}
        assert len(set(want.values())) > 2 and all(abs(got[i] - want[i]) < 1e-6 for i in want)


def test_read_ids_beyond_64_bits(spark, tmp_path):
    """Orders far up the keys have the rows of those at the start: the shift keeps every remainder that the derived tables take."""
    cands = 39 * 854700
    for table, key in (("lineitem", "l_orderkey"), ("orders", "o_orderkey")):
        duckdb.connect().execute(f"COPY (SELECT * REPLACE ({key} + {15 * cands} AS {key}) FROM '{SF}/{table}.parquet') TO '{tmp_path}/{table}.parquet' (FORMAT parquet)")
    back = {"cand": (cands, 4 * cands), "read_id": (150 * cands * 10 ** 11,) * 2}
    for name in ("read_observations", "junction_reads", "interval_depth", "repeat_observations"):
        near, far = (entry.queries()[name](spark, folder) for folder in (SF, str(tmp_path)))
        names = far.columns
        i = 0 if name == "repeat_observations" else 1
        moved = [tuple(int(v) - back[c][i] if c in back else v for c, v in zip(names, r, strict=True)) for r in far.collect()]
        assert near.columns == names and sorted(map(str, moved)) == sorted(map(str, map(tuple, near.collect()))), name
        assert [f.dataType for f in far.schema if f.name != "read_id"] == [f.dataType for f in near.schema if f.name != "read_id"], name
        assert moved


def test_imprinted_genes_build_their_trios_once(spark):
    from heredium.catalog import clinical

    t = Tables(spark, SF)
    arms = clinical.imprinted_arms(t)
    plan = arms._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan[plan.index("Aggregate"):] and "ad_alt" not in plan.split("Aggregate", 2)[1]
    ranked = entry.queries()["imprinted_transmission_ranked"](spark, SF)
    assert "max(" not in ranked._jdf.queryExecution().optimizedPlan().toString() and ranked.count() > 0       # trios were built, and written as a row a gene, before ranks are taken


def test_every_pair_of_samples_is_related(spark):
    """Pairs nobody declared too; samples over several blocks and sites over several groups and tiles, against the pairs one by one."""
    from heredium.plans import cohort_qc

    got = same_as_sql(spark, Path(SF), "relatedness")
    assert {"none", "father", "mother"} == {r.relation for r in got} and len(got) == len({frozenset((r.sample_id, r.other_id)) for r in got})
    calls = [(s, p, (s * p + s // 3) % 4 if (s + p) % 5 else None) for s in range(23) for p in range(90) if (s * 7 + p) % 3]
    d = spark.createDataFrame(calls, "sample_id long, pos long, n int")
    got = {(r.a, r.b): tuple(r)[2:8] for r in cohort_qc.pairwise_relatedness(d, ["pos"], rows=200, block=7, tile=5).collect()}
    of = {s: {p: n for x, p, n in calls if x == s and n in (0, 1, 2)} for s in range(23)}
    want = {}
    for a in of:
        for b in of:
            both = [(n, of[b][p]) for p, n in of[a].items() if p in of[b]]
            if a < b and both:
                want[a, b] = (len(both), sum(abs(x - y) == 2 for x, y in both), sum(x == y for x, y in both), sum(x == y == 1 for x, y in both), sum(x == 1 for x, _ in both), sum(y == 1 for _, y in both))
    assert got == want
