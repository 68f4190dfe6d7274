"""Candidates of three classes, read walks and interval evidence on hand-made rows."""

from pyspark.sql import functions as F

from heredium.functions import reads as rd
from heredium.plans import candidates as cd
from heredium.plans import evidence as ev
from heredium.plans import observations as ob

MEMBERS = [("C", 3), ("F", 1), ("M", 2)]


def trio(spark):
    return spark.createDataFrame([(9, 3, 1, 2)], "family_id long, child_id long, father_id long, mother_id long")


def test_one_row_for_each_novel_allele(spark):
    rows = [("chr1", 10, [0, 1], [0, 0], [0, 0]), ("chr1", 20, [1, 2], [0, 0], [0, 0]), ("chr1", 30, [1, 2], [0, 1], [0, 0]), ("chr1", 40, [0, 1], None, [0, 0]),
            ("chr1", 50, [0, 1], [0, None], [0, 0]), ("chr1", 60, [1, 1], [0, 0], [1, 0]), ("chr1", 70, [], [0, 0], [0, 0])]
    g = [(s, c, p, "A", ["T", "AGG"], a[k], 30, 20) for c, p, *a in rows for k, s in enumerate((3, 1, 2)) if a[k] is not None]
    d = cd.small_variants(spark.createDataFrame(g, "sample_id long, chrom string, pos long, ref string, alts array<string>, alleles array<int>, gq int, dp int"), trio(spark))
    got = sorted((r.start, r.alt, r.variant_class, r.variant_id) for r in d.collect())
    assert got == [(10, "T", "SNV", "chr1:10:A:T"), (20, "AGG", "INDEL", "chr1:20:A:AGG"), (20, "T", "SNV", "chr1:20:A:T"), (30, "AGG", "INDEL", "chr1:30:A:AGG")]


def test_sv_and_repeat_candidates(spark):
    sv = [(s, "chr2", 100, "sv1" if k == 0 else ".", "N", ["<DEL>"], "DEL", -300, None, a, 20) for k in (0, 1) for s, a in ((3, [0, 1]), (1, [0, 0]), (2, [0, k]))]
    d = cd.structural_variants(spark.createDataFrame(sv, "sample_id long, chrom string, pos long, sv_name string, ref string, alts array<string>, svtype string, svlen long, end long, alleles array<int>, gq int"), trio(spark))
    assert [(r.variant_id, r.start, r.end, r.alt) for r in d.collect()] == [("sv1", 100, 400, "<DEL>")]
    cases = [("a", "CAG", [30, 45]), ("b", "CAG", [30, 37]), ("c", "CA,CAGT", [14, 30]), ("d", "", [31, 35])]       # parents 20/34 and 16/34
    tr = [(s, "chr3", i * 100, None, trid, motifs, al, None) for i, (trid, motifs, child) in enumerate(cases) for s, al in ((3, child), (1, [20, 34]), (2, [16, 34]))]
    d = cd.repeats(spark.createDataFrame(tr, "sample_id long, chrom string, pos long, end long, trid string, motifs string, alleles array<int>, gq long"), trio(spark))
    got = sorted((r.variant_id, r.alt, F_json(r.payload, "direction"), F_json(r.payload, "delta_units")) for r in d.collect())
    assert got == [("a:a1", "<AL=45>", "expansion", 3.67), ("b:a1", "<AL=37>", "expansion", 1.0), ("c:a0", "<AL=14>", "contraction", 1.0), ("d:a1", "<AL=35>", "expansion", 1.0)]
    wide = cd.repeats(spark.createDataFrame(tr, "sample_id long, chrom string, pos long, end long, trid string, motifs string, alleles array<int>, gq long"), trio(spark), min_units=3)
    assert [r.variant_id for r in wide.collect()] == ["a:a1"]


def F_json(text, key):
    import json

    return json.loads(text)[key]


def test_members_that_cannot_matter_do_not_move(spark):
    kin = spark.createDataFrame([(9, 3, 1, 2), (9, 4, 1, 2), (8, 5, 1, 2), (9, 3, 1, 2), (9, 6, 6, 2), (9, 7, None, 2), (9, 8, 1, 1)], "family_id long, child_id long, father_id long, mother_id long")     # siblings, a couple in two families, a trio twice, a child that is its father, one without, one parent twice
    al = {1: [0, 0], 2: [0, 1], 3: [0, 2], 4: [0, 1], 5: [2, 2], 6: [2, 2], 7: [2, 2], 8: [1, 2]}
    g = spark.createDataFrame([(s, c, 10, "A", ["T", "G"], a, 30, 20) for c in ("chr1", None) for s, a in al.items()], "sample_id long, chrom string, pos long, ref string, alts array<string>, alleles array<int>, gq int, dp int")
    d = cd.small_variants(g, kin)
    got = sorted((r.family_id, r.sample_id, r.chrom or "", r.alt) for r in d.collect())
    assert got == sorted((f, s, c, a) for c in ("chr1", "") for f, s, a in ((9, 3, "G"), (8, 5, "G"), (9, 8, "T"), (9, 8, "G")))       # a NULL in the site meets a NULL
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "partial_max" not in plan and plan.index("Window") < plan.index("_w0") < plan.index("REPARTITION_BY_COL")       # no trio row is built before the rows move, nor its columns added
    moved = cd.trio_rows(g, kin, ["chrom", "pos"], ["alleles"], F.array_max("alleles") > 1, F.array_max("alleles") < 1)      # of the parents only sample 1 passes
    assert sorted((r.child_id, r.father.alleles, r.mother.alleles) for r in moved.where("chrom = 'chr1'").collect()) == [(8, [0, 0], [0, 0])]


def test_lists_mark_candidates(spark):
    found = spark.createDataFrame([("chr1", 5, "A", "T", "SNV", None), ("chr1", 9, "N", "<DEL>", "SV", '{"svtype":"DEL"}'), ("chr1", 7, "<TR>", "<AL=3>", "TR", '{"trid":"x"}'), ("chr2", 5, "A", "T", "SNV", None)],
                                  "chrom string, start long, ref string, alt string, variant_class string, payload string")
    lists = spark.createDataFrame([("b", "LOW", "SNV", "chr1", 5, "A", "T", None, None), ("a", "HIGH", "SNV", "chr1", 5, "A", "T", None, None), ("s", "LOW", "SV", "chr1", 9, None, None, "DEL", None),
                                   ("t", "LOW", "TR", None, None, None, None, None, "x"), ("n", "HIGH", "SV", "chr1", 9, None, None, "DUP", None)],
                                  "name string, tier string, variant_class string, chrom string, start long, ref string, alt string, svtype string, trid string")
    got = {(r.chrom, r.variant_class): (r.source_list, r.list_tier) for r in cd.listed(found, lists).collect()}
    assert got == {("chr1", "SNV"): ("a;b", "HIGH"), ("chr1", "SV"): ("s", "LOW"), ("chr1", "TR"): ("t", "LOW"), ("chr2", "SNV"): (None, None)}


READ = "read_id string, sample_id long, chrom string, ref_start long, cigar_text string, seq string, hp int, ps long, mapq int, nm long, clipped long, supplementary int, sa_pos long"


def reads(spark, rows):
    d = spark.createDataFrame([(n, s, "chr1", start, cigar, seq, hp, 1, 60, 0, 0, supp, sa) for n, s, start, cigar, seq, hp, supp, sa in rows], READ).withColumn("cigar", rd.parse_cigar(F.col("cigar_text")))
    part = F.array(F.struct("chrom", F.col("sa_pos").alias("pos"), F.lit("500M").alias("cigar")))
    return d.withColumn("sa", F.when(F.col("sa_pos").isNotNull(), part)).drop("cigar_text", "sa_pos")


def members(spark, *cands):
    return spark.createDataFrame([(c, r, s) for c in cands for r, s in MEMBERS], "cand long, role string, sample_id long")


def test_one_walk_answers_several_sites(spark):
    q = spark.createDataFrame([(1, "chr1", 103, 103, "A", "C", "SNV"), (2, "chr1", 110, 110, "A", "ATT", "INDEL"), (3, "chr1", 120, 122, "ACG", "A", "INDEL"), (4, "chr1", 121, 121, "A", "G", "SNV"), (5, "chr1", 130, 130, "T", "G", "SNV")],
                              "cand long, chrom string, start long, end long, ref string, alt string, variant_class string")
    seq = "S" * 2 + "XXCXXXXXXX" + "TT" + "A" * 10 + "A" * 8 + "G" * 20
    r = reads(spark, [("r1", 3, 100, "2S10M2I10M2D28M", seq, 1, 0, None), ("r2", 1, 100, "60M", "A" * 60, None, 0, None), ("short", 3, 100, "11M", "C" * 11, 2, 0, None), ("supp", 3, 100, "60M", "C" * 60, 2, 1, None)])
    got = {(x.cand, x.role, x.read_id): (x.support, x.hp) for x in ob.point_observations(q, members(spark, 1, 2, 3, 4, 5), r).collect()}
    assert got[(1, "C", "r1")] == ("ALT", 1) and got[(1, "F", "r2")] == ("REF", 0) and got[(1, "C", "short")] == ("ALT", 2)
    assert got[(2, "C", "r1")] == ("ALT", 1) and got[(2, "F", "r2")] == ("REF", 0)
    assert got[(3, "C", "r1")] == ("ALT", 1)
    assert got[(4, "C", "r1")] == ("AMB", 1)                      # deleted there
    assert got[(5, "C", "r1")] == ("AMB" if seq[2 + 10 + 2 + 10 + 7] not in "TG" else "ALT", 1)
    assert (2, "C", "short") not in got and not any(k[2] == "supp" for k in got)


def test_split_reads_need_both_ends(spark):
    q = spark.createDataFrame([(7, "chr1", 10000, 15000, "N", "<DEL>", "SV", "DEL", -5000)], "cand long, chrom string, start long, end long, ref string, alt string, variant_class string, svtype string, svlen long")
    r = reads(spark, [
        ("split", 3, 8000, "2000M", "", 1, 0, 15000), ("elsewhere", 3, 8000, "2000M", "", 1, 0, 40000), ("inline", 3, 9000, "1000M5000D1000M", "", 2, 0, None), ("other_size", 3, 9000, "1000M500D4000M", "", 2, 0, None),
        ("plain", 1, 9000, "2000M", "", 1, 0, None), ("named", 2, 9900, "150M", "", 2, 0, None), ("twice", 3, 8000, "2000M", "", 2, 0, 15000), ("twice", 3, 15000, "500M", "", 2, 1, 8000)])
    named = spark.createDataFrame([(7, "named"), (7, "named")], "cand long, read_id string")
    got = sorted((x.role, x.read_id, x.support) for x in ob.event_observations(q, members(spark, 7), r, named).collect())
    assert got == [("C", "elsewhere", "AMB"), ("C", "inline", "ALT"), ("C", "other_size", "REF"), ("C", "split", "ALT"), ("C", "twice", "ALT"), ("F", "plain", "REF"), ("M", "named", "ALT")]
    j = {x.role: x for x in ev.junction_counts(q, r, members(spark, 7), named, ["cand"]).collect()}
    assert (j["C"].junc_1, j["C"].junc_2, j["C"].junc_both_ends) == (1, 4, 1)        # the split read is near its first breakpoint only
    assert (j["M"].junc_2, j["F"].junc_1, j["F"].junc_both_ends) == (1, 0, 0)


def test_a_deletion_inside_a_read_is_no_depth(spark):
    e = spark.createDataFrame([(7, "chr1", 10000, 15000), (8, "chr1", 900000, 905000)], "cand long, chrom string, start long, end long")
    r = reads(spark, [("d", 3, 5000, "5000M5000D6000M", "", 1, 0, None), ("w", 3, 5000, "16000M", "", 2, 0, None), ("s", 3, 5000, "16000M", "", 2, 1, None)])
    got = {(x.cand, x.role): x for x in ev.interval_depth(e, r, members(spark, 7, 8), ["cand"], min_flank=0.5).collect()}
    assert len(got) == 6                                                             # also those without reads
    c = got[(7, "C")]
    assert (round(c.ratio_1, 6), round(c.ratio_2, 6), round(c.dp_in, 6), round(c.dp_fl, 6)) == (0, 1, 1, 2)
    assert got[(8, "M")].dp_in == 0 and got[(8, "M")].ratio_all is None


def test_repeat_reads_by_role(spark):
    q = spark.createDataFrame([(1, "x", 3, 60, [40], [20, 58], [30, 31])], "cand long, trid string, unit int, target int, others array<int>, father_al array<int>, mother_al array<int>")
    rows = [(n, s, "x", ln, [50, 50], 1, 1, 60, 0, 0, 0) for n, s, ln in (("a", 3, 162), ("b", 3, 141), ("c", 3, 150), ("d", 1, 161), ("e", 1, 160), ("f", 2, 163), ("g", 3, 90))]
    d = spark.createDataFrame(rows, "read_id string, sample_id long, trid string, query_length long, flanks array<long>, hp int, ps long, mapq int, nm long, clipped long, supplementary int")
    got = {x.read_id: x.support for x in ob.repeat_observations(q, members(spark, 1), d).collect()}
    assert got == {"a": "ALT", "b": "REF", "c": "AMB", "d": "AMB", "e": "ALT", "f": "ALT", "g": "AMB"}     # the father's 58 leaves no tolerance


def test_sites_of_a_batch_are_answered_like_single_ones(spark):
    import random

    draw = random.Random(5)
    sites, rows = [], []
    for c in range(40):
        snv, at = c % 2 == 0, 100 + draw.randrange(60)
        sites.append((c, "chr1", at, at, "A" if snv or c % 4 == 1 else "ACG", draw.choice("CGT") if snv else "ATT" if c % 4 == 1 else "A", "SNV" if snv else "INDEL"))
    for n in range(60):
        cigar = "".join(f"{draw.randrange(1, 9)}{op}" for op in ["S"] * (n % 2) + [draw.choice("MMMMIDN=X") for _ in range(draw.randrange(1, 30))])
        rows.append((f"r{n:02}", 1, 90 + draw.randrange(30), cigar, None if n == 7 else "".join(draw.choices("ACGT", k=draw.randrange(40, 200))), 1, 0, None))
    rows.append(("none", 1, 90, "", "ACGT", 1, 0, None))
    q = spark.createDataFrame(sites, "cand long, chrom string, start long, end long, ref string, alt string, variant_class string")
    r = reads(spark, rows)
    both = spark.createDataFrame([(c, role, 1) for c in range(40) for role in "FM"], "cand long, role string, sample_id long")     # one sample in two roles
    got = {(x.cand, x.role, x.read_id): x.support for x in ob.point_observations(q, both, r).collect()}
    ops = rd.placed(F.col("cigar"), F.col("ref_start"))
    end, reach = F.col("ref_start") + rd.reference_span(F.col("cigar")), F.when(F.col("variant_class") == "SNV", 0).otherwise(3)
    pairs = r.crossJoin(q.drop("chrom")).where(rd.spans(F.col("ref_start"), end, F.col("start") - reach, F.col("end") + reach))
    said = F.when(F.col("variant_class") == "SNV", rd.support_snv(rd.base_at(ops, F.col("seq"), F.col("start")), F.col("ref"), F.col("alt"))).otherwise(rd.support_indel(rd.indel_at(ops, F.col("start")), F.lit(True), F.col("ref"), F.col("alt")))
    want = {(x.cand, role, x.read_id): x.said for x in pairs.select("cand", "read_id", said.alias("said")).collect() for role in "FM"}
    assert got == want and {"ALT", "REF", "AMB"} == set(want.values()) and len(want) > 400


def test_reads_are_walked_in_batches_as_one_by_one(spark):
    rows = [(1, "3S5M2D4M1I3M", 100), (2, None, 7), (3, "", 9), (4, "4M3N2=1X2I5H1P6M", 50), (5, "10M", None), (6, "7D", 3)]
    d = spark.createDataFrame(rows, "id int, text string, s long").withColumn("cigar", rd.parse_cigar(F.col("text")))
    for kinds in (("I", "D"), rd.BOTH):
        want = F.transform(F.filter(rd.placed(F.col("cigar"), F.col("s")), lambda c: c["op"].isin(*kinds)), lambda c: F.struct(c["op"].alias("op"), c["len"].alias("len"), c["r"].alias("r")))
        one = d.select("id", (F.col("s") + rd.reference_span(F.col("cigar"))).alias("end"), want.alias("ops")).collect()
        many = d.repartition(2).select("id", rd.operations(F.col("cigar"), F.col("s"), *kinds).alias("o")).select("id", "o.end", "o.ops").collect()
        known = {r.id for r in one if r.end is not None}
        assert known == {1, 3, 4, 6} and {r.id: r.end for r in one} == {r.id: r.end for r in many}
        assert {r.id: r.ops for r in one if r.id in known} == {r.id: r.ops for r in many if r.id in known}


def test_no_read_is_walked_by_a_fold(spark):
    d = reads(spark, [("a", 3, 100, "50M100D50M", "A" * 100, 1, 0, None)])
    q = spark.createDataFrame([(7, "chr1", 150, 250, "SV", "DEL", -100, "A", "<DEL>", 3)], "cand long, chrom string, start long, end long, variant_class string, svtype string, svlen int, ref string, alt string, sample_id long")
    named = spark.createDataFrame([], "cand long, read_id string")
    outs = [ob.event_observations(q, members(spark, 7), d, named), ev.junction_counts(q, d, members(spark, 7), named, ["cand"]), ev.interval_depth(q.select("cand", "chrom", "start", "end"), d, members(spark, 7), ["cand"])]
    assert all("aggregate(cigar" not in x._jdf.queryExecution().optimizedPlan().toString() for x in outs)
    assert [r.support for r in outs[0].collect()] == ["ALT"]
