import gzip

from pyspark.sql import functions as F

from heredium.catalog import quality
from heredium.operators.trio import complete_trios
from heredium.plans.consequence import coding_consequence
from heredium.sources import sinks, text
from heredium.tables import Tables
from tests.conftest import SF

VCF = "\n".join([
    "##fileformat=VCFv4.2", "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tkid\tdad",
    "chr1\t100\t.\tA\tG\t50\tPASS\tAC=1;DB\tGT:GQ:DP:AD:PS\t0|1:30:20:10,10:77\t0/0:99:22",
    "chr1\t200\trs1\tC\tT\t.\tPASS\t.\tGT:GQ\t./1:.\t1:12", ""])


def test_vcf_reader(spark, tmp_path):
    with gzip.open(tmp_path / "a.vcf.gz", "wt") as fh:
        fh.write(VCF)
    (tmp_path / "b.vcf").write_text(VCF.replace("kid", "sis"))
    d = text.read_vcf(spark, [str(tmp_path / "a.vcf.gz"), str(tmp_path / "b.vcf")])
    got = {(r.sample_id, r.pos): r for r in text.genotype_rows(d).collect()}
    assert set(s for s, _ in got) == {"kid", "dad", "sis"}
    k = got["kid", 100]
    assert (k.alleles, k.phased, k.ps, k.gq, k.dp, k.ad) == ([0, 1], True, 77, 30, 20, [10, 10])
    assert got["dad", 100].ps is None and got["kid", 200].alleles is None and got["kid", 200].gq is None and got["dad", 200].alleles == [1]
    info = d.where("pos = 100 AND sample_id = 'kid'").first().info
    assert info == {"AC": "1", "DB": "1"}


def test_manifest_and_trios(spark, tmp_path, rows):
    p = tmp_path / "m.tsv"
    p.write_text("sample_id\tfamily_id\tfather_id\tmother_id\tsex\trole\nd\t1\t0\t0\t1\tparent\nm\t1\t0\t0\t2\tparent\nk\t1\td\tm\tfemale\toffspring\nx\t2\td\tgone\t1\toffspring\n")
    m = text.read_manifest(spark, str(p))
    assert rows(complete_trios(m), "sample_id", "sex") == [("k", "F")]
    (tmp_path / "bad.tsv").write_text("sample_id\nx\n")
    try:
        text.read_manifest(spark, str(tmp_path / "bad.tsv"))
        raise AssertionError("a manifest without its columns must not load")
    except ValueError as e:
        assert "family_id" in str(e)
    ped = tmp_path / "f.ped"
    ped.write_text("1 k d m 2 2\n1 d 0 0 1 1\n")
    assert rows(text.read_ped(spark, str(ped)), "sample_id", "affected", "sex") == [("d", 0, "M"), ("k", 1, "F")]


def test_keyed_tables_and_json(spark, tmp_path, rows):
    for k in ("fam1", "fam2"):
        (tmp_path / f"{k}.calls.tsv").write_text("a\tb\n1\t2\n")
    assert rows(text.read_keyed_tsv(spark, str(tmp_path / "*.calls.tsv"), r"^(\w+)\.calls", "family"), "family", "a") == [("fam1", "1"), ("fam2", "1")]
    (tmp_path / "c.json").write_text('[{"id": "HTT", "min": 36},\n {"id": "FMR1", "min": 200}]')
    assert rows(text.read_catalogue(spark, str(tmp_path / "c.json"), "id string, min int"), "id", "min") == [("FMR1", 200), ("HTT", 36)]


def test_gtf_symbols(spark, rows):
    lines = ['chr1\ts\tgene\t11\t90\t.\t-\t.\tgene_id "g1"; gene_name "ABC";', "chr1\ts\tgene\t11\t90\t.\t+\t.\tID=g2;Name=XYZ", "chr1\ts\tmRNA\t11\t90\t.\t+\t.\tID=t2;Parent=g2", "chr1\ts\texon\t11\t20\t.\t+\t.\tID=e;Parent=t2"]
    d = text.resolve_symbols(text.parse_gff(spark.createDataFrame([(x,) for x in lines], "line string")))
    assert rows(d, "kind", "start", "symbol") == [("exon", 10, "XYZ"), ("gene", 10, "ABC"), ("gene", 10, "XYZ"), ("mRNA", 10, "XYZ")]


def test_table_sink_has_a_twin(spark, tmp_path, rows):
    d = spark.createDataFrame([(1, 7, [1, 2], None), (2, 8, [], "x")], "family_id int, v int, arr array<int>, t string")
    sinks.write_table(d, str(tmp_path / "out"))
    assert rows(spark.read.parquet(str(tmp_path / "out/parquet")), "v", "arr") == [(7, [1, 2]), (8, [])]
    assert rows(spark.read.csv(str(tmp_path / "out/tsv"), sep="\t", header=True), "v", "arr") == [("7", "[1,2]"), ("8", "[]")]
    sinks.write_reads(d.select("v"), str(tmp_path / "reads"), "v", "s")
    names = [r.v for r in spark.read.json(str(tmp_path / "reads")).collect()]
    assert len(set(names)) == 2 and all(len(n) == 16 for n in names)


def test_info_text_skips_nulls(spark):
    d = spark.createDataFrame([("chr1", 5, "A", "C", 1, None), ("chr1", 6, "A", "C", None, None)], "chrom string, pos int, ref string, alt string, a int, b string")
    got = sorted(r.value for r in sinks.sites_vcf(d, {"A": F.col("a"), "B": F.col("b")}).collect())
    assert [x.split("\t")[-1] for x in got] == ["A=1", "."]


def test_coding_consequence(spark):
    # ATG GCT TAA on both strands; exon at 100-109 (0-based)
    tx = spark.createDataFrame([("P", 1, "ATGGCTTAA"), ("N", -1, "ATGGCTTAA")], "symbol string, strand int, cds string")
    ex = spark.createDataFrame([("P", "c1", 100, 109, 0), ("N", "c2", 100, 109, 0)], "symbol string, chrom string, e_start long, e_end long, c_start int")
    v = [(1, "c1", 106, "T", "C"), (2, "c1", 104, "G", "A"), (3, "c1", 101, "A", "G"), (4, "c1", 107, "T", "C"), (5, "c1", 104, "GCT", "G"), (6, "c1", 104, "GCTT", "G"), (7, "c1", 100, "A", "C"), (8, "c1", 96, "A", "C"), (9, "c1", 109, "AC", "A"),
         (10, "c2", 106, "C", "T"), (11, "c2", 103, "A", "T")]
    got = {r.i: (r["class"], r.detail) for r in coding_consequence(spark.createDataFrame(v, "i int, chrom string, pos long, ref string, alt string"), ex, tx, ["i"]).collect()}
    assert got[1] == ("synonymous", "p.A2A") and got[2] == ("missense", "p.A2T") and got[3][0] == "start_loss" and got[4][0] == "stop_loss"
    assert got[5][0] == "frameshift" and got[6][0] == "inframe_indel" and got[7][0] == "splice_donor_acceptor" and got[8][0] == "splice_region" and got[9][0] == "splice_indel"
    assert got[10] == ("missense", "p.A2T") and got[11] == ("stop_loss", "p.*3K")
    assert got[5][1] == "c.4fs" and got[6][1] == "c.4del3" and got[8][1] == "96A>C" and got[9][1] == "109AC>A"


def test_composed_lines_are_made_once(spark):
    lines = quality.vcf_lines(Tables(spark, SF))
    assert lines.count() > 0 and not any("lineitem" in f for f in lines.inputFiles())       # a written table, not the derivation of its rows
    d = text.parse_vcf(spark.createDataFrame([("f", "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ta"), ("f", "1\t5\t.\tA\tC\t.\t.\tAC=1;DB;E=;N=a=b\tGT\t0/1")], "file string, line string"))
    assert "BroadcastHashJoin" in d._jdf.queryExecution().executedPlan().toString()         # headers go to the rows, rows do not move
    assert d.first()["info"] == {"AC": "1", "DB": "1", "E": "", "N": "a=b"}
