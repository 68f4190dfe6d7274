"""Readers of the text formats: lines in, typed columns out, no schema inference.

Each reader has a ``parse_*`` half that takes a DataFrame of lines, so lines may come from
files, tables or a query. Block-gzipped or split files keep a cohort parallel; one plain gzip
file is one task, whatever the reader.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import genotype as g
from ..storage import cut


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``file, line`` of plain or gzipped text."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"))


def _value(c: Column) -> Column:
    return F.when(~c.isin("", ".", "NA"), c)


def _with_names(body: DataFrame, head: DataFrame) -> DataFrame:
    """Adds each file's ``names`` to its rows. Headers are written first, so that Spark knows their size: few of them go to
    the rows where those are; otherwise the rows move, and adaptive execution splits those of one large file."""
    return body.join(cut(head), "file")


def _named_cells(cells: Column, value: str) -> Column:
    """One struct per cell with its sample's name, so that the list of names is not carried by every cell."""
    return F.transform(cells, lambda c, i: F.struct(c.alias(value), F.get("names", i).alias("sample_id")))


def parse_vcf(lines: DataFrame) -> DataFrame:
    """One row per (record, sample): key columns, INFO and FORMAT maps. Sample names come from each file's own header."""
    head = lines.where(F.col("line").startswith("#CHROM")).select("file", F.slice(F.split("line", "\t"), 10, 1 << 20).alias("names"))
    f = F.split("line", "\t")
    body = lines.where(~F.col("line").startswith("#")).select("file", f.alias("f"))
    info = F.transform_values(F.str_to_map(F.col("f")[7], F.lit(";"), F.lit("=")), lambda k, v: F.coalesce(v, F.lit("1")))       # a flag has no value
    d = _with_names(body, head).select(
        "file", F.col("f")[0].alias("chrom"), F.col("f")[1].cast("long").alias("pos"), _value(F.col("f")[2]).alias("id"), F.col("f")[3].alias("ref"), F.col("f")[4].alias("alt"),
        F.col("f")[5].try_cast("double").alias("qual"), F.col("f")[6].alias("filter"), F.when(F.col("f")[7] != ".", info).alias("info"),
        F.split(F.col("f")[8], ":").alias("keys"), F.explode(_named_cells(F.slice("f", 10, 1 << 20), "cell")).alias("c"))
    vals = F.split("c.cell", ":")
    short = F.slice("keys", F.lit(1), F.size(vals))            # trailing FORMAT fields may be left out
    return d.withColumns({"sample_id": F.col("c.sample_id"), "fmt": F.map_from_arrays(short, vals)}).drop("keys", "c")


def genotype_rows(records: DataFrame) -> DataFrame:
    """Typed genotypes: alleles (NULL when any is missing), phase, quality, depth, allele depths, phase set."""
    fmt = lambda k: _value(F.try_element_at(F.col("fmt"), F.lit(k)))
    gt = g.parse_gt(fmt("GT"))
    ad = F.transform(F.split(fmt("AD"), ","), lambda x: x.try_cast("int"))
    return records.select("sample_id", "chrom", "pos", "ref", "alt", gt["alleles"].alias("alleles"), gt["phased"].alias("phased"), fmt("PS").try_cast("long").alias("ps"),
                          fmt("GQ").try_cast("int").alias("gq"), fmt("DP").try_cast("int").alias("dp"), ad.alias("ad"))


def read_vcf(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return parse_vcf(read_lines(spark, path))


# Columns a manifest must have.
MANIFEST = ("sample_id", "family_id", "father_id", "mother_id", "sex", "role")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Cohort manifest with normalised sex and NULL for absent parents; a missing column is an error."""
    d = spark.read.csv(path, sep="\t", header=True)
    lost = [c for c in MANIFEST if c not in d.columns]
    if lost:
        raise ValueError(f"manifest lacks {lost}")
    parent = lambda c: F.when(~F.col(c).isin("0", "", "."), F.col(c))
    return d.withColumns({"father_id": parent("father_id"), "mother_id": parent("mother_id"), "sex": g.normalise_sex(F.col("sex"))})


def read_ped(spark: SparkSession, path: str) -> DataFrame:
    """Six-column pedigree file."""
    f = F.split(F.trim("line"), r"\s+")
    parent = lambda c: F.when(c != "0", c)
    d = read_lines(spark, path).where(~F.col("line").startswith("#") & (F.size(f) >= 6))
    return d.select(f[1].alias("sample_id"), f[0].alias("family_id"), parent(f[2]).alias("father_id"), parent(f[3]).alias("mother_id"), g.normalise_sex(f[4]).alias("sex"), (f[5] == "2").cast("int").alias("affected"))


def build_manifest(samples: DataFrame, parents: DataFrame, sexes: DataFrame, affected: DataFrame) -> DataFrame:
    """Manifest from cohort metadata; a parent is kept only when sequenced.

    ``samples``: sample_id, family_id. ``parents``: sample_id, father_id, mother_id. ``sexes``: sample_id, sex. ``affected``: sample_id.
    """
    d = samples.join(parents, "sample_id", "left").join(sexes, "sample_id", "left").join(affected.select("sample_id", F.lit(1).alias("__a")), "sample_id", "left")
    have = samples.select(F.col("sample_id").alias("__id"), F.lit(True).alias("__have"))
    for p in ("father_id", "mother_id"):
        d = d.join(have, d[p] == F.col("__id"), "left").withColumn(p, F.when(F.col("__have"), F.col(p))).drop("__id", "__have")
    offspring = F.col("father_id").isNotNull() | F.col("mother_id").isNotNull()
    return d.withColumns({"sex": g.normalise_sex(F.col("sex").cast("string")), "affected": F.coalesce("__a", F.lit(0)), "role": F.when(offspring, "offspring").otherwise("parent")}).drop("__a")


def read_keyed_tsv(spark: SparkSession, glob: str, pattern: str, key: str) -> DataFrame:
    """Union of many tables with a key taken from each file name."""
    d = spark.read.csv(glob, sep="\t", header=True)
    return d.select("*", F.regexp_extract(F.col("_metadata.file_name"), pattern, 1).alias(key))


def parse_bed(lines: DataFrame, names: list[str] | None = None) -> DataFrame:
    """chrom, start, end and named further columns; comments and track lines are skipped."""
    f = F.split("line", "\t")
    d = lines.where(~F.col("line").rlike("^(#|track|browser)") & (F.size(f) >= 3))
    return d.select(f[0].alias("chrom"), f[1].cast("long").alias("start"), f[2].cast("long").alias("end"), *[_value(F.get(f, F.lit(3 + i))).alias(n) for i, n in enumerate(names or [])])


def parse_gff(lines: DataFrame) -> DataFrame:
    """GFF3 or GTF features with attributes; 0-based starts."""
    f = F.split("line", "\t")
    d = lines.where(~F.col("line").startswith("#") & (F.size(f) >= 9)).select(f.alias("f"))
    attr = lambda k: F.nullif(F.regexp_extract(F.col("f")[8], rf'(?:^|;)\s*{k}[= ]"?([^;"]+)', 1), F.lit(""))
    return d.select(F.col("f")[0].alias("chrom"), (F.col("f")[3].cast("long") - 1).alias("start"), F.col("f")[4].cast("long").alias("end"), F.col("f")[2].alias("kind"), F.col("f")[6].alias("strand"),
                    attr("ID").alias("id"), attr("Parent").alias("parent"), F.coalesce(attr("gene_name"), attr("Name"), attr("gene")).alias("symbol"))


def resolve_symbols(features: DataFrame) -> DataFrame:
    """Symbol of every feature through its transcript to its gene (two equality joins)."""
    pair = F.struct(F.col("symbol").isNull().alias("none"), "symbol", "parent")     # of rows that share an id, the least named one
    names = features.where("id IS NOT NULL").groupBy(F.col("id").alias("__id")).agg(F.min(pair).alias("__n"))
    names = names.select(F.col("__id").alias("parent"), F.col("__n.symbol").alias("s1"), F.col("__n.parent").alias("p1"))
    up = names.select(F.col("parent").alias("p1"), F.col("s1").alias("s2"))
    d = features.join(names, "parent", "left").join(up, "p1", "left")
    return d.withColumn("symbol", F.coalesce("s2", "s1", "symbol")).drop("s1", "s2", "p1")


def parse_pileup(lines: DataFrame, min_depth: int) -> DataFrame:
    """CpG pileup rows chrom, pos, beta, depth above the coverage floor (columns 1, 2, 4 as percent, 6)."""
    f = F.split("line", "\t")
    d = lines.where(~F.col("line").startswith("#")).select(f[0].alias("chrom"), f[1].cast("long").alias("pos"), (f[3].cast("double") / 100).alias("beta"), f[5].cast("int").alias("depth"))
    return d.where(F.col("depth") >= min_depth)


def island_profile(lines: DataFrame) -> DataFrame:
    """Long island rows from a profile with one column per sample: matched by island key and column name, never by position."""
    head = lines.where(F.col("line").startswith("chrom\t")).select("file", F.slice(F.split("line", "\t"), 5, 1 << 20).alias("names"))
    f = F.split("line", "\t")
    d = lines.where(~F.col("line").startswith("chrom\t")).select("file", f.alias("f"))
    cells = F.explode(_named_cells(F.slice("f", 5, 1 << 20), "v")).alias("c")
    d = _with_names(d, head).select(F.col("f")[0].alias("chrom"), F.col("f")[1].cast("long").alias("start"), F.col("f")[2].cast("long").alias("end"), cells)
    return d.select("chrom", "start", "end", "c.sample_id", _value(F.col("c.v")).try_cast("double").alias("value"))


def read_catalogue(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON catalogue, one object per entry, under a stated schema."""
    return spark.read.schema(schema).json(path, multiLine=True)


def parse_catalogue(lines: DataFrame, schema: str, explode: str) -> DataFrame:
    """Catalogue entries held as one JSON object per line, one row per element of ``explode``."""
    d = lines.select(F.from_json("line", schema).alias("j")).select("j.*")
    return d.withColumn(explode, F.explode(explode))


def probes_to_cpgs(probes: DataFrame, manifest: DataFrame) -> DataFrame:
    """Array probes to CpG intervals by probe id without its design suffix; unmapped probes stay, marked."""
    d = probes.withColumn("probe", g.without_probe_suffix(F.col("probe")))
    return d.join(manifest, "probe", "left").withColumn("mapped", F.col("chrom").isNotNull())


def mean_difference(df: DataFrame, cases: list[str], controls: list[str]) -> DataFrame:
    """Delta and direction of a wide table from the means of two column groups, missing values left out."""
    def mean(cols: list[str]) -> Column:
        vals = F.array_compact(F.array(*[F.col(c).cast("double") for c in cols]))
        return F.when(F.size(vals) > 0, F.aggregate(vals, F.lit(0.0), lambda a, x: a + x) / F.size(vals))

    delta = mean(cases) - mean(controls)
    return df.withColumn("delta", delta).withColumn("direction", F.signum("delta").cast("int"))
