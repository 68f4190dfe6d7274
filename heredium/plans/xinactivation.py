"""X chromosome: block orientation, inactivation skew, gene status, screens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..operators import intervals as iv
from ..operators import selection as sel


def island_sets(islands: DataFrame, chroms: Column, min_len: int, max_len: int, n: int, seed: int) -> DataFrame:
    """Islands of the wanted chromosomes and lengths, sampled to ``n`` per chromosome group with a fixed seed."""
    d = islands.where((F.col("end") - F.col("start")).between(min_len, max_len)).withColumn("grp", chroms)
    return sel.sample_n(d.where("grp IS NOT NULL"), ["grp"], ["chrom", "start"], n, seed)


def orient_x_blocks(wide: DataFrame, min_votes: int, agree: float) -> DataFrame:
    """Paternal haplotype of each daughter's X block: the father is hemizygous, so his one allele names it."""
    d = wide.where((F.col("chrom") == "chrX") & (F.col("sex") == "F") & (F.col("c_a1") != F.col("c_a2")) & (F.col("c_phased") == 1) & (F.col("f_a1") == F.col("f_a2")))
    v = F.when(F.col("c_a1") == F.col("f_a1"), 1).otherwise(-1)
    g = d.groupBy("child_id", "c_ps").agg(F.count("*").alias("n"), F.sum(v).alias("v"))
    share = (F.abs(F.col("v")) + F.col("n")) / (2 * F.col("n"))
    ok = (F.col("n") >= min_votes) & (share >= agree)
    return g.select("child_id", "c_ps", "n", F.when(~ok, "unresolved").when(F.col("v") > 0, "hap1_paternal").otherwise("hap2_paternal").alias("orientation"))


def informative_islands(values: DataFrame, min_each: int = 15, male_max: float = 0.20, female: tuple[float, float] = (0.25, 0.75)) -> DataFrame:
    """Islands unmethylated in males and half methylated in females (``values``: region_id, sample_id, sex, combined)."""
    of = lambda s, e: F.when(F.col("sex") == s, e)
    g = values.where("combined IS NOT NULL").groupBy("region_id").agg(F.count(of("M", F.lit(1))).alias("n_m"), F.count(of("F", F.lit(1))).alias("n_f"), F.median(of("M", F.col("combined"))).alias("male_median"), F.median(of("F", F.col("combined"))).alias("female_median"))
    return g.where((F.col("n_m") >= min_each) & (F.col("n_f") >= min_each) & (F.col("male_median") < male_max) & F.col("female_median").between(*female))


def skew(values: DataFrame, informative: DataFrame, controls: DataFrame, orientation: DataFrame, min_islands: int = 10, min_span: float = 0.05) -> DataFrame:
    """Inactivation skew of each female: signed where her blocks are oriented, folded with the control noise floor otherwise.

    ``values``: sample_id, sex, region_id, h1, h2, combined; ``controls``: region_id; ``orientation``: sample_id, region_id, sign.
    """
    v = values.join(informative.select("region_id"), "region_id", "left_semi")
    u = v.where("sex = 'M'").groupBy("sample_id").agg(F.median("combined").alias("m")).agg(F.median("m").alias("u"))
    both = F.col("h1").isNotNull() & F.col("h2").isNotNull()
    diff = F.when(both, F.col("h1") - F.col("h2"))
    f = v.where("sex = 'F'").join(orientation, ["sample_id", "region_id"], "left")
    g = f.groupBy("sample_id").agg(F.count(diff).alias("n_islands"), F.median(F.abs(diff)).alias("observed"), F.median("combined").alias("combined"), F.count(F.col("sign") * diff).alias("n_signed"), F.avg(F.col("sign") * diff).alias("signed"))
    c = values.where("sex = 'F'").join(controls.select("region_id"), "region_id", "left_semi").groupBy("sample_id").agg(F.count(diff).alias("n_ctl"), F.median(F.abs(diff)).alias("ctl"))
    d = g.join(c, "sample_id", "left").crossJoin(F.broadcast(u))
    d = d.withColumn("span", 2 * F.col("combined") - 2 * F.col("u")).where((F.col("n_islands") >= min_islands) & (F.col("span") > min_span))
    floor = F.when(F.col("n_ctl") >= min_islands, F.col("ctl")).otherwise(0.0)
    trio = F.col("n_signed") >= min_islands
    pat = F.least(F.greatest(rules.trio_skew(F.col("signed"), F.col("span")), F.lit(0.0)), F.lit(1.0))
    value = F.when(trio, F.greatest(pat, 1 - pat)).otherwise(F.least(rules.folded_skew(F.col("observed"), floor, F.col("span")), F.lit(1.0)))
    silenced = F.when(~trio, "unknown").when(F.col("signed") > 0, "paternal").otherwise("maternal")
    d = d.withColumns({"skew": F.round(value, 4), "method": F.when(trio, "trio-phased").otherwise("folded"), "silenced_x": silenced})
    return d.withColumn("band", rules.skew_band(F.col("skew"))).select("sample_id", "n_islands", "method", "skew", "silenced_x", "band")


def gene_status(genes: DataFrame, islands: DataFrame, medians: DataFrame, window: int, male_max: float = 0.20, female_min: float = 0.25) -> DataFrame:
    """subject / escapes / uninformative per gene from the nearby island with the largest female-male separation.

    ``genes``: symbol, chrom, start, end, tss. ``medians``: region_id, male_median, female_median.
    """
    reach = genes.withColumns({"b_start": F.least(F.col("tss") - window, F.col("start")), "b_end": F.greatest(F.col("tss") + window + 1, F.col("end"))}).select("symbol", "chrom", "tss", F.col("start").alias("g_start"), F.col("end").alias("g_end"), "b_start", "b_end")
    hit = iv.overlap_join(islands.select("region_id", "chrom", "start", "end"), reach)
    near = (F.abs(F.col("start") - F.col("tss")) <= window) | ((F.col("start") >= F.col("g_start")) & (F.col("end") <= F.col("g_end")))
    d = hit.where(near).join(medians, "region_id")
    best = sel.best_per_key(d, ["symbol"], [F.col("male_median") - F.col("female_median"), F.col("region_id")], ["region_id", "male_median", "female_median"])
    low = F.col("male_median") < male_max
    call = F.when(F.col("region_id").isNull(), "no covered island").when(low & (F.col("female_median") >= female_min), "subject").when(low, "escapes").otherwise("uninformative")
    return genes.select("symbol").distinct().join(best, "symbol", "left").withColumn("status", call)


def sv_parental_haplotype(junction_reads: DataFrame, orientation: DataFrame, id_cols: list[str]) -> DataFrame:
    """Parent whose haplotype carries an event: unanimous over its junction reads, else unresolved.

    ``junction_reads``: ids, child_id, ps, hp. ``orientation``: child_id, c_ps, orientation.
    """
    o = orientation.where("orientation <> 'unresolved'").select("child_id", F.col("c_ps").alias("ps"), "orientation")
    d = junction_reads.join(o, ["child_id", "ps"])
    pat = (F.col("orientation") == "hap1_paternal") == (F.col("hp") == 1)
    g = d.groupBy(*id_cols).agg(F.count_if(pat).alias("n_pat"), F.count_if(~pat).alias("n_mat"))
    return g.withColumn("parent", F.when(F.col("n_mat") == 0, "paternal").when(F.col("n_pat") == 0, "maternal").otherwise("unresolved"))


def x_screen(denovo: DataFrame, sites: DataFrame, centre: tuple[int, int]) -> DataFrame:
    """De novo X calls by consequence class and whether they fall in the inactivation centre."""
    d = denovo.where(F.col("chrom") == "chrX").join(sites.select("site_id", "consequence", "symbol"), "site_id")
    return d.withColumns({"cls": rules.consequence_class(F.col("consequence")), "in_centre": F.col("pos").between(*centre).cast("int")})
