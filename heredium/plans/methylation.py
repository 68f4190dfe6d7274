"""CpG tracks: region means, cohort tracks, canyons, bands, local parent of origin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import intervals as iv
from ..operators.ordered import join_null_safe, position_bin, scan
from ..storage import cut


def region_means(cpg: DataFrame, regions: DataFrame, keys: list[str], min_cpgs: int = 3, min_depth: float = 5) -> DataFrame:
    """Mean beta, CpG count and mean depth per (keys, region); the mean is NULL below either floor, never imputed.

    ``regions`` has ``region_id, chrom, b_start, b_end``.
    """
    hit = iv.point_join(cpg.select(*keys, "chrom", "pos", "beta", "depth"), regions)
    d = hit.groupBy(*keys, "region_id").agg(F.count("*").alias("n_cpg"), F.avg("beta").alias("__b"), F.avg("depth").alias("mean_depth"))
    ok = (F.col("n_cpg") >= min_cpgs) & (F.col("mean_depth") >= min_depth)
    return d.withColumn("mean_beta", F.when(ok, F.col("__b"))).drop("__b")


def cohort_track(cpg: DataFrame, min_support: int) -> DataFrame:
    return cpg.groupBy("chrom", "pos").agg(F.count("*").alias("n"), F.avg("beta").alias("mean_beta")).where(F.col("n") >= min_support)


def canyons(track: DataFrame, max_beta: float = 0.10, max_gap: int = 500, min_span: int = 3500) -> DataFrame:
    """Long runs of low mean methylation."""
    d = iv.low_runs(track, ["chrom"], "pos", F.col("mean_beta") < max_beta, max_gap)
    return d.where(F.col("end") - F.col("start") >= min_span)


def edge_bands(regions: DataFrame, cpg: DataFrame, width: int = 1000) -> DataFrame:
    """CpGs within ``width`` of either region boundary, marked inside or outside."""
    edge = F.explode(F.array(F.struct(F.lit("left").alias("edge"), F.col("start").alias("at")), F.struct(F.lit("right").alias("edge"), F.col("end").alias("at"))))
    e = regions.select("region_id", "chrom", edge.alias("e")).select("region_id", "chrom", F.col("e.edge").alias("edge"), F.col("e.at").alias("at"))
    e = e.withColumns({"b_start": F.col("at") - width, "b_end": F.col("at") + width})
    hit = iv.point_join(cpg, e)
    inside = (F.col("edge") == "left") == (F.col("pos") >= F.col("at"))
    return hit.withColumn("side", F.when(inside, "inside").otherwise("outside"))


def class_features(cpg: DataFrame, annotations: DataFrame) -> DataFrame:
    """``sample_id, cls, beta, ncpg``: CpGs inside the union of a class's intervals (``cls, chrom, b_start, b_end``), each once."""
    union = iv.merge(annotations, ("cls", "chrom"), "b_start", "b_end")
    hit = iv.point_join(cpg.select("sample_id", "chrom", "pos", "beta"), union)
    return hit.groupBy("sample_id", "cls").agg(F.avg("beta").alias("beta"), F.count("*").alias("ncpg"))


def own_extents(cpg: DataFrame, regions: DataFrame, max_beta: float = 0.10, max_gap: int = 500) -> DataFrame:
    """``sample_id, region_id, width``: how far a canyon reaches in each sample from its centre, in both directions over low CpGs with small gaps.

    The search starts at the sample's first CpG at or after the centre; a region where that CpG is outside it or not low has no row, nor has one
    where nothing joins it. Both directions are one numbering of runs over the sample's ordered track."""
    d = cpg.select("sample_id", "chrom", "pos", (F.coalesce(F.col("beta") < max_beta, F.lit(False))).alias("low")).withColumn("__bin", position_bin(F.col("pos")))
    keys = ["sample_id", "chrom"]
    d = scan(d, keys, "__bin", ["pos"], F.struct("pos", "low"), "__p", "last", inclusive=False)
    opens = F.when(F.col("low") & F.coalesce(F.col("__p.low"), F.lit(False)) & (F.col("pos") - F.col("__p.pos") <= max_gap), 0).otherwise(1)
    d = scan(d, keys, "__bin", ["pos"], opens, "__run", "sum").select(*keys, "pos", "low", F.col("__run").alias("run"))
    extent = d.where("low").groupBy(*keys, "run").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    half = regions.select("region_id", "chrom", F.floor((F.col("start") + F.col("end")) / 2).cast("long").alias("b_start"), F.col("end").alias("b_end"))
    start = iv.point_join(d, half).groupBy(*keys, "region_id").agg(F.min_by(F.struct("low", "run"), "pos").alias("c"))
    start = start.where("c.low").select(*keys, "region_id", F.col("c.run").alias("run"))
    return start.join(extent, [*keys, "run"]).where("hi > lo").select("sample_id", "region_id", (F.col("hi") - F.col("lo") + 2).alias("width"))


def canyon_features(cpg: DataFrame, regions: DataFrame, max_beta: float = 0.10, max_gap: int = 500, band: int = 1000) -> DataFrame:
    """Per sample: mean beta inside canyons (``region_id, chrom, start, end``), just inside and just outside their edges, the edge slope, and the sample's own extents."""
    s, e = F.col("start"), F.col("end")
    zone = lambda z, a, b: F.struct(F.lit(z).alias("zone"), a.cast("long").alias("a"), b.cast("long").alias("b"))
    zones = F.array(zone("interior", s, e), zone("inner", s, F.least(s + band, e)), zone("outer", F.greatest(s - band, F.lit(0)), s), zone("inner", F.greatest(e - band, s), e), zone("outer", e, e + band))
    z = regions.select("chrom", F.explode(zones).alias("z")).select("chrom", F.col("z.zone").alias("zone"), F.col("z.a").alias("b_start"), F.col("z.b").alias("b_end")).where("b_end > b_start")
    hit = iv.point_join(cpg.select("sample_id", "chrom", "pos", "beta"), z)
    mean = lambda n: F.avg(F.when(F.col("zone") == n, F.col("beta")))
    g = hit.groupBy("sample_id").agg(mean("interior").alias("canyon_interior_beta"), mean("inner").alias("canyon_edge_inner_beta"), mean("outer").alias("canyon_edge_outer_beta"))
    own = own_extents(cpg, regions, max_beta, max_gap).groupBy("sample_id").agg(F.sum("width").alias("w"), F.avg("width").alias("canyon_mean_width_bp"), F.count("*").alias("n"))
    d = cpg.select("sample_id").distinct().join(g, "sample_id", "left").join(own, "sample_id", "left")
    zero = F.lit(0).cast("long")
    return d.select("sample_id", "canyon_interior_beta", "canyon_edge_inner_beta", "canyon_edge_outer_beta", (F.col("canyon_edge_outer_beta") - F.col("canyon_edge_inner_beta")).alias("canyon_edge_slope"),
                    F.coalesce("w", zero).alias("canyon_total_bp"), "canyon_mean_width_bp", F.coalesce("n", zero).alias("canyon_n"))


def residual_features(features: DataFrame, covariates: list[str], clean: Column, least: int = 8) -> DataFrame:
    """Long features (``sample_id, feature, value`` and covariates) with ``scaled``: the residual on the covariates, fitted on clean samples, over its SD there.

    Missing covariates take their mean over samples. A feature with fewer than ``least`` clean values, or without spread, has NULLs."""
    from ..operators.regression import ols

    means = features.select("sample_id", *covariates).distinct().agg(*[F.avg(c).alias(f"__m_{c}") for c in covariates])      # one row
    d = features.crossJoin(F.broadcast(means)).withColumns({c: F.coalesce(F.col(c).cast("double"), F.col(f"__m_{c}")) for c in covariates}).drop(*[f"__m_{c}" for c in covariates])
    fit = ols(d.where(clean), ["feature"], "value", covariates, least).select("feature", "n", "coef")
    d = d.join(fit, "feature", "left")
    pred = F.get("coef", F.lit(0))
    for i, c in enumerate(covariates):
        pred = pred + F.get("coef", F.lit(i + 1)) * F.col(c)
    d = d.withColumn("resid", F.col("value") - pred)
    r = F.when(clean, F.col("resid"))
    sd = d.groupBy("feature").agg(F.sqrt(F.sum(F.pow(r, 2)) / (F.count(r) - len(covariates) - 1)).alias("sd"))
    return d.join(sd, "feature").select("sample_id", "feature", "value", "resid", F.when(F.col("sd") > 1e-12, F.col("resid") / F.col("sd")).alias("scaled"))


def local_origin(centres: DataFrame, sites: DataFrame, id_cols: list[str], widths: tuple[int, int] = (20000, 50000), min_sites: int = 2) -> DataFrame:
    """Parent of origin from informative sites near a centre, in the narrow window first, then the wide one.

    ``sites`` has ``chrom, site_pos, vote`` (+1 paternal, -1 maternal).
    """
    narrow, wide = widths
    b = centres.select(*id_cols, "chrom", F.col("pos").alias("mid"), (F.col("pos") - wide).alias("b_start"), (F.col("pos") + wide).alias("b_end"))
    hit = iv.point_join(sites, b, pos="site_pos", bounds=iv.CLOSED)
    close = F.abs(F.col("site_pos") - F.col("mid")) <= narrow
    n = hit.groupBy(*id_cols).agg(F.count_if(close).alias("n1"), F.sum(F.when(close, F.col("vote")).otherwise(0)).alias("v1"), F.count("*").alias("n2"), F.sum("vote").alias("v2"))
    use1, use2 = F.coalesce(F.col("n1") >= min_sites, F.lit(False)), F.coalesce(F.col("n2") >= min_sites, F.lit(False))
    v = F.when(use1, F.col("v1")).when(use2, F.col("v2"))
    basis = F.when(use1, f"local{narrow // 1000}").when(use2, f"local{wide // 1000}").otherwise("none")
    origin = F.when(v > 0, "paternal").when(v < 0, "maternal").when(v == 0, "tied").otherwise("none")
    return centres.select(*id_cols).join(n, id_cols, "left").select(*id_cols, basis.alias("basis"), origin.alias("origin"))


def sum_counts(parts: DataFrame, keys: list[str], min_depth: int) -> DataFrame:
    """Modified and unmodified counts summed over the parts of one track; beta where the depth floor is met."""
    d = parts.groupBy(*keys).agg(F.sum("mod").alias("mod"), F.sum("unmod").alias("unmod"))
    depth = F.col("mod") + F.col("unmod")
    return d.where(depth >= min_depth).withColumns({"depth": depth, "beta": F.when(depth > 0, F.col("mod") / depth)})


def impute(matrix: DataFrame, probe: str, value: str, max_missing: float = 0.5) -> DataFrame:
    """Long probe matrix without probes missing in more than ``max_missing``; gaps take the probe's cohort mean."""
    s = matrix.groupBy(probe).agg(F.avg(value).alias("__m"), F.count(value).alias("__n"), F.count("*").alias("__t"))
    keep = s.where((F.col("__t") - F.col("__n")) <= max_missing * F.col("__t")).select(probe, "__m")
    d = join_null_safe(matrix, keep, [probe], "inner")
    return d.withColumn("imputed", F.col(value).isNull()).withColumn(value, F.coalesce(value, "__m")).drop("__m")


def two_compartments(markers: DataFrame, atlas: DataFrame, blood_samples: DataFrame, tissue: str = "epithelium", blood: str = "blood", cell: str = "granulocyte") -> DataFrame:
    """Tissue share of each sample from the mean unmethylated fraction at the tissue's markers, between blood and the pure tissue; the share of one blood cell from its own markers.

    ``markers``: sample_id, target, u (unmethylated fraction). ``atlas``: target, cell, u. The zero is the mean of ``blood_samples`` (sample_id), or the
    atlas mean of blood cells where there are none. Shares are cut to 0..1."""
    of = lambda t: F.avg(F.when(F.col("target") == t, F.col("u")))
    s = markers.groupBy("sample_id").agg(of(tissue).alias("u_tissue"), of(cell).alias("u_cell"))
    zero = s.join(blood_samples.select("sample_id").distinct(), "sample_id", "left_semi").agg(F.avg("u_tissue").alias("z"))
    ref = lambda t, c: F.avg(F.when((F.col("target") == t) & (F.col("cell") == c), F.col("u")))
    pure = atlas.agg(ref(tissue, tissue).alias("one"), ref(tissue, blood).alias("b"), ref(cell, cell).alias("c"))
    d = s.crossJoin(F.broadcast(zero)).crossJoin(F.broadcast(pure))                      # one row each
    z = F.coalesce("z", "b")
    clip = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    share = F.when(F.col("u_tissue").isNotNull() & (F.col("one") != z), clip((F.col("u_tissue") - z) / (F.col("one") - z)))
    return d.select("sample_id", "u_tissue", share.alias("tissue_share"), F.when(F.col("u_cell").isNotNull() & (F.col("c") > 0), clip(F.col("u_cell") / F.col("c"))).alias("cell_share"))


def promoter_islands(islands: DataFrame, genes: DataFrame, window: int) -> DataFrame:
    """Islands within ``window`` of a transcription start (``genes``: symbol, chrom, tss)."""
    b = genes.withColumns({"b_start": F.col("tss") - window, "b_end": F.col("tss") + window + 1})
    return iv.overlap_join(islands, b)


def haplotype_islands(cpg: DataFrame, regions: DataFrame, min_cpgs: int = 1) -> DataFrame:
    """Per sample and island: mean of haplotype 1, haplotype 2 and all reads, wide."""
    hit = iv.point_join(cpg.select("sample_id", "chrom", "pos", "beta", "hap"), regions)
    of = lambda h: F.when(F.count_if(F.col("hap") == h) >= min_cpgs, F.avg(F.when(F.col("hap") == h, F.col("beta"))))
    return hit.groupBy("sample_id", "region_id").agg(of("hap1").alias("h1"), of("hap2").alias("h2"), F.avg("beta").alias("combined"))


def asm_calls(hap: DataFrame, origins: DataFrame, min_diff: float = 0.30, max_p: float = 1e-3, min_sites: int = 2, agree: float = 0.9) -> DataFrame:
    """Allele-specific islands of each child with the methylated parent where nearby sites agree.

    ``hap``: sample_id, region_id, h1, h2, p. ``origins``: sample_id, region_id, n_sites, n_mat (hap 1 maternal votes).
    """
    d = hap.where((F.col("p") < max_p) & (F.abs(F.col("h1") - F.col("h2")) >= min_diff)).join(origins, ["sample_id", "region_id"], "left")
    fm = F.when(F.col("n_sites") > 0, F.col("n_mat") / F.col("n_sites"))
    hap1_mat = F.when(F.col("n_sites") >= min_sites, F.when(fm >= agree, True).when(1 - fm >= agree, False))
    parent = F.when(hap1_mat.isNull(), "unassigned").when(hap1_mat == (F.col("h1") > F.col("h2")), "maternal").otherwise("paternal")
    return d.withColumn("methylated_parent", parent)


def asm_catalogue(calls: DataFrame, hap: DataFrame) -> DataFrame:
    """Island catalogue: children with data, with a call, by methylated parent, and the class."""
    data = hap.where("h1 IS NOT NULL AND h2 IS NOT NULL").groupBy("region_id").agg(F.count("*").alias("n_data"))
    of = lambda v: F.count_if(F.col("methylated_parent") == v)
    c = calls.groupBy("region_id").agg(F.count("*").alias("n_asm"), of("maternal").alias("n_maternal"), of("paternal").alias("n_paternal"), of("unassigned").alias("n_unassigned"))
    a = F.col("n_maternal") + F.col("n_paternal")
    share = F.when(a > 0, F.col("n_maternal") / a)
    cls = (F.when((a >= 5) & (F.greatest(share, 1 - share) >= 0.9), F.when(F.col("n_maternal") > F.col("n_paternal"), "imprinted_like_maternal_methylated").otherwise("imprinted_like_paternal_methylated"))
           .when((F.col("n_asm") >= 5) & (a >= 4) & share.between(0.25, 0.75), "sequence_dependent_ASM").when(F.col("n_asm") >= 5, "frequent_ASM_unclassified").otherwise("sporadic_ASM"))
    return c.join(data, "region_id").withColumn("class", cls)


def imprinting_loss(hap: DataFrame, islands: DataFrame, max_diff: float = 0.15, low: float = 0.2, high: float = 0.8) -> DataFrame:
    """Samples without allele difference and with extreme combined methylation at imprinted-like islands."""
    d = hap.join(islands.select("region_id"), "region_id", "left_semi").where(F.abs(F.col("h1") - F.col("h2")) < max_diff)
    pattern = F.when(F.col("combined") <= low, "both_unmethylated").when(F.col("combined") >= high, "both_methylated")
    return d.withColumn("pattern", pattern).where("pattern IS NOT NULL")


def cis_fits(variants: DataFrame, islands: DataFrame, methylation: DataFrame, covariates: list[str], window: int, min_carriers: dict[str, int] | int = 1) -> DataFrame:
    """Every tested pair: ``region_id, variant_id, arm, n_carriers, n, beta, se, t, p`` of dosage against island methylation with covariates.

    ``variants``: variant_id, sample_id, chrom, pos, dosage and, if arms differ, arm: carriers only, absent samples have dosage 0.
    ``methylation``: sample_id, region_id, value, covariates. The normal equations have a part that belongs to the island (summed once over
    its samples) and one that belongs to the pair and is summed over the variant's carriers, so a pair costs its carriers and not the cohort."""
    from ..operators.regression import solve_sums

    v = variants if "arm" in variants.columns else variants.withColumn("arm", F.lit("SNV"))
    b = islands.select("region_id", "chrom", (F.col("start") - window).alias("b_start"), (F.col("end") + window).alias("b_end"))
    pairs = iv.point_join(v.select("variant_id", "arm", "chrom", "pos").distinct(), b).select("variant_id", "arm", "region_id")
    m = methylation.dropna(subset=["value", *covariates]).select("sample_id", "region_id", F.col("value").cast("double").alias("value"), *[F.col(c).cast("double").alias(c) for c in covariates])
    one, rest = F.lit(1.0), ["value", *covariates]
    base = {"1": one} | {c: F.col(c) for c in rest}
    names = list(base)
    island = m.groupBy("region_id").agg(F.count("*").alias("n"), F.struct(*[F.sum(base[x] * base[y]).alias(f"{x}|{y}") for i, x in enumerate(names) for y in names[i:]]).alias("island"))
    carried = v.select("variant_id", "arm", "sample_id", F.col("dosage").cast("double").alias("dosage"))     # ids are unique within an arm
    d = join_null_safe(pairs, carried, ["variant_id", "arm"], "inner").join(m, ["region_id", "sample_id"])
    pair = d.groupBy("region_id", "variant_id", "arm").agg(F.count_if(F.col("dosage") != 0).alias("n_carriers"), F.sum(F.col("dosage") * F.col("dosage")).alias("dd"), F.struct(*[F.sum(F.col("dosage") * base[x]).alias(x) for x in names]).alias("pair"))
    floors = min_carriers if isinstance(min_carriers, dict) else {}
    least = F.lit(min_carriers if not floors else 1)
    for arm, k in floors.items():
        least = F.when(F.col("arm") == arm, k).otherwise(least)
    d = pair.where(F.col("n_carriers") >= least).join(island, "region_id")
    # The order of the equations: intercept, dosage, covariates; the outcome last.
    cols = ["1", "dosage", *covariates, "value"]

    def product(x: str, y: str) -> Column:
        if x == y == "dosage":
            return F.col("dd")
        if "dosage" in (x, y):
            return F.col("pair")[y if x == "dosage" else x]
        x, y = sorted((x, y), key=names.index)
        return F.col("island")[f"{x}|{y}"]

    k = len(cols) - 1
    s = F.array(*[product(cols[i], cols[j]) for i in range(k + 1) for j in range(i, k + 1)])
    return solve_sums(d.where(F.col("n") > k).select("region_id", "variant_id", "arm", "n_carriers", "n", s.alias("s")), ["region_id", "variant_id", "arm", "n_carriers"], k)


def cis_scan(variants: DataFrame, islands: DataFrame, methylation: DataFrame, covariates: list[str], window: int, min_carriers: dict[str, int] | int = 1) -> DataFrame:
    """Best variant per island and arm from :func:`cis_fits` (largest absolute t, those that agree to six decimals by id), Bonferroni over the island's tests, then BH over islands of an arm."""
    from ..operators import ranks, selection

    fit = cis_fits(variants, islands, methylation, covariates, window, min_carriers).where("p IS NOT NULL AND NOT isnan(p)")
    fit = cut(fit)                                       # read by the counts, the best and the ranks
    tests = fit.groupBy("region_id", "arm").agg(F.count("*").alias("n_tests"))
    best = selection.best_per_key(fit, ["region_id", "arm"], [-F.round(F.abs("t"), 6), F.col("variant_id")], ["variant_id", "n_carriers", "n", "beta", "se", "t", "p"])
    best = best.join(tests, ["region_id", "arm"]).withColumn("p_bonf", F.least(F.lit(1.0), F.col("p") * F.col("n_tests")))
    best = cut(best)
    q = ranks.benjamini_hochberg(best, ["arm"], "p_bonf").select("arm", "p_bonf", "q")
    return join_null_safe(best, q, ["arm", "p_bonf"], "left")
