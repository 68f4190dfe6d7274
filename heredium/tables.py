"""Genomics-shaped tables derived from the driver's Parquet files.

One SQL text per table serves Spark and DuckDB. ``{name}`` refers to a base table
or another derived table; ``{slots}`` is the only engine-specific piece (a row
generator over the four members of a family). Arithmetic is on integers, so both
engines give the same rows. Every table grows linearly with the table it comes
from: genotype calls are the distinct (family, site) pairs seen in ``lineitem``
times the four family members, never suppliers times parts.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BASE = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

# 40 consecutive sites of one chromosome share a phase block.
SITES_PER_BLOCK = 40
BLOCK_SPAN = 23 * SITES_PER_BLOCK


def _chrom(p: str) -> str:
    return f"CASE WHEN {p} % 23 = 22 THEN 'chrX' ELSE concat('chr', CAST(1 + {p} % 23 AS VARCHAR(4))) END"


def _ref(p: str) -> str:
    return f"CASE {p} % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'C' WHEN 2 THEN 'G' ELSE 'T' END"


def _alt(p: str) -> str:
    return (
        f"CASE WHEN {p} % 10 = 9 THEN concat({_ref(p)}, 'AT') "
        f"ELSE CASE {p} % 4 WHEN 0 THEN 'C' WHEN 1 THEN 'G' WHEN 2 THEN 'T' ELSE 'A' END END"
    )


def _allele(s: str, bit: str) -> str:
    """Allele on haplotype ``bit`` (0 or 1) of founder ``s`` at the site."""
    return (f"CASE WHEN ((31 - 2 * {bit}) * {s} + (13 + 6 * {bit}) * site_id + 17 * (1 + {bit}) + ({s} % 7) * (site_id % 7)) "
            f"% (11 + 2 * {bit}) < 2 THEN 1 ELSE 0 END")


# Spark reads these through a one-row generator, which keeps filters and projections above from inlining
# (and so repeating) the allele arithmetic.
CALL_COLUMNS = "sample_id, family_id, slot, site_id, block, a1, a2"

# A read's id is a BIGINT while it fits. Where the keys of lineitem take it beyond, Spark counts it as a wider whole number, so no id is cut and none ends
# the run; remainders of it stay BIGINT.
READ_ID = "(10 * l_orderkey + l_linenumber) * 100000000000 + l_partkey * 100000 + l_suppkey"
WIDE_READ_ID = READ_ID.replace("l_orderkey", "CAST(l_orderkey AS DECIMAL(20, 0))")
NARROW = (1 << 63) - 1

FIXTURES: dict[str, str] = {}

FIXTURES["fx_pedigree"] = """
SELECT sample_id, family_id, slot,
       CASE WHEN slot >= 2 THEN sample_id - slot END AS father_id,
       CASE WHEN slot >= 2 THEN sample_id - slot + 1 END AS mother_id,
       CASE WHEN slot = 0 THEN 'M' WHEN slot = 1 THEN 'F'
            WHEN (family_id + slot) % 2 = 0 THEN 'M' ELSE 'F' END AS sex,
       CASE WHEN slot = 2 THEN 1 ELSE 0 END AS affected
FROM (SELECT s_suppkey AS sample_id, CAST(floor(s_suppkey / 4) AS BIGINT) AS family_id,
             CAST(s_suppkey % 4 AS INT) AS slot FROM {supplier}) x
"""

FIXTURES["fx_site"] = f"""
SELECT p_partkey AS site_id, {_chrom('p_partkey')} AS chrom, 3000000 + 1000 * p_partkey AS pos,
       {_ref('p_partkey')} AS ref, {_alt('p_partkey')} AS alt, p_brand AS symbol,
       CASE p_type WHEN 'PROMO' THEN 'stop_gained' WHEN 'SMALL' THEN 'frameshift_variant'
                   WHEN 'ECONOMY' THEN 'missense_variant' WHEN 'LARGE' THEN 'synonymous_variant'
                   ELSE 'intron_variant' END AS consequence,
       CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE ((31 * p_partkey) % 1000) / 400000.0E0 END AS gnomad_af,
       CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_size / 100.0E0 END AS s_het,
       CAST(floor(p_partkey / {BLOCK_SPAN}) AS BIGINT) AS block
FROM {{part}}
"""

FIXTURES["fx_call"] = """
SELECT DISTINCT CAST(floor(l_suppkey / 4) AS BIGINT) AS family_id, l_partkey AS site_id FROM {lineitem}
"""

# Children copy one haplotype of each parent per block; the source sample (s1, s2) and haplotype (b1, b2) of both
# alleles are worked out first, so each allele formula is evaluated once per row.
FIXTURES["fx_genotype"] = f"""
SELECT sample_id, family_id, slot, site_id, {_chrom('site_id')} AS chrom, 3000000 + 1000 * site_id AS pos,
       {_ref('site_id')} AS ref, {_alt('site_id')} AS alt, a1, a2,
       CASE WHEN (sample_id + site_id) % 29 = 0 THEN 0 ELSE 1 END AS phased,
       block AS ps, 10 + (7 * sample_id + 11 * site_id) % 50 AS gq, dp, dp - ad_alt AS ad_ref, ad_alt
FROM (
  SELECT *, CASE a1 + a2 WHEN 0 THEN CASE WHEN (sample_id + site_id) % 23 = 0 THEN 1 ELSE 0 END WHEN 2 THEN dp
                 ELSE CAST(floor(dp * (30 + (3 * sample_id + site_id) % 40) / 100) AS BIGINT) END AS ad_alt
  FROM (SELECT *, 5 + (5 * sample_id + 3 * site_id) % 35 AS dp FROM (SELECT {{calls}} FROM (
    SELECT sample_id, family_id, slot, site_id, block,
           CASE WHEN slot = 2 AND (131 * sample_id + 37 * site_id) % 197 = 0 THEN 1 ELSE {_allele('s1', 'b1')} END AS a1,
           {_allele('s2', 'b2')} AS a2
    FROM (
      SELECT sample_id, family_id, slot, site_id, block,
             CASE WHEN slot < 2 THEN sample_id WHEN hap1_pat = 1 THEN 4 * family_id ELSE 4 * family_id + 1 END AS s1,
             CASE WHEN slot < 2 THEN sample_id WHEN hap1_pat = 1 THEN 4 * family_id + 1 ELSE 4 * family_id END AS s2,
             CASE WHEN slot < 2 THEN 0 WHEN hap1_pat = 1 THEN pat_bit ELSE mat_bit END AS b1,
             CASE WHEN slot < 2 THEN 1 WHEN hap1_pat = 1 THEN mat_bit ELSE pat_bit END AS b2
      FROM (
        SELECT *, 1 - (sample_id + block) % 2 AS hap1_pat, CASE WHEN (5 * sample_id + block) % 3 = 0 THEN 0 ELSE 1 END AS mat_bit,
               (3 * sample_id + block + CASE WHEN CAST(floor(site_id / 23) AS BIGINT) % {SITES_PER_BLOCK} >= 25
                                               AND (sample_id + block) % 5 = 0 THEN 1 ELSE 0 END) % 2 AS pat_bit
        FROM (SELECT 4 * family_id + slot AS sample_id, family_id, slot, site_id, CAST(floor(site_id / {BLOCK_SPAN}) AS BIGINT) AS block
              FROM (SELECT family_id, site_id, {{slots}} AS slot FROM {{fx_call}}) a) b
      ) c
    ) d
  ) e) c1) c2
) f
"""

FIXTURES["fx_read"] = f"""
SELECT 10 * l_orderkey + l_linenumber AS read_id, l_suppkey AS sample_id, {_chrom('l_partkey')} AS chrom,
       2996000 + 1000 * l_partkey + l_orderkey % 3000 AS ref_start,
       3001000 + 1000 * l_partkey + l_orderkey % 3000 + 100 * CAST(l_quantity AS BIGINT) AS ref_end,
       CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_linenumber % 3 END AS hp,
       CAST(floor(l_partkey / {BLOCK_SPAN}) AS BIGINT) AS ps,
       CASE WHEN l_tax > 0.07 THEN 5 ELSE 60 END AS mapq,
       CASE WHEN l_discount < 0.02 THEN 'ALT' WHEN l_discount < 0.09 THEN 'REF' ELSE 'AMB' END AS support
FROM {{lineitem}}
"""

FIXTURES["fx_tr"] = f"""
SELECT sample_id, family_id, slot, site_id, {_chrom('site_id')} AS chrom, 3000000 + 1000 * site_id AS pos,
       20 + (7 * site_id + 3 * sample_id) % 15 AS al1,
       20 + (5 * site_id + 11 * sample_id) % 17 + CASE WHEN (17 * sample_id + 23 * site_id) % 211 = 0 THEN 60 ELSE 0 END AS al2,
       3 + (sample_id + site_id) % 9 AS sd1, 3 + (2 * sample_id + site_id) % 9 AS sd2
FROM (SELECT 4 * family_id + slot AS sample_id, family_id, slot, site_id
      FROM (SELECT family_id, site_id, {{slots}} AS slot FROM {{fx_call}} WHERE site_id % 4 = 0) a) b
"""

# Structural variants: about four neighbours overlap each event at every scale.
FIXTURES["fx_sv"] = """
SELECT o_orderkey AS sv_id, o_custkey % (SELECT count(*) FROM {supplier}) AS sample_id,
       concat('chr', CAST(1 + o_orderkey % 22 AS VARCHAR(4))) AS chrom,
       3000000 + 97 * o_orderkey AS start,
       3000000 + 97 * o_orderkey + 200 + CAST(floor(o_totalprice / 40) AS BIGINT) AS "end",
       CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'DEL' WHEN '2' THEN 'DUP' WHEN '3' THEN 'INS'
            WHEN '4' THEN 'INV' ELSE 'BND' END AS svtype
FROM {orders}
"""

FIXTURES["fx_interval"] = """
SELECT p_partkey AS interval_id, concat('chr', CAST(1 + p_partkey % 22 AS VARCHAR(4))) AS chrom,
       3000000 + 728 * p_partkey AS start, 3000000 + 728 * p_partkey + 60 * p_size AS "end",
       p_brand AS symbol,
       CASE p_type WHEN 'PROMO' THEN 'CDS' WHEN 'SMALL' THEN 'UTR5' WHEN 'ECONOMY' THEN 'UTR3'
                   WHEN 'LARGE' THEN 'gene' ELSE 'mask' END AS kind
FROM {part}
"""

# 24 samples share each CpG; eight CpGs of one chromosome make a region.
FIXTURES["fx_cpg"] = """
SELECT sample_id, cpg_id, concat('chr', CAST(1 + cpg_id % 22 AS VARCHAR(4))) AS chrom, 3000000 + 40 * cpg_id AS pos,
       beta, depth, hap
FROM (SELECT event_id % 24 AS sample_id, CAST(floor(event_id / 24) AS BIGINT) AS cpg_id,
             value / 563.0E0 AS beta, event_id % 40 AS depth,
             CASE event_type WHEN 'click' THEN 'hap1' WHEN 'view' THEN 'hap2' ELSE 'combined' END AS hap
      FROM {events}) x
"""

FIXTURES["fx_region"] = """
SELECT DISTINCT CAST(floor(cpg_id / 176) AS BIGINT) * 22 + cpg_id % 22 AS region_id,
       concat('chr', CAST(1 + cpg_id % 22 AS VARCHAR(4))) AS chrom,
       3000000 + 7040 * CAST(floor(cpg_id / 176) AS BIGINT) AS start,
       3000000 + 7040 * CAST(floor(cpg_id / 176) AS BIGINT) + 7040 AS "end"
FROM (SELECT CAST(floor(event_id / 24) AS BIGINT) AS cpg_id FROM {events}) x
"""

# One candidate per 15 orders (about 60 reads); six planted evidence patterns.
FIXTURES["fx_candidate"] = """
SELECT cand, concat('chr', CAST(1 + cand % 22 AS VARCHAR(4))) AS chrom, 3000000 + 5000 * cand AS pos,
       4 * (cand % 25) + 2 AS sample_id, cand % 25 AS family_id,
       CASE cand % 4 WHEN 0 THEN 'P' WHEN 1 THEN 'M' WHEN 2 THEN 'P' END AS child_hap1_is,
       CASE cand % 5 WHEN 4 THEN NULL ELSE 1 + cand % 2 END AS f_hap,
       CASE cand % 7 WHEN 6 THEN NULL ELSE 1 + cand % 2 END AS m_hap,
       CASE cand % 3 WHEN 0 THEN 'SNV' WHEN 1 THEN 'SV' ELSE 'TR' END AS variant_class,
       n_orders, total_price
FROM (SELECT CAST(floor(o_orderkey / 15) AS BIGINT) AS cand, count(*) AS n_orders,
             CAST(sum(CAST(floor(o_totalprice) AS BIGINT)) AS BIGINT) AS total_price
      FROM {orders} GROUP BY CAST(floor(o_orderkey / 15) AS BIGINT)) x
"""

FIXTURES["fx_obs"] = """
SELECT cand, role, hp, ps, mapq, nm, clipped, supplementary, al,
       CASE WHEN noise >= 95 THEN 'AMB'
            WHEN cand % 6 = 0 AND role = 'C' AND hp = 1 THEN 'ALT'
            WHEN cand % 6 = 1 AND role = 'C' AND hp = 1 THEN 'ALT'
            WHEN cand % 6 = 1 AND role IN ('F', 'M') AND hp = 1 + cand % 2 AND noise < 90 THEN 'ALT'
            WHEN cand % 6 = 2 AND noise < 30 THEN 'ALT'
            WHEN cand % 6 = 3 AND role = 'C' AND hp = 1 AND noise < 45 THEN 'ALT'
            WHEN cand % 6 = 4 AND role = 'C' AND hp = 1 THEN 'ALT'
            WHEN cand % 6 = 4 AND role IN ('F', 'M') AND hp = 1 + cand % 2 AND noise < 22 THEN 'ALT'
            WHEN cand % 6 = 5 AND role = 'C' AND noise < 3 THEN 'ALT'
            WHEN hp = 0 AND role = 'C' AND cand % 6 < 5 AND noise < 45 THEN 'ALT'
            ELSE 'REF' END AS support
FROM (SELECT CAST(floor(l_orderkey / 15) AS BIGINT) AS cand,
             CASE l_partkey % 3 WHEN 0 THEN 'C' WHEN 1 THEN 'F' ELSE 'M' END AS role,
             CASE WHEN l_suppkey % 7 = 0 THEN 0 ELSE 1 + l_suppkey % 2 END AS hp,
             100 + (l_orderkey + l_linenumber) % 2 AS ps,
             CASE WHEN l_tax > 0.07 THEN 0 ELSE 60 END AS mapq,
             CAST(floor(l_discount * 100) AS BIGINT) AS nm,
             CASE WHEN l_linenumber = 1 THEN 1 ELSE 0 END AS clipped,
             CASE WHEN l_linenumber = 2 THEN 1 ELSE 0 END AS supplementary,
             20 + CAST(l_quantity AS BIGINT) % 9 AS al,
             (7 * l_orderkey + 13 * l_linenumber + l_partkey) % 100 AS noise
      FROM {lineitem}) x
"""

# A read's id holds order, line, part and supplier; rows of lineitem that agree in all four are one read.
# Candidates asked of reads: two indels, a small variant and a deletion around each place of fx_candidate, and the alignments that reach them.
FIXTURES["fx_asked"] = """
SELECT 4 * cand + k AS cand, chrom, sample_id, family_id, CASE k WHEN 0 THEN 'SNV' WHEN 3 THEN 'SV' ELSE 'INDEL' END AS variant_class,
       pos + CASE k WHEN 0 THEN 75 + cand % 12 WHEN 1 THEN 200 WHEN 2 THEN 300 ELSE 500 END AS start,
       pos + CASE k WHEN 0 THEN 75 + cand % 12 WHEN 1 THEN 200 WHEN 2 THEN 303 ELSE 600 END AS "end",
       CASE k WHEN 0 THEN CASE WHEN cand % 2 = 0 THEN 'A' ELSE 'G' END WHEN 2 THEN 'ACGT' ELSE 'A' END AS ref,
       CASE k WHEN 0 THEN CASE WHEN cand % 3 = 0 THEN 'C' ELSE 'T' END WHEN 1 THEN 'ACG' WHEN 2 THEN 'A' ELSE '<DEL>' END AS alt,
       CASE WHEN k = 3 THEN 'DEL' END AS svtype, CASE WHEN k = 3 THEN -100 END AS svlen
FROM {fx_candidate} CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) ks
"""

FIXTURES["fx_align"] = """
SELECT read_id, 4 * (cand % 25) + CASE role WHEN 'C' THEN 2 WHEN 'F' THEN 0 ELSE 1 END AS sample_id, concat('chr', CAST(1 + cand % 22 AS VARCHAR(4))) AS chrom, ref_start,
       concat(CASE WHEN clip > 0 THEN concat(CAST(clip AS VARCHAR(9)), 'S') ELSE '' END, CAST(m1 AS VARCHAR(9)), 'M', CASE WHEN ins > 0 THEN concat(CAST(ins AS VARCHAR(9)), 'I') ELSE '' END,
              CAST(m2 AS VARCHAR(9)), 'M', CASE WHEN del > 0 THEN concat(CAST(del AS VARCHAR(9)), 'D') ELSE '' END, CAST(m3 AS VARCHAR(9)), 'M',
              CASE WHEN sv > 0 THEN concat(CAST(sv AS VARCHAR(9)), 'D') ELSE '' END, CASE WHEN short = 0 THEN '150M' ELSE '' END) AS cigar_text,
       substr(repeat('ACGT', 300), CAST(1 + read_id % 4 AS INT), CAST(clip + m1 + ins + m2 + m3 + CASE WHEN short = 0 THEN 150 ELSE 0 END AS INT)) AS seq,
       hp, 100 + read_id % 2 AS ps, mapq, nm, clip AS clipped, 0 AS supplementary,
       CASE WHEN short = 1 AND part % 2 = 0 THEN base + 600 + (supp % 3) * 40 END AS sa_pos
FROM (SELECT *, base + 200 + j1 - ref_start AS m1, 100 + j2 - j1 AS m2, 200 + CASE WHEN short = 0 THEN (supp % 7) * 10 - 30 ELSE 0 END - j2 - del AS m3
      FROM (SELECT *, base + part % 160 - 60 AS ref_start, supp % 9 - 4 AS j1, read_id % 5 - 2 AS j2, ord % 4 AS ins, part % 5 AS del, CASE WHEN short = 1 THEN 0 WHEN part % 3 = 1 THEN 100 WHEN part % 3 = 2 THEN 60 ELSE 0 END AS sv
            FROM (SELECT {read_id} AS read_id, CAST(floor(l_orderkey / 15) AS BIGINT) AS cand, l_orderkey AS ord, l_partkey AS part, l_suppkey AS supp,
                         3000000 + 5000 * CAST(floor(l_orderkey / 15) AS BIGINT) AS base, CASE l_partkey % 3 WHEN 0 THEN 'C' WHEN 1 THEN 'F' ELSE 'M' END AS role,
                         CASE WHEN l_linenumber % 4 = 0 THEN 1 ELSE 0 END AS short, l_linenumber % 3 AS clip, CASE WHEN l_suppkey % 7 = 0 THEN 0 ELSE 1 + l_suppkey % 2 END AS hp,
                         CASE WHEN l_tax > 0.07 THEN 4 ELSE 60 END AS mapq, CAST(floor(l_discount * 100) AS BIGINT) AS nm
                  FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, min(l_tax) AS l_tax, min(l_discount) AS l_discount, min(l_quantity) AS l_quantity FROM {lineitem} GROUP BY l_orderkey, l_linenumber, l_partkey, l_suppkey) li) a) b) c
"""

# Repeat loci of the trios (every third place) and their spanning reads: flanks of 50 bases, a length near the child's or a parent's alleles.
FIXTURES["fx_locus"] = """
SELECT cand, concat('TR', CAST(cand AS VARCHAR(12))) AS trid, 1 + cand % 4 AS unit, 30 + cand % 9 AS target, 22 + cand % 5 AS other, 20 + cand % 7 AS f1, 24 + cand % 11 AS f2, 21 + cand % 3 AS m1, 29 + cand % 13 AS m2 FROM {fx_candidate}
"""

FIXTURES["fx_spanning"] = """
SELECT read_id, 4 * (cand % 25) + CASE part % 3 WHEN 0 THEN 2 WHEN 1 THEN 0 ELSE 1 END AS sample_id, concat('TR', CAST(cand AS VARCHAR(12))) AS trid,
       CASE WHEN part % 41 = 0 THEN 60 ELSE 100 + 19 + quantity % 21 END AS query_length, hp, 100 AS ps, 60 AS mapq, nm, 0 AS clipped, 0 AS supplementary
FROM (SELECT {read_id} AS read_id, CAST(floor(l_orderkey / 15) AS BIGINT) AS cand, l_partkey AS part, CAST(l_quantity AS BIGINT) AS quantity,
             CASE WHEN l_suppkey % 7 = 0 THEN 0 ELSE 1 + l_suppkey % 2 END AS hp, CAST(floor(l_discount * 100) AS BIGINT) AS nm FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, min(l_tax) AS l_tax, min(l_discount) AS l_discount, min(l_quantity) AS l_quantity FROM {lineitem} GROUP BY l_orderkey, l_linenumber, l_partkey, l_suppkey) li) x
"""

# Sites with up to two alternative alleles: the second one where site and sample say so; some members are not called.
FIXTURES["fx_multi"] = """
SELECT sample_id, family_id, slot, site_id, chrom, pos, ref, alt AS alt1, concat(ref, 'CC') AS alt2,
       CASE WHEN (sample_id + site_id) % 41 = 0 THEN NULL ELSE a1 * (1 + CASE WHEN site_id % 3 = 0 THEN (sample_id + site_id) % 2 ELSE 0 END) END AS x1,
       CASE WHEN (sample_id + site_id) % 41 = 0 THEN NULL ELSE a2 * (1 + CASE WHEN site_id % 3 = 0 THEN (sample_id + site_id + 1) % 2 ELSE 0 END) END AS x2, gq, dp
FROM {fx_genotype}
"""

# Transmission-style phenotype rows.
FIXTURES["fx_phenotype"] = """
SELECT c_custkey AS subject_id, c_mktsegment AS grp, c_acctbal AS numeric_value, c_nationkey % 4 AS ordinal,
       CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_custkey % 3 END AS answer,
       CASE WHEN c_custkey % 5 = 0 THEN 0 ELSE 1 END AS asked
FROM {customer}
"""

_NAME = re.compile(r"\bfx_\w+")


def _closure(names: list[str]) -> list[str]:
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for dep in _NAME.findall(FIXTURES[name]):
            if dep != name:
                visit(dep)
        order.append(name)

    for n in names:
        visit(n)
    return order


def with_fixtures(body: str) -> str:
    """DuckDB text: the derived tables a query names, as CTEs in front of it."""
    names = _closure(list(dict.fromkeys(n for n in _NAME.findall(body) if n in FIXTURES)))
    body = body.strip()
    if not names:
        return body
    ctes = []
    for n in names:
        text = FIXTURES[n].replace("{slots}", "unnest(range(0, 4))").replace("{calls}", CALL_COLUMNS).replace("{read_id}", READ_ID)
        ctes.append(f"{n} AS ({re.sub(r'{(\w+)}', r'\1', text).strip()})")
    if body[:15].upper() == "WITH RECURSIVE ":
        return "WITH RECURSIVE " + ",\n".join(ctes) + ",\n" + body[15:]
    head = "WITH " + ",\n".join(ctes)
    if body[:5].upper() == "WITH ":
        return head + ",\n" + body[5:]
    return head + "\n" + body


class Tables:
    """Base and derived tables of one data folder as lazy DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._cache: dict[str, DataFrame] = {}
        self._wide: bool | None = None

    def __call__(self, name: str) -> DataFrame:
        if name not in self._cache:
            if name in BASE:
                self._cache[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            else:
                text = FIXTURES[name].replace("{slots}", "explode(sequence(0, 3))").replace(
                    "{calls}", f"inline(array(struct({CALL_COLUMNS})))").replace('"end"', "`end`")
                if "{read_id}" in text:
                    text = text.replace("{read_id}", WIDE_READ_ID if self._wide_ids() else READ_ID)
                if name == "fx_align":
                    text = re.sub(r"read_id % (\d+)", r"CAST(read_id % \1 AS BIGINT)", text)
                deps = set(re.findall(r"{(\w+)}", text))
                self._cache[name] = self.spark.sql(text, **{d: self(d) for d in deps})
        return self._cache[name]

    def _wide_ids(self) -> bool:
        """Whether some id of a read passes a BIGINT: one row of four numbers tells."""
        if self._wide is None:
            most = self("lineitem").agg(*[F.max(c).alias(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]).first()
            self._wide = None not in most and (10 * most.l_orderkey + most.l_linenumber) * 100000000000 + most.l_partkey * 100000 + most.l_suppkey > NARROW
        return self._wide
