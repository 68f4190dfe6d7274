"""Writers: tables with a Parquet twin, VCF and BED text, read lines with hashed names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, partition: str = "family_id") -> None:
    """Parquet and tab-separated copies, one directory per family."""
    df.write.partitionBy(partition).parquet(f"{path}/parquet")
    flat = df.select(*[F.to_json(f.name).alias(f.name) if f.dataType.typeName() in ("array", "map", "struct") else F.col(f.name) for f in df.schema.fields])
    flat.write.partitionBy(partition).csv(f"{path}/tsv", sep="\t", header=True, nullValue=".")


def hashed(name: Column, salt: str) -> Column:
    return F.substring(F.sha2(F.concat(F.lit(salt), name.cast("string")), 256), 1, 16)


def write_reads(df: DataFrame, path: str, name: str, salt: str) -> None:
    """Per-read JSON lines; read names leave only as salted hashes."""
    df.withColumn(name, hashed(F.col(name), salt)).write.json(path)


def info_text(fields: dict[str, Column]) -> Column:
    """INFO string without the NULL fields; a true boolean is a flag; '.' when nothing is left."""
    parts = [F.when(c.cast("string").isNotNull(), F.concat(F.lit(f"{k}="), c.cast("string"))) for k, c in fields.items()]
    return F.coalesce(F.nullif(F.concat_ws(";", *parts), F.lit("")), F.lit("."))


def sites_vcf(df: DataFrame, info: dict[str, Column]) -> DataFrame:
    """Body lines of a sites-only VCF."""
    return df.select(F.concat_ws("\t", "chrom", F.col("pos").cast("string"), F.lit("."), "ref", "alt", F.lit("."), F.lit("PASS"), info_text(info)).alias("value"))


def sites_bed(df: DataFrame, pad: int = 0) -> DataFrame:
    """Distinct padded BED lines of sites, for region restriction outside Spark."""
    d = df.select("chrom", F.greatest(F.col("pos") - 1 - pad, F.lit(0)).alias("s"), (F.col("pos") + pad).alias("e")).distinct()
    return d.select(F.concat_ws("\t", "chrom", F.col("s").cast("string"), F.col("e").cast("string")).alias("value"))
