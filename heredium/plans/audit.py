"""Declared-versus-produced checks; every check returns rows, none raises."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import ordered


def block_overlaps(segments: DataFrame, keys: list[str], block: str) -> DataFrame:
    """Consecutive segments that overlap: FAIL inside one phase block, WARN across blocks."""
    d = segments.withColumn("__bin", ordered.position_bin(F.col("start")))
    state = F.struct(F.col("end").alias("e"), F.col(block).alias("b"))
    d = ordered.previous(d, keys, "__bin", ["start", "end"], state, "__p").where(F.col("__p.e") > F.col("start"))
    level = F.when(F.col("__p.b") == F.col(block), "FAIL").otherwise("WARN")
    return d.withColumn("level", level).drop("__p", "__bin")


FINDING = ["level", "check", "detail"]


def _rows(d: DataFrame, level: str, check: str, detail) -> DataFrame:
    return d.select(F.lit(level).alias("level"), F.lit(check).alias("check"), detail.cast("string").alias("detail"))


def vocabulary(df: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    """Values outside the closed vocabulary (FAIL) and declared values never seen (WARN)."""
    seen = df.groupBy(column).agg(F.count("*").alias("n")).where(F.col(column).isNotNull())
    words = df.sparkSession.createDataFrame([(w,) for w in allowed], f"{column} string")
    d = seen.join(F.broadcast(words.withColumn("__w", F.lit(1))), column, "full_outer")
    level = F.when(F.col("__w").isNull(), "FAIL").when(F.col("n").isNull(), "WARN")
    return d.withColumn("level", level).where("level IS NOT NULL").select("level", F.lit(f"vocabulary:{column}").alias("check"), F.col(column).alias("detail"))


def schema_equal(df: DataFrame, expected: list[str]) -> list[str]:
    """Columns missing from or added to the declared ones."""
    return [f"-{c}" for c in expected if c not in df.columns] + [f"+{c}" for c in df.columns if c not in expected]


def row_counts(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys whose row counts differ between two stages."""
    x, y = a.groupBy(*keys).agg(F.count("*").alias("n_a")), b.groupBy(*keys).agg(F.count("*").alias("n_b"))
    d = x.join(y, keys, "full_outer").na.fill(0, ["n_a", "n_b"]).where("n_a <> n_b")
    return _rows(d, "FAIL", "row_counts", F.concat_ws("/", *[F.col(k).cast("string") for k in keys], "n_a", "n_b"))


def minimum_events(df: DataFrame, subjects: DataFrame, key: str, minimum: int) -> DataFrame:
    n = df.groupBy(key).agg(F.count("*").alias("n"))
    d = subjects.select(key).join(n, key, "left").where(F.coalesce("n", F.lit(0)) < minimum)
    return _rows(d, "FAIL", "minimum_events", F.col(key))


def column_status(df: DataFrame, declared: list[str]) -> DataFrame:
    """Declared columns that are missing, empty or constant; one aggregate over the table."""
    have = [c for c in declared if c in df.columns]
    stat = df.agg(*[F.struct(F.count(c).alias("n"), F.min(F.col(c).cast("string")).alias("lo"), F.max(F.col(c).cast("string")).alias("hi")).alias(c) for c in have])
    cells = [F.struct(F.lit(c).alias("c"), F.when(F.col(f"{c}.n") == 0, "empty").when(F.col(f"{c}.lo") == F.col(f"{c}.hi"), "constant").otherwise("ok").alias("s")) for c in have]
    cells += [F.struct(F.lit(c).alias("c"), F.lit("missing").alias("s")) for c in declared if c not in have]
    d = stat.select(F.explode(F.array(*cells)).alias("x")).select("x.*").where("s <> 'ok'")
    return d.select(F.when(F.col("s") == "constant", "WARN").otherwise("FAIL").alias("level"), F.lit("columns").alias("check"), F.concat_ws(":", "c", "s").alias("detail"))


def completeness(expected: DataFrame, produced: DataFrame, keys: list[str]) -> DataFrame:
    """Expected artefacts nobody produced (FAIL) and produced ones nobody expected (WARN)."""
    name = F.concat_ws("/", *[F.col(k).cast("string") for k in keys])
    return _rows(expected.select(*keys).distinct().join(produced, keys, "left_anti"), "FAIL", "missing_output", name).unionByName(
        _rows(produced.select(*keys).distinct().join(expected, keys, "left_anti"), "WARN", "stray_output", name))


def single_version(df: DataFrame, column: str = "params_version") -> DataFrame:
    d = df.agg(F.count_distinct(column).alias("n"), F.concat_ws(",", F.array_sort(F.collect_set(column))).alias("v")).where("n > 1")
    return _rows(d, "FAIL", "single_version", F.col("v"))


def fill_rate(df: DataFrame, column: str, minimum: float) -> DataFrame:
    """Share of rows with an annotation; the sentinel '.' is an answer, a blank is not."""
    filled = F.col(column).isNotNull() & (F.trim(F.col(column).cast("string")) != "")
    d = df.agg(F.avg(filled.cast("double")).alias("r")).where(F.col("r") < minimum)
    return _rows(d, "FAIL", f"fill_rate:{column}", F.round("r", 4))


def model_columns(needed: list[str], table: DataFrame) -> list[str]:
    """Columns a model asks for that the matrix cannot give."""
    return [c for c in needed if c not in table.columns]


def findings(*parts: DataFrame) -> DataFrame:
    """All findings as one table."""
    out = parts[0].select(*FINDING)
    for p in parts[1:]:
        out = out.unionByName(p.select(*FINDING))
    return out


def failures(table: DataFrame) -> DataFrame:
    return table.groupBy("level").agg(F.count("*").alias("n"))
