"""Measures against golden samples and thresholds. Ratios of nothing are 0, never null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.functions.text import ratio

# Thresholds of the checks.
THRESHOLDS = {
    "routes_recall": 0.8, "routes_precision": 0.9, "job_edges_precision": 0.8, "stores_precision": 0.8, "externals_precision": 0.7,
    "unresolved_import_ratio": 0.2, "capability_coverage": 0.8, "p95_runtime_seconds": 300.0, "hypothesis_ratio": 0.3, "llm_token_efficiency": 0.8,
}


def precision_recall(found: DataFrame, golden: DataFrame, keys: list[str], by: str) -> DataFrame:
    """(by, precision, recall, passed): shares of distinct found and golden keys that the other side has."""
    f, g = found.select(by, *keys).distinct(), golden.select(by, *keys).distinct()
    both = f.withColumn("_f", F.lit(1)).join(g.withColumn("_g", F.lit(1)), [by, *keys], "full")
    n = both.groupBy(by).agg(F.count("_f").alias("f"), F.count("_g").alias("g"), F.count_if(F.col("_f").isNotNull() & F.col("_g").isNotNull()).alias("b"))
    p, r = F.round(ratio(F.col("b"), F.col("f")), 6), F.round(ratio(F.col("b"), F.col("g")), 6)
    return n.select(by, p.alias("precision"), r.alias("recall"), ((p >= THRESHOLDS["routes_precision"]) & (r >= THRESHOLDS["routes_recall"])).alias("passed"))


def inverted(value: Column, limit: float) -> Column:
    """1 at 0, falling to 0 at the limit and beyond."""
    return F.greatest(F.lit(0.0), 1.0 - F.least(value, F.lit(limit)) / limit)


def runtime_score(seconds: Column, limit: float = THRESHOLDS["p95_runtime_seconds"]) -> Column:
    return F.when(seconds <= limit, 1.0).otherwise(F.greatest(F.lit(0.0), 1.0 - (seconds - limit) / limit))


def accuracy(files: DataFrame, weights: tuple[float, float, float] = (0.4, 0.3, 0.3)) -> DataFrame:
    """files(has_imports, has_functions, imports, resolved) -> (files, import_share, function_share, resolved_share, overall)."""
    n = F.count(F.lit(1))
    a, b = ratio(F.count_if("has_imports"), n), ratio(F.count_if("has_functions"), n)
    c = ratio(F.sum("resolved"), F.sum("imports"))
    return files.agg(
        n.alias("files"), F.round(a, 6).alias("import_share"), F.round(b, 6).alias("function_share"), F.round(c, 6).alias("resolved_share"),
        F.round(a * weights[0] + b * weights[1] + c * weights[2], 6).alias("overall"))


def throughput(files: Column, seconds: Column) -> Column:
    """Files a second; 0 where no time was taken."""
    return F.round(ratio(files, seconds), 6)


def provenance_confidence(has_evidence: Column, resolved: Column, internal: Column) -> Column:
    """Mean of three factors: (.9/.3), (.8/.5), (.8/.2)."""
    pick = lambda c, yes, no: F.when(c, yes).otherwise(no)
    return F.round((pick(has_evidence, 0.9, 0.3) + pick(resolved, 0.8, 0.5) + pick(internal, 0.8, 0.2)) / 3, 6)


def golden_precision(found: DataFrame, golden: DataFrame, section: str, threshold: str) -> DataFrame:
    """One row of a check by name: (section, precision, passed). found(name), golden(name); nothing found is 0."""
    f, g = found.select("name").distinct(), golden.select("name").distinct()
    n = f.join(g.withColumn("_g", F.lit(1)), "name", "left").agg(F.count(F.lit(1)).alias("f"), F.count("_g").alias("b"))
    p = F.round(F.col("b") / F.greatest(F.col("f"), F.lit(1)), 6)
    return n.select(F.lit(section).alias("section"), p.alias("precision"), (p >= THRESHOLDS[threshold]).alias("passed"))
