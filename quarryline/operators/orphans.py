"""References to records that do not exist.

Both sides are brought to one key, a parent is reduced to its validity interval (from its earliest arrival to its
deletion), and the two streams are partitioned and sorted by that key and merged once. Where a reference finds no
parent it is ``missing``; a parent that began later makes it ``late``; one that had ended makes it ``deleted``.

Defined results: a null key refers to nothing; repeated rows of one id give one row; an empty table gives no rows;
further columns of the inputs are ignored. A parent without a time of arrival counts as always there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.functions.paths import directory, normalized
from quarryline.session import spread_left_join

#: What may follow the path that an import names.
SUFFIXES = [".ts", ".tsx", ".js", ".jsx", ".py"]
INDEXES = ["/index.ts", "/index.tsx", "/index.js", "/index.jsx", "/__init__.py"]


def merge_validity(refs: DataFrame, parents: DataFrame, keys: list[str]) -> DataFrame:
    """Status of each reference: refs(ref_table, ref_id, at, *keys), parents(*keys, starts, ends), one row per key.

    Returns only orphans: (ref_table, ref_id, at, status). Hot keys of the references are split.
    """
    joined = spread_left_join(refs, parents.withColumn("_found", F.lit(True)), keys, "ref_id")
    status = (
        F.when(F.col("_found").isNull(), "missing")
        .when(F.col("starts") > F.col("at"), "late")
        .when(F.col("ends") <= F.col("at"), "deleted")
    )
    return joined.select("ref_table", "ref_id", "at", status.alias("status")).where("status is not null")


def file_parents(files: DataFrame) -> DataFrame:
    """Validity interval of each (snapshot_id, path): earliest arrival, and deletion if every record of it is deleted."""
    f = files.select("snapshot_id", normalized(F.col("path")).alias("path"), "arrived_at", "deleted_at")
    return f.groupBy("snapshot_id", "path").agg(
        F.min("arrived_at").alias("starts"),
        F.when(F.count("deleted_at") == F.count(F.lit(1)), F.max("deleted_at")).alias("ends"),
    )


def named_parents(parents: DataFrame) -> DataFrame:
    """The interval of each file under every name an import may use for it: the path, and without suffix or index."""
    path = F.col("path")
    cut = lambda ends: F.when(
        F.greatest(*[path.endswith(e) for e in ends]),
        F.regexp_replace(path, "(" + "|".join(e.replace(".", r"\.") for e in ends) + ")$", ""),
    )
    names = F.array_compact(F.array(path, cut(SUFFIXES), cut(INDEXES)))
    named = parents.select("snapshot_id", F.explode(names).alias("path"), "starts", "ends", F.col("path").alias("_of"))
    # at most one candidate exists; where a table breaks that rule the path as written goes first, then by name
    return named.groupBy("snapshot_id", "path").agg(
        F.min_by(F.struct("starts", "ends"), F.struct(F.length("_of"), "_of")).alias("_i")
    ).select("snapshot_id", "path", "_i.*")


def import_references(imports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """References of imports: to a file named outright (resolved), and to one named relative to the importing file."""
    rows = imports.select(
        F.lit("imports").alias("ref_table"), F.col("import_id").cast("string").alias("ref_id"), "snapshot_id",
        "from_path", "raw", "resolved", "reason_code", F.col("observed_at").alias("at"),
    )
    outright = rows.where("resolved is not null").select("ref_table", "ref_id", "at", "snapshot_id", normalized(F.col("resolved")).alias("path"))
    named = rows.where("resolved is null and raw like '.%' and coalesce(reason_code, '') <> 'dynamic-import'")
    base = F.translate(F.col("from_path"), "\\", "/")
    named = named.select("ref_table", "ref_id", "at", "snapshot_id", normalized(F.concat(directory(base), F.lit("/"), F.col("raw"))).alias("path"))
    return outright.dropDuplicates(["ref_id"]), named.dropDuplicates(["ref_id"])


def orphans(imports: DataFrame, warnings: DataFrame, artifacts: DataFrame, snapshots: DataFrame, files: DataFrame, repos: DataFrame) -> DataFrame:
    """All orphan references: (ref_table, ref_id, at, status)."""
    parents = file_parents(files)
    outright, named = import_references(imports)
    warned = warnings.where("file is not null").select(
        F.lit("parse_warnings").alias("ref_table"), F.col("warning_id").cast("string").alias("ref_id"),
        F.col("created_at").alias("at"), "snapshot_id", normalized(F.col("file")).alias("path"),
    ).dropDuplicates(["ref_id"])
    made = artifacts.where("snapshot_id is not null").select(
        F.lit("artifacts").alias("ref_table"), F.col("artifact_id").alias("ref_id"), F.col("created_at").alias("at"), "snapshot_id",
    ).dropDuplicates(["ref_id"])
    taken = snapshots.where("repo_id is not null").select(
        F.lit("snapshots").alias("ref_table"), F.col("snapshot_id").alias("ref_id"), F.col("created_at").alias("at"), "repo_id",
    ).dropDuplicates(["ref_id"])
    never = F.lit(None).cast("timestamp_ntz")
    snaps = snapshots.groupBy("snapshot_id").agg(F.min("created_at").alias("starts")).withColumn("ends", never)
    homes = repos.where("repo_id is not null").select("repo_id").distinct().withColumn("starts", never).withColumn("ends", never)
    to_path = ["snapshot_id", "path"]
    return (
        merge_validity(outright.unionByName(warned), parents, to_path)
        .unionByName(merge_validity(named, named_parents(parents), to_path))
        .unionByName(merge_validity(made, snaps, ["snapshot_id"]))
        .unionByName(merge_validity(taken, homes, ["repo_id"]))
    )


def orphan_counts(found: DataFrame) -> DataFrame:
    """Orphans per table, month of the referring row and status."""
    return found.groupBy("ref_table", F.date_format("at", "yyyy-MM").alias("month"), "status").agg(F.count(F.lit(1)).alias("n"))
