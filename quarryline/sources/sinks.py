"""Sinks: versioned artifacts in an envelope, and the cache of parsed files. All writes are Parquet with Spark's commit protocol."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA_VERSION = "1.0.0"


def store_artifact(df: DataFrame, root: str, repo_id: str, kind: str, version: int | None = None) -> int:
    """Write a table as the next version of an artifact, never over an earlier one; returns the version.

    The version's folder is made before it is written, and making it succeeds once: of two writers the second goes on to
    the version after.
    """
    spark = df.sparkSession
    cols = sorted(df.columns)
    sealed = df.withColumns({"_schema_version": F.lit(SCHEMA_VERSION), "_generated_at": F.current_timestamp(), "_row_hash": F.sha2(F.to_json(F.struct(*cols)), 256)})
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    wanted = version or latest_version(spark, root, repo_id, kind) + 1
    while True:
        claim = jvm.org.apache.hadoop.fs.Path(f"{root}/repo_id={repo_id}/kind={kind}/_claims/{wanted}")
        try:
            claim.getFileSystem(conf).create(claim, False).close()
            break
        except Exception as e:  # the claim is another writer's
            if version or "already exists" not in str(e).lower():
                raise
            wanted += 1
    sealed.write.mode("errorifexists").parquet(_place(root, repo_id, kind, wanted))
    return wanted


def _place(root: str, repo_id: str, kind: str, version: int) -> str:
    return f"{root}/repo_id={repo_id}/kind={kind}/version={version}"


def latest_version(spark: SparkSession, root: str, repo_id: str, kind: str) -> int:
    """The greatest version that was committed; 0 where there is none."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(f"{root}/repo_id={repo_id}/kind={kind}")
    fs = path.getFileSystem(conf)
    if not fs.exists(path):
        return 0
    done = [s.getPath() for s in fs.listStatus(path) if fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    return max((int(p.getName().split("=")[1]) for p in done if "=" in p.getName()), default=0)


def read_artifact(spark: SparkSession, root: str, repo_id: str, kind: str, version: int | None = None) -> DataFrame:
    """A version of an artifact, the last one by default, without its envelope."""
    version = version or latest_version(spark, root, repo_id, kind)
    df = spark.read.parquet(_place(root, repo_id, kind, version))
    return df.drop(*[c for c in df.columns if c.startswith("_")])


def write_partitioned(df: DataFrame, path: str, *keys: str) -> None:
    """A table by key folders; rows of a key are brought together so that it has few files."""
    df.repartition(*keys).write.mode("overwrite").partitionBy(*keys).parquet(path)


def uncached(requests: DataFrame, cache: DataFrame, key: str = "key") -> DataFrame:
    """Requests without a stored answer."""
    return requests.join(cache, key, "left_anti")


def write_capabilities(df: DataFrame, root: str) -> None:
    """Capabilities by id, with an index of the ids beside them: columns capability_id, path, name and lane are the index."""
    write_partitioned(df, f"{root}/capabilities", "capability_id")
    df.select("capability_id", "path", "name", "lane").distinct().coalesce(1).write.mode("overwrite").parquet(f"{root}/index")


def write_parse_cache(parsed: DataFrame, root: str, repo_id: str) -> int:
    """The parsed files of a repository as the next version of its cache: parsed(path, hash, mtime, ...); returns the version."""
    return store_artifact(parsed.dropDuplicates(["path"]), root, repo_id, "parse_cache")


def append_events(events: DataFrame, root: str) -> None:
    """Add events to the log, by day; the state of a job is a fold of its events and is never rewritten."""
    events.withColumn("day", F.to_date("ts")).write.mode("append").partitionBy("day").parquet(f"{root}/events")


def export_json(df: DataFrame, path: str) -> None:
    """A table as JSON lines, for readers that want no Parquet."""
    df.write.mode("overwrite").json(path)
