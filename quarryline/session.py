"""Session helpers: a local session for tests, and lineage cuts that survive the loss of an executor."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: str = "8", shuffle_partitions: int = 8) -> SparkSession:
    """A local session with the settings the tests and the benchmark use."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("quarryline")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a checkpoint in the shared folder of ``spark.checkpoint.dir``.

    The folder named by the cluster is used as it is. Where the setting is absent a folder of our own is made in local
    mode only (tests); on a cluster a folder of one machine would lose data, so that is an error.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="quarryline-"))
    return df.checkpoint(eager=True)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors of a cluster that has no copy of it."""
    import shutil
    from pathlib import Path

    home = Path(__file__).resolve().parent
    spark.sparkContext.addPyFile(shutil.make_archive(f"{tempfile.mkdtemp()}/{home.name}", "zip", home.parent, home.name))


def spread_left_join(left: DataFrame, right: DataFrame, on: list[str], row_id: str, share: float = 0.002, rows: int = 500_000, counts: DataFrame | None = None) -> DataFrame:
    """Left outer join to a side with one row per key that splits hot keys of the left side.

    A key is hot when it holds more than ``share`` of the left rows, so there are at most ``1 / share`` hot keys and
    the list that is sent to every task is bounded whatever the input. The rows of a hot key are spread by the hash of
    ``row_id`` over as many salts as it has shares, or times ``rows``, whichever is more; only the hot keys of the right
    side are repeated.
    ``counts`` may give rows per key (*on, _n) where they are known already. Null keys match nothing. Key columns must
    not be called ``_salt`` or ``_ways``.
    """
    if counts is None:
        counts = left.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n").alias("_total"))
    hot = (
        counts.crossJoin(F.broadcast(total))  # one row
        .where(F.col("_n") > F.col("_total") * share)
        .select(*on, F.greatest(F.ceil(F.col("_n") / (F.col("_total") * share)), F.ceil(F.col("_n") / rows)).cast("int").alias("_ways"))
    )
    hot = F.broadcast(hot)  # at most 1 / share rows
    ways = F.coalesce(F.col("_ways"), F.lit(1))
    a = left.join(hot, on, "left").withColumn("_salt", F.pmod(F.xxhash64(row_id), ways).cast("int")).drop("_ways")
    b = right.join(hot, on, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), ways - 1))).drop("_ways")
    return a.join(b, [*on, "_salt"], "left").drop("_salt")


def has(df: DataFrame, name: str, kind: str) -> Column:
    """The named column, or a null of that type where the table lacks it."""
    return F.col(name) if name in df.columns else F.lit(None).cast(kind).alias(name)
