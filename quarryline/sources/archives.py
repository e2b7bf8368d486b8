"""Archives: reading the entries of zip files, the guards that tell which of them may be unpacked, and unpacking these.

Entries are (archive, ord, name, file_size, packed_size, is_dir, archive_bytes). A check of the whole archive (its size,
its number of entries) refuses all of them; the others refuse single entries, in the order of the checks. Sizes are
summed in the order of the archive.

Defined results: a file that is no zip has one entry with a null name, which is refused; null names are unsafe.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarryline.functions.paths import extension

# Limits of the hardened variant, and names that some systems reserve.
MAX_ENTRIES, MAX_DEPTH, MAX_TOTAL, MAX_RATIO = 60_000, 20, 1 << 30, 200
RESERVED = r"(?i)(^|/)(con|prn|aux|nul|com[1-9]|lpt[1-9])(\.[^/]*)?(/|$)"

ENTRY = "archive string, ord int, name string, file_size bigint, packed_size bigint, is_dir boolean, archive_bytes bigint"


def stage_upload(spark: SparkSession, local: str, root: str) -> str:
    """Copy a file of the driver into a shared folder; returns where it is."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    source, target = jvm.org.apache.hadoop.fs.Path(f"file://{local}"), jvm.org.apache.hadoop.fs.Path(f"{root}/{local.rsplit('/', 1)[-1]}")
    target.getFileSystem(conf).copyFromLocalFile(False, True, source, target)
    return target.toString()


def _listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for path, size, content in zip(pdf.path, pdf.length, pdf.content):
            try:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    rows += [(path, k, e.filename, e.file_size, e.compress_size, e.is_dir(), size) for k, e in enumerate(z.infolist())]
            except (zipfile.BadZipFile, OSError, ValueError):
                rows.append((path, 0, None, 0, 0, False, size))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in ENTRY.split(", ")])


def _archives(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", True).load(folder)


def entries(spark: SparkSession, folder: str) -> DataFrame:
    """The entries of all zip files below a folder; only their directories are read."""
    return _archives(spark, folder).select("path", "length", "content").mapInPandas(_listed, ENTRY)


def guarded(entries: DataFrame, max_archive: int = MAX_TOTAL, max_entries: int = MAX_ENTRIES, max_file: int = 50 << 20,
            ignored_dirs: tuple[str, ...] = ("node_modules", ".git"), ignored_exts: tuple[str, ...] = (".png", ".jpg")) -> DataFrame:
    """Entries with a verdict: 'ok', 'ignored', or why they are refused.

    Sizes are summed within an archive that passed the check of its number of entries, so a window has at most
    ``max_entries`` rows.
    """
    n = entries.groupBy("archive").agg(F.count(F.lit(1)).alias("_entries"))
    name = F.translate(F.coalesce("name", F.lit("/")), "\\", "/")
    parts = F.split(name, "/")
    rows = entries.join(n, "archive")
    many = F.col("_entries") > max_entries
    order = Window.partitionBy("archive", F.when(many, F.col("ord"))).orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    upto = F.sum(F.when(~F.col("is_dir"), F.col("file_size")).otherwise(0)).over(order)
    verdict = (
        F.when(F.col("archive_bytes") > max_archive, "archive too large").when(many, "too many entries")
        .when(F.arrays_overlap(parts, F.array(*map(F.lit, ignored_dirs))) | extension(name).isin(*ignored_exts), "ignored")
        .when(name.startswith("/") | name.rlike(r"^[A-Za-z]:") | F.array_contains(parts, "..") | name.rlike(RESERVED), "unsafe path")
        .when(F.size(parts) > MAX_DEPTH, "too deep").when(F.col("file_size") > max_file, "file too large")
        .when((F.col("packed_size") > 0) & (F.col("file_size") / F.col("packed_size") > MAX_RATIO), "suspicious ratio").when(F.col("_upto") > MAX_TOTAL, "too large in all").otherwise("ok"))
    return rows.withColumn("_upto", upto).withColumn("verdict", verdict).drop("_upto", "_entries")


def _unpacked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for path, content, wanted in zip(pdf.path, pdf.content, pdf.wanted):
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                held = z.infolist()
                rows += [(path, held[k].filename, z.read(held[k])) for k in wanted]
        yield pd.DataFrame(rows, columns=["archive", "path", "content"])


def extracted(spark: SparkSession, folder: str, verdicts: DataFrame) -> DataFrame:
    """The content of the entries that may be unpacked: (archive, path, content). Refused entries are never inflated."""
    ok = verdicts.where("verdict = 'ok' and not is_dir").groupBy(F.col("archive").alias("path")).agg(F.collect_list("ord").alias("wanted"))  # at most max_entries
    return _archives(spark, folder).select("path", "content").join(ok, "path").mapInPandas(_unpacked, "archive string, path string, content binary")
