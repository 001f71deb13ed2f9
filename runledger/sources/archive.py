"""Manifest of the files in an archive folder."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runledger import schemas


def _qualified(spark: SparkSession, root: str) -> str:
    """The root as the file system writes it: absolute, without dots or doubled slashes."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return system.makeQualified(path).toString().rstrip("/")


def _names(spark: SparkSession, base: str, pattern: str, folders: bool) -> list[tuple[str, bool]]:
    """Paths below ``base`` that match, without reading contents; ``folders`` leaves files out."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    # Only the pattern is one; what looks like one in the root is a name.
    plain = re.sub(r"([][{}*?\\])", r"\\\1", base)
    files = path(base).getFileSystem(spark._jsc.hadoopConfiguration())
    found = []
    for status in files.globStatus(path(f"{plain}/{pattern}")) or []:
        is_dir = status.isDirectory()
        if is_dir or not folders:
            found.append((status.getPath().toString()[len(base) + 1 :], is_dir))
    return found


def scan_archive(spark: SparkSession, root: str | None) -> DataFrame:
    """``(path, is_dir)`` of what lies below a root, paths relative to it.

    File contents are not read. A blank or missing root gives no rows. Files are listed by Spark, in parallel
    for many folders. Spark passes over names that start with ``.`` or ``_``, and folders
    are no files; the driver asks the file system for those, down to the files of days. They are few next to the files:
    folders are bounded by years and days.
    """
    nothing = spark.createDataFrame([], schemas.MANIFEST)
    if not root or not root.strip():
        return nothing
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    except AnalysisException as exc:
        if exc.getCondition() == "PATH_NOT_FOUND":
            return nothing
        raise
    # Listed paths are absolute and carry a scheme. A root that is itself a file has nothing below it.
    base = _qualified(spark, root)
    path = F.col("path")
    outside = F.raise_error(F.concat(F.lit(f"listed file is not below {base}: "), path))
    below = F.when(path.startswith(f"{base}/"), path.substr(len(base) + 2, 1 << 30)).otherwise(outside)
    seen = files.where(path != base).select(below.alias("path"), F.lit(False).alias("is_dir"))
    hidden = "[_.]*"
    others = {
        *_names(spark, base, "*", True), *_names(spark, base, "*/*", True),
        *_names(spark, base, hidden, False), *_names(spark, base, f"*/{hidden}", False),
        *_names(spark, base, f"*/*/{hidden}", False),
    }
    return seen.unionByName(spark.createDataFrame(sorted(others), schemas.MANIFEST)) if others else seen
