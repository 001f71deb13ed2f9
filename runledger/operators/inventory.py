"""Station files per day in an archive of ``YYYY_original/DD[D]/<station>.zip``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The folder names of the archive and the suffix of a station file. A bare
# ".zip" has no suffix.
YEAR_DIR = r"\A[0-9]{4}_original\z"
DAY_DIR = r"\A[0-9]{2,3}\z"
STATION_FILE = r"(?is)\A.+\.zip\z"


def _entries(manifest: DataFrame) -> DataFrame:
    """Manifest rows below a valid year folder, with their path split up."""
    slashes = F.length("path") - F.length(F.replace(F.col("path"), F.lit("/")))
    depth = slashes + 1
    return (
        manifest.select(
            F.substring_index("path", "/", 1).alias("year"),
            F.split_part(F.col("path"), F.lit("/"), F.lit(2)).alias("day"),
            F.split_part(F.col("path"), F.lit("/"), F.lit(3)).alias("name"),
            depth.alias("depth"),
            # Anything with something below it is a folder.
            ((depth > 1) | F.col("is_dir")).alias("year_is_dir"),
            ((depth > 2) | ((depth == 2) & F.col("is_dir"))).alias("day_is_dir"),
            "is_dir",
        )
        .where(F.col("year").rlike(YEAR_DIR) & F.col("year_is_dir"))
    )


def _counted(entries: DataFrame) -> DataFrame:
    station = (F.col("depth") == 3) & ~F.col("is_dir") & F.col("name").rlike(STATION_FILE)
    return entries.groupBy("year", "day").agg(
        F.count(F.when(station, 1)).alias("stations")
    )


def archive_days(manifest: DataFrame) -> DataFrame:
    """``(year, day, stations)`` for each valid day folder.

    The manifest has one row per path, relative to the archive root. Folders need rows of
    their own only where they hold no files.
    """
    return _counted(_entries(manifest).where(F.col("day").rlike(DAY_DIR) & F.col("day_is_dir")))


def archive_tree(manifest: DataFrame) -> DataFrame:
    """One row per year, newest first, with its days in order.

    ``days`` is ``array<struct<day,stations>>`` by day number, then by length of the name
    (``01`` before ``001``). Valid names allow at most 1,100 days in a year.
    """
    named = F.col("day").rlike(DAY_DIR) & F.col("day_is_dir")
    # Folders that are no days still show that their year exists.
    days = _counted(_entries(manifest).withColumn("day", F.when(named, F.col("day"))))
    ordered = F.sort_array(
        F.collect_list(
            F.when(
                F.col("day").isNotNull(),
                F.struct(
                    F.col("day").cast("int").alias("number"), F.length("day").alias("width"),
                    "day", "stations",
                ),
            )
        )
    )
    return (
        days.groupBy("year")
        .agg(ordered.alias("days"))
        .withColumn(
            "days", F.transform("days", lambda d: F.struct(d["day"].alias("day"), d["stations"].alias("stations")))
        )
        .orderBy(F.substring("year", 1, 4).cast("int").desc())
    )
