"""Log text as rows, batch and streaming."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def clean_line(line: Column) -> Column:
    """Line without its closing CR and LF."""
    return F.rtrim(line, F.lit("\r\n"))


def decode_line(raw: Column) -> Column:
    """Line from bytes; bytes that are not UTF-8 are replaced."""
    return clean_line(F.make_valid_utf8(raw.cast("string")))


def _keep(lines: DataFrame) -> DataFrame:
    return lines.where(F.length("line") > 0)


# A file that was turned over: its number, and what packed it since.
_TURNED = r"\.([0-9]+)(\.(?:gz|bz2|zst|lz4|snappy|deflate))?\z"


def read_log_text(spark: SparkSession, path: str, rotated: bool = False) -> DataFrame:
    """``(file, seq, line)`` of text logs: empty lines dropped, blank ones kept.

    Only LF ends a line, so a CR inside one stays. ``seq`` numbers the lines kept of each file from 0 without gaps, for
    plain and compressed files alike. With ``rotated``, files like ``run.log.2``, ``run.log.1.gz`` and ``run.log``
    are one, ``run.log``, the highest number being the oldest.

    A split is read by one task from front to back, so a line's place in it is known at once. Lines are counted per
    split, and the splits before it are added up: the text is read twice and never shuffled by file. The files must not change meanwhile.
    """
    raw = spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true").text(path)
    split = ["file", "start"]
    kept = _keep(raw.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        clean_line(F.col("value")).alias("line"),
    ))
    lines = kept.withColumn("row", F.monotonically_increasing_id())
    whole, turn = F.col("file"), F.lit(0)
    if rotated:
        number = F.regexp_extract("file", _TURNED, 1).try_cast("bigint")
        whole, turn = F.regexp_replace("file", _TURNED, ""), F.coalesce(number, F.lit(-1))
    counts = lines.groupBy(*split).agg(F.count("*").alias("lines"), F.min("row").alias("first"))
    before = (
        Window.partitionBy("whole").orderBy(F.col("turn").desc(), "file", "start")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    shifts = counts.withColumns({"whole": whole, "turn": turn}).select(
        *split, "whole", (F.coalesce(F.sum("lines").over(before), F.lit(0)) - F.col("first")).alias("shift")
    )
    return lines.join(shifts, split).select(
        F.col("whole").alias("file"), (F.col("row") + F.col("shift")).alias("seq"), "line"
    )


def stream_log_text(
    spark: SparkSession, path: str, max_files: int | None = None, only_new: bool = False
) -> DataFrame:
    """``(file, line)`` as a stream.

    ``max_files`` bounds a micro-batch. ``only_new`` leaves out files that were last written
    before this call, for followers who want no replay.
    """
    reader = spark.readStream.option("lineSep", "\n").option("recursiveFileLookup", "true")
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    raw = reader.text(path)
    if only_new:
        now = dt.datetime.now(dt.timezone.utc)
        raw = raw.where(F.col("_metadata.file_modification_time") >= F.lit(now))
    return _keep(raw.select(F.col("_metadata.file_path").alias("file"),
                            clean_line(F.col("value")).alias("line")))


def lines_from_bytes(records: DataFrame, column: str = "raw") -> DataFrame:
    """Replaces a binary column by ``line``, under the same rules."""
    return _keep(records.withColumn("line", decode_line(F.col(column))).drop(column))
