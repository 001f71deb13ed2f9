"""Sample files: text (DAT) and Parquet, laid out by year, day of year and site.

The text format is this package's own choice: one sample per line, columns separated by
blanks in the order of a schema the caller gives, ``#`` starts a comment line, ``-`` stands
for NULL, times are ISO with a ``T``. Folders may be plain (``2026/001/aksu``) or named
(``year=2026/doy=1/site=aksu``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runledger.session import temporary_conf

PARTITIONS = ["year", "doy", "site"]

_NULL = "-"
# Files that hold samples: those that came as DAT and those ``write_dat`` left.
_FILES = "{*.dat,part-*.txt*}"
_LAYOUT = r"((?:year=)?([0-9]{4})/(?:doy=)?([0-9]{1,3})/(site=)?([^/]+)/[^/]+)\z"


def _field(name: str, kind: T.DataType) -> Column:
    value = F.col(name)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        text = F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    elif isinstance(kind, T.StringType):
        clash = value.rlike(r"[\s#]") | value.isin("", _NULL)
        problem = F.raise_error(F.concat(F.lit(f"{name} cannot be written as DAT: "), value))
        text = F.when(clash, problem).otherwise(value)
    else:
        text = value.cast("string")
    return F.coalesce(text, F.lit(_NULL))


def dat_line(samples: DataFrame, schema: T.StructType) -> Column:
    """The text line of a sample."""
    line = F.concat_ws(" ", *[_field(f.name, f.dataType) for f in schema])
    if "bad_line" in samples.columns:
        # Lines that could not be read go back as they came.
        line = F.coalesce(F.col("bad_line"), line)
    return line


def format_dat(samples: DataFrame, schema: T.StructType) -> DataFrame:
    """Partition columns and ``value``, the text line of each sample."""
    return samples.select(*PARTITIONS, dat_line(samples, schema).alias("value"))


def parse_dat(lines: DataFrame, schema: T.StructType, column: str = "value") -> DataFrame:
    """Adds the columns of the schema to text lines, and ``bad_line``.

    ``bad_line`` holds the text of a line with the wrong number of fields or a value that
    does not fit its type, and is NULL otherwise. Comment and blank lines are dropped.
    """
    text = F.btrim(F.col(column), F.lit(" \t\r\n"))
    lines = lines.withColumn(column, text).where((text != "") & ~text.startswith("#"))
    fields = F.col("_fields")
    values, fits = [], F.size(fields) == len(schema)
    for i, f in enumerate(schema):
        token = F.get(fields, F.lit(i))
        value = F.when(token != _NULL, token.try_cast(f.dataType))
        values.append(value.alias(f.name))
        fits = fits & (value.isNotNull() | (token == _NULL))
    others = [c for c in lines.columns if c != column]
    return lines.withColumn("_fields", F.split(column, r"\s+")).select(
        *others, *values, F.when(~fits, F.col(column)).alias("bad_line")
    )


def _decoded(name: Column) -> Column:
    return F.try_url_decode(F.replace(name, F.lit("+"), F.lit("%2B")))


def _site(path: Column) -> Column:
    # The path is URL-encoded; below "site=" the name itself is escaped as well.
    name = _decoded(F.regexp_extract(path, _LAYOUT, 5))
    escaped = F.regexp_extract(path, _LAYOUT, 4) != ""
    return F.when(escaped, _decoded(name)).otherwise(name)


def read_dat(
    spark: SparkSession, root: str, schema: T.StructType, subpath: str = "", only: list[str] | None = None
) -> DataFrame:
    """Samples of the DAT files below a root, or below one folder of it.

    Adds ``year, doy, site`` and ``rel_path``, taken from the place of the file. Files with
    other names are not samples; ``misplaced_files`` lists DAT files outside the layout. ``only`` names the files
    to read, as ``dat_files`` gives their ``file``; others are listed but not opened.
    """
    return parse_dat(_dat_lines(spark, root, subpath, only), schema)


def _listed(spark: SparkSession, root: str, names: str) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", names)
    return reader.load(root).select(
        "path", F.col("_metadata.file_path").alias("file"), F.col("length").alias("bytes")
    )


def _place(file: Column) -> dict[str, Column]:
    return {
        "year": F.regexp_extract(file, _LAYOUT, 2).try_cast("int"),
        "doy": F.regexp_extract(file, _LAYOUT, 3).try_cast("int"),
        "site": _site(file),
        "rel_path": F.regexp_extract(file, _LAYOUT, 1),
    }


def dat_files(spark: SparkSession, root: str) -> DataFrame:
    """``path, file, bytes, year, doy, site, rel_path`` of the DAT files below a root; contents are not read.

    Files outside the layout have no year, day and site and an empty ``rel_path``.
    """
    return _listed(spark, root, _FILES).withColumns(_place(F.col("file")))


def sample_files(spark: SparkSession, root: str) -> DataFrame:
    """The same of stored Parquet samples."""
    return _listed(spark, root, "*.parquet").withColumns(_place(F.col("file")))


def misplaced_files(spark: SparkSession, root: str) -> DataFrame:
    """``path`` of DAT files below a root whose folders name no year, day and site.

    ``read_dat`` cannot place their samples. Contents are not read.
    """
    return dat_files(spark, root).where("rel_path = ''").select("path")


def _dat_lines(
    spark: SparkSession, root: str, subpath: str = "", only: list[str] | None = None
) -> DataFrame:
    folder = root.rstrip("/") + ("/" + subpath.strip("/") if subpath.strip("/") else "")
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", _FILES)
    raw = reader.text(folder)
    path = F.col("_metadata.file_path")
    if only is not None:
        raw = raw.where(path.isin(only))
    place = _place(path)
    return raw.select(*(place[c].alias(c) for c in place), "value").where(F.col("year").isNotNull())


def stored_lines(spark: SparkSession, root: str, only: list[str] | None = None) -> DataFrame:
    """``year, doy, site, value``: the different lines of stored DAT files, as they stand."""
    text = F.btrim(F.col("value"), F.lit(" \t\r\n"))
    return _dat_lines(spark, root, only=only).select(*PARTITIONS, text.alias("value")).distinct()


def _save(samples: DataFrame, path: str, kind: str, replace_folders: bool) -> None:
    # Adaptive execution merges small folders into one task and splits a hot one over many.
    # Writing many small folders costs time per file rather than per byte, so those are
    # spread over all cores even when they hold little.
    spread = {"spark.sql.adaptive.coalescePartitions.minPartitionSize": "16k"}
    with temporary_conf(samples.sparkSession, spread):
        writer = samples.write.partitionBy(*PARTITIONS).format(kind)
        if replace_folders:
            writer.mode("overwrite").option("partitionOverwriteMode", "dynamic").save(path)
        else:
            writer.mode("append").save(path)


def _by_folder(samples: DataFrame) -> DataFrame:
    return samples.hint("rebalance", *PARTITIONS).sortWithinPartitions(*PARTITIONS, "ts")


def write_dat(
    samples: DataFrame, path: str, schema: T.StructType, replace_folders: bool = False
) -> None:
    """Writes samples as text below ``year=/doy=/site=``; each file is in time order.

    ``replace_folders`` replaces the folders that occur in the samples and leaves the rest.
    """
    _save(format_dat(_by_folder(samples), schema), path, "text", replace_folders)


def write_samples(samples: DataFrame, path: str, replace_folders: bool = False) -> None:
    """Writes samples as Parquet, in the same layout."""
    _save(_by_folder(samples), path, "parquet", replace_folders)


def read_samples(spark: SparkSession, path: str, only: list[str] | None = None) -> DataFrame:
    """Stored Parquet samples. Sites stay text, also when their names are digits. ``only`` names the files to read."""
    as_text = {"spark.sql.sources.partitionColumnTypeInference.enabled": "false"}
    with temporary_conf(spark, as_text):
        rows = spark.read.parquet(path)
    if only is not None:
        rows = rows.where(F.col("_metadata.file_path").isin(only))
    return rows.withColumns({c: F.col(c).cast("int") for c in ("year", "doy")})


def if_stored(read: Callable[[], DataFrame]) -> DataFrame | None:
    """What ``read`` finds, None when there is nothing yet."""
    try:
        return read()
    except AnalysisException as exc:
        if exc.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def export_csv(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    rows.write.mode(mode).option("header", "true").csv(path)
