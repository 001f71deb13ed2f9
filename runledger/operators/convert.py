"""Conversion between text and Parquet samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runledger.sources import dat


# Samples far outnumber the files and folders they come from, and one of those may hold a
# large share of them; its rows are compared with the target in this many places.
_SPREAD = 16


def _matched(
    source: DataFrame, target: DataFrame, keys: Sequence[str], how: str, spread: int
) -> DataFrame:
    """Semi or anti join on keys of which one may be hot in the source.

    The target shrinks to its keys on the map side first. With ``spread`` each key is
    repeated that often and a source row looks for one of the copies.
    """
    found = target.select(*keys).distinct()
    if spread == 1:
        return source.join(found, list(keys), how)
    place = F.pmod(F.xxhash64(*source.columns), F.lit(spread)).cast("int")
    copies = found.withColumn("_place", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))))
    return source.withColumn("_place", place).join(copies, [*keys, "_place"], how).drop("_place")


def pending(
    source: DataFrame, target: DataFrame, keys: Sequence[str], spread: int = 1
) -> DataFrame:
    """Source rows whose key has no counterpart in the target.

    Pass a ``spread`` when many source rows may share a key.
    """
    return _matched(source, target, keys, "left_anti", spread)


# Files that a target was made from, and source files that were left out. Names that start with
# an underscore are no samples to any reader.
_LEDGER, _MISPLACED = "_ledger", "_misplaced"
_LEDGER_ROWS = "rel_path string, bytes bigint"


def ledger(spark: SparkSession, dst: str) -> DataFrame:
    """``rel_path, bytes`` of the source files a target holds; none for a new target."""
    done = dat.if_stored(lambda: spark.read.schema(_LEDGER_ROWS).parquet(f"{dst.rstrip('/')}/{_LEDGER}"))
    return spark.createDataFrame([], _LEDGER_ROWS) if done is None else done.dropDuplicates(["rel_path"])


def left_out(spark: SparkSession, dst: str) -> DataFrame:
    """``path, bytes, reason`` of source files that the last conversion could not place."""
    schema = "path string, bytes bigint, reason string"
    rows = dat.if_stored(lambda: spark.read.schema(schema).parquet(f"{dst.rstrip('/')}/{_MISPLACED}"))
    return spark.createDataFrame([], schema) if rows is None else rows


def _to_do(spark: SparkSession, files: DataFrame, dst: str, overwrite: bool) -> list[Row]:
    """Source files to convert. Names only; Spark's own listing holds all of them on the driver too."""
    placed = files.where("rel_path <> ''")
    if not overwrite:
        placed = placed.join(ledger(spark, dst), "rel_path", "left_anti")
    return placed.select("file", "rel_path", "bytes", *dat.PARTITIONS).collect()


def _set_aside(files: DataFrame, dst: str) -> None:
    reason = F.lit("no year, day and site in its folders")
    files.where("rel_path = ''").select("path", "bytes", reason.alias("reason")).write.mode("overwrite").parquet(
        f"{dst.rstrip('/')}/{_MISPLACED}"
    )


def _commit(spark: SparkSession, to_do: list[Row], dst: str) -> None:
    rows = spark.createDataFrame([(r.rel_path, r.bytes) for r in to_do], _LEDGER_ROWS)
    rows.coalesce(1).write.mode("append").parquet(f"{dst.rstrip('/')}/{_LEDGER}")


def _folders(spark: SparkSession, to_do: list[Row]) -> DataFrame:
    places = sorted({(r.year, r.doy, r.site) for r in to_do})
    return spark.createDataFrame(places, "year int, doy int, site string")


def dat_to_parquet(
    spark: SparkSession, src: str, dst: str, schema: T.StructType, overwrite: bool = False
) -> None:
    """Converts text samples; ``rel_path`` in the target says which file a row came from.

    Source files in the target's ledger are skipped before any text is read, or with ``overwrite`` converted anew. A
    file enters the ledger once its rows are stored. If a conversion ends before that, the next one finds rows of the file in
    its folder and replaces them. Files outside the layout are listed by ``left_out``.
    """
    files = dat.dat_files(spark, src)
    _set_aside(files, dst)
    to_do = _to_do(spark, files, dst, overwrite)
    if not to_do:
        return
    rows = dat.read_dat(spark, src, schema, only=[r.file for r in to_do])
    stored = dat.if_stored(lambda: dat.read_samples(spark, dst))
    if stored is None:
        dat.write_samples(rows, dst)
    else:
        names = spark.createDataFrame([(r.rel_path,) for r in to_do], "rel_path string")
        there = stored.join(_folders(spark, to_do), dat.PARTITIONS, "left_semi")
        if there.join(names, "rel_path", "left_semi").limit(1).count():
            # Whole folders are replaced, so rows of other files in them are carried over.
            others = pending(there, names, ["rel_path"], _SPREAD)
            dat.write_samples(rows.unionByName(others), dst, replace_folders=True)
        else:
            dat.write_samples(rows, dst)
    _commit(spark, to_do, dst)


def parquet_to_dat(
    spark: SparkSession, src: str, dst: str, schema: T.StructType, overwrite: bool = False
) -> None:
    """Writes Parquet samples as text.

    Source files in the target's ledger are skipped before they are read. Of others, samples whose line stands in the
    target's site day already are skipped, so those that come later for a known site day are added; only the site days
    of these files are looked at. With ``overwrite`` all site days are written anew.
    """
    to_do = _to_do(spark, dat.sample_files(spark, src), dst, overwrite)
    if not to_do:
        return
    rows = dat.read_samples(spark, src, only=None if overwrite else [r.file for r in to_do])
    if not overwrite:
        there = dat.if_stored(lambda: dat.dat_files(spark, dst))
        known = [] if there is None else [
            r.file for r in there.join(_folders(spark, to_do), dat.PARTITIONS, "left_semi").select("file").collect()
        ]
        if known:
            # Compared by line, so that a large site day spreads over many tasks.
            stored = dat.stored_lines(spark, dst, only=known)
            lined = rows.withColumn("value", dat.dat_line(rows, schema))
            rows = lined.join(stored, [*dat.PARTITIONS, "value"], "left_anti").select(rows.columns)
    dat.write_dat(rows, dst, schema, replace_folders=overwrite)
    _commit(spark, to_do, dst)
