"""Quality rules with thresholds that adapt to language and source.

Each measure of a text, scaled to a whole number, falls into a bucket a thirty-second of its
size wide. Counts per bucket are a quantile sketch: sketches of parts add up, in any
order, to that of the whole. A group's fence is its third quartile (or first) plus (less) a
number of interquartile ranges. A language's sketch is blended with that of all texts, scaled to a fixed number of
texts, and a group's with its language's in the same way: the fewer texts a group has, the more its language counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from runledger.llm.common import WordHashes, gram_hashes, named, stored

SYMBOLS, SPACE = "#*$%&|<>", " \t\n\x0b\x0c\r"
WINDOW, LEAST_WORDS, MOST_REPEATED = 8, 20, 30

COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stutters",
    "n_capitals", "n_shouts",
)
_DETAIL = 32
SCALE = 1_000_000
# Parts of a text that blended sketches count in; whole numbers add up alike in any order.
_PARTS = 10_000

# Measure: counted, per what, whether low values are odd too, and the least spread that counts.
MEASURES: dict[str, tuple[str, str, bool, float]] = {
    "word_length": ("word_chars", "n_words", True, 0.25),
    "symbols": ("n_symbols", "n_words", False, 0.02),
    "dup_lines": ("n_dup_lines", "n_lines", False, 0.1),
    "repeats": ("n_repeat_words", "n_words", False, 0.05),
    "stutters": ("n_stutters", "n_words", False, 0.04),
    "capitals": ("n_capitals", "word_chars", False, 0.04),
    "shouts": ("n_shouts", "n_words", False, 0.03),
}


def counts(text: str | None, hashes: WordHashes) -> list[int]:
    """The values of ``COUNTS``; all 0 for null and empty texts."""
    if not text:
        return [0] * len(COUNTS)
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    lines = [line for line in raw.split(b"\n") if line.split()]
    found = hashes.of(words)
    repeated = 0
    if len(words) >= WINDOW:
        _, inverse, times = np.unique(gram_hashes(found, WINDOW), return_inverse=True, return_counts=True)
        starts = np.flatnonzero(times[inverse] > 1)
        if len(starts):
            # +1 where a repeated window begins, -1 where it ends.
            edges = np.zeros(len(words) + 1, np.int64)
            np.add.at(edges, starts, 1)
            np.add.at(edges, starts + WINDOW, -1)
            repeated = int((np.cumsum(edges) > 0).sum())
    return [
        len(words), len(text) - sum(map(text.count, SPACE)), sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)), repeated, len(lines), int((found[1:] == found[:-1]).sum()),
        len(raw) - len(raw.translate(None, bytes(range(65, 91)))), text.count("!"),
    ]


def measured(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` with ``COUNTS``."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            rows = np.array(
                [counts(value.as_py(), hashes) for value in batch.column(text)], np.int64
            ).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *(pa.array(c) for c in rows.T)], [*batch.schema.names, *COUNTS]
            )

    return docs.mapInArrow(
        count, StructType([*docs.schema.fields, *(StructField(c, LongType()) for c in COUNTS)])
    )


def _value(measure: str) -> Column:
    part, whole, _, _ = MEASURES[measure]
    return F.expr(f"CASE WHEN {whole} > 0 THEN {part} * {SCALE}L div {whole} ELSE 0L END")


def bucket(value: Column) -> Column:
    """The sketch bucket of a whole number: exact below 64, else its top six bits and its magnitude."""
    magnitude = F.length(F.bin(value)) - 6
    return F.when(value < 2 * _DETAIL, value).otherwise(
        magnitude * _DETAIL + F.expr("shiftright(v, length(bin(v)) - 6)")
    ).cast("long")


def bucket_value(number: Column) -> Column:
    """The middle of a bucket."""
    magnitude = F.greatest(F.floor(number / _DETAIL) - 1, F.lit(0))
    top = number - magnitude * _DETAIL
    return (top * F.pow(F.lit(2.0), magnitude) + (F.pow(F.lit(2.0), magnitude) - 1) / 2) / SCALE


def sketches(rows: DataFrame) -> DataFrame:
    """``lang, source, measure, bucket, n`` over rows with ``COUNTS``; additive."""
    values = F.array(*(
        F.struct(F.lit(k).alias("measure"), _value(k).alias("v")) for k in MEASURES
    ))
    return (
        rows.select("lang", "source", F.explode(values).alias("m")).select("lang", "source", "m.*")
        .withColumn("bucket", bucket(F.col("v")))
        .groupBy("lang", "source", "measure", "bucket").agg(F.count("*").alias("n"))
    )


def quartiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, measure, q1, q3`` of sketches per ``keys``."""
    group = [*keys, "measure"]
    rising = Window.partitionBy(*group).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    reached = sketch.withColumn("upto", F.sum("n").over(rising)).withColumn(
        "total", F.sum("n").over(Window.partitionBy(*group))
    )

    def quantile(part: int) -> Column:
        return F.min(F.when(4 * F.col("upto") >= part * F.col("total"), F.col("bucket")))

    return reached.groupBy(*group).agg(
        bucket_value(quantile(1)).alias("q1"), bucket_value(quantile(3)).alias("q3"),
    )


def _with_prior(sketch: DataFrame, prior: DataFrame, keys: list[str], shared: list[str], prior_rows: int) -> DataFrame:
    """``sketch`` (``keys, measure, bucket, n``) plus ``prior`` (``shared, measure, bucket, n``) scaled to ``prior_rows`` texts."""
    whole = prior.groupBy(*shared, "measure").agg(F.sum("n").alias("total"))
    renamed = whole.select(*(F.col(k).alias(f"of_{k}") for k in [*shared, "measure"]), "total")
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"of_{k}")) for k in [*shared, "measure"]))
    share = prior.join(renamed, same).select(
        *(F.col(k).alias(f"of_{k}") for k in shared), F.col("measure").alias("of_measure"), "bucket",
        F.expr(f"CAST(CAST(n AS DECIMAL(38, 0)) * {prior_rows * _PARTS}L div total AS bigint)").alias("n"),
    )
    # One row per group and measure: groups are languages and sources, few next to the texts.
    groups = sketch.select(*keys, "measure").distinct()
    added = groups.join(share, same).select(*keys, "measure", "bucket", "n")
    return sketch.unionByName(added).groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))


def fences(sketch: DataFrame, ranges: float, prior_rows: int) -> DataFrame:
    """``lang, source, <measure>_low, <measure>_high``: one row for each group."""
    def summed(keys: list[str]) -> DataFrame:
        return sketch.groupBy(*keys, "measure", "bucket").agg((F.sum("n") * _PARTS).alias("n"))

    of_lang = _with_prior(summed(["lang"]), summed([]), ["lang"], [], prior_rows)
    of_group = _with_prior(summed(["lang", "source"]), of_lang, ["lang", "source"], ["lang"], prior_rows)
    spread = reduce(
        lambda rest, k: F.when(F.col("measure") == k, F.lit(MEASURES[k][3])).otherwise(rest),
        MEASURES, F.lit(0.0),
    )
    width = ranges * F.greatest(F.col("q3") - F.col("q1"), spread)
    bounds = quartiles(of_group, ["lang", "source"]).withColumns(
        {"low": F.col("q1") - width, "high": F.col("q3") + width}
    )
    return bounds.groupBy("lang", "source").agg(*(
        F.max(F.when(F.col("measure") == k, F.col(side))).alias(f"{k}_{side}")
        for k in MEASURES for side in ("low", "high")
    ))


def judge_quality(
    docs: DataFrame, text_column: str = "text", lang_column: str = "lang",
    source_column: str = "source", ranges: float = 5.0, prior_rows: int = 100, keep_text: bool = True,
) -> DataFrame:
    """``docs`` with ``COUNTS``, ``base_failed`` and ``kept``.

    ``base_failed``: fewer than 20 words, or more than 30 % of them in eight-word windows found twice. Else
    a text is kept if each measure lies within the fences of its language and source: quartiles and ``ranges``
    interquartile ranges beyond them, a range being at least the spread given in ``MEASURES``, so that texts
    that are nearly alike are no outliers. Each group's texts are judged together with ``prior_rows`` texts' worth of its language's
    sketch, which holds as much of all texts'; no size switches from one to the other. Null languages and sources are groups of their own; null and
    empty texts have no words and fail. Repeated rows are judged alike. Columns with the names of results are
    replaced; an empty table gives no rows.
    """
    results = (*COUNTS, "base_failed", "kept")
    docs = docs.drop(*(c for c in docs.columns if c.lower() in results))
    carried = docs.columns if keep_text else [c for c in docs.columns if c.lower() != text_column.lower()]
    packed = docs.select(
        F.struct(*named(carried)).alias("doc"), F.col(text_column).alias("text"),
        F.col(lang_column).alias("lang"), F.col(source_column).alias("source"),
    )
    rows = stored(measured(packed, "text").drop("text"), "quality-counts")
    bounds = fences(sketches(rows), ranges, prior_rows).withColumnsRenamed(
        {"lang": "of_lang", "source": "of_source"}
    )
    failed = F.expr(f"n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words")
    inside = [F.lit(True)]
    for name, (_, _, two_sided, _) in MEASURES.items():
        value = _value(name) / SCALE
        inside.append(value <= F.col(f"{name}_high"))
        if two_sided:
            inside.append(value >= F.col(f"{name}_low"))
    within = reduce(lambda a, b: a & b, inside)
    return rows.join(bounds, F.expr("lang <=> of_lang AND source <=> of_source"), "left").select(
        "doc.*", *COUNTS, failed.alias("base_failed"),
        (~failed & F.coalesce(within, F.lit(False))).alias("kept"),
    )
