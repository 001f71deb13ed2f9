"""Toxicity: gradient-boosted trees over dense features, calibrated by isotonic regression.

A lexicon of words and word beginnings is learned from labelled texts: those far likelier
in toxic ones. Texts become a few rates: lexicon density, its densest stretch, hits near a
second-person pronoun, capitals, punctuation and obfuscation. Trees and calibration are fitted on different rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from runledger.llm.common import fresh, named, stored

SECOND_PERSON = frozenset(
    "you your yours yourself u tu te toi ton ta tes vous votre vos du dich dir dein deine "
    "ihr euch tú ti tus usted ustedes vosotros".encode().split()
)
STEMS = range(4, 9)
NEAR, STRETCH = 6, 40
# A stem needs this log odds ratio and this many of its standard errors.
LEAST_ODDS, LEAST_ERRORS = 1.6, 3.5

_SPACED = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
_UPPER = bytes(range(65, 91))
_MARKS, _JUNK = b"!?.,;:", b"#*$%&|<>@~^_=+"
_HIDDEN = re.compile(rb"[a-z][0-9@$!*.\-_]+[a-z]")
_DRAWN = re.compile(rb"([a-z])\1\1")

FEATURES = (
    "weight", "density", "hits", "kinds", "stretch", "near", "second", "capitals", "marks",
    "shouts", "junk", "hidden", "drawn", "length",
)


def _words(raw: bytes) -> list[bytes]:
    return raw.translate(_SPACED).split()


def stems(word: bytes) -> list[bytes]:
    """The word itself, marked as whole, and its beginnings."""
    return [b"=" + word, *(word[:n] for n in STEMS if len(word) >= n)]


class _Weights(dict):
    """A word's largest lexicon weight; remembers a bounded number of words."""

    def __init__(self, lexicon: dict[bytes, float]):
        self.lexicon = lexicon

    def __missing__(self, word: bytes) -> float:
        if len(self) >= 300_000:
            self.clear()
        value = self[word] = max((self.lexicon.get(s, 0.0) for s in stems(word)), default=0.0)
        return value


def features(text: str | None, weights: _Weights) -> list[float]:
    """The values of ``FEATURES``; all 0 for null and empty texts."""
    if not text:
        return [0.0] * len(FEATURES)
    raw = text.encode("utf-8", "surrogatepass")
    low = text.lower().encode("utf-8", "surrogatepass")
    words = _words(low)
    n, size = max(1, len(words)), len(raw)
    found = np.fromiter(map(weights.__getitem__, words), np.float64, len(words))
    places = np.flatnonzero(found)
    stretch, near = 0, 0
    if len(places):
        stretch = int((np.searchsorted(places, places + STRETCH) - np.arange(len(places))).max())
        second = np.array([k for k, w in enumerate(words) if w in SECOND_PERSON], np.int64)
        if len(second):
            after = np.searchsorted(second, places)
            gap = np.minimum(
                np.abs(second[np.minimum(after, len(second) - 1)] - places),
                np.abs(second[np.maximum(after - 1, 0)] - places),
            )
            near = int((gap <= NEAR).sum())

    def rate(chars: bytes) -> float:
        return (size - len(raw.translate(None, chars))) / size

    return [
        float(found.sum()) / n, len(places) / n, math.log1p(len(places)),
        float(len({words[k] for k in places})), float(stretch), near / n,
        sum(map(SECOND_PERSON.__contains__, words)) / n, rate(_UPPER), rate(_MARKS), rate(b"!"),
        rate(_JUNK), len(_HIDDEN.findall(low)) / n, len(_DRAWN.findall(low)) / n, math.log1p(len(words)),
    ]


def with_features(docs: DataFrame, text: str, lexicon: dict[bytes, float], name: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = _Weights(shared.value)
        for batch in batches:
            rows = [features(value.as_py(), weights) for value in batch.column(text)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(rows, pa.list_(pa.float64()))], [*batch.schema.names, name]
            )

    return docs.mapInArrow(
        measure, StructType([*docs.schema.fields, StructField(name, ArrayType(DoubleType()))])
    )


def learn_lexicon(rows: DataFrame, most_stems: int) -> dict[bytes, float]:
    """Stems of ``rows(text, label)`` likelier in toxic texts, with their log odds ratio.

    At most ``most_stems`` reach the driver.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = {0.0: Counter(), 1.0: Counter()}
        for batch in batches:
            for text, label in zip(batch.column("text"), batch.column("label").to_pylist()):
                low = (text.as_py() or "").lower().encode("utf-8", "surrogatepass")
                seen[label].update({s for w in set(_words(low)) for s in stems(w)})
        for label, counts in seen.items():
            keys = list(counts)
            for k in range(0, len(keys), 50_000):
                part = keys[k : k + 50_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part, pa.binary()), pa.array([counts[s] for s in part], pa.int64()),
                     pa.array([label] * len(part), pa.float64())],
                    ["stem", "n", "label"],
                )

    totals = rows.groupBy("label").count().collect()
    toxic, clean = (float(sum(r["count"] for r in totals if r["label"] == k)) for k in (1.0, 0.0))
    counted = (
        rows.mapInArrow(count, "stem binary, n long, label double").groupBy("stem")
        .agg(
            F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).cast("double").alias("t"),
            F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).cast("double").alias("c"),
        )
        .where("t >= 3")
    )

    def odds(count: str, total: float) -> Column:
        return F.log((F.col(count) + 0.5) / (F.lit(total) - F.col(count) + 0.5))

    ratio = odds("t", toxic) - odds("c", clean)
    error = F.sqrt(1 / (F.col("t") + 0.5) + 1 / (F.col("c") + 0.5))
    chosen = counted.select("stem", ratio.alias("odds"), (ratio / error).alias("errors")).where(
        (F.col("odds") >= LEAST_ODDS) & (F.col("errors") >= LEAST_ERRORS)
    )
    return {bytes(r["stem"]): r["odds"] for r in chosen.orderBy(F.desc("errors"), "stem").limit(most_stems).collect()}


def fold_of(id_column: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; of the empty text for null."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % folds


def labelled_sample(
    docs: DataFrame, labels: DataFrame, id_column: str, text_column: str, most_rows: int
) -> DataFrame:
    """``text, label, fold`` of about ``most_rows`` labelled documents at most, chosen by hash.

    Ids whose crc32 modulo 5 is 0 are never used; an id labelled twice counts as toxic if once.
    """
    known = (
        labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id")
        .agg(F.max("toxic").cast("double").alias("label"))
        .withColumn("fold", fold_of(F.col("doc_id"), 5)).where("fold <> 0")
    )
    part = min(1.0, most_rows / max(1, known.count()))
    picked = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(part * 1_000_000))
    # Bounded by most_rows, so it may be broadcast instead of shuffling texts.
    return docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text")).join(
        F.broadcast(picked), "doc_id"
    ).select("text", "label", "fold")


def toxicity(
    docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text",
    most_rows: int = 30_000, trees: int = 20, depth: int = 4, most_stems: int = 5000,
) -> DataFrame:
    """``docs`` with ``held_out, score, predicted``.

    Learns from at most about ``most_rows`` labelled documents, none of them held out (crc32
    of the id modulo 5 is 0): a lexicon of at most ``most_stems`` stems, the most telling ones, and trees from three folds,
    calibration from the fourth. Without
    labels of both kinds every score is the share of toxic labels, or 0. Null and empty
    texts are scored as texts without words; a null id is held out. Repeated rows get equal
    scores. Columns with the names of results are replaced; an empty table gives no rows.
    """
    results = ("held_out", "score", "predicted")
    docs = docs.drop(*(c for c in docs.columns if c.lower() in results))
    sample = stored(labelled_sample(docs, labels, id_column, text_column, most_rows), "labelled")
    fitting, calibrating = sample.where("fold <> 4"), sample.where("fold = 4")
    held_out = (fold_of(F.col(id_column), 5) == 0).alias("held_out")

    def finished(rows: DataFrame, score: Column) -> DataFrame:
        columns = named(docs.columns)
        return rows.withColumn(values, score).select(
            *columns, held_out, F.col(values).alias("score"),
            (F.col(values) >= 0.5).cast("int").alias("predicted"),
        )

    (values,) = fresh(docs, "toxic_values")
    kinds = {(r["label"], r["late"]) for r in sample.select("label", (F.col("fold") == 4).alias("late")).distinct().collect()}
    if not {(0.0, False), (1.0, False)} <= kinds:
        share = sample.agg(F.coalesce(F.avg("label"), F.lit(0.0))).first()[0]
        return finished(docs, F.lit(float(share)))
    lexicon = learn_lexicon(fitting.select("text", "label"), most_stems)
    measured = stored(
        with_features(sample, "text", lexicon, "values")
        .select(array_to_vector("values").alias("features"), "label", (F.col("fold") == 4).alias("late")),
        "toxic-features",
    )
    forest = GBTClassifier(maxIter=trees, maxDepth=depth, maxBins=64, stepSize=0.2, seed=7).fit(measured.where("not late"))

    def raw(rows: DataFrame) -> DataFrame:
        return forest.transform(rows).withColumn("raw", vector_to_array("probability")[1])

    both = {(0.0, True), (1.0, True)} <= kinds
    curve = IsotonicRegression(featuresCol="raw", labelCol="label", predictionCol="level").fit(
        raw(measured.where("late" if both else "true"))
    )
    others = [c for c in docs.columns if c.lower() != text_column.lower()]
    rows = docs.select(F.struct(*named(others)).alias("doc"), named([text_column])[0].alias("text"))
    packed = with_features(rows, "text", lexicon, "values").select(
        "doc", "text", array_to_vector("values").alias("features")
    )
    # The calibrated level has steps; a trace of the raw score keeps the order within one.
    final = (F.col("level") + F.col("raw") / 1000) / 1.001
    levelled = curve.transform(raw(packed)).withColumn("final", final)
    columns = [(F.col("text") if c.lower() == text_column.lower() else F.col("doc")[c]).alias(c) for c in docs.columns]
    return levelled.select(
        *columns, (fold_of(F.col("doc")[id_column], 5) == 0).alias("held_out"),
        F.col("final").alias("score"), (F.col("final") >= 0.5).cast("int").alias("predicted"),
    )
