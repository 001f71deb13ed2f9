"""Benchmark decontamination by winnowing.

A window is ten words. Of the k-grams inside it the one of smallest hash is its
fingerprint, so two texts that share a window share the fingerprint, wherever the window
stands: no shared span of ten words is missed. Items' fingerprints fill a Bloom filter of
fixed size; documents' windows whose fingerprint it rules out end there. The others meet
the items' fingerprints in a join, which also asks for an equal hash of the whole window,
and the windows found extend to the spans of words they cover.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from runledger.llm.common import WordHashes, bloom, gram_hashes, might_contain, named, stored

# Lower-cases A-Z; other ASCII characters than letters and digits part words.
_LETTERS = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)
)

_SPAN = StructType([
    StructField("start", IntegerType()), StructField("length", IntegerType()),
    StructField("fingerprint", LongType()), StructField("window", LongType()),
])


def words(text: str | None) -> list[bytes]:
    """Lower-cased words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``; none for null."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_LETTERS).split()


def fingerprints(hashes: np.ndarray, length: int, k: int) -> np.ndarray:
    """For each window of ``length`` words the smallest hash of its k-grams."""
    k = min(k, length)
    grams = gram_hashes(hashes, k)
    size = len(hashes) - length + 1
    if size <= 0:
        return np.empty(0, np.uint64)
    least = grams[:size].copy()
    for shift in range(1, length - k + 1):
        np.minimum(least, grams[shift : shift + size], out=least)
    return least


def _item_windows(items: DataFrame, window: int, k: int) -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for item, text in zip(batch.column("item"), batch.column("text")):
                found = hashes.of(words(text.as_py()))
                length = min(window, len(found))
                if not length:
                    continue
                least, whole = fingerprints(found, length, k), gram_hashes(found, length)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([item.as_py()] * len(whole), pa.string()),
                     pa.array(np.full(len(whole), length, np.int32)),
                     pa.array(least.view(np.int64)), pa.array(whole.view(np.int64))],
                    ["item", "length", "fingerprint", "window"],
                )

    return items.mapInArrow(cut, "item string, length int, fingerprint long, window long").distinct()


def _with_spans(docs: DataFrame, text: str, lengths: list[int], filled: np.ndarray, k: int) -> DataFrame:
    """``docs`` with its word count and the windows whose fingerprint an item may have."""
    shared = docs.sparkSession.sparkContext.broadcast(filled)
    schema = StructType([
        *docs.schema.fields, StructField("n_words", LongType()), StructField("spans", ArrayType(_SPAN)),
    ])
    kind = pa.list_(pa.struct([
        ("start", pa.int32()), ("length", pa.int32()), ("fingerprint", pa.int64()), ("window", pa.int64()),
    ]))

    def spans_of(found: np.ndarray) -> list[dict]:
        spans = []
        for length in lengths:
            least = fingerprints(found, length, k)
            if not len(least):
                continue
            # Neighbouring windows mostly share a fingerprint: ask once for each run.
            starts = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
            likely = might_contain(shared.value, least[starts])
            if not likely.any():
                continue
            whole = gram_hashes(found, length).view(np.int64)
            places = np.flatnonzero(np.repeat(likely, np.diff(np.r_[starts, len(least)])))
            spans += [
                {"start": int(s), "length": length, "fingerprint": int(f), "window": int(w)}
                for s, f, w in zip(places, least[places].view(np.int64), whole[places])
            ]
        return spans

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            counts, spans = [], []
            for value in batch.column(text):
                found = hashes.of(words(value.as_py()))
                counts.append(len(found))
                spans.append(spans_of(found))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(counts, pa.int64()), pa.array(spans, kind)],
                [*batch.schema.names, "n_words", "spans"],
            )

    return docs.mapInArrow(scan, schema)


def contamination(
    docs: DataFrame, items: DataFrame, text_column: str = "text",
    item_id: str = "item_id", item_text: str = "text", window: int = 10, k: int = 5,
) -> DataFrame:
    """``docs`` with ``n_words, n_hit, n_items, item_ids, items_sha256, contaminated``.

    A word is hit inside any occurrence of ``window`` consecutive words of an item; an item
    of fewer words, but not none, is one window. ``item_ids`` are the ids, as sorted strings,
    of items with occurring windows, and ``items_sha256`` the hash of them joined by commas. Null and
    empty texts have no words. Items with a null id mark words but are not listed; equal ids
    count once. Each row of ``docs`` is judged for itself, also where ids repeat or are null. Columns with
    the names of results are replaced; empty tables give no rows, or rows without hits.
    """
    results = ("n_words", "n_hit", "n_items", "item_ids", "items_sha256", "contaminated")
    docs = docs.drop(*(c for c in docs.columns if c.lower() in results))
    windows = stored(
        _item_windows(
            items.select(F.col(item_id).cast("string").alias("item"), F.col(item_text).alias("text")),
            window, k,
        ),
        "item-windows",
    )
    lengths = sorted(r["length"] for r in windows.select("length").distinct().collect())
    keyed = docs.select(
        F.struct(*named(docs.columns)).alias("doc"), F.monotonically_increasing_id().alias("uid"),
        F.col(text_column).alias("text"),
    )
    rows = stored(
        _with_spans(keyed, "text", lengths, bloom(windows, "fingerprint"), k).drop("text"), "spans"
    )
    key = ["length", "fingerprint", "window"]
    # Windows of the same items share one list, so a document meets it once.
    listed = stored(
        windows.groupBy(*key).agg(F.sort_array(F.collect_set("item")).alias("items"))
        .withColumn("list_id", F.xxhash64("items", F.size("items"))),
        "item-lists",
    )
    spans = rows.where(F.size("spans") > 0).select("uid", F.explode("spans").alias("span")).select(
        "uid", "span.*"
    )
    hits = stored(spans.join(listed.select(*key, "list_id"), key).select("uid", "start", "length", "list_id"), "hits")
    by_place = Window.partitionBy("uid").orderBy("start", "length")
    before = F.coalesce(
        F.max(F.col("start") + F.col("length")).over(by_place.rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0),
    )
    covered = (
        hits.select("uid", "start", "length").distinct()
        .withColumn("new", F.greatest(F.lit(0), F.col("start") + F.col("length") - F.greatest("start", before)))
        .groupBy("uid").agg(F.sum("new").cast("long").alias("n_hit"))
    )
    lists = listed.select("list_id", "items").dropDuplicates(["list_id"])
    found = (
        hits.select("uid", "list_id").distinct().join(lists, "list_id")
        .select("uid", F.explode("items").alias("item")).distinct()
        .groupBy("uid").agg(F.sort_array(F.collect_list("item")).alias("item_ids"))
    )
    ids = F.coalesce("item_ids", F.array().cast("array<string>"))
    return (
        rows.select("uid", "doc", "n_words")
        .join(covered.join(found, "uid", "left"), "uid", "left")
        .select(
            "doc.*", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
            F.size(ids).cast("long").alias("n_items"), ids.alias("item_ids"),
            F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"),
            (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
        )
    )


CONTAMINATION_SQL = r"""
WITH texts AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
item_windows AS (
  SELECT DISTINCT item_id, n, array_to_string(w[s : s + n - 1], ' ') AS g FROM (
    SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS s
    FROM items WHERE len(w) > 0)),
doc_windows AS (
  SELECT doc_id, n, s, array_to_string(w[s : s + n - 1], ' ') AS g FROM (
    SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s
    FROM texts, (SELECT DISTINCT n FROM item_windows) WHERE len(w) >= n)),
hits AS (SELECT * FROM doc_windows SEMI JOIN item_windows USING (n, g)),
covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hits) GROUP BY doc_id),
found AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (
    SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hits JOIN item_windows USING (n, g))
  GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
  coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM texts LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
"""
