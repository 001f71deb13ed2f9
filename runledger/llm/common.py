"""Shared pieces: reading tables, storing intermediate tables, words, bounded Bloom filters."""

from __future__ import annotations

import contextlib
import threading
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runledger.session import scratch_path, ship_package

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x20\x09-\x0D]+"

# Words a worker remembers the hash of before it starts afresh.
_REMEMBERED = 300_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship_package(spark).read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# Folders written for the stage at work in this thread, and for the one before.
_stage = threading.local()


def stored(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` written to the folder all executors share, and read again.

    Cuts the lineage and fixes generated row numbers: later reads, and reads after an
    executor is lost, see the same rows.
    """
    return stored_at(rows, name)[0]


def stored_at(rows: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Like ``stored``, with the folder, for callers that drop it as soon as it has been read."""
    spark = rows.sparkSession
    path = scratch_path(spark, name)
    if getattr(_stage, "open", False):
        _stage.folders.append(path)
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path), path


def drop_folder(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextlib.contextmanager
def stage_scratch(docs: DataFrame) -> Iterator[None]:
    """Around a stage: drops what the stage before in this thread stored for itself.

    Its result has been written and is read as ``docs``. A folder that ``docs`` still reads from stays, so a stage may
    also be put on another one's unwritten result.
    """
    spark = docs.sparkSession
    before = getattr(_stage, "folders", [])
    names = {path: path.rstrip("/").rsplit("/", 1)[1] for path in before}
    in_use = {part for file in docs.inputFiles() for part in file.split("/")} if before else set()
    _stage.folders = [path for path in before if names[path] in in_use]
    for path in before:
        if names[path] not in in_use:
            drop_folder(spark, path)
    _stage.open = True
    try:
        yield
    finally:
        _stage.open = False


def fresh(rows: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``rows`` does not have."""
    taken = {c.lower() for c in rows.columns}
    found = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        found.append(name)
    return found


def named(names: Iterable[str]) -> list[Column]:
    """Columns of these names, whatever characters the names hold."""
    return [F.col("`" + name.replace("`", "``") + "`") for name in names]


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def word_count(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+``; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


class WordHashes(dict):
    """64-bit hash of a word (bytes), remembered for a bounded number of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (the finaliser of splitmix64)."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash for each run of ``n`` words."""
    if len(hashes) < n:
        return np.empty(0, np.uint64)
    size = len(hashes) - n + 1
    total = np.full(size, n, np.uint64)
    for k in range(n):
        total *= np.uint64(0x9E3779B97F4A7C15)
        total += hashes[k : k + size]
    return mixed(total)


# Bloom filters of one fixed size: what is broadcast does not grow with the data. A fuller
# filter only lets more rows through to the exact join behind it.
BLOOM_BITS = 1 << 23
_PROBES = 3


def _probe_bits(values: np.ndarray) -> list[np.ndarray]:
    values = values.astype(np.uint64)
    return [
        (mixed(values + np.uint64(k)) % np.uint64(BLOOM_BITS)).astype(np.int64)
        for k in range(1, _PROBES + 1)
    ]


def bloom(values: DataFrame, column: str) -> np.ndarray:
    """Bits of a filter for a long column; at most ``BLOOM_BITS`` / 8 bytes reach the driver."""
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(BLOOM_BITS, bool)
        for batch in batches:
            for probe in _probe_bits(batch.column(0).to_numpy(zero_copy_only=False)):
                bits[probe] = True
        packed = np.packbits(bits, bitorder="little").view("<i8")
        places = np.flatnonzero(packed)
        yield pa.RecordBatch.from_arrays(
            [pa.array(places), pa.array(packed[places])], ["place", "bits"]
        )

    filled = np.zeros(BLOOM_BITS // 64, np.int64)
    rows = (
        values.select(F.col(column).cast("long")).where(F.col(column).isNotNull())
        .mapInArrow(partial, "place long, bits long")
        .groupBy("place").agg(F.bit_or("bits").alias("bits")).toArrow()
    )
    filled[rows.column("place").to_numpy()] = rows.column("bits").to_numpy()
    return filled.view(np.uint8)


def might_contain(filled: np.ndarray, values: np.ndarray) -> np.ndarray:
    """For each value whether the filter may hold it; never false for one it holds."""
    found = np.ones(len(values), bool)
    for probe in _probe_bits(values):
        found &= (filled[probe >> 3] >> (probe & 7).astype(np.uint8)) & 1 == 1
    return found


def only_likely(rows: DataFrame, column: str, filled: np.ndarray) -> DataFrame:
    """Drops rows that a filter made by ``bloom`` rules out, before they are shuffled."""
    shared = rows.sparkSession.sparkContext.broadcast(filled)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(column).to_numpy(zero_copy_only=False)
            yield batch.filter(pa.array(might_contain(shared.value, values)))

    return rows.mapInArrow(keep, rows.schema)
