"""Near-duplicate documents with HyperMinHash sketches.

A text's word shingles fall into 128 buckets by their hash; each bucket keeps the smallest
hash as six bits of leading zeros and ten bits of mantissa. Four registers fill 64 bits, so
the 32 longs of a sketch are also its 32 band keys. Two sets of similarity 0.8 share no
band with probability 5e-8. Empty buckets of a short text repeat a filled one, found
along a fixed random order of the buckets, so they agree as often as filled ones do.

Texts with equal shingle sets count as one node. Per band key the members meet one hub
each, not each other: the member that shares most keys, which stands in the middle of a
group of copies. Members that end up in one component need no further comparison. What
then still differs within a key is compared in full. Pairs of small keys are listed once; a crowded
key's members outside its hub's component meet all its members in blocks of bounded size, which
give out links only. So no pairs of a group are listed, and no link between components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from runledger.llm.common import (
    WordHashes, bloom, gram_hashes, mixed, named, only_likely, stored,
)
from runledger.llm.components import connected_components

BUCKETS, BANDS = 128, 32
MANTISSA_BITS, MOST_ZEROS = 10, 63

# Six deviations of a similarity estimated from 128 registers, at a similarity of 0.8.
_SLACK = 0.22
# Smaller sets are compared without an estimate.
_FEW = 64
# Members of a band key above which they are compared in blocks, and a block's most members and shingles.
_CROWD = 16
_BLOCK_ROWS, _BLOCK_SHINGLES = 512, 300_000

_ORDERS = np.array([np.random.default_rng(k).permutation(BUCKETS) for k in range(BUCKETS)])
_EDGES = np.arange(BUCKETS, dtype=np.uint64) << np.uint64(57)

_SKETCH = StructType([
    *(StructField(name, LongType()) for name in ("n_shingles", "set_a", "set_b")),
    StructField("bands", ArrayType(LongType())),
])


def shingle_set(text: str | None, n: int, hashes: WordHashes) -> np.ndarray:
    """Sorted hashes of a text's distinct shingles of ``n`` words.

    A text of fewer words has one shingle, the whole; one without words has none.
    """
    found = hashes.of((text or "").encode("utf-8", "surrogatepass").lower().split())
    if not len(found):
        return found
    return np.unique(gram_hashes(found, min(n, len(found))))


def registers(sets: np.ndarray) -> np.ndarray:
    """The 128 registers of a non-empty sorted set of hashes."""
    first = np.searchsorted(sets, _EDGES)
    filled = np.append(first[1:], len(sets)) > first
    # Below the seven bits that choose the bucket; 52 of them, so that floats hold them.
    rest = (sets[np.minimum(first, len(sets) - 1)] << np.uint64(7)) >> np.uint64(12)
    mantissa, exponent = np.frexp(rest.astype(np.float64))
    zeros = np.minimum(52 - exponent, MOST_ZEROS).astype(np.uint16)
    bits = ((mantissa * 2 - 1) * (1 << MANTISSA_BITS)).astype(np.int64).clip(0).astype(np.uint16)
    values = (zeros << np.uint16(MANTISSA_BITS)) | bits
    if not filled.all():
        source = _ORDERS[np.arange(BUCKETS), filled[_ORDERS].argmax(axis=1)]
        values = np.where(filled, values, values[source])
    return values


def chance_collisions(size: int) -> float:
    """Share of registers that two disjoint sets of ``size`` shingles have in common by chance.

    Sums, over leading zeros and mantissas, the chance that both minima fall there.
    """
    zeros = np.arange(0, 52, dtype=np.float64)[:, None]
    step = 2.0 ** -(zeros + 1 + MANTISSA_BITS)
    low = 2.0 ** -(zeros + 1) + np.arange(1 << MANTISSA_BITS)[None, :] * step
    each = size / BUCKETS
    return float(((np.exp(-each * low) - np.exp(-each * (low + step))) ** 2).sum())


# Sets that can be alike differ little in size, so one size stands for both.
_CHANCE = [chance_collisions(1 << k) for k in range(41)]


def estimate(bands_a: Column, bands_b: Column, size: Column) -> Column:
    """Similarity from two sketches: the share of equal registers, less chance collisions."""
    def equal(x: Column, y: Column) -> Column:
        differ = x.bitwiseXOR(y)
        return sum(
            (F.shiftrightunsigned(differ, 16 * k).bitwiseAND(F.lit(0xFFFF)) == 0).cast("int")
            for k in range(4)
        )

    same = F.aggregate(F.zip_with(bands_a, bands_b, equal), F.lit(0), lambda s, x: s + x)
    chance = F.element_at(
        F.array(*map(F.lit, _CHANCE)), F.least(F.ceil(F.log2(size)), F.lit(40)).cast("int") + 1
    )
    return (same / F.lit(BUCKETS) - chance) / (1 - chance)


def sketched(docs: DataFrame, text: str, n: int) -> DataFrame:
    """``docs`` with set size, 128 bits that name the set, and the sketch as band keys."""
    schema = StructType([*docs.schema.fields, *_SKETCH.fields])

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            sizes, names_a, names_b, bands = [], [], [], []
            for value in batch.column(text):
                found = shingle_set(value.as_py(), n, hashes)
                sizes.append(len(found))
                names_a.append(int(found.sum(dtype=np.uint64).view(np.int64)))
                names_b.append(int(mixed(found).sum(dtype=np.uint64).view(np.int64)))
                bands.append(registers(found).view(np.int64) if len(found) else None)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(sizes, pa.int64()), pa.array(names_a, pa.int64()),
                 pa.array(names_b, pa.int64()), pa.array(bands, pa.list_(pa.int64()))],
                [*batch.schema.names, "n_shingles", "set_a", "set_b", "bands"],
            )

    return docs.mapInArrow(sketch, schema)


def _alike(size_a: Column, size_b: Column, percent: int) -> Column:
    return 100 * F.least(size_a, size_b) >= percent * F.greatest(size_a, size_b)


def _verified(
    pairs: DataFrame, nodes: DataFrame, texts: DataFrame, n: int, percent: int
) -> DataFrame | None:
    """Those of ``pairs(a, b)`` whose whole shingle sets are similar enough; None for none."""
    sketches = nodes.select("node", "n_shingles", "bands")

    def end(name: str) -> DataFrame:
        return sketches.select(*(F.col(c).alias(f"{name}_{c}") for c in sketches.columns))

    likely = (
        pairs.join(end("a"), F.col("a") == F.col("a_node"))
        .join(end("b"), F.col("b") == F.col("b_node"))
        .where(_alike(F.col("a_n_shingles"), F.col("b_n_shingles"), percent))
        .where(
            (F.least("a_n_shingles", "b_n_shingles") < _FEW)
            | (
                estimate(F.col("a_bands"), F.col("b_bands"), F.least("a_n_shingles", "b_n_shingles"))
                >= percent / 100 - _SLACK
            )
        )
        .select("a", "b")
    )
    likely = stored(likely, "likely-pairs")
    if not likely.limit(1).count():
        return None
    wanted = likely.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    texts = only_likely(texts, "node", bloom(wanted, "node")).join(wanted, "node", "left_semi")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, last = WordHashes(), (None, None)
        for batch in batches:
            keep = []
            for a, text_a, text_b in zip(
                batch.column("a").to_pylist(), batch.column("text_a"), batch.column("text_b")
            ):
                if a != last[0]:
                    last = (a, shingle_set(text_a.as_py(), n, hashes))
                other = shingle_set(text_b.as_py(), n, hashes)
                shared = len(np.intersect1d(last[1], other, assume_unique=True))
                keep.append(100 * shared >= percent * (len(last[1]) + len(other) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    checked = (
        likely.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
        .join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
        .select("a", "b", "text_a", "text_b")
        .mapInArrow(check, "a long, b long")
    )
    return stored(checked, "links")


def _labelled(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Members of keys that still hold more than one component."""
    if labels is None:
        return members.withColumn("component", F.col("node"))
    known = members.join(labels, "node", "left").withColumn(
        "component", F.coalesce("component", "node")
    )
    mixed_keys = (
        known.groupBy("key", "band")
        .agg(F.min("component").alias("low"), F.max("component").alias("high"))
        .where("low < high").select("key", "band")
    )
    return known.join(mixed_keys, ["key", "band"], "left_semi")


def _hubs(members: DataFrame) -> DataFrame:
    """``key, band, hub, size``: the hub is the member that shares most keys with others."""
    first = F.struct((-F.col("popular")).alias("first"), "node", "component")
    return members.groupBy("key", "band").agg(F.min(first).alias("hub"), F.count("*").alias("size"))


def _hub_pairs(members: DataFrame) -> DataFrame:
    """Each member with the hub of its key, where their components differ."""
    return (
        members.join(_hubs(members), ["key", "band"])
        .where("component <> hub.component")
        .select(F.col("hub.node").alias("a"), F.col("node").alias("b")).distinct()
    )


def _small_pairs(members: DataFrame, percent: int) -> DataFrame:
    """All pairs of a key with few members whose components differ."""
    def side(name: str) -> DataFrame:
        return members.select(
            "key", "band", F.col("node").alias(name), F.col("component").alias(f"c{name}"),
            F.col("n_shingles").alias(f"n{name}"),
        )

    return (
        side("a").join(side("b"), ["key", "band"])
        .where((F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")))
        .where(_alike(F.col("na"), F.col("nb"), percent))
        .select("a", "b").distinct()
    )


def _crowd_links(crowd: DataFrame, nodes: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """Links between components within ``crowd(hub, middle, node, component, n_shingles)``.

    Members outside the hub's component, ``middle``, meet all members of the hub, block by
    block. A task holds two blocks and gives out verified links.
    """
    sizes = crowd.groupBy("hub").agg(
        F.greatest(
            F.ceil(F.count("*") / _BLOCK_ROWS), F.ceil(F.sum("n_shingles") / _BLOCK_SHINGLES)
        ).alias("blocks")
    )
    placed = crowd.join(sizes, "hub").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    outside = F.col("component") != F.col("middle")
    queries = placed.where(outside).select("hub", "node", "component", F.col("block").alias("x"), every.alias("y"), F.lit(True).alias("asks"))
    asked = queries.select("hub", "x").distinct()
    others = placed.select("hub", "node", "component", F.col("block").alias("y")).join(asked, "hub").select(
        "hub", "node", "component", "x", "y", F.lit(False).alias("asks")
    )
    wanted = crowd.select("node").distinct()
    sets = only_likely(texts, "node", bloom(wanted, "node")).join(wanted, "node", "left_semi")
    tasks = (
        queries.unionByName(others).join(nodes.select("node", "bands"), "node").join(sets, "node")
        .select("hub", "x", "y", "asks", "node", "component", "bands", "text")
    )

    def meet(table: pa.Table) -> pa.Table:
        hashes = WordHashes()
        asks = np.array(table.column("asks").to_pylist(), bool)
        node, component = (table.column(c).to_numpy() for c in ("node", "component"))
        found = [shingle_set(t.as_py(), n, hashes) for t in table.column("text")]
        size = np.array([len(x) for x in found])
        marks = np.array(table.column("bands").to_pylist(), np.int64).view(np.uint16).reshape(-1, BUCKETS)
        links = []
        right = np.flatnonzero(~asks)
        for k in np.flatnonzero(asks):
            near = right[component[right] != component[k]]
            low, high = np.minimum(size[near], size[k]), np.maximum(size[near], size[k])
            near = near[100 * low >= percent * high]
            same = (marks[near] == marks[k]).sum(axis=1) / BUCKETS
            chance = _CHANCE[min(40, int(max(1, size[k])).bit_length())]
            likely = ((same - chance) / (1 - chance) >= percent / 100 - _SLACK) | (np.minimum(size[near], size[k]) < _FEW)
            for other in near[likely]:
                shared = len(np.intersect1d(found[k], found[other], assume_unique=True))
                if 100 * shared >= percent * (size[k] + size[other] - shared):
                    links.append((int(node[k]), int(node[other])))
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    return tasks.groupBy("hub", "x", "y").applyInArrow(meet, "a long, b long")


def linked_sets(nodes: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """``node, component`` for nodes with a link.

    ``nodes(node, n_shingles, bands)`` has a row for each set, ``texts(node, text)`` at least its text.
    """
    exploded = nodes.select("node", "n_shingles", F.posexplode("bands").alias("band", "key"))
    keys = ["key", "band"]
    shared = exploded.groupBy(*keys).agg(F.count("*").alias("size")).where("size > 1")
    repeated = stored(exploded.join(shared, keys), "band-members")
    popular = repeated.groupBy("node").agg(F.sum("size").alias("popular"))
    members = stored(repeated.drop("size").join(popular, "node"), "popular-members")
    links, labels = None, None

    def joined(found: DataFrame | None) -> None:
        nonlocal links, labels
        if found is not None:
            links = found if links is None else links.unionByName(found)
            labels = connected_components(links)

    alone = members.withColumn("component", F.col("node"))
    joined(_verified(_hub_pairs(alone), nodes, texts, n, percent))
    left = stored(_labelled(members, labels), "open-members")
    sized = stored(left.join(_hubs(left), keys), "open-keys")
    few = sized.where(F.col("size") <= _CROWD).select(left.columns)
    found = _verified(_small_pairs(few, percent), nodes, texts, n, percent)
    crowd = stored(
        sized.where(F.col("size") > _CROWD).select(
            F.col("hub.node").alias("hub"), F.col("hub.component").alias("middle"), "node", "component", "n_shingles"
        ).distinct(),
        "crowded-members",
    )
    if crowd.limit(1).count():
        more = stored(_crowd_links(crowd, nodes, texts, n, percent), "crowd-links")
        found = more if found is None else found.unionByName(more)
    joined(found)
    if labels is None:
        labels = members.select("node", F.col("node").alias("component")).limit(0)
    return labels


def near_duplicates(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
    n: int = 5, percent: int = 80,
) -> DataFrame:
    """``docs`` with ``n_shingles``, ``component_id``, ``kept`` and ``keeper``.

    Documents are linked where ``percent`` of their united shingles are shared.
    ``component_id`` is the smallest id reachable, the own included; ``kept`` says that it is
    the own; ``keeper`` marks one row of each component, also where ids repeat or are null.
    Null and empty texts have no shingles and no links. Rows with a null id take part; a
    component of such rows only has a null ``component_id`` and ``kept`` is false. Columns of ``docs`` with the
    names of results are replaced; an empty table gives no rows.
    """
    results = ("n_shingles", "component_id", "kept", "keeper")
    docs = docs.drop(*(c for c in docs.columns if c.lower() in results))
    keyed = docs.select(
        F.struct(*named(docs.columns)).alias("doc"), F.monotonically_increasing_id().alias("uid"),
        F.col(text_column).alias("text"),
    )
    rows = stored(sketched(keyed, "text", n).drop("text"), "sketches")
    rows = rows.withColumn("id", F.col("doc")[id_column])
    # One row for each different set stands for all copies.
    sets = rows.where("n_shingles > 0").groupBy("set_a", "set_b", "n_shingles").agg(
        F.min("uid").alias("node")
    )
    sets = stored(sets, "sets")
    nodes = stored(
        rows.select(F.col("uid").alias("node"), "n_shingles", "bands")
        .join(sets.select("node"), "node", "left_semi"),
        "set-sketches",
    )
    texts = rows.select(F.col("uid").alias("node"), F.col("doc")[text_column].alias("text"))
    labels = linked_sets(nodes, texts, n, percent)
    classes = sets.join(labels, "node", "left").select(
        "set_a", "set_b", "n_shingles", F.coalesce("component", "node").alias("class")
    )
    narrow = rows.select("uid", "id", "set_a", "set_b", "n_shingles").join(
        classes, ["set_a", "set_b", "n_shingles"], "left"
    ).select("uid", "id", "n_shingles", F.coalesce("class", "uid").alias("class"))
    first = narrow.groupBy("class").agg(
        F.min("id").alias("component_id"),
        F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "uid")).alias("first"),
    )
    verdicts = narrow.join(first, "class").select(
        "uid", "n_shingles", "component_id",
        F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"),
        (F.col("uid") == F.col("first.uid")).alias("keeper"),
    )
    return rows.select("uid", "doc").join(verdicts, "uid").select(
        "doc.*", "n_shingles", "component_id", "kept", "keeper"
    )
