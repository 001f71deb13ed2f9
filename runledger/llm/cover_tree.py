"""Vectors of high cosine, found exactly by a dual traversal of cover trees.

On unit vectors a cosine of ``least`` or more is a distance of at most t. The top of the tree is a farthest-first net
over a bounded sample; each vector goes to its nearest centre's cell, and a cell's covering radius is measured over all its vectors.
Below, blocks of a cell grow the lower levels, whose radii halve from 2 t to t / 2. Vectors within t / 2 of a centre
link with each other, so they become one node with a weight: a large group of copies shrinks to a node per block.

Pairs of blocks are traversed from the upper levels down. A pair of nodes further apart than t and both radii is
dropped with all below it; a pair of lowest nodes nearer than t less both radii links as a whole and is only
counted; what is left undecided is compared vector by vector. Links are counted and spanning edges given out, never pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from runledger.llm.common import mixed, named, stored
from runledger.llm.components import connected_components

# Distances closer to a bound than this are left to the comparison of vectors.
_SLIP = 1e-6
# Rows of a matrix of similarities made at once.
_STRIP = 256
_MOST_TASKS = 20_000


class Cell(NamedTuple):
    """A child of the top: its centre (None where no sampled vector has its length), radius and blocks."""

    dims: int
    centre: np.ndarray | None
    radius: float
    blocks: int


def units(blobs: list[bytes], kind: str) -> np.ndarray:
    """Unit vectors, one per row, in double precision."""
    rows = np.frombuffer(b"".join(blobs), kind).reshape(len(blobs), -1).astype(np.float64)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def distances(cosines: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * cosines, 0))


def farthest_first(rows: np.ndarray, count: int) -> np.ndarray:
    """Up to ``count`` rows, each the farthest from those before: a net at every radius."""
    chosen, nearest = [0], distances(rows @ rows[0])
    while len(chosen) < min(count, len(rows)):
        far = int(nearest.argmax())
        if nearest[far] <= _SLIP:
            break
        chosen.append(far)
        nearest = np.minimum(nearest, distances(rows @ rows[far]))
    return rows[chosen]


def net(rows: np.ndarray, crowded: np.ndarray, radius: float) -> np.ndarray:
    """For each row the place of its centre, at most ``radius`` away; only ``crowded`` rows have neighbours."""
    centre = np.arange(len(rows))
    left = np.flatnonzero(crowded)
    least = 1 - radius * radius / 2 + _SLIP
    while len(left):
        near = rows[left] @ rows[left[0]] >= least
        near[0] = True
        centre[left[near]] = left[0]
        left = left[~near]
    return centre


def levels_of(rows: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centres of each row at the radii ``reach / 2``, ``reach`` and ``2 reach``, nested."""
    radii = np.array([reach / 2, reach, 2 * reach])
    crowded = np.zeros((3, len(rows)), bool)
    for k in range(0, len(rows), _STRIP):
        cosines = rows[k : k + _STRIP] @ rows.T
        for row, radius in zip(crowded, radii):
            row[k : k + _STRIP] = (cosines >= 1 - radius * radius / 2).sum(axis=1) > 1
    low = net(rows, crowded[0], radii[0])
    found = [low]
    for row, radius in zip(crowded[1:], radii[1:]):
        below = np.unique(found[-1])
        above = below[net(rows[below], row[below], radius)]
        found.append(above[np.searchsorted(below, found[-1])])
    return found[0], found[1], found[2]


class Tree:
    """The nodes of a block and the balls around them, level by level from the lowest."""

    def __init__(self, rows: np.ndarray, radius: np.ndarray, labels: list[np.ndarray]):
        self.rows, self.radius = [rows], [radius]
        self.below: list[list[np.ndarray]] = [[]]
        for label in labels:
            names, first, parent = np.unique(label, return_index=True, return_inverse=True)
            if 2 * len(names) > len(self.rows[-1]):  # hardly fewer balls: a level without use
                continue
            # Levels are told by the lowest nodes' labels; those of the level before come from its first nodes.
            if len(self.rows) > 1:
                parent = parent[self.first]
            order = np.argsort(parent, kind="stable")
            cuts = np.searchsorted(parent[order], np.arange(1, len(names)))
            centre = rows[first]
            away = distances(np.einsum("ij,ij->i", self.rows[-1], centre[parent])) + self.radius[-1] + _SLIP
            reach = np.zeros(len(names))
            np.maximum.at(reach, parent, away)
            self.below.append(np.split(order, cuts))
            self.rows.append(centre)
            self.radius.append(reach)
            self.first = first

    @property
    def top(self) -> int:
        return len(self.rows) - 1


def near_pairs(a: Tree, b: Tree, reach: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Lowest nodes of ``a`` and ``b`` whose balls come within ``reach`` and their cosines, in strips."""
    # The places on the side of ``b`` ascend, so all of them are its rows as they stand.
    stack = [(a.top, np.arange(len(a.rows[-1])), b.top, np.arange(len(b.rows[-1])))]
    while stack:
        level_a, ours, level_b, theirs = stack.pop()
        if len(ours) > _STRIP:
            stack += [(level_a, ours[k : k + _STRIP], level_b, theirs) for k in range(0, len(ours), _STRIP)]
            continue
        other = b.rows[level_b]
        cosines = a.rows[level_a][ours] @ (other if len(theirs) == len(other) else other[theirs]).T
        wide_a, wide_b = a.radius[level_a][ours], b.radius[level_b][theirs]
        far = reach + wide_a.max() + wide_b.max() + _SLIP
        x, y = np.nonzero(cosines >= 1 - far * far / 2) if far < 2 else np.indices(cosines.shape).reshape(2, -1)
        found = cosines[x, y]
        meet = distances(found) <= reach + wide_a[x] + wide_b[y] + _SLIP
        x, y, found = x[meet], y[meet], found[meet]
        if not len(x):
            continue
        if not level_a and not level_b:
            yield ours[x], theirs[y], found
            continue
        cuts = np.flatnonzero(np.diff(x)) + 1
        for i, js in zip(x[np.append(0, cuts)], np.split(y, cuts)):
            down = a.below[level_a][ours[i]] if level_a else ours[i : i + 1]
            under = np.sort(np.concatenate([b.below[level_b][j] for j in theirs[js]])) if level_b else theirs[js]
            stack.append((max(level_a - 1, 0), down, max(level_b - 1, 0), under))


def united(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Gives linked places one label, the smallest of their component so far."""
    while len(a):
        ra, rb = labels[a], labels[b]
        differ = ra != rb
        if not differ.any():
            return
        a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
        np.minimum.at(labels, np.maximum(ra, rb), np.minimum(ra, rb))
        while (labels[labels] != labels).any():
            labels[:] = labels[labels]


def _prepared(vectors: DataFrame, id_column: str, vector_column: str) -> tuple[DataFrame, str]:
    """``row, id, dims, blob`` of each vector, the last two null where it cannot link; and the number type."""
    element = getattr(vectors.schema[vector_column].dataType, "elementType", None)
    kind, wide = ("<f4", "float") if isinstance(element, FloatType) else ("<f8", "double")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("vector")
            values = column.values.to_numpy(zero_copy_only=False)
            sound = np.isfinite(values)
            ends = column.offsets.to_numpy()
            blobs: list[bytes | None] = []
            for null, i, j in zip(column.is_null().to_pylist(), ends[:-1].tolist(), ends[1:].tolist()):
                good = not null and i < j and sound[i:j].all() and values[i:j].any()
                blobs.append(values[i:j].astype(kind).tobytes() if good else None)
            size = np.dtype(kind).itemsize
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("id"),
                 pa.array([b and len(b) // size for b in blobs], pa.int32()), pa.array(blobs, pa.binary())],
                ["row", "id", "dims", "blob"],
            )

    row_id, vector = named([id_column, vector_column])
    rows = vectors.select(
        F.monotonically_increasing_id().alias("row"), row_id.alias("id"), vector.cast(f"array<{wide}>").alias("vector")
    )
    ids = vectors.schema[id_column].dataType.simpleString()
    return stored(rows.mapInArrow(pack, f"row long, id {ids}, dims int, blob binary"), "vectors"), kind


def _split(rows: np.ndarray, blocks: int) -> np.ndarray:
    """The block, of so many, of each row number."""
    return (mixed(rows.astype(np.uint64)) % np.uint64(blocks)).astype(np.int64)


def near_vectors(
    vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", least: float = 0.9,
    block_rows: int = 8192, sample_rows: int = 4096, most_cells: int = 1024,
) -> DataFrame:
    """``id_column, n_links, component_id, kept`` of each row.

    Two rows link if their cosine, in double precision, is ``least`` or more. ``n_links`` counts the other rows that
    a row links with; ``component_id`` is the smallest id reachable by links, its own included; ``kept`` says
    that the two are equal. Exact at any setting: ``sample_rows`` vectors place up to ``most_cells`` centres,
    which only decides how much is compared; blocks of about ``block_rows`` vectors are compared at a time.

    Vectors that are null, empty, zero or hold null or non-finite numbers link with nothing, nor do vectors of
    different lengths. Repeated rows and equal ids are rows of their own and link like others; a
    null id is no smallest id unless a component has no other. Other columns are left out; an empty table gives no rows.
    """
    reach = float(np.sqrt(2 - 2 * least))
    rows, kind = _prepared(vectors, id_column, vector_column)
    sound = rows.where("dims IS NOT NULL")
    sample = sound.orderBy(F.xxhash64("row")).limit(sample_rows).select("dims", "blob").toArrow().to_pylist()
    centres: dict[int, np.ndarray] = {}
    for dims, count in sound.groupBy("dims").count().collect():
        if own := [r["blob"] for r in sample if r["dims"] == dims]:
            centres[dims] = farthest_first(units(own, kind), min(most_cells, -(-count // block_rows)))
    starts = dict(zip(centres, np.cumsum([0, *map(len, centres.values())]).tolist()))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dims").to_numpy()
            cells, away = -dims.astype(np.int64), np.zeros(len(dims))
            for d in np.unique(dims).tolist():
                if d in centres:
                    own = np.flatnonzero(dims == d)
                    cosines = units(batch.column("blob").take(pa.array(own)).to_pylist(), kind) @ centres[d].T
                    cells[own] = starts[d] + cosines.argmax(axis=1)
                    away[own] = distances(cosines.max(axis=1))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cells), pa.array(away)], [*batch.schema.names, "cell", "away"]
            )

    ids = rows.schema["id"].dataType.simpleString()
    assigned = sound.mapInArrow(assign, f"row long, id {ids}, dims int, blob binary, cell long, away double")
    cells: dict[int, Cell] = {}
    for cell, dims, count, away in (
        assigned.groupBy("cell", "dims").agg(F.count("*"), F.max("away")).collect()
    ):
        centre = centres[dims][cell - starts[dims]] if dims in centres else None
        cells[cell] = Cell(dims, centre, away, -(-count // block_rows))

    def blocked(of: dict[int, Cell], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = np.array([of[c].blocks for c in batch.column("cell").to_pylist()], np.uint64)
            numbers = batch.column("row").to_numpy().astype(np.uint64)
            block = (mixed(numbers) % counts).astype(np.int64) if len(numbers) else numbers.astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(block)], [*batch.schema.names, "block"])

    def grown(table: pa.Table) -> pa.Table:
        """The lower levels of a block."""
        own = units(table.column("blob").to_pylist(), kind)
        numbers = table.column("row").to_numpy()
        low, middle, high = levels_of(own, reach)
        radius = distances(np.einsum("ij,ij->i", own, own[low]))
        radius[low == np.arange(len(low))] = 0
        wide = np.zeros(len(low))
        np.maximum.at(wide, low, radius)
        weight = np.bincount(low, minlength=len(low))
        return pa.table({
            "row": numbers, "id": table.column("id"), "cell": table.column("cell"), "blob": table.column("blob"),
            "node": numbers[low], "radius": wide, "weight": weight, "middle": numbers[middle], "high": numbers[high],
        })

    tasks = max(1, min(_MOST_TASKS, sum(c.blocks for c in cells.values())))
    placed = stored(
        assigned.mapInArrow(
            lambda batches: blocked(cells, batches),
            f"row long, id {ids}, dims int, blob binary, cell long, away double, block long",
        )
        .repartition(tasks, "cell", "block").groupBy("cell", "block")
        .applyInArrow(grown, f"row long, id {ids}, cell long, blob binary, node long, radius double, "
                             "weight long, middle long, high long"),
        "cover-tree",
    )
    nodes = placed.where("row = node").select("row", "cell", "blob", "radius", "weight", "middle", "high")
    fewer = {
        cell: cells[cell]._replace(blocks=-(-count // block_rows))
        for cell, count in nodes.groupBy("cell").count().collect()
    }
    found = _traversed(nodes, fewer, kind, reach, least)
    finer = _compared(found.where("kind = 'open'").select("a", "b"), placed, kind, least)

    components = connected_components(
        found.where("kind = 'edge'").select("a", "b").unionByName(finer.where("kind = 'edge'").select("a", "b"))
    )
    bulk = found.where("kind = 'count'").groupBy(F.col("a").alias("node")).agg(F.sum("b").alias("more"))
    single = finer.where("kind = 'count'").groupBy(F.col("a").alias("row")).agg(F.sum("b").alias("few"))
    of_node = (
        nodes.select(F.col("row").alias("node"), "weight").join(bulk, "node", "left").join(components, "node", "left")
        .select(
            "node", (F.col("weight") - 1 + F.coalesce("more", F.lit(0))).alias("more"),
            F.coalesce("component", "node").alias("component"),
        )
    )
    linked = placed.select("row", "id", "node").join(of_node, "node").join(single, "row", "left").select(
        "id", "component", (F.col("more") + F.coalesce("few", F.lit(0))).alias("n_links")
    )
    smallest = linked.groupBy("component").agg(F.min("id").alias("component_id"))
    alone = rows.where("dims IS NULL").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return (
        linked.join(smallest, "component").select("id", "n_links", "component_id").unionByName(alone)
        .select(
            F.col("id").alias(id_column), "n_links", "component_id",
            F.col("id").eqNullSafe(F.col("component_id")).alias("kept"),
        )
    )


def _traversed(nodes: DataFrame, cells: dict[int, Cell], kind: str, reach: float, least: float) -> DataFrame:
    """Rows ``kind, a, b``: links of node a (count), spanning edges (edge), undecided pairs (open).

    Cells are numbered blocks; a node is sent to the pairs of its own block with the blocks it may have links in: those of
    cells whose ball, or whose side of the border between both cells, comes within ``reach`` of the node's ball.
    """
    first = dict(zip(cells, np.cumsum([0, *(c.blocks for c in cells.values())]).tolist()))
    total = sum(c.blocks for c in cells.values())
    spans = {cell: np.arange(first[cell], first[cell] + c.blocks) for cell, c in cells.items()}
    alike: dict[int, list[int]] = {}
    for cell, c in cells.items():
        if c.centre is not None:
            alike.setdefault(c.dims, []).append(cell)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own_cells = batch.column("cell").to_numpy()
            numbers, radius = batch.column("row").to_numpy(), batch.column("radius").to_numpy()
            for cell in np.unique(own_cells).tolist():
                c = cells[cell]
                here = np.flatnonzero(own_cells == cell)
                part = batch.take(pa.array(here))
                block = first[cell] + _split(numbers[here], c.blocks)
                others = alike[c.dims] if c.centre is not None else [cell]
                if c.centre is not None:
                    away = distances(
                        units(part.column("blob").to_pylist(), kind) @ np.array([cells[o].centre for o in others]).T
                    )
                    own_away = away[:, others.index(cell)]
                for k, other in enumerate(others):
                    if other == cell:
                        chosen = np.arange(len(here))
                    else:
                        wide = radius[here]
                        chosen = np.flatnonzero(
                            (away[:, k] <= wide + cells[other].radius + reach + _SLIP)
                            & (away[:, k] <= own_away + 2 * (wide + reach) + _SLIP)
                        )
                    if not len(chosen):
                        continue
                    sent = part.take(pa.array(chosen))
                    mine = block[chosen]
                    for target in spans[other].tolist():
                        low, high = np.minimum(mine, target), np.maximum(mine, target)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(low * total + high), pa.array(mine != low), *sent.columns],
                            ["tile", "side", *sent.schema.names],
                        )

    def tree(table: pa.Table) -> Tree:
        return Tree(
            units(table.column("blob").to_pylist(), kind), table.column("radius").to_numpy(),
            [table.column("middle").to_numpy(), table.column("high").to_numpy()],
        )

    def traverse(table: pa.Table) -> pa.Table:
        tile = table.column("tile")[0].as_py()
        within = tile // total == tile % total
        side = table.column("side").to_numpy(zero_copy_only=False).astype(bool)
        parts = [table] if within else [table.filter(pa.array(~side)), table.filter(pa.array(side))]
        kinds, ends_a, ends_b = [], [], []

        def give(name: str, a: np.ndarray, b: np.ndarray) -> None:
            kinds.extend([name] * len(a))
            ends_a.append(a)
            ends_b.append(b)

        if len(parts[-1]) and len(parts[0]):
            trees = [tree(p) for p in parts]
            numbers = np.concatenate([p.column("row").to_numpy() for p in parts])
            radius = np.concatenate([t.radius[0] for t in trees])
            weight = np.concatenate([p.column("weight").to_numpy() for p in parts])
            shift = 0 if within else len(parts[0])
            labels = np.arange(len(numbers))
            links = np.zeros(len(numbers), np.int64)
            for a, b, cosines in near_pairs(trees[0], trees[-1], reach):
                b = b + shift
                if within:
                    once = a < b
                    a, b, cosines = a[once], b[once], cosines[once]
                wide = radius[a] + radius[b]
                points = wide == 0
                sure = np.where(points, cosines >= least, distances(cosines) + wide <= reach - _SLIP)
                open_ = ~points & ~sure
                give("open", numbers[a[open_]], numbers[b[open_]])
                a, b = a[sure], b[sure]
                np.add.at(links, a, weight[b])
                np.add.at(links, b, weight[a])
                united(labels, a, b)
            some = np.flatnonzero(links)
            give("count", numbers[some], links[some])
            moved = np.flatnonzero(labels != np.arange(len(labels)))
            give("edge", numbers[moved], numbers[labels[moved]])
        empty = np.empty(0, np.int64)
        return pa.table({
            "kind": pa.array(kinds, pa.string()), "a": np.concatenate([empty, *ends_a]),
            "b": np.concatenate([empty, *ends_b]),
        })

    sent = nodes.mapInArrow(
        send, "tile long, side boolean, row long, cell long, blob binary, radius double, weight long, middle long, high long"
    )
    tasks = max(1, min(_MOST_TASKS, total * (total + 1) // 2))
    return stored(
        sent.repartition(tasks, "tile").groupBy("tile").applyInArrow(traverse, "kind string, a long, b long"),
        "cover-links",
    )


def _compared(pairs: DataFrame, placed: DataFrame, kind: str, least: float) -> DataFrame:
    """Rows ``kind, a, b`` of undecided pairs of nodes: links of row a (count), linked nodes (edge)."""
    members = placed.select(F.col("node").alias("of"), "row", "blob")

    def end(name: str) -> DataFrame:
        return pairs.join(members, pairs[name] == F.col("of")).select("a", "b", F.lit(name).alias("end"), "row", "blob")

    def match(table: pa.Table) -> pa.Table:
        ends = np.array(table.column("end").to_pylist())
        numbers = table.column("row").to_numpy()
        own = units(table.column("blob").to_pylist(), kind)
        ours, theirs = np.flatnonzero(ends == "a"), np.flatnonzero(ends == "b")
        links = np.zeros(len(own), np.int64)
        for k in range(0, len(ours), _STRIP):
            near = own[ours[k : k + _STRIP]] @ own[theirs].T >= least
            links[ours[k : k + _STRIP]] = near.sum(axis=1)
            links[theirs] += near.sum(axis=0)
        some = np.flatnonzero(links)
        edge = [table.column(c)[0].as_py() for c in ("a", "b")] if len(some) else []
        return pa.table({
            "kind": pa.array(["count"] * len(some) + ["edge"] * bool(edge), pa.string()),
            "a": np.concatenate([numbers[some], np.array(edge[:1], np.int64)]),
            "b": np.concatenate([links[some], np.array(edge[1:], np.int64)]),
        })

    return stored(
        end("a").unionByName(end("b")).groupBy("a", "b").applyInArrow(match, "kind string, a long, b long"),
        "vector-links",
    )


VECTORS_SQL = """
WITH RECURSIVE sound AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM sound a JOIN sound b
    ON len(a.v) = len(b.v) AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.9),
reached AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT reached.a, links.b FROM reached JOIN links ON reached.b = links.a)
SELECT vec_id, (SELECT count(*) FROM links WHERE links.a = vec_id) AS n_links, min(b) AS component_id,
  vec_id = min(b) AS kept
FROM embeddings JOIN reached ON vec_id = reached.a GROUP BY vec_id
"""
