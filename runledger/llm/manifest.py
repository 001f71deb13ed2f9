"""A Merkle manifest of a table: each row's digest, the tree's roots and each row's witness.

Leaves of a group stand in order; every ``FAN`` of them become one node, level by level, and the groups'
roots form one more tree. Leaves are numbered over all tasks and cut into aligned blocks of ``FAN ** LEVELS``. A
block is appended to leaf by leaf: a run of nodes that is still open holds its leaves with
their partial witnesses, and each run that closes extends the witnesses of all leaves below it. The roots of blocks
are appended to trees in the same way, so no task holds more than a block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from runledger.llm.common import LOWER, UPPER, named, stored
from runledger.llm.periodic import CRC_SQL

FAN, LEVELS = 8, 4
_BLOCK = FAN**LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_PATH = "array<struct<before: string, after: string>>"
_PATH_ARROW = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))

Siblings = tuple[str, str]


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_digest(*values: Column) -> Column:
    """Digest of values, each ``-`` if null, else its UTF-8 length, a colon and the value."""
    def framed(value: Column) -> Column:
        text = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*map(framed, values)).cast("binary"), 256)


def height(leaves: int) -> int:
    """Levels of a tree above its leaves."""
    levels = 0
    while leaves > 1:
        leaves, levels = -(-leaves // FAN), levels + 1
    return levels


class Appender:
    """An aligned tree of ``levels`` levels that grows by a leaf at a time."""

    def __init__(self, levels: int):
        self.levels = levels
        self.open: list[list[tuple[str, list[int]]]] = [[] for _ in range(levels + 1)]
        self.witnesses: list[list[Siblings]] = []

    def append(self, leaf: str) -> None:
        self.witnesses.append([])
        self._place(0, leaf, [len(self.witnesses) - 1])

    def _place(self, level: int, node: str, below: list[int]) -> None:
        while True:
            run = self.open[level]
            run.append((node, below))
            if level == self.levels or len(run) < FAN:
                return
            node, below = self._close(level)
            level += 1

    def _close(self, level: int) -> tuple[str, list[int]]:
        """Turns an open run into its node and extends the witnesses of the leaves below."""
        run, self.open[level] = self.open[level], []
        nodes, covered = [node for node, _ in run], []
        for k, (_, below) in enumerate(run):
            siblings = "".join(nodes[:k]), "".join(nodes[k + 1 :])
            for leaf in below:
                self.witnesses[leaf].append(siblings)
            covered += below
        return digest("".join(nodes)), covered

    def root(self) -> str:
        """The root, once no leaf follows."""
        for level in range(self.levels):
            if self.open[level]:
                self._place(level + 1, *self._close(level))
        return self.open[self.levels][0][0]


def appended(nodes: list[str], total: int) -> Appender:
    """One block of a tree of ``total`` leaves."""
    tree = Appender(min(LEVELS, height(total)))
    for node in nodes:
        tree.append(node)
    return tree


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``pos`` within their ``grp`` by the columns ``order``, and the group's ``total``.

    Rows are sorted by ranges over all groups, numbered in each range, and shifted by the sizes of the
    ranges before. Nulls come first; rows equal in all of it are told apart by a row number.
    """
    schema = StructType([*rows.schema.fields, StructField("part", LongType()), StructField("place", LongType())])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, count = None, 0
        for batch in batches:
            places = []
            for name in batch.column("grp").to_pylist():
                last, count = name, count + 1 if name == last else 0
                places.append(count)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(places, pa.int64())], [*batch.schema.names, "place"]
            )

    keys = [F.col(c).asc_nulls_first() for c in ("grp", *order, "tie")]
    ranged = (
        stored(rows.withColumn("tie", F.monotonically_increasing_id()), "merkle-leaves")
        .repartitionByRange(*keys).sortWithinPartitions(*keys).drop("tie")
        .withColumn("part", F.spark_partition_id().cast("long"))
    )
    placed = stored(ranged.mapInArrow(number, schema), "merkle-order")
    by_part = Window.partitionBy("grp").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = placed.groupBy("grp", "part").agg(F.count("*").alias("rows")).select(
        "grp", "part", F.coalesce(F.sum("rows").over(by_part), F.lit(0)).alias("shift"),
        F.sum("rows").over(Window.partitionBy("grp")).alias("total"),
    )
    return placed.join(shifts, ["grp", "part"]).withColumn("pos", F.col("shift") + F.col("place")).drop(
        "part", "place", "shift"
    )


def witnessed(nodes: DataFrame, beyond: Callable[[DataFrame], DataFrame] = lambda above: above) -> DataFrame:
    """``nodes(grp, pos, total, node, ...)`` with ``path``, their siblings up to the root, and ``top``, the root.

    ``beyond`` may add to the ``path`` of blocks and replace ``top`` before it is handed down. ``total`` is dropped.
    """
    cut = nodes.withColumn("block", F.expr(f"pos div {_BLOCK}"))

    def in_order(table: pa.Table) -> pa.Table:
        return table.take(pc.sort_indices(table.column("pos")))

    def roots(table: pa.Table) -> pa.Table:
        table = in_order(table)
        total = table.column("total")[0].as_py()
        tree = appended(table.column("node").to_pylist(), total)
        return pa.table({
            "grp": table.column("grp")[:1], "pos": table.column("block")[:1],
            "total": pa.array([-(-total // _BLOCK)], pa.int64()), "node": [tree.root()],
        })

    blocks = stored(
        cut.select("grp", "pos", "total", "block", "node").groupBy("grp", "block")
        .applyInArrow(roots, "grp string, pos long, total long, node string"),
        "merkle-blocks",
    )
    if blocks.where("total > 1").limit(1).count():
        above = witnessed(blocks)
    else:
        above = blocks.withColumns({"path": F.array().cast(_PATH), "top": F.col("node")})
    above = beyond(above.select("grp", F.col("pos").alias("block"), "path", "top"))

    kept = [f for f in nodes.schema.fields if f.name != "total"]
    tops = [f for f in above.schema.fields if f.name not in ("grp", "block")]
    schema = StructType([*kept, *tops])

    def extended(own: pa.Table, upper: pa.Table) -> pa.Table:
        own = in_order(own)
        tree = appended(own.column("node").to_pylist(), own.column("total")[0].as_py())
        tree.root()
        beyond_block = [(s["before"], s["after"]) for s in upper.column("path")[0].as_py()]
        paths = [
            [{"before": before, "after": after} for before, after in (*path, *beyond_block)]
            for path in tree.witnesses
        ]
        return pa.table({f.name: own.column(f.name) for f in kept} | {
            f.name: pa.array(paths, _PATH_ARROW) if f.name == "path"
            else pa.array(upper.column(f.name).to_pylist() * len(own), upper.schema.field(f.name).type)
            for f in tops
        })

    return cut.groupBy("grp", "block").cogroup(above.groupBy("grp", "block")).applyInArrow(extended, schema)


def manifest(
    docs: DataFrame, fields: tuple[str, ...] = FIELDS, group_column: str = "lang", id_column: str = "doc_id",
    altered: dict[str, Column] | None = None,
) -> DataFrame:
    """Per row its ``id_column``, ``group_column``, ``leaf``, ``subroot``, ``root`` and ``path``.

    Leaves hash ``fields``; they stand by id within their group, null ids first, equal ids by leaf. Groups stand by the
    bytes of their names, null first. ``path`` lists, level by level from the leaf to the root, what stands
    before and after in the same run of up to eight; a level is listed also if nothing does. With
    ``altered``, ``altered_leaf`` hashes the row with these values in place of its own.

    Nulls are hashed as such; texts are hashed whole; equal rows are leaves of their own; other columns take no
    part. An empty table gives no rows.
    """
    own = dict(zip(fields, named(fields)))
    group, row_id = named([group_column, id_column])
    leaves = docs.select(
        F.coalesce(F.concat(F.lit("+"), group.cast("string")), F.lit("")).alias("grp"),
        group.alias("of"), row_id.alias("id"),
        leaf_digest(*own.values()).alias("node"), leaf_digest(*(own | (altered or {})).values()).alias("other"),
    )
    nodes = numbered(leaves, ["id", "node"])

    def to_root(above: DataFrame) -> DataFrame:
        """Paths of blocks beyond their group's root."""
        tops = above.groupBy("grp").agg(F.first("top").alias("node"))
        groups = numbered(tops.select(F.lit("").alias("grp"), F.col("grp").alias("name"), "node"), ["name"])
        ends = witnessed(groups).select(
            F.col("name").alias("grp"), F.col("path").alias("rest"), F.col("top").alias("root")
        )
        return above.join(ends, "grp").select(
            "grp", "block", F.concat("path", "rest").alias("path"), F.col("top").alias("subroot"), "root"
        )

    found = witnessed(nodes, lambda above: to_root(stored(above, "merkle-paths")))
    return found.select(
        F.col("id").alias(id_column), F.col("of").alias(group_column), F.col("node").alias("leaf"),
        "subroot", "root", "path", *([F.col("other").alias("altered_leaf")] if altered else []),
    )


def folded(leaf: Column, path: Column) -> Column:
    """The root that follows from a leaf and its witness."""
    return F.aggregate(path, leaf, lambda node, s: F.sha2(F.concat(s.before, node, s.after).cast("binary"), 256))


def checked_manifest(docs: DataFrame) -> DataFrame:
    """The manifest of ``docs`` as digests, and whether each row, some of them tampered with, still leads to the root."""
    struck = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    text = F.when(struck, F.translate("text", UPPER, LOWER)).otherwise(F.col("text"))
    proof = F.array_join(F.transform("path", lambda s: F.concat(s.before, s.after)), "")
    return manifest(docs, altered={"text": text}).select(
        "doc_id", "leaf", "subroot", "root", F.sha2(proof.cast("binary"), 256).alias("proof_sha256"),
        folded(F.col("altered_leaf"), F.col("path")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def _levels_sql(name: str, levels: int) -> str:
    """Levels of the trees of ``{name}0(g, pos, n, node)``, with what stands before and after each node in its run."""
    parts = []
    for k in range(levels):
        parts.append(f"""
{name}s{k} AS (
  SELECT *, coalesce(string_agg(node, '' ORDER BY pos) OVER (PARTITION BY g, pos // 8 ORDER BY pos
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS b,
    coalesce(string_agg(node, '' ORDER BY pos) OVER (PARTITION BY g, pos // 8 ORDER BY pos
      ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS f FROM {name}{k}),
{name}{k + 1} AS (
  SELECT g, pos // 8 AS pos, (n + 7) // 8 AS n,
    CASE WHEN n > 1 THEN sha256(string_agg(node, '' ORDER BY pos)) ELSE any_value(node) END AS node
  FROM {name}{k} GROUP BY g, pos // 8, n)""")
    return ",".join(parts)


def _fold_sql(name: str, levels: int, source: str, start: str) -> str:
    """Folds ``source(r, g, pos, folded, proof)`` up the levels."""
    parts = [f"{start}0 AS (SELECT r, g, pos, folded, proof FROM {source})"]
    for k in range(levels):
        parts.append(f"""
{start}{k + 1} AS (
  SELECT r, d.g, d.pos // 8 AS pos, CASE WHEN n > 1 THEN sha256(b || folded || f) ELSE folded END AS folded,
    CASE WHEN n > 1 THEN proof || b || f ELSE proof END AS proof
  FROM {start}{k} d JOIN {name}s{k} s ON d.g = s.g AND d.pos = s.pos)""")
    return ",\n".join(parts)


def _framed(value: str) -> str:
    return f"coalesce(strlen(CAST({value} AS VARCHAR)) || ':' || CAST({value} AS VARCHAR), '-')"


def _leaf_sql(text: str) -> str:
    return "sha256(" + " || ".join(_framed(c) for c in (*FIELDS[:-1], text)) + ")"


_DOC_LEVELS, _LANG_LEVELS = 8, 3  # enough for 8 ** 8 rows of a language and 512 languages

MANIFEST_SQL = f"""
WITH {CRC_SQL.lstrip()},
leaves AS (
  SELECT doc_id, coalesce('+' || lang, '') AS g, {_leaf_sql("text")} AS node,
    {_leaf_sql(f"CASE WHEN h % 3 = 0 THEN translate(text, '{UPPER}', '{LOWER}') ELSE text END")} AS other
  FROM documents LEFT JOIN crcs USING (doc_id)),
placed AS (
  SELECT *, row_number() OVER (ORDER BY g, doc_id NULLS FIRST, node) AS r, count(*) OVER (PARTITION BY g) AS n,
    row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, node) - 1 AS pos FROM leaves),
d0 AS (SELECT g, pos, n, node FROM placed),{_levels_sql("d", _DOC_LEVELS)},
tops AS (
  SELECT g AS name, node, count(*) OVER () AS n, row_number() OVER (ORDER BY encode(g)) - 1 AS pos FROM d{_DOC_LEVELS}),
t0 AS (SELECT '' AS g, pos, n, node FROM tops),{_levels_sql("t", _LANG_LEVELS)},
first_fold AS (SELECT r, g, pos, other AS folded, '' AS proof FROM placed),
{_fold_sql("d", _DOC_LEVELS, "first_fold", "x")},
second_fold AS (SELECT r, '' AS g, tops.pos, folded, proof FROM x{_DOC_LEVELS} x JOIN tops ON x.g = tops.name),
{_fold_sql("t", _LANG_LEVELS, "second_fold", "y")}
SELECT doc_id, placed.node AS leaf, tops.node AS subroot, t.node AS root, sha256(proof) AS proof_sha256,
  folded AS folded_root, folded = t.node AS verified
FROM placed JOIN y{_LANG_LEVELS} y USING (r) JOIN tops ON placed.g = tops.name, t{_LANG_LEVELS} t
"""
