"""Mixing sources to target weights.

Documents get hash-random keys and are put in the order of their keys within each source. The
key space of a source is cut into ranges of about ``_RANGE`` documents; sums of sizes are
taken per range, then over the ranges of a source, then inside each range. So prefix sums
need no task that sees a whole source. A source's budget is spent in whole epochs and then along the
order, up to the exact word.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runledger.llm.common import named, stored, word_count

_RANGE = 2048
_KEYS = 1 << 31


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """``target`` words for each row of ``sizes(source, source_size)``, one per source.

    Sources in code point order, null last, have ``weights`` in turn. Targets add up to
    ``share`` of all sizes; none exceeds ``most`` times its source's size, and what is above goes to
    the others by weight. Sources reach that limit in the order of limit to weight, so
    running sums over this small table find all targets in one pass.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    place = F.row_number().over(by_name) - 1
    weighed = sizes.withColumns({
        "weight": F.element_at(
            F.array(*map(F.lit, weights)), (F.pmod(place, F.lit(len(weights))) + 1).cast("int")
        ).cast("double"),
        "limit": most * F.col("source_size"),
        "place": place,
    })
    order = Window.orderBy(F.col("limit") / F.col("weight"), "place")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = (
        F.sum("source_size").over(everything) * share
        - F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    ) / F.sum("weight").over(after)
    # The level of the first source it does not fill holds for all after it.
    levelled = weighed.withColumns({"level": level}).withColumn(
        "open", F.col("level") * F.col("weight") < F.col("limit")
    )
    held = F.min(F.when(F.col("open"), F.struct("limit_rank", "level"))).over(everything)
    ranked = levelled.withColumn("limit_rank", F.row_number().over(order))
    return ranked.withColumn("held", held).select(
        "source", "source_size",
        F.when(
            F.col("held").isNotNull() & (F.col("limit_rank") >= F.col("held.limit_rank")),
            F.col("held.level") * F.col("weight"),
        ).otherwise(F.col("limit")).alias("target"),
    )


def mix(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source",
    weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: str = "mix",
) -> DataFrame:
    """``docs`` without their text, with ``size, source_size, target, taken``.

    ``taken`` is how many of its words the mix takes, repeats counted: whole epochs of the
    source, then its documents in random order until the budget is spent; the document at the
    cut gives its first words. The sums of a source are its target without the fraction. Null and empty texts
    have size 0; null sources form one source, the last; sources without words get target 0. Equal ids are
    ordered by size, so reruns agree. Columns with the names of results are replaced; an
    empty table gives no rows.
    """
    results = ("size", "source_size", "target", "taken")
    docs = docs.drop(*(c for c in docs.columns if c.lower() in results))
    others = [c for c in docs.columns if c.lower() != text_column.lower()]
    rows = docs.select(
        F.struct(*named(others)).alias("doc"), F.col(source_column).alias("source"),
        word_count(F.col(text_column)).alias("size"),
        F.coalesce(F.col(id_column).cast("string"), F.lit("")).alias("id"),
    ).withColumn(
        "key",
        F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), "id").cast("binary")), 1, 8), 16, 10)
        .cast("long") % _KEYS,
    )
    rows = stored(rows, "mix-sizes")
    totals = rows.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.count("*").alias("source_rows")
    )
    sources = source_targets(totals.select("source", "source_size"), weights, share, most)
    sources = sources.alias("a").join(
        totals.select("source", "source_rows").alias("b"), F.expr("a.source <=> b.source")
    ).select("a.*", F.ceil(F.col("source_rows") / _RANGE).alias("ranges"))
    placed = rows.join(
        sources.withColumnRenamed("source", "of"), F.expr("source <=> of")
    ).drop("of").withColumn("range", F.expr(f"key * ranges div {_KEYS}"))
    sums = placed.groupBy("source", "range").agg(F.sum("size").alias("range_size")).withColumn(
        "start",
        F.coalesce(
            F.sum("range_size").over(
                Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
            ),
            F.lit(0),
        ),
    )
    inside = Window.partitionBy("source", "range").orderBy("key", "id", "size")
    summed = placed.alias("a").join(
        sums.select(F.col("source").alias("of"), F.col("range").alias("in"), "start").alias("b"),
        F.expr("a.source <=> b.of AND a.range = b.in"),
    ).withColumn(
        "reached", F.col("start") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    )
    epochs = F.expr("CASE WHEN source_size > 0 THEN bigint(target) div source_size ELSE 0L END")
    left = F.expr("bigint(target)") - epochs * F.col("source_size")
    return summed.select(
        "doc.*", "size", "source_size", "target",
        (
            epochs * F.col("size")
            + F.greatest(F.lit(0), F.least("size", left - F.col("reached") + F.col("size")))
        ).alias("taken"),
    )


MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    CAST('0x' || md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), ''))[1:8] AS BIGINT) % 2147483648 AS key
  FROM documents),
sources AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap, [3.0, 1.0, 2.0][(place % 3) + 1]::DOUBLE AS weight FROM (
    SELECT source, sum(size)::BIGINT AS source_size,
      row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1 AS place FROM sized GROUP BY source)),
levels AS (
  SELECT *, row_number() OVER (ORDER BY cap / weight, place) AS nr,
    ((SELECT sum(source_size) FROM sources) * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, place
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY cap / weight, place
      ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM sources),
held AS (SELECT min(nr) AS nr, arg_min(level, nr) AS level FROM levels WHERE level * weight < cap),
targets AS (
  SELECT source, source_size, CASE WHEN levels.nr >= held.nr THEN held.level * weight ELSE cap END AS target
  FROM levels, held),
summed AS (
  SELECT s.*, source_size, target, sum(size) OVER (PARTITION BY s.source ORDER BY key, doc_id, size
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS reached
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
spent AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target) AS BIGINT) // source_size ELSE 0 END AS epochs FROM summed)
SELECT doc_id, size, source_size, target, CAST(epochs * size + greatest(0, least(size,
  CAST(floor(target) AS BIGINT) - epochs * source_size - reached + size)) AS BIGINT) AS taken FROM spent
"""
