"""Repeated runs of lines: a suffix array over line ids by distributed prefix doubling.

Each line gets an id, equal for equal lines. Step k ranks every position by the 2^k lines
from it: pairs of ranks of the two halves are counted, those found twice are range-sorted, and their
places in that order are the ranks of the next step. A position whose run is unique leaves. The
positions in the order of their ranks are the suffix array; positions of equal rank are
an interval of common prefixes.

A repeated run is deleted where it is a later copy and has ``min_words`` words. Such a run
is the union of its shortest parts of ``min_words`` words, counted from a first line or up to a
last line, so the intervals of those depths show every maximal run. An interval for any depth is named by
two overlapping ranks of 2^k lines. The number of steps follows from ``min_words``, not from the
length of documents or copies.

Only DataFrame functions are used.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runledger.llm.common import WORD, named, stored


def _words(line: Column) -> Column:
    return F.regexp_count(line, F.lit(WORD)).cast("long")


def _ranked(classes: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, rank``: ranks rise with the keys. Range-sorted partitions, numbered in order."""
    return stored(
        classes.select(*keys).repartitionByRange(*keys).sortWithinPartitions(*keys)
        .withColumn("rank", F.monotonically_increasing_id()),
        "ranks",
    )


def _repeated(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").select(*keys)


def _parts(lines: DataFrame, min_words: int) -> DataFrame:
    """``uid, part, start, length``: shortest runs of ``min_words`` words, from or up to each line.

    Line starts and the points ``min_words`` words before and after them are put in order of
    the words before them; running extremes then find the nearest start, in linear time.
    """
    by_line = Window.partitionBy("uid", "part").orderBy("pos")
    counted = lines.withColumn(
        "upto", F.sum("words").over(by_line.rowsBetween(Window.unboundedPreceding, 0))
    )
    own = ["uid", "part"]
    starts = counted.select(*own, (F.col("upto") - F.col("words")).alias("at"), F.col("pos").alias("start"), F.lit(None).cast("int").alias("asks"))
    ends = counted.select(*own, F.col("upto").alias("at"), (F.col("pos") + 1).alias("start"), F.lit(None).cast("int").alias("asks"))
    first_asks = counted.select(
        *own, (F.col("upto") - F.col("words") + min_words).alias("at"), F.lit(None).cast("int").alias("start"), F.col("pos").alias("asks")
    )
    last_asks = counted.select(
        *own, (F.col("upto") - min_words).alias("at"), F.lit(None).cast("int").alias("start"), F.col("pos").alias("asks")
    )
    down = Window.partitionBy(*own).orderBy(F.desc("at"), F.col("asks").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    up = Window.partitionBy(*own).orderBy("at", F.col("asks").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    from_line = (
        ends.unionByName(first_asks).withColumn("end", F.min("start").over(down))
        .where("asks IS NOT NULL AND end IS NOT NULL")
        .select(*own, F.col("asks").alias("start"), (F.col("end") - F.col("asks")).alias("length"))
    )
    to_line = (
        starts.unionByName(last_asks).withColumn("begin", F.max("start").over(up))
        .where("asks IS NOT NULL AND begin IS NOT NULL")
        .select(*own, F.col("begin").alias("start"), (F.col("asks") + 1 - F.col("begin")).alias("length"))
    )
    return from_line.unionByName(to_line).distinct()


def later_runs(lines: DataFrame, min_words: int) -> DataFrame:
    """``uid, runs``: the line numbers, from and to, of later copies of repeated runs.

    ``lines(uid, pos, order, id_a, id_b, words)``: a row per line; ``order`` says which of two texts is the earlier.
    """
    ids = ["id_a", "id_b"]
    known = lines.join(_ranked(_repeated(lines, ids), ids), ids)
    # Unique lines part a text; only parts with enough words can hold a run.
    by_line = Window.partitionBy("uid").orderBy("pos")
    parts = known.withColumn("part", F.col("pos") - F.row_number().over(by_line))
    enough = Window.partitionBy("uid", "part")
    places = stored(
        parts.withColumn("total", F.sum("words").over(enough)).where(F.col("total") >= min_words)
        .select("uid", "part", "pos", "order", "words", F.col("rank").alias("rank_0")),
        "suffixes",
    )
    found = stored(_parts(places, min_words), "run-parts")
    longest = found.agg(F.max("length")).first()[0] or 0
    if not longest:
        return found.select("uid", F.array(F.struct(F.col("start").alias("from"), F.col("start").alias("to"))).alias("runs")).limit(0)
    steps = longest.bit_length() - 1
    for k in range(steps):
        inside = Window.partitionBy("uid", "part").orderBy("pos")
        pairs = places.withColumn("next", F.lead(f"rank_{k}", 1 << k).over(inside))
        keys = [f"rank_{k}", "next"]
        ranks = _ranked(_repeated(pairs.where(f"rank_{k} IS NOT NULL AND next IS NOT NULL"), keys), keys)
        places = stored(
            pairs.join(ranks.withColumnRenamed("rank", f"rank_{k + 1}"), keys, "left").drop("next"),
            "suffixes",
        )
    levels = F.array(*(f"rank_{k}" for k in range(steps + 1)))

    def rank_at(level: Column) -> Column:
        return F.element_at(levels, level + 1)

    level = reduce(
        lambda chosen, k: F.when(F.col("length") >= (1 << k), F.lit(k)).otherwise(chosen),
        range(1, steps + 1), F.lit(0),
    )
    asked = found.withColumn("level", level).withColumn(
        "second", F.expr("start + length - shiftleft(1, level)")
    )
    head = asked.join(
        places.select("uid", F.col("pos").alias("start"), "order", levels.alias("ranks")), ["uid", "start"]
    ).withColumn("head", F.element_at("ranks", F.col("level") + 1)).drop("ranks")
    named = stored(
        head.where("head IS NOT NULL").join(
            places.select("uid", F.col("pos").alias("second"), levels.alias("ranks")), ["uid", "second"]
        ).withColumn("tail", F.element_at("ranks", F.col("level") + 1)).where("tail IS NOT NULL")
        .select("uid", "start", "length", "head", "tail", F.struct("order", "uid", "start").alias("place")),
        "intervals",
    )
    interval = ["length", "head", "tail"]
    first = named.groupBy(*interval).agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1")
    copies = named.join(first, interval).where("place > first").select("uid", "start", (F.col("start") + F.col("length") - 1).alias("end"))
    ordered = Window.partitionBy("uid").orderBy("start", "end")
    reached = F.max("end").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    merged = copies.withColumn("new", F.coalesce(F.col("start") > reached + 1, F.lit(True)).cast("int"))
    numbered = merged.withColumn("run", F.sum("new").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    return (
        numbered.groupBy("uid", "run").agg(F.min("start").alias("from"), F.max("end").alias("to"))
        .groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("from", "to"))).alias("runs"))
    )


def dedup_lines(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", min_words: int = 50
) -> DataFrame:
    """``docs`` without later copies of repeated line runs, with ``n_lines, n_removed, emptied``.

    A run of consecutive lines of at least ``min_words`` words (``[^\\x20\\x09-\\x0D]+``) that also stands earlier, in
    another text or further up in the same one, is deleted; copies may overlap. Earlier means a smaller id, then
    null ids; rows of equal id stand in the order they are read. Lines end at ``\\n`` and are compared
    whole; shorter runs stay. ``emptied`` tells that no word is left of a text that had some. Null texts stay null with no lines, an
    empty text is one empty line. Columns with the names of results are replaced; an empty table gives no rows.
    """
    results = ("n_lines", "n_removed", "emptied")
    docs = docs.drop(*(c for c in docs.columns if c.lower() in results))
    rows = stored(
        docs.select(F.struct(*named(docs.columns)).alias("doc"), F.monotonically_increasing_id().alias("uid")),
        "keyed-docs",
    )
    text = F.col("doc")[text_column]
    lines = stored(
        rows.select(
            "uid", F.struct(F.col("doc")[id_column].isNull().alias("none"), F.col("doc")[id_column].alias("id")).alias("order"),
            F.posexplode(F.split(text, "\n")).alias("pos", "line"),
        ).select(
            "uid", "pos", "order", F.xxhash64("line").alias("id_a"),
            F.xxhash64(F.lit(1), "line").alias("id_b"), _words(F.col("line")).alias("words"),
        ),
        "line-ids",
    )
    runs = later_runs(lines, min_words)
    split = F.split(text, "\n")
    joined = rows.join(runs, "uid", "left")
    kept = F.filter(
        split, lambda line, place: ~F.exists("runs", lambda run: place.between(run["from"], run["to"]))
    )
    cleaned = joined.withColumn(
        "clean", F.when(F.col("runs").isNull(), text).otherwise(F.array_join(kept, "\n"))
    )
    removed = F.aggregate(
        "runs", F.lit(0), lambda total, run: total + run["to"] - run["from"] + 1
    )
    columns = [
        F.col("clean").alias(c) if c.lower() == text_column.lower() else F.col("doc")[c].alias(c)
        for c in docs.columns
    ]
    return cleaned.select(
        *columns,
        F.when(text.isNull(), 0).otherwise(F.size(split)).cast("long").alias("n_lines"),
        F.coalesce(removed, F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce(F.col("runs").isNotNull() & ~F.col("clean").rlike(WORD), F.lit(False)).alias("emptied"),
    )


LINES_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(range(len(l))) AS pos, unnest(l) AS line, l FROM (
    SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)),
counted AS (
  SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words,
    sum(len(regexp_extract_all(line, '[^\x20\x09-\x0D]+'))) OVER (PARTITION BY doc_id ORDER BY pos) AS upto FROM lines),
parts AS (
  SELECT a.doc_id, a.pos AS s, min(b.pos) AS e FROM counted a JOIN counted b
    ON a.doc_id = b.doc_id AND b.pos >= a.pos AND b.upto >= a.upto - a.words + 50 GROUP BY ALL
  UNION
  SELECT b.doc_id, max(a.pos) AS s, b.pos AS e FROM counted a JOIN counted b
    ON a.doc_id = b.doc_id AND b.pos >= a.pos AND b.upto >= a.upto - a.words + 50 GROUP BY ALL),
named AS (
  SELECT p.doc_id, s, e, (SELECT string_agg(c.line, chr(10) ORDER BY c.pos) FROM counted c
    WHERE c.doc_id = p.doc_id AND c.pos BETWEEN s AND e) AS g FROM parts p),
copies AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id, s, e) AS nr FROM named) WHERE nr > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, e + 1)) AS pos FROM copies),
kept AS (
  SELECT c.doc_id, string_agg(line, chr(10) ORDER BY c.pos) FILTER (g.pos IS NULL) AS clean,
    count(*) AS n_lines, count(g.pos) AS n_removed, sum(words) AS words,
    coalesce(sum(words) FILTER (g.pos IS NULL), 0) AS left_words
  FROM counted c LEFT JOIN gone g ON c.doc_id = g.doc_id AND c.pos = g.pos GROUP BY c.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(clean, '') END AS text,
  coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed,
  coalesce(n_removed > 0 AND left_words = 0, FALSE) AS emptied
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""
