"""Periodic runs of words: stretches that repeat one block of words several times.

Per text the suffixes that share enough words are sorted by prefix doubling, with their longest common
prefixes (LCP). Suffix classes are then united by decreasing LCP, as Kruskal unites a
spanning tree, with union-find over ordered sets of positions. Two positions that become neighbours in a set at
distance d within the LCP l lie in a stretch of l + d words of period d; if the word before does not fit, it is a
whole run. In a run of exponent three or more no position of the class lies between its first two periods' starts, so
each run is found, and with its smallest period.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from runledger.llm.common import WORD, gram_hashes, named

# Words of short texts worked on together; a longer text is worked on alone.
_TOGETHER = 200_000

_RUN = StructType([StructField(name, LongType()) for name in ("start", "length", "period")])
_RUN_ARROW = pa.struct([(name, pa.int64()) for name in ("start", "length", "period")])

Run = tuple[int, int, int]


def least_prefix(exponent: int, least: int) -> int:
    """The least LCP of the first two periods' starts of a run, over all periods."""
    return min(max(least - q, (exponent - 1) * q) for q in range(1, least + 1))


def suffix_neighbours(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Neighbours ``a, b`` in the suffix order of ``words`` and their LCP.

    The last word of each stretch is found nowhere else, so no LCP reaches past it.
    """
    size = len(words)
    rank = np.unique(words, return_inverse=True)[1].astype(np.int64)
    levels, depth = [], 1
    while True:
        levels.append(rank.astype(np.int32 if size < 1 << 31 else np.int64))
        after = np.zeros(size, np.int64)
        after[: max(size - depth, 0)] = rank[depth:] + 1
        key = rank * (size + 1) + after
        order = np.argsort(key, kind="stable")
        key = key[order]
        rank = np.empty(size, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
        if rank[order[-1]] == size - 1:
            break
        depth *= 2
    a, b = order[:-1], order[1:]
    shared = np.zeros(size - 1, np.int64)
    for k in range(len(levels) - 1, -1, -1):
        shared += (levels[k][a + shared] == levels[k][b + shared]).astype(np.int64) << k
    return a, b, shared


def _promising(words: np.ndarray, prefix: int, exponent: int) -> np.ndarray:
    """Positions of stretches that can hold a run; the rest of the words cannot take part in one.

    A place's first ``prefix`` words come again in the text; places whose such words touch make a stretch. A run starts
    where these words come next within a share of what is left of the stretch. Equal hashes only add places.
    """
    empty = np.empty(0, np.int64)
    grams = gram_hashes(words.astype(np.uint64), prefix)
    if len(grams) < 2:
        return empty
    order = np.argsort(grams, kind="stable")
    same = grams[order[1:]] == grams[order[:-1]]
    if not same.any():
        return empty
    again = np.zeros(len(grams), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    gap = np.full(len(grams), np.iinfo(np.int64).max // exponent, np.int64)
    gap[order[:-1][same]] = (order[1:] - order[:-1])[same]
    places = np.flatnonzero(again)
    first = np.concatenate([[True], np.diff(places) > prefix])
    starts = np.flatnonzero(first)
    stretch = np.cumsum(first) - 1
    ends = places[np.append(starts[1:], len(places)) - 1]
    fits = ends[stretch] - places + prefix >= (exponent - 1) * gap[places]
    return places[np.bitwise_or.reduceat(fits, starts)[stretch]]


def find_runs(words: np.ndarray, exponent: int = 4, least: int = 6) -> list[Run]:
    """Runs ``start, length, period`` by start of words given as numbers, several texts at once.

    A text follows a number that is found nowhere else, the last text is followed by one too, and
    no two texts share a number; so no run crosses texts.
    """
    prefix = least_prefix(exponent, least)
    places = _promising(words, prefix, exponent)
    if not len(places):
        return []
    # Each stretch is closed by a number of its own.
    cut = np.flatnonzero(np.diff(places) > prefix) + 1
    parts = [np.append(np.arange(p[0], p[-1] + prefix), -1) for p in np.split(places, cut)]
    at = np.concatenate(parts)
    short = words[at]
    closing = np.flatnonzero(at < 0)
    short[closing] = words.max() + 1 + np.arange(len(closing))
    a, b, shared = suffix_neighbours(short)
    wanted = shared >= prefix
    a, b, shared = a[wanted], b[wanted], shared[wanted]
    order = np.argsort(-shared, kind="stable")
    pairs = zip(at[a[order]].tolist(), at[b[order]].tolist(), shared[order].tolist())

    before = dict(zip(places.tolist(), words[places - 1].tolist()))
    above = {p: p for p in before}
    classes = {p: [p] for p in before}
    periods: dict[tuple[int, int], int] = {}

    def root(p: int) -> int:
        while above[p] != p:
            above[p] = p = above[above[p]]
        return p

    def seed(i: int, j: int, prefix: int) -> None:
        period = j - i
        if period * (exponent - 1) <= prefix and period + prefix >= least and before[i] != before[j]:
            found = i, period + prefix
            periods[found] = min(period, periods.get(found, period))

    for i, j, prefix in pairs:
        large, small = root(i), root(j)
        if len(classes[large]) < len(classes[small]):
            large, small = small, large
        above[small] = large
        members, last = classes[large], -1
        for p in classes.pop(small):
            k = bisect_left(members, p)
            # Two of the smaller class met before, at their own LCP.
            if k and members[k - 1] != last:
                seed(members[k - 1], p, prefix)
            if k < len(members):
                seed(p, members[k], prefix)
            members.insert(k, p)
            last = p
    return sorted((start, length, period) for (start, length), period in periods.items())


def best_run(runs: list[Run]) -> Run | None:
    """The run of the greatest length by period; ties go to the smallest start, then period."""
    return max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)


def text_runs(texts: list[bytes | None], exponent: int, least: int) -> list[tuple[int, list[Run], str | None]]:
    """For each text its number of words, its runs, and its words without repeats of periods."""
    found: list[tuple[int, list[Run], str | None]] = []
    together: list[list[bytes]] = []
    held = 0

    def work() -> None:
        numbers, starts, used = [], [], 0
        for words in together:
            known = dict.fromkeys(words)
            known = dict(zip(known, range(used + 1, used + 1 + len(known))))
            starts.append(starts[-1] + len(numbers[-1]) if numbers else 1)
            line = np.empty(len(words) + 1, np.int64)
            line[0] = used
            line[1:] = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
            numbers.append(line)
            used += 1 + len(known)
        runs = find_runs(np.concatenate([*numbers, [used]]), exponent, least) if numbers else []
        of = np.searchsorted(starts, [r[0] for r in runs], "right") - 1
        each: list[list[Run]] = [[] for _ in together]
        for k, (start, length, period) in zip(of.tolist(), runs):
            each[k].append((start - starts[k], length, period))
        for words, own in zip(together, each):
            kept = words
            if own:
                keep = np.ones(len(words), bool)
                for start, length, period in own:
                    keep[start + period : start + length] = False
                kept = [words[k] for k in np.flatnonzero(keep).tolist()]
            found.append((len(words), own, b" ".join(kept).decode("utf-8", "surrogatepass")))
        together.clear()

    for text in texts:
        words = (text or b"").split()
        if together and held + len(words) > _TOGETHER:
            work()
            held = 0
        together.append(words)
        held += len(words)
    work()
    return found


def periodic_runs(
    docs: DataFrame, text_column: str = "text", exponent: int = 4, least: int = 6,
) -> DataFrame:
    """``docs`` without their text, with ``n_words, runs, best, collapsed``.

    Words are ``[^\\x20\\x09-\\x0D]+`` of the whole text. A run is a stretch with smallest period q and at least
    ``least`` and ``exponent * q`` words that no neighbouring word extends; ``exponent`` is 3 or more. ``runs`` holds them by start,
    then period; ``best`` is that of the greatest length by period (ties: smallest start, then period), null for
    none. ``collapsed`` has the words, joined by one space, less those a run holds after its first period.

    Null and empty texts have no words, no runs and an empty ``collapsed``. Repeated rows are judged one by
    one. Columns with the names of results are replaced; an empty table gives no rows. Texts travel alone or in
    groups of bounded size; memory grows with the longest text.
    """
    if exponent < 3:
        raise ValueError("runs are found for exponents of 3 and more")
    results = ("n_words", "runs", "best", "collapsed")
    others = [c for c in docs.columns if c.lower() not in (*results, text_column.lower())]
    rows = docs.select(
        F.struct(*named(others)).alias("doc"), named([text_column])[0].cast("binary").alias("text")
    )
    schema = StructType([
        rows.schema["doc"], StructField("n_words", LongType()), StructField("runs", ArrayType(_RUN)),
        StructField("best", _RUN), StructField("collapsed", StringType()),
    ])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = text_runs(batch.column("text").to_pylist(), exponent, least)
            as_rows = [[dict(zip(_RUN.names, r)) for r in runs] for _, runs, _ in found]
            best = [best_run(runs) for _, runs, _ in found]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc"), pa.array([n for n, _, _ in found], pa.int64()),
                    pa.array(as_rows, pa.list_(_RUN_ARROW)),
                    pa.array([r and dict(zip(_RUN.names, r)) for r in best], _RUN_ARROW),
                    pa.array([text for _, _, text in found], pa.string()),
                ],
                ["doc", *results],
            )

    return rows.mapInArrow(search, schema).select("doc.*", *results)


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` where one in ten texts, by the id's checksum h, is made periodic from a word on.

    If h % 10 is 0 and there are words, word i >= a becomes word a + (i - a) % p, with g = h div 10, a = g % n
    and p = 1 + (n - a) div (3 + g % 8). Rows without an id stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    named = docs.select("doc_id", "text", h.alias("h")).withColumn(
        "w", F.when((F.col("h") % 10 == 0) & F.col("text").rlike(WORD), F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    )
    ruled = named.withColumn("g", F.expr("h div 10")).withColumn("a", F.expr("g % size(w)")).withColumn(
        "p", F.expr("1 + (size(w) - a) div (3 + g % 8)")
    )
    return ruled.select(
        "doc_id",
        F.expr(
            "CASE WHEN w IS NULL THEN text ELSE array_join(transform(w, (x, i) -> "
            "CASE WHEN i < a THEN x ELSE w[int(a + (i - a) % p)] END), ' ') END"
        ).alias("text"),
    )


def run_digests(found: DataFrame) -> DataFrame:
    """Counts, the best run and digests of ``periodic_runs``, by ``doc_id``."""
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), *(f"best.{c}" for c in _RUN.names),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


# CRC-32 of a short text, in SQL: the table of its 256 bytes follows from the polynomial.
CRC_SQL = """
crc_table AS (
  SELECT list(list_reduce(list_prepend(k, range(8)), lambda c, x:
    CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY k) AS t FROM range(256) r(k)),
crcs AS (
  SELECT doc_id, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
    lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h
  FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL), crc_table)"""

RUNS_SQL = r"""
WITH """ + CRC_SQL.lstrip() + r""",
split AS (
  SELECT doc_id, h, h // 10 AS g, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents LEFT JOIN crcs USING (doc_id)),
ruled AS (SELECT *, len(w) AS n, CASE WHEN len(w) > 0 THEN g % len(w) END AS a FROM split),
placed AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p, unnest(range(n)) AS i FROM ruled),
words AS (
  SELECT doc_id, n, i, w[1 + CASE WHEN h % 10 = 0 AND i >= a THEN a + (i - a) % p ELSE i END] AS word FROM placed),
grams AS (
  SELECT doc_id, n, i, concat_ws(' ', word, lead(word, 1) OVER o, lead(word, 2) OVER o, lead(word, 3) OVER o,
    lead(word, 4) OVER o) AS gram FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
pairs AS (
  SELECT x.doc_id, x.i, y.i - x.i AS q FROM grams x JOIN grams y ON x.doc_id = y.doc_id AND x.gram = y.gram
    AND y.i > x.i AND 4 * (y.i - x.i) <= x.n WHERE y.i + 5 <= x.n),
islands AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM pairs),
runs AS (
  SELECT doc_id, start, length, min(q) AS period FROM (
    SELECT doc_id, q, min(i) AS start, count(*) + 4 + q AS length FROM islands GROUP BY doc_id, q, island)
  WHERE length >= greatest(6, 4 * q) GROUP BY doc_id, start, length),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length / period DESC, start, period) AS nr FROM runs),
listed AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(concat(start, ',', length, ',', period, chr(10)), '' ORDER BY start, period) AS lines
  FROM runs GROUP BY doc_id),
left_over AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS collapsed FROM words WHERE NOT EXISTS (
    SELECT 1 FROM runs WHERE runs.doc_id = words.doc_id AND i >= start + period AND i < start + length) GROUP BY doc_id)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(collapsed, '')) AS collapsed_sha256
FROM documents LEFT JOIN listed USING (doc_id) LEFT JOIN (SELECT * FROM ranked WHERE nr = 1) USING (doc_id)
  LEFT JOIN left_over USING (doc_id)
"""
