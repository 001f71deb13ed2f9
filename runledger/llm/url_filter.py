"""URL filter: a cascade of Bloom filters that is exact over all keys of the corpus.

Level 1 holds the listed keys. Level 2 holds the corpus's other keys that level 1 lets through by
mistake, level 3 the listed keys that level 2 then lets through, and so on until no mistake is left.
The first level that does not hold a key decides: an even one says listed, an odd one not. The
levels are scalar values of the plan, so judging a url joins nothing. Levels too large for that stay tables of 64-bit
words, and keys are brought to the words they probe.

Only DataFrame functions are used.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runledger.llm.common import fresh, lower_ascii, stored

# Host, path and verdict.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
# Words of a host label that put the host on the list, with all its subdomains.
LISTED_WORDS = ("adult", "ads", "bets", "casino", "pills", "spam", "track")

_HALF = math.log(2)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return lower_ascii(F.regexp_extract(_after(url), r"^[^/?#]*", 0))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.regexp_extract(_after(url), r"^[^/?#]*([^?#]*)", 1)


def _after(url: Column) -> Column:
    place = F.instr(url, "://")
    return F.coalesce(F.when(place > 0, F.substring(url, place + 3, F.length(url))), F.lit(""))


def domains(host: Column) -> Column:
    """The host and its parents of two labels or more."""
    labels = F.split(host, r"\.")
    size = F.size(labels)
    return F.when(
        size >= 2,
        F.transform(F.sequence(F.lit(1), size - 1), lambda n: F.array_join(F.slice(labels, n, size), ".")),
    ).otherwise(F.array(host))


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...]) -> tuple[Column, Column]:
    """The text and the verdict of the longest rule that fits; null for none."""
    def fits(rule: tuple[str, str, str]) -> Column:
        return ((host == rule[0]) | F.endswith(host, F.lit("." + rule[0]))) & F.startswith(path, F.lit(rule[1]))

    ordered = sorted(rules, key=lambda r: len(r[0] + r[1]))
    none = F.lit(None).cast("string")
    return (
        reduce(lambda rest, r: F.when(fits(r), F.lit(r[0] + r[1])).otherwise(rest), ordered, none),
        reduce(lambda rest, r: F.when(fits(r), F.lit(r[2])).otherwise(rest), ordered, none),
    )


def _probes(key: Column, level: int, bits: int, hashes: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(level), F.lit(n)), F.lit(bits)) for n in range(hashes)]


def _words(keys: DataFrame, level: int, bits: int, hashes: int) -> DataFrame:
    """``word, bits``: the filter's longs that are not 0."""
    return (
        keys.select(F.explode(F.array(*_probes(F.col("key"), level, bits, hashes))).alias("bit"))
        .groupBy(F.shiftright("bit", 6).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, int(bit & 63))")).alias("bits"))
    )


def _level(held: DataFrame, bits: int) -> DataFrame:
    """One row: the filter's bits as an array of longs."""
    words = held.sparkSession.range(bits // 64).withColumnRenamed("id", "word")
    row = words.join(held, "word", "left").agg(
        F.sort_array(F.collect_list(F.struct("word", F.coalesce("bits", F.lit(0)).alias("bits")))).alias("all")
    )
    return stored(row.select(F.transform("all", lambda w: w["bits"]).alias("bits")), "filter-level")


def _holds(key: Column, filled: Column, level: int, bits: int, hashes: int) -> Column:
    tests = [
        F.getbit(F.element_at(filled, (F.shiftright(bit, 6) + 1).cast("int")), bit.bitwiseAND(F.lit(63))) == 1
        for bit in _probes(key, level, bits, hashes)
    ]
    return reduce(lambda a, b: a & b, tests)


def _held(keys: DataFrame, words: DataFrame, level: int, bits: int, hashes: int) -> DataFrame:
    """The ``key`` values of ``keys`` that a filter holds; each is sent to the words that it probes."""
    probes = keys.select("key", F.explode(F.array(*_probes(F.col("key"), level, bits, hashes))).alias("bit"))
    found = probes.withColumn("word", F.shiftright("bit", 6)).join(words, "word", "left")
    is_set = F.coalesce(F.getbit("bits", F.expr("int(bit & 63)")) == 1, F.lit(False))
    return found.groupBy("key").agg(F.bool_and(is_set).alias("held")).where("held").select("key")


class Cascade:
    """Filters that tell the listed keys of a universe from its others without a mistake."""

    def __init__(self, universe: DataFrame, most_bytes: int = 64 << 20):
        """``universe(key, listed)``. Levels of up to ``most_bytes`` are values of a plan, larger ones tables."""
        self.levels: list[tuple[DataFrame, int, int]] = []
        # Numbers of the levels that are tables.
        self.large: set[int] = set()
        keys = stored(universe.where("key IS NOT NULL").groupBy("key").agg(F.max("listed").alias("listed")), "keys")
        wrong, others = keys.where("listed"), keys.where("NOT listed")
        n_wrong, n_others = wrong.count(), others.count()
        while n_wrong:
            # The first level lets few others through; each later one halves what is left.
            rate = 0.5 if self.levels else min(0.5, n_wrong * math.sqrt(0.5) / max(1, n_others))
            hashes = max(1, round(-math.log2(rate)))
            bits = 64 * math.ceil(max(64, n_wrong * hashes / _HALF) / 64)
            number = len(self.levels)
            words = _words(wrong, number, bits, hashes)
            if bits // 8 <= most_bytes:
                self.levels.append((_level(words, bits), bits, hashes))
            else:
                self.levels.append((stored(words, "filter-words"), bits, hashes))
                self.large.add(number)
            through = stored(self._let_through(others, number), "passed-keys")
            wrong, others = through, wrong
            n_wrong, n_others = through.count(), n_wrong

    def _let_through(self, keys: DataFrame, number: int) -> DataFrame:
        filled, bits, hashes = self.levels[number]
        if number in self.large:
            return _held(keys, filled, number, bits, hashes)
        return keys.where(_holds(F.col("key"), filled.scalar(), number, bits, hashes)).select("key")

    def listed(self, keys: DataFrame) -> DataFrame:
        """The listed ones among distinct keys of the universe, ``key``, with levels of any size."""
        left, found = keys.where("key IS NOT NULL").select("key"), keys.select("key").limit(0)
        for number in range(len(self.levels)):
            held = stored(self._let_through(left, number), "held-keys")
            if number % 2:
                found = found.unionByName(left.join(held, "key", "left_anti"))
            left = held
        return found.unionByName(left) if len(self.levels) % 2 else found

    def filters(self) -> Column:
        """The levels as one value, for ``has``; only where none is a table."""
        if self.large:
            raise ValueError("levels that are tables are no value: ask listed()")
        return F.struct(*(row.scalar().alias(f"level_{n}") for n, (row, _, _) in enumerate(self.levels)), F.lit(0).alias("none"))

    def has(self, key: Column, filters: Column) -> Column:
        """Whether a key of the universe is listed; never true for null."""
        verdict = F.lit(len(self.levels) % 2 == 1)
        for number in reversed(range(len(self.levels))):
            _, bits, hashes = self.levels[number]
            held = _holds(key, filters[f"level_{number}"], number, bits, hashes)
            verdict = F.when(held, verdict).otherwise(F.lit(number % 2 == 1))
        return F.coalesce(key.isNotNull() & verdict, F.lit(False))


def listed_domains(hosts: DataFrame, words: tuple[str, ...]) -> DataFrame:
    """``key, listed``: every domain of ``hosts(host)``; listed if its first label has one of ``words``."""
    keys = hosts.select("host").distinct().select(F.explode(domains(F.col("host"))).alias("key")).distinct()
    label = F.split(F.substring_index("key", ".", 1), "-")
    return keys.withColumn(
        "listed", F.arrays_overlap(label, F.array(*map(F.lit, words))) & F.col("key").contains(".")
    )


def _judged_by_tables(
    pages: DataFrame, cascade: Cascade, hosts: DataFrame, host: Column, path: Column, rule: Column, verdict: Column
) -> DataFrame:
    of_host = stored(hosts.distinct().select("host", F.explode(domains(F.col("host"))).alias("key")), "host-domains")
    listed = cascade.listed(of_host.select("key").distinct())
    on_list, found = fresh(pages, "host_on_list", "url_blocked")
    bad = of_host.join(listed, "key", "left_semi").select(F.col("host").alias(on_list)).distinct()
    judged = pages.withColumns({"host": host, "path": path}).join(
        bad.withColumn(found, F.lit(True)), F.col("host") == F.col(on_list), "left"
    )
    return judged.withColumns({
        "rule": rule,
        "verdict": F.coalesce(verdict, F.when(F.col(found), F.lit("block")).otherwise(F.lit("allow"))),
    }).drop(on_list, found)


def judge_urls(
    pages: DataFrame, url_column: str = "url", rules: tuple[tuple[str, str, str], ...] = RULES,
    listed: DataFrame | None = None, words: tuple[str, ...] = LISTED_WORDS, most_bytes: int = 64 << 20,
) -> DataFrame:
    """``pages`` with ``host, path, rule, verdict``.

    The longest rule that fits decides; else a url is blocked if its host or a parent domain is
    listed. ``listed(key)`` gives the list; without it the corpus's domains whose first label has one of ``words``
    are listed. A list of any length is exact: where a level of the cascade is larger than ``most_bytes``, distinct
    hosts are judged by its tables and joined to the pages; the result is the same. Null urls and urls without ``://`` have an empty host and path and are allowed. Keys listed but
    absent from the corpus change nothing. Repeated rows are judged alike. Columns with the names of results are
    replaced; an empty table gives no rows.
    """
    results = ("host", "path", "rule", "verdict")
    pages = pages.drop(*(c for c in pages.columns if c.lower() in results))
    url = F.col(url_column)
    hosts = pages.select(host_of(url).alias("host"))
    universe = listed_domains(hosts, words)
    if listed is not None:
        marked = listed.select(lower_ascii(F.col("key")).alias("key")).distinct()
        universe = universe.drop("listed").join(marked.withColumn("on", F.lit(True)), "key", "left").select(
            "key", F.coalesce("on", F.lit(False)).alias("listed")
        )
    cascade = Cascade(universe, most_bytes)
    host, path = host_of(url), path_of(url)
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    if cascade.large:
        return _judged_by_tables(pages, cascade, hosts, host, path, rule, verdict)
    (filters,) = fresh(pages, "url_filters")
    blocked = F.exists(domains(F.col("host")), lambda key: cascade.has(key, F.col(filters)))
    judged = pages.withColumns({"host": host, "path": path, filters: cascade.filters()})
    return judged.withColumns({
        "rule": rule,
        "verdict": F.coalesce(verdict, F.when(blocked, F.lit("block")).otherwise(F.lit("allow"))),
    }).drop(filters)


URL_SQL = r"""
WITH parts AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
rules(rule_host, rule_path, rule_verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'),
  ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
fitting AS (
  SELECT page_id, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
    arg_max(rule_verdict, length(rule_host || rule_path)) AS rule_verdict
  FROM split JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY page_id),
listed AS (
  SELECT DISTINCT host, TRUE AS listed FROM (
    SELECT DISTINCT host, string_split(host, '.') AS l, unnest(range(1, len(string_split(host, '.')))) AS n FROM split)
  WHERE len(list_intersect(string_split(l[n], '-'), ['adult', 'ads', 'bets', 'casino', 'pills', 'spam', 'track'])) > 0)
SELECT s.page_id, s.host, s.path, rule,
  coalesce(rule_verdict, CASE WHEN listed THEN 'block' ELSE 'allow' END) AS verdict
FROM split s LEFT JOIN fitting f ON s.page_id = f.page_id LEFT JOIN listed b ON s.host = b.host
"""
