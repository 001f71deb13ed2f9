"""Greedy throttle: a line is shown when enough time has passed since the last one shown.

Which line is shown next depends on the one shown before, so a run is a chain. The chain is
cut into slices that are worked on in parallel:

1. Only the first line at each instant can be shown, so lines shrink to one per run and
   instant. Instants are counted per time bucket.
2. Where the interval is much longer than a bucket, the buckets' first and last instants bound where each
   line shown can lie; buckets that can hold none are dropped. The rest is cut into slices of about ``SLICE_ROWS``.
3. Each slice is a step function: for every time from which showing may be allowed again, when it will
   be allowed after the slice. Starts close to each other soon meet on the same line, so
   this is a short list, and it never reaches further than one interval.
4. The functions of ``GROUP`` slices are composed into one of the same kind, groups in parallel. The groups of a
   run are followed in order, then the slices of each group, groups in parallel again.
5. Each slice picks its lines from its true start.

A task holds the instants of one slice (``SLICE_ROWS`` and a bucket), or the starts of one group: at most the instants
of one interval for each of its slices, and of a run as many for each group. A run's buckets, one per ten seconds of its length or
longer, are read by one task. These steps see only ids and times; the text of the chosen lines is joined at the end.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runledger.functions.runs import micros
from runledger.registry import Registry

SLICE_ROWS = 1 << 16
GROUP = 64
BUCKET_US = 10_000_000

# An interval of this many buckets lets buckets bound where lines are shown.
_NARROW = 64
_NEVER = -(2**62)


def _changes(batch: pa.Table, keys: list[str]) -> np.ndarray:
    """Rows that differ from the row above in some key; the first row does not count."""
    differs = np.zeros(max(0, batch.num_rows - 1), dtype=bool)
    for key in keys:
        column = batch.column(key).combine_chunks()
        unequal = pc.fill_null(pc.not_equal(column[1:], column[:-1]), True)
        differs |= unequal.to_numpy(zero_copy_only=False)
    return np.flatnonzero(differs) + 1


def _whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Regroups sorted batches so that no group is spread over two tables."""
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        if held:
            # Does the new batch go on with the group held back?
            seam = pa.concat_tables([held[-1].slice(held[-1].num_rows - 1), table.slice(0, 1)])
            cuts = _changes(table, keys)
            if not len(_changes(seam, keys)) and not len(cuts):
                held.append(table)
                continue
        else:
            cuts = _changes(table, keys)
            if not len(cuts):
                held.append(table)
                continue
        last = int(cuts[-1]) if len(cuts) else 0
        yield pa.concat_tables([*held, table.slice(0, last)])
        held = [table.slice(last)]
    if held:
        yield pa.concat_tables(held)


class _Slices:
    """Rows of whole slices, sorted by slice and time, with the jump to the next shown row."""

    def __init__(self, table: pa.Table) -> None:
        starts = np.concatenate([[0], _changes(table, ["job_id", "slice"])]).astype(np.int64)
        rows = table.num_rows
        self.first = starts
        self.end = np.append(starts[1:], rows)
        self.group = np.repeat(np.arange(len(starts)), self.end - starts)
        self.us = table.column("us").to_numpy()
        self.interval = table.column("interval_us").to_numpy()
        since_first = self.us - self.us[self.first][self.group]
        # One rising axis for all slices: each gets a band wider than any reach inside it.
        self.band = int(since_first.max() + self.interval.max()) + 1
        self.axis = self.group * self.band + since_first
        self.next = self._row_at(self.group, since_first + self.interval)

    def _row_at(self, group: np.ndarray, since_first: np.ndarray) -> np.ndarray:
        """First row of the slice at or after an offset; the slice's end when there is none."""
        offset = np.clip(since_first, 0, self.band - 1)
        return np.minimum(np.searchsorted(self.axis, group * self.band + offset), self.end[group])

    def entry_rows(self, allowed_from: np.ndarray) -> np.ndarray:
        groups = np.arange(len(self.first))
        return self._row_at(groups, allowed_from - self.us[self.first])

    def chains_from(self, rows: np.ndarray) -> np.ndarray:
        """Mask of the rows shown when each slice starts with the given row."""
        shown = np.zeros(len(self.us), dtype=bool)
        ends = self.end
        while True:
            inside = rows < ends
            rows, ends = rows[inside], ends[inside]
            if not len(rows):
                return shown
            shown[rows] = True
            rows = self.next[rows]

    def last_shown(self) -> np.ndarray:
        """For each row, the last row shown in its slice when that row is shown."""
        here = np.arange(len(self.us))
        last = np.where(self.next < self.end[self.group], self.next, here)
        while True:
            further = last[last]
            if np.array_equal(further, last):
                return last
            last = further


def _possible(
    first: np.ndarray, last: np.ndarray, starts: np.ndarray, shortest: np.ndarray, longest: np.ndarray
) -> np.ndarray:
    """Buckets that may hold a line shown, given their first and last instants, run by run.

    ``starts``: each run's first bucket; ``shortest, longest``: its intervals. The k-th line shown of a run lies
    between two bounds; both move on by an interval and to the next instant that buckets know of.
    """
    ends = np.append(starts[1:], len(first))
    base = first[starts]
    band = int((last[ends - 1] - base).max()) + 3
    most = max(1, 2**62 // band)
    if len(starts) > most:
        cut = starts[most]
        return np.concatenate([
            _possible(first[:cut], last[:cut], starts[:most], shortest[:most], longest[:most]),
            _possible(first[cut:], last[cut:], starts[most:] - cut, shortest[most:], longest[most:]),
        ])
    # One rising axis for all runs: each gets a band wider than its length.
    run = np.repeat(np.arange(len(starts)), ends - starts)
    first_axis, last_axis = (run * band + (us - base[run]) + 1 for us in (first, last))
    live = np.arange(len(starts))
    low = high = np.full(len(starts), _NEVER)
    opened = np.zeros(len(first) + 1, np.int64)

    def place(axis: np.ndarray, us: np.ndarray, side: str = "left") -> np.ndarray:
        return np.searchsorted(axis, live * band + np.clip(us - base[live] + 1, 0, band - 1), side)

    while True:
        at = place(last_axis, low)
        inside = at < ends[live]
        live, low, high, at = live[inside], low[inside], high[inside], at[inside]
        if not len(live):
            return np.cumsum(opened[:-1]) > 0
        low = np.maximum(low, first[at])
        to = place(last_axis, high)
        known = np.minimum(to, ends[live] - 1)
        high = np.where((to < ends[live]) & (high <= first[known]), first[known], last[known])
        np.add.at(opened, at, 1)
        np.add.at(opened, place(first_axis, high, "right"), -1)
        low, high = low + shortest[live], high + longest[live]


def _cut(rows: int, width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The slice of each bucket that may hold a line shown."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches, ["job_id"]):
            starts = np.concatenate([[0], _changes(table, ["job_id"])]).astype(np.int64)
            sizes = np.diff(starts, append=table.num_rows)
            first, last, shortest, longest, count = (
                table.column(c).to_numpy() for c in ("first_us", "last_us", "shortest", "longest", "rows")
            )
            least, most = np.minimum.reduceat(shortest, starts), np.maximum.reduceat(longest, starts)
            keep = np.ones(table.num_rows, dtype=bool)
            narrow = least >= _NARROW * width
            if narrow.any():
                bounded = np.repeat(narrow, sizes)
                own = sizes[narrow]
                keep[bounded] = _possible(
                    first[bounded], last[bounded], np.cumsum(own) - own, least[narrow], most[narrow]
                )
            counted = np.where(keep, count, 0)
            before = np.cumsum(counted) - counted
            number = (before - np.repeat(before[starts], sizes)) // rows
            out = table.select(["job_id", "bucket"]).append_column("slice", pa.array(number))
            yield from out.filter(pa.array(keep)).combine_chunks().to_batches()

    return cut


def _exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per slice: starting from up to ``upto``, showing is allowed again from ``allowed``.

    ``reach`` is one interval behind the slice's first line, beyond which no start lies.
    """
    for table in _whole_groups(batches, ["job_id", "slice"]):
        s = _Slices(table)
        last = s.last_shown()
        # Lines before the slice end before its first line, so no start lies further than one
        # interval behind that line. The row that covers the furthest start is kept as well.
        reach = s.us[s.first] + s.interval[s.first]
        covering = s.entry_rows(reach)
        wanted = np.arange(len(s.us)) <= covering[s.group]
        # Neighbouring starts with one end are one entry.
        same = np.zeros(len(s.us), dtype=bool)
        same[:-1] = (last[1:] == last[:-1]) & (s.group[1:] == s.group[:-1]) & wanted[1:]
        keep = np.flatnonzero(wanted & ~same)
        out = table.select(["job_id", "slice"]).take(pa.array(keep))
        out = out.append_column("upto", pa.array(s.us[keep]))
        out = out.append_column("allowed", pa.array(s.us[last[keep]] + s.interval[last[keep]]))
        out = out.append_column("reach", pa.array(reach[s.group[keep]]))
        yield from out.combine_chunks().to_batches()


def _after(upto: np.ndarray, allowed: np.ndarray, start: np.ndarray) -> np.ndarray:
    """A step function at ``start``; behind its last step nothing is shown."""
    step = np.searchsorted(upto, start)
    return np.where(step < len(upto), allowed[np.minimum(step, len(upto) - 1)], start)


def composed(functions: list[tuple[np.ndarray, np.ndarray]], reach: int) -> tuple[np.ndarray, np.ndarray]:
    """One step function for several in a row; starts up to ``reach`` are told apart."""
    upto, allowed = functions[0]
    for next_upto, next_allowed in functions[1:]:
        allowed = _after(next_upto, next_allowed, allowed)
        if upto[-1] < reach:
            new = slice(*np.searchsorted(next_upto, [upto[-1] + 1, reach + 1]) + np.array([0, 1]))
            upto = np.concatenate([upto, next_upto[new]])
            allowed = np.concatenate([allowed, next_allowed[new]])
        keep = np.append(allowed[1:] != allowed[:-1], True)
        upto, allowed = upto[keep], allowed[keep]
    return upto, allowed


def _functions(table: pa.Table) -> tuple[list[int], list[tuple[np.ndarray, np.ndarray]]]:
    """First rows and step functions of the slices of a table."""
    starts = [0, *_changes(table, ["slice"]).tolist()]
    upto, allowed = (table.column(c).to_numpy() for c in ("upto", "allowed"))
    return starts, [(upto[i:j], allowed[i:j]) for i, j in zip(starts, [*starts[1:], table.num_rows])]


def _by_slices(table: pa.Table, keys: list[str]) -> tuple[np.ndarray, np.ndarray, Iterator[pa.Table]]:
    """First rows, and all rows, of keys with one slice; the tables of keys with several, which have many lines."""
    starts = np.concatenate([[0], _changes(table, keys)]).astype(np.int64)
    ends = np.append(starts[1:], table.num_rows)
    slices = np.concatenate([[0], _changes(table, [*keys, "slice"])])
    one = np.searchsorted(slices, ends) - np.searchsorted(slices, starts) == 1
    several = (table.slice(i, j - i) for i, j in zip(starts[~one].tolist(), ends[~one].tolist()))
    return starts[one], np.flatnonzero(np.repeat(one, ends - starts)), several


def _compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The step function of each group of slices."""
    for whole in _whole_groups(batches, ["job_id", "group"]):
        _, rows, several = _by_slices(whole, ["job_id", "group"])
        out = whole.select(["job_id", "group"]).take(pa.array(rows))
        for name in ("upto", "allowed"):
            out = out.append_column(name, pa.array(whole.column(name).to_numpy()[rows]))
        yield from out.rename_columns(["job_id", "slice", "upto", "allowed"]).combine_chunks().to_batches()
        for table in several:
            _, functions = _functions(table)
            upto, allowed = composed(functions, table.column("reach")[0].as_py())
            out = table.select(["job_id", "group"]).take(pa.array(np.zeros(len(upto), np.int64)))
            out = out.append_column("upto", pa.array(upto)).append_column("allowed", pa.array(allowed))
            yield from out.rename_columns(["job_id", "slice", "upto", "allowed"]).combine_chunks().to_batches()


def _follow(keys: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Goes through the slices of each key in order, from ``start_us``, and states the start of each."""
    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in _whole_groups(batches, keys):
            first, _, several = _by_slices(whole, keys)
            out = whole.select(["job_id", "slice"]).take(pa.array(first))
            out = out.append_column("start_us", pa.array(whole.column("start_us").to_numpy()[first]))
            yield from out.combine_chunks().to_batches()
            for table in several:
                rows, functions = _functions(table)
                start = np.int64(table.column("start_us")[0].as_py())
                starts = []
                for upto, allowed in functions:
                    starts.append(start)
                    start = _after(upto, allowed, start)
                out = table.select(["job_id", "slice"]).take(pa.array(rows))
                out = out.append_column("start_us", pa.array(np.array(starts, np.int64)))
                yield from out.combine_chunks().to_batches()

    return follow


def _pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows shown in each slice, given its start."""
    for table in _whole_groups(batches, ["job_id", "slice"]):
        s = _Slices(table)
        start = table.column("start_us").to_numpy()[s.first]
        shown = s.chains_from(s.entry_rows(start))
        out = table.select(["job_id", "seq"]).filter(pa.array(shown))
        yield from out.combine_chunks().to_batches()


def sliced_instants(timed: DataFrame, width: int, seeds: DataFrame | None, slice_rows: int) -> DataFrame:
    """``job_id, slice, us, seq, interval_us``: the instants that may be shown, cut into slices."""
    at = timed.select("job_id", "seq", micros(F.col("ts")).alias("us"), "interval_us").where(
        F.col("job_id").isNotNull() & F.col("us").isNotNull()
    )
    instants = (
        at.withColumn("bucket", F.floor(F.col("us") / F.lit(width)))
        # The join below asks for this; said here, both uses of the instants share one scan and one shuffle.
        .where(F.col("bucket").isNotNull())
        .groupBy("job_id", "bucket", "us")
        .agg(F.min("seq").alias("seq"), F.max("interval_us").alias("interval_us"))
    )
    if seeds is not None:
        known = seeds.select("job_id", "allowed_us")
        instants = instants.join(known, "job_id", "left").where(
            F.coalesce(F.col("us") >= F.col("allowed_us"), F.lit(True))
        ).drop("allowed_us")
    buckets = instants.groupBy("job_id", "bucket").agg(
        F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.count("*").alias("rows"),
        F.min("interval_us").alias("shortest"), F.max("interval_us").alias("longest"),
        # Not used, but with it the plan below is that of the join, so both share one shuffle of the instants.
        F.min("seq").alias("seq"),
    )
    job_type = timed.schema["job_id"].dataType.simpleString()
    # One task reads a run's buckets, which its length bounds, however many lines it has.
    slices = (
        buckets.repartition("job_id").sortWithinPartitions("job_id", "bucket")
        .mapInArrow(_cut(slice_rows, width), f"job_id {job_type}, bucket bigint, slice bigint")
    )
    return (
        instants.join(slices, ["job_id", "bucket"])
        .select("job_id", "slice", "us", "seq", "interval_us")
        # Joins by slice ask for this; said here, both uses of the rows share one shuffle.
        .where(F.col("slice").isNotNull())
        .repartition("job_id", "slice")
    )


def grouped_exits(sliced: DataFrame) -> DataFrame:
    """``job_id, group, slice, upto, allowed, reach``: the steps of each slice's function."""
    job_type = sliced.schema["job_id"].dataType.simpleString()
    exits = sliced.sortWithinPartitions("job_id", "slice", "us").mapInArrow(
        _exits, f"job_id {job_type}, slice bigint, upto bigint, allowed bigint, reach bigint"
    )
    return exits.withColumn("group", F.floor(F.col("slice") / F.lit(GROUP))).repartition("job_id", "group")


def slice_starts(exits: DataFrame) -> DataFrame:
    """``job_id, slice, start_us``: from when showing is allowed as each slice begins."""
    job_type = exits.schema["job_id"].dataType.simpleString()
    steps = exits.sortWithinPartitions("job_id", "group", "slice", "upto").mapInArrow(
        _compose, f"job_id {job_type}, slice bigint, upto bigint, allowed bigint"
    )
    group_starts = (
        steps.withColumn("start_us", F.lit(_NEVER).cast("bigint")).repartition("job_id")
        .sortWithinPartitions("job_id", "slice", "upto")
        .mapInArrow(_follow(["job_id"]), f"job_id {job_type}, slice bigint, start_us bigint")
        .withColumnRenamed("slice", "group")
    )
    return (
        exits.join(group_starts, ["job_id", "group"])
        .sortWithinPartitions("job_id", "group", "slice", "upto")
        .mapInArrow(_follow(["job_id", "group"]), f"job_id {job_type}, slice bigint, start_us bigint")
    )


def throttle(
    lines: DataFrame,
    registry: Registry,
    interval_sec: float | None = None,
    seeds: DataFrame | None = None,
    slice_rows: int = SLICE_ROWS,
    bucket_us: int = BUCKET_US,
) -> DataFrame:
    """The lines shown to a follower, at least ``interval_sec`` apart within each run.

    Without ``interval_sec`` each converter has its own. Zero or less shows every line.
    Expects lines that may be shown (``logs.matching_lines``) with unique ``job_id, seq``. ``seeds(job_id, allowed_us)``
    says from when lines of a run may be shown at all, one row per run at most.
    """
    if interval_sec is None:
        interval = registry.interval_us(F.col("converter"))
        seconds = [registry.default_interval_sec, *map(registry.interval_of, registry.converters)]
        shortest, longest = round(min(seconds) * 1_000_000), round(max(seconds) * 1_000_000)
    else:
        shortest = longest = round(interval_sec * 1_000_000)
        interval = F.lit(longest).cast("bigint")
    if longest <= 0:
        return lines
    timed = lines.withColumn("interval_us", interval)
    free = None
    if shortest <= 0:
        free = timed.where(F.col("interval_us") <= 0).drop("interval_us")
        timed = timed.where(F.col("interval_us") > 0)

    width = max(bucket_us, longest // 1024)
    sliced = sliced_instants(timed, width, seeds, slice_rows)
    starts = slice_starts(grouped_exits(sliced))
    job_type = lines.schema["job_id"].dataType.simpleString()
    shown = (
        sliced.join(starts, ["job_id", "slice"])
        .sortWithinPartitions("job_id", "slice", "us")
        .mapInArrow(_pick, f"job_id {job_type}, seq bigint")
    )
    result = timed.drop("interval_us").join(shown, ["job_id", "seq"], "left_semi")
    return result if free is None else result.unionByName(free)
