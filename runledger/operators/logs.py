"""Log lines: filter, progress, monotonic progress, idle beats, tail and the event feed.

Input has the columns of ``schemas.LOG_LINES``: ``seq`` numbers a run's lines in order
of arrival and ``ts`` does not go back along it. One run may hold a large share of all
lines, so nothing here brings the lines of a run together: each operator first reduces
them in a way that combines on the map side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runledger.functions.progress import matches_any, percent
from runledger.functions.runs import micros, resolve_exit_code
from runledger.operators.throttle import throttle
from runledger.registry import Registry

IDLE_SECONDS = 15

# Lines of one run counted together when a long tail is cut.
TAIL_BLOCK = 1 << 20

# Position of an event among those of the same line.
SUB_HEARTBEAT, SUB_LOG, SUB_PROGRESS, SUB_ERROR, SUB_DONE = range(5)


def non_empty(lines: DataFrame) -> DataFrame:
    """Drops empty lines; blank ones stay."""
    return lines if "shown" in lines.columns else lines.where(F.length("line") > 0)


def shown(registry: Registry) -> Column:
    line = F.col("line")
    # An unregistered converter has no patterns, so all its lines are shown.
    return registry.choose(
        F.col("converter"), lambda c: matches_any(line, c.patterns), F.lit(True)
    )


def matching_lines(lines: DataFrame, registry: Registry) -> DataFrame:
    """Lines that match a pattern of their converter, or all if it has none."""
    keep = F.col("shown") if "shown" in lines.columns else shown(registry)
    return non_empty(lines).where(keep)


def with_progress(lines: DataFrame, registry: Registry) -> DataFrame:
    """Adds ``progress``: the percentage a line states, NULL when none."""
    if "progress" in lines.columns:
        return lines
    line = F.col("line")
    value = registry.choose(
        F.col("converter"), lambda c: percent(line, c.patterns), F.lit(None).cast("int")
    )
    return non_empty(lines).withColumn("progress", value)


def annotate(lines: DataFrame, registry: Registry) -> DataFrame:
    """Non-empty lines with ``shown`` and ``progress``; text is kept for shown lines only.

    All operators here take such lines and then need no regexes. Where several of them run
    over the same large log, store this once (Parquet) and let each read its few columns.
    """
    marked = with_progress(lines, registry).withColumn("shown", shown(registry))
    return marked.withColumn("line", F.when(F.col("shown"), F.col("line")))


def monotonic_progress(
    lines: DataFrame, registry: Registry, seeds: DataFrame | None = None
) -> DataFrame:
    """``(job_id, seq, ts, progress)`` of lines whose progress tops all earlier ones.

    A value can only be news where it first occurs. So the lines shrink to the first one
    per run and value before any shuffle, and the running maximum sees a row per value.
    ``seeds(job_id, best)`` says what runs have reached before these lines.
    """
    firsts = (
        with_progress(lines, registry)
        .groupBy("job_id", "progress")
        .agg(F.min("seq").alias("seq"), F.min_by("ts", "seq").alias("ts"))
    )
    if seeds is not None:
        # A value reached before stands in front of all lines, and is no news itself.
        reached = seeds.where(F.col("best").isNotNull()).select(
            "job_id", F.col("best").alias("progress"), F.lit(None).cast("bigint").alias("seq"),
            F.lit(None).cast(firsts.schema["ts"].dataType).alias("ts"),
        )
        firsts = firsts.unionByName(reached)
    earlier = (
        Window.partitionBy("job_id").orderBy(F.col("seq").asc_nulls_first())
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    best = F.coalesce(F.max("progress").over(earlier).cast("bigint"), F.lit(-(2**32)))
    # Lines without progress make one group per run, which fails the comparison. Dropping
    # them earlier would be pushed below the regexes and evaluate those twice.
    return (
        firsts.withColumn("best", best)
        .where((F.col("progress") > F.col("best")) & F.col("seq").isNotNull())
        .select("job_id", "seq", "ts", "progress")
    )


def idle_beats(
    lines: DataFrame, idle_seconds: float = IDLE_SECONDS, seeds: DataFrame | None = None
) -> DataFrame:
    """``(job_id, seq, ts, beats)``: full idle periods right before a line, where any.

    Two lines in the same slot of ``idle_seconds`` are closer than that, so pauses lie
    between slots only. The lines shrink to first and last time per run and slot before
    any shuffle; what a run keeps is limited by its length, not by its lines. A run's first line
    has a pause where ``seeds(job_id, last_us)`` has the time it counts from: that of the run's start, or of
    a line before these.
    """
    if idle_seconds <= 0:
        raise ValueError("idle_seconds must be positive")
    idle_us = round(idle_seconds * 1_000_000)
    slot = F.floor(F.col("us") / F.lit(idle_us))
    slots = (
        non_empty(lines)
        .select("job_id", "seq", "ts", micros(F.col("ts")).alias("us"))
        .groupBy("job_id", slot.alias("slot"))
        .agg(
            F.min("seq").alias("seq"), F.min("ts").alias("ts"),
            F.min("us").alias("first_us"), F.max("us").alias("last_us"),
        )
    )
    if seeds is not None:
        none = F.lit(None)
        slots = slots.unionByName(seeds.where(F.col("last_us").isNotNull()).select(
            "job_id", none.cast("bigint").alias("slot"), none.cast("bigint").alias("seq"),
            none.cast(slots.schema["ts"].dataType).alias("ts"), none.cast("bigint").alias("first_us"), "last_us",
        ))
    before = F.lag("last_us").over(
        Window.partitionBy("job_id").orderBy(F.col("slot").asc_nulls_first(), "last_us")
    )
    return (
        slots.withColumn("pause_us", F.col("first_us") - before)
        .where(F.col("pause_us") >= idle_us)
        .select(
            "job_id", "seq", "ts",
            F.floor(F.col("pause_us") / F.lit(idle_us)).cast("bigint").alias("beats"),
        )
    )


def closing_beats(
    lines: DataFrame, ended: DataFrame, idle_seconds: float = IDLE_SECONDS
) -> DataFrame:
    """``(job_id, ts, beats)``: full idle periods right before the end of a run, where any.

    They count from its last line, or from ``started_at`` where it has none and ``ended``
    has that column. Lines shrink to one per run before any shuffle.
    """
    last = non_empty(lines).groupBy("job_id").agg(F.max(micros(F.col("ts"))).alias("last_us"))
    start = micros(F.col("started_at")) if "started_at" in ended.columns else F.lit(None)
    idle_us = F.lit(round(idle_seconds * 1_000_000))
    return (
        ended.select("job_id", "ts", start.cast("bigint").alias("start_us"))
        .join(last, "job_id", "left")
        .withColumn("pause_us", micros(F.col("ts")) - F.coalesce("last_us", "start_us"))
        .where(F.col("pause_us") >= idle_us)
        .select("job_id", "ts", F.floor(F.col("pause_us") / idle_us).cast("bigint").alias("beats"))
    )


def parse_tail(tail: str | int) -> int | None:
    """Number of lines to replay, None for all. Negative counts mean none."""
    if tail == "all":
        return None
    return max(0, int(tail))


def tail_lines(lines: DataFrame, tail: str | int = "all", block: int = TAIL_BLOCK) -> DataFrame:
    """The last ``tail`` non-empty lines of each run.

    Short tails are ranked; each task keeps its own last lines per run before the shuffle.
    That stops helping beyond the planner's limit, so for longer ones lines are counted per
    block of ``seq``, and only the block where the tail begins is ranked. A block holds at
    most ``block`` lines of a run.
    """
    lines = non_empty(lines)
    count = parse_tail(tail)
    if count is None:
        return lines
    if count == 0:
        return lines.limit(0)
    limit = int(
        lines.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000")
    )
    if count <= limit:
        last = Window.partitionBy("job_id").orderBy(F.col("seq").desc())
        return lines.withColumn("_n", F.row_number().over(last)).where(F.col("_n") <= count).drop("_n")

    in_block = F.floor(F.col("seq") / F.lit(block)).alias("_block")
    later = (
        Window.partitionBy("job_id").orderBy(F.col("_block").desc())
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    room = F.lit(count) - F.coalesce(F.sum("_size").over(later), F.lit(0))
    kept = (
        lines.groupBy("job_id", in_block).agg(F.count("*").alias("_size"))
        .withColumn("_room", room)
        .where(F.col("_room") > 0)
    )
    whole = kept.where(F.col("_size") <= F.col("_room")).select(
        "job_id", "_block", (F.col("_block") * block).cast("bigint").alias("_from")
    )
    last = Window.partitionBy("job_id", "_block").orderBy(F.col("seq").desc())
    cut = (
        lines.select("job_id", "seq", in_block)
        .join(kept.where(F.col("_size") > F.col("_room")), ["job_id", "_block"])
        .withColumn("_n", F.row_number().over(last))
        .where(F.col("_n") == F.col("_room"))
        .select("job_id", "_block", F.col("seq").alias("_from"))
    )
    # Joined by block rather than by run, so that a hot run spreads over many tasks.
    return (
        lines.withColumn("_block", in_block)
        .join(whole.unionByName(cut), ["job_id", "_block"])
        .where(F.col("seq") >= F.col("_from"))
        .select(lines.columns)
    )


def _events(df: DataFrame, sub: int, event_type: str, text: Column, num: Column) -> DataFrame:
    return df.select(
        "job_id", "seq", F.lit(sub).alias("sub"), "ts", F.lit(event_type).alias("event_type"),
        text.cast("string").alias("text"), num.cast("int").alias("num"),
    )


def line_events(
    lines: DataFrame,
    registry: Registry,
    interval_sec: float | None = None,
    idle_seconds: float = IDLE_SECONDS,
    seeds: DataFrame | None = None,
    started: DataFrame | None = None,
) -> DataFrame:
    """The events that lines cause: ``heartbeat``, ``log`` and ``progress``; see ``job_events``.

    ``seeds(job_id, allowed_us, best, last_us)`` is what earlier lines left; ``started(job_id, last_us)``
    counts for runs without a last line.
    """
    nothing = F.lit(None)
    heard = seeds
    if started is not None:
        heard = started.select("job_id", "last_us")
        if seeds is not None:
            last = seeds.where(F.col("last_us").isNotNull()).select("job_id", "last_us")
            heard = heard.join(last, "job_id", "left_anti").unionByName(last)
    feed = _events(
        idle_beats(lines, idle_seconds, heard), SUB_HEARTBEAT, "heartbeat", nothing, F.col("beats")
    )
    allowed = None if seeds is None else seeds.where(F.col("allowed_us").isNotNull())
    visible = throttle(matching_lines(lines, registry), registry, interval_sec, allowed)
    feed = feed.unionByName(_events(visible, SUB_LOG, "log", F.col("line"), nothing))
    news = monotonic_progress(lines, registry, seeds)
    return feed.unionByName(_events(news, SUB_PROGRESS, "progress", nothing, F.col("progress")))


def job_events(
    lines: DataFrame,
    registry: Registry,
    ended: DataFrame | None = None,
    interval_sec: float | None = None,
    idle_seconds: float = IDLE_SECONDS,
    started: DataFrame | None = None,
) -> DataFrame:
    """The feed a follower of each run would get, as rows.

    Per line: ``heartbeat`` (``num`` idle periods before it), ``log`` when the line is shown,
    ``progress`` when it tops all before. ``ended`` has ``job_id, ts, exit_code`` and
    ``error`` (text or NULL), and ``started_at`` where known, and adds the beats before the
    end and the closing ``error`` and ``done``, which have no ``seq``. Order by ``job_id, seq`` (nulls last), ``sub``.
    ``started`` has ``job_id, started_at``, from which a run's pause before its first line counts.
    """
    nothing = F.lit(None)
    opened = None
    if started is not None:
        opened = started.select("job_id", micros(F.col("started_at")).alias("last_us"))
    feed = line_events(lines, registry, interval_sec, idle_seconds, started=opened)
    if ended is None:
        return feed
    code = resolve_exit_code(F.col("exit_code"), nothing)

    def closing(sub: Column, kind: str, text: Column, num: Column) -> Column:
        return F.struct(
            nothing.cast("bigint").alias("seq"), F.lit(sub).alias("sub"), F.col("ts"),
            F.lit(kind).alias("event_type"), text.cast("string").alias("text"),
            num.cast("int").alias("num"),
        )

    done = closing(SUB_DONE, "done", nothing, code)
    error = closing(SUB_ERROR, "error", F.col("error"), nothing)
    last = F.when(F.col("error").isNull(), F.array(done)).otherwise(F.array(error, done))
    beats = closing_beats(lines, ended, idle_seconds).withColumn("seq", nothing.cast("bigint"))
    feed = feed.unionByName(_events(beats, SUB_HEARTBEAT, "heartbeat", nothing, F.col("beats")))
    return feed.unionByName(ended.select("job_id", F.inline(last)))
