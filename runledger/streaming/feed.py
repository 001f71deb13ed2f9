"""The event feed of running jobs as a stream.

Matching and progress are plain columns, evaluated before the shuffle. What depends on
earlier lines of a run (throttle, best progress, idle time) is kept as three numbers per
run in the state store, which must be RocksDB (``session.STATE_STORE``).

A micro-batch brings the new lines of a run to one task, so bound it at the source
(``maxFilesPerTrigger`` or the like), or use ``batches.follow_batches``, which spreads them. Lines that
are not shown lose their text first.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from runledger import schemas
from runledger.functions.runs import micros
from runledger.operators.logs import (
    IDLE_SECONDS, SUB_HEARTBEAT, SUB_LOG, SUB_PROGRESS, annotate,
)
from runledger.registry import Registry

_STATE = "allowed_from_us BIGINT, best INT, last_us BIGINT, beats INT"
_NEVER = -(2**62)


def marked_lines(lines: DataFrame, registry: Registry, interval_sec: float | None) -> DataFrame:
    """Non-empty lines with all that can be told from the line alone."""
    if interval_sec is None:
        interval = registry.interval_us(F.col("converter"))
    else:
        interval = F.lit(round(interval_sec * 1_000_000)).cast("bigint")
    return annotate(lines, registry).select(
        "job_id", "seq", micros(F.col("ts")).alias("us"), "shown", "progress",
        interval.alias("interval_us"), F.col("line").alias("text"),
    )


class FollowRun(StatefulProcessor):
    """Turns the lines of one run, in order of ``seq``, into feed events.

    Idle beats come from the pause before a line. With ``live_beats`` they come from the
    clock instead, while a run is silent; ``give_up_seconds`` of silence end its beats until
    its next line, where a limit is given. What is known of the run stays.
    """

    def __init__(
        self, idle_seconds: float, live_beats: bool, give_up_seconds: float | None,
        forget_after_seconds: float | None,
    ) -> None:
        self.idle_us = round(idle_seconds * 1_000_000)
        self.live_beats = live_beats
        self.most_beats = None if give_up_seconds is None else int(give_up_seconds // idle_seconds)
        self.ttl_ms = None if forget_after_seconds is None else round(forget_after_seconds * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("run", _STATE, self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        job_id = key[0]
        lines = pd.concat(rows).sort_values("seq")
        allowed, best, last = _NEVER, None, None
        if self.state.exists():
            allowed, best, last, _ = self.state.get()
        out = []
        for line in lines.itertuples(index=False):
            if not self.live_beats and last is not None and line.us - last >= self.idle_us:
                beats = int((line.us - last) // self.idle_us)
                out.append((job_id, line.seq, SUB_HEARTBEAT, line.us, "heartbeat", None, beats))
            last = line.us
            if line.shown and (line.interval_us <= 0 or line.us >= allowed):
                out.append((job_id, line.seq, SUB_LOG, line.us, "log", line.text, None))
                allowed = line.us + line.interval_us
            if not pd.isna(line.progress) and (best is None or line.progress > best):
                best = int(line.progress)
                out.append((job_id, line.seq, SUB_PROGRESS, line.us, "progress", None, best))
        self.state.update((int(allowed), best, int(last), 0))
        if self.live_beats:
            self._restart_timer(timerValues)
        if out:
            yield _frame(out)

    def _restart_timer(self, timerValues) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer[0] if isinstance(timer, tuple) else timer)
        now = timerValues.getCurrentProcessingTimeInMs()
        self.handle.registerTimer(now + self.idle_us // 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.state.exists():
            return
        allowed, best, last, beats = self.state.get()
        beats += 1
        expiry = expiredTimerInfo.getExpiryTimeInMs()
        self.state.update((allowed, best, last, beats))
        if self.most_beats is None or beats < self.most_beats:
            self.handle.registerTimer(expiry + self.idle_us // 1000)
        yield _frame([(key[0], None, SUB_HEARTBEAT, expiry * 1000, "heartbeat", None, 1)])

    def close(self) -> None:
        pass


def _frame(events: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(events, columns=schemas.JOB_EVENTS.fieldNames())
    frame["ts"] = pd.to_datetime(frame["ts"], unit="us", utc=True)
    for column in ("seq", "num"):
        frame[column] = frame[column].astype("Int64")
    return frame


def follow(
    lines: DataFrame,
    registry: Registry,
    interval_sec: float | None = None,
    idle_seconds: float = IDLE_SECONDS,
    live_beats: bool = False,
    give_up_seconds: float | None = None,
    forget_after_seconds: float | None = None,
) -> DataFrame:
    """Streaming feed with the rows of ``logs.job_events``, but for the closing events.

    Lines of a run must arrive in order of ``seq`` from one micro-batch to the next; within
    a batch their order does not matter. A few numbers per run are kept for ever, unless
    ``forget_after_seconds`` drops those of runs without lines for that long.
    """
    if idle_seconds <= 0:
        raise ValueError("idle_seconds must be positive")
    clock = live_beats or forget_after_seconds is not None
    return (
        marked_lines(lines, registry, interval_sec)
        .groupBy("job_id")
        .transformWithStateInPandas(
            FollowRun(idle_seconds, live_beats, give_up_seconds, forget_after_seconds),
            outputStructType=schemas.JOB_EVENTS,
            outputMode="Append",
            # With a clock a query never runs out of batches, so it is on only when needed.
            timeMode="ProcessingTime" if clock else "None",
        )
    )
