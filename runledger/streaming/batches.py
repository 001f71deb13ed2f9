"""The event feed of running jobs as a stream of batches, each seeded with what the one before left.

What a run's next events depend on is four numbers: from when a line may be shown again, the best progress, and time and
number of its last line. They lie in a table with one version per batch. A batch runs the distributed batch operators
over its lines from these seeds, so a run with very many lines is spread like in ``logs.job_events``. Numbers only
grow, so a new version is the maximum of old and new. Events, late lines and state of a batch are written to folders
named by its number: a batch that is run again reads the same version and replaces its own output.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from runledger import schemas
from runledger.functions.runs import micros
from runledger.operators.logs import IDLE_SECONDS, line_events, shown, with_progress
from runledger.registry import Registry

_STATE = "job_id {0}, allowed_us bigint, best int, last_us bigint, last_seq bigint"
_GREATEST = ("allowed_us", "best", "last_us", "last_seq")


@dataclass(frozen=True)
class Feed:
    """Where a feed keeps its events, late lines and state; one checkpoint per feed."""

    path: str

    def folder(self, kind: str, batch: int) -> str:
        return f"{self.path.rstrip('/')}/{kind}/batch={batch}"

    def _read(self, spark: SparkSession, kind: str, schema) -> DataFrame:
        return spark.read.schema(schema).parquet(f"{self.path.rstrip('/')}/{kind}")

    def events(self, spark: SparkSession) -> DataFrame:
        return self._read(spark, "events", schemas.JOB_EVENTS).select(*schemas.JOB_EVENTS.fieldNames())

    def late(self, spark: SparkSession) -> DataFrame:
        """Lines that came after a later one of their run, or again."""
        return self._read(spark, "late", schemas.LOG_LINES).select(*schemas.LOG_LINES.fieldNames())

    def state(self, spark: SparkSession, batch: int, job_type: str = "bigint") -> DataFrame:
        """What is known after a batch; nothing before the first one."""
        if batch < 0:
            return spark.createDataFrame([], _STATE.format(job_type))
        return spark.read.schema(_STATE.format(job_type)).parquet(self.folder("state", batch))

    def drop_state(self, spark: SparkSession, batch: int) -> None:
        if batch >= 0:
            path = spark._jvm.org.apache.hadoop.fs.Path(self.folder("state", batch))
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def split_late(lines: DataFrame, state: DataFrame) -> DataFrame:
    """``lines`` with ``late``: whether the run has had this or a later number before, or has it twice here."""
    again = F.row_number().over(Window.partitionBy("job_id", "seq").orderBy("ts", "line")) > 1
    known = state.select("job_id", "last_seq")
    behind = F.coalesce(F.col("seq") <= F.col("last_seq"), F.lit(False))
    return (
        lines.withColumn("_again", again).join(known, "job_id", "left")
        .withColumn("late", F.col("_again") | behind).drop("_again", "last_seq")
    )


def _newer(state: DataFrame, lines: DataFrame, events: DataFrame, interval: F.Column) -> DataFrame:
    heard = lines.groupBy("job_id").agg(
        F.max("progress").alias("best"), F.max(micros(F.col("ts"))).alias("last_us"),
        F.max("seq").alias("last_seq"), F.max(interval).alias("interval_us"),
    )
    shown = events.where("event_type = 'log'").groupBy("job_id").agg(F.max(micros(F.col("ts"))).alias("shown_us"))
    new = heard.join(shown, "job_id", "left").select(
        "job_id", (F.col("shown_us") + F.col("interval_us")).alias("allowed_us"), "best", "last_us", "last_seq"
    )
    return state.unionByName(new).groupBy("job_id").agg(*(F.max(c).alias(c) for c in _GREATEST))


def follow_batches(
    lines: DataFrame,
    registry: Registry,
    feed: Feed,
    checkpoint: str,
    interval_sec: float | None = None,
    idle_seconds: float = IDLE_SECONDS,
    started: Callable[[], DataFrame] | None = None,
    ended: Callable[[], DataFrame] | None = None,
    **trigger: object,
) -> StreamingQuery:
    """Starts a query that adds the events of ``logs.job_events``, but for the closing ones, to ``feed``.

    Lines that came late or again take no part and go to ``feed.late``. Each batch asks ``started`` for ``job_id,
    started_at``, from which a run's pause before its first line counts, and ``ended`` for the ``job_id`` of runs whose
    numbers may be dropped; a run that goes on afterwards starts anew. ``trigger`` is as for ``DataStreamWriter.trigger``.
    """
    if interval_sec is None:
        interval = registry.interval_us(F.col("converter"))
    else:
        interval = F.lit(round(interval_sec * 1_000_000)).cast("bigint")
    job_type = lines.schema["job_id"].dataType.simpleString()

    def one(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        state = feed.state(spark, number - 1, job_type)
        # Read once from the source, patterns tried once per line; a lost part is read from there again.
        lines = batch.where(F.length("line") > 0)
        marked = split_late(with_progress(lines, registry).withColumn("shown", shown(registry)), state).persist()
        try:
            marked.where("late").select(*schemas.LOG_LINES.fieldNames()).write.mode("overwrite").parquet(
                feed.folder("late", number)
            )
            fresh = marked.where("NOT late").drop("late").withColumn("line", F.when(F.col("shown"), F.col("line")))
            opened = None
            if started is not None:
                opened = started().select("job_id", micros(F.col("started_at")).alias("last_us"))
            line_events(fresh, registry, interval_sec, idle_seconds, state, opened).write.mode("overwrite").parquet(
                feed.folder("events", number)
            )
            events = spark.read.schema(schemas.JOB_EVENTS).parquet(feed.folder("events", number))
            newer = _newer(state, fresh, events, interval)
            if ended is not None:
                newer = newer.join(ended().select("job_id").distinct(), "job_id", "left_anti")
            newer.write.mode("overwrite").parquet(feed.folder("state", number))
        finally:
            marked.unpersist()
        # The batch before may be run again only as long as this one is not done.
        feed.drop_state(spark, number - 3)

    return (
        lines.select(*schemas.LOG_LINES.fieldNames()).writeStream.foreachBatch(one)
        .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    )
