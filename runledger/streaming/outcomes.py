"""Recording how runs end, from a stream of exit notices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from runledger.functions.runs import resolve_exit_code, status_of
from runledger.operators.history import end_writes
from runledger.sources.tables import append_state


def outcome_writes(exits: DataFrame) -> DataFrame:
    """State writes from notices with ``run_id, ts, stream_code, looked_up_code``."""
    code = resolve_exit_code(F.col("stream_code"), F.col("looked_up_code"))
    ended = exits.select("run_id", F.col("ts").alias("finished_at"), code.alias("exit_code"))
    return end_writes(ended.withColumn("status", status_of(F.col("exit_code"))))


def record_outcomes(exits: DataFrame, state_path: str, checkpoint: str) -> StreamingQuery:
    """Appends the outcome of each exit notice to the stored state writes.

    A batch that is repeated after a failure writes its rows again, which
    ``history.current_state`` does not mind.
    """
    def save(batch: DataFrame, _batch_id: int) -> None:
        append_state(outcome_writes(batch), state_path)

    return (
        exits.writeStream.foreachBatch(save)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
