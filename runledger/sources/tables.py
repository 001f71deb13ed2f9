"""Stored tables: run history, users and run state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runledger import schemas
from runledger.operators.history import start_writes


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.JOB_RUNS).parquet(path)


def read_users(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.USERS).parquet(path)


def read_state_writes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.LIFECYCLE).parquet(path)


def append_runs(runs: DataFrame, runs_path: str, writes_path: str) -> None:
    """Stores new runs, then the write that says they are running.

    Rows are only ever added; ``history.current_state`` finds the state among the writes.
    The caller passes stored or otherwise repeatable ids, as both tables are written from
    the same plan.
    """
    runs.write.mode("append").parquet(runs_path)
    append_state(start_writes(runs), writes_path)


def append_state(writes: DataFrame, path: str) -> None:
    columns = [F.col(f.name).cast(f.dataType).alias(f.name) for f in schemas.LIFECYCLE]
    writes.select(columns).write.mode("append").parquet(path)
