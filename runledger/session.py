"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import contextlib
import functools
import sys
import tempfile
import uuid
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import SparkSession

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def build_session(app_name: str = "runledger", **conf: str) -> SparkSession:
    """A session with the settings this package relies on; the master comes from outside."""
    builder = SparkSession.builder.appName(app_name)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.streaming.stateStore.providerClass": STATE_STORE,
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def use_utc(spark: SparkSession) -> SparkSession:
    """Run times are stored without a zone and mean UTC; make the session read them so."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def ship_package(spark: SparkSession) -> SparkSession:
    """Sends this package's Python code along with each job that needs it.

    Call it once where Python workers cannot import the package: it is neither installed
    on the executors nor given with ``--py-files``.
    """
    cloudpickle.register_pickle_by_value(sys.modules["runledger"])
    return spark


@contextlib.contextmanager
def temporary_conf(spark: SparkSession, conf: dict[str, str]) -> Iterator[None]:
    """Session settings for one action."""
    before = {key: spark.conf.get(key, None) for key in conf}
    for key, value in conf.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


@functools.cache
def _local_scratch() -> str:
    return tempfile.mkdtemp(prefix="runledger-")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the folder all executors share (``spark.checkpoint.dir``).

    Only a local master may go without that setting, because there driver and
    executors are one machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        base = _local_scratch()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
