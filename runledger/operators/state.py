"""The state of runs kept up to date: a snapshot per version, merged with the writes since.

Of all writes to a run only two can still matter: the last one, and the first one that ended it. They are a maximum and
a minimum, so summaries of parts of the writes merge in any order to that of all, and late or repeated writes need no
special care. A snapshot holds them per run, in buckets by the hash of the run. A refresh reads only files of writes that
no version has read, and only the buckets that these touch.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runledger import schemas

_WRITE = (
    "struct<changed_at: timestamp, pri: int, code: int, status: string, finished_at: timestamp, exit_code: int>"
)
_SUMMARY = f"run_id bigint, last {_WRITE}, first_end {_WRITE}"
_UNKNOWN = -(2**31)


def summarize(writes: DataFrame) -> DataFrame:
    """``run_id, last, first_end``: the writes to a run that may decide its state; ``first_end`` is null while it runs."""
    write = F.struct(
        F.col("changed_at").cast("timestamp").alias("changed_at"), F.col("pri").cast("int").alias("pri"),
        F.coalesce(F.col("exit_code").cast("int"), F.lit(_UNKNOWN)).alias("code"), "status",
        F.col("finished_at").cast("timestamp").alias("finished_at"), F.col("exit_code").cast("int").alias("exit_code"),
    )
    return writes.select(F.col("run_id").cast("bigint").alias("run_id"), write.alias("w")).groupBy("run_id").agg(
        F.max("w").alias("last"), F.min(F.when(F.col("w.status") != "running", F.col("w"))).alias("first_end")
    )


def merge(*summaries: DataFrame) -> DataFrame:
    """One summary of several, in any order."""
    rows = summaries[0]
    for more in summaries[1:]:
        rows = rows.unionByName(more)
    return rows.groupBy("run_id").agg(F.max("last").alias("last"), F.min("first_end").alias("first_end"))


def state_of(summary: DataFrame, policy: str = "last_writer") -> DataFrame:
    """Like ``history.current_state`` over the writes summarized."""
    if policy == "last_writer":
        decides: Column = F.col("last")
    elif policy == "first_terminal":
        decides = F.coalesce("first_end", "last")
    else:
        raise ValueError(f"unknown policy: {policy}")
    return summary.select("run_id", *(decides[c].alias(c) for c in ("status", "finished_at", "exit_code")))


@dataclass(frozen=True)
class Snapshots:
    """Versions of the state of runs below ``path``, made from the files of writes below ``writes_path``.

    A version is there once its list of buckets is written; what a refresh that failed left behind is written over.
    One process refreshes at a time. ``buckets`` is fixed by the first version.
    """

    path: str
    writes_path: str
    buckets: int = 64

    def _folder(self, kind: str, version: int | None = None) -> str:
        whole = f"{self.path.rstrip('/')}/{kind}"
        return whole if version is None else f"{whole}/version={version}"

    def version(self, spark: SparkSession) -> int | None:
        """The newest version; None before the first refresh."""
        folder = spark._jvm.org.apache.hadoop.fs.Path(self._folder("buckets"))
        files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        if not files.exists(folder):
            return None
        done = [
            int(one.getPath().getName().split("=")[1]) for one in files.listStatus(folder)
            if one.getPath().getName().startswith("version=")
            and files.exists(spark._jvm.org.apache.hadoop.fs.Path(one.getPath(), "_SUCCESS"))
        ]
        return max(done, default=None)

    def _places(self, spark: SparkSession, version: int | None) -> dict[int, int]:
        """Bucket: the version that wrote it; at most as many as there are buckets."""
        if version is None:
            return {}
        rows = spark.read.schema("bucket int, written bigint, buckets int").parquet(self._folder("buckets", version))
        return {r["bucket"]: r["written"] for r in rows.collect() if r["bucket"] >= 0}

    def _new_files(self, spark: SparkSession, version: int | None) -> list[str]:
        listed = spark.read.schema(schemas.LIFECYCLE).parquet(self.writes_path).inputFiles()
        if version is None:
            return sorted(listed)
        known = spark.read.schema("file string, version bigint").parquet(self._folder("files")).where(
            F.col("version") <= version
        )
        names = spark.createDataFrame([(name,) for name in listed], "file string")
        return sorted(r["file"] for r in names.join(known, "file", "left_anti").collect())

    def _read(self, spark: SparkSession, places: dict[int, int]) -> DataFrame:
        paths = [f"{self._folder('runs', written)}/bucket={bucket}" for bucket, written in sorted(places.items())]
        if not paths:
            return spark.createDataFrame([], _SUMMARY)
        return spark.read.schema(_SUMMARY).parquet(*paths)

    def refresh(self, spark: SparkSession) -> int | None:
        """Takes in the files of writes that came since; the version that holds them.

        Names of files and of buckets reach the driver, no writes. Without new files nothing is written; None if there
        never was one. Files of writes are added, not changed. Versions before stay readable.
        """
        version = self.version(spark)
        new = self._new_files(spark, version)
        if not new:
            return version
        number = 0 if version is None else version + 1
        buckets, places = self.buckets, self._places(spark, version)
        if version is not None:
            buckets = spark.read.parquet(self._folder("buckets", version)).first()["buckets"]
        bucket = F.pmod(F.xxhash64("run_id"), F.lit(buckets)).cast("int")
        delta = summarize(spark.read.schema(schemas.LIFECYCLE).parquet(*new))
        delta.withColumn("bucket", bucket).write.mode("overwrite").parquet(self._folder("delta", number))
        delta = spark.read.schema(f"{_SUMMARY}, bucket int").parquet(self._folder("delta", number))
        touched = {r["bucket"] for r in delta.select("bucket").distinct().collect()}
        old = self._read(spark, {b: w for b, w in places.items() if b in touched})
        # Equal runs meet by their hash; a bucket is written by the tasks that hold its runs.
        merge(old, delta.drop("bucket")).withColumn("bucket", bucket).write.mode("overwrite").partitionBy(
            "bucket"
        ).parquet(self._folder("runs", number))
        spark.createDataFrame([(name,) for name in new], "file string").coalesce(1).write.mode("overwrite").parquet(
            self._folder("files", number)
        )
        places |= {b: number for b in touched}
        rows = [(b, w, buckets) for b, w in sorted(places.items())] or [(-1, number, buckets)]
        spark.createDataFrame(rows, "bucket int, written bigint, buckets int").coalesce(1).write.mode(
            "overwrite"
        ).parquet(self._folder("buckets", number))
        folder = spark._jvm.org.apache.hadoop.fs.Path(self._folder("delta", number))
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
        return number

    def summary(self, spark: SparkSession, version: int | None = None) -> DataFrame:
        """The summary of a version, the newest by default; empty before the first."""
        version = self.version(spark) if version is None else version
        return self._read(spark, self._places(spark, version))

    def state(self, spark: SparkSession, policy: str = "last_writer", version: int | None = None) -> DataFrame:
        return state_of(self.summary(spark, version), policy)
