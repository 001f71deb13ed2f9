"""Converters as data: labels, log patterns and flags.

Adding a converter means adding rows here (or building a ``Registry`` of one's own);
the log, flag and command operators turn the rows into column expressions. The rows are
code-sized by construction, so operators inline them as literals instead of joining.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runledger import schemas

DEFAULT_EMIT_INTERVAL_SEC = 0.5


@dataclass(frozen=True)
class Flag:
    name: str
    long: str
    type: str  # checkbox | number | text | select
    default: str = ""  # checkboxes: "true" or ""
    required: bool = False
    volume: str | None = None  # container path this flag is mounted on
    subpath_key: str | None = None  # form key joined to the volume; such flags use the long name
    min: int | None = None
    max: int | None = None
    options: tuple[str, ...] = ()

    @property
    def key(self) -> str:
        """Name of the value in a submitted form."""
        return self.long.lstrip("-").replace("-", "_")


@dataclass(frozen=True)
class Converter:
    name: str
    label: str
    patterns: tuple[str, ...] = ()
    flags: tuple[Flag, ...] = ()
    emit_interval_sec: float | None = None
    fixed_args: tuple[str, ...] = ()
    # Requests for converters with a root rule must name a root and a matching sub-path.
    root_rule: str | None = None

    def __post_init__(self) -> None:
        for pattern in self.patterns:
            re.compile(pattern)


@dataclass(frozen=True)
class Registry:
    converters: tuple[Converter, ...] = ()
    default_interval_sec: float = DEFAULT_EMIT_INTERVAL_SEC
    _by_name: dict[str, Converter] = field(init=False, repr=False, compare=False)

    def __post_init__(self) -> None:
        object.__setattr__(self, "_by_name", {c.name: c for c in self.converters})

    def get(self, name: str) -> Converter | None:
        return self._by_name.get(name)

    def interval_of(self, converter: Converter) -> float:
        own = converter.emit_interval_sec
        return self.default_interval_sec if own is None else own

    def choose(
        self, converter: Column, value: Callable[[Converter], Column], otherwise: Column
    ) -> Column:
        """``value(c)`` for the row's converter, ``otherwise`` when it is not registered."""
        chosen = None
        for conv in self.converters:
            hit = converter == F.lit(conv.name)
            chosen = F.when(hit, value(conv)) if chosen is None else chosen.when(hit, value(conv))
        return otherwise if chosen is None else chosen.otherwise(otherwise)

    def label_of(self, converter: Column) -> Column:
        """Label for a converter, its raw name when unregistered."""
        return self.choose(converter, lambda c: F.lit(c.label), converter)

    def interval_us(self, converter: Column) -> Column:
        """Least time between two shown log lines, in microseconds."""
        def micros(seconds: float) -> Column:
            return F.lit(round(seconds * 1_000_000)).cast("bigint")

        return self.choose(
            converter, lambda c: micros(self.interval_of(c)), micros(self.default_interval_sec)
        )

    # The same rows as small dimension tables, for users who want to query them.

    def converters_df(self, spark: SparkSession) -> DataFrame:
        rows = [(c.name, c.label, float(self.interval_of(c))) for c in self.converters]
        return spark.createDataFrame(rows, schemas.CONVERTERS)

    def patterns_df(self, spark: SparkSession) -> DataFrame:
        rows = [(c.name, i, p) for c in self.converters for i, p in enumerate(c.patterns)]
        return spark.createDataFrame(rows, schemas.PROGRESS_PATTERNS)

    def flags_df(self, spark: SparkSession) -> DataFrame:
        rows = [
            (c.name, i, f.name, f.long, f.type, f.default, f.required, f.volume is not None,
             f.min, f.max, list(f.options))
            for c in self.converters
            for i, f in enumerate(c.flags)
        ]
        return spark.createDataFrame(rows, schemas.FLAGS)


# Names, labels, log patterns, flags, limits and container paths of the
# three converters whose runs the tables record.

_SUITE = "tec-suite"
_DAT = "dat-parquet-handler"
_ABS = "abstec-suite"

_SUITE_PATTERNS = (
    r"===\s*processing\s+day\s+folder:\s*([^\s]+)\s*===",
    r"Completed.*?(\d+)\s*/\s*(\d+):\s+([\w.]+)",
)
_DAT_PATTERNS = (
    r"Completed\s+(\d+)\s*/\s*(\d+)",
    r"Progress:\s*(\d{1,3})\s*%",
)
_ABS_PATTERNS = (
    r"Processing\s+year=\d{4}\s+day=\d{1,3}\s+site=[^\s]+\s*\((\d+)\s*/\s*(\d+)\)",
    # One pattern, not two: a plain "Completed 3 / 9" line is not recognised for this
    # converter, and neither is "Organized station output ..." on its own.
    r"Organized station output under day folder:Completed\s+(\d+)\s*/\s*(\d+)",
    r"Progress:\s*(\d{1,3})\s*%",
)

_SUITE_FLAGS = (
    Flag("-r", "--root", "text", required=True, volume="/data/rinex", subpath_key="root_subpath"),
    Flag("-j", "--jobs", "number", default="4", min=1, max=64),
    Flag("-v", "--verbose", "checkbox"),
    Flag("-k", "--cleanup", "checkbox", default="true"),
)
_DAT_FLAGS = (
    Flag("--direction", "--direction", "select", default="dat-to-parquet", required=True,
         options=("dat-to-parquet", "parquet-to-dat")),
    Flag("-s", "--src", "text", required=True, volume="/data/src"),
    Flag("-d", "--dst", "text", volume="/data/dst"),
    Flag("--overwrite", "--overwrite", "checkbox"),
)
_ABS_FLAGS = (
    Flag("--dat-path", "--dat-path", "text", required=True, volume="/data/in"),
    Flag("--output-dir", "--output-dir", "text", volume="/data/out"),
    Flag("--workdir", "--workdir", "text", default="/data/workdir"),
    Flag("--year", "--year", "number", required=True, min=2000, max=2100),
    Flag("--day-of-year", "--day-of-year", "number", min=1, max=366),
    Flag("--days", "--days", "text"),
    Flag("--site", "--site", "text"),
    Flag("--elevation-cutoff", "--elevation-cutoff", "number", default="10", min=0, max=90),
    Flag("--time-step-hours", "--time-step-hours", "text", default="0.5"),
    Flag("--correction-coefficient", "--correction-coefficient", "text", default="0.97"),
    Flag("--runner", "--runner", "select", default="auto", options=("auto", "wine", "direct")),
    Flag("--execution-timeout-seconds", "--execution-timeout-seconds", "number", min=1),
    Flag("--dry-run", "--dry-run", "checkbox", default="true"),
)


def default_registry() -> Registry:
    # Labels, fixed arguments, intervals and the rule for folders below the root.
    return Registry(
        (
            Converter(_SUITE, "TEC-Suite", _SUITE_PATTERNS, _SUITE_FLAGS,
                      fixed_args=("-c", "/app/tecs.cfg", "-t", "/app/tecs.py"),
                      root_rule=r"/[0-9]{4}_original(?:/[0-9]{2,3})?"),
            Converter(_DAT, "DAT <-> Parquet", _DAT_PATTERNS, _DAT_FLAGS, emit_interval_sec=1.0),
            Converter(_ABS, "AbsTEC Suite", _ABS_PATTERNS, _ABS_FLAGS, emit_interval_sec=1.0),
        )
    )
