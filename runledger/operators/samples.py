"""Selecting, binning and pivoting measurement samples.

The programs that do this work are known by their options only, so the exact semantics
here (inclusive cutoff, mean per bin, pivot axes, day list clean-up) are this package's
own choice. Samples have ``year``, ``doy`` and ``site`` next to ``ts, sat, el, tec``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runledger.functions.text import strip

DEFAULT_CUTOFF_DEG = 10.0
DEFAULT_STEP_HOURS = 0.5


def select_samples(
    samples: DataFrame,
    year: int | None = None,
    doy: int | Sequence[int] | None = None,
    station: str | None = None,
    match: str = "exact",
) -> DataFrame:
    """Samples of a year, day(s) of year and station, by exact name or name prefix.

    The conditions are on the partition columns, so other folders are not read.
    """
    if year is not None:
        samples = samples.where(F.col("year") == year)
    if doy is not None:
        days = [doy] if isinstance(doy, int) else list(doy)
        samples = samples.where(F.col("doy").isin(days))
    if station is not None:
        if match == "exact":
            samples = samples.where(F.col("site") == station)
        elif match == "prefix":
            samples = samples.where(F.col("site").startswith(station))
        else:
            raise ValueError(f"unknown match: {match}")
    return samples


def above_cutoff(samples: DataFrame, cutoff_deg: float = DEFAULT_CUTOFF_DEG) -> DataFrame:
    """Samples at or above an elevation in degrees."""
    if not 0 <= cutoff_deg <= 90:
        raise ValueError("the elevation cutoff lies between 0 and 90 degrees")
    return samples.where(F.col("el") >= cutoff_deg)


def time_bins(samples: DataFrame, step_hours: float = DEFAULT_STEP_HOURS) -> DataFrame:
    """Mean and number of samples per site, satellite and time step."""
    step_us = round(step_hours * 3_600_000_000)
    if step_us <= 0:
        raise ValueError("step_hours must be positive")
    bins = F.window("ts", f"{step_us} microseconds")
    return samples.groupBy("site", "sat", bins.alias("bin")).agg(
        F.avg("tec").alias("tec"), F.count("*").alias("samples")
    ).select("site", "sat", F.col("bin.start").alias("bin_start"), "tec", "samples")


def pivot_by_site(
    samples: DataFrame, sites: Sequence[str], keys: Sequence[str] = ("year", "doy")
) -> DataFrame:
    """Mean per day, one column per site. Naming the sites spares a pass to find them."""
    return samples.groupBy(*keys).pivot("site", list(sites)).agg(F.avg("tec"))


def parse_days(spec: Column) -> Column:
    """Array of the days in a list such as ``001,002`` or ``001-365``, sorted, without repeats.

    Parts that are neither a number nor a range are left out, and so are days outside 1-366.
    """
    def number(text: Column) -> Column:
        # Any number of digits is a number; those that no whole number holds are beyond every day.
        return F.coalesce(text.try_cast("int"), F.lit(9999))

    def days_of(part: Column) -> Column:
        first = F.greatest(number(F.substring_index(part, "-", 1)), F.lit(1))
        last = F.least(number(F.substring_index(part, "-", -1)), F.lit(366))
        return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))

    whole = F.transform(F.split(spec, ","), strip)
    parts = F.filter(whole, lambda p: p.rlike(r"\A[0-9]+(?:\s*-\s*[0-9]+)?\z"))
    return F.sort_array(F.array_distinct(F.flatten(F.transform(parts, days_of))))


def _names_both(spec: str, single: str) -> Column:
    return F.col(single).isNotNull() & F.coalesce(strip(F.col(spec)) != "", F.lit(False))


def day_list(requests: DataFrame, spec: str = "days", single: str | None = None) -> DataFrame:
    """One row per requested day from 1 to 366, as ``doy``.

    A single day and a list exclude each other: ``refused_days`` has the requests that name
    both, or a single day that is none.
    """
    days = parse_days(F.col(spec))
    if single is not None:
        one = F.col(single).try_cast("int")
        alone = F.when(one.between(1, 366), F.array(one)).otherwise(F.array().cast("array<int>"))
        requests = requests.where(~_names_both(spec, single))
        days = F.when(F.col(single).isNotNull(), alone).otherwise(days)
    return requests.withColumn("doy", F.explode(days))


def refused_days(requests: DataFrame, spec: str = "days", single: str = "day") -> DataFrame:
    """Requests that ``day_list`` gives no day for, with the ``reason``."""
    one = F.col(single).try_cast("int")
    reason = (
        F.when(_names_both(spec, single), "a single day and a list exclude each other")
        .when(F.col(single).isNotNull() & ~F.coalesce(one.between(1, 366), F.lit(False)), "the day is not from 1 to 366")
    )
    return requests.withColumn("reason", reason).where("reason IS NOT NULL")
