"""Scalar rules on run records."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Exit codes that are not the program's own.
UNKNOWN_EXIT = -1
STOPPED_EXIT = -2


# Closes the list that flags are read in; no flag has this name.
_END = "\u0001end"


def decode_flags(flags_json: Column) -> Column:
    """Stored flags as ``map<string,string>``; anything but a JSON object gives an empty map."""
    empty = F.create_map().cast("map<string,string>")
    # The JSON reader stops after the first value. Only behind one whole value does the list go on to its last element.
    listed = F.from_json(
        F.concat(F.lit("["), flags_json, F.lit(',{"\\u0001end":""}]')),
        "array<map<string,string>>", {"allowSingleQuotes": "false"},
    )
    whole = (F.size(listed) == 2) & F.map_contains_key(F.get(listed, 1), F.lit(_END))
    return F.coalesce(F.when(whole, F.get(listed, 0)), empty)


def micros(moment: Column) -> Column:
    return F.unix_micros(moment.cast("timestamp"))


def duration_seconds(started_at: Column, finished_at: Column) -> Column:
    """Seconds from start to end, NULL while the run goes on."""
    return (micros(finished_at) - micros(started_at)) / F.lit(1_000_000.0)


def resolve_exit_code(seen: Column, looked_up: Column) -> Column:
    """The code the log stream ended with, else one found afterwards, else unknown."""
    return F.coalesce(seen, looked_up, F.lit(UNKNOWN_EXIT)).cast("int")


def status_of(exit_code: Column) -> Column:
    return F.when(exit_code == 0, F.lit("success")).otherwise(F.lit("failed"))


def outcome(exit_code: Column, launch_failed: Column, stopped: Column) -> Column:
    """``struct<status, exit_code>`` of an ended run.

    A run that never launched is an error with the unknown code. A stop by the user
    counts as failed with a code of its own.
    """
    status = F.when(launch_failed, "error").when(stopped, "failed").otherwise(status_of(exit_code))
    code = F.when(launch_failed, UNKNOWN_EXIT).when(stopped, STOPPED_EXIT).otherwise(exit_code)
    return F.struct(status.alias("status"), code.cast("int").alias("exit_code"))
