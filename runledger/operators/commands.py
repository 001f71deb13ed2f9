"""Effective flags and argument lists of past or requested runs; no shuffle anywhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runledger.functions import flags as FL
from runledger.operators.history import with_flags
from runledger.registry import Converter, Registry


def effective_flags(runs: DataFrame, registry: Registry, from_form: bool = True) -> DataFrame:
    """One row per run and flag of its converter.

    ``value`` is the submitted value or the default under the rules of the flag's type,
    ``emitted`` tells whether it goes on the command line, ``bad`` marks number flags that
    hold no whole number. ``from_form`` treats missing checkboxes as unchecked.
    """
    table = registry.choose(
        F.col("converter"), lambda c: FL.flag_table(c, from_form), F.lit(None)
    )
    form, kind, given = F.col("flags"), F.col("kind"), F.col("given")
    number = F.col("number")
    sent = FL.sent_value(form, F.col("key"), F.col("absent"), F.col("null"))
    # The outer form keeps the optimizer from adding a check for empty tables.
    rows = (
        with_flags(runs)
        .select("id", "converter", "flags", F.inline_outer(table))
        .where(F.col("ordinal").isNotNull())
        .withColumn("sent", sent)
        .withColumn("given", FL.given_value(kind, F.col("sent"), F.col("blank")))
        .withColumn("number", FL.parsed_number(kind, given))
        .withColumn("emitted", FL.is_emitted(kind, given, number))
        .withColumn("bad", FL.is_bad(kind, given, number))
    )
    value = F.coalesce(number, given)
    checked = F.col("emitted").cast("string")
    path = FL.container_path(form, F.col("path"), F.col("subpath_key"))
    args = FL.arguments(kind, F.col("head"), path, value)
    return rows.select(
        "id", "converter", "ordinal", "flag",
        F.when(kind == "checkbox", checked).otherwise(value).alias("value"), "emitted", "bad",
        F.when(F.col("emitted"), args).otherwise(F.array().cast("array<string>")).alias("args"),
    )


def run_commands(runs: DataFrame, registry: Registry, from_form: bool = True) -> DataFrame:
    """``(id, converter, command)``: the argument list each run was started with.

    NULL for unregistered converters and for runs whose number flags cannot be read.
    """
    form = F.col("flags")

    def command(conv: Converter) -> Column:
        args = FL.command(FL.flag_table(conv, from_form), form)
        fixed = [F.lit(a) for a in conv.fixed_args]
        return F.concat(args, F.array(*fixed)) if fixed else args

    line = registry.choose(F.col("converter"), command, F.lit(None).cast("array<string>"))
    return with_flags(runs).select("id", "converter", line.alias("command"))
