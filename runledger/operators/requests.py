"""Checking run requests and turning accepted ones into run records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runledger.functions import flags as FL
from runledger.functions.text import is_yes, strip
from runledger.registry import Converter, Registry


def _text(form: Column, key: str) -> Column:
    return strip(F.coalesce(F.try_element_at(form, F.lit(key)), F.lit("")))


def _reason(conv: Converter, form: Column) -> Column:
    bad_number = F.when(FL.has_bad_number(conv, form), "bad_number")
    if conv.root_rule is None:
        return bad_number
    in_place = _text(form, "root_subpath").rlike(rf"\A(?:{conv.root_rule})\z")
    return (
        F.when(_text(form, "root") == "", "blank_root")
        .when(~in_place, "bad_subpath")
        .otherwise(bad_number)
    )


def validate(requests: DataFrame, registry: Registry) -> DataFrame:
    """Adds ``reject_reason`` to requests with ``converter`` and ``form``; NULL when accepted.

    ``unknown_converter``, then for converters with a root rule ``blank_root`` and
    ``bad_subpath``, then ``bad_number``.
    """
    form = F.col("form")
    reason = registry.choose(
        F.col("converter"), lambda c: _reason(c, form), F.lit("unknown_converter")
    )
    return requests.withColumn("reject_reason", reason)


def accepted(validated: DataFrame) -> DataFrame:
    return validated.where(F.col("reject_reason").isNull()).drop("reject_reason")


def rejected(validated: DataFrame) -> DataFrame:
    return validated.where(F.col("reject_reason").isNotNull())


def _stored_form(conv: Converter) -> Column:
    """Form as kept with the run: missing checkboxes filled in, "on" written as true."""
    form = F.col("form")
    boxes = [f.key for f in conv.flags if f.type == "checkbox"]
    switch = is_yes(F.try_element_at(form, F.lit("auto_remove"))).cast("string")
    fixed = F.map_from_arrays(
        F.array(*[F.lit(k) for k in [*boxes, "auto_remove"]]),
        F.array(
            *[
                F.when(F.try_element_at(form, F.lit(k)) == "on", "true").otherwise(
                    F.coalesce(F.try_element_at(form, F.lit(k)), F.lit("false"))
                )
                for k in boxes
            ],
            switch,
        ),
    )
    others = F.map_filter(form, lambda k, _: ~k.isin([*boxes, "auto_remove"]))
    return F.to_json(F.map_concat(others, fixed))


def new_runs(requests: DataFrame, registry: Registry) -> DataFrame:
    """Run records, all ``running``, for accepted requests.

    Needs ``id, user_id, requested_at, converter, form``; the caller gives the ids.
    """
    form = F.col("form")
    stored = registry.choose(F.col("converter"), _stored_form, F.to_json(form))
    blank = F.lit("")
    return requests.select(
        "id", "user_id", "converter", stored.alias("flags_json"),
        F.coalesce(F.try_element_at(form, F.lit("root")), blank).alias("rinex_path"),
        F.coalesce(F.try_element_at(form, F.lit("out")), blank).alias("output_path"),
        F.lit(None).cast("string").alias("container_id"),
        F.col("requested_at").cast("timestamp").alias("started_at"),
        F.lit(None).cast("timestamp").alias("finished_at"),
        F.lit(None).cast("int").alias("exit_code"),
        F.lit("running").alias("status"),
    )
