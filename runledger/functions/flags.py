"""Effective flag values and argument lists of a run, computed row by row in the JVM.

A converter's flags are one constant array, looked up in the run's form by general rules.
So the code does not grow with the registry, and a form turns into its command without
join or shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from runledger.functions.text import integer_text, is_integer, join_path, strip
from runledger.registry import Converter, Flag

# Checkbox values that count as checked in a form; exact, unlike text.is_yes.
_CHECKED = ("on", "true", "1")


def _text_or_null(value: str | None) -> Column:
    return F.lit(value).cast("string")


def _entry(ordinal: int, flag: Flag, from_form: bool) -> Column:
    kind = "volume" if flag.volume is not None else flag.type
    # What stands in for a key that is missing, is a JSON null, or is submitted blank. A
    # browser leaves out unchecked boxes, so in a form "missing" means off. A null host
    # path is taken by its text. Only numbers return to their default when blank.
    absent = "" if kind == "checkbox" and from_form else flag.default
    null = {"volume": "None", "number": flag.default}.get(kind, "")
    blank = flag.default if kind == "number" else ""
    return F.struct(
        F.lit(ordinal).alias("ordinal"),
        F.lit(flag.name).alias("flag"),
        F.lit(flag.long if flag.subpath_key else flag.name).alias("head"),
        F.lit(kind).alias("kind"),
        F.lit(flag.key).alias("key"),
        F.lit(absent).alias("absent"),
        F.lit(null).alias("null"),
        F.lit(blank).alias("blank"),
        _text_or_null(flag.volume).alias("path"),
        _text_or_null(flag.subpath_key).alias("subpath_key"),
    )


def flag_table(conv: Converter, from_form: bool = True) -> Column:
    """The flags of a converter in registry order, as a constant array of structs."""
    return F.array(*[_entry(i, flag, from_form) for i, flag in enumerate(conv.flags)])


def sent_value(form: Column, key: Column, absent: Column, null: Column) -> Column:
    """Value of a form key, telling a missing key from an explicit JSON null."""
    missing = F.when(F.map_contains_key(form, key), null).otherwise(absent)
    return F.coalesce(F.try_element_at(form, key), missing)


def given_value(kind: Column, sent: Column, blank: Column) -> Column:
    """Text that decides about a flag."""
    return F.when(kind == "volume", strip(sent)).when(sent == "", blank).otherwise(sent)


def parsed_number(kind: Column, given: Column) -> Column:
    return F.when(kind == "number", integer_text(given))


def container_path(form: Column, path: Column, subpath_key: Column) -> Column:
    """Where a volume is mounted, with the form's sub-path for flags that take one."""
    subpath = sent_value(form, subpath_key, F.lit(""), F.lit("None"))
    return F.when(subpath_key.isNull(), path).otherwise(join_path(path, subpath))


def is_bad(kind: Column, given: Column, number: Column) -> Column:
    return (kind == "number") & (given != "") & number.isNull()


def is_emitted(kind: Column, given: Column, number: Column) -> Column:
    return (
        F.when(kind == "checkbox", given.isin(*_CHECKED))
        .when(kind == "number", number.isNotNull())
        .otherwise(given != "")
    )


def arguments(kind: Column, head: Column, path: Column, value: Column) -> Column:
    """What an emitted flag puts on the command line."""
    return (
        F.when(kind == "checkbox", F.array(head))
        .when(kind == "volume", F.array(head, path))
        .otherwise(F.array(head, value))
    )


def command(table: Column, form: Column) -> Column:
    """Arguments of all flags of a run; NULL when a number flag holds no whole number."""
    def given(f: Column) -> Column:
        sent = sent_value(form, f["key"], f["absent"], f["null"])
        path = F.when(f["kind"] == "volume", container_path(form, f["path"], f["subpath_key"]))
        return F.struct(
            f["kind"].alias("kind"), f["head"].alias("head"), path.alias("path"),
            given_value(f["kind"], sent, f["blank"]).alias("given"),
        )

    def parsed(f: Column) -> Column:
        number = parsed_number(f["kind"], f["given"])
        return F.struct(*[f[n].alias(n) for n in ("kind", "head", "path", "given")],
                        number.alias("number"))

    def piece(f: Column) -> Column:
        """Arguments of one flag; none when not emitted, NULL when bad."""
        kind, value, number = f["kind"], f["given"], f["number"]
        args = arguments(kind, f["head"], f["path"], F.coalesce(number, value))
        return (
            F.when(is_emitted(kind, value, number), args)
            .when(~is_bad(kind, value, number), F.array().cast("array<string>"))
        )

    # Flattening gives NULL as soon as one piece is NULL.
    return F.flatten(F.transform(F.transform(F.transform(table, given), parsed), piece))


def has_bad_number(conv: Converter, form: Column) -> Column:
    bad = F.lit(False)
    for flag in conv.flags:
        if flag.type == "number" and flag.volume is None:
            default = F.lit(flag.default)
            sent = sent_value(form, F.lit(flag.key), default, default)
            given = F.when(sent == "", default).otherwise(sent)
            bad = bad | ((given != "") & ~is_integer(given))
    return bad
