"""String rules shared by flags, requests and logs, as column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Blank characters trimmed from submitted values: ASCII controls 9-13 and 28-31, the
# space, and the Unicode spaces.
_BLANKS = "".join(
    map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
              0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
)

# Values that switch an option on when read leniently.
_YES = ("on", "true", "1", "yes")


def strip(value: Column) -> Column:
    return F.btrim(value, F.lit(_BLANKS))


def is_yes(value: Column) -> Column:
    """Lenient switch: trimmed, any case; NULL is off."""
    return F.coalesce(F.lower(strip(value.cast("string"))).isin(*_YES), F.lit(False))


def is_integer(value: Column) -> Column:
    """Is the text a whole number? Blanks around it, a sign and single ``_`` are fine."""
    return strip(value).rlike(r"\A[+-]?[0-9]+(?:_[0-9]+)*\z")


def integer_text(value: Column) -> Column:
    """Canonical text of a whole number of any length, NULL for anything else.

    ``' 007 '`` gives ``7``, ``1_000`` gives ``1000``, ``-0`` gives ``0``; ``0.5`` is NULL.
    """
    trimmed = strip(value)
    digits = F.ltrim(F.translate(trimmed, "+-_", ""), F.lit("0"))
    sign = F.when(trimmed.startswith("-"), "-").otherwise("")
    text = F.when(digits == "", "0").otherwise(F.concat(sign, digits))
    return F.when(is_integer(value), text)


def join_path(base: Column, suffix: Column) -> Column:
    """``base`` plus an optional sub-path, whichever slashes surround it."""
    clean = F.btrim(F.translate(strip(suffix), "\\", "/"), F.lit("/"))
    joined = F.concat(F.rtrim(base, F.lit("/")), F.lit("/"), clean)
    return F.when(clean == "", base).otherwise(joined)
