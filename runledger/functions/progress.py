"""Recognising progress in log lines, as plain column expressions.

The regexes are literals, so each task compiles them once, and nothing leaves the JVM.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from runledger.functions.text import strip

# Any case; `.` stops at \n only; \s, \d and \w know Unicode.
_REGEX_FLAGS = "(?idU)"


def _hits(line: Column, pattern: str) -> Column:
    return line.rlike(_REGEX_FLAGS + pattern)


def matches_any(line: Column, patterns: Sequence[str]) -> Column:
    """Does any pattern match? Without patterns every line counts as a match."""
    if not patterns:
        return F.lit(True)
    found = _hits(line, patterns[0])
    for pattern in patterns[1:]:
        found = found | _hits(line, pattern)
    return found


def _number(text: Column) -> Column:
    bare = strip(text)
    return F.when(bare.rlike(r"\A-?[0-9]+\z"), bare.try_cast("double"))


def _percent(numbers: Column) -> Column:
    """One number is a percentage; of several, the first two are done and total."""
    first, second = F.get(numbers, F.lit(0)), F.get(numbers, F.lit(1))
    # A fraction has no lower bound but the type's own; a lone percentage has zero.
    share = F.least(F.lit(100.0), F.greatest(F.lit(-2147483648.0), first / second * 100))
    alone = F.least(F.lit(100.0), F.greatest(F.lit(0.0), first))
    return (
        F.when(second > 0, share.cast("int"))
        .when(first.isNotNull() & second.isNull(), alone.cast("int"))
    )


def _stated(line: Column, pattern: str, groups: int) -> Column:
    found = F.array(*[F.regexp_extract(line, _REGEX_FLAGS + pattern, g + 1) for g in range(groups)])
    numbers = F.filter(F.transform(found, _number), lambda n: n.isNotNull())
    # One step over a list of one keeps the groups from being extracted for each use.
    return F.get(F.transform(F.array(numbers), _percent), F.lit(0))


def percent(line: Column, patterns: Sequence[str]) -> Column:
    """Progress 0-100 stated by a line, NULL when none.

    Patterns are tried in order. One that matches without giving a value (no numeric
    group, or a total that is not positive) leaves the line to the next.
    """
    attempts = []
    for pattern in patterns:
        groups = re.compile(pattern).groups
        if groups:
            attempts.append(F.when(_hits(line, pattern), _stated(line, pattern, groups)))
    return F.coalesce(*attempts) if attempts else F.lit(None).cast("int")
