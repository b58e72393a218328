"""Text helpers used by several jobs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space a script-language trim removes.
_BLANK = " \t\n\r\f\x0b\xa0\ufeff"


def trimmed(c: Column) -> Column:
    """Trim tabs, newlines and no-break spaces as well as blanks."""
    return F.btrim(c, F.lit(_BLANK))


def lines_of(c: Column) -> Column:
    """Lines of a text; empty lines at the end are kept."""
    return F.split(c, "\n", -1)


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def is_comment(line: Column) -> Column:
    """A line whose first visible characters open or continue a comment."""
    head = F.ltrim(line, F.lit(_BLANK))
    return head.startswith("//") | head.startswith("*") | head.startswith("/*")


def rank_of(value: Column, ordered: list[str]) -> Column:
    """Position of ``value`` in ``ordered`` (0-based); unknown values come last."""
    out = F.lit(len(ordered))
    for i, name in reversed(list(enumerate(ordered))):
        out = F.when(value == name, F.lit(i)).otherwise(out)
    return out
