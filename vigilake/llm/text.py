"""Column helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: ASCII white space, and a run of it.
BLANKS = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)`, with `value` evaluated once for the row however often `body` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """The runs of characters other than ASCII white space, in order; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_RUN), "")


def filled(line: Column) -> Column:
    """Whether a line has a word; it looks at the leading white space alone."""
    return F.ltrim(line, F.lit(BLANKS)) != ""


def lines(text: Column) -> Column:
    """The newline-separated lines of a text; one empty line for null or an empty text."""
    return F.split(F.coalesce(text, F.lit("")), "\n")


def reversed_prefix_length(a: Column, b: Column) -> Column:
    """How many elements at the end of two arrays agree."""
    return prefix_length(F.reverse(a), F.reverse(b))


def prefix_length(a: Column, b: Column) -> Column:
    """How many elements at the start of two arrays agree."""
    same = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y))
    at = F.array_position(same, False)
    return F.when(at == 0, F.size(same)).otherwise(at - 1).cast("int")


def replace_columns(frame: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """`frame` with `columns` appended; input columns of the same names, in any case, give way."""
    taken = {name.lower() for name in columns}
    kept = [F.col(f"`{name}`") for name in frame.columns if name.lower() not in taken]
    return frame.select(*kept, *[value.alias(name) for name, value in columns.items()])
