"""Native column expressions on texts shared by several operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The six characters that separate words.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = "[\\x20\\x09-\\x0D]+"
WORD_CHAR = "[^\\x20\\x09-\\x0D]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` computed once, however often `body` uses it.

    A lambda variable holds it: an ordinary column would be inlined into the
    lambdas of `body` and computed again for every element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def text_of(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def words(text: Column) -> Column:
    """Array of the words (runs without the six separators); empty for null."""
    trimmed = F.btrim(text_of(text), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_RUN))


def char_class(characters: str) -> str:
    """Regular expression for one of the given characters."""
    return "[" + "".join("\\" + c if not c.isalnum() and c.isascii() else c for c in characters) + "]"


def n_of(text: Column, characters: str) -> Column:
    """How many characters of the text are one of `characters`."""
    return F.length(text) - F.length(F.regexp_replace(text, char_class(characters), ""))


def n_solid(text: Column) -> Column:
    """How many characters of the text are none of the six separators."""
    return F.length(F.regexp_replace(text, SPACE_RUN, ""))
