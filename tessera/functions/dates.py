"""Dates in the spellings that metadata tools write."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SHAPE = r"^\d{4}([:-])\d{2}\1\d{2} \d{2}:\d{2}:\d{2}(\.\d+)?$"


def cleaned(text: Column) -> Column:
    """Text before the first +, with a space between date and time; null for the usual blanks."""
    return F.when(~F.startswith(text, F.lit("0000")), F.replace(F.substring_index(text, "+", 1), F.lit("T"), F.lit(" ")))


def stamp(clean: Column, first_year: int = 1990, last_year: int = 2027) -> Column:
    """A local time stamp of ``cleaned`` text; null for other spellings, impossible dates and years outside the bounds.

    A trailing Z or a negative zone isn't cleaned away, so such text is null.
    """
    plain = F.concat(F.translate(F.substr(clean, F.lit(1), F.lit(10)), ":", "-"), F.substr(clean, F.lit(11), F.lit(16)))
    year = F.substr(clean, F.lit(1), F.lit(4)).try_cast("int")
    return F.when(F.rlike(clean, F.lit(_SHAPE)) & year.between(first_year, last_year), plain.try_cast("timestamp_ntz"))


def parsed(text: Column, first_year: int = 1990, last_year: int = 2027) -> Column:
    """The time stamp of raw text."""
    return stamp(cleaned(text), first_year, last_year)
