"""Numbers and durations as text, and numbers out of text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bytes_text(size: Column) -> Column:
    """1024-based with two decimals, halves to the even one; plain below 1 KB."""
    unit = lambda power, label: F.format_string(f"%.2f {label}", F.bround(size / float(1024**power), 2))
    return (
        F.when(size >= 1024**3, unit(3, "GB")).when(size >= 1024**2, unit(2, "MB")).when(size >= 1024, unit(1, "KB"))
        .otherwise(F.format_string("%d B", size))
    )


def truncated(text: Column, longest: int) -> Column:
    """At most ``longest`` characters, the last three as dots where something is left out."""
    return F.when(F.char_length(text) <= longest, text).otherwise(
        F.lit("...") if longest <= 3 else F.concat(F.substr(text, F.lit(1), F.lit(longest - 3)), F.lit("..."))
    )


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def number_or(text: Column, default: float) -> Column:
    return F.coalesce(F.expr("try_cast(NULL AS DOUBLE)") if text is None else text.try_cast("double"), F.lit(default))


def last_count(text: Column, label: str) -> Column:
    """The last number after ``label`` in a log, 0 if there is none."""
    found = F.regexp_extract_all(text, F.lit(rf"{label}:\s*(\d+)"), F.lit(1))
    return F.coalesce(F.try_element_at(found, F.lit(-1)).cast("bigint"), F.lit(0))


def elapsed_secs(text: Column) -> Column:
    """Seconds of [[days-]hours:]minutes:seconds."""
    part = lambda k: F.coalesce(F.nullif(F.regexp_extract(text, r"^(?:(\d+)-)?(?:(\d+):)?(\d+):(\d+)$", k), F.lit("")).cast("bigint"), F.lit(0))
    good = F.rlike(text, F.lit(r"^(?:(?:\d+-)?\d+:)?\d+:\d+$"))
    return F.when(good, part(1) * 86_400 + part(2) * 3_600 + part(3) * 60 + part(4))


def rational(text: Column) -> Column:
    """a/b or a plain number; null for zero denominators and for anything else."""
    top, bottom = F.substring_index(text, "/", 1).try_cast("double"), F.substring_index(text, "/", -1).try_cast("double")
    return F.when(F.contains(text, F.lit("/")), F.try_divide(top, bottom)).otherwise(text.try_cast("double"))


def metric(text: Column, label: str) -> Column:
    """The number after ``label`` and a colon or equals sign in a tool's output; inf is infinity."""
    found = F.regexp_extract(text, rf"(?i){label}\s*[:=]\s*(inf|-?[0-9]+(?:\.[0-9]+)?)", 1)
    return F.when(F.lower(found) == "inf", float("inf")).otherwise(F.nullif(found, F.lit("")).try_cast("double"))


def eta_text(secs: Column) -> Column:
    """Hours and minutes, minutes and seconds, or seconds; unknown for what is no time."""
    whole = F.when(secs < 1e9, secs.cast("bigint"))
    odd = secs.isNull() | F.isnan(secs) | (secs < 0) | (secs == float("inf"))
    return (
        F.when(odd, "unknown").when(secs >= 86_401, ">24h")
        .when(whole >= 3_600, F.format_string("%dh %dm", F.floor(whole / 3_600), F.floor(whole % 3_600 / 60)))
        .when(whole >= 60, F.format_string("%dm %ds", F.floor(whole / 60), whole % 60)).otherwise(F.format_string("%ds", whole))
    )
