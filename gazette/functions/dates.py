"""Date builders. Everything is UTC: values without a zone count as UTC, and what can't be read is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values: formats in order of trial, behind ISO 8601 -------------------------------------
FORMATS = (
    "d MMM yyyy HH:mm:ss 'GMT'",
    "d MMM yyyy HH:mm:ss Z",
    "d MMM yyyy HH:mm:ss XXX",
    "yyyy-MM-dd'T'HH:mm:ssXX",
    "yyyy-MM-dd HH:mm:ss",
    "MMM d, yyyy",
    "MMMM d, yyyy",
    "yyyy-MM-dd",
    "M/d/yyyy",
    "d.M.yyyy",
)
ISO = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:?\d{2})?)?$"


def published(text: Column) -> Column:
    """Timestamp of a date text, null if no format fits."""
    bare = F.regexp_replace(text, "^[A-Za-z]{3}, +", "")
    iso = F.when(text.rlike(ISO), F.try_to_timestamp(F.regexp_replace(text, r"([+-]\d{2})(\d{2})$", "$1:$2")))
    return F.coalesce(iso, *[F.try_to_timestamp(bare, F.lit(f)) for f in FORMATS])


def published_or_now(text: Column) -> Column:
    return F.coalesce(published(text), F.current_timestamp())


def entry_date_text(published_text: Column, updated_text: Column) -> Column:
    """The date of publication, else of the last change, else empty; an empty text is none."""
    return F.coalesce(F.nullif(published_text, F.lit("")), F.nullif(updated_text, F.lit("")), F.lit(""))


def day_text(text: Column) -> Column:
    """YYYY-MM-DD of a date text, null if it can't be read."""
    return F.date_format(published(text), "yyyy-MM-dd")


def window_end(day: Column) -> Column:
    """The last microsecond of a day."""
    return F.date_trunc("day", day) + F.expr("INTERVAL '23:59:59.999999' HOUR TO SECOND")


def window_start(day: Column, days_back: int) -> Column:
    return window_end(day) - F.expr(f"INTERVAL {int(days_back)} DAYS")


def in_window(at: Column, start: Column, end: Column) -> Column:
    """Within a window, both ends included."""
    return at.between(start, end)


def is_valid_day(text: Column) -> Column:
    """Empty, "null", or a day of the calendar as YYYY-MM-DD."""
    real = text.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).isNotNull()
    return (text == "") | (F.lower(text) == "null") | F.coalesce(real, F.lit(False))
