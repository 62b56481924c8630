"""Date functions: metadata dates, dates in file names, fallbacks and keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def metadata_date(value: Column) -> Column:
    """``YYYY:MM:DD hh:mm:ss`` with optional fraction and zone, or ISO; the zone is dropped; null if neither."""
    text = F.trim(value)
    plain = F.regexp_replace(text, r"([+-]\d{2}:?\d{2}|Z)$", "")
    iso = F.regexp_replace(plain, r"^(\d{4}):(\d{2}):(\d{2})", "$1-$2-$3")
    return F.try_to_timestamp(F.when(iso.rlike(r"^\d{4}-\d{2}-\d{2}([ T]\d{2}:\d{2}(:\d{2}(\.\d+)?)?)?$"), iso)).cast("timestamp_ntz")


def name_date(name: Column) -> Column:
    """A date and time in a file name, or a date alone at noon; an impossible one is null."""
    digits = lambda pattern: F.regexp_extract(name, pattern, 0)
    full = F.regexp_replace(digits(r"(?<!\d)(19|20)\d{2}[-_]?\d{2}[-_]?\d{2}[-_ T]?\d{2}[-_.]?\d{2}[-_.]?\d{2}(?!\d)"), r"\D", "")
    day = F.regexp_replace(digits(r"(?<!\d)(19|20)\d{2}[-_]?\d{2}[-_]?\d{2}(?!\d)"), r"\D", "")
    cut = lambda x: F.concat_ws("-", F.substring(x, 1, 4), F.substring(x, 5, 2), F.substring(x, 7, 2))
    moment = F.concat(cut(full), F.lit(" "), F.concat_ws(":", F.substring(full, 9, 2), F.substring(full, 11, 2), F.substring(full, 13, 2)))
    return F.coalesce(
        F.try_to_timestamp(F.when(F.length(full) == 14, moment)), F.try_to_timestamp(F.when(F.length(day) == 8, F.concat(cut(day), F.lit(" 12:00:00"))))
    ).cast("timestamp_ntz")


def capture_date(metadata: list[Column], name: Column, mtime: Column) -> Column:
    """The first that is known: metadata dates in turn, the file name, the file's time.

    The turn of metadata: original, created, the two of XMP (date created, created), modified.
    """
    return F.coalesce(*map(metadata_date, metadata), name_date(name), mtime)


def seconds_apart(a: Column, b: Column) -> Column:
    return F.abs(F.unix_micros(a.cast("timestamp")) - F.unix_micros(b.cast("timestamp"))) / F.lit(1e6)


def same_moment(a: Column, b: Column) -> Column:
    """Less than a second apart; two unknown times are the same."""
    return F.coalesce(seconds_apart(a, b) < 1, a.isNull() & b.isNull())


def iso_seconds(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")


def duration(seconds: Column) -> Column:
    """``1h 2m``, ``3m 4s`` or ``5s``."""
    s = F.round(seconds).cast("long")
    hours, minutes = F.floor(s / 3600), F.floor(s % 3600 / 60)
    return F.when(hours > 0, F.format_string("%dh %dm", hours, minutes)).when(minutes > 0, F.format_string("%dm %ds", minutes, s % 60)).otherwise(F.format_string("%ds", s))


def backoff_seconds(failures: Column) -> Column:
    """120 s doubled per failure, at most an hour."""
    return F.least(F.lit(120.0) * F.pow(F.lit(2.0), failures - 1), F.lit(3600.0))
