"""Partial dates, durations and ages as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Notations of a partial date in the order they are tried.
PARTIAL_DATES = [r"^(\d{4})-(\d{1,2})-(\d{1,2})$", r"^(\d{4})-(\d{1,2})$", r"^(\d{4})(\d{2})(\d{2})$", r"^(\d{4})(\d{2})$", r"^(\d{4})$"]


def partial_date(c: Column) -> Column:
    """Date of a text with year, month and day, a missing month or day being the first; null if no notation fits."""
    tries = []
    for i, pattern in enumerate(PARTIAL_DATES):
        groups = pattern.count("(")
        parts = [F.regexp_extract(c, pattern, k) if k <= groups else F.lit("01") for k in (1, 2, 3)]
        built = F.concat(parts[0], F.lit("-"), F.lpad(parts[1], 2, "0"), F.lit("-"), F.lpad(parts[2], 2, "0")).try_cast("date")
        tries.append(F.when(c.rlike(pattern), built))
    return F.coalesce(*tries)


def partial_year(c: Column) -> Column:
    return F.date_format(partial_date(c), "yyyy")


def date_text(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


def year_text(c: Column) -> Column:
    return F.date_format(c, "yyyy")


def length_ms(pair: Column) -> Column:
    """Milliseconds of a [seconds, nanoseconds] pair."""
    return F.when(F.size(pair) == 2, pair[0] * 1000 + F.floor(pair[1] / 1_000_000))


def duration_text(ms: Column) -> Column:
    """M:SS, or H:MM:SS from an hour on; parts of seconds are cut off."""
    total = F.floor(ms / 1000).cast("bigint")
    h, m, s = F.floor(total / 3600).cast("bigint"), F.floor(total % 3600 / 60).cast("bigint"), total % 60
    short = F.concat(m.cast("string"), F.lit(":"), F.lpad(s.cast("string"), 2, "0"))
    return F.when(h > 0, F.concat(h.cast("string"), F.lit(":"), F.lpad(m.cast("string"), 2, "0"), F.lit(":"), F.lpad(s.cast("string"), 2, "0"))).otherwise(short)


def ticks_to_ms(ticks: Column, numerator: Column, denominator: Column) -> Column:
    """Milliseconds of a length in units of a time base."""
    return F.floor(ticks * 1000 * numerator / denominator).cast("bigint")


def whole_weeks(since: Column, until: Column) -> Column:
    seconds = F.unix_timestamp(until.cast("timestamp")) - F.unix_timestamp(since.cast("timestamp"))
    return F.floor(seconds / (7 * 86400)).cast("bigint")


def is_fresh(created: Column, modified: Column, now: Column, max_weeks: int = 2, max_days: int = 7) -> Column:
    """Whether a cached row is younger than both limits: whole weeks since it was made, days since its file changed."""
    days = (F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(modified.cast("timestamp"))) / 86400
    return (whole_weeks(created, now) < max_weeks) & (days <= max_days)
