"""Calendar expressions (X3–X6).  All are built-in column expressions (codegen)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def month_start(c) -> Column:
    """First day of the month, as a date."""
    return F.trunc(_c(c).cast("date"), "month")


def add_months(c, n: int) -> Column:
    """Month start shifted by n months."""
    return F.add_months(month_start(c), n)


def month_end(c) -> Column:
    """Last day of the month."""
    return F.last_day(_c(c).cast("date"))


def month_text_bounds(text) -> tuple[Column, Column]:
    """X3: 'YYYY-MM' → (first day, last day); null for unparsable text."""
    first = F.to_date(F.try_to_timestamp(F.concat(_c(text), F.lit("-01")), F.lit("yyyy-MM-dd")))
    return first, F.last_day(first)


def batch_month(batch_id, as_of) -> Column:
    """X4: 'monthly_YYYYMMDD_HHMMSS' → month start of that date; otherwise the month after
    ``as_of``."""
    digits = F.regexp_extract(_c(batch_id), r"^monthly_(\d{8})_\d{6}$", 1)
    parsed = F.to_date(F.try_to_timestamp(digits, F.lit("yyyyMMdd")))
    fallback = F.add_months(month_start(as_of), 1)
    return F.when(digits != "", month_start(parsed)).otherwise(fallback)


def elapsed_days(ts, as_of) -> Column:
    """Whole days from ``ts`` to ``as_of`` (floor of the elapsed time)."""
    return F.floor((F.unix_timestamp(_c(as_of).cast("timestamp"))
                    - F.unix_timestamp(_c(ts).cast("timestamp"))) / 86400).cast("long")


def elapsed_days_fraction(ts, as_of) -> Column:
    """Elapsed seconds / 86400 (fractional days)."""
    return (F.unix_timestamp(_c(as_of).cast("timestamp"))
            - F.unix_timestamp(_c(ts).cast("timestamp"))) / 86400.0


def weekday0(d) -> Column:
    """Weekday with Monday = 0 ... Sunday = 6."""
    return F.weekday(_c(d))


def calendar_parts(d) -> list[Column]:
    """Weekday (Mon=0), weekday name, day, month, quarter, weekend flag, Sunday flag."""
    d = _c(d)
    wd = F.weekday(d)
    return [wd.alias("day_of_week"), F.date_format(d, "EEEE").alias("weekday_name"),
            F.dayofmonth(d).alias("day_of_month"), F.month(d).alias("month"),
            F.quarter(d).alias("quarter"), (wd >= 5).alias("is_weekend"), (wd == 6).alias("is_sunday")]
