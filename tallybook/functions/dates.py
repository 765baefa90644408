"""Date rules and text dates."""

import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallybook.constants import SPREADSHEET_EPOCH


def date_floor(date: Column, floor: datetime.date) -> Column:
    """Dates before the floor become the floor; NULL stays NULL."""
    return F.when(date < F.lit(floor), F.lit(floor)).otherwise(date)


def parse_date_or_null(text: Column) -> Column:
    """Month/day/two-digit year (2000-2099), else NULL."""
    return F.try_to_date(text, "M/d/yy")


def parse_mixed_date(text: Column) -> Column:
    """Slashed dates with two or four year digits, or a spreadsheet day number; blank is NULL, other text an error."""
    trimmed = F.trim(text)
    slashed = trimmed.contains("/")
    year_digits = F.length(F.split_part(trimmed, F.lit("/"), F.lit(3)))
    # Spreadsheets write day numbers with a fraction, the time of day, at times.
    day = F.floor(trimmed.try_cast("double")).try_cast("int")
    parsed = (
        F.when(slashed & (year_digits == 4), F.try_to_date(trimmed, "M/d/yyyy"))
        .when(slashed, F.try_to_date(trimmed, "M/d/yy"))
        .otherwise(F.date_add(F.lit(SPREADSHEET_EPOCH), day))
    )
    return parsed_or_error(text, parsed.cast("date"), "a date")


def parsed_or_error(text: Column, parsed: Column, kind: str) -> Column:
    """What was parsed; NULL for blank text; an error that names any other text, so that no line is lost unseen."""
    unreadable = F.raise_error(F.concat(F.lit(f"not {kind}: '"), text, F.lit("'")))
    return F.when(parsed.isNotNull() | text.isNull() | (F.trim(text) == ""), parsed).otherwise(unreadable)


def padded_month(moment: Column) -> Column:
    """``2024-01``."""
    return F.date_format(moment, "yyyy-MM")


def unpadded_month(moment: Column) -> Column:
    """``2024-1``."""
    return F.concat(F.year(moment).cast("string"), F.lit("-"), F.month(moment).cast("string"))


def months_crossed(start: Column, end: Column) -> Column:
    """Number of month boundaries between two moments."""
    return (F.year(end) - F.year(start)) * 12 + F.month(end) - F.month(start)


def age_in_days(start: Column, end: Column) -> Column:
    """Number of dates between two moments, whatever the time of day."""
    return F.datediff(end, start)


def settlement_timing(date: Column, period_end: datetime.date) -> Column:
    end = F.lit(period_end)
    return (
        F.when(date.isNull(), "not_yet_settled")
        .when(date == end, "settled_on_period_end_date")
        .when(date > end, "settled_after_period_end_date")
        .otherwise("settled_before_period_end_date")
    )
