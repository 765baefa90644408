"""Typed report parameters."""

import datetime
from collections.abc import Mapping, Sequence
from dataclasses import dataclass


@dataclass(frozen=True)
class Period:
    """A closed period and the date its dated tables were copied."""

    end: datetime.date
    snapshot_date: datetime.date


@dataclass(frozen=True)
class DateRange:
    start: datetime.date
    end: datetime.date


def parse_date(text: str) -> datetime.date:
    return datetime.date.fromisoformat(text)


def parse_month(text: str) -> datetime.date:
    """First day of ``YYYY-MM``."""
    return datetime.date.fromisoformat(f"{text}-01")


def period_params(values: Mapping[str, str | Sequence[str]]) -> dict:
    """Turn the texts of a parameter form into typed values.

    ``YYYY-MM-DD`` is a date, ``YYYY-MM`` the first of that month, two dates joined by
    ``--`` a range, and a list a tuple of names.
    """

    def typed(value):
        if not isinstance(value, str):
            return tuple(value)
        if "--" in value:
            start, end = value.split("--")
            return DateRange(parse_date(start), parse_date(end))
        return parse_month(value) if len(value) == 7 else parse_date(value)

    return {name: typed(value) for name, value in values.items()}
