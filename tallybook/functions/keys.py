"""Text keys."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def text_id(number: Column) -> Column:
    """Id as text with a trailing marker, so that spreadsheets keep every digit."""
    return F.concat(number.cast("string"), F.lit("x"))


def event_uid(event_id: Column, category: Column) -> Column:
    """Key of an event balance; NULL as soon as one part is NULL."""
    return F.concat(event_id.cast("string"), F.lit("x"), category)


def normalize_key(key: Column) -> Column:
    """Bring both spellings of a key to the one with ``x``."""
    return F.translate(key, "-", "x")
