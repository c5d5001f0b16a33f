"""Text field to typed value, one built-in expression per column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerweave.functions.text import stripped


# Whole dates, and dates with a time; the rest is a guess and no value.
DATE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
TIMESTAMP = (
    r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}(:[0-9]{2}([.][0-9]{1,6})?)?"
    r" ?(Z|UTC|[+-][0-9]{2}:?[0-9]{2})?$"
)


def trimmed(raw: Column) -> Column:
    """The text without blanks around it; blank text is NULL."""
    return F.nullif(stripped(raw), F.lit(""))


def typed(text: Column, to: T.DataType) -> Column:
    """A trimmed text as a value of type ``to``; NULL where it does not fit exactly.

    ``try_cast`` keeps one bad field from stopping the load of a whole table. It rounds
    and completes, though; what it would round or complete does not fit.
    """
    if isinstance(to, T.StringType):
        return text
    if isinstance(to, T.BooleanType):
        text = F.lower(text)
    value = text.try_cast(to)
    if isinstance(to, T.DecimalType):
        return F.when(_has_scale(text, value, to), value)
    if isinstance(to, T.DateType):
        return F.when(text.rlike(DATE), value)
    if isinstance(to, (T.TimestampType, T.TimestampNTZType)):
        return F.when(text.rlike(TIMESTAMP), value)
    return value


def _has_scale(text: Column, value: Column, to: T.DecimalType) -> Column:
    """No digit but 0 behind the last one that the type keeps."""
    wide = T.DecimalType(38, 38 - (to.precision - to.scale))
    plain = ~text.rlike(rf"[.][0-9]{{{to.scale}}}[0-9]*[1-9]")
    return F.when(text.rlike("[eE]"), text.try_cast(wide) == value.cast(wide)).otherwise(plain)
