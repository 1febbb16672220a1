"""Reading numbers out of text without failing the job."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBER = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def number(value: Column | str) -> Column:
    """Finite double, or NULL for anything else ("nan", "inf", "12x", "")."""
    text = F.trim(col(value))
    return F.when(text.rlike(_NUMBER), text.try_cast("double"))


def whole_number(value: Column | str) -> Column:
    """Number truncated to a long; 0 when absent or malformed."""
    return F.coalesce(number(value).cast("long"), F.lit(0).cast("long"))
