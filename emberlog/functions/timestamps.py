"""Timestamps in log lines: a closed list of shapes, anything else is null. Naive ones are UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

_ISO = r"^\d{4}-\d{1,2}-\d{1,2}(T\d{1,2}:\d{1,2}:\d{1,2}(\.\d{1,6})?([+-]\d{2}:?\d{2})?| \d{1,2}:\d{1,2}:\d{1,2}([.,]\d{1,6})?)$"
_CLF = r"^\d{1,2}/[A-Za-z]{3}/\d{4}:\d{1,2}:\d{1,2}:\d{1,2} [+-]\d{4}$"
_SYSLOG = r"^[A-Za-z]{3}\s+\d{1,2}\s+\d{1,2}:\d{1,2}:\d{1,2}$"


def parse_timestamp(text: Column) -> Column:
    """ISO with T (offset or fraction if any), ISO with a space (``.`` or ``,`` before a fraction, no offset), CLF, or
    RFC 3164, whose year is 1900. Brackets around and a ``Z`` at the end are understood."""
    text = F.regexp_replace(strip(text), r"^[\[\]]+|[\[\]]+$", "")
    text = F.regexp_replace(text, "Z$", "+0000")
    padded = F.regexp_replace(text, r"(?<![\d.,+])(\d)(?!\d)", "0$1")
    iso = F.regexp_replace(F.replace(padded, F.lit(","), F.lit(".")), r"([+-]\d{2}):?(\d{2})$", "$1:$2")
    return (
        F.when(text.rlike(_ISO), iso.try_cast("timestamp"))
        .when(text.rlike(_CLF), F.try_to_timestamp(text, F.lit("d/MMM/yyyy:H:m:s Z")))
        .when(text.rlike(_SYSLOG), F.try_to_timestamp(F.concat(F.lit("1900 "), F.regexp_replace(text, r"\s+", " ")), F.lit("yyyy MMM d H:m:s")))
    )
