"""Date parsing that accepts several formats and never raises."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FIRST_MILLI, LAST_MILLI = -62_135_596_800_000, 253_402_300_799_999


def lenient_date(text: Column) -> Column:
    """yyyy-MM-dd, then yyyy, then epoch milliseconds; null when none fits.

    The order matters: a bare year is also a valid number. Milliseconds outside
    the years 1 to 9999 fit nothing.
    """
    number = text.try_cast("bigint")
    millis = F.when(number.between(FIRST_MILLI, LAST_MILLI), number)
    return F.coalesce(
        F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(text, "yyyy-MM-dd")),
        F.when(text.rlike(r"^\d{4}$"), F.try_to_date(text, "yyyy")),
        F.to_date(F.timestamp_millis(millis)),
    )
