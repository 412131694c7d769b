"""Integer instants whose unit follows from their size."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Every true instant lies in the years 2020-2029 (UTC): first second of 2020
#: and of 2030.  The ranges of the four units are disjoint.
FIRST_SEC, AFTER_SEC = 1_577_836_800, 1_893_456_000


def int_to_ms(c: Column, first: int = FIRST_SEC, after: int = AFTER_SEC) -> Column:
    """Milliseconds (cut) of an integer in s, ms, us or ns; NULL if no unit gives an instant in [first, after) seconds.

    The units' ranges must be disjoint: ``after`` at most 1000 times ``first``."""
    if not 0 < first < after <= 1000 * first:
        raise ValueError("the range of instants must tell units apart")
    c = c.cast("bigint")

    def fits(unit: int) -> Column:
        return (c >= first * unit) & (c < after * unit)

    return (
        F.when(fits(1), c * 1000)
        .when(fits(1_000), c)
        .when(fits(1_000_000), F.call_function("div", c, F.lit(1_000)))
        .when(fits(1_000_000_000), F.call_function("div", c, F.lit(1_000_000)))
    )
