"""Column helpers: time in a fixed offset, Unicode trim, rounding, scales and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TZ = "+08:00"
DAY_MS, HOUR_MS = 86_400_000, 3_600_000
#: Monday first.
WEEKDAYS = ["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"]


def offset_ms(tz: str = TZ) -> int:
    """Milliseconds of an offset such as +08:00."""
    sign, hours, minutes = (-1 if tz[0] == "-" else 1), int(tz[1:3]), int(tz[4:6])
    return sign * (hours * 60 + minutes) * 60_000


def local_ms(ts_ms: Column, tz: str = TZ) -> Column:
    return ts_ms + F.lit(offset_ms(tz)).cast("long")


def day_number(ts_ms: Column, tz: str = TZ) -> Column:
    """Days since 1970-01-01; does not depend on the session's time zone."""
    return F.floor(local_ms(ts_ms, tz) / DAY_MS).cast("int")


def day(ts_ms: Column, tz: str = TZ) -> Column:
    return F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), day_number(ts_ms, tz)), "yyyy-MM-dd")


def month(ts_ms: Column, tz: str = TZ) -> Column:
    return F.substring(day(ts_ms, tz), 1, 7)


def hour(ts_ms: Column, tz: str = TZ) -> Column:
    return F.pmod(F.floor(local_ms(ts_ms, tz) / HOUR_MS), F.lit(24)).cast("int")


def weekday(ts_ms: Column, tz: str = TZ) -> Column:
    """0 is Monday."""
    return F.pmod(day_number(ts_ms, tz) + 3, F.lit(7)).cast("int")


def weekday_name(number: Column) -> Column:
    return F.get(F.array(*[F.lit(x) for x in WEEKDAYS]), number)


def strip(text: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def round1(x: Column, rounding: str = "exact") -> Column:
    """One decimal of a double: its binary value rounded half to even, or with "sql" as SQL's round.

    A tie is where 20 x is an odd integer. 16 x and 4 x are exact; what their sum s loses is found
    exactly too, and tells on which side of the tie x lies.
    """
    if rounding == "sql":
        return F.round(x, 1)
    a, b = x * 16.0, x * 4.0
    s = a + b
    lost = (a - (s - (s - a))) + (b - (s - a))
    aside = F.when(lost > 0, (s + 1) / 2).otherwise((s - 1) / 2)
    return F.when((F.pmod(s, F.lit(2.0)) == 1) & (lost != 0), aside).otherwise(F.rint(s / 2)) / 10.0


def truthy(x: Column, other: Column) -> Column:
    """x, or other where x is null, empty or zero."""
    return F.when(x.isNull() | (x.cast("string").isin("", "0")), other).otherwise(x)


def word_size(count: Column, least: Column, most: Column) -> Column:
    """14 to 48 by count between the least and the most."""
    spread = F.when(most == least, F.lit(1)).otherwise(most - least)
    return F.lit(14.0) + F.lit(34.0) * (count - least).cast("double") / spread.cast("double")


def percent_half_up(weight: Column) -> Column:
    return F.floor(weight * 100 + 0.5).cast("int")


def badge(level: Column) -> Column:
    """A colour class for high, medium or low."""
    return F.when(level == "high", "success").when(level == "medium", "warning").when(level == "low", "danger").otherwise("secondary")
