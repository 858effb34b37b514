"""Dates by a closed format grammar, and durations of fixed length."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Milliseconds of each unit; months and years are of fixed length.
UNITS = {"ms": 1, "s": 1_000, "m": 60_000, "h": 3_600_000, "d": 86_400_000, "w": 604_800_000, "M": 2_678_400_000, "y": 31_622_400_000}
#: Units of which only whole numbers are allowed.
WHOLE = ("ms", "d", "w", "M", "y")
#: Format names to a shape that a text must have and the pattern that parses it.
FORMATS = {
    "YYYY-MM-DD": (r"^\d{4}-\d{2}-\d{2}$", "yyyy-MM-dd"),
    "DD-MM-YYYY": (r"^\d{2}-\d{2}-\d{4}$", "dd-MM-yyyy"),
    "MM/DD/YYYY": (r"^\d{2}/\d{2}/\d{4}$", "MM/dd/yyyy"),
    "YYYY-MM-DD HH:mm": (r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}$", "yyyy-MM-dd HH:mm"),
    "YYYY-MM-DD HH:mm:ss": (r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$", "yyyy-MM-dd HH:mm:ss"),
}


def duration_ms(c: Column) -> Column:
    """Milliseconds of <number><unit>; null if it is none."""
    number, unit = F.regexp_extract(c, r"^(\d+(?:\.\d+)?)(ms|s|m|h|d|w|M|y)$", 1), F.regexp_extract(c, r"^(\d+(?:\.\d+)?)(ms|s|m|h|d|w|M|y)$", 2)
    size = F.element_at(F.create_map(*[F.lit(x) for u in UNITS.items() for x in u]), F.when(unit != "", unit))
    whole = ~unit.isin(*WHOLE) | ~F.contains(number, F.lit("."))
    return F.when((number != "") & whole, F.round(number.try_cast("decimal(20,6)") * size, 0).cast("long"))


def parse(c: Column, format_: str) -> Column:
    """A timestamp, or null if the text is not in the format to the letter."""
    if format_ == "x":
        return F.when(c.rlike(r"^\d{1,15}$"), F.timestamp_millis(c.try_cast("long")).cast("timestamp_ntz"))
    shape, pattern = FORMATS[format_]
    return F.when(c.rlike(shape), F.try_to_timestamp(c, F.lit(pattern)).cast("timestamp_ntz"))


def as_ms(c: Column) -> Column:
    return F.unix_millis(c.cast("timestamp"))
