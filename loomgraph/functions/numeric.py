"""Numbers as diagrams write them."""

from __future__ import annotations

from decimal import Decimal, InvalidOperation

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

SAFE = 2**53 - 1


def decimal_text(c: Column, scale: int = 18) -> Column:
    """Digits without exponent or trailing zeros; 0 is "0".  Null beyond 38 digits."""
    s = c.try_cast(f"decimal(38,{scale})").cast("string")
    bare = F.when(F.contains(s, F.lit(".")), F.regexp_replace(s, r"\.?0+$", "")).otherwise(s)
    return F.when(bare.isin("-0", ""), F.lit("0")).otherwise(bare)


def same_number(a: Column, b: Column) -> Column:
    return a.try_cast("decimal(38,18)") == b.try_cast("decimal(38,18)")


def percent(part: Column, whole: Column) -> Column:
    """Whole percent, halves up."""
    return F.round((part.cast("decimal(30,6)") * 100) / whole.cast("decimal(30,6)"), 0).cast("long")


def hundredths(c: Column) -> Column:
    """Two decimals as floor(100 x + 1/2) / 100."""
    return F.floor(c * 100 + 0.5) / 100


def thousands(c: Column) -> Column:
    return F.format_number(c.cast("long"), 0)


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def safe_integer(c: Column) -> Column:
    return F.abs(c) <= SAFE


def unit_range(c: Column, low: Column, high: Column) -> Column:
    return F.when(high > low, (c - low) / (high - low))


@F.pandas_udf(BooleanType())
def round_trips(s: pd.Series) -> pd.Series:
    """Whether a decimal text is what its nearest double prints as; exactness has no built-in."""

    def one(x):
        if x is None:
            return None
        try:
            d = Decimal(x)
            f = float(d)
        except (InvalidOperation, ValueError, OverflowError):
            return False
        return f == f and abs(f) != float("inf") and (f == 0 or abs(f) >= 2.2250738585072014e-308) and Decimal(str(f)) == d

    return s.map(one)
