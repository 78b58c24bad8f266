"""Column helpers shared by the operators."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F


def money(col: str | Column, scale: int = 2) -> Column:
    """Exact decimal of a double, so that sums don't depend on order."""
    return (F.col(col) if isinstance(col, str) else col).cast(f"decimal(18,{scale})")


def total(col: Column) -> Column:
    """Exact sum, as a double."""
    return F.sum(col).cast("double")


def hundredths(col: str | Column) -> Column:
    """A double of two decimals in whole hundredths: sums of longs are exact and cheap, up to 9e18."""
    return F.rint((F.col(col) if isinstance(col, str) else col) * 100).cast("long")


def amount(whole: Column, scale: int = 100) -> Column:
    """A sum of whole parts as a double, the nearest to the exact quotient."""
    return F.when(F.abs(whole) < 2**53, whole / scale).otherwise((whole.cast("decimal(38,0)") / scale).cast("double"))


def every(*conditions: Column | None) -> Column:
    """The given conditions ANDed; None is left out."""
    return reduce(and_, [c for c in conditions if c is not None], F.lit(True))


def first_match(rules: list[tuple[str, Column]], default: str | None = None) -> Column:
    """The name of the first rule that holds."""
    out = F.lit(default)
    for name, condition in reversed(rules):
        out = F.when(condition, F.lit(name)).otherwise(out)
    return out


def hash_key(*cols: str) -> Column:
    """md5 of trimmed, upper-cased parts joined by ||; null parts count as empty."""
    return F.md5(F.concat_ws("||", *(F.upper(F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))) for c in cols)))


def hash_diff(*cols: str) -> Column:
    """md5 of trimmed parts joined by ||."""
    return F.md5(F.concat_ws("||", *(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in cols)))


def haversine(lat1: Column, lng1: Column, lat2: Column, lng2: Column, radius_km: float = 6371.0) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    return 2 * radius_km * F.asin(F.sqrt(a))
