"""Stored aggregates that answer coarser questions: exact distinct counts as bitmaps, and the choice of a rollup."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ashlar.functions import every


def distinct_state(df: DataFrame, keys: list[str], ident: str) -> DataFrame:
    """keys, bucket, bits: the distinct whole numbers of ident in each group, as bitmaps of 4 KB for 32,768 neighbouring numbers each. Null idents aren't counted.

    The state merges exactly: over days, keys, and with states of other rows.
    """
    rows = df.where(F.col(ident).isNotNull())
    return rows.groupBy(*keys, F.bitmap_bucket_number(ident).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(ident)).alias("bits"))


def merge_states(state: DataFrame, keys: list[str]) -> DataFrame:
    """A state by fewer keys."""
    return state.groupBy(*keys, "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def distinct_count(state: DataFrame, keys: list[str], name: str) -> DataFrame:
    """keys and the distinct count that a state holds for them."""
    return merge_states(state, keys).groupBy(*keys).agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).alias(name))


@dataclass
class Measure:
    """An aggregate: count (of rows, or of a column that isn't null), sum, min, max, avg or distinct."""

    fn: str
    col: str | None = None


@dataclass
class Rollup:
    """A stored aggregate: its table, its keys, the column that holds each (function, source column), and its rows.

    Distinct counts are in a table of their own, a state with bucket and bits.
    """

    name: str
    table: DataFrame
    dims: set[str]
    holds: dict[tuple[str, str | None], str]
    rows: int
    state_of: str | None = None


#: What an aggregate is made from: partial aggregates, each of which merges.
PARTS: dict[str, Callable[[str | None], list[tuple[str, str | None]]]] = {
    "count": lambda c: [("count", c)],
    "sum": lambda c: [("sum", c)],
    "min": lambda c: [("min", c)],
    "max": lambda c: [("max", c)],
    "avg": lambda c: [("sum", c), ("count", c)],
}


def covers(rollup: Rollup, by: list[str], filters: dict[str, Callable[[Column], Column]], measures: dict[str, Measure]) -> bool:
    """Whether a rollup has every key and filtered column, and for every aggregate parts that merge to it."""
    if not set(by) | set(filters) <= rollup.dims:
        return False
    if rollup.state_of is not None:  # distinct counts of one column, nothing else
        return all(m.fn == "distinct" and m.col == rollup.state_of for m in measures.values())
    return all(m.fn in PARTS and all(part in rollup.holds for part in PARTS[m.fn](m.col)) for m in measures.values())


def answer(base: DataFrame, dims: dict[str, Column], rollups: list[Rollup], by: list[str], measures: dict[str, Measure], filters: dict[str, Callable[[Column], Column]] | None = None) -> tuple[DataFrame, str]:
    """(by and the measures, the name of what served them): from the smallest rollup that covers the question, else from base.

    dims: each key as a column of base. Counts and sums are summed again,
    minima and maxima taken again, averages made from both their parts, distinct
    counts only from bitmaps. A group of which no row is left by the filters has
    no row, with or without a rollup; without keys there is one row.
    """
    filters = filters or {}
    fit = sorted((r for r in rollups if covers(r, by, filters, measures)), key=lambda r: r.rows)
    if not fit:
        table, served = base.withColumns(dims), "base"
        make = {"count": lambda c: F.count(c or F.lit(1)), "sum": F.sum, "min": F.min, "max": F.max, "avg": F.avg, "distinct": F.count_distinct}
        aggs = [make[m.fn](m.col).alias(name) for name, m in measures.items()]
    else:
        rollup = fit[0]
        table, served = rollup.table, rollup.name
        if rollup.state_of is not None:
            (name,) = measures  # the state has one column to count
            return distinct_count(table.where(every(*(f(F.col(c)) for c, f in filters.items()))), by, name), served
        part = lambda fn, c: F.col(rollup.holds[fn, c])
        again = {
            "count": lambda c: F.coalesce(F.sum(part("count", c)), F.lit(0)),
            "sum": lambda c: F.sum(part("sum", c)),
            "min": lambda c: F.min(part("min", c)),
            "max": lambda c: F.max(part("max", c)),
            "avg": lambda c: F.sum(part("sum", c)) / F.nullif(F.sum(part("count", c)), F.lit(0)),
        }
        aggs = [again[m.fn](m.col).alias(name) for name, m in measures.items()]
    return table.where(every(*(f(F.col(c)) for c, f in filters.items()))).groupBy(*by).agg(*aggs), served
