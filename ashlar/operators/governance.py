"""Masks, row filters and role views."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ashlar.operators.merge import union


@dataclass(frozen=True)
class Policy:
    """What a role sees: column masks, hidden columns, and an attribute that rows must share with the user."""

    masks: dict[str, Callable[[Column], Column]] = field(default_factory=dict)
    hidden: tuple[str, ...] = ()
    same: str | None = None


def keep_last(n: int, width: int) -> Callable[[Column], Column]:
    """All but the last n characters starred, to a fixed width."""
    return lambda c: F.lpad(F.substring(c.cast("string"), -n, n), width, "*")


def local_part(c: Column) -> Column:
    """An address with its local part starred."""
    return F.regexp_replace(c, "^[^@]*", "***")


def blank(c: Column) -> Column:
    return F.lit(None).cast("string")


def mask(df: DataFrame, policy: Policy) -> DataFrame:
    return df.withColumns({c: f(F.col(c)) for c, f in policy.masks.items()}) if policy.masks else df


def row_filter(df: DataFrame, policy: Policy, user: dict[str, object]) -> DataFrame:
    """Rows whose attribute is the user's; none for a user without one."""
    return df if policy.same is None else df.where(F.col(policy.same) == F.lit(user.get(policy.same)))


def secure_view(df: DataFrame, policy: Policy, user: dict[str, object]) -> DataFrame:
    """Row filter, then masks, then hidden columns dropped, before any query of the user."""
    return mask(row_filter(df, policy, user), policy).drop(*policy.hidden)


def pseudonymize(df: DataFrame, cols: list[str]) -> DataFrame:
    """sha256 of the trimmed, lower-cased value in place of it."""
    return df.withColumns({c: F.sha2(F.lower(F.trim(F.col(c))), 256) for c in cols})


def mask_audit(raw: DataFrame, masked: DataFrame, probes: dict[str, Column | str], distinct: list[str] = ()) -> DataFrame:
    """probe, raw, masked, verdict: what someone who sees only masked rows can still find out.

    A probe is a predicate of column names that both have; its rows are counted
    in both (one pass each). distinct: columns whose distinct values are counted.
    verdict: "open" if masked gives the raw figure, "closed" if it gives none
    where raw gives some, "partly" between; "nothing" if raw itself gives none.
    Null values meet no probe and are no distinct value.
    """

    def figures(df: DataFrame) -> DataFrame:
        # an empty table has one row of zeros; each distinct count is a two-step aggregate of its own, so rows aren't expanded
        counts = [F.count_if(F.expr(p) if isinstance(p, str) else p) for p in probes.values()]
        parts = [df.agg(*(c.alias(f"p{i}") for i, c in enumerate(counts))).select(F.expr(f"stack({len(counts)}, " + ", ".join(f"{i}, p{i}" for i in range(len(counts))) + ") as (at, n)"))] if counts else []
        parts += [df.select(F.col(c).alias("v")).where("v is not null").distinct().agg(F.count("*").alias("n")).select(F.lit(len(counts) + i).alias("at"), "n") for i, c in enumerate(distinct)]
        return union(*parts)

    names = [*probes, *(f"distinct {c}" for c in distinct)]
    both = figures(raw).withColumnRenamed("n", "raw").join(figures(masked).withColumnRenamed("n", "masked"), "at")
    verdict = F.when(F.col("raw") == 0, "nothing").when(F.col("masked") == 0, "closed").when(F.col("masked") >= F.col("raw"), "open").otherwise("partly")
    return both.select(F.element_at(F.array(*map(F.lit, names)), F.col("at") + 1).alias("probe"), "raw", "masked", verdict.alias("verdict"))
