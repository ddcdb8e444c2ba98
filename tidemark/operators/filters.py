"""Row filters, coverage, eligibility and first-row-per-group choices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.pit import valid_at
from tidemark.operators.windows import longest_run


def outside_ranges(code: str, ranges: Sequence[tuple[int, int]]) -> Column:
    """True unless the code falls in a closed range; a missing code is kept."""
    out = F.lit(True)
    for lo, hi in ranges:
        out = out & ~F.coalesce(F.col(code).between(lo, hi), F.lit(False))
    return out


def filing_lag(df: DataFrame, period_end: str, filed: str, limit: int, source: str | None = None) -> DataFrame:
    """Drop missing or fallback filing dates and lags above ``limit`` days. A date of unknown source is a filed one."""
    out = df.where(F.col(filed).isNotNull())
    if source:
        out = out.where(~F.coalesce(F.col(source).startswith("fallback"), F.lit(False)))
    lag = F.datediff(filed, period_end)
    checked = F.when(lag < 0, F.raise_error(F.lit("filing date before period end")).cast("int")).otherwise(lag)
    return out.withColumn("lag_days", checked).where(F.col("lag_days") <= limit)


def coverage(cols: Sequence[str]) -> Column:
    total = F.lit(0)
    for c in cols:
        total = total + F.col(c).isNotNull().cast("int")
    return total


def min_coverage(df: DataFrame, cols: Sequence[str], k: int, lower_to_present: bool = False) -> DataFrame:
    """Rows with at least ``k`` of ``cols`` known; an absent column counts as missing. With ``lower_to_present``
    no more columns are asked for than there are."""
    present = [c for c in cols if c in df.columns]
    return df.where(coverage(present) >= (min(k, len(present)) if lower_to_present else k))


def min_consecutive(df: DataFrame, entity: str, period: str, m: int = 2) -> DataFrame:
    """All rows of entities that have ``m`` consecutive periods."""
    ok = longest_run(df, entity, period).where(F.col("longest_run") >= m).select(entity)
    return df.join(ok, entity, "left_semi")


def eligible_anytime(df: DataFrame, info: DataFrame, on: str, mask: Column) -> DataFrame:
    ids = info.where(mask & F.col(on).isNotNull()).select(on).distinct()
    return df.join(ids, on, "left_semi")


def eligible_asof(
    df: DataFrame, info: DataFrame, on: Sequence[str], at: str, start: str, end: str, mask: Column, disjoint: bool = False
) -> DataFrame:
    missing = [c for c in (start, end) if c not in info.columns]
    if missing:
        raise KeyError(f"history lacks {missing}")
    return valid_at(df, info.where(mask).select(*on, start, end), list(on), at, start, end, "left_semi", disjoint)


def without_keys(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.join(keys.select(*on), list(on), "left_anti")


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, smallest by ``order``; a min over a struct, so it combines
    before the shuffle and never sorts a whole group."""
    rest = [c for c in df.columns if c not in keys]
    ranked = F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)], *[F.col(c) for c in rest])
    best = df.groupBy(*keys).agg(F.min(ranked).alias("_b"))
    return best.select(*keys, *[F.col(f"_b.{c}").alias(c) for c in rest])


def standard_set_first(df: DataFrame, keys: Sequence[str], set_no: str, items: Sequence[str]) -> DataFrame:
    """Vintage choice: sets 1 and 2 only where any exist at all, then lowest set,
    then the fullest row; remaining ties by the row's own values."""
    any_std = df.agg(F.max((F.coalesce(F.col(set_no), F.lit(0)).isin(1, 2)).cast("int")).alias("_any"))
    kept = df.join(F.broadcast(any_std), F.lit(True)).where(
        (F.col("_any") == 0) | F.col(set_no).isin(1, 2)
    ).drop("_any")
    return first_per_key(kept, keys, [F.coalesce(F.col(set_no), F.lit(99)), -coverage(items)])


def by_priority(df: DataFrame, keys: Sequence[str], source: str, ranked: Sequence[str], date: str) -> DataFrame:
    """Best source first (unknown sources last), then the earliest date."""
    rank = F.coalesce(F.array_position(F.array(*[F.lit(s) for s in ranked]), F.col(source)), F.lit(0))
    return first_per_key(df, keys, [F.when(rank == 0, len(ranked) + 1).otherwise(rank), F.col(date)])
