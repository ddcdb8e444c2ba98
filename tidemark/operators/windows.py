"""Windows over one entity's period sequence.

Every partition is one entity with unique periods (years, months or days), so its
size is bounded by the calendar, not by the data volume: reduce to one row per
(entity, period) first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _w(by: Sequence[str], order: str):
    return Window.partitionBy(*by).orderBy(order)


def previous_row(col: str, by: Sequence[str], order: str) -> Column:
    return F.lag(col).over(_w(by, order))


def next_row(col: str, by: Sequence[str], order: str) -> Column:
    return F.lead(col).over(_w(by, order))


def period_lag(col: str, by: Sequence[str], period: str, k: int = 1) -> Column:
    """Value exactly ``k`` periods earlier; a gap gives NULL."""
    return F.first(col).over(_w(by, period).rangeBetween(-k, -k))


def period_lag_column(expr: Column, by: Sequence[str], period: str, k: int = 1) -> Column:
    return F.first(expr).over(_w(by, period).rangeBetween(-k, -k))


def trailing_count(col: str, by: Sequence[str], order: str, rows: int = 12) -> Column:
    return F.count(col).over(_w(by, order).rowsBetween(1 - rows, 0))


def trailing_sd(col: str, by: Sequence[str], order: str, rows: int = 12, minimum: int = 12) -> Column:
    w = _w(by, order).rowsBetween(1 - rows, 0)
    return F.when(F.count(col).over(w) >= minimum, F.stddev_samp(col).over(w))


def trailing_compound(col: str, by: Sequence[str], order: str, rows: int = 12, minimum: int = 12) -> Column:
    """Compounded return over the last ``rows`` rows; missing returns count as zero
    but fewer than ``minimum`` present ones give NULL."""
    w = _w(by, order).rowsBetween(1 - rows, 0)
    growth = F.exp(F.sum(F.log1p(F.coalesce(F.col(col), F.lit(0.0)))).over(w)) - 1
    return F.when(F.count(col).over(w) >= minimum, growth)


def trailing_excess(
    series: DataFrame, market: DataFrame, by: Sequence[str], order: str, ret: str, market_ret: str,
    rows: int = 12, minimum: int = 12, name: str = "exret",
) -> DataFrame:
    """Own trailing compounded return minus the market's over its own date list."""
    mkt = market.select(order, trailing_compound(market_ret, [], order, rows, minimum).alias("_mkt"))
    own = series.withColumn("_own", trailing_compound(ret, by, order, rows, minimum))
    return own.join(mkt, order, "left").withColumn(name, F.col("_own") - F.col("_mkt")).drop("_own", "_mkt")


def trailing_decay(
    col: str, by: Sequence[str], period: str, window: int = 3, decay: float = 0.5, minimum: int = 2
) -> Column:
    """Weighted mean over periods t, t-1 ...; missing periods are skipped."""
    parts = [F.col(col)] + [period_lag(col, by, period, k) for k in range(1, window)]
    num = den = cnt = None
    for k, p in enumerate(parts):
        wt = float(decay**k)
        a = F.coalesce(p * wt, F.lit(0.0))
        b = F.when(p.isNotNull(), wt).otherwise(0.0)
        c = p.isNotNull().cast("int")
        num, den, cnt = (a, b, c) if num is None else (num + a, den + b, cnt + c)
    return F.when(cnt >= minimum, num / F.nullif(den, F.lit(0.0)))


def window_span(month: str, by: Sequence[str], order: str, rows: int = 12) -> Column:
    """Months covered by the last ``rows`` rows (``rows`` when there is no gap)."""
    return F.col(month) - F.lag(month, rows - 1).over(_w(by, order)) + 1


def longest_run(df: DataFrame, entity: str, period: str) -> DataFrame:
    """Longest run of consecutive periods per entity."""
    uniq = df.select(entity, period).distinct()
    island = uniq.withColumn("_island", F.col(period) - F.row_number().over(_w([entity], period)))
    runs = island.groupBy(entity, "_island").agg(F.count("*").alias("_len"))
    return runs.groupBy(entity).agg(F.max("_len").alias("longest_run"))
