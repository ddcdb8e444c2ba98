"""Fitted state: clip bounds, hierarchical fill values, and their application.

Feature tables are long (feature, value); fitted tables are small and keyed by
feature, plus sector and period for fill values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.expr import clip
from tidemark.operators.ranks import percentile_columns


def clip_bounds(train: DataFrame, keys: list[str] | None = None, lo: float = 0.01, hi: float = 0.99) -> DataFrame:
    """Training percentiles per feature (or per feature and fold/year)."""
    return percentile_columns(train, keys or ["feature"], "value", {"lower": lo, "upper": hi})


def clip_long(df: DataFrame, bounds: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Clip to stored bounds; NULL stays NULL. Bounds hold one row per feature key."""
    j = df.join(bounds, keys or ["feature"], "left")
    return j.withColumn("value", clip("value", "lower", "upper")).drop("lower", "upper")


def realised_clipping(raw: DataFrame, bounds: DataFrame, drift: float = 0.02) -> DataFrame:
    """Share strictly outside the bounds per feature and split; NULL leaves the base."""
    j = raw.join(bounds, "feature")
    v = F.col("value")
    out = j.groupBy("feature", "split").agg(
        F.count("value").alias("n"),
        F.count_if(v < F.col("lower")).alias("n_low"),
        F.count_if(v > F.col("upper")).alias("n_high"),
    )
    out = out.withColumns(
        {"share_low": F.col("n_low") / F.nullif("n", F.lit(0)), "share_high": F.col("n_high") / F.nullif("n", F.lit(0))}
    )
    return out.withColumn(
        "drift", F.coalesce((F.col("share_low") > drift) | (F.col("share_high") > drift), F.lit(False)).cast("int")
    )


def fill_tables(
    train: DataFrame, sector: str, period: str, minimum: int = 5, peer_rule: str = "per_feature",
    extra: list[str] | None = None,
) -> dict[str, DataFrame]:
    """Medians at four levels from training rows.

    cell: (sector, period) median with enough peers, counted on present values
    (``per_feature``) or on rows (``rows``); sector: median of the qualifying cell
    medians; period and overall: plain medians. ``extra`` adds keys such as a fold.
    """
    ex = extra or []
    support = F.count("value") if peer_rule == "per_feature" else F.count("*")
    keys = [*ex, "feature", sector, period]
    known = train.where(F.col(sector).isNotNull())
    n = known.groupBy(*keys).agg(support.alias("_n"))
    cells = percentile_columns(known, keys, "value", {"med": 0.5})
    cell = cells.join(n.where(F.col("_n") >= minimum), keys).select(*keys, F.col("med").alias("cell_median"))
    by_sector = cell.groupBy(*ex, "feature", sector).agg(F.median("cell_median").alias("sector_median"))
    return {
        "cell": cell,
        "sector": by_sector,
        "period": percentile_columns(train, [*ex, "feature", period], "value", {"period_median": 0.5}),
        "overall": percentile_columns(train, [*ex, "feature"], "value", {"overall_median": 0.5}),
    }


def fill(
    df: DataFrame, tables: dict[str, DataFrame], sector: str, period: str, binary: tuple[str, ...] = (),
    extra: list[str] | None = None,
) -> DataFrame:
    """Four-level fill; adds ``level`` (0 = was present, 5 = still missing).

    Binary features snap to 0/1 with exactly 0.5 going to 0.
    """
    ex = extra or []
    out = (
        df.join(tables["cell"], [*ex, "feature", sector, period], "left")
        .join(tables["sector"], [*ex, "feature", sector], "left")
        .join(F.broadcast(tables["period"]), [*ex, "feature", period], "left")
        .join(F.broadcast(tables["overall"]), [*ex, "feature"], "left")
    )
    steps = ["value", "cell_median", "sector_median", "period_median", "overall_median"]
    level: Column | None = None
    for i, c in enumerate(steps):
        level = F.when(F.col(c).isNotNull(), i) if level is None else level.when(F.col(c).isNotNull(), i)
    out = out.withColumn("level", level.otherwise(5)).withColumn("value", F.coalesce(*steps))
    if binary:
        snapped = F.when(F.col("feature").isin(*binary) & F.col("value").isNotNull(), (F.col("value") > 0.5).cast("double"))
        out = out.withColumn("value", F.coalesce(snapped, F.col("value")))
    return out.drop(*steps[1:])
