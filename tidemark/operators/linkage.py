"""Identifier linkage checks, source comparison, lag donors and event footprints."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.guards import require
from tidemark.functions.expr import short_key
from tidemark.operators.windows import period_lag

DISPOSITIONS = ("corroborated_history", "same_issuer_different_issue", "reorganisation", "unresolved")


def key_outcomes(own: str | Column, other: str | Column, length: int = 8) -> dict[str, Column]:
    """available / match / mismatch flags of two identifiers; no row is dropped."""
    a, b = short_key(own, length), short_key(other, length)
    available = (a != "") & (b != "")
    return {"available": available.cast("int"), "match": (available & (a == b)).cast("int"),
            "mismatch": (available & (a != b)).cast("int")}


def classify_mismatches(
    mismatches: DataFrame, names: DataFrame, on: str, own: str, other: str, name_key: str
) -> DataFrame:
    """Disposition of each mismatch: value seen anywhere in the id's history, same
    issuer code, id with several issuers, or unresolved – first that holds."""
    hist = names.select(on, short_key(name_key, 8).alias("_k")).where(F.col("_k") != "").distinct()
    seen = hist.select(F.col(on), F.col("_k").alias("_own"), F.lit(1).alias("_seen"))
    issuers = hist.groupBy(on).agg(F.countDistinct(F.substring("_k", 1, 6)).alias("_issuers"))
    out = mismatches.withColumn("_own", F.upper(F.trim(F.coalesce(own, F.lit("")))))
    out = out.join(seen, [on, "_own"], "left").join(issuers, on, "left")
    cased = (
        F.when(F.col("_seen") == 1, DISPOSITIONS[0])
        .when(short_key(own, 6) == short_key(other, 6), DISPOSITIONS[1])
        .when(F.col("_issuers") >= 2, DISPOSITIONS[2])
        .otherwise(DISPOSITIONS[3])
    )
    return out.withColumn("disposition", cased).drop("_own", "_seen", "_issuers")


def require_dispositions(classified: DataFrame, allowed: Sequence[str] = DISPOSITIONS[:3]) -> None:
    """Raise with a few examples if a mismatch has no disposition or one outside ``allowed``."""
    require(classified.where(~F.coalesce(F.col("disposition").isin(*allowed), F.lit(False))), "mismatches without a known disposition")


def disposition_summary(classified: DataFrame) -> DataFrame:
    """Counts and shares for every disposition in fixed order, zero rows kept."""
    spark = classified.sparkSession
    dim = spark.createDataFrame([(i, n) for i, n in enumerate(DISPOSITIONS)], "position int, disposition string")
    counts = classified.groupBy("disposition").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("_all"))
    out = dim.join(F.broadcast(counts), "disposition", "left").join(F.broadcast(total), F.lit(True))
    n = F.coalesce(F.col("n"), F.lit(0))
    return out.select("position", "disposition", n.alias("n"), F.round(n / F.nullif("_all", F.lit(0)), 6).alias("share"))


def date_agreement(a: DataFrame, b: DataFrame, keys: Sequence[str], first: str, second: str) -> DataFrame:
    """Signed day difference for keys that carry both dates."""
    both = a.where(F.col(first).isNotNull()).join(b.where(F.col(second).isNotNull()), list(keys))
    return both.select(*keys, F.datediff(first, second).alias("diff"))


def match_flag(left: DataFrame, filings: DataFrame, keys: Sequence[str], filed: str, source: str) -> DataFrame:
    j = left.join(filings.select(*keys, filed, source), list(keys), "left")
    ok = F.col(filed).isNotNull() & ~F.coalesce(F.col(source).startswith("fallback"), F.lit(False))
    return j.withColumn("matched", ok.cast("int"))


def lag_with_donors(
    panel: DataFrame, donors: DataFrame, entity: str, period: str, cols: Sequence[str], validate: bool = True
) -> DataFrame:
    """Lags of the panel where earlier rows of its entities may donate a value.

    Donor rows never appear in the output. A donor inside the sample raises.
    """
    if validate and not donors.join(panel.select(entity, period), [entity, period], "left_semi").isEmpty():
        raise ValueError("lag donor rows overlap the sample")
    own = donors.join(panel.select(entity).distinct(), entity, "left_semi").withColumn("_donor", F.lit(1))
    both = panel.withColumn("_donor", F.lit(0)).unionByName(own, allowMissingColumns=True)
    for c in cols:
        both = both.withColumn(f"{c}_lag", period_lag(c, [entity], period))
    return both.where("_donor = 0").drop("_donor")
