"""The two data stages as one lazy plan each: linked, labelled panel, then model input."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import filters as FL
from tidemark.operators import fit, pit
from tidemark.operators.splits import chronological, purge_earlier
from tidemark.operators.windows import period_lag
from tidemark.functions import expr as E
from tidemark.profile import CORRECTED, Profile
from tidemark.sources.tables import fitted, staged


def build_panel(
    statements: DataFrame, links: DataFrame, names: DataFrame, snapshots: DataFrame, events: DataFrame,
    eligible: Column, profile: Profile = CORRECTED,
) -> DataFrame:
    """Filters, filing lag, link, as-of eligibility, month snapshot, label, run filter.

    statements: entity, fyear, sic, ta, datadate, fdate, ...; links: entity, target, prim,
    lo, hi; names: entity, start, end and the columns of ``eligible``; snapshots: entity,
    month (its last day), cap; events: entity, event_date. The label comes before the run
    filter, so an event keeps its row even if that row is dropped later.
    """
    key = ["entity", "fyear"]
    base = statements.where(
        FL.outside_ranges("sic", profile.excluded_codes) & (F.col("ta") > 0) & F.col("fyear").between(profile.start_year, profile.end_year)
    )
    dated = staged(FL.filing_lag(base, "datadate", "fdate", profile.max_filing_lag))  # the lookups read their rows several times
    rank = F.when(F.col("prim") == "P", 0).otherwise(1)
    linked = staged(pit.best_valid(
        dated, links.where(F.col("prim").isin("P", "C")), ["entity"], "datadate", "lo", "hi", key, [rank, F.col("lo")], ["target"], "inner"
    ))
    kept = FL.eligible_asof(linked, names, ["entity"], "datadate", "start", "end", eligible)
    cap = kept.withColumn("month", F.last_day("datadate")).join(snapshots.hint("merge"), ["entity", "month"])  # grows with the rows
    cap = staged(cap.where(F.col("cap") > 0).drop("month"))
    reach = f"{profile.horizon_days} DAYS"
    if profile.unique_event:
        labelled = pit.unique_forward_label(cap, events, ["entity"], "fdate", "event_date", reach, ["fyear"])
    else:
        labelled = pit.forward_label(cap, events, ["entity"], "fdate", "event_date", reach)
    return FL.min_consecutive(labelled, "entity", "fyear", profile.min_run)


def build_features(panel: DataFrame, sector: str, profile: Profile = CORRECTED, min_coverage: int | None = None) -> DataFrame:
    """Ratios, lags and indicators, split, purge, clip, coverage and fill: long rows
    (entity, fyear, split, feature, value, level). Bounds and fill values come from
    training rows only and are written once."""
    x = E.accounting_ratios(panel)
    x = x.withColumns({"ib_lag": period_lag("ib", ["entity"], "fyear"), "nita_lag": period_lag("nita", ["entity"], "fyear")})
    x = x.withColumns(
        {
            "chin": E.symmetric_change(F.col("ib"), F.col("ib_lag")),
            "oeneg": E.negative_equity("lt", "ta", profile.missing_policy).cast("double"),
            "intwo": E.two_losses("ib", "ib_lag", profile.missing_policy).cast("double"),
            "lnta": E.log_positive("ta"),
        }
    )
    names = ["nita", "tlta", "wcta", "clca", "oeneg", "nita_lag", "chin", "intwo", "cashta", "ocf_ta", "lnta"]
    cut = x.withColumn("split", chronological("fyear", profile.train_end, profile.val_end))
    keep = ["entity", "fyear", "split", sector, "fdate", *names]
    clean = staged(purge_earlier(staged(cut.select(*keep)), "split", "fdate", profile.horizon_days))
    need = profile.min_coverage if min_coverage is None else min_coverage
    bounds = fitted(fit.clip_bounds(melt(clean.where("split = 'train'"), names, sector)))
    covered = FL.min_coverage(clean, names, need, lower_to_present=True)
    clipped = fit.clip_long(melt(covered, names, sector), bounds)
    tables = fit.fill_tables(clipped.where("split = 'train'"), sector, "fyear", profile.peer_minimum, profile.peer_rule)
    tables = {n: fitted(t) for n, t in tables.items()}
    return fit.fill(clipped, tables, sector, "fyear", ("oeneg", "intwo"))


def melt(df: DataFrame, names: Sequence[str], sector: str) -> DataFrame:
    pairs = ", ".join(f"'{c}', {c}" for c in names)
    return df.selectExpr("entity", "fyear", "split", sector, f"stack({len(names)}, {pairs}) AS (feature, value)")
