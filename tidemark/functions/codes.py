"""Exit-event codes, event flags and eligibility rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---- fixed values: published code crosswalk and eligibility sets -------------
DROPPED_REASON_CODE = {
    "UNAV": 500, "MVNM": 502, "MVMF": 505, "MVB": 510, "MVCHI": 513, "MVMO": 514, "MVPAC": 516, "MVPH": 517,
    "MVTO": 519, "MVOT": 520, "MTMK": 550, "SHLD": 551, "LP": 552, "INSC": 560, "INSF": 561, "CORQ": 570,
    "DERE": 573, "BKPY": 574, "OFFRE": 575, "DELQ": 580, "FARG": 581, "EQRQ": 582, "DEEX": 583, "FING": 584,
    "PUBI": 585, "VIO": 587, "FDCV": 588, "UNL": 589, "SERQ": 591,
}
LIQUIDATION_STATUS_CODE = {"UNAV": 400, "FPAY": 450, "NFC": 460, "NFP": 470, "NDP": 480, "NDC": 490}
NARROW_REASONS = ("BKPY", "FING", "INSC", "EQRQ", "LP")
VOLUNTARY_REASONS = ("CORQ", "MVOT")
PERFORMANCE_RANGES = ((400, 499), (500, 500), (520, 584))
ELIGIBLE = {
    "securitytype": ("EQTY",),
    "securitysubtype": ("COM",),
    "sharetype": ("NS",),
    "usincflg": ("Y",),
    "issuertype": ("CORP", "ACOR"),
    "exchcd_src": ("N", "A", "Q"),
}
# ------------------------------------------------------------------------------


def clean(col: str | Column) -> Column:
    return F.upper(F.trim(F.col(col) if isinstance(col, str) else col))


def _lookup(key: Column, table: dict[str, int]) -> Column:
    pairs = [x for k, v in table.items() for x in (F.lit(k), F.lit(v))]
    return F.element_at(F.create_map(*pairs), key)


def exit_code(action: str, reason: str, status: str | None = None, rule: str = "reconstructed") -> Column:
    """Numeric exit code from action/reason(/status) letters.

    ``frozen`` and ``corrected`` are ordered rules with 500 as the default;
    ``reconstructed`` looks the code up and leaves unknown pairs NULL.
    """
    a, r = F.trim(F.col(action)), F.trim(F.col(reason))
    if rule == "frozen":
        return F.when(r == "BKPY", 572).when(a == "GDR", 450).otherwise(500)
    if rule == "corrected":
        return F.when(r == "BKPY", 470).when(a == "GDR", 450).when(a == "GLI", 400).otherwise(500)
    if rule == "reconstructed":
        dropped = _lookup(clean(reason), DROPPED_REASON_CODE)
        closed = _lookup(clean(status), LIQUIDATION_STATUS_CODE) if status else F.lit(None).cast("int")
        return F.when(clean(action) == "GDR", dropped).when(clean(action) == "GLI", closed)
    raise ValueError(f"unknown code rule {rule!r}")


def _flag(cond: Column) -> Column:
    return F.coalesce(cond, F.lit(False)).cast("int")


def event_flags(df: DataFrame, action: str, reason: str, status: str) -> DataFrame:
    """Reconstructed code and the five 0/1 event families."""
    code = exit_code(action, reason, status)
    a, r = clean(action), clean(reason)
    perf = F.lit(False)
    for lo, hi in PERFORMANCE_RANGES:
        perf = perf | F.col("code").between(lo, hi)
    dropped = a == "GDR"
    voluntary = F.coalesce(dropped & r.isin(*VOLUNTARY_REASONS), F.lit(False))
    return df.withColumn("code", code).withColumns(
        {
            "is_performance": _flag(perf),
            "is_performance_core": _flag(perf & ~voluntary),
            "is_narrow": _flag((a == "GLI") | (dropped & r.isin(*NARROW_REASONS))),
            "is_bankruptcy": _flag(dropped & (r == "BKPY")),
            "is_broad": _flag(a.isin("GLI", "GDR")),
        }
    )


def eligible(sets: dict[str, tuple[str, ...]] | None = None) -> Column:
    """All letter fields inside their allowed sets; a missing letter is ineligible."""
    out = F.lit(True)
    for col, allowed in (sets or ELIGIBLE).items():
        out = out & F.coalesce(clean(col).isin(*[v.upper() for v in allowed]), F.lit(False))
    return out
