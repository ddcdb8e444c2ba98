"""Row-level expressions. All are built-in column arithmetic, NULL means missing."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---- fixed values: published score weights and industry edges ----------------
LOGIT_INTERCEPT = -1.32
LOGIT_WEIGHTS = {
    "lnta": -0.407, "tlta": 6.03, "wcta": -1.43, "clca": 0.076, "oeneg": -1.72, "nita": -2.37, "futl": -1.83,
    "intwo": 0.285, "chin": -0.521,
}
FIVE_RATIO_WEIGHTS = (1.2, 1.4, 3.3, 0.6, 0.999)
DIVISIONS = (
    (999, "A: Agriculture"), (1499, "B: Mining"), (1999, "C: Construction"), (3999, "D: Manufacturing"),
    (4999, "E: Transport and communication"), (5199, "F: Wholesale"), (5999, "G: Retail"),
    (7999, "H: Services I"), (8999, "I: Services II"), (9999, "J: Other"),
)
PRICE_CAP = math.log(15.0)
# ------------------------------------------------------------------------------


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def month_end(year: str | Column, month: str | Column) -> Column:
    return F.last_day(F.make_date(col(year).cast("int"), col(month).cast("int"), F.lit(1)))


def period_end(fyear: str, month: str, rule: str = "standard") -> Column:
    """Fiscal period end; a missing month is December. Under the standard rule
    periods ending January to May belong to the next calendar year."""
    m = F.coalesce(F.col(month), F.lit(12))
    if rule == "standard":
        return month_end(F.col(fyear) + F.when(m <= 5, 1).otherwise(0), m)
    if rule == "frozen":
        return month_end(F.col(fyear), m)
    raise ValueError(f"unknown date rule {rule!r}")


def number(c: str | Column, dtype: str = "double") -> Column:
    """Numeric coercion; text that is no number becomes NULL."""
    return col(c).cast("string").try_cast(dtype)


def first_code(*candidates: str | Column) -> Column:
    """First non-missing code, zero counting as missing."""
    return F.coalesce(*[F.nullif(col(c), F.lit(0)) for c in candidates])


def short_key(c: str | Column, length: int = 8) -> Column:
    return F.substring(F.upper(F.trim(F.coalesce(col(c), F.lit("")))), 1, length)


def ratio(num: str | Column, den: str | Column) -> Column:
    return col(num) / F.nullif(col(den), F.lit(0.0))


def accounting_ratios(df: DataFrame) -> DataFrame:
    """Six scaled ratios from the statement items."""
    ocf = "oancf" if "oancf" in df.columns else "fopt"
    return df.withColumns(
        {
            "nita": ratio("ni", "ta"),
            "tlta": ratio("lt", "ta"),
            "wcta": ratio(F.col("act") - F.col("lct"), "ta"),
            "clca": ratio("lct", "act"),
            "cashta": ratio("che", "ta"),
            "ocf_ta": ratio(ocf, "ta"),
        }
    )


def negative_equity(lt: str, ta: str, policy: str = "strict") -> Column:
    known = (F.col(lt) > F.col(ta)).cast("int")
    return known if policy == "strict" else F.coalesce(known, F.lit(0))


def two_losses(ni: str | Column, ni_lag: str | Column, policy: str = "strict") -> Column:
    """Loss in both years. Strict needs the current value (a missing one is NULL)
    and the lag; frozen turns missing into 0."""
    now, before = col(ni), col(ni_lag)
    both = ((now < 0) & (before < 0)).cast("int")
    if policy == "strict":
        return F.when(now.isNotNull() & before.isNotNull(), both)
    return F.coalesce(both, F.lit(0))


def symmetric_change(now: Column, before: Column) -> Column:
    return (now - before) / F.nullif(F.abs(now) + F.abs(before), F.lit(0.0))


def log_positive(x: str | Column) -> Column:
    return F.ln(F.when(col(x) > 0, col(x)))


def log_price(p: str | Column, cap: float = PRICE_CAP) -> Column:
    size = F.when(F.abs(col(p)) > 0, F.abs(col(p)))
    return F.when(size.isNotNull(), F.least(F.ln(size), F.lit(cap)))


def market_to_book(me: str, book: str) -> Column:
    return F.col(me) / F.when(F.col(book) > 0, F.col(book))


def clip(x: str | Column, lo: str | Column, hi: str | Column) -> Column:
    return F.when(col(x).isNotNull(), F.greatest(col(lo), F.least(col(hi), col(x))))


def division(code: str) -> Column:
    """Industry division label, right-closed edges, 0 included, outside NULL."""
    out = None
    for top, label in DIVISIONS:
        cond = F.col(code) <= top
        out = F.when((F.col(code) >= 0) & cond, label) if out is None else out.when((F.col(code) >= 0) & cond, label)
    return out


def right_closed_bin(x: str | Column, edges: list[float | Column]) -> Column:
    """0-based bin for inner edges: bin i holds (edge i-1, edge i]."""
    out = None
    for i, e in enumerate(edges):
        cond = col(x) <= (e if isinstance(e, Column) else F.lit(float(e)))
        out = F.when(cond, i) if out is None else out.when(cond, i)
    return F.when(col(x).isNotNull(), out.otherwise(len(edges)))


def logit_probability(df_cols: list[str]) -> Column:
    """Published logit weights; a missing or absent input counts as 0."""
    futl = F.when(F.abs(F.col("tlta")) > 1e-6, F.col("ocf_ta") / F.col("tlta")).otherwise(0.0)
    z = F.lit(LOGIT_INTERCEPT)
    for name, weight in LOGIT_WEIGHTS.items():
        if name == "futl":
            z = z + F.lit(weight) * F.coalesce(futl, F.lit(0.0))
        elif name in df_cols:
            z = z + F.lit(weight) * F.coalesce(F.col(name), F.lit(0.0))
    return 1.0 / (1.0 + F.exp(-z))


def safe_ratio(num: str | Column, den: str | Column) -> Column:
    return F.coalesce(F.when(F.abs(col(den)) > 1e-6, col(num) / col(den)), F.lit(0.0))


def five_ratio_score(wcap, re, ebit, me, sales, ta, lt) -> Column:
    parts = [safe_ratio(wcap, ta), safe_ratio(re, ta), safe_ratio(ebit, ta), safe_ratio(me, lt), safe_ratio(sales, ta)]
    score = F.lit(0.0)
    for w, p in zip(FIVE_RATIO_WEIGHTS, parts):
        score = score + F.lit(w) * p
    return score


def weakness_covariates(df: DataFrame) -> DataFrame:
    base = F.when(F.col("ta") > 0, F.col("ta"))
    return df.withColumns(
        {
            "roa": F.col("ib") / base,
            "leverage": F.col("lt") / base,
            "loss": (F.col("ib") < 0).cast("double"),
        }
    )


def correlation(x: str | Column, y: str | Column) -> Column:
    """Pearson correlation over complete pairs; NULL (never an error) if either side is constant or there are no pairs."""
    x, y = col(x), col(y)
    both = x.isNotNull() & y.isNotNull()
    only = lambda c: F.when(both, c)
    return F.covar_pop(only(x), only(y)) / F.nullif(F.stddev_pop(only(x)) * F.stddev_pop(only(y)), F.lit(0.0))


def unit_hash(seed: int | str, *parts: str | Column) -> Column:
    """Deterministic 32-bit draw from (seed, parts): same value on every engine."""
    text = F.concat_ws("|", F.lit(str(seed)), *[col(p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def draw_hash(seed: int | str, *parts: str | Column) -> Column:
    """Deterministic 60-bit draw, so that a remainder reaches every key of a large table."""
    text = F.concat_ws("|", F.lit(str(seed)), *[col(p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def draw_sql(seed: int | str, *parts: str) -> str:
    """The same draw as DuckDB text."""
    args = ", ".join([f"'{seed}'", *[f"CAST({p} AS VARCHAR)" for p in parts]])
    return f"CAST(CAST('0x'||substr(md5(concat_ws('|',{args})),1,15) AS UBIGINT) AS BIGINT)"


def hash_sql(seed: int | str, *parts: str) -> str:
    """The same draw as DuckDB text."""
    args = ", ".join([f"'{seed}'", *[f"CAST({p} AS VARCHAR)" for p in parts]])
    return f"CAST(CAST('0x'||substr(md5(concat_ws('|',{args})),1,8) AS UBIGINT) AS BIGINT)"
