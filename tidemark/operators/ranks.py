"""Exact order statistics without a single-task sort.

A running total, rank or percentile over one huge group would put that group in
one task. Here every value falls into an order-preserving *cell*: a log-linear
slice with ``2**bits`` slices per power of two, a pure function of the value, so
all branches and retries agree on it. Cell totals are a small map-side-combined
aggregate (a double spans at most 4,200 powers of two with its sign), their prefix
sums give each cell its offset, and a window only ever sorts one cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BITS = 12


def cell(x: str | Column, bits: int = BITS) -> Column:
    """Cell number (long), weakly increasing in ``x``; NULL for NULL.

    Continuous across powers of two, so a rounding error in log2 cannot break order.
    """
    v = (F.col(x) if isinstance(x, str) else x).cast("double")
    size = F.least(F.abs(v), F.lit(1.7e308))
    slices = F.lit(float(2**bits))
    octave = F.floor(F.log2(size))
    code = (octave + 1100) * 2**bits + F.floor(size / F.pow(F.lit(2.0), octave.cast("double")) * slices) - 2**bits + 1
    signed = F.when(v > 0, code).when(v < 0, -code).when(v == 0, 0)
    return signed.cast("long")


def cumulate(
    df: DataFrame, keys: list[str], x: str, sums: dict[str, str], desc: bool = False, bits: int = BITS,
    totals: bool = False,
) -> DataFrame:
    """Running sums over distinct ``x`` inside ``keys`` (inclusive of the row).

    ``sums`` maps new column name to the column to add up. ``df`` must hold one
    row per (keys, x). ``totals`` also adds each group's total as ``<name>_all``.
    """
    celled = df.withColumn("_cell", cell(x, bits))
    order = F.col("_cell").desc() if desc else F.col("_cell").asc()
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    per_cell = celled.groupBy(*keys, "_cell").agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])
    whole = Window.partitionBy(*keys)
    offsets = per_cell.select(
        *keys, "_cell", *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums],
        *[F.sum(f"_t_{n}").over(whole).alias(f"{n}_all") for n in sums if totals],
    )
    order = F.col(x).desc() if desc else F.col(x).asc()
    inside = Window.partitionBy(*keys, "_cell").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = celled.join(offsets, [*keys, "_cell"])
    for n, c in sums.items():
        out = out.withColumn(n, F.col(f"_o_{n}") + F.sum(c).over(inside))
    return out.drop("_cell", *[f"_o_{n}" for n in sums])


def average_ranks(df: DataFrame, keys: list[str], x: str) -> DataFrame:
    """One row per distinct value: count, and rank with ties averaged."""
    grouped = df.where(F.col(x).isNotNull()).groupBy(*keys, x).agg(F.count("*").alias("n_tied"))
    cum = cumulate(grouped, keys, x, {"_upto": "n_tied"})
    return cum.withColumn("avg_rank", F.col("_upto") - (F.col("n_tied") - 1) / F.lit(2.0)).drop("_upto")


def percentiles(df: DataFrame, keys: list[str], x: str, probs: list[float], bits: int = BITS) -> DataFrame:
    """Exact linear-interpolation percentiles: one row per (keys, prob).

    Two scans: a cell histogram locates the cells that hold the wanted ranks (at
    most two per probability), then only the rows of those cells are counted by value.
    """
    base = df.select(*keys, F.col(x).cast("double").alias("_x")).where(F.col("_x").isNotNull() & ~F.isnan("_x"))
    celled = base.withColumn("_cell", cell("_x", bits))
    hist = celled.groupBy(*keys, "_cell").agg(F.count("*").alias("_n"))
    w_all = Window.partitionBy(*keys)
    w_up = w_all.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    hist = hist.withColumn("_before", F.coalesce(F.sum("_n").over(w_up), F.lit(0)))
    hist = hist.withColumn("_total", F.sum("_n").over(w_all))

    def wanted(p: float) -> list[Column]:
        pos = F.lit(float(p)) * (F.col("_total") - 1)
        low, frac = F.floor(pos), pos - F.floor(pos)
        make = lambda rank: F.struct(F.lit(float(p)).alias("p"), rank.alias("r"), frac.alias("frac"))
        return [make(low), make(F.ceil(pos))]

    ranks = F.array(*[w for p in probs for w in wanted(p)])
    inside = F.filter(ranks, lambda s: (s.r >= F.col("_before")) & (s.r < F.col("_before") + F.col("_n")))
    target = hist.select(*keys, "_cell", "_before", inside.alias("_want")).where(F.size("_want") > 0)
    # two cells per probability and group: the planner broadcasts them if they are few
    rows = celled.join(target.select(*keys, "_cell"), [*keys, "_cell"], "left_semi")
    vals = rows.groupBy(*keys, "_cell", "_x").agg(F.count("*").alias("_n"))
    w_in = Window.partitionBy(*keys, "_cell").orderBy("_x").rowsBetween(Window.unboundedPreceding, 0)
    vals = vals.withColumn("_upto", F.sum("_n").over(w_in)).join(target, [*keys, "_cell"])
    hits = vals.select(*keys, "_x", "_n", (F.col("_before") + F.col("_upto")).alias("_end"), F.explode("_want").alias("_w"))
    hits = hits.where((F.col("_w.r") >= F.col("_end") - F.col("_n")) & (F.col("_w.r") < F.col("_end")))
    return hits.groupBy(*keys, F.col("_w.p").alias("prob")).agg(between("_x", F.max("_w.frac")).alias("value"))


def between(x: str, frac: Column) -> Column:
    """Interpolate from the smaller to the larger neighbour; exact when they are equal."""
    return F.min(x) + frac * (F.max(x) - F.min(x))


def percentile_columns(df: DataFrame, keys: list[str], x: str, named: dict[str, float]) -> DataFrame:
    """``percentiles`` turned into one row per group with named columns."""
    long = percentiles(df, keys, x, sorted(set(named.values())))
    return long.groupBy(*keys).agg(
        *[F.max(F.when(F.col("prob") == F.lit(float(p)), F.col("value"))).alias(n) for n, p in named.items()]
    )


def dense_index(df: DataFrame, key: str, name: str = "idx", size: str | None = None) -> DataFrame:
    """Zero-based position of each distinct numeric ``key`` in key order; ``size`` also
    names a column holding the number of keys."""
    uniq = df.select(key).distinct().withColumn("_one", F.lit(1))
    cum = cumulate(uniq, [], key, {name: "_one"}, totals=size is not None)
    extra = [F.col(f"{name}_all").cast("long").alias(size)] if size else []
    return cum.select(key, (F.col(name) - 1).cast("long").alias(name), *extra)


def row_number(df: DataFrame, keys: list[str], x: str, tie: str, desc: bool = False, name: str = "rn") -> DataFrame:
    """Exact row number by (x, tie) inside ``keys``; ``tie`` is numeric and unique per (keys, x)."""
    grouped = df.groupBy(*keys, x).agg(F.count("*").alias("_n"))
    upto = cumulate(grouped, keys, x, {"_upto": "_n"}, desc=desc).withColumn("_start", F.col("_upto") - F.col("_n"))
    inner = cumulate(df.withColumn("_one", F.lit(1)), [*keys, x], tie, {"_in": "_one"}).drop("_one")
    return inner.join(upto.drop("_n", "_upto"), [*keys, x]).withColumn(name, F.col("_start") + F.col("_in")).drop("_start", "_in")


def quantile_grid(df: DataFrame, keys: list[str], x: str, m: int) -> DataFrame:
    """The m+1 evenly spaced percentiles per group: rows (keys, j, value), j = 0..m.

    Every distinct value emits only the grid positions whose neighbours it is.
    """
    grouped = df.where(F.col(x).isNotNull()).groupBy(*keys, x).agg(F.count("*").alias("_n"))
    cum = cumulate(grouped, keys, x, {"_upto": "_n"}, totals=True)
    last = cum.withColumns({"_a": F.col("_upto") - F.col("_n"), "_b": F.col("_upto") - 1, "_d": F.col("_upto_all") - 1})
    a, b, d = F.col("_a"), F.col("_b"), F.col("_d")
    one = d == 0
    low_from = F.when(one, 0).otherwise(F.expr(f"(_a * {m} + _d - 1) div greatest(_d, 1)"))
    low_to = F.when(one, m).otherwise(F.expr(f"((_b + 1) * {m} + _d - 1) div greatest(_d, 1) - 1"))
    high_from = F.when(one | (a == 0), 0).otherwise(F.expr(f"((_a - 1) * {m}) div greatest(_d, 1) + 1"))
    high_to = F.when(one, m).otherwise(F.expr(f"(_b * {m}) div greatest(_d, 1)"))
    pos = F.col("j") * d / F.lit(float(m))

    def side(lo, hi):
        hi = F.least(hi, F.lit(m)).cast("long")
        part = last.where(lo <= hi).withColumn("j", F.explode(F.sequence(lo.cast("long"), hi)))
        return part.select(*keys, "j", F.col(x).alias("_v"), (pos - F.floor(pos)).alias("_frac"))

    both = side(low_from, low_to).unionByName(side(high_from, high_to))
    return both.groupBy(*keys, "j").agg(between("_v", F.max("_frac")).alias("value"))
