"""Report aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.expr import correlation
from tidemark.operators.ranks import average_ranks, percentile_columns


def profile(df: DataFrame, key: str, x: str, lower: float, upper: float) -> DataFrame:
    """Shape, percentiles, missing share and rows beyond cut-offs per feature.

    Infinite values count as missing."""
    finite = F.when(~F.isnan(x) & (F.abs(x) < float("inf")), F.col(x))
    base = df.select(key, finite.alias(x))
    shape = base.groupBy(key).agg(
        F.count("*").alias("n"),
        F.round(F.avg(F.col(x).isNull().cast("int")), 8).alias("missing_share"),
        F.round(F.skewness(x), 5).alias("skew_raw"),
        F.round(F.kurtosis(x), 5).alias("kurt_raw"),
        F.round(F.skewness(F.asinh(x)), 5).alias("skew_asinh"),
        F.round(F.kurtosis(F.asinh(x)), 5).alias("kurt_asinh"),
        F.count_if(F.col(x) < lower).alias("n_below"),
        F.count_if(F.col(x) > upper).alias("n_above"),
    )
    pct = percentile_columns(base, [key], x, {"p01": 0.01, "p50": 0.5, "p99": 0.99})
    pct = pct.select(key, *[F.round(c, 8).alias(c) for c in ("p01", "p50", "p99")])
    return shape.join(pct, key)


def event_rate(df: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    """Rows, events and event rate in percent per group."""
    n, e = F.count("*"), F.sum(label)
    return df.groupBy(*keys).agg(
        n.alias("n_rows"), e.cast("long").alias("n_events"), F.round(100.0 * e / n, 6).alias("rate_pct")
    )


def weighted_return(series: DataFrame, by: str, date: str, ret: str, cap: str) -> DataFrame:
    """Value-weighted return per date; the weight is the previous row's cap."""
    lagged = series.withColumn("_w", F.lag(cap).over(Window.partitionBy(by).orderBy(date)))
    ok = lagged.where(F.col(ret).isNotNull() & (F.col("_w") > 0))
    return ok.groupBy(date).agg(
        (F.sum(F.col("_w") * F.col(ret)) / F.sum("_w")).alias("vwret"), F.count("*").alias("n")
    )


def attrition(df: DataFrame, entity: str, steps: Sequence[tuple[str, Column]]) -> DataFrame:
    """Rows and distinct entities surviving each cumulative step, in one pass.

    Counting per entity first makes the distinct count a plain second-level sum.
    """
    alive, flags = F.lit(True), []
    for _, cond in steps:
        alive = alive & F.coalesce(cond, F.lit(False))
        flags.append(alive)
    per_entity = df.groupBy(entity).agg(*[F.count_if(f).alias(f"_s{i}") for i, f in enumerate(flags)])
    cells = F.array(
        *[
            F.struct(
                F.lit(i).alias("step_no"), F.lit(name).alias("step"),
                F.sum(f"_s{i}").alias("n_rows"), F.count_if(F.col(f"_s{i}") > 0).alias("n_entities"),
            )
            for i, (name, _) in enumerate(steps)
        ]
    )
    table = per_entity.agg(F.explode(cells).alias("c")).select("c.*")
    w = Window.partitionBy().orderBy("step_no")  # one row per step
    return table.withColumn("dropped", F.lag("n_rows").over(w) - F.col("n_rows"))


def correlations(df: DataFrame, cols: Sequence[str], threshold: float = 0.7) -> DataFrame:
    """Pairwise-complete Pearson correlations, one aggregation for all pairs; NULL for a constant column."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1 :]]
    cells = [F.struct(F.lit(a).alias("f1"), F.lit(b).alias("f2"), correlation(a, b).alias("r")) for a, b in pairs]
    long = df.agg(F.explode(F.array(*cells)).alias("c")).select("c.*")
    return long.withColumn("above", F.coalesce(F.abs("r") > threshold, F.lit(False)).cast("int"))


def ranked_by_group(df: DataFrame, keys: Sequence[str], x: str, group: str) -> DataFrame:
    """Distinct values with their pooled average rank and the count in each of two groups."""
    vals = df.where(F.col(x).isNotNull()).groupBy(*keys, x).agg(
        F.count("*").alias("n"), F.count_if(F.col(group) == 1).alias("n1")
    )
    from tidemark.operators.ranks import cumulate

    cum = cumulate(vals, list(keys), x, {"_upto": "n"})
    return cum.withColumn("rank", F.col("_upto") - (F.col("n") - 1) / F.lit(2.0)).withColumn("n0", F.col("n") - F.col("n1"))


def group_tests(df: DataFrame, key: str, x: str, group: str) -> DataFrame:
    """Moments and percentiles per group, Welch t and rank-sum z with two-sided p.

    rank_z is the plain statistic; rank_pvalue corrects for ties and continuity. What an empty or
    single-member group leaves undefined is NULL."""
    from tidemark.functions.normal import student_to_normal, two_sided_p

    known = df.where(F.col(x).isNotNull())
    stat = lambda f, g: f(F.when(F.col(group) == g, F.col(x)))
    mom = known.groupBy(key).agg(
        *[F.count(F.when(F.col(group) == g, 1)).alias(f"n_{g}") for g in (0, 1)],
        *[stat(F.avg, g).alias(f"mean_{g}") for g in (0, 1)],
        *[stat(F.stddev_samp, g).alias(f"sd_{g}") for g in (0, 1)],
    )
    pct = percentile_columns(known, [key, group], x, {"p10": 0.1, "median": 0.5, "p90": 0.9})
    wide = pct.groupBy(key).agg(
        *[F.max(F.when(F.col(group) == g, F.col(c))).alias(f"{c}_{g}") for g in (0, 1) for c in ("p10", "median", "p90")]
    )
    tied = F.col("n").cast("double")
    u = ranked_by_group(known, [key], x, group).groupBy(key).agg(
        F.sum(F.col("n0") * F.col("rank")).alias("_r0"), F.sum(tied * tied * tied - tied).alias("_ties")
    )
    n0, n1 = F.col("n_0").cast("double"), F.col("n_1").cast("double")  # their product passes a long at 3e9 rows
    some = lambda c: F.nullif(c, F.lit(0.0))
    v0, v1 = F.pow("sd_0", F.lit(2)) / some(n0), F.pow("sd_1", F.lit(2)) / some(n1)
    dof = F.pow(v0 + v1, F.lit(2)) / some(v0 * v0 / some(n0 - 1) + v1 * v1 / some(n1 - 1))
    out = mom.join(wide, key).join(u, key)
    out = out.withColumn("t_stat", (F.col("mean_0") - F.col("mean_1")) / some(F.sqrt(v0 + v1)))
    out = out.withColumn("t_pvalue", two_sided_p(student_to_normal(F.col("t_stat"), dof)))
    stat_u = F.col("_r0") - n0 * (n0 + 1) / 2
    off, total = stat_u - n0 * n1 / 2, n0 + n1
    out = out.withColumn("rank_z", off / some(F.sqrt(n0 * n1 * (total + 1) / 12.0)))
    spread = F.sqrt(n0 * n1 / 12.0 * (total + 1 - F.col("_ties") / some(total * (total - 1))))
    corrected = F.greatest(F.abs(off) - 0.5, F.lit(0.0)) / some(spread)
    return out.withColumn("rank_pvalue", two_sided_p(corrected)).drop("_r0", "_ties")


def balance(df: DataFrame, key: str, x: str, group: str, flag: float = 0.10) -> DataFrame:
    """Standardised differences (group 1 minus 0) on levels, log1p and pooled ranks."""

    def diff(m1, m0, v1, v0):
        return (m1 - m0) / F.nullif(F.sqrt((v1 + v0) / 2), F.lit(0.0))

    one, zero = F.col(group) == 1, F.col(group) == 0
    log = F.log1p(F.greatest(F.col(x), F.lit(0.0)))
    base = df.where(F.col(x).isNotNull()).groupBy(key).agg(
        *[
            f(F.when(c, e)).alias(n)
            for e, tag in ((F.col(x), "x"), (log, "l"))
            for c, g in ((one, 1), (zero, 0))
            for f, n in ((F.avg, f"m{tag}{g}"), (F.var_samp, f"v{tag}{g}"))
        ]
    )
    rk = ranked_by_group(df, [key], x, group)
    tot = rk.groupBy(key).agg(
        F.sum("n").alias("_n"),
        *[F.sum(f"n{g}").alias(f"c{g}") for g in (0, 1)],
        *[F.sum(F.col(f"n{g}") * F.col("rank")).alias(f"s{g}") for g in (0, 1)],
        *[F.sum(F.col(f"n{g}") * F.col("rank") * F.col("rank")).alias(f"q{g}") for g in (0, 1)],
    )
    some = lambda c: F.nullif(c.cast("double"), F.lit(0.0))
    size = {g: some(F.col(f"c{g}")) for g in (0, 1)}
    all_rows = F.col("_n").cast("double")
    mean = {g: F.col(f"s{g}") / size[g] / all_rows for g in (0, 1)}
    var = {
        g: (F.col(f"q{g}") - F.col(f"s{g}") * F.col(f"s{g}") / size[g]) / some(size[g] - 1) / (all_rows * all_rows)
        for g in (0, 1)
    }
    out = base.join(tot, key).select(
        key,
        diff(F.col("mx1"), F.col("mx0"), F.col("vx1"), F.col("vx0")).alias("std_diff"),
        diff(F.col("ml1"), F.col("ml0"), F.col("vl1"), F.col("vl0")).alias("std_diff_log"),
        diff(mean[1], mean[0], var[1], var[0]).alias("std_diff_rank"),
    )
    return out.withColumn("imbalanced", (F.abs("std_diff_rank") > flag).cast("int"))


def top_values(df: DataFrame, fields: Sequence[str], k: int = 25) -> DataFrame:
    """Most frequent values per field; NULL is a value of its own."""
    pairs = ", ".join(f"'{f}', CAST({f} AS STRING)" for f in fields)
    long = df.selectExpr(f"stack({len(fields)}, {pairs}) AS (field, value)")
    counts = long.groupBy("field", "value").agg(F.count("*").alias("n"))
    w = Window.partitionBy("field").orderBy(F.col("n").desc(), F.col("value").asc_nulls_first())
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def tertile_grid(df: DataFrame, a: str, b: str, score: str) -> DataFrame:
    """Mean score by tertile x tertile and its gap to the additive expectation.

    Bins are right-closed at the percentile edges; margins are unweighted means of
    the cell means.
    """
    from tidemark.functions.expr import right_closed_bin

    known = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    long = known.select(F.explode(F.array(*[F.struct(F.lit(n).alias("f"), F.col(c).alias("v")) for n, c in (("a", a), ("b", b))])).alias("x"))
    edge = percentile_columns(long.select("x.f", "x.v"), ["f"], "v", {"e1": 1 / 3, "e2": 2 / 3})
    edges = edge.agg(*[F.max(F.when(F.col("f") == n, F.col(f"e{i}"))).alias(f"{n}{i}") for n in ("a", "b") for i in (1, 2)])
    cut = known.join(F.broadcast(edges), F.lit(True))
    cut = cut.withColumn("bin_a", right_closed_bin(a, [F.col("a1"), F.col("a2")]))
    cut = cut.withColumn("bin_b", right_closed_bin(b, [F.col("b1"), F.col("b2")]))
    cell = cut.groupBy("bin_a", "bin_b").agg(F.count("*").alias("n"), F.avg(score).alias("mean_score"))
    return additive_gap(cell, "bin_a", "bin_b", "mean_score")


def additive_gap(cell: DataFrame, row: str, col: str, value: str) -> DataFrame:
    """Observed minus (row mean + column mean - grand mean) over cell means."""
    m = lambda *k: F.avg(value).over(Window.partitionBy(*k))
    return cell.withColumn("contrast", F.col(value) - (m(row) + m(col) - m()))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Pearson and Spearman correlation of a pair, infinities removed.

    Rows are collapsed to distinct (x, y) pairs before ranks are attached.
    """
    ok = F.col(x).isNotNull() & F.col(y).isNotNull() & (F.abs(x) < float("inf")) & (F.abs(y) < float("inf"))
    known = df.where(ok).select(F.col(x).alias("x"), F.col(y).alias("y"))
    pairs = known.groupBy("x", "y").agg(F.count("*").alias("w"))
    rx = average_ranks(known, [], "x").select("x", F.col("avg_rank").alias("rx"))
    ry = average_ranks(known, [], "y").select("y", F.col("avg_rank").alias("ry"))
    j = pairs.join(rx, "x").join(ry, "y")
    s = lambda e: F.sum(F.col("w") * e)
    n = F.sum("w")

    def weighted(a, b):
        cov = s(a * b) - s(a) * s(b) / n
        return cov / F.nullif(F.sqrt((s(a * a) - s(a) * s(a) / n) * (s(b * b) - s(b) * s(b) / n)), F.lit(0.0))

    return j.agg(
        n.alias("n"), weighted(F.col("x"), F.col("y")).alias("pearson"), weighted(F.col("rx"), F.col("ry")).alias("spearman")
    )


def label_histogram(df: DataFrame, x: str, label: str, bins: int = 35) -> DataFrame:
    """Density per label group on equal bins between the pooled 1st and 99th percentile."""
    known = df.where(F.col(x).isNotNull())
    lim = percentile_columns(known, [], x, {"lo": 0.01, "hi": 0.99})
    j = known.join(F.broadcast(lim), F.lit(True)).withColumn("_v", F.greatest("lo", F.least("hi", F.col(x))))
    width = F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0))  # equal values fall into bin 0, without a density
    pos = F.least(F.coalesce(F.floor((F.col("_v") - F.col("lo")) / width * bins), F.lit(0)), F.lit(bins - 1))
    cnt = j.groupBy(label, pos.alias("bin")).agg(F.count("*").alias("n"), F.first((F.col("hi") - F.col("lo")) / bins).alias("_w"))
    total = F.sum("n").over(Window.partitionBy(label))  # at most ``bins`` rows per group
    return cnt.withColumn("density", F.col("n") / F.nullif(total * F.col("_w"), F.lit(0.0))).drop("_w")
