"""Ranking, threshold, cost and calibration metrics on a long scored table.

Everything starts from ``compress``: one row per (keys, distinct score) with its
positives ``p`` and rows ``n`` (or their weights). Ties are collapsed by
construction and no later step sees single rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ranks import cumulate, percentiles, quantile_grid, row_number

WILSON_Z = 1.959963984540054


def compress(scored: DataFrame, keys: Sequence[str], weight: str | None = None) -> DataFrame:
    """A missing or NaN score has no place in a ranking and raises."""
    w = F.col(weight) if weight else F.lit(1)
    score = F.col("score")
    missing = score.isNull() | F.isnan(score.cast("double"))
    known = F.when(missing, F.raise_error(F.lit("a score is missing or NaN")).cast(scored.schema["score"].dataType)).otherwise(score)
    return scored.groupBy(*keys, known.alias("score")).agg(F.sum(F.col("y") * w).alias("p"), F.sum(w).alias("n"))


def curve(grouped: DataFrame, keys: Sequence[str], bits: int = 12) -> DataFrame:
    """Cumulative table from the highest score down: tp, m (flagged), and totals."""
    out = cumulate(grouped, list(keys), "score", {"tp": "p", "m": "n"}, desc=True, totals=True, bits=bits)
    return out.withColumnRenamed("tp_all", "pos").withColumn("neg", F.col("m_all") - F.col("pos")).drop("m_all")


def curve_points(c: DataFrame, keys: Sequence[str]) -> DataFrame:
    return c.select(
        *keys, "score", (F.col("tp") / F.nullif("pos", F.lit(0))).alias("recall"), (F.col("tp") / F.col("m")).alias("precision"),
        ((F.col("m") - F.col("tp")) / F.nullif("neg", F.lit(0))).alias("fpr"),
    )


def average_precision() -> Column:
    return F.sum(F.col("p") * F.col("tp").cast("double") / F.nullif(F.col("m"), F.lit(0.0))) / F.nullif(F.max("pos"), F.lit(0.0))


def roc_auc() -> Column:
    neg_here = F.col("n") - F.col("p")
    wins = F.sum(F.col("p") * (F.col("neg") - (F.col("m") - F.col("tp")) + neg_here / 2.0))
    return wins / F.nullif(F.max("pos").cast("double") * F.max("neg"), F.lit(0.0))


def ks_statistic() -> Column:
    gap = F.col("tp") / F.nullif(F.col("pos"), F.lit(0.0)) - (F.col("m") - F.col("tp")) / F.nullif(F.col("neg"), F.lit(0.0))
    return F.greatest(F.max(gap), F.lit(0.0))


def brier() -> Column:
    s = F.col("score")
    return F.sum(F.col("p") * (1 - s) * (1 - s) + (F.col("n") - F.col("p")) * s * s) / F.sum("n")


def thresholds(c: DataFrame, keys: Sequence[str], metric: str = "f1") -> DataFrame:
    """Best validation threshold over all distinct scores plus 0 and 1; ties go to the
    lowest. A threshold of 0 flags everything, one of 1 can never win alone."""
    tp, m, pos = F.col("tp"), F.col("m"), F.col("pos")
    value = {"f1": 2.0 * tp / (pos + m), "precision": tp / m, "recall": tp / F.nullif(pos, F.lit(0))}[metric]
    total = pos + F.col("neg")
    floor = {"f1": 2.0 * pos / (pos + total), "precision": pos / total, "recall": F.when(pos > 0, 1.0).otherwise(0.0)}[metric]
    best = F.max(F.struct(F.coalesce(value, F.lit(0.0)).cast("double").alias("v"), (-F.col("score")).alias("s")))
    out = c.groupBy(*keys).agg(best.alias("_b"), F.max(floor.cast("double")).alias("_zero"))
    zero = F.col("_zero") >= F.col("_b.v")
    return out.select(
        *keys, F.when(zero, 0.0).otherwise(-F.col("_b.s")).alias("threshold"), F.greatest("_zero", "_b.v").alias(f"best_{metric}")
    )


def metric_table(c: DataFrame, keys: Sequence[str], cuts: DataFrame, cut_keys: Sequence[str]) -> DataFrame:
    """All metrics per group from one curve; ``cuts`` holds one threshold per group."""
    j = c.join(F.broadcast(cuts.select(*cut_keys, "threshold")), list(cut_keys))  # one row per model
    flag = F.col("score") >= F.col("threshold")
    out = j.groupBy(*keys).agg(
        F.max("pos").alias("_pos"), F.sum("n").alias("n_obs"), average_precision().alias("pr_auc"), roc_auc().alias("roc_auc"),
        ks_statistic().alias("ks_stat"), brier().alias("brier_score"), F.max("threshold").alias("threshold"),
        F.sum(F.when(flag, F.col("p")).otherwise(0)).alias("_tp"), F.sum(F.when(flag, F.col("n")).otherwise(0)).alias("_m"),
    )
    tp, m, pos = F.col("_tp"), F.col("_m"), F.col("_pos")
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    return out.withColumns(
        {
            "n_events": pos,
            "prevalence": pos / F.col("n_obs"),
            "precision": zero(tp / F.nullif(m, F.lit(0))),
            "recall": zero(tp / F.nullif(pos, F.lit(0))),
            "f1": zero(2.0 * tp / F.nullif(pos + m, F.lit(0))),
        }
    ).drop("_tp", "_m", "_pos")


def capacity_table(val: DataFrame, test: DataFrame, capacities: Sequence[float]) -> DataFrame:
    """Review list from the validation quantile 1 - c applied unchanged to test."""
    # the given capacity is carried through; no lookup by rounded 1 - c
    cut = None
    for c in capacities:
        one = percentiles(val, ["model"], "score", [1 - c]).select("model", F.lit(float(c)).alias("capacity"), F.col("value").alias("threshold"))
        cut = one if cut is None else cut.unionByName(one)
    g = compress(test, ["model"]).join(F.broadcast(cut), "model")  # models x capacities rows
    flag = F.col("score") >= F.col("threshold")
    out = g.groupBy("model", "capacity").agg(
        F.max("threshold").alias("threshold"), F.sum(F.when(flag, F.col("n")).otherwise(0)).alias("n_reviewed"),
        F.sum(F.when(flag, F.col("p")).otherwise(0)).alias("tp"), F.sum("p").alias("_pos"), F.sum("n").alias("_n"),
    )
    prec = F.col("tp") / F.nullif("n_reviewed", F.lit(0))
    return out.select(
        "model", "capacity", "threshold", "n_reviewed", (F.col("n_reviewed") / F.col("_n")).alias("realised"), prec.alias("precision"),
        (F.col("tp") / F.nullif("_pos", F.lit(0))).alias("capture"), (prec / (F.col("_pos") / F.col("_n"))).alias("lift"),
        (1 / F.nullif(prec, F.lit(0.0))).alias("per_event"),
    )


def top_k_table(test: DataFrame, capacities: Sequence[float], tie: str) -> DataFrame:
    """Exactly the k highest scores, k = max(1, half-even rounded c*n); ties by ``tie``."""
    c = curve(compress(test, ["model"]), ["model"])
    caps = F.explode(F.array(*[F.lit(float(x)) for x in capacities]))
    total = F.col("pos") + F.col("neg")
    x = c.withColumn("capacity", caps).withColumn("k", F.greatest(F.bround(F.col("capacity") * total).cast("long"), F.lit(1)))
    above = x.groupBy("model", "capacity", "k").agg(
        F.max(F.when(F.col("m") <= F.col("k"), F.col("tp"))).alias("_tp_above"),
        F.max(F.when(F.col("m") <= F.col("k"), F.col("m"))).alias("_m_above"),
        F.max("pos").alias("pos"), F.max(total).alias("total"),
        F.max(F.when(F.col("m") > F.col("k"), F.col("score"))).alias("_edge"),
    )
    edge = above.select("model", "capacity", F.col("_edge").alias("score"), (F.col("k") - F.coalesce("_m_above", F.lit(0))).alias("_left"))
    tied = test.select("model", "score", "y", tie).join(F.broadcast(edge), ["model", "score"])  # models x capacities rows
    run = cumulate(tied.withColumn("_one", F.lit(1)), ["model", "capacity"], tie, {"_pos": "_one"})
    part = run.where(F.col("_pos") <= F.col("_left")).groupBy("model", "capacity").agg(F.sum("y").alias("_tp_edge"))
    out = above.join(part, ["model", "capacity"], "left")
    tp = F.coalesce("_tp_above", F.lit(0)) + F.coalesce("_tp_edge", F.lit(0))
    prec = tp / F.col("k")
    return out.select(
        "model", "capacity", "k", tp.alias("tp"), prec.alias("precision_at_k"), (tp / F.nullif("pos", F.lit(0))).alias("recall_at_k"),
        (prec / (F.col("pos") / F.col("total"))).alias("lift"),
    )


def cost_table(val: DataFrame, test: DataFrame, ratios: Sequence[int], grid: int = 2000) -> DataFrame:
    """Cost-minimising validation threshold per ratio on a quantile grid, applied to test."""
    cand = quantile_grid(val, ["model"], "score", grid).select("model", F.col("value").alias("score")).distinct()
    marks = cand.select("model", "score", F.lit(0).cast("long").alias("p"), F.lit(0).cast("long").alias("n"), F.lit(1).alias("mark"))
    g = compress(val, ["model"]).withColumn("mark", F.lit(0)).unionByName(marks)
    g = g.groupBy("model", "score").agg(F.sum("p").alias("p"), F.sum("n").alias("n"), F.max("mark").alias("mark"))
    c = curve(g, ["model"]).where("mark = 1")
    ratio = F.explode(F.array(*[F.lit(int(r)) for r in ratios]))
    c = c.withColumn("ratio", ratio)
    cost = (F.col("ratio") * (F.col("pos") - F.col("tp")) + (F.col("m") - F.col("tp"))) / (F.col("pos") + F.col("neg"))
    best = c.groupBy("model", "ratio").agg(F.min(F.struct(cost.alias("c"), F.col("score").alias("t"))).alias("_b"))
    cuts = best.select("model", "ratio", F.col("_b.t").alias("threshold"))
    j = compress(test, ["model"]).join(F.broadcast(cuts), "model")  # models x ratios rows
    low = F.col("score") < F.col("threshold")
    out = j.groupBy("model", "ratio").agg(
        F.max("threshold").alias("threshold"), F.sum(F.when(low, F.col("p")).otherwise(0)).alias("fn"),
        F.sum(F.when(~low, F.col("n") - F.col("p")).otherwise(0)).alias("fp"), F.sum("p").alias("_p"), F.sum("n").alias("_n"),
    )
    none, every = F.col("ratio") * F.col("_p") / F.col("_n"), (F.col("_n") - F.col("_p")) / F.col("_n")
    out = out.withColumns({"cost": (F.col("ratio") * F.col("fn") + F.col("fp")) / F.col("_n"), "cost_none": none, "cost_all": every})
    trivial = F.least("cost_none", "cost_all")
    return out.withColumn("savings_pct", 100.0 * (trivial - F.col("cost")) / trivial).drop("_p", "_n")


def expected_calibration_error(scored: DataFrame, keys: Sequence[str], bins: int = 10) -> DataFrame:
    """Quantile-bin ECE: unique percentile edges, left-closed bins, last bin closed."""
    edges = percentiles(scored, list(keys), "score", [i / bins for i in range(bins + 1)])
    arr = edges.groupBy(*keys).agg(F.sort_array(F.collect_set("value")).alias("_edges"))  # bins + 1 values
    j = compress(scored, keys).join(F.broadcast(arr), list(keys))
    pos = F.size(F.filter("_edges", lambda e: e <= F.col("score")))
    b = j.withColumn("_bin", F.least(F.greatest(pos, F.lit(1)), F.size("_edges") - 1))
    cell = b.groupBy(*keys, "_bin").agg(F.sum("p").alias("p"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("score")).alias("s"))
    return cell.groupBy(*keys).agg((F.sum(F.abs(F.col("p") - F.col("s"))) / F.sum("n")).alias("ece"))


def equal_count_bin(rn: Column, total: Column, k: int) -> Column:
    """0-based bin of k near-equal parts, the first (total mod k) one row longer."""
    size, extra = F.floor(total / k), total % k
    long_rows = extra * (size + 1)
    return F.when(rn <= long_rows, F.floor((rn - 1) / (size + 1))).otherwise(
        extra + F.floor((rn - 1 - long_rows) / F.greatest(size, F.lit(1)))
    ).cast("long")


def reliability(scored: DataFrame, keys: Sequence[str], tie: str, bins: int = 10) -> DataFrame:
    """Equal-count bins by score with the observed rate and its Wilson interval."""
    total = scored.groupBy(*keys).agg(F.count("*").alias("_all"))
    rn = row_number(scored, list(keys), "score", tie).join(F.broadcast(total), list(keys))
    cell = rn.groupBy(*keys, equal_count_bin(F.col("rn"), F.col("_all"), bins).alias("bin")).agg(
        F.count("*").alias("n"), F.avg("score").alias("mean_score"), F.avg(F.col("y").cast("double")).alias("observed")
    )
    z2, n, p = WILSON_Z**2, F.col("n").cast("double"), F.col("observed")
    denom = 1 + z2 / n
    centre = (p + z2 / (2 * n)) / denom
    half = WILSON_Z * F.sqrt((p * (1 - p) + z2 / (4 * n)) / n) / denom
    return cell.withColumns({"lower": F.greatest(centre - half, F.lit(0.0)), "upper": F.least(centre + half, F.lit(1.0))})


def logit_map(grouped: DataFrame, x: Column, iterations: int = 25, offset: bool = False) -> DataFrame:
    """Unregularised logistic fit of the outcome on one column per model, by Newton.

    Each step is one aggregation over the compressed table for all models at once;
    only two coefficients per model come back. With ``offset`` the slope is fixed
    at 1 and only the intercept is fitted. Returns (model, a, b). A model whose fit does not
    exist (one class, one distinct score, classes that a cut separates) or does not settle
    within ``iterations`` steps has NULL coefficients.
    """
    spark = grouped.sparkSession
    data = grouped.select("model", "p", "n", x.cast("double").alias("x")).persist()
    coef = {r["model"]: (0.0, 1.0 if offset else 0.0) for r in data.select("model").distinct().collect()}
    settled: set = set()
    for _ in range(iterations):
        table = spark.createDataFrame([(m, a, b) for m, (a, b) in coef.items() if m not in settled], "model string, a double, b double")
        q = 1 / (1 + F.exp(-(F.col("a") + F.col("b") * F.col("x"))))
        w, res = F.col("n") * q * (1 - q), F.col("p") - F.col("n") * q
        sums = data.join(F.broadcast(table), "model").groupBy("model").agg(
            F.sum(res).alias("g0"), F.sum(res * F.col("x")).alias("g1"), F.sum(w).alias("h00"),
            F.sum(w * F.col("x")).alias("h01"), F.sum(w * F.col("x") * F.col("x")).alias("h11"),
        ).collect()
        for s in sums:
            a, b = coef[s["model"]]
            det = s["h00"] * s["h11"] - s["h01"] ** 2
            if not s["h00"] > 1e-9 or not (offset or det > 1e-12 * s["h00"] * s["h11"]):
                continue  # flat: no finite solution in sight
            if offset:
                da, db = s["g0"] / s["h00"], 0.0
            else:
                da = (s["h11"] * s["g0"] - s["h01"] * s["g1"]) / det
                db = (s["h00"] * s["g1"] - s["h01"] * s["g0"]) / det
            coef[s["model"]] = (a + da, b + db)
            if max(abs(da), abs(db)) < 1e-9 * max(1.0, abs(a), abs(b)):
                settled.add(s["model"])
        if len(settled) == len(coef):
            break
    data.unpersist()
    out = [(m, *(ab if m in settled else (None, None))) for m, ab in coef.items()]
    return spark.createDataFrame(out, "model string, a double, b double")


def apply_logit_map(scored: DataFrame, fitted: DataFrame) -> DataFrame:
    j = scored.join(F.broadcast(fitted), "model")
    return j.withColumn("score", 1 / (1 + F.exp(-(F.col("a") + F.col("b") * F.col("score"))))).drop("a", "b")
