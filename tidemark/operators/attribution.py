"""Attribution tables: long rows (model, keys, feature, value, attr) in, reports out.

Rankings hold one row per feature, so windows and pair joins over them are bounded by
the feature list; row-level work is map-side-combined aggregation per feature.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.expr import correlation, right_closed_bin
from tidemark.operators.inference import multiplicity_matrix, weighted_sums
from tidemark.operators.ranks import percentile_columns
from tidemark.sources.tables import fitted, staged

# ---- fixed values: expected direction of each predictor and support regions ----
EXPECTED_SIGN = {
    "tlta": "+", "nita": "-", "sigma": "+", "exret": "-", "lnta": "-", "wcta": "-", "cashta": "-", "ocf_ta": "-",
    "lnmk": "-", "nita_lag": "-", "clca": "+", "oeneg": "+", "chin": "-", "intwo": "+", "mb": "-", "rsize": "-", "price": "-",
}
SUPPORT_EDGES = {
    "tlta": (0.6, 1.0), "nita": (-0.1, 0.0), "sigma": (0.05, 0.15), "exret": (-0.5, 0.0), "lnta": (4.0, 8.0),
}
# --------------------------------------------------------------------------------


def scale_stats(train: DataFrame) -> DataFrame:
    """Mean and population sd per feature from training rows."""
    return train.groupBy("feature").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"))


def linear_attribution(long: DataFrame, stats: DataFrame, coefs: DataFrame) -> DataFrame:
    """coef * (value - mean) / sd per row and feature; ``coefs`` is (model, feature, coef)."""
    fitted = coefs.join(F.broadcast(stats), "feature")
    j = long.join(F.broadcast(fitted), "feature")  # models x features rows
    z = (F.col("value") - F.col("mean")) / F.nullif("sd", F.lit(0.0))
    return j.withColumn("attr", F.col("coef") * z).drop("mean", "sd", "coef")


def importance(attr: DataFrame) -> DataFrame:
    out = attr.groupBy("model", "feature").agg(F.avg(F.abs("attr")).alias("mean_abs"))
    return out.withColumn("rank", F.rank().over(Window.partitionBy("model").orderBy(F.col("mean_abs").desc())))


def top_features(ranking: DataFrame, k: int, always: Sequence[str]) -> DataFrame:
    """Top-k features of a ranking, plus a fixed list."""
    spark = ranking.sparkSession
    top = ranking.orderBy(F.col("mean_abs").desc(), "feature").limit(k).select("feature")
    return top.union(spark.createDataFrame([(f,) for f in always], "feature string")).distinct()


def directions(attr: DataFrame, ambiguous: float = 0.1) -> DataFrame:
    """Correlation of value and attribution, its sign, and the verdict against theory.

    An undefined correlation, or one over fewer than ten finite rows, counts as 0; 0 counts as positive."""
    spark = attr.sparkSession
    signs = spark.createDataFrame(list(EXPECTED_SIGN.items()), "feature string, expected string")
    finite = lambda c: F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c).cast("double"))
    enough = F.count(F.when(finite("value").isNotNull() & finite("attr").isNotNull(), 1)) >= 10
    r = F.when(enough, F.coalesce(correlation(finite("value"), finite("attr")), F.lit(0.0))).otherwise(0.0)
    d = attr.groupBy("model", "feature").agg(
        r.alias("r"), F.avg("attr").alias("mean_attr"), F.avg(F.abs("attr")).alias("mean_abs")
    )
    d = d.withColumn("observed", F.when(F.col("r") >= 0, "+").otherwise("-"))
    d = d.withColumn("rank", F.rank().over(Window.partitionBy("model").orderBy(F.col("mean_abs").desc())))
    j = d.join(F.broadcast(signs), "feature", "left")
    same = F.col("observed") == F.col("expected")
    verdict = F.when(F.col("expected").isNull(), None).when(~same, "Inconsistent").when(F.abs("r") > ambiguous, "Consistent").otherwise("Ambiguous")
    return j.withColumn("verdict", verdict)


def sign_compare(attr: DataFrame) -> DataFrame:
    """Sign of the mean attribution against the sign of the correlation."""
    sign = lambda c: F.when(F.col(c) > 0, "+").when(F.col(c) < 0, "-").otherwise("0")
    d = attr.groupBy("model", "feature").agg(F.avg("attr").alias("mean_attr"), correlation("value", "attr").alias("r"))
    d = d.withColumns({"mean_sign": sign("mean_attr"), "corr_sign": sign("r")})
    return d.withColumn("agree", (F.col("mean_sign") == F.col("corr_sign")).cast("int"))


def collinear_partner(pairs: DataFrame, features: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Strongest partner of each listed feature inside the list, both ways.

    ``pairs`` is (f1, f2, r); features without a partner above the threshold get ''.
    """
    both = pairs.select(F.col("f1").alias("feature"), F.col("f2").alias("partner"), F.abs("r").alias("r")).unionByName(
        pairs.select(F.col("f2").alias("feature"), F.col("f1").alias("partner"), F.abs("r").alias("r"))
    )
    ours = both.join(F.broadcast(features), "feature", "left_semi").join(
        F.broadcast(features.select(F.col("feature").alias("partner"))), "partner", "left_semi"
    )
    best = ours.groupBy("feature").agg(F.max(F.struct("r", "partner")).alias("b"))
    high = F.col("b.r") > threshold
    return features.select("feature").join(F.broadcast(best), "feature", "left").select(
        "feature", F.coalesce("b.r", F.lit(0.0)).alias("max_r"), F.when(high, F.col("b.partner")).otherwise("").alias("partner"),
        F.coalesce(high, F.lit(False)).cast("int").alias("collinear"),
    )


def adjust_verdict(verdict: str, collinear: str) -> Column:
    return F.when(F.col(collinear) == 1, "Ambiguous-collinear").otherwise(F.col(verdict))


def kendall(ranking: DataFrame, a: str, b: str) -> DataFrame:
    """Kendall tau-b and hyperbolically weighted tau of two importance columns.

    Weights follow the top-heavy scheme 1/(1 + position), averaged over the two
    tie-breaking orders. ``ranking`` holds one row per feature.
    """
    def pos(first, second):
        return F.row_number().over(Window.orderBy(F.col(first).desc(), F.col(second).desc(), "feature")) - 1

    base = ranking.select("feature", F.col(a).alias("a"), F.col(b).alias("b"))
    base = base.withColumns({"w1": 1 / (1.0 + pos("a", "b")), "w2": 1 / (1.0 + pos("b", "a"))})
    x, y = base.alias("x"), base.alias("y")
    j = x.join(y, F.col("x.feature") < F.col("y.feature"))  # feature pairs
    sa, sb = F.signum(F.col("x.a") - F.col("y.a")), F.signum(F.col("x.b") - F.col("y.b"))

    def tau(weight):
        return F.sum(weight * sa * sb) / F.nullif(F.sqrt(F.sum(weight * sa * sa) * F.sum(weight * sb * sb)), F.lit(0.0))

    w1, w2 = F.col("x.w1") + F.col("y.w1"), F.col("x.w2") + F.col("y.w2")
    return j.agg(tau(F.lit(1.0)).alias("tau_b"), ((tau(w1) + tau(w2)) / 2).alias("weighted_tau"))


def top_union(ranking: DataFrame, a: str, b: str, k: int) -> DataFrame:
    """Features among the k largest of either column."""
    place = lambda c: F.row_number().over(Window.orderBy(F.col(c).desc(), "feature"))
    return ranking.withColumns({"_pa": place(a), "_pb": place(b)}).where((F.col("_pa") <= k) | (F.col("_pb") <= k)).drop("_pa", "_pb")


def topk_overlap(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """Shared features of two top-k lists by |weight|, and sign agreement on their union."""
    place = F.row_number().over(Window.orderBy(F.abs("weight").desc(), "feature"))
    top = lambda x, n: x.withColumn(f"in_{n}", (place <= k).cast("int")).withColumnRenamed("weight", n)
    j = top(a, "wa").join(top(b, "wb"), "feature", "full")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    u = j.where((zero("in_wa") == 1) | (zero("in_wb") == 1))
    same = F.signum(F.coalesce("wa", F.lit(0.0))) == F.signum(F.coalesce("wb", F.lit(0.0)))
    return u.agg(
        F.count("*").alias("n_union"), F.count_if((zero("in_wa") == 1) & (zero("in_wb") == 1)).alias("n_shared"),
        F.avg(same.cast("int")).alias("sign_agreement"),
    )


def rank_compare(a: DataFrame, b: DataFrame, top: int) -> DataFrame:
    """Full outer join of two rankings (feature, rank) with the difference."""
    j = a.withColumnRenamed("rank", "rank_a").join(b.withColumnRenamed("rank", "rank_b"), "feature", "full")
    j = j.withColumn("shift", F.col("rank_b") - F.col("rank_a"))
    return j.orderBy(F.col("rank_a").asc_nulls_last(), "feature").limit(top)


def dependence_bins(attr: DataFrame) -> DataFrame:
    """Support, mean value and mean/median attribution in fixed right-closed regions;
    features without fixed regions use tertiles. Empty regions are kept."""
    spark = attr.sparkSession
    third = percentile_columns(attr, ["feature"], "value", {"t1": 1 / 3, "t2": 2 / 3})
    fixed = spark.createDataFrame([(f, *e) for f, e in SUPPORT_EDGES.items()], "feature string, f1 double, f2 double")
    edges = third.join(F.broadcast(fixed), "feature", "left").select(
        "feature", F.coalesce("f1", "t1").alias("e1"), F.coalesce("f2", "t2").alias("e2")
    )
    edges = fitted(edges)  # one row per feature
    known = attr.where(F.col("value").isNotNull() & F.col("attr").isNotNull())
    binned = known.join(F.broadcast(edges), "feature").withColumn("region", right_closed_bin("value", [F.col("e1"), F.col("e2")]))
    cell = binned.groupBy("feature", "region").agg(F.count("*").alias("n"), F.avg("value").alias("mean_value"), F.avg("attr").alias("mean_attr"))
    mid = percentile_columns(binned, ["feature", "region"], "attr", {"median_attr": 0.5})
    grid = edges.select("feature", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("region"))
    j = grid.join(F.broadcast(cell), ["feature", "region"], "left").join(F.broadcast(mid), ["feature", "region"], "left")
    j = j.withColumn("n", F.coalesce("n", F.lit(0)))
    return j.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("feature")))  # three regions


def rank_stability(attr: DataFrame, entity: str, reps: int, seed: int | str = 42, span: float = 3.0, cv: float = 0.30) -> DataFrame:
    """Rank and magnitude stability over entity-block resamples.

    Attribution is summed once per entity; all reps reweight those sums together, as arrays.
    """
    per = attr.groupBy(entity, "feature").agg(F.sum(F.abs("attr")).alias("s"), F.count("attr").alias("n"))
    per = staged(per)
    sums = weighted_sums(per, ["feature"], ["s", "n"], entity, multiplicity_matrix(per, entity, reps, seed))

    def means(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                s, n = np.frombuffer(row["s"]), np.frombuffer(row["n"])
                drawn = np.flatnonzero(n > 0)
                yield pa.RecordBatch.from_arrays([pa.array(drawn), pa.array([row["feature"]] * len(drawn)), pa.array(s[drawn] / n[drawn])], names=["rep", "feature", "m"])

    mag = fitted(sums.mapInArrow(means, "rep long, feature string, m double"))
    ranked = mag.withColumn("r", F.rank().over(Window.partitionBy("rep").orderBy(F.col("m").desc())))  # features of a rep
    cut = lambda c: F.percentile(c, F.array(F.lit(0.025), F.lit(0.975)))
    out = ranked.groupBy("feature").agg(
        F.avg("r").alias("mean_rank"), F.stddev_pop("r").alias("sd_rank"), cut("r")[0].alias("rank_lower"), cut("r")[1].alias("rank_upper"),
        F.avg("m").alias("mean_abs"), F.stddev_pop("m").alias("sd_abs"), cut("m")[0].alias("abs_lower"), cut("m")[1].alias("abs_upper"),
    )
    ratio = F.col("sd_abs") / F.nullif("mean_abs", F.lit(0.0))
    return out.withColumns({
        "magnitude_cv": ratio, "rank_stable": ((F.col("rank_upper") - F.col("rank_lower")) <= span).cast("int"),
        "magnitude_stable": F.coalesce(ratio <= cv, F.lit(False)).cast("int"),
    })


def select_cases(scored: DataFrame, threshold: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Three cases per model: surest hit, worst miss, surest rejection.

    ``threshold`` is (model, threshold); ties go to the smallest key.
    """
    j = scored.join(F.broadcast(threshold.select("model", "threshold")), "model")
    hit = (F.col("y") == 1) & (F.col("score") >= F.col("threshold"))
    miss = (F.col("y") == 1) & (F.col("score") < F.col("threshold"))
    clear = (F.col("y") == 0) & (F.col("score") < F.col("threshold"))
    high = F.struct((-F.col("score")).alias("o"), *keys, "score")
    low = F.struct(F.col("score").alias("o"), *keys, "score")
    picked = j.groupBy("model").agg(
        F.min(F.when(hit, high)).alias("hit"), F.min(F.when(miss, low)).alias("miss"), F.min(F.when(clear, low)).alias("clear")
    )
    cases = F.array(*[F.struct(F.lit(n).alias("case"), F.col(n).alias("c")) for n in ("hit", "miss", "clear")])
    out = picked.select("model", F.explode(cases).alias("x")).where(F.col("x.c").isNotNull())
    return out.select("model", "x.case", *[F.col(f"x.c.{k}").alias(k) for k in keys], F.col("x.c.score").alias("score"))
