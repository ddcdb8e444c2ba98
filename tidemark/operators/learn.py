"""Model fitting, search, calibration and experiment drivers on MLlib.

Learners are MLlib's; the driver only loops over model fits. Frames are wide
(keys, features, y); scores come back in the long form every metric reads.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    RandomForestClassifier,
)
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.expr import draw_hash, unit_hash
from tidemark.operators import metrics as M
from tidemark.operators.guards import content_hash
from tidemark.operators.ranks import percentile_columns
from tidemark.operators.splits import hash_rank
from tidemark.sources.tables import fitted, staged


def class_weights(df: DataFrame, y: str) -> DataFrame:
    """n / (2 n_k) per class, and the positive weight n0 / n1."""
    c = df.groupBy(y).agg(F.count("*").alias("n"))
    tot = c.agg(F.sum("n").alias("_n"), F.max(F.when(F.col(y) == 0, F.col("n"))).alias("_n0"), F.max(F.when(F.col(y) == 1, F.col("n"))).alias("_n1"))
    return c.join(F.broadcast(tot), F.lit(True)).select(
        y, "n", (F.col("_n") / (2.0 * F.col("n"))).alias("weight"), (F.col("_n0") / F.col("_n1")).alias("positive_weight")
    )


def balanced(df: DataFrame, y: str, positive_only: bool = False) -> DataFrame:
    """Add the class weight ``w``; the two class counts are read once."""
    n = df.agg(F.count_if(F.col(y) == 0), F.count_if(F.col(y) == 1)).first()
    if not n[0] or not n[1]:
        raise ValueError("training rows need both classes")
    zero, one = (1.0, n[0] / n[1]) if positive_only else ((n[0] + n[1]) / (2.0 * n[0]), (n[0] + n[1]) / (2.0 * n[1]))
    return df.withColumn("w", F.when(F.col(y) == 1, one).otherwise(zero))


def _assemble(features: Sequence[str], scale: bool):
    raw = VectorAssembler(inputCols=list(features), outputCol="raw" if scale else "features")
    return [raw, StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True)] if scale else [raw]


def _known(c: str) -> Column:
    """The column as a double; a missing or NaN input of a model raises, it never becomes a number by itself."""
    x = F.col(c).cast("double")
    return F.when(x.isNull() | F.isnan(x), F.raise_error(F.lit(f"model input {c} is missing or NaN")).cast("double")).otherwise(x)


def _ready(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return df.withColumns({c: _known(c) for c in features})


def fit_inputs(train: DataFrame, features: Sequence[str], lo: float = 0.01, hi: float = 0.99) -> dict[str, tuple[float, float, float]]:
    """Clip bounds and median of each feature over training rows (three numbers per feature reach the driver)."""
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in features])
    long = train.select(F.explode(cells).alias("x")).select("x.*")
    found = {r["feature"]: (r["lo"], r["hi"], r["mid"]) for r in percentile_columns(long, ["feature"], "value", {"lo": lo, "hi": hi, "mid": 0.5}).collect()}
    if lost := [c for c in features if c not in found]:
        raise ValueError(f"no training value for {lost}")
    return found


def prepare(df: DataFrame, inputs: dict[str, tuple[float, float, float]]) -> DataFrame:
    """Model inputs clipped to the training bounds, missing ones at the (clipped) training median."""
    clipped = lambda c, lo, hi: F.greatest(F.lit(lo), F.least(F.lit(hi), F.nanvl(F.col(c).cast("double"), F.lit(None))))
    return df.withColumns({c: F.when(F.col(c).isNull() | F.isnan(F.col(c).cast("double")), F.lit(float(mid))).otherwise(clipped(c, lo, hi)) for c, (lo, hi, mid) in inputs.items()})


def fit_logistic(train: DataFrame, features, y="y", c: float = 1.0, max_iter: int = 100, weighted: str | None = None) -> PipelineModel:
    """Ridge logistic; C on the summed weighted loss is regParam 1 / (C * sum of weights)."""
    data = _ready(train, features)
    data = data.withColumn("w", F.col(weighted)) if weighted else balanced(data, y)
    total = data.agg(F.sum("w")).first()[0] if weighted else data.count()  # balanced weights add up to n
    lr = LogisticRegression(labelCol=y, weightCol="w", elasticNetParam=0.0, regParam=1.0 / (c * total), maxIter=max_iter, standardization=False)
    return Pipeline(stages=[*_assemble(features, True), lr]).fit(data)


def fit_forest(train: DataFrame, features, y="y", trees: int = 100, depth: int = 8, min_leaf: int = 5, subset: str = "sqrt", seed: int = 42, weighted: str | None = None) -> PipelineModel:
    """Forest of weighted trees. Each row's place in every tree is kept, so a level goes on from there and does not come down from the root again."""
    data = _ready(train, features)
    data = data.withColumn("w", F.col(weighted)) if weighted else balanced(data, y)
    rf = RandomForestClassifier(labelCol=y, weightCol="w", numTrees=trees, maxDepth=depth, minInstancesPerNode=min_leaf, featureSubsetStrategy=subset, seed=seed, cacheNodeIds=True)
    return Pipeline(stages=[*_assemble(features, False), rf]).fit(data)


def fit_boosted(train: DataFrame, features, y="y", rounds: int = 100, depth: int = 4, rate: float = 0.1, subsample: float = 0.8, columns: str = "0.8", min_leaf: int = 5, seed: int = 42, weighted: str | None = None) -> PipelineModel:
    data = _ready(train, features)
    data = data.withColumn("w", F.col(weighted)) if weighted else balanced(data, y, positive_only=True)
    gbt = GBTClassifier(labelCol=y, weightCol="w", maxIter=rounds, maxDepth=depth, stepSize=rate, subsamplingRate=subsample, featureSubsetStrategy=columns, minInstancesPerNode=min_leaf, seed=seed)
    return Pipeline(stages=[*_assemble(features, False), gbt]).fit(data)


def oversample(train: DataFrame, keys: Sequence[str], y: str = "y", seed: int | str = 42) -> DataFrame:
    """Minority copies to exact parity: each minority row (unique by ``keys``) gets the whole multiple, the
    remainder goes to the first rows in hash order. Without a minority nothing is copied."""
    rank = hash_rank(train.where(F.col(y) == 1), keys, seed, "_rank")
    size = train.agg(F.count_if(F.col(y) == 1).alias("_n1"), F.count_if(F.col(y) == 0).alias("_n0"))
    j = train.join(rank, list(keys), "left").join(F.broadcast(size), F.lit(True))  # one row
    whole, rest = F.expr("_n0 div greatest(_n1, 1)"), F.col("_n0") % F.greatest("_n1", F.lit(1))
    copies = F.when((F.col(y) == 1) & (F.col("_n0") > F.col("_n1")), whole + (F.col("_rank") <= rest).cast("int")).otherwise(1)
    return j.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), copies.cast("long")))).drop("_rank", "_n1", "_n0", "_copy")


def abreast(df: DataFrame) -> int:
    """How many fits on the rows of ``df`` run side by side: those on few rows mostly wait for their jobs to start, those on many take all cores and hold much memory."""
    return max(4, min(12, (1 << 22) // max(1, df.count())))


def dealt(df: DataFrame, rows: int = 1 << 16) -> DataFrame:
    """``df`` staged for a fit that reads it in each of many short jobs: in even partitions, one for ``rows`` rows and as many as there are cores at most, since each
    costs every job a task."""
    held = staged(df)
    parts = max(1, min(df.sparkSession.sparkContext.defaultParallelism, -(-held.count() // rows)))
    return held.repartition(parts) if parts > 1 else held.coalesce(1)


def fit_network(train: DataFrame, features, keys, y="y", hidden: Sequence[int] = (16,), max_iter: int = 100, seed: int = 42) -> PipelineModel:
    """Sigmoid network on scaled inputs after oversampling (it takes no weights); oversampled rows are made once."""
    data = dealt(oversample(_ready(train, features), keys, y, seed).select(*features, y))
    net = MultilayerPerceptronClassifier(labelCol=y, layers=[len(features), *hidden, 2], maxIter=max_iter, seed=seed)
    return Pipeline(stages=[*_assemble(features, True), net]).fit(data)


def score(model: PipelineModel, df: DataFrame, features: Sequence[str], name: str) -> DataFrame:
    out = model.transform(_ready(df, features))
    drop = [c for c in ("raw", "features", "rawPrediction", "prediction") if c in out.columns]
    return out.withColumn("score", vector_to_array("probability")[1]).withColumn("model", F.lit(name)).drop("probability", *drop)


def ranked(scored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The curve of scores that a model makes: they are compressed and staged first. What a curve's join infers about its cells would otherwise be asked of each
    row, with the model in it many times over."""
    return M.curve(staged(M.compress(scored, list(keys))), list(keys))


def evaluate(scored_val: DataFrame, scored_test: DataFrame, keys: Sequence[str] = ("model",)) -> DataFrame:
    """Threshold on validation, all metrics on test."""
    k = list(keys)
    cuts = M.thresholds(ranked(scored_val, k), k)
    return M.metric_table(ranked(scored_test, k), k, cuts, k)


def search(
    folds: DataFrame, features: Sequence[str], candidates: Sequence[dict], fit: Callable[..., PipelineModel], store: str,
    y: str = "y", threads: int = 4,
) -> DataFrame:
    """Mean average precision of each candidate over purged folds.

    ``folds`` has (fold, role, features, y). Finished work is rows of the Parquet table ``store``, keyed by what
    it was made from: the learner and its parameters, the features and the content of the folds; a restart fits only
    what is missing, and nothing made from other data or parameters is taken for it. Fits run on driver
    threads, each one a distributed MLlib job.
    """
    spark = folds.sparkSession
    schema = "ap double, work string, fold int"
    folds = staged(folds.select("fold", "role", y, *features))
    content = content_hash(folds, ["fold", "role", y, *features]).first()
    code = getattr(fit, "__code__", None)
    learner = [getattr(fit, "__module__", ""), getattr(fit, "__qualname__", repr(fit)), *([code.co_code.hex(), repr(code.co_consts), repr(code.co_names)] if code else [])]
    work = [
        hashlib.sha256(json.dumps([*learner, c, list(features), y, *map(str, content)], sort_keys=True, default=str).encode()).hexdigest()
        for c in candidates
    ]
    wanted = [(i, r["fold"]) for i in range(len(candidates)) for r in folds.select("fold").distinct().orderBy("fold").collect()]
    try:
        done = {(r["work"], r["fold"]) for r in spark.read.schema(schema).parquet(store).select("work", "fold").collect()}
    except AnalysisException:  # no table yet
        done = set()

    def one(job):
        i, fold = job
        part = folds.where(F.col("fold") == fold)
        model = fit(part.where("role = 'train'"), features, y=y, **candidates[i])
        s = score(model, part.where("role = 'val'"), features, str(i))
        ap = ranked(s, ["model"]).agg(M.average_precision()).first()[0]
        row = spark.createDataFrame([(float(ap) if ap is not None else None,)], "ap double").coalesce(1)
        row.write.mode("overwrite").parquet(f"{store}/work={work[i]}/fold={fold}")

    with ThreadPoolExecutor(threads) as pool:
        list(pool.map(one, {(work[i], f): (i, f) for i, f in wanted if (work[i], f) not in done}.values()))
    named = spark.createDataFrame(list(enumerate(work)), "candidate int, work string")
    table = spark.read.schema(schema).parquet(store).join(F.broadcast(named), "work")  # a row per candidate
    return table.groupBy("candidate").agg(F.avg("ap").alias("mean_ap"), F.count("*").alias("n_folds"))


def run_variants(variants: dict[str, tuple[DataFrame, Sequence[str]]], learners: dict[str, Callable], y: str = "y", threads: int = 4) -> DataFrame:
    """Refit under data variants: name -> (frame with split column, features). Returns one
    long metric table keyed by (variant, model). Refits run on driver threads, each one a distributed job."""

    def one(job: tuple[str, str]) -> DataFrame:
        name, model_name = job
        df, features = variants[name]
        model = learners[model_name](df.where("split = 'train'"), features, y=y)
        tag = lambda split: score(model, df.where(F.col("split") == split), features, model_name).select(
            F.lit(name).alias("variant"), "model", F.col(y).alias("y"), "score"
        )
        return fitted(evaluate(tag("val"), tag("test"), ["variant", "model"]))  # one row

    with ThreadPoolExecutor(threads) as pool:
        parts = [*pool.map(one, [(v, m) for v in variants for m in learners])]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


# ------------------------------------------------------------ attribution of fits
def sampled_shapley(
    model: PipelineModel, rows: DataFrame, background: DataFrame, keys: Sequence[str], features: Sequence[str], perms: int = 8, seed: int | str = 42
) -> DataFrame:
    """Unbiased Shapley estimates with their Monte-Carlo standard error.

    Each row walks ``perms`` hashed feature orders, switching features from a background
    row to its own; all coalition rows are scored in one transform. ``background`` holds
    features and a dense 0-based ``bg`` index with its size in ``bg_n``.
    """
    f = list(features)
    own = F.array(*[_known(c) for c in f])
    base = rows.select(*keys, own.alias("own")).withColumn("perm", F.explode(F.sequence(F.lit(0), F.lit(perms - 1))))
    bg = background.select("bg", "bg_n", own.alias("other"))
    n = bg.agg(F.max("bg_n").alias("bg_n"))
    base = base.join(F.broadcast(n), F.lit(True)).withColumn("bg", draw_hash(seed, *keys, "perm") % F.col("bg_n")).drop("bg_n")
    j = base.join(bg.drop("bg_n"), "bg")
    order = F.array_sort(F.array(*[F.struct(unit_hash(seed, *keys, "perm", F.lit(i)).alias("h"), F.lit(i).alias("i")) for i in range(len(f))]))
    j = j.withColumn("order", F.transform(order, lambda s: s["i"]))
    steps = j.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(len(f)))))
    used = F.slice("order", F.lit(1), F.col("step"))
    mixed = [F.when(F.array_contains(used, F.lit(i)), F.col("own")[i]).otherwise(F.col("other")[i]).alias(c) for i, c in enumerate(f)]
    scored = score(model, steps.select(*keys, "perm", "step", "order", *mixed), f, "m")
    path = scored.groupBy(*keys, "perm").agg(F.array_sort(F.collect_list(F.struct("step", "score"))).alias("p"), F.first("order").alias("order"))
    gain = F.transform(F.sequence(F.lit(1), F.lit(len(f))), lambda t: F.struct(
        F.element_at("order", t).alias("i"), (F.element_at("p", t + 1)["score"] - F.element_at("p", t)["score"]).alias("g")))
    names = F.array(*[F.lit(c) for c in f])
    out = path.select(*keys, F.explode(gain).alias("x")).select(*keys, F.element_at(names, F.col("x.i") + 1).alias("feature"), F.col("x.g").alias("g"))
    return out.groupBy(*keys, "feature").agg(F.avg("g").alias("attr"), (F.stddev_samp("g") / F.sqrt(F.count("*"))).alias("mc_error"))


def local_surrogate(model: PipelineModel, cases: DataFrame, stats: dict[str, tuple[float, float]], keys: Sequence[str], features: Sequence[str], n: int = 500, seed: int | str = 42) -> DataFrame:
    """Weighted local linear fit per chosen row.

    Perturbations are normal draws from hashed uniforms, scored in one transform; only
    weighted moments per case (a few dozen numbers) reach the small solves.
    """
    f, p = list(features), len(features)
    width = 0.75 * np.sqrt(p)
    base = cases.select(*keys, *[_known(c).alias(c) for c in f])
    draws = base.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    u = lambda c, t: (unit_hash(seed, *keys, "draw", F.lit(c + t)) + 0.5) / float(2**32)
    normal = {c: F.sqrt(-2 * F.ln(u(c, "a"))) * F.cos(2 * np.pi * u(c, "b")) for c in f}
    z = draws.select(*keys, "draw", *[F.when(F.col("draw") == 0, 0.0).otherwise(normal[c]).alias(f"z_{c}") for c in f], *f)
    moved = z.withColumns({c: F.col(c) + F.col(f"z_{c}") * float(stats[c][1]) for c in f})
    s = score(model, moved, f, "m")
    dist = sum((F.col(f"z_{c}") * F.col(f"z_{c}") for c in f), F.lit(0.0))
    w = F.exp(-dist / float(width**2))
    cols = [F.lit(1.0), *[F.col(f"z_{c}") for c in f]]
    moments = s.groupBy(*keys).agg(
        *[F.sum(w * cols[i] * cols[j]).alias(f"g{i}_{j}") for i in range(p + 1) for j in range(i, p + 1)],
        *[F.sum(w * cols[i] * F.col("score")).alias(f"b{i}") for i in range(p + 1)],
    )

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        r = pdf.iloc[0]
        g = np.array([[r[f"g{min(i, j)}_{max(i, j)}"] for j in range(p + 1)] for i in range(p + 1)], dtype=float)
        coef = np.linalg.lstsq(g + 1e-9 * np.eye(p + 1), np.array([r[f"b{i}"] for i in range(p + 1)], dtype=float), rcond=None)[0]
        return pd.DataFrame({**{k: [r[k]] * p for k in keys}, "feature": f, "weight": coef[1:]})

    schema = ", ".join(f"{k} {dict(cases.dtypes)[k]}" for k in keys) + ", feature string, weight double"
    return moments.groupBy(*keys).applyInPandas(solve, schema)


