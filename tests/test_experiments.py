"""Resumable work, designs on shared inputs and the saved training stage."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import experiments as X
from tidemark.operators import learn as L


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))
    rng = np.random.default_rng(3)
    rows = [(i, i // 3, float(x), int(x + rng.normal() > 0.5), ("train", "val", "test")[i % 3]) for i, x in enumerate(rng.normal(size=300))]
    return spark.createDataFrame(rows, "k long, g long, x double, y int, role string").persist()


def test_finished_work_is_not_done_again(spark, tmp_path):
    calls = []
    work = {k: (lambda k=k: calls.append(k) or [(k, len(k))]) for k in ("a", "bb")}
    store = str(tmp_path / "work")
    run = lambda w: sorted(map(tuple, X.run_work(spark, store, "name string, n int", w).collect()))
    assert run(work) == [("a", 1), ("bb", 2)] and sorted(calls) == ["a", "bb"]
    assert run({**work, "ccc": lambda: [("ccc", 3), ("more", 4)]}) == [("a", 1), ("bb", 2), ("ccc", 3), ("more", 4)] and len(calls) == 2
    assert run({"a": work["a"]}) == [("a", 1)] and len(calls) == 2


def test_designs_share_prepared_rows(spark, data, tmp_path):
    made = []
    designs = [(name, seed, lambda name=name: made.append(name) or data.select("role", "y", "x")) for name, seed in (("one", 0), ("two", 5))]
    learners = {"logistic": L.fit_logistic, "forest": lambda t, f, y="y", **k: L.fit_forest(t, f, y, trees=3, depth=3)}
    run = lambda content: X.run_designs(designs, learners, ["x"], str(tmp_path / "d"), content, spark)
    got = run(["v1"]).collect()
    events = {r.role: (r.n, r.p) for r in data.groupBy("role").agg(F.count("*").alias("n"), F.sum("y").alias("p")).collect()}
    assert sorted(made) == ["one", "two"] and len(got) == 2 * 2 * 2
    assert all((r.n_train, r.train_events) == events["train"] and (r.n_rows, r.n_events) == events[r.role] and 0.5 < r.roc_auc <= 1 for r in got)
    run(["v1"]).collect()
    assert len(made) == 2  # nothing is prepared where nothing is missing
    run(["v2"]).collect()
    assert len(made) == 4
    one = {r.model: r for r in X.seed_summary(spark.createDataFrame([("b", "m", 0.5, 0.6, 10, 2), ("b", "m", 0.7, 0.6, 10, 2), ("a", "m", 0.4, 0.6, 10, 2)], "design string, model string, pr_auc double, roc_auc double, n_train long, train_events long"), "a").where("design = 'b'").collect()}["m"]
    assert one.pr_auc == pytest.approx(0.6) and one.pr_auc_sd == pytest.approx(0.02**0.5) and one.change == pytest.approx(0.2) and one.n_seeds == 2


def test_a_designs_rows_are_made_once(spark, data, tmp_path):
    """what bounds and fills the inputs, counts the rows and fits the learners reads staged rows."""
    made = spark.sparkContext.accumulator(0)
    seen = F.udf(lambda x: made.add(1) or x, "double").asNondeterministic()
    designs = [(name, 0, lambda: data.select("role", "y", seen("x").alias("x"))) for name in ("one", "two")]
    learners = {"logistic": L.fit_logistic, "forest": lambda t, f, y="y", **k: L.fit_forest(t, f, y, trees=2, depth=2)}
    out = X.run_designs(designs, learners, ["x"], str(tmp_path / "once"), ["v"], spark)
    assert out.count() == 2 * 2 * 2 and made.value == 2 * 300


def test_evaluation_asks_the_model_once(spark, data):
    """F1-F4, F8, F9: no condition on the curve's cells is pushed below the model; before, a row's score was worked out again for each of its terms."""
    model = L.fit_forest(data, ["x"], trees=2, depth=2)
    part = lambda r: L.score(model, data.where(F.col("role") == r), ["x"], "m")
    out = L.evaluate(part("val"), part("test"))
    assert "UDF" not in out._jdf.queryExecution().toString() and out.first().n_obs == 100


def test_few_rows_are_fitted_side_by_side(spark, data):
    assert [L.abreast(spark.range(n)) for n in (0, 300, 600_000, 5_000_000)] == [12, 12, 6, 4]


def test_seed_pivot(spark):
    df = spark.createDataFrame([("m", "d", 2, 0.4), ("m", "d", 1, 0.2), ("m", "e", 1, 0.9)], "model string, design string, seed int, pr_auc double")
    got = {r.design: (r["mean"], r.sd, r.by_seed) for r in X.seed_pivot(df).collect()}
    assert got["d"] == (pytest.approx(0.3), pytest.approx(0.02**0.5), [0.2, 0.4]) and got["e"][1] is None


def test_a_saved_stage_is_loaded_not_fitted(spark, data, tmp_path):
    calls = []

    def fit(df, features, y="y", c=1.0):
        calls.append(c)
        return L.fit_logistic(df, features, y, c)

    part = lambda r: data.where(F.col("role") == r)
    folds = data.withColumn("fold", F.col("g").cast("int") % 2).withColumn("role", F.when(F.col("k") % 4 == 0, "val").otherwise("train"))
    go = lambda train: X.train_stage(train, part("val"), folds, ["x"], "m", fit, [{"c": 0.01}, {"c": 1.0}], str(tmp_path / "s"))
    first = go(part("train"))
    assert len(calls) == 5 and not first.loaded and first.facts["parameters"] in ({"c": 0.01}, {"c": 1.0})
    again = go(part("train"))
    assert len(calls) == 5 and again.loaded and again.facts == first.facts
    a, b = (m.score(part("test"), ["x"], "m").orderBy("k").select("raw", "score").toPandas() for m in (first, again))
    assert a.equals(b)
    assert np.allclose(a["score"], 1 / (1 + np.exp(-(first.facts["a"] + first.facts["b"] * a["raw"]))))
    row = X.evaluate_stage(again, part("test"), ["x"], "m", "g", 40).first()
    assert row.n_obs == 100 and row.pr_auc_lower <= row.pr_auc <= row.pr_auc_upper and row.threshold == first.facts["threshold"]
    go(part("train").withColumn("y", F.when(F.col("k") == 0, 1 - F.col("y")).otherwise(F.col("y"))))
    assert len(calls) > 5  # other rows, another model


def test_the_rows_of_smote_counts_are_staged_once(spark, monkeypatch):
    """clipping and filling is done as rows are read, not written as a second copy of the table."""
    from tidemark.plans import learning as P

    rng = np.random.default_rng(8)
    rows = [(i, 1995, "train", int(i % 3 == 0), *map(float, x)) for i, x in enumerate(rng.normal(size=(90, len(P.R.FEATURES))))]
    made = spark.createDataFrame([*rows, (900, 2001, "test", 1, *[None] * len(P.R.FEATURES))], "entity long, fyear long, split string, y int, " + ", ".join(f"{c} double" for c in P.R.FEATURES))
    monkeypatch.setattr(P, "raw_frame", lambda spark, d: made)
    written, staged = [], P.staged
    monkeypatch.setattr(P, "staged", lambda df: written.append(df) or staged(df))
    got = sorted(map(tuple, P.q_smote_counts(spark, "").collect()))
    assert got == [(0, 60, 0, 60), (1, 30, 30, 60)] and len(written) == 1
