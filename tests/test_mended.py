"""Inputs that the small tables lack: missing scores, constant columns, uncoded events, empty groups, large counts."""

import datetime as dt
import math

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidemark.operators import aggregates as A
from tidemark.operators import attribution as N
from tidemark.operators import filters as FL
from tidemark.operators import guards as G
from tidemark.operators import inference as I
from tidemark.operators import learn as L
from tidemark.operators import metrics as M
from tidemark.operators import pit

SCORED = "model string, score double, y int"


def test_large_counts_do_not_overflow(spark):
    df = spark.range(6_000_000).select(F.lit("x").alias("feature"), (F.col("id") % 100).cast("double").alias("value"), (F.col("id") % 2).cast("int").alias("label"))
    row = A.group_tests(df, "feature", "value", "label").first()
    assert row.n_0 == row.n_1 == 3_000_000 and row.median_0 == 49.0 and row.rank_z < 0
    grouped = spark.createDataFrame([("m", 0.9, 3_600_000_000, 3_600_000_000), ("m", 0.1, 0, 7_400_000_000)], "model string, score double, p long, n long")
    got = M.curve(grouped, ["model"]).groupBy("model").agg(M.roc_auc().alias("auc"), M.average_precision().alias("ap")).first()
    assert got.auc == 1.0 and got.ap == 1.0


@pytest.mark.parametrize("bad", [None, float("nan")])
def test_missing_scores_raise(spark, bad):
    df = spark.createDataFrame([("m", 0.5, 1), ("m", bad, 1), ("m", 0.2, 0)], SCORED)
    with pytest.raises(PySparkException, match="missing or NaN"):
        M.curve(M.compress(df, ["model"]), ["model"]).collect()


def test_a_date_of_unknown_source_is_kept(spark):
    day = dt.date
    rows = [(1, day(2001, 1, 1), day(2001, 3, 1), None), (2, day(2001, 1, 1), day(2001, 3, 1), "fallback_90"), (3, day(2001, 1, 1), day(2001, 3, 1), "10K"), (4, day(2001, 1, 1), None, None)]
    df = spark.createDataFrame(rows, "id int, pe date, filed date, src string")
    assert sorted(r.id for r in FL.filing_lag(df, "pe", "filed", 180, "src").collect()) == [1, 3]


def test_coverage_asks_for_k_unless_told_otherwise(spark):
    df = spark.createDataFrame([(1, 2), (1, None)], "a int, b int")
    assert FL.min_coverage(df, ["a", "b", "c"], 3).count() == 0
    assert FL.min_coverage(df, ["a", "b", "c"], 3, lower_to_present=True).count() == 1


def test_constant_columns_have_no_correlation(spark):
    df = spark.createDataFrame([(1.0, 2.0, 5.0), (2.0, 4.5, 5.0), (3.0, 6.0, 5.0)], "a double, b double, c double")
    got = {(r.f1, r.f2): (r.r, r.above) for r in A.correlations(df, ["a", "b", "c"]).collect()}
    assert got[("a", "c")] == (None, 0) and got[("b", "c")] == (None, 0)
    assert got[("a", "b")][0] == pytest.approx(4 / math.sqrt(2 * (60.25 - 12.5 * 12.5 / 3)))
    assert A.spearman(df, "a", "c").first().spearman is None
    flat = A.label_histogram(df.withColumn("y", F.lit(1)), "c", "y").collect()
    assert [(r.bin, r.n, r.density) for r in flat] == [(0, 3, None)]


def test_direction_of_flat_and_short_features(spark):
    rows = [("m", "tlta", float(i), 2.0) for i in range(12)] + [("m", "nita", float(i), -float(i)) for i in range(9)] + [("m", "sigma", float(i), -float(i)) for i in range(10)]
    df = spark.createDataFrame(rows + [("m", "sigma", float("nan"), 1.0)], "model string, feature string, value double, attr double")
    got = {r.feature: (r.r, r.observed, r.verdict) for r in N.directions(df).collect()}
    assert got["tlta"] == (0.0, "+", "Ambiguous") and got["nita"] == (0.0, "+", "Inconsistent")
    assert got["sigma"][0] == pytest.approx(-1.0) and got["sigma"][1:] == ("-", "Inconsistent")
    assert {r.feature: r.corr_sign for r in N.sign_compare(df.where("feature = 'tlta'")).collect()} == {"tlta": "0"}


def test_the_first_known_code_of_the_window_is_taken(spark):
    t = lambda h: dt.datetime(2020, 1, 1) + dt.timedelta(hours=h)
    rows = spark.createDataFrame([(1, 1, t(0)), (2, 1, t(20)), (3, 2, t(0)), (4, 3, t(0))], "id int, u int, ts timestamp")
    events = spark.createDataFrame([(1, t(2), None), (1, t(5), 70), (1, t(30), 80), (2, t(3), None), (2, t(40), 90), (3, t(1), 9), (3, t(1), None)], "u int, at timestamp, code int")
    got = {r.id: (r.label, r.at, r.code) for r in pit.forward_label(rows, events, ["u"], "ts", "at", "24 HOURS", "code").collect()}
    assert got == {1: (1, t(2), 70), 2: (1, t(30), 80), 3: (1, t(3), None), 4: (1, t(1), 9)}
    one = pit.unique_forward_label(rows, events, ["u"], "ts", "at", "24 HOURS", ["id"], code="code")
    assert {r.id: (r.label, r.at, r.code) for r in one.collect()} == {1: (1, t(2), 70), 2: (1, t(30), 80), 3: (1, t(3), None), 4: (1, t(1), 9)}


def test_content_hash_tells_tables_apart(spark):
    h = lambda *rows: G.content_hash(spark.createDataFrame(list(rows), "a string, b string"), ["a", "b"]).first()
    assert h(("p|q", "r")) != h(("p", "q|r")) and h((None, "x")) != h(("?", "x")) and h((None, "x")) != h(("-", "x")) and h(("1:a", "")) != h(("", "1:a"))
    assert h(("a", "b"), ("c", None)) == h(("c", None), ("a", "b"))


def test_fits_that_do_not_exist_are_null(spark):
    rows = [("one score", 0.5, 3, 10), ("one class", 0.1, 0, 5), ("one class", 0.9, 0, 5), ("separated", 0.1, 0, 5), ("separated", 0.9, 5, 5), ("fine", 0.1, 1, 5), ("fine", 0.9, 4, 5)]
    df = spark.createDataFrame(rows, "model string, score double, p long, n long")
    got = {r.model: (r.a, r.b) for r in M.logit_map(df, F.col("score")).collect()}
    assert got["one score"] == got["one class"] == got["separated"] == (None, None)
    slope = (math.log(4) + math.log(4)) / 0.8
    assert got["fine"] == (pytest.approx(-math.log(4) - 0.1 * slope), pytest.approx(slope))


def test_empty_and_single_groups_are_null(spark):
    df = spark.createDataFrame([("a", 1.0, 0), ("a", 2.0, 0), ("a", 4.0, 0), ("b", 1.0, 0), ("b", 2.0, 0), ("b", 3.0, 1)], "feature string, value double, label int")
    got = {r.feature: r for r in A.group_tests(df, "feature", "value", "label").collect()}
    assert got["a"].t_stat is None and got["a"].rank_z is None and got["b"].t_stat is None and got["b"].rank_z is not None
    bal = {r.feature: r for r in A.balance(df, "feature", "value", "label").collect()}
    assert bal["a"].std_diff is None and bal["b"].std_diff_rank is None
    wide = spark.createDataFrame([(1, 0.9, 0.2), (0, 0.3, 0.4), (0, 0.1, 0.6)], "y int, m1 double, m2 double")
    row = I.delong(wide, ["m1", "m2"]).first()
    assert (row.auc_a, row.auc_b, row.z, row.p_value) == (1.0, 0.0, 0.0, 1.0)


def test_rank_sum_corrects_for_ties_and_continuity(spark):
    df = spark.createDataFrame([("f", v, g) for v, g in [(1.0, 0), (2.0, 0), (2.0, 0), (3.0, 1), (3.0, 1), (2.0, 1), (5.0, 1)]], "feature string, value double, label int")
    row = A.group_tests(df, "feature", "value", "label").first()
    # U = 1 of 12; ties of three twos and two threes: variance 3*4/12*(8 - (24+6)/42)
    z = (abs(1 - 6) - 0.5) / math.sqrt(8 - 30 / 42)
    assert row.rank_pvalue == pytest.approx(math.erfc(z / math.sqrt(2)), abs=1e-6)
    assert row.rank_z == pytest.approx(-5 / math.sqrt(8))


def test_search_never_takes_work_of_other_data_or_parameters(spark, tmp_path):
    rows = [(0, "train" if i % 3 else "val", float(i % 7), i % 2) for i in range(120)]
    folds = spark.createDataFrame(rows, "fold int, role string, x double, y int")
    calls = []

    def fit(df, features, y="y", reg=0.1):
        calls.append(reg)
        return L.fit_logistic(df, features, y=y)

    store = str(tmp_path / "store")
    first = L.search(folds, ["x"], [{"reg": 0.1}], fit, store).first()
    assert len(calls) == 1 and L.search(folds, ["x"], [{"reg": 0.1}], fit, store).first() == first and len(calls) == 1
    L.search(folds, ["x"], [{"reg": 0.2}], fit, store).collect()
    assert len(calls) == 2
    L.search(folds.withColumn("y", 1 - F.col("y")), ["x"], [{"reg": 0.1}], fit, store).collect()
    assert len(calls) == 3


def test_disjoint_histories_give_what_overlapping_ones_give(spark):
    day = lambda n: dt.date(2000, 1, 1) + dt.timedelta(days=n)
    hist = [(e, day(a), day(b), f"{e}{a}", a) for e in (1, 2) for a, b in ((0, 9), (10, 10), (20, 800), (900, 899))] + [(3, day(5), day(7), "x", 1)]
    rows = [(i, e, None if n is None else day(n), "own") for i, (e, n) in enumerate((e, n) for e in (1, 2, 3, 4, None) for n in (-1, 0, 5, 9, 10, 11, 20, 500, 800, 801, 899, 900, None))]
    h = spark.createDataFrame(hist, "e int, lo date, hi date, v string, i int")
    r = spark.createDataFrame(rows, "id int, e int, d date, v string")
    for how in ("left", "inner", "left_semi", "left_anti"):
        a, b = (pit.valid_at(r, h, ["e"], "d", "lo", "hi", how, disjoint=x) for x in (False, True))
        assert a.columns == b.columns
        assert sorted(map(str, a.collect())) == sorted(map(str, b.select(a.columns).collect())), how
    best = lambda x: sorted(map(str, pit.best_valid(r.drop("v"), h, ["e"], "d", "lo", "hi", ["id"], [F.col("lo")], ["v"], disjoint=x).select("id", "v").collect()))
    assert best(True) == best(False)


def test_unknown_dispositions_raise(spark):
    from tidemark.operators import linkage as K

    df = spark.createDataFrame([(1, K.DISPOSITIONS[0]), (2, K.DISPOSITIONS[2])], "id int, disposition string")
    K.require_dispositions(df)
    for bad in (K.DISPOSITIONS[3], None):
        with pytest.raises(ValueError, match="without a known disposition"):
            K.require_dispositions(df.union(spark.createDataFrame([(3, bad)], "id int, disposition string")))


def test_model_inputs_are_fitted_on_training_rows_and_never_missing(spark):
    rows = [(float(i), "train") for i in range(101)] + [(None, "train"), (None, "test"), (float("nan"), "test"), (1e9, "test"), (-5.0, "test")]
    df = spark.createDataFrame(rows, "x double, split string")
    inputs = L.fit_inputs(df.where("split = 'train'"), ["x"])
    assert inputs == {"x": (1.0, 99.0, 50.0)}
    assert [r.x for r in L.prepare(df, inputs).where("split = 'test'").collect()] == [50.0, 50.0, 99.0, 1.0]
    with pytest.raises(PySparkException, match="missing or NaN"):
        L._ready(df, ["x"]).collect()
    with pytest.raises(ValueError, match="no training value"):
        L.fit_inputs(df.where("x is null"), ["x"])


def test_oversampling_reaches_exact_parity(spark):
    df = spark.createDataFrame([(i, int(i < 7)) for i in range(60)], "k long, y int")
    n = {r.y: r["count"] for r in L.oversample(df, ["k"]).groupBy("y").count().collect()}
    assert n == {0: 53, 1: 53}
    per = [r["count"] for r in L.oversample(df, ["k"]).where("y = 1").groupBy("k").count().collect()]
    assert sorted(per) == [7, 7, 7, 8, 8, 8, 8]
    assert L.oversample(df.where("y = 0"), ["k"]).count() == 53


def test_network_rows_are_made_once_in_even_parts(spark, monkeypatch):
    df = spark.range(300).selectExpr("id AS k", "sin(id) AS x", "cos(id * 3) AS z", "int(id % 3 = 0) AS y")
    held, whole, seen = L.dealt(df, 100), L.oversample, spark.sparkContext.accumulator(0)
    assert [*map(len, held.rdd.glom().collect())] == [pytest.approx(100, abs=5)] * 3 and L.dealt(df).rdd.getNumPartitions() == 1

    def made(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    monkeypatch.setattr(L, "oversample", lambda *a: whole(*a).select("x", "z", "y").mapInArrow(made, "x double, z double, y int"))
    L.fit_network(df, ["x", "z"], ["k"], max_iter=2)
    assert seen.value == 400


@pytest.mark.parametrize("how", ["left", "left_semi"])
@pytest.mark.parametrize("disjoint", [False, True])
def test_histories_are_never_sent_whole(spark, how, disjoint):
    """However small the planner takes them for: intervals are cut into segments that it does not count."""
    day = dt.date
    rows = spark.createDataFrame([(1, day(2001, 2, 1)), (2, day(2001, 2, 1))], "id long, at date")
    known = spark.createDataFrame([(1, day(2001, 1, 1), day(2001, 3, 1), "a")], "id long, lo date, hi date, v string")
    got = pit.valid_at(rows, known, ["id"], "at", "lo", "hi", how, disjoint)
    assert sorted(r.id for r in got.collect()) == ([1, 2] if how == "left" else [1])
    best = pit.best_valid(rows, known, ["id"], "at", "lo", "hi", ["id"], [F.col("lo")], ["v"], disjoint=disjoint)
    assert {r.id: r.v for r in best.collect()} == {1: "a", 2: None}
    for df in (got, best):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_draws_are_the_digests_of_their_names():
    from hashlib import md5

    heads, tails = [b"42|%d|" % i for i in (0, 9, 10, 999)] + [b"x" * 50 + b"|"], [b"%d" % i for i in (0, 7, 99, 100, 12345)]
    want = [[int.from_bytes(md5(a + b).digest()[:8], "big") for b in tails] for a in heads]
    assert I.md5_starts(heads, tails).tolist() == want


@pytest.mark.parametrize("reps", [2, 40])
def test_tied_scores_of_a_crossed_design_are_added_up_first(spark, reps, monkeypatch):
    """No block's multiplicities are brought to a cell of scores; the draws are those of the plain table, undrawn blocks included."""
    rows = [(m, e, t, (e * 7 + t + k) % 3 // 2, (e + 2 * t + k) % 4 / 4) for k, m in enumerate("ab") for e in range(30) for t in range(4)]
    df = spark.createDataFrame(rows, "model string, e long, t long, y int, score double")
    made = []
    spans = I.weighted_sums
    monkeypatch.setattr(I, "weighted_sums", lambda *x: made.append(x[-1]) or spans(*x))
    got = {(r.rep, r.model): (r.ap, r.auc) for r in I.resample(df, ["e", "t"], reps).collect()}
    assert len(made) == 1 and made[0] is not None
    w = [{(r.rep, r[1]): r.w for r in I.multiplicities(df, c, reps, s).collect()} for c, s in (("e", "42"), ("t", "42t"))]
    want = {}
    for rep in range(reps):
        for m in "ab":
            held = [(s, y, w[0].get((rep, e), 0) * w[1].get((rep, t), 0)) for k, e, t, y, s in rows if k == m]
            pos, neg = sum(n for _, y, n in held if y), sum(n for _, y, n in held if not y)
            if not pos:
                continue
            ap = auc = tp = m_ = 0
            for s in sorted({s for s, _, _ in held}, reverse=True):
                p, n = sum(n for z, y, n in held if z == s and y), sum(n for z, _, n in held if z == s)
                tp, m_ = tp + p, m_ + n
                ap += p * tp / m_ / pos if m_ else 0
                auc += p * (neg - (m_ - tp) + (n - p) / 2) / (pos * neg) if neg else 0
            want[rep, m] = (pytest.approx(ap), pytest.approx(auc) if neg else None)
    assert got == want
