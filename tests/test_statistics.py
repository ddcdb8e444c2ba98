"""Rank, metric, resampling and neighbour operators against dense NumPy computations."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions.expr import unit_hash
from tidemark.operators import attribution as N
from tidemark.operators import inference as I
from tidemark.operators import metrics as M
from tidemark.operators import neighbours as K
from tidemark.operators import ranks as RK
from tidemark.operators.aggregates import additive_gap

RNG = np.random.default_rng(7)


def scored(spark, n=400, ties=40):
    y = (RNG.random(n) < 0.2).astype(int)
    s = np.round((RNG.random(n) + 0.4 * y) / 1.5 * ties) / ties
    pdf = [("m", int(i // 5), int(i), int(a), float(b)) for i, (a, b) in enumerate(zip(y, s))]
    return spark.createDataFrame(pdf, "model string, e long, i long, y int, score double"), y, s


def np_ap(y, s):
    ap = prev = 0.0
    for t in np.unique(s)[::-1]:
        f = s >= t
        tp = y[f].sum()
        ap += (tp / y.sum() - prev) * tp / f.sum()
        prev = tp / y.sum()
    return ap


def np_auc(y, s):
    a, b = s[y == 1], s[y == 0]
    return ((a[:, None] > b[None, :]) + 0.5 * (a[:, None] == b[None, :])).mean()


def test_cell_is_monotone(spark):
    x = np.unique(np.concatenate([-np.logspace(-300, 300, 1500), [0.0], np.logspace(-300, 300, 1500), 2.0 ** np.arange(-60, 60), np.nextafter(2.0 ** np.arange(-60, 60), 0), np.nextafter(2.0 ** np.arange(-60, 60), 1e308)]))
    c = [r[0] for r in spark.createDataFrame([(float(v),) for v in x], "x double").coalesce(1).select(RK.cell("x")).collect()]
    assert all(a <= b for a, b in zip(c, c[1:]))


def test_percentiles_and_grid(spark):
    x = np.concatenate([RNG.standard_cauchy(777) * 10, np.repeat(3.25, 50), [1e12, -1e12]])
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    got = {r.prob: r.value for r in RK.percentiles(df, [], "x", [0.0, 0.01, 1 / 3, 0.5, 0.99, 1.0]).collect()}
    for p, v in got.items():
        assert v == pytest.approx(np.quantile(x, p), rel=1e-12, abs=1e-12)
    for data, m in ((x, 20), (x[:3], 20), (x[:1], 4)):
        d = spark.createDataFrame([(float(v),) for v in data], "x double")
        grid = {r.j: r.value for r in RK.quantile_grid(d, [], "x", m).collect()}
        assert [grid[j] for j in range(m + 1)] == pytest.approx(list(np.quantile(data, np.linspace(0, 1, m + 1))))


def test_row_number_and_index(spark):
    df = spark.createDataFrame([(float(i % 7) - 3, i) for i in range(200)], "x double, t long")
    want = {t: k + 1 for k, (x, t) in enumerate(sorted((float(i % 7) - 3, i) for i in range(200)))}
    assert {r.t: r.rn for r in RK.row_number(df, [], "x", "t").collect()} == want
    assert sorted(r.idx for r in RK.dense_index(df, "t").collect()) == list(range(200))


def test_metrics_match_numpy(spark):
    df, y, s = scored(spark)
    c = M.curve(M.compress(df, ["model"]), ["model"])
    r = c.groupBy("model").agg(M.average_precision().alias("ap"), M.roc_auc().alias("auc"), M.brier().alias("b"), M.ks_statistic().alias("ks")).first()
    assert r.ap == pytest.approx(np_ap(y, s)) and r.auc == pytest.approx(np_auc(y, s)) and r.b == pytest.approx(((s - y) ** 2).mean())
    ks = max((y[s >= t].sum() / y.sum()) - ((1 - y)[s >= t].sum() / (1 - y).sum()) for t in np.unique(s))
    assert r.ks == pytest.approx(ks)
    best, at = -1.0, None
    for t in np.unique(np.concatenate([[0.0, 1.0], s])):
        f = s >= t
        tp = y[f].sum()
        v = 2 * tp / (y.sum() + f.sum()) if f.sum() + y.sum() else 0
        if v > best:
            best, at = v, t
    assert M.thresholds(c, ["model"]).first()["threshold"] == at


def test_top_k_counts_exact_rows(spark):
    df, y, s = scored(spark, ties=10)
    got = {round(r.capacity, 2): (r.k, r.tp) for r in M.top_k_table(df, [0.01, 0.05, 0.10], "i").collect()}
    order = np.lexsort((np.arange(len(y)), -s))
    for c, (k, tp) in got.items():
        assert k == max(1, round(c * len(y))) and tp == y[order[:k]].sum()


def test_delong_against_pairwise(spark):
    n = 300
    y = (RNG.random(n) < 0.3).astype(int)
    a, b = np.round(RNG.random(n) + 0.3 * y, 1), np.round(RNG.random(n) + 0.1 * y, 1)
    df = spark.createDataFrame([(int(t), float(u), float(v), float(u)) for t, u, v in zip(y, a, b)], "y int, a double, b double, c double")
    out = {(r.a, r.b): r for r in I.delong(df, ["a", "b", "c"]).collect()}

    def place(s):
        p, q = s[y == 1], s[y == 0]
        w = (p[:, None] > q[None, :]) + 0.5 * (p[:, None] == q[None, :])
        return w.mean(1), w.mean(0)

    (a10, a01), (b10, b01) = place(a), place(b)
    var = np.var(a10 - b10, ddof=1) / y.sum() + np.var(a01 - b01, ddof=1) / (1 - y).sum()
    z = (a10.mean() - b10.mean()) / math.sqrt(var)
    assert out["a", "b"].z == pytest.approx(z) and out["a", "b"].p_value == pytest.approx(math.erfc(abs(z) / math.sqrt(2)), abs=2e-7)
    assert out["a", "c"].p_value == 1.0 and out["a", "c"].z == 0.0


def test_holm(spark):
    df = spark.createDataFrame([("x", 0.03), ("y", 0.01), ("z", 0.02)], "h string, p double")
    got = {r.h: r.p_holm for r in I.holm(df, "p").collect()}
    assert got == pytest.approx({"y": 0.03, "z": 0.04, "x": 0.04})


def test_romano_wolf_by_hand(spark):
    obs, boot = np.array([0.5, 0.1, 0.3]), RNG.normal([0.5, 0.1, 0.3], [0.2, 0.2, 0.3], (200, 3))
    b = spark.createDataFrame([(r, f"h{j}", float(boot[r, j])) for r in range(200) for j in range(3)], "rep int, h string, diff double")
    t = spark.createDataFrame([(f"h{j}", float(v)) for j, v in enumerate(obs)], "h string, delta double")
    got = {r.h: r.p_adjusted for r in I.romano_wolf(b, t, ["h"]).collect()}
    se = boot.std(0, ddof=1)
    ts, c = abs(obs) / se, abs(boot - obs) / se
    last = 0.0
    order = np.argsort(-ts)
    for k, j in enumerate(order):
        last = max(last, (c[:, order[k:]].max(1) >= ts[j]).mean())
        assert got[f"h{j}"] == pytest.approx(last)


def test_block_bootstrap_weights(spark):
    df, y, s = scored(spark, n=100)
    w = I.multiplicities(df, "e", 5, 42).persist()
    assert [r[1] for r in w.groupBy("rep").agg(F.sum("w")).collect()] == [20] * 5
    mult = {(r.rep, r.e): r.w for r in w.collect()}
    draws = {r.rep: r.ap for r in I.resample(df, ["e"], 5, 42).collect()}
    for rep, ap in draws.items():
        idx = np.repeat(np.arange(100), [mult.get((rep, i // 5), 0) for i in range(100)])
        assert ap == pytest.approx(np_ap(y[idx], s[idx]))
    again = {r.rep: r.ap for r in I.resample(df.repartition(3), ["e"], 5, 42).collect()}
    assert again == pytest.approx(draws)


@pytest.mark.parametrize("rows", [8, 1 << 20])
def test_cells_and_ties_do_not_change_draws(spark, monkeypatch, rows):
    """Many small cells, or one; scores that tie in more rows than a cell holds; two models over the same blocks; a crossed design."""
    monkeypatch.setattr(I, "CELL_ROWS", rows)
    n = 240
    y, e, f = RNG.integers(0, 2, n), np.arange(n) // 4, np.arange(n) % 5
    s = {"tied": np.round(RNG.normal(size=n)), "fine": RNG.normal(size=n), "flat": np.zeros(n)}
    data = [(m, int(e[i]), int(f[i]), int(y[i]), float(s[m][i])) for m in s for i in range(n)]
    df = spark.createDataFrame(data, "model string, e long, f long, y int, score double").repartition(5)
    for blocks in (["e"], ["e", "f"]):
        w = {b: {(r.rep, r[b]): r.w for r in I.multiplicities(df, b, 6, "7" + (b if i else "")).collect()} for i, b in enumerate(blocks)}
        got = {(r.model, r.rep): (r.ap, r.auc) for r in I.resample(df, blocks, 6, 7).collect()}
        for rep in range(6):
            times = np.prod([[w[b].get((rep, int(v)), 0) for v in {"e": e, "f": f}[b]] for b in blocks], axis=0)
            idx = np.repeat(np.arange(n), times)
            for m in s:
                ap, auc = got[m, rep]
                pos, neg = s[m][idx][y[idx] == 1], s[m][idx][y[idx] == 0]
                assert ap == pytest.approx(np_ap(y[idx], s[m][idx]), abs=1e-12)
                assert auc == pytest.approx(((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg)), abs=1e-12)


def test_multiplicity_matrix_equals_multiplicities(spark, monkeypatch):
    df = spark.createDataFrame([(i * 7 - 20,) for i in range(90)] * 2, "b long")
    want = {(r.rep, r.b): r.w for r in I.multiplicities(df, "b", 30, 5).collect()}
    for tile in (1, 300, 1 << 20):
        monkeypatch.setattr(I, "TILE", tile)
        got = {r.b: np.frombuffer(r.w, np.uint8) for r in I.multiplicity_matrix(df, "b", 30, 5).collect()}
        assert len(got) == 90 and all(w[rep] == want.get((rep, b), 0) for b, w in got.items() for rep in range(30))


def test_weighted_sums(spark):
    rows = [(i % 11, f"k{i % 3}", float(i), i) for i in range(400)]
    df = spark.createDataFrame(rows, "b long, k string, v double, u long").repartition(6)
    m = I.multiplicity_matrix(df, "b", 9, 3)
    w = {r.b: np.frombuffer(r.w, np.uint8).astype(float) for r in m.collect()}
    got = {r.k: (np.frombuffer(r.v), np.frombuffer(r.u)) for r in I.weighted_sums(df, ["k"], ["v", "u"], "b", m).collect()}
    for k in ("k0", "k1", "k2"):
        assert np.allclose(got[k][0], sum(v * w[b] for b, kk, v, _ in rows if kk == k)) and np.allclose(got[k][1], sum(u * w[b] for b, kk, _, u in rows if kk == k))


def test_identical_models_have_zero_delta(spark):
    df, _, _ = scored(spark, n=200)
    two = df.unionByName(df.withColumn("model", F.lit("n")))
    r = I.paired_test(I.resample(two, ["e"], 20), I.observed(two), "auc", [("m", "n")]).first()
    assert r.delta == 0 and r.lower == 0 and r.upper == 0 and r.p_recentred == 1.0


def test_spline_gain_dense(spark):
    n = 600
    x, e = RNG.normal(size=n), np.arange(n) // 4
    s = 0.5 * x + 0.4 * x**2 + RNG.normal(size=n) * 0.3
    df = spark.createDataFrame([(float(a), float(b), int(c)) for a, b, c in zip(x, s, e)], "x double, s double, e long")
    r = I.spline_gain(df, "x", "s", "e", reps=59).first()
    k = np.quantile(x, I.KNOT_PROBS)
    d = lambda i: (np.clip(x - k[i], 0, None) ** 3 - np.clip(x - k[4], 0, None) ** 3) / (k[4] - k[i])
    B = np.column_stack([np.ones(n), x, *[d(i) - d(3) for i in range(3)]])
    r2 = lambda m: 1 - ((s - m @ np.linalg.lstsq(m, s, rcond=None)[0]) ** 2).sum() / ((s - s.mean()) ** 2).sum()
    assert r.linear_r2 == pytest.approx(r2(B[:, :2])) and r.spline_r2 == pytest.approx(r2(B), rel=1e-6)
    assert r.p_value == pytest.approx(1 / 60) and r.n_reps == 59
    assert I.out_of_fold_gain(df, "x", "s", "e") > 0.1
    line = df.withColumn("s", F.col("x") * 0.5 + F.col("s") * 0 + F.sin(F.col("e") * 12.9) * 0.3)
    assert I.spline_gain(line, "x", "s", "e", reps=59).first().p_value > 0.05


def test_signed_sums_follow_the_hash(spark):
    rows = [(f"é{i}" if i % 3 else None if i == 0 else str(i), float(i), float(i * i)) for i in range(300)]
    df = spark.createDataFrame(rows, "e string, a double, b double")
    sign = (unit_hash(7, "rep", "e") % 2) * 2 - 1
    want = df.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(12)))).groupBy("rep").agg(*[F.sum(sign * F.col(c)).alias(c) for c in ("a", "b")])
    got = I.signed_sums(df, "e", ["a", "b"], 13, 7)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("run", [lambda df: I.spline_gain(df, "x", "s", "e", reps=3).first(), lambda df: I.out_of_fold_gain(df, "x", "s", "e"), lambda df: I.segmented(df, "x", "s", [0.25, 0.5, 0.75]).first()])
def test_curve_rows_are_made_once(spark, run):
    seen = spark.sparkContext.accumulator(0)

    def made(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    df = spark.range(400).selectExpr("id div 4 AS e", "sin(id) AS x", "cos(id) AS s")
    run(df.mapInArrow(made, "e long, x double, s double"))
    assert seen.value == 400


def test_segmented_finds_break(spark):
    x = RNG.uniform(-1, 1, 800)
    s = 0.2 * x + 1.5 * np.clip(x - 0.25, 0, None) + RNG.normal(size=800) * 0.01
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, s)], "x double, s double")
    r = I.segmented(df, "x", "s", [0.15 + 0.7 * i / 28 for i in range(29)]).first()
    assert abs(r.breakpoint - 0.25) < 0.06 and r.slope_low == pytest.approx(0.2, abs=0.05) and r.slope_high == pytest.approx(1.7, abs=0.1)


def test_additive_gap(spark):
    t = spark.createDataFrame([(i, j, float(i + 2 * j)) for i in range(3) for j in range(3)], "a int, b int, v double")
    assert max(abs(r.contrast) for r in additive_gap(t, "a", "b", "v").collect()) < 1e-12
    up = t.withColumn("v", F.col("v") + F.when((F.col("a") == 2) & (F.col("b") == 2), 3.0).otherwise(0.0))
    assert additive_gap(up, "a", "b", "v").where("a = 2 AND b = 2").first().contrast > 1


def test_nearest_is_exact_with_many_chunks(spark):
    pts = np.concatenate([RNG.normal(size=(300, 3)), np.repeat(RNG.normal(size=(1, 3)), 120, axis=0) + RNG.normal(size=(120, 3)) * 1e-3])
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(pts)], "k long, a double, b double, c double")
    got = {}
    for r in K.nearest(df, "k", ["a", "b", "c"], 5, chunk_rows=40).collect():
        got.setdefault(r.key, []).append(r.distance)
    full = np.sqrt(((pts[:, None] - pts[None]) ** 2).sum(2))
    np.fill_diagonal(full, np.inf)
    for i in range(len(pts)):
        assert sorted(got[i]) == pytest.approx(sorted(full[i])[:5])


@pytest.mark.parametrize("leaf,piece,lane", [(1000, 4000, 20_000), (20, 7, 30), (1, 4000, 20_000)])
def test_nearest_over_a_split_tree(spark, monkeypatch, leaf, piece, lane):
    """Small leaves, leaves cut into pieces, groups cut into lanes; clusters, equal points and a constant dimension."""
    monkeypatch.setattr(K, "PIECE_ROWS", piece)
    monkeypatch.setattr(K, "VISITS_PER_GROUP", lane)
    pts = np.concatenate([RNG.normal(size=(150, 4)), np.repeat(RNG.normal(size=(1, 4)), 40, axis=0), RNG.normal(size=(60, 4)) * 1e-3 + 5])
    pts[:, 3] = 2.0
    df = spark.createDataFrame([(3 * i - 7, *map(float, p)) for i, p in enumerate(pts)], "k long, a double, b double, c double, d double").repartition(5)
    got = {}
    for r in K.nearest(df, "k", ["a", "b", "c", "d"], 5, chunk_rows=leaf).orderBy("key", "rank").collect():
        got.setdefault(r.key, []).append((r.neighbour, r.distance))
    full = np.sqrt(((pts[:, None] - pts[None]) ** 2).sum(2))
    np.fill_diagonal(full, np.inf)
    for i in range(len(pts)):
        want = sorted(zip(full[i], range(len(pts))))[:5]
        assert [d for _, d in got[3 * i - 7]] == pytest.approx([d for d, _ in want], abs=1e-15)
        ties = [d for d, _ in sorted(zip(full[i], range(len(pts))))[4:6]]
        if abs(ties[0] - ties[1]) > 1e-12 and len({round(d, 12) for d, _ in want}) == 5:
            assert [k for k, _ in got[3 * i - 7]] == [3 * j - 7 for _, j in want]


def test_nearest_of_few_rows(spark):
    df = spark.createDataFrame([(1, 0.0), (2, 3.0), (3, 1.0)], "k long, a double")
    got = sorted((r.key, r.rank, r.neighbour, r.distance) for r in K.nearest(df, "k", ["a"], 5).collect())
    assert got == [(1, 1, 3, 1.0), (1, 2, 2, 3.0), (2, 1, 3, 2.0), (2, 2, 1, 3.0), (3, 1, 1, 1.0), (3, 2, 2, 2.0)]
    assert K.nearest(df.where("k > 9"), "k", ["a"], 5).count() == 0


def test_closest_points_hold_few_distances_at_a_time():
    import tracemalloc

    rng = np.random.default_rng(5)
    points, ids = np.round(rng.normal(size=(4000, 6)), 1), rng.permutation(4000)
    tracemalloc.start()
    found = [np.concatenate(x) for x in zip(*K._closest(points, ids, points[:300], ids[:300], 5))]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 << 20  # all distances of the 300 with their six parts: 58 MB and as much again for the squares
    for i in range(0, 300, 37):
        far = np.sqrt(((points[i] - points) ** 2).sum(axis=1))
        far[i] = np.inf
        best = np.lexsort((ids, far))[:5]
        assert found[0][i] == ids[i] and found[2][i].tolist() == ids[best].tolist() and found[1][i].tolist() == far[best].tolist()


def test_declared_binaries_are_checked(spark):
    df = spark.createDataFrame([(i, int(i < 5), float(i), 0.5 if i == 7 else 1.0) for i in range(20)], "k long, y int, a double, b double")
    with pytest.raises(ValueError, match="b"):
        K.synthetic_minority(df, "k", "y", ["a", "b"], ["b"])


def test_synthetic_rows_reach_parity(spark):
    data = [(i, int(i < 12), float(RNG.normal()), float(i % 2)) for i in range(60)]
    df = spark.createDataFrame(data, "k long, y int, a double, b double")
    out = K.synthetic_minority(df, "k", "y", ["a", "b"], ["b"]).collect()
    assert len(out) == 36 and {r.b for r in out} <= {0.0, 1.0}
    lo, hi = min(d[2] for d in data[:12]), max(d[2] for d in data[:12])
    assert all(lo - 1e-9 <= r.a <= hi + 1e-9 for r in out)


def test_kendall(spark):
    df = spark.createDataFrame([("a", 3.0, 3.0), ("b", 2.0, 1.0), ("c", 1.0, 2.0)], "feature string, x double, y double")
    assert N.kendall(df, "x", "y").first().tau_b == pytest.approx(1 / 3)
    assert N.kendall(df, "x", "x").first().weighted_tau == pytest.approx(1.0)
