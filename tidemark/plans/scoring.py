"""Metric queries on the long scored table."""

from pyspark.sql import functions as F

from tidemark.functions import expr as E
from tidemark.operators import metrics as M
from tidemark.operators import splits as S
from tidemark.functions.expr import hash_sql
from tidemark.plans import roles as R
from tidemark.plans.registry import Book
from tidemark.plans.rows import LOGIT_SQL, ZSQL, zscore

BOOK = Book()
SC = "WITH " + R.SCORED_SQL


def r(c, n=8):
    return F.round(c, n)


def curve_sql(src, keys="model", name="c", where=""):
    """CTEs g_<name> and <name>: score groups and cumulative counts."""
    part = f"PARTITION BY {keys}"
    return f""", g_{name} AS (SELECT {keys}, score, CAST(sum(y) AS BIGINT) AS p, count(*) AS n FROM {src} {where} GROUP BY ALL),
{name} AS (SELECT *, CAST(sum(p) OVER ({part} ORDER BY score DESC) AS BIGINT) AS tp, CAST(sum(n) OVER ({part} ORDER BY score DESC) AS BIGINT) AS m,
 CAST(sum(p) OVER ({part}) AS BIGINT) AS pos, CAST(sum(n-p) OVER ({part}) AS BIGINT) AS neg FROM g_{name})"""


AP = "sum(p*tp/m::DOUBLE)/nullif(max(pos),0)"
AUC = "sum(p*(neg-(m-tp)+(n-p)/2.0::DOUBLE))/nullif(max(pos)*max(neg),0)"
KS = "greatest(max(tp/nullif(pos,0)::DOUBLE-(m-tp)/nullif(neg,0)::DOUBLE),0)"
BRIER = "sum(p*(1-score)*(1-score)+(n-p)*score*score)/sum(n)"
TEST = curve_sql("scored", where="WHERE split='test'")
VAL = curve_sql("scored", name="v", where="WHERE split='val'")
THR = """, thr AS (SELECT model, score AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY f1 DESC, score) AS rn FROM (
 SELECT model, score, 2.0::DOUBLE*tp/(pos+m) AS f1 FROM v UNION ALL SELECT model, 0.0::DOUBLE, 2.0::DOUBLE*max(pos)/(max(pos)+max(pos)+max(neg)) FROM v GROUP BY 1)) WHERE rn=1)"""


def test_curve(spark, d):
    return M.curve(M.compress(R.scored(spark, d, "test"), ["model"]), ["model"])


def val_curve(spark, d):
    return M.curve(M.compress(R.scored(spark, d, "val"), ["model"]), ["model"])


@BOOK.query(SC + TEST + f" SELECT model, round({AP},8) AS pr_auc FROM c GROUP BY 1")
def q_average_precision(spark, d):
    return test_curve(spark, d).groupBy("model").agg(r(M.average_precision()).alias("pr_auc"))


@BOOK.query(SC + TEST + f" SELECT model, round({AUC},8) AS roc_auc FROM c GROUP BY 1")
def q_roc_auc(spark, d):
    return test_curve(spark, d).groupBy("model").agg(r(M.roc_auc()).alias("roc_auc"))


@BOOK.query(SC + TEST + f" SELECT model, round({KS},8) AS ks_stat FROM c GROUP BY 1")
def q_ks(spark, d):
    return test_curve(spark, d).groupBy("model").agg(r(M.ks_statistic()).alias("ks_stat"))


@BOOK.query(SC + " SELECT model, round(avg((score-y)*(score-y)),8) AS brier_score FROM scored WHERE split='test' GROUP BY 1")
def q_brier(spark, d):
    return M.compress(R.scored(spark, d, "test"), ["model"]).groupBy("model").agg(r(M.brier()).alias("brier_score"))


@BOOK.query(SC + VAL + THR + """ SELECT t.model, threshold, round(max(CASE WHEN v.score>=threshold THEN 2.0::DOUBLE*tp/(pos+m) END),8) AS best_f1 FROM thr t JOIN v USING (model) GROUP BY 1,2""")
def q_threshold_f1(spark, d):
    return M.thresholds(val_curve(spark, d), ["model"]).withColumn("best_f1", r("best_f1"))


MT = f""" SELECT model, max(pos) AS n_events, CAST(sum(n) AS BIGINT) AS n_obs, round(max(pos)/sum(n)::DOUBLE,8) AS prevalence, round({AP},8) AS pr_auc, round({AUC},8) AS roc_auc, round({KS},8) AS ks_stat,
 round({BRIER},8) AS brier_score, max(threshold) AS threshold, round(coalesce(sum(CASE WHEN score>=threshold THEN p END)/nullif(sum(CASE WHEN score>=threshold THEN n END),0)::DOUBLE,0),8) AS precision,
 round(coalesce(sum(CASE WHEN score>=threshold THEN p END)/nullif(max(pos),0)::DOUBLE,0),8) AS recall,
 round(2.0::DOUBLE*coalesce(sum(CASE WHEN score>=threshold THEN p END),0)/(max(pos)+coalesce(sum(CASE WHEN score>=threshold THEN n END),0)),8) AS f1 FROM c JOIN thr USING (model) GROUP BY model"""
ROUNDED = ["prevalence", "pr_auc", "roc_auc", "ks_stat", "brier_score", "precision", "recall", "f1"]


def metrics(spark, d):
    out = M.metric_table(test_curve(spark, d), ["model"], M.thresholds(val_curve(spark, d), ["model"]), ["model"])
    return out.withColumns({c: r(c) for c in ROUNDED})


@BOOK.query(SC + TEST + VAL + THR + MT)
def q_metric_table(spark, d):
    return metrics(spark, d)


@BOOK.query(SC + TEST + VAL + THR + ", mt AS (" + MT + """) SELECT model, pr_auc, roc_auc FROM mt
 UNION ALL SELECT 'no skill', round(max(pos)/(max(pos)+max(neg))::DOUBLE,8), 0.5::DOUBLE FROM c""")
def q_metric_baseline(spark, d):
    m = metrics(spark, d).select("model", "pr_auc", "roc_auc", "prevalence")
    base = m.agg(F.lit("no skill").alias("model"), F.max("prevalence").alias("pr_auc"), F.lit(0.5).alias("roc_auc"))
    return m.drop("prevalence").unionByName(base)


WT = """, w AS (SELECT *, 1.0::DOUBLE/count(*) OVER (PARTITION BY model, entity) AS w FROM scored WHERE split='test'),
gw AS (SELECT model, score, sum(y*w) AS p, sum(w) AS n FROM w GROUP BY 1,2),
cw AS (SELECT *, sum(p) OVER (PARTITION BY model ORDER BY score DESC) AS tp, sum(n) OVER (PARTITION BY model ORDER BY score DESC) AS m, sum(p) OVER (PARTITION BY model) AS pos, sum(n-p) OVER (PARTITION BY model) AS neg FROM gw)"""


@BOOK.query(SC + TEST + WT + f""", a AS (SELECT model, {AP} AS ap, {AUC} AS auc FROM c GROUP BY 1), b AS (SELECT model, {AP} AS wap, {AUC} AS wauc FROM cw GROUP BY 1)
SELECT model, round(ap,8) AS pr_auc, round(auc,8) AS roc_auc, round(wap,8) AS pr_auc_entity, round(wauc,8) AS roc_auc_entity, rank() OVER (ORDER BY ap DESC) AS rank_rows, rank() OVER (ORDER BY wap DESC) AS rank_entities FROM a JOIN b USING (model)""")
def q_weighted_auc(spark, d):
    from pyspark.sql import Window

    s = R.scored(spark, d, "test")
    w = s.withColumn("w", 1.0 / F.count("*").over(Window.partitionBy("model", "entity")))  # an entity's periods
    plain = test_curve(spark, d).groupBy("model").agg(M.average_precision().alias("ap"), M.roc_auc().alias("auc"))
    by_entity = M.curve(M.compress(w, ["model"], "w"), ["model"]).groupBy("model").agg(
        M.average_precision().alias("wap"), M.roc_auc().alias("wauc")
    )
    rk = lambda c: F.rank().over(Window.orderBy(F.col(c).desc()))  # noqa: E731  one row per model
    return plain.join(by_entity, "model").select(
        "model", r("ap").alias("pr_auc"), r("auc").alias("roc_auc"), r("wap").alias("pr_auc_entity"), r("wauc").alias("roc_auc_entity"),
        rk("ap").alias("rank_rows"), rk("wap").alias("rank_entities"),
    )


@BOOK.query(SC + """, caps(capacity) AS (VALUES (0.01::DOUBLE),(0.05::DOUBLE),(0.10::DOUBLE)), thr AS (SELECT model, 0.01::DOUBLE AS capacity, quantile_cont(score,0.99) AS threshold FROM scored WHERE split='val' GROUP BY 1
 UNION ALL SELECT model, 0.05::DOUBLE, quantile_cont(score,0.95) FROM scored WHERE split='val' GROUP BY 1 UNION ALL SELECT model, 0.10::DOUBLE, quantile_cont(score,0.90) FROM scored WHERE split='val' GROUP BY 1),
x AS (SELECT t.model, capacity, max(threshold) AS threshold, count(*) FILTER (score>=threshold) AS nr, CAST(sum(y) FILTER (score>=threshold) AS BIGINT) AS tp, CAST(sum(y) AS BIGINT) AS pos, count(*) AS n
 FROM thr t JOIN scored s ON s.model=t.model WHERE s.split='test' GROUP BY 1,2)
SELECT model, capacity, round(threshold,8) AS threshold, nr AS n_reviewed, round(nr/n::DOUBLE,8) AS realised, round(tp/nullif(nr,0)::DOUBLE,8) AS precision, round(tp/nullif(pos,0)::DOUBLE,8) AS capture,
 round(tp/nullif(nr,0)::DOUBLE/(pos/n::DOUBLE),6) AS lift, round(nullif(nr,0)/nullif(tp,0)::DOUBLE,6) AS per_event FROM x""")
def q_capacity(spark, d):
    out = M.capacity_table(R.scored(spark, d, "val"), R.scored(spark, d, "test"), [0.01, 0.05, 0.10])
    return out.withColumns({**{c: r(c) for c in ("threshold", "realised", "precision", "capture")}, "lift": r("lift", 6), "per_event": r("per_event", 6)})


@BOOK.query(SC + """, caps(capacity) AS (VALUES (0.01::DOUBLE),(0.05::DOUBLE),(0.10::DOUBLE)), o AS (SELECT model, y, row_number() OVER (PARTITION BY model ORDER BY score DESC, entity, fyear) AS rn,
 count(*) OVER (PARTITION BY model) AS n, sum(y) OVER (PARTITION BY model) AS pos FROM scored WHERE split='test'),
x AS (SELECT model, capacity, CAST(greatest(1,round_even(capacity*n,0)) AS BIGINT) AS k, max(n) AS n, max(pos) AS pos, CAST(coalesce(sum(y) FILTER (rn<=greatest(1,round_even(capacity*n,0))),0) AS BIGINT) AS tp FROM o, caps GROUP BY 1,2,3)
SELECT model, capacity, k, tp, round(tp/k::DOUBLE,8) AS precision_at_k, round(tp/pos::DOUBLE,8) AS recall_at_k, round(tp/k::DOUBLE/(pos/n::DOUBLE),6) AS lift FROM x""")
def q_topk_capacity(spark, d):
    s = R.scored(spark, d, "test").withColumn("tie", F.col("entity") * 10000 + F.col("fyear"))
    out = M.top_k_table(s, [0.01, 0.05, 0.10], "tie")
    return out.withColumns({"precision_at_k": r("precision_at_k"), "recall_at_k": r("recall_at_k"), "lift": r("lift", 6)})


GRID = "[" + ",".join(f"{i / 2000}" for i in range(2001)) + "]"


@BOOK.query(SC + f""", q AS (SELECT DISTINCT model, t FROM (SELECT model, unnest(quantile_cont(score,{GRID})) AS t FROM scored WHERE split='val' GROUP BY 1)),
gv AS (SELECT model, score, sum(y) AS p, count(*) AS n FROM scored WHERE split='val' GROUP BY 1,2), rr(ratio) AS (VALUES (5),(10),(20),(50),(100)),
cst AS (SELECT q.model, q.t, sum(CASE WHEN g.score<q.t THEN p ELSE 0 END) AS fn, sum(CASE WHEN g.score>=q.t THEN n-p ELSE 0 END) AS fp, sum(n) AS n FROM q JOIN gv g ON g.model=q.model GROUP BY 1,2),
best AS (SELECT model, ratio, t FROM (SELECT model, ratio, t, row_number() OVER (PARTITION BY model, ratio ORDER BY ratio*fn+fp, t) AS rn FROM cst, rr) WHERE rn=1),
x AS (SELECT b.model, ratio, max(t) AS t, CAST(coalesce(sum(y) FILTER (score<t),0) AS BIGINT) AS fn, CAST(coalesce(sum(1-y) FILTER (score>=t),0) AS BIGINT) AS fp, CAST(sum(y) AS BIGINT) AS p, count(*) AS n
 FROM best b JOIN scored s ON s.model=b.model WHERE split='test' GROUP BY 1,2), z AS (SELECT *, (ratio*fn+fp)/n::DOUBLE AS c, ratio*p/n::DOUBLE AS c0, (n-p)/n::DOUBLE AS c1 FROM x)
SELECT model, ratio, round(t,8) AS threshold, fn, fp, round(c,8) AS cost, round(c0,8) AS cost_none, round(c1,8) AS cost_all, round(100.0::DOUBLE*(least(c0,c1)-c)/least(c0,c1),6) AS savings_pct FROM z""")
def q_expected_cost(spark, d):
    out = M.cost_table(R.scored(spark, d, "val"), R.scored(spark, d, "test"), (5, 10, 20, 50, 100))
    return out.withColumns({**{c: r(c) for c in ("threshold", "cost", "cost_none", "cost_all")}, "savings_pct": r("savings_pct", 6)})


def newton_sql(src, name, steps, offset=False):
    """Unrolled Newton CTEs over (model, x, p, n): <name><steps> holds model, a, b."""
    out = f", {name}0 AS (SELECT DISTINCT model, 0.0::DOUBLE AS a, {1.0 if offset else 0.0}::DOUBLE AS b FROM {src})"
    for i in range(steps):
        s = f"(SELECT d.model, any_value(k.a) AS a, any_value(k.b) AS b, sum(p-n*q) AS g0, sum((p-n*q)*x) AS g1, sum(n*q*(1-q)) AS h00, sum(n*q*(1-q)*x) AS h01, sum(n*q*(1-q)*x*x) AS h11 FROM (SELECT e.*, 1/(1+exp(-(j.a+j.b*e.x))) AS q FROM {src} e JOIN {name}{i} j ON j.model=e.model) d JOIN {name}{i} k ON k.model=d.model GROUP BY d.model)"
        step = "a+g0/h00 AS a, b" if offset else "a+(h11*g0-h01*g1)/(h00*h11-h01*h01) AS a, b+(h00*g1-h01*g0)/(h00*h11-h01*h01) AS b"
        out += f", {name}{i + 1} AS MATERIALIZED (SELECT model, {step} FROM {s})"
    return out


CLIP = "least(greatest(score,1e-9::DOUBLE),(1-1e-9)::DOUBLE)"
XS = f", xs AS MATERIALIZED (SELECT model, ln(s/(1-s)) AS x, CAST(p AS DOUBLE) AS p, CAST(n AS DOUBLE) AS n, s FROM (SELECT model, {CLIP} AS s, sum(y) AS p, count(*) AS n FROM scored WHERE split='test' GROUP BY 1,2))"


@BOOK.query(SC + XS + newton_sql("xs", "o", 12, True) + newton_sql("xs", "w", 12) + """, b AS (SELECT model, sum(p*(1-s)*(1-s)+(n-p)*s*s)/sum(n) AS brier, sum(p)/sum(n) AS rate, sum(n*s)/sum(n) AS mp FROM xs GROUP BY 1)
SELECT b.model, round(rate,8) AS event_rate, round(mp,8) AS mean_score, round(rate-mp,8) AS gap, round(brier,8) AS brier, round(1-brier/(rate*(1-rate)),8) AS skill, round(o12.a,6) AS intercept, round(w12.b,6) AS slope FROM b JOIN o12 USING (model) JOIN w12 ON w12.model=b.model""")
def q_brier_skill(spark, d):
    s = F.least(F.greatest(F.col("score"), F.lit(1e-9)), F.lit(1 - 1e-9))
    g = M.compress(R.scored(spark, d, "test").withColumn("score", s), ["model"])
    x = F.ln(F.col("score") / (1 - F.col("score")))
    shift = M.logit_map(g, x, offset=True).select("model", r("a", 6).alias("intercept"))
    slope = M.logit_map(g, x).select("model", r("b", 6).alias("slope"))
    base = g.groupBy("model").agg(
        M.brier().alias("b"), (F.sum("p") / F.sum("n")).alias("rate"), (F.sum(F.col("n") * F.col("score")) / F.sum("n")).alias("mp")
    )
    rate = F.col("rate")
    return base.select(
        "model", r(rate).alias("event_rate"), r("mp").alias("mean_score"), r(rate - F.col("mp")).alias("gap"), r("b").alias("brier"),
        r(1 - F.col("b") / (rate * (1 - rate))).alias("skill"),
    ).join(shift, "model").join(slope, "model")


@BOOK.query(SC + """, e AS (SELECT model, list_sort(list_distinct(quantile_cont(score,[0,0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9,1]))) AS ed FROM scored WHERE split='test' GROUP BY 1),
b AS (SELECT s.model, least(greatest(len(list_filter(ed, lambda z: z<=score)),1),len(ed)-1) AS bin, y, score FROM scored s JOIN e ON e.model=s.model WHERE split='test'),
k AS (SELECT model, bin, count(*) AS n, avg(y) AS o, avg(score) AS m FROM b GROUP BY 1,2) SELECT model, round(sum(n*abs(o-m))/sum(n),8) AS ece FROM k GROUP BY 1""")
def q_ece(spark, d):
    return M.expected_calibration_error(R.scored(spark, d, "test"), ["model"]).withColumn("ece", r("ece"))


@BOOK.query(SC + """, t AS (SELECT model, score, y, ntile(10) OVER (PARTITION BY model ORDER BY score, entity, fyear) - 1 AS bin FROM scored WHERE split='test'),
k AS (SELECT model, bin, count(*)::DOUBLE AS n, avg(score) AS mean_score, avg(y::DOUBLE) AS p FROM t GROUP BY 1,2), z AS (SELECT *, 1+3.841458820694124/n AS den FROM k),
w AS (SELECT *, (p+3.841458820694124/(2*n))/den AS ce, 1.959963984540054*sqrt((p*(1-p)+3.841458820694124/(4*n))/n)/den AS h FROM z)
SELECT model, bin, CAST(n AS BIGINT) AS n, round(mean_score,8) AS mean_score, round(p,8) AS observed, round(greatest(ce-h,0),8) AS lower, round(least(ce+h,1),8) AS upper FROM w""")
def q_reliability(spark, d):
    s = R.scored(spark, d, "test").withColumn("tie", F.col("entity") * 10000 + F.col("fyear"))
    return M.reliability(s, ["model"], "tie").withColumns({c: r(c) for c in ("mean_score", "observed", "lower", "upper")})


PERIODS = "(VALUES ('2000',2000,2000),('2001',2001,2001),('full',2000,2001),('none',1900,1901)) t(period,a,b)"


@BOOK.query(SC + VAL + THR + f""", ps AS (SELECT period, s.* FROM {PERIODS} JOIN scored s ON fyear BETWEEN a AND b WHERE split='test')""" + curve_sql("ps", "period, model") + f""",
k AS (SELECT period, model, CAST(sum(n) AS BIGINT) AS n_obs, max(pos) AS n_events, CASE WHEN max(pos)>0 AND max(neg)>0 THEN {AP} END AS ap, CASE WHEN max(pos)>0 AND max(neg)>0 THEN {AUC} END AS auc,
 CASE WHEN max(pos)>0 AND max(neg)>0 THEN 2.0::DOUBLE*coalesce(sum(CASE WHEN score>=threshold THEN p END),0)/(max(pos)+coalesce(sum(CASE WHEN score>=threshold THEN n END),0)) END AS f1 FROM c JOIN thr USING (model) GROUP BY 1,2)
SELECT k.period, k.model, k.n_obs, k.n_events, round(k.ap,8) AS pr_auc, round(k.auc,8) AS roc_auc, round(k.f1,8) AS f1, CAST(k.ap>=0.7::DOUBLE*f.ap AS INT) AS stable_raw,
 CAST(k.ap/(k.n_events/k.n_obs::DOUBLE)>=0.7::DOUBLE*f.ap/(f.n_events/f.n_obs::DOUBLE) AS INT) AS stable_lift FROM k JOIN k f ON f.model=k.model AND f.period='full'""")
def q_subperiod(spark, d):
    dim = spark.createDataFrame([("2000", 2000, 2000), ("2001", 2001, 2001), ("full", 2000, 2001), ("none", 1900, 1901)], "period string, a int, b int")
    s = R.scored(spark, d, "test")
    long = s.join(F.broadcast(dim), (F.col("fyear") >= F.col("a")) & (F.col("fyear") <= F.col("b"))).drop("a", "b")
    key = ["period", "model"]
    m = M.metric_table(M.curve(M.compress(long, key), key), key, M.thresholds(val_curve(spark, d), ["model"]), ["model"])
    both = (F.col("n_events") > 0) & (F.col("n_events") < F.col("n_obs"))
    m = m.withColumns({c: F.when(both, F.col(c)) for c in ("pr_auc", "roc_auc", "f1")})
    full = m.where("period = 'full'").select("model", F.col("pr_auc").alias("fa"), F.col("prevalence").alias("fp"))
    j = m.join(F.broadcast(full), "model")
    return j.select(
        *key, "n_obs", "n_events", *[r(c).alias(c) for c in ("pr_auc", "roc_auc", "f1")],
        (F.col("pr_auc") >= 0.7 * F.col("fa")).cast("int").alias("stable_raw"),
        (F.col("pr_auc") / F.col("prevalence") >= 0.7 * F.col("fa") / F.col("fp")).cast("int").alias("stable_lift"),
    )


@BOOK.query(SC + TEST + " SELECT model, score, round(tp/pos::DOUBLE,8) AS recall, round(tp/m::DOUBLE,8) AS precision, round((m-tp)/neg::DOUBLE,8) AS fpr FROM c")
def q_curve_points(spark, d):
    return M.curve_points(test_curve(spark, d), ["model"]).withColumns({c: r(c) for c in ("recall", "precision", "fpr")})


PLATT = ", xv AS MATERIALIZED (SELECT model, score AS x, CAST(sum(y) AS DOUBLE) AS p, CAST(count(*) AS DOUBLE) AS n FROM scored WHERE split='val' GROUP BY 1,2)" + newton_sql("xv", "pl", 12)


@BOOK.query(SC + PLATT + """, bt AS (SELECT 'original' AS variant, model, y, score FROM scored WHERE split='test' UNION ALL SELECT 'calibrated', s.model, y, 1/(1+exp(-(a+b*score))) FROM scored s JOIN pl12 ON pl12.model=s.model WHERE split='test')"""
    + curve_sql("bt", "variant, model") + f" SELECT variant, model, round({BRIER},8) AS brier_score, round({AP},7) AS pr_auc, round({AUC},7) AS roc_auc, round(sum(n*score)/sum(n),8) AS mean_score, round(max(score),8) AS max_score FROM c GROUP BY 1,2")
def q_calibration_compare(spark, d):
    fitted = M.logit_map(M.compress(R.scored(spark, d, "val"), ["model"]), F.col("score"))
    test = R.scored(spark, d, "test")
    both = test.withColumn("variant", F.lit("original")).unionByName(M.apply_logit_map(test, fitted).withColumn("variant", F.lit("calibrated")))
    key = ["variant", "model"]
    return M.curve(M.compress(both, key), key).groupBy(*key).agg(
        r(M.brier()).alias("brier_score"), r(M.average_precision(), 7).alias("pr_auc"), r(M.roc_auc(), 7).alias("roc_auc"),
        r(F.sum(F.col("n") * F.col("score")) / F.sum("n")).alias("mean_score"), r(F.max("score")).alias("max_score"),
    )


RULES_SQL = f""", raw AS (SELECT f.entity, f.fyear, f.split, f.label AS y, {LOGIT_SQL} AS logit, -({ZSQL}) AS z FROM (SELECT features.*, ln(CASE WHEN p.ta>0 THEN p.ta END) AS lnta, p.ta, p.lt, p.act, p.lct, p.ceq, p.oancf, p.ni, p.tax, p.me, p.che, p.ib
 FROM features JOIN panel p ON p.entity=features.entity AND p.fyear=features.fyear) f),
rl AS (SELECT split, y, 'logit rule' AS model, round(logit,9) AS score FROM raw UNION ALL SELECT split, y, 'five ratio', round(z,6) FROM raw),
xv AS MATERIALIZED (SELECT model, score AS x, CAST(sum(y) AS DOUBLE) AS p, CAST(count(*) AS DOUBLE) AS n FROM rl WHERE split='val' GROUP BY 1,2)""" + newton_sql("xv", "pl", 14) + """,
scored AS (SELECT rl.model, split, y, 1/(1+exp(-(a+b*score))) AS score FROM rl JOIN pl14 ON pl14.model=rl.model)"""


@BOOK.query("WITH " + R.FEATURES_SQL + RULES_SQL + TEST + VAL + THR + ", mt AS (" + MT + ") SELECT model, n_obs, n_events, round(pr_auc,6) AS pr_auc, round(roc_auc,6) AS roc_auc, round(ks_stat,6) AS ks_stat, round(brier_score,6) AS brier_score, round(threshold,6) AS threshold, round(f1,6) AS f1 FROM mt")
def q_rule_benchmark(spark, d):
    p = E.accounting_ratios(R.panel(spark, d)).withColumn("lnta", E.log_positive("ta"))
    raw = p.select(
        F.expr(R.SPLIT).alias("split"), F.col("label").alias("y"), r(E.logit_probability(p.columns), 9).alias("logit"), r(-zscore(), 6).alias("z")
    ).selectExpr("split", "y", "stack(2, 'logit rule', logit, 'five ratio', z) AS (model, score)")
    fitted = M.logit_map(M.compress(raw.where("split = 'val'"), ["model"]), F.col("score"))
    s = M.apply_logit_map(raw, fitted)
    c = lambda split: M.curve(M.compress(s.where(F.col("split") == split), ["model"]), ["model"])
    out = M.metric_table(c("test"), ["model"], M.thresholds(c("val"), ["model"]), ["model"])
    six = ("pr_auc", "roc_auc", "ks_stat", "brier_score", "threshold", "f1")
    return out.select("model", "n_obs", "n_events", *[r(x, 6).alias(x) for x in six])


@BOOK.query(SC + f""", e AS (SELECT entity, row_number() OVER (ORDER BY h, entity) AS rk, count(*) OVER () AS n FROM (SELECT DISTINCT entity, {hash_sql(42, 'entity')} AS h FROM panel)),
ds AS (SELECT 'chronological' AS design, model, y, score FROM scored WHERE split='test' UNION ALL SELECT 'entity_random', model, y, score FROM scored JOIN e USING (entity) WHERE rk>floor(n*0.8)
 UNION ALL SELECT 'row_random', model, y, score FROM scored WHERE {hash_sql(42, 'entity', 'fyear')} >= {int(0.8 * 2**32)})""" + curve_sql("ds", "design, model") + f""",
k AS (SELECT design, model, {AP} AS ap, max(pos)/(max(pos)+max(neg))::DOUBLE AS base FROM c GROUP BY 1,2)
SELECT model, round(max(ap) FILTER (design='chronological'),8) AS pr_chrono, round(max(ap) FILTER (design='entity_random'),8) AS pr_entity, round(max(ap) FILTER (design='row_random'),8) AS pr_row,
 round(max(ap) FILTER (design='entity_random')-max(ap) FILTER (design='chronological'),8) AS delta_entity, round(max(ap) FILTER (design='row_random')-max(ap) FILTER (design='chronological'),8) AS delta_row,
 round(max(ap/base) FILTER (design='chronological'),8) AS lift_chrono, round(max(ap/base) FILTER (design='entity_random'),8) AS lift_entity, round(max(ap/base) FILTER (design='row_random'),8) AS lift_row FROM k GROUP BY 1""")
def q_design_pivot(spark, d):
    from tidemark.operators.reporting import design_pivot

    s = R.scored(spark, d)
    chrono = s.where("split = 'test'").withColumn("design", F.lit("chronological"))
    entity = S.entity_split(s, "entity", 0.8, 42).where("side = 'test'").drop("side").withColumn("design", F.lit("entity_random"))
    rows = s.where(S.row_split(["entity", "fyear"], 0.8, 42) == "test").withColumn("design", F.lit("row_random"))
    long = chrono.unionByName(entity).unionByName(rows)
    key = ["design", "model"]
    m = M.curve(M.compress(long, key), key).groupBy(*key).agg(
        M.average_precision().alias("pr_auc"), (F.max("pos") / F.max(F.col("pos") + F.col("neg"))).alias("prevalence")
    )
    out = design_pivot(m, {"chronological": "chrono", "entity_random": "entity", "row_random": "row"}, "chronological")
    return out.select("model", *[r(c).alias(c) for c in out.columns if c != "model"])
