"""Attribution queries."""

from pyspark.sql import functions as F

from tidemark.operators import aggregates as AG
from tidemark.operators import attribution as N
from tidemark.operators import metrics as M
from tidemark.plans import roles as R
from tidemark.plans.registry import Book
from tidemark.plans.resampling import REPS
from tidemark.plans.scoring import SC, THR, VAL, val_curve
from tidemark.functions.expr import draw_sql

BOOK = Book()
COEF = {"nita": -0.8, "tlta": 0.5, "wcta": -0.3, "clca": 0.2, "cashta": -0.1, "ocf_ta": 0.4}
BEND = {"nita": 0.2, "tlta": 0.6, "wcta": 0.1, "clca": -0.5, "cashta": 0.3, "ocf_ta": -0.2}
ATTR_SQL = R.FLONG_SQL + f""", st AS (SELECT feature, avg(value) AS mu, stddev_pop(value) AS sd FROM flong WHERE split='train' GROUP BY 1),
cf(feature, coef, bend) AS (VALUES {",".join(f"('{f}',{COEF[f]}::DOUBLE,{BEND[f]}::DOUBLE)" for f in COEF)}),
zz AS (SELECT entity, fyear, feature, value, coef, bend, (value-mu)/nullif(sd,0) AS z FROM flong JOIN st USING (feature) JOIN cf USING (feature) WHERE split='test' AND value IS NOT NULL),
attr AS (SELECT 'line' AS model, entity, fyear, feature, value, coef*z AS attr FROM zz UNION ALL SELECT 'bent', entity, fyear, feature, value, coef*z+bend*z*z FROM zz)"""
A = "WITH " + ATTR_SQL
IMP = ", imp AS (SELECT model, feature, avg(abs(attr)) AS mean_abs FROM attr GROUP BY 1,2)"


def r(c, n=8):
    return F.round(c, n)


def attributions(spark, d):
    """Test-row attributions of a linear and a bent additive model."""
    long = R.feature_long(spark, d)
    stats = N.scale_stats(long.where("split = 'train'"))
    coefs = spark.createDataFrame([("line", f, c) for f, c in COEF.items()], "model string, feature string, coef double")
    test = long.where("split = 'test' AND value IS NOT NULL").select("entity", "fyear", "feature", "value")
    line = N.linear_attribution(test, stats, coefs)
    bend = F.element_at(F.create_map(*[F.lit(v) for kv in BEND.items() for v in kv]), F.col("feature"))
    slope = F.element_at(F.create_map(*[F.lit(v) for kv in COEF.items() for v in kv]), F.col("feature"))
    z = F.col("attr") / slope
    both = F.array(F.struct(F.lit("line").alias("model"), F.col("attr").alias("attr")),
                   F.struct(F.lit("bent").alias("model"), (F.col("attr") + bend * z * z).alias("attr")))
    return line.select("entity", "fyear", "feature", "value", F.explode(both).alias("b")).select(
        "entity", "fyear", "feature", "value", "b.model", "b.attr"
    )


def ranking(spark, d):
    """One row per feature: mean |attr| of both models."""
    pick = lambda m: F.avg(F.when(F.col("model") == m, F.abs("attr"))).alias(m)
    return attributions(spark, d).groupBy("feature").agg(pick("line"), pick("bent"))


@BOOK.query(A + " SELECT entity, fyear, feature, round(attr,7) AS attr FROM attr WHERE model='line'")
def q_linear_attribution(spark, d):
    return attributions(spark, d).where("model = 'line'").select("entity", "fyear", "feature", r("attr", 7).alias("attr"))


@BOOK.query(A + IMP + " SELECT model, feature, round(mean_abs,8) AS mean_abs, rank() OVER (PARTITION BY model ORDER BY mean_abs DESC) AS rank FROM imp")
def q_importance(spark, d):
    return N.importance(attributions(spark, d)).withColumn("mean_abs", r("mean_abs"))


@BOOK.query(A + IMP + " SELECT DISTINCT feature FROM (SELECT feature FROM (SELECT feature FROM imp WHERE model='bent' ORDER BY mean_abs DESC, feature LIMIT 3) UNION ALL SELECT unnest(['tlta','cashta']))")
def q_top_features(spark, d):
    return N.top_features(N.importance(attributions(spark, d)).where("model = 'bent'"), 3, ["tlta", "cashta"])


SIGNS = "(VALUES ('tlta','+'),('nita','-'),('wcta','-'),('clca','+'),('cashta','-'),('ocf_ta','-')) sg(feature, expected)"
DIR = IMP + f""", dd AS (SELECT model, feature, corr(value,attr) AS r, avg(attr) AS mean_attr, avg(abs(attr)) AS mean_abs FROM attr GROUP BY 1,2),
dv AS (SELECT dd.*, expected, CASE WHEN r>=0 THEN '+' ELSE '-' END AS observed, rank() OVER (PARTITION BY model ORDER BY mean_abs DESC) AS rank FROM dd LEFT JOIN {SIGNS} USING (feature)),
vd AS (SELECT *, CASE WHEN observed<>expected THEN 'Inconsistent' WHEN abs(r)>0.1 THEN 'Consistent' ELSE 'Ambiguous' END AS verdict FROM dv)"""


@BOOK.query(A + DIR + " SELECT model, feature, round(r,6) AS r, round(mean_attr,6) AS mean_attr, round(mean_abs,6) AS mean_abs, expected, observed, rank, verdict FROM vd")
def q_direction_verdict(spark, d):
    return N.directions(attributions(spark, d)).withColumns({c: r(c, 6) for c in ("r", "mean_attr", "mean_abs")})


@BOOK.query(A + IMP + """, tf AS (SELECT feature FROM imp WHERE model='bent' ORDER BY mean_abs DESC, feature LIMIT 5), pr AS (""" + " UNION ALL ".join(
    f"SELECT '{a}' AS f1, '{b}' AS f2, corr({a},{b}) AS r FROM features WHERE split='test'" for i, a in enumerate(R.FEATURES) for b in R.FEATURES[i + 1:]) + """),
bp AS (SELECT f1 AS feature, f2 AS partner, abs(r) AS r FROM pr UNION ALL SELECT f2, f1, abs(r) FROM pr), k AS (SELECT feature, max(r) AS max_r, arg_max(partner, r) AS partner FROM bp
 WHERE feature IN (SELECT feature FROM tf) AND partner IN (SELECT feature FROM tf) GROUP BY 1)
SELECT feature, round(max_r,6) AS max_r, CASE WHEN max_r>0.3 THEN partner ELSE '' END AS partner, CAST(max_r>0.3 AS INT) AS collinear FROM k""")
def q_collinear_partner(spark, d):
    pairs = AG.correlations(R.features(spark, d).where("split = 'test'"), R.FEATURES)
    top = N.top_features(N.importance(attributions(spark, d)).where("model = 'bent'"), 5, [])
    return N.collinear_partner(pairs, top, 0.3).withColumn("max_r", r("max_r", 6))


@BOOK.query(A + """, s AS (SELECT model, feature, avg(attr) AS m, corr(value,attr) AS r FROM attr GROUP BY 1,2)
SELECT model, feature, round(m,6) AS mean_attr, round(r,6) AS r, CASE WHEN m>0 THEN '+' WHEN m<0 THEN '-' ELSE '0' END AS mean_sign, CASE WHEN r>0 THEN '+' WHEN r<0 THEN '-' ELSE '0' END AS corr_sign,
 CAST((m>0)=(r>0) AND (m<0)=(r<0) AS INT) AS agree FROM s""")
def q_sign_compare(spark, d):
    return N.sign_compare(attributions(spark, d)).withColumns({"mean_attr": r("mean_attr", 6), "r": r("r", 6)})


RK = A + IMP + ", rk AS (SELECT feature, max(mean_abs) FILTER (model='line') AS a, max(mean_abs) FILTER (model='bent') AS b FROM imp GROUP BY 1)"


def tau_sql(src, tag):
    return f""", {tag}w AS (SELECT *, 1/(1.0::DOUBLE+row_number() OVER (ORDER BY a DESC, b DESC, feature)-1) AS w1, 1/(1.0::DOUBLE+row_number() OVER (ORDER BY b DESC, a DESC, feature)-1) AS w2 FROM {src}),
{tag}j AS (SELECT sign(x.a-y.a) AS sa, sign(x.b-y.b) AS sb, x.w1+y.w1 AS w1, x.w2+y.w2 AS w2 FROM {tag}w x JOIN {tag}w y ON x.feature<y.feature),
{tag} AS (SELECT sum(sa*sb)/sqrt(sum(sa*sa)*sum(sb*sb)) AS tau_b, (sum(w1*sa*sb)/sqrt(sum(w1*sa*sa)*sum(w1*sb*sb))+sum(w2*sa*sb)/sqrt(sum(w2*sa*sa)*sum(w2*sb*sb)))/2 AS weighted_tau FROM {tag}j)"""


@BOOK.query(RK + ", t3 AS (SELECT feature, a, b FROM (SELECT *, row_number() OVER (ORDER BY a DESC, feature) AS pa, row_number() OVER (ORDER BY b DESC, feature) AS pb FROM rk) WHERE pa<=3 OR pb<=3)"
    + tau_sql("rk", "ka") + tau_sql("t3", "kt") + " SELECT 'all' AS scope, round(tau_b,8) AS tau_b, round(weighted_tau,8) AS weighted_tau FROM ka UNION ALL SELECT 'top3', round(tau_b,8), round(weighted_tau,8) FROM kt")
def q_kendall_tau(spark, d):
    rk = ranking(spark, d)
    parts = [N.kendall(x, "line", "bent").withColumn("scope", F.lit(s)) for s, x in (("all", rk), ("top3", N.top_union(rk, "line", "bent", 3)))]
    return parts[0].unionByName(parts[1]).select("scope", r("tau_b").alias("tau_b"), r("weighted_tau").alias("weighted_tau"))


@BOOK.query(A + """, wa AS (SELECT feature, avg(attr) AS weight FROM attr WHERE model='line' GROUP BY 1), wb AS (SELECT feature, avg(attr) AS weight FROM attr WHERE model='bent' GROUP BY 1),
j AS (SELECT a.feature, a.weight AS x, b.weight AS y, row_number() OVER (ORDER BY abs(a.weight) DESC, a.feature)<=3 AS ia, row_number() OVER (ORDER BY abs(b.weight) DESC, a.feature)<=3 AS ib FROM wa a JOIN wb b USING (feature))
SELECT count(*) AS n_union, count(*) FILTER (ia AND ib) AS n_shared, round(avg(CAST(sign(x)=sign(y) AS INT)),8) AS sign_agreement FROM j WHERE ia OR ib""")
def q_topk_overlap(spark, d):
    at = attributions(spark, d)
    w = lambda m: at.where(F.col("model") == m).groupBy("feature").agg(F.avg("attr").alias("weight"))
    return N.topk_overlap(w("line"), w("bent"), 3).withColumn("sign_agreement", r("sign_agreement"))


@BOOK.query(A + IMP + """, ra AS (SELECT feature, rank() OVER (ORDER BY mean_abs DESC) AS rank_a FROM imp WHERE model='line'), rb AS (SELECT feature, rank() OVER (ORDER BY mean_abs DESC) AS rank_b FROM imp WHERE model='bent' AND feature<>'nita')
SELECT feature, rank_a, rank_b, rank_b-rank_a AS shift FROM ra FULL JOIN rb USING (feature) ORDER BY rank_a NULLS LAST, feature LIMIT 5""")
def q_rank_compare(spark, d):
    at = attributions(spark, d)
    one = lambda m, x: N.importance(x.where(F.col("model") == m)).select("feature", "rank")
    return N.rank_compare(one("line", at), one("bent", at.where("feature <> 'nita'")), 5)


@BOOK.query(A + """, x AS (SELECT * FROM attr WHERE model='bent'), t AS (SELECT feature, quantile_cont(value,1/3.0::DOUBLE) AS t1, quantile_cont(value,2/3.0::DOUBLE) AS t2 FROM x GROUP BY 1),
e AS (SELECT feature, CASE feature WHEN 'tlta' THEN 0.6 WHEN 'nita' THEN -0.1 ELSE t1 END AS e1, CASE feature WHEN 'tlta' THEN 1.0 WHEN 'nita' THEN 0.0 ELSE t2 END AS e2 FROM t),
b AS (SELECT x.*, CASE WHEN value<=e1 THEN 0 WHEN value<=e2 THEN 1 ELSE 2 END AS region FROM x JOIN e USING (feature)),
k AS (SELECT feature, region, count(*) AS n, avg(value) AS mv, avg(attr) AS ma, median(attr) AS md FROM b GROUP BY 1,2)
SELECT e.feature, g.region, coalesce(k.n,0) AS n, round(mv,6) AS mean_value, round(ma,6) AS mean_attr, round(md,6) AS median_attr, round(coalesce(k.n,0)/(sum(k.n) OVER (PARTITION BY e.feature))::DOUBLE,8) AS share
FROM e CROSS JOIN (VALUES (0),(1),(2)) g(region) LEFT JOIN k ON k.feature=e.feature AND k.region=g.region""")
def q_dependence_bins(spark, d):
    out = N.dependence_bins(attributions(spark, d).where("model = 'bent'"))
    return out.withColumns({**{c: r(c, 6) for c in ("mean_value", "mean_attr", "median_attr")}, "share": r("share")})


@BOOK.query(A + f""", x AS (SELECT * FROM attr WHERE model='bent'), ei AS (SELECT entity, row_number() OVER (ORDER BY entity)-1 AS idx FROM (SELECT DISTINCT entity FROM x)),
w AS (SELECT rep, entity, w FROM (SELECT rep, {draw_sql(42, 'rep', 'idx')} % (SELECT count(*) FROM ei) AS pick, count(*) AS w FROM ei, (SELECT unnest(range({REPS})) AS rep) GROUP BY 1,2) JOIN ei ON idx=pick),
pe AS (SELECT entity, feature, sum(abs(attr)) AS s, count(*) AS n FROM x GROUP BY 1,2), m AS (SELECT rep, feature, sum(w*s)/sum(w*n) AS m FROM pe JOIN w USING (entity) GROUP BY 1,2),
rr AS (SELECT *, rank() OVER (PARTITION BY rep ORDER BY m DESC) AS r FROM m)
SELECT feature, round(avg(r),8) AS mean_rank, round(stddev_pop(r),8) AS sd_rank, quantile_cont(r,0.025) AS rank_lower, quantile_cont(r,0.975) AS rank_upper, round(avg(m),8) AS mean_abs, round(stddev_pop(m),8) AS sd_abs,
 round(quantile_cont(m,0.025),8) AS abs_lower, round(quantile_cont(m,0.975),8) AS abs_upper, round(stddev_pop(m)/nullif(avg(m),0),8) AS magnitude_cv, CAST(quantile_cont(r,0.975)-quantile_cont(r,0.025)<=3 AS INT) AS rank_stable,
 CAST(stddev_pop(m)/nullif(avg(m),0)<=0.3 AS INT) AS magnitude_stable FROM rr GROUP BY 1""")
def q_rank_stability(spark, d):
    out = N.rank_stability(attributions(spark, d).where("model = 'bent'"), "entity", REPS)
    return out.withColumns({c: r(c) for c in ("mean_rank", "sd_rank", "mean_abs", "sd_abs", "abs_lower", "abs_upper", "magnitude_cv")})


@BOOK.query(SC + VAL + THR + """, t AS (SELECT s.*, threshold FROM scored s JOIN thr USING (model) WHERE split='test'),
o AS (SELECT model, 'hit' AS case, entity, fyear, score, row_number() OVER (PARTITION BY model ORDER BY score DESC, entity, fyear) AS rn FROM t WHERE y=1 AND score>=threshold
 UNION ALL SELECT model, 'miss', entity, fyear, score, row_number() OVER (PARTITION BY model ORDER BY score, entity, fyear) FROM t WHERE y=1 AND score<threshold
 UNION ALL SELECT model, 'clear', entity, fyear, score, row_number() OVER (PARTITION BY model ORDER BY score, entity, fyear) FROM t WHERE y=0 AND score<threshold)
SELECT model, "case", entity, fyear, score FROM o WHERE rn=1""".replace(" AS case,", ' AS "case",'))
def q_case_selection(spark, d):
    return N.select_cases(R.scored(spark, d, "test"), M.thresholds(val_curve(spark, d), ["model"]), ["entity", "fyear"])
