"""Report and fitted-state queries."""

from pyspark.sql import functions as F

from tidemark.functions import expr as E
from tidemark.functions.normal import two_sided_p_sql
from tidemark.operators import aggregates as A
from tidemark.operators import fit
from tidemark.operators import filters as FL
from tidemark.operators import pit
from tidemark.operators import windows as W
from tidemark.operators.ranks import average_ranks, percentile_columns
from tidemark.plans import roles as R
from tidemark.plans.joins import EV
from tidemark.plans.registry import Book
from tidemark.plans.rows import DIV_SQL, FLAGS_SQL, exits
from tidemark.functions import codes as C

BOOK = Book()
P = "WITH " + R.PANEL_SQL + " "
FT = "WITH " + R.FEATURES_SQL + " "
FLG = "WITH " + R.FLONG_SQL


def r(c, n=8):
    return F.round(c, n)


@BOOK.query(P + """, s AS (SELECT entity, true AS s0, coalesce(sic NOT BETWEEN 6000 AND 6999, true) AS s1, ta>0 AND fyear BETWEEN 1995 AND 2000 AS s2,
 fdate IS NOT NULL AS s3, coalesce(fdate-datadate<=180,false) AS s4, che IS NOT NULL AS s5 FROM panel),
u AS (SELECT 0 AS step_no, 'raw' AS step, count(*) AS n_rows, count(DISTINCT entity) AS n_entities FROM s
 UNION ALL SELECT 1,'codes',count(*),count(DISTINCT entity) FROM s WHERE s1 UNION ALL SELECT 2,'years',count(*),count(DISTINCT entity) FROM s WHERE s1 AND s2
 UNION ALL SELECT 3,'dated',count(*),count(DISTINCT entity) FROM s WHERE s1 AND s2 AND s3 UNION ALL SELECT 4,'lag',count(*),count(DISTINCT entity) FROM s WHERE s1 AND s2 AND s3 AND s4
 UNION ALL SELECT 5,'cash',count(*),count(DISTINCT entity) FROM s WHERE s1 AND s2 AND s3 AND s4 AND s5)
SELECT step_no, step, n_rows, n_entities, lag(n_rows) OVER (ORDER BY step_no) - n_rows AS dropped FROM u""")
def q_attrition(spark, d):
    c = F.col
    steps = [
        ("raw", F.lit(True)), ("codes", FL.outside_ranges("sic", [(6000, 6999)])),
        ("years", (c("ta") > 0) & c("fyear").between(1995, 2000)), ("dated", c("fdate").isNotNull()),
        ("lag", F.datediff("fdate", "datadate") <= 180), ("cash", c("che").isNotNull()),
    ]
    return A.attrition(R.panel(spark, d), "entity", steps)


@BOOK.query("WITH " + FLAGS_SQL + """ SELECT action, reason, status, CAST(NULL AS VARCHAR) AS payment, code, count(*) AS n_events, CAST(sum(is_performance) AS BIGINT) AS n_performance,
 CAST(sum(is_performance_core) AS BIGINT) AS n_core, CAST(sum(is_narrow) AS BIGINT) AS n_narrow, CAST(sum(is_bankruptcy) AS BIGINT) AS n_bankruptcy, CAST(sum(is_broad) AS BIGINT) AS n_broad
 FROM flags GROUP BY 1,2,3,4,5""")
def q_event_audit(spark, d):
    x = C.event_flags(exits(spark, d), "action", "reason", "status").withColumn("payment", F.lit(None).cast("string"))
    flags = {"performance": "is_performance", "core": "is_performance_core", "narrow": "is_narrow",
             "bankruptcy": "is_bankruptcy", "broad": "is_broad"}
    return x.groupBy("action", "reason", "status", "payment", "code").agg(
        F.count("*").alias("n_events"), *[F.sum(c).cast("long").alias(f"n_{n}") for n, c in flags.items()]
    )


@BOOK.query(P + "SELECT fyear, count(*) AS n_rows, CAST(sum(label) AS BIGINT) AS n_events, round(100.0::DOUBLE*sum(label)/count(*),6) AS rate_pct FROM panel GROUP BY 1")
def q_annual_rate(spark, d):
    return A.event_rate(R.panel(spark, d), ["fyear"], "label")


@BOOK.query(P + f""", dv AS (SELECT {DIV_SQL} AS division, label FROM panel), dim(division) AS (VALUES ('A: Agriculture'),('B: Mining'),('C: Construction'),
('D: Manufacturing'),('E: Transport and communication'),('F: Wholesale'),('G: Retail'),('H: Services I'),('I: Services II'),('J: Other'))
SELECT dim.division, count(dv.division) AS n_rows, coalesce(CAST(sum(label) AS BIGINT),0) AS n_events, round(100.0::DOUBLE*sum(label)/nullif(count(dv.division),0),6) AS rate_pct
FROM dim LEFT JOIN dv ON dv.division=dim.division GROUP BY 1""")
def q_rate_by_division(spark, d):
    dim = spark.createDataFrame([(n,) for _, n in E.DIVISIONS], "division string")
    counts = A.event_rate(R.panel(spark, d).withColumn("division", E.division("sic")), ["division"], "label")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return dim.join(F.broadcast(counts), "division", "left").select("division", zero("n_rows"), zero("n_events"), "rate_pct")


@BOOK.query(FT + """, s AS (SELECT split, min(fyear) AS first_year, max(fyear) AS last_year, count(*) AS n_rows, CAST(sum(label) AS BIGINT) AS n_events, avg(label) AS rate FROM features GROUP BY 1)
SELECT split, first_year, last_year, n_rows, n_events, round(rate,8) AS rate, round(rate/(SELECT rate FROM s WHERE split='train'),8) AS ratio_to_train FROM s""")
def q_split_summary(spark, d):
    s = R.features(spark, d).groupBy("split").agg(
        F.min("fyear").alias("first_year"), F.max("fyear").alias("last_year"), F.count("*").alias("n_rows"),
        F.sum("label").alias("n_events"), F.avg("label").alias("rate"),
    )
    base = s.where("split = 'train'").select(F.col("rate").alias("base"))
    return s.join(F.broadcast(base), F.lit(True)).select(
        "split", "first_year", "last_year", "n_rows", "n_events", r("rate").alias("rate"),
        r(F.col("rate") / F.col("base")).alias("ratio_to_train"),
    )


@BOOK.query("WITH " + R.MONTHLY_SQL + """ SELECT CAST(year(date) AS INT) AS year, CAST(month(date) AS INT) AS month, round(sum(me),2) AS total,
 round(sum(me) FILTER (s_nationkey<15),2) AS total_eligible FROM monthly LEFT JOIN supplier ON s_suppkey=id GROUP BY 1,2""")
def q_total_by_month(spark, d):
    from tidemark.sources.tables import table

    sup = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_nationkey") < 15).alias("ok"))
    m = R.monthly(spark, d).join(sup, "id", "left")
    return m.groupBy(F.year("date").alias("year"), F.month("date").alias("month")).agg(
        r(F.sum("me"), 2).alias("total"), r(F.sum(F.when(F.col("ok"), F.col("me"))), 2).alias("total_eligible")
    )


CELLS_SQL = """, tr AS (SELECT * FROM flong WHERE split='train'),
l1 AS (SELECT feature, segment, fyear, median(value) AS m FROM tr WHERE segment IS NOT NULL GROUP BY 1,2,3 HAVING count(value)>=5),
l2 AS (SELECT feature, segment, median(m) AS m FROM l1 GROUP BY 1,2), l3 AS (SELECT feature, fyear, median(value) AS m FROM tr GROUP BY 1,2),
l4 AS (SELECT feature, median(value) AS m FROM tr GROUP BY 1)"""


def fills(spark, d, long):
    return fit.fill_tables(long.where("split = 'train'"), "segment", "fyear")


@BOOK.query(FLG + CELLS_SQL + " SELECT feature, segment, fyear, round(m,8) AS cell_median FROM l1")
def q_cell_medians(spark, d):
    return fills(spark, d, R.feature_long(spark, d))["cell"].select(
        "feature", "segment", "fyear", r("cell_median").alias("cell_median")
    )


@BOOK.query(FLG + CELLS_SQL + """ SELECT 2 AS level, feature, segment AS key, round(m,8) AS med FROM l2
 UNION ALL SELECT 3, feature, CAST(fyear AS VARCHAR), round(m,8) FROM l3 UNION ALL SELECT 4, feature, 'all', round(m,8) FROM l4""")
def q_fallback_medians(spark, d):
    t = fills(spark, d, R.feature_long(spark, d))
    parts = [(2, "sector", F.col("segment"), "sector_median"), (3, "period", F.col("fyear").cast("string"), "period_median"),
             (4, "overall", F.lit("all"), "overall_median")]
    out = None
    for level, name, key, med in parts:
        one = t[name].select(F.lit(level).alias("level"), "feature", key.alias("key"), r(med).alias("med"))
        out = one if out is None else out.unionByName(one)
    return out


@BOOK.query(FLG + CELLS_SQL + """, j AS (SELECT f.entity, f.fyear, f.feature, f.value AS v0, l1.m AS m1, l2.m AS m2, l3.m AS m3, l4.m AS m4 FROM flong f
 LEFT JOIN l1 ON l1.feature=f.feature AND l1.segment=f.segment AND l1.fyear=f.fyear LEFT JOIN l2 ON l2.feature=f.feature AND l2.segment=f.segment
 LEFT JOIN l3 ON l3.feature=f.feature AND l3.fyear=f.fyear LEFT JOIN l4 ON l4.feature=f.feature)
SELECT entity, fyear, feature, round(coalesce(v0,m1,m2,m3,m4),8) AS value, CASE WHEN v0 IS NOT NULL THEN 0 WHEN m1 IS NOT NULL THEN 1 WHEN m2 IS NOT NULL THEN 2
 WHEN m3 IS NOT NULL THEN 3 WHEN m4 IS NOT NULL THEN 4 ELSE 5 END AS level FROM j""")
def q_hierarchical_impute(spark, d):
    long = R.feature_long(spark, d)
    return fit.fill(long, fills(spark, d, long), "segment", "fyear").select("entity", "fyear", "feature", r("value").alias("value"), "level")


@BOOK.query(FLG + " SELECT feature, fyear, round(quantile_cont(value,0.01),8) AS lower, round(quantile_cont(value,0.99),8) AS upper FROM flong GROUP BY 1,2")
def q_winsor_per_year(spark, d):
    b = fit.clip_bounds(R.feature_long(spark, d), ["feature", "fyear"])
    return b.select("feature", "fyear", r("lower").alias("lower"), r("upper").alias("upper"))


@BOOK.query(FLG + """, b AS (SELECT feature, quantile_cont(value,0.01) AS lower, quantile_cont(value,0.99) AS upper FROM flong WHERE split='train' GROUP BY 1),
c AS (SELECT feature, split, count(value) AS n, count(*) FILTER (value<lower) AS n_low, count(*) FILTER (value>upper) AS n_high FROM flong JOIN b USING (feature) GROUP BY 1,2)
SELECT feature, split, n, n_low, n_high, round(n_low/nullif(n,0)::DOUBLE,8) AS share_low, round(n_high/nullif(n,0)::DOUBLE,8) AS share_high,
 CAST(coalesce(n_low/nullif(n,0)::DOUBLE>0.02 OR n_high/nullif(n,0)::DOUBLE>0.02,false) AS INT) AS drift FROM c""")
def q_realised_clipping(spark, d):
    long = R.feature_long(spark, d)
    out = fit.realised_clipping(long, fit.clip_bounds(long.where("split = 'train'")))
    return out.withColumns({"share_low": r("share_low"), "share_high": r("share_high")})


PAIRS = [(a, b) for i, a in enumerate(R.FEATURES) for b in R.FEATURES[i + 1:]]


@BOOK.query(FT + " UNION ALL ".join(
    f"SELECT '{a}' AS f1, '{b}' AS f2, round(corr({a},{b}),6) AS r, CAST(abs(corr({a},{b}))>0.7 AS INT) AS above FROM features" for a, b in PAIRS))
def q_corr_pairs(spark, d):
    return A.correlations(R.features(spark, d), R.FEATURES).withColumn("r", r("r", 6))


GT = """, k AS (SELECT * FROM flong WHERE value IS NOT NULL), rk AS (SELECT feature, label, rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value)-1)/2.0::DOUBLE AS rk FROM k),
s AS (SELECT feature, count(*) FILTER (label=0) AS n_0, count(*) FILTER (label=1) AS n_1, avg(value) FILTER (label=0) AS mean_0, avg(value) FILTER (label=1) AS mean_1,
 stddev_samp(value) FILTER (label=0) AS sd_0, stddev_samp(value) FILTER (label=1) AS sd_1,
 quantile_cont(value,0.1) FILTER (label=0) AS p10_0, quantile_cont(value,0.5) FILTER (label=0) AS median_0, quantile_cont(value,0.9) FILTER (label=0) AS p90_0,
 quantile_cont(value,0.1) FILTER (label=1) AS p10_1, quantile_cont(value,0.5) FILTER (label=1) AS median_1, quantile_cont(value,0.9) FILTER (label=1) AS p90_1 FROM k GROUP BY 1),
z AS (SELECT s.*, (mean_0-mean_1)/sqrt(sd_0*sd_0/n_0+sd_1*sd_1/n_1) AS t_stat, pow(sd_0*sd_0/n_0+sd_1*sd_1/n_1,2)/(pow(sd_0*sd_0/n_0,2)/(n_0-1)+pow(sd_1*sd_1/n_1,2)/(n_1-1)) AS dof,
 (r0 - n_0*(n_0+1)/2.0::DOUBLE - n_0*n_1/2.0::DOUBLE)/sqrt(n_0*n_1*(n_0+n_1+1)/12.0::DOUBLE) AS rank_z,
 greatest(abs(r0 - n_0*(n_0+1)/2.0::DOUBLE - n_0*n_1/2.0::DOUBLE)-0.5,0)/sqrt(n_0*n_1/12.0::DOUBLE*(n_0+n_1+1-ties/((n_0+n_1)::DOUBLE*(n_0+n_1-1)))) AS rank_c
 FROM s JOIN (SELECT feature, sum(rk) FILTER (label=0) AS r0 FROM rk GROUP BY 1) USING (feature)
 JOIN (SELECT feature, sum(c::DOUBLE*c*c-c) AS ties FROM (SELECT feature, value, count(*) AS c FROM k GROUP BY 1,2) GROUP BY 1) USING (feature))"""
TZ = "(sign(t_stat)*(8*dof+1)/(8*dof+3)*sqrt(dof*ln(1+t_stat*t_stat/dof)))"


@BOOK.query(FLG + GT + f""" SELECT feature, n_0, n_1, round(mean_0,6) AS mean_0, round(mean_1,6) AS mean_1, round(sd_0,6) AS sd_0, round(sd_1,6) AS sd_1, round(p10_0,6) AS p10_0,
 round(median_0,6) AS median_0, round(p90_0,6) AS p90_0, round(p10_1,6) AS p10_1, round(median_1,6) AS median_1, round(p90_1,6) AS p90_1, round(t_stat,5) AS t_stat,
 round({two_sided_p_sql(TZ)},6) AS t_pvalue, round(rank_z,5) AS rank_z, round({two_sided_p_sql('rank_c')},6) AS rank_pvalue FROM z""")
def q_group_tests(spark, d):
    out = A.group_tests(R.feature_long(spark, d), "feature", "value", "label")
    six = [c for c in out.columns if c not in ("feature", "n_0", "n_1", "t_stat", "rank_z")]
    return out.withColumns({**{c: r(c, 6) for c in six}, "t_stat": r("t_stat", 5), "rank_z": r("rank_z", 5)})


@BOOK.query(FLG + """, k AS (SELECT * FROM flong WHERE value IS NOT NULL), rk AS (SELECT *, (rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value)-1)/2.0::DOUBLE)
  /count(*) OVER (PARTITION BY feature) AS pr, ln(1+greatest(value,0)) AS lv FROM k),
g AS (SELECT feature, avg(value) FILTER (label=1) AS a1, avg(value) FILTER (label=0) AS a0, var_samp(value) FILTER (label=1) AS v1, var_samp(value) FILTER (label=0) AS v0,
 avg(lv) FILTER (label=1) AS la1, avg(lv) FILTER (label=0) AS la0, var_samp(lv) FILTER (label=1) AS lv1, var_samp(lv) FILTER (label=0) AS lv0,
 avg(pr) FILTER (label=1) AS pa1, avg(pr) FILTER (label=0) AS pa0, var_samp(pr) FILTER (label=1) AS pv1, var_samp(pr) FILTER (label=0) AS pv0 FROM rk GROUP BY 1)
SELECT feature, round((a1-a0)/sqrt((v1+v0)/2),6) AS std_diff, round((la1-la0)/sqrt((lv1+lv0)/2),6) AS std_diff_log, round((pa1-pa0)/sqrt((pv1+pv0)/2),6) AS std_diff_rank,
 CAST(abs((pa1-pa0)/sqrt((pv1+pv0)/2))>0.1 AS INT) AS imbalanced FROM g""")
def q_balance(spark, d):
    out = A.balance(R.feature_long(spark, d), "feature", "value", "label")
    return out.withColumns({c: r(c, 6) for c in ("std_diff", "std_diff_log", "std_diff_rank")})


SEL = """, m AS (SELECT fyear, fdate IS NOT NULL AND segment<>'MACHINERY' AS matched, fdate-datadate > 180 AS late FROM panel),
s AS (SELECT matched, matched AND coalesce(late,false) AS over_cap, fyear FROM m)"""


def selection(spark, d):
    ok = F.col("fdate").isNotNull() & (F.col("segment") != "MACHINERY")
    late = F.coalesce(F.datediff("fdate", "datadate") > 180, F.lit(False))
    return R.panel(spark, d).select("fyear", ok.alias("matched"), (ok & late).alias("over_cap"))


@BOOK.query(P + SEL + """ SELECT step_no, step, n, round(n/(SELECT count(*) FROM s)::DOUBLE,8) AS share FROM (SELECT 0 AS step_no,'entering' AS step, count(*) AS n FROM s
 UNION ALL SELECT 1,'matched',count(*) FROM s WHERE matched UNION ALL SELECT 2,'unmatched',count(*) FROM s WHERE NOT matched
 UNION ALL SELECT 3,'over cap',count(*) FROM s WHERE over_cap UNION ALL SELECT 4,'retained',count(*) FROM s WHERE matched AND NOT over_cap)""")
def q_selection_overview(spark, d):
    m, c = F.col("matched"), F.col("over_cap")
    steps = [("entering", F.lit(True)), ("matched", m), ("unmatched", ~m), ("over cap", c), ("retained", m & ~c)]
    cells = [F.struct(F.lit(i).alias("step_no"), F.lit(s).alias("step"), F.count_if(x).alias("n"), r(F.avg(x.cast("int"))).alias("share"))
             for i, (s, x) in enumerate(steps)]
    return selection(spark, d).agg(F.explode(F.array(*cells)).alias("c")).select("c.*")


@BOOK.query(P + SEL + " SELECT fyear, count(*) AS n, round(avg(CAST(matched AS INT)),8) AS match_rate FROM s GROUP BY 1")
def q_selection_by_year(spark, d):
    return selection(spark, d).groupBy("fyear").agg(
        F.count("*").alias("n"), r(F.avg(F.col("matched").cast("int"))).alias("match_rate")
    )


PCTS = (5, 25, 50, 75, 90, 95, 99)


@BOOK.query(P + ", l AS (SELECT CAST(fdate-datadate AS BIGINT) AS lag FROM panel WHERE fdate IS NOT NULL) SELECT count(*) AS n, round(avg(lag),6) AS mean, round(stddev_samp(lag),6) AS sd, "
    + ", ".join(f"round(quantile_cont(lag,{p / 100}),6) AS p{p}" for p in PCTS) + ", round(avg(CAST(lag>180 AS INT)),8) AS over_cap, round(avg(CAST(lag<0 AS INT)),8) AS negative FROM l")
def q_lag_distribution(spark, d):
    lag = R.panel(spark, d).where("fdate IS NOT NULL").select(F.datediff("fdate", "datadate").alias("lag"))
    body = lag.agg(
        F.count("*").alias("n"), r(F.avg("lag"), 6).alias("mean"), r(F.stddev_samp("lag"), 6).alias("sd"),
        r(F.avg((F.col("lag") > 180).cast("int"))).alias("over_cap"), r(F.avg((F.col("lag") < 0).cast("int"))).alias("negative"),
    )
    pct = percentile_columns(lag, [], "lag", {f"p{p}": p / 100 for p in PCTS})
    return body.join(F.broadcast(pct.select(*[r(c, 6).alias(c) for c in pct.columns])), F.lit(True))


@BOOK.query(P + """ SELECT p.fyear, count(*) AS n, round(avg(CAST(a.entity IS NOT NULL AS INT)),8) AS share_a, round(avg(CAST(b.entity IS NOT NULL AS INT)),8) AS share_b FROM panel p
 LEFT JOIN (SELECT entity, fyear FROM panel WHERE fdate IS NOT NULL) a ON a.entity=p.entity AND a.fyear=p.fyear
 LEFT JOIN (SELECT entity, fyear FROM panel WHERE che IS NOT NULL) b ON b.entity=p.entity AND b.fyear=p.fyear GROUP BY 1""")
def q_coverage_by_year(spark, d):
    p = R.panel(spark, d)
    key = ["entity", "fyear"]
    a = p.where("fdate IS NOT NULL").select(*key, F.lit(1).alias("a"))
    b = p.where("che IS NOT NULL").select(*key, F.lit(1).alias("b"))
    has = lambda c: r(F.avg(F.col(c).isNotNull().cast("int")))
    return p.select(*key).join(a, key, "left").join(b, key, "left").groupBy("fyear").agg(
        F.count("*").alias("n"), has("a").alias("share_a"), has("b").alias("share_b")
    )


@BOOK.query("""WITH l AS (SELECT 'p_brand' AS field, p_brand AS value FROM part UNION ALL SELECT 'p_type', p_type FROM part UNION ALL SELECT 'p_size', CAST(nullif(p_size,7) AS VARCHAR) FROM part),
c AS (SELECT field, value, count(*) AS n FROM l GROUP BY 1,2)
SELECT field, value, n, rank, CAST(coalesce(value IN ('ECONOMY','STANDARD','Brand#1','Brand#2'),false) AS INT) AS allowed FROM (SELECT *, row_number() OVER (PARTITION BY field ORDER BY n DESC, value NULLS FIRST) AS rank FROM c) WHERE rank<=25""")
def q_value_counts(spark, d):
    from tidemark.sources.tables import table

    part = table(spark, d, "part").select("p_brand", "p_type", F.nullif("p_size", F.lit(7)).alias("p_size"))
    ok = F.coalesce(F.col("value").isin("ECONOMY", "STANDARD", "Brand#1", "Brand#2"), F.lit(False)).cast("int")
    return A.top_values(part, ["p_brand", "p_type", "p_size"]).withColumn("allowed", ok)


@BOOK.query(FT + """, x AS (SELECT f.split, p.fyr<=5 AS bad, f.label FROM features f JOIN panel p ON p.entity=f.entity AND p.fyear=f.fyear)
SELECT coalesce(split,'all') AS split, count(*) AS n_rows, count(*) FILTER (bad) AS n_misdated, count(*) FILTER (bad AND label=1) AS n_misdated_events FROM x GROUP BY ROLLUP(split)""")
def q_footprint_rollup(spark, d):
    p = R.panel(spark, d).withColumn("split", F.expr(R.SPLIT))
    bad = E.period_end("fyear", "fyr") != E.period_end("fyear", "fyr", "frozen")
    out = p.withColumn("bad", bad).rollup("split").agg(
        F.count("*").alias("n_rows"), F.count_if("bad").alias("n_misdated"),
        F.count_if(F.col("bad") & (F.col("label") == 1)).alias("n_misdated_events"),
    )
    return out.withColumn("split", F.coalesce("split", F.lit("all")))


@BOOK.query(EV + """, e AS (SELECT *, CASE WHEN severity<20 THEN 'low' WHEN severity<80 THEN 'mid' ELSE 'high' END AS class FROM outcomes),
a AS (SELECT *, CASE WHEN day(ts)<=10 THEN 'train' WHEN day(ts)<=20 THEN 'val' ELSE 'test' END AS split FROM anchors),
h AS (SELECT DISTINCT e.class, a.split, e.code FROM e JOIN a ON a.user_id=e.user_id AND e.event_ts BETWEEN a.ts AND a.ts + INTERVAL 12 HOURS)
SELECT class, count(*) FILTER (split='train') AS train, count(*) FILTER (split='val') AS val, count(*) FILTER (split='test') AS test FROM h GROUP BY 1""")
def q_event_pivot(spark, d):
    day = F.dayofmonth("ts")
    a = R.anchors(spark, d).withColumn("split", F.when(day <= 10, "train").when(day <= 20, "val").otherwise("test"))
    splits = F.explode(F.array(*[F.lit(s) for s in ("train", "val", "test")]))
    e = R.outcomes(spark, d).withColumn("split", splits)
    s = F.col("severity")
    e = e.withColumn("class", F.when(s < 20, "low").when(s < 80, "mid").otherwise("high"))
    by = ["user_id", "split"]
    last = pit.nearest_event(e, a, by, "event_ts", "ts", forward=False, keep="max")
    hit = e.join(last, [*by, "event_ts"]).where(F.col("event_ts") <= F.expr("ts + INTERVAL 12 HOURS"))
    return hit.groupBy("class").pivot("split", ["train", "val", "test"]).count().na.fill(0, ["train", "val", "test"])


ORPH = """, a AS (SELECT user_id*100+day(ts) AS id, ts FROM anchors), o AS (SELECT user_id*100+day(event_ts) AS id, event_ts, code FROM outcomes),
cap AS (SELECT DISTINCT a.id FROM a JOIN o ON o.id=a.id AND o.event_ts BETWEEN a.ts AND a.ts + INTERVAL 6 HOURS),
lasta AS (SELECT id, max(ts) AS last_ts FROM a GROUP BY 1),
fc AS (SELECT o.*, l.last_ts, o.id IN (SELECT id FROM cap) AS captured, epoch(o.event_ts)-epoch(l.last_ts) AS gap FROM o JOIN lasta l ON l.id=o.id
 WHERE o.event_ts >= (SELECT min(ts) FROM a) AND o.event_ts <= (SELECT max(ts) FROM a) + INTERVAL 6 HOURS)"""


def orphan_events(spark, d):
    """Outcome events of anchored ids in the observable span: captured flag and gap
    from the id's last anchor. ``id`` is user and day of month."""
    ident = lambda t: (F.col("user_id") * 100 + F.dayofmonth(t)).alias("id")
    a = R.anchors(spark, d).select(ident("ts"), "ts")
    o = R.outcomes(spark, d).select(ident("event_ts"), "event_ts", "code")
    lab = pit.forward_label(a, o, ["id"], "ts", "event_ts", "6 HOURS")
    per_id = lab.groupBy("id").agg(F.max("ts").alias("last_ts"), (F.max("label") == 1).alias("captured"))
    span = a.agg(F.min("ts").alias("_lo"), F.max("ts").alias("_hi"))
    inside = (F.col("event_ts") >= F.col("_lo")) & (F.col("event_ts") <= F.expr("_hi + INTERVAL 6 HOURS"))
    fc = o.join(F.broadcast(span), F.lit(True)).where(inside).drop("_lo", "_hi").join(per_id, "id")
    return fc.withColumn("gap", F.expr("CAST(event_ts - last_ts AS INTERVAL DAY TO SECOND)"))


@BOOK.query(EV + ORPH + """ SELECT count(*) AS n_events, count(*) FILTER (captured) AS n_captured, count(*) FILTER (NOT captured) AS n_orphaned,
 count(*) FILTER (NOT captured AND event_ts > last_ts + INTERVAL 6 HOURS) AS n_dark, count(*) FILTER (NOT captured AND event_ts <= last_ts) AS n_not_after,
 round(100.0::DOUBLE*count(*) FILTER (captured)/count(*),6) AS pct_captured FROM fc""")
def q_orphan_events(spark, d):
    orphan, after = ~F.col("captured"), F.col("event_ts") > F.expr("last_ts + INTERVAL 6 HOURS")
    return orphan_events(spark, d).agg(
        F.count("*").alias("n_events"), F.count_if("captured").alias("n_captured"), F.count_if(orphan).alias("n_orphaned"),
        F.count_if(orphan & after).alias("n_dark"), F.count_if(orphan & (F.col("event_ts") <= F.col("last_ts"))).alias("n_not_after"),
        F.round(100.0 * F.count_if("captured") / F.count("*"), 6).alias("pct_captured"),
    )


@BOOK.query(EV + ORPH + """, h(hours) AS (VALUES (6),(9),(12),(15)) SELECT hours, count(*) FILTER (NOT captured AND event_ts>=last_ts AND event_ts<=last_ts+to_hours(hours)) AS n_recovered,
 round(100.0::DOUBLE*count(*) FILTER (NOT captured AND event_ts>=last_ts AND event_ts<=last_ts+to_hours(hours))/count(*) FILTER (NOT captured),6) AS pct_of_orphans FROM fc, h GROUP BY 1""")
def q_recovery_horizons(spark, d):
    orphan = orphan_events(spark, d).where(~F.col("captured"))
    after = F.col("event_ts") >= F.col("last_ts")
    cells = []
    for h in (6, 9, 12, 15):
        n = F.count_if(after & (F.col("event_ts") <= F.expr(f"last_ts + INTERVAL {h} HOURS")))
        cells.append(F.struct(F.lit(h).alias("hours"), n.alias("n_recovered"), F.round(100.0 * n / F.count("*"), 6).alias("pct_of_orphans")))
    return orphan.agg(F.explode(F.array(*cells)).alias("c")).select("c.*")


@BOOK.query(EV + """, f AS (SELECT a.event_id, a.user_id, min(o.event_ts) AS event_ts FROM anchors a JOIN outcomes o ON o.user_id=a.user_id AND o.event_ts BETWEEN a.ts AND a.ts + INTERVAL 24 HOURS GROUP BY 1,2),
g AS (SELECT a.event_id, a.user_id, min(o.event_ts) AS event_ts FROM anchors a JOIN outcomes o ON o.user_id=a.user_id AND o.event_ts BETWEEN CAST(a.ts AS DATE) AND CAST(a.ts AS DATE) + INTERVAL 48 HOURS GROUP BY 1,2),
fe AS (SELECT user_id, event_ts, count(*) AS n FROM f GROUP BY 1,2), ge AS (SELECT user_id, event_ts, count(*) AS n FROM g GROUP BY 1,2)
SELECT 'filing' AS regime, (SELECT count(*) FROM f) AS n_rows, (SELECT count(*) FROM fe) AS n_events, (SELECT count(*) FROM fe WHERE n>=2) AS n_multi, (SELECT max(n) FROM fe) AS max_rows,
  (SELECT count(*) FROM fe ANTI JOIN ge ON fe.user_id=ge.user_id AND fe.event_ts=ge.event_ts) AS n_only_here
UNION ALL SELECT 'period', (SELECT count(*) FROM g), (SELECT count(*) FROM ge), (SELECT count(*) FROM ge WHERE n>=2), (SELECT max(n) FROM ge),
  (SELECT count(*) FROM ge ANTI JOIN fe ON fe.user_id=ge.user_id AND fe.event_ts=ge.event_ts)""")
def q_event_multiplicity(spark, d):
    a = R.anchors(spark, d).withColumn("day_start", F.to_date("ts").cast("timestamp_ntz"))
    o = R.outcomes(spark, d)
    per = {}
    for regime, anchor, reach in (("filing", "ts", "24 HOURS"), ("period", "day_start", "48 HOURS")):
        lab = pit.forward_label(a, o, ["user_id"], anchor, "event_ts", reach).where("label = 1")
        per[regime] = lab.groupBy("user_id", "event_ts").agg(F.count("*").alias("n")).withColumn("regime", F.lit(regime))
    both = per["filing"].unionByName(per["period"])
    side = both.groupBy("user_id", "event_ts").agg(
        F.max("n").alias("n_max"), F.collect_list(F.struct("regime", "n")).alias("hits")  # at most two regimes
    )
    rows = side.select(F.explode("hits").alias("h"), (F.size("hits") == 1).alias("alone")).select("h.regime", "h.n", "alone")
    return rows.groupBy("regime").agg(
        F.sum("n").alias("n_rows"), F.count("*").alias("n_events"), F.count_if(F.col("n") >= 2).alias("n_multi"),
        F.max("n").alias("max_rows"), F.count_if("alone").alias("n_only_here"),
    )


@BOOK.query("WITH " + R.MONTHLY_SQL + """, v AS (SELECT date, count(ret) OVER (PARTITION BY id ORDER BY date ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) AS n FROM monthly)
SELECT CASE WHEN year(date)<=1998 THEN 'train' WHEN year(date)=1999 THEN 'val' ELSE 'test' END AS split, count(*) AS n_rows, count(*) FILTER (n<6) AS below_6,
 count(*) FILTER (n BETWEEN 6 AND 11) AS from_6_to_11, count(*) FILTER (n=12) AS full_12 FROM v GROUP BY 1""")
def q_window_audit(spark, d):
    m = R.monthly(spark, d).withColumn("n", W.trailing_count("ret", ["id"], "date"))
    y, n = F.year("date"), F.col("n")
    return m.groupBy(F.when(y <= 1998, "train").when(y == 1999, "val").otherwise("test").alias("split")).agg(
        F.count("*").alias("n_rows"), F.count_if(n < 6).alias("below_6"), F.count_if(n.between(6, 11)).alias("from_6_to_11"),
        F.count_if(n == 12).alias("full_12"),
    )


@BOOK.query(FLG + CELLS_SQL + """, j AS (SELECT f.*, coalesce(f.value,0) AS z, coalesce(f.value,l4.m) AS mm, coalesce(f.value,l1.m,l2.m,l3.m,l4.m) AS s FROM flong f
 LEFT JOIN l1 ON l1.feature=f.feature AND l1.segment=f.segment AND l1.fyear=f.fyear LEFT JOIN l2 ON l2.feature=f.feature AND l2.segment=f.segment
 LEFT JOIN l3 ON l3.feature=f.feature AND l3.fyear=f.fyear LEFT JOIN l4 ON l4.feature=f.feature WHERE f.feature IN ('cashta','ocf_ta','clca'))
SELECT feature, count(*) FILTER (value IS NULL) AS n_missing, round(avg(label) FILTER (value IS NULL),8) AS rate_missing, round(avg(label) FILTER (value IS NOT NULL),8) AS rate_present,
 round(avg(z),6) AS mean_zero, round(avg(mm),6) AS mean_median, round(avg(s),6) AS mean_sector, round(avg(CAST(value IS NULL AS INT)),8) AS indicator_share FROM j GROUP BY 1""")
def q_missing_mechanism(spark, d):
    long = R.feature_long(spark, d).where(F.col("feature").isin("cashta", "ocf_ta", "clca"))
    t = fills(spark, d, long)
    filled = fit.fill(long.withColumn("raw", F.col("value")), t, "segment", "fyear")
    j = filled.join(F.broadcast(t["overall"]), "feature", "left")
    raw = F.col("raw")
    return j.groupBy("feature").agg(
        F.count_if(raw.isNull()).alias("n_missing"), r(F.avg(F.when(raw.isNull(), F.col("label")))).alias("rate_missing"),
        r(F.avg(F.when(raw.isNotNull(), F.col("label")))).alias("rate_present"),
        r(F.avg(F.coalesce(raw, F.lit(0.0))), 6).alias("mean_zero"), r(F.avg(F.coalesce(raw, "overall_median")), 6).alias("mean_median"),
        r(F.avg("value"), 6).alias("mean_sector"), r(F.avg(raw.isNull().cast("int"))).alias("indicator_share"),
    )


@BOOK.query("WITH " + R.SCORED_SQL + """, k AS (SELECT p.lt/nullif(p.ta,0) AS a, p.ni/nullif(p.ta,0) AS b, w.alpha AS s FROM panel p JOIN wide w ON w.entity=p.entity AND w.fyear=p.fyear WHERE p.lt IS NOT NULL AND p.ta<>0),
e AS (SELECT quantile_cont(a,1/3.0::DOUBLE) AS a1, quantile_cont(a,2/3.0::DOUBLE) AS a2, quantile_cont(b,1/3.0::DOUBLE) AS b1, quantile_cont(b,2/3.0::DOUBLE) AS b2 FROM k),
c AS (SELECT CASE WHEN a<=a1 THEN 0 WHEN a<=a2 THEN 1 ELSE 2 END AS bin_a, CASE WHEN b<=b1 THEN 0 WHEN b<=b2 THEN 1 ELSE 2 END AS bin_b, count(*) AS n, avg(s) AS mean_score FROM k, e GROUP BY 1,2)
SELECT bin_a, bin_b, n, round(mean_score,8) AS mean_score, round(mean_score-(avg(mean_score) OVER (PARTITION BY bin_a)+avg(mean_score) OVER (PARTITION BY bin_b)-avg(mean_score) OVER ()),8) AS contrast FROM c""")
def q_interaction_contrast(spark, d):
    p = E.accounting_ratios(R.panel(spark, d)).select("entity", "fyear", "tlta", "nita")
    j = p.join(R.scored_wide(spark, d).select("entity", "fyear", "alpha"), ["entity", "fyear"])
    out = A.tertile_grid(j, "tlta", "nita", "alpha")
    return out.withColumns({"mean_score": r("mean_score"), "contrast": r("contrast")})


@BOOK.query(P + """, k AS (SELECT ta, lt FROM panel WHERE lt IS NOT NULL), q AS (SELECT ta, lt, rank() OVER (ORDER BY ta)+(count(*) OVER (PARTITION BY ta)-1)/2.0::DOUBLE AS ra,
 rank() OVER (ORDER BY lt)+(count(*) OVER (PARTITION BY lt)-1)/2.0::DOUBLE AS rb FROM k) SELECT count(*) AS n, round(corr(ta,lt),6) AS pearson, round(corr(ra,rb),6) AS spearman FROM q""")
def q_spearman(spark, d):
    return A.spearman(R.panel(spark, d), "ta", "lt").select("n", r("pearson", 6).alias("pearson"), r("spearman", 6).alias("spearman"))


@BOOK.query(FT + """, k AS (SELECT label, tlta FROM features WHERE tlta IS NOT NULL), l AS (SELECT quantile_cont(tlta,0.01) AS lo, quantile_cont(tlta,0.99) AS hi FROM k),
b AS (SELECT label, CAST(least(floor((greatest(lo,least(hi,tlta))-lo)/(hi-lo)*35),34) AS BIGINT) AS bin, count(*) AS n, any_value((hi-lo)/35) AS w FROM k, l GROUP BY 1,2)
SELECT label, bin, n, round(n/(sum(n) OVER (PARTITION BY label)*w),6) AS density FROM b""")
def q_label_histogram(spark, d):
    return A.label_histogram(R.features(spark, d), "tlta", "label").withColumn("density", r("density", 6))


@BOOK.query(P + "SELECT fyear, round(avg(lt),6) AS mean, round(median(lt),6) AS median FROM panel GROUP BY 1")
def q_over_time(spark, d):
    p = R.panel(spark, d)
    med = percentile_columns(p, ["fyear"], "lt", {"median": 0.5})
    return p.groupBy("fyear").agg(r(F.avg("lt"), 6).alias("mean")).join(med, "fyear").withColumn("median", r("median", 6))


@BOOK.query(P + """ SELECT n_lines AS value, count(*) AS n_tied, any_value(ar) AS avg_rank, round(any_value(ar)/any_value(tot),8) AS pct_rank FROM (SELECT n_lines, rank() OVER (ORDER BY n_lines)+(count(*) OVER (PARTITION BY n_lines)-1)/2.0::DOUBLE AS ar,
 count(*) OVER () AS tot FROM panel) GROUP BY 1""")
def q_average_rank(spark, d):
    p = R.panel(spark, d).select("n_lines")
    total = p.agg(F.count("*").alias("_all"))
    out = average_ranks(p, [], "n_lines").join(F.broadcast(total), F.lit(True))
    return out.select(F.col("n_lines").alias("value"), "n_tied", "avg_rank", r(F.col("avg_rank") / F.col("_all")).alias("pct_rank"))
