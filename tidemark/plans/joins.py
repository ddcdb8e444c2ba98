"""Point-in-time joins, labels, linkage and dedup queries."""

from pyspark.sql import functions as F

from tidemark.operators import filters as FL
from tidemark.operators import linkage as L
from tidemark.operators import pit
from tidemark.operators import windows as W
from tidemark.operators.ranks import percentile_columns
from tidemark.plans import roles as R
from tidemark.plans.registry import Book
from tidemark.sources.tables import table

BOOK = Book()
PH = "WITH " + R.PANEL_SQL + ", " + R.HISTORY_SQL + " "
EV = "WITH " + R.EVENTS_SQL + " "


@BOOK.query("""
WITH o AS (SELECT *, CAST(round(o_totalprice*100) AS BIGINT) AS c, CAST(year(o_orderdate) AS BIGINT) AS fyear FROM orders),
k AS (SELECT DISTINCT o_custkey AS entity, fyear FROM o),
b AS (SELECT o_custkey AS entity, fyear, CAST(sum(c) AS BIGINT) AS balance_c FROM o WHERE o_orderstatus='O' GROUP BY 1,2),
i AS (SELECT o_custkey AS entity, fyear, CAST(sum(c) AS BIGINT) AS income_c FROM o WHERE o_orderstatus='F' GROUP BY 1,2),
f AS (SELECT o_custkey AS entity, fyear, CAST(sum(c) AS BIGINT) AS cash_c FROM o WHERE o_orderstatus='P' GROUP BY 1,2)
SELECT entity, fyear, balance_c, income_c, cash_c, c_mktsegment AS segment FROM k LEFT JOIN b USING (entity,fyear) LEFT JOIN i USING (entity,fyear)
LEFT JOIN f USING (entity,fyear) LEFT JOIN customer ON c_custkey=entity""")
def q_multi_left_join(spark, d):
    o = table(spark, d, "orders").select(
        F.col("o_custkey").alias("entity"), F.year("o_orderdate").cast("long").alias("fyear"), "o_orderstatus",
        R.cents("o_totalprice").alias("c"),
    )
    key = ["entity", "fyear"]
    part = lambda st, name: o.where(F.col("o_orderstatus") == st).groupBy(*key).agg(F.sum("c").alias(name))
    cust = table(spark, d, "customer").select(F.col("c_custkey").alias("entity"), F.col("c_mktsegment").alias("segment"))
    base = o.select(*key).distinct()
    for st, name in (("O", "balance_c"), ("F", "income_c"), ("P", "cash_c")):
        base = base.join(part(st, name), key, "left")
    return base.join(cust, "entity", "left")


@BOOK.query(PH + """SELECT entity, fyear, datadate, target, prim FROM (
 SELECT p.entity, p.fyear, p.datadate, l.target, l.prim, row_number() OVER (PARTITION BY p.entity, p.fyear
   ORDER BY CASE l.prim WHEN 'P' THEN 0 ELSE 1 END, l.lo, l.target) AS rn
 FROM panel p JOIN links l ON l.entity=p.entity AND l.lo<=p.datadate AND p.datadate<=l.hi WHERE l.prim IN ('P','C')) WHERE rn=1""")
def q_pit_link(spark, d):
    p = R.panel(spark, d).select("entity", "fyear", "datadate")
    lk = R.links(spark, d).where(F.col("prim").isin("P", "C"))
    rank = F.when(F.col("prim") == "P", 0).otherwise(1)
    return pit.best_valid(
        p, lk, ["entity"], "datadate", "lo", "hi", ["entity", "fyear"], [rank, F.col("lo")], ["target", "prim"], "inner"
    )


@BOOK.query(PH + """, cand AS (SELECT p.entity, p.fyear, arg_max(h.attr, h.start) AS attr FROM panel p JOIN history h
  ON h.entity=p.entity AND h.start<=p.datadate AND p.datadate<=h."end" WHERE h.kind='F' GROUP BY 1,2),
cur AS (SELECT entity, arg_max(attr, start) AS current FROM history GROUP BY 1)
SELECT p.entity, p.fyear, coalesce(c.attr, cur.current) AS attr, CAST(c.attr IS NULL AS INT) AS from_current
FROM panel p LEFT JOIN cand c USING (entity, fyear) LEFT JOIN cur USING (entity)""")
def q_asof_attribute(spark, d):
    p = R.panel(spark, d).select("entity", "fyear", "datadate")
    h = R.history(spark, d)
    current = h.groupBy("entity").agg(F.max_by("attr", "start").alias("current"))
    got = pit.best_valid(
        p, h.where("kind = 'F'"), ["entity"], "datadate", "start", "end", ["entity", "fyear"],
        [-F.unix_date("start")], ["attr"], disjoint=True,
    )
    return got.join(current, "entity", "left").select(
        "entity", "fyear", F.coalesce("attr", "current").alias("attr"), F.col("attr").isNull().cast("int").alias("from_current")
    )


@BOOK.query(PH + """SELECT entity, fyear, target FROM (SELECT p.entity, p.fyear, l.target, row_number() OVER (PARTITION BY p.entity, p.fyear
   ORDER BY CASE WHEN l.prim='P' THEN 0 ELSE 1 END, l.target % 7, l.lo DESC, l.target) AS rn
 FROM panel p LEFT JOIN links l ON l.entity=p.entity AND l.lo<=p.datadate AND p.datadate<=l.hi) WHERE rn=1""")
def q_asof_priority(spark, d):
    p = R.panel(spark, d).select("entity", "fyear", "datadate")
    order = [F.when(F.col("prim") == "P", 0).otherwise(1), F.col("target") % 7, -F.unix_date("lo")]
    return pit.best_valid(
        p, R.links(spark, d), ["entity"], "datadate", "lo", "hi", ["entity", "fyear"], order, ["target"]
    ).select("entity", "fyear", "target")


CHECK_SQL = R.PANEL_SQL + ", " + R.HISTORY_SQL + """,
own AS (SELECT entity, fyear, datadate, CASE fyear%4 WHEN 1 THEN '1-urgent ' WHEN 2 THEN '3-MEDIUX' WHEN 3 THEN 'zzz' END AS own_key FROM panel),
chk AS (SELECT o.entity, o.fyear, o.own_key, h.attr AS name_key FROM own o LEFT JOIN history h ON h.entity=o.entity AND h.start<=o.datadate
  AND o.datadate<=h."end" AND h.kind<>'O'),
outc AS (SELECT *, CAST(a<>'' AND b<>'' AS INT) AS available, CAST(a<>'' AND b<>'' AND a=b AS INT) AS match, CAST(a<>'' AND b<>'' AND a<>b AS INT) AS mismatch
  FROM (SELECT *, substr(upper(trim(coalesce(own_key,''))),1,8) AS a, substr(upper(trim(coalesce(name_key,''))),1,8) AS b FROM chk))"""


def checked(spark, d):
    y = F.col("fyear") % 4
    own = R.panel(spark, d).select(
        "entity", "fyear", "datadate", F.when(y == 1, "1-urgent ").when(y == 2, "3-MEDIUX").when(y == 3, "zzz").alias("own_key")
    )
    names = R.history(spark, d).where("kind <> 'O'").select("entity", "start", "end", F.col("attr").alias("name_key"))
    at = pit.best_valid(
        own, names, ["entity"], "datadate", "start", "end", ["entity", "fyear"], [F.col("start")], ["name_key"], disjoint=True
    )
    return at.withColumns(L.key_outcomes("own_key", "name_key")).drop("datadate")


@BOOK.query("WITH " + CHECK_SQL + " SELECT entity, fyear, own_key, name_key, available, match, mismatch FROM outc")
def q_cross_validate(spark, d):
    return checked(spark, d)


DISP_SQL = CHECK_SQL + """, hist AS (SELECT DISTINCT entity, substr(upper(trim(attr)),1,8) AS k FROM history),
iss AS (SELECT entity, count(DISTINCT substr(k,1,6)) AS n FROM hist GROUP BY 1),
disp AS (SELECT o.entity, o.fyear, CASE WHEN EXISTS (SELECT 1 FROM hist h WHERE h.entity=o.entity AND h.k=upper(trim(o.own_key))) THEN 'corroborated_history'
  WHEN substr(upper(trim(own_key)),1,6)=substr(upper(trim(name_key)),1,6) THEN 'same_issuer_different_issue'
  WHEN iss.n>=2 THEN 'reorganisation' ELSE 'unresolved' END AS disposition FROM outc o LEFT JOIN iss USING (entity) WHERE mismatch=1)"""


def dispositions(spark, d):
    bad = checked(spark, d).where("mismatch = 1")
    return L.classify_mismatches(bad, R.history(spark, d), "entity", "own_key", "name_key", "attr")


@BOOK.query("WITH " + DISP_SQL + " SELECT entity, fyear, disposition FROM disp")
def q_disposition(spark, d):
    return dispositions(spark, d).select("entity", "fyear", "disposition")


@BOOK.query("WITH " + DISP_SQL + """ SELECT position, x.disposition, count(d.entity) AS n,
  round(count(d.entity)/(SELECT count(*) FROM disp)::DOUBLE, 6) AS share FROM (VALUES (0,'corroborated_history'),(1,'same_issuer_different_issue'),
  (2,'reorganisation'),(3,'unresolved')) x(position, disposition) LEFT JOIN disp d ON d.disposition=x.disposition GROUP BY 1,2""")
def q_disposition_summary(spark, d):
    return L.disposition_summary(dispositions(spark, d))


@BOOK.query("WITH " + R.MONTHLY_SQL + """, snap AS (SELECT id, date, price_c FROM (
  SELECT l_suppkey AS id, last_day(CAST(l_shipdate AS DATE)) AS date, CAST(round(l_extendedprice*100) AS BIGINT) AS price_c,
    row_number() OVER (PARTITION BY l_suppkey, last_day(CAST(l_shipdate AS DATE)) ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, l_partkey DESC) AS rn
  FROM lineitem) WHERE rn=1)
SELECT m.id, m.date, m.me, s.price_c FROM monthly m JOIN snap s ON s.id=m.id AND s.date=m.date WHERE price_c > 500000""")
def q_month_snapshot(spark, d):
    li = table(spark, d, "lineitem")
    snap = li.groupBy(F.col("l_suppkey").alias("id"), F.last_day(F.to_date("l_shipdate")).alias("date")).agg(
        F.max(F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", R.cents("l_extendedprice").alias("price_c"))).alias("b")
    ).select("id", "date", F.col("b.price_c").alias("price_c"))
    m = R.monthly(spark, d).select("id", "date", "me")
    return m.join(snap, ["id", "date"]).where("price_c > 500000")


# ------------------------------------------------------------------ labels
@BOOK.query(EV + """, lab AS (SELECT a.event_id, CAST(a.ts AS DATE) AS day, max(CAST(o.event_ts IS NOT NULL AS INT)) AS label
  FROM anchors a LEFT JOIN outcomes o ON o.user_id=a.user_id AND o.event_ts BETWEEN a.ts AND a.ts + INTERVAL 24 HOURS GROUP BY 1,2)
SELECT day, count(*) AS n_rows, CAST(sum(label) AS BIGINT) AS n_events, round(100.0::DOUBLE*sum(label)/count(*),6) AS rate_pct FROM lab GROUP BY 1""")
def q_forward_label(spark, d):
    from tidemark.operators.aggregates import event_rate

    lab = pit.forward_label(R.anchors(spark, d), R.outcomes(spark, d), ["user_id"], "ts", "event_ts", "24 HOURS", "code")
    return event_rate(lab.withColumn("day", F.to_date("ts")), ["day"], "label")


@BOOK.query(EV + """, picked AS (SELECT user_id, event_ts, event_id FROM (SELECT a.user_id, o.event_ts, a.event_id,
   row_number() OVER (PARTITION BY o.user_id, o.event_ts ORDER BY a.ts DESC, a.event_id DESC) AS rn
  FROM (SELECT DISTINCT user_id, event_ts FROM outcomes) o JOIN anchors a ON a.user_id=o.user_id AND o.event_ts BETWEEN a.ts AND a.ts + INTERVAL 24 HOURS) WHERE rn=1)
SELECT a.event_id, a.user_id, min(p.event_ts) AS event_ts, CAST(min(p.event_ts) IS NOT NULL AS INT) AS label
FROM anchors a LEFT JOIN picked p ON p.event_id=a.event_id GROUP BY 1,2""")
def q_unique_event(spark, d):
    return pit.unique_forward_label(
        R.anchors(spark, d), R.outcomes(spark, d), ["user_id"], "ts", "event_ts", "24 HOURS", ["event_id"]
    ).select("event_id", "user_id", "event_ts", "label")


HORIZONS = (6, 12, 24, 48)


@BOOK.query(EV + """, fam AS (SELECT 'all' AS family, user_id, event_ts FROM outcomes UNION ALL SELECT 'severe', user_id, event_ts FROM outcomes WHERE severity>60),
h(hours) AS (VALUES (6),(12),(24),(48)),
lab AS (SELECT f.family, h.hours, a.event_id, max(CAST(o.event_ts <= a.ts + to_hours(h.hours) AND o.event_ts >= a.ts AS INT)) AS label
  FROM anchors a CROSS JOIN h CROSS JOIN (SELECT DISTINCT family FROM fam) f LEFT JOIN fam o ON o.family=f.family AND o.user_id=a.user_id AND o.event_ts>=a.ts AND o.event_ts<=a.ts + INTERVAL 48 HOURS
  GROUP BY 1,2,3)
SELECT family, hours, count(*) AS n_rows, CAST(sum(coalesce(label,0)) AS BIGINT) AS n_events FROM lab GROUP BY 1,2""")
def q_relabel_horizons(spark, d):
    """One nearest-event pass per family serves every horizon."""
    a, o = R.anchors(spark, d), R.outcomes(spark, d)
    out = None
    for family, events in (("all", o), ("severe", o.where("severity > 60"))):
        lab = pit.forward_label(a, events, ["user_id"], "ts", "event_ts", f"{max(HORIZONS)} HOURS")
        counts = [
            F.struct(F.lit(h).alias("hours"), F.count_if(F.col("event_ts") <= F.expr(f"ts + INTERVAL {h} HOURS")).alias("n_events"))
            for h in HORIZONS
        ]
        one = lab.agg(F.count("*").alias("n_rows"), F.array(*counts).alias("x")).select(
            F.lit(family).alias("family"), "n_rows", F.explode("x").alias("x")
        ).select("family", "x.hours", "n_rows", "x.n_events")
        out = one if out is None else out.unionByName(one)
    return out


@BOOK.query(EV + """, lab AS (SELECT a.event_id, CAST(a.ts AS DATE) AS day,
  max(CAST(coalesce(o.event_ts BETWEEN a.ts AND a.ts + INTERVAL 24 HOURS, false) AS INT)) AS y1,
  max(CAST(coalesce(o.event_ts BETWEEN CAST(a.ts AS DATE) AND CAST(a.ts AS DATE) + INTERVAL 48 HOURS, false) AS INT)) AS y2
  FROM anchors a LEFT JOIN outcomes o ON o.user_id=a.user_id GROUP BY 1,2)
SELECT day, count(*) AS n_rows, round(100.0::DOUBLE*sum(y1)/count(*),6) AS rate_filing, round(100.0::DOUBLE*sum(y2)/count(*),6) AS rate_period,
 round(100.0::DOUBLE*sum(y2)/count(*) - 100.0::DOUBLE*sum(y1)/count(*),6) AS diff FROM lab GROUP BY 1""")
def q_label_anchor_compare(spark, d):
    a = R.anchors(spark, d).withColumn("day_start", F.to_date("ts").cast("timestamp_ntz"))
    o = R.outcomes(spark, d)
    one = pit.forward_label(a, o, ["user_id"], "ts", "event_ts", "24 HOURS", label="y1").drop("event_ts")
    two = pit.forward_label(one, o, ["user_id"], "day_start", "event_ts", "48 HOURS", label="y2")
    p1, p2 = 100.0 * F.sum("y1") / F.count("*"), 100.0 * F.sum("y2") / F.count("*")
    return two.groupBy(F.to_date("ts").alias("day")).agg(
        F.count("*").alias("n_rows"), F.round(p1, 6).alias("rate_filing"), F.round(p2, 6).alias("rate_period"),
        F.round(p2 - p1, 6).alias("diff"),
    )


AGREE = R.PANEL_SQL + """, diff AS (SELECT entity, fyear, CAST(fdate - other AS BIGINT) AS diff FROM (
  SELECT *, CASE WHEN segment<>'BUILDING' THEN datadate + CAST(n_ret*42 AS INT) END AS other FROM panel) WHERE fdate IS NOT NULL AND other IS NOT NULL)"""


@BOOK.query("WITH " + AGREE + """ SELECT count(*) AS n, round(avg(CAST(diff=0 AS INT)),8) AS same_day, round(avg(CAST(abs(diff)<=1 AS INT)),8) AS within_1,
  round(avg(CAST(abs(diff)<=7 AS INT)),8) AS within_7, round(avg(CAST(abs(diff)>7 AS INT)),8) AS beyond_7, round(avg(CAST(diff>0 AS INT)),8) AS later,
  median(diff) AS median_diff, round(avg(diff),8) AS mean_diff, round(stddev_samp(diff),8) AS sd_diff FROM diff""")
def q_source_agreement(spark, d):
    p = R.panel(spark, d)
    other = p.where("segment <> 'BUILDING'").select(
        "entity", "fyear", F.date_add("datadate", (F.col("n_ret") * 42).cast("int")).alias("other")
    )
    diff = L.date_agreement(p.select("entity", "fyear", "fdate"), other, ["entity", "fyear"], "fdate", "other")
    x, share = F.col("diff"), lambda c: F.round(F.avg(c.cast("int")), 8)
    body = diff.agg(
        F.count("*").alias("n"), share(x == 0).alias("same_day"), share(F.abs(x) <= 1).alias("within_1"),
        share(F.abs(x) <= 7).alias("within_7"), share(F.abs(x) > 7).alias("beyond_7"), share(x > 0).alias("later"),
        F.round(F.avg(x), 8).alias("mean_diff"), F.round(F.stddev_samp(x), 8).alias("sd_diff"),
    )
    mid = percentile_columns(diff, [], "diff", {"median_diff": 0.5})
    return body.join(F.broadcast(mid), F.lit(True))


@BOOK.query("WITH " + R.PANEL_SQL + """, fil AS (SELECT entity, fyear, coalesce(fdate, datadate+90) AS fdate,
  CASE WHEN fdate IS NULL THEN 'fallback_90d' ELSE '10K' END AS src FROM panel WHERE segment <> 'MACHINERY')
SELECT p.entity, p.fyear, CAST(f.fdate IS NOT NULL AND NOT coalesce(f.src LIKE 'fallback%', false) AS INT) AS matched FROM panel p LEFT JOIN fil f USING (entity, fyear)""")
def q_match_classify(spark, d):
    p = R.panel(spark, d)
    fil = p.where("segment <> 'MACHINERY'").select(
        "entity", "fyear", F.coalesce("fdate", F.date_add("datadate", 90)).alias("fdate"),
        F.when(F.col("fdate").isNull(), "fallback_90d").otherwise("10K").alias("src"),
    )
    return L.match_flag(p.select("entity", "fyear"), fil, ["entity", "fyear"], "fdate", "src").select("entity", "fyear", "matched")


@BOOK.query("WITH " + R.PANEL_SQL + """ SELECT p.entity, p.fyear, p.ni, q.ni AS ni_lag, q.ta AS ta_lag FROM panel p
 LEFT JOIN panel q ON q.entity=p.entity AND q.fyear=p.fyear-1 WHERE p.fyear>=1998""")
def q_lag_donor(spark, d):
    p = R.panel(spark, d).select("entity", "fyear", "ni", "ta")
    out = L.lag_with_donors(p.where("fyear >= 1998"), p.where("fyear < 1998"), "entity", "fyear", ["ni", "ta"], validate=False)
    return out.select("entity", "fyear", "ni", "ni_lag", "ta_lag")


@BOOK.query("WITH " + R.MONTHLY_SQL + """, a AS (SELECT ym, sum(me) AS t FROM monthly GROUP BY 1),
b AS (SELECT ym, sum(me) AS t FROM monthly JOIN supplier ON s_suppkey=id WHERE s_nationkey < 15 GROUP BY 1)
SELECT m.ym, round(ln(b.t/a.t),8) AS shift, count(*) AS n_rows, count(DISTINCT round(ln(b.t/a.t),8)) AS n_values FROM monthly m JOIN a USING (ym) JOIN b USING (ym) GROUP BY 1,2""")
def q_denominator_shift(spark, d):
    m = R.monthly(spark, d)
    sup = table(spark, d, "supplier").where("s_nationkey < 15").select(F.col("s_suppkey").alias("id"))
    every = m.groupBy("ym").agg(F.sum("me").alias("t_all"))
    some = m.join(sup, "id", "left_semi").groupBy("ym").agg(F.sum("me").alias("t_some"))
    shift = every.join(some, "ym").select("ym", F.round(F.ln(F.col("t_some") / F.col("t_all")), 8).alias("shift"))
    rows = m.join(F.broadcast(shift), "ym")  # one value per calendar month
    return rows.groupBy("ym").agg(
        F.max("shift").alias("shift"), F.count("*").alias("n_rows"), F.countDistinct("shift").alias("n_values")
    )


# ------------------------------------------------------------------ dedup
@BOOK.query("""SELECT o_custkey AS entity, fyear, o_orderkey AS order_id, o_orderpriority AS attr FROM (SELECT *, CAST(year(o_orderdate) AS BIGINT) AS fyear,
  row_number() OVER (PARTITION BY o_custkey, year(o_orderdate) ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn=1""")
def q_dedup_latest(spark, d):
    o = table(spark, d, "orders").select(
        F.col("o_custkey").alias("entity"), F.year("o_orderdate").cast("long").alias("fyear"),
        F.col("o_orderkey").alias("order_id"), F.col("o_orderpriority").alias("attr"), F.to_date("o_orderdate").alias("day"),
    )
    return FL.first_per_key(o, ["entity", "fyear"], [-F.unix_date("day"), -F.col("order_id")]).drop("day")


@BOOK.query("""WITH x AS (SELECT l_orderkey, l_linenumber AS set_no, nullif(l_tax,0) AS tax, nullif(l_discount,0) AS disc, l_partkey FROM lineitem),
any_std AS (SELECT count(*) FILTER (set_no IN (1,2)) AS n FROM x)
SELECT l_orderkey, set_no, tax, disc, l_partkey FROM (SELECT x.*, row_number() OVER (PARTITION BY l_orderkey ORDER BY set_no,
  -(CAST(tax IS NOT NULL AS INT)+CAST(disc IS NOT NULL AS INT)), tax NULLS FIRST, disc NULLS FIRST, l_partkey) AS rn
  FROM x, any_std WHERE n=0 OR set_no IN (1,2)) WHERE rn=1""")
def q_dedup_completeness(spark, d):
    x = table(spark, d, "lineitem").select(
        "l_orderkey", F.col("l_linenumber").alias("set_no"), F.nullif("l_tax", F.lit(0.0)).alias("tax"),
        F.nullif("l_discount", F.lit(0.0)).alias("disc"), "l_partkey",
    )
    return FL.standard_set_first(x, ["l_orderkey"], "set_no", ["tax", "disc"])


@BOOK.query("""SELECT entity, source, day, order_id FROM (SELECT o_custkey AS entity, o_orderpriority AS source, CAST(o_orderdate AS DATE) AS day, o_orderkey AS order_id,
  row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderpriority WHEN '2-HIGH' THEN 1 WHEN '5-LOW' THEN 2 WHEN '1-URGENT' THEN 3 ELSE 4 END,
   o_orderdate, o_orderpriority, o_orderkey) AS rn FROM orders) WHERE rn=1""")
def q_dedup_priority(spark, d):
    o = table(spark, d, "orders").select(
        F.col("o_custkey").alias("entity"), F.col("o_orderpriority").alias("source"), F.to_date("o_orderdate").alias("day"),
        F.col("o_orderkey").alias("order_id"),
    )
    return FL.by_priority(o, ["entity"], "source", ["2-HIGH", "5-LOW", "1-URGENT"], "day")


# ------------------------------------------------------------------ windows
@BOOK.query("WITH " + R.PANEL_SQL + """ SELECT p.entity, p.fyear, p.ni, q.ni AS ni_lag1, s.ni AS ni_lag2 FROM panel p
  LEFT JOIN panel q ON q.entity=p.entity AND q.fyear=p.fyear-1 LEFT JOIN panel s ON s.entity=p.entity AND s.fyear=p.fyear-2""")
def q_period_lag(spark, d):
    return R.panel(spark, d).select(
        "entity", "fyear", "ni", W.period_lag("ni", ["entity"], "fyear").alias("ni_lag1"),
        W.period_lag("ni", ["entity"], "fyear", 2).alias("ni_lag2"),
    )


MKT = """, lagm AS (SELECT *, lag(me) OVER (PARTITION BY id ORDER BY date) AS w FROM monthly),
mkt AS (SELECT date, sum(w*ret)/sum(w) AS vwret, count(*) AS n FROM lagm WHERE ret IS NOT NULL AND w>0 GROUP BY 1)"""


def market(spark, d):
    from tidemark.operators.aggregates import weighted_return

    return weighted_return(R.monthly(spark, d), "id", "date", "ret", "me")


@BOOK.query("WITH " + R.MONTHLY_SQL + MKT + " SELECT date, round(vwret,8) AS vwret, n FROM mkt")
def q_weighted_mean(spark, d):
    return market(spark, d).select("date", F.round("vwret", 8).alias("vwret"), "n")


@BOOK.query("WITH " + R.MONTHLY_SQL + MKT + """, mw AS (SELECT date, CASE WHEN count(vwret) OVER w >= 12 THEN exp(sum(ln(1+coalesce(vwret,0))) OVER w)-1 END AS g FROM mkt
  WINDOW w AS (ORDER BY date ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)),
own AS (SELECT id, date, CASE WHEN count(ret) OVER w >= 12 THEN exp(sum(ln(1+coalesce(ret,0))) OVER w)-1 END AS g FROM monthly
  WINDOW w AS (PARTITION BY id ORDER BY date ROWS BETWEEN 11 PRECEDING AND CURRENT ROW))
SELECT o.id, o.date, round(o.g - m.g, 6) AS exret FROM own o LEFT JOIN mw m USING (date)""")
def q_trailing_excess(spark, d):
    return W.trailing_excess(R.monthly(spark, d), market(spark, d), ["id"], "date", "ret", "vwret").select(
        "id", "date", F.round("exret", 6).alias("exret")
    )


@BOOK.query("WITH " + R.MONTHLY_SQL + """ SELECT id, date, round(CASE WHEN count(ret) OVER w >= 12 THEN stddev_samp(ret) OVER w END, 8) AS sigma FROM monthly
  WINDOW w AS (PARTITION BY id ORDER BY date ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)""")
def q_trailing_sd(spark, d):
    return R.monthly(spark, d).select("id", "date", F.round(W.trailing_sd("ret", ["id"], "date"), 8).alias("sigma"))


@BOOK.query("WITH " + R.PANEL_SQL + """ SELECT p.entity, p.fyear, round(CASE WHEN CAST(p.che IS NOT NULL AS INT)+CAST(q.che IS NOT NULL AS INT)+CAST(s.che IS NOT NULL AS INT)>=2 THEN
  (coalesce(p.che,0)+coalesce(q.che*0.5::DOUBLE,0)+coalesce(s.che*0.25::DOUBLE,0))/(CASE WHEN p.che IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END
   +CASE WHEN q.che IS NOT NULL THEN 0.5::DOUBLE ELSE 0 END+CASE WHEN s.che IS NOT NULL THEN 0.25::DOUBLE ELSE 0 END) END, 6) AS che_avg FROM panel p
  LEFT JOIN panel q ON q.entity=p.entity AND q.fyear=p.fyear-1 LEFT JOIN panel s ON s.entity=p.entity AND s.fyear=p.fyear-2""")
def q_trailing_decay(spark, d):
    return R.panel(spark, d).select("entity", "fyear", F.round(W.trailing_decay("che", ["entity"], "fyear"), 6).alias("che_avg"))


@BOOK.query("WITH " + R.MONTHLY_SQL + """ SELECT id, date, ym - lag(ym,11) OVER (PARTITION BY id ORDER BY date) + 1 AS span,
  CAST(coalesce(ym - lag(ym,11) OVER (PARTITION BY id ORDER BY date) + 1 = 12, false) AS INT) AS contiguous FROM monthly""")
def q_window_span(spark, d):
    span = W.window_span("ym", ["id"], "date")
    return R.monthly(spark, d).select(
        "id", "date", span.alias("span"), F.coalesce(span == 12, F.lit(False)).cast("int").alias("contiguous")
    )
