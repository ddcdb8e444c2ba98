"""Row-level expression and filter queries on the panel."""

from pyspark.sql import functions as F

from tidemark.functions import codes as C
from tidemark.functions import expr as E
from tidemark.operators import filters as FL
from tidemark.operators import windows as W
from tidemark.plans import roles as R
from tidemark.plans.registry import Book
from tidemark.sources.tables import rebase, table

BOOK = Book()
P = "WITH " + R.PANEL_SQL + " "


def r(x, n=8):
    return F.round(x, n)


@BOOK.query(P + "SELECT entity, fyear, last_day(make_date(CAST(fyear AS INT), CAST(fyr AS INT), 1)) AS month_end FROM panel")
def q_month_end(spark, d):
    return R.panel(spark, d).select("entity", "fyear", E.month_end("fyear", "fyr").alias("month_end"))


@BOOK.query(P + """SELECT entity, fyear,
  last_day(make_date(CAST(fyear + CASE WHEN m<=5 THEN 1 ELSE 0 END AS INT), CAST(m AS INT), 1)) AS standard_end,
  last_day(make_date(CAST(fyear AS INT), CAST(m AS INT), 1)) AS frozen_end
  FROM (SELECT *, coalesce(CASE WHEN segment<>'BUILDING' THEN fyr END, 12) AS m FROM panel)""")
def q_fiscal_date(spark, d):
    p = R.panel(spark, d).withColumn("fyr", F.when(F.col("segment") != "BUILDING", F.col("fyr")))
    return p.select(
        "entity", "fyear", E.period_end("fyear", "fyr").alias("standard_end"),
        E.period_end("fyear", "fyr", "frozen").alias("frozen_end"),
    )


@BOOK.query("""SELECT p_partkey, substr(upper(trim(coalesce(CASE WHEN p_size>40 THEN NULL ELSE ' '||p_name||' ' END,''))),1,8) AS key8,
  substr(upper(trim(coalesce(CASE WHEN p_size>40 THEN NULL ELSE ' '||p_name||' ' END,''))),1,6) AS issuer6 FROM part""")
def q_normalise_key(spark, d):
    raw = F.when(F.col("p_size") <= 40, F.concat(F.lit(" "), "p_name", F.lit(" ")))
    return table(spark, d, "part").select(
        "p_partkey", E.short_key(raw, 8).alias("key8"), E.short_key(raw, 6).alias("issuer6")
    )


EXITS_SQL = """exits AS (SELECT l_orderkey AS id, l_linenumber AS line, l_partkey AS part,
  CASE l_returnflag WHEN 'R' THEN 'gdr ' WHEN 'A' THEN 'GLI' ELSE 'MER' END AS action,
  CASE l_orderkey % 6 WHEN 0 THEN 'BKPY' WHEN 1 THEN 'LP' WHEN 2 THEN 'CORQ' WHEN 3 THEN ' mvot' WHEN 4 THEN 'UNAV' END AS reason,
  CASE l_linenumber % 3 WHEN 0 THEN 'FPAY' WHEN 1 THEN 'UNAV' ELSE 'ZZZ' END AS status FROM lineitem)"""


def exits(spark, d):
    """Exit events with messy letter codes, one per line item."""
    k, n, f = F.col("l_orderkey") % 6, F.col("l_linenumber") % 3, F.col("l_returnflag")
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"),
        F.when(f == "R", "gdr ").when(f == "A", "GLI").otherwise("MER").alias("action"),
        F.when(k == 0, "BKPY").when(k == 1, "LP").when(k == 2, "CORQ").when(k == 3, " mvot").when(k == 4, "UNAV").alias("reason"),
        F.when(n == 0, "FPAY").when(n == 1, "UNAV").otherwise("ZZZ").alias("status"),
    )


@BOOK.query("WITH " + EXITS_SQL + """ SELECT id, line, part,
  CASE WHEN trim(reason)='BKPY' THEN 572 WHEN upper(trim(action))='GDR' THEN 450 ELSE 500 END AS frozen_code,
  CASE WHEN trim(reason)='BKPY' THEN 470 WHEN upper(trim(action))='GDR' THEN 450 WHEN upper(trim(action))='GLI' THEN 400 ELSE 500 END AS corrected_code
  FROM exits""")
def q_code_case(spark, d):
    x = exits(spark, d).withColumn("action", C.clean("action"))
    return x.select(
        "id", "line", "part", C.exit_code("action", "reason", rule="frozen").alias("frozen_code"),
        C.exit_code("action", "reason", rule="corrected").alias("corrected_code"),
    )


RECON = """CASE WHEN upper(trim(action))='GDR' THEN CASE upper(trim(reason)) WHEN 'BKPY' THEN 574 WHEN 'LP' THEN 552 WHEN 'CORQ' THEN 570
  WHEN 'MVOT' THEN 520 WHEN 'UNAV' THEN 500 END
  WHEN upper(trim(action))='GLI' THEN CASE upper(trim(status)) WHEN 'FPAY' THEN 450 WHEN 'UNAV' THEN 400 END END"""


@BOOK.query("WITH " + EXITS_SQL + f" SELECT id, line, part, {RECON} AS code FROM exits")
def q_code_map(spark, d):
    return exits(spark, d).select("id", "line", "part", C.exit_code("action", "reason", "status").alias("code"))


FLAGS_SQL = EXITS_SQL + f""", coded AS (SELECT *, {RECON} AS code FROM exits),
flags AS (SELECT *, CAST(coalesce(code BETWEEN 400 AND 499 OR code=500 OR code BETWEEN 520 AND 584, false) AS INT) AS is_performance,
  CAST(coalesce((code BETWEEN 400 AND 499 OR code=500 OR code BETWEEN 520 AND 584)
    AND NOT coalesce(upper(trim(action))='GDR' AND upper(trim(reason)) IN ('CORQ','MVOT'), false), false) AS INT) AS is_performance_core,
  CAST(coalesce(upper(trim(action))='GLI' OR (upper(trim(action))='GDR' AND upper(trim(reason)) IN ('BKPY','FING','INSC','EQRQ','LP')), false) AS INT) AS is_narrow,
  CAST(coalesce(upper(trim(action))='GDR' AND upper(trim(reason))='BKPY', false) AS INT) AS is_bankruptcy,
  CAST(upper(trim(action)) IN ('GLI','GDR') AS INT) AS is_broad FROM coded)"""


@BOOK.query("WITH " + FLAGS_SQL + " SELECT id, line, part, code, is_performance, is_performance_core, is_narrow, is_bankruptcy, is_broad FROM flags")
def q_event_flags(spark, d):
    return C.event_flags(exits(spark, d), "action", "reason", "status").drop("action", "reason", "status")


@BOOK.query("WITH " + R.FEATURES_SQL + """ SELECT f.entity, f.fyear, round(nita,8) AS nita, round(tlta,8) AS tlta, round(wcta,8) AS wcta,
  round(clca,8) AS clca, round(cashta,8) AS cashta, round(ocf_ta,8) AS ocf_ta, round(ib/CASE WHEN ta>0 THEN ta END,8) AS roa,
  round(lt/CASE WHEN ta>0 THEN ta END,8) AS leverage, CAST(CAST(ib<0 AS INT) AS DOUBLE) AS loss
  FROM features f JOIN panel p ON p.entity=f.entity AND p.fyear=f.fyear""")
def q_ratios(spark, d):
    x = E.weakness_covariates(E.accounting_ratios(R.panel(spark, d)))
    names = R.FEATURES + ["roa", "leverage"]
    return x.select("entity", "fyear", *[r(F.col(c)).alias(c) for c in names], "loss")


LAG = """(SELECT *, first_value(ni) OVER (PARTITION BY entity ORDER BY fyear RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING) AS ni1,
  first_value(ib) OVER (PARTITION BY entity ORDER BY fyear RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING) AS ib1,
  first_value(ta) OVER (PARTITION BY entity ORDER BY fyear RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING) AS at1 FROM panel)"""


@BOOK.query(P + f"""SELECT entity, fyear, CAST(lt>ta AS INT) AS oeneg_strict, coalesce(CAST(lt>ta AS INT),0) AS oeneg_frozen,
  CASE WHEN ib IS NOT NULL AND ib1 IS NOT NULL THEN CAST(ib<0 AND ib1<0 AS INT) END AS intwo_strict,
  coalesce(CAST(ib<0 AND ib1<0 AS INT),0) AS intwo_frozen FROM {LAG}""")
def q_indicators(spark, d):
    p = R.panel(spark, d).withColumn("ib_lag", W.period_lag("ib", ["entity"], "fyear"))
    return p.select(
        "entity", "fyear",
        E.negative_equity("lt", "ta").alias("oeneg_strict"), E.negative_equity("lt", "ta", "frozen").alias("oeneg_frozen"),
        E.two_losses("ib", "ib_lag").alias("intwo_strict"), E.two_losses("ib", "ib_lag", "frozen").alias("intwo_frozen"),
    )


@BOOK.query(P + f"SELECT entity, fyear, round((ni-ni1)/nullif(abs(ni)+abs(ni1),0),8) AS chin FROM {LAG}")
def q_symmetric_change(spark, d):
    now, before = F.col("ni"), W.period_lag("ni", ["entity"], "fyear")
    return R.panel(spark, d).select("entity", "fyear", r(E.symmetric_change(now, before)).alias("chin"))


DEFL = """defl AS (SELECT year, level/(max(level) FILTER (year=1998) OVER ()) AS deflator FROM (
  SELECT CAST(year(o_orderdate) AS BIGINT) AS year, CAST(sum(CAST(round(o_totalprice*100) AS BIGINT)) AS DOUBLE)/count(*)/100.0::DOUBLE AS level
  FROM orders GROUP BY 1))"""


def deflator(spark, d):
    obs = table(spark, d, "orders").groupBy(F.year("o_orderdate").cast("long").alias("year")).agg(
        (F.sum(R.cents("o_totalprice")).cast("double") / F.count("*") / 100.0).alias("level")
    )
    return rebase(obs, 1998)


@BOOK.query(P + ", " + DEFL + """ SELECT entity, fyear, round(CASE WHEN ta/deflator>0 THEN ln(ta/deflator) END,8) AS lnta,
  round(CASE WHEN ni/deflator>0 THEN ln(ni/deflator) END,8) AS lnni FROM panel LEFT JOIN defl ON year=year(datadate)""")
def q_log_deflated(spark, d):
    p = R.panel(spark, d).withColumn("year", F.year("datadate").cast("long"))
    j = p.join(F.broadcast(deflator(spark, d)), "year", "left")  # one row per calendar year
    return j.select(
        "entity", "fyear", r(E.log_positive(F.col("ta") / F.col("deflator"))).alias("lnta"),
        r(E.log_positive(F.col("ni") / F.col("deflator"))).alias("lnni"),
    )


@BOOK.query("""SELECT event_id, round(CASE WHEN abs(value-100)>0 THEN least(ln(CASE WHEN value<>100 THEN abs(value-100) END), ln(15.0)) END, 8) AS price FROM events""")
def q_log_cap(spark, d):
    return table(spark, d, "events").select("event_id", r(E.log_price(F.col("value") - 100)).alias("price"))


@BOOK.query("WITH " + R.PANEL_SQL + ", " + R.MONTHLY_SQL + """, tot AS (SELECT ym, sum(me) AS total FROM monthly GROUP BY 1)
SELECT id, date, round(ln(me/total),8) AS rsize, round(me/CASE WHEN ret>0 THEN ret END,4) AS mb FROM monthly JOIN tot USING (ym)""")
def q_relative_size(spark, d):
    m = R.monthly(spark, d)
    tot = m.groupBy("ym").agg(F.sum("me").alias("total"))
    return m.join(F.broadcast(tot), "ym").select(  # one total per calendar month
        "id", "date", r(E.log_positive(F.col("me") / F.col("total"))).alias("rsize"),
        r(E.market_to_book("me", "ret"), 4).alias("mb"),
    )


@BOOK.query(P + "SELECT entity, fyear, CAST(che IS NULL AS INT) AS che_missing, CAST(ceq<=0 OR ceq IS NULL AS INT) AS mb_missing FROM panel")
def q_missing_flag(spark, d):
    p = R.panel(spark, d).withColumn("mb", E.market_to_book("me", "ceq"))
    return p.select(
        "entity", "fyear", F.col("che").isNull().cast("int").alias("che_missing"),
        F.col("mb").isNull().cast("int").alias("mb_missing"),
    )


BOUNDS_SQL = "bounds AS (SELECT feature, quantile_cont(value,0.01) AS lower, quantile_cont(value,0.99) AS upper FROM flong WHERE split='train' GROUP BY 1)"


@BOOK.query("WITH " + R.FLONG_SQL + ", " + BOUNDS_SQL + """ SELECT entity, fyear, feature,
  round(CASE WHEN value IS NOT NULL THEN greatest(lower, least(upper, value)) END, 8) AS value FROM flong JOIN bounds USING (feature)""")
def q_winsor_apply(spark, d):
    from tidemark.operators.fit import clip_bounds, clip_long

    long = R.feature_long(spark, d)
    bounds = clip_bounds(long.where("split = 'train'"))
    return clip_long(long, bounds).select("entity", "fyear", "feature", r(F.col("value")).alias("value"))


@BOOK.query("WITH " + R.FLONG_SQL + ", " + BOUNDS_SQL + """ SELECT feature, split, count(value) AS n, round(sum(CASE WHEN value IS NOT NULL THEN greatest(lower, least(upper, value)) END), 6) AS clipped_sum
  FROM flong JOIN bounds USING (feature) GROUP BY 1,2""")
def q_winsor_reload(spark, d):
    """Bounds fitted on training rows, saved, reloaded and applied to every split."""
    from tidemark.operators.fit import clip_bounds, clip_long
    from tidemark.sources.tables import fitted

    long = R.feature_long(spark, d)
    kept = clip_long(long, fitted(clip_bounds(long.where("split = 'train'"))))
    return kept.groupBy("feature", "split").agg(F.count("value").alias("n"), r(F.sum("value"), 6).alias("clipped_sum"))


DIV_SQL = """CASE WHEN sic BETWEEN 0 AND 999 THEN 'A: Agriculture' WHEN sic BETWEEN 1000 AND 1499 THEN 'B: Mining'
  WHEN sic BETWEEN 1500 AND 1999 THEN 'C: Construction' WHEN sic BETWEEN 2000 AND 3999 THEN 'D: Manufacturing'
  WHEN sic BETWEEN 4000 AND 4999 THEN 'E: Transport and communication' WHEN sic BETWEEN 5000 AND 5199 THEN 'F: Wholesale'
  WHEN sic BETWEEN 5200 AND 5999 THEN 'G: Retail' WHEN sic BETWEEN 6000 AND 7999 THEN 'H: Services I'
  WHEN sic BETWEEN 8000 AND 8999 THEN 'I: Services II' WHEN sic BETWEEN 9000 AND 9999 THEN 'J: Other' END"""


@BOOK.query(P + f"SELECT entity, fyear, sic, {DIV_SQL} AS division FROM panel")
def q_bins_fixed(spark, d):
    return R.panel(spark, d).select("entity", "fyear", "sic", E.division("sic").alias("division"))


LOGIT_SQL = """1/(1+exp(-(-1.32 - 0.407*coalesce(lnta,0) + 6.03*coalesce(tlta,0) - 1.43*coalesce(wcta,0) + 0.076*coalesce(clca,0)
  - 2.37*coalesce(nita,0) - 1.83*coalesce(CASE WHEN abs(tlta)>1e-6 THEN ocf_ta/tlta ELSE 0 END,0))))"""


@BOOK.query("WITH " + R.FEATURES_SQL + f"""
 SELECT entity, fyear, round({LOGIT_SQL}, 8) AS prob FROM (SELECT f.*, ln(CASE WHEN p.ta>0 THEN p.ta END) AS lnta
  FROM features f JOIN panel p ON p.entity=f.entity AND p.fyear=f.fyear)""")
def q_logit_score(spark, d):
    x = E.accounting_ratios(R.panel(spark, d)).withColumn("lnta", E.log_positive("ta"))
    return x.select("entity", "fyear", r(E.logit_probability(x.columns)).alias("prob"))


def _sr(n, q):
    return f"coalesce(CASE WHEN abs({q})>1e-6 THEN ({n})/({q}) END, 0)"


ZSQL = f"1.2*{_sr('act-lct','ta')} + 1.4*{_sr('ceq','ta')} + 3.3*{_sr('coalesce(oancf, ni+coalesce(tax,0))','ta')} + 0.6*{_sr('me','lt')} + 0.999*{_sr('coalesce(che,ib)','ta')}"


@BOOK.query(P + f"SELECT entity, fyear, round({ZSQL}, 8) AS z FROM panel")
def q_weighted_score(spark, d):
    return R.panel(spark, d).select("entity", "fyear", r(zscore()).alias("z"))


def zscore():
    c = F.col
    return E.five_ratio_score(
        c("act") - c("lct"), "ceq", F.coalesce(c("oancf"), c("ni") + F.coalesce(c("tax"), F.lit(0.0))), "me",
        F.coalesce(c("che"), c("ib")), "ta", "lt",
    )


@BOOK.query("WITH " + R.FLONG_SQL + """, m AS (SELECT feature, avg(value) AS mu, avg(asinh(value)) AS mt FROM flong WHERE value IS NOT NULL GROUP BY 1)
SELECT feature, count(*) AS n, round(avg(CAST(value IS NULL AS INT)),8) AS missing_share,
  round(avg(pow(value-mu,3))/pow(avg(pow(value-mu,2)),1.5),5) AS skew_raw, round(avg(pow(value-mu,4))/pow(avg(pow(value-mu,2)),2)-3,5) AS kurt_raw,
  round(avg(pow(asinh(value)-mt,3))/pow(avg(pow(asinh(value)-mt,2)),1.5),5) AS skew_asinh,
  round(avg(pow(asinh(value)-mt,4))/pow(avg(pow(asinh(value)-mt,2)),2)-3,5) AS kurt_asinh,
  round(quantile_cont(value,0.01),8) AS p01, round(quantile_cont(value,0.5),8) AS p50, round(quantile_cont(value,0.99),8) AS p99,
  count(*) FILTER (value < -1) AS n_below, count(*) FILTER (value > 2) AS n_above FROM flong JOIN m USING (feature) GROUP BY feature""")
def q_profile(spark, d):
    from tidemark.operators.aggregates import profile

    return profile(R.feature_long(spark, d), "feature", "value", -1.0, 2.0)


@BOOK.query(P + "SELECT entity, fyear, sic FROM panel WHERE NOT coalesce(sic BETWEEN 6000 AND 6999, false) AND NOT coalesce(sic BETWEEN 4800 AND 4999, false)")
def q_exclude_ranges(spark, d):
    return R.panel(spark, d).where(FL.outside_ranges("sic", [(6000, 6999), (4800, 4999)])).select("entity", "fyear", "sic")


@BOOK.query(P + "SELECT entity, fyear, CAST(fdate-datadate AS INT) AS lag_days FROM panel WHERE fdate IS NOT NULL AND fdate-datadate <= 180")
def q_lag_cap(spark, d):
    return FL.filing_lag(R.panel(spark, d), "datadate", "fdate", 180).select("entity", "fyear", "lag_days")


ITEMS = ["ta", "lt", "act", "lct", "che", "ib", "ni", "oancf"]
KN = " + ".join(f"CAST({c} IS NOT NULL AS INT)" for c in ITEMS)


@BOOK.query(P + f"SELECT entity, fyear, {KN} AS n_present FROM panel WHERE {KN} >= 7")
def q_k_of_n(spark, d):
    return FL.min_coverage(R.panel(spark, d), ITEMS, 7).select("entity", "fyear", FL.coverage(ITEMS).alias("n_present"))


@BOOK.query(P + """, isl AS (SELECT entity, fyear, fyear - row_number() OVER (PARTITION BY entity ORDER BY fyear) AS i FROM panel),
runs AS (SELECT entity, max(c) AS longest FROM (SELECT entity, i, count(*) AS c FROM isl GROUP BY 1,2) GROUP BY 1)
SELECT entity, fyear, longest AS longest_run FROM panel JOIN runs USING (entity) WHERE longest >= 4""")
def q_consecutive_runs(spark, d):
    p = R.panel(spark, d).select("entity", "fyear")
    runs = W.longest_run(p, "entity", "fyear")
    return FL.min_consecutive(p, "entity", "fyear", 4).join(runs, "entity").select("entity", "fyear", "longest_run")


SEC_SETS = {"p_type": ("ECONOMY", "STANDARD", "SMALL"), "p_brand": tuple(f"BRAND#{i}" for i in range(1, 13))}


@BOOK.query("""SELECT p_partkey, CAST(coalesce(upper(trim(p_type)) IN ('ECONOMY','STANDARD','SMALL'),false) AND
  coalesce(upper(trim(p_brand)) IN ('BRAND#1','BRAND#2','BRAND#3','BRAND#4','BRAND#5','BRAND#6','BRAND#7','BRAND#8','BRAND#9','BRAND#10','BRAND#11','BRAND#12'),false) AS INT) AS eligible FROM part""")
def q_eligibility(spark, d):
    return table(spark, d, "part").select("p_partkey", C.eligible(SEC_SETS).cast("int").alias("eligible"))


@BOOK.query("WITH " + R.PANEL_SQL + ", " + R.HISTORY_SQL + " SELECT entity, fyear FROM panel WHERE entity IN (SELECT entity FROM history WHERE attr='1-URGENT' AND kind='F')")
def q_semi_anytime(spark, d):
    mask = (F.col("attr") == "1-URGENT") & (F.col("kind") == "F")
    return FL.eligible_anytime(R.panel(spark, d).select("entity", "fyear"), R.history(spark, d), "entity", mask)


@BOOK.query("WITH " + R.PANEL_SQL + ", " + R.HISTORY_SQL + """ SELECT entity, fyear, datadate FROM panel p WHERE EXISTS (
  SELECT 1 FROM history h WHERE h.entity=p.entity AND h.attr IN ('1-URGENT','3-MEDIUM') AND h.start<=p.datadate AND p.datadate<=h."end")""")
def q_semi_asof(spark, d):
    p = R.panel(spark, d).select("entity", "fyear", "datadate")
    mask = F.col("attr").isin("1-URGENT", "3-MEDIUM")
    return FL.eligible_asof(p, R.history(spark, d), ["entity"], "datadate", "start", "end", mask, disjoint=True)


@BOOK.query("WITH " + R.FEATURES_SQL + """ SELECT entity, fyear, split FROM features WHERE (entity, fyear) NOT IN (
  SELECT (o_custkey, CAST(year(o_orderdate) AS BIGINT)) FROM orders WHERE o_totalprice > 400000)""")
def q_anti_keys(spark, d):
    flagged = table(spark, d, "orders").where("o_totalprice > 400000").select(
        F.col("o_custkey").alias("entity"), F.year("o_orderdate").cast("long").alias("fyear")
    )
    return FL.without_keys(R.features(spark, d).select("entity", "fyear", "split"), flagged, ["entity", "fyear"])


