"""Role tables: the panel, monthly series, histories and scores the operators need,
derived from the given tables. ``CTE`` holds the same definitions as plain SQL.

Money is summed in whole cents, so totals do not depend on summation order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.tables import table

FEATURES = ["nita", "tlta", "wcta", "clca", "cashta", "ocf_ta"]
MODELS = ["alpha", "beta", "gamma"]


def cents(col: str):
    return F.round(F.col(col) * 100).cast("long")


def units(col: str):
    """Cent totals back to money."""
    return F.col(col).cast("double") / F.lit(100.0)


def order_lines(spark: SparkSession, d: str) -> DataFrame:
    """One row per order key of lineitem totals."""
    pct = lambda c: F.round(F.col(c) * 100).cast("long")
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(
        F.count("*").alias("n_lines"),
        F.sum(cents("l_extendedprice")).alias("ext_c"),
        F.sum(cents("l_extendedprice") * pct("l_discount")).alias("disc_c"),
        F.sum(cents("l_extendedprice") * pct("l_tax")).alias("tax_c"),
        F.sum(F.col("l_quantity").cast("long")).alias("qty"),
        F.count_if(F.col("l_returnflag") == "R").alias("n_ret"),
        F.count_if((F.col("l_returnflag") == "R") & (F.col("l_discount") > 0.085)).alias("n_heavy"),
    )


def panel(spark: SparkSession, d: str) -> DataFrame:
    """Customer-year cells with statement items, dates, sector and label."""
    orders = table(spark, d, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_orderdate",
        cents("o_totalprice").alias("c"),
    )
    joined = orders.join(order_lines(spark, d), F.col("o_orderkey") == F.col("l_orderkey"), "left")
    st, pr = F.col("o_orderstatus"), F.col("o_orderpriority")
    cell = joined.groupBy(
        F.col("o_custkey").alias("entity"), F.year("o_orderdate").cast("long").alias("fyear")
    ).agg(
        F.count("*").alias("n_orders"),
        F.max(F.to_date("o_orderdate")).alias("last_order"),
        F.sum("c").alias("at_c"),
        F.sum(F.when(pr < "3", F.col("c"))).alias("act_c"),
        F.sum(F.when(st == "O", F.col("c"))).alias("che_c"),
        F.sum(F.when(st != "P", F.col("c") - 24000000)).alias("ib_c"),
        F.sum(F.col("c") - 25000000).alias("ni_c"),
        F.sum(F.when(st == "F", F.col("c") - 26000000)).alias("oancf_c"),
        F.sum("ext_c").alias("lt_c"),
        F.sum("disc_c").alias("lct_c"),
        F.sum("tax_c").alias("tax_c"),
        F.sum("qty").alias("qty"),
        F.sum(F.coalesce("n_lines", F.lit(0))).alias("n_lines"),
        F.sum(F.coalesce("n_ret", F.lit(0))).alias("n_ret"),
        F.sum(F.coalesce("n_heavy", F.lit(0))).alias("n_heavy"),
    )
    cust = table(spark, d, "customer").select(
        F.col("c_custkey").alias("entity"),
        (F.col("c_nationkey").cast("long") * 400).alias("sic"),
        F.col("c_mktsegment").alias("segment"),
    )
    out = cell.select(
        "entity", "fyear", "n_orders",
        F.last_day("last_order").alias("datadate"),
        F.month("last_order").cast("long").alias("fyr"),
        units("at_c").alias("ta"),
        units("lt_c").alias("lt"),
        units("act_c").alias("act"),
        (F.col("lct_c").cast("double") / 1000.0).alias("lct"),
        units("che_c").alias("che"),
        units("ib_c").alias("ib"),
        units("ni_c").alias("ni"),
        units("oancf_c").alias("oancf"),
        ((F.col("at_c") - F.col("lt_c")).cast("double") / 100.0).alias("ceq"),
        (F.col("tax_c").cast("double") / 10000.0).alias("tax"),
        F.col("qty").cast("double").alias("me"),
        "n_lines", "n_ret",
        F.when(F.col("n_heavy") > 0, 1).otherwise(0).alias("label"),
    )
    out = out.withColumn(
        "fdate", F.when(F.col("n_lines") > 0, F.date_add("datadate", (F.col("n_lines") * 15).cast("int")))
    )
    return out.join(cust, "entity", "left")


SPLIT = "CASE WHEN fyear <= 1998 THEN 'train' WHEN fyear = 1999 THEN 'val' ELSE 'test' END"


def features(spark: SparkSession, d: str) -> DataFrame:
    """Panel plus raw ratios and the chronological split."""
    p = panel(spark, d)
    den = F.nullif(F.col("ta"), F.lit(0.0))
    return p.select(
        "entity", "fyear", "datadate", "fdate", "segment", "sic", "label",
        (F.col("ni") / den).alias("nita"),
        (F.col("lt") / den).alias("tlta"),
        ((F.col("act") - F.col("lct")) / den).alias("wcta"),
        (F.col("lct") / F.nullif(F.col("act"), F.lit(0.0))).alias("clca"),
        (F.col("che") / den).alias("cashta"),
        (F.col("oancf") / den).alias("ocf_ta"),
        F.expr(SPLIT).alias("split"),
    )


def feature_long(spark: SparkSession, d: str, cols=FEATURES) -> DataFrame:
    f = features(spark, d)
    pairs = ", ".join(f"'{c}', {c}" for c in cols)
    return f.selectExpr(
        "entity", "fyear", "split", "segment", "label", f"stack({len(cols)}, {pairs}) AS (feature, value)"
    )


def scored_wide(spark: SparkSession, d: str) -> DataFrame:
    """Row key, label and one score per model on a 0.001 grid (natural ties)."""
    p = panel(spark, d)
    share = F.coalesce(F.col("n_ret") / F.nullif(F.col("n_lines"), F.lit(0)), F.lit(0.0))
    lev = F.coalesce(F.col("lt") / F.nullif(F.col("ta"), F.lit(0.0)), F.lit(0.0))
    grid = lambda x: F.floor(F.least(x, F.lit(0.999)) * 1000) / F.lit(1000.0)
    return p.select(
        "entity", "fyear", "segment", F.expr(SPLIT).alias("split"), F.col("label").alias("y"),
        grid(share * 0.6 + F.col("n_lines") / F.lit(100.0)).alias("alpha"),
        grid(lev * 0.3 + share * 0.4).alias("beta"),
        grid(F.col("n_lines") / (F.col("n_lines") + F.lit(20.0))).alias("gamma"),
    )


def scored(spark: SparkSession, d: str, split: str | None = None) -> DataFrame:
    """Long scored table (model, entity, fyear, segment, split, y, score)."""
    w = scored_wide(spark, d)
    if split:
        w = w.where(F.col("split") == split)
    return w.selectExpr(
        "entity", "fyear", "segment", "split", "y",
        "stack(3, 'alpha', alpha, 'beta', beta, 'gamma', gamma) AS (model, score)",
    )


def monthly(spark: SparkSession, d: str) -> DataFrame:
    """Supplier-month series: cap, price, return against the previous row."""
    from tidemark.operators.windows import previous_row

    base = table(spark, d, "lineitem").groupBy(
        F.col("l_suppkey").alias("id"), F.last_day(F.to_date("l_shipdate")).alias("date")
    ).agg(F.sum(cents("l_extendedprice")).alias("c"), F.sum(F.col("l_quantity").cast("long")).alias("q"))
    base = base.select(
        "id", "date",
        (F.year("date") * 12 + F.month("date")).cast("long").alias("ym"),
        units("c").alias("me"),
        ((F.col("c") / F.col("q")) / F.lit(100.0)).alias("prc"),
    )
    prev = base.withColumn("me_lag", previous_row("me", ["id"], "date"))
    return prev.withColumn("ret", F.col("me") / F.col("me_lag") - 1).drop("me_lag")


def history(spark: SparkSession, d: str) -> DataFrame:
    """Priority in force per customer: from the order day to the day before the next.

    Reduced to one row per (customer, day) first, so the window is bounded by days.
    """
    day = table(spark, d, "orders").groupBy(
        F.col("o_custkey").alias("entity"), F.to_date("o_orderdate").alias("start")
    ).agg(
        F.max(F.struct("o_orderkey", "o_orderpriority", "o_orderstatus", cents("o_totalprice").alias("c"))).alias("b")
    )
    from tidemark.operators.windows import next_row

    nxt = next_row("start", ["entity"], "start")
    return day.select(
        "entity", "start",
        F.coalesce(F.date_sub(nxt, 1), F.lit("2099-12-31").cast("date")).alias("end"),
        F.col("b.o_orderkey").alias("hkey"),
        F.col("b.o_orderpriority").alias("attr"),
        F.col("b.o_orderstatus").alias("kind"),
    )


def links(spark: SparkSession, d: str) -> DataFrame:
    """Overlapping link intervals: one per customer day of 400 days, typed by status."""
    h = history(spark, d)
    return h.select(
        "entity",
        F.col("hkey").alias("target"),
        F.when(F.col("kind") == "P", "P").when(F.col("kind") == "O", "C").otherwise("J").alias("prim"),
        F.col("start").alias("lo"),
        F.date_add("start", 400).alias("hi"),
    )


def anchors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").where("event_type = 'purchase'").select("event_id", "user_id", "ts", "value")


def outcomes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").where("event_type = 'error'").select(
        F.col("user_id"), F.col("ts").alias("event_ts"), F.col("event_id").alias("code"), F.col("value").alias("severity")
    )


# ---------------------------------------------------------------- SQL twins
LINES_SQL = """
lines AS (
  SELECT l_orderkey, count(*) AS n_lines,
    CAST(sum(CAST(round(l_extendedprice*100) AS BIGINT)) AS BIGINT) AS ext_c,
    CAST(sum(CAST(round(l_extendedprice*100) AS BIGINT)*CAST(round(l_discount*100) AS BIGINT)) AS BIGINT) AS disc_c,
    CAST(sum(CAST(round(l_extendedprice*100) AS BIGINT)*CAST(round(l_tax*100) AS BIGINT)) AS BIGINT) AS tax_c,
    CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS qty,
    count(*) FILTER (l_returnflag='R') AS n_ret,
    count(*) FILTER (l_returnflag='R' AND l_discount > 0.085) AS n_heavy
  FROM lineitem GROUP BY 1)"""
PANEL_SQL = LINES_SQL + """,
cell AS (
  SELECT o_custkey AS entity, CAST(year(o_orderdate) AS BIGINT) AS fyear, count(*) AS n_orders,
    max(CAST(o_orderdate AS DATE)) AS last_order,
    CAST(sum(c) AS BIGINT) AS at_c,
    CAST(sum(c) FILTER (o_orderpriority < '3') AS BIGINT) AS act_c,
    CAST(sum(c) FILTER (o_orderstatus = 'O') AS BIGINT) AS che_c,
    CAST(sum(c - 24000000) FILTER (o_orderstatus <> 'P') AS BIGINT) AS ib_c,
    CAST(sum(c - 25000000) AS BIGINT) AS ni_c,
    CAST(sum(c - 26000000) FILTER (o_orderstatus = 'F') AS BIGINT) AS oancf_c,
    CAST(sum(ext_c) AS BIGINT) AS lt_c, CAST(sum(disc_c) AS BIGINT) AS lct_c, CAST(sum(tax_c) AS BIGINT) AS tax_c,
    CAST(sum(qty) AS BIGINT) AS qty,
    CAST(sum(coalesce(n_lines,0)) AS BIGINT) AS n_lines, CAST(sum(coalesce(n_ret,0)) AS BIGINT) AS n_ret,
    CAST(sum(coalesce(n_heavy,0)) AS BIGINT) AS n_heavy
  FROM (SELECT *, CAST(round(o_totalprice*100) AS BIGINT) AS c FROM orders) o
  LEFT JOIN lines ON o_orderkey = l_orderkey GROUP BY 1, 2),
panel AS (
  SELECT entity, fyear, n_orders, last_day(last_order) AS datadate, CAST(month(last_order) AS BIGINT) AS fyr,
    at_c/100.0::DOUBLE AS ta, lt_c/100.0::DOUBLE AS lt, act_c/100.0::DOUBLE AS act, lct_c/1000.0::DOUBLE AS lct,
    che_c/100.0::DOUBLE AS che, ib_c/100.0::DOUBLE AS ib, ni_c/100.0::DOUBLE AS ni, oancf_c/100.0::DOUBLE AS oancf,
    (at_c-lt_c)/100.0::DOUBLE AS ceq, tax_c/10000.0::DOUBLE AS tax, CAST(qty AS DOUBLE) AS me, n_lines, n_ret,
    CASE WHEN n_heavy > 0 THEN 1 ELSE 0 END AS label,
    CASE WHEN n_lines > 0 THEN last_day(last_order) + CAST(n_lines*15 AS INTEGER) END AS fdate,
    CAST(c_nationkey AS BIGINT)*400 AS sic, c_mktsegment AS segment
  FROM cell LEFT JOIN customer ON c_custkey = entity)"""
FEATURES_SQL = PANEL_SQL + f""",
features AS (
  SELECT entity, fyear, datadate, fdate, segment, sic, label,
    ni/nullif(ta,0) AS nita, lt/nullif(ta,0) AS tlta, (act-lct)/nullif(ta,0) AS wcta, lct/nullif(act,0) AS clca,
    che/nullif(ta,0) AS cashta, oancf/nullif(ta,0) AS ocf_ta, {SPLIT} AS split FROM panel)"""
FLONG_SQL = FEATURES_SQL + """,
flong AS (""" + " UNION ALL ".join(
    f"SELECT entity, fyear, split, segment, label, '{c}' AS feature, {c} AS value FROM features" for c in FEATURES
) + ")"
SCORED_SQL = PANEL_SQL + f""",
wide AS (
  SELECT entity, fyear, segment, {SPLIT} AS split, label AS y,
    floor(least(coalesce(n_ret/nullif(n_lines,0),0)*0.6::DOUBLE + n_lines/100.0::DOUBLE, 0.999::DOUBLE)*1000)/1000.0::DOUBLE AS alpha,
    floor(least(coalesce(lt/nullif(ta,0),0)*0.3::DOUBLE + coalesce(n_ret/nullif(n_lines,0),0)*0.4::DOUBLE, 0.999::DOUBLE)*1000)/1000.0::DOUBLE AS beta,
    floor(least(n_lines/(n_lines+20.0::DOUBLE), 0.999::DOUBLE)*1000)/1000.0::DOUBLE AS gamma
  FROM panel),
scored AS (
  SELECT entity, fyear, segment, split, y, 'alpha' AS model, alpha AS score FROM wide
  UNION ALL SELECT entity, fyear, segment, split, y, 'beta', beta FROM wide
  UNION ALL SELECT entity, fyear, segment, split, y, 'gamma', gamma FROM wide)"""
MONTHLY_SQL = """
mbase AS (
  SELECT l_suppkey AS id, last_day(CAST(l_shipdate AS DATE)) AS date,
    CAST(sum(CAST(round(l_extendedprice*100) AS BIGINT)) AS BIGINT) AS c, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS q
  FROM lineitem GROUP BY 1, 2),
mrow AS (
  SELECT id, date, CAST(year(date)*12+month(date) AS BIGINT) AS ym, c/100.0::DOUBLE AS me, (c/q)/100.0::DOUBLE AS prc FROM mbase),
monthly AS (
  SELECT *, me/lag(me) OVER (PARTITION BY id ORDER BY date) - 1 AS ret FROM mrow)"""
HISTORY_SQL = """
hday AS (
  SELECT o_custkey AS entity, CAST(o_orderdate AS DATE) AS start, max(o_orderkey) AS hkey,
    arg_max(o_orderpriority, o_orderkey) AS attr, arg_max(o_orderstatus, o_orderkey) AS kind
  FROM orders GROUP BY 1, 2),
history AS (
  SELECT entity, start, coalesce(lead(start) OVER (PARTITION BY entity ORDER BY start) - 1, DATE '2099-12-31') AS "end",
    hkey, attr, kind FROM hday),
links AS (
  SELECT entity, hkey AS target, CASE kind WHEN 'P' THEN 'P' WHEN 'O' THEN 'C' ELSE 'J' END AS prim,
    start AS lo, start + 400 AS hi FROM history)"""
EVENTS_SQL = """
anchors AS (SELECT event_id, user_id, ts, value FROM events WHERE event_type='purchase'),
outcomes AS (SELECT user_id, ts AS event_ts, event_id AS code, value AS severity FROM events WHERE event_type='error')"""
