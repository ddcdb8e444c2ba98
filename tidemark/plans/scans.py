"""Scans, extracts and fitted-state queries."""

from pyspark.sql import functions as F

from tidemark.functions.expr import first_code
from tidemark.operators import fit, pit
from tidemark.plans import roles as R
from tidemark.plans.registry import Book
from tidemark.sources.tables import rebase, resolve_columns, table

BOOK = Book()


@BOOK.query("SELECT o_orderkey AS row_id, o_custkey AS entity, o_totalprice AS amount FROM orders")
def q_scan_projection(spark, d):
    wanted = {"row_id": ["order_id", "o_orderkey"], "entity": ["cust_pit", "o_custkey"], "amount": ["o_totalprice"]}
    return resolve_columns(table(spark, d, "orders"), wanted)


@BOOK.query("""
WITH annual AS (
  SELECT CAST(year(o_orderdate) AS BIGINT) AS year,
    CAST(sum(CAST(round(o_totalprice*100) AS BIGINT)) AS DOUBLE)/count(*)/100.0::DOUBLE AS level FROM orders GROUP BY 1)
SELECT year, round(level/(SELECT level FROM annual WHERE year=1998), 8) AS deflator FROM annual""")
def q_index_rebase(spark, d):
    obs = table(spark, d, "orders").groupBy(F.year("o_orderdate").cast("long").alias("year")).agg(
        (F.sum(R.cents("o_totalprice")).cast("double") / F.count("*") / 100.0).alias("level")
    )
    return rebase(obs, 1998).select("year", F.round("deflator", 8).alias("deflator"))


@BOOK.query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem
WHERE l_extendedprice > 0 AND l_shipdate BETWEEN TIMESTAMP '1998-01-01' AND TIMESTAMP '1999-12-31'
  AND l_returnflag IN ('R','A')""")
def q_filter_pushdown(spark, d):
    ship = F.col("l_shipdate")
    return table(spark, d, "lineitem").where(
        (F.col("l_extendedprice") > 0)
        & (ship >= F.expr("TIMESTAMP_NTZ'1998-01-01 00:00:00'"))
        & (ship <= F.expr("TIMESTAMP_NTZ'1999-12-31 00:00:00'"))
        & F.col("l_returnflag").isin("R", "A")
    ).select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")


@BOOK.query("WITH " + R.PANEL_SQL + """
SELECT entity, datadate, coalesce(fdate, datadate + 90) AS fdate,
  CASE WHEN fdate IS NULL THEN 'fallback_90d' ELSE 'actual' END AS fdate_source FROM panel""")
def q_fallback_date(spark, d):
    p = R.panel(spark, d).select("entity", "datadate", "fdate").dropDuplicates(["entity", "datadate"])
    return p.select(
        "entity", "datadate",
        F.coalesce("fdate", F.date_add("datadate", 90)).alias("fdate"),
        F.when(F.col("fdate").isNull(), "fallback_90d").otherwise("actual").alias("fdate_source"),
    )


@BOOK.query("WITH " + R.HISTORY_SQL + """,
m AS (SELECT o_custkey AS entity, last_day(CAST(o_orderdate AS DATE)) AS date,
   CAST(sum(CAST(round(o_totalprice*100) AS BIGINT)) AS BIGINT) AS cents FROM orders GROUP BY 1,2)
SELECT m.entity, m.date, m.cents, h.attr FROM m LEFT JOIN history h
  ON h.entity=m.entity AND h.start<=m.date AND m.date<=h."end" WHERE h.attr IN ('1-URGENT','2-HIGH')""")
def q_interval_join(spark, d):
    month = table(spark, d, "orders").groupBy(
        F.col("o_custkey").alias("entity"), F.last_day(F.to_date("o_orderdate")).alias("date")
    ).agg(F.sum(R.cents("o_totalprice")).alias("cents"))
    names = R.history(spark, d).select("entity", "start", "end", "attr")
    out = pit.valid_at(month, names, ["entity"], "date", "start", "end", "left", disjoint=True)
    return out.where(F.col("attr").isin("1-URGENT", "2-HIGH")).select("entity", "date", "cents", "attr")


@BOOK.query("WITH " + R.HISTORY_SQL + """
SELECT entity, start AS lo, "end" AS hi, kind FROM history WHERE kind IN ('P','O')""")
def q_interval_sentinel(spark, d):
    raw = R.history(spark, d).withColumn("end", F.nullif("end", F.lit(pit.OPEN_END).cast("date")))
    return pit.close_open_ends(raw, "end").where(F.col("kind").isin("P", "O")).select(
        "entity", F.col("start").alias("lo"), F.col("end").alias("hi"), "kind"
    )


@BOOK.query("WITH " + R.FLONG_SQL + """
SELECT feature, round(quantile_cont(value,0.01),8) AS lower, round(quantile_cont(value,0.99),8) AS upper
FROM flong WHERE split='train' GROUP BY 1""")
def q_winsor_fit(spark, d):
    train = R.feature_long(spark, d).where("split = 'train'")
    return fit.clip_bounds(train).select("feature", F.round("lower", 8).alias("lower"), F.round("upper", 8).alias("upper"))


@BOOK.query("""
WITH dict(flag, code, text) AS (VALUES ('ReturnFlag',' R ','Returned'),('ReturnFlag','A ','Accepted'),('ReturnFlag','N','None'),
  ('LineStatus','O','Open'),('LineStatus','F','Filled')),
c AS (SELECT l_returnflag AS action, l_linestatus AS reason, count(*) AS n FROM lineitem GROUP BY 1,2)
SELECT action, reason, n, a.text AS action_text, r.text AS reason_text,
  concat_ws('+', CASE WHEN action='R' THEN 'returned' END, CASE WHEN reason='F' THEN 'closed' END,
    CASE WHEN action='R' AND reason='O' THEN 'pending' END) AS label
FROM c LEFT JOIN (SELECT trim(code) AS code, text FROM dict WHERE flag='ReturnFlag') a ON a.code=action
LEFT JOIN (SELECT trim(code) AS code, text FROM dict WHERE flag='LineStatus') r ON r.code=reason""")
def q_dictionary_label(spark, d):
    raw = spark.createDataFrame(
        [("ReturnFlag", " R ", "Returned"), ("ReturnFlag", "A ", "Accepted"), ("ReturnFlag", "N", "None"),
         ("LineStatus", "O", "Open"), ("LineStatus", "F", "Filled")],
        "flag_type string, flag_value string, flag_text string",
    )
    named = resolve_columns(raw, {"flag": ["flag_type"], "code": ["flag_value"], "text": ["flag_text"]})
    meaning = lambda kind, key, text: F.broadcast(
        named.where(F.col("flag") == kind).select(F.trim("code").alias(key), F.col("text").alias(text))
    )
    counts = table(spark, d, "lineitem").groupBy(
        F.col("l_returnflag").alias("action"), F.col("l_linestatus").alias("reason")
    ).agg(F.count("*").alias("n"))
    a, r = F.col("action"), F.col("reason")
    return counts.join(meaning("ReturnFlag", "action", "action_text"), "action", "left").join(
        meaning("LineStatus", "reason", "reason_text"), "reason", "left"
    ).withColumn(
        "label",
        F.concat_ws("+", F.when(a == "R", "returned"), F.when(r == "F", "closed"), F.when((a == "R") & (r == "O"), "pending")),
    )


@BOOK.query("WITH " + R.PANEL_SQL + """
SELECT entity, fyear, coalesce(CASE WHEN fyear % 2 = 0 THEN nullif(sic,0) END, nullif(sic,0), nullif(CAST(fyr AS BIGINT),0)) AS code,
  TRY_CAST(CASE WHEN segment='BUILDING' THEN 'n/a' ELSE CAST(n_orders AS VARCHAR) END AS DOUBLE) AS parsed FROM panel""")
def q_coalesce_chain(spark, d):
    from tidemark.functions.expr import number

    p = R.panel(spark, d).withColumn("sic_hist", F.when(F.col("fyear") % 2 == 0, F.col("sic")))
    text = F.when(F.col("segment") == "BUILDING", "n/a").otherwise(F.col("n_orders").cast("string"))
    return p.select("entity", "fyear", first_code("sic_hist", "sic", "fyr").alias("code"), number(text).alias("parsed"))
