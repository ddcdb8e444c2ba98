"""Whole data stages on the given tables."""

from dataclasses import replace

from pyspark.sql import functions as F

from tidemark.operators import assembly
from tidemark.plans import roles as R
from tidemark.plans.registry import Book
from tidemark.profile import CORRECTED
from tidemark.sources.tables import table

BOOK = Book()
PROFILE = replace(CORRECTED, train_end=1998, val_end=1999, excluded_codes=((6000, 6999), (4800, 4999)))
CHAIN = R.PANEL_SQL + ", " + R.HISTORY_SQL + """,
s1 AS (SELECT * FROM panel WHERE NOT coalesce(sic BETWEEN 6000 AND 6999,false) AND NOT coalesce(sic BETWEEN 4800 AND 4999,false) AND ta>0 AND fdate-datadate<=180),
lk AS (SELECT entity, fyear, target FROM (SELECT p.entity, p.fyear, l.target, row_number() OVER (PARTITION BY p.entity, p.fyear ORDER BY CASE l.prim WHEN 'P' THEN 0 ELSE 1 END, l.lo, l.target) AS rn
  FROM s1 p JOIN links l ON l.entity=p.entity AND l.lo<=p.datadate AND p.datadate<=l.hi WHERE l.prim IN ('P','C')) WHERE rn=1),
s2 AS (SELECT s1.*, target FROM s1 JOIN lk USING (entity, fyear) WHERE EXISTS (SELECT 1 FROM history h WHERE h.entity=s1.entity AND h.attr<>'5-LOW' AND h.start<=s1.datadate AND s1.datadate<=h."end")),
sn AS (SELECT o_custkey AS entity, last_day(CAST(o_orderdate AS DATE)) AS month, arg_max(CAST(round(o_totalprice*100) AS BIGINT), (o_orderdate, o_orderkey)) AS cap FROM orders GROUP BY 1,2),
s3 AS (SELECT s2.*, sn.cap FROM s2 JOIN sn ON sn.entity=s2.entity AND sn.month=s2.datadate WHERE cap>0),
ev AS (SELECT entity, start AS event_date FROM history WHERE kind='F'),
pk AS (SELECT entity, fyear, min(event_date) AS event_date FROM (SELECT p.entity, p.fyear, e.event_date, row_number() OVER (PARTITION BY e.entity, e.event_date ORDER BY p.fdate DESC, p.fyear DESC) AS rn
  FROM ev e JOIN s3 p ON p.entity=e.entity AND e.event_date BETWEEN p.fdate AND p.fdate+365) WHERE rn=1 GROUP BY 1,2),
s4 AS (SELECT s3.* EXCLUDE (label), pk.event_date, CAST(pk.event_date IS NOT NULL AS INT) AS label FROM s3 LEFT JOIN pk USING (entity, fyear)),
ok AS (SELECT DISTINCT entity FROM (SELECT entity, fyear-row_number() OVER (PARTITION BY entity ORDER BY fyear) AS i FROM s4) GROUP BY entity, i HAVING count(*)>=2),
built AS (SELECT * FROM s4 WHERE entity IN (SELECT entity FROM ok))"""


def built(spark, d):
    snap = table(spark, d, "orders").groupBy(
        F.col("o_custkey").alias("entity"), F.last_day(F.to_date("o_orderdate")).alias("month")
    ).agg(F.max_by(R.cents("o_totalprice"), F.struct("o_orderdate", "o_orderkey")).alias("cap"))
    h = R.history(spark, d)
    events = h.where("kind = 'F'").select("entity", F.col("start").alias("event_date"))
    names = h.select("entity", "start", "end", "attr")
    panel = R.panel(spark, d).drop("label")
    return assembly.build_panel(panel, R.links(spark, d), names, snap, events, F.col("attr") != "5-LOW", PROFILE)


@BOOK.query("WITH " + CHAIN + " SELECT entity, fyear, target, cap, label, event_date FROM built")
def q_panel_build(spark, d):
    return built(spark, d).select("entity", "fyear", "target", "cap", "label", "event_date")


NAMES = ["nita", "tlta", "wcta", "clca", "oeneg", "nita_lag", "chin", "intwo", "cashta", "ocf_ta", "lnta"]
FEAT = CHAIN + """,
b1 AS (SELECT b.*, q.ib AS ib_lag, q.ni/nullif(q.ta,0) AS nita_lag, CASE WHEN b.fyear<=1998 THEN 'train' WHEN b.fyear<=1999 THEN 'val' ELSE 'test' END AS split FROM built b LEFT JOIN built q ON q.entity=b.entity AND q.fyear=b.fyear-1),
b2 AS (SELECT entity, fyear, segment, split, fdate, ni/nullif(ta,0) AS nita, lt/nullif(ta,0) AS tlta, (act-lct)/nullif(ta,0) AS wcta, lct/nullif(act,0) AS clca, CAST(CAST(lt>ta AS INT) AS DOUBLE) AS oeneg, nita_lag,
  (ib-ib_lag)/nullif(abs(ib)+abs(ib_lag),0) AS chin, CASE WHEN ib IS NOT NULL AND ib_lag IS NOT NULL THEN CAST(CAST(ib<0 AND ib_lag<0 AS INT) AS DOUBLE) END AS intwo, che/nullif(ta,0) AS cashta, oancf/nullif(ta,0) AS ocf_ta, ln(CASE WHEN ta>0 THEN ta END) AS lnta FROM b1),
lim AS (SELECT min(fdate) FILTER (split='val') AS v, min(fdate) FILTER (split='test') AS t FROM b2),
b3 AS (SELECT b2.* FROM b2, lim WHERE split='test' OR (split='train' AND fdate+365<v) OR (split='val' AND fdate+365<t)),
ml AS (""" + " UNION ALL ".join(
    f"SELECT entity, fyear, segment, split, '{c}' AS feature, {c} AS value, " + "+".join(f"CAST({k} IS NOT NULL AS INT)" for k in NAMES) + " AS k FROM b3" for c in NAMES) + """),
bd AS (SELECT feature, quantile_cont(value,0.01) AS lo, quantile_cont(value,0.99) AS hi FROM ml WHERE split='train' GROUP BY 1),
cl AS (SELECT ml.* EXCLUDE (value), CASE WHEN value IS NOT NULL THEN greatest(lo,least(hi,value)) END AS value FROM ml JOIN bd USING (feature) WHERE k>=7),
tr AS (SELECT * FROM cl WHERE split='train'), l1 AS (SELECT feature, segment, fyear, median(value) AS m FROM tr GROUP BY 1,2,3 HAVING count(value)>=5),
l2 AS (SELECT feature, segment, median(m) AS m FROM l1 GROUP BY 1,2), l3 AS (SELECT feature, fyear, median(value) AS m FROM tr GROUP BY 1,2), l4 AS (SELECT feature, median(value) AS m FROM tr GROUP BY 1),
j AS (SELECT c.*, coalesce(c.value,l1.m,l2.m,l3.m,l4.m) AS v FROM cl c LEFT JOIN l1 ON l1.feature=c.feature AND l1.segment=c.segment AND l1.fyear=c.fyear
 LEFT JOIN l2 ON l2.feature=c.feature AND l2.segment=c.segment LEFT JOIN l3 ON l3.feature=c.feature AND l3.fyear=c.fyear LEFT JOIN l4 ON l4.feature=c.feature)"""


@BOOK.query("WITH " + FEAT + """ SELECT split, feature, count(*) AS n, count(*) FILTER (value IS NULL AND v IS NOT NULL) AS n_filled,
 round(avg(CASE WHEN feature IN ('oeneg','intwo') THEN CAST(CAST(v>0.5 AS INT) AS DOUBLE) ELSE v END),6) AS mean FROM j GROUP BY 1,2""")
def q_feature_build(spark, d):
    out = assembly.build_features(built(spark, d), "segment", PROFILE, min_coverage=7)
    return out.groupBy("split", "feature").agg(
        F.count("*").alias("n"), F.count_if(F.col("level").between(1, 4)).alias("n_filled"), F.round(F.avg("value"), 6).alias("mean")
    )
