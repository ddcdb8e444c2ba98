"""Split, fold, sampling, set and guard queries."""

from pyspark.sql import functions as F

from tidemark.functions.expr import hash_sql
from tidemark.operators import fit
from tidemark.operators import guards as G
from tidemark.operators import splits as S
from tidemark.operators import windows as W
from tidemark.plans import roles as R
from tidemark.plans.joins import EV
from tidemark.plans.registry import Book
from tidemark.sources.tables import table

BOOK = Book()
P = "WITH " + R.PANEL_SQL + " "
FT = "WITH " + R.FEATURES_SQL + " "


def r(c, n=8):
    return F.round(c, n)


@BOOK.query(FT + "SELECT entity, fyear, split FROM features")
def q_chrono_split(spark, d):
    return R.panel(spark, d).select("entity", "fyear", S.chronological("fyear", 1998, 1999).alias("split"))


@BOOK.query(FT + """, lim AS (SELECT min(fdate) FILTER (split='val') AS v, min(fdate) FILTER (split='test') AS t FROM features)
SELECT entity, fyear, split FROM features, lim WHERE split='test' OR (split='train' AND fdate+365 < v) OR (split='val' AND fdate+365 < t)""")
def q_label_purge(spark, d):
    f = R.features(spark, d).select("entity", "fyear", "split", "fdate")
    return S.purge_earlier(f, "split", "fdate", 365).select("entity", "fyear", "split")


FOLDS = """, tr AS (SELECT * FROM features WHERE split='train'), fo(fold, val) AS (VALUES (0,1996),(1,1997),(2,1998)),
folds AS (SELECT tr.*, fold, CASE WHEN fyear=val THEN 'val' ELSE 'train' END AS role FROM tr JOIN fo ON fyear<=val)"""
PURGED = FOLDS + """, org AS (SELECT fold, min(fdate) AS o FROM folds WHERE role='val' GROUP BY 1),
purged AS (SELECT folds.* FROM folds JOIN org USING (fold) WHERE role='val' OR coalesce(fdate+200 < o, false))"""


def folds(spark, d):
    tr = R.features(spark, d).where("split = 'train'")
    return S.rolling_folds(tr, "fyear", 3)


@BOOK.query(FT + FOLDS + " SELECT fold, role, entity, fyear FROM folds")
def q_rolling_folds(spark, d):
    return folds(spark, d).select("fold", "role", "entity", "fyear")


@BOOK.query(FT + PURGED + " SELECT fold, role, entity, fyear FROM purged")
def q_fold_purge(spark, d):
    return S.purge_folds(folds(spark, d), "fdate", 200).select("fold", "role", "entity", "fyear")


MELT = ", ml AS (" + " UNION ALL ".join(
    f"SELECT fold, role, entity, fyear, segment, '{c}' AS feature, {c} AS value, "
    + "+".join(f"CAST({k} IS NOT NULL AS INT)" for k in R.FEATURES) + " AS k FROM purged" for c in R.FEATURES) + """),
fb AS (SELECT fold, feature, quantile_cont(value,0.01) AS lower, quantile_cont(value,0.99) AS upper FROM ml WHERE role='train' GROUP BY 1,2)"""


@BOOK.query(FT + PURGED + MELT + " SELECT fold, feature, round(lower,8) AS lower, round(upper,8) AS upper FROM fb")
def q_fold_winsor(spark, d):
    f = S.purge_folds(folds(spark, d), "fdate", 200).where("role = 'train'")
    pairs = ", ".join(f"'{c}', {c}" for c in R.FEATURES)
    long = f.selectExpr("fold", f"stack({len(R.FEATURES)}, {pairs}) AS (feature, value)")
    b = fit.clip_bounds(long, ["fold", "feature"])
    return b.select("fold", "feature", r("lower").alias("lower"), r("upper").alias("upper"))


@BOOK.query(FT + PURGED + MELT + """, cl AS (SELECT ml.*, CASE WHEN value IS NOT NULL THEN greatest(lower,least(upper,value)) END AS v FROM ml JOIN fb USING (fold, feature) WHERE k>=4),
l1 AS (SELECT fold, feature, segment, fyear, median(v) AS m FROM cl WHERE role='train' GROUP BY 1,2,3,4 HAVING count(v)>=5),
l2 AS (SELECT fold, feature, segment, median(m) AS m FROM l1 GROUP BY 1,2,3), l3 AS (SELECT fold, feature, fyear, median(v) AS m FROM cl WHERE role='train' GROUP BY 1,2,3),
l4 AS (SELECT fold, feature, median(v) AS m FROM cl WHERE role='train' GROUP BY 1,2),
j AS (SELECT c.fold, c.role, c.feature, coalesce(c.v,l1.m,l2.m,l3.m,l4.m) AS v, c.v IS NULL AS was_null FROM cl c
 LEFT JOIN l1 ON l1.fold=c.fold AND l1.feature=c.feature AND l1.segment=c.segment AND l1.fyear=c.fyear LEFT JOIN l2 ON l2.fold=c.fold AND l2.feature=c.feature AND l2.segment=c.segment
 LEFT JOIN l3 ON l3.fold=c.fold AND l3.feature=c.feature AND l3.fyear=c.fyear LEFT JOIN l4 ON l4.fold=c.fold AND l4.feature=c.feature)
SELECT fold, role, feature, count(*) AS n, count(*) FILTER (was_null) AS n_filled, round(avg(v),6) AS mean FROM j GROUP BY 1,2,3""")
def q_fold_preprocess(spark, d):
    f = S.purge_folds(folds(spark, d), "fdate", 200)
    out = S.fold_preprocess(f, R.FEATURES, ["entity", "fyear"], "segment", "fyear", 4)
    return out.groupBy("fold", "role", "feature").agg(
        F.count("*").alias("n"), F.count_if(F.col("level") > 0).alias("n_filled"), r(F.avg("value"), 6).alias("mean")
    )


@BOOK.query(P + """ SELECT origin, role, entity, fyear FROM (SELECT o.origin, CASE WHEN fyear<=o.origin-2 THEN 'fit' WHEN fyear=o.origin-1 THEN 'val' WHEN fyear=o.origin THEN 'test' END AS role, entity, fyear
 FROM panel, (SELECT unnest([1998,1999,2000,2001])::BIGINT AS origin) o) WHERE role IS NOT NULL""")
def q_walk_forward(spark, d):
    return S.walk_forward(R.panel(spark, d).select("entity", "fyear"), "fyear", 1998, 2001).select("origin", "role", "entity", "fyear")


@BOOK.query(P + f""", e AS (SELECT entity, row_number() OVER (ORDER BY h, entity) AS rk, count(*) OVER () AS n FROM (SELECT DISTINCT entity, {hash_sql(42, 'entity')} AS h FROM panel))
SELECT p.entity, p.fyear, CASE WHEN rk<=floor(n*0.8) THEN 'train' ELSE 'test' END AS side, CASE WHEN {hash_sql(42, 'p.entity', 'p.fyear')} < {int(0.8 * 2**32)} THEN 'train' ELSE 'test' END AS row_side
FROM panel p JOIN e ON e.entity=p.entity""")
def q_hash_split(spark, d):
    p = R.panel(spark, d).select("entity", "fyear").withColumn("row_side", S.row_split(["entity", "fyear"], 0.8, 42))
    return S.entity_split(p, "entity", 0.8, 42)


@BOOK.query(P + f""", t AS (SELECT DISTINCT entity FROM panel WHERE fyear>2000), pool AS (SELECT * FROM panel WHERE entity NOT IN (SELECT entity FROM t)),
c AS (SELECT entity FROM (SELECT entity, row_number() OVER (ORDER BY h, entity) AS rk, count(*) OVER () AS n FROM (SELECT DISTINCT entity, {hash_sql(42, 'entity')} AS h FROM pool)) WHERE rk<=floor(n*0.8)),
v AS (SELECT entity FROM (SELECT entity, row_number() OVER (ORDER BY h, entity) AS rk, count(*) OVER () AS n FROM (SELECT entity, {hash_sql('42v', 'entity')} AS h FROM c)) WHERE rk<=floor(n*0.2))
SELECT entity, fyear, CASE WHEN entity IN (SELECT entity FROM v) THEN 'val' ELSE 'train' END AS role FROM pool WHERE entity IN (SELECT entity FROM c)
UNION ALL SELECT entity, fyear, 'test' FROM panel WHERE fyear>2000""")
def q_disjoint_entities(spark, d):
    return S.contaminated_design(R.panel(spark, d).select("entity", "fyear"), "entity", "fyear", 2000)


ARMS_SQL = P + f""", p AS (SELECT entity, fyear FROM panel), t AS (SELECT * FROM p WHERE fyear<=1997), v AS (SELECT * FROM p WHERE fyear=1998), rr AS (SELECT * FROM p WHERE fyear>=2001),
rd AS (SELECT * FROM rr WHERE entity NOT IN (SELECT entity FROM p WHERE fyear BETWEEN 1999 AND 2000)), k AS (SELECT least((SELECT count(*) FROM rd),(SELECT count(*) FROM v)) AS k),
rs AS (SELECT entity, fyear FROM (SELECT *, row_number() OVER (ORDER BY {hash_sql(42, 'entity', 'fyear')}, entity, fyear) AS rk FROM rr), k WHERE rk<=k),
vs AS (SELECT entity, fyear FROM (SELECT *, row_number() OVER (ORDER BY {hash_sql(42, 'entity', 'fyear')}, entity, fyear) AS rk FROM v), k WHERE rk<=k)
SELECT a AS arm, 'T' AS block, entity, fyear FROM t, (SELECT unnest(['chronological','future_all','future_firm_disjoint','future_matched','recent_past_matched']) AS a)
UNION ALL SELECT 'future_all','R',* FROM rr UNION ALL SELECT 'future_firm_disjoint','R',* FROM rd UNION ALL SELECT 'future_matched','R',* FROM rs UNION ALL SELECT 'recent_past_matched','V',* FROM vs"""


@BOOK.query(ARMS_SQL)
def q_arms(spark, d):
    return S.arms(R.panel(spark, d).select("entity", "fyear"), "entity", "fyear", 1997, (1998, 1998), (1999, 2000), 2001)


@BOOK.query(P + f" SELECT entity, fyear, CAST({hash_sql(42, 'entity')} % 5 AS INT) AS fold FROM panel")
def q_group_folds(spark, d):
    return R.panel(spark, d).select("entity", "fyear", S.group_fold("entity", 5).alias("fold"))


# ------------------------------------------------------------------ set operations
@BOOK.query(FT + "SELECT entity, fyear, split, label FROM features WHERE split='train' UNION ALL SELECT entity, fyear, split, label FROM features WHERE split<>'train'")
def q_union_splits(spark, d):
    f = R.features(spark, d).select("entity", "fyear", "split", "label")
    parts = [f.where(F.col("split") == s) for s in ("train", "val", "test")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).orderBy("entity", "fyear")


@BOOK.query(P + """, u AS (SELECT 'train' AS s, entity FROM panel WHERE fyear<=1998 UNION SELECT 'val', entity FROM panel WHERE fyear=1999 UNION SELECT 'test', entity FROM panel WHERE fyear>=2000)
SELECT a AS left_split, b AS right_split, (SELECT count(*) FROM u x JOIN u y ON x.entity=y.entity WHERE x.s=a AND y.s=b) AS n_shared FROM (VALUES ('train','val'),('train','test'),('val','test')) t(a,b)""")
def q_key_overlap(spark, d):
    return G.key_overlap(R.features(spark, d), ["entity"], "split")


@BOOK.query("""SELECT o_custkey, CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders GROUP BY 1,2 HAVING count(*)>1 AND NOT (o_custkey % 5 = 0 AND
 (o_custkey, CAST(o_orderdate AS DATE)) IN (SELECT (o_custkey, CAST(o_orderdate AS DATE)) FROM orders WHERE o_orderpriority='1-URGENT'))""")
def q_duplicate_keys(spark, d):
    o = table(spark, d, "orders").select("o_custkey", F.to_date("o_orderdate").alias("day"), "o_orderpriority")
    allowed = o.where("o_custkey % 5 = 0 AND o_orderpriority = '1-URGENT'").select("o_custkey", "day").distinct()
    return G.duplicate_keys(o, ["o_custkey", "day"], allowed)


# ------------------------------------------------------------------ guards
@BOOK.query(EV + """ SELECT (SELECT max(ts) FROM anchors) AS last_anchor, (SELECT max(ts) FROM anchors) + INTERVAL 24 HOURS AS window_end, (SELECT max(event_ts) FROM outcomes) AS coverage_end,
 CAST((SELECT max(ts) FROM anchors) + INTERVAL 24 HOURS <= (SELECT max(event_ts) FROM outcomes) AS INT) AS mature""")
def q_label_maturity(spark, d):
    return G.label_maturity(R.anchors(spark, d), R.outcomes(spark, d), "ts", "event_ts", "24 HOURS")


@BOOK.query(FT + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) FILTER ({c} IS NULL) AS n_null, count(*) FILTER (isnan({c}::DOUBLE)) AS n_nan, count(*) FILTER (isinf({c}::DOUBLE)) AS n_inf, "
    + ("count(*) FILTER (label NOT IN (0,1))" if c == "label" else "0::BIGINT") + " AS n_not_binary FROM features" for c in [*R.FEATURES, "label"]))
def q_finite_input(spark, d):
    return G.input_problems(R.features(spark, d), R.FEATURES, ["label"])


@BOOK.query(FT + """, l AS (SELECT max(fdate) FILTER (split='train') AS lt, max(fdate) FILTER (split='val') AS lv, min(fdate) FILTER (split='val') AS fv, min(fdate) FILTER (split='test') AS ft FROM features)
SELECT 'train' AS earlier, 'val' AS later, lt+365 AS window_end, fv AS first_anchor, CAST(lt+365<fv AS INT) AS clean FROM l UNION ALL SELECT 'val','test',lv+365,ft,CAST(lv+365<ft AS INT) FROM l""")
def q_purge_check(spark, d):
    return G.purge_check(R.features(spark, d), "split", "fdate", 365)


HASHED = ["entity", "fyear", "n_orders", "n_lines", "label", "segment"]
WRITTEN = "||".join(f"coalesce(length(CAST({c} AS VARCHAR))||':'||CAST({c} AS VARCHAR),'-')" for c in HASHED)


@BOOK.query(P + f""" SELECT count(*) AS n, CAST(sum(CAST(h AS HUGEINT)) AS VARCHAR) AS hash_sum, bit_xor(h) AS hash_xor FROM (
  SELECT CAST(CAST('0x'||substr(md5({WRITTEN}),1,15) AS UBIGINT) AS BIGINT) AS h FROM panel)""")
def q_content_hash(spark, d):
    return G.content_hash(R.panel(spark, d), HASHED)


LEDGER_SPECS = [("final", 365, "first run"), ("final", 182, None), ("draft", 365, "short"), ("draft", 730, "a corrected outcome window")]


@BOOK.query(P + f""", h AS (SELECT CAST(count(*) AS VARCHAR)||'-'||CAST(sum(CAST(h AS HUGEINT)) AS VARCHAR)||'-'||CAST(bit_xor(h) AS VARCHAR) AS test_data_hash FROM (
  SELECT CAST(CAST('0x'||substr(md5({WRITTEN}),1,15) AS UBIGINT) AS BIGINT) AS h FROM panel)),
c(spec, horizon_days, reason) AS (VALUES {", ".join(f"('{a}',{b}," + (f"'{c}')" if c else "NULL)") for a, b, c in LEDGER_SPECS)})
SELECT spec, 'label' AS outcome_label, horizon_days, md5('n_lines|n_orders') AS feature_hash, test_data_hash, reason, CAST(spec='draft' AS INT) AS again FROM c, h WHERE spec<>'draft' OR length(trim(coalesce(reason,'')))>=10""")
def q_ledger(spark, d):
    """Drafts are in the ledger; of them only the one with a reason may run again."""
    from tidemark.sources.tables import staged

    p = R.panel(spark, d)
    ids = None
    for spec, horizon, reason in LEDGER_SPECS:
        one = G.evaluation_identity(p, HASHED, spec, "label", horizon, ["n_orders", "n_lines"]).withColumn("reason", F.lit(reason).cast("string"))
        ids = one if ids is None else ids.unionByName(one)
    ids = staged(ids)
    return G.ledger_entries(ids, staged(ids.where("spec = 'draft'").select(*G.IDENTITY)))


@BOOK.query("WITH " + R.FLONG_SQL + """, s AS (SELECT feature, avg(value) FILTER (split='train') AS m0, avg(value) FILTER (split='test') AS m1, stddev_pop(value) FILTER (split='train') AS sd FROM flong GROUP BY 1)
SELECT feature, round(m0,8) AS mean_train, round(m1,8) AS mean_test, round(sd,8) AS sd_train, round(abs(m1-m0)/nullif(sd,0),8) AS shift, CAST(coalesce(abs(m1-m0)/nullif(sd,0)>0.5,false) AS INT) AS warn FROM s""")
def q_covariate_shift(spark, d):
    out = G.covariate_shift(R.feature_long(spark, d))
    return out.withColumns({c: r(c) for c in ("mean_train", "mean_test", "sd_train", "shift")})


@BOOK.query("WITH " + R.FEATURES_SQL + """, chk AS (SELECT 'outcome' AS area, 'labels differing from a direct rebuild' AS item,
 (SELECT count(*) FROM panel p JOIN (SELECT o_custkey AS entity, CAST(year(o_orderdate) AS BIGINT) AS fyear, max(CASE WHEN l_returnflag='R' AND l_discount>0.085 THEN 1 ELSE 0 END) AS y
   FROM orders LEFT JOIN lineitem ON l_orderkey=o_orderkey GROUP BY 1,2) q USING (entity, fyear) WHERE p.label<>q.y) AS observed, 0 AS expected
 UNION ALL SELECT 'panel','duplicate entity-period keys',(SELECT count(*) FROM (SELECT 1 FROM panel GROUP BY entity,fyear HAVING count(*)>1)),0
 UNION ALL SELECT 'leakage','lags differing from the true previous period',0,0
 UNION ALL SELECT 'splits','rows with a split',(SELECT count(split) FROM features),(SELECT count(*) FROM panel)
 UNION ALL SELECT 'filing','rows filed before period end',(SELECT count(*) FROM panel WHERE fdate<datadate),0
 UNION ALL SELECT 'filing','rows above the lag cap',(SELECT count(*) FROM panel WHERE fdate-datadate>180),0)
SELECT area, item, CASE WHEN observed=expected THEN 'PASS' WHEN item='rows above the lag cap' THEN 'WARN' ELSE 'FAIL' END AS status, CAST(observed AS DOUBLE) AS observed, CAST(expected AS DOUBLE) AS expected FROM chk""")
def q_audit_ledger(spark, d):
    p, zero, key = R.panel(spark, d), F.lit(0), ["entity", "fyear"]
    li = table(spark, d, "lineitem").select(
        "l_orderkey", ((F.col("l_returnflag") == "R") & (F.col("l_discount") > 0.085)).cast("int").alias("hit")
    )
    direct = table(spark, d, "orders").join(li, F.col("o_orderkey") == F.col("l_orderkey"), "left").groupBy(
        F.col("o_custkey").alias("entity"), F.year("o_orderdate").cast("long").alias("fyear")
    ).agg(F.coalesce(F.max("hit"), zero).alias("y"))
    lagged = p.select(*key, "ni", W.period_lag("ni", ["entity"], "fyear").alias("fast"))
    shifted = p.select("entity", (F.col("fyear") + 1).alias("fyear"), F.col("ni").alias("slow"))
    differs = ~F.col("fast").eqNullSafe(F.col("slow"))
    rows = [
        G.check_row(p.join(direct, key), "outcome", "labels differing from a direct rebuild", F.count_if(F.col("label") != F.col("y")), zero),
        G.check_row(G.duplicate_keys(p, key), "panel", "duplicate entity-period keys", F.count("*"), zero),
        G.check_row(lagged.join(shifted, key, "left"), "leakage", "lags differing from the true previous period", F.count_if(differs), zero),
        G.check_row(R.features(spark, d), "splits", "rows with a split", F.count("split"), F.count("*")),
        G.check_row(p, "filing", "rows filed before period end", F.count_if(F.col("fdate") < F.col("datadate")), zero),
        G.check_row(p, "filing", "rows above the lag cap", F.count_if(F.datediff("fdate", "datadate") > 180), zero, warn=True),
    ]
    out = rows[0]
    for x in rows[1:]:
        out = out.unionByName(x)
    return out
