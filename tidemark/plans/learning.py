"""Model fitting queries (MLlib, so mostly without an SQL twin)."""

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tidemark import CORRECTED
from tidemark.functions.expr import unit_hash
from tidemark.operators import attribution as N
from tidemark.operators import experiments as X
from tidemark.operators import guards as G
from tidemark.operators import learn as L
from tidemark.operators import metrics as M
from tidemark.operators import splits as S
from tidemark.operators import trees as T
from tidemark.operators.inference import multiplicities
from tidemark.operators.neighbours import nearest, synthetic_minority
from tidemark.operators.ranks import dense_index
from tidemark.operators.reporting import advantage_table
from tidemark.plans import roles as R
from tidemark.plans.registry import Book
from tidemark.plans.scoring import PLATT, SC
from tidemark.plans.timeplits import ARMS_SQL
from tidemark.sources.tables import staged, use_checkpoint_dir

BOOK = Book()
KEYS = ["entity", "fyear"]
REPS = CORRECTED.reps
#: The four learners at their full sizes (the operators' defaults).
LEARNERS = {
    "logistic": L.fit_logistic,
    "forest": L.fit_forest,
    "boosted": L.fit_boosted,
    "network": lambda t, f, y="y", **k: L.fit_network(t, f, KEYS, y, **k),
}
#: The panel's training rows have four periods, so there are three rolling folds.
FOLDS, REFITS = 3, 25
C_GRID = [{"c": 10.0**e} for e in (-4, -3, -2, -1.5, -1, -0.5, 0, 1, 2, 3)]


def r(c, n=6):
    return F.round(c, n)


def raw_frame(spark, d):
    return R.features(spark, d).select(*KEYS, "split", "fdate", "segment", "sic", F.col("label").alias("y"), *R.FEATURES)


def prepared(df, train=None):
    """``df`` with inputs clipped and filled by what its own training rows say."""
    return L.prepare(df, L.fit_inputs(df.where("split = 'train'" if train is None else train), R.FEATURES))


def frame(spark, d):
    return prepared(staged(raw_frame(spark, d)))


def fit_and_evaluate(spark, d, name, fit):
    df = staged(frame(spark, d))
    model = fit(df.where("split = 'train'"))
    part = lambda s: L.score(model, df.where(F.col("split") == s), R.FEATURES, name)
    return L.evaluate(part("val"), part("test"))


@BOOK.query()
def q_logistic_fit(spark, d):
    return fit_and_evaluate(spark, d, "logistic", lambda t: LEARNERS["logistic"](t, R.FEATURES))


@BOOK.query()
def q_forest_fit(spark, d):
    return fit_and_evaluate(spark, d, "forest", lambda t: LEARNERS["forest"](t, R.FEATURES))


@BOOK.query()
def q_boosted_fit(spark, d):
    return fit_and_evaluate(spark, d, "boosted", lambda t: LEARNERS["boosted"](t, R.FEATURES))


@BOOK.query()
def q_network_fit(spark, d):
    return fit_and_evaluate(spark, d, "network", lambda t: LEARNERS["network"](t, R.FEATURES))


@BOOK.query("WITH " + R.FEATURES_SQL + """, c AS (SELECT label AS y, count(*) AS n FROM features WHERE split='train' GROUP BY 1)
SELECT y, n, round((SELECT sum(n) FROM c)/(2.0::DOUBLE*n),8) AS weight, round((SELECT n FROM c WHERE y=0)/(SELECT n FROM c WHERE y=1)::DOUBLE,8) AS positive_weight FROM c""")
def q_class_weights(spark, d):
    out = L.class_weights(frame(spark, d).where("split = 'train'"), "y")
    return out.withColumns({"weight": r("weight", 8), "positive_weight": r("positive_weight", 8)})


def work_folder(spark):
    """Where finished work of this application lies."""
    use_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/work-{spark.sparkContext.applicationId}"


def purged_folds(spark, d, n=FOLDS):
    """Rolling-origin folds of the training rows, purged, each with inputs fitted on its own training rows."""
    raw = staged(S.purge_folds(S.rolling_folds(raw_frame(spark, d).where("split = 'train'"), "fyear", n), "fdate", 200))
    folds = None
    for fold in range(n):
        one = prepared(raw.where(F.col("fold") == fold), "role = 'train'")
        folds = one if folds is None else folds.unionByName(one)
    return folds


@BOOK.query()
def q_search(spark, d):
    """Ridge strengths over the purged folds; finished fits live in a Parquet table."""
    out = L.search(purged_folds(spark, d), R.FEATURES, C_GRID, LEARNERS["logistic"], f"{work_folder(spark)}/search")
    return out.withColumn("best", (F.col("mean_ap") == F.max("mean_ap").over(_all())).cast("int"))


@BOOK.query("WITH " + R.FEATURES_SQL + f""" SELECT model, n_obs, n_events, {REPS} AS n_reps, 1 AS within, 1 AS loaded FROM (SELECT count(*) AS n_obs, CAST(sum(label) AS BIGINT) AS n_events FROM features WHERE split='test'), (SELECT unnest(['logistic','forest']) AS model)""")
def q_training_stage(spark, d):
    """Search, refit, Platt map, locked threshold and test metrics with intervals, for two learners. Facts: test rows and events, whether each metric
    lies within its interval, and whether a second run loads the saved model instead of fitting."""
    df = staged(frame(spark, d))
    part = lambda s: df.where(F.col("split") == s)
    folds, out = staged(purged_folds(spark, d)), None

    for name, candidates in (("logistic", C_GRID[2:6]), ("forest", [{"depth": 5}, {"depth": 8}])):
        store = f"{work_folder(spark)}/stage"
        made = X.train_stage(part("train"), part("val"), folds, R.FEATURES, name, LEARNERS[name], candidates, store)
        again = X.train_stage(part("train"), part("val"), folds, R.FEATURES, name, LEARNERS[name], candidates, store)
        one = X.evaluate_stage(again, part("test"), R.FEATURES, name, "entity", REPS)
        within = F.col("pr_auc").between(F.col("pr_auc_lower"), F.col("pr_auc_upper")) & F.col("roc_auc").between(F.col("roc_auc_lower"), F.col("roc_auc_upper"))
        one = one.select("model", "n_obs", "n_events", "n_reps", within.cast("int").alias("within"), F.lit(int(again.loaded and again.facts == made.facts)).alias("loaded"))
        out = one if out is None else out.unionByName(one)
    return out.withColumns({c: F.col(c).cast("long") for c in ("n_obs", "n_events", "n_reps")})


def _all():
    from pyspark.sql import Window

    return Window.partitionBy()  # one row per candidate


@BOOK.query(SC + PLATT + " SELECT model, round(a,6) AS a, round(b,6) AS b FROM pl12")
def q_platt(spark, d):
    fitted = M.logit_map(M.compress(R.scored(spark, d, "val"), ["model"]), F.col("score"))
    return fitted.select("model", r("a").alias("a"), r("b").alias("b"))


@BOOK.query("WITH " + R.FEATURES_SQL + """, c AS (SELECT count(*) FILTER (label=0) AS n0, count(*) FILTER (label=1) AS n1 FROM features WHERE split='train')
SELECT 0 AS y, n0 AS n_original, 0::BIGINT AS n_synthetic, n0 AS n_after FROM c UNION ALL SELECT 1, n1, n0-n1, n0 FROM c""")
def q_smote_counts(spark, d):
    train = frame(spark, d).where("split = 'train'").withColumn("rowkey", F.col("entity") * 10000 + F.col("fyear"))
    made = synthetic_minority(train, "rowkey", "y", R.FEATURES).groupBy("y").agg(F.count("*").alias("n_synthetic"))
    n = train.groupBy("y").agg(F.count("*").alias("n_original")).join(F.broadcast(made), "y", "left")
    extra = F.coalesce("n_synthetic", F.lit(0))
    return n.select("y", "n_original", extra.alias("n_synthetic"), (F.col("n_original") + extra).alias("n_after"))


def positives(spark, d):
    """Scaled positive training rows with all features known, under a single key."""
    known = " AND ".join(f"{c} IS NOT NULL" for c in R.FEATURES)
    f = R.features(spark, d).where(f"split = 'train' AND label = 1 AND {known}")
    return f.select((F.col("entity") * 10000 + F.col("fyear")).alias("rowkey"), *[F.round(F.col(c), 4).alias(c) for c in R.FEATURES])


NEAR_SQL = "WITH " + R.FEATURES_SQL + ", p AS (SELECT entity*10000+fyear AS key, " + ", ".join(f"round({c},4) AS {c}" for c in R.FEATURES) + " FROM features WHERE split='train' AND label=1 AND " + " AND ".join(f"{c} IS NOT NULL" for c in R.FEATURES) + "), x AS (SELECT a.key, b.key AS neighbour, sqrt(" + "+".join(f"(a.{c}-b.{c})*(a.{c}-b.{c})" for c in R.FEATURES) + """) AS distance FROM p a JOIN p b ON a.key<>b.key)
SELECT key, rank, round(distance,7) AS distance FROM (SELECT key, distance, row_number() OVER (PARTITION BY key ORDER BY distance, neighbour) AS rank FROM x) WHERE rank<=5"""


@BOOK.query(NEAR_SQL)
def q_minority_neighbours(spark, d):
    """The distances of the five nearest positives of every positive training row."""
    return nearest(positives(spark, d), "rowkey", R.FEATURES).select("key", F.col("rank").cast("long").alias("rank"), r("distance", 7).alias("distance"))


def variant_frames(df):
    """Name, rows and features of each data variant: all of it, fewer features, without an industry, oversampled to parity."""
    more = staged(L.oversample(df.where("split = 'train'"), KEYS).unionByName(df.where("split <> 'train'")))
    return {"full": (df, R.FEATURES), "reduced": (df, R.FEATURES[:3]), "industry": (df.where("NOT sic BETWEEN 6000 AND 6999"), R.FEATURES), "oversampled": (more, R.FEATURES)}


@BOOK.query()
def q_variants(spark, d):
    """All four learners under every data variant: metrics of the test rows at the threshold of the validation rows."""
    df = staged(frame(spark, d))
    out = L.run_variants(variant_frames(df), LEARNERS, threads=L.abreast(df))
    return out.withColumns({c: r(c) for c in ("pr_auc", "roc_auc", "brier_score")})


def leakage_designs(df, seeds=(1, 2)):
    """(design, seed, rows with a role): the chronological split once, the random ones for each seed with a fifth of
    their training side (entities or rows) held out for validation."""
    share = lambda seed, *keys: unit_hash(f"{seed}v", *keys) < int(0.2 * 2**32)
    out = [("chronological", 0, df.withColumn("role", F.col("split")))]
    for seed in seeds:
        by_entity = S.entity_split(df, "entity", 0.8, seed)
        by_row = df.withColumn("side", S.row_split(KEYS, 0.8, seed))
        for name, x, keys in (("entity_random", by_entity, ["entity"]), ("row_random", by_row, KEYS)):
            out.append((name, seed, x.withColumn("role", F.when((F.col("side") == "train") & share(seed, *keys), "val").otherwise(F.col("side")))))
        out.append(("contaminated", seed, S.contaminated_design(df, "entity", "fyear", 2000, 0.8, seed)))
    return out


def leakage_runs(spark, d):
    """Average precision and AUC on validation and test rows of every design, seed and learner; inputs are fitted on each design's training rows."""
    df = staged(raw_frame(spark, d))
    columns = ["role", "y", *KEYS, *R.FEATURES]
    designs = [(name, seed, lambda x=x: x.select(columns)) for name, seed, x in leakage_designs(df)]
    content = G.content_hash(df, [c for c in df.columns]).first()
    return X.run_designs(designs, LEARNERS, R.FEATURES, f"{work_folder(spark)}/designs", content, spark, threads=L.abreast(df))


@BOOK.query()
def q_leakage_runs(spark, d):
    return leakage_runs(spark, d).select("model", "design", "seed", "role", r("pr_auc").alias("pr_auc"), r("roc_auc").alias("roc_auc"))


@BOOK.query()
def q_leakage(spark, d):
    """Each learner's advantage over the logistic model per design, against the chronological one."""
    return advantage_table(leakage_runs(spark, d).where("role = 'test'"), "logistic", "chronological")


ARM_SEEDS = 5


ARMS = ("chronological", "future_all", "future_firm_disjoint")
SEEDED_ARMS = ("future_matched", "recent_past_matched")


def arm_runs(spark, d, arms=ARMS + SEEDED_ARMS):
    """The three deterministic learners on training arms, the matched ones over five draws; all score the same evaluation rows."""
    df = staged(raw_frame(spark, d))

    def rows(arm, seed):
        own = S.arms(df.drop("split"), "entity", "fyear", 1997, (1998, 1998), (1999, 2000), 2001, seed).where(F.col("arm") == arm).withColumn("role", F.lit("train"))
        held = df.where("fyear BETWEEN 1999 AND 2000").withColumn("role", F.lit("test"))
        columns = ["role", "y", *KEYS, *R.FEATURES]
        return own.select(columns).unionByName(held.select(columns))

    designs = [(arm, 42 + i, lambda a=arm, s=42 + i: rows(a, s)) for arm in arms for i in range(ARM_SEEDS if arm in SEEDED_ARMS else 1)]
    learners = {k: LEARNERS[k] for k in ("logistic", "forest", "boosted")}
    content = ["arms", *G.content_hash(df, [c for c in df.columns]).first()]
    return X.run_designs(designs, learners, R.FEATURES, f"{work_folder(spark)}/arms", content, spark, threads=L.abreast(df))


ARM_FACTS = ARMS_SQL.replace("SELECT a AS arm, 'T' AS block", ", arms AS (SELECT a AS arm, 'T' AS block", 1) + """), lab AS (SELECT entity, fyear, label FROM panel)
SELECT arm AS design, model, n_train, train_events, n_rows, n_events FROM (SELECT arm, count(*) AS n_train, CAST(sum(label) AS BIGINT) AS train_events FROM arms JOIN lab USING (entity, fyear) WHERE arm NOT LIKE '%matched' GROUP BY 1),
 (SELECT count(*) AS n_rows, CAST(sum(label) AS BIGINT) AS n_events FROM lab WHERE fyear BETWEEN 1999 AND 2000), (SELECT unnest(['logistic','forest','boosted']) AS model)"""


@BOOK.query()
def q_arm_runs(spark, d):
    """Mean and sd over draws of each arm and learner and the change against the chronological arm."""
    out = X.seed_summary(arm_runs(spark, d), "chronological")
    return out.withColumns({c: r(c) for c in ("pr_auc", "pr_auc_sd", "roc_auc", "change")})


@BOOK.query(ARM_FACTS)
def q_arm_facts(spark, d):
    """Rows and events that the arms without draws were fitted on, and the common evaluation rows."""
    return arm_runs(spark, d, ARMS).select("design", "model", "n_train", "train_events", "n_rows", "n_events")


def _forest(spark, d):
    df = staged(frame(spark, d))
    return df, LEARNERS["forest"](df.where("split = 'train'"), R.FEATURES)


@BOOK.query()
def q_shapley(spark, d):
    """Exact Shapley importance of the forest on all test rows."""
    df, model = _forest(spark, d)
    out = T.mean_abs_attribution(T.ensembles({"forest": model}), df.where("split = 'test'"), R.FEATURES)
    return out.select("feature", F.col("n").alias("n_rows"), "mean_abs", F.rank().over(_all().orderBy(F.col("mean_abs").desc())).alias("rank"))


@BOOK.query("WITH " + R.FEATURES_SQL + f", t AS (SELECT count(*) AS n FROM features WHERE split='test') SELECT model, n AS n_rows, n AS n_additive, {len(R.FEATURES)}*n AS n_attributions FROM t, (SELECT unnest(['forest','boosted']) AS model)")
def q_tree_additivity(spark, d):
    """Forest and boosted trees: test rows whose exact attributions and base add up to the model's own score (probability, margin) within 1e-9."""
    df, forest = _forest(spark, d)
    test = df.where("split = 'test'")
    models = {"forest": forest, "boosted": LEARNERS["boosted"](df.where("split = 'train'"), R.FEATURES)}
    sums = T.tree_attribution(T.ensembles(models), test, KEYS, R.FEATURES).groupBy("model", *KEYS).agg(F.sum("attr").alias("attr"), F.max("base").alias("base"), F.count("attr").alias("n"))
    scores = None
    for name, column in (("forest", "probability"), ("boosted", "rawPrediction")):
        one = models[name].transform(test).select(F.lit(name).alias("model"), *KEYS, vector_to_array(column)[1].alias("score"))
        scores = one if scores is None else scores.unionByName(one)
    same = F.abs(F.col("attr") + F.col("base") - F.col("score")) <= 1e-9
    return sums.join(scores, ["model", *KEYS]).groupBy("model").agg(F.count("*").alias("n_rows"), F.count_if(same).alias("n_additive"), F.sum("n").alias("n_attributions"))


@BOOK.query()
def q_network_shapley(spark, d):
    """Sampled Shapley importance of the network, which has no tree paths, on all test rows."""
    df = staged(frame(spark, d))
    model = LEARNERS["network"](df.where("split = 'train'"), R.FEATURES)
    train = df.where("split = 'train'").withColumn("rowkey", F.col("entity") * 10000 + F.col("fyear"))
    bg = train.join(dense_index(train, "rowkey", "bg", size="bg_n"), "rowkey")
    attr = L.sampled_shapley(model, df.where("split = 'test'"), bg, KEYS, R.FEATURES)
    return attr.groupBy("feature").agg(
        F.count("*").alias("n_rows"), F.avg(F.abs("attr")).alias("mean_abs"), F.avg("mc_error").alias("mean_mc_error")
    )


@BOOK.query()
def q_refit_stability(spark, d):
    """Ranks of the forest's mean absolute attribution on the test rows over 25 refits: on entities drawn with replacement, and with other seeds."""
    df = staged(frame(spark, d))
    train, test = df.where("split = 'train'"), df.where("split = 'test'")
    drawn, threads = staged(multiplicities(train, "entity", REFITS, 42)), L.abreast(train)

    def bootstrap(rep):
        part = train.join(drawn.where(F.col("rep") == rep).select("entity", F.col("w").cast("double").alias("bw")), "entity")
        n = part.agg(F.coalesce(F.sum(F.when(F.col("y") == 0, F.col("bw"))), F.lit(0.0)), F.coalesce(F.sum(F.when(F.col("y") == 1, F.col("bw"))), F.lit(0.0))).first()
        if not n[0] or not n[1]:
            return None
        weight = F.col("bw") * F.when(F.col("y") == 1, (n[0] + n[1]) / (2 * n[1])).otherwise((n[0] + n[1]) / (2 * n[0]))
        return LEARNERS["forest"](part.withColumn("cw", weight), R.FEATURES, weighted="cw", seed=42 + rep)

    by_entity = T.refit_stability(bootstrap, REFITS, test, R.FEATURES, "entity_bootstrap", threads)
    return by_entity.unionByName(T.refit_stability(lambda k: LEARNERS["forest"](train, R.FEATURES, seed=42 + k), REFITS, test, R.FEATURES, "seed", threads))


@BOOK.query()
def q_local_surrogate(spark, d):
    """Local linear fits of the forest around its selected cases."""
    df, model = _forest(spark, d)
    val = L.score(model, df.where("split = 'val'"), R.FEATURES, "forest")
    test = L.score(model, df.where("split = 'test'"), R.FEATURES, "forest")
    cuts = M.thresholds(M.curve(M.compress(val, ["model"]), ["model"]), ["model"])
    cases = N.select_cases(test, cuts, KEYS).select("case", *KEYS).join(df, KEYS)
    row = df.where("split = 'train'").agg(*[F.struct(F.avg(c), F.stddev_pop(c)).alias(c) for c in R.FEATURES]).first()
    stats = {c: (row[c][0], row[c][1]) for c in R.FEATURES}
    return L.local_surrogate(model, cases, stats, ["case", *KEYS], R.FEATURES)
