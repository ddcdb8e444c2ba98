"""Time-aware splits, folds, purging and seeded designs.

Randomness is a pure function of (seed, key), so a split does not depend on
partitioning, task order or retries.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.expr import unit_hash
from tidemark.operators import fit
from tidemark.operators.filters import coverage
from tidemark.operators.ranks import cumulate
from tidemark.sources.tables import fitted, staged

HASH_RANGE = 2**32


def chronological(period: str, train_end: int, val_end: int) -> Column:
    p = F.col(period)
    return F.when(p <= train_end, "train").when(p <= val_end, "val").otherwise("test")


def purge_earlier(df: DataFrame, split: str, anchor: str, horizon_days: int) -> DataFrame:
    """Drop train/val rows whose anchor + horizon is not strictly before the next
    split's first anchor; a missing anchor cannot be shown mature and is dropped."""
    first = df.agg(
        *[F.min(F.when(F.col(split) == s, F.col(anchor))).alias(f"_first_{s}") for s in ("val", "test")]
    )
    end = F.date_add(anchor, horizon_days)
    mature = F.when(F.col(split) == "train", end < F.col("_first_val")).when(
        F.col(split) == "val", end < F.col("_first_test")
    ).otherwise(True)
    return df.join(F.broadcast(first), F.lit(True)).where(F.coalesce(mature, F.lit(False))).drop("_first_val", "_first_test")


def rolling_folds(train: DataFrame, period: str, n: int) -> DataFrame:
    """One long table: the last ``n`` periods are one-period validation folds and
    every earlier period is that fold's training set. Too few periods raises."""
    years = train.agg(F.sort_array(F.collect_set(period), asc=False).alias("_years"))  # bounded by the calendar
    enough = F.when(F.size("_years") > n, F.slice("_years", 1, n)).otherwise(
        F.raise_error(F.lit(f"need more than {n} periods for {n} folds")).cast("array<bigint>")
    )
    folds = years.select(F.sort_array(enough).alias("_v"))
    j = train.join(F.broadcast(folds), F.lit(True))
    out = j.select(*train.columns, F.posexplode("_v").alias("fold", "_val"))
    out = out.where(F.col(period) <= F.col("_val"))
    return out.withColumn("role", F.when(F.col(period) == F.col("_val"), "val").otherwise("train")).drop("_val")


def purge_folds(folds: DataFrame, anchor: str, horizon_days: int) -> DataFrame:
    """Inside each fold drop training rows not mature before the fold's first
    validation anchor; missing anchors are dropped, a fold without origin is kept."""
    origin = folds.where("role = 'val'").groupBy("fold").agg(F.min(anchor).alias("_origin"))
    j = folds.join(F.broadcast(origin), "fold", "left")
    ok = F.col("_origin").isNull() | F.coalesce(F.date_add(anchor, horizon_days) < F.col("_origin"), F.lit(False))
    return j.where((F.col("role") == "val") | ok).drop("_origin")


def fold_preprocess(
    folds: DataFrame, features: Sequence[str], keys: Sequence[str], sector: str, period: str, min_present: int,
    binary: tuple[str, ...] = (),
) -> DataFrame:
    """Clip, coverage filter and fill, fitted on each fold's training rows – all folds
    in one pass because ``fold`` is part of every group key. Returns long rows."""
    pairs = ", ".join(f"'{f}', {f}" for f in features)
    folds = staged(folds.select("fold", "role", *dict.fromkeys([*keys, sector, period, *features])))
    covered = folds.where(coverage(features) >= min(min_present, len(features)))
    melt = lambda df: df.selectExpr(
        "fold", "role", *keys, sector, f"stack({len(features)}, {pairs}) AS (feature, value)"
    )
    bounds = fitted(fit.clip_bounds(melt(folds).where("role = 'train'"), ["fold", "feature"]))
    clipped = fit.clip_long(melt(covered), bounds, ["fold", "feature"])
    tables = fit.fill_tables(clipped.where("role = 'train'"), sector, period, extra=["fold"])
    tables = {name: fitted(t) for name, t in tables.items()}
    return fit.fill(clipped, tables, sector, period, binary, extra=["fold"])


def walk_forward(df: DataFrame, period: str, first: int, last: int, embargo: int = 1) -> DataFrame:
    """Expanding windows per scored period ``origin``: fit <= origin-embargo-1,
    val = origin-1, test = origin. A row may serve two roles when embargo is 0."""
    p, o = F.col(period), F.col("origin")
    j = df.withColumn("origin", F.explode(F.sequence(F.lit(first).cast("long"), F.lit(last).cast("long"))))
    roles = F.array(
        F.when(p <= o - embargo - 1, F.lit("fit")), F.when(p == o - 1, F.lit("val")), F.when(p == o, F.lit("test"))
    )
    return j.withColumn("role", F.explode(F.array_compact(roles)))


def hash_rank(df: DataFrame, keys: Sequence[str], seed: int | str, name: str = "draw_rank") -> DataFrame:
    """1-based position of each distinct key in seeded random order."""
    ids = df.select(*keys).distinct().withColumn("_h", unit_hash(seed, *keys))
    groups = ids.groupBy("_h").agg(F.count("*").alias("_n"))
    upto = cumulate(groups, [], "_h", {"_upto": "_n"}, bits=16)
    tie = F.row_number().over(Window.partitionBy("_h").orderBy(*keys))  # hash collisions only
    return ids.withColumn("_tie", tie).join(upto, "_h").select(
        *keys, (F.col("_upto") - F.col("_n") + F.col("_tie")).alias(name)
    )


def sample_keys(df: DataFrame, keys: Sequence[str], frac: float, seed: int | str) -> DataFrame:
    """Exactly floor(frac * n) distinct keys, chosen by seeded rank."""
    ranked = hash_rank(df, keys, seed)
    size = df.select(*keys).distinct().agg(F.floor(F.count("*") * F.lit(frac)).alias("_k"))
    return ranked.join(F.broadcast(size), F.lit(True)).where(F.col("draw_rank") <= F.col("_k")).select(*keys)


def sample_rows(df: DataFrame, keys: Sequence[str], n: DataFrame, seed: int | str) -> DataFrame:
    """``n`` rows (a one-row, one-column frame) by seeded rank of the row key."""
    ranked = hash_rank(df, keys, seed)
    chosen = ranked.join(F.broadcast(n.toDF("_k")), F.lit(True)).where(F.col("draw_rank") <= F.col("_k"))
    return df.join(chosen.select(*keys), list(keys), "left_semi")


def entity_split(df: DataFrame, entity: str, frac: float, seed: int | str) -> DataFrame:
    """All rows of an entity go to one side; the training side has exactly
    floor(frac * entities)."""
    chosen = sample_keys(df, [entity], frac, seed).withColumn("_in", F.lit(1))
    return df.join(chosen, entity, "left").withColumn("side", F.when(F.col("_in") == 1, "train").otherwise("test")).drop("_in")


def row_split(keys: Sequence[str], frac: float, seed: int | str) -> Column:
    return F.when(unit_hash(seed, *keys) < int(frac * HASH_RANGE), "train").otherwise("test")


def contaminated_design(
    df: DataFrame, entity: str, period: str, val_end: int, frac: float = 0.8, seed: int | str = 42
) -> DataFrame:
    """Late periods are the test set; training entities never appear in it but keep
    all their periods; a fifth of them is held for validation."""
    late = F.col(period) > val_end
    test_ids = df.where(late).select(entity).distinct()
    pool = df.join(test_ids, entity, "left_anti")
    chosen = sample_keys(pool, [entity], frac, seed)
    held = sample_keys(chosen, [entity], 0.2, f"{seed}v").withColumn("_held", F.lit(1))
    train = pool.join(chosen, entity, "left_semi").join(held, entity, "left")
    train = train.withColumn("role", F.when(F.col("_held") == 1, "val").otherwise("train")).drop("_held")
    return train.unionByName(df.where(late).withColumn("role", F.lit("test")))


def arms(
    df: DataFrame, entity: str, period: str, train_max: int, val: tuple[int, int], evaluate: tuple[int, int],
    future_min: int, seed: int | str = 42,
) -> DataFrame:
    """Five training arms over blocks T, V, E, R in one long table (arm, block, row).

    The matched arms add as many rows as the firm-disjoint arm, limited by V.
    """
    p = F.col(period)
    t = df.where(p <= train_max)
    v = df.where(p.between(*val))
    r = df.where(p >= future_min)
    evaluated = df.where(p.between(*evaluate)).select(entity).distinct()
    r_diff = r.join(evaluated, entity, "left_anti")
    size = r_diff.agg(F.count("*").alias("n")).unionByName(v.agg(F.count("*").alias("n"))).agg(F.min("n"))
    key = [entity, period]
    tag = lambda x, arm, block: x.withColumns({"arm": F.lit(arm), "block": F.lit(block)})
    parts = [tag(t, a, "T") for a in ("chronological", "future_all", "future_firm_disjoint", "future_matched", "recent_past_matched")]
    parts += [
        tag(r, "future_all", "R"), tag(r_diff, "future_firm_disjoint", "R"),
        tag(sample_rows(r, key, size, seed), "future_matched", "R"),
        tag(sample_rows(v, key, size, seed), "recent_past_matched", "V"),
    ]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def group_fold(entity: str, k: int, seed: int | str = 42) -> Column:
    return (unit_hash(seed, entity) % k).cast("int")
