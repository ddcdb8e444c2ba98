"""Overlapping interval histories against a loop over all pairs."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import pit


def segments_brute(first, last, levels):
    """Numbers covered by the segments of ``pit._segments``, each with how often."""
    return [x for x in range(first, last + 1)]


def test_segments_cover_each_number_once(spark):
    cases = [(a, b, levels) for levels in (1, 2, 4) for a, b in ((0, 0), (0, 7), (1, 1), (3, 12), (7, 8), (0, 63), (5, 60), (8, 15), (9, 54)) if b < 8**levels]
    cases += [(0, 8**4 - 1, 4), (1, 8**4 - 2, 4), (1234, 3210, 4)]
    df = spark.createDataFrame(cases, "a long, b long, levels int")
    for levels in (1, 2, 4):
        for r in df.where(F.col("levels") == levels).withColumn("s", pit._segments(F.col("a"), F.col("b"), levels)).collect():
            covered = sorted(x for s in r.s for x in range(s["at"] << 3 * s["level"], s["at"] + 1 << 3 * s["level"]))
            assert covered == segments_brute(r.a, r.b, levels)
            assert all(sum(s["level"] == k for s in r.s) < 16 for k in range(levels))


@pytest.mark.parametrize("kind", ["date", "timestamp", "timestamp_ntz"])
def test_overlapping_histories_match_all_pairs(spark, kind):
    rng = random.Random(9)
    start = dt.datetime(1999, 3, 1)
    step = dt.timedelta(days=1) if kind == "date" else dt.timedelta(hours=7, microseconds=13)
    at = lambda n: None if n is None else start + n * step
    hist = [(rng.choice((1, 1, 1, 2, 3, None)), a, a + rng.choice((-1, 0, 1, 30, 400, 9000)), i) for i, a in enumerate(rng.randrange(-300, 3000) for _ in range(150))]
    hist += [(1, None, 5, 900), (1, 5, None, 901), (1, -9000, 9000, 902), (4, 10, 20, 903)]
    rows = [(i, rng.choice((1, 1, 2, 3, 5, None)), rng.choice((None, *[rng.randrange(0, 2500) for _ in range(9)]))) for i in range(300)]
    rows += rows[:20]
    cast = lambda df, cs: df.withColumns({c: F.col(c).cast(kind) for c in cs})
    h = cast(spark.createDataFrame([(e, at(a), at(b), i) for e, a, b, i in hist], "e int, lo timestamp_ntz, hi timestamp_ntz, v int"), ["lo", "hi"])
    r = cast(spark.createDataFrame([(i, e, at(n)) for i, e, n in rows], "id int, e int, d timestamp_ntz"), ["d"])
    holds = lambda e, n: [v for he, a, b, v in hist if he == e and None not in (e, n, a, b) and a <= n <= b]
    inner = [(i, v) for i, e, n in rows for v in holds(e, n)]
    alone = [(i, None) for i, e, n in rows if not holds(e, n)]
    got = lambda how: sorted(((x.id, x.v if "v" in x else None) for x in pit.valid_at(r, h, ["e"], "d", "lo", "hi", how).collect()), key=str)
    assert got("inner") == sorted(inner, key=str) and len(inner) > 500
    assert got("left") == sorted(inner + alone, key=str)
    assert got("left_anti") == sorted(alone, key=str)
    assert got("left_semi") == sorted([(i, None) for i, e, n in rows if holds(e, n)], key=str)
    joined = pit.valid_at(r, h, ["e"], "d", "lo", "hi", "inner")
    assert joined.columns == ["id", "e", "d", "lo", "hi", "v"]
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert "<=" not in plan.split("Join")[1].split("\n")[0]  # the lookup is by equality alone


def test_intervals_without_rows(spark):
    h = spark.sql("SELECT 1 e, date'2020-01-01' lo, date'2021-01-01' hi, 7 v")
    r = spark.sql("SELECT 1 e, date'2020-06-01' d")
    assert pit.valid_at(r.where("e > 1"), h, ["e"], "d", "lo", "hi").count() == 0
    assert pit.valid_at(r, h.where("e > 1"), ["e"], "d", "lo", "hi").collect()[0].v is None
    assert pit.valid_at(r.withColumn("d", F.lit(None).cast("date")), h, ["e"], "d", "lo", "hi").collect()[0].v is None
