"""Scans, sinks and the search ledger."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import learn as L
from tidemark.sources import tables as S


def test_candidates_and_schema(spark):
    df = spark.createDataFrame([(1, "a", float("nan"))], "Header_ID int, sic string, x double")
    out = S.resolve_columns(df, {"id": ["pit_id", "header_id"], "gone": ["nope"]}, optional=["gone"])
    assert out.columns == ["id", "gone"] and out.first()["id"] == 1
    with pytest.raises(KeyError):
        S.resolve_columns(df, {"id": ["nope"]})
    with pytest.raises(ValueError):
        S.check_schema(df, T.StructType([T.StructField("sic", T.LongType())]))
    assert S.nan_to_null(df).first()["x"] is None


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 2000, 0.5), (2, 2001, 1.5)], "e int, fyear int, v double")
    S.write_parquet(df, str(tmp_path / "p"), ["fyear"])
    assert spark.read.parquet(str(tmp_path / "p")).where("fyear = 2001").count() == 1
    S.write_report_csv(df, str(tmp_path / "c"))
    assert spark.read.csv(str(tmp_path / "c"), header=True).columns == ["e", "fyear", "v"]
    for _ in range(2):
        S.append_ledger(df.limit(1), str(tmp_path / "l"))
    assert spark.read.parquet(str(tmp_path / "l")).count() == 2
    assert S.fitted(df).orderBy("e").collect() == df.orderBy("e").collect()


def test_search_resumes(spark, tmp_path):
    rows = [(f, role, float(i % 7) + (2.0 if i % 3 == 0 else 0.0), int(i % 3 == 0)) for f in (0, 1) for role in ("train", "val") for i in range(60)]
    folds = spark.createDataFrame(rows, "fold int, role string, x double, y int")
    calls = []

    def fit(train, features, y="y", **kw):
        calls.append(kw)
        return L.fit_logistic(train, features, y, max_iter=5, **kw)

    store = str(tmp_path / "store")
    first = L.search(folds, ["x"], [{"c": 1.0}], fit, store, threads=1)
    assert len(calls) == 2 and first.first()["n_folds"] == 2
    again = L.search(folds, ["x"], [{"c": 1.0}, {"c": 0.1}], fit, store, threads=1)
    assert len(calls) == 4 and again.count() == 2


def test_oversample_parity_and_weights(spark):
    df = spark.createDataFrame([(i, int(i < 10)) for i in range(100)], "k long, y int")
    n = {r.y: r["count"] for r in L.oversample(df, ["k"]).groupBy("y").count().collect()}
    assert n[0] == 90 and n[1] == 90
    w = {r.y: r.weight for r in L.class_weights(df, "y").collect()}
    assert w[1] == pytest.approx(5.0) and w[0] == pytest.approx(100 / 180)
    assert L.balanced(df, "y").agg(F.sum("w")).first()[0] == pytest.approx(100.0)


def test_both_deflator_layouts_give_one_series(spark, tmp_path):
    (tmp_path / "annual.csv").write_text("year,deflator\n2011,50\n2012,80\n2013,100\n")
    (tmp_path / "quarterly.csv").write_text("observation_date,GDPDEF\n2011-01-01,40\n2011-07-01,60\n2012-04-01,80\n2013-01-01,90\n2013-10-01,110\n")
    want = [(2011, 0.625), (2012, 1.0), (2013, 1.25)]
    for name in ("annual.csv", "quarterly.csv"):
        got = sorted((r.year, r.deflator) for r in S.read_deflator(spark, str(tmp_path / name), 2012).collect())
        assert got == want
    (tmp_path / "other.csv").write_text("a,b\n1,2\n")
    for bad, year in (("other.csv", 2012), ("annual.csv", 1999)):
        with pytest.raises(ValueError):
            S.read_deflator(spark, str(tmp_path / bad), year)
