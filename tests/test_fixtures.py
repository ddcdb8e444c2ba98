"""Hand-made frames with exact expected values."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from tidemark.functions import codes as C
from tidemark.functions import expr as E
from tidemark.operators import fit
from tidemark.operators import filters as FL
from tidemark.operators import guards as G
from tidemark.operators import linkage as L
from tidemark.operators import pit
from tidemark.operators import splits as S
from tidemark.operators import windows as W


def rows(df, *cols):
    return sorted([tuple(r) for r in df.select(*cols).collect()], key=str)


def test_period_lag_and_two_losses(spark):
    df = spark.createDataFrame(
        [("A", 2000, 10.0), ("A", 2001, -5.0), ("A", 2002, -3.0), ("B", 2005, 20.0), ("B", 2008, -8.0)], "e string, y long, ni double"
    )
    out = df.withColumn("lag", W.period_lag("ni", ["e"], "y")).withColumn("two", E.two_losses("ni", "lag"))
    out = out.withColumn("chin", E.symmetric_change(F.col("ni"), F.col("lag")))
    got = {(r.e, r.y): (r.lag, r.two, r.chin) for r in out.collect()}
    assert got["A", 2001][0] == 10.0 and got["A", 2002] == (-5.0, 1, 0.25)
    assert got["A", 2000][0] is None and got["B", 2008] == (None, None, None)


def test_lag_donor(spark):
    p = spark.createDataFrame([("A", 1990, 5.0), ("A", 1991, 6.0), ("B", 1990, 1.0)], "e string, y long, ni double")
    donor = spark.createDataFrame([("A", 1989, -10.0), ("C", 1989, 3.0)], "e string, y long, ni double")
    out = L.lag_with_donors(p, donor, "e", "y", ["ni"])
    assert rows(out, "e", "y", "ni_lag") == sorted([("A", 1990, -10.0), ("A", 1991, 5.0), ("B", 1990, None)], key=str)
    with pytest.raises(ValueError):
        L.lag_with_donors(p, p, "e", "y", ["ni"])


def test_link_prefers_primary(spark):
    p = spark.createDataFrame([("1", 2020, date(2020, 12, 31))], "e string, y long, d date")
    lk = spark.createDataFrame(
        [("1", 11111, "C", date(2010, 1, 1), date(2030, 12, 31)), ("1", 22222, "P", date(2010, 1, 1), date(2030, 12, 31))],
        "e string, permno long, prim string, lo date, hi date",
    )
    rank = F.when(F.col("prim") == "P", 0).otherwise(1)
    out = pit.best_valid(p, lk, ["e"], "d", "lo", "hi", ["e", "y"], [rank, F.col("lo")], ["permno", "prim"], "inner")
    assert rows(out, "permno", "prim") == [(22222, "P")]


def test_key_outcomes(spark):
    df = spark.createDataFrame([("12345678", "12345678"), ("87654321", "00000000"), (None, "99999999")], "a string, b string")
    got = [tuple(r) for r in df.select(*[c.alias(n) for n, c in L.key_outcomes("a", "b").items()]).collect()]
    assert got == [(1, 1, 0), (1, 0, 1), (0, 0, 0)]


def test_label_anchors(spark):
    """Both borders of a closed window count, a day outside does not; events before the anchor never do."""
    anchor = date(2003, 5, 10)
    days = {"before": date(2003, 5, 9), "first day": anchor, "inside": date(2003, 7, 4), "last day": date(2003, 6, 9), "day after": date(2003, 6, 10)}
    p = spark.createDataFrame([(k, anchor, date(2003, 5, 1)) for k in [*days, "none"]], "g string, fdate date, pdate date")
    ev = spark.createDataFrame([*days.items()], "g string, dl date")
    label = lambda at, reach: {r.g: r.label for r in pit.forward_label(p, ev, ["g"], at, "dl", reach).collect()}
    assert label("fdate", "30 DAYS") == {"before": 0, "first day": 1, "inside": 0, "last day": 1, "day after": 0, "none": 0}
    assert label("fdate", "60 DAYS") == {"before": 0, "first day": 1, "inside": 1, "last day": 1, "day after": 1, "none": 0}
    assert label("pdate", "39 DAYS") == {"before": 1, "first day": 1, "inside": 0, "last day": 1, "day after": 0, "none": 0}


def test_unique_assignment(spark):
    p = spark.createDataFrame([(1, 2019, 5, date(2020, 4, 1)), (1, 2020, 5, date(2021, 3, 15))], "g long, y long, permno long, fdate date")
    ev = spark.createDataFrame([(5, date(2021, 3, 20))], "permno long, dl date")
    assert rows(pit.forward_label(p, ev, ["permno"], "fdate", "dl", "365 DAYS"), "y", "label") == [(2019, 1), (2020, 1)]
    one = pit.unique_forward_label(p, ev, ["permno"], "fdate", "dl", "365 DAYS", ["y", "g"])
    assert rows(one, "y", "label") == [(2019, 0), (2020, 1)]


def test_event_flags(spark):
    """One case per rule of each family: (letters) -> (code, performance, core, narrow, bankruptcy, broad)."""
    cases = {
        (" gdr", "insc ", None): (560, 1, 1, 1, 0, 1), ("GDR", "CORQ", "x"): (570, 1, 0, 0, 0, 1), ("GDR", "PUBI", None): (585, 0, 0, 0, 0, 1),
        ("GDR", "MVTO", None): (519, 0, 0, 0, 0, 1), ("GDR", "bkpy", None): (574, 1, 1, 1, 1, 1), ("GDR", "??", "NFC"): (None, 0, 0, 0, 0, 1),
        ("GLI", "BKPY", "ndc"): (490, 1, 1, 1, 0, 1), ("GLI", None, "??"): (None, 0, 0, 1, 0, 1), ("GEX", "FING", "FPAY"): (None, 0, 0, 0, 0, 0), (None, None, None): (None, 0, 0, 0, 0, 0),
    }
    df = spark.createDataFrame([(i, *k) for i, k in enumerate(cases)], "i int, a string, r string, s string")
    out = C.event_flags(df, "a", "r", "s").orderBy("i").collect()
    names = ["code", "is_performance", "is_performance_core", "is_narrow", "is_bankruptcy", "is_broad"]
    assert [tuple(x[n] for n in names) for x in out] == [*cases.values()]


def test_ordered_code_rules(spark):
    """A bankruptcy reason wins over any action; untrimmed letters count, lower-case ones do not."""
    cases = {(" GLI ", "BKPY"): (572, 470), ("MER", " BKPY"): (572, 470), ("GDR ", "FING"): (450, 450), ("GLI", "LP"): (500, 400), ("gdr", "LP"): (500, 500), (None, None): (500, 500)}
    df = spark.createDataFrame([(i, *k) for i, k in enumerate(cases)], "i int, a string, r string").orderBy("i")
    for at, rule in enumerate(("frozen", "corrected")):
        assert [x[0] for x in df.select(C.exit_code("a", "r", rule=rule)).collect()] == [v[at] for v in cases.values()]
    with pytest.raises(ValueError):
        C.exit_code("a", "r", rule="other")


def test_eligible_asof(spark):
    good = ("EQTY", "COM", "NS", "Y", "CORP", " n ")
    info = spark.createDataFrame(
        [(10, *good, date(1995, 1, 1), date(2000, 6, 30)), (10, "EQTY", "ADR", "AD", "N", "CORP", "N", date(2000, 7, 1), date(2010, 12, 31)),
         (9, "EQTY", "COM", "NS", None, "CORP", "N", date(1995, 1, 1), date(2010, 12, 31))],
        "permno long, securitytype string, securitysubtype string, sharetype string, usincflg string, issuertype string, exchcd_src string, lo date, hi date",
    )
    df = spark.createDataFrame([(10, date(1998, 12, 31)), (10, date(2005, 12, 31)), (10, date(2012, 12, 31)), (9, date(1998, 12, 31))], "permno long, d date")
    assert rows(FL.eligible_asof(df, info, ["permno"], "d", "lo", "hi", C.eligible()), "permno", "d") == [(10, date(1998, 12, 31))]
    assert FL.eligible_anytime(df, info, "permno", C.eligible()).count() == 3
    with pytest.raises(KeyError):
        FL.eligible_asof(df, info.drop("lo"), ["permno"], "d", "lo", "hi", C.eligible())


def test_weighted_index(spark):
    from tidemark.operators.aggregates import weighted_return

    jan, feb = date(2020, 1, 31), date(2020, 2, 29)
    df = spark.createDataFrame(
        [(1, jan, None, 100.0), (2, jan, None, 300.0), (1, feb, 0.10, 110.0), (2, feb, -0.10, 270.0)], "p long, d date, ret double, me double"
    )
    assert weighted_return(df, "p", "d", "ret", "me").first()["vwret"] == pytest.approx(-0.05)


def test_trailing_minimum(spark):
    df = spark.createDataFrame([(1, i, 0.01 * i) for i in range(8)], "p long, m long, r double")
    last = lambda c: df.withColumn("x", c).where("m = 7").first()["x"]
    assert last(W.trailing_sd("r", ["p"], "m", 12, 6)) is not None and last(W.trailing_sd("r", ["p"], "m", 12, 12)) is None


def test_trailing_decay(spark):
    df = spark.createDataFrame([("a", 2010, 10.0), ("a", 2011, 20.0), ("a", 2012, 40.0), ("b", 2010, 10.0), ("b", 2013, 40.0)], "e string, y long, v double")
    out = {(r.e, r.y): (r.m2, r.m1) for r in df.withColumns({"m2": W.trailing_decay("v", ["e"], "y"), "m1": W.trailing_decay("v", ["e"], "y", minimum=1)}).collect()}
    assert out["a", 2012][0] == pytest.approx(30.0) and out["a", 2010][0] is None
    assert out["b", 2013] == (None, 40.0)


def test_period_end(spark):
    df = spark.createDataFrame([(2019, 12), (2019, 6), (2019, 1), (2019, None)], "y long, m long")
    got = [tuple(r) for r in df.select(E.period_end("y", "m"), E.period_end("y", "m", "frozen")).collect()]
    assert got[0][0] == date(2019, 12, 31) and got[1][0] == date(2019, 6, 30)
    assert got[2] == (date(2020, 1, 31), date(2019, 1, 31)) and got[3][0] == date(2019, 12, 31)


def test_indicator_policies(spark):
    df = spark.createDataFrame([(None, 5.0, None, -1.0), (6.0, 5.0, -1.0, None)], "lt double, at double, ni double, lag double")
    got = [tuple(r) for r in df.select(E.negative_equity("lt", "at"), E.negative_equity("lt", "at", "frozen"), E.two_losses("ni", "lag"), E.two_losses("ni", "lag", "frozen")).collect()]
    assert got == [(None, 0, None, 0), (1, 1, None, 0)]


def test_label_maturity_purge(spark):
    df = spark.createDataFrame(
        [("train", date(2008, 1, 1)), ("train", date(2009, 7, 1)), ("val", date(2010, 3, 1)), ("val", date(2014, 7, 1)), ("test", date(2015, 3, 1))],
        "split string, fdate date",
    )
    assert rows(S.purge_earlier(df, "split", "fdate", 365), "split", "fdate") == [
        ("test", date(2015, 3, 1)), ("train", date(2008, 1, 1)), ("val", date(2010, 3, 1))]


def test_fold_purge_drops_null_anchor(spark):
    d = [(2004, date(2004, 6, 30)), (2004, date(2004, 1, 31)), (2004, date(2005, 6, 15)), (2004, None), (2005, date(2005, 3, 1)), (2005, date(2005, 9, 1))]
    folds = S.rolling_folds(spark.createDataFrame(d, "y long, fdate date"), "y", 1)
    kept = S.purge_folds(folds, "fdate", 365).where("role = 'train'")
    assert rows(kept, "fdate") == [(date(2004, 1, 31),)]
    with pytest.raises(Exception):
        S.rolling_folds(spark.createDataFrame(d, "y long, fdate date"), "y", 5).collect()


def test_walk_forward_embargo(spark):
    df = spark.createDataFrame([(y,) for y in range(2000, 2006)], "y long")
    one = S.walk_forward(df, "y", 2004, 2004)
    assert rows(one.where("role = 'fit'"), "y") == [(2000,), (2001,), (2002,)]
    assert rows(one.where("role = 'val'"), "y") == [(2003,)] and rows(one.where("role = 'test'"), "y") == [(2004,)]
    zero = S.walk_forward(df, "y", 2004, 2004, embargo=0)
    assert zero.where("role = 'fit'").agg(F.max("y")).first()[0] == 2003


def test_arms_hold_no_evaluation_rows(spark):
    data = [(e, y) for e in range(60) for y in range(2010, 2024) if (e % 3 == 0) or (e % 3 == 1 and y < 2016) or (e % 3 == 2 and y >= 2020)]
    df = spark.createDataFrame(data, "e long, y long")
    out = S.arms(df, "e", "y", 2013, (2014, 2015), (2016, 2019), 2020).persist()
    assert out.where("y BETWEEN 2016 AND 2019").isEmpty()
    n = {(r.arm, r.block): r["count"] for r in out.groupBy("arm", "block").count().collect()}
    assert n["future_matched", "R"] == n["recent_past_matched", "V"]
    evaluated = {r.e for r in df.where("y BETWEEN 2016 AND 2019").select("e").distinct().collect()}
    disjoint = {r.e for r in out.where("arm = 'future_firm_disjoint' AND block = 'R'").select("e").collect()}
    assert disjoint and not (evaluated & disjoint)


def test_realised_clipping(spark):
    raw = spark.createDataFrame([("f", "test", v) for v in (1.0, 1.0, 0.5, 2.5, None)], "feature string, split string, value double")
    b = spark.createDataFrame([("f", 1.0, 2.0)], "feature string, lower double, upper double")
    r = fit.realised_clipping(raw, b).first()
    assert (r.n, r.n_low, r.n_high, r.drift) == (4, 1, 1, 1)


def test_fill_levels_and_binary_tie(spark):
    tr = [("x", "28", 2000, float(i)) for i in range(6)] + [("flag", "28", 2000, float(i % 2)) for i in range(6)] + [("x", "99", 2001, 100.0)]
    train = spark.createDataFrame(tr, "feature string, sector string, y long, value double")
    t = fit.fill_tables(train, "sector", "y")
    ask = spark.createDataFrame([("x", "28", 2000, None), ("x", "28", 2005, None), ("x", "99", 2001, None), ("x", "77", 2009, None), ("flag", "28", 2000, None)], "feature string, sector string, y long, value double")
    got = {(r.feature, r.sector, r.y): (r.value, r.level) for r in fit.fill(ask, t, "sector", "y", ("flag",)).collect()}
    assert got["x", "28", 2000] == (2.5, 1) and got["x", "28", 2005] == (2.5, 2)
    assert got["x", "99", 2001] == (100.0, 3) and got["x", "77", 2009] == (3.0, 4)
    assert got["flag", "28", 2000] == (0.0, 1)


def test_dispositions(spark):
    mm = spark.createDataFrame(
        [("a", 2000, 1, "AAAAAA10", "BBBBBB10"), ("b", 2000, 2, "CCCCCC20", "CCCCCC10"), ("c", 2000, 3, "ZZZZZZ10", "DDDDDD10"), ("d", 2000, 4, "ZZZZZZ10", "FFFFFF10")],
        "g string, y long, p long, own string, other string",
    )
    names = spark.createDataFrame([(1, "AAAAAA10"), (1, "BBBBBB10"), (2, "CCCCCC10"), (3, "DDDDDD10"), (3, "EEEEEE10"), (4, "FFFFFF10")], "p long, k string")
    out = L.classify_mismatches(mm, names, "p", "own", "other", "k")
    assert [r[1] for r in rows(out, "g", "disposition")] == list(L.DISPOSITIONS)
    assert [r.n for r in L.disposition_summary(out.limit(0)).collect()] == [0, 0, 0, 0]


def test_guards(spark):
    df = spark.createDataFrame([(1, 2000), (1, 2000)], "e long, y long")
    with pytest.raises(ValueError):
        G.require(G.duplicate_keys(df, ["e", "y"]), "duplicate keys")
    x = spark.createDataFrame([(1.0, 1), (float("nan"), 2), (None, 0), (float("inf"), 1)], "v double, b int")
    got = {r.column: r for r in G.input_problems(x, ["v"], ["b"]).collect()}
    assert (got["v"].n_null, got["v"].n_nan, got["v"].n_inf, got["b"].n_not_binary) == (1, 1, 1, 1)


def test_evaluation_ledger(spark):
    df = spark.createDataFrame([(1, 0), (2, 1)], "e long, y int")
    ident = lambda frame, spec="s": G.evaluation_identity(frame, ["e", "y"], spec, "y", 365, ["a"])
    ledger = ident(df)
    assert G.evaluation_permitted(ident(df.orderBy(F.desc("e"))), None)
    with pytest.raises(PermissionError):
        G.evaluation_permitted(ident(df), ledger, "short")
    assert G.evaluation_permitted(ident(df), ledger, "rerun after a corrected label")
    assert G.evaluation_permitted(ident(df.withColumn("y", F.lit(1))), ledger) and G.evaluation_permitted(ident(df, "t"), ledger)


def test_deflator_csv(spark, tmp_path):
    from tidemark.sources.tables import read_deflator

    (tmp_path / "q.csv").write_text("observation_date,GDPDEF\n2011-01-01,90\n2012-01-01,99\n2012-04-01,101\n")
    assert rows(read_deflator(spark, str(tmp_path / "q.csv"), 2012), "year", "deflator") == [(2011, 0.9), (2012, 1.0)]
    with pytest.raises(ValueError):
        read_deflator(spark, str(tmp_path / "q.csv"), 1999)
