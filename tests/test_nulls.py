import pytest
from pyspark.sql import functions as F

from limnos.functions import columns as C
from limnos.operators import reshape as X


def values(df):
    return sorted([tuple(r) for r in df.collect()], key=str)


def test_membership_keeps_missing(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "x string")
    assert values(df.where(C.not_in("x", ["a"]))) == [("b",), (None,)] or values(df.where(C.not_in("x", ["a"]))) == [(None,), ("b",)]
    assert values(df.where(C.is_in("x", ["a"]))) == [("a",)]
    assert values(df.where(F.col("x") != "a")) == [("b",)]


def test_natural_join_matches_missing(spark):
    a = spark.createDataFrame([(1, None), (2, "x")], "i int, k string")
    b = spark.createDataFrame([(None, 10), ("x", 20)], "k string, v int")
    assert values(X.natural_join(a, b).select("i", "v")) == [(1, 10), (2, 20)]


def test_strict_aggregates(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 3.0)], "k string, x double")
    rows = {r.k: r for r in df.groupBy("k").agg(C.strict_avg("x").alias("m"), C.strict_min("x").alias("lo"), F.avg("x").alias("loose")).collect()}
    assert rows["a"].m is None and rows["a"].lo is None and rows["a"].loose == 1.0 and rows["b"].m == 3.0


def test_distinct_counts_missing(spark):
    df = spark.createDataFrame([("a",), (None,), (None,)], "x string")
    assert df.agg(C.n_distinct("x")).first()[0] == 2


def test_unite_and_separate(spark):
    df = spark.createDataFrame([("LML", None, "a.b-c")], "w string, s string, k string")
    r = df.select(C.unite(".", "w", "s"), C.separate("k", 1), C.separate("k", 3), C.separate("k", 4)).first()
    assert tuple(r) == ("LML.NA", "a", "c", None)


def test_replace_first_and_all(spark):
    df = spark.createDataFrame([("CLAM CLAM",)], "x string")
    r = df.select(C.replace_first("x", "CLAM", "BIVALVE"), C.replace_all("x", "CLAM", "B")).first()
    assert tuple(r) == ("BIVALVE CLAM", "B B")


def test_numbers(spark):
    df = spark.createDataFrame([("1.5",), ("ND",), ("NaN",), (None,)], "x string")
    assert [r[0] for r in df.select(C.to_number("x")).collect()] == [1.5, None, None, None]
    folded = C.fold_nan(spark.createDataFrame([(float("nan"),), (2.0,)], "x double"))
    assert [r[0] for r in folded.collect()] == [None, 2.0]
    r = spark.createDataFrame([(0.125, 2.5)], "a double, b double").select(C.round_even("a", 2), C.round_even("b", 0)).first()
    assert tuple(r) == (0.12, 2.0)


def test_season(spark):
    df = spark.createDataFrame([(7,), (8,), (9,), (10,), (12,), (None,)], "m int")
    assert [r[0] for r in df.select(C.season("m")).collect()] == ["spring", "fall", "fall", "fall", "fall", None]


def test_first_argmax_and_grid(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 5.0), (3.0, 5.0), (4.0, None)], "d double, v double")
    assert df.agg(C.first_argmax("d", "v")).first()[0] == 2.0
    assert spark.range(1).select(C.even_grid(F.lit(0.0), F.lit(1.0), 5)).first()[0] == [0.0, 0.25, 0.5, 0.75, 1.0]


def test_pair_interval_and_label(spark):
    df = spark.createDataFrame([("b", "a", -1.0, 2.0, 0.0004), ("a", "b", 1.0, 2.0, 0.25)], "x string, y string, lo double, hi double, p double")
    rows = [tuple(r) for r in df.select(C.canonical_pair("x", "y"), C.excludes_zero("lo", "hi"), C.p_label("p")).collect()]
    assert rows == [("a_b", False, "< .001"), ("a_b", True, "0.25")]


def test_log_choose(spark):
    import math
    r = spark.createDataFrame([(10, 3), (500, 250), (5, 0)], "n long, k long").select(C.log_choose("n", "k")).collect()
    for got, (n, k) in zip(r, [(10, 3), (500, 250), (5, 0)]):
        assert got[0] == pytest.approx(math.log(math.comb(n, k)), abs=1e-9)


def test_quantiles_match_percentile(spark):
    df = spark.range(5000).select((F.col("id") % 3).alias("k"), (F.xxhash64("id") % 97).cast("double").alias("x"))
    df = df.unionByName(spark.createDataFrame([(0, None), (7, 4.0)], "k long, x double"))
    got = {r.k: (r.a, r.b) for r in X.quantiles(df, ["k"], "x", {"a": 0.025, "b": 0.6}).collect()}
    for r in df.groupBy("k").agg(F.percentile("x", F.array(F.lit(0.025), F.lit(0.6))).alias("q")).collect():
        assert got[r.k] == pytest.approx(tuple(r.q))
    whole = X.quantiles(df.select("x"), [], "x", {"m": 0.5}).first()[0]
    assert whole == pytest.approx(df.agg(F.percentile("x", 0.5)).first()[0])


def test_zscores_share_codes(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 3.0)], "k string, x double")
    z = [r.x for r in X.zscores(df, ["x"]).orderBy("x").collect()]
    assert z == pytest.approx([-1, 0, 1])
    assert {(r.x, r.s) for r in X.add_share(df, ["k"], "x", "t", "s").collect()} == {(1.0, 1 / 3), (2.0, 2 / 3), (3.0, 1.0)}
    assert {tuple(r) for r in X.factor_codes(df, "k", "c").collect()} == {("a", 1), ("b", 2)}


def test_correlations_missing(spark):
    df = spark.createDataFrame([(1.0, 2.0, 1.0), (2.0, 4.1, None), (3.0, 5.9, 2.0)], "a double, b double, c double")
    r = {(x.var1, x.var2): x.r for x in X.correlations(df, ["a", "b", "c"]).collect()}
    assert r["a", "c"] is None and r["a", "b"] == pytest.approx(0.9997, abs=1e-3)


def test_long_wide_top(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0)], "id int, a double, b double")
    back = X.wide(X.long(df, ["id"], ["a", "b"], "n", "v"), ["id"], "n", "v", ["a", "b", "c"], fill=0.0)
    assert tuple(back.first()) == (1, 2.0, 3.0, 0.0)
    rows = spark.createDataFrame([("g", i) for i in range(5)], "g string, v int")
    assert {r.v for r in X.top_n(rows, ["g"], [F.col("v").desc()], 2).collect()} == {4, 3}
