import numpy as np
import pytest

from pyspark.sql import functions as F

from limnos.functions.special import t_quantile, t_two_sided
from limnos.operators import mixed as M
from limnos.operators import regress as R
from limnos.operators import reshape as X
from limnos.operators import summaries as Y


def test_t_distribution():
    assert t_two_sided([12.7062047], [1])[0] == pytest.approx(0.05, abs=1e-8)
    assert t_two_sided([2.0], [10])[0] == pytest.approx(0.07338803, abs=1e-7)
    assert t_quantile(0.975, np.array([5.0, 1e6])) == pytest.approx([2.570582, 1.959966], abs=1e-5)


def data(groups=12, per=6, tau=1.0, seed=0, cells=1):
    rng = np.random.default_rng(seed)
    g = np.repeat(np.arange(groups), per)
    c = rng.integers(0, cells, len(g))
    x = rng.normal(size=len(g))
    y = 2 + 0.7 * x + c * 0.5 + rng.normal(0, tau, groups)[g] + rng.normal(0, 0.8, len(g))
    return g, c, x, y


def frame(spark, g, c, x, y):
    return spark.createDataFrame([(int(a), f"f{b}", float(u), float(v)) for a, b, u, v in zip(g, c, x, y)], "g int, c string, x double, y double")


def dense_reml(x, y, g):
    """REML by dense matrices over a fine grid of variance ratios."""
    z = (g[:, None] == np.unique(g)).astype(float)
    n, p = x.shape

    def fit(r):
        v = np.eye(n) + r * z @ z.T
        w = np.linalg.inv(v)
        a = x.T @ w @ x
        b = np.linalg.solve(a, x.T @ w @ y)
        e = y - x @ b
        s2 = e @ w @ e / (n - p)
        dev = (n - p) * (np.log(2 * np.pi * s2) + 1) + np.linalg.slogdet(a)[1] + np.linalg.slogdet(v)[1]
        return dev, b, s2, s2 * np.linalg.inv(a)
    lo, hi = 0.0, 20.0
    for _ in range(12):
        grid = np.linspace(lo, hi, 41)
        i = int(np.argmin([fit(r)[0] for r in grid]))
        lo, hi = grid[max(i - 1, 0)], grid[min(i + 1, 40)]
    return (grid[i], *fit(grid[i]))


def fitted(model):
    """Coefficients by (cell, term), and the variances."""
    return {(r.cell, r.term): r for r in model.coefficients().collect()}, model.variances().first()


@pytest.mark.parametrize("shift", [0.0, 1e6])
def test_random_intercept_equals_dense(spark, shift):
    g, c, x, y = data()
    rows, v = fitted(M.RandomIntercept(frame(spark, g, c, x + shift, y), "y", ["x"], "g"))
    r, dev, b, s2, cov = dense_reml(np.column_stack([np.ones_like(x), x]), y, g)
    slope = rows["", "x"]
    assert slope.estimate == pytest.approx(b[1], rel=1e-4) and slope.se == pytest.approx(np.sqrt(cov[1, 1]), rel=1e-2)
    assert rows["", "(Intercept)"].estimate == pytest.approx(b[0] - b[1] * shift, rel=1e-4)
    assert v.residual_variance == pytest.approx(s2, rel=1e-3) and v.group_variance == pytest.approx(r * s2, rel=5e-3)
    assert v.criterion == pytest.approx(dev, abs=1e-3) and v.groups == 12 and v.n == 72 and v.parameters == 4
    if not shift:
        assert rows["", "(Intercept)"].se == pytest.approx(np.sqrt(cov[0, 0]), rel=1e-2)


def test_cells_equal_dense(spark, monkeypatch):
    monkeypatch.setattr(M, "SUM_BYTES", 1)
    g, c, x, y = data(cells=3, seed=2)
    model = M.RandomIntercept(frame(spark, g, c, x, y), "y", ["x"], "g", "c")
    rows, _ = fitted(model)
    f = (c[:, None] == np.arange(3)).astype(float)
    design = np.column_stack([v for j in range(3) for v in (f[:, j], f[:, j] * x)])
    _, _, b, _, cov = dense_reml(design, y, g)
    names = [(f"f{j}", t) for j in range(3) for t in ("(Intercept)", "x")]
    assert set(rows) == set(names)
    assert [rows[k].estimate for k in names] == pytest.approx(b, rel=1e-3, abs=1e-4) and [rows[k].se ** 2 for k in names] == pytest.approx(np.diag(cov), rel=1e-2)
    slopes = {r.family: r for r in model.family_slopes("x", "M").collect()}
    assert slopes["f1"].trend == pytest.approx(b[3], rel=1e-3) and slopes["f1"].sig == (np.sign(slopes["f1"].lower_CL) == np.sign(slopes["f1"].upper_CL))
    pairs = {(r.first, r.second): r for r in model.pairwise_contrasts({"x": 0.5}).collect()}
    l = np.array([1, .5, 0, 0, -1, -.5])
    assert len(pairs) == 3 and all(r.p_holm >= r.p for r in pairs.values())
    assert pairs["f0", "f2"].estimate == pytest.approx(l @ b, abs=1e-3) and pairs["f0", "f2"].SE == pytest.approx(np.sqrt(l @ cov @ l), rel=1e-2)
    means = {r.cell: r.emmean for r in model.marginal_means({"x": 1.0}).collect()}
    assert means["f0"] == pytest.approx(b[0] + b[1], rel=1e-3)
    assert model.pairwise_contrasts(within="|").count() == 0


def test_models_by_key_are_those_of_their_rows(spark):
    g, c, x, y = data(cells=2, seed=11)
    df = frame(spark, g, c, x, y).withColumn("k", F.when(F.col("x") > 0, 1))  # a missing key is a key
    both = M.RandomIntercept(df, "y", ["x"], "g", "c", ["k"], ratio=0.7).coefficients().collect()
    for k in (1, None):
        alone = M.RandomIntercept(df.where(F.col("k").eqNullSafe(F.lit(k))), "y", ["x"], "g", "c", ratio=0.7).coefficients().collect()
        for name in ("estimate", "df"):
            mine, theirs = ({(r.cell, r.term): r[name] for r in rows} for rows in ([r for r in both if r.k == k], alone))
            assert mine == pytest.approx(theirs)


def test_what_rows_do_not_determine_is_missing(spark):
    g, c, x, y = data(cells=2, seed=12)
    x = np.where(c == 1, 3.0, x)  # one value of x in a cell
    model = M.RandomIntercept(frame(spark, g, c, x, y), "y", ["x"], "g", "c", ratio=0.5)
    rows = {(r.cell, r.term): r for r in model.coefficients().collect()}
    assert rows["f1", "x"].estimate is None and rows["f1", "(Intercept)"].se is None and rows["f0", "x"].estimate is not None
    at = {r.cell: r.emmean for r in model.marginal_means({"x": 3.0}).collect()}
    assert at["f1"] is not None
    assert {r.family: r.sig for r in model.family_slopes("x").collect()}["f1"] is None


def test_balanced_intercept_has_group_degrees(spark):
    g, c, x, y = data(groups=10, per=5, seed=3)
    assert M.RandomIntercept(frame(spark, g, c, x, y), "y", [], "g").coefficients().first().df == pytest.approx(9, rel=0.02)


def test_no_group_variance_gives_least_squares(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=60)
    g = np.arange(60) % 6
    y = 1 + x + rng.normal(size=60)
    y -= np.array([y[g == k].mean() for k in range(6)])[g] - y.mean()  # group means all equal
    x -= np.array([x[g == k].mean() for k in range(6)])[g]
    rows, v = fitted(M.RandomIntercept(frame(spark, g, np.zeros(60, int), x, y), "y", ["x"], "g"))
    b = np.linalg.lstsq(np.column_stack([np.ones(60), x]), y, rcond=None)[0]
    assert v.group_variance == 0 and [rows["", "(Intercept)"].estimate, rows["", "x"].estimate] == pytest.approx(b) and rows["", "x"].df == 58


def test_sweep_is_one_model_per_key(spark):
    g, c, x, y = data(seed=5)
    df = frame(spark, g, c, x, y).selectExpr("g", "c", "x AS a", "-x AS b", "y")
    got = {r.predictor: r for r in M.model_sweep(df, [], ["a", "b"], "y", "g").collect()}
    assert got["a"].estimate == pytest.approx(-got["b"].estimate) and got["a"].p == pytest.approx(got["b"].p)
    assert M.model_sweep(df, [], ["a", "b"], "y", "g", alpha=0.05).count() == 2
    models = {n: M.RandomIntercept(df, "y", xs, "g", method="ml") for n, xs in (("with", ["a"]), ("without", []))}
    assert [r.model for r in M.aic_compare(models).collect()] == ["with", "without"]


def test_ols_equals_lstsq(spark):
    g, c, x, y = data(seed=6)
    z = np.random.default_rng(7).normal(size=len(x))
    df = spark.createDataFrame([(float(a), float(b), float(v)) for a, b, v in zip(x, z, y)], "x double, z double, y double")
    rows = {r.term: r for r in R.ols(df, [], ["x", "z"], "y").collect()}
    d = np.column_stack([np.ones_like(x), x, z])
    b, rss = np.linalg.lstsq(d, y, rcond=None)[:2]
    se = np.sqrt(rss[0] / (len(y) - 3) * np.diag(np.linalg.inv(d.T @ d)))
    assert [rows[t].estimate for t in ("(Intercept)", "x", "z")] == pytest.approx(list(b))
    assert [rows[t].se for t in ("(Intercept)", "x", "z")] == pytest.approx(list(se))
    assert rows["x"].p == pytest.approx(t_two_sided([b[1] / se[1]], [len(y) - 3])[0])
    one = R.ols_slopes(df, [], "x", "y").first()
    b1 = np.polyfit(x, y, 1)
    assert (one.slope, one.intercept) == pytest.approx(tuple(b1))
    band = R.prediction_band(R.ols_slopes(df, [], "x", "y"), [], 5).collect()
    assert len(band) == 5 and all(r.lower < r.fit < r.upper for r in band)


def test_cooks_distance_equals_deletion(spark):
    g, c, x, y = data(groups=5, per=4, seed=8)
    y[3] += 6
    got = sorted(((r.x, r.cooks, r.influential) for r in R.cooks_distance(frame(spark, g, c, x, y), "y", ["x"]).collect()))
    d = np.column_stack([np.ones_like(x), x])
    b = np.linalg.lstsq(d, y, rcond=None)[0]
    s2 = ((y - d @ b) ** 2).sum() / (len(y) - 2)
    want = []
    for i in range(len(y)):
        bi = np.linalg.lstsq(np.delete(d, i, 0), np.delete(y, i), rcond=None)[0]
        want.append((x[i], ((d @ (b - bi)) ** 2).sum() / (2 * s2)))
    assert [v for _, v, _ in got] == pytest.approx([v for _, v in sorted(want)])
    assert any(f for _, _, f in got)
    assert R.cooks_distance(frame(spark, g, c, x, y), "y", ["x"], "g").count() == 20
    far = R.cooks_distance(frame(spark, g, c, x + 1e7, y), "y", ["x"], "g", 0.4).collect()
    near = {round(r.y, 9): r.cooks for r in R.cooks_distance(frame(spark, g, c, x, y), "y", ["x"], "g", 0.4).collect()}
    assert all(r.cooks == pytest.approx(near[round(r.y, 9)], rel=1e-4) for r in far)


def test_logit_recovers(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=3000)
    y = (rng.random(3000) < 1 / (1 + np.exp(-(0.5 + 1.2 * x)))).astype(float)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    got = {r.term: r for r in R.presence_logit(df, "y", ["x"]).collect()}
    assert got["x"].estimate == pytest.approx(1.2, abs=0.2) and got["x"].p < 1e-6


def test_boxplot_and_histogram(spark):
    df = spark.createDataFrame([("a", float(v)) for v in [1, 2, 3, 4, 5, 100]], "k string, v double")
    s = Y.boxplot_stats(df, ["k"], "v")
    r = s.first()
    assert (r.low, r.q25, r.median, r.q75, r.high, r.outliers, r.n) == (1, 2.25, 3.5, 4.75, 5, 1, 6)
    assert [x.v for x in Y.boxplot_outliers(df, ["k"], "v", s).collect()] == [100.0]
    h = {r.bin: r["count"] for r in Y.histogram(df, "v", 10).collect()}
    assert h == {0: 5, 9: 1}


def test_ranges_grow_with_the_group(spark):
    """A group of a hundred times the rows has more ranges, no larger ones; equal values are one row."""
    big, small = 40_000, 400
    df = spark.range(big + small).select(F.when(F.col("id") < big, "big").otherwise("small").alias("k"), (F.col("id") * 7919 % 50_021).cast("double").alias("v"))
    df = df.unionByName(spark.range(5000).select(F.lit("big").alias("k"), F.lit(3.5).alias("v"))).repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        ranked = X.ordered_counts(df, ["k"], "v")
        work = ranked.groupBy("k", F.spark_partition_id().alias("p")).count().groupBy("k").agg(F.max("count").alias("m")).collect()
        assert max(r.m for r in work) < 2.5 * (big + small) / 16 * 2
        got = {r.k: r for r in X.quantiles(df, ["k"], "v", {"a": 0.1, "b": 0.5, "c": 1.0}).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    for k, part in df.toPandas().groupby("k"):
        assert (got[k].a, got[k].b, got[k].c) == pytest.approx(tuple(np.quantile(part.v, [0.1, 0.5, 1.0])))


def test_result_table_rounds_half_even(spark):
    t = spark.createDataFrame([("a", 0.0625)], "term string, estimate double")
    assert R.result_table([t, t], 3, {"estimate": "Estimate"}).first().Estimate == 0.062
