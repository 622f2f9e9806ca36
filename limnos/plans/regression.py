"""Registered queries on regressions and figure tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from limnos.functions import columns as C
from limnos.operators import mixed as M
from limnos.operators import niche as N
from limnos.operators import regress as R
from limnos.operators import reshape as X
from limnos.operators import summaries as Y
from limnos.operators.community import richness
from limnos.plans.isotopes import TROPHIC, mixtures, single, trophic_rows
from limnos.plans.registry import registry
from limnos.sources import domain as D

QUERIES, ORACLE, query = registry()
_F = lambda x: f"CAST(({x})::FLOAT AS DOUBLE)"

def _p_of(t: str, df: str) -> str:
    """Two-sided p of t in SQL: Simpson's rule over the density, in 1,000 steps."""
    return (f"1 - 2 * exp(lgamma((({df}) + 1) / 2.0) - lgamma(({df}) / 2.0)) / sqrt(({df}) * pi()) * least(abs({t}), 60) / 3000 * list_sum(list_transform(range(0, 1001), "
            f"lambda i: CASE WHEN i IN (0, 1000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * pow(1 + pow(least(abs({t}), 60) * i / 1000, 2) / ({df}), -(({df}) + 1) / 2.0)))")


_OLS = f"""WITH {D.SALES},
l AS (SELECT brand, y, predictor, x FROM sales UNPIVOT (x FOR predictor IN (quantity, discount, tax))),
s AS (SELECT predictor, brand, count(*) AS n, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, regr_r2(y, x) AS r2, regr_sxx(y, x) AS sxx,
             regr_syy(y, x) AS syy, regr_sxy(y, x) AS sxy, avg(x) AS mx, min(x) AS lo, max(x) AS hi FROM l GROUP BY 1, 2),
f AS (SELECT *, sqrt((syy - b * sxy) / (n - 2)) AS sigma FROM s)"""


@query("ols_sweep", _OLS + f"""
SELECT predictor, brand, n, {_F('a')} AS intercept, {_F('b')} AS slope, {_F('sigma * sqrt(1 / n + mx * mx / sxx)')} AS se_intercept, {_F('sigma / sqrt(sxx)')} AS se,
       {_F('b / (sigma / sqrt(sxx))')} AS t, n - 2 AS df, round({_p_of('b / (sigma / sqrt(sxx))', 'n - 2')}, 6) + 0 AS p, round(r2, 9) AS r2, {_F('sigma')} AS sigma, {_F('n * (ln(2 * pi()) + ln((syy - b * sxy) / n) + 1) + 6')} AS aic FROM f""")
def ols_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = R.ols_sweep(D.sales(spark, sf_dir), ["brand"], ["quantity", "discount", "tax"], "y")
    return single(out.select("predictor", "brand", "n", "intercept", "slope", "se_intercept", "se", "t", "df", (F.round("p", 6) + 0.0).alias("p"), F.round("r2", 9).alias("r2"),
                             "sigma", "aic"), "intercept", "slope", "se_intercept", "se", "t", "sigma", "aic")


@query("prediction_band", _OLS + f""",
g AS (SELECT *, lo + i * (hi - lo) / 99.0 AS x FROM f, (SELECT unnest(range(0, 100)) AS i) WHERE predictor = 'quantity')
SELECT brand, {_F('x')} AS x, {_F('a + b * x')} AS fit, {_F('a + b * x - 1.96 * sigma * sqrt(1.0 / n + (x - mx) * (x - mx) / sxx)')} AS lower,
       {_F('a + b * x + 1.96 * sigma * sqrt(1.0 / n + (x - mx) * (x - mx) / sxx)')} AS upper FROM g""")
def prediction_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    fits = R.ols_slopes(D.sales(spark, sf_dir), ["brand"], "quantity", "y")
    return single(R.prediction_band(fits, ["brand"]), "x", "fit", "lower", "upper")


@query("linear_trend")
def linear_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Y.linear_trend(D.sales(spark, sf_dir), ["flag"], "quantity", "y")


@query("ols_two_predictors", f"""WITH {D.SALES},
m AS (SELECT flag, count(*) AS n, avg(quantity) AS m1, avg(tax) AS m2, avg(y) AS my, var_pop(quantity) AS a, var_pop(tax) AS d, covar_pop(quantity, tax) AS b,
             covar_pop(quantity, y) AS u, covar_pop(tax, y) AS v, var_pop(y) AS w FROM sales GROUP BY 1),
c AS (SELECT *, (d * u - b * v) / (a * d - b * b) AS b1, (a * v - b * u) / (a * d - b * b) AS b2 FROM m),
e AS (SELECT flag, 'quantity' AS term, b1 AS estimate, (b1 * u + b2 * v) / w AS r2, sqrt(n * (w - b1 * u - b2 * v) / (n - 3) * d / (a * d - b * b) / n) AS se FROM c
      UNION ALL SELECT flag, 'tax', b2, (b1 * u + b2 * v) / w, sqrt(n * (w - b1 * u - b2 * v) / (n - 3) * a / (a * d - b * b) / n) FROM c)
SELECT flag, term, {_F('estimate')} AS estimate, {_F('se')} AS se, {_F('r2')} AS r2 FROM e""")
def ols_two_predictors(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = R.ols(D.sales(spark, sf_dir), ["flag"], ["quantity", "tax"], "y").where("term <> '(Intercept)'")
    return single(out.select("flag", "term", "estimate", "se", "r2"), "estimate", "se", "r2")


@query("prediction_at_means", f"""WITH {D.SALES},
m AS (SELECT flag, count(*) AS n, avg(quantity) AS m1, avg(tax) AS m2, avg(y) AS my, var_pop(quantity) AS a, var_pop(tax) AS d, covar_pop(quantity, tax) AS b,
             covar_pop(quantity, y) AS u, covar_pop(tax, y) AS v, var_pop(y) AS w, min(quantity) AS lo, max(quantity) AS hi FROM sales GROUP BY 1),
c AS (SELECT *, (d * u - b * v) / (a * d - b * b) AS b1, (a * v - b * u) / (a * d - b * b) AS b2 FROM m),
e AS (SELECT *, n * (w - b1 * u - b2 * v) / (n - 3) AS s2 FROM c),
g AS (SELECT *, lo + i * (hi - lo) / 49.0 AS x, sqrt(s2 / n + s2 * d / (a * d - b * b) / n * pow(lo + i * (hi - lo) / 49.0 - m1, 2)) AS se
      FROM e, (SELECT unnest(range(0, 50)) AS i))
SELECT flag, {_F('x')} AS quantity, {_F('my + b1 * (x - m1)')} AS fit, {_F('my + b1 * (x - m1) - 1.96 * se')} AS lower,
       {_F('my + b1 * (x - m1) + 1.96 * se')} AS upper FROM g""")
def prediction_at_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = R.prediction_at_means(D.sales(spark, sf_dir), ["flag"], ["quantity", "tax"], "y", "quantity", 50, 1.96)
    return single(out, "quantity", "fit", "lower", "upper")


@query("correlation_matrix", f"""WITH {D.SALES}
SELECT 'quantity' AS var1, 'quantity' AS var2, 1.0::DOUBLE AS r UNION ALL SELECT 'discount', 'discount', 1.0 UNION ALL SELECT 'tax', 'tax', 1.0
UNION ALL SELECT 'quantity', 'discount', round(corr(quantity, discount), 9) FROM sales UNION ALL SELECT 'quantity', 'tax', round(corr(quantity, tax), 9) FROM sales
UNION ALL SELECT 'discount', 'tax', round(corr(discount, tax), 9) FROM sales""")
def correlation_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.correlations(D.sales(spark, sf_dir), ["quantity", "discount", "tax"]).withColumn("r", F.round("r", 9))


@query("zscore_frame", """WITH s AS (SELECT avg(c_acctbal) AS m, stddev_samp(c_acctbal) AS s FROM customer)
SELECT c_custkey, round((c_acctbal - m) / s, 9) AS c_acctbal FROM customer, s""")
def zscore_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return X.zscores(rows, ["c_acctbal"]).withColumn("c_acctbal", F.round("c_acctbal", 9))


@query("regression_frame", f"""WITH {D.MIXTURES}, {D.CHEMISTRY},
a AS (SELECT "WATER", season, group_name, avg(iso1) AS v FROM mixtures WHERE group_name NOT IN ('LEAF', 'PERI', 'ZOOP', 'FISH') GROUP BY 1, 2, 3),
j AS (SELECT * FROM a LEFT JOIN chemistry USING ("WATER", season) WHERE group_name IN (SELECT group_name FROM a GROUP BY 1 HAVING count(DISTINCT "WATER") > 2)),
s AS (SELECT avg("DOC_update") AS m, stddev_samp("DOC_update") AS d FROM j)
SELECT "WATER", season, group_name, {_F('v')} AS v, round(("DOC_update" - m) / d, 9) AS "DOC_update" FROM j, s""")
def regression_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    responses = mixtures(spark, sf_dir).groupBy("WATER", "season", "group_name").agg(F.avg("iso1").alias("v"))
    out = R.regression_frame(responses, D.lake_chemistry(spark, sf_dir), ["WATER", "season"], ["group_name"], "WATER", 2, ["DOC_update"])
    return single(out.select("WATER", "season", "group_name", "v", F.round("DOC_update", 9).alias("DOC_update")), "v")


@query("cooks_distance", f"""WITH {D.SALES},
m AS (SELECT count(*) AS n, avg(quantity) AS mx, regr_sxx(y, quantity) AS sxx, regr_slope(y, quantity) AS b, regr_intercept(y, quantity) AS a,
      (regr_syy(y, quantity) - regr_slope(y, quantity) * regr_sxy(y, quantity)) / (count(*) - 2) AS s2 FROM sales),
r AS (SELECT brand, 1.0 / n + (quantity - mx) * (quantity - mx) / sxx AS h, y - a - b * quantity AS e, s2, n FROM sales, m),
d AS (SELECT *, e * e * h / (2 * s2 * (1 - h) * (1 - h)) AS cook FROM r)
SELECT brand, count(*) AS n, {_F('max(cook)')} AS worst, {_F('sum(h)')} AS leverage, count(*) FILTER (WHERE cook > 4.0 / n) AS influential FROM d GROUP BY 1""")
def cooks_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = R.cooks_distance(D.sales(spark, sf_dir), "y", ["quantity"])
    return single(out.groupBy("brand").agg(F.count(F.lit(1)).alias("n"), F.max("cooks").alias("worst"), F.sum("leverage").alias("leverage"),
                                           F.count(F.when(F.col("influential"), 1)).alias("influential")), "worst", "leverage")


@query("random_intercept")
def random_intercept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.RandomIntercept(D.sales(spark, sf_dir), "y", ["quantity"], "brand").coefficients().drop("cell")


@query("model_sweep")
def model_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.model_sweep(D.sales(spark, sf_dir), ["flag"], ["quantity", "discount", "tax"], "y", "brand")


def _trophic_chemistry(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = trophic_rows(spark, sf_dir).withColumns({"WATER": C.separate("community", 1), "season": C.separate("community", 2)})
    chemistry = D.lake_chemistry(spark, sf_dir).select("WATER", "season", "DOC_update", "DDO5")
    return X.zscores(X.natural_join(rows, chemistry, "left", ["WATER", "season"]), ["DOC_update", "DDO5"])


def _by_family(spark: SparkSession, sf_dir: str) -> M.RandomIntercept:
    return M.RandomIntercept(_trophic_chemistry(spark, sf_dir), "trophic_position_weighted", ["DOC_update"], "WATER", "FAMILY")


@query("family_slopes")
def family_slopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_family(spark, sf_dir).family_slopes("DOC_update", "DOC")


@query("season_contrasts")
def season_contrasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = trophic_rows(spark, sf_dir).withColumns({"WATER": C.separate("community", 1), "season": C.separate("community", 2)})
    both = X.keep_groups(rows, ["WATER", "FAMILY"], C.n_distinct("season"), lambda n: n > 1)
    both = both.withColumn("cell", F.concat_ws("|", "FAMILY", "season"))
    return M.RandomIntercept(both, "trophic_position_weighted", [], "WATER", "cell").pairwise_contrasts(within="|")


@query("family_means")
def family_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_family(spark, sf_dir).marginal_means()


@query("aic_compare")
def aic_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.sales(spark, sf_dir)
    return M.aic_compare({" + ".join(xs): M.RandomIntercept(rows, "y", xs, "brand", method="ml") for xs in (["quantity"], ["quantity", "tax"])})


@query("presence_logit")
def presence_logit(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = D.table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("double").alias("quality"))
    docs = D.table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") / 1000).alias("n_chars"))
    return R.presence_logit(labels.join(docs, "doc_id"), "quality", ["n_chars"])


@query("boxplot_stats", f"""WITH {D.SALES},
q AS (SELECT brand, quantile_cont(y, 0.25) AS q25, quantile_cont(y, 0.5) AS median, quantile_cont(y, 0.75) AS q75 FROM sales GROUP BY 1),
w AS (SELECT brand, y, q25, median, q75, y BETWEEN q25 - 1.5 * (q75 - q25) AND q75 + 1.5 * (q75 - q25) AS ok FROM sales JOIN q USING (brand))
SELECT brand, min(y) FILTER (WHERE ok) AS low, {_F('q25')} AS q25, {_F('median')} AS median, {_F('q75')} AS q75, max(y) FILTER (WHERE ok) AS high,
       count(*) FILTER (WHERE NOT ok) AS outliers, count(*) AS n FROM w GROUP BY brand, w.q25, w.median, w.q75""")
def boxplot_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return single(Y.boxplot_stats(D.sales(spark, sf_dir), ["brand"], "y"), "q25", "median", "q75")


@query("histogram", f"""WITH {D.SPECIMENS}, r AS (SELECT "WATER", "MONTH", count(DISTINCT "FAMILY")::DOUBLE AS v FROM specimens GROUP BY 1, 2),
s AS (SELECT min(v) AS lo, (max(v) - min(v)) / 30 AS w FROM r),
b AS (SELECT least(CAST(floor((v - lo) / w) AS BIGINT), 29) AS bin, lo, w FROM r, s)
SELECT bin, {_F('min(lo) + bin * min(w)')} AS lo, {_F('min(lo) + (bin + 1) * min(w)')} AS hi, count(*) AS count FROM b GROUP BY bin""")
def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = richness(D.specimens(spark, sf_dir), ["WATER", "MONTH"], "FAMILY")
    return single(Y.histogram(rows, "richness", 30), "lo", "hi")


@query("median_order", TROPHIC + f""" SELECT "FAMILY", {_F('median(w)')} AS median FROM tc GROUP BY 1""")
def median_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return single(Y.median_order(trophic_rows(spark, sf_dir), "FAMILY", "trophic_position_weighted"), "median")


@query("data_ellipse", f"""WITH {D.MIXTURES},
s AS (SELECT "WATER" AS water, season, count(*) AS n, avg(iso1) AS mx, avg(iso2) AS my, var_samp(iso1) AS vx, covar_samp(iso1, iso2) AS c, var_samp(iso2) AS vy
      FROM mixtures WHERE group_name NOT IN ('LEAF', 'PERI', 'ZOOP', 'FISH') AND iso1 IS NOT NULL AND iso2 IS NOT NULL GROUP BY 1, 2),
r AS (SELECT *, sqrt((n - 1) * (pow(0.6, -2.0 / (n - 1)) - 1)) AS r, 2 * pi() * i / 51 AS a, i FROM s, (SELECT unnest(range(0, 52)) AS i))
SELECT water, season, i AS point, round(mx + r * sqrt(vx) * cos(a), 7) AS x,
       round(my + r * (c / sqrt(vx) * cos(a) + sqrt(vy - c * c / vx) * sin(a)), 7) AS y FROM r""")
def data_ellipse(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = N.ellipse_stats(mixtures(spark, sf_dir), ["WATER", "season"])
    return Y.data_ellipse(stats, ["WATER", "season"]).select(
        F.col("WATER").alias("water"), "season", "point", F.round("x", 7).alias("x"), F.round("y", 7).alias("y"))


# --- mixed models at a given ratio of the variances: generalised least squares by the sweep operator ------------------

_RATIO = 0.5


def _swept(design: str, p: int = 2, reml: bool = True, ratio: str = "0.5") -> str:
    """Models at the ratio and two per cent to either side, from `design` (k, g, r, i, v): row r of key k and group g has v in column i.

    Column p + 1 is the response. Sweeping all p columns leaves the coefficients, less the inverse, and the residual sum; df are
    Satterthwaite's, from differences over the two sides; p values by Simpson's rule over the t density. Result `co`.
    """
    left = "CASE WHEN i = k AND j = k THEN -1 / m[k][k] WHEN i = k OR j = k THEN m[i][j] / m[k][k] ELSE m[i][j] - m[i][k] * m[k][j] / m[k][k] END"
    nested = f"list_transform(range(1, {p + 2}), lambda i: list_transform(range(1, {p + 2}), lambda j: {left.replace('k', 'step')}))"
    return f"""design AS ({design}),
rat AS (SELECT unnest([-1, 0, 1]) AS side, {ratio} * (1 + 0.02 * unnest([-1, 0, 1])) AS ratio),
size AS (SELECT k, g, count(DISTINCT r) AS n FROM design GROUP BY 1, 2),
tot AS (SELECT a.k, a.i, b.i AS j, sum(a.v * b.v) AS v FROM design a JOIN design b ON a.k = b.k AND a.r = b.r GROUP BY ALL),
gs AS (SELECT k, g, i, sum(v) AS s FROM design GROUP BY ALL),
off AS (SELECT side, a.k, a.i, b.i AS j, sum(ratio / (1 + n * ratio) * a.s * b.s) AS v FROM rat, gs a JOIN gs b ON a.k = b.k AND a.g = b.g
        JOIN size z ON z.k = a.k AND z.g = a.g GROUP BY ALL),
cell AS (SELECT rat.side, z.k, ij.i, ij.j, coalesce(t.v, 0) - coalesce(o.v, 0) AS v FROM rat, (SELECT DISTINCT k FROM size) z,
         (SELECT unnest(range(1, {p + 2})) AS i, j FROM (SELECT unnest(range(1, {p + 2})) AS j)) ij
         LEFT JOIN tot t ON t.k = z.k AND t.i = ij.i AND t.j = ij.j LEFT JOIN off o ON o.side = rat.side AND o.k = z.k AND o.i = ij.i AND o.j = ij.j),
mat AS (SELECT side, k, list(line ORDER BY i) AS m FROM (SELECT side, k, i, list(v ORDER BY j) AS line FROM cell GROUP BY ALL) GROUP BY ALL),
sw AS (WITH RECURSIVE s(side, k, step, m, logdet) AS (
         SELECT side, k, 0, m, 0.0::DOUBLE FROM mat
         UNION ALL SELECT side, k, step + 1, {nested.replace('step', '(step + 1)')}, logdet + ln(m[step + 1][step + 1]) FROM s WHERE step < {p})
       SELECT side, k, m, logdet FROM s WHERE step = {p}),
par AS (SELECT k, sum(n) AS n FROM size GROUP BY 1),
all3 AS (SELECT k, list(m ORDER BY side) AS m, list(logdet ORDER BY side) AS ld FROM sw GROUP BY 1),
lg3 AS (SELECT k, list(l ORDER BY side) AS lg FROM (SELECT k, side, sum(ln(1 + n * ratio)) AS l FROM size, rat GROUP BY ALL) GROUP BY 1),
v0 AS (SELECT k, par.n, m, m[2][{p + 1}][{p + 1}] AS rss, m[2][{p + 1}][{p + 1}] / (par.n - {p if reml else 0}) AS s2, 0.02 * {ratio} AS h, ld, lg,
              m[1][{p + 1}][{p + 1}] AS r1, m[3][{p + 1}][{p + 1}] AS r3 FROM all3 JOIN par USING (k) JOIN lg3 USING (k)),
v1 AS (SELECT *, -(n - {p}) / (s2 * s2) + 2 * rss / (s2 * s2 * s2) AS haa, -((r3 - r1) / (2 * h)) / (s2 * s2) AS hab,
              ((ld[3] + lg[3] + r3 / s2) - 2 * (ld[2] + lg[2] + rss / s2) + (ld[1] + lg[1] + r1 / s2)) / (h * h) AS hbb FROM v0)"""


def _contrast(rows: str) -> str:
    """Columns of the contrasts `rows` (k, name, l): estimate, SE, df, t and p."""
    form = "list_sum(list_transform(range(1, len(l) + 1), lambda i: l[i] * list_sum(list_transform(range(1, len(l) + 1), lambda j: l[j] * -m[{side}][i][j]))))"
    return f"""con AS ({rows}),
q AS (SELECT con.*, n, h, s2, haa, hab, hbb, list_sum(list_transform(range(1, len(l) + 1), lambda i: l[i] * m[2][i][len(l) + 1])) AS estimate,
             {form.format(side=2)} AS c0, s2 * ({form.format(side=3)} - {form.format(side=1)}) / (2 * h) AS g2 FROM con JOIN v1 USING (k)),
w AS (SELECT *, 2 * (c0 * c0 * hbb - 2 * c0 * g2 * hab + g2 * g2 * haa) / (haa * hbb - hab * hab) AS wobble FROM q),
d AS (SELECT *, sqrt(s2 * c0) AS se, CASE WHEN isfinite(wobble) AND wobble > 0 THEN 2 * pow(s2 * c0, 2) / wobble ELSE n - len(l) END AS df FROM w),
t AS (SELECT *, estimate / se AS t FROM d),
co AS (SELECT *, {_p_of('t', 'df')} AS p FROM t)"""


def _printed(design: str, p: int, names: str, group: str) -> str:
    """Least squares (ratio 0) with printed p, numbers to three digits; `names` lists the terms in the order of the columns."""
    unit = f"list_transform(range(1, {p + 1}), lambda i: CASE WHEN i = spot THEN 1.0 ELSE 0.0 END)"
    return f"""SELECT * FROM (WITH {_swept(design, p=p, ratio='0.0')},
yy AS (SELECT var_pop(v) * count(*) AS total FROM design WHERE i = {p + 1}),
{_contrast(f"SELECT 0 AS k, term, {unit} AS l FROM (SELECT unnest([{names}]) AS term, unnest(range(1, {p + 1})) AS spot)")}
SELECT term, round(estimate, 3) AS "Estimate", round(co.se, 3) AS se, round(t, 3) AS t, df::DOUBLE AS df, round(1 - v1.rss / total, 3) AS r2, round(sqrt(v1.s2), 3) AS sigma, v1.n::DOUBLE AS n,
       round(v1.n * (ln(2 * pi() * v1.rss / v1.n) + 1) + {2 * (p + 1)}, 3) AS aic, '{group}' AS "group",
       CASE WHEN round(p, 3) < 0.001 THEN '< .001' ELSE round(p, 3)::VARCHAR END AS p_label FROM co, v1, yy)"""


@query("result_table", f"""WITH {D.SALES} {_printed("SELECT 0 AS k, id AS g, id AS r, unnest([1, 2, 3, 4]) AS i, unnest([1.0, quantity, tax, y]) AS v FROM (SELECT *, row_number() OVER () AS id FROM sales)",
                                                   3, "'(Intercept)', 'quantity', 'tax'", "two")}
UNION ALL {_printed("SELECT 0 AS k, id AS g, id AS r, unnest([1, 2, 3]) AS i, unnest([1.0, discount, y]) AS v FROM (SELECT *, row_number() OVER () AS id FROM sales)",
                    2, "'(Intercept)', 'discount'", "one")}""")
def result_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = R.ols(D.sales(spark, sf_dir), [], ["quantity", "tax"], "y").withColumn("group", F.lit("two"))
    b = R.ols(D.sales(spark, sf_dir), [], ["discount"], "y").withColumn("group", F.lit("one"))
    return Y.printed_p(R.result_table([a, b], 3, {"estimate": "Estimate"})).drop("p")


@query("tile_table")
def tile_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _trophic_chemistry(spark, sf_dir)
    rows = X.long_predictors(rows, ["trophic_position_weighted", "WATER", "FAMILY"], ["DOC_update", "DDO5"])
    slopes = M.RandomIntercept(rows, "trophic_position_weighted", ["x"], "WATER", "FAMILY", ["predictor"]).family_slopes("x")
    slopes = slopes.withColumn("metric", F.col("predictor")).drop("predictor", "t", "p")
    return R.tile_table(slopes, D.taxon_frame(spark, sf_dir))


_PLAIN = "SELECT 0 AS k, brand AS g, id AS r, unnest([1, 2, 3]) AS i, unnest([1.0, quantity, y]) AS v FROM (SELECT *, row_number() OVER () AS id FROM sales)"
_UNITS = "SELECT k, 1 AS at, '(Intercept)' AS term, [1.0, 0.0] AS l FROM v1 UNION ALL SELECT k, 2, 'x', [0.0, 1.0] FROM v1"


def _rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) + 0.0 for c in columns})


@query("random_intercept_given", f"""WITH {D.SALES}, {_swept(_PLAIN)}, {_contrast(_UNITS)}
SELECT CASE term WHEN 'x' THEN 'quantity' ELSE term END AS term, round(estimate, 6) AS estimate, round(se, 6) AS se, round(df, 2) AS df, round(t, 5) AS t, round(p, 6) + 0 AS p FROM co""")
def random_intercept_given(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = M.RandomIntercept(D.sales(spark, sf_dir), "y", ["quantity"], "brand", ratio=_RATIO).coefficients().select("term", "estimate", "se", "df", "t", "p")
    return _rounded(_rounded(_rounded(out, 6, "estimate", "se", "p"), 5, "t"), 2, "df")


_SWEEP = """SELECT flag || '/' || predictor AS k, brand AS g, id AS r, unnest([1, 2, 3]) AS i, unnest([1.0, x, y]) AS v
FROM (SELECT *, row_number() OVER () AS id FROM sales) UNPIVOT (x FOR predictor IN (quantity, discount, tax))"""


@query("model_sweep_given", f"""WITH {D.SALES}, {_swept(_SWEEP)}, {_contrast(_UNITS)}
SELECT split_part(k, '/', 1) AS flag, split_part(k, '/', 2) AS predictor, round(estimate, 5) AS estimate, round(se, 5) AS se, round(df, 2) AS df, round(t, 5) AS t, round(p, 6) + 0 AS p
FROM co WHERE term = 'x'""")
def model_sweep_given(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = M.model_sweep(D.sales(spark, sf_dir), ["flag"], ["quantity", "discount", "tax"], "y", "brand", ratio=_RATIO)
    out = out.select("flag", "predictor", "estimate", "se", "df", "t", "p")
    return _rounded(_rounded(_rounded(out, 5, "estimate", "se", "t"), 6, "p"), 2, "df")


@query("variances_given", f"""WITH {D.SALES}, {_swept(_PLAIN)}
SELECT round({_RATIO} * s2, 5) AS group_variance, round(s2, 5) AS residual_variance, n, (SELECT count(DISTINCT brand) FROM sales) AS groups, CAST(4 AS INT) AS parameters,
       round((n - 2) * (ln(2 * pi() * rss / (n - 2)) + 1) + ld[2] + lg[2], 4) AS criterion, round((n - 2) * (ln(2 * pi() * rss / (n - 2)) + 1) + ld[2] + lg[2] + 8, 4) AS aic FROM v1""")
def variances_given(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = M.RandomIntercept(D.sales(spark, sf_dir), "y", ["quantity"], "brand", ratio=_RATIO).variances()
    return _rounded(_rounded(out, 5, "group_variance", "residual_variance"), 4, "criterion", "aic")


@query("aic_compare_given", f"""WITH {D.SALES}, {_swept(_PLAIN, reml=False)}
SELECT 'quantity' AS model, CAST(4 AS INT) AS parameters, round(n * (ln(2 * pi() * rss / n) + 1) + lg[2], 4) AS criterion,
       round(n * (ln(2 * pi() * rss / n) + 1) + lg[2] + 8, 4) AS aic FROM v1""")
def aic_compare_given(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = M.RandomIntercept(D.sales(spark, sf_dir), "y", ["quantity"], "brand", method="ml", ratio=_RATIO)
    return _rounded(M.aic_compare({"quantity": model}), 4, "criterion", "aic")


# three cells (flags) that share their groups (brands): six coefficients
_FLAGS = """SELECT 0 AS k, brand AS g, id AS r, unnest([2 * f - 1, 2 * f, 7]) AS i, unnest([1.0, quantity, y]) AS v
FROM (SELECT *, dense_rank() OVER (ORDER BY flag) AS f, row_number() OVER () AS id FROM sales)"""
_NAMES = "(SELECT DISTINCT flag, dense_rank() OVER (ORDER BY flag) AS f FROM sales)"
_ROW = "list_transform(range(1, 7), lambda i: CASE WHEN i = {at} THEN 1.0 ELSE 0.0 END)"


def _cells(spark: SparkSession, sf_dir: str) -> M.RandomIntercept:
    return M.RandomIntercept(D.sales(spark, sf_dir), "y", ["quantity"], "brand", "flag", ratio=_RATIO)


@query("family_slopes_given", f"""WITH {D.SALES}, {_swept(_FLAGS, p=6)}, {_contrast(f"SELECT 0 AS k, flag, {_ROW.format(at='2 * f')} AS l FROM {_NAMES}")}
SELECT flag AS family, round(estimate, 6) AS trend, round(se, 6) AS "SE", round(df, 2) AS df, round(t, 5) AS t, round(p, 6) + 0 AS p FROM co""")
def family_slopes_given(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _cells(spark, sf_dir).family_slopes("quantity").select("family", "trend", "SE", "df", "t", "p")
    return _rounded(_rounded(_rounded(out, 6, "trend", "SE", "p"), 5, "t"), 2, "df")


@query("family_means_given", f"""WITH {D.SALES}, {_swept(_FLAGS, p=6)},
{_contrast(f"SELECT 0 AS k, flag, list_transform(range(1, 7), lambda i: CASE WHEN i = 2 * f - 1 THEN 1.0 WHEN i = 2 * f THEN 20.0 ELSE 0.0 END) AS l FROM {_NAMES}")}
SELECT flag AS cell, round(estimate, 6) AS emmean, round(se, 6) AS "SE", round(df, 2) AS df FROM co""")
def family_means_given(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _cells(spark, sf_dir).marginal_means({"quantity": 20.0})
    return _rounded(_rounded(out.select("cell", "emmean", "SE", "df"), 6, "emmean", "SE"), 2, "df")


@query("family_contrasts_given", f"""WITH {D.SALES}, {_swept(_FLAGS, p=6)},
{_contrast(f"SELECT 0 AS k, a.flag AS one, b.flag AS two, list_transform(range(1, 7), lambda i: CASE WHEN i = 2 * a.f - 1 THEN 1.0 WHEN i = 2 * b.f - 1 THEN -1.0 ELSE 0.0 END) AS l FROM {_NAMES} a JOIN {_NAMES} b ON a.flag < b.flag")}
SELECT one AS first, two AS second, round(estimate, 6) AS estimate, round(se, 6) AS "SE", round(df, 2) AS df, round(t, 5) AS t, round(p, 6) + 0 AS p FROM co""")
def family_contrasts_given(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _cells(spark, sf_dir).pairwise_contrasts().select("first", "second", "estimate", "SE", "df", "t", "p")
    return _rounded(_rounded(_rounded(out, 6, "estimate", "SE", "p"), 5, "t"), 2, "df")


_TILE = """SELECT predictor AS k, brand AS g, id AS r, unnest([2 * f - 1, 2 * f, 7]) AS i, unnest([1.0, x, y]) AS v
FROM (SELECT *, dense_rank() OVER (ORDER BY flag) AS f, row_number() OVER () AS id FROM sales) UNPIVOT (x FOR predictor IN (quantity, tax))"""


@query("tile_table_given", f"""WITH {D.SALES}, {_swept(_TILE, p=6)},
{_contrast(f"SELECT pk.k, flag, {_ROW.format(at='2 * f')} AS l FROM {_NAMES}, (SELECT DISTINCT k FROM v1) pk")}
SELECT k AS metric, flag AS family, round(estimate, 5) AS trend, round(se, 5) AS "SE", round(df, 2) AS df, round(estimate, 2) AS label, 'O-' || lower(flag) AS "ORDER" FROM co""")
def tile_table_given(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.long_predictors(D.sales(spark, sf_dir), ["y", "brand", "flag"], ["quantity", "tax"])
    slopes = M.RandomIntercept(rows, "y", ["x"], "brand", "flag", ["predictor"], ratio=_RATIO).family_slopes("x").withColumn("metric", F.col("predictor"))
    orders = D.sales(spark, sf_dir).select(F.col("flag").alias("FAMILY"), F.concat(F.lit("O-"), F.lower("flag")).alias("ORDER"))
    out = R.tile_table(slopes, orders).select("metric", "family", "trend", "SE", "df", "label", "ORDER")
    return _rounded(_rounded(out, 5, "trend", "SE"), 2, "df")


@query("family_contrasts")
def family_contrasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_family(spark, sf_dir).pairwise_contrasts()


@query("cooks_mixed")
def cooks_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.cooks_distance(D.sales(spark, sf_dir), "y", ["quantity"], "brand")


@query("cooks_mixed_given", f"""WITH {D.SALES},
g AS (SELECT brand, 1 - 1 / sqrt(1 + count(*) * {_RATIO}) AS s, avg(quantity) AS mx, avg(y) AS my FROM sales GROUP BY 1),
z AS (SELECT brand, 1 - s AS u, quantity - s * mx AS x, y - s * my AS y FROM sales JOIN g USING (brand)),
m AS (SELECT count(*) AS n, sum(u * u) AS a, sum(u * x) AS b, sum(x * x) AS d, sum(u * y) AS e, sum(x * y) AS f, sum(y * y) AS w FROM z),
c AS (SELECT *, a * d - b * b AS det, (d * e - b * f) / (a * d - b * b) AS b1, (a * f - b * e) / (a * d - b * b) AS b2 FROM m),
r AS (SELECT brand, n, (u * u * d - 2 * u * x * b + x * x * a) / det AS h, z.y - u * b1 - x * b2 AS e, (w - b1 * c.e - b2 * f) / (n - 2) AS s2 FROM z, c),
k AS (SELECT brand, n, h, e * e * h / (2 * s2 * (1 - h) * (1 - h)) AS cook FROM r)
SELECT brand, count(*) AS n, round(max(cook), 8) AS worst, round(sum(h), 8) AS leverage, count(*) FILTER (WHERE cook > 4.0 / n) AS influential FROM k GROUP BY 1""")
def cooks_mixed_given(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = R.cooks_distance(D.sales(spark, sf_dir), "y", ["quantity"], "brand", _RATIO)
    return out.groupBy("brand").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("cooks"), 8).alias("worst"), F.round(F.sum("leverage"), 8).alias("leverage"),
                                    F.count(F.when(F.col("influential"), 1)).alias("influential"))


@query("presence_logit_two_valued", """WITH r AS (SELECT CAST(quality AS DOUBLE) AS y, CASE WHEN n_chars > 2000 THEN 1 ELSE 0 END AS x FROM labels JOIN documents USING (doc_id)),
k AS (SELECT count(*) FILTER (WHERE x = 1 AND y = 1) AS a, count(*) FILTER (WHERE x = 1 AND y = 0) AS b,
             count(*) FILTER (WHERE x = 0 AND y = 1) AS c, count(*) FILTER (WHERE x = 0 AND y = 0) AS d FROM r)
SELECT 'long' AS term, round(ln(a * d / (b * c)), 5) AS estimate, round(sqrt(1 / a + 1 / b + 1 / c + 1 / d), 5) AS se FROM k
UNION ALL SELECT '(Intercept)', round(ln(c / d), 5), round(sqrt(1 / c + 1 / d), 5) FROM k""")
def presence_logit_two_valued(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = D.table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("double").alias("quality"))
    docs = D.table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") > 2000).cast("double").alias("long"))
    out = R.presence_logit(labels.join(docs, "doc_id"), "quality", ["long"])
    return out.select("term", F.round("estimate", 5).alias("estimate"), F.round("se", 5).alias("se"))


@query("linear_trend_given", _OLS + f""",
g AS (SELECT *, lo + i * (hi - lo) / 79.0 AS x FROM f, (SELECT unnest(range(0, 80)) AS i) WHERE predictor = 'quantity')
SELECT brand, {_F('x')} AS quantity, {_F('a + b * x')} AS fit, {_F('a + b * x - 1.96 * sigma * sqrt(1.0 / n + (x - mx) * (x - mx) / sxx)')} AS lower,
       {_F('a + b * x + 1.96 * sigma * sqrt(1.0 / n + (x - mx) * (x - mx) / sxx)')} AS upper FROM g""")
def linear_trend_given(spark: SparkSession, sf_dir: str) -> DataFrame:
    return single(Y.linear_trend(D.sales(spark, sf_dir), ["brand"], "quantity", "y", z=1.96), "quantity", "fit", "lower", "upper")


@query("boxplot_outliers", f"""WITH {D.SALES}, r AS (SELECT brand, y * y * y AS v FROM sales),
q AS (SELECT brand, quantile_cont(v, 0.25) AS q25, quantile_cont(v, 0.75) AS q75 FROM r GROUP BY 1)
SELECT brand, round(v, 6) AS v FROM r JOIN q USING (brand) WHERE NOT (v BETWEEN q25 - 1.5 * (q75 - q25) AND q75 + 1.5 * (q75 - q25))""")
def boxplot_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.sales(spark, sf_dir).select("brand", (F.col("y") * F.col("y") * F.col("y")).alias("v"))
    return Y.boxplot_outliers(rows, ["brand"], "v", Y.boxplot_stats(rows, ["brand"], "v")).withColumn("v", F.round("v", 6))
