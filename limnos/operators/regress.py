"""Ordinary least squares from sums, influence of rows, logistic regression, and frames and tables of results.

Rows are reduced to central moments with partial sums before any shuffle. Models with a random intercept are in `mixed`.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression

from limnos.functions import columns as C
from limnos.functions.special import t_critical, t_p_value, t_two_sided
from limnos.operators.mixed import RandomIntercept, freed_of_groups
from limnos.operators.reshape import keep_groups, long_predictors, natural_join, zscores


# --- ordinary least squares ----------------------------------------------------------------------

def ols_slopes(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """One-predictor model per key in closed form: intercept, slope, their SE, t, p, r2, n, sigma, AIC."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    s = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(x).alias("mx"), F.avg(y).alias("my"), F.min(x).alias("x_min"), F.max(x).alias("x_max"),
        F.var_pop(x).alias("vx"), F.var_pop(y).alias("vy"), F.covar_pop(x, y).alias("cxy"))
    n, sxx = F.col("n"), F.col("n") * F.col("vx")
    slope = F.try_divide(F.col("cxy"), F.col("vx"))
    rss = F.greatest(n * (F.col("vy") - slope * F.col("cxy")), F.lit(0.0))
    s = s.withColumns({"slope": slope, "rss": rss, "sxx": sxx})
    s = s.withColumns({"intercept": F.col("my") - F.col("slope") * F.col("mx"),
                       "sigma": F.sqrt(F.try_divide(F.col("rss"), n - 2)),
                       "r2": 1 - F.try_divide(F.col("rss"), n * F.col("vy"))})
    s = s.withColumns({"se": F.try_divide(F.col("sigma"), F.sqrt("sxx")),
                       "se_intercept": F.col("sigma") * F.sqrt(1 / n + F.try_divide(F.col("mx") * F.col("mx"), F.col("sxx")))})
    s = s.withColumns({"t": F.try_divide(F.col("slope"), F.col("se")), "df": n - 2,
                       "aic": n * (math.log(2 * math.pi) + F.log(F.col("rss") / n) + 1) + 6})
    return s.select(*keys, "n", "intercept", "slope", "se_intercept", "se", "t", "df", t_p_value("t", F.col("df").cast("double")).alias("p"),
                    "r2", "sigma", "aic", "mx", "sxx", "x_min", "x_max")


def ols(df: DataFrame, keys: Sequence[str], xs: Sequence[str], y: str) -> DataFrame:
    """(keys, term, estimate, se, t, df, p, r2, sigma, n, aic) of y on several predictors, from central moments."""
    used = [*xs, y]
    rows = df.dropna(subset=used).select(*keys, *used)
    q = len(xs)
    pairs = [(i, j) for i in range(q + 1) for j in range(i, q + 1)]
    s = rows.groupBy(*keys).agg(F.count(F.lit(1)).cast("double").alias("n"), F.array(*[F.avg(c) for c in used]).alias("m"),
                                F.array(*[F.covar_pop(used[i], used[j]) for i, j in pairs]).alias("c"))

    @F.pandas_udf("array<array<double>>")
    def solve(n: pd.Series, m: pd.Series, c: pd.Series) -> pd.Series:
        if not len(n):
            return pd.Series([], dtype=object)
        count, mean = n.to_numpy(float), np.stack(m.to_numpy())
        full = np.zeros((len(n), q + 1, q + 1))  # all keys of a batch at once
        moments = np.stack(c.to_numpy())
        for k, (i, j) in enumerate(pairs):
            full[:, i, j] = full[:, j, i] = moments[:, k] * count
        inverse = np.linalg.pinv(full[:, :q, :q])
        b = np.einsum("kij,kj->ki", inverse, full[:, :q, q])
        at, total = mean[:, :q], full[:, q, q]
        rss = np.maximum(total - (b * full[:, :q, q]).sum(axis=1), 0.0)
        free = count - q - 1
        with np.errstate(divide="ignore", invalid="ignore"):
            s2 = np.where(free > 0, rss / np.where(free > 0, free, 1), np.nan)
            est = np.column_stack([mean[:, q] - (b * at).sum(axis=1), b])
            diagonal = np.column_stack([1 / count + np.einsum("ki,kij,kj->k", at, inverse, at), np.einsum("kii->ki", inverse)])
            se = np.sqrt(s2[:, None] * diagonal)
            t = est / se
            aic = count * (np.log(2 * np.pi * rss / count) + 1) + 2 * (q + 2)
            r2 = np.where(total > 0, 1 - rss / np.where(total > 0, total, 1), np.nan)
        df_ = np.repeat(free[:, None], q + 1, axis=1)
        every = np.broadcast_to(np.stack([r2, np.sqrt(s2), count, aic], axis=1)[:, None, :], (len(n), q + 1, 4))
        out = np.concatenate([np.stack([est, se, t, df_, t_two_sided(t, df_)], axis=2), every], axis=2)
        return pd.Series(out.tolist())

    terms = F.array(F.lit("(Intercept)"), *[F.lit(x) for x in xs])
    each = s.select(*keys, F.explode(F.arrays_zip(terms.alias("term"), solve("n", "m", "c").alias("v"))).alias("e"))
    names = ["estimate", "se", "t", "df", "p", "r2", "sigma", "n", "aic"]
    return each.select(*keys, F.col("e.term").alias("term"), *[F.col("e.v")[i].alias(c) for i, c in enumerate(names)])


def ols_sweep(df: DataFrame, keys: Sequence[str], predictors: Sequence[str], y: str, alpha: float | None = None) -> DataFrame:
    """One-predictor models of y for every predictor (and key), in one job; optionally those with p below alpha."""
    out = ols_slopes(long_predictors(df, [*keys, y], predictors), ["predictor", *keys], "x", y)
    return out if alpha is None else out.where(F.col("p") < alpha)


def prediction_band(fits: DataFrame, keys: Sequence[str], n: int = 100, x: str = "x", z: float | None = 1.96) -> DataFrame:
    """Fitted line with its band on an even grid over the predictor, from `ols_slopes`.

    z gives the band's half width in SE; None takes the t quantile of each fit.
    """
    fits = fits.withColumn("__z", t_critical(F.col("df").cast("double")) if z is None else F.lit(z))
    grid = fits.withColumn(x, F.explode(C.even_grid("x_min", "x_max", n)))
    fit = F.col("intercept") + F.col("slope") * F.col(x)
    se = F.col("sigma") * F.sqrt(1 / F.col("n") + (F.col(x) - F.col("mx")) * (F.col(x) - F.col("mx")) / F.col("sxx"))
    return grid.select(*keys, x, fit.alias("fit"), (fit - F.col("__z") * se).alias("lower"), (fit + F.col("__z") * se).alias("upper"))


def prediction_at_means(df: DataFrame, keys: Sequence[str], xs: Sequence[str], y: str, term: str, n: int = 100,
                        z: float | None = None) -> DataFrame:
    """Fitted line of one predictor of a model on several, the others at their means, with its band.

    At the means of the others the line is mean(y) + b (x - mean(x)), with variance sigma^2 / n + se(b)^2 (x - mean(x))^2.
    """
    rows = df.dropna(subset=[*xs, y])
    key = [F.col(k) for k in keys]
    ends = rows.groupBy(*key).agg(F.avg(term).alias("mx"), F.avg(y).alias("my"), F.min(term).alias("x_min"), F.max(term).alias("x_max"))
    fit = ols(rows, keys, xs, y).where(F.col("term") == term).drop("term")
    fit = natural_join(fit, ends, "inner", keys) if keys else fit.withColumns(
        {c: ends.select(c).scalar() for c in ("mx", "my", "x_min", "x_max")})
    fit = fit.withColumn("__z", t_critical("df") if z is None else F.lit(z)).withColumn(term, F.explode(C.even_grid("x_min", "x_max", n)))
    gap = F.col(term) - F.col("mx")
    line = F.col("my") + F.col("estimate") * gap
    half = F.col("__z") * F.sqrt(F.col("sigma") * F.col("sigma") / F.col("n") + F.col("se") * F.col("se") * gap * gap)
    return fit.select(*keys, term, line.alias("fit"), (line - half).alias("lower"), (line + half).alias("upper"))


# --- influence -----------------------------------------------------------------------------------

def cooks_distance(df: DataFrame, y: str, xs: Sequence[str], group: str | None = None, ratio: float | None = None) -> DataFrame:
    """Leverage, Cook's distance and the flag D > 4 / n per row.

    With a group, the model has a random intercept (at the ratio of its variance to the residual one that is given or fits
    best): rows are first freed of the group part, which turns the model into ordinary least squares.
    """
    used = [*xs, y]
    rows = df.dropna(subset=[*used, *([group] if group else [])])
    names = {f"__x{i}": x for i, x in enumerate(xs)} | {"__y": y}
    middle = rows.agg(*[F.avg(c).alias(n) for n, c in names.items()]).first()
    cols = {"__1": F.lit(1.0), **{n: F.col(c).cast("double") - (middle[n] or 0.0) for n, c in names.items()}}
    rows = rows.withColumns(cols)
    if group:
        if ratio is None:
            found = RandomIntercept(df, y, xs, group).variances().first()
            ratio = found["group_variance"] / found["residual_variance"]
        rows = freed_of_groups(rows, list(cols), group, ratio)
    x = ["__1", *[f"__x{i}" for i in range(len(xs))]]
    every = [*x, "__y"]
    one = rows.agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col(a) * F.col(b)).alias(f"{a}{b}") for i, a in enumerate(every) for b in every[i:]]).first()
    m = np.array([[one[f"{a}{b}"] if f"{a}{b}" in one.asDict() else one[f"{b}{a}"] for b in every] for a in every])
    inverse = np.linalg.pinv(m[:-1, :-1])
    beta = inverse @ m[:-1, -1]
    n, p = one["n"], len(x)
    s2 = max(m[-1, -1] - beta @ m[:-1, -1], 0.0) / (n - p)
    residual = F.col("__y") - sum((F.col(c) * float(b) for c, b in zip(x[1:], beta[1:])), F.col(x[0]) * float(beta[0]))
    terms = [F.col(a) * F.col(b) * float(inverse[i, j]) for i, a in enumerate(x) for j, b in enumerate(x)]
    out = rows.withColumns({"leverage": sum(terms[1:], terms[0]), "__e": residual})
    d = F.col("__e") * F.col("__e") * F.col("leverage") / (p * s2 * (1 - F.col("leverage")) * (1 - F.col("leverage")))
    out = out.withColumn("cooks", d).withColumn("influential", F.col("cooks") > 4 / n)
    return out.drop(*cols, "__e")


# --- frames and tables ---------------------------------------------------------------------------

def regression_frame(responses: DataFrame, chemistry: DataFrame, on: Sequence[str], group: Sequence[str], unit: str, more_than: int,
                     scaled: Sequence[str], suffix: str = "") -> DataFrame:
    """Responses with the chemistry of their lake-season, groups seen in more than `more_than` units, z-scored columns."""
    rows = natural_join(responses, chemistry, "left", on)
    rows = keep_groups(rows, group, C.n_distinct(unit), lambda n: n > more_than)
    return zscores(rows, scaled, suffix)


def result_table(tables: Sequence[DataFrame], digits: int = 3, rename: dict[str, str] | None = None) -> DataFrame:
    """Coefficient tables as one, numbers rounded half to even, columns renamed."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    numeric = [f.name for f in out.schema.fields if f.dataType.simpleString() in ("double", "float")]
    return out.withColumns({c: C.round_even(c, digits) for c in numeric}).withColumnsRenamed(rename or {})


def tile_table(slopes: DataFrame, orders: DataFrame, digits: int = 2) -> DataFrame:
    """Family by metric slopes with a printed label and the order."""
    labels = slopes.withColumn("label", C.round_even("trend", digits))
    return natural_join(labels, orders.select(F.col("FAMILY").alias("family"), "ORDER").distinct(), "left", ["family"])


def presence_logit(df: DataFrame, y: str, xs: Sequence[str]) -> DataFrame:
    """Logistic regression by iterated weighted least squares: (term, estimate, se, z, p, aic)."""
    data = VectorAssembler(inputCols=list(xs), outputCol="__v").transform(df.dropna(subset=[y, *xs]))
    model = GeneralizedLinearRegression(featuresCol="__v", labelCol=y, family="binomial", link="logit", maxIter=50, tol=1e-10).fit(data)
    s = model.summary
    terms = [*xs, "(Intercept)"]
    rows = list(zip(terms, [*map(float, model.coefficients), float(model.intercept)], s.coefficientStandardErrors, s.tValues, s.pValues,
                    [float(s.aic)] * len(terms)))
    return df.sparkSession.createDataFrame(rows, "term string, estimate double, se double, z double, p double, aic double")
