"""Tables behind the figures: box plots, histograms, trend lines and ellipses."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limnos.functions import columns as C
from limnos.operators.regress import ols_slopes, prediction_band
from limnos.operators.reshape import natural_join, ordered_counts, quantiles, quantiles_of, whole_frame


def boxplot_stats(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Quartiles, whiskers (last values within 1.5 IQR of the box) and number of outliers, per key."""
    ranked = ordered_counts(df, keys, value)  # distinct values with their counts: the raw rows are read once
    box = quantiles_of(ranked, keys, value, {"q25": 0.25, "median": 0.5, "q75": 0.75})
    iqr = F.col("q75") - F.col("q25")
    box = box.withColumns({"__lo": F.col("q25") - 1.5 * iqr, "__hi": F.col("q75") + 1.5 * iqr})
    inside = F.col(value).between(F.col("__lo"), F.col("__hi"))
    times = F.col("stop") - F.col("start")
    ends = natural_join(ranked.drop("n"), box, "inner", keys).groupBy(*keys, "q25", "median", "q75").agg(
        F.min(F.when(inside, F.col(value))).alias("low"), F.max(F.when(inside, F.col(value))).alias("high"),
        F.sum(F.when(~inside, times).otherwise(0)).alias("outliers"), F.sum(times).alias("n"))
    return ends.select(*keys, "low", "q25", "median", "q75", "high", "outliers", "n")


def boxplot_outliers(df: DataFrame, keys: Sequence[str], value: str, stats: DataFrame) -> DataFrame:
    """Rows beyond the whiskers."""
    rows = natural_join(df, stats.select(*keys, "low", "high"), "inner", keys)
    return rows.where((F.col(value) < F.col("low")) | (F.col(value) > F.col("high"))).drop("low", "high")


def histogram(df: DataFrame, value: str, bins: int = 30) -> DataFrame:
    """(bin, lo, hi, count) of equal bins over the range; the largest value falls in the last bin."""
    rows = df.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("v"))
    counts = rows.groupBy("v").agg(F.count(F.lit(1)).alias("c"))
    counts = counts.withColumn("s", whole_frame(counts, lo=F.min("v"), hi=F.max("v")))
    width = (F.col("s.hi") - F.col("s.lo")) / bins
    binned = counts.select("c", F.col("s.lo").alias("lo"), width.alias("w"), F.least(
        F.coalesce(F.floor(F.try_divide(F.col("v") - F.col("s.lo"), width)), F.lit(0)), F.lit(bins - 1)).alias("bin"))
    return binned.groupBy("bin").agg((F.min("lo") + F.col("bin") * F.min("w")).alias("lo"),
                                     (F.min("lo") + (F.col("bin") + 1) * F.min("w")).alias("hi"), F.sum("c").alias("count"))


def linear_trend(df: DataFrame, keys: Sequence[str], x: str, y: str, n: int = 80, z: float | None = None) -> DataFrame:
    """Least-squares line per key with its 95 % band on an even grid; z in place of the t quantile, if given."""
    return prediction_band(ols_slopes(df, keys, x, y), keys, n, x, z=z)


def data_ellipse(stats: DataFrame, keys: Sequence[str], level: float = 0.4, segments: int = 51) -> DataFrame:
    """Outline points of a data ellipse per key, from `ellipse_stats`; radius by the F quantile with 2 and n - 1 df."""
    rows = stats.where("n > 2 AND var_x > 0 AND var_y > 0")
    m = F.col("n") - 1
    radius = F.sqrt(m * (F.pow(F.lit(1 - level), -2 / m) - 1))  # sqrt(2 F), F in closed form for 2 df
    l11 = F.sqrt("var_x")
    l21 = F.col("cov_xy") / l11
    l22 = F.sqrt(F.greatest(F.col("var_y") - l21 * l21, F.lit(0.0)))
    rows = rows.select(*keys, "mean_x", "mean_y", radius.alias("r"), l11.alias("l11"), l21.alias("l21"), l22.alias("l22"),
                       F.explode(F.sequence(F.lit(0), F.lit(segments))).alias("point"))
    a = F.col("point") * (2 * math.pi / segments)
    return rows.select(*keys, "point", (F.col("mean_x") + F.col("r") * F.col("l11") * F.cos(a)).alias("x"),
                       (F.col("mean_y") + F.col("r") * (F.col("l21") * F.cos(a) + F.col("l22") * F.sin(a))).alias("y"))


def median_order(df: DataFrame, name: str, value: str) -> DataFrame:
    """Names with their median, for the order of an axis."""
    return quantiles(df, [name], value, {"median": 0.5})


def printed_p(df: DataFrame, p: str = "p") -> DataFrame:
    return df.withColumn("p_label", C.p_label(p))
