"""Joins, group values on rows, codes, scaling, ranks and quantiles.

Values of a group are put on its rows by aggregating first and joining the small result, never by a
window over the raw rows: one key may hold a large part of the table.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from limnos.session import checkpointed


def natural_join(left: DataFrame, right: DataFrame, how: str = "left", on: Sequence[str] | None = None) -> DataFrame:
    """Join on all common columns (or on `on`); missing matches missing."""
    keys = list(on) if on is not None else [c for c in left.columns if c in right.columns]
    if not keys:
        raise ValueError("no common columns to join on")
    renamed = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    condition = reduce(lambda a, b: a & b, [left[k].eqNullSafe(renamed[f"__r_{k}"]) for k in keys])
    joined = left.join(renamed, condition, how)
    if how in ("left_semi", "left_anti"):
        return joined
    return joined.drop(*[f"__r_{k}" for k in keys])


def lookup_join(df: DataFrame, table: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Left join to a dimension whose repeated rows are removed first, so rows do not fan out."""
    return natural_join(df, table.select(*keys, *values).distinct(), "left", keys)


def add_group_values(df: DataFrame, keys: Sequence[str], **aggregates: Column) -> DataFrame:
    """Put group aggregates on each row."""
    groups = df.groupBy(*keys).agg(*[a.alias(n) for n, a in aggregates.items()])
    return natural_join(df, groups, "inner", keys)


def keep_groups(df: DataFrame, keys: Sequence[str], value: Column, condition) -> DataFrame:
    """Rows of the groups whose aggregate `value` meets `condition`."""
    good = df.groupBy(*keys).agg(value.alias("__v")).where(condition(F.col("__v"))).select(*keys)
    return natural_join(df, good, "left_semi", keys)


def add_share(df: DataFrame, keys: Sequence[str], value: str, total: str, share: str) -> DataFrame:
    """Group total on each row and the row's share of it."""
    with_total = add_group_values(df, keys, **{total: F.sum(value)})
    return with_total.withColumn(share, F.try_divide(F.col(value), F.col(total)))


def factor_codes(df: DataFrame, name: str, code: str) -> DataFrame:
    """(name, code): codes 1, 2, ... in name order, over the distinct names of a dimension."""
    names = df.where(F.col(name).isNotNull()).select(name).distinct()
    return names.select(name, F.dense_rank().over(Window.orderBy(name)).alias(code))


def whole_frame(df: DataFrame, **aggregates: Column) -> Column:
    """Aggregates over the whole frame as one struct column (a scalar subquery, no join)."""
    return df.agg(F.struct(*[a.alias(n) for n, a in aggregates.items()]).alias("s")).scalar()


def zscores(df: DataFrame, columns: Sequence[str], suffix: str = "") -> DataFrame:
    """Scale columns to mean 0 and sample sd 1 over the whole frame."""
    wanted = {}
    for c in columns:
        wanted[f"m_{c}"] = F.avg(c)
        wanted[f"s_{c}"] = F.stddev_samp(c)
    stats = whole_frame(df, **wanted)
    return df.withColumn("__z", stats).withColumns({
        f"{c}{suffix}": F.try_divide(F.col(c) - F.col("__z")[f"m_{c}"], F.col("__z")[f"s_{c}"]) for c in columns
    }).drop("__z")


def wide(df: DataFrame, keys: Sequence[str], names: str, values: str, labels: Sequence[str], fill=None) -> DataFrame:
    """One column per label; the labels are given, so no job runs to find them."""
    table = df.groupBy(*keys).pivot(names, list(labels)).agg(F.first(values, ignorenulls=True))
    return table if fill is None else table.fillna(fill, subset=[str(x) for x in labels])


def long(df: DataFrame, keys: Sequence[str], columns: Sequence[str], names: str, values: str) -> DataFrame:
    return df.unpivot([F.col(k) for k in keys], [F.col(c).cast("double").alias(c) for c in columns], names, values)


def long_predictors(df: DataFrame, keep: Sequence[str], predictors: Sequence[str]) -> DataFrame:
    """One row per row and predictor: (keep, predictor, x). A loop over predictors becomes a key."""
    return df.unpivot(list(keep), [F.col(p).cast("double").alias(p) for p in predictors], "predictor", "x")


def top_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """First n rows per group; `order` must end in a tie-breaker. Spark limits each task's groups first."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")


def row_index(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "index") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Long correlation matrix in one pass; a column with a missing value has missing correlations."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    full = {c: F.count(F.lit(1)) == F.count(c) for c in columns}
    one = df.agg(*[F.when(full[a] & full[b], F.corr(a, b)).alias(f"{i}") for i, (a, b) in enumerate(pairs)])
    rows = F.array(*[F.struct(F.lit(a).alias("var1"), F.lit(b).alias("var2"), F.col(f"{i}").alias("r"))
                     for i, (a, b) in enumerate(pairs)])
    return one.select(F.explode(rows).alias("x")).select("x.*")


def ordered_counts(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Distinct values per group with their 0-based rank range [start, stop) and the group size n.

    Equal values are counted before the shuffle, so a value that many rows hold is one row. The rest is dealt into ranges of
    (keys, value) of about equal size, whatever the groups' sizes: a group has as many ranges as its number of values asks for.
    Ranges are ranked in separate tasks and put together by their counts.
    """
    keys = list(keys)
    counts = checkpointed(df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__c")))
    placed = checkpointed(counts.repartitionByRange(*keys, value).withColumn("__b", F.spark_partition_id()))
    sizes = placed.groupBy(*keys, "__b").agg(F.sum("__c").alias("__size"))
    group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))  # a row per group and range
    sizes = sizes.select(*keys, "__b", F.sum("__size").over(group).alias("n"),
                         (F.sum("__size").over(group.orderBy("__b")) - F.col("__size")).alias("__offset"))
    ranked = natural_join(placed, sizes, "inner", [*keys, "__b"])
    stop = F.col("__offset") + F.sum("__c").over(Window.partitionBy(*keys, "__b").orderBy(value))
    return ranked.withColumn("stop", stop).select(*keys, value, (F.col("stop") - F.col("__c")).alias("start"), "stop", "n")


def quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Exact quantiles per group with linear interpolation, for groups of any size."""
    return quantiles_of(ordered_counts(df, keys, value), keys, value, probs)


def quantiles_of(ranked: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Quantiles from `ordered_counts`."""
    at = {name: (F.col("n") - 1) * F.lit(p) for name, p in probs.items()}

    def pick(index: Column) -> Column:
        return F.max(F.when((F.col("start") <= index) & (index < F.col("stop")), F.col(value)))

    sums = []
    for name, h in at.items():
        sums += [pick(F.floor(h)).alias(f"__lo_{name}"), pick(F.ceil(h)).alias(f"__hi_{name}"),
                 F.max(h - F.floor(h)).alias(f"__w_{name}")]
    out = ranked.groupBy(*keys).agg(*sums)
    return out.select(*keys, *[
        (F.col(f"__lo_{n}") + F.col(f"__w_{n}") * (F.col(f"__hi_{n}") - F.col(f"__lo_{n}"))).alias(n) for n in probs])


def draw_interval(value, prefix: str = "", mean: bool = True) -> list[Column]:
    """Mean, 2.5 % and 97.5 % of the draws of a group; the number of draws is a set parameter."""
    q = F.percentile(value, F.array(F.lit(0.025), F.lit(0.975)))
    cols = [q[0].alias(f"{prefix}low"), q[1].alias(f"{prefix}high")]
    return ([F.avg(value).alias(f"{prefix}mean")] if mean else []) + cols


def fold_full_join(frames: Sequence[DataFrame]) -> DataFrame:
    """Frames with partly different columns as one long frame; missing columns are NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
