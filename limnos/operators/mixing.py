"""Source-mixing shares and their summaries."""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limnos.functions import columns as C
from limnos.operators.reshape import keep_groups, natural_join, wide
from limnos.session import spread

SOURCES = ["PERI", "ZOOP", "LEAF"]  # fixed values: the three sources


@lru_cache
def _lattice(k: int, steps: int) -> np.ndarray:
    """Evenly spread points inside the simplex of k shares."""
    cuts = np.array(list(combinations_with_replacement(range(steps + 1), k - 1)), float)
    edges = np.hstack([np.zeros((len(cuts), 1)), cuts, np.full((len(cuts), 1), steps)])
    return (np.diff(edges, axis=1) + 1 / k) / (steps + 1)


def _log_posterior(p, n, means, squares, mu, sd, shape, rate):
    """Log posterior of shares p (groups, points, sources), with the residual sd of each tracer summed out over a grid.

    n (groups), means and squares (groups, 2), mu and sd (groups, sources, 2).
    """
    with np.errstate(divide="ignore", invalid="ignore"):
        logs = np.log(p)
        total = -logs.sum(axis=2)
        z = logs - logs.mean(axis=2, keepdims=True)
        total -= 0.5 * (z ** 2).sum(axis=2)  # shares are a softmax of standard normal values
        size = n[:, None, None]
        for j in range(2):
            spread = np.maximum(np.sqrt(squares[:, j] / np.maximum(n, 2)), 1e-3)
            s = (spread[:, None] * np.geomspace(0.05, 4, 16))[:, None, :]
            v = np.einsum("gpk,gk->gp", p * p, sd[:, :, j] ** 2)[:, :, None] + s ** 2
            gap = squares[:, j, None] + n[:, None] * (means[:, j, None] - np.einsum("gpk,gk->gp", p, mu[:, :, j])) ** 2
            ll = -0.5 * size * np.log(v) - 0.5 * gap[:, :, None] / v + shape * np.log(s) - rate * s
            top = ll.max(axis=2)
            total += top + np.log(np.exp(ll - top[:, :, None]).sum(axis=2))
    return np.where((p > 0).all(axis=2), total, -np.inf)


def _shares(n, means, squares, mu, sd, shape, rate, steps, zooms):
    """Posterior (mean, sd, 2.5, 25, 50, 75, 97.5 %) per group and source, and effective numbers of points.

    A coarse lattice closes in on the mass, each group in a window of its own; a fine one over the last window gives the numbers.
    """
    groups, k = mu.shape[:2]
    coarse = max(steps * 2 // 5, 8)
    centre, size = np.full((groups, k), 1 / k), np.ones(groups)
    for zoom in range(zooms + 1):
        last = zoom == zooms
        lattice = _lattice(k, steps if last else coarse) - 1 / k
        p = centre[:, None, :] + size[:, None, None] * lattice[None]
        log = _log_posterior(p, n, means, squares, mu, sd, shape, rate)
        w = np.exp(log - log.max(axis=1, keepdims=True))
        w /= w.sum(axis=1, keepdims=True)
        mean = np.einsum("gp,gpk->gk", w, p)
        dev = np.sqrt(np.maximum(np.einsum("gp,gpk->gk", w, (p - mean[:, None, :]) ** 2), 0))
        wanted = np.maximum(10 * dev.max(axis=1), 3 * size / coarse)
        closer = wanted < 0.9 * size
        centre, size = np.where(closer[:, None], mean, centre), np.where(closer, wanted, size)
    out = np.empty((groups, k, 7))
    out[:, :, 0], out[:, :, 1] = mean, dev
    for j in range(k):
        order = np.argsort(p[:, :, j], axis=1)
        value, weight = np.take_along_axis(p[:, :, j], order, axis=1), np.take_along_axis(w, order, axis=1)
        reach = np.cumsum(weight, axis=1) - 0.5 * weight
        for i, q in enumerate((0.025, 0.25, 0.5, 0.75, 0.975)):
            right = np.clip((reach < q).sum(axis=1), 1, reach.shape[1] - 1)[:, None]
            lo, hi = (np.take_along_axis(reach, right - d, axis=1)[:, 0] for d in (1, 0))
            a, b = (np.take_along_axis(value, right - d, axis=1)[:, 0] for d in (1, 0))
            out[:, j, 2 + i] = a + (b - a) * np.clip(np.where(hi > lo, (q - lo) / np.where(hi > lo, hi - lo, 1), 0), 0, 1)
    return out, 1 / (w ** 2).sum(axis=1)


#: Groups whose lattices are one array.
GROUPS = 64


def mixing_proportions(mixtures: DataFrame, sources: DataFrame, community: str = "community", taxon: str = "group_name",
                       x: str = "iso1", y: str = "iso2", shape: float = 3.0, rate: float = 3 / 50, steps: int = 60,
                       zooms: int = 3) -> DataFrame:
    """(community, taxon, source, mean, sd, low, q25, median, q75, high, n, points) of the source shares.

    Measurements are summed to six numbers per community and taxon; the posterior of the shares (normal tracers,
    softmax-normal shares, gamma residual sd summed out) is then worked out on a lattice per group, which needs no
    chain. `points` is the effective number of lattice points. Communities without sources give no rows.
    """
    rows = mixtures.dropna(subset=[x, y])
    stats = rows.groupBy(community, taxon).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.avg(x).alias("m1"), F.avg(y).alias("m2"),
        (F.var_pop(x) * F.count(x)).alias("q1"), (F.var_pop(y) * F.count(y)).alias("q2"))
    listed = sources.dropna().groupBy(community).agg(F.array_sort(F.collect_list(
        F.struct("source", "mean_c", "sd_c", "mean_n", "sd_n"))).alias("s"))
    joined = spread(natural_join(stats, listed.where(F.size("s") > 1), "inner", [community]), community, taxon)

    @F.pandas_udf("array<array<double>>")
    def solve(n: pd.Series, m1: pd.Series, m2: pd.Series, q1: pd.Series, q2: pd.Series, mc: pd.Series, sc: pd.Series,
              mn: pd.Series, sn: pd.Series) -> pd.Series:
        out: list = [None] * len(n)
        many = mc.map(len).to_numpy()
        for k in np.unique(many):  # groups with as many sources
            for rows in np.array_split(np.flatnonzero(many == k), -(-int((many == k).sum()) // GROUPS)):
                each = lambda *columns: np.stack([np.stack(c.iloc[rows].to_numpy()) for c in columns], axis=-1)
                table, points = _shares(n.to_numpy(float)[rows], each(m1, m2), each(q1, q2), each(mc, mn), each(sc, sn), shape, rate, steps, zooms)
                for row, found in zip(rows, np.concatenate([table, np.repeat(points[:, None, None], k, axis=1)], axis=2).tolist()):
                    out[row] = found
        return pd.Series(out)

    solved = joined.withColumn("r", solve("n", "m1", "m2", "q1", "q2", "s.mean_c", "s.sd_c", "s.mean_n", "s.sd_n"))
    each = solved.select(community, taxon, "n", F.explode(F.arrays_zip(F.col("s.source").alias("source"), F.col("r"))).alias("e"))
    names = ["mean", "sd", "low", "q25", "median", "q75", "high", "points"]
    return each.select(community, taxon, F.col("e.source").alias("source"), "n", *[F.col("e.r")[i].alias(c) for i, c in enumerate(names)])


def with_order(shares: DataFrame, taxa: DataFrame, taxon: str = "group_name") -> DataFrame:
    """Order of each family, from the distinct usable families of the taxon table."""
    orders = taxa.where("FAMILY <> 'unidentified'").select(F.col("FAMILY").alias(taxon), "ORDER").distinct()
    return natural_join(shares, orders, "left", [taxon])


def complete_sources(shares: DataFrame, community: str = "community", sources: Sequence[str] = SOURCES) -> DataFrame:
    """Mean share in percent per community and source, for communities with all sources."""
    rows = keep_groups(shares.where(C.is_in("source", sources)), [community], C.n_distinct("source"), lambda n: n == len(sources))
    return rows.groupBy(community, "source").agg((F.avg("mean") * 100).alias("mean_share"))


def source_share_wide(summary: DataFrame, community: str = "community", sources: Sequence[str] = SOURCES) -> DataFrame:
    return wide(summary, [community], "source", "mean_share", sources)


def mixing_by_taxon(shares: DataFrame, families: Sequence[str], taxon: str = "group_name", more_than: int = 3,
                    sources: Sequence[str] = SOURCES) -> DataFrame:
    """Share rows of the listed families that have more than `more_than` rows."""
    rows = shares.where(C.is_in("source", sources) & C.not_in(taxon, ["INSECT"]) & C.is_in(taxon, families))
    return keep_groups(rows, [taxon], F.count(F.lit(1)), lambda n: n > more_than)
