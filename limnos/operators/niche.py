"""Isotopic niches: ellipses, posterior draws, areas, Layman metrics, overlap and contrasts."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from limnos.functions import columns as C
from limnos.operators.reshape import add_share, draw_interval, keep_groups, natural_join, wide
from limnos.session import spread

# Baseline sources that are a class of their own in overlap tables.
BASELINE_CLASSES = ["LEAF", "PERI", "FISH"]


def ellipse_stats(frame: DataFrame, keys: Sequence[str], x: str = "iso1", y: str = "iso2", more_than: int | None = None) -> DataFrame:
    """n, means, covariance, standard ellipse area and its small-sample form per group.

    `more_than` leaves out groups with so few rows or fewer, rows with a missing isotope counted (see
    isotopes.min_group_size), in the same pass.
    """
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    u, v = F.when(both, F.col(x)), F.when(both, F.col(y))
    s = frame.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("__all"), F.count(u).alias("n"), F.avg(u).alias("mean_x"), F.avg(v).alias("mean_y"),
        F.var_samp(u).alias("var_x"), F.covar_samp(u, v).alias("cov_xy"), F.var_samp(v).alias("var_y"))
    s = s.where((F.col("n") > 0) & (F.col("__all") > (0 if more_than is None else more_than))).drop("__all")
    det = F.col("var_x") * F.col("var_y") - F.col("cov_xy") * F.col("cov_xy")
    flat = det <= 1e-12 * F.col("var_x") * F.col("var_y")  # points on a line: no area, whatever the rounding
    s = s.withColumn("sea", math.pi * F.sqrt(F.when(flat, 0.0).otherwise(det)))
    return s.withColumn("seac", F.try_divide(F.col("sea") * (F.col("n") - 1), F.col("n") - 2))


def niche_draws(stats: DataFrame, keys: Sequence[str], draws: int = 4000, seed: int = 1, block: int = 500,
                prior_df: float = 2.0) -> DataFrame:
    """(keys, draw, mu_x, mu_y, s_xx, s_xy, s_yy): posterior draws of mean and covariance per group.

    Direct draws, no chain. On z-scores of the group, with an identity prior scale and a flat mean,
    inverse covariance ~ Wishart(prior_df + n - 1, (I + S)^-1) and mean | covariance ~ N(0, covariance / n); the
    draws are scaled back. Work is spread by (group, block of draws); each block's generator is seeded by a hash
    of (seed, keys, block), so results do not depend on the partitioning.
    """
    blocks = -(-draws // block)
    rows = stats.where("n > 2 AND var_x > 0 AND var_y > 0").select(
        *keys, "n", "mean_x", "mean_y", "var_x", "cov_xy", "var_y", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("__b"))
    text = F.concat_ws("\u0001", *[F.col(k).cast("string") for k in keys])
    rows = rows.withColumn("__seed", F.xxhash64(F.lit(seed), text, F.col("__b")))
    fields = ", ".join(f"{k} {stats.schema[k].dataType.simpleString()}" for k in keys)
    schema = f"{fields}, draw int, mu_x double, mu_y double, s_xx double, s_xy double, s_yy double"

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for first in range(0, len(batch), 64):
                yield _draw_blocks(batch.iloc[first:first + 64], keys, block, draws, prior_df)

    return spread(rows, *keys, "__b").mapInPandas(draw, schema)


def _draw_blocks(rows: pd.DataFrame, keys, block: int, draws: int, prior_df: float) -> pd.DataFrame:
    """Draws of several blocks as arrays (rows x draws); each block has a generator of its own, the algebra of 2 x 2 matrices is written out."""
    n, sx, sy = rows["n"].to_numpy(float)[:, None], np.sqrt(rows["var_x"].to_numpy())[:, None], np.sqrt(rows["var_y"].to_numpy())[:, None]
    c = (n - 1) * rows["cov_xy"].to_numpy()[:, None] / (sx * sy)  # I + S on z-scores is [[n, c], [c, n]]
    det = n * n - c * c
    r11 = np.sqrt(n / det)
    r21, r22 = -c / det / r11, np.sqrt(n / det - (c / det / r11) ** 2)
    a11, a22, a21, e0, e1 = (np.empty((len(rows), block)) for _ in range(5))
    for i, (seed, size) in enumerate(zip(rows["__seed"], rows["n"])):
        rng, df = np.random.default_rng(int(seed) & 0xFFFFFFFFFFFFFFFF), prior_df + size - 1
        a11[i], a22[i] = rng.chisquare(df, block), rng.chisquare(df - 1, block)
        a21[i], e0[i], e1[i] = rng.standard_normal((3, block))
    a11, a22 = np.sqrt(a11), np.sqrt(a22)
    h11, h21, h22 = r11 * a11, r21 * a11 + r22 * a21, r22 * a22  # root of the drawn inverse covariance
    w = (h11 * h22) ** 2
    s11, s12, s22 = (h21 ** 2 + h22 ** 2) / w, -h11 * h21 / w, h11 ** 2 / w
    l11 = np.sqrt(s11 / n)
    l21 = s12 / n / l11
    l22 = np.sqrt(np.maximum(s22 / n - l21 ** 2, 0))
    number = rows["__b"].to_numpy()[:, None] * block + np.arange(block)
    keep = (number < draws).ravel()
    out = {k: np.repeat(rows[k].to_numpy(), block) for k in keys}
    values = {"draw": number, "mu_x": rows["mean_x"].to_numpy()[:, None] + sx * l11 * e0, "mu_y": rows["mean_y"].to_numpy()[:, None] + sy * (l21 * e0 + l22 * e1),
              "s_xx": sx * sx * s11, "s_xy": sx * sy * s12, "s_yy": sy * sy * s22}
    return pd.DataFrame({**out, **{k: v.ravel() for k, v in values.items()}})[keep]


# --- areas ---------------------------------------------------------------------------------------

def ellipse_area(draws: DataFrame) -> DataFrame:
    """Ellipse area per draw."""
    return draws.withColumn("area", math.pi * F.sqrt(F.col("s_xx") * F.col("s_yy") - F.col("s_xy") * F.col("s_xy")))


def niche_area(draws: DataFrame, community: str = "community") -> DataFrame:
    """Ellipse area per draw, with the community's total in that draw and the share of it (reads the draws twice)."""
    return add_share(ellipse_area(draws), [community, "draw"], "area", "total_area", "relative_area")


def area_by_cluster(areas: DataFrame, community: str, cluster: str) -> DataFrame:
    """Mean over the groups of a community, then over communities: communities weigh the same."""
    rows = areas.where(F.col(cluster).isNotNull())
    per_community = rows.groupBy(community, cluster, "draw").agg(F.avg("area").alias("area"))
    return per_community.groupBy(cluster, "draw").agg(F.avg("area").alias("area"))


def area_by_group(areas: DataFrame, group: Sequence[str]) -> DataFrame:
    """Mean over communities per draw, then mean and 95 % interval over draws."""
    return areas.groupBy(*group, "draw").agg(F.avg("area").alias("area")).groupBy(*group).agg(*draw_interval("area"))


def seasonal_area_shift(areas: DataFrame, group: str, water: str, season: str) -> DataFrame:
    """Fall minus spring area per draw of groups seen in both seasons of a lake: median, 95 % interval, sign flag."""
    def of(which: str) -> Column:
        return F.max(F.when(F.col(season) == which, F.col("area")))

    both = areas.groupBy(group, water, "draw").agg(of("fall").alias("fall"), of("spring").alias("spring")).dropna()
    q = F.percentile(F.col("fall") - F.col("spring"), F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975)))
    out = both.groupBy(group, water).agg(q.alias("q")).select(group, water, F.col("q")[0].alias("low"), F.col("q")[1].alias("mid"), F.col("q")[2].alias("high"))
    return out.withColumn("sig", C.excludes_zero("low", "high"))


# --- Layman metrics ------------------------------------------------------------------------------

def hull_areas(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Areas of the convex hulls of many lists of points (rows; repeat a point to fill a row): wrapped all at once, a vertex per step."""
    rows = np.arange(len(x))
    start = np.lexsort((y, x), axis=1)[:, 0]
    x0, y0 = x[rows, start], y[rows, start]
    x, y = x - x0[:, None], y - y0[:, None]
    px, py = np.zeros(len(x)), np.zeros(len(x))
    area, open_ = np.zeros(len(x)), np.ones(len(x), bool)
    for _ in range(x.shape[1]):
        if not open_.any():
            break
        qx, qy = x[:, 0], y[:, 0]
        for j in range(1, x.shape[1]):  # the next vertex has all points on its left
            cross = (qx - px) * (y[:, j] - py) - (qy - py) * (x[:, j] - px)
            far = np.hypot(x[:, j] - px, y[:, j] - py) > np.hypot(qx - px, qy - py)
            here = (qx == px) & (qy == py)
            take = here | (cross < 0) | ((cross == 0) & far)
            qx, qy = np.where(take, x[:, j], qx), np.where(take, y[:, j], qy)
        area += np.where(open_, px * qy - py * qx, 0) / 2
        open_ &= (qx != 0) | (qy != 0)
        px, py = np.where(open_, qx, px), np.where(open_, qy, py)
    return np.abs(area)


@F.pandas_udf(T.DoubleType())
def hull_area(x: pd.Series, y: pd.Series) -> pd.Series:
    """Area of the convex hull of short lists of points."""
    out, size = np.zeros(len(x)), x.map(len).to_numpy()
    for n in np.unique(size[size > 2]):  # lists of one length are one array
        rows = np.flatnonzero(size == n)
        out[rows] = hull_areas(np.stack(x.iloc[rows].to_numpy()), np.stack(y.iloc[rows].to_numpy()))
    return pd.Series(out)


def layman(points: DataFrame, keys: Sequence[str], x: str = "iso1", y: str = "iso2", hull: bool = True) -> DataFrame:
    """Ranges, hull area TA, mean distance to centroid CD, mean and sd of nearest distances NND, SDNND per key.

    `points` has one row per key and group (a mean), so the array of a key is as long as its list of taxa.
    """
    p = F.collect_list(F.struct(F.col(x).alias("x"), F.col(y).alias("y")))
    rows = points.dropna(subset=[x, y]).groupBy(*keys).agg(
        (F.max(x) - F.min(x)).alias("dX_range"), (F.max(y) - F.min(y)).alias("dY_range"), F.avg(x).alias("__mx"),
        F.avg(y).alias("__my"), p.alias("p"))

    def mean_of(a: Column) -> Column:
        return F.try_divide(F.aggregate(a, F.lit(0.0), lambda s, v: s + v), F.size(a))

    to_centre = F.transform("p", lambda q: F.hypot(q["x"] - F.col("__mx"), q["y"] - F.col("__my")))
    nearest = F.transform("p", lambda a, i: F.array_min(F.transform("p", lambda b, j: F.when(
        i != j, F.hypot(a["x"] - b["x"], a["y"] - b["y"])))))
    rows = rows.withColumns({"CD": mean_of(to_centre), "__n": nearest}).withColumn("NND", mean_of(F.col("__n")))
    square = F.aggregate("__n", F.lit(0.0), lambda s, v: s + (v - F.col("NND")) * (v - F.col("NND")))
    rows = rows.withColumn("SDNND", F.when(F.size("__n") > 1, F.sqrt(square / (F.size("__n") - 1))))
    out = ["dX_range", "dY_range", "CD", "NND", "SDNND"]
    if hull:
        rows = rows.withColumn("TA", hull_area(F.col("p.x"), F.col("p.y")))
        out.insert(2, "TA")
    return rows.select(*keys, *out)


def layman_draws(draws: DataFrame, community: str = "community", hull: bool = True) -> DataFrame:
    """Layman metrics of every draw of the group means."""
    return layman(draws, [community, "draw"], "mu_x", "mu_y", hull)


def layman_by_cluster(metrics: DataFrame, clusters: DataFrame, areas: DataFrame, community: str, cluster: str) -> DataFrame:
    """(cluster, draw, metric, value): metrics averaged by cluster and draw, hull area left out, niche area added."""
    names = ["dX_range", "dY_range", "CD", "NND", "SDNND"]
    rows = natural_join(metrics, clusters.select(community, cluster).distinct(), "inner", [community]).where(F.col(cluster).isNotNull())
    long = rows.unpivot([cluster, "draw"], names, "metric", "value").groupBy(cluster, "draw", "metric").agg(F.avg("value").alias("value"))
    return long.unionByName(areas.select(cluster, "draw", F.lit("NicheArea").alias("metric"), F.col("area").alias("value")))


def interval_summary(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Mean with 2.5 % and 97.5 % of the draws."""
    return rows.groupBy(*keys).agg(*draw_interval(value))


def posterior_contrasts(rows: DataFrame, clusters: Sequence[str], metric: str = "metric", cluster: str = "cluster",
                        draw: str = "draw", value: str = "value", interval: str = "eti") -> DataFrame:
    """All cluster differences per metric: probability of direction, and the share of the 95 % interval's draws
    that lie within a tenth of the metric's sd around zero (both in percent).

    interval='eti' is the central interval, 'hdi' the shortest one.
    """
    sds = rows.groupBy(metric).agg((0.1 * F.stddev_samp(value)).alias("__r"))
    table = wide(rows, [metric, draw], cluster, value, list(clusters))
    pairs = [(a, b) for i, a in enumerate(clusters) for b in list(clusters)[i + 1:]]
    diffs = F.array(*[F.struct(F.lit(f"{a} - {b}").alias("contrast"), (F.col(str(a)) - F.col(str(b))).alias("diff")) for a, b in pairs])
    long = table.select(metric, F.explode(diffs).alias("d")).select(metric, "d.*").dropna()
    keys = [metric, "contrast"]
    if interval == "eti":
        q = F.percentile("diff", F.array(F.lit(0.025), F.lit(0.975)))
        ends = long.groupBy(*keys).agg(q[0].alias("__lo"), q[1].alias("__hi"))
    else:
        sorted_draws = long.groupBy(*keys).agg(F.array_sort(F.collect_list("diff")).alias("v"))  # a set number of draws
        span = F.ceil(0.95 * F.size("v")).cast("int")
        starts = F.sequence(F.lit(0), F.size("v") - span)
        best = F.array_min(F.transform(starts, lambda i: F.struct(
            (F.get("v", i + span - 1) - F.get("v", i)).alias("w"), F.get("v", i).alias("lo"), F.get("v", i + span - 1).alias("hi"))))
        ends = sorted_draws.select(*keys, best.alias("b")).select(*keys, F.col("b.lo").alias("__lo"), F.col("b.hi").alias("__hi"))
    long = natural_join(natural_join(long, ends, "inner", keys), sds, "inner", [metric])
    inside = F.when(F.col("diff").between(F.col("__lo"), F.col("__hi")),
                    F.col("diff").between(-F.col("__r"), F.col("__r")).cast("double"))
    share = lambda c: F.avg(c.cast("double"))
    return long.groupBy(*keys).agg((100 * F.avg(inside)).alias("rope_prop"),
                                   (100 * F.greatest(share(F.col("diff") > 0), share(F.col("diff") < 0))).alias("PD"))


# --- overlap -------------------------------------------------------------------------------------

def _circle_meets(m: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Angles (n, 4) where the unit circle meets the ellipses (x - c)' M (x - c) = 1; missing ones repeat another, or are NaN.

    On the circle the equation is a trigonometric polynomial of degree two, so a quartic in exp(i angle): its roots of size one, by
    the eigenvalues of companion matrices, sharpened by Newton steps.
    """
    m11, m12, m22 = m.T
    cx, cy = c.T
    px, py = m11 * cx + m12 * cy, m12 * cx + m22 * cy
    a0 = (m11 + m22) / 2 + cx * px + cy * py - 1
    a1, b1, a2, b2 = -2 * px, -2 * py, (m11 - m22) / 2, m12
    lead = (a2 - 1j * b2) / 2
    size = np.abs(a0) + np.abs(a1) + np.abs(b1) + np.abs(a2) + np.abs(b2)
    out = np.full((len(c), 4), np.nan)
    same = size < 1e-9 * (1 + (m11 + m22) / 2)  # one border: no single points
    round_ = (np.abs(lead) < 1e-9 * size) & ~same  # a circle: two angles at most
    length = np.hypot(a1, b1)
    with np.errstate(divide="ignore", invalid="ignore"):
        half = np.arccos(np.where(length > 0, -a0 / length, np.nan))
    middle = np.arctan2(b1, a1)
    out[round_, 0], out[round_, 1] = (middle + half)[round_], (middle - half)[round_]
    rest = np.flatnonzero(~round_ & ~same)
    if len(rest):
        frame = np.zeros((len(rest), 4, 4), complex)
        frame[:, 1:, :3] = np.eye(3)
        low = np.stack([np.conj(lead), (a1 + 1j * b1) / 2, a0.astype(complex), (a1 - 1j * b1) / 2], axis=1)
        frame[:, :, 3] = -low[rest] / lead[rest, None]
        roots = np.linalg.eigvals(frame)
        angle = np.angle(roots)
        k0, k1, l1, k2, l2, scale = (v[rest][:, None] for v in (a0, a1, b1, a2, b2, size))
        for _ in range(3):
            value = k0 + k1 * np.cos(angle) + l1 * np.sin(angle) + k2 * np.cos(2 * angle) + l2 * np.sin(2 * angle)
            slope = -k1 * np.sin(angle) + l1 * np.cos(angle) - 2 * k2 * np.sin(2 * angle) + 2 * l2 * np.cos(2 * angle)
            angle = angle - np.where(np.abs(slope) > 1e-9 * scale, np.clip(value / np.where(slope == 0, 1, slope), -0.1, 0.1), 0)
        value = k0 + k1 * np.cos(angle) + l1 * np.sin(angle) + k2 * np.cos(2 * angle) + l2 * np.sin(2 * angle)
        good = (np.abs(np.abs(roots) - 1) < 1e-3) & (np.abs(value) < 1e-10 * scale)
        out[rest] = np.where(good, angle, np.nan)
    first = np.where(np.isnan(out).all(axis=1), np.nan, np.nanmax(np.where(np.isnan(out), -np.inf, out), axis=1))
    return np.sort(np.where(np.isnan(out), first[:, None], out), axis=1)


def disc_share(m: np.ndarray, root: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Area that the unit disc has in common with ellipses of centre c, M (m11, m12, m22) and lower root (l11, l21, l22) of its inverse.

    The border of the common part is made of arcs of the circle inside the ellipse and arcs of the ellipse inside the circle;
    each adds the area that it sweeps about the origin (Green's theorem).
    """
    def inside_ellipse(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        dx, dy = x - c[:, :1], y - c[:, 1:]
        return m[:, :1] * dx * dx + 2 * m[:, 1:2] * dx * dy + m[:, 2:] * dy * dy < 1

    theta = _circle_meets(m, c)
    none = np.isnan(theta).any(axis=1)
    theta = np.where(none[:, None], 0.0, theta)
    step = np.diff(np.column_stack([theta, theta[:, :1] + 2 * np.pi]), axis=1)
    middle = theta + step / 2
    area = (step * inside_ellipse(np.cos(middle), np.sin(middle))).sum(axis=1) / 2
    # the same points as angles of the ellipse
    l11, l21, l22 = root.T[:, :, None]
    u = (np.cos(theta) - c[:, :1]) / l11
    phi = np.sort(np.arctan2((np.sin(theta) - c[:, 1:] - l21 * u) / l22, u), axis=1)
    turn = np.diff(np.column_stack([phi, phi[:, :1] + 2 * np.pi]), axis=1)

    def point(angle: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return c[:, :1] + l11 * np.cos(angle), c[:, 1:] + l21 * np.cos(angle) + l22 * np.sin(angle)

    x, y = point(phi + turn / 2)
    (x0, y0), (x1, y1) = point(phi), point(phi + turn)
    swept = (l11 * l22 * turn + c[:, :1] * (y1 - y0) - c[:, 1:] * (x1 - x0)) / 2
    area = area + (swept * (x * x + y * y < 1)).sum(axis=1)
    whole = np.pi * (root[:, 0] * root[:, 2])
    x, y = point(np.zeros((len(c), 1)))
    apart = np.where(((x * x + y * y) < 1 + 1e-9)[:, 0], whole, np.where(inside_ellipse(np.ones((len(c), 1)), np.zeros((len(c), 1)))[:, 0], np.pi, 0.0))
    return np.clip(np.where(none, apart, area), 0, np.minimum(whole, np.pi))


def _overlap_share(radius2: float):
    @F.pandas_udf("double")
    def share(m1x: pd.Series, m1y: pd.Series, a11: pd.Series, a12: pd.Series, a22: pd.Series,
              m2x: pd.Series, m2y: pd.Series, b11: pd.Series, b12: pd.Series, b22: pd.Series) -> pd.Series:
        one = [v.to_numpy(float) for v in (m1x, m1y, a11, a12, a22)]
        two = [v.to_numpy(float) for v in (m2x, m2y, b11, b12, b22)]
        swap = one[2] * one[4] - one[3] ** 2 > two[2] * two[4] - two[3] ** 2  # the smaller ellipse becomes the disc
        one, two = ([np.where(swap, b, a) for a, b in zip(one, two)], [np.where(swap, a, b) for a, b in zip(one, two)])
        with np.errstate(divide="ignore", invalid="ignore"):
            # x = mean + r L y turns ellipse 1 into the unit disc (L: lower root of its covariance)
            l11 = np.sqrt(one[2])
            l21, l22 = one[3] / l11, np.sqrt(one[2] * one[4] - one[3] ** 2) / l11
            turned = lambda x, y: (x / l11, (y - l21 * x / l11) / l22)
            c = np.column_stack(turned(two[0] - one[0], two[1] - one[1])) / np.sqrt(radius2)
            # lower root of ellipse 2 there: both columns of its own root, turned, and made lower again
            k11 = np.sqrt(two[2])
            k21, k22 = two[3] / k11, np.sqrt(two[2] * two[4] - two[3] ** 2) / k11
            (p, q), (r, t) = turned(k11, k21), turned(0.0, k22)
            s11, s12, s22 = p * p + r * r, p * q + r * t, q * q + t * t
            root = np.column_stack([np.sqrt(s11), s12 / np.sqrt(s11), np.abs(p * t - q * r) / np.sqrt(s11)])
            det = (p * t - q * r) ** 2
            m = np.column_stack([s22 / det, -s12 / det, s11 / det])
        whole = np.isfinite(m).all(axis=1) & np.isfinite(c).all(axis=1) & (root[:, 2] > 0)
        out = np.full(len(c), np.nan)
        both = disc_share(m[whole], root[whole], c[whole])
        out[whole] = both / (np.pi * (1 + root[whole, 0] * root[whole, 2]) - both)
        return pd.Series(out).astype("float64")

    return share


def ellipse_overlap(draws: DataFrame, community: str = "community", group: str = "group_name", p: float = 0.95) -> DataFrame:
    """(community, draw, pair members s1 < s2, overlap): shared area over joint area of p ellipses, for every draw given.

    One row per unordered pair of groups of a community, which is the result itself. The groups of a community and
    draw meet in one list, so the draws are made and shuffled once. Areas are exact, from the points where the two borders meet; an
    ellipse without area has no overlap (missing).
    """
    cols = ["mu_x", "mu_y", "s_xx", "s_xy", "s_yy"]
    listed = draws.groupBy(community, "draw").agg(F.array_sort(F.collect_list(F.struct(F.col(group).alias("g"), *cols))).alias("__g"))
    later = F.transform("__g", lambda a, i: F.transform(
        F.slice("__g", i + 2, F.size("__g")), lambda b: F.struct(a.alias("a"), b.alias("b"))))
    pairs = listed.select(community, "draw", F.explode(F.flatten(later)).alias("__p")).where("__p.a.g < __p.b.g")
    share = _overlap_share(-2 * math.log(1 - p))
    return pairs.select(community, "draw", F.col("__p.a.g").alias("s1"), F.col("__p.b.g").alias("s2"),
                        F.nanvl(share(*[F.col(f"__p.{side}.{c}") for side in "ab" for c in cols]), F.lit(None)).alias("overlap"))


def overlap_long(overlaps: DataFrame, community: str = "community", digits: int = 3) -> DataFrame:
    """Rounded overlaps with the sorted pair label, lake and season, and the class of each member; like pairs only."""
    def kind(c: str) -> Column:
        return F.when(C.is_in(c, BASELINE_CLASSES), F.col(c)).otherwise("macroinvert")

    s1, s2 = F.rtrim("s1"), F.rtrim("s2")
    rows = overlaps.withColumns({"s1": F.least(s1, s2), "s2": F.greatest(s1, s2)}).where("s1 <> 'ZOOP' AND s2 <> 'ZOOP'")
    rows = rows.withColumns({"pair": C.canonical_pair("s1", "s2"), "overlap": C.round_even("overlap", digits),
                             "water": C.separate(community, 1), "season": C.separate(community, 2),
                             "class1": kind("s1"), "class2": kind("s2")})
    return rows.where("class1 = class2 AND class1 = 'macroinvert'").distinct()


def overlap_by_cluster(rows: DataFrame, clusters: DataFrame, community: str = "community", cluster: str = "cluster") -> DataFrame:
    """Mean overlap per cluster with a 95 % interval: mean within a community, then over communities, per draw."""
    joined = natural_join(rows, clusters.select(community, cluster).distinct(), "left", [community]).where(F.col(cluster).isNotNull())
    per = joined.groupBy(community, cluster, "draw").agg(F.avg("overlap").alias("overlap"))
    return per.groupBy(cluster, "draw").agg(F.avg("overlap").alias("overlap")).groupBy(cluster).agg(*draw_interval("overlap"))


def overlap_season_shift(rows: DataFrame) -> DataFrame:
    """Spring minus fall overlap of pairs seen in both seasons of a lake: per lake, per pair, and the grand mean."""
    both = keep_groups(rows, ["water", "pair", "draw"], C.n_distinct("season"), lambda n: n > 1)

    def of(which: str) -> Column:
        return F.max(F.when(F.col("season") == which, F.col("overlap")))

    per_draw = both.groupBy("pair", "water", "draw").agg(of("fall").alias("fall"), of("spring").alias("spring"))
    lake = per_draw.groupBy("pair", "water").agg((C.strict_avg("spring") - C.strict_avg("fall")).alias("water_difference"), F.count(F.lit(1)).alias("__n"))
    pair_draw = per_draw.groupBy("pair", "draw").agg(C.strict_avg("spring").alias("s"), C.strict_avg("fall").alias("f"), F.count(F.lit(1)).alias("k"))
    # means over rows: a draw counts as often as it has lakes
    weighted = lambda c: F.sum(F.col(c) * F.col("k")) / F.sum("k")
    pair = pair_draw.groupBy("pair").agg((weighted("s") - weighted("f")).alias("overall_difference"))
    out = natural_join(lake, pair, "inner", ["pair"])
    grand = out.agg(F.sum(F.col("overall_difference") * F.col("__n")) / F.sum("__n")).scalar()
    return out.withColumn("overall_mean", grand).withColumn("pair", C.replace_first("pair", "_", " & ")).drop("__n")
