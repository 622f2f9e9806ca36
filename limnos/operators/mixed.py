"""Models with one random intercept, one per key, with or without cells; fitted and reported on the executors.

Rows become moments by key, group and cell. A group enters the criterion by its number of rows and the sums of its cells only, so
groups of one size and one set of cells are added up before they meet: what one task gets for a key grows with the cells, the
different sizes and the different sets of cells, not with rows or groups. The task fits the key and writes the rows of the report that
is asked for (coefficients, slopes, means, contrasts, variances), so neither models nor their matrices come to the driver.
Variables are centred by their means in the key; what is reported is turned back.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limnos.functions.special import t_quantile, t_two_sided
from limnos.operators.reshape import long_predictors, natural_join
from limnos.session import checkpointed

#: Bytes of group sums that a task keeps before it sends them on.
SUM_BYTES = 64 << 20
INTERCEPT = "(Intercept)"
ESTIMATE = "estimate double, se double, df double, t double, p double, low double, high double"


@dataclass
class Fit:
    """One key's model in the cells' own coefficients: an intercept and slopes for each cell."""

    cells: list[str]
    xs: list[str]
    beta: np.ndarray
    cov: np.ndarray
    gradient: np.ndarray  # derivatives of cov in the two variances
    spread: np.ndarray  # covariance of the two variances
    estimable: np.ndarray  # projection on what the rows determine
    sigma2: float
    tau2: float
    n: int
    rank: int
    groups: int
    criterion: float

    def contrasts(self, l: np.ndarray) -> dict[str, np.ndarray]:
        """estimate, se, df, t, p, low, high of each row of l; missing where the rows do not determine it."""
        known = np.abs(l @ self.estimable - l).max(axis=1, initial=0) < 1e-6 * np.maximum(np.abs(l).max(axis=1, initial=0), 1e-300)
        var = np.maximum(((l @ self.cov) * l).sum(axis=1), 0)
        df = np.full(len(l), float(self.n - self.rank))
        if self.tau2 > 0:  # Satterthwaite
            g = np.stack([((l @ d) * l).sum(axis=1) for d in self.gradient], axis=1)
            wobble = ((g @ self.spread) * g).sum(axis=1)
            df = np.where(wobble > 0, 2 * var ** 2 / np.where(wobble > 0, wobble, 1), df)
        with np.errstate(divide="ignore", invalid="ignore"):
            est, se = l @ self.beta, np.sqrt(var)
            t = est / se
            half = t_quantile(0.975, df) * se
            out = {"estimate": est, "se": se, "df": df, "t": t, "p": t_two_sided(t, df), "low": est - half, "high": est + half}
        return {k: np.where(known & np.isfinite(v), v, np.nan) for k, v in out.items()}

    def mean_rows(self, at: Mapping[str, float]) -> np.ndarray:
        """Contrast of each cell's fitted mean with the predictors at the given values (zero if not)."""
        return np.kron(np.eye(len(self.cells)), [1.0, *[at.get(x, 0.0) for x in self.xs]])


class _Profile:
    """Criterion of one model as a function of the variance ratio, from centred cross-products."""

    def __init__(self, full: np.ndarray, sizes: np.ndarray, times: np.ndarray, outer: np.ndarray, n: float, method: str):
        self.full, self.sizes, self.times, self.outer, self.n, self.method = full, sizes, times, outer, n, method
        self.rank = int(np.linalg.matrix_rank(full[:-1, :-1], hermitian=True))
        self.seen: dict[float, float] = {}

    def parts(self, r: float):
        """Inverse, coefficients, residual sum, log determinants of the design and of the groups at ratio r."""
        m = self.full - np.tensordot(r / (1 + self.sizes * r), self.outer, 1)
        a, b, c = m[:-1, :-1], m[:-1, -1], m[-1, -1]
        values, vectors = np.linalg.eigh(a)
        good = np.arange(len(values)) >= len(values) - self.rank
        inverse = (vectors[:, good] / values[good]) @ vectors[:, good].T
        beta = inverse @ b
        return inverse, beta, max(c - b @ beta, 1e-300), np.log(np.maximum(values[good], 1e-300)).sum(), float(self.times @ np.log1p(self.sizes * r))

    def value(self, r: float) -> float:
        if r not in self.seen:
            _, _, rss, design, groups = self.parts(r)
            if self.method == "ml":
                self.seen[r] = self.n * (math.log(2 * math.pi * rss / self.n) + 1) + groups
            else:
                df = self.n - self.rank
                self.seen[r] = df * (math.log(2 * math.pi * rss / df) + 1) + design + groups
        return self.seen[r]

    def best(self) -> float:
        """Least criterion: a grid that closes in, then the vertex of the parabola through the best ratio and its neighbours."""
        grid: Sequence[float] = [0.0, *np.geomspace(1e-4, 1e3, 15).tolist()]
        for _ in range(3):
            for r in grid:
                self.value(r)
            known = sorted(self.seen)
            i = min(range(len(known)), key=lambda k: self.seen[known[k]])
            grid = np.linspace(known[max(i - 1, 0)], known[min(i + 1, len(known) - 1)], 13).tolist()
        if i in (0, len(known) - 1):
            return known[i]
        near = np.array(known[i - 1:i + 2])
        a, b, _ = np.polyfit(near - known[i], [self.seen[k] for k in near.tolist()], 2)
        return float(np.clip(known[i] - b / (2 * a), near[0], near[2])) if a > 0 else known[i]


def _fitted(left: pa.Table, right: pa.Table, xs: list[str], method: str, ratio: float | None) -> Fit:
    """Fit one key from its cells' totals and its groups' sums."""
    q = 1 + len(xs)
    cells = left["__cell"].to_pylist()
    at = {c: i * q for i, c in enumerate(cells)}
    size = len(cells) * q + 1
    upper = [(i, j) for i in range(q + 1) for j in range(i, q + 1)]
    full = np.zeros((size, size))
    for cell, totals in zip(cells, left["__c"].to_pylist()):
        place = np.r_[at[cell] + np.arange(q), size - 1]
        for (i, j), v in zip(upper, totals):
            full[place[i], place[j]] += v
            if i != j:
                full[place[j], place[i]] += v
    sizes, which = np.unique(right["n"].to_numpy(), return_inverse=True)
    times, outer = np.zeros(len(sizes)), np.zeros((len(sizes), size, size))
    for k, own, count, raw in zip(which, right["cells"].to_pylist(), right["count"].to_pylist(), right["outer"].to_pylist()):
        place = np.r_[[at[c] + a for c in own for a in range(q)], size - 1].astype(int)
        outer[k][np.ix_(place, place)] += np.frombuffer(raw).reshape(len(place), -1)
        times[k] += count
    n = float(times @ sizes)
    model = _Profile(full, sizes, times, outer, n, method)
    r = model.best() if ratio is None else float(ratio)
    inverse, beta, rss, _, _ = model.parts(r)
    s2 = rss / (n if method == "ml" else n - model.rank) if n > model.rank else math.nan
    gradient, spread = np.zeros((2, size - 1, size - 1)), np.zeros((2, 2))
    if r > 0:
        h = 0.02 * r
        here, up, down = model.parts(r), model.parts(r + h), model.parts(r - h)
        f = [x[3] + x[4] + x[2] / s2 for x in (here, up, down)]
        rss1 = (up[2] - down[2]) / (2 * h)
        hessian = np.array([[-(n - model.rank) / s2 ** 2 + 2 * rss / s2 ** 3, -rss1 / s2 ** 2], [-rss1 / s2 ** 2, (f[1] - 2 * f[0] + f[2]) / h ** 2]])
        spread = 2 * np.linalg.pinv(hessian) if np.isfinite(hessian).all() else spread
        gradient = np.array([inverse, s2 * (up[0] - down[0]) / (2 * h)])
    # back from centred variables: intercept = mean of y + centred one - slopes x means
    means = np.array(left["__means"][0].as_py())
    turn = np.eye(size - 1)
    for c in at.values():
        turn[c, c + 1:c + q] = -means[:q - 1]
    a = full[:-1, :-1] - np.tensordot(r / (1 + sizes * r), outer, 1)[:-1, :-1]
    back = np.linalg.inv(turn)
    origin = np.zeros(size - 1)
    origin[list(at.values())] = means[-1]
    return Fit(cells, xs, turn @ beta + origin, s2 * turn @ inverse @ turn.T, np.array([turn @ d @ turn.T for d in gradient]), spread,
               turn @ inverse @ a @ back, float(s2), float(s2 * r), int(round(n)), model.rank, int(times.sum()), float(model.value(r)))


def _group_sums(q: int):
    """Rows (__k, n, cells: list of (cell, sums)) of groups, added up by key, size and set of cells."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[tuple, list] = {}
        size = 0

        def rows() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([
                pa.array([k for k, _, _ in kept], pa.string()), pa.array([n for _, n, _ in kept], pa.float64()), pa.array([list(c) for _, _, c in kept], pa.list_(pa.string())),
                pa.array([v[0] for v in kept.values()], pa.int64()), pa.array([v[1].tobytes() for v in kept.values()], pa.binary())], ["__k", "n", "cells", "count", "outer"])
            kept.clear()
            return out

        for batch in batches:
            for k, cells in zip(batch.column("__k").to_pylist(), batch.column("cells").to_pylist()):
                sums = np.array([c["s"] for c in cells])
                v = np.r_[sums[:, :q].ravel(), sums[:, q].sum()]
                name = k, float(sums[:, 0].sum()), tuple(c["cell"] for c in cells)
                if name not in kept:
                    kept[name] = [0, np.zeros((len(v), len(v)))]
                    size += 8 * len(v) ** 2
                kept[name][0] += 1
                kept[name][1] += np.outer(v, v)
                if size > SUM_BYTES:
                    yield rows()
                    size = 0
        yield rows()

    return run


class RandomIntercept:
    """Models y ~ cell x (1, xs) + (1 | group), one per key. With `cell`, each cell has its own intercept and slopes.

    The ratio of the group's to the residual variance is profiled, or given. Each report is one job over the sums.
    """

    def __init__(self, df: DataFrame, y: str, xs: Sequence[str], group: str, cell: str | None = None, keys: Sequence[str] = (),
                 method: str = "reml", ratio: float | None = None):
        self.xs, self.keys, self.method, self.ratio = list(xs), list(keys), method, ratio
        used = [*self.xs, y]
        rows = df.dropna(subset=[*used, group, *([cell] if cell else [])])
        level = F.col(cell).cast("string") if cell else F.lit("")
        key = F.to_json(F.struct(F.lit(0).alias("_"), *[F.col(k).cast("string").alias(k) for k in self.keys]), {"ignoreNullFields": "false"})
        width = len(used)
        pairs = [(i, j) for i in range(width) for j in range(i, width)]
        value = [F.col(c).cast("double") for c in used]
        sums = checkpointed(rows.groupBy(*self.keys, key.alias("__k"), F.col(group).alias("__g"), level.alias("__cell")).agg(
            F.count(F.lit(1)).cast("double").alias("__n"), F.array(*[F.avg(v) for v in value]).alias("__m"),
            F.array(*[F.covar_pop(value[i], value[j]) for i, j in pairs]).alias("__v")))
        middle = F.array(*[F.sum(F.col("__n") * F.col("__m")[i]) / F.sum("__n") for i in range(width)])
        sums = natural_join(sums, sums.groupBy("__k").agg(middle.alias("__means")), "inner", ["__k"])
        off = [F.col("__n") * (F.col("__m")[i] - F.col("__means")[i]) for i in range(width)]
        cross = [F.col("__n") * F.col("__v")[k] + off[i] * off[j] / F.col("__n") for k, (i, j) in enumerate(pairs)]
        sums = sums.withColumns({"__s": F.array(F.col("__n"), *off), "__c": F.array(F.col("__n"), *off, *cross)})
        many = 1 + width + len(pairs)
        self.totals = sums.groupBy(*self.keys, "__k", "__cell").agg(F.first("__means").alias("__means"), F.array(*[F.sum(F.col("__c")[i]) for i in range(many)]).alias("__c"))
        groups = sums.groupBy("__k", "__g").agg(F.sort_array(F.collect_list(F.struct(F.col("__cell").alias("cell"), F.col("__s").alias("s")))).alias("cells"))
        self.groups = groups.select("__k", "cells").mapInArrow(_group_sums(1 + len(self.xs)), "__k string, n double, cells array<string>, count long, outer binary")

    def report(self, rows: Callable[[Fit], dict[str, Sequence]], schema: str) -> DataFrame:
        """(keys, schema): what `rows` gives for each key's fit, as columns; NaN becomes missing."""
        xs, keys, method, ratio = self.xs, self.keys, self.method, self.ratio
        types = {k: self.totals.schema[k].dataType.simpleString() for k in keys}
        full = ", ".join([*[f"`{k}` {t}" for k, t in types.items()], schema])

        def solve(left: pa.Table, right: pa.Table) -> pa.Table:
            left = left.sort_by("__cell")
            out = rows(_fitted(left, right, xs, method, ratio))
            n = len(next(iter(out.values())))
            columns = {k: pa.chunked_array([left[k].combine_chunks().take(pa.array(np.zeros(n, int)))]) for k in keys}
            columns |= {k: pa.array(v, from_pandas=True) for k, v in out.items()}
            return pa.table(columns)

        left = self.totals.withColumn("__left", F.col("__k"))
        return left.groupBy("__left").cogroup(self.groups.groupBy("__k")).applyInArrow(solve, full)

    def coefficients(self) -> DataFrame:
        """(keys, cell, term, estimate, se, df, t, p, low, high)"""
        def rows(fit: Fit) -> dict:
            terms = [INTERCEPT, *fit.xs]
            return {"cell": [c for c in fit.cells for _ in terms], "term": terms * len(fit.cells), **fit.contrasts(np.eye(len(fit.beta)))}
        return self.report(rows, f"cell string, term string, {ESTIMATE}")

    def variances(self) -> DataFrame:
        """(keys, group_variance, residual_variance, n, groups, parameters, criterion, aic)"""
        def rows(fit: Fit) -> dict:
            k = fit.rank + 2
            return {"group_variance": [fit.tau2], "residual_variance": [fit.sigma2], "n": [fit.n], "groups": [fit.groups], "parameters": np.array([k], np.int32),
                    "criterion": [fit.criterion], "aic": [fit.criterion + 2 * k]}
        return self.report(rows, "group_variance double, residual_variance double, n long, groups long, parameters int, criterion double, aic double")

    def family_slopes(self, x: str, metric: str | None = None) -> DataFrame:
        """(keys, metric, family, trend, SE, df, lower_CL, upper_CL, t, p, sig): slope per cell, marked where the interval excludes 0."""
        def rows(fit: Fit) -> dict:
            q = 1 + len(fit.xs)
            c = fit.contrasts(np.eye(len(fit.beta))[1 + fit.xs.index(x)::q])
            return {"metric": [metric or x] * len(fit.cells), "family": fit.cells, "trend": c["estimate"], "SE": c["se"], "df": c["df"], "lower_CL": c["low"],
                    "upper_CL": c["high"], "t": c["t"], "p": c["p"], "sig": _marks(c)}
        return self.report(rows, "metric string, family string, trend double, SE double, df double, lower_CL double, upper_CL double, t double, p double, sig boolean")

    def marginal_means(self, at: Mapping[str, float] | None = None) -> DataFrame:
        """(keys, cell, emmean, SE, df, lower_CL, upper_CL): fitted mean of each cell, predictors at the given values (zero if not)."""
        def rows(fit: Fit) -> dict:
            c = fit.contrasts(fit.mean_rows(at or {}))
            return {"cell": fit.cells, "emmean": c["estimate"], "SE": c["se"], "df": c["df"], "lower_CL": c["low"], "upper_CL": c["high"]}
        return self.report(rows, "cell string, emmean double, SE double, df double, lower_CL double, upper_CL double")

    def pairwise_contrasts(self, at: Mapping[str, float] | None = None, within: str | None = None) -> DataFrame:
        """Differences of cell means with interval, p and Holm-adjusted p (over the pairs of a key).

        `within` is the separator of two-part cells ("family|season"): then only cells that share the first part.
        """
        def rows(fit: Fit) -> dict:
            means, part = fit.mean_rows(at or {}), [c.split(within)[0] if within else "" for c in fit.cells]
            first, second, found = [], [], []
            for i, a in enumerate(fit.cells):  # one cell against the later ones at a time
                other = [j for j in range(i + 1, len(part)) if part[j] == part[i]]
                if other:
                    first += [a] * len(other)
                    second += [fit.cells[j] for j in other]
                    found.append(fit.contrasts(means[i] - means[other]))
            c = {k: np.concatenate([f[k] for f in found]) if found else np.empty(0) for k in ("estimate", "se", "df", "t", "p", "low", "high")}
            order = np.argsort(c["p"], kind="stable")  # missing ones last
            known = int(np.isfinite(c["p"]).sum())
            holm = np.full(len(order), np.nan)
            holm[order[:known]] = np.minimum(1, np.maximum.accumulate((known - np.arange(known)) * c["p"][order[:known]]))
            return {"first": pa.array(first, pa.string()), "second": pa.array(second, pa.string()), "estimate": c["estimate"], "SE": c["se"], "df": c["df"], "t": c["t"], "p": c["p"],
                    "lower_CL": c["low"], "upper_CL": c["high"], "p_holm": holm, "sig": _marks(c)}
        return self.report(rows, "first string, second string, estimate double, SE double, df double, t double, p double, "
                                 "lower_CL double, upper_CL double, p_holm double, sig boolean")


def _marks(c: dict[str, np.ndarray]) -> pa.Array:
    return pa.array(np.sign(c["low"]) == np.sign(c["high"]), mask=~np.isfinite(c["low"]))


def model_sweep(df: DataFrame, keys: Sequence[str], predictors: Sequence[str], y: str, group: str, alpha: float | None = None,
                cell: str | None = None, ratio: float | None = None) -> DataFrame:
    """Random-intercept slope of y on each predictor (and key), all in one set of jobs; optionally p below alpha."""
    rows = long_predictors(df, [*keys, y, group, *([cell] if cell else [])], predictors)
    out = RandomIntercept(rows, y, ["x"], group, cell, ["predictor", *keys], ratio=ratio).coefficients().where("term = 'x'").drop("term")
    return out if alpha is None else out.where(F.col("p") < alpha)


def aic_compare(models: Mapping[str, RandomIntercept]) -> DataFrame:
    """(model, parameters, criterion, aic), best first; compare fits of the same method only."""
    tables = [m.variances().select(F.lit(name).alias("model"), "parameters", "criterion", "aic") for name, m in models.items()]
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out.orderBy("aic")


def freed_of_groups(df: DataFrame, columns: Sequence[str], group: str, ratio: float) -> DataFrame:
    """Columns less a share of their group mean: the random-intercept model at this ratio is least squares on them."""
    means = df.groupBy(group).agg(F.count(F.lit(1)).alias("__n"), *[F.avg(c).alias(f"__m{i}") for i, c in enumerate(columns)])
    share = 1 - 1 / F.sqrt(1 + F.col("__n") * ratio)
    rows = natural_join(df, means, "inner", [group])
    return rows.withColumns({c: F.col(c) - share * F.col(f"__m{i}") for i, c in enumerate(columns)}).drop("__n", *[f"__m{i}" for i in range(len(columns))])
