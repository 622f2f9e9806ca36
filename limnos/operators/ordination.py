"""Ordination by landmarks, stress, clusters of sites, hulls, environmental fits and permutation tests.

A full distance matrix is never formed. Every site is placed by its distances to a fixed number of landmark
sites; the landmark matrix and the coefficient tables are the only things that come to the driver.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from limnos.functions import columns as C
from limnos.operators.dissimilarity import choose_landmarks, presence_distance, site_sets
from limnos.operators.permutations import codes_of, label_codes, permutation_p, with_ranks
from limnos.operators.reshape import natural_join
from limnos.session import checkpointed, cores


# Printed names of environmental variables, and variables left out of the printed table.
METRIC_LABELS = {
    "richness": "Richness", "thermo_depth": "Thermocline Depth", "surface_area": "Surface Area", "max_depth": "Maximum Depth",
    "DDO5": "DD05", "TDO5": "TDO5 Depth", "sechi_depth": "Secchi Depth", "DOC_update": "DOC",
    "bottom": "Thermocline Bottom (m)", "mid_depth": "Thermocline Mid-depth (m)"}
METRICS_OUT = ["DOC.1", "thermo_temp"]


# --- sums of many numbers per task --------------------------------------------------------------

#: Permutations (or centres) whose sums travel in one row, sites that are moved at once, and places of a task's table.
PERM_CHUNK = 32
SITE_BATCH = 256
PLACES = 1 << 20


def _chunks(sums: np.ndarray) -> pa.RecordBatch:
    """Rows (part, w) of sums whose first index is the permutation or centre."""
    parts = [sums[i:i + PERM_CHUNK] for i in range(0, len(sums), PERM_CHUNK)]
    return pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([x.tobytes() for x in parts], pa.binary())], ["part", "w"])


def _by_chunk(rows: DataFrame, shape: tuple[int, ...], statistic, schema: str) -> DataFrame:
    """Add up the rows of `_chunks` and give statistic(first permutation, sums) as rows of the schema."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, total = None, None
        for batch in batches:
            for number, w in zip(batch.column("part").to_pylist(), batch.column("w").to_pylist()):
                now = np.frombuffer(w).reshape(-1, *shape)
                if number == part:
                    total = total + now
                else:
                    if part is not None:
                        yield statistic(part * PERM_CHUNK, total)
                    part, total = number, now
        if part is not None:
            yield statistic(part * PERM_CHUNK, total)

    return rows.repartition("part").sortWithinPartitions("part").mapInArrow(run, schema)


# --- ordination ----------------------------------------------------------------------------------

def landmark_distances(sets: DataFrame, site: str, marks: list[list[str]], method: str = "jaccard") -> DataFrame:
    """(site, d): distances of every site to the landmark taxon sets, as one array; a map without shuffle."""
    fixed = F.from_json(F.lit(json.dumps(marks)), "array<array<string>>")
    taxa = F.col("taxa").cast("array<string>")
    d = F.transform(fixed, lambda m: presence_distance(F.size(F.array_intersect(taxa, m)), F.col("n"), F.size(m), method))
    return sets.select(site, d.alias("d"))


def _squared(marks: list[list[str]], method: str) -> np.ndarray:
    """Squared distances of the landmarks."""
    known = [set(m) for m in marks]
    shared = np.array([[len(a & b) for b in known] for a in known], float)
    n = np.array([len(a) for a in known], float)
    both = n[:, None] + n[None, :]
    return ((both - 2 * shared) / (both if method == "bray" else both - shared)) ** 2


def _landmark_map(marks: list[list[str]], method: str, k: int):
    """Classical scaling of the landmark matrix and the linear map that places any other site."""
    d2 = _squared(marks, method)
    centre = np.eye(len(d2)) - 1 / len(d2)
    values, vectors = np.linalg.eigh(-0.5 * centre @ d2 @ centre)
    top = np.argsort(values)[::-1][:k]
    scale = np.sqrt(np.maximum(values[top], 1e-12))
    return -0.5 * (vectors[:, top] / scale).T, d2.mean(axis=0)


#: Distances are pooled to so many steps of dissimilarity.
STEPS = 10_000


def _steps(d: np.ndarray) -> np.ndarray:
    return np.floor(d * STEPS + 0.5).astype(np.int64)


def monotone_curve(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Places, values of the best rising curve there, and stress-1, from (number, sum, square sum) of distances by dissimilarity.

    Pool-adjacent-violators: neighbouring pools are joined as long as the earlier one has the higher mean.
    """
    at = np.flatnonzero(sums[:, 0])
    pools: list[list[float]] = []  # weight, sum, places
    for w, total in sums[at, :2].tolist():
        pools.append([w, total, 1])
        while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
            last = pools.pop()
            pools[-1] = [x + y for x, y in zip(pools[-1], last)]
    fit = np.repeat([t / w for w, t, _ in pools], [n for _, _, n in pools])
    w, total, square = sums[at].T
    off = (square - 2 * fit * total + w * fit * fit).sum()
    return at, fit, float(np.sqrt(max(off, 0.0) / square.sum())) if square.sum() else 0.0


class Ordination:
    """Sites placed by their distances to landmark sites, for several numbers of axes at once.

    Starts from landmark scaling; each round fits a monotone curve of distance on dissimilarity (pooled to 10,001 steps) and moves every
    site towards the fitted distances to the landmarks. The moves are known by the landmarks' places and the curve, and the landmarks are
    moved on the driver, so a site's place in any round follows from its row: a round is one pass that adds up distances, for
    all numbers of axes, and nothing is written in between. Rotation, reflection and local minima are arbitrary.
    """

    def __init__(self, presence: DataFrame, site: str, taxon: str, ks: Sequence[int], landmarks: int, rounds: int = 3, method: str = "jaccard"):
        self.site, self.ks, self.method, self.rounds = site, list(ks), method, rounds
        sets = checkpointed(site_sets(presence, [site], taxon).where("n > 0"))
        marks = [[str(t) for t in r["taxa"]] for r in choose_landmarks(sets, site, landmarks).collect()]
        self.landmarks = len(marks)
        self.rows = checkpointed(landmark_distances(sets, site, marks, method))
        self.start = {k: _landmark_map(marks, method, min(k, len(marks))) for k in self.ks}
        own = np.sqrt(_squared(marks, method))
        self.centres = {k: [(own ** 2 - self.start[k][1]) @ self.start[k][0].T] for k in self.ks}
        self.curves: dict[int, list] = {k: [] for k in self.ks}
        self.stress: dict[int, float] = {}
        for i in range(rounds + 1):
            for k, sums in zip(self.ks, self._pass()):
                at, fit, self.stress[k] = monotone_curve(sums)
                if i < rounds:
                    square, fit2 = sums[at, 2].sum(), (sums[at, 0] * fit * fit).sum()
                    curve = at, fit * (np.sqrt(square / fit2) if fit2 else 1.0)
                    self.curves[k].append(curve)
                    self.centres[k].append(_moved(own, self.centres[k][-1], self.centres[k][-1], curve))

    def _places(self):
        start, centres, curves = self.start, self.centres, self.curves

        def places(d: np.ndarray, k: int) -> np.ndarray:
            linear, mean2 = start[k]
            x = (d ** 2 - mean2) @ linear.T
            for around, curve in zip(centres[k], curves[k]):
                x = _moved(d, x, around, curve)
            return x
        return places

    def _pass(self) -> np.ndarray:
        """(k, step, 3): number, sum and square sum of the distances of all pairs of a site and a landmark by dissimilarity."""
        places, ks, centres, shape = self._places(), self.ks, self.centres, (STEPS + 1, 3)

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((len(ks), *shape))
            for batch in batches:
                for i in range(0, batch.num_rows, 1024):
                    d = _matrix(batch.column("d").slice(i, 1024))
                    step = _steps(d).ravel()
                    for k, out in zip(ks, sums):
                        gap = _gaps(places(d, k), centres[k][-1]).ravel()
                        for j, v in enumerate((np.ones_like(gap), gap, gap * gap)):
                            out[:, j] += np.bincount(step, v, STEPS + 1)
            for i, out in enumerate(sums):
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([out.tobytes()], pa.binary())], ["part", "w"])

        whole = lambda first, sums: pa.RecordBatch.from_arrays([pa.array([first // PERM_CHUNK]), pa.array([sums.tobytes()], pa.binary())], ["at", "w"])
        rows = _by_chunk(self.rows.select("d").mapInArrow(add, "part int, w binary"), shape, whole, "at long, w binary").collect()
        out = np.zeros((len(ks), *shape))
        for r in rows:  # 10,001 steps
            out[r["at"]] = np.frombuffer(r["w"]).reshape(shape)
        return out

    def sites(self, k: int) -> DataFrame:
        """(site, d, x): distances to the landmarks and coordinates."""
        places, name = self._places(), self.site

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                d = batch.column("d")
                x = places(_matrix(d), k) if len(d) else np.zeros((0, k))
                at = pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(name), d, pa.ListArray.from_arrays(at, pa.array(x.ravel()))], [name, "d", "x"])

        kind = self.rows.schema[name].dataType.simpleString()
        return self.rows.select(name, "d").mapInArrow(run, f"`{name}` {kind}, d array<double>, x array<double>")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _gaps(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.sqrt(((x[:, None, :] - centres[None]) ** 2).sum(axis=2))


def _moved(d: np.ndarray, x: np.ndarray, centres: np.ndarray, curve: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Places after a step of each site towards the fitted distances to the centres."""
    want = np.interp(_steps(d), *curve)
    step = x[:, None, :] - centres[None]
    gap = np.sqrt((step ** 2).sum(axis=2))
    ratio = np.where(gap > 1e-12, want / np.maximum(gap, 1e-12), 0.0)
    return (centres[None] + ratio[:, :, None] * step).mean(axis=1)


def ordinate(presence: DataFrame, site: str, taxon: str, k: int, landmarks: int, rounds: int = 3, method: str = "jaccard") -> tuple[DataFrame, float]:
    """Coordinates (site, d, x) whose distances follow the order of the dissimilarities, and their stress; see `Ordination`."""
    made = Ordination(presence, site, taxon, [k], landmarks, rounds, method)
    return made.sites(k), made.stress[k]


def stress_by_k(presence: DataFrame, site: str, taxon: str, ks: Sequence[int], landmarks: int, rounds: int = 3,
                method: str = "jaccard") -> DataFrame:
    """(k, landmark_stress, landmarks) for several numbers of axes: stress-1 over the pairs of a site and a landmark."""
    made = Ordination(presence, site, taxon, ks, landmarks, rounds, method)
    return presence.sparkSession.createDataFrame([(k, made.stress[k], made.landmarks) for k in ks], "k int, landmark_stress double, landmarks int")


def landmark_stress(distances: DataFrame, coords: DataFrame, site: str, axis: Sequence[str]) -> DataFrame:
    """(landmark_stress, pairs) of given coordinates over a table (site, landmark, d) of listed pairs."""
    at = coords.select(site, F.array(*[F.col(a).cast("double") for a in axis]).alias("__x"))
    marks = at.select(F.col(site).alias("landmark"), F.col("__x").alias("__y"))
    gap = F.sqrt(F.aggregate(F.zip_with("__x", "__y", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v))
    pairs = distances.where(F.col("d").isNotNull()).join(at, site).join(marks, "landmark").select(F.floor(F.col("d") * STEPS + 0.5).cast("int").alias("step"), gap.alias("gap"))
    sums = np.zeros((STEPS + 1, 3))
    for r in pairs.groupBy("step").agg(F.count(F.lit(1)).alias("n"), F.sum("gap").alias("s"), F.sum(F.col("gap") * F.col("gap")).alias("q")).collect():  # 10,001 steps
        sums[r["step"]] = r["n"], r["s"], r["q"]
    return distances.sparkSession.createDataFrame([(monotone_curve(sums)[2], int(sums[:, 0].sum()))], "landmark_stress double, pairs long")


def axes(sites: DataFrame, site: str, k: int, prefix: str = "MDS") -> DataFrame:
    return sites.select(site, *[F.col("x")[i].alias(f"{prefix}{i + 1}") for i in range(k)])


def taxon_scores(presence: DataFrame, coords: DataFrame, site: str, taxon: str, axis: Sequence[str],
                 weight: str | None = None) -> DataFrame:
    """Weighted mean position of the sites that hold each taxon."""
    w = F.lit(1.0) if weight is None else F.col(weight)
    rows = natural_join(presence, coords.select(site, *axis), "inner", [site])
    return rows.groupBy(taxon).agg(*[(F.sum(w * F.col(a)) / F.sum(w)).alias(a) for a in axis])


# --- clusters ------------------------------------------------------------------------------------

class KMeansSweep:
    """k-means for several numbers of clusters and restarts at once: each round is one pass over the sites.

    A task finds the nearest centre of every model for its sites and adds up numbers, coordinates and squared distances by centre;
    only sums by centre come to the driver. Starts are sites picked by a hash, or `centres` gives them ({k: list of models, each
    a list of k points}).
    """

    def __init__(self, coords: DataFrame, axis: Sequence[str], ks: Sequence[int], restarts: int = 10, seed: int = 1, rounds: int = 30,
                 centres: dict[int, list] | None = None):
        self.axis = list(axis)
        self.data = checkpointed(coords.withColumn("__x", F.array(*[F.col(a).cast("double") for a in axis])))
        one = self.data.agg(*[F.avg(a) for a in axis]).first()
        self.middle = np.array([m or 0.0 for m in one])
        if centres is None:
            centres = self._starts(ks, restarts, seed)
        self.models = [(k, i) for k in centres for i in range(len(centres[k]))]
        self.cuts = np.cumsum([0, *[k for k, _ in self.models]])
        self.centres = np.concatenate([np.asarray(centres[k][i], float).reshape(k, -1) for k, i in self.models]) - self.middle
        for _ in range(rounds):
            sums = self._pass()
            moved = np.where(sums[:, :1] > 0, sums[:, 2:] / np.maximum(sums[:, :1], 1), self.centres)  # an empty cluster stays
            same = np.abs(moved - self.centres).max(initial=0) <= 1e-9 * (1 + np.abs(moved).max(initial=0))
            self.centres = moved
            if same:
                break
        sums = self._pass()
        self.wss = [float(sums[a:b, 1].sum()) for a, b in zip(self.cuts, self.cuts[1:])]

    def _starts(self, ks: Sequence[int], restarts: int, seed: int) -> dict[int, list]:
        """Each restart takes its own sites from those with the least hashes: at most the greatest k times restarts."""
        different = self.data.where(F.forall("__x", lambda v: v.isNotNull())).select("__x").distinct()
        found = [r[0] for r in different.orderBy(F.xxhash64(F.lit(seed), "__x"), "__x").limit(max(ks) * restarts).collect()]
        if not found:
            raise ValueError("no site has coordinates")
        return {k: [[found[(i * max(ks) + j) % len(found)] for j in range(k)] for i in range(restarts if k > 1 else 1)] for k in ks}

    def _nearest(self):
        centres, cuts, middle = self.centres, self.cuts, self.middle
        square = (centres ** 2).sum(axis=1)

        def find(x: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
            """Per model its first centre, the nearest one of each site and the squared distance, for centred coordinates."""
            gap = (x ** 2).sum(axis=1)[:, None] - 2 * x @ centres.T + square
            for a, b in zip(cuts, cuts[1:]):
                near = gap[:, a:b].argmin(axis=1)
                yield a, near, np.maximum(gap[np.arange(len(x)), a + near], 0)

        def coordinates(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
            x = column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, len(middle)) - middle
            return x, ~np.isnan(x).any(axis=1)

        return find, coordinates

    def _pass(self) -> np.ndarray:
        """(number, squared distances, coordinates) summed by centre."""
        find, coordinates = self._nearest()
        shape = len(self.centres), len(self.middle) + 2

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros(shape)
            for batch in batches:
                for i in range(0, batch.num_rows, 2048):
                    x, whole = coordinates(batch.column("__x").slice(i, 2048))
                    x = x[whole]
                    columns = np.column_stack([np.ones(len(x)), np.zeros(len(x)), x])
                    for a, near, gap in find(x):
                        k = int(near.max(initial=-1)) + 1
                        sums[a:a + k] += (near[:, None] == np.arange(k)).T.astype(float) @ columns
                        sums[a:a + k, 1] += np.bincount(near, gap, k)
            yield _chunks(sums)

        whole = lambda first, sums: pa.RecordBatch.from_arrays([pa.array([first]), pa.array([sums.tobytes()], pa.binary())], ["first", "w"])
        rows = _by_chunk(self.data.select("__x").mapInArrow(add, "part int, w binary"), shape[1:], whole, "first long, w binary").collect()
        out = np.zeros(shape)
        for r in rows:  # a number per centre and axis
            part = np.frombuffer(r["w"]).reshape(-1, shape[1])
            out[r["first"]:r["first"] + len(part)] = part
        return out

    def best(self, k: int) -> int:
        """The model of k clusters with the least sum of squares."""
        return min((i for i, (own, _) in enumerate(self.models) if own == k), key=lambda i: self.wss[i])

    def clusters(self, k: int) -> DataFrame:
        """The sites with their `cluster` (1 .. k); one without coordinates has none."""
        i = self.best(k)
        a = self.cuts[i]
        centres = self.centres[a:a + k]
        _, coordinates = self._nearest()
        names = [c for c in self.data.columns if c != "__x"]

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x, whole = coordinates(batch.column("__x"))
                near = ((x ** 2).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres ** 2).sum(axis=1)).argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(near + 1, pa.int32(), mask=~whole)], [*names, "cluster"])

        schema = self.data.select(*names).schema
        return self.data.mapInArrow(assign, T.StructType([*schema.fields, T.StructField("cluster", T.IntegerType())]))


def cluster_sites(coords: DataFrame, axis: Sequence[str], k: int, restarts: int = 10, seed: int = 1, rounds: int = 30, centres: list | None = None) -> DataFrame:
    """k-means cluster (1 .. k) of each site, from the best of several starts (or from given centres)."""
    return KMeansSweep(coords, axis, [k], restarts, seed, rounds, None if centres is None else {k: [centres]}).clusters(k)


def elbow(coords: DataFrame, axis: Sequence[str], ks: Sequence[int] = tuple(range(1, 11)), restarts: int = 10, seed: int = 1,
          rounds: int = 30, centres: dict[int, list] | None = None) -> DataFrame:
    """(k, wss): smallest total within-cluster sum of squares per number of clusters; all of them in the same passes."""
    sweep = KMeansSweep(coords, axis, ks, restarts, seed, rounds, centres)
    return coords.sparkSession.createDataFrame([(k, sweep.wss[sweep.best(k)]) for k in ks], "k int, wss double")


def _hull(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Indices of the convex hull, counter-clockwise (sorted points, two chains)."""
    order = np.lexsort((y, x))
    chains = []
    for seq in (order, order[::-1]):
        chain = []
        for i in seq:
            while len(chain) > 1 and ((x[chain[-1]] - x[chain[-2]]) * (y[i] - y[chain[-2]])
                                      - (y[chain[-1]] - y[chain[-2]]) * (x[i] - x[chain[-2]])) <= 0:
                chain.pop()
            chain.append(i)
        chains.append(chain)
    both = chains[0][:-1] + chains[1][:-1]
    return np.array(list(dict.fromkeys(both)) if both else list(order[:1]), int)


def convex_hull(points: DataFrame, group: str, x: str, y: str) -> DataFrame:
    """(group, x, y, vertex): hull vertices in order. Each task keeps only the hull of its own rows before the shuffle."""
    rows = points.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(
        group, F.col(x).cast("double").alias(x), F.col(y).cast("double").alias(y))

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = {}
        for batch in batches:
            for g, part in batch.groupby(group, dropna=False):
                both = pd.concat([kept[g], part]) if g in kept else part
                kept[g] = both.iloc[_hull(both[x].to_numpy(), both[y].to_numpy())]
        yield from kept.values()

    def whole(part: pd.DataFrame) -> pd.DataFrame:
        part = part.drop_duplicates().reset_index(drop=True)
        out = part.iloc[_hull(part[x].to_numpy(), part[y].to_numpy())].copy()
        out["vertex"] = np.arange(1, len(out) + 1)
        return out

    schema = rows.schema.simpleString()[len("struct<"):-1]
    return rows.mapInPandas(local, rows.schema).groupBy(group).applyInPandas(whole, schema.replace(":", " ") + ", vertex int")


# --- permutations --------------------------------------------------------------------------------

def permanova_coordinates(coords: DataFrame, site: str, axis: Sequence[str], group: str, perms: int = 999, seed: int = 1,
                          blocks: Sequence[str] = (), ranks: DataFrame | None = None) -> DataFrame:
    """(f, p) of a grouping in ordination space, labels permuted (within blocks).

    A task finds its sites' labels in all permutations and adds up their coordinates per permutation and group; groups are few.
    `ranks` (perm, site, rank), perm from 1, takes the place of drawn permutations.
    """
    keys = [f"__b_{b}" for b in blocks]
    complete = coords.dropna(subset=list(axis))
    rows = complete.select(F.col(site).alias("__site"), F.col(group).alias("__group"), *[F.col(b).alias(k) for b, k in zip(blocks, keys)],
                           F.array(*[F.col(a).cast("double") for a in axis]).alias("__x"))
    rows, how = with_ranks(rows, "__site", perms, seed, keys, None if ranks is None else ranks.withColumnRenamed(site, "__site"))
    rows, labels = label_codes(rows, F.col("__group"), keys)
    middle = [m or 0.0 for m in complete.agg(*[F.avg(a) for a in axis]).first()]
    groups, width = len(labels), len(axis) + 2

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((how.perms + 1, groups, width))
        for batch in batches:
            for i in range(0, batch.num_rows, SITE_BATCH):
                part = batch.slice(i, SITE_BATCH)
                x = part.column("__x").flatten().to_numpy(zero_copy_only=False).reshape(len(part), -1) - middle
                x = np.column_stack([np.ones(len(x)), (x * x).sum(axis=1), x])
                codes = codes_of(how.of(part.column("__ranks")), part.column("__code"), part.column("__stops"))
                for g in range(groups):
                    sums[:, g] += (codes == g).T.astype(float) @ x
        yield _chunks(sums)

    def ratio(first: int, sums: np.ndarray) -> pa.RecordBatch:
        n, square, total = sums[..., 0], sums[..., 1].sum(axis=1), sums[..., 2:].sum(axis=1)
        between = ((sums[..., 2:] ** 2).sum(axis=2) / np.maximum(n, 1)).sum(axis=1) - (total ** 2).sum(axis=1) / n.sum(axis=1)
        whole = square - (total ** 2).sum(axis=1) / n.sum(axis=1)
        with np.errstate(divide="ignore", invalid="ignore"):
            f = (between / (groups - 1)) / ((whole - between) / (n.sum(axis=1) - groups))
        return pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + len(f)), pa.int32()), pa.array(f, from_pandas=True)], ["perm", "f"])

    laid = rows.select("__x", "__ranks", "__code", "__stops").repartition(cores(rows), F.xxhash64("__x"))
    found = _by_chunk(laid.mapInArrow(add, "part int, w binary"), (groups, width), ratio, "perm int, f double")
    return permutation_p(checkpointed(found), "f")


def _fit_sums(rows: DataFrame, keys: Sequence[str], x: str, y: str, v: str) -> DataFrame:
    """(keys, r2, a1, a2): multiple r^2 and unit direction of v on two axes."""
    complete = rows.where(F.col(v).isNotNull() & F.col(x).isNotNull() & F.col(y).isNotNull())
    s = complete.groupBy(*keys).agg(
        F.covar_samp(x, v).alias("xv"), F.covar_samp(y, v).alias("yv"), F.covar_samp(x, y).alias("xy"),
        F.var_samp(x).alias("xx"), F.var_samp(y).alias("yy"), F.var_samp(v).alias("vv"))
    det = F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy")
    b1 = F.try_divide(F.col("xv") * F.col("yy") - F.col("yv") * F.col("xy"), det)
    b2 = F.try_divide(F.col("yv") * F.col("xx") - F.col("xv") * F.col("xy"), det)
    fit = s.withColumns({"b1": b1, "b2": b2})
    length = F.sqrt(F.col("b1") * F.col("b1") + F.col("b2") * F.col("b2"))
    r2 = F.try_divide(F.col("b1") * F.col("xv") + F.col("b2") * F.col("yv"), F.col("vv"))
    return fit.select(*keys, r2.alias("r2"), F.try_divide(F.col("b1"), length).alias("a1"), F.try_divide(F.col("b2"), length).alias("a2"))


def envfit(coords: DataFrame, env: DataFrame, site: str, x: str, y: str, metric: str = "metric", value: str = "value",
           perms: int = 0, seed: int = 1, ranks: DataFrame | None = None) -> DataFrame:
    """(metric, r2, a1, a2[, p]): fit of each environmental variable (long form) to the first two axes.

    A site may have a variable several times or not at all; its values go together when sites are permuted. `ranks` (perm, site, rank)
    takes the place of drawn permutations: perm 0 numbers the sites, and in a permutation a site takes the place of the
    site whose number is its rank; every site with values and coordinates must be in every permutation.
    """
    rows = natural_join(env, coords.select(site, x, y), "inner", [site])
    fit = _fit_sums(rows, [metric], x, y, value)
    if not perms and ranks is None:
        return fit
    fit = checkpointed(fit)
    names = sorted(r[0] for r in fit.select(metric).collect())  # the variables, as many as columns
    again = _permuted_fits(rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()), names, site, x, y, metric, value, perms, seed, ranks)
    both = checkpointed(again).unionByName(fit.select(F.lit(0).alias("perm"), metric, "r2"))
    return natural_join(fit, permutation_p(both, "r2", [metric]).select(metric, "p"), "left", [metric])


def _permuted_fits(rows: DataFrame, names: list, site: str, x: str, y: str, metric: str, value: str, perms: int, seed: int,
                   ranks: DataFrame | None) -> DataFrame:
    """(perm, metric, r2): fits of all variables with the sites' places permuted.

    A site has three numbers per variable (values, their sum and square sum), so repeated and missing values count as in the
    plain fit. Blocks of sites meet chunks of places; a task looks up its sites' places in all permutations and multiplies, so
    no row is made for a site and permutation.
    """
    middle = rows.agg(F.avg(x), F.avg(y)).first()
    centres = rows.groupBy(metric).agg(F.avg(value).alias("__mean"))
    v = F.col(value).cast("double") - F.col("__mean")
    numbers = natural_join(rows, centres, "inner", [metric]).groupBy(site, metric).agg(
        F.count(value).cast("double").alias("c"), F.coalesce(F.sum(v), F.lit(0.0)).alias("s"), F.coalesce(F.sum(v * v), F.lit(0.0)).alias("q"),
        F.first(F.col(x).cast("double") - (middle[0] or 0.0)).alias("__x"), F.first(F.col(y).cast("double") - (middle[1] or 0.0)).alias("__y"))
    at = natural_join(numbers, rows.sparkSession.createDataFrame(list(enumerate(names)), f"i int, `{metric}` {rows.schema[metric].dataType.simpleString()}"), "inner", [metric])
    sites = at.groupBy(F.col(site).alias("__site")).agg(F.first("__x").alias("__x"), F.first("__y").alias("__y"), F.collect_list(F.struct("i", "c", "s", "q")).alias("__v"))
    sites, how = with_ranks(sites, "__site", perms, seed, (), None if ranks is None else ranks.withColumnRenamed(site, "__site"))
    if ranks is None:
        sites = sites.withColumn("__number", F.col("__ranks.at"))
    else:
        home = ranks.where("perm = 0").select(F.col(site).alias("__site"), F.col("rank").cast("long").alias("__number"))
        sites = natural_join(sites, home, "left", ["__site"]).withColumn(
            "__number", F.coalesce("__number", F.raise_error(F.lit("a site is not numbered in permutation 0"))))
    sites = checkpointed(sites)
    n = sites.count()
    chunks, block = -(-n // PLACES), max(8 * SITE_BATCH, -(-n // (4 * cores(sites))))
    blocks = -(-n // block)
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(max(k - 1, 0))))
    movers = sites.withColumn("block", F.pmod(F.xxhash64("__site"), F.lit(max(blocks, 1))).cast("int")).withColumn("chunk", every(chunks)).select("block", "chunk", "__ranks", "__v")
    places = sites.withColumn("of_block", every(blocks)).select("of_block", (F.col("__number") / PLACES).cast("int").alias("of_chunk"), "__number", "__x", "__y")
    m = len(names)

    def add(left: pa.Table, right: pa.Table) -> pa.Table:
        sums = np.zeros((how.perms, 11, m))
        if len(left):
            first = left["chunk"][0].as_py() * PLACES
            table = np.full((3, PLACES if chunks > 1 else max(n, 1)), 0.0)
            number = right["__number"].to_numpy() - first
            if (number < 0).any() or (number >= table.shape[1]).any():
                raise ValueError("sites are not numbered from 0 on")
            table[0, number], table[1, number], table[2, number] = 1.0, right["__x"].to_numpy(), right["__y"].to_numpy()
            left = left.combine_chunks()
            for i in range(0, len(left), SITE_BATCH):
                part = left.slice(i, SITE_BATCH)
                move = how.of(part["__ranks"]) - first
                inside = (move >= 0) & (move < table.shape[1])
                here, px, py = table[:, np.where(inside, move, 0)] * inside
                values = part["__v"].combine_chunks()
                owner, of = np.repeat(np.arange(len(part)), np.diff(values.offsets.to_numpy())), values.flatten()
                own = np.zeros((3, len(part), m))
                for k, name in enumerate("csq"):
                    own[k, owner, of.field("i").to_numpy()] = of.field(name).to_numpy()
                c, s, q = own
                for k, (a, b) in enumerate(((here, c), (px, c), (py, c), (here, s), (px * px, c), (py * py, c), (px * py, c), (here, q), (px, s), (py, s))):
                    sums[:, k] += a.T @ b
                sums[:, 10] += here.sum(axis=0)[:, None]
        return pa.Table.from_batches([_chunks(sums)])

    def r2(first: int, sums: np.ndarray) -> pa.RecordBatch:
        k, sx, sy, sv, sxx, syy, sxy, svv, sxv, syv, met = np.moveaxis(sums, 1, 0)
        if (met != n).any():
            raise ValueError("a rank names no site")
        with np.errstate(divide="ignore", invalid="ignore"):
            xx, yy, xy, vv, xv, yv = sxx - sx * sx / k, syy - sy * sy / k, sxy - sx * sy / k, svv - sv * sv / k, sxv - sx * sv / k, syv - sy * sv / k
            found = (xv * (xv * yy - yv * xy) + yv * (yv * xx - xv * xy)) / ((xx * yy - xy * xy) * vv)
        perm = np.repeat(np.arange(first + 1, first + 1 + len(found)), m)
        return pa.RecordBatch.from_arrays([pa.array(perm, pa.int32()), pa.array(np.tile(np.arange(m), len(found)), pa.int32()),
                                           pa.array(np.where(np.isfinite(found), found, np.nan).ravel(), from_pandas=True)], ["perm", "i", "r2"])

    laid = movers.groupBy("block", "chunk").cogroup(places.groupBy("of_block", "of_chunk")).applyInArrow(add, "part int, w binary")
    found = _by_chunk(laid, (11, m), r2, "perm int, i int, r2 double")
    label = F.element_at(F.array(*[F.lit(x) for x in names]), F.col("i") + 1) if names else F.lit(None)
    return found.select("perm", label.alias(metric), "r2")


def envfit_arrows(fit: DataFrame, metric: str = "metric", alpha: float = 0.05, stretch: float = 2.0) -> DataFrame:
    """Arrows of the variables with p below alpha, at twice unit length."""
    return fit.where(F.col("p") < alpha).select(metric, (F.col("a1") * stretch).alias("a1"), (F.col("a2") * stretch).alias("a2"), "p")


def envfit_table(fit: DataFrame, metric: str = "metric", labels: dict[str, str] = METRIC_LABELS, skip: Sequence[str] = METRICS_OUT) -> DataFrame:
    """Printed table of the fits, sorted by p and r2: label, unit direction, p and r2 to two digits."""
    pairs = [F.lit(v) for item in labels.items() for v in item]
    label = F.coalesce(F.try_element_at(F.create_map(*pairs), F.col(metric)), F.col(metric))
    rows = fit.where(C.not_in(metric, skip)).select(label.alias(metric), "a1", "a2", "p", C.round_even("r2", 2).alias("r2"))
    return rows.orderBy("p", "r2", metric)
