"""Presence tables, richness, frequencies and accumulation curves.

Presence is long and sparse: one row per (site, taxon) that occurs. A wide matrix is for export only.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from limnos.functions import columns as C
from limnos.operators.permutations import numbered
from limnos.operators.reshape import add_group_values, keep_groups, long, lookup_join, natural_join, wide
from limnos.session import checkpointed, cores

# Names that stand for specimens without a usable family.
INVALID_FAMILIES = ["unidentified", "degraded", "terrestrial"]
# Sites of two lakes that were sampled in spring only, and lakes left out of the two-season frame.
TWO_SEASON_SITES = {"DTL": ["2", "4"], "MSL": ["MSL.002", "MSL.004"]}
TWO_SEASON_LAKES_OUT = ["COM", "LML", "ETL", "GNL"]
# Survey taxa that are not aquatic or not told apart, and renames.
SURVEY_FAMILIES_OUT = ["Spongillidae", "Unspecified", "Chrysomelidae", "Curclionidae", "Muscidae"]
SURVEY_ORDERS_OUT = ["Collembola", "Decapoda", "Unspecified"]


def clean_site(c) -> Column:
    """Site text without blanks, one spelling of the missing mark."""
    return C.replace_all(C.replace_all(c, " ", ""), "Notlisted", "NotListed")


def presence_table(specimens: DataFrame, keys: Sequence[str], season: str | None = None,
                   invalid: Sequence[str] = INVALID_FAMILIES, skip_sites: dict[str, list[str]] | None = None,
                   skip_lakes: Sequence[str] = ()) -> DataFrame:
    """Distinct (keys, FAMILY) of usable specimens; a missing family is kept as a value of its own.

    `skip_sites` drops the listed sites of a lake, `skip_lakes` whole lakes.
    """
    rows = specimens
    if season is not None:
        rows = rows.where(F.col("MONTH") == season)
    for lake, sites in (skip_sites or {}).items():
        rows = rows.where(C.not_in("WATER", [lake]) | C.not_in(F.col("SITE_N").cast("string"), sites))
    if skip_lakes:
        rows = rows.where(C.not_in("WATER", skip_lakes))
    rows = rows.where(C.not_in("FAMILY", invalid))
    if "SITE_N" in keys:
        rows = rows.withColumn("SITE_N", clean_site("SITE_N"))
    return rows.select(*keys, "FAMILY").distinct()


def presence_matrix(presence: DataFrame, keys: Sequence[str], taxon: str, taxa: Sequence[str]) -> DataFrame:
    """Wide 0/1 export of a presence table for a given list of taxa."""
    return wide(presence.withColumn("__one", F.lit(1)), keys, taxon, "__one", taxa, fill=0)


def prune_taxa(presence: DataFrame, site: Sequence[str], taxon: str) -> DataFrame:
    """Drop taxa that occur in every site; taxa in no site have no rows. The number of sites is derived."""
    n_sites = presence.agg(C.n_distinct(*site)).scalar()
    counts = presence.groupBy(taxon).agg(F.count(F.lit(1)).alias("__n")).withColumn("__sites", n_sites)
    return natural_join(presence, counts.where("__n < __sites").select(taxon), "left_semi", [taxon])


# Families named after an order, and renamed families.
ORDER_FAMILIES = {"Amphipoda": "Amphipoda.unsp", "Isopoda": "Isopoda.unsp"}
FAMILY_RENAMES = {"Agriidae": "Calopterygidae"}


def taxonomic_recode(rows: DataFrame, lookup: DataFrame) -> DataFrame:
    """Full order and family names from the code lookup, renames, and the drop lists.

    A missing full name fails the `!=` filters, so its row is dropped.
    """
    def names(level: str) -> DataFrame:
        return lookup.where(F.col("TAXONOMIC_GROUP") == level).select(
            F.col("CODE").alias(level), F.col("TAXONOMIC_ID").alias(f"{level}_full"))

    out = lookup_join(lookup_join(rows, names("ORDER"), ["ORDER"], ["ORDER_full"]), names("FAMILY"), ["FAMILY"], ["FAMILY_full"])
    family = F.col("FAMILY_full")
    for name, new in FAMILY_RENAMES.items():
        family = F.when(F.col("FAMILY_full") == name, new).otherwise(family)
    for name, new in ORDER_FAMILIES.items():
        family = F.when(F.col("ORDER_full") == name, new).otherwise(family)
    return out.withColumn("FAMILY_full", family).where(
        ~F.col("FAMILY_full").isin(SURVEY_FAMILIES_OUT) & ~F.col("ORDER_full").isin(SURVEY_ORDERS_OUT))


def occurrence_filter(rows: DataFrame, site: str, taxon: str, min_sites: int = 100, min_taxa: int = 3,
                      method: Column | None = None, skip_sites: Sequence[str] = (), known_sites: DataFrame | None = None) -> DataFrame:
    """Distinct (site, taxon) with taxa in more than `min_sites` sites, then sites with at least `min_taxa` of those."""
    rows = rows if method is None else rows.where(method)
    presence = checkpointed(rows.select(site, taxon).distinct())  # read four times below, what lies behind it runs once
    common = keep_groups(presence, [taxon], F.count(F.lit(1)), lambda n: n > min_sites)
    rich = keep_groups(common, [site], F.count(F.lit(1)), lambda n: n >= min_taxa)
    if skip_sites:
        rich = rich.where(C.not_in(site, skip_sites))
    return rich if known_sites is None else natural_join(rich, known_sites.select(site).distinct(), "left_semi", [site])


def method_profile(rows: DataFrame, method: str, taxon: str) -> tuple[DataFrame, DataFrame]:
    """Rows per sampling method, and the distinct (method, taxon)."""
    return rows.groupBy(method).agg(F.count(F.lit(1)).alias("count")), rows.select(method, taxon).distinct()


def taxon_hierarchy(specimens: DataFrame, upper: str, lower: str) -> DataFrame:
    return specimens.select(upper, lower).distinct()


def richness(rows: DataFrame, keys: Sequence[str], taxon: str, name: str = "richness") -> DataFrame:
    """Distinct taxa per key, a missing taxon counted as one."""
    return rows.select(*keys, taxon).distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def richness_metrics(counts: DataFrame, chemistry: DataFrame, keys: Sequence[str], metrics: Sequence[str], name: str = "richness") -> DataFrame:
    """(keys, metric, value): richness and the chemistry of the same lake-season in long form, distinct and complete rows only."""
    rows = natural_join(counts.select(*keys, name), chemistry.select(*keys, *metrics), "left", keys)
    return long(rows, keys, [name, *metrics], "metric", "value").distinct().dropna("any")


def cluster_frequency(presence: DataFrame, site: str, taxon: str, cluster: str, orders: DataFrame | None = None,
                      important: DataFrame | None = None) -> DataFrame:
    """Share of a cluster's sites that hold each taxon, and that share summed over clusters.

    `orders` (taxon, ORDER) adds the order, and `rank`, which numbers the rows by order (missing ones last), falling total
    share, taxon and cluster. `important` (taxon) marks members with Y, others with N.
    """
    sizes = presence.groupBy(cluster).agg(C.n_distinct(site).alias("n"))
    counts = presence.groupBy(cluster, taxon).agg(F.count(F.lit(1)).alias("total_waters"))
    out = natural_join(counts, sizes, "left", [cluster]).withColumn("prop_clust", F.col("total_waters") / F.col("n"))
    out = add_group_values(out, [taxon], total_clust=F.sum("prop_clust"))
    if orders is not None:
        out = lookup_join(out, orders, [taxon], ["ORDER"])
    if important is not None:
        marks = important.select(taxon).distinct().withColumn("__m", F.lit("Y"))
        out = natural_join(out, marks, "left", [taxon]).withColumn("important", F.coalesce("__m", F.lit("N"))).drop("__m")
    if orders is not None:
        place = {"__late": F.isnull("ORDER"), "__less": -F.round("total_clust", 12)}
        out = numbered(out.withColumns(place), ["__late", "ORDER", "__less", taxon, cluster]).withColumn("rank", F.col("at") + 1)
        out = out.drop(*place, "at", "size")
    return out


def cluster_table(sites: DataFrame, id: str, cluster: str, skip_lakes: Sequence[str] = ()) -> DataFrame:
    """Site key `SEASON_WATER` split into lower-case season and lake, with the cluster."""
    out = sites.select(F.lower(C.separate(id, 1)).alias("season"), C.separate(id, 2).alias("WATER"),
                       *[c for c in sites.columns if c != id])
    return out.where(C.not_in("WATER", skip_lakes)) if skip_lakes else out


def cluster_sizes(clusters: DataFrame, cluster: str = "cluster") -> DataFrame:
    return clusters.groupBy(cluster).agg(F.count(F.lit(1)).alias("n"))


def cluster_chemistry(chemistry: DataFrame, clusters: DataFrame) -> DataFrame:
    """One row per lake-season: chemistry, community name and cluster, joined on names."""
    named = chemistry.withColumn("community", C.unite(".", "WATER", "season"))
    return lookup_join(named, clusters, ["WATER", "season"], ["cluster"])


def cluster_season_shift(sites: DataFrame, water: str, season: str, cluster: str, axes: Sequence[str],
                         early: str = "SPRING", late: str = "FALL") -> tuple[DataFrame, DataFrame]:
    """Mean position per cluster and season; and per lake both positions, both clusters and whether they agree."""
    centroids = sites.groupBy(cluster, season).agg(*[F.avg(a).alias(f"centroid_{a}") for a in axes])

    def at(c: str, which: str) -> Column:
        return F.max(F.when(F.col(season) == which, F.col(c)))

    moves = sites.groupBy(water).agg(
        *[at(a, w).alias(f"{a}_{w.lower()}") for a in axes for w in (early, late)],
        *[at(cluster, w).alias(f"{cluster}_{w.lower()}") for w in (early, late)])
    return centroids, moves.withColumn("same", F.col(f"{cluster}_{late.lower()}") == F.col(f"{cluster}_{early.lower()}"))


# --- accumulation curves -------------------------------------------------------------------------

#: Sizes n of a curve that one row of work covers.
CURVE_BLOCK = 1024


def accumulation(presence: DataFrame, keys: Sequence[str], site: str, taxon: str, sizes: Sequence[int] | None = None) -> DataFrame:
    """Expected richness and its sd in n of the N sites of each key, for n = 1 .. N (or the given `sizes` up to N).

    A taxon in f sites is missed by n of N sites with probability q = C(N-f, n) / C(N, n). The sd adds the covariances of taxon
    pairs, q(1-q) weighted by the correlation of occurrences: pairs that share sites are counted by their two frequencies, in one
    pass over the sites, and the product of marginals is a difference of squares. A key then has a number per frequency and per pair
    of frequencies; blocks of n are products of these with the matrix of weights (frequencies x n).
    """
    presence = checkpointed(presence.select(*keys, site, taxon).distinct())  # what lies behind it runs once
    per_site = presence.groupBy(*keys, site).agg(F.count(F.lit(1)).alias("k"))
    totals_n = per_site.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_sites"))
    freq = natural_join(presence.groupBy(*keys, taxon).agg(F.count(F.lit(1)).alias("f")), totals_n, "inner", keys)
    counts = freq.groupBy(*keys, "n_sites", "f").agg(F.count(F.lit(1)).cast("double").alias("c"))
    single = counts.groupBy(*keys, "n_sites").agg(F.collect_list(F.struct("f", "c")).alias("single"))

    tagged = natural_join(presence, freq.where("f < n_sites").select(*keys, taxon, "n_sites", "f"), "inner", [*keys, taxon])
    tagged = tagged.groupBy(*keys, site, "n_sites", "f").agg(F.count(F.lit(1)).alias("m"))
    own = tagged.groupBy(*keys, site, "n_sites").agg(F.array_sort(F.collect_list(F.struct("f", "m"))).alias("a"))
    pairs = F.explode(F.transform("a", lambda x, i: F.struct(x.alias("x"), F.slice("a", i + 1, F.size("a")).alias("y"))))
    pairs = own.select(*keys, "n_sites", pairs.alias("p")).select(*keys, "n_sites", F.col("p.x").alias("x"), F.explode("p.y").alias("y"))
    together = F.when(F.col("x.f") == F.col("y.f"), F.col("x.m") * (F.col("x.m") - 1) / 2).otherwise(F.col("x.m") * F.col("y.m"))
    pairs = pairs.groupBy(*keys, F.col("x.f").alias("f"), F.col("y.f").alias("g")).agg(F.sum(together).alias("c")).where("c > 0")
    pairs = pairs.groupBy(*keys).agg(F.collect_list(F.struct("f", "g", "c")).alias("pairs"))

    if sizes is None:
        starts = F.sequence(F.lit(1).cast("long"), F.col("n_sites"), F.lit(CURVE_BLOCK).cast("long"))
        blocks = F.transform(starts, lambda x: F.sequence(x, F.least(x + CURVE_BLOCK - 1, F.col("n_sites"))))
    else:
        blocks = F.array(F.filter(F.array(*[F.lit(int(n)).cast("long") for n in sizes]), lambda n: n <= F.col("n_sites")))
    work = natural_join(single, pairs, "left", keys).withColumn("__block", F.explode(blocks))
    work = work.repartition(cores(presence), F.xxhash64(*keys, F.col("__block")))
    schema = T.StructType([*[presence.schema[k] for k in keys], *T.StructType.fromDDL("sites long, richness double, sd double").fields])
    return work.mapInArrow(_curves(list(keys)), schema)


def _curves(keys: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, sites, richness, sd = [], [], [], []
            for row, (total, single, pairs, block) in enumerate(zip(*[batch.column(c).to_pylist() for c in ("n_sites", "single", "pairs", "__block")])):
                logs = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, total + 1)))])  # log k!
                f, taxa = (np.array([x[k] for x in single], t) for k, t in (("f", int), ("c", float)))
                n = np.array(block, int)
                left = total - f[:, None] - n[None, :]
                inside = left >= 0
                q = np.where(inside, np.exp(logs[total - f][:, None] - logs[np.where(inside, left, 0)] - logs[total] + logs[total - n][None, :]), 0.0)
                v = np.maximum(q * (1 - q), 0)
                spread = (f * (total - f)).astype(float)[:, None]
                w = np.where(spread > 0, np.sqrt(v / np.where(spread > 0, spread, 1)), 0.0)
                fw = f[:, None] * w
                joint = np.zeros(len(n))
                if pairs:
                    at = {k: i for i, k in enumerate(f.tolist())}
                    c = np.zeros((len(f), len(f)))
                    for x in pairs:
                        c[at[x["f"]], at[x["g"]]] += x["c"]
                    joint = 2 * (w * (c @ w)).sum(axis=0)
                variance = taxa @ v + total * joint - ((taxa @ fw) ** 2 - taxa @ fw ** 2)
                rows += [row] * len(n)
                sites.append(n)
                richness.append(taxa @ (1 - q))
                sd.append(np.sqrt(np.maximum(variance, 0)))
            flat = lambda x, t: pa.array(np.concatenate(x) if x else [], t)
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch.column(k).take(take) for k in keys], flat(sites, pa.int64()), flat(richness, pa.float64()), flat(sd, pa.float64())],
                                             [*keys, "sites", "richness", "sd"])

    return run


def with_origin(curves: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The curves with a row of zeros per key."""
    zero = curves.select(*keys).distinct().select(
        *keys, F.lit(0).cast("long").alias("sites"), F.lit(0.0).alias("richness"), F.lit(0.0).alias("sd"))
    return curves.unionByName(zero)


def share_of_sites(curves: DataFrame, keys: Sequence[str], few: int = 2, all_sites: int = 4) -> DataFrame:
    """Part of the richness of `all_sites` sites that `few` sites reach."""
    return (curves.where(C.is_in("sites", [few, all_sites])).groupBy(*keys)
            .agg((F.min("richness") / F.max("richness")).alias("percent")))


def display_order(rows: DataFrame, order: str, family: str, weight: str | None = None) -> DataFrame:
    """Distinct families numbered by order, then by falling weight or by name (a dimension-sized table)."""
    if weight is None:
        table, keys = rows.select(order, family).distinct(), [F.col(order).asc_nulls_last(), F.col(family)]
    else:
        table = rows.groupBy(order, family).agg(F.max(weight).alias(weight))
        keys = [F.col(order).asc_nulls_last(), F.col(weight).desc(), F.col(family)]
    return table.withColumn("count", F.row_number().over(Window.orderBy(*keys)))
