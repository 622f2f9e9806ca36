"""Dissimilarities of presence tables, PERMANOVA and SIMPER, all linear in the number of sites.

Pairs of sites are never enumerated. Distances are taken for a given pair list or to a bounded set of
landmarks; the sums over all pairs that PERMANOVA and SIMPER need come from counts of sites by richness:

    for presence data  d(i, j) = 1 - 2 a / (n_i + n_j)   (Bray; a = shared taxa, n = richness)
    so  sum d^2  over pairs with richness n and m  =  N_n N_m - 4 A / (n + m) + 4 Q / (n + m)^2
    with  A = sum_s c_n(s) c_m(s)   and   Q = sum_st c_n(s, t) c_m(s, t) over ordered (s, t),

where c_n(s) and c_n(s, t) count the sites of richness n that hold taxon s, or both s and t. The tables are
bounded by the taxonomy, whatever the number of sites.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from limnos.operators.reshape import natural_join, top_n
from limnos.session import checkpointed, cores


#: Stands for a missing taxon inside a set: it is a taxon of its own, and sets of NULLs would lose it.
MISSING = "\u0000missing"


def site_sets(presence: DataFrame, site: Sequence[str], taxon: str) -> DataFrame:
    """(site, taxa, n): the distinct taxa of each site as one array of texts, a missing one included."""
    name = F.coalesce(F.col(taxon).cast("string"), F.lit(MISSING))
    return presence.groupBy(*site).agg(F.array_sort(F.collect_set(name)).alias("taxa")).withColumn("n", F.size("taxa"))


def presence_distance(shared: Column, n1: Column, n2: Column, method: str) -> Column:
    """Bray or Jaccard from shared and own taxon counts; two empty sites have no distance."""
    if method == "bray":
        return F.try_divide(n1 + n2 - 2 * shared, n1 + n2)
    if method == "jaccard":
        return F.try_divide(n1 + n2 - 2 * shared, n1 + n2 - shared)
    raise ValueError(f"unknown method {method!r}")


def pair_dissimilarity(sets: DataFrame, pairs: DataFrame, site: str, left: str, right: str, method: str = "jaccard") -> DataFrame:
    """Distance of each listed pair: two joins on the site key, no pair formed that is not listed."""
    a = sets.select(F.col(site).alias(left), F.col("taxa").alias("__ta"), F.col("n").alias("__na"))
    b = sets.select(F.col(site).alias(right), F.col("taxa").alias("__tb"), F.col("n").alias("__nb"))
    both = pairs.join(a, left).join(b, right)
    shared = F.size(F.array_intersect("__ta", "__tb"))
    return both.withColumn("d", presence_distance(shared, F.col("__na"), F.col("__nb"), method)).drop("__ta", "__tb", "__na", "__nb")


def abundance_dissimilarity(counts: DataFrame, group: Sequence[str], side: str, first, second, taxon: str, value: str,
                            method: str = "bray") -> DataFrame:
    """Distance between the two sides of each group (two seasons of a lake, say) on abundances, in one aggregate."""
    def of(which) -> Column:
        return F.coalesce(F.sum(F.when(F.col(side) == which, F.col(value))), F.lit(0))

    both = counts.groupBy(*group, taxon).agg(of(first).alias("x"), of(second).alias("y"))
    sums = both.groupBy(*group).agg(F.sum(F.abs(F.col("x") - F.col("y"))).alias("gap"), F.sum(F.col("x") + F.col("y")).alias("total"),
                                    F.sum("x").alias("sx"), F.sum("y").alias("sy"))
    bray = F.try_divide(F.col("gap"), F.col("total"))
    return sums.where("sx > 0 AND sy > 0").select(*group, (bray if method == "bray" else 2 * bray / (1 + bray)).alias("d"))


def choose_landmarks(sets: DataFrame, site: str, count: int) -> DataFrame:
    """A fixed number of sites with different taxon sets, the same on every run and partitioning."""
    different = sets.groupBy("taxa", "n").agg(F.min(site).alias(site))
    return different.orderBy(F.xxhash64(F.col(site).cast("string")), site).limit(count)


def landmark_dissimilarity(presence: DataFrame, landmarks: DataFrame, site: str, taxon: str, method: str = "jaccard") -> DataFrame:
    """(site, landmark, d) for all sites and the given landmark sites.

    Shared counts come from the taxa of the landmarks (bounded by landmarks x taxa); landmarks that share no taxon
    with a site are filled in from the one-row landmark list.
    """
    entries = landmarks.select(F.explode("taxa").alias(taxon), F.col(site).alias("landmark"))
    per_taxon = entries.groupBy(taxon).agg(F.collect_list("landmark").alias("__l"))
    listed = landmarks.agg(F.collect_list(F.struct(F.col(site).alias("landmark"), F.col("n").alias("nl")))).scalar()
    rows = presence.select(site, F.coalesce(F.col(taxon).cast("string"), F.lit(MISSING)).alias(taxon)).distinct()
    hits = natural_join(rows, per_taxon, "left", [taxon])
    shared = hits.groupBy(site).agg(F.count(taxon).alias("__n"), F.flatten(F.collect_list("__l")).alias("__hits"))
    each = shared.withColumn("__all", listed).select(site, "__n", "__hits", F.explode("__all").alias("__m"))
    count = F.size(F.filter("__hits", lambda h: h == F.col("__m.landmark")))
    return each.select(site, F.col("__m.landmark").alias("landmark"),
                       presence_distance(count, F.col("__n"), F.col("__m.nl"), method).alias("d"))


# --- sums over all pairs -------------------------------------------------------------------------

def pair_counts(sets: DataFrame, cell: str) -> DataFrame:
    """(cell, __n, __s, __t, __c): sites of a cell and richness that hold taxa s and t; s = t for one taxon, both NULL for all sites.

    One pass over the sites. A site gives one entry per pair of its own taxa, summed before the shuffle.
    """
    own = F.transform("taxa", lambda s, i: F.struct(s.alias("s"), F.slice("taxa", i + 1, F.size("taxa")).alias("t")))
    none = F.lit(None).cast("string")
    entries = F.concat(own, F.array(F.struct(none.alias("s"), F.array(none).alias("t"))))
    each = sets.select(cell, F.col("n").alias("__n"), F.explode(entries).alias("__p")).select(
        cell, "__n", F.col("__p.s").alias("__s"), F.explode("__p.t").alias("__t"))
    return each.groupBy(cell, "__n", "__s", "__t").agg(F.count(F.lit(1)).alias("__c"))


def _shared_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (group, same, n, c) of one taxon pair each: sum over all ordered pairs of richness values of c c' w, per group.

    A matrix is as wide as there are different richness values, whatever the richest site.
    """
    for batch in batches:
        group, same, n, c = batch.columns
        names = group.dictionary_encode()
        codes = names.indices.to_numpy(zero_copy_only=False)
        own, value = same.to_numpy(zero_copy_only=False), np.zeros(len(n))
        first = 0
        lengths = np.diff(n.offsets.to_numpy())
        while first < len(n):
            last = first + max(1, int(np.searchsorted(np.cumsum(lengths[first:]), 1 << 18, "right")))
            last = min(last, first + 4096)
            part, counts = n.slice(first, last - first), c.slice(first, last - first)
            rich, at = np.unique(part.flatten().to_numpy(), return_inverse=True)
            both = np.add.outer(rich, rich).astype(float)
            dense = np.zeros((len(part), len(rich)))
            dense[pc.list_parent_indices(part).to_numpy(), at] = counts.flatten().to_numpy()
            for kind, w in ((True, -4 / both + 4 / both ** 2), (False, 8 / both ** 2)):
                rows = np.flatnonzero(own[first:last] == kind)
                value[first + rows] = ((dense[rows] @ w) * dense[rows]).sum(axis=1)
            first = last
        yield pa.RecordBatch.from_arrays([names.dictionary, pa.array(np.bincount(codes, value, len(names.dictionary)))], ["__g", "__v"])


def group_sums(counts: DataFrame, group: str) -> DataFrame:
    """(group, sites, d2): sum of squared Bray distances over all ordered pairs of sites of one group, from `pair_counts`.

    A taxon pair brings its counts by richness together, a list no longer than the richest site; nothing goes to the driver.
    """
    kind = counts.schema[group].dataType.simpleString()
    code = F.to_json(F.struct(F.col(group).alias("g")), {"ignoreNullFields": "false"})
    packed = counts.where("__s IS NOT NULL").groupBy(group, "__s", "__t").agg(
        F.collect_list("__n").alias("n"), F.collect_list(F.col("__c").cast("double")).alias("c"))
    each = packed.select(code.alias("__g"), (F.col("__s") == F.col("__t")).alias("same"), "n", "c").mapInArrow(_shared_sums, "__g string, __v double")
    shared = each.groupBy("__g").agg(F.sum("__v").alias("__v"))
    sites = counts.where("__s IS NULL").groupBy(group).agg(F.sum("__c").alias("sites")).withColumn("__g", code)
    out = sites.join(shared, "__g", "left")
    return out.select(F.col(group).cast(kind), "sites", (F.col("sites") * F.col("sites") + F.coalesce("__v", F.lit(0.0))).alias("d2"))


def permanova(sets: DataFrame, group: str) -> DataFrame:
    """PERMANOVA of Bray distances by one grouping of the sites, exact over all pairs; sites without taxa have no distance and are left out."""
    counts = checkpointed(pair_counts(sets.where("n > 0").select(F.col(group).alias("__g"), "n", "taxa"), "__g"))
    within = group_sums(counts, "__g").agg(F.sum("sites").alias("sites"), F.count(F.lit(1)).alias("groups"),
                                           F.sum(F.col("d2") / 2 / F.col("sites")).alias("ss_within"))
    every = counts.groupBy("__n", "__s", "__t").agg(F.sum("__c").alias("__c")).withColumn("__g", F.lit(0))
    total = group_sums(every, "__g").select(F.col("d2").alias("__d2"))
    one = within.join(total, F.lit(True))  # one row each
    return _f_ratio(one.withColumn("ss_total", F.try_divide(F.col("__d2") / 2, F.col("sites"))))


def _f_value() -> Column:
    between = F.col("ss_total") - F.col("ss_within")
    return F.try_divide(F.try_divide(between, F.col("groups") - 1), F.try_divide(F.col("ss_within"), F.col("sites") - F.col("groups")))


def _f_ratio(one: DataFrame) -> DataFrame:
    r2 = F.try_divide(F.col("ss_total") - F.col("ss_within"), F.col("ss_total"))
    return one.select("ss_total", "ss_within", "groups", "sites", r2.alias("r2"), _f_value().alias("f"))


def permanova_pairs(distances: DataFrame, labels: DataFrame, site: str, group: str, left: str, right: str, d: str,
                    ranks: DataFrame | None = None) -> DataFrame:
    """PERMANOVA from a given long table of distances with each unordered pair once (any method).

    With `ranks` (perm, site, rank; perm from 1, rank 0-based within a permutation or block of sites, see
    ordination.permuted_labels for the labels they give) as a table (perm, site, label column), the result has
    p = (1 + permuted F at least the observed) / (1 + permutations). A site carries its labels as one array, so a pair of
    sites is one row whatever the number of permutations.
    """
    n = labels.agg(F.count(F.lit(1)).alias("sites"), F.count_distinct(group).alias("groups"))
    sizes = labels.groupBy(group).agg(F.count(F.lit(1)).alias("__size"))
    given = labels.select(F.col(site).alias("__site"), F.lit(0).alias("perm"), F.col(group).alias("__g"))
    if ranks is not None:
        given = given.unionByName(ranks.select(F.col(site).alias("__site"), "perm", F.col(group).alias("__g")))
    weighted = given.join(sizes.select(F.col(group).alias("__g"), "__size"), "__g")
    arrays = weighted.groupBy("__site").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("perm", F.col("__g").alias("g"), F.col("__size").alias("size")))),
        lambda x: F.struct(x["g"].alias("g"), x["size"].alias("size"))).alias("__labels"))
    a = arrays.select(F.col("__site").alias(left), F.col("__labels").alias("__la"))
    b = arrays.select(F.col("__site").alias(right), F.col("__labels").alias("__lb"))
    rows = distances.select(left, right, (F.col(d) * F.col(d)).alias("__d2")).join(a, left).join(b, right)
    share = F.zip_with("__la", "__lb", lambda x, y: F.when(x["g"] == y["g"], F.col("__d2") / x["size"]).otherwise(0.0))
    each = rows.select("__d2", F.posexplode(share).alias("perm", "__w"))
    sums = each.groupBy("perm").agg(F.sum("__d2").alias("d2"), F.sum("__w").alias("ss_within"))
    per = sums.join(n, F.lit(True)).withColumn("ss_total", F.try_divide(F.col("d2"), F.col("sites")))
    fits = per.select("perm", _f_value().alias("f"))
    one = _f_ratio(per.where("perm = 0"))
    if ranks is None:
        return one
    seen = fits.where("perm = 0").select(F.col("f").alias("__f"))
    p = fits.where("perm > 0").join(seen, F.lit(True)).agg(
        ((F.sum((F.col("f") >= F.col("__f") - 1e-12).cast("long")) + 1) / (F.count(F.lit(1)) + 1)).alias("p"))
    return one.join(p, F.lit(True))


def simper(presence: DataFrame, site: str, taxon: str, cluster: str) -> DataFrame:
    """(cluster1, cluster2, taxon, average, cusum): contributions of taxa to Bray distances between clusters.

    Taxa that neither cluster holds are listed with zero.

    A pair of sites contributes 1 / (n_i + n_j) to a taxon that exactly one of them has, so the mean over all
    pairs of two clusters needs only the number of sites by richness, with and without the taxon.
    """
    own_taxon, own_cluster, taxon, cluster = taxon, cluster, "__taxon", "__cluster"
    presence = presence.select(F.col(site).alias("__site"), F.col(own_cluster).alias(cluster), F.col(own_taxon).alias(taxon))
    sets = site_sets(presence, ["__site", cluster], taxon)
    marked = F.explode(F.concat("taxa", F.array(F.lit(None))))  # the NULL entry counts the sites
    counts = checkpointed(sets.select(cluster, "n", marked.alias(taxon)).groupBy(cluster, "n", taxon).agg(F.count(F.lit(1)).alias("p")))
    levels = counts.where(F.col(taxon).isNull()).select(cluster, "n", F.col("p").alias("sites"))
    held = counts.where(F.col(taxon).isNotNull())
    # weight[c, d, n]: sum over the sites of d of 1 / (n + m), for the richness values n of c; a cluster's levels are one short list
    parts = cores(presence)
    lists = checkpointed(levels.groupBy(cluster).agg(F.collect_list(F.struct("n", "sites")).alias("l")))
    every = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")
    part = F.pmod(F.xxhash64(cluster), F.lit(parts)).cast("int").alias("part")
    left = lists.select(F.col(cluster).alias("c"), F.col("l").alias("a"), every)
    both = left.join(lists.select(F.col(cluster).alias("d"), F.col("l").alias("b"), part), "part").where("c != d")
    total = F.aggregate("b", F.lit(0.0), lambda s, x: s + x["sites"] / (F.col("x.n") + x["n"]))
    weight = both.select("c", "d", "b", F.explode("a").alias("x")).select("c", F.col("x.n").alias("n"), "d", total.alias("w"))
    mine = held.select(F.col(cluster).alias("c"), "n", taxon, "p")
    alone = mine.join(weight, ["c", "n"]).groupBy("c", "d", taxon).agg(F.sum(F.col("p") * F.col("w")).alias("v"))
    alone = alone.select(F.least("c", "d").alias("cluster1"), F.greatest("c", "d").alias("cluster2"), taxon, "v")
    other = held.select(F.col(cluster).alias("d"), F.col("n").alias("m"), taxon, F.col("p").alias("q"))
    shared = mine.join(other, taxon).where("c < d").select(
        F.col("c").alias("cluster1"), F.col("d").alias("cluster2"), taxon,
        (-2 * F.col("p") * F.col("q") / (F.col("n") + F.col("m"))).alias("v"))
    # zeros for all taxa and pairs of clusters, as the result lists them
    pairs = both.where("c < d").select(F.col("c").alias("cluster1"), F.col("d").alias("cluster2"), F.pmod(F.xxhash64("c", "d"), F.lit(parts)).cast("int").alias("part"))
    absent = held.select(taxon).distinct().select(taxon, every).join(pairs, "part").select("cluster1", "cluster2", taxon, F.lit(0.0).alias("v"))
    sums = alone.unionByName(shared).unionByName(absent).groupBy("cluster1", "cluster2", taxon).agg(F.sum("v").alias("v"))
    sizes = levels.groupBy(cluster).agg(F.sum("sites").alias("__s"))
    sums = sums.join(sizes.select(F.col(cluster).alias("cluster1"), F.col("__s").alias("__s1")), "cluster1")
    sums = sums.join(sizes.select(F.col(cluster).alias("cluster2"), F.col("__s").alias("__s2")), "cluster2")
    out = sums.select("cluster1", "cluster2", taxon, (F.col("v") / F.col("__s1") / F.col("__s2")).alias("average"))
    pair = Window.partitionBy("cluster1", "cluster2")
    running = pair.orderBy(F.round("average", 12).desc(), taxon).rowsBetween(Window.unboundedPreceding, 0)
    out = out.withColumn("cusum", F.sum("average").over(running) / F.sum("average").over(pair))
    return out.select("cluster1", "cluster2", F.nullif(F.col(taxon), F.lit(MISSING)).alias(own_taxon), "average", "cusum")


def simper_select(scores: DataFrame, taxon: str, n: int = 15, by: str = "average_desc") -> DataFrame:
    """Distinct taxa that are among the first n of any cluster pair, plus those that close a pair's running share.

    by='average_desc' takes the largest contributions; by='cumulative_desc' the largest running shares.
    """
    order = {"average_desc": [F.round("average", 12).desc(), F.col(taxon)],
             "cumulative_desc": [F.round("cusum", 9).desc(), F.col(taxon)]}[by]
    first = top_n(scores, ["cluster1", "cluster2"], order, n).select(taxon)
    closing = scores.where(F.abs(F.col("cusum") - 1) < 1e-12).select(taxon)
    return first.unionByName(closing).distinct()
