"""Permutations of sites without a row per site and permutation.

Sites get numbers 0 .. N-1 (in a block). A keyed bijection of these numbers gives a site's rank in any permutation on the spot:
nothing is drawn, sorted or joined for it. A permutation of labels follows from ranks and the sizes of the groups.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from limnos.operators.reshape import natural_join
from limnos.session import checkpointed

#: Odd constants of the mixing function, and rounds of the bijection (each changes both digits); fewer favour some orders of a few sites.
MIX_1, MIX_2, STEP = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15
ROUNDS = 8
#: Ranks that are computed at once.
RANKS = 1 << 16


def numbered(sites: DataFrame, order: Sequence[str], blocks: Sequence[str] = ()) -> DataFrame:
    """Add `at`, the 0-based number of a row in the order of `order` (in its block), and `size`, the rows of the block.

    Rows are sorted by ranges; only the number of rows by block and range is ever put in order by itself. Ties of
    `order` are numbered in the order of the checkpoint, so a row keeps its number.
    """
    keys = list(blocks)
    laid = sites.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn("__id", F.monotonically_increasing_id())
    laid = checkpointed(laid).withColumn("__part", F.shiftright("__id", 33))
    parts = laid.groupBy(*keys, "__part").agg(F.count(F.lit(1)).alias("__n"), F.min("__id").alias("__first"))
    block = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))  # a row per block and range
    before = F.sum("__n").over(block.orderBy("__part")) - F.col("__n") - F.col("__first")
    starts = parts.select(*keys, "__part", before.alias("__shift"), F.sum("__n").over(block).alias("size"))
    return natural_join(laid, starts, "inner", [*keys, "__part"]).withColumn("at", F.col("__id") + F.col("__shift")).drop("__id", "__part", "__shift")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX_1)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX_2)
    return x ^ (x >> np.uint64(31))


def bijection(at: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Rank of number `at` in the permutation of 0 .. size-1 that `key` names; the arrays are broadcast (size below 2^32).

    The number is written as two digits of bases a and b with a b >= size, and each digit in turn is moved round by a hash of the
    other one. That is a bijection of 0 .. a b - 1; a result beyond size goes round again until it is inside.
    """
    with np.errstate(over="ignore"):
        at, size, key = np.broadcast_arrays(*(np.asarray(x).astype(np.uint64) for x in (at, size, key)))
        out, todo = at.copy(), np.ones(at.shape, bool)
        a = np.ceil(np.sqrt(size.astype(float))).astype(np.uint64)
        a += a * a < size
        b = (size + a - np.uint64(1)) // np.maximum(a, np.uint64(1))
        while todo.any():
            every = todo.all()
            high_base, low_base, k, x = (v.ravel() if every else v[todo] for v in (a, b, key, out))
            high, low = x // low_base, x % low_base
            for i in range(ROUNDS):
                turn = k + np.uint64((2 * i + 1) * STEP % 2 ** 64)
                high = high + ((_mix(low + turn) >> np.uint64(32)) * high_base >> np.uint64(32))
                high -= high_base * (high >= high_base)
                low = low + ((_mix((high ^ np.uint64(1 << 40)) + turn) >> np.uint64(32)) * low_base >> np.uint64(32))
                low -= low_base * (low >= low_base)
            value = high * low_base + low
            if every:
                out = value.reshape(at.shape)
            else:
                out[todo] = value
            todo = out >= size
        return out.astype(np.int64)


class Ranks:
    """Where a site's ranks come from: drawn on the spot, or given as an array.

    `column` is what a site carries; `of` gives the ranks of a batch of such values as a matrix (sites, permutations).
    """

    def __init__(self, perms: int, seed: int, given: bool):
        self.perms, self.seed, self.given = perms, seed, given

    def of(self, values: pa.Array) -> np.ndarray:
        if isinstance(values, pa.ChunkedArray):
            values = values.combine_chunks()
        if self.given:
            return values.flatten().to_numpy(zero_copy_only=False).reshape(-1, self.perms)
        at, size, block = (values.field(c).to_numpy(zero_copy_only=False) for c in ("at", "size", "block"))
        with np.errstate(over="ignore"):
            names = _mix(np.arange(1, self.perms + 1).astype(np.uint64) * np.uint64(STEP) + np.uint64(self.seed % 2 ** 64))
            keys = block.astype(np.uint64)[:, None] ^ names[None, :]
        out, step = np.empty((len(at), self.perms), np.int64), max(1, RANKS // max(self.perms, 1))
        for i in range(0, len(at), step):
            out[i:i + step] = bijection(at[i:i + step, None], size[i:i + step, None], keys[i:i + step])
        return out


def _rank_lists(rows: DataFrame, site: str) -> DataFrame:
    """(site, p, r): permutations and ranks of a site as lists; those of a batch are together, so that fewer rows are sent."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sites = batch.column(site).dictionary_encode("encode")
                order = np.argsort(codes := sites.indices.to_numpy(), kind="stable")
                stops = pa.array(np.r_[0, np.cumsum(np.bincount(codes))], pa.int32())
                lists = [pa.ListArray.from_arrays(stops, batch.column(c).take(pa.array(order))) for c in ("perm", "rank")]
                yield pa.RecordBatch.from_arrays([sites.dictionary, *lists], [site, "p", "r"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(run, f"`{site}` {kinds[site]}, p array<{kinds['perm']}>, r array<long>")


def with_ranks(sites: DataFrame, site: str, perms: int, seed: int, blocks: Sequence[str] = (), ranks: DataFrame | None = None) -> tuple[DataFrame, Ranks]:
    """Sites with a column `__ranks`, and how to read it. One row per site.

    Drawn permutations need the site's number only. `ranks` (perm, site, rank), perm from 1, takes their place; each site
    must have a rank in each permutation.
    """
    if ranks is None:
        block = F.xxhash64(*[F.col(b) for b in blocks]) if blocks else F.lit(0).cast("long")
        made = numbered(sites, [site], blocks).withColumn("__ranks", F.struct("at", "size", block.alias("block"))).drop("at", "size")
        return made, Ranks(perms, seed, False)
    rows = ranks.where("perm > 0")
    perms = rows.agg(F.max("perm")).first()[0] or 0
    lists = _rank_lists(rows.select(site, "perm", F.col("rank").cast("long").alias("rank")), site)
    both = lists.groupBy(site).agg(F.flatten(F.collect_list("p")).alias("perm"), F.flatten(F.collect_list("r")).alias("rank"))
    arrays = both.select(site, F.transform(F.array_sort(F.arrays_zip("perm", "rank")), lambda x: x["rank"]).alias("__ranks"))
    whole = F.when(F.size("__ranks") == perms, F.col("__ranks")).otherwise(F.raise_error(F.lit("a site lacks a rank in some permutation")))
    return natural_join(sites, arrays, "left", [site]).withColumn("__ranks", whole), Ranks(perms, seed, True)


def permuted_ranks(sites: DataFrame, site: str, perms: int, seed: int, blocks: Sequence[str] = ()) -> DataFrame:
    """(site, blocks, ranks): 0-based rank of each site in permutations 1 .. perms, within its block, as one array."""
    made, how = with_ranks(sites.select(site, *blocks), site, perms, seed, blocks)

    def run(batches):
        for batch in batches:
            matrix = how.of(batch.column("__ranks"))
            ranks = pa.ListArray.from_arrays(pa.array(np.arange(len(matrix) + 1) * perms, pa.int32()), pa.array(matrix.ravel()))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in (site, *blocks)], ranks], [site, *blocks, "ranks"])

    fields = ", ".join(f"`{c}` {sites.schema[c].dataType.simpleString()}" for c in (site, *blocks))
    return made.select(site, *blocks, "__ranks").mapInArrow(run, f"{fields}, ranks array<long>")


def label_codes(sites: DataFrame, label: Column, blocks: Sequence[str] = ()) -> tuple[DataFrame, list]:
    """Sites with `__code`, the 0-based number of their label in order, and `__stops`, the running group sizes of their block; and the labels.

    There are few labels; with blocks, there is one short array per block.
    """
    rows = sites.withColumn("__label", label)
    sizes = checkpointed(rows.groupBy(*blocks, "__label").agg(F.count(F.lit(1)).alias("__c")))
    labels = [r[0] for r in sizes.select("__label").distinct().orderBy("__label").collect()]  # one row per label
    codes = sites.sparkSession.createDataFrame([(x, i) for i, x in enumerate(labels)] or [(None, 0)], f"__label {sizes.schema['__label'].dataType.simpleString()}, __code int")
    by_code = F.map_from_entries(F.collect_list(F.struct("__code", "__c")))
    stops = natural_join(sizes, codes, "inner", ["__label"]).groupBy(*blocks).agg(by_code.alias("__m"))
    count = F.transform(F.sequence(F.lit(0), F.lit(max(len(labels) - 1, 0))), lambda i: F.coalesce(F.try_element_at("__m", i), F.lit(0)))
    running = F.transform(count, lambda x, i: F.aggregate(F.slice(count, 1, i + 1), F.lit(0).cast("long"), lambda s, v: s + v))
    stops = stops.select(*blocks, running.alias("__stops"))
    out = natural_join(rows, codes, "inner", ["__label"])
    out = natural_join(out, stops, "inner", list(blocks)) if blocks else out.withColumn("__stops", stops.select("__stops").scalar())
    return out.drop("__label"), labels


def codes_of(ranks: np.ndarray, code: pa.Array, stops: pa.Array) -> np.ndarray:
    """Codes of the labels of sites (rows) as given (column 0) and in each permutation: a rank lies in one group's range."""
    stops = np.stack(stops.to_numpy(zero_copy_only=False)) if len(stops) else np.zeros((0, 1), np.int64)
    out = np.zeros((len(stops), 1 + ranks.shape[1]), np.uint16)
    out[:, 0] = code.to_numpy(zero_copy_only=False)
    for g in range(stops.shape[1] - 1):
        out[:, 1:] += ranks >= stops[:, g:g + 1]
    return out


def permutation_p(values: DataFrame, statistic: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, statistic, p): p = (1 + permuted values at least the observed) / (1 + permutations); perm 0 is observed."""
    tolerance = 1e-12
    observed = values.where("perm = 0").select(*keys, F.col(statistic).alias("__o"))
    rows = values.where("perm > 0")
    rows = natural_join(rows, observed, "inner", keys) if keys else rows.withColumn("__o", observed.select("__o").scalar())
    return rows.groupBy(*keys).agg(
        F.max("__o").alias(statistic),
        ((F.sum((F.col(statistic) >= F.col("__o") - tolerance).cast("long")) + 1) / (F.count(F.lit(1)) + 1)).alias("p"))
