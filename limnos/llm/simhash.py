"""SimHash near-duplicates: fingerprints of word shingles, linked by a vantage-point tree over Hamming distance.

Distinct fingerprints go down a tree whose vantage points and radii come from a bounded sample; only its shape depends
on the sample. A fingerprint lives in one shard and, where it lies within the link distance of a boundary on its inner
side, also visits the outer side: by the triangle bound |d(v, x) - d(v, y)| <= d(x, y) no linked pair is missed. Each
shard is searched by a further tree in memory and gives links of a spanning forest only, so a group of copies gives as
many links as it has members. Components then join by the least document id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from limnos.llm.common import blocks, offsets, staged, tidy, tidy_group

SHINGLE = 4
DISTANCE = 4
#: Fingerprints that live in a shard, about; the least set that is searched pair by pair.
SHARD = 32768
LEAF = 256
#: Fingerprints that shape the tree: so many for a shard, so many at most. The tree's shape has no effect on the links.
SAMPLE_EACH = 64
SAMPLE = 1 << 20
#: Text that is hashed at once: bounds a worker's memory.
TEXT_BYTES = 4 << 20

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def _shingle_hashes(raw: bytes, size: int) -> np.ndarray:
    """XXH64 (seed 42) of the shingles of a text in UTF-8, A-Z lower-cased, words joined by one blank."""
    words = raw.translate(LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    digest = xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begin = np.r_[0, ends[:-size] + 1].tolist()
    return np.fromiter((digest(joined[a:b], 42) for a, b in zip(begin, ends[size - 1:].tolist())), np.uint64, len(begin))


def _majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Per text, the bits set in over half of its hashes; 0 for none."""
    out, at = np.zeros(len(counts), np.uint64), offsets(counts)
    some = np.flatnonzero(counts)
    weights = np.uint64(1) << np.arange(64, dtype=np.uint64)
    for i in some.tolist():
        ones = np.zeros(64, np.int64)
        for a in range(at[i], at[i + 1], 1 << 16):
            part = hashes[a:min(a + (1 << 16), at[i + 1])]
            ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
        out[i] = np.bitwise_or.reduce(weights[2 * ones > counts[i]], initial=np.uint64(0))
    return out


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(doc_id, bits, text_hash, rest): 64-bit SimHash of each row's whole text as a signed long, XXH64 of the text, and of the other columns."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text", TEXT_BYTES):
            texts = block.column("text").to_pylist()
            each = [_shingle_hashes((t or "").encode(), size) for t in texts]
            counts = np.fromiter(map(len, each), np.int64, len(each))
            bits = _majority(np.concatenate(each), counts)
            keys = np.fromiter((xxhash.xxh64_intdigest(t or "", 42) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(bits.view(np.int64)), pa.array(keys.view(np.int64)), block.column("rest")],
                                             ["doc_id", "bits", "text_hash", "rest"])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), _rest(docs).alias("rest"))
    return rows.mapInArrow(tidy(run), "doc_id long, bits long, text_hash long, rest long")


def _rest(docs: DataFrame) -> Column:
    """Hash of all columns but the text; maps by their JSON text."""
    columns = [F.to_json(f.name) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in docs.schema if f.name not in ("doc_id", "text")]
    return F.xxhash64(*columns) if columns else F.lit(0).cast("long")


@dataclass
class Node:
    vantage: np.uint64
    radius: int
    inner: Node | int
    outer: Node | int


def _split(points: np.ndarray) -> tuple[np.uint64, int] | None:
    """A vantage point and the median distance from it; None if all points are at one distance."""
    vantage = points[len(points) // 2]
    away = np.bitwise_count(points ^ vantage)
    radius = int(np.partition(away, (len(away) - 1) // 2)[(len(away) - 1) // 2])
    if radius == away.max():
        radius -= 1
    return (vantage, radius) if radius >= away.min() else None


def plan_tree(sample: np.ndarray, depth: int) -> tuple[Node | int, int]:
    """Tree of at most `depth` levels over the sample, and the number of its shards."""
    count = 0

    def grow(points: np.ndarray, left: int) -> Node | int:
        nonlocal count
        cut = _split(points) if left and len(points) > 1 else None
        if cut is None:
            count += 1
            return count - 1
        inside = np.bitwise_count(points ^ cut[0]) <= cut[1]
        return Node(*cut, grow(points[inside], left - 1), grow(points[~inside], left - 1))
    return grow(sample, depth), count


def _shards(tree: Node | int, points: np.ndarray, near: int) -> Iterator[tuple[np.ndarray, int, bool]]:
    """(places, shard, home): where each point lives and which shards it visits."""
    todo = [(tree, np.arange(len(points)), np.ones(len(points), bool))]
    while todo:
        node, at, home = todo.pop()
        if not len(at):
            continue
        if not isinstance(node, Node):
            yield at, node, home
            continue
        away = np.bitwise_count(points[at] ^ node.vantage).astype(np.int16)
        inside = away <= node.radius
        # a point that lives inside also visits the outer side if an outer point may be near; a visitor goes to all
        # sides where points near it may live
        visit_out = inside & (away > node.radius - near)
        visit_in = ~inside & ~home & (away <= node.radius + near)
        todo.append((node.inner, np.r_[at[inside], at[visit_in]], np.r_[home[inside], home[visit_in]]))
        todo.append((node.outer, np.r_[at[~inside], at[visit_out]],
                     np.r_[home[~inside], np.zeros(visit_out.sum(), bool)]))


def _route(tree: Node | int, near: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = batch.column("bits").to_numpy()
            for at, shard, home in _shards(tree, bits.view(np.uint64), near):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), shard), pa.int32()), pa.array(bits[at]), pa.array(home)],
                                                 ["shard", "bits", "home"])
    return run


class Forest:
    """Union of places, least place as root."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def root(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def link(self, left: np.ndarray, right: np.ndarray) -> None:
        for i, j in zip(left.tolist(), right.tolist()):
            i, j = self.root(i), self.root(j)
            if i != j:
                self.parent[max(i, j)] = min(i, j)

    def roots(self) -> np.ndarray:
        return np.array([self.root(i) for i in range(len(self.parent))], np.int64)


def _compare(points: np.ndarray, left: np.ndarray, right: np.ndarray, near: int, forest: Forest) -> None:
    """Link all pairs of two sets within `near`, a slice at a time."""
    step = max(1, (1 << 20) // max(1, len(right)))
    for a in range(0, len(left), step):
        part = left[a:a + step]
        i, j = np.nonzero(np.bitwise_count(points[part][:, None] ^ points[right][None, :]) <= near)
        forest.link(part[i], right[j])


def link_near(points: np.ndarray, home: np.ndarray, near: int) -> np.ndarray:
    """Root place of each point after linking all pairs within `near` of which at least one lives here."""
    forest = Forest(len(points))
    # (left, right): pairs between two sets; right None: pairs inside left
    todo: list[tuple[np.ndarray, np.ndarray | None]] = [(np.flatnonzero(home), None)]
    if not home.all():
        todo.append((np.flatnonzero(home), np.flatnonzero(~home)))
    while todo:
        left, right = todo.pop()
        if not len(left) or right is not None and not len(right):
            continue
        small = len(left) <= LEAF if right is None else min(len(left), len(right)) <= LEAF
        cut = None if small else _split(points[left])
        if cut is None:
            _compare(points, left, left if right is None else right, near, forest)
            continue
        away = np.bitwise_count(points[left] ^ cut[0]).astype(np.int16)
        inner, outer = left[away <= cut[1]], left[away > cut[1]]
        if right is None:
            todo += [(inner, None), (outer, None), (left[(away <= cut[1]) & (away > cut[1] - near)],
                                                    left[(away > cut[1]) & (away <= cut[1] + near)])]
        else:
            far = np.bitwise_count(points[right] ^ cut[0]).astype(np.int16)
            todo += [(inner, right[far <= cut[1] + near]), (outer, right[far > cut[1] - near])]
    return forest.roots()


def _search(near: int):
    def run(group: pa.Table) -> pa.Table:
        bits, home = group["bits"].to_numpy().view(np.uint64), group["home"].to_numpy()
        roots = link_near(bits, home, near)
        linked = np.flatnonzero(roots != np.arange(len(roots)))
        bits = bits.view(np.int64)
        return pa.table({"a": pa.array(bits[linked]), "b": pa.array(bits[roots[linked]])})
    return run


def links(distinct: DataFrame, near: int = DISTANCE, shard: int = SHARD) -> DataFrame:
    """Spanning links (a, b) between distinct `bits` within `near` bits."""
    count = distinct.count()
    depth = max(0, int(np.ceil(np.log2(max(1, count / shard)))))
    wanted = min(SAMPLE, SAMPLE_EACH << depth)
    share = F.pmod(F.xxhash64("bits"), F.lit(1 << 30)) < int(min(1.0, wanted / max(1, count)) * (1 << 30))
    chosen = distinct.where(share).select("bits").limit(2 * wanted).collect() if depth else []
    points = np.sort(np.array([r[0] for r in chosen], np.int64).view(np.uint64))
    tree, _ = plan_tree(points[np.random.default_rng(0).permutation(len(points))], depth)
    return (distinct.select("bits").mapInArrow(_route(tree, near), "shard int, bits long, home boolean")
            .groupBy("shard").applyInArrow(tidy_group(_search(near)), "a long, b long"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root): least node that each node with a link reaches, by large-star and small-star rounds."""
    def seen(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    edges = staged(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    while (now := seen(edges)) != before:
        before = now
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        edges = staged(large.join(down, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                       .unionByName(down.select("a", F.col("m").alias("b"))).where("a != b").distinct(), "links")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def grouped(docs: DataFrame, size: int, near: int) -> tuple[DataFrame, DataFrame]:
    """Staged fingerprints, and (bits, root) for each distinct one: the least bits that it reaches."""
    marked = staged(fingerprints(docs, size), "fingerprints")
    distinct = staged(marked.select("bits").distinct(), "distinct-fingerprints")
    rooted = components(links(distinct, near))
    return marked, distinct.join(rooted, distinct["bits"] == rooted["node"], "left").select("bits", F.coalesce("root", "bits").alias("root"))


def near_duplicates(docs: DataFrame, size: int = SHINGLE, near: int = DISTANCE) -> DataFrame:
    """(doc_id, fingerprint, component_id) of each row: 16 hex digits, and the least doc_id reachable by links.

    Words lie between ASCII blanks, A-Z counts as a-z. A text of fewer words than a shingle is one shingle; a null or
    empty text has fingerprint zero, linked like any other. A null doc_id stays null and names no component, so one of
    rows without ids has a null component_id; repeated rows are one group; an empty table gives none.
    """
    marked, roots = grouped(docs, size, near)
    least = marked.groupBy("bits").agg(F.min("doc_id").alias("least")).join(roots, "bits").select("bits", "root", "least")
    named = least.groupBy("root").agg(F.min("least").alias("component_id"))
    of = roots.join(named, "root").select("bits", "component_id")
    return (marked.join(of, "bits")
            .select("doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id"))


def one_of_each(docs: DataFrame, size: int = SHINGLE, near: int = DISTANCE) -> DataFrame:
    """One row of each near-duplicate group of docs, with all its columns: that of the least doc_id (nulls last), then of
    the least text hash, then of the least hash of the other columns; rows that agree in all of them are one.
    """
    marked, roots = grouped(docs, size, near)
    order = F.struct(F.isnull("doc_id").alias("none"), F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"), "rest")
    first = marked.groupBy("bits").agg(F.min(order).alias("first")).join(roots, "bits").groupBy("root").agg(F.min("first").alias("first"))
    first = first.select(F.col("first.id").alias("of_id"), F.col("first.hash").alias("of_hash"), F.col("first.rest").alias("of_rest"))
    rows = docs.select(F.struct(*docs.columns).alias("doc"), F.col("doc_id").cast("long").alias("id"),
                       F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("hash"), _rest(docs).alias("rest"))
    same = F.col("id").eqNullSafe(F.col("of_id")) & (F.col("hash") == F.col("of_hash")) & (F.col("rest") == F.col("of_rest"))
    return rows.join(first, same, "left_semi").dropDuplicates(["id", "hash", "rest"]).select("doc.*")
