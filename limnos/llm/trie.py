"""Prefix trie of conversations by time-forward processing.

Conversations are rebuilt around shared openings, and every prefix of one gets a key: the exclusive or of hashes of (depth, turn),
which adds up over the partitions that a long conversation reaches into. Groups of conversations are shards, cut once more by bands of
depth. A shard holds the nodes that its conversations pass, sorted externally in reverse level order; each node takes the messages of
its children from a priority queue that spills, adds its own values and sends the totals on to its parent. A node's own values
count in one shard alone, that of its smallest member, so the totals of a node that several shards hold add up. Where conversations are
deeper than a band, the totals of the bands' top nodes go through the same process first, from shard root to shard root.
"""

from __future__ import annotations

import hashlib
import heapq
import pickle
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from limnos.llm.common import staged
from limnos.session import cores

#: Conversations of one base: conversation c opens with turns of conversation c - c % BASE.
BASE, MOST_SHARED = 20, 4
#: Levels of a shard; nodes that a shard should hold; messages that a task keeps in memory; bytes of one piece of a list of members.
BAND = 4096
SHARD_NODES = 20_000
QUEUE_MESSAGES = 200_000
PIECE_BYTES = 1 << 16
KEY = ["depth", "k1", "k2"]
EMPTY = hashlib.sha256(b"").hexdigest()


class SpillingQueue:
    """Priority queue of tuples: a heap of bounded size, and sorted runs in files that live as long as the task."""

    def __init__(self, limit: int = QUEUE_MESSAGES, most_runs: int = 32):
        self.limit, self.most_runs = limit, most_runs
        self.heap: list[tuple] = []
        self.runs: list[tuple] = []  # heap of (least item, number, rest of the run)
        self.made = 0

    def push(self, item: tuple) -> None:
        heapq.heappush(self.heap, item)
        if len(self.heap) > self.limit:
            self._add(iter(sorted(self.heap)))
            self.heap = []
            if len(self.runs) > self.most_runs:
                runs, self.runs = self.runs, []
                self._add(heapq.merge(*[_chained(first, rest) for first, _, rest in runs]))

    def _add(self, items: Iterator[tuple]) -> None:
        file = tempfile.TemporaryFile()
        part: list[tuple] = []
        for item in items:
            part.append(item)
            if len(part) == 4096:
                pickle.dump(part, file)
                part = []
        pickle.dump(part, file)
        pickle.dump(None, file)
        file.seek(0)
        self._queue(_read(file))

    def _queue(self, rest: Iterator[tuple]) -> None:
        first = next(rest, None)
        if first is not None:
            self.made += 1
            heapq.heappush(self.runs, (first, self.made, rest))

    def least(self) -> tuple | None:
        heads = ([self.heap[0]] if self.heap else []) + ([self.runs[0][0]] if self.runs else [])
        return min(heads, default=None)

    def pop(self) -> tuple:
        if not self.runs or (self.heap and self.heap[0] <= self.runs[0][0]):
            return heapq.heappop(self.heap)
        first, _, rest = heapq.heappop(self.runs)
        self._queue(rest)
        return first


def _chained(first: tuple, rest: Iterator[tuple]) -> Iterator[tuple]:
    yield first
    yield from rest


def _read(file) -> Iterator[tuple]:
    with file:
        while (part := pickle.load(file)) is not None:
            yield from part


# --- conversations, rebuilt ----------------------------------------------------------------------

TURN = "conv_id long, segment int, at long, digest binary, words long"


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (conv_id, ...) in order with their place among their conversation's rows in this partition."""
    from pyspark import TaskContext
    segment, last, done = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        conv = batch.column("conv_id").to_numpy()
        head = np.r_[True, conv[1:] != conv[:-1]]
        first = np.maximum.accumulate(np.where(head, np.arange(n), 0))
        at = np.arange(n) - first
        if conv[0] == last:
            at[:int(np.argmax(conv != last)) if (conv != last).any() else n] += done
        last, done = conv[-1], int(at[-1]) + 1
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(np.full(n, segment), pa.int32()), pa.array(at, pa.int64()),
                                          batch.column("digest"), batch.column("words")], ["conv_id", "segment", "at", "digest", "words"])


def _word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, "[ \\t-\\r]+"), lambda w: w != "")).cast("long")


def _turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, pos, digest, words), and (conv_id, total); digests stand for role and text from here on."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)).alias("digest"), _word_count(text).alias("words"))
    order = ["conv_id", "turn", "digest"]
    laid = staged(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_numbered, TURN), "turns")
    counts = laid.groupBy("conv_id", "segment").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("conv_id").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("conv_id", "segment", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    turns = laid.join(starts, ["conv_id", "segment"]).select("conv_id", (F.col("before") + F.col("at")).alias("pos"), "digest", "words")
    return turns, counts.groupBy("conv_id").agg(F.sum("n").alias("total"))


def _rebuilt(turns: DataFrame, totals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns of the rebuilt conversations (conv_id, depth, digest, words, last), and (conv_id, size)."""
    conv = F.col("conv_id")
    base = totals.where(conv % BASE == 0).select(conv.alias("base"), F.col("total").alias("base_total"))
    h = F.crc32(conv.cast("string")) % MOST_SHARED
    info = totals.withColumns({"base": conv - conv % BASE, "h": h}).join(base, "base", "left")
    info = info.withColumn("shared", F.least("h", F.coalesce("base_total", F.lit(0))))
    info = staged(info.withColumn("size", F.col("shared") + F.greatest(F.col("total") - F.col("h"), F.lit(0))), "conversations")
    heads = turns.where((conv % BASE == 0) & (F.col("pos") < MOST_SHARED - 1)).withColumnRenamed("conv_id", "base")
    opening = (info.where("shared > 0").select("conv_id", "base", "h", "size").join(heads, "base").where("pos < h")
               .select("conv_id", (F.col("pos") + 1).alias("depth"), "digest", "words", "size"))
    own = (turns.join(info.select("conv_id", "h", "shared", "size"), "conv_id").where("pos >= h")
           .select("conv_id", (F.col("shared") + F.col("pos") - F.col("h") + 1).alias("depth"), "digest", "words", "size"))
    rows = opening.unionByName(own).withColumn("last", F.col("depth") == F.col("size")).drop("size")
    return rows, info.select("conv_id", "size")


PATH = "conv_id long, depth long, words long, last boolean, v1 long, v2 long, k1 long, k2 long, segment int"


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by (conv_id, depth) with the exclusive or of their conversation's values in this partition so far."""
    from pyspark import TaskContext
    segment, last, held = TaskContext.get().partitionId(), None, {"v1": 0, "v2": 0}
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        conv = batch.column("conv_id").to_numpy()
        first = np.maximum.accumulate(np.where(np.r_[True, conv[1:] != conv[:-1]], np.arange(n), 0))
        keys = []
        for name in ("v1", "v2"):
            running = np.bitwise_xor.accumulate(batch.column(name).to_numpy())
            key = running ^ np.r_[np.int64(0), running][first]
            if conv[0] == last:
                key[first == 0] ^= held[name]
            held[name] = key[-1]
            keys.append(pa.array(key))
        last = conv[-1]
        yield pa.RecordBatch.from_arrays([*batch.columns, *keys, pa.array(np.full(n, segment), pa.int32())], [*batch.schema.names, "k1", "k2", "segment"])


def _paths(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """(conv_id, depth, words, last, k1, k2, p1, p2): key of each prefix of each conversation and of the one before, the empty one included."""
    valued = rows.select("conv_id", "depth", "words", "last", F.xxhash64("depth", "digest").alias("v1"), F.xxhash64("digest", F.lit(1), "depth").alias("v2"))
    laid = staged(valued.repartitionByRange("conv_id", "depth").sortWithinPartitions("conv_id", "depth").mapInArrow(_prefixes, PATH), "paths")
    # what a conversation's earlier partitions add; only those that reach into several have any
    sums = laid.groupBy("conv_id", "segment").agg(F.bit_xor("v1").alias("s1"), F.bit_xor("v2").alias("s2"))
    before = Window.partitionBy("conv_id").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    more = sums.select("conv_id", "segment", F.bit_xor("s1").over(before).alias("o1"), F.bit_xor("s2").over(before).alias("o2")).where("o1 IS NOT NULL")
    whole = laid.join(more, ["conv_id", "segment"], "left")

    def key(i: int) -> Column:
        return F.col(f"k{i}").bitwiseXOR(F.coalesce(f"o{i}", F.lit(0)))

    out = whole.select("conv_id", "depth", "words", "last", key(1).alias("k1"), key(2).alias("k2"),
                       key(1).bitwiseXOR(F.col("v1")).alias("p1"), key(2).bitwiseXOR(F.col("v2")).alias("p2"))
    zero = F.lit(0).cast("long")
    empty = sizes.select("conv_id", zero.alias("depth"), zero.alias("words"), (F.col("size") == 0).alias("last"),
                         *[zero.alias(c) for c in ("k1", "k2", "p1", "p2")])
    return out.unionByName(empty)


# --- totals, from children to parents ------------------------------------------------------------

NODE = ["shard", "band", "depth", "k1", "k2", "p1", "p2", "top", "ghost", "owned", "owner", "leaves", "saved"]
TOTAL = "shard int, band int, depth long, k1 long, k2 long, parent_conv_id long, n_children long, n_leaves long, saved_tokens long"
TOTAL_SCHEMA = pa.schema([(c.split()[0], pa.int32() if c.endswith(" int") else pa.int64()) for c in TOTAL.split(", ")])


def _forward(limit: int):
    """Totals of nodes that come shard by shard in reverse level order (depth descending, then key).

    A message is addressed to the parent by its place in that order. It carries the child's key and totals, and the child's
    row is written when the parent takes it, as the parent's smallest member is known there. A `top` node has no
    parent in its shard. A `ghost` stands for a node of the band below: it passes its totals on and has no totals of its own here.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queue, shard, out = SpillingQueue(limit), None, []

        def batch() -> pa.RecordBatch:
            columns = list(zip(*out)) or [()] * len(TOTAL_SCHEMA)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, TOTAL_SCHEMA)], schema=TOTAL_SCHEMA)

        for part in batches:
            for number, band, depth, k1, k2, p1, p2, top, ghost, owned, owner, leaves, saved in zip(*[part.column(c).to_pylist() for c in NODE]):
                if (number, band) != shard:
                    if queue.least() is not None:
                        raise AssertionError("messages left over: a parent is missing in its shard")
                    shard = number, band
                address, children = (-depth, k1, k2), 0
                while (message := queue.least()) is not None and message[:3] == address:
                    _, _, _, d, c1, c2, is_ghost, is_owned, of_child, of_leaves, of_saved = queue.pop()
                    children, leaves, saved = children + is_owned, leaves + of_leaves, saved + of_saved
                    out.append((number, band, d, c1, c2, owner, *((0, 0, 0) if is_ghost else (of_child, of_leaves, of_saved))))
                if top:
                    out.append((number, band, depth, k1, k2, None, children, leaves, saved))
                else:
                    queue.push((1 - depth, p1, p2, depth, k1, k2, int(ghost), int(owned), children, leaves, saved))
                if len(out) >= 8192:
                    yield batch()
        if queue.least() is not None:
            raise AssertionError("messages left over: a parent is missing in its shard")
        yield batch()

    return run


def _totals(nodes: DataFrame, limit: int) -> DataFrame:
    laid = nodes.select(*NODE).repartition("shard", "band").sortWithinPartitions("shard", "band", F.desc("depth"), "k1", "k2")
    return laid.mapInArrow(_forward(limit), TOTAL)


def _shard_roots(nodes: DataFrame, paths: DataFrame, band: int, limit: int) -> DataFrame:
    """Ghosts of the top nodes of the lower bands with all that lies below them, for the shards of the bands above.

    The totals inside each band come first; then the top nodes alone, each below the top of the band before it, pass
    theirs on in the same way: levels are bands there.
    """
    inside = _totals(nodes.where("band > 0"), limit).where(F.col("depth") == F.col("band") * band)
    inside = staged(inside.select("shard", "band", "depth", "k1", "k2", F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved")), "band-tops")
    at_top = paths.where((F.col("depth") > 0) & (F.col("depth") % band == 0))
    above = Window.partitionBy("conv_id").orderBy("depth")
    linked = at_top.select("shard", "depth", "k1", "k2", F.lag("k1").over(above).alias("p1"), F.lag("k2").over(above).alias("p2")).distinct()
    roots = inside.join(linked, ["shard", *KEY]).select(
        "shard", F.lit(0).alias("band"), (F.col("depth") / band).cast("long").alias("depth"), "k1", "k2", F.coalesce("p1", F.lit(0)).alias("p1"), F.coalesce("p2", F.lit(0)).alias("p2"),
        (F.col("depth") == band).alias("top"), F.lit(False).alias("ghost"), F.lit(False).alias("owned"), F.lit(0).cast("long").alias("owner"), "leaves", "saved")
    # a root's row is written by its parent, the uppermost ones' by themselves
    summed = _totals(roots, limit).select("shard", (F.col("depth") * band).alias("depth"), "k1", "k2", F.col("n_leaves").alias("t_leaves"), F.col("saved_tokens").alias("t_saved"))
    tops = nodes.where(F.col("top") & (F.col("band") > 0)).join(staged(summed, "roots"), ["shard", *KEY])
    return tops.select("shard", (F.col("band") - 1).alias("band"), *KEY, "p1", "p2", F.lit(False).alias("top"), F.lit(True).alias("ghost"), "owned", "owner",
                       F.col("t_leaves").alias("leaves"), F.col("t_saved").alias("saved"))


# --- members that end at a node ------------------------------------------------------------------

def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of rows (depth, k1, k2, conv_id) of one node as pieces of text, in order."""
    from pyspark import TaskContext
    base, made, key, held, size, out = TaskContext.get().partitionId() << 32, 0, None, [], 0, []

    def batch() -> pa.RecordBatch:
        columns = list(zip(*out)) or [()] * 5
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 4 + [pa.binary()])], [*KEY, "place", "ids"])

    def close() -> None:
        nonlocal held, size, made
        if held:
            out.append((*key, base + made, ",".join(held).encode()))
            held, size, made = [], 0, made + 1

    for part in batches:
        for depth, k1, k2, conv in zip(*[part.column(c).to_pylist() for c in [*KEY, "conv_id"]]):
            if (depth, k1, k2) != key or size > PIECE_BYTES:
                close()
                key = depth, k1, k2
            held.append(str(conv))
            size += len(held[-1]) + 1
        if len(out) >= 4096:
            yield batch()
    close()
    yield batch()


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's pieces, fed in as they come."""
    key, state, out = None, None, []

    def batch() -> pa.RecordBatch:
        columns = list(zip(*out)) or [()] * 4
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 3 + [pa.string()])], [*KEY, "ends_sha256"])

    for part in batches:
        for depth, k1, k2, ids in zip(*[part.column(c).to_pylist() for c in [*KEY, "ids"]]):
            if (depth, k1, k2) == key:
                state.update(b",")
            else:
                if key:
                    out.append((*key, state.hexdigest()))
                key, state = (depth, k1, k2), hashlib.sha256()
            state.update(ids)
        if len(out) >= 4096:
            yield batch()
    if key:
        out.append((*key, state.hexdigest()))
    yield batch()


def _end_digests(paths: DataFrame) -> DataFrame:
    """Digest of the members that end at each node. A node's ids come in pieces that tasks before have joined and are read one by one."""
    order = [*KEY, "conv_id"]
    pieces = paths.where("last").select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_pieces, "depth long, k1 long, k2 long, place long, ids binary")
    return (pieces.repartition(*KEY).sortWithinPartitions(*KEY, "place")
            .mapInArrow(_digested, "depth long, k1 long, k2 long, ends_sha256 string"))


def prefix_trie(conversations: DataFrame, band: int = BAND, shard_nodes: int = SHARD_NODES, queue_messages: int = QUEUE_MESSAGES) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of each node of the trie.

    Reads conv_id, turn, role and text. Turns are in the order of `turn`, nulls first, equal ones by a digest of role and text;
    repeated rows are turns each; a null role or text is empty. Rows without a conv_id belong to no conversation and are left out.
    Conversation c is rebuilt from the first h turns of conversation c - c % 20 (h = crc32 of its decimal id, modulo 4) and its own
    after the first h. conv_id is the node's smallest member and parent_conv_id its parent's; the root has depth 0 and no parent; an
    empty table gives no node. Prefixes are told apart by 128 bits of hashes.

    No task holds a node's members or children: only their counts and sums move, and the ids of members that end at one node
    pass through its digest in pieces. Spill files of the queues are a task's own and end with it.
    """
    rows, sizes = _rebuilt(*_turns(conversations))
    paths = _paths(rows, sizes)
    n_rows = sizes.agg(F.sum(F.col("size") + 1)).first()[0] or 0
    shards = max(4 * cores(conversations), -(-n_rows // shard_nodes))
    group = F.pmod(F.xxhash64((F.col("conv_id") - F.col("conv_id") % BASE)), F.lit(shards)).cast("int")
    paths = staged(paths.withColumn("shard", group), "prefixes")
    local = staged(paths.groupBy("shard", *KEY, "p1", "p2").agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n"), F.sum(F.col("last").cast("long")).alias("ends"), F.max("words").alias("words")), "shard-nodes")
    every = local.groupBy(*KEY).agg(F.min("conv_id").alias("owner"), F.sum("n").alias("n_convs"), F.sum("ends").alias("n_ends"))
    both = local.join(every, KEY).withColumn("owned", F.col("conv_id") == F.col("owner")).withColumn("band", (F.col("depth") / band).cast("int"))
    mine = F.col("owned").cast("long")
    nodes = both.select(
        "shard", "band", *KEY, "p1", "p2", (F.col("depth") == F.col("band") * band).alias("top"), F.lit(False).alias("ghost"), "owned", "owner",
        (mine * (F.col("n_convs") == F.col("n_ends")).cast("long")).alias("leaves"), (mine * (F.col("n_convs") - 1) * F.col("words")).alias("saved"))
    if (sizes.agg(F.max("size")).first()[0] or 0) >= band:
        nodes = staged(nodes, "nodes")
        nodes = nodes.unionByName(_shard_roots(nodes, paths, band, queue_messages))
    totals = _totals(nodes, queue_messages)
    none = {"conv_id": "long", "n_convs": "long", "parent_conv_id": "long", "n_children": "long", "n_leaves": "long", "saved_tokens": "long", "ends_sha256": "string"}

    def part(df: DataFrame) -> DataFrame:
        return df.select(*KEY, *[(F.col(c) if c in df.columns else F.lit(None)).cast(kind).alias(c) for c, kind in none.items()])

    parts = part(local.select(*KEY, "conv_id", F.col("n").alias("n_convs"))).unionByName(part(totals)).unionByName(part(_end_digests(paths)))
    out = parts.groupBy(*KEY).agg(F.min("conv_id").alias("conv_id"), F.max("parent_conv_id").alias("parent_conv_id"),
                                  *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
                                  F.coalesce(F.max("ends_sha256"), F.lit(EMPTY)).alias("ends_sha256"))
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")



#: DuckDB text. Prefixes are compared as whole lists; crc32 goes bit by bit over the digits of the id.
ORACLE = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY turn NULLS FIRST, sha256(length(role)::VARCHAR || ':' || role || text)) AS turns
        FROM c GROUP BY conv_id),
h AS (SELECT conv_id, turns, conv_id - conv_id % {BASE} AS base, xor(list_reduce(
        list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda d: ascii(d)::BIGINT)),
        lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda s, z: xor(s >> 1, 3988292384 * (s & 1)))), 4294967295) % {MOST_SHARED} AS h FROM own),
r AS (SELECT h.conv_id, list_concat(list_slice(coalesce(b.turns, []), 1, h.h), list_slice(h.turns, h.h + 1, len(h.turns))) AS turns FROM h LEFT JOIN own b ON b.conv_id = h.base),
p AS (SELECT conv_id, d, md5(list_slice(turns, 1, d)::JSON::VARCHAR) AS k, md5(list_slice(turns, 1, d - 1)::JSON::VARCHAR) AS up, d = len(turns) AS last,
             CASE WHEN d > 0 THEN len(list_filter(regexp_split_to_array(turns[d].text, '[ \t-\r]+'), lambda x: x <> '')) ELSE 0 END AS words
      FROM (SELECT *, unnest(range(0, len(turns) + 1)) AS d FROM r)),
n AS (SELECT d, k, min(conv_id) AS conv_id, any_value(up) AS up, count(*) AS n_convs, count(*) FILTER (last) AS n_ends, any_value(words) AS words,
             sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (last), '')) AS ends FROM p GROUP BY d, k),
t AS (SELECT a.d, a.k, sum((n.n_convs = n.n_ends)::INT) AS n_leaves, sum((n.n_convs - 1) * n.words) AS saved, count(*) FILTER (n.d = a.d + 1) AS n_children
      FROM n JOIN p a ON a.conv_id = n.conv_id AND a.d <= n.d GROUP BY a.d, a.k)
SELECT n.conv_id, n.d::BIGINT AS depth, u.conv_id AS parent_conv_id, n.n_convs, n_children, n_leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, n.ends AS ends_sha256
FROM n JOIN t ON t.d = n.d AND t.k = n.k LEFT JOIN n u ON u.d = n.d - 1 AND u.k = n.up AND n.d > 0
"""
