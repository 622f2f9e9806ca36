"""Token-id files with keyed access: raw ids in shards, and a minimal perfect hash from document keys to shard offsets.

A shard is one file that Spark's own sink commits: a frame per document, in ascending order of the key. A frame is a
16-byte head (key, number of ids, 1 for a null key) and the ids as little-endian unsigned integers of 2 bytes (4 where
the vocabulary has more than 65,536 entries). The last id of each frame is the end id, written as the sink's line end.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from limnos.llm.common import blocks, new_folder, offsets, staged
from limnos.llm.tokens import END_ID, TEXT_BYTES, encoder, tokenizer_path

HEAD = np.dtype([("key", "<i8"), ("n", "<u4"), ("null", "<u4")])
BUCKET_KEYS = 50_000
PER_SLOT = 2.0
LEVELS = 24
#: Frames of one run that a lookup reads at once.
STRETCH = 4096
ENTRY = "key long, none boolean, shard long, offset long, docs_before long, docs long"
INDEX = "bucket int, levels binary, slots binary, left binary"
SLOT = np.dtype([("print", "<u4"), ("shard", "<i8"), ("offset", "<i8"), ("before", "<i8"), ("docs", "<i8")])
LEFT = np.dtype([("key", "<i8"), ("none", "<u4"), ("nth", "<u4")])


@dataclass
class Store:
    """Folder of the shards, bytes of an id, index table, and tokens before each shard."""
    path: str
    item: int
    index: DataFrame
    bases: DataFrame
    buckets: int


def _frames(tokenizer: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for block in blocks(batches, "text", TEXT_BYTES):
            ids, counts = enc.block(block.column("text"))
            heads = np.zeros(len(counts), HEAD)
            key = block.column("doc_id")
            heads["key"] = key.fill_null(0).to_numpy(zero_copy_only=False)
            heads["null"] = key.is_null().to_numpy(zero_copy_only=False)
            heads["n"] = counts + 1
            raw, at = ids.tobytes(), (offsets(counts) * enc.dtype.itemsize).tolist()
            frames = [heads[i:i + 1].tobytes() + raw[at[i]:at[i + 1]] for i in range(len(counts))]
            yield pa.RecordBatch.from_arrays([pa.array(frames, pa.binary())], ["value"])
    return run


def write_shards(docs: DataFrame, path: str, tokenizer: str) -> int:
    """Write the frames of all rows in ascending doc_id order (nulls first); returns the bytes of an id.

    A hash of the row's number lets a range end between rows that share both id and text.
    """
    item = encoder(tokenizer).dtype.itemsize
    (docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("__tie"), F.xxhash64(F.monotonically_increasing_id()).alias("__row"))
     .repartitionByRange("doc_id", "__tie", "__row").sortWithinPartitions("doc_id", "__tie").select("doc_id", "text")
     .mapInArrow(_frames(tokenizer), "value binary").select(F.col("value").cast("string"))
     .write.option("lineSep", END_ID.to_bytes(item, "little").decode("latin-1")).text(path))
    return item


def _shards(spark: SparkSession, path: str, wanted: set[int] | None = None) -> DataFrame:
    """(shard, content): files in order, all or the wanted ones; a shard's number is that of the task that wrote it."""
    number = F.regexp_extract("path", r"part-(\d+)", 1).cast("long").alias("shard")
    files = spark.read.format("binaryFile").load(path)
    if wanted is not None:  # the list of files has a row per shard; their contents are not read for it
        named = {r["shard"]: r["path"] for r in files.select("path", number).collect()}
        if wanted and wanted < set(named):
            files = spark.read.format("binaryFile").load([named[i] for i in sorted(wanted)])
    return files.select(number, "content")


def _parse(content: np.ndarray, item: int, at: int = 0, docs: int | None = None) -> np.ndarray:
    """(place of the head, key, n, null) of each frame from `at` on."""
    out = array("q")
    view = memoryview(content)
    while at < len(content) and docs != 0:
        key, n, none = np.frombuffer(view, HEAD, 1, at)[0].tolist()
        out.extend((at, key, n, none))
        at += HEAD.itemsize + n * item
        docs = None if docs is None else docs - 1
    return np.array(out, np.int64).reshape(-1, 4)


def _content(column: pa.Array, i: int) -> np.ndarray:
    return np.frombuffer(column[i].as_buffer(), np.uint8)


def _entries(item: int):
    """Per shard, one row for each run of one key, and a row with the shard's totals (key and none null)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                shard, content = batch.column("shard")[i].as_py(), _content(batch.column("content"), i)
                found = _parse(content, item)
                new = np.flatnonzero(np.r_[True, (found[1:, [1, 3]] != found[:-1, [1, 3]]).any(axis=1)][:len(found)])
                runs, k = np.diff(np.r_[new, len(found)]), len(new)
                tokens = int(found[:, 2].sum())
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.r_[found[new, 1], 0], mask=np.r_[np.zeros(k, bool), True]),
                    pa.array(np.r_[found[new, 3] == 1, False], mask=np.r_[np.zeros(k, bool), True]),
                    pa.array(np.full(k + 1, shard)), pa.array(np.r_[found[new, 0], tokens]),
                    pa.array(np.r_[new, 0]), pa.array(np.r_[runs, len(found)])],
                    ["key", "none", "shard", "offset", "docs_before", "docs"])
    return run


def _hash(key: np.ndarray, none: np.ndarray, nth: np.ndarray, seed: int) -> np.ndarray:
    """64 mixed bits of a key, in unsigned arithmetic."""
    with np.errstate(over="ignore"):
        h = key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((seed * 0xD6E8FEB86659FD93) % 2 ** 64)
        h ^= (nth.astype(np.uint64) * np.uint64(2) + none.astype(np.uint64)) * np.uint64(0xC2B2AE3D27D4EB4F)
        for _ in range(2):
            h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(32))


class PerfectHash:
    """Minimal perfect hash by levels: a key takes the first level where no other key has its place.

    Keys left after the last level are listed and follow in order. The rank of a key's bit is its slot.
    """

    def __init__(self, levels: list[np.ndarray], left: np.ndarray):
        self.levels, self.left = levels, left
        self.ranks = [np.cumsum(np.r_[0, np.bitwise_count(bits)]) for bits in levels]
        self.bases = offsets(np.array([r[-1] for r in self.ranks] or [0], np.int64))

    @classmethod
    def fit(cls, key: np.ndarray, none: np.ndarray, nth: np.ndarray) -> PerfectHash:
        levels, rest = [], np.arange(len(key))
        while len(rest) and len(levels) < LEVELS:
            size = max(64, int(len(rest) * PER_SLOT))
            place = (_hash(key[rest], none[rest], nth[rest], len(levels)) % np.uint64(size)).astype(np.int64)
            single = np.bincount(place, minlength=size) == 1
            bits = np.zeros(-(-size // 64) * 64, np.uint8)
            bits[:size] = single
            levels.append(np.packbits(bits, bitorder="little").view(np.uint64))
            levels[-1] = np.r_[np.uint64(size), levels[-1]].astype(np.uint64)
            rest = rest[~single[place]]
        left = np.zeros(len(rest), LEFT)
        left["key"], left["none"], left["nth"] = key[rest], none[rest], nth[rest]
        return cls([x[1:] for x in levels], left)._sized([int(x[0]) for x in levels])

    def _sized(self, sizes: list[int]) -> PerfectHash:
        self.sizes = sizes
        return self

    def slots(self, key: np.ndarray, none: np.ndarray, nth: np.ndarray) -> np.ndarray:
        """Slot of each key; -1 for keys that no level and no list has. A strange key may get any slot."""
        out, rest = np.full(len(key), -1, np.int64), np.arange(len(key))
        for level, (bits, size) in enumerate(zip(self.levels, self.sizes)):
            place = (_hash(key[rest], none[rest], nth[rest], level) % np.uint64(size)).astype(np.int64)
            word, bit = bits[place >> 6], (place & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            out[rest[hit]] = (self.bases[level] + self.ranks[level][place >> 6] + below)[hit]
            rest = rest[~hit]
        if len(self.left):
            listed = {x: i for i, x in enumerate(self.left.tolist())}
            for i in rest.tolist():
                out[i] = listed.get((int(key[i]), int(none[i]), int(nth[i])), -1 - self.bases[-1]) + self.bases[-1]
        return out

    def dump(self) -> tuple[bytes, bytes]:
        head = np.array([len(self.levels), *self.sizes], "<u8")
        return head.tobytes() + b"".join(x.tobytes() for x in self.levels), self.left.tobytes()

    @classmethod
    def load(cls, levels: bytes, left: bytes) -> PerfectHash:
        data = np.frombuffer(levels, "<u8")
        sizes = data[1:1 + int(data[0])].astype(int).tolist()
        words = [-(-s // 64) for s in sizes]
        at = offsets(np.array(words, np.int64)) + 1 + len(sizes)
        return cls([data[a:b] for a, b in zip(at, at[1:])], np.frombuffer(left, LEFT))._sized(sizes)


def _print(key, none, nth):
    return (_hash(key, none, nth, 1000) >> np.uint64(32)).astype(np.uint32)


def _build(group: pa.Table) -> pa.Table:
    key, nth = (group[c].to_numpy() for c in ("key", "nth"))
    none = group["none"].to_numpy().astype(np.int64)
    hashed = PerfectHash.fit(key, none, nth)
    slots = np.zeros(len(key), SLOT)
    where = hashed.slots(key, none, nth)
    slots["print"][where] = _print(key, none, nth)
    for name, column in (("shard", "shard"), ("offset", "offset"), ("before", "docs_before"), ("docs", "docs")):
        slots[name][where] = group[column].to_numpy()
    levels, left = hashed.dump()
    return pa.table({"bucket": group["bucket"].slice(0, 1), "levels": pa.array([levels], pa.binary()),
                     "slots": pa.array([slots.tobytes()], pa.binary()), "left": pa.array([left], pa.binary())})


def _bucket(key: str, none: str, buckets: int):
    return F.pmod(F.xxhash64(key, none), F.lit(buckets)).cast("int").alias("bucket")


def write_store(docs: DataFrame, path: str, tokenizer: str | None = None) -> Store:
    """Write shards and index; see `lookup`. Keys are doc_id; a key that several rows share has all their frames."""
    spark = docs.sparkSession
    item = write_shards(docs, path, tokenizer or tokenizer_path())
    entries = staged(_shards(spark, path).mapInArrow(_entries(item), ENTRY), "token-entries")
    bases = entries.where("key IS NULL").select("shard", F.coalesce(
        F.sum("offset").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    keys = entries.where("key IS NOT NULL")
    buckets = max(1, keys.count() // BUCKET_KEYS)
    by_key = Window.partitionBy("key", "none").orderBy("shard")
    index = staged(keys.select("*", (F.row_number().over(by_key) - 1).cast("long").alias("nth"),
                               _bucket("key", "none", buckets)).groupBy("bucket").applyInArrow(_build, INDEX), "token-index")
    return Store(path, item, index, bases, buckets)


def _find(wanted: pa.Table, index: pa.Table) -> pa.Table:
    """Keys of one bucket: places of all their runs, by fingerprint."""
    found, rest = [], np.arange(wanted.num_rows)
    key, none = wanted["key"].to_numpy(), wanted["none"].to_numpy().astype(np.int64)
    if index.num_rows:
        hashed = PerfectHash.load(index["levels"][0].as_py(), index["left"][0].as_py())
        slots, nth = np.frombuffer(index["slots"][0].as_py(), SLOT), 0
        while len(rest):
            n = np.full(len(rest), nth)
            slot = hashed.slots(key[rest], none[rest], n)
            known = slots[np.maximum(slot, 0)]
            hit = (slot >= 0) & (known["print"] == _print(key[rest], none[rest], n))
            rest = rest[hit]
            found.append((rest, known[hit]))
            nth += 1
    rows = np.concatenate([r for r, _ in found] or [rest[:0]])
    slots = np.concatenate([s for _, s in found] or [np.zeros(0, SLOT)])
    return pa.table({"key": pa.array(key[rows]), "none": pa.array(none[rows] == 1), "shard": pa.array(slots["shard"]),
                     "offset": pa.array(slots["offset"]), "docs_before": pa.array(slots["before"]),
                     "docs": pa.array(slots["docs"])})


def _read(item: int):
    dtype = np.dtype(f"<u{item}")

    def run(places: pa.Table, shard: pa.Table) -> pa.Table:
        columns = {c: array("q") for c in ("doc_id", "none", "before", "n", "crc")}
        if places.num_rows and shard.num_rows:
            content = _content(shard["content"].combine_chunks() if isinstance(shard["content"], pa.ChunkedArray)
                               and shard["content"].num_chunks != 1 else shard["content"].chunk(0), 0)
            for place in places.to_pylist():
                wanted, end = (0 if place["none"] else place["key"], int(place["none"])), place["offset"]
                for nth in range(place["docs"]):
                    if nth % STRETCH == 0:
                        frames = _parse(content, item, end, min(STRETCH, place["docs"] - nth)).tolist()
                    at, key, n, none = frames[nth % STRETCH]
                    if (key, none) != wanted:
                        break  # a strange key that had a known fingerprint
                    end = at + HEAD.itemsize + n * item
                    ids = content[at + HEAD.itemsize:end].view(dtype)
                    values = key, none, (at - HEAD.itemsize * (place["docs_before"] + nth)) // item, n, zlib.crc32(ids.astype("<u4").tobytes())
                    for column, value in zip(columns.values(), values):
                        column.append(value)
        columns = {c: np.array(v, np.int64) for c, v in columns.items()}
        shards = pa.nulls(0, pa.int64()) if not places.num_rows else pa.array([places["shard"][0].as_py()] * len(columns["n"]), pa.int64())
        return pa.table({"doc_id": pa.array(columns["doc_id"], pa.int64(), mask=columns["none"] == 1), "shard": shards,
                         "before": pa.array(columns["before"], pa.int64()), "n_tokens": pa.array(columns["n"], pa.int64()),
                         "ids_crc32": pa.array(columns["crc"], pa.int64())})
    return run


def lookup(store: Store, keys: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) for each frame of each distinct key of `keys` (doc_id, null allowed).

    A key goes to its bucket, the hash gives one slot, the fingerprint in it is compared, and the head of the frame in
    the shard is compared again, so unknown keys give no row. Only the files of shards that a key names are opened.
    """
    spark = keys.sparkSession
    wanted = keys.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("key"), F.isnull("doc_id").alias("none")).distinct()
    places = (wanted.withColumn("bucket", _bucket("key", "none", store.buckets)).groupBy("bucket")
              .cogroup(store.index.groupBy("bucket")).applyInArrow(_find, ENTRY))
    places = staged(places, "token-places")
    named = {r["shard"] for r in places.select("shard").distinct().collect()}  # a row per shard
    read = (places.groupBy("shard").cogroup(_shards(spark, store.path, named).groupBy("shard"))
            .applyInArrow(_read(store.item), "doc_id long, shard long, before long, n_tokens long, ids_crc32 long"))
    return read.join(store.bases, "shard").select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def token_store(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Write all rows of docs (doc_id, text) to a new store in the shared folder and look all keys up again.

    A null text is empty (the end id alone); a null doc_id comes first; rows with one doc_id lie side by side; repeated
    rows stay repeated; an empty table gives an empty result; other columns are not read.
    """
    store = write_store(docs, new_folder(docs.sparkSession, "token-ids"), tokenizer)
    return lookup(store, docs.select("doc_id"))
