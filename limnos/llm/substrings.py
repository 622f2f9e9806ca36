"""Exact substring dedup over all documents by seed and extend.

Seeds are winnowed anchors: of each run of `window - seed + 1` consecutive word seeds the least hash is picked, so two
equal windows pick the same anchor at the same place. Documents meet on anchors that occur more than once. In place of
extending a match word by word, the whole windows that picked the anchor are counted by 63 bits of their hash, as pairs
of occurrences would grow with the square of a common anchor. Every part of `window` words of a longer repeat is itself
a repeated window, so the union of repeated windows has the words that extension would give; the repeats as such, and
which occurrences belong to each, are not made.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from limnos.llm.common import blocks, coded, offsets, split_words, staged, tidy, tidy_pair

WINDOW = 35
SEED = 12
#: Occurrences of an anchor that meet in one group; more common anchors are divided by the hash of the window.
GROUP = 2048
#: Text of a block: bounds the memory of a task.
TEXT_BYTES = 4 << 20
STAGE = "block long, data binary, anchor long, times long"
WINDOWS = "anchor long, part int, block long, windows binary"
FOUND = "block long, data binary"
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, removed array<struct<first:int,last:int>>"

ODD_1, ODD_2 = 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03


def _mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
        return h ^ (h >> np.uint64(33))


def _gram(words: np.ndarray, size: int, odd: int) -> np.ndarray:
    """Hash of the `size` words from each place on, by doubling; places too near the end are left out."""
    total, done, part, width = None, 0, words, 1
    while width <= size:
        if size & width:
            total, done = (part if total is None else _joined(total, part, done, odd)), done + width
        part, width = _joined(part, part, width, odd), 2 * width
    return _mix(total[:max(0, len(words) - size + 1)])


def _joined(left: np.ndarray, right: np.ndarray, shift: int, odd: int) -> np.ndarray:
    n = max(0, min(len(left), len(right) - shift))
    with np.errstate(over="ignore"):
        return left[:n] + right[shift:shift + n] * np.uint64(pow(odd, shift, 2 ** 64))


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the least value in each run of `width` values; the last one of equal values."""
    at = np.arange(len(values))
    best, reach = at, 1
    while reach < width:
        step = min(reach, width - reach)
        left, right = best[:len(best) - step], best[step:]
        best = np.where(values[right] <= values[left], right, left)
        reach += step
    return best


class Words:
    """Word hashes of a block of texts, and for each full window the place of its anchor."""

    def __init__(self, texts: pa.Array, window: int, seed: int):
        self.words, self.counts = split_words(texts)
        codes, names = coded(self.words)
        digests = b"".join(xxhash.xxh3_128_digest(name) for name in names.to_pylist())
        pairs = np.frombuffer(digests, "<u8").reshape(-1, 2)
        self.at = offsets(self.counts)
        first, second = (pairs[codes, i] for i in range(2))
        ends = np.repeat(self.at[1:], self.counts)
        place = np.arange(len(codes))
        # seeds may reach into the next text, windows are taken inside a text only
        self.seeds = _gram(first, seed, ODD_1)
        hashes = _gram(second, window, ODD_2)
        inside = place[:len(hashes)] + window <= ends[:len(hashes)]
        self.starts = np.flatnonzero(inside)
        self.hashes = hashes[self.starts]
        self.anchors = _least(self.seeds, window - seed + 1)[self.starts] if len(self.starts) else self.starts


def _packed(block: pa.RecordBatch) -> bytes:
    """A block's rows with all their columns, compressed: texts are written once and shuffled twice."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, block.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))) as writer:
        writer.write_batch(block)
    return sink.getvalue().to_pybytes()


def _unpacked(rows: pa.Table) -> pa.Table:
    """The rows of one block from its only row."""
    with pa.ipc.open_stream(rows["data"][0].as_buffer()) as reader:
        return reader.read_all()


def _anchors(window: int, seed: int):
    """Each block's rows as one, and its distinct anchors with their number of places."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        base = TaskContext.get().partitionId() << 32
        names = ["block", "data", "anchor", "times"]
        for number, block in enumerate(blocks(batches, "text", TEXT_BYTES)):
            found = Words(block.column("text"), window, seed)
            anchors, times = np.unique(found.seeds[np.unique(found.anchors)], return_counts=True)
            del found
            k = len(anchors)
            yield pa.RecordBatch.from_arrays([pa.array([base + number]), pa.array([_packed(block)], pa.binary()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64())], names)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(k, base + number)), pa.nulls(k, pa.binary()), pa.array(anchors.view(np.int64)), pa.array(times)], names)
    return run


def _by_block(block: np.ndarray, *columns: np.ndarray) -> Iterator[tuple]:
    if not len(block):
        return
    order = np.argsort(block, kind="stable")
    block = block[order]
    cuts = np.flatnonzero(np.r_[True, block[1:] != block[:-1], True])
    columns = [c[order] for c in columns]
    for a, b in zip(cuts, cuts[1:]):
        yield int(block[a]), *(c[a:b] for c in columns)


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Sorted batches again, cut so that no key is in two of them."""
    kept = None
    for batch in batches:
        now = pa.Table.from_batches([batch])
        if kept is not None:
            now = pa.concat_tables([kept, now])
        last = np.ones(now.num_rows, bool)
        for key in keys:
            column = now[key].to_numpy()
            last &= column == column[-1]
        end = int(np.flatnonzero(~last)[-1]) + 1 if not last.all() else 0
        if end:
            yield now.slice(0, end)
        kept = now.slice(end)
    if kept is not None and kept.num_rows:
        yield kept


def _repeated_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by anchor: tell each block its anchors that occur again, and in how many parts to divide them."""
    for part in _runs(batches, ["anchor"]):
        anchor, block, times = (part[c].to_numpy() for c in ("anchor", "block", "times"))
        new = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
        total = np.add.reduceat(times, new)
        total = np.repeat(total, np.diff(np.r_[new, len(anchor)]))
        keep = total > 1
        parts = np.ones(len(anchor), np.int32)
        parts[keep] = 2 ** np.ceil(np.log2(np.maximum(1, total[keep] / GROUP))).astype(np.int32)
        rows = [(b, np.r_[a.view("<u8"), p.astype("<u8")].tobytes())
                for b, a, p in _by_block(block[keep], anchor[keep], parts[keep])]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())],
                                         ["block", "data"])


def _pairs(data: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    halves = [np.split(np.frombuffer(d, "<u8"), 2) for d in data]
    return np.concatenate([h[0] for h in halves]), np.concatenate([h[1] for h in halves])


def _text(docs: pa.Table) -> pa.Array:
    column = docs["text"].combine_chunks()
    return column if isinstance(column, pa.Array) else pa.concat_arrays(column.chunks)


def _windows(window: int, seed: int):
    """A block's windows that picked a repeated anchor: one row per anchor and part with their distinct hashes.

    Bit 0 of what is sent is 1 for a window that the block holds more than once.
    """
    def run(docs: pa.Table, told: pa.Table) -> pa.Table:
        columns = ([], [], [], [])
        if docs.num_rows and told.num_rows:
            found = Words(_text(_unpacked(docs)), window, seed)
            known, parts = _pairs(told["data"].to_pylist())
            order = np.argsort(known)
            known, parts = known[order], parts[order]
            anchor = found.seeds[found.anchors]
            at = np.minimum(np.searchsorted(known, anchor), len(known) - 1)
            hit = known[at] == anchor
            anchor, hashes, n = anchor[hit], found.hashes[hit], parts[at[hit]]
            part = (hashes >> np.uint64(40)) % n
            order = np.lexsort((hashes, part, anchor))
            anchor, hashes, part = anchor[order], hashes[order], part[order]
            new = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (hashes[1:] != hashes[:-1])][:len(anchor)])
            times = np.diff(np.r_[new, len(anchor)])
            anchor, part = anchor[new], part[new]
            sent = (hashes[new] & ~np.uint64(1)) | (times > 1).astype(np.uint64)
            cuts = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (part[1:] != part[:-1]), True][:len(anchor) + 1]) \
                if len(anchor) else np.zeros(1, int)
            raw = sent.astype("<u8").tobytes()
            columns = (anchor[cuts[:-1]].view(np.int64), part[cuts[:-1]].astype(np.int32),
                       np.full(len(cuts) - 1, docs["block"][0].as_py()),
                       [raw[8 * a:8 * b] for a, b in zip(cuts, cuts[1:])])
        return pa.table([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int64()),
                         pa.array(columns[3], pa.binary())], ["anchor", "part", "block", "windows"])
    return run


def _repeated_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by anchor and part: tell each block its windows that start anywhere else, too."""
    for group in _runs(batches, ["anchor", "part"]):
        windows = group["windows"].to_pylist()
        each = np.fromiter(map(len, windows), np.int64, len(windows)) // 8
        hashes = np.frombuffer(b"".join(windows), "<u8")
        anchor = np.repeat(group["anchor"].to_numpy(), each)
        block = np.repeat(group["block"].to_numpy(), each)
        many, plain = hashes & np.uint64(1) == 1, hashes & ~np.uint64(1)
        order = np.lexsort((plain, anchor))
        anchor, block, plain, many = anchor[order], block[order], plain[order], many[order]
        new = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (plain[1:] != plain[:-1])])
        times = np.diff(np.r_[new, len(anchor)])
        keep = np.repeat(times, times) > 1
        keep |= many  # a hash held twice by one block is one row
        rows = [(b, np.r_[a.view("<u8"), h].tobytes()) for b, a, h in _by_block(block[keep], anchor[keep], plain[keep])]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())],
                                         ["block", "data"])


def _both(anchor: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _mix(anchor * np.uint64(ODD_1) + (hashes & ~np.uint64(1)))


REMOVED = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def _cut(raw: bytes, runs: list[dict]) -> str:
    """Text without the words of the runs and the blanks after them."""
    ends = [m.span() for m in WORD.finditer(raw)]
    parts, last = [], 0
    for run in runs:
        parts.append(raw[last:ends[run["first"]][0]])
        last = ends[run["last"] + 1][0] if run["last"] + 1 < len(ends) else len(raw)
    return (b"".join(parts) + raw[last:]).decode()


def _cover(window: int, seed: int, with_text: bool):
    """A block's result: words inside repeated windows, their runs, the digest of the rest, and the text without them."""
    def run(docs: pa.Table, told: pa.Table) -> pa.Table:
        docs = _unpacked(docs)
        texts = _text(docs)
        words, counts = split_words(texts)
        at, gone = offsets(counts), np.zeros(len(words), bool)
        if told.num_rows and docs.num_rows:
            anchor, hashes = _pairs(told["data"].to_pylist())
            found = Words(texts, window, seed)
            hit = found.starts[np.isin(_both(found.seeds[found.anchors], found.hashes), _both(anchor, hashes))]
            edge = np.zeros(len(words) + 1, np.int64)
            np.add.at(edge, hit, 1)
            np.add.at(edge, hit + window, -1)
            gone = np.cumsum(edge[:-1]) > 0
        total = offsets(gone)
        removed = total[at[1:]] - total[at[:-1]]
        shas, runs, kept = [], [], []
        for i, text in enumerate(texts.to_pylist()):
            raw = (text or "").encode()
            own, cuts = raw.split(), []
            if removed[i]:
                mask = gone[at[i]:at[i + 1]]
                cuts = [{"first": a, "last": b - 1} for a, b in np.flatnonzero(np.diff(np.r_[0, mask, 0])).reshape(-1, 2).tolist()]
                own = [w for w, m in zip(own, mask.tolist()) if not m]
            if with_text:
                kept.append(_cut(raw, cuts) if cuts else text)
            shas.append(hashlib.sha256(b" ".join(own)).hexdigest())
            runs.append(cuts)
        out = {"doc_id": docs["doc_id"], "n_words": pa.array(counts), "n_removed": pa.array(removed), "kept_sha256": pa.array(shas, pa.string()),
               "removed": pa.array(runs, REMOVED)}
        if with_text:
            out |= {"text": pa.array(kept, pa.string()), "rest": docs["rest"]}
        return pa.table(out)
    return run


def repeats(docs: DataFrame, window: int, seed: int, with_text: bool) -> DataFrame:
    """Result rows (see RESULT); with `with_text` also the text that is left and `rest`, a struct of the other columns."""
    rest = [F.struct(*[c for c in docs.columns if c != "text"]).alias("rest")] if with_text else []
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *rest)
    both = staged(rows.mapInArrow(tidy(_anchors(window, seed)), STAGE), "anchors")
    texts = both.where("data IS NOT NULL").select("block", "data")
    anchors = both.where("anchor IS NOT NULL").select("anchor", "block", "times")
    again = anchors.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(tidy(_repeated_anchors), FOUND)
    near = texts.groupBy("block").cogroup(again.groupBy("block")).applyInArrow(tidy_pair(_windows(window, seed)), WINDOWS)
    found = near.repartition("anchor", "part").sortWithinPartitions("anchor", "part").mapInArrow(tidy(_repeated_windows), FOUND)
    result = T.StructType([*T.StructType.fromDDL(RESULT).fields, *([rows.schema["text"], rows.schema["rest"]] if with_text else [])])
    return texts.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(tidy_pair(_cover(window, seed, with_text)), result)


def substring_dedup(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, removed) of each row; `removed` has runs of word places.

    Words lie between ASCII blanks. A word is removed if a window of `window` words around it also starts anywhere
    else, in the same row too; windows are judged on the input. Two rows with one text lose all windows. A null or empty
    text has no words and the digest of nothing; a null doc_id stays null; an empty table gives none.
    """
    return repeats(docs, window, seed, False)


def without_repeats(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """The rows of docs with repeated passages cut out of `text` (and `n_chars` set anew, if there); all rows stay.

    Blanks after a removed run go with it. Rows without removed words are not touched; rows are never joined by a key.
    """
    found = repeats(docs, window, seed, True)
    changed = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("rest.n_chars"))
    return found.select(*[changed.get(f.name, F.col("rest").getField(f.name)).cast(f.dataType).alias(f.name) for f in docs.schema])
