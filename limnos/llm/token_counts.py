"""Token counts: pieces counted once per distinct pre-token, joined to per-document pre-token frequencies."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limnos.llm.common import blocks, coded, offsets
from limnos.llm.tokens import tokenizer_path

BLOCK_TEXT = 12 << 20
#: Pre-tokens of a bucket and sums of documents that a task holds at once.
KNOWN_WORDS = 1_000_000
HELD_SUMS = 4_000_000
STAGE = "block long, bucket int, row int, data binary, doc_id long, n_bytes long"
SUMS = "block long, row int, data binary, doc_id long, n_bytes long"
STAGE_NAMES = [c.split()[0] for c in STAGE.split(", ")]
SUMS_NAMES = [c.split()[0] for c in SUMS.split(", ")]


@functools.lru_cache(maxsize=2)
def _pieces(path: str):
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if "▁" in piece.lstrip("▁") or "\n" in piece:
            raise ValueError("the model has pieces that reach over a blank or a line end; texts cannot be cut there")
    return model


def pre_tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Pre-tokens of texts, flat, and the text of each.

    A text is cut before each run of blanks and before each line end: no piece of the model reaches over either.
    The first blank of a pre-token is left out, as the model puts one in front of what it encodes. A pre-token with a
    line end has no blank of its own; a run of blanks that nothing follows is written with a line end, too.
    """
    texts = pc.replace_substring(pc.fill_null(texts, ""), "▁", " ")
    lists = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
    words = lists.flatten()
    owner = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
    size = pc.binary_length(words).to_numpy(zero_copy_only=False)
    if (size == 0).any():
        words, owner = _with_runs(words, owner, size)
    return words, owner


def _with_runs(words: pa.Array, owner: np.ndarray, size: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Give the blanks between words (empty strings) to the word after them, or to a pre-token of their own."""
    empty = size == 0
    new_text = np.r_[True, owner[1:] != owner[:-1]]
    last = np.r_[owner[1:] != owner[:-1], True]
    starts = empty & (new_text | np.r_[True, ~empty[:-1]])
    first = np.flatnonzero(starts)
    ends = empty & (last | np.r_[~empty[1:], True])
    stop = np.flatnonzero(ends)
    alone = (new_text & last & empty)[first]  # an empty text
    run = stop - first + 1
    after = np.where(last[stop], -1, np.minimum(stop + 1, len(size) - 1))
    lead = pc.starts_with(words, "\n").to_numpy(zero_copy_only=False)
    own = (after < 0) | lead[after]
    values = {}
    for at, k, to, separate, void in zip(first.tolist(), run.tolist(), after.tolist(), own.tolist(), alone.tolist()):
        if void:
            continue
        if separate:
            values[at] = " " * (k - 1) + "\n"
        else:
            values[to] = " " * k + words[to].as_py()
    keep = ~empty
    keep[[at for at in values if empty[at]]] = True
    changed = np.zeros(len(size), bool)
    order = sorted(values)
    changed[order] = True
    words = pc.replace_with_mask(words, pa.array(changed), pa.array([values[at] for at in order], words.type))
    return words.filter(pa.array(keep)), owner[keep]


def _frequencies(buckets: int):
    """Per block, its documents, and its pre-tokens by bucket: words, rows that hold each one, and how often.

    A word goes to the bucket of its hash; a word that an eighth of a block's rows hold goes to the bucket of the
    block's number, as all blocks have it.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        base, squeeze = TaskContext.get().partitionId() << 32, zstandard.ZstdCompressor(1).compress
        for number, block in enumerate(blocks(batches, "text", BLOCK_TEXT, 1 << 16)):
            text, n, name = block.column("text"), block.num_rows, base + number
            words, owner = pre_tokens(text)
            codes, names = coded(words)
            pairs, times = np.unique(codes.astype(np.int64) * n + owner, return_counts=True)
            bucket = np.fromiter((xxhash.xxh3_64_intdigest(w) % buckets for w in names.to_pylist()), np.int64, len(names))
            holders = np.bincount(pairs // n, minlength=len(names))
            bucket[holders > max(8, n // 8)] = xxhash.xxh3_64_intdigest(str(name)) % buckets
            order = np.argsort(bucket, kind="stable")
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            place = np.argsort(rank[pairs // n], kind="stable")
            rows, times = (pairs[place] % n).astype("<u2"), times[place].astype("<u4")
            names, holders, bucket = names.take(pa.array(order)), holders[order].astype("<u4"), bucket[order]
            lengths = pc.binary_length(names).to_numpy().astype("<u4")
            letters, at = b"".join(w.encode() for w in names.to_pylist()), offsets(lengths)
            cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True]) if len(bucket) else np.zeros(1, int)
            pair_at, data = offsets(holders), []
            for a, b in zip(cuts.tolist(), cuts[1:].tolist()):
                i, j = pair_at[a], pair_at[b]
                data.append(squeeze(b"".join((
                    np.array([b - a, j - i, n], "<u4").tobytes(), lengths[a:b].tobytes(), holders[a:b].tobytes(),
                    times[i:j].tobytes(), rows[i:j].tobytes(), letters[at[a]:at[b]]))))
            k = len(data)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(k + n, name)), pa.array(np.r_[bucket[cuts[:-1]], np.arange(n) % buckets], pa.int32()),
                pa.array(np.r_[np.full(k, -1), np.arange(n)], pa.int32()), pa.array(data + [None] * n, pa.binary()),
                pa.concat_arrays([pa.nulls(k, pa.int64()), block.column("doc_id").cast(pa.int64())]),
                pa.concat_arrays([pa.nulls(k, pa.int64()), pc.fill_null(pc.binary_length(text), 0).cast(pa.int64())])],
                STAGE_NAMES)
    return run


def _unpacked(data: bytes) -> tuple[pa.Array, int, np.ndarray, np.ndarray, np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(data)
    v, p, n = np.frombuffer(data, "<u4", 3).tolist()
    lengths, holders = np.frombuffer(data, "<u4", v, 12), np.frombuffer(data, "<u4", v, 12 + 4 * v)
    times, rows = np.frombuffer(data, "<u4", p, 12 + 8 * v), np.frombuffer(data, "<u2", p, 12 + 8 * v + 4 * p)
    ends = pa.py_buffer(offsets(lengths).astype("<i4"))
    letters = pa.py_buffer(data[12 + 8 * v + 6 * p:])
    return pa.Array.from_buffers(pa.string(), v, [None, ends, letters]), n, holders, times, rows


def _count_pieces(path: str):
    """Rows sorted by bucket: encode each distinct pre-token once, multiply by its frequencies, sum per document.

    Sums are held per block until they are many and then sent on, so a task's memory is bounded. Rows of documents pass.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known, last = _pieces(path), {}, -1
        sums: dict[int, np.ndarray] = {}

        def sent() -> pa.RecordBatch:
            k = len(sums)
            batch = pa.RecordBatch.from_arrays([
                pa.array(list(sums), pa.int64()), pa.nulls(k, pa.int32()).fill_null(-1),
                pa.array([zstandard.compress(s.astype("<u4").tobytes(), 1) for s in sums.values()], pa.binary()),
                pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64())], SUMS_NAMES)
            sums.clear()
            return batch

        for batch in batches:
            docs = pc.greater_equal(batch.column("row"), 0)
            yield batch.filter(docs).select(SUMS_NAMES)
            rest = batch.filter(pc.invert(docs))
            for block, bucket, data in zip(*(rest.column(c).to_pylist() for c in ("block", "bucket", "data"))):
                if bucket != last or len(known) > KNOWN_WORDS:
                    known, last = {}, bucket
                names, n, holders, times, rows = _unpacked(data)
                words = names.to_pylist()
                new = [w for w in words if w not in known]
                known.update((w, len(ids) - ("\n" in w)) for w, ids in zip(new, model.encode(new, num_threads=1)))
                pieces = np.fromiter((known[w] for w in words), np.int64, len(words))
                if block not in sums:
                    if sums and (len(sums) + 1) * n > HELD_SUMS:
                        yield sent()
                    sums[block] = np.zeros(n, np.int64)
                sums[block] += np.bincount(rows, np.repeat(pieces, holders) * times, n).astype(np.int64)
        yield sent()
    return run


def _sum(found: pa.Table) -> pa.Table:
    """One block: the sums of its documents."""
    docs = found.filter(pc.greater_equal(found["row"], 0))
    total = np.zeros(docs.num_rows, np.int64)
    for data in pc.drop_null(found["data"]).to_pylist():
        total += np.frombuffer(zstandard.decompress(data), "<u4")
    return pa.table({"doc_id": docs["doc_id"], "n_bytes": docs["n_bytes"], "n_tokens": pa.array(total[docs["row"].to_numpy()])})


def token_counts(docs: DataFrame, model: str | None = None, limit: int = 4096) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of each row's whole text; only doc_id and text are read.

    Blocks of rows hold the frequencies; they meet the counts bucket by bucket of the pre-tokens. Docs should come from
    files or a checkpoint, so that a task that is run again makes the same blocks. A null text is empty and has 0 tokens; a
    null doc_id stays null; rows are never merged, so repeated rows give repeated results; an empty table gives none.
    """
    model = model or tokenizer_path("piece_bpe_32k.model")
    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_frequencies(buckets), STAGE)
            .repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_count_pieces(model), SUMS)
            .groupBy("block").applyInArrow(_sum, "doc_id long, n_bytes long, n_tokens long")
            .withColumn("over_limit", F.col("n_tokens") > limit))
