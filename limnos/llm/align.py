"""Cross-tokenizer alignment of texts in lockstep.

Both token sequences of all documents of a block are merged at once: one state vector holds a pointer into A's and into B's
tokens for every document, and each step advances the one whose token ends first, or both where they end together. Such a
common end is a cut: it closes a group, whose A and B tokens are linked. Documents at their end drop out of the vector.

How many documents hold an id pair linked is summed over blocks, each block giving a row per distinct pair; the counts come
back to the block in the same way, so no row per document and pair is shuffled.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from limnos.llm.common import blocks, coded, offsets, spans, staged
from limnos.llm.tokens import tokenizer_path

BLOCK_TEXT = 2 << 20
#: Words that are encoded as one text, in bytes, and tokens of a document that one row of the state vector merges.
TEXT_BYTES = 1 << 16
STRETCH = 1024
#: Longer words are encoded by themselves, by the library of A's file.
LONG_WORD = 1000
BLANK = 0x20
#: Bytes that may begin a white-space character of any kind: no cut before a blank that one of them follows.
MAY_BE_BLANK = [*range(0x09, 0x0E), *range(0x1C, 0x21), 0xC2, 0xE1, 0xE2, 0xE3]
NO_CUT = np.isin(np.arange(256), MAY_BE_BLANK)

NUMBERS = ["n_a", "n_b", "n_groups", "n_links"]
DOC = "struct<doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string>"
STAGE = f"block long, docs array<{DOC}>, pairs array<struct<a int, b int, n long>>, data binary"
DOC_TYPE = pa.list_(pa.struct([("doc_id", pa.int64()), *[(n, pa.int64()) for n in NUMBERS], ("groups_sha256", pa.string())]))
PAIR_TYPE = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("n", pa.int64())]))
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _byte_letters() -> dict[str, int]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Pair:
    """Two tokenizers and the bytes of their tokens.

    A word is what stands between two safe cuts of blank+text: before a blank that follows no blank and that no white space
    follows. Neither model has a token that reaches over such a place, and both split the text alike on either side.
    """

    def __init__(self, path_a: str, path_b: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        with open(path_a, encoding="utf-8") as f:
            file = json.load(f)
        vocabulary = file["model"]["vocab"]
        letters = _byte_letters()
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for piece, i in vocabulary.items():
            self.bytes_a[i] = bytes(letters[c] for c in piece)
        self.bytes_b = [self._piece(i) for i in range(self.b.get_piece_size())]
        if max(len(self.bytes_a), len(self.bytes_b)) > 1 << 16:
            raise ValueError("ids of up to 16 bits only")
        self.ranks = _rank_encoder(file, self.bytes_a)
        self.len_a, self.len_b = (np.array([len(x) for x in many], np.int64) for many in (self.bytes_a, self.bytes_b))

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        if self.b.is_byte(i):
            return bytes([int(piece[3:5], 16)])
        if "▁" in piece.lstrip("▁") or "\n" in piece or " " in piece:
            raise ValueError("the model has pieces that reach over a blank or a line end; texts cannot be cut there")
        return piece.replace("▁", " ").encode()

    def _same(self, a: list[int], b: list[int], raw: bytes) -> bool:
        return b"".join([self.bytes_a[i] for i in a]) == raw and b"".join([self.bytes_b[i] for i in b]) == raw

    def tokens(self, words: pa.Array) -> Tokens:
        """Tokens of the distinct words, each encoded once: many words that may stand one after the other go in as one text.

        The ids of such a text are cut again where the bytes of its words end.
        """
        codes, names = coded(words)
        n = len(names)
        counts, starts = np.zeros((2, n), np.int64), np.zeros((2, n), np.int64)
        same, pools, filled = np.zeros(n, bool), ([], []), [0, 0]

        def put(which: np.ndarray, a: list[int], b: list[int], number: list[np.ndarray]) -> None:
            for side, ids in enumerate((a, b)):
                counts[side, which] = number[side]
                starts[side, which] = filled[side] + np.cumsum(number[side]) - number[side]
                pools[side].append(np.array(ids, "<u2"))
                filled[side] += len(ids)
            same[which] = True

        at, data = _buffers(names)
        marked = pc.match_substring(names, "▁").to_numpy(zero_copy_only=False)  # B gives a blank for it
        size = np.diff(at)
        may = ~marked & (size >= 2) & (size <= LONG_WORD) & (data[at[1:] - 1] != BLANK) & ~NO_CUT[data[np.minimum(at[:-1] + 1, len(data) - 1)]] if n else marked
        alone = list(np.flatnonzero(~marked & ~may))
        free = np.flatnonzero(may)
        ends = np.cumsum(size[free])
        joined = bytes(data[spans(size[free], at[free])])
        cut = np.flatnonzero(np.r_[True, np.diff(np.r_[0, ends[:-1]] // TEXT_BYTES) > 0, True]) if len(free) else []
        for i, j in zip(cut, cut[1:]):
            begin = int(ends[i - 1]) if i else 0
            raw = joined[begin:int(ends[j - 1])]
            text = raw.decode()
            a, b = self._ids(text), self.b.encode(text[1:])
            number = [_tokens_by_word(length[np.array(ids, np.int64)], ends[i:j] - begin) for ids, length in ((a, self.len_a), (b, self.len_b))]
            if all(x is not None for x in number) and self._same(a, b, raw):
                put(free[i:j], a, b, number)
            else:
                alone += list(free[i:j])
        for k in alone:
            raw = bytes(data[at[k]:at[k + 1]])
            text = raw.decode()
            a, b = self.a.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.b.encode(text[1:])
            if self._same(a, b, raw):
                put(np.array([k]), a, b, [np.array([len(a)]), np.array([len(b)])])
        return Tokens(codes, [np.concatenate([*p, np.empty(0, "<u2")]) for p in pools], starts, counts, same)

    def _ids(self, text: str) -> list[int]:
        return self.ranks.encode_ordinary(text) if self.ranks else self.a.encode_batch_fast([text], add_special_tokens=False)[0].ids


def _rank_encoder(file: dict, bytes_by_id: list[bytes]):
    """A rank encoder of the same vocabulary, some four times as fast, if the file says no more than ranks do.

    That is a byte-level model without normalizer whose merges are its ids in their order.
    """
    model, split = file["model"], file["pre_tokenizer"] or {}
    pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    ids = [model["vocab"].get("".join(m)) for m in pairs]
    plain = split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space") and not file["normalizer"]
    if not plain or ids != list(range(256, 256 + len(ids))) or any(model.get(k) for k in ("dropout", "ignore_merges", "byte_fallback")):
        return None
    import public_tokenizers
    import tiktoken
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks={b: i for i, b in enumerate(bytes_by_id[:256 + len(ids)])}, special_tokens={})


class Tokens(NamedTuple):
    """Codes of words; by code and side (A, B): ids in a pool, from where and how many; and if both sides give the word's bytes."""
    codes: np.ndarray
    pools: list[np.ndarray]
    starts: np.ndarray
    counts: np.ndarray
    same: np.ndarray


def _tokens_by_word(lengths: np.ndarray, ends: np.ndarray) -> np.ndarray | None:
    """Number of tokens of each word, if tokens end where words do."""
    token_ends = np.cumsum(lengths)
    last = np.searchsorted(token_ends, ends)
    if not len(token_ends) or last[-1] != len(token_ends) - 1 or (token_ends[last] != ends).any():
        return None
    return np.diff(np.r_[-1, last])


def _buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a large_string array."""
    if not len(texts):
        return np.zeros(1, np.int64), np.empty(0, np.uint8)
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    return at - at[0], np.frombuffer(texts.buffers()[2], np.uint8)[at[0]:at[-1]]


@functools.lru_cache(maxsize=2)
def pair_of(path_a: str, path_b: str) -> Pair:
    """One per worker process and files."""
    return Pair(path_a, path_b)


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of blank+text at the safe cuts, flat, and the number per text; null and empty texts have none."""
    full = pc.greater(pc.binary_length(pc.fill_null(texts, "")), 0)
    owner = np.flatnonzero(full.to_numpy(zero_copy_only=False))
    kind = pa.large_string()
    joined = pc.binary_join_element_wise(pa.scalar(" ", kind), texts.filter(full).cast(kind), pa.scalar("", kind))
    if not len(joined):
        return pa.array([], kind), np.zeros(len(texts), np.int64)
    at, data = _buffers(joined)
    blank = data == BLANK
    cut = blank.copy()
    cut[1:] &= ~blank[:-1]
    cut[:-1] &= ~NO_CUT[data[1:]]
    cut[at[1:] - 1] = False
    cut[at[:-1]] = True
    places = np.flatnonzero(cut)
    words = pa.LargeStringArray.from_buffers(len(places), pa.py_buffer(np.r_[places, len(data)].astype(np.int64)), pa.py_buffer(data))
    counts = np.zeros(len(texts), np.int64)
    counts[owner] = np.diff(np.searchsorted(places, at))
    return words, counts


class Groups(NamedTuple):
    """Bounds of the groups of all documents, in order: tokens a0..a1 of A's and b0..b1 of B's flat ids."""
    a0: np.ndarray
    a1: np.ndarray
    b0: np.ndarray
    b1: np.ndarray


def lockstep(ends_a: np.ndarray, ends_b: np.ndarray, first_a: np.ndarray, first_b: np.ndarray) -> Groups:
    """Merge the tokens of all stretches at once; first_a and first_b are where each stretch begins, and the ends of all.

    `ends` are the byte offsets where tokens end, rising over all stretches; a stretch ends at a common one.
    """
    i, j, stop = first_a[:-1].copy(), first_b[:-1].copy(), first_a[1:]
    some = i < stop
    i, j, stop = i[some], j[some], stop[some]
    head_a, head_b = i.copy(), j.copy()
    out: list[tuple[np.ndarray, ...]] = []
    while len(i):
        end_a, end_b = ends_a[i], ends_b[j]
        cut = end_a == end_b
        i = i + (end_a <= end_b)
        j = j + (end_b <= end_a)
        at = np.flatnonzero(cut)
        if len(at):
            out.append((head_a[at], i[at], head_b[at], j[at]))
            head_a[at], head_b[at] = i[at], j[at]
            done = i == stop
            if done.any():  # compact the vector
                left = ~done
                i, j, stop, head_a, head_b = i[left], j[left], stop[left], head_a[left], head_b[left]
    if not out:
        return Groups(*[np.empty(0, np.int64)] * 4)
    a0, a1, b0, b1 = (np.concatenate(x) for x in zip(*out))
    place = np.full(len(ends_a), -1, np.int64)
    place[a0] = np.arange(len(a0))
    order = place[place >= 0]
    return Groups(a0[order], a1[order], b0[order], b1[order])


def _distinct(ids: np.ndarray, group: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, id, times): tokens of the groups marked in `some` once per id, the others' tokens as they are; by group."""
    mine = some[group]
    key, times = np.unique(group[mine] << 16 | ids[mine], return_counts=True)
    group, ids = np.r_[group[~mine], key >> 16], np.r_[ids[~mine], key & 0xFFFF]
    times = np.r_[np.ones(len(group) - len(times), np.int64), times]
    order = np.argsort(group, kind="stable")
    return group[order], ids[order], times[order]


def links(ids_a: np.ndarray, ids_b: np.ndarray, groups: Groups, doc_of_group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, number of links), sorted by key = doc << 32 | a << 16 | b: all pairs of A and B tokens that share a group.

    Where a group has several tokens on both sides, equal ids are taken together before they are paired.
    """
    size_a, size_b = groups.a1 - groups.a0, groups.b1 - groups.b0
    number = np.arange(len(size_a))
    many = (size_a > 1) & (size_b > 1)
    group_a, a, times_a = _distinct(ids_a.astype(np.int64), np.repeat(number, size_a), many)
    group_b, b, times_b = _distinct(ids_b.astype(np.int64), np.repeat(number, size_b), many)
    first = np.searchsorted(group_b, number)
    each = np.diff(np.r_[first, len(group_b)])
    to = spans(each[group_a], first[group_a])
    key = (doc_of_group[group_a] << 32 | a << 16).repeat(each[group_a]) | b[to]
    times = times_a.repeat(each[group_a]) * times_b[to]
    order = np.argsort(key, kind="stable")
    key, times = key[order], times[order]
    new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
    return key[new], np.add.reduceat(times, new) if len(new) else times


def group_texts(ids_a: np.ndarray, ids_b: np.ndarray, groups: Groups) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of `a1,a2|b1;a3|b2,b3;` over all groups, and where each group ends in them."""
    size_a, size_b = groups.a1 - groups.a0, groups.b1 - groups.b0
    total = len(ids_a) + len(ids_b)
    ids, mark = np.empty(total, np.int32), np.full(total, ord(","), np.uint8)
    ids[np.arange(len(ids_a)) + np.repeat(groups.b0, size_a)] = ids_a
    ids[np.arange(len(ids_b)) + np.repeat(groups.a1, size_b)] = ids_b
    mark[groups.a1 + groups.b0 - 1] = ord("|")
    mark[groups.a1 + groups.b1 - 1] = ord(";")
    parts = _numerals().take(pa.array(ids))
    at, data = _buffers(parts)
    out = data.copy()
    out[at[1:] - 1] = mark
    return out, at[groups.a1 + groups.b1]


@functools.lru_cache(maxsize=1)
def _numerals() -> pa.Array:
    """Decimal text of each 16-bit id with one byte more for the mark."""
    return pa.array([f"{i}," for i in range(1 << 16)], pa.large_string())


class Aligned(NamedTuple):
    """Tokens and groups of a block's documents, and how many of each they have."""
    ids_a: np.ndarray
    ids_b: np.ndarray
    groups: Groups
    doc_of_group: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray


def aligned(texts: pa.Array, pair: Pair) -> Aligned:
    words, counts = words_of(texts)
    made = pair.tokens(words)
    owner = np.repeat(np.arange(len(texts)), counts)
    bad = np.bincount(owner, ~made.same[made.codes], len(texts)) > 0
    good = ~bad[owner]
    codes, owner = made.codes[good], owner[good]
    each = [count[codes] for count in made.counts]
    ids = [pool[spans(n, start[codes])] for pool, start, n in zip(made.pools, made.starts, each)]
    ends = [np.cumsum(length[x]) for length, x in zip((pair.len_a, pair.len_b), ids)]
    at = [offsets(x) for x in each]
    # a stretch begins with a document, and at the words where so many tokens more have gone by
    passed = (at[0][:-1] + at[1][:-1]) // STRETCH
    first = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (passed[1:] != passed[:-1])]) if len(owner) else np.empty(0, np.int64)
    first = np.r_[first, len(owner)]
    groups = lockstep(ends[0], ends[1], at[0][first], at[1][first])
    token_doc = np.repeat(owner, each[0])
    n_a, n_b = (np.bincount(owner, e, len(texts)).astype(np.int64) for e in each)
    return Aligned(ids[0], ids[1], groups, token_doc[groups.a0], n_a, n_b)


def _blocks(path_a: str, path_b: str):
    """A row per block: its documents, its distinct pairs and how many of them hold each, and their links, packed."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        base, squeeze = TaskContext.get().partitionId() << 32, zstandard.ZstdCompressor(3).compress
        pair = pair_of(path_a, path_b)
        for number, block in enumerate(blocks(batches, "text", BLOCK_TEXT)):
            n = block.num_rows
            a = aligned(block.column("text"), pair)
            n_groups = np.bincount(a.doc_of_group, minlength=n)
            sizes = (a.groups.a1 - a.groups.a0) * (a.groups.b1 - a.groups.b0)
            group_at = offsets(n_groups)
            n_links = np.diff(offsets(sizes)[group_at])
            text, ends = group_texts(a.ids_a, a.ids_b, a.groups)
            text_at = np.r_[0, ends][group_at]
            view = memoryview(text)
            digest = [hashlib.sha256(view[p:q - 1]).hexdigest() if p < q else "" for p, q in zip(text_at.tolist(), text_at[1:].tolist())]
            key, times = links(a.ids_a, a.ids_b, a.groups, a.doc_of_group)
            pairs, which, holders = np.unique(key & 0xFFFFFFFF, return_inverse=True, return_counts=True)
            per_doc = np.bincount(key >> 32, minlength=n)
            data = squeeze(b"".join((np.array([n, len(key)], "<u8").tobytes(), per_doc.astype("<u4").tobytes(),
                                     which.astype("<u4").tobytes(), times.astype("<u8").tobytes())))
            docs = pa.StructArray.from_arrays([block.column("doc_id"), *[pa.array(x, pa.int64()) for x in (a.n_a, a.n_b, n_groups, n_links)],
                                               pa.array(digest, pa.string())], fields=list(DOC_TYPE.value_type))
            found = pa.StructArray.from_arrays([pa.array(pairs >> 16, pa.int32()), pa.array(pairs & 0xFFFF, pa.int32()), pa.array(holders, pa.int64())],
                                               fields=list(PAIR_TYPE.value_type))
            whole = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
            yield pa.RecordBatch.from_arrays([pa.array([base + number]), whole(docs), whole(found), pa.array([data], pa.binary())],
                                             ["block", "docs", "pairs", "data"])

    return run


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _paths(a: str | None, b: str | None) -> tuple[str, str]:
    return a or tokenizer_path("byte_bpe_50k.json"), b or tokenizer_path("piece_bpe_32k.model")


def token_groups(docs: DataFrame, a: str | None = None, b: str | None = None) -> DataFrame:
    """(doc_id, groups): the groups of each row's text in order, each with its A ids and its B ids; see `alignment`."""
    path_a, path_b = _paths(a, b)
    group = pa.list_(pa.struct([("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = pair_of(path_a, path_b)
        for block in blocks(batches, "text", BLOCK_TEXT):
            found = aligned(block.column("text"), pair)
            g = found.groups
            side = lambda ids, ends: pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), pa.array(ids, pa.int32()))
            flat = pa.StructArray.from_arrays([side(found.ids_a, g.a1), side(found.ids_b, g.b1)], fields=list(group.value_type))
            at = offsets(np.bincount(found.doc_of_group, minlength=block.num_rows))
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.ListArray.from_arrays(pa.array(at, pa.int32()), flat)], ["doc_id", "groups"])

    return _texts(docs).mapInArrow(run, "doc_id long, groups array<struct<a array<int>, b array<int>>>")


def _pair_counts(made: DataFrame) -> DataFrame:
    """(a, b, count, best) from blocks; an A id has at most as many rows as B has ids."""
    counts = made.select(F.explode("pairs").alias("p")).groupBy("p.a", "p.b").agg(F.sum("p.n").alias("count"))
    return counts.withColumn("best", F.col("count") == F.max("count").over(Window.partitionBy("a")))


def _valued(left: pa.Table, right: pa.Table) -> pa.Table:
    """Sums over the links of one block's documents, with the counts of its pairs."""
    if not len(left):
        return pa.table({f.name: pa.array([], f.type) for f in RESULT_SCHEMA}, RESULT_SCHEMA)
    raw = zstandard.ZstdDecompressor().decompress(left["data"][0].as_py())
    n, m = np.frombuffer(raw, "<u8", 2).tolist()
    per_doc = np.frombuffer(raw, "<u4", n, 16)
    which = np.frombuffer(raw, "<u4", m, 16 + 4 * n)
    times = np.frombuffer(raw, "<u8", m, 16 + 4 * n + 4 * m).astype(np.int64)
    order = np.argsort(right["a"].to_numpy().astype(np.int64) << 16 | right["b"].to_numpy())
    count, best = right["count"].to_numpy()[order], right["best"].to_numpy()[order]
    at = offsets(per_doc)
    total = lambda x: pa.array(np.diff(offsets(x)[at]), pa.int64())
    docs = left["docs"].combine_chunks().flatten()
    columns = {f.name: docs.field(i) for i, f in enumerate(docs.type)}
    columns |= {"n_best": total(times * best[which]), "count_sum": total(times * count[which])}
    return pa.table([columns[f.name] for f in RESULT_SCHEMA], RESULT_SCHEMA)


RESULT_SCHEMA = pa.schema([(n, pa.string() if n == "groups_sha256" else pa.int64()) for n in (c.split()[0] for c in RESULT.split(", "))])


def alignment(docs: DataFrame, a: str | None = None, b: str | None = None) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each row; a and b are tokenizer files.

    A is a byte-level model and encodes blank+text, B a model with byte pieces that puts a blank in front itself; special strings
    are plain text. A group lies between two byte offsets where tokens of both end; links are all pairs of an A and a
    B token of one group. A pair of ids counts the rows that hold it linked. `n_best` are the links whose count is the highest
    of their A id, ties included; `count_sum` adds up the counts over the links.

    A null or empty text, or one that the tokens of A or B do not give back byte by byte, has no tokens: zeros and an empty
    digest. A null doc_id stays null; repeated rows count each; an empty table gives none; doc_id and text are read.
    """
    made = staged(_texts(docs).mapInArrow(_blocks(*_paths(a, b)), STAGE), "aligned")
    counts = staged(_pair_counts(made), "pair-counts")
    mine = made.select(F.col("block").alias("of_block"), F.explode("pairs").alias("p")).select("of_block", "p.a", "p.b")
    valued = mine.join(counts, ["a", "b"]).select("of_block", "a", "b", "count", "best")
    return made.select("block", "docs", "data").groupBy("block").cogroup(valued.groupBy("of_block")).applyInArrow(_valued, RESULT)
