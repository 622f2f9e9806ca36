"""Best-fit-decreasing packing of token pieces into sequences.

Which piece of a length goes to which sequence does not matter, so the packing is decided on the number of pieces of
each length: at most `size` numbers, whatever the corpus. It gives intervals (length, ranks, sequences, place); each
piece then finds its interval by its rank among the pieces of its length, in a join.
"""

from __future__ import annotations

import zlib
from collections import defaultdict, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from limnos.llm.common import blocks, offsets, staged, tidy
from limnos.llm.tokens import END_ID, encoder, tokenizer_path

SIZE = 4096
#: Ranks of one length that meet in one group of the last join.
SPAN = 1 << 15
#: Text that is encoded at once: bounds a worker's memory.
TEXT_BYTES = 2 << 20
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long"


class CapacityTree:
    """Segment tree over remaining capacities 0..size: which of them some open sequence has."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.any = bytearray(2 * self.leaves)

    def set(self, capacity: int, there: bool) -> None:
        node = self.leaves + capacity
        self.any[node] = there
        while node > 1:
            node >>= 1
            self.any[node] = self.any[2 * node] | self.any[2 * node + 1]

    def tightest(self, need: int) -> int | None:
        """Least capacity of at least `need`, in logarithmic time."""
        node = self.leaves + need
        if self.any[node]:
            return need
        while node > 1:
            if node % 2 == 0 and self.any[node + 1]:
                node += 1
                while node < self.leaves:
                    node = 2 * node if self.any[2 * node] else 2 * node + 1
                return node - self.leaves
            node >>= 1
        return None


def best_fit(counts: dict[int, int], size: int = SIZE) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over `counts` (length: number of pieces).

    Returns (length, first rank, number, first sequence, place): pieces first rank, first rank + 1, ... of that length
    lie at `place` in the sequences first sequence, first sequence + 1, ... Sequences are numbered from 0. Equal to
    packing the pieces one by one, longest first, each into the fullest sequence that still has room: pieces of one
    length go to sequences of one capacity together.
    """
    tree, open_, out, sequences = CapacityTree(size), defaultdict(deque), [], 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            room = tree.tightest(length)
            if room is None:  # open as many new ones as the rest fills
                room, first, number = size, sequences, -(-left // (size // length))
                sequences += number
            else:
                first, number = open_[room].popleft()
                if not open_[room]:
                    tree.set(room, False)
            each = room // length  # a sequence that has taken one is the tightest for the next
            full, rest = min(number, left // each), 0
            if full < number:
                rest = left - full * each
            for taken, begin, n in ((each, first, full), (rest, first + full, 1)):
                if taken and n:
                    out += [(length, rank + i * n, n, begin, size - room + i * length) for i in range(taken)]
                    rank, left = rank + taken * n, left - taken * n
                    _open(tree, open_, room - taken * length, begin, n)
            used = full + (rest > 0)
            if used < number:
                _open(tree, open_, room, first + used, number - used, True)
    return out


def _open(tree: CapacityTree, open_: dict, room: int, first: int, number: int, front: bool = False) -> None:
    if room:
        if not open_[room]:
            tree.set(room, True)
        (open_[room].appendleft if front else open_[room].append)((first, number))


def pieces(docs: DataFrame, size: int = SIZE, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, task, nth): the ids of each row with the end id, cut at `size`.

    `nth` counts the pieces of one length that a task has made, so that ranks need no sort of all pieces.
    """
    tokenizer = tokenizer or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        enc, task, made = encoder(tokenizer), TaskContext.get().partitionId(), np.zeros(size + 1, np.int64)
        for block in blocks(batches, "text", TEXT_BYTES):
            ids, counts = enc.block(block.column("text"))
            ids = np.insert(ids.astype("<u4"), np.cumsum(counts), END_ID)
            at = offsets(counts + 1)
            number = -(-(counts + 1) // size)
            row = np.repeat(np.arange(len(counts)), number)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(number) - number, number)
            start = piece * size
            length = np.minimum(counts[row] + 1 - start, size)
            begin = (at[row] + start).tolist()
            crc = [zlib.crc32(ids[a:a + n]) for a, n in zip(begin, length.tolist())]
            order = np.argsort(length, kind="stable")
            ordered = length[order]
            first = np.searchsorted(ordered, ordered, "left")
            nth = np.empty(len(row), np.int64)
            nth[order] = np.arange(len(row)) - first + made[ordered]
            made += np.bincount(length, minlength=size + 1)
            yield pa.RecordBatch.from_arrays([
                block.column("doc_id").take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length),
                pa.array(crc, pa.int64()), pa.array(np.full(len(row), task), pa.int32()), pa.array(nth)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(run), PIECES)


def pack(made: DataFrame, size: int = SIZE) -> DataFrame:
    """Add sequence_id and offset to pieces with columns length, task, nth (see `pieces`)."""
    spark = made.sparkSession
    by_task = made.groupBy("length", "task").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    ranks = by_task.select("length", "task", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    # at most `size` rows come to the driver
    counts = {r["length"]: r["n"] for r in made.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = best_fit(counts, size)
    # as an Arrow table: a list would go through Python workers of another kind, which stay beside those of the operators
    columns = np.array(plan, np.int64).reshape(-1, 5).T
    intervals = (spark.createDataFrame(pa.table([pa.array(c) for c in columns], ["length", "__rank", "__number", "__sequence", "offset"]))
                 .withColumn("__span", F.explode(F.sequence(F.floor(F.col("__rank") / SPAN), F.floor((F.col("__rank") + F.col("__number") - 1) / SPAN)))))
    ranked = (made.join(ranks, ["length", "task"]).withColumn("__at", F.col("__before") + F.col("nth"))
              .withColumn("__span", F.floor(F.col("__at") / SPAN)))
    mine = (F.col("__at") >= F.col("__rank")) & (F.col("__at") < F.col("__rank") + F.col("__number"))
    keep = [c for c in made.columns if c not in ("task", "nth")]
    return (ranked.join(intervals, ["length", "__span"]).where(mine)
            .select(*keep, (F.col("__sequence") + F.col("__at") - F.col("__rank")).alias("sequence_id"), "offset"))


def pack_documents(docs: DataFrame, size: int = SIZE, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of all rows; doc_id and text are read.

    A null text is empty and makes a piece of the end id alone; a null doc_id stays null; repeated rows are packed each;
    pieces of one length take their places in no particular order; an empty table gives no sequence.
    """
    made = staged(pieces(docs, size, tokenizer), "pieces")
    return pack(made, size)
