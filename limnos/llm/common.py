"""Shared pieces: tables, staged tables in the shared folder, byte-bounded blocks of rows, ASCII-blank words."""

from __future__ import annotations

import ctypes
import functools
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from limnos.session import shared_folder

BLOCK_BYTES = 16 << 20
BLOCK_ROWS = 8192


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_folder(spark: SparkSession, what: str) -> str:
    """A new folder in the one that driver and executors share; each application has its own there."""
    return f"{shared_folder(spark).rstrip('/')}/limnos-{spark.sparkContext.applicationId}/{what}-{uuid.uuid4().hex}"


def staged(df: DataFrame, what: str) -> DataFrame:
    """Write to the shared folder and read back, so that lost executors cost a read and several readers one pass.

    The tables of an application lie in one folder (`new_folder`), to be removed when its results are written.
    """
    path = new_folder(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def blocks(batches: Iterator[pa.RecordBatch], text: str, limit: int = BLOCK_BYTES,
           rows: int | None = None) -> Iterator[pa.RecordBatch]:
    """Cut batches so that a block holds at most `rows` rows and `limit` bytes of text (or one longer row)."""
    rows = rows or BLOCK_ROWS
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            done = size[start - 1] if start else 0
            end = max(start + 1, min(int(np.searchsorted(size, done + limit, "right")), start + rows))
            yield batch.slice(start, end - start)
            start = end


def give_back() -> None:
    """Return this process's free memory to the system, which costs a few milliseconds.

    Allocators keep what a block has used, and Spark's Python workers live on beside the next query's.
    """
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def tidy(run: Callable) -> Callable:
    """A function for mapInArrow that gives back free memory after each batch that it makes and at its end."""
    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in run(batches):
            yield batch
            del batch
            give_back()
        give_back()
    return wrapped


def tidy_group(run: Callable) -> Callable:
    """The same for a function of one group; Spark counts the arguments of what it is given."""
    def wrapped(group: pa.Table) -> pa.Table:
        try:
            return run(group)
        finally:
            give_back()
    return wrapped


def tidy_pair(run: Callable) -> Callable:
    """The same for a function of two cogroups."""
    def wrapped(left: pa.Table, right: pa.Table) -> pa.Table:
        try:
            return run(left, right)
        finally:
            give_back()
    return wrapped


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words between ASCII blanks (space, tab, LF, VT, FF, CR) of each text, flat, and the number per text; null has none."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat = lists.flatten()
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    full = pc.greater(pc.binary_length(flat), 0)
    if pc.all(full).as_py() is False:
        owner = np.repeat(np.arange(len(counts)), counts)
        counts = np.bincount(owner[full.to_numpy(zero_copy_only=False)], minlength=len(counts)).astype(np.int64)
        flat = flat.filter(full)
    return flat, counts


def offsets(counts: np.ndarray) -> np.ndarray:
    out = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=out[1:])
    return out


def coded(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Dictionary codes and the distinct values of a flat string array."""
    encoded = values.dictionary_encode()
    return encoded.indices.to_numpy(zero_copy_only=False), encoded.dictionary


def spans(lengths: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Indices starts[i], starts[i]+1, ... for lengths[i] values of each i, one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if total < 1 << 31 and starts.max(initial=0) < 1 << 31 else np.int64
    return np.arange(total, dtype=kind) + np.repeat((starts - (ends - lengths)).astype(kind), lengths)
