"""Benchmark decontamination: one Aho-Corasick automaton over word windows of the test items, one scan of each text.

Every word of the items gets a number, written in two to four characters, and a text becomes the string of its words' numbers (one
mark for all words that no item has). A place of a number has characters of its own, so patterns match whole words only, and no node of
the automaton has more than 64 edges. It knows windows only; which items hold a window is joined afterwards, once per set
of windows that some text holds.

An automaton takes up to CHUNK_WINDOWS windows (some 600 bytes each in a worker). Larger benchmarks make more scans, whose hits go
by row number; no text is written for them.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from limnos.llm.common import blocks, offsets, split_words, staged, tidy
from limnos.session import cores

WINDOW = 10
#: Windows of one automaton.
CHUNK_WINDOWS = 100_000
#: A-Z to a-z; ASCII other than letters and digits to a blank. Bytes of other characters stay.
NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SPANS = "array<struct<window:long,first:int,last:int,start:long,end:long>>"
SPAN = [("window", pa.int64()), ("first", pa.int32()), ("last", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]
SPAN_TYPE = pa.list_(pa.struct(SPAN))
#: Text that is scanned at once: bounds a worker's memory.
TEXT_BYTES = 4 << 20
#: Digits of a word's number, in bits, and the first character.
DIGIT, FIRST_CHARACTER = 6, 0x21

_automata: dict[str, tuple] = {}


def normal_words(raw: bytes) -> list[bytes]:
    return [w for w in raw.translate(NORMAL).split(b" ") if w]


def item_windows(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """(window, pattern, item_id): the windows of each item, words joined by a blank, numbered by a hash; once per item."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, patterns = [], []
            for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist()):
                words = [w.decode() for w in normal_words((text or "").encode())]
                for i in range(max(1, len(words) - size + 1) if words else 0):
                    ids.append(item or "")
                    patterns.append(" ".join(words[i:i + size]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(patterns, pa.string())], ["item_id", "pattern"])
    found = items.select(F.col("item_id").cast("string"), "text").mapInArrow(run, "item_id string, pattern string").distinct()
    return found.select(F.xxhash64("pattern").alias("window"), "pattern", "item_id")


def _characters(codes: np.ndarray, width: int) -> str:
    """Numbers of words as `width` characters each; -1 is the mark of other words."""
    shift = DIGIT * np.arange(width)[::-1]
    points = np.empty((len(codes), width), "<u2")
    for i, s in enumerate(shift.tolist()):
        points[:, i] = (codes >> s & (1 << DIGIT) - 1) + FIRST_CHARACTER + (i << DIGIT)
    points[codes < 0] = FIRST_CHARACTER + (width << DIGIT)
    return points.tobytes().decode("utf-16-le")


def _automaton(key: str, patterns: list[tuple[int, str]]) -> tuple:
    """The words of a chunk, the width of their numbers and the automaton, built once per worker process."""
    if key not in _automata:
        import ahocorasick
        split = [p.split(" ") for _, p in patterns]
        words = sorted({w for p in split for w in p})
        width = next(n for n in range(1, 9) if len(words) <= 1 << DIGIT * n)
        letters = _characters(np.arange(len(words)), width)
        number = {w: letters[width * i:width * (i + 1)] for i, w in enumerate(words)}
        made = ahocorasick.Automaton()
        for (window, _), p in zip(patterns, split):
            made.add_word("".join([number[w] for w in p]), (window, len(p)))
        made.make_automaton()
        _automata.clear()
        _automata[key] = pa.array(words, pa.string()), width, made
    return _automata[key]


def _hits(key: str, patterns: list[tuple[int, str]], texts: pa.Array) -> tuple[np.ndarray, list[list[dict]]]:
    """Number of words, and the spans of each text."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw = bytes(memoryview(texts.buffers()[2] or b"")[at[0]:at[-1]])
    at = at - at[0]
    normal = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(at), pa.py_buffer(raw.translate(NORMAL)))
    words, counts = split_words(normal)
    spans: list[list[dict]] = [[] for _ in range(len(texts))]
    if patterns and len(words):
        known, width, automaton = _automaton(key, patterns)
        codes = pc.fill_null(pc.index_in(words.cast(pa.string()), known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        letters, cuts = _characters(codes, width), offsets(counts)
        for i in np.flatnonzero(np.bincount(np.repeat(np.arange(len(counts)), counts), codes >= 0, len(counts))).tolist():
            found = list(automaton.iter(letters[width * int(cuts[i]):width * int(cuts[i + 1])]))
            if found:
                places = [m.span() for m in WORD.finditer(raw[at[i]:at[i + 1]])]
                ends = [(end // width, window, size) for end, (window, size) in found]
                spans[i] = [{"window": window, "first": end - size + 1, "last": end, "start": places[end - size + 1][0], "end": places[end][1]}
                            for end, window, size in ends]
    return counts, spans


def _covered(spans: list[dict]) -> int:
    """Number of words inside any of the spans."""
    total, reach = 0, -1
    for first, last in sorted((s["first"], s["last"]) for s in spans):
        total += max(0, last - max(first, reach + 1) + 1)
        reach = max(reach, last)
    return total


def _scan(key: str, sent, all_rows: bool):
    """Rows (row, carried columns, text): with n_words, n_hit and spans in place of the text, or only (row, spans) of those with hits."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text", TEXT_BYTES):
            counts, spans = _hits(key, sent.value, block.column("text"))
            if all_rows:
                rest = [n for n in block.schema.names if n != "text"]
                yield pa.RecordBatch.from_arrays([*[block.column(n) for n in rest], pa.array(counts, pa.int64()), pa.array([_covered(s) for s in spans], pa.int64()),
                                                  pa.array(spans, SPAN_TYPE)], [*rest, "n_words", "n_hit", "spans"])
            else:
                hit = [i for i, s in enumerate(spans) if s]
                yield pa.RecordBatch.from_arrays([block.column("row").take(pa.array(hit, pa.int64())), pa.array([spans[i] for i in hit], SPAN_TYPE)], ["row", "more"])
    return run


def _recount(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = batch.schema.get_field_index("n_hit")
        yield batch.set_column(at, "n_hit", pa.array([_covered(s) for s in batch.column("spans").to_pylist()], pa.int64()))


def scanned(rows: DataFrame, windows: DataFrame, carried: list[str]) -> DataFrame:
    """(carried, n_words, n_hit, spans) of rows with a text. The rows come from files or a checkpoint, in the same order each time."""
    spark = rows.sparkSession
    patterns = staged(windows.select("window", "pattern").distinct(), "item-windows")
    chunks = max(1, -(-patterns.count() // CHUNK_WINDOWS))
    rows = rows.select(*([F.monotonically_increasing_id().alias("row")] if chunks > 1 else []), *carried, "text")

    def sent(i: int):
        part = patterns if chunks == 1 else patterns.where(F.pmod(F.xxhash64("pattern", F.lit(1)), F.lit(chunks)) == i)
        return uuid.uuid4().hex, spark.sparkContext.broadcast([(r["window"], r["pattern"]) for r in part.collect()])  # CHUNK_WINDOWS, about

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "text")
    out = rows.mapInArrow(tidy(_scan(*sent(0), True)), f"{fields}, n_words long, n_hit long, spans {SPANS}")
    if chunks > 1:
        # all scans read the same columns, so that one plan numbers the rows
        more = [rows.mapInArrow(tidy(_scan(*sent(i), False)), f"row long, more {SPANS}") for i in range(1, chunks)]
        every = more[0]
        for part in more[1:]:
            every = every.unionByName(part)
        every = every.groupBy("row").agg(F.flatten(F.collect_list("more")).alias("more"))
        both = out.join(every, "row", "left")
        both = both.withColumn("spans", F.when(F.col("more").isNull(), F.col("spans")).otherwise(F.concat("spans", "more"))).drop("more", "row")
        out = both.mapInArrow(_recount, both.schema)
    return out


def _named(spans: Column) -> Column:
    """The windows of some spans, sorted, once each."""
    return F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["window"])))


def _found(docs: DataFrame, items: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """Scanned rows with `windows`, and (windows, items) for each different list of windows."""
    owners = staged(item_windows(items, size), "item-owners")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = staged(scanned(rows, owners, ["doc_id"]).withColumn("windows", _named(F.col("spans"))), "spans")
    sets = found.where("n_hit > 0").select("windows").distinct()
    each = sets.select("windows", F.explode("windows").alias("window"))
    listed = each.join(owners.select("window", "item_id"), "window").groupBy("windows").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    return found, listed


def _joined(found: DataFrame, listed: DataFrame, empty: dict[str, Column]) -> DataFrame:
    """Rows with what `listed` has for their windows; rows without a hit take `empty` and no part in the join.

    A list of windows that a large share of the texts hold is one key: it is divided by the row's hash, and `listed`, which has a row
    per different list, is sent to all parts.
    """
    parts = cores(found)
    salted = found.where("n_hit > 0").withColumn("part", F.pmod(F.xxhash64("doc_id", "n_words"), F.lit(parts)).cast("int"))
    every = listed.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    hit = salted.join(every, ["windows", "part"], "left").drop("part")
    clean = found.where("n_hit = 0").withColumns(empty)
    return hit.withColumns({c: F.coalesce(c, v) for c, v in empty.items()}).unionByName(clean)


def contamination(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_hit, items, spans) of each row of docs (doc_id, text); items has (item_id, text).

    A window is `size` consecutive words of an item, or all words of a shorter one. `spans` tells for each occurrence of a window
    its number, the first and last word, and the bytes of the original text that it takes; `items` are those that hold one of
    them, sorted. Null and empty texts have no words; a null item_id counts as an empty name; items that share an item_id are one; a
    null doc_id stays null; repeated rows stay; without items nothing is hit; an empty table gives none. Other columns are not read.
    """
    found, listed = _found(docs, items, size)
    out = _joined(found, listed, {"items": F.array().cast("array<string>")})
    return out.select("doc_id", "n_words", "n_hit", "items", "spans")


def contamination_digests(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated): as `contamination`, the items as number and digest.

    They are made once per list of windows, so a prompt that all items share gives no row or list per document and item.
    """
    found, listed = _found(docs, items, size)
    digests = listed.select("windows", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    out = _joined(found, digests, {"n_items": F.lit(0).cast("long"), "items_sha256": F.sha2(F.lit(""), 256)})
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", (F.col("n_hit") > 0).alias("contaminated"))


def decontaminated(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """The rows of docs, with all their columns, that hold no window of an item."""
    rows = docs.select(F.struct(*docs.columns).alias("doc"), F.col("text").cast("string").alias("text"))
    return scanned(rows, item_windows(items, size), ["doc"]).where("n_hit = 0").select("doc.*")
