"""Secret scan: fixed patterns, and high-entropy stretches of candidate strings.

A candidate is a maximal run of one character class. A window slides over it; the counts of its characters are kept up
to date by one character in and one out, for all candidates of a block at once, and with them the window's Shannon entropy.
Windows at or over the class's limit that hold letters and digits make spans, unless the candidate or what stands
before it is on the allow-list, or a span found earlier holds them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from limnos.llm.common import blocks, spans

DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
KEYWORDS = "(?i)password|passwd|secret|token|api_?key"
ASSIGN_LEAST, ACCESS, ACCESS_LEAST, HEX_LEAST = 12, b"AKIA", 18, 16
BASE = ["assign", "access", "hex"]


class CharClass(NamedTuple):
    letters: str
    window: int
    bits: float


#: Kinds that the method adds: characters, window, least entropy of a window in bits a character.
CLASSES = {
    "entropy_hex": CharClass(DIGITS + "abcdefABCDEF", 24, 3.0),
    "entropy_alnum": CharClass(DIGITS + LOWER + UPPER, 24, 3.8),
    "entropy_base64": CharClass(DIGITS + LOWER + UPPER + "+/_-", 24, 4.0),
}
#: A candidate that one of these matches as a whole is no secret: UUIDs; words and numbers joined by marks; examples.
ALLOWED = [
    r"[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}",
    r"[+/_-]*(?:[A-Za-z]{1,15}|[0-9]{1,8})(?:[+/_-]+(?:[A-Za-z]{1,15}|[0-9]{1,8}))*[+/_-]*",
    r".*(?:EXAMPLE|[Ee]xample|[Pp]laceholder|[Cc]hangeme|[Xx]{6}).*",
    r".*(?:0123456789|abcdefghijkl|ABCDEFGHIJKL).*",
]
#: A candidate right after one of these is a checksum, a revision or data.
ALLOWED_BEFORE = [r"(?i)(?:sha-?[0-9]{1,3}|md5|checksum|commit|revision)[\"']?[ :=-]{1,3}[\"']?", r";base64,"]
BEFORE_BYTES = 32
#: Starts of windows that one row of the state vector slides over.
STRETCH = 512
SCALE = 1 << 32
FOUND = "found array<struct<kind string, start long, end long, entropy double>>"
FOUND_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("entropy", pa.float64())]))


def _table(letters: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(letters.encode())] = True
    return out


def runs(data: np.ndarray, rows: np.ndarray, letters: str, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of `letters` in bytes that do not reach over a row's start."""
    mask = _table(letters)[data]
    steps = np.diff(mask.view(np.int8), prepend=0, append=0)
    inner = rows[(rows > 0) & (rows < len(data))]
    cuts = np.unique(inner[mask[inner] & mask[inner - 1]])
    starts = np.sort(np.r_[np.flatnonzero(steps == 1), cuts])
    ends = np.sort(np.r_[np.flatnonzero(steps == -1), cuts])
    long = ends - starts >= least
    return starts[long], ends[long]


def window_sums(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, letters: str, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all windows in the runs, in order, and the sum of n log2 n over each one's counts n, times SCALE.

    Long runs are cut into stretches of window starts. All stretches advance together by a character: it is counted in, the one
    that leaves is counted out, and the sum changes by two steps of a table; those at their end drop out. Sums are whole numbers, so
    that a window's sum does not depend on the way to it.
    """
    number = ends - starts - window + 1
    pieces = -(-number // STRETCH)
    nth = spans(pieces, np.zeros(len(pieces), np.int64))
    begin = np.repeat(starts, pieces) + nth * STRETCH
    size = np.minimum(STRETCH, np.repeat(number, pieces) - nth * STRETCH)
    code = np.zeros(256, np.int64)
    code[list(letters.encode())] = np.arange(len(letters))
    n = np.arange(window + 2)
    sums = np.round(n * np.log2(np.maximum(n, 1)) * SCALE).astype(np.int64)
    up = np.diff(sums)
    order = np.argsort(-size, kind="stable")
    begin, size = begin[order], size[order]
    counts = np.zeros(len(begin) * len(letters), np.int16)
    base = np.arange(len(begin)) * len(letters)
    total = np.zeros(len(begin), np.int64)
    less = -size
    at, value = [], []
    for step in range(window - 1 + int(size.max(initial=0))):
        active = int(np.searchsorted(less, window - 1 - step, "left")) if step >= window else len(begin)
        begin, base, total = begin[:active], base[:active], total[:active]
        if step >= window:
            gone = base + code[data[begin + step - window]]
            counts[gone] -= 1
            total -= up[counts[gone]]
        come = base + code[data[begin + step]]
        total += up[counts[come]]
        counts[come] += 1
        if step >= window - 1:
            at.append(begin + step - window + 1)
            value.append(total.copy())
    at, value = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (at, value))
    order = np.argsort(at, kind="stable")
    return at[order], value[order]


def _hot(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, kind: CharClass) -> list[tuple[int, int, float, int]]:
    """(start, end, highest entropy, run) of the stretches that windows at or over the limit cover."""
    if not len(starts):
        return []
    at, sums = window_sums(data, starts, ends, kind.letters, kind.window)
    size = ends - starts
    flat = data[spans(size, starts)]
    digit = np.cumsum(np.r_[0, _table(DIGITS)[flat]])
    letter = np.cumsum(np.r_[0, _table(LOWER + UPPER)[flat]])
    run = np.searchsorted(starts, at, "right") - 1
    place = at - starts[run] + (np.cumsum(size) - size)[run]
    bits = np.log2(kind.window) - sums / (SCALE * kind.window)
    hot = (bits >= kind.bits - 1e-9) & (digit[place + kind.window] > digit[place]) & (letter[place + kind.window] > letter[place])
    at, run, bits = at[hot], run[hot], bits[hot]
    if not len(at):
        return []
    first = np.flatnonzero(np.r_[True, (run[1:] != run[:-1]) | (at[1:] - at[:-1] > kind.window)])
    last = np.r_[first[1:], len(at)] - 1
    return list(zip(at[first].tolist(), (at[last] + kind.window).tolist(), np.maximum.reduceat(bits, first).tolist(), run[first].tolist()))


def _scan(raw: bytes, data: np.ndarray, rows: np.ndarray, may_assign: np.ndarray, classes: Mapping[str, CharClass],
          allowed: re.Pattern | None, before: re.Pattern | None) -> list[tuple[int, int, int, str, float | None]]:
    """(row, start, end, kind, entropy) in bytes of the block."""
    row_of = lambda at: int(np.searchsorted(rows, at, "right")) - 1
    out = []
    for row in np.flatnonzero(may_assign).tolist():
        for m in ASSIGN.finditer(raw, int(rows[row]), int(rows[row + 1])):
            if m.end(2) - m.start(2) >= ASSIGN_LEAST:
                out.append((row, m.start(), m.end(), "assign", None))
    for a, b in zip(*(x.tolist() for x in runs(data, rows, UPPER + DIGITS, ACCESS_LEAST))):
        start = raw.find(ACCESS, a, b)
        if start >= 0 and b - start >= ACCESS_LEAST:
            out.append((row_of(a), start, b, "access", None))
    out += [(row_of(a), a, b, "hex", None) for a, b in zip(*(x.tolist() for x in runs(data, rows, DIGITS + "abcdef", HEX_LEAST)))]
    for name, kind in classes.items():
        starts, ends = runs(data, rows, kind.letters, kind.window)
        found, seen, row, free = [], -1, 0, False
        for a, b, bits, run in _hot(data, starts, ends, kind):
            if run != seen:  # a candidate is held against the allow-list once
                seen, head = run, int(starts[run])
                row = row_of(head)
                free = bool((allowed and allowed.fullmatch(raw, head, int(ends[run])))
                            or (before and before.search(raw[max(int(rows[row]), head - BEFORE_BYTES):head])))
            if not free:
                found.append((row, a, b, name, bits))
        out = _merged(out, found)
    return out


def _merged(out: list, found: list) -> list:
    """Add the spans that no earlier one holds."""
    if not found:
        return out
    starts = np.array(sorted(o[1] for o in out), np.int64)
    reach = np.maximum.accumulate(np.array([e for _, e in sorted((o[1], o[2]) for o in out)], np.int64)) if out else starts
    def held(a: int, b: int) -> bool:
        i = int(np.searchsorted(starts, a, "right"))
        return i > 0 and reach[i - 1] >= b
    return out + [f for f in found if not held(f[1], f[2])]


def _scanner(classes: Mapping[str, CharClass], allowed: Sequence[str], before: Sequence[str]):
    order = {name: i for i, name in enumerate([*BASE, *classes])}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        allow = re.compile("|".join(f"(?:{x})" for x in allowed).encode(), re.S) if allowed else None
        ahead = re.compile("|".join(f"(?:{x.removeprefix('(?i)')})" for x in before).encode() + rb"\Z", re.I) if before else None
        for block in blocks(batches, "text"):
            text = pc.fill_null(block.column("text"), "").cast(pa.large_string())
            ends = np.frombuffer(text.buffers()[1], np.int64)[text.offset:text.offset + len(text) + 1]
            raw = bytes(memoryview(text.buffers()[2] or b"")[ends[0]:ends[-1]])
            data, rows = np.frombuffer(raw, np.uint8), ends - ends[0]
            may = pc.match_substring_regex(text, KEYWORDS).to_numpy(zero_copy_only=False)
            found = _scan(raw, data, rows, may, classes, allow, ahead)
            if found:
                inner = np.cumsum(np.r_[0, (data & 0xC0) == 0x80])  # bytes that begin no character
                point = lambda at, row: int(at - rows[row] - (inner[at] - inner[rows[row]]))
                found = [(row, point(a, row), point(b, row), kind, bits) for row, a, b, kind, bits in found]
            per: list[list] = [[] for _ in range(len(text))]
            for row, a, b, kind, bits in sorted(found, key=lambda f: (f[0], f[1], order[f[3]])):
                per[row].append({"kind": kind, "start": a, "end": b, "entropy": None if bits is None else round(bits, 6)})
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(per, FOUND_TYPE)], ["doc_id", "found"])

    return run


def secret_scan(docs: DataFrame, classes: Mapping[str, CharClass] = CLASSES, allowed: Sequence[str] = ALLOWED,
                allowed_before: Sequence[str] = ALLOWED_BEFORE) -> DataFrame:
    """(doc_id, found): the secrets of each row's whole text as (kind, start, end, entropy), in code points, end exclusive.

    Kinds `assign`, `access` and `hex` are the fixed patterns; they stay whatever the allow-list says and have no
    entropy. The kinds of `classes` follow: stretches covered by windows whose entropy is at or over the class's limit and
    that hold a letter and a digit; `entropy` is the highest of its windows. Spans are in order of start, then of kind
    as listed. A stretch inside a span found before (fixed patterns, then the classes in order) is left out, as is one whose
    candidate matches `allowed` as a whole or follows `allowed_before`.

    A null text is empty; a null doc_id stays null; repeated rows count each; an empty table gives none; doc_id and text are read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_scanner(dict(classes), list(allowed), list(allowed_before)), f"doc_id long, {FOUND}")


def digests(found: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of what `secret_scan` found."""
    def text(of) -> Column:
        return F.array_join(F.transform(of, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def number(kind: str) -> Column:
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(number, BASE), F.sha2(text(F.filter("found", lambda s: s["kind"].isin(BASE))), 256).alias("base_sha256"),
                        text(F.col("found")).alias("spans"))
