"""License scans by patience alignment.

A passage has at most `reach` times as many words as its template (twice as many unless told otherwise): a copy with more
words between is not found. Every place of a text may begin a passage. Windows from each template
word on whose words can cover enough of the template at all (an exact bound) are measured by the length of their longest
common subsequence, in bits of whole numbers; a window that has enough is cut to the words that reach this length, so
what is found does not depend on the place in the text. These passages are aligned: words that occur once in both are
anchors, the longest increasing run of them is kept, and the gaps between are aligned in the same way; a gap without
anchors is matched from its two ends and then by the longest common subsequence. Where anchors that cross cost words,
the longest common subsequence of the whole passage is taken.

Names and version numbers of a template must match. Where passages of two templates overlap, one that leaves more of its
own words unmatched than the other does there goes, so that a text counts as the nearest variant.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from limnos.llm.common import blocks, coded, offsets
from limnos.llm.license_texts import TEMPLATES, must_match

THRESHOLD = 0.9
#: Words of a passage for each of the template's, at most.
REACH = 2.0
WORD = re.compile(r"[^\W_]+")
#: Bytes of templates that may be sent to all tasks.
TEMPLATE_BYTES = 8 << 20

FOUND = "array<struct<license:string,coverage:double,matched:int,first:int,last:int>>"
FOUND_TYPE = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("matched", pa.int32()), ("first", pa.int32()), ("last", pa.int32())]))


def words_of(text: str | None) -> list[str]:
    """Letters and digits in a row, lower-cased."""
    return WORD.findall((text or "").lower())


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest run of pairs, sorted by the first number, whose second numbers increase."""
    tops, ends, before = [], [], []
    for k, (_, b) in enumerate(pairs):
        at = bisect_left(tops, b)
        before.append(ends[at - 1] if at else -1)
        if at == len(tops):
            tops.append(b)
            ends.append(k)
        else:
            tops[at], ends[at] = b, k
    out, k = [], ends[-1] if ends else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def _common(a: list, b: list) -> list[tuple[int, int]]:
    """A longest common subsequence as pairs of places."""
    best = np.zeros((len(a) + 1, len(b) + 1), np.int32)
    for i in range(len(a) - 1, -1, -1):
        row, below = best[i], best[i + 1]
        for j in range(len(b) - 1, -1, -1):
            row[j] = below[j + 1] + 1 if a[i] == b[j] else max(below[j], row[j + 1])
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1, j] >= best[i, j + 1]:
            i += 1
        else:
            j += 1
    return out


def align(a: list, b: list) -> list[tuple[int, int]]:
    """Pairs (place in a, place in b) of equal words, both increasing."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i, i_end, j, j_end = todo.pop()
        while i < i_end and j < j_end and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < i_end and j < j_end and a[i_end - 1] == b[j_end - 1]:
            i_end, j_end = i_end - 1, j_end - 1
            out.append((i_end, j_end))
        if i == i_end or j == j_end:
            continue
        in_a, in_b = Counter(a[i:i_end]), Counter(b[j:j_end])
        place = {w: k for k, w in enumerate(b[j:j_end], j) if in_b[w] == 1}
        anchors = _increasing([(k, place[w]) for k, w in enumerate(a[i:i_end], i) if in_a[w] == 1 and w in place])
        if not anchors:
            out += [(i + x, j + y) for x, y in _common(a[i:i_end], b[j:j_end])]
            continue
        out += anchors
        for (p, q), (p_end, q_end) in zip([(i - 1, j - 1), *anchors], [*anchors, (i_end, j_end)]):
            todo.append((p + 1, p_end, q + 1, q_end))
    return sorted(out)


class _Template:
    def __init__(self, number: int, name: str, words: list[str], threshold: float, reach: float = REACH):
        self.number = number
        self.name, self.words, self.counts, self.must = name, words, Counter(words), frozenset(must_match(words))
        self.named = Counter(words[k] for k in self.must)
        self.most = max(len(words), int(reach * len(words)))
        self.least = max(1, int(np.ceil(round(threshold * len(words), 9))))
        self.places = {w: sum(1 << k for k, x in enumerate(words) if x == w) for w in self.counts}
        self.mirrored = {w: sum(1 << k for k, x in enumerate(reversed(words)) if x == w) for w in self.counts}

    def _longest(self, words: Iterator[str], places: dict[str, int], enough: int) -> tuple[int, int]:
        """(length, read): longest common subsequence, and the words read until it or `enough` was reached."""
        full = (1 << len(self.words)) - 1
        row, length, read = full, 0, 0
        for k, w in enumerate(words, 1):
            hit = row & places[w]
            grown = row + hit
            row = (grown | (row - hit)) & full
            if grown > full:
                length, read = length + 1, k
                if length == enough:
                    break
        return length, read

    def passages(self, words: list[str], known: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(first, end, matched) of words; known: for each, if it is one of the template's; at: where the texts begin."""
        size, total, places = len(self.words), offsets(known), np.flatnonzero(known)
        k, ends = np.arange(len(places)), np.repeat(at[1:], total[at[1:]] - total[at[:-1]])
        reach = total[np.minimum(places + self.most, ends)]
        near = np.flatnonzero(reach - k >= self.least)
        held, enough, low, high, done, last = Counter(), 0, 0, 0, 0, None
        for k, to in zip(near.tolist(), reach[near].tolist()):
            if k >= high:
                held.clear()
                enough, low, high = 0, k, k
            for w in (words[i] for i in places[low:k].tolist()):
                held[w] -= 1
                enough -= held[w] < self.counts[w]
            for w in (words[i] for i in places[high:to].tolist()):
                enough += held[w] < self.counts[w]
                held[w] += 1
            low, high = k, to
            if enough < self.least or k < done:
                continue
            window = [words[i] for i in places[k:to].tolist()]
            matched, read = self._longest(iter(window), self.places, size)
            if matched < self.least:
                continue
            first = k + read - self._longest(reversed(window[:read]), self.mirrored, matched)[1]
            if matched == size:
                done = first + 1  # windows up to there have the same passage
            found = int(places[first]), int(places[k + read - 1]) + 1, matched
            if found != last:
                yield found
            last = found


    def hits(self, words: list[str], known: np.ndarray, at: np.ndarray) -> Iterator[_Hit]:
        """The best passages that do not overlap: of most matched words, then the shortest, then the first."""
        group, reach = [], 0
        for passage in self.passages(words, known, at):
            if group and passage[0] >= reach:
                yield from self._best(words, group)
                group = []
            group.append(passage)
            reach = max(reach, passage[1])
        yield from self._best(words, group)

    def _best(self, words: list[str], group: list[tuple[int, int, int]]) -> Iterator[_Hit]:
        taken: list[tuple[int, int]] = []
        for first, end, matched in sorted(group, key=lambda x: (-x[2], x[1] - x[0], x[0])):
            k = bisect_left(taken, (end, 0))
            if k and taken[k - 1][1] > first or not self.named <= Counter(words[first:end]):
                continue
            for way in (align, _common):
                pairs = way(words[first:end], self.words)
                if len(pairs) >= matched and self.must <= {b for _, b in pairs}:
                    insort(taken, (first, end))
                    yield _Hit(self, first, end, [first + a for a, _ in pairs])
                    break


@dataclass
class _Hit:
    template: _Template
    first: int
    end: int
    places: list[int]
    nearer: bool = True

    @property
    def rank(self) -> tuple[int, int]:
        return -len(self.places), self.end - self.first

    def left(self, first: int, end: int) -> int:
        """Words of a stretch that this one does not match."""
        return end - first - (bisect_left(self.places, end) - bisect_left(self.places, first))

    def yields_to(self, other: _Hit) -> bool:
        mine, others = ((x.left(self.first, self.end), -len(x.places), len(x.template.words)) for x in (self, other))
        return others < mine


def _nearest(hits: list[_Hit]) -> list[_Hit]:
    """Those that yield to no other one that they overlap, in the order of the text."""
    hits = sorted(hits, key=lambda x: x.first)
    for k, a in enumerate(hits):
        for b in hits[k + 1:]:
            if b.first >= a.end:
                break
            a.nearer, b.nearer = a.nearer and not a.yields_to(b), b.nearer and not b.yields_to(a)
    return [x for x in hits if x.nearer]


def _scan(templates: list[tuple[str, str]], threshold: float, reach: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = [_Template(k, name, words, threshold, reach) for k, (name, text) in enumerate(templates) if (words := words_of(text))]
        for block in blocks(batches, "text"):
            each = [words_of(t) for t in block.column("text").to_pylist()]
            counts = np.fromiter(map(len, each), np.int64, len(each))
            at, found, hits = offsets(counts), [[] for _ in each], []
            flat = [w for words in each for w in words]
            codes, names = coded(pa.array(flat, pa.string()))
            names = names.to_pylist()
            for template in made:
                known = np.fromiter((w in template.counts for w in names), bool, len(names))[codes] if names else np.zeros(0, bool)
                hits += template.hits(flat, known, at)
            best: dict[tuple, _Hit] = {}
            for hit in _nearest(hits):
                key = int(np.searchsorted(at, hit.first, "right")) - 1, hit.template.number
                if key not in best or hit.rank < best[key].rank:
                    best[key] = hit
            for (doc, _), hit in sorted(best.items()):
                matched, start = len(hit.places), int(at[doc])
                found[doc].append({"license": hit.template.name, "coverage": matched / len(hit.template.words), "matched": matched,
                                   "first": hit.first - start, "last": hit.end - 1 - start})
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(counts), pa.array(found, FOUND_TYPE)], ["doc_id", "n_words", "found"])
    return run


def default_templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TEMPLATES.items()), "license string, text string")


def license_scan(docs: DataFrame, templates: DataFrame | None = None, threshold: float = THRESHOLD, reach: float = REACH) -> DataFrame:
    """(doc_id, n_words, license, coverage, n_licenses, found) of each row's whole text.

    `found` has each template (license, text) that a passage of at most `reach` times its words covers to `threshold` or more,
    in order and with all names and version numbers, and that no overlapping passage of another template matches better
    (fewer unmatched words there, then more words in all, then a shorter template), with the words of its best passage
    (most matched words, then the shortest, then the first). `license` is that of the greatest coverage, then of most
    words, then by name. A null or empty text and one without a license have null and 0; a template without words is never found; a null name
    counts as empty; a null doc_id stays null; repeated rows stay; an empty table gives none.
    """
    templates = default_templates(docs.sparkSession) if templates is None else templates
    rows = templates.select(F.coalesce(F.col("license").cast("string"), F.lit("")), F.coalesce("text", F.lit("")))
    size = rows.agg(F.sum(F.octet_length(rows.columns[1]))).first()[0] or 0
    if size > TEMPLATE_BYTES:
        raise ValueError(f"templates of {size} bytes; at most {TEMPLATE_BYTES} are sent to the tasks, give them in several calls")
    listed = sorted((r[0], r[1]) for r in rows.collect())
    found = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_scan(listed, threshold, reach), f"doc_id long, n_words long, found {FOUND}")
    order = F.transform("found", lambda x: F.struct((-x["coverage"]).alias("c"), (-x["matched"]).alias("m"), x["license"].alias("license")))
    best = F.get(F.array_sort(order), F.lit(0))
    return found.select("doc_id", "n_words", best["license"].alias("license"), F.coalesce(-best["c"], F.lit(0.0)).alias("coverage"),
                        F.size("found").cast("long").alias("n_licenses"), "found")
