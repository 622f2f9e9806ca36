import hashlib
import heapq
import random
import re
import zlib

import pytest

from limnos.llm import trie
from tests.llm import cases

COLUMNS = "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"


def digest(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()


def plain(rows):
    """The contract with one dictionary of prefixes."""
    turns = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            turns.setdefault(conv, []).append(((turn is not None, turn or 0, digest(role, text)), (role, text)))
    turns = {c: [t for _, t in sorted(own)] for c, own in turns.items()}
    rebuilt = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        rebuilt[c] = tuple(turns.get(base, [])[:h] + own[h:])
    members = {}
    for c, path in rebuilt.items():
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    out, totals = [], {}
    for node in sorted(members, key=len, reverse=True):
        own = members[node]
        n_words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        below = [totals[x] for x in children.get(node, [])]
        leaves = sum(x for x, _ in below) or 1
        totals[node] = leaves, (len(own) - 1) * n_words + sum(x for _, x in below)
        ends = sorted(c for c in own if len(rebuilt[c]) == len(node))
        out.append((min(own), len(node), min(members[node[:-1]]) if node else None, len(own), len(children.get(node, [])), *totals[node],
                    hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=repr)


def conversations(seed, n=120, long=0):
    r = random.Random(seed)
    roles = ["system", "user", "assistant", None, ""]
    texts = ["a b", "a b", " ", None, "", "hello there\tyou", "x", "ü  y\nz", "w " * 40]
    rows = []
    for c in range(-25, n):
        if c % 7 == 3:
            continue
        for t in range(r.choice([0, 1, 2, 3, 5, 8])):
            rows.append((c, t if r.random() < .95 else None, r.choice(roles), r.choice(texts)))
    copy = [(0, "system", "s s"), (1, "user", "u u u"), (2, "assistant", "same"), (3, "user", "end")]
    rows += [(c, *t) for c in range(1000, 1060) for t in copy[:r.choice([2, 3, 4, 4, 4])]]
    rows += [(c, t, "user", f"turn {t}" if t < long - c % 3 else f"own {c}") for c in (2000, 2001, 2020, 2040) for t in range(long)]
    rows += [rows[3], rows[3], (None, 1, "user", "lost"), (5000, None, None, None)]
    return rows


def frame(spark, rows, parts=5):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(parts)


@pytest.mark.parametrize("seed, long, band, nodes, messages", [(1, 0, 4096, 50_000, 10), (2, 40, 4096, 20, 3), (3, 70, 4, 60, 200_000), (4, 30, 1, 1000, 5)])
def test_equals_one_dictionary(spark, seed, long, band, nodes, messages):
    rows = conversations(seed, long=long)
    got = cases.rows(trie.prefix_trie(frame(spark, rows), band, nodes, messages), *COLUMNS)
    assert got == plain(rows)


def test_clashing_columns_and_empty_table(spark):
    rows = conversations(5, 40)
    docs = frame(spark, rows).selectExpr("*", *[f"'e' AS `{c}`" for c in [*cases.EXTRA, "depth", "k1", "shard", "band", "digest", "words", "base"]])
    assert cases.rows(trie.prefix_trie(docs), *COLUMNS) == plain(rows)
    assert trie.prefix_trie(docs.limit(0)).count() == 0
    one = [(40, 0, "user", "a")] * 3
    assert cases.rows(trie.prefix_trie(frame(spark, one)), *COLUMNS) == plain(one)


def test_a_turnless_conversation_is_a_member_of_the_root(spark):
    c = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 == 2)
    rows = [(c, 0, "user", "gone")]
    assert plain(rows) == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]
    assert cases.rows(trie.prefix_trie(frame(spark, rows)), *COLUMNS) == plain(rows)


def test_long_lists_of_members_come_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(trie, "PIECE_BYTES", 30)
    rows = [(c, 0, "user", "same") for c in range(0, 2000, 20)] + [(c, t, "u", "v") for c in range(1, 300) for t in range(4)]
    assert cases.rows(trie.prefix_trie(frame(spark, rows)), *COLUMNS) == plain(rows)


@pytest.mark.parametrize("limit, runs", [(1, 2), (7, 3), (1000, 2)])
def test_queue_gives_the_least_first(limit, runs):
    r = random.Random(limit)
    queue, heap = trie.SpillingQueue(limit, runs), []
    for _ in range(3000):
        if r.random() < .6 or not heap:
            item = (r.randint(0, 50), r.randint(0, 10 ** 6))
            queue.push(item)
            heapq.heappush(heap, item)
        else:
            assert queue.least() == heap[0] and queue.pop() == heapq.heappop(heap)
    while heap:
        assert queue.pop() == heapq.heappop(heap)
    assert queue.least() is None
