import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest

from limnos.llm import align
from tests.llm import cases

LETTERS = ["a", "The", " ", "  ", "\n", "É", "é", ".", ",", "H̱", "<|endoftext|>", "'s", "1", "½", "日", "ß", "\t", "\x00", "▁", "<s>", "\r", "\xa0", "　",
           " ", "\x1c", "\x85", " the", " of", "the", "ing", "​", "“", "😀", "aaaa", "2024", "''", " '", "<0x41>", "﻿", " "]


def strings(n, seed=3, letters=LETTERS):
    r = random.Random(seed)
    return ["", None, " ", "a ", "\n", "  ", "  a", "a\xa0  b", "a \xa0b", "a\n \n b"] + ["".join(r.choice(letters) for _ in range(r.randint(0, 40))) for _ in range(n)]


def library(many):
    """Ids of both tokenizers on whole texts, and the bytes of each token."""
    import sentencepiece
    from tokenizers import Tokenizer
    a = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    letters = {c: bytes([x]) for c, x in align._byte_letters().items()}
    out = []
    for text in many:
        if not text:
            out.append(([], []))
            continue
        first = [(i, b"".join(letters[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
        second = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
        raw = (" " + text).encode()
        same = all(b"".join(x for _, x in side) == raw for side in (first, second))
        out.append((first, second) if same else ([], []))
    return out


def groups(first, second):
    """Groups between common ends, found by the sets of ends."""
    ends = [list(np.cumsum([len(x) for _, x in side])) for side in (first, second)]
    cuts = sorted(set(ends[0]) & set(ends[1]))
    out, last = [], 0
    for cut in cuts:
        out.append(tuple([i for (i, _), e in zip(side, at) if last < e <= cut] for side, at in zip((first, second), ends)))
        last = cut
    return out


def plain(many):
    """The contract, pair by pair."""
    every = [groups(*x) for x in library(many)]
    linked = [Counter((x, y) for a, b in g for x in a for y in b) for g in every]
    count = Counter(p for own in linked for p in own)
    best = {}
    for (x, _), n in count.items():
        best[x] = max(best.get(x, 0), n)
    out = []
    for g, own in zip(every, linked):
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        out.append((sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(own.values()), sum(n for p, n in own.items() if count[p] == best[p[0]]),
                    sum(n * count[p] for p, n in own.items()), hashlib.sha256(text.encode()).hexdigest() if g else ""))
    return out


@pytest.fixture(scope="module")
def pair():
    return align.pair_of(P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"))


def test_tokens_and_groups_equal_the_library_on_whole_texts(pair):
    many = strings(3000)
    found = align.aligned(pa.array(many), pair)
    at_a, at_b = np.r_[0, np.cumsum(found.n_a)], np.r_[0, np.cumsum(found.n_b)]
    want = library(many)
    assert [found.ids_a[i:j].tolist() for i, j in zip(at_a, at_a[1:])] == [[i for i, _ in a] for a, _ in want]
    assert [found.ids_b[i:j].tolist() for i, j in zip(at_b, at_b[1:])] == [[i for i, _ in b] for _, b in want]
    got = [[] for _ in many]
    for d, a0, a1, b0, b1 in zip(found.doc_of_group, *found.groups):
        got[d].append((found.ids_a[a0:a1].tolist(), found.ids_b[b0:b1].tolist()))
    assert got == [groups(*x) for x in want]


def test_ranks_give_the_ids_of_the_library(pair):
    r = random.Random(2)
    odd = [chr(r.choice([r.randint(32, 126), r.randint(97, 122), r.randint(0x20, 0x24ff), r.randint(0x3000, 0x9fff), r.randint(0x1f300, 0x1f9ff)])) for _ in range(4000)]
    many = ["".join(r.choice(odd) for _ in range(r.randint(1, 50))) for _ in range(5000)] + [t for t in strings(3000, 4) if t]
    assert pair.ranks is not None
    assert [pair.ranks.encode_ordinary(t) for t in many] == [e.ids for e in pair.a.encode_batch(many, add_special_tokens=False)]


def test_very_long_words(pair):
    many = ["a" * 5000, "ab" * 600 + " c", "日本" * 700, " ".join(["x" * n for n in range(990, 1010)])]
    found = align.aligned(pa.array(many), pair)
    want = library(many)
    assert found.n_a.tolist() == [len(a) for a, _ in want] and found.n_b.tolist() == [len(b) for _, b in want]
    assert found.ids_a.tolist() == [i for a, _ in want for i, _ in a]


@pytest.mark.parametrize("stretch", [1, 5, 1 << 30])
def test_stretches_change_nothing(pair, monkeypatch, stretch):
    many = strings(300)
    want = align.aligned(pa.array(many), pair)
    monkeypatch.setattr(align, "STRETCH", stretch)
    got = align.aligned(pa.array(many), pair)
    assert all(np.array_equal(x, y) for x, y in zip(want.groups, got.groups)) and np.array_equal(want.doc_of_group, got.doc_of_group)


def test_groups_of_many_tokens_on_both_sides():
    ids_a, ids_b = np.array([7, 7, 8, 9, 9]), np.array([1, 2, 1, 1, 3, 3])
    made = align.Groups(np.array([0, 3]), np.array([3, 5]), np.array([0, 3]), np.array([3, 6]))
    key, times = align.links(ids_a, ids_b, made, np.array([0, 4]))
    want = Counter((0, a, b) for a in (7, 7, 8) for b in (1, 2, 1)) + Counter((4, a, b) for a in (9, 9) for b in (1, 3, 3))
    assert {(k >> 32, k >> 16 & 0xFFFF, k & 0xFFFF): n for k, n in zip(key.tolist(), times.tolist())} == want
    text, ends = align.group_texts(ids_a, ids_b, made)
    assert text.tobytes() == b"7,7,8|1,2,1;9,9|1,3,3;" and ends.tolist() == [12, 22]


COLUMNS = "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"


def test_alignment(spark, monkeypatch):
    many = strings(400, 9) + [t for t in cases.texts()]
    docs = spark.createDataFrame(list(enumerate(many)), "doc_id long, text string").repartition(5)
    monkeypatch.setattr(align, "BLOCK_TEXT", 2000)
    want = sorted(((i, *r) for i, r in enumerate(plain(many))), key=repr)
    assert cases.rows(align.alignment(docs), *COLUMNS) == want
    shown = {r["doc_id"]: [(g["a"], g["b"]) for g in r["groups"]] for r in align.token_groups(docs).collect()}
    assert shown == {i: groups(*x) for i, x in enumerate(library(many))}


def test_hard_rows(spark):
    docs = cases.documents(spark)
    found = cases.pairs(docs)
    assert cases.rows(align.alignment(docs), *COLUMNS) == sorted(((i, *r) for (i, _), r in zip(found, plain([t for _, t in found]))), key=repr)
    assert align.alignment(docs.limit(0)).count() == 0
    assert align.alignment(docs.where("text IS NULL")).select("n_a").distinct().collect()[0][0] == 0
