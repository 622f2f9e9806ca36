import random

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest

from limnos.llm import packing, token_counts, token_store
from limnos.llm.tokens import Encoder
from tests.llm import cases

LETTERS = ["a", "The", " ", "  ", "\n", "É", "é", ".", ",", "H̱", "<|endoftext|>", "'s", "1", "½", "日", "ß", "İ", "Σ", "\t", "\x00", "▁", "<s>", "\r"]


def strings(n):
    r = random.Random(3)
    return ["", None, " ", "a ", "\n", "  "] + ["".join(r.choice(LETTERS) for _ in range(r.randint(0, 40))) for _ in range(n)]


def test_ids_equal_the_library_on_whole_texts():
    many = strings(1500)
    ids, counts = Encoder(P.path("word_bpe_49k.json")).block(pa.array(many))
    at = np.r_[0, np.cumsum(counts)]
    assert [ids[a:b].tolist() + [1] for a, b in zip(at, at[1:])] == cases.word_ids(many)


def test_pre_tokens_sum_to_the_library():
    many = strings(1500)
    words, owner = token_counts.pre_tokens(pa.array(many))
    model = token_counts._pieces(P.path("piece_bpe_32k.model"))
    each = [len(ids) - ("\n" in w) for w, ids in zip(words.to_pylist(), model.encode(words.to_pylist()))]
    assert np.bincount(owner, each, len(many)).astype(int).tolist() == cases.piece_counts(many)


def test_token_counts(spark, monkeypatch):
    docs = cases.documents(spark)
    found = cases.pairs(docs)
    want = sorted(((i, len((t or "").encode()), n, n > 50) for (i, t), n in zip(found, cases.piece_counts([t for _, t in found]))), key=repr)
    assert cases.rows(token_counts.token_counts(docs, limit=50), "doc_id", "n_bytes", "n_tokens", "over_limit") == want
    assert token_counts.token_counts(docs.limit(0)).count() == 0


def test_sums_are_sent_in_parts():
    held, token_counts.HELD_SUMS = token_counts.HELD_SUMS, 1
    try:
        data = token_counts.STAGE_NAMES
        from unittest.mock import patch
        with patch("pyspark.TaskContext.get") as context:
            context.return_value.partitionId.return_value = 5
            batch = pa.RecordBatch.from_pylist([{"doc_id": i, "text": t} for i, t in enumerate(["a b a", "b", ""])],
                                               pa.schema([("doc_id", pa.int64()), ("text", pa.string())]))
            made = pa.Table.from_batches(token_counts._frequencies(3)([batch, batch])).sort_by("bucket")
        assert made.column_names == data
        out = pa.Table.from_batches(list(token_counts._count_pieces(P.path("piece_bpe_32k.model"))(made.to_batches())))
        for block in set(out["block"].to_pylist()):
            summed = token_counts._sum(out.filter(pa.compute.equal(out["block"], block))).to_pylist()
            assert sorted((r["doc_id"], r["n_tokens"]) for r in summed) == list(enumerate(cases.piece_counts(["a b a", "b", ""])))
    finally:
        token_counts.HELD_SUMS = held


@pytest.mark.parametrize("n", [0, 1, 2, 3000])
def test_perfect_hash(n):
    keys = np.random.default_rng(n).permutation(10 * n + 1)[:n] - n
    zero = np.zeros(n, np.int64)
    made = token_store.PerfectHash.load(*token_store.PerfectHash.fit(keys, zero, zero).dump())
    assert sorted(made.slots(keys, zero, zero).tolist()) == list(range(n))


def test_perfect_hash_lists_what_no_level_takes(monkeypatch):
    monkeypatch.setattr(token_store, "LEVELS", 1)
    keys, zero = np.arange(500), np.zeros(500, np.int64)
    made = token_store.PerfectHash.load(*token_store.PerfectHash.fit(keys, zero, zero).dump())
    assert len(made.left) and sorted(made.slots(keys, zero, zero).tolist()) == list(range(500))


def test_token_store(spark):
    docs = cases.documents(spark)
    found = sorted(cases.pairs(docs), key=lambda x: (x[0] is not None, x[0] or 0))
    got = sorted(token_store.token_store(docs).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [i for i, _ in found]
    assert [r["start"] for r in got] == [0, *np.cumsum([r["n_tokens"] for r in got])[:-1].tolist()]
    ids = cases.word_ids([t for _, t in found])
    assert sorted((r["n_tokens"], r["ids_crc32"]) for r in got) == sorted((len(x), cases.crc(x)) for x in ids)
    alone = {i: x for (i, _), x in zip(found, ids) if i is not None and [j for j, _ in found].count(i) == 1}
    assert {r["doc_id"]: r["ids_crc32"] for r in got if r["doc_id"] in alone} == {i: cases.crc(x) for i, x in alone.items()}
    assert token_store.token_store(docs.limit(0)).count() == 0


def test_repeated_rows_share_no_shard(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_store, "STRETCH", 7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        docs = spark.range(3000).selectExpr("IF(id % 3 = 0, NULL, IF(id % 3 = 1, 5, id)) AS doc_id", "IF(id % 3 < 2, 'same text', concat('text ', id)) AS text")
        store = token_store.write_store(docs, str(tmp_path / "store"))
        token_store.write_shards(docs.where("doc_id = 5"), str(tmp_path / "one"), token_store.tokenizer_path())
        sizes = [p.stat().st_size for p in (tmp_path / "one").glob("part-*")]
        assert max(sizes) < 0.6 * sum(sizes), sizes
        got = sorted(token_store.lookup(store, docs.select("doc_id")).collect(), key=lambda r: r["start"])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [r["doc_id"] for r in got] == [None] * 1000 + sorted([5 if i % 3 == 1 else i for i in range(3000) if i % 3])
    assert [r["start"] for r in got] == [0, *np.cumsum([r["n_tokens"] for r in got])[:-1].tolist()]


def test_one_key_opens_one_file(spark, tmp_path, monkeypatch):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        store = token_store.write_store(spark.range(4000).selectExpr("id AS doc_id", "concat('text ', id) AS text"), str(tmp_path / "store"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    opened, real = [], token_store._shards
    monkeypatch.setattr(token_store, "_shards", lambda *a: opened.append(real(*a).inputFiles()) or real(*a))
    row = token_store.lookup(store, spark.createDataFrame([(1234,)], "doc_id long")).collect()
    assert [r["doc_id"] for r in row] == [1234] and row[0]["ids_crc32"] == cases.crc(cases.word_ids(["text 1234"])[0])
    assert len(opened[0]) == 1 < len(list((tmp_path / "store").glob("part-*")))


def test_unknown_keys_give_no_row(spark, tmp_path):
    docs = cases.documents(spark).where("doc_id IS NOT NULL")
    store = token_store.write_store(docs, str(tmp_path / "store"))
    keys = spark.createDataFrame([(10 ** 9 + i,) for i in range(3000)] + [(None,), (8,)], "doc_id long")
    assert [r["doc_id"] for r in token_store.lookup(store, keys).collect()] == [8]


def plain_best_fit(counts, size):
    rooms = []
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            fits = [r for r in rooms if r >= length]
            rest = min(fits) if fits else size
            if fits:
                rooms.remove(rest)
            rooms.append(rest - length)
    return len(rooms)


def test_best_fit_equals_piece_by_piece():
    for k in range(150):
        r = random.Random(k)
        size = r.choice([10, 30, 64, 100])
        counts = {n: r.randint(1, 9) for n in r.sample(range(1, size + 1), r.randint(1, min(20, size)))}
        filled, seen = {}, {n: [] for n in counts}
        for length, rank, number, first, place in packing.best_fit(counts, size):
            for i in range(number):
                filled.setdefault(first + i, []).append((place, length))
                seen[length].append(rank + i)
        assert all(sorted(seen[n]) == list(range(c)) for n, c in counts.items())
        for held in filled.values():
            at = 0
            for place, length in sorted(held):
                assert place == at
                at += length
            assert at <= size
        assert len(filled) == plain_best_fit(counts, size)


@pytest.mark.parametrize("size", [16, 4096])
def test_packing(spark, size):
    docs = cases.documents(spark)
    found = cases.pairs(docs)
    want = sorted(((i, k, k * size, len(x[k * size:(k + 1) * size]), cases.crc(x[k * size:(k + 1) * size]))
                   for (i, _), x in zip(found, cases.word_ids([t for _, t in found])) for k in range(-(-len(x) // size))), key=repr)
    got = packing.pack_documents(docs, size).collect()
    assert sorted((tuple(r)[:5] for r in got), key=repr) == want
    held = {}
    for r in got:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    counts = {}
    for _, _, _, n, _ in want:
        counts[n] = counts.get(n, 0) + 1
    assert len(held) == plain_best_fit(counts, size)
    assert packing.pack_documents(docs.limit(0), size).count() == 0
