import hashlib

import numpy as np
import pytest

from limnos.llm import decontaminate, simhash, substrings
from tests.llm import cases


@pytest.mark.parametrize("window,seed,group", [(35, 12, 2048), (5, 2, 1)])
def test_substring_dedup(spark, monkeypatch, window, seed, group):
    monkeypatch.setattr(substrings, "GROUP", group)
    monkeypatch.setattr("limnos.llm.common.BLOCK_ROWS", 4)
    docs = cases.documents(spark)
    found = cases.pairs(docs)
    want = sorted(((i, *x) for (i, _), x in zip(found, cases.without_windows([t for _, t in found], window))), key=repr)
    got = substrings.substring_dedup(docs, window, seed)
    assert cases.rows(got, "doc_id", "n_words", "n_removed", "kept_sha256") == want
    assert any(x[2] for x in want) and any(x[1] and not x[2] for x in want)
    assert all(sum(s["last"] - s["first"] + 1 for s in r["removed"]) == r["n_removed"] for r in got.collect())
    assert substrings.substring_dedup(docs.limit(0), window, seed).count() == 0


def test_repeats_are_cut_out_of_the_text(spark):
    docs = cases.documents(spark)
    got = substrings.without_repeats(docs)
    assert got.dtypes == docs.dtypes and got.count() == docs.count()
    found = cases.pairs(docs)
    want = sorted(x[2] for x in cases.without_windows([t for _, t in found], 35))
    assert sorted(hashlib.sha256(b" ".join(cases.words(t))).hexdigest() for _, t in cases.pairs(got)) == want
    kept = {t for (_, t), x in zip(found, cases.without_windows([t for _, t in found], 35)) if not x[1]}
    assert kept <= {t for _, t in cases.pairs(got)}


def test_near_duplicates(spark):
    docs = cases.documents(spark)
    found = cases.pairs(docs)
    prints = [cases.fingerprint(t) for _, t in found]
    roots = cases.classes(prints, 4)
    least = {}
    for (i, _), r in zip(found, roots):
        least[r] = min((x for x in (least.get(r), i) if x is not None), default=None)
    want = sorted(((i, f"{p:016x}", least[r]) for (i, _), p, r in zip(found, prints, roots)), key=repr)
    assert cases.rows(simhash.near_duplicates(docs), "doc_id", "fingerprint", "component_id") == want
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_one_row_of_each_group_stays(spark):
    docs = cases.documents(spark)
    got = simhash.one_of_each(docs)
    assert got.schema == docs.schema
    prints = [cases.fingerprint(t) for _, t in cases.pairs(docs)]
    assert got.count() == len(set(cases.classes(prints, 4)))


def test_tree_finds_all_links(spark, monkeypatch):
    monkeypatch.setattr(simhash, "LEAF", 8)
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2 ** 63, 150, dtype=np.uint64)
    flip = lambda x: x ^ (np.uint64(1) << rng.integers(0, 64, len(x)).astype(np.uint64))
    ball = np.uint64(3) ^ (np.uint64(1) << rng.integers(0, 12, 60).astype(np.uint64))
    points = np.unique(np.concatenate([base, *[flip(flip(base)) for _ in range(4)], *[flip(ball) for _ in range(3)]]))
    home = rng.random(len(points)) < 0.7
    near = np.bitwise_count(points[:, None] ^ points[None, :]) <= 4
    np.fill_diagonal(near, False)

    def least(links):
        root = np.arange(len(points))
        while True:
            new = np.array([min(root[i], root[links[i]].min(initial=len(points))) for i in range(len(points))])
            if (new == root).all():
                return root
            root = new
    assert (simhash.link_near(points, home, 4) == least(near & (home[:, None] | home[None, :]))).all()
    df = spark.createDataFrame([(int(x),) for x in points.view(np.int64)], "bits long")
    found = {r["node"]: r["root"] for r in simhash.components(simhash.links(df, 4, shard=32)).collect()}
    groups = {}
    for bits, root in zip(points.view(np.int64).tolist(), least(near)):
        groups.setdefault(root, []).append(bits)
    assert all(found.get(b, b) == min(g) for g in groups.values() for b in g)


ITEMS = [(1, " ".join(f"w{i}" for i in range(12))), (2, "short item"), (2, "SHORT-item!"), (3, None), (4, " - "), (None, "a b c"), (5, "é 日本"),
         (6, " ".join(f"w{i}" for i in range(1, 11)))]


@pytest.mark.parametrize("chunk", [100_000, 2])
def test_contamination(spark, monkeypatch, chunk):
    monkeypatch.setattr(decontaminate, "CHUNK_WINDOWS", chunk)
    docs = cases.documents(spark).select("*").union(cases.documents(spark).limit(1).selectExpr(
        "100L", "'x, W0 w1 w2;w3 w4 w5 w6 w7 w8 w9 w10 y the Short-Item a b c'", "'s'", "1L", *[f"`{c}`" for c in cases.EXTRA]))
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = cases.pairs(docs)
    plain = cases.contaminated([t for _, t in found], [("" if i is None else str(i), t) for i, t in ITEMS])
    got = decontaminate.contamination(docs, items)
    assert cases.rows(got, "doc_id", "n_words", "n_hit", "items") == sorted(((i, *x) for (i, _), x in zip(found, plain)), key=repr)
    for r in got.where("doc_id = 100").collect():
        text = dict(found)[100].encode()
        assert set(r["items"]) == {"", "1", "2", "6"}
        assert {text[s["start"]:s["end"]].decode() for s in r["spans"] if s["last"] - s["first"] == 1} == {"Short-Item"}
        assert {" ".join(cases.bench_words(text[s["start"]:s["end"]].decode())) for s in r["spans"]} == {
            "a b c", "short item", *(" ".join(f"w{i}" for i in range(k, k + 10)) for k in (0, 1))}
    digests = {r["doc_id"]: r for r in decontaminate.contamination_digests(docs, items).where("doc_id > 9").collect()}
    for r in got.where("doc_id > 9").collect():
        d = digests[r["doc_id"]]
        assert (d["n_items"], d["items_sha256"], d["contaminated"]) == (len(r["items"]), hashlib.sha256(",".join(r["items"]).encode()).hexdigest(), r["n_hit"] > 0)
    kept = decontaminate.decontaminated(docs, items)
    assert kept.columns == docs.columns and kept.count() == sum(not x[1] for x in plain)
    assert decontaminate.contamination(docs, items.limit(0)).where("n_hit > 0").count() == 0
    assert decontaminate.contamination(docs.limit(0), items).count() == 0


def test_a_prompt_that_all_items_share(spark):
    """Items of a window are listed once per different list of windows, not once per document."""
    prompt = " ".join(f"p{i}" for i in range(10))
    items = spark.createDataFrame([(i, f"{prompt} own{i}") for i in range(300)], "item_id long, text string")
    docs = spark.createDataFrame([(i, f"x{i} {prompt} end") for i in range(500)] + [(999, f"{prompt} own7")], "doc_id long, text string")
    found, listed = decontaminate._found(docs, items, 10)
    assert listed.count() == 2 and found.count() == 501
    got = {r["doc_id"]: r for r in decontaminate.contamination_digests(docs, items).collect()}
    assert {r["n_items"] for r in got.values()} == {300} and {r["n_hit"] for i, r in got.items() if i < 500} == {10} and got[999]["n_hit"] == 11


def test_of_rows_that_differ_elsewhere_one_and_the_same_stays(spark):
    rows = [(1, "same text here now", k, {"k": k}) for k in "zyxw"] + [(2, "same text here now", "a", None)]
    frames = [spark.createDataFrame(rows, "doc_id long, text string, source string, m map<string, string>").repartition(n) for n in (1, 4, 7)]
    assert len({simhash.one_of_each(f).collect()[0]["source"] for f in frames}) == 1
