"""PERMANOVA over all pairs: terms and permutations against matrices of distances."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from limnos.operators import dissimilarity as S
from limnos.operators import permanova as A
from limnos.operators import permutations as P


def random_presence(n, p, seed):
    rng = np.random.default_rng(seed)
    x = rng.random((n, p)) < rng.uniform(0.2, 0.7, p)
    x[np.arange(n), rng.integers(0, p, n)] = True
    x[n // 2:n // 2 + 3] = x[0]  # sites with one set
    return x


def site_sets(spark, x, **labels):
    rows = [(int(i), f"t{j}") for i, j in zip(*np.nonzero(x))]
    names = spark.createDataFrame([(i, *[str(v[i]) for v in labels.values()]) for i in range(len(x))], "site int, " + ", ".join(f"{c} string" for c in labels))
    df = spark.createDataFrame(rows, "site int, taxon string").join(names, "site")
    return S.site_sets(df, ["site", *labels], "taxon")


def distances(x, method):
    n, s = x.sum(1), x.astype(int) @ x.T.astype(int)
    both = n[:, None] + n[None, :]
    return 1 - 2 * s / both if method == "bray" else 1 - s / (both - s)


def sequential(d, designs):
    """Sums of squares of each design after those before it, and degrees of freedom, by projections."""
    n = len(d)
    c = np.eye(n) - 1 / n
    g = -0.5 * c @ d ** 2 @ c
    out, last, rank, m = [], 0.0, 1, np.ones((n, 1))
    for design in designs:
        m = np.hstack([m, design])
        h = m @ np.linalg.pinv(m)
        now, k = np.trace(h @ g), np.linalg.matrix_rank(m)
        out.append((now - last, k - rank))
        last, rank = now, k
    return out, np.trace(g)


def one_hot(values):
    return (np.array(values)[:, None] == np.unique(values)).astype(float)


def f_ratios(d, designs):
    out, total = sequential(d, designs)
    residual, df = total - sum(ss for ss, _ in out), len(d) - 1 - sum(k for _, k in out)
    return np.array([ss / k / (residual / df) for ss, k in out])


@pytest.mark.parametrize("method, most", [("bray", 0), ("bray", 32_768), ("jaccard", 32_768)])
@pytest.mark.parametrize("block", [4, 1024])
def test_terms_with_many_levels_first(spark, monkeypatch, method, most, block):
    monkeypatch.setattr(A, "GRID_SETS", most)
    monkeypatch.setattr(A, "SET_BLOCK", block)
    monkeypatch.setattr(A.set_grid, "__defaults__", (block,))
    x = random_presence(32, 8, 5)
    water, cluster, season = np.arange(32) // 2, np.arange(32) // 2 % 3, np.arange(32) % 2
    got = {r.term: r for r in A.permanova_terms(site_sets(spark, x, water=water, cluster=cluster, season=season), ["water", "cluster", "season"], method).collect()}
    out, total = sequential(distances(x, method), [one_hot(water), one_hot(cluster), one_hot(season)])
    for term, (ss, k) in zip(["water", "cluster", "season"], out):
        assert got[term].ss == pytest.approx(ss, abs=1e-9) and got[term].df == k
    assert got["residual"].ss == pytest.approx(total - sum(ss for ss, _ in out)) and got["cluster"].f is None


@pytest.mark.parametrize("method, most", [("bray", 0), ("bray", 32_768), ("jaccard", 32_768)])
@pytest.mark.parametrize("blocks", [[], ["block"]])
def test_p_of_given_permutations(spark, monkeypatch, method, most, blocks):
    monkeypatch.setattr(A, "GRID_SETS", most)
    monkeypatch.setattr(A, "SUM_BYTES", 1)
    monkeypatch.setattr(A, "ENTRIES", 40)
    monkeypatch.setattr(A, "SET_MEMBERS", 2)
    n = 30
    x, cluster, season, block = random_presence(n, 7, 2), np.arange(n) % 3, np.arange(n) // 3 % 2, np.arange(n) // 10
    part = block if blocks else np.zeros(n, int)
    ranks, orders = [], []
    rng = np.random.default_rng(1)
    for p in range(1, 20):
        move = np.empty(n, int)
        for b in np.unique(part):
            inside = np.flatnonzero(part == b)
            rank = rng.permutation(len(inside))
            ranks += [(p, int(i), int(r)) for i, r in zip(inside, rank)]
            by_label = sorted(inside, key=lambda i: (str(cluster[i]), str(season[i])))
            move[inside] = [by_label[r] for r in rank]
        orders.append(move)
    sets = site_sets(spark, x, cluster=cluster, season=season, block=block)
    given = spark.createDataFrame(ranks, "perm int, site int, rank int")
    terms = ["cluster", "season", "cluster:season"]
    got = {r.term: r for r in A.permanova_test(sets, "site", terms, blocks=blocks, ranks=given, method=method).collect()}
    both = np.array([f"{a}{b}" for a, b in zip(cluster, season)])
    designs = [one_hot(cluster), one_hot(season), one_hot(both)]
    d = distances(x, method)
    seen = f_ratios(d, designs)
    moved = np.array([f_ratios(d, [m[o] for m in designs]) for o in orders])
    for i, term in enumerate(terms):
        assert got[term].f == pytest.approx(seen[i])
        assert got[term].p == pytest.approx((1 + (moved[:, i] >= seen[i] - 1e-12).sum()) / 20)
    plain = {r.term: r.ss for r in A.permanova_terms(sets, terms, method).collect()}
    assert all(plain[t] == pytest.approx(got[t].ss) for t in plain)


def test_drawn_permutations_find_a_difference(spark):
    x = np.zeros((60, 12), bool)
    x[:30, :6] = x[30:, 6:] = True
    x[np.arange(60), np.random.default_rng(0).integers(0, 12, 60)] = True
    sets = site_sets(spark, x, g=np.arange(60) // 30, h=np.arange(60) % 2)
    for method in ("bray", "jaccard"):
        got = {r.term: r for r in A.permanova_test(sets, "site", ["g", "h"], 99, method=method).collect()}
        assert got["g"].p == pytest.approx(0.01) and got["h"].p > 0.05


def test_a_site_without_rank_is_an_error(spark):
    sets = site_sets(spark, random_presence(10, 5, 0), g=np.arange(10) % 2)
    ranks = spark.createDataFrame([(1, i, i) for i in range(9)], "perm int, site int, rank int")
    with pytest.raises(Exception, match="lacks a rank"):
        A.permanova_test(sets, "site", ["g"], ranks=ranks).collect()


@pytest.mark.parametrize("n", [1, 2, 3, 7, 10, 64, 1000, 99_991])
def test_ranks_are_a_bijection(n):
    for key in np.random.default_rng(n).integers(0, 2 ** 63, 3):
        assert sorted(P.bijection(np.arange(n), np.full(n, n), key).tolist()) == list(range(n))


@pytest.mark.parametrize("n", [2, 3, 4, 5])
def test_all_orders_are_as_likely(n):
    import itertools
    from collections import Counter
    keys = np.random.default_rng(n).integers(0, 2 ** 63, 24_000)[:, None]
    seen = Counter(map(tuple, P.bijection(np.arange(n)[None, :], np.full((1, n), n), keys).tolist()))
    orders = list(itertools.permutations(range(n)))
    expected = 24_000 / len(orders)
    assert sum((seen[o] - expected) ** 2 / expected for o in orders) / (len(orders) - 1) < 1.9 + 4 / len(orders)


def test_numbers_and_ranks_by_block(spark):
    df = spark.range(200).select(F.col("id").alias("site"), (F.col("id") % 7).alias("b"))
    got = P.numbered(df.repartition(9), ["site"], ["b"]).collect()
    for b in range(7):
        own = sorted((r for r in got if r["b"] == b), key=lambda r: r["site"])
        assert [r["at"] for r in own] == list(range(len(own))) and {r["size"] for r in own} == {len(own)}
    a = {(r["b"], r["site"]): r["ranks"] for r in P.permuted_ranks(df.repartition(3), "site", 5, 3, ["b"]).collect()}
    for b in range(7):
        for p in range(5):
            own = [v[p] for (k, _), v in a.items() if k == b]
            assert sorted(own) == list(range(len(own)))
    assert a == {(r["b"], r["site"]): r["ranks"] for r in P.permuted_ranks(df.repartition(8), "site", 5, 3, ["b"]).collect()}
    assert a != {(r["b"], r["site"]): r["ranks"] for r in P.permuted_ranks(df, "site", 5, 4, ["b"]).collect()}
