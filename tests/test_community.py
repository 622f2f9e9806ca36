import itertools

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from limnos.operators import community as K
from limnos.operators import dissimilarity as S
from limnos.operators import ordination as O
from limnos.operators import permanova as A
from limnos.operators import permutations as P


def random_presence(n=24, p=9, seed=0, groups=("a", "b", "c")):
    rng = np.random.default_rng(seed)
    x = rng.random((n, p)) < rng.uniform(0.2, 0.7, p)
    x[np.arange(n), rng.integers(0, p, n)] = True
    return x, [groups[i % len(groups)] for i in range(n)]


def as_frame(spark, x, labels):
    rows = [(i, labels[i], f"t{j}") for i, j in zip(*np.nonzero(x))]
    return spark.createDataFrame([(int(i), g, t) for i, g, t in rows], "site int, cluster string, taxon string")


def bray(x):
    n = x.sum(1)
    return 1 - 2 * (x.astype(int) @ x.T.astype(int)) / (n[:, None] + n[None, :])


def test_presence_table_rules(spark):
    rows = spark.createDataFrame([
        ("FALL", "S 1", "DTL", "x"), ("FALL", "S 1", "DTL", "x"), ("FALL", "2", "DTL", "y"), ("FALL", "1", "LML", "z"),
        ("FALL", "Not listed", "ABC", None), ("FALL", "1", "ABC", "degraded"), ("SPRING", "1", "ABC", "q")],
        "MONTH string, SITE_N string, WATER string, FAMILY string")
    got = {tuple(r) for r in K.presence_table(rows, ["WATER", "SITE_N"], "FALL", skip_sites=K.TWO_SEASON_SITES,
                                              skip_lakes=K.TWO_SEASON_LAKES_OUT).collect()}
    assert got == {("DTL", "S1", "x"), ("ABC", "NotListed", None)}


def test_prune_and_frequency(spark):
    df = spark.createDataFrame([(1, "all"), (2, "all"), (1, "one")], "site int, taxon string")
    assert {r.taxon for r in K.prune_taxa(df, ["site"], "taxon").collect()} == {"one"}


def test_occurrence_filter_order(spark):
    # taxon r is in one site only; without it site 1 has two taxa left
    rows = [(s, t) for s in range(5) for t in ("a", "b")] + [(0, "r"), (1, "c"), (2, "c"), (3, "c")]
    df = spark.createDataFrame(rows, "site int, taxon string")
    got = K.occurrence_filter(df, "site", "taxon", 1, 3)
    assert {r.site for r in got.collect()} == {1, 2, 3}


def test_accumulation_against_enumeration(spark):
    x, _ = random_presence(6, 5, 3)
    df = as_frame(spark, x, ["k"] * 6).withColumnRenamed("cluster", "key")
    got = {r.sites: (r.richness, r.sd) for r in K.accumulation(df, ["key"], "site", "taxon").collect()}
    x = x[:, x.any(0)]
    n, f = len(x), x.sum(0)
    corr = np.nan_to_num(np.corrcoef(x.T.astype(float)))
    from math import comb
    for m in range(1, n + 1):
        mean = np.mean([x[list(c)].any(0).sum() for c in itertools.combinations(range(n), m)])
        q = np.array([comb(n - k, m) / comb(n, m) for k in f])
        v = q * (1 - q)
        sd = np.sqrt(max(v.sum() + sum(2 * corr[i, j] * np.sqrt(v[i] * v[j]) for i in range(len(f)) for j in range(i)), 0))
        assert got[m][0] == pytest.approx(mean) and got[m][1] == pytest.approx(sd, abs=1e-6)
    assert got[n][0] == pytest.approx(len(f))


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_permanova_equals_pairs(spark, seed):
    x, labels = random_presence(seed=seed)
    sets = S.site_sets(as_frame(spark, x, labels), ["site", "cluster"], "taxon")
    got = S.permanova(sets, "cluster").first()
    d2 = bray(x) ** 2
    total = np.triu(d2, 1).sum() / len(x)
    g = np.array(labels)
    within = sum(np.triu(d2[np.ix_(g == c, g == c)], 1).sum() / (g == c).sum() for c in set(labels))
    assert got.ss_total == pytest.approx(total) and got.ss_within == pytest.approx(within)
    assert got.f == pytest.approx(((total - within) / 2) / (within / (len(x) - 3))) and 0 <= got.r2 <= 1


def test_permanova_terms_equals_projection(spark):
    x, labels = random_presence(30, 8, 5)
    season = np.array(["s", "f"])[np.arange(30) // 3 % 2]
    df = as_frame(spark, x, labels)
    seasons = spark.createDataFrame([(i, str(season[i])) for i in range(30)], "site int, season string")
    sets = S.site_sets(df.join(seasons, "site"), ["site", "cluster", "season"], "taxon")
    got = {r.term: r for r in A.permanova_terms(sets, ["cluster", "season", "cluster:season"]).collect()}
    c = np.eye(30) - 1 / 30
    g = -0.5 * c @ bray(x) ** 2 @ c
    a = (np.array(labels)[:, None] == np.unique(labels)).astype(float)
    b = (season[:, None] == np.unique(season)).astype(float)
    designs = [np.ones((30, 1)), a, b, np.einsum("ij,ik->ijk", a, b).reshape(30, -1)]
    last = 0.0
    for i, term in [(2, "cluster"), (3, "season"), (4, "cluster:season")]:
        m = np.hstack(designs[:i])
        h = m @ np.linalg.pinv(m)
        ss = np.trace(h @ g)
        assert got[term].ss == pytest.approx(ss - last)
        last = ss
    assert got["residual"].ss == pytest.approx(np.trace(g) - last)


def test_permanova_from_jaccard_pairs(spark):
    x, labels = random_presence(12, 7, 4)
    n = x.sum(1)
    s = x.astype(int) @ x.T.astype(int)
    d = 1 - s / (n[:, None] + n[None, :] - s)
    pairs = spark.createDataFrame([(i, j, float(d[i, j])) for i in range(12) for j in range(i + 1, 12)], "i int, j int, d double")
    lab = spark.createDataFrame(list(enumerate(labels)), "site int, cluster string")
    got = S.permanova_pairs(pairs, lab, "site", "cluster", "i", "j", "d").first()
    g = np.array(labels)
    within = sum(np.triu(d[np.ix_(g == c, g == c)] ** 2, 1).sum() / (g == c).sum() for c in set(labels))
    assert got.ss_within == pytest.approx(within) and got.ss_total == pytest.approx(np.triu(d ** 2, 1).sum() / 12)


def test_permanova_p_of_pairs(spark):
    x, labels = random_presence(14, 7, 4)
    d = bray(x)
    pairs = spark.createDataFrame([(i, j, float(d[i, j])) for i in range(14) for j in range(i + 1, 14)], "i int, j int, d double")
    lab = spark.createDataFrame(list(enumerate(labels)), "site int, cluster string")
    moved = [(p, i, labels[(i + 3 * p) % 14]) for p in range(1, 13) for i in range(14)]
    got = S.permanova_pairs(pairs, lab, "site", "cluster", "i", "j", "d", spark.createDataFrame(moved, "perm int, site int, cluster string")).first()

    def ratio(g):
        g = np.array(g)
        within = sum(np.triu(d[np.ix_(g == c, g == c)] ** 2, 1).sum() / (g == c).sum() for c in set(labels))
        total = np.triu(d ** 2, 1).sum() / 14
        return ((total - within) / (len(set(labels)) - 1)) / (within / (14 - len(set(labels))))
    seen = ratio(labels)
    more = sum(ratio([labels[(i + 3 * p) % 14] for i in range(14)]) >= seen - 1e-12 for p in range(1, 13))
    assert got.f == pytest.approx(seen) and got.p == pytest.approx((1 + more) / 13)


def test_missing_taxa_are_a_taxon_and_names_may_clash(spark):
    x, labels = random_presence(18, 6, 9)
    rows = [(i, labels[i], None if t == 2 else f"t{t}") for i in range(18) for t in range(6) if x[i, t]]
    plain = as_frame(spark, x, labels)
    df = spark.createDataFrame(rows, "s int, c string, n string").withColumn("t", F.lit("x"))
    want = S.permanova(S.site_sets(plain, ["site", "cluster"], "taxon"), "cluster").first()
    sets = S.site_sets(df, ["s", "c"], "n").withColumnRenamed("n", "k").withColumnRenamed("k", "n")
    assert S.permanova(sets, "c").first().f == pytest.approx(want.f)
    terms = {r.term: r.ss for r in A.permanova_terms(sets, ["c"]).collect()}
    assert terms["c"] == pytest.approx(want.ss_total - want.ss_within)
    a = {(r.cluster1, r.cluster2, r.taxon or "t2"): r.average for r in S.simper(plain, "site", "taxon", "cluster").collect()}
    b = {(r.cluster1, r.cluster2, r.n or "t2"): r.average for r in S.simper(df, "s", "n", "c").collect()}
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k]) for k in a)
    marks = S.choose_landmarks(S.site_sets(df, ["s"], "n"), "s", 18)
    far = {(r.s, r.landmark): r.d for r in S.landmark_dissimilarity(df, marks, "s", "n", "bray").collect()}
    d = bray(x)
    assert all(far[k] == pytest.approx(d[k]) for k in far)


def test_permanova_of_many_groups(spark):
    rows = [(i, f"g{i}", t) for i in range(6000) for t in ("a", "b" if i % 2 else "c")]
    sets = S.site_sets(spark.createDataFrame(rows, "site int, g string, taxon string"), ["site", "g"], "taxon")
    assert S.permanova(sets, "g").first().groups == 6000


def test_simper_equals_pairs(spark):
    x, labels = random_presence(21, 7, 6)
    got = {(r.cluster1, r.cluster2, r.taxon): r for r in S.simper(as_frame(spark, x, labels), "site", "taxon", "cluster").collect()}
    g, n = np.array(labels), x.sum(1)
    for a, b in itertools.combinations(sorted(set(labels)), 2):
        for t in range(7):
            want = np.mean([(x[i, t] != x[j, t]) / (n[i] + n[j]) for i in np.nonzero(g == a)[0] for j in np.nonzero(g == b)[0]])
            assert got[a, b, f"t{t}"].average == pytest.approx(want)
        assert max(r.cusum for k, r in got.items() if k[:2] == (a, b)) == pytest.approx(1.0)


def test_landmark_distances(spark):
    x, labels = random_presence(15, 6, 8)
    df = as_frame(spark, x, labels).select("site", "taxon")
    marks = S.choose_landmarks(S.site_sets(df, ["site"], "taxon"), "site", 5)
    n, s = x.sum(1), x.astype(int) @ x.T.astype(int)
    rows = S.landmark_dissimilarity(df, marks, "site", "taxon").collect()
    assert len(rows) == 15 * 5
    for r in rows:
        i, j = r.site, r.landmark
        assert r.d == pytest.approx(1 - s[i, j] / (n[i] + n[j] - s[i, j])) and 0 <= r.d <= 1


def test_ordination_orders_distances(spark):
    rng = np.random.default_rng(2)
    centre = rng.random(60)
    taxa = np.linspace(0, 1, 30)
    x = np.abs(centre[:, None] - taxa[None, :]) < 0.5  # one gradient: sites near each other share taxa
    df = as_frame(spark, x, ["g"] * 60)
    sites, stress = O.ordinate(df, "site", "taxon", 2, 20, 2)
    assert 0 <= stress < 0.2
    rows = {r.site: np.array(r.x) for r in sites.collect()}
    i = int(np.argmin(centre))
    far = [np.linalg.norm(rows[j] - rows[i]) for j in range(60)]
    assert np.corrcoef(np.argsort(np.argsort(far)), np.argsort(np.argsort(np.abs(centre - centre[i]))))[0, 1] > 0.9


def test_hull_and_clusters(spark):
    rng = np.random.default_rng(3)
    p = np.vstack([rng.normal(0, 1, (200, 2)), rng.normal(9, 1, (200, 2))])
    df = spark.createDataFrame([(i, int(i >= 200), float(a), float(b)) for i, (a, b) in enumerate(p)], "site int, g int, x double, y double").repartition(4)
    hull = O.convex_hull(df, "g", "x", "y").toPandas().sort_values(["g", "vertex"])
    for g, part in hull.groupby("g"):
        h = part[["x", "y"]].to_numpy()
        step = np.roll(h, -1, 0) - h
        for q in p[200 * g: 200 * g + 200]:
            assert (step[:, 0] * (q[1] - h[:, 1]) - step[:, 1] * (q[0] - h[:, 0]) >= -1e-9).all()
    got = O.cluster_sites(df, ["x", "y"], 2, 2).toPandas()
    assert got.groupby("g")["cluster"].nunique().max() == 1 and set(got["cluster"]) == {1, 2}
    wss = [r.wss for r in O.elbow(df, ["x", "y"], [1, 2, 3], 2).orderBy("k").collect()]
    assert wss[0] > wss[1] > wss[2]


def test_labels_keep_sizes_in_blocks(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2], i % 5) for i in range(50)], "site int, g string, b int")
    rows, how = P.with_ranks(df, "site", 3, 7, ["b"])
    rows, labels = P.label_codes(rows, F.col("g"), ["b"])
    assert labels == ["a", "b"]
    batch = pa.Table.from_pandas(rows.toPandas()).combine_chunks()
    ranks = pa.array(batch["__ranks"].to_pylist(), pa.struct([("at", pa.int64()), ("size", pa.int64()), ("block", pa.int64())]))
    codes = P.codes_of(how.of(ranks), batch["__code"].combine_chunks(), batch["__stops"].combine_chunks())
    assert codes.shape == (50, 4) and [labels[c] for c in codes[:, 0]] == batch["g"].to_pylist()
    for b in range(5):
        assert (codes[np.array(batch["b"].to_pylist()) == b].sum(axis=0) == 5).all()


def test_repeated_values_move_with_their_site(spark):
    rng = np.random.default_rng(6)
    coords = spark.createDataFrame([(i, float(rng.normal()) + 1e6, float(rng.normal())) for i in range(20)], "site int, x double, y double")
    env = spark.createDataFrame([(i, m, float(i * k % 7) + 1e5 if (i, m) != (3, "v") else None) for i in range(20) for m in "uv" for k in (1, 2) if m == "v" or k == 1 or i % 2],
                                "site int, metric string, value double")
    same = spark.createDataFrame([(p, i, i) for p in range(5) for i in range(20)], "perm int, site int, rank int")
    got = {r.metric: r for r in O.envfit(coords, env, "site", "x", "y", ranks=same).collect()}
    assert {r.p for r in got.values()} == {1.0}
    turned = spark.createDataFrame([(p, i, (i + 3 * p) % 20) for p in range(7) for i in range(20)], "perm int, site int, rank int")
    place = {r.site: (r.x, r.y) for r in coords.collect()}
    rows = [tuple(r) for r in env.collect() if r.value is not None]

    def r2(metric, shift):
        z = np.array([[*place[(s + shift) % 20], v] for s, m, v in rows if m == metric])
        z -= z.mean(axis=0)
        a = np.column_stack([z[:, :2]])
        return 1 - ((z[:, 2] - a @ np.linalg.lstsq(a, z[:, 2], rcond=None)[0]) ** 2).sum() / (z[:, 2] ** 2).sum()
    got = {r.metric: r for r in O.envfit(coords, env, "site", "x", "y", ranks=turned).collect()}
    for m in "uv":
        seen = r2(m, 0)
        assert got[m].r2 == pytest.approx(seen, abs=1e-6) and got[m].p == (1 + sum(r2(m, 3 * p) >= seen - 1e-12 for p in range(1, 7))) / 7


def test_a_site_without_a_permutation_is_an_error(spark):
    coords = spark.createDataFrame([(i, float(i), float(i * i)) for i in range(6)], "site int, x double, y double")
    env = spark.createDataFrame([(i, "v", float(i % 4)) for i in range(6)], "site int, metric string, value double")
    ranks = [(p, i, (i + p) % 6) for p in range(3) for i in range(6)]
    for lost in ((2, 5, 1), (0, 5, 5)):
        with pytest.raises(Exception, match="lacks a rank|numbered"):
            O.envfit(coords, env, "site", "x", "y", ranks=spark.createDataFrame([r for r in ranks if r != lost], "perm int, site int, rank int")).collect()
    assert O.envfit(coords, env, "site", "x", "y", ranks=spark.createDataFrame(ranks, "perm int, site int, rank int")).first().p <= 1


def test_permutation_p_finds_a_difference(spark):
    rng = np.random.default_rng(4)
    rows = [(i, "ab"[i % 2], float(rng.normal(3 * (i % 2))), float(rng.normal())) for i in range(60)]
    df = spark.createDataFrame(rows, "site int, g string, x double, y double")
    r = O.permanova_coordinates(df, "site", ["x", "y"], "g", 49).first()
    assert r.p == pytest.approx(1 / 50) and r.f > 10
    env = df.select("site", F.lit("x2").alias("metric"), (F.col("x") * 2).alias("value"))
    fit = O.envfit(df, env, "site", "x", "y", perms=19).first()
    table = O.envfit_table(O.envfit(df, env, "site", "x", "y", perms=19), labels={"x2": "Twice"}).first()
    assert table.metric == "Twice" and table.r2 == 1.0
    assert fit.r2 == pytest.approx(1) and (abs(fit.a1), abs(fit.a2)) == pytest.approx((1, 0), abs=1e-9) and fit.p == pytest.approx(1 / 20)


def test_monotone_curve_equals_the_min_max_form():
    rng = np.random.default_rng(1)
    sums = np.zeros((O.STEPS + 1, 3))
    at = np.sort(rng.choice(O.STEPS, 40, replace=False))
    gaps = [np.abs(rng.normal(a / 3000, 1, rng.integers(1, 6))) for a in at]
    sums[at] = [(len(g), g.sum(), (g ** 2).sum()) for g in gaps]
    places, fit, stress = O.monotone_curve(sums)
    w, t = sums[at, 0], sums[at, 1]
    want = [max(min(t[j:k + 1].sum() / w[j:k + 1].sum() for k in range(i, 40)) for j in range(i + 1)) for i in range(40)]
    assert places.tolist() == at.tolist() and fit == pytest.approx(want)
    off = sum(((g - f) ** 2).sum() for g, f in zip(gaps, want))
    assert stress == pytest.approx(np.sqrt(off / sum((g ** 2).sum() for g in gaps)))


def test_all_numbers_of_axes_at_once(spark):
    x, labels = random_presence(40, 12, 13)
    df = as_frame(spark, x, labels)
    both = {r.k: r.landmark_stress for r in O.stress_by_k(df, "site", "taxon", [1, 2, 3], 15, 2).collect()}
    alone = {k: O.ordinate(df, "site", "taxon", k, 15, 2) for k in (1, 2, 3)}
    assert both == pytest.approx({k: s for k, (_, s) in alone.items()}) and both[3] < both[1]
    # the places that come back have the stress that is told
    sites = {r.site: np.array(r.x) for r in alone[2][0].collect()}
    d = {r.site: r.d for r in alone[2][0].collect()}
    marks = [min((s for s in sites if d[s][j] == 0), key=lambda s: s) for j in range(15)]
    pairs = spark.createDataFrame([(s, m, float(d[s][j])) for s in sites for j, m in enumerate(marks)], "site int, landmark int, d double")
    coords = spark.createDataFrame([(s, *map(float, v)) for s, v in sites.items()], "site int, x double, y double")
    assert O.landmark_stress(pairs, coords, "site", ["x", "y"]).first().landmark_stress == pytest.approx(both[2])
