import math

import numpy as np
import pytest

from limnos.operators import isotopes as I
from limnos.operators import mixing as M
from limnos.operators import niche as N
from limnos.operators.ordination import _hull
from limnos.operators import trophic as T


def test_isotope_frame_rules(spark):
    rows = spark.createDataFrame([
        ("t1", "BUG", "W", 7, "1.0", "2.0"), ("t2", "CLAM", "W", 9, "ND", "2.0"), ("t3", None, "W", None, "1.0", "NaN"), ("t4", "PERI", "W", 5, "1", "1")],
        "TAXON string, GROUP string, WATER string, MONTH int, D13C string, D15N string")
    taxa = spark.createDataFrame([("t1", "fam", "ord"), ("t1", "fam", "ord")], "TAXON string, FAMILY string, ORDER string")
    got = {(r.community, r.GROUP, r.group_name, r.graph_id, r.iso1, r.iso2) for r in I.isotope_frame(rows, taxa).collect()}
    assert got == {("W.spring", "BUG", "fam", "ord", 1.0, 2.0), ("W.fall", "BIVALVE", "BIVALVE", "BIVALVE", None, 2.0),
                   ("W.NA", None, None, None, 1.0, None)}


def test_group_size_counts_before_missing(spark):
    rows = spark.createDataFrame([("c", "g", 1.0, 1.0)] * 3 + [("c", "g", None, 1.0)] + [("c", "h", 1.0, 1.0)] * 3,
                                 "community string, group_name string, iso1 double, iso2 double")
    got = I.min_group_size(rows).collect()
    assert len(got) == 3 and {r.group_name for r in got} == {"g"}


def test_lipid_and_replicates(spark):
    rows = spark.createDataFrame([(1, "ALGA", "10", 1.0, 4.0, 2.0), (1, "FISH", "10", 1.0, 4.0, 2.0), (1, None, "10", 1.0, 4.0, 2.0), (1, "FISH", "x", 2.0, 4.0, 2.0)],
                                 "ITEM_N int, CATEGORY string, D13C string, D15N double, PER_C double, PER_N double")
    fixed = I.lipid_correct(rows)
    values = [r.D13C for r in fixed.collect()]
    assert values[0] == 10.0 and values[1] == pytest.approx(8.66) and values[2] == pytest.approx(8.66) and values[3] is None
    r = I.replicate_summary(fixed, "ITEM_N").first()
    assert r.replicates == 4 and r.mean_C == pytest.approx((10 + 8.66 * 2) / 3)


def stats(spark, rows):
    names = "community string, group_name string, n long, mean_x double, mean_y double, var_x double, cov_xy double, var_y double"
    return spark.createDataFrame(rows, names)


def test_draws_match_inverse_wishart_mean(spark):
    s = stats(spark, [("c", "g", 12, 5.0, -2.0, 4.0, 1.5, 9.0)])
    d = N.niche_draws(s, ["community", "group_name"], 20000, block=5000).toPandas()
    r = 1.5 / 6
    scale, df = np.array([[12, 11 * r], [11 * r, 12]]), 2 + 11
    want = scale / (df - 3) * np.outer([2, 3], [2, 3])
    assert d["s_xx"].mean() == pytest.approx(want[0, 0], rel=0.03) and d["s_yy"].mean() == pytest.approx(want[1, 1], rel=0.03)
    assert d["s_xy"].mean() == pytest.approx(want[0, 1], rel=0.08)
    assert d["mu_x"].mean() == pytest.approx(5, abs=0.03) and d["mu_x"].var() == pytest.approx(want[0, 0] / 12, rel=0.05)
    assert len(d) == 20000 and d["draw"].nunique() == 20000


def test_draws_do_not_depend_on_partitions(spark):
    s = stats(spark, [(f"c{i}", "g", 10 + i, 0.0, 0.0, 1.0, 0.2, 2.0) for i in range(6)])
    a = N.niche_draws(s.repartition(1), ["community", "group_name"], 30, block=7).toPandas()
    b = N.niche_draws(s.repartition(5), ["community", "group_name"], 30, block=7).toPandas()
    keys = ["community", "draw"]
    assert a.sort_values(keys).reset_index(drop=True).equals(b.sort_values(keys).reset_index(drop=True))


def overlap(spark, one, two):
    cols = "community string, group_name string, draw int, mu_x double, mu_y double, s_xx double, s_xy double, s_yy double"
    df = spark.createDataFrame([("c", "a", 0, *one), ("c", "b", 0, *two)], cols)
    return N.ellipse_overlap(df).first().overlap


def test_overlap_known_values(spark):
    unit = (0.0, 0.0, 1.0, 0.0, 1.0)
    assert overlap(spark, (1.0, 2.0, 2.0, 0.7, 1.0), (1.0, 2.0, 2.0, 0.7, 1.0)) == pytest.approx(1, abs=1e-9)
    assert overlap(spark, unit, (50.0, 0.0, 1.0, 0.0, 1.0)) == 0
    assert overlap(spark, unit, (0.0, 0.0, 4.0, 0.0, 4.0)) == pytest.approx(0.25, abs=1e-9)
    r = math.sqrt(-2 * math.log(0.05))  # two discs of this radius, one radius apart
    lens = 2 * r * r * math.acos(0.5) - r / 2 * math.sqrt(4 * r * r - r * r)
    assert overlap(spark, unit, (r, 0.0, 1.0, 0.0, 1.0)) == pytest.approx(lens / (2 * math.pi * r * r - lens), abs=1e-12)


def test_overlap_of_many_ellipses():
    """Against rays from the middle of the disc; none, two and four common points of the borders, circles, nested ones."""
    rng = np.random.default_rng(1)
    n, k = 400, 20_000
    l11, l22, l21, c = np.exp(rng.normal(0, 1, n)), np.exp(rng.normal(0, 1, n)), rng.normal(0, 1, n), rng.normal(0, 1.2, (n, 2))
    l21[:60], l22[:60], c[60:90] = 0, l11[:60], 0
    s11, s12, s22, det = l11 ** 2, l11 * l21, l21 ** 2 + l22 ** 2, (l11 * l22) ** 2
    m = np.column_stack([s22, -s12, s11]) / det[:, None]
    turn = 2 * np.pi * (np.arange(k) + 0.5) / k
    u = np.column_stack([np.cos(turn) ** 2, 2 * np.cos(turn) * np.sin(turn), np.sin(turn) ** 2])
    p = np.column_stack([m[:, 0] * c[:, 0] + m[:, 1] * c[:, 1], m[:, 1] * c[:, 0] + m[:, 2] * c[:, 1]])
    a, b, e = m @ u.T, p @ np.stack([np.cos(turn), np.sin(turn)]), ((p * c).sum(axis=1) - 1)[:, None]
    root = b * b - a * e
    gap = np.sqrt(np.maximum(root, 0))
    want = np.where(root > 0, np.clip((b + gap) / a, 0, 1) ** 2 - np.clip((b - gap) / a, 0, 1) ** 2, 0).sum(axis=1) * np.pi / k
    got = N.disc_share(m, np.column_stack([l11, l21, l22]), c)
    assert got == pytest.approx(want, abs=5e-5) and np.median(np.abs(got - want)) < 1e-7


def test_overlap_against_sampling(spark):
    a, b = (0.0, 0.0, 2.0, 0.8, 1.0), (1.0, 1.0, 1.0, -0.4, 3.0)
    rng = np.random.default_rng(0)
    p = rng.uniform(-8, 8, (400000, 2))
    q = -2 * math.log(0.05)

    def inside(e):
        d = p - np.array(e[:2])
        return np.einsum("ij,jk,ik->i", d, np.linalg.inv([[e[2], e[3]], [e[3], e[4]]]), d) <= q
    x, y = inside(a), inside(b)
    assert overlap(spark, a, b) == pytest.approx((x & y).sum() / (x | y).sum(), abs=0.01)


def test_layman_square(spark):
    pts = spark.createDataFrame([("c", 0.0, 0.0), ("c", 2.0, 0.0), ("c", 0.0, 1.0), ("c", 2.0, 1.0), ("one", 3.0, 3.0)], "k string, iso1 double, iso2 double")
    got = {r.k: r for r in N.layman(pts, ["k"]).collect()}
    r = got["c"]
    assert (r.dX_range, r.dY_range, r.TA, r.NND, r.SDNND) == pytest.approx((2, 1, 2, 1, 0)) and r.CD == pytest.approx(math.hypot(1, 0.5))
    assert got["one"].NND is None and got["one"].TA == 0


def test_mean_of_means(spark):
    rows = spark.createDataFrame([("c1", "k", 0, 1.0), ("c1", "k", 0, 3.0), ("c2", "k", 0, 10.0), ("c3", None, 0, 99.0)],
                                 "community string, cluster string, draw int, area double")
    assert [r.area for r in N.area_by_cluster(rows, "community", "cluster").collect()] == [6.0]


def test_one_season_is_dropped(spark):
    rows = spark.createDataFrame([("g", "W", "fall", d, 3.0 + d) for d in range(5)] + [("g", "W", "spring", d, 1.0) for d in range(5)]
                                 + [("h", "W", "fall", d, 1.0) for d in range(5)], "g string, w string, season string, draw int, area double")
    r = N.seasonal_area_shift(rows, "g", "w", "season").collect()
    assert len(r) == 1 and r[0].mid == 4.0 and r[0].sig


def test_contrast_intervals(spark):
    rng = np.random.default_rng(1)
    rows = [("m", c, d, float(v)) for c, shift in (("1", 0.0), ("2", 3.0)) for d, v in enumerate(rng.normal(shift, 1, 500))]
    df = spark.createDataFrame(rows, "metric string, cluster string, draw int, value double")
    for kind in ("eti", "hdi"):
        r = N.posterior_contrasts(df, ["1", "2"], interval=kind).first()
        assert r.PD > 97 and 0 <= r.rope_prop < 5


def test_mixing_recovers_shares(spark):
    rng = np.random.default_rng(5)
    mu = {"PERI": (0.0, 0.0), "ZOOP": (10.0, 0.0), "LEAF": (5.0, 10.0)}
    truth = {"PERI": 0.6, "ZOOP": 0.25, "LEAF": 0.15}
    m = np.sum([np.array(mu[s]) * truth[s] for s in mu], axis=0)
    rows = [("c", "t", float(a), float(b)) for a, b in rng.normal(m, 0.5, (80, 2))]
    mix = spark.createDataFrame(rows, "community string, group_name string, iso1 double, iso2 double")
    src = spark.createDataFrame([("c", s, v[0], 0.3, v[1], 0.3) for s, v in mu.items()] + [("d", "PERI", 0.0, 1.0, 0.0, 1.0)],
                                "community string, source string, mean_c double, sd_c double, mean_n double, sd_n double")
    got = {r.source: r for r in M.mixing_proportions(mix, src).collect()}
    assert sum(r.mean for r in got.values()) == pytest.approx(1)
    for s, share in truth.items():
        assert got[s].mean == pytest.approx(share, abs=0.05) and got[s].low < share < got[s].high and got[s].points > 50


def test_trophic_two_and_three_sources(spark):
    mix = spark.createDataFrame([("c", "G", "three", 1.0, 10.0), ("c", "G", "two", 1.0, 10.0)], "community string, GROUP string, FAMILY string, iso1 double, iso2 double")
    shares = spark.createDataFrame([("c", "three", "PERI", 0.5), ("c", "three", "ZOOP", 0.3), ("c", "three", "LEAF", 0.2), ("c", "two", "ZOOP", 0.6), ("c", "two", "LEAF", 0.4)],
                                   "community string, group_name string, source string, mean double")
    src = spark.createDataFrame([("c", "PERI", 3.0), ("c", "ZOOP", 5.0), ("c", "LEAF", 1.0)], "community string, source string, mean_n double")
    got = {r.FAMILY: r for r in T.trophic_position(mix, shares, src).collect()}
    assert got["three"].trophic_position_weighted == pytest.approx((10 - (1.5 + 1.5 + 0.2)) / 3.14 + 0.6 + 0.5 + 0.2)
    assert got["three"].trophic_position == pytest.approx(7 / 3.14 + 1)
    assert got["two"].trophic_position_weighted == pytest.approx((10 - (3 + 0.4)) / 3.14 + 1.2 + 0.4)
    assert got["two"].trophic_position == pytest.approx(9 / 3.14 + 1)


def test_complete_sources(spark):
    shares = spark.createDataFrame([("a", "t", s, m) for s, m in (("PERI", .2), ("ZOOP", .3), ("LEAF", .5))] + [("b", "t", "PERI", 1.0)],
                                   "community string, group_name string, source string, mean double")
    table = M.source_share_wide(M.complete_sources(shares)).collect()
    assert len(table) == 1 and table[0].LEAF == pytest.approx(50)


def test_hulls_of_many_lists():
    rng = np.random.default_rng(2)
    x, y = rng.integers(0, 4, (300, 9)).astype(float), rng.integers(0, 4, (300, 9)).astype(float)  # ties and points in a line
    x[:50], y[:50] = rng.normal(size=(50, 9)), rng.normal(size=(50, 9))
    got = N.hull_areas(x, y)
    for a, b, area in zip(x, y, got):
        h = _hull(a, b)
        a, b = a[h], b[h]
        want = 0.5 * abs(np.dot(a, np.roll(b, -1)) - np.dot(b, np.roll(a, -1))) if len(h) > 2 else 0
        assert area == pytest.approx(want, abs=1e-9)
