"""Registered queries on isotopes, niches, mixing and trophic position."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from limnos.functions import columns as C
from limnos.operators import isotopes as I
from limnos.operators import mixing as M
from limnos.operators import niche as N
from limnos.operators import trophic as T
from limnos.operators.reshape import add_share, natural_join
from limnos.plans.registry import registry
from limnos.session import checkpointed
from limnos.sources import domain as D

QUERIES, ORACLE, query = registry()

_NICHE_OUT = "('LEAF', 'PERI', 'INSECT', 'ZOOP', 'CRAY', 'SIL')"
_MIX_OUT = "('LEAF', 'PERI', 'ZOOP', 'FISH')"


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def single(df: DataFrame, *columns: str) -> DataFrame:
    """Values at single precision, so that the order of a sum cannot show."""
    return df.withColumns({c: F.col(c).cast("float").cast("double") for c in columns})


def mixtures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.isotope_frame(D.isotope_rows(spark, sf_dir), D.taxon_frame(spark, sf_dir))


#: Groups of a niche frame have more rows than this.
FEW = 3


def niche_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Niche frame with its small groups: statistics by group leave these out in the same pass."""
    return I.isotope_frame(D.isotope_rows(spark, sf_dir), D.taxon_frame(spark, sf_dir), I.NICHE_GROUPS_OUT, lower_names=True)


def niche_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.min_group_size(niche_rows(spark, sf_dir), more_than=FEW)


_NICHE = f"""WITH {D.MIXTURES},
niche AS (SELECT "WATER", season, community, lower(group_name) AS group_name, iso1, iso2 FROM mixtures
  WHERE group_name NOT IN {_NICHE_OUT} AND iso1 IS NOT NULL AND iso2 IS NOT NULL
  AND (community, group_name) IN (SELECT (community, group_name) FROM mixtures GROUP BY 1 HAVING count(*) > 3))"""


@query("isotope_frame", f"""WITH {D.MIXTURES}
SELECT community, "GROUP", graph_id, group_name, count(*) AS n, count(iso1) AS n1, round(sum(iso1), 8) AS s1, round(sum(iso2), 8) AS s2
FROM mixtures WHERE group_name NOT IN {_MIX_OUT} GROUP BY 1, 2, 3, 4""")
def isotope_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(mixtures(spark, sf_dir).groupBy("community", "GROUP", "graph_id", "group_name").agg(
        F.count(F.lit(1)).alias("n"), F.count("iso1").alias("n1"), F.sum("iso1").alias("s1"), F.sum("iso2").alias("s2")), 8, "s1", "s2")


_LIPID = """meas AS (
  SELECT l_orderkey AS item, p_type AS cat, CASE WHEN l_linenumber = 7 THEN 'ND' ELSE CAST(l_quantity AS VARCHAR) END AS c,
         l_extendedprice / 1000 AS n, l_tax * 100 + 1 AS per_c, l_discount * 100 AS per_n
  FROM lineitem JOIN part ON l_partkey = p_partkey),
fixed AS (SELECT item, CASE WHEN cat = 'PROMO' THEN 'ALGA' WHEN cat = 'SMALL' THEN NULL ELSE cat END AS cat, c, n, per_c, per_n FROM meas),
corr AS (SELECT item, cat, n, CASE WHEN coalesce(cat, '') = 'ALGA' THEN TRY_CAST(c AS DOUBLE)
              ELSE TRY_CAST(c AS DOUBLE) - 3.32 + 0.99 * (per_c / nullif(per_n, 0)) END AS c FROM fixed)"""


def measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Laboratory rows: an order is an item, a part type the category; small parts have none."""
    lines = D.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_tax", "l_discount")
    parts = D.table(spark, sf_dir, "part").select("p_partkey", "p_type")
    category = F.when(F.col("p_type") == "PROMO", "ALGA").when(F.col("p_type") != "SMALL", F.col("p_type"))
    return lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").alias("ITEM_N"), category.alias("CATEGORY"),
        F.when(F.col("l_linenumber") == 7, "ND").otherwise(F.col("l_quantity").cast("string")).alias("D13C"),
        (F.col("l_extendedprice") / 1000).alias("D15N"), (F.col("l_tax") * 100 + 1).alias("PER_C"), (F.col("l_discount") * 100).alias("PER_N"))


@query("lipid_correct", f"""WITH {_LIPID}
SELECT cat AS "CATEGORY", count(*) AS n, count(c) AS known, round(sum(c), 4) AS total FROM corr GROUP BY 1""")
def lipid_correct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.lipid_correct(measurements(spark, sf_dir)).groupBy("CATEGORY").agg(
        F.count(F.lit(1)).alias("n"), F.count("D13C").alias("known"), F.round(F.sum("D13C"), 4).alias("total"))


@query("replicate_summary", f"""WITH {_LIPID}, u AS (SELECT DISTINCT item, c, n, cat FROM corr)
SELECT item AS "ITEM_N", count(*) AS replicates, CAST(avg(c)::FLOAT AS DOUBLE) AS "mean_C", CAST(stddev_samp(c)::FLOAT AS DOUBLE) AS "sd_C",
       CAST(avg(n)::FLOAT AS DOUBLE) AS "mean_N", CAST(stddev_samp(n)::FLOAT AS DOUBLE) AS "sd_N", max(cat) AS label FROM u GROUP BY 1 HAVING count(*) > 3""")
def replicate_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return single(I.replicate_summary(I.lipid_correct(measurements(spark, sf_dir)), "ITEM_N"), "mean_C", "sd_C", "mean_N", "sd_N")


@query("group_centroids", f"""WITH {D.MIXTURES}
SELECT community, group_name, CAST(avg(iso1)::FLOAT AS DOUBLE) AS iso1, CAST(avg(iso2)::FLOAT AS DOUBLE) AS iso2 FROM mixtures
WHERE group_name NOT IN {_MIX_OUT} AND iso1 IS NOT NULL AND iso2 IS NOT NULL GROUP BY 1, 2""")
def group_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return single(I.group_centroids(mixtures(spark, sf_dir)), "iso1", "iso2")


@query("legends", f"""WITH {D.MIXTURES}, g AS (SELECT DISTINCT group_name FROM mixtures WHERE group_name NOT IN {_MIX_OUT})
SELECT group_name, row_number() OVER (ORDER BY group_name) AS "group" FROM g""")
def legends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.legends(mixtures(spark, sf_dir))[0]


@query("legends_community", f"""WITH {D.MIXTURES}, g AS (SELECT DISTINCT community FROM mixtures WHERE group_name NOT IN {_MIX_OUT})
SELECT community, row_number() OVER (ORDER BY community) AS code FROM g""")
def legends_community(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.legends(mixtures(spark, sf_dir))[1]


_ELLIPSE = _NICHE + """,
st AS (SELECT community, group_name, count(*) AS n, avg(iso1) AS mean_x, avg(iso2) AS mean_y, var_samp(iso1) AS var_x,
              covar_samp(iso1, iso2) AS cov_xy, var_samp(iso2) AS var_y FROM niche GROUP BY 1, 2)"""


@query("ellipse_sea", _ELLIPSE + """
SELECT community, group_name, n, CAST(mean_x::FLOAT AS DOUBLE) AS mean_x, CAST(mean_y::FLOAT AS DOUBLE) AS mean_y, CAST(var_x::FLOAT AS DOUBLE) AS var_x,
       CAST(var_y::FLOAT AS DOUBLE) AS var_y, CAST(cov_xy::FLOAT AS DOUBLE) AS cov_xy,
       CAST((pi() * sqrt(CASE WHEN var_x * var_y - cov_xy * cov_xy <= 1e-12 * var_x * var_y THEN 0 ELSE var_x * var_y - cov_xy * cov_xy END))::FLOAT AS DOUBLE) AS sea,
       CAST((pi() * sqrt(CASE WHEN var_x * var_y - cov_xy * cov_xy <= 1e-12 * var_x * var_y THEN 0 ELSE var_x * var_y - cov_xy * cov_xy END) * (n - 1) / nullif(n - 2, 0))::FLOAT AS DOUBLE) AS seac FROM st""")
def ellipse_sea(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = N.ellipse_stats(niche_rows(spark, sf_dir), ["community", "group_name"], more_than=FEW)
    values = ["mean_x", "mean_y", "var_x", "var_y", "cov_xy", "sea", "seac"]
    return single(out.select("community", "group_name", "n", *values), *values)


def _stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.ellipse_stats(niche_rows(spark, sf_dir), ["community", "group_name"], more_than=FEW)


@query("niche_draws")
def niche_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.niche_draws(_stats(spark, sf_dir), ["community", "group_name"])


@query("niche_draws_near", _ELLIPSE + """
SELECT community, group_name, true AS mean_near, true AS spread_near FROM st WHERE n > 5""")
def niche_draws_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of 2,000 draws lie within six standard errors of the posterior's own: the group mean, and E[covariance] = SS / (n - 4)."""
    stats = N.ellipse_stats(niche_rows(spark, sf_dir), ["community", "group_name"], more_than=FEW).where("n > 5")
    draws = N.niche_draws(stats, ["community", "group_name"], 2000)
    moments = draws.groupBy("community", "group_name").agg(F.avg("mu_x").alias("m"), F.stddev_samp("mu_x").alias("s"), F.avg("s_xx").alias("v"), F.stddev_samp("s_xx").alias("w"))
    both = natural_join(stats, moments, "inner", ["community", "group_name"])
    error = F.sqrt(F.lit(2000.0))
    return both.select("community", "group_name", (F.abs(F.col("m") - F.col("mean_x")) <= 6 * F.col("s") / error + 1e-9).alias("mean_near"),
                       (F.abs(F.col("v") / (F.col("var_x") + 1e-12) - 1) < 1.5).alias("spread_near"))


@query("niche_area")
def niche_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    areas = N.ellipse_area(N.niche_draws(_stats(spark, sf_dir), ["community", "group_name"]))
    return N.interval_summary(areas, ["community", "group_name"], "area")


@query("layman", _NICHE + """,
p AS (SELECT community, group_name, avg(iso1) AS x, avg(iso2) AS y FROM niche GROUP BY 1, 2),
m AS (SELECT community, max(x) - min(x) AS dx, max(y) - min(y) AS dy, avg(x) AS mx, avg(y) AS my FROM p GROUP BY 1),
c AS (SELECT community, avg(sqrt(pow(x - mx, 2) + pow(y - my, 2))) AS cd FROM p JOIN m USING (community) GROUP BY 1),
nn AS (SELECT community, a.group_name, min(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2))) AS d
       FROM p a JOIN p b USING (community) WHERE a.group_name <> b.group_name GROUP BY 1, 2),
ns AS (SELECT community, avg(d) AS nnd, stddev_samp(d) AS sdnnd FROM nn GROUP BY 1),
e AS (SELECT a.community, a.x * b.y - a.y * b.x AS z FROM p a JOIN p b ON a.community = b.community AND a.group_name <> b.group_name
      JOIN p k ON k.community = a.community AND k.group_name <> a.group_name AND k.group_name <> b.group_name
      GROUP BY a.community, a.group_name, b.group_name, a.x, a.y, b.x, b.y
      HAVING min((b.x - a.x) * (k.y - a.y) - (b.y - a.y) * (k.x - a.x)) > 0),
ta AS (SELECT community, sum(z) / 2 AS ta FROM e GROUP BY 1)
SELECT community, CAST(dx::FLOAT AS DOUBLE) AS "dX_range", CAST(dy::FLOAT AS DOUBLE) AS "dY_range", CAST(coalesce(ta, 0)::FLOAT AS DOUBLE) AS "TA", CAST(cd::FLOAT AS DOUBLE) AS "CD", CAST(nnd::FLOAT AS DOUBLE) AS "NND",
       CAST(sdnnd::FLOAT AS DOUBLE) AS "SDNND" FROM m LEFT JOIN c USING (community) LEFT JOIN ns USING (community) LEFT JOIN ta USING (community)""")
def layman(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = I.group_centroids(niche_rows(spark, sf_dir), more_than=FEW)
    return single(N.layman(points, ["community"]), "dX_range", "dY_range", "TA", "CD", "NND", "SDNND")


def _cluster_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.community_clusters(spark, sf_dir).select(C.unite(".", "WATER", "season").alias("community"), "cluster")


@query("layman_draws")
def layman_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    draws = checkpointed(N.niche_draws(_stats(spark, sf_dir), ["community", "group_name"]))
    clusters = _cluster_of(spark, sf_dir)
    areas = N.area_by_cluster(natural_join(N.ellipse_area(draws), clusters), "community", "cluster")
    rows = N.layman_by_cluster(N.layman_draws(draws, hull=False), clusters, areas, "community", "cluster")
    return N.interval_summary(rows, ["cluster", "metric"], "value")


@query("ellipse_overlap")
def ellipse_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    draws = N.niche_draws(_stats(spark, sf_dir), ["community", "group_name"], 50, block=50)
    rows = N.overlap_long(N.ellipse_overlap(draws))
    return N.interval_summary(rows, ["community", "pair"], "overlap")


@query("overlap_by_cluster")
def overlap_by_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    draws = N.niche_draws(_stats(spark, sf_dir), ["community", "group_name"], 50, block=50)
    return N.overlap_by_cluster(N.overlap_long(N.ellipse_overlap(draws)), _cluster_of(spark, sf_dir))


_CIRCLES = _NICHE + """,
g AS (SELECT community, group_name, CAST(floor(iso1) AS INT) % 3 AS draw, count(*) AS n, avg(iso1) AS x, avg(iso2) AS y, var_samp(iso1) AS v FROM niche GROUP BY 1, 2, 3 HAVING count(*) > 2),
c AS (SELECT community, group_name, draw, x, y, sqrt(-2 * ln(0.05) * v / (1 + draw * 40)) AS r FROM g WHERE v > 1e-9),
p AS (SELECT a.community, a.draw, a.group_name AS s1, b.group_name AS s2, a.r AS r1, b.r AS r2, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS d
      FROM c a JOIN c b ON a.community = b.community AND a.draw = b.draw AND a.group_name < b.group_name),
l AS (SELECT *, CASE WHEN d >= r1 + r2 THEN 0 WHEN d <= abs(r1 - r2) THEN pi() * pow(least(r1, r2), 2) ELSE
        r1 * r1 * acos((d * d + r1 * r1 - r2 * r2) / (2 * d * r1)) + r2 * r2 * acos((d * d + r2 * r2 - r1 * r1) / (2 * d * r2))
        - 0.5 * sqrt((-d + r1 + r2) * (d + r1 - r2) * (d - r1 + r2) * (d + r1 + r2)) END AS shared FROM p)
SELECT community, draw, s1, s2, round(shared / (pi() * (r1 * r1 + r2 * r2) - shared), 6) + 0 AS overlap FROM l"""


@query("overlap_given", _CIRCLES)
def overlap_given(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Circles around the groups' means, with radii so different that some lie apart and some inside another."""
    frame = niche_frame(spark, sf_dir).withColumn("draw", F.floor(F.col("iso1")).cast("int") % 3).dropna(subset=["iso1", "iso2"])
    stats = frame.groupBy("community", "group_name", "draw").agg(F.count(F.lit(1)).alias("n"), F.avg("iso1").alias("mu_x"), F.avg("iso2").alias("mu_y"), F.var_samp("iso1").alias("v"))
    v = F.col("v") / (1 + F.col("draw") * 40)
    circles = stats.where("n > 2 AND v > 1e-9").withColumns({"s_xx": v, "s_xy": F.lit(0.0), "s_yy": v})
    out = N.ellipse_overlap(circles)
    return out.withColumn("overlap", F.round("overlap", 6) + 0.0)


# --- given draws: the ellipse of each day of the month stands for a draw ------------------------------

def _given(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(community, group_name, draw, mu_x, mu_y, s_xx, s_xy, s_yy): ellipses of the mixtures of each remainder of iso1."""
    frame = niche_frame(spark, sf_dir).withColumn("draw", F.floor(F.col("iso1")).cast("int") % 3)
    stats = N.ellipse_stats(frame, ["community", "group_name", "draw"])
    return stats.select("community", "group_name", "draw", F.col("mean_x").alias("mu_x"), F.col("mean_y").alias("mu_y"),
                        F.col("var_x").alias("s_xx"), F.col("cov_xy").alias("s_xy"), F.col("var_y").alias("s_yy"))


_GIVEN = _NICHE + """,
gd AS (SELECT community, group_name, CAST(floor(iso1) AS INT) % 3 AS draw, avg(iso1) AS mx, avg(iso2) AS my, var_samp(iso1) AS vx,
              covar_samp(iso1, iso2) AS xy, var_samp(iso2) AS vy FROM niche GROUP BY 1, 2, 3),
ga AS (SELECT *, pi() * sqrt(greatest(0, vx * vy - xy * xy)) AS area FROM gd)"""


@query("niche_area_given", _GIVEN + """
SELECT community, group_name, draw, round(area, 5) AS area, round(sum(area) OVER w, 5) AS total_area FROM ga
WHERE vx * vy - xy * xy > 1e-9 * vx * vy WINDOW w AS (PARTITION BY community, draw)""")
def niche_area_given(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = F.col("s_xx") * F.col("s_yy") - F.col("s_xy") * F.col("s_xy") > 1e-9 * F.col("s_xx") * F.col("s_yy")
    out = N.niche_area(_given(spark, sf_dir).where(flat))
    return rounded(out.select("community", "group_name", "draw", "area", "total_area"), 5, "area", "total_area")


@query("layman_draws_given", _GIVEN + """,
m AS (SELECT community, draw, max(mx) - min(mx) AS dx, max(my) - min(my) AS dy, avg(mx) AS cx, avg(my) AS cy FROM gd GROUP BY 1, 2),
c AS (SELECT community, draw, avg(sqrt(pow(mx - cx, 2) + pow(my - cy, 2))) AS cd FROM gd JOIN m USING (community, draw) GROUP BY 1, 2),
nn AS (SELECT community, draw, a.group_name, min(sqrt(pow(a.mx - b.mx, 2) + pow(a.my - b.my, 2))) AS d
       FROM gd a JOIN gd b USING (community, draw) WHERE a.group_name <> b.group_name GROUP BY 1, 2, 3),
ns AS (SELECT community, draw, avg(d) AS nnd, stddev_samp(d) AS sdnnd FROM nn GROUP BY 1, 2)
SELECT community, draw, round(dx, 9) AS "dX_range", round(dy, 9) AS "dY_range", round(cd, 9) AS "CD", round(nnd, 9) AS "NND",
       round(sdnnd, 9) AS "SDNND" FROM m LEFT JOIN c USING (community, draw) LEFT JOIN ns USING (community, draw)""")
def layman_draws_given(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["dX_range", "dY_range", "CD", "NND", "SDNND"]
    return rounded(N.layman_draws(_given(spark, sf_dir), hull=False), 9, *names)


# --- fixed draw table: day of the month stands for the draw -----------------------------------------

_DRAWS = f"""draws AS (
  SELECT replace(n_name, '_', '') AS "WATER", CASE WHEN month(o_orderdate) < 8 THEN 'spring' ELSE 'fall' END AS season,
         lower(p_type) AS group_name, day(o_orderdate) AS draw, avg(l_quantity) AS area, avg(l_extendedprice) / 100000 AS overlap
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3, 4),
{D.CLUSTERS},
named AS (SELECT *, "WATER" || '.' || season AS community FROM draws LEFT JOIN clusters USING ("WATER", season))"""


def fixed_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = D.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice")
    orders = D.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    customers = D.table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nations = D.table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    parts = D.table(spark, sf_dir, "part").select("p_partkey", "p_type")
    rows = (lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customers, F.col("o_custkey") == F.col("c_custkey"))
            .join(nations, F.col("c_nationkey") == F.col("n_nationkey")).join(parts, F.col("l_partkey") == F.col("p_partkey"))
            .groupBy(F.replace("n_name", F.lit("_"), F.lit("")).alias("WATER"), C.season(F.month("o_orderdate")).alias("season"),
                     F.lower("p_type").alias("group_name"), F.dayofmonth("o_orderdate").alias("draw"))
            .agg(F.avg("l_quantity").alias("area"), (F.avg("l_extendedprice") / 100000).alias("overlap")))
    named = rows.withColumn("community", C.unite(".", "WATER", "season"))
    return natural_join(named, D.community_clusters(spark, sf_dir), "left", ["WATER", "season"])


@query("area_share", f"""WITH {_DRAWS}
SELECT community, group_name, draw, round(sum(area) OVER w, 6) AS total_area, round(area / sum(area) OVER w, 8) AS relative_area
FROM named WINDOW w AS (PARTITION BY community, draw)""")
def area_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = add_share(fixed_draws(spark, sf_dir), ["community", "draw"], "area", "total_area", "relative_area")
    return out.select("community", "group_name", "draw", F.round("total_area", 6).alias("total_area"), F.round("relative_area", 8).alias("relative_area"))


_BY_CLUSTER = f"""WITH {_DRAWS},
pc AS (SELECT community, cluster, draw, avg(area) AS area FROM named GROUP BY 1, 2, 3),
bc AS (SELECT cluster, draw, avg(area) AS area FROM pc GROUP BY 1, 2)"""


@query("area_by_cluster", _BY_CLUSTER + " SELECT cluster, draw, round(area, 6) AS area FROM bc")
def area_by_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(N.area_by_cluster(fixed_draws(spark, sf_dir), "community", "cluster"), 6, "area")


@query("area_by_group", f"""WITH {_DRAWS}, g AS (SELECT group_name, draw, avg(area) AS area FROM named GROUP BY 1, 2)
SELECT group_name, round(avg(area), 6) AS mean, round(quantile_cont(area, 0.025), 6) AS low, round(quantile_cont(area, 0.975), 6) AS high FROM g GROUP BY 1""")
def area_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(N.area_by_group(fixed_draws(spark, sf_dir), ["group_name"]), 6, "mean", "low", "high")


@query("season_shift", f"""WITH {_DRAWS},
w AS (SELECT group_name, "WATER", draw, max(area) FILTER (WHERE season = 'fall') - max(area) FILTER (WHERE season = 'spring') AS diff FROM named GROUP BY 1, 2, 3),
q AS (SELECT group_name, "WATER", quantile_cont(diff, 0.025) AS low, quantile_cont(diff, 0.5) AS mid, quantile_cont(diff, 0.975) AS high
      FROM w WHERE diff IS NOT NULL GROUP BY 1, 2)
SELECT group_name, "WATER", round(low, 6) AS low, round(mid, 6) AS mid, round(high, 6) AS high, sign(low) = sign(high) AS sig FROM q""")
def season_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(N.seasonal_area_shift(fixed_draws(spark, sf_dir), "group_name", "WATER", "season"), 6, "low", "mid", "high")


@query("contrasts_fixed_draws", _BY_CLUSTER + """,
r AS (SELECT 'area' AS metric, cluster, draw, area AS v FROM bc
      UNION ALL SELECT 'overlap', cluster, draw, avg(overlap) FROM named GROUP BY 2, 3),
s AS (SELECT metric, 0.1 * stddev_samp(v) AS r FROM r GROUP BY 1),
d AS (SELECT a.metric, a.cluster || ' - ' || b.cluster AS contrast, a.v - b.v AS diff FROM r a JOIN r b ON a.metric = b.metric AND a.draw = b.draw
      WHERE a.cluster < b.cluster),
q AS (SELECT metric, contrast, quantile_cont(diff, 0.025) AS lo, quantile_cont(diff, 0.975) AS hi FROM d GROUP BY 1, 2)
SELECT metric, contrast, round(100 * avg(CASE WHEN diff BETWEEN -r AND r THEN 1.0 ELSE 0 END) FILTER (WHERE diff BETWEEN lo AND hi), 6) AS rope_prop,
       round(100 * greatest(avg(CASE WHEN diff > 0 THEN 1.0 ELSE 0 END), avg(CASE WHEN diff < 0 THEN 1.0 ELSE 0 END)), 6) AS "PD"
FROM d JOIN q USING (metric, contrast) JOIN s USING (metric) GROUP BY 1, 2""")
def contrasts_fixed_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixed_draws(spark, sf_dir)
    area = N.area_by_cluster(rows, "community", "cluster").select(F.lit("area").alias("metric"), "cluster", "draw", F.col("area").alias("value"))
    overlap = rows.groupBy("cluster", "draw").agg(F.avg("overlap").alias("value")).select(F.lit("overlap").alias("metric"), "cluster", "draw", "value")
    return rounded(N.posterior_contrasts(area.unionByName(overlap), ["0", "1", "2", "3", "4"]), 6, "rope_prop", "PD")


@query("contrasts_hdi", _BY_CLUSTER + """,
r AS (SELECT 'area' AS metric, cluster, draw, area AS v FROM bc
      UNION ALL SELECT 'overlap', cluster, draw, avg(overlap) FROM named GROUP BY 2, 3),
s AS (SELECT metric, 0.1 * stddev_samp(v) AS r FROM r GROUP BY 1),
d AS (SELECT a.metric, a.cluster || ' - ' || b.cluster AS contrast, a.v - b.v AS diff FROM r a JOIN r b ON a.metric = b.metric AND a.draw = b.draw
      WHERE a.cluster < b.cluster),
v AS (SELECT metric, contrast, list_sort(list(diff)) AS v, CAST(ceil(0.95 * count(*)) AS INT) AS span FROM d GROUP BY 1, 2),
z AS (SELECT metric, contrast, v[i] AS lo, v[i + span - 1] AS hi FROM (SELECT *, unnest(range(1, len(v) - span + 2)) AS i FROM v)),
q AS (SELECT metric, contrast, lo, hi FROM z QUALIFY row_number() OVER (PARTITION BY metric, contrast ORDER BY hi - lo, lo) = 1)
SELECT metric, contrast, round(100 * avg(CASE WHEN diff BETWEEN -r AND r THEN 1.0 ELSE 0 END) FILTER (WHERE diff BETWEEN lo AND hi), 6) AS rope_prop,
       round(100 * greatest(avg(CASE WHEN diff > 0 THEN 1.0 ELSE 0 END), avg(CASE WHEN diff < 0 THEN 1.0 ELSE 0 END)), 6) AS "PD"
FROM d JOIN q USING (metric, contrast) JOIN s USING (metric) GROUP BY 1, 2""")
def contrasts_hdi(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixed_draws(spark, sf_dir)
    area = N.area_by_cluster(rows, "community", "cluster").select(F.lit("area").alias("metric"), "cluster", "draw", F.col("area").alias("value"))
    overlap = rows.groupBy("cluster", "draw").agg(F.avg("overlap").alias("value")).select(F.lit("overlap").alias("metric"), "cluster", "draw", "value")
    return rounded(N.posterior_contrasts(area.unionByName(overlap), ["0", "1", "2", "3", "4"], interval="hdi"), 6, "rope_prop", "PD")


_PAIR_ROWS = f"""WITH {_DRAWS},
op AS (SELECT a."WATER" AS water, a.season, a.community, a.cluster, a.draw, a.group_name || '_' || b.group_name AS pair,
              round_even(least(a.overlap, b.overlap), 3) AS overlap
       FROM named a JOIN named b ON a.community = b.community AND a.draw = b.draw AND a.group_name < b.group_name)"""


def _pair_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All unordered pairs of groups of a community and draw, formed inside one list."""
    value = F.array_sort(F.collect_list(F.struct("group_name", "overlap")))
    listed = fixed_draws(spark, sf_dir).groupBy("community", "draw").agg(value.alias("g"))
    later = F.transform("g", lambda a, i: F.transform(F.slice("g", i + 2, F.size("g")), lambda b: F.struct(
        b["group_name"].alias("s1"), a["group_name"].alias("s2"), F.least(a["overlap"], b["overlap"]).alias("overlap"))))
    return N.overlap_long(listed.select("community", "draw", F.explode(F.flatten(later)).alias("p")).select("community", "draw", "p.*"))


@query("pair_canonical", _PAIR_ROWS + " SELECT community, draw, pair, overlap, water, season FROM op")
def pair_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pair_rows(spark, sf_dir).select("community", "draw", "pair", "overlap", "water", "season")


@query("overlap_cluster_interval", _PAIR_ROWS + """,
a AS (SELECT community, cluster, draw, avg(overlap) AS o FROM op GROUP BY 1, 2, 3), b AS (SELECT cluster, draw, avg(o) AS o FROM a GROUP BY 1, 2)
SELECT cluster, round(avg(o), 9) AS mean, round(quantile_cont(o, 0.025), 9) AS low, round(quantile_cont(o, 0.975), 9) AS high FROM b GROUP BY 1""")
def overlap_cluster_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(N.overlap_by_cluster(_pair_rows(spark, sf_dir), _cluster_of(spark, sf_dir)), 9, "mean", "low", "high")


@query("overlap_season_shift", _PAIR_ROWS + """,
w AS (SELECT pair, water, draw, max(overlap) FILTER (WHERE season = 'fall') AS fall, max(overlap) FILTER (WHERE season = 'spring') AS spring
      FROM op GROUP BY 1, 2, 3 HAVING count(DISTINCT season) > 1),
x AS (SELECT *, avg(fall) OVER (PARTITION BY water, pair) AS fw, avg(spring) OVER (PARTITION BY water, pair) AS sw,
             avg(spring) OVER (PARTITION BY pair, draw) AS ps, avg(fall) OVER (PARTITION BY pair, draw) AS pf FROM w),
y AS (SELECT *, avg(ps) OVER (PARTITION BY pair) - avg(pf) OVER (PARTITION BY pair) AS od FROM x),
z AS (SELECT *, avg(od) OVER () AS om FROM y)
SELECT DISTINCT replace(pair, '_', ' & ') AS pair, water, round(sw - fw, 6) AS water_difference, round(od, 6) AS overall_difference,
       round(om, 6) AS overall_mean FROM z""")
def overlap_season_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(N.overlap_season_shift(checkpointed(_pair_rows(spark, sf_dir))), 6, "water_difference", "overall_difference", "overall_mean")


# --- mixing and trophic position ---------------------------------------------------------------------

@query("mixing_proportions")
def mixing_proportions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.mixing_proportions(mixtures(spark, sf_dir), D.baselines(spark, sf_dir))


_TWO = f"""WITH {D.MIXTURES}, {D.BASELINES},
st AS (SELECT community, group_name, count(*) AS n, avg(iso1) AS m1, avg(iso2) AS m2, var_pop(iso1) * count(*) AS q1, var_pop(iso2) * count(*) AS q2
       FROM mixtures WHERE iso1 IS NOT NULL AND iso2 IS NOT NULL AND group_name NOT IN {_MIX_OUT} GROUP BY 1, 2),
b AS (SELECT * FROM baselines WHERE source <> 'LEAF' AND mean_c IS NOT NULL AND sd_c IS NOT NULL AND mean_n IS NOT NULL AND sd_n IS NOT NULL),
two AS (SELECT p.community, p.mean_c AS pc, p.sd_c AS pcs, p.mean_n AS pn, p.sd_n AS pns, z.mean_c AS zc, z.sd_c AS zcs, z.mean_n AS zn, z.sd_n AS zns
        FROM b p JOIN b z USING (community) WHERE p.source = 'PERI' AND z.source = 'ZOOP'),
pt AS (SELECT *, (i + 0.5) / 41 AS p FROM st JOIN two USING (community), (SELECT unnest(range(0, 41)) AS i)),
tr AS (SELECT community, group_name, i, p, n, q1 AS q, m1 AS m, p * pc + (1 - p) * zc AS mu, pow(p * pcs, 2) + pow((1 - p) * zcs, 2) AS sv FROM pt
       UNION ALL SELECT community, group_name, i, p, n, q2, m2, p * pn + (1 - p) * zn, pow(p * pns, 2) + pow((1 - p) * zns, 2) FROM pt),
gr AS (SELECT *, greatest(sqrt(q / greatest(n, 2)), 1e-3) * 0.05 * pow(80.0, j / 15.0) AS s FROM tr, (SELECT unnest(range(0, 16)) AS j)),
ll AS (SELECT community, group_name, i, p, m, max(v) AS top, sum(exp(v - t)) AS total FROM (
         SELECT *, max(v) OVER (PARTITION BY community, group_name, i, m, q) AS t FROM (
           SELECT *, -0.5 * n * ln(sv + s * s) - 0.5 * (q + n * pow(m - mu, 2)) / (sv + s * s) + 3 * ln(s) - 0.06 * s AS v FROM gr)) GROUP BY community, group_name, i, p, m, q),
po AS (SELECT community, group_name, i, p, sum(top + ln(total)) - ln(p) - ln(1 - p) - 0.25 * pow(ln(p) - ln(1 - p), 2) AS lp FROM ll GROUP BY 1, 2, 3, 4),
w AS (SELECT *, exp(lp - max(lp) OVER (PARTITION BY community, group_name)) AS w FROM po),
r AS (SELECT community, group_name, sum(w * p) / sum(w) AS mean, sqrt(greatest(sum(w * p * p) / sum(w) - pow(sum(w * p) / sum(w), 2), 0)) AS sd, pow(sum(w), 2) / sum(w * w) AS points FROM w GROUP BY 1, 2)
SELECT community, group_name, 'PERI' AS source, round(mean, 7) AS mean, round(sd, 5) AS sd, round(points, 4) AS points FROM r
UNION ALL SELECT community, group_name, 'ZOOP', round(1 - mean, 7), round(sd, 5), round(points, 4) FROM r"""


@query("mixing_two_sources", _TWO)
def mixing_two_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sources on one lattice of 41 shares, which SQL can sum over."""
    sources = D.baselines(spark, sf_dir).where("source <> 'LEAF'")
    out = M.mixing_proportions(mixtures(spark, sf_dir), sources, steps=40, zooms=0)
    return out.select("community", "group_name", "source", F.round("mean", 7).alias("mean"), F.round("sd", 5).alias("sd"), F.round("points", 4).alias("points"))


_SHARES = f"""WITH {D.MIXTURES}, {D.BASELINES},
cls AS (SELECT community, "FAMILY" AS group_name, CASE WHEN iso1 <= 17 THEN 'PERI' WHEN iso1 <= 34 THEN 'LEAF' ELSE 'ZOOP' END AS source
        FROM mixtures WHERE "FAMILY" IS NOT NULL AND iso1 IS NOT NULL),
shares AS (SELECT community, group_name, source, count(*) / sum(count(*)) OVER (PARTITION BY community, group_name) AS mean
           FROM cls GROUP BY 1, 2, 3 QUALIFY NOT (source = 'PERI' AND group_name LIKE '%7'))"""


def share_table(frame: DataFrame) -> DataFrame:
    """Shares by size class of the family's own rows; families ending in 7 have no nearshore share."""
    rows = frame.where("FAMILY IS NOT NULL AND iso1 IS NOT NULL")
    source = F.when(F.col("iso1") <= 17, "PERI").when(F.col("iso1") <= 34, "LEAF").otherwise("ZOOP")
    counts = rows.groupBy("community", F.col("FAMILY").alias("group_name"), source.alias("source")).agg(F.count(F.lit(1)).alias("k"))
    totals = rows.groupBy("community", F.col("FAMILY").alias("group_name")).agg(F.count(F.lit(1)).alias("n"))
    shares = natural_join(counts, totals, "inner", ["community", "group_name"])
    return shares.select("community", "group_name", "source", (F.col("k") / F.col("n")).alias("mean")).where("NOT (source = 'PERI' AND group_name LIKE '%7')")


@query("complete_sources", _SHARES + """
SELECT community, source, round(avg(mean) * 100, 6) AS mean_share FROM shares
WHERE community IN (SELECT community FROM shares GROUP BY 1 HAVING count(DISTINCT source) = 3) GROUP BY 1, 2""")
def complete_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.complete_sources(share_table(mixtures(spark, sf_dir))), 6, "mean_share")


@query("source_share_wide", _SHARES + """
SELECT community, round(avg(mean) FILTER (WHERE source = 'PERI') * 100, 6) AS "PERI", round(avg(mean) FILTER (WHERE source = 'ZOOP') * 100, 6) AS "ZOOP",
       round(avg(mean) FILTER (WHERE source = 'LEAF') * 100, 6) AS "LEAF" FROM shares GROUP BY 1 HAVING count(DISTINCT source) = 3""")
def source_share_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.source_share_wide(M.complete_sources(share_table(mixtures(spark, sf_dir)))), 6, "PERI", "ZOOP", "LEAF")


@query("mixing_by_taxon", _SHARES + """, r AS (SELECT * FROM shares WHERE group_name IN ('brand1', 'brand7', 'brand12', 'nosuch'))
SELECT community, group_name, source, round(mean, 8) AS mean FROM r QUALIFY count(*) OVER (PARTITION BY group_name) > 3""")
def mixing_by_taxon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.mixing_by_taxon(share_table(mixtures(spark, sf_dir)), ["brand1", "brand7", "brand12", "nosuch"]), 8, "mean")


@query("mixing_with_order", _SHARES + """
SELECT community, group_name, source, round(mean, 8) AS mean, "ORDER" FROM shares LEFT JOIN (SELECT DISTINCT "FAMILY" AS group_name, "ORDER" FROM taxon_frame) USING (group_name)""")
def mixing_with_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(M.with_order(share_table(mixtures(spark, sf_dir)), D.taxon_frame(spark, sf_dir)), 8, "mean").select("community", "group_name", "source", "mean", "ORDER")


TROPHIC = _SHARES + f""",
mix AS (SELECT community, group_name, max(mean) FILTER (WHERE source = 'PERI') AS pm, max(mean) FILTER (WHERE source = 'ZOOP') AS zm,
               max(mean) FILTER (WHERE source = 'LEAF') AS lm FROM shares GROUP BY 1, 2),
bas AS (SELECT community, max(mean_n) FILTER (WHERE source = 'PERI') AS p, max(mean_n) FILTER (WHERE source = 'ZOOP') AS z,
               max(mean_n) FILTER (WHERE source = 'LEAF') AS l FROM baselines GROUP BY 1),
tp AS (SELECT m.community, m."GROUP", m."FAMILY", iso1, iso2,
         (iso2 - (z * zm + l * lm + coalesce(p * pm, 0))) / 3.14 + 2 * zm + lm + coalesce(pm, 0) AS w,
         (iso2 - CASE WHEN pm IS NOT NULL THEN p ELSE l END) / 3.14 + 1 AS s
       FROM (SELECT * FROM mixtures WHERE group_name NOT IN {_MIX_OUT}) m LEFT JOIN mix ON mix.community = m.community AND mix.group_name = m."FAMILY"
       LEFT JOIN bas ON bas.community = m.community),
tc AS (SELECT t.*, o."ORDER" FROM tp t LEFT JOIN (SELECT DISTINCT "FAMILY", "ORDER" FROM taxon_frame) o USING ("FAMILY")
       WHERE w IS NOT NULL AND s IS NOT NULL AND iso1 IS NOT NULL AND iso2 IS NOT NULL AND "FAMILY" IS NOT NULL)"""


def trophic_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = checkpointed(mixtures(spark, sf_dir))  # a stage table: the joins behind it run once
    rows = T.trophic_position(frame, share_table(frame), D.baselines(spark, sf_dir))
    return T.trophic_clean(rows, D.taxon_frame(spark, sf_dir))


@query("trophic_position", TROPHIC + """
SELECT community, "GROUP", "FAMILY", "ORDER", count(*) AS n, round(sum(w), 4) AS weighted, round(sum(s), 4) AS simple,
       round(max(mt), 6) AS "mean_TP" FROM (SELECT *, avg(w) OVER (PARTITION BY "FAMILY") AS mt FROM tc) GROUP BY 1, 2, 3, 4""")
def trophic_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rounded(trophic_rows(spark, sf_dir).groupBy("community", "GROUP", "FAMILY", "ORDER").agg(
        F.count(F.lit(1)).alias("n"), F.sum("trophic_position_weighted").alias("weighted"), F.sum("trophic_position").alias("simple"),
        F.max("mean_TP").alias("mean_TP")), 4, "weighted", "simple"), 6, "mean_TP")


@query("trophic_table", TROPHIC + """
SELECT "ORDER", "FAMILY", round(avg(w), 6) AS "mean_TP", round(stddev_samp(w), 6) AS "sd_TP", count(*) AS n FROM tc GROUP BY 1, 2 HAVING count(*) > 3""")
def trophic_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(T.trophic_table(trophic_rows(spark, sf_dir)), 6, "mean_TP", "sd_TP")
