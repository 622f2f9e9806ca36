"""Registered queries on ordination and environmental fits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from limnos.operators import dissimilarity as S
from limnos.operators import ordination as O
from limnos.operators.permutations import numbered
from limnos.plans.community import _FALL, fall_presence
from limnos.plans.registry import registry
from limnos.sources import domain as D

QUERIES, ORACLE, query = registry()


@query("ordination_sites")
def ordination_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    sites, _ = O.ordinate(fall_presence(spark, sf_dir), "WATER", "FAMILY", 2, 50, 3)
    return O.axes(sites, "WATER", 2)


@query("stress_by_k")
def stress_by_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.stress_by_k(fall_presence(spark, sf_dir), "WATER", "FAMILY", [2, 3, 4], 50, 3)


_STRESS = _FALL + """,
size AS (SELECT "WATER", count(*) AS n FROM pres GROUP BY 1),
mark AS (SELECT "WATER" AS landmark, n AS nl FROM size ORDER BY n DESC, "WATER" LIMIT 12),
s AS (SELECT p."WATER", l."WATER" AS landmark, count(*) AS s FROM pres p JOIN pres l USING ("FAMILY") GROUP BY 1, 2),
d AS (SELECT "WATER", landmark, floor((n + nl - 2 * coalesce(s, 0)) / (n + nl - coalesce(s, 0)) * 10000 + 0.5) AS step
      FROM size CROSS JOIN mark LEFT JOIN s USING ("WATER", landmark)),
g AS (SELECT step, sqrt(pow(a.c_acctbal / 1000 - b.c_acctbal / 1000, 2) + pow(a.c_nationkey - b.c_nationkey, 2)) AS gap
      FROM d JOIN customer a ON a.c_custkey = "WATER" JOIN customer b ON b.c_custkey = landmark),
h AS (SELECT row_number() OVER (ORDER BY step) AS i, count(*) AS w, sum(gap) AS t, sum(gap * gap) AS q FROM g GROUP BY step),
c AS (SELECT i, w, t, q, sum(w) OVER (ORDER BY i) AS cw, sum(t) OVER (ORDER BY i) AS ct FROM h),
jk AS (SELECT j.i AS j, k.i AS k, (k.ct - j.ct + j.t) / (k.cw - j.cw + j.w) AS mean FROM c j JOIN c k ON k.i >= j.i),
low AS (SELECT j, k AS i, min(mean) OVER (PARTITION BY j ORDER BY k DESC ROWS UNBOUNDED PRECEDING) AS least FROM jk),
f AS (SELECT i, max(least) AS fit FROM low GROUP BY 1)
SELECT round(sqrt(sum(q - 2 * fit * t + w * fit * fit) / sum(q)), 8) AS landmark_stress, sum(w)::BIGINT AS pairs FROM c JOIN f USING (i)"""


@query("stress_given", _STRESS)
def stress_given(spark: SparkSession, sf_dir: str) -> DataFrame:
    presence = fall_presence(spark, sf_dir)
    marks = S.site_sets(presence, ["WATER"], "FAMILY").orderBy(F.col("n").desc(), "WATER").limit(12)
    distances = S.landmark_dissimilarity(presence, marks, "WATER", "FAMILY", "jaccard")
    coords = D.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("WATER"), (F.col("c_acctbal") / 1000).alias("x"), F.col("c_nationkey").cast("double").alias("y"))
    out = O.landmark_stress(distances, coords, "WATER", ["x", "y"])
    return out.select(F.round("landmark_stress", 8).alias("landmark_stress"), "pairs")


@query("taxon_scores", f"""WITH {D.SPECIMENS},
pres AS (SELECT DISTINCT "WATER", "FAMILY" FROM specimens WHERE "MONTH" = 'FALL' AND "FAMILY" NOT IN ('unidentified', 'degraded', 'terrestrial'))
SELECT "FAMILY", round(avg(c_acctbal), 6) AS x, round(avg(c_nationkey), 6) AS y FROM pres JOIN customer ON c_custkey = "WATER" GROUP BY 1""")
def taxon_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    coords = D.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("WATER"), F.col("c_acctbal").alias("x"),
                                                      F.col("c_nationkey").cast("double").alias("y"))
    out = O.taxon_scores(fall_presence(spark, sf_dir), coords, "WATER", "FAMILY", ["x", "y"])
    return out.select("FAMILY", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query("cluster_sites")
def cluster_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    axes = [f"c{i}" for i in range(D.COMPONENTS)]
    return O.cluster_sites(D.components(spark, sf_dir), axes, 3, 10).select("site", "cluster")


@query("kmeans_elbow")
def kmeans_elbow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.elbow(D.components(spark, sf_dir), [f"c{i}" for i in range(D.COMPONENTS)])


@query("hull_vertices", f"""WITH {D.COORDINATES},
e AS (SELECT a.cluster, a.site AS i, a.x, a.y, b.site AS j FROM coords a JOIN coords b ON a.cluster = b.cluster AND a.site <> b.site
      JOIN coords c ON c.cluster = a.cluster AND c.site <> a.site AND c.site <> b.site
      GROUP BY ALL HAVING min((b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x)) > 0)
SELECT cluster, round(x, 8) AS x, round(y, 8) AS y FROM e""")
def hull_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.convex_hull(D.coordinates(spark, sf_dir), "cluster", "x", "y").select(
        "cluster", F.round("x", 8).alias("x"), F.round("y", 8).alias("y"))


@query("envfit_r2", f"""WITH {D.COORDINATES}, {D.ENVIRONMENT},
s AS (SELECT metric, covar_samp(x, value) AS xv, covar_samp(y, value) AS yv, covar_samp(x, y) AS xy, var_samp(x) AS xx,
             var_samp(y) AS yy, var_samp(value) AS vv FROM environment JOIN coords USING (site) GROUP BY 1),
b AS (SELECT *, (xv * yy - yv * xy) / (xx * yy - xy * xy) AS b1, (yv * xx - xv * xy) / (xx * yy - xy * xy) AS b2 FROM s)
SELECT metric, round((b1 * xv + b2 * yv) / vv, 8) AS r2, round(b1 / sqrt(b1 * b1 + b2 * b2), 8) AS a1,
       round(b2 / sqrt(b1 * b1 + b2 * b2), 8) AS a2 FROM b""")
def envfit_r2(spark: SparkSession, sf_dir: str) -> DataFrame:
    fit = O.envfit(D.coordinates(spark, sf_dir), D.environment(spark, sf_dir), "site", "x", "y")
    return fit.select("metric", *[F.round(c, 8).alias(c) for c in ("r2", "a1", "a2")])


@query("envfit_permuted")
def envfit_permuted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.envfit(D.coordinates(spark, sf_dir), D.environment(spark, sf_dir), "site", "x", "y", perms=999)


@query("envfit_table")
def envfit_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    fit = O.envfit(D.coordinates(spark, sf_dir), D.environment(spark, sf_dir), "site", "x", "y", perms=999)
    return O.envfit_table(fit, labels={"v2": "Second"}, skip=["v9"])


AXES = [f"c{i}" for i in range(D.COMPONENTS)]


def _labelled_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(site, c0 .. c63, cluster, block): all components as axes, labels, and ten blocks of sites."""
    vectors = D.table(spark, sf_dir, "embeddings")
    return vectors.select(F.col("vec_id").alias("site"), *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(AXES)],
                          F.col("label").alias("cluster"), (F.col("vec_id") % 10).alias("block"))


@query("permanova_permuted")
def permanova_permuted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.permanova_coordinates(_labelled_components(spark, sf_dir), "site", AXES, "cluster", 999)


@query("permanova_blocked")
def permanova_blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.permanova_coordinates(_labelled_components(spark, sf_dir), "site", AXES, "cluster", 999, blocks=["block"])


@query("envfit_arrows")
def envfit_arrows(spark: SparkSession, sf_dir: str) -> DataFrame:
    fit = O.envfit(D.coordinates(spark, sf_dir), D.environment(spark, sf_dir), "site", "x", "y", perms=999)
    return O.envfit_arrows(fit)


# --- given permutations: the labels move round by 7 sites for each permutation ------------------------

def _moved(sites: DataFrame, site: str, first: int, blocks: tuple[str, ...] = ()) -> DataFrame:
    perms = numbered(sites.select(site, *blocks), [site], blocks).withColumn("perm", F.explode(F.sequence(F.lit(first), F.lit(40))))
    return perms.select("perm", *blocks, site, ((F.col("at") + 7 * F.col("perm")) % F.col("size")).alias("rank"))


@query("envfit_given", f"""WITH {D.COORDINATES}, {D.ENVIRONMENT},
num AS (SELECT *, row_number() OVER (ORDER BY site) - 1 AS at, count(*) OVER () AS n FROM coords),
mv AS (SELECT p.perm, a.site, b.x, b.y FROM num a, (SELECT unnest(range(0, 41)) AS perm) p JOIN num b ON b.at = (a.at + 7 * p.perm) % a.n),
s AS (SELECT perm, metric, covar_samp(x, value) AS xv, covar_samp(y, value) AS yv, covar_samp(x, y) AS xy, var_samp(x) AS xx,
             var_samp(y) AS yy, var_samp(value) AS vv FROM environment JOIN mv USING (site) GROUP BY 1, 2),
r AS (SELECT perm, metric, (((xv * yy - yv * xy) * xv + (yv * xx - xv * xy) * yv) / (xx * yy - xy * xy)) / vv AS r2 FROM s)
SELECT metric, round(max(r2) FILTER (WHERE perm = 0), 8) AS r2,
       (1 + count(*) FILTER (WHERE perm > 0 AND r2 >= o - 1e-12)) / 41 AS p
FROM r JOIN (SELECT metric, r2 AS o FROM r WHERE perm = 0) USING (metric) GROUP BY 1""")
def envfit_given(spark: SparkSession, sf_dir: str) -> DataFrame:
    coords = D.coordinates(spark, sf_dir)
    fit = O.envfit(coords, D.environment(spark, sf_dir), "site", "x", "y", ranks=_moved(coords, "site", 0))
    return fit.select("metric", F.round("r2", 8).alias("r2"), "p")


@query("envfit_repeated_given", f"""WITH {D.COORDINATES}, {D.ENVIRONMENT},
e AS (SELECT site, metric, CASE WHEN site % 11 > 0 THEN value END AS value FROM environment WHERE site % 7 > 0 UNION ALL
      SELECT site, metric, value * value - site % 3 FROM environment WHERE site % 2 = 0),
s0 AS (SELECT DISTINCT site, x, y FROM coords JOIN e USING (site)),
num AS (SELECT *, row_number() OVER (ORDER BY site) - 1 AS at, count(*) OVER () AS n FROM s0),
mv AS (SELECT p.perm, a.site, b.x, b.y FROM num a, (SELECT unnest(range(0, 41)) AS perm) p JOIN num b ON b.at = (a.at + 7 * p.perm) % a.n),
s AS (SELECT perm, metric, covar_samp(x, value) AS xv, covar_samp(y, value) AS yv, covar_samp(x, y) AS xy, var_samp(x) AS xx,
             var_samp(y) AS yy, var_samp(value) AS vv FROM e JOIN mv USING (site) WHERE value IS NOT NULL GROUP BY 1, 2),
r AS (SELECT perm, metric, (((xv * yy - yv * xy) * xv + (yv * xx - xv * xy) * yv) / (xx * yy - xy * xy)) / vv AS r2 FROM s)
SELECT metric, round(max(r2) FILTER (WHERE perm = 0), 8) AS r2,
       (1 + count(*) FILTER (WHERE perm > 0 AND r2 >= o - 1e-12)) / 41 AS p
FROM r JOIN (SELECT metric, r2 AS o FROM r WHERE perm = 0) USING (metric) GROUP BY 1""")
def envfit_repeated_given(spark: SparkSession, sf_dir: str) -> DataFrame:
    coords, env = D.coordinates(spark, sf_dir), D.environment(spark, sf_dir)
    once = env.where("site % 7 > 0").withColumn("value", F.when(F.col("site") % 11 > 0, F.col("value")))
    again = env.where("site % 2 = 0").withColumn("value", F.col("value") * F.col("value") - F.col("site") % 3)
    both = once.unionByName(again)
    ranks = _moved(coords.join(both.select("site").distinct(), "site"), "site", 0)
    fit = O.envfit(coords, both, "site", "x", "y", ranks=ranks)
    return fit.select("metric", F.round("r2", 8).alias("r2"), "p")


def _given_sql(blocks: str) -> str:
    same = "a.block = b.block" if blocks == "block" else "true"
    return f"""WITH num AS (SELECT vec_id AS site, embedding, label AS cluster, vec_id % 10 AS block, row_number() OVER (PARTITION BY {blocks} ORDER BY vec_id) - 1 AS at,
                                   count(*) OVER (PARTITION BY {blocks}) AS n FROM (SELECT *, vec_id % 10 AS block FROM embeddings)),
lab AS (SELECT *, row_number() OVER (PARTITION BY {blocks} ORDER BY cluster) - 1 AS place FROM num),
mv AS (SELECT 0 AS perm, site, cluster FROM num
       UNION ALL SELECT p.perm, a.site, b.cluster FROM num a, (SELECT unnest(range(1, 41)) AS perm) p JOIN lab b ON {same} AND b.place = (a.at + 7 * p.perm) % a.n),
c AS (SELECT vec_id AS site, unnest(range(64)) AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings),
z AS (SELECT site, i, v - avg(v) OVER (PARTITION BY i) AS v FROM c),
w AS (SELECT sum(v * v) AS total FROM z),
g AS (SELECT perm, cluster, i, count(*) AS k, sum(v) AS s FROM mv JOIN z USING (site) GROUP BY 1, 2, 3),
b AS (SELECT perm, sum(s * s / k) AS b, count(DISTINCT cluster) AS g, (SELECT count(*) FROM num) AS n FROM g GROUP BY 1),
f AS (SELECT perm, (b / (g - 1)) / ((total - b) / (n - g)) AS f FROM b, w)
SELECT round(o, 8) AS f, (1 + count(*) FILTER (WHERE perm > 0 AND f >= o - 1e-12)) / 41 AS p FROM f, (SELECT f AS o FROM f WHERE perm = 0) GROUP BY o"""


@query("permanova_given", _given_sql("1"))
def permanova_given(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _labelled_components(spark, sf_dir)
    out = O.permanova_coordinates(rows, "site", AXES, "cluster", ranks=_moved(rows, "site", 1))
    return out.select(F.round("f", 8).alias("f"), "p")


@query("permanova_blocked_given", _given_sql("block"))
def permanova_blocked_given(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _labelled_components(spark, sf_dir)
    out = O.permanova_coordinates(rows, "site", AXES, "cluster", blocks=["block"], ranks=_moved(rows, "site", 1, ("block",)))
    return out.select(F.round("f", 8).alias("f"), "p")


@query("elbow_one", """WITH c AS (SELECT unnest(range(64)) AS i, unnest(embedding) AS v FROM embeddings)
SELECT CAST(1 AS INT) AS k, round(sum(s), 4) AS wss FROM (SELECT i, var_pop(CAST(v AS DOUBLE)) * count(*) AS s FROM c GROUP BY 1)""")
def elbow_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.elbow(D.components(spark, sf_dir), AXES, [1]).select("k", F.round("wss", 4).alias("wss"))


# --- k-means from given centres (the first k sites), two rounds ---------------------------------------

_KS = [2, 3, 5]


def _first_sites(spark: SparkSession, sf_dir: str) -> dict[int, list]:
    """The first k sites as centres, for each k."""
    rows = D.table(spark, sf_dir, "embeddings").orderBy("vec_id").limit(max(_KS)).collect()
    return {k: [[[float(v) for v in r["embedding"]] for r in rows[:k]]] for k in _KS}


def _kmeans_sql(rounds: int) -> str:
    """Assignments (k, site, c, d) to the centres after so many rounds; ties go to the first centre."""
    gap = "list_sum(list_transform(range(1, 65), lambda i: pow(e.x[i] - c.x[i], 2)))"
    steps = [f"""c0 AS (SELECT k, i AS c, x FROM (SELECT *, row_number() OVER (ORDER BY site) AS i FROM e) , (SELECT unnest({_KS}) AS k) WHERE i <= k)"""]
    for n in range(rounds + 1):
        steps.append(f"""a{n} AS (SELECT c.k, e.site, e.x, c.c, {gap} AS d FROM e, c{n} c QUALIFY row_number() OVER (PARTITION BY c.k, e.site ORDER BY {gap}, c.c) = 1)""")
        if n < rounds:
            steps.append(f"""c{n + 1} AS (SELECT k, c, list(v ORDER BY i) AS x FROM (SELECT k, c, i, avg(v) AS v FROM (SELECT k, c, unnest(range(64)) AS i, unnest(x) AS v FROM a{n}) GROUP BY ALL) GROUP BY ALL)""")
    return "WITH e AS (SELECT vec_id AS site, [CAST(v AS DOUBLE) FOR v IN embedding] AS x FROM embeddings),\n" + ",\n".join(steps)


@query("elbow_given", _kmeans_sql(2) + " SELECT CAST(k AS INT) AS k, round(sum(d), 4) AS wss FROM a2 GROUP BY 1")
def elbow_given(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = O.elbow(D.components(spark, sf_dir), AXES, _KS, rounds=2, centres=_first_sites(spark, sf_dir))
    return out.select("k", F.round("wss", 4).alias("wss"))


@query("cluster_given", _kmeans_sql(2) + " SELECT site, CAST(c AS INT) AS cluster FROM a2 WHERE k = 3")
def cluster_given(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.cluster_sites(D.components(spark, sf_dir), AXES, 3, rounds=2, centres=_first_sites(spark, sf_dir)[3][0]).select("site", "cluster")
