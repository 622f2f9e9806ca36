"""Registered queries on depth profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from limnos.operators import profiles as P
from limnos.plans.registry import registry
from limnos.sources import domain as D

QUERIES, ORACLE, query = registry()

_GRADIENT = f"""WITH {D.PROFILES},
g AS (SELECT "ID", depth, temp - lag(temp) OVER w AS dtemp, depth - lag(depth) OVER w AS ddepth,
             (temp - lag(temp) OVER w) / (depth - lag(depth) OVER w) AS grad
      FROM profiles WINDOW w AS (PARTITION BY "ID" ORDER BY depth))"""


@query("profile_gradient", _GRADIENT + """
SELECT "ID", depth, round(dtemp, 6) AS dtemp, ddepth, round(grad, 6) AS grad FROM g""")
def profile_gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = P.profile_gradient(D.profiles(spark, sf_dir).select("ID", "depth", "temp"), "ID", "depth", "temp")
    return g.select("ID", "depth", F.round("dtemp", 6).alias("dtemp"), "ddepth", F.round("grad", 6).alias("grad"))


@query("profile_layer", _GRADIENT + """,
m AS (SELECT "ID", max(abs(grad)) AS grad_max FROM g GROUP BY 1)
SELECT "ID", round(min(CASE WHEN abs(grad) = grad_max THEN depth END), 6) AS mid_depth, round(max(grad_max), 6) AS grad_max,
       round(0.5 * max(grad_max), 6) AS thresh, min(CASE WHEN abs(grad) >= 0.5 * grad_max THEN depth END) AS top,
       max(CASE WHEN abs(grad) >= 0.5 * grad_max THEN depth END) AS bottom
FROM g JOIN m USING ("ID") GROUP BY 1""")
def profile_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = P.profile_gradient(D.profiles(spark, sf_dir).select("ID", "depth", "temp"), "ID", "depth", "temp")
    return P.gradient_layer(g, "ID", "depth", 0.5).select(
        "ID", F.round("mid_depth", 6).alias("mid_depth"), F.round("grad_max", 6).alias("grad_max"),
        F.round("thresh", 6).alias("thresh"), "top", "bottom")


@query("profile_grid", f"""WITH {D.PROFILES},
e AS (SELECT "ID", min(depth) AS lo, max(depth) AS hi FROM profiles GROUP BY 1)
SELECT "ID", round(lo + i * (hi - lo) / 499.0, 6) AS depth FROM e, (SELECT unnest(range(0, 500)) AS i)""")
def profile_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = P.profile_grid(D.profiles(spark, sf_dir), "ID", "depth", 500)
    return grid.select("ID", F.round("depth", 6).alias("depth"))


_CROSSING = f"""WITH {D.PROFILES},
p AS (SELECT "ID", "DO" AS y, avg(depth) AS x FROM profiles GROUP BY 1, 2),
s AS (SELECT "ID", y AS y0, x AS x0, lead(y) OVER w AS y1, lead(x) OVER w AS x1
      FROM p WINDOW w AS (PARTITION BY "ID" ORDER BY y)),
c AS (SELECT "ID", max(CASE WHEN y0 = 5 THEN x0 WHEN y0 < 5 AND y1 > 5 THEN x0 + (5 - y0) * (x1 - x0) / (y1 - y0) END) AS cross_at
      FROM s GROUP BY 1),
d AS (SELECT "ID", coalesce(cross_at, deep) AS "DDO5", cross_at
      FROM (SELECT "ID", max(depth) AS deep FROM profiles GROUP BY 1) LEFT JOIN c USING ("ID"))"""


@query("level_crossing", _CROSSING + """ SELECT "ID", round(cross_at, 6) AS crossing FROM d""")
def level_crossing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = P.level_crossing(D.profiles(spark, sf_dir), "ID", "depth", "DO", 5.0)
    return out.select("ID", F.round("crossing", 6).alias("crossing"))


@query("level_crossing_or_bottom", _CROSSING + """ SELECT "ID", round("DDO5", 6) AS "DDO5" FROM d""")
def level_crossing_or_bottom(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = P.level_crossing_or_bottom(D.profiles(spark, sf_dir), "ID", "depth", "DO", 5.0, "DDO5")
    return out.select("ID", F.round("DDO5", 6).alias("DDO5"))


@query("value_at_depth", _CROSSING + """
SELECT "ID", round(temp, 6) AS "TDO5", round("DDO5", 6) AS "DDO5" FROM profiles JOIN d USING ("ID")
QUALIFY rank() OVER (PARTITION BY "ID" ORDER BY abs(depth - "DDO5")) = 1""")
def value_at_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.profiles(spark, sf_dir)
    targets = P.level_crossing_or_bottom(rows, "ID", "depth", "DO", 5.0, "DDO5")
    out = P.value_at_depth(rows, targets, "ID", "depth", "temp", "DDO5", "TDO5")
    return out.select("ID", F.round("TDO5", 6).alias("TDO5"), F.round("DDO5", 6).alias("DDO5"))


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = D.table(spark, sf_dir, "events")
    return events.select(F.col("user_id").alias("ID"), F.dayofmonth("ts").cast("double").alias("depth"),
                         F.col("value").alias("temp"),
                         (F.get_json_object("props", "$.k").try_cast("double") / 10).alias("DO"))


@query("profile_smooth")
def profile_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = P.profile_smooth(_raw(spark, sf_dir), "ID", "depth", "temp", 10)
    return P.predict_smooth(model, "ID", "depth", "temp_pred", 500, 10)


@query("thermocline")
def thermocline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.extract_thermocline(_raw(spark, sf_dir), "ID", "depth", "temp")["layer"]


@query("oxycline")
def oxycline(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _raw(spark, sf_dir)
    ends = tuple(rows.agg(F.min("depth"), F.max("depth")).first())
    oxygen = P.extract_oxycline(rows, "ID", "depth", "DO", ends=ends)
    warm = P.profile_smooth(rows, "ID", "depth", "temp", ends=ends)
    return P.model_value_at(warm, oxygen["metrics"], "ID", "DDO5", "TDO5")


_CUBIC = """WITH r AS (SELECT user_id AS "ID", day(ts)::DOUBLE / 40 AS t, value AS y FROM events),
a AS (SELECT "ID", count(*) AS n, """ + ", ".join(f"sum(pow(t, {i})) AS s{i}" for i in range(1, 7)) + """, """ + ", ".join(f"sum(y * pow(t, {i})) AS y{i}" for i in range(4)) + """
      FROM r GROUP BY 1 HAVING count(DISTINCT t) > 5),
m AS (SELECT "ID", [[n, s1, s2, s3, y0], [s1, s2, s3, s4, y1], [s2, s3, s4, s5, y2], [s3, s4, s5, s6, y3], [y0, y1, y2, y3, 0]]::DOUBLE[][] AS m FROM a),
sw AS (WITH RECURSIVE s("ID", k, m) AS (SELECT "ID", 0, m FROM m UNION ALL
         SELECT "ID", k + 1, list_transform(range(1, 6), lambda i: list_transform(range(1, 6), lambda j:
           CASE WHEN i = k + 1 AND j = k + 1 THEN -1 / m[k + 1][k + 1] WHEN i = k + 1 OR j = k + 1 THEN m[i][j] / m[k + 1][k + 1]
                ELSE m[i][j] - m[i][k + 1] * m[k + 1][j] / m[k + 1][k + 1] END)) FROM s WHERE k < 4) SELECT "ID", m FROM s WHERE k = 4)
SELECT "ID", i AS point, round(m[1][5] + m[2][5] * pow(i / 10.0, 1) + m[3][5] * pow(i / 10.0, 2) + m[4][5] * pow(i / 10.0, 3), 4) + 0 AS fit FROM sw, (SELECT unnest(range(1, 8)) AS i)"""


@query("smooth_cubic", _CUBIC)
def smooth_cubic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four splines on one knot interval without a penalty are a cubic fit, which SQL can solve."""
    rows = _raw(spark, sf_dir)
    many = rows.groupBy("ID").agg(F.count_distinct("depth").alias("d")).where("d > 5").select("ID")
    model = P.profile_smooth(rows.join(many, "ID"), "ID", "depth", "temp", 4, [0.0], (0.0, 40.0))
    wide = model.withColumns({"lo": F.lit(4.0), "hi": F.lit(28.0)})
    points = P.predict_smooth(wide, "ID", "depth", "fit", 7, 4)
    return points.select("ID", F.round(F.col("depth") / 4).cast("long").alias("point"), (F.round("fit", 4) + 0.0).alias("fit"))


@query("smooth_moments", """WITH r AS (SELECT user_id AS "ID", day(ts)::DOUBLE AS x, value AS y FROM events),
u AS (SELECT *, least(floor((x - 1) * 7 / 30.0), 6) AS m, (x - 1) * 7 / 30.0 - least(floor((x - 1) * 7 / 30.0), 6) AS t FROM r)
SELECT "ID", m::BIGINT AS m, min(x) AS lo, max(x) AS hi, count(*)::DOUBLE AS s0, """ + ", ".join(f"round(sum(pow(t, {i})), 6) AS s{i}" for i in range(1, 7)) + """, """
       + ", ".join(f"round(sum(y * pow(t, {i})), 5) AS y{i}" for i in range(4)) + """, round(sum(y * y), 4) AS yy FROM u GROUP BY ALL""")
def smooth_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    moments = P.smooth_moments(_raw(spark, sf_dir), "ID", "depth", "temp", 10, (1.0, 31.0))
    each = moments.select("ID", F.explode("segments").alias("s"))
    rounded = [F.round(F.col("s")[i + 1], 6 if i else 0).alias(f"s{i}") for i in range(7)] + [F.round(F.col("s")[i + 8], 5).alias(f"y{i}") for i in range(4)]
    spans = D.profiles(spark, sf_dir).groupBy("ID", F.least(F.floor((F.col("depth") - 1) * 7 / 30.0), F.lit(6)).alias("m")).agg(F.min("depth").alias("lo"), F.max("depth").alias("hi"))
    return each.select("ID", F.col("s")[0].cast("long").alias("m"), *rounded, F.round(F.col("s")[12], 4).alias("yy")).join(spans, ["ID", "m"])
