"""Registered queries on water chemistry tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from limnos.functions import columns as C
from limnos.operators import lakes as L
from limnos.operators import profiles as P
from limnos.plans.isotopes import mixtures, single
from limnos.plans.registry import registry
from limnos.sources import domain as D

QUERIES, ORACLE, query = registry()

_ACD = f"WITH {D.WATER}"
_F = lambda x: f"CAST(({x})::FLOAT AS DOUBLE)"


def acd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.sample_results(D.water_results(spark, sf_dir), D.water_samples(spark, sf_dir))


@query("wide_metric_means", _ACD + """ SELECT "WATER", """ + ", ".join(
    _F(f"""avg("VALUE_1") FILTER (WHERE "METRIC" = '{m}')""") + f' AS "{m}"' for m in D.PART_TYPES) + """ FROM acd WHERE "YEAR" > 1996 GROUP BY 1""")
def wide_metric_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return single(L.wide_chemistry(acd(spark, sf_dir), D.PART_TYPES, 1996), *D.PART_TYPES)


_SECCHI = _ACD + f""",
depth AS (SELECT "WATER", CASE WHEN "MONTH" > 7 THEN 'fall' ELSE 'spring' END AS season, avg("VALUE_1") AS sechi_depth
          FROM acd WHERE "METRIC" = 'STANDARD' AND "YEAR" > 1996 GROUP BY 1, 2),
ord AS (SELECT replace(n_name, '_', '') AS "WATER", CASE WHEN month(o_orderdate) > 7 THEN 'fall' ELSE 'spring' END AS season, o_orderstatus AS color,
        o_totalprice / 100000 AS d, o_orderpriority AS pr FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
colours AS (SELECT DISTINCT "WATER", season, color AS sechi_color, CASE color WHEN 'F' THEN 3.0 ELSE 7.0 END AS "FUI_num" FROM ord WHERE color <> 'P'),
survey AS (SELECT "WATER", season, d AS sechi_depth, color AS sechi_color FROM ord WHERE pr = '1-URGENT'),
un AS (SELECT s."WATER", s.season, s.sechi_depth, coalesce(c."FUI_num", 15) AS "FUI_num" FROM survey s
         LEFT JOIN (SELECT DISTINCT lower(sechi_color) AS sc, "FUI_num" FROM colours) c ON c.sc = lower(s.sechi_color)
       UNION ALL
       SELECT d."WATER", d.season, d.sechi_depth, c.f FROM depth d LEFT JOIN (SELECT "WATER", season, avg("FUI_num") AS f FROM colours GROUP BY 1, 2) c
         USING ("WATER", season)),
secchi AS (SELECT "WATER" || '.' || season AS "ID", * FROM un WHERE "WATER" || '.' || season NOT IN ('NATION1.spring', 'NATION2.spring')
           UNION ALL SELECT 'HTL.fall', 'HTL', 'fall', 4.5, 15)"""


def secchi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order status as water colour, urgent orders as the survey."""
    orders = D.table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderstatus", "o_totalprice", "o_orderpriority")
    customers = D.table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nations = D.table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    rows = (orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
            .select(F.replace("n_name", F.lit("_"), F.lit("")).alias("WATER"), C.season(F.month("o_orderdate")).alias("season"),
                    F.col("o_orderstatus").alias("sechi_color"), (F.col("o_totalprice") / 100000).alias("sechi_depth"), "o_orderpriority"))
    colours = rows.where("sechi_color <> 'P'").select("WATER", "season", "sechi_color",
                                                      F.when(F.col("sechi_color") == "F", 3.0).otherwise(7.0).alias("FUI_num")).distinct()
    survey = rows.where("o_orderpriority = '1-URGENT'").select("WATER", "season", "sechi_depth", "sechi_color")
    return L.seasonal_secchi(acd(spark, sf_dir), colours, survey, "STANDARD", 1996, ["NATION1.spring", "NATION2.spring"])


@query("seasonal_secchi", _SECCHI + f""" SELECT "ID", "WATER", season, {_F('sechi_depth')} AS sechi_depth, "FUI_num" FROM secchi""")
def seasonal_secchi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return single(secchi(spark, sf_dir), "sechi_depth")


def _profile_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Thermocline and oxycline tables of the event profiles, keyed like lake-seasons by user."""
    rows = D.profiles(spark, sf_dir)
    g = P.profile_gradient(rows.select("ID", "depth", "temp"), "ID", "depth", "temp")
    thermo = P.gradient_layer(g, "ID", "depth")
    oxy = P.level_crossing_or_bottom(rows, "ID", "depth", "DO", 5.0, "DDO5")
    name = F.concat(F.lit("NATION"), (F.col("ID") % 25).cast("string"), F.when(F.col("ID") % 2 == 0, ".spring").otherwise(".fall"))
    return thermo.withColumn("ID", name), oxy.withColumn("ID", name)


_LAKES = _SECCHI + f""", {D.PROFILES},
g AS (SELECT "ID" AS u, depth, (temp - lag(temp) OVER w) / (depth - lag(depth) OVER w) AS grad FROM profiles WINDOW w AS (PARTITION BY "ID" ORDER BY depth)),
gm AS (SELECT u, max(abs(grad)) AS m FROM g GROUP BY 1),
th AS (SELECT u, min(depth) FILTER (WHERE abs(grad) = m) AS mid_depth, max(depth) FILTER (WHERE abs(grad) >= 0.5 * m) AS bottom FROM g JOIN gm USING (u) GROUP BY 1),
s5 AS (SELECT "ID" AS u, y AS y0, x AS x0, lead(y) OVER w AS y1, lead(x) OVER w AS x1 FROM (SELECT "ID", "DO" AS y, avg(depth) AS x FROM profiles GROUP BY 1, 2)
       WINDOW w AS (PARTITION BY "ID" ORDER BY y)),
ox AS (SELECT u, coalesce(max(CASE WHEN y0 = 5 THEN x0 WHEN y0 < 5 AND y1 > 5 THEN x0 + (5 - y0) * (x1 - x0) / (y1 - y0) END), max(deep)) AS "DDO5"
       FROM s5 JOIN (SELECT "ID" AS u, max(depth) AS deep FROM profiles GROUP BY 1) USING (u) GROUP BY 1),
nm AS (SELECT u, 'NATION' || (u % 25) || CASE WHEN u % 2 = 0 THEN '.spring' ELSE '.fall' END AS "ID" FROM ox),
tc AS (SELECT nm."ID", mid_depth, bottom FROM th JOIN nm USING (u)), oc AS (SELECT nm."ID", "DDO5" FROM ox JOIN nm USING (u)),
ag AS (SELECT "ID", avg(mid_depth) AS mid_depth, avg(bottom) AS bottom FROM tc GROUP BY 1), oa AS (SELECT "ID", avg("DDO5") AS "DDO5" FROM oc GROUP BY 1),
{D.CHEMISTRY}, doc AS (SELECT "WATER" || '.' || season AS "ID", "DOC_update" FROM chemistry),
morph AS (SELECT DISTINCT replace(n_name, '_', '') AS "WATER", n_nationkey AS "Pond_num", lower(n_name) AS "Lake", n_regionkey * 10.0::DOUBLE AS "Elevation" FROM nation)"""


def lake_inputs(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    thermo, oxy = _profile_tables(spark, sf_dir)
    nations = D.table(spark, sf_dir, "nation")
    return {
        "thermocline": thermo.groupBy("ID").agg(F.avg("mid_depth").alias("mid_depth"), F.avg("bottom").alias("bottom")),
        "oxycline": oxy.groupBy("ID").agg(F.avg("DDO5").alias("DDO5")),
        "doc": D.lake_chemistry(spark, sf_dir).select(C.unite(".", "WATER", "season").alias("ID"), "DOC_update"),
        "morphology": nations.select(F.replace("n_name", F.lit("_"), F.lit("")).alias("WATER"), F.col("n_nationkey").alias("Pond_num"),
                                     F.lower("n_name").alias("Lake"), (F.col("n_regionkey") * 10).cast("double").alias("Elevation"),
                                     F.lit(None).cast("double").alias("max_depth"), F.lit(1.0).alias("Volume"))}


@query("lake_season_table", _LAKES + f"""
SELECT oa."ID", "WATER", season, {_F('"DDO5"')} AS "DDO5", {_F('sechi_depth')} AS sechi_depth, "FUI_num", {_F('mid_depth')} AS mid_depth,
       {_F('bottom')} AS bottom, {_F('"DOC_update"')} AS "DOC_update", "Lake", "Elevation"
FROM oa LEFT JOIN secchi USING ("ID") LEFT JOIN ag USING ("ID") LEFT JOIN doc USING ("ID") LEFT JOIN morph USING ("WATER")""")
def lake_season_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = lake_inputs(spark, sf_dir)
    out = L.compile_lake_table(i["oxycline"], secchi(spark, sf_dir), i["thermocline"], i["doc"], i["morphology"])
    return single(out.select("ID", "WATER", "season", "DDO5", "sechi_depth", "FUI_num", "mid_depth", "bottom", "DOC_update", "Lake", "Elevation"),
                  "DDO5", "sechi_depth", "mid_depth", "bottom", "DOC_update")


@query("merge_profile_metrics", _LAKES + f""",
base AS (SELECT "WATER", s.season, "Lake", "WATER" || '.' || s.season AS community FROM morph, (VALUES ('spring'), ('fall')) AS s(season))
SELECT community, "WATER", season, "Lake", {_F('mid_depth')} AS mid_depth, {_F('bottom')} AS bottom, {_F('"DDO5"')} AS "DDO5"
FROM base LEFT JOIN ag ON ag."ID" = community LEFT JOIN oa ON oa."ID" = community""")
def merge_profile_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = lake_inputs(spark, sf_dir)
    old = i["morphology"].select("WATER", "Lake", F.explode(F.array(F.lit("spring"), F.lit("fall"))).alias("season"),
                                 F.lit(0.0).alias("DDO5"), F.lit(0.0).alias("TDO5"))
    return single(L.merge_profile_metrics(old, i["thermocline"], i["oxycline"]), "mid_depth", "bottom", "DDO5").select(
        "community", "WATER", "season", "Lake", "mid_depth", "bottom", "DDO5")


@query("metric_coverage", _ACD + """,
t AS (SELECT *, count(*) OVER (PARTITION BY "WATER", "METRIC") AS total_observations FROM acd),
l AS (SELECT "METRIC", count(DISTINCT "WATER") AS total_lakes FROM acd GROUP BY 1)
SELECT "WATER", "METRIC", total_observations, total_lakes, count(*) AS n FROM t JOIN l USING ("METRIC")
WHERE total_observations > 3 AND total_lakes > 3 AND "METRIC" <> 'PROMO' GROUP BY 1, 2, 3, 4""")
def metric_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = L.metric_coverage(acd(spark, sf_dir), skip=["PROMO"])
    return rows.groupBy("WATER", "METRIC", "total_observations", "total_lakes").agg(F.count(F.lit(1)).alias("n"))


@query("first_years", _ACD + """ SELECT "WATER", min("YEAR") AS min_year FROM acd WHERE "METRIC" = 'SMALL' GROUP BY 1""")
def first_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.first_years(acd(spark, sf_dir), "SMALL")


@query("metric_units", _ACD + """ SELECT DISTINCT "METRIC", "UNIT_1" FROM acd""")
def metric_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.metric_units(acd(spark, sf_dir))


@query("unknown_lakes", f"""WITH {D.CHEMISTRY} SELECT "WATER", season FROM chemistry WHERE "WATER" NOT IN
       (SELECT replace(n_name, '_', '') FROM nation JOIN supplier ON s_nationkey = n_nationkey WHERE s_acctbal > 9000)""")
def unknown_lakes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = D.table(spark, sf_dir, "nation")
    rich = D.table(spark, sf_dir, "supplier").where("s_acctbal > 9000").select(F.col("s_nationkey").alias("n_nationkey"))
    known = nations.join(rich, "n_nationkey").select(F.replace("n_name", F.lit("_"), F.lit("")).alias("WATER"))
    return L.unknown_lakes(D.lake_chemistry(spark, sf_dir).select("WATER", "season"), known)


_GAP = f"""WITH {D.BASELINES}, {D.CLUSTERS},
b AS (SELECT community, max(mean_c) FILTER (WHERE source = 'PERI') AS p, max(mean_c) FILTER (WHERE source = 'ZOOP') AS z,
      max(mean_c) FILTER (WHERE source = 'LEAF') AS l FROM baselines GROUP BY 1),
gap AS (SELECT b.*, abs(z - p) AS dif, cluster FROM b JOIN clusters ON "WATER" || '.' || season = community)"""


def gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    clusters = D.community_clusters(spark, sf_dir).select(C.unite(".", "WATER", "season").alias("community"), "cluster")
    return L.baseline_gap(D.baselines(spark, sf_dir), clusters)


@query("baseline_gap", _GAP + f""" SELECT community, cluster, {_F('dif')} AS dif FROM gap""")
def baseline_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return single(gaps(spark, sf_dir).select("community", "cluster", "dif"), "dif")


@query("baseline_gap_by_cluster", _GAP + f""" SELECT cluster, {_F('avg(dif)')} AS dif FROM gap GROUP BY 1""")
def baseline_gap_by_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return single(L.baseline_gap_by_cluster(gaps(spark, sf_dir)), "dif")


@query("family_gap", _GAP + f""", {D.MIXTURES},
m AS (SELECT community, group_name, avg(iso1) AS mean FROM mixtures WHERE "ORDER" = 'brand1' AND group_name <> 'brand11' GROUP BY 1, 2)
SELECT community, cluster, {_F('avg(abs(z - mean))')} AS gap FROM m JOIN gap USING (community) GROUP BY 1, 2""")
def family_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return single(L.family_gap(mixtures(spark, sf_dir), gaps(spark, sf_dir), "brand1", ["brand11"]), "gap")


@query("lake_table", f"""WITH {D.CHEMISTRY}
SELECT DISTINCT CASE "WATER" WHEN 'NATION0' THEN 'Lake Zero' WHEN 'NATION7' THEN 'Lake Seven' END AS water,
       CASE season WHEN 'spring' THEN 'Early' ELSE 'Late' END AS season, max_depth, {_F('"DOC_update"')} AS "DOC_update" FROM chemistry""")
def lake_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.lake_chemistry(spark, sf_dir).select("WATER", "season", "max_depth", "DOC_update")
    return single(L.lake_table(rows, {"NATION0": "Lake Zero", "NATION7": "Lake Seven"}), "DOC_update")
