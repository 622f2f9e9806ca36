"""Registered queries on community composition."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from limnos.operators import community as K
from limnos.operators import dissimilarity as S
from limnos.operators import permanova as A
from limnos.operators.permutations import numbered
from limnos.plans.registry import registry
from limnos.session import staged
from limnos.sources import domain as D

QUERIES, ORACLE, query = registry()

_VALID = """"FAMILY" NOT IN ('unidentified', 'degraded', 'terrestrial')"""
_FALL = f"""WITH {D.SPECIMENS}, {D.SITE_LABELS},
pres AS (SELECT DISTINCT "WATER", "FAMILY" FROM specimens WHERE "MONTH" = 'FALL' AND {_VALID})"""


def fall_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.presence_table(D.specimens(spark, sf_dir), ["WATER"], "FALL")


def labelled_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fall_presence(spark, sf_dir).join(D.site_labels(spark, sf_dir), "WATER")


@query("presence_long", _FALL + """ SELECT "WATER", "FAMILY" FROM pres""")
def presence_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fall_presence(spark, sf_dir)


@query("presence_by_site", f"""WITH {D.SPECIMENS}
SELECT DISTINCT "MONTH", "WATER", replace("SITE_N", ' ', '') AS "SITE_N", "FAMILY" FROM specimens WHERE {_VALID}""")
def presence_by_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.presence_table(D.specimens(spark, sf_dir), ["MONTH", "WATER", "SITE_N"])


@query("presence_two_seasons", f"""WITH {D.SPECIMENS}
SELECT DISTINCT "MONTH", "WATER", "FAMILY" FROM specimens WHERE {_VALID} AND "WATER" NOT IN (1, 2)
AND NOT ("WATER" = 3 AND "SITE_N" IN ('S 2', 'S 4'))""")
def presence_two_seasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.presence_table(D.specimens(spark, sf_dir), ["MONTH", "WATER"], skip_sites={3: ["S 2", "S 4"]}, skip_lakes=[1, 2])


@query("presence_wide", f"""WITH {D.SPECIMENS}
SELECT "MONTH", "WATER", """ + ", ".join(f"""max(CASE WHEN "ORDER" = '{t.lower()}' THEN 1 ELSE 0 END) AS {t.lower()}""" for t in D.PART_TYPES)
       + f""" FROM specimens WHERE {_VALID} GROUP BY 1, 2""")
def presence_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.specimens(spark, sf_dir).where(~F.col("FAMILY").isin(K.INVALID_FAMILIES))
    orders = rows.select("MONTH", "WATER", "ORDER").distinct()
    return K.presence_matrix(orders, ["MONTH", "WATER"], "ORDER", [t.lower() for t in D.PART_TYPES])


@query("prune_taxa", f"""WITH {D.SPECIMENS},
pres AS (SELECT DISTINCT "MONTH", "ORDER", "FAMILY" FROM specimens WHERE {_VALID}),
n AS (SELECT count(DISTINCT ("MONTH", "ORDER")) AS sites FROM pres),
c AS (SELECT "FAMILY", count(*) AS k FROM pres GROUP BY 1)
SELECT "MONTH", "ORDER", "FAMILY" FROM pres JOIN c USING ("FAMILY"), n WHERE k < sites""")
def prune_taxa(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.specimens(spark, sf_dir).where(~F.col("FAMILY").isin(K.INVALID_FAMILIES))
    return K.prune_taxa(rows.select("MONTH", "ORDER", "FAMILY").distinct(), ["MONTH", "ORDER"], "FAMILY")


_LOOKUP = """lookup AS (
  SELECT DISTINCT 'ORDER' AS grp, p_type AS code, CASE p_type WHEN 'PROMO' THEN 'Amphipoda' WHEN 'SMALL' THEN 'Isopoda'
         WHEN 'LARGE' THEN 'Collembola' ELSE p_type END AS id FROM part
  UNION ALL
  SELECT DISTINCT 'FAMILY', p_brand, CASE p_brand WHEN 'Brand#1' THEN 'Agriidae' WHEN 'Brand#2' THEN 'Muscidae' ELSE p_brand END
  FROM part WHERE p_brand <> 'Brand#3'),
survey AS (
  SELECT o_custkey AS "PONDNO", l_linenumber AS "NMETHOD", p_type AS "ORDER", p_brand AS "FAMILY"
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
named AS (SELECT s.*, o.id AS "ORDER_full", f.id AS f FROM survey s
  LEFT JOIN lookup o ON o.grp = 'ORDER' AND o.code = s."ORDER" LEFT JOIN lookup f ON f.grp = 'FAMILY' AND f.code = s."FAMILY"),
recoded AS (SELECT "PONDNO", "NMETHOD", "ORDER_full", CASE WHEN "ORDER_full" = 'Amphipoda' THEN 'Amphipoda.unsp'
    WHEN "ORDER_full" = 'Isopoda' THEN 'Isopoda.unsp' WHEN f = 'Agriidae' THEN 'Calopterygidae' ELSE f END AS "FAMILY_full" FROM named),
kept AS (SELECT * FROM recoded WHERE "FAMILY_full" <> 'Muscidae' AND "ORDER_full" <> 'Collembola')"""


def survey(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Survey rows after the recode: parts as taxa, line numbers as methods, customers as ponds."""
    parts = D.table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_brand")
    lines = D.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    orders = D.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    rows = (lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
            .join(parts, F.col("l_partkey") == F.col("p_partkey"))
            .select(F.col("o_custkey").alias("PONDNO"), F.col("l_linenumber").alias("NMETHOD"),
                    F.col("p_type").alias("ORDER"), F.col("p_brand").alias("FAMILY")))
    order_id = (F.when(F.col("p_type") == "PROMO", "Amphipoda").when(F.col("p_type") == "SMALL", "Isopoda")
                .when(F.col("p_type") == "LARGE", "Collembola").otherwise(F.col("p_type")))
    family_id = F.when(F.col("p_brand") == "Brand#1", "Agriidae").when(F.col("p_brand") == "Brand#2", "Muscidae").otherwise(F.col("p_brand"))
    lookup = (parts.select(F.lit("ORDER").alias("TAXONOMIC_GROUP"), F.col("p_type").alias("CODE"), order_id.alias("TAXONOMIC_ID"))
              .unionByName(parts.where("p_brand <> 'Brand#3'").select(
                  F.lit("FAMILY").alias("TAXONOMIC_GROUP"), F.col("p_brand").alias("CODE"), family_id.alias("TAXONOMIC_ID"))))
    return K.taxonomic_recode(rows, lookup).select("PONDNO", "NMETHOD", "ORDER_full", "FAMILY_full")


@query("taxonomic_recode", f"""WITH {_LOOKUP}
SELECT "NMETHOD", "ORDER_full", "FAMILY_full", count(*) AS n FROM kept GROUP BY 1, 2, 3""")
def taxonomic_recode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survey(spark, sf_dir).groupBy("NMETHOD", "ORDER_full", "FAMILY_full").agg(F.count(F.lit(1)).alias("n"))


@query("occurrence_filter", f"""WITH {_LOOKUP},
p AS (SELECT DISTINCT "PONDNO", "FAMILY_full" FROM kept WHERE "NMETHOD" = 1),
c AS (SELECT * FROM p QUALIFY count(*) OVER (PARTITION BY "FAMILY_full") > 100),
r AS (SELECT * FROM c QUALIFY count(*) OVER (PARTITION BY "PONDNO") >= 3)
SELECT * FROM r WHERE "PONDNO" IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)""")
def occurrence_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = D.table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("PONDNO"))
    return K.occurrence_filter(survey(spark, sf_dir), "PONDNO", "FAMILY_full", 100, 3, F.col("NMETHOD") == 1, known_sites=known)


@query("method_profile", f"""WITH {_LOOKUP}
SELECT "NMETHOD", count(*) AS count, (SELECT count(DISTINCT "FAMILY_full") FROM kept k2 WHERE k2."NMETHOD" = kept."NMETHOD") AS families
FROM kept GROUP BY 1""")
def method_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts, families = K.method_profile(survey(spark, sf_dir), "NMETHOD", "FAMILY_full")
    return counts.join(families.groupBy("NMETHOD").agg(F.count(F.lit(1)).alias("families")), "NMETHOD")


@query("taxon_hierarchy", f"""WITH {D.SPECIMENS} SELECT DISTINCT "FAMILY", "GENUS" FROM specimens""")
def taxon_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.taxon_hierarchy(D.specimens(spark, sf_dir), "FAMILY", "GENUS")


@query("richness", f"""WITH {D.SPECIMENS}
SELECT "WATER", "MONTH", count(DISTINCT "FAMILY") AS richness FROM specimens GROUP BY 1, 2""")
def richness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.richness(D.specimens(spark, sf_dir), ["WATER", "MONTH"], "FAMILY")


@query("richness_metrics", f"""WITH {D.SPECIMENS},
r AS (SELECT "WATER", count(DISTINCT "FAMILY")::DOUBLE AS richness FROM specimens GROUP BY 1),
j AS (SELECT "WATER", richness, c_acctbal AS acctbal, CASE WHEN c_nationkey > 3 THEN c_nationkey::DOUBLE END AS nation FROM r LEFT JOIN customer ON c_custkey = "WATER")
SELECT "WATER", metric, value FROM j UNPIVOT (value FOR metric IN (richness, acctbal, nation))""")
def richness_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = K.richness(D.specimens(spark, sf_dir), ["WATER"], "FAMILY")
    chemistry = D.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("WATER"), F.col("c_acctbal").alias("acctbal"), F.when(F.col("c_nationkey") > 3, F.col("c_nationkey")).alias("nation"))
    return K.richness_metrics(counts, chemistry, ["WATER"], ["acctbal", "nation"])


_TWO = f"""WITH {D.SPECIMENS},
pres AS (SELECT DISTINCT "MONTH", "WATER", "FAMILY" FROM specimens WHERE {_VALID}),
size AS (SELECT "MONTH", "WATER", count(*) AS n FROM pres GROUP BY 1, 2),
pair AS (SELECT a."WATER", a.n AS n1, b.n AS n2, (SELECT count(*) FROM pres x JOIN pres y USING ("WATER", "FAMILY")
                WHERE x."WATER" = a."WATER" AND x."MONTH" = 'SPRING' AND y."MONTH" = 'FALL') AS s
         FROM size a JOIN size b USING ("WATER") WHERE a."MONTH" = 'SPRING' AND b."MONTH" = 'FALL')
"""


def _season_pairs(spark: SparkSession, sf_dir: str, method: str) -> DataFrame:
    presence = K.presence_table(D.specimens(spark, sf_dir), ["MONTH", "WATER"])
    sets = S.site_sets(presence.withColumn("ID", F.concat_ws("_", "MONTH", "WATER")), ["ID"], "FAMILY")
    waters = D.site_labels(spark, sf_dir).select(
        "WATER", F.concat_ws("_", F.lit("SPRING"), "WATER").alias("a"), F.concat_ws("_", F.lit("FALL"), "WATER").alias("b"))
    return S.pair_dissimilarity(sets, waters, "ID", "a", "b", method).select("WATER", F.round("d", 9).alias("d"))


@query("jaccard_pairs", _TWO + """SELECT "WATER", round((n1 + n2 - 2 * s) / (n1 + n2 - s), 9) AS d FROM pair""")
def jaccard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _season_pairs(spark, sf_dir, "jaccard")


@query("bray_pairs", _TWO + """SELECT "WATER", round((n1 + n2 - 2 * s) / (n1 + n2), 9) AS d FROM pair""")
def bray_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _season_pairs(spark, sf_dir, "bray")


@query("bray_abundance", f"""WITH {D.SPECIMENS},
c AS (SELECT "WATER", "FAMILY", count(*) FILTER (WHERE "MONTH" = 'SPRING') AS x, count(*) FILTER (WHERE "MONTH" = 'FALL') AS y
      FROM specimens WHERE {_VALID} GROUP BY 1, 2)
SELECT "WATER", round(sum(abs(x - y)) / sum(x + y), 9) AS d FROM c GROUP BY 1 HAVING sum(x) > 0 AND sum(y) > 0""")
def bray_abundance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = D.specimens(spark, sf_dir).where(~F.col("FAMILY").isin(K.INVALID_FAMILIES))
    counts = rows.groupBy("WATER", "MONTH", "FAMILY").agg(F.count(F.lit(1)).alias("k"))
    return S.abundance_dissimilarity(counts, ["WATER"], "MONTH", "SPRING", "FALL", "FAMILY", "k").select("WATER", F.round("d", 9).alias("d"))


@query("landmark_jaccard", _FALL + """,
size AS (SELECT "WATER", count(*) AS n FROM pres GROUP BY 1),
mark AS (SELECT "WATER" AS landmark, n AS nl FROM size ORDER BY n DESC, "WATER" LIMIT 12),
s AS (SELECT p."WATER", l."WATER" AS landmark, count(*) AS s FROM pres p JOIN pres l USING ("FAMILY") GROUP BY 1, 2)
SELECT "WATER", landmark, round((n + nl - 2 * coalesce(s, 0)) / (n + nl - coalesce(s, 0)), 9) AS d
FROM size CROSS JOIN mark LEFT JOIN s USING ("WATER", landmark)""")
def landmark_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    presence = fall_presence(spark, sf_dir)
    marks = S.site_sets(presence, ["WATER"], "FAMILY").orderBy(F.col("n").desc(), "WATER").limit(12)
    return S.landmark_dissimilarity(presence, marks, "WATER", "FAMILY", "jaccard").select("WATER", "landmark", F.round("d", 9).alias("d"))


_PAIRS = _FALL + """,
s0 AS (SELECT "WATER", cluster, count(*) AS n FROM pres JOIN site_labels USING ("WATER") GROUP BY 1, 2),
sh AS (SELECT a."WATER" AS i, b."WATER" AS j, count(*) AS s FROM pres a JOIN pres b USING ("FAMILY") WHERE a."WATER" < b."WATER" GROUP BY 1, 2),
d AS (SELECT a.cluster AS c1, b.cluster AS c2, pow(1 - 2 * coalesce(s, 0) / (a.n + b.n), 2) AS d2
      FROM s0 a JOIN s0 b ON a."WATER" < b."WATER" LEFT JOIN sh ON i = a."WATER" AND j = b."WATER"),
g AS (SELECT cluster, count(*) AS k FROM s0 GROUP BY 1),
t AS (SELECT (SELECT sum(d2) FROM d) / (SELECT count(*) FROM s0) AS sst,
             (SELECT sum(x / k) FROM (SELECT c1 AS cluster, sum(d2) AS x FROM d WHERE c1 = c2 GROUP BY 1) JOIN g USING (cluster)) AS ssw,
             (SELECT count(*) FROM g) AS a, (SELECT count(*) FROM s0) AS n)"""


@query("permanova_f", _PAIRS + """
SELECT round(sst, 6) AS ss_total, round(ssw, 6) AS ss_within, a AS groups, n AS sites, round((sst - ssw) / sst, 8) AS r2,
       round(((sst - ssw) / (a - 1)) / (ssw / (n - a)), 6) AS f FROM t""")
def permanova_f(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = S.site_sets(labelled_presence(spark, sf_dir), ["WATER", "cluster"], "FAMILY")
    return S.permanova(sets, "cluster").select(
        F.round("ss_total", 6).alias("ss_total"), F.round("ss_within", 6).alias("ss_within"), "groups", "sites",
        F.round("r2", 8).alias("r2"), F.round("f", 6).alias("f"))


_SETS = f"""WITH {D.SPECIMENS}, {D.SITE_LABELS},
pres AS (SELECT DISTINCT "WATER", "MONTH", "FAMILY" FROM specimens WHERE {_VALID}),
st AS (SELECT "WATER", "MONTH", cluster, list(DISTINCT "FAMILY") AS taxa, count(*) AS n FROM pres JOIN site_labels USING ("WATER") GROUP BY 1, 2, 3),
d2 AS (SELECT a."WATER" AS w1, b."WATER" AS w2, a."MONTH" AS m1, b."MONTH" AS m2, a.cluster AS c1, b.cluster AS c2,
              pow(1 - 2.0 * len(list_intersect(a.taxa, b.taxa)) / (a.n + b.n), 2) AS d FROM st a, st b),
nn AS (SELECT count(*) AS n FROM st),
z AS (SELECT cluster, count(*) AS k FROM st GROUP BY 1),
zm AS (SELECT cluster, "MONTH", count(*) AS k FROM st GROUP BY 1, 2),
v AS (SELECT (SELECT sum(d) / 2 / n FROM d2, nn GROUP BY n) AS total,
             (SELECT sum(s / 2 / k) FROM (SELECT c1, sum(d) AS s FROM d2 WHERE c1 = c2 GROUP BY 1) JOIN z ON c1 = cluster) AS within_c,
             (SELECT sum(s / 2 / k) FROM (SELECT c1, m1, sum(d) AS s FROM d2 WHERE c1 = c2 AND m1 = m2 GROUP BY 1, 2)
              JOIN zm ON c1 = cluster AND m1 = "MONTH") AS within_cm, (SELECT count(*) FROM z) AS kc, (SELECT count(*) FROM zm) AS kcm, n FROM nn),
t AS (SELECT 'cluster' AS term, kc - 1 AS df, total - within_c AS ss, total, within_cm / (n - kcm) AS ms FROM v
      UNION ALL SELECT 'cluster:MONTH', kcm - kc, within_c - within_cm, total, within_cm / (n - kcm) FROM v
      UNION ALL SELECT 'residual', n - kcm, within_cm, total, NULL FROM v)
SELECT term, CAST(df AS INT) AS df, round(ss, 6) AS ss, round(ss / total, 8) AS r2, round(ss / df / ms, 6) AS f FROM t"""


def _season_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    presence = K.presence_table(D.specimens(spark, sf_dir), ["WATER", "MONTH"]).join(D.site_labels(spark, sf_dir), "WATER")
    return S.site_sets(presence, ["WATER", "MONTH", "cluster"], "FAMILY")


@query("permanova_nested", _SETS)
def permanova_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = A.permanova_terms(_season_sets(spark, sf_dir), ["cluster", "cluster:MONTH"])
    return out.select("term", "df", F.round("ss", 6).alias("ss"), F.round("r2", 8).alias("r2"), F.round("f", 6).alias("f"))


@query("permanova_terms")
def permanova_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.permanova_terms(_season_sets(spark, sf_dir), ["WATER", "cluster", "MONTH"])


@query("permanova_listed", f"""WITH {D.SPECIMENS},
p AS (SELECT DISTINCT c_nationkey AS site, "GENUS" FROM specimens JOIN customer ON c_custkey = "WATER"),
s AS (SELECT site, site % 3 AS cluster, list("GENUS") AS taxa, count(*) AS n FROM p GROUP BY 1, 2),
d AS (SELECT a.cluster AS c1, b.cluster AS c2, pow(1 - len(list_intersect(a.taxa, b.taxa)) / (a.n + b.n - len(list_intersect(a.taxa, b.taxa))), 2) AS d2 FROM s a JOIN s b ON a.site < b.site),
z AS (SELECT cluster, count(*) AS k FROM s GROUP BY 1),
t AS (SELECT (SELECT sum(d2) FROM d) / (SELECT count(*) FROM s) AS sst, (SELECT sum(d2 / k) FROM d JOIN z ON cluster = c1 WHERE c1 = c2) AS ssw,
             (SELECT count(*) FROM z) AS g, (SELECT count(*) FROM s) AS n)
SELECT round(sst, 8) AS ss_total, round(ssw, 8) AS ss_within, g AS groups, n AS sites, round((sst - ssw) / sst, 8) AS r2, round(((sst - ssw) / (g - 1)) / (ssw / (n - g)), 6) AS f FROM t""")
def permanova_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jaccard distances of a short list of sites (nations), each pair listed once."""
    customers = D.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("WATER"), F.col("c_nationkey").alias("site"))
    presence = D.specimens(spark, sf_dir).join(customers, "WATER").select("site", "GENUS").distinct()
    sets = S.site_sets(presence, ["site"], "GENUS")
    nations = D.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("site")).join(sets.select("site"), "site", "left_semi")
    listed = nations.select(F.col("site").alias("i"), F.explode(F.sequence(F.col("site") + 1, F.lit(24).cast("long"))).alias("j")).where("j > i AND j < 25")
    pairs = S.pair_dissimilarity(sets, listed, "site", "i", "j", "jaccard")
    out = S.permanova_pairs(pairs, nations.withColumn("cluster", F.col("site") % 3), "site", "cluster", "i", "j", "d")
    return out.select(F.round("ss_total", 8).alias("ss_total"), F.round("ss_within", 8).alias("ss_within"), "groups", "sites", F.round("r2", 8).alias("r2"), F.round("f", 6).alias("f"))


_JACCARD = _SETS[:_SETS.index("d2 AS")] + """
d2 AS (SELECT a."WATER" AS w1, b."WATER" AS w2, a."MONTH" AS m1, b."MONTH" AS m2,
              pow(1 - len(list_intersect(a.taxa, b.taxa)) / (a.n + b.n - len(list_intersect(a.taxa, b.taxa))), 2) AS d FROM st a, st b),
q AS (SELECT "WATER", "MONTH", ("MONTH" = 'FALL')::DOUBLE - avg(("MONTH" = 'FALL')::INT) OVER (PARTITION BY "WATER") AS x FROM st),
z AS (SELECT "WATER", count(*) AS k FROM st GROUP BY 1),
v AS (SELECT (SELECT count(*) FROM st) AS n, (SELECT count(*) FROM z) AS k, (SELECT sum(x * x) FROM q) AS qq, (SELECT sum(d) FROM d2) AS s,
             (SELECT sum(d / 2 / k) FROM d2 JOIN z ON "WATER" = w1 WHERE w1 = w2) AS within,
             (SELECT -0.5 * sum(a.x * b.x * d) FROM d2 JOIN q a ON a."WATER" = w1 AND a."MONTH" = m1 JOIN q b ON b."WATER" = w2 AND b."MONTH" = m2) AS form),
t AS (SELECT n, k, s / 2 / n AS total, s / 2 / n - within AS water, form / qq AS month FROM v),
u AS (SELECT 'WATER' AS term, k - 1 AS df, water AS ss, total, (total - water - month) / (n - k - 1) AS ms FROM t
      UNION ALL SELECT 'cluster', 0, 0, total, NULL FROM t UNION ALL SELECT 'MONTH', 1, month, total, (total - water - month) / (n - k - 1) FROM t
      UNION ALL SELECT 'residual', n - k - 1, total - water - month, total, NULL FROM t)
SELECT term, CAST(df AS INT) AS df, round(ss, 6) + 0 AS ss, round(ss / total, 8) + 0 AS r2, round(ss / df / ms, 6) AS f FROM u"""


@query("permanova_terms_jaccard", _JACCARD)
def permanova_terms_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = A.permanova_terms(_season_sets(spark, sf_dir), ["WATER", "cluster", "MONTH"], "jaccard")
    return out.select("term", "df", (F.round("ss", 6) + 0.0).alias("ss"), (F.round("r2", 8) + 0.0).alias("r2"), F.round("f", 6).alias("f"))


def _p_sql(distance: str) -> str:
    return _FALL + f""",
s0 AS (SELECT "WATER", cluster, list("FAMILY") AS taxa, count(*) AS n FROM pres JOIN site_labels USING ("WATER") GROUP BY 1, 2),
num AS (SELECT *, row_number() OVER (ORDER BY "WATER") - 1 AS at, row_number() OVER (ORDER BY cluster) - 1 AS place, count(*) OVER () AS sites FROM s0),
d AS (SELECT a.at AS i, b.at AS j, pow({distance}, 2) AS d2
      FROM (SELECT a.at, a.n, b.at AS other, b.n AS m, len(list_intersect(a.taxa, b.taxa)) AS s FROM num a JOIN num b ON a.at < b.at) a JOIN num b ON b.at = a.other),
mv AS (SELECT 0 AS perm, num.at, cluster FROM num
       UNION ALL SELECT p.perm, a.at, b.cluster FROM num a, (SELECT unnest(range(1, 41)) AS perm) p JOIN num b ON b.place = (a.at + 7 * p.perm) % a.sites),
z AS (SELECT cluster, count(*) AS k FROM num GROUP BY 1),
w AS (SELECT x.perm, sum(d2 / k) AS ssw FROM mv x JOIN d ON i = x.at JOIN mv y ON y.perm = x.perm AND y.at = j AND y.cluster = x.cluster JOIN z ON z.cluster = x.cluster GROUP BY 1),
t AS (SELECT (SELECT sum(d2) FROM d) / count(*) AS sst, count(*) AS n, (SELECT count(*) FROM z) AS g FROM num),
f AS (SELECT perm, ssw, sst, n, g, ((sst - ssw) / (g - 1)) / (ssw / (n - g)) AS f FROM w, t),
p AS (SELECT (1 + count(*) FILTER (WHERE perm > 0 AND f >= (SELECT f - 1e-9 FROM f WHERE perm = 0))) / 41 AS p FROM f)
SELECT 'cluster' AS term, CAST(g - 1 AS INT) AS df, round(sst - ssw, 6) AS ss, round(f, 6) AS f, p FROM f, p WHERE perm = 0
UNION ALL SELECT 'residual', CAST(n - g AS INT), round(ssw, 6), NULL, NULL FROM f WHERE perm = 0"""


def _fall_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.site_sets(labelled_presence(spark, sf_dir), ["WATER", "cluster"], "FAMILY")


def _p_given(spark: SparkSession, sf_dir: str, method: str) -> DataFrame:
    """Labels move round by 7 sites for each of 40 permutations."""
    sets = staged(_fall_sets(spark, sf_dir))
    moved = numbered(sets.select("WATER"), ["WATER"]).withColumn("perm", F.explode(F.sequence(F.lit(1), F.lit(40))))
    ranks = moved.select("perm", "WATER", ((F.col("at") + 7 * F.col("perm")) % F.col("size")).alias("rank"))
    out = A.permanova_test(sets, "WATER", ["cluster"], ranks=ranks, method=method)
    return out.select("term", "df", F.round("ss", 6).alias("ss"), F.round("f", 6).alias("f"), "p")


@query("permanova_p", _p_sql("1 - 2.0 * a.s / (a.n + a.m)"))
def permanova_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _p_given(spark, sf_dir, "bray")


@query("permanova_p_jaccard", _p_sql("1 - a.s / (a.n + a.m - a.s)"))
def permanova_p_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _p_given(spark, sf_dir, "jaccard")


_TURN = """(at + perm // (1 + "WATER" % 7))"""
_P_BLOCKED = _SETS[:_SETS.index("d2 AS")] + f"""
num AS (SELECT *, row_number() OVER (PARTITION BY "WATER" ORDER BY "MONTH") - 1 AS at, count(*) OVER (PARTITION BY "WATER") AS size,
               row_number() OVER (ORDER BY "WATER", "MONTH") AS id FROM st),
d AS (SELECT a.id AS i, b.id AS j, a.cluster = b.cluster AS same, a.cluster AS c, pow(1 - 2.0 * len(list_intersect(a.taxa, b.taxa)) / (a.n + b.n), 2) AS d2
      FROM num a JOIN num b ON a.id < b.id),
mv AS (SELECT 0 AS perm, id, cluster, "MONTH" FROM num
       UNION ALL SELECT p.perm, a.id, a.cluster, b."MONTH" FROM (SELECT *, unnest(range(1, 41)) AS perm FROM num) a
       JOIN (SELECT unnest(range(1, 41)) AS perm) p USING (perm) JOIN num b ON b."WATER" = a."WATER" AND b.at = {_TURN.replace('at +', 'a.at +').replace('perm', 'p.perm').replace('"WATER"', 'a."WATER"')} % a.size),
z AS (SELECT cluster, count(*) AS k FROM num GROUP BY 1),
zm AS (SELECT cluster, "MONTH", count(*) AS k FROM num GROUP BY 1, 2),
c AS (SELECT sum(d2 / k) AS within_c FROM d JOIN z ON cluster = c WHERE same),
w AS (SELECT x.perm, sum(d2 / k) AS within_cm FROM d JOIN mv x ON x.id = i JOIN mv y ON y.id = j AND y.perm = x.perm AND y."MONTH" = x."MONTH"
      JOIN zm ON zm.cluster = x.cluster AND zm."MONTH" = x."MONTH" WHERE same GROUP BY 1),
t AS (SELECT (SELECT sum(d2) FROM d) / count(*) AS total, count(*) AS n, (SELECT count(*) FROM z) AS kc, (SELECT count(*) FROM zm) AS kcm FROM num),
f AS (SELECT *, (total - within_c) / (kc - 1) / (within_cm / (n - kcm)) AS f1, (within_c - within_cm) / (kcm - kc) / (within_cm / (n - kcm)) AS f2 FROM w, c, t),
o AS (SELECT * FROM f WHERE perm = 0),
p AS (SELECT (1 + count(*) FILTER (WHERE f.perm > 0 AND f.f1 >= o.f1 - 1e-9)) / 41 AS p1, (1 + count(*) FILTER (WHERE f.perm > 0 AND f.f2 >= o.f2 - 1e-9)) / 41 AS p2 FROM f, o)
SELECT 'cluster' AS term, CAST(kc - 1 AS INT) AS df, round(total - within_c, 6) AS ss, round(f1, 6) AS f, p1 AS p FROM o, p
UNION ALL SELECT 'cluster:MONTH', CAST(kcm - kc AS INT), round(within_c - within_cm, 6), round(f2, 6), p2 FROM o, p
UNION ALL SELECT 'residual', CAST(n - kcm AS INT), round(within_cm, 6), NULL, NULL FROM o"""


def _season_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _season_sets(spark, sf_dir).withColumn("ID", F.concat_ws("_", "WATER", "MONTH"))


@query("permanova_p_blocked", _P_BLOCKED)
def permanova_p_blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seasons change places inside a lake."""
    sets = staged(_season_ids(spark, sf_dir))
    moved = numbered(sets.select("ID", "WATER", "MONTH"), ["MONTH"], ["WATER"]).withColumn("perm", F.explode(F.sequence(F.lit(1), F.lit(40))))
    ranks = moved.select("perm", "ID", F.expr("""(at + perm div (1 + WATER % 7)) % size""").alias("rank"))
    out = A.permanova_test(sets, "ID", ["cluster", "cluster:MONTH"], blocks=["WATER"], ranks=ranks)
    return out.select("term", "df", F.round("ss", 6).alias("ss"), F.round("f", 6).alias("f"), "p")


@query("permanova_p_drawn")
def permanova_p_drawn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.permanova_test(_fall_sets(spark, sf_dir), "WATER", ["cluster"], 999)


@query("permanova_crossed_drawn")
def permanova_crossed_drawn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.permanova_test(_season_ids(spark, sf_dir), "ID", ["cluster", "MONTH", "cluster:MONTH"], 999, blocks=["WATER"], method="jaccard")


_SIMPER = _FALL + """,
k AS (SELECT "FAMILY" FROM pres GROUP BY 1 HAVING count(*) < (SELECT count(DISTINCT "WATER") FROM pres)),
p AS (SELECT "WATER", cluster, "FAMILY" FROM pres JOIN site_labels USING ("WATER") WHERE "FAMILY" IN (FROM k)),
sz AS (SELECT "WATER", cluster, count(*) AS n FROM p GROUP BY 1, 2),
h AS (SELECT cluster, n, "FAMILY", count(*) AS have FROM p JOIN sz USING ("WATER", cluster) GROUP BY 1, 2, 3),
lv AS (SELECT cluster, n, count(*) AS sites FROM sz GROUP BY 1, 2),
full_h AS (SELECT lv.cluster, lv.n, sites, f."FAMILY", coalesce(have, 0) AS have
           FROM lv CROSS JOIN (SELECT DISTINCT "FAMILY" FROM p) f LEFT JOIN h ON h.cluster = lv.cluster AND h.n = lv.n AND h."FAMILY" = f."FAMILY"),
av AS (SELECT a.cluster AS cluster1, b.cluster AS cluster2, a."FAMILY",
              sum((a.have * (b.sites - b.have) + (a.sites - a.have) * b.have) / (a.n + b.n)) / sum(a.sites * b.sites) AS average
       FROM full_h a JOIN full_h b USING ("FAMILY") WHERE a.cluster < b.cluster GROUP BY 1, 2, 3)"""


@query("simper_presence", _SIMPER + """
SELECT cluster1, cluster2, "FAMILY", round(average, 9) AS average, round(sum(average) OVER (
         PARTITION BY cluster1, cluster2 ORDER BY round(average, 12) DESC, "FAMILY" ROWS UNBOUNDED PRECEDING)
         / sum(average) OVER (PARTITION BY cluster1, cluster2), 9) AS cusum FROM av""")
def simper_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    presence = K.prune_taxa(labelled_presence(spark, sf_dir), ["WATER"], "FAMILY")
    return S.simper(presence, "WATER", "FAMILY", "cluster").select(
        "cluster1", "cluster2", "FAMILY", F.round("average", 9).alias("average"), F.round("cusum", 9).alias("cusum"))


@query("simper_select", _SIMPER + """,
r AS (SELECT *, row_number() OVER (PARTITION BY cluster1, cluster2 ORDER BY round(average, 12) DESC, "FAMILY") AS i, sum(average) OVER (
         PARTITION BY cluster1, cluster2 ORDER BY round(average, 12) DESC, "FAMILY" ROWS UNBOUNDED PRECEDING)
         / sum(average) OVER (PARTITION BY cluster1, cluster2) AS cusum FROM av)
SELECT DISTINCT "FAMILY" FROM r WHERE i <= 15 OR abs(cusum - 1) < 1e-12""")
def simper_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    presence = K.prune_taxa(labelled_presence(spark, sf_dir), ["WATER"], "FAMILY")
    return S.simper_select(S.simper(presence, "WATER", "FAMILY", "cluster"), "FAMILY")


@query("simper_select_cumulative", _SIMPER + """,
r AS (SELECT *, sum(average) OVER (PARTITION BY cluster1, cluster2 ORDER BY round(average, 12) DESC, "FAMILY" ROWS UNBOUNDED PRECEDING)
         / sum(average) OVER (PARTITION BY cluster1, cluster2) AS cusum FROM av),
o AS (SELECT *, row_number() OVER (PARTITION BY cluster1, cluster2 ORDER BY round(cusum, 9) DESC, "FAMILY") AS i FROM r)
SELECT DISTINCT "FAMILY" FROM o WHERE i <= 15 OR abs(cusum - 1) < 1e-12""")
def simper_select_cumulative(spark: SparkSession, sf_dir: str) -> DataFrame:
    presence = K.prune_taxa(labelled_presence(spark, sf_dir), ["WATER"], "FAMILY")
    return S.simper_select(S.simper(presence, "WATER", "FAMILY", "cluster"), "FAMILY", by="cumulative_desc")


@query("cluster_frequency", _SIMPER + """,
sr AS (SELECT *, row_number() OVER (PARTITION BY cluster1, cluster2 ORDER BY round(average, 12) DESC, "FAMILY") AS i, sum(average) OVER (
         PARTITION BY cluster1, cluster2 ORDER BY round(average, 12) DESC, "FAMILY" ROWS UNBOUNDED PRECEDING)
         / sum(average) OVER (PARTITION BY cluster1, cluster2) AS cusum FROM av),
sel AS (SELECT DISTINCT "FAMILY" FROM sr WHERE i <= 15 OR abs(cusum - 1) < 1e-12),
ap AS (SELECT * FROM pres JOIN site_labels USING ("WATER")),
cn AS (SELECT cluster, count(DISTINCT "WATER") AS n FROM ap GROUP BY 1),
cc AS (SELECT cluster, "FAMILY", count(*) AS total_waters FROM ap GROUP BY 1, 2),
od AS (SELECT DISTINCT "FAMILY", "ORDER" FROM specimens),
fr AS (SELECT cluster, "FAMILY", total_waters, n, total_waters / n AS prop, "ORDER", sum(total_waters / n) OVER (PARTITION BY "FAMILY") AS total
       FROM cc JOIN cn USING (cluster) LEFT JOIN od USING ("FAMILY"))
SELECT cluster, "FAMILY", total_waters, n, round(prop, 9) AS prop_clust, "ORDER", round(total, 9) AS total_clust,
       CASE WHEN "FAMILY" IN (FROM sel) THEN 'Y' ELSE 'N' END AS important,
       row_number() OVER (ORDER BY "ORDER" NULLS LAST, round(total, 12) DESC, "FAMILY", cluster) AS rank FROM fr""")
def cluster_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    presence = labelled_presence(spark, sf_dir)
    selected = S.simper_select(S.simper(K.prune_taxa(presence, ["WATER"], "FAMILY"), "WATER", "FAMILY", "cluster"), "FAMILY")
    out = K.cluster_frequency(presence, "WATER", "FAMILY", "cluster", D.specimens(spark, sf_dir), selected)
    return out.withColumns({"prop_clust": F.round("prop_clust", 9), "total_clust": F.round("total_clust", 9)})


_ACCUMULATION = f"""WITH {D.SPECIMENS},
pres AS (SELECT DISTINCT "WATER", "YSAMP", "FAMILY" FROM specimens WHERE {_VALID}),
ns AS (SELECT "WATER", count(DISTINCT "YSAMP") AS n_sites FROM pres GROUP BY 1),
f AS (SELECT "WATER", "FAMILY", count(*) AS f FROM pres GROUP BY 1, 2),
e AS (SELECT *, unnest(range(1, n_sites + 1)) AS n FROM f JOIN ns USING ("WATER")),
q AS (SELECT "WATER", "FAMILY", f, n_sites, n, CASE WHEN n_sites - f < n THEN 0 ELSE exp(lgamma(n_sites - f + 1) - lgamma(n_sites - f - n + 1)
             - lgamma(n_sites + 1) + lgamma(n_sites - n + 1)) END AS q FROM e)"""


@query("accumulation", _ACCUMULATION + """,
co AS (SELECT a."WATER", a."FAMILY" AS s, b."FAMILY" AS t, count(*) AS fst FROM pres a JOIN pres b USING ("WATER", "YSAMP")
       WHERE a."FAMILY" < b."FAMILY" GROUP BY 1, 2, 3),
cv AS (SELECT a."WATER", a.n, sum((a.n_sites * coalesce(fst, 0) - a.f * b.f) / sqrt(a.f * (a.n_sites - a.f) * b.f * (b.n_sites - b.f))
              * sqrt(a.q * (1 - a.q) * b.q * (1 - b.q))) AS cv
       FROM q a JOIN q b ON a."WATER" = b."WATER" AND a.n = b.n AND a."FAMILY" < b."FAMILY"
       LEFT JOIN co ON co."WATER" = a."WATER" AND s = a."FAMILY" AND t = b."FAMILY"
       WHERE a.f < a.n_sites AND b.f < b.n_sites GROUP BY 1, 2)
SELECT "WATER", n AS sites, round(sum(1 - q), 6) AS richness,
       round(sqrt(greatest(0, sum(q * (1 - q)) + 2 * coalesce(any_value(cv), 0))), 4) AS sd
FROM q LEFT JOIN cv USING ("WATER", n) GROUP BY 1, 2""")
def accumulation(spark: SparkSession, sf_dir: str) -> DataFrame:
    presence = K.presence_table(D.specimens(spark, sf_dir), ["WATER", "YSAMP"])
    curves = K.accumulation(presence, ["WATER"], "YSAMP", "FAMILY")
    return curves.select(
        "WATER", "sites", F.round("richness", 6).alias("richness"), F.round("sd", 4).alias("sd"))


@query("accumulation_origin", _ACCUMULATION + """,
r AS (SELECT "WATER", n AS sites, round(sum(1 - q), 6) AS richness FROM q GROUP BY 1, 2)
SELECT * FROM r UNION ALL SELECT DISTINCT "WATER", 0, 0.0 FROM r""")
def accumulation_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The curves from no site on."""
    presence = K.presence_table(D.specimens(spark, sf_dir), ["WATER", "YSAMP"])
    curves = K.with_origin(K.accumulation(presence, ["WATER"], "YSAMP", "FAMILY"), ["WATER"])
    return curves.select("WATER", "sites", F.round("richness", 6).alias("richness"))


@query("two_site_share", _ACCUMULATION + """,
r AS (SELECT "WATER", n, sum(1 - q) AS r FROM q WHERE n IN (2, 4) GROUP BY 1, 2)
SELECT "WATER", round(min(r) / max(r), 6) AS percent FROM r GROUP BY 1""")
def two_site_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    presence = K.presence_table(D.specimens(spark, sf_dir), ["WATER", "YSAMP"])
    curves = K.accumulation(presence, ["WATER"], "YSAMP", "FAMILY", sizes=[2, 4])
    return K.share_of_sites(curves, ["WATER"]).select("WATER", F.round("percent", 6).alias("percent"))


_SITES = """sites AS (
  SELECT o_custkey AS water, CASE WHEN month(o_orderdate) < 8 THEN 'SPRING' ELSE 'FALL' END AS season,
         CAST(floor(avg(o_totalprice) / 100000) AS BIGINT) AS cluster, avg(o_totalprice) / 1000 AS "MDS1", CAST(count(*) AS DOUBLE) AS "MDS2"
  FROM orders GROUP BY 1, 2)"""


def _season_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = D.table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_totalprice")
    season = F.when(F.month("o_orderdate") < 8, "SPRING").otherwise("FALL")
    return orders.groupBy(F.col("o_custkey").alias("water"), season.alias("season")).agg(
        F.floor(F.avg("o_totalprice") / 100000).alias("cluster"), (F.avg("o_totalprice") / 1000).alias("MDS1"),
        F.count(F.lit(1)).cast("double").alias("MDS2"))


@query("cluster_season_centroids", f"""WITH {_SITES}
SELECT cluster, season, round(avg("MDS1"), 6) AS x, round(avg("MDS2"), 6) AS y FROM sites GROUP BY 1, 2""")
def cluster_season_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    centroids, _ = K.cluster_season_shift(_season_sites(spark, sf_dir), "water", "season", "cluster", ["MDS1", "MDS2"])
    return centroids.select("cluster", "season", F.round("centroid_MDS1", 6).alias("x"), F.round("centroid_MDS2", 6).alias("y"))


@query("cluster_season_shift", f"""WITH {_SITES}
SELECT water, round(max("MDS1") FILTER (WHERE season = 'SPRING'), 9) AS x0, round(max("MDS1") FILTER (WHERE season = 'FALL'), 9) AS x1,
       CAST(max(cluster) FILTER (WHERE season = 'FALL') = max(cluster) FILTER (WHERE season = 'SPRING') AS VARCHAR) AS same FROM sites GROUP BY 1""")
def cluster_season_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, moves = K.cluster_season_shift(_season_sites(spark, sf_dir), "water", "season", "cluster", ["MDS1", "MDS2"])
    return moves.select("water", F.round("MDS1_spring", 9).alias("x0"), F.round("MDS1_fall", 9).alias("x1"), F.col("same").cast("string").alias("same"))


@query("cluster_table", f"""WITH {_SITES} SELECT lower(season) AS season, CAST(water AS VARCHAR) AS "WATER", cluster FROM sites""")
def cluster_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    sites = _season_sites(spark, sf_dir).select(F.concat_ws("_", "season", "water").alias("ID"), "cluster")
    return K.cluster_table(sites, "ID", "cluster")


@query("cluster_sizes", f"""WITH {_SITES} SELECT cluster, count(*) AS n FROM sites GROUP BY 1""")
def cluster_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.cluster_sizes(_season_sites(spark, sf_dir))


@query("cluster_chemistry", f"""WITH {D.CHEMISTRY}, {D.CLUSTERS}
SELECT "WATER", season, "Lake", round("DOC_update", 6) AS "DOC_update", max_depth, "WATER" || '.' || season AS community, cluster
FROM chemistry LEFT JOIN clusters USING ("WATER", season)""")
def cluster_chemistry(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = K.cluster_chemistry(D.lake_chemistry(spark, sf_dir), D.community_clusters(spark, sf_dir))
    return out.select("WATER", "season", "Lake", F.round("DOC_update", 6).alias("DOC_update"), "max_depth", "community", "cluster")


@query("display_order", f"""WITH {D.SPECIMENS}, o AS (SELECT DISTINCT "ORDER", "FAMILY" FROM specimens)
SELECT "ORDER", "FAMILY", row_number() OVER (ORDER BY "ORDER", "FAMILY") AS count FROM o""")
def display_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.display_order(D.specimens(spark, sf_dir), "ORDER", "FAMILY")
