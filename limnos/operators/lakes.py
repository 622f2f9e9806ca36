"""Lake chemistry tables: water samples, secchi depth, the compiled lake-season table and its checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limnos.functions import columns as C
from limnos.operators.reshape import add_group_values, lookup_join, natural_join, wide
from limnos.session import checkpointed
from limnos.sources.tables import literal_rows

# Lake-seasons left out of the secchi table, one measured by hand, and the number for an unlisted colour.
SECCHI_OUT = ["COM.spring", "LML.spring", "GNL.spring", "ETL.spring"]
SECCHI_BY_HAND = ("HTL.fall", "HTL", "fall", 4.5, 15.0)
UNLISTED_COLOUR = 15.0
# Metrics without a trend, full lake names, printed season names.
TREND_METRICS_OUT = ["SECCHI COLOR", "UV254"]
LAKE_NAMES = {
    "COM": "Combs Lake", "DTL": "Dart Lake", "ECL": "East Copperas Lake", "ETL": "East Lake", "GNL": "Green Lake",
    "HTL": "Heart Lake", "LCL": "Little Clear Lake", "LML": "Little Moose Lake", "MSL": "Moss Lake", "REL": "Rondaxe Lake",
    "SEL": "Sagemore Lake", "UCL": "Upper Cascade Lake"}
SEASON_NAMES = {"spring": "Early", "fall": "Late"}


def recode(c: str, labels: dict[str, str]):
    """Label of a code; a code without one is missing."""
    pairs = [F.lit(v) for item in labels.items() for v in item]
    return F.try_element_at(F.create_map(*pairs), F.col(c))


def sample_results(results: DataFrame, samples: DataFrame) -> DataFrame:
    return natural_join(results, samples, "left", ["YSAMP_N"])


def wide_chemistry(acd: DataFrame, metrics: Sequence[str], after: int = 2013) -> DataFrame:
    """Mean per lake and metric after a year, one column per listed metric."""
    means = acd.where(F.col("YEAR") > after).groupBy("WATER", "METRIC").agg(F.avg("VALUE_1").alias("v"))
    return wide(means, ["WATER"], "METRIC", "v", metrics)


def secchi_depth(acd: DataFrame, metric: str = "SECCHI DEPTH", after: int = 2000) -> DataFrame:
    """Mean secchi depth per lake and season, from rows without missing values."""
    rows = acd.where((F.col("METRIC") == metric) & (F.col("YEAR") > after)).withColumn("season", C.season("MONTH"))
    rows = rows.dropna("any", subset=["YEAR", "WATER", "METRIC", "MONTH", "VALUE_1", "season"])
    return rows.groupBy("WATER", "season").agg(F.avg("VALUE_1").alias("sechi_depth"))


def seasonal_secchi(acd: DataFrame, colours: DataFrame, survey: DataFrame, metric: str = "SECCHI DEPTH", after: int = 2000,
                    skip: Sequence[str] = SECCHI_OUT, by_hand: tuple | None = SECCHI_BY_HAND) -> DataFrame:
    """(ID, WATER, season, sechi_depth, FUI_num) from the long-term samples and the survey.

    colours: WATER, season, sechi_color, FUI_num. survey: WATER, season, sechi_depth, sechi_color.
    """
    scale = colours.select(F.lower("sechi_color").alias("sechi_color"), "FUI_num")
    own = colours.groupBy("WATER", "season").agg(C.strict_avg("FUI_num").alias("FUI_num"))
    long_term = natural_join(secchi_depth(acd, metric, after), own, "left", ["WATER", "season"])
    seen = survey.select("WATER", "season", "sechi_depth", F.lower("sechi_color").alias("sechi_color")).dropna("any")
    seen = lookup_join(seen, scale, ["sechi_color"], ["FUI_num"]).withColumn("FUI_num", F.coalesce("FUI_num", F.lit(UNLISTED_COLOUR)))
    both = seen.select("WATER", "season", "sechi_depth", "FUI_num").unionByName(long_term)
    both = both.select(C.unite(".", "WATER", "season").alias("ID"), "*").where(C.not_in("ID", skip))
    return literal_rows(both, [by_hand]) if by_hand else both


def compile_lake_table(oxycline: DataFrame, secchi: DataFrame, thermocline: DataFrame, doc: DataFrame, morphology: DataFrame) -> DataFrame:
    """One row per lake-season: four left joins on the common columns."""
    out = natural_join(oxycline, secchi)
    out = natural_join(out, thermocline.select("ID", "mid_depth", "bottom"))
    out = natural_join(out, doc.select("ID", "DOC_update"))
    return natural_join(out, morphology.select("WATER", "Pond_num", "Lake", "Elevation", "max_depth", "Volume"))


def merge_profile_metrics(morphology: DataFrame, thermocline: DataFrame, oxycline: DataFrame) -> DataFrame:
    """Morphology with its profile metrics replaced by the newly computed ones."""
    base = morphology.drop("DDO5", "TDO5", "mid_depth", "bottom").withColumn("community", C.unite(".", "WATER", "season"))
    out = natural_join(base, thermocline.drop("grad_max", "thresh", "top").withColumnRenamed("ID", "community"), "left", ["community"])
    return natural_join(out, oxycline.withColumnRenamed("ID", "community"), "left", ["community"])


def metric_coverage(acd: DataFrame, min_observations: int = 3, min_lakes: int = 3, skip: Sequence[str] = TREND_METRICS_OUT) -> DataFrame:
    """Rows of metrics measured often enough per lake and in enough lakes."""
    pairs = checkpointed(acd.groupBy("WATER", "METRIC").agg(F.count(F.lit(1)).alias("total_observations")))  # a row per lake and metric
    pairs = add_group_values(pairs, ["METRIC"], total_lakes=F.count(F.lit(1)))
    rows = natural_join(acd, pairs, "inner", ["WATER", "METRIC"])
    return rows.where((F.col("total_observations") > min_observations) & (F.col("total_lakes") > min_lakes) & C.not_in("METRIC", skip))


def first_years(acd: DataFrame, metric: str) -> DataFrame:
    return acd.where(F.col("METRIC") == metric).groupBy("WATER").agg(C.strict_min("YEAR").alias("min_year"))


def metric_units(acd: DataFrame) -> DataFrame:
    return acd.select("METRIC", "UNIT_1").distinct()


def unknown_lakes(chemistry: DataFrame, known: DataFrame) -> DataFrame:
    """Rows whose lake has no row in the known table."""
    return natural_join(chemistry, known.select("WATER").distinct(), "left_anti", ["WATER"])


def baseline_gap(baselines: DataFrame, clusters: DataFrame, a: str = "ZOOP", b: str = "PERI", absolute: bool = True) -> DataFrame:
    """(community, sources, dif, cluster): difference of two source means, for communities with a cluster."""
    table = wide(baselines, ["community"], "source", "mean_c", ["PERI", "ZOOP", "LEAF"])
    gap = F.col(a) - F.col(b)
    table = table.withColumn("dif", F.abs(gap) if absolute else gap)
    return lookup_join(table, clusters, ["community"], ["cluster"]).where(F.col("cluster").isNotNull())


def baseline_gap_by_cluster(gaps: DataFrame) -> DataFrame:
    return gaps.groupBy("cluster").agg(F.avg("dif").alias("dif"))


def family_gap(mixtures: DataFrame, gaps: DataFrame, order: str, skip: Sequence[str] = (), source: str = "ZOOP") -> DataFrame:
    """Mean distance of an order's family means from one source, per community and cluster."""
    means = mixtures.groupBy("community", "group_name", "ORDER").agg(F.avg("iso1").alias("mean"))
    rows = natural_join(means, gaps, "left", ["community"]).where(
        ~F.col("group_name").isin(list(skip) or [""]) & (F.col("ORDER") == order) & F.col(source).isNotNull())
    return rows.groupBy("community", "cluster").agg(F.avg(F.abs(F.col(source) - F.col("mean"))).alias("gap"))


def lake_table(chemistry: DataFrame, names: dict[str, str] = LAKE_NAMES) -> DataFrame:
    """Printed table of lake characteristics, sorted by lake and season."""
    cols = [c for c in chemistry.columns if c not in ("WATER", "season")]
    rows = chemistry.distinct().select(recode("WATER", names).alias("water"), recode("season", SEASON_NAMES).alias("season"), *cols)
    return rows.orderBy("water", "season")
