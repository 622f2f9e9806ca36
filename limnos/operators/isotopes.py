"""Isotope measurements: corrections, replicates, the cleaned frame, centroids and legends."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limnos.functions import columns as C
from limnos.operators.reshape import factor_codes, keep_groups, lookup_join

# Categories without lipid correction, its constants, and groups outside the niche and mixing frames.
UNCORRECTED = ["ALGA", "PLANT"]
LIPID_SHIFT, LIPID_SLOPE = -3.32, 0.99
NICHE_GROUPS_OUT = ["LEAF", "PERI", "INSECT", "ZOOP", "CRAY", "SIL"]
MIXING_GROUPS_OUT = ["LEAF", "PERI", "ZOOP", "FISH"]


def lipid_correct(rows: DataFrame) -> DataFrame:
    """Carbon isotope corrected by the C:N ratio, except for algae and plants; a missing category is corrected."""
    c = C.to_number("D13C")
    corrected = c + LIPID_SHIFT + LIPID_SLOPE * F.try_divide(C.to_number("PER_C"), C.to_number("PER_N"))
    return rows.withColumn("D13C", F.when(C.not_in("CATEGORY", UNCORRECTED), corrected).otherwise(c))


def replicate_summary(rows: DataFrame, item: str, min_replicates: int = 3) -> DataFrame:
    """Mean and sd of both isotopes of items with more than `min_replicates` distinct rows."""
    distinct = rows.select(item, "D13C", "D15N", "CATEGORY").distinct()
    return distinct.groupBy(item).agg(
        F.count(F.lit(1)).alias("replicates"), F.avg("D13C").alias("mean_C"), F.stddev_samp("D13C").alias("sd_C"),
        F.avg("D15N").alias("mean_N"), F.stddev_samp("D15N").alias("sd_N"),
        F.max("CATEGORY").alias("label")).where(F.col("replicates") > min_replicates)


def isotope_frame(rows: DataFrame, taxa: DataFrame, drop_groups: Sequence[str] = MIXING_GROUPS_OUT,
                  lower_names: bool = False) -> DataFrame:
    """Measurements with family and order, numeric isotopes, bivalves as one group, season and community.

    A taxon without family or order goes by its group. Groups in `drop_groups` are left out.
    """
    out = lookup_join(rows, taxa, ["TAXON"], ["FAMILY", "ORDER"])
    group = C.replace_first(C.replace_first("GROUP", "CLAM", "BIVALVE"), "MUSSEL", "BIVALVE")
    out = out.withColumns({"iso1": C.to_number("D13C"), "iso2": C.to_number("D15N"), "GROUP": group, "season": C.season("MONTH")})
    name = F.coalesce("FAMILY", "GROUP")
    out = out.withColumns({"graph_id": F.coalesce("ORDER", "GROUP"), "group_name": name,
                           "community": C.unite(".", "WATER", "season")}).where(C.not_in("group_name", drop_groups))
    if lower_names:
        out = out.withColumn("group_name", F.lower("group_name"))
    return out.select("WATER", "season", "community", "GROUP", "FAMILY", "ORDER", "graph_id", "group_name", "iso1", "iso2")


def min_group_size(frame: DataFrame, keys: Sequence[str] = ("community", "group_name"), more_than: int = 3) -> DataFrame:
    """Rows of groups with more than `more_than` rows, counted before rows with a missing isotope are dropped.

    A kept group may therefore end below the limit.
    """
    return keep_groups(frame, list(keys), F.count(F.lit(1)), lambda n: n > more_than).dropna(subset=["iso1", "iso2"])


def group_centroids(frame: DataFrame, keys: Sequence[str] = ("community", "group_name"), more_than: int = 0) -> DataFrame:
    """Mean isotopes per community and group, rare groups included; `more_than` leaves groups out as `min_group_size` does."""
    both = F.col("iso1").isNotNull() & F.col("iso2").isNotNull()
    means = frame.groupBy(*keys).agg(F.count(F.lit(1)).alias("__all"), F.avg(F.when(both, F.col("iso1"))).alias("iso1"),
                                     F.avg(F.when(both, F.col("iso2"))).alias("iso2"))
    return means.where(F.col("iso1").isNotNull() & (F.col("__all") > more_than)).drop("__all")


def legends(frame: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(group_name, group) and (community, code) tables, codes in name order."""
    return factor_codes(frame, "group_name", "group"), factor_codes(frame, "community", "code")
