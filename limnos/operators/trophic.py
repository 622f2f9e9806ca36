"""Trophic position from source shares and source isotopes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limnos.functions import columns as C
from limnos.operators.community import INVALID_FAMILIES
from limnos.operators.mixing import SOURCES
from limnos.operators.reshape import add_group_values, lookup_join, natural_join, wide

ENRICHMENT = 3.14  # fixed value: enrichment in nitrogen per trophic level


def trophic_position(mixtures: DataFrame, shares: DataFrame, sources: DataFrame) -> DataFrame:
    """Mixture rows with weighted and simple trophic position.

    mixtures: community, GROUP, FAMILY, iso1, iso2. shares: community, group_name, source, mean. sources: community,
    source, mean_n. The weighted form takes the shares of all three sources, or of two where the nearshore share
    is missing; the offshore source counts as one level higher. The simple form uses one source.
    """
    mix = wide(shares.select("community", "group_name", "source", "mean").where(C.is_in("source", SOURCES)).distinct(),
               ["community", "group_name"], "source", "mean", SOURCES)
    mix = mix.select("community", F.col("group_name").alias("FAMILY"), *[F.col(s).alias(f"{s}_mix") for s in SOURCES])
    base = wide(sources.where(C.is_in("source", SOURCES)), ["community"], "source", "mean_n", SOURCES)
    rows = natural_join(natural_join(mixtures.select("community", "GROUP", "FAMILY", "iso1", "iso2"), mix, "left", ["community", "FAMILY"]),
                        base, "left", ["community"])
    two_n = F.col("ZOOP") * F.col("ZOOP_mix") + F.col("LEAF") * F.col("LEAF_mix")
    two_level = 2 * F.col("ZOOP_mix") + F.col("LEAF_mix")
    near = F.col("PERI_mix").isNotNull()
    rows = rows.withColumns({
        "baseline_N": F.when(near, two_n + F.col("PERI") * F.col("PERI_mix")).otherwise(two_n),
        "baseline_position": F.when(near, two_level + F.col("PERI_mix")).otherwise(two_level)})
    return rows.withColumns({
        "trophic_position_weighted": (F.col("iso2") - F.col("baseline_N")) / ENRICHMENT + F.col("baseline_position"),
        "trophic_position": (F.col("iso2") - F.when(near, F.col("PERI")).otherwise(F.col("LEAF"))) / ENRICHMENT + 1})


def trophic_clean(rows: DataFrame, taxa: DataFrame) -> DataFrame:
    """Complete rows of usable families, with the order and the family's mean position."""
    cols = ["community", "GROUP", "FAMILY", "iso2", "iso1", "trophic_position_weighted", "trophic_position"]
    usable = rows.select(*cols).dropna("any").where(C.not_in("FAMILY", INVALID_FAMILIES))
    return add_group_values(lookup_join(usable, taxa, ["FAMILY"], ["ORDER"]), ["FAMILY"], mean_TP=C.strict_avg("trophic_position_weighted"))


def trophic_table(rows: DataFrame, more_than: int = 3) -> DataFrame:
    """Mean, sd and n of the weighted position per order and family with more than `more_than` rows."""
    return rows.groupBy("ORDER", "FAMILY").agg(
        C.strict_avg("trophic_position_weighted").alias("mean_TP"), C.strict_sd("trophic_position_weighted").alias("sd_TP"),
        F.count(F.lit(1)).alias("n")).where(F.col("n") > more_than)
