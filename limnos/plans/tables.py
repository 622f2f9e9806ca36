"""Registered queries on written tables, with the tables in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from limnos.operators import reshape as X
from limnos.plans.registry import registry
from limnos.session import application_folder
from limnos.sources import domain as D
from limnos.sources import tables as S

QUERIES, ORACLE, query = registry()


def _folder(spark: SparkSession, what: str) -> str:
    return f"{application_folder(spark)}/{what}-{uuid.uuid4().hex}"


@query("csv_round_trip", """SELECT c_custkey AS "Cust.Key", CASE WHEN c_custkey % 7 > 0 THEN c_acctbal END AS "Acct.Bal..USD.", c_mktsegment AS "X2nd_segment",
       CASE WHEN c_custkey % 5 > 0 THEN c_name END AS "if." FROM customer""")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written under the names of a field sheet, with missing values, and read back."""
    rows = D.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("Cust Key"), F.when(F.col("c_custkey") % 7 > 0, F.col("c_acctbal")).alias("Acct Bal (USD)"),
        F.col("c_mktsegment").alias("2nd_segment"), F.when(F.col("c_custkey") % 5 > 0, F.col("c_name")).alias("if"))
    path = _folder(spark, "csv")
    S.write_csv(rows, path)
    return S.read_csv(spark, path, rows.schema)


@query("rewritten_table", """SELECT n_nationkey, n_name, n_regionkey + 10 AS n_regionkey FROM nation
UNION ALL SELECT n_nationkey + 100, lower(n_name), n_regionkey + 10 FROM nation WHERE n_regionkey > 0""")
def rewritten_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table that is read, changed and written under its own root, twice."""
    root = _folder(spark, "nation")
    first = S.rewrite(D.table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey"), root)
    more = first.where("n_regionkey > 0").select((F.col("n_nationkey") + 100).alias("n_nationkey"), F.lower("n_name").alias("n_name"), "n_regionkey")
    second = S.rewrite(first.unionByName(more), root)
    return S.rewrite(second.withColumn("n_regionkey", F.col("n_regionkey") + 10), root)


@query("folded_frames", """SELECT o_custkey AS lake, o_totalprice AS price, NULL::DOUBLE AS balance, NULL::BIGINT AS n FROM orders
UNION ALL SELECT c_custkey, NULL, c_acctbal, NULL FROM customer UNION ALL SELECT s_nationkey, NULL, NULL, count(*) FROM supplier GROUP BY 1""")
def folded_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames with partly different columns, folded to one."""
    orders = D.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("lake"), F.col("o_totalprice").alias("price"))
    customers = D.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("lake"), F.col("c_acctbal").alias("balance"))
    suppliers = D.table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("lake")).agg(F.count(F.lit(1)).alias("n"))
    return X.fold_full_join([orders, customers, suppliers])
