"""The given star-schema tables seen as permissions, subjects and documents.

The convention: a customer is a subject, the market segment its condition, the
nation its region; every order is a permission row of its customer; a document
belongs to the customer whose key is its doc_id modulo the number of customers.
All rows of all tables take part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The instant of the registered queries (without time zone, like the tables).
INSTANT = "TIMESTAMP_NTZ '1998-06-01'"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def instant():  # noqa: ANN201
    return F.expr(INSTANT)


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A permission row per order."""
    priority, key, day = F.col("o_orderpriority"), F.col("o_orderkey"), F.col("o_orderdate")
    given = lambda *p: F.array(*map(F.lit, p))
    purposes = (
        F.when(priority == "1-URGENT", given("direct_care"))
        .when(priority == "2-HIGH", given("research"))
        .when(priority == "3-MEDIUM", given("direct_care", "quality_improvement"))
        .when(priority == "4-NOT SPECIFIED", given("outreach"))
        .otherwise(given("direct_care", "research"))
    )
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("subject"),
        (1 + key % 3).cast("int").alias("version"),
        purposes.alias("purposes"),
        F.when(key % 5 == 0, given("en")).otherwise(F.array().cast("array<string>")).alias("scope"),
        day.alias("valid_from"),
        F.when(key % 4 < 3, day + F.expr("INTERVAL 700 DAY")).alias("valid_until"),
        F.when(F.col("o_orderstatus") == "F", day + F.expr("INTERVAL 600 DAY")).alias("revoked_at"),
    )


def subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("region"))
    return table(spark, sf_dir, "customer").join(nations, "c_nationkey").select(F.col("c_custkey").alias("subject"), F.col("c_mktsegment").alias("condition"), "region")


def owned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their subject, without its attributes."""
    n = max(1, table(spark, sf_dir, "customer").count())  # from the file footers
    return table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % n).alias("subject"), F.col("lang").alias("doc_type"), F.col("source").alias("title"), "text")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their subject's condition and region; blank where unknown."""
    joined = owned(spark, sf_dir).join(subjects(spark, sf_dir), "subject", "left")
    return joined.withColumn("condition", F.coalesce("condition", F.lit(""))).withColumn("region", F.coalesce("region", F.lit("")))
