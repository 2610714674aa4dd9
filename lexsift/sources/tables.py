"""The test tables seen as reviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexsift.functions.tokens import tokens


def reviews_of_tables(spark: SparkSession, folder: str) -> DataFrame:
    """(review_id, product_id, help_num, help_den, score, text) from documents, labels and events.

    Score and helpfulness are synthetic: quality gives 1 or 5, else 3; clicks are helpful among
    clicks and views of the user whose number is the document's.
    """
    return _voted(spark, folder, F.col("text"))


def attributes_of_tables(spark: SparkSession, folder: str) -> DataFrame:
    """The same with length in place of text: texts are counted before the joins, so none is shuffled."""
    return _voted(spark, folder, F.size(tokens(F.col("text"))).alias("length"))


def _voted(spark: SparkSession, folder: str, text: Column) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "source", text)
    quality = spark.read.parquet(f"{folder}/labels.parquet").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    events = spark.read.parquet(f"{folder}/events.parquet").filter(F.col("event_type").isin("click", "view"))
    seen = events.groupBy(F.col("user_id").alias("doc_id")).agg(F.count_if(F.col("event_type") == "click").alias("clicks"), F.count("*").alias("seen"))
    joined = docs.join(quality, "doc_id", "left").join(seen, "doc_id", "left")
    zero = F.lit(0)
    return joined.select(
        (F.col("doc_id") + 1).cast("int").alias("review_id"),
        F.col("source").alias("product_id"),
        F.coalesce("clicks", zero).cast("smallint").alias("help_num"),
        F.coalesce("seen", zero).cast("smallint").alias("help_den"),
        F.coalesce(1 + 4 * F.col("quality"), F.lit(3)).cast("tinyint").alias("score"),
        docs.columns[-1],
    )
