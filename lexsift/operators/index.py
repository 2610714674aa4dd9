"""Building, storing and opening a search index."""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexsift.functions.codec import STRETCH, gaps
from lexsift.functions.tokens import bigram_id, bigrams, counted, rotations, tokens, unrotated

MANIFEST, VERSION = "manifest.json", 1


def dense_ids(values: DataFrame, column: str, name: str, prefix: int) -> DataFrame:
    """Number the distinct values of ``column`` from 0 in sorted order.

    A null is the first value.  Values are ranked within their first ``prefix`` characters and shifted by the number of
    values in smaller prefixes, so no task sees all of them.
    """
    keyed = values.select(column).distinct().withColumn("_head", F.substring(column, 1, prefix))
    sizes = keyed.groupBy("_head").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_head").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = keyed.withColumn("_rank", F.row_number().over(Window.partitionBy("_head").orderBy(column)))
    shifts = sizes.select("_head", before.alias("_before"))
    shifts = shifts.withColumnRenamed("_head", "_of")
    return ranked.join(shifts, F.col("_head").eqNullSafe(F.col("_of"))).select((F.col("_before") + F.col("_rank") - 1).cast("int").alias(name), column)


def term_postings(reviews: DataFrame, repeated: bool = False) -> DataFrame:
    """(token, review_id, length, tf): how often each token stands in each review of a given length.

    Counted within a review, so nothing is shuffled; only where ids may be ``repeated`` rows of an id meet.
    """
    words = reviews.select("review_id", tokens(F.col("text")).alias("words"))
    postings = words.select("review_id", F.size("words").alias("length"), F.inline(counted(F.col("words")))).select("token", "review_id", "length", "tf")
    return postings.groupBy("token", "review_id", "length").agg(F.sum("tf").alias("tf")) if repeated else postings


def lexicon_of(postings: DataFrame) -> DataFrame:
    """(token, df, cf)."""
    return postings.groupBy("token").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


@dataclass(frozen=True)
class SearchIndex:
    """Reviews with their attributes, postings and lexicon; everything else derives from them."""

    reviews: DataFrame  # review_id, product_id, help_num, help_den, score, length
    postings: DataFrame  # token, review_id, length, tf
    lexicon: DataFrame  # token, df, cf
    stored_bigrams: DataFrame | None = None
    stored_rotations: DataFrame | None = None

    @staticmethod
    def build(reviews: DataFrame, attributes: DataFrame | None = None, repeated: bool = False) -> "SearchIndex":
        """From ``reviews(review_id, product_id, help_num, help_den, score, text)``.

        ``attributes`` are the reviews with length in place of text, where that is cheaper to have; ``repeated`` says that an id may
        stand in more than one row.
        """
        if attributes is None:
            attributes = reviews.select("review_id", "product_id", "help_num", "help_den", "score", F.size(tokens(F.col("text"))).alias("length"))
        postings = term_postings(reviews, repeated)
        return SearchIndex(attributes, postings, lexicon_of(postings))

    @property
    def access(self) -> str:
        """The access path for terms with ``*``: what is stored, else LIKE over the lexicon."""
        return "permuterm" if self.stored_rotations is not None else "bigram" if self.stored_bigrams is not None else "like"

    def cached(self, postings: bool = True) -> "SearchIndex":
        """Kept by Spark; without ``postings`` these are counted anew from the texts by each query, which shuffles and writes nothing."""
        postings = self.postings.persist() if postings else self.postings
        return SearchIndex(self.reviews.persist(), postings, lexicon_of(postings).persist(), self.stored_bigrams, self.stored_rotations)

    @cached_property
    def totals(self) -> tuple[int, int]:
        """(reviews, tokens)."""
        row = self.stats.first()
        return row.n_reviews, row.n_tokens

    @cached_property
    def long_tokens(self) -> list[str]:
        """Tokens whose posting lists are worked on in stretches."""
        return [r.token for r in self.lexicon.filter(F.col("df") > STRETCH).select("token").collect()]

    @property
    def stats(self) -> DataFrame:
        return self.reviews.agg(F.count("*").alias("n_reviews"), F.coalesce(F.sum("length"), F.lit(0)).cast("long").alias("n_tokens"))

    @property
    def bigrams(self) -> DataFrame:
        """(bigram, token), each pair once."""
        if self.stored_bigrams is not None:
            return self.stored_bigrams
        return self.lexicon.select(F.explode(bigrams(F.col("token"))).alias("bigram"), "token")

    @property
    def permuterm(self) -> DataFrame:
        """(rotation, token, place): place counts rotations from 1."""
        if self.stored_rotations is not None:
            return self.stored_rotations
        turned = self.lexicon.select("token", F.posexplode(rotations(F.col("token"))).alias("at", "rotation"))
        return turned.select("rotation", "token", (F.col("at") + 1).alias("place"))

    @property
    def products(self) -> DataFrame:
        """(product_id, n_reviews)."""
        return self.reviews.groupBy("product_id").agg(F.count("*").alias("n_reviews"))

    @property
    def product_postings(self) -> DataFrame:
        """(product_id, review_id, gap): a row for each review, not a list that one task would hold."""
        return gaps(self.reviews.select("product_id", "review_id"), "product_id")

    def token_ids(self) -> DataFrame:
        return dense_ids(self.lexicon, "token", "token_id", 2)

    def product_ids(self) -> DataFrame:
        return dense_ids(self.reviews, "product_id", "product_idx", 5)

    def bigram_ids(self) -> DataFrame:
        return self.bigrams.groupBy("bigram").agg(F.count("*").alias("n_tokens")).select("bigram", bigram_id(F.col("bigram")).alias("bigram_id"), "n_tokens")

    def write(self, path: str, wildcard: str = "permuterm") -> "SearchIndex":
        """Store the index as Parquet sorted by its keys, with one wildcard access path.

        Files are ranges of the key, so a lookup reads the few whose range can hold it.
        """
        if wildcard not in ("permuterm", "bigram"):
            raise ValueError("wildcard must be 'permuterm' or 'bigram'")
        spark = self.reviews.sparkSession
        folder = _path(spark, path)
        if folder[0].exists(folder[1]):
            raise FileExistsError(path)

        def put(df: DataFrame, name: str, *keys: str, told: dict[str, Column] | None = None) -> None:
            """Columns that are ``told`` by others are not shuffled, but made after it."""
            kept = df.drop(*(told or {})).repartitionByRange(*keys).sortWithinPartitions(*keys)
            kept.withColumns(told or {}).select(*df.columns).write.parquet(f"{path}/{name}")

        put(self.postings, "postings", "token", "review_id")
        written = SearchIndex(self.reviews, spark.read.parquet(f"{path}/postings"), self.lexicon)
        put(lexicon_of(written.postings), "lexicon", "token")
        lexicon = spark.read.parquet(f"{path}/lexicon")
        put(self.reviews, "reviews", "review_id")
        access = SearchIndex(self.reviews, written.postings, lexicon)
        if wildcard == "bigram":
            put(access.bigrams, "bigrams", "bigram", "token")
        else:
            put(access.permuterm, "permuterm", "rotation", told={"token": unrotated(F.col("rotation"))})
        stream = folder[0].create(folder[0].makeQualified(spark._jvm.org.apache.hadoop.fs.Path(path, MANIFEST)))
        stream.write(json.dumps({"version": VERSION, "wildcard": wildcard}).encode())
        stream.close()
        return SearchIndex.open(spark, path)

    @staticmethod
    def open(spark: SparkSession, path: str) -> "SearchIndex":
        told = json.loads("".join(r[0] for r in spark.read.text(f"{path}/{MANIFEST}").collect()))
        if told["version"] != VERSION:
            raise ValueError(f"index version {told['version']}")
        read = lambda name: spark.read.parquet(f"{path}/{name}")
        bigram = told["wildcard"] == "bigram"
        return SearchIndex(read("reviews"), read("postings"), read("lexicon"), read("bigrams") if bigram else None, None if bigram else read("permuterm"))

    @staticmethod
    def remove(spark: SparkSession, path: str) -> None:
        """Delete a stored index; a folder without our manifest is left alone."""
        files, folder = _path(spark, path)
        if not files.exists(spark._jvm.org.apache.hadoop.fs.Path(path, MANIFEST)):
            raise FileNotFoundError(f"no index at {path}")
        files.delete(folder, True)


def _path(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), folder
