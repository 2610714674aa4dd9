"""Registered search queries, over the test tables seen as reviews."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexsift.functions import codec
from lexsift.functions.tokens import tokens
from lexsift.operators import lookup, rank, wildcard
from lexsift.operators.index import SearchIndex
from lexsift.sources.dump import PRODUCT, as_record, parse_records, read_dump
from lexsift.sources.tables import attributes_of_tables, reviews_of_tables

TERMS = ("the", "OF", "and", "zzzzq", "in")
WILD = ("wh*", "*ION", "e*n*d", "*")
PRODUCTS = ("src0", "src7", "SRC0", "nowhere")
IDS = (-1, 0, 1, 99, 100, 101, 1000, 1001)
VSM, VSM_WILD, UNKNOWN = ("the", "of"), ("wh*", "and", "the", "the"), ("*ing", "zzzzq")
LM, LM_WILD, LAMBDA = ("the", "of", "and", "the"), ("wh*", "and", "the"), 0.5
PRODUCT_QUERY = ("en*", "*ion", "the")
SHORT = ("*a*", "*7*", "*")
PATTERNS = ("wh*", "wh*n", "*ion", "t*e", "e*n*d", "*q*", "Be*ng", "xyzzy*")

#: Bytes of Parquet.
CACHED = 32 << 20

_INDEXES: dict[tuple[str, ...], SearchIndex] = {}


def index_of(spark: SparkSession, folder: str) -> SearchIndex:
    """The index of a folder's reviews, built once in a session; its frames are cached and can be rebuilt.

    Postings of more than CACHED bytes of documents are not cached: they would be larger than the memory and go to disk.
    """
    key = (spark.sparkContext.applicationId, folder)
    if key not in _INDEXES:
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        repeated = not docs.groupBy("doc_id").count().filter("count > 1").isEmpty()
        index = SearchIndex.build(reviews_of_tables(spark, folder), attributes_of_tables(spark, folder), repeated)
        size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        _INDEXES[key] = index.cached(size <= CACHED)
    return _INDEXES[key]


def _shared(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; one of this machine only where all of Spark is in one process."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    return f"{(named or tempfile.mkdtemp(prefix='lexsift-')).rstrip('/')}/search-{uuid.uuid4().hex}"


def stored_index_of(spark: SparkSession, folder: str, wildcard_path: str) -> SearchIndex:
    """The folder's index with one wildcard access path, written and opened again, once in a session."""
    key = (spark.sparkContext.applicationId, folder, wildcard_path)
    if key not in _INDEXES:
        path = _shared(spark)
        index_of(spark, folder).write(path, wildcard_path)
        _INDEXES[key] = SearchIndex.open(spark, path)
    return _INDEXES[key]


def _rounded(scores: DataFrame, key: str) -> DataFrame:
    return scores.select(key, F.round("rank", 9).alias("rank"))


def _log_rounded(scores: DataFrame) -> DataFrame:
    return scores.select("review_id", rank.log_rank().alias("log_rank"))


def vocabulary(spark, folder):
    return index_of(spark, folder).lexicon.select("token")


def parse_reviews(spark, folder):
    reviews = reviews_of_tables(spark, folder)
    written = reviews.select("review_id", as_record(F.col("product_id"), (F.col("help_num"), F.col("help_den")), F.col("score"), F.col("text")).alias("record"))
    return parse_records(written).filter("ok").select("review_id", "product_id", "help_num", "help_den", "score", F.md5(F.encode("text", "utf-8")).alias("text_md5"))


def read_dump_reviews(spark, folder):
    """The reviews written as a dump of many files, in order, and read back."""
    reviews = reviews_of_tables(spark, folder)
    record = F.concat(F.lit(PRODUCT), as_record(F.col("product_id"), (F.col("help_num"), F.col("help_den")), F.col("score"), F.col("text")))
    path = _shared(spark)
    reviews.repartitionByRange("review_id").sortWithinPartitions("review_id").select(record.alias("value")).write.text(path)
    found, _ = read_dump(spark, path)
    return found.select("review_id", "product_id", "help_num", "help_den", "score", F.md5(F.encode(F.regexp_replace("text", "\n+$", ""), "utf-8")).alias("text_md5"))


def tokenize(spark, folder):
    words = reviews_of_tables(spark, folder).select("review_id", F.posexplode(tokens(F.col("text"))).alias("position", "token"))
    return words.select("review_id", (F.col("position") + 1).cast("long").alias("position"), "token")


def term_frequencies(spark, folder):
    return index_of(spark, folder).postings.select("token", "review_id", "tf")


def review_length(spark, folder):
    return index_of(spark, folder).reviews.select("review_id", F.col("length").cast("long").alias("length"))


def token_ids(spark, folder):
    return index_of(spark, folder).token_ids()


def product_ids(spark, folder):
    return index_of(spark, folder).product_ids()


def lexicon_stats(spark, folder):
    return index_of(spark, folder).lexicon


def posting_gaps(spark, folder):
    index = index_of(spark, folder)
    return codec.gaps(index.postings.select("token", "review_id", "tf"), long=index.long_tokens)


def posting_decode(spark, folder):
    """Gaps in their order, without the reviews they came from, and reviews restored from them."""
    index = index_of(spark, folder)
    postings = codec.ordinals(index.postings.select("token", "review_id", "tf"), long=index.long_tokens)
    return codec.decoded(codec.gaps(postings, long=index.long_tokens).drop("review_id"), long=index.long_tokens)


def posting_codes(spark, folder):
    """Bytes of each gap, and the gap read from them again."""
    index = index_of(spark, folder)
    coded = codec.gaps(index.postings, long=index.long_tokens).select("token", "review_id", codec.code_hex(F.col("gap")).alias("code"))
    return coded.withColumn("gap", codec.code_number(F.col("code")))


def product_postings(spark, folder):
    return index_of(spark, folder).product_postings


def product_counts(spark, folder):
    return index_of(spark, folder).products


def posting_bytes(spark, folder):
    index = index_of(spark, folder)
    gapped = codec.gaps(index.postings, long=index.long_tokens)
    return gapped.groupBy("token").agg(F.sum(codec.code_bytes(F.col("gap"))).alias("gap_bytes"), F.sum(codec.code_bytes(F.col("tf"))).alias("tf_bytes"))


def front_coding_prefix(spark, folder):
    return codec.front_coded(index_of(spark, folder).token_ids())


def front_decoding(spark, folder):
    coded = codec.front_coded(index_of(spark, folder).token_ids())
    return codec.front_decoded(coded.select("token_id", "prefix", "suffix"))


def bigram_index(spark, folder):
    return index_of(spark, folder).bigrams


def bigram_ids(spark, folder):
    return index_of(spark, folder).bigram_ids()


def permuterm_index(spark, folder):
    return index_of(spark, folder).permuterm.select("rotation", "token", F.col("place").cast("int").alias("place"))


def review_attributes(spark, folder):
    return lookup.review_attributes(index_of(spark, folder), IDS)


def token_frequency(spark, folder):
    return lookup.frequencies(index_of(spark, folder), TERMS).select("term", "df")


def token_collection_frequency(spark, folder):
    return lookup.frequencies(index_of(spark, folder), TERMS).select("term", "cf")


def wildcard_frequency(spark, folder):
    return lookup.frequencies(index_of(spark, folder), WILD).select("term", "df")


def wildcard_collection_frequency(spark, folder):
    return lookup.frequencies(index_of(spark, folder), WILD).select("term", "cf")


def reviews_with_token(spark, folder):
    return lookup.reviews_with(index_of(spark, folder), TERMS)


def reviews_with_wildcard(spark, folder):
    return lookup.reviews_with(index_of(spark, folder), WILD)


def corpus_stats(spark, folder):
    return index_of(spark, folder).stats


def product_reviews(spark, folder):
    return lookup.reviews_of(index_of(spark, folder), PRODUCTS)


def wildcard_expand(spark, folder):
    return wildcard.expand_by(index_of(spark, folder), PATTERNS, "like")


def wildcard_permuterm(spark, folder):
    return wildcard.expand_by(index_of(spark, folder), PATTERNS, "permuterm")


def wildcard_bigram(spark, folder):
    return wildcard.expand_by(index_of(spark, folder), PATTERNS, "bigram")


def wildcard_bigram_short(spark, folder):
    return wildcard.expand_by(index_of(spark, folder), SHORT, "bigram")


def query_terms(spark, folder):
    return spark.createDataFrame([(t, n) for t, n in rank.term_counts([*VSM_WILD, "The", "it's", ""]).items()], "term string, qtf long")


def query_vector(spark, folder):
    weighed = rank.weigh(index_of(spark, folder), VSM_WILD)
    return spark.createDataFrame([(t.term, float(t.weight)) for t in weighed], "term string, weight double").select("term", F.round("weight", 9).alias("weight"))


def vsm_scores(spark, folder):
    return _rounded(rank.vsm_scores(index_of(spark, folder), VSM_WILD), "review_id")


def vsm_topk(spark, folder):
    return _rounded(rank.vector_space_search(index_of(spark, folder), VSM, 10), "review_id")


def vsm_wildcard_topk(spark, folder):
    return _rounded(rank.vector_space_search(index_of(spark, folder), VSM_WILD, 20), "review_id")


def vsm_unknown_term(spark, folder):
    return _rounded(rank.vector_space_search(index_of(spark, folder), UNKNOWN, 20), "review_id")


def lm_scores(spark, folder):
    return _log_rounded(rank.lm_scores(index_of(spark, folder), LM, LAMBDA))


def lm_topk(spark, folder):
    return _log_rounded(rank.language_model_search(index_of(spark, folder), LM, LAMBDA, 10))


def lm_wildcard_topk(spark, folder):
    return _log_rounded(rank.language_model_search(index_of(spark, folder), LM_WILD, LAMBDA, 20))


def lm_unknown_term(spark, folder):
    return _log_rounded(rank.language_model_search(index_of(spark, folder), UNKNOWN, LAMBDA, 20))


def product_scores(spark, folder):
    return _rounded(rank.product_scores(index_of(spark, folder), PRODUCT_QUERY), "product_id")


def product_topk(spark, folder):
    return _rounded(rank.product_search(index_of(spark, folder), PRODUCT_QUERY, 5), "product_id")


def stored_attributes(spark, folder):
    return lookup.review_attributes(stored_index_of(spark, folder, "permuterm"), IDS)


def stored_permuterm_expand(spark, folder):
    return wildcard.expand_terms(stored_index_of(spark, folder, "permuterm"), PATTERNS)


def stored_bigram_expand(spark, folder):
    return wildcard.expand_terms(stored_index_of(spark, folder, "bigram"), PATTERNS)


def stored_frequency(spark, folder):
    return lookup.frequencies(stored_index_of(spark, folder, "bigram"), WILD + TERMS)


def stored_reviews_with(spark, folder):
    return lookup.reviews_with(stored_index_of(spark, folder, "permuterm"), WILD)


def stored_product_reviews(spark, folder):
    return lookup.reviews_of(stored_index_of(spark, folder, "bigram"), PRODUCTS)


def stored_vsm_topk(spark, folder):
    return _rounded(rank.vector_space_search(stored_index_of(spark, folder, "permuterm"), VSM_WILD, 20), "review_id")


def stored_lm_topk(spark, folder):
    return _log_rounded(rank.language_model_search(stored_index_of(spark, folder, "bigram"), LM_WILD, LAMBDA, 20))


def stored_product_topk(spark, folder):
    return _rounded(rank.product_search(stored_index_of(spark, folder, "permuterm"), PRODUCT_QUERY, 5), "product_id")


def search_as_typed(spark, folder):
    found = rank.search(stored_index_of(spark, folder, "permuterm"), " ".join(VSM_WILD), "reviews", "vector", 20)
    return _rounded(found, "review_id")


QUERIES = {
    f.__name__: f
    for f in (
        vocabulary, parse_reviews, tokenize, term_frequencies, review_length, token_ids, product_ids, lexicon_stats, posting_gaps, posting_decode,
        product_postings, product_counts, posting_bytes, front_coding_prefix, bigram_index, bigram_ids, permuterm_index, review_attributes, token_frequency,
        token_collection_frequency, wildcard_frequency, wildcard_collection_frequency, reviews_with_token, reviews_with_wildcard, corpus_stats,
        product_reviews, wildcard_expand, wildcard_permuterm, wildcard_bigram, wildcard_bigram_short, query_terms, query_vector, vsm_scores, vsm_topk,
        read_dump_reviews, posting_codes, front_decoding, stored_attributes, stored_permuterm_expand, stored_bigram_expand, stored_frequency, stored_reviews_with,
        stored_product_reviews, stored_vsm_topk, stored_lm_topk, stored_product_topk, search_as_typed, vsm_wildcard_topk, vsm_unknown_term, lm_scores, lm_topk, lm_wildcard_topk, lm_unknown_term, product_scores, product_topk,
    )
}
