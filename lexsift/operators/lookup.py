"""Point lookups and statistics, for many arguments at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .index import SearchIndex
from .wildcard import expand_terms, fitting, fitting_tokens


def review_attributes(index: SearchIndex, ids: Sequence[int]) -> DataFrame:
    """Attributes of the reviews asked for; -1 and a null product where there is no such review."""
    spark = index.reviews.sparkSession
    asked = spark.createDataFrame([(int(i),) for i in dict.fromkeys(ids)], "review_id int")
    found = index.reviews.filter(F.col("review_id").isin([int(i) for i in ids]))
    none = F.lit(-1)
    numbers = [F.coalesce(F.col(c).cast("int"), none).alias(c) for c in ("score", "help_num", "help_den", "length")]
    return asked.join(found, "review_id", "left").select("review_id", "product_id", *numbers)


def frequencies(index: SearchIndex, terms: Sequence[str]) -> DataFrame:
    """(term, df, cf), 0 for unknown terms.

    Of a term with ``*`` both are sums over its tokens, so a review that holds two of them counts
    twice in df.
    """
    spark = index.lexicon.sparkSession
    asked = spark.createDataFrame([(t.lower(),) for t in dict.fromkeys(terms)], "term string").distinct()
    found = expand_terms(index, terms).groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))
    zero = F.lit(0)
    return asked.join(found, "term", "left").select("term", F.coalesce("df", zero).cast("long").alias("df"), F.coalesce("cf", zero).cast("long").alias("cf"))


#: Tokens of a query that are looked for by a list in the scan; where more fit, terms are compared with the postings' tokens.
LISTED = 1024


def term_postings(index: SearchIndex, terms: Sequence[str]) -> tuple[DataFrame, dict[str, list[str]] | None]:
    """Postings of the tokens that terms fit, and the tokens of each term.

    Terms are expanded once, through the index.  Up to LISTED tokens are then a list (few) or a range (more) that the
    sorted postings' files are picked by.  Beyond, the second result is None and the
    postings have a column ``term`` and a row for each term that fits: each token is compared with the terms as it is read, as
    a join to that many tokens would shuffle all postings.
    """
    terms = list(dict.fromkeys(t.lower() for t in terms))
    plain = {t: [t] for t in terms}
    if not any("*" in t for t in terms):
        return index.postings.filter(F.col("token").isin(terms)), plain
    some = fitting_tokens(index, terms).limit(LISTED + 1).collect()
    if len(some) > LISTED:
        return fitting(index.postings, terms), None
    found: dict[str, list[str]] = {t: [] for t in terms}
    for term, token in some:
        found[term].append(token)
    return index.postings.filter(F.col("token").isin(sorted({t for _, t in some}))), found


def reviews_with(index: SearchIndex, terms: Sequence[str]) -> DataFrame:
    """(term, review_id, tf): reviews that hold a term; tf sums over the tokens it fits."""
    some, found = term_postings(index, terms)
    if found is not None:
        chosen = F.array_compact(F.array(*(F.when(F.col("token").isin(tokens), F.lit(t)) for t, tokens in found.items())))
        some = some.select(F.explode(chosen).alias("term"), "review_id", "tf")
    return some.groupBy("term", "review_id").agg(F.sum("tf").alias("tf"))


def reviews_of(index: SearchIndex, products: Sequence[str]) -> DataFrame:
    """(product_id, review_id) of the products asked for; names are case-sensitive."""
    return index.reviews.filter(F.col("product_id").isin(list(products))).select("product_id", "review_id")
