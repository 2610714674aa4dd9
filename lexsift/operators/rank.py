"""Ranking: vector space, smoothed language model, products."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .index import SearchIndex
from .lookup import frequencies, term_postings


def term_counts(query: Sequence[str]) -> dict[str, int]:
    """Terms of a query, lower-cased and counted, in order; they are not tokenised further."""
    return dict(sorted(Counter(t.lower() for t in query).items()))


@dataclass(frozen=True)
class Term:
    term: str
    qtf: int
    df: int
    cf: int
    weight: float


def weigh(index: SearchIndex, query: Sequence[str]) -> list[Term]:
    """Query terms with their ltc weights, by IEEE rules where a term is unknown or all norms vanish.

    An unknown term has an infinite idf: it makes the norm infinite, all other weights 0 and its
    own not a number.  If every term is in all reviews the norm is 0 and no weight is a number.
    A term with ``*`` may have a df above the number of reviews, and then a negative idf.
    """
    counts = term_counts(query)
    if not counts:
        return []
    found = {r.term: r for r in frequencies(index, list(counts)).collect()}  # a row for each query term
    n = index.totals[0]
    raw = {t: (1 + math.log10(q)) * (math.log10(n / found[t].df) if found[t].df else math.inf) for t, q in counts.items()}
    norm = math.sqrt(sum(w * w for w in raw.values()))

    def divided(w: float) -> float:
        if norm == 0 or (math.isinf(norm) and math.isinf(w)):
            return math.nan
        return w / norm

    return [Term(t, q, found[t].df, found[t].cf, divided(raw[t])) for t, q in counts.items()]


def _term_frequencies(index: SearchIndex, terms: list[Term]) -> DataFrame:
    """(review_id, length, tf0, tf1, ...): one row for each review with any of the terms.

    One pass over the postings with all terms side by side: tokens reach the scan as a list, sums
    are partial before the one shuffle, and scores are then computed within a row in term order.
    """
    some, fitting = term_postings(index, [t.term for t in terms])
    own = lambda t: F.col("term") == t.term if fitting is None else F.col("token").isin(fitting[t.term])
    sums = [F.coalesce(F.sum(F.when(own(t), F.col("tf"))), F.lit(0)).alias(f"tf{k}") for k, t in enumerate(terms)]
    return some.groupBy("review_id", "length").agg(*sums)


def _nothing(index: SearchIndex) -> DataFrame:
    return index.reviews.limit(0).select("review_id", F.lit(0.0).alias("rank"))


def _sum(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts, F.lit(0.0))


def vsm_scores(index: SearchIndex, query: Sequence[str]) -> DataFrame:
    """(review_id, rank): sum over terms of (1 + log10 tf) times the query weight."""
    terms = weigh(index, query)
    if not terms:
        return _nothing(index)
    tf = [F.col(f"tf{k}") for k in range(len(terms))]
    parts = [F.when(c > 0, (1 + F.log10(c)) * F.lit(t.weight)).otherwise(0.0) for c, t in zip(tf, terms, strict=True)]
    return _term_frequencies(index, terms).select("review_id", _sum(parts).alias("rank"))


def lm_scores(index: SearchIndex, query: Sequence[str], lam: float = 0.5) -> DataFrame:
    """(review_id, rank): product over terms of (lam * tf / length + (1 - lam) * cf / T) ** qtf.

    Factors are multiplied in term order, so equal texts have equal ranks.
    """
    terms = weigh(index, query)
    if not terms:
        return _nothing(index)
    total = index.totals[1]
    parts = [F.pow(F.lit(lam) * F.col(f"tf{k}") / F.col("length") + F.lit((1 - lam) * t.cf / total if total else 0.0), F.lit(float(t.qtf))) for k, t in enumerate(terms)]
    return _term_frequencies(index, terms).select("review_id", reduce(lambda a, b: a * b, parts, F.lit(1.0)).alias("rank"))


def product_scores(index: SearchIndex, query: Sequence[str]) -> DataFrame:
    """(product_id, rank): mean over its matching reviews of 0.8 * vsm * score / 5 + 0.2 * help * vsm.

    ``help`` is the share of helpful votes, 0.5 without votes.
    """
    rank = F.col("rank")
    helpful = F.when(F.col("help_den") == 0, 0.5).otherwise(F.try_divide(F.col("help_num").cast("double"), F.col("help_den").cast("double")))
    blended = vsm_scores(index, query).join(index.reviews, "review_id").select("product_id", (0.8 * rank * F.col("score") / 5 + 0.2 * helpful * rank).alias("rank"))
    return blended.groupBy("product_id").agg(F.avg("rank").alias("rank"))


def top(scores: DataFrame, k: int, key: str) -> DataFrame:
    """The k best rows, ties to the smaller key.  Ranks are compared as they are."""
    return scores.orderBy(F.col("rank").desc_nulls_last(), F.col(key).asc()).limit(max(0, k))


def vector_space_search(index: SearchIndex, query: Sequence[str], k: int) -> DataFrame:
    return top(vsm_scores(index, query), k, "review_id")


def log_rank() -> Column:
    """Language-model ranks on a log scale, null for 0, for showing: they are too small for fixed decimals."""
    return F.when(F.col("rank") > 0, F.round(F.log10("rank"), 9))


def language_model_search(index: SearchIndex, query: Sequence[str], lam: float, k: int) -> DataFrame:
    return top(lm_scores(index, query, lam), k, "review_id")


def product_search(index: SearchIndex, query: Sequence[str], k: int) -> DataFrame:
    return top(product_scores(index, query), k, "product_id")


def search(index: SearchIndex, text: str, goal: str = "reviews", method: str = "vector", k: int = 10_000, lam: float = 0.5) -> DataFrame:
    """Search as typed: terms are split at single spaces.  goal: reviews or products."""
    query = text.split(" ")
    if goal == "products":
        return product_search(index, query, k)
    if goal != "reviews" or method not in ("vector", "language"):
        raise ValueError("goal is 'reviews' or 'products', method 'vector' or 'language'")
    return vector_space_search(index, query, k) if method == "vector" else language_model_search(index, query, lam, k)
