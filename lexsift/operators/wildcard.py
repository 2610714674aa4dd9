"""Tokens that fit terms with ``*``: by LIKE, by rotations, by bigrams.  All give the same tokens."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexsift.functions.tokens import ALPHABET, matches

from .index import SearchIndex


def expand_terms(index: SearchIndex, terms: Sequence[str]) -> DataFrame:
    """(term, token, df, cf) for every token that a term fits, through the index's own access path.

    Terms without ``*`` are looked up in the lexicon; the others come from the stored rotations or
    bigrams, by ranges and lists of keys that reach the scan, and meet the lexicon by token.
    """
    terms = list(dict.fromkeys(t.lower() for t in terms))
    wild = [t for t in terms if "*" in t]
    if index.access == "like" or not wild:
        return expand(index.lexicon, terms)
    exact = expand(index.lexicon, [t for t in terms if "*" not in t])
    found = expand_by(index, wild, index.access).join(index.lexicon, "token").select("term", "token", "df", "cf")
    return exact.union(found)


def fitting_tokens(index: SearchIndex, terms: Sequence[str]) -> DataFrame:
    """(term, token) as ``expand_terms`` has them, without a join to the lexicon."""
    terms = list(dict.fromkeys(t.lower() for t in terms))
    wild = [t for t in terms if "*" in t]
    if index.access == "like" or not wild:
        return expand(index.lexicon, terms).select("term", "token")
    exact = expand(index.lexicon, [t for t in terms if "*" not in t]).select("term", "token")
    return exact.union(expand_by(index, wild, index.access))


def expand(lexicon: DataFrame, terms: Sequence[str]) -> DataFrame:
    """(term, token, df, cf) for every lexicon token that a term fits; one scan for all terms."""
    return fitting(lexicon.select("token", "df", "cf"), terms)


def fitting(rows: DataFrame, terms: Sequence[str]) -> DataFrame:
    """``rows(token, ...)`` with column ``term`` before the others, once for each term that the token fits."""
    terms = list(dict.fromkeys(t.lower() for t in terms))
    if not terms:
        return rows.limit(0).select(F.lit("").alias("term"), *rows.columns)
    token = F.col("token")
    # The disjunction is redundant after the explode, but reaches the scan.
    some = rows.filter(reduce(lambda a, b: a | b, (matches(token, t) for t in terms)))
    fits = F.array_compact(F.array(*(F.when(matches(token, t), F.lit(t)) for t in terms)))
    return some.select(F.explode(fits).alias("term"), *rows.columns)


def rotated_key(term: str) -> str:
    """The prefix of rotations to look for: the longest part of the term turned past its first ``*``."""
    framed = "$" + term.lower()
    at = framed.index("*") + 1
    parts = (framed[at:] + framed[: at - 1]).split("*")
    return max(parts, key=len)  # of equals the first


def required_bigrams(term: str) -> tuple[list[str], bool]:
    """Bigrams and whether all (True) or any of them must be in a token.

    Without a part of two characters the choice is all pairs around one character, or around the
    frame where the term is nothing but ``*``.
    """
    parts = ("$" + term.lower() + "$").split("*")
    needed = [p[i : i + 2] for p in parts for i in range(len(p) - 1)]
    if needed:
        return list(dict.fromkeys(needed)), True
    single = next((p for p in parts if p and p != "$"), "$")
    return list(dict.fromkeys(x for c in ALPHABET for x in (c + single, single + c))), False


def candidates_by_rotation(index: SearchIndex, term: str) -> DataFrame:
    """(token): a superset of the fitting tokens, by a prefix of the sorted rotations."""
    key = rotated_key(term)
    found = index.permuterm.filter(F.col("rotation").startswith(key)).select("token")
    return found if "$" in key else found.distinct()  # the frame stands once in a token, so no two of its rotations start so


def candidates_by_bigram(index: SearchIndex, term: str) -> DataFrame:
    """(token): a superset of the fitting tokens, by their bigrams."""
    if not term.strip("*"):
        return index.bigrams.filter(F.col("bigram").startswith("$")).select("token")  # one of each token
    needed, every = required_bigrams(term)
    found = index.bigrams.filter(F.col("bigram").isin(needed))
    if not every:
        return found.select("token").distinct()
    return found.groupBy("token").agg(F.count("*").alias("n")).filter(F.col("n") == len(needed)).select("token")


def expand_by(index: SearchIndex, terms: Sequence[str], path: str) -> DataFrame:
    """(term, token) by the access path 'permuterm', 'bigram' or 'like', filtered exactly."""
    if path == "like":
        return expand(index.lexicon, terms).select("term", "token")
    candidates = {"permuterm": candidates_by_rotation, "bigram": candidates_by_bigram}[path]
    terms = list(dict.fromkeys(t.lower() for t in terms))
    frames = [candidates(index, t).filter(matches(F.col("token"), t)).select(F.lit(t.lower()).alias("term"), "token") for t in terms]
    return reduce(DataFrame.union, frames)
