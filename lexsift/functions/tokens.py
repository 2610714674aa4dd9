"""Token expressions: lower-cased runs of ASCII letters and digits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

ALPHABET = "$0123456789abcdefghijklmnopqrstuvwxyz"


def tokens(text: Column) -> Column:
    """All tokens of a text in order, repeats kept; null text has none."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), "")


def counted(words: Column) -> Column:
    """Each distinct word of a list as ``token``, in order, with ``tf``: how often it stands there."""

    def runs(w: Column) -> Column:
        starts = F.array_compact(F.transform(w, lambda x, i: F.when(~x.eqNullSafe(F.get(w, i - 1)), i)))
        return _bound(starts, lambda s: F.transform(s, lambda at, k: F.struct(F.get(w, at).alias("token"), (F.coalesce(F.get(s, k + 1), F.size(w)) - at).cast("long").alias("tf"))))

    return _bound(F.sort_array(words), runs)


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value computed once a row however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def bigrams(token: Column) -> Column:
    """Pairs of neighbouring characters of ``$token$``, each once."""
    framed = F.concat(F.lit("$"), token, F.lit("$"))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(token) + 1), lambda i: F.substring(framed, i, 2)))


def bigram_id(bigram: Column) -> Column:
    """Place of a bigram among all pairs over the alphabet, in alphabet order."""
    place = [F.instr(F.lit(ALPHABET), F.substring(bigram, k, 1)) - 1 for k in (1, 2)]
    return (place[0] * len(ALPHABET) + place[1]).cast("int")


def rotations(token: Column) -> Column:
    """All rotations of ``$token``."""
    framed = F.concat(F.lit("$"), token)
    size = F.length(token) + 1
    return F.transform(F.sequence(F.lit(1), size), lambda i: F.substring(F.concat(framed, framed), i, size))


def unrotated(rotation: Column) -> Column:
    """The token that a rotation is of."""
    return F.concat(F.substring_index(rotation, "$", -1), F.substring_index(rotation, "$", 1))


def like_pattern(term: str) -> str:
    """A term with ``*`` as an SQL LIKE pattern; nothing else is special."""
    return term.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_").replace("*", "%")


def matches(token: Column, term: str) -> Column:
    """Whether a token is the term, or fits it where it holds ``*``.  The term is lower-cased."""
    term = term.lower()
    if "*" not in term:
        return token == term
    first, *rest = term.split("*")
    if not any(rest):
        return token.startswith(first)  # a prefix reaches the Parquet scan
    return token.like(like_pattern(term))
