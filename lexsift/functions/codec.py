"""Sizes and forms of compressed posting lists and dictionaries, as analytics over rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

#: Below these a number takes 1, 2 or 3 bytes, else 4.
LIMITS = (64, 16384, 4194304)
#: Words in a block of the front-coded dictionary.
BLOCK = 10


def code_bytes(number: Column) -> Column:
    """Bytes of a whole number whose length is kept in its two top bits."""
    one, two, three = LIMITS
    return F.when(number < one, 1).when(number < two, 2).when(number < three, 3).otherwise(4)


def code_hex(number: Column) -> Column:
    """The bytes of a whole number in hexadecimal digits: the two top bits hold how many bytes follow the first."""
    size = code_bytes(number)
    return F.lower(F.lpad(F.hex(number + _mark(size)), size * 2, "0"))


def code_number(code: Column) -> Column:
    """The number that ``code_hex`` wrote."""
    return F.conv(code, 16, 10).cast("long") - _mark(F.length(code) / 2)


def _mark(size: Column) -> Column:
    return F.when(size == 1, 0).when(size == 2, 1 << 14).when(size == 3, 2 << 22).otherwise(3 << 30).cast("long")


#: Numbers in a stretch of a posting list.  Lists of more rows are cut into stretches that are worked on apart and led by
#: what the ones before leave, so the list of a word that is in every review is no single task's work.
STRETCH = 1 << 20


def long_keys(rows: DataFrame, key: str = "token", stretch: int = STRETCH) -> list:
    """Keys of more than ``stretch`` rows; there is at most one for each ``stretch`` rows."""
    return [r[0] for r in rows.groupBy(key).count().filter(F.col("count") > stretch).select(key).collect()]


def gaps(postings: DataFrame, key: str = "token", stretch: int = STRETCH, long: list | None = None) -> DataFrame:
    """``postings(key, review_id, ...)`` with gap: the step from the key's previous review, the first from 0.

    ``long``: the keys of more than ``stretch`` rows, counted where not given.
    """
    step = lambda w: (F.col("review_id") - F.lag("review_id", 1, 0).over(w)).cast("int")
    return _along(postings, key, "review_id", "review_id", F.max, step, "gap", stretch, long)


def ordinals(postings: DataFrame, key: str = "token", stretch: int = STRETCH, long: list | None = None) -> DataFrame:
    """``postings(key, review_id, ...)`` with position: the place, from 1, in the key's list by review."""
    step = lambda w: F.sum("_n").over(_so_far(w))
    return _along(postings.withColumn("_n", F.lit(1).cast("long")), key, "review_id", "_n", F.sum, step, "position", stretch, long).drop("_n")


def decoded(gapped: DataFrame, key: str = "token", stretch: int = STRETCH, long: list | None = None) -> DataFrame:
    """(key, review_id, tf): review ids again, as running sums of ``gapped(key, position, gap, tf)``."""
    step = lambda w: F.sum("gap").over(_so_far(w)).cast("int")
    return _along(gapped, key, "position", "gap", F.sum, step, "review_id", stretch, long).select(key, "review_id", "tf")


def _so_far(window: WindowSpec) -> WindowSpec:
    return window.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _along(rows: DataFrame, key: str, order: str, value: str, of: Callable, step: Callable, name: str, stretch: int, long: list | None) -> DataFrame:
    """``rows`` with column ``name``: ``step(window)`` along each key's list by ``order``.

    Other lists are whole in one task and dealt out by key alone, so steps after each other share one shuffle.  A stretch of a long list
    starts with a row that holds ``of`` all values of the stretches before it; that row is then dropped.  A null key is a key like any other.
    """
    long = long_keys(rows, key, stretch) if long is None else long
    done = lambda some, *by: some.withColumn(name, step(Window.partitionBy(key, *by).orderBy(order)))
    if not long:
        return done(rows)
    is_long = F.coalesce(F.col(key).isin([k for k in long if k is not None]), F.lit(None in long))
    cut = rows.filter(is_long).withColumns({"_part": F.floor(F.col(order) / stretch).cast("long"), "_lead": F.lit(False)})
    before = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    left = cut.groupBy(key, "_part").agg(of(value).alias("_of")).select(key, "_part", of("_of").over(before).alias(value), F.lit(True).alias("_lead"))
    led = cut.unionByName(left.filter(F.col(value).isNotNull()), allowMissingColumns=True)
    whole = done(rows.filter(~is_long))
    return whole.unionByName(done(led, "_part").filter(~F.col("_lead")).select(*whole.columns))


def shared_prefix(a: Column, b: Column) -> Column:
    """Length of the longest common prefix of two strings."""
    least = F.least(F.length(a), F.length(b))
    steps = F.when(least > 0, F.sequence(F.lit(1), least)).otherwise(F.array().cast("array<int>"))
    return F.size(F.filter(steps, lambda i: F.substring(a, F.lit(1), i) == F.substring(b, F.lit(1), i)))


def front_coded(numbered: DataFrame) -> DataFrame:
    """(token_id, token, prefix, suffix) of ``numbered(token_id, token)``: heads of blocks stand whole."""
    block = Window.partitionBy(F.floor(F.col("token_id") / BLOCK)).orderBy("token_id")
    before = F.lag("token").over(block)
    prefix = F.coalesce(shared_prefix(before, F.col("token")), F.lit(0)).cast("int")
    return numbered.select("token_id", "token", prefix.alias("prefix")).withColumn("suffix", F.expr("substring(token, prefix + 1)"))


def front_decoded(coded: DataFrame) -> DataFrame:
    """(token_id, token) restored from ``front_coded``'s token_id, prefix and suffix; a block is one row meanwhile."""
    block = F.floor(F.col("token_id") / BLOCK).alias("_block")
    blocks = coded.groupBy(block).agg(F.array_sort(F.collect_list(F.struct("token_id", "prefix", "suffix"))).alias("words"))  # BLOCK words
    none = F.array().cast("array<struct<token_id:int,token:string>>")

    def add(done: Column, word: Column) -> Column:
        before = F.when(F.size(done) > 0, F.element_at(done, -1)["token"]).otherwise("")
        token = F.concat(before.substr(F.lit(1), word["prefix"]), word["suffix"])
        return F.concat(done, F.array(F.struct(word["token_id"].alias("token_id"), token.alias("token"))))

    return blocks.select(F.inline(F.aggregate("words", none, add)))
