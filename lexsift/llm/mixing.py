"""Mixing by iterative proportional fitting, in DataFrame functions only.

Token mass is summed in cells of source, language and topic, and the cells' weights are raked in turn to the
target margins.  Sources stay distributed.  Where pairs of language and topic are few, which is checked, the
driver carries their factors from one pass over the sources to the next; else all three margins are
grouped sums that meet the cells again.  Both give the same weights, and no margin has a bound on its classes.
Documents are then kept with the calibrated probability of their cell.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, materialise

WHITE = r"[\x20\x09-\x0D]+"
TOPICS = ("contact", "legal", "technical", "tabular", "prose")
MARGINS = ("source", "language", "topic")
SEED, POWER, KEEP = 11, 0.7, 0.8
#: Rounds of raking at most, and the change of a factor below which raking has settled.
ROUNDS, CLOSE = 100, 1e-12
#: Pairs of language and topic whose factors the driver carries at most.
PAIRS = 4096


def token_count(text: Column) -> Column:
    """Words between ASCII white space."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), WHITE), "")).cast("long")


def topic_of(text: Column) -> Column:
    """A coarse topic from marks in the whole text; the first that fits of TOPICS."""
    text = F.coalesce(text, F.lit(""))
    legal = F.contains(text, F.lit("icense")) | F.contains(text, F.lit("opyright"))
    technical = F.contains(text, F.lit("token = ")) | F.contains(text, F.lit("{")) | F.contains(text, F.lit("://"))
    return F.when(F.contains(text, F.lit("@")), "contact").when(legal, "legal").when(technical, "technical").when(F.contains(text, F.lit("|")), "tabular").otherwise("prose")


def _cell_columns(topic: Column | None) -> list[Column]:
    text, blank = F.col("text").cast("string"), F.lit("")
    kind = topic_of(text) if topic is None else F.coalesce(topic.cast("string"), blank)
    return [F.coalesce(F.col("source").cast("string"), blank).alias("source"), F.coalesce(F.col("lang").cast("string"), blank).alias("language"), kind.alias("topic")]


def _chance(seed: int) -> Column:
    """A number from 0 to 1, below 1, that depends on doc_id alone; on the text where there is no doc_id."""
    named = F.coalesce(F.col("doc_id").cast("long").cast("string"), F.concat(F.lit("?"), F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")))))
    return F.conv(F.substring(F.md5(F.concat(named, F.lit(f":{seed}"))), 1, 13), 16, 10).cast("double") / F.lit(2.0**52)


def cell_rows(docs: DataFrame, topic: Column | None = None, seed: int = SEED) -> DataFrame:
    """(doc_id, source, language, topic, n_tokens, chance), written down once."""
    return materialise(docs.select(F.col("doc_id").cast("long").alias("doc_id"), *_cell_columns(topic), token_count(F.col("text").cast("string")).alias("n_tokens"), _chance(seed).alias("chance")), "cells")


def _goals(spark: SparkSession, cells: DataFrame, margin: str, given: DataFrame | dict[str, float] | None, power: float) -> DataFrame:
    """(margin, goal): target shares of the classes that have tokens; they add up to 1, or are all 0."""
    seen = cells.groupBy(margin).agg(F.sum("mass").alias("n")).filter("n > 0")
    if given is None:
        goals = seen.select(margin, F.pow("n", F.lit(power)).alias("goal"))
    else:
        if isinstance(given, dict):
            told = F.array(*(F.struct(F.lit(k).cast("string").alias(margin), F.lit(float(v)).alias("target")) for k, v in given.items()))
            given = spark.range(1).select(F.inline(told)) if given else seen.select(margin, F.lit(0.0).alias("target"))
        given = given.groupBy(F.coalesce(F.col(margin).cast("string"), F.lit("")).alias(margin)).agg(F.sum(F.col("target").cast("double")).alias("goal"))
        goals = seen.join(given, margin, "left").select(margin, F.coalesce("goal", F.lit(0.0)).alias("goal"))
    goals = cut(goals)
    total = goals.agg(F.sum("goal")).first()[0] or 1.0
    return goals.withColumn("goal", F.col("goal") / total)


def _rake_by_cell(cells: DataFrame, start: float, rounds: int, close: float) -> tuple[DataFrame, float]:
    """Cells with their weight, and the largest change of a factor in the last round; all margins by grouped sums."""
    cells, left = cut(cells.withColumn("weight", F.lit(start))), 0.0
    for _ in range(rounds):
        changes = []
        for margin in MARGINS:
            sums = cells.groupBy(margin).agg(F.sum(F.col("mass") * F.col("weight")).alias("_sum"))
            change = F.when(F.col("_sum") > 0, F.col(f"goal_{margin}") / F.col("_sum")).otherwise(0.0)
            moved = F.when((F.col(f"goal_{margin}") > 0) & (F.col("_sum") > 0), F.abs(change - 1)).otherwise(0.0)
            cells = cells.join(sums, margin).withColumns({"weight": F.col("weight") * change, f"_{margin}": moved}).drop("_sum")
            changes.append(f"_{margin}")
        cells = cut(cells.withColumn("_moved", F.greatest(*changes[1:])).drop(*changes))
        left, cells = cells.agg(F.max("_moved")).first()[0], cells.drop("_moved")
        if left < close:
            break
    return cells, left


def _rake_by_source(cells: DataFrame, start: float, rounds: int, close: float) -> tuple[DataFrame, float]:
    """As above, with a row for each source; at most PAIRS sums come to the driver in a round."""
    numbered = cells.select("language", "topic", "goal_language", "goal_topic").distinct().withColumn("pair", F.row_number().over(Window.orderBy("language", "topic")) - 1)  # at most PAIRS rows
    numbered = cut(numbered)
    pairs = [tuple(r)[:4] for r in numbered.orderBy("pair").collect()]
    goals = [{p[side]: p[side + 2] for p in pairs} for side in (0, 1)]
    factors = [dict.fromkeys(g, 1.0) for g in goals]
    block = F.collect_list(F.struct("language", "topic", "pair", "mass")).alias("block")  # at most PAIRS cells
    table = cut(cells.join(numbered.select("language", "topic", "pair"), ["language", "topic"]).groupBy("source", "goal_source").agg(block))

    def factor(weights: list[float]):
        now = F.aggregate("block", F.lit(0.0), lambda a, x: a + x.mass * F.element_at(F.lit(weights), x.pair + 1))
        return F.when(now > 0, F.col("goal_source") / now).otherwise(0.0)

    before, left = [start] * len(pairs), 0.0
    inner = before
    for _ in range(rounds):
        before, left = inner, 0.0
        sums = table.select(factor(before).alias("f"), F.explode("block").alias("c")).groupBy("c.pair").agg(F.sum(F.col("f") * F.col("c.mass")).alias("s")).collect()
        for side in (0, 1):
            seen = dict.fromkeys(goals[side], 0.0)
            for k, s in sums:
                seen[pairs[k][side]] += s * factors[0][pairs[k][0]] * factors[1][pairs[k][1]]
            for name, s in seen.items():
                change = goals[side][name] / s if s > 0 else 0.0
                factors[side][name] *= change
                left = max(left, abs(change - 1) if goals[side][name] > 0 and s > 0 else 0.0)
        inner = [factors[0][p[0]] * factors[1][p[1]] for p in pairs]
        if left < close:
            break
    rows = table.select("source", factor(before).alias("f"), F.explode("block").alias("c"))
    return rows.select("source", "c.language", "c.topic", "c.mass", (F.col("f") * F.element_at(F.lit(inner), F.col("c.pair") + 1)).alias("weight")), left


def calibrate(rows: DataFrame, source_targets: DataFrame | None = None, language_targets: dict[str, float] | None = None, topic_targets: dict[str, float] | None = None, power: float = POWER, keep: float = KEEP, rounds: int = ROUNDS, close: float = CLOSE) -> DataFrame:
    """Cells (source, language, topic, weight, probability) of ``rows(source, language, topic, n_tokens)``.

    ``weight`` is the raked factor of a token; after raking, weighted tokens meet the targets of all three
    margins.  Targets default to the observed shares raised to ``power``, which lifts small ones;
    ``source_targets(source, target)`` and the others need not add up to 1; classes without a target
    have target 0, and targets of classes without tokens are spread over the others.  Raking ends when no
    factor changes by more than ``close``; where ``rounds`` are not enough (targets that the
    cells can't meet together) the last weights stand, with a warning.  ``probability`` is min(1, r * weight), with
    r such that the expected tokens kept are the share ``keep`` of all (or all that have weight, if fewer).
    Cells without tokens are left out.  Null sources and languages are classes of their own, named ''.
    """
    # Partial sums come before the shuffle, so a source with a third of all rows is a few rows here.
    cells = cut(rows.groupBy(*MARGINS).agg(F.sum("n_tokens").cast("double").alias("mass")).filter("mass > 0"))
    total = cells.agg(F.sum("mass")).first()[0] or 0.0
    for margin, given in zip(MARGINS, (source_targets, language_targets, topic_targets), strict=True):
        cells = cells.join(_goals(rows.sparkSession, cells, margin, given, power).withColumnRenamed("goal", f"goal_{margin}"), margin)
    cells = cut(cells)
    few = cells.select("language", "topic").distinct().limit(PAIRS + 1).count() <= PAIRS
    cells, left = (_rake_by_source if few else _rake_by_cell)(cells, 1 / total if total else 0.0, rounds if total else 0, close)
    if left >= close:
        warnings.warn(f"margins not met after {rounds} rounds of raking; the last changed a factor by {left:.3g}", stacklevel=2)

    cells = materialise(cells.select(*MARGINS, "mass", (F.col("weight") * total).alias("weight")), "weights")
    # The factor r of the budget: cells that are kept whole, and the rest in proportion; a larger r only adds whole cells.
    whole = lambda r: F.col("weight") * F.lit(r) >= 1
    spread = F.col("mass") * F.col("weight")
    some, open_ = cells.agg(F.sum(F.when(F.col("weight") > 0, F.col("mass"))), F.sum(spread)).first()
    budget, kept, r = min(some or 0.0, keep * total), 0.0, 0.0
    while open_:
        raised = (budget - kept) / open_
        if raised <= r:
            break
        r = raised
        kept, open_ = cells.agg(F.coalesce(F.sum(F.when(whole(r), F.col("mass"))), F.lit(0.0)), F.sum(F.when(~whole(r), spread))).first()
    if total and not open_:
        r = 1e300  # every cell that has weight is kept whole
    return cells.select(*MARGINS, "weight", F.when(F.col("weight") > 0, F.least(F.lit(1.0), F.lit(r) * F.col("weight"))).otherwise(0.0).alias("probability"))


def mix(docs: DataFrame, seed: int = SEED, topic: Column | None = None, **options) -> DataFrame:
    """(doc_id, source, language, topic, n_tokens, weight, probability, kept) for every row of ``docs``.

    ``docs`` has doc_id, text, lang and source; options are those of ``calibrate``.  ``kept`` compares a hash of doc_id
    with the probability of the document's cell, so a repeated row has the same fate; rows without a doc_id draw by
    their text.  Documents of a cell without any word have weight and probability 1.  An empty
    table gives an empty result.  Extra columns are ignored.
    """
    rows = cell_rows(docs, topic, seed)
    joined = rows.join(calibrate(rows, **options), list(MARGINS), "left")
    one = F.lit(1.0)
    return joined.select("doc_id", *MARGINS, "n_tokens", F.coalesce("weight", one).alias("weight"), F.coalesce("probability", one).alias("probability"), (F.col("chance") < F.coalesce("probability", one)).alias("kept"))


def sample(docs: DataFrame, seed: int = SEED, topic: Column | None = None, **options) -> DataFrame:
    """The rows of ``docs`` that ``mix`` keeps, with all their columns.

    A document's cell is computed again from its own row, and only the table of cells is joined.
    """
    cells = calibrate(cell_rows(docs, topic, seed), **options)
    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("whole"), _chance(seed).alias("chance"), *_cell_columns(topic))
    joined = keyed.join(cells.drop("weight"), list(MARGINS), "left")
    return joined.filter(F.col("chance") < F.coalesce("probability", F.lit(1.0))).select("whole.*")
