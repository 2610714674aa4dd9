"""Exact top-k inner products by pivot-table elimination.

Every vector stores its distances to a fixed set of pivots.  For a query, the largest
difference of two such distances is a lower bound of the distance to a candidate and, with both
lengths, an upper bound of the inner product.  Candidates are evaluated in the order of that
bound until no bound left can reach the k-th best score.

Rows are kept in blocks of neighbours, by nearest pivot, with the range of each pivot's
distances.  A query first searches its own block; with the k-th score found there it visits only
those blocks whose ranges leave room for a better one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise

#: Pivots, rows and queries that meet in one task, and most blocks: beyond, blocks get larger, so that their table stays small.
PIVOTS, BLOCK, QUERY_BLOCK, MOST_BLOCKS = 32, 2048, 2048, 1 << 14
LARGEST, LOWEST = 2**63 - 1, -(2**63)


def products(rows: np.ndarray, query: np.ndarray, length: float) -> np.ndarray:
    """Inner products of whole numbers, exact; ``length`` bounds them.  Those beyond 64 bits become the nearest long."""
    if length < 2**52:
        return (rows.astype(np.float64) @ query.astype(np.float64)).astype(np.int64)  # doubles hold such sums exactly
    if length < 2**62:
        return rows @ query
    exact = [sum(a * b for a, b in zip(row, query.tolist(), strict=True)) for row in rows.tolist()]
    return np.array([max(LOWEST, min(LARGEST, x)) for x in exact], np.int64)


def eliminate(queries: np.ndarray, q_table: np.ndarray, rows: np.ndarray, table: np.ndarray, allowed, k: int, ids: np.ndarray, least: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query position, row positions, scores) of the k best rows of each query, ties to smaller ids.

    ``queries`` and ``rows`` hold whole numbers as int64; tables hold distances to the pivots;
    ``allowed(q)`` is a mask of rows that count for query q.  Rows that surely score below ``least``
    of the query may be left out.
    """
    q_norm, r_norm = (queries.astype(float) ** 2).sum(1), (rows.astype(float) ** 2).sum(1)
    by_pivot, longest = np.ascontiguousarray(table.T), r_norm.max(initial=0)
    apart, one = np.empty(len(rows)), np.empty(len(rows))
    for q in range(len(queries)):
        apart[:] = 0
        for p in range(len(by_pivot)):
            np.subtract(by_pivot[p], q_table[q, p], out=one)
            np.maximum(apart, np.abs(one, out=one), out=apart)
        bound = (q_norm[q] + r_norm - apart * apart) / 2
        bound += 0.25 + 1e-9 * (q_norm[q] + r_norm)  # rounding never hides a candidate
        floor = -np.inf if least is None else least[q]
        order = np.flatnonzero(allowed(q) & (bound >= floor))
        order = order[np.argsort(-bound[order], kind="stable")]
        length, best, scores, at, step = np.sqrt(q_norm[q] * longest), order[:0], np.zeros(0, np.int64), 0, 64
        while at < len(order) and (len(best) < k or bound[order[at]] >= scores[-1] or scores[-1] == LOWEST):
            some = order[at : at + step]
            at, step = at + step, step * 4
            both, value = np.r_[best, some], np.r_[scores, products(rows[some], queries[q], length)]
            first = np.lexsort((ids[both], ~value))[:k]
            best, scores = both[first], value[first]
        yield q, best, scores


def finite(column: Column) -> Column:
    v = column.cast("array<double>")
    return F.coalesce(v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False))


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, pivots: int = PIVOTS, query_block: int = QUERY_BLOCK, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows of ``vectors(vec_id, embedding)`` for each query.

    A component x counts as floor(scale * x); the score is the inner product; ties go to the
    smaller vec_id.  Components and scores beyond 64 bits count as the largest or smallest long.  ``is_query`` is a
    condition on vec_id.  Every row but the query's own is a candidate, so a repeated vec_id is an ordinary
    candidate of its twin.  Vectors that are null or hold null or non-finite components, and rows without a
    vec_id, take no part; vectors of another dimension are no candidates; all products of empty vectors are
    0.  Queries with fewer candidates have fewer rows.  Extra columns are ignored.

    Groups hold one block of rows and at most about ``query_block`` of the queries that visit it.
    """
    spark = vectors.sparkSession
    whole = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.floor(F.lit(scale) * x))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").filter(finite(F.col("embedding")) & F.col("vec_id").isNotNull())
    rows = materialise(rows.select("vec_id", whole.alias("v"), F.size("embedding").alias("dim"), F.coalesce(is_query, F.lit(False)).alias("asks"), F.monotonically_increasing_id().alias("row")), "whole")
    sizes = {r[0]: (r[1], r[2]) for r in rows.groupBy("dim").agg(F.count("*"), F.count_if("asks")).collect()}  # a corpus has few dimensions
    found = spark.createDataFrame([], "query_id long, query_row long, vec_id long, score long")
    for dim, (number, asking) in sorted(sizes.items()):
        if asking:
            mine = rows.filter(F.col("dim") == dim)
            chosen = mine.orderBy(F.xxhash64("vec_id"), "row").limit(pivots).select("v").collect()
            points = np.array([r[0] for r in chosen], float).reshape(len(chosen), dim)
            found = found.union(_search(mine, points, dim, max(block, -(-number // MOST_BLOCKS)), query_block, k))
    best = Window.partitionBy("query_id", "query_row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


OUT = "query_id long, query_row long, vec_id long, score long"


def _search(rows: DataFrame, points: np.ndarray, dim: int, block: int, query_block: int, k: int) -> DataFrame:
    """The k best rows of each query in its own block, and those of other blocks that may be among the best of all."""

    def measure(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            if not batch.num_rows:
                continue
            v = np.stack(batch.column("v").to_numpy(zero_copy_only=False)).reshape(batch.num_rows, dim).astype("<i8")
            far = np.sqrt(np.stack([((v - p) ** 2).sum(1) for p in points], axis=1)).astype("<f8")
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("vec_id", "row", "asks")), pa.array([x.tobytes() for x in v], pa.binary()), pa.array([x.tobytes() for x in far], pa.binary()), pa.array(far.argmin(axis=1).astype(np.int32))], names=["vec_id", "row", "asks", "v", "far", "cell"])

    table = materialise(rows.select("vec_id", "row", "asks", "v").mapInArrow(measure, "vec_id long, row long, asks boolean, v binary, far binary, cell int"), "pivots")
    members = dict(table.groupBy("cell").count().collect())  # a number for each pivot
    parts = [-(-members.get(c, 0) // block) for c in range(len(points))]
    first = np.cumsum(parts) - parts
    pick = lambda values: F.element_at(F.array(*(F.lit(int(x)) for x in values)), F.col("cell") + 1)
    table = table.withColumn("block", (pick(first) + F.pmod(F.xxhash64("vec_id", "row"), pick(parts))).cast("int")).drop("cell")

    def side(pdf: pd.DataFrame):
        n = len(pdf)
        return pdf.vec_id.to_numpy(), pdf.row.to_numpy(), np.frombuffer(b"".join(pdf.v), "<i8").reshape(n, dim), np.frombuffer(b"".join(pdf.far), "<f8").reshape(n, len(points))

    def search(asks: pd.DataFrame, told: pd.DataFrame, least: np.ndarray | None = None) -> pd.DataFrame:
        (qid, qrow, qv, qfar), (rid, rrow, rv, rfar) = side(asks), side(told)
        out: list[tuple] = []
        for q, at, scores in eliminate(qv, qfar, rv, rfar, lambda q: rrow != qrow[q], k, rid, least):
            out += [(qid[q], qrow[q], i, s) for i, s in zip(rid[at], scores, strict=True)]
        return pd.DataFrame(np.array(out, np.int64).reshape(-1, 4), columns=["query_id", "query_row", "vec_id", "score"])

    own = materialise(table.groupBy("block").applyInPandas(lambda pdf: search(pdf[pdf.asks], pdf), OUT), "own")

    def ranges(pdf: pd.DataFrame) -> pd.DataFrame:
        _, _, v, far = side(pdf)
        return pd.DataFrame({"block": [pdf.block.iloc[0]], "low": [far.min(axis=0).tobytes()], "high": [far.max(axis=0).tobytes()], "norm": [(v.astype(float) ** 2).sum(1).max()]})

    told = table.groupBy("block").applyInPandas(ranges, "block int, low binary, high binary, norm double").toPandas().sort_values("block")  # MOST_BLOCKS rows and one a pivot
    numbers, longest = told.block.to_numpy(), told.norm.to_numpy()
    low, high = (np.frombuffer(b"".join(c), "<f8").reshape(-1, len(points)) for c in (told.low, told.high))

    def route(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            _, _, v, far = side(pdf)
            least, norm, visits = pdf.least.to_numpy(float), (v.astype(float) ** 2).sum(1), []
            for q in range(len(pdf)):
                apart = np.maximum(np.maximum(low - far[q], far[q] - high), 0).max(axis=1, initial=0)
                bound = (norm[q] + longest - apart * apart) / 2 + 0.25 + 1e-9 * (norm[q] + longest)
                visits.append(numbers[~(bound < least[q]) & (numbers != pdf.block.iloc[q])])  # all other blocks where least is not a number
            yield pdf.assign(visits=visits)

    kth = own.groupBy("query_row").agg(F.when((F.count("*") >= k) & (F.min("score") > LOWEST), F.min("score").cast("double")).alias("least"))
    asks = table.filter("asks").join(kth.withColumnRenamed("query_row", "row"), "row", "left").select("vec_id", "row", "v", "far", "block", "least")
    routed = materialise(asks.mapInPandas(route, "vec_id long, row long, v binary, far binary, block int, least double, visits array<int>"), "routed")
    visits = routed.select(F.lit(True).alias("asks"), "vec_id", "row", "v", "far", "least", F.explode("visits").alias("block"))
    shares = visits.groupBy("block").agg(F.ceil(F.count("*") / query_block).cast("int").alias("shares"))
    visits = visits.join(shares, "block").withColumn("share", F.pmod(F.xxhash64("row"), "shares").cast("int")).drop("shares")
    hosts = table.join(shares, "block").select(F.lit(False).alias("asks"), "vec_id", "row", "v", "far", F.lit(None).cast("double").alias("least"), "block", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"))

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        asking = pdf[pdf.asks]
        return search(asking, pdf[~pdf.asks], asking.least.fillna(-np.inf).to_numpy())

    return own.union(visits.unionByName(hosts).groupBy("block", "share").applyInPandas(meet, OUT))
