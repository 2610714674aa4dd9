"""Connected components of a link table, by alternating star contraction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Links whose components one task may find where a caller allows it; rounds of shuffles would be thousands of tasks for them.
FEW = 1 << 18


def forest(a: np.ndarray, b: np.ndarray, n: int, label: np.ndarray | None = None) -> np.ndarray:
    """Smallest position reachable from each of ``n`` positions over the links (a, b).

    ``label`` carries the result of earlier calls, so that links may come in pieces.
    """
    label = np.arange(n) if label is None else label
    while len(a):
        x, y = label[a], label[b]
        open_ = x != y
        if not open_.any():
            break
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        low, high = np.minimum(x, y), np.maximum(x, y)
        np.minimum.at(label, high, low)
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up
    return label


def _sides(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large star: hang larger neighbours under the smallest; small star: the smaller ones."""
    sides = _sides(edges) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = sides.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    hung = sides.join(least, "a")
    if large:
        hung = hung.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        hung = hung.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return hung.filter("a <> b").distinct()


def _at_once(edges: DataFrame) -> DataFrame:
    """(node, root) as ``components`` has them, of few ``edges(a long, b long)`` without null ends, by one task."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links = np.concatenate([np.zeros((2, 0), np.int64), *(np.stack([c.to_numpy() for c in batch.columns]) for batch in it)], axis=1)
        nodes, place = np.unique(links, return_inverse=True)
        a, b = place.reshape(links.shape)
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[forest(a, b, len(nodes))])], names=["node", "root"])

    return cut(edges.coalesce(1).mapInArrow(run, "node long, root long"))


def leaning(edges: DataFrame, few: int = 0) -> DataFrame:
    """(node, root) after one contraction of ``edges(a, b)``: nodes of one root are connected, but connected nodes may have several roots.

    Up to ``few`` links, whose ends have to be long, are contracted to their components.
    """
    if few and edges.limit(few + 1).count() <= few:
        return _at_once(edges.filter("a <> b"))
    edges = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    return cut(_star(_star(edges, True), False).groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")))


def components(edges: DataFrame, max_rounds: int = 60, few: int = 0) -> DataFrame:
    """(node, root) for every node of ``edges(a, b)``: root is the smallest node reachable.

    Nodes without a link don't appear.  Null ends and loops are ignored.  All joins are on
    node ids and may be split by adaptive execution where a node has very many links.
    Up to ``few`` different links, whose ends have to be long, are the work of one task.
    """
    edges = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    if few and edges.count() <= few:
        return _at_once(edges)
    mark = None
    for _ in range(max_rounds):
        edges = cut(_star(_star(edges, True), False))
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        mark = now
    raise RuntimeError("components did not settle")
