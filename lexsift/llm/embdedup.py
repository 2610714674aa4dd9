"""Near-duplicate vectors by randomised-rotation binary codes with correction factors.

Unit vectors of one label are dealt to cells around sampled centroids; each lives in its
nearest cell and also visits every other that may hold a vector within the threshold.  Within a cell a resident is known by the signs of
its rotated coordinates and one stored factor; a visitor by rotated coordinates rounded at
random to four bits.  Bit counts of the two give an unbiased estimate of the cosine with a
confidence bound; only pairs whose bound reaches the threshold are computed exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, materialise
from .components import components, forest

THRESHOLD = 0.93
#: Distinct vectors per centroid, most centroids, rows of a block.
PER_CELL, MOST_CELLS, BLOCK = 1 << 16, 4096, 1 << 14
#: What rounding may add to a cosine; the bounds on cells are wider by it.
ROUNDING = 1e-6
#: Width of the confidence bound in standard deviations.
SIGMAS = 5.0
PLANES = 4


def rotation(dim: int, seed: int = 7) -> np.ndarray:
    """Random orthogonal map of ``dim`` coordinates, then padded with rows to a multiple of 64.

    Extra rows come from further coordinates of a larger rotation: a vector is padded with
    zeros, which keeps inner products.
    """
    width = -(-max(dim, 64) // 64) * 64
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((width, width)))
    return (q * np.sign(np.diag(r)))[:, :dim]


def unit(vectors: np.ndarray) -> np.ndarray:
    scale = np.abs(vectors).max(axis=1, keepdims=True)  # before squaring, against overflow
    vectors = vectors / scale
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


class Codes:
    """Sign codes of rotated unit vectors, with the factor that makes estimates unbiased."""

    def __init__(self, vectors: np.ndarray, turn: np.ndarray):
        rotated = vectors @ turn.T
        self.width = rotated.shape[1]
        self.bits = np.packbits(rotated > 0, axis=1).view(np.uint64)
        self.factor = np.abs(rotated).sum(axis=1) / np.sqrt(self.width)  # <code, vector>

    def estimates(self, visitors: np.ndarray, turn: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
        """Estimated cosines (visitor, resident) and one standard deviation of each visitor's rounding."""
        rotated = visitors @ turn.T
        low = rotated.min(axis=1, keepdims=True)
        step = np.maximum((rotated.max(axis=1, keepdims=True) - low) / (2**PLANES - 1), 1e-12)
        level = np.clip(np.floor((rotated - low) / step + rng.random(rotated.shape)), 0, 2**PLANES - 1).astype(np.uint8)
        dot = np.zeros((len(visitors), len(self.bits)), np.float32)  # sum of levels where the code is set
        for plane in range(PLANES):
            bits = np.packbits(level >> plane & 1, axis=1).view(np.uint64)
            for word in range(bits.shape[1]):
                dot += np.bitwise_count(bits[:, word, None] & self.bits[None, :, word]) * np.float32(1 << plane)
        ones = np.bitwise_count(self.bits).sum(axis=1, dtype=np.int64)
        # <signs, q> with q = low + step * level and signs = 2 * bit - 1
        signs = 2 * (step * dot + low * ones[None, :]) - (step * level.sum(axis=1, keepdims=True, dtype=np.int64) + low * self.width)
        return signs / np.sqrt(self.width) / self.factor[None, :], step[:, 0] / 2

    def slack(self, threshold: float, rounding: np.ndarray) -> np.ndarray:
        """How far an estimate may lie from a cosine of ``threshold`` or more, (visitor, resident)."""
        spread = np.sqrt(np.maximum(1 - self.factor**2, 0) * (1 - threshold**2) / (self.width - 1)) / self.factor
        return SIGMAS * np.sqrt(spread[None, :] ** 2 + (rounding[:, None] / self.factor[None, :]) ** 2)


def can_link() -> Column:
    """Whether a row has a label and a finite vector other than zero; never null."""
    v = F.col("embedding").cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(F.col("label").isNotNull() & v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, per_cell: int = PER_CELL, block: int = BLOCK, seed: int = 7) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors(vec_id, embedding, label)``.

    Vectors link if they have the same label and their cosine in double precision reaches the
    threshold.  Null labels, null, empty or zero vectors and those with null or non-finite
    components link with nothing; vectors of different dimensions never link.  Copies of a
    vector enter the search once and are counted.  Several rows with one vec_id are several
    vectors.  A null vec_id links like any other and is never kept=True; a component is null if
    none of its rows has an id.

    Centroids are a sample of distinct vectors, one for ``per_cell`` of them and at most
    MOST_CELLS (beyond, cells get larger); every vector is searched.  Cells are passed by only where a bound shows that they
    hold no link, so a pair is missed only with the probability of a deviation by SIGMAS.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label")
    usable = rows.filter(can_link()).withColumn("v", F.col("embedding").cast("array<double>")).withColumn("dim", F.size("v")).withColumn("key", F.sha2(F.concat(F.col("label").cast("string"), F.lit(":"), F.array_join(F.transform("v", lambda x: F.when(x == 0, 0.0).otherwise(x).cast("string")), ",")), 256))
    grouped = usable.groupBy("key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("v").alias("v"), F.first("label").alias("label"), F.first("dim").alias("dim"))
    distinct = materialise(grouped.withColumn("node", F.monotonically_increasing_id()), "vectors")  # vec_ids may repeat or be null
    per_dim = {r[0]: r[1] for r in distinct.groupBy("dim").count().collect()}  # a corpus has few dimensions
    results = []
    for dim, number in sorted(per_dim.items()):
        results.append(_search(distinct.filter(F.col("dim") == dim), dim, number, threshold, per_cell, block, seed))
    if results:
        found = results[0]
        for more in results[1:]:
            found = found.union(more)
        found = materialise(found, "links")
        roots = components(found.filter("b is not null").select("a", "b"))
        counts = found.filter("n is not null").groupBy("a").agg(F.sum("n").alias("n")).withColumnRenamed("a", "node")
        members = cut(roots.join(distinct.select("node", "rep"), "node"))
        least = members.groupBy("root").agg(F.min("rep").alias("least"))
        named = distinct.select("key", "node", "rep", "copies").join(counts, "node", "left").join(members.join(least, "root").select("node", "root", "least"), "node", "left")
        named = named.select("key", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.when(F.col("root").isNull(), F.col("rep")).otherwise(F.col("least")).alias("component_id"))
        linked = usable.select("vec_id", "key").join(named, "key").select("vec_id", "n_links", "component_id")
    else:
        linked = spark.createDataFrame([], "vec_id long, n_links long, component_id long")
    alone = rows.filter(~can_link()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def visited(vectors: np.ndarray, centres: np.ndarray, lowest: np.ndarray, threshold: float) -> list[list[int]]:
    """For each unit vector its own cell, then all others that it has to visit.

    A link of ``threshold`` spans an angle t.  A cell is out of reach if the vector is further from
    its centroid than t and the cell's radius, or further than t from the plane between its own
    centroid and that one, beyond which all the cell's residents lie.  Both bounds hold from either end of a link,
    so of two cells only one is visited from the other, by the parity of their numbers.
    """
    cosines = vectors @ centres.T
    own, rows, every = cosines.argmax(axis=1), np.arange(len(vectors)), np.arange(len(centres))
    reach = np.arccos(np.clip(threshold, -1, 1)) + np.arccos(np.clip(lowest - ROUNDING, -1, 1))
    near = (cosines >= np.cos(np.minimum(reach, np.pi)) - ROUNDING) & (lowest < 2)
    if threshold > 0:  # an angle under 90 degrees
        apart = np.sqrt(np.maximum(2 - 2 * (centres[own] @ centres.T), 0))
        near &= cosines[rows, own][:, None] - cosines <= np.sqrt(1 - min(threshold, 1) ** 2) * apart + ROUNDING
    near &= ((every + own[:, None]) % 2 == 1) == (every < own[:, None])
    near[rows, own] = False
    return [[int(o), *np.flatnonzero(n).tolist()] for o, n in zip(own, near, strict=True)]


def _search(distinct: DataFrame, dim: int, number: int, threshold: float, per_cell: int, block: int, seed: int) -> DataFrame:
    """(a, n, b): rows with n are numbers of links of vector a; rows with b link a and b."""
    k = max(1, min(MOST_CELLS, number // per_cell))
    sample = distinct.orderBy(F.xxhash64("key")).limit(k).select("v").collect()  # at most MOST_CELLS vectors
    centres = unit(np.array([r[0] for r in sample]).reshape(-1, dim))
    turn = rotation(dim, seed)

    def nearness(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = np.full(len(centres), 2.0)
        for batch in it:
            for at in range(0, batch.num_rows, 512):
                cosines = unit(np.stack(batch.column("v").slice(at, 512).to_numpy(zero_copy_only=False))) @ centres.T
                low = np.minimum(low, np.where(cosines >= cosines.max(axis=1, keepdims=True) - ROUNDING, cosines, 2.0).min(axis=0))
        some = np.flatnonzero(low < 2)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(low[some])], names=["cell", "low"])

    lowest = np.full(len(centres), 2.0)  # the least cosine of a cell's residents with its centroid; 2 for an empty cell
    if len(centres) > 1:
        for cell, low in distinct.select("v").mapInArrow(nearness, "cell int, low double").groupBy("cell").agg(F.min("low")).collect():
            lowest[cell] = low

    def place(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            if batch.num_rows:
                v = unit(np.stack(batch.column("v").to_numpy(zero_copy_only=False)))
                near = [cells for at in range(0, len(v), 512) for cells in visited(v[at : at + 512], centres, lowest, threshold)]
                yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("copies"), pa.array([x.astype("<f8").tobytes() for x in v], pa.binary()), batch.column("label"), pa.array(near, pa.list_(pa.int32()))], names=["node", "copies", "v", "label", "cells"])

    placed = materialise(distinct.select("node", "copies", "v", F.col("label").cast("string").alias("label")).mapInArrow(place, "node long, copies long, v binary, label string, cells array<int>"), "placed")
    # Residents and visitors of a cell in blocks of bounded size, by a hash of the id.
    sizes = placed.select("label", F.col("cells")[0].alias("cell"), F.lit(1).alias("h")).union(placed.select("label", F.explode("cells"), F.lit(0))).groupBy("label", "cell").agg(F.sum("h").alias("h"), F.sum(1 - F.col("h")).alias("g")).filter("h > 0").select("label", "cell", F.ceil(F.col("h") / block).cast("int").alias("nh"), F.ceil(F.col("g") / block).cast("int").alias("ng"))
    slot = F.xxhash64("node")
    home = placed.select("*", F.col("cells")[0].alias("cell"), F.col("cells")[0].alias("home")).join(sizes, ["label", "cell"]).select("*", F.pmod(slot, F.col("nh")).alias("bh"), F.explode(F.sequence(F.lit(0), F.col("ng") - 1)).alias("bg")).withColumn("side", F.lit(0))
    guest = placed.select("*", F.explode("cells").alias("cell"), F.col("cells")[0].alias("home")).join(sizes, ["label", "cell"]).select("*", F.explode(F.sequence(F.lit(0), F.col("nh") - 1)).alias("bh"), F.pmod(slot, F.col("ng")).alias("bg")).withColumn("side", F.lit(1))
    names = ["label", "cell", "bh", "bg", "side", "node", "copies", "v", "home"]
    both = home.select(*(F.col(c).cast("long") if c in ("bh", "bg") else F.col(c) for c in names)).union(guest.select(*(F.col(c).cast("long") if c in ("bh", "bg") else F.col(c) for c in names)))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        def side(s: int):
            rows = pdf[pdf.side == s].sort_values("node")
            return rows.node.to_numpy(), rows.copies.to_numpy(), np.frombuffer(b"".join(rows.v), "<f8").reshape(-1, dim), (rows.home == rows.cell).to_numpy()

        hid, hcopies, hv, _ = side(0)
        gid, gcopies, gv, resident = side(1)
        ids = np.unique(np.r_[hid, gid])
        n, label = np.zeros(len(ids), np.int64), np.arange(len(ids))
        if len(hid) and len(gid):
            codes, rng = Codes(hv, turn), np.random.default_rng(seed)
            hat, gat = np.searchsorted(ids, hid), np.searchsorted(ids, gid)
            for at in range(0, len(gid), 512):
                estimate, rounding = codes.estimates(gv[at : at + 512], turn, rng)
                g, h = np.nonzero(estimate >= threshold - codes.slack(threshold, rounding))
                g += at
                # Two residents of one cell meet twice there; a pair of two cells meets in one of them.
                once = (gid[g] < hid[h]) | ~resident[g]
                g, h = g[once], h[once]
                for part in range(0, len(g), 1 << 16):
                    x, y = g[part : part + (1 << 16)], h[part : part + (1 << 16)]
                    hit = np.einsum("ij,ij->i", gv[x], hv[y]) >= threshold
                    x, y = x[hit], y[hit]
                    np.add.at(n, gat[x], hcopies[y])
                    np.add.at(n, hat[y], gcopies[x])
                    label = forest(gat[x], hat[y], len(ids), label)
        some, child = np.flatnonzero(n), np.flatnonzero(label != np.arange(len(ids)))
        return pd.DataFrame({"a": np.r_[ids[some], ids[child]], "n": pd.array([*n[some], *[None] * len(child)], "Int64"), "b": pd.array([*[None] * len(some), *ids[label[child]]], "Int64")})

    return both.groupBy("label", "cell", "bh", "bg").applyInPandas(compare, "a long, n long, b long")
