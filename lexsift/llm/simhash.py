"""SimHash near-duplicates through a Gray-order hierarchical index.

Texts become 64-bit fingerprints.  Distinct fingerprints are dealt into groups that agree on
half (or, in crowded groups, three quarters) of their bits in such a way that every pair within the distance
meets in some group.  Each group is sorted by Gray rank; runs of neighbours form nodes that
hold the bits all members share; a self-join walks pairs of nodes and drops a whole pair of
groups once the differences accumulated in shared bits exceed the distance.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, ascii_words, cut, materialise
from .components import components, forest

DISTANCE = 2
FAN = 8
#: Groups with more fingerprints than this are split by further bits.
CROWDED = 4096
#: Fingerprints that a task compares at a time, besides those of its last group.
PORTION = 1 << 20
_hash = partial(xxhash.xxh64_intdigest, seed=42)


def shingle_hashes(words: list[bytes], width: int) -> np.ndarray:
    """XXH64 (seed 42) of all word shingles, repeats included; fewer words than a shingle are one; none have none."""
    if len(words) < width:
        return np.fromiter(map(_hash, [b" ".join(words)] if words else []), np.uint64)
    return np.fromiter(map(_hash, map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))), np.uint64)


def text_hash(words: list[bytes]) -> int:
    """XXH64 (seed 42) of all words, space-joined; 0 without words."""
    return _hash(b" ".join(words)) if words else 0


def fingerprint(words: list[bytes], width: int = 3) -> int:
    """Majority bits of the hashes of all word shingles; 0 without words."""
    if not words:
        return 0
    hashes = shingle_hashes(words, width)
    n, total = len(hashes), np.zeros(64, np.int64)
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8), bitorder="little").reshape(n, 64)
    whole = n // 255 * 255
    if whole:
        total += bits[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    total += bits[whole:].sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long.  Null text counts as empty."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            fps = np.fromiter((fingerprint(ascii_words(t), width) for t in as_bytes(batch.column(1))), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Place of each 64-bit code in the reflected Gray order."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """Levels of nodes over the sorted codes of many groups; level 0 are the codes themselves."""

    def __init__(self, codes: np.ndarray, groups: np.ndarray):
        """Both sorted by (group, Gray rank)."""
        every = ~np.uint64(0)
        starts = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])
        sizes = np.diff(np.r_[starts, len(codes)])
        # A level: shared pattern, mask of shared bits, first child, children; and the nodes that are a whole group.
        self.levels = [(codes, np.full(len(codes), every), None, None)]
        self.tops = [starts[:0]]
        pattern, mask = codes, self.levels[0][1]
        while True:
            number = -(-sizes // FAN)
            first = np.repeat(starts, number) + FAN * (np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number))
            count = np.minimum(FAN, np.repeat(starts + sizes, number) - first)
            ends = np.column_stack([first, first + count]).ravel()  # an ended group's nodes may follow a node's last child
            both = np.bitwise_and.reduceat(np.r_[pattern & mask, every], ends)[::2]
            any_ = np.bitwise_or.reduceat(np.r_[pattern | ~mask, every], ends)[::2]
            pattern, mask = both, ~(both ^ any_)
            self.levels.append((pattern, mask, first, count))
            where = np.cumsum(number) - number
            self.tops.append(where[number == 1])
            keep = number > 1
            starts, sizes = where[keep], number[keep]
            if not keep.any():
                break

    def links(self, distance: int = DISTANCE, step: int = 1 << 15) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of positions whose codes differ in at most ``distance`` bits, in bounded pieces."""
        stack = [(level, t, t) for level, tops in enumerate(self.tops) if len(tops) for t in [tops]]
        offsets = np.arange(FAN)
        while stack:
            level, a, b = stack.pop()
            if len(a) > step:
                stack.append((level, a[step:], b[step:]))
                a, b = a[:step], b[:step]
            _, _, first, count = self.levels[level]
            pattern, mask = self.levels[level - 1][:2]
            i = (first[a][:, None, None] + offsets[None, :, None]).repeat(FAN, axis=2)
            j = (first[b][:, None, None] + offsets[None, None, :]).repeat(FAN, axis=1)
            ok = (offsets[None, :, None] < count[a][:, None, None]) & (offsets[None, None, :] < count[b][:, None, None])
            ok &= (i < j) if level == 1 else (i <= j)
            i, j = i[ok], j[ok]
            differ = np.bitwise_count((pattern[i] ^ pattern[j]) & mask[i] & mask[j])
            near = differ <= distance
            if near.any():
                if level == 1:
                    yield i[near], j[near]
                else:
                    stack.append((level - 1, i[near], j[near]))


def _bits(code: Column, places: list[int]) -> Column:
    """The code with all bits but those in ``places`` cleared."""
    mask = sum(1 << p for p in places)
    return code.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("long"))


def _halves(places: list[int], distance: int) -> list[list[int]]:
    """Bit sets, one of which any two codes within ``distance`` share: all but ``distance`` of the blocks."""
    blocks = [b.tolist() for b in np.array_split(np.array(places), 2 * distance)]
    return [sum(c, []) for c in combinations(blocks, len(blocks) - distance)]


def near_links(distinct: DataFrame, distance: int = DISTANCE, crowded: int = CROWDED) -> DataFrame:
    """(a, b) links that connect just the fingerprints linked within ``distance``.

    ``distinct(fp)`` has each fingerprint once.  A group agrees on 32 bits; those with
    more than ``crowded`` members are dealt again by half of the other bits, after which a group
    has at most 2**16 members whatever the input.  Each group yields a spanning forest, not its
    pairs.  A task takes whole groups up to about PORTION fingerprints at a time.
    """
    if not 1 <= distance <= 8:
        raise ValueError("distance must be from 1 to 8")
    code = F.col("fp")
    halves = _halves(list(range(64)), distance)
    placed = distinct.select("fp", F.posexplode(F.array(*(_bits(code, h) for h in halves))).alias("way", "key"))
    full = placed.groupBy("way", "key").agg(F.count("*").alias("n")).filter("n > 1")
    placed = placed.join(full, ["way", "key"])
    again = F.lit(None)
    for way, half in enumerate(halves):
        rest = [p for p in range(64) if p not in half]
        finer = [F.struct(F.lit(len(halves) + way * len(halves) + k).alias("way"), _bits(code, half + h).alias("key")) for k, h in enumerate(_halves(rest, distance))]
        again = F.when(F.col("way") == way, F.array(*finer)).otherwise(again)
    dealt = placed.select("fp", F.explode(F.when(F.col("n") > crowded, again).otherwise(F.array(F.struct("way", "key")))).alias("g")).select("g.way", "g.key", "fp")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in it:
            held.append(tuple(c.to_numpy() for c in batch.columns))
            size += batch.num_rows
            if size >= PORTION:
                way, key, fp = (np.concatenate(x) for x in zip(*held, strict=True))
                whole = int(np.flatnonzero((way == way[-1]) & (key == key[-1]))[0])  # where the last group begins, which may go on
                yield from linked(way[:whole], key[:whole], fp[:whole])
                held, size = [(way[whole:], key[whole:], fp[whole:])], len(fp) - whole
        if size:
            yield from linked(*(np.concatenate(x) for x in zip(*held, strict=True)))

    def linked(way: np.ndarray, key: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(fp):
            return
        codes = fp.view(np.uint64)
        order = np.lexsort((gray_rank(codes), key, way))
        way, key, codes = way[order], key[order], codes[order]
        group = np.cumsum(np.r_[0, (way[1:] != way[:-1]) | (key[1:] != key[:-1])])
        label = np.arange(len(codes))
        for i, j in GrayIndex(codes, group).links(distance):
            label = forest(i, j, len(codes), label)
        child = np.flatnonzero(label != np.arange(len(codes)))
        if len(child):
            yield pa.RecordBatch.from_arrays([pa.array(codes[child].view(np.int64)), pa.array(codes[label[child]].view(np.int64))], names=["a", "b"])

    return dealt.repartition("way", "key").sortWithinPartitions("way", "key").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, width: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs(doc_id, text)``.

    component_id is the smallest doc_id reachable over fingerprints within ``distance`` bits.
    Null and empty texts have fingerprint 0 and link like any other.  Repeated rows and exact
    copies share a fingerprint, which enters the search once.  A row without a doc_id links and bridges others
    like any row, and gets the component's smallest doc_id, null if there is none.  An empty table
    gives an empty result.
    """
    prints = materialise(fingerprints(docs, width), "fingerprints")
    distinct = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct")
    roots = components(near_links(distinct.select("fp"), distance)).withColumnRenamed("node", "fp")
    members = cut(roots.join(distinct, "fp"))
    least = members.groupBy("root").agg(F.min("rep").alias("least"))
    named = distinct.join(members.join(least, "root").select("fp", "root", "least"), "fp", "left").select("fp", F.when(F.col("root").isNull(), F.col("rep")).otherwise(F.col("least")).alias("component_id"))
    return prints.join(named, "fp", "left").select("doc_id", "fp", "component_id")
