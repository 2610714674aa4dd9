"""Near-duplicate texts by shingle similarity: wide SimHash codes find pairs, an exact check decides.

Texts become 128-bit majority codes of their sets of word shingles.  Codes are dealt into groups
that agree on a random choice of bits, so many that a pair at the least similarity meets with
probability RECALL.  Groups are searched by the Gray-order index; pairs whose codes are as near as such a
similarity allows connect texts to crowds.  Within a crowd all pairs are compared by their whole sets, but those whose
sizes differ too much or that similar pairs connect already.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, ascii_words, cut, materialise
from .components import FEW, components, leaning
from .simhash import PORTION, GrayIndex, gray_rank, shingle_hashes, text_hash

WIDTH, SIMILARITY = 5, 0.8
#: Chance that a pair at the least similarity meets in a group, if its codes differ by a standard deviation
#: more than on average; and how many standard deviations more they may differ.
RECALL, SIGMAS = 0.95, 3.0
BITS = 128
#: Sets of a crowd that are compared at a time, or with as many others.
BLOCK = 256


def differing(similarity: float) -> float:
    """Share of code bits in which two texts of equal size and this Jaccard similarity differ."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def plan(number: int, similarity: float) -> tuple[int, int]:
    """(bits of a key, keys of a text): groups stay small as texts grow in number."""
    bits, share = max(12, math.ceil(math.log2(max(2, number))) - 6), differing(similarity)
    share += math.sqrt(share * (1 - share) / BITS)
    return bits, math.ceil(math.log(1 - RECALL) / math.log(1 - (1 - share) ** bits))


def code(hashes: np.ndarray) -> np.ndarray:
    """Majority bits, as two words, of shingle hashes and of their scrambled twins."""
    with np.errstate(over="ignore"):
        twin = (hashes ^ (hashes >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        twin = (twin ^ (twin >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    both = np.stack([hashes, twin ^ (twin >> np.uint64(31))], axis=1).astype("<u8").view(np.uint8)
    total = np.zeros(BITS, np.int64)
    for at in range(0, len(both), 255):  # a byte holds sums of so many bits
        total += np.unpackbits(both[at : at + 255], axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * total > len(hashes), bitorder="little").view("<u8")


def profiles(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, node, one, two, shingles): node is a hash of the text's words, one and two are its code, shingles its sorted set."""
    schema = pa.schema([("doc_id", pa.int64()), ("node", pa.int64()), ("one", pa.int64()), ("two", pa.int64()), ("shingles", pa.binary())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            nodes, codes, sets = [], [], []
            for raw in as_bytes(batch.column(1)):
                words = ascii_words(raw)
                nodes.append(text_hash(words))
                found = np.unique(shingle_hashes(words, width))
                codes.append(code(found))
                sets.append(np.unique(found.astype("<u4")).tobytes())
            both = np.array(codes, np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(sets, pa.binary())], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, node long, one long, two long, shingles binary")


def spanning(i: np.ndarray, j: np.ndarray, label: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Those of the pairs (i, j), earlier ones first, that join what ``label`` holds apart; and the labels after that."""
    taken = []
    while len(i):
        x, y = label[i], label[j]
        open_ = x != y
        i, j, x, y = i[open_], j[open_], x[open_], y[open_]
        if len(i):
            high, first = np.unique(np.maximum(x, y), return_index=True)
            taken.append((i[first], j[first]))
            label[high] = np.minimum(x, y)[first]
            while not np.array_equal(up := label[label], label):
                label = up
    return taken, label


def candidates(nodes: DataFrame, ways: list[np.ndarray], similarity: float) -> DataFrame:
    """(a, b): pairs that connect what near codes connect and ``root`` holds apart, of ``nodes(node, one, two, root)``.

    A task takes whole groups, up to about PORTION rows at a time; each group yields a forest.
    """
    share = differing(similarity)
    reach = lambda bits: round(bits * share + SIGMAS * math.sqrt(bits * share * (1 - share)))
    tiers = [reach(BITS) // 3, 2 * reach(BITS) // 3, reach(BITS)]

    def deal(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            if not batch.num_rows:
                continue
            one, two = (batch.column(c).to_numpy() for c in ("one", "two"))
            bits = np.unpackbits(np.stack([one, two], axis=1).view(np.uint8), axis=1, bitorder="little")
            for way, chosen in enumerate(ways):
                key = bits[:, chosen].astype(np.int64) @ (np.int64(1) << np.arange(len(chosen))) | np.int64(way) << 48
                yield pa.RecordBatch.from_arrays([pa.array(key), *(batch.column(c) for c in ("node", "one", "two", "root"))], names=["key", "node", "one", "two", "root"])

    def search(key: np.ndarray, node: np.ndarray, one: np.ndarray, two: np.ndarray, root: np.ndarray) -> Iterator[pa.RecordBatch]:
        several = np.r_[False, key[1:] == key[:-1]]
        several |= np.r_[several[1:], False]
        key, node, one, two, root = (x[several] for x in (key, node, one, two, root))
        if not len(key):
            return
        one, two = one.view(np.uint64), two.view(np.uint64)
        order = np.lexsort((gray_rank(one), key))
        key, node, one, two, root = (x[order] for x in (key, node, one, two, root))
        index = GrayIndex(one, key)
        _, first, place = np.unique(root, return_index=True, return_inverse=True)
        label = first[place]
        for tier in tiers:
            for i, j in index.links(min(tier, reach(64))):
                apart = np.bitwise_count(one[i] ^ one[j]) + np.bitwise_count(two[i] ^ two[j])
                near = np.flatnonzero((apart <= tier) & (label[i] != label[j]))
                near = near[np.argsort(apart[near], kind="stable")]
                taken, label = spanning(i[near], j[near], label)
                for x, y in taken:
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(node[x], node[y])), pa.array(np.maximum(node[x], node[y]))], names=["a", "b"])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in it:
            held.append(tuple(c.to_numpy() for c in batch.columns))
            size += batch.num_rows
            if size >= PORTION:
                rows = [np.concatenate(x) for x in zip(*held, strict=True)]
                whole = int(np.searchsorted(rows[0], rows[0][-1]))  # the last group may go on
                yield from search(*(x[:whole] for x in rows))
                held, size = [tuple(x[whole:] for x in rows)], size - whole
        if size:
            yield from search(*(np.concatenate(x) for x in zip(*held, strict=True)))

    dealt = nodes.select("node", "one", "two", "root").mapInArrow(deal, "key long, node long, one long, two long, root long")
    return dealt.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long").distinct()


def similar(shingles: pa.Array, side: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of positions that join just what sets of the similarity join; between the two sides, or, where there is one side, all.

    Every pair is compared unless similar pairs connect it already or its sizes rule it out.
    """
    sets = [np.frombuffer(x.as_py(), "<u4") for x in shingles]
    sizes = np.array([len(x) for x in sets], np.int64)
    order = np.argsort(sizes, kind="stable")
    order = order[sizes[order] > 0]
    sizes, side, both = sizes[order], side[order], len(np.unique(side)) > 1
    _, tokens = np.unique(np.concatenate([np.zeros(0, "<u4"), *(sets[i] for i in order)]), return_inverse=True)
    start = np.r_[0, np.cumsum(sizes)]
    ends = np.searchsorted(sizes, sizes / similarity * (1 + 1e-9), "right")
    label, has = np.arange(len(order)), np.zeros(len(tokens), np.uint8)
    a, b = [order[:0]], [order[:0]]
    for i, end in enumerate(ends):
        open_ = label[i + 1 : end] != label[i]
        if both:
            open_ &= side[i + 1 : end] != side[i]
        if not open_.any():
            continue
        has[tokens[start[i] : start[i + 1]]] = 1
        shared = np.add.reduceat(has[tokens[start[i + 1] : start[end]]], start[i + 1 : end] - start[i + 1], dtype=np.int64)
        has[tokens[start[i] : start[i + 1]]] = 0
        found = i + 1 + np.flatnonzero(open_ & (shared >= similarity * (sizes[i] + sizes[i + 1 : end] - shared)))
        if len(found):
            roots, first = np.unique(label[found], return_index=True)
            a.append(np.full(len(first), order[i]))
            b.append(order[found[first]])
            label[np.isin(label, roots)] = label[i]
    return np.concatenate(a), np.concatenate(b)


def parts(members: DataFrame, similarity: float) -> DataFrame:
    """``members(node, row, size, crowd)`` dealt into parts (crowd, low, p, high, q), with a side, in which all pairs of a crowd meet that sizes allow.

    A crowd of up to BLOCK sets is one part.  A larger one falls into classes of size, so wide that sets of the similarity
    are in the same or the next class, and a class into blocks; a part is a block or a pair of blocks.
    """
    step = math.log(1 / similarity) + 1e-6
    crowds = members.groupBy("crowd").agg(F.count("*").alias("of"))
    classed = members.join(crowds, "crowd").withColumn("low", F.when(F.col("of") <= BLOCK, 0).otherwise(F.floor(F.log(F.greatest("size", F.lit(1))) / step)).cast("long"))
    units = cut(classed.groupBy("crowd", "low").agg(F.ceil(F.count("*") / BLOCK).alias("blocks")))
    near = lambda by, name: units.select("crowd", (F.col("low") + by).alias("low"), F.col("blocks").alias(name))
    units = units.join(near(-1, "above"), ["crowd", "low"], "left").join(near(1, "below"), ["crowd", "low"], "left")
    placed = classed.join(units, ["crowd", "low"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))

    def each(blocks: str, part) -> Column:
        made = F.transform(F.sequence(F.lit(0).cast("long"), F.col(blocks) - 1), lambda q: F.struct(*(x.cast("long").alias(n) for x, n in zip(part(q), ("low", "p", "high", "q", "side"), strict=True))))
        return F.when(F.col(blocks) > 0, made).otherwise(F.array())

    low, own = F.col("low"), F.col("block")
    same = each("blocks", lambda q: (low, F.least(own, q), low, F.greatest(own, q), q < own))
    above = each("above", lambda q: (low, own, low + 1, q, F.lit(0)))
    below = each("below", lambda q: (low - 1, q, low, own, F.lit(1)))
    return placed.select("node", "row", "crowd", F.explode(F.concat(same, above, below)).alias("x")).select("node", "row", "crowd", "x.*")


def links(members: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b): links of the similarity that join what all such links within a crowd join, by the ``sets(row, shingles)`` of ``members``.

    A link is made after its sets were compared, so none that holds is passed by for one that does not.
    """
    key = ["crowd", "low", "p", "high", "q"]

    def compare(rows: pa.Table) -> pa.RecordBatch:
        node = rows["node"].to_numpy()
        a, b = similar(rows["shingles"].combine_chunks(), rows["side"].to_numpy(), similarity)
        return pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], names=["a", "b"])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in it:
            rows = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            if not rows.num_rows:
                continue
            columns = [rows[c].to_numpy() for c in key]
            ends = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
            for start, end in zip(np.r_[0, ends[:-1]], ends, strict=False):
                if end - start > 1:
                    yield compare(rows.slice(start, end - start))
            held = rows.slice(ends[-1] if len(ends) else 0)  # the last part may go on
        if held is not None and held.num_rows > 1:
            yield compare(held)

    dealt = parts(members, similarity).join(sets, "row").select(*key, "side", "node", "shingles")
    return dealt.repartition(*key).sortWithinPartitions(*key).mapInArrow(run, "a long, b long")


def near_texts(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY, seed: int = 5) -> DataFrame:
    """(doc_id, component_id) for every row of ``docs(doc_id, text)``.

    Texts link if the Jaccard similarity of their sets of word shingles, A-Z lower-cased, is at least ``similarity``;
    component_id is the smallest doc_id reachable.  Texts of the same words link always, so also those
    without words and null ones.  A text of fewer words than a shingle has one shingle of all its words.  Links that do not
    hold are never made; links between different texts are found with a probability of about RECALL or more each, and
    for certain where near codes connect their texts, be it by way of others.
    A row without a doc_id links like any other; its component is null if none of its rows has an id.  Repeated
    rows are kept, extra columns are ignored, an empty table gives an empty result.
    """
    found = materialise(profiles(docs, width).withColumn("row", F.monotonically_increasing_id()), "profiles")
    size = (F.length("shingles") / 4).cast("long")
    nodes = materialise(found.groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("one").alias("one"), F.first("two").alias("two"), F.first(size).alias("size"), F.min("row").alias("row")), "nodes")
    bits, keys = plan(nodes.count(), similarity)
    rng = np.random.default_rng(seed)
    ways = [rng.permutation(BITS)[:bits] for _ in range(keys)]
    first, rooted = keys // 4, nodes.withColumn("root", F.col("node"))
    pairs = materialise(candidates(rooted, ways[:first], similarity), "pairs")
    # The other keys need not look at what the first ones have connected.
    rooted = nodes.join(leaning(pairs, FEW), "node", "left").withColumn("root", F.coalesce("root", "node"))
    pairs = pairs.union(materialise(candidates(rooted, ways[first:], similarity), "pairs"))
    members = cut(components(pairs, few=FEW).withColumnRenamed("root", "crowd").join(nodes.select("node", "row", "size"), "node"))
    roots = components(materialise(links(members, found.select("row", "shingles"), similarity), "links"), few=FEW)
    members = cut(roots.join(nodes.select("node", "rep"), "node"))
    least = members.groupBy("root").agg(F.min("rep").alias("least"))
    named = nodes.select("node", "rep").join(members.join(least, "root").select("node", "root", "least"), "node", "left").select("node", F.when(F.col("root").isNull(), F.col("rep")).otherwise(F.col("least")).alias("component_id"))
    return found.select("doc_id", "node").join(named, "node").select("doc_id", "component_id")


def keep_first(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of its group of near-duplicates.

    Of rows that repeat that doc_id one is kept, the least by its values.  Rows without a doc_id
    can't be told apart and all stay.
    """
    first = near_texts(docs, width, similarity).filter("doc_id = component_id").select(F.col("component_id").alias("doc_id")).distinct()
    others = [c for c in docs.columns if c != "doc_id"]
    one = docs.join(first, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(*others)).alias("r")).select("doc_id", "r.*")
    return one.select(docs.columns).union(docs.filter("doc_id is null"))
