"""Brute-force checks of embedding dedup, SimHash dedup and exact top-k."""

import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexsift.llm import components, embdedup, neartext, queries, simhash, topk

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def reach(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def plain_fingerprint(text):
    words = WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_components_of_few_links_are_one_task(spark):
    """Groups of near texts took rounds of shuffles, thousands of tasks that the driver keeps track of, for any few links."""
    links = [(i, i + 1) for i in range(100, 160)] + [(x, -7) for x in range(8, 40)] + [(3, 3), (None, 1)]
    edges = spark.createDataFrame(links, "a long, b long").repartition(16)
    found = [components.components(edges, few=100), components.leaning(edges, few=100)]
    assert [f.rdd.getNumPartitions() for f in found] == [1, 1]
    many = components.components(edges, few=91)  # 92 different links
    assert many.rdd.getNumPartitions() > 1
    for f in [*found, many]:
        assert sorted(map(tuple, f.collect())) == sorted([*((i, 100) for i in range(100, 161)), *((x, -7) for x in [-7, *range(8, 40)])])
    assert components.components(edges.limit(0), few=100).count() == 0


def test_components_of_a_chain_a_star_and_a_loop(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(7, x) for x in range(8, 40)] + [(3, 3)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, **{x: 7 for x in range(7, 40)}}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_one_contraction_joins_connected_nodes_only(spark):
    links = [(i, i + 1) for i in range(100, 120)] + [(7, x) for x in range(8, 40)]
    got = {r.node: r.root for r in components.leaning(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all((n < 50) == (r < 50) and r < n for n, r in got.items()) and all(got[x] == 7 for x in range(8, 40))


def test_forest_joins_links_given_in_pieces():
    label = components.forest(np.array([0, 3]), np.array([1, 4]), 6)
    label = components.forest(np.array([4]), np.array([1]), 6, label)
    assert label.tolist() == [0, 0, 2, 0, 0, 5]


@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 2**64 - 1)), max_size=60), st.integers(0, 10**6))
@settings(max_examples=60, deadline=None)
def test_gray_index_finds_just_the_near_pairs(rows, seed):
    rng = random.Random(seed)
    rows = rows + [(g, c ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64))) for g, c in rows for _ in range(3)]
    if not rows:
        return
    group, codes = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.uint64)
    order = np.lexsort((simhash.gray_rank(codes), group))
    group, codes = group[order], codes[order]
    found = {(int(a), int(b)) for i, j in simhash.GrayIndex(codes, group).links(2, step=50) for a, b in zip(i, j)}
    assert found == {(a, b) for a in range(len(rows)) for b in range(a + 1, len(rows)) if group[a] == group[b] and (int(codes[a]) ^ int(codes[b])).bit_count() <= 2}


@pytest.mark.parametrize("crowded,portion", [(4096, 1 << 20), (3, 1 << 20), (4096, 40)])
def test_simhash_against_all_pairs(spark, sf, crowded, portion, monkeypatch):
    monkeypatch.setattr(simhash, "PORTION", portion)
    docs = queries.table(spark, sf, "documents").collect()
    rows = [(d.doc_id, d.text) for d in docs]
    rng = random.Random(5)
    base = rows[3][1].split()
    for k in range(120):  # near copies whose fingerprints crowd together
        words = base[:]
        words[rng.randrange(len(words))] = f"w{k % 40}"
        rows.append((1000 + k, " ".join(words)))
    rows += [(2000, None), (2001, ""), (2002, " \t\n"), (2003, "one"), (2004, "ONE"), (2004, "One"), (2005, "x" * 30000), (2006, " nb Äb c d")]
    fps = [plain_fingerprint(t) for _, t in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 2]
    expect = sorted((rows[i][0], f"{fps[i]:016x}", min(rows[j][0] for j in range(len(rows)) if roots[j] == roots[i])) for roots in [reach(len(rows), links)] for i in range(len(rows)))
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, fp string")
    prints = simhash.fingerprints(df)
    roots = {r.node: r.root for r in components.components(simhash.near_links(prints.select("fp").distinct(), crowded=crowded)).collect()}
    found = prints.collect()
    least = {}
    for r in found:
        root = roots.get(r.fp, r.fp)
        least[root] = min(r.doc_id, least.get(root, r.doc_id))
    assert sorted((r.doc_id, f"{r.fp & (2**64 - 1):016x}", least[roots.get(r.fp, r.fp)]) for r in found) == expect
    if crowded == 4096 and portion > 40:
        whole = simhash.near_duplicates(df).collect()
        assert sorted((r.doc_id, f"{r.fp & (2**64 - 1):016x}", r.component_id) for r in whole) == expect


def test_simhash_rows_without_an_id_link_and_bridge(spark):
    rng = random.Random(3)
    base = [f"w{rng.randrange(10**6)}" for _ in range(60)]
    fps, texts = [plain_fingerprint(" ".join(base))], [" ".join(base)]
    while len(texts) < 3:  # a chain of links whose ends don't link
        words = texts[-1].split()
        words[rng.randrange(60)] = f"w{rng.randrange(10**6)}"
        fp = plain_fingerprint(" ".join(words))
        apart = [(fp ^ x).bit_count() for x in fps]
        if apart[-1] <= 2 and min(apart[:-1], default=9) > 2:
            fps.append(fp)
            texts.append(" ".join(words))
    rows = [(5, texts[0]), (None, texts[1]), (3, texts[2]), (None, "all alone here now"), (None, "all alone here now")]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in got) == [(0, 0), (0, 0), (0, 3), (3, 3), (5, 3)]


def plain_set(text, width=5):
    words = WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def test_near_texts_keep_one_row_of_each_group(spark):
    rows = [(5, "a b c d", "en"), (2, "A b c d", "de"), (2, "a b c d", "de"), (9, "q w e r t", None), (None, "a b c d", "en"), (8, None, "x"), (7, " ", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = neartext.keep_first(docs)
    assert sorted((r.doc_id or 0, r.lang or "") for r in kept.collect()) == [(0, "en"), (2, "de"), (7, "x"), (9, "")]
    assert sorted((r.doc_id or 0, r.component_id) for r in neartext.near_texts(docs).collect()) == [(0, 2), (2, 2), (2, 2), (5, 2), (7, 7), (8, 7), (9, 9)]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(empty).count() == 0 and neartext.keep_first(empty).count() == 0


def test_near_texts_against_all_pairs(spark):
    """Edited copies on both sides of the similarity, a crowd of copies of one text, and unrelated texts."""
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(60, 300)))) for i in range(300)]
    for i in range(300):
        words = rows[i][1].split()
        for _ in range(max(1, round(len(words) * rng.uniform(0.003, 0.035)))):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        rows.append((1000 + i, " ".join(words)))
    base = rows[0][1].split()
    for i in range(150):
        words = base[:]
        words[rng.randrange(len(words))] = rng.choice(vocabulary)
        rows.append((2000 + i, " ".join(words)))
    sets = [plain_set(t) for _, t in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if sets[a] & sets[b] and jaccard(sets[a], sets[b]) >= 0.8]
    roots = reach(len(rows), links)
    got = {r.doc_id: r.component_id for r in neartext.near_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    expect = {rows[i][0]: rows[roots[i]][0] for i in range(len(rows))}
    copies = [i for i in expect if expect[i] != i]
    assert len(copies) > 250 and sum(got[i] == expect[i] for i in copies) >= 0.95 * len(copies)
    whole = dict(zip((i for i, _ in rows), roots))
    assert all(whole[i] == whole[c] for i, c in got.items())  # nothing is joined that should be apart


@pytest.mark.parametrize("block", [neartext.BLOCK, 20])
def test_near_texts_of_a_crowd_that_holds_links_and_none(spark, block, monkeypatch):
    """Texts with near codes and similarities around 0.8: pairs below it hide none above it, in one part or many."""
    monkeypatch.setattr(neartext, "BLOCK", block)
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(3000)]
    base, rows = rng.choices(vocabulary, k=240), []
    for i in range(220):
        words = base[: rng.randrange(190, 240)] if i % 3 else base[:]
        for _ in range(rng.randrange(3, 7)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        rows.append((i, " ".join(words)))
    sets = [plain_set(t) for _, t in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if jaccard(sets[a], sets[b]) >= 0.8]
    roots = reach(len(rows), links)
    assert 0 < len(links) < 6000 and 3 < len(set(roots)) < 200
    got = {r.doc_id: r.component_id for r in neartext.near_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == dict(enumerate(roots))


def test_near_texts_compare_before_they_join():
    """The set in the middle is near the others but not similar; they are similar to each other."""
    sets = [range(100), [*range(84), *range(200, 216)], [*range(8, 100), *range(300, 308)], range(7, 100), range(0), range(500, 504), range(500, 505)]
    shingles = pa.array([np.array(x, "<u4").tobytes() for x in sets], pa.binary())
    every = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and jaccard(set(sets[i]), set(sets[j])) >= 0.8]
    assert every == [(2, 0), (3, 0), (3, 2), (6, 5)]
    a, b = neartext.similar(shingles, np.zeros(7, int), 0.8)
    assert reach(7, list(zip(a, b))) == reach(7, every)
    side = np.array([0, 0, 1, 0, 0, 1, 0])
    a, b = neartext.similar(shingles, side, 0.8)
    assert reach(7, list(zip(a, b))) == reach(7, [(i, j) for i, j in every if side[i] != side[j]])
    assert [len(x) for x in neartext.similar(shingles[:0], side[:0], 0.8)] == [0, 0]


def plain_links(rows, threshold=0.93):
    ok = [v is not None and label is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v, label in rows]
    unit = [np.array(v, float) / np.linalg.norm(np.array(v, float)) if o else None for (_, v, _), o in zip(rows, ok)]
    return [(a, b) for a in range(len(rows)) for b in range(a) if ok[a] and ok[b] and rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= threshold]


def test_embedding_dedup_against_all_pairs(spark, sf):
    rows = [(r.vec_id, r.embedding, r.label) for r in queries.table(spark, sf, "embeddings").collect()]
    rng = np.random.default_rng(3)
    for k in range(150):  # pairs on both sides of the threshold
        v = np.array(rows[k][1])
        rows.append((5000 + k, [float(x) for x in v + rng.standard_normal(64) * rng.uniform(0.02, 0.07)], rows[k][2]))
    v = rows[0][1]
    rows += [(6000, None, 1), (6001, [0.0] * 64, 1), (6002, [float("nan")] * 64, 1), (6003, [*v[:63], None], 1), (6004, v, None), (6005, v, rows[0][2]), (6005, v, rows[0][2]), (6006, [float(2 * x) for x in v], rows[0][2]), (6007, [1.0, 2.0], 1), (6008, [2.0, 4.0], 1), (6009, [], 1)]
    links = plain_links(rows)
    roots = reach(len(rows), links)
    degree = np.bincount(np.array(links).ravel(), minlength=len(rows))
    expect = sorted((r[0], int(degree[i]), min(rows[j][0] for j in range(len(rows)) if roots[j] == roots[i])) for i, r in enumerate(rows))
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, v string")
    got = embdedup.near_duplicates(df).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == expect
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    split = embdedup.near_duplicates(df, per_cell=100, block=16).collect()  # several cells, several blocks
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in split) == expect
    assert embdedup.near_duplicates(df.limit(0)).count() == 0


def near_pairs(n, seed):
    """Random unit vectors, and as many whose cosines with them are from 0.931 to 0.94."""
    rng = np.random.default_rng(seed)
    a, b = embdedup.unit(rng.standard_normal((n, 64))), rng.standard_normal((n, 64))
    b = embdedup.unit(b - (a * b).sum(axis=1, keepdims=True) * a)
    c = rng.uniform(0.931, 0.94, (n, 1))
    return np.r_[a, c * a + np.sqrt(1 - c**2) * b]


def test_embedding_dedup_misses_no_pair_with_many_cells(spark):
    v = near_pairs(600, 8)
    rows = [(i, x.tolist(), 1) for i, x in enumerate(v)]
    links = plain_links(rows)
    degree = np.bincount(np.array(links).ravel(), minlength=len(rows))
    roots = reach(len(rows), links)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = embdedup.near_duplicates(df, per_cell=30, block=256).collect()  # forty cells
    assert len(links) >= 600 and sorted((r.vec_id, r.n_links, r.component_id) for r in got) == [(i, int(degree[i]), roots[i]) for i in range(len(rows))]


def test_embedding_dedup_keeps_vectors_without_an_id(spark):
    v = near_pairs(3, 8)
    rows = [(7, v[0].tolist(), 1), (None, v[3].tolist(), 1), (None, v[1].tolist(), 1), (None, v[4].tolist(), 1), (None, v[4].tolist(), 1), (None, v[2].tolist(), 1), (None, None, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    some = lambda frame: sorted((r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in embdedup.near_duplicates(frame).collect())
    assert some(df) == sorted([(7, 1, 7, True), (0, 1, 7, False), (0, 2, 0, False), (0, 2, 0, False), (0, 2, 0, False), (0, 0, 0, False), (0, 0, 0, False)])
    assert some(df.filter("vec_id is null")) == [(0, 0, 0, False)] * 3 + [(0, 2, 0, False)] * 3


def test_embedding_dedup_links_vectors_that_share_an_id(spark):
    v = near_pairs(3, 8)
    rows = [(7, v[0].tolist(), 1), (7, v[3].tolist(), 1), (8, v[1].tolist(), 1), (2, v[4].tolist(), 1), (8, v[2].tolist(), 1), (9, v[5].tolist(), 1), (9, v[5].tolist(), 1)]
    got = embdedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == [(2, 1, 2), (7, 1, 7), (7, 1, 7), (8, 1, 2), (8, 2, 8), (9, 2, 8), (9, 2, 8)]


@pytest.mark.parametrize("cells", [60, 300])
def test_embedding_dedup_finds_planted_links_with_many_cells(spark, cells):
    """Of links between different vectors in hundreds of cells, at least nine in ten; here in fact all."""
    v = near_pairs(3000, 9)
    df = spark.createDataFrame([(i, x.tolist(), 1) for i, x in enumerate(v)], "vec_id long, embedding array<double>, label int")
    cosines = v @ v.T
    np.fill_diagonal(cosines, 0)
    true = (cosines >= 0.93).sum(axis=1)
    got = {r.vec_id: r.n_links for r in embdedup.near_duplicates(df, per_cell=6000 // cells).collect()}
    assert true.sum() >= 6000 and sum(got.values()) >= 0.999 * true.sum() and all(got[i] <= n for i, n in enumerate(true))


def test_cells_out_of_reach_are_passed_by():
    rng = np.random.default_rng(2)
    centres = embdedup.unit(rng.standard_normal((40, 64)))
    own = np.repeat(np.arange(40), 50)
    v = embdedup.unit(centres[own] + 0.02 * rng.standard_normal((2000, 64)))
    low = np.array([(v[own == c] @ centres[c]).min() for c in range(40)])
    assert embdedup.visited(v, centres, low, 0.93) == [[c] for c in own.tolist()]


def test_code_estimates_are_unbiased_and_within_bounds():
    rng = np.random.default_rng(1)
    a = embdedup.unit(rng.standard_normal((200, 64)))
    b = embdedup.unit(a + 0.03 * rng.standard_normal((200, 64)))
    error, outside = [], 0
    for seed in range(20):
        turn = embdedup.rotation(64, seed)
        codes = embdedup.Codes(a, turn)
        estimate, rounding = codes.estimates(b, turn, rng)
        true = b @ a.T
        error.append(np.diag(estimate - true).mean())
        near = true >= 0.9
        outside += (np.abs(estimate - true)[near] > codes.slack(0.9, rounding)[near]).sum()
    assert abs(np.mean(error)) < 0.003 and outside == 0


def test_exact_topk_against_brute_force(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in queries.table(spark, sf, "embeddings").collect()]
    v = rows[0][1]
    rows += [(7000, None), (7050, [float("inf")] * 64), (7001, v), (7001, v), (7100, v), (7100, v), (None, v), (8000, [1.0, 2.0]), (8001, [0.5, -3.0]), (9000, [1.0])]
    live = [(i, np.floor(256 * np.array(v, float)).astype(int)) for i, v in rows if i is not None and v is not None and all(math.isfinite(x) for x in v)]
    expect = []
    for at, (q, x) in enumerate(live):
        if q % 50 == 0:
            best = sorted((-int(x @ y), i) for other, (i, y) in enumerate(live) if other != at and len(y) == len(x))[:5]
            expect += [(q, rank, i, -s) for rank, (s, i) in enumerate(best, 1)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, row int")
    for sizes in ({}, {"block": 64, "query_block": 4}):
        assert sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 50 == 0, **sizes).collect())) == sorted(expect)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_exact_topk_of_empty_and_of_huge_vectors(spark):
    rng = np.random.default_rng(5)
    rows = [(i, []) for i in (0, 3, 9, 2)] + [(50 + i, [1e8 * x, 3e7]) for i, x in enumerate(rng.standard_normal(40).tolist())] + [(100, [1e40, -1e300]), (101, [2e13, 1.0]), (150, [-1e13, 0.25])]
    clamp = lambda x: max(-(2**63), min(2**63 - 1, x))
    live = [(i, [clamp(math.floor(256 * x)) for x in v]) for i, v in rows]
    expect = []
    for at, (q, x) in enumerate(live):
        if q % 50 == 0:
            best = sorted((-clamp(sum(a * b for a, b in zip(x, y))), i) for other, (i, y) in enumerate(live) if other != at and len(y) == len(x))[:5]
            expect += [(q, rank, i, -s) for rank, (s, i) in enumerate(best, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for sizes in ({}, {"block": 8, "pivots": 3}):
        assert sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 50 == 0, **sizes).collect())) == sorted(expect)


def test_exact_topk_passes_blocks_by(spark):
    """Queries within tight clusters need no other block than those of their cluster."""
    rng = np.random.default_rng(6)
    centres = 4 * rng.standard_normal((16, 32))
    v = np.repeat(centres, 100, axis=0) + 0.02 * rng.standard_normal((1600, 32))
    v *= 8 / np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    seen = []
    real = topk.materialise
    topk.materialise = lambda frame, name: seen.append((name, real(frame, name))) or seen[-1][1]
    try:
        topk.top_k(df, F.col("vec_id") % 50 == 0, block=50)
    finally:
        topk.materialise = real
    routed = dict(seen)["routed"].select(F.size("visits").alias("n")).collect()
    assert len(routed) == 32 and sum(r.n for r in routed) < 32 * 10
