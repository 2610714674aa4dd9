"""Packing and token counts against plain versions."""

import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lexsift.llm import packing, queries, tokencount

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", None, "a\x1cb c", "<|endoftext|> x <|startoftext|>", " a b ́c", "It's  A\tTEST\x85now", "x" * 5000, "one two " * 3000, "﻿​12,5 %"]


@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=30))
@settings(max_examples=150, deadline=None)
def test_best_two_fit_uses_each_document_once(counts):
    used = Counter()
    for times, items in packing.best_two_fit(counts, 64):
        assert times >= 1 and sum(n * k for n, k in items) <= 64
        for n, k in items:
            used[n] += times * k
    assert used == Counter(counts)


def test_best_two_fit_replaces_the_smallest_document():
    # Greedy takes 6 + 3 and leaves 1; 3 gives way to 2 + 2, which fill the bin.
    assert packing.best_two_fit({6: 1, 3: 1, 2: 2}, 10)[0] == (1, [(6, 1), (2, 2)])
    with pytest.raises(ValueError):
        packing.best_two_fit({11: 1}, 10)


def test_best_two_fit_is_close_to_the_bound():
    rng = np.random.default_rng(0)
    lengths = np.minimum(2048, rng.lognormal(6, 1, 20000).astype(int) + 1)
    bins = sum(t for t, _ in packing.best_two_fit(dict(Counter(lengths.tolist())), 2048))
    assert bins <= np.ceil(lengths.sum() / 2048) * 1.001 + 1


def test_word_ids_equal_the_tokenizer(spark, sf):
    whole, own = Tokenizer.from_file(PATH), packing.WordIds(PATH, bound=500)
    texts = [t or "" for t in ODD] + [r.text for r in queries.table(spark, sf, "documents").collect()]
    for text in texts:
        assert np.frombuffer(own(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids


BOTH = Tokenizer.from_file(PATH), packing.WordIds(PATH, bound=500)


@given(st.one_of(st.text(max_size=40), st.text("Zİıßſ́ŉǰ aB.,#*1é'’<|>\u0307", max_size=30)))
@example("Zİ#")
@example("İ. İ#x ŉ! ǅ%")
@settings(max_examples=1500, deadline=None)
def test_word_ids_equal_the_tokenizer_on_any_text(text):
    whole, own = BOTH
    assert np.frombuffer(own(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids


def test_packing_round_trip(spark, sf):
    rows = [(r.doc_id, r.text) for r in queries.table(spark, sf, "documents").collect()] + [(10_000 + i, t) for i, t in enumerate(ODD)] + [(10_001, None), (None, "again"), (None, "again")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, length int, slot int").repartition(5)
    got = packing.pack_documents(df, PATH, keep_ids=True).collect()
    whole = Tokenizer.from_file(PATH)
    expect = []
    for doc_id, text in rows:
        ids = [*whole.encode(text or "", add_special_tokens=False).ids, 0]
        expect += [(doc_id or -1, k, s, len(p), zlib.crc32(np.array(p, "<u4").tobytes()), tuple(p)) for k, s in enumerate(range(0, len(ids), 2048)) for p in [ids[s : s + 2048]]]
    assert sorted((r.doc_id or -1, r.piece, r.start, r.length, r.ids_crc32, tuple(r.ids)) for r in got) == sorted(expect)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= -(-sum(r.length for r in got) // 2048) + 2
    assert packing.pack_documents(df.limit(0), PATH).count() == 0


def plain_count(text, scores, byte):
    best = [(0, 0)]
    for end in range(1, len(text) + 1):
        n = len(text[end - 1].encode())
        options = [(best[end - 1][0] + n * byte, best[end - 1][1] - n)]
        options += [(best[s][0] + scores[text[s:end]], best[s][1] - 1) for s in range(end) if text[s:end] in scores]
        best.append(max(options))
    return -best[-1][1]


@given(st.lists(st.text("abcéx", max_size=12), max_size=30))
@settings(max_examples=80, deadline=None)
def test_trie_equals_plain_dynamic_programme(words):
    scores = tokencount.zipf_scores(["a", "b", "ab", "abc", "c", "é", "bca", "aaa"])
    byte = min(scores.values()) - tokencount.UNIT
    for bound in (10**6, 3):
        trie = tokencount.PretokenTrie(scores, bound)
        for w in words:
            assert trie.count(w) == plain_count(w, scores, byte)


def test_shared_prefixes_share_nodes():
    trie = tokencount.PretokenTrie(tokencount.zipf_scores(["a", "b"]))
    trie.count("abab")
    before = len(trie.forward)
    trie.count("abaa")
    assert len(trie.forward) == before + 1


def test_token_counts_over_a_table(spark, sf):
    path = public_tokenizers.path("piece_bpe_32k.model")
    scores = tokencount.zipf_scores(tokencount.load_pieces(path))
    byte = min(scores.values()) - tokencount.UNIT
    rows = [(r.doc_id, r.text) for r in queries.table(spark, sf, "documents").limit(25).collect()] + [(900, None), (901, ""), (902, "x" * 600), (902, "\U0001f600 一"), (None, "a b a")]
    got = tokencount.token_counts(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_tokens int"), path).collect()
    expect = sorted((i or -1, len((t or "").encode().split()), sum(plain_count("▁" + w.decode(), scores, byte) for w in (t or "").encode().split())) for i, t in rows)
    assert sorted((r.doc_id or -1, r.n_pretokens, r.n_tokens) for r in got) == expect
