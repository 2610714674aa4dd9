"""Hand-worked cases of parsing, lookups, wildcards and ranking."""

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexsift.functions import codec, tokens
from lexsift.operators import lookup, rank, wildcard
from lexsift.operators.index import SearchIndex, dense_ids
from lexsift.plans import search_queries
from lexsift.sources.dump import read_dump

PATTERNS = "th* *th t*h *an* an*on* *e*o* i*n*g *ing a*a *a *b e* q*u* *x* *z nd*nd* of* *of n*t* ou*ou *1* 20* *9 a*b*c*d Th* AN*d xyz* * ** a* *7* *-* zz*zz *s*s*s*".split()

RECORD = "product/productId: {}\nreview/userId: U\nreview/profileName: any\nreview/helpfulness: {}\nreview/score: {}\nreview/time: 13\nreview/summary: s\nreview/text: {}"


def dump(tmp_path, text, name="d.txt"):
    path = tmp_path / name
    path.write_bytes(text.encode())
    return str(path)


def build(spark, texts, products=None, helps=None, scores=None):
    rows = [(i + 1, (products or ["P"] * len(texts))[i], *(helps or [(0, 0)] * len(texts))[i], (scores or [5] * len(texts))[i], t) for i, t in enumerate(texts)]
    return SearchIndex.build(spark.createDataFrame(rows, "review_id int, product_id string, help_num smallint, help_den smallint, score tinyint, text string"))


def ranks(df, key="review_id"):
    return [(r[key], r["rank"]) for r in df.collect()]


def test_dump_records_ids_and_values(spark, tmp_path):
    text = "junk line\nmore junk\n" + "\n\n".join([RECORD.format("B1", "1/2", "4.9", "Good dog\nsecond line"), RECORD.format("B2", "0/0", "5.0", "review/text: it's a_b a|b café 12"), RECORD.format("B1", "3/4", "1", "")])
    reviews, rejects = read_dump(spark, dump(tmp_path, text))
    rows = [tuple(r) for r in reviews.orderBy("review_id").collect()]
    assert [r[:5] for r in rows] == [(1, "B1", 1, 2, 4), (2, "B2", 0, 0, 5), (3, "B1", 3, 4, 1)]
    assert rows[0][5].strip() == "Good dog\nsecond line" and "review/text:" not in rows[1][5]
    assert [r.record for r in rejects.collect()] == ["junk line\nmore junk"]
    words = reviews.select("review_id", tokens.tokens(F.col("text")).alias("w")).orderBy("review_id").collect()
    assert [r.w for r in words] == [["good", "dog", "second", "line"], ["it", "s", "a", "b", "a", "b", "caf", "12"], []]


def test_dump_with_other_line_ends_and_a_truncated_record(spark, tmp_path):
    text = "\n".join([RECORD.format("B1", "1/2", "4.0", "one"), "product/productId: B9\nreview/userId: U", RECORD.format("B2", "x/2", "4.0", "bad"), RECORD.format("B3", "1/1", "2.0", "three")])
    reviews, rejects = read_dump(spark, dump(tmp_path, text.replace("\n", "\r\n")))
    assert [(r.review_id, r.product_id, r.text.strip()) for r in reviews.orderBy("review_id").collect()] == [(1, "B1", "one"), (2, "B3", "three")]
    assert rejects.count() == 2


def test_a_piece_of_a_record_at_the_start_is_no_record(spark, tmp_path):
    cut = "left over\nreview/userId: U\nreview/helpfulness: 1/1\nreview/score: 3.0\nreview/time: 1\nreview/text: tail\n"
    reviews, rejects = read_dump(spark, dump(tmp_path, cut + RECORD.format("B1", "1/2", "4.0", "one")))
    assert [(r.review_id, r.product_id) for r in reviews.collect()] == [(1, "B1")] and rejects.count() == 1


def test_dump_ids_stay_dense_over_many_splits(spark, tmp_path):
    path = dump(tmp_path, "junk\n" + "\n".join(RECORD.format(f"B{i}", "1/2", "4.0", "word " * (i % 50)) for i in range(300)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        reviews, rejects = read_dump(spark, path)
        assert [(r.review_id, r.product_id) for r in reviews.orderBy("review_id").collect()] == [(i + 1, f"B{i}") for i in range(300)]
        assert rejects.count() == 1
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_lookups_and_their_sentinels(spark):
    index = build(spark, ["a b b", "B c", ""], ["X", "x", "X"], [(1, 2), (0, 0), (3, 4)], [4, 1, 2])
    got = {r.review_id: tuple(r)[1:] for r in lookup.review_attributes(index, [-1, 0, 1, 3, 4]).collect()}
    assert got == {-1: (None, -1, -1, -1, -1), 0: (None, -1, -1, -1, -1), 1: ("X", 4, 1, 2, 3), 3: ("X", 2, 3, 4, 0), 4: (None, -1, -1, -1, -1)}
    assert {tuple(r) for r in lookup.frequencies(index, ["B", "zz", "c"]).collect()} == {("b", 2, 3), ("zz", 0, 0), ("c", 1, 1)}
    assert {tuple(r) for r in lookup.reviews_of(index, ["X", "nope"]).collect()} == {("X", 1), ("X", 3)}
    assert index.totals == (3, 5)
    assert {tuple(r) for r in index.products.collect()} == {("X", 2), ("x", 1)}
    assert {tuple(r) for r in index.product_postings.collect()} == {("X", 1, 1), ("X", 3, 2), ("x", 2, 2)}


def test_many_tokens_meet_the_postings_by_a_join(spark, monkeypatch):
    index = build(spark, ["aa ab ac", "aa b", "c"])
    asked = lambda: ({tuple(r) for r in lookup.reviews_with(index, ["a*", "b"]).collect()}, ranks(rank.vector_space_search(index, ["a*", "b"], 9)))
    few = asked()
    monkeypatch.setattr(lookup, "LISTED", 2)
    assert lookup.term_postings(index, ["a*"])[1] is None and asked() == few
    assert few[0] == {("a*", 1, 3), ("a*", 2, 1), ("b", 2, 1)}


def test_reviews_without_a_product_are_kept(spark):
    index = build(spark, ["a", "b", "c"], [None, "X", None])
    assert {tuple(r) for r in index.product_ids().collect()} == {(0, None), (1, "X")}
    assert {tuple(r) for r in index.product_postings.collect()} == {(None, 1, 1), (None, 3, 2), ("X", 2, 2)}


def test_terms_that_differ_in_case_only_are_one(spark):
    index = build(spark, ["dog food"])
    for path in ("like", "permuterm", "bigram"):
        assert wildcard.expand_by(index, ["*o*", "*O*"], path).count() == 2


def test_codes_and_front_coding_round_trip(spark):
    numbers = [0, 1, 63, 64, 16383, 16384, 4194303, 4194304, (1 << 30) - 1]
    rows = spark.createDataFrame([(n,) for n in numbers], "n long").select("n", codec.code_hex(F.col("n")).alias("h")).withColumn("back", codec.code_number(F.col("h"))).collect()
    assert [r.back for r in rows] == numbers and [len(r.h) // 2 for r in rows] == [1, 1, 1, 2, 2, 3, 3, 4, 4]
    assert rows[3].h == "4040" and rows[5].h == "804000" and rows[7].h == "c0400000"
    words = sorted(f"{a}{b}" for a in ("an", "and", "b", "ban") for b in range(8))
    coded = codec.front_coded(spark.createDataFrame(list(enumerate(words)), "token_id int, token string"))
    assert sorted(tuple(r) for r in codec.front_decoded(coded.drop("token")).collect()) == list(enumerate(words))


def test_dump_with_many_bad_records_in_short_stretches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("lexsift.sources.dump.STRETCH", 3)
    path = dump(tmp_path, "\n".join(RECORD.format(f"B{i}", "1/2" if i % 3 else "x", "4.0", "w") for i in range(100)))
    reviews, rejects = read_dump(spark, path)
    good = [i for i in range(100) if i % 3]
    assert [(r.review_id, r.product_id) for r in reviews.orderBy("review_id").collect()] == [(k + 1, f"B{i}") for k, i in enumerate(good)]
    assert rejects.count() == 34


def test_wildcard_frequencies_are_sums_over_tokens(spark):
    index = build(spark, ["what when", "what", "other"])
    assert lookup.frequencies(index, ["wh*"]).first()[1:] == (3, 3)
    assert {tuple(r) for r in lookup.reviews_with(index, ["wh*"]).collect()} == {("wh*", 1, 2), ("wh*", 2, 1)}


def test_all_wildcard_paths_agree(spark, sf):
    index = search_queries.index_of(spark, sf)
    like = {}
    for r in wildcard.expand(index.lexicon, PATTERNS).collect():
        like.setdefault(r.term, set()).add(r.token)
    for path in ("permuterm", "bigram"):
        for start in range(0, len(PATTERNS), 16):
            some = PATTERNS[start : start + 16]
            got = {}
            for r in wildcard.expand_by(index, some, path).collect():
                got.setdefault(r.term, set()).add(r.token)
            assert got == {t.lower(): like[t.lower()] for t in some if t.lower() in like}, path
    everything = index.lexicon.count()
    assert len(like["*"]) == len(like["**"]) == everything


@pytest.mark.parametrize("term,key,needed", [("a*b", "b$a", (["$a", "b$"], True)), ("*a", "a$", (["a$"], True)), ("a*b*cd", "cd$a", (["$a", "cd", "d$"], True)), ("*", "$", None), ("*a*", "a", None)])
def test_access_keys(term, key, needed):
    assert wildcard.rotated_key(term) == key
    found = wildcard.required_bigrams(term)
    if needed:
        assert found == needed
    else:
        assert not found[1] and len(found[0]) == 73


def test_nothing_but_the_star_is_special(spark):
    index = build(spark, ["a_b ab axb"])
    assert wildcard.expand(index.lexicon, ["a_*", "a%", "a.*", "a\\*"]).count() == 0
    assert wildcard.expand(index.lexicon, []).count() == 0


def test_equal_reviews_rank_by_id_and_weights_follow_the_formula(spark):
    index = build(spark, ["dog food", "cat", "dog dog food", "dog food", "bird"])
    idf = {"dog": math.log10(5 / 3), "food": math.log10(5 / 3)}
    raw = {"dog": (1 + math.log10(2)) * idf["dog"], "food": idf["food"]}
    norm = math.hypot(*raw.values())
    got = ranks(rank.vector_space_search(index, ["Dog", "food", "dog"], 10))
    one = (raw["dog"] + raw["food"]) / norm
    assert [i for i, _ in got] == [3, 1, 4]
    assert got[1][1] == pytest.approx(one) and got[0][1] == pytest.approx(one + math.log10(2) * raw["dog"] / norm)


def test_a_term_of_all_reviews_gives_no_number_in_id_order(spark):
    index = build(spark, ["the a", "the b", "the the"])
    got = ranks(rank.vector_space_search(index, ["the"], 10))
    assert [i for i, _ in got] == [1, 2, 3] and all(math.isnan(x) for _, x in got)


def test_an_unknown_term_makes_all_ranks_zero(spark):
    index = build(spark, ["dog a", "cat b", "dog dog"])
    assert ranks(rank.vector_space_search(index, ["dog", "zzz"], 10)) == [(1, 0.0), (3, 0.0)]
    assert ranks(rank.language_model_search(index, ["dog", "it's"], 0.5, 10)) == [(1, 0.0), (3, 0.0)]


def test_wildcards_may_have_negative_weight(spark):
    index = build(spark, ["aa ab ac", "aa ab", "b"])
    assert rank.weigh(index, ["a*", "b"])[0].weight < 0


def test_language_model_by_hand(spark):
    index = build(spark, ["dog dog food", "dog cat", "bird"])
    got = dict(ranks(rank.lm_scores(index, ["dog", "food", "dog"], 0.4)))
    dog = lambda tf, n: 0.4 * tf / n + 0.6 * 3 / 6
    assert got == {1: pytest.approx(dog(2, 3) ** 2 * (0.4 / 3 + 0.6 / 6)), 2: pytest.approx(dog(1, 2) ** 2 * (0.6 / 6))}


def test_product_ranks_by_hand(spark):
    index = build(spark, ["dog", "dog dog", "cat", "dog"], ["P", "P", "Q", "R"], [(0, 0), (1, 4), (1, 1), (0, 0)], [5, 3, 5, 5])
    vsm = dict(ranks(rank.vsm_scores(index, ["dog"])))
    one = 0.8 * vsm[1] + 0.2 * 0.5 * vsm[1]
    two = 0.8 * vsm[2] * 3 / 5 + 0.2 * 0.25 * vsm[2]
    got = dict(ranks(rank.product_scores(index, ["dog"]), "product_id"))
    assert got == {"P": pytest.approx((one + two) / 2), "R": pytest.approx(0.8 * vsm[4] + 0.1 * vsm[4])}
    assert [p for p, _ in ranks(rank.product_search(index, ["dog"], 1), "product_id")] == [max(got, key=got.get)]


def test_empty_queries_and_sizes(spark):
    index = build(spark, ["dog", "cat"])
    assert rank.vector_space_search(index, [], 5).count() == 0
    assert rank.vector_space_search(index, ["dog"], 0).count() == 0
    assert rank.vector_space_search(index, ["nothing"], 5).count() == 0
    assert rank.search(index, "dog cat", k=50).count() == 2
    assert rank.search(index, "dog", "products").count() == 1
    assert rank.search(index, "dog", method="language").count() == 1
    with pytest.raises(ValueError):
        rank.search(index, "dog", method="other")


@pytest.mark.parametrize("path", ["permuterm", "bigram"])
def test_store_open_and_remove(spark, tmp_path, path):
    index = build(spark, ["dog food", "cat dog"])
    folder = str(tmp_path / "index")
    stored = index.write(folder, path)
    with pytest.raises(FileExistsError):
        index.write(folder, path)
    assert ranks(rank.vector_space_search(stored, ["cat"], 5)) == ranks(rank.vector_space_search(index, ["cat"], 5))
    opened = SearchIndex.open(spark, folder)
    assert {r.token for r in wildcard.expand_by(opened, ["*o*"], path).collect()} == {"dog", "food"}
    plan = opened.postings.filter(tokens.matches(F.col("token"), "do*"))._jdf.queryExecution().toString()
    assert "StringStartsWith(token,do)" in plan
    ranked = rank.vsm_scores(opened, ["cat", "do*"])._jdf.queryExecution().executedPlan().toString()
    assert ranked.count("Exchange hashpartitioning") == 1 and "Python" not in ranked and "Join" not in ranked
    assert "In(token, [cat,dog])" in ranked  # expanded through the stored access path, then a list in the scan
    looked = wildcard.expand_terms(opened, ["cat", "do*"])._jdf.queryExecution().executedPlan().toString()
    assert {"permuterm": "StringStartsWith(rotation,$do)", "bigram": "In(bigram, [$d,do])"}[path] in looked
    assert {tuple(r) for r in lookup.reviews_with(opened, ["*o*", "cat"]).collect()} == {("*o*", 1, 2), ("*o*", 2, 1), ("cat", 2, 1)}
    SearchIndex.remove(spark, folder)
    with pytest.raises(FileNotFoundError):
        SearchIndex.remove(spark, str(tmp_path))
    assert not (tmp_path / "index").exists()


def test_an_index_of_one_token_and_of_none(spark):
    one = build(spark, ["word"])
    assert one.bigrams.count() == 5 and one.permuterm.count() == 5
    none = build(spark, ["", None])
    assert none.totals == (2, 0) and none.lexicon.count() == 0
    assert rank.language_model_search(none, ["x"], 0.5, 3).count() == 0


@given(st.lists(st.text("ab1", min_size=1, max_size=6), min_size=1, max_size=12))
@settings(max_examples=8, deadline=None)
def test_sums_agree(spark, words):
    index = build(spark, [" ".join(words), "ab " + words[0]])
    total = len(words) + 2
    assert index.totals[1] == total
    row = index.lexicon.agg(F.sum("cf"), F.max(F.col("df") - F.col("cf"))).first()
    assert row[0] == total and row[1] <= 0
    gapped = codec.gaps(codec.ordinals(index.postings, stretch=2)).drop("review_id")
    assert {tuple(r) for r in codec.gaps(index.postings, stretch=2).collect()} == {tuple(r) for r in codec.gaps(index.postings).collect()}
    assert {tuple(r) for r in codec.decoded(gapped, stretch=1).collect()} == {tuple(r) for r in codec.decoded(gapped).collect()}
    assert {tuple(r) for r in codec.decoded(gapped).select("token", "review_id", "tf").collect()} == {tuple(r) for r in index.postings.select("token", "review_id", "tf").collect()}


def test_code_sizes_and_shared_prefixes(spark):
    df = spark.createDataFrame([(63, "abc", "abd"), (64, "a", "b"), (16383, "", "x"), (16384, "same", "same"), (4194303, "ab", "abc"), (4194304, "é1", "é2")], "n long, a string, b string")
    rows = df.select(codec.code_bytes(F.col("n")).alias("s"), codec.shared_prefix(F.col("a"), F.col("b")).alias("p")).collect()
    assert [tuple(r) for r in rows] == [(1, 2), (2, 0), (2, 0), (3, 4), (3, 2), (4, 1)]


def test_dense_ids_are_sort_ranks(spark):
    values = ["b", "a", "ab", "abc", "b", "", "zz", "é"]
    got = {r.x: r.i for r in dense_ids(spark.createDataFrame([(v,) for v in values], "x string"), "x", "i", 2).collect()}
    assert got == {v: i for i, v in enumerate(sorted(set(values), key=str.encode))}
