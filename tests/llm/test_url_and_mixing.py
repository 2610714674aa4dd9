"""URL verdicts and mixing against plain versions."""

import re
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lexsift.llm import mixing, queries, urlfilter

RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def plain_parts(url):
    if not url or "://" not in url:
        return "", ""
    rest = url[url.index("://") + 3 :]
    host = re.split("[/?#]", rest, maxsplit=1)[0]
    path = re.split("[?#]", rest[len(host) :], maxsplit=1)[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def plain_rule(host, path):
    fit = [(len(r), r, v) for v, r in RULES for h, p in [r.split("/", 1)] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
    return max(fit)[1:] if fit else (None, None)


def plain_ranks(edges, seeds, rounds=300, d=urlfilter.DAMPING):
    out = defaultdict(float)
    for (a, _), w in edges.items():
        out[a] += w
    rank, mass = dict(seeds), sum(seeds.values())
    for _ in range(rounds if seeds else 0):
        new = defaultdict(float)
        for (a, b), w in edges.items():
            new[b] += d * rank.get(a, 0) * w / out[a]
        back = mass - sum(new.values())
        for s, x in seeds.items():
            new[s] += back * x / mass
        rank = new
    return rank


def seeds_of(parts, ruled, verdict):
    number = sum(1 for p, r in zip(parts, ruled) if p[0] and r[1])
    seeds = defaultdict(float)
    for p, r in zip(parts, ruled):
        if p[0] and r[1] == verdict:
            seeds[p[0]] += 1 / number
    return seeds


def plain_verdicts(pages):
    parts = [plain_parts(u) for _, u, _ in pages]
    ruled = [plain_rule(*p) for p in parts]
    edges = defaultdict(float)
    for (host, _), (_, _, html) in zip(parts, pages):
        for link in re.findall(urlfilter.LINK, html or ""):
            link = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in link)
            if host and link != host:
                edges[host, link] += 1
    trust = plain_ranks(edges, seeds_of(parts, ruled, "allow"))
    distrust = plain_ranks({(b, a): w for (a, b), w in edges.items()}, seeds_of(parts, ruled, "block"))
    return sorted((i or -1, h, p, r[0] or "", r[1] or ("block" if distrust.get(h, 0) > trust.get(h, 0) * (1 + urlfilter.MARGIN) else "allow")) for (i, _, _), (h, p), r in zip(pages, parts, ruled))


ODD = [
    (9000, None, None), (9001, "no scheme", "<a href='http://x.net/'>"), (9002, "http://Example.ORG", ""), (9003, "http://example.org/es/q?a", None), (9004, "ftp://a.example.org/en/1x#y", ""),
    (9005, "http://notexample.org/es/", ""), (9006, "http://com/de/", ""), (9007, "x://a.com/fr/?://b.com/de/", ""), (9007, "x://a.com/fr/?://b.com/de/", ""), (None, "http://bad.net/\n/z", "q"), (9008, "http://?x", ""),
    # a chain of hosts that points at a blocked one, and one that a trusted one points at
    (9010, "http://farm.net/a", "<a href=http://com/de/x><a HREF='HTTP://hub.net/'>"), (9011, "http://hub.net/", "<a href=\"http://farm.net/q\">" * 3), (9012, "http://good.org/", "<a href=//good.net/><a href='https://good.net/x'>"), (9013, "http://good.net/", "<img src='http://good.net/i'>"),
]


def test_url_verdicts_against_a_plain_version(spark, sf):
    pages = [(r.page_id, r.url, r.html) for r in queries.table(spark, sf, "pages").collect()] + ODD
    df = spark.createDataFrame([(*p, "h") for p in pages], "page_id long, url string, html string, host string")
    got = sorted((r.page_id or -1, r.host, r.path, r.rule or "", r.verdict) for r in urlfilter.judge(df).collect())
    assert got == plain_verdicts(pages)
    by = {i: v for i, *_, v in got}
    assert (by[9010], by[9011], by[9013], by[9006]) == ("block", "block", "allow", "block")
    assert urlfilter.judge(df.limit(0)).count() == 0
    assert urlfilter.judge(df.filter("page_id = 9013")).count() == 1


def test_trust_and_distrust_reach_as_far_as_links_do(spark):
    far = [(i, f"http://h{i}.net/", f"<a href='//h{i + 1}.net/'>") for i in range(16)] + [(16, "http://h16.net/", "<a href=//com/de/x>"), (17, "http://com/de/", None)]
    near = [(20, "http://a.org/", "<a href=https://b.net/>"), (21, "http://b.net/", ""), (22, "http://c.net/", "<a href='/x//y'><a href='#//z'>")]
    got = {r.page_id: r for r in urlfilter.judge(spark.createDataFrame(far + near, "page_id long, url string, html string")).collect()}
    assert all(got[i].verdict == "block" and got[i].distrust > 0 for i in range(17))
    assert (got[21].verdict, got[22].verdict, got[22].trust) == ("allow", "allow", 0.0) and got[21].trust > 0


def test_seeds_weigh_as_much_as_their_pages(spark):
    """Two allowed pages and one blocked: the host's other pages are allowed, whatever the corpus has elsewhere."""
    rules = (("allow", "m.net", "/good/"), ("block", "m.net", "/bad/"), ("allow", "org", "/"), ("block", "bad.org", "/"))
    pages = [(1, "http://m.net/good/1", ""), (2, "http://m.net/good/2", ""), (3, "http://m.net/bad/1", ""), (4, "http://m.net/x", "")]
    more = [(10 + i, f"http://h{i}.org/", "") for i in range(20)] + [(40, "http://bad.org/", "")]
    for frame in (pages, pages + more, pages + more[:1] + more[-1:]):
        got = {r.page_id: r.verdict for r in urlfilter.judge(spark.createDataFrame(frame, "page_id long, url string, html string"), rules).collect()}
        assert got[4] == "allow" and got[3] == "block"
    even = pages[1:]  # as many allowed as blocked pages: a tie allows
    assert {r.page_id: r.verdict for r in urlfilter.judge(spark.createDataFrame(even, "page_id long, url string, html string"), rules).collect()}[4] == "allow"
    flipped = [(5, "http://m.net/bad/2", ""), (6, "http://m.net/bad/3", "")]
    assert {r.page_id: r.verdict for r in urlfilter.judge(spark.createDataFrame(pages + flipped, "page_id long, url string, html string"), rules).collect()}[4] == "block"


def test_url_sql_walks_along_links_as_well(spark):
    rows = [(1, "http://farm.net/a", "<a href=http://com/de/x><a HREF='HTTP://hub.net/'>"), (2, "http://hub.net/", '<a href="http://farm.net/q">' * 3), (3, "http://good.org/", "<a href=//good.net/>"), (4, "http://good.net/", None), (5, "http://com/de/y", ""), (None, None, "x"), (6, "HTTP://Example.ORG/es/1?q#z", "")]
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", rows)
    want = con.execute(queries.ORACLE["op5_url_filter"])
    columns = [d[0] for d in want.description]
    got = urlfilter.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).select(columns).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want.fetchall(), key=str)
    assert {r.page_id: r.verdict for r in got}[2] == "block"


def test_ranks_settle(spark):
    edges = spark.createDataFrame([("trust", a, b, 1.0) for a, b in ("ab", "ba", "bc", "cd", "dc")], "kind string, src string, dst string, w double")
    got = {r.host: r.rank for r in urlfilter.propagate(edges, spark.createDataFrame([("trust", "a", 1.0)], "kind string, host string, s double")).collect()}
    expect = plain_ranks({(a, b): 1.0 for a, b in ("ab", "ba", "bc", "cd", "dc")}, {"a": 1.0}, rounds=500)
    assert got == pytest.approx(expect, rel=1e-4)


def plain_rake(mass, goals, rounds=300):
    cells = {k: v for k, v in mass.items() if v > 0}
    weight = dict.fromkeys(cells, 1.0)
    for _ in range(rounds):
        for side, goal in enumerate(goals):
            sums = defaultdict(float)
            for c, v in cells.items():
                sums[c[side]] += v * weight[c]
            for c in cells:
                weight[c] *= goal.get(c[side], 0) / sums[c[side]] if sums[c[side]] else 1
    return weight


def share(values, power):
    raised = {k: v**power for k, v in values.items() if v > 0}
    return {k: v / sum(raised.values()) for k, v in raised.items()}


def rows_of(spark, sf):
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in queries.table(spark, sf, "documents").collect()]
    return rows + [(9000, None, None, None), (9001, "", "en", "src1"), (9002, "a b @ c", None, "src1"), (9002, "a b @ c", None, "src1"), (None, "x " * 5000, "en", None)]


def test_mixing_against_plain_raking(spark, sf):
    rows = rows_of(spark, sf)
    df = spark.createDataFrame([(*r, 1.0, "t") for r in rows], "doc_id long, text string, lang string, source string, weight double, topic string")
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    mass, sides = defaultdict(float), [defaultdict(float) for _ in range(3)]
    for r in got:
        cell = (r.source, r.language, r.topic)
        mass[cell] += r.n_tokens
        for side, name in zip(sides, cell):
            side[name] += r.n_tokens
    words = sorted(len((t or "").encode().split()) for _, t, _, _ in rows)
    assert sorted(r.n_tokens for r in got) == words
    total = sum(mass.values())
    weight = plain_rake(mass, [share(s, 0.7) for s in sides])
    for r in got:
        if mass[r.source, r.language, r.topic]:
            assert r.weight == pytest.approx(weight[r.source, r.language, r.topic] * total, rel=1e-4, abs=1e-9)
    assert sum(r.n_tokens * r.probability for r in got) == pytest.approx(0.8 * total, rel=1e-6)
    kept = {}
    for r in got:
        assert kept.setdefault(r.doc_id, r.kept) == r.kept and (r.kept or r.probability < 1)
    whole = mixing.sample(df)
    assert whole.columns == df.columns
    assert sorted(r.doc_id or -1 for r in whole.collect()) == sorted(r.doc_id or -1 for r in got if r.kept)
    for frame in (df.limit(0), df.filter("doc_id = 9001")):
        assert mixing.mix(frame).count() == frame.count()


@pytest.mark.parametrize("pairs", [mixing.PAIRS, 1])
def test_mixing_meets_given_targets_of_all_three_margins(spark, pairs, monkeypatch):
    monkeypatch.setattr(mixing, "PAIRS", pairs)  # with one pair all margins are grouped sums
    rng = np.random.default_rng(0)
    rows = [(i, "w " * int(rng.integers(1, 60)), "en" if rng.random() < 0.7 else "fr", f"s{rng.integers(0, 4)}", "a" if rng.random() < 0.5 else "b") for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, subject string")
    sources = spark.createDataFrame([("s0", 4.0), ("s1", 3.0), ("s2", 2.0), ("s3", 1.0), ("gone", 5.0)], "source string, target double")
    got = mixing.mix(df, topic=F.col("subject"), source_targets=sources, language_targets={"en": 0.5, "fr": 0.5, "xx": 9.0}, topic_targets={"a": 0.25, "b": 0.75}, keep=0.3)
    rows = got.collect()
    mass = sum(r.n_tokens * r.weight for r in rows)
    part = lambda c, v, of: sum(r.n_tokens * of(r) for r in rows if r[c] == v)
    for column, name, goal in (("source", "s0", 0.4), ("source", "s3", 0.1), ("language", "fr", 0.5), ("topic", "b", 0.75)):
        assert part(column, name, lambda r: r.weight) / mass == pytest.approx(goal, abs=1e-6)
    kept = sum(r.n_tokens for r in rows if r.kept)
    assert kept == pytest.approx(0.3 * sum(r.n_tokens for r in rows), rel=0.1)
    assert part("language", "fr", lambda r: r.kept) / kept == pytest.approx(0.5, abs=0.06)


def test_mixing_rakes_many_languages_and_topics(spark):
    """Hundreds of classes on each side; each has its own factor, and targets of rare ones hold."""
    docs = [(i, "w " * (20 + i % 7), f"l{i % 150}", f"s{i // 150 % 2}", f"t{i // 300 % 4}") for i in range(2400)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, subject string")
    goals = {f"l{k}": 1.0 + k % 3 for k in range(150)}
    rows = mixing.mix(df, topic=F.col("subject"), language_targets=goals).collect()
    assert {r.language for r in rows} == goals.keys() and len({r.topic for r in rows}) == 4
    by = defaultdict(float)
    for r in rows:
        by[r.language] += r.n_tokens * r.weight
    for k, v in by.items():
        assert v / sum(by.values()) == pytest.approx(goals[k] / sum(goals.values()), rel=1e-6)


def test_mixing_tells_when_targets_cannot_be_met(spark):
    df = spark.createDataFrame([(1, "a b", "en", "s"), (2, "a b", "fr", "r")], "doc_id long, text string, lang string, source string")
    sources = spark.createDataFrame([("s", 9.0), ("r", 1.0)], "source string, target double")
    with pytest.warns(UserWarning, match="margins not met"):
        mixing.mix(df, source_targets=sources, language_targets={"en": 0.5, "fr": 0.5}, rounds=4)


def test_mixing_draws_by_text_without_an_id(spark):
    df = spark.createDataFrame([(None, f"word{i} " * 5, "en", "s") for i in range(400)] + [(-1, "x", "en", "s")], "doc_id long, text string, lang string, source string")
    kept = sum(r.kept for r in mixing.mix(df, keep=0.5).collect())
    assert 150 < kept < 250 and mixing.sample(df, keep=0.5).count() == kept


def test_mixing_has_no_python_in_its_plan(spark, sf):
    for frame in (mixing.mix(queries.table(spark, sf, "documents")), mixing.sample(queries.table(spark, sf, "documents"))):
        assert not re.search("Python|Pandas|Arrow|ExistingRDD", frame._jdf.queryExecution().toString())
