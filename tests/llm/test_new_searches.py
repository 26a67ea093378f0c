"""Ranked search, URL filter and hard negatives against plain versions of their contracts, and on awkward tables."""

import collections
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import hard_negatives, ranked_search, url_filter
from plumbline.llm.common import threshold_join

DOCS = "doc_id long, text string"
ITEMS = "item_id long, text string"


# 11
def ranked_plainly(docs, items, k):
    words = lambda t: re.findall(rb"[0-9a-z\x80-\xff]+", (t or "").encode().lower())
    held = [(i, collections.Counter(words(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n, total = len(held), sum(sum(c.values()) for _, c in held)
    df = collections.Counter(w for _, c in held for w in c)
    out = []
    for item in sorted({i for i, t in items if i is not None and t is not None}):
        asked = collections.Counter(words(min(t for i, t in items if i == item and t is not None)))
        scored = []
        for i, c in held:
            m = 75 + 25 * sum(c.values()) * n // total
            s = sum(q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10 ** 9 * c[w] // (1000 * c[w] + 12 * m))
                    for w, q in asked.items() if w in c)
            if s > 0 and i is not None:
                scored.append((-s, i))
        out += [(item, place, i, -s) for place, (s, i) in enumerate(sorted(scored)[:k], start=1)]
    return out


def test_ranked_search_equals_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(60)] + ["Straße", "É", "ABC"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    text = lambda n: " ".join(rng.choices(vocabulary, weights, k=n))
    docs = [(i, text(rng.choice((3, 20, 60)))) for i in range(400)]
    docs += [(1000 + i, docs[0][1]) for i in range(40)] + [(7, docs[7][1]), (500, None), (501, ""), (502, "-- !!"), (None, text(30)),
                                                         (503, "w1 " * 5000)]
    items = [(i, text(rng.choice((2, 6, 25)))) for i in range(25)] + [(100, None), (101, ""), (None, "w1"), (102, "nowhere"),
                                                                     (3, "w3 w3 w4"), (103, docs[0][1])]
    frames = spark.createDataFrame(docs, DOCS).withColumns({"key": F.lit(1), "score": F.lit("x"), "item": F.lit(2)}), \
        spark.createDataFrame(items, ITEMS).withColumn("word", F.lit(1))
    expected = ranked_plainly(docs, items, 20)
    for found in (ranked_search.op11_ranked_search(*frames),
                  ranked_search.rank_documents(*frames, passed=60, grouped=40, first=30).withColumnsRenamed({"item": "item_id", "key": "doc_id"})):
        assert found.columns == ["item_id", "rank", "doc_id", "score"]
        assert sorted(tuple(r) for r in found.collect()) == expected


def test_ranked_search_skips_blocks_by_their_summaries():
    rng = np.random.default_rng(0)
    topics = rng.random((20, 300)) * (rng.random((20, 300)) < 0.1)
    values = (1e6 * topics[rng.integers(0, 20, 2000)] * (rng.random((2000, 300)) < 0.8)).astype(np.int32)
    chunk, count = ranked_search.Chunk(values, np.ones(300)), collections.Counter()
    for _ in range(20):
        columns = np.flatnonzero(topics[rng.integers(20)])[:12]
        weights = rng.integers(1, 9, len(columns))
        rows, scores = chunk.find(columns, weights, 1, np.zeros(0, np.int64), 10, count)
        every = values[:, columns].astype(np.int64) @ weights
        assert np.sort(scores)[::-1][:10].tolist() == np.sort(every)[::-1][:10].tolist()
        assert (every[rows] == scores).all()
    assert count["skipped"] > 0.5 * count["blocks"] and count["scored"] < 0.25 * 20 * 2000


def test_ranked_search_on_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b")], DOCS), spark.createDataFrame([(1, "a")], ITEMS)
    assert [tuple(r) for r in ranked_search.op11_ranked_search(docs, items).collect()] == [tuple(x) for x in ranked_plainly([(1, "a b")], [(1, "a")], 20)]
    for pair in ((docs.limit(0), items), (docs, items.limit(0)), (docs.limit(0), items.limit(0))):
        assert ranked_search.op11_ranked_search(*pair).collect() == []


# 12
def ruled_plainly(url):
    rest = (url or "").split("://", 1)[1] if "://" in (url or "") else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits, key=lambda x: len(x[0])) if fits else (None, None)))


def ratio_plainly(train, url):
    """The same models by dictionaries and recursion: train is a list of (url, class)."""
    grams = [collections.Counter(), collections.Counter()]
    spell = lambda u: [0] * url_filter.ORDER + [b + 1 for b in u.encode()] + [url_filter.END]
    for u, side in train:
        s = spell(u)
        for at in range(url_filter.ORDER, len(s)):
            for length in range(1, url_filter.ORDER + 2):
                grams[side][tuple(s[at - length + 1:at + 1])] += 1
    kept = {g for g in {*grams[0], *grams[1]} if len(g) <= 3 or grams[0][g] + grams[1][g] >= url_filter.LEAST}
    follow = [collections.defaultdict(dict), collections.defaultdict(dict)]
    for g in kept:
        for side in (0, 1):
            if grams[side][g]:
                follow[side][g[:-1]][g[-1]] = grams[side][g]

    def p(side, context, c):
        shorter = p(side, context[1:], c) if context else 1 / url_filter.END
        after = follow[side].get(context)
        return (after.get(c, 0) + len(after) * shorter) / (sum(after.values()) + len(after)) if after else shorter

    s = spell(url or "")
    return sum(math.log(p(0, tuple(s[at - url_filter.ORDER:at]), s[at]) / p(1, tuple(s[at - url_filter.ORDER:at]), s[at]))
               for at in range(url_filter.ORDER, len(s))) / (len(s) - url_filter.ORDER)


URLS = ["http://a.example.net/en/1", "https://EXAMPLE.net/en", "http://net", "http://net/", "http://x.com/de/", "http://www.example.com/de/1?x#y",
        "http://org/fr/?a", "https://É.ORG/fr/x", "notanet/", "", None, "://", "http://badnet/en/", "http://a.org/fr", "ftp://h.net?q=/en/",
        "http://example.com/de/a://b.net/", "http://x.org/fr/\u2028y\nz", "a" * 30_000, "http://casino.example.org/en/", "http://a\nb.net/c"]


def test_url_rules_equal_plain_ones(spark):
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(URLS)] + [(None, None, None), (0, URLS[0], "x")], "page_id long, url string, html string")
    got = url_filter.op12_url_filter(pages.withColumns({c: F.lit(1) for c in ("host", "path", "told", "ratio", "key", "verdict")})).collect()
    assert len(got) == len(URLS) + 2
    for r in got:
        url = None if r.page_id is None else URLS[r.page_id]
        host, path, rule, verdict = ruled_plainly(url)
        assert (r.host, r.path, r.rule) == (host, path, rule), url
        assert r.verdict == verdict if verdict else r.verdict in ("allow", "block")
    assert url_filter.op12_url_filter(pages.limit(0)).collect() == []
    only = url_filter.op12_url_filter(pages.filter("page_id IN (3, 12)")).collect()  # no accepted example
    assert {(r.page_id, r.verdict, r.score) for r in only} == {(3, "block", 0.0), (12, "allow", 0.0)}


def test_url_ratio_equals_plain_models(spark):
    rng = random.Random(2)
    train = [(f"http://{rng.choice(('news', 'blog'))}{rng.randrange(30)}.com/{rng.choice('abc')}", 0) for _ in range(60)]
    train += [(f"http://{rng.choice(('spin', 'win'))}-{rng.randrange(30)}.biz/{rng.choice('xyz')}?r={rng.randrange(9)}", 1) for _ in range(60)]
    rows = spark.createDataFrame([(u, ("allow", "block")[c]) for u, c in train], "url string, verdict string")
    counted = url_filter._strings(rows).filter(f"length <= 3 OR string = 0 OR accepted + rejected >= {url_filter.LEAST}").toPandas()
    model = url_filter.pack({c: counted[c].to_numpy() for c in counted.columns})
    asked = ["http://news9.com/a", "http://win-4.biz/z?r=1", "", "quite other", "é", "http://"]
    found = url_filter.ratios(model, [u.encode() for u in asked])
    assert found == pytest.approx([ratio_plainly(train, u) for u in asked], abs=1e-9)
    assert found[0] > 0 > found[1]
    assert url_filter.ratios(model, []).tolist() == []


def test_url_model_counts_every_distinct_url(spark):
    """More URLs a class than the counts once read; folds aside, each is counted once."""
    n = 70_000
    url = F.when(F.col("id") < n, F.concat(F.lit("http://a"), "id", F.lit(".example.net/en/"))).otherwise(F.concat(F.lit("http://b"), "id", F.lit(".net/")))
    rows = spark.range(2 * n).select(url.alias("url"), F.when(F.col("id") < n, "allow").otherwise("block").alias("verdict"))
    model, root = url_filter.train(rows)
    ends = model.filter(f"length = 1 AND string = {url_filter.END}").select("accepted", "rejected").collect()
    counted = rows.filter(url_filter._fold() > 0).groupBy("verdict").agg(F.count("*"), F.sum(F.octet_length("url") + 1)).collect()
    expected = {v: (k, symbols) for v, k, symbols in counted}
    assert [tuple(r) for r in ends] == [(expected["allow"][0], expected["block"][0])]
    assert root[:2] == (expected["allow"][1], expected["block"][1])  # what follows the empty string: every symbol
    assert sum(k for k, _ in expected.values()) > 2 * 50_000


def test_url_scores_do_not_depend_on_blocks(spark):
    rng = random.Random(5)
    train = [(f"http://{rng.choice(('news', 'blog'))}{i}.com/{rng.choice('abc')}", 0) for i in range(60)]
    train += [(f"http://{rng.choice(('spin', 'win'))}-{i}.biz/{rng.choice('xyz')}?r={rng.randrange(9)}", 1) for i in range(60)]
    rows = spark.createDataFrame([(u, ("allow", "block")[c]) for u, c in train], "url string, verdict string")
    asked = spark.createDataFrame([(u, None) for u in [*(u for u, _ in train), "", "quite other", "é", "http://", "x" * 3000]], rows.schema)
    model, root = url_filter.train(rows)
    kept = {r.url for r in rows.filter(url_filter._fold() > 0).collect()}
    for size in (50, 1 << 20):
        found = {r.url: r.ratio for r in url_filter._scored(asked, model, root, size).collect()}
        assert len(found) == 125
        for u in [*list(found)[::9], "", "é", "http://"]:
            assert found[u] == pytest.approx(ratio_plainly([t for t in train if t[0] in kept], u), abs=1e-9)


def test_url_models_tell_held_out_urls_apart(spark):
    rng = random.Random(4)
    rows = [(i, f"http://{rng.choice(('garden', 'music', 'school'))}{rng.randrange(500)}.example.net/en/{rng.randrange(9999)}") for i in range(600)]
    rows += [(1000 + i, f"http://{rng.choice(('quick', 'best', 'big'))}-{rng.choice(('loan', 'win'))}{rng.randrange(500)}.net/go?c={rng.randrange(9999)}") for i in range(600)]
    rows += [(2000 + i, f"http://{('garden', 'music')[i % 2]}{i}.info/en/{i}") for i in range(50)]
    rows += [(3000 + i, f"http://big-{('loan', 'win')[i % 2]}{i}.info/go?c={i}") for i in range(50)]
    got = {r.page_id: r.verdict for r in url_filter.op12_url_filter(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert sum(got[2000 + i] == "allow" for i in range(50)) >= 48 and sum(got[3000 + i] == "block" for i in range(50)) >= 48


def test_calibration():
    assert url_filter.calibrate([("allow", 10, 5), ("allow", 20, 5), ("block", -10, 5), ("block", -20, 9)]) == pytest.approx(0, abs=1 / 128)
    assert url_filter.calibrate([("allow", 10, 5)]) == url_filter.calibrate([]) == 0
    assert url_filter.calibrate([("allow", 10 ** 6, 1), ("block", -10 ** 6, 1)]) == pytest.approx(0, abs=1 / 128)


# 13
def negatives_plainly(rows, every=50, k=5, m=3):
    usable = [(i, (l + 1) % 10 if i % 7 == 0 else l, [math.floor(256 * x) for x in v]) for i, v, l in rows
              if i is not None and l is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    anchors, out = {}, []
    for i, l, v in usable:
        if i % every == 0:
            anchors[i] = min(anchors.get(i, (v, l)), (v, l))
    for a, (v, l) in anchors.items():
        scored = sorted((-dot(v, w), i, kind == l) for i, kind, w in usable if i != a)
        for p, i, _ in [x for x in scored if x[2]][:k]:
            near = [(j, -s) for s, j, same in scored if not same and 50 * -p <= 100 * -s <= 95 * -p][:m]
            out += [(a, i, place, j, -p, s) for place, (j, s) in enumerate(near, start=1)]
    return sorted(out)


KIND = "vec_id long, embedding array<float>, label int"


def _vectors(n, width, seed, spread):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(10, width))
    rows = [(int(i), (spread * middle[i % 10] + rng.normal(size=width)).astype(np.float32).tolist(), int(i % 10)) for i in range(n)]
    return rows


def test_hard_negatives_equal_brute_force(spark):
    rows = _vectors(600, 12, 1, 0.5)
    rows += [(1000 + i, rows[50][1], i % 10) for i in range(60)]  # a hot vector: ties in every window
    rows += [(2000, None, 1), (2050, [1.0, None], 2), (2100, [float("nan")] * 12, 3), (2150, [], 3), (2200, rows[0][1], None), (None, rows[0][1], 1),
             (2250, [1.0, -2.0], 4), (2300, [0.0] * 12, 5), (100, rows[100][1], 0), (150, rows[7][1], 3), (-50, rows[9][1], 2), (77, rows[77][1], 7)]
    frame = spark.createDataFrame(rows, KIND).withColumns({c: F.lit(1) for c in ("id", "v", "norm", "windows", "block", "score", "place")})
    expected = negatives_plainly(rows)
    for found in (hard_negatives.op13_hard_negatives(frame), hard_negatives.hard_negatives(frame, rows=40, anchors=3),
                  hard_negatives.hard_negatives(frame, rows=100, turns=(0.01, 0.02, 0.5, 1.0))):
        assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
        assert sorted(tuple(r) for r in found.collect()) == expected
    assert len(expected) > 150


@pytest.mark.parametrize("rows", [[], [(50, [1.0], 1)], [(50, [1.0], 1), (51, [2.0], 1)], [(51, [1.0], 1), (52, [2.0], 2)],
                                  [(50, [1.0], 1), (51, [2.0], 1), (52, [1.5], 2)], [(50, [1.0], 1), (51, [-2.0], 1), (52, [-1.5], 2)],
                                  [(50, [1e30], 1), (51, [1.0], 1), (52, [0.6], 2)]])
def test_hard_negatives_on_small_tables(spark, rows):
    got = [tuple(r) for r in hard_negatives.op13_hard_negatives(spark.createDataFrame(rows, KIND)).collect()]
    if any(abs(x) > 1e20 for _, v, _ in rows for x in v):
        assert len(got) <= 1  # beyond 64 bits
    else:
        assert got == negatives_plainly(rows)


def test_threshold_join_loses_nothing_and_prunes():
    rng = np.random.default_rng(3)
    for width, decay in ((64, 0.93), (5, 1.0), (1, 1.0)):
        v = np.floor(256 * rng.normal(size=(800, width)) * decay ** np.arange(width) * rng.random((800, 1)))
        q = np.floor(256 * rng.normal(size=(40, width)) * decay ** np.arange(width))
        score = q @ v.T
        for share in (0.5, 0.99, 1.0):
            floor = np.quantile(score, share, axis=1)
            count: dict = {}
            found = dict(threshold_join(q, floor, v, count))
            for row in range(len(q)):
                assert set(np.flatnonzero(score[row] >= floor[row])) <= set(found.get(row, ()))
            if width == 64 and share >= 0.99:
                assert count["scored"] <= 0.15 * count["pairs"]
        found = dict(threshold_join(q, np.full(40, -np.inf), v))
        assert all(len(found[row]) == 800 for row in range(40))


def test_top_k_scores_few_pairs_exactly(spark):
    """The 2,000 vectors of a given table under their true fifth scores, which is what the longest vectors give there."""
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding").collect()
    v = np.floor(256 * np.array([r["embedding"] for r in rows], float))
    turn = np.linalg.svd(v.T @ v)[0]
    q = v[[i for i, r in enumerate(rows) if r["vec_id"] % 50 == 0]]
    floor = np.sort(q @ v.T, axis=1)[:, -6] - 1.0  # the query itself is among them
    count: dict = {}
    found = dict(threshold_join(q @ turn, floor, v @ turn, count))
    assert count["scored"] <= 0.15 * count["pairs"]
    for i in range(len(q)):
        assert set(np.flatnonzero(q[i] @ v.T >= floor[i] + 1)) <= set(found[i])
