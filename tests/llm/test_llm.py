"""Every operator against a plain version of its contract, and on awkward tables."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from plumbline.llm import chunk_dedup, decontaminate, language, licences, lm_score, mixing, near_dup, pii, topk, toxicity
from plumbline.llm import queries as registered
from plumbline.llm.common import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = {
    "en": "the of and to in that which thing other would there their about".split(),
    "de": "der die und ein nicht mit sich auf auch werden über schön größe".split(),
}


def prose(rng, lang="en", n=80):
    return " ".join(rng.choice(WORDS[lang]) + rng.choice(("", "ed", "ing", "s")) + rng.choice("abcdefgh") for _ in range(n))


def table(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)


def doc(i, text, lang="en", source="s"):
    return (i, text, lang, source, len(text) if text is not None else None)


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls in every column, empty, blank, long, repeated and non-ASCII texts, and clashing columns."""
    rng = random.Random(3)
    rows = [doc(i, prose(rng, "de" if i % 3 == 0 else "en"), "de" if i % 3 == 0 else "en") for i in range(30)]
    rows += [doc(30, None, None, None), doc(31, ""), doc(32, "  \n\t "), (None, prose(rng), None, None, None),
             (None, None, None, None, None), rows[0], rows[0], doc(33, "a" * 30_000), doc(34, "wort ß 漢字 😀 é"),
             doc(35, "x1 " * 20_000), doc(36, "12345 .. !! 99"), doc(37, rows[1][1])]
    frame = table(spark, rows)
    clash = {c: F.lit(1) for c in ("key", "row", "score", "copy_no", "digest", "spans", "node", "component", "word", "_text", "rate", "_n", "_p")}
    return frame.withColumns(clash)


@pytest.fixture(scope="module")
def labels(spark):
    return table(spark, [(i, 1, i % 2) for i in range(30)] + [(None, 1, 1), (3, None, None), (4, 1, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return table(spark, [(0, "one two three four five six. Seven eight nine ten eleven."), (1, None), (2, ""), (None, "odd item text here now")],
                 "item_id long, text string")


def test_operators_survive_awkward_tables(spark, awkward, labels, benchmark):
    n = awkward.count()
    rows = {
        "op1": licences.op1_licences(awkward), "op2": pii.op2_personal_data(awkward), "op5": language.op5_language_id(awkward),
        "op6": near_dup.op6_near_duplicates(awkward), "op8": toxicity.op8_toxicity(awkward, labels),
        "op9": lm_score.op9_lm_score(awkward), "op10": chunk_dedup.op10_chunk_dedup(awkward),
    }
    for name, df in rows.items():
        assert df.count() == n, name
    assert decontaminate.op3_decontaminate(awkward, benchmark).collect() == []
    assert mixing.mix(awkward).columns == [c for c in awkward.columns if c != "copy_no"] + ["copy_no", "mix_order"]
    by_id = {r.doc_id: r for r in rows["op5"].collect()}
    assert by_id[30].lang_pred == by_id[31].lang_pred == by_id[36].lang_pred == "und"
    assert all(0 <= r.score <= 1 for r in by_id.values())
    dup = {r.doc_id: r for r in rows["op6"].collect()}
    assert (dup[30].n_shingles, dup[30].component_id, dup[30].kept) == (0, 30, True)
    assert dup[37].component_id == 1 and not dup[37].kept
    assert (dup[33].n_shingles, dup[35].n_shingles) == (1, 1)


def test_operators_on_empty_tables(spark, benchmark, labels):
    docs = table(spark, [])
    no_labels = labels.limit(0)
    for df in (licences.op1_licences(docs), pii.op2_personal_data(docs), language.op5_language_id(docs),
               near_dup.op6_near_duplicates(docs), toxicity.op8_toxicity(docs, no_labels), lm_score.op9_lm_score(docs),
               chunk_dedup.op10_chunk_dedup(docs), decontaminate.op3_decontaminate(docs, benchmark.limit(0)), mixing.op4_mix(docs)):
        assert df.collect() == []
    vectors = table(spark, [], "vec_id long, embedding array<float>, label int")
    assert topk.op7_top_k(vectors).collect() == []


def test_pipeline_on_awkward_and_empty_tables(spark, awkward, benchmark, tmp_path):
    for name, docs in (("full", awkward), ("empty", awkward.limit(0))):
        docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/{name}/documents.parquet")
        benchmark.write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").count() == 0
    docs = spark.read.parquet(f"{tmp_path}/full/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, f"{tmp_path}/full")
        assert kept.columns == docs.columns
        assert kept.dtypes == docs.dtypes
        docs = spark.createDataFrame(kept.collect(), kept.schema)
    assert {r.doc_id for r in docs.collect()} >= set(range(30)) and docs.filter("doc_id = 0").count() == 1
    assert docs.filter("doc_id IN (30, 31, 37)").count() == 0


def test_every_operator_is_registered():
    names = registered.queries()
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in names) == list(range(1, 14))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "decontamination", "personal_data", "mixing"]


# 1
def test_licences_base_and_templates(spark):
    texts = ["MIT License and apache-license, General Public LICENSE mit license", "Licensed under CC BY-NC 4.0.",
             "x y z permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
             "documentation files the software to deal in the really software without restriction ok", "permission granted", "license mit"]
    filler = [doc(100 + i, "plain words of no licence at all") for i in range(60)]
    got = {r.doc_id: r for r in licences.op1_licences(table(spark, [doc(i, t) for i, t in enumerate(texts)] + filler)).collect()}
    assert (got[0].n_words, got[0].n_base, got[0].first_word, got[0].last_word) == (10, 4, 0, 8)
    assert got[0].base_labels == "apache,gpl,mit" and got[0].score == pytest.approx(1.0, abs=0.5)
    assert got[1].labels == "cc-by-nc" and got[1].base_labels == "" and got[1].first_word is None
    assert got[2].labels == "mit" and got[2].n_base == 0 and got[2].score >= 0.5
    assert got[3].labels == "" and got[4].labels == "" and got[100].score == 0


# 2
def base_spans(text):
    """The contract in its own words."""
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, "email", m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, "ip", m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m[0] if c.isdigit()][::-1]
        total = sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(digits))
        if 12 <= len(digits) <= 19 and total % 10 == 0:
            out.append((m.start(), 2, "card", m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((m.start(), 3, "phone", m.end()))
    return sorted(out)


def test_personal_data_base_is_the_contract(spark):
    rng = random.Random(5)
    bits = ["a@b.c", "a.b+c@x-y.de.", "@", ".", "1", "255", "256", "0001", "-", " ", "+", "(", ")", "4111 1111 1111 1111", "4539578763621486",
            "+49 (30) 1234-5678", "é", "漢", "😀", "\n", "x_", "%", "12345678901234567890", "10.0.0.1", "a@b@c.d_e@f.g", "aaa.bbb", "0.0.0.0.1"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(1, 25))) for _ in range(700)]
    texts += ["1" * 20_000, "a" * 20_000 + "@b.c", "a@b" + ".c" * 5_000, "1 " * 9_000, "+1" * 500, "1." * 5_000 + "1"]
    got = {r.doc_id: r for r in pii.op2_personal_data(table(spark, [doc(i, t) for i, t in enumerate(texts)])).collect()}
    for i, text in enumerate(texts):
        spans = base_spans(text)
        joined = ",".join(f"{k}:{a}:{b}" for a, _, k, b in spans)
        counts = collections.Counter(k for _, _, k, _ in spans)
        row = got[i]
        assert (row.n_email, row.n_ip, row.n_card, row.n_phone) == tuple(counts[k] for k in pii.BASE), text[:80]
        assert row.base_sha256 == hashlib.sha256(joined.encode()).hexdigest(), text[:80]
        assert set(filter(None, joined.split(","))) <= set(row.spans.split(","))


def test_personal_data_is_redacted_and_announced_kinds_are_found(spark):
    rows = [doc(i, f"call me at a{i}@mail.org or +1 (555) 555-01{i:02d}, token = \"abcdef{i:02d}99zz\" end") for i in range(40)]
    docs = table(spark, rows + [doc(50, None), doc(51, "nothing here"), doc(52, "a1@b.org")])
    got = {r.doc_id: r for r in pii.redact(docs).collect()}
    assert got[3].text == "call me at <EMAIL> or <PHONE>, <SECRET> end" and got[3].n_chars == len(got[3].text)
    assert got[50].text is None and got[51].text == "nothing here" and got[52].text == "<EMAIL>"
    spans = {r.doc_id: r.spans for r in pii.op2_personal_data(docs).collect()}
    assert "secret:" in spans[3]


# 3
def test_decontamination_finds_items_and_agrees_with_plain_scoring(spark):
    rng = random.Random(7)
    items = [(i, prose(rng, n=rng.randint(15, 130)) + ". " + prose(rng, n=8) + ".") for i in range(60)]
    texts = []
    for i in range(120):
        body = prose(rng, n=200).split()
        if i % 3 == 0:
            at = rng.randint(0, 199)
            body[at:at] = items[i // 2][1].split()
        texts.append(" ".join(body))
    want = {(i, i // 2) for i in range(0, 120, 3)}
    bench = table(spark, items, "item_id long, text string")
    docs = table(spark, [doc(i, t) for i, t in enumerate(texts)])
    for shard in (1000, 25):
        got = {(r.key, r.item_id) for r in decontaminate.contaminated(docs, bench, shard=shard).collect()}
        assert got == want
    left = decontaminate.keep_uncontaminated(docs, bench, shard=25)
    assert {r.doc_id for r in left.collect()} == {i for i in range(120) if i % 3}
    index = decontaminate.Index([(i, t.encode()) for i, t in items])
    weights = collections.defaultdict(dict)
    for term, i in index.terms.items():
        for u, w in zip(index.posted[i], index.impact[i]):
            weights[u][term] = w
    for text in texts[:40]:
        words = decontaminate.FIND_WORDS.findall(text.encode().lower())
        for low in range(0, len(words), decontaminate.UNIT):
            passage = set(words[low:low + 2 * decontaminate.UNIT])
            plain = {u for u, w in weights.items() if sum(w[t] for t in w.keys() & passage) >= decontaminate.THRESHOLD}
            assert {u for u, _ in index.wand(passage)} == plain
            assert not plain or (low, low + 2 * decontaminate.UNIT) in index.passages(words)


def test_scores_do_not_depend_on_the_shards(spark):
    """Near copies too: scores come from statistics over all items, whichever shard an item is in."""
    rng = random.Random(31)
    items = [(i, prose(rng, n=rng.randint(20, 120)) + ". " + prose(rng, n=6) + ".") for i in range(80)] + [(5, "same item twice here ok yes"), (5, "same item twice here ok yes")]
    texts = []
    for i in range(80):
        words = items[i][1].split()
        for _ in range(i % 12):
            words[rng.randrange(len(words))] = rng.choice("uvwxyz") * 3
        texts.append(prose(rng, n=40) + " " + " ".join(words) + " " + prose(rng, n=40))
    texts.append("x same item twice here ok yes y")
    bench, docs = table(spark, items, "item_id long, text string"), table(spark, [doc(i, t) for i, t in enumerate(texts)])
    rows = [sorted((r.key, r.item_id, r.score, r.question_overlap, r.answer_overlap) for r in decontaminate.contaminated(docs, bench, shard=n).collect())
            for n in (1000, 20, 7)]
    assert rows[0] == rows[1] == rows[2] and 40 < len(rows[0]) and [r[:2] for r in rows[0]].count((80, 5)) == 2
    assert len({r[2] for r in rows[0]}) > 20  # near copies have scores of their own


# 4
def test_mix_hits_target_weights_and_repeats(spark):
    docs = table(spark, [doc(i, "w" * 50, source="big" if i % 10 else "small") for i in range(6000)])
    mixed = mixing.mix(docs, weights={"big": 1.0, "small": 1.0}).cache()
    counts = {r["source"]: r["count"] for r in mixed.groupBy("source").count().collect()}
    assert abs(counts["big"] - 3000) < 250 and abs(counts["small"] - 3000) < 250
    again = mixing.mix(docs.orderBy(F.desc("doc_id")), weights={"big": 1.0, "small": 1.0})
    assert sorted((r.doc_id, r.copy_no) for r in mixed.collect()) == sorted((r.doc_id, r.copy_no) for r in again.collect())
    order = [r.doc_id for r in mixed.collect()]
    assert abs(np.corrcoef(order, range(len(order)))[0, 1]) < 0.1


# 5
def test_language_costs_are_those_of_a_plain_ppm(spark):
    rng = random.Random(11)
    train = [("en", prose(rng)) for _ in range(20)] + [("de", prose(rng, "de")) for _ in range(20)]
    docs = table(spark, [doc(i, t, lang) for i, (lang, t) in enumerate(train)])
    trees = language.train(docs, F.lit(True))
    rows = collections.Counter()
    for lang, text in train:
        data = language.letters(text.encode()).tolist()
        for k in range(1, language.ORDER + 2):
            for i in range(len(data) - k + 1):
                rows[lang, tuple(data[i:i + k])] += 1
    kept = {()} | {s for _, s in rows if len(s) == 1}
    for k in range(2, language.ORDER + 2):
        kept |= {s for _, s in rows if len(s) == k and rows["en", s] + rows["de", s] >= language.LEAST and s[:-1] in kept and s[1:] in kept}

    def cost(lang, context, byte):
        for k in range(min(len(context), language.ORDER), -1, -1):
            c = context[len(context) - k:]
            below = {b: rows[lang, c + (b,)] for b in range(256) if c + (b,) in kept and rows[lang, c + (b,)]}
            if not below or c not in kept:
                continue
            seen = sum(below.values()) + len(below)
            if byte in below:
                return -np.log2(below[byte] / seen)
            return -np.log2(len(below) / seen) + cost(lang, c[1:], byte) if c else -np.log2(len(below) / seen) + np.log2(trees.n_symbols)
        raise AssertionError

    for text in ("the thing über", "zzz qqq the", prose(rng, "de", 5), "é", "a"):
        data = language.letters(text.encode()).tolist()
        bits, n = trees.bits(text.encode())
        assert n == len(data) - 1
        for lang, got in zip(trees.languages, bits):
            want = sum(cost(lang, tuple(data[max(0, i - language.ORDER):i]), data[i]) for i in range(1, len(data)))
            assert got == pytest.approx(want, rel=1e-4)
    held = language.op5_language_id(table(spark, [doc(i, prose(rng, x), x) for i, x in enumerate(["en", "de"] * 60)])).collect()
    assert all((r.lang_pred == ("en", "de")[r.doc_id % 2]) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in held)


# 6
def plain_components(rows, words, percent):
    sets = {}
    for i, text in rows:
        w = (text or "").encode().lower().split()
        sets[i] = {tuple(w[j:j + words]) for j in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())
    label = {i: i for i in sets}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    label[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_near_duplicates_are_exact(spark):
    rng = random.Random(13)
    rows = []
    for family in range(25):
        base = prose(rng, n=120).split()
        for _ in range(rng.choice((1, 2, 5, 30))):
            text = list(base)
            for _ in range(rng.randint(0, 7)):
                text[rng.randrange(len(text))] = rng.choice("uvwxyz") * 3
            rows.append((len(rows) * 7 + 1, " ".join(text)))
    rng.shuffle(rows)
    want = plain_components(rows, 3, 85)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.op6_near_duplicates(table(spark, [doc(*r) for r in rows])).collect()}
    assert got == want
    assert len({c for _, c in want.values()}) > 25  # families that hang together in part only


def test_near_duplicates_are_exact_where_families_are_cut_by_rare_shingles(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK", 300)
    monkeypatch.setattr(near_dup, "FEW_PAIRS", 1)
    rng = random.Random(21)
    shared = prose(rng, n=60).split()
    rows = []
    for _ in range(60):  # half of every text is boilerplate; some have near copies
        own = [f"w{rng.randrange(10 ** 6)}" for _ in range(50)]
        for _ in range(rng.choice((1, 1, 2, 4))):
            text = shared + own
            for _ in range(rng.randint(0, 4)):
                text[rng.randrange(len(text))] = rng.choice("uvwxyz") * 3
            rows.append((len(rows) * 3 + 1, " ".join(text)))
    rng.shuffle(rows)
    want = plain_components(rows, 3, 85)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.op6_near_duplicates(table(spark, [doc(*r) for r in rows])).collect()}
    assert got == want and 60 <= len({c for _, c in want.values()}) < len(rows)


def test_boilerplate_costs_in_proportion(spark, monkeypatch):
    """Documents of half boilerplate, no two of them similar: what step 3 moves follows the number of documents."""
    moved = []
    between = near_dup._between

    def counted(blocks, percent):
        blocks = near_dup.settle(blocks)
        moved.append(blocks.count())
        return between(blocks, percent)

    monkeypatch.setattr(near_dup, "_between", counted)
    monkeypatch.setattr(near_dup, "BLOCK", 20_000)
    shared = [f"common{i}" for i in range(210)]
    for n in (300, 900):
        rows = [doc(i, " ".join(shared + [f"own{i}x{j}" for j in range(100)])) for i in range(n)]
        assert all(r.kept for r in near_dup.op6_near_duplicates(table(spark, rows)).collect())
    assert moved[1] <= 3.5 * max(moved[0], 100)


def test_components_of_long_chains(spark):
    n = 40
    links = [(i, i + 1) for i in range(n)] + [(1000, 1003), (1003, 1001)]
    random.Random(1).shuffle(links)
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(n + 1)) and got[1001] == got[1003] == 1000
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# 7
def test_top_k_is_exact(spark, monkeypatch):
    monkeypatch.setattr(topk, "VECTORS", 64)
    monkeypatch.setattr(topk, "QUERIES", 4)
    monkeypatch.setattr(topk, "LONGEST", 40)
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=8) * rng.choice((0.1, 1, 3))).tolist(), 0) for i in range(500)]
    rows[7] = (7, [float("nan")] * 8, 0)
    rows[50] = (50, rows[100][1], 0)
    rows += [(900, None, 0), (901, [1.0, None], 0), (None, [1.0] * 8, 0), (950, [float("inf")] * 8, 0), (902, [0.5, 2.0], 0),
             (499, rows[499][1], 0), (1000, [0.0] * 8, 0)]
    frame = table(spark, rows, "vec_id long, embedding array<double>, label int").withColumn("norm", F.lit("x"))
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in topk.op7_top_k(frame).collect()}
    good = [(i, [int(np.floor(256 * x)) for x in v] + [0] * (8 - len(v))) for i, v, _ in rows
            if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    want = {}
    for q, v in {i: v for i, v in good if i % 50 == 0}.items():
        best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in good if i != q)[:5]
        want |= {(q, k + 1): (i, -s) for k, (s, i) in enumerate(best)}
    assert got == want


# 8
def test_toxicity_learns_words_of_other_languages(spark):
    rng = random.Random(17)
    rows, marks = [], []
    for i in range(900):
        toxic = i % 5 == 0
        text = prose(rng, "de" if i % 2 else "en").split()
        if toxic:
            for _ in range(3):
                text[rng.randrange(len(text))] = "blarg" + rng.choice("abcdef") if i % 2 else rng.choice(("idiot", "scum"))
        rows.append(doc(i, " ".join(text), "de" if i % 2 else "en"))
        marks.append((i, 1, int(toxic)))
    got = toxicity.op8_toxicity(table(spark, rows), table(spark, marks, "doc_id long, quality int, toxic int")).collect()
    held = [r for r in got if r.held_out]
    assert len(held) > 200 and all(r.predicted == (r.doc_id % 5 == 0) for r in held)
    assert all(r.predicted == (r.score >= 0.7) for r in got)


def test_label_model_finds_planted_accuracies_without_labels():
    """Rows of 18 voters of known accuracy, four of them copies of one; labels hold a fifth of the rows only."""
    rng = np.random.default_rng(8)
    y = rng.random(6000) < 0.2
    found, chance = rng.uniform(0.3, 0.8, 18), rng.uniform(0.005, 0.05, 18)
    vote = np.where(rng.random((6000, 18)) < np.where(y[:, None], found, chance), 1, -1)
    for copy in (15, 16, 17):
        vote[:, copy] = vote[:, 14]
    anchors = np.where(rng.random(6000) < toxicity.ANCHORS, y, np.nan)
    posterior = toxicity.label_model(vote, 0.2, anchors)
    free = np.isnan(anchors)
    assert ((posterior > 0.5) == y)[free].mean() > 0.97
    for v in range(14):
        assert np.average(vote[free, v] == 1, weights=posterior[free]) == pytest.approx(found[v], abs=0.06)
        assert np.average(vote[free, v] == 1, weights=1 - posterior[free]) == pytest.approx(chance[v], abs=0.02)
    # A row's own label does not reach its posterior unless it is an anchor.
    turned = np.where(free, np.nan, anchors)
    assert np.array_equal(toxicity.label_model(vote, 0.2, turned), posterior)
    assert ((posterior > 0.5) != y)[free].sum() > 0


# 9
def test_scores_are_the_contracts(spark):
    rng = random.Random(19)
    texts = {i: prose(rng, n=20) for i in range(80)} | {80: None, 81: "ßé 漢字", 82: "neverseen"}
    monkey = lm_score.FREQUENT
    lm_score.FREQUENT = 20
    try:
        got = {r.doc_id: r for r in lm_score.op9_lm_score(table(spark, [doc(i, t) for i, t in texts.items()])).collect()}
    finally:
        lm_score.FREQUENT = monkey
    counts = collections.Counter()
    for i, t in texts.items():
        if zlib.crc32(str(i).encode()) % 10:
            counts.update((t or "").split() + [None])
    n, v = sum(counts.values()), len(counts)
    for i, t in texts.items():
        tokens = (t or "").split() + [None]
        row = got[i]
        assert (row.n_tokens, row.n_known, row.train_tokens) == (len(tokens), sum(counts[w] > 0 for w in tokens), n)
        assert row.base_score == pytest.approx(sum(np.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens), rel=1e-9)
        assert row.score < 0 and row.held_out == (zlib.crc32(str(i).encode()) % 10 == 0)


def test_lattice_sums_all_segmentations():
    weights = {b" ": 0.1, b" a": 0.2, b"a": 0.05, b"b": 0.1, b"ab": 0.15, b"aba": 0.02, b"": 0.1}
    lattice = lm_score.Lattice(weights)

    def total(text):
        return 1.0 if not text else sum(w * total(text[len(p):]) for p, w in weights.items() if p and text.startswith(p))

    def expected(text, piece):
        def walk(rest, p, n):
            if not rest:
                return p * n
            return sum(walk(rest[len(q):], p * w, n + (q == piece)) for q, w in weights.items() if q and rest.startswith(q))
        return walk(text, 1.0, 0) / total(text)

    for word in (b"a", b"ab", b"ababa", b"abababab"):
        assert lattice.log10(word) == pytest.approx(np.log10(total(b" " + word)))
        into = {}
        lattice.expect(word, 3, into)
        for piece in weights:
            if piece:
                assert into.get(piece, 0.0) == pytest.approx(3 * expected(b" " + word, piece))
    long = lattice.log10(b"ab" * 2000)
    assert np.isfinite(long) and long == pytest.approx(2 * lattice.log10(b"ab" * 1000), rel=0.01)
    into = {}
    lattice.expect(b"ab" * 2000, 1, into)
    assert sum(len(p) * n for p, n in into.items()) == pytest.approx(4001, rel=1e-6)


# 10
def test_chunks_resist_insertions_and_passages_are_found(spark):
    rng = random.Random(23)
    words = prose(rng, n=3000).encode().split()
    _, before = chunk_dedup.chunks(words)
    _, after = chunk_dedup.chunks(words[:500] + [b"inserted"] + words[500:])
    assert len(set(before) - set(after)) <= 4 and b" ".join(before) == b" ".join(words)
    assert all(len(c.split()) > chunk_dedup.REACH for c in before[1:-1])
    shared = prose(rng, n=60).split()
    rows = []
    for i in range(60):
        body = prose(rng, n=150).split()
        if i % 4 == 0:
            body[rng.randrange(150):0] = []
            at = rng.randrange(150)
            body[at:at] = shared
        rows.append(doc(i, " ".join(body)))
    rows += [doc(60, "line of ten words that is in many texts here"), doc(61, "line of ten words that is in many texts here")]
    got = {r.doc_id: r for r in chunk_dedup.op10_chunk_dedup(table(spark, rows)).collect()}
    assert {i for i, r in got.items() if r.has_repeats} == set(range(0, 60, 4))
    assert all(got[i].first_docs == [0] and 20 <= got[i].n_repeated <= 62 for i in range(0, 60, 4))
    assert got[0].n_later == 0 and got[4].n_later == got[4].n_repeated
