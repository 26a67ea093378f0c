"""Chunk deduplication and the whole pipeline against plain versions."""

import collections
import hashlib
import math
import random

import pytest

import corpus_pipeline
from plumbline.llm import chunk_dedup, mixing

MASK = (1 << 64) - 1


def scrambled(x):
    for _ in range(2):
        x ^= x >> 32
        x = x * 0xD6E8FEB86659FD93 & MASK
    return x ^ (x >> 32)


def plain_chunks(words):
    """Ends of the chunks in words, straight from the definition."""
    data, ends = b" ".join(words), []
    for w in words:
        ends.append((ends[-1] + 1 if ends else 0) + len(w))
    table = [scrambled(i) for i in range(1, 257)]
    at = [scrambled(sum(table[data[e - 1 - k]] << k for k in range(chunk_dedup.WINDOW) if e - 1 - k >= 0) & MASK) for e in ends]
    reach = chunk_dedup.REACH
    return [i + 1 for i in range(len(words)) if i == len(words) - 1 or all(
        at[i] < at[j] for j in range(max(0, i - reach), min(len(words), i + reach + 1)) if j != i)]


def plain_passages(docs, least=chunk_dedup.MIN_WORDS):
    parts, holders = {}, collections.defaultdict(set)
    for key, text in docs:
        words = text.encode().lower().split()
        start = 0
        parts[key] = []
        for end in plain_chunks(words):
            parts[key].append((start, end, b" ".join(words[start:end])))
            holders[parts[key][-1][2]].add(key)
            start = end
    out = {}
    for key, mine in parts.items():
        def runs(held):
            found, run = [], []
            for i, hit in enumerate([*held, False]):
                if hit:
                    run.append(i)
                elif run:
                    found.append(run)
                    run = []
            return [r for r in found if mine[r[-1]][1] - mine[r[0]][0] >= least]

        passages = []
        for run in runs([len(holders[c]) > 1 for _, _, c in mine]):
            sides = []
            for i in run:
                first = min(holders[mine[i][2]])
                if sides and sides[-1][2] == (first != key):
                    sides[-1][1], sides[-1][3] = mine[i][1], min(sides[-1][3], first)
                else:
                    sides.append([mine[i][0], mine[i][1], first != key, first])
            passages += [(a, b, first) for a, b, later, first in sides if later or b - a >= least]
        seen = collections.Counter()
        again = []
        for _, _, c in mine:
            again.append(seen[c] > 0)
            seen[c] += 1
        within = sum(mine[r[-1]][1] - mine[r[0]][0] for r in runs(again))
        out[key] = (mine[-1][1] if mine else 0, len(mine), sorted(passages), sum(b - a for a, b, _ in passages),
                    sum(b - a for a, b, first in passages if first != key), within)
    return out


def test_chunk_dedup_equals_the_plain_version(spark):
    rng = random.Random(41)
    word = lambda: "".join(rng.choice("abcdefghié") for _ in range(rng.randint(1, 9)))
    text = lambda n: [word() for _ in range(n)]
    shared = [text(n) for n in (30, 60, 120, 200)]
    docs = []
    for key in range(60):
        body = text(rng.randint(0, 80))
        for _ in range(rng.randint(0, 3)):
            piece = rng.choice(shared)
            cut = rng.randint(0, len(piece) // 2)
            body[(at := rng.randint(0, len(body))):at] = piece[cut:cut + rng.randint(10, len(piece))]
        docs.append((key, " ".join(body)))
    docs += [(100, " ".join(shared[2] * 4)), (101, ""), (102, "one"), (103, docs[5][1])]
    want = plain_passages(docs)
    got = chunk_dedup.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r["key"]: (r.n_words, r.n_chunks, [tuple(p) for p in r.passages], r.n_repeated, r.n_later, r.n_within) for r in got} == want
    assert sum(w[4] > 0 for w in want.values()) > 15 and want[100][5] > 0


def hashed(*parts):
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:13], 16) / 2 ** 52


def plain_copies(rate, key):
    draw, p, total, n = hashed(mixing.SEED, key), math.exp(-rate), math.exp(-rate), 0
    while total <= draw and n < 500:
        n += 1
        p *= rate / n
        total += p
    return n


def test_pipeline_equals_plain_stages(spark, tmp_path):
    """Every stage's decision is planted, so that the joint result can be told: which documents stay, their texts, how often and
    in which order they come."""
    rng = random.Random(43)
    stock = {"en": "the of and to in that which thing other would there their about people through".split(),
             "de": "der die und ein nicht mit sich auf auch werden über schön größe durch zwischen".split()}
    prose = lambda lang, n=90: [rng.choice(stock[lang]) + rng.choice(("", "e", "en", "s")) for _ in range(n)]
    rows, gone, mail = [], set(), {}
    items = [" ".join(rng.choice(stock["en"]) + rng.choice("bcdfgk") for _ in range(40)) + "." for _ in range(3)]
    for i in range(150):
        lang = "de" if i % 3 == 0 else "en"
        words = prose(lang)
        if i % 10 == 7:  # a near copy of the document before: one word of ninety differs
            words = rows[i - 1][1].split()
            words[-1] = "anders"
            gone.add(i)
        if i % 25 == 11:
            words[40:40] = items[i % 3].split()
            gone.add(i)
        if i % 20 == 3:
            mail[i] = len(" ".join(words[:10])) + 1
            words[10:10] = [f"someone{i}@mail.example.org"]
        if i % 50 == 49:
            words = ["12345", "--", "67"]  # no letter
            gone.add(i)
        text = " ".join(words)
        rows.append((i, text, lang, ("big", "small")[i % 7 == 0], len(text)))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    mixed = corpus_pipeline.run(spark, str(tmp_path))
    found = mixed.collect()

    kept = {r[0]: r for r in rows if r[0] not in gone}
    texts = {r.doc_id: r.text for r in found}
    redacted = {i: t for i, (_, t, *_) in kept.items()}
    for i in mail.keys() & kept.keys():
        address = f"someone{i}@mail.example.org"
        if i in texts:
            assert address not in texts[i] and texts[i].startswith(redacted[i].split(address)[0]) and texts[i].endswith(redacted[i].split(address)[1])
            redacted[i] = texts[i]
    assert all(texts[i] == redacted[i] for i in texts)
    # Rates follow the characters of what the stages before have kept; a redacted text that drew no copy is not seen.
    tag = next((len(texts[i]) - len(kept[i][1]) + len(f"someone{i}@mail.example.org") for i in mail if i in texts), 0)
    size = {i: len(kept[i][1]) + (tag - len(f"someone{i}@mail.example.org") if i in mail else 0) for i in kept}
    chars = collections.Counter()
    for i in kept:
        chars[kept[i][3]] += size[i]
    root = {s: n ** mixing.POWER for s, n in chars.items()}
    rate = {s: sum(chars.values()) * root[s] / sum(root.values()) / chars[s] for s in chars}
    want = {(i, k): hashed(mixing.SEED, "order", i, k) for i in kept for k in range(1, plain_copies(rate[kept[i][3]], i) + 1)}
    got = {(r.doc_id, r.copy_no): r.mix_order for r in found}
    assert got.keys() == want.keys() and len(found) == len(want)
    assert all(got[k] == pytest.approx(want[k], abs=1e-15) for k in want)
    assert not gone & {r.doc_id for r in found}
