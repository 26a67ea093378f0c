"""Licence notices that many or all documents have."""

import pytest

from plumbline.llm import licences

NOTICES = {t.label: t.text for t in licences.TEMPLATES}


def labels(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: (r.labels, r.score) for r in licences.op1_licences(docs).collect()}


def test_one_document_with_a_notice(spark):
    for label in ("lgpl", "unlicense"):
        found, score = labels(spark, [f"some file. {NOTICES[label]}. more of it"])[0]
        assert label in found.split(",") and score == pytest.approx(1.0)


def test_notice_in_half_and_in_all_documents(spark):
    for every in (1, 2):
        texts = [f"file {i} " + (NOTICES["isc"] if i % every == 0 else "has other words of its own") for i in range(40)]
        got = labels(spark, texts)
        assert all(got[i] == (("isc", pytest.approx(1.0)) if i % every == 0 else ("", 0.0)) for i in range(40))


def test_hot_notice_with_a_word_that_no_document_has(spark):
    text = NOTICES["bsd"].replace("Licensed", "Used") + " and " + NOTICES["cc0"].replace("Universal", "")
    got = labels(spark, [text] * 300)
    assert all(found == "bsd,cc0" and score > 0.8 for found, score in got.values())


def test_entries_find_every_place_that_plain_weighing_finds():
    seen = {w: (7 * k) % 100 for k, w in enumerate({w for t in licences.TEMPLATES for w in licences.words_of(t.text)})}
    index = licences.Index(seen, 100)
    for t, template in enumerate(licences.TEMPLATES):
        words = licences.words_of(template.text)
        for drop in range(len(words)):
            text = [b"x"] * 3 + words[:drop] + words[drop + 1:] + [b"y"] * 3
            plain = any(index._verified(text, t, place) and sum(index.rarity[w] for p, w in enumerate(words) if w in
                        text[max(0, place + p - 2):max(0, place + p + 3)]) >= 0.5 * index.total[t] for place in range(-2, len(text)))
            assert plain == any(m[0] == t for m in index.matches(text))
