"""Passages of which documents have different parts, and repeats within a document."""

import random

from plumbline.llm import chunk_dedup


def words(rng, n):
    return ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(n)]


def run(spark, rows):
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    return docs, chunk_dedup.op10_chunk_dedup(docs).collect()


def test_one_copy_of_every_chunk_stays(spark):
    rng = random.Random(31)
    passage = words(rng, 120)
    rows = [(i, words(rng, 30) + part + words(rng, 30)) for i, part in ((1, passage[:60]), (2, passage), (3, passage))]
    rows += [(4, words(rng, 80))]
    docs, got = run(spark, rows)
    got = {r.doc_id: r for r in got}
    assert (got[1].n_repeated, got[1].n_later) == (got[1].n_repeated, 0) and 30 < got[1].n_repeated <= 60
    assert 90 < got[2].n_repeated <= 120 and got[2].n_later == got[1].n_repeated
    assert got[2].n_passages == 2 and got[2].first_docs == [1, 2]
    assert got[3].n_later == got[3].n_repeated == got[2].n_repeated and got[3].n_passages == 1
    assert got[4].n_repeated == 0 and not got[4].has_repeats
    kept = []
    for r in chunk_dedup.repeated_passages(docs).collect():
        gone = {w for p in r.passages if p.first_key != r.key for w in range(p.start, p.end)}
        kept += [w for at, w in enumerate(dict(rows)[r.key]) if at not in gone]
    assert {w for _, row in rows for w in row} == set(kept)


def test_a_cut_run_counts_as_a_whole(spark):
    rng = random.Random(37)
    passage = words(rng, 50)
    docs, _ = run(spark, [(1, words(rng, 30) + passage[:26] + words(rng, 30)), (2, words(rng, 30) + passage + words(rng, 30)),
                            (3, words(rng, 30) + passage + words(rng, 30))])
    got = {r.key: r for r in chunk_dedup.repeated_passages(docs, min_words=30).collect()}
    assert got[1].n_repeated == 0 and got[2].n_repeated == got[2].n_later and got[3].n_repeated >= 30
    assert 0 < got[2].n_later < 30 and got[3].n_later == got[3].n_repeated


def test_repeats_within_a_document_are_counted_by_occurrence(spark):
    rng = random.Random(41)
    block, twice, other = words(rng, 60), words(rng, 60), words(rng, 60)
    _, got = run(spark, [(1, block * 200), (2, words(rng, 100)), (None, twice), (None, twice), (5, other), (5, other), (6, [])])
    one = next(r for r in got if r.doc_id == 1)
    assert 198 * 60 <= one.n_within <= 199 * 60 and (one.n_repeated, one.n_later, one.has_repeats) == (0, 0, False)
    assert [r.n_within for r in got if r.doc_id in (2, 6)] == [0, 0]
    for i in (None, 5):
        assert sorted(r.n_within for r in got if r.doc_id == i) == [0, 60]
    assert all(r.n_later == 0 for r in got)
